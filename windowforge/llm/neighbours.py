"""Approximate nearest neighbours by cosine: inverted lists of coarse centroids, product-quantised residuals, exact reranking.

Centroids and codebooks are fitted on a sample of at most ``FIT_ROWS`` vectors (those with the smallest hash of their id);
every vector is indexed. A query visits the lists nearest to it; asymmetric distance tables over their members' codes choose one pool of
``POOL`` candidates from all of them, and only these are scored on the original vectors. The index is dealt to shares by a hash of the row, so that
each share has a part of every list and a list that holds a third of all vectors is spread like any other; queries stream past the shares, and no
row of the index is copied. Within a share the rows lie by list, so a query reads the lists that it visits and no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowforge.llm.common import batch_of, column, hand_over, n_partitions, ranges, stage, table
from windowforge.llm.shares import n_shares, past_shares

#: Bounds of the fit: rows of the sample, rows for the codebooks, coarse lists, codewords of a part, Lloyd rounds.
FIT_ROWS, BOOK_ROWS, MAX_LISTS, CODEWORDS, ROUNDS = 20_000, 8192, 4096, 256, 8
#: Share of the lists that a query visits, dimensions of a part, candidates reranked for each neighbour wanted.
PROBE_SHARE, PART_DIMS, POOL = 0.4, 2, 10
#: Queries whose tables are held at once; how much larger a part of the rows is than the one whose pools bound its own; room for rounding in bounds.
BLOCK, PART, ROUNDING = 128, 8, 1e-4


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # neither tiny nor huge components leave what squares can hold
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(axis=1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin(half - x[at : at + 4096] @ c.T, axis=1)
    return out


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


class Quantiser:
    """Coarse centroids and, for each part of the dimensions, codewords of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        x = _unit(sample)
        self.dims = x.shape[1]
        self.coarse = k_means(x, lists, 1)
        rest = (x - self.coarse[_nearest(x, self.coarse)])[:BOOK_ROWS]
        cuts = list(range(0, self.dims, PART_DIMS)) + [self.dims]
        self.parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.books = [k_means(rest[:, a:b], CODEWORDS, 2 + a) for a, b in self.parts]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and what of a member's squared distance doesn't hang on the query: r.r + 2 c.r for its decoded residual r."""
        own = _nearest(unit, self.coarse)
        centre = self.coarse[own]
        rest = unit - centre
        codes = np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        decoded = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)
        return own, codes, (decoded * (decoded + 2 * centre)).sum(axis=1).astype(np.float32)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """(query, part * codeword): -2 times the products of the queries with the codewords."""
        out = np.zeros((len(unit), len(self.parts), CODEWORDS), np.float32)
        for k, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            out[:, k, : len(book)] = -2 * (unit[:, a:b] @ book.T)
        return out.reshape(len(unit), -1)

    def to_lists(self, unit: np.ndarray) -> np.ndarray:
        """(query, list): squared distances but for the query's own square."""
        return (self.coarse * self.coarse).sum(axis=1) - 2 * (unit @ self.coarse.T)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the vectors that take part: none null or empty, no null, NaN or infinite component, not all zero."""
    vec = F.col(vec_col).cast("array<double>")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & good)


def _pooled(order: tuple[np.ndarray, ...], want: int) -> np.ndarray:
    """Places of the ``want`` least of rows ordered by (distance, id, row)."""
    far, ids, rows = order
    pool = np.arange(len(far))
    if len(far) > want:
        pool = np.flatnonzero(far <= np.partition(far, want - 1)[want - 1])
    return pool[np.lexsort((rows[pool], ids[pool], far[pool]))][:want]


def search(vectors: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", probe_share: float = PROBE_SHARE, pool: int = POOL) -> DataFrame:
    """query_id, query_row, rank, vec_id, score: for each row whose id is divisible by ``every``, the ``k`` nearest other rows found.

    Ties go to the smaller id, then to the row read first. Every row is a query or candidate of its own: rows that share an id are ranked apart (by
    query_row, a number of the row) and find each other. Vectors of another length than most of the sample take no part, nor do null ids
    or vectors that are null, empty, zero or hold null, NaN or infinite components. If fewer than ``k`` candidates exist, all are returned. An
    empty table gives no rows. At most ``pool * k`` candidates of a query are scored exactly.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toPandas()  # a bounded sample
    if not len(sample):
        return spark.createDataFrame([], "query_id long, query_row long, rank int, vec_id long, score double")
    dims = int(sample["vec"].map(len).mode()[0])
    fit = np.stack([v for v in sample["vec"] if len(v) == dims])
    rows = rows.where(F.size("vec") == dims)
    total = rows.count()
    q = Quantiser(fit, int(np.clip(4 * np.sqrt(total), 1, min(MAX_LISTS, max(1, len(fit) // 8)))))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for b in batches:
            if b.num_rows:
                own, codes, rest = q.encode(_unit(_matrix(b.column(1), dims)))
                number = np.arange(at, at + b.num_rows)
                at += b.num_rows
                yield batch_of(row=number, list=pa.array(own.astype(np.int32)), id=b.column(0), code=pa.array([c.tobytes() for c in codes], pa.binary()), rest=rest, vec=b.column(1))

    indexed = stage(rows.mapInArrow(index, "row long, list int, id long, code binary, rest float, vec array<double>"))
    sizes = np.zeros(len(q.coarse), np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():  # as many rows as lists
        sizes[r["list"]] = r["n"]
    visits, want = max(1, int(np.ceil(probe_share * len(q.coarse)))), pool * k
    asked = indexed.where(F.pmod("id", F.lit(every)) == 0)

    def by_list(t: pa.Table) -> tuple[np.ndarray, ...]:
        """A share's rows in the order of their lists, and where each list begins."""
        own = t.column("list").to_numpy()
        order = np.argsort(own, kind="stable")
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(own), -1)[order].astype(np.int32)
        codes += CODEWORDS * np.arange(codes.shape[1], dtype=np.int32)
        return (*(t.column(c).to_numpy()[order] for c in ("row", "id", "rest")), own[order], codes, np.searchsorted(own[order], np.arange(len(sizes) + 1)))

    def answer(share: tuple[np.ndarray, ...], asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, ids, rest, own, codes, first = share
        asker, unit = asks.column("row").to_numpy(), _unit(_matrix(asks.column("vec"), dims))
        bounds = np.nan_to_num(column(asks, "bound").astype(np.float64), nan=np.inf) + ROUNDING
        for a in range(0, len(asker), BLOCK):
            block, most = unit[a : a + BLOCK], bounds[a : a + BLOCK]
            tables, to_lists = q.tables(block), q.to_lists(block)
            near = np.argsort(to_lists, axis=1, kind="stable")
            # further lists only where those visited could hold too few rows
            need = np.cumsum(sizes[near], axis=1) - sizes[near] < k + 1
            visited = (np.arange(len(sizes)) < visits) | need
            found: list[tuple[np.ndarray, ...]] = []
            for i in range(len(block)):
                lists = near[i][visited[i]]
                some = ranges(first[lists], first[lists + 1] - first[lists])
                some = some[row[some] != asker[a + i]]
                far = to_lists[i][own[some]].astype(np.float32) + rest[some] + tables[i][codes[some]].sum(axis=1)
                some, far = some[far <= most[i]], far[far <= most[i]]
                best = _pooled((far, ids[some], row[some]), want)
                found.append((np.full(len(best), asker[a + i]), row[some][best], ids[some][best], far[best]))
            yield batch_of(**dict(zip(("query_row", "near_row", "vec_id", "far"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    members, asking = indexed.select("row", "list", "id", "code", "rest"), asked.select("row", "vec").withColumn("bound", F.lit(None).cast("float"))
    by = lambda *order: Window.partitionBy("query_row").orderBy(*order)
    # a part of the rows bounds a query's pool for a part eight times as large: what leaves the shares grows with the queries, not with queries times shares
    kept = [indexed]
    for round_ in range(math.ceil(math.log(n_shares(total, n_partitions(spark)), PART)), -1, -1):
        some = members.where(F.pmod(F.xxhash64("row", F.lit(round_ > 0)), F.lit(PART**round_)) == 0)
        near = past_shares(some, asking, total // PART**round_, by_list, answer, "query_row long, near_row long, vec_id long, far float").withColumnRenamed("near_row", "row")
        pooled = near.withColumn("n", F.row_number().over(by("far", "vec_id", "row"))).where(F.col("n") <= want)
        if round_:
            kept.append(stage(pooled.where(F.col("n") == want).select(F.col("query_row").alias("row"), F.col("far").alias("bound"))))
            asking = asked.select("row", "vec").join(kept[-1], "row", "left")
    pooled = pooled.drop("n", "far")
    vecs = indexed.select("row", "vec")
    both = pooled.join(vecs, "row").join(asked.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("vec").alias("query_vec")), "query_row")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column(4), dims), _matrix(b.column(5), dims)
                big = np.abs(x).max(axis=1)[:, None], np.abs(y).max(axis=1)[:, None]  # a scale that cancels out
                x, y = x / big[0], y / big[1]
                cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(cosine)], ["query_row", "query_id", "row", "vec_id", "score"])

    scored = both.select("query_row", "query_id", "row", "vec_id", "vec", "query_vec").mapInArrow(score, "query_row long, query_id long, row long, vec_id long, score double")
    ranked = scored.withColumn("rank", F.row_number().over(by(F.desc("score"), "vec_id", "row"))).where(F.col("rank") <= k)
    return hand_over(ranked.select("query_id", "query_row", "rank", "vec_id", "score"), *kept)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), every=50).drop("query_row")
