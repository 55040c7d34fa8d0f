"""Hard negatives by inner product: rows of another label that score nearly as high as an anchor's best rows of its own.

The search prunes by coordinates. A share of the rows is parted into buckets of similar length, longest first; a bucket keeps its unit vectors as sorted lists,
one a coordinate. The score that an anchor still needs gives a least cosine in the bucket, and with it, for the anchor's largest coordinates (its focus), the
range in which a row's coordinate must lie. The ranges are looked up in the sorted lists and their rows intersected; only these are scored, on the
original integers. A bucket whose ranges leave nothing out is scored by one matrix product, one whose length rules it out not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowforge.llm.common import NULL_ID, batch_of, hand_over, null_id, release, stage, table
from windowforge.llm.shares import past_shares

#: Length of a bucket's shortest row as a share of its longest's, rows of a bucket at most, coordinates in an anchor's focus, anchors scored together.
RATIO, BUCKET_ROWS, FOCUS, BLOCK = 0.9, 4096, 4, 128
#: Room for rounding when bounds are compared.
SLACK = 1e-9


def vectors_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, id, label, vec array<double>, all integers) of the rows that take part: label and vector not null, no component null, NaN or infinite."""
    vec = F.col(vec_col).cast("array<double>")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & good)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for b in batches:
            values = b.column(2).flatten().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(b.column(2).offsets.to_numpy() - b.column(2).offsets[0].as_py(), pa.array(np.floor(256 * values))) if b.num_rows else b.column(2)
            yield batch_of(row=np.arange(at, at + b.num_rows), id=b.column(0), label=b.column(1), vec=lists)
            at += b.num_rows

    return rows.mapInArrow(numbered, "row long, id long, label long, vec array<double>")


def _matrices(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each number of dimensions: the places of its rows and their vectors."""
    vec = rows.column(rows.schema.get_field_index("vec"))
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    off, flat = vec.offsets.to_numpy() - vec.offsets[0].as_py(), vec.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(off)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield at, flat.reshape(-1, d) if len(at) == len(sizes) else flat[(off[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)


def _lengths(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, initial=1)  # neither do squares of large components overflow
    return big * np.sqrt(((x / big[:, None]) ** 2).sum(axis=1))


def _exact(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of integers, as doubles where those hold every sum, else as Python's integers."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(p).max(initial=0) < 2.0**53:
        return q @ p.T
    as_int = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return as_int(q) @ as_int(p).T


class Bucket:
    def __init__(self, vec: np.ndarray, unit: np.ndarray, lengths: np.ndarray, places: np.ndarray):
        self.vec, self.unit, self.places, self.longest = vec, unit, places, float(lengths[0])
        self.low, self.high = unit.min(axis=0), unit.max(axis=0)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by ascending coordinate, and the coordinate's values; made when a focus first asks for it."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows whose coordinates lie in all ranges of the focus."""
        spans = []
        for f, a, z in zip(focus.tolist(), low.tolist(), high.tolist(), strict=True):
            order, values = self.sorted_list(f)
            spans.append(order[np.searchsorted(values, a) : np.searchsorted(values, z, side="right")])
        spans.sort(key=len)
        met = spans[0]
        for other in spans[1:]:
            if len(other) < len(self.unit):
                met = np.intersect1d(met, other, assume_unique=True)
        return met


class Share:
    """The rows of a share: their buckets for each number of dimensions."""

    def __init__(self, rows: pa.Table):
        self.row, self.id, self.label = (rows.column(c).to_numpy() for c in ("row", "id", "label"))
        self.buckets: dict[int, list[Bucket]] = {}
        for places, vec in _matrices(rows):
            lengths = _lengths(vec)
            order = np.argsort(-lengths, kind="stable")
            vec, lengths, places = vec[order], lengths[order], places[order]
            unit = vec / np.where(lengths > 0, lengths, 1)[:, None]
            a, own = 0, self.buckets.setdefault(vec.shape[1], [])
            while a < len(vec):
                z = min(a + BUCKET_ROWS, int(np.searchsorted(-lengths, -RATIO * lengths[a], side="right")))
                own.append(Bucket(vec[a:z], unit[a:z], lengths[a:z], places[a:z]))
                a = z

    def scored(self, asked: np.ndarray, needs) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the anchor, places, scores) of the rows that may reach ``needs(number)``, asked anew before each bucket; -inf needs all, inf none."""
        lengths = _lengths(asked)
        unit = asked / np.where(lengths > 0, lengths, 1)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        own = np.take_along_axis(unit, focus, axis=1)
        for bucket in self.buckets.get(asked.shape[1], []):
            need = np.array([needs(i) for i in range(len(asked))])
            most = lengths * bucket.longest
            open_ = np.flatnonzero(most * (1 + SLACK) >= need)
            if not len(open_):
                continue
            cosine = np.where(need[open_] > 0, need[open_] / np.maximum(most[open_], 1e-300) - SLACK, -1.0).clip(-1, 1)[:, None]
            side = np.sqrt(np.maximum(0, (1 - own[open_] ** 2)) * (1 - cosine**2))
            low = np.where(own[open_] <= -cosine, -1.0, own[open_] * cosine - side) - SLACK
            high = np.where(own[open_] >= cosine, 1.0, own[open_] * cosine + side) + SLACK
            pruned = (cosine[:, 0] > 0) & ((low > bucket.low[focus[open_]]) | (high < bucket.high[focus[open_]])).any(axis=1)
            whole = open_[~pruned]
            if len(whole):
                for i, scores in zip(whole.tolist(), _exact(asked[whole], bucket.vec), strict=True):
                    yield i, bucket.places, scores
            for k in np.flatnonzero(pruned).tolist():
                i = int(open_[k])
                met = bucket.candidates(focus[i], low[k], high[k])
                if len(met):
                    yield i, bucket.places[met], _exact(asked[i : i + 1], bucket.vec[met])[0]


class Best:
    """The first ``k`` of what was offered: by score downwards, then by id and row."""

    __slots__ = ("k", "score", "id", "row")

    def __init__(self, k: int):
        self.k, self.score, self.id, self.row = k, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def offer(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(score) > self.k and score.dtype != object:
            some = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, rows = score[some], ids[some], rows[some]
        if len(score):
            score, ids, rows = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.row, rows])
            first = np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i], rows[i]))[: self.k]) if score.dtype == object else np.lexsort((rows, ids, -score))[: self.k]
            self.score, self.id, self.row = score[first], ids[first], rows[first]


def _blocks(asks: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at, vec in _matrices(asks):
        for a in range(0, len(at), BLOCK):
            yield at[a : a + BLOCK], vec[a : a + BLOCK]


def _listed(found: list[tuple], names: str) -> pa.RecordBatch:
    return batch_of(**{n: pa.array(c, pa.int64()) for n, c in zip(names.split(), zip(*found, strict=True), strict=True)})


def mine(
    vectors: DataFrame, every: int, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, anchor_row, positive_id, positive_row, rank, negative_id, negative_row, positive_score, negative_score.

    Components become floor(256 x); a score is the integer inner product, higher first, ties by smaller id, then by the row read first. Anchors are the rows
    whose id is divisible by ``every``, their positives the first ``positives`` other rows of the label; for each of these, the first ``negatives``
    rows of other labels with least% of its score <= score <= most%. Exact: every row is scored or ruled out by a bound. All where there are fewer; a positive
    that no row fits has none. Every row stands for itself: repeated ids are anchors and candidates of their own, told apart by the row
    numbers. Rows with a null label or vector, or a null, NaN or infinite component take no part. A null id is no anchor; as a candidate it is smaller than all
    others and stays null. Vectors meet those of the same number of dimensions. A score beyond a long is an error. An empty table gives no rows.
    """
    index = stage(vectors_of(vectors, id_col, vec_col, label_col))
    total = index.count()
    asked = index.where((F.col("id") != F.lit(NULL_ID)) & (F.pmod("id", F.lit(every)) == 0))

    def own_label(share: Share, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, label = asks.column("row").to_numpy(), asks.column("label").to_numpy()
        found: list[tuple] = []
        for at, vec in _blocks(asks):
            best = [Best(positives) for _ in at]
            for i, places, scores in share.scored(vec, lambda i: best[i].least()):
                some = (share.label[places] == label[at[i]]) & (share.row[places] != row[at[i]])
                best[i].offer(scores[some], share.id[places[some]], share.row[places[some]])
            found += [(int(row[at[i]]), int(r), int(v), int(s)) for i, b in enumerate(best) for s, v, r in zip(b.score, b.id, b.row, strict=True)]
        if found:
            yield _listed(found, "anchor_row positive_row positive_id positive_score")

    own = past_shares(index, asked, total, Share, own_label, "anchor_row long, positive_row long, positive_id long, positive_score long")
    place = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = own.withColumn("n", place(["anchor_row"], F.desc("positive_score"), "positive_id", "positive_row")).where(F.col("n") <= positives)
    pairs = first.groupBy("anchor_row").agg(F.collect_list(F.struct("positive_row", "positive_id", "positive_score")).alias("p"))  # at most ``positives`` each
    asking = stage(asked.join(pairs.withColumnRenamed("anchor_row", "row"), "row"))

    def other_labels(share: Share, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, ids, label, pairs = (asks.column(c) for c in ("row", "id", "label", "p"))
        row, ids, label = row.to_numpy(), ids.to_numpy(), label.to_numpy()
        found: list[tuple] = []
        for at, vec in _blocks(asks):
            held = []
            for i in at.tolist():
                p = pairs[i].as_py()
                bounds = [(-(-least * x["positive_score"] // 100), most * x["positive_score"] // 100, x, Best(negatives)) for x in p]
                held.append([b for b in bounds if b[0] <= b[1]])
            for i, places, scores in share.scored(vec, lambda i: min((max(lo, b.least()) for lo, _, _, b in held[i]), default=np.inf)):
                if not held[i]:
                    continue
                some = np.flatnonzero((share.label[places] != label[at[i]]) & (scores >= min(lo for lo, *_ in held[i])) & (scores <= max(hi for _, hi, *_ in held[i])))
                scores, places = scores[some], places[some]
                for lo, hi, _, b in held[i]:
                    fits = (scores >= max(lo, b.least())) & (scores <= hi)
                    b.offer(scores[fits], share.id[places[fits]], share.row[places[fits]])
            for i, bounds in zip(at.tolist(), held, strict=True):
                found += [(int(row[i]), int(ids[i]), x["positive_row"], x["positive_id"], x["positive_score"], int(r), int(v), int(s)) for _, _, x, b in bounds for s, v, r in zip(b.score, b.id, b.row, strict=True)]
        if found:
            yield _listed(found, "anchor_row anchor_id positive_row positive_id positive_score negative_row negative_id negative_score")

    schema = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, negative_row long, negative_id long, negative_score long"
    near = past_shares(index, asking, total, Share, other_labels, schema)
    rank = place(["anchor_row", "positive_row"], F.desc("negative_score"), "negative_id", "negative_row")
    out = stage(near.withColumn("rank", rank).where(F.col("rank") <= negatives))
    release(index, asking)
    cols = ["anchor_id", "anchor_row", null_id("positive_id").alias("positive_id"), "positive_row", "rank", null_id("negative_id").alias("negative_id"), "negative_row", "positive_score", "negative_score"]
    return hand_over(out.select(*cols), out)


def relabelled(embeddings: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 7 have the next of ten labels."""
    return embeddings.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = mine(relabelled(table(spark, sf_dir, "embeddings")), every=100)
    return hand_over(mined.drop("anchor_row", "positive_row", "negative_row"), mined)


ORACLE_OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS own, b.r AS br, b.vec_id AS other, list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.vec) = len(b.vec) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other NULLS FIRST, br) <= 5)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER w AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.own AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.other NULLS FIRST, n.br) QUALIFY row_number() OVER w <= 10
"""
