"""Near-duplicate documents by the Jaccard similarity of word n-grams, with PartEnum signatures.

Sets of shingles are put into bands of similar size. Two sets of one band or of neighbouring bands that are similar enough
differ in at most ``k`` features. The feature domain is parted on two levels: into first-level parts, so many that similar sets
differ in at most ``k2`` features of one of them at least, and each of these into ``n2`` second-level parts, of which that one
agrees on ``n2 - k2`` at least. So each subset of ``n2 - k2`` second-level parts of a first-level part is enumerated as a signature,
and every similar pair shares one.

Sets that share a signature, and whose sizes and sketches (an exact bound) leave a similarity possible, are joined to families. Each
family then meets with its whole sets, in cells of bounded size, and what comes back is a forest of verified links, never a row for each
pair. Equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.llm.common import BASE_A, batch_of, hand_over, id_text, mix, n_partitions, null_id, ranges, release, rolling_hash, small_batches, span_hash, stage, table, text_buffer, word_hashes, words_of
from windowforge.llm.components import components
from windowforge.llm.exchange import PACKED, bucket_bits, by_bucket, packed_rows

#: Members of a slice of a group or family, and shingles of a slice of a family: larger ones are compared slice by slice, in tasks of their own.
SLICE, SLICE_SHINGLES = 2048, 1 << 20
#: Differences left to a first-level part, its second-level parts, and most differences for which there is one first-level part only.
PART_DIFFER, PART_PARTS, UNPARTED = 1, 3, 3
_SET = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The ascending distinct hashes of each text's shingles."""
    data, off = text_buffer(texts)
    starts, ends, first = words_of(data, off)
    hashes = word_hashes(data, starts, ends, lower=True)
    rolled = rolling_hash(hashes, words, BASE_A)
    lo, hi = first[:-1], first[1:]
    short = np.flatnonzero((hi - lo < words) & (hi > lo))
    whole = dict(zip(short.tolist(), span_hash(hashes, lo[short], hi[short], BASE_A), strict=True))
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        yield np.unique(rolled[a : b - words + 1]) if b - a >= words else np.array([whole[i]] if i in whole else [], np.uint64)


def node_of(shingles: np.ndarray) -> int:
    """A 63-bit name of the set."""
    total = np.cumsum(mix(shingles ^ _SET), dtype=np.uint64)[-1] if len(shingles) else np.uint64(0)
    return int(mix(np.array([total + np.uint64(len(shingles))], np.uint64))[0] >> np.uint64(1))


def sketch(shingles: np.ndarray) -> bytes:
    """Parities: bit i is how often, modulo 2, a shingle's lowest bits are i. Sets differ in at least as many shingles as sketches in bits.

    A bit or more to a shingle, and 256 at least, so that few of the pairs that aren't similar pass.
    """
    bits = min(1 << 15, max(256, 1 << max(0, len(shingles) - 1).bit_length()))
    n = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length (that of the shortest), as rows of 64-bit words: halves of a longer one are added modulo 2."""
    width = min(map(len, sketches))
    out = []
    for k in sketches:
        x = np.frombuffer(k, np.uint64)
        while 8 * len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.stack(out)


class Bands:
    """Size bands and their signature schemes for a similarity of ``percent`` or more."""

    def __init__(self, percent: int):
        self.percent = percent
        low, self.low, self.high = 1, [], []
        while low < 1 << 40:
            self.low.append(low)
            self.high.append(low * 100 // percent)
            low = self.high[-1] + 1
        self._schemes: dict[int, tuple] = {}

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def differ(self, band: int) -> int:
        """Most features in which similar sets of this band and the one below can differ."""
        return (100 - self.percent) * 2 * self.high[band] // (100 + self.percent)

    def scheme(self, band: int) -> tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray]:
        """First-level parts, spare ones among them, k2, n2, the inner edges of all second-level parts, and for each signature of a
        first-level part the second-level parts that it leaves out and (by part) its name."""
        if band not in self._schemes:
            k = self.differ(band)
            if k <= UNPARTED:
                n1, spare, k2, n2 = 1, 0, k, k + 4
            else:
                k2, n2 = PART_DIFFER, PART_PARTS
                least = k // (k2 + 1) + 1  # in one of so many parts, similar sets differ in k2 features at most
                spare = -(-least // 16)
                n1 = least + spare
            edges = np.array([(i << 64) // (n1 * n2) for i in range(1, n1 * n2)], np.uint64)
            left_out = np.array(list(combinations(range(n2), k2)), np.int64)
            names = mix(np.arange(n1 * len(left_out), dtype=np.uint64) + np.uint64(band << 40)).reshape(n1, -1)
            self._schemes[band] = n1, spare, k2, n2, edges, left_out, names
        return self._schemes[band]

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """Of the set's band and the one above. A signature without features says nothing and is left out, unless the set has more thin
        parts (whose features could all be in the parts left out) than there are spare ones: of the ``spare + 1`` parts that differ in
        few features, one isn't thin else, and what is shared there has features."""
        out = []
        sums = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mix(shingles), dtype=np.uint64, out=sums[1:])
        own = self.of(len(shingles))
        for band in (own, own + 1):
            if not self.differ(band):  # only equal sets are similar
                continue
            n1, spare, k2, n2, edges, left_out, names = self.scheme(band)
            at = np.concatenate([[0], np.searchsorted(shingles, edges), [len(shingles)]])
            size, part = np.diff(at).reshape(n1, n2), (sums[at[1:]] - sums[at[:-1]]).reshape(n1, n2)
            value = mix(part.sum(axis=1, dtype=np.uint64)[:, None] - part[:, left_out].sum(axis=2, dtype=np.uint64) + names)
            thin = int(((size > 0).sum(axis=1) <= k2).sum())
            out.append(value.ravel() if thin > spare else value[size.sum(axis=1)[:, None] > size[:, left_out].sum(axis=2)])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


#: Of a signature, 40 bits below those of the bucket; of a node, the first 48: what falls together by that is told apart by the sketches.
_ENTRY = np.dtype([("sig", "u1", 5), ("node", "u1", 6)])
_NODE_SHIFT = 15


def _bytes_of(values: np.ndarray, first: int, n: int) -> np.ndarray:
    """Bytes first .. first + n - 1, from the most significant, of 64-bit integers."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, first : first + n]


def _number(parts: np.ndarray) -> np.ndarray:
    """Bytes (most significant first) as integers."""
    out = np.zeros((len(parts), 8), np.uint8)
    out[:, 8 - parts.shape[1] :] = parts
    return out.reshape(-1).view(">u8").astype(np.int64)


def signature_rows(docs: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """Packed (signature, node) by bucket; equal sets within a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, number = Bands(percent), 0
        for b in small_batches(batches, "text", 3 << 20):
            nodes: dict[int, np.ndarray] = {}
            for s in shingle_sets(b.column(1), words):
                if len(s) and (k := node_of(s)) not in nodes:
                    nodes[k] = bands.signatures(s)
            n = np.fromiter(map(len, nodes.values()), np.int64, len(nodes))
            if n.sum():
                sigs = np.concatenate(list(nodes.values()))
                order = np.argsort(sigs)
                entries = np.empty(len(sigs), _ENTRY)
                entries["sig"] = _bytes_of(sigs[order] << np.uint64(bits), 0, 5)
                entries["node"] = _bytes_of(np.repeat(np.fromiter(nodes, np.uint64, len(nodes)) >> np.uint64(_NODE_SHIFT), n)[order], 2, 6)
                yield packed_rows(number, sigs[order], bits, entries)
            number += 1

    return docs.mapInArrow(run, PACKED)


def _groups(bucket: int, _, payloads: list[bytes], __) -> Iterator[pa.RecordBatch]:
    """(name, prefix): the nodes of each signature that more than one has. Groups of the same nodes have one name."""
    every = np.concatenate([np.frombuffer(p, _ENTRY) for p in payloads])
    sig, node = _number(every["sig"]), _number(every["node"])
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    sig, node = sig[new], node[new]
    head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.concatenate([head, [len(sig)]]))
    head, size = head[size > 1], size[size > 1]
    if len(head):
        at = np.cumsum(size) - size
        node = node[ranges(head, size)]
        name = mix(np.add.reduceat(mix(node.view(np.uint64)), at) + size.astype(np.uint64)).view(np.int64)
        _, first = np.unique(name, return_index=True)
        yield batch_of(name=np.repeat(name[first], size[first]), prefix=node[ranges(at[first], size[first])])


def _sliced(members: DataFrame, group: str, weight: int) -> DataFrame:
    """``members`` dealt to cells (cell, side): a small group is one cell; of a large one, each slice and each two slices are.

    A slice has about ``SLICE`` members and ``weight`` shingles at most.
    """
    slices = F.ceil(F.greatest(F.count("*") / SLICE, F.sum("n") / weight)).cast("int")
    sizes = members.groupBy(group).agg(slices.alias("slices")).where("slices > 1")
    large = members.join(sizes, group).withColumn("side", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    large = large.withColumn("cell", F.least("side", "other") * F.col("slices") + F.greatest("side", "other")).drop("slices", "other")
    small = members.join(sizes, group, "left_anti").withColumn("side", F.lit(0)).withColumn("cell", F.lit(0))
    return small.unionByName(large)


def _by_cell(members: DataFrame, group: str, cells_of: Callable[[pa.Table], Callable[[int, int], tuple[np.ndarray, ...]]], names: list[str]) -> DataFrame:
    """Rows of ``cells_of(rows)(first, last + 1)`` for the members of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def answers(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key = [rows.column(k).to_numpy() for k in (group, "cell")]
            edges = np.flatnonzero(np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]), [True]]))
            answer = cells_of(rows)
            found = [answer(lo, hi) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if hi - lo > 1]
            if found:
                yield batch_of(**dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))

        for b in batches:  # ordered: the last cell of a batch may go on in the next
            if not b.num_rows:
                continue
            last = [b.column(b.schema.get_field_index(k)).to_numpy() for k in (group, "cell")]
            done = np.flatnonzero((last[0] != last[0][-1]) | (last[1] != last[1][-1]))
            if len(done):
                yield from answers(pa.Table.from_batches([*held, b.slice(0, int(done[-1]) + 1)]))
                held = [b.slice(int(done[-1]) + 1)]
            else:
                if held and any(held[-1].column(b.schema.get_field_index(k))[0].as_py() != v[0] for k, v in zip((group, "cell"), last, strict=True)):
                    yield from answers(pa.Table.from_batches(held))
                    held = []
                held.append(b)
        if held:
            yield from answers(pa.Table.from_batches(held))

    ordered = members.repartition(n_partitions(members.sparkSession), group, "cell").sortWithinPartitions(group, "cell", "node")
    return ordered.mapInArrow(run, ", ".join(f"{k} long" for k in names))


def _forest(m: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect 0 .. m-1 as ``linked(i, candidates)`` does; what is connected already is not asked again."""
    root, low, high = np.arange(m), [], []
    for i in range(m - 1):
        j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        j = linked(i, j) if len(j) else j
        if len(j):
            roots, first = np.unique(root[j], return_index=True)
            low.append(np.full(len(first), i))
            high.append(j[first])
            root[np.isin(root, roots)] = root[i]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (low, high))


def candidate_forest(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the members of each group (name, node, n, sketch) that sizes and sketches allow to be similar, directly or by others."""

    def cells_of(rows: pa.Table) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]]:
        nodes, ns, sides = (rows.column(k).to_numpy() for k in ("node", "n", "side"))
        sketches = rows.column("sketch").to_pylist()

        def cell(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            node, n, side, bits = nodes[lo:hi], ns[lo:hi], sides[lo:hi], _folded(sketches[lo:hi])
            crossed = side.min() != side.max()  # a cell of two slices: pairs within one slice belong to another cell

            def linked(i: int, j: np.ndarray) -> np.ndarray:
                j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
                j = j[side[j] != side[i]] if crossed else j
                return j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) * (100 + percent) <= (100 - percent) * (n[i] + n[j])]

            a, b = _forest(len(node), linked)
            return node[a], node[b]

        return cell

    return _by_cell(_sliced(groups, "name", 1 << 40), "name", cells_of, ["a", "b"])


def verified(families: DataFrame, percent: int, count: bool) -> DataFrame:
    """Of families (family, node, n, shingles): a forest (a, b) of the links that whole sets confirm; with ``count`` (node, n_links), for each cell."""

    def cell(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.sort_by("n").combine_chunks()
        node, n, side = (rows.column(k).to_numpy() for k in ("node", "n", "side"))
        data, off = text_buffer(rows.column("shingles"))
        flat, off = np.frombuffer(data.tobytes(), np.uint64), off // 8
        bits = 64  # some to a shingle, so that hardly a dissimilar pair passes; 32 MB for all at most
        while bits < 8 * int(n[-1]) and 2 * bits * len(n) <= 1 << 28:
            bits *= 2
        sketches = np.zeros((len(n), bits // 8), np.uint8)
        for i in range(len(n)):
            times = np.bincount((flat[off[i] : off[i + 1]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
            sketches[i] = np.packbits((times & 1).astype(np.uint8))
        sketches = sketches.view(np.uint64)
        crossed = side.min() != side.max()

        def linked(i: int, j: np.ndarray) -> np.ndarray:
            j = j[: np.searchsorted(percent * n[j], 100 * n[i], side="right")]  # sizes ascend
            j = j[side[j] != side[i]] if crossed else j
            out = []
            for at in range(0, len(j), 512):
                some = j[at : at + 512]
                some = some[np.bitwise_count(sketches[some] ^ sketches[i]).sum(axis=1) * (100 + percent) <= (100 - percent) * (n[i] + n[some])]
                if len(some):
                    own, others = flat[off[i] : off[i + 1]], flat[ranges(off[some], n[some])]
                    same = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
                    common = np.add.reduceat(same, np.cumsum(n[some]) - n[some], dtype=np.int64)
                    out.append(some[100 * common >= percent * (n[i] + n[some] - common)])
            return np.concatenate(out) if out else j[:0]

        if not count:
            a, b = _forest(len(n), linked)
            return node[a], node[b]
        degree = np.zeros(len(n), np.int64)
        for i in range(len(n) - 1):
            j = linked(i, np.arange(i + 1, len(n)))
            degree[i] += len(j)
            degree[j] += 1
        return node[degree > 0], degree[degree > 0]

    return _by_cell(_sliced(families, "family", SLICE_SHINGLES), "family", lambda rows: lambda lo, hi: cell(rows.slice(lo, hi - lo)), ["node", "n_links"] if count else ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, text_md5 and stands_first per document; with ``links`` also n_links, the number of other sets similar to its own.

    Words are runs other than blank and 0x09-0x0D, with A-Z lower-cased; a text of fewer words than a shingle has one, the
    whole sequence. Documents are linked when 100 * intersection >= percent * union; component_id is the least doc_id that links
    reach. Null, empty and blank texts have no shingles and no links. Equal sets are linked. Null ids count as smallest.
    stands_first marks the rows whose id and text (by its MD5) are the least of their component: one row, or equal rows; without shingles every row.
    Components need few of the links; to count them, every pair of a family that may be similar is verified, within components too.
    """
    rows = id_text(docs, id_col, text_col)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 3 << 20):
            sets = [(len(s), node_of(s), sketch(s)) for s in shingle_sets(b.column(1), words)]
            n, node, bits = zip(*sets, strict=True)
            yield batch_of(id=b.column(0), md5=b.column(2), n=pa.array(n, pa.int64()), node=pa.array(node, pa.int64()), sketch=pa.array(bits, pa.binary()))

    keyed = rows.withColumn("md5", F.unhex(F.md5("text")))
    named = stage(keyed.mapInArrow(name, "id long, md5 binary, n long, node long, sketch binary"))
    least_row = F.min(F.struct("id", "md5")).alias("row")
    classes = stage(named.where("n > 0").groupBy("node").agg(least_row, F.min("n").alias("n"), F.min("sketch").alias("sketch")).select("node", "row.id", "row.md5", "n", "sketch"))
    shared = by_bucket(signature_rows(rows, words, percent, bucket_bits(docs.sparkSession)), _groups, "name long, prefix long").distinct()
    known = classes.select("node", "n", "sketch", F.shiftright("node", _NODE_SHIFT).alias("prefix"))
    groups = stage(shared.join(known, "prefix").drop("prefix"))
    trees = stage(candidate_forest(groups, percent).distinct())
    release(groups)
    families = components(trees)
    release(trees)
    members = stage(families.withColumnRenamed("label", "family").join(classes.select("node", "id", "n"), "node"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 3 << 20):
            sets = list(shingle_sets(b.column(1), words))
            yield batch_of(node=pa.array([node_of(s) for s in sets], pa.int64()), shingles=pa.array([s.tobytes() for s in sets], pa.binary()))

    sets = rows.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(whole, "node long, shingles binary")
    of_families = stage(sets.join(members.drop("id"), "node").dropDuplicates(["node"]))
    found = stage(verified(of_families, percent, False).distinct())
    labels = components(found)

    joined = classes.select("node", "id", "md5").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = joined.groupBy("label").agg(least_row).select("label", F.col("row.id").alias("component"), F.col("row.md5").alias("least_md5"))
    by_node = joined.join(least, "label").select("node", "component", "least_md5")
    if links:
        degree = verified(of_families, percent, True).groupBy("node").agg(F.sum("n_links").alias("n_links"))
        by_node = by_node.join(degree, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    by_node, count = stage(by_node), ["n_links"] if links else []
    release(of_families, members, families, found, labels, classes)
    first = ((F.col("id") == F.col("component")) & (F.col("md5") == F.col("least_md5"))).alias("stands_first")
    linked = named.where("n > 0").join(by_node, "node").select("id", "n", "component", *count, "md5", first)
    none = named.where("n = 0").select("id", "n", F.col("id").alias("component"), *(F.lit(0).cast("long").alias(k) for k in count), "md5", F.lit(True).alias("stands_first"))
    out = linked.unionByName(none).select(null_id().alias("doc_id"), F.col("n").alias("n_shingles"), null_id("component").alias("component_id"), *count, F.col("md5").alias("text_md5"), "stands_first")
    return hand_over(out, named, by_node)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(CASE WHEN len(ws) < 4 THEN ws ELSE ws[i:i + 3] END, ' ')) AS g
  FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
