"""Best-fit packing by minimum bin slack.

Documents are cut into pieces of at most ``capacity`` tokens. Packing needs the lengths only, and there are at most
``capacity`` different ones: the histogram of lengths (at most ``capacity`` rows, whatever the input) goes to the
driver, which fills bin after bin by a bitset subset-sum over the lengths still there. A bin's combination is taken as
often as the counts allow, so that the plan stays short. Every piece then finds its bin from its rank among the pieces
of its length; ranks are made in salted groups, so that a frequent length is no bottleneck.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowforge.llm import tokens
from windowforge.llm.common import batch_of, column, id_text, n_partitions, null_id, ranges, small_batches, stage, table

PIECE = "id long, piece int, start long, length int, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. Only documents of over ``capacity`` ids are cut; their first piece takes the odd rest.

    A null or empty text still has its end id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, glued=True)
        for b in small_batches(batches, "text", 2 << 20):
            ids, off = enc.encode(b.column(1).to_pylist())
            n = np.diff(off) + 1
            wide = np.full(int(n.sum()), end_id, np.uint32)
            first = np.cumsum(n) - n
            wide[ranges(first, n - 1)] = ids
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = ranges(np.zeros(len(n), np.int64), pieces)
            head = n - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[doc], capacity)
            at = first[doc] + start
            view = memoryview(wide).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
            yield batch_of(id=column(b, "id")[doc], piece=piece.astype(np.int32), start=start, length=length.astype(np.int32), ids_crc32=crc)

    return id_text(docs, id_col, text_col).mapInArrow(encode, PIECE)


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of the available lengths that fills ``room`` as far as possible, long ones preferred."""
    reach, layers = 1, []
    mask = (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left = min(int(counts[length]), room // length)
        part = 1
        while left:  # binary parts of the count
            take = min(part, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return list(out.items())


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, [(length, pieces of it in each), ...]) until no piece is left: the longest piece is laid first, and
    the fullest combination of the others is laid beside it."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    while (left := np.flatnonzero(counts)).size:
        longest = int(left[-1])
        counts[longest] -= 1
        use = dict(fullest(counts, capacity - longest)) if longest < capacity else {}
        counts[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        times = min(int(counts[k]) // n for k, n in use.items())
        for k, n in use.items():
            counts[k] -= times * n
        plan.append((times, sorted(use.items(), reverse=True)))
    return plan


def places(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, for the k-th combination that holds it: first rank, pieces in a bin, first bin, first offset in a bin."""
    seen = np.zeros(capacity + 1, np.int64)
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for times, use in plan:
        offset = 0
        for length, n in use:
            rows.setdefault(length, []).append((int(seen[length]), n, first, offset))
            seen[length] += times * n
            offset += length * n
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32) with sequence_id and offset. Lengths lie from 1 to ``capacity``."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    where = places(plan_bins(histogram, capacity), capacity)

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(n_partitions(pieces.sparkSession))).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(inside)).join(first, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") - 1).alias("nth"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth = column(b, "length"), column(b, "nth")
            seq, off = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, edges) if len(order) else ():
                n = int(length[rows[0]])
                rank, each, bin0, off0 = where[n]
                k = np.searchsorted(rank, nth[rows], side="right") - 1
                r = nth[rows] - rank[k]
                seq[rows], off[rows] = bin0[k] + r // each[k], off0[k] + r % each[k] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(3).cast(pa.int64()), b.column(4), pa.array(seq), pa.array(off)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lay, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut, then pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty, null ids stay null, repeated rows are packed each; an empty table gives no rows.
    """
    pieces = stage(cut_pieces(docs, path or tokens.default_path("byte_bpe_50k.json"), end_id, capacity, id_col, text_col))
    return pack(pieces, capacity).select(null_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
