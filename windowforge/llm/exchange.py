"""Compact exchanges for operators that look for equal contents among all positions of all texts.

Documents, ordered by id, are cut into chunks of a few MB; a chunk is one row and is the unit in which positions are
numbered. What a chunk wants compared goes out as one packed row per bucket of hash values, not as a row per position.
Before that, a chunk reduces equal values of its own to one, so a content that a third of all rows hold
reaches its bucket once per chunk. Answers return by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from windowforge.llm.common import batch_of, id_text, n_partitions, small_batches, stage, text_buffer, with_row

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
PACKED = "bucket int, chunk long, payload binary, extra binary"


def ordered_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, rows: bool = False) -> DataFrame:
    """Staged rows (chunk, ids, texts): all documents by (id, text hash); chunk numbers ascend in that order.

    With ``rows`` also ``rows``: each document's other columns and whether its text is null, as a struct.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal number
            whole = pa.Table.from_batches(held).combine_chunks()
            bounds = pa.array([0, whole.num_rows], pa.int32())
            number += 1
            lists = [pa.ListArray.from_arrays(bounds, c.combine_chunks()) for c in whole.columns]
            return batch_of(chunk=[number - 1], **dict(zip(("ids", "texts", "rows"), lists)))  # rows only where asked for

        for b in small_batches(batches, "text", chunk_bytes):
            n = len(text_buffer(b.column(1))[0])
            if held and size + n > chunk_bytes:
                yield flush()
                held, size = [], 0
            held.append(b)
            size += n
        if held:
            yield flush()

    n = n_partitions(docs.sparkSession)
    plain = id_text(docs, id_col, text_col, rows).withColumn("tie", F.xxhash64("text"))
    schema = with_row("chunk long, ids array<long>, texts array<string>", None)
    if rows:
        plain = plain.withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != text_col], F.col(f"row.`{text_col}`").isNull().alias("no_text__")))
        schema = schema.add("rows", ArrayType(plain.schema["row"].dataType))
    plain = plain.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").drop("tie")
    return stage(plain.mapInArrow(cut, schema))


def bucket_bits(spark: SparkSession) -> int:
    """Buckets, as a power of two: a few to a partition."""
    return max(1, (2 * n_partitions(spark) - 1).bit_length())


def bucket_bounds(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where the buckets (leading bits) begin in ascending 64-bit hashes; one more than buckets."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def packed_rows(chunk: int, sorted_hashes: np.ndarray, bits: int, payload: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each bucket that has values; ``payload`` and ``extra`` run parallel to the hashes."""
    bounds = bucket_bounds(sorted_hashes, bits)
    full = np.flatnonzero(np.diff(bounds))
    cut = lambda x: [x[bounds[k] : bounds[k + 1]].tobytes() for k in full]
    return batch_of(
        bucket=pa.array(full.astype(np.int32)),
        chunk=pa.array(np.full(len(full), chunk, np.int64)),
        payload=pa.array(cut(payload), pa.binary()),
        extra=pa.array(cut(extra) if extra is not None else [None] * len(full), pa.binary()),
    )


def by_bucket(packed: DataFrame, answer, schema: str) -> DataFrame:
    """``answer(bucket, chunks, payloads, extras)`` over all rows of a bucket yields rows of ``schema``.

    A task holds the packed rows of its buckets; their number follows the number of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[int, bytes, bytes | None]]] = {}
        for b in batches:
            for k, c, p, x in zip(*(col.to_pylist() for col in b.columns), strict=True):
                found.setdefault(k, []).append((c, p, x))
        while found:
            k, rows = found.popitem()
            rows.sort(key=lambda r: r[0])
            yield from answer(k, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])

    return packed.repartition(n_partitions(packed.sparkSession), "bucket").mapInArrow(run, schema)


def gathered(answers: DataFrame, *cols: str) -> DataFrame:
    """(chunk, answers): what came back for each chunk, bounded by what the chunk sent out."""
    return answers.groupBy("chunk").agg(F.collect_list(F.struct(*cols)).alias("answers"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.Array, list[dict]]]:
    """chunk, ids, texts and answers of each chunk row."""
    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            ids, texts = b.column(names.index("ids"))[i].values, b.column(names.index("texts"))[i].values
            extra = (b.column(names.index("answers"))[i].as_py() or []) if "answers" in names else []
            yield b.column(names.index("chunk"))[i].as_py(), ids.to_numpy(zero_copy_only=False), texts, extra
