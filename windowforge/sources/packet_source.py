"""A data source for packet files whose partitions are byte ranges, so that a file of any length is read by many tasks.

Where a range's first record starts follows from the sizes of all records before it. Each range first takes the place where it would start if all
records were as long as the file's first, and follows the sizes from there to its end. Ranges whose start isn't where the range before them ended follow
the sizes once more, from the place that the last proven range leads to, until every range begins where its predecessor ends.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from windowforge.sources.scratch import staged

# The layout of a record's header.
HEADER, DIMS = 272, (("num_rx", 46, 1), ("num_tx", 47, 1), ("num_subcarriers", 52, 4))

#: Bytes of a range; bytes read at once.
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20

#: Bytes and ranges of a task, which has several short ranges or one long one.
TASK_BYTES, TASK_RANGES = 64 << 20, 1000

SHAPES = "array<struct<rx:long,tx:long,sc:long,n:long>>"
RANGES = f"sample_id string, path string, length long, k long, start long, end long, entry long, exit long, records long, step long, stop string, wrong long, shapes {SHAPES}, head binary"
_NAMES = "sample_id path length k start end entry exit records step stop wrong shapes head".split()


class ByteReader:
    """Bytes of a file, read a block at a time where records are short."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        self.file, self.at, self.block = store.open_input_file(name), 0, b""

    def read(self, at: int, n: int, ahead: int = 0) -> bytes:
        if at < self.at or at + n > self.at + len(self.block):
            self.at, self.block = at, self.file.read_at(max(n, ahead), at)
        return self.block[at - self.at : at - self.at + n]


def number(head: bytes, at: int, size: int) -> int:
    return int.from_bytes(head[at : at + size], "little")


def chain(read: ByteReader, length: int, entry: int, end: int) -> tuple:
    """(exit, records, step, stop, wrong, shapes) of the records that start from ``entry`` on and before ``end``.

    ``stop`` says why the file ends there: a size of 0, or bytes that are no whole record; ``wrong`` counts headers that contradict themselves, ``shapes`` the
    dimensions of the others, the first one first.
    """
    at, records, wrong, shapes, step, stop = entry, 0, 0, {}, 0, None
    while at < end and at < length:
        head = read.read(at, min(HEADER, length - at), 0 if step > BLOCK_BYTES >> 2 else BLOCK_BYTES)
        size = number(head, 0, 4) if len(head) == HEADER else 1
        if size == 0 or at + HEADER + size > length:
            stop = "trailing_partial" if size else "bad_size"
            break
        dims = tuple(number(head, o, n) for _, o, n in DIMS)
        if 0 in dims or 4 * dims[0] * dims[1] * dims[2] != size:
            wrong += 1
        else:
            shapes[dims] = shapes.get(dims, 0) + 1
        step = HEADER + size
        at, records = at + step, records + 1
    return at, records, step, stop, wrong, [{"rx": a, "tx": b, "sc": c, "n": n} for (a, b, c), n in shapes.items()]


def _described(rows: list[dict]) -> pa.RecordBatch:
    shape = pa.list_(pa.struct([(k, pa.int64()) for k in ("rx", "tx", "sc", "n")]))
    kinds = {"sample_id": pa.string(), "path": pa.string(), "stop": pa.string(), "shapes": shape, "head": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in _NAMES], _NAMES)


class Pieces(InputPartition):
    """Some byte ranges (path, length, number, start, end)."""

    def __init__(self, pieces: list[tuple]):
        self.pieces = pieces


class PacketReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.dat")
        self.range_bytes, self.heads = int(options.get("rangebytes", RANGE_BYTES)), options.get("heads", "false") == "true"

    def partitions(self) -> list[Pieces]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        prefix = self.path[: len(self.path.rstrip("/")) - len(root.rstrip("/"))] if self.path.rstrip("/").endswith(root.rstrip("/")) else ""
        out, held, size = [], [], 0
        for f in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            if not f.is_file or not fnmatch.fnmatch(f.base_name, self.glob):
                continue
            for k in range(1 if self.heads else max(1, -(-f.size // self.range_bytes))):  # a file of 0 bytes is a range, too
                end = f.size if self.heads else min(f.size, (k + 1) * self.range_bytes)
                held.append((prefix + f.path, f.size, k, k * self.range_bytes, end))
                size += HEADER if self.heads else end - k * self.range_bytes
                if size >= TASK_BYTES or len(held) == TASK_RANGES:
                    out.append(Pieces(held))
                    held, size = [], 0
        if held or not out:
            out.append(Pieces(held))
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        rows = []
        last, read = None, None
        for path, length, k, start, end in partition.pieces:
            if path != last:  # the ranges of a file follow one another
                last, read = path, ByteReader(path)
            head = read.read(0, min(HEADER, length))
            step = HEADER + number(head, 0, 4) if len(head) == HEADER else 1
            entry = -(-start // step) * step
            row = {"sample_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "path": path, "length": length, "k": k, "start": start, "end": end, "entry": entry, "head": head if k == 0 else None}
            found = (None, None, None, None, None, None) if self.heads else chain(read, length, entry, end)
            rows.append(row | dict(zip(("exit", "records", "step", "stop", "wrong", "shapes"), found, strict=True)))
            if len(rows) == 1000:
                yield _described(rows)
                rows = []
        if rows:
            yield _described(rows)


class PacketRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packet_ranges"

    def schema(self) -> str:
        return RANGES

    def reader(self, schema) -> PacketReader:
        return PacketReader(self.options)


def _source(spark: SparkSession, path: str, glob: str, **options) -> DataFrame:
    spark.dataSource.register(PacketRanges)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return spark.read.format("packet_ranges").option("path", uri).option("glob", glob).options(**options).load()


def packet_heads(spark: SparkSession, path: str, glob: str = "*.dat") -> DataFrame:
    """(sample_id, path, length, content) of all packet files below a path, those of 0 bytes included; the content is the first header, and no more is read.

    The tasks open files by Arrow's file systems (local folders, HDFS, S3 and the like).
    """
    return _source(spark, path, glob, heads="true").select("sample_id", "path", "length", F.col("head").alias("content"))


def _again(ranges: DataFrame, range_bytes: int) -> DataFrame:
    """``ranges`` from other entries; each with the ``stretch`` - 1 ranges behind it, one after another. A null entry has no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                read, entry = ByteReader(r["path"]), r["entry"]
                for k in range(r["k"], r["k"] + r["stretch"]):
                    start = k * range_bytes
                    if k and start >= r["length"]:
                        break
                    end = min(r["length"], start + range_bytes)
                    found = (None, 0, None, None, 0, []) if entry is None else chain(read, r["length"], entry, end)
                    rows.append(r | {"k": k, "start": start, "end": end, "entry": entry} | dict(zip(("exit", "records", "step", "stop", "wrong", "shapes"), found, strict=True)))
                    entry = None if found[3] else found[0]
            if rows:
                yield _described(rows)

    return ranges.select(*_NAMES, "stretch").repartition("path", "k").mapInArrow(run, RANGES)


def packet_ranges(spark: SparkSession, path: str, glob: str = "*.dat", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A staged row for each range of each file with its true entry, exit and numbers of records, and first, the index of its first record.

    A range behind the end of a file's records has a null entry. A round puts right the first wrong range of each file and twice as many behind it as the round
    before, so their number grows with the logarithm of the ranges of a file whose records often change their size.
    """
    stretch, known = 1, staged(_source(spark, path, glob, rangebytes=str(range_bytes)))
    by = Window.partitionBy("path").orderBy("k")
    while True:
        stretch *= 2
        lead, over = F.lag("exit").over(by), F.lag("stop").over(by).isNotNull() | (F.lag("entry").over(by).isNull() & (F.col("k") > 0))
        good = (F.col("k") == 0) | (over & F.col("entry").isNull()) | (~over & F.col("entry").eqNullSafe(lead))
        seen = known.withColumn("lead", lead).withColumn("over", over).withColumn("lead_step", F.lag("step").over(by)).withColumn("good", good)
        bad = F.min(F.when(~F.col("good"), F.col("k"))).over(Window.partitionBy("path"))
        seen = seen.withColumn("bad", bad)
        if seen.where("bad IS NOT NULL").isEmpty():
            break
        # the first wrong range of a file has its proven entry; later ones are guessed from it by the last size
        at_bad = lambda c: F.max(F.when(F.col("k") == F.col("bad"), F.col(c))).over(Window.partitionBy("path"))
        seen = seen.withColumn("base", at_bad("lead")).withColumn("ended", at_bad("over")).withColumn("by", F.greatest(F.coalesce(at_bad("lead_step"), F.lit(1)), F.lit(1)))
        guess = F.when(~F.col("ended"), F.when((F.col("k") == F.col("bad")) | (F.col("base") >= F.col("start")), F.col("base")).otherwise(F.col("base") + F.ceil((F.col("start") - F.col("base")) / F.col("by")) * F.col("by")))
        redo = F.coalesce(F.col("k") >= F.col("bad"), F.lit(False))
        first = F.col("k") == F.col("bad")
        again = seen.where(redo & (first | (F.col("k") >= F.col("bad") + stretch))).withColumn("entry", guess.cast("long")).withColumn("stretch", F.when(first, stretch).otherwise(1))
        known = staged(seen.where(~redo).select(*_NAMES).unionByName(_again(again, range_bytes)))
    return known.withColumn("first", F.coalesce(F.sum("records").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
