"""Helpers shared by the operators: table access, staged results, text arrays and hashes.

Conventions that hold for every operator of this subpackage:

* Only the columns that an operator names are read; further columns, whatever their names, are ignored.
* A null text is an empty text. A null id counts as smaller than every other id and stays null in results.
* Repeated rows are rows of their own; where an order is needed, equal ids are ordered by their text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType, _parse_datatype_string

#: Stands for a null id inside the operators; smaller than every other 64-bit integer.
NULL_ID = -(2**63)

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="windowforge-")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir.

    Only a session on one machine may leave it unset; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/windowforge-{uuid.uuid4().hex}"


#: Where the tables lie that ``stage`` returned, or that others read.
_STAGED: WeakKeyDictionary = WeakKeyDictionary()


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps restart from the files when an executor is lost.

    Shuffle files of the job are released as soon as it has ended; the table itself by ``release``.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    with shuffle_cleanup(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[out] = [path]
    return out


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs within are released as soon as they have ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def release(*read: DataFrame) -> None:
    """Delete staged tables, and those handed over to these, that nothing reads any more: what was made of them is staged itself."""
    for df in read:
        for path in _STAGED.pop(df, []):
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hand_over(df: DataFrame, *staged: DataFrame) -> DataFrame:
    """``df``, which reads ``staged``: they go when it is released."""
    _STAGED[df] = [path for x in staged for path in _STAGED.pop(x, [])]
    return df


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """(id long, text string) with nulls replaced; with ``rows`` also ``row``."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *([row_struct(docs)] if rows else []),
    )


def row_struct(docs: DataFrame):
    """All columns of a row as one, ``row``: what a decision about a row is made for goes with it, whatever its id."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def with_row(schema: str, row: DataType | None) -> StructType:
    """``schema`` and, unless there is none, the column ``row`` of this type."""
    out = _parse_datatype_string(schema)
    return out if row is None else StructType(out.fields).add("row", row)


def null_id(col: str = "id"):
    """The inverse of the replacement of null ids."""
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


# ---------------------------------------------------------------- Arrow columns as numpy


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (uint8) and row offsets (int64, one more than rows) of a string or binary column without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # nothing in it
        column = pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def small_batches(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that the texts of a batch hold about ``limit`` bytes at most (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = text_buffer(b.column(b.schema.get_field_index(text)))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield b.slice(at, end - at)
            at = end


# ---------------------------------------------------------------- hashes

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64)  # a copy
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)[:n]


#: Odd bases of the two polynomial hashes and the seed of the table of byte values.
BASE_A, BASE_B, SEED = 0x5851F42D4C957F2D, 0xD1342543DE82EF95, 20250101
BYTE_VALUES = np.random.default_rng(SEED).integers(0, 2**64, 256, dtype=np.uint64)
BYTE_VALUES_B = np.random.default_rng(SEED + 1).integers(0, 2**64, 256, dtype=np.uint64)


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each values[start:end]; equal contents give equal hashes wherever they stand."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse(base), n + 1)[starts] + (ends - starts).astype(np.uint64) * _ODD)


def rolling_hash(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """The hashes of all len(values) - width + 1 windows."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(inverse(base), n))


#: What parts words.
SPACES = " \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words of all rows, and each row's first word number (one more than rows).

    Words are the runs [^\\x20\\x09-\\x0D]+, or of whatever bytes ``space`` doesn't mark.
    """
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets[(offsets > 0) & (offsets < n)]] = True  # a word ends with its row
    begin = solid[1:-1] & (~solid[:-2] | cut[:-1])
    end = solid[1:-1] & (~solid[2:] | cut[1:])
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    values = (BYTE_VALUES_B if second else BYTE_VALUES)[_LOWER[data] if lower else data]
    return span_hash(values, starts, ends, BASE_B if second else BASE_A)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lengths[0]-1, starts[1] .., one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
