"""Token-id files: one wavelet matrix per shard.

A shard file holds the ids of consecutive documents as bit-planes, most significant first; below each plane the ids are
parted stably by its bit. A plane is cut into blocks that are compressed one by one; the file's directory has each block's place and
the ones before it. So a file answers by a few blocks of its planes, without unpacking the ids: the id at a position, how
often an id occurs before a position, and where its k-th occurrence is.

Shards are the binary rows of a Parquet table, so that any store that Spark writes can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowforge.llm import tokens
from windowforge.llm.common import batch_of, column, id_text, n_partitions, null_id, ranges, small_batches, stage, table

MAGIC, HEAD = b"WFWM0002", struct.Struct("<8sQIII")  # magic, ids, documents, bits, bytes of a block of a plane
SHARD_IDS, BLOCK = 1 << 20, 1 << 13
_CODEC = pa.Codec("zstd", compression_level=1)
_PLACE = np.dtype([("end", "<u4"), ("ones", "<u4")])  # of a block: where its bytes end in the plane, and ones up to its end


class WaveletMatrix:
    """Reads a shard file. Nothing is unpacked before it is asked for, and of a plane only the blocks that a question needs."""

    def __init__(self, file):
        self.file = memoryview(file).cast("B")
        magic, self.n, docs, self.bits, self.block = HEAD.unpack_from(self.file)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.blocks = -(-self.n // (8 * self.block))
        sizes = np.frombuffer(self.file, "<u8", self.bits + 2, HEAD.size).astype(np.int64)
        at = HEAD.size + 8 * (self.bits + 2)
        self.places = np.frombuffer(self.file, _PLACE, self.bits * self.blocks, at).reshape(self.bits, self.blocks)
        self.starts = at + self.places.nbytes + np.concatenate([[0], np.cumsum(sizes)])
        self.doc_ids, self.doc_off = (self._unpacked(k, 8 * n).view("<i8") for k, n in ((0, docs), (1, docs + 1)))

    def _unpacked(self, part: int, size: int) -> np.ndarray:
        raw = _CODEC.decompress(self.file[self.starts[part] : self.starts[part + 1]], decompressed_size=size, asbytes=True) if size else b""
        return np.frombuffer(raw, np.uint8)

    # ---- the file

    @staticmethod
    def build(ids: np.ndarray, doc_ids: np.ndarray, doc_off: np.ndarray, bits: int = 16, block: int = BLOCK) -> bytes:
        seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        pack = lambda x: _CODEC.compress(memoryview(x).cast("B"), asbytes=True) if x.size else b""
        parts = [pack(doc_ids.astype("<i8")), pack(doc_off.astype("<i8"))]
        blocks = -(-len(seq) // (8 * block))
        places = np.empty((bits, blocks), _PLACE)
        for level, shift in enumerate(range(bits - 1, -1, -1)):
            bit = (seq & seq.dtype.type(1 << shift)) != 0
            plane = np.packbits(bit, bitorder="little")
            packed = [pack(plane[k * block : (k + 1) * block]) for k in range(blocks)]
            places["end"][level] = np.cumsum([len(x) for x in packed])
            places["ones"][level] = np.cumsum([np.count_nonzero(bit[k * 8 * block : (k + 1) * 8 * block]) for k in range(blocks)])
            parts.append(b"".join(packed))
            zeros, parted = len(seq) - int(np.count_nonzero(bit)), np.empty_like(seq)
            np.compress(~bit, seq, out=parted[:zeros])
            np.compress(bit, seq, out=parted[zeros:])
            seq = parted
        sizes = np.array([len(x) for x in parts], "<u8").tobytes()
        return HEAD.pack(MAGIC, len(ids), len(doc_ids), bits, block) + sizes + places.tobytes() + b"".join(parts)

    def directory_bytes(self) -> int:
        """What rank support takes of the file."""
        return self.places.nbytes

    # ---- questions, answered by single blocks

    def _block(self, level: int, k: int) -> np.ndarray:
        start = int(self.starts[2 + level])
        before = int(self.places["end"][level, k - 1]) if k else 0
        size = min(self.block, (self.n + 7) // 8 - k * self.block)
        return np.frombuffer(_CODEC.decompress(self.file[start + before : start + int(self.places["end"][level, k])], decompressed_size=size, asbytes=True), np.uint8)

    def _ones(self, level: int, k: int) -> int:
        """Ones before block ``k``."""
        return int(self.places["ones"][level, k - 1]) if k else 0

    def zeros(self, level: int) -> int:
        return self.n - self._ones(level, self.blocks)

    def rank1(self, level: int, i: int) -> tuple[int, int]:
        """Ones before position ``i``, and the bit there (0 at the end)."""
        k, rest = divmod(i, 8 * self.block)
        if k == self.blocks or not rest and i == self.n:
            return self._ones(level, k), 0
        raw, (byte, bit) = self._block(level, k), divmod(rest, 8)
        inside = int(np.bitwise_count(raw[:byte]).sum(dtype=np.int64))
        here = int(raw[byte]) if byte < len(raw) else 0
        return self._ones(level, k) + inside + (here & ((1 << bit) - 1)).bit_count(), here >> bit & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            ones, bit = self.rank1(level, i)
            i = self.zeros(level) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value < 0 or value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            (a, _), (b, _) = self.rank1(level, start), self.rank1(level, end)
            if value >> (self.bits - 1 - level) & 1:
                start, end = self.zeros(level) + a, self.zeros(level) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``value`` in [start, end)."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        upto = self.places["ones"][level].astype(np.int64)
        if not bit:
            upto = np.minimum(np.arange(1, self.blocks + 1) * 8 * self.block, self.n) - upto
        block = int(np.searchsorted(upto, k, side="right"))
        inside = np.flatnonzero(np.unpackbits(self._block(level, block), bitorder="little") == bit)
        return block * 8 * self.block + int(inside[k - (int(upto[block - 1]) if block else 0)])

    def locate(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of ``value``."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros(level) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids: the partings undone from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self._block(level, k) for k in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint8)
            bit = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros, up = self.zeros(level), np.empty_like(value)
            up[np.flatnonzero(~bit)] = value[:zeros]
            up[np.flatnonzero(bit)] = value[zeros:] | kind(1 << (self.bits - 1 - level))
            value = up
        return value


SHARDS = "part int, nth int, n_docs long, n_ids long, file binary"


def write_shards(docs: DataFrame, path: str, end_id: int = 1, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all documents in ascending order of their ids and write the shard files; returns the table of files.

    Within a range of ids, shards take documents until they hold ``shard_ids`` ids; a longer document has its own. A null id counts as
    smallest, a null text as empty (its document is the end id alone); rows of one id stand by a hash of their text, equal rows side by side.
    An empty table gives no files.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        enc = tokens.encoder(path, glued=False)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal nth
            lengths = np.concatenate([x[2] for x in held])
            file = WaveletMatrix.build(np.concatenate([x[1] for x in held]), np.concatenate([x[0] for x in held]), np.concatenate([[0], np.cumsum(lengths)]))
            nth += 1
            held.clear()
            return batch_of(part=pa.array([part], pa.int32()), nth=pa.array([nth - 1], pa.int32()), n_docs=[len(lengths)], n_ids=[int(lengths.sum())], file=pa.array([file], pa.binary()))

        n = 0
        for b in small_batches(batches, "text", 2 << 20):
            ids, off = enc.encode(b.column(1).to_pylist())
            lengths = np.diff(off) + 1
            flat = np.full(int(lengths.sum()), end_id, np.uint16)
            flat[ranges(np.cumsum(lengths) - lengths, lengths - 1)] = ids
            if n and n + len(flat) > shard_ids:
                yield flush()
                n = 0
            held.append((column(b, "id"), flat, lengths))
            n += len(flat)
        if held:
            yield flush()

    spark = docs.sparkSession
    ordered = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(n_partitions(spark), "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return stage(ordered.mapInArrow(encode, SHARDS), "uncompressed")


def read_documents(shards: DataFrame) -> DataFrame:
    """From the files: id, start (ids of all documents before it), n_tokens, ids_crc32 of the 32-bit ids. One row for each row that was
    written, repeated and null ids (``NULL_ID`` here) among them; no files, no rows."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, nth, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                wm = WaveletMatrix(file.as_buffer())
                view = memoryview(wm.tokens().astype("<u4")).cast("B")
                off = wm.doc_off.tolist()
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(off[:-1], off[1:], strict=True)), np.int64, len(off) - 1)
                yield batch_of(part=np.full(len(crc), part, np.int32), nth=np.full(len(crc), nth, np.int32), id=wm.doc_ids, inner=wm.doc_off[:-1], n_tokens=np.diff(wm.doc_off), ids_crc32=crc)

    rows = shards.select("part", "nth", "file").mapInArrow(decode, "part int, nth int, id long, inner long, n_tokens long, ids_crc32 long")
    # ids before a range of documents: as many rows as the ranges; then those before a shard within its range
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    of_range = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    of_shard = shards.select("part", "nth", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("lead")).join(of_range, "part")
    return rows.join(of_shard, ["part", "nth"]).select("id", (F.col("base") + F.col("lead") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(shards: DataFrame, values: list[int]) -> DataFrame:
    """part, nth, value, n, first: how often each of the ids stands in each file, and where first (null: nowhere), by rank and select alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, nth, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                wm = WaveletMatrix(file.as_buffer())
                n = [wm.count(v) for v in values]
                first = [wm.locate(v, 0) if k else None for v, k in zip(values, n, strict=True)]
                yield batch_of(part=np.full(len(n), part, np.int32), nth=np.full(len(n), nth, np.int32), value=pa.array(values, pa.int64()), n=pa.array(n, pa.int64()), first=pa.array(first, pa.int64()))

    return shards.select("part", "nth", "file").mapInArrow(run, "part int, nth int, value long, n long, first long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"))
    return read_documents(shards).select(null_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")
