"""Binary packet files as distributed jobs: a census of sizes, and one row per packet.

A record is a 272-byte little-endian header and a payload of int16 pairs, ordered by receiver, transmitter and subcarrier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowforge.functions.scalars import flag_list, flagged
from windowforge.operators.checks import require_none
from windowforge.operators.timealign import in_ranges
from windowforge.sources.packet_source import BLOCK_BYTES, HEADER, RANGE_BYTES, ByteReader, number, packet_heads, packet_ranges

# The layout of a record.
FIELDS = {"csi_size": ("<u4", 0), "ftm_clock": ("<u4", 8), "timestamp": ("<u8", 12), "num_rx": ("u1", 46), "num_tx": ("u1", 47), "num_subcarriers": ("<u4", 52), "rssi1": ("<u4", 60), "rssi2": ("<u4", 64), "rate_flags": ("<u4", 92)}
MAC = slice(68, 74)

PACKETS = (
    "sample_id string, packet_idx int, csi_size long, ftm_clock long, timestamp decimal(20,0), num_rx smallint, num_tx smallint, num_subcarriers long, "
    "rssi1 long, rssi2 long, source_mac string, rate_flags long, iq array<smallint>, problem string"
)
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.decimal128(20, 0), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int16()), pa.string()]
_NAMES = [x.split()[0] for x in PACKETS.replace("decimal(20,0)", "decimal").split(", ")]


def packet_files(spark: SparkSession, path: str, glob: str = "*.dat") -> DataFrame:
    """(sample_id, path, length, content) of all packet files below a path, for files that fit a value; ``scan_packet_files`` reads files of any length."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                length = b.column(2)[i].as_py()
                content = ByteReader(b.column(1)[i].as_py()).read(0, length) if length else b""
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in b.columns], pa.array([content], pa.binary())], names=["sample_id", "path", "length", "content"])

    listed = packet_heads(spark, path, glob).select("sample_id", "path", "length")
    return listed.mapInArrow(whole, "sample_id string, path string, length long, content binary")


def packet_census(files: DataFrame) -> DataFrame:
    """sample_id, packet_size, packets, trailing and flags, from each file's length and the size in its first header: ``packet_heads`` has all that is needed."""
    first = F.hex(F.expr("substring(content, 1, 4)"))
    word = F.conv(F.concat(*[F.substring(first, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")  # least byte first
    f = files.select("sample_id", "length", F.when(F.col("length") >= HEADER, word + HEADER).alias("packet_size"))
    good = F.col("packet_size") > HEADER
    f = f.withColumn("packets", F.when(good, F.floor(F.col("length") / F.col("packet_size"))).otherwise(0)).withColumn("trailing", F.when(good, F.col("length") % F.col("packet_size")).otherwise(0))
    flags = flag_list(
        flagged(F.col("packet_size").isNull() | (good & (F.col("packets") == 0)), "empty_or_invalid_csi_file"),
        flagged(F.col("packet_size") <= HEADER, "invalid_csi_packet_size"),
        flagged(F.col("trailing") > 0, "csi_trailing_bytes"),
    )
    return f.withColumn("flags", flags)


def _runs(data: np.ndarray, most: int | None) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    """(first index, records of one size as rows of bytes, None) as long as the sizes in the headers lead on; last, if the walk ended so, (index, None, problem)."""
    at, idx = 0, 0
    while at + HEADER <= len(data) and (most is None or idx < most):
        size = int(data[at : at + 4].view("<u4")[0])
        record = HEADER + size
        n = (len(data) - at) // record
        if size == 0:
            yield idx, None, "bad_size"
            break
        if n == 0:
            break
        n = n if most is None else min(n, most - idx)
        rows = data[at : at + n * record].reshape(n, record)
        other = np.flatnonzero(rows[:, :4].copy().view("<u4")[:, 0] != size)
        rows = rows[: other[0]] if len(other) else rows
        yield idx, rows, None
        at, idx = at + len(rows) * record, idx + len(rows)
    if most is not None and idx >= most:
        return
    if at < len(data):
        yield idx, None, "trailing_partial"
    elif idx == 0:
        yield idx, None, "no_packets"


def scan_packets(files: DataFrame, keep: int | None = None, block: int = 512, max_packets: int | None = None, only_problems: bool = False) -> DataFrame:
    """One row per packet of all files, and one per problem that ended a walk (bad_size, trailing_partial, no_packets).

    Records whose size, dimensions or shape are wrong are kept with their problem and without I/Q; ``keep``: of how many valid records the I/Q is read;
    ``max_packets``: how many records of a file are looked at, what follows is not judged. Headers are read for a whole run of records of one size at a
    time. Rows leave in blocks, so that a task holds one file and one block.
    """


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sample, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8) if content.is_valid and len(content.as_buffer()) else np.zeros(0, np.uint8)
                yield from _packets(sample, _runs(data, max_packets), keep, block, only_problems)

    return files.select("sample_id", "content").mapInArrow(run, PACKETS)


def _packets(sample: str, runs: Iterator[tuple[int, np.ndarray | None, str | None]], keep: int | None, block: int, only_problems: bool = False, shape: np.ndarray | None = None, valid: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of runs of records; ``shape`` are the dimensions of the file's first sound record, if it lies before, ``valid`` the number of valid ones so far."""
    for first, records, problem in runs:
        if records is None:
            yield _batch({"sample_id": pa.array([sample]), "packet_idx": pa.array([first], pa.int32()), "problem": pa.array([problem])}, 1)
            continue
        for at in range(0, len(records), block):
            part = records[at : at + block]
            n = len(part)
            f = {k: part[:, o : o + np.dtype(kind).itemsize].copy().view(kind)[:, 0] for k, (kind, o) in FIELDS.items()}
            dims = np.stack([f[k].astype(np.int64) for k in ("num_rx", "num_tx", "num_subcarriers")], axis=1)
            zero, fits = (dims == 0).any(axis=1), f["csi_size"] == 4 * dims.prod(axis=1)
            well = ~zero & fits
            if shape is None and well.any():
                shape = dims[np.argmax(well)]
            good = well & (dims == (shape if shape is not None else -1)).all(axis=1)
            wrong = np.where(good, None, np.where(zero, "zero_dimension", np.where(fits, "shape_change", "size_mismatch")))
            with_iq = good if keep is None else good & (valid + np.cumsum(good) <= keep)
            valid += int(good.sum())
            size = (part.shape[1] - HEADER) // 2
            offsets = np.concatenate([[0], np.cumsum(with_iq * size)]).astype(np.int32)
            values = part[with_iq, HEADER : HEADER + 2 * size].copy().view("<i2").reshape(-1)
            columns = {k: pa.array(v) for k, v in f.items()} | {"timestamp": pa.array(f["timestamp"]).cast(pa.decimal128(20, 0))}
            columns |= {"sample_id": pa.array([sample] * n, pa.string()), "packet_idx": pa.array(np.arange(first + at, first + at + n, dtype=np.int32)), "source_mac": pa.array([m.tobytes().hex(":") for m in part[:, MAC]], pa.string())}
            columns |= {"iq": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~with_iq)), "problem": pa.array(wrong, pa.string())}
            if only_problems:
                pick = np.flatnonzero(~good)
                columns, n = {k: v.take(pa.array(pick)) for k, v in columns.items()}, len(pick)
            if n:
                yield _batch(columns, n)


def _range_runs(read: ByteReader, r: dict, most: int | None, with_iq: bool) -> Iterator[tuple[int, np.ndarray | None, str | None]]:
    """As ``_runs``, of one byte range; without I/Q only the headers are read."""
    at, idx, step = r["entry"], r["first"], 0
    last = idx + r["records"] if most is None else min(idx + r["records"], most)
    while idx < last:
        head = read.read(at, HEADER, 0 if with_iq or step > BLOCK_BYTES >> 2 else BLOCK_BYTES)
        step = HEADER + number(head, 0, 4)
        if with_iq:
            n = max(1, min(last - idx, BLOCK_BYTES // step, (r["exit"] - at) // step))
            for _, rows, _ in _runs(np.frombuffer(read.read(at, n * step), np.uint8), n):
                if rows is not None:
                    yield idx, rows, None
                    at, idx = at + rows.size, idx + len(rows)
        else:  # headers of one run of sizes
            heads = [head]
            while idx + len(heads) < last and number(next_ := read.read(at + len(heads) * step, HEADER, 0 if step > BLOCK_BYTES >> 2 else BLOCK_BYTES), 0, 4) == step - HEADER and len(heads) < 4096:
                heads.append(next_)
            yield idx, np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), HEADER), None
            at, idx = at + len(heads) * step, idx + len(heads)
    if most is not None and idx >= most:
        return
    if r["stop"] == "bad_size":
        yield idx, None, "bad_size"
    if r["stop"]:
        yield idx, None, "trailing_partial"
    elif r["length"] == 0:
        yield idx, None, "no_packets"


def _shaped(ranges: DataFrame) -> DataFrame:
    """Adds shape, the dimensions of each file's first sound record, and valid, how many records before a range have them, own, how many in it."""
    by = Window.partitionBy("path").orderBy("k")
    r = ranges.withColumn("shape", F.first(F.when(F.size("shapes") > 0, F.col("shapes")[0]), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    same = F.filter("shapes", lambda x: (x["rx"] == F.col("shape.rx")) & (x["tx"] == F.col("shape.tx")) & (x["sc"] == F.col("shape.sc")))
    r = r.withColumn("own", F.aggregate(same, F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    return r.withColumn("valid", F.coalesce(F.sum("own").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def scan_packet_files(spark: SparkSession, path: str, glob: str = "*.dat", keep: int | None = None, max_packets: int | None = None, range_bytes: int = RANGE_BYTES, block: int = 512) -> DataFrame:
    """``scan_packets`` of all files below a path, which may have any length: a task reads one byte range at a time, and of that one block."""
    return _parsed(packet_ranges(spark, path, glob, range_bytes), keep, max_packets, block)


def _parsed(ranges: DataFrame, keep: int | None, max_packets: int | None, block: int = 512) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shape = np.array([r["shape"][k] for k in ("rx", "tx", "sc")]) if r["shape"] else None
                wants = r["own"] > 0 and (keep is None or r["valid"] < keep)
                yield from _packets(r["sample_id"], _range_runs(ByteReader(r["path"]), r, max_packets, wants), keep, block, shape=shape, valid=r["valid"])

    cols = ["sample_id", "path", "length", "entry", "exit", "records", "first", "stop", "shape", "valid", "own"]
    wanted = _shaped(ranges).where("entry IS NOT NULL" + (f" AND first < {max_packets}" if max_packets is not None else ""))
    return wanted.repartition("path", "k").select(*cols).mapInArrow(run, PACKETS)


def read_packet_files(spark: SparkSession, path: str, glob: str = "*.dat", keep: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Strict: any problem in any file is an error that names the first few. The ranges' own counts tell, so no packet is read for that."""
    ranges = packet_ranges(spark, path, glob, range_bytes)
    off = F.aggregate("shapes", F.lit(0).cast("long"), lambda a, x: a + x["n"]) - F.col("own")
    found = _shaped(ranges).where((F.col("length") == 0) | F.col("stop").isNotNull() | (F.col("wrong") > 0) | (off > 0))
    require_none(found.select("sample_id", F.coalesce("stop", F.when(F.col("length") == 0, "no_packets").otherwise("size_or_shape")).alias("problem"), "first"), "packet files have problems")
    return _parsed(ranges, keep, None)


def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def read_packets(files: DataFrame, keep: int | None = None, max_packets: int | None = None) -> DataFrame:
    """Strict: any problem in any file is an error that names the first few. With ``max_packets``, of each file's first packets only."""
    if max_packets is not None and max_packets <= 0:
        raise ValueError("max_packets must be positive")
    require_none(scan_packets(files, 0, max_packets=max_packets, only_problems=True).select("sample_id", "packet_idx", "problem"), "packet files have problems")
    return scan_packets(files, keep, max_packets=max_packets)


def packet_problems(packets: DataFrame) -> DataFrame:
    """Counts per sample: packets, mismatched, bad_size, partial. A stop at a bad size leaves bytes behind, so it counts as partial as well."""
    p = F.col("problem")
    return packets.groupBy("sample_id").agg(
        F.count_if(p.isNull()).alias("packets"), F.count_if(p.isin("size_mismatch", "zero_dimension", "shape_change")).alias("mismatched"),
        F.count_if(p == "bad_size").alias("bad_size"), F.count_if(p == "trailing_partial").alias("partial"),
    )


def slice_packets(packets: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packets of each window (window_id, sample_id, start_idx, end_idx), and counts written against expected with a status.

    A window meets the packets of its own buckets of indices only.
    """
    inside = in_ranges(windows, packets.where("problem IS NULL"), "sample_id", "packet_idx")
    written = inside.groupBy("window_id").agg(F.count("*").alias("written"))
    expected = F.when((F.col("start_idx") >= 0) & (F.col("end_idx") >= F.col("start_idx")), F.col("end_idx") - F.col("start_idx") + 1)
    report = windows.join(written, "window_id", "left").select("window_id", expected.alias("expected"), F.coalesce("written", F.lit(0)).alias("written"))
    status = F.when(F.col("expected").isNull(), "invalid_range").when(F.col("expected") == F.col("written"), "csi_ok").otherwise("csi_count_mismatch")
    return inside, report.withColumn("status", status)
