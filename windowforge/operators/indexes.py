"""Whole indexes: the packet half of the synchronisation index, and what slicing makes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowforge.functions.scalars import composite_status, flag_list, flagged, linear_range, padded_range, series_rate
from windowforge.operators.profile import describe_linear
from windowforge.operators.timealign import index_method, packet_range


def csi_index(windows: DataFrame, files: DataFrame, times: DataFrame, default_fs: float = 100.0) -> DataFrame:
    """Packet ranges of windows (window_id, sample_id, a, b; microseconds).

    files (sample_id, n_packets, declared, census_flags array<string>, sample_start, sample_end), times (sample_id, t) from logs.
    A sample whose log has as many times as its file has packets is placed by time; others in proportion to the sample's
    span, or at the default rate. Windows of samples without packets have only the census flags.
    """
    logs = times.groupBy("sample_id").agg(F.count("*").alias("n_times"))
    method = index_method(files, logs).withColumnRenamed("flags", "method_flags")
    f = files.join(method, "sample_id")
    w = windows.join(f, "sample_id", "left")
    by_log = F.col("method") == "log_subcarrier_timestamp"
    timed = w.where(by_log & (F.col("n_packets") > 0))
    placed = packet_range(timed.select("window_id", F.col("sample_id").alias("recording"), "a", "b"), times.select(F.col("sample_id").alias("recording"), "t"))
    start = F.coalesce("sample_start", "a")
    span = F.when(F.col("sample_end") > start, (F.col("sample_end") - start) / 1e6)
    lo, hi = linear_range((F.col("a") - start) / 1e6, (F.col("b") - start) / 1e6, span, F.col("n_packets"), default_fs)
    joined = w.join(placed.select("window_id", F.col("start_idx").alias("_lo"), F.col("end_idx").alias("_hi"), F.col("flags").alias("_flags")), "window_id", "left")
    some = F.col("n_packets") > 0
    joined = joined.withColumn("start_idx", F.when(some, F.when(by_log, F.col("_lo")).otherwise(lo))).withColumn("end_idx", F.when(some, F.when(by_log, F.col("_hi")).otherwise(hi)))
    count = F.col("end_idx") - F.col("start_idx") + 1
    own = flag_list(
        flagged(F.col("n_packets").isNull(), "missing_csi_file"),
        flagged(some & ~by_log & F.col("sample_start").isNull(), "missing_sample_start_unix_ns"),
        flagged(some & ~by_log & span.isNull(), "missing_sample_end_unix_ns"),
        flagged(some & (count < 1), "invalid_csi_action_range"),
        flagged(some & (count <= 0), "invalid_csi_action_count"),
    )
    empty = F.array().cast("array<string>")
    more = F.when(some, F.concat(F.coalesce("method_flags", empty), F.coalesce("_flags", empty))).otherwise(empty)
    flags = F.array_sort(F.array_distinct(F.concat(own, F.coalesce("census_flags", empty), more)))
    name = F.when(~some, F.lit(None)).when(by_log | span.isNotNull(), F.col("method")).otherwise(F.lit(f"default_{default_fs:g}hz"))
    return joined.select("window_id", "sample_id", name.alias("method"), "start_idx", "end_idx", series_rate(F.col("n_packets"), span).alias("raw_rate"), flags.alias("flags"))


def slice_windows(index: DataFrame, written: DataFrame, totals: DataFrame, pre: float, post: float) -> DataFrame:
    """index (window_id, recording, start_idx, end_idx, start_pos, end_pos), written (window_id, written), totals (recording, n_frames, fps) to
    counts, padded frames and the status: ok, or partial if the packets or the frames are not."""
    lo, hi = padded_range(F.col("start_pos"), F.col("end_pos"), F.col("n_frames"), F.col("fps"), pre, post)
    j = index.join(written, "window_id", "left").join(totals, "recording", "left")
    j = j.withColumn("expected", F.greatest(F.lit(0), F.col("end_idx") - F.col("start_idx") + 1)).withColumn("written", F.coalesce("written", F.lit(0)))
    j = j.withColumn("frame_start", lo).withColumn("frame_end", hi)
    packets = F.when(F.col("written") == F.col("expected"), "csi_ok").otherwise("csi_count_mismatch")
    frames = F.when(F.col("n_frames").isNull(), "video_skipped").when(F.col("frame_end") >= F.col("frame_start"), "video_ok").otherwise("video_empty")
    return j.select("window_id", "expected", "written", "frame_start", "frame_end", composite_status(F.array(packets, frames)).alias("status"))


def session_selection(index: DataFrame, session: str, status: str, include_warn: bool) -> DataFrame:
    """(session, selected, warned): rows taken, with those that warn if asked for, and rows that warn."""
    warn = F.col(status) == "warn"
    ok = (F.col(status) == "ok") | (warn & F.lit(include_warn))
    return index.groupBy(session).agg(F.count_if(ok).alias("selected"), F.count_if(warn).alias("warned"))


def rate_outliers(rates: DataFrame, rate: str, low: float = 80, high: float = 130) -> tuple[DataFrame, DataFrame]:
    """Rows within the accepted rates, and those outside."""
    inside = F.col(rate).between(low, high)
    return rates.where(inside), rates.where(~F.coalesce(inside, F.lit(False)))


def packet_rate_summary(rates: DataFrame, sample: str, rate: str, flags: str, target: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """The distribution of known rates over two populations (all, and normal: those without a flag low_packet_rate or high_packet_rate), and the outliers (sample, rate).

    ``flags`` is an array of flags; null or not a number is no rate. A population without rates has a row with n = 0."""
    known = rates.where(F.col(rate).isNotNull() & ~F.isnan(F.col(rate).cast("double")))
    odd = F.coalesce(F.arrays_overlap(F.col(flags), F.array(F.lit("low_packet_rate"), F.lit("high_packet_rate"))), F.lit(False))
    rows = known.select(F.explode(F.when(odd, F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("normal")))).alias("population"), F.col(rate).cast("double").alias("rate"))
    every = rates.sparkSession.createDataFrame([("all",), ("normal",)], "population string")
    summary = every.join(describe_linear(rows, "rate", target, "population"), "population", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return summary, known.where(odd).select(sample, rate)
