"""Sources: indexes, manifests, frame times, logs, review tables and lists."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowforge.functions.scalars import log_time_ns, safe_path, to_float, to_int
from windowforge.operators.checks import duplicates, require_none
from windowforge.operators.quality import last_rows
from windowforge.sources.csv_records import _ddl, read_csv
from windowforge.sources.scratch import staged


def read_index(spark: SparkSession, path: str, schema: T.StructType | str | None = None, blank_rows: bool = True) -> DataFrame:
    """A CSV file with header, read in splits; with a schema, columns are cast leniently and absent ones are null. Blank rows go if ``blank_rows`` is false."""
    raw = read_csv(spark, path)
    if not blank_rows:
        some = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in raw.columns])
        raw = raw.where(some.isNotNull())
    if schema is None:
        return raw
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return raw.select(*[_typed(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None).cast("string"), f.dataType).alias(f.name) for f in kinds])


def _typed(c, kind):
    if isinstance(kind, T.LongType | T.IntegerType):
        return to_int(c).cast(kind)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return to_float(c).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.when(c == "ok", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.split(c, ";"))))
    return F.nullif(c.try_cast(kind), F.lit("").cast(kind)) if isinstance(kind, T.StringType) else c.try_cast(kind)


# Columns of the manifests
COMMON = "sample_id string, session_id string, archive_session_id string, person_id string, environment_id string, action_id string, trial_id string, status string, sync_quality_flags string"
MANIFESTS = {
    "packets": COMMON + ", archive_csi_path string, csi_packets_written bigint",
    "video": COMMON + ", archive_video_path string, video_frames_written bigint, video_fps double",
}


def load_manifest(spark: SparkSession, path: str, modality: str, require_ok: bool = True, listing: DataFrame | None = None) -> DataFrame:
    """A typed release manifest. Missing columns, unsafe or missing paths, bad numbers, repeated ids and an empty result are errors.

    The file is read once: rows and bad rows are counted as they are written to a table, which the other checks and the caller read.
    """
    kinds = T._parse_datatype_string(MANIFESTS[modality])
    head = spark.read.option("header", True).csv(path).columns
    if lost := [f.name for f in kinds if f.name not in head]:
        raise ValueError(f"the manifest lacks {', '.join(lost)}")
    rows = read_index(spark, path, kinds)
    if require_ok:
        rows = rows.where("status = 'ok' AND sync_quality_flags = 'ok'")
    where = F.col("archive_csi_path" if modality == "packets" else "archive_video_path")
    number = F.col("csi_packets_written").isNull() if modality == "packets" else ~F.coalesce((F.col("video_frames_written") > 0) & (F.col("video_fps") > 0), F.lit(False))
    problem = F.when(F.col("sample_id").isNull(), "no sample_id").when(~safe_path(where), "unsafe path").when(number, "bad number")
    seen = Observation()
    marked = staged(rows.withColumn("problem", problem).observe(seen, F.count(F.lit(1)).alias("rows"), F.count("problem").alias("bad")))
    if seen.get["bad"]:
        require_none(marked.where("problem IS NOT NULL").select("sample_id", "problem"), "the manifest has bad rows")
    if not seen.get["rows"]:
        raise ValueError("the manifest has no usable row")
    rows = marked.drop("problem")
    require_none(duplicates(rows, "sample_id"), "the manifest repeats ids")
    if listing is not None:
        require_none(rows.select(where.alias("path")).join(listing.select("path"), "path", "left_anti"), "files are missing")
    return rows


def scan_frame_times(spark: SparkSession, root: str, glob: str = "*video_timestamps.csv") -> DataFrame:
    """(recording, video, frame_idx, unix_time_ns) of every file of frame times below a root; unreadable rows go."""
    source = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    # the header of one file names the columns of all; left to itself, Spark would list every file once more by itself to find it
    header = source.text(root).where("trim(value) <> ''").first()
    names = next(csv.reader([header.value])) if header else ["frame_idx", "unix_time_ns"]
    lower = [n.lower() for n in names]
    names = [f"{n}{k}" if lower.count(n.lower()) > 1 else n or f"_c{k}" for k, n in enumerate(names)]  # as Spark names them
    raw = source.option("header", True).schema(_ddl(names)).csv(root)
    rows = raw.select(F.col("_metadata.file_path").alias("recording"), to_int(F.col("frame_idx")).alias("frame_idx"), to_int(F.col("unix_time_ns")).alias("unix_time_ns"))
    video = F.regexp_replace("recording", r"_?video_timestamps\.csv$", ".mp4")
    return rows.where("frame_idx IS NOT NULL AND unix_time_ns IS NOT NULL").select("recording", video.alias("video"), "frame_idx", "unix_time_ns")


def scan_log_packet_times(spark: SparkSession, root: str, dates: DataFrame, zone_hours: int = 8, glob: str = "*.log", sample: str = r"([^/]*)\.log$") -> DataFrame:
    """(sample_id, packet_idx, unix_ns) of the lines ``[HH:MM:SS.f] Subcarrier count:`` of each sample's log, in file order, days added at midnight.

    dates (sample_id, date); ``sample`` takes the id of a log from its path. A log is read in the splits of a text source; each is a piece whose days are counted by themselves.
    """
    from windowforge.operators.timealign import day_offsets

    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(root)
    clock = F.regexp_extract("value", r"^\[(\d{2}:\d{2}:\d{2}\.\d{1,6})\] Subcarrier count:", 1)  # fixed values: the form of the lines
    # the lines of a split come in order
    times = lines.select(F.regexp_extract(F.col("_metadata.file_path"), sample, 1).alias("sample_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), clock.alias("clock")).where("clock <> ''")
    times = staged(times)  # splits, which pieces are named by, are cut by the cores that are there: they must not change between two reads
    timed = times.join(dates, "sample_id").withColumn("ns", log_time_ns(F.col("date"), F.col("clock"), zone_hours)).where("ns IS NOT NULL")
    moved = day_offsets(timed, "sample_id", "line", "ns", F.struct("path", "split"))
    return moved.select("sample_id", F.col("place").alias("packet_idx"), (F.col("ns") + F.col("day_offset") * 86_400_000_000_000).alias("unix_ns"))


def read_review_rules(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """(rule_id, session_id, clip_expr, category, description, resample_status) from a Markdown file's table of rules: a number, then these columns.

    The lines from the first ``##`` heading that begins so to the next ``##`` heading count; without it all lines. A rule is a table line of six cells
    or more with a back-tick; its expression is what stands in back-ticks, or the whole cell.
    """
    text = spark.read.text(path, wholetext=True)
    marked = text.select(F.regexp_replace("value", r"(?m)^\s*##[ ]", "## ").alias("value"))
    begin = F.locate(f"\n## {heading}", F.concat(F.lit("\n"), "value"))
    rest = F.substring("value", begin, F.length("value"))
    part = F.when(begin > 0, F.regexp_replace(rest, r"(?s)\n## .*$", "")).otherwise(F.col("value"))
    lines = marked.select(F.posexplode(F.split(part, r"\r?\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    table = lines.where(F.col("line").startswith("|") & F.col("line").contains("`"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    plain = lambda k: F.trim(F.regexp_replace(F.get("c", F.lit(k)), r"\*\*", ""))
    rows = table.select("n", cells.alias("c")).where((F.size("c") >= 6) & ~F.get("c", F.lit(0)).isin("#", ":-:"))
    expr = F.trim(F.regexp_extract(F.get("c", F.lit(2)), "`([^`]+)`", 1))
    out = rows.select(F.col("n").alias("rule_id"), plain(1).alias("session_id"), F.when(F.get("c", F.lit(2)).rlike("`[^`]+`"), expr).otherwise(plain(2)).alias("clip_expr"), plain(3).alias("category"), plain(4).alias("description"), plain(5).alias("resample_status"))
    return out.where("session_id <> '' AND clip_expr <> ''")


def resolve_sample_files(wanted: DataFrame, listing: DataFrame, base: str) -> DataFrame:
    """wanted (sample_id, session_id, name) to path: ``base/session/name`` if it is there, else the first ``base/*/name``, else null."""
    files = listing.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).where(F.col("path").rlike(f"^{base}/[^/]+/[^/]+$"))
    direct = F.col("path") == F.concat_ws("/", F.lit(base), "session_id", "name")
    joined = wanted.join(files, "name", "left").withColumn("_rank", F.struct((~direct).alias("a"), "path"))
    return joined.groupBy("sample_id").agg(F.min_by("path", "_rank").alias("path"))


def load_reference_maps(spark: SparkSession, session_csv: str, person_csv: str) -> tuple[DataFrame, DataFrame]:
    """(session_id, expected_person), the last row of a session counting, and (person_id, name)."""
    s = read_csv(spark, session_csv, "at").select(F.trim("Session").alias("session_id"), F.trim("Person_ID").alias("p"), "at")
    s = last_rows(s, "session_id", "at").select("session_id", F.when(F.lower("p") != "none", F.col("p")).alias("expected_person"))
    return s, read_index(spark, person_csv).select(F.trim("Person_id").alias("person_id"), F.trim("Name").alias("name")).distinct()


def load_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, split, seed); repeated ids, bad seeds or splits and an empty file are errors."""
    rows = staged(read_index(spark, path, "sample_id string, split string, seed bigint"))
    require_none(rows.where("sample_id IS NULL OR seed IS NULL OR split NOT IN ('train', 'val', 'test') OR split IS NULL"), "bad assignments")
    require_none(duplicates(rows, "sample_id"), "assignments repeat ids")
    if rows.isEmpty():
        raise ValueError("no assignments")
    return rows


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("sample_id")).where((F.col("sample_id") != "") & ~F.col("sample_id").startswith("#")).distinct()


def load_slice_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a video, and how many others there were (one row: dropped), which are counted as the former are written to a table."""
    good = (F.coalesce("sample_id", F.lit("")) != "") & (F.coalesce("video_out_path", F.lit("")) != "")
    seen = Observation()
    rows = staged(read_index(spark, path).observe(seen, F.count_if(~good).alias("dropped")).where(good))
    return rows, spark.range(1).select(F.lit(seen.get["dropped"]).cast("long").alias("dropped"))
