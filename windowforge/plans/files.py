"""Queries that go through files: the tables are written in the forms that the readers know, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.functions import scalars as S
from windowforge.operators import features as X
from windowforge.operators import packets as P
from windowforge.operators import quality as Q
from windowforge.sources import readers as R
from windowforge.sources import sinks as W
from windowforge.sources.scratch import scratch_path


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- indexes, manifests and lists


def read_index(spark, d):
    """Customers as an index in CSV, with a list of flags and a column that the file lacks."""
    flags = S.flag_list(S.flagged(F.col("c_acctbal") < 0, "negative"), S.flagged(F.col("c_nationkey") < 5, "near"))
    path = scratch_path(spark)
    W.write_index(_t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", flags.alias("flags")), path, ["c_name", "c_custkey", "c_acctbal", "flags"], "csv")
    back = R.read_index(spark, path, "c_custkey bigint, c_name string, c_acctbal double, flags array<string>, absent bigint")
    return back.select("c_custkey", "c_name", "c_acctbal", F.concat_ws(";", "flags").alias("flags"), "absent")


def ordered_export(spark, d):
    """Suppliers written in the order of nation and balance; each one's place among its nation as the files have them."""
    from pyspark.sql import Window

    path = scratch_path(spark)
    W.write_index(_t(spark, d, "supplier"), path, ["s_suppkey", "s_nationkey", "s_acctbal"], "csv", order=["s_nationkey", F.desc("s_acctbal"), "s_suppkey"])
    at = F.struct(F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)", 1).alias("file"), F.monotonically_increasing_id().alias("id"))
    rows = spark.read.option("header", True).csv(path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_nationkey", at.alias("at"))
    return rows.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("at")).cast("long").alias("place"))


def manifest(spark, d):
    """Orders as a release manifest of videos; finished ones are usable."""
    o, key = _t(spark, d, "orders"), F.col("o_orderkey").cast("string")
    status = F.when(F.col("o_orderstatus") == "F", "ok").otherwise("warn")
    rows = o.select(
        F.concat(F.lit("O"), key).alias("sample_id"), F.concat(F.lit("S"), F.col("o_custkey")).alias("session_id"), F.lit("S00").alias("archive_session_id"), F.lit("P01").alias("person_id"), F.lit("E1").alias("environment_id"),
        F.lit("walk").alias("action_id"), F.lit("R001").alias("trial_id"), status.alias("status"), F.lit("ok").alias("sync_quality_flags"), F.concat(F.lit("data/"), key, F.lit(".mp4")).alias("archive_video_path"),
        F.format_string("%d", F.col("o_orderkey") % 300 + 1).alias("video_frames_written"), F.lit("29.97").alias("video_fps"),
    )
    path = scratch_path(spark)
    rows.write.option("header", True).csv(path)
    return R.load_manifest(spark, path, "video").select("sample_id", "session_id", "video_frames_written", "video_fps")


def assignments(spark, d):
    path = scratch_path(spark)
    part = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("vec_id") % 3 + 1).cast("int"))
    _t(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), part.alias("split"), F.lit(2026).alias("seed")).write.option("header", True).csv(path)
    return R.load_assignments(spark, path).groupBy("split", "seed").agg(F.count("*").alias("n"), F.sum(F.col("sample_id").cast("long")).alias("ids"))


def id_list(spark, d):
    """Parts as lines with blanks, comments and repeats."""
    path = scratch_path(spark)
    key = F.col("p_partkey")
    _t(spark, d, "part").select(F.when(key % 5 == 0, F.concat(F.lit("# "), key)).when(key % 7 == 0, "  ").otherwise(F.concat(F.lit(" P"), F.floor(key / 2), F.lit(" "))).alias("value")).write.text(path)
    return R.read_id_list(spark, path)


def slice_index(spark, d):
    """Line items as a slice index; rows without an id or a video are counted."""
    path = scratch_path(spark)
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    _t(spark, d, "lineitem").select(F.when(key % 11 != 0, key.cast("string")).alias("sample_id"), F.when(key % 13 != 0, F.concat(F.lit("v/"), key)).alias("video_out_path")).write.option("header", True).csv(path)
    rows, dropped = R.load_slice_index(spark, path)
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("sample_id").cast("long")).alias("ids")).join(dropped, F.lit(True))


def reference_maps(spark, d):
    """Customers' nations as sessions, the last row of each counting; suppliers as persons."""
    a, b = scratch_path(spark), scratch_path(spark)
    person = F.when(F.col("c_custkey") % 9 == 0, "None").otherwise(F.concat(F.lit(" P"), F.col("c_custkey")))
    _t(spark, d, "customer").select(F.concat(F.lit("S"), F.col("c_custkey")).alias("Session"), person.alias("Person_ID")).write.option("header", True).csv(a)
    _t(spark, d, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey"), F.lit(" ")).alias("Person_id"), F.col("s_name").alias("Name")).write.option("header", True).csv(b)
    sessions, persons = R.load_reference_maps(spark, a, b)
    return sessions.join(persons, sessions.expected_person == persons.person_id, "left").select("session_id", "expected_person", "name")


def review_rules(spark, d):
    """Nations as the table of rules in a Markdown file of the reviewers."""
    path, n = scratch_path(spark), F.col("n_nationkey")
    line = F.concat(F.lit("| "), n, F.lit(" | S"), n, F.lit(" | `P"), n, F.lit("_R003–007` | **"), F.col("n_name"), F.lit("** | seen | "), F.col("n_regionkey"), F.lit(" |"))
    text = _t(spark, d, "nation").agg(F.concat(F.lit("## Notes\n| 0 | S | `no` | a | b | c |\n## Rules\n| # | S | `expr` | a | b | c |\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n## End\n| 9 | S | `no` | a | b | c |\n")).alias("value"))
    text.write.text(path)
    return R.read_review_rules(spark, path, "Rules").select("session_id", "clip_expr", "category", "description", "resample_status")


def resolve_files(spark, d):
    """Orders look for a file in their customer's folder, else in any."""
    o = _t(spark, d, "orders")
    wanted = o.select(F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("S"), F.col("o_custkey") % 50).alias("session_id"), F.concat(F.col("o_orderkey"), F.lit(".mp4")).alias("name"))
    folder = lambda k: F.concat(F.lit("base/S"), k, F.lit("/"), F.col("o_orderkey"), F.lit(".mp4")).alias("path")
    listing = o.where("o_orderkey % 3 <> 0").select(folder(F.col("o_orderkey") % 40)).unionByName(o.where("o_orderkey % 4 = 1").select(folder(F.col("o_custkey") % 50)))
    return R.resolve_sample_files(wanted, listing, "base")


# ---------------------------------------------------------------- recordings


def _stamped(spark, d):
    return _t(spark, d, "events").select("event_id", F.col("user_id").alias("user"), S.unix_micros(F.col("ts")).alias("t"))


def _file_of(ending: str):
    """The file of a user, in one of 256 folders, which are listed side by side."""
    return F.concat((F.col("user") % 256).cast("string"), F.lit("/user="), F.col("user").cast("string"), F.lit(ending)).alias("name")


def frame_times(spark, d):
    """Events as one file of frame times a user; some lines can't be read."""
    path, k = scratch_path(spark), F.col("event_id")
    value = F.concat(F.when(k % 17 == 0, "bad").otherwise(k.cast("string")), F.lit(","), (F.col("t") * 1000).cast("string")).alias("value")
    W.write_lines(_stamped(spark, d).select("user", value).repartition("user").sortWithinPartitions("user").select(_file_of("_video_timestamps.csv"), "value"), path, "frame_idx,unix_time_ns")
    return R.scan_frame_times(spark, path).select(F.regexp_extract("recording", r"user=(\d+)_", 1).cast("long").alias("user"), "frame_idx", "unix_time_ns")


def log_times(spark, d):
    """Events as one log a user, in the order of time, with other lines between; days are told by the clock going back."""
    path = scratch_path(spark)
    e = _stamped(spark, d)
    micros = F.col("t") + 8 * 3_600_000_000
    clock = F.format_string("%02d:%02d:%02d.%06d", F.floor(micros / 3_600_000_000) % 24, F.floor(micros / 60_000_000) % 60, F.floor(micros / 1_000_000) % 60, micros % 1_000_000)
    line = F.concat(F.lit("["), clock, F.lit("] Subcarrier count: 996"))
    rows = e.select("user", "t", "event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("noise\n"), line)).otherwise(line).alias("value"))
    W.write_lines(rows.repartition("user").sortWithinPartitions("user", "t", "event_id").select(_file_of(".log"), "value"), path)
    dates = e.groupBy("user").agg(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.min("t") + 8 * 3_600_000_000) / 86_400_000_000).cast("int")).cast("string").alias("date")).select(F.col("user").cast("string").alias("sample_id"), "date")
    return R.scan_log_packet_times(spark, path, dates, 8, sample=r"user=(\d+)\.log$").select(F.col("sample_id").cast("long").alias("user"), "packet_idx", "unix_ns")


def _le(value, size: int):
    """``size`` bytes of a number, least first, as hexadecimal digits."""
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)])


def packet_table(spark, d) -> DataFrame:
    """Embeddings as packet files of twenty vectors (2 receivers, 16 carriers): some end within a packet, in some a header lies."""
    e = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000).cast("long")).alias("iq"))
    k, zero = F.col("vec_id").cast("long"), lambda n: F.lit("00" * n)
    rx = F.when(k % 37 == 5, 3).otherwise(2).cast("long")
    head = F.concat(_le(F.lit(128).cast("long"), 4), zero(4), _le(k, 4), _le(k * 1000, 8), zero(26), _le(rx, 1), _le(F.lit(1).cast("long"), 1), zero(4), _le(F.lit(16).cast("long"), 4), zero(4), _le(F.lit(70).cast("long"), 4), _le(F.lit(71).cast("long"), 4), F.lit("0a0b0c0d0e0f"), zero(18), _le(F.lit(4096).cast("long"), 4), zero(176))
    body = F.array_join(F.transform("iq", lambda v: _le(v, 2)), "")
    each = e.select(F.floor(k / 20).cast("long").alias("file"), F.struct("vec_id", F.concat(head, body).alias("hex")).alias("p"))
    whole = each.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["hex"]), "").alias("hex"))  # twenty packets
    content = F.unhex(F.concat("hex", F.when(F.col("file") % 7 == 0, "0102").otherwise("")))
    return whole.select(F.concat(F.lit("F"), F.col("file")).alias("sample_id"), content.alias("content")).withColumn("length", F.length("content").cast("long"))


def packet_census(spark, d):
    return P.packet_census(packet_table(spark, d)).select("sample_id", "length", "packet_size", "packets", "trailing", F.concat_ws(";", "flags").alias("flags"))


def packet_scan(spark, d):
    rows = P.scan_packets(packet_table(spark, d))
    total = F.aggregate(F.coalesce("iq", F.array().cast("array<smallint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("sample_id", "packet_idx", "csi_size", "ftm_clock", F.col("timestamp").cast("long").alias("timestamp"), "num_rx", "num_subcarriers", "rssi2", "source_mac", "rate_flags", total.alias("iq_sum"), "problem")


def packet_strict(spark, d):
    """Files without faults, the first five packets of each."""
    good = packet_table(spark, d).join(P.packet_problems(P.scan_packets(packet_table(spark, d), 0)).where("mismatched + bad_size + partial = 0").select("sample_id"), "sample_id", "left_semi")
    return P.read_packets(good, max_packets=5).groupBy("sample_id").agg(F.count("*").alias("n"), F.max("packet_idx").alias("last_idx"))


def packet_problems(spark, d):
    return P.packet_problems(P.scan_packets(packet_table(spark, d), 0))


def _written_files(spark, d) -> str:
    """The packet files of ``packet_table`` as files, and for each an empty one, in a folder that driver and executors share."""
    path = scratch_path(spark)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root)
        for b in batches:
            for sample, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for name, data in ((sample, content), ("E" + sample, b"")):
                    with store.open_output_stream(f"{root}/{name}.dat") as f:
                        f.write(data)
            yield pa.RecordBatch.from_pydict({"sample_id": b.column(0)})

    packet_table(spark, d).select("sample_id", "content").mapInArrow(write, "sample_id string").write.format("noop").mode("overwrite").save()
    return path


def packet_ranges(spark, d):
    """Packet files on disk, read in byte ranges of a few packets each; the empty ones have a row with their problem."""
    rows = P.scan_packet_files(spark, _written_files(spark, d), range_bytes=2048)
    total = F.aggregate(F.coalesce("iq", F.array().cast("array<smallint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("sample_id", "packet_idx", "csi_size", "ftm_clock", F.col("timestamp").cast("long").alias("timestamp"), "num_rx", "num_subcarriers", "rssi2", "source_mac", "rate_flags", total.alias("iq_sum"), "problem")


def census_of_files(spark, d):
    """A census of files on disk by their headers, empty files included."""
    heads = P.packet_heads(spark, _written_files(spark, d))
    return P.packet_census(heads).select("sample_id", "length", "packet_size", "packets", "trailing", F.concat_ws(";", "flags").alias("flags"))


def packet_summary(spark, d):
    return Q.packet_summary(P.scan_packets(packet_table(spark, d), 0))


def slice_packets(spark, d):
    """Windows over the packets of each file: some reach beyond it, some are empty."""
    packets = P.scan_packets(packet_table(spark, d), 0)
    k = F.col("vec_id").cast("long")
    windows = _t(spark, d, "embeddings").select(k.alias("window_id"), F.concat(F.lit("F"), F.floor(k / 20)).alias("sample_id"), (k % 20).alias("start_idx"), (k % 20 + k % 6 - 1).alias("end_idx"))
    return P.slice_packets(packets, windows)[1]


def feature_cache(spark, d):
    """Features of the good files, built, then found again; the report of the second run."""
    files = packet_table(spark, d)
    packets = P.scan_packets(files).where("problem IS NULL")
    samples = files.select("sample_id", F.lit("S1").alias("session_id"), F.lit(20).cast("long").alias("n"))
    path = scratch_path(spark)
    X.build_feature_cache(samples.where("sample_id < 'F3'"), packets, path, "v1", "n")
    return X.cache_report(X.build_feature_cache(samples, packets, path, "v1", "n"))


# ---------------------------------------------------------------- sinks


def by_session(spark, d):
    path = scratch_path(spark)
    W.write_by_session(_t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("session_id")), path)
    return spark.read.parquet(path).groupBy(F.col("session_id").cast("long").alias("session_id")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


def metadata(spark, d):
    """A document for each order, with its customer as the sync row."""
    path, o = scratch_path(spark), _t(spark, d, "orders")
    W.write_metadata(o.select(F.col("o_orderkey").alias("sample_id"), "o_custkey"), o.select(F.col("o_orderkey").alias("sample_id"), "o_orderstatus", "o_orderpriority"), path)
    at = lambda p: F.get_json_object("value", p)
    return spark.read.text(path).select(at("$.slice_result.sample_id").cast("long").alias("sample_id"), at("$.slice_result.o_orderstatus").alias("status"), at("$.source_sync_row.o_custkey").cast("long").alias("custkey"))


def run_log(spark, d):
    """Two runs are appended; the later one is read back."""
    path, o = scratch_path(spark), _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    W.append_run_log(o, path, "20240101")
    W.append_run_log(o.where("o_orderstatus = 'F'"), path, "20240102")
    return W.latest_run(spark.read.schema("o_orderkey long, o_orderstatus string, run_id string").parquet(path)).groupBy("run_id", "o_orderstatus").agg(F.count("*").alias("n"))


def evaluation(spark, d):
    """Evaluated orders, written whole; the metrics as they are read back."""
    from windowforge.plans.datasets import _classes, _predictions

    path = scratch_path(spark)
    W.write_evaluation(_predictions(spark, d), _classes(spark, d), path)
    return spark.read.parquet(f"{path}/metrics").select("run", "support", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


def file_list_files(spark, d):
    """The lists of files of each order's sample, written as lines and read back."""
    from windowforge.operators import archive as A

    path, k = scratch_path(spark), F.col("o_orderkey")
    index = _t(spark, d, "orders").select(k.alias("sample_id"), F.concat(F.lit("c/"), k).alias("csi_path"), F.when(k % 3 > 0, F.concat(F.lit("v/"), k)).alias("video_path"))
    A.write_file_lists(index, "sample_id", ["csi_path", "video_path"], path)
    return spark.read.text(path).select("list", "value")


QUERIES = {
    n: globals()[n]
    for n in (
        "read_index ordered_export manifest assignments id_list slice_index reference_maps review_rules resolve_files frame_times log_times packet_census census_of_files packet_scan packet_ranges packet_summary packet_strict packet_problems slice_packets "
        "feature_cache by_session metadata run_log evaluation file_list_files"
    ).split()
}

_FILES = """pk AS (SELECT vec_id, vec_id // 20 AS file, vec_id % 37 = 5 AS lies, list_sum(list_transform(embedding, lambda x: round_even(x::DOUBLE * 1000, 0)::BIGINT))::BIGINT AS s, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1 AS idx FROM embeddings),
fi AS (SELECT file, count(*) AS n, count(*) FILTER (WHERE lies) AS wrong, CASE WHEN file % 7 = 0 THEN 2 ELSE 0 END AS tail FROM pk GROUP BY file)"""
ORACLE = {
    "read_index": "SELECT c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal, concat_ws(';', CASE WHEN c_nationkey < 5 THEN 'near' END, CASE WHEN c_acctbal < 0 THEN 'negative' END) AS f0, NULL::BIGINT AS absent FROM customer",
    "ordered_export": "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier",
    "manifest": "SELECT 'O' || o_orderkey AS sample_id, 'S' || o_custkey AS session_id, o_orderkey % 300 + 1 AS video_frames_written, 29.97::DOUBLE AS video_fps FROM orders WHERE o_orderstatus = 'F'",
    "assignments": "SELECT ['train', 'val', 'test'][(vec_id % 3 + 1)::INT] AS split, 2026::BIGINT AS seed, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1",
    "id_list": "SELECT DISTINCT 'P' || (p_partkey // 2) AS sample_id FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0",
    "slice_index": "WITH k AS (SELECT l_orderkey * 8 + l_linenumber AS k FROM lineitem) SELECT count(*) FILTER (WHERE k % 11 <> 0 AND k % 13 <> 0) AS n, sum(k) FILTER (WHERE k % 11 <> 0 AND k % 13 <> 0)::BIGINT AS ids, count(*) FILTER (WHERE k % 11 = 0 OR k % 13 = 0) AS dropped FROM k",
    "reference_maps": "WITH s AS (SELECT 'S' || c_custkey AS session_id, CASE WHEN c_custkey % 9 <> 0 THEN 'P' || c_custkey END AS expected_person FROM customer) SELECT session_id, expected_person, s_name AS name FROM s LEFT JOIN supplier ON expected_person = 'P' || s_suppkey",
    "review_rules": "SELECT 'S' || n_nationkey AS session_id, 'P' || n_nationkey || '_R003–007' AS clip_expr, n_name AS category, 'seen' AS description, n_regionkey::VARCHAR AS resample_status FROM nation",
    "resolve_files": """WITH l AS (SELECT o_orderkey AS k, 'base/S' || (o_orderkey % 40) || '/' || o_orderkey || '.mp4' AS path FROM orders WHERE o_orderkey % 3 <> 0 UNION SELECT o_orderkey, 'base/S' || (o_custkey % 50) || '/' || o_orderkey || '.mp4' FROM orders WHERE o_orderkey % 4 = 1)
SELECT o_orderkey AS sample_id, coalesce(min(path) FILTER (WHERE path = 'base/S' || (o_custkey % 50) || '/' || o_orderkey || '.mp4'), min(path)) AS path FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY o_orderkey""",
    "frame_times": "SELECT user_id AS user, event_id AS frame_idx, epoch_us(ts) * 1000 AS unix_time_ns FROM events WHERE event_id % 17 <> 0",
    "log_times": """WITH e AS (SELECT user_id AS user, epoch_us(ts) + 28800000000 AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
c AS (SELECT *, l % 86400000000 AS clock, min(l // 86400000000) OVER (PARTITION BY user) AS day FROM e), b AS (SELECT *, coalesce((clock < lag(clock) OVER (PARTITION BY user ORDER BY k))::INT, 0) AS back FROM c)
SELECT user, k AS packet_idx, ((day * 86400000000 + clock - 28800000000 + sum(back) OVER (PARTITION BY user ORDER BY k) * 86400000000) * 1000)::BIGINT AS unix_ns FROM b""",
    "packet_census": f"WITH {_FILES} SELECT 'F' || file AS sample_id, n * 400 + tail AS length, 400::BIGINT AS packet_size, n AS packets, tail::BIGINT AS trailing, CASE WHEN tail > 0 THEN 'csi_trailing_bytes' ELSE '' END AS flags FROM fi",
    "packet_scan": f"""WITH {_FILES} SELECT 'F' || file AS sample_id, idx::INT AS packet_idx, 128::BIGINT AS csi_size, vec_id::BIGINT AS ftm_clock, vec_id::BIGINT * 1000 AS timestamp, CASE WHEN lies THEN 3 ELSE 2 END::SMALLINT AS num_rx, 16::BIGINT AS num_subcarriers, 71::BIGINT AS rssi2, '0a:0b:0c:0d:0e:0f' AS source_mac,
  4096::BIGINT AS rate_flags, CASE WHEN lies THEN 0 ELSE s END AS iq_sum, CASE WHEN lies THEN 'size_mismatch' END AS problem FROM pk
UNION ALL SELECT 'F' || file, n::INT, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 'trailing_partial' FROM fi WHERE tail > 0""",
    "packet_strict": f"WITH {_FILES} SELECT 'F' || file AS sample_id, least(n, 5) AS n, (least(n, 5) - 1)::INT AS last_idx FROM fi WHERE wrong = 0 AND tail = 0",
    "packet_problems": f"WITH {_FILES} SELECT 'F' || file AS sample_id, n - wrong AS packets, wrong AS mismatched, 0::BIGINT AS bad_size, (tail > 0)::BIGINT AS partial FROM fi",
    "slice_packets": f"""WITH {_FILES}, w AS (SELECT vec_id AS window_id, vec_id // 20 AS file, vec_id % 20 AS a, vec_id % 20 + vec_id % 6 - 1 AS b FROM embeddings)
SELECT window_id, CASE WHEN b >= a THEN b - a + 1 END::BIGINT AS expected, count(idx) AS written, CASE WHEN b < a THEN 'invalid_range' WHEN count(idx) = b - a + 1 THEN 'csi_ok' ELSE 'csi_count_mismatch' END AS status
FROM w LEFT JOIN pk ON pk.file = w.file AND NOT lies AND idx BETWEEN a AND b GROUP BY window_id, a, b""",
    "feature_cache": f"WITH {_FILES} SELECT count(*) AS requested, count(*) FILTER (WHERE n - wrong = 20) AS completed, count(*) FILTER (WHERE n - wrong <> 20) AS failed, count(*) FILTER (WHERE n - wrong <> 20) = 0 AS complete, coalesce(string_agg('F' || file, ';' ORDER BY 'F' || file) FILTER (WHERE n - wrong <> 20), '') AS failed_ids FROM fi",
    "by_session": "SELECT o_custkey % 20 AS session_id, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY 1",
    "metadata": "SELECT o_orderkey AS sample_id, o_orderstatus AS status, o_custkey AS custkey FROM orders",
    "run_log": "SELECT '20240102' AS run_id, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 2",
    "file_list_files": "SELECT 'sample_ids' AS list, o_orderkey::VARCHAR AS value FROM orders UNION ALL SELECT unnest(['csi_path', 'all']), 'c/' || o_orderkey FROM orders UNION ALL SELECT unnest(['video_path', 'all']), 'v/' || o_orderkey FROM orders WHERE o_orderkey % 3 > 0",
}
ORACLE["packet_ranges"] = ORACLE["packet_scan"] + " UNION ALL SELECT 'EF' || file, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 'no_packets' FROM fi"
ORACLE["census_of_files"] = ORACLE["packet_census"] + " UNION ALL SELECT 'EF' || file, 0, NULL, 0, 0, 'empty_or_invalid_csi_file' FROM fi"
ORACLE["packet_summary"] = f"""WITH {_FILES} SELECT 'F' || file AS sample_id, n - wrong AS packets, wrong + (tail > 0)::INT AS bad, CASE WHEN wrong = 0 THEN '2' WHEN n > wrong THEN '2;3' ELSE '3' END AS rx_values, '1' AS tx_values, '16' AS subcarrier_values,
  CASE WHEN n = wrong THEN 'error' WHEN wrong > 0 OR tail > 0 THEN 'warn' ELSE 'ok' END AS parse_status FROM fi"""
ORACLE["read_index"] = ORACLE["read_index"].replace(" AS f0", " AS flags")
