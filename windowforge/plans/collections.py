"""Queries over orders as samples, customers as persons, nations as sessions, parts as trials and pages as paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowforge.functions import scalars as S
from windowforge.operators import archive as A
from windowforge.operators import cleanup as C
from windowforge.operators import quality as Q
from windowforge.operators.profile import status_summary as statuses
from windowforge.sources.publish import publish, read_published
from windowforge.sources.scratch import scratch_path

# Hand-written review rules of the queries.
RULES = [(1, "P1_R003-007", "shake"), (2, "P2_R010之后", "dark"), (3, "P3_R001", "cut"), (4, "P4_*", "blur"), (5, "P9_R001–004", "cut"), (6, "P2_R950", "shake")]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rules(spark):
    return spark.createDataFrame(RULES, "rule_id int, clip_expr string, category string")


def _trials(spark, d):
    p = F.col("p_partkey")
    return _t(spark, d, "part").select(F.concat(F.lit("P"), p % 7, F.lit("_R"), F.lpad((p % 1000).cast("string"), 3, "0"), F.when(p % 50 == 0, "x").otherwise("")).alias("sample_id")).distinct()


def review_match(spark, d):
    return Q.match_review_rules(_trials(spark, d), _rules(spark))


def unmatched_rules(spark, d):
    return Q.unmatched_rules(_rules(spark), review_match(spark, d)).select("rule_id", "clip_expr")


def review_labels(spark, d):
    return Q.collect_labels(review_match(spark, d), _rules(spark), ["category"])


def quality_table(spark, d):
    """An order is a slice that promises its number of lines; the lines are its packets, the customer its sync row."""
    o, li, c = _t(spark, d, "orders"), _t(spark, d, "lineitem"), _t(spark, d, "customer")
    slices = o.select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("slice_status"), F.lit("ok").alias("sync_flags"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") % 5).alias("size"), (F.col("o_orderkey") % 4 + 1).alias("written"), (F.col("o_orderkey") % 3 + 2).alias("expected"), (F.col("o_totalprice") / 3e6).alias("seconds"))
    sync = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("c_acctbal") > 0, "ok").otherwise("warn").alias("sync_status"), F.lit(None).cast("long").alias("sync_packets"))
    packets = li.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count("*").alias("packets"), F.count_if(F.col("l_quantity") < 2).alias("partial"), F.lit(0).alias("mismatched"), F.count_if(F.col("l_discount") > 0.09).alias("bad_size"), (F.count_if(F.col("l_tax") > 0.005) / F.count("*")).alias("nonzero_ratio"), F.count_if(F.col("l_tax") < 0.005).alias("zero_packets"), F.lit(0).alias("dead_links"), F.lit(1.0).alias("amplitude_std"))
    review = o.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("sample_id"), F.lit(1).alias("n_rules"), (F.col("o_orderkey") % 2 == 0).alias("resampled"), (F.col("o_orderkey") % 2 == 1).alias("unresolved"))
    return Q.quality_table(slices, sync, packets, review).select("sample_id", F.concat_ws(";", "flags").alias("flags"), "final_status")


def _operations(spark, d):
    o, c, n = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "nation")
    key = F.col("o_orderkey").cast("string")
    base = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("S"), F.col("c_nationkey")).alias("session_id"), F.col("c_mktsegment").alias("person_id"), F.concat(F.lit("data/csi/"), key, F.lit(".dat")).alias("csi_path"), F.concat(F.lit("data/video/"), key, F.lit(".mp4")).alias("video_path"), F.when(F.col("o_orderstatus") == "P", "warn").otherwise("ok").alias("final_status"))
    slices = base.where("sample_id % 2 = 0").select("sample_id", F.concat(F.lit("slice/"), "csi_path").alias("csi_path"), F.lit("").alias("video_path"))
    persons = n.where("n_nationkey < 20").select(F.concat(F.lit("S"), F.col("n_nationkey")).alias("session_id"), F.when(F.col("n_nationkey") % 5 != 0, "BUILDING").alias("expected_person"))
    return base, C.cleanup_plan(base, slices, persons, F.col("sample_id") % 97 == 0, "quarantine", "holdout")


def cleanup_plan(spark, d):
    return _operations(spark, d)[1].drop("replacement")


def clean_index(spark, d):
    base, ops = _operations(spark, d)
    return C.removed_counts(base, ops, "session_id")


def _moves(spark, d):
    base, ops = _operations(spark, d)
    here = base.where("sample_id % 10 <> 3")
    listing = here.select(F.col("csi_path").alias("path")).unionByName(here.select(F.col("video_path").alias("path"))).unionByName(ops.where("sample_id % 7 = 0").select(F.concat_ws("/", "destination", S.base_name(F.col("csi_path"))).alias("path")))
    return base, ops, C.classify_moves(ops, listing, "data", "data/protected")


def apply_preview(spark, d):
    return C.preflight(_moves(spark, d)[2])


def apply_log(spark, d):
    base, ops, moves = _moves(spark, d)
    return C.apply_plan(base, ops, moves)[1].groupBy("kind", "result").agg(F.count("*").alias("n"))


def apply_published(spark, d):
    """The operations whose moves can all run, applied to a published index: its log, what is left, and the snapshot taken before."""
    base, ops, moves = _moves(spark, d)
    path, runs = scratch_path(spark), moves.groupBy("sample_id").agg(F.bool_and(F.col("status") == "would_move").alias("ok")).where("ok").select("sample_id")
    publish(base, f"{path}/index")
    log = C.apply_published(spark, path, ops.join(runs, "sample_id", "left_semi"), moves.join(runs, "sample_id", "left_semi"), "first")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    kept, before = read_published(spark, f"{path}/index"), read_published(spark, f"{path}/snapshots/first")
    logged = read_published(spark, f"{path}/log").groupBy(F.concat_ws(":", "stamp", "kind", "result").alias("name")).agg(F.count("*").alias("n"))
    return logged.unionByName(count(kept, "index")).unionByName(count(before, "snapshot")).unionByName(count(log, "log"))


def verify_counts(spark, d):
    base, ops = _operations(spark, d)
    kept = C.clean_index(base, ops)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    actual = n(base, "all").unionByName(n(kept, "kept")).unionByName(n(C.leaks(kept, ops), "leaked"))
    expected = n(base, "all").unionByName(n(base, "kept")).unionByName(n(base.where("false"), "leaked"))
    return C.verify_counts(actual, expected)


def reconcile(spark, d):
    """Orders against the orders that line items name."""
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    return A.reconcile(o.select(F.col("o_orderkey").alias("key")), li.select(F.col("l_orderkey").alias("key")), "key")


def upsert_index(spark, d):
    """Suppliers as the index; customers, in two versions each, take the place of those of their number or follow."""
    row = lambda df, p, more: df.select(F.col(f"{p}key").alias("id"), (F.col(f"{p}key") + more).alias("at"), F.col(f"{p[:2]}name").alias("name"), (F.col(f"{p[:2]}acctbal") + more).alias("balance"))
    c = _t(spark, d, "customer")
    return A.upsert_index(row(_t(spark, d, "supplier"), "s_supp", 0), row(c, "c_cust", 0).unionByName(row(c, "c_cust", 1)), "id", "at", "at").withColumn("balance", F.round("balance", 4))


def union_collections(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("ok").alias("status"))
    out = A.union_collections(c.where("id % 5 <> 0"), c.where("id % 5 = 0"), "id", "status")
    return out.groupBy("collection").agg(F.count("*").alias("n"))


def _sessions(spark, d):
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 60).alias("person"), F.when(F.col("s_suppkey") % 4 == 0, "S00").otherwise(F.concat(F.lit("S"), F.col("s_nationkey"))).alias("session_id"))


def unique_session_map(spark, d):
    return A.unique_session_map(_sessions(spark, d), ["person"], "session_id", "S00")


def canonical_session(spark, d):
    return A.canonical_session(_sessions(spark, d), ["person"], "session_id", "S00").select("id", "archive_session")


def file_lists(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("v/"), "p_brand").alias("v"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("c/"), "p_type")).alias("c"), F.col("p_name").alias("m"))
    return A.file_lists(p, "p_partkey", ["v", "c", "m"])


def archive_index(spark, d):
    """Suppliers as samples of two collections; those of the fourth session are supplemental and go to their person's only session. Sizes are part prices."""
    s, k = _t(spark, d, "supplier"), F.col("s_suppkey")
    main = F.concat(F.lit("S"), F.col("s_nationkey") + 1)
    text = lambda head, tail: F.concat(F.lit(head), k, F.lit(tail))
    row = lambda df, session: df.select(text("X", "").alias("sample_id"), session.alias("session_id"), F.concat(F.lit("P"), "s_nationkey").alias("person_id"), F.lit("E1").alias("environment_id"), F.lit("walk").alias("action_id"), text("raw/", ".dat").alias("csi_path"), text("raw/", ".mp4").alias("video_path"), F.lit("ok").alias("status"))
    extra = _t(spark, d, "customer").join(s.select(F.col("s_nationkey").alias("c_nationkey")).distinct(), "c_nationkey", "left_semi").select((F.col("c_custkey") + 1_000_000_000).alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"))
    sizes = _t(spark, d, "part").select(F.concat(F.lit("raw/"), "p_partkey", F.lit(".dat")).alias("path"), F.rint(F.col("p_retailprice") * 100).cast("long").alias("bytes"))
    out = A.build_archive(row(s, main), row(extra, F.lit("S00")), sizes)
    return out.select("sample_id", "collection", "archive_session", "archive_csi_path", "archive_video_path", "csi_bytes", "video_bytes")


def release_index(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("archive/data/"), "p_brand", F.lit("/"), "p_partkey").alias("path"), F.col("p_name").alias("source_path"))
    return A.build_release(p, ["source_path"], ["path"], "archive")


def missing_paths(spark, d):
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    return A.missing_paths(o.select(F.col("o_orderkey").cast("string").alias("packets")), li.select(F.col("l_orderkey").cast("string").alias("path")), ["packets"])


def find_outputs(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("dir"), F.concat(F.lit("f"), F.col("l_linenumber")).alias("name")).distinct()
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderkey").alias("dir"), F.when(F.col("o_orderkey") % 2 == 0, "f1").alias("name"))
    return A.find_outputs(o, li)


def anonymisation_status(spark, d):
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    k = F.col("o_orderkey")
    plan = o.select(k.alias("sample_id"), F.concat(F.when(k % 50 == 0, "../").otherwise("v/"), k).alias("source"), F.concat(F.lit("out/"), k).alias("target"), (k % 3 == 0).alias("probe_ok"))
    listing = li.select(F.concat(F.lit("v/"), "l_orderkey").alias("path")).unionByName(li.where("l_orderkey % 4 = 0").select(F.concat(F.lit("out/"), "l_orderkey").alias("path")))
    out = A.anonymisation_status(plan, listing, F.col("sample_id") % 9 != 0)
    return statuses(out, "status", ["unsafe_path", "missing_source", "missing_model", "exists_invalid", "exists", "planned"])


def path_derive(spark, d):
    path = F.regexp_replace("url", "^https?://[^/]*/", "")
    full = F.concat(F.lit("data/csi/"), path, F.lit(".dat"))
    return _t(spark, d, "pages").select("page_id", S.metadata_path(full).alias("metadata"), S.base_name(path).alias("base"), S.relative_path(full, "data").alias("relative"), S.anonymised_path(full, "data/csi", "anon").alias("anonymised"))


def path_safety(spark, d):
    path = F.regexp_replace("url", "^https?://[^/]*", F.lit(""))
    k = F.col("page_id")
    shown = F.when(k % 4 == 0, path).when(k % 4 == 1, F.concat(F.lit("data/../"), k)).when(k % 4 == 2, F.concat(F.lit("data/raw/"), k)).otherwise(F.concat(F.lit("data/"), k))
    return _t(spark, d, "pages").select("page_id", S.safe_path(shown, "data", "data/raw").alias("safe"))


def digest(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.content_digest(F.col("text").cast("binary")).alias("sha256"))


def signature(spark, d):
    return _t(spark, d, "documents").select("doc_id", S.config_signature({"lang": F.col("lang"), "source": F.col("source"), "n": F.col("n_chars")}).alias("signature"))


def log_progress(spark, d):
    """A log for each line item: some name no step, some several; frames before and after, too large ones and others right behind a step."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    step = F.when(n % 3 == 0, F.concat(F.lit("STEP: "), n, F.lit("/9 started, "))).when(n % 3 == 1, F.concat(F.lit("step"), n, F.lit(" / 7\nStep 1/2 ")))
    text = F.concat(F.lit("frame 1/60 done; 70/60 skipped; "), F.coalesce(step, F.lit("")), F.lit("then a frame, "), q, F.lit("/40 now, step 3/3"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.log_progress(text).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.*")


def preview(spark, d):
    """The first sample of each preferred kind, filled up to three a user with other kinds."""
    from pyspark.sql import Window

    e = _t(spark, d, "events").select("user_id", "event_id", "event_type")
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    wanted = F.col("event_type").isin("purchase", "view")
    ranked = e.withColumn("_k", first).withColumn("_p", F.when(wanted & (F.col("_k") == 1), 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("_p", "event_id"))
    return ranked.withColumn("place", place).where("place <= 3").select("user_id", "place", "event_id")


def select_samples(spark, d):
    o = _t(spark, d, "orders")
    chosen = o.join(o.sparkSession.createDataFrame([("1-URGENT",), ("2-HIGH",)], "o_orderpriority string"), "o_orderpriority", "left_semi")
    return chosen.where(F.col("o_orderstatus") == "O").orderBy("o_orderkey").limit(500).select("o_orderkey", "o_orderpriority")


_RULE_ROWS = """rules(rule_id, clip_expr, category, kind, prefix, low, high) AS (VALUES (1, 'P1_R003-007', 'shake', 'range', 'P1', 3, 7), (2, 'P2_R010之后', 'dark', 'from', 'P2', 10, 1073741824),
  (3, 'P3_R001', 'cut', 'exact', 'P3_R001', 0, 0), (4, 'P4_*', 'blur', 'prefix', 'P4_', 0, 0), (5, 'P9_R001–004', 'cut', 'range', 'P9', 1, 4), (6, 'P2_R950', 'shake', 'exact', 'P2_R950', 0, 0)),
tr AS (SELECT DISTINCT 'P' || (p_partkey % 7) || '_R' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || CASE WHEN p_partkey % 50 = 0 THEN 'x' ELSE '' END AS sample_id FROM part),
ts AS (SELECT sample_id, CASE WHEN regexp_matches(sample_id, '_R\\d{3}$') THEN sample_id[:-6] END AS pre, TRY_CAST(regexp_extract(sample_id, '_R(\\d{3})$', 1) AS INT) AS trial FROM tr),
mm AS (SELECT sample_id, rule_id, category FROM ts JOIN rules ON (kind = 'exact' AND sample_id = prefix) OR (kind IN ('range', 'from') AND pre = prefix AND trial BETWEEN low AND high) OR (kind = 'prefix' AND starts_with(sample_id, prefix)))"""
_BASE = """base AS (SELECT o_orderkey AS sample_id, 'S' || c_nationkey AS session_id, c_mktsegment AS person_id, 'data/csi/' || o_orderkey || '.dat' AS csi_path, 'data/video/' || o_orderkey || '.mp4' AS video_path,
  CASE WHEN o_orderstatus = 'P' THEN 'warn' ELSE 'ok' END AS final_status FROM orders JOIN customer ON o_custkey = c_custkey),
ops AS (SELECT sample_id, session_id, CASE WHEN sample_id % 97 = 0 THEN 'holdout' ELSE 'quarantine' END AS operation, CASE WHEN sample_id % 2 = 0 THEN 'slice/' || csi_path ELSE csi_path END AS csi_path, video_path,
  CASE WHEN sample_id % 97 = 0 THEN 'holdout/' ELSE 'quarantine/' END || session_id AS destination,
  CASE WHEN n_nationkey IS NULL THEN 'unknown_session' WHEN n_nationkey % 5 = 0 THEN 'missing_person' WHEN person_id = 'BUILDING' THEN 'ok' ELSE 'mismatch: ' || person_id || ' is not BUILDING' END AS person_check
  FROM base LEFT JOIN nation ON n_nationkey < 20 AND session_id = 'S' || n_nationkey WHERE final_status <> 'ok' OR sample_id % 97 = 0),
opm AS (SELECT *, replace(replace(csi_path, '/csi/', '/metadata/'), '.dat', '.json') AS metadata_path FROM ops)"""
_MOVES = _BASE + """, lst AS (SELECT csi_path AS path FROM base WHERE sample_id % 10 <> 3 UNION SELECT video_path FROM base WHERE sample_id % 10 <> 3 UNION SELECT destination || '/' || string_split(csi_path, '/')[-1] FROM ops WHERE sample_id % 7 = 0),
mv0 AS (SELECT sample_id, destination, 'csi' AS kind, csi_path AS source FROM opm UNION ALL SELECT sample_id, destination, 'video', video_path FROM opm UNION ALL SELECT sample_id, destination, 'metadata', metadata_path FROM opm),
mv AS (SELECT *, CASE WHEN NOT starts_with(source, 'data/') THEN 'safety_blocked' WHEN source NOT IN (SELECT path FROM lst) THEN 'missing_source'
  WHEN destination || '/' || string_split(source, '/')[-1] IN (SELECT path FROM lst) THEN 'destination_exists' ELSE 'would_move' END AS status FROM mv0)"""
_SESS = "ss AS (SELECT s_suppkey AS id, s_suppkey % 60 AS person, CASE WHEN s_suppkey % 4 = 0 THEN 'S00' ELSE 'S' || s_nationkey END AS session_id FROM supplier), um AS (SELECT person, min(session_id) AS main_session FROM ss WHERE session_id <> 'S00' GROUP BY person HAVING count(DISTINCT session_id) = 1)"

QUERIES = {
    n: globals()[n]
    for n in (
        "review_match unmatched_rules review_labels quality_table cleanup_plan clean_index apply_preview apply_log apply_published verify_counts reconcile upsert_index union_collections unique_session_map "
        "canonical_session file_lists archive_index release_index missing_paths find_outputs anonymisation_status path_derive path_safety digest signature log_progress preview select_samples"
    ).split()
}

ORACLE = {
    "review_match": f"WITH {_RULE_ROWS} SELECT sample_id, rule_id FROM mm",
    "unmatched_rules": f"WITH {_RULE_ROWS} SELECT rule_id, clip_expr FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM mm)",
    "review_labels": f"WITH {_RULE_ROWS} SELECT sample_id, string_agg(DISTINCT category, ';' ORDER BY category) AS category, count(DISTINCT rule_id) AS n_rules FROM mm GROUP BY sample_id",
    "quality_table": """WITH p AS (SELECT l_orderkey AS k, count(*) AS packets, count(*) FILTER (WHERE l_quantity < 2) AS part, count(*) FILTER (WHERE l_discount > 0.09) AS bad, count(*) FILTER (WHERE l_tax > 0.005) / count(*) AS nz, count(*) FILTER (WHERE l_tax < 0.005) AS zero FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice / 3e6 AS sec, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 5 END AS size, c_custkey, c_acctbal, p.* EXCLUDE (k) FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN p ON p.k = o_orderkey),
f AS (SELECT k, concat_ws(';', CASE WHEN nz = 0 THEN 'all_zero_csi_payload' END, CASE WHEN bad > 0 THEN 'bad_csi_size' END, CASE WHEN size = 0 THEN 'empty_csi_slice_file' END,
  CASE WHEN packets > 0 AND sec > 0 AND packets / sec > 130 THEN 'high_packet_rate' END, CASE WHEN nz > 0 AND nz < 0.95 THEN 'low_nonzero_ratio' END, CASE WHEN packets > 0 AND sec > 0 AND packets / sec < 80 THEN 'low_packet_rate' END,
  CASE WHEN size IS NULL THEN 'missing_csi_slice_file' END, CASE WHEN packets IS NULL THEN 'missing_packet_rate' END, CASE WHEN c_custkey IS NULL THEN 'missing_sync_index_row' END, CASE WHEN size IS NOT NULL AND packets IS NULL THEN 'no_dat_packets' END,
  CASE WHEN packets <> k % 3 + 2 THEN 'packet_count_mismatch_slice_expected' END, CASE WHEN packets <> k % 4 + 1 THEN 'packet_count_mismatch_slice_index' END, CASE WHEN nz IS NULL THEN 'payload_not_checked' END,
  CASE WHEN zero > 0 THEN 'sampled_zero_packet' END, CASE WHEN st = 'F' THEN 'slice_status_not_ok' END, CASE WHEN NOT c_acctbal > 0 THEN 'sync_status_not_ok' END, CASE WHEN part > 0 THEN 'trailing_partial_packet' END,
  CASE WHEN k % 11 = 0 THEN 'video_review_issue' END, CASE WHEN k % 22 = 0 THEN 'video_review_resampled_available' END, CASE WHEN k % 22 = 11 THEN 'video_review_unresolved' END) AS flags FROM j)
SELECT k AS sample_id, flags, CASE WHEN list_has_any(string_split(flags, ';'), ['slice_status_not_ok', 'missing_csi_slice_file', 'empty_csi_slice_file', 'no_dat_packets', 'trailing_partial_packet', 'bad_csi_size', 'packet_count_mismatch_slice_index', 'all_zero_csi_payload', 'video_review_issue']) THEN 'exclude' WHEN flags <> '' THEN 'warn' ELSE 'ok' END AS final_status FROM f""",
    "cleanup_plan": f"WITH {_BASE} SELECT * FROM opm",
    "clean_index": f"WITH {_BASE} SELECT session_id, count(*) FILTER (WHERE sample_id NOT IN (SELECT sample_id FROM ops)) AS kept, count(*) FILTER (WHERE sample_id IN (SELECT sample_id FROM ops)) AS removed FROM base GROUP BY session_id",
    "apply_preview": f"""WITH {_MOVES}, n AS (SELECT count(*) FILTER (WHERE status = 'would_move') AS would_move, count(*) FILTER (WHERE status = 'safety_blocked') AS blocked, count(*) FILTER (WHERE status = 'missing_source') AS missing, count(*) FILTER (WHERE status = 'destination_exists') AS existing FROM mv)
SELECT *, blocked + missing + existing = 0 AS ok FROM n""",
    "apply_published": f"""WITH {_MOVES}, runs AS (SELECT sample_id FROM mv GROUP BY 1 HAVING bool_and(status = 'would_move'))
SELECT 'first:' || kind || ':moved' AS name, count(*) AS n FROM mv JOIN runs USING (sample_id) GROUP BY kind UNION ALL SELECT 'index', count(*) FROM base WHERE sample_id NOT IN (SELECT sample_id FROM runs)
UNION ALL SELECT 'snapshot', count(*) FROM base WHERE session_id IN (SELECT session_id FROM ops JOIN runs USING (sample_id)) UNION ALL SELECT 'log', count(*) FROM mv JOIN runs USING (sample_id)""",
    "apply_log": f"WITH {_MOVES} SELECT kind, CASE WHEN status = 'would_move' THEN 'preflight_aborted' ELSE status END AS result, count(*) AS n FROM mv GROUP BY ALL",
    "verify_counts": f"""WITH {_BASE}, n AS (SELECT count(*) AS a, count(*) FILTER (WHERE sample_id NOT IN (SELECT sample_id FROM ops)) AS k FROM base)
SELECT 'all' AS name, a AS expected, a AS actual, 'OK' AS verdict FROM n UNION ALL SELECT 'kept', a, k, CASE WHEN a = k THEN 'OK' ELSE 'MISMATCH' END FROM n UNION ALL SELECT 'leaked', 0, 0, 'OK'""",
    "reconcile": """WITH a AS (SELECT o_orderkey AS key FROM orders), b AS (SELECT DISTINCT l_orderkey AS key FROM lineitem)
SELECT key, 'only_first' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'only_second' FROM b WHERE key NOT IN (SELECT key FROM a)""",
    "upsert_index": """WITH m AS (SELECT max(s_suppkey) AS top FROM supplier)
SELECT c_custkey AS id, CASE WHEN s_suppkey IS NOT NULL THEN s_suppkey ELSE top + 1 + c_custkey END AS at, c_name AS name, round(c_acctbal + 1, 4) AS balance FROM customer CROSS JOIN m LEFT JOIN supplier ON s_suppkey = c_custkey
UNION ALL SELECT s_suppkey, s_suppkey, s_name, round(s_acctbal, 4) FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""",
    "union_collections": "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'supplemental' ELSE 'clean' END AS collection, count(*) AS n FROM customer GROUP BY 1",
    "unique_session_map": f"WITH {_SESS} SELECT * FROM um",
    "canonical_session": f"WITH {_SESS} SELECT id, CASE WHEN session_id = 'S00' THEN main_session ELSE session_id END AS archive_session FROM ss LEFT JOIN um ON um.person = ss.person",
    "file_lists": """WITH l AS (SELECT p_partkey, list_filter(['v/' || p_brand, CASE WHEN p_partkey % 3 <> 0 THEN 'c/' || p_type END, p_name], lambda x: x IS NOT NULL) AS fs FROM part)
SELECT p_partkey, (i - 1)::INT AS pos, fs[i] AS path FROM l, unnest(range(1, len(fs) + 1)) AS t(i)""",
    "archive_index": """WITH r AS (SELECT s_suppkey AS k, s_nationkey AS n, 'clean' AS c FROM supplier UNION ALL SELECT c_custkey + 1000000000, c_nationkey, 'supplemental' FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)),
z AS (SELECT p_partkey AS k, round_even(p_retailprice * 100, 0)::BIGINT AS bytes FROM part)
SELECT 'X' || r.k AS sample_id, c AS collection, 'S' || (n + 1) AS archive_session, 'data/S' || (n + 1) || '/csi/walk/' || r.k || '.dat' AS archive_csi_path, 'data/S' || (n + 1) || '/video/walk/' || r.k || '.mp4' AS archive_video_path,
  bytes AS csi_bytes, NULL::BIGINT AS video_bytes FROM r LEFT JOIN z ON z.k = r.k""",
    "release_index": "SELECT p_partkey, 'data/' || p_brand || '/' || p_partkey AS path FROM part",
    "missing_paths": "SELECT 'packets' AS column, o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "find_outputs": """WITH l AS (SELECT DISTINCT l_orderkey AS k, 'f' || l_linenumber AS name FROM lineitem), c AS (SELECT k, count(*) AS n, min(name) AS one, bool_or(name = 'f1') AS f1 FROM l GROUP BY k)
SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN f1 THEN 'f1' END WHEN n = 1 THEN one END AS output,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN f1 THEN 'found' ELSE 'missing_output' END WHEN n = 1 THEN 'found' WHEN n > 1 THEN 'multiple_outputs' ELSE 'missing_output' END AS status FROM orders LEFT JOIN c ON k = o_orderkey""",
    "anonymisation_status": """WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), s AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'unsafe_path' WHEN k IS NULL THEN 'missing_source' WHEN o_orderkey % 9 = 0 THEN 'missing_model'
  WHEN k % 4 = 0 AND o_orderkey % 3 = 0 THEN 'exists' WHEN k % 4 = 0 THEN 'exists_invalid' ELSE 'planned' END AS st FROM orders LEFT JOIN l ON k = o_orderkey)
SELECT x AS status, count(st) AS n FROM (SELECT unnest(['unsafe_path', 'missing_source', 'missing_model', 'exists_invalid', 'exists', 'planned']) AS x) LEFT JOIN s ON st = x GROUP BY x UNION ALL SELECT 'total', count(*) FROM s""",
    "path_derive": r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') AS q FROM pages)
SELECT page_id, regexp_replace(replace('data/csi/' || q || '.dat', '/csi/', '/metadata/'), '\.dat$', '.json') AS metadata, string_split(q, '/')[-1] AS base, 'csi/' || q || '.dat' AS relative,
  'anon/' || regexp_replace(q || '.dat', '\.[^./]*$', '') || '_add.mp4' AS anonymised FROM p""",
    "path_safety": "SELECT page_id, page_id % 4 = 3 AS safe FROM pages",
    "digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "signature": """SELECT doc_id, substr(sha256('{"lang":"' || lang || '","n":' || n_chars || ',"source":"' || source || '"}'), 1, 16) AS signature FROM documents""",
    "log_progress": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 < 2 THEN l_linenumber ELSE 3 END::BIGINT AS step_current,
  CASE l_linenumber % 3 WHEN 0 THEN 9 WHEN 1 THEN 7 ELSE 3 END::BIGINT AS step_total, CASE WHEN l_quantity <= 40 THEN l_quantity ELSE 1 END::BIGINT AS frame_current, CASE WHEN l_quantity <= 40 THEN 40 ELSE 60 END::BIGINT AS frame_total FROM lineitem""",
    "preview": """WITH k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events),
r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type IN ('purchase', 'view') AND k = 1 THEN 0 ELSE 1 END, event_id) AS place FROM k)
SELECT user_id, place::INT AS place, event_id FROM r WHERE place <= 3""",
    "select_samples": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 500",
}
