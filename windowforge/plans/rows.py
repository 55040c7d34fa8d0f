"""Queries of row-wise helpers, choices, lists and orders over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowforge.functions import scalars as S
from windowforge.operators import archive as A
from windowforge.operators import checks as K
from windowforge.operators import cleanup as C
from windowforge.operators import indexes as I
from windowforge.operators import profile as P
from windowforge.operators import quality as Q
from windowforge.operators import splits as X
from windowforge.operators.process import process_rows

#: Kinds of orders that a preview prefers, in this order.
PREFERRED = ["2-HIGH", "1-URGENT", "9-NONE"]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def casts(spark, d):
    """Numbers as text of many forms, read leniently, and written with fixed digits."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    forms = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, F.concat(k, F.lit(".75"))).when(k % 6 == 2, "nan").when(k % 6 == 3, "").when(k % 6 == 4, "x1").otherwise(F.concat(F.lit(" "), k, F.lit(" ")))
    rows = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", forms.alias("text"))
    return rows.select("o_orderkey", S.to_int(F.col("text")).alias("whole"), S.to_float(F.col("text")).alias("number"), S.fixed(F.when(k % 5 > 0, F.col("o_totalprice")), 2).alias("shown"))


def json_lines(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", S.sorted_json(["n_regionkey", "n_name", "n_nationkey"]).alias("line"))


def probes(spark, d):
    """Line items as probe results: flags in a text, and whether all numbers are positive."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    flags = F.concat_ws(";", F.when(k % 2 == 0, "dead_rx_tx_link"), F.when(k % 3 == 0, "low_packet_rate"), F.lit("other_low_packet_rate"))
    probe = S.valid_probe(F.col("l_quantity") - 5, F.when(k % 7 > 0, F.col("l_extendedprice")))
    rows = _t(spark, d, "lineitem").select("l_orderkey", S.has_flag(flags, "low_packet_rate").alias("low"), probe.alias("probe"))
    return rows.groupBy("l_orderkey").agg(F.count_if("low").alias("n_low"), F.count_if("probe").alias("n_valid"))


def nonzero(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", S.nonzero_count(F.transform("embedding", lambda x: F.rint(x))).alias("n"))


def log_clock(spark, d):
    """The clock of each event, as logs write it, with its date at UTC+8."""
    us = S.unix_micros(F.col("ts")) + 8 * 3_600_000_000
    clock = F.format_string("%02d:%02d:%02d.%03d", F.floor(us / 3_600_000_000) % 24, F.floor(us / 60_000_000) % 60, F.floor(us / 1_000_000) % 60, F.floor(us / 1000) % 1000)
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int"))
    return _t(spark, d, "events").select("event_id", S.log_time_ns(date, F.when(F.col("event_id") % 19 == 0, "25:61:00.1").otherwise(clock)).alias("unix_ns"))


def _order_samples(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("sample_id"), (F.col("o_custkey") % 50).cast("string").alias("session_id"), F.col("o_orderpriority").alias("action_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("low_packet_rate").alias("quality_flags"))


def chosen_samples(spark, d):
    """All samples of two sessions and two actions, with those that warn."""
    return X.select_samples(_order_samples(spark, d), "o_orderkey", sessions=["3", "4"], actions=["1-URGENT", "2-HIGH"], include_warn=True, full=True).select("o_orderkey", "session_id", "action_id")


def preview_samples(spark, d):
    """The default preview: preferred actions first, filled up to three."""
    return X.select_samples(_order_samples(spark, d), "o_orderkey", preferred=PREFERRED).select("o_orderkey", "action_id")


def first_of_actions(spark, d):
    return X.first_per_action(_order_samples(spark, d), "action_id", "o_orderkey", PREFERRED, 4, "5-LOW").select("o_orderkey", "action_id", "place")


def _people(spark, d):
    s = _t(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("sample_id"), F.when(F.col("s_suppkey") % 5 == 0, "NONE").when(F.col("s_suppkey") % 7 > 0, F.concat(F.lit("P"), "s_nationkey")).alias("person_id"), F.concat(F.lit("A"), F.col("s_suppkey") % 4).alias("action_id"))


def human_samples(spark, d):
    return X.human_samples(_people(spark, d), ["A1", "A2"]).select("sample_id", "person_id")


def complement(spark, d):
    """Customers without orders."""
    return X.complement(_t(spark, d, "customer").select("c_custkey", "c_name"), _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def removed_ids(spark, d):
    """Parts that were returned or are small, once each."""
    part = lambda df, c: df.select(F.col(c).alias("sample_id"))
    li = _t(spark, d, "lineitem")
    return C.removed_ids(part(li.where("l_returnflag = 'R'"), "l_partkey"), part(_t(spark, d, "part").where("p_size < 5"), "p_partkey"))


def removed_counts(spark, d):
    removed = removed_ids(spark, d).withColumnRenamed("sample_id", "p_partkey")
    return C.removed_counts(_t(spark, d, "part"), removed, "p_brand", "p_partkey")


def leaks(spark, d):
    """Rows of a cleaned index that should have gone: here those that a second list removes."""
    part = _t(spark, d, "part").select("p_partkey", "p_brand")
    cleaned = C.clean_index(part, removed_ids(spark, d).withColumnRenamed("sample_id", "p_partkey"), "p_partkey")
    return C.leaks(cleaned, _t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


def snapshot(spark, d):
    """Customers of all nations that an operation on a customer in debt touches."""
    c = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("S"), "c_nationkey").alias("session_id"), "c_acctbal")
    return C.snapshot(c, c.where("c_acctbal < -900"), "before").select("c_custkey", "snapshot")


def overridden(spark, d):
    """Customers' segments, replaced for the nations that a list names."""
    c = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("S"), "c_nationkey").alias("session_id"), "c_mktsegment")
    lists = _t(spark, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("S"), "n_nationkey").alias("session_id"), F.col("n_name").alias("value"))
    return A.overridden(c, lists, "c_mktsegment").select("c_custkey", "c_mktsegment")


def session_lookup(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("session_id"))
    return A.session_lookup(c, _t(spark, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("session_id"), "n_name"), "n_name").select("c_custkey", "n_name")


def first_rows(spark, d):
    """Each user's first event, and the last."""
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type")
    first, last = (f(e, "user_id", "event_id").select("user_id", F.col("event_id").alias(f"{n}_id"), F.col("event_type").alias(f"{n}_type")) for f, n in ((Q.first_rows, "first"), (Q.last_rows, "last")))
    return first.join(last, "user_id")


def first_valid_packets(spark, d):
    """Each user's first three events that aren't errors."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("packet_idx"), F.when(F.col("event_type") == "view", "view").alias("problem"))
    return Q.first_valid_packets(e, 3).select("sample_id", "packet_idx")


def most_common(spark, d):
    """The seven types of parts that are most frequent."""
    return P.most_common(_t(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")), "p_type", 7)


def warning_sample(spark, d):
    """The first forty orders that aren't finished, and the number of the others."""
    rows, rest = P.warning_sample(_t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "ok").otherwise("warn").alias("status")), "status", "o_orderkey", 40)
    return rows.select("o_orderkey").join(rest, F.lit(True))


def head_examples(spark, d):
    return K.head_examples(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), 10, "c_acctbal", "c_custkey")


def duplicates(spark, d):
    return K.duplicates(_t(spark, d, "lineitem"), "l_orderkey", "l_partkey").select("l_orderkey", "l_partkey", F.col("count").alias("n"))


def summary_table(spark, d):
    """Counts of orders by status and of customers by segment as one table."""
    counts = lambda t, c: _t(spark, d, t).groupBy(F.col(c).alias("key")).agg(F.count("*").alias("value"))
    return P.summary_table({"status": counts("orders", "o_orderstatus"), "segment": counts("customer", "c_mktsegment")})


def rate_outliers(spark, d):
    """Customers whose balance lies within, and how many lie outside or have none."""
    inside, outside = I.rate_outliers(_t(spark, d, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal")).alias("rate")), "rate", 0, 5000)
    tag = lambda df, n: df.groupBy("c_nationkey").agg(F.count("*").alias("n")).withColumn("side", F.lit(n))
    return tag(inside, "inside").unionByName(tag(outside, "outside"))


def out_of_range(spark, d):
    """Predictions outside the known classes."""
    from windowforge.operators import evaluate as E

    p = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("true"), F.substring("o_orderpriority", 1, 1).alias("pred"))
    classes = _t(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("label")).unionByName(_t(spark, d, "orders").select(F.col("o_orderstatus").alias("label")).where("label <> 'P'").distinct())
    return E.out_of_range(p, classes).groupBy("true", "pred").agg(F.count("*").alias("n"))


def _judged(row: dict) -> dict:
    if row["n_chars"] % 10 == 3:
        raise ValueError(f"no {row['doc_id']}")
    return {"doc_id": row["doc_id"], "words": len((row["text"] or "").split(" "))}


def row_processor(spark, d):
    """A hook from outside over all documents: some rows fail, the others go on."""
    out = process_rows(_t(spark, d, "documents").select("doc_id", "text", "n_chars"), _judged, "doc_id long, words long")
    return out.groupBy(F.coalesce(F.split("error", " ")[0], F.lit("ok")).alias("status")).agg(F.count("*").alias("n"), F.sum("words").alias("words"))


QUERIES = {
    n: globals()[n]
    for n in (
        "casts json_lines probes nonzero log_clock chosen_samples preview_samples first_of_actions human_samples complement removed_ids removed_counts leaks snapshot overridden session_lookup first_rows first_valid_packets "
        "most_common warning_sample head_examples duplicates summary_table rate_outliers out_of_range row_processor"
    ).split()
}

_REMOVED = "gone AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size < 5)"
_SAMPLE = "s AS (SELECT o_orderkey, (o_custkey % 50)::VARCHAR AS session_id, o_orderpriority AS action_id, o_orderstatus = 'F' AS ok FROM orders)"
_FIRSTS = """f AS (SELECT action_id, min(o_orderkey) AS k, CASE action_id WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS r FROM {s} WHERE action_id IN ('2-HIGH', '1-URGENT', '9-NONE') GROUP BY 1),
g AS (SELECT o_orderkey AS k, action_id, 4 AS r FROM {s} WHERE action_id <> '{avoid}' AND o_orderkey NOT IN (SELECT k FROM f) ORDER BY o_orderkey LIMIT {n}), h AS (SELECT k AS o_orderkey, action_id, r, row_number() OVER (ORDER BY r, k) AS place FROM (SELECT k, action_id, r FROM f UNION ALL SELECT * FROM g))"""
ORACLE = {
    "casts": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 5) THEN o_orderkey END AS whole, CASE WHEN o_orderkey % 6 = 1 THEN o_orderkey + 0.75::DOUBLE WHEN o_orderkey % 6 IN (0, 5) THEN o_orderkey::DOUBLE END AS number,
  CASE WHEN o_orderkey % 5 > 0 THEN printf('%.2f', o_totalprice) ELSE '' END AS shown FROM orders""",
    "json_lines": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM nation""",
    "probes": "SELECT l_orderkey, count(*) FILTER (WHERE (l_orderkey + l_linenumber) % 3 = 0) AS n_low, count(*) FILTER (WHERE l_quantity > 5 AND (l_orderkey + l_linenumber) % 7 > 0 AND l_extendedprice > 0) AS n_valid FROM lineitem GROUP BY 1",
    "nonzero": "SELECT vec_id, len(list_filter(embedding, lambda x: round_even(x::DOUBLE, 0) <> 0))::INT AS n FROM embeddings",
    "log_clock": "SELECT event_id, CASE WHEN event_id % 19 <> 0 THEN epoch_us(ts) // 1000 * 1000000 END AS unix_ns FROM events",
    "chosen_samples": f"WITH {_SAMPLE} SELECT o_orderkey, session_id, action_id FROM s WHERE session_id IN ('3', '4') AND action_id IN ('1-URGENT', '2-HIGH')",
    "preview_samples": f"WITH {_SAMPLE}, s1 AS (SELECT * FROM s WHERE ok), {_FIRSTS.format(s='s1', avoid='background_idle', n=3)} SELECT o_orderkey, action_id FROM h WHERE (r < 4 OR place <= 3) AND place <= 3",
    "first_of_actions": f"WITH {_SAMPLE}, {_FIRSTS.format(s='s', avoid='5-LOW', n=4)} SELECT o_orderkey, action_id, place::INT AS place FROM h WHERE r < 4 OR place <= 4",
    "human_samples": "SELECT s_suppkey AS sample_id, 'P' || s_nationkey AS person_id FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 > 0 AND s_suppkey % 4 IN (1, 2)",
    "complement": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "removed_ids": f"WITH {_REMOVED} SELECT k AS sample_id FROM gone",
    "removed_counts": f"WITH {_REMOVED} SELECT p_brand, count(*) FILTER (WHERE k IS NULL) AS kept, count(k) AS removed FROM part LEFT JOIN gone ON k = p_partkey GROUP BY 1",
    "leaks": f"WITH {_REMOVED} SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT k FROM gone) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "snapshot": "SELECT c_custkey, 'before' AS snapshot FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900)",
    "overridden": "SELECT c_custkey, coalesce(n_name, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 2",
    "session_lookup": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 1",
    "first_rows": "SELECT user_id, min(event_id) AS first_id, arg_min(event_type, event_id) AS first_type, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1",
    "first_valid_packets": "SELECT user_id AS sample_id, event_id AS packet_idx FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'view') WHERE k <= 3",
    "most_common": "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7",
    "warning_sample": "WITH b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders WHERE o_orderstatus <> 'F') SELECT o_orderkey, greatest(0, n - 40) AS omitted FROM b WHERE k <= 40",
    "head_examples": "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2, 1 LIMIT 10",
    "duplicates": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "summary_table": "SELECT 'status' AS section, o_orderstatus AS key, count(*)::VARCHAR AS value FROM orders GROUP BY 2 UNION ALL SELECT 'segment', c_mktsegment, count(*)::VARCHAR FROM customer GROUP BY 2",
    "rate_outliers": "SELECT c_nationkey, CASE WHEN c_custkey % 9 > 0 AND c_acctbal BETWEEN 0 AND 5000 THEN 'inside' ELSE 'outside' END AS side, count(*) AS n FROM customer GROUP BY ALL",
    "out_of_range": """WITH p AS (SELECT o_orderstatus AS "true", o_orderpriority[1] AS pred FROM orders), k AS (SELECT r_regionkey::VARCHAR AS label FROM region UNION SELECT o_orderstatus FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT * FROM p WHERE "true" NOT IN (SELECT label FROM k) UNION ALL SELECT * FROM p WHERE pred NOT IN (SELECT label FROM k)) SELECT "true", pred, count(*) AS n FROM b GROUP BY ALL""",
    "row_processor": "SELECT CASE WHEN n_chars % 10 = 3 THEN 'ValueError:' ELSE 'ok' END AS status, count(*) AS n, sum(CASE WHEN n_chars % 10 <> 3 THEN len(string_split(text, ' ')) END)::BIGINT AS words FROM documents GROUP BY 1",
}
