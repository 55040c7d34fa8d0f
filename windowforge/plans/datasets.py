"""Queries over splits, results and distributions. Persons are embedding labels, actions ids modulo 3; orders are evaluated as runs by priority."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from windowforge.functions import scalars as S
from windowforge.operators import evaluate as E
from windowforge.operators import indexes as I
from windowforge.operators import profile as P
from windowforge.operators import splits as X

SEEDS = [2026, 2027]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _samples(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.col("label").alias("person"), (F.col("vec_id") % 3).alias("action"))


def _split(spark, d):
    return X.stratified_split(_samples(spark, d), ["person", "action"], "vec_id", SEEDS)


def split(spark, d):
    return _split(spark, d).select("seed", "vec_id", "split")


def split_summary(spark, d):
    return X.split_summary(_split(spark, d)).withColumn("ratio", F.round("ratio", 6))


def validate_split(spark, d):
    """A split without the samples whose vectors begin high, and with those twice that begin low."""
    x = _t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    s = _split(spark, d).join(x, "vec_id")
    broken = s.where("x <= 0.2").unionByName(s.where("x < -0.25")).drop("x")
    return X.split_violations(broken, _samples(spark, d), ["person", "action"], "vec_id").groupBy("seed", "problem").agg(F.count("*").alias("n"))


def loso_pairs(spark, d):
    return X.loso_pairs(_samples(spark, d), "person")


def loso_folds(spark, d):
    s = _samples(spark, d)
    return X.subject_folds(s, X.loso_pairs(s, "person"), "person").groupBy("test_person", "split").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


def compare_assignments(spark, d):
    """The split of vectors against one of documents by their length, under the same numbers."""
    a = _split(spark, d).where(F.col("seed") == SEEDS[0]).select("vec_id", F.lit(1).alias("seed"), "split")
    size = F.when(F.col("n_chars") > 900, "train").when(F.col("n_chars") > 500, "val").otherwise("test")
    b = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("seed"), size.alias("split"))
    return X.compare_assignments(a, b, "vec_id")


def _predictions(spark, d):
    """Order status against one guessed from its lines; the runs are priorities."""
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("k"))
    guess = F.when(F.col("q") > 120, "O").when(F.col("k") < 3, "P").otherwise("F")
    return o.join(lines, "o_orderkey", "left").select(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("true"), guess.alias("pred"))


def _classes(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderstatus").alias("label")).unionByName(spark.createDataFrame([("F",), ("O",), ("P",), ("Z",)], "label string")).distinct()


def _confusion(spark, d):
    return E.confusion_matrix(_predictions(spark, d), _classes(spark, d), ("run",))


def class_weights(spark, d):
    labels = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("label"))
    return E.class_weights(labels, _classes(spark, d)).withColumn("weight", F.round("weight", 6))


def confusion(spark, d):
    return _confusion(spark, d)


def confusion_norm(spark, d):
    return E.mean_confusion(_confusion(spark, d), "run").withColumn("share", F.round("share", 6))


def class_report(spark, d):
    r = E.class_report(_confusion(spark, d), ("run",))
    return r.select("run", "label", "support", "predicted", "hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def metrics(spark, d):
    m = E.metrics(E.class_report(_confusion(spark, d), ("run",)), ("run",))
    return m.select("run", "support", *[F.round(c, 6).alias(c) for c in E.METRICS])


def run_summary(spark, d):
    """Runs of all priorities but one, which failed; their matrices are checked over the statuses that there are."""
    pred = _predictions(spark, d)
    counts = E.confusion_matrix(pred.where("run NOT LIKE '5%'"), _t(spark, d, "orders").select(F.col("o_orderstatus").alias("label")).distinct(), ("run",))
    runs = E.metrics(E.class_report(_confusion(spark, d), ("run",)), ("run",)).where("run NOT LIKE '5%'")
    requested = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("run")).distinct()
    out = E.summarise_runs(runs, requested, requested.where("run LIKE '5%'"), counts)
    return out.select("metric", "n_runs", "complete", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


def run_matrix(spark, d):
    arch = _t(spark, d, "part").select(F.col("p_brand").alias("arch")).distinct()
    units = _t(spark, d, "embeddings").select(F.lit("loso").alias("protocol"), F.col("label").cast("string").alias("unit")).distinct()
    done = arch.join(units, F.lit(True)).where("unit IN ('1', '2') AND arch LIKE '%1%'")
    return X.run_matrix(arch, units, done).select("arch", "protocol", "unit")


def early_stop(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("score"))
    w = F.row_number().over(Window.partitionBy("run").orderBy("epoch"))
    return E.early_stop(e.withColumn("epoch", w), 5).withColumn("best_score", F.round("best_score", 6))


def describe_nearest_rank(spark, d):
    return P.describe_nearest_rank(_t(spark, d, "orders"), "o_orderpriority", "o_totalprice")


def packet_rate_summary(spark, d):
    """Lines of an order are its rate; one or two are too few, seven too many. The last row has how many outliers there are."""
    n = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("rate"))
    flags = S.flag_list(S.flagged(F.col("rate") < 3, "low_packet_rate"), S.flagged(F.col("rate") > 6, "high_packet_rate"), S.flagged(F.col("rate") == 4, "count_mismatch"))
    summary, outliers = I.packet_rate_summary(n.withColumn("flags", flags), "l_orderkey", "rate", "flags", 4.0)
    columns = ("min", "p50", "p95", "max", "mean", "std", "delta", "delta_percent")
    out = summary.select("population", "n", *[F.round(c, 6).alias(c) for c in columns])
    return out.unionByName(outliers.agg(F.count("*").alias("n"), F.sum("rate").alias("mean")).select(F.lit("outliers").alias("population"), "n", "mean"), allowMissingColumns=True)


def _flagged(spark, d):
    o = _t(spark, d, "orders")
    flags = S.flag_list(S.flagged(F.col("o_totalprice") > 200000, "bad_csi_size"), S.flagged(F.col("o_orderpriority").startswith("1"), "low_packet_rate"), S.flagged(F.col("o_orderstatus") == "F", "sampled_zero_packet"))
    return o.select("o_orderkey", flags.alias("flags"))


def flag_counts(spark, d):
    text = _flagged(spark, d).select(F.when(F.size("flags") == 0, "ok").otherwise(F.concat_ws(";", "flags")).alias("flags"))
    return P.flag_counts(text, "flags")


def final_status(spark, d):
    return _flagged(spark, d).select("o_orderkey", F.concat_ws(";", "flags").alias("flags"), S.final_status(F.col("flags")).alias("status"))


def count_by(spark, d):
    return P.count_by(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


def status_summary(spark, d):
    return P.status_summary(_t(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


def size_totals(spark, d):
    return P.size_totals(_t(spark, d, "documents"), "lang", F.octet_length("text"))


def integrity_totals(spark, d):
    li = _t(spark, d, "lineitem")
    return P.integrity_totals(li, ["l_linenumber"], {"n_open": F.col("l_linestatus") == "O", "n_returned": F.col("l_returnflag") == "R"})


def profile(spark, d):
    docs = _t(spark, d, "documents")
    out = P.dataset_profile(docs, "lang", "n_chars", F.col("source") == "src0")
    return out.select("samples", "background", "classes", F.round("imbalance", 6).alias("imbalance"), "least", "median", "most")


_SAMPLES = "s AS (SELECT vec_id, label AS person, vec_id % 3 AS action FROM embeddings)"
_SPLIT = f"""{_SAMPLES}, r AS (
  SELECT seed, vec_id, person, action, row_number() OVER (PARTITION BY seed, person, action ORDER BY md5(seed || '|' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY seed, person, action) AS n
  FROM s, (VALUES ({SEEDS[0]}), ({SEEDS[1]})) AS v(seed)),
c AS (SELECT *, round_even(n * 0.65::DOUBLE, 0)::BIGINT AS a FROM r),
x AS (SELECT seed, vec_id, person, action, CASE WHEN k <= a THEN 'train' WHEN k <= a + (n - a) // 2 THEN 'val' ELSE 'test' END AS split FROM c)"""
_PRED = """li AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS q, count(*) AS k FROM lineitem GROUP BY 1),
p AS (SELECT o_orderpriority AS run, o_orderstatus AS t, CASE WHEN q > 120 THEN 'O' WHEN k < 3 THEN 'P' ELSE 'F' END AS g FROM orders LEFT JOIN li USING (o_orderkey)),
cl AS (SELECT o_orderstatus AS label FROM orders UNION SELECT unnest(['F', 'O', 'P', 'Z'])),
m AS (SELECT r.run, a.label AS "true", b.label AS pred, count(p.t) AS n FROM (SELECT DISTINCT run FROM p) r CROSS JOIN cl a CROSS JOIN cl b LEFT JOIN p ON p.run = r.run AND p.t = a.label AND p.g = b.label GROUP BY ALL)"""
_REPORT = _PRED + """, s0 AS (SELECT run, label, sum(n) FILTER (WHERE "true" = label) AS support, sum(n) FILTER (WHERE pred = label) AS predicted, sum(n) FILTER (WHERE pred = label AND "true" = label) AS hit FROM m, cl GROUP BY ALL),
s1 AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re FROM s0),
rp AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM s1),
me AS (SELECT run, sum(hit) / sum(support) AS accuracy, avg(re) FILTER (WHERE support > 0) AS balanced_accuracy, avg(f) AS macro_f1, sum(f * support) / sum(support) AS weighted_f1, sum(support)::BIGINT AS support FROM rp GROUP BY run)"""
_FLAGS = """f AS (SELECT o_orderkey, concat_ws(';', CASE WHEN o_totalprice > 200000 THEN 'bad_csi_size' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'low_packet_rate' END, CASE WHEN o_orderstatus = 'F' THEN 'sampled_zero_packet' END) AS flags FROM orders)"""

QUERIES = {
    n: globals()[n]
    for n in (
        "split split_summary validate_split loso_pairs loso_folds compare_assignments class_weights confusion confusion_norm class_report metrics run_summary run_matrix "
        "early_stop describe_nearest_rank packet_rate_summary flag_counts final_status count_by status_summary size_totals integrity_totals profile"
    ).split()
}

ORACLE = {
    "split": f"WITH {_SPLIT} SELECT seed, vec_id, split FROM x",
    "split_summary": f"WITH {_SPLIT} SELECT seed, split, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY seed), 6) AS ratio FROM x GROUP BY seed, split",
    "validate_split": f"""WITH {_SPLIT}, y AS (SELECT vec_id, embedding[1]::DOUBLE AS z FROM embeddings), b AS (SELECT x.* FROM x JOIN y USING (vec_id) WHERE z <= 0.2 UNION ALL SELECT x.* FROM x JOIN y USING (vec_id) WHERE z < -0.25),
parts AS (SELECT DISTINCT seed, split FROM x), st AS (SELECT DISTINCT person, action FROM s),
v AS (SELECT seed, 'duplicate' AS problem FROM b GROUP BY seed, vec_id HAVING count(*) > 1
  UNION ALL SELECT seed, 'missing' FROM (SELECT DISTINCT seed FROM b) z CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.seed = z.seed AND b.vec_id = s.vec_id)
  UNION ALL SELECT seed, 'stratum_missing' FROM parts CROSS JOIN st WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.seed = parts.seed AND b.split = parts.split AND b.person = st.person AND b.action = st.action))
SELECT seed, problem, count(*) AS n FROM v GROUP BY ALL""",
    "loso_pairs": "WITH p AS (SELECT DISTINCT label AS t FROM embeddings) SELECT t AS test_person, coalesce(lead(t) OVER (ORDER BY t), (SELECT min(t) FROM p)) AS val_person FROM p",
    "loso_folds": f"""WITH {_SAMPLES}, p AS (SELECT DISTINCT person AS t FROM s), q AS (SELECT t, coalesce(lead(t) OVER (ORDER BY t), (SELECT min(t) FROM p)) AS v FROM p)
SELECT t AS test_person, CASE WHEN person = t THEN 'test' WHEN person = v THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM s CROSS JOIN q GROUP BY 1, 2""",
    "compare_assignments": f"""WITH {_SPLIT}, a AS (SELECT * FROM x WHERE seed = {SEEDS[0]}), b AS (SELECT doc_id AS vec_id, CASE WHEN n_chars > 900 THEN 'train' WHEN n_chars > 500 THEN 'val' ELSE 'test' END AS split FROM documents)
SELECT * FROM (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, CASE WHEN b.split IS NULL THEN 'missing' WHEN a.split IS NULL THEN 'extra' WHEN a.split <> b.split THEN 'split' END AS problem
FROM a FULL JOIN b ON a.vec_id = b.vec_id) WHERE problem IS NOT NULL""",
    "class_weights": f"""WITH {_PRED}, k AS (SELECT label, nullif(count(o_orderkey), 0) AS n FROM cl LEFT JOIN orders ON o_orderstatus = label GROUP BY label)
SELECT label, coalesce(n, 0) AS n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM k""",
    "confusion": f"WITH {_PRED} SELECT * FROM m",
    "confusion_norm": f"""WITH {_PRED}, s AS (SELECT *, sum(n) OVER (PARTITION BY run, "true") AS t FROM m) SELECT "true", pred, round(avg(CASE WHEN t > 0 THEN n / t ELSE 0 END), 6) AS share FROM s GROUP BY 1, 2""",
    "class_report": f"WITH {_REPORT} SELECT run, label, support::BIGINT AS support, predicted::BIGINT AS predicted, hit::BIGINT AS hit, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1 FROM rp",
    "metrics": f"WITH {_REPORT} SELECT run, support, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM me",
    "run_summary": f"""WITH {_REPORT}, l AS (UNPIVOT (SELECT run, accuracy, balanced_accuracy, macro_f1, weighted_f1 FROM me WHERE run NOT LIKE '5%') ON accuracy, balanced_accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE v)
SELECT metric, count(*) AS n_runs, false AS complete, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM l GROUP BY metric""",
    "run_matrix": """WITH a AS (SELECT DISTINCT p_brand AS arch FROM part), u AS (SELECT DISTINCT 'loso' AS protocol, label::VARCHAR AS unit FROM embeddings)
SELECT * FROM a CROSS JOIN u WHERE NOT (unit IN ('1', '2') AND arch LIKE '%1%')""",
    "early_stop": """WITH h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS score FROM events),
b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM h),
c AS (SELECT *, CASE WHEN top IS NULL OR score > top THEN epoch END AS best FROM b),
e AS (SELECT *, max(best) OVER (PARTITION BY run ORDER BY epoch) AS last FROM c),
s AS (SELECT run, coalesce(min(epoch) FILTER (WHERE epoch - last >= 5), max(epoch))::INT AS stop_epoch FROM e GROUP BY run)
SELECT e.run, max(best)::INT AS best_epoch, round(arg_max(score, epoch) FILTER (WHERE best IS NOT NULL), 6) AS best_score, any_value(stop_epoch) AS stop_epoch FROM e JOIN s ON s.run = e.run WHERE epoch <= stop_epoch GROUP BY e.run""",
    "describe_nearest_rank": """WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, max(n) AS n, min(v) AS min, max(v) AS max, max(v) FILTER (WHERE k = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(v) FILTER (WHERE k = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95 FROM r GROUP BY 1""",
    "packet_rate_summary": """WITH r AS (SELECT count(*)::DOUBLE AS v FROM lineitem GROUP BY l_orderkey), p AS (SELECT 'all' AS population, v FROM r UNION ALL SELECT 'normal', v FROM r WHERE v BETWEEN 3 AND 6)
SELECT population, count(*) AS n, min(v) AS min, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg(v) - 4, 6) AS delta, round((avg(v) - 4) / 4 * 100, 6) AS delta_percent
FROM p GROUP BY population UNION ALL SELECT 'outliers', count(*), NULL, NULL, NULL, NULL, sum(v), NULL, NULL, NULL FROM r WHERE v NOT BETWEEN 3 AND 6""",
    "flag_counts": f"WITH {_FLAGS} SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN flags = '' THEN 'ok' ELSE flags END, ';')) AS flag FROM f) GROUP BY flag",
    "final_status": f"WITH {_FLAGS} SELECT o_orderkey, flags, CASE WHEN flags LIKE '%bad_csi_size%' THEN 'exclude' WHEN flags <> '' THEN 'warn' ELSE 'ok' END AS status FROM f",
    "count_by": "SELECT 'o_orderstatus' AS key, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL",
    "status_summary": "SELECT s AS status, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s UNION ALL SELECT 'total', count(*) FROM orders",
    "size_totals": "SELECT lang, sum(strlen(text))::BIGINT AS bytes, count(*) AS n, round(sum(strlen(text)) / 1048576, 2) AS mib FROM documents GROUP BY lang",
    "integrity_totals": "SELECT sum(l_linenumber)::BIGINT AS l_linenumber, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem",
    "profile": """WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE source = 'src0') AS b FROM documents GROUP BY lang)
SELECT sum(n)::BIGINT AS samples, sum(b)::BIGINT AS background, count(*) AS classes, round(max(n) / min(n), 6) AS imbalance, (SELECT min(n_chars)::DOUBLE FROM documents WHERE source <> 'src0') AS least,
  (SELECT quantile_cont(n_chars, 0.5) FROM documents WHERE source <> 'src0') AS median, (SELECT max(n_chars)::DOUBLE FROM documents WHERE source <> 'src0') AS most FROM c""",
}
