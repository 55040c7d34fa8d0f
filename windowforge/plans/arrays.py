"""Queries over embeddings as arrays: pairs of numbers are I/Q, halves are receivers, labels samples, places carriers."""

from __future__ import annotations

from pyspark.sql import functions as F

from windowforge.functions import scalars as S
from windowforge.operators import features as X
from windowforge.operators import quality as Q


def _e(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").alias("sample_id"), F.col("embedding").cast("array<double>").alias("v"))


def amplitude_stats(spark, d):
    half = lambda k: F.slice("v", 1 + 32 * k, 32)
    links = _e(spark, d).select("sample_id", F.explode(F.array(*[F.struct(F.lit(k).alias("link"), S.amplitudes(half(k)).alias("amplitude")) for k in (0, 1)])).alias("l")).select("sample_id", "l.*")
    out = Q.payload_stats(links)
    return out.select("sample_id", "packets", "zero_packets", "dead_links", *[F.round(c, 6).alias(c) for c in ("nonzero_ratio", "amplitude_min", "amplitude_mean", "amplitude_max", "amplitude_std", "link_ratio_min", "link_mean_min")])


def even_indices(spark, d):
    return _e(spark, d).select("vec_id", F.explode(S.even_indices(F.col("vec_id") % 400 + 1, 16)).alias("place"))


def zscore(spark, d):
    z = _e(spark, d).select("vec_id", F.posexplode(F.array(*[S.z_scores(F.slice("v", 1 + 32 * k, 32)) for k in (0, 1)])).alias("rx", "z"))
    return z.select("vec_id", "rx", F.posexplode("z").alias("place", "z")).withColumn("z", F.round("z", 5))


def carrier_energy(spark, d):
    rows = _e(spark, d).select("sample_id", F.transform("v", lambda x: F.abs(x)).alias("v"))
    return X.carrier_energy(rows, "sample_id", "v").withColumn("energy", F.round("energy", 6))


def repair_carriers(spark, d):
    rows = _e(spark, d).select("sample_id", F.transform("v", lambda x: F.greatest(F.lit(0.0), x)).alias("v"))
    return X.repaired_energy(X.carrier_energy(rows, "sample_id", "v"), "sample_id", 0.5).select("sample_id", "carrier", F.round("energy", 6).alias("energy"), F.round("repaired", 6).alias("repaired"), "valid", "problem")


def preprocess(spark, d):
    iq = F.transform("v", lambda x: F.rint(x * 1000).cast("smallint"))
    rows = _e(spark, d).select(F.col("sample_id").cast("string").alias("sample_id"), F.col("vec_id").alias("packet_idx"), F.lit(2).alias("num_rx"), F.lit(1).alias("num_tx"), F.lit(16).alias("num_subcarriers"), iq.alias("iq"))
    out = X.preprocess(rows, 8, 8).select("sample_id", "rx", "t", F.posexplode_outer("values").alias("slot", "z"), "problem")
    return out.withColumn("z", F.round(F.col("z").cast("double"), 5))


QUERIES = {"amplitude_stats": amplitude_stats, "even_indices": even_indices, "zscore": zscore, "carrier_energy": carrier_energy, "repair_carriers": repair_carriers, "preprocess": preprocess}

_A = """v AS (SELECT vec_id, label AS sample_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
x AS (SELECT sample_id, k AS link, vec_id, sqrt(v[32 * k + 2 * j + 1] * v[32 * k + 2 * j + 1] + v[32 * k + 2 * j + 2] * v[32 * k + 2 * j + 2]) AS a FROM v, range(0, 2) AS t(k), range(0, 16) AS u(j))"""
_REPAIR = """r AS (SELECT sample_id, median(energy) AS typical FROM e WHERE energy > 1e-6 GROUP BY 1),
v0 AS (SELECT e.*, energy > 1e-6 AS sounds, energy > 1e-6 AND energy >= {ratio} * typical AS strong FROM e LEFT JOIN r USING (sample_id)),
v AS (SELECT *, CASE WHEN count(*) FILTER (WHERE strong) OVER (PARTITION BY sample_id) >= 2 THEN strong ELSE sounds END AS valid FROM v0),
nx AS (SELECT v.sample_id, v.carrier, v.energy, v.valid, coalesce(min(u.carrier) FILTER (WHERE u.carrier >= v.carrier), max(u.carrier)) AS hi FROM v LEFT JOIN v u ON u.sample_id = v.sample_id AND u.valid GROUP BY ALL),
pl AS (SELECT nx.*, coalesce(max(u.carrier), any_value(hi)) AS lo, count(u.carrier) AS dummy FROM nx LEFT JOIN v u ON u.sample_id = nx.sample_id AND u.valid AND u.carrier < nx.hi GROUP BY ALL),
pn AS (SELECT *, CASE WHEN hi > lo THEN (carrier - lo) / (hi - lo)::DOUBLE ELSE 0 END AS weight, count(*) FILTER (WHERE valid) OVER (PARTITION BY sample_id) AS n_valid FROM pl)"""
ORACLE = {
    "repair_carriers": "WITH e AS (SELECT label AS sample_id, j::INT AS carrier, median(greatest(0, embedding[j + 1]::DOUBLE)) AS energy FROM embeddings, range(0, 64) AS t(j) GROUP BY 1, 2),"
    + _REPAIR.format(ratio=0.5)
    + """
SELECT pn.sample_id, pn.carrier, round(pn.energy, 6) AS energy, valid, CASE WHEN n_valid = 0 THEN 'no_energy' WHEN n_valid = 1 THEN 'one_usable_carrier' END AS problem,
  CASE WHEN n_valid > 1 THEN round(CASE WHEN valid THEN pn.energy ELSE a.energy * (1 - weight) + b.energy * weight END, 6) END AS repaired
FROM pn LEFT JOIN e a ON a.sample_id = pn.sample_id AND a.carrier = lo LEFT JOIN e b ON b.sample_id = pn.sample_id AND b.carrier = hi""",
    "preprocess": """WITH q AS (SELECT label::VARCHAR AS sample_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS n, list_transform(embedding, lambda x: round_even(x::DOUBLE * 1000, 0)) AS v FROM embeddings),
x AS (SELECT sample_id, place, n, r::INT AS rx, j::INT AS carrier, ln(1 + sqrt(v[32 * r + 2 * j + 1] ** 2 + v[32 * r + 2 * j + 2] ** 2)) AS a FROM q, range(0, 2) AS t(r), range(0, 16) AS u(j)),
e AS (SELECT sample_id, carrier, median(a) AS energy FROM x GROUP BY 1, 2),"""
    + _REPAIR.format(ratio=0.05)
    + """,
fs AS (SELECT f::INT AS slot, CASE WHEN f = 7 THEN 15 ELSE round_even(f * (15 / 7.0::DOUBLE), 0) END AS carrier FROM range(0, 8) AS t(f)),
ts AS (SELECT DISTINCT sample_id, t::INT AS t, CASE WHEN t = 7 THEN n - 1 ELSE round_even(t * ((n - 1) / 7.0::DOUBLE), 0) END AS place FROM q, range(0, 8) AS w(t)),
y AS (SELECT x.sample_id, x.rx, ts.t, fs.slot, CASE WHEN valid THEN x.a ELSE a.a * (1 - weight) + b.a * weight END AS y FROM x JOIN fs ON fs.carrier = x.carrier JOIN ts ON ts.sample_id = x.sample_id AND ts.place = x.place
  JOIN pn ON pn.sample_id = x.sample_id AND pn.carrier = x.carrier JOIN x a ON a.sample_id = x.sample_id AND a.place = x.place AND a.rx = x.rx AND a.carrier = lo JOIN x b ON b.sample_id = x.sample_id AND b.place = x.place AND b.rx = x.rx AND b.carrier = hi)
SELECT sample_id, rx, t, slot, round(((y - avg(y) OVER w) / greatest(stddev_pop(y) OVER w, 1e-6))::FLOAT::DOUBLE, 5) AS z, NULL::VARCHAR AS problem FROM y WINDOW w AS (PARTITION BY sample_id, rx)""",
    "amplitude_stats": f"""WITH {_A}, p AS (SELECT sample_id, link, vec_id, count(*) FILTER (WHERE a <> 0) AS nz FROM x GROUP BY ALL), z AS (SELECT sample_id, count(*) FILTER (WHERE nz = 0) AS zp FROM p GROUP BY 1),
l AS (SELECT sample_id, link, count(*) AS k, count(*) FILTER (WHERE a <> 0) AS nz, sum(a) AS s, sum(a * a) AS q, min(a) AS lo, max(a) AS hi, count(DISTINCT vec_id) AS n FROM x GROUP BY ALL)
SELECT l.sample_id, max(n) AS packets, any_value(zp) AS zero_packets, count(*) FILTER (WHERE nz = 0) AS dead_links, round(sum(nz) / sum(k), 6) AS nonzero_ratio, round(min(lo), 6) AS amplitude_min, round(sum(s) / sum(k), 6) AS amplitude_mean,
  round(max(hi), 6) AS amplitude_max, round(sqrt(greatest(0, sum(q) / sum(k) - (sum(s) / sum(k)) ** 2)), 6) AS amplitude_std, round(min(nz / k), 6) AS link_ratio_min, round(min(s / k), 6) AS link_mean_min FROM l JOIN z USING (sample_id) GROUP BY 1""",
    "even_indices": "SELECT vec_id, CASE WHEN j = 15 THEN vec_id % 400 ELSE round_even(j * ((vec_id % 400) / 15.0::DOUBLE), 0)::BIGINT END AS place FROM embeddings, range(0, 16) AS t(j)",
    "zscore": """WITH x AS (SELECT vec_id, k::INT AS rx, j::INT AS place, embedding[32 * k + j + 1]::DOUBLE AS a FROM embeddings, range(0, 2) AS t(k), range(0, 32) AS u(j))
SELECT vec_id, rx, place, round((a - avg(a) OVER w) / greatest(stddev_pop(a) OVER w, 1e-6), 5) AS z FROM x WINDOW w AS (PARTITION BY vec_id, rx)""",
    "carrier_energy": "SELECT label AS sample_id, j::INT AS carrier, round(median(abs(embedding[j + 1]::DOUBLE)), 6) AS energy FROM embeddings, range(0, 64) AS t(j) GROUP BY 1, 2",
}
