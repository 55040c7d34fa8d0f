"""Counts, distributions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe_nearest_rank(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, min, max, p50, p95, where a quantile is the value at round((n - 1) p), half to even. Equal values are one row before
    they are ranked, so a frequent value is no bottleneck."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group)
    upto = F.sum("k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto).withColumn("_n", F.sum("k").over(w))
    at = lambda p: F.min(F.when(F.col("_upto") > F.rint((F.col("_n") - 1) * p), F.col(value)))
    return ranked.groupBy(group).agg(F.max("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), at(0.5).alias("p50"), at(0.95).alias("p95"))


#: Size of the sketch that a group's quantiles are looked up in, how far from a rank it is cut on both sides, and cuts on each side.
SKETCH, NEAR, CUTS = 4096, 0.004, 4


def _met(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner") -> DataFrame:
    """A join by equal or both null keys (left name to right name); without keys, with a table of one row."""
    on = F.lit(True)
    for mine, other in keys.items():
        on = on & left[mine].eqNullSafe(right[other])
    return left.join(right, on, how).drop(*keys.values())


def quantiles(df: DataFrame, value: str, shares: list[float], *group: str) -> DataFrame:
    """group, n and q: the exact quantiles of a number at these shares, by a line between neighbours.

    A sketch of each group, merged from those of the tasks, gives values just below and above each rank; they cut the group into cells. Equal values are
    counted, the counts of the cells tell in which of them the ranks lie, and only those are sorted, each on its own. Where the sketch cuts decides how
    large the cells are, not what comes out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    wanted_at = sorted({min(1.0, max(0.0, p + NEAR * k / CUTS)) for p in shares for k in range(-CUTS, CUTS + 1)})
    sketches = rows.groupBy(*group).agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_s"))
    known = F.kll_sketch_get_quantile_double("_s", F.array(*map(F.lit, wanted_at)))
    cuts = sketches.select(*[F.col(k).alias(f"_{k}") for k in group], F.array_sort(F.array_distinct(F.when(F.kll_sketch_get_n_double("_s") > 0, known))).alias("_cuts"))
    counts = _met(rows.groupBy(*group, "_v").agg(F.count("*").alias("_k")), cuts, {k: f"_{k}" for k in group}, "left")
    counts = counts.withColumn("_range", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col("_v")))).drop("_cuts")
    whole = Window.partitionBy(*group)
    per = counts.groupBy(*group, "_range").agg(F.sum("_k").alias("_in"))  # a few rows for a group
    per = per.withColumn("n", F.sum("_in").over(whole)).withColumn("_upto", F.sum("_in").over(whole.orderBy("_range")))
    place = {p: (F.col("n") - 1) * F.lit(float(p)) for p in shares}
    ranks = F.array(*[f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)])
    wanted = per.where(F.exists(ranks, lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_in"))))
    wanted = wanted.select(*[F.col(k).alias(f"_{k}") for k in group], F.col("_range").alias("_of"), "n", (F.col("_upto") - F.col("_in")).alias("_before"))
    seen = F.col("_before") + F.sum("_k").over(Window.partitionBy(*group, "_range").orderBy("_v"))
    ranked = _met(counts, wanted, {**{k: f"_{k}" for k in group}, "_range": "_of"}).withColumn("_seen", seen)
    at = lambda r: F.min(F.when(F.col("_seen") > r, F.col("_v")))
    ends = ranked.groupBy(*group).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[at(f(x)).alias(f"_{i}_{f.__name__}") for i, x in enumerate(place.values()) for f in (F.floor, F.ceil)])
    line = [F.col(f"_{i}_floor") + (F.col(f"_{i}_ceil") - F.col(f"_{i}_floor")) * (x - F.floor(x)) for i, x in enumerate(place.values())]
    return ends.select(*group, "n", F.array(*line).alias("q"))


def describe_linear(df: DataFrame, value: str, target: float, *group: str) -> DataFrame:
    """n, min, p50, p95, max, mean, std of the population, and the mean's distance from a target, absolute and in percent."""
    v = F.col(value)
    out = df.groupBy(*group).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    q = quantiles(df, value, [0.5, 0.95], *group).select(*[F.col(k).alias(f"_{k}") for k in group], F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))
    out = _met(out, q, {k: f"_{k}" for k in group}, "left")
    return out.withColumn("delta", F.col("mean") - target).withColumn("delta_percent", (F.col("mean") - target) / target * 100)


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    """(flag, n) of a column of ``;``-joined flags; ``ok`` counts as itself."""
    return df.select(F.explode(F.split(flags, ";")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """(key, value, n) for every key, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    return df.select(pairs.alias("p")).groupBy("p.key", "p.value").agg(F.count("*").alias("n"))


def most_common(counts: DataFrame, key: str, k: int | None = None) -> DataFrame:
    out = counts.orderBy(F.desc("n"), key)
    return out.limit(k) if k else out


def warning_sample(df: DataFrame, status: str, order: str, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first k rows that aren't ok, and how many were left out."""
    bad = df.where(F.col(status) != "ok")
    return bad.orderBy(order).limit(k), bad.agg(F.greatest(F.lit(0), F.count("*") - k).alias("omitted"))


def status_summary(df: DataFrame, status: str, known: list[str]) -> DataFrame:
    """(status, n) over a fixed list, zeros included, and a total."""
    names = df.sparkSession.createDataFrame([(s,) for s in known], "status string")
    counts = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    listed = names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return listed.unionByName(df.select(F.lit("total").alias("status")).groupBy("status").agg(F.count("*").alias("n")))


def size_totals(df: DataFrame, kind: str, size: Column) -> DataFrame:
    return df.groupBy(kind).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).withColumn("mib", F.round(F.col("bytes") / (1 << 20), 2))


def integrity_totals(df: DataFrame, counts: list[str], flags: dict[str, Column]) -> DataFrame:
    """One row: sums of counters and numbers of rows with a flag."""
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], *[F.count_if(x).alias(n) for n, x in flags.items()])


def dataset_profile(df: DataFrame, label: str, value: str, background: Column) -> DataFrame:
    """One row: samples, background, classes, quantiles of a value and the ratio of the largest to the smallest class, from counts per class."""
    per = df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(background).alias("b"))
    shape = per.agg(F.sum("n").alias("samples"), F.sum("b").alias("background"), F.count("*").alias("classes"), (F.max("n") / F.min("n")).alias("imbalance"))
    q = quantiles(df.where(~background), value, [0.0, 0.5, 1.0]).select(F.col("q")[0].alias("least"), F.col("q")[1].alias("median"), F.col("q")[2].alias("most"))
    return shape.join(q, F.lit(True), "left")  # one row each


def summary_table(parts: dict[str, DataFrame], key: str = "key", value: str = "value") -> DataFrame:
    """(section, key, value) of several small tables."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
