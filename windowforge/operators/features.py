"""Fixed-shape features: amplitudes, repaired carriers, even resampling, z-scores, and a cache of what has been built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowforge.functions.scalars import amplitudes, even_indices
from windowforge.operators.profile import quantiles
from windowforge.sources.publish import Conflict, commit, current, folders, read_parts, read_published, write_part
from windowforge.sources.scratch import staged

#: Energy up to which a carrier counts as silent, and the least deviation that z-scores are divided by.
SILENT, LEAST_DEVIATION = 1e-6, 1e-6
#: Columns of features and their types.
FEATURES = {"sample_id": "string", "rx": "int", "t": "int", "values": "array<float>", "problem": "string"}


def carrier_energy(rows: DataFrame, group: str, values: str) -> DataFrame:
    """(group, carrier, energy): the median over rows of each place of an array. Values are counted, then ranked; no task holds a group."""
    places = rows.select(group, F.posexplode(values).alias("carrier", "v"))
    return quantiles(places, "v", [0.5], group, "carrier").select(group, "carrier", F.col("q")[0].alias("energy"))


def repair_plan(energy: DataFrame, group: str, ratio: float = 0.05) -> DataFrame:
    """Adds valid, here (its own carrier and energy), left, right (those of the valid carriers it is to be drawn from), weight and problem to (group, carrier, energy).

    A carrier is valid that isn't silent and has at least ``ratio`` of the median energy of those that aren't; if fewer than two are, all that
    aren't silent. ``right`` is the next valid carrier, ``left`` the valid one before that; beyond the last, the last two, so that
    their line goes on; before the first, twice the first. A group without any sound, or with one such carrier, has a problem.
    """
    sounds, whole = F.col("energy") > SILENT, Window.partitionBy(group)
    typical = energy.where(sounds).groupBy(group).agg(F.median("energy").alias("_typical"))  # as many values as carriers
    judged = energy.join(typical, group, "left").withColumn("_strong", F.coalesce(sounds & (F.col("energy") >= ratio * F.col("_typical")), F.lit(False)))
    judged = judged.withColumn("valid", F.when(F.count_if("_strong").over(whole) >= 2, F.col("_strong")).otherwise(F.coalesce(sounds, F.lit(False))))
    n = F.count_if("valid").over(whole)
    judged = judged.withColumn("problem", F.when(n == 0, "no_energy").when(n == 1, "one_usable_carrier"))
    by, here = whole.orderBy("carrier"), F.struct(F.col("carrier").alias("at"), F.col("energy"))
    before = F.last(F.when(F.col("valid"), here), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    pair = judged.withColumn("here", here).withColumn("_pair", F.when(F.col("valid"), F.struct(F.col("here").alias("right"), before.alias("left"))))
    following = F.first("_pair", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    met = pair.withColumn("_met", F.coalesce(following, F.last("_pair", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    right, left = F.col("_met.right"), F.coalesce("_met.left", "_met.right")
    span = right["at"] - left["at"]
    weight = F.when(span > 0, (F.col("carrier") - left["at"]) / span).otherwise(0.0)
    return met.select(group, "carrier", "energy", "valid", "here", left.alias("left"), right.alias("right"), weight.alias("weight"), "problem")


def _drawn(of: Callable[[Column], Column], x: Column) -> Column:
    """The value of a carrier of a plan, where ``of`` gives those of its neighbours."""
    return F.when(x["valid"], of(x["here"])).otherwise(of(x["left"]) * (1 - x["weight"]) + of(x["right"]) * x["weight"])


def repaired_energy(energy: DataFrame, group: str, ratio: float = 0.05) -> DataFrame:
    """(group, carrier, energy, repaired, valid, problem) of a table (group, carrier, energy); with a problem, nothing is repaired."""
    plan = repair_plan(energy, group, ratio).withColumn("x", F.struct("valid", "here", "left", "right", "weight"))
    return plan.select(group, "carrier", "energy", F.when(F.col("problem").isNull(), _drawn(lambda c: c["energy"], F.col("x"))).alias("repaired"), "valid", "problem")


def _plans(plan: DataFrame, group: str, slots: DataFrame) -> DataFrame:
    """(group, take, problem): for the slots (group, slot, carrier), in order, where their values come from."""
    return (
        plan.join(slots, [group, "carrier"])
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("slot", "valid", "here", "left", "right", "weight"))).alias("take"), F.max("problem").alias("problem"))
    )


def _taken(values: Column, take: Column) -> Column:
    return F.transform(take, lambda x: _drawn(lambda c: F.get(values, c["at"]), x))


def repair_carriers(rows: DataFrame, group: str, values: str, ratio: float = 0.05) -> DataFrame:
    """``rows`` with weak places of their array column replaced, as the energies of their group decide (``repair_plan``), and ``problem``."""
    plan = repair_plan(carrier_energy(rows, group, values), group, ratio)
    plans = _plans(plan, group, plan.select(group, "carrier", F.col("carrier").alias("slot")))
    return rows.join(plans, group).withColumn(values, F.when(F.col("problem").isNull(), _taken(F.col(values), F.col("take"))).otherwise(F.col(values))).drop("take")


def preprocess(packets: DataFrame, n_time: int, n_freq: int, ratio: float = 0.05) -> DataFrame:
    """packets (sample_id, packet_idx, num_rx, num_tx, num_subcarriers, iq) to sample_id, rx, t, values (array<float>), problem.

    log(1 + amplitude), repair of weak carriers, even choice of packets and carriers, population z-score per receiver in double
    precision. Samples that can't be used have one row with their problem: several_transmitters, empty_dimension, no_energy, one_usable_carrier or not_finite.
    """
    dims = ("num_rx", "num_tx", "num_subcarriers")
    shape = packets.groupBy("sample_id").agg(F.count("*").alias("n"), *[F.coalesce(F.max(c), F.lit(0)).cast("int").alias(c) for c in dims])
    empty = F.least(*dims) <= 0
    shape = shape.withColumn("problem", F.when(empty, "empty_dimension").when(F.col("num_tx") > 1, "several_transmitters"))
    fit = shape.where("problem IS NULL").drop("problem")
    placed = packets.select("sample_id", "iq", (F.row_number().over(Window.partitionBy("sample_id").orderBy("packet_idx")) - 1).cast("long").alias("place")).join(fit, "sample_id")
    level = F.transform(amplitudes(F.col("iq")), lambda a: F.log1p(a))
    level = placed.select("sample_id", "place", "num_rx", "num_subcarriers", level.alias("level"))
    level = staged(level)  # read for the energies of all packets and for the values of those chosen
    by_rx = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("num_rx") - 1), lambda r: F.slice("level", r * F.col("num_subcarriers") + 1, F.col("num_subcarriers")))).alias("rx", "level")
    plan = staged(repair_plan(carrier_energy(level.select("sample_id", by_rx), "sample_id", "level"), "sample_id", ratio))
    slots = fit.select("sample_id", F.posexplode(even_indices(F.col("num_subcarriers"), n_freq)).alias("slot", "carrier"))
    plans = _plans(plan, "sample_id", slots)
    times = fit.select("sample_id", F.posexplode(even_indices(F.col("n"), n_time)).alias("t", "place"))
    chosen = level.join(times, ["sample_id", "place"]).select("sample_id", "t", by_rx).join(plans.where("problem IS NULL").drop("problem"), "sample_id")
    chosen = chosen.select("sample_id", "rx", "t", _taken(F.col("level"), F.col("take")).alias("x"))
    each, total = Window.partitionBy("sample_id", "rx"), lambda f: F.aggregate("x", F.lit(0.0), lambda a, x: a + f(x))
    size = F.sum(F.size("x")).over(each)
    centred = chosen.withColumn("mean", F.sum(total(lambda x: x)).over(each) / size).withColumn("x", F.transform("x", lambda x: x - F.col("mean")))
    spread = centred.withColumn("std", F.greatest(F.sqrt(F.sum(total(lambda x: x * x)).over(each) / size), F.lit(LEAST_DEVIATION)))
    scored = spread.select("sample_id", "rx", "t", F.transform("x", lambda x: (x / F.col("std")).cast("float")).alias("values"))
    odd = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scored = scored.withColumn("bad", F.max(odd).over(Window.partitionBy("sample_id")))
    wrong = shape.select("sample_id", "problem").unionByName(plans.select("sample_id", "problem")).unionByName(scored.where("bad").select("sample_id", F.lit("not_finite").alias("problem")).distinct())
    none = wrong.where("problem IS NOT NULL").select("sample_id", F.lit(None).cast("int").alias("rx"), F.lit(None).cast("int").alias("t"), F.lit(None).cast("array<float>").alias("values"), "problem")
    return scored.where("NOT bad").select("sample_id", "rx", "t", "values", F.lit(None).cast("string").alias("problem")).unionByName(none)


def build_feature_cache(
    samples: DataFrame, packets: DataFrame, path: str, signature: str, expected: str | None = None, build: Callable[[DataFrame], DataFrame] | None = None,
    shape: tuple[int, int] | None = None, overwrite: bool = False,
) -> DataFrame:
    """Features of the samples that the cache at ``path`` lacks under a signature are built and published; returns a report.

    samples (sample_id, session_id[, ``expected`` packets]). Report: sample_id, session_id, status (cached, built or the problem). A sample whose packets differ in
    number from what is expected isn't built; the others go on. ``build`` takes packets and returns the columns of ``preprocess``; other columns
    or types are an error. With ``shape`` (rows of a sample, values of a row), a sample of another shape or with values that are null or not finite isn't cached.
    ``overwrite``: all samples are built, and what was there goes when they are. A build that fails changes nothing; of builds at the same time, each adds what
    the cache still lacks when it is done.
    """
    spark, root = samples.sparkSession, f"{path}/signature={signature}"
    base = current(spark, root)
    have = read_published(spark, root, base).select("sample_id").distinct() if base and not overwrite else spark.createDataFrame([], "sample_id string")
    todo = samples.join(have, "sample_id", "left_anti")
    counts = packets.groupBy("sample_id").agg(F.count("*").alias("_n"))
    todo = todo.join(counts, "sample_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    wrong = F.when(F.col("_n") == 0, "no_packets")
    if expected:
        wrong = wrong.when(F.col("_n") != F.col(expected), "packet_count_mismatch")
    todo = todo.withColumn("_problem", wrong)
    fit = todo.where("_problem IS NULL").select("sample_id", "session_id")
    decoded = (build or (lambda p: preprocess(p, 8, 8)))(packets.join(fit.select("sample_id"), "sample_id", "left_semi"))
    if sorted(decoded.dtypes) != sorted(FEATURES.items()):
        raise ValueError(f"features need {FEATURES}, not {dict(decoded.dtypes)}")
    if shape:
        odd = F.coalesce((F.size("values") != shape[1]) | F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        whole = Window.partitionBy("sample_id")
        decoded = decoded.withColumn("problem", F.coalesce("problem", F.when((F.count("*").over(whole) != shape[0]) | F.max(odd).over(whole), "wrong_shape")))
    built = decoded.join(fit, "sample_id").where("problem IS NULL")
    own = write_part(built, root, "session_id")
    while True:
        try:
            version = commit(spark, root, base, [*([] if overwrite else folders(spark, root, base)), own], built.schema)
            break
        except Conflict:
            base = current(spark, root)
            if not overwrite:  # what another build has added in the meantime stays as it is
                rows = read_parts(spark, root, [own], built.schema)
                own = write_part(rows.join(read_published(spark, root, base).select("sample_id").distinct(), "sample_id", "left_anti"), root, "session_id")
    now = read_published(spark, root, version).select("sample_id").distinct().withColumn("_built", F.lit(True))
    listed = samples.select("sample_id", "session_id").join(have.withColumn("_had", F.lit(True)), "sample_id", "left").join(todo.select("sample_id", "_problem"), "sample_id", "left").join(now, "sample_id", "left")
    return listed.select("sample_id", "session_id", F.when(F.col("_had"), "cached").otherwise(F.coalesce("_problem", F.when(F.col("_built"), "built").otherwise("failed"))).alias("status"))


def cached_features(spark, path: str, signature: str) -> DataFrame:
    """What the cache holds under a signature."""
    return read_published(spark, f"{path}/signature={signature}")


def cache_report(report: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """One row: requested, completed, failed, whether complete, failed_ids (joined by ``;``, in order); with the cache's rows also its bytes."""
    ok = F.col("status").isin("cached", "built")
    out = report.agg(F.count("*").alias("requested"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), (F.count_if(~ok) == 0).alias("complete"), F.concat_ws(";", F.array_sort(F.collect_list(F.when(~ok, F.col("sample_id"))))).alias("failed_ids"))
    if cached is None:
        return out
    files = cached.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    return out.join(files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), F.lit(True))  # one row each
