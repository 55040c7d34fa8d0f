"""Choice of samples, and dataset splits that leak nothing: stratified by a seeded hash order, or by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windowforge.operators.checks import duplicates

PARTS = ("train", "val", "test")


def human_samples(samples: DataFrame, actions: list[str] | None = None) -> DataFrame:
    kept = samples.where(F.coalesce(F.col("person_id"), F.lit("NONE")) != "NONE")
    return kept.where(F.col("action_id").isin(actions)) if actions else kept


def first_per_action(rows: DataFrame, action: str, order: str, preferred: list[str], least: int = 3, avoid: str = "background_idle") -> DataFrame:
    """The first row of each preferred action, in the order of preference; if those are fewer than ``least``, filled up with the first other rows
    whose action isn't ``avoid``. Adds place, from 1."""
    rank = F.array_position(F.array(*map(F.lit, preferred)), F.col(action))
    firsts = rows.where(F.col(action).isin(preferred)).groupBy(action).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    firsts = firsts.withColumn("_rank", rank)  # no more rows than preferred actions
    others = rows.join(firsts.select(order), order, "left_anti").where(F.coalesce(F.col(action) != avoid, F.lit(True)))
    fill = others.orderBy(order).limit(least).withColumn("_rank", F.lit(len(preferred) + 1).cast("long"))
    place = F.row_number().over(Window.orderBy("_rank", order))
    return firsts.unionByName(fill).withColumn("place", place).where((F.col("_rank") <= len(preferred)) | (F.col("place") <= least)).drop("_rank")


def select_samples(
    rows: DataFrame, order: str, ids: list[str] | None = None, sessions: list[str] | None = None, actions: list[str] | None = None,
    include_warn: bool = False, full: bool = False, limit: int | None = None, preferred: list[str] | None = None,
) -> DataFrame:
    """Rows (sample_id, session_id, action_id, quality_flags, ..) that fit what is asked for, in the order of ``order``; unless all (``full``) or
    named ones are wanted, a preview (``first_per_action``). ``limit`` is 3 unless ``full`` or given."""
    for column, wanted in (("sample_id", ids), ("session_id", sessions), ("action_id", actions)):
        if wanted:
            rows = rows.where(F.col(column).isin(wanted))
    if not include_warn:
        rows = rows.where(F.col("quality_flags") == "ok")
    limit = 3 if limit is None and not full else limit
    if not full and not ids:
        return first_per_action(rows, "action_id", order, preferred or []).where(F.col("place") <= limit).drop("place")
    return rows.orderBy(order).limit(limit) if limit is not None else rows


def complement(all_rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    return all_rows.join(some.select(key).distinct(), key, "left_anti")


#: Hexadecimal digits of a row's hash by which a stratum is counted before anything of it is sorted.
PREFIX = 4


def stratified_split(samples: DataFrame, strata: list[str], key: str, seeds: list[int], train: float = 0.65) -> DataFrame:
    """Adds seed and split: within a stratum, in the order of md5(seed|key), round(train * n) rows (half to even) go to train, half of
    the rest (rounded down) to val, the others to test. All seeds are rows of one job.

    Counts by prefixes of the hash tell on which side of both cuts a prefix lies; only the rows of prefixes that a cut falls into are ranked, each prefix by
    itself, so a stratum of all rows is many tasks.
    """
    rows = samples.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("_hash", F.md5(F.concat_ws("|", "seed", key).cast("binary"))).withColumn("_prefix", F.left("_hash", F.lit(PREFIX)))
    group = ["seed", *strata]
    whole = Window.partitionBy(*group)
    sums = rows.groupBy(*group, "_prefix").agg(F.count("*").alias("_in")).withColumn("_n", F.sum("_in").over(whole)).withColumn("_upto", F.sum("_in").over(whole.orderBy("_prefix")))
    first = F.rint(F.col("_n") * train).cast("long")
    sums = sums.withColumn("_a", first).withColumn("_b", first + F.floor((F.col("_n") - first) / 2)).withColumn("_before", F.col("_upto") - F.col("_in"))
    side = lambda lo, hi: F.when(hi <= F.col("_a"), "train").when((lo >= F.col("_a")) & (hi <= F.col("_b")), "val").when(lo >= F.col("_b"), "test")
    sums = sums.select(*[F.col(c).alias(f"_{c}_") for c in group], F.col("_prefix").alias("_of"), "_a", "_b", "_before", side(F.col("_before"), F.col("_upto")).alias("split"))
    met = F.col("_prefix") == F.col("_of")
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    placed = rows.join(sums, met)
    cut = placed.where("split IS NULL")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_prefix").orderBy("_hash", key))
    cut = cut.withColumn("split", side(rank - 1, rank))
    cols = [*samples.columns, "seed", "split"]
    return placed.where("split IS NOT NULL").select(*cols).unionByName(cut.select(*cols))


def split_summary(assigned: DataFrame) -> DataFrame:
    """seed, split, n, ratio."""
    counts = assigned.groupBy("seed", "split").agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy("seed")))


def split_violations(assigned: DataFrame, samples: DataFrame, strata: list[str], key: str) -> DataFrame:
    """(seed, problem, detail): duplicates, unknown and missing samples, empty parts, strata that a part lacks."""
    seeds = assigned.select("seed").distinct()
    parts = seeds.withColumn("split", F.explode(F.array(*map(F.lit, PARTS))))
    detail = F.concat_ws("/", *strata)
    twice = duplicates(assigned, "seed", key).select("seed", F.lit("duplicate").alias("problem"), F.col(key).cast("string").alias("detail"))
    unknown = assigned.join(samples.select(key).distinct(), key, "left_anti").select("seed", F.lit("unknown").alias("problem"), F.col(key).cast("string").alias("detail"))
    has = assigned.groupBy(key).agg(F.collect_set("seed").alias("has"))
    every = seeds.agg(F.collect_set("seed").alias("every"))  # one row: a seed is a run's parameter
    lack = samples.select(key).distinct().join(has, key, "left").join(every, F.lit(True)).select(key, F.explode(F.array_except("every", F.coalesce("has", F.array().cast(every.schema["every"].dataType)))).alias("seed"))
    missing = lack.select("seed", F.lit("missing").alias("problem"), F.col(key).cast("string").alias("detail"))
    empty = parts.join(assigned.select("seed", "split").distinct(), ["seed", "split"], "left_anti").select("seed", F.lit("empty_part").alias("problem"), F.col("split").alias("detail"))
    wanted = parts.join(samples.select(*strata).distinct(), F.lit(True))  # parts of seeds and strata, all of them wanted
    lacking = wanted.join(assigned.select("seed", "split", *strata).distinct(), ["seed", "split", *strata], "left_anti")
    lacking = lacking.select("seed", F.lit("stratum_missing").alias("problem"), F.concat_ws(":", "split", detail).alias("detail"))
    return twice.unionByName(unknown).unionByName(missing).unionByName(empty).unionByName(lacking)


def loso_pairs(samples: DataFrame, person: str) -> DataFrame:
    """(test_person, val_person): the next person in order validates, the last wraps to the first. The distinct persons are a small table."""
    people = samples.select(F.col(person).alias("test_person")).distinct()
    w = Window.orderBy("test_person")
    first = F.min("test_person").over(Window.partitionBy())
    return people.select("test_person", F.coalesce(F.lead("test_person").over(w), first).alias("val_person"))


def subject_folds(samples: DataFrame, pairs: DataFrame, person: str) -> DataFrame:
    """Every fold with every sample's split; ``pairs`` has a row per person."""
    split = F.when(F.col(person) == F.col("test_person"), "test").when(F.col(person) == F.col("val_person"), "val").otherwise("train")
    return samples.join(pairs, F.lit(True)).withColumn("split", split)  # the folds hold every sample


def compare_assignments(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing on one side, or another seed or split."""
    left = a.select(key, F.col("seed").alias("seed_a"), F.col("split").alias("split_a"))
    right = b.select(key, F.col("seed").alias("seed_b"), F.col("split").alias("split_b"))
    both = left.join(right, key, "full_outer")
    problem = F.when(F.col("split_b").isNull(), "missing").when(F.col("split_a").isNull(), "extra").when(~F.col("seed_a").eqNullSafe(F.col("seed_b")), "seed").when(F.col("split_a") != F.col("split_b"), "split")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def run_matrix(architectures: DataFrame, protocols: DataFrame, done: DataFrame) -> DataFrame:
    """All (arch, protocol, unit) still to run; the inputs are lists of configurations."""
    return architectures.join(protocols, F.lit(True)).join(done, ["arch", "protocol", "unit"], "left_anti")
