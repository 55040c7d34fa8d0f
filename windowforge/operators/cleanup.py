"""Cleanup plans and their all-or-nothing application to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.functions.scalars import metadata_path, person_check, safe_path
from windowforge.operators.checks import duplicates, require_none
from windowforge.sources.publish import Conflict, commit, current, folders, publish, read_published, write_part

KINDS = ("csi", "video", "metadata")


def clean_index(index: DataFrame, removed: DataFrame, key: str = "sample_id") -> DataFrame:
    return index.join(removed.select(key).distinct(), key, "left_anti").select(*index.columns)


def removed_counts(index: DataFrame, removed: DataFrame, group: str, key: str = "sample_id") -> DataFrame:
    """(group, kept, removed)."""
    gone = removed.select(key).distinct().withColumn("_gone", F.lit(1))
    return index.join(gone, key, "left").groupBy(group).agg(F.count_if(F.col("_gone").isNull()).alias("kept"), F.count("_gone").alias("removed"))


def removed_ids(*parts: DataFrame, key: str = "sample_id") -> DataFrame:
    out = parts[0].select(key)
    for p in parts[1:]:
        out = out.unionByName(p.select(key))
    return out.distinct()


def plan_lookup(quality: DataFrame, slices: DataFrame, columns: list[str], key: str = "sample_id") -> DataFrame:
    """Columns from the slice index where it has them, else from the quality table."""
    right = slices.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = quality.join(right, key, "left")
    return joined.select(key, *[F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)).alias(c) for c in columns], *[c for c in quality.columns if c not in (key, *columns)])


def classify_moves(operations: DataFrame, listing: DataFrame, allowed: str, protected: str) -> DataFrame:
    """A row per operation and kind of file, with its status: missing_source, safety_blocked, destination_exists or would_move, the first that holds.

    operations (sample_id, csi_path, video_path, metadata_path, destination), listing (path).
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_path").alias("source")) for k in KINDS]))
    rows = operations.select("sample_id", "destination", kinds.alias("k")).select("sample_id", "destination", "k.*")
    rows = rows.withColumn("target", F.concat_ws("/", "destination", F.element_at(F.split("source", "/"), -1)))
    there = lambda c, name: listing.select(F.col("path").alias(c), F.lit(True).alias(name)).distinct()
    rows = rows.join(there("source", "has_source"), "source", "left").join(there("target", "has_target"), "target", "left")
    empty = F.col("source").isNull() | (F.col("source") == "")
    unsafe = ~safe_path(F.col("source"), allowed, protected) | ~safe_path(F.col("target"))
    status = F.when(empty, "missing_source").when(unsafe, "safety_blocked").when(F.col("has_source").isNull(), "missing_source").when(F.col("has_target"), "destination_exists").otherwise("would_move")
    return rows.select("sample_id", "kind", "source", "target", status.alias("status"))


def preflight(moves: DataFrame) -> DataFrame:
    """One row: counts by status and whether the plan may run."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = moves.agg(n("would_move").alias("would_move"), n("safety_blocked").alias("blocked"), n("missing_source").alias("missing"), n("destination_exists").alias("existing"))
    return out.withColumn("ok", (F.col("blocked") + F.col("missing") + F.col("existing")) == 0)


def cleanup_plan(quality: DataFrame, slices: DataFrame, persons: DataFrame, held_out: Column, quarantine: str, hold: str, replacement: Column | None = None) -> DataFrame:
    """Operations: every sample that isn't ok goes to quarantine, samples of the named cohort to the holdout; the first reason counts.

    quality (sample_id, session_id, person_id, csi_path, video_path, final_status), persons (session_id, expected_person).
    """
    looked = plan_lookup(quality, slices, ["csi_path", "video_path"])
    picked = looked.where((F.col("final_status") != "ok") | held_out).withColumn("operation", F.when(held_out, "holdout").otherwise("quarantine"))
    known = persons.withColumn("_known", F.lit(True))  # one row per session
    joined = picked.join(known, "session_id", "left")
    check = person_check(F.coalesce("_known", F.lit(False)), F.col("expected_person"), F.col("person_id"))
    where = F.concat_ws("/", F.when(F.col("operation") == "holdout", F.lit(hold)).otherwise(F.lit(quarantine)), "session_id")
    hint = replacement if replacement is not None else F.lit(None).cast("string")
    return joined.select("sample_id", "session_id", "operation", "csi_path", "video_path", metadata_path(F.col("csi_path")).alias("metadata_path"), where.alias("destination"), check.alias("person_check"), hint.alias("replacement"))


def apply_plan(index: DataFrame, operations: DataFrame, moves: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """New index and log. Unless every move may run, the index stays as it is and moves that could have run say preflight_aborted; a dry run logs what it would do."""
    require_none(duplicates(operations, "sample_id"), "operations name a sample twice")
    if dry_run:
        return index, moves.withColumn("result", F.col("status"))
    if not preflight(moves).first()["ok"]:  # one row
        return index, moves.withColumn("result", F.when(F.col("status") == "would_move", "preflight_aborted").otherwise(F.col("status")))
    return clean_index(index, operations), moves.withColumn("result", F.lit("moved"))


def apply_published(spark: SparkSession, path: str, operations: DataFrame, moves: DataFrame, stamp: str, dry_run: bool = False) -> DataFrame:
    """A plan applied to the index published at ``path``/index; returns its rows of the log.

    If the plan may run, the rows of all sessions that it touches are published at ``path``/snapshots/``stamp``, then the index without the removed samples;
    the log at ``path``/log gets its moves in any case. The index changes in one step or not at all: a failure before leaves the old version,
    another change of it in the meantime is a ``Conflict``. Applied again, a plan removes nothing more.
    """
    base = current(spark, f"{path}/index")
    index = read_published(spark, f"{path}/index", base)
    kept, log = apply_plan(index, operations, moves, dry_run)
    if kept is not index:
        publish(snapshot(index, operations, stamp), f"{path}/snapshots/{stamp}")
        publish(kept, f"{path}/index", base)
    log, at = log.withColumn("stamp", F.lit(stamp)), f"{path}/log"
    part = write_part(log, at)
    while True:
        before = current(spark, at)
        try:
            commit(spark, at, before, [*folders(spark, at, before), part], log.schema)
            return log
        except Conflict:  # another plan's rows came first; these follow
            continue


def snapshot(index: DataFrame, operations: DataFrame, stamp: str) -> DataFrame:
    """The rows of all sessions that a plan touches, with the name of the snapshot."""
    return index.join(operations.select("session_id").distinct(), "session_id", "left_semi").withColumn("snapshot", F.lit(stamp))


def verify_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, expected, actual, verdict) of two tables (name, n)."""
    both = expected.select("name", F.col("n").alias("expected")).join(actual.select("name", F.col("n").alias("actual")), "name", "full_outer")
    return both.withColumn("verdict", F.when(F.col("expected").eqNullSafe(F.col("actual")), "OK").otherwise("MISMATCH"))


def leaks(index: DataFrame, removed: DataFrame, key: str = "sample_id") -> DataFrame:
    return index.join(removed.select(key).distinct(), key, "left_semi")
