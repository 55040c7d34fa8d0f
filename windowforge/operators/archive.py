"""Assembly of archives and releases from collections, listings and earlier indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowforge.functions.scalars import base_name, safe_path
from windowforge.operators.checks import duplicates, require_none


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one table has."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full_outer").where("_a IS NULL OR _b IS NULL")
    return both.select(key, F.when(F.col("_b").isNull(), "only_first").otherwise("only_second").alias("side"))


def reconciled_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    require_none(reconcile(a, b, key), "tables differ in their keys")
    return a.join(b, key)


def upsert_index(existing: DataFrame, new: DataFrame, key: str, order: str, new_order: str) -> DataFrame:
    """Rows of ``new`` take the place of rows of their key; unseen ones follow in their own order. Of a key's new rows the last counts.

    ``order`` and ``new_order`` are number columns; the result's ``order`` runs on.
    """
    cols = [c for c in existing.columns if c not in (key, order)]
    pack = lambda df, name: df.select(key, F.struct(*cols).alias(name), F.col(order if name == "_old" else new_order).alias(f"{name}_at"))
    late = pack(new, "_new").groupBy(key).agg(F.max_by("_new", "_new_at").alias("_new"), F.min("_new_at").alias("_new_at"))
    both = pack(existing, "_old").join(late, key, "full_outer")
    top = existing.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_top"))  # one row
    joined = both.join(top, F.lit(True))
    at = F.coalesce(F.col("_old_at"), F.col("_top") + 1 + F.col("_new_at"))
    row = F.coalesce("_new", "_old")
    return joined.select(key, at.alias(order), *[row[c].alias(c) for c in cols])


def missing_paths(df: DataFrame, listing: DataFrame, columns: list[str]) -> DataFrame:
    """(column, path) that the listing lacks."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("path")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("path IS NOT NULL").join(listing.select("path").distinct(), "path", "left_anti").select("column", "path")


def find_outputs(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """expected (sample_id, dir, name or null), listing (dir, name): the output and its status (found, missing_output, multiple_outputs)."""
    per_dir = listing.groupBy("dir").agg(F.count("*").alias("_n"), F.min("name").alias("_only"))
    named = listing.select("dir", "name", F.lit(True).alias("_there")).distinct()
    joined = expected.join(named, ["dir", "name"], "left").join(per_dir, "dir", "left")
    out = F.when(F.col("name").isNotNull(), F.when(F.col("_there"), F.col("name"))).when(F.col("_n") == 1, F.col("_only"))
    status = F.when(out.isNotNull(), "found").when(F.col("name").isNull() & (F.col("_n") > 1), "multiple_outputs").otherwise("missing_output")
    return joined.select("sample_id", out.alias("output"), status.alias("status"))


def session_lookup(df: DataFrame, sessions: DataFrame, column: str) -> DataFrame:
    """A value per session; the table has a row per session."""
    return df.join(sessions.select("session_id", column), "session_id", "left")


def overridden(df: DataFrame, overrides: DataFrame, column: str) -> DataFrame:
    """``overrides`` (session_id, value) beat ``column``; empty sessions or values are errors."""
    require_none(overrides.where("coalesce(session_id, '') = '' OR coalesce(value, '') = ''"), "malformed overrides")
    return df.join(overrides.select("session_id", F.col("value").alias("_o")), "session_id", "left").withColumn(column, F.coalesce("_o", column)).drop("_o")


def union_collections(clean: DataFrame, supplemental: DataFrame, key: str, status: str) -> DataFrame:
    require_none(clean.where(F.col(status) != "ok").select(key, status), "the clean collection has rows that aren't ok")
    both = clean.withColumn("collection", F.lit("clean")).unionByName(supplemental.withColumn("collection", F.lit("supplemental")))
    require_none(duplicates(both, key), "collections share keys")
    return both


def unique_session_map(index: DataFrame, keys: list[str], session: str, supplemental: str) -> DataFrame:
    """keys to their session, where they have exactly one besides the supplemental."""
    return index.where(F.col(session) != supplemental).groupBy(*keys).agg(F.count_distinct(session).alias("_n"), F.min(session).alias("main_session")).where("_n = 1").drop("_n")


def canonical_session(index: DataFrame, keys: list[str], session: str, supplemental: str) -> DataFrame:
    """Adds archive_session: that of the map for supplemental rows (null if there is none), else their own."""
    joined = index.join(unique_session_map(index, keys, session, supplemental), keys, "left")
    return joined.withColumn("archive_session", F.when(F.col(session) == supplemental, F.col("main_session")).otherwise(F.col(session))).drop("main_session")


def file_lists(index: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, pos, path): the files of each sample in the order of ``columns``, without nulls."""
    return index.select(key, F.posexplode(F.filter(F.array(*columns), lambda x: x.isNotNull())).alias("pos", "path"))


def write_file_lists(index: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Text lists below ``path``, one folder (list=..) each: the ids, each column's files, and all files, without nulls, in the order of the ids."""
    lists = [F.struct(F.lit("sample_ids").alias("list"), F.lit(0).alias("pos"), F.col(key).cast("string").alias("value"))]
    lists += [F.struct(F.lit(name).alias("list"), F.lit(k).alias("pos"), F.col(c).alias("value")) for k, c in enumerate(columns) for name in (c, "all")]
    rows = index.select(key, F.explode(F.array(*lists)).alias("x")).select(key, "x.*").where("value IS NOT NULL")
    rows.orderBy("list", key, "pos").select("list", "value").write.mode("overwrite").partitionBy("list").text(path)


def archive_path(kind: str, session: Column, action: Column, source: Column) -> Column:
    return F.concat_ws("/", F.lit("data"), session, F.lit(kind), action, base_name(source))


def build_archive(clean: DataFrame, supplemental: DataFrame, sizes: DataFrame, main: str = "S00") -> DataFrame:
    """The archive index of both collections (sample_id, session_id, person_id, environment_id, action_id, csi_path, video_path, status), with
    canonical sessions, archive paths and sizes from ``sizes`` (path, bytes)."""
    rows = canonical_session(union_collections(clean, supplemental, "sample_id", "status"), ["person_id", "environment_id"], "session_id", main)
    require_none(rows.where("archive_session IS NULL").select("sample_id"), "no unique session to place samples under")
    for kind in ("csi", "video"):
        rows = rows.withColumn(f"archive_{kind}_path", archive_path(kind, F.col("archive_session"), F.col("action_id"), F.col(f"{kind}_path")))
        rows = rows.join(sizes.select(F.col("path").alias(f"{kind}_path"), F.col("bytes").alias(f"{kind}_bytes")), f"{kind}_path", "left")
    return rows


def build_release(archive: DataFrame, sources: list[str], paths: list[str], root: str) -> DataFrame:
    """Without source columns, with paths under the release."""
    out = archive.drop(*sources)
    for p in paths:
        out = out.withColumn(p, F.regexp_replace(p, f"^{root}/", ""))
    return out


def anonymisation_status(plan: DataFrame, listing: DataFrame, has_model: Column) -> DataFrame:
    """plan (sample_id, source, target, probe_ok) to status, the first that holds: unsafe_path, missing_source, missing_model,
    exists_invalid or exists, planned."""
    at = lambda c, n: listing.select(F.col("path").alias(c), F.lit(True).alias(n)).distinct()
    j = plan.join(at("source", "_s"), "source", "left").join(at("target", "_t"), "target", "left")
    unsafe = ~safe_path(F.col("source")) | ~safe_path(F.col("target"))
    status = F.when(unsafe, "unsafe_path").when(F.col("_s").isNull(), "missing_source").when(~has_model, "missing_model").when(F.col("_t") & F.col("probe_ok"), "exists").when(F.col("_t"), "exists_invalid").otherwise("planned")
    return j.select("sample_id", status.alias("status"))
