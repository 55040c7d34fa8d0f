"""Quality screening: payload statistics, review rules and the flags that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowforge.functions.scalars import clip_rule, final_status, flag_list, flagged, rate_flag, trial_number, trial_prefix


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: that with the greatest ``order``."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def match_review_rules(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """(sample_id, rule_id) for every rule (rule_id, clip_expr) that a sample meets.

    Exact names and trial ranges meet by equality of the name or its prefix; wildcard prefixes by equality with the start of the name, once
    for each length that they have.
    """
    r = rules.select("rule_id", clip_rule(F.col("clip_expr")).alias("r")).select("rule_id", "r.*")
    s = samples.select("sample_id", trial_prefix(F.col("sample_id")).alias("prefix"), trial_number(F.col("sample_id")).alias("trial"))
    exact = s.join(r.where("kind = 'exact'").select("rule_id", F.col("exact").alias("sample_id")), "sample_id").select("sample_id", "rule_id")
    ranged = r.where("kind IN ('from', 'range')").select("rule_id", "prefix", "low", F.coalesce("high", F.lit(1 << 30)).alias("high"))
    ranged = s.join(ranged, "prefix").where("trial BETWEEN low AND high").select("sample_id", "rule_id")
    wild = r.where("kind = 'prefix'").select("rule_id", F.col("prefix").alias("start"), F.length("prefix").alias("size"))
    sizes = wild.agg(F.collect_set("size").alias("sizes"))  # one row; no more entries than a name has characters are of use
    starts = s.select("sample_id").join(sizes, F.lit(True)).withColumn("size", F.explode("sizes")).where(F.length("sample_id") >= F.col("size"))
    wild = starts.withColumn("start", F.expr("left(sample_id, size)")).join(wild, ["size", "start"]).select("sample_id", "rule_id")
    return exact.unionByName(ranged).unionByName(wild)


def unmatched_rules(rules: DataFrame, matches: DataFrame, held: list[str] | None = None) -> DataFrame:
    """Rules that no sample meets, without the held-out expressions."""
    left = rules.join(matches.select("rule_id").distinct(), "rule_id", "left_anti")
    return left.where(~F.col("clip_expr").isin(held)) if held else left


def collect_labels(matches: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """Per sample: sorted distinct values of the rules' columns joined by ``;`` and the number of rules."""
    joined = matches.join(rules, "rule_id")
    return joined.groupBy("sample_id").agg(*[F.array_join(F.array_sort(F.collect_set(c)), ";").alias(c) for c in columns], F.countDistinct("rule_id").alias("n_rules"))


def first_valid_packets(packets: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("sample_id").orderBy("packet_idx")
    return packets.where("problem IS NULL").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def packet_summary(packets: DataFrame) -> DataFrame:
    """sample_id, packets, bad, rx_values, tx_values, subcarrier_values (of all whole records, ascending, joined by ``;``) and parse_status of rows of packets:
    empty, error if no packet is valid, warn if some are not, else ok."""
    p, listed = F.col("problem"), lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ";")
    bad = F.count_if(p.isNotNull() & (p != "no_packets"))
    out = packets.groupBy("sample_id").agg(
        F.count_if(p.isNull()).alias("packets"), bad.alias("bad"), listed("num_rx").alias("rx_values"), listed("num_tx").alias("tx_values"),
        listed("num_subcarriers").alias("subcarrier_values"), F.max(F.coalesce(p == "no_packets", F.lit(False))).alias("_empty"),
    )
    return out.withColumn("parse_status", F.when(F.col("_empty"), "empty").when(F.col("packets") == 0, "error").when(F.col("bad") > 0, "warn").otherwise("ok")).drop("_empty")


def payload_stats(links: DataFrame) -> DataFrame:
    """Statistics per sample of packets' amplitudes: ``links`` (sample_id, link, amplitude array<double>), a row per packet and link.

    Sums per link and sample are associative, so they are formed before the shuffle.
    """
    a = F.col("amplitude")
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    rows = links.select("sample_id", "link", F.size(a).alias("k"), F.size(F.filter(a, lambda v: v != 0)).alias("nz"), add(a).alias("s"), add(F.transform(a, lambda v: v * v)).alias("q"), F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
    per_link = rows.groupBy("sample_id", "link").agg(*[F.sum(c).alias(c) for c in ("k", "nz", "s", "q")], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("packets"), F.count_if(F.col("nz") == 0).alias("zero_packets"))
    per_link = per_link.withColumn("ratio", F.col("nz") / F.col("k"))
    total = per_link.groupBy("sample_id").agg(
        F.max("packets").alias("packets"), F.sum("zero_packets").alias("zero_packets"), (F.sum("nz") / F.sum("k")).alias("nonzero_ratio"),
        F.min("lo").alias("amplitude_min"), (F.sum("s") / F.sum("k")).alias("amplitude_mean"), F.max("hi").alias("amplitude_max"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("k") - (F.sum("s") / F.sum("k")) * (F.sum("s") / F.sum("k")))).alias("amplitude_std"),
        F.count_if(F.col("ratio") == 0).alias("dead_links"), F.min("ratio").alias("link_ratio_min"), F.min(F.col("s") / F.col("k")).alias("link_mean_min"),
    )
    return total


def _set_and_not_ok(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "") & (F.col(c) != "ok")


def quality_flags() -> Column:
    """The flags of a joined quality row; see ``quality_table`` for its columns."""
    c = F.col
    known = lambda x: F.coalesce(x, F.lit(False))
    has_packets = known(c("packets") > 0)
    has_file = c("size").isNotNull()
    return flag_list(
        flagged(c("has_sync").isNull(), "missing_sync_index_row"),
        flagged(_set_and_not_ok("sync_status"), "sync_status_not_ok"),
        flagged(_set_and_not_ok("slice_status"), "slice_status_not_ok"),
        flagged(_set_and_not_ok("sync_flags"), "sync_quality_warning"),
        flagged(~has_file, "missing_csi_slice_file"),
        flagged(known(c("size") == 0), "empty_csi_slice_file"),
        flagged(has_file & ~has_packets, "no_dat_packets"),
        flagged(known(c("partial") > 0), "trailing_partial_packet"),
        flagged(known(c("mismatched") > 0), "csi_size_mismatch"),
        flagged(known(c("bad_size") > 0), "bad_csi_size"),
        F.when(has_packets & (c("seconds") > 0), rate_flag(c("packets"), c("seconds"))).when(~has_packets, F.lit("missing_packet_rate")),
        flagged(known(c("packets") != c("written")), "packet_count_mismatch_slice_index"),
        flagged(known(c("packets") != c("expected")), "packet_count_mismatch_slice_expected"),
        flagged(known(c("packets") != c("sync_packets")), "packet_count_mismatch_sync_index"),
        F.when(c("nonzero_ratio") == 0, "all_zero_csi_payload").when(c("nonzero_ratio") < 0.95, "low_nonzero_ratio"),
        flagged(known(c("zero_packets") > 0), "sampled_zero_packet"),
        flagged(known(c("dead_links") > 0), "dead_rx_tx_link"),
        flagged(known(c("amplitude_std") <= 1e-6), "constant_csi_amplitude"),
        flagged(c("nonzero_ratio").isNull(), "payload_not_checked"),
        flagged(known(c("n_rules") > 0), "video_review_issue"),
        flagged(known(c("resampled")), "video_review_resampled_available"),
        flagged(known(c("unresolved")), "video_review_unresolved"),
    )


def quality_table(slices: DataFrame, sync: DataFrame, packets: DataFrame, review: DataFrame) -> DataFrame:
    """Flags and status per sample.

    slices (sample_id, slice_status, sync_flags, size, written, expected, seconds), sync (sample_id, sync_status, sync_packets), packets
    (sample_id, packets, partial, mismatched, bad_size and the columns of ``payload_stats`` that the flags use), review
    (sample_id, n_rules, resampled, unresolved).
    """
    joined = slices.join(sync.withColumn("has_sync", F.lit(1)), "sample_id", "left").join(packets, "sample_id", "left").join(review, "sample_id", "left")
    return joined.withColumn("flags", quality_flags()).withColumn("final_status", final_status(F.col("flags")))
