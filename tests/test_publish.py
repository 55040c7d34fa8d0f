"""Publication in two steps: nothing half done is ever seen."""

import pytest
from pyspark.sql import functions as F

from windowforge.operators import cleanup as C
from windowforge.operators import features as X
from windowforge.sources import publish as P


def ids(df):
    return sorted(r[0] for r in df.select("sample_id").collect())


def table(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "sample_id string")


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, path)
    assert P.current(spark, path) == 0 and P.publish(table(spark, "a"), path) == 1
    old = P.read_published(spark, path)
    assert P.publish(table(spark, "b"), path) == 2 and ids(P.read_published(spark, path)) == ["b"]
    assert ids(old) == ["a"] == ids(P.read_published(spark, path, 1))
    with pytest.raises(P.Conflict):
        P.publish(table(spark, "c"), path, 1)
    assert ids(P.read_published(spark, path)) == ["b"] and P.current(spark, path) == 2
    P.publish(table(spark).where("false"), path)
    assert ids(P.read_published(spark, path)) == []


def test_a_failed_job_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    P.publish(table(spark, "a"), path)
    bad = table(spark, "b", "c").withColumn("sample_id", F.when(F.col("sample_id") == "c", F.raise_error("lost").cast("string")).otherwise(F.col("sample_id")))
    with pytest.raises(Exception, match="lost"):
        P.publish(bad, path)
    assert P.current(spark, path) == 1 and ids(P.read_published(spark, path)) == ["a"]


def built(spark, value):
    def build(packets):
        return packets.select("sample_id", F.lit(0).alias("rx"), F.lit(0).alias("t"), F.array(F.lit(value)).cast("array<float>").alias("values"), F.lit(None).cast("string").alias("problem")).distinct()

    return build


def test_cache_builds_each_sample_once(spark, tmp_path):
    path, packets = str(tmp_path / "cache"), spark.createDataFrame([(s, k) for s in "abc" for k in range(2)], "sample_id string, packet_idx int")
    samples = spark.createDataFrame([(s, "S1") for s in "abcd"], "sample_id string, session_id string")

    def meanwhile(p):
        """While all are built, another build adds a and b."""
        X.build_feature_cache(samples.where("sample_id < 'c'"), packets, path, "v", build=built(spark, 2.0))
        return built(spark, 1.0)(p)

    report = X.build_feature_cache(samples, packets, path, "v", build=meanwhile)
    held = lambda: {r.sample_id: r["values"][0] for r in X.cached_features(spark, path, "v").collect()}
    assert held() == {"a": 2.0, "b": 2.0, "c": 1.0} and X.cached_features(spark, path, "v").count() == 3
    r = X.cache_report(report, X.cached_features(spark, path, "v")).first()
    assert (r.requested, r.completed, r.failed, r.failed_ids) == (4, 3, 1, "d") and r.bytes > 0
    again = X.build_feature_cache(samples, packets, path, "v", build=built(spark, 3.0))
    assert {r.sample_id: r.status for r in again.collect()} == {"a": "cached", "b": "cached", "c": "cached", "d": "no_packets"} and held()["a"] == 2.0
    with pytest.raises(Exception, match="lost"):
        X.build_feature_cache(samples, packets, path, "v", build=lambda p: built(spark, 4.0)(p).withColumn("t", F.raise_error("lost").cast("int")), overwrite=True)
    assert held() == {"a": 2.0, "b": 2.0, "c": 1.0}
    new = X.build_feature_cache(samples.where("sample_id <> 'b'"), packets, path, "v", build=built(spark, 5.0), overwrite=True)
    assert {r.sample_id: r.status for r in new.collect()} == {"a": "built", "c": "built", "d": "no_packets"} and held() == {"a": 5.0, "c": 5.0}


def plan(spark, *there):
    index = spark.createDataFrame([("a", "S1"), ("b", "S1"), ("c", "S2")], "sample_id string, session_id string")
    ops = spark.createDataFrame([("a", "S1", "data/csi/a.dat", "data/video/a.mp4", "data/metadata/a.json", "q/S1")], "sample_id string, session_id string, csi_path string, video_path string, metadata_path string, destination string")
    return index, ops, C.classify_moves(ops, spark.createDataFrame([(p,) for p in there], "path string"), "data", "data/raw")


def test_a_plan_is_applied_whole_or_not_at_all(spark, tmp_path):
    path, files = str(tmp_path), ("data/csi/a.dat", "data/video/a.mp4", "data/metadata/a.json")
    index, ops, moves = plan(spark, *files)
    P.publish(index, f"{path}/index")
    _, _, short = plan(spark, *files[:1])
    assert {(r.kind, r.result) for r in C.apply_published(spark, path, ops, short, "one").collect()} == {("csi", "preflight_aborted"), ("video", "missing_source"), ("metadata", "missing_source")}
    assert {r.result for r in C.apply_published(spark, path, ops, moves, "two", dry_run=True).collect()} == {"would_move"}
    assert P.current(spark, f"{path}/index") == 1 and P.current(spark, f"{path}/snapshots/one") == 0 == P.current(spark, f"{path}/snapshots/two")
    assert {r.result for r in C.apply_published(spark, path, ops, moves, "three").collect()} == {"moved"}
    assert ids(P.read_published(spark, f"{path}/index")) == ["b", "c"] and ids(P.read_published(spark, f"{path}/snapshots/three")) == ["a", "b"]
    C.apply_published(spark, path, ops, moves, "four")
    assert ids(P.read_published(spark, f"{path}/index")) == ["b", "c"]
    log = P.read_published(spark, f"{path}/log")
    assert {(r.stamp, r.n) for r in log.groupBy("stamp").agg(F.count("*").alias("n")).collect()} == {(s, 3) for s in ("one", "two", "three", "four")}
