import random
import pytest
from pyspark.sql import functions as F

from windowforge.functions import scalars as S
from windowforge.operators import archive as A
from windowforge.operators import cleanup as C
from windowforge.operators import quality as Q
from windowforge.operators.checks import ViolationError


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "whole", "number"), [("1719999999999999999", 1719999999999999999, 1.72e18), ("3.9", 3, 3.9), ("-3.9", -3, -3.9), ("", None, None), ("nan", None, None), ("inf", None, None), ("x", None, None), (None, None, None)])
def test_casts(spark, text, whole, number):
    assert one(spark, S.to_int(F.lit(text).cast("string"))) == whole
    got = one(spark, S.to_float(F.lit(text).cast("string")))
    assert got is None if number is None else abs(got - number) < 1e3


@pytest.mark.parametrize(("n", "k", "places"), [(151, 16, list(range(0, 151, 10))), (3, 5, [0, 0, 1, 2, 2]), (1, 3, [0, 0, 0])])
def test_even_indices(spark, n, k, places):
    assert one(spark, S.even_indices(F.lit(n).cast("long"), k)) == places


def test_rules(spark):
    kind = lambda e: tuple(one(spark, S.clip_rule(F.lit(e))))
    assert kind("X_R001") == ("exact", None, None, None, "X_R001")
    assert kind("X_R003–007")[:4] == ("range", "X", 3, 7)
    assert kind("X_R003 – 007") == ("exact", None, None, None, "X_R003 - 007")
    assert kind("X_*_a")[:2] == ("prefix", "X_") and kind(" * ")[:2] == ("prefix", "")
    assert [kind(e)[0] for e in ("X_R3-7", "X_R003-R007", "X_R10之后", "_R003-007")] == ["exact"] * 4
    assert kind("P  1_R003-007")[:4] == ("range", "P 1", 3, 7)
    assert kind("X_R010 之后")[:3] == ("from", "X", 10)
    assert kind("X_*")[:2] == ("prefix", "X_")


def test_rates_and_status(spark):
    flag = lambda n, s: one(spark, S.rate_flag(F.lit(n), F.lit(s)))
    assert [flag(790, 10), flag(800, 10), flag(1300, 10), flag(1301, 10), flag(5, 0)] == ["low_packet_rate", None, None, "high_packet_rate", "missing_packet_rate"]
    status = lambda *f: one(spark, S.final_status(F.array(*map(F.lit, f)).cast("array<string>")))
    assert [status(), status("low_packet_rate"), status("bad_csi_size"), status("packet_count_mismatch_slice_expected")] == ["ok", "warn", "exclude", "warn"]


@pytest.mark.parametrize(("path", "safe"), [("data/a", True), ("", False), (None, False), ("/data/a", False), ("data/../x", False), ("other/a", False), ("data/raw/a", False)])
def test_paths(spark, path, safe):
    assert one(spark, S.safe_path(F.lit(path).cast("string"), "data", "data/raw")) is safe


def test_upsert_and_duplicates(spark):
    old = spark.createDataFrame([("a", 0, 1), ("b", 1, 2)], "k string, at long, v int")
    new = spark.createDataFrame([("c", 0, 9), ("b", 1, 5), ("b", 2, 6)], "k string, at long, v int")
    got = [(r.k, r.v) for r in A.upsert_index(old, new, "k", "at", "at").orderBy("at").collect()]
    assert got == [("a", 1), ("b", 6), ("c", 9)]
    with pytest.raises(ViolationError):
        A.reconciled_join(old, new, "k")
    with pytest.raises(ViolationError):
        A.union_collections(old.withColumn("s", F.lit("ok")), new.withColumn("s", F.lit("ok")), "k", "s")


def test_apply_is_all_or_nothing(spark):
    index = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    ops = spark.createDataFrame([("a", "data/csi/a.dat", "data/video/a.mp4", "data/metadata/a.json", "q/S1")], "sample_id string, csi_path string, video_path string, metadata_path string, destination string")
    files = spark.createDataFrame([("data/csi/a.dat",), ("data/video/a.mp4",), ("data/metadata/a.json",)], "path string")
    moves = C.classify_moves(ops, files, "data", "data/raw")
    kept, log = C.apply_plan(index, ops, moves)
    assert [r.sample_id for r in kept.collect()] == ["b"] and {r.result for r in log.collect()} == {"moved"}
    bad = C.classify_moves(ops, files.where("path LIKE '%csi%'"), "data", "data/raw")
    kept, log = C.apply_plan(index, ops, bad)
    assert kept.count() == 2 and {(r.kind, r.result) for r in log.collect()} == {("csi", "preflight_aborted"), ("video", "missing_source"), ("metadata", "missing_source")}


def test_archive(spark):
    cols = "sample_id string, session_id string, person_id string, environment_id string, action_id string, csi_path string, video_path string, status string"
    clean = spark.createDataFrame([("a", "S01", "P1", "E1", "walk", "x/a.dat", "x/a.mp4", "ok")], cols)
    extra = spark.createDataFrame([("b", "S00", "P1", "E1", "walk", "x/b.dat", "x/b.mp4", "ok")], cols)
    sizes = spark.createDataFrame([("x/a.dat", 5), ("x/b.dat", 7)], "path string, bytes long")
    got = {r.sample_id: (r.archive_csi_path, r.csi_bytes) for r in A.build_archive(clean, extra, sizes).collect()}
    assert got == {"a": ("data/S01/csi/walk/a.dat", 5), "b": ("data/S01/csi/walk/b.dat", 7)}
    lonely = extra.withColumn("person_id", F.lit("P9"))
    with pytest.raises(ViolationError):
        A.build_archive(clean, lonely, sizes)


def test_last_and_first_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, at int, v string")
    assert {(r.k, r.v) for r in Q.last_rows(df, "k", "at").collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.v) for r in Q.first_rows(df, "k", "at").collect()} == {("a", "x"), ("b", None)}


def test_fixed_digits(spark):
    shown = lambda v: one(spark, S.fixed(F.lit(v).cast("double"), 2))
    assert [shown(v) for v in (1.006, -2.0, None, "nan", "inf", "-inf")] == ["1.01", "-2.00", "", "", "", ""]


def test_log_progress(spark):
    """The first step, in any case; the last pair that isn't a step's."""
    logs = {
        "Step 2/5\nStep 3/5": (2, 5, None, None),
        "STEP : 4 / 9 then 10/20, 30/20, 0/0": (4, 9, 10, 20),
        "7/8 and step 1/3": (1, 3, 7, 8),
        "step of 3/4": (None, None, None, None),
        "a step that is long over 3/4": (None, None, 3, 4),
        "steps 1/2 3/4": (None, None, None, None),
        "misstep 1/2": (None, None, None, None),
        "9/8 5/5": (None, None, 5, 5),
        "": (None, None, None, None),
        None: (None, None, None, None),
    }
    df = spark.createDataFrame([(t,) for t in logs], "t string").select("t", S.log_progress(F.col("t")).alias("p")).select("t", "p.*")
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == logs


def test_log_progress_searches_pairs_once(spark):
    """A plan with one search for pairs and one for steps; rare forms of pairs as Python's expressions of the reference find them."""
    import re

    rng = random.Random(4)
    words = ["step", "STEP", "Step:", "1/2", "3 / 4", "12\t/\n40", "9/8", "0/0", "/", "7", "a5/6", "5/6b", "1/2/3", "99999999999999999999/5", "5/99999999999999999999", " ", "  ", ", ", "\n", "then a frame", "_", "é"]
    texts = ["".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(3000)] + ["step   123456789/5/6"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.log_progress(F.col("t")).alias("p"))
    # one search, named by both parts of the result
    assert str(df._jdf.queryExecution().analyzed()).count("regexp_extract_all") <= 2

    def want(t):
        number = lambda x: int(x) if int(x) < 1 << 63 else None
        s = re.search(r"\bStep\s*:?\s*(\d+)\s*/\s*(\d+)\b", t, re.I)
        out = [number(s[1]), number(s[2])] if s else [None, None]
        last = [None, None]
        for m in re.finditer(r"\b(\d+)\s*/\s*(\d+)\b", t):
            a, b = number(m[1]), number(m[2])
            if "step" not in t[max(0, m.start() - 12) : m.start()].lower() and a is not None and b is not None and 0 < b and a <= b:
                last = [a, b]
        return (*out, *last)

    got = {r.t: tuple(r.p) for r in df.collect()}
    assert {t: got[t] for t in texts if got[t] != want(t)} == {}
