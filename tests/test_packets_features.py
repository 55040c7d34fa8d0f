import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from windowforge.operators import features as X
from windowforge.operators import packets as P
from windowforge.operators import quality as Q
from windowforge.operators.checks import ViolationError
from windowforge.operators.profile import quantiles
from windowforge.sources import readers as R
from windowforge.sources import sinks as S


def record(i, rx=2, tx=1, sc=8, size=None, head_rx=None):
    body = b"".join(struct.pack("<hh", i * 100 + r * 10 + c + 1, -(c + 1)) for r in range(rx) for c in range(sc))
    h = bytearray(272)
    struct.pack_into("<I", h, 0, len(body) if size is None else size)
    struct.pack_into("<I", h, 8, 1000 + i)
    struct.pack_into("<BB", h, 46, rx if head_rx is None else head_rx, tx)
    struct.pack_into("<I", h, 52, sc)
    struct.pack_into("<II", h, 60, 70, 71)
    h[68:74] = bytes(range(6))
    struct.pack_into("<I", h, 92, 2 << 11)
    return bytes(h) + body


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("packets")
    good = b"".join(map(record, range(4)))
    for name, data in {"good": good, "trail": good + b"partial", "mismatch": good + record(4, head_rx=3), "zero": good + record(4, size=0), "cut": good[:-5], "empty": b""}.items():
        (d / f"{name}.dat").write_bytes(data)
    return P.packet_files(spark, str(d))


def test_values(files):
    rows = P.scan_packets(files.where("sample_id = 'good'")).orderBy("packet_idx").collect()
    assert len(rows) == 4 and all(r.problem is None for r in rows)
    r = rows[2]
    assert (r.ftm_clock, r.num_rx, r.num_subcarriers, r.rssi2, r.source_mac, r.rate_flags) == (1002, 2, 8, 71, "00:01:02:03:04:05", 4096)
    assert r.iq[:4] == [201, -1, 202, -2] and r.iq[16:18] == [211, -1]


def test_problems(files):
    got = {r.sample_id: (r.packets, r.mismatched, r.bad_size, r.partial) for r in P.packet_problems(P.scan_packets(files)).collect()}
    assert got == {"good": (4, 0, 0, 0), "trail": (4, 0, 0, 1), "mismatch": (4, 1, 0, 0), "zero": (4, 0, 1, 1), "cut": (3, 0, 0, 1), "empty": (0, 0, 0, 0)}
    with pytest.raises(ViolationError):
        P.read_packets(files)
    assert P.read_packets(files.where("sample_id = 'good'")).count() == 4
    assert P.scan_packets(files.where("sample_id = 'good'"), keep=2).where("iq IS NOT NULL").count() == 2


def test_census(spark, files):
    got = {r.sample_id: (r.packets, r.flags) for r in P.packet_census(files).collect()}
    assert got["good"] == (4, []) and got["trail"] == (4, ["csi_trailing_bytes"])
    assert got["empty"] == (0, ["empty_or_invalid_csi_file"])
    heads = P.packet_heads(spark, files.where("sample_id = 'good'").first().path.rsplit("/", 1)[0])
    assert heads.where("length(content) > 272").isEmpty()
    assert {r.sample_id: (r.packets, r.flags) for r in P.packet_census(heads).collect()} == got


def test_slices(spark, files):
    wins = spark.createDataFrame([(1, "good", 1, 2), (2, "good", 3, 9), (3, "good", 3, 1)], "window_id int, sample_id string, start_idx int, end_idx int")
    inside, report = P.slice_packets(P.scan_packets(files), wins)
    assert inside.count() == 3
    assert {r.window_id: r.status for r in report.collect()} == {1: "csi_ok", 2: "csi_count_mismatch", 3: "invalid_range"}


def plan_of(spark, energies, ratio=0.05):
    rows = [(1, i, float(e)) for i, e in enumerate(energies)]
    return X.repaired_energy(spark.createDataFrame(rows, "g long, carrier int, energy double"), "g", ratio).orderBy("carrier").collect()


def test_repair_by_hand(spark):
    got = plan_of(spark, [0, 10, 20, 0, 60, 0, 0])
    assert [r.repaired for r in got] == [10, 10, 20, 40, 60, 80, 100] and [r.valid for r in got] == [False, True, True, False, True, False, False]
    assert {(r.problem, r.repaired) for r in plan_of(spark, [0, 5, 0])} == {("one_usable_carrier", None)}
    assert {(r.problem, r.repaired) for r in plan_of(spark, [0, 0, 1e-7])} == {("no_energy", None)}
    weak = plan_of(spark, [100, 1, 0], 0.9)  # one strong carrier only: all that sound count
    assert [r.valid for r in weak] == [True, True, False] and [r.repaired for r in weak] == [100, 1, -98]


def test_repair_of_arrays(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 0.0, 4.0, 5.0]), ("a", [2.0, 3.0, 0.0, 5.0, 6.0]), ("b", [0.0] * 5)], "g string, v array<double>")
    got = {tuple(r.v): r.problem for r in X.repair_carriers(rows, "g", "v", 0.1).collect()}
    assert got == {(1, 2, 3, 4, 5): None, (2, 3, 4, 5, 6): None, (0,) * 5: "no_energy"}


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v)) for g, n in ((1, 1), (2, 2), (3, 501), (None, 7)) for v in rng.integers(0, 40, n) / 4] + [(9, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    for r in quantiles(df, "v", [0.0, 0.25, 0.5, 0.95], "g").collect():
        own = [v for g, v in rows if g == r.g]
        assert r.n == len(own) and np.allclose(r.q, np.quantile(own, [0.0, 0.25, 0.5, 0.95]))
    assert np.isclose(quantiles(df, "v", [0.5]).first().q[0], np.median([v for _, v in rows if v is not None]))
    # a hot group of a narrow range among wide ones, cut finely by its own sketch; no job before the plan runs
    hot = [(1, 1000 + float(v)) for v in rng.normal(0, 1e-3, 30_000)] + [(2, float(v)) for v in rng.normal(0, 1e6, 300)]
    many = spark.createDataFrame(hot, "g long, v double").repartition(4)
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    plan = quantiles(many, "v", [0.05, 0.5, 0.95], "g")
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() == before
    for r in plan.collect():
        assert np.allclose(r.q, np.quantile([v for g, v in hot if g == r.g], [0.05, 0.5, 0.95]), rtol=0, atol=1e-9)
    assert quantiles(df.limit(0), "v", [0.5]).first().n == 0 and quantiles(df.limit(0), "v", [0.5], "g").count() == 0


def test_preprocess_is_standard(spark, files):
    out = X.preprocess(P.scan_packets(files.where("sample_id = 'good'")).where("problem IS NULL"), 6, 4).collect()
    assert len(out) == 2 * 6
    for rx in (0, 1):
        v = np.array([r["values"] for r in out if r.rx == rx])
        assert v.shape == (6, 4) and np.isfinite(v).all() and abs(v.mean()) < 1e-6
    odd = P.scan_packets(files.where("sample_id = 'good'")).withColumn("num_tx", F.lit(2).cast("smallint"))
    assert X.preprocess(odd, 6, 4).first().problem == "several_transmitters"
    rows = [("silent", 0, [0] * 8), ("silent", 1, [0] * 8), ("one", 0, [0, 0, 3, 4, 0, 0, 0, 0]), ("none", 0, [])]
    few = spark.createDataFrame([(n, k, 1, 1, len(iq) // 2, iq) for n, k, iq in rows], "sample_id string, packet_idx int, num_rx int, num_tx int, num_subcarriers int, iq array<smallint>")
    assert {(r.sample_id, r.problem) for r in X.preprocess(few, 2, 2).collect()} == {("silent", "no_energy"), ("one", "one_usable_carrier"), ("none", "empty_dimension")}


def test_preprocess_against_numpy(spark):
    rng = np.random.default_rng(8)
    iq = rng.integers(-900, 900, (20, 2, 24, 2))
    iq[:, :, [0, 7, 22, 23]] = 0
    packets = spark.createDataFrame([("s", k, 2, 1, 24, iq[k].ravel().tolist()) for k in range(20)], "sample_id string, packet_idx int, num_rx int, num_tx int, num_subcarriers int, iq array<smallint>")
    level = np.log1p(np.sqrt((iq.astype(float) ** 2).sum(axis=-1)))
    for rx in (0, 1):
        for place, (lo, hi) in {0: (1, 1), 7: (6, 8), 22: (20, 21), 23: (20, 21)}.items():
            level[:, rx, place] = np.interp(place, [lo, hi], level[0, rx, [lo, hi]]) if lo == hi else level[:, rx, lo] + (level[:, rx, hi] - level[:, rx, lo]) * (place - lo) / (hi - lo)
    level[:, :, 0] = level[:, :, 1]
    even = lambda n, k: [round(j * (n - 1) / (k - 1)) for j in range(k)]
    want = level[even(20, 12)][:, :, even(24, 8)]
    want = (want - want.mean(axis=(0, 2), keepdims=True)) / want.std(axis=(0, 2), keepdims=True)
    got = {(r.rx, r.t): r["values"] for r in X.preprocess(packets, 12, 8).collect()}
    assert len(got) == 24 and all(np.allclose(got[rx, t], want[t, rx], atol=1e-5) for rx, t in got)


def test_cache(spark, files, tmp_path):
    packets = P.scan_packets(files).where("problem IS NULL")
    samples = spark.createDataFrame([("good", "S1", 4), ("trail", "S1", 5), ("absent", "S2", 4)], "sample_id string, session_id string, n long")
    path = str(tmp_path / "cache")
    first = X.build_feature_cache(samples, packets, path, "abc", "n")
    assert {r.sample_id: r.status for r in first.collect()} == {"good": "built", "trail": "packet_count_mismatch", "absent": "no_packets"}
    r = X.cache_report(first).first()
    assert (r.requested, r.completed, r.failed, r.complete) == (3, 1, 2, False)
    again = X.build_feature_cache(samples, packets, path, "abc", "n")
    assert {r.sample_id: r.status for r in again.collect()}["good"] == "cached"


def test_payload_stats(spark):
    rows = [("a", 0, [1.0, 0.0]), ("a", 0, [3.0, 4.0]), ("a", 1, [0.0, 0.0]), ("a", 1, [0.0, 0.0])]
    r = Q.payload_stats(spark.createDataFrame(rows, "sample_id string, link int, amplitude array<double>")).first()
    assert (r.packets, r.zero_packets, r.dead_links, r.nonzero_ratio, r.amplitude_mean) == (2, 2, 1, 3 / 8, 1.0)


HEAD = "sample_id,session_id,archive_session_id,person_id,environment_id,action_id,trial_id,status,sync_quality_flags,archive_video_path,video_frames_written,video_fps\n"


def row(i, path=None, fps="30.0", frames="151", status="ok"):
    return f"X_R{i:03},S1,S1,P1,E1,walk,R{i:03},{status},ok,{path or f'data/v/{i}.mp4'},{frames},{fps}\n"


def manifest(tmp_path, *rows, head=HEAD):
    p = tmp_path / "m.csv"
    p.write_text("﻿" + head + "".join(rows), encoding="utf-8")
    return str(p)


def test_manifest(spark, tmp_path):
    df = R.load_manifest(spark, manifest(tmp_path, row(1), row(2), row(3, status="warn")), "video")
    assert {(r.sample_id, r.video_frames_written, r.video_fps) for r in df.collect()} == {("X_R001", 151, 30.0), ("X_R002", 151, 30.0)}


@pytest.mark.parametrize("rows", [[row(1, path="../outside.mp4")], [row(1, fps="nan")], [row(1, frames="x")], [row(1), row(1)], [row(1, status="warn")]])
def test_bad_manifests(spark, tmp_path, rows):
    with pytest.raises(ValueError):
        R.load_manifest(spark, manifest(tmp_path, *rows), "video")


def test_missing_column(spark, tmp_path):
    with pytest.raises(ValueError, match="lacks"):
        R.load_manifest(spark, manifest(tmp_path, head=HEAD.replace("video_fps", "other")), "video")


def test_logs_frames_rules_and_lists(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("[23:59:59.9] Subcarrier count: 996\nnoise\n[00:00:00.1] Subcarrier count: 996\n")
    dates = spark.createDataFrame([("a", "2024-05-01")], "sample_id string, date string")
    got = [r.unix_ns for r in R.scan_log_packet_times(spark, str(tmp_path / "logs"), dates).orderBy("packet_idx").collect()]
    assert got[0] == 1714579199_900000000 and got[1] - got[0] == 200_000_000
    (tmp_path / "Video" / "x").mkdir(parents=True)
    (tmp_path / "Video" / "x" / "c_video_timestamps.csv").write_text("frame_idx,unix_time_ns\n0,1719999999999999999\nbad,5\n1,1720000000000000003\n")
    frames = R.scan_frame_times(spark, str(tmp_path / "Video")).orderBy("frame_idx").collect()
    assert [r.unix_time_ns for r in frames] == [1719999999999999999, 1720000000000000003] and frames[0].video.endswith("x/c.mp4")
    (tmp_path / "rules.md").write_text("## Intro\n| a | `skip` | x | y | z |\n  ## Detail of it\n| # | S | `expr` | c | d | r |\n|--|--|--|--|--|--|\n  | 1 | **S1** | **`X_R003–007`** | shake | long | **done** |\n| 2 | | `x` | a | b | c |\n## End\n| 3 | S2 | `no` | c | d | r |\n## Detail\n| 4 | S3 | `no` | c | d | r |\n", encoding="utf-8")
    rules = R.read_review_rules(spark, str(tmp_path / "rules.md"), "Detail").collect()
    assert [(r.session_id, r.clip_expr, r.category, r.resample_status) for r in rules] == [("S1", "X_R003–007", "shake", "done")]
    (tmp_path / "ids.txt").write_text("# c\n a \n\nb\n")
    assert {r.sample_id for r in R.read_id_list(spark, str(tmp_path / "ids.txt")).collect()} == {"a", "b"}
    (tmp_path / "as.csv").write_text("sample_id,split,seed\na,train,1\na,val,1\n")
    with pytest.raises(ViolationError):
        R.load_assignments(spark, str(tmp_path / "as.csv"))
    (tmp_path / "sl.csv").write_text("sample_id,video_out_path\na,v\n,v\nb,\n")
    kept, dropped = R.load_slice_index(spark, str(tmp_path / "sl.csv"))
    assert kept.count() == 1 and dropped.first().dropped == 2


def test_resolve_and_maps(spark, tmp_path):
    listing = spark.createDataFrame([("d/S2/a.dat",), ("d/S1/a.dat",), ("d/S1/b.dat",)], "path string")
    wanted = spark.createDataFrame([("a", "S2", "a.dat"), ("b", "S9", "b.dat"), ("c", "S1", "c.dat")], "sample_id string, session_id string, name string")
    assert {r.sample_id: r.path for r in R.resolve_sample_files(wanted, listing, "d").collect()} == {"a": "d/S2/a.dat", "b": "d/S1/b.dat", "c": None}
    (tmp_path / "s.csv").write_text("Session,Person_ID\nS1, P1\nS1,P2\nS2,None\n")
    (tmp_path / "p.csv").write_text("Person_id,Name\nP1,A\n")
    s, p = R.load_reference_maps(spark, str(tmp_path / "s.csv"), str(tmp_path / "p.csv"))
    assert {r.session_id: r.expected_person for r in s.collect()} == {"S1": "P2", "S2": None} and p.count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "S1", ["x", "y"]), ("b", "S2", [])], "sample_id string, session_id string, flags array<string>")
    S.write_index(df, str(tmp_path / "i"), ["sample_id", "flags", "extra"], "csv")
    assert {(r.sample_id, r.flags, r.extra) for r in R.read_index(spark, str(tmp_path / "i")).collect()} == {("a", "x;y", None), ("b", "ok", None)}
    S.write_by_session(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "session_id=S1")).count() == 1
    S.write_metadata(df, df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).select("slice_result.sample_id").count() == 2
    for run in ("r1", "r2"):
        S.append_run_log(df, str(tmp_path / "l"), run)
    assert {r.run_id for r in S.latest_run(spark.read.parquet(str(tmp_path / "l"))).collect()} == {"r2"}
    preds = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 1)], "run int, sample_id string, true int, pred int")
    S.write_evaluation(preds, spark.createDataFrame([(0,), (1,)], "label int"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e" / "metrics")).first().accuracy == 0.5


def test_first_packets_only(spark, files):
    trail = files.where("sample_id = 'trail'")
    with pytest.raises(ViolationError):
        P.read_packets(trail)
    assert [r.packet_idx for r in P.read_packets(trail, max_packets=2).orderBy("packet_idx").collect()] == [0, 1]
    with pytest.raises(ValueError):
        P.read_packets(trail, max_packets=0)


def test_decoders_are_checked(spark, tmp_path):
    samples = spark.createDataFrame([("a", "S1"), ("b", "S1"), ("c", "S1")], "sample_id string, session_id string")
    packets = samples.select("sample_id")
    rows = spark.createDataFrame([("a", 0, 0, [1.0, 2.0], None), ("b", 0, 0, [1.0], None), ("c", 0, 0, [1.0, float("nan")], None)], "sample_id string, rx int, t int, values array<float>, problem string")
    got = X.build_feature_cache(samples, packets, str(tmp_path / "c"), "v", build=lambda p: rows, shape=(1, 2))
    assert {r.sample_id: r.status for r in got.collect()} == {"a": "built", "b": "failed", "c": "failed"}
    with pytest.raises(ValueError, match="features need"):
        X.build_feature_cache(samples, packets, str(tmp_path / "d"), "v", build=lambda p: rows.drop("t"))


def test_row_hook(spark):
    from windowforge.operators.process import process_rows

    def one(row):
        if row["a"] == 2:
            raise KeyError("no")
        return {"x": row["a"] * 2 if row["a"] != 3 else "text", "more": 1}

    got = process_rows(spark.createDataFrame([(1,), (2,), (3,), (None,)], "a long"), one, "x long, y string").collect()
    assert got[0][:] == (2, None, None) and got[1].error.startswith("KeyError") and got[2].error and got[3].error.startswith("TypeError")


def odd_files(d):
    """Files whose records change their size, contradict themselves, stop and go on; one record longer than a range; none at all."""
    rng = np.random.default_rng(6)
    good = [record(i) for i in range(60)]
    mixed = [record(i, sc=int(rng.choice([2, 8, 8, 8, 20])), head_rx=int(rng.choice([2, 2, 2, 3, 0]))) for i in range(80)]
    data = {"good": good, "trail": [*good, b"partial"], "mixed": mixed, "late": [*good[:20], record(20, sc=3), *good[21:]], "stops": [*good[:30], record(30, size=0), *good[31:]], "long": [record(0, sc=400), *good[:5], record(6, sc=900)]}
    data |= {"lies": [record(0, head_rx=5), *good[1:9]], "cut": ["".join(()).encode(), b"".join(good)[:-5]], "short": [b"x" * 100], "empty": []}
    for name, parts in data.items():
        (d / f"{name}.dat").write_bytes(b"".join(parts))


@pytest.mark.parametrize("range_bytes", [1000, 1 << 20])
def test_ranges_of_files_are_read_as_wholes_are(spark, tmp_path, range_bytes):
    odd_files(tmp_path)
    rows = lambda df: sorted(map(str, df.collect()))
    whole = P.packet_files(spark, str(tmp_path))
    assert whole.count() == 10
    assert rows(P.scan_packet_files(spark, str(tmp_path), range_bytes=range_bytes)) == rows(P.scan_packets(whole))
    if range_bytes == 1000:
        assert P.packet_ranges(spark, str(tmp_path), range_bytes=1000).groupBy("path").count().agg(F.max("count")).first()[0] > 10
        for keep, most in ((0, None), (7, 25)):
            assert rows(P.scan_packet_files(spark, str(tmp_path), keep=keep, max_packets=most, range_bytes=1000)) == rows(P.scan_packets(whole, keep, max_packets=most))
        with pytest.raises(ViolationError):
            P.read_packet_files(spark, str(tmp_path), range_bytes=1000)
        assert P.read_packet_files(spark, str(tmp_path), "good.dat", range_bytes=1000).count() == 60
        for name in ("stops", "empty"):
            with pytest.raises(ViolationError, match=name):
                P.read_packet_files(spark, str(tmp_path), f"{name}.dat", range_bytes=1000)


def test_a_sparse_file_over_two_gib(spark, tmp_path):
    path, size = tmp_path / "huge.dat", 0
    with open(path, "wb") as f:
        for i in range(40):
            head = bytearray(record(i, sc=8)[:272])
            struct.pack_into("<I", head, 0, 4 * 2 * 8_000_000)
            struct.pack_into("<I", head, 52, 8_000_000)
            f.seek(size)
            f.write(head)
            size += 272 + 64_000_000
        f.truncate(size + 3)
    assert size > 2**31
    got = P.scan_packet_files(spark, str(tmp_path), keep=0)
    assert got.where("problem IS NULL").agg(F.count("*"), F.sum("ftm_clock"), F.max("packet_idx")).first()[:] == (40, sum(range(1000, 1040)), 39)
    assert [(r.packet_idx, r.problem) for r in got.where("problem IS NOT NULL").collect()] == [(40, "trailing_partial")]
    assert P.packet_census(P.packet_heads(spark, str(tmp_path))).first().packets == 40


def test_a_log_in_many_splits_is_read_as_one(spark, tmp_path):
    """Midnights within splits, at their edges and over splits without a packet; the splits end within lines."""
    rng = np.random.default_rng(9)
    (tmp_path / "logs").mkdir()
    want = {}
    for name, n in (("a", 400), ("b", 3), ("c", 1)):
        clock, day, lines, times = 85_000.0, 0, [], []
        for _ in range(n):
            clock += float(rng.choice([0.25, 0.5, 300, 5000]))
            if clock >= 86_400:
                clock, day = clock - 86_400, day + 1
            h, m, s = int(clock // 3600), int(clock // 60 % 60), clock % 60
            lines += ["noise [12:00:00.0] Subcarrier count: 1"] * int(rng.integers(0, 3)) + [f"[{h:02d}:{m:02d}:{s:04.1f}] Subcarrier count: 996\r"]
            times.append((day, f"{h:02d}:{m:02d}:{s:04.1f}"))
        (tmp_path / "logs" / f"{name}.log").write_bytes("\n".join(lines).encode())
        want[name] = times
    dates = spark.createDataFrame([(k, "2025-03-01") for k in want], "sample_id string, date string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    for size in ("700", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if size == "700" else "4m")
        df = R.scan_log_packet_times(spark, str(tmp_path / "logs"), dates)
        if size == "700":
            assert spark.read.text(str(tmp_path / "logs")).rdd.getNumPartitions() >= 10
        got.append(sorted(map(tuple, df.collect())))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == got[1] and len(got[0]) == 404
    days = lambda rows: [(t - rows[0]) // 10**8 for t in rows]
    for name, times in want.items():
        at = [d * 864_000 + round((int(c[:2]) * 3600 + int(c[3:5]) * 60 + float(c[6:])) * 10) for d, c in times]
        assert days([t for s, _, t in got[0] if s == name]) == [a - at[0] for a in at] and [k for s, k, _ in got[0] if s == name] == list(range(len(times)))


def test_files_of_many_names_are_written_in_their_places(spark, tmp_path):
    """One task, files that go on over batches of rows; lines in order, headers once, nothing left but the files."""
    df = spark.range(0, 25000, 1, 1).select(F.format_string("%d/n%d.txt", F.floor(F.col("id") / 100) % 4, F.floor(F.col("id") / 100)).alias("name"), F.col("id").cast("string").alias("value"))
    S.write_lines(df, str(tmp_path / "w"), "v")
    found = {str(p.relative_to(tmp_path / "w")): p.read_text().split("\n") for p in (tmp_path / "w").rglob("*") if p.is_file()}
    assert found == {f"{k % 4}/n{k}.txt": ["v", *map(str, range(100 * k, 100 * k + 100)), ""] for k in range(250)}
    S.write_lines(df.limit(0), str(tmp_path / "none"))


def test_frame_times_of_many_recordings(spark, tmp_path, monkeypatch):
    """No folder a user, which the driver would move one by one; the header of one file names the columns."""
    from pyspark.sql import DataFrameWriter

    from windowforge.plans import files as Q

    monkeypatch.setattr(DataFrameWriter, "partitionBy", None)
    monkeypatch.setattr(Q, "scratch_path", lambda spark: str(tmp_path / "q"))
    assert Q.frame_times(spark, "/root/testdata/sf0.001").count() > 0
    found = list((tmp_path / "q").rglob("*.csv"))
    assert len({p.parent for p in found}) <= 256 and len(found) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
    (tmp_path / "v").mkdir()
    for name, text in (("a", "note,FRAME_IDX,unix_time_ns,note\n\nx,1,10,y\n"), ("b", "note,frame_idx,unix_time_ns,note\nx,2,20,y\nx,,30,y\n"), ("c", "")):
        (tmp_path / "v" / f"{name}_video_timestamps.csv").write_text(text)
    assert sorted((r.frame_idx, r.unix_time_ns) for r in R.scan_frame_times(spark, str(tmp_path / "v")).collect()) == [(1, 10), (2, 20)]


def test_log_times_of_many_logs(spark, tmp_path, monkeypatch):
    """A log a user in its place, none moved by the driver."""
    from pyspark.sql import DataFrameWriter

    from windowforge.plans import files as Q

    monkeypatch.setattr(DataFrameWriter, "partitionBy", None)
    monkeypatch.setattr(Q, "scratch_path", lambda spark: str(tmp_path / "q"))
    assert Q.log_times(spark, "/root/testdata/sf0.001").count() == 1000
    assert len(list((tmp_path / "q").rglob("*.log"))) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()


def test_short_ranges_share_tasks(tmp_path):
    """Tasks are cut by their bytes and number of ranges, however short a range is; every byte lies in one range."""
    from windowforge.sources.packet_source import TASK_RANGES, PacketReader

    for k in range(150):
        (tmp_path / f"f{k}.dat").write_bytes(b"".join(map(record, range(60 if k % 2 else 0))))
    parts = PacketReader({"path": f"file://{tmp_path}", "rangebytes": "1000"}).partitions()
    ranges = [p for t in parts for p in t.pieces]
    assert len(ranges) == 75 + 75 * -(-60 * 336 // 1000) and len(parts) == -(-len(ranges) // TASK_RANGES) == 2
    assert sum(end - start for *_, start, end in ranges) == sum(p.stat().st_size for p in tmp_path.iterdir()) == 75 * 60 * (272 + 64)
    with open(tmp_path / "long.dat", "wb") as f:
        f.truncate(1 << 28)
    assert len(PacketReader({"path": f"file://{tmp_path}", "glob": "long.dat"}).partitions()) == 4
