import random

import pytest
from windowforge.operators import timealign as T


def test_nearest_frame_ties_and_edges(spark):
    frames = spark.createDataFrame([("r", 10, 0, 0), ("r", 20, 1, 1), ("r", 20, 2, 2), ("r", 30, 3, 3)], "recording string, t long, frame_idx long, pos long")
    points = spark.createDataFrame([(0, "r", 15), (1, "r", 20), (2, "r", 5), (3, "r", 99), (4, "r", 24), (5, "x", 1), (6, "r", 25)], "point_id long, recording string, t long")
    got = {r.point_id: (r.frame_idx, r.diff_us) for r in T.nearest_frame(points, frames).collect()}
    # a tie goes to the later frame; of equal later stamps the first, of equal earlier ones the last
    assert got == {0: (1, 5), 1: (1, 0), 2: (0, 5), 3: (3, -69), 4: (2, -4), 5: (None, None), 6: (3, 5)}


def test_match_recording_prefers_containing(spark):
    recs = spark.createDataFrame([("long", 0, 100), ("short", 10, 50), ("part", 45, 60), ("touch", 200, 300)], "recording string, first_us long, last_us long")
    wins = spark.createDataFrame([(1, 20, 50), (2, 40, 120), (3, 150, 200), (4, 400, 500), (5, 9, 9)], "window_id long, a long, b long")
    got = {r.window_id: r.recording for r in T.match_recording(wins, recs).collect()}
    assert got == {1: "short", 2: "long", 3: "touch", 4: None, 5: "long"}


def test_packet_range_outside_and_reversed(spark):
    packets = spark.createDataFrame([("r", t) for t in (10, 20, 30)], "recording string, t long")
    wins = spark.createDataFrame([(1, "r", 0, 5), (2, "r", 40, 50), (3, "r", 20, 30), (4, "r", 21, 29)], "window_id long, recording string, a long, b long")
    got = {r.window_id: (r.start_idx, r.end_idx, r.flags) for r in T.packet_range(wins, packets).collect()}
    assert got[1] == (0, 0, ["action_outside_csi_range"])
    assert got[2] == (2, 2, ["action_outside_csi_range"])
    assert got[3] == (1, 2, [])
    assert got[4] == (2, 1, ["invalid_csi_action_range"])


def test_two_midnights_and_equal_times(spark):
    rows = spark.createDataFrame([("s", i, c) for i, c in enumerate((22, 23, 23, 1, 5, 2, 3))], "sample string, line int, clock int")
    got = [r.day_offset for r in T.day_offsets(rows, "sample", "line", "clock").orderBy("line").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2]


def test_max_gap_over_buckets(spark):
    frames = T.positions(spark.createDataFrame([("r", i * 10 + (500 if i > 300 else 0), i) for i in range(600)], "recording string, t long, frame_idx long"))
    ranges = spark.createDataFrame([(1, "r", 0, 299), (2, "r", 100, 400), (3, "r", 5, 5)], "window_id long, recording string, start_pos long, end_pos long")
    assert {r.window_id: r.gap_us for r in T.max_gap(ranges, frames).collect()} == {1: 10, 2: 510, 3: 0}


def test_index_method(spark):
    files = spark.createDataFrame([("a", 5, 5), ("b", 5, 7), ("c", 5, 6)], "sample_id string, n_packets long, declared long")
    logs = spark.createDataFrame([("a", 5), ("b", 4)], "sample_id string, n_times long")
    got = {r.sample_id: (r.method, r.flags) for r in T.index_method(files, logs).collect()}
    assert got["a"] == ("log_subcarrier_timestamp", [])
    assert got["b"][1] == ["csi_log_packet_count_mismatch_dat", "csi_packet_count_mismatch_manifest"]
    assert got["c"] == ("manifest_sample_window_linear", ["missing_csi_packet_log_times"])


@pytest.mark.parametrize("seed", [7, 32, 1000])
def test_match_recording_against_brute_force(spark, seed):
    rng = random.Random(seed)
    recs = [(f"r{rng.randrange(10)}{k}", a := rng.randrange(-300, 900), a + rng.choice([0, 3, 20, 60, 300, 1500])) for k in range(60)]
    wins = [(k, a := rng.randrange(-400, 1100), a + rng.choice([-1, 0, 1, 6, 7, 8, 14, 15, 40, 200])) for k in range(150)]
    got = T.match_recording(spark.createDataFrame(wins, "window_id long, a long, b long"), spark.createDataFrame(recs, "recording string, first_us long, last_us long"))
    for r in got.collect():
        holds = [(z - f, n) for n, f, z in recs if f <= r.a and r.b <= z]
        meets = [(max(r.a, f) - min(r.b, z), n) for n, f, z in recs if r.a <= z and f <= r.b]
        want = (None, None) if r.b < r.a or not meets else (min(holds)[1], True) if holds else (min(meets)[1], False)
        assert (r.recording, r.contained) == want
    assert got.count() == len(wins)


def test_cells_change_nothing(spark):
    rng = random.Random(1)
    frames = spark.createDataFrame([(f"r{k % 3}", rng.randrange(500), k) for k in range(200)], "recording string, t long, frame_idx long")
    points = spark.createDataFrame([(k, f"r{k % 4}", rng.randrange(-50, 560)) for k in range(150)], "point_id long, recording string, t long")
    wins = points.selectExpr("point_id AS window_id", "recording", "t AS a", "t + point_id % 40 - 3 AS b")
    rows = lambda df: sorted(map(str, df.collect()))
    placed = T.positions(frames)
    assert rows(placed) == rows(T.positions(frames, 13))
    assert rows(T.nearest_frame(points, placed)) == rows(T.nearest_frame(points, placed, 13))
    ranges = T.packet_range(wins, frames)
    assert rows(ranges) == rows(T.packet_range(wins, frames, 13))
    cut = T.in_ranges(wins.join(ranges, "window_id").drop("flags"), placed, "recording", "pos", 5)
    by_hand = {(w.window_id, f.frame_idx) for w in wins.join(ranges, "window_id").collect() for f in placed.collect() if f.recording == w.recording and w.start_idx <= f.pos <= w.end_idx}
    assert {(r.window_id, r.frame_idx) for r in cut.collect()} == by_hand


def rows_out(df, node):
    """Rows that come out of the plan's nodes of this kind, after a run."""
    df.collect()
    found, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        name = p.nodeName()
        if node in name and p.metrics().contains("numOutputRows"):
            found += p.metrics().apply("numOutputRows").value()
        more = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else []
        children = p.children()
        plans += more + [children.apply(i) for i in range(children.size())]
    return found


def test_match_forms_no_pairs(spark):
    """Rows that windows ask for grow with the logarithm of the recordings, though each window lies in a third of them."""
    rng = random.Random(3)
    asked = []
    for n in (400, 800):
        recs = [(f"r{k}", a := rng.randrange(1000), a + rng.randrange(1000)) for k in range(n)]
        wins = [(k, a := rng.randrange(1000), a + rng.randrange(300)) for k in range(n)]
        got = T.match_recording(spark.createDataFrame(wins, "window_id long, a long, b long"), spark.createDataFrame(recs, "recording string, first_us long, last_us long"))
        asked.append(rows_out(got, "Join"))
        assert asked[-1] <= n * (2 * n.bit_length() + 6)
    assert asked[1] < 2.4 * asked[0]


def test_hot_places_are_split(spark, monkeypatch):
    """Small cells of keys, few recordings asked by many windows: copies of nodes and tables of cells change nothing."""
    from windowforge.operators import ranks

    monkeypatch.setattr(ranks, "CELL_BITS", 2)
    rng = random.Random(4)
    recs = [(f"r{k % 7}{k}", a := rng.randrange(50), a + rng.choice([0, 5, 30, 60])) for k in range(40)]
    wins = [(k, a := rng.choice([20, 20, rng.randrange(-5, 90)]), a + rng.randrange(25)) for k in range(400)]
    got = T.match_recording(spark.createDataFrame(wins, "window_id long, a long, b long"), spark.createDataFrame(recs, "recording string, first_us long, last_us long"))
    for r in got.collect():
        holds = [(z - f, n) for n, f, z in recs if f <= r.a and r.b <= z]
        meets = [(max(r.a, f) - min(r.b, z), n) for n, f, z in recs if r.a <= z and f <= r.b]
        assert (r.recording, r.contained) == ((None, None) if not meets else (min(holds)[1], True) if holds else (min(meets)[1], False))


def test_gaps_of_long_ranges(spark):
    """Ranges of every length, as long as a recording included, meet at most two rows besides their edge blocks."""
    rng = random.Random(5)
    times = {r: sorted(rng.randrange(10**6) for _ in range(n)) for r, n in (("a", 1500), ("b", 130), ("c", 1))}
    frames = spark.createDataFrame([(r, t, k) for r, ts in times.items() for k, t in enumerate(ts)], "recording string, t long, frame_idx long")
    ranges = [(k, r := rng.choice("aab"), x := rng.randrange(len(times[r])), rng.randrange(x, len(times[r]))) for k in range(300)]
    ranges += [(900, "a", 0, 1499), (901, "b", 0, 129), (902, "c", 0, 0), (903, "a", 63, 64), (904, "a", 40, 20)]
    want = {k: max((b - a for a, b in zip(times[r][x:y], times[r][x + 1 : y + 1])), default=0) for k, r, x, y in ranges}
    df = spark.createDataFrame(ranges, "window_id long, recording string, start_pos long, end_pos long")
    for placed in (T.positions(frames), T.timeline(frames)):
        got = T.max_gap(df, placed)
        assert {r.window_id: r.gap_us for r in got.collect()} == want
    table = T.block_maxima(T.frame_gaps(T.timeline(frames)))
    assert table.count() <= 24 * 6 + 3 * 3 + 1 and table.groupBy("recording", "level", "block").count().where("count > 1").isEmpty()


def test_too_few_frames_are_an_error(spark):
    frames = spark.createDataFrame([("a", k, k, k) for k in range(151)] + [("b", k, k, k) for k in range(15)], "recording string, t long, frame_idx long, pos long")
    with pytest.raises(Exception, match="recording b has 15 frames but 16 are required"):
        T.sampled_frames(frames, 16).collect()
    assert [tuple(r) for r in T.short_recordings(frames, 16).collect()] == [("b", 15)]
    got = [r.pos for r in T.sampled_frames(frames.where("recording = 'a'"), 16).orderBy("slot").collect()]
    assert got == [round(k * 10) for k in range(16)]


def test_pieces_of_a_clock_change_nothing(spark, monkeypatch):
    rng = random.Random(11)
    rows = [("s", i, rng.randrange(100)) for i in range(200)] + [("t", i * 7, i % 5) for i in range(40)] + [("u", 3, 1)]
    want = {}
    for s in "stu":
        day, last = 0, None
        for k, (_, i, c) in enumerate(r for r in rows if r[0] == s):
            day += last is not None and c < last
            want[s, i], last = (day, k), c
    df = spark.createDataFrame(rows, "sample string, line int, clock int")
    for width in (1, 10, 1 << 16):
        monkeypatch.setattr(T, "PIECE", width)
        assert {(r["sample"], r.line): (r.day_offset, r.place) for r in T.day_offsets(df, "sample", "line", "clock").collect()} == want
