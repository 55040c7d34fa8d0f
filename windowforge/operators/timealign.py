"""Time alignment: recordings, windows, frames and packets on one clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowforge.functions.scalars import flag_list, flagged, series_rate
from windowforge.operators.ranks import counted, nodes_before, nodes_of, running_minima
from windowforge.sources.scratch import staged

#: Frames of a bucket where windows meet the gaps between frames; units of time of a cell in which frames, packets and points are sorted together.
FRAME_BUCKET, CELL = 256, 86_400_000_000
#: Frames of a block whose largest gap is a row of its own, as a power of two.
BLOCK_BITS = 6


def recording_stats(frames: DataFrame) -> DataFrame:
    """frames (recording, t) to recording, first_us, last_us, n_frames, fps."""
    out = frames.groupBy("recording").agg(F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.count("*").alias("n_frames"))
    return out.withColumn("fps", series_rate(F.col("n_frames"), (F.col("last_us") - F.col("first_us")) / 1e6))


#: Orders in which recordings have places: by start, by end, and by what a window prefers (length, length downwards, end downwards, start), then by name.
STARTS, ENDS, SHORTEST, LONGEST, LAST, FIRST = range(6)


def _places(windows: DataFrame, recordings: DataFrame) -> DataFrame:
    """A row for each recording (window_id null) and each window (recording null): lo, hi, how many recordings there are (n), and its places.

    A recording has its place p in each order; a window how many recordings begin before and by a (p0, p1) and end before and by b (p2, p3).
    """
    none = F.lit(None)
    point = lambda dim, t, kind, p: F.struct(F.lit(dim).alias("dim"), t.alias("t"), F.lit(kind).alias("kind"), F.lit(p).alias("p"))
    lo, hi = F.col("lo"), F.col("hi")
    orders = {STARTS: lo, ENDS: hi, SHORTEST: hi - lo, LONGEST: lo - hi, LAST: -hi, FIRST: lo}
    r = recordings.where("first_us IS NOT NULL AND last_us IS NOT NULL").select("recording", none.cast(windows.schema["window_id"].dataType).alias("window_id"), F.col("first_us").alias("lo"), F.col("last_us").alias("hi"))
    w = windows.where("b >= a").select(none.cast(r.schema["recording"].dataType).alias("recording"), "window_id", F.col("a").alias("lo"), F.col("b").alias("hi"))
    r = r.select("*", F.explode(F.array(*[point(k, t, 1, k) for k, t in orders.items()])).alias("q"))
    w = w.select("*", F.explode(F.array(*[point(e, t, k, 2 * e + k // 2) for e, t in ((STARTS, lo), (ENDS, hi)) for k in (0, 2)])).alias("q"))
    both = r.unionByName(w).select("recording", "window_id", "lo", "hi", "q.*").withColumn("is_rec", (F.col("kind") == 1).cast("int")).withColumn("tie", F.xxhash64("window_id", "lo", "hi"))
    placed = counted(both, ["dim", "t", "kind", "recording", "tie"], "is_rec").withColumn("n", F.floor(F.col("total") / len(orders)))
    placed = placed.withColumn("before", F.col("before") - F.col("dim") * F.col("n"))
    out = placed.groupBy("recording", "window_id", "lo", "hi", "n", "others").agg(*[F.max(F.when(F.col("p") == k, F.col("before"))).alias(f"p{k}") for k in range(len(orders))])
    return out.withColumn("bits", F.length(F.bin("n")).cast("int")).withColumn("salts", F.greatest(F.lit(1), F.floor(F.col("others") / 4 / F.greatest("n", F.lit(1)))))


def match_recording(windows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Adds recording (or null) and contained to windows (window_id, a, b): the shortest of ``recordings`` (recording, first_us, last_us) that contains [a, b],
    else the one that overlaps it most; then the smallest name. A window with b before a has none.

    No window is paired with recordings. By start, each recording enters the dyadic nodes of its place; a window
    asks the nodes of the recordings that begin by a, and of those that begin at a or later. Within a node, both are sorted by end: a running minimum answers
    which is the shortest that lasts to b, the longest that ends by b, the first to begin of those that last beyond b, and the last to end. Windows that
    stand alike to all recordings ask once.
    """
    placed = staged(_places(windows, recordings))  # as many rows as windows and recordings
    recs, wins = placed.where("window_id IS NULL"), placed.where("recording IS NULL")
    of = lambda k: F.col(f"p{k}")
    nodes = F.concat(nodes_of(f"p{STARTS}"), nodes_of(f"(n - 1 - p{STARTS})", "1"))
    by_start = F.col("x.side") == 0
    entries = recs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).select("*", F.explode(nodes).alias("x"))
    entries = entries.select("x.*", "salt", of(ENDS).alias("key"), F.when(by_start, of(SHORTEST)).otherwise(of(FIRST)).alias("d"), F.when(~by_start, of(LONGEST)).alias("a"), F.when(by_start, of(LAST)).alias("t"))
    alike = ["p0", "p1", "p2", "p3"]
    asks = wins.select(*alike, "n", "bits", "salts").distinct().select("*", F.pmod(F.xxhash64(*alike), F.col("salts")).alias("salt"), F.explode(F.concat(nodes_before("p1"), nodes_before("(n - p0)", "1"))).alias("x"))
    asks = asks.select(*alike, "salt", "x.*", F.when(by_start, F.col("p2")).otherwise(F.col("p3")).alias("key"))
    best = lambda side, c: F.min(F.when(F.col("side") == side, F.col(c)))
    found = running_minima(entries, asks).groupBy(*alike).agg(best(0, "from_key").alias("holds"), best(1, "to_key").alias("inside"), best(0, "whole").alias("ended"), best(1, "from_key").alias("begun"))
    choice = lambda dim, c: F.struct(F.lit(dim).alias("dim"), F.col(c).alias("place"))
    some = F.when(F.col("holds").isNotNull(), F.array(choice(SHORTEST, "holds"))).otherwise(F.array(choice(LONGEST, "inside"), choice(LAST, "ended"), choice(FIRST, "begun")))
    chosen = wins.join(found, alike).select("window_id", "lo", "hi", F.explode(some).alias("c")).where("c.place IS NOT NULL").select("window_id", "lo", "hi", "c.*")
    names = recs.select("recording", F.col("lo").alias("first_us"), F.col("hi").alias("last_us"), F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), of(k).alias("place")) for k in (SHORTEST, LONGEST, LAST, FIRST)])).alias("x")).select("*", "x.*")
    overlap = F.least("hi", "last_us") - F.greatest("lo", "first_us")
    named = chosen.join(names, ["dim", "place"]).where(overlap >= 0)
    most = named.groupBy("window_id").agg(F.min(F.struct((-overlap).alias("v"), "recording", (F.col("dim") == SHORTEST).alias("contained"))).alias("m"))
    return windows.join(most, "window_id", "left").select(*windows.columns, F.col("m.recording").alias("recording"), F.col("m.contained").alias("contained"))


def _before(rows: DataFrame, n: str) -> DataFrame:
    """(recording, cell, before, total) of counts (recording, cell, ``n``): those of the cells before it, and of all."""
    whole = Window.partitionBy("recording")
    return rows.select("recording", "cell", (F.sum(n).over(whole.orderBy("cell")) - F.col(n)).alias("before"), F.sum(n).over(whole).alias("total"))


def nearest_frame(points: DataFrame, frames: DataFrame, cell: int = CELL) -> DataFrame:
    """points (point_id, recording, t) with the frame (frame_idx, pos, diff_us) nearest in time within the recording; of two as near, the later.

    Of equal earlier stamps the last counts, of equal later ones the first. Points and frames are sorted together in cells of time, so a
    long recording is many tasks; what lies nearest beyond a cell comes from a table of its cells.
    """
    none, key = F.lit(None), ["recording", "cell"]
    frame = F.struct("t", "pos", "frame_idx")
    p = points.select("recording", "t", F.lit(0).alias("kind"), none.cast("long").alias("pos"), none.cast(frames.select(frame.alias("f")).schema["f"].dataType).alias("f"), "point_id")
    f = frames.select("recording", "t", F.lit(1).alias("kind"), "pos", frame.alias("f"), none.cast(points.schema["point_id"].dataType).alias("point_id"))
    both = p.unionByName(f).withColumn("cell", F.floor(F.col("t") / cell))
    way = lambda *order: Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("l", F.last("f", ignorenulls=True).over(way("t", "kind", "pos"))).withColumn("r", F.last("f", ignorenulls=True).over(way(F.desc("t"), F.desc("kind"), F.desc("pos")))).where("kind = 0")
    by = Window.partitionBy("recording").orderBy("cell")
    beyond = both.groupBy(*key).agg(F.max("f").alias("hi"), F.min("f").alias("lo"))
    beyond = beyond.select(*key, F.last("hi", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    near = inside.join(beyond, key).withColumn("l", F.coalesce("l", "before")).withColumn("r", F.coalesce("r", "after"))
    pick = F.when(F.col("l").isNull(), F.col("r")).when(F.col("r").isNull(), F.col("l")).when(F.col("r.t") - F.col("t") <= F.col("t") - F.col("l.t"), F.col("r")).otherwise(F.col("l"))
    return near.withColumn("n", pick).select("point_id", "recording", "t", F.col("n.frame_idx").alias("frame_idx"), F.col("n.pos").alias("pos"), (F.col("n.t") - F.col("t")).alias("diff_us"))


def positions(frames: DataFrame, cell: int = CELL) -> DataFrame:
    """Adds pos, the place of a frame in its recording, by (t, frame_idx); counted in cells of time."""
    return timeline(frames, cell).select(*frames.columns, "pos")


def timeline(frames: DataFrame, cell: int = CELL) -> DataFrame:
    """Adds pos, the place of a frame in its recording, by (t, frame_idx), and gap, the time since the frame before (null for the first).

    Both are taken in cells of time; what comes before a cell is in a table of the cells.
    """
    f = frames.withColumn("cell", F.floor(F.col("t") / cell))
    whole = Window.partitionBy("recording").orderBy("cell")
    cells = f.groupBy("recording", "cell").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    cells = cells.select("recording", "cell", (F.sum("n").over(whole) - F.col("n")).alias("before"), F.lag("last").over(whole).alias("last"))
    own = Window.partitionBy("recording", "cell").orderBy("t", "frame_idx")
    f = f.withColumn("pos", F.row_number().over(own) - 1).withColumn("gap", F.lag("t").over(own)).join(cells, ["recording", "cell"])
    return f.select(*frames.columns, (F.col("pos") + F.col("before")).alias("pos"), (F.col("t") - F.coalesce("gap", "last")).alias("gap"))


def packet_counts(windows: DataFrame, packets: DataFrame, cell: int = CELL) -> DataFrame:
    """(window_id, n, before, upto) of windows (window_id, recording, a, b) among the packets (recording, t): how many there are, how many before a, how many up to b.

    Windows and packets are sorted together in cells of time, so no pair of them is ever formed, and a long recording is many tasks.
    """
    ends = windows.select("recording", F.explode(F.array(F.struct(F.col("a").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("b").alias("t"), F.lit(2).alias("kind")))).alias("e"), "window_id")
    rows = ends.select("recording", "e.t", "e.kind", "window_id").unionByName(packets.select("recording", "t", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("window_id")))
    rows = rows.withColumn("cell", F.floor(F.col("t") / cell))
    is_packet = (F.col("kind") == 1).cast("long")
    before = _before(rows.groupBy("recording", "cell").agg(F.sum(is_packet).alias("k")), "k")
    seen = F.sum(is_packet).over(Window.partitionBy("recording", "cell").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    marks = rows.withColumn("seen", seen).where("kind <> 1").join(before, ["recording", "cell"]).withColumn("seen", F.col("seen") + F.col("before")).withColumnRenamed("total", "n")
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("seen")))
    return marks.groupBy("window_id").agg(F.max("n").alias("n"), at(0).alias("before"), at(2).alias("upto")).where("n > 0")


def packet_range(windows: DataFrame, packets: DataFrame, cell: int = CELL) -> DataFrame:
    """start_idx, end_idx and flags of windows (window_id, recording, a, b) among the packets (recording, t): the first at a or later, the last by b."""
    out = packet_counts(windows, packets, cell)
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.col("n") - 1, x))
    out = out.withColumn("start_idx", clamp(F.col("before"))).withColumn("end_idx", clamp(F.col("upto") - 1))
    outside = (F.col("before") >= F.col("n")) | (F.col("upto") == 0)
    flags = flag_list(flagged(outside, "action_outside_csi_range"), flagged(F.col("end_idx") < F.col("start_idx"), "invalid_csi_action_range"))
    return out.select("window_id", "start_idx", "end_idx", flags.alias("flags"))


def in_ranges(ranges: DataFrame, rows: DataFrame, owner: str, place: str, width: int = FRAME_BUCKET) -> DataFrame:
    """``rows`` (``owner``, ``place``, ..) that lie in ranges (``owner``, start_idx, end_idx, ..) of places, once for each range.

    A range meets the rows of its own buckets of ``width`` places only.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    wide = ranges.where("start_idx >= 0 AND end_idx >= start_idx").withColumn("_bucket", F.explode(F.sequence(bucket("start_idx"), bucket("end_idx"))))
    return rows.withColumn("_bucket", bucket(place)).join(wide, [owner, "_bucket"]).where(F.col(place).between(F.col("start_idx"), F.col("end_idx"))).drop("_bucket")


def index_method(files: DataFrame, logs: DataFrame) -> DataFrame:
    """files (sample_id, n_packets, declared) and logs (sample_id, n_times) to method and flags."""
    both = files.join(logs, "sample_id", "left")
    n, times = F.col("n_packets"), F.coalesce("n_times", F.lit(0))
    flags = flag_list(
        flagged((times > 0) & (times != n), "csi_log_packet_count_mismatch_dat"),
        flagged(times == 0, "missing_csi_packet_log_times"),
        flagged((F.col("declared") > 0) & (F.abs(F.col("declared") - n) > 1), "csi_packet_count_mismatch_manifest"),
    )
    method = F.when((times > 0) & (times == n), "log_subcarrier_timestamp").otherwise("manifest_sample_window_linear")
    return both.select("sample_id", method.alias("method"), flags.alias("flags"))


#: Places of a sample's order in which its clock is followed in one go.
PIECE = 1 << 16


def day_offsets(rows: DataFrame, sample: str, order: str, clock: str, piece: Column | None = None) -> DataFrame:
    """Adds day_offset: how often the time of day has gone back so far; and place, the number of rows of the sample before.

    Rows are in the order of ``piece`` and, within a piece, of ``order``; without one, ``order`` is a number and its pieces are ``PIECE`` long. Each piece is counted
    by itself; a table of the pieces has what is carried on from one to the next, so no task goes through a whole sample.
    """
    r = rows.withColumn("_piece", F.floor(F.col(order) / PIECE) if piece is None else piece)
    key, whole = [sample, "_piece"], Window.partitionBy(sample).orderBy("_piece")
    own = Window.partitionBy(*key).orderBy(order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    back = F.coalesce((F.col(clock) < F.lag(clock).over(own)).cast("long"), F.lit(0))
    r = r.withColumn("_back", back).withColumn("_own", F.sum("_back").over(upto)).withColumn("_nth", F.row_number().over(own) - 1)
    pieces = r.groupBy(*key).agg(F.sum("_back").alias("backs"), F.count("*").alias("n"), F.min_by(clock, order).alias("first"), F.max_by(clock, order).alias("last"))
    crossed = F.coalesce((F.col("first") < F.lag("last").over(whole)).cast("long"), F.lit(0))
    pieces = pieces.withColumn("crossed", crossed).withColumn("before", F.sum(F.col("backs") + F.col("crossed")).over(whole) - F.col("backs")).withColumn("earlier", F.sum("n").over(whole) - F.col("n"))
    out = r.join(pieces.select(*key, "before", "earlier"), key)
    return out.select(*rows.columns, (F.col("_own") + F.col("before")).alias("day_offset"), (F.col("_nth") + F.col("earlier")).cast("long").alias("place"))


def frame_gaps(frames: DataFrame) -> DataFrame:
    """(recording, pos, gap): time since the frame before; pos runs without gaps. Sorted in buckets, whose edges meet by their numbers."""
    if "gap" in frames.columns:
        return frames.where("gap IS NOT NULL").select("recording", "pos", "gap")
    f = frames.select("recording", "pos", "t", F.floor(F.col("pos") / (FRAME_BUCKET << 4)).alias("cell"))
    last = f.groupBy("recording", (F.col("cell") + 1).alias("cell")).agg(F.max("t").alias("before"))
    own = F.lag("t").over(Window.partitionBy("recording", "cell").orderBy("pos"))
    return f.withColumn("own", own).join(last, ["recording", "cell"], "left").select("recording", "pos", (F.col("t") - F.coalesce("own", "before")).alias("gap")).where("gap IS NOT NULL")


def block_maxima(gaps: DataFrame) -> DataFrame:
    """(recording, level, block, gap): a table in which two rows hold the maximum of any run of blocks.

    At level k, blocks lie in groups of 2^(k+1); those of a group's first half have the maximum from themselves to the middle, the others from the middle
    to themselves. The blocks l < r are parted by the middle of level k, the highest bit in which they differ. Level -1 has each block itself.
    """
    own = gaps.groupBy("recording", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.max("gap").alias("gap"))
    own = own.withColumn("bits", F.length(F.bin(F.max("block").over(Window.partitionBy("recording")))).cast("int"))
    rows = own.select("recording", "block", "gap", F.explode(F.sequence(F.lit(-1), F.col("bits") - 1)).alias("level"))
    right = F.when(F.col("level") < 0, 1).otherwise(F.expr("shiftright(block, greatest(level, 0)) & 1"))
    rows = rows.withColumn("half", F.expr("shiftright(block, greatest(level, 0))")).withColumn("from", F.when(right == 1, F.col("block")).otherwise(-F.col("block")))
    run = Window.partitionBy("recording", "level", "half").orderBy("from").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("recording", "level", "block", F.max("gap").over(run).alias("gap"))


def max_gap(ranges: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds gap_us to ranges (window_id, recording, start_pos, end_pos): the largest gap between consecutive frames within, 0 if there is none.

    A range meets the gaps of its first and last block of ``2 ** BLOCK_BITS`` frames, and at most two rows for all blocks between, however long it is.
    """
    gaps = frame_gaps(frames)
    r = ranges.select("window_id", "recording", "start_pos", "end_pos", F.shiftright(F.col("start_pos") + 1, BLOCK_BITS).alias("l"), F.shiftright("end_pos", BLOCK_BITS).alias("r")).where("end_pos > start_pos")
    edges = r.select("window_id", "recording", "start_pos", "end_pos", F.explode(F.array_distinct(F.array("l", "r"))).alias("block"))
    near = edges.join(gaps.withColumn("block", F.shiftright("pos", BLOCK_BITS)), ["recording", "block"]).where((F.col("pos") > F.col("start_pos")) & (F.col("pos") <= F.col("end_pos")))
    inner = r.select("window_id", "recording", (F.col("l") + 1).alias("l"), (F.col("r") - 1).alias("r")).where("l <= r")
    level = F.when(F.col("l") == F.col("r"), -1).otherwise(F.length(F.bin(F.col("l").bitwiseXOR(F.col("r")))).cast("int") - 1)
    inner = inner.select("window_id", "recording", level.alias("level"), F.explode(F.array_distinct(F.array("l", "r"))).alias("block"))
    far = inner.join(block_maxima(gaps), ["recording", "level", "block"])
    most = near.select("window_id", "gap").unionByName(far.select("window_id", "gap")).groupBy("window_id").agg(F.max("gap").alias("gap_us"))
    return ranges.join(most, "window_id", "left").withColumn("gap_us", F.coalesce("gap_us", F.lit(0)))


def sync_index(windows: DataFrame, frames: DataFrame, max_diff_us: int, max_gap_us: int) -> DataFrame:
    """The video half of the synchronisation index: for windows (window_id, a, b), the recording, its nearest frames at both ends, the largest
    frame gap between, sorted flags and the status (ok iff there is no flag).

    The frames with their places and gaps, the matched windows and the windows' nearest frames are written once and read by all that follows.
    """
    placed = staged(timeline(frames.select("recording", "frame_idx", "t")))
    matched = staged(match_recording(windows, recording_stats(placed)).drop("contained"))
    point = lambda k, t: F.struct(F.lit(k).alias("end"), F.col(t).alias("t"))
    ends = matched.where("recording IS NOT NULL").select("recording", "window_id", F.explode(F.array(point(0, "a"), point(1, "b"))).alias("p"))
    near = nearest_frame(ends.select("recording", F.struct("window_id", "p.end").alias("point_id"), "p.t"), placed).select("recording", "point_id.*", "frame_idx", "pos", "diff_us")
    of = lambda k, c: F.max(F.when(F.col("end") == k, F.col(c)))
    pairs = staged(near.groupBy("window_id", "recording").agg(*[of(k, c).alias(f"{n}_{c}") for k, n in ((0, "start"), (1, "end")) for c in ("frame_idx", "pos", "diff_us")]))
    full = matched.join(max_gap(pairs, placed).drop("recording"), "window_id", "left")
    frames_n: Column = F.col("end_pos") - F.col("start_pos") + 1
    flags = flag_list(
        flagged(F.col("b") <= F.col("a"), "invalid_action_time"),
        flagged(F.col("recording").isNull(), "no_matching_video_timestamp_csv"),
        flagged(frames_n <= 0, "invalid_video_frame_range"),
        flagged(F.abs("start_diff_us") > max_diff_us, "large_start_time_diff"),
        flagged(F.abs("end_diff_us") > max_diff_us, "large_end_time_diff"),
        flagged(F.col("gap_us") > max_gap_us, "large_frame_gap_in_raw_window"),
    )
    cols = ["window_id", "recording", "start_frame_idx", "end_frame_idx", "start_diff_us", "end_diff_us", "gap_us"]
    return full.select(*cols, flags.alias("flags")).withColumn("status", F.when(F.size("flags") == 0, "ok").otherwise("warn"))


def short_recordings(frames: DataFrame, k: int) -> DataFrame:
    """(recording, n) of recordings with fewer than k frames."""
    return frames.groupBy("recording").agg(F.count("*").alias("n")).where(F.col("n") < k)


def sampled_frames(frames: DataFrame, k: int) -> DataFrame:
    """The k evenly spaced frames of each recording; frames have pos. A recording with fewer than k frames is an error; ``short_recordings`` lists them."""
    from windowforge.functions.scalars import even_indices

    if k <= 0:
        raise ValueError("a sample has one frame at least")
    short = F.raise_error(F.concat(F.lit("recording "), F.col("recording").cast("string"), F.lit(" has "), F.col("n"), F.lit(f" frames but {k} are required")))
    wanted = frames.groupBy("recording").agg(F.count("*").alias("n"))
    wanted = wanted.withColumn("n", F.when(F.col("n") < k, short.cast("long")).otherwise(F.col("n"))).select("recording", F.posexplode(even_indices(F.col("n"), k)).alias("slot", "pos"))
    return wanted.join(frames, ["recording", "pos"]).select("recording", "slot", "pos", "frame_idx", "t")
