"""Queries over ``events``: a user is a recording, views and clicks are its frames, all events its packets, purchases the windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.functions import scalars as S
from windowforge.operators import indexes as I
from windowforge.operators import timealign as T
from windowforge.sources.scratch import staged

HOUR = 3_600_000_000
DAY = 24 * HOUR


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.col("user_id").alias("recording"), S.unix_micros(F.col("ts")).alias("t"), "event_type", "value")


def _frames(e: DataFrame) -> DataFrame:
    return e.where(F.col("event_type").isin("view", "click")).select("recording", F.col("event_id").alias("frame_idx"), "t")


def _windows(e: DataFrame, hours: int) -> DataFrame:
    return e.where("event_type = 'purchase'").select(F.col("event_id").alias("window_id"), "recording", F.col("t").alias("a"), (F.col("t") + hours * HOUR).alias("b"))


def recording_stats(spark, d):
    return T.recording_stats(_frames(_events(spark, d)))


def match_recording(spark, d):
    e = _events(spark, d)
    daily = _frames(e).withColumn("recording", F.concat_ws("/", F.col("recording"), F.floor(F.col("t") / DAY)))
    found = T.match_recording(_windows(e, 1).drop("recording"), T.recording_stats(daily))
    return found.select("window_id", "recording", "contained")


def nearest_frame(spark, d):
    e = _events(spark, d)
    points = _windows(e, 0).select(F.col("window_id").alias("point_id"), "recording", F.col("a").alias("t"))
    return T.nearest_frame(points, T.positions(_frames(e)))


def packet_range(spark, d):
    e = _events(spark, d)
    return T.packet_range(_windows(e, 24), e).withColumn("flags", F.concat_ws(";", "flags"))


def linear_range(spark, d):
    e = _events(spark, d)
    n = T.recording_stats(e.select("recording", "t"))
    w = _windows(e, 24).join(n, "recording")
    seconds = lambda x: (F.col(x) - F.col("first_us")) / 1e6
    lo, hi = S.linear_range(seconds("a"), seconds("b"), seconds("last_us"), F.col("n_frames"))
    return w.select("window_id", lo.alias("start_idx"), hi.alias("end_idx"))


def rollover(spark, d):
    e = _events(spark, d).withColumn("clock", F.col("t") % DAY)
    return T.day_offsets(e, "recording", "event_id", "clock").select("event_id", "day_offset")


def _day_ranges(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    frames = staged(T.timeline(_frames(e)))  # read several times
    near = T.nearest_frame(_windows(e, 0).select(F.col("window_id").alias("point_id"), "recording", F.col("a").alias("t")), frames)
    return near.where("pos IS NOT NULL").select(F.col("point_id").alias("window_id"), "recording", F.col("pos").alias("start_pos"), (F.col("pos") + 10).alias("end_pos")), frames


def max_gap(spark, d):
    ranges, frames = _day_ranges(_events(spark, d))
    return T.max_gap(ranges, frames).select("window_id", "gap_us")


def sync_index(spark, d):
    e = _events(spark, d)
    out = T.sync_index(_windows(e, 24).drop("recording"), _frames(e), HOUR, 12 * HOUR)
    return out.withColumn("flags", F.concat_ws(";", "flags"))


def padded_range(spark, d):
    ranges, frames = _day_ranges(_events(spark, d))
    stats = T.recording_stats(frames)
    lo, hi = S.padded_range(F.col("start_pos"), F.col("end_pos"), F.col("n_frames"), F.col("fps") * 3600, 1.5, 2.5)
    return ranges.join(stats, "recording").select("window_id", lo.alias("frame_start"), hi.alias("frame_end"))


def _written(e: DataFrame, w: DataFrame) -> DataFrame:
    """Packets cut out for each window, those of its time: a difference of two places."""
    return T.packet_counts(w, e.select("recording", "t")).select("window_id", F.greatest(F.lit(0), F.col("upto") - F.col("before")).alias("written"))


def slice_counts(spark, d):
    """Packets written for each window against those its range promises."""
    e = _events(spark, d)
    w = _windows(e, 24)
    ranges = T.packet_range(w, e.select("recording", "t"))
    expected = ranges.select("window_id", F.greatest(F.lit(0), F.col("end_idx") - F.col("start_idx") + 1).alias("expected"))
    out = expected.join(_written(e, w), "window_id", "left").withColumn("written", F.coalesce("written", F.lit(0)))
    return out.withColumn("status", F.when(F.col("written") == F.col("expected"), "ok").otherwise("count_mismatch"))


def frame_sample(spark, d):
    frames = staged(T.positions(_frames(_events(spark, d))))
    enough = frames.join(T.short_recordings(frames, 16), "recording", "left_anti")
    return T.sampled_frames(enough, 16).select("recording", "slot", "frame_idx")


def packet_rate(spark, d):
    e = _events(spark, d)
    r = T.recording_stats(e.select("recording", "t"))
    days = (F.col("last_us") - F.col("first_us")) / DAY
    return r.select("recording", F.round(F.col("n_frames") / days, 6).alias("rate"), F.coalesce(S.rate_flag(F.col("n_frames"), days, 2.0, 2.4), F.lit("ok")).alias("flag"))


_E = f"""
e AS (SELECT event_id, user_id AS recording, epoch_us(ts) AS t, event_type FROM events),
f AS (SELECT recording, event_id AS frame_idx, t, row_number() OVER (PARTITION BY recording ORDER BY t, event_id) - 1 AS pos FROM e WHERE event_type IN ('view', 'click')),
w1 AS (SELECT event_id AS window_id, recording, t AS a, t + {HOUR} AS b FROM e WHERE event_type = 'purchase'),
w24 AS (SELECT window_id, recording, a, a + {DAY} AS b FROM w1),
rec AS (SELECT recording, min(t) AS first_us, max(t) AS last_us, count(*) AS n_frames,
  CASE WHEN count(*) > 1 AND max(t) > min(t) THEN (count(*) - 1) / ((max(t) - min(t)) / 1e6) END AS fps FROM f GROUP BY recording)"""
_MATCH = """
SELECT window_id, recording, holds AS contained FROM (
  SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY holds DESC, CASE WHEN holds THEN last_us - first_us ELSE -(least(b, last_us) - greatest(a, first_us)) END, recording) AS n
  FROM (SELECT w.window_id, w.a, w.b, r.*, r.first_us <= w.a AND w.b <= r.last_us AS holds FROM {w} w LEFT JOIN {r} r ON w.a <= r.last_us AND r.first_us <= w.b)) WHERE n = 1"""
_NEAR = """
SELECT p.point_id, p.recording, p.t, CASE WHEN c THEN r.frame_idx ELSE l.frame_idx END AS frame_idx, CASE WHEN c THEN r.pos ELSE l.pos END AS pos,
  CASE WHEN c THEN r.t ELSE l.t END - p.t AS diff_us
FROM {p} p ASOF LEFT JOIN f l ON l.recording = p.recording AND p.t > l.t ASOF LEFT JOIN f r ON r.recording = p.recording AND p.t <= r.t,
LATERAL (SELECT l.t IS NULL OR (r.t IS NOT NULL AND r.t - p.t <= p.t - l.t) AS c)"""
_RANGE = """
SELECT w.window_id, count(*) AS n, count(*) FILTER (WHERE e.t < w.a) AS lo, count(*) FILTER (WHERE e.t <= w.b) AS hi FROM w24 w JOIN e ON e.recording = w.recording GROUP BY w.window_id"""
_CLAMPED = f"SELECT window_id, n, lo, hi, greatest(0, least(n - 1, lo)) AS start_idx, greatest(0, least(n - 1, hi - 1)) AS end_idx FROM ({_RANGE})"
_DAYS = "d AS (SELECT window_id AS point_id, recording, a AS t FROM w1), nr AS (" + _NEAR.format(p="d") + "), rg AS (SELECT point_id AS window_id, recording, pos AS start_pos, pos + 10 AS end_pos FROM nr WHERE pos IS NOT NULL), g AS (SELECT recording, pos, t - lag(t) OVER (PARTITION BY recording ORDER BY pos) AS gap FROM f)"

QUERIES = {
    "recording_stats": recording_stats,
    "match_recording": match_recording,
    "nearest_frame": nearest_frame,
    "packet_range": packet_range,
    "linear_range": linear_range,
    "rollover": rollover,
    "max_gap": max_gap,
    "sync_index": sync_index,
    "padded_range": padded_range,
    "slice_counts": slice_counts,
    "frame_sample": frame_sample,
    "packet_rate": packet_rate,
}

ORACLE = {
    "recording_stats": f"WITH {_E} SELECT * FROM rec",
    "match_recording": f"WITH {_E}, day AS (SELECT recording || '/' || (t // {DAY}) AS recording, min(t) AS first_us, max(t) AS last_us FROM f GROUP BY 1) " + _MATCH.format(w="w1", r="day"),
    "nearest_frame": f"WITH {_E}, d AS (SELECT window_id AS point_id, recording, a AS t FROM w1) " + _NEAR.format(p="d"),
    "packet_range": f"""WITH {_E}, c AS ({_CLAMPED}) SELECT window_id, start_idx, end_idx,
  concat_ws(';', CASE WHEN lo >= n OR hi = 0 THEN 'action_outside_csi_range' END, CASE WHEN end_idx < start_idx THEN 'invalid_csi_action_range' END) AS flags FROM c""",
    "linear_range": f"""WITH {_E}, r AS (SELECT recording, min(t) AS f0, max(t) AS f1, count(*) AS n FROM e GROUP BY recording)
SELECT window_id, greatest(0, least(n - 1, ceil(((a - f0) / 1e6) / ((f1 - f0) / 1e6) * (n - 1))::BIGINT)) AS start_idx,
  greatest(0, least(n - 1, floor(((b - f0) / 1e6) / ((f1 - f0) / 1e6) * (n - 1))::BIGINT)) AS end_idx FROM w24 JOIN r ON r.recording = w24.recording""",
    "rollover": f"""WITH {_E}, c AS (SELECT *, t % {DAY} < lag(t % {DAY}) OVER (PARTITION BY recording ORDER BY event_id) AS back FROM e)
SELECT event_id, sum(coalesce(back, false)::INT) OVER (PARTITION BY recording ORDER BY event_id)::BIGINT AS day_offset FROM c""",
    "max_gap": f"""WITH {_E}, {_DAYS} SELECT window_id, coalesce(max(gap), 0) AS gap_us FROM rg LEFT JOIN g ON g.recording = rg.recording AND g.pos > start_pos AND g.pos <= end_pos GROUP BY window_id""",
    "sync_index": f"""WITH {_E}, m AS ({_MATCH.format(w="w24", r="rec")}), mw AS (SELECT m.window_id, m.recording, w24.a, w24.b FROM m JOIN w24 ON w24.window_id = m.window_id),
pa AS (SELECT window_id AS point_id, recording, a AS t FROM mw WHERE recording IS NOT NULL), pb AS (SELECT window_id AS point_id, recording, b AS t FROM mw WHERE recording IS NOT NULL),
na AS ({_NEAR.format(p="pa")}), nb AS ({_NEAR.format(p="pb")}),
g AS (SELECT recording, pos, t - lag(t) OVER (PARTITION BY recording ORDER BY pos) AS gap FROM f),
j AS (SELECT mw.*, na.frame_idx AS sf, nb.frame_idx AS ef, na.pos AS sp, nb.pos AS ep, na.diff_us AS sd, nb.diff_us AS ed FROM mw LEFT JOIN na ON na.point_id = mw.window_id LEFT JOIN nb ON nb.point_id = mw.window_id),
k AS (SELECT j.window_id, any_value(j.recording) AS recording, any_value(sf) AS start_frame_idx, any_value(ef) AS end_frame_idx, any_value(sd) AS start_diff_us, any_value(ed) AS end_diff_us,
  any_value(ep - sp + 1) AS n, CASE WHEN any_value(j.recording) IS NOT NULL THEN coalesce(max(gap), 0) END AS gap_us
  FROM j LEFT JOIN g ON g.recording = j.recording AND g.pos > sp AND g.pos <= ep GROUP BY j.window_id),
fl AS (SELECT *, concat_ws(';', CASE WHEN n <= 0 THEN 'invalid_video_frame_range' END, CASE WHEN abs(end_diff_us) > {HOUR} THEN 'large_end_time_diff' END,
  CASE WHEN gap_us > {12 * HOUR} THEN 'large_frame_gap_in_raw_window' END, CASE WHEN abs(start_diff_us) > {HOUR} THEN 'large_start_time_diff' END,
  CASE WHEN recording IS NULL THEN 'no_matching_video_timestamp_csv' END) AS flags FROM k)
SELECT window_id, recording, start_frame_idx, end_frame_idx, start_diff_us, end_diff_us, gap_us, flags, CASE WHEN flags = '' THEN 'ok' ELSE 'warn' END AS status FROM fl""",
    "padded_range": f"""WITH {_E}, {_DAYS} SELECT window_id, greatest(0, start_pos - greatest(0, round_even(CASE WHEN fps > 0 THEN fps * 3600 ELSE 30 END * 1.5, 0)::BIGINT)) AS frame_start,
  least(n_frames - 1, end_pos + greatest(0, round_even(CASE WHEN fps > 0 THEN fps * 3600 ELSE 30 END * 2.5, 0)::BIGINT)) AS frame_end FROM rg JOIN rec ON rec.recording = rg.recording""",
    "slice_counts": f"""WITH {_E}, c AS ({_CLAMPED}), x AS (SELECT window_id, greatest(0, end_idx - start_idx + 1) AS expected, hi - lo AS written FROM c)
SELECT *, CASE WHEN written = expected THEN 'ok' ELSE 'count_mismatch' END AS status FROM x""",
    "frame_sample": f"""WITH {_E}, n AS (SELECT recording, count(*) AS n FROM f GROUP BY recording HAVING count(*) >= 16),
s AS (SELECT recording, j::INT AS slot, CASE WHEN j = 15 THEN n - 1 ELSE round_even(j * ((n - 1) / 15.0::DOUBLE), 0)::BIGINT END AS pos FROM n, range(0, 16) AS r(j))
SELECT s.recording, slot, frame_idx FROM s JOIN f ON f.recording = s.recording AND f.pos = s.pos""",
    "packet_rate": f"""WITH {_E}, r AS (SELECT recording, count(*) AS n, (max(t) - min(t)) / {DAY} AS days FROM e GROUP BY recording)
SELECT recording, round(n / days, 6) AS rate, CASE WHEN NOT days > 0 THEN 'missing_packet_rate' WHEN n / days < 2.0 THEN 'low_packet_rate' WHEN n / days > 2.4 THEN 'high_packet_rate' ELSE 'ok' END AS flag FROM r""",
}


def csi_index(spark, d):
    """A user's events are a packet file; some users have no log, some a short one, some a wrong declared count."""
    e = _events(spark, d)
    n = e.groupBy(F.col("recording").alias("sample_id")).agg(F.count("*").alias("n_packets"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    u = F.col("sample_id")
    files = n.select("sample_id", "n_packets", (F.col("n_packets") + F.when(u % 4 == 0, 3).otherwise(1)).alias("declared"), F.when(u % 7 == 0, F.array(F.lit("csi_trailing_bytes"))).otherwise(F.array().cast("array<string>")).alias("census_flags"), F.when(u % 6 != 1, F.col("lo")).alias("sample_start"), F.when(u % 6 != 2, F.col("hi")).alias("sample_end"))
    times = e.where("recording % 3 <> 0 AND NOT (recording % 5 = 0 AND event_id % 50 = 0)").select(F.col("recording").alias("sample_id"), "t")
    windows = _windows(e, 24).select("window_id", F.col("recording").alias("sample_id"), "a", "b")
    out = I.csi_index(windows, files, times, 1.0)
    return out.withColumn("flags", F.concat_ws(";", "flags")).withColumn("raw_rate", F.round(F.col("raw_rate") * 1e6, 4))


def slice_windows(spark, d):
    e = _events(spark, d)
    ranges, frames = _day_ranges(e)
    w = _windows(e, 24)
    index = T.packet_range(w, e).drop("flags").join(ranges, "window_id")
    written = _written(e, w)
    totals = T.recording_stats(frames).select("recording", "n_frames", (F.col("fps") * 3600).alias("fps"))
    return I.slice_windows(index, written, totals, 1.5, 2.5)


def session_selection(spark, d):
    e = _events(spark, d).withColumn("status", F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "view", "warn").otherwise("bad"))
    return I.session_selection(e, "recording", "status", True)


QUERIES |= {"csi_index": csi_index, "slice_windows": slice_windows, "session_selection": session_selection}
ORACLE |= {
    "csi_index": f"""WITH {_E}, tm AS (SELECT recording, t FROM e WHERE recording % 3 <> 0 AND NOT (recording % 5 = 0 AND event_id % 50 = 0)),
fl AS (SELECT recording AS sample_id, count(*) AS n, CASE WHEN recording % 6 <> 1 THEN min(t) END AS s, CASE WHEN recording % 6 <> 2 THEN max(t) END AS z, count(*) + CASE WHEN recording % 4 = 0 THEN 3 ELSE 1 END AS declared FROM e GROUP BY recording),
lg AS (SELECT recording AS sample_id, count(*) AS k FROM tm GROUP BY recording),
m AS (SELECT fl.*, coalesce(k, 0) AS k, coalesce(k, 0) = n AS by_log FROM fl LEFT JOIN lg USING (sample_id)),
c AS (SELECT w.window_id, count(*) FILTER (WHERE tm.t < w.a) AS lo, count(*) FILTER (WHERE tm.t <= w.b) AS hi FROM w24 w JOIN tm ON tm.recording = w.recording GROUP BY 1),
j AS (SELECT w.window_id, w.recording AS sample_id, w.a, w.b, m.* EXCLUDE (sample_id), coalesce(s, w.a) AS st, CASE WHEN z > coalesce(s, w.a) THEN (z - coalesce(s, w.a)) / 1e6 END AS span, lo, hi
  FROM w24 w JOIN m ON m.sample_id = w.recording LEFT JOIN c ON c.window_id = w.window_id),
x AS (SELECT *, CASE WHEN by_log THEN greatest(0, least(n - 1, lo)) WHEN n = 1 THEN 0 ELSE greatest(0, least(n - 1, ceil(((a - st) / 1e6) / coalesce(span, n) * (n - 1))::BIGINT)) END AS start_idx,
  CASE WHEN by_log THEN greatest(0, least(n - 1, hi - 1)) WHEN n = 1 THEN 0 ELSE greatest(0, least(n - 1, floor(((b - st) / 1e6) / coalesce(span, n) * (n - 1))::BIGINT)) END AS end_idx FROM j)
SELECT window_id, sample_id, CASE WHEN by_log THEN 'log_subcarrier_timestamp' WHEN span IS NOT NULL THEN 'manifest_sample_window_linear' ELSE 'default_1hz' END AS method, start_idx, end_idx,
  CASE WHEN n > 1 AND span > 0 THEN round((n - 1) / span * 1e6, 4) END AS raw_rate,
  concat_ws(';', CASE WHEN by_log AND (lo >= n OR hi = 0) THEN 'action_outside_csi_range' END, CASE WHEN k > 0 AND k <> n THEN 'csi_log_packet_count_mismatch_dat' END, CASE WHEN declared - n > 1 THEN 'csi_packet_count_mismatch_manifest' END,
    CASE WHEN sample_id % 7 = 0 THEN 'csi_trailing_bytes' END, CASE WHEN end_idx < start_idx THEN 'invalid_csi_action_count' END, CASE WHEN end_idx < start_idx THEN 'invalid_csi_action_range' END,
    CASE WHEN k = 0 THEN 'missing_csi_packet_log_times' END, CASE WHEN NOT by_log AND span IS NULL THEN 'missing_sample_end_unix_ns' END, CASE WHEN NOT by_log AND s IS NULL THEN 'missing_sample_start_unix_ns' END) AS flags FROM x""",
    "slice_windows": f"""WITH {_E}, {_DAYS}, c AS ({_CLAMPED}),
x AS (SELECT c.window_id, greatest(0, end_idx - start_idx + 1) AS expected, hi - lo AS written, greatest(0, start_pos - greatest(0, round_even(CASE WHEN fps > 0 THEN fps * 3600 ELSE 30 END * 1.5, 0)::BIGINT)) AS frame_start,
  least(n_frames - 1, end_pos + greatest(0, round_even(CASE WHEN fps > 0 THEN fps * 3600 ELSE 30 END * 2.5, 0)::BIGINT)) AS frame_end FROM c JOIN rg ON rg.window_id = c.window_id JOIN rec ON rec.recording = rg.recording)
SELECT *, CASE WHEN written = expected AND frame_end >= frame_start THEN 'ok' ELSE 'partial' END AS status FROM x""",
    "session_selection": "SELECT user_id AS recording, count(*) FILTER (WHERE event_type IN ('purchase', 'view')) AS selected, count(*) FILTER (WHERE event_type = 'view') AS warned FROM events GROUP BY user_id",
}
