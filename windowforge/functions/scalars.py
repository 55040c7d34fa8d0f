"""Column functions: lenient casts, rates, flags, rule expressions, paths, digests, index arithmetic. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- casts and formats


def to_int(c: Column) -> Column:
    """Whole numbers exactly, others truncated; null for anything else."""
    number = F.expr("try_cast(null as double)") if c is None else c.try_cast("double")
    return F.coalesce(c.try_cast("bigint"), F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), number.cast("bigint")))


def to_float(c: Column) -> Column:
    """Null for what isn't a finite number."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def fixed(c: Column, digits: int) -> Column:
    """Fixed digits for export, half up by the shortest decimal form of the number; empty for null and what isn't finite."""
    number = c.cast("double")
    return F.when(F.abs(number) < float("inf"), F.format_string(f"%.{digits}f", number)).otherwise("")


def sorted_json(names: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]))


def config_signature(config: dict[str, Column]) -> Column:
    """16 hexadecimal digits that stand for a configuration."""
    return F.substring(F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(config.items())])), 256), 1, 16)


# ---------------------------------------------------------------- time and rate


def unix_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def log_time_ns(date: Column, clock: Column, zone_hours: int = 8) -> Column:
    """``HH:MM:SS.f`` on a date at a fixed offset from UTC, as unix nanoseconds; null if it can't be read."""
    whole, part = F.split_part(clock, F.lit("."), F.lit(1)), F.split_part(clock, F.lit("."), F.lit(2))
    text = F.concat(date.cast("string"), F.lit(" "), whole, F.lit("."), F.rpad(part, 6, "0"))
    return (unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")) - zone_hours * 3_600_000_000) * 1000


def series_rate(n: Column, seconds: Column) -> Column:
    return F.when((n > 1) & (seconds > 0), (n - 1) / seconds)


def rate_flag(count: Column, seconds: Column, low: float = 80, high: float = 130) -> Column:
    rate = count / seconds
    return F.when(count.isNull() | seconds.isNull() | (seconds <= 0), "missing_packet_rate").when(rate < low, "low_packet_rate").when(rate > high, "high_packet_rate")


def padded_range(start: Column, end: Column, total: Column, fps: Column, pre: float, post: float) -> tuple[Column, Column]:
    """Frames widened by seconds before and after, within the recording; 30 frames a second where the rate is 0 or null."""
    rate = F.when(fps > 0, fps).otherwise(30.0)
    grow = lambda s: F.greatest(F.lit(0), F.rint(rate * s).cast("long"))
    return F.greatest(F.lit(0).cast("long"), start - grow(pre)), F.least(total - 1, end + grow(post))


def linear_range(rel_start: Column, rel_end: Column, seconds: Column, n: Column, fs: float = 100.0) -> tuple[Column, Column]:
    """Packet range of a window in proportion to time, clamped; n / fs stands for an unknown duration."""
    span = F.when(seconds > 0, seconds).otherwise(n / F.lit(fs))
    place = lambda r, how: F.greatest(F.lit(0), F.least(n - 1, how(r / span * (n - 1)).cast("long")))
    return F.when(n == 1, 0).otherwise(place(rel_start, F.ceil)).cast("long"), F.when(n == 1, 0).otherwise(place(rel_end, F.floor)).cast("long")


# ---------------------------------------------------------------- flags

# The flags that exclude a sample.
EXCLUDING = [
    "slice_status_not_ok",
    "missing_csi_slice_file",
    "empty_csi_slice_file",
    "no_dat_packets",
    "trailing_partial_packet",
    "csi_size_mismatch",
    "bad_csi_size",
    "packet_count_mismatch_slice_index",
    "packet_count_mismatch_sync_index",
    "all_zero_csi_payload",
    "dead_rx_tx_link",
    "video_review_issue",
]


def flag_list(*flags: Column) -> Column:
    """Sorted distinct flags that aren't null."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*flags), lambda x: x.isNotNull())))


def flagged(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def final_status(flags: Column) -> Column:
    return F.when(F.arrays_overlap(flags, F.array(*map(F.lit, EXCLUDING))), "exclude").when(F.size(flags) > 0, "warn").otherwise("ok")


def has_flag(text: Column, name: str) -> Column:
    return F.array_contains(F.split(text, ";"), name)


def composite_status(parts: Column) -> Column:
    return F.when(F.forall(parts, lambda p: p.endswith("_ok") | p.endswith("_skipped")), "ok").otherwise("partial")


def valid_probe(*numbers: Column) -> Column:
    out = F.lit(True)
    for n in numbers:
        out = out & F.coalesce(n > 0, F.lit(False))
    return out


# ---------------------------------------------------------------- sample ids and rules


def trial_prefix(sample: Column) -> Column:
    """What stands before ``_Rnnn`` (exactly three digits); null without it."""
    return F.nullif(F.regexp_extract(sample, r"^(.*)_R\d{3}$", 1), F.lit(""))


def trial_number(sample: Column) -> Column:
    return F.regexp_extract(sample, r"_R(\d{3})$", 1).try_cast("int")


def clip_rule(expr: Column) -> Column:
    """A reviewer's clip expression as struct(kind, prefix, low, high, exact).

    Dashes count as hyphens, white space as one blank. With a ``*``, whatever begins as what stands before the first one; trials (three digits each)
    from one on or between two; anything else names one sample.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(expr, "[–—]", "-"), r"(?U)\s+", " "))
    after, span = r"^(.+)_R(\d{3}) ?之后$", r"^(.+)_R(\d{3})-(\d{3})$"
    kind = F.when(text.contains("*"), "prefix").when(text.rlike(after), "from").when(text.rlike(span), "range").otherwise("exact")
    pick = lambda p, g: F.regexp_extract(text, p, g)
    prefix = F.when(kind == "prefix", F.substring_index(text, "*", 1)).when(kind == "from", pick(after, 1)).when(kind == "range", pick(span, 1))
    low = F.when(kind == "from", pick(after, 2).try_cast("int")).when(kind == "range", pick(span, 2).try_cast("int"))
    high = F.when(kind == "range", pick(span, 3).try_cast("int"))
    return F.struct(kind.alias("kind"), prefix.alias("prefix"), low.alias("low"), high.alias("high"), F.when(kind == "exact", text).alias("exact"))


def person_check(known: Column, expected: Column, actual: Column) -> Column:
    return (
        F.when(~known, "unknown_session")
        .when(expected.isNull() | (expected == ""), "missing_person")
        .when(expected == actual, "ok")
        .otherwise(F.concat(F.lit("mismatch: "), actual, F.lit(" is not "), expected))
    )


# ---------------------------------------------------------------- paths and text


def metadata_path(packets: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(packets, "/csi/", "/metadata/"), r"\.dat$", ".json")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_path(path: Column, root: str) -> Column:
    cut = root.rstrip("/") + "/"
    return F.when(path.startswith(cut), F.substring(path, len(cut) + 1, 1 << 30)).otherwise(path)


def anonymised_path(path: Column, known: str, target: str) -> Column:
    """Under ``target``, without the known prefix, named ``…_add.mp4``."""
    return F.concat(F.lit(target.rstrip("/") + "/"), F.regexp_replace(relative_path(path, known), r"\.[^./]*$", ""), F.lit("_add.mp4"))


def safe_path(path: Column, allowed: str | None = None, protected: str | None = None) -> Column:
    """Not empty, not absolute, without ``..``, under the allowed prefix and not under the protected one."""
    ok = path.isNotNull() & (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
    if allowed:
        ok = ok & path.startswith(allowed.rstrip("/") + "/")
    if protected:
        ok = ok & ~path.startswith(protected.rstrip("/") + "/")
    return F.coalesce(ok, F.lit(False))


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def log_progress(text: Column) -> Column:
    """What a log says about its progress, as step_current, step_total (the first ``Step a/b``, in any case, with or without a colon) and frame_current,
    frame_total (the last other ``a/b`` with a <= b and b > 0 that has no "step" within the 12 characters before it); null where it says nothing."""
    step = F.nullif(F.regexp_extract(text, r"[sS](?<=\b[sS])[tT][eE][pP]\s*+:?+\s*+(\d++\s*+/\s*+\d++)\b", 1), F.lit(""))
    # one search for all pairs: those of a step, which are named within the 12 characters before, are empty texts
    pair = r"\d*+\s*+/\s*+\d++\b"
    pairs = F.regexp_extract_all(text, F.lit(rf"(?is)(\d(?<=\b\d)(?<!step.{{0,8}}\d){pair})|\d(?<=\b\d){pair}"), F.lit(1))
    numbers = lambda x: F.transform(F.split(x, "/"), lambda n: n.try_cast("long"))
    # empty texts go before: a cast that fails is slow
    frames = F.filter(F.transform(F.filter(pairs, lambda x: x != ""), numbers), lambda n: (n[1] > 0) & (n[0] <= n[1]))
    first, last = numbers(step), F.try_element_at(frames, F.lit(-1))
    return F.struct(first[0].alias("step_current"), first[1].alias("step_total"), last[0].alias("frame_current"), last[1].alias("frame_total"))


# ---------------------------------------------------------------- arrays


def even_indices(n: Column, target: int) -> Column:
    """``target`` places from 0 to n - 1, evenly spaced, rounded half to even."""
    step = (n - 1) / F.lit(max(1, target - 1)).cast("double")
    inner = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda j: F.rint(j * step).cast("long"))
    if target < 2:
        return F.array(F.lit(0).cast("long"))
    return F.transform(inner, lambda x, j: F.when(j == target - 1, n - 1).otherwise(x).cast("long"))


def amplitudes(iq: Column) -> Column:
    """Magnitudes of (real, imaginary) pairs laid one after another."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(iq) / 2).cast("int") - 1)
    at = lambda k: F.get(iq, k).cast("double")
    return F.transform(pairs, lambda k: F.sqrt(at(2 * k) * at(2 * k) + at(2 * k + 1) * at(2 * k + 1)))


def nonzero_count(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x != 0))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once: inside lambdas, Spark would work it out for every element."""
    return F.transform(F.array(value), then)[0]


def z_scores(values: Column, least: float = 1e-6) -> Column:
    """Population z-scores, the deviation not below ``least``."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    scaled = lambda v, c: _let(F.greatest(F.sqrt(squares(c) / F.size(v)), F.lit(least)), lambda d: F.transform(c, lambda x: x / d))
    centred = lambda v, m: _let(F.transform(v, lambda x: x - m), lambda c: scaled(v, c))
    return _let(values, lambda v: _let(total(v) / F.size(v), lambda m: centred(v, m)))
