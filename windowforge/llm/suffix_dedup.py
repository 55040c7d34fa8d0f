"""Removal of repeated byte strings with merged Burrows-Wheeler transforms.

Every window of ``width`` bytes names an anchor, the least hash of its inner 50-byte strings; equal windows name equal anchors at
equal places. Anchors that stand once in the corpus end there. The text around each other one, its segment, goes to the
bucket of its hash; equal ones of a chunk go once. Where all segments of an anchor are equal, all but the first are repeats. Where they differ, they are
strings that count as often as they stand; they are cut into shards,
each with its own Burrows-Wheeler transform; the transforms are merged by refining their interleaving, four characters deeper a
round, without sorting suffixes anew. What is left alone is settled and gives the common prefixes; suffixes still together
after ``width`` characters are the intervals of repeated windows, of which the earliest place stays.

An anchor with very many segments (the edge of a passage that many documents share) would be one long task: its windows go to
the buckets of their own 128-bit hashes instead, each window once a chunk, and equal hashes are equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.llm.common import BASE_A, BASE_B, BYTE_VALUES, BYTE_VALUES_B, batch_of, hand_over, mix, null_id, ranges, release, rolling_hash, span_hash, stage, table, text_buffer
from windowforge.llm.exchange import PACKED, bucket_bits, bucket_bounds, by_bucket, gathered, ordered_chunks, packed_rows, rows_of

#: Bytes of an anchor; bytes of a chunk; least bytes of a shard; bytes of the segments whose transforms are merged at a time.
ANCHOR, CHUNK, SHARD, LOT = 50, 2 << 20, 16 << 10, 64 << 10
#: Bits of a place in a chunk; the others of 64 are those of the hash by which anchors are chosen.
PLACE_BITS = 32
#: Characters by which suffixes are first told apart.
HEAD = 8
#: Segments of an anchor, counted once a chunk, above which its windows are compared one by one.
HOT = 1024


# ---------------------------------------------------------------- transforms


def _heads(text: np.ndarray) -> np.ndarray:
    """The next ``HEAD`` characters from each place as one number; 0 behind an end."""
    n = len(text)
    out, on = text.astype(np.uint64) << np.uint64(56), text != 0
    for k in range(1, min(HEAD, n)):
        on[: n - k] &= text[k - 1 : n - 1] != 0
        out[: n - k] |= np.where(on[: n - k], text[k:], 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def shard_transform(text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, transform and first characters (``_heads``) of strings laid one after another, each ended by a 0; ``first``: where they start.

    Ends are ordered as their strings are. Ranks start with ``HEAD`` characters and double in depth until no two suffixes are equal.
    """
    n = len(text)
    heads = _heads(text)
    order = np.argsort(heads, kind="stable")
    head = heads[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], (head[1:] != head[:-1]) | (head[1:] & np.uint64(255) == 0)]))  # what reaches an end is like no other
    depth = HEAD
    while rank.max(initial=0) < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - depth] = rank[depth:]
        key = rank * (n + 1) + ahead
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        depth *= 2
    before = np.empty(n, np.uint8)
    before[1:] = text[:-1]
    before[first] = 0
    return order, before[order], heads[order]


def merge_transforms(transforms: list[np.ndarray], heads: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge transforms until suffixes are interleaved by ``width`` characters: the places (in the transforms laid one after another) that share
    as many with another, interval by interval; which of them begin an interval; and for every place the common prefix with its
    nearest neighbour, as far as the last round that had it together with another.

    The suffixes of all shards are first put together by their first characters. Round by round, what is interleaved is dealt by the four characters before it
    (by two or one in the first rounds of other widths); within equal ones the order stays. The place of the longer suffix in its own transform is
    known from counts, so nothing is sorted but characters. A suffix that is alone in its
    interval is settled: whatever is longer by it is alone too. So is one that reaches its string's end. Rounds deal with the others only.
    """
    chars, back, at = np.concatenate(transforms), [], 0
    for t in transforms:
        own = np.empty(len(t), np.int32)
        own[np.argsort(t, kind="stable")] = np.arange(at, at + len(t), dtype=np.int32)
        back.append(own)
        at += len(t)
    back = np.concatenate(back)
    one = chars != 0
    pairs, twice, two = chars[back].astype(np.uint16) << 8 | chars, back[back], one & one[back]
    far, fourth, four = pairs[twice], twice[twice], two & two[twice]
    steps = {1: ((chars,), back, one), 2: ((pairs,), twice, two), 4: ((pairs, far), fourth, four)}
    prefix, depth = np.zeros(len(chars), np.int32), 0
    active, begins = np.arange(len(chars), dtype=np.int32), np.zeros(len(chars), bool)  # nothing is known: all are together
    begins[:1] = True
    if width >= HEAD:
        head = np.concatenate(heads)
        active = active[head & np.uint64(255) != 0]
        active = active[np.argsort(head[active])]
        active, begins = _open(active, np.concatenate([[True], head[active][1:] != head[active][:-1]])[: len(active)])
        depth = HEAD
        prefix[active] = depth
    while depth < width and len(active):
        step = 1 if (width - depth) % 2 else 2 if (width - depth) % 4 else 4
        keys, longer, goes_on = steps[step]
        interval, on = np.cumsum(begins, dtype=np.int32), goes_on[active]
        active, interval = active[on], interval[on]
        order, parted = np.arange(len(active)), np.zeros(max(0, len(active) - 1), bool)
        for key in keys:  # from the nearest characters to the furthest
            order = order[np.argsort(key[active[order]], kind="stable")]
        for key in keys:
            here = key[active[order]]
            parted |= here[1:] != here[:-1]
        interval, active = interval[order], longer[active[order]]
        active, begins = _open(active, np.concatenate([[True], parted | (interval[1:] != interval[:-1])])[: len(active)])
        depth += step
        prefix[active] = depth
    return active, begins, prefix


def _open(places: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the intervals of one place."""
    alone = begins.copy()
    alone[:-1] &= begins[1:]
    return places[~alone], begins[~alone]


def repeated(segments: list[bytes], width: int, shard_bytes: int = SHARD, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, segment, offset) of every string of ``width`` bytes that stands more than once in ``segments``, which count ``times`` times each (else once)."""
    shards, held, size = [], [], 0
    for i, s in enumerate(segments):
        if held and size + len(s) + 1 > shard_bytes:
            shards.append(held)
            held, size = [], 0
        held.append(i)
        size += len(s) + 1
    shards.append(held)
    transforms, heads, owner, offset = [], [], [], []
    for part in shards:
        lengths = np.array([len(segments[i]) + 1 for i in part])
        first = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"\xff".join(segments[i] for i in part) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no 0xFF: 0 is free
        order, transform, head = shard_transform(text, first)
        transforms.append(transform)
        heads.append(head)
        own = np.repeat(np.array(part), lengths)
        owner.append(own[order])
        offset.append(order - np.repeat(first, lengths)[order])
    at, begins, _ = merge_transforms(transforms, heads, width)
    owner, offset = np.concatenate(owner), np.concatenate(offset)
    interval = np.cumsum(begins)
    if times is not None:  # an interval of one suffix that stands for several
        sizes, rest = np.array(list(map(len, segments))), np.ones(len(owner), bool)
        rest[at] = False
        more = np.flatnonzero(rest & (times[owner] > 1) & (offset + width <= sizes[owner]))
        at, interval = np.concatenate([at, more]), np.concatenate([interval, np.arange(len(more)) + len(interval) + 1])
    return interval, owner[at], offset[at]


# ---------------------------------------------------------------- the jobs


def _runs(place: np.ndarray) -> np.ndarray:
    """Ascending distinct places as uint32 pairs (first, number) of consecutive ones."""
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1] + 1])) if len(place) else np.zeros(0, np.int64)
    return np.stack([place[head], np.diff(np.concatenate([head, [len(place)]]))], axis=1).astype(np.uint32)


class _Segments:
    """The anchors of a chunk's windows: hash, first window, number of windows."""

    def __init__(self, texts: pa.Array, width: int):
        self.data, self.off = text_buffer(texts)
        n = len(self.data)
        lengths = np.diff(self.off)
        self.windows = np.maximum(0, lengths - width + 1)
        empty = np.zeros(0, np.int64)
        self.hash, self.start, self.count = np.zeros(0, np.uint64), empty, empty
        inner = width - ANCHOR + 1
        if n < width:
            return
        hashes = rolling_hash(BYTE_VALUES[self.data], ANCHOR, BASE_A)
        # places take the same bits in every chunk, so that equal windows choose alike wherever they stand; of equal hashes the first counts
        bits = PLACE_BITS
        low = (hashes >> np.uint64(bits)) << np.uint64(bits) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while span * 2 <= inner:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < inner:
            low = np.minimum(low[: len(low) - (inner - span)], low[inner - span :])
        window = ranges(self.off[:-1], self.windows)
        anchor = (low[window] & np.uint64((1 << bits) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])) if len(anchor) else empty
        self.start = window[head]
        self.count = np.diff(np.concatenate([head, [len(anchor)]]))
        self.hash = mix(hashes[anchor[head]])  # least hashes alone would crowd the first buckets


def _lots(by_hash: dict[int, dict[bytes, list[tuple[int, int]]]]) -> Iterator[list[tuple[bytes, list[tuple[int, int]]]]]:
    """The segments of the anchors that have several, with where each stands, some anchors at a time."""
    held, size = [], 0
    for known in by_hash.values():
        if len(known) > 1:
            held += known.items()
            size += sum(map(len, known))
            if size > LOT:
                yield held
                held, size = [], 0
    if held:
        yield held


_MANY = np.uint32(1)
_ITEM = np.dtype([("hash", "<u8"), ("start", "<u4"), ("size", "<u2")])
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u8")])


def _later_windows(every: np.ndarray) -> np.ndarray:
    """Which of these windows (_WINDOW) equal one before them."""
    order = np.lexsort((every["b"], every["a"]))  # stable
    a, b = every["a"][order], every["b"][order]
    later = np.zeros(len(every), bool)
    later[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return later


def repeated_runs(chunks: DataFrame, width: int, hot: int = HOT) -> DataFrame:
    """(chunk, answers of runs): runs of window starts, as uint32 pairs (first byte in the chunk, number), whose strings also start earlier."""
    bits = bucket_bits(chunks.sparkSession)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts, _ in rows_of(batches):
            s = _Segments(texts, width)
            distinct, n = np.unique(s.hash, return_counts=True)
            value = ((distinct << np.uint64(bits)) >> np.uint64(33)).astype(np.uint32) << 1
            several = np.flatnonzero((n > 1)[np.searchsorted(distinct, s.hash)])  # equal segments count once
            text = span_hash(BYTE_VALUES[s.data], s.start[several], s.start[several] + s.count[several] + width - 1, BASE_A)
            order = np.lexsort((text, s.hash[several]))
            anchor, text = s.hash[several][order], text[order]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])[: len(text)]
            sizes = np.ones(len(distinct), np.uint16)
            found, times = np.unique(anchor[new], return_counts=True)
            sizes[np.searchsorted(distinct, found)] = np.minimum(times, 65535)
            yield packed_rows(chunk, distinct, bits, value | (n > 1).astype(np.uint32), sizes)

    def common(bucket: int, chunks_: list[int], payloads: list[bytes], extras: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(p, np.uint32) for p in payloads]
        every = np.concatenate(parts)
        order = np.argsort(every)
        every, sizes = every[order], np.concatenate([np.frombuffer(x, np.uint16) for x in extras])[order]
        value = every >> 1
        head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        large = value[head][np.add.reduceat(sizes, head, dtype=np.int64) > hot]
        hit = value[head][(np.diff(np.concatenate([head, [len(every)]])) > 1) | (np.maximum.reduceat(every & _MANY, head) > 0)]
        found = []
        for c, p in zip(chunks_, parts, strict=True):
            at = np.minimum(np.searchsorted(hit, p >> 1), max(0, len(hit) - 1))
            if len(hit) and (mask := hit[at] == p >> 1).any():
                over = np.isin(p >> 1, large)
                found.append((c, np.packbits(mask).tobytes(), np.packbits(over).tobytes() if over.any() else None))
        if found:
            c, m, o = zip(*found, strict=True)
            yield batch_of(chunk=list(c), bucket=pa.array([bucket] * len(found), pa.int32()), mask=pa.array(m, pa.binary()), large=pa.array(o, pa.binary()))

    answers = stage(gathered(by_bucket(chunks.mapInArrow(probe, PACKED), common, "chunk long, bucket int, mask binary, large binary"), "bucket", "mask", "large"))

    def single(chunk: int, s: _Segments, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The windows that start there, in buckets beyond those of the segments; repeats within the chunk are known at once."""
        every = np.empty(len(start), _WINDOW)
        every["a"] = span_hash(BYTE_VALUES[s.data], start, start + width, BASE_A)
        every["b"] = span_hash(BYTE_VALUES_B[s.data], start, start + width, BASE_B)
        later = _later_windows(every)  # starts ascend
        own, every, start = start[later], every[~later], start[~later].astype(np.uint32)
        order = np.argsort(every["a"], kind="stable")
        rows = packed_rows(chunk, every["a"][order], bits, every[order], start[order])
        yield rows.set_column(0, "bucket", pc.add(rows.column(0), pa.scalar(1 << bits, pa.int32())))
        if len(own):
            yield batch_of(bucket=pa.array([((chunk >> 24) * 7 + chunk) % (1 << bits)], pa.int32()), chunk=[chunk], payload=pa.array([None], pa.binary()), extra=pa.array([_runs(own).tobytes()], pa.binary()))

    def compare(chunks_: list[int], payloads: list[bytes], extras: list[bytes]) -> Iterator[pa.RecordBatch]:
        later = _later_windows(np.concatenate([np.frombuffer(p, _WINDOW) for p in payloads]))  # chunks ascend
        found, at = [], 0
        for c, x in zip(chunks_, extras, strict=True):
            start = np.frombuffer(x, np.uint32)
            place = np.sort(start[later[at : at + len(start)]].astype(np.int64))
            at += len(start)
            if len(place):
                found.append((c, _runs(place).tobytes()))
        if found:
            yield batch_of(chunk=[c for c, _ in found], runs=pa.array([r for _, r in found], pa.binary()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts, masks in rows_of(batches):
            s = _Segments(texts, width)
            distinct = np.unique(s.hash)
            bounds, on, over = bucket_bounds(distinct, bits), np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
            for m in masks:
                a, b = bounds[m["bucket"]], bounds[m["bucket"] + 1]
                on[a:b] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=b - a).view(bool)
                if m["large"] is not None:
                    over[a:b] = np.unpackbits(np.frombuffer(m["large"], np.uint8), count=b - a).view(bool)
            number = np.searchsorted(distinct, s.hash)
            windows = np.flatnonzero(over[number])
            if len(windows):
                yield from single(chunk, s, ranges(s.start[windows], s.count[windows]))
            pick = np.flatnonzero((on & ~over)[number])
            raw, seen, first, own = s.data.tobytes(), {}, [], []
            for k, h, a, n in zip(pick.tolist(), s.hash[pick].tolist(), s.start[pick].tolist(), s.count[pick].tolist(), strict=True):
                text = raw[a : a + n + width - 1]
                if (h, text) in seen:  # an equal segment stands before in the chunk
                    own.append((a, n))
                else:
                    seen[h, text] = a
                    first.append(k)
            first = np.array(first, np.int64)
            first = first[np.argsort(s.hash[first], kind="stable")]
            hashes, start, size = s.hash[first], s.start[first], s.count[first] + width - 1
            items = np.empty(len(first), _ITEM)
            items["hash"], items["start"], items["size"] = hashes, start, size
            text = s.data[ranges(start, size)]
            edge, ends = bucket_bounds(hashes, bits), np.concatenate([[0], np.cumsum(size)])
            full = np.flatnonzero(np.diff(edge))
            rows = [(int(k), items[edge[k] : edge[k + 1]].tobytes(), text[ends[edge[k]] : ends[edge[k + 1]]].tobytes()) for k in full]
            if own:
                rows.append((((chunk >> 24) * 7 + chunk) % (1 << bits), None, np.array(own, np.uint32).tobytes()))
            if rows:
                b, p, x = zip(*rows, strict=True)
                yield batch_of(bucket=pa.array(b, pa.int32()), chunk=pa.array([chunk] * len(rows), pa.int64()), payload=pa.array(p, pa.binary()), extra=pa.array(x, pa.binary()))

    def resolve(bucket: int, chunks_: list[int], payloads: list[bytes], extras: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket >> bits:
            yield from compare(chunks_, payloads, extras)
            return
        runs, single = {}, {}
        by_hash: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for c, p, x in zip(chunks_, payloads, extras, strict=True):  # chunks ascend
            if p is None:
                runs.setdefault(c, []).append(np.frombuffer(x, np.uint32).reshape(-1, 2))
                continue
            items = np.frombuffer(p, _ITEM)
            ends = np.cumsum(items["size"].astype(np.int64))
            for h, a, n, e in zip(items["hash"].tolist(), items["start"].tolist(), items["size"].tolist(), ends.tolist(), strict=True):
                by_hash.setdefault(h, {}).setdefault(x[e - n : e], []).append((c, a))
        for known in by_hash.values():
            if len(known) == 1:  # all that shares this anchor is equal
                ((text, at),) = known.items()
                for c, a in at[1:]:
                    single.setdefault(c, []).extend((a, len(text) - width + 1))
        for segments in _lots(by_hash):
            times = np.fromiter((len(at) for _, at in segments), np.int64, len(segments))
            interval, owner, offset = repeated([t for t, _ in segments], width, times=times)
            # of an interval, the earliest place stays: it is the first of some segment's; all places after a segment's first are repeats
            chunk = np.array([at[0][0] for _, at in segments])[owner]
            place = np.array([at[0][1] for _, at in segments])[owner] + offset
            order = np.lexsort((place, chunk, interval))
            repeat = np.zeros(len(order), bool)
            repeat[1:] = interval[order][1:] == interval[order][:-1]
            chunk, place = chunk[order][repeat], place[order][repeat]
            more = np.flatnonzero(times[owner] > 1)
            more = more[np.lexsort((offset[more], owner[more]))]
            own, off = owner[more], offset[more]
            head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)])) if len(more) else np.zeros(0, np.int64)
            for i, o, n in zip(own[head].tolist(), off[head].tolist(), np.diff(np.concatenate([head, [len(more)]])).tolist(), strict=True):
                for c, a in segments[i][1][1:]:
                    single.setdefault(c, []).extend((a + o, n))
            order = np.lexsort((place, chunk))
            chunk, place = chunk[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (place[1:] != place[:-1] + 1)])) if len(chunk) else np.zeros(0, np.int64)
            pairs = np.stack([place[head], np.diff(np.concatenate([head, [len(chunk)]]))], axis=1).astype(np.uint32)
            for c in np.unique(chunk[head]).tolist():
                runs.setdefault(c, []).append(pairs[chunk[head] == c])
        for c, r in single.items():
            runs.setdefault(c, []).append(np.array(r, np.uint32).reshape(-1, 2))
        if runs:
            yield batch_of(chunk=list(runs), runs=pa.array([np.concatenate(r).tobytes() for r in runs.values()], pa.binary()))

    packed = chunks.join(answers, "chunk").mapInArrow(send, PACKED)
    runs = stage(gathered(by_bucket(packed, resolve, "chunk long, runs binary"), "runs"))
    release(answers)
    return runs


def dedup_bytes(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes, from and to), kept (the other bytes).

    A byte goes if a string of ``width`` bytes (over 50) that covers it also starts earlier: at a smaller id (null smallest; equal ids by
    text), or before in the same document. Strings are judged on the input and never cross documents. A null text is
    empty; an empty table gives no rows. What is kept may start or end within a character.
    """
    chunks = ordered_chunks(docs, id_col, text_col, CHUNK)
    runs = repeated_runs(chunks, width, hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, answers in rows_of(batches):
            data, off = text_buffer(texts)
            cover = np.zeros(len(data) + 1, np.int32)
            for x in answers:
                a = np.frombuffer(x["runs"], np.uint32).reshape(-1, 2).astype(np.int64)
                np.add.at(cover, a[:, 0], 1)
                np.add.at(cover, a.sum(axis=1) + width - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            new = np.concatenate([[True], gone[1:] != gone[:-1]]) if len(gone) else gone.copy()
            new[off[:-1][off[:-1] < len(data)]] = True
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:], [len(data)]]) if len(head) else head
            head, tail = head[gone[head]], tail[gone[head]]
            doc = np.searchsorted(off, head, side="right") - 1
            bounds = np.searchsorted(head, off).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(head - off[doc]), pa.array(tail - off[doc])], ["start", "end"]))
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[off[1:]] - total[off[:-1]]
            raw = data[~gone].tobytes()
            kept_off = (off - total[off]).tolist()
            kept = [raw[a:b] for a, b in zip(kept_off[:-1], kept_off[1:], strict=True)]
            yield batch_of(id=ids, n_bytes=np.diff(off), n_removed=removed, spans=spans, kept=pa.array(kept, pa.binary()))

    rows = chunks.join(runs, "chunk", "left").mapInArrow(cut, "id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
    return hand_over(rows.select(null_id().alias("doc_id"), "n_bytes", "n_removed", "spans", "kept"), chunks, runs)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_OP3 = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, i, md5_number(h[2 * i - 1:2 * i + 198]) AS k FROM d, unnest(range(1, n - 98)) AS t(i)),
r AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS m FROM g) WHERE m > 1),
s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM r),
b AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS z, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS k FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
e AS (SELECT d.doc_id, coalesce(b.z, 0) AS z, coalesce(lead(b.a) OVER (PARTITION BY d.doc_id ORDER BY b.k), n + 1) AS a, b.k FROM d JOIN b ON b.doc_id = d.doc_id),
p AS (SELECT doc_id, 0 AS k, 1 AS f, min(a) - 1 AS l FROM b GROUP BY doc_id UNION ALL SELECT doc_id, k, z + 1, a - 1 FROM e),
q AS (SELECT p.doc_id, string_agg(CASE WHEN l >= f THEN h[2 * f - 1:2 * l] ELSE '' END, '' ORDER BY k) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1)::BIGINT AS n_removed FROM b GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id
"""
