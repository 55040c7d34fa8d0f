"""Removal of repeated word sequences by fixed-block anchors.

Any window of ``width`` words holds a whole block of ``width // 2`` words that starts at a multiple of that number in its
document. These non-overlapping blocks are the index; every rolling window of a block's length probes it. Around the
hits, windows are extended to ``width`` words and compared; repeats that overlap join to maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat, tee

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.llm.common import BASE_A, BASE_B, batch_of, hand_over, null_id, ranges, release, rolling_hash, stage, table, text_buffer, with_row, word_hashes, words_of
from windowforge.llm.exchange import PACKED, bucket_bits, bucket_bounds, by_bucket, gathered, ordered_chunks, packed_rows, rows_of


class _Words:
    """The words of a chunk, one after another, with the windows that lie within one document."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = text_buffer(texts)
        self.starts, self.ends, self.first = words_of(self.data, self.off)
        self.n = len(self.starts)
        lengths = np.diff(self.first)
        self.left = np.repeat(self.first[1:], lengths) - np.arange(self.n)  # words from here to the document's end
        self.at = np.arange(self.n) - np.repeat(self.first[:-1], lengths)  # place in the document

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)


def _anchors(w: _Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rolling blocks in documents of ``width`` words or more, and their hashes; the lowest bit: at a multiple of the block."""
    block = width // 2
    rolled = rolling_hash(hashes, block, BASE_A)
    n = len(rolled)
    ok = np.flatnonzero((w.left[:n] >= block) & (w.at[:n] + w.left[:n] >= width))
    return ok, (rolled[ok] & ~np.uint64(1)) | (w.at[ok] % block == 0).astype(np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct hashes, whether each stands in the chunk more than once, and whether as an index block."""
    keys = np.sort(keys)
    bare = keys & ~np.uint64(1)
    head = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]])) if len(bare) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate([head, [len(bare)]])) > 1
    block = np.maximum.reduceat(keys & np.uint64(1), head) if len(head) else np.zeros(0, np.uint64)
    return bare[head], many, block


def _common(payloads: list[bytes]) -> Iterator[np.ndarray]:
    """For each payload of a bucket, which entries occur twice or more in all and once or more as an index block."""
    parts = [np.frombuffer(p, np.uint32) for p in payloads]
    every = np.sort(np.concatenate(parts))
    value = every >> 2
    head = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    block = np.maximum.reduceat(every & 1, head)
    times = np.diff(np.concatenate([head, [len(every)]])) + np.maximum.reduceat(every >> 1 & 1, head)
    hit = value[head][(block > 0) & (times > 1)]
    for p in parts:
        at = np.searchsorted(hit, p >> 2)
        yield (at < len(hit)) & (hit[np.minimum(at, len(hit) - 1)] == p >> 2) if len(hit) else np.zeros(len(p), bool)


def repeated_windows(chunks: DataFrame, width: int) -> DataFrame:
    """(chunk, positions): starts (uint32 word numbers in the chunk) of all windows whose words also start earlier."""
    bits = bucket_bits(chunks.sparkSession)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts, _ in rows_of(batches):
            w = _Words(texts)
            bare, many, block = _distinct(_anchors(w, w.hashes(), width)[1])
            entry = ((bare << np.uint64(bits)) >> np.uint64(34)).astype(np.uint32) << 2
            yield packed_rows(chunk, bare, bits, entry | many.astype(np.uint32) << 1 | block.astype(np.uint32))

    def hits(bucket: int, chunks_: list[int], payloads: list[bytes], _) -> Iterator[pa.RecordBatch]:
        found = [(c, np.packbits(m).tobytes()) for c, m in zip(chunks_, _common(payloads), strict=True) if m.any()]
        if found:
            yield batch_of(chunk=[c for c, _ in found], bucket=pa.array([bucket] * len(found), pa.int32()), mask=pa.array([m for _, m in found], pa.binary()))

    answers = stage(gathered(by_bucket(chunks.mapInArrow(probe, PACKED), hits, "chunk long, bucket int, mask binary"), "bucket", "mask"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts, masks in rows_of(batches):
            w = _Words(texts)
            hashes = w.hashes()
            place, keys = _anchors(w, hashes, width)
            bare, _, _ = _distinct(keys)
            bounds = bucket_bounds(bare, bits)
            common = np.zeros(len(bare), bool)
            for m in masks:
                a, b = bounds[m["bucket"]], bounds[m["bucket"] + 1]
                common[a:b] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=b - a).view(bool)
            common = bare[common]
            at = np.searchsorted(common, keys & ~np.uint64(1))
            hit = place[(at < len(common)) & (common[np.minimum(at, len(common) - 1)] == keys & ~np.uint64(1))]
            seen = np.zeros(w.n + 2, np.int32)
            seen[hit + 1] = 1
            seen = np.cumsum(seen)
            start = np.flatnonzero(w.left >= width)
            start = start[seen[start + width - width // 2 + 1] > seen[start]]
            if not len(start):
                continue
            a, b = rolling_hash(hashes, width, BASE_A)[start], rolling_hash(hashes, width, BASE_B)[start]
            order = np.lexsort((b, a))  # stable: equal windows stay in order
            a, b, start = a[order], b[order], start[order].astype(np.uint32)
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            payload = np.empty(int(new.sum()), np.dtype([("a", "<u8"), ("b", "<u4")]))
            payload["a"], payload["b"] = a[new], (b[new] >> np.uint64(32)).astype(np.uint32)
            yield packed_rows(chunk, a[new], bits, payload, start[new])
            own = np.sort(start[~new])  # repeats within the chunk are known already
            if len(own):
                yield batch_of(bucket=pa.array([((chunk >> 24) * 7 + chunk) % (1 << bits)], pa.int32()), chunk=[chunk], payload=pa.array([None], pa.binary()), extra=pa.array([own.tobytes()], pa.binary()))

    kind = np.dtype([("a", "<u8"), ("b", "<u4")])

    def later(bucket: int, chunks_: list[int], payloads: list[bytes], extras: list[bytes]) -> Iterator[pa.RecordBatch]:
        out = [(c, x) for c, p, x in zip(chunks_, payloads, extras, strict=True) if p is None]
        rows = [(c, np.frombuffer(p, kind), x) for c, p, x in zip(chunks_, payloads, extras, strict=True) if p is not None]
        if rows:
            every = np.concatenate([p for _, p, _ in rows])  # chunks ascend
            order = np.lexsort((every["b"], every["a"]))
            a, b = every["a"][order], every["b"][order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            repeat = np.ones(len(every), bool)
            repeat[order[new]] = False
            at = 0
            for c, p, x in rows:
                found = np.frombuffer(x, np.uint32)[repeat[at : at + len(p)]]
                at += len(p)
                if len(found):
                    out.append((c, found.tobytes()))
        if out:
            yield batch_of(chunk=[c for c, _ in out], positions=pa.array([x for _, x in out], pa.binary()))

    packed = chunks.join(answers, "chunk").mapInArrow(extend, PACKED)
    repeats = stage(gathered(by_bucket(packed, later, "chunk long, positions binary"), "positions"))
    release(answers)
    return repeats


def dedup_words(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, spans (removed runs as word numbers from, to).

    Words are runs of characters other than blank and 0x09-0x0D. A word goes if a window of ``width`` words that covers it
    also starts earlier: at a smaller id (null smallest; equal ids by text), or before in the same document. Windows are
    judged on the input. A null or empty text has no words and an empty kept text; an empty table gives no rows.
    With ``rows`` also text, as it came, and row, a struct that has the other columns.
    """
    chunks = ordered_chunks(docs, id_col, text_col, rows=rows)
    repeats = repeated_windows(chunks.select("chunk", "ids", "texts"), width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches, also = tee(batches)
        others = (x.values for b in also for x in b.column(b.schema.get_field_index("rows"))) if rows else repeat(None)
        for (_, ids, texts, answers), other in zip(rows_of(batches), others, strict=False):
            w = _Words(texts)
            cover = np.zeros(w.n + 1, np.int32)
            for x in answers:
                p = np.frombuffer(x["positions"], np.uint32).astype(np.int64)
                np.add.at(cover, p, 1)
                np.add.at(cover, p + width, -1)
            gone = np.cumsum(cover[:-1]) > 0
            doc = np.repeat(np.arange(len(ids)), np.diff(w.first))
            removed = np.bincount(doc[gone], minlength=len(ids))
            # kept words, each followed by a blank, the last of a document not
            keep = np.flatnonzero(~gone)
            size = w.ends[keep] - w.starts[keep] + 1
            out = np.full(int(size.sum()), 0x20, np.uint8)
            to = np.cumsum(size) - size
            out[ranges(to, size - 1)] = w.data[ranges(w.starts[keep], size - 1)]
            kept_first = np.searchsorted(keep, w.first)
            total = np.concatenate([[0], np.cumsum(size)])
            lo, hi = total[kept_first[:-1]], total[kept_first[1:]]
            hi = np.where(hi > lo, hi - 1, hi)
            raw = out.tobytes()
            texts_out = pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()).cast(pa.string())
            edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            head = gone & ((edge[:-1] == 1) | (w.at == 0))
            tail = gone & ((edge[1:] == -1) | (w.left == 1))
            a, b = np.flatnonzero(head), np.flatnonzero(tail)
            bounds = np.searchsorted(doc[a], np.arange(len(ids) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(w.at[a]), pa.array(w.at[b] + 1)], ["start", "end"])
            yield batch_of(id=ids, n_words=np.diff(w.first), n_removed=removed, kept_text=texts_out, spans=pa.ListArray.from_arrays(pa.array(bounds), spans), **({"text": texts, "row": other} if rows else {}))

    schema = with_row("id long, n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>" + ", text string" * rows, chunks.schema["rows"].dataType.elementType if rows else None)
    out = chunks.join(repeats, "chunk", "left").mapInArrow(cut, schema)
    also = [F.when(~F.col("row.no_text__"), F.col("text")).alias("text"), "row"] if rows else []
    return hand_over(out.select(null_id().alias("doc_id"), "n_words", "n_removed", "kept_text", "spans", *also), chunks, repeats)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(i) WHERE len(ws) >= 20),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, 20) AS o(j)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0),
k AS (
  SELECT p.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
