"""Chat formatting by columnar byte assembly.

A conversation becomes ``<s>`` + turns + ``</s>``, a turn ``[INST]`` role ``[:]`` text ``[/INST]``. In roles and texts a
backslash follows every ``<``, ``[`` and backslash, so that no control string can stand inside them, and the escape can be
undone exactly. All bytes of a batch are placed by cumulative offsets into one preallocated Arrow buffer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.llm.common import NULL_ID, batch_of, column, n_partitions, null_id, ranges, table, text_buffer

BOS, EOS, TURN, MID, END = b"<s>", b"</s>", b"[INST]", b"[:]", b"[/INST]"
BACKSLASH = 0x5C
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[0x3C, 0x5B, BACKSLASH]] = True


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A backslash behind each special byte; returns bytes and row offsets."""
    special = _SPECIAL[data]
    grown = np.concatenate([[0], np.cumsum(special, dtype=np.int64)])
    out = np.full(len(data) + int(grown[-1]), BACKSLASH, np.uint8)
    out[np.arange(len(data)) + grown[:-1]] = data
    return out, offsets + grown[offsets]


def inserted(data: np.ndarray) -> np.ndarray:
    """Which bytes of a formatted buffer are escapes: each second one of a run of backslashes, counted from a ``<`` or ``[`` before it."""
    slash = data == BACKSLASH
    before = np.concatenate([[False], slash[:-1]])
    first = np.flatnonzero(slash & ~before)
    at = np.flatnonzero(slash)
    run = np.searchsorted(first, at, side="right") - 1
    lead = np.zeros(len(first), np.int64)
    lead[first > 0] = _SPECIAL[data[first[first > 0] - 1]]
    out = np.zeros(len(data), bool)
    out[at] = (at - first[run] + lead[run]) % 2 == 1
    return out


FORMATTED = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


def _assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Whole conversations, turn by turn in order, to one row each."""
    n = len(conv)
    raw_role, role_at = text_buffer(roles)
    role_buf, role_off = escape(raw_role, role_at)
    text_buf, text_off = escape(*text_buffer(texts))
    role_len, text_len = np.diff(role_off), np.diff(text_off)
    first = np.concatenate([[True], conv[1:] != conv[:-1]])
    last = np.concatenate([first[1:], [True]])
    sizes = np.stack([first * len(BOS), np.full(n, len(TURN)), role_len, np.full(n, len(MID)), text_len, np.full(n, len(END)), last * len(EOS)], axis=1)
    at = np.concatenate([[0], np.cumsum(sizes.ravel())])
    starts = at[:-1].reshape(n, 7)
    out = np.empty(int(at[-1]), np.uint8)
    for k, const in ((0, BOS), (1, TURN), (3, MID), (5, END), (6, EOS)):
        rows = np.flatnonzero(sizes[:, k])
        out[(starts[rows, k, None] + np.arange(len(const))).ravel()] = np.tile(np.frombuffer(const, np.uint8), len(rows))
    out[ranges(starts[:, 2], role_len)] = role_buf
    out[ranges(starts[:, 4], text_len)] = text_buf

    head = np.flatnonzero(first)
    begin = starts[head, 0]
    off = np.concatenate([begin, [len(out)]])
    whole = pa.LargeStringArray.from_buffers(len(head), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out))
    own = np.cumsum(first) - 1
    trained = np.flatnonzero(pa.compute.equal(roles, "assistant").to_numpy(zero_copy_only=False))
    bounds = np.searchsorted(own[trained], np.arange(len(head) + 1)).astype(np.int32)
    lo = starts[trained, 4] - begin[own[trained]]
    span = lambda v: pa.ListArray.from_arrays(pa.array(bounds), pa.array(v))
    return batch_of(conv_id=conv[head], n_turns=np.diff(np.concatenate([head, [n]])), formatted=whole.cast(pa.string()), loss_start=span(lo), loss_end=span(lo + text_len[trained]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to one row per conversation: conv_id, n_turns, formatted, loss_start, loss_end.

    Turns are ordered by (turn, role, text), a null turn first. A null role or text is empty; a null conv_id is a
    conversation of its own and stays null. Repeated rows are turns of their own. The spans of the loss mask are bytes
    of ``formatted``: the assistant's texts. An empty table gives no rows. A conversation is one string, so it has to fit a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the conversation that the last batch broke off in
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            conv = column(b, "conv_id")
            change = np.flatnonzero(conv != conv[-1])
            known = held[0].column(0)[0].as_py()
            if len(change) or known != conv[-1]:
                done = int(change[-1]) + 1 if len(change) else 0
                whole = pa.Table.from_batches([*held[:-1], b.slice(0, done)]).combine_chunks()
                yield _assemble(whole.column(0).to_numpy(), whole.column(1).combine_chunks(), whole.column(2).combine_chunks())
                held = [b.slice(done)]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield _assemble(whole.column(0).to_numpy(), whole.column(1).combine_chunks(), whole.column(2).combine_chunks())

    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    spread = rows.repartition(n_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return spread.select("conv_id", "role", "text").mapInArrow(run, FORMATTED).withColumn("conv_id", null_id("conv_id"))


def parse_formatted(data: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts of one formatted conversation."""
    raw = np.frombuffer(data, np.uint8)
    return _parse(raw, inserted(raw), 0, len(raw))


def _parse(raw: np.ndarray, skip: np.ndarray, start: int, end: int) -> list[tuple[bytes, bytes]]:
    part, hidden = raw[start:end], skip[start:end]
    follow = np.concatenate([hidden[1:], [False]])
    control = np.flatnonzero((part == 0x5B) & ~follow)  # brackets that no escape follows
    out = []
    clear = lambda a, b: part[a:b][~hidden[a:b]].tobytes()
    for a, b, c in control.reshape(-1, 3).tolist():
        out.append((clear(a + len(TURN), b), clear(b + len(MID), c)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings hold, parsed from their bytes alone and the spans of the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw, off = text_buffer(b.column(1))
            skip = inserted(raw)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            lo, hi = b.column(2), b.column(3)
            turns, n, loss, loss_n = [], [], [], []
            for i in range(b.num_rows):
                parts = _parse(raw, skip, int(off[i]), int(off[i + 1]))
                n.append(len(parts))
                turns.append(hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in parts)).hexdigest())
                under = [raw[off[i] + s : off[i] + e][~skip[off[i] + s : off[i] + e]] for s, e in zip(lo[i].as_py(), hi[i].as_py(), strict=True)]
                text = np.concatenate(under) if under else np.zeros(0, np.uint8)
                loss.append(hashlib.sha256(text.tobytes()).hexdigest())
                loss_n.append(int(((text & 0xC0) != 0x80).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(turns), pa.array(loss_n, pa.int64()), pa.array(loss), pa.array(chars[off[1:]] - chars[off[:-1]])], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kept = formatted.select("conv_id", "formatted", "loss_start", "loss_end")
    return kept.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    return read_back(format_conversations(turns.unionByName(probe)))


ORACLE_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body) + 16 * count(*) + 7 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
