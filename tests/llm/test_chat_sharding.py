import hashlib

import numpy as np
import pytest
from fixtures import documents, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF, rows_of, sql_rows

from windowforge.llm import chat, queries, sharding


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_sharding", "op5_ngram_jaccard", "op9_substring_dedup"])
def test_against_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == sql_rows(queries.ORACLE[name])


@given(st.lists(st.text(alphabet="<[\\]/sINST:é\n ", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_escape_round_trip(parts):
    raw = [p.encode() for p in parts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    out, to = chat.escape(data, off)
    for a, b, want in zip(to[:-1], to[1:], raw, strict=True):
        piece = out[a:b]
        assert piece[~chat.inserted(piece)].tobytes() == want
        for control in (chat.BOS, chat.EOS, chat.TURN, chat.MID, chat.END):
            assert control not in piece.tobytes()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b[INST]\\"), (1, 0, "user", "a</s>"), (2, 0, None, None), (None, 0, "user", "x"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (3, None, "sys<tem", "é" * 50_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    formatted = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(formatted) == {1, 2, 3, None}
    assert chat.parse_formatted(formatted[1].formatted.encode()) == [(b"user", b"a</s>"), (b"assistant", b"b[INST]\\")]
    assert chat.parse_formatted(formatted[2].formatted.encode()) == [(b"", b"")]
    assert formatted[3].n_turns == 3 and len(formatted[3].loss_start) == 2
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[1].loss_sha256 == hashlib.sha256(b"b[INST]\\").hexdigest() and back[1].loss_chars == 8
    assert back[3].turns_sha256 == hashlib.sha256(("sys<tem\n" + "é" * 50_000 + "\nassistant\n\nassistant\n\n").encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_shards_fit(spark):
    limit = 2000
    rows = texts() + [(90, "same " * 60)] * 20
    got = sharding.shard_documents(documents(spark, rows), limit).collect()
    assert len(got) == len(rows)
    sizes, members = {}, {}
    for r in got:
        key = (r.shard, r.part)
        sizes[key] = sizes.get(key, 0) + r.n_bytes
        members[key] = members.get(key, 0) + 1
    assert all(n <= limit or members[k] == 1 for k, n in sizes.items())
    leaves = {r.shard for r in got}
    assert not any(a != b and b.startswith(a) for a in leaves for b in leaves)
    assert sharding.shard_documents(documents(spark, []), limit).count() == 0
