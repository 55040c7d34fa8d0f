"""Pieces, spans and decoded texts against the library itself."""

import random

import numpy as np
import pytest
import sentencepiece as spm
from fixtures import documents, sha, texts
from oracle import SF
from sentencepiece import sentencepiece_model_pb2 as files

from windowforge.llm import sentence_pieces as S
from windowforge.llm.tokens import default_path

PATH = default_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "▁", "a▁ b", "▁▁x ▁ y", "\0a", "</s> <s> <unk>", "日本 語 テキスト", "é́ 🎉🎉  x", "\n\n\ta  b   c", "1234 567", "<0x41>", "x" * 5000, " " * 5000, "é " * 400]


def many():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("ab  ▁é日🎉\n\t.ﬁ①Ａ　 ̈") for _ in range(rng.randint(0, 40))) for _ in range(800)]


def buffers(rows):
    parts = [t.encode() for t in rows]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


@pytest.mark.parametrize("entries", [50, 1 << 20])
def test_ids_are_the_library_s(entries):
    model, plain, rows = S.PieceModel(PATH, entries), spm.SentencePieceProcessor(model_file=PATH), many()
    for part in (rows, rows[::-1], rows[:1], []):
        ids, first, starts, ends = model.encode(*buffers(part))
        for i, t in enumerate(part):
            own = slice(first[i], first[i + 1])
            assert ids[own].tolist() == plain.encode(t), repr(t)
            # spans cover the text from end to end
            if t:
                assert starts[own][0] == 0 and ends[own][-1] == len(t.encode()) and (ends[own][:-1] == starts[own][1:]).all()


def test_spans_are_the_pieces_own_bytes():
    model, text = S.PieceModel(PATH), "Hello wörld  日本🎉"
    ids, _, starts, ends = model.encode(*buffers([text]))
    shown = [text.encode()[a:b] for a, b in zip(starts, ends, strict=True)]
    for i, own in zip(ids.tolist(), shown, strict=True):
        piece = model.processor.id_to_piece(i)
        assert own.decode(errors="replace").replace(" ", "▁") in (piece, piece[1:]) or piece.startswith("<0x") and own == bytes([int(piece[3:5], 16)])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("tidy", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("escape", [True, False])
def test_normalised_with_offsets(rule, tidy, prefix, escape):
    library = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=escape, remove_extra_whitespaces=tidy)
    model = files.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    rows = many()
    flat, at, align = S.Normaliser(model.normalizer_spec)(*buffers(rows))
    for i, t in enumerate(rows):
        text, offsets = library.normalize(t, with_offsets=True)
        mine = flat[at[i] : at[i + 1]].tobytes().decode()
        assert mine == text
        if text:
            chars = np.cumsum([0] + [len(c.encode()) for c in mine])
            assert [len(t.encode()[:x].decode()) for x in align[at[i] + i :][chars]] == offsets


def answers(rows):
    plain = spm.SentencePieceProcessor(model_file=PATH)
    out = []
    for i, t in rows:
        ids = plain.encode(t or "", add_eos=True)
        out.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(plain.decode(ids).encode())))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    got = S.op12_sentence_pieces(spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == answers(rows)


def test_odd_rows(spark, monkeypatch, tmp_path):
    """Null and repeated ids, null and empty texts, clashing columns, an empty table."""
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, S.op12_sentence_pieces(spark, str(tmp_path)).collect()), key=str) == answers(texts())
    assert S.encode_documents(documents(spark, []), PATH).count() == 0
    (r,) = S.encode_documents(documents(spark, [(None, None)]), PATH).collect()
    assert (r.doc_id, r.ids, r.starts, r.ends, r.decoded) == (None, [2], [0], [0], "")
