import zlib

import numpy as np
import pytest
from fixtures import documents, texts
from tokenizers import Tokenizer

from windowforge.llm import packing, token_files, tokens

ODD = ["", " ", "a  b", "\n", "a \n b", " a", "a ", "x\n\ny", "a\xa0 \xa0b", "é́ ́x", "<|endoftext|> hi <|endoftext|>", "it's 'S 't", "A  B\x1c C\x1c", "Σας ΟΔΟΣ. 12 34", "THE. THE, x|. É. İ. ß.", "<|ENDOFTEXT|>. x<|endoftext|>|", "a. . , ,a A.", "zute,### Éauß*** eux%%%$ É,É É.é ÑÓ'' a-b --a- a_ _a 4,5 4... ǅab. ſt, Ÿ?!", "a\0b . \0 c\0."]


@pytest.mark.parametrize(("name", "glued"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_are_exact(name, glued):
    path = tokens.default_path(name)
    rng = np.random.default_rng(1)
    more = ["".join(rng.choice(list(" \nab's\xa0́É1<|\t\x1f.,"), rng.integers(0, 30))) for _ in range(500)]
    enc, plain = tokens.PieceEncoder(path, glued, entries=200), Tokenizer.from_file(path)
    for part in (ODD, more, [t or "" for _, t in texts()], more[::-1]):
        ids, off = enc.encode(part)
        for i, t in enumerate(part):
            assert ids[off[i] : off[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark):
    path = tokens.default_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in texts() if i not in (50, 51)]
    for capacity in (1024, 50):
        got = packing.pack_documents(documents(spark, rows), capacity).toPandas()
        for i, t in rows:
            ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
            own = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("piece")
            assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(-(-len(ids) // capacity)))
            assert (own.length.iloc[1:] == capacity).all()
            for p in own.itertuples():
                assert crc(ids[p.start : p.start + p.length]) == p.ids_crc32
        ordered = got.sort_values(["sequence_id", "offset"])
        assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
        assert got.groupby("sequence_id").length.sum().max() <= capacity
    assert packing.pack_documents(documents(spark, [])).count() == 0
    assert packing.pack_documents(documents(spark)).groupBy("doc_id", "piece").count().where("doc_id = 50").count() == 1


def test_fullest_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(200):
        room = int(rng.integers(1, 60))
        counts = np.zeros(61, np.int64)
        for x in rng.integers(1, 40, 6):
            counts[x] += 1
        sums = {0}
        for x in np.repeat(np.arange(61), counts).tolist():
            sums |= {s + x for s in sums}
        use = packing.fullest(counts, room)
        assert sum(a * n for a, n in use) == max(s for s in sums if s <= room)
        assert all(n <= counts[a] for a, n in use)


def test_token_files(spark):
    path = tokens.default_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in texts() if i not in (50, 51)]
    shards = token_files.write_shards(documents(spark, rows), path, shard_ids=500)
    assert shards.count() > 3
    got = {r.id: r for r in token_files.read_documents(shards).collect()}
    at = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        r = got[-(2**63) if i is None else i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert token_files.read_documents(token_files.write_shards(documents(spark, []), path)).count() == 0


@pytest.mark.parametrize("block", [1, 16, 1 << 13])
def test_wavelet_matrix(block):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.choice(np.array([0, 1, 5, 49407, 65535], np.uint16), n)
        wm = token_files.WaveletMatrix(token_files.WaveletMatrix.build(ids, np.array([3]), np.array([0, n]), block=block))
        assert wm.tokens().tolist() == ids.tolist() and [wm.access(i) for i in range(n)] == ids.tolist()
        for v in (0, 1, 5, 6, 65535):
            at = np.flatnonzero(ids == v).tolist()
            assert wm.count(v) == len(at) and [wm.locate(v, k) for k in range(len(at))] == at
            assert wm.count(v, n // 3, n // 2) == sum(n // 3 <= x < n // 2 for x in at)


def test_questions_read_few_blocks(spark, monkeypatch):
    ids = np.random.default_rng(1).integers(0, 49_000, 400_000).astype(np.uint16)
    file = token_files.WaveletMatrix.build(ids, np.array([1]), np.array([0, len(ids)]))
    wm, read = token_files.WaveletMatrix(file), []
    assert wm.directory_bytes() < len(file) / 100
    one = wm._block
    monkeypatch.setattr(wm, "_block", lambda level, k: read.append((level, k)) or one(level, k))
    assert wm.access(123_456) == ids[123_456] and len(read) == 16
    v = int(ids[77])
    assert wm.count(v) == (ids == v).sum() and wm.locate(v, 0) == np.flatnonzero(ids == v)[0]
    assert len(read) <= 16 + 3 * 32
    shards = token_files.write_shards(documents(spark), tokens.default_path("word_bpe_49k.json"), shard_ids=500)
    got = token_files.token_counts(shards, [1, 320]).groupBy("value").sum("n").collect()
    every = [i for r in shards.collect() for i in token_files.WaveletMatrix(r.file).tokens().tolist()]
    assert {r[0]: r[1] for r in got} == {v: every.count(v) for v in (1, 320)}
    assert token_files.read_documents(shards).count() == len(texts())
    assert sorted(r.n_tokens for r in token_files.read_documents(shards).where("id = 51").collect())[0] == 1


def test_wide_vocabularies_are_an_error(tmp_path):
    import json

    with open(tokens.default_path("word_bpe_49k.json")) as f:
        model = json.load(f)
    model["model"]["vocab"] |= {f"wide{i}</w>": i for i in range(len(model["model"]["vocab"]), 66_000)}
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(model))
    with pytest.raises(ValueError, match="beyond 16 bits"):
        tokens.PieceEncoder(str(path), False)
