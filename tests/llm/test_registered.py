"""Registered queries without SQL against the tokenizers themselves, over whole tables; repeated ids by value."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures import documents, texts
from oracle import SF, rows_of, sql_rows
from tokenizers import Tokenizer

from windowforge.llm import packing, token_files, tokens
from windowforge.llm.queries import ORACLE, QUERIES


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(params=["table", "odd rows"])
def table(request, spark, tmp_path):
    """A folder with documents, and its rows."""
    if request.param == "table":
        return SF, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pq.write_table(documents(spark).toArrow(), f"{tmp_path}/documents.parquet")
    return str(tmp_path), texts()


def test_op6_against_the_tokenizer(spark, table):
    folder, rows = table
    plain = Tokenizer.from_file(tokens.default_path("word_bpe_49k.json"))
    got = sorted(token_files_rows(spark, folder), key=lambda r: r[1])
    own = Counter((i, len(ids), crc(ids)) for i, t in rows for ids in [plain.encode(t or "", add_special_tokens=False).ids + [1]])
    assert Counter((i, n, c) for i, _, n, c in got) == own
    assert [s for _, s, _, _ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    ids = [i for i, *_ in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def token_files_rows(spark, folder):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.op6_token_files(spark, folder).collect()]


def test_op10_against_the_tokenizer(spark, table):
    folder, rows = table
    plain, capacity = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json")), 1024
    got = packing.op10_best_fit_packing(spark, folder).collect()
    # pieces of a document: all of 1024 but the first; rows of one id are told apart by their values
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        n = -(-len(ids) // capacity)
        cuts = [0, *(len(ids) - capacity * (n - k) for k in range(1, n)), len(ids)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= capacity
    assert len(sequences) <= 1.01 * sum(r.length for r in got) / capacity + 1  # no packing has fewer than their sum needs


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op11_hard_negatives", "op13_dialogue_repair"])
def test_against_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == sql_rows(ORACLE[name])
