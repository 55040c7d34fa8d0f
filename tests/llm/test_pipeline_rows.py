"""Rows of the pipeline's stages where ids are null or repeated, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline as P
from fixtures import documents, texts
from test_dedup import one_order

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def first_of_groups(rows, words, percent):
    """Of each group of near duplicates the least row, ids before MD5s of texts; all rows without words."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    group = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and 100 * len(x & y) >= percent * len(x | y):
                group = [group[b] if g == group[a] else g for g in group]
    key = lambda k: (rows[k][0] is not None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).digest())
    least = {g: min((k for k in range(len(rows)) if group[k] == g), key=key) for g in set(group)}
    return Counter(rows[k] for k in range(len(rows)) if not sets[k] or least[group[k]] == k)


def test_toxic_rows_go_alone(spark):
    sf = "/root/testdata/sf0.01"
    docs = P.table(spark, sf, "documents").join(P.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    scored = P.score_documents(docs, P.train(docs, P.table(spark, sf, "labels")), rows=True).select("score", "row.*")
    toxic = scored.where("toxic = 1").orderBy("score").collect()[-1].text
    clean = [r.text for r in scored.where("toxic = 0").orderBy("score").limit(3).collect()]
    kept = [(None, clean[0]), (None, clean[1]), (7, clean[1]), (7, clean[2])]
    assert rows_of(P.toxicity(spark, documents(spark, [*kept, (None, toxic), (7, toxic)]), sf)) == Counter(kept)


def test_leaking_rows_go_alone(spark):
    item = P.table(spark, SF, "benchmark").where("length(text) > 100").orderBy("item_id").first().text
    kept = [(i, t) for i, t in texts() if i in (None, 4, 50, 51)] + [(None, "something else"), (None, None)]
    assert rows_of(P.decontamination(spark, documents(spark, [*kept, (None, item), (50, item)]), SF)) == Counter(kept)


def test_one_row_of_each_group_stays(spark):
    rows = texts() + [(None, "a text of its own"), (None, None), (None, ""), (51, None), (51, ""), (7, "x " * 30 + "y"), (7, texts()[6][1]), (25, "quite another text"), (20, texts()[-1][1])]
    assert rows_of(P.ngram_jaccard(spark, documents(spark, rows), SF)) == first_of_groups(rows, 5, 80)


def brute_cut(spark, docs):
    want, seen = Counter(), set()
    null = Counter(r.doc_id for r in docs.where("text IS NULL").collect())
    for i, t in one_order(spark, docs):
        w = [x for x in re.split("[ \\t\\n\\x0b\\x0c\\r]+", t) if x]
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        if t == "" and null[i]:
            null[i], t = null[i] - 1, None
        want[i, " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t] += 1
    return want


def test_cut_rows_keep_the_first_place(spark):
    line = texts()[6][1]
    docs = documents(spark, [*texts(), (7, line), (7, "before " + line), (None, line), (80, None), (80, line), (80, line + " end")])
    want = brute_cut(spark, docs)
    out = P.substring_dedup(spark, docs, SF)
    assert rows_of(out) == want
    assert out.where("text IS NOT NULL AND n_chars <> 0 AND n_chars <> length(text)").isEmpty() and out.columns == docs.columns


def test_run_against_brute_force(spark):
    """The whole pipeline on the small tables: what the toxicity network keeps, then all further stages in plain Python."""
    from test_search_models import brute_leaks
    from tokenizers import Tokenizer

    from windowforge.llm import tokens

    docs = P.table(spark, SF, "documents")
    kept = P.stage(P.toxicity(spark, docs, SF))
    scores = P.score_documents(docs, P.train(docs, P.table(spark, SF, "labels")))
    assert rows_of(kept) == rows_of(docs.join(scores.where("score < 0.5").select("doc_id"), "doc_id"))
    rows = list(first_of_groups([(r.doc_id, r.text) for r in kept.collect()], 5, 80).elements())
    rows = list(brute_cut(spark, documents(spark, rows)).elements())
    leaks = dict(brute_leaks(rows, [tuple(r) for r in P.table(spark, SF, "benchmark").select("item_id", "text").collect()]))
    plain, want = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json")), Counter()
    for i, t in rows:
        if not leaks[i]:
            ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
            first, at = (len(ids) - 1) % 1024 + 1, 0
            for k, n in enumerate([first, *[1024] * ((len(ids) - first) // 1024)]):
                want[i, k, at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + n]))] += 1
                at += n
    got = P.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert any(leaks.values()) and len(rows) < docs.count()
