import numpy as np
from fixtures import documents, texts
from pyspark.sql import functions as F

from windowforge.llm import decontamination as D
from windowforge.llm import neighbours as N
from windowforge.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def test_wand_finds_all():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(400)]
    items = [" ".join(rng.choice(words[: rng.integers(20, 400)], rng.integers(1, 50))) for _ in range(90)]
    ix = D.Index(list(range(90)), items, [""] * 90)
    for _ in range(150):
        terms = np.unique(rng.choice(len(ix.terms), rng.integers(1, 60)))
        score = np.zeros(90)
        for t in terms:
            score[ix.item[ix.post[t] : ix.post[t + 1]]] += ix.impact[ix.post[t] : ix.post[t + 1]]
        for threshold in (0.1, 0.3, 0.6):
            got = ix.wand(terms, threshold)
            assert sorted(i for i, _ in got) == np.flatnonzero(score >= threshold - 1e-6).tolist()
            assert all(abs(s - score[i]) < 1e-9 for i, s in got)


def test_search_is_every_passage():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    import pyarrow as pa

    items = [" ".join(rng.choice(words, 12)) for _ in range(30)]
    ix = D.Index(list(range(30)), items, [""] * 30)
    docs = [" ".join(rng.choice(words, n)) for n in (0, 1, 31, 32, 33, 64, 65, 200, 1000)]
    hashes, first = D._words(pa.array(docs))
    got = {(t, lo, item) for t, lo, _, item, _ in ix.search(hashes, first, 0.5)}
    half, want = ix.passage // 2, set()
    for t in range(len(docs)):
        own = hashes[first[t] : first[t + 1]]
        for k in range(max(1, -(-len(own) // half))):
            terms = np.flatnonzero(np.isin(ix.terms, own[k * half : k * half + ix.passage]))
            want |= {(t, int(first[t]) + k * half, i) for i, _ in ix.wand(terms, 0.5)}
    assert got == want


def test_leaks(spark, monkeypatch):
    items = [(i, t) for i, t in enumerate(["Which of these alpha beta gamma delta epsilon zeta is it? The answer is eta theta iota kappa.", "quick brown fox jumps over the lazy dog again. It runs home slowly and sleeps", "", None, "!!!"])]
    table = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, doc_id string")
    rows = texts() + [(70, "a b c " * 50 + items[0][1].upper() + " d e f" * 90), (71, items[1][1] + " " + items[0][1]), (72, "Which of these alpha beta gamma"), (None, items[1][1])]
    for size, sent, group in ((128 << 10, 1 << 30, 1 << 30), (10, 1 << 30, 50), (10, 1, 1 << 30)):
        monkeypatch.setattr(D, "INDEX_BYTES", size)
        monkeypatch.setattr(D, "MOST_SENT", sent)
        monkeypatch.setattr(D, "GROUP_BYTES", group)
        got = D.find_leaks(documents(spark, rows), D.build_indexes(table)).where("n_items > 0").collect()
        assert sorted((str(r.doc_id), r.item_ids) for r in got) == [("70", [0]), ("71", [0, 1]), ("None", [1])]
    assert D.find_leaks(documents(spark, rows), D.build_indexes(table.limit(0))).where("n_items > 0").isEmpty()
    assert D.find_leaks(documents(spark, []), D.build_indexes(table)).count() == 0


def brute_leaks(docs, items, threshold=0.5):
    """BM25 of every item for every passage, in plain Python, and shares of n-grams."""
    import math
    import re
    from collections import Counter

    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {(x,) for x in w}
    split = {i: D.split_item(t or "") for i, t in items}
    own = {i: words(" ".join(split[i])) for i, _ in items}
    own = {i: w for i, w in own.items() if w}
    df, mean = Counter(x for w in own.values() for x in set(w)), sum(map(len, own.values())) / max(1, len(own))
    weight = {i: {x: math.log1p((len(own) - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, f in Counter(w).items()} for i, w in own.items()}
    half, out = max(64, 2 * max(map(len, own.values()))) // 2, []
    for d, t in docs:
        w, hit = words(t), set()
        for k in range(0, max(1, len(w)), half):
            part = w[k : k + 2 * half]
            seen, five = set(part), grams(part) if len(part) >= 5 else set()
            for i, x in weight.items():
                if sum(v for y, v in x.items() if y in seen) / sum(x.values()) >= threshold - 1e-6:
                    q, a = (words(y) for y in split[i])
                    a = own[i] if len(a) < 5 else a
                    share = lambda g: max(sum(y in five for y in g) / len(g), sum(y[0] in seen for y in g) / len(g) if len(next(iter(g))) == 1 else 0) if g else 1
                    if share(grams(q)) >= 0.5 and share(grams(a)) >= 0.5:
                        hit.add(i)
        out.append((d, sorted(hit)))
    return out


def test_query_against_brute_force(spark, tmp_path):
    """The registered query on the small table, whole, and on odd documents."""
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text"))))
    got = sorted((r.doc_id, r.item_ids) for r in D.op7_decontamination(spark, sf).collect())
    assert got == sorted(brute_leaks(docs, items)) and any(x for _, x in got)
    odd = [*texts(), *((900 + i, " ".join((t or "").split()[:-1])) for i, t in items[:40])]
    have = D.find_leaks(documents(spark, odd), D.build_indexes(spark.read.parquet(f"{sf}/benchmark.parquet"))).collect()
    assert sorted((str(r.doc_id), r.item_ids) for r in have) == sorted((str(d), x) for d, x in brute_leaks(odd, items))


def test_sent_indexes_are_small(spark):
    import pickle

    table = spark.read.parquet(f"{SF}/benchmark.parquet")
    size = sum(len(r.text) for r in table.collect())
    (indexes,) = D.build_indexes(table).passes()
    assert len(pickle.dumps(indexes)) < 25 * size


def test_whole_items_are_found(spark):
    import duckdb

    docs, items = (duckdb.sql(f"SELECT * FROM '{SF}/{t}.parquet'").fetchall() for t in ("documents", "benchmark"))
    want = {d[0]: [i for i, t in items if t in d[1]] for d in docs}
    got = {r.doc_id: r.item_ids for r in D.op7_decontamination(spark, SF).collect()}
    assert all(set(want[k]) <= set(got[k]) for k in want)
    assert sum(bool(got[k]) and not want[k] for k in want) <= 2


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((1500, 12)).astype(np.float32)
    v[100:500] = v[100]  # a hot vector
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(2000, None, 1), (2050, [0.0] * 12, 1), (2100, [float("nan")] + [1.0] * 11, 1), (2150, [None] + [1.0] * 11, 1), (2200, [1.0] * 5, 1), (None, [1.0] * 12, 1)]
    got = N.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int"), 50).toPandas()
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hit = total = 0
    for q in range(0, 1500, 50):
        score = np.round(unit @ unit[q], 9)
        score[q] = -2
        best = np.lexsort((np.arange(1500), -score))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in own.vec_id.tolist()
        assert np.allclose(own.score, [unit[q] @ unit[k] for k in own.vec_id])
        if 100 <= q < 500:
            assert own.vec_id.tolist() == [k for k in range(100, 106) if k != q][:5]
        hit += len(set(own.vec_id) & set(best))
        total += 5
    assert hit / total >= 0.9 and set(got.query_id) == set(range(0, 1500, 50))


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in N.search(few, 50).collect()}
    assert got == {(0, 1): 3, (0, 2): 50, (50, 1): 3, (50, 2): 0}
    assert N.search(few.limit(0), 50).count() == 0


def test_rows_of_one_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.9, 0.1]), (50, [0.0, 1.0]), (7, [0.0, 0.9]), (7, [0.0, 0.8])]
    got = N.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50, k=2).collect()
    by_row = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_row.setdefault(r.query_row, []).append(r.vec_id)
    assert len(by_row) == 3 and sorted(by_row.values()) == [[7, 7], [50, 7], [50, 7]]
    assert all(r.query_id == 50 for r in got)


def test_recall(spark):
    """All queries of sf0.1 against brute force, with few vectors scored exactly."""
    sf = "/root/testdata/sf0.1"
    d = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    assert 5 * N.POOL <= 0.03 * len(d)
    x = np.stack(d.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = N.op8_nearest_neighbours(spark, sf).toPandas()
    hit = total = 0
    for i in np.flatnonzero(d.vec_id % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        own = got[got.query_id == d.vec_id[i]].sort_values("rank")
        assert np.allclose(own.score, np.sort(s[own.vec_id.map(dict(zip(d.vec_id, range(len(d)), strict=True)))])[::-1], atol=1e-12)
        hit += len(set(d.vec_id[np.argsort(-s)[:5]]) & set(own.vec_id))
        total += 5
    assert hit / total >= 0.9


def numeric_gradients_agree(net, w, start, length, y, weight):
    g = net.gradients(w, start, length, y, weight)

    def loss():
        z = net.forward(net.tables(net.inputs(w)[0]), net.index(w, start, length), length).astype(np.float64)
        p = 1 / (1 + np.exp(-z))
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())

    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name in ("ew", "ec") and at[0] == 0:
                continue
            keep = value[at]
            value[at] = keep + 1e-2
            up = loss()
            value[at] = keep - 1e-2
            down = loss()
            value[at] = keep
            assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at]), name


def test_gradients():
    import pyarrow as pa

    w = X.Words(pa.array(["you are a nice person and kind", "you idiot are a clown, really a very bad clown of all the clowns here", "one"]))
    net = X.Network(w.words[::2], np.unique(w.parts)[::3], np.ones(len(w.words[::2]), np.float32), np.ones(len(np.unique(w.parts)[::3]), np.float32))
    _, start, length = w.windows()
    y = np.array([0, 1, 0], np.float32)[: len(start)]
    numeric_gradients_agree(net, w, start, length, y, np.ones(len(y), np.float32))


def test_windows_cover_everything():
    import pyarrow as pa

    w = X.Words(pa.array(["", " ".join("w%d" % i for i in range(100)), "a", None, " ".join("v" * k for k in range(1, 33))]))
    doc, start, length = w.windows()
    seen = [set() for _ in range(5)]
    for d, s, n in zip(doc, start, length, strict=True):
        seen[d] |= set(range(s, s + n))
    assert [len(x) for x in seen] == np.diff(w.first).tolist() == [0, 100, 1, 0, 32]


def test_scores(spark):
    docs = documents(spark)
    none = X.score_documents(docs, X.train(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert none.count() == len(texts()) and none.where("score <> 0").isEmpty()
    real, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    net = X.train(real, labels.unionByName(labels.limit(1).withColumn("toxic", F.lit(None).cast("int")).withColumn("doc_id", F.lit(None).cast("long"))))
    got = X.score_documents(docs, net).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
    bare = [r for r in got if r.doc_id in (1, 2, 3)]
    assert all(r.score == net.base and r.window_start is None for r in bare)
    assert X.score_documents(documents(spark, []), net).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.op4_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    pos, neg = rows[rows.toxic == 1].score.to_numpy(), rows[rows.toxic == 0].score.to_numpy()
    auc = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert auc > 0.9 and (rows.predicted == rows.toxic).mean() > 0.95


def brute_score(net, text):
    """The highest window's calibrated probability, step by step and number by number."""
    import math

    import pyarrow as pa

    w = X.Words(pa.array([text]))
    sig, dot = (lambda v: 1 / (1 + math.exp(-v))), (lambda v, m: [sum(float(a) * float(m[i][j]) for i, a in enumerate(v)) for j in range(len(m[0]))])
    p, best = net.p, None
    place = {int(k): i + 1 for i, k in enumerate(net.words)}, {int(k): i + 1 for i, k in enumerate(net.parts)}
    for _, start, length in zip(*w.windows(), strict=True):
        x = []
        for n in w.number[start : start + length]:
            parts = [p["ec"][place[1].get(int(k), 0)] for k in w.parts[n]]
            x.append([float(v) for v in p["ew"][place[0].get(int(w.words[n]), 0)]] + [float(sum(v)) / len(parts) for v in zip(*parts, strict=True)])
        states = []
        for d, steps in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            h, own = [0.0] * X.STATE, {}
            if d == "b":  # what stands behind the end of a window is padding, which the backward direction reads first
                for _ in range(X.WINDOW - length):
                    h = brute_step(p, d, [0.0] * 2 * X.EMBED, h, dot, sig)
            for t in steps:
                h = own[t] = brute_step(p, d, x[t], h, dot, sig)
            states.append(own)
        both = [states[0][t] + states[1][t] for t in range(length)]
        e = [sum(a * float(b) for a, b in zip(h, p["att"], strict=True)) for h in both]
        a = [math.exp(v - max(e)) for v in e]
        pooled = [sum(k * h[j] for k, h in zip(a, both, strict=True)) / sum(a) for j in range(2 * X.STATE)]
        logit = sum(v * float(o) for v, o in zip(pooled, p["out"], strict=True)) + float(p["bias"][0])
        best = logit if best is None else max(best, logit)
    return net.base if best is None else sig(net.calibration[0] * best + net.calibration[1])


def brute_step(p, d, x, h, dot, sig):
    import math

    s = X.STATE
    pre, g = [a + float(c) for a, c in zip(dot(x, p[f"w{d}"]), p[f"c{d}"], strict=True)], dot(h, p[f"u{d}"])
    z, r = [sig(pre[i] + g[i]) for i in range(s)], [sig(pre[s + i] + g[s + i]) for i in range(s)]
    c = [math.tanh(pre[2 * s + i] + r[i] * g[2 * s + i]) for i in range(s)]
    return [c[i] + z[i] * (h[i] - c[i]) for i in range(s)]


def test_toxicity_query_against_brute_force(spark):
    """All rows of the registered query: who is held out, and the score of every short text by plain arithmetic."""
    import zlib

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    net, got = X.train(docs, labels), {r.doc_id: r for r in X.op4_toxicity(spark, sf).collect()}
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")).collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
    for r in sorted(rows, key=lambda r: len(r.text))[:60]:
        assert abs(got[r.doc_id].score - brute_score(net, r.text)) < 1e-4


def test_a_long_labelled_text_keeps_its_class(spark):
    """Texts over every bound, repeated ids, and labels of both kinds: the sample is cut, never to nothing."""
    words = ["lovely", "garden", "quiet", "river"], ["awful", "scum", "vermin", "filth"]
    docs, labels = [], []
    for i in range(1, 121):
        toxic = i % 2
        long = i in (7, 8)
        docs.append((i, " ".join(words[toxic][(i + k) % 4] for k in range(400_000 if long else 40))))
        labels.append((i, toxic))
    docs += [(11, docs[10][1] + " zz"), (12, None)]
    labels += [(12, 1), (12, 0)]
    docs, labels = documents(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    for more in ({}, {"most_bytes": 1}, {"most_docs": 3, "most_chars": 100}, {"most_chars": 20}):
        net = X.train(docs, labels, **more)
        assert net is not None
    net = X.train(docs, labels)
    score = {r.doc_id: r.score for r in X.score_documents(docs.where("doc_id > 20"), net).collect()}
    assert min(s for i, s in score.items() if i % 2) > 0.5 > max(s for i, s in score.items() if not i % 2)
    again = X.train(docs.repartition(3), labels.repartition(2))
    assert {r.doc_id: r.score for r in X.score_documents(docs.where("doc_id > 20"), again).collect()} == score


def test_neighbours_over_several_shares_and_blocks(spark, monkeypatch):
    """No row of the index is copied, and what leaves the shares is bounded by the pools of a part of the rows; recall holds."""
    from windowforge.llm import shares

    monkeypatch.setattr(shares, "LEAST_ROWS", 512)
    rng = np.random.default_rng(8)
    n, every = 4000, 5
    vecs = rng.normal(size=(n, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    parts = shares.n_shares(n, 4)
    assert parts == 8 and n // every > 5 * N.BLOCK
    dealt = []
    plain = shares.past_shares

    def counting(members, asking, *more):
        out = plain(members, asking, *more)
        dealt.append((members.count(), out.count()))
        return out

    monkeypatch.setattr(N, "past_shares", counting)
    got = N.search(df, every).toPandas()
    assert dealt[-1][0] == n and all(a < n / 4 for a, _ in dealt[:-1]) and len(dealt) == 2
    assert dealt[-1][1] < n // every * 50 * parts
    unit = vecs.astype(np.float64) / np.linalg.norm(vecs.astype(np.float64), axis=1)[:, None]
    found = {(q, v) for q, v in zip(got.query_id, got.vec_id, strict=True)}
    best = 0
    for i in range(0, n, every):
        s = unit @ unit[i]
        s[i] = -2
        best += sum((i, int(j)) in found for j in np.argsort(-s, kind="stable")[:5])
    assert len(found) == n // every * 5 and best / len(found) >= 0.9
