import numpy as np
import pytest
from fixtures import documents, sha

from windowforge.llm import ngram_join, substring_dedup, suffix_dedup
from windowforge.llm.components import components


def by_text(rows, df):
    """Rows of one id come back in the operator's order: answers are compared as multisets."""
    return sorted(map(str, rows)), sorted(map(str, (tuple(r) for r in df.collect())))


def one_order(spark, docs):
    """The rows in the order that the operators use: null ids first, equal ids by a hash of their texts."""
    from pyspark.sql import functions as F

    from windowforge.llm.common import id_text, null_id

    return [(r.doc_id, r.text) for r in id_text(docs).orderBy("id", F.xxhash64("text")).select(null_id().alias("doc_id"), "text").collect()]


def brute_bytes(rows, width):
    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - width + 1):
            k = b[p : p + width]
            if k in seen:
                cover[p] += 1
                cover[p + width] -= 1
            seen.add(k)
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def brute_words(rows, width):
    seen, out = set(), []
    for i, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            if k in seen:
                gone[p : p + width] = [True] * width
            seen.add(k)
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def test_bytes(spark):
    docs = documents(spark)
    got = suffix_dedup.dedup_bytes(docs).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long)", "sha2(kept, 256)")
    want, have = by_text(brute_bytes(one_order(spark, docs), 100), got)
    assert want == have
    assert suffix_dedup.dedup_bytes(documents(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [40, 1 << 20])
@pytest.mark.parametrize("width", [1, 2, 7, 8, 11, 13])
@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh"])
def test_merged_transforms(shard, width, letters):
    rng = np.random.default_rng(3)
    segments = [bytes(rng.choice(np.frombuffer(letters, np.uint8), rng.integers(1, 40))) for _ in range(50)]
    for times in (None, rng.integers(1, 3, 50)):
        groups = {}
        for i, owner, offset in zip(*suffix_dedup.repeated(segments, width, shard, times), strict=True):
            groups.setdefault(i, set()).add((int(owner), int(offset)))
        want = {}
        for i, s in enumerate(segments):
            for p in range(len(s) - width + 1):
                want.setdefault(s[p : p + width], set()).add((i, p))
        many = lambda v: len(v) > 1 or times is not None and times[next(iter(v))[0]] > 1
        assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if many(v))


def test_common_prefixes():
    rng = np.random.default_rng(5)
    strings = [bytes(rng.choice(np.frombuffer(b"ab", np.uint8), rng.integers(1, 30))) for _ in range(20)]
    transforms, heads, suffixes = [], [], []
    for part in (strings[:7], strings[7:12], strings[12:]):
        lengths = np.array([len(s) + 1 for s in part])
        text = np.frombuffer(b"\xff".join(part) + b"\xff", np.uint8) + np.uint8(1)
        order, transform, head = suffix_dedup.shard_transform(text, np.cumsum(lengths) - lengths)
        heads.append(head)
        own = b"\xff".join(part) + b"\xff"
        transforms.append(transform)
        suffixes += [own[k:].split(b"\xff")[0] for k in order]
    at, begins, prefix = suffix_dedup.merge_transforms(transforms, heads, 14)
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
    for i, s in enumerate(suffixes):
        nearest = max(same(s, t) for j, t in enumerate(suffixes) if j != i)
        assert prefix[i] == next(k for k in (14, 10, 8, 0) if nearest >= k)
    assert {suffixes[k][:14] for k in at[begins]} == {s[:14] for s in suffixes if sum(len(t) >= 14 and t[:14] == s[:14] for t in suffixes) > 1}


def test_words(spark):
    docs = documents(spark)
    got = substring_dedup.dedup_words(docs).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256)")
    want, have = by_text(brute_words(one_order(spark, docs), 20), got)
    assert want == have
    spans = substring_dedup.dedup_words(docs).collect()
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in spans)
    assert substring_dedup.dedup_words(documents(spark, [])).count() == 0


def brute_near(rows, words, percent):
    sets = []
    for i, t in rows:
        w = t.encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    least = lambda i: (i is not None, i or 0)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    groups = {}
    for a in range(len(sets)):
        groups.setdefault(find(a), []).append(sets[a][0])
    return [(i, len(s), min(groups[find(a)], key=least)) for a, (i, s) in enumerate(sets)]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 60), (2, 30)])
def test_near(spark, words, percent):
    docs = documents(spark)
    got = ngram_join.near_duplicates(docs, words, percent).select("doc_id", "n_shingles", "component_id")
    want, have = by_text(brute_near(one_order(spark, docs), words, percent), got)
    assert want == have
    assert ngram_join.near_duplicates(documents(spark, [])).count() == 0


def test_similar_sets_share_signatures():
    rng = np.random.default_rng(0)
    for percent in (80, 85, 50):
        bands = ngram_join.Bands(percent)
        for n in (1, 2, 3, 5, 7, 8, 12, 40, 300):
            for _ in range(40):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                gone = rng.integers(0, n * (100 - percent) // 100 + 1)
                more = rng.integers(0, max(1, n // 4) + 1)
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, more, dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common < percent * (len(a) + len(b) - common) or np.array_equal(a, b):
                    continue
                assert np.intersect1d(bands.signatures(a), bands.signatures(b)).size
                x, y = ngram_join.sketch(a), ngram_join.sketch(b)
                folded = ngram_join._folded([x, y])
                assert np.bitwise_count(folded[0] ^ folded[1]).sum() <= len(a) + len(b) - 2 * common


def test_large_groups_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 3)
    docs = documents(spark)
    want, have = by_text(brute_near(one_order(spark, docs), 2, 30), ngram_join.near_duplicates(docs, 2, 30).select("doc_id", "n_shingles", "component_id"))
    assert want == have


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(100, 99), (99, 98)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert all(got[i] == 10 for i in range(10, 41)) and got[100] == 98
    assert components(links.limit(0)).count() == 0
