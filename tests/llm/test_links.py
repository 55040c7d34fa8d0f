from collections import Counter

from fixtures import documents, texts

from windowforge.llm import ngram_join


def test_all_links_are_counted(spark):
    family = [(100 + k, " ".join(f"w{i}" if i != 20 * k + 10 else "other" for i in range(200))) for k in range(8)]
    rows = [*texts(), *family, (200, family[0][1])]
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    distinct = {s for _, s in sets if s}
    want = Counter((i, sum(x != s and 100 * len(x & s) >= 80 * len(x | s) for x in distinct) if s else 0) for i, s in sets)
    got = ngram_join.near_duplicates(documents(spark, rows), links=True)
    assert Counter((r.doc_id, r.n_links) for r in got.collect()) == want
    assert want[100, 7] == 1 and "n_links" not in ngram_join.near_duplicates(documents(spark, [])).columns


def test_few_candidates_for_each_link():
    """On all texts of sf0.1: sets that share a signature and pass sizes and sketches, against similar pairs; none of those lacks a signature."""
    from collections import defaultdict
    from itertools import combinations

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts_ = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").cast(pa.large_string()).combine_chunks().fill_null("")
    sets = {ngram_join.node_of(s): s for s in ngram_join.shingle_sets(texts_, 4) if len(s)}
    bands, groups, owners = ngram_join.Bands(85), defaultdict(list), defaultdict(list)
    for k, s in sets.items():
        for x in bands.signatures(s).tolist():
            groups[x].append(k)
        for x in s[:: max(1, len(s) // 60)].tolist():  # some shingles of each set: similar pairs share most of theirs
            owners[x].append(k)

    def similar(a, b):
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common)

    pairs = {p for g in groups.values() if len(g) > 1 for p in combinations(sorted(g), 2)}
    passed = 0
    for a, b in pairs:
        x = ngram_join._folded([ngram_join.sketch(sets[a]), ngram_join.sketch(sets[b])])
        n = len(sets[a]) + len(sets[b])
        small, large = sorted((len(sets[a]), len(sets[b])))
        passed += 100 * small >= 85 * large and int(np.bitwise_count(x[0] ^ x[1]).sum()) * 185 <= 15 * n
    links = {p for p in pairs if similar(*p)}
    print(f"{len(sets)} sets, {len(pairs)} pairs with a signature, {passed} candidates, {len(links)} links")
    assert links and passed < 10 * len(links)
    near = {p for g in owners.values() if 1 < len(g) < 50 for p in combinations(sorted(g), 2)}
    assert {p for p in near if similar(*p)} <= links
