"""Hard negatives against SQL, and against plain Python over all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, rows_of, sql_rows

from windowforge.llm import hard_negatives as H
from windowforge.llm import shares

SCHEMA = "vec_id long, embedding array<float>, label int, share int, kind string, row int, id string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "i", 3) for r in rows], SCHEMA)


def random_rows(n=700, dims=16, seed=1, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(clusters)] * rng.uniform(0.2, 3) + rng.normal(size=dims) * 0.1
        out.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 4))))
    return out


def brute(rows, every, positives=5, negatives=10, least=30, most=90):
    kept = [(-(2**63) if i is None else i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(kept):
        if i == -(2**63) or i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, b) for b, (j, w, _) in enumerate(kept) if b != a and len(w) == len(v))
        for p, pid, _ in [s for s in scored if kept[s[2]][2] == y][:positives]:
            fit = [s for s in scored if kept[s[2]][2] != y and least * -p <= 100 * -s[0] <= most * -p][:negatives]
            null = lambda k: None if k == -(2**63) else k
            out += [(i, null(pid), r, null(nid), -p, -n) for r, (n, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df, every, **more):
    return sorted(map(tuple, H.mine(df, every, **more).select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize("clusters", [1, 12])
def test_several_shares(spark, monkeypatch, clusters):
    monkeypatch.setattr(shares, "LEAST_ROWS", 64)
    rows = random_rows(clusters=clusters)
    assert shares.n_shares(len(rows), 4) > 4
    assert mined(frame(spark, rows), 20) == brute(rows, 20)


def test_odd_rows(spark):
    """Nulls everywhere, other lengths, empty and zero vectors, repeated ids and rows, ties, huge and tiny components."""
    rows = random_rows(80, 3)
    inf, nan = float("inf"), float("nan")
    rows += [(None, [1.0, 2.0, 3.0], 0), (None, [1.0, 2.0, 3.0], 1), (100, None, 1), (200, [1.0, None, 0.0], 1), (300, [1.0, nan, 0.0], 1), (400, [inf, 0.0, 0.0], 1), (500, [1.0, 1.0, 1.0], None)]
    rows += [(600, [], 1), (601, [], 1), (602, [], 2), (700, [0.0, 0.0, 0.0], 1), (701, [0.0, 0.0, 0.0], 2), (800, [1.0, 2.0], 0), (801, [2.0, 1.0], 0), (802, [1.0, 1.5], 3), (803, [1.0, 1.0], 3)]
    rows += [(900, [0.5, 0.5, 0.5], 2)] * 2 + [(901 + i % 3, [0.5, 0.5, 0.25], 3) for i in range(14)] + [(950 + i, [0.5, 0.5, 0.5], 2) for i in range(8)]
    rows += [(1000, [1e6, 3e6, 0.0], 0), (1001, [1.5e6, 3e6, 1.0], 0), (1002, [1e6, 2e6, 0.0], 1), (-100, [1e-9, -1e-9, 0.25], 0)]
    assert mined(frame(spark, rows), 10) == brute(rows, 10)
    assert mined(frame(spark, rows), 10, positives=2, negatives=3, least=0, most=100) == brute(rows, 10, 2, 3, 0, 100)
    assert mined(frame(spark, []), 10) == [] == mined(frame(spark, rows[:1]), 10)


def share_of(rows):
    return H.Share(pa.table({"row": np.arange(len(rows)), "id": [r[0] for r in rows], "label": [r[2] for r in rows], "vec": [np.floor(256 * np.array(r[1])).tolist() for r in rows]}))


@pytest.mark.parametrize("bucket_rows", [10, 4096])
def test_pruning_loses_nothing(monkeypatch, bucket_rows):
    monkeypatch.setattr(H, "BUCKET_ROWS", bucket_rows)
    rows = random_rows(600, 8, clusters=30)
    share, vec = share_of(rows), np.floor(256 * np.array([r[1] for r in rows]))
    asked, seen = vec[::37], 0
    exact = asked @ vec.T
    for quantile in (0.5, 0.9, 0.99, 1.0):
        needs = np.quantile(exact, quantile, axis=1)
        found = [set() for _ in asked]
        for i, places, scores in share.scored(asked, lambda i: needs[i]):
            assert (scores == exact[i, places]).all()
            found[i] |= set(places.tolist())
            seen += len(places)
        for i, f in enumerate(found):
            assert set(np.flatnonzero(exact[i] >= needs[i]).tolist()) <= f
    assert seen < 0.5 * 4 * exact.size  # most rows were ruled out without a score


def test_candidates_come_from_sorted_lists():
    share = share_of(random_rows(500, 8, clusters=40))
    (bucket, *_), focus = share.buckets[8], np.array([1, 4, 6])
    low, high = np.quantile(bucket.unit[:, focus], 0.3, axis=0), np.quantile(bucket.unit[:, focus], 0.8, axis=0)
    inside = ((bucket.unit[:, focus] >= low) & (bucket.unit[:, focus] <= high)).all(axis=1)
    assert sorted(bucket.candidates(focus, low, high)) == np.flatnonzero(inside).tolist()
    assert set(bucket.lists) == {1, 4, 6}


def test_rows_are_moved_once(spark):
    """Every row goes to one share; a query goes once to each."""
    rows = H.vectors_of(frame(spark, random_rows(300, 4)), "vec_id", "embedding", "label")
    asked = rows.where("id % 50 = 0")

    def count(share, asks):
        yield pa.RecordBatch.from_pydict({"members": [share.num_rows], "asks": [asks.num_rows]})

    before, shares.LEAST_ROWS = shares.LEAST_ROWS, 50
    try:
        got = shares.past_shares(rows, asked, 300, lambda t: t, count, "members long, asks long").toPandas()
    finally:
        shares.LEAST_ROWS = before
    assert len(got) == 6 and got.members.sum() == 300 and (got.asks == 6).all()


def test_query_against_sql(spark):
    got = H.op11_hard_negatives(spark, SF)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert rows_of(got) == sql_rows(H.ORACLE_OP11)
