import random
from collections import Counter

import numpy as np
from fixtures import documents, texts
from test_dedup import brute_bytes, by_text, one_order

from windowforge.llm import suffix_dedup


def test_hot_anchors_are_spread(spark, monkeypatch):
    """A line and the edges of a passage that many documents share with other neighbours: no anchor sends many segments to one bucket."""
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = say(70), say(300)
    docs = documents(spark, texts() + [(100 + i, say(80) + line + say(80) + (passage if i % 2 else "") + say(60)) for i in range(60)] + [(200, line * 4), (None, "q" * 90 + line + "r" * 90), (201, "q" * 90 + line + "r" * 90)])
    sent, plain = [], suffix_dedup.by_bucket

    def watched(packed, answer, schema):
        sent.append([(r.payload, r.extra) for r in packed.collect()])
        return plain(packed, answer, schema)

    monkeypatch.setattr(suffix_dedup, "by_bucket", watched)
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    hot = {"hot": 8} if "hot" in suffix_dedup.dedup_bytes.__code__.co_varnames else {}
    got = suffix_dedup.dedup_bytes(docs, **hot).selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long)", "sha2(kept, 256)")
    want, have = by_text(brute_bytes(one_order(spark, docs), 100), got)
    assert want == have
    count = Counter()
    for payload, extra in sent[1]:
        if payload is not None and len(payload) % suffix_dedup._ITEM.itemsize == 0:
            items = np.frombuffer(payload, suffix_dedup._ITEM)
            if int(items["size"].sum()) == len(extra):  # segments, not single windows
                count.update(items["hash"].tolist())
    assert count and max(count.values()) <= 8
