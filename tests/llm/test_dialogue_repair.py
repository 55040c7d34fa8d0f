"""Repair against SQL, and against plain Python that tries every edit with whole strings."""

import hashlib
import random
import re
import zlib
from functools import cache

import pyarrow.parquet as pq
import pytest
from fixtures import sha
from oracle import SF, rows_of, sql_rows

from windowforge.llm import dialogue_repair as D
from windowforge.llm.common import NULL_ID

SCHEMA = "conv_id long, turn long, role string, text string, id string, kind int, letter string, audit string"


def brute(rows):
    """(blank, duplicate, truncated, illegal, gaps, cost, audit, repaired lines) of one conversation's (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def go(at, state):  # the cheapest (cost, audit, lines); an inserted row never follows two others
        return best(at, state, 2)

    def best(at, state, inserts):
        out = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        if inserts:
            for role, after in (("user", "u"), ("assistant", "a")):
                if (state, after) in {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    c, a, r = best(at, after, inserts - 1)
                    out.append((c + 3, "I" + a, (role + ":", *r)))
        if at < len(rows):
            _, role, text = rows[at]
            c, a, r = go(at + 1, state)
            out.append((c + 4, "D" + a, r))
            if faults[at] not in ("b", "d"):
                extra = 3 if faults[at] == "t" else 0
                for new, letter, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if (state, new[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        c, a, r = go(at + 1, new[:1])
                        out.append((c + price + extra, letter + a, (new + ":" + text, *r)))
        return min(out, default=(10**9, "", ()))

    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = go(0, "")
    return (*(faults.count(k) for k in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), max(turns) - min(turns) + 1 - len(turns) if turns else 0, cost, audit, lines)


def conversations():
    rng = random.Random(7)
    out = []
    for c in [None, *range(60)]:
        for t in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u"])
            out.append((c, rng.choice([t, t, t, t + 3, None]), role, rng.choice(["Yes.", "No", "Hm?\n", " \t", "", None, "ünï! ", "a. b", f"{t}.", f"{t}"])))
    out += [(100, t, ("user", "assistant")[t % 2], "same.") for t in range(40)]
    out += [(101, t, "user", f"{t}.") for t in range(30)] + [(102, None, "system", "Be good.")] * 3 + [(103, 0, "assistant", "x" * 200_000)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, "l", "a") for r in rows], SCHEMA)


def by_conversation(rows):
    out = {}
    for c, *r in rows:
        out.setdefault(c, []).append(r)
    return out


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_repair_against_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = conversations()
    audits, repaired = D.repair_conversations(frame(spark, rows))
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.id, r.place)):
        lines.setdefault(r.id, []).append(f"{r.role}:{r.text}")
    got = {r.id: (r.blank, r.duplicate, r.truncated, r.illegal, r.gaps, r.cost, r.audit, tuple(lines.get(r.id, []))) for r in audits.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {NULL_ID if c is None else c: brute(r) for c, r in by_conversation(rows).items()}


def test_every_signature_of_four_rows():
    """All signatures up to four letters: nodes are made once for an ending and hold what brute force finds."""
    letters, words = "suaoSUAOx", [""]
    for _ in range(4):
        words += [w + x for w in words if len(w) == len(words[-1]) for x in letters]
    words = sorted(set(words), key=lambda w: w[::-1])
    D.node.cache_clear()
    found = list(D.best_audits(words))
    assert D.node.cache_info().misses < 300 < len(found) / 20  # endings with equal differences of costs are one node
    say = {"s": "system", "u": "user", "a": "assistant", "o": "other"}
    for w, cost, audit, roles in random.Random(1).sample(found, 600):
        rows = [(i, "user", "") if x == "x" else (i, say[x.lower()], f"{i}" + ("" if x.isupper() else ".")) for i, x in enumerate(w)]
        *_, c, a, lines = brute(rows)
        assert (cost, audit) == (c, a) and re.fullmatch("(s?(ua)+)?", roles.replace("-", ""))
        assert len(lines) == len(roles.replace("-", ""))


def test_a_long_conversation():
    (found,) = D.best_audits(["u" * 30_000])
    assert found[1] == 3 * 15_000 and len(found[2]) == 30_000


def expected(rows):
    out, every = [], {c for c, *_ in rows}
    spoilt = []
    for c, t, role, text in rows:
        s = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20
        role, text = s(role), s(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        spoilt += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = by_conversation(spoilt)
    for c in every:
        b, d, t, i, g, cost, audit, lines = brute(got[c]) if c in got else (0, 0, 0, 0, 0, 0, "", ())
        out.append((audit, b, c, cost, d, g, i, sha("\n".join(lines).encode()), t))
    return sorted(out, key=str)


def test_query_on_odd_rows(spark, tmp_path):
    rows = conversations() + [(i, 0, "user", "only") for i in range(200, 400)]  # some lose their only row
    pq.write_table(frame(spark, rows).toArrow(), f"{tmp_path}/conversations.parquet")
    got = rows_of(D.op13_dialogue_repair(spark, str(tmp_path)))
    assert got == (["audit", "blank", "conv_id", "cost", "duplicate", "gaps", "illegal", "repaired_sha256", "truncated"], expected(rows))
    assert got == sql_rows(D.ORACLE_OP13, str(tmp_path))
    frame(spark, []).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert D.op13_dialogue_repair(spark, f"{tmp_path}/empty").count() == 0


def test_query_against_sql(spark):
    assert rows_of(D.op13_dialogue_repair(spark, SF)) == sql_rows(D.ORACLE_OP13)
