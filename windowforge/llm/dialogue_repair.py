"""Repair of conversation structure: the cheapest edits that leave an optional system row and pairs of user and assistant rows.

A conversation's rows become a signature, one letter a row for its role and fault. What repair costs from some row on, and which edit comes first,
follows from the rest of the signature and the state of the grammar alone. Equal endings of all conversations are therefore one node of an
automaton that is built from the end: the distinct signatures are sorted by their reversed letters, so that a task meets the signatures of
one ending next to each other, keeps the nodes of the last one on a stack and makes a node only where a new ending begins. Each node
holds, once for every state, the cost to go and the first edit of the best audit suffix; the rest of that suffix is the next node's.
Conversations then look their signature up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowforge.llm.common import NULL_ID, SPACES, batch_of, column, hand_over, n_partitions, null_id, release, stage, table, text_buffer

# Costs of the edits, letters of roles (in upper case if truncated) and of rows that have to go.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES, GONE = "suao", "x"
#: Grammar states: nothing yet, after the system row, after a user's, after an assistant's. FORTH is where the row that must come next leads, and its letter.
START, SYSTEM, USER, ASSISTANT = range(4)
FORTH, NEXT = (USER, USER, ASSISTANT, USER), "uuau"
ENDS = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40


def kept_state(state: int, role: str) -> int | None:
    """Where a kept row of this role leads."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


@cache
def node(after: tuple[int, ...], letter: str) -> tuple[tuple[int, ...], str]:
    """Costs to go and first edits, for each state, of a row before an ending whose costs are ``after``."""
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    ways: list[list[tuple[int, str]]] = []
    for state in range(4):
        own = [(after[state] + DELETE, "D")]
        if letter != GONE:
            own.append((after[FORTH[state]] + REROLE + extra, "R"))
            to = kept_state(state, role)
            if to is not None:
                own.append((after[to] + extra, "K"))
        ways.append(own)
    least = [min(w)[0] for w in ways]
    # an inserted row leads to a state of the same node; two in a row never beat what they come back to
    for state in (USER, ASSISTANT, START, SYSTEM):
        ways[state].append((min(least[FORTH[state]], least[FORTH[FORTH[state]]] + INSERT) + INSERT, "I"))
    best = [min(w) for w in ways]  # of equal costs, the ASCII-least edit: no two edits of a state share a letter
    return tuple(c for c, _ in best), "".join(e for _, e in best)


END = (ENDS, "-II-")


def best_audits(signatures: Iterator[str]) -> Iterator[tuple[str, int, str, str]]:
    """(signature, cost, audit, roles) of signatures whose reversed letters ascend; ``roles`` has the role letter after each edit, ``-`` for a deletion."""
    stack, offsets, last = [END], [0], ""
    for signature in signatures:
        back = signature[::-1]
        same = 0
        while same < min(len(back), len(last)) and back[same] == last[same]:
            same += 1
        del stack[same + 1 :], offsets[same + 1 :]
        for letter in back[same:]:
            costs, edits = node(stack[-1][0], letter)
            low = min(costs)  # nodes hold what states cost more than the cheapest: endings of equal differences share their edits
            stack.append((tuple(c - low for c in costs), edits))
            offsets.append(offsets[-1] + low)
        last = back
        depth, state, audit, roles = len(back), START, [], []
        cost = offsets[depth] + stack[depth][0][START]
        while (edit := stack[depth][1][state]) != "-":
            audit.append(edit)
            role = "-" if edit == "D" else back[depth - 1].lower() if edit == "K" else NEXT[state]
            roles.append(role)
            state = state if edit == "D" else kept_state(state, role) if edit == "K" else FORTH[state]
            depth -= edit != "I"
        yield signature, cost, "".join(audit), "".join(roles)


def prepared(conversations: DataFrame) -> DataFrame:
    """(id, turn, role, text, digest) with nulls replaced: a null role or text is one space."""
    c = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    return c.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


ORDER = ("turn", "role", "digest")


def signatures(rows: DataFrame) -> DataFrame:
    """id, signature, blank, duplicate, truncated, illegal, gaps of ``prepared`` rows. Only the letters of a row go to its conversation, not its text."""
    bare = F.rtrim("text", F.lit(SPACES))
    r = rows.select("id", *ORDER, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.left("role", F.lit(1)).alias("initial"))
    r = r.repartition(n_partitions(rows.sparkSession), "id")
    said = Window.partitionBy("id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    order = [F.asc_nulls_first(c) for c in (*ORDER, "again")]  # of equal rows, the first is the one that isn't a duplicate
    by = Window.partitionBy("id").orderBy(*order)
    r = r.withColumn("again", F.row_number().over(said) > 1)
    before = F.lag("initial").over(by)
    r = r.withColumn("illegal", before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au"))
    r = r.withColumn("fresh", F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(by) == F.col("turn"), F.lit(False)))
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("cut"), 3).otherwise(0)
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(fault.isin(1, 2), GONE).when(fault == 3, F.upper(role)).otherwise(role)
    r = r.select("id", *ORDER, F.ascii(letter).cast("tinyint").alias("letter"), fault.cast("tinyint").alias("fault"), "illegal", "fresh", "again").sortWithinPartitions("id", *order)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("blank", "duplicate", "truncated", "illegal", "turns")
        open_, held, sums, lo, hi = None, [], None, None, None

        def closed() -> tuple:
            return open_, b"".join(held).decode("ascii"), *sums[:4].tolist(), 0 if lo is None else hi - lo + 1 - int(sums[4])

        def rows_of(found: list[tuple]) -> pa.RecordBatch:
            return batch_of(**{n: pa.array(x, pa.string() if n == "signature" else pa.int64()) for n, x in zip(("id", "signature", *names[:4], "gaps"), zip(*found, strict=True), strict=True)})

        for b in batches:
            if not b.num_rows:
                continue
            ids, letters, fault = column(b, "id"), column(b, "letter").astype(np.uint8), column(b, "fault")
            turn, known = pc.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False), pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False)
            flags = np.stack([fault == 1, fault == 2, fault == 3, column(b, "illegal"), column(b, "fresh")]).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
            part, ends, found = np.add.reduceat(flags, cuts, axis=1), np.append(cuts[1:], len(ids)), []
            for k, (a, z) in enumerate(zip(cuts.tolist(), ends.tolist(), strict=True)):
                if open_ is None or ids[a] != open_:
                    if open_ is not None:
                        found.append(closed())
                    open_, held, sums, lo, hi = int(ids[a]), [], np.zeros(5, np.int64), None, None
                held.append(letters[a:z].tobytes())
                sums = sums + part[:, k]
                if known[z - 1]:  # turns ascend, nulls first
                    lo, hi = int(turn[a + int(np.argmax(known[a:z]))]) if lo is None else lo, int(turn[z - 1])
            if found:
                yield rows_of(found)
        if open_ is not None:
            yield rows_of([closed()])

    return r.mapInArrow(gather, "id long, signature string, blank long, duplicate long, truncated long, illegal long, gaps long")


def audits_of(distinct: DataFrame) -> DataFrame:
    """(signature, cost, audit, roles) of distinct signatures. An ending whose signatures lie in two tasks has its nodes in both."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for found in best_audits(s for b in batches for s in b.column(0).to_pylist()):
            out.append(found)
            size += len(found[2])
            if size > 1 << 20:
                yield batch_of(**dict(zip(("signature", "cost", "audit", "roles"), zip(*out, strict=True), strict=True)))
                out, size = [], 0
        if out:
            yield batch_of(**dict(zip(("signature", "cost", "audit", "roles"), zip(*out, strict=True), strict=True)))

    back = F.reverse("signature")
    spread = distinct.repartitionByRange(n_partitions(distinct.sparkSession), back).sortWithinPartitions(back)
    return spread.mapInArrow(walk, "signature string, cost long, audit string, roles string")


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(id, place, edit, role, text): ``rows`` under the edits of their conversation's audit. A conversation streams through one task: its audit, then its rows."""
    none = lambda kind: F.lit(None).cast(kind)
    heads = audits.select("id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), "audit", "roles")
    both = rows.select("id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", none("string").alias("audit"), none("string").alias("roles")).unionByName(heads)
    both = both.repartition(n_partitions(rows.sparkSession), "id").sortWithinPartitions("id", "kind", *[F.asc_nulls_first(c) for c in ORDER]).select("id", "kind", "role", "text", "audit", "roles")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits = roles = np.zeros(0, np.uint8)
        uses, cursor, used, place = np.zeros(0, np.int64), 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, heads = column(b, "id"), np.flatnonzero(column(b, "kind") == 0)
            found: list[tuple[np.ndarray, ...]] = []
            for a, z, head in zip([0, *(heads + 1).tolist()], [*heads.tolist(), b.num_rows], [None, *heads.tolist()], strict=True):
                if head is not None:
                    edits, roles = (np.frombuffer(b.column(k)[head].as_py().encode(), np.uint8) for k in (4, 5))
                    uses, cursor, used, place = np.flatnonzero(edits != ord("I")), 0, 0, 0
                if a == z:
                    continue
                used += z - a
                end = int(uses[used]) if used < len(uses) else len(edits)  # with what is inserted before the next row
                e, r = edits[cursor:end], roles[cursor:end]
                source = a - 1 + np.cumsum(e != ord("I"))
                stays = e != ord("D")
                found.append((np.full(int(stays.sum()), ids[a]), place + np.arange(int(stays.sum())), e[stays], r[stays], np.where(e == ord("I"), -1, source)[stays]))
                cursor, place = end, place + int(stays.sum())
            if found:
                own, places, e, r, source = map(np.concatenate, zip(*found, strict=True))
                at = pa.array(source, pa.int64(), mask=source < 0)
                kept = b.column(2).take(at)
                named = pa.array(np.where(r == ord("u"), "user", "assistant"))
                yield batch_of(id=own, place=places, edit=pa.array([chr(x) for x in e.tolist()], pa.string()), role=pc.if_else(pa.array(e == ord("K")), kept, named), text=pc.fill_null(b.column(3).take(at), ""))

    return both.mapInArrow(apply, "id long, place long, edit string, role string, text string")


def repair_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits (id, signature, blank, duplicate, truncated, illegal, gaps, cost, audit, roles), one per conversation, and the repaired rows (id, place, edit, role, text).

    conversations (conv_id, turn, role, text); further columns are ignored. Rows count by turn (null turns first), those of one turn by role, then by the
    text's digest; equal rows are rows of their own, all but the first duplicates. A null id is an id of its own (``NULL_ID`` here), a null role or text one
    space, a role known by its first letter. A row without words, or equal to an earlier one, has to be deleted; a conversation may lose all its rows. An empty
    table gives no rows. A signature has a byte a row and has to fit a task; texts pass through one row at a time.
    """
    rows = prepared(conversations)
    signed = stage(signatures(rows))
    known = stage(audits_of(signed.select("signature").distinct()))
    audits = stage(signed.join(known, "signature"))
    release(signed, known)
    return audits, repaired_rows(rows, audits)


def digests(repaired: DataFrame) -> DataFrame:
    """(id, repaired_sha256): of the lines ``role:text`` of a conversation's repaired rows, joined by line feeds."""
    line = F.concat(F.when(F.col("place") > 0, "\n").otherwise(""), F.col("role"), F.lit(":"), F.col("text"))
    lines = repaired.select("id", "place", line.alias("line")).repartition(n_partitions(repaired.sparkSession), "id").sortWithinPartitions("id", "place").select("id", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, sha = None, None
        for b in batches:
            if not b.num_rows:
                continue
            ids, (raw, off) = column(b, "id"), text_buffer(b.column(1))
            cuts, done = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1]), []
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True):
                if open_ is None or ids[a] != open_:
                    if open_ is not None:
                        done.append((open_, sha.hexdigest()))
                    open_, sha = int(ids[a]), hashlib.sha256()
                sha.update(raw[off[a] : off[z]])
            if done:
                yield batch_of(id=pa.array([i for i, _ in done], pa.int64()), repaired_sha256=pa.array([h for _, h in done]))
        if open_ is not None:
            yield batch_of(id=pa.array([open_], pa.int64()), repaired_sha256=pa.array([sha.hexdigest()]))

    return lines.mapInArrow(run, "id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the damage that the checksum of ``conv_id:turn`` deals out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    c = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    c = c.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    c = c.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    audits, repaired = repair_conversations(damaged(conversations))
    every = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("id")).distinct()
    out = every.join(audits, "id", "left").join(digests(repaired), "id", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.select(null_id().alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
    return hand_over(out, audits)


def _sql() -> str:
    step = lambda key, add, letter, text="''": f"{{'k': lpad((left({key}.k, 9)::INT + {add})::VARCHAR, 9, '0') || '{letter}' || substr({key}.k, 10), 'r': {text} || {key}.r}}"
    line = lambda role: f"chr(10) || {role} || ':' || text"
    far = "{'k': '900000000', 'r': ''}"
    forth = {"c0": ("cu", "'user'"), "cs": ("cu", "'user'"), "cu": ("ca", "'assistant'"), "ca": ("cu", "'user'")}
    keeps = {"c0": {"s": "cs", "u": "cu"}, "cs": {"u": "cu"}, "cu": {"a": "ca"}, "ca": {"u": "cu"}}
    base = []
    for q, (to, role) in forth.items():
        kept = " ".join(f"WHEN i = '{letter}' THEN {step('d.' + on, 't', 'K', line('role'))}" for letter, on in keeps[q].items())
        ways = [step("d." + q, DELETE, "D"), f"CASE WHEN must THEN {far} ELSE {step('d.' + to, f'{REROLE} + t', 'R', line(role))} END", f"CASE WHEN must THEN {far} {kept} ELSE {far} END"]
        base.append(f"list_min([{', '.join(ways)}]) AS {q}")
    insert = lambda q: step(f"b.{forth[q][0]}", INSERT, "I", f"chr(10) || {forth[q][1]} || ':'")
    return rf"""
WITH RECURSIVE b AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda k: ascii(substr(s, k, 1))::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 20 AS kind FROM b),
dm AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE kind <> 0),
ag AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM dm),
nr AS (
  SELECT *, row_number() OVER w AS n, left(role, 1) AS i, lag(left(role, 1)) OVER w AS before,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM ag WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again)),
ft AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM nr),
rw AS (SELECT *, fault IN (1, 2) AS must, CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END AS t, max(n) OVER (PARTITION BY conv_id) AS last FROM ft),
dp AS (
  SELECT DISTINCT conv_id, last + 1 AS n, {{'k': '000000000', 'r': ''}} AS c0, {{'k': '000000006II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS cs, {{'k': '000000003I', 'r': chr(10) || 'assistant:'}} AS cu, {{'k': '000000000', 'r': ''}} AS ca FROM rw
  UNION ALL
  SELECT conv_id, n, list_min([b.c0, {step("m.cu", INSERT, "I", "chr(10) || 'user:'")}]), list_min([b.cs, {step("m.cu", INSERT, "I", "chr(10) || 'user:'")}]), m.cu, m.ca FROM (
    SELECT conv_id, n, b, {{'cu': list_min([b.cu, {insert("cu")}]), 'ca': list_min([b.ca, {insert("ca")}])}} AS m FROM (
      SELECT conv_id, n, {{'c0': c0, 'cs': cs, 'cu': cu, 'ca': ca}} AS b FROM (
        SELECT d.conv_id, rw.n, {", ".join(base)} FROM dp d JOIN rw ON rw.conv_id IS NOT DISTINCT FROM d.conv_id AND rw.n = d.n - 1)))),
best AS (SELECT conv_id, left(c0.k, 9)::BIGINT AS cost, substr(c0.k, 10) AS audit, sha256(substr(c0.r, 2)) AS sha FROM dp WHERE n = 1),
cn AS (
  SELECT conv_id, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM rw GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cn ON cn.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_OP13 = _sql()
