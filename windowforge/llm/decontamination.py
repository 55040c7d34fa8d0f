"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND by every training passage.

Impacts are BM25 weights divided by an item's score for its own text, so a score is the share of the item that a passage
covers, rare words first. Items are ordered by length and their postings cut into blocks with their largest impacts.
Passages whose bounds stay below the threshold, by term, by block and by fine block, are passed over in one step for a whole batch; the others walk the postings.
What is retrieved is verified: enough of the question's and of the answer's word n-grams have to stand in the passage.

Document frequencies and the mean length are those of the whole benchmark. An index holds items of about ``INDEX_BYTES`` of text; the tasks of a
pass over the documents get as many indexes as weigh ``MOST_SENT`` bytes as they are sent, and a larger benchmark takes several passes.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.llm.common import BASE_A, batch_of, column, hand_over, id_text, null_id, ranges, release, rolling_hash, small_batches, stage, table, text_buffer, with_row, word_hashes, words_of

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach; shares of the question's and the answer's n-grams; words of an n-gram.
THRESHOLD, QUESTION, ANSWER, GRAM = 0.5, 0.5, 0.5, 5
#: Items of a block of postings and of a fine block; least words of a passage; bytes of text of an index.
BLOCK, FINE, PASSAGE, INDEX_BYTES = 8, 2, 64, 128 << 10
#: Bytes of the indexes of one pass, as they go to every task; bytes of items that the driver holds at a time.
MOST_SENT, GROUP_BYTES = 48 << 20, 8 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(range(0x00, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x80))] = True


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters and digits, A-Z lower-cased) and each text's first."""
    data, off = text_buffer(texts)
    starts, ends, first = words_of(data, off, _SEPARATOR)
    return word_hashes(data, starts, ends, lower=True), first


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item given as one text: the answer is its last sentence, or its last third if there is one only."""
    parts = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.strip())]
    if parts and parts[-1] < len(text.strip()):
        return text.strip()[: parts[-1]], text.strip()[parts[-1] :]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:cut]), " ".join(words[cut:])


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Distinct n-grams; of fewer words, the words."""
    return np.unique(rolling_hash(hashes, GRAM, BASE_A) if len(hashes) >= GRAM else hashes)


class Statistics:
    """Of the whole benchmark: items with words, their mean length, and in how many of them each of some words stands."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        order = np.argsort(terms)
        self.n, self.mean, self.terms, self.df = n, max(1e-9, mean), terms[order], df[order]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        hashes, first = _words(pa.array(texts, pa.string()))
        terms, df = np.unique(np.concatenate([np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)] or [hashes]), return_counts=True)
        lengths = np.diff(first)
        return cls(int((lengths > 0).sum()), float(lengths[lengths > 0].mean()) if lengths.any() else 0.0, terms, df)

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)]
        return np.log1p((self.n - df + 0.5) / (df + 0.5))


class Maxima:
    """Of each term, the blocks of items in which it stands and its largest impact there."""

    def __init__(self, number: np.ndarray, item: np.ndarray, impact: np.ndarray, terms: int, width: int):
        block = item // width
        head = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (block[1:] != block[:-1])])) if len(number) else np.zeros(0, np.int64)
        self.block, self.most = block[head].astype(np.int32), np.maximum.reduceat(impact, head).astype(np.float32) if len(head) else np.zeros(0, np.float32)
        self.first = np.searchsorted(number[head], np.arange(terms + 1)).astype(np.int32)
        self.blocks = int(block.max(initial=-1)) + 1

    def get(self, term: int, block: int) -> float:
        a, b = self.first[term], self.first[term + 1]
        k = a + int(np.searchsorted(self.block[a:b], block))
        return float(self.most[k]) if k < b and self.block[k] == block else 0.0

    def reached(self, terms: np.ndarray, owner: np.ndarray, owners: int, threshold: float) -> np.ndarray:
        """Which owners (0 .. ``owners`` - 1) of these terms have a block whose maxima add up to ``threshold``."""
        n = (self.first[terms + 1] - self.first[terms]).astype(np.int64)
        at = ranges(self.first[terms], n)
        sums = np.bincount(np.repeat(owner, n) * self.blocks + self.block[at], weights=self.most[at], minlength=owners * self.blocks)
        return sums.reshape(owners, self.blocks).max(axis=1, initial=0) >= threshold


class Index:
    """Items with a question and an answer. An answer that was only derived from the text and has fewer words than an n-gram proves
    nothing by itself: for it, the n-grams of the whole item are looked for."""

    def __init__(self, ids: list[int], questions: list[str], answers: list[str], derived: list[bool] | None = None, known: Statistics | None = None):
        whole = [f"{q} {a}" for q, a in zip(questions, answers, strict=True)]
        hashes, first = _words(pa.array(whole, pa.string()))
        known, derived = known or Statistics.of(whole), derived or [False] * len(ids)
        lengths = np.diff(first)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]  # an item without words can't be found
        self.ids = [ids[i] for i in order]
        parts = [[_words(pa.array([x[i]], pa.string()))[0] for i in order] for x in (questions, answers)]
        self.question = [_grams(x) for x in parts[0]]
        self.answer = [_grams(hashes[first[i] : first[i + 1]] if derived[i] and len(x) < GRAM else x) for i, x in zip(order, parts[1], strict=True)]
        n = len(order)
        self.passage = max(PASSAGE, 2 * int(lengths.max(initial=0)))
        pair = np.stack([np.repeat(np.arange(n), lengths[order]).astype(np.uint64), np.concatenate([hashes[first[i] : first[i + 1]] for i in order]) if n else np.zeros(0, np.uint64)])
        (item, term), tf = np.unique(pair, axis=1, return_counts=True)
        item = item.astype(np.int64)
        self.terms, number = np.unique(term, return_inverse=True)
        weight = known.idf(self.terms)[number] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[order][item] / known.mean)) if n else np.zeros(0)
        impact = weight / np.bincount(item, weights=weight, minlength=n)[item]
        by_term = np.lexsort((item, number))
        item, self.impact, number = item[by_term], impact[by_term], number[by_term]
        self.item, self.post = item.astype(np.int32), np.searchsorted(number, np.arange(len(self.terms) + 1))
        self.block_max, self.fine_max = (Maxima(number, item, self.impact, len(self.terms), width) for width in (BLOCK, FINE))
        self.term_max = np.maximum.reduceat(self.impact, self.post[:-1]).astype(np.float32) if n else np.zeros(0, np.float32)

    def wand(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All (item, score) of ``threshold`` or more for a set of terms: lists are walked in parallel, the pivot is the first item
        that the upper bounds allow, and a block whose largest impacts fall short is left at once."""
        lists = [[int(self.post[t]), int(self.post[t + 1]), t] for t in terms.tolist()]
        found, slack = [], 1e-6
        while lists:
            lists.sort(key=lambda x: self.item[x[0]])
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += float(self.term_max[t])
                if bound >= threshold - slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = int(self.item[lists[pivot][0]])
            while pivot + 1 < len(lists) and self.item[lists[pivot + 1][0]] == item:
                pivot += 1
            block = item // BLOCK
            here = lists[: pivot + 1]
            if sum(self.block_max.get(t, block) for _, _, t in here) < threshold - slack:
                # no item before the next block, or before the next list begins, can reach it
                target = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    target = min(target, int(self.item[lists[pivot + 1][0]]))
                target = max(target, item + 1)
            elif self.item[here[0][0]] == item:
                score = sum(float(self.impact[a]) for a, _, _ in here)
                if score >= threshold - slack:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for x in here:
                if self.item[x[0]] < target:
                    x[0] += int(np.searchsorted(self.item[x[0] : x[1]], target))
            lists = [x for x in lists if x[0] < x[1]]
        return found

    def search(self, hashes: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word, last word + 1, item, score) of every passage and each item that it reaches."""
        if not len(self.terms) or not len(hashes):
            return
        half = self.passage // 2
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == hashes)
        text = np.searchsorted(first, known, side="right") - 1
        place = known - first[text]
        # passages start at each half; a word lies in that of its own half and in the one before
        halves = np.maximum(1, -(-np.diff(first) // half))
        base = np.concatenate([[0], np.cumsum(halves)])
        cell = base[text] + place // half
        early = place // half > 0
        key = np.unique(np.concatenate([cell * len(self.terms) + at[known], (cell[early] - 1) * len(self.terms) + at[known][early]]))
        passage, term = np.divmod(key, len(self.terms))
        head = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(key) else np.zeros(0, np.int64)
        bounds = np.concatenate([head, [len(key)]])
        open_ = np.flatnonzero(np.add.reduceat(self.term_max[term], head) >= threshold - 1e-4) if len(head) else head
        for lot in range(0, len(open_), 4096):  # the bounds by block, then by fine block, of the passages left
            some = open_[lot : lot + 4096]
            for maxima in (self.block_max, self.fine_max):
                if len(some):
                    n = bounds[some + 1] - bounds[some]
                    some = some[maxima.reached(term[ranges(bounds[some], n)], np.repeat(np.arange(len(some)), n), len(some), threshold - 1e-4)]
            for k in some.tolist():
                p = int(passage[bounds[k]])
                t = int(np.searchsorted(base, p, side="right")) - 1
                lo = int(first[t]) + (p - int(base[t])) * half
                for item, score in self.wand(term[bounds[k] : bounds[k + 1]], threshold):
                    yield t, lo, min(lo + self.passage, int(first[t + 1])), item, score

    def overlap(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's and the answer's n-grams in a passage; of an empty part, 1."""
        grams, single = np.unique(rolling_hash(words, GRAM, BASE_A)), np.unique(words)
        out = []
        for part, of in ((self.question[item], None), (self.answer[item], None)):
            out.append(1.0 if not len(part) else max(float(np.isin(part, grams).mean()), float(np.isin(part, single).mean())))
        return out[0], out[1]


class Benchmark:
    """Items whose statistics are known; their indexes are made a few at a time, whenever they are asked for."""

    def __init__(self, items: DataFrame, n_groups: int, n: int, mean: float, df: DataFrame):
        self.items, self.n_groups, self.n, self.mean, self.df = items, n_groups, n, mean, df

    def passes(self) -> Iterator[list[Index]]:
        """Lists of indexes of at most ``MOST_SENT`` bytes (one index at least)."""
        held, sent = [], 0
        for g in range(self.n_groups):
            own = self.items.where(F.col("group") == g)
            terms = own.mapInArrow(_item_terms, "term long, length long").select("term").distinct()
            found = self.df.join(terms, "term").toArrow()  # no more than the words of a group
            known = Statistics(self.n, self.mean, found.column("term").to_numpy().view(np.uint64), found.column("df").to_numpy())
            rows: list[tuple] = []
            size = 0
            for r in [*own.orderBy("id", "q").toLocalIterator(), None]:
                if r is not None:
                    rows.append((r["id"], r["q"], r["a"], False) if r["a"] is not None else (r["id"], *split_item(r["q"]), True))
                    size += len(rows[-1][1]) + len(rows[-1][2])
                if rows and (r is None or size > INDEX_BYTES):
                    index = Index(*map(list, zip(*rows, strict=True)), known)
                    weight = len(pickle.dumps(index))
                    if held and sent + weight > MOST_SENT:
                        yield held
                        held, sent = [], 0
                    held.append(index)
                    rows, size, sent = [], 0, sent + weight
        yield held


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct words, with its length at the first of them."""
    for b in batches:
        hashes, first = _words(pa.array([f"{q} {a or ''}" for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.string()))
        own = [np.unique(hashes[x:y]) for x, y in zip(first[:-1], first[1:], strict=True) if y > x]
        n = np.fromiter(map(len, own), np.int64, len(own))
        length = np.zeros(int(n.sum()), np.int64)
        length[np.cumsum(n) - n] = np.diff(first)[np.diff(first) > 0]
        yield batch_of(term=(np.concatenate(own) if own else hashes[:0]).view(np.int64), length=length)


def build_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", question: str | None = None, answer: str | None = None) -> Benchmark:
    """The items with the statistics of all of them. Items of one id are items of their own, reported under that id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = (text(question).alias("q"), text(answer).alias("a")) if question and answer else (text(text_col).alias("q"), F.lit(None).cast("string").alias("a"))
    picked = items.select(F.col(id_col).cast("long").alias("id"), *parts)
    total = picked.agg(F.sum(F.octet_length("q") + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    n_groups = max(1, -(-total // GROUP_BYTES))
    grouped = picked.withColumn("group", F.pmod(F.xxhash64("id", "q"), F.lit(n_groups)).cast("int"))
    df = stage(grouped.mapInArrow(_item_terms, "term long, length long").groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length"), F.count_if(F.col("length") > 0).alias("items")))
    sums = df.agg(F.sum("items").alias("n"), F.sum("length").alias("length")).first()
    return Benchmark(grouped, n_groups, sums["n"] or 0, (sums["length"] or 0) / max(1, sums["n"] or 0), df.select("term", "df"))


def find_leaks(docs: DataFrame, benchmark: Benchmark, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """One row per document: doc_id, n_items, item_ids (ascending) and spans (item, first word, last word + 1, score, question and answer shares).

    Null and empty texts match nothing, nor do items without words. Every passage of every text is a query. Null ids stay null; repeated rows
    are rows of their own. A null item_id is an item that is reported as null, several items of one id are named once. With ``rows``, the row
    itself comes along (struct ``row``). A benchmark that takes several passes has the documents written between them.
    """
    span = "array<struct<item_id: long, start: long, end: long, score: double, question: double, answer: double>>"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def one_pass(found: DataFrame, indexes: list[Index], last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small_batches(batches, "text", 4 << 20):
                hashes, first = _words(b.column(1))
                before = b.schema.get_field_index("before")
                spans: list[list[dict]] = b.column(before).to_pylist() if before >= 0 else [[] for _ in range(b.num_rows)]
                for index in indexes:
                    for t, lo, hi, item, score in index.search(hashes, first, threshold):
                        q, a = index.overlap(hashes[lo:hi], item)
                        if q >= QUESTION and a >= ANSWER:
                            spans[t].append({"item_id": index.ids[item], "start": lo - int(first[t]), "end": hi - int(first[t]), "score": score, "question": q, "answer": a})
                row = {"row": b.column(b.schema.get_field_index("row"))} if rows else {}
                if last:
                    items = [sorted({s["item_id"] for s in x}, key=lambda v: (v is None, v)) for x in spans]
                    yield batch_of(id=column(b, "id"), n_items=pa.array(list(map(len, items)), pa.int64()), item_ids=pa.array(items, pa.list_(pa.int64())), spans=pa.array(spans, kind), **row)
                else:
                    yield batch_of(id=column(b, "id"), text=b.column(1), before=pa.array(spans, kind), **row)

        schema = f"id long, n_items long, item_ids array<long>, spans {span}" if last else f"id long, text string, before {span}"
        return found.mapInArrow(run, with_row(schema, docs.schema if rows else None))

    found, waiting = id_text(docs, id_col, text_col, rows), None
    for indexes in benchmark.passes():
        if waiting is not None:
            before, found = found, stage(one_pass(found, waiting, False))
            release(before)
        waiting = indexes
    out = one_pass(found, waiting, True).select(null_id().alias("doc_id"), "n_items", "item_ids", "spans", *(["row"] if rows else []))
    return hand_over(out, found)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), build_indexes(table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", (F.col("n_items") > 0).alias("leaked"), "n_items", "item_ids")
