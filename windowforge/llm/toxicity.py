"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words are read in overlapping windows. A word enters as its embedding beside the mean of the embeddings of its
beginnings and endings (characters), so that unseen words are judged by their parts. A window's score comes from the
attention-weighted states of both directions; a document's score is its highest window's, calibrated.

The network is fitted on the driver on a bounded sample of labelled documents (``train``); scoring covers every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windowforge.llm.common import BASE_A, BYTE_VALUES, NULL_ID, batch_of, column, inverse, mix, null_id, powers, ranges, row_struct, small_batches, table, text_buffer, with_row, words_of

#: Bounds of the fit: documents of each class, characters of one of them and bytes of all; vocabulary entries, epochs.
FIT_DOCS, FIT_CHARS, FIT_BYTES, VOCABULARY, EPOCHS = 1_500, 1 << 17, 6 << 20, 20_000, 5
#: Excerpts in which a longer text enters the fit.
EXCERPTS = 16
#: Words of a window and between the starts of windows; state of a direction; dimensions of an embedding.
WINDOW, STEP, STATE, EMBED = 32, 16, 8, 8
#: Bytes of the beginnings and endings of a word that enter as characters.
HEADS, TAILS = (2, 3, 4, 5, 6, 7), (2, 3, 4)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(range(0x00, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x80))] = True


class Words:
    """Words of lower-cased texts as numbers of distinct words, with the hashes that stand for each and its parts."""

    def __init__(self, texts: pa.Array):
        data, off = text_buffer(texts)
        starts, ends, self.first = words_of(data, off, _SEPARATOR)
        self.n = len(starts)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE_A, len(data)), dtype=np.uint64, out=sums[1:])
        back = powers(inverse(BASE_A), len(data) + 1)
        cut = lambda a, b, k: mix((sums[b] - sums[a]) * back[a] + np.uint64(k))
        whole = cut(starts, ends, 0)
        distinct, at, self.number = np.unique(whole, return_index=True, return_inverse=True)
        a, b = starts[at], ends[at]
        parts = [cut(a, np.minimum(a + k, b), 100 + k) for k in HEADS] + [cut(np.maximum(b - k, a), b, 200 + k) for k in TAILS]
        self.words, self.parts = distinct, np.stack(parts, axis=1)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word and length of every window; documents without words have none."""
        n = np.diff(self.first)
        many = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STEP)) + 1, 0)
        doc = np.repeat(np.arange(len(n)), many)
        at = ranges(np.zeros(len(n), np.int64), many) * STEP
        return doc, self.first[doc] + at, np.minimum(WINDOW, n[doc] - at)


def _lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Position + 1 in ascending ``keys``, 0 for the unknown."""
    if not len(keys):
        return np.zeros(values.shape, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at + 1, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, words: np.ndarray, parts: np.ndarray, word_odds: np.ndarray, part_odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.words, self.parts, self.calibration, self.base = words, parts, (1.0, 0.0), 0.0
        self.p = {"ew": draw(len(words) + 1, EMBED) * 0.2, "ec": draw(len(parts) + 1, EMBED) * 0.2}
        self.p["ew"][1:, 0] += word_odds  # the log odds of what was counted give the first dimension its start
        self.p["ec"][1:, 0] += part_odds
        self.p["ew"][0], self.p["ec"][0] = 0, 0
        for d in "fb":
            self.p |= {f"w{d}": draw(2 * EMBED, 3 * STATE), f"u{d}": draw(STATE, 3 * STATE), f"c{d}": np.zeros(3 * STATE, np.float32)}
        self.p |= {"att": draw(2 * STATE), "out": draw(2 * STATE) * 3, "bias": np.zeros(1, np.float32)}

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedded distinct words (the last row stands for padding), and the entries they come from."""
        iw, ic = _lookup(self.words, w.words), _lookup(self.parts, w.parts)
        x = np.concatenate([self.p["ew"][iw], self.p["ec"][ic].mean(axis=1)], axis=1)
        return np.concatenate([x, np.zeros((1, 2 * EMBED), np.float32)]), iw, ic

    def forward(self, tables: dict[str, np.ndarray], index: np.ndarray, length: np.ndarray, keep: bool = False):
        """Scores (logits) of windows; ``index`` (window, step) has numbers of distinct words."""
        p, n = self.p, len(index)
        hs, trail = np.empty((2, WINDOW, n, STATE), np.float32), []
        for k, d in enumerate("fb"):
            h = np.zeros((n, STATE), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                x, g = tables[d][index[:, t]], h @ p[f"u{d}"]
                zr = _sigmoid(x[:, : 2 * STATE] + g[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                c = np.tanh(x[:, 2 * STATE :] + r * g[:, 2 * STATE :])
                if keep:
                    trail.append((d, t, h, z, r, c, g[:, 2 * STATE :]))
                h = c + z * (h - c)
                hs[k, t] = h
        e = np.tensordot(hs[0], p["att"][:STATE], 1) + np.tensordot(hs[1], p["att"][STATE:], 1)
        e[np.arange(WINDOW)[:, None] >= length[None]] = -1e9
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.concatenate([np.einsum("tn,tns->ns", a, hs[k]) for k in (0, 1)], axis=1)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, pooled, a, hs, trail) if keep else logit

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def index(self, w: Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        step = np.arange(WINDOW)
        at = np.minimum(start[:, None] + step, max(0, w.n - 1))
        return np.where(step < length[:, None], w.number[at], len(w.words))

    def logits(self, w: Words, start: np.ndarray, length: np.ndarray, block: int = 8192) -> np.ndarray:
        tables = self.tables(self.inputs(w)[0])
        out = [self.forward(tables, self.index(w, start[i : i + block], length[i : i + block]), length[i : i + block]) for i in range(0, len(start), block)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, w: Words, start: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, iw, ic = self.inputs(w)
        index = self.index(w, start, length)
        logit, pooled, a, hs, trail = self.forward(self.tables(x), index, length, keep=True)
        dl = ((_sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"][0] = pooled.T @ dl, dl.sum()
        dh, de = np.empty_like(hs), np.zeros_like(a)
        for k in (0, 1):
            dp = dl[:, None] * p["out"][None, k * STATE : (k + 1) * STATE]
            dh[k] = a[:, :, None] * dp[None]
            de += (hs[k] * dp[None]).sum(axis=2)
        de = a * (de - (a * de).sum(axis=0))
        for k in (0, 1):
            part = slice(k * STATE, (k + 1) * STATE)
            dh[k] += de[:, :, None] * p["att"][part]
            g["att"][part] = np.einsum("tn,tns->s", de, hs[k])
        dx = np.zeros_like(x)
        carry = np.zeros((len(index), STATE), np.float32)
        last = None
        for d, t, h, z, r, c, gc in reversed(trail):
            if d != last:
                carry, last = np.zeros_like(carry), d
            up = dh["fb".index(d), t] + carry
            dc = up * (1 - z) * (1 - c * c)
            dz = up * (h - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            dpre = np.concatenate([dz, dr, dc], axis=1)
            g[f"u{d}"] += h.T @ dg
            carry = up * z + dg @ p[f"u{d}"].T
            g[f"c{d}"] += dpre.sum(axis=0)
            rows = index[:, t]
            g[f"w{d}"] += x[rows].T @ dpre
            np.add.at(dx, rows, dpre @ p[f"w{d}"].T)
        dx = dx[:-1]
        np.add.at(g["ew"], iw, dx[:, :EMBED])
        np.add.at(g["ec"], ic.ravel(), np.repeat(dx[:, EMBED:] / ic.shape[1], ic.shape[1], axis=0))
        g["ew"][0], g["ec"][0] = 0, 0
        return g


def _odds(doc: np.ndarray, columns: Iterator[np.ndarray], label: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that stand in three documents or more (at most ``limit``, the furthest from even odds), and their clipped log odds.

    ``columns``: the key of each row of ``doc``, column by column; columns share no keys.
    """
    share = label.mean()
    keys, odds = [], []
    for column_ in columns:
        values, number = np.unique(column_, return_inverse=True)
        key, own = np.divmod(np.unique(number * len(label) + doc), len(label))
        n = np.bincount(key, minlength=len(values))
        toxic = np.bincount(key, weights=label[own], minlength=len(values))
        some = np.flatnonzero(n >= 3)
        keys.append(values[some])
        odds.append(np.log((toxic[some] + 0.5) / (n[some] - toxic[some] + 0.5)) - np.log((share + 1e-9) / (1 - share + 1e-9)))
    keys, odds = np.concatenate(keys), np.concatenate(odds)
    best = np.argsort(-np.abs(odds), kind="stable")[:limit]
    best = best[np.argsort(keys[best])]
    return keys[best], np.clip(odds[best], -3, 3).astype(np.float32)


def fit(texts: list[str], label: np.ndarray, prevalence: float, seed: int = 7) -> Network:
    """Train on whole texts: a toxic text by its highest window, a clean one by its highest and one more."""
    w = Words(pa.array(texts, pa.string()))
    n_words = np.diff(w.first)
    own, number = np.divmod(np.unique(np.repeat(np.arange(len(texts)), n_words) * max(1, len(w.words)) + w.number), max(1, len(w.words)))
    words, word_odds = _odds(own, [w.words[number]], label, VOCABULARY)
    parts, part_odds = _odds(own, (w.parts[number, k] for k in range(w.parts.shape[1])), label, 2 * VOCABULARY)
    net = Network(words, parts, word_odds, part_odds, seed)
    net.base = prevalence
    doc, start, length = w.windows()
    if not len(doc):
        return net
    strength = np.where(word_odds > 1.5, word_odds, 0)
    prior = np.concatenate([[0], np.cumsum(np.concatenate([[0], strength])[_lookup(words, w.words)][w.number])])
    score = (prior[start + length] - prior[start]).astype(np.float32)
    rng = np.random.default_rng(seed)
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([head, [len(doc)]]))
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for _ in range(EPOCHS):
        order = np.lexsort((-score, doc))
        top, other = order[head], head + rng.integers(0, size)
        clean = label[doc[other]] == 0
        rows = np.concatenate([top, other[clean]])
        rng.shuffle(rows)
        for at in range(0, len(rows), 128):
            pick = rows[at : at + 128]
            y = label[doc[pick]].astype(np.float32)
            weight = np.where(y > 0, 1.5, 1.0).astype(np.float32)
            step += 1
            used = _subset(w, start[pick], length[pick])
            for k, g in net.gradients(used, used.first[:-1], length[pick], y, weight).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net.p[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        score = net.logits(w, start, length)
    best = np.maximum.reduceat(score, head)
    net.calibration = _calibrated(best.astype(np.float64), label[doc[head]], prevalence)
    return net


def _subset(w: Words, start: np.ndarray, length: np.ndarray) -> Words:
    """Just these windows, one after another."""
    out = Words.__new__(Words)
    numbers = w.number[ranges(start, length)]
    distinct, out.number = np.unique(numbers, return_inverse=True)
    out.words, out.parts, out.n = w.words[distinct], w.parts[distinct], len(numbers)
    out.first = np.concatenate([[0], np.cumsum(length)])
    return out


def _calibrated(x: np.ndarray, y: np.ndarray, prevalence: float) -> tuple[float, float]:
    """Slope and offset of a logistic fit, with classes weighted as they are among all labelled rows."""
    share = y.mean()
    weight = np.where(y == 1, prevalence / max(share, 1e-9), (1 - prevalence) / max(1 - share, 1e-9))
    a, b = 1.0, 0.0
    for _ in range(50):
        s = _sigmoid(a * x + b)
        r, c = weight * (s - y), weight * s * (1 - s) + 1e-9
        grad = np.array([(r * x).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(c * x * x).sum() + 1e-3, (c * x).sum()], [(c * x).sum(), c.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(move[0], -2, 2)), b - float(np.clip(move[1], -2, 2))
    return a, b


def held_out(col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _excerpts(text, most_chars: int):
    """The text, or, if it is longer than ``most_chars``, evenly spaced parts of it that have as many together."""
    part = max(1, most_chars // EXCERPTS)
    starts = F.transform(F.sequence(F.lit(0), F.lit(EXCERPTS - 1)), lambda k: (F.floor((F.length(text) - part) * k / (EXCERPTS - 1)) + 1).cast("int"))
    return F.when(F.length(text) <= most_chars, text).otherwise(F.array_join(F.transform(starts, lambda at: F.substr(text, at, F.lit(part))), " "))


def train(docs: DataFrame, labels: DataFrame, most_docs: int = FIT_DOCS, most_chars: int = FIT_CHARS, most_bytes: int = FIT_BYTES) -> Network | None:
    """Fit on labelled rows that are not held out; None without labels of both classes that have texts. Null labels and ids don't count.

    The sample is bounded: of each class, the ``most_docs`` ids of the smallest hashes, of each text at most ``most_chars`` characters (evenly spaced excerpts of a
    longer one), and texts until they have ``most_bytes`` together, the one that crosses that bound included: a class with texts is never without one. An id with labels of
    both kinds counts as toxic, one with several texts has the least of them.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(most_docs) for k in (0, 1)]  # bounded, whatever the input
    wanted = F.broadcast(picked[0].unionByName(picked[1]))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    rows = text.join(wanted, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).withColumn("text", _excerpts(F.col("text"), most_chars))
    upto = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")  # no more rows than most_docs of each class
    size = F.octet_length("text")
    rows = rows.withColumn("_before", F.sum(size).over(upto) - size).where(F.col("_before") < most_bytes).drop("_before")
    rows = rows.toPandas().sort_values("id")
    label = rows["toxic"].to_numpy()
    if not len(rows) or label.min() == label.max():
        return None
    return fit(rows["text"].tolist(), label, counts[1] / (counts[0] + counts[1]))


def score_documents(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """doc_id, score, window_start and window_end (words of the highest window) for every row; with ``rows`` also the row itself (struct ``row``).

    Null, empty and wordless texts have the labelled rows' share of toxic ones as their score, and no window; without a
    network every score is 0. Repeated rows are rows of their own and have the same score; null ids stay null. An empty table gives no rows.
    """
    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"), *([row_struct(docs)] if rows else []))
    if net is None:
        none = F.lit(None).cast("long")
        return text.select(null_id().alias("doc_id"), F.lit(0.0).alias("score"), none.alias("window_start"), none.alias("window_end"), *(["row"] if rows else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 2 << 20):
            w = Words(b.column(1))
            doc, start, length = w.windows()
            logit = net.logits(w, start, length).astype(np.float64)
            score = np.full(b.num_rows, net.base)
            order = np.lexsort((-logit, doc))
            top = order[np.flatnonzero(np.concatenate([[True], doc[order][1:] != doc[order][:-1]]))] if len(doc) else order
            score[doc[top]] = _sigmoid(net.calibration[0] * logit[top] + net.calibration[1])
            a = np.full(b.num_rows, -1)
            e = a.copy()
            a[doc[top]] = start[top] - w.first[doc[top]]
            e[doc[top]] = a[doc[top]] + length[top]
            yield batch_of(id=column(b, "id"), score=score, window_start=pa.array(a, mask=a < 0), window_end=pa.array(e, mask=a < 0), **({"row": b.column(2)} if rows else {}))

    schema = with_row("id long, score double, window_start long, window_end long", docs.schema if rows else None)
    return text.mapInArrow(run, schema).withColumn("id", null_id()).withColumnRenamed("id", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
