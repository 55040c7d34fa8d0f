"""Exact, cached encoding with the public tokenizer files.

Each text is cut before blanks, where neither tokenizer lets a token span the cut; a piece is encoded once and
then looked up. Texts with places where the cut could matter are encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from windowforge.llm.common import ranges, text_buffer

#: Entries kept by one Python worker; beyond it those seldom used are forgotten, which costs time but changes nothing.
CACHE_ENTRIES = 900_000
#: Marks that both files' patterns part from the letters before them and take together.
MARKS = ".,;:!?*#$%&()+-/=@[]^_{}~"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in both files: a printable character for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
#: For texts that are blanks and marks besides letters: those keep their places.
_LETTERS = {b: c for b, c in BYTE_LETTERS.items() if b >= 0x80}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        return -1


class PieceEncoder:
    """``glued``: a blank belongs to the word after it (byte-level files); else white space is dropped."""

    def __init__(self, path: str, glued: bool, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.glued, self.entries = Tokenizer.from_file(path), glued, entries
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has ids beyond 16 bits")
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.stop = self._ids(["."])[0][0]
        self.reset()

    def reset(self) -> None:
        self.number = _Numbers({"": 0})
        self.tails: dict[str, list[int]] = {}  # ids of marks behind letters
        self.ids, self.off, self.used = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), 0
        self.uses, self.entered = np.zeros(1 << 14, np.uint32), 1  # by number: batches that used it; numbers given out

    def forget(self) -> None:
        """Keep at most half of the entries: those that most batches used, twice at least."""
        uses = self.uses[: self.entered]
        least = max(2, int(np.partition(uses, -self.entries // 2)[-self.entries // 2]) + 1) if len(uses) > self.entries // 2 else 2
        kept = np.flatnonzero(uses >= least)
        kept = kept[kept > 0]
        again = np.full(len(uses), -1, np.int64)
        again[0], again[kept] = 0, np.arange(1, len(kept) + 1)
        words, numbers = list(self.number), np.fromiter(self.number.values(), np.int64, len(self.number))
        ids, off, times = self.ids, self.off, uses[kept]
        self.reset()
        lengths = off[kept + 1] - off[kept]
        self._append([], ids[ranges(off[kept], lengths)], lengths)
        self.uses[1 : len(kept) + 1] = times
        numbers = again[numbers]
        self.number.update((words[i], n) for i, n in zip(np.flatnonzero(numbers > 0).tolist(), numbers[numbers > 0].tolist(), strict=True))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _append(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = self.entered, len(ids)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(lengths) + 1 > len(self.off):
            self.off, self.uses = np.concatenate([self.off, np.zeros_like(self.off)]), np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.ids[self.used : self.used + n] = ids
        self.off[first] = self.used
        self.off[first + 1 : first + len(lengths) + 1] = self.used + np.cumsum(lengths)
        self.used += n
        self.entered += len(lengths)
        self.number.update(zip(pieces, range(first, first + len(pieces))))

    def _base(self, piece: str) -> tuple[str, str, bool]:
        """What a piece's ids follow from, letters and the marks behind them; and whether those are Latin letters alone, which neither
        file's pattern parts and no normaliser changes but for case."""
        base = piece.rstrip(MARKS)
        if base.isalpha() and (base.isascii() or max(base) < "\u0250"):
            low = base if self.glued else base.lower()
            if low.isascii() or low.isalpha():  # a mark split off by the change of case may join the closing ones
                return low, piece[len(base) :], True
        return piece, "", False

    def _learn(self, pieces: list[str]) -> None:
        forms = list(map(self._base, pieces))
        known = self.number
        new = {b: plain for b, _, plain in forms if b not in known}
        plain = [b for b, p in new.items() if p]
        self._encode_plain([b for b in plain if b.isascii()], str)
        self._encode_plain([b for b in plain if not b.isascii()], lambda t: t.encode().decode("latin-1").translate(_LETTERS))
        self._encode_other([b for b, p in new.items() if not p])
        known.update((p, known[b]) for p, (b, tail, _) in zip(pieces, forms, strict=True) if not tail and p != b)
        closed = [(p, known[b], tail) for p, (b, tail, _) in zip(pieces, forms, strict=True) if tail]
        if closed:
            words, base, tails = zip(*closed, strict=True)
            fresh = [t for t in dict.fromkeys(tails) if t not in self.tails]
            self.tails.update(zip(fresh, self._ids(fresh) if fresh else [], strict=True))
            base, tails = np.array(base), [self.tails[t] for t in tails]
            n, more = self.off[base + 1] - self.off[base], np.fromiter(map(len, tails), np.int64, len(tails))
            lengths = n + more
            at = np.cumsum(lengths) - lengths
            ids = np.empty(int(lengths.sum()), np.uint16)
            ids[ranges(at, n)] = self.ids[ranges(self.off[base], n)]
            ids[ranges(at + n, more)] = np.fromiter(chain.from_iterable(tails), np.uint16, int(more.sum()))
            self._append(words, ids, lengths)

    def _encode_plain(self, pieces: list[str], letters) -> None:
        """Letters by the merges alone, with full stops between, which no such piece has; ``letters`` puts bytes as the files do."""
        lead = BYTE_LETTERS[0x20] if self.glued else ""
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            joined = lead + letters(" . \0".join(part)).replace("\0", lead)
            ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            stop = ids == self.stop
            self._append(part, ids[~stop], np.diff(np.concatenate([[-1], np.flatnonzero(stop), [len(ids)]])) - 1)

    def _encode_other(self, other: list[str]) -> None:
        """By the whole tokenizer, with a special token between, which parts pieces before anything else is applied."""
        lead = " " if self.glued else ""
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            odd = {i: p for i, p in enumerate(part) if self.mark in p}
            joined = self.mark.join(lead + ("" if i in odd else p) for i, p in enumerate(part)) if odd else self.mark.join(lead + p for p in part)
            ids = np.array(self._ids([joined])[0], np.int64)
            at_mark = np.flatnonzero(ids == self.mark_id)
            lengths = np.diff(np.concatenate([[-1], at_mark, [len(ids)]])) - 1
            ids = ids[ids != self.mark_id]
            if odd:
                found = np.split(ids, np.cumsum(lengths)[:-1])
                for i, p in odd.items():
                    found[i] = np.array(self._ids([lead + p])[0], np.int64)
                ids, lengths = np.concatenate(found), np.array([len(x) for x in found])
            self._append(part, ids, lengths)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint16) and each text's first (int64, one more than texts)."""
        if len(self.number) > self.entries:
            self.forget()
        data = np.frombuffer((" ".join(texts) + " ").encode() if texts else b"", np.uint8)
        blank = data == 0x20 if self.glued else (data == 0x20) | (data == 0x0A)
        edges = np.concatenate([[0], np.flatnonzero(blank) + 1])
        offsets = edges.astype(np.int64).tobytes()
        pieces = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = text_buffer(pieces.dictionary)[0].tobytes().decode()  # each with its blank
        at, words = pieces.indices.to_numpy(), (distinct if self.glued else distinct.replace("\n", " ")).split(" ")[:-1]
        known = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        missed = np.flatnonzero(known < 0).tolist()
        if missed:
            self._learn(list(dict.fromkeys(words[i] for i in missed)))
            known[missed] = [self.number[words[i]] for i in missed]
        self.uses[known] += 1  # words of one number count once
        numbers = known[at]
        if self.glued:
            count = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
        else:
            count = np.fromiter((t.count(" ") + t.count("\n") + 1 for t in texts), np.int64, len(texts))
        whole: dict[int, list[int]] = {}
        if self.glued:  # heads are encoded alone; a text with blanks in a row or behind other white space is encoded whole
            head = np.cumsum(count) - count
            odd = np.fromiter((not w or w[-1].isspace() for w in words), bool, len(words))[at]
            alone = count == 1
            is_whole = np.add.reduceat(odd, head, dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
            is_whole &= ~alone
            numbers[head] = 0
            numbers[np.repeat(is_whole, count)] = 0
            heads = [words[k] for k in at[head].tolist()]
            lead = [t if w else h for t, h, w in zip(texts, heads, is_whole.tolist(), strict=True)]
            whole = dict(enumerate(self._ids(lead))) if lead else {}
        lengths = self.off[numbers + 1] - self.off[numbers]
        bounds = np.concatenate([[0], np.cumsum(count)])
        sums = np.concatenate([[0], np.cumsum(lengths)])
        tail = sums[bounds[1:]] - sums[bounds[:-1]]
        ids = self.ids[ranges(self.off[numbers], lengths)]
        if not self.glued:
            return ids, np.concatenate([[0], np.cumsum(tail)])
        lead = np.fromiter((len(whole[i]) for i in range(len(texts))), np.int64, len(texts))
        off = np.concatenate([[0], np.cumsum(lead + tail)])
        out = np.zeros(int(off[-1]), np.uint16)
        out[ranges(off[:-1], lead)] = np.fromiter((x for i in range(len(texts)) for x in whole[i]), np.uint16, int(lead.sum()))
        out[ranges(off[:-1] + lead, tail)] = ids
        return out, off


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, glued: bool) -> PieceEncoder:
    """The encoder of this Python worker."""
    if (path, glued) not in _ENCODERS:
        _ENCODERS[path, glued] = PieceEncoder(path, glued)
    return _ENCODERS[path, glued]
