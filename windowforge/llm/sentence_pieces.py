"""Encoding to sentence pieces that keeps its offsets, and decoding.

A text is normalised first: at every place the longest key of the model's compiled character map is replaced, other characters stay, blanks
become the mark of the model. Each byte of the result knows the byte of the text that it came from. The normalised text is then cut where no
piece of the vocabulary can span, each distinct cut is parted into pieces once, and the pieces' lengths and the recorded alignment give every piece's
bytes in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowforge.llm.common import batch_of, id_text, null_id, ranges, small_batches, table, text_buffer
from windowforge.llm.tokens import default_path

#: The mark that stands for a blank.
MARK = "▁".encode()
#: Bytes of text encoded at once; cuts whose pieces a Python worker keeps (beyond it all are forgotten, which costs time alone).
BATCH_BYTES, CACHE_ENTRIES = 1 << 20, 600_000
#: Types of pieces in a model file.
NORMAL, USER_DEFINED, BYTE, BPE = 1, 4, 6, 2


def _row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each byte."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class CharacterMap:
    """A compiled map: a double array over the keys' bytes whose leaves point into a pool of replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).astype(np.int64)
        self.pool = np.frombuffer(blob, np.uint8, offset=4 + size)
        self.pool_ends = np.flatnonzero(self.pool == 0)

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest key that begins at each of ``starts`` and ends by its limit (0: none), and its place in the pool."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        live, node, at = np.arange(len(starts)), np.full(len(starts), self._offset(self.units[0])), 0
        while True:
            inside = starts[live] + at < limits[live]
            live, node = live[inside], node[inside]
            if not len(live):
                return length, value
            byte = data[starts[live] + at].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            goes = (unit & 0x800000FF) == byte
            live, unit, node, at = live[goes], unit[goes], (node ^ self._offset(unit))[goes], at + 1
            leaf = (unit >> 8) & 1 == 1
            length[live[leaf]], value[live[leaf]] = at, self.units[node[leaf]] & 0x7FFFFFFF


class Normaliser:
    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.tidy, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is replaced or kept as one: places of all units in the text, and the places and lengths of what stands for them in text + pool."""
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        limits = offsets[1:][_row_of(offsets)[starts]]
        own = np.diff(np.append(starts, len(data)))  # bytes of each character
        if self.map is None:
            return starts, starts, own
        length, value = self.map.longest(data, starts, limits)
        kept, until = np.ones(len(starts), bool), 0
        for k in np.flatnonzero(length > own).tolist():  # keys of several characters, in order
            if starts[k] >= until:
                until = int(starts[k] + length[k])
                kept[k + 1 : np.searchsorted(starts, until)] = False
        starts, own, length, value = starts[kept], own[kept], length[kept], value[kept]
        hit = length > 0
        ends = self.map.pool_ends[np.searchsorted(self.map.pool_ends, value)]
        return starts, np.where(hit, len(data) + value, starts), np.where(hit, ends - value, own)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes, each row's first, and for each of them the byte it came from (counted in the row), with the end of what was read after each row's last:
        row r's alignment begins at offsets[r] + r."""
        n, row = len(offsets) - 1, _row_of(offsets)
        starts, places, lengths = self.units(data, offsets)
        source = np.concatenate([data, self.map.pool]) if self.map else data
        out = source[ranges(places, lengths)]
        unit = np.repeat(np.arange(len(starts)), lengths)
        owner, origin = row[starts[unit]], starts[unit]
        end = offsets[1:].copy()  # what a row's alignment ends with
        if self.tidy:  # blanks that begin a unit go if one stands before them or nothing does; those at a row's end go
            blank, place = out == 0x20, np.arange(len(out))
            fresh = np.diff(unit, prepend=-1) > 0
            after = np.append(True, blank[:-1])[: len(out)] | (np.diff(owner, prepend=-1) > 0)
            head = np.maximum.accumulate(np.where(fresh, place, 0))
            leading = blank & (np.maximum.accumulate(np.where(blank, -1, place)) < head)
            keep = ~(leading & after[head])
            out, unit, owner, origin = out[keep], unit[keep], owner[keep], origin[keep]
            last = np.full(n, -1)
            solid = out != 0x20
            if self.escape and len(out) > 2:  # a mark of the text's own ends it like a blank
                own = np.flatnonzero((out[:-2] == MARK[0]) & (out[1:-1] == MARK[1]) & (out[2:] == MARK[2]))
                solid[own], solid[own + 1], solid[own + 2] = False, False, False
            solid = np.flatnonzero(solid)
            last[owner[solid]] = solid
            keep = np.arange(len(out)) <= last[owner]
            for r, at in zip(owner[~keep][::-1].tolist(), origin[~keep][::-1].tolist(), strict=True):
                end[r] = at
            out, owner, origin = out[keep], owner[keep], origin[keep]
            begins = np.full(n, -1)
            begins[owner[::-1]] = origin[::-1]
            prefixed = begins >= 0
        else:
            prefixed, begins = np.diff(offsets) > 0, offsets[:-1]
        # blanks become marks of three bytes; a row begins with one
        mark = np.frombuffer(MARK if self.escape else b" ", np.uint8)
        wide = np.where(out == 0x20, len(mark), 1)
        lead = np.where(prefixed & self.prefix, len(mark), 0)
        counts = np.bincount(owner, weights=wide, minlength=n).astype(np.int64) + lead
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(int(at[-1]), np.uint8)
        align = np.zeros(len(flat) + n, np.int64)
        shift = np.concatenate([[0], np.cumsum(wide)])
        before = shift[np.searchsorted(owner, np.arange(n))]  # bytes of earlier rows
        where = shift[:-1] - before[owner] + at[owner] + lead[owner]
        for k in range(len(mark)):
            some = wide > k
            flat[where[some] + k] = np.where(out[some] == 0x20, mark[k], out[some])
            align[where[some] + k + owner[some]] = origin[some] - offsets[owner[some]]
        rows = np.flatnonzero(lead)
        for k in range(len(mark)):
            flat[at[rows] + k] = mark[k]
            align[at[rows] + k + rows] = begins[rows] - offsets[rows]
        align[at[1:] + np.arange(n)] = end - offsets[:-1]
        return flat, at, align


class PieceModel:
    """Encodes batches of texts exactly as the library does, with the bytes of each piece."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as files

        model = files.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("needs a model of merged pairs with bytes for unknown characters and no symbols of the user's")
        self.processor = SentencePieceProcessor(model_file=path)
        self.normalise, self.entries = Normaliser(model.normalizer_spec), entries
        self.end_id = self.processor.eos_id()
        plain = files.ModelProto()
        plain.CopyFrom(model)
        plain.normalizer_spec.Clear()
        plain.normalizer_spec.add_dummy_prefix = plain.normalizer_spec.remove_extra_whitespaces = plain.normalizer_spec.escape_whitespaces = False
        self.parter = SentencePieceProcessor(model_proto=plain.SerializeToString())
        self.n_bytes = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        mark = MARK.decode() if self.normalise.escape else " "
        #: No piece has a mark behind anything but marks: texts may be cut there.
        self.cuts = not any(mark in p.piece.lstrip(mark) for p in model.pieces if p.type == NORMAL)
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        found = self.parter.encode(words, num_threads=1)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(lengths.sum()))
        self.number.update(zip(words, range(len(self.off) - 1, len(self.off) - 1 + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, flat])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lengths)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids (without an end id), each row's first (one more than rows), and every piece's first byte and last + 1 in its row's text."""
        flat, at, align = self.normalise(data, offsets)
        n = len(offsets) - 1
        edge = np.zeros(len(flat) + 1, bool)
        edge[at] = True
        if self.cuts:
            mark = flat == MARK[0]
            if self.normalise.escape:
                mark = mark & (np.append(flat[1:], 0) == MARK[1]) & (np.append(flat[2:], [0, 0])[: len(flat)] == MARK[2])
                inner = np.zeros(len(flat), bool)  # does a mark end before this byte?
                inner[3:] = mark[:-3]
            else:
                mark = flat == 0x20
                inner = np.append(False, mark[:-1])[: len(flat)]
            edge[:-1] |= mark & ~inner
        edges = np.flatnonzero(edge)
        words = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.number) + len(distinct) > max(self.entries, len(distinct)):
            self.reset()
        new = [w for w in distinct if w not in self.number]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()] if len(edges) > 1 else np.zeros(0, np.int64)
        lengths = self.off[number + 1] - self.off[number]
        ids = self.ids[ranges(self.off[number], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        first = sums[np.searchsorted(edges, at)]
        ends = np.cumsum(self.n_bytes[ids])  # pieces cover the normalised text without a gap
        owner = np.repeat(np.arange(n), np.diff(first))
        begin = ends - self.n_bytes[ids]
        return ids, first, align[begin + owner], align[ends + owner]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1)


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of this Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the end id), starts and ends (bytes of the UTF-8 text that each piece stands for; the end id's are both its length), decoded.

    A row for each row, repeated ids and texts included. A null or empty text has the end id alone and decodes to an empty text; a null id stays null; an
    empty table gives no rows. Bytes that stand for one character each have their own byte as span. No shuffle; a text has to fit a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in small_batches(batches, "text", BATCH_BYTES):
            data, off = text_buffer(b.column(1))
            ids, first, begin, end = model.encode(data, off)
            rows, last = np.arange(b.num_rows), first[1:]
            put = lambda x, more: np.insert(x, last, more)
            ids, size = put(ids, model.end_id).astype(np.int32), np.diff(off)
            bounds = pa.array(np.append(first[:-1] + rows, len(ids)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ids, put(begin, size), put(end, size))]
            whole, at = ids.tolist(), bounds.to_pylist()
            yield batch_of(id=b.column(0), ids=lists[0], starts=lists[1], ends=lists[2], decoded=pa.array(model.decode([whole[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]), pa.string()))

    out = id_text(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>, starts array<long>, ends array<long>, decoded string")
    return out.select(null_id().alias("doc_id"), "ids", "starts", "ends", "decoded")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), default_path("piece_bpe_32k.model"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
