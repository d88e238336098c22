"""Best-fit decreasing packing of token sequences.

Tokens. Texts are cut at white space and signs where the byte-level BPE's own
split pattern always cuts; each distinct piece of text is encoded once per worker by
``tokenizers`` and looked up by its hash afterwards. A document that spells a
special token is encoded whole, so such strings mean what the tokenizer says.

Packing. Best-fit decreasing looks at lengths only, and pieces of one length
are alike, so the histogram of lengths (at most ``capacity`` rows, whatever the
table holds) decides the packing of all rows: lengths go from long to short, a
segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and bins of equal capacity are filled as one range. The
result is exactly the packing of one sequential best-fit decreasing pass over
all pieces. The plan (ranges of ranks within a length -> ranges of bins) is
applied to the rows in a narrow pass; ranks come from pre-aggregated counts.

Defined results: null text counts as empty; an empty document is the end id
alone; a document longer than the capacity is cut into full pieces after a
first piece that takes the rest; repeated rows are packed each on their own;
an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.bytetext import Flat, byte_set, flat, slices, span_hashes
from codelens.llm.common import add_columns, cut, table
from codelens.llm.sharding import with_slots

CAPACITY = 2048
END_ID = 0
#: Distinct text pieces whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 1_000_000

_PLAIN = byte_set((0x21, 0x7E), (0x80, 0xC1), (0xC3, 0xE0), (0xE4, 0xFF))  # first bytes that surely are no white space
_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_SIGN = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_SPACE, _LINE = 0x20, 0x0A


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts through a memory of encoded text pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.first = np.zeros(1, np.int64)  # of the ids of each remembered piece
        self.ids = np.empty(0, np.uint32)

    def cuts(self, texts: Flat) -> np.ndarray:
        """Starts of the pieces: every text, and places where the split pattern always parts."""
        buf = texts.buf
        parts = np.zeros(len(buf) + 1, bool)
        if len(buf) > 1:
            blank = (buf[:-1] == _SPACE) | (buf[:-1] == _LINE)
            at = np.flatnonzero(blank & _PLAIN[buf[1:]])
            parts[at] = True
            parts[at[buf[at] == _LINE] + 1] = True
            parts[1:-1] |= _LETTER[buf[:-1]] & _SIGN[buf[1:]]
        for word in self.special:
            raw, found = buf.tobytes(), -1
            while (found := raw.find(word, found + 1)) >= 0:
                k = int(np.searchsorted(texts.offsets, found, "right")) - 1
                parts[texts.offsets[k]: texts.offsets[k + 1]] = False
        parts[texts.offsets] = True
        return np.flatnonzero(parts[:-1])

    def encode(self, texts: Flat) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text), without end ids."""
        if not len(texts.buf):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = self.cuts(texts)
        ends = np.append(starts[1:], len(texts.buf))
        distinct, example, which = np.unique(span_hashes(texts.buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            raw = [texts.buf[a:b].tobytes().decode() for a, b in zip(starts[example[new]], ends[example[new]], strict=True)]
            made = [e.ids for e in self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)]
            place = len(self.first) - 1 + np.arange(len(new))
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.uint32, sizes.sum())])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            where = np.searchsorted(self.known, distinct[new])
            self.known, self.place = np.insert(self.known, where, distinct[new]), np.insert(self.place, where, place)
        place = self.place[np.searchsorted(self.known, distinct)][which]
        n = self.first[place + 1] - self.first[place]
        ids = self.ids[np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        before = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, texts.offsets)]
        return ids, np.diff(before)


_encoders: dict[str, Encoder] = {}


def _tokenize(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(path, None) or Encoder(path)
        _encoders[path] = encoder
        for batch in batches:
            for lo, hi, part in slices(flat(batch.column(1))):
                ids, n = encoder.encode(part)
                doc = np.repeat(np.arange(hi - lo), n)
                whole = np.full(len(ids) + hi - lo, end_id, np.uint32)
                whole[np.arange(len(ids)) + doc] = ids
                n = n + 1
                pieces = -(-n // capacity)
                of = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                rest = (n - (pieces - 1) * capacity)[of]
                start = np.where(piece == 0, 0, rest + (piece - 1) * capacity)
                length = np.where(piece == 0, rest, capacity)
                offsets = np.concatenate([[0], np.cumsum(length)]) * 4
                binary = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary],
                    names=["key", "piece", "start", "length", "ids"])
    return run


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, ids) of each piece; ids as little-endian unsigned 32-bit numbers.

    ``tokenizer`` names a byte-level BPE file for ``tokenizers`` that executors can read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(_tokenize(tokenizer or default_tokenizer(), capacity, end_id), f"key {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("key", key)


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that says which capacities occur."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first bin, bins)

    def _mark(self, room: int) -> None:
        i = room + self.size
        self.any[i] = bool(self.ranges[room])
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def push(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.ranges[room].append((first, bins))
            self._mark(room)

    def pop(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        self._mark(room)
        return out

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that an open bin has."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of pieces by length: rows (length, first rank, first bin, pieces in each bin, offset).

    A row holds for the ranks of its length from its own up to the next row's.
    """
    bins, open_bins, out = 0, OpenBins(capacity), []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = open_bins.tightest(length)
            if room is None:
                more = -(-left // (capacity // length))
                open_bins.push(capacity, bins, more)
                bins, room = bins + more, capacity
            first, count = open_bins.pop(room)
            each = room // length
            full = min(count, left // each)
            if full:
                out.append((length, rank, first, each, capacity - room))
                open_bins.push(room - each * length, first, full)
                rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if count and left and left < each:
                out.append((length, rank, first, each, capacity - room))
                open_bins.push(room - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            open_bins.push(room, first, count)
    return out


def _place(rows: list[tuple[int, int, int, int, int]]):
    length, rank, first, each, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 5
    order = np.lexsort([rank, length])
    length, rank, first, each, offset = length[order], rank[order], first[order], each[order], offset[order]
    known = length << 44 | rank

    def run(lengths: pa.Array, ranks: pa.Array) -> list[pa.Array]:
        n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        k = np.searchsorted(known, n << 44 | r, "right") - 1
        nth = r - rank[k]
        return [pa.array(first[k] + nth // each[k]), pa.array(offset[k] + nth % each[k] * n)]
    return run


def pack(pieces: DataFrame, order: Sequence[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``order`` tells rows of one length apart (rows equal in it are alike)."""
    counts = {r[0]: r[1] for r in pieces.groupBy(length).agg(F.count("*")).collect()}  # a row for each length
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    ranked = with_slots(pieces, length, order, sum(counts.values()), out="_rank")
    placed = add_columns(ranked, [length, "_rank"], _place(plan(counts, capacity)), [("sequence_id", "long"), ("offset", "long")])
    return placed.drop("_rank")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of the packed sequences, from pieces that still carry their ids (a sequence is at most one capacity)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of ``docs``."""
    pieces = cut(tokenize(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    packed = pack(pieces, ["doc_id", "piece", "ids_crc32"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
