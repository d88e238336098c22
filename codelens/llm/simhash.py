"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

Fingerprints: 64 bits, each the majority over the XXH64 hashes of the text's
word shingles. Two fingerprints link at MAX_BITS (4) or fewer differing bits.

Finding the links. The 64 bits are cut into segments of 22, 21 and 21 bits.
Four errors over three segments leave two segments with at most two errors
each (pigeonhole). The perfect binary Golay code (23, 12) turns that into
equal keys: every 23-bit word lies within 3 bits of exactly one codeword; a
segment is decoded together with its 23 neighbours at one bit, which gives 1
or 6 different codeword indices, and two segments that differ in at most two
bits have a common neighbour and so a common index. A fingerprint's keys are
the pairs of indices of every two segments (at most 108). Distinct
fingerprints are sorted by key, those that share a key are compared, and only
a spanning forest of the true links of a key leaves the task.

A key that more than RUN_LIMIT distinct fingerprints share goes to a second
round: its members are cut into blocks and every two blocks meet in a task of
their own, so no task holds more than two blocks and no link is lost.

Components come from alternating large-star and small-star steps over tables;
nothing of them reaches the driver but a checksum for each step.

Defined results: null text counts as empty; a text without words has
fingerprint 0, linked like any other; equal fingerprints are one component;
component_id is the smallest doc_id of the component; repeated rows get equal
results. ``keep_first`` keeps one row of each component, whatever its doc_id:
that of the smallest doc_id (a null one counts as the largest), among rows of
this doc_id that of the smallest text hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.common import add_columns, cut, keep_where, parts_for, table, text_or_empty

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Distinct fingerprints of one key that one task compares; more go to the second round in blocks of half as many.
RUN_LIMIT = 100_000
#: Runs up to this length are compared pair by pair in one vectorised pass.
SHORT_RUN = 8
#: Distinct fingerprints whose keys one task makes.
FINGERPRINTS_PER_TASK = 20_000
_BLOCK = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text, as an unsigned number."""
    split = text.lower().split()  # of bytes: only A-Z folds, only ASCII white space parts
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(split))
    n = len(split) - width + 1
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo + width - 1: hi + width - 1].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array(np.fromiter((fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in column), np.uint64, len(column)).view(np.int64))]
    return run


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number."""
    return add_columns(docs, [text], _fingerprints(shingle), [(out, "long")])


# ---- Golay keys

_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_PAIRS = ((0, 1), (0, 2), (1, 2))
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(parity of each 12-bit message, error pattern of each 11-bit syndrome) of the systematic code."""
    parity = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= _GENERATOR << (bit - 11)
        parity[m] = r
    leader = np.zeros(2048, np.int64)
    single = [1 << i for i in range(23)]
    errors = [0] + single + [a ^ b for i, a in enumerate(single) for b in single[:i]]
    errors += [a ^ b ^ c for i, a in enumerate(single) for j, b in enumerate(single[:i]) for c in single[:j]]
    e = np.array(errors)
    leader[parity[e >> 11] ^ (e & 2047)] = e
    return parity, leader


_PARITY, _LEADER = _golay()
_FLIPS = np.array([0] + [1 << i for i in range(23)])


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, values): the different codeword indices of each 23-bit word and its neighbours at one bit."""
    near = words[:, None] ^ _FLIPS
    index = np.sort((near ^ _LEADER[_PARITY[near >> 11] ^ (near & 2047)]) >> 11, axis=1)
    new = np.ones(index.shape, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    return new.sum(axis=1), index[new]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key): all keys of each fingerprint."""
    found = [indices((fps >> np.uint64(lo)).astype(np.int64) & ((1 << n) - 1)) for lo, n in _SEGMENTS]
    places, out = [], []
    for number, (a, b) in enumerate(_PAIRS):
        (na, va), (nb, vb) = found[a], found[b]
        n = na * nb
        row = np.repeat(np.arange(len(fps)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = (np.cumsum(na) - na)[row] + inside // nb[row]
        j = (np.cumsum(nb) - nb)[row] + inside % nb[row]
        places.append(row)
        out.append((number << 24 | va[i] << 12 | vb[j]).astype(np.int32))
    return np.concatenate(places), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fps), 2000):
            part = fps[lo: lo + 2000]
            place, key = keys(part)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(part[place].view(np.int64))})


# ---- links

def near(a: np.ndarray, b: np.ndarray | np.uint64, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what the links among ``fps`` connect: each member meets only those not yet reached."""
    links, left = [], fps
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            pivot = front.pop()
            hit = near(left, pivot, bits)
            if hit.any():
                front.extend(left[hit])
                links += [(int(pivot), int(x)) for x in left[hit]]
                left = left[~hit]
    return links


class Union:
    """Links of one task, handed on as (member, smallest member seen) rows."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while (y := self.up.get(x, x)) != top:
            self.up[x], x = top, y
        return top

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def rows(self) -> pa.RecordBatch:
        members = list(self.up)
        a = np.array([self.root(x) for x in members], np.uint64).view(np.int64)
        b = np.array(members, np.uint64).view(np.int64)
        self.up = {}
        return pa.RecordBatch.from_pydict({"key": pa.array(np.full(len(a), -1, np.int32)), "a": pa.array(a), "b": pa.array(b)})


def _links(bits: int, run_limit: int):
    """From rows sorted by (key, fp): forest rows (-1, a, b), and rows (key, fp, fp) of keys that are too common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Union()
        held_k, held_f = np.empty(0, np.int32), np.empty(0, np.uint64)
        common = None  # the key whose run passed the limit

        def work(k: np.ndarray, f: np.ndarray) -> None:
            if not len(k):
                return
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(start, len(k)))
            short = np.repeat(size <= SHORT_RUN, size)
            for d in range(1, SHORT_RUN):
                hit = (k[d:] == k[:-d]) & short[d:]
                hit[hit] = near(f[d:][hit], f[:-d][hit], bits)
                for a, b in zip(f[:-d][hit].tolist(), f[d:][hit].tolist(), strict=True):
                    joined.add(a, b)
            for s, n in zip(start[size > SHORT_RUN], size[size > SHORT_RUN], strict=True):
                for a, b in forest(f[s: s + n], bits):
                    joined.add(a, b)

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            if common is not None:
                n = int(np.searchsorted(k, common, "right"))
                yield _rows(k[:n], f[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    held_k, held_f = k, f
                    continue
                common = None
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0
            work(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
            if len(held_k) > run_limit:
                common = held_k[0]
                yield _rows(held_k, held_f)
                held_k, held_f = held_k[:0], held_f[:0]
            if len(joined.up) > 500_000:
                yield joined.rows()
        work(held_k, held_f)
        yield joined.rows()
    return run


def _rows(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array(k, pa.int32()), "a": pa.array(f.view(np.int64)), "b": pa.array(f.view(np.int64))})


def _block_links(bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = forest(np.unique(pdf["a"].to_numpy()).view(np.uint64), bits)
        return pd.DataFrame(np.array(rows, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])
    return run


def links(fps: DataFrame, bits: int = MAX_BITS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b) rows that connect exactly the distinct fingerprints (column fp) within ``bits`` of each other."""
    if bits > MAX_BITS:
        raise ValueError("the keys find up to four differing bits")
    # a fingerprint becomes up to 108 rows: many tasks make them, however few hold the fingerprints
    spread = fps.repartition(parts_for(fps.count(), FINGERPRINTS_PER_TASK, fps.sparkSession.sparkContext.defaultParallelism), "fp")
    keyed = spread.mapInArrow(_keyed, "key int, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = cut(keyed.mapInArrow(_links(bits, run_limit), "key int, a long, b long"))
    common = found.filter("key >= 0").select("key", "a")
    near_rows = found.filter("key < 0").select("a", "b")
    if common.isEmpty():
        return near_rows
    blocks = common.groupBy("key").agg(F.ceil(F.count("*") / (run_limit / 2)).cast("int").alias("blocks"))
    dealt = common.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = meets.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "a")
    return near_rows.union(pairs.groupBy("key", "lo", "hi").applyInPandas(_block_links(bits), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node of the component.

    Large-star joins the larger neighbours of a node to its smallest neighbour,
    small-star the smaller ones; both keep connectivity, and the edges end as
    one star for each component.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(lowest, F.col("a") == F.col("node")).select(F.col("low").alias("a"), "b").filter("a <> b").distinct()
        smallest = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(smallest, "b").select(F.explode(F.array(
            F.struct(F.col("low").alias("a"), F.col("b").alias("b")),
            F.struct(F.least("low", "a").alias("a"), F.greatest("low", "a").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.filter("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = state


def _rooted(first: DataFrame, bits: int) -> DataFrame:
    """``first`` (one row for each fingerprint fp) with the root of its component."""
    roots = cut(components(links(first.select("fp"), bits)))
    return first.join(roots, F.col("fp") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(key, fp, component_id) of every row."""
    slim = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    rows = cut(with_fingerprint(slim, "text", shingle).select("key", "fp"))
    first = cut(rows.groupBy("fp").agg(F.min("key").alias("low")))
    placed = _rooted(first, bits)
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = placed.join(lowest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of the smallest key, with the input's columns; equal (key, text) rows count as one document."""
    def decide(rows: DataFrame, key: str, text: str) -> DataFrame:
        digest = F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))
        slim = rows.select(F.col(key).alias("key"), digest.alias("digest"), text_or_empty(text).alias("text"))
        one = F.struct(F.col("key").isNull().alias("no_key"), "key", "digest")
        first = cut(with_fingerprint(slim).groupBy("fp").agg(F.min(one).alias("low")))
        kept = _rooted(first, MAX_BITS).groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key").alias("first"), F.col("low.digest").alias("kept"))
        marked = rows.withColumn("digest", digest)
        same = F.col(key).eqNullSafe(F.col("first")) & (F.col("digest") == F.col("kept"))
        return marked.join(kept, same, "left_semi").dropDuplicates([key, "digest"])

    return keep_where(docs, decide, key, text)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
