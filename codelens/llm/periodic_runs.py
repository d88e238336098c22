"""Periodic runs of words by grammar compression, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q that cannot be
extended with that period and has at least ``least_times`` periods and
``least_words`` words.

Grammar. The word ids of each document are compressed by Re-Pair in rounds: all
pairs that occur twice or more in their document get a nonterminal, and where
occurrences overlap the more frequent pair wins, until no pair occurs twice. What
is left of a document is joined by a balanced tree, so the document is one
derivation tree in which every run lies in a lowest node and crosses the boundary
between that node's two parts.

Runs. A run of at least four periods has two of them on one side of the boundary
it crosses, so for every boundary and period q the words beside it are compared
with those q further; equal stretches are found by hashes of prefixes (62 bits)
and extended as far as the node goes by binary search. This happens once for each
nonterminal, at its first occurrence; the runs found are moved to all places where
Re-Pair put the nonterminal. A run that a node cuts off is part of a longer one
found further up: of the intervals of one period only the maximal stay, and of the
periods of one interval only the smallest.

Work is done slice by slice of a record batch with numpy; a slice has about 1 MB
of text or one text, and takes about 250 bytes for each of its words, so memory
follows the longest text, not the table.

Defined results: a null or empty text has no words, no runs and an empty text
left; repeated rows are treated each on their own; an empty table gives no rows;
all columns of the input pass through, but for columns named runs and collapsed,
which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.bytetext import Flat, byte_set, flat, mix, slices, words
from codelens.llm.common import add_columns, table, text_or_empty
from codelens.llm.filter_audit import split_words

LEAST_WORDS = 6
LEAST_TIMES = 4
#: (boundary, period) pairs that are compared at once.
BLOCK = 1 << 20

_WORD = ~byte_set((0x20, 0x20), (0x09, 0x0D))
RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_PRIMES = ((2147483629, 1103515245), (2147483587, 690069069))  # modulus, base


def _gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes (or items) buf[starts[i]: starts[i] + lengths[i]], one after the other."""
    first = np.cumsum(lengths) - lengths
    return buf[np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))]


def word_array(texts: Flat) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, bounds): text i has the words bounds[i]:bounds[i + 1]."""
    starts, ends, bounds = words(texts, _WORD)
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = _gather(texts.buf, starts, lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)), bounds


@dataclass
class Nodes:
    """Places of derivation nodes: words start:mid are the left part, mid:end the right part."""

    start: np.ndarray
    mid: np.ndarray
    end: np.ndarray

    @classmethod
    def join(cls, parts: list[Nodes]) -> Nodes:
        return cls(*[np.concatenate([getattr(p, f) for p in parts]) if parts else np.empty(0, np.int64) for f in ("start", "mid", "end")])


def re_pair(symbols: np.ndarray) -> tuple[Nodes, np.ndarray, np.ndarray, np.ndarray]:
    """(first occurrences of the rules, starts of what is left, rule of each occurrence, start of each occurrence).

    ``symbols`` are word ids from 0 that no two documents share, so a pair that
    occurs twice lies inside one document.
    """
    seq, at = symbols.astype(np.int64), np.arange(len(symbols))
    ends = at + 1
    next_symbol = int(seq.max()) + 1 if len(seq) else 0
    first_symbol = next_symbol
    rules, used_rule, used_at = [], [], []
    while len(seq) > 1:
        often = np.bincount(seq) > 1
        often = often[seq]
        cand = np.flatnonzero(often[:-1] & often[1:])
        if not len(cand):
            break
        left, right = seq[cand], seq[cand + 1]
        same = left == right
        if same.any():  # of a stretch aaaa only every second pair
            fresh = same.copy()
            fresh[1:] &= ~(same[:-1] & (cand[1:] == cand[:-1] + 1))
            begin = np.maximum.accumulate(np.where(fresh, cand, 0))
            whole = ~same | ((cand - begin) % 2 == 0)
            cand, left, right = cand[whole], left[whole], right[whole]
        which, pairs = pd.factorize(left << 32 | right)
        count = np.bincount(which)
        keep = count[which] > 1
        if not keep.any():
            break
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort([mix(pairs.astype(np.uint64)), count])] = np.arange(1, len(pairs) + 1)
        cand, which = cand[keep], which[keep]
        strength, pair_at = np.zeros(len(seq) + 1, np.int64), np.zeros(len(seq), np.int64)
        strength[cand + 1], pair_at[cand] = rank[which], which
        mine = strength[cand + 1]
        after = np.where(cand + 2 < len(strength), strength[np.minimum(cand + 2, len(seq))], 0)
        chosen = cand[(mine > strength[cand]) & (mine > after)]
        again = np.bincount(pair_at[chosen], minlength=len(pairs)) > 1
        chosen = chosen[again[pair_at[chosen]]]
        rule, names = pd.factorize(pair_at[chosen])
        _, example = np.unique(rule, return_index=True)
        example = chosen[example]
        rules.append(Nodes(at[example], at[example + 1], ends[example + 1]))
        used_rule.append(next_symbol - first_symbol + rule)
        used_at.append(at[chosen])
        seq[chosen] = next_symbol + rule
        ends[chosen] = ends[chosen + 1]
        stays = np.ones(len(seq), bool)
        stays[chosen + 1] = False
        seq, at, ends = seq[stays], at[stays], ends[stays]
        next_symbol += len(names)
    none = [np.empty(0, np.int64)]
    return Nodes.join(rules), at, np.concatenate(used_rule or none), np.concatenate(used_at or none)


def balanced(at: np.ndarray, bounds: np.ndarray) -> Nodes:
    """The nodes of a balanced tree over each document's pieces, which start at ``at``."""
    ends = np.append(at[1:], bounds[-1])
    doc = np.searchsorted(bounds, at, "right") - 1
    out = []
    while len(at):
        change = np.flatnonzero(np.diff(doc, prepend=-1))
        nth = np.arange(len(at)) - np.repeat(change, np.diff(np.append(change, len(at))))
        left = np.flatnonzero((nth[:-1] % 2 == 0) & (doc[:-1] == doc[1:]))
        if not len(left):
            break
        out.append(Nodes(at[left], at[left + 1], ends[left + 1]))
        ends[left] = ends[left + 1]
        stays = np.ones(len(at), bool)
        stays[left + 1] = False
        at, ends, doc = at[stays], ends[stays], doc[stays]
    return Nodes.join(out)


class Stretches:
    """Equality of stretches of a sequence by hashes of its prefixes."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        mixed = mix(ids.astype(np.uint64) + np.uint64(1))
        self.sums, self.powers = [], []
        for prime, base in _PRIMES:
            power = np.ones(len(ids) + 1, np.int64)
            done = 1
            while done < len(power):
                step = int(power[done - 1]) * base % prime
                more = min(done, len(power) - done)
                power[done: done + more] = power[:more] * step % prime
                done += more
            terms = (mixed % np.uint64(prime)).astype(np.int64) * power[:-1] % prime
            self.sums.append(np.concatenate([[0], np.cumsum(terms)]))
            self.powers.append(power)

    def equal(self, i: np.ndarray, shift: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from i on equal those from i + shift on."""
        out = np.ones(len(i), bool)
        for (prime, _), sums, power in zip(_PRIMES, self.sums, self.powers, strict=True):
            j = i + shift
            out &= (sums[i + n] - sums[i]) % prime * power[shift] % prime == (sums[j + n] - sums[j]) % prime
        return out

    def longest(self, i: np.ndarray, shift: np.ndarray, limit: np.ndarray, backwards: bool) -> np.ndarray:
        """The largest n up to ``limit`` with n equal words from i on (backwards: before i) and ``shift`` further."""
        low, high = np.zeros(len(i), np.int64), limit.copy()
        while (low < high).any():
            n = (low + high + 1) // 2
            ok = self.equal(i - n if backwards else i, shift, n)
            low, high = np.where(ok, n, low), np.where(ok, high, n - 1)
        return low


def _pairs(most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, period) for the periods 1 .. most[node] of all nodes, in blocks."""
    node = np.flatnonzero(most > 0)
    total = np.cumsum(most[node])
    lo = 0
    while lo < len(node):
        base = total[lo] - most[node[lo]]
        hi = max(lo + 1, int(np.searchsorted(total, base + BLOCK)))
        n = most[node[lo:hi]]
        yield np.repeat(node[lo:hi], n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
        lo = hi


def crossing(text: Stretches, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period) of the runs that cross the boundary of a node, as far as the node goes."""
    ids, start, mid, end = text.ids, nodes.start, nodes.mid, nodes.end
    size = end - start
    fits = np.where(size >= LEAST_WORDS, size // LEAST_TIMES, 0)
    found = []
    for node, q in _pairs(np.minimum((end - mid) // 2, fits)):  # two periods after the boundary
        m = mid[node]
        ok = np.flatnonzero(ids[m] == ids[m + q])
        node, q, m = node[ok], q[ok], m[ok]
        ok = np.flatnonzero(ids[m + q - 1] == ids[m + 2 * q - 1])
        found.append((node[ok], q[ok], m[ok]))
    for node, q in _pairs(np.minimum((mid - start) // 2, fits)):  # two periods before it
        m = mid[node]
        ok = np.flatnonzero(ids[m - 1] == ids[m - 1 - q])
        node, q, m = node[ok], q[ok], m[ok]
        ok = np.flatnonzero(ids[m - q] == ids[m - 2 * q])
        found.append((node[ok], q[ok], m[ok] - 2 * q[ok]))
    node, q, i = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*found, strict=True)) or [[], [], []]))
    ok = text.equal(i, q, q)
    node, q, i = node[ok], q[ok], i[ok]
    after = text.longest(i, q, end[node] - i - q, False)
    before = text.longest(i, q, i - start[node], True)
    s, e = i - before, i + q + after
    ok = e - s >= np.maximum(LEAST_WORDS, LEAST_TIMES * q)
    node, s, e, q = node[ok], s[ok], e[ok], q[ok]
    order = np.lexsort([q, e, s, node])  # of the periods of one interval the smallest
    node, s, e, q = node[order], s[order], e[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (np.diff(node) != 0) | (np.diff(s) != 0) | (np.diff(e) != 0)
    return node[new], s[new], e[new], q[new]


def _everywhere(nodes: Nodes, runs: tuple, rule: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the rules' runs at all places of their rules."""
    node, s, e, q = runs
    has = np.zeros(len(nodes.start), bool)
    has[node] = True
    use = has[rule]
    rule, at = rule[use], at[use]
    order = np.argsort(rule, kind="stable")
    rule, at = rule[order], at[order]
    first, last = np.searchsorted(rule, node, "left"), np.searchsorted(rule, node, "right")
    n = last - first
    place = _gather(at, first, n)
    back = np.repeat(nodes.start[node], n)
    return place + np.repeat(s, n) - back, place + np.repeat(e, n) - back, np.repeat(q, n)


def _maximal(s: np.ndarray, e: np.ndarray, q: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of intervals of one period those that no other contains, and of the periods of an interval the smallest; by start."""
    order = np.lexsort([-e, s, q])
    s, e, q = s[order], e[order], q[order]
    reach = np.maximum.accumulate(e + q * (total + 1))
    new = np.ones(len(s), bool)
    new[1:] = (e + q * (total + 1))[1:] > reach[:-1]
    s, e, q = s[new], e[new], q[new]
    order = np.lexsort([q, e, s])
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (np.diff(s) != 0) | (np.diff(e) != 0)
    s, e, q = s[new], e[new], q[new]
    order = np.lexsort([q, s])
    return s[order], e[order], q[order]


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start; document i has the word ids ids[bounds[i]:bounds[i + 1]]."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    symbols = pd.factorize(doc << 40 | ids)[0]
    rules, left, rule, at = re_pair(symbols)
    text = Stretches(symbols)
    s, e, q = _everywhere(rules, crossing(text, rules), rule, at)
    _, s2, e2, q2 = crossing(text, balanced(left, bounds))
    return _maximal(np.concatenate([s, s2]), np.concatenate([e, e2]), np.concatenate([q, q2]), len(ids))


def _find(texts: pa.Array) -> list[pa.Array]:
    runs, kept = [], []
    for lo, hi, part in slices(flat(texts)):
        found, bounds = word_array(part)
        ids = found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        s, e, q = find_runs(ids, bounds)
        first = np.searchsorted(s, bounds)
        base = bounds[np.searchsorted(bounds, s, "right") - 1] if len(s) else s
        entries = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - s), pa.array(q)], fields=list(_RUN))
        runs.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), entries))
        inside = np.zeros(len(ids) + 1, np.int64)
        np.add.at(inside, s + q, 1)
        np.add.at(inside, e, -1)
        stays = np.cumsum(inside[:-1]) == 0
        before = np.concatenate([[0], np.cumsum(stays)])[bounds]
        lists = pa.LargeListArray.from_arrays(pa.array(before), found.filter(pa.array(stays)))
        kept.append(pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()))
    return [pa.concat_arrays(runs) if runs else pa.array([], pa.list_(_RUN)), pa.concat_arrays(kept) if kept else pa.array([], pa.string())]


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the columns runs (start, length, period; by start, then period) and collapsed.

    collapsed are the words that no run repeats (a run keeps its first period),
    joined by one space.
    """
    return add_columns(docs, [text], _find, [("runs", RUNS_TYPE), ("collapsed", "string")])


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the ids get a text whose words repeat a stretch of it, as the query's input asks for.

    The words are a column of their own, so they are split once for each text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, split_words(F.col("text"))))
    g, n = F.floor(F.col("h") / 10).cast("long"), F.size("words")
    rows = rows.withColumn("a", (g % F.greatest(n, F.lit(1))).cast("int")).withColumn("p", (F.floor((n - F.col("a")) / (g % 8 + 3)) + 1).cast("int"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("words"), place(i)))
    return rows.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, with the stretches that the query plants in a tenth of them."""
    found = with_runs(planted(table(spark, sf_dir, "documents"))).drop("text")
    better = lambda best, r: best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", nothing, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
