"""Exact dedup, SimHash near-dedup and removal of repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from codelens.llm import exact_dedup as X, simhash as S, suffix_dedup as R
from tests.llm.helpers import docs, rows

LONG = "".join(random.Random(5).choices(["word ", "another, ", "é ", "日本\n", "x"], k=60_000))
TEXTS = ["a b c", "A b c", "a b c", None, "", " ", "a b c", LONG, LONG + "!", LONG, "same", "same", None]


# ---- exact

def exact_brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    return sorted([(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs], key=repr)


def test_exact(spark):
    df = docs(spark, TEXTS, extra=True)
    assert rows(X.verdicts(df)) == exact_brute(list(enumerate(TEXTS)))
    kept = X.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(i for i, _, _, k, _ in exact_brute(list(enumerate(TEXTS))) if k)
    assert rows(kept) == rows(df.join(kept.select("doc_id"), "doc_id", "left_semi").select(*df.columns))


def test_exact_repeated_rows(spark):
    df = docs(spark, ["t", "t", "u", "t"], ids=[7, 7, 7, 3])
    assert sorted(r[:4] for r in rows(X.verdicts(df))) == [(3, 7, 3, False), (7, 7, 1, True), (7, 7, 3, True), (7, 7, 3, True)]
    assert sorted(r[:2] for r in rows(X.dedup(df))) == [(7, "t"), (7, "u")]


def test_chunks_join_to_the_text(spark):
    texts = [LONG, "no boundary" * 2000, "x" * 9000, "short", "", "\n\n a. b\n" * 999]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for (got, parts), t in zip(df.select("text", X.chunks(F.col("text"))).collect(), texts, strict=True):
        assert "".join(parts) == t == got
        assert all(len(p) <= X.MAX_CHUNK for p in parts)


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(X, "chunk_hash", lambda c: F.length(c).cast("long"))
    texts = ["aaa", "bbb", "aaa", "ccc", "bbb", None, "", LONG[:9000], LONG[:8999] + "~", LONG[:9000]]
    assert rows(X.verdicts(docs(spark, texts))) == exact_brute(list(enumerate(texts)))


# ---- SimHash

def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    grams = [" ".join(w[i: i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, bits=4):
    f, up = np.array(fps, np.uint64), list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= bits):
            a, b = root(i), root(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    low = {}
    for i, x in enumerate(ids):
        low[root(i)] = min(low.get(root(i), x), x)
    return {x: low[root(i)] for i, x in enumerate(ids)}


def test_simhash(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(90)) for _ in range(6)]
    texts = list(TEXTS)
    for b in base:
        for _ in range(8):
            w = b.split()
            w[rng.randrange(90)] = "ZÉ"
            texts.append("  ".join(w) if rng.random() < 0.3 else " ".join(w))
    texts += ["One two", "one  TWO", "one"]
    df = docs(spark, texts, extra=True)
    got = {r[0]: (r[1] % 2**64, r[2]) for r in S.near_duplicates(df).collect()}
    fps = [fingerprint(t) for t in texts]
    want = classes(list(range(len(texts))), fps)
    assert got == {i: (fps[i], want[i]) for i in range(len(texts))}
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_keep_first_takes_one_row_of_each_component_whatever_its_key(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    a, b, *others = (text() for _ in range(10))
    rows_in = [(5, a), (5, b), (2, b), (5, others[0]), (5, others[0])] + [(None, t) for t in others[1:]] + [(None, a), (None, others[1])]
    df = docs(spark, [t for _, t in rows_in], [i for i, _ in rows_in], extra=True)
    got = S.keep_first(df)
    assert got.columns == df.columns
    assert rows(got.select("doc_id", "text")) == sorted([(5, a), (2, b), (5, others[0])] + [(None, t) for t in others[1:]], key=repr)


def test_golay_words_within_two_bits_share_an_index():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 23, 3000)
    b = a ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    (na, va), (nb, vb) = S.indices(a), S.indices(b)
    assert set(np.unique(na)) <= {1, 6}
    for i, (x, y) in enumerate(zip(np.split(va, np.cumsum(na)[:-1]), np.split(vb, np.cumsum(nb)[:-1]), strict=True)):
        assert set(x) & set(y), i


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)
    found = []
    for x in (a, b):
        place, key = S.keys(x)
        order = np.argsort(place, kind="stable")
        found.append(np.split(key[order], np.cumsum(np.bincount(place))[:-1]))
    assert all(set(x) & set(y) for x, y in zip(*found, strict=True))


@pytest.mark.parametrize("run_limit", [10, 100_000])
def test_links_of_a_dense_cluster_and_common_keys(spark, run_limit):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 64, dtype=np.uint64)
    f = [centre]
    for _ in range(250):  # a chain of small steps around the centre, and noise
        x = f[rng.integers(0, len(f))]
        for _ in range(rng.integers(1, 4)):
            x = x ^ np.uint64(1) << np.uint64(rng.integers(0, 64))
        f.append(x)
    f = np.unique(np.array(f + list(rng.integers(0, 1 << 64, 300, dtype=np.uint64)), np.uint64))
    df = spark.createDataFrame(pd.DataFrame({"fp": f.view(np.int64)}))
    roots = {a % 2**64: b for a, b in S.components(S.links(df, run_limit=run_limit)).collect()}
    want = classes([int(x) for x in f], f)
    got = {}
    for x in want:
        got.setdefault(roots.get(x, x), set()).add(want[x])
    assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(500, 501), (7, 7)]
    random.Random(0).shuffle(edges)
    got = dict(map(tuple, S.components(spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 500: 500, 501: 500}


# ---- repeated strings

def repeats_brute(pairs, width=50):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in pairs]
    for i, b in raw:
        for s in range(len(b) - width + 1):
            w = b[s: s + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if first[b[s: s + width]] < i:
                gone[s: s + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, kept))
    return sorted(out, key=repr)


def repeat_texts():
    rng = random.Random(3)
    line = "The quick brown fox jumps over the lazy dog, and then it does so again.\n"
    noise = lambda n: "".join(rng.choice("abcé日 \n") for _ in range(n))
    texts = [None, "", "x" * 49, "x" * 50, "x" * 400, "x" * 391, noise(300), line * 3]
    texts += [noise(rng.randint(0, 120)) + line + noise(rng.randint(0, 120)) for _ in range(30)]
    texts += [line[:51], line[:50], line[:49], line[5:65] + noise(20) + line[5:65]]
    texts += [texts[6], texts[6][:200] + "!" + texts[6][200:], "ab" * 300, "ba" * 200, "é" * 60]
    return texts


@pytest.mark.parametrize("array_bytes", [200, 2_000_000])
def test_repeats(spark, array_bytes):
    pairs = list(enumerate(repeat_texts()))
    random.Random(4).shuffle(pairs)
    df = docs(spark, [t for _, t in pairs], [i for i, _ in pairs], extra=True)
    assert rows(R.remove_repeats(df, array_bytes=array_bytes)) == repeats_brute(pairs)


def test_repeats_in_many_batches(spark):
    """Copies that meet only in their bucket, not in one batch."""
    pairs = [(i % 40, t) for i, t in enumerate(repeat_texts() * 3)]
    pairs = list({i: (i, t) for i, t in pairs}.values())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = docs(spark, [t for _, t in pairs], [i for i, _ in pairs]).repartition(7)
        assert rows(R.remove_repeats(df)) == repeats_brute(pairs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_repeats_null_and_shared_ids(spark):
    text = "".join(random.Random(6).choices("abcdefgh ", k=300))
    other = text[::-1]
    df = docs(spark, [text, text, other, text, other], [None, 4, 4, 4, 2])
    got = sorted((r[0] is None, r[0], r[2]) for r in R.remove_repeats(df).collect())
    assert got == [(False, 2, 0), (False, 4, 300), (False, 4, 300), (False, 4, 300), (True, None, 0)]


def test_long_previous():
    rng = np.random.default_rng(0)
    for _ in range(50):
        size = rng.integers(1, 30, 8)
        buf = rng.integers(97, 99, size.sum()).astype(np.uint8)
        doc = np.sort(rng.integers(0, 4, 8))
        got = R.long_previous(buf, np.cumsum(size), doc, width=9)
        begin = np.cumsum(size) - size
        for k in range(8):
            for p in range(begin[k], begin[k] + size[k]):
                w = bytes(buf[p: p + 9])
                want = p + 9 <= begin[k] + size[k] and any(
                    doc[j] < doc[k] and w in bytes(buf[begin[j]: begin[j] + size[j]]) for j in range(8))
                assert got[p] == want


def test_segments_of_a_long_text_cover_its_windows(monkeypatch):
    monkeypatch.setattr(R, "LONG_TEXT", 300)
    raw = "".join(random.Random(8).choices("abc é", k=1500))
    flat = R.flat(pa.array([raw]))
    _, _, start, n = R.segments(flat)
    assert np.concatenate([np.arange(a, a + k) for a, k in zip(start, n, strict=True)]).tolist() == list(range(len(flat.buf) - R.WIDTH + 1))


def test_packed_rows():
    cols = [np.array([1, 2**40, -5], "<i8"), np.array([7, 8, 9], "u1"), np.array([1, 2, 3], "<u2")]
    assert all((a == b).all() for a, b in zip(R.unpack(R.pack(cols), ["<i8", "u1", "<u2"]), cols, strict=True))
