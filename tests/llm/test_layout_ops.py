"""Packing, sharding and the corpus pipeline against brute force."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codelens.llm import packing as P, quality as Q, sharding as H
from codelens.llm.bytetext import flat
from codelens.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, rows
from tests.llm.test_dedup import classes, fingerprint
from tests.llm.test_text_ops import contamination_brute


# ---- packing

def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return sorted(capacity - r for r in room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(0)
    for _ in range(300):
        capacity = rng.randint(3, 60)
        lengths = rng.choices(range(1, capacity + 1), k=rng.randint(0, 150))
        where = P._place(P.plan(Counter(lengths), capacity))
        ranks, seen = [], Counter()
        for n in lengths:
            ranks.append(seen[n])
            seen[n] += 1
        bins, offsets = (x.to_pylist() for x in where(pa.array(lengths, pa.int64()), pa.array(ranks, pa.int64())))
        fill = {}
        for b, o, n in sorted(zip(bins, offsets, lengths, strict=True)):
            assert fill.get(b, 0) == o
            fill[b] = o + n
        assert sorted(fill.values()) == best_fit_decreasing(lengths, capacity)


def test_tightest_bin():
    rng = random.Random(1)
    bins, have = P.OpenBins(40), Counter()
    for _ in range(2000):
        need = rng.randint(1, 40)
        assert bins.tightest(need) == min((c for c in have if have[c] and c >= need), default=None)
        c = rng.randint(1, 40)
        if have[c] and rng.random() < 0.5:
            bins.pop(c)
            have[c] -= 1
        else:
            bins.push(c, 0, 1)
            have[c] += 1


def test_encoder_agrees_with_the_tokenizer():
    rng = random.Random(3)
    texts = ["", "a  b   c", "x \nY\n\n z\t q\n", "a<|endoftext|> b  <|endoftext|>c", " lead", "trail ", "\xa0x  y　z é à", " \x85a", "don't we'll  'tis\n'x"]
    texts += ["".join(rng.choices([" ", "\n", "a", "é", "\xa0", "　", ".", "1", "'s", "\t", "\r", "<|endoftext|>", "日", "B"], k=rng.randint(0, 40))) for _ in range(600)]
    encoder = P.Encoder(P.default_tokenizer())
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # from the empty memory, then from the full one
        ids, n = encoder.encode(flat(pa.array(texts)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_packing(spark):
    rng = random.Random(4)
    texts = [None, "", "x", "long " * 5000, "long " * 2047, "long " * 2048] + [" ".join(rng.choices(["alpha", "beta", "é"], k=rng.randint(0, 900))) for _ in range(80)] + ["same"] * 30
    df = docs(spark, texts, extra=True)
    df = df.union(df.filter("doc_id = 2"))
    pieces = P.tokenize(df)
    packed = P.pack(pieces, ["doc_id", "piece"]).cache()
    tokenizer = P.Encoder(P.default_tokenizer()).tokenizer
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    got = packed.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    for i, want in ids.items():
        own = sorted({r["piece"]: r for r in got if r["doc_id"] == i}.values(), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == want
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert all(r["length"] == 2048 for r in own[1:]) and all(1 <= r["length"] <= 2048 for r in own)
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(fill.values()) == best_fit_decreasing([r["length"] for r in got], 2048)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in P.sequences(packed).collect()}
    for r in got:
        assert (whole[r["sequence_id"]][r["offset"]: r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4")).all()
    query = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in P.pack_documents(df).collect()}
    assert query == {(r["doc_id"], r["piece"]): zlib.crc32(r["ids"]) for r in got}


def test_packing_refuses_lengths_over_the_capacity(spark):
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 2049)], "id long, length long"), ["id"])


# ---- sharding

def test_sharding_query(spark):
    got = {r["doc_id"]: r for r in H.op9_sharding(spark, SF_SMALL).collect()}
    texts = dict(map(tuple, table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()))
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i]["size"] == len((t or "").encode()) + 1 and got[i]["text_crc32"] == zlib.crc32((t or "").encode()) and got[i]["law"] == "key"
        assert got[i]["grown_shard"] in (got[i]["shard"], 16) and 0 <= got[i]["shard"] < 16
    for s in range(16):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))
    assert any(r["grown_shard"] == 16 for r in got.values())


def test_weighted_rendezvous(spark):
    df = spark.range(20_000).withColumn("shard", F.lit("mine"))
    weights = [1.0, 3.0, 0.0, 2.0]
    at = lambda w: {r[0]: r[2] for r in H.rendezvous_shard(df, "id", w, "to").collect()}
    first, more, less = at(weights), at([*weights, 2.0]), at([1.0, 0.0, 0.0, 2.0])
    share = Counter(first.values())
    assert share[2] == 0 and all(abs(share[s] / 20_000 - w / 6) < 0.02 for s, w in enumerate(weights))
    assert all(more[i] in (first[i], 4) for i in first)
    assert all(less[i] == first[i] for i in first if first[i] != 1)
    with pytest.raises(ValueError):
        H.scores(F.col("id"), [0.0, 0.0])


def test_sharding_cases(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS_PER_BUCKET", 7)
    df = docs(spark, ["t"] * 60 + [None, ""], [5] * 30 + list(range(30)) + [None, None], extra=True)
    sharded = H.rendezvous_shard(df.drop("shard", "slot"), "doc_id", [1.0] * 4)
    got = H.with_slots(sharded, "shard", ["doc_id", "text"], 62)
    found = got.collect()
    assert len(found) == 62 and len({r["shard"] for r in found if r["doc_id"] == 5}) == 1
    for s in range(4):
        slots = sorted(r["slot"] for r in found if r["shard"] == s)
        assert slots == list(range(len(slots)))


# ---- pipeline

def test_pipeline_stages(spark):
    docs_in = table(spark, SF_SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    stage = [f for _, f in corpus_pipeline.STAGES]

    good = stage[0](spark, docs_in, SF_SMALL).cache()
    scores = Q.score(docs_in, Q.train_on_labels(spark, docs_in, SF_SMALL))
    assert rows(good) == rows(scores.filter(F.col("score") >= 0.3).drop("score"))

    single = stage[1](spark, good, SF_SMALL).cache()
    last = {}
    for r in good.collect():
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    assert rows(single) == rows(good.filter(F.col("doc_id").isin(list(last.values()))))

    apart = stage[2](spark, single, SF_SMALL).cache()
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    want = classes(list(texts), [fingerprint(t) for t in texts.values()])
    assert rows(apart) == rows(single.filter(F.col("doc_id").isin(list(set(want.values())))))

    clean = stage[3](spark, apart, SF_SMALL).cache()
    items = list(map(tuple, table(spark, SF_SMALL, "benchmark").select("item_id", "text").collect()))
    left = apart.select("doc_id", "text").collect()
    held = contamination_brute([r["text"] for r in left], items)
    assert rows(clean) == rows(apart.filter(F.col("doc_id").isin([r["doc_id"] for i, r in enumerate(left) if not held[i][1]])))

    assert all(d.columns == docs_in.columns and d.dtypes == docs_in.dtypes for d in (good, single, apart, clean))
    whole = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in whole} == {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert Counter(r["doc_id"] for r in whole) == Counter(r["doc_id"] for r in stage[4](spark, clean, SF_SMALL).collect())


def test_pipeline_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, and columns beyond those of documents."""
    for t in ("labels", "benchmark"):
        table(spark, SF_SMALL, t).write.parquet(os.path.join(tmp_path, f"{t}.parquet"))
    good = [r["text"] for r in table(spark, SF_SMALL, "documents").join(table(spark, SF_SMALL, "labels").filter("quality = 1"), "doc_id").limit(20).collect()]
    texts = [None, "", None, *good, *good, " ".join(good) * 3]
    df = docs(spark, texts, extra=True)
    df = df.union(df.filter("doc_id % 5 = 0"))
    out = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == df.columns
        assert len(out.subtract(df).collect()) == 0
    kept = [r["doc_id"] for r in out.collect()]
    assert len(kept) == len(set(kept)) > 0
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[4][1](spark, out, str(tmp_path)).collect()} == set(kept)
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.collect() == []




def test_slots_keep_all_columns(spark):
    names = ["id", "_bucket", "_row", "_n", "_b", "_shard", "_first", "bucket", "row", "of", "b", "k0", "first", "shard"]
    df = spark.range(50).select(*[F.col("id").alias(n) for n in names[:-1]], F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("shard"))
    got = H.with_slots(df, "shard", ["id"], 50)
    assert got.columns == [*names, "slot"]
    by = {}
    for r in got.collect():
        assert all(r[n] == r["id"] for n in names[:-1])
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == {None, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_slots_of_one_key_spread(spark):
    """Rows that are equal in their order are no single group: 300,000 of one id give several."""
    df = spark.range(300_000).select(F.lit(7).cast("long").alias("id"), F.lit(1).alias("shard"))
    got = H.with_slots(df, "shard", ["id"], 300_000)
    assert got.agg(F.min("slot"), F.max("slot"), F.count_distinct("slot")).first()[:] == (0, 299_999, 300_000)
    sizes = [r["count"] for r in H.dealt(df, ["id"], 300_000).groupBy("bucket").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 100_000


def test_shards_by_digest(spark):
    """Every score recomputed from its MD5: the largest one has the shard, weighted or not."""
    import hashlib
    import math

    def score(key, shard, weight):
        u = (int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -weight / math.log(u) if weight else -1.0

    keys = [*range(400), None]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for weights in ([1.0] * 17, [1.0] * 16, [3.0, 0.0, 1.0, 0.5]):
        for r in H.rendezvous_shard(df, "doc_id", weights).collect():
            found = [score("" if r.doc_id is None else r.doc_id, s, w) for s, w in enumerate(weights)]
            assert r.shard == found.index(max(found))
