"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Words are runs of letters and digits (A-Z lower-cased) or runs of other signs.
Features, hashed into 2**BITS places: words, word pairs, and triples of word
shapes (how a word is written, the signs themselves, and whether a word
repeats the one before it), so that unseen words still carry evidence. The
value of a feature is its share of the text's n-grams; the score is the
sigmoid of the sparse dot product of values and weights, over the whole text.

Training reads at most ``sample`` labelled rows (chosen by a hash
of their ids, a documented bound: SAMPLE) in one task and hands back one weight vector
of fixed size; scoring is a narrow pass over all rows.

Defined results: null and empty texts have no features and score by the bias
alone; without labels all weights are 0 and every score is 0.5; a doc_id that
is labelled twice counts with its higher label; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.bytetext import LOWER, Flat, byte_set, flat, grams, mix, slices, span_hashes, words
from codelens.llm.common import add_columns, keep_where, table, text_or_empty

BITS = 18
SAMPLE = 8000
THRESHOLD = 0.3
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.3, 0.05, 1e-5, 1e-5, 16.0

_WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SIGN = byte_set((0x21, 0x7E)) & ~_WORD
_UPPER, _LOWERCASE, _DIGIT = byte_set((0x41, 0x5A)), byte_set((0x61, 0x7A)), byte_set((0x30, 0x39))


def _tokens(texts: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape hash of each token, and the token bounds of each text."""
    low = LOWER[texts.buf]
    ws, we, _ = words(texts, _WORD)
    ps, pe, _ = words(texts, _SIGN)
    starts = np.concatenate([ws, ps])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([we, pe])[order]
    is_word = order < len(ws)
    hashes = span_hashes(low, starts, ends)
    bounds = np.searchsorted(starts, texts.offsets)
    if not len(starts):
        return hashes, hashes, bounds
    up, lo, dg = (np.add.reduceat(m[texts.buf].astype(np.int32), starts) for m in (_UPPER, _LOWERCASE, _DIGIT))
    # reduceat also sums the bytes up to the next token: these are white space or, at a join, none of the three sets
    capital = _UPPER[texts.buf[starts]]
    kind = np.select([dg > 0, (up > 1) & (lo == 0), capital, up > 0], [1, 2, 3, 4], 0).astype(np.uint64)
    shape = np.where(is_word, kind + np.uint64(1), hashes)
    again = np.zeros(len(starts), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    return hashes, mix(shape * np.uint64(2) + again.astype(np.uint64)), bounds


def features(texts: Flat) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every n-gram, texts in order."""
    hashes, shapes, bounds = _tokens(texts)
    found = []
    for salt, (at, g) in enumerate((grams(hashes, bounds, 1), grams(hashes, bounds, 2), grams(shapes, bounds, 3))):
        found.append((np.searchsorted(bounds, at, "right") - 1, (mix(g + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int32)))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (the last one is the bias) from (places, values, label) rows by per-coordinate FTRL-proximal."""
    n_w = (1 << BITS) + 1
    z, n, bias = np.zeros(n_w), np.zeros(n_w), np.array([n_w - 1])

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for places, values, label in rows:
            i, x = np.concatenate([places, bias]), np.concatenate([values, [1.0]])
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(n_w))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        labels = batch.column("label").to_pylist()
        for lo, hi, part in slices(flat(batch.column("text"))):
            which, place = features(part)
            order = np.argsort(which, kind="stable")
            which, place = which[order], place[order]
            cuts = np.searchsorted(which, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                seen, times = np.unique(place[cuts[k]: cuts[k + 1]], return_counts=True)
                rows.append((seen, SCALE * times / max(1, times.sum()), labels[lo + k]))
    yield pa.RecordBatch.from_pydict({"weights": pa.array([ftrl(rows).astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled rows of ``docs``."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("label"))
    # about 1.5 times the sample by a hash of the id, so that the exact cut below sorts few rows
    share = min(1.0, 1.5 * sample / max(1, known.count()))
    some = known.filter(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    known = some.orderBy(F.xxhash64("_key", F.lit(1)), "_key").limit(sample)
    # the limit bounds the broadcast side; one row for each id
    rows = docs.select(F.col(key).alias("_id"), text_or_empty(text).alias("text")).join(F.broadcast(known), F.col("_id") == F.col("_key"))
    # an id may repeat in the documents, so the rows are bounded once more
    first = rows.select("label", "text").orderBy(F.xxhash64("_id"), "_id", "text").limit(sample)
    got = first.coalesce(1).mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def _scorer(weights: np.ndarray):
    def run(column: pa.Array) -> list[pa.Array]:
        texts = flat(column)
        dots = np.zeros(len(texts))
        for lo, hi, part in slices(texts):
            which, place = features(part)
            total = np.bincount(which, weights=weights[place], minlength=hi - lo)
            dots[lo:hi] = SCALE * total / np.maximum(1, np.bincount(which, minlength=hi - lo))
        return [pa.array(1 / (1 + np.exp(-np.clip(dots + weights[-1], -35, 35))))]
    return run


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` and the score of each row, from its whole text."""
    return add_columns(docs, [text], _scorer(weights), [(out, "double")])


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> np.ndarray:
    """Weights from the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return train(docs, labels.filter(~held_out(F.col("doc_id"))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train_on_labels(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that the classifier accepts, with the input's columns."""
    return keep_where(docs, lambda rows, _, body: score(rows, weights, body).filter(F.col("score") >= THRESHOLD), key, text)
