"""Benchmark decontamination as a prefix-filtered containment join over item-sized windows.

Words are runs of letters, digits and non-ASCII characters (A-Z lower-cased).
Each item gives its windows of WINDOW consecutive words (a shorter item is one
window). A window is the set of its shingles (SHINGLE words, fewer in a shorter
item); since it must be contained whole, one shingle is a sufficient prefix.

1. Tasks cut the items into windows, equal windows once, and these into shingles.
2. Tasks count in how many documents each shingle occurs, added up by a
   shuffle. A window keeps its rarest shingle as its prefix; one that has a
   shingle of no document is retired.
3. Tasks find the prefixes in the documents and send each with the words around
   it, as far as a window can reach. A shuffle join on the shingle brings them to the windows,
   which must fit between the document's ends (length and position bounds) and
   equal the document's words.
4. Spans and items are gathered by text, under its SHA-256, written to the shared
   folder and joined to the documents; Spark broadcasts them while the written
   table is under its threshold and shuffles beyond it.

The number of passes over the documents does not depend on the benchmark, and
no item, window or shingle goes through the driver. What tasks share is a Bloom
filter of MAX_BITS at most: shingles that it lets through wrongly meet no window.
A prefix that more than HOT documents hold is dealt over FAN (FAN squared, ...)
salts, and its windows are copied to each; the filter has a level for each power.
Copies of a text within a batch are searched once.

Defined results: null text has no words; an item without words matches
nothing; items that repeat an id count once; items with a null id hit like any
other and are listed together as one null id, last; equal windows of several
items hit for each of them; repeated documents each get their own row; without
documents or items all tables are empty or all documents clean; n_words, spans
and item_ids replace columns of those names, all other columns are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.bytetext import LOWER, Flat, byte_set, flat, grams, slices, span_hashes, words
from codelens.llm.common import add_columns, cut, keep_where, shuffles_removed, table, text_or_empty
from codelens.session import ensure_checkpoint_dir

WINDOW, SHINGLE = 10, 5
#: Size of a filter: bits for each shingle row, within fixed bounds (8 MB for each level).
BITS_PER_SHINGLE, MIN_BITS, MAX_BITS = 32, 1 << 22, 1 << 26
#: A prefix in more than HOT documents is dealt over FAN salts, in FAN times as many over FAN squared, up to LEVELS.
HOT, FAN, LEVELS = 10_000, 16, 3
#: Rows that a task holds before it sends them on.
HELD_ROWS = 2_000_000
_BITMAP = 32_768  # bits of one of Spark's bitmaps
_INSIDE = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _parsed(part: Flat) -> tuple[Flat, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = Flat(LOWER[part.buf], part.offsets)
    starts, ends, bounds = words(low, _INSIDE)
    return low, starts, ends, bounds, span_hashes(low.buf, starts, ends)


def _shingles_of(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of all shingles of ``width`` words; keys of different widths differ."""
    at, g = grams(h, bounds, width)
    return at, g + np.uint64(width)


def _spelled(low: Flat, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(low.buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


# ---- items

def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(win, item): the windows of (item, text) rows, their words joined by one space."""
    for batch in batches:
        for first, _, part in slices(flat(batch.column(1))):
            low, starts, ends, bounds, _ = _parsed(part)
            found, of = [], []
            for k in range(len(part)):
                lo, hi = int(bounds[k]), int(bounds[k + 1])
                width = min(WINDOW, hi - lo)
                spelled = [low.buf[a:b].tobytes() for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)]
                n = hi - lo - width + 1 if width else 0
                found += [b" ".join(spelled[i: i + width]) for i in range(n)]
                of += [first + k] * n
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), batch.column(0).take(pa.array(of, pa.int64()))], names=["win", "item"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(win, width, size, shingle, off): each shingle of each window."""
    for batch in batches:
        _, _, _, bounds, h = _parsed(flat(batch.column(0)))
        width = np.diff(bounds)
        parts = []
        for size in range(1, SHINGLE + 1):
            at, key = _shingles_of(h, bounds, size)
            win = np.searchsorted(bounds, at, "right") - 1
            mine = np.minimum(SHINGLE, width[win]) == size
            parts.append((win[mine], np.full(int(mine.sum()), size), key[mine], at[mine] - bounds[win[mine]]))
        win, size, key, off = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(win)), pa.array(width[win].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(off.astype(np.int32))],
            names=["win", "width", "size", "shingle", "off"])


# ---- what tasks share

@dataclass
class Known:
    """A Bloom filter of shingles with levels, two places for each shingle, and the shingles' sizes."""

    maps: list[np.ndarray]
    sizes: list[int]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each shingle; -1: not in the filter."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for bits in self.maps:
            mask = np.uint64(len(bits) * 8 - 1)
            inside = np.ones(len(left), bool)
            for place in (keys[left] & mask, (keys[left] >> np.uint64(32)) & mask):
                inside &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[inside]
            out[left] += 1
        return out

    def shingles(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, places, keys, levels) of the shingles that the filter lets through."""
        for size in self.sizes:
            at, key = _shingles_of(h, bounds, size)
            level = self.levels(key)
            hit = np.flatnonzero(level >= 0)
            yield size, at[hit], key[hit], level[hit]


def known(shingles: DataFrame, level: Column, bits: int) -> Known:
    """The filter of the table's shingles (size, shingle); bitmaps are made and joined by tasks."""
    places = F.transform(F.array(F.col("shingle"), F.shiftrightunsigned("shingle", 32)), lambda x: x.bitwiseAND(F.lit(bits - 1)) + 1)
    spots = shingles.select("size", F.explode(F.sequence(F.lit(0), level)).alias("level"), places.alias("at")) \
        .select("size", "level", F.explode("at").alias("at"))
    rows = spots.groupBy("level", F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"), F.collect_set("size").alias("sizes")).collect()
    # at most LEVELS + 1 filters of ``bits`` in all
    maps = [np.zeros(bits // 8, np.uint8) for _ in range(1 + max((r["level"] for r in rows), default=0))]
    for r in rows:
        at = (r["bucket"] - 1) * (_BITMAP // 8)
        maps[r["level"]][at: at + _BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return Known(maps, sorted({k for r in rows for k in r["sizes"]}))


# ---- documents

def _frequencies(wanted: Known):
    """(shingle, n): in how many documents each shingle occurs, added up over HELD_ROWS at a time."""
    def added(found: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for _, _, part in slices(flat(batch.column(0))):
                _, _, _, bounds, h = _parsed(part)
                for _, at, key, _ in wanted.shingles(h, bounds):
                    doc = np.searchsorted(bounds, at, "right") - 1
                    order = np.lexsort([key, doc])
                    doc, key = doc[order], key[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                    found.append(key[new])
                    held += len(found[-1])
                if held > HELD_ROWS:
                    yield added(found)
                    found, held = [], 0
        if held:
            yield added(found)
    return run


_CANDIDATE = "key binary, shingle long, salt int, at long, before int, around string"


def _candidates(prefixes: Known):
    """Each place of a prefix: the text's key, the word it starts at, and the words that a window over it may have."""
    names = [f.split()[0] for f in _CANDIDATE.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            first = {key: i for i, key in reversed(list(enumerate(batch.column(0).to_pylist())))}  # of copies one
            own = sorted(first.values())
            keys = batch.column(0).take(pa.array(own, pa.int64())).to_pylist()
            for lo, _, part in slices(flat(batch.column(1).take(pa.array(own, pa.int64())))):
                low, starts, ends, bounds, h = _parsed(part)
                for size, at, shingle, level in prefixes.shingles(h, bounds):
                    doc = np.searchsorted(bounds, at, "right") - 1
                    begin = np.maximum(bounds[doc], at - (WINDOW - size if size == SHINGLE else 0))
                    end = np.minimum(bounds[doc + 1], at + (WINDOW if size == SHINGLE else size))
                    spots = zip(doc.tolist(), at.tolist(), shingle.view(np.int64).tolist(), level.tolist(), begin.tolist(), end.tolist(), strict=True)
                    for d, i, s, n, a, b in spots:
                        key, place = keys[lo + d], i - int(bounds[d])
                        salt = (int.from_bytes(key[:8], "little") + place) % FAN**n
                        rows.append((key, s, salt, place, i - a, _spelled(low, starts[a:b], ends[a:b])))
                        if len(rows) == 20_000:
                            yield made(rows)
                            rows = []
        if rows:
            yield made(rows)
    return run


def _salted(prefixes: Known):
    """The windows with the level of their prefix in the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = prefixes.levels(batch.column(2).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(level.astype(np.int32))], names=["win", "width", "shingle", "off", "level"])
    return run


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs in place of the spans of each text."""
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in union([(s["start"], s["end"]) for s in row])] for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, batch.schema.field(1).type)], names=["key", "spans"])


def _n_words(column: pa.Array) -> list[pa.Array]:
    found = [np.diff(_parsed_words(part)) for _, _, part in slices(flat(column))]
    return [pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64())]


def _parsed_words(part: Flat) -> np.ndarray:
    return words(Flat(LOWER[part.buf], part.offsets), _INSIDE)[2]


# ---- the join

_SPANS = "array<struct<start:long,end:long>>"


def text_key(text: str) -> Column:
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


def hit_texts(docs: DataFrame, items: DataFrame, text: str, item: str, item_text: str) -> DataFrame:
    """(key, spans, item_ids) of the different texts that hold a window, as a table in the shared folder."""
    spark = docs.sparkSession
    asked = items.select(F.col(item).cast("string").alias("item"), text_or_empty(item_text).alias("text")).distinct()
    pairs = cut(asked.mapInArrow(_windows, "win string, item string").distinct())
    shingles = cut(pairs.select("win").distinct().mapInArrow(_shingles, "win string, width int, size int, shingle long, off int"))
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_SHINGLE * shingles.count()).bit_length()))

    texts = docs.select(text_or_empty(text).alias("text"))
    counted = texts.mapInArrow(_frequencies(known(shingles, F.lit(0), bits)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "off", "width", "size")).alias("r")
    windows = cut(shingles.join(counted, "shingle", "left").groupBy("win").agg(rarest).select("win", "r.*").filter("n > 0"))

    level = sum(((F.col("n") > HOT * FAN**j).cast("int") for j in range(LEVELS)), F.lit(0))
    prefixes = known(windows, level, bits)
    dealt = windows.select("win", "width", "shingle", "off").mapInArrow(_salted(prefixes), "win string, width int, shingle long, off int, level int")
    salts = F.sequence(F.lit(0), (F.pow(F.lit(FAN), F.col("level")) - 1).cast("int"))
    dealt = dealt.withColumn("salt", F.explode(salts)).drop("level")
    places = docs.select(text_key(text).alias("key"), text_or_empty(text).alias("text")).mapInArrow(_candidates(prefixes), _CANDIDATE)
    begin = F.col("before") - F.col("off")
    around = F.split("around", " ")
    fits = (begin >= 0) & (begin + F.col("width") <= F.size(around))
    same = F.array_join(F.slice(around, F.greatest(begin, F.lit(0)) + 1, F.col("width")), " ") == F.col("win")
    start = F.col("at") - F.col("off")
    held = places.join(dealt, ["shingle", "salt"]).filter(fits & same).select("key", "win", start.alias("start"), (start + F.col("width")).alias("end"))
    held = cut(held)

    spans = held.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(_merged, f"key binary, spans {_SPANS}")
    ids = held.select("key", "win").distinct().join(pairs, "win").select("key", "item").distinct() \
        .groupBy("key").agg(F.collect_list(F.struct("item")).alias("items"))
    found = spans.join(ids, "key").select("key", "spans", F.array_sort(F.transform("items", lambda x: x["item"])).alias("item_ids"))
    path = f"{ensure_checkpoint_dir(spark)}/contaminated-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, the spans of words that item windows cover, and the ids of their items."""
    fields = ["n_words", "spans", "item_ids"]
    found = hit_texts(docs, items, text, item, item_text)
    names = [f"k{i}" for i in range(len(docs.columns))]
    own = {c: n for c, n in zip(docs.columns, names, strict=True) if c not in fields}
    rows = docs.toDF(*names).withColumn("key", text_key(names[docs.columns.index(text)]))
    rows = add_columns(rows, [names[docs.columns.index(text)]], _n_words, [("n_words", "long")])
    spans, ids = F.coalesce("spans", F.array().cast(_SPANS)), F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(found, "key", "left").select(*own.values(), "n_words", spans, ids).toDF(*own, *fields)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that hold no item window, with the input's columns."""
    def clean(rows: DataFrame, _: str, body: str) -> DataFrame:
        hit = hit_texts(rows, items, body, "item_id", "text").select("key")
        return rows.withColumn("key", text_key(body)).join(hit, "key", "left_anti")

    return keep_where(docs, clean, key, text)


OP7_SQL = r"""
WITH item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), places AS (
    SELECT d.doc_id, d.i, k.width, array_to_string(d.w[d.i : d.i + k.width - 1], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words) d
    JOIN (SELECT DISTINCT width FROM windows) k ON d.i + k.width - 1 <= len(d.w)
), hits AS (
    SELECT p.doc_id, p.i, p.width, x.item FROM places p JOIN windows x ON p.win = x.win AND p.width = x.width
), covered AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS j FROM hits) GROUP BY doc_id
), held AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(h.n_items, 0) AS n_items,
       sha256(coalesce(h.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN held h USING (doc_id)
"""
