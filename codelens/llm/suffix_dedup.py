"""Removal of byte strings that an earlier document holds already, by longest-previous-factor arrays.

A byte goes if some string of WIDTH bytes over it also starts in a document
with a smaller id; matches never cross documents, and every string is judged
on the input. The first copy stays.

One suffix array over a large corpus fits nowhere, so its suffixes are dealt
to many small ones. Strings that are equal have the same smallest GRAM-byte
substring (by hash). Consecutive window starts of a document with the same
smallest substring form one segment, the bytes that those windows cover; all
equal windows of the corpus lie in segments of the same substring, and segments
are dealt by it. Three passes follow:

1. Segments that are equal as a whole stand next to each other in suffix order;
   all but those of the first document are removed at once, only first copies
   go on. This moves a few bytes for each segment, not its text.
2. First copies whose substring several documents have, but in different
   segments (mostly the ends of repeated passages), are cut out of their texts
   and meet in suffix arrays: prefix doubling orders all suffixes by WIDTH
   bytes. Suffixes that agree in WIDTH bytes are a run, kept in order of their
   documents: the previous smaller position of each is the head of its run, so
   the longest previous factor reaches WIDTH exactly where the head belongs to
   a smaller document. These windows are removed.
3. The removed spans of each document are merged and cut out of its bytes.

Segments that repeat within one input batch are reduced to their first copy
before anything is shuffled, so a passage that a third of all documents hold
reaches its task once for each batch.

Defined results: null text is empty; a null id counts as smaller than all;
rows with one id are one document for the question which is smaller, and each
gets the spans that its own bytes confirm; texts under WIDTH bytes lose
nothing; all other columns are left out of the result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.bytetext import Flat, flat, mix, rolling_hashes, slices, span_hashes
from codelens.llm.common import parts_for, shuffles_removed, table, text_or_empty
from codelens.session import ensure_checkpoint_dir

WIDTH, GRAM = 50, 16
#: Windows that one segment has at most (longer ones are periodic text, and are cut).
LONGEST = 128
#: Text that one bucket of segments, and one partition of texts, stands for.
BUCKET_BYTES = 16_000_000
#: Text whose segments are grouped together before they are dealt.
PART_BYTES = 8_000_000
#: Bytes of segments that one suffix array orders (a substring's segments stay together).
ARRAY_BYTES = 2_000_000
#: A text beyond this many bytes is taken in blocks of windows.
LONG_TEXT = 4_000_000
_NO_ID = -(2**63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done:]) if done < width else x


def segments(texts: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, smallest gram hash, first window start, windows) of all segments, in order; a very long text block by block."""
    if len(texts) > 1 or len(texts.buf) <= LONG_TEXT:
        return _segments(texts)
    parts = []
    for lo in range(0, len(texts.buf) - WIDTH + 1, LONG_TEXT):
        part = texts.buf[lo: lo + LONG_TEXT + WIDTH - 1]  # the windows that start in the block
        text, low, start, n = _segments(Flat(part, np.array([0, len(part)])))
        parts.append((text, low, start + lo, n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(texts: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64)
    if len(texts.buf) < WIDTH:
        return none, none.astype(np.uint64), none, none
    low = _sliding_min(rolling_hashes(texts.buf, GRAM), WIDTH - GRAM + 1)  # for the window at each place
    begin, end = texts.offsets[:-1], np.maximum(texts.offsets[:-1], texts.offsets[1:] - WIDTH + 1)  # windows of each text
    new = np.ones(len(low) + 1, bool)
    new[1:-1] = low[1:] != low[:-1]
    new[begin[begin <= len(low)]] = True
    new[end[end <= len(low)]] = True
    edges = np.flatnonzero(new)
    first, size = edges[:-1], np.diff(edges)
    text = np.searchsorted(texts.offsets, first, "right") - 1
    inside = first < end[text]  # else the window would leave its text
    first, size, text = first[inside], size[inside], text[inside]
    cut = -(-size // LONGEST)
    extra = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
    of = np.repeat(np.arange(len(first)), cut)
    return text[of], low[first[of]], first[of] + extra * LONGEST, np.minimum(size[of] - extra * LONGEST, LONGEST)


# ---- packed rows: numpy columns as one binary, byte planes apart so that equal high bytes compress

def pack(columns: list[np.ndarray]) -> bytes:
    return struct.pack("<q", len(columns[0])) + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<q", blob)[0], 8, []
    for kind in map(np.dtype, kinds):
        raw = np.frombuffer(blob, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(raw.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


_SEGMENT = ["<u4", "<u4", "<u2", "<i8", "<u4", "u1"]  # gram, hash of the segment (48 bits), document, start, windows - 1


def _dealt_segments(buckets: int):
    """Packed segments for each bucket; those that repeat an earlier document's within the batch are settled here."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
        """The segments of about PART_BYTES of text at a time."""
        found, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, part in slices(flat(batch.column(1))):
                text, low, start, n = segments(part)
                if len(text):
                    found.append([low, span_hashes(part.buf, start, start + n + WIDTH - 1), ids[lo + text], start - part.offsets[text], n])
                size += len(part.buf)
                if found and size > PART_BYTES:
                    yield found
                    found, size = [], 0
        if found:
            yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, found in enumerate(parts(batches)):
            low, own, doc, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
            # a segment of a later document than the first one with the same bytes is settled
            key = mix(low ^ own * np.uint64(3))
            order = np.argsort(key)
            head = np.ones(len(key), bool)
            head[1:] = key[order][1:] != key[order][:-1]
            smallest = np.minimum.reduceat(doc[order], np.flatnonzero(head))
            settled = np.empty(len(key), bool)
            settled[order] = doc[order] > smallest[np.cumsum(head) - 1]
            columns = [(low >> np.uint64(32)).astype("<u4"), own.astype("<u4"), (own >> np.uint64(32)).astype("<u2"), doc, start.astype("<u4"), (n - 1).astype("u1")]
            bucket = (low % np.uint64(buckets)).astype(np.int64)
            rows = []
            for done in (False, True):
                mine = np.flatnonzero(settled == done)
                # settled rows need no company: they are spread evenly, in the order of their documents
                key = bucket[mine] if not done else (np.arange(len(mine)) * buckets // max(1, len(mine)) + turn) % buckets
                key = key.astype(np.uint16 if buckets < 1 << 16 else np.int64)
                order = np.argsort(key, kind="stable")
                by, key = mine[order], key[order]
                edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    rows.append((int(key[a]), done, pack([c[by[a:b]] for c in columns])))
            for lo in range(0, len(rows), 64):
                part = rows[lo: lo + 64]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in part], pa.int32()), "settled": pa.array([r[1] for r in part]), "rows": pa.array([r[2] for r in part], pa.binary())})
    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) of consecutive rows that share the first column."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and held:
                yield key, held
                held = []
            key = row[0]
            held.append(row[1:])
    if held:
        yield key, held


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled spans (gram null) and open segments (with their gram) of each bucket."""
    def rows(doc: np.ndarray, start: np.ndarray, n: np.ndarray, check: np.ndarray, gram: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(doc), 100_000):
            z = slice(a, a + 100_000)
            yield pa.RecordBatch.from_pydict({
                "doc": pa.array(doc[z]), "start": pa.array(start[z].astype(np.int64)), "n": pa.array(n[z].astype(np.int32) + WIDTH),
                "check": pa.array(check[z].view(np.int32)),
                "gram": pa.nulls(len(doc[z]), pa.int64()) if gram is None else pa.array(gram[z])})

    for bucket, held in _by_key(batches):
        for blob in (b for done, b in held if done):
            gram, own, _, doc, start, n = unpack(blob, _SEGMENT)
            yield from rows(doc, start, n, own, None)
        parts = [unpack(b, _SEGMENT) for done, b in held if not done]
        if not parts:
            continue
        gram, own, high, doc, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts, held
        group = gram.astype(np.uint64) << np.uint64(16) | high  # the gram, then the segment's hash in two parts
        order = np.lexsort([own, group])
        group, gram, own, doc, start, n = group[order], gram[order], own[order], doc[order], start[order], n[order]
        g_head, s_head = np.ones(len(gram), bool), np.ones(len(gram), bool)
        g_head[1:] = gram[1:] != gram[:-1]
        s_head[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
        settled = doc > np.minimum.reduceat(doc, np.flatnonzero(s_head))[np.cumsum(s_head) - 1]
        yield from rows(doc[settled], start[settled], n[settled], own[settled], None)
        # a first copy stays open if its gram has several segments, and one of them is in a later document than the gram's first
        group, first = np.cumsum(g_head) - 1, np.flatnonzero(g_head)
        smallest = np.minimum.reduceat(doc, first)
        kinds = np.add.reduceat(s_head.astype(np.int64), first)
        latest = np.maximum.reduceat(np.where(settled, _NO_ID, doc), first)
        left = ~settled & ((kinds > 1) & (latest > smallest))[group]
        yield from rows(doc[left], start[left], n[left], own[left], gram[left].astype(np.int64) << 20 | bucket & 0xFFFFF)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_squeeze.compress(x.as_buffer()) for x in batch.column(1).cast(pa.binary())], pa.binary())], names=["doc", "packed"])


_squeeze, _unpacked = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _plain(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(_unpacked.decompress(packed.as_buffer()), np.uint8)


def _confirmed(buf: np.ndarray, start: np.ndarray, n: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which spans lie in the text and have the bytes that were judged (another row with the same id may have others)."""
    ok = start + n <= len(buf)
    ok[ok] = span_hashes(buf, start[ok], (start + n)[ok]).astype("<u4").view(np.int32) == check[ok]
    return ok


def _spans(column: pa.ListArray, *fields: str) -> Iterator[list[np.ndarray] | None]:
    """For each document the fields of its spans in order of their starts; None without spans."""
    offsets = column.offsets.to_numpy()
    values = [column.values.field(f).to_numpy(zero_copy_only=False) for f in fields]
    empty = column.is_null().to_numpy(zero_copy_only=False) | (offsets[1:] == offsets[:-1])
    for a, b, none in zip(offsets[:-1].tolist(), offsets[1:].tolist(), empty.tolist(), strict=True):
        if none:
            yield None
        else:
            order = np.argsort(values[0][a:b], kind="stable") + a
            yield [v[order] for v in values]


_OPEN = ["<i8", "<i8", "<u4", "<u2"]  # gram, document, start, length; then the bytes


def _cut_out(buckets: int):
    """The bytes of the open segments, packed for each bucket of grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list[list[np.ndarray]]) -> pa.RecordBatch:
            gram, doc, start, n = (np.concatenate([f[i] for f in found]) for i in range(4))
            begin = np.cumsum(n) - n
            text = np.concatenate([f[4] for f in found])
            key = (gram >> 20) * 31 % buckets
            order = np.lexsort([gram, key])
            sorted_key = key[order]
            edges = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1], [True]]))
            keys, blobs = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:b]
                size = n[own]
                at = np.repeat(begin[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                keys.append(int(sorted_key[a]))
                blobs.append(pack([gram[own], doc[own], start[own].astype("<u4"), size.astype("<u2")]) + text[at].tobytes())
            return pa.RecordBatch.from_pydict({"bucket": pa.array(keys, pa.int32()), "rows": pa.array(blobs, pa.binary())})

        found, held = [], 0
        for batch in batches:
            spans = _spans(batch.column(2), "start", "n", "check", "gram")
            for doc, packed_text, (start, n, check, gram) in zip(batch.column(0), batch.column(1), spans, strict=True):
                buf = _plain(packed_text)
                n = n.astype(np.int64)
                ok = _confirmed(buf, start, n, check)
                start, n, gram = start[ok], n[ok], gram[ok]
                if len(start):
                    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found.append([gram, np.full(len(start), doc.as_py()), start, n, buf[at]])
                    held += int(n.sum())
                if held > 8_000_000:
                    yield packed(found)
                    found, held = [], 0
        if found:
            yield packed(found)
    return run


def long_previous(buf: np.ndarray, ends: np.ndarray, doc: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether the longest previous factor reaches ``width``, for the suffix at each place of the segments.

    buf: the segments' bytes; ends: where they end; doc: their documents, in
    ascending order. Places nearer to their segment's end than ``width`` have
    no suffix of that length. A hash of ``width`` bytes leaves out the suffixes
    that no other document's can equal; the rest are put in suffix order.
    """
    out = np.zeros(len(buf), bool)
    size = np.diff(np.concatenate([[0], ends]))
    n = np.maximum(0, size - width + 1)
    place = np.arange(n.sum()) + np.repeat(ends - size - np.cumsum(n) + n, n)
    if not len(place):
        return out
    owner = np.repeat(doc, n)
    key = rolling_hashes(buf, width)[place]
    order = np.argsort(key)
    head = np.ones(len(key), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    first, owners = np.flatnonzero(head), owner[order]
    several = np.minimum.reduceat(owners, first) < np.maximum.reduceat(owners, first)
    order = np.sort(order[several[np.cumsum(head) - 1]])
    place, owner = place[order], owner[order]
    if not len(place):
        return out
    # suffix order by ``width`` bytes, eight at a time; equal suffixes in order of their documents
    text = np.zeros((len(place), -(-width // 8) * 8), np.uint8)
    for k in range(width):
        text[:, k] = buf[place + k]
    text = text.view(">u8")
    order = np.lexsort([owner, *text.T[::-1]])
    text, owner = text[order], owner[order]
    head = np.ones(len(order), bool)
    head[1:] = (text[1:] != text[:-1]).any(axis=1)
    previous = owner[np.flatnonzero(head)][np.cumsum(head) - 1]
    out[place[order]] = previous < owner
    return out


def _later_windows(array_bytes: int):
    """Spans of open segments that an earlier document holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_key(batches):
            parts = []
            for (blob,) in held:
                gram, doc, start, n = unpack(blob, _OPEN)
                parts.append((gram, doc, start, n, np.frombuffer(blob, np.uint8, offset=8 + len(gram) * 22)))
            gram, doc, start, n, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts, held
            n = n.astype(np.int64)
            begin = np.cumsum(n) - n
            order = np.lexsort([start, doc, gram])
            gram, doc, start, n, begin = gram[order], doc[order], start[order].astype(np.int64), n[order], begin[order]
            # arrays of about array_bytes, the segments of a gram together
            edges = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            total = np.cumsum(n)[np.append(edges[1:], len(gram)) - 1]
            edges = edges[np.concatenate([[True], total[1:] // array_bytes != total[:-1] // array_bytes])]
            for a, b in zip(edges, np.append(edges[1:], len(gram)), strict=True):
                order = np.argsort(doc[a:b], kind="stable") + a
                size = n[order]
                at = np.repeat(begin[order] - np.cumsum(size) + size, size) + np.arange(size.sum())
                buf, ends = text[at], np.cumsum(size)
                hit = np.flatnonzero(long_previous(buf, ends, doc[order]))
                if not len(hit):
                    continue
                of = np.searchsorted(ends, hit, "right")
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (of[1:] != of[:-1])
                head = np.flatnonzero(new)
                last = hit[np.append(head[1:], len(hit)) - 1]
                lo = hit[head]
                seg = order[of[head]]
                yield pa.RecordBatch.from_pydict({
                    "doc": pa.array(doc[seg]), "start": pa.array(start[seg] + lo - (ends - size)[of[head]]), "n": pa.array((last - lo + WIDTH).astype(np.int32)),
                    "check": pa.array(span_hashes(buf, lo, last + WIDTH).astype("<u4").view(np.int32))})
    return run


def _without(buf: np.ndarray, spans: list[np.ndarray] | None) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, removed runs, what stays) of one text and its spans."""
    if spans is None:
        return len(buf), 0, 0, buf.tobytes()
    start, n, check = spans
    ok = _confirmed(buf, start, n.astype(np.int64), check)
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, start[ok], 1)
    np.add.at(edge, (start + n)[ok], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()
    return len(buf), int(gone.sum()), int(runs), buf[~gone].tobytes()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows, held = [], 0
    for batch in batches:
        for doc, packed, spans in zip(batch.column(0), batch.column(1), _spans(batch.column(2), "start", "n", "check"), strict=True):
            rows.append((doc.as_py(), *_without(_plain(packed), spans)))
            held += rows[-1][1]
            if held > 8_000_000:
                yield made(rows)
                rows, held = [], 0
    if rows:
        yield made(rows)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row; kept: the bytes that stay, in order."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("doc"), text_or_empty(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = parts_for(size, BUCKET_BYTES, spark.sparkContext.defaultParallelism)
    dealt = rows.mapInArrow(_dealt_segments(buckets), "bucket int, settled boolean, rows binary")
    found = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _first_copies, "doc long, start long, n int, check int, gram long")
    # a written table in the shared folder: both uses below read it, and an executor can go
    path = f"{ensure_checkpoint_dir(spark)}/repeats-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)

    texts = rows.mapInArrow(_compressed, "doc long, packed binary").repartition(buckets, "doc")  # one exchange, used twice
    cells = found.filter("gram is not null").groupBy("doc").agg(F.collect_list(F.struct("start", "n", "check", "gram")).alias("spans"))
    opened = texts.join(cells.hint("shuffle_merge"), "doc").select("doc", "packed", "spans").mapInArrow(_cut_out(buckets), "bucket int, rows binary")
    later = opened.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_later_windows(array_bytes), "doc long, start long, n int, check int")
    spans = found.filter("gram is null").drop("gram").union(later)
    cells = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "check")).alias("spans"))
    joined = texts.join(cells.hint("shuffle_merge"), "doc", "left").select("doc", "packed", "spans")
    out = joined.mapInArrow(_kept, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), places AS (
    SELECT doc_id, h, unnest(range(0, length(h) // 2 - {WIDTH - 1})) AS i FROM texts
), windows AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, {2 * WIDTH}) AS w FROM places
), first AS (
    SELECT w, min(doc_id) AS doc FROM windows GROUP BY w
), later AS (
    SELECT x.doc_id, x.i FROM windows x JOIN first f ON x.w = f.w AND f.doc < x.doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS j FROM later
), bytes AS (
    SELECT t.doc_id, t.j, t.c, g.j IS NOT NULL AS gone
    FROM (SELECT doc_id, j, substr(h, 2 * j + 1, 2) AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS j FROM texts)) t
    LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.j = t.j
), runs AS (
    SELECT doc_id, c, j, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS head FROM bytes
), done AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans,
           string_agg(c, '' ORDER BY j) FILTER (NOT gone) AS kept
    FROM runs GROUP BY doc_id
)
SELECT t.doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, coalesce(d.n_removed, 0) AS n_removed, coalesce(d.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(d.kept, ''))) AS kept_sha256
FROM texts t LEFT JOIN done d USING (doc_id)
"""
