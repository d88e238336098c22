"""Numbered lines of text files of any size.

A file is dealt to tasks as byte ranges. A range owns the lines that start in it
(at the file's beginning or after a newline), so a first pass that only counts
newlines gives every range its number of lines, a prefix over the ranges of a
file the number of its first line, and a second pass reads the ranges again and
gives out the lines, the last one up to its end beyond the range. Ranges are rows
of a table, so both passes see the same ones whatever the session's settings;
lines are not shuffled and no file is a single row.

Lines are what a split at newlines gives: a file that ends with a newline has an
empty last line, an empty file one empty line. Bytes that are no UTF-8 are
replaced. A file counts as long as it was when it was listed; one that is gone
or unreadable when it is read gives no lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelens.session import ensure_checkpoint_dir
from codelens.sources.tree import Opener

#: Bytes of a range, and of the blocks that are read at once.
RANGE_BYTES = 64 << 20
BLOCK = 4 << 20

_NEWLINE = 10


def _count(open_file: Opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for uri, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = 1 if start == 0 else 0
                try:
                    fs, path = open_file(uri)
                    with fs.open_input_file(path) as f:
                        f.seek(max(start, 1) - 1)
                        left = end - max(start, 1)
                        while left > 0 and (data := f.read(min(BLOCK, left))):
                            lines += data.count(b"\n")
                            left -= len(data)
                except OSError:
                    lines = None
                n.append(lines)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=["file", "start", "end", "size", "n"])
    return run


def _first_start(f, start: int, end: int) -> int | None:
    """Where the first line starts that starts in start:end."""
    if start == 0:
        return 0
    at = start - 1
    f.seek(at)
    while at < end - 1 and (data := f.read(min(BLOCK, end - 1 - at))):
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return None


def _owned(f, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines that start in start:end, as blocks of whole lines with their newlines (a file's last line may have none)."""
    at = _first_start(f, start, end)
    if at is None:
        return
    f.seek(at)
    held: list[bytes] = []  # parts of a line that goes on
    while data := f.read(min(BLOCK, size - at)):
        stop = data.find(b"\n", max(0, end - 1 - at))  # the line after this newline is not owned
        cut = (stop if stop >= 0 else data.rfind(b"\n")) + 1
        if cut:
            yield b"".join([*held, data[:cut]])
            held = []
        if stop >= 0:
            return
        held.append(data[cut:])
        at += len(data)
    if any(held):
        yield b"".join(held)


def _texts(data: bytes) -> pa.Array:
    """The lines of a block as strings; a newline at its end ends the last line."""
    buf = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(buf == _NEWLINE)
    offsets = np.concatenate([[0], ends + 1, [] if buf[-1] == _NEWLINE else [len(buf) + 1]]).astype(np.int64)
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return pa.array([data[a: b - 1].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
    keep = buf[buf != _NEWLINE]
    sizes = np.diff(offsets) - 1
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(keep))


def _read(open_file: Opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, end, size, line_no, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                try:
                    fs, path = open_file(uri)
                    with fs.open_input_file(path) as f:
                        left = n
                        for data in _owned(f, start, end, size):
                            lines = _texts(data)
                            yield _batch(uri, line_no + n - left, lines)
                            left -= len(lines)
                        if left > 0:  # the line after the file's last newline, or the one of an empty file
                            yield _batch(uri, line_no + n - left, pa.array([""] * left, pa.string()))
                except OSError:
                    continue
    return run


def _batch(uri: str, first: int, lines: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([uri], pa.string()).take(pa.array(np.zeros(len(lines), np.int64))), pa.array(first + np.arange(len(lines))), lines],
        names=["file", "line_no", "line"])


def numbered_lines(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES,
                   open_file: Opener = pafs.FileSystem.from_uri) -> DataFrame:
    """(file, line_no, line) of ``files``, (URI, size) each; line numbers start at 1."""
    ensure_checkpoint_dir(spark)
    listed = spark.createDataFrame(files, "file string, size long")
    start = F.explode(F.sequence(F.lit(0).cast("long"), "size", F.lit(range_bytes).cast("long"))).alias("start")
    # the place after the last byte belongs to the last range: a line may start there
    ranges = listed.select("file", start, "size").withColumn("end", F.least(F.col("start") + range_bytes, F.col("size") + 1))
    parts = max(1, sum(size // range_bytes + 1 for _, size in files))
    dealt = ranges.select("file", "start", "end", "size").repartition(min(parts, 10_000), "file", "start")
    counted = dealt.mapInArrow(_count(open_file), "file string, start long, end long, size long, n long").where("n IS NOT NULL").checkpoint(eager=True)
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")  # one row for each range
    numbered = counted.select("file", "start", "end", "size", (before + 1).alias("line_no"), "n")
    return numbered.repartition(min(parts, 10_000), "file", "start").mapInArrow(_read(open_file), "file string, line_no long, line string")
