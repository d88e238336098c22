"""Source trees on any file system, listed and read by tasks.

Spark's own listing hides names that start with ``.`` or ``_`` and gives no row
for an empty file; both are part of a source tree. Here tasks list folders
through Arrow's file systems (local disks, hdfs, viewfs, s3, gs, or one that the
caller opens), in rounds: a task goes down from its folder until it has seen
``ENTRIES`` entries and leaves the folders it did not get to for the next round.
The rounds' listings are cut off into the shared checkpoint folder; then each
listed file is read by the task that its name is dealt to.

What cannot be read is skipped, as the source tool does: folders and files
without permission, files that are gone by now, broken links. Only regular files
are opened (no pipe, socket or device); links to files are read, links to
folders are not entered.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.session import ensure_checkpoint_dir

#: Entries that a task lists before it leaves further folders to others.
ENTRIES = 5_000
#: Bytes of files that one partition reads, and that one Arrow batch holds, about.
PART_BYTES = 64 << 20
BATCH_BYTES = 16 << 20

#: Opens a root: (file system, path in it). Must be picklable.
Opener = Callable[[str], tuple[pafs.FileSystem, str]]

_ENTRY = "path string, is_folder boolean, size long, mod_time timestamp"
_FILE = "path string, size long, mod_time timestamp, content string, is_text boolean"


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as a URI; one without a scheme belongs to the session's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.toUri().getScheme() is None:
        path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    uri = path.toUri().toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _list_folder(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    try:
        return fs.get_file_info(pafs.FileSelector(folder))
    except OSError:
        return []


def _is_link(fs: pafs.FileSystem, path: str) -> bool:
    if isinstance(fs, pafs.SubTreeFileSystem):
        return _is_link(fs.base_fs, fs.base_path.rstrip("/") + "/" + path.lstrip("/"))
    return isinstance(fs, pafs.LocalFileSystem) and os.path.islink(path)


def _lister(root: str, open_root: Opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        base = base.rstrip("/")
        for batch in batches:
            for start in batch.column(0).to_pylist():
                out: list[tuple] = []
                todo = [start]
                while todo and len(out) < ENTRIES:
                    here = todo.pop()
                    for info in _list_folder(fs, f"{base}/{here}" if here else base):
                        path = f"{here}/{info.base_name}" if here else info.base_name
                        if info.type == pafs.FileType.Directory:
                            if not _is_link(fs, info.path):
                                todo.append(path)
                        elif info.type == pafs.FileType.File:
                            out.append((path, False, info.size, info.mtime))
                out += [(path, True, None, None) for path in todo]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _entry_types(), strict=True)], names=["path", "is_folder", "size", "mod_time"])
    return run


def _entry_types() -> list[pa.DataType]:
    return [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]


def list_tree(spark: SparkSession, uri: str, open_root: Opener = pafs.FileSystem.from_uri) -> DataFrame:
    """(path, size, mod_time) of the regular files below ``uri``."""
    ensure_checkpoint_dir(spark)
    found, todo = [], spark.createDataFrame([("",)], "path string")
    while True:
        listed = todo.mapInArrow(_lister(uri, open_root), _ENTRY).checkpoint(eager=True)
        found.append(listed.where("NOT is_folder"))
        folders = listed.where("is_folder").select("path")
        left = folders.count()
        if not left:
            break
        todo = folders.repartition(min(left, 4 * spark.sparkContext.defaultParallelism), "path")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.select("path", "size", "mod_time")


def text_of(data: bytes) -> tuple[str, bool]:
    """The bytes as text, and whether they are text: valid UTF-8 without a zero byte; bytes that are not are replaced."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace"), False
    return text, "\0" not in text


def read_file(fs: pafs.FileSystem, path: str) -> bytes | None:
    """The file's bytes, or None where it cannot be read."""
    try:
        with fs.open_input_stream(path) as f:
            return f.read()
    except OSError:
        return None


def _reader(root: str, open_root: Opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_root(root)
        base = base.rstrip("/")
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "size", "mod_time", "content", "is_text"])

        for batch in batches:
            for path, mod_time in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = read_file(fs, f"{base}/{path}")
                if data is None:
                    continue
                text, is_text = text_of(data)
                rows.append((path, len(data), mod_time or dt.datetime.fromtimestamp(0, dt.timezone.utc), text, is_text))
                held += len(data)
                if held >= BATCH_BYTES or len(rows) >= 1000:
                    yield flush()
                    rows.clear()
                    held = 0
        if rows:
            yield flush()
    return run


def read_files(spark: SparkSession, root: str, open_root: Opener = pafs.FileSystem.from_uri) -> DataFrame:
    """(path, size, mod_time, content, is_text) of the regular files below ``root``."""
    uri = qualified(spark, root)
    listed = list_tree(spark, uri, open_root)
    size = listed.agg(F.sum("size"), F.count("*")).first()
    parts = min(max(1, size[1]), max(spark.sparkContext.defaultParallelism, -(-(size[0] or 0) // PART_BYTES)))
    return listed.select("path", "mod_time").repartition(parts, "path").mapInArrow(_reader(uri, open_root), _FILE)
