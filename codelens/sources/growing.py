"""Lines of files that are still being written, as a stream.

``growing_lines`` is a Python streaming data source over a folder that the
driver and the executors mount (files in object stores do not grow). Its offset
is the number of bytes taken of each file, by the file's identity (device and
inode), so a file that is renamed while it is followed goes on where it stopped,
and a new file of the same name starts at its beginning. A micro-batch takes the
whole lines up to the last newline; the rest waits for its newline. A file that
became shorter than what was taken of it was truncated and starts again.

Offsets are in the stream's checkpoint: after a restart every line comes once.
A file that is gone when a batch is read (or read again) gives no lines.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes read at once.
BLOCK = 1 << 20


class GrowingLines(DataSource):
    """Options: path (a mounted folder), glob (of file names, default ``*``)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, start long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], self.options.get("glob", "*"))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, folder: str, glob: str):
        self.folder = folder.removeprefix("file://").removeprefix("file:").rstrip("/")
        self.glob = glob

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Name and end of the last whole line of each file, by identity."""
        out = {}
        for path in _files(self.folder, self.glob):
            try:
                with open(path, "rb") as f:
                    out[_identity(f)] = [os.path.basename(path), _last_line_end(f)]
            except OSError:  # gone or unreadable: next time
                continue
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for identity, (name, stop) in sorted(end.items()):
            begin = start.get(identity, [name, 0])[1]
            begin = 0 if stop < begin else begin  # shorter than what was taken: truncated
            if begin < stop:
                out.append(InputPartition((identity, name, begin, stop)))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        identity, name, begin, stop = partition.value
        found = _open(self.folder, name, identity)
        if found is None:
            return
        with found as f:
            f.seek(begin)
            at = begin
            while at < stop:
                line = f.readline(stop - at)
                if not line:  # truncated since
                    return
                yield name, at, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def _files(folder: str, glob: str) -> list[str]:
    with os.scandir(folder) as found:
        return sorted(x.path for x in found if fnmatch.fnmatch(x.name, glob) and x.is_file())


def _identity(f) -> str:
    s = os.fstat(f.fileno())
    return f"{s.st_dev}:{s.st_ino}"


def _last_line_end(f) -> int:
    """Place after the last newline, looked for from the end."""
    at = f.seek(0, os.SEEK_END)
    while at:
        lo = max(0, at - BLOCK)
        f.seek(lo)
        nl = f.read(at - lo).rfind(b"\n")
        if nl >= 0:
            return lo + nl + 1
        at = lo
    return 0


def _open(folder: str, name: str, identity: str):
    """The file of that identity, under its name or the one it has by now."""
    for path in [f"{folder}/{name}", *_files(folder, "*")]:
        try:
            f = open(path, "rb")  # noqa: SIM115 - given to the caller, who closes it
        except OSError:
            continue
        if _identity(f) == identity:
            return f
        f.close()
    return None


def follow_lines(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """SRC_PROC_STREAM: (file, start, line) of files that grow; ``start`` is the line's place in its file, in bytes."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("glob", glob).load(folder)


def follow_processes(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of ``<pid>.stdout.log`` and ``<pid>.stderr.log`` as the watchers take them: (seq, pid, source, ts, line).

    ``seq`` orders the lines of one output; ``ts`` is the time of the micro-batch that took the line.
    """
    part = lambda k: F.regexp_extract("file", r"^([0-9]+)\.(stdout|stderr)\.log", k)
    lines = follow_lines(spark, folder, "*.std*.log*").where(part(1) != "")
    return lines.select(F.col("start").alias("seq"), part(1).cast("long").alias("pid"), part(2).alias("source"),
                        F.current_timestamp().alias("ts"), "line")
