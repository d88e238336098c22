"""Errors published to a log that subscribers read from offsets of their own.

A streaming sink with commits: tasks write the rows of an epoch as files that no
reader sees and name them in their commit messages; when all tasks are done, one
manifest ``_log/<epoch>.json`` makes them visible together. An epoch that fails
is aborted and its files go; an epoch that is replayed after a restart finds its
manifest there and adds nothing. Files of an executor that was lost before it
could say their names stay unseen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter


@dataclass
class Written(WriterCommitMessage):
    """The file of one task; None: it had no rows."""

    file: str | None


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class Publisher(DataSourceStreamArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _opened(self.folder)
        out, file = None, f"{uuid.uuid4().hex}.jsonl"
        for batch in iterator:
            if batch.num_rows and out is None:
                fs.create_dir(f"{root}/_rows", recursive=True)
                out = fs.open_output_stream(f"{root}/_rows/{file}")
            if batch.num_rows:
                out.write("".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode())
        if out is None:
            return Written(None)
        out.close()
        return Written(file)

    def _remove(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.folder)
        for m in messages:
            if m is not None and m.file is not None:
                fs.delete_file(f"{root}/_rows/{m.file}")

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803 - Spark's name
        fs, root = _opened(self.folder)
        target = f"{root}/_log/{batchId:020d}.json"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:  # replayed: its rows are there
            self._remove(messages)
            return
        fs.create_dir(f"{root}/_log", recursive=True)
        waiting = f"{root}/_log/.{uuid.uuid4().hex}"
        with fs.open_output_stream(waiting) as out:
            out.write(json.dumps([m.file for m in messages if m is not None and m.file is not None]).encode())
        fs.move(waiting, target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803 - Spark's name
        self._remove(messages)


class PublishedLog(DataSource):
    """Streaming sink ``published_log`` for rows with one string column, one line each (option path: the shared folder)."""

    @classmethod
    def name(cls) -> str:
        return "published_log"

    def streamWriter(self, schema, overwrite: bool) -> Publisher:  # noqa: N802 - Spark's name
        return Publisher(self.options["path"])


def publish(errors: DataFrame, folder: str) -> DataStreamWriter:
    """SNK_ERROR_FANOUT: a writer that publishes each row of a stream once, as a JSON object; give it a checkpoint and start it."""
    errors.sparkSession.dataSource.register(PublishedLog)
    rows = errors.select(F.to_json(F.struct(*errors.columns)).alias("value"))
    return rows.writeStream.format("published_log").option("path", folder)


class Subscriber:
    """A reader of a published log; its offset is the last epoch it said it was done with, kept beside the log."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name

    def _numbers(self, place: str) -> list[int]:
        fs, root = _opened(self.folder)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/{place}", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if not f.base_name.startswith("."))

    def offset(self) -> int:
        """The last epoch that is done with; -1 at first."""
        return max(self._numbers(f"_subscribers/{self.name}"), default=-1)

    def new(self, at_most: int = 1000) -> tuple[DataFrame, int]:
        """(value) of the epochs after the offset, the oldest ``at_most`` of them, and the last epoch among these."""
        fs, root = _opened(self.folder)
        offset = self.offset()
        epochs = [n for n in self._numbers("_log") if n > offset][:at_most]
        files = []
        for n in epochs:
            with fs.open_input_stream(f"{root}/_log/{n:020d}.json") as f:
                files += json.loads(f.read())
        paths = [f"{self.folder}/_rows/{f}" for f in files]
        rows = self.spark.read.text(paths) if paths else self.spark.createDataFrame([], "value string")
        return rows, epochs[-1] if epochs else offset

    def done(self, epoch: int) -> None:
        """All epochs up to this one are taken."""
        fs, root = _opened(self.folder)
        place = f"_subscribers/{self.name}"
        fs.create_dir(f"{root}/{place}", recursive=True)
        earlier = [n for n in self._numbers(place) if n < epoch]
        fs.open_output_stream(f"{root}/{place}/{epoch:020d}").close()
        for n in earlier:
            fs.delete_file(f"{root}/{place}/{n:020d}")
