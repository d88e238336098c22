"""Structured Streaming forms of the watchers.

* ``error_stream``      STR_ERRORS: classify each process line (JVM expressions) and attach the last
                        5 lines of its (pid, source) stream; state holds only the last 4 lines.
* ``change_stream``     STR_CHANGES: created / modified per path; value state holds the last mtime.
* ``latest_errors``     STR_LATEST: newest error per process.
* ``process_state``     STR_PROCESS_STATE: status, last error and bounded tail per process.
* ``counters``          STR_COUNTERS: running counters per process.
* ``retain_recent``     STR_RECENT: a ``foreachBatch`` sink keeping each workspace's newest changes in a table.
* ``fan_out``           SNK_ERROR_FANOUT: ``foreachBatch`` writing each error as JSON for every subscriber.

Keyed state lives in ``transformWithStateInPandas`` processors. There is no
watermark: processes have clocks of their own, and a clock that all of them
shared would throw away the lines of those that lag behind. Instead each state
variable has a time to live that starts anew whenever its key is seen (by the
time lines arrive, not by what they say), so a stream over ever-new keys keeps
bounded state and no line is dropped for its time. The operators need the
RocksDB state store (``use_state_store``).

Keys are dealt to ``GROUPS`` groups and a step takes all keys of a group, each
with its own entry of the group's map state. A group's rows of a micro-batch
may come in several Arrow chunks; they are put in order together before the
state step, so results do not depend on chunk sizes (their memory is bounded by
what a trigger reads). The per-key Python only slices small lists:
classification, parsing and regexes run in the JVM before it. A source that reads a bounded amount per trigger takes the place of the
source tool's drop-on-full channel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codelens.functions import catalogs as C
from codelens.functions.text import any_of, java_regex
from codelens.operators.diagnostics import error_severity, error_type
from codelens.operators.process import change_project, top_k

DAY_MS = 24 * 3600 * 1000
#: Groups that the keys of a stream are dealt to by a hash; a checkpoint keeps its number.
GROUPS = 1024

ERROR_OUT = ("seq long, pid long, source string, severity string, error_type string, message string, "
             "context string, context_lines long")


@contextmanager
def use_state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside this block keep their state in RocksDB, as keyed processors need.

    They make no batches without data either: a state's time to live would ask
    for another empty batch for ever, so an ``availableNow`` run never ended.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def classify_columns(lines: DataFrame, custom_patterns=()) -> DataFrame:
    ln = F.col("line")
    gate = java_regex(any_of(list(C.PROCESS_ERROR_PATTERNS) + list(custom_patterns)))
    return (lines.withColumn("is_error", ln.rlike(gate))
            .withColumn("severity", error_severity(ln)).withColumn("error_type", error_type(ln)))


class _Keyed(StatefulProcessor):
    """Base of the processors: a step takes the rows and the states of a group of keys, key after key.

    Calls between Python and the state store and frames for each key cost far more
    than a key's few rows, so keys share a frame (``GROUPS``) and each has an entry
    of its own, with its own time to live, in a map that its group keeps.
    """

    #: Schema of the value that a key keeps.
    VALUE: str

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("state", "key string", self.VALUE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # all rows of the group in the micro-batch, those of a key together and by seq
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["stream_key", "seq"], kind="stable", ignore_index=True)
        columns = self.columns(frame)
        keys = frame["stream_key"].tolist()
        starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        found: list[tuple] = []
        for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            value, out = self.step(self.state.getValue((keys[start],)), range(start, end), columns)
            if value is not None:  # seen: its time to live starts anew
                self.state.updateValue((keys[start],), value)
            found += out
        if found:
            yield self.output(frame, found)

    def columns(self, frame: pd.DataFrame) -> dict[str, list]:
        """What the steps read of a group's rows."""
        return {c: frame[c].tolist() for c in ("seq", "line", "is_error") if c in frame}

    def step(self, held: tuple | None, at: range, columns: dict[str, list]) -> tuple[tuple | None, list[tuple]]:
        """The value that a key keeps (None: leave it) and what is given out for it, from the value held and its rows ``at``."""
        raise NotImplementedError

    def output(self, frame: pd.DataFrame, found: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, keys: list[str], processor: _Keyed, out: str, mode: str) -> DataFrame:
    """The processor's stream over groups of keys; ``out`` names the keys, whose values go through Python as text (longs with nulls stay exact)."""
    types = dict(df.select(*keys).dtypes)
    rows = df.withColumn("stream_key", F.to_json(F.struct(*keys))).withColumns({k: F.col(k).cast("string") for k in keys})
    schema = ", ".join(f"{f.split()[0]} string" if f.split()[0] in types else f for f in out.split(", "))
    given = (rows.withColumn("stream_group", F.pmod(F.xxhash64("stream_key"), F.lit(GROUPS))).groupBy("stream_group")
             .transformWithStateInPandas(processor, schema, mode, "ProcessingTime" if processor.ttl_ms else "None"))
    return given.withColumns({k: F.col(k).cast(t) for k, t in types.items()})


class ErrorContext(_Keyed):
    VALUE = "lines string"  # JSON

    def __init__(self, ttl_ms: int | None, n: int):
        super().__init__(ttl_ms)
        self.keep = n - 1

    def step(self, held, at, columns):
        before = json.loads(held[0]) if held else []
        lines = before + columns["line"][at.start: at.stop]
        out = []
        for k, i in enumerate(at, len(before)):
            if columns["is_error"][i]:
                context = lines[max(0, k - self.keep): k + 1]
                out.append((i, "\n".join(map(_text, context)), len(context)))
        return (json.dumps(lines[-self.keep:]),) if self.keep else None, out

    def output(self, frame, found):
        at, context, n = zip(*found, strict=True)
        out = frame.loc[list(at), ["seq", "pid", "source", "severity", "error_type", "line"]].rename(columns={"line": "message"})
        return out.assign(context=list(context), context_lines=list(n))


def _text(line: str | None) -> str:
    return line or ""


def error_stream(lines: DataFrame, n: int = C.CONTEXT_LINES, custom_patterns=(), ttl_ms: int | None = DAY_MS) -> DataFrame:
    """STR_ERRORS over a streaming frame of (seq, pid, source, ts, line)."""
    c = classify_columns(lines, custom_patterns).select("seq", "pid", "source", "line", F.coalesce("is_error", F.lit(False)).alias("is_error"),
                                                        "severity", "error_type")
    return _keyed(c, ["pid", "source"], ErrorContext(ttl_ms, n), ERROR_OUT, "append")


CHANGE_OUT = "seq long, path string, change_type string, mtime timestamp_ntz, observed_at timestamp_ntz"


class Changes(_Keyed):
    VALUE = "mtime_us long"

    def columns(self, frame):
        return {"us": pd.to_datetime(frame["mtime"]).astype("datetime64[us]").astype("int64").tolist()}

    def step(self, held, at, columns):
        last = held[0] if held else None
        out = []
        for i in at:
            m = columns["us"][i]
            if last is None:
                out.append((i, "created"))
            elif m > last:
                out.append((i, "modified"))
            last = m
        return (last,), out

    def output(self, frame, found):
        at, change = zip(*found, strict=True)
        return frame.loc[list(at), ["seq", "path", "mtime", "observed_at"]].assign(change_type=list(change))


def change_stream(observations: DataFrame, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """STR_CHANGES over a streaming frame of (seq, path, observed_at, mtime); state per path: the last mtime."""
    obs = observations.select("seq", "path", "observed_at", "mtime")
    return _keyed(obs, ["path"], Changes(ttl_ms), CHANGE_OUT, "append")


LATEST_OUT = "pid long, seq long, ts timestamp_ntz, severity string, error_type string, message string"


class Latest(_Keyed):
    VALUE = "seq long"

    def step(self, held, at, columns):
        for i in reversed(at):
            if columns["is_error"][i]:
                if held is None or columns["seq"][i] > held[0]:
                    return (columns["seq"][i],), [(i,)]
                break
        return (held[0],) if held else None, []

    def output(self, frame, found):
        return frame.loc[[i for i, in found], ["pid", "seq", "ts", "severity", "error_type", "line"]].rename(columns={"line": "message"})


def latest_errors(lines: DataFrame, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """STR_LATEST: newest error per process, given out when it changes (update mode). Filter by a duration at read time."""
    c = classify_columns(lines).select("seq", "pid", F.col("ts").cast("timestamp_ntz").alias("ts"), "line",
                                       F.coalesce("is_error", F.lit(False)).alias("is_error"), "severity", "error_type")
    return _keyed(c, ["pid"], Latest(ttl_ms), LATEST_OUT, "update")


PROCESS_OUT = "pid long, lines long, errors long, last_error string, last_seq long, tail string"


class ProcessState(_Keyed):
    VALUE = "lines long, errors long, last_error string, last_seq long, tail string"  # tail: JSON

    def __init__(self, ttl_ms: int | None, tail_n: int):
        super().__init__(ttl_ms)
        self.tail_n = tail_n

    def step(self, held, at, columns):
        lines, n_errors, last_error, last_seq, kept = held or (0, 0, None, -1, "[]")
        for i in at:
            if columns["is_error"][i]:
                n_errors, last_error = n_errors + 1, columns["line"][i]
        lines, last_seq = lines + len(at), max(last_seq, columns["seq"][at[-1]])
        tail = (json.loads(kept) + columns["line"][at.start: at.stop])[-self.tail_n:]
        out = (at.start, lines, n_errors, last_error, last_seq, "\n".join(map(_text, tail)))
        return (lines, n_errors, last_error, last_seq, json.dumps(tail)), [out]

    def output(self, frame, found):
        out = pd.DataFrame(found, columns=["at", "lines", "errors", "last_error", "last_seq", "tail"])
        return out.assign(pid=frame.loc[out.pop("at"), "pid"].tolist())


def process_state(lines: DataFrame, tail_n: int = C.MAX_OUTPUT_LINES, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """STR_PROCESS_STATE: per process counts, last error and the last ``tail_n`` lines (update mode)."""
    c = classify_columns(lines).select("seq", "pid", "line", F.coalesce("is_error", F.lit(False)).alias("is_error"))
    return _keyed(c, ["pid"], ProcessState(ttl_ms, tail_n), PROCESS_OUT, "update")


class Counters(_Keyed):
    VALUE = "lines long, errors long"

    def columns(self, frame):
        return {"is_error": frame["is_error"].tolist()}

    def step(self, held, at, columns):
        lines, errors = held or (0, 0)
        value = (lines + len(at), errors + sum(columns["is_error"][at.start: at.stop]))
        return value, [(at.start, *value)]

    def output(self, frame, found):
        out = pd.DataFrame(found, columns=["at", "lines", "errors"])
        return out.assign(pid=frame.loc[out.pop("at"), "pid"].tolist())


def counters(lines: DataFrame, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """STR_COUNTERS: running error and line counters per process (update mode)."""
    c = classify_columns(lines).select("seq", "pid", F.coalesce("is_error", F.lit(False)).alias("is_error"))
    return _keyed(c, ["pid"], Counters(ttl_ms), "pid long, lines long, errors long", "update")


def keep_output(out_dir: str):
    """``foreachBatch`` sink that keeps every micro-batch's rows under ``epoch=<n>``; a replayed epoch replaces itself."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    return write


def run_through(rows: DataFrame, order: str, build, folder: str, mode: str = "append", arrivals: int = 3) -> DataFrame:
    """What a stream operator writes when ``rows`` arrive in ``arrivals`` parts, in the order of the number ``order``.

    Each part is put in place by a rename and taken by an ``availableNow`` run
    that starts from the checkpoint of the one before; ``build`` makes the
    operator's stream from the stream that reads the parts.
    """
    spark = rows.sparkSession
    bounds = rows.approxQuantile(order, [k / arrivals for k in range(1, arrivals)], 0.01)
    part = sum((F.when(F.col(order) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    rows.withColumn("arrival", part).write.partitionBy("arrival").parquet(f"{folder}/staged")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{folder}/in"))
    out_schema = None
    for k in range(arrivals):
        if fs.exists(path(f"{folder}/staged/arrival={k}")):
            fs.rename(path(f"{folder}/staged/arrival={k}"), path(f"{folder}/in/part-{k}"))
            out = build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"))
            out_schema = out.schema
            with use_state_store(spark):
                query = (out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
                         .foreachBatch(keep_output(f"{folder}/out")).trigger(availableNow=True).start())
            query.awaitTermination()
    if out_schema is None:  # nothing arrived
        return spark.createDataFrame([], build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).schema).withColumn("epoch", F.lit(0))
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/epoch=*")


def _versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Complete versions in the folder, through Hadoop's file system (any store that Spark reads)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()[1:]) for p in done)


def read_recent(spark: SparkSession, table_dir: str) -> DataFrame:
    """The newest complete version that ``retain_recent`` wrote."""
    return spark.read.parquet(f"{table_dir}/v{_versions(spark, table_dir)[-1]}")


def retain_recent(table_dir: str, keep: int = C.MAX_CHANGES):
    """STR_RECENT sink: after every micro-batch each workspace's newest ``keep`` changes, as version ``epoch``.

    A version is the last one before its epoch plus the batch, so an epoch that
    is replayed gives the same version again; readers take the newest complete
    version and apply the 10-minute filter. Versions before the previous one
    are removed.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in _versions(spark, table_dir) if v < epoch]
        rows = batch.select("seq", "path", "change_type", "observed_at", change_project(F.col("path")).alias("project"))
        if earlier:
            rows = rows.unionByName(spark.read.parquet(f"{table_dir}/v{earlier[-1]}"))
        top = top_k(rows, ["project"], [F.col("observed_at").desc(), F.col("seq").desc()], keep).drop("rank")
        top.write.mode("overwrite").parquet(f"{table_dir}/v{epoch}")
        path = spark._jvm.org.apache.hadoop.fs.Path
        for v in earlier[:-1]:
            old = path(f"{table_dir}/v{v}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write


def fan_out(out_dir: str):
    """SNK_ERROR_FANOUT: each micro-batch of errors is published once, as JSON lines under ``epoch=<n>``.

    Every subscriber reads the same published log from its own offset (as with
    a message topic), so the errors x subscribers product is never built.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        msgs = batch.select(F.to_json(F.struct(*batch.columns)).alias("value"))
        msgs.write.mode("overwrite").text(f"{out_dir}/epoch={epoch}")

    return write
