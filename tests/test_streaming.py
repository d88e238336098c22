"""Streaming watchers equal their batch twins (file source, several micro-batches, availableNow)."""

import datetime as dt
import os
import random
import time
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from codelens.operators import process as P
from codelens.plans.fixtures import register
from codelens.session import ensure_checkpoint_dir
from codelens.streaming import watchers as W
from tests.conftest import SF_SMALL


def _stage(spark, name, df, parts, scratch):
    src = os.path.join(scratch, f"{name}-src")
    os.makedirs(src)
    pdf = df.toPandas().sort_values("seq")
    for i, chunk in enumerate(np.array_split(pdf, parts)):
        chunk.to_parquet(os.path.join(src, f"part-{i:03d}.parquet"), index=False,
                         coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(os.path.join(src, f"part-{i:03d}.parquet"), (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def _run(spark, sdf, mode="append", ckpt=None):
    rows = []
    ckpt = ckpt or f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    _finish(spark, sdf.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
            .foreachBatch(lambda b, e: rows.extend(r.asDict() for r in b.collect())))
    return rows


def _finish(spark, writer):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store each
    try:
        with W.use_state_store(spark):
            q = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert q.awaitTermination(120) or q.stop()


def test_error_stream_matches_batch_context(spark, scratch):
    register(spark, SF_SMALL)
    lines = spark.table("log_lines").select("seq", "pid", "source", "ts", "line")
    rows = _run(spark, W.error_stream(_stage(spark, "logs", lines, 4, scratch)))
    from codelens.plans.registry import load_all
    batch = load_all()["win_context"][0](spark, SF_SMALL).collect()
    want = {(r.seq, r.context, r.severity, r.error_type) for r in batch}
    got = {(r["seq"], r["context"], r["severity"], r["error_type"]) for r in rows}
    assert len(want) > 0 and got == want


def test_change_stream_matches_batch(spark, scratch):
    register(spark, SF_SMALL)
    obs = spark.table("file_observations")
    rows = _run(spark, W.change_stream(_stage(spark, "obs", obs, 3, scratch)))
    from codelens.plans.registry import load_all
    batch = load_all()["win_changes"][0](spark, SF_SMALL).collect()
    assert {(r.seq, r.change_type) for r in batch} == {(r["seq"], r["change_type"]) for r in rows}


def _put(src, name, rows, columns):
    os.makedirs(src, exist_ok=True)
    pd.DataFrame(rows, columns=columns).to_parquet(os.path.join(src, name), index=False, coerce_timestamps="us", allow_truncated_timestamps=True)


def test_idle_keys_lose_their_state(spark, scratch):
    """A path not seen for longer than its time to live is 'created' again; one that is seen stays known, whatever its clock says."""
    t0 = dt.datetime(2024, 1, 1)
    src, ckpt = os.path.join(scratch, "ttl-src"), os.path.join(scratch, "ttl-ckpt")
    schema = "seq long, path string, observed_at timestamp_ntz, mtime timestamp_ntz"
    columns = ["seq", "path", "observed_at", "mtime"]

    def run(seq, path, days):
        _put(src, f"part-{seq}.parquet", [(seq, path, t0 + dt.timedelta(days=days), t0)], columns)
        return [r["change_type"] for r in _run(spark, W.change_stream(spark.readStream.schema(schema).parquet(src), ttl_ms=20_000), ckpt=ckpt)]

    assert run(1, "a.go", 0) == ["created"]
    assert run(2, "a.go", 30) == []  # soon after, though its own clock says a month
    time.sleep(21)
    assert run(3, "b.go", 0) == ["created"]
    assert run(4, "a.go", 30) == ["created"]
    assert run(5, "b.go", -30) == []


def test_clocks_hours_apart_lose_no_line(spark, scratch):
    """Two processes whose clocks differ by hours, shuffled rows, a restart after each of four triggers: all errors come out."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1 + i % 2, "stdout", t0 + dt.timedelta(hours=-9 * (i % 2), seconds=i), f"Error: {i}" if i % 3 == 0 else f"line {i}") for i in range(80)]
    schema, columns = "seq long, pid long, source string, ts timestamp_ntz, line string", ["seq", "pid", "source", "ts", "line"]
    src, out = os.path.join(scratch, "clocks"), {name: [] for name in ("errors", "state")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for k in range(4):
            part = rows[20 * k: 20 * k + 20]
            random.Random(k).shuffle(part)
            _put(src, f"part-{k}.parquet", part, columns)
            stream = spark.readStream.schema(schema).parquet(src)
            for name, sdf in (("errors", W.error_stream(stream)), ("state", W.process_state(stream, tail_n=3))):
                out[name] += _run(spark, sdf, "append" if name == "errors" else "update", os.path.join(scratch, f"ckpt-{name}"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    batch = spark.createDataFrame(rows, schema)
    want = {(r.seq, r.pid, r.message, "\n".join(r.context)) for r in P.with_context(batch).collect()}
    assert len(want) == 27 and {(r["seq"], r["pid"], r["message"], r["context"]) for r in out["errors"]} == want and len(out["errors"]) == 27
    last = {r["pid"]: r for r in out["state"]}
    for pid in (1, 2):
        mine = [r for r in rows if r[1] == pid]
        errors = [r for r in mine if r[4].startswith("Error")]
        state = last[pid]
        assert (state["lines"], state["errors"], state["last_error"], state["tail"]) == (40, len(errors), errors[-1][4], "\n".join(r[4] for r in mine[-3:]))


def test_process_state_and_counters(spark, scratch):
    register(spark, SF_SMALL)
    lines = spark.table("log_lines").select("seq", "pid", "source", "ts", "line")
    rows = _run(spark, W.process_state(_stage(spark, "ps", lines, 3, scratch), tail_n=3), mode="update")
    final = {}
    for r in rows:
        if r["pid"] not in final or r["last_seq"] >= final[r["pid"]]["last_seq"]:
            final[r["pid"]] = r
    pdf = lines.toPandas()
    for pid, g in pdf.groupby("pid"):
        g = g.sort_values("seq")
        assert final[pid]["lines"] == len(g)
        assert final[pid]["tail"] == "\n".join(g["line"].tolist()[-3:])


def test_latest_errors_stream(spark, scratch):
    register(spark, SF_SMALL)
    lines = spark.table("log_lines").select("seq", "pid", "source", "ts", "line")
    rows = _run(spark, W.latest_errors(_stage(spark, "le", lines, 3, scratch)), mode="update")
    last = {}
    for r in rows:
        last[r["pid"]] = max(last.get(r["pid"], -1), r["seq"])
    classified = W.classify_columns(lines).where("is_error").groupBy("pid").max("seq").collect()
    assert last == {r["pid"]: r["max(seq)"] for r in classified}


def test_counters_stream(spark, scratch):
    register(spark, SF_SMALL)
    lines = spark.table("log_lines").select("seq", "pid", "source", "ts", "line")
    rows = _run(spark, W.counters(_stage(spark, "ct", lines, 3, scratch)), mode="update")
    got = {}
    for r in rows:
        got[r["pid"]] = max(got.get(r["pid"], (0, 0)), (r["lines"], r["errors"]))
    want = W.classify_columns(lines).groupBy("pid").agg({"seq": "count", "is_error": "count_if"}).collect()
    assert got == {r["pid"]: (r["count(seq)"], r["count_if(is_error)"]) for r in want}


def test_streams_do_not_depend_on_chunks(spark, scratch):
    """Shuffled lines of few processes, four rows an Arrow chunk: context, tail and changes as in order."""
    register(spark, SF_SMALL)
    lines = spark.table("log_lines").select("seq", (F.col("pid") % 2).alias("pid"), "source", "ts", "line")
    shuffled = lines.orderBy(F.xxhash64("seq"))
    obs = spark.table("file_observations").withColumn("path", F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/a.go")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        src = os.path.join(scratch, "shuffled")
        shuffled.write.parquet(src)
        rows = _run(spark, W.error_stream(spark.readStream.schema(lines.schema).parquet(src)))
        osrc = os.path.join(scratch, "obs")
        obs.orderBy(F.xxhash64("seq")).write.parquet(osrc)
        changes = _run(spark, W.change_stream(spark.readStream.schema(obs.schema).parquet(osrc)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {(r.seq, "\n".join(r.context)) for r in P.with_context(lines).collect()}
    assert want and {(r["seq"], r["context"]) for r in rows} == want
    assert {(r["seq"], r["change_type"]) for r in changes} == {(r.seq, r.change_type) for r in P.file_changes(obs).collect()}


def test_fan_out_and_retain(spark, scratch):
    register(spark, SF_SMALL)
    obs = spark.table("file_observations")
    changes = W.change_stream(_stage(spark, "fo", obs, 2, scratch))
    out = os.path.join(scratch, "pub")
    ckpt = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    _finish(spark, changes.writeStream.option("checkpointLocation", ckpt).foreachBatch(W.fan_out(out)))
    published = spark.read.text(out).count()
    from codelens.plans.registry import load_all
    assert published == load_all()["win_changes"][0](spark, SF_SMALL).count()  # every change published once
    keep_dir = os.path.join(scratch, "recent")
    ckpt2 = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    _finish(spark, W.change_stream(_stage(spark, "fo2", obs, 4, scratch)).writeStream.option("checkpointLocation", ckpt2)
            .foreachBatch(W.retain_recent(keep_dir, keep=3)))
    ch = P.file_changes(obs).withColumn("project", P.change_project(F.col("path")))
    want = {(r.project, r.seq) for r in P.top_k(ch, ["project"], [F.col("observed_at").desc(), F.col("seq").desc()], 3).collect()}
    got = W.read_recent(spark, keep_dir).collect()
    assert {(r.project, r.seq) for r in got} == want and len(got) == len(want)
    # a replayed epoch gives the same version again
    versions = sorted(int(v[1:]) for v in os.listdir(keep_dir) if v.startswith("v"))
    assert len(versions) == 2
    W.retain_recent(keep_dir, keep=3)(ch.limit(0), versions[-1] + 1)
    W.retain_recent(keep_dir, keep=3)(ch.limit(0), versions[-1] + 1)
    assert {(r.project, r.seq) for r in W.read_recent(spark, keep_dir).collect()} == want


class _Map:
    """A map state in memory."""

    def __init__(self):
        self.held = {}

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value


class _Handle:
    def getMapState(self, name, key, value, ttl):
        return _Map()


def test_many_keys_share_a_frame():
    """A group's 300 keys, whose rows come mixed and in chunks, give one frame for each micro-batch, as 300 steps of their own would."""
    rows = [(f"k{i % 300}", i, str(i % 300), None, f"line {i}", i % 4 == 0, "error", "runtime") for i in range(1500)]
    frame = pd.DataFrame(rows, columns=["stream_key", "seq", "pid", "source", "line", "is_error", "severity", "error_type"])
    for processor, given in ((W.ErrorContext(None, 3), 375), (W.ProcessState(None, 2), 600), (W.Latest(None), 150), (W.Counters(None), 600)):
        processor.init(_Handle())
        out = []
        for part in (frame[:750], frame[750:]):
            part = part.assign(ts=pd.Timestamp(2024, 1, 1)).sample(frac=1, random_state=1)
            out += [list(processor.handleInputRows((0,), iter([part[:400], part[400:]]), None))]
        assert [len(x) for x in out] == [1, 1]
        assert sum(len(x) for (x,) in out) == given
        last = out[1][0].set_index("pid")
        if isinstance(processor, W.ErrorContext):
            assert set(last[last.seq == 900].context) == {"line 300\nline 600\nline 900"}
        elif isinstance(processor, W.ProcessState):
            assert list(last.loc["8"][["lines", "errors", "last_error", "last_seq", "tail"]]) == [5, 5, "line 1208", 1208, "line 908\nline 1208"]
