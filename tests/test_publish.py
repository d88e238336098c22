"""The published log: epochs are visible as a whole, once, and each subscriber has its own offset."""

import json
import os
import uuid

import pyarrow as pa

from codelens.session import ensure_checkpoint_dir
from codelens.sinks.publish import Publisher, Subscriber, publish


def _values(found):
    return sorted(r["value"] for r in found.collect())


def test_failed_epochs_are_unseen_and_replayed_ones_add_nothing(spark, scratch):
    batch = lambda *x: pa.RecordBatch.from_arrays([pa.array(list(x), pa.string())], names=["value"])
    writer, reader = Publisher(scratch), Subscriber(spark, scratch, "a")
    assert _values(reader.new()[0]) == [] and reader.new()[1] == -1
    done = writer.write(iter([batch("x"), batch(), batch("y", "z")]))
    assert _values(reader.new()[0]) == []  # written, not committed
    writer.abort([done, None], 0)
    assert os.listdir(f"{scratch}/_rows") == [] and _values(reader.new()[0]) == []
    writer.commit([writer.write(iter([batch("x", "é")])), writer.write(iter([])), writer.write(iter([batch("y")]))], 0)
    writer.commit([writer.write(iter([batch("x", "é", "y")]))], 0)  # the epoch again, dealt otherwise
    writer.commit([writer.write(iter([]))], 1)
    rows, last = reader.new()
    assert _values(rows) == ["x", "y", "é"] and last == 1 and len(os.listdir(f"{scratch}/_rows")) == 2
    reader.done(last)
    assert reader.offset() == 1 and reader.new()[1] == 1 and _values(reader.new()[0]) == []
    assert _values(Subscriber(spark, scratch, "b").new(at_most=1)[0]) == ["x", "y", "é"]


def test_stream_publishes_each_row_once_over_a_replay(spark, scratch):
    ckpt = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    out, source = f"{scratch}/out", f"{scratch}/in"

    def run():
        lines = spark.readStream.schema("seq long, line string").parquet(source)
        publish(lines.where("line like 'error%'"), out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()

    want = []
    for k in range(2):
        rows = [(i, f"{'error' if i % 3 else 'fine'} {i}") for i in range(k * 20, k * 20 + 20)]
        spark.createDataFrame(rows, "seq long, line string").repartition(3).write.mode("append").parquet(source)
        run()
        want += [r for r in rows if r[1].startswith("error")]
    for name in ("1", ".1.crc"):  # as if the driver had stopped between the sink's commit and Spark's
        os.remove(f"{ckpt.removeprefix('file:')}/commits/{name}")
    run()
    a, b = Subscriber(spark, out, "a"), Subscriber(spark, out, "b")
    rows, last = a.new()
    assert sorted((x["seq"], x["line"]) for x in map(json.loads, _values(rows))) == want
    a.done(last)
    assert _values(a.new()[0]) == [] and len(_values(b.new()[0])) == len(want)
