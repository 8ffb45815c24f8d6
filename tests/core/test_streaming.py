"""Streams: admission, the outbox, the ordered log and its replay, against their batch forms."""

import shutil
import time
from datetime import datetime

from memloom.operators import maintain
from memloom.streaming import feeds


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_admission_over_restarts(spark, tmp_path):
    rows = [[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "doc_id long, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = feeds.stream_admit(spark.readStream.schema("doc_id long, content string").parquet(str(tmp_path / "in")))
        run(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")))
        got = spark.read.parquet(str(tmp_path / "out"))
        assert sorted(x.content for x in got.collect()) == (["a", "b"], ["a", "b", "c"])[k]


def test_outbox_equals_batch(spark, tmp_path):
    changes = [("o1", 1, None), ("o2", 2, "x"), ("o1", 3, "y"), ("o1", 4, None)]
    schema = "owner_id string, seq long, owner_snapshot string"
    df = spark.createDataFrame(changes, schema)
    df.write.parquet(str(tmp_path / "in"))
    out = feeds.stream_outbox(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run(out.writeStream.format("memory").queryName("outbox").outputMode("complete"))
    got = sorted((x.owner_id, x.target_revision, x.owner_snapshot) for x in spark.table("outbox").collect())
    assert got == sorted((x.owner_id, x.target_revision, x.owner_snapshot) for x in maintain.coalesce_outbox(df).collect())


def test_ordered_log_and_replay(spark, tmp_path):
    """Numbers go on without gaps over batches; a batch that comes again changes nothing."""
    schema = "exploration_id string, event_id string, ts timestamp"
    spark.sql("select 'e1' exploration_id, 'a' event_id, timestamp '2024-01-01' ts union all select 'e2', 'b', timestamp '2024-01-01' union all select 'e1', 'c', timestamp '2024-01-02'").write.mode("append").parquet(str(tmp_path / "in"))
    log = str(tmp_path / "log")
    start = lambda name: run(feeds.stream_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), log, str(tmp_path / name)))
    start("check")
    spark.sql("select 'e1' exploration_id, 'd' event_id, timestamp '2024-01-03' ts").write.mode("append").parquet(str(tmp_path / "in"))
    start("check")
    want = [("e1", "a", 1), ("e1", "c", 2), ("e1", "d", 3), ("e2", "b", 1)]
    read = lambda: sorted((x.exploration_id, x.event_id, x.seq) for x in spark.read.parquet(log).collect())
    assert read() == want
    first = spark.read.parquet(log).filter("batch_id = 0").drop("batch_id", "seq")
    feeds.append_batch(first, log, 0)
    assert read() == want
    after = feeds.events_after(spark.read.parquet(log), spark.createDataFrame([("e1", 1)], "exploration_id string, after long"))
    assert sorted(x.event_id for x in after.collect()) == ["c", "d"]


def test_batches_are_handed_on(spark, tmp_path):
    """A step per micro-batch that writes by batch, so that a replay overwrites its own rows."""
    spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string").write.parquet(str(tmp_path / "in"))

    def step(batch, batch_id):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch_id={batch_id}"))

    run(feeds.stream_batches(spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in")), step, str(tmp_path / "check")))
    assert sorted(x.v for x in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_numbers_from_state(spark, tmp_path):
    """Over restarts the stream equals the batch form; events that come again, in one batch or later, are not numbered twice; what was
    written before is not read, so it may go."""
    schema = "exploration_id string, event_id string, ts timestamp"
    batches = [[("e1", "b", 2), ("e1", "a", 1), ("e2", "x", 1), ("e1", "a", 1)], [("e1", "c", 1), ("e1", "a", 1), ("e3", "y", 5)], [("e2", "w", 0), ("e1", "c", 1)]]
    log, all_rows = str(tmp_path / "log"), []
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(e, i, datetime(2024, 1, d + 1)) for e, i, d in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(feeds.stream_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), log, str(tmp_path / "check")))
        got = spark.read.parquet(f"{log}/batch_id={k}").collect()
        all_rows += [(x.exploration_id, x.event_id, x.seq) for x in got]
        shutil.move(f"{log}/batch_id={k}", str(tmp_path / f"away-{k}"))
    assert sorted(all_rows) == [("e1", "a", 1), ("e1", "b", 2), ("e1", "c", 3), ("e2", "w", 2), ("e2", "x", 1), ("e3", "y", 1)]
    once = [df for df in (spark.createDataFrame([(e, i, datetime(2024, 1, d + 1)) for e, i, d in rows], schema).dropDuplicates(["event_id"]) for rows in batches)]
    whole = None
    for k, df in enumerate(once):
        part = feeds.append_events(df, whole, k).select("exploration_id", "event_id", "ts", "seq", "batch_id")
        whole = part if whole is None else whole.unionByName(part)
    assert sorted((x.exploration_id, x.event_id, x.seq) for x in whole.collect()) == sorted(all_rows)


def test_outbox_from_state(spark, tmp_path):
    """Revisions go on over restarts and equal the batch form; what is applied stays so until it changes; pending rows are sent again."""
    schema = "owner_id string, seq long, owner_snapshot string, applied_revision long"
    batches = [[("o1", 1, "poor", None), ("o2", 2, None, None)], [("o1", 3, None, None), ("o1", 4, "rich", None), ("o2", None, None, 1), ("o1", None, None, 2)], [("o3", 5, None, None)]]
    seen = []
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep the query going

    def put(batch, batch_id):
        seen.extend((x.owner_id, x.target_revision, x.owner_snapshot, x.status, x.attempts) for x in batch.collect())

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = feeds.outbox_feed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), retry_ms=500)
        time.sleep(1)
        run(out.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "check")))
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = {x[0]: x[1:] for x in seen}
    assert last["o2"] == (1, None, "applied", 0) and last["o3"][:3] == (1, None, "pending")
    assert last["o1"][:3] == (3, "rich", "pending") and last["o1"][3] >= 1  # an earlier revision was applied: still pending, and sent again
    changes = spark.createDataFrame([r for rows in batches for r in rows if r[3] is None], schema)
    assert {(x.owner_id, x.target_revision, x.owner_snapshot) for x in maintain.coalesce_outbox(changes).collect()} == {(k, x[0], x[1]) for k, x in last.items()}
