"""Streaming forms (T1-T6): keyed state where a number or a revision goes on, else the batch operator on each micro-batch, written
idempotently by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from memloom.streaming.state import OUTBOX, OrderedLog, OutboxState


def stream_admit(stream: DataFrame, horizon: str | None = None, time_col: str = "ts") -> DataFrame:
    """T1. Documents whose content hash is new. With a horizon, hashes are forgotten that long after; without, state grows with the documents."""
    rows = stream.withColumn("content_hash", F.md5("content"))
    if horizon:
        return rows.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(["content_hash"])
    return rows.dropDuplicates(["content_hash"])


def stream_outbox(changes: DataFrame) -> DataFrame:
    """T2. (owner_id, target_revision, last_seq, owner_snapshot), growing with each change; update or complete mode. Equals the
    batch form: the latest richest snapshot counts."""
    rich = F.struct(F.col("owner_snapshot").isNotNull(), "seq")
    return changes.groupBy("owner_id").agg(F.count("*").alias("target_revision"), F.max("seq").alias("last_seq"), F.max_by("owner_snapshot", rich).alias("owner_snapshot"))


def append_events(batch: DataFrame, log: DataFrame | None, batch_id: int) -> DataFrame:
    """T3. Events with a seq that goes on without gaps after each exploration's last one; a batch seen before adds nothing (T5)."""
    if log is not None:
        batch = batch.join(log.select("event_id"), "event_id", "left_anti")
        last = log.groupBy("exploration_id").agg(F.max("seq").alias("_last"))
        batch = batch.join(last, "exploration_id", "left")
    else:
        batch = batch.withColumn("_last", F.lit(None).cast("long"))
    n = F.row_number().over(W.partitionBy("exploration_id").orderBy("ts", "event_id"))
    return batch.withColumn("seq", F.coalesce("_last", F.lit(0)) + n).drop("_last").withColumn("batch_id", F.lit(batch_id))


def events_after(log: DataFrame, cursor: DataFrame) -> DataFrame:
    """T3. Events after each exploration's cursor (exploration_id, after)."""
    return log.join(cursor, "exploration_id").filter("seq > after").drop("after")


LOG = "exploration_id string, event_id string, ts timestamp, seq long, batch_id long"


def append_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """T3, T5. One batch's part of the ordered log at path, without a stream's state. Only the explorations of the batch are looked up in earlier parts;
    a batch that is replayed overwrites its own part."""
    spark = batch.sparkSession
    batch.limit(0).select("exploration_id", "event_id", "ts", F.lit(0).cast("long").alias("seq")).write.mode("append").parquet(f"{path}/batch_id=-1")  # the log exists from here on
    log = spark.read.schema(LOG).parquet(path).filter(F.col("batch_id") < batch_id)
    mine = log.join(batch.select("exploration_id").distinct(), "exploration_id", "left_semi")
    rows = append_events(batch, mine, batch_id).select("exploration_id", "event_id", "ts", F.col("seq").cast("long").alias("seq"))
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store, which keeps state on disk and writes its changes to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def numbered_events(stream: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """T3, T5. Events (exploration_id, event_id, ts) with seq, from 1 and without gaps in each exploration, from keyed state: the last seq,
    and the events seen, which are forgotten forget_ms after they came (None: never). An event that comes again is
    left out. Nothing of the log is read. With forget_ms Spark goes on with batches without data, as for all timers. A trigger's events of one exploration are ordered in one task, by (ts, event_id)."""
    keyed_state(stream.sparkSession)
    rows = stream.select("exploration_id", "event_id", "ts").groupBy("exploration_id")
    return rows.transformWithStateInPandas(OrderedLog(forget_ms), "exploration_id string, event_id string, ts timestamp, seq long", "Append", "None" if forget_ms is None else "ProcessingTime")


def outbox_feed(changes: DataFrame, retry_ms: int | None = None) -> DataFrame:
    """T2. The outbox's rows as they change, from keyed state: (owner_id, target_revision, last_seq, owner_snapshot, status, attempts).

    changes: (owner_id, seq, owner_snapshot, applied_revision). A change raises the revision and is pending again; the richest
    snapshot of the latest seq stays. A row with applied_revision says that the target has got that far: if it is the
    present revision, the owner is applied, an earlier one changes nothing. What is still pending retry_ms later is sent again, with one
    attempt more. Equals `coalesce_outbox` over all changes. Update mode: the last row of an owner holds."""
    keyed_state(changes.sparkSession)
    rows = changes.select("owner_id", "seq", "owner_snapshot", "applied_revision").groupBy("owner_id")
    return rows.transformWithStateInPandas(OutboxState(retry_ms), f"owner_id string, {OUTBOX}", "Update", "None" if retry_ms is None else "ProcessingTime")


def stream_events(stream: DataFrame, path: str, checkpoint: str, forget_ms: int | None = None) -> DataStreamWriter:
    """T3. A writer of the ordered log at path: events (exploration_id, event_id, ts), numbered by keyed state. A batch that is replayed
    overwrites its own part."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return numbered_events(stream, forget_ms).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)


def stream_batches(stream: DataFrame, step, checkpoint: str) -> DataStreamWriter:  # noqa: ANN001
    """T4, T6. A writer that hands each micro-batch to step(batch, batch_id), such as apply_evolution or assign_provisional."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
