"""Latest stage per job from a stream of progress events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Stages after which nothing is expected of a job.
TERMINAL = ("complete", "done", "failed")
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def job_state(events: DataFrame) -> DataFrame:
    """Last event per job by time, and how many there were, of a table."""
    return events.groupBy("job_id").agg(
        F.max_by(F.struct("stage", "ts"), F.struct("ts", "stage")).alias("e"), F.count("*").alias("events")
    ).select("job_id", "e.stage", "e.ts", "events")


def track(events: DataFrame, terminal: tuple[str, ...], keep_seconds: float, idle_seconds: float) -> DataFrame:
    """job_id, life, stage, ts, events of the jobs that a batch changes; state expires.

    State is one row per job, however many events it sends. It leaves the state store
    ``keep_seconds`` after the last event of a finished job and ``idle_seconds`` after that of any
    other, by the clock. No event is dropped for being late: one that comes
    after its job has left opens a new ``life``, named by its batch's time, and counts there.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    given = events.select("job_id", F.col("stage").cast("string").alias("stage"), micros.alias("ts"))
    kind = given.schema["job_id"].dataType
    held = T.StructType().add("life", T.LongType()).add("stage", T.StringType()).add("ts", T.LongType()).add("events", T.LongType())
    out = T.StructType([T.StructField("job_id", kind), *held.fields])

    def order(ts, stage) -> tuple:
        """Nulls come first, as in a sort."""
        return (ts is not None, ts or 0, stage is not None, stage or "")

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        life, stage, ts, n = state.get if state.exists else (state.getCurrentProcessingTimeMs(), None, None, 0)
        for chunk in chunks:
            last = chunk.sort_values(["ts", "stage"], na_position="first").iloc[-1]
            new = (None if pd.isna(last["ts"]) else int(last["ts"]), None if pd.isna(last["stage"]) else str(last["stage"]))
            if n == 0 or order(*new) > order(ts, stage):
                ts, stage = new
            n += len(chunk)
        state.update((life, stage, ts, n))
        state.setTimeoutDuration(max(1, int(1000 * (keep_seconds if stage in terminal else idle_seconds))))
        yield pd.DataFrame({"job_id": [key[0]], "life": [life], "stage": [stage], "ts": pd.array([ts], "Int64"), "events": [n]})

    changed = given.groupBy("job_id").applyInPandasWithState(follow, out, held, "update", GroupStateTimeout.ProcessingTimeTimeout)
    return changed.withColumn("ts", F.timestamp_micros("ts").cast(events.schema["ts"].dataType))


def stream_job_state(
    events: DataFrame, path: str, checkpoint: str, terminal: tuple[str, ...] = TERMINAL,
    keep_seconds: float = 3600, idle_seconds: float = 30 * 86400,
) -> StreamingQuery:
    """Keep the changed jobs of every batch as one folder per batch; expiry as in ``track``.

    A repeated batch overwrites its own folder, so the result is the same after a
    restart. ``current_state`` gives the state over all batches. State expires in batches that
    have events: batches without any would follow each other without end, and are turned off.
    """

    def save(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    spark = events.sparkSession
    empty = spark.conf.get(EMPTY_BATCHES, "true")
    spark.conf.set(EMPTY_BATCHES, "false")
    try:
        # The query keeps a copy of the settings it starts with.
        return (
            track(events, terminal, keep_seconds, idle_seconds).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start())
    finally:
        spark.conf.set(EMPTY_BATCHES, empty)


def current_state(history: DataFrame) -> DataFrame:
    """The last row of each life, and of these the latest event and the sum of events per job."""
    lives = history.groupBy("job_id", "life").agg(F.max_by(F.struct("stage", "ts", "events"), F.col("batch")).alias("s"))
    return lives.groupBy("job_id").agg(
        F.max_by(F.struct("s.stage", "s.ts"), F.struct("s.ts", "s.stage")).alias("e"), F.sum("s.events").alias("events")
    ).select("job_id", "e.stage", "e.ts", "events")
