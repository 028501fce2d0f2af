"""Streaming forms: queue intake with a dead-letter branch, exact rate limiting of tables, late-tolerant grouping. What needs timers is in `state`.

Offsets are committed after the sink's success, so a message is deleted only once it is durable; a batch
that is run again overwrites its own output by batch id.
"""

from __future__ import annotations

import threading
import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "analysis_id string, enqueued_at timestamp"


def parse_messages(raw: DataFrame) -> DataFrame:
    """(value) to analysis_id, enqueued_at, poison; malformed JSON and empty ids are poison."""
    out = raw.select("value", F.from_json("value", MESSAGE).alias("m")).select("value", "m.analysis_id", "m.enqueued_at")
    return out.withColumn("poison", F.coalesce(F.length("analysis_id"), F.lit(0)) == 0)


def intake(raw: DataFrame, good_path: str, poison_path: str, checkpoint: str):
    """Start a query that writes good messages and poison to two folders, once for what is there now."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_messages(batch)
        parsed.where("not poison").drop("value", "poison").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        parsed.where("poison").select("value").write.mode("overwrite").parquet(f"{poison_path}/batch={batch_id}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MAX_DEQUEUE = 3  # fixed value: deliveries of a message before it is poison


def _accepted(times: deque[float], at: float, limit: int, seconds: int) -> bool:
    """Whether an event at `at` is within the limit; `times`, the accepted ones of its window, is brought up to date.

    An accepted event counts until it is more than `seconds` old.
    """
    while times and times[0] < at - seconds:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(at)
    return True


def _forget_after(state: GroupState, last: pd.Timestamp, seconds: int) -> None:
    """Let a key's state go once the watermark is `seconds` past its last event."""
    state.setTimeoutTimestamp(max(int((last.timestamp() + seconds) * 1000), state.getCurrentWatermarkMs() + 1))


def rate_limited_batch(events: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """`state.rate_limited` over a stored table (client, ts, id): adds accepted. Whether an event counts depends on those before
    it, so a client's events are walked in order, streamed a batch at a time, with `limit` times kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, times = object(), deque()
        for frame in frames:
            out = []
            for c, t in zip(frame["client"], frame["us"], strict=True):
                if c != client:
                    client, times = c, deque()
                out.append(_accepted(times, t / 1e6, limit, seconds))
            yield frame.drop(columns="us").assign(accepted=out)

    ordered = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).repartition("client").sortWithinPartitions("client", "us", "id")
    kept = ordered.drop("us")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", accepted boolean"
    return ordered.select(*kept.columns, "us").mapInPandas(run, schema)


def delivered(messages: DataFrame) -> DataFrame:
    """Adds poison and delay_s to deliveries (message_id, analysis_id, dequeue_count, enqueued_at, received_at): a
    message without an id, or delivered more than MAX_DEQUEUE times, is poison."""
    poison = (F.coalesce(F.length("analysis_id"), F.lit(0)) == 0) | (F.col("dequeue_count") > MAX_DEQUEUE)
    waited = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("enqueued_at").cast("timestamp"))) / 1e6
    return messages.withColumns({"poison": poison, "delay_s": F.greatest(waited, F.lit(0.0))})


def counted(messages: DataFrame) -> DataFrame:
    """A stream's deliveries (message_id, analysis_id, enqueued_at, received_at) with dequeue_count, for `delivered`.

    State: one number a message, forgotten a day after its last delivery.
    """
    names = "message_id string, analysis_id string, enqueued_at timestamp, received_at timestamp, dequeue_count long"

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("received_at")
        rows["dequeue_count"] = range(seen + 1, seen + 1 + len(rows))
        state.update((seen + len(rows),))
        _forget_after(state, rows["received_at"].iloc[-1], 86_400)
        yield rows[["message_id", "analysis_id", "enqueued_at", "received_at", "dequeue_count"]]

    known = messages.withWatermark("received_at", "1 day")
    return known.groupBy("message_id").applyInPandasWithState(step, names, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def requeued(jobs: DataFrame, now, stale_hours: int = 2) -> DataFrame:
    """Jobs as they are after an operator's requeue: those that are running and not stale, or have succeeded, are
    refused and stay as they are."""
    stale = F.col("started_at") < now - F.expr(f"INTERVAL {stale_hours} HOURS")
    refused = F.when((F.col("status") == "running") & ~F.coalesce(stale, F.lit(False)), "running").when(F.col("status") == "succeeded", "succeeded")
    kept = lambda name, new: F.when(refused.isNull(), new).otherwise(F.col(name))
    made = {"refused": refused, "status": kept("status", F.lit("queued")), "failure_category": kept("failure_category", F.lit(None)), "retry_count": kept("retry_count", F.col("retry_count") + 1)}
    return jobs.withColumns(made)


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """A time limit on the Spark jobs that this thread starts inside: those under way when it passes are cancelled,
    as are later ones, and TimeoutError is raised, which `process.failure_category` calls a timeout."""
    context, group, over = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        over.set()
        context._jsc.sc().cancelJobGroupAndFutureJobs(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, f"at most {seconds:g} s", True)
    timer.start()
    try:
        yield
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"the jobs took more than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)
    if over.is_set():
        raise TimeoutError(f"the jobs took more than {seconds:g} s")


def job_metrics(runs: DataFrame, bins: int = 10) -> DataFrame:
    """One row: runs that succeeded and failed, and histograms of (seconds, delay_s), from (status, seconds, delay_s)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.agg(count("succeeded"), count("failed"), *[F.histogram_numeric(c, F.lit(bins)).alias(f"{c}_histogram") for c in ("seconds", "delay_s")])


def group_stream(granules: DataFrame, late: str = "1 hour") -> DataFrame:
    """Acquisitions from (item_id, platform, orbit, ts): closed once the watermark passes their minute."""
    return granules.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "platform", "orbit").agg(F.count("*").alias("granule_count"), F.min("ts").alias("observed_at"))


def may_claim(now, stale_hours: int = 2):
    """Queued, or running since before the stale limit."""
    return (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {stale_hours} HOURS")))


def claimable(jobs: DataFrame, now, stale_hours: int = 2) -> DataFrame:
    """Jobs that may be claimed."""
    return jobs.where(may_claim(now, stale_hours))
