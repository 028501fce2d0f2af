"""Stateful streams with timers: leased deliveries, claims, rate limits and acquisitions that late granules correct.

State lies in RocksDB by key and goes by timer: a key that nothing is due for has no state. Timers run on event time,
as the watermark passes them, so a stream that is started again from its checkpoint goes on where it was, and gives what
it would have given. Rows of one key in one batch are taken in the order of their times.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from verdara.session import ship

MAX_DEQUEUE = 3  # fixed value: deliveries of a message before it is poison
HOUR = 3_600_000
EPOCH = datetime(1970, 1, 1)


def _ms(at: datetime) -> int:
    """Milliseconds of a naive time, which is UTC, or of one with a zone."""
    return round((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def _us(at: datetime) -> int:
    """Microseconds, likewise."""
    return ((at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at) - EPOCH) // timedelta(microseconds=1)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


def _in_order(rows: Iterator[Row], name: str) -> list[Row]:
    return sorted(rows, key=lambda r: r[name])


class _Timed(StatefulProcessor):
    """A processor with one timer a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def due(self, at: int | None) -> None:
        """The key's timer is at this time, or there is none."""
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other[0] if isinstance(other, tuple) else other)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Leases(_Timed):
    """Deliveries of messages: a lease that isn't ended by `done` in time expires, and the message is delivered again."""

    def __init__(self, lease_s: int, most: int) -> None:
        self.lease, self.most = lease_s * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "analysis_id string, deliveries long, until long")

    def deliver(self, key, analysis: str | None, nth: int, at: int) -> Row:
        poison = not analysis or nth > self.most
        if poison:
            self.held.clear()
        else:
            self.held.update((analysis, nth, at + self.lease))
        self.due(None if poison else at + self.lease)
        return Row(message_id=key[0], analysis_id=analysis, delivery=nth, at=_at(at), poison=poison)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in _in_order(rows, "at"):
            at = _ms(row["at"])
            if row["event"] == "sent" and not self.held.exists():
                yield self.deliver(key, row["analysis_id"], 1, at)
            elif row["event"] == "done" and self.held.exists() and at <= self.held.get()[2]:
                self.held.clear()
                self.due(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            analysis, nth, until = self.held.get()
            yield self.deliver(key, analysis, nth + 1, until)


def deliveries(events: DataFrame, lease_s: int = 1800, most: int = MAX_DEQUEUE, late: str = "10 minutes") -> DataFrame:
    """(message_id, analysis_id, delivery, at, poison) of a stream of (message_id, analysis_id, at, event).

    `sent` is delivered at once and leased; `done` within the lease ends it; an expired lease is a delivery more, at the
    time it expired. One without an analysis, or beyond `most` deliveries, is poison and is forgotten. A `done` that
    comes when the lease is over is of no account, and a message that is sent while it is held is the same one.
    """
    made = "message_id string, analysis_id string, delivery long, at timestamp, poison boolean"
    return _stateful(events.withWatermark("at", late), ["message_id"], Leases(lease_s, most), made)


def route(found: DataFrame, good_path: str, poison_path: str, checkpoint: str):
    """Start a query that writes deliveries to one folder and poison to the other, once for what is there now.

    A batch that is run again overwrites its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where("not poison").drop("poison").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        batch.where("poison").drop("poison").write.mode("overwrite").parquet(f"{poison_path}/batch={batch_id}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Claims(_Timed):
    def __init__(self, stale_ms: int, keep_ms: int) -> None:
        self.stale, self.keep = stale_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "status string, since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, since = self.job.get() if self.job.exists() else ("queued", 0)
        for row in _in_order(rows, "at"):
            at = _ms(row["at"])
            if row["event"] == "done":
                status, since = "done", at
            elif row["event"] == "claim":
                free = status == "queued" or status == "running" and since < at - self.stale
                if free:
                    status, since = "running", at
                yield Row(analysis_id=key[0], at=row["at"], granted=free)
        if status != "queued":
            self.job.update((status, since))
            self.due(since + (self.stale if status == "running" else self.keep) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.job.clear()  # stale, so it may be claimed again; or done so long ago that nobody asks
        return iter(())


def claims(attempts: DataFrame, stale_hours: int = 2, keep_hours: int = 24 * 30, late: str = "1 hour") -> DataFrame:
    """analysis_id, at, granted for a stream of (analysis_id, at, event): `claim` is granted when the analysis isn't
    running, or has been since before the stale limit; `done` ends it, and is remembered for `keep_hours`. Of claims
    that race one is granted. A claim that is stale goes by timer."""
    return _stateful(attempts.withWatermark("at", late), ["analysis_id"], Claims(stale_hours * HOUR, keep_hours * HOUR), "analysis_id string, at timestamp, granted boolean")


class Limiter(_Timed):
    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.window = limit, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = [t[0] for t in self.times.get()] if self.times.exists() else []
        for row in _in_order(rows, "ts"):
            at = _ms(row["ts"])
            times = [t for t in times if t >= at - self.window]
            accepted = len(times) < self.limit
            if accepted:
                times.append(at)
            yield Row(client=key[0], ts=row["ts"], accepted=accepted)
        self.times.put([(t,) for t in times])
        self.due(times[-1] + self.window + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.times.clear()
        return iter(())


def rate_limited(events: DataFrame, limit: int, seconds: int = 3600) -> DataFrame:
    """client, ts, accepted: at most `limit` (one or more) accepted events in any window before an event; refused ones
    don't count. A client's accepted times are forgotten once the last is a window old."""
    return _stateful(events.withWatermark("ts", f"{seconds} seconds"), ["client"], Limiter(limit, seconds), "client string, ts timestamp, accepted boolean")


class Acquisitions(_Timed):
    """The granules of an acquisition; each batch that brings new ones gives the whole acquisition, corrected."""

    def __init__(self, keep_ms: int) -> None:
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.items = handle.getListState("items", "item_id string, us long, cloud double")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # The state is read once and written once a batch: a call for each granule costs more than all else.
        known = {item: (us, cloud) for item, us, cloud in self.items.get()} if self.items.exists() else {}
        fresh = {}
        for row in rows:
            if row["item_id"] not in known:
                fresh.setdefault(row["item_id"], (_us(row["ts"]), row["cloud"]))
        if not fresh:
            return
        self.items.appendList([(item, *told) for item, told in fresh.items()])
        n = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((n,))
        held = sorted(((item, *told) for item, told in (known | fresh).items()), key=lambda g: g[0])
        clouds = [c for _, _, c in held if c is not None]
        self.due(round(max(t for _, t, _ in held) / 1000) + self.keep)
        yield Row(
            acquisition_key=key[0], version=n, granule_count=len(held), observed_at=EPOCH + timedelta(microseconds=min(t for _, t, _ in held)), item_ids=[i for i, _, _ in held], least_cloud=min(clouds, default=None),
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.items.clear()
        self.version.clear()
        return iter(())


CORRECTED = "acquisition_key string, version long, granule_count long, observed_at timestamp, item_ids array<string>, least_cloud double"


def corrected(granules: DataFrame, keep_days: int = 30) -> DataFrame:
    """Acquisitions of a stream of (acquisition_key, item_id, ts, cloud), again with a higher version whenever granules come late.

    An acquisition stays open for `keep_days` of event time after its last granule. A granule that comes twice is one;
    one that comes later than that is dropped as late, so `keep_days` is to exceed the catalogue's delay.
    """
    return _stateful(granules.withWatermark("ts", f"{keep_days} days"), ["acquisition_key"], Acquisitions(keep_days * 24 * HOUR), CORRECTED)


def publish(corrections: DataFrame, path: str, checkpoint: str):
    """Start a query that appends corrections by batch, once for what is there now; `series` reads them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return corrections.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def series(published: DataFrame) -> DataFrame:
    """The acquisitions as they stand: of each key the row of the highest version."""
    names = [c for c in published.columns if c not in ("acquisition_key", "batch")]
    return published.groupBy("acquisition_key").agg(F.max_by(F.struct(*names), "version").alias("r")).select("acquisition_key", "r.*")


def _stateful(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")
