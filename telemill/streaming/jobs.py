"""Continuous jobs: files of exports arrive, events are stored once, and what they touch is recomputed.

A watermark would drop late rows, so only the live view, the exact dedup window
and session lifecycles use one; tables that have to be right come from
recomputation of the touched days in ``foreachBatch``, from their folders alone.
"""

from __future__ import annotations

import bisect
import itertools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from telemill.operators import explorer, filters, ingest
from telemill.sources import days

DEDUP_WINDOW = "7 days"
IDLE = "15 minutes"
HOUR = 3_600_000_000
BLOCK = 512  # samples of a series that are one value of state, about
LEDGER_MONTH, ROLLUP_MONTH = "seen_month", "bucket_month"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicated(events: DataFrame, window: str = DEDUP_WINDOW) -> DataFrame:
    """A stream of events without repeats of a key inside the window of their receipt."""
    return events.withWatermark("ingested_at", window).dropDuplicatesWithinWatermark(["dedup_key"])


def live_hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A live view of hours by vendor and kind; rows later than ``late`` are left to the recomputed table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "vendor", "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "vendor", "kind", "n")


def sessions_by_gap(events: DataFrame, gap: str = IDLE, late: str = "1 hour") -> DataFrame:
    """Stretches of activity of each session, closed after an idle gap."""
    return events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "n")


class Lifecycle(StatefulProcessor):
    """A session's status: active until an end or an idle time; a late end makes an abandoned one ended."""

    def __init__(self, idle_ms: int = 15 * 60 * 1000):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "started boolean, ended boolean, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, ended, last = self.state.get() if self.state.exists() else (False, False, 0)
        for pdf in rows:
            started |= bool((pdf["kind"] == "session.start").any())
            ended |= bool((pdf["kind"] == "session.end").any())
            last = max(last, int(pdf["ts"].astype("datetime64[ms]").astype("int64").max()))
        self.state.update((started, ended, last))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not ended:
            self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, "ended" if ended else "active" if started else "unknown", last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, ended, last = self.state.get()
        if not ended:
            yield self._row(key, "abandoned", last)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, status: str, last: int) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "status": [status], "last_event_at": [pd.Timestamp(last, unit="ms")]})


def lifecycle(events: DataFrame, idle_ms: int = 15 * 60 * 1000, late: str = "1 hour") -> DataFrame:
    """Changes of session status, with timers for idle ones; needs the RocksDB state store."""
    rows = events.withWatermark("ts", late).select("session_id", "kind", "ts")
    return rows.groupBy("session_id").transformWithStateInPandas(Lifecycle(idle_ms), "session_id string, status string, last_event_at timestamp", "update", "eventTime")


class Counters(StatefulProcessor):
    """Differences of a cumulative series to the value before, in order of time; a fall counts whole.

    The samples of ``horizon_ms`` before the newest one are kept, in blocks of
    some hours of up to ``BLOCK`` samples, so that a batch reads and writes a value
    for many samples and only those blocks that it touches.  A late one is put in
    its place, and the difference of the one after it is given out again with what
    it was before and a higher revision.  Of older samples the last stays; one
    that is older still has no difference (revision -1).
    """

    def __init__(self, horizon_ms: int = 7 * 24 * 3_600_000):
        self.horizon = horizon_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "blocks string, floor long")
        self.samples = handle.getMapState("samples", "block long", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, floor = self.index.get() if self.index.exists() else ("[[], 0]", None)
        blocks, fresh = json.loads(text)  # [number, its hours] of each block in order, and the next number
        stored, held = {n for n, _ in blocks}, {}

        def of(n: int) -> list[list]:
            """[time, key, value, difference, revision] of the samples of a block, in order."""
            if n not in held:
                held[n] = json.loads(self.samples.getValue((n,))[0]) if n in stored else []
            return held[n]

        out, new = [], []
        for pdf in rows:
            for at, value, dedup_key in zip(pdf["at"].tolist(), pdf["value"].tolist(), pdf["dedup_key"].tolist()):
                if floor is not None and at <= floor:
                    out.append((at, dedup_key, value, None, None, -1))
                else:
                    new.append([at, dedup_key, value, None, -1])
        if new and not blocks:
            blocks, fresh = [[fresh, []]], fresh + 1
        starts, coming = [hours[0] for _, hours in blocks[1:]], {}
        for x in new:
            coming.setdefault(bisect.bisect_right(starts, x[0] // HOUR), []).append(x)
        changed = set()
        for k in sorted(coming, reverse=True):  # from the last one, as a block that is cut moves those after it
            n, hours = blocks[k]
            own = of(n)
            there = {(x[0], x[1]) for x in own}
            for x in coming[k]:
                if (x[0], x[1]) not in there:  # else the same sample again
                    there.add((x[0], x[1]))
                    own.append(x)
            own.sort(key=lambda x: x[:2])
            pieces = [[]]
            for _, some in itertools.groupby(own, key=lambda x: x[0] // HOUR):
                if len(own) > BLOCK and len(pieces[-1]) >= BLOCK // 2:
                    pieces.append([])
                pieces[-1].extend(some)
            numbers = [n, *range(fresh, fresh + len(pieces) - 1)]
            fresh += len(pieces) - 1
            blocks[k : k + 1] = [[m, sorted({x[0] // HOUR for x in piece})] for m, piece in zip(numbers, pieces)]
            held.update(zip(numbers, pieces))
            changed |= set(numbers)
        touched = set(changed)
        for k, (n, _) in enumerate(blocks):
            if n not in touched and not (k and blocks[k - 1][0] in touched):
                continue
            some = of(n) if n in touched else of(n)[:1]
            last = of(blocks[k - 1][0])[-1][2] if k else None
            if not k and floor is not None:  # what was before the first one is forgotten, so its difference stands
                last, some = some[0][2], some[1:]
            for x in some:
                delta = x[2] if last is None or x[2] < last else x[2] - last
                if x[4] < 0 or delta != x[3]:
                    out.append((x[0], x[1], x[2], delta, x[3], x[4] + 1))
                    x[3], x[4] = delta, x[4] + 1
                    changed.add(n)
                last = x[2]
        every = [h for _, hours in blocks for h in hours]
        oldest, gone = (every[-1] * HOUR - self.horizon) // HOUR if every else 0, 0
        while gone + 1 < len(every) and every[gone + 1] <= oldest:  # the hour after it is old as well, so nothing before that is needed
            gone += 1
        if gone:
            first = every[gone]
            while blocks[0][1][-1] < first:
                n, _ = blocks.pop(0)
                changed.discard(n)
                if n in stored:
                    self.samples.removeKey((n,))
            n, hours = blocks[0]
            if hours[0] < first:
                blocks[0][1], held[n] = [h for h in hours if h >= first], [x for x in of(n) if x[0] // HOUR >= first]
                changed.add(n)
            floor = of(n)[0][0]
        for n in changed:
            self.samples.updateValue((n,), (json.dumps(held[n]),))
        self.index.update((json.dumps([blocks, fresh]), floor))
        if out:
            given = pd.DataFrame(out, columns=["ts", "dedup_key", "value", "delta", "retracts", "revision"])
            given["ts"] = pd.to_datetime(given["ts"], unit="us")
            given.insert(0, "series_hash", key[0])
            yield given

    def close(self) -> None:
        pass


def counter_deltas(samples: DataFrame, horizon_ms: int = 7 * 24 * 3_600_000) -> DataFrame:
    """Differences of the cumulative series of a stream, whatever the order of arrival; needs the RocksDB state store.

    A row says that a sample's difference is ``delta`` and no longer ``retracts``:
    sums over all rows of delta - retracts are right at any time, and the highest
    revision of a sample is its difference (:func:`latest_deltas`).
    """
    rows = samples.where(F.col("temporality") == "cumulative").select("series_hash", F.unix_micros("ts").alias("at"), "value", "dedup_key")
    return rows.groupBy("series_hash").transformWithStateInPandas(Counters(horizon_ms), "series_hash string, ts timestamp, dedup_key string, value double, delta double, retracts double, revision int", "append", "none")


def latest_deltas(changes: DataFrame) -> DataFrame:
    """One row per sample of :func:`counter_deltas`, as it stands now."""
    return changes.groupBy("series_hash", "ts", "dedup_key").agg(F.max_by("value", "revision").alias("value"), F.max_by("delta", "revision").alias("delta"))


def store_batch(path: str, spark: SparkSession, window_days: int = 7) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores each micro-batch's new events once: by key within the batch and against the ledger.

    The ledger holds the keys of stored events by day of their receipt; only the
    days from ``window_days`` before the batch's receipts are listed and read, so
    its cost does not grow with history.  A batch has folders of its own, which a
    retry replaces; so a batch that is repeated after a failure leaves the same
    tables.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = ingest.first_of_key(batch).persist()
        received = days.of(rows, "ingested_at")
        known = days.read(spark, ledger_of(path), days.with_neighbours(received, window_days, 0), LEDGER_MONTH)
        new = rows
        if known is not None:
            new = rows.join(known.where(F.col("batch") < batch_id).select("dedup_key"), "dedup_key", "left_anti").select(*batch.columns)
        days.write(new, path, batch_id)
        days.write(new.select("dedup_key", F.col("ingested_at").alias("first_seen_at")), ledger_of(path), batch_id, LEDGER_MONTH, "first_seen_at")
        rows.unpersist()

    return write


def ledger_of(path: str) -> str:
    """Where :func:`store_batch` keeps the keys of the events that it stores at ``path``."""
    return f"{path.rstrip('/')}-ledger"


def heal(spark: SparkSession, events_path: str, fold: Callable[[DataFrame], DataFrame], rollup_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that recomputes, in full, every day that a batch touches, and replaces it.

    fold: events of whole hours to rollup rows.  Late rows change old hours as
    well as new ones: nothing is dropped for its age.  Only the folders of the
    touched days are read.  For a capped, shared backlog see
    :mod:`telemill.streaming.rollup_queue`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        touched = days.of(batch)
        stored = days.read(spark, events_path, touched)
        if stored is not None:
            days.replace(fold(stored.drop("batch")), rollup_path, touched, ROLLUP_MONTH, "bucket")

    return write


def live_feed(events: DataFrame, path: str, checkpoint: str, projects: DataFrame | None = None) -> StreamingQuery:
    """Persisted events, of all sessions or of those in ``projects``, by day for readers to follow; the checkpoint is where a restart resumes."""
    rows = events if projects is None else events.join(F.broadcast(projects), "session_id", "left_semi")
    return rows.withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, path: str, position: tuple | None = None, session_id: str | None = None, limit: int = 2000) -> DataFrame:
    """The next events of a feed after (ts, seq), in that order, of one session or of all; the last row is the position to resume from."""
    rows = spark.read.parquet(path)
    if position is not None:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(position[0])))
    rows = explorer.event_scan(rows.drop("day"), position)
    return filters.apply(rows, filters.equals("session_id", session_id)).orderBy("ts", "seq").limit(limit)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run all that is there through a ``foreachBatch`` function, and stop."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
