"""A durable queue of dirty hours, and the job that works it off.

Folders under one path:

``marks/batch=N``    (bucket, source) that batch N made dirty; a retry replaces its folder
``done/pass=P``      (bucket, source, upto): marks of batches up to ``upto`` are worked off
``lease``            who works, and until when

An hour is dirty if a mark of it is of a later batch than all that is done of it.
So a mark that arrives while a pass runs stays, and a pass that fails before its
``done`` is written is repeated in full, over the same or newer data.  Hours are
recomputed from all of their rows and replaced whole, which any number of times
gives the same rollup.

One pass at a time: the lease is a file that only one writer can create.  A pass
that finds it taken does nothing; a lease that has run out is taken over.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators import rollups
from telemill.sources import days, folders, tables

MOST = 200  # dirty hours of a pass
LEASE_SECONDS = 600
FOLDERS = 64  # of marks, after which they are put together
BUCKET = "bucket timestamp, source string"
HOUR_TEXT = "yyyy-MM-dd HH:00:00"


@dataclass
class Pass:
    """What a pass did: hours claimed from the queue, hours recomputed, and whether another one was at work."""

    claimed: int = 0
    recomputed: int = 0
    busy: bool = False


class Queue:
    """The dirty hours at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def mark(self, dirty: DataFrame, batch_id: int) -> None:
        """Mark the (bucket, source) rows of ``dirty`` for a batch; batches count upwards."""
        dirty.select("bucket", "source").distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch_id}")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not folders.children(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def pending(self) -> DataFrame:
        """(bucket, source, upto) of the dirty hours, with the last batch that marked each."""
        marked = self._table("marks", f"{BUCKET}, batch long").groupBy("bucket", "source").agg(F.max("batch").alias("upto"))
        done = self._table("done", f"{BUCKET}, upto long").groupBy("bucket", "source").agg(F.max("upto").alias("done"))
        return marked.join(done, ["bucket", "source"], "left").where(F.col("done").isNull() | (F.col("upto") > F.col("done"))).drop("done")

    def claim(self, most: int) -> list[tuple[str, str, int]]:
        """The oldest ``most`` dirty hours, as texts in the session's time zone."""
        oldest = self.pending().orderBy("bucket", "source").limit(most)
        return [tuple(r) for r in oldest.select(F.date_format("bucket", HOUR_TEXT), "source", "upto").collect()]

    def clear(self, claimed: list[tuple[str, str, int]], name: str) -> None:
        """Note that the marks of ``claimed`` are worked off; later marks of the same hours stay."""
        if claimed:
            rows = self.spark.createDataFrame(claimed, "bucket string, source string, upto long")
            rows.withColumn("bucket", F.to_timestamp("bucket")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/pass={name}")

    def settle(self) -> None:
        """Put marks and notes together when there are many folders of marks.

        Under the lease.  Broken off, it leaves marks or notes twice, which changes
        nothing that is pending.
        """
        names = [n for n in folders.children(self.spark, f"{self.path}/marks") if n.startswith("batch=")]
        if len(names) <= FOLDERS:
            return
        last = max(int(n.partition("=")[2]) for n in names)
        # they become marks of the batch before the last one, as the last one may still be written again by a retry
        kept = tables.staged(self.pending().where(F.col("upto") < last).select("bucket", "source"), "settled-marks")
        kept.coalesce(1).write.mode("append").parquet(f"{self.path}/marks/batch={last - 1}")
        for n in names:
            if int(n.partition("=")[2]) < last - 1:
                folders.delete(self.spark, f"{self.path}/marks/{n}")
        notes = folders.children(self.spark, f"{self.path}/done")
        if notes:
            marked = self._table("marks", f"{BUCKET}, batch long").select("bucket", "source").distinct()
            done = self._table("done", f"{BUCKET}, upto long").groupBy("bucket", "source").agg(F.max("upto").alias("upto"))
            tables.staged(done.join(marked, ["bucket", "source"], "left_semi"), "settled-notes").coalesce(1).write.parquet(f"{self.path}/done/pass={uuid.uuid4().hex}")
            for n in notes:
                folders.delete(self.spark, f"{self.path}/done/{n}")

    def lease(self, seconds: float = LEASE_SECONDS, now: float | None = None) -> str | None:
        """A token if this caller may work now."""
        now = time.time() if now is None else now
        token = uuid.uuid4().hex
        text = json.dumps({"token": token, "until": now + seconds})
        file = f"{self.path}/lease"
        if folders.create(self.spark, file, text):
            return token
        held = folders.text_of(self.spark, file)
        try:
            over = held is not None and json.loads(held)["until"] < now
        except ValueError:
            over = False  # being written
        if not over:
            return None
        # of several that find it run out, the one that can take the file away goes on
        aside = f"{self.path}/lease-{token}"
        try:
            folders.rename(self.spark, file, aside)
        except OSError:
            return None
        folders.delete(self.spark, aside)
        return token if folders.create(self.spark, file, text) else None

    def release(self, token: str) -> None:
        held = folders.text_of(self.spark, f"{self.path}/lease")
        if held is not None and json.loads(held)["token"] == token:
            folders.delete(self.spark, f"{self.path}/lease")


def work(
    queue: Queue,
    folds: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame]]],
    rollup_path: str,
    now: datetime,
    most: int = MOST,
    seconds: float = LEASE_SECONDS,
    daily_path: str | None = None,
    daily: Callable[[DataFrame], DataFrame] = rollups.daily,
) -> Pass:
    """One pass: claim the oldest dirty hours and the current and previous one, recompute them, replace them, clear them.

    folds: for each source the path of its day table, the name of that table's
    month column, and a function of the rows of whole hours to rollup rows with
    ``bucket``.  ``now`` is in the session's time zone.  Hours whose month the
    table does not have any more are left as they are: their raw rows have
    expired, and the rollup is all that is left.  With ``daily_path`` the days of
    the recomputed hours are derived again from their stored hours, by ``daily``.
    """
    spark = queue.spark
    token = queue.lease(seconds)
    if token is None:
        return Pass(busy=True)
    try:
        claimed = queue.claim(most)
        recent = [f"{now - timedelta(hours=k):%Y-%m-%d %H}:00:00" for k in (0, 1)]
        recomputed = 0
        for source, (path, month, fold) in folds.items():
            there = set(days.months(spark, path, month))
            own = sorted({b for b, s, _ in claimed if s == source} | set(recent))
            own = [b for b in own if b[:7] in there]
            if own:
                recompute(spark, source, own, path, month, fold, rollup_path)
                if daily_path is not None:
                    derive_days(spark, source, sorted({b[:10] for b in own}), rollup_path, daily_path, daily)
                recomputed += len(own)
        queue.clear(claimed, token)
        queue.settle()
        return Pass(len(claimed), recomputed)
    finally:
        queue.release(token)


def recompute(spark: SparkSession, source: str, hours: list[str], path: str, month: str, fold: Callable[[DataFrame], DataFrame], rollup_path: str) -> None:
    """Replace ``hours`` (at most some hundreds) of one source in the rollup at ``rollup_path``/source=…; only their days' folders are read."""
    some = sorted({h[:10] for h in hours})
    claimed = spark.createDataFrame([(h,) for h in hours], "bucket string").select(F.to_timestamp("bucket").alias("bucket"))
    raw = days.read(spark, path, some, month)
    target = f"{rollup_path}/source={source}"
    before = days.read(spark, target, some, "bucket_month")
    if raw is not None:
        near = raw.drop("batch").join(F.broadcast(claimed.select(F.col("bucket").alias("__b"))), rollups.hour("ts") == F.col("__b"), "left_semi")
        fresh = fold(near).drop("source").join(F.broadcast(claimed), "bucket", "left_semi")
    elif before is not None:
        fresh = before.limit(0)
    else:
        return
    if before is not None:
        fresh = before.join(F.broadcast(claimed), "bucket", "left_anti").unionByName(fresh)
    days.replace(fresh, target, some, "bucket_month", "bucket")


def derive_days(spark: SparkSession, source: str, some: list[str], rollup_path: str, daily_path: str, daily: Callable[[DataFrame], DataFrame]) -> None:
    """Replace ``some`` days of one source by what their hours add up to; days without an hour go."""
    hours = days.read(spark, f"{rollup_path}/source={source}", some, "bucket_month")
    if hours is not None:
        days.replace(daily(hours.withColumn("source", F.lit(source))).drop("source"), f"{daily_path}/source={source}", some, "bucket_month", "bucket")
        return
    for d in some:
        folders.delete(spark, f"{daily_path}/source={source}/bucket_month={d[:7]}/day={d}")


def read_rollup(spark: SparkSession, rollup_path: str) -> DataFrame:
    return spark.read.parquet(rollup_path).drop("bucket_month", "day")
