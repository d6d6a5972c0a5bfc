"""Expiry on storage: months and days go by their folders' names, and only the day of the cutoff is read.

Times are in the session's zone.  Rollups are never expired here.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.sources import days, folders, tables


def _after(month: str) -> date:
    """The day after a month like ``2024-01``."""
    y, m = int(month[:4]), int(month[5:])
    return date(y + m // 12, m % 12 + 1, 1)


def expired(spark: SparkSession, path: str, cutoff: date, month: str = days.MONTH) -> list[str]:
    """Months of the table that end by ``cutoff``, from the listing of its folders alone."""
    return [m for m in days.months(spark, path, month) if _after(m) <= cutoff]


def expire(spark: SparkSession, tables_by_month: dict[str, str], cutoff: date, dry_run: bool = False) -> dict[str, list[str]]:
    """Delete the months that end by ``cutoff`` from each table (path to the name of its month column); with ``dry_run`` only tell them."""
    found = {path: expired(spark, path, cutoff, month) for path, month in tables_by_month.items()}
    if not dry_run:
        for path, gone in found.items():
            for m in gone:
                folders.delete(spark, f"{path}/{tables_by_month[path]}={m}")
    return found


def prune(spark: SparkSession, path: str, cutoff: datetime, month: str = days.MONTH, ts: str = "ts", earlier_months: bool = False) -> None:
    """Delete rows before ``cutoff`` from its own month, or with ``earlier_months`` from all of the table.

    Days before it go as folders; its day alone is read and written again, batch
    by batch.  The files of all other days stay as they are.
    """
    own, today = f"{cutoff:%Y-%m}", f"{cutoff:%Y-%m-%d}"
    if earlier_months:
        for m in days.months(spark, path, month):
            if m < own:
                folders.delete(spark, f"{path}/{month}={m}")
    for d in days.days(spark, path, own, month):
        if d < today:
            folders.delete(spark, f"{path}/{month}={own}/day={d}")
    rows = days.read(spark, path, [today], month)
    if rows is not None and cutoff != datetime(cutoff.year, cutoff.month, cutoff.day):
        days.replace(rows.where(F.col(ts) >= F.lit(f"{cutoff:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp")), path, [today], month, ts)


def expire_sessions(spark: SparkSession, sessions_path: str, projections: list[str], cutoff: datetime) -> int:
    """Delete sessions whose last event is before ``cutoff``, and their rows in every projection; how many sessions went.

    Projections stand in session buckets (:func:`telemill.sources.tables.write_projection`);
    only buckets with a session that goes are read and written again.  Sessions go
    last, so that a call that was broken off finds them again.
    """
    old = F.col("last_event_at") < F.lit(f"{cutoff:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp")
    gone = tables.staged(spark.read.parquet(sessions_path).where(old).select("session_id", "bucket"), "expired-sessions")
    touched = sorted(r.bucket for r in gone.select("bucket").distinct().collect())
    for path in [*projections, sessions_path]:
        there = [b for b in touched if folders.exists(spark, f"{path}/bucket={b}")]
        if there:
            rows = spark.read.option("basePath", path).parquet(*[f"{path}/bucket={b}" for b in there])
            tables.replace_buckets(rows.join(gone.select("session_id"), "session_id", "left_anti").select(*rows.columns), path, there)
    return gone.count()


def covered(spark: SparkSession, path: str, oldest: date, now: date, ahead: int = 2, month: str = days.MONTH) -> list[str]:
    """Months of the table between that of ``oldest`` and ``ahead`` months after ``now``."""
    last = now.month - 1 + ahead
    high = f"{now.year + last // 12:04d}-{last % 12 + 1:02d}"
    return [m for m in days.months(spark, path, month) if f"{oldest:%Y-%m}" <= m <= high]


def frame(spark: SparkSession, found: dict[str, list[str]]) -> DataFrame:
    """(path, month) rows of what :func:`expire` found."""
    return spark.createDataFrame([(p, m) for p, months in found.items() for m in months], "path string, month string")
