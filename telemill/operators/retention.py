"""Retention of raw rows, sessions and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expired_months(rows: DataFrame, cutoff) -> DataFrame:
    """(month, rows) of the months that end by ``cutoff``: what an expiry would drop."""
    month = F.trunc(F.to_date("ts"), "month")
    return rows.groupBy(month.alias("month")).agg(F.count("*").alias("rows")).where(F.add_months("month", 1) <= F.lit(cutoff).cast("date"))


def without_expired(rows: DataFrame, cutoff) -> DataFrame:
    """Rows of the months that go on after ``cutoff``."""
    return rows.where(F.add_months(F.trunc(F.to_date("ts"), "month"), 1) > F.lit(cutoff).cast("date"))


def precise_prune(rows: DataFrame, cutoff) -> DataFrame:
    """Rows from ``cutoff`` on; only the month of the cutoff changes."""
    return rows.where(F.col("ts") >= F.lit(cutoff))


def expired_sessions(sessions: DataFrame, cutoff) -> DataFrame:
    return sessions.where(F.col("last_event_at") < F.lit(cutoff)).select("session_id")


def without_sessions(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every projection without the rows of the sessions that are gone."""
    return {name: df.join(gone, "session_id", "left_anti") for name, df in tables.items()}


def prune_ledger(ledger: DataFrame, cutoff) -> DataFrame:
    return ledger.where(F.col("first_seen_at") >= F.lit(cutoff))


def covered_months(rows: DataFrame, oldest, now, ahead: int = 2) -> DataFrame:
    """Months with rows between the horizon and ``ahead`` months after ``now``."""
    month = F.trunc(F.to_date("ts"), "month")
    low, high = F.trunc(F.lit(oldest).cast("date"), "month"), F.add_months(F.trunc(F.lit(now).cast("date"), "month"), ahead)
    return rows.select(month.alias("month")).distinct().where(F.col("month").between(low, high))
