"""Tables by month, day and batch: ``month=2024-01/day=2024-01-05/batch=3``.

A batch owns its folders, which a retry replaces.  Readers name the days that
they need, and only these folders are listed and read, so that the cost of a
batch depends on what it touches and not on history.  Small folders of old
batches are put together by :func:`compact`.

Days travel as texts like ``2024-01-05``.  Their number is that of the days that
some rows touch; the driver holds no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.sources.folders import children, create, delete, exists, rename, shared_dir, text_of

MONTH = "event_month"


def day(ts: str = "ts"):
    return F.date_format(ts, "yyyy-MM-dd")


def write(rows: DataFrame, path: str, batch_id: int | None = None, month: str = MONTH, ts: str = "ts") -> None:
    """Add rows by the day of ``ts``: as the folders of a batch, or without one to the folders of the days."""
    # tasks of like sizes that hold few days each: small days are few files, large days are many
    out = rows.withColumn(month, F.date_format(ts, "yyyy-MM")).withColumn("day", day(ts)).hint("rebalance", F.col("day"))
    if batch_id is None:
        out.write.mode("append").partitionBy(month, "day").parquet(path)
    else:
        out.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month, "day", "batch").parquet(path)


def of(rows: DataFrame, ts: str = "ts") -> list[str]:
    """The days of ``rows``, one text each."""
    return sorted(r[0] for r in rows.select(day(ts)).distinct().collect() if r[0] is not None)


def with_neighbours(days: Iterable[str], before: int, after: int) -> list[str]:
    return sorted({str(date.fromisoformat(d) + timedelta(days=k)) for d in days for k in range(-before, after + 1)})


def folders(spark: SparkSession, path: str, days: Iterable[str], month: str = MONTH) -> list[str]:
    """Folders of those of ``days`` that the table has."""
    return [x for x in (f"{path}/{month}={d[:7]}/day={d}" for d in days) if exists(spark, x)]


def read(spark: SparkSession, path: str, days: Iterable[str], month: str = MONTH) -> DataFrame | None:
    """Rows of ``days`` with their ``batch``; none if the table has none of them."""
    found = folders(spark, path, days, month)
    return spark.read.option("basePath", path).parquet(*found).drop(month, "day") if found else None


def replace(rows: DataFrame, path: str, days: Iterable[str], month: str = MONTH, ts: str = "ts") -> None:
    """Make ``rows`` all that the table has of ``days``; rows of other days are left out, and ``batch``, if there, keeps its folders.

    The rows are written aside first, so they may come from the table itself.
    A failure before the last step leaves the old days or, in part, the new ones;
    the same call again puts it right, as long as its input does not change.
    """
    spark, days = rows.sparkSession, sorted(days)
    aside = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    kept = rows.withColumn(month, F.date_format(ts, "yyyy-MM")).withColumn("day", day(ts)).where(F.col("day").isin(days))
    kept.hint("rebalance", F.col("day")).write.partitionBy(month, "day", *(["batch"] if "batch" in rows.columns else [])).parquet(aside)
    for d in days:
        target, fresh = f"{path}/{month}={d[:7]}/day={d}", f"{aside}/{month}={d[:7]}/day={d}"
        delete(spark, target)
        if exists(spark, fresh):
            rename(spark, fresh, target)
    delete(spark, aside)


def months(spark: SparkSession, path: str, month: str = MONTH) -> list[str]:
    """The months that the table has, from its folders' names alone."""
    return sorted(x.partition("=")[2] for x in children(spark, path) if x.startswith(f"{month}="))


def days(spark: SparkSession, path: str, of_month: str, month: str = MONTH) -> list[str]:
    return sorted(x.partition("=")[2] for x in children(spark, f"{path}/{month}={of_month}") if x.startswith("day="))


def compact(spark: SparkSession, path: str, some: Iterable[str], below: int, month: str = MONTH, order: Sequence[str] = (), files: int = 1) -> int:
    """Put each day's batches under ``below`` into ``files`` files in the folder of the last one of them; how many folders that took away.

    With ``order`` the rows are dealt over the files by ranges of these columns
    and sorted, so that readers of a range skip files and row groups by their
    statistics; a folder that is sorted so already, and alone, stays.

    The merged rows are written beside the table and a note names what they
    replace.  A call that was broken off is finished by the next one, from the
    note; readers should not run at the same time.
    """
    gone = 0
    for d in some:
        folder, note = f"{path}/{month}={d[:7]}/day={d}", f"{path}/_compact-{d}"
        ready = text_of(spark, f"{note}/ready")
        if ready is None:
            old = [b for b in sorted(int(x.partition("=")[2]) for x in children(spark, folder) if x.startswith("batch=")) if b < below]
            if not old or len(old) == 1 and (not order or text_of(spark, f"{folder}/batch={old[0]}/_sorted") == ",".join(order)):
                continue
            delete(spark, note)
            rows = spark.read.option("basePath", folder).parquet(*[f"{folder}/batch={b}" for b in old]).drop("batch")
            rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order) if order else rows.coalesce(files)
            rows.write.parquet(f"{note}/batch={old[-1]}")
            if order:
                create(spark, f"{note}/batch={old[-1]}/_sorted", ",".join(order))
            ready = ",".join(map(str, old))
            create(spark, f"{note}/ready", ready)
        names = ready.split(",")
        fresh = f"{note}/batch={names[-1]}"
        if exists(spark, fresh):
            for b in names:
                delete(spark, f"{folder}/batch={b}")
            rename(spark, fresh, f"{folder}/batch={names[-1]}")
        delete(spark, note)
        gone += len(names) - 1
    return gone


def page(spark: SparkSession, path: str, order: Sequence[Column], limit: int, start: datetime | None = None, where: Column | None = None, descending: bool = False, month: str = MONTH, step: int = 4) -> DataFrame | None:
    """The first ``limit`` rows by ``order`` (which begins with ts) that meet ``where``, from the time ``start`` on; none without days.

    Days are taken in order from that of ``start``, ``step`` at first and then
    more, until they hold a page; inside them the bound on ts reaches the scan,
    which skips files and row groups of sorted days (:func:`compact`).
    """
    # a day more, as the driver's time zone may not be the session's; the bound on ts is exact
    day_of = None if start is None else f"{start + timedelta(days=1 if descending else -1):%Y-%m-%d}"
    near = lambda x: day_of is None or (x <= day_of[: len(x)] if descending else x >= day_of[: len(x)])
    left = sorted((d for m in months(spark, path, month) if near(m) for d in days(spark, path, m, month) if near(d)), reverse=descending)
    while left:
        rows = read(spark, path, left[:step], month)
        if start is not None:
            rows = rows.where(F.col("ts") <= F.lit(start) if descending else F.col("ts") >= F.lit(start))
        if where is not None:
            rows = rows.where(where)
        out = rows.orderBy(*order).limit(limit)
        if step >= len(left) or out.count() == limit:
            return out
        step *= 3
    return None
