"""Idempotent ingest: coverage, duplicates, order numbers and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.percentiles import order_statistics
from telemill.sources.tables import staged


def first_of_key(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key (dedup_key unless others are named): the earliest."""
    names = rows.columns
    return rows.groupBy(*(keys or ("dedup_key",))).agg(F.min_by(F.struct(*names), F.struct("ts", *[c for c in ("seq", "event_name", "session_id", "name") if c in names])).alias("r")).select("r.*")


def months_between(spark, oldest, now, ahead: int = 2) -> DataFrame:
    """First days of the months from that of ``oldest`` to ``ahead`` months after ``now``."""
    one = spark.range(1).select(F.trunc(F.lit(oldest).cast("date"), "month").alias("a"), F.add_months(F.trunc(F.lit(now).cast("date"), "month"), ahead).alias("b"))
    return one.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))


def covered(rows: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of a covered month; months: at most some hundreds."""
    return rows.join(F.broadcast(months.select(F.col("month").alias("__m"))), F.trunc(F.to_date("ts"), "month") == F.col("__m"), "left_semi")


def outcome(rows: DataFrame, ledger: DataFrame, months: DataFrame, key: str = "dedup_key") -> DataFrame:
    """``rows`` with what happens to each: too_old, deduped or written.

    A row that is too old never meets the ledger, so a later replay into a
    restored month still lands.
    """
    names = rows.columns
    marked = rows.join(F.broadcast(months.select(F.col("month").alias("__m"), F.lit(True).alias("__covered"))), F.trunc(F.to_date("ts"), "month") == F.col("__m"), "left").drop("__m")
    order = Window.partitionBy(key, F.col("__covered").isNotNull()).orderBy("ts", *[c for c in ("seq",) if c in names])
    placed = marked.withColumn("__place", F.row_number().over(order)).join(ledger.select(F.col(key), F.lit(True).alias("__known")), key, "left")
    out = F.when(F.col("__covered").isNull(), "too_old").when(F.col("__known") | (F.col("__place") > 1), "deduped").otherwise("written")
    return placed.withColumn("outcome", out).select(*names, "outcome")


def survivors(rows: DataFrame, ledger: DataFrame, months: DataFrame | None = None, key: str = "dedup_key") -> DataFrame:
    """Rows that are new: of a covered month, the first of their key, and of no key in the ledger."""
    base = rows if months is None else covered(rows, months)
    return first_of_key(base, key).join(ledger.select(key), key, "left_anti").select(*rows.columns)


def grown_ledger(ledger: DataFrame, new: DataFrame, now) -> DataFrame:
    """The ledger with the new rows' keys, first seen ``now``."""
    return ledger.unionByName(new.select("dedup_key", F.lit(now).cast("timestamp").alias("first_seen_at")))


def accounts(outcomes: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """(outcome, n) of written, deduped, too old and rejected records."""
    out = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    if rejects is not None:
        out = out.unionByName(rejects.agg(F.coalesce(F.sum("points"), F.lit(0)).alias("n")).select(F.lit("rejected").alias("outcome"), "n"))
    return out


def balance(outcomes: DataFrame) -> DataFrame:
    """(outcome, n) of rows that have a ``reason`` and lost ``points`` if they were rejected: events and rejected, in one pass; both are there even if nothing came."""
    sums = outcomes.agg(F.count_if(F.col("reason").isNull()).alias("event"), F.coalesce(F.sum("points"), F.lit(0)).alias("rejected"))
    return sums.unpivot([], ["event", "rejected"], "outcome", "n")


def with_sequence(rows: DataFrame, offset: int = 0) -> DataFrame:
    """``rows`` with ``seq``: their place by (ts, dedup_key) in the batch, after ``offset``.

    A sample sort: Spark samples (ts, dedup_key) for ranges of equal size, each
    task sorts one, and one number a range gives the offsets.  A busy hour is dealt
    over as many ranges as it needs.  The sorted rows are written once, so that
    places and offsets come from the same ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(n, "ts", "dedup_key").sortWithinPartitions("ts", "dedup_key")
    ranged = staged(ranged.withColumns({"__range": F.shiftright(place, 33), "__k": place.bitwiseAND((1 << 33) - 1)}), "sequence")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__n")  # a row for each range
    starts = F.broadcast(sizes.select("__range", before.alias("__before")))
    return ranged.join(starts, "__range").withColumn("seq", F.lit(offset + 1) + F.col("__before") + F.col("__k")).drop("__range", "__k", "__before")


def ingest_lag(events: DataFrame, edges: tuple[float, ...] = (1, 5, 30, 60, 300, 1800)) -> DataFrame:
    """One row: percentiles of the seconds from event to receipt, and how many are within each edge."""
    lag = (F.unix_micros("ingested_at") - F.unix_micros("ts")) / 1_000_000
    base = events.select(lag.alias("lag"))
    edges_of = order_statistics(base, "lag", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    counts = base.agg(*[F.count_if(F.col("lag") <= e).alias(f"le_{e}") for e in edges], F.count("*").alias("n"))
    return edges_of.select(*[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")]).join(counts, F.lit(True))  # one row each


def by_source(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count("*").alias("n"))
