"""Tables on storage: months as partitions, projections by session bucket, price lists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill import schemas
from telemill.sources import days, folders
from telemill.sources.folders import shared_dir

BUCKETS = 64


_STORED: dict[tuple, tuple] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for results that a plan needs more than once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the files at ``source``: made and written once a session, and again when one of the files changes."""
    key = (spark.sparkContext.applicationId, name, source)
    files = folders.modified(spark, source)
    if key not in _STORED or _STORED[key][0] != files:
        _STORED[key] = (files, staged(make(), name))
    return _STORED[key][1]


def forget(name: str) -> None:
    """Let the next reader of the stored table ``name`` make it again."""
    for key in [k for k in _STORED if k[1] == name]:
        del _STORED[key]


def append_events(events: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Add to a table of months and days.  With a batch id the rows go to folders of the batch, which a retry replaces."""
    days.write(events, path, batch_id)


def append_samples(samples: DataFrame, path: str, batch_id: int | None = None) -> None:
    days.write(samples, path, batch_id, "sample_month")


def read_events(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Events between two times; the months' names prune partitions before rows are read."""
    out = spark.read.parquet(path)
    if start is not None:
        out = out.where((F.col("event_month") >= F.date_format(F.lit(start), "yyyy-MM")) & (F.col("ts") >= F.lit(start)))
    if end is not None:
        out = out.where((F.col("event_month") <= F.date_format(F.lit(end), "yyyy-MM")) & (F.col("ts") < F.lit(end)))
    return out.drop("event_month", "day", "batch")


def session_bucket(column: str = "session_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def write_projection(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the buckets that ``rows`` belong to and leave all others as they are."""
    out = rows.withColumn("bucket", session_bucket(buckets=buckets)).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_buckets(rows: DataFrame, path: str, buckets: list[int]) -> None:
    """Make ``rows`` all that the projection has of ``buckets``, those without a row included."""
    spark = rows.sparkSession
    aside = f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(aside)
    for b in buckets:
        folders.delete(spark, f"{path}/bucket={b}")
        if folders.exists(spark, f"{aside}/bucket={b}"):
            folders.rename(spark, f"{aside}/bucket={b}", f"{path}/bucket={b}")
    folders.delete(spark, aside)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price lists in JSON; currency and source have defaults."""
    money = "input_per_mtok double, output_per_mtok double, cache_read_per_mtok double, cache_write_per_mtok double"
    rows = spark.read.option("multiLine", True).schema(f"model string, effective_from date, currency string, {money}, source string").json(path)
    kinds = dict(x.split() for x in schemas.PRICES.split(", "))
    filled = rows.fillna({"currency": "USD", "source": "repo", "cache_read_per_mtok": 0.0, "cache_write_per_mtok": 0.0})
    return filled.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
