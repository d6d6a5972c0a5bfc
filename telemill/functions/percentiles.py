"""Exact interpolated percentiles, by one stated formula."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """One row for each group of ``keys`` that has a value, with a column for each wanted share.

    Of n sorted values x the percentile p is, in doubles, lo + (q - floor(q)) *
    (hi - lo), with q = p * (n - 1) and lo and hi the values at floor(q) and
    ceil(q).  Values are counted before they are ranked, so a group's window
    holds its distinct values only.  Nulls do not count.
    """
    keys = list(keys)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = counts.withColumns({"__end": F.sum("__n").over(own.orderBy("__x")), "__all": F.sum("__n").over(own)})

    def at(k: Column) -> Column:
        return F.min(F.when(F.col("__end") > k, F.col("__x")))

    out = []
    for name, p in wanted.items():
        q = F.lit(p) * (F.col("__all") - 1)
        lo, hi, part = at(F.floor(q)), at(F.ceil(q)), F.max(q - F.floor(q))
        out.append((lo + part * (hi - lo)).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def rounded(c: Column | str) -> Column:
    """Half away from zero, as a whole number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 0, F.floor(c + 0.5)).otherwise(F.ceil(c - 0.5)).cast("long")


def order_statistics(rows: DataFrame, value: str, wanted: dict[str, float], ranges: int = 1024) -> DataFrame:
    """One row: percentiles over all rows by the same formula, and lo and hi, the least and greatest value.

    A mergeable quantile sketch (``approx_percentile``) gives, for each wanted
    share, two values that hold it between them and at most some 2 / ``ranges`` of
    the rows, however the values are spread; the next scan counts what lies
    outside and ranks the distinct values inside.  Two scans, and no task ranks
    more than one such range.  Of few rows all values are ranked.
    """
    x = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__x"))
    shares = [s for p in wanted.values() for s in (max(p - 1 / ranges, 0.0), min(p + 1 / ranges, 1.0))]
    ends = x.agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"), F.count("*").alias("__all"), F.approx_percentile("__x", shares, 8 * ranges).alias("__s"))
    few = F.col("__all") < 8 * ranges  # the sketch may be a rank off, which its margin covers from here on
    bounds = [F.when(few, F.col("lo" if k % 2 == 0 else "hi")).otherwise(F.col("__s")[k]) for k in range(len(shares))]
    met = x.join(F.broadcast(ends.select("lo", "hi", "__all", *[b.alias(f"__b{k}") for k, b in enumerate(bounds)])), F.lit(True))  # one row
    # zones between the bounds: each lies wholly inside the ranges that are ranked, or outside
    passed = [(F.col("__x") >= F.col(f"__b{k}")) if k % 2 == 0 else (F.col("__x") > F.col(f"__b{k}")) for k in range(len(shares))]
    zone = sum((c.cast("int") for c in passed[1:]), passed[0].cast("int"))
    inside = F.lit(False)
    for a, b in zip(passed[::2], passed[1::2]):
        inside |= a & ~b
    counts = met.groupBy(zone.alias("__zone"), F.when(inside, F.col("__x")).alias("__v"), "lo", "hi", "__all").agg(F.count("*").alias("__n"))
    sizes = counts.groupBy("__zone").agg(F.sum("__n").alias("__m"))
    starts = sizes.withColumn("__before", F.sum("__m").over(Window.partitionBy(F.lit(0)).orderBy("__zone")) - F.col("__m"))  # a row for each zone
    ranked = counts.join(F.broadcast(starts.drop("__m")), "__zone").withColumn("__end", F.col("__before") + F.sum("__n").over(Window.partitionBy("__zone").orderBy("__v")))
    out = []
    for name, p in wanted.items():
        q = F.lit(p) * (F.col("__all") - 1)
        lo, hi = (F.min(F.when(F.col("__end") > k, F.col("__v"))) for k in (F.floor(q), F.ceil(q)))
        out.append((lo + F.max(q - F.floor(q)) * (hi - lo)).alias(name))
    return ranked.agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), *out)
