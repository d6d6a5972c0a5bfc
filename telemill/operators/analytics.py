"""Analytics over rollups, tool calls and sessions.  Windows hold their start and not their end."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.percentiles import order_statistics, percentiles, rounded
from telemill.operators import filters
from telemill.operators.rollups import bucket_list
from telemill.schemas import MONEY

#: Metrics of a series, as sums of rollup columns.
METRICS = {
    "cost": ["cost_reported_usd", "cost_estimated_usd"],
    "tokens": ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"],
    "loc": ["loc_added", "loc_removed"],
    **{m: [m] for m in ("sessions_started", "turns", "api_requests", "api_errors", "tool_calls", "tool_rejects", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "active_seconds", "commits", "pull_requests")},
}
#: What a model filter may apply to, and sums that belong to no model or to one.
MODEL_METRICS = ("cost", "tokens", "api_requests", "api_errors")
NOT_ATTRIBUTABLE = ["sessions_started", "turns", "tool_calls", "tool_rejects", "loc_added", "loc_removed", "active_seconds"]
ATTRIBUTABLE = ["api_requests", "api_errors", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_reported_usd", "cost_estimated_usd"]
TOOL_DIMENSIONS = {"tool": "tool_name", "decision_source": "decision_source", "error_type": "error_type"}


class UnsupportedFilter(ValueError):
    """A filter that the metric or dimension cannot have."""


@dataclass(frozen=True)
class Query:
    """Window and filters of an analytics read."""

    now: datetime
    start: datetime | None = None
    end: datetime | None = None
    projects: tuple[str, ...] = ()
    vendors: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    source: str = "event"

    def window(self) -> tuple[datetime, datetime]:
        """The last day unless given."""
        end = self.end or self.now
        return self.start or end - timedelta(hours=24), end

    def bucket(self) -> str:
        """Hours up to a week, then days."""
        a, b = self.window()
        return "hour" if b - a <= timedelta(days=7) else "day"

    def before(self) -> Query:
        """The window of the same length just before."""
        a, b = self.window()
        return Query(self.now, a - (b - a), a, self.projects, self.vendors, self.models, self.source)


def rows(rollup: DataFrame, q: Query, models: bool = True) -> DataFrame:
    """Rollup rows of the window, source and filters."""
    a, b = q.window()
    return filters.apply(rollup, filters.within("bucket", a, b), filters.equals("source", q.source), filters.any_of("project", q.projects), filters.any_of("vendor", q.vendors), filters.any_of("model", q.models) if models else None)


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY if c.startswith("cost_") else "long").alias(c)


def summary(hourly: DataFrame, q: Query) -> DataFrame:
    """One row of totals; what no model can have is null under a model filter, and named in ``not_attributable``."""
    one = rows(hourly, q).agg(*[_sum(c) for c in ATTRIBUTABLE])
    two = rows(hourly, q, models=False).agg(*[_sum(c) for c in NOT_ATTRIBUTABLE])
    if q.models:
        two = two.select(*[F.lit(None).cast("long").alias(c) for c in NOT_ATTRIBUTABLE])
    out = one.join(two, F.lit(True))  # one row each
    total = F.col("cost_reported_usd") + F.col("cost_estimated_usd")
    return out.select(
        "*", total.cast(MONEY).alias("cost_usd"), estimated_share().alias("estimated_share"),
        F.when(F.col("tool_calls") > 0, F.col("tool_rejects") / F.col("tool_calls")).when(F.col("tool_calls") == 0, 0.0).alias("reject_rate"),
        F.array(*[F.lit(c) for c in (NOT_ATTRIBUTABLE if q.models else [])]).cast("array<string>").alias("not_attributable"),
    )


def estimated_share(reported: str = "cost_reported_usd", estimated: str = "cost_estimated_usd") -> Column:
    """Estimated cost in the whole; 0 where there is no cost."""
    total = F.col(reported).cast("double") + F.col(estimated).cast("double")
    return F.when(total != 0, F.col(estimated).cast("double") / total).otherwise(0.0)


def metrics_only_projects(hourly: DataFrame, q: Query) -> DataFrame:
    """Projects with metrics and without events in the window (events of any vendor count)."""
    a, b = q.window()
    base = hourly.where(filters.within("bucket", a, b))
    metric = filters.apply(base, F.col("source") == "metric", F.col("project") != "", filters.any_of("project", q.projects), filters.any_of("vendor", q.vendors))
    return metric.select("project").distinct().join(base.where(F.col("source") == "event").select("project").distinct(), "project", "left_anti")


def metric_value(metric: str) -> Column:
    """Value of a row under a metric, as a double."""
    out = F.lit(0.0)
    for c in METRICS[metric]:
        out = out + F.col(c).cast("double")
    return out


def _check_series(metric: str, q: Query) -> None:
    if q.models and metric not in MODEL_METRICS:
        raise UnsupportedFilter(f"{metric} belongs to no model")


def timeseries(hourly: DataFrame, daily: DataFrame, metric: str, q: Query, group_by: str | None = None, bucket: str | None = None, top: int = 8) -> DataFrame:
    """(bucket, series, value): dense over all buckets of the window, the ``top`` series by total and ``other`` for the rest.

    Buckets start with the one that holds the window's start, while only rows at
    or after the start count.  Without grouping there is always one series, ''.
    """
    _check_series(metric, q)
    unit = bucket or q.bucket()
    a, b = q.window()
    key = F.col(group_by) if group_by else F.lit("")
    each = rows(hourly if unit == "hour" else daily, q).groupBy("bucket", key.alias("key")).agg(F.round(F.sum(metric_value(metric)), 8).alias("value"))
    totals = each.groupBy("key").agg(F.sum("value").alias("total"))
    kept = totals.orderBy(F.desc("total"), "key").limit(top).select("key", F.lit(True).alias("kept"))
    named = each.join(F.broadcast(kept), "key", "left").select("bucket", F.when(F.col("kept"), F.col("key")).otherwise("other").alias("series"), F.col("kept").isNull().alias("is_other"), "value")
    summed = named.groupBy("bucket", "series", "is_other").agg(F.sum("value").alias("value"))
    series = summed.select("series", "is_other").distinct()
    if not group_by:
        series = series.sparkSession.createDataFrame([("", False)], "series string, is_other boolean")
    dense = bucket_list(hourly.sparkSession, a, b, unit).join(series, F.lit(True))  # at most top + 1 series
    return dense.join(summed, ["bucket", "series", "is_other"], "left").select("bucket", "series", F.round(F.coalesce("value", F.lit(0.0)), 8).alias("value"))


def series_sums(hourly: DataFrame, daily: DataFrame, q: Query, group_by: str | None = None, bucket: str | None = None) -> DataFrame:
    """All sums by bucket and group."""
    unit = bucket or q.bucket()
    key = F.col(group_by) if group_by else F.lit("")
    columns = ["sessions_started", "turns", "api_requests", "api_errors", "tool_calls", "tool_rejects", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_reported_usd", "cost_estimated_usd", "loc_added", "loc_removed"]
    return rows(hourly if unit == "hour" else daily, q).groupBy("bucket", key.alias("group_key")).agg(*[_sum(c) for c in columns])


def breakdown(dimension: str, q: Query, hourly: DataFrame | None = None, tool_calls: DataFrame | None = None, sessions: DataFrame | None = None, metric: str = "cost", limit: int = 20) -> DataFrame:
    """(key, value, share): the largest values and their share of the whole.

    model, project: a metric of the rollup.  tool, decision_source, error_type:
    numbers of calls, whatever the metric; only projects filter them.
    query_source: cost of the sessions whose last event is in the window.
    """
    a, b = q.window()
    if q.models and not (dimension in ("model", "project") and metric in ("cost", "tokens")):
        raise UnsupportedFilter(f"{dimension} by {metric} belongs to no model")
    if dimension in ("model", "project"):
        each = rows(hourly, q).groupBy(F.col(dimension).alias("key")).agg(F.round(F.sum(metric_value("api_requests" if metric == "calls" else metric)), 8).alias("value"))
    elif dimension in TOOL_DIMENSIONS:
        each = _calls(tool_calls, sessions, q).where(F.col(TOOL_DIMENSIONS[dimension]).isNotNull()).groupBy(F.col(TOOL_DIMENSIONS[dimension]).alias("key")).agg(F.count("*").cast("double").alias("value"))
    else:
        own = filters.apply(sessions, filters.within("last_event_at", a, b), filters.any_of("project", q.projects), filters.any_of("vendor", q.vendors))
        each = own.select(F.explode("cost_by_query_source").alias("key", "cost")).groupBy("key").agg(F.sum("cost").cast("double").alias("value"))
    total = F.sum("value").over(Window.partitionBy())  # one row for each key
    return each.withColumn("share", F.when(total != 0, F.col("value") / total).otherwise(0.0)).orderBy(F.desc("value"), "key").limit(limit)


def _calls(tool_calls: DataFrame, sessions: DataFrame, q: Query) -> DataFrame:
    a, b = q.window()
    return filters.exists(tool_calls.where(filters.within("started_at", a, b)), sessions, {"session_id": "session_id"}, "project", q.projects)


def decision_matrix(tool_calls: DataFrame, sessions: DataFrame, q: Query) -> DataFrame:
    """Decisions of each tool; exact_share is 1 where nothing is decided, percentiles of the wait are null without one."""
    decided = F.col("decision").isin("accept", "reject")
    exact = decided & (F.col("correlation") == "exact")
    calls = _calls(tool_calls, sessions, q)
    counts = calls.groupBy("tool_name").agg(
        F.count_if(F.col("decision") == "accept").alias("accept"), F.count_if(F.col("decision") == "reject").alias("reject"), F.count_if(decided).alias("decided"),
        F.when(F.count_if(decided) > 0, F.count_if(exact) / F.count_if(decided)).otherwise(1.0).alias("exact_share"),
    )
    waits = percentiles(calls, ["tool_name"], "wait_ms", {"p50": 0.5, "p95": 0.95})
    return counts.join(waits, "tool_name", "left").select("tool_name", "accept", "reject", "decided", "exact_share", rounded("p50").alias("wait_p50_ms"), rounded("p95").alias("wait_p95_ms"))


def decisions_by_source(tool_calls: DataFrame, sessions: DataFrame, q: Query) -> DataFrame:
    """Numbers of calls of each tool and decision source."""
    return _calls(tool_calls, sessions, q).where(F.col("decision").isNotNull() & F.col("decision_source").isNotNull()).groupBy("tool_name", "decision_source").agg(F.count("*").alias("n"))


def matrix_peak(by_source: DataFrame) -> DataFrame:
    """The sources that are columns of the matrix, and its greatest cell."""
    return by_source.groupBy("decision_source").agg(F.max("n").alias("column_peak")).withColumn("peak", F.max("column_peak").over(Window.partitionBy()))


def has_estimates(hourly: DataFrame) -> DataFrame:
    """Whether any row has an estimated cost."""
    return hourly.agg(F.coalesce(F.max(F.col("cost_estimated_usd") > 0), F.lit(False)).alias("estimated_cost_present"))


def period_over_period(hourly: DataFrame, q: Query) -> DataFrame:
    """(metric, value, before, delta) of the window and the one before it, in one pass; no delta if either has no rows."""
    a, b = q.window()
    p, _ = q.before().window()
    both = filters.apply(hourly, filters.within("bucket", p, b), filters.equals("source", q.source), filters.any_of("project", q.projects), filters.any_of("vendor", q.vendors), filters.any_of("model", q.models))
    now = F.col("bucket") >= F.lit(a)
    names = ["cost", "tokens", "api_requests", "tool_calls"]
    sums = [F.struct(F.lit(m).alias("metric"), F.round(F.sum(F.when(now, metric_value(m))), 8).alias("value"), F.round(F.sum(F.when(~now, metric_value(m))), 8).alias("before")) for m in names]
    out = both.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return out.withColumn("delta", F.round(F.col("value") - F.col("before"), 8)).withColumn("change", F.when(F.col("before") != 0, F.round(F.col("delta") / F.col("before"), 8)))


def sparkline(series: DataFrame) -> DataFrame:
    """Totals of each bucket over all series, ``other`` among them."""
    return series.groupBy("bucket").agg(F.round(F.sum("value"), 8).alias("value"))


def cost_bands(sessions: DataFrame) -> DataFrame:
    """(session_id, cost, band): from p90 on critical, from p75 on warn; none where all costs are equal."""
    cost = F.col("cost_usd").cast("double") + F.col("cost_estimated_usd").cast("double")
    base = sessions.select("session_id", cost.alias("cost"))
    edges = order_statistics(base, "cost", {"p75": 0.75, "p90": 0.9})
    out = base.join(F.broadcast(edges), F.lit(True))  # one row
    return out.select("session_id", "cost", F.when(F.col("lo") == F.col("hi"), "none").when(F.col("cost") >= F.col("p90"), "critical").when(F.col("cost") >= F.col("p75"), "warn").otherwise("none").alias("band"))


def reject_band(rate: Column) -> Column:
    """Bands of a reject rate."""
    return F.when(rate >= 0.15, "critical").when(rate >= 0.05, "warn").otherwise("none")
