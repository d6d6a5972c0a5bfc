"""Hourly and daily rollups of events, tool calls and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.attributes import attr
from telemill.functions.percentiles import rounded
from telemill.operators.pricing import resolve_prices, token_cost
from telemill.schemas import COSTS, EVENT_COUNTERS, MEASURES, METRIC_COUNTERS, MONEY, ROLLUP_KEY

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]


def hour(c: str) -> Column:
    return F.date_trunc("hour", F.col(c))


def with_home(rows: DataFrame, sessions: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with columns of their session, null where the session is not known."""
    return rows.join(sessions.select("session_id", *columns), "session_id", "left")


def event_rollup(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Counters of each hour, project, vendor and model, with the tokens of requests that came without a cost."""
    request = F.col("kind") == "llm.request"
    rows = with_home(events, sessions, "project")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    return rows.groupBy(hour("ts").alias("bucket"), F.coalesce("project", F.lit("")).alias("project"), "vendor", F.coalesce("model", F.lit("")).alias("model")).agg(
        count("session.start").alias("sessions_started"), count("turn.start").alias("turns"), count("llm.request").alias("api_requests"), count("llm.error").alias("api_errors"),
        *[total(c, request).alias(c) for c in TOKENS],
        F.coalesce(F.sum(F.when(F.col("cost_source") == "reported", F.col("cost_usd"))), F.lit(0)).cast(MONEY).alias("cost_reported_usd"),
        *[total(c, request & F.col("cost_usd").isNull()).alias(f"uncosted_{c}") for c in TOKENS],
    )


def tool_rollup(tool_calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Calls and rejects of each hour of their start, project and vendor."""
    rows = with_home(tool_calls, sessions, "project", "vendor")
    return rows.groupBy(hour("started_at").alias("bucket"), F.coalesce("project", F.lit("")).alias("project"), F.coalesce("vendor", F.lit("unknown")).alias("vendor")).agg(
        F.count("*").alias("tool_calls"), F.count_if(F.col("decision") == "reject").alias("tool_rejects")
    )


def merged_rollup(of_events: DataFrame, of_tools: DataFrame) -> DataFrame:
    """Both on one key; tool calls belong to no model."""
    uncosted = [f"uncosted_{c}" for c in TOKENS]
    tools = of_tools.withColumn("model", F.lit(""))
    both = of_events.unionByName(tools, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast(MONEY if c in COSTS else "long").alias(c) for c in [*EVENT_COUNTERS, "cost_reported_usd", *uncosted]]
    return both.groupBy(*ROLLUP_KEY).agg(*sums)


def with_estimates(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Price the uncosted tokens of each group at the time of its bucket."""
    uncosted = [F.col(f"uncosted_{c}") for c in TOKENS]
    need = (F.col("model") != "") & (sum(uncosted[1:], uncosted[0]) > 0)
    priced = resolve_prices(rows, prices, F.col("bucket"))
    cost = F.when(need & F.col("price_model").isNotNull(), F.round(token_cost(*uncosted), 8)).otherwise(0.0)
    return priced.withColumn("cost_estimated_usd", cost.cast(MONEY)).select(*ROLLUP_KEY, *EVENT_COUNTERS, *COSTS)


def hourly_events(events: DataFrame, tool_calls: DataFrame, sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """The hourly rollup of source ``event``."""
    return hourly_of(merged_rollup(event_rollup(events, sessions), tool_rollup(tool_calls, sessions)), prices)


def hourly_of(merged: DataFrame, prices: DataFrame) -> DataFrame:
    """The hourly rollup from the merged counters, which are read more than once: store them first."""
    return _complete(with_estimates(merged, prices), "event")


def _complete(rows: DataFrame, source: str) -> DataFrame:
    for c in MEASURES:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(0).cast(MONEY if c in COSTS else "long"))
    return rows.select(*ROLLUP_KEY, F.lit(source).alias("source"), *MEASURES)


def sample_deltas(samples: DataFrame, parts: int = 1) -> DataFrame:
    """``samples`` with ``delta``, what each contributes.

    cumulative: the difference to the sample before it in its series; the first
    one, and one that is less than its predecessor, counts whole.  delta: the
    value.  gauge and anything else: the last sample of a series and hour counts
    whole, the others nothing.

    One order of each series serves all: the last sample of an hour is the one
    before the next hour's.  parts: tasks that sort, where there should be more
    than the shuffled bytes, which equal names make few, would give.
    """
    if parts > 1:
        samples = samples.repartition(parts, "series_hash")
    series = Window.partitionBy("series_hash").orderBy("ts", "dedup_key")
    following = F.lead(F.struct(hour("ts").alias("hour"))).over(series)
    last = following.isNull() | ~following["hour"].eqNullSafe(hour("ts"))
    before = F.lag("value").over(series)
    step = F.when(before.isNull() | (F.col("value") < before), F.col("value")).otherwise(F.col("value") - before)
    return samples.withColumn("delta", F.when(F.col("temporality") == "cumulative", step).when(F.col("temporality") == "delta", F.col("value")).otherwise(F.when(last, F.col("value")).otherwise(0.0)))


def series_checkpoint(samples: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(series_hash, last_ts, last_value) of the cumulative series; a stored checkpoint only moves forward."""
    rows = samples.where(F.col("temporality") == "cumulative").select("series_hash", F.struct("ts", "dedup_key").alias("at"), "ts", "value")
    out = rows.groupBy("series_hash").agg(F.max("ts").alias("last_ts"), F.max_by("value", "at").alias("last_value"))
    if stored is not None:
        out = stored.unionByName(out).groupBy("series_hash").agg(F.max_by("last_value", "last_ts").alias("last_value"), F.max("last_ts").alias("last_ts")).select("series_hash", "last_ts", "last_value")
    return out


#: Metric, attribute that decides, its value (empty: any), and the rollup column.
METRICS = [
    ("claude_code.cost.usage", None, None, "cost_reported_usd"),
    ("claude_code.token.usage", "type", "input", "input_tokens"),
    ("claude_code.token.usage", "type", "output", "output_tokens"),
    ("claude_code.token.usage", "type", "cacheRead", "cache_read_tokens"),
    ("claude_code.token.usage", "type", "cacheCreation", "cache_creation_tokens"),
    ("claude_code.lines_of_code.count", "type", "added", "loc_added"),
    ("claude_code.lines_of_code.count", "type", "removed", "loc_removed"),
    ("claude_code.active_time.total", None, None, "active_seconds"),
    ("claude_code.commit.count", None, None, "commits"),
    ("claude_code.pull_request.count", None, None, "pull_requests"),
    ("claude_code.code_edit_tool.decision", "decision", "accept", "edit_decisions_accept"),
    ("claude_code.code_edit_tool.decision", "decision", "reject", "edit_decisions_reject"),
]
WITH_MODEL = ["claude_code.cost.usage", "claude_code.token.usage"]


def hourly_metrics(samples: DataFrame, sessions: DataFrame, parts: int = 1) -> DataFrame:
    """The hourly rollup of source ``metric``; counts are rounded sample by sample, cost is not.  parts: see :func:`sample_deltas`."""
    rows = with_home(sample_deltas(samples, parts).where(F.col("name").isin(*{m[0] for m in METRICS})), sessions, "project")
    # each attribute is read once a row
    keys = sorted({m[1] for m in METRICS if m[1]} | {"model"})
    rows = rows.withColumns({f"__{k}": attr("attrs", k) for k in keys})
    model = F.when(F.col("name").isin(*WITH_MODEL), F.coalesce("__model", F.lit(""))).otherwise("")
    whole = rounded("delta")
    sums = []
    for name, key, value, column in METRICS:
        hit = F.col("name") == name
        if key:
            hit &= F.col(f"__{key}") == value
        sums.append(F.coalesce(F.sum(F.when(hit, F.col("delta") if column in COSTS else whole)), F.lit(0)).cast(MONEY if column in COSTS else "long").alias(column))
    out = rows.groupBy(hour("ts").alias("bucket"), F.coalesce("project", F.lit("")).alias("project"), "vendor", model.alias("model")).agg(*sums)
    return _complete(out, "metric")


def daily(hourly: DataFrame) -> DataFrame:
    """Days from hours, source by source."""
    sums = [F.sum(c).cast(MONEY if c in COSTS else "long").alias(c) for c in MEASURES]
    return hourly.groupBy(F.date_trunc("day", F.col("bucket")).alias("bucket"), "project", "vendor", "model", "source").agg(*sums)


def replace_buckets(stored: DataFrame, fresh: DataFrame, claimed: DataFrame) -> DataFrame:
    """``stored`` without the claimed (bucket, source) pairs, and ``fresh`` in their place."""
    return stored.join(claimed.select("bucket", "source"), ["bucket", "source"], "left_anti").unionByName(fresh.join(claimed.select("bucket", "source"), ["bucket", "source"], "left_semi"))


def dirty_buckets(events: DataFrame, samples: DataFrame | None = None, tool_calls: DataFrame | None = None) -> DataFrame:
    """(bucket, source) that new rows change: hours of events, of samples, and of the starts of touched calls."""
    out = events.select(hour("ts").alias("bucket"), F.lit("event").alias("source"))
    if tool_calls is not None:
        out = out.unionByName(tool_calls.select(hour("started_at").alias("bucket"), F.lit("event").alias("source")))
    if samples is not None:
        out = out.unionByName(samples.select(hour("ts").alias("bucket"), F.lit("metric").alias("source")))
    return out.distinct()


def moved_buckets(before: DataFrame, after: DataFrame, most: int = 720) -> DataFrame:
    """Every hour of the sessions whose project or cwd changed, both sources; at most ``most`` hours a session."""
    old = before.select("session_id", F.col("project").alias("old_project"), F.col("cwd").alias("old_cwd"))
    moved = after.join(old, "session_id").where(~F.col("project").eqNullSafe(F.col("old_project")) | ~F.col("cwd").eqNullSafe(F.col("old_cwd")))
    hours = F.slice(F.sequence(hour("first_seen_at"), hour("last_event_at"), F.expr("INTERVAL 1 HOUR")), 1, most)
    return moved.select(F.explode(hours).alias("bucket")).distinct().crossJoin(_sources(after))


def _sources(df: DataFrame) -> DataFrame:
    """The two sources, as rows."""
    return F.broadcast(df.sparkSession.createDataFrame([("event",), ("metric",)], "source string"))


def claim(dirty: DataFrame, most: int, now) -> DataFrame:
    """The oldest ``most`` dirty buckets, and the current and the previous hour of both sources."""
    spark = dirty.sparkSession
    current = spark.range(1).select(F.date_trunc("hour", F.lit(now).cast("timestamp")).alias("h"))
    recent = current.select(F.explode(F.array(F.col("h"), F.col("h") - F.expr("INTERVAL 1 HOUR"))).alias("bucket"), F.lit("event").alias("source"))
    recent = recent.unionByName(recent.withColumn("source", F.lit("metric")))
    return dirty.orderBy("bucket", "source").limit(most).select("bucket", "source").unionByName(recent).distinct()


def with_raw_data(claimed: DataFrame, months: DataFrame) -> DataFrame:
    """Claimed buckets whose month still has raw rows; months: ``month`` as first day."""
    return claimed.withColumn("month", F.trunc(F.to_date("bucket"), "month")).join(months.select("month"), "month", "left_semi").drop("month")


def rows_of(events: DataFrame, claimed: DataFrame, column: str = "ts") -> DataFrame:
    """Rows of the claimed hours, behind a range test that prunes partitions."""
    lo, hi = claimed.agg(F.min("bucket"), F.max("bucket")).first()
    if lo is None:
        return events.limit(0)
    near = events.where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi) + F.expr("INTERVAL 1 HOUR")))
    return near.join(claimed.select(F.col("bucket").alias("__b")).distinct(), hour(column) == F.col("__b"), "left_semi")


def bucket_list(spark, start, end, unit: str = "hour") -> DataFrame:
    """Buckets from the one that holds ``start`` to the one before ``end``."""
    one = spark.range(1).select(F.date_trunc(unit, F.lit(start).cast("timestamp")).alias("a"), F.lit(end).cast("timestamp").alias("b"))
    return one.select(F.explode(F.sequence("a", F.col("b"), F.expr(f"INTERVAL 1 {unit}"))).alias("bucket"), "b").where(F.col("bucket") < F.col("b")).select("bucket")


assert set(METRIC_COUNTERS) <= {m[3] for m in METRICS}
