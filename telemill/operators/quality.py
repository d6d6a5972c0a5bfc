"""Data quality, facets and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.attributes import attr
from telemill.functions.percentiles import percentiles, rounded
from telemill.schemas import KIND_GROUPS


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that are not null or ''."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("value")).distinct()


def facets(sessions: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """(facet, value) of every facet of the read side, each table read once; no empty projects, vendors, models and tools."""
    one = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    of_session = F.concat(
        F.array(one("projects", F.col("project")), one("vendors", F.col("vendor"))), F.transform(F.coalesce("models", F.array().cast("array<string>")), lambda m: one("models", m)),
        F.transform(F.map_keys(F.coalesce("cost_by_query_source", F.create_map().cast("map<string,decimal(16,8)>"))), lambda k: one("query_sources", k)),
    )
    of_call = F.array(one("tools", F.col("tool_name")), one("decision_sources", F.col("decision_source")))
    every = sessions.select(F.explode(of_session).alias("x")).unionByName(tool_calls.select(F.explode(of_call).alias("x"))).select("x.*")
    return every.where(F.col("value").isNotNull() & ((F.col("value") != "") | F.col("facet").isin("decision_sources", "query_sources"))).distinct()


def coverage(events: DataFrame, samples: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """One row: whether logs, metrics, hooks and tool details were ever seen."""
    a = events.agg(F.coalesce(F.max(F.col("source") == "otel_log"), F.lit(False)).alias("logs_seen"), F.coalesce(F.max(F.col("source") == "hook"), F.lit(False)).alias("hooks_seen"))
    b = samples.agg((F.count("*") > 0).alias("metrics_seen"))
    c = tool_calls.agg(F.coalesce(F.max(F.col("file_path").isNotNull() | F.col("input_size_bytes").isNotNull()), F.lit(False)).alias("tool_details_seen"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))  # one row each


def unknown_kinds(events: DataFrame, since=None, limit: int = 500) -> DataFrame:
    """Names that no kind knows, by source: count, first and last time, and the attributes of the earliest."""
    rows = events.where(F.col("kind") == "unknown")
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since))
    return rows.groupBy("event_name", "source").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("attrs", F.struct("ts", "seq")).alias("sample")).orderBy(F.desc("n"), "event_name", "source").limit(limit)


def hook_latency(events: DataFrame) -> DataFrame:
    """Hook runs by hook event: number, percentiles (0 without a duration), errors, cancelled runs."""
    cancelled = attr("attrs", "num_cancelled").try_cast("long") > 0
    runs = events.where(F.col("kind") == "hook.execution_end").withColumn("hook_event", F.coalesce(attr("attrs", "hook_event"), F.lit("")))
    counts = runs.groupBy("hook_event").agg(F.count("*").alias("executions"), F.count_if(~F.col("success")).alias("errors"), F.count_if(cancelled).alias("cancelled"))
    each = percentiles(runs, ["hook_event"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    return counts.join(each, "hook_event", "left").select("hook_event", "executions", *[F.coalesce(rounded(c), F.lit(0)).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")], "errors", "cancelled")


def unknown_total(unknown: DataFrame) -> DataFrame:
    return unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def kind_group(kind: Column) -> Column:
    """The group of a kind; a kind that no group has falls back."""
    out = F.lit("fallback")
    for group, kinds in KIND_GROUPS.items():
        out = F.when(kind.isin(*kinds), group).otherwise(out)
    return out


def reconcile(received: DataFrame, outcome: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of checks: what came in less duplicates and what was too old is what is stored.

    received: one row for each record; outcome: (outcome, n) of the ingest.
    """
    n = received.agg(F.count("*").alias("received"))
    o = outcome.agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == x, F.col("n"))), F.lit(0)).alias(x) for x in ("written", "deduped", "too_old", "rejected")])
    e = events.agg(F.count("*").alias("stored"), F.count_distinct("kind").alias("kinds"), F.count_if(F.col("kind") == "unknown").alias("unknown"))
    s = sessions.agg(F.count_if(F.col("started_at").isNull()).alias("sessions_without_start"))
    out = n.join(o, F.lit(True)).join(e, F.lit(True)).join(s, F.lit(True))  # one row each
    return out.withColumn("balanced", F.col("received") - F.col("deduped") - F.col("too_old") - F.col("rejected") == F.col("stored"))


def checksum(df: DataFrame) -> DataFrame:
    """One row: number of rows and the sum of their hashes over columns in order of their names; maps count by their entries."""
    columns = []
    for name, kind in sorted(df.dtypes):
        columns.append(F.array_sort(F.map_entries(name)) if kind.startswith("map") else F.col(name))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash"))
