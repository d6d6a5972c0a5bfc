"""Session explorer reads: lists in pages, details of sessions, and timelines' rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.attributes import attr
from telemill.functions.percentiles import percentiles, rounded
from telemill.operators import filters
from telemill.operators.analytics import estimated_share

SORTS = {"last_event": "last_event_at", "started": "started_at", "cost": "cost_usd", "events": "event_count"}
LIMIT, MOST = 50, 500


def _limit(n: int | None) -> int:
    return min(n or LIMIT, MOST)


def duration_ms() -> Column:
    """From start to end, or to the last event; null without a start."""
    return F.floor((F.unix_micros(F.coalesce("ended_at", "last_event_at")) - F.unix_micros("started_at")) / 1000)


def after(columns: Sequence[tuple[str, bool]], position: Sequence) -> Column:
    """Rows that follow ``position`` in an order; columns: (name, descending), nulls last in either.

    A null in the position stands for a row among those nulls.
    """
    out = F.lit(False)
    same = F.lit(True)
    for (name, descending), value in zip(columns, position):
        c = F.col(name)
        if value is None:
            beyond = F.lit(False)
        else:
            beyond = (c < F.lit(value)) if descending else (c > F.lit(value))
            beyond = F.coalesce(beyond, F.lit(True))  # nulls come last
        out = out | (same & beyond)
        same = same & c.eqNullSafe(F.lit(value))
    return out


def session_list(sessions: DataFrame, tool_calls: DataFrame, f: filters.SessionFilter, sort: str = "last_event", position: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Summaries in descending order with the id as tie-break; one row more than the limit tells whether a page follows."""
    column = SORTS[sort]
    out = filters.sessions(sessions, tool_calls, f)
    if position is not None:
        out = out.where(after([(column, True), ("session_id", True)], position))
    return session_summaries(out).orderBy(F.col(column).desc_nulls_last(), F.desc("session_id")).limit(_limit(limit) + 1)


def session_summaries(sessions: DataFrame) -> DataFrame:
    """The shape of a session in lists: duration, cost block, and whether its start was seen."""
    dominant = dominant_source()
    return sessions.withColumns(
        {
            "duration_ms": duration_ms(), "total_cost_usd": F.round(F.col("cost_usd").cast("double") + F.col("cost_estimated_usd").cast("double"), 8),
            "estimated_share": estimated_share("cost_usd", "cost_estimated_usd"), "partial": F.col("started_at").isNull(), "dominant_source": dominant["key"], "dominant_cost": dominant["cost"],
        }
    ).withColumn("other_cost", (F.aggregate(F.map_values("cost_by_query_source"), F.lit(0).cast("decimal(28,8)"), lambda a, x: (a + x).cast("decimal(28,8)")) - F.col("dominant_cost")).cast("decimal(16,8)"))


def dominant_source(column: str = "cost_by_query_source") -> Column:
    """(key, cost) of the most costly query source, the first key on ties; '' and 0 of an empty map."""
    entries = F.array_sort(F.map_entries(column), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    first = F.get(entries, F.lit(0))
    return F.struct(F.coalesce(first["key"], F.lit("")).alias("key"), F.coalesce(first["value"], F.lit(0).cast("decimal(16,8)")).alias("cost"))


def mode_history(events: DataFrame) -> DataFrame:
    """Changes of permission mode: session, time, from, to, trigger."""
    return events.where(F.col("kind") == "permission.mode_changed").select("session_id", "ts", "seq", attr("attrs", "from_mode").alias("from_mode"), attr("attrs", "to_mode").alias("to_mode"), attr("attrs", "trigger").alias("trigger"))


def top_tools(tool_calls: DataFrame, limit: int = 10) -> DataFrame:
    """Each session's most called tools: calls, rejects, median duration."""
    keys = ["session_id", "tool_name"]
    each = tool_calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.count_if(F.col("decision") == "reject").alias("rejects"))
    each = each.join(percentiles(tool_calls, keys, "duration_ms", {"p50": 0.5}), keys, "left").select(*keys, "calls", "rejects", rounded("p50").alias("p50_ms"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("calls"), "tool_name"))
    return each.withColumn("place", place).where(F.col("place") <= limit)


def decision_totals(tool_calls: DataFrame) -> DataFrame:
    """Each session's decisions: accepted, rejected, decided, and decided with exact correlation."""
    decided = F.col("decision").isin("accept", "reject")
    return tool_calls.groupBy("session_id").agg(
        F.count_if(F.col("decision") == "accept").alias("accept"), F.count_if(F.col("decision") == "reject").alias("reject"), F.count_if(decided).alias("decided"), F.count_if(decided & (F.col("correlation") == "exact")).alias("exact_decided")
    )


def decision_sources(tool_calls: DataFrame) -> DataFrame:
    """Each session's decided calls by raw source, '' for none."""
    return tool_calls.where(F.col("decision").isin("accept", "reject")).groupBy("session_id", F.coalesce("decision_source", F.lit("")).alias("decision_source")).agg(F.count("*").alias("n"))


def sources_seen(events: DataFrame) -> DataFrame:
    return events.select("session_id", "source").distinct()


def session_hook_latency(events: DataFrame) -> DataFrame:
    """Each session's hook runs: number, p50, p95, and medians by hook event without the events that have none."""
    runs = events.where(F.col("kind") == "hook.execution_end").withColumn("hook_event", F.coalesce(attr("attrs", "hook_event"), F.lit("")))
    total = runs.groupBy("session_id").agg(F.count("*").alias("executions"))
    each = percentiles(runs, ["session_id"], "duration_ms", {"p50": 0.5, "p95": 0.95})
    by = percentiles(runs, ["session_id", "hook_event"], "duration_ms", {"p50": 0.5}).select("session_id", F.struct("hook_event", rounded("p50").alias("p50")).alias("e"))
    medians = by.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("p50_by_hook_event"))  # one for each hook event
    return total.join(each, "session_id", "left").join(medians, "session_id", "left").select("session_id", "executions", rounded("p50").alias("p50_ms"), rounded("p95").alias("p95_ms"), "p50_by_hook_event")


def raw_expired(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Whether a session began before the oldest month that still has raw events."""
    oldest = events.agg(F.date_trunc("month", F.min("ts")).alias("oldest"))
    return sessions.join(F.broadcast(oldest), F.lit(True)).select("session_id", (F.col("oldest").isNull() | (F.col("first_seen_at") < F.col("oldest"))).alias("raw_events_expired"))  # one row


def turn_list(turns: DataFrame, session_id: str | None = None, position: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Turns in the order of their first event."""
    out = filters.apply(turns, filters.equals("session_id", session_id))
    if position is not None:
        out = out.where(after([("first_seen_at", False), ("prompt_id", False)], position))
    return out.orderBy("first_seen_at", "prompt_id").limit(_limit(limit) + 1)


def event_order(descending: bool = False) -> list[Column]:
    """Time, vendor number (none last), sequence; descending is the exact reverse."""
    if descending:
        return [F.desc("ts"), F.col("vendor_seq").desc_nulls_first(), F.desc("seq")]
    return [F.asc("ts"), F.col("vendor_seq").asc_nulls_last(), F.asc("seq")]


def event_list(events: DataFrame, sessions: DataFrame, f: filters.EventFilter, descending: bool = False, position: tuple | None = None, limit: int | None = None, full: bool = False) -> DataFrame:
    """A page of events; slim rows leave ``attrs`` out, so that a scan never reads them."""
    out = filters.events(events, sessions, f)
    if position is not None:
        out = out.where(events_after(position, descending))
    out = out.orderBy(*event_order(descending)).limit(_limit(limit) + 1)
    return out if full else out.drop("attrs")


def events_after(position: tuple, descending: bool = False) -> Column:
    """Events that follow (ts, vendor_seq, seq); vendor numbers may be null."""
    ts, number, seq = position
    t, v, s = F.col("ts"), F.col("vendor_seq"), F.col("seq")
    if descending:
        beyond = v.isNotNull() if number is None else F.coalesce(v < F.lit(number), F.lit(False))
        return (t < F.lit(ts)) | (t == F.lit(ts)) & (beyond | v.eqNullSafe(F.lit(number)) & (s < F.lit(seq)))
    beyond = F.lit(False) if number is None else v.isNull() | (v > F.lit(number))
    return (t > F.lit(ts)) | (t == F.lit(ts)) & (F.coalesce(beyond, F.lit(True)) | v.eqNullSafe(F.lit(number)) & (s > F.lit(seq)))


def event_by_reference(events: DataFrame, ts, seq: int) -> DataFrame:
    """The event at (ts, seq)."""
    return events.where((F.col("ts") == F.lit(ts)) & (F.col("seq") == F.lit(seq)))


def events_since(events: DataFrame, start, position: tuple | None = None, limit: int = 2000) -> DataFrame:
    """Events from ``start`` on and after (ts, seq), in that order."""
    out = events.where(F.col("ts") >= F.lit(start))
    if position is not None:
        out = out.where((F.col("ts") > F.lit(position[0])) | (F.col("ts") == F.lit(position[0])) & (F.col("seq") > F.lit(position[1])))
    return out.orderBy("ts", "seq").limit(limit)


def event_scan(events: DataFrame, position: tuple | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """All events after (ts, seq), of the given sessions or of all: what a rebuild folds.  Folds order inside their groups, so rows come in no order."""
    out = events
    if position is not None:
        out = out.where((F.col("ts") > F.lit(position[0])) | (F.col("ts") == F.lit(position[0])) & (F.col("seq") > F.lit(position[1])))
    return out if sessions is None else out.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def tool_call_list(tool_calls: DataFrame, sessions: DataFrame, f: filters.ToolCallFilter, position: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Tool calls, the latest first."""
    out = filters.tool_calls(tool_calls, sessions, f)
    if position is not None:
        out = out.where(after([("started_at", True), ("id", True)], position))
    return out.orderBy(F.desc("started_at"), F.desc("id")).limit(_limit(limit) + 1)


def list_totals(sessions: DataFrame) -> DataFrame:
    """Cost and tokens over the listed sessions."""
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    return sessions.agg(F.count("*").alias("sessions"), F.round(F.sum(F.col("cost_usd").cast("double") + F.col("cost_estimated_usd").cast("double")), 8).alias("cost_usd"), F.sum(tokens).alias("tokens"))


def session_strip(sessions: DataFrame) -> DataFrame:
    """Each session's tokens, and reject rate, null without calls."""
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    return sessions.select("session_id", tokens.alias("tokens"), F.when(F.col("tool_call_count") > 0, F.col("tool_reject_count") / F.col("tool_call_count")).alias("reject_rate"))
