"""Folds of events into sessions and turns.

Ranked fields follow one rule that does not depend on arrival: of the values
that are there, the one of the highest source rank wins, then the latest, then
the one of the highest sequence number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.attributes import attr, base_name
from telemill.schemas import MONEY



def source_rank() -> Column:
    """Logs over hooks (and whatever else) over metrics."""
    return F.when(F.col("source") == "otel_log", 30).when(F.col("source") == "otel_metric", 10).otherwise(20)


def latest(value: Column, rank: Column | None = None, when: Column | None = None) -> Column:
    """The value of the highest rank, then time, then sequence number, among non-empty ones."""
    there = value.isNotNull()
    if when is not None:
        there &= when
    order = [F.col("ts"), F.col("seq")]
    return F.max_by(value, F.when(there, F.struct(*([rank.alias("rank")] if rank is not None else []), *order)))


def text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _tokens(when: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]


def _money(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def cost_map(events: DataFrame) -> DataFrame:
    """(session_id, cost_by_query_source): summed cost of each raw query source, '' where absent; a source without any cost is there with 0."""
    by = events.where(F.col("kind") == "llm.request").groupBy("session_id", F.coalesce("query_source", F.lit("")).alias("query_source")).agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast(MONEY).alias("cost"))
    return by.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_source", "cost")))).alias("cost_by_query_source"))


def fold_sessions(events: DataFrame, turns: DataFrame | None = None, tool_calls: DataFrame | None = None, subagents: DataFrame | None = None) -> DataFrame:
    """One row per session.  Counts of turns, calls and subagents come from their own folds."""
    kind, hook, log, rank = F.col("kind"), F.col("source") == "hook", F.col("source") == "otel_log", source_rank()
    start, end, request = kind == "session.start", kind == "session.end", kind == "llm.request"
    moved = hook & kind.isin("session.start", "workspace.cwd_changed")
    estimated = F.coalesce(F.col("cost_source") == "estimated", F.lit(False))
    one = events.groupBy("session_id").agg(
        latest(F.col("vendor")).alias("vendor"),
        latest(text(base_name(attr("attrs", "cwd"))), rank, moved).alias("project"),
        latest(attr("attrs", "cwd"), rank, moved).alias("cwd"),
        latest(attr("attrs", "source"), rank, hook & start).alias("start_type"),
        latest(attr("attrs", "reason"), rank, hook & end).alias("end_reason"),
        latest(text(F.col("permission_mode")), rank).alias("permission_mode"),
        latest(F.coalesce(attr("attrs", "app.version"), attr("attrs", "resource.service.version")), rank, log).alias("app_version"),
        latest(F.coalesce(attr("attrs", "app.entrypoint"), attr("attrs", "resource.app.entrypoint")), rank, log).alias("entrypoint"),
        latest(attr("attrs", "terminal.type"), rank, log).alias("terminal_type"),
        latest(attr("attrs", "user.email"), rank, log).alias("user_email"),
        latest(attr("attrs", "user.account_uuid"), rank, log).alias("user_account_uuid"),
        latest(attr("attrs", "organization.id"), rank, log).alias("organization_id"),
        F.min(F.when(start, F.col("ts"))).alias("started_at"),
        F.max(F.when(end, F.col("ts"))).alias("ended_at"),
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_event_at"),
        F.count("*").alias("event_count"),
        *_tokens(request),
        _money(F.when(request & ~estimated, F.col("cost_usd"))).alias("cost_usd"),
        _money(F.when(request & estimated, F.col("cost_usd"))).alias("cost_estimated_usd"),
        F.array_sort(F.collect_set(F.when(request, text(F.col("model"))))).alias("models"),
        F.when(F.max(end), "ended").when(F.max(start), "active").otherwise("unknown").alias("status"),
        F.count_if((kind == "llm.error") | (kind == "tool.result") & ~F.coalesce("success", F.lit(True))).alias("derived_error_count"),
    )
    out = one.join(cost_map(events), "session_id", "left")
    out = out.withColumn("cost_by_query_source", F.coalesce("cost_by_query_source", F.create_map().cast(f"map<string,{MONEY}>")))
    for rows, name, more in ((turns, "turn_count", []), (tool_calls, "tool_call_count", [F.count_if(F.col("decision") == "reject").alias("tool_reject_count")]), (subagents, "subagent_count", [])):
        if rows is not None:
            counts = rows.groupBy("session_id").agg(F.count("*").alias(name), *more)
            out = out.join(counts, "session_id", "left").fillna(0, [name, *(["tool_reject_count"] if more else [])])
    return out


def fold_turns(events: DataFrame, tool_calls: DataFrame | None = None) -> DataFrame:
    """One row per (session, prompt); events without a prompt belong to no turn."""
    kind = F.col("kind")
    start, end, request = kind == "turn.start", kind == "turn.end", kind == "llm.request"
    estimated = F.coalesce(F.col("cost_source") == "estimated", F.lit(False))
    ended = latest(F.col("success"), None, end)
    out = events.where(text(F.col("prompt_id")).isNotNull()).groupBy("session_id", "prompt_id").agg(
        F.min(F.when(start, F.col("ts"))).alias("started_at"),
        F.max(F.when(end, F.col("ts"))).alias("ended_at"),
        F.min("ts").alias("first_seen_at"),
        F.max("ts").alias("last_event_at"),
        F.when(ended, "complete").when(~ended, "failed").otherwise("open").alias("status"),
        F.count_if(request).alias("api_request_count"),
        *_tokens(request),
        _money(F.when(request & ~estimated, F.col("cost_usd"))).alias("cost_usd"),
        _money(F.when(request & estimated, F.col("cost_usd"))).alias("cost_estimated_usd"),
        F.array_sort(F.collect_set(F.when(request, text(F.col("model"))))).alias("models"),
        F.count_if((kind == "llm.error") | (kind == "tool.result") & ~F.coalesce("success", F.lit(True))).alias("derived_error_count"),
    )
    out = out.withColumn("derived_duration_ms", F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000))
    out = out.withColumn("turn_index", F.row_number().over(Window.partitionBy("session_id").orderBy("first_seen_at", "prompt_id")) - 1)
    if tool_calls is not None:
        counts = tool_calls.where(text(F.col("prompt_id")).isNotNull()).groupBy("session_id", "prompt_id").agg(F.count("*").alias("tool_call_count"), F.count_if(F.col("decision") == "reject").alias("tool_reject_count"))
        out = out.join(counts, ["session_id", "prompt_id"], "left").fillna(0, ["tool_call_count", "tool_reject_count"])
    return out


def sweep_abandoned(sessions: DataFrame, cutoff) -> DataFrame:
    """Sessions without an end and idle since before ``cutoff`` are abandoned."""
    idle = F.col("status").isin("active", "unknown") & F.col("ended_at").isNull() & (F.col("last_event_at") < F.lit(cutoff))
    return sessions.withColumn("status", F.when(idle, "abandoned").otherwise(F.col("status")))


def touched(events: DataFrame, since) -> DataFrame:
    """Sessions with an event at or after ``since``."""
    return events.where(F.col("ts") >= F.lit(since)).select("session_id").distinct()


def rebuild_scope(tables: dict[str, DataFrame], sessions: DataFrame) -> DataFrame:
    """(table, rows): how many rows of each projection a rebuild of ``sessions`` would replace."""
    out = None
    for name, df in tables.items():
        one = df.join(sessions, "session_id", "left_semi").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def rebuild(stored: DataFrame, events: DataFrame, sessions: DataFrame, fold) -> DataFrame:
    """``stored`` with the rows of ``sessions`` folded anew from their whole history."""
    fresh = fold(events.join(sessions, "session_id", "left_semi"))
    return stored.join(sessions, "session_id", "left_anti").unionByName(fresh)


def check_rebuild_start(events: DataFrame, since, force: bool = False) -> None:
    """A rebuild from before the oldest raw event would lose history; refuse it unless forced."""
    oldest = events.agg(F.min(F.date_trunc("month", "ts")).alias("m")).first()["m"]
    if not force and oldest is not None and str(since) < str(oldest):
        raise ValueError(f"raw events start at {oldest}; a rebuild since {since} needs force=True")
