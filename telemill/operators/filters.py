"""Filters of the read side: every one is optional, and all present ones have to hold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(column: str, values: Sequence[str] | None) -> Column | None:
    """The column is one of ``values``; no values, no filter."""
    return F.col(column).isin(*values) if values else None


def overlaps(column: str, values: Sequence[str] | None) -> Column | None:
    """The array column shares a value with ``values``."""
    return F.arrays_overlap(column, F.array(*map(F.lit, values))) if values else None


def between(column: str, start=None, end=None) -> Column | None:
    """Lists: both ends belong to the range."""
    return both(F.col(column) >= F.lit(start) if start is not None else None, F.col(column) <= F.lit(end) if end is not None else None)


def within(column: str, start=None, end=None) -> Column | None:
    """Analytics: the start belongs to the range, the end does not."""
    return both(F.col(column) >= F.lit(start) if start is not None else None, F.col(column) < F.lit(end) if end is not None else None)


def text_search(columns: Sequence[str], text: str | None) -> Column | None:
    """A substring of any of the columns, in any case; no character is special."""
    if not text:
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(text))), F.lit(False)) for c in columns])


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def both(*clauses: Column | None) -> Column | None:
    """All clauses that are there."""
    some = [c for c in clauses if c is not None]
    return reduce(lambda a, b: a & b, some) if some else None


def apply(df: DataFrame, *clauses: Column | None) -> DataFrame:
    clause = both(*clauses)
    return df if clause is None else df.where(clause)


def exists(df: DataFrame, related: DataFrame, keys: dict[str, str], column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows of ``df`` with a related row whose ``column`` is one of ``values``; keys: own column to related column."""
    if not values:
        return df
    wanted = related.where(F.col(column).isin(*values)).select(*[F.col(b).alias(f"__{a}") for a, b in keys.items()]).distinct()
    return df.join(wanted, reduce(lambda x, y: x & y, [df[a] == wanted[f"__{a}"] for a in keys]), "left_semi")


@dataclass(frozen=True)
class SessionFilter:
    """Filters of session lists."""

    projects: tuple[str, ...] = ()
    vendors: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    tools: tuple[str, ...] = ()
    decision_sources: tuple[str, ...] = ()
    start: object = None
    end: object = None
    text: str | None = None


def sessions(df: DataFrame, tool_calls: DataFrame, f: SessionFilter) -> DataFrame:
    """Sessions that ``f`` lets through; times apply to the last event."""
    out = apply(
        df, any_of("project", f.projects), any_of("vendor", f.vendors), overlaps("models", f.models), any_of("status", f.statuses),
        between("last_event_at", f.start, f.end), text_search(["session_id", "project", "cwd"], f.text),
    )
    out = exists(out, tool_calls, {"session_id": "session_id"}, "tool_name", f.tools)
    return exists(out, tool_calls, {"session_id": "session_id"}, "decision_source", f.decision_sources)


@dataclass(frozen=True)
class EventFilter:
    """Filters of event lists."""

    sessions: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    prompt_id: str | None = None
    agent_id: str | None = None
    tools: tuple[str, ...] = ()
    decision_sources: tuple[str, ...] = ()
    vendors: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    start: object = None
    end: object = None
    extra: tuple = field(default=())


def events(df: DataFrame, session_rows: DataFrame, f: EventFilter) -> DataFrame:
    """Events that ``f`` lets through; projects are those of their sessions."""
    out = apply(
        df, any_of("session_id", f.sessions), any_of("kind", f.kinds), equals("prompt_id", f.prompt_id), equals("agent_id", f.agent_id), any_of("tool_name", f.tools),
        any_of("decision_source", f.decision_sources), any_of("vendor", f.vendors), between("ts", f.start, f.end),
    )
    return exists(out, session_rows, {"session_id": "session_id"}, "project", f.projects)


@dataclass(frozen=True)
class ToolCallFilter:
    """Filters of tool-call lists."""

    sessions: tuple[str, ...] = ()
    tools: tuple[str, ...] = ()
    decision_sources: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    start: object = None
    end: object = None


def tool_calls(df: DataFrame, session_rows: DataFrame, f: ToolCallFilter) -> DataFrame:
    """Tool calls that ``f`` lets through; times apply to their start."""
    out = apply(df, any_of("session_id", f.sessions), any_of("tool_name", f.tools), any_of("decision_source", f.decision_sources), between("started_at", f.start, f.end))
    return exists(out, session_rows, {"session_id": "session_id"}, "project", f.projects)
