"""Folds of tool events into tool calls."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.attributes import attr
from telemill.operators.sessions import latest, source_rank, text

#: Fixed value: the namespace that call ids are derived in.
NAMESPACE = "2e1a9c9e-9c1d-5f2a-8b0a-6e1f5b7c9a3d"
WINDOW_SECONDS = 60
KINDS = ["tool.pre", "tool.decision", "tool.permission_request", "tool.result"]


def contributions(events: DataFrame, *more: str) -> DataFrame:
    """Tool events with the sizes that their attributes give; ``more`` names further columns to keep."""
    size = lambda name: attr("attrs", name).try_cast("int")
    return events.where(F.col("kind").isin(*KINDS) & text(F.col("tool_name")).isNotNull()).select(
        "session_id", "prompt_id", "tool_name", text(F.col("tool_use_id")).alias("tool_use_id"), "kind", "source", "ts", "seq", "vendor_seq", "dedup_key", "decision", "decision_source", "tool_source",
        "permission_mode", "agent_id", "file_path", "error_type", "success", "duration_ms", size("tool_input_size_bytes").alias("input_size_bytes"), size("tool_result_size_bytes").alias("result_size_bytes"), *more,
    )


def uuid5(name: Column) -> Column:
    """Version 5 UUID of a text in the fixed namespace, by built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def keyed_id() -> Column:
    return uuid5(F.concat_ws("|", "session_id", "tool_use_id"))


def decision_rank() -> Column:
    """How much a contribution's decision counts: logged decision, logged result, hook, anything else."""
    log = F.col("source") == "otel_log"
    return F.when(log & (F.col("kind") == "tool.decision"), 30).when(log & (F.col("kind") == "tool.result"), 20).when(F.col("source") == "hook", 10).otherwise(0)


def assign_keyless(rows: DataFrame, window_seconds: int = WINDOW_SECONDS, open_at_the_time: bool = False) -> DataFrame:
    """Contributions with their call: ``call_id`` and ``heuristic``.

    A contribution with a use id belongs to that call.  One without claims, in
    the order of time, vendor number (none last) and dedup key, the nearest call
    of the same session, prompt and tool that is open, not yet claimed and
    within the window; otherwise it opens a call of its own, which can be
    claimed once.  Open is a call without any result in the input, or, with
    ``open_at_the_time``, without one up to the contribution's time.
    """
    keys = ["session_id", "prompt_id", "tool_name"]
    keyed = rows.where(F.col("tool_use_id").isNotNull()).withColumn("call_id", keyed_id()).withColumn("heuristic", F.lit(False))
    loose = rows.where(F.col("tool_use_id").isNull())
    calls = keyed.groupBy("session_id", "call_id").agg(
        F.max_by("prompt_id", F.struct(F.col("prompt_id").isNotNull(), -F.unix_micros("ts"))).alias("prompt_id"), F.min("tool_name").alias("tool_name"),
        F.coalesce(F.min(F.when(F.col("kind").isin("tool.pre", "tool.decision"), F.col("ts"))), F.min("ts")).alias("started_at"),
        F.min(F.when(F.col("kind") == "tool.result", F.col("ts"))).alias("ended_at"), F.max(F.when(F.col("source") == "otel_log", 1).otherwise(0)).alias("logged"),
    )
    if not open_at_the_time:
        calls = calls.where(F.col("ended_at").isNull())
    place = [F.coalesce(k, F.lit("")).alias(k) for k in keys]
    none = F.lit(None)
    asks = loose.select(*place, F.unix_micros("ts").alias("at"), "vendor_seq", "dedup_key", "seq", none.cast("string").alias("call_id"), none.cast("long").alias("until"), F.lit(0).alias("logged"))
    open_ = calls.select(*place, F.unix_micros("started_at").alias("at"), none.cast("long").alias("vendor_seq"), none.cast("string").alias("dedup_key"), none.cast("long").alias("seq"), "call_id", F.unix_micros("ended_at").alias("until"), "logged")
    points = asks.unionByName(open_.join(asks.select(*keys).distinct(), keys, "left_semi"))
    # nothing reaches over a gap longer than the window, so the stretches between gaps are walked apart
    own = Window.partitionBy(*keys).orderBy("at")
    gap = F.coalesce(F.col("at") - F.lag("at").over(own) > window_seconds * 1_000_000, F.lit(True))
    points = points.withColumn("gap", gap.cast("int")).withColumn("island", F.sum("gap").over(own)).drop("gap")
    order = [F.col("at"), F.col("vendor_seq").isNull(), F.col("vendor_seq"), F.col("dedup_key")]
    dealt = points.repartition(*keys, "island").sortWithinPartitions(*keys, "island", *order, "call_id")
    found = dealt.mapInPandas(_walker(window_seconds * 1_000_000), "session_id string, prompt_id string, tool_name string, island long, dedup_key string, seq long, call_id string, opened int, place int, heuristic boolean")
    # calls that contributions open are numbered through their session, prompt and tool
    before = F.coalesce(F.sum("opened").over(Window.partitionBy(*keys).orderBy("island").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = (F.col("before") + F.col("place")).cast("string")
    found = found.withColumn("before", before).select("dedup_key", "seq", F.coalesce("call_id", uuid5(F.concat_ws("|", *keys, number))).alias("call_id"), "heuristic")
    return keyed.unionByName(loose.join(found, ["dedup_key", "seq"]).select(*keyed.columns))


def _walker(window: int):
    """Over rows sorted by session, prompt, tool, island and order: contributions claim calls, island by island."""

    def walk(rows: list) -> list[tuple]:
        pool = sorted((r.at, i, r.call_id, r.until, bool(r.logged), -1) for i, r in enumerate(r for r in rows if r.dedup_key is None))
        out, opened = [], 0
        for r in rows:
            if r.dedup_key is None:
                continue
            best, start = None, bisect.bisect_left(pool, (r.at,))
            for step, stop in ((-1, -1), (1, len(pool))):
                k = start - 1 if step < 0 else start
                while k != stop:
                    p = pool[k]
                    far = abs(r.at - p[0])
                    if far > window or (best is not None and far > best[0]):
                        break
                    if (pd.isna(p[3]) or p[3] > r.at) and (best is None or (far, p[1]) < best[:2]):
                        best = (far, p[1], k)
                    k += step
            if best is not None:
                p = pool.pop(best[2])
                out.append((*r[:3], r.island, r.dedup_key, r.seq, p[2], 0, p[5], p[4]))
            else:
                bisect.insort(pool, (r.at, len(rows) + opened, None, None, False, opened))
                out.append((*r[:3], r.island, r.dedup_key, r.seq, None, 1, opened, False))
                opened += 1
        return out

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["session_id", "prompt_id", "tool_name", "island", "dedup_key", "seq", "call_id", "opened", "place", "heuristic"]
        waiting, key = [], None
        for page in pages:
            done = []
            for r in page.itertuples(index=False):
                own = (r.session_id, r.prompt_id, r.tool_name, r.island)
                if own != key:
                    done += walk(waiting)
                    waiting, key = [], own
                waiting.append(r)
            if done:
                yield pd.DataFrame(done, columns=names)
        if waiting:
            yield pd.DataFrame(walk(waiting), columns=names)

    return run


def fold_tool_calls(events: DataFrame, keyless: bool = True, open_at_the_time: bool = False) -> DataFrame:
    """One row per tool call.

    keyless: also place contributions without a use id; otherwise they are
    left out.  wait_ms is the time from start to decision.
    """
    rows = contributions(events)
    if keyless:
        rows = assign_keyless(rows, open_at_the_time=open_at_the_time)
    else:
        rows = rows.where(F.col("tool_use_id").isNotNull()).withColumn("call_id", keyed_id()).withColumn("heuristic", F.lit(False))
    return fold_placed(rows)


def fold_placed(rows: DataFrame) -> DataFrame:
    """One row per tool call, from contributions with their ``call_id`` and ``heuristic``."""
    kind, rank, decided = F.col("kind"), source_rank(), decision_rank()
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "seq")))
    strict = F.min(F.when(kind.isin("tool.pre", "tool.decision"), F.col("ts")))
    logged, hooked, guessed = F.max(F.col("source") == "otel_log"), F.max((F.col("source") == "hook") & F.col("tool_use_id").isNotNull()), F.max("heuristic")
    # an id names a session's call, so grouping by both keeps it next to its session
    one = rows.groupBy("session_id", F.col("call_id").alias("id")).agg(
        first("prompt_id").alias("prompt_id"), latest(F.col("tool_use_id")).alias("tool_use_id"), first("tool_name").alias("tool_name"),
        *[latest(F.col(c), decided).alias(c) for c in ("tool_source", "decision", "decision_source")],
        *[latest(F.col(c), rank).alias(c) for c in ("agent_id", "permission_mode", "duration_ms", "success", "error_type", "file_path", "input_size_bytes", "result_size_bytes")],
        F.coalesce(strict, F.min("ts")).alias("started_at"), latest(F.col("ts"), decided, kind == "tool.decision").alias("decided_at"), F.max(F.when(kind == "tool.result", F.col("ts"))).alias("ended_at"),
        F.when(logged & hooked, "exact").when(logged & guessed, "heuristic").when(logged, "otel_only").otherwise("hook_only").alias("correlation"), F.count("*").alias("event_count"),
    )
    return one.withColumn("wait_ms", F.floor((F.unix_micros("decided_at") - F.unix_micros("started_at")) / 1000).cast("long"))
