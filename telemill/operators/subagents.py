"""Folds of subagent events, and the trees they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.attributes import attr
from telemill.operators.sessions import latest, source_rank, text
from telemill.sources.tables import staged

MAX_DEPTH = 16
CROWD = 10_000  # agents of a session whose parents stand in one row


def fold_subagents(events: DataFrame, tool_calls: DataFrame | None = None) -> DataFrame:
    """One row per (session, agent): times, status, explicit or inferred parent, depth.

    Tool-call counts are null unless hooks cover the session: a call that only
    logs report names no agent.
    """
    own = events.where(F.col("kind").isin("subagent.start", "subagent.stop") & text(F.col("agent_id")).isNotNull())
    start, stop, rank = F.col("kind") == "subagent.start", F.col("kind") == "subagent.stop", source_rank()
    one = own.groupBy("session_id", "agent_id").agg(
        latest(text(F.col("parent_agent_id")), rank).alias("stated_parent"), latest(text(F.col("agent_type")), rank).alias("agent_type"), latest(text(F.col("prompt_id")), rank).alias("prompt_id"),
        F.min(F.when(start, F.col("ts"))).alias("started_at"), F.max(F.when(stop, F.col("ts"))).alias("ended_at"), latest(F.col("success"), None, stop).alias("ok"),
    )
    status = F.when(F.col("started_at").isNull(), "unknown").when(F.col("ended_at").isNull(), "running").when(F.coalesce("ok", F.lit(True)), "complete").otherwise("failed")
    one = one.withColumn("status", status).drop("ok")
    found = infer_parents(one.where(F.col("stated_parent").isNull()), events)
    one = one.join(found, ["session_id", "agent_id"], "left").withColumn("parent_agent_id", F.coalesce("stated_parent", "found_parent")).drop("stated_parent", "found_parent")
    levels = depths(one)
    one = one.join(levels, ["session_id", "agent_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(1)))
    return one if tool_calls is None else count_calls(one, tool_calls)


def infer_parents(agents: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, agent_id, found_parent, spawn_tool_use_id): of the hook calls of the same prompt that ask for this type of agent, the latest not after its start."""
    calls = events.where((F.col("kind") == "tool.pre") & (F.col("source") == "hook") & attr("attrs", "tool_input", "subagent_type").isNotNull()).select(
        "session_id", "prompt_id", attr("attrs", "tool_input", "subagent_type").alias("agent_type"), F.col("ts").alias("call_ts"), F.col("seq").alias("call_seq"), F.col("agent_id").alias("caller"), "tool_use_id"
    )
    met = agents.where(F.col("started_at").isNotNull()).join(calls, ["session_id", "prompt_id", "agent_type"]).where((F.col("call_ts") <= F.col("started_at")) & ~F.col("caller").eqNullSafe(F.col("agent_id")))
    last = F.struct("call_ts", "call_seq")
    return met.groupBy("session_id", "agent_id").agg(F.max_by("caller", last).alias("found_parent"), F.max_by("tool_use_id", last).alias("spawn_tool_use_id"))


def tree_rows(agents: DataFrame, max_depth: int = MAX_DEPTH, crowd: int = CROWD) -> DataFrame:
    """``agents`` that are reached from one without a parent (depth 1), with depth and path.

    Agents on a cycle or under an agent that was never seen are reached from
    nowhere and left out, and so is what lies deeper than the limit.
    """
    found = _lines(agents, max_depth, crowd).where((F.col("up") == "") & (F.size("path") <= max_depth))
    found = found.select("session_id", "agent_id", F.size("path").alias("depth"), F.array_join("path", "/").alias("path"))
    return agents.select("session_id", "agent_id", "parent_agent_id").join(found, ["session_id", "agent_id"])


def depths(agents: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(session_id, agent_id, depth) of the agents that hang on one without a parent; what lies deeper than the limit has its depth.

    Agents on a cycle, or under one that was never seen, have none.
    """
    lines = _lines(agents, max_depth)
    endless = (F.coalesce("up", F.lit("")) != "") & (F.size(F.array_distinct("path")) < F.size("path"))
    return lines.where(F.col("up").isNotNull() & ~endless).select("session_id", "agent_id", F.least(F.size("path"), F.lit(max_depth)).alias("depth"))


def _lines(agents: DataFrame, max_depth: int, crowd: int = CROWD) -> DataFrame:
    """(session_id, agent_id, path, up): each agent's line of ancestors, of at most ``max_depth`` steps up, and what is above it: '' for nothing, null for an agent that was never seen.

    A session's parents become one map, in which its agents look their ancestors
    up; where a session has more than ``crowd`` agents, lines double instead
    (:func:`_doubled_lines`).  Both give the same lines.
    """
    links = staged(agents.select("session_id", "agent_id", F.coalesce("parent_agent_id", F.lit("")).alias("up")), "agent-links")
    crowded = links.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("session_id")
    if crowded.isEmpty():
        return _mapped_lines(links, max_depth)
    rest = links.join(crowded, "session_id", "left_anti")
    return _mapped_lines(rest, max_depth).unionByName(_doubled_lines(links.join(crowded, "session_id", "left_semi"), max_depth))


def _mapped_lines(links: DataFrame, max_depth: int) -> DataFrame:
    maps = links.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("agent_id", "up"))).alias("up"))

    def climb(acc: Column, _: Column) -> Column:
        top = F.coalesce(acc["up"], F.lit("")) == ""
        return F.when(top, acc).otherwise(F.struct(F.concat(F.array(acc["up"]), acc["path"]).alias("path"), F.try_element_at(F.col("up"), acc["up"]).alias("up")))

    def line(agent: Column) -> Column:
        start = F.struct(F.array(agent).alias("path"), F.try_element_at(F.col("up"), agent).alias("up"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(max_depth)), start, climb)

    lines = maps.select("session_id", F.explode(F.transform(F.map_keys("up"), line)).alias("l"))
    return lines.select("session_id", F.element_at("l.path", -1).alias("agent_id"), "l.path", "l.up")


def _doubled_lines(links: DataFrame, max_depth: int) -> DataFrame:
    """The same by pointer doubling: a line is joined with that of the agent above it, so that some five joins climb 16 steps and no session is one row."""
    one = links.select("session_id", "agent_id", F.array("agent_id").alias("path"), "up")

    def joined(low: DataFrame, high: DataFrame) -> DataFrame:
        """Lines of ``low`` that go on in the line of ``high`` above them; one that ends at an agent never seen takes its name in."""
        open_ = F.coalesce("up", F.lit("")) != ""
        above = high.select(F.col("session_id").alias("__session"), F.col("agent_id").alias("__up"), F.col("path").alias("__path"), F.col("up").alias("__next"))
        met = low.where(open_).join(above, (F.col("session_id") == F.col("__session")) & (F.col("up") == F.col("__up")), "left")
        grown = met.select("session_id", "agent_id", F.concat(F.coalesce("__path", F.array("up")), "path").alias("path"), F.col("__next").alias("up"))
        return staged(low.where(~open_).unionByName(grown), "agent-lines")

    # a line of n agents is made of lines whose sizes are the powers of two in n
    power, out, wanted = one, None, max_depth + 1
    while wanted:
        if wanted & 1:
            out = power if out is None else joined(out, power)
        wanted >>= 1
        if wanted:
            power = joined(power, power)
    return out


def count_calls(agents: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """Agents with their number of calls, null in sessions that hooks do not cover."""
    covered = tool_calls.where(F.col("correlation") != "otel_only").select("session_id", F.lit(True).alias("covered")).distinct()
    n = tool_calls.where(text(F.col("agent_id")).isNotNull()).groupBy("session_id", "agent_id").agg(F.count("*").alias("n"))
    out = agents.join(covered, "session_id", "left").join(n, ["session_id", "agent_id"], "left")
    return out.withColumn("tool_call_count", F.when(F.col("covered"), F.coalesce("n", F.lit(0)))).drop("covered", "n")


def session_tree(agents: DataFrame, sessions: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """Rows of each session's tree: the root (depth 0, the session's times and status) and all agents that it reaches."""
    covered = tool_calls.groupBy("session_id").agg(F.max(F.col("correlation") != "otel_only").alias("covered"), F.count_if(text(F.col("agent_id")).isNull()).alias("n"))
    root = sessions.join(covered, "session_id", "left").select(
        "session_id", F.lit("root").alias("agent_id"), F.lit(None).cast("string").alias("parent_agent_id"), F.lit(None).cast("string").alias("agent_type"), F.lit(0).alias("depth"), F.lit("root").alias("path"),
        "started_at", "ended_at", "status", F.when(F.col("covered"), F.col("n")).alias("tool_call_count"),
    )
    levels = tree_rows(agents).select("session_id", "agent_id", "depth", "path")
    rest = count_calls(agents.drop("depth", "tool_call_count"), tool_calls).join(levels, ["session_id", "agent_id"])
    rest = rest.select("session_id", "agent_id", F.when(F.col("depth") == 1, "root").otherwise(F.col("parent_agent_id")).alias("parent_agent_id"), "agent_type", "depth", F.concat(F.lit("root/"), "path").alias("path"), "started_at", "ended_at", "status", "tool_call_count")
    return root.unionByName(rest)
