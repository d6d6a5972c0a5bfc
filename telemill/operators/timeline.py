"""Timeline derivations: one moment seen by several sources, tool threads, runs of a turn."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators.sessions import source_rank

MERGE_MS = 2000


def correlation_key() -> Column:
    """What two reports of one moment share: the tool use, else the request, else the agent, else the prompt."""
    keys = ["tool_use_id", "request_id", "agent_id", "prompt_id"]
    return F.coalesce(*[F.when(F.col(k) != "", F.concat(F.lit(f"{k}:"), F.col(k))) for k in keys], F.concat(F.lit("seq:"), F.col("seq").cast("string")))


def groups_of_moments(events: DataFrame, merge_ms: int = MERGE_MS) -> DataFrame:
    """``events`` (session_id, kind, ts, seq, ...) with ``moment``: the seq of the first event of its moment.

    In order of time an event joins the first open group of its session, kind
    and correlation key whose first member is at most ``merge_ms`` before it;
    events with a skewed clock stay alone.  A group is anchored at its first
    member, so a chain of close events does not grow without end.
    """
    alone = events.where(F.col("clock_skewed")).withColumn("moment", F.col("seq"))
    own = Window.partitionBy("session_id", "kind", "__key")
    order = own.orderBy("__at", F.col("vendor_seq").isNull(), "vendor_seq", "seq")
    rest = events.where(~F.col("clock_skewed")).withColumns({"__key": correlation_key(), "__at": F.unix_micros("ts")})
    # a gap above the limit starts an island; only islands that are longer than the limit have to be walked
    gap = F.col("__at") - F.lag("__at").over(order) > merge_ms * 1000
    rest = rest.withColumn("__gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("__island", F.sum("__gap").over(order))
    island = Window.partitionBy("session_id", "kind", "__key", "__island")
    first = F.first("seq").over(island.orderBy("__at", F.col("vendor_seq").isNull(), "vendor_seq", "seq"))
    rest = rest.withColumns({"__first": first, "__long": F.max("__at").over(island) - F.min("__at").over(island) > merge_ms * 1000})
    columns = events.columns
    short = rest.where(~F.col("__long")).select(*columns, F.col("__first").alias("moment"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """One island."""
        pdf = pdf.assign(last=pdf["vendor_seq"].isna()).sort_values(["at", "last", "vendor_seq", "seq"])
        out, anchor, first = [], None, None
        for at, seq in zip(pdf["at"].tolist(), pdf["seq"].tolist()):
            if anchor is None or at - anchor > merge_ms * 1000:
                anchor, first = at, seq
            out.append((seq, first))
        return pd.DataFrame(out, columns=["seq", "moment"])

    long = rest.where(F.col("__long"))
    found = long.select("session_id", "kind", "__key", "__island", F.col("__at").alias("at"), "vendor_seq", "seq").groupBy("session_id", "kind", "__key", "__island").applyInPandas(walk, "seq long, moment long")
    walked = long.join(found, "seq").select(*columns, "moment")
    return short.unionByName(walked).unionByName(alone.select(*columns, "moment"))


def collapse(events: DataFrame, merge_ms: int = MERGE_MS) -> DataFrame:
    """One row per moment: its sources, and each field from the report of the highest rank that has it, of equal ones the first."""
    rows = groups_of_moments(events, merge_ms)
    keep = [c for c in events.columns if c not in ("seq", "ts", "session_id", "kind", "source", "attrs")]
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(source_rank(), -F.unix_micros("ts"), -F.col("seq"))))
    return rows.groupBy("session_id", "kind", "moment").agg(F.min("ts").alias("ts"), F.count("*").alias("members"), F.array_sort(F.collect_set("source")).alias("sources"), *[pick(c).alias(c) for c in keep])


#: Which event of a thread is shown first.
DISPLAY = ["tool.result", "tool.decision", "tool.permission_request", "tool.pre"]


def tool_threads(events: DataFrame) -> DataFrame:
    """Events of a tool use with their thread: size, parent (its first ``tool.pre``, else its first event), and the event to show."""
    rows = events.where(F.coalesce("tool_use_id", F.lit("")) != "")
    own = Window.partitionBy("session_id", "tool_use_id")
    order = [F.col("ts"), F.col("vendor_seq").isNull(), F.col("vendor_seq"), F.col("seq")]
    rank = F.lit(0)
    for k, kind in enumerate(DISPLAY):
        rank = F.when(F.col("kind") == kind, len(DISPLAY) - k).otherwise(rank)
    return rows.withColumns(
        {
            "size": F.count("*").over(own), "parent_seq": F.first("seq").over(own.orderBy((F.col("kind") != "tool.pre").cast("int"), *order)),
            "display_seq": F.first("seq").over(own.orderBy(F.desc(rank), *order)), "place": F.row_number().over(own.orderBy(*order)),
        }
    ).withColumn("is_thread", F.col("size") > 1)


def turn_runs(rows: DataFrame, session: str = "session_id", prompt: str = "prompt_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """``rows`` with ``run``, the number of the stretch of equal prompts it is in, and ``continuation``, whether the prompt had a run before."""
    own = Window.partitionBy(session).orderBy(*order)
    change = F.when(F.lag(prompt).over(own).eqNullSafe(F.col(prompt)) & (F.row_number().over(own) > 1), 0).otherwise(1)
    numbered = rows.withColumn("__new", change).withColumn("run", F.sum("__new").over(own).cast("int"))
    first = F.min("run").over(Window.partitionBy(session, prompt))
    return numbered.withColumn("continuation", F.col("run") > first).drop("__new")
