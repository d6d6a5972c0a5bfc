"""Canonical telemetry derived from the driver's ``events`` table by one deterministic projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill import schemas
from telemill.session import configure

PRICE_ROWS = [
    ("opal", "2023-01-01", 1.0, 2.0, 0.1, 0.5),
    ("opal-2", "2024-01-01", 3.0, 15.0, 0.3, 3.75),
    ("opal-2", "2024-01-15", 2.5, 12.0, 0.25, 3.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task, about.
TASK_ROWS = 100_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt over tasks by ``keys``, as many as their number asks for, however their files are cut or compressed."""
    parts = -(-rows.count() // TASK_ROWS)
    return rows.repartition(parts, *keys) if parts > 1 else rows


def _case(*pairs: str, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in zip(pairs[::2], pairs[1::2])) + f" ELSE {other} END"


def events(spark: SparkSession, sf_dir: str, keyless: bool = False) -> DataFrame:
    """Every row of the driver's events as one canonical event.

    keyless: leave the tool use id out of every tenth hook event, as agents
    without ids do.
    """
    configure(spark)
    raw = spread(table(spark, sf_dir, "events"), "event_id").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("f", F.floor("value").cast("long"))
    kind = _case(
        "event_type = 'purchase'", "'llm.request'",
        "event_type = 'error'", "element_at(array('llm.error', 'hook.execution_end', 'unknown'), k % 3 + 1)",
        "event_type IN ('click', 'view') AND k % 10 = 8", "CASE WHEN event_type = 'click' THEN 'subagent.start' ELSE 'subagent.stop' END",
        "event_type = 'click'", "CASE WHEN k % 2 = 0 THEN 'tool.pre' ELSE 'tool.decision' END",
        "event_type = 'view'", "'tool.result'",
        "k % 4 = 0 AND (user_id % 11 = 0 OR k % 20 = 16)", "'session.end'",
        "k % 4 < 3", "element_at(array('session.start', 'turn.start', 'turn.end'), k % 4 + 1)",
        other="'permission.mode_changed'",
    )
    source = _case("kind IN ('session.start', 'session.end', 'turn.start', 'turn.end', 'tool.pre', 'subagent.start', 'subagent.stop') OR kind = 'tool.result' AND k % 2 = 1", "'hook'", other="'otel_log'")
    one = (
        raw.withColumn("kind", F.expr(kind))
        .withColumn("source", F.expr(source))
        .withColumn("session_id", F.expr("concat('s', user_id)"))
        .withColumn("prompt_id", F.expr("CASE WHEN k % 20 <> 19 THEN concat(session_id, '-', date_format(ts, 'yyyy-MM-dd')) END"))
        .withColumn("tool_name", F.expr("CASE WHEN kind LIKE 'tool.%' THEN element_at(array('Bash', 'Read', 'Edit', 'Task'), k % 4 + 1) END"))
        .withColumn("n", F.expr("CASE WHEN kind LIKE 'subagent.%' THEN cast(k div 10 as int) END"))
    )
    use = "CASE WHEN kind LIKE 'tool.%' THEN concat(coalesce(prompt_id, session_id), '-', tool_name, '-', k div 25) END"
    if keyless:
        use = f"CASE WHEN source = 'hook' AND k % 10 = 0 THEN NULL ELSE {use} END"
    attrs = {
        "cwd": "CASE WHEN kind = 'session.start' THEN concat('/work/p', user_id % 7, CASE WHEN k % 8 = 0 THEN '/' ELSE '' END) END",
        "source": "CASE WHEN kind = 'session.start' THEN CASE WHEN k % 3 = 0 THEN 'resume' ELSE 'startup' END END",
        "reason": "CASE WHEN kind = 'session.end' THEN CASE WHEN k % 3 = 0 THEN 'logout' ELSE 'other' END END",
        "app.version": "CASE WHEN source = 'otel_log' AND k % 5 > 0 THEN concat('1.', k % 4) END",
        "resource.service.version": "CASE WHEN source = 'otel_log' AND k % 5 = 0 THEN '0.9' END",
        "terminal.type": "CASE WHEN source = 'otel_log' AND k % 6 = 0 THEN 'xterm' END",
        "user.email": "CASE WHEN source = 'otel_log' THEN concat('u', user_id, '@example.com') END",
        "from_mode": "CASE WHEN kind = 'permission.mode_changed' THEN 'default' END",
        "to_mode": "CASE WHEN kind = 'permission.mode_changed' THEN 'acceptEdits' END",
        "trigger": "CASE WHEN kind = 'permission.mode_changed' THEN CASE WHEN k % 8 = 3 THEN 'shift_tab' ELSE 'command' END END",
        "hook_event": "CASE WHEN kind = 'hook.execution_end' THEN element_at(array('PreToolUse', 'PostToolUse', 'Stop'), cast(k % 9 div 3 as int) + 1) END",
        "num_cancelled": "CASE WHEN kind = 'hook.execution_end' THEN k % 4 END",
        "tool_input_size_bytes": "CASE WHEN kind = 'tool.result' AND source = 'otel_log' THEN k * 7 END",
        "tool_result_size_bytes": "CASE WHEN kind = 'tool.result' AND source = 'otel_log' THEN k * 11 END",
        "tool_input": "CASE WHEN kind = 'tool.pre' AND tool_name = 'Task' THEN named_struct('subagent_type', element_at(array('explore', 'plan', 'review'), k % 3 + 1)) END",
    }
    out = {
        "seq": "event_id", "ts": "ts", "ingested_at": "timestampadd(MINUTE, k % 7, ts)", "session_id": "session_id", "prompt_id": "prompt_id",
        "vendor": "CASE WHEN user_id % 5 = 0 THEN 'other_agent' ELSE 'claude_code' END", "source": "source", "kind": "kind",
        "event_name": "CASE WHEN kind = 'unknown' THEN concat('mystery_', k % 5) ELSE replace(kind, '.', '_') END",
        "vendor_seq": "CASE WHEN source <> 'hook' THEN event_id % 1000 END", "tool_name": "tool_name", "tool_use_id": use,
        "decision": "CASE WHEN kind = 'tool.decision' THEN CASE WHEN k % 5 < 3 THEN 'accept' WHEN k % 5 = 3 THEN 'reject' END END",
        "decision_source": "CASE WHEN kind = 'tool.decision' OR kind = 'tool.result' AND source = 'otel_log' THEN CASE k % 6 WHEN 0 THEN 'config' WHEN 1 THEN 'hook' WHEN 2 THEN 'user_permanent' WHEN 3 THEN 'user_temporary' WHEN 4 THEN 'user_reject' END END",
        "tool_source": "CASE WHEN kind = 'tool.decision' AND k % 7 < 4 THEN 'builtin' END",
        "query_source": "CASE WHEN kind IN ('llm.request', 'llm.error') THEN CASE k % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'subagent' WHEN 2 THEN 'compact' END END",
        "model": "CASE WHEN kind IN ('llm.request', 'llm.error') THEN element_at(array('opal-2', 'opal-2-20240110', 'quartz-1'), k % 3 + 1) END",
        "input_tokens": "CASE WHEN kind = 'llm.request' THEN k * 10 + f END", "output_tokens": "CASE WHEN kind = 'llm.request' THEN k * 3L END",
        "cache_read_tokens": "CASE WHEN kind = 'llm.request' THEN f * 2 END", "cache_creation_tokens": "CASE WHEN kind = 'llm.request' THEN k * 1L END",
        "cost_usd": "CASE WHEN kind = 'llm.request' AND k % 4 <> 0 THEN cast(value / 100 as decimal(16,8)) END",
        "cost_source": "CASE WHEN kind = 'llm.request' THEN 'reported' END",
        "duration_ms": "CASE WHEN kind IN ('llm.request', 'tool.result', 'hook.execution_end') AND k % 9 <> 0 THEN cast(value * 10 as int) END",
        "success": "CASE kind WHEN 'llm.request' THEN true WHEN 'llm.error' THEN false WHEN 'tool.result' THEN k % 5 <> 0 WHEN 'turn.end' THEN k % 3 <> 0 WHEN 'hook.execution_end' THEN k % 8 <> 0 WHEN 'subagent.stop' THEN CASE WHEN n % 3 = 0 THEN NULL ELSE n % 2 = 0 END END",
        "error_type": "CASE WHEN kind = 'llm.error' THEN concat('http_', 400 + k % 4) WHEN kind = 'tool.result' AND k % 5 = 0 THEN 'tool_error' END",
        "agent_id": "CASE WHEN n IS NOT NULL THEN concat('a', n) WHEN kind IN ('tool.pre', 'tool.result') AND source = 'hook' AND k % 3 = 0 THEN concat('a', k % 10) END",
        "parent_agent_id": "CASE WHEN kind = 'subagent.start' THEN CASE WHEN n = 3 AND user_id % 13 = 0 THEN 'a9' WHEN n >= 3 THEN concat('a', n div 3) END END",
        "agent_type": "CASE WHEN n IS NOT NULL THEN element_at(array('explore', 'plan', 'review'), n % 3 + 1) END",
        "permission_mode": "CASE WHEN kind = 'permission.mode_changed' THEN 'acceptEdits' WHEN source = 'hook' THEN CASE k % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'plan' END END",
        "file_path": "CASE WHEN kind = 'tool.pre' AND tool_name IN ('Read', 'Edit') THEN concat('/f/', k) END",
        "request_id": "CASE WHEN kind = 'llm.request' THEN concat('r', event_id) END", "message_uuid": "cast(NULL as string)", "clock_skewed": "k % 50 = 49",
        "dedup_key": "concat('e:', event_id)", "attrs": "to_json(named_struct(" + ", ".join(f"'{a}', {e}" for a, e in attrs.items()) + "))",
    }
    return one.selectExpr(*[f"{e} AS {c}" for c, e in out.items()])


def prices(spark: SparkSession) -> DataFrame:
    """A price list with several dates and overlapping prefixes."""
    rows = spark.createDataFrame(PRICE_ROWS, "model string, effective_from string, i double, o double, r double, w double")
    money = lambda c: F.col(c).cast("decimal(12,6)")
    return rows.select(
        "model", F.to_date("effective_from").alias("effective_from"), F.lit("USD").alias("currency"), money("i").alias("input_per_mtok"), money("o").alias("output_per_mtok"),
        money("r").alias("cache_read_per_mtok"), money("w").alias("cache_write_per_mtok"), F.lit("repo").alias("source"),
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric series of every user: a cumulative token counter that restarts, a delta series and a gauge."""
    configure(spark)
    raw = spread(table(spark, sf_dir, "events"), "user_id").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # one order serves both: the counter is the sum so far without that up to its last restart
    own = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    raw = raw.withColumn("all", F.sum("cents").over(own))
    raw = raw.withColumn("total", F.col("all") - F.coalesce(F.last(F.when(F.col("k") == 0, F.col("all") - F.col("cents")), ignorenulls=True).over(own), F.lit(0)))
    kinds = F.explode(
        F.expr(
            """array(
            named_struct('name', 'claude_code.token.usage', 'value', cast(total as double), 'temporality', 'cumulative', 'a', 'input', 'm', 'opal-2', 'd', cast(NULL as string)),
            named_struct('name', element_at(array('claude_code.cost.usage', 'claude_code.lines_of_code.count', 'claude_code.active_time.total', 'claude_code.commit.count', 'claude_code.pull_request.count', 'claude_code.code_edit_tool.decision', 'other.thing'), k % 7 + 1),
                'value', cents / 100, 'temporality', 'delta', 'a', CASE WHEN k % 2 = 0 THEN 'added' ELSE 'removed' END, 'm', 'opal-2', 'd', CASE WHEN k % 3 = 0 THEN 'reject' ELSE 'accept' END),
            named_struct('name', 'claude_code.active_time.total', 'value', cast(k as double), 'temporality', CASE WHEN user_id % 2 = 0 THEN 'gauge' ELSE 'unspecified' END, 'a', 'user', 'm', cast(NULL as string), 'd', cast(NULL as string)))"""
        )
    ).alias("s")
    one = raw.select("event_id", "ts", "user_id", kinds).withColumn("attrs", F.to_json(F.expr("named_struct('decision', s.d, 'model', s.m, 'type', s.a, 'user', cast(user_id as string))")))
    return one.select(
        "ts", F.col("ts").alias("ingested_at"), F.col("s.name").alias("name"), F.when(F.col("user_id") % 5 == 0, "other_agent").otherwise("claude_code").alias("vendor"), F.concat(F.lit("s"), "user_id").alias("session_id"),
        F.col("s.value").alias("value"), F.col("s.temporality").alias("temporality"), F.sha2(F.concat("s.name", F.lit("|"), "attrs", "s.temporality"), 256).alias("series_hash"), "attrs", F.concat(F.lit("m:"), "event_id", F.lit(":"), "s.temporality").alias("dedup_key"),
    ).selectExpr(*[x.split()[0] for x in schemas.METRIC_SAMPLES.split(", ")])
