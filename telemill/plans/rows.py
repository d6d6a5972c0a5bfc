"""Registered queries of the rows that other queries only use: sources, cleaning and mapping, single filters and joins, facets, streaming jobs.

Inputs are derived from the driver's tables; results are rows, not counts.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import attributes as at
from telemill.functions import mapping as mp
from telemill.functions.percentiles import rounded
from telemill.operators import analytics as an
from telemill.operators import explorer as ex
from telemill.operators import filters as fi
from telemill.operators import ingest as ing
from telemill.operators import pricing as pr
from telemill.operators import quality as qu
from telemill.operators import retention as rt
from telemill.operators import rollups as ro
from telemill.operators import sessions as ss
from telemill.operators import subagents as sa
from telemill.operators import timeline as tl
from telemill.operators import tool_calls as tc
from telemill.plans.queries import (
    _D, _DOUBLED, _LOGS, _RKEY, _SE, _TC, BOTH, EV, MS, NOW, RH, SA, SE, START, TC, TOKENS, TU, Tables, _doubled, _ledger, _received, hook_bodies, log_bodies, metric_bodies, query, with_,
)
from telemill.sources import folders, hooks, otlp, tables
from telemill.streaming import calls, jobs

K = "CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER)"
RAW = f"raw AS (SELECT *, {K} AS k FROM events)"


def raw(t: Tables) -> DataFrame:
    """The driver's events with ``k`` of their props."""
    return t.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def folder(t: Tables, name: str) -> str:
    return f"{tables.shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources ---


@query("A3_histogram_samples", "SELECT 'latency_sum' AS name, 's' || user_id AS session_id, epoch_us(ts) AS ts, value, 'cumulative' AS temporality FROM events UNION ALL SELECT 'latency_count', 's' || user_id, epoch_us(ts), 2, 'cumulative' FROM events")
def _(t):
    rows = otlp.metrics(metric_bodies(t), _received())[0].where(F.col("name").startswith("latency_"))
    return rows.select("name", "session_id", "ts", "value", "temporality")


@query("A4_number_points", "SELECT 'claude_code.token.usage' AS name, 's' || user_id AS session_id, epoch_us(ts) AS ts, value FROM events UNION ALL SELECT 'depth', 's' || user_id, epoch_us(ts), event_id::DOUBLE FROM events")
def _(t):
    return otlp.metrics(metric_bodies(t), _received())[0].where(F.col("name").isin("claude_code.token.usage", "depth")).select("name", "session_id", "ts", "value")


def _one_log(attributes: Column | str, record: str = "", resource: str = "", scope: str = "", body: Column | None = None) -> Column:
    """A request with a single log record; attributes: the list's JSON."""
    parts = [f'{{"resourceLogs":[{{"resource":{{"attributes":[{resource}]}},"scopeLogs":[{{"scope":{{"attributes":[{scope}]}},"logRecords":[{{{record}"attributes":', attributes]
    parts += [',"body":{"stringValue":"', body, '"}'] if body is not None else []
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in [*parts, "}]}]}]}"]])


@query("A5_attribute_map", f"WITH {RAW} SELECT event_id, '{{\"id\":\"' || event_id || '\",\"tree\":{{\"a\":[{{\"b\":[{{\"c\":' || k || '}}]}},\"x\"]}},\"twice\":\"last\"}}' AS attrs FROM raw")
def _(t):
    """Lists in maps in lists, five levels of them, and a key that is there twice."""
    pair = lambda key, value: f'{{"key":"{key}","value":{value}}}'
    tree = '{"kvlistValue":{"values":[{"key":"a","value":{"arrayValue":{"values":[{"kvlistValue":{"values":[{"key":"b","value":{"arrayValue":{"values":[{"kvlistValue":{"values":[{"key":"c","value":{"intValue":"%s"}}]}}]}}}]}},{"stringValue":"x"}]}}}]}}'
    head, tail = tree.split("%s")
    text = F.concat(F.lit("[" + pair("twice", '{"stringValue":"first"}') + "," + '{"key":"id","value":{"stringValue":"'), F.col("event_id").cast("string"), F.lit('"}},{"key":"tree","value":' + head), F.col("k").cast("string"), F.lit(tail + "}," + pair("twice", '{"stringValue":"last"}') + "]"))
    got = otlp.log_records(raw(t).select(_one_log(text).alias("body")))
    return got.select(F.get_json_object("attrs", "$.id").cast("long").alias("event_id"), "attrs")


@query("A7_price_list", "SELECT p_type AS model, '2024-01-01' AS effective_from, 'USD' AS currency, 'repo' AS source, min(p_retailprice)::DECIMAL(12, 6)::DOUBLE AS input_per_mtok, 0::DOUBLE AS cache_read_per_mtok FROM part GROUP BY p_type")
def _(t):
    """Part types as models in a file without currency, source and cache prices."""
    path = folder(t, "prices")
    listed = t.raw("part").groupBy(F.col("p_type").alias("model")).agg(F.min("p_retailprice").alias("p"))
    one = F.struct("model", F.lit("2024-01-01").alias("effective_from"), F.col("p").alias("input_per_mtok"), F.col("p").alias("output_per_mtok"))
    listed.agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)  # a list is one JSON array; part has some types
    return tables.read_prices(t.spark, path).select("model", "effective_from", "currency", "source", "input_per_mtok", "cache_read_per_mtok")


@query("A9_event_table", with_("SELECT seq, epoch_us(ts) AS ts, session_id, kind, dedup_key FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'", EV))
def _(t):
    """Appended in two parts, then read by months."""
    path = folder(t, "event-table")
    for part in (0, 1):
        tables.append_events(t.events.where(F.col("seq") % 2 == part), path)
    return tables.read_events(t.spark, path, datetime(2024, 1, 5), datetime(2024, 1, 25)).select("seq", "ts", "session_id", "kind", "dedup_key")


@query("A10_metric_table", with_("SELECT dedup_key, epoch_us(ts) AS ts, name, value, temporality, '2024-01' AS sample_month FROM ms", EV + MS))
def _(t):
    """Written as a batch twice: the second write replaces the first."""
    path = folder(t, "sample-table")
    for _ in range(2):
        tables.append_samples(t.samples, path, 3)
    return t.spark.read.parquet(path).select("dedup_key", "ts", "name", "value", "temporality", "sample_month")


def _collected(t: Tables, stream: DataFrame, name: str, more=None) -> DataFrame:
    """All that a stream gives, with each batch's number."""
    path = folder(t, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch if more is None else more(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    jobs.run_available(stream, write, folder(t, f"{name}-checkpoint")).awaitTermination()
    return t.spark.read.parquet(path)


@query("A13_streamed_logs", with_(f"SELECT session_id, epoch_us(ts) AS ts, kind, vendor_seq {_LOGS}", EV))
def _(t):
    path = folder(t, "requests")
    log_bodies(t).select("body").repartition(3, "body").write.text(path)
    got = _collected(t, otlp.stream_bodies(t.spark, path, 1), "streamed-logs", lambda batch: otlp.logs(batch, _received())[0])
    return got.select("session_id", "ts", "kind", "vendor_seq")


@query("A14_event_scan", with_("SELECT seq, epoch_us(ts) AS ts FROM ev WHERE (ts > TIMESTAMP '2024-01-15' OR ts = TIMESTAMP '2024-01-15' AND seq > 500) AND session_id IN (SELECT session_id FROM se WHERE project IN ('p1', 'p2', 'p3'))", EV, SE))
def _(t):
    return ex.event_scan(t.events, (datetime(2024, 1, 15), 500), t.sessions.where(F.col("project").isin("p1", "p2", "p3"))).select("seq", "ts")


# --- single filters ---


@query("B1_or_set", with_("SELECT seq FROM ev WHERE tool_name IN ('Bash', 'Task')", EV))
def _(t):
    return fi.apply(t.events, fi.any_of("tool_name", ("Bash", "Task")), fi.any_of("kind", ())).select("seq")


@query("B2_array_overlap", with_("SELECT session_id FROM se WHERE list_has_any(models, ['quartz-1', 'none'])", EV, SE))
def _(t):
    return fi.apply(t.sessions, fi.overlaps("models", ("quartz-1", "none"))).select("session_id")


@query("B3_time_range", with_("SELECT seq FROM ev WHERE ts >= (SELECT min(ts) FROM ev WHERE seq % 100 = 7) AND ts <= (SELECT max(ts) FROM ev WHERE seq % 100 = 7)", EV))
def _(t):
    """Both ends are times of events, which belong to the range."""
    ends = t.events.where(F.col("seq") % 100 == 7).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return fi.apply(t.events, fi.between("ts", ends.a, ends.b)).select("seq")


@query("B4_text_search", with_("SELECT seq, 'percent' AS search FROM ev WHERE contains(lower(event_name || '%_' || session_id), 'y_1%_s') UNION ALL SELECT seq, 'case' FROM ev WHERE contains(lower(event_name || '%_' || session_id), 'mystery_1')", EV))
def _(t):
    """No character of the text is special."""
    rows = t.events.withColumn("label", F.concat("event_name", F.lit("%_"), "session_id"))
    one = fi.apply(rows, fi.text_search(["label"], "Y_1%_S")).select("seq", F.lit("percent").alias("search"))
    return one.unionByName(fi.apply(rows, fi.text_search(["label", "model"], "MYSTERY_1")).select("seq", F.lit("case").alias("search")))


@query("B6_equality", with_("SELECT seq FROM ev WHERE agent_id = 'a3'", EV))
def _(t):
    return fi.apply(t.events, fi.equals("agent_id", "a3"), fi.equals("prompt_id", None)).select("seq")


@query("B7_conjunction", with_("SELECT seq FROM ev WHERE vendor = 'claude_code' AND kind IN ('tool.pre', 'tool.result') AND ts >= TIMESTAMP '2024-01-10'", EV))
def _(t):
    return t.events.where(fi.both(fi.equals("vendor", "claude_code"), None, fi.any_of("kind", ("tool.pre", "tool.result")), fi.between("ts", datetime(2024, 1, 10)))).select("seq")


@query("B12_message_display", with_("SELECT session_id, epoch_us(ts) AS ts, kind, false AS allowed FROM ev WHERE source = 'hook' AND kind <> 'tool.pre' UNION ALL SELECT session_id, epoch_us(ts), CASE WHEN kind = 'tool.pre' THEN 'unknown' ELSE kind END, true FROM ev WHERE source = 'hook'", EV))
def _(t):
    """Tool calls reported as displayed messages: dropped, or kept as events of unknown kind."""
    bodies = hook_bodies(t).select(F.replace("body", F.lit('"hook_event_name":"PreToolUse"'), F.lit('"hook_event_name":"MessageDisplay"')).alias("body"))
    parts = [hooks.hooks(bodies, _received(), allow_message_display=x)[0].select("session_id", "ts", "kind", F.lit(x).alias("allowed")) for x in (False, True)]
    return parts[0].unionByName(parts[1])


@query("B13_session_required", with_(f"SELECT session_id, count(*) AS n, false AS rejected {_LOGS} AND user_id % 3 <> 0 GROUP BY ALL UNION ALL SELECT NULL, count(*), true {_LOGS} AND user_id % 3 = 0", EV))
def _(t):
    """Of a third of the sessions no record has an id, of another third only the resource has it."""
    user = F.regexp_extract("body", r'"session.id","value":\{"stringValue":"s(\d+)"', 1).cast("int")
    hidden = F.replace("body", F.lit('"session.id"'), F.lit('"no.id"'))
    moved = F.replace(hidden, F.lit('{"key":"service.name"'), F.concat(F.lit('{"key":"session.id","value":{"stringValue":"s'), user.cast("string"), F.lit('"}},{"key":"service.name"')))
    bodies = log_bodies(t).select(F.when(user % 3 == 0, hidden).when(user % 3 == 1, moved).otherwise(F.col("body")).alias("body"))
    rows, rejects = otlp.logs(bodies, _received())
    lost = rejects.agg(F.sum("points").alias("n")).select(F.lit(None).cast("string").alias("session_id"), "n", F.lit(True).alias("rejected"))
    return rows.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("rejected", F.lit(False)).unionByName(lost)


# --- reads, cleaning, mapping ---


def _variant(*pairs: tuple[str, Column | str]) -> Column:
    """VARIANT of an object; values: JSON texts."""
    parts: list = []
    for k, (name, value) in enumerate(pairs):
        parts += [F.lit(("{" if k == 0 else ",") + f'"{name}":'), F.lit(value) if isinstance(value, str) else value]
    return F.parse_json(F.concat(*parts, F.lit("}")))


@query("C1_typed_reads", f"WITH {RAW} SELECT event_id, event_type AS text, NULL::VARCHAR AS no_text, k::BIGINT AS whole, k::DOUBLE AS parsed, (CASE WHEN k % 2 = 0 THEN k ELSE -k END)::BIGINT AS cut, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM raw")
def _(t):
    k = F.col("k").cast("string")
    v = _variant(("s", F.concat(F.lit('"'), "event_type", F.lit('"'))), ("n", k), ("p", F.concat(F.lit('"'), k, F.lit('"'))), ("f", F.concat(F.when(F.col("k") % 2 == 0, "").otherwise("-"), k, F.lit(".75"))), ("b", F.when(F.col("k") % 3 == 0, "true").when(F.col("k") % 3 == 1, '"False"').otherwise('"maybe"')))
    rows = raw(t).select("event_id", v.alias("v"))
    v = F.col("v")
    return rows.select("event_id", at.variant_string(v, "s").alias("text"), at.variant_string(v, "n").alias("no_text"), at.variant_number(v, "n", "long").alias("whole"), at.variant_number(v, "p").alias("parsed"), at.variant_number(v, "f", "long").alias("cut"), at.variant_bool(v, "b").alias("flag"))


@query("C2_string_like", f"WITH {RAW} SELECT event_id, event_type AS s, k::VARCHAR AS n, (k * 1000000)::VARCHAR AS e, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS b, NULL::VARCHAR AS none FROM raw")
def _(t):
    k = F.col("k").cast("string")
    rows = raw(t).select("event_id", _variant(("s", F.concat(F.lit('"'), "event_type", F.lit('"'))), ("n", k), ("e", F.concat(k, F.lit("e6"))), ("b", F.when(F.col("k") % 2 == 0, "true").otherwise("false"))).alias("v"))
    return rows.select("event_id", *[at.string_like(F.col("v"), c).alias(c) for c in ("s", "n", "e", "b", "none")])


@query("C3_merged_attributes", f"WITH {RAW} SELECT event_id, 'r' AS resource_x, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE 'scope' END AS x, 'scope' AS y, event_type AS body FROM raw")
def _(t):
    """The same name in resource, scope and, for even k, record."""
    text = lambda key, value: f'{{"key":"{key}","value":{{"stringValue":"{value}"}}}}'
    own = F.concat(F.lit('[{"key":"id","value":{"stringValue":"'), F.col("event_id").cast("string"), F.lit('"}}'), F.when(F.col("k") % 2 == 0, F.concat(F.lit(',{"key":"x","value":{"stringValue":"'), F.col("k").cast("string"), F.lit('"}}'))).otherwise(""), F.lit("]"))
    rows = otlp.log_records(raw(t).select(_one_log(own, resource=text("x", "r"), scope=text("x", "scope") + "," + text("y", "scope"), body=F.col("event_type")).alias("body")))
    return rows.select(at.attr("attrs", "id").cast("long").alias("event_id"), at.attr("attrs", "resource.x").alias("resource_x"), at.attr("attrs", "x").alias("x"), at.attr("attrs", "y").alias("y"), at.attr("attrs", "body").alias("body"))


@query("C4_clean_text", "SELECT event_id, event_type || '�' || user_id AS clean FROM events")
def _(t):
    return t.raw("events").select("event_id", at.clean_text(F.concat("event_type", F.char(F.lit(0)), F.col("user_id").cast("string"))).alias("clean"))


@query("C5_clean_number", f"WITH {RAW} SELECT event_id, CASE k % 4 WHEN 0 THEN '\"NaN\"' WHEN 1 THEN '\"+Inf\"' WHEN 2 THEN '\"-Inf\"' ELSE (k + 0.5)::DOUBLE::VARCHAR END AS clean FROM raw")
def _(t):
    k = F.col("k")
    x = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf")).when(k % 4 == 2, float("-inf")).otherwise(k + 0.5)
    return raw(t).select("event_id", at.clean_number(x).alias("clean"))


@query("C6_clean_payload", "SELECT event_id, '{\"a\":[\"' || event_type || '�\",{\"b\":\"\\\\u0000' || user_id || '\"}]}' AS clean FROM events")
def _(t):
    """An escaped NUL is replaced wherever it is; a backslash before u0000 is none."""
    return t.raw("events").select("event_id", at.clean_json(F.concat(F.lit('{"a":["'), "event_type", F.lit('\\u0000",{"b":"\\\\u0000'), F.col("user_id").cast("string"), F.lit('"}]}'))).alias("clean"))


@query("C7_event_names", f"WITH {RAW} SELECT event_id, CASE k % 4 WHEN 0 THEN event_type WHEN 1 THEN 'attr' || k WHEN 2 THEN 'body' || k ELSE repeat('é', 255) END AS name FROM raw")
def _(t):
    k = F.col("k")
    rows = raw(t).withColumn("v", _variant(("event.name", F.when(k % 4 == 1, F.concat(F.lit('"claude_code.attr\\n'), k.cast("string"), F.lit('"'))).otherwise("1"))))
    record = F.when(k % 4 == 0, F.concat(F.lit("claude_code."), "event_type")).when(k % 4 == 3, F.repeat(F.lit("é"), 300)).otherwise("")
    return rows.select("event_id", mp.event_name(record, F.col("v"), F.when(k % 4 == 2, F.concat(F.lit("body\r"), k.cast("string")))).alias("name"))


@query("C8_vendors", f"WITH {RAW} SELECT event_id, CASE k % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' ELSE event_type END AS vendor FROM raw")
def _(t):
    k = F.col("k") % 4
    return raw(t).select("event_id", mp.vendor_of(F.when(k == 0, "claude-code").when(k == 1, "").when(k == 3, F.col("event_type"))).alias("vendor"))


@query("C9_log_times", f"WITH {RAW} SELECT event_id, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 4 = 0 THEN epoch_us(date_trunc('second', ts)) + k * 1000000 ELSE epoch_us(ts) END AS ts, k % 4 = 2 AND k > 5 AS apart FROM raw")
def _(t):
    """Nanoseconds, a text, both with k seconds between them, or neither."""
    k, ts = F.col("k"), F.col("ts").cast("timestamp")
    nanos = F.when(k % 4 == 0, "0").when(k % 4 == 3, F.lit(None)).otherwise(F.concat(F.unix_micros(ts).cast("string"), F.lit("999")))
    late = F.timestamp_micros(F.unix_micros(F.when(k % 4 == 0, F.date_trunc("second", ts)).otherwise(ts)) + k * 1_000_000)
    text = F.when(k % 4 == 0, F.date_format(late, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 2, F.date_format(late, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    got, apart = mp.timestamp_of(nanos, text)
    return raw(t).select("event_id", got.alias("ts"), apart.alias("apart"))


@query("C10_hook_times", f"WITH {RAW} SELECT 'h' || event_id AS session_id, CASE WHEN k % 3 = 0 THEN epoch_us(ts) ELSE epoch_us(TIMESTAMP '2024-01-31') END AS ts FROM raw")
def _(t):
    """A timestamp, none, or one that is no time."""
    k = F.col("k") % 3
    stamp = F.when(k == 0, F.concat(F.lit(',"timestamp":"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"'))).when(k == 1, ',"timestamp":"soon"').otherwise("")
    bodies = raw(t).select(F.concat(F.lit('{"hook_event_name":"Stop","session_id":"h'), F.col("event_id").cast("string"), F.lit('"'), stamp, F.lit("}")).alias("body"))
    return hooks.hooks(bodies, _received())[0].select("session_id", "ts")


@query("C12_log_rows", with_(f"SELECT session_id, epoch_us(ts) AS ts, vendor_seq, kind, model, cost_source, CASE WHEN kind = 'hook.execution_end' THEN NULL ELSE success END AS success, CASE WHEN kind <> 'hook.execution_end' THEN duration_ms::BIGINT END AS duration_ms, decision, decision_source, error_type, query_source, permission_mode, output_tokens, cache_read_tokens, cache_creation_tokens {_LOGS}", EV))
def _(t):
    return otlp.logs(log_bodies(t), _received())[0].select("session_id", "ts", "vendor_seq", "kind", "model", "cost_source", "success", "duration_ms", "decision", "decision_source", "error_type", "query_source", "permission_mode", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


@query("C14_costs", f"WITH {RAW} SELECT event_id, CASE k % 3 WHEN 0 THEN k::DOUBLE WHEN 1 THEN k / 2.0::DOUBLE END::DOUBLE AS cost_usd FROM raw")
def _(t):
    """Millionths win over the amount; neither gives null."""
    k = F.col("k")
    v = _variant(("a", "1"), ("cost_usd_micros", F.when(k % 3 == 0, (k * 1_000_000).cast("string")).otherwise("null")), ("cost_usd", F.when(k % 3 < 2, (k / 2).cast("string")).otherwise("null")))
    rows = raw(t).select("event_id", v.alias("v"))
    return rows.select("event_id", mp.log_columns(F.lit("api_request"), F.col("v"))["cost_usd"].alias("cost_usd"))


@query("C15_hook_paths", f"WITH {RAW} SELECT event_id, CASE k % 4 WHEN 0 THEN '/p/' || k WHEN 1 THEN '/q/' || k END AS file_path FROM raw")
def _(t):
    """By tool: file_path, path, a tool without files, an input without either."""
    k = F.col("k")
    tool = F.element_at(F.array(*map(F.lit, ["Read", "Glob", "Bash", "Edit"])), k % 4 + 1)
    given = F.when(k % 4 == 0, F.concat(F.lit('{"file_path":"/p/'), k.cast("string"), F.lit('","path":"/no"}'))).when(k % 4 == 1, F.concat(F.lit('{"path":"/q/'), k.cast("string"), F.lit('"}'))).when(k % 4 == 2, '{"file_path":"/no"}').otherwise("{}")
    rows = raw(t).select("event_id", _variant(("tool_name", F.concat(F.lit('"'), tool, F.lit('"'))), ("tool_input", given)).alias("v"))
    return rows.select("event_id", mp.hook_columns(F.lit("PreToolUse"), F.col("v"))["file_path"].alias("file_path"))


@query("C16_hook_success", f"WITH {RAW} SELECT event_id, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 2 = 0 AND k % 5 = 0 END AS success FROM raw")
def _(t):
    k = F.col("k")
    rows = raw(t).select("event_id", _variant(("num_non_blocking_error", (k % 2).cast("string")), ("num_cancelled", F.when(k % 3 == 0, "null").otherwise((k % 5).cast("string")))).alias("v"))
    return rows.select("event_id", mp.hook_success(F.col("v")).alias("success"))


@query("C17_temporality", f"WITH {RAW} SELECT event_id, ['unspecified', 'delta', 'cumulative', 'delta', 'cumulative', 'unspecified'][k % 6 + 1] AS temporality FROM raw")
def _(t):
    code = F.element_at(F.array(*map(F.lit, ["0", "1", "2", "AGGREGATION_TEMPORALITY_DELTA", "aggregation_temporality_cumulative", "other"])), F.col("k") % 6 + 1)
    return raw(t).select("event_id", mp.temporality(code).alias("temporality"))


_CANON = "'{\"k\":' || k || '}'"


def _canon() -> Column:
    return F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.lit("}"))


@query("C18_log_key_rows", f"WITH {RAW} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'otel:s' || user_id || ':' || event_id || ':' || event_type || ':' ELSE 'otel:s' || user_id || ':h:' END || left(sha256({_CANON}), 32) AS key FROM raw")
def _(t):
    session = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    return raw(t).select("event_id", mp.log_key(session, F.when(F.col("k") % 2 == 0, F.col("event_id")), F.col("event_type"), _canon()).alias("key"))


@query("C19_metric_keys", f"WITH {RAW} SELECT event_id, 'metric:' || left(sha256(event_type || '|' || epoch_us(ts) || '|' || {_CANON}), 32) AS key FROM raw")
def _(t):
    return raw(t).select("event_id", mp.metric_key(F.col("event_type"), F.col("ts").cast("timestamp"), _canon()).alias("key"))


@query("C20_hook_keys", f"WITH {RAW} SELECT event_id, 'hook:' || left(sha256(event_type || '|s' || user_id || '|' || CASE WHEN k % 2 = 0 THEN 'p' || k ELSE '' END || '|' || {_CANON}), 32) AS key FROM raw")
def _(t):
    k = F.col("k")
    return raw(t).select("event_id", mp.hook_key(F.col("event_type"), F.concat(F.lit("s"), F.col("user_id").cast("string")), F.when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"))), _canon()).alias("key"))


@query("C21_series_keys", f"WITH {RAW} SELECT event_id, sha256(event_type || '|' || {_CANON}) AS key FROM raw")
def _(t):
    return raw(t).select("event_id", mp.series_key(F.col("event_type"), _canon()).alias("key"))


@query("C22_canonical_rows", f"WITH {RAW} SELECT event_id, '{{\"a\":{{\"user\":\"' || user_id || '\",\"z\":1}},\"k\":' || k || '}}' AS json FROM raw")
def _(t):
    text = F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit(',"a":{"z":1,"user": "'), F.col("user_id").cast("string"), F.lit('"}}'))
    return raw(t).select("event_id", at.canonical_json(text).alias("json"))


@query("C24_bucket_floor", "SELECT event_id, epoch_us(date_trunc('hour', ts)) AS hour, epoch_us(date_trunc('day', ts)::TIMESTAMP) AS day FROM events")
def _(t):
    rows = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", ro.hour("ts").alias("hour"), F.date_trunc("day", F.col("ts")).alias("day"))


@query("C27_session_duration", with_("SELECT session_id, CASE WHEN started_at IS NOT NULL THEN floor((epoch_us(coalesce(ended_at, last_event_at)) - epoch_us(started_at)) / 1000)::BIGINT END AS duration_ms FROM se", EV, SE))
def _(t):
    return t.sessions.select("session_id", ex.duration_ms().alias("duration_ms"))


@query("C28_estimated_share", with_("SELECT project, model, round(CASE WHEN r + e <> 0 THEN e / (r + e) ELSE 0 END, 8) AS share FROM (SELECT project, model, sum(cost_reported_usd)::DOUBLE AS r, sum(cost_estimated_usd)::DOUBLE AS e FROM rh GROUP BY ALL)", EV, TC, SE, RH))
def _(t):
    sums = t.hourly.groupBy("project", "model").agg(F.sum("cost_reported_usd").alias("cost_reported_usd"), F.sum("cost_estimated_usd").alias("cost_estimated_usd"))
    return sums.select("project", "model", F.round(an.estimated_share(), 8).alias("share"))


@query("C29_token_price", "SELECT l_orderkey, l_linenumber, round(1e6 * ((l_quantity::BIGINT * 1.5::DOUBLE / 1e6 + l_partkey * 7.5::DOUBLE / 1e6) + l_suppkey * 0.15::DOUBLE / 1e6 + l_linenumber * 1.875::DOUBLE / 1e6), 6) AS millionths FROM lineitem")
def _(t):
    """Numbers of line items as numbers of tokens."""
    prices = {"input_per_mtok": 1.5, "output_per_mtok": 7.5, "cache_read_per_mtok": 0.15, "cache_write_per_mtok": 1.875}
    rows = t.raw("lineitem").withColumns({k: F.lit(v) for k, v in prices.items()})
    cost = pr.token_cost(F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", F.round(cost * 1e6, 6).alias("millionths"))


@query("C30_rounding", f"WITH {RAW} SELECT event_id, CASE WHEN k >= 50 THEN (k - 50 + 1) // 2 ELSE -((50 - k + 1) // 2) END::BIGINT AS whole FROM raw")
def _(t):
    """Halves go away from zero."""
    return raw(t).select("event_id", rounded((F.col("k") - 50) / 2).alias("whole"))


# --- single joins ---


@query("J1_event_projects", with_("SELECT seq, project FROM ev LEFT JOIN (SELECT session_id, project FROM se WHERE event_count > 60) se USING (session_id)", EV, SE))
def _(t):
    """Sessions of few events are left out, so that some events have none."""
    return ro.with_home(t.events, t.sessions.where(F.col("event_count") > 60), "project").select("seq", "project")


@query("J2_call_homes", with_("SELECT tc.id, se.project, se.vendor FROM tc LEFT JOIN se USING (session_id)", EV, TC, SE))
def _(t):
    return ro.with_home(t.tool_calls, t.sessions, "project", "vendor").select("id", "project", "vendor")


@query("J3_sample_projects", with_("SELECT dedup_key, project FROM ms LEFT JOIN se USING (session_id)", EV, SE, MS))
def _(t):
    return ro.with_home(t.samples, t.sessions, "project").select("dedup_key", "project")


@query("J4_semi_join", with_("SELECT session_id FROM se WHERE session_id IN (SELECT session_id FROM tc WHERE decision IN ('reject'))", EV, TC, SE))
def _(t):
    return fi.exists(t.sessions, t.tool_calls, {"session_id": "session_id"}, "decision", ("reject",)).select("session_id")


@query("J5_anti_join", with_("SELECT DISTINCT project FROM rm WHERE project <> '' AND vendor = 'claude_code' AND bucket >= TIMESTAMP '2024-01-10' AND bucket < TIMESTAMP '2024-01-12' AND project NOT IN (SELECT project FROM rh WHERE vendor = 'other_agent' AND project IN ('p1', 'p2') AND bucket >= TIMESTAMP '2024-01-10' AND bucket < TIMESTAMP '2024-01-12')", BOTH))
def _(t):
    """Events of any vendor count against a project, whatever vendor is asked for."""
    rollup = t.both.where((F.col("source") == "metric") | F.col("project").isin("p1", "p2") & (F.col("vendor") == "other_agent"))
    return an.metrics_only_projects(rollup, an.Query(NOW, datetime(2024, 1, 10), datetime(2024, 1, 12), vendors=("claude_code",)))


@query("J6_unseen_keys", with_("SELECT dedup_key FROM ev WHERE seq % 7 <> 0", EV))
def _(t):
    return ing.survivors(t.events, _ledger(t)).select("dedup_key")


@query("J7_last_before", with_("SELECT series, epoch_us(max(ts)) AS last_ts, arg_max(value, row(ts, dedup_key)) AS last_value FROM (SELECT *, user_id::VARCHAR AS s FROM ms) WHERE temporality = 'cumulative' AND ts < TIMESTAMP '2024-01-15' GROUP BY series".replace("SELECT series,", "SELECT any_value(s) AS user,"), EV + MS))
def _(t):
    """Each series' last sample strictly before a time."""
    rows = t.samples.where(F.col("ts") < F.lit(datetime(2024, 1, 15)))
    users = t.samples.select("series_hash", at.attr("attrs", "user").alias("user")).distinct()
    return ro.series_checkpoint(rows).join(users, "series_hash").select("user", "last_ts", "last_value")


@query("J8_longest_prefix", "WITH m AS (SELECT DISTINCT p_type AS model FROM part), p AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS pm FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) FROM part WHERE p_type < 'P' UNION SELECT DISTINCT p_type FROM part WHERE p_type > 'STANDARD P') SELECT model, arg_max(pm, length(pm)) AS price_model FROM m JOIN p ON starts_with(model, pm) GROUP BY model")
def _(t):
    """Types as models; lists for first words, for two words of some, for whole types of others."""
    types = t.raw("part").select(F.col("p_type").alias("model")).distinct()
    word = lambda n: F.substring_index("model", " ", n)
    listed = types.select(word(1).alias("model")).union(types.where(F.col("model") < "P").select(word(2))).union(types.where(F.col("model") > "STANDARD P")).distinct()
    return pr.price_models(types, listed)


_SPAWN = f"WITH {RAW}, a AS (SELECT 'v' || event_id AS agent_id, 's' || user_id AS session_id, 'p' || (user_id % 3) AS prompt_id, ['explore', 'plan', 'review'][k % 3 + 1] AS kind, ts FROM raw WHERE event_type = 'view'), c AS (SELECT event_id, 's' || user_id AS session_id, 'p' || (user_id % 3) AS prompt_id, ['explore', 'plan', 'review'][k % 3 + 1] AS kind, CASE WHEN k % 4 > 0 THEN 'c' || (k % 4) END AS caller, ts FROM raw WHERE event_type = 'click') "


@query("J11_spawning_calls", _SPAWN + "SELECT a.session_id, agent_id, (arg_max(row(caller, 'u' || event_id), row(c.ts, event_id)))[1] AS found_parent, (arg_max(row(caller, 'u' || event_id), row(c.ts, event_id)))[2] AS spawn_tool_use_id FROM a JOIN c ON c.session_id = a.session_id AND c.prompt_id = a.prompt_id AND c.kind = a.kind AND c.ts <= a.ts GROUP BY ALL")
def _(t):
    """Views as agents that start, clicks as hook calls that ask for agents."""
    kind = F.element_at(F.array(*map(F.lit, ["explore", "plan", "review"])), F.col("k") % 3 + 1)
    home = [F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("prompt_id")]
    ts = F.col("ts").cast("timestamp")
    agents = raw(t).where(F.col("event_type") == "view").select(*home, F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("agent_id"), kind.alias("agent_type"), ts.alias("started_at"))
    calls = raw(t).where(F.col("event_type") == "click").select(
        *home, F.lit("tool.pre").alias("kind"), F.lit("hook").alias("source"), ts.alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("k") % 4 > 0, F.concat(F.lit("c"), (F.col("k") % 4).cast("string"))).alias("agent_id"),
        F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("tool_use_id"), F.to_json(F.struct(F.struct(kind.alias("subagent_type")).alias("tool_input"))).alias("attrs"),
    )
    return sa.infer_parents(agents, calls).select("session_id", "agent_id", "found_parent", "spawn_tool_use_id")


@query("J12_tree_levels", "WITH RECURSIVE a AS (SELECT DISTINCT conv_id::VARCHAR AS session_id, 't' || turn AS agent_id, CASE WHEN turn > 0 THEN 't' || ((turn - 1) // 2) END AS parent FROM conversations), tree AS (SELECT session_id, agent_id, 1 AS depth, agent_id AS path FROM a WHERE parent IS NULL UNION ALL SELECT a.session_id, a.agent_id, tree.depth + 1, tree.path || '/' || a.agent_id FROM tree JOIN a ON a.session_id = tree.session_id AND a.parent = tree.agent_id) SELECT session_id, agent_id, depth::BIGINT AS depth, path FROM tree")
def _(t):
    """Turns of a conversation as agents, each started by turn (n - 1) / 2."""
    turn = F.col("turn")
    agents = t.raw("conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("t"), turn.cast("string")).alias("agent_id"), F.when(turn > 0, F.concat(F.lit("t"), F.floor((turn - 1) / 2).cast("string"))).alias("parent_agent_id")).distinct()
    return sa.tree_rows(agents).select("session_id", "agent_id", "depth", "path")


@query("J13_merged_rows", with_(f"SELECT {_RKEY}, tool_calls, tool_rejects, {', '.join(TOKENS)}, {_D('cost_reported_usd')}, {', '.join(f'un_{c} AS uncosted_{c}' for c in TOKENS)} FROM rb", EV, TC, SE, RH))
def _(t):
    both = ro.merged_rollup(ro.event_rollup(t.events, t.sessions), ro.tool_rollup(t.tool_calls, t.sessions))
    return both.select(*ro.ROLLUP_KEY, "tool_calls", "tool_rejects", *TOKENS, "cost_reported_usd", *[f"uncosted_{c}" for c in TOKENS])


@query("J14_counters", with_("SELECT se.session_id, (SELECT count(*) FROM tu WHERE tu.session_id = se.session_id) AS turn_count, (SELECT count(*) FROM tc WHERE tc.session_id = se.session_id) AS tool_call_count, (SELECT count(*) FROM tc WHERE tc.session_id = se.session_id AND decision = 'reject') AS tool_reject_count, (SELECT count(*) FROM sa WHERE sa.session_id = se.session_id) AS subagent_count FROM se", EV, TC, SE, TU, SA))
def _(t):
    return t.counted_sessions.select("session_id", "turn_count", "tool_call_count", "tool_reject_count", "subagent_count")


# --- ingest, folds, rollups: rows where other queries count ---


@query("I3_second_line", with_("SELECT dedup_key, epoch_us(ts) AS ts, min(seq) AS seq FROM dbl GROUP BY ALL", EV, ", ", _DOUBLED))
def _(t):
    return ing.first_of_key(_doubled(t), "ts", "dedup_key").select("dedup_key", "ts", "seq")


@query("I7_landed_rows", with_("SELECT seq, NOT old AND row_number() OVER (PARTITION BY dedup_key, old ORDER BY ts, seq) = 1 AND dedup_key NOT IN (SELECT dedup_key FROM ev WHERE seq % 7 = 0) AS landed FROM dbl", EV, ", ", _DOUBLED))
def _(t):
    got = ing.outcome(_doubled(t), _ledger(t), rt.covered_months(t.events, START, NOW))
    return got.select("seq", (F.col("outcome") == "written").alias("landed"))


@query("D3_field_sources", with_("SELECT session_id, cwd, project, start_type, end_reason, app_version, terminal_type, user_email, permission_mode FROM se", EV, SE))
def _(t):
    """Values that a source must not give are added to events of the other sources: they change nothing."""
    noise = F.when(F.col("source") == "otel_log", F.regexp_replace("attrs", r"^\{", '{"cwd":"/x/bad","source":"bad","reason":"bad",')).otherwise(F.regexp_replace("attrs", r"^\{", '{"app.version":"bad","terminal.type":"bad","user.email":"bad",'))
    noisy = t.events.withColumn("attrs", F.replace(noise, F.lit(",}"), F.lit("}")))
    return ss.fold_sessions(noisy).select("session_id", "cwd", "project", "start_type", "end_reason", "app_version", "terminal_type", "user_email", "permission_mode")


@query("D29_rebuilt_sessions", with_(f"SELECT {_SE} FROM se", EV, SE))
def _(t):
    """Stored sessions of a part of the events, rebuilt from all."""
    stale = ss.fold_sessions(t.events.where(F.col("seq") % 3 == 0))
    got = ss.rebuild(stale, t.events, ss.touched(t.events, START), ss.fold_sessions)
    return got.drop("cost_by_query_source", "entrypoint", "user_account_uuid", "organization_id")


@query("D30_rebuilt_turns", with_("SELECT session_id, prompt_id, CASE WHEN session_id IN (SELECT session_id FROM ev WHERE ts >= TIMESTAMP '2024-01-30') THEN api_request_count ELSE -1 END AS api_request_count, epoch_us(last_event_at) AS last_event_at FROM tu", EV, TU))
def _(t):
    """Stored turns with a wrong count: those of the touched sessions are folded anew, all others stay."""
    stale = t.turns.withColumn("api_request_count", F.lit(-1).cast("long"))
    got = ss.rebuild(stale, t.events, ss.touched(t.events, datetime(2024, 1, 30)), ss.fold_turns)
    return got.select("session_id", "prompt_id", "api_request_count", "last_event_at")


@query("E18_guarded_buckets", with_("SELECT DISTINCT epoch_us(date_trunc('hour', ts)) AS bucket, 'event' AS source FROM ev", EV))
def _(t):
    dirty = ro.dirty_buckets(t.events)
    older = dirty.withColumn("bucket", F.col("bucket") - F.expr("INTERVAL 400 DAY"))
    return ro.with_raw_data(dirty.unionByName(older), rt.covered_months(t.events, START, NOW)).select("bucket", "source")


@query("E19_rows_of_buckets", with_("SELECT seq FROM ev WHERE date_trunc('hour', ts) IN (SELECT DISTINCT date_trunc('hour', ts) AS b FROM ev WHERE extract('hour' FROM ts) % 5 = 0)", EV))
def _(t):
    dirty = ro.dirty_buckets(t.events).where(F.hour("bucket") % 5 == 0)
    return ro.rows_of(t.events, dirty).select("seq")


# --- timeline and facets ---

_MOMENTS = """, keyed AS (SELECT *, epoch_us(ts) AS us, CASE WHEN tool_use_id <> '' THEN 'tool_use_id:' || tool_use_id WHEN request_id <> '' THEN 'request_id:' || request_id WHEN agent_id <> '' THEN 'agent_id:' || agent_id WHEN prompt_id <> '' THEN 'prompt_id:' || prompt_id ELSE 'seq:' || seq END AS key FROM ev),
placed AS (SELECT *, row_number() OVER w AS n FROM keyed WHERE NOT clock_skewed WINDOW w AS (PARTITION BY session_id, kind, key ORDER BY us, vendor_seq NULLS LAST, seq)),
placed2 AS (SELECT *, min(n) OVER (PARTITION BY session_id, kind, key ORDER BY us RANGE BETWEEN 2000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_n FROM placed),
anchors AS (SELECT session_id, kind, key, n, next_n, seq FROM placed2 WHERE n = 1 UNION ALL SELECT p.session_id, p.kind, p.key, p.n, p.next_n, p.seq FROM anchors a JOIN placed2 p ON p.session_id = a.session_id AND p.kind = a.kind AND p.key = a.key AND p.n = a.next_n),
moments AS (SELECT p.* EXCLUDE (next_n, n, us, key), a.seq AS moment FROM placed2 p JOIN anchors a ON p.session_id = a.session_id AND p.kind = a.kind AND p.key = a.key AND p.n >= a.n AND (a.next_n IS NULL OR p.n < a.next_n) UNION ALL SELECT * EXCLUDE (us, key), seq AS moment FROM keyed WHERE clock_skewed)"""


def _first_of_rank(c: str) -> str:
    return f"arg_max({c}, row(rank, -epoch_us(ts), -seq)) FILTER (WHERE {c} IS NOT NULL) AS {c}"


def _moments_sql(columns: str) -> str:
    return f"WITH RECURSIVE {EV}{_MOMENTS} SELECT session_id, kind, moment, {columns} FROM moments GROUP BY session_id, kind, moment"


@query("H1_moments", _moments_sql("epoch_us(min(ts)) AS ts, count(*) AS members, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources"))
def _(t):
    return tl.collapse(t.events).select("session_id", "kind", "moment", "ts", "members", "sources")


@query("H2_ranked_moment_fields", _moments_sql(", ".join(map(_first_of_rank, ("tool_name", "decision", "permission_mode", "agent_type", "file_path", "success")))))
def _(t):
    return tl.collapse(t.events).select("session_id", "kind", "moment", "tool_name", "decision", "permission_mode", "agent_type", "file_path", "success")


@query("Q2_vendors", with_("SELECT DISTINCT vendor AS value FROM se", EV, SE))
def _(t):
    return qu.facet(t.sessions, "vendor")


@query("Q3_models", with_("SELECT DISTINCT unnest(models) AS value FROM se", EV, SE))
def _(t):
    return qu.facet(t.sessions.select(F.explode("models").alias("m")), "m")


@query("Q4_tools", with_("SELECT DISTINCT tool_name AS value FROM tc", EV, TC))
def _(t):
    return qu.facet(t.tool_calls, "tool_name")


@query("Q5_decision_sources", with_("SELECT DISTINCT decision_source AS value FROM tc WHERE decision_source IS NOT NULL", EV, TC))
def _(t):
    return qu.facets(t.sessions, t.tool_calls).where(F.col("facet") == "decision_sources").select("value")


@query("Q6_query_sources", with_("SELECT DISTINCT qs AS value FROM cm", EV, SE))
def _(t):
    return qu.facets(t.sessions, t.tool_calls).where(F.col("facet") == "query_sources").select("value")


# --- streams: files of events arrive, jobs run until all is taken ---


#: Rows of a file of a stream, about.
FILE_ROWS = 200_000


def _stream(t: Tables, rows: DataFrame, files: int = 3, name: str = "arriving") -> DataFrame:
    """A stream of ``rows`` in the order of their receipt, an arrival a batch; large arrivals are some files each, of which a task takes one or few."""
    path, at = folder(t, name), F.unix_micros("ingested_at")
    ends = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    place = F.lit(0) if ends.lo is None or ends.lo == ends.hi else F.least(F.floor((at - ends.lo) / (ends.hi - ends.lo) * files), F.lit(files - 1))
    sizes = {r[0]: r[1] for r in rows.groupBy(place.alias("place")).count().collect()}  # a number for each arrival
    # all arrivals have as many files, so that a batch is an arrival: a small one has empty files beside its own
    parts = max(1, -(-max(sizes.values(), default=0) // FILE_ROWS))
    empty = None
    count = lambda: sum(x.endswith(".parquet") for x in folders.children(t.spark, path))
    for k in range(files):  # one after the other, so that the files' times follow the rows'
        arrival = rows.where(place == k)
        own = min(parts, sizes.get(k, 0) // 100)  # files that surely get rows
        (arrival.coalesce(1) if own <= 1 else arrival.repartition(own)).write.mode("append").parquet(path)
        lacking = (k + 1) * parts - count()
        if lacking:
            if empty is None:
                aside = folder(t, "empty")
                t.spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(aside)
                empty = next(f"{aside}/{x}" for x in folders.children(t.spark, aside) if x.endswith(".parquet"))
            for i in range(lacking):
                folders.copy(t.spark, empty, f"{path}/empty-{k}-{i}.parquet")
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(path)


def _with_state_store(t: Tables) -> None:
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)


@query("S1_streamed_dedup", with_("SELECT dedup_key FROM ev", EV))
def _(t):
    """Every third event comes a second time, within the window."""
    twice = t.events.unionByName(t.events.where(F.col("seq") % 3 == 0))
    return _collected(t, jobs.deduplicated(_stream(t, twice)), "streamed-dedup").select("dedup_key")


@query("S2_live_hours", with_("SELECT epoch_us(date_trunc('hour', ts)) AS bucket, vendor, kind, count(*) AS n FROM ev GROUP BY ALL", EV))
def _(t):
    """The last state of every hour that the live view has given out."""
    path = folder(t, "live-hours")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    jobs.live_hourly(_stream(t, t.events), late="2 days").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", folder(t, "live-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path).groupBy("bucket", "vendor", "kind").agg(F.max("n").alias("n"))


@query("S3_healed_hours", with_("SELECT epoch_us(date_trunc('hour', ts)) AS bucket, kind, count(*) AS n FROM ev GROUP BY ALL", EV))
def _(t):
    """Every fifth event arrives last of all; its hour is then counted anew."""
    late = t.events.withColumn("ingested_at", F.when(F.col("seq") % 5 == 0, F.lit(NOW)).otherwise(F.col("ingested_at")))
    events, rollup = folder(t, "healed-events"), folder(t, "healed-hours")
    fold = lambda e: e.groupBy(ro.hour("ts").alias("bucket"), "kind").agg(F.count("*").alias("n")).withColumn("source", F.lit("event"))
    store, heal = jobs.store_batch(events, t.spark), jobs.heal(t.spark, events, fold, rollup)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch, batch_id)
        heal(batch, batch_id)

    jobs.run_available(_stream(t, late), write, folder(t, "heal-checkpoint")).awaitTermination()
    return t.spark.read.parquet(rollup).select("bucket", "kind", "n")


@query("S4_lifecycle", with_("SELECT session_id, CASE WHEN bool_or(kind = 'session.end') THEN 'ended' WHEN max(ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR THEN 'abandoned' WHEN bool_or(kind = 'session.start') THEN 'active' ELSE 'unknown' END AS status, epoch_us(date_trunc('millisecond', max(ts))) AS last_event_at FROM ev GROUP BY session_id", EV))
def _(t):
    """Each session's last status, with all events in one batch."""
    _with_state_store(t)
    path = folder(t, "lifecycle")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    jobs.lifecycle(_stream(t, t.events, 1)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", folder(t, "lifecycle-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    rank = F.struct("last_event_at", F.col("status") != "active", F.col("status") == "abandoned")
    return t.spark.read.parquet(path).groupBy("session_id").agg(F.max_by("status", rank).alias("status"), F.max("last_event_at").alias("last_event_at"))


@query("S5_counter_deltas", with_("SELECT user_id::VARCHAR AS user, epoch_us(ts) AS ts, value, delta FROM md WHERE temporality = 'cumulative'", EV + MS))
def _(t):
    """Three batches, with samples of all times in each: differences are given out again when a late sample comes before them."""
    _with_state_store(t)
    spread = t.samples.withColumn("ingested_at", F.timestamp_micros(F.unix_micros("ts") + F.pmod(F.xxhash64("dedup_key"), F.lit(40)) * 86_400_000_000))
    changes = _collected(t, jobs.counter_deltas(_stream(t, spread, name="samples"), 100 * 86_400_000), "counter-deltas")
    users = t.samples.select("series_hash", at.attr("attrs", "user").alias("user")).distinct()
    return jobs.latest_deltas(changes).join(users, "series_hash").select("user", "ts", "value", "delta")


@query("S6_streamed_calls", with_(f"SELECT {_TC} FROM tcw", EV, TC))
def _(t):
    """The rows that three batches have placed, folded at the end: calls go on over many days here, longer than the live projection looks back."""
    _with_state_store(t)
    rows = _collected(t, calls.placed(_stream(t, t.events)), "placed-rows")
    return tc.fold_placed(rows.drop("batch"))


@query("S7_feed_replay", with_("SELECT * FROM (SELECT seq, epoch_us(ts) AS ts, 'all' AS feed FROM ev WHERE ts > TIMESTAMP '2024-01-12' ORDER BY ts, seq LIMIT 700) UNION ALL SELECT * FROM (SELECT seq, epoch_us(ts), 'one' FROM ev WHERE session_id = 's5' AND ts > TIMESTAMP '2024-01-02' ORDER BY ts, seq LIMIT 700)", EV))
def _(t):
    """A follower of all sessions that stops after 400 events and resumes there, and one of a single session."""
    path = folder(t, "feed")
    jobs.live_feed(_stream(t, t.events), path, folder(t, "feed-checkpoint")).awaitTermination()
    first = jobs.replay(t.spark, path, (datetime(2024, 1, 12), 10**12), limit=400).select("seq", "ts")
    last = first.orderBy(F.desc("ts"), F.desc("seq")).first()
    rest = jobs.replay(t.spark, path, (last.ts, last.seq) if last else None, limit=300).select("seq", "ts")
    one = jobs.replay(t.spark, path, (datetime(2024, 1, 2), 10**12), "s5", 700).select("seq", "ts")
    return first.unionByName(rest).withColumn("feed", F.lit("all")).unionByName(one.withColumn("feed", F.lit("one")))


@query("S8_repeated_batches", with_("SELECT seq, dedup_key FROM ev", EV))
def _(t):
    """Every batch is written twice, as after a failure, and events come again within a batch."""
    path = folder(t, "repeated")
    store = jobs.store_batch(path, t.spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch, batch_id)
        store(batch, batch_id)

    again = t.events.where(F.col("seq") % 4 == 0).withColumn("seq", F.col("seq") + 10**9)
    jobs.run_available(_stream(t, t.events.unionByName(again)), write, folder(t, "repeated-checkpoint")).awaitTermination()
    return tables.read_events(t.spark, path).select("seq", "dedup_key")


@query("S9_streamed_clamp", with_("SELECT seq, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN epoch_us(TIMESTAMP '2024-01-31') ELSE epoch_us(ts) END AS ts, ts < TIMESTAMP '2024-01-11' AS clock_skewed FROM ev", EV))
def _(t):
    """Events that are older than the retention when they are received."""
    ts, odd = mp.clamped(F.col("ts"), _received(), 20)
    return _collected(t, _stream(t, t.events).select("seq", ts.alias("ts"), odd.alias("clock_skewed")), "clamped").select("seq", "ts", "clock_skewed")
