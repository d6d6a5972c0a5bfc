"""Readers and name mapping on small files of our own."""

import json
from datetime import datetime, timezone
from types import SimpleNamespace

from pyspark.sql import functions as F

from telemill import schemas
from telemill.functions.attributes import base_name, canonical_json, clean_json, clean_number, string_like, variant_bool, variant_number, variant_string
from telemill.operators import pricing, quality
from telemill.sources import hooks, otlp, tables

NOW = datetime(2024, 3, 1, 12, tzinfo=timezone.utc)


def kv(**values):
    kinds = {str: "stringValue", bool: "boolValue", int: "intValue", float: "doubleValue"}
    return [{"key": k.replace("__", "."), "value": {kinds[type(v)]: str(v) if type(v) is int else v}} for k, v in values.items()]


def log_bodies(spark, *records, resource=None):
    body = {"resourceLogs": [{"resource": {"attributes": resource if resource is not None else kv(service__name="claude-code")}, "scopeLogs": [{"logRecords": list(records)}]}]}
    return spark.createDataFrame([(json.dumps(body),)], "body string")


def nanos(seconds):
    return str(int((NOW.timestamp() + seconds) * 1e9))


def record(seconds=0, name=None, **attributes):
    out = {"timeUnixNano": nanos(seconds), "attributes": kv(session__id="s", **attributes)}
    return out | ({"eventName": name} if name else {})


def logs(spark, *records, **more):
    rows, rejects = otlp.logs(log_bodies(spark, *records, **more), F.lit(NOW))
    return rows.orderBy("ts", "event_name").collect(), rejects.collect()


def test_request_columns(spark):
    (r,), rejects = logs(spark, record(0, "claude_code.api_request", model="m", input_tokens="12", output_tokens=3, cost_usd_micros=1500000, duration_ms=12.9, event__sequence=7, prompt__id="p", cost_usd=9.0))
    assert (r.kind, r.model, r.input_tokens, r.output_tokens, float(r.cost_usd), r.cost_source, r.duration_ms, r.vendor_seq, r.prompt_id, r.success, r.vendor, r.event_name) == (
        "llm.request", "m", 12, 3, 1.5, "reported", 12, 7, "p", True, "claude_code", "api_request"
    )
    assert not rejects and r.dedup_key.startswith("otel:s:7:api_request:")


def test_names_and_sessions(spark):
    body = record(0) | {"body": {"stringValue": "claude_code.user_prompt"}}
    named = record(1, event__name="plugin_loaded")
    lost = {"timeUnixNano": nanos(2), "attributes": kv(event__name="user_prompt")}
    rows, rejects = logs(spark, body, named, lost)
    assert [(r.event_name, r.kind) for r in rows] == [("user_prompt", "turn.start"), ("plugin_loaded", "agent.plugin")]
    assert [(r.reason, r.points) for r in rejects] == [("missing session.id", 1)]
    rows, rejects = logs(spark, lost, resource=kv(session__id="of resource"))
    assert rows[0].session_id == "of resource" and rows[0].vendor == "unknown" and not rejects


def test_clock(spark):
    apart = record(0, "a", event__timestamp="2024-03-01T11:59:50Z")
    near = record(1, "b", event__timestamp="2024-03-01T11:59:59Z")
    future = record(7200, "c")
    attribute = {"attributes": kv(session__id="s", event__timestamp="2024-03-01T11:00:00Z", event__name="d")}
    rows, _ = logs(spark, apart, near, future, attribute)
    got = {r.event_name: (r.ts.replace(tzinfo=timezone.utc), r.clock_skewed) for r in rows}
    assert got["a"][1] and not got["b"][1] and got["c"] == (NOW, True) and got["d"] == (datetime(2024, 3, 1, 11, tzinfo=timezone.utc), False)


def test_unknown_name_and_last_of_equal_attributes(spark):
    twice = record(0, "strange", x="first")
    twice["attributes"] += kv(x="second")
    twice["attributes"] += [{"key": "deep", "value": {"kvlistValue": {"values": kv(a=1)}}}, {"key": "list", "value": {"arrayValue": {"values": [{"stringValue": "q"}, {"intValue": "2"}]}}}]
    (r,), _ = logs(spark, twice)
    attrs = json.loads(r.attrs)
    assert r.kind == "unknown" and attrs["x"] == "second" and attrs["deep"] == {"a": 1} and attrs["list"] == ["q", 2] and attrs["resource.service.name"] == "claude-code"


def test_the_last_of_equal_names_counts_in_a_new_session(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    request = {"resourceLogs": [{"resource": {"attributes": kv(x="r")}, "scopeLogs": [{"scope": {"attributes": kv(x="scope", y="scope")}, "logRecords": [{"attributes": kv(x="first") + kv(x="last")}, {"attributes": []}]}]}]}
    got = otlp.log_records(own.createDataFrame([(json.dumps(request),)], "body string")).collect()
    assert sorted(json.loads(r.attrs)["x"] for r in got) == ["last", "scope"] and all(json.loads(r.attrs)["resource.x"] == "r" for r in got)


def test_outcomes_are_the_events_and_rejects(spark):
    """Flat, nested, deep, too deep in either way, with underscores, without a session, and no request at all: each is one row, as in the two tables of ``logs``."""
    request = lambda attributes: json.dumps({"resourceLogs": [{"resource": {"attributes": kv(a="1")}, "scopeLogs": [{"logRecords": [{"eventName": "e", "attributes": attributes}]}]}]})
    listed = [{"key": "l", "value": {"arrayValue": {"values": [{"intValue": "1"}]}}}]
    more = lambda opening, closing: request([])[:-1] + f',"x":{opening}{closing}}}'
    deep, flat_deep, deeper = more('{"kvlistValue":' * 600 + "{}", "}" * 600), more("[" * 1001, "]" * 1001), more('{"arrayValue":[' * 600, "]}" * 600)
    snake = request(kv(session__id="snake") + listed).replace("resourceLogs", "resource_logs").replace("scopeLogs", "scope_logs").replace("logRecords", "log_records").replace("stringValue", "string_value").replace("arrayValue", "array_value")
    long = request(kv(session__id="long", text="x" * 2000) + listed)
    two = json.loads(request(kv(session__id="two")))
    two["resourceLogs"][0]["scopeLogs"] *= 2
    bodies = [request(kv(session__id="flat")), request(kv(session__id="nested") + listed), deep, flat_deep, deeper, snake, long, json.dumps(two), request(listed), request(kv(session__id="")), "[1]", '{"resourceLogs":"x"}', long[:-3], '{"resourceLogs":[]}', "{}", None]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = otlp.log_outcomes(frame).collect()
    events, rejects = otlp.logs(frame, F.lit(NOW))
    assert sorted(r.session_id for r in got if r.reason is None) == sorted(r.session_id for r in events.collect()) == ["flat", "long", "nested", "snake", "two", "two"]
    rejects = rejects.collect()
    some = lambda rows: sorted((r.reason, r.points) for r in rows if r.reason is not None)
    assert some(got) == some(rejects)
    bad = [r.record for r in rejects if r.reason == "unreadable body"]
    assert sorted(b or "" for b in bad) == sorted(b or "" for b in [deeper, flat_deep, "[1]", '{"resourceLogs":"x"}', long[:-3], None])
    assert sorted(r.record for r in rejects if r.reason == "missing session.id") == sorted(['{"resource.a":"1"}', '{"l":[1],"resource.a":"1"}', '{"resource.a":"1","session.id":""}'])


def test_hook_run_success(spark):
    rows, _ = logs(spark, *[record(i, "hook_execution_complete", **a) for i, a in enumerate([{"num_non_blocking_error": 0, "num_cancelled": 0}, {"num_non_blocking_error": 1, "num_cancelled": 0}, {"num_cancelled": 0}])])
    assert [r.success for r in rows] == [True, False, None]


def hook_rows(spark, *bodies, **more):
    rows, rejects = hooks.hooks(spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "body string"), F.lit(NOW), **more)
    return rows.orderBy("event_name").collect(), rejects.collect()


def test_hooks(spark):
    one = {"session_id": "s", "hook_event_name": "PreToolUse", "tool_name": "Glob", "tool_use_id": "u", "tool_input": {"path": "/x"}, "permission_mode": "odd mode"}
    many = [{"session_id": "s", "hook_event_name": "Stop"}, {"session_id": "t", "hook_event_name": "MessageDisplay"}, {"session_id": "t", "hook_event_name": "New"}]
    rows, rejects = hook_rows(spark, one, many)
    assert [(r.event_name, r.kind, r.file_path, r.success, r.permission_mode) for r in rows] == [("New", "unknown", None, None, None), ("PreToolUse", "tool.pre", "/x", None, "odd mode"), ("Stop", "turn.end", None, True, None)]
    assert not rejects and all(r.ts.replace(tzinfo=timezone.utc) == NOW for r in rows)
    assert len(hook_rows(spark, many, allow_message_display=True)[0]) == 3
    rows, rejects = hook_rows(spark, [one, {"hook_event_name": "Stop"}], {"session_id": ""}, "no json")
    assert not rows and sorted(r.points for r in rejects) == [1, 1, 2]


def test_hook_keys_ignore_the_order_of_fields(spark):
    a, b = '{"session_id":"s","hook_event_name":"Stop","x":{"p":1,"q":2}}', '{"x":{"q":2,"p":1},"hook_event_name":"Stop","session_id":"s"}'
    (r,), _ = hook_rows(spark, a)
    (q,), _ = hook_rows(spark, b)
    assert r.dedup_key == q.dedup_key and r.attrs == q.attrs


def test_metrics(spark):
    point = {"timeUnixNano": nanos(0), "attributes": kv(type="input", session__id="s")}
    data = [
        {"name": "n", "sum": {"aggregationTemporality": 2, "dataPoints": [point | {"asInt": "5"}, point | {"asDouble": 1.5}, point]}},
        {"name": "g", "gauge": {"dataPoints": [point | {"asDouble": 2.0}]}},
        {"name": "h", "histogram": {"aggregationTemporality": "AGGREGATION_TEMPORALITY_DELTA", "dataPoints": [point | {"count": "3", "sum": 9.0}, point | {"count": "4"}]}},
        {"name": "u", "sum": {"dataPoints": [point | {"asInt": "1"}]}},
        {"name": "q", "summary": {"dataPoints": [{"timeUnixNano": "1"}, {"timeUnixNano": "2"}]}},
    ]
    body = json.dumps({"resourceMetrics": [{"resource": {"attributes": kv(service__name="other")}, "scopeMetrics": [{"metrics": data}]}]})
    rows, rejects = otlp.metrics(spark.createDataFrame([(body,)], "body string"), F.lit(NOW))
    got = sorted((r.name, r.temporality, r.value, r.vendor, r.session_id) for r in rows.collect())
    assert got == [(n, t, v, "other", "s") for n, t, v in [("g", "gauge", 2.0), ("h_count", "delta", 3.0), ("h_count", "delta", 4.0), ("h_sum", "delta", 9.0), ("n", "cumulative", 1.5), ("n", "cumulative", 5.0), ("u", "unspecified", 1.0)]]
    assert {(r.reason, r.points) for r in otlp.rejection_summary(rejects).collect()} == {("unsupported aggregation", 2), ("point without a value", 1)}


def test_attribute_reads(spark):
    v = spark.createDataFrame([('{"s":"x","n":"12","f":3.9,"neg":-3.9,"b":true,"t":"false","big":1.5e21,"o":{}}',)], "j string").select(F.parse_json("j").alias("v"))
    c = F.col("v")
    row = v.select(
        variant_string(c, "s"), variant_string(c, "f"), variant_number(c, "n", "long"), variant_number(c, "f", "long"), variant_number(c, "neg", "long"), variant_number(c, "s"), variant_bool(c, "b"), variant_bool(c, "t"), variant_bool(c, "s"), string_like(c, "b"), string_like(c, "f"), string_like(c, "s")
    ).first()
    assert tuple(row) == ("x", None, 12, 3, -3, None, True, False, None, "true", "3.9", "x")


def test_cleaning_and_paths(spark):
    df = spark.createDataFrame([('{"a":"x\\u0000y"}', float("nan"), "/a/b//"), ('{"b": [2, {"d":1,"c":2}]}', float("-inf"), "/"), ("no", 1.5, "")], "j string, d double, p string")
    got = df.select(clean_json(F.col("j")), clean_number(F.col("d")), base_name(F.col("p")), canonical_json(F.col("j"))).collect()
    assert got[0][0] == '{"a":"x�y"}' and [r[1] for r in got] == ['"NaN"', '"-Inf"', "1.5"] and [r[2] for r in got] == ["b", "/", None] and got[1][3] == '{"b":[2,{"c":2,"d":1}]}'


def test_files_and_prices(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"resourceLogs": []}) + "\n" + log_bodies(spark, record(0, "user_prompt")).first().body + "\n")
    rows, _ = otlp.logs(otlp.read_bodies(spark, str(tmp_path / "in")), F.lit(NOW))
    assert rows.count() == 1
    tables.append_events(rows.withColumn("seq", F.lit(1).cast("long")), str(tmp_path / "events"))
    assert tables.read_events(spark, str(tmp_path / "events"), NOW.replace(tzinfo=None), datetime(2024, 3, 2)).count() == 1
    (tmp_path / "p.json").write_text(json.dumps([{"model": "opal", "effective_from": "2024-01-01", "input_per_mtok": 1, "output_per_mtok": 2}, {"model": "opal-2", "effective_from": "2024-02-01", "input_per_mtok": 3, "output_per_mtok": 4, "source": "user"}]))
    listed = tables.read_prices(spark, str(tmp_path / "p.json"))
    assert {(r.model, r.currency, r.source) for r in listed.collect()} == {("opal", "USD", "repo"), ("opal-2", "USD", "user")}
    asks = spark.createDataFrame([("opal-2-x", "2024-03-01"), ("opal-2-x", "2024-01-15"), ("opal-1", "2024-01-15"), ("other", "2024-03-01"), ("opal", "2023-01-01")], "model string, day string")
    got = {(r.model, r.day): (r.price_model, r.input_per_mtok) for r in pricing.resolve_prices(asks, listed, F.col("day")).collect()}
    # the model is chosen before the date: no shorter prefix stands in
    assert got == {("opal-2-x", "2024-03-01"): ("opal-2", 3.0), ("opal-2-x", "2024-01-15"): (None, None), ("opal-1", "2024-01-15"): ("opal", 1.0), ("other", "2024-03-01"): (None, None), ("opal", "2023-01-01"): (None, None)}


def test_projection_buckets_are_replaced_alone(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit(1).alias("v"))
    path = str(tmp_path / "p")
    tables.write_projection(rows, path, 8)
    some = rows.where(tables.session_bucket(buckets=8) == 3).withColumn("v", F.lit(2))
    tables.write_projection(some, path, 8)
    back = spark.read.parquet(path)
    assert back.count() == 200 and back.where("v = 2").count() == some.count() > 0
    assert quality.checksum(rows).first()["rows"] == 200


def test_unreadable_bodies_are_rejects(spark):
    """No body is lost, and none stops the others."""
    good = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record(0, "a")]}]}]})
    deep = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record(0, "b") | {"attributes": kv(session__id="s") + [{"key": "t", "value": {"stringValue": "x"}}]}]}]}]})
    for _ in range(400):
        deep = deep.replace('{"stringValue": "x"}', '{"kvlistValue": {"values": [{"key": "k", "value": {"stringValue": "x"}}]}}', 1)
    bad = ["{x", "", "[1]", "5", "null", '{"resourceLogs": 7}', good[:-3], deep, None]
    bodies = spark.createDataFrame([(b,) for b in [good, *bad, "{}"]], "body string")
    for read, name in ((otlp.logs, "resourceLogs"), (otlp.metrics, "resourceMetrics")):
        rows, rejects = read(spark.createDataFrame([(r.body and r.body.replace("resourceLogs", name),) for r in bodies.collect()], "body string"), F.lit(NOW))
        assert rows.count() == (1 if name == "resourceLogs" else 0)
        assert {(r.reason, r.points, r.n) for r in rejects.groupBy("reason", "points").agg(F.count("*").alias("n")).collect()} == {("unreadable body", 1, len(bad))}


def test_odd_values_and_names_stay(spark):
    odd = [{"key": "l", "value": {"arrayValue": {"values": [{"intValue": "x"}, {"intValue": 4}, {}]}}}, {"value": {"stringValue": "n"}}, {"key": "m", "value": {"kvlistValue": {"values": [{"value": {"intValue": "5"}}, {"key": "e"}]}}}]
    (r,), rejects = logs(spark, record(0, "a") | {"attributes": kv(session__id="s") + odd})
    assert json.loads(r.attrs) == {"": "n", "l": [None, 4, None], "m": {"": 5, "e": None}, "resource.service.name": "claude-code", "session.id": "s"} and not rejects
    (r,), rejects = logs(spark, record(0, "a") | {"attributes": kv(session__id="s") + odd[1:2]})
    assert json.loads(r.attrs) == {"": "n", "resource.service.name": "claude-code", "session.id": "s"} and not rejects


def test_sessions_are_texts(spark):
    bodies = ['{"session_id": 5, "hook_event_name": "Stop"}', '{"session_id": null, "hook_event_name": "Stop"}', '[{"session_id": "s", "hook_event_name": "Stop"}, {"session_id": {"a": "s"}}]', '{"session_id": "s", "hook_event_name": "Stop"}']
    rows, rejects = hooks.hooks(spark.createDataFrame([(b,) for b in bodies], "body string"), F.lit(NOW))
    assert [r.session_id for r in rows.collect()] == ["s"] and sorted(r.points for r in rejects.collect()) == [1, 1, 2]


def test_field_names_with_underscores(spark):
    """Either spelling is read; texts that look like fields stay."""
    import re

    text = 'say \\"scope_logs\\": or "time_unix_nano": it'
    one = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record(0, "a", note=text, prompt__id="p", size=3)]}]}]})
    snake = re.sub(r'(?<!\\)"([a-z]+(?:[A-Z][a-z]+)+)"(?=:)', lambda m: '"' + re.sub("[A-Z]", lambda x: f"_{x[0].lower()}", m[1]) + '"', one)
    assert "resource_logs" in snake and "string_value" in snake and "time_unix_nano" in snake
    a, b = (otlp.logs(spark.createDataFrame([(x,)], "body string"), F.lit(NOW))[0].collect() for x in (one, snake))
    assert a == b and json.loads(a[0].attrs)["note"] == text and json.loads(a[0].attrs)["size"] == 3
    point = {"resource_metrics": [{"scope_metrics": [{"metrics": [{"name": "m", "sum": {"aggregation_temporality": 2, "data_points": [{"time_unix_nano": nanos(0), "as_int": "7", "attributes": [{"key": "k", "value": {"string_value": "v"}}]}]}}]}]}]}
    (m,) = otlp.metrics(spark.createDataFrame([(json.dumps(point),)], "body string"), F.lit(NOW))[0].collect()
    assert (m.name, m.value, m.temporality, json.loads(m.attrs)) == ("m", 7.0, "cumulative", {"k": "v"})


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_filters_do_not_repeat_the_reading_of_requests(spark):
    """A filter on computed columns moves beneath their computation, which it repeated for each time that it named them."""
    bodies = log_bodies(spark, record())
    for df in (*otlp.logs(bodies, F.lit(NOW)), *otlp.metrics(bodies, F.lit(NOW))):
        assert not [x for x in _plan(df) if x.lstrip(" :+-").startswith("Filter") and ("from_json" in x or "variant_get" in x)]


def test_records_do_not_carry_their_list(spark):
    """Beside an exploded record stood the whole scope that it is of, so that a request cost the square of its records."""
    lists = [x for x in _plan(otlp.log_records(log_bodies(spark, record()))) if "Generate explode" in x and "ecords" in x]
    assert lists and not [x for x in lists if ".logRecords" in x]


def test_log_keys_of_repeated_events(spark):
    """Events of a session that agree in all but their place, as sequence numbers begin anew, are records of their own."""
    from telemill.plans import queries

    one = spark.createDataFrame([(1,), (1001,)], "seq long")
    texts = {"session_id": "s1", "vendor": "claude_code", "kind": "permission.mode_changed", "source": "otel_log", "event_name": "permission_mode_changed", "permission_mode": "plan"}
    columns = dict(x.split() for x in schemas.EVENTS.split(", "))
    made = {"seq": F.col("seq"), "ts": F.lit(NOW), "vendor_seq": F.col("seq") % 1000, "dedup_key": F.concat(F.lit("e:"), "seq")} | {k: F.lit(v) for k, v in texts.items()}
    events = one.select(*[made.get(c, F.lit(None)).cast(k).alias(c) for c, k in columns.items()])
    rows = otlp.logs(queries.log_bodies(SimpleNamespace(events=events)), F.lit(NOW))[0]
    assert rows.count() == rows.select("dedup_key").distinct().count() == 2
