"""OTLP/JSON exports: files of export requests to canonical events and metric samples.

Attribute lists become JSON objects with sorted names; of equal names the last
counts, and a pair without a name has the empty one.  Records that cannot be
placed come out as rejects, with a reason and the number of points lost.  A body
that is no JSON object of the request's shape, or is nested deeper than the
parser goes (1000 levels of JSON), is one reject as a whole.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill import schemas
from telemill.functions import mapping as mp
from telemill.functions.attributes import clean_json, variant_number, variant_string
from telemill.session import configure

_NESTED = ("kvlist", "array")  # requests that may hold lists or maps as values go through Arrow batches
_KV = "array<struct<key string, value variant>>"
#: The format's field names, which may also be written with underscores.
_FIELDS = [
    "resourceLogs", "scopeLogs", "logRecords", "resourceMetrics", "scopeMetrics", "timeUnixNano", "observedTimeUnixNano", "eventName", "stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue",
    "kvlistValue", "dataPoints", "asDouble", "asInt", "aggregationTemporality", "isMonotonic", "exponentialHistogram",
]
_CORRUPT = "_corrupt_record"  # set by the parser on what it cannot read whole
_LEVELS = 1000  # of JSON, which the parser goes; a body of no more bytes cannot have more
LOGS = f"resourceLogs array<struct<resource struct<attributes {_KV}>, scopeLogs array<struct<scope struct<attributes {_KV}>, logRecords array<struct<timeUnixNano string, observedTimeUnixNano string, eventName string, body variant, attributes {_KV}>>>>>>"
_NUMBER = f"array<struct<timeUnixNano string, asDouble double, asInt string, attributes {_KV}>>"
_HISTOGRAM = f"array<struct<timeUnixNano string, count string, sum double, attributes {_KV}>>"
METRICS = (
    f"resourceMetrics array<struct<resource struct<attributes {_KV}>, scopeMetrics array<struct<metrics array<struct<name string, sum struct<aggregationTemporality string, isMonotonic boolean, dataPoints {_NUMBER}>, "
    f"gauge struct<dataPoints {_NUMBER}>, histogram struct<aggregationTemporality string, dataPoints {_HISTOGRAM}>, summary struct<dataPoints array<struct<timeUnixNano string>>>, exponentialHistogram struct<dataPoints array<struct<timeUnixNano string>>>>>>>>>"
)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One export request per line of the files at ``path``."""
    return _lines(spark.read.text(path))


def stream_bodies(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream of files."""
    return _lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def _lines(files: DataFrame) -> DataFrame:
    """Bodies of the lines of files; blank lines are none."""
    return files.where(F.trim("value") != "").select(clean_json(F.col("value")).alias("body"))


def _named(bodies: DataFrame) -> DataFrame:
    """Bodies with the field names that the schemas have; names with underscores are looked for where a request's own is one."""
    body = F.col("body")
    plain = body
    for name in _FIELDS:
        snake = re.sub("[A-Z]", lambda m: f"_{m[0].lower()}", name)
        plain = F.regexp_replace(plain, rf'(?<!\\)"{snake}"(\s*:)', f'"{name}"$1')
    likely = body.contains('_logs"') | body.contains('_metrics"')  # a search for bytes, some thirty times as fast as the pattern
    return bodies.select(F.when(likely & body.rlike(r'(?<!\\)"(?:resource|scope)_(?:logs|metrics)"\s*:'), plain).otherwise(body).alias("body"))


def _holds(*texts: str) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.col("body").contains(x) for x in texts]), F.lit(False))


def _nested() -> Column:
    return _holds(*[f'"{x}Value"' for x in _NESTED])


def _from_json(body: Column, schema: str) -> Column:
    return F.from_json(body, f"{schema}{_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})


def _parsed(bodies: DataFrame, schema: str) -> DataFrame:
    """(body, j, readable): requests by the permissive parser, and whether it could read them whole.

    A nested body may be deeper than the parser goes.  A schema without fields finds
    that out by skipping, at a fifth of the cost of building values a thousand
    levels down first.
    """
    body = F.col("body")
    too_deep = F.when(_nested() & (F.octet_length(body) > _LEVELS), _from_json(body, "")[_CORRUPT].isNotNull()).otherwise(F.lit(False))
    parsed = bodies.select("body", _from_json(F.when(~too_deep, body), f"{schema}, ").alias("j"))
    return parsed.select("body", "j", F.coalesce(F.col("j").isNotNull() & F.col(f"j.{_CORRUPT}").isNull() & F.ltrim("body").startswith("{"), F.lit(False)).alias("readable"))


def unreadable(bodies: DataFrame, schema: str) -> DataFrame:
    """A reject for each body that cannot be read; how many records it held is not known, so it counts as one."""
    bad = _parsed(bodies, schema).select(F.explode(F.when(~F.col("readable"), F.array("body"))).alias("record"))
    return bad.select(F.lit("unreadable body").alias("reason"), "record", F.lit(1).cast("long").alias("points"))


def _resources(bodies: DataFrame, schema: str, name: str) -> DataFrame:
    """(r): the resources of the requests that can be read."""
    return _parsed(bodies, schema).select(F.explode(F.when(F.col("readable"), F.col(f"j.{name}"))).alias("r"))


def _only(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed columns.

    A filter would move beneath their computation and repeat it, once for each time that the condition names them.
    """
    return rows.select(F.explode(F.when(condition, F.array(F.struct(*rows.columns)))).alias("__r")).select("__r.*")


def value_of(v: Column) -> Column:
    """A flat attribute value without its wrapper."""
    get = lambda name, kind="variant": F.try_variant_get(v, f"$.{name}", kind)
    return F.coalesce(get("stringValue"), get("boolValue"), F.try_parse_json(get("intValue", "string")), get("doubleValue"), get("bytesValue"))


def attribute_map(pairs: Column) -> Column:
    """Map of an attribute list of flat values, names in order; of equal names the last counts."""
    entries = F.transform(F.coalesce(pairs, F.array().cast(_KV)), lambda e: F.struct(F.coalesce(e["key"], F.lit("")).alias("key"), value_of(e["value"]).alias("value")))
    return F.map_from_entries(entries)


def _plain(value):
    """A JSON attribute value without its wrappers, at any depth."""
    if not isinstance(value, dict):
        return value
    if "kvlistValue" in value:
        return _pairs((value["kvlistValue"] or {}).get("values"))
    if "arrayValue" in value:
        return [_plain(x) for x in (value["arrayValue"] or {}).get("values") or []]
    if "intValue" in value:
        try:
            return int(value["intValue"])
        except (TypeError, ValueError):
            return None  # as in a flat attribute
    return next((value[k] for k in ("stringValue", "boolValue", "doubleValue", "bytesValue") if k in value), None)


def _pairs(values) -> dict:
    return {e.get("key") or "": _plain(e.get("value")) for e in values or [] if isinstance(e, dict)}


@F.pandas_udf(T.StringType())
def _plain_pairs(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else json.dumps(_pairs(json.loads(x)), ensure_ascii=False))


def nested_attribute_map(pairs: Column) -> Column:
    """:func:`attribute_map` for lists and maps as values, of any depth."""
    return F.coalesce(F.from_json(_plain_pairs(F.to_json(pairs)), "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _by_depth(bodies: DataFrame, read, named=lambda bodies: bodies) -> DataFrame:
    """``read`` over requests with flat attribute values, and in its way for nested ones over the others, after ``named``.

    Each way first leaves out what is surely the other's, as a body may be long.
    """
    configure(bodies.sparkSession)  # of equal names the last counts by a session setting
    nested = _nested()
    flat_ones, others = named(_only(bodies, ~nested)), named(_only(bodies, _holds(*_NESTED)))
    return read(_only(flat_ones, ~nested), attribute_map).unionByName(read(_only(others, nested), nested_attribute_map))


def sorted_json(m: Column) -> Column:
    """JSON of a map of variants, names in order."""
    keys = F.array_sort(F.map_keys(m))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: m[k])))


def log_records(bodies: DataFrame) -> DataFrame:
    """One row per log record: service, merged attributes (JSON), resource attributes, record fields."""
    return _by_depth(bodies, _log_records)


def _log_records(bodies: DataFrame, attribute_map, rejects: bool = False) -> DataFrame:
    """rejects: also a row for each body that cannot be read, of an empty record, with ``lost`` set; and the records' ``session_id``."""
    kept = ["lost"] if rejects else []
    rows = lambda c: F.when(F.col("lost"), F.array(F.lit(None))).otherwise(F.col(c)) if rejects else F.col(c)
    if rejects:
        j = _parsed(bodies, LOGS).select((~F.col("readable")).alias("lost"), F.col("j.resourceLogs").alias("resources"))
        j = j.select(*kept, F.explode(rows("resources")).alias("r"))
    else:
        j = _resources(bodies, LOGS, "resourceLogs")
    # what a row keeps beside an exploded list is selected before, or each record would carry the list that it is of
    j = j.select(*kept, attribute_map(F.col("r.resource.attributes")).alias("ra"), F.col("r.scopeLogs").alias("scopes"))
    j = j.select(*kept, "ra", F.explode(rows("scopes")).alias("s")).select(*kept, "ra", attribute_map(F.col("s.scope.attributes")).alias("sa"), F.col("s.logRecords").alias("records"))
    j = j.select(*kept, "ra", "sa", F.explode(rows("records")).alias("x")).select(*kept, "ra", "sa", attribute_map(F.col("x.attributes")).alias("xa"), F.try_variant_get("x.body", "$.stringValue", "string").alias("body_text"), F.col("x.eventName").alias("record_name"), F.col("x.timeUnixNano").alias("nanos"))
    j = j.withColumn("merged", F.map_concat(F.transform_keys("ra", lambda k, _: F.concat(F.lit("resource."), k)), "sa", "xa"))
    if rejects:
        j, kept = j.withColumn("session_id", _session(lambda name: variant_string(F.col("merged")[name]))), [*kept, "session_id"]
    body = F.when(F.col("body_text").isNotNull(), F.to_json(F.create_map(F.lit("body"), "body_text")))
    out = j.select(*kept, F.try_variant_get(F.col("ra")["service.name"], "$", "string").alias("service"), sorted_json(F.col("merged")).alias("attrs"), "body_text", body.alias("__body"), "record_name", "nanos")
    joined = F.when(F.col("__body").isNull(), F.col("attrs")).when(F.col("attrs") == "{}", F.col("__body")).otherwise(F.concat(F.regexp_replace("__body", r"\}$", ","), F.substring("attrs", 2, 1 << 30)))
    return out.withColumn("attrs", joined).drop("__body")


def _session(text) -> Column:
    """The session that a record names; text: the string attribute of a name."""
    return F.coalesce(F.nullif(text("session.id"), F.lit("")), F.nullif(text("resource.session.id"), F.lit("")))


def log_outcomes(bodies: DataFrame) -> DataFrame:
    """(session_id, reason, points): every log record, and every body that cannot be read; only rejects have the last two.

    Each body is parsed once, so what counts events and rejects reads this and not
    both tables of :func:`logs`.  Lost bodies themselves are in the latter only:
    here they would wait beside the nested ones for their Arrow batches.
    """
    rows = _by_depth(bodies, lambda b, attribute_map: _log_records(b, attribute_map, rejects=True), _named)
    reason = F.when(F.col("lost"), "unreadable body").when(F.col("session_id").isNull(), "missing session.id")
    rows = rows.select("session_id", reason.alias("reason"))
    return rows.withColumn("points", F.when(F.col("reason").isNotNull(), F.lit(1).cast("long")))


def logs(bodies: DataFrame, now: Column, retention_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(canonical events without seq, rejects) of log exports received at ``now``."""
    rows = _by_depth(bodies, _log_records, _named).withColumn("v", F.parse_json("attrs")).withColumn("now", now)
    v = F.col("v")
    rows = rows.withColumn("session_id", _session(lambda name: variant_string(v, name)))
    rows = rows.withColumn("event_name", mp.event_name(F.col("record_name"), v, F.col("body_text")))
    rejects = _only(rows.select("attrs", "session_id"), F.col("session_id").isNull()).select(F.lit("missing session.id").alias("reason"), F.col("attrs").alias("record"), F.lit(1).cast("long").alias("points"))
    rejects = rejects.unionByName(unreadable(_named(bodies), LOGS))
    raw, apart = mp.timestamp_of(F.col("nanos"), variant_string(v, "event.timestamp"))
    ts, odd = mp.clamped(raw, F.col("now"), retention_days)
    number = variant_number(v, "event.sequence", "long")
    columns = mp.log_columns(F.col("event_name"), v) | {
        "ts": ts, "ingested_at": F.col("now"), "session_id": F.col("session_id"), "prompt_id": variant_string(v, "prompt.id"), "vendor": mp.vendor_of(F.col("service")), "source": F.lit("otel_log"),
        "event_name": F.col("event_name"), "vendor_seq": number, "clock_skewed": odd | apart, "dedup_key": mp.log_key(F.col("session_id"), number, F.col("event_name"), F.col("attrs")), "attrs": F.col("attrs"),
    }
    return _events(_only(rows, F.col("session_id").isNotNull()), columns), rejects


def _events(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    kinds = dict(x.split() for x in schemas.EVENTS.split(", "))
    return rows.select(*[(columns[c] if c in columns else F.lit(None)).cast(kinds[c]).alias(c) for c in schemas.EVENT_COLUMNS if c != "seq"])


def metrics(bodies: DataFrame, now: Column, retention_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(metric samples, rejects) of metric exports received at ``now``.

    A histogram point gives a sum, if it has one, and a count.  Summaries,
    exponential histograms, points without a value and unreadable bodies are
    rejected.
    """
    points, bodies = _by_depth(bodies, _metric_points, _named), _named(bodies)
    rejects = _unsupported(bodies).unionByName(unreadable(bodies, METRICS))
    rejects = rejects.unionByName(points.where(F.col("value").isNull()).select(F.lit("point without a value").alias("reason"), F.col("name").alias("record"), F.lit(1).cast("long").alias("points")))
    rows = points.where(F.col("value").isNotNull()).withColumn("now", now).withColumn("attrs", sorted_json(F.col("map")))
    text = lambda m, k: F.nullif(F.try_variant_get(F.col(m)[k], "$", "string"), F.lit(""))
    ts, _ = mp.clamped(mp.timestamp_of(F.col("nanos"), F.lit(None).cast("string"))[0], F.col("now"), retention_days)
    out = rows.withColumn("ts", ts).select(
        "ts", F.col("now").alias("ingested_at"), "name", mp.vendor_of(text("ra", "service.name")).alias("vendor"), F.coalesce(text("map", "session.id"), text("ra", "session.id")).alias("session_id"), "value", "temporality",
        mp.series_key(F.col("name"), F.col("attrs")).alias("series_hash"), "attrs", mp.metric_key(F.col("name"), F.col("ts"), F.col("attrs")).alias("dedup_key"),
    )
    return out, rejects


def _unsupported(bodies: DataFrame) -> DataFrame:
    j = _resources(bodies, METRICS, "resourceMetrics").select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))
    lost = F.coalesce(F.size("m.summary.dataPoints"), F.lit(0)) + F.coalesce(F.size("m.exponentialHistogram.dataPoints"), F.lit(0))
    unsupported = F.col("m.summary").isNotNull() | F.col("m.exponentialHistogram").isNotNull()
    return j.where(unsupported).select(F.lit("unsupported aggregation").alias("reason"), F.col("m.name").alias("record"), lost.cast("long").alias("points"))


def _metric_points(bodies: DataFrame, attribute_map) -> DataFrame:
    """(ra, name, nanos, value, map, temporality) of every data point."""
    j = _resources(bodies, METRICS, "resourceMetrics").select(attribute_map(F.col("r.resource.attributes")).alias("ra"), F.col("r.scopeMetrics").alias("scopes"))
    j = j.select("ra", F.explode("scopes").alias("s")).select("ra", F.explode("s.metrics").alias("m"))
    point = lambda name, p, value, kind: F.struct(name.alias("name"), p["timeUnixNano"].alias("nanos"), value.alias("value"), p["attributes"].alias("attributes"), kind.alias("temporality"))
    number = lambda p: F.coalesce(p["asDouble"], p["asInt"].try_cast("double"))
    name = F.col("m.name")
    kind = F.array().cast(f"array<struct<name string, nanos string, value double, attributes {_KV}, temporality string>>")
    sums = F.transform("m.sum.dataPoints", lambda p: point(name, p, number(p), mp.temporality(F.col("m.sum.aggregationTemporality"))))
    gauges = F.transform("m.gauge.dataPoints", lambda p: point(name, p, number(p), F.lit("gauge")))
    of = mp.temporality(F.col("m.histogram.aggregationTemporality"))
    totals = F.transform(F.filter("m.histogram.dataPoints", lambda p: p["sum"].isNotNull()), lambda p: point(F.concat(name, F.lit("_sum")), p, p["sum"], of))
    counts = F.transform("m.histogram.dataPoints", lambda p: point(F.concat(name, F.lit("_count")), p, p["count"].try_cast("double"), of))
    points = F.concat(*[F.coalesce(x, kind) for x in (sums, gauges, totals, counts)])
    rows = j.select("ra", F.explode(points).alias("p")).select("ra", "p.*")
    return rows.select("ra", "name", "nanos", "value", attribute_map(F.col("attributes")).alias("map"), "temporality")


def rejection_summary(rejects: DataFrame) -> DataFrame:
    """(reason, points, first record) of the rejects."""
    return rejects.groupBy("reason").agg(F.sum("points").alias("points"), F.min("record").alias("example"))
