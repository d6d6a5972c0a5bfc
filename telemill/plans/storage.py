"""Registered queries of what is kept on storage and in state: keyless calls, the queue of dirty hours, retention.

Inputs are derived from the driver's tables; results are the rows that are left.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators import explorer as ex
from telemill.operators import ingest as ing
from telemill.operators import quality as qu
from telemill.operators import rollups as ro
from telemill.operators import sessions as ss
from telemill.operators import subagents as sa
from telemill.operators import tool_calls as tc
from telemill.plans import canonical
from telemill.plans import oracle_base as ob
from telemill.plans.queries import _RALL, _SA, _TC, BOTH, EV, RH, SA, SE, START, TC, TU, Tables, _received, query, with_
from telemill.plans.rows import _stream, _with_state_store, folder
from telemill.schemas import MEASURES
from telemill.sources import days, expiry, hooks, otlp, tables
from telemill.streaming import calls, jobs, rollup_queue

# --- keyless calls: a month of tool events in a quarter of an hour, so that many calls are near each other ---

_BASE = 1_704_067_200_000_000  # 2024-01-01
#: (which events, kind, source, use id, microseconds later, vendor number, letter): the calls, results of some, and rows without a use id before and after them
_BUSY = [
    ("true", "kind", "source", "concat('u', seq)", "0", "vendor_seq", "a"),
    ("seq % 4 = 0", "'tool.result'", "'otel_log'", "concat('u', seq)", "20000000", "seq % 1000", "d"),
    ("seq % 2 = 0", "'tool.pre'", "'hook'", "cast(NULL AS {text})", "((seq * 37) % 150 - 75) * 1000000", "cast(NULL AS bigint)", "b"),
    ("seq % 3 = 0", "'tool.result'", "'hook'", "cast(NULL AS {text})", "((seq * 53) % 200 - 60) * 1000000", "seq % 7", "c"),
]


def busy_events(t: Tables) -> DataFrame:
    base = t.events.where(F.col("kind").isin(*tc.KINDS)).withColumn("at", F.expr(f"{_BASE} + (unix_micros(ts) - {_BASE}) div 3000"))
    parts = []
    for k, (some, kind, source, use, later, vendor, letter) in enumerate(_BUSY):
        one = base.where(some).withColumns({"kind": F.expr(kind), "source": F.expr(source), "tool_use_id": F.expr(use.format(text="string")), "vendor_seq": F.expr(vendor).cast("long"), "ts": F.timestamp_micros(F.expr(f"at + {later}"))})
        parts.append(one.withColumns({"dedup_key": F.concat(F.lit(f"{letter}:"), "seq"), "prompt_id": F.concat("session_id", F.lit("-p")), "seq": F.col("seq") + k * 10_000_000}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ingested_at", F.timestamp_micros(F.unix_micros("ts") + F.col("seq") % 5 * 30_000_000)).drop("at")


_ROWS = " UNION ALL ".join(
    f"SELECT session_id, session_id || '-p' AS prompt_id, tool_name, {kind} AS kind, {source} AS source, {use.format(text='VARCHAR')} AS use_id, us + {later} AS us, {vendor} AS vendor, '{letter}:' || seq AS key FROM near WHERE {some}" for some, kind, source, use, later, vendor, letter in _BUSY
)
_ID = ob.uuid5("w.session_id || '|' || prompt_id || '|' || w.tool_name || '|' || opened")
#: The walk over the contributions of each session and tool, one a step; the pool holds the calls that can be claimed.
BUSY = f""",
near AS (SELECT *, {_BASE} + (epoch_us(ts) - {_BASE}) // 3000 AS us FROM ev WHERE kind IN ({", ".join(f"'{k}'" for k in tc.KINDS)})),
busy AS MATERIALIZED ({_ROWS}),
keyed AS (SELECT *, {ob.uuid5("session_id || '|' || use_id")} AS id FROM busy WHERE use_id IS NOT NULL),
kc AS (SELECT session_id, tool_name, id, any_value(use_id) AS use_id, coalesce(min(us) FILTER (WHERE kind IN ('tool.pre', 'tool.decision')), min(us)) AS us, min(us) FILTER (WHERE kind = 'tool.result') AS until, bool_or(source = 'otel_log') AS logged FROM keyed GROUP BY session_id, tool_name, id),
pools AS (SELECT session_id, tool_name, list({{'us': us, 'i': i, 'id': id, 'use': use_id, 'until': until, 'logged': logged}}) AS pool FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tool_name ORDER BY us, id) AS i FROM kc) GROUP BY ALL),
asks AS (SELECT session_id, prompt_id, tool_name, list({{'us': us, 'key': key}} ORDER BY us, vendor NULLS LAST, key) AS list FROM busy WHERE use_id IS NULL GROUP BY ALL),
walk AS (SELECT session_id, tool_name, 0::BIGINT AS n, 0::BIGINT AS opened, pool, NULL::VARCHAR AS key, NULL::VARCHAR AS id, NULL::VARCHAR AS use_id, NULL::BIGINT AS gap, false AS heuristic FROM asks LEFT JOIN pools USING (session_id, tool_name)
  UNION ALL
  SELECT session_id, tool_name, n + 1, opened + (best IS NULL)::BIGINT, CASE WHEN best IS NULL THEN list_append(coalesce(pool, []), {{'us': a.us, 'i': 1000000000 + opened, 'id': fresh, 'use': NULL::VARCHAR, 'until': NULL::BIGINT, 'logged': false}}) ELSE list_filter(pool, lambda p: p.i <> best.i) END,
    a.key, coalesce(best.id, fresh), best.use, best.far, coalesce(best.logged, false)
  FROM (SELECT w.session_id, w.tool_name, n, opened, pool, asks.list[n + 1] AS a, {_ID} AS fresh,
      list_sort(list_transform(list_filter(pool, lambda p: abs(p.us - asks.list[n + 1].us) <= 60000000 AND (p.until IS NULL OR p.until > asks.list[n + 1].us)), lambda p: {{'far': abs(p.us - asks.list[n + 1].us), 'i': p.i, 'id': p.id, 'use': p.use, 'logged': p.logged}}))[1] AS best
    FROM walk w JOIN asks ON w.session_id = asks.session_id AND w.tool_name = asks.tool_name WHERE n < len(asks.list))),
placed AS (SELECT key, id, heuristic FROM walk WHERE n > 0 UNION ALL SELECT key, id, false FROM keyed)"""


@query("D14_claims", f"WITH RECURSIVE {EV}{BUSY} SELECT key AS dedup_key, id AS call_id, heuristic FROM placed")
def _(t):
    """Every contribution with its call, open calls as they are at the contribution's time."""
    return tc.assign_keyless(tc.contributions(busy_events(t)), open_at_the_time=True).select("dedup_key", "call_id", "heuristic")


@query("J10_nearest_open_calls", f"WITH RECURSIVE {EV}{BUSY} SELECT key AS dedup_key, use_id AS tool_use_id, gap AS gap_us FROM walk WHERE use_id IS NOT NULL")
def _(t):
    """Contributions that claimed a call with a use id, and how far that call's start is from them."""
    rows = tc.assign_keyless(tc.contributions(busy_events(t)), open_at_the_time=True)
    strict = F.min(F.when(F.col("kind").isin("tool.pre", "tool.decision"), F.col("ts")))
    named = rows.where(F.col("tool_use_id").isNotNull()).groupBy("call_id").agg(F.first("tool_use_id").alias("use"), F.coalesce(strict, F.min("ts")).alias("start"))
    return rows.where(F.col("tool_use_id").isNull()).join(named, "call_id").select("dedup_key", F.col("use").alias("tool_use_id"), F.abs(F.unix_micros("ts") - F.unix_micros("start")).alias("gap_us"))


def _tick(rows: DataFrame) -> DataFrame:
    """The last receipt again, a day later and of a session of its own: time goes on when nothing happens."""
    last = rows.orderBy(F.desc("ingested_at"), "seq").limit(1)
    later = F.col("ingested_at") + F.expr("INTERVAL 1 DAY")
    return rows.unionByName(last.withColumns({"ingested_at": later, "session_id": F.lit("~"), "tool_use_id": F.lit("tick"), "dedup_key": F.lit("tick")}))


_FOLDED = "CASE WHEN bool_or(source = 'otel_log') AND bool_or(source = 'hook' AND use_id IS NOT NULL) THEN 'exact' WHEN bool_or(source = 'otel_log') AND bool_or(heuristic) THEN 'heuristic' WHEN bool_or(source = 'otel_log') THEN 'otel_only' ELSE 'hook_only' END"


@query("S6_matched_claims", f"WITH RECURSIVE {EV}{BUSY} SELECT session_id, id, any_value(use_id) AS tool_use_id, {_FOLDED} AS correlation, count(*) AS event_count, coalesce(min(us) FILTER (WHERE kind IN ('tool.pre', 'tool.decision')), min(us)) AS started_at FROM placed JOIN busy USING (key) GROUP BY session_id, id")
def _(t):
    """Contributions arrive up to two minutes late, wait in state, and are folded into the stored projection after each of five batches."""
    _with_state_store(t)
    stream = calls.placed(_stream(t, _tick(busy_events(t)), 5, "busy"))
    stored, projection = folder(t, "placed"), folder(t, "placed-calls")
    jobs.run_available(stream, calls.project_calls(t.spark, stored, projection), folder(t, "placed-checkpoint")).awaitTermination()
    return t.spark.read.parquet(projection).where("session_id <> '~'").select("session_id", "id", "tool_use_id", "correlation", "event_count", "started_at")


# --- bodies that cannot be read ---

_DEEP = 600  # levels of maps in maps, which is more JSON than the parser takes


def _bad_bodies(t: Tables) -> DataFrame:
    """A log request for each event of the driver's: cut off, no JSON object, too deep, without a session, with a bad number in a list and a pair without a name, or good."""
    i = F.col("event_id").cast("string")
    good = lambda pairs: F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"eventName":"claude_code.x","attributes":[{"key":"session.id","value":{"stringValue":"s'), i, F.lit('"}},{"key":"id","value":{"intValue":"'), i, F.lit('"}}' + pairs + "]}]}]}]}"))
    deep = '{"kvlistValue":{"values":[{"key":"a","value":' * _DEEP + '{"stringValue":"x"}' + "}]}}" * _DEEP
    odd = ',{"key":"list","value":{"arrayValue":{"values":[{"intValue":"abc"},{"intValue":"7"}]}}},{"value":{"stringValue":"nameless"}}'
    kind = F.col("event_id") % 8
    body = (
        F.when(kind == 0, F.substring(good(""), 1, 40)).when(kind == 1, F.lit("[1, 2]")).when(kind == 2, F.concat(F.lit('{"resourceLogs":"'), i, F.lit('"}'))).when(kind == 3, good(',{"key":"deep","value":' + deep + "}"))
        .when(kind == 4, F.regexp_replace(good(""), '"s[0-9]+"', '""')).when(kind == 5, good(odd)).otherwise(good(""))
    )
    return canonical.spread(t.raw("events").select("event_id"), "event_id").select(body.alias("body"))


@query("A11_unreadable_bodies", "SELECT CASE WHEN k < 4 THEN 'unreadable body' ELSE 'missing session.id' END AS outcome, count(*) AS n, NULL::VARCHAR AS session_id, NULL::VARCHAR AS list, NULL::VARCHAR AS nameless FROM (SELECT event_id % 8 AS k FROM events) WHERE k < 5 GROUP BY outcome UNION ALL SELECT 'event', 1, 's' || event_id, CASE WHEN event_id % 8 = 5 THEN '[null,7]' END, CASE WHEN event_id % 8 = 5 THEN 'nameless' END FROM events WHERE event_id % 8 >= 5")
def _(t):
    """Every body is an event or a reject."""
    events, rejects = otlp.logs(_bad_bodies(t), _received())
    none = F.lit(None).cast("string")
    told = otlp.rejection_summary(rejects).select(F.col("reason").alias("outcome"), F.col("points").alias("n"), none.alias("session_id"), none.alias("list"), none.alias("nameless"))
    kept = events.select(F.lit("event").alias("outcome"), F.lit(1).cast("long").alias("n"), "session_id", F.get_json_object("attrs", "$.list").alias("list"), F.from_json("attrs", "map<string,string>")[""].alias("nameless"))
    return told.unionByName(kept)


@query("I5_balance", "SELECT 'event' AS outcome, count(*) AS n FROM events WHERE event_id % 8 >= 5 UNION ALL SELECT 'rejected', count(*) FROM events WHERE event_id % 8 < 5")
def _(t):
    """Accounts of the same bodies: written and rejected add up to all that came."""
    return ing.balance(otlp.log_outcomes(_bad_bodies(t)))


@query("A6_typed_sessions", "SELECT CASE WHEN event_id % 4 = 0 THEN 's' || event_id END AS session_id, CASE WHEN event_id % 4 = 0 THEN 'event' ELSE 'invalid hook body' END AS outcome FROM events")
def _(t):
    """A session that is a number, null or missing is none."""
    i = F.col("event_id").cast("string")
    session = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"session_id":"s'), i, F.lit('",'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"session_id":'), i, F.lit(","))).when(F.col("event_id") % 4 == 2, F.lit('"session_id":null,')).otherwise("")
    events, rejects = hooks.hooks(t.raw("events").select(F.concat(F.lit("{"), session, F.lit('"hook_event_name":"Stop"}')).alias("body")), _received())
    return events.select("session_id", F.lit("event").alias("outcome")).unionByName(rejects.select(F.lit(None).cast("string").alias("session_id"), F.col("reason").alias("outcome")))


# --- the queue of dirty hours ---

_PASSES = 3


@query("S3_queue_passes", with_(f"SELECT pass, greatest(0, all_hours - pass * most)::BIGINT AS pending, count(*) FILTER (WHERE k <= pass * most) AS hours, coalesce(sum(n) FILTER (WHERE k <= pass * most), 0)::BIGINT AS events FROM (SELECT *, row_number() OVER (ORDER BY bucket) AS k, count(*) OVER () AS all_hours, ceil(count(*) OVER () / {_PASSES}::DOUBLE)::BIGINT AS most FROM (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM ev GROUP BY ALL)), (SELECT unnest(range(1, {_PASSES + 2})) AS pass) GROUP BY pass, all_hours, most", EV))
def _(t):
    """Three batches are stored and marked, then passes of a third of the dirty hours each work them off, oldest first, and one finds nothing."""
    events, rollup = folder(t, "queued-events"), folder(t, "queued-rollup")
    queue, store = rollup_queue.Queue(t.spark, folder(t, "queue")), jobs.store_batch(events, t.spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch, batch_id)
        queue.mark(ro.dirty_buckets(batch), batch_id)

    jobs.run_available(_stream(t, t.events), write, folder(t, "queue-checkpoint")).awaitTermination()
    fold = lambda e: e.groupBy(ro.hour("ts").alias("bucket"), "kind").agg(F.count("*").alias("n"))
    most, seen = -(-queue.pending().count() // _PASSES), []
    for k in range(1, _PASSES + 2):
        rollup_queue.work(queue, {"event": (events, days.MONTH, fold)}, rollup, datetime(2025, 1, 1), most)
        made = rollup_queue.read_rollup(t.spark, rollup).agg(F.count_distinct("bucket"), F.sum("n")).first() if most else (0, 0)
        seen.append((k, queue.pending().count(), made[0], made[1] or 0))
    return t.spark.createDataFrame(seen if most else [], "pass long, pending long, hours long, events long")


@query("E14_queued_rollup", with_("SELECT epoch_us(date_trunc('hour', ts)) AS bucket, kind, count(*) AS n FROM ev GROUP BY ALL", EV))
def _(t):
    """Batch by batch, with a pass after each: hours that a later batch touches are replaced, whatever pass they were in before."""
    events, rollup = folder(t, "queued-events"), folder(t, "queued-rollup")
    queue, store = rollup_queue.Queue(t.spark, folder(t, "queue")), jobs.store_batch(events, t.spark)
    fold = lambda e: e.groupBy(ro.hour("ts").alias("bucket"), "kind").agg(F.count("*").alias("n"))
    late = t.events.withColumn("ingested_at", F.when(F.col("seq") % 5 == 0, F.lit(datetime(2024, 1, 31))).otherwise(F.col("ingested_at")))

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch, batch_id)
        queue.mark(ro.dirty_buckets(batch), batch_id)
        rollup_queue.work(queue, {"event": (events, days.MONTH, fold)}, rollup, datetime(2025, 1, 1), 500)

    jobs.run_available(_stream(t, late), write, folder(t, "queue-checkpoint")).awaitTermination()
    while rollup_queue.work(queue, {"event": (events, days.MONTH, fold)}, rollup, datetime(2025, 1, 1), 500).claimed:
        pass
    return rollup_queue.read_rollup(t.spark, rollup).select("bucket", "kind", "n")


def _worked_off(t: Tables) -> tuple[str, str]:
    """(hourly, daily) rollups of events that passes over a queue have made: three batches, each with marks of its events' hours and of the starts of the calls that it touches."""
    events, rollup, daily = folder(t, "rolled-events"), folder(t, "rolled-hours"), folder(t, "rolled-days")
    queue, store = rollup_queue.Queue(t.spark, folder(t, "queue")), jobs.store_batch(events, t.spark)
    homes = tables.staged(t.sessions.select("session_id", "project", "vendor"), "session-homes")
    started = tables.staged(t.tool_calls.select("session_id", "id", "started_at", "decision"), "started-calls")

    def fold(e: DataFrame) -> DataFrame:
        hours = e.select(ro.hour("ts").alias("__b")).distinct()
        near = started.join(F.broadcast(hours), ro.hour("started_at") == F.col("__b"), "left_semi")  # a pass has some hundreds of hours
        return ro.hourly_of(tables.staged(ro.merged_rollup(ro.event_rollup(e, homes), ro.tool_rollup(near, homes)), "merged-rollup"), t.prices)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch, batch_id)
        touched = started.join(batch.select("session_id").distinct(), "session_id", "left_semi")
        queue.mark(ro.dirty_buckets(batch, tool_calls=touched), batch_id)
        work()

    def work() -> int:
        return rollup_queue.work(queue, {"event": (events, days.MONTH, fold)}, rollup, datetime(2025, 1, 1), 400, daily_path=daily).claimed

    jobs.run_available(_stream(t, t.events), write, folder(t, "queue-checkpoint")).awaitTermination()
    while work():
        pass
    return rollup, daily


@query("E12_queued_hours", with_(f"SELECT {_RALL} FROM rh", EV, TC, SE, RH))
def _(t):
    rows = t.spark.read.parquet(_worked_off(t)[0])
    return rows.select(*ro.ROLLUP_KEY, "source", *MEASURES)


@query("E13_queued_days", with_(f"SELECT {_RALL} FROM rd WHERE source = 'event'", BOTH))
def _(t):
    rows = t.spark.read.parquet(_worked_off(t)[1])
    return rows.select(*ro.ROLLUP_KEY, "source", *MEASURES)


# --- retention ---


def _three_months(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("seq") % 3 * (31 * 86_400_000_000)))


_MONTHS = "m AS (SELECT seq, ts + to_days((seq % 3 * 31)::INTEGER) AS ts FROM ev)"


@query("R1_expired_on_storage", with_("SELECT seq, epoch_us(ts) AS ts FROM m WHERE date_trunc('month', ts) + INTERVAL 1 MONTH > TIMESTAMP '2024-03-01'", EV, ", " + _MONTHS))
def _(t):
    """The table after a dry run, which changes nothing, and the expiry itself."""
    path = folder(t, "expiring-events")
    days.write(_three_months(t), path, 0)
    told = expiry.expire(t.spark, {path: days.MONTH}, date(2024, 3, 1), dry_run=True)
    assert sorted(told[path]) == [m for m in days.months(t.spark, path) if m < "2024-03"]
    expiry.expire(t.spark, {path: days.MONTH}, date(2024, 3, 1))
    return tables.read_events(t.spark, path).select("seq", "ts")


@query("R2_pruned_on_storage", with_("SELECT seq, epoch_us(ts) AS ts FROM m WHERE NOT (ts >= TIMESTAMP '2024-02-01' AND ts < TIMESTAMP '2024-02-15 12:30:00')", EV, ", " + _MONTHS))
def _(t):
    path = folder(t, "pruned-events")
    for k in (0, 1):
        days.write(_three_months(t).where(F.col("seq") % 2 == k), path, k)
    expiry.prune(t.spark, path, datetime(2024, 2, 15, 12, 30))
    return tables.read_events(t.spark, path).select("seq", "ts")


_LEFT = "session_id IN (SELECT session_id FROM se WHERE last_event_at >= TIMESTAMP '2024-01-29 12:00:00')"


@query("R3_expired_projections", with_(f"SELECT 'session' AS kind, session_id, session_id AS id FROM se WHERE {_LEFT} UNION ALL SELECT 'turn', session_id, prompt_id FROM tu WHERE {_LEFT} UNION ALL SELECT 'call', session_id, id FROM tc WHERE {_LEFT} UNION ALL SELECT 'agent', session_id, agent_id FROM sa WHERE {_LEFT}", EV, TC, SE, TU, SA))
def _(t):
    """What is left of four stored projections."""
    made = {"session": (t.sessions, "session_id"), "turn": (t.turns, "prompt_id"), "call": (t.tool_calls, "id"), "agent": (t.subagents, "agent_id")}
    paths = {k: folder(t, f"projection-{k}") for k in made}
    for k, (df, _) in made.items():
        tables.write_projection(df, paths[k])
    expiry.expire_sessions(t.spark, paths["session"], [p for k, p in paths.items() if k != "session"], datetime(2024, 1, 29, 12))
    out = None
    for k, (_, key) in made.items():
        one = t.spark.read.parquet(paths[k]).select(F.lit(k).alias("kind"), "session_id", F.col(key).alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


@query("R4_pruned_ledger", with_("SELECT dedup_key FROM ev WHERE ingested_at >= TIMESTAMP '2024-01-20 08:15:00'", EV))
def _(t):
    """The ledger that the batches of a stream have left, after its prune."""
    path = folder(t, "ledgered-events")
    jobs.run_available(_stream(t, t.events), jobs.store_batch(path, t.spark), folder(t, "ledger-checkpoint")).awaitTermination()
    expiry.prune(t.spark, jobs.ledger_of(path), datetime(2024, 1, 20, 8, 15), jobs.LEDGER_MONTH, "first_seen_at", earlier_months=True)
    return t.spark.read.parquet(jobs.ledger_of(path)).select("dedup_key")


@query("S8_compacted_batches", with_("SELECT seq, dedup_key FROM ev", EV))
def _(t):
    """Six batches, their days put together after the third, and all of them once more at the end."""
    path = folder(t, "compacted-events")
    store = jobs.store_batch(path, t.spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch, batch_id)
        if batch_id == 3:
            compact(batch_id)

    def compact(below: int) -> None:
        for m in days.months(t.spark, path):
            days.compact(t.spark, path, days.days(t.spark, path, m), below)

    spread = t.events.withColumn("ingested_at", F.timestamp_micros(F.unix_micros("ingested_at") + F.col("seq") % 6 * (5 * 86_400_000_000)))
    jobs.run_available(_stream(t, spread, 6), write, folder(t, "compacted-checkpoint")).awaitTermination()
    compact(100)
    return tables.read_events(t.spark, path).select("seq", "dedup_key")


# --- pages over sorted days, order numbers, trees of crowded sessions ---


@query("F15_clustered_pages", with_("SELECT * FROM (SELECT seq, epoch_us(ts) AS ts, 'on' AS way FROM ev ORDER BY ev.ts, vendor_seq NULLS LAST, seq LIMIT 900) UNION ALL SELECT * FROM (SELECT seq, epoch_us(ts), 'back' FROM ev WHERE session_id = 's5' ORDER BY ev.ts DESC, vendor_seq DESC NULLS FIRST, seq DESC LIMIT 40)", EV))
def _(t):
    """Pages of 300 and of 20, each from where the last one ended, over days that were sorted when their batches were put together."""
    path = folder(t, "clustered-events")
    for k in range(2):
        days.write(t.events.where(F.col("seq") % 2 == k), path, k)
    for m in days.months(t.spark, path):
        days.compact(t.spark, path, days.days(t.spark, path, m), 100, order=("ts", "seq"), files=2)
    out = None
    for way, size, pages, own in (("on", 300, 3, F.lit(True)), ("back", 20, 2, F.col("session_id") == "s5")):
        position, back = None, way == "back"
        for _ in range(pages):
            where = own if position is None else own & ex.events_after(position, back)
            rows = days.page(t.spark, path, ex.event_order(back), size, position and position[0], where, back)
            if rows is None:
                break
            rows = rows.select("seq", "ts", "vendor_seq", F.lit(way).alias("way"))
            last = rows.orderBy(*[c for c in ex.event_order(not back)]).first()
            if last is None:
                break
            position = (last.ts, last.vendor_seq, last.seq)
            out = rows if out is None else out.unionByName(rows)
    return t.events.select("seq", "ts", F.lit("").alias("way")).limit(0) if out is None else out.drop("vendor_seq")


@query("I6_busy_hour", with_("SELECT seq AS event, row_number() OVER (ORDER BY CASE WHEN seq % 10 > 0 THEN TIMESTAMP '2024-01-05 10:00:00' + to_microseconds(seq % 1000) ELSE ts END, dedup_key) + 1000 AS seq FROM ev", EV))
def _(t):
    """Nine of ten events in one second of one hour."""
    busy = F.timestamp_micros(F.lit(1_704_448_800_000_000) + F.col("seq") % 1000)
    rows = t.events.withColumn("event", F.col("seq")).withColumn("ts", F.when(F.col("seq") % 10 > 0, busy).otherwise(F.col("ts"))).drop("seq")
    return ing.with_sequence(rows, 1000).select("event", "seq")


_HEAP = "heap AS (SELECT event_id AS i, CASE WHEN event_id = 1 OR event_id % 997 = 0 THEN NULL WHEN event_id % 499 = 0 THEN event_id * 2 WHEN event_id % 503 = 0 THEN 1000000000 ELSE event_id // 2 END AS up FROM events), down AS (SELECT i, 1 AS depth, i::VARCHAR AS path FROM heap WHERE up IS NULL UNION ALL SELECT h.i, depth + 1, path || '/' || h.i FROM down JOIN heap h ON h.up = down.i WHERE depth < 16)"


@query("F18_crowded_tree", f"WITH RECURSIVE {_HEAP} SELECT 'a' || i AS agent_id, depth, 'a' || replace(path, '/', '/a') AS path FROM down")
def _(t):
    """All events as agents of one session, each under the one of half its number; some roots, cycles and agents never seen between them."""
    i = F.col("event_id")
    up = F.when((i == 1) | (i % 997 == 0), None).when(i % 499 == 0, i * 2).when(i % 503 == 0, 1_000_000_000).otherwise(F.floor(i / 2))
    agents = t.raw("events").select(F.lit("s").alias("session_id"), F.concat(F.lit("a"), i).alias("agent_id"), F.concat(F.lit("a"), up).alias("parent_agent_id"))
    return sa.tree_rows(agents, crowd=100).select("agent_id", "depth", "path")


# --- rebuilds of all projections, sessions over many batches ---


def _folds() -> dict:
    return {"sessions": ss.fold_sessions, "turns": ss.fold_turns, "tool_calls": lambda e: tc.fold_tool_calls(e, keyless=False), "subagents": sa.fold_subagents}


def _rebuilt(t: Tables, name: str) -> DataFrame:
    """A projection of every third event, with the touched sessions, which are all, folded anew."""
    fold = _folds()[name]
    return ss.rebuild(fold(t.events.where(F.col("seq") % 3 == 0)), t.events, ss.touched(t.events, START), fold)


@query("D29_rebuilt_calls", with_(f"SELECT {_TC} FROM tcw", EV, TC))
def _(t):
    return _rebuilt(t, "tool_calls")


@query("D29_rebuilt_agents", with_(f"SELECT {_SA}, coalesce(depth, 1)::BIGINT AS depth FROM sa LEFT JOIN tree USING (session_id, agent_id)", EV, SA))
def _(t):
    return _rebuilt(t, "subagents")


@query("Q12_equal_checksums", with_("SELECT 'sessions' AS projection, count(*) AS rows, true AS same FROM se UNION ALL SELECT 'turns', count(*), true FROM tu UNION ALL SELECT 'tool_calls', count(*), true FROM tc UNION ALL SELECT 'subagents', count(*), true FROM sa", EV, TC, SE, TU, SA))
def _(t):
    """Checksums of the four projections before a rebuild and after one from a stale part of the events."""
    out = None
    for name, fold in _folds().items():
        before, after = qu.checksum(fold(t.events)), qu.checksum(_rebuilt(t, name))
        one = before.join(after.select(F.col("rows").alias("rows2"), F.col("hash").alias("hash2")), F.lit(True)).select(F.lit(name).alias("projection"), "rows", ((F.col("rows") == F.col("rows2")) & (F.col("hash") == F.col("hash2"))).alias("same"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("S4_lifecycle_over_batches", with_("SELECT session_id, CASE WHEN bool_or(kind = 'session.end') THEN 'ended' WHEN max(ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR THEN 'abandoned' WHEN bool_or(kind = 'session.start') THEN 'active' ELSE 'unknown' END AS status, epoch_us(date_trunc('millisecond', max(ts))) AS last_event_at FROM ev GROUP BY session_id", EV))
def _(t):
    """Five batches: sessions are given up between them by their timers, come back, and end late."""
    _with_state_store(t)
    path = folder(t, "lifecycle")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    jobs.lifecycle(_stream(t, t.events, 5)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", folder(t, "lifecycle-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    rank = F.struct("last_event_at", "batch", F.col("status") == "abandoned")
    return t.spark.read.parquet(path).groupBy("session_id").agg(F.max_by("status", rank).alias("status"), F.max("last_event_at").alias("last_event_at"))
