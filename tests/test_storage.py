"""Day tables, expiry, the queue of dirty hours, and state over several batches."""

import os
import random
from datetime import date, datetime, timedelta

import pytest

from pyspark.sql import functions as F
from telemill.operators import rollups, tool_calls
from telemill.plans import canonical
from telemill.sources import days, expiry, folders, tables
from telemill.streaming import calls, jobs, rollup_queue

SMALL = "/root/testdata/sf0.001"
T0 = datetime(2024, 3, 1, 10)


def rows_at(spark, *times):
    return spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(times)], "dedup_key string, ts timestamp")


def keys(df):
    return sorted(r.dedup_key for r in df.select("dedup_key").collect())


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


# --- day tables and expiry ---


def test_days_read_replace_and_compact(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        days.write(rows_at(spark, T0, T0 + timedelta(days=1)).withColumn("dedup_key", F.concat("dedup_key", F.lit(f"-{k}"))), path, k)
    days.write(rows_at(spark, T0, T0 + timedelta(days=1)).withColumn("dedup_key", F.concat("dedup_key", F.lit("-3"))), path, 3)  # a retry
    whole = keys(spark.read.parquet(path))
    assert len(whole) == 8 and days.of(spark.read.parquet(path)) == ["2024-03-01", "2024-03-02"]
    assert keys(days.read(spark, path, ["2024-03-01", "2024-05-05"])) == [f"k0-{k}" for k in range(4)]
    assert days.read(spark, path, ["2024-05-05"]) is None
    assert days.compact(spark, path, ["2024-03-01", "2024-03-02"], 3) == 4
    assert folders.children(spark, f"{path}/event_month=2024-03/day=2024-03-01") == ["batch=2", "batch=3"]
    assert keys(spark.read.parquet(path)) == whole and len(files_of(path)) == 4
    assert days.compact(spark, path, ["2024-03-01"], 3) == 0
    days.replace(days.read(spark, path, ["2024-03-01"]).where("dedup_key <> 'k0-1'"), path, ["2024-03-01"])
    assert keys(spark.read.parquet(path)) == [x for x in whole if x != "k0-1"]
    days.replace(days.read(spark, path, ["2024-03-01"]).limit(0), path, ["2024-03-01"])
    assert keys(spark.read.parquet(path)) == [f"k1-{k}" for k in range(4)]


@pytest.mark.parametrize("broken", ["before", "between"])
def test_compaction_is_finished_after_a_failure(spark, tmp_path, monkeypatch, broken):
    """Broken off while it writes, or after some of the old folders are gone."""
    path = str(tmp_path / "t")
    for k in range(3):
        days.write(rows_at(spark, T0).withColumn("dedup_key", F.lit(f"b{k}")), path, k)
    real, seen = days.delete, []

    def failing(session, where):
        seen.append(where)
        if len(seen) == (1 if broken == "before" else 3):
            raise OSError("lost")
        real(session, where)

    monkeypatch.setattr(days, "delete", failing)
    with pytest.raises(OSError):
        days.compact(spark, path, ["2024-03-01"], 10)
    monkeypatch.setattr(days, "delete", real)
    assert days.compact(spark, path, ["2024-03-01"], 10) == 2
    assert keys(spark.read.parquet(path)) == ["b0", "b1", "b2"]
    assert folders.children(spark, f"{path}/event_month=2024-03/day=2024-03-01") == ["batch=2"]


def test_expired_months_go_by_name(spark, tmp_path):
    events, samples = str(tmp_path / "e"), str(tmp_path / "s")
    times = [datetime(2023, 12, 31, 23), datetime(2024, 1, 15), datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59)]
    tables.append_events(rows_at(spark, *times), events, 1)
    tables.append_samples(rows_at(spark, *times), samples, 1)
    both = {events: "event_month", samples: "sample_month"}
    before = files_of(tmp_path)
    told = expiry.expire(spark, both, date(2024, 2, 1), dry_run=True)
    assert told == {events: ["2023-12", "2024-01"], samples: ["2023-12", "2024-01"]} and files_of(tmp_path) == before
    assert expiry.expire(spark, both, date(2024, 2, 1)) == told
    assert keys(spark.read.parquet(events)) == keys(spark.read.parquet(samples)) == ["k2", "k3"]
    assert all(before[f] == t for f, t in files_of(tmp_path).items())
    assert expiry.expire(spark, both, date(2024, 2, 29)) == {events: [], samples: []}
    assert expiry.covered(spark, events, date(2023, 1, 1), date(2023, 12, 5)) == ["2024-02"]
    assert expiry.frame(spark, told).count() == 4


def test_prune_leaves_other_days_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    times = [datetime(2024, 1, 31), datetime(2024, 2, 3), datetime(2024, 2, 10, 11), datetime(2024, 2, 10, 13), datetime(2024, 2, 11), datetime(2024, 3, 1)]
    days.write(rows_at(spark, *times), path, 1)
    before = files_of(path)
    expiry.prune(spark, path, datetime(2024, 2, 10, 12))
    assert keys(spark.read.parquet(path)) == ["k0", "k3", "k4", "k5"]
    same = {f for f, t in files_of(path).items() if before.get(f) == t}
    assert len(same) == 3 and not any("2024-02-10" in f for f in same)
    expiry.prune(spark, path, datetime(2024, 2, 11), earlier_months=True)
    assert keys(spark.read.parquet(path)) == ["k4", "k5"]


def test_expired_sessions_take_their_rows_along(spark, tmp_path):
    old, new = T0 - timedelta(days=9), T0
    sessions = spark.createDataFrame([(f"s{i}", old if i % 5 == 0 else new) for i in range(40)], "session_id string, last_event_at timestamp")
    turns = spark.createDataFrame([(f"s{i}", f"p{k}") for i in range(40) for k in range(2)], "session_id string, prompt_id string")
    paths = {k: str(tmp_path / k) for k in ("sessions", "turns")}
    tables.write_projection(sessions, paths["sessions"])
    tables.write_projection(turns, paths["turns"])
    before = files_of(tmp_path)
    assert expiry.expire_sessions(spark, paths["sessions"], [paths["turns"]], T0 - timedelta(days=1)) == 8
    left = {f"s{i}" for i in range(40) if i % 5}
    for p, each in ((paths["sessions"], 1), (paths["turns"], 2)):
        got = [r.session_id for r in spark.read.parquet(p).collect()]
        assert sorted(got) == sorted(list(left) * each)
    assert any(before.get(f) == t for f, t in files_of(tmp_path).items())  # buckets without an old session
    assert expiry.expire_sessions(spark, paths["sessions"], [paths["turns"]], T0 - timedelta(days=1)) == 0


def test_small_files_and_listing(spark, tmp_path):
    file = str(tmp_path / "a" / "x")
    assert folders.create(spark, file, "one") and not folders.create(spark, file, "two")
    assert folders.text_of(spark, file) == "one" and folders.text_of(spark, file + "y") is None
    first = folders.modified(spark, str(tmp_path))
    os.truncate(file, 1)
    assert folders.modified(spark, str(tmp_path)) != first


# --- the queue of dirty hours ---


def hourly(e):
    return e.groupBy(rollups.hour("ts").alias("bucket")).agg(F.count("*").alias("n"))


def hours(spark, path):
    return {r.bucket: r.n for r in rollup_queue.read_rollup(spark, path).select(F.date_format("bucket", "dd HH").alias("bucket"), "n").collect()}


@pytest.fixture
def queued(spark, tmp_path):
    events, rollup = str(tmp_path / "events"), str(tmp_path / "rollup")
    queue = rollup_queue.Queue(spark, str(tmp_path / "queue"))

    def add(batch, *times):
        df = rows_at(spark, *times).withColumn("dedup_key", F.concat("dedup_key", F.lit(f"-{batch}")))
        days.write(df, events, batch)
        queue.mark(rollups.dirty_buckets(df), batch)

    def work(most=200, now=datetime(2030, 1, 1), fold=hourly):
        return rollup_queue.work(queue, {"event": (events, days.MONTH, fold)}, rollup, now, most)

    return queue, add, work, rollup, events


def test_passes_take_the_oldest_hours_first(spark, queued):
    queue, add, work, rollup, _ = queued
    add(0, T0, T0 + timedelta(hours=1), T0 + timedelta(hours=1), T0 + timedelta(days=2))
    assert work(2) == rollup_queue.Pass(2, 2)
    assert hours(spark, rollup) == {"01 10": 1, "01 11": 2} and queue.pending().count() == 1
    add(1, T0)  # late: its hour is dirty again, and the oldest
    assert work(1) == rollup_queue.Pass(1, 1)
    assert hours(spark, rollup) == {"01 10": 2, "01 11": 2}
    assert work().claimed == 1 and work().claimed == 0
    assert hours(spark, rollup) == {"01 10": 2, "01 11": 2, "03 10": 1}


def test_a_failed_pass_is_repeated(spark, queued, monkeypatch):
    """After the rollup is replaced and before the queue is cleared."""
    queue, add, work, rollup, _ = queued
    add(0, T0, T0)
    monkeypatch.setattr(queue, "clear", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        work()
    monkeypatch.undo()
    assert hours(spark, rollup) == {"01 10": 2} and queue.pending().count() == 1
    assert work() == rollup_queue.Pass(1, 1)
    assert hours(spark, rollup) == {"01 10": 2} and queue.pending().count() == 0


def test_a_mark_during_a_pass_stays(spark, queued):
    queue, add, work, rollup, _ = queued
    add(0, T0)
    claimed = queue.claim(10)
    add(1, T0)
    queue.clear(claimed, "first")
    assert [r.upto for r in queue.pending().collect()] == [1]
    work()
    assert hours(spark, rollup) == {"01 10": 2}


def test_one_pass_at_a_time(spark, queued):
    queue, add, work, rollup, _ = queued
    add(0, T0)
    token = queue.lease(600)
    assert work() == rollup_queue.Pass(busy=True)
    queue.release("another")
    assert queue.lease(600) is None
    queue.release(token)
    assert work().claimed == 1
    assert queue.lease(-1) and work().busy is False  # the holder's time is over


def test_expired_months_keep_their_rollup(spark, queued):
    queue, add, work, rollup, events = queued
    add(0, T0, datetime(2024, 4, 1))
    work()
    expiry.expire(spark, {events: days.MONTH}, date(2024, 4, 1))
    queue.mark(spark.createDataFrame([(T0,), (datetime(2024, 4, 1),)], "bucket timestamp").withColumn("source", F.lit("event")), 1)
    assert work() == rollup_queue.Pass(2, 1)
    assert hours(spark, rollup) == {"01 10": 1, "01 00": 1}


def test_emptied_hours_and_the_current_one(spark, queued):
    queue, add, work, rollup, events = queued
    add(0, T0, T0 + timedelta(hours=1))
    work()
    days.replace(days.read(spark, events, ["2024-03-01"]).where(F.hour("ts") == 11), events, ["2024-03-01"])
    assert work(now=T0 + timedelta(minutes=59)) == rollup_queue.Pass(0, 2)  # 10 and 9 o'clock, without a mark
    assert hours(spark, rollup) == {"01 11": 1}


def test_days_follow_their_hours(spark, tmp_path, queued):
    queue, add, _, rollup, events = queued
    daily = str(tmp_path / "daily")
    by_day = lambda h: h.groupBy(F.date_trunc("day", F.col("bucket")).alias("bucket"), "source").agg(F.sum("n").alias("n"))
    work = lambda: rollup_queue.work(queue, {"event": (events, days.MONTH, hourly)}, rollup, datetime(2030, 1, 1), daily_path=daily, daily=by_day)
    add(0, T0, T0 + timedelta(hours=1), T0 + timedelta(days=1))
    work()
    assert hours(spark, daily) == {"01 00": 2, "02 00": 1}
    add(1, T0 + timedelta(hours=1))
    days.replace(days.read(spark, events, ["2024-03-02"]).limit(0), events, ["2024-03-02"])
    queue.mark(spark.createDataFrame([(T0 + timedelta(days=1),), (T0 + timedelta(hours=1),)], "bucket timestamp").withColumn("source", F.lit("event")), 2)
    work()
    assert hours(spark, daily) == {"01 00": 3}


def test_many_marks_are_put_together(spark, queued, monkeypatch):
    monkeypatch.setattr(rollup_queue, "FOLDERS", 3)
    queue, add, work, rollup, _ = queued
    for k in range(6):
        add(k, T0 + timedelta(hours=k), T0)
    before = sorted(map(tuple, queue.pending().select("bucket", "source").collect()))
    work(2)
    assert len(folders.children(spark, f"{queue.path}/marks")) <= 3 and len(folders.children(spark, f"{queue.path}/done")) == 1
    assert sorted(map(tuple, queue.pending().select("bucket", "source").collect())) == before[2:]
    while work(2).claimed:
        pass
    assert hours(spark, rollup) == {f"01 {10 + k}": 6 if k == 0 else 1 for k in range(6)} | {"01 10": 7}


def test_reads_do_not_grow_with_history(spark, tmp_path):
    """The files that a batch reads are those of the days that it touches, however many came before."""
    events, rollup = str(tmp_path / "events"), str(tmp_path / "rollup")
    store, heal = jobs.store_batch(events, spark, window_days=1), jobs.heal(spark, events, hourly, rollup)
    seen = []
    real = days.read

    def counted(session, path, some, month=days.MONTH):
        df = real(session, path, some, month)
        seen[-1] += 0 if df is None else len(df.inputFiles())
        return df

    days_read = pytest.MonkeyPatch()
    days_read.setattr(days, "read", counted)
    try:
        for k in range(20):
            seen.append(0)
            at = T0 + timedelta(days=k)
            batch = rows_at(spark, at).withColumns({"dedup_key": F.lit(f"b{k}"), "ingested_at": F.col("ts")})
            store(batch, k)
            heal(batch, k)
    finally:
        days_read.undo()
    assert len(set(seen[2:])) == 1
    assert sum(hours(spark, rollup).values()) == 20


# --- keyless calls in state ---


def _files(spark, tmp_path, parts):
    src = str(tmp_path / "in")
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(src)


def tool_events(spark, rows):
    """(session, prompt, kind, source, use id, seconds, receipt seconds, key)."""
    base = canonical.events(spark, SMALL).limit(0)
    made = spark.createDataFrame(
        [(s, p, k, o, u, T0 + timedelta(seconds=t), T0 + timedelta(seconds=r), d, "Edit", i) for i, (s, p, k, o, u, t, r, d) in enumerate(rows)],
        "session_id string, prompt_id string, kind string, source string, tool_use_id string, ts timestamp, ingested_at timestamp, dedup_key string, tool_name string, seq long",
    )
    return base.unionByName(made, allowMissingColumns=True)


def matched(spark, tmp_path, batches, **options):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    stream = calls.placed(_files(spark, tmp_path, [tool_events(spark, b) for b in batches]), **options)
    out = str(tmp_path / "out")
    q = jobs.run_available(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert q.exception() is None
    return {r.dedup_key: (r.tool_use_id, r.call_id, r.heuristic) for r in spark.read.parquet(out).collect()}


TICK = ("~", "p", "tool.pre", "hook", "tick", 90_000, 90_000, "tick")


def test_three_concurrent_calls_match_one_each(spark, tmp_path):
    pre = [("s", "p", "tool.pre", "otel_log", f"u{i}", i, i, f"o{i}") for i in range(3)]
    hook = [("s", "p", "tool.pre", "hook", None, i + 0.05, i + 1, f"h{i}") for i in range(3)]
    got = matched(spark, tmp_path, [hook[:1] + pre[2:], pre[:2] + hook[1:], [TICK]])
    assert [got[f"h{i}"][1:] for i in range(3)] == [(got[f"o{i}"][1], True) for i in range(3)]


def test_windows_results_and_own_calls(spark, tmp_path):
    """A claim before its call, none after its result, none after a minute; a contribution's own call can be claimed once."""
    rows = [
        ("s", "p", "tool.pre", "hook", None, 0, 1, "before"), ("s", "p", "tool.pre", "otel_log", "u1", 50, 51, "call"), ("s", "p", "tool.result", "otel_log", "u1", 70, 71, "result"),
        ("s", "p", "tool.pre", "hook", None, 75, 76, "after"), ("s", "p", "tool.result", "hook", None, 80, 81, "again"), ("s", "p", "tool.result", "hook", None, 85, 86, "third"),
        ("s", None, "tool.pre", "hook", None, 52, 53, "other prompt"), ("s", "p", "tool.pre", "hook", None, 400, 401, "late"),
    ]
    got = matched(spark, tmp_path, [rows[:1], rows[1:4], rows[4:], [TICK]])
    call = {k: v[1] for k, v in got.items()}
    assert call["before"] == call["call"] == call["result"] and got["before"][2]
    assert call["again"] == call["after"] != call["call"] and not got["again"][2]
    assert len({call[k] for k in ("call", "after", "third", "other prompt", "late")}) == 5


def test_state_equals_the_walk_over_all(spark, tmp_path):
    """Random calls and contributions that arrive out of order over many batches."""
    r = random.Random(4)
    rows = []
    for i in range(240):
        at = r.randint(0, 3000)
        use = f"u{r.randint(0, 60)}" if r.random() < 0.5 else None
        kind = r.choice(["tool.pre", "tool.pre", "tool.decision", "tool.result"]) if use is None else "tool.pre"
        rows.append((r.choice("ab"), r.choice(["p", "q"]) if use is None else "pq"[int(use[1:]) % 2], kind, "hook" if use is None else "otel_log", use and f"{use}-{i}", at, at + r.randint(0, 280), f"k{i:03}"))
        if use and r.random() < 0.5:
            rows.append((*rows[-1][:2], "tool.result", "otel_log", rows[-1][4], at + 30, at + 30 + r.randint(0, 280), f"r{i:03}"))
    rows.sort(key=lambda x: x[6])
    got = matched(spark, tmp_path, [*(rows[k : k + 40] for k in range(0, len(rows), 40)), [TICK]])
    batch = tool_calls.assign_keyless(tool_calls.contributions(tool_events(spark, rows)), open_at_the_time=True)
    assert {k: v[1] for k, v in got.items() if k != "tick"} == {x.dedup_key: x.call_id for x in batch.collect()}
    assert sum(v[2] for v in got.values()) > 20


def test_projection_of_days(spark, tmp_path):
    """Calls over midnight, stored and folded by day, equal the fold of all."""
    rows = [(f"s{i % 3}", "p", k, "otel_log", f"u{i}", 3600 * 13 + 900 * i + d, 3600 * 13 + 900 * i + d, f"{k}{i}") for i in range(12) for k, d in (("tool.pre", 0), ("tool.decision", 2000), ("tool.result", 7000))]
    events = tool_events(spark, rows)
    placed = tool_calls.assign_keyless(tool_calls.contributions(events))
    stored, projection = str(tmp_path / "placed"), str(tmp_path / "calls")
    write = calls.project_calls(spark, stored, projection)
    for k in range(4):
        write(placed.where(F.col("seq") % 4 == k), k)
        write(placed.where(F.col("seq") % 4 == k), k)
    names = ["id", "tool_use_id", "started_at", "decided_at", "ended_at", "correlation", "event_count"]
    read = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert read(spark.read.parquet(projection)) == read(tool_calls.fold_tool_calls(events, keyless=False))
    assert len({r.started_at.date() for r in spark.read.parquet(projection).collect()}) == 2


# --- counters ---


def test_late_samples_change_both_differences(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    r = random.Random(8)
    values, total = [], 0.0
    for m in range(60):
        total = 0.5 if r.random() < 0.1 else total + r.randint(0, 9)
        values.append((m * 40, total))
    make = lambda some: spark.createDataFrame([("h", T0 + timedelta(minutes=m), float(v), f"k{m}", "cumulative") for m, v in some], "series_hash string, ts timestamp, value double, dedup_key string, temporality string")
    shuffled = list(values)
    r.shuffle(shuffled)
    stream = _files(spark, tmp_path, [make(shuffled[:20]), make(shuffled[15:40]), make(shuffled[40:])])
    out = str(tmp_path / "out")
    jobs.run_available(jobs.counter_deltas(stream), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "c")).awaitTermination(120)
    changes = spark.read.parquet(out)
    want = [v if i == 0 or v < values[i - 1][1] else v - values[i - 1][1] for i, (_, v) in enumerate(values)]
    assert [x.delta for x in jobs.latest_deltas(changes).orderBy("ts").collect()] == want
    assert abs(changes.agg(F.sum(F.col("delta") - F.coalesce("retracts", F.lit(0.0)))).first()[0] - sum(want)) < 1e-9
    assert changes.where("revision > 0").count() > 5


def test_samples_before_the_horizon(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    make = lambda *some: spark.createDataFrame([("h", T0 + timedelta(hours=h), float(v), f"k{h}", "cumulative") for h, v in some], "series_hash string, ts timestamp, value double, dedup_key string, temporality string")
    stream = _files(spark, tmp_path, [make((0, 1), (1, 4), (10, 20)), make((2, 6)), make((0.5, 2), (9, 15))])
    out = str(tmp_path / "out")
    jobs.run_available(jobs.counter_deltas(stream, 5 * 3_600_000), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "c")).awaitTermination(120)
    got = {x.dedup_key: (x.delta, x.revision) for x in spark.read.parquet(out).orderBy("revision").collect()}
    assert got["k0"] == (1.0, 0) and got["k1"] == (3.0, 0) and got["k2"] == (2.0, 0)
    assert got["k10"] == (5.0, 2) and got["k9"] == (9.0, 0) and got["k0.5"] == (None, -1)


# --- pages, percentiles, order numbers and trees under skew ---


def scanned(df):
    """(files, row groups' rows) that the plan's scans read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, rows, files = plan.toString(), 0, 0
    leaves = plan.finalPhysicalPlan().collectLeaves() if "AdaptiveSparkPlan" in text else plan.collectLeaves()
    for k in range(leaves.size()):
        m = leaves.apply(k).metrics()
        files += m.get("numFiles").get().value() if m.contains("numFiles") else 0
        rows += m.get("numOutputRows").get().value() if m.contains("numOutputRows") else 0
    return files, rows


def test_a_page_reads_few_files_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.parquet.filterPushdown", "true")
    rows = spark.range(40_000).select(F.col("id").alias("seq"), F.timestamp_micros(F.lit(1_709_280_000_000_000) + F.col("id") * 10_000_000).alias("ts"), F.lit(None).cast("long").alias("vendor_seq"))
    days.write(rows.orderBy(F.rand(1)), path, 0)
    days.compact(spark, path, days.days(spark, path, "2024-03"), 1, order=("ts", "seq"), files=4)
    before = files_of(path)
    days.compact(spark, path, days.days(spark, path, "2024-03"), 1, order=("ts", "seq"), files=4)
    assert files_of(path) == before  # sorted already
    start = datetime(2024, 3, 3, 20)
    page = days.page(spark, path, [F.col("ts"), F.col("seq")], 100, start)
    first = page.orderBy("ts").first()
    assert page.count() == 100 and first.ts == start
    files, read = scanned(page)
    assert files <= 4 * 4 and read < 4 * 8640  # four of five days' files are listed, and less than their rows are read
    back = days.page(spark, path, [F.col("ts").desc(), F.col("seq").desc()], 5, start, descending=True)
    assert [r.ts for r in back.collect()] == [start - timedelta(seconds=10 * k) for k in range(5)]
    assert days.page(spark, path, [F.col("ts")], 5, datetime(2025, 1, 1)) is None
    far = days.page(spark, path, [F.col("ts")], 5, where=F.col("seq") > 39_000, step=1)
    assert [r.seq for r in far.collect()] == [39_001, 39_002, 39_003, 39_004, 39_005]


@pytest.mark.parametrize("n", [3, 500, 30_000])
def test_percentiles_of_a_heavy_tail(spark, n):
    """One value that is far out does not put all others into one range."""
    from telemill.functions.percentiles import order_statistics

    r = random.Random(n)
    values = [r.paretovariate(0.3) for _ in range(n - 1)] + [1e300]
    values += values[: n // 3]
    values.sort()

    def exact(p):
        q = p * (len(values) - 1)
        lo, hi = values[int(q)], values[min(int(q) + (q > int(q)), len(values) - 1)]
        return lo + (q - int(q)) * (hi - lo)

    got = order_statistics(spark.createDataFrame([(v,) for v in values], "v double").repartition(4), "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99, "e": 1.0}).first()
    assert (got.lo, got.hi) == (values[0], values[-1])
    for name, p in zip("abcde", (0.0, 0.5, 0.95, 0.99, 1.0)):
        assert got[name] == pytest.approx(exact(p), rel=1e-12)


def test_order_numbers_of_a_busy_hour(spark):
    from telemill.operators import ingest

    rows = spark.range(20_000).select(F.format_string("k%05d", F.pmod(F.col("id") * 7919, F.lit(20_000))).alias("dedup_key"), F.when(F.col("id") % 10 > 0, F.lit(T0)).otherwise(F.timestamp_micros(F.unix_micros(F.lit(T0)) + (F.col("id") - 9_000) * 10**9)).alias("ts"))
    got = ingest.with_sequence(rows, 5)
    want = {r.dedup_key: k + 6 for k, r in enumerate(sorted(rows.collect(), key=lambda r: (r.ts, r.dedup_key)))}
    assert {r.dedup_key: r.seq for r in got.collect()} == want
    sizes = [r["count"] for r in spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).groupBy("__range").count().collect()]
    assert max(sizes) < 2 * 20_000 / len(sizes)


def test_lines_by_map_and_by_doubling(spark):
    from telemill.operators import subagents

    r = random.Random(6)
    agents = [("chain", f"c{i}", f"c{i - 1}" if i else None) for i in range(40)] + [("ring", f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("ring", "tail", "r0"), ("ring", "own", "own")] + [(s, x, y) for s, y in (("one", None), ("two", "up"), ("three", "gone")) for x, y in (("up", None), ("agent", y))]
    agents += [("wild", f"w{i}", r.choice([None, "unseen", *(f"w{k}" for k in range(60))])) for i in range(60)]
    links = spark.createDataFrame(agents, "session_id string, agent_id string, parent_agent_id string").select("session_id", "agent_id", F.coalesce("parent_agent_id", F.lit("")).alias("up"))
    for most in (1, 5, 16):
        a, b = (sorted(map(str, f(links, most).select("session_id", "agent_id", "path", "up").collect())) for f in (subagents._mapped_lines, subagents._doubled_lines))
        assert a == b
