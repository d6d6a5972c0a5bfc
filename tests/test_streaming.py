"""Streams over files equal the batch operators, late files included."""

import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from telemill import schemas
from telemill.operators import rollups
from telemill.plans import canonical
from telemill.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def _files(spark, tmp_path, parts):
    src = str(tmp_path / "in")
    for k, df in enumerate(parts):
        df.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(src)


def _run(q):
    q.awaitTermination(120)
    assert q.exception() is None and not q.isActive


def test_store_and_heal_equal_batch(spark, tmp_path):
    e = canonical.events(spark, SMALL)
    # every event once or twice, the later half first
    parts = [e.where("seq >= 500"), e.where("seq < 600"), e.where("seq % 3 = 0")]
    stream = _files(spark, tmp_path, parts)
    store = jobs.store_batch(str(tmp_path / "events"), spark)
    fold = lambda x: rollups.event_rollup(x, x.select("session_id").distinct().withColumn("project", F.lit(""))).withColumn("source", F.lit("event"))
    heal = jobs.heal(spark, str(tmp_path / "events"), fold, str(tmp_path / "rollup"))

    def both(batch, batch_id):
        store(batch, batch_id)
        store(batch, batch_id)  # a repeated batch changes nothing
        heal(batch, batch_id)

    _run(jobs.run_available(stream, both, str(tmp_path / "c1")))
    stored = spark.read.parquet(str(tmp_path / "events"))
    assert stored.count() == stored.select("dedup_key").distinct().count() == e.count()
    names = ["bucket", "vendor", "model", "turns", "api_requests", "input_tokens"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "rollup")).select(*names).collect())) == sorted(map(tuple, fold(e).select(*names).collect()))


def _memory(spark, df, name, tmp_path, mode="append"):
    _run(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    return spark.table(name)


def test_dedup_and_live_view(spark, tmp_path):
    e = canonical.events(spark, SMALL)
    stream = _files(spark, tmp_path, [e.where("seq < 500"), e.where("seq < 500")])
    assert _memory(spark, jobs.deduplicated(stream).select("dedup_key"), "dedup", tmp_path).count() == 500
    live = _memory(spark, jobs.live_hourly(stream), "live", tmp_path, "update")
    assert live.count() > 0


def _events(spark, *rows):
    t0 = datetime(2024, 3, 1, 10)
    return spark.createDataFrame([(s, k, t0 + timedelta(minutes=m)) for s, k, m in rows], "session_id string, kind string, ts timestamp")


def test_lifecycle_with_idle_time(spark, tmp_path):
    src = str(tmp_path / "in")
    first = _events(spark, ("a", "session.start", 0), ("b", "session.start", 0), ("b", "session.end", 5), ("c", "tool.pre", 0))
    first.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")

    def run():
        _run(jobs.lifecycle(stream).writeStream.foreachBatch(lambda b, i: b.withColumn("i", F.lit(i)).write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
        return {r.session_id: r.status for r in spark.read.parquet(out).groupBy("session_id").agg(F.max_by("status", F.struct("i", "last_event_at")).alias("status")).collect()}

    assert run() == {"a": "active", "b": "ended", "c": "unknown"}
    _events(spark, ("z", "session.start", 600)).coalesce(1).write.mode("append").parquet(src)
    _events(spark, ("z", "session.end", 601)).coalesce(1).write.mode("append").parquet(src)
    got = run()
    assert got["a"] == got["c"] == "abandoned" and got["b"] == got["z"] == "ended"


def test_counter_state(spark, tmp_path):
    t0 = datetime(2024, 3, 1, 10)
    src = str(tmp_path / "in")
    rows = lambda *vs: spark.createDataFrame([("h", t0 + timedelta(minutes=m), float(v), f"k{m}", "cumulative") for m, v in vs], "series_hash string, ts timestamp, value double, dedup_key string, temporality string")
    rows((0, 5), (1, 8)).coalesce(1).write.parquet(src)
    rows((2, 3), (3, 4)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows((0, 0)).schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = _memory(spark, jobs.counter_deltas(stream), "counters", tmp_path)
    assert [r.delta for r in got.orderBy("ts").collect()] == [5.0, 3.0, 3.0, 1.0]


def test_large_arrivals_are_several_files_and_one_batch(spark, tmp_path, monkeypatch):
    """An arrival was one file, which one task wrote and read, however large it was."""
    from telemill.plans import rows

    monkeypatch.setattr(rows, "FILE_ROWS", 400)
    monkeypatch.setattr(rows, "folder", lambda t, name: str(tmp_path / name))
    given = spark.range(3000).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ingested_at"))
    stream = rows._stream(SimpleNamespace(spark=spark), given)
    got = []
    jobs.run_available(stream, lambda b, k: got.append((k, [r.id for r in b.select("id").collect()])), str(tmp_path / "checkpoint")).awaitTermination()
    assert len(list((tmp_path / "arriving").glob("*.parquet"))) == 9 and len(got) == 3
    ends = [(min(ids), max(ids), len(ids)) for _, ids in sorted(got)]
    assert ends[0][0] == 0 and ends[2][1] == 2999 and all(a[1] + 1 == b[0] for a, b in zip(ends, ends[1:])) and sum(e[2] for e in ends) == 3000


class FakeState:
    """State values and maps without a store, and how often they are asked."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def getValueState(self, *_):
        return FakeState()

    def getMapState(self, name, *_):
        self.map = FakeState()
        return self.map

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer

    def exists(self):
        return bool(self.data)

    def get(self):
        return self.data["value"]

    def update(self, value):
        self.data["value"] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.data

    def getValue(self, key):
        self.calls += 1
        return self.data[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.data[key] = value

    def removeKey(self, key):
        del self.data[key]


def test_counters_keep_many_hours_in_a_value(monkeypatch):
    """Each hour was a value of its own, read and written in every batch that touched it."""
    rows = [(k * 3_600_000_000, f"k{k}", float(k * 7 % 50)) for k in range(600)]
    want = {k: v if i == 0 or v < rows[i - 1][2] else v - rows[i - 1][2] for i, (_, k, v) in enumerate(rows)}
    for block in (jobs.BLOCK, 5):
        monkeypatch.setattr(jobs, "BLOCK", block)
        handle, counters, got = FakeState(), jobs.Counters(1000 * 86_400_000), {}
        counters.init(handle)
        for some in (rows[::2], rows[1::3], rows):  # late ones, and the same again
            for out in counters.handleInputRows(("h",), iter([pd.DataFrame(some, columns=["at", "dedup_key", "value"])]), None):
                got |= {r.dedup_key: r.delta for r in out.sort_values("revision").itertuples()}
        assert got == want
        assert (len(handle.map.data) > 100) if block == 5 else (handle.map.calls < 20)


def test_a_small_arrival_leaves_large_ones_in_several_files(spark, tmp_path, monkeypatch):
    """An arrival of few rows made every arrival one file, which one task wrote and read."""
    from telemill.plans import rows

    monkeypatch.setattr(rows, "FILE_ROWS", 400)
    monkeypatch.setattr(rows, "folder", lambda t, name: str(tmp_path / name))
    given = spark.range(1201).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") < 1200, F.col("id")).otherwise(86_400)).alias("ingested_at"))
    stream, got = rows._stream(SimpleNamespace(spark=spark), given, 3), []
    jobs.run_available(stream, lambda b, k: got.append((k, b.count(), b.where("id = 1200").count())), str(tmp_path / "checkpoint")).awaitTermination()
    full = [f for f in (tmp_path / "arriving").glob("part-*.parquet") if spark.read.parquet(str(f)).count()]
    assert sorted(got) == [(0, 1200, 0), (1, 0, 0), (2, 1, 1)] and len(full) >= 4


def test_claims_do_not_search_all_calls_of_a_session(monkeypatch):
    """Each contribution was held against every call of its session, and asked the store for the number of each call that it opened."""
    from telemill.streaming import calls

    handle, matcher, n = FakeState(), calls.Matcher(), 2000
    matcher.init(handle)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**12)
    place, tried = json.dumps(["p", "Edit"]), 0
    start = calls._start

    def counted(call):
        nonlocal tried
        tried += 1
        return start(call)

    monkeypatch.setattr(calls, "_start", counted)
    known = {f"c{i:05}": [place, None, i * 10**6, i * 10**6, None, None, False] for i in range(n)}
    held = {"calls": known, "asks": [[i * 10**6 + 1, None, f"k{i}", place, "r"] for i in range(2 * n)], "timer": None}
    out = matcher._placed("s", held, now)
    assert [(c, h) for _, c, h, _ in out[:n]] == [(f"c{i:05}", True) for i in range(n)] and len({c for _, c, _, _ in out}) == n + n // 2  # of the rest every second one claims the call that the one before it opened
    assert tried <= 4 * n and handle.map.calls <= 3
