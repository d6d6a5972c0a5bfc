"""Metric series, buckets and windows on hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from telemill import schemas
from telemill.operators import analytics, ingest, rollups
from telemill.session import require_utc

T0 = datetime(2024, 3, 1, 10, 30)


def samples(spark, *rows):
    out = [(T0 + timedelta(minutes=m), T0, "n", "v", "s", float(x), kind, series, "{}", f"k{i:02}") for i, (series, kind, m, x) in enumerate(rows)]
    return spark.createDataFrame(out, schemas.METRIC_SAMPLES)


def test_reset_gauge_and_unknown_temporality(spark):
    s = samples(spark, ("c", "cumulative", 0, 5), ("c", "cumulative", 1, 9), ("c", "cumulative", 2, 3), ("d", "delta", 0, 4), ("g", "gauge", 0, 1), ("g", "gauge", 5, 7), ("g", "gauge", 40, 2), ("u", "odd", 0, 6), ("u", "odd", 1, 8))
    got = [r.delta for r in rollups.sample_deltas(s).orderBy("dedup_key").collect()]
    assert got == [5, 4, 3, 4, 0, 7, 2, 0, 8]
    assert rollups.series_checkpoint(s).first().last_value == 3


def test_claims_take_the_oldest_and_the_current_hours(spark):
    dirty = spark.createDataFrame([(T0 - timedelta(hours=h), "event") for h in range(5, 9)], "bucket timestamp, source string")
    got = {(r.bucket, r.source) for r in rollups.claim(dirty, 2, T0).collect()}
    now = T0.replace(minute=0)
    assert got == {(T0 - timedelta(hours=8), "event"), (T0 - timedelta(hours=7), "event")} | {(now - timedelta(hours=h), s) for h in (0, 1) for s in ("event", "metric")}


def test_a_model_filter_needs_a_metric_with_models(spark):
    q = analytics.Query(T0, models=("m",))
    with pytest.raises(analytics.UnsupportedFilter):
        analytics.timeseries(None, None, "turns", q)
    with pytest.raises(analytics.UnsupportedFilter):
        analytics.breakdown("tool", q)
    assert q.window() == (T0 - timedelta(hours=24), T0) and q.bucket() == "hour"
    assert analytics.Query(T0, T0 - timedelta(days=8)).bucket() == "day"


def test_too_old_rows_never_meet_the_ledger(spark):
    rows = spark.createDataFrame([(T0, "a", 1), (T0, "a", 2), (T0 - timedelta(days=400), "b", 3), (T0, "c", 4)], "ts timestamp, dedup_key string, seq long")
    ledger = spark.createDataFrame([("c", T0)], "dedup_key string, first_seen_at timestamp")
    months = ingest.months_between(spark, T0, T0)
    got = {r.seq: r.outcome for r in ingest.outcome(rows, ledger, months).collect()}
    assert got == {1: "written", 2: "deduped", 3: "too_old", 4: "deduped"}
    assert [r.seq for r in ingest.survivors(rows, ledger, months).collect()] == [1]


def test_numbers_by_time_and_key(spark):
    rows = spark.range(300).select((F.lit(T0) + F.make_dt_interval(F.lit(0), (F.col("id") * 7 % 11).cast("int"))).alias("ts"), F.concat(F.lit("k"), "id").alias("dedup_key"))
    got = ingest.with_sequence(rows, 1000).collect()
    want = sorted(got, key=lambda r: (r.ts, r.dedup_key))
    assert [r.seq for r in want] == list(range(1001, 1301))


def test_time_zone_is_checked(spark):
    require_utc(spark)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def sorts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Window [")


def test_series_are_ordered_once_and_dealt_by_rows(spark, monkeypatch):
    """A gauge's hours had an order of their own beside its series', the made counter had two, and a small file was one task however many rows it held."""
    from telemill.plans import canonical

    s = samples(spark, ("g", "gauge", 0, 1), ("g", "gauge", 31, 7), ("g", "gauge", 40, 2), ("c", "cumulative", 0, 5))
    assert sorts(rollups.sample_deltas(s)) == 1
    assert rollups.sample_deltas(s, 7).rdd.getNumPartitions() == 7
    assert [r.delta for r in rollups.sample_deltas(s, 7).orderBy("dedup_key").collect()] == [1, 0, 2, 5]
    monkeypatch.setattr(canonical, "TASK_ROWS", 300)
    small = "/root/testdata/sf0.001"
    rows = canonical.table(spark, small, "events").count()
    assert canonical.events(spark, small).rdd.getNumPartitions() == canonical.metric_samples(spark, small).rdd.getNumPartitions() == -(-rows // 300) > 1
