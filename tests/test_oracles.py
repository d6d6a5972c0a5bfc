"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from telemill.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Quick ones of each family; the slow rest is compared by the driver.
SOME = ["D1_sessions", "D8_turns", "D15_tool_calls", "D22_subagents", "E4_estimates", "E11_metric_pivot", "F14_event_list", "F5_dominant_source", "G7_hourly_cost_by_project", "G16_decisions_by_source", "H4_turn_runs", "I5_accounts", "J9_as_of_prices", "Q9_hook_latency", "A6_hook_payloads", "A2_metric_points"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    own = [tuple(round(r[c], 8) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect()]
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in names]
    theirs = [tuple(round(x[i], 8) if isinstance(x[i], float) else x[i] for i in at) for x in rel.fetchall()]
    key = lambda x: tuple((v is None, str(v)) for v in x)
    assert sorted(own, key=key) == sorted(theirs, key=key)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_merged_attributes_need_no_query_before_them(spark, duck):
    """The first query of a session, with Spark's own settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    df = QUERIES["C3_merged_attributes"](own, SMALL)
    theirs = duck.sql(ORACLES["C3_merged_attributes"]).select(*df.columns).fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(theirs)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_balance_of_no_events(spark, duck, tmp_path):
    """Both accounts are there; and the bodies are made for flat and for nested requests only, not again for each kind of reject."""
    none = str(tmp_path / "none")
    spark.read.parquet(f"{SMALL}/events.parquet").limit(0).coalesce(1).write.parquet(f"{none}/events.parquet")
    assert sorted(tuple(r) for r in QUERIES["I5_balance"](spark, none).collect()) == [("event", 0), ("rejected", 0)]
    df = QUERIES["I5_balance"](spark, SMALL)
    assert sorted(tuple(r) for r in df.collect()) == sorted(duck.sql(ORACLES["I5_balance"]).fetchall())
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2
