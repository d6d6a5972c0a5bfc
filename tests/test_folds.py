"""Folds on hand-made events: ranks, matching, trees, and independence of the order of arrival."""

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from telemill import schemas
from telemill.functions.percentiles import order_statistics, percentiles, rounded
from telemill.operators import quality, sessions, subagents, timeline, tool_calls

T0 = datetime(2024, 3, 1, 10)


def events(spark, *rows):
    kinds = dict(x.split() for x in schemas.EVENTS.split(", "))
    base = {"vendor": "v", "source": "hook", "kind": "unknown", "event_name": "x", "session_id": "s", "clock_skewed": False, "attrs": "{}"}
    out = []
    for i, r in enumerate(rows):
        r = base | {"seq": i + 1, "dedup_key": f"k{i:03}", "ingested_at": T0} | r
        r["ts"] = T0 + timedelta(seconds=r.pop("s", i))
        out.append(tuple(r.get(c) for c in schemas.EVENT_COLUMNS))
    return spark.createDataFrame(out, ", ".join(f"{c} {kinds[c]}" for c in schemas.EVENT_COLUMNS))


def test_ranked_fields_prefer_logs_then_later(spark):
    e = events(
        spark,
        {"source": "otel_log", "permission_mode": "plan"},
        {"source": "hook", "permission_mode": "default"},
        {"source": "otel_log", "permission_mode": ""},
        {"kind": "session.start", "attrs": '{"cwd":"/a/b/","source":"resume"}'},
        {"kind": "workspace.cwd_changed", "attrs": '{"cwd":"/"}'},
    )
    got = sessions.fold_sessions(e).first()
    assert (got.permission_mode, got.project, got.cwd, got.start_type, got.status) == ("plan", "/", "/", "resume", "active")


def test_turn_takes_the_last_end(spark):
    e = events(spark, {"kind": "turn.end", "prompt_id": "p", "success": True}, {"kind": "turn.end", "prompt_id": "p", "success": False}, {"kind": "turn.start", "prompt_id": "q"}, {"prompt_id": None})
    got = {r.prompt_id: (r.status, r.turn_index) for r in sessions.fold_turns(e).collect()}
    assert got == {"p": ("failed", 0), "q": ("open", 1)}


def test_call_ids_are_version_five(spark):
    e = events(spark, {"kind": "tool.pre", "tool_name": "Bash", "tool_use_id": "u1"})
    got = tool_calls.fold_tool_calls(e).first()
    assert got.id == str(uuid.uuid5(uuid.UUID(tool_calls.NAMESPACE), "s|u1"))


def _keyless(spark, *rows, **more):
    return tool_calls.assign_keyless(tool_calls.contributions(events(spark, *[{"tool_name": "Bash", "prompt_id": "p"} | r for r in rows])), **more)


def test_keyless_claims_the_nearest_open_call_once(spark):
    rows = _keyless(
        spark,
        {"kind": "tool.pre", "tool_use_id": "u1", "s": 0, "source": "otel_log"},
        {"kind": "tool.pre", "tool_use_id": "u2", "s": 50, "source": "otel_log"},
        {"kind": "tool.permission_request", "s": 45},
        {"kind": "tool.permission_request", "s": 46},
        {"kind": "tool.permission_request", "s": 200},
        {"kind": "tool.permission_request", "s": 230},
    )
    calls = {r.dedup_key: r.call_id for r in rows.collect()}
    assert calls["k002"] == calls["k001"]  # nearest
    assert calls["k003"] == calls["k000"]  # the other one is taken
    space = uuid.UUID(tool_calls.NAMESPACE)
    assert calls["k004"] == calls["k005"] == str(uuid.uuid5(space, "s|p|Bash|0"))  # a new call, claimed once


def test_keyless_never_claims_a_call_that_ended(spark):
    rows = [{"kind": "tool.pre", "tool_use_id": "u1", "s": 0}, {"kind": "tool.result", "tool_use_id": "u1", "s": 30}, {"kind": "tool.permission_request", "s": 5}]
    calls = {r.dedup_key: r.call_id for r in _keyless(spark, *rows).collect()}
    assert calls["k002"] != calls["k000"]
    live = {r.dedup_key: r.call_id for r in _keyless(spark, *rows, open_at_the_time=True).collect()}
    assert live["k002"] == live["k000"]


def test_decision_precedence(spark):
    e = events(
        spark,
        {"kind": "tool.decision", "tool_name": "Bash", "tool_use_id": "u", "source": "otel_log", "decision": "accept", "decision_source": "config"},
        {"kind": "tool.decision", "tool_name": "Bash", "tool_use_id": "u", "source": "hook", "decision": "reject", "decision_source": "unknown"},
        {"kind": "tool.result", "tool_name": "Bash", "tool_use_id": "u", "source": "otel_log", "decision_source": "hook"},
    )
    got = tool_calls.fold_tool_calls(e).first()
    assert (got.decision, got.decision_source, got.correlation, got.wait_ms) == ("accept", "config", "exact", 0)


def test_subagent_cycle_and_long_chain(spark):
    chain = [{"kind": "subagent.start", "agent_id": f"c{i}", "parent_agent_id": f"c{i - 1}" if i else None} for i in range(20)]
    ring = [{"kind": "subagent.start", "agent_id": "x", "parent_agent_id": "y"}, {"kind": "subagent.start", "agent_id": "y", "parent_agent_id": "x"}]
    rows = {r.agent_id: r.depth for r in subagents.tree_rows(subagents.fold_subagents(events(spark, *chain, *ring))).collect()}
    assert rows == {f"c{i}": i + 1 for i in range(16)}


def test_subagent_stop_without_start_then_late_start(spark):
    stop = {"kind": "subagent.stop", "agent_id": "a", "success": False}
    assert subagents.fold_subagents(events(spark, stop)).first().status == "unknown"
    assert subagents.fold_subagents(events(spark, stop, {"kind": "subagent.start", "agent_id": "a"})).first().status == "failed"


def test_spawn_is_the_latest_call_not_after_the_start(spark):
    pre = {"kind": "tool.pre", "tool_name": "Task", "prompt_id": "p", "attrs": '{"tool_input":{"subagent_type":"plan"}}'}
    e = events(spark, pre | {"tool_use_id": "u1", "agent_id": "old"}, pre | {"tool_use_id": "u2", "agent_id": "near"}, {"kind": "subagent.start", "agent_id": "a", "agent_type": "plan", "prompt_id": "p"}, pre | {"tool_use_id": "u3", "agent_id": "late"})
    got = subagents.fold_subagents(e).first()
    assert (got.parent_agent_id, got.spawn_tool_use_id) == ("near", "u2")


def test_order_and_split_do_not_matter(spark):
    rows = [{"kind": k, "source": s, "tool_name": "Bash", "tool_use_id": f"u{i % 3}", "prompt_id": f"p{i % 2}", "decision": "accept", "permission_mode": f"m{i}"} for i, (k, s) in enumerate([("tool.pre", "hook"), ("tool.decision", "otel_log"), ("tool.result", "otel_log")] * 4)]
    e = events(spark, *rows)
    shuffled = e.orderBy(F.xxhash64("seq")).repartition(3)
    for fold in (sessions.fold_sessions, sessions.fold_turns, tool_calls.fold_tool_calls):
        assert quality.checksum(fold(e)).first() == quality.checksum(fold(shuffled)).first()
    fold = lambda x: tool_calls.fold_tool_calls(x, keyless=False)
    stored = fold(e.where("seq <= 5"))
    again = sessions.rebuild(stored, e, e.where("seq > 5").select("session_id").distinct(), fold)
    assert quality.checksum(again).first() == quality.checksum(fold(e)).first()


def test_moments_collapse_around_their_first_member(spark):
    rows = [{"kind": "tool.pre", "tool_use_id": "u", "s": s} for s in (0, 1.5, 3, 4.5)] + [{"kind": "tool.pre", "tool_use_id": "u", "s": 0.5, "clock_skewed": True}]
    got = {r.seq: r.moment for r in timeline.groups_of_moments(events(spark, *rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_runs_and_continuations(spark):
    e = events(spark, *[{"prompt_id": p} for p in ["a", "a", "b", None, None, "a"]])
    got = [(r.run, r.continuation) for r in timeline.turn_runs(e).orderBy("seq").collect()]
    assert [r for r, _ in got] == [1, 1, 2, 3, 3, 4]
    assert [c for _, c in got] == [False, False, False, False, False, True]


def test_empty_input(spark):
    e = events(spark, {}).limit(0)
    for fold in (sessions.fold_sessions, sessions.fold_turns, tool_calls.fold_tool_calls, subagents.fold_subagents):
        assert fold(e).count() == 0


def test_depths_are_clamped(spark):
    chain = [("s", f"a{i}", f"a{i - 1}" if i else None) for i in range(20)]
    rest = [("s", "x", "y"), ("s", "y", "x"), ("s", "o", "never seen"), ("s", "under", "x"), ("t", "a1", None)]
    agents = spark.createDataFrame(chain + rest, "session_id string, agent_id string, parent_agent_id string")
    got = {(r.session_id, r.agent_id): r.depth for r in subagents.depths(agents).collect()}
    assert got == {("s", f"a{i}"): min(i + 1, 16) for i in range(20)} | {("t", "a1"): 1}
    assert {r.agent_id for r in subagents.tree_rows(agents).where("session_id = 's'").collect()} == {f"a{i}" for i in range(16)}


def test_percentile_at_a_tie(spark):
    rows = spark.createDataFrame([("s", 71), ("s", 241), ("s", 1406), ("t", None), ("u", 5)], "k string, v long")
    got = {r.k: r for r in percentiles(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).select("k", "p50", rounded("p95").alias("p95")).collect()}
    assert (got["s"].p50, got["s"].p95, got["u"].p95) == (241.0, 1290, 5) and "t" not in got
    whole = order_statistics(rows, "v", {"p50": 0.5, "p95": 0.95}, 3).first()
    assert (whole.lo, whole.hi, whole.p50) == (5.0, 1406.0, 156.0) and abs(whole.p95 - (241 + 0.85 * 1165)) < 1e-9
    assert order_statistics(rows.limit(0), "v", {"p50": 0.5}).first().p50 is None
    assert [r[0] for r in spark.createDataFrame([(2.5,), (-2.5,), (-0.4,)], "x double").select(rounded("x")).collect()] == [3, -3, 0]
