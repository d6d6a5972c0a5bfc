"""Common table expressions of the DuckDB oracles: the canonical events and the projections, written for DuckDB."""

from __future__ import annotations

from telemill.operators.tool_calls import NAMESPACE
from telemill.plans.canonical import PRICE_ROWS

EV = r"""
raw AS (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k, CAST(floor(value) AS BIGINT) AS f FROM events),
e1 AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'llm.request' WHEN event_type = 'error' THEN ['llm.error', 'hook.execution_end', 'unknown'][k % 3 + 1]
    WHEN event_type IN ('click', 'view') AND k % 10 = 8 THEN CASE WHEN event_type = 'click' THEN 'subagent.start' ELSE 'subagent.stop' END
    WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'tool.pre' ELSE 'tool.decision' END WHEN event_type = 'view' THEN 'tool.result'
    WHEN k % 4 = 0 AND (user_id % 11 = 0 OR k % 20 = 16) THEN 'session.end' WHEN k % 4 < 3 THEN ['session.start', 'turn.start', 'turn.end'][k % 4 + 1] ELSE 'permission.mode_changed' END AS kind FROM raw),
e2 AS (SELECT *, CASE WHEN kind IN ('session.start', 'session.end', 'turn.start', 'turn.end', 'tool.pre', 'subagent.start', 'subagent.stop') OR kind = 'tool.result' AND k % 2 = 1 THEN 'hook' ELSE 'otel_log' END AS source,
    's' || user_id AS session_id, CASE WHEN k % 20 <> 19 THEN 's' || user_id || '-' || strftime(ts, '%Y-%m-%d') END AS prompt_id,
    CASE WHEN kind LIKE 'tool.%' THEN ['Bash', 'Read', 'Edit', 'Task'][k % 4 + 1] END AS tool_name, CASE WHEN kind LIKE 'subagent.%' THEN k // 10 END AS n FROM e1),
ev AS (SELECT event_id AS seq, ts, ts + to_minutes(k % 7) AS ingested_at, session_id, prompt_id, CASE WHEN user_id % 5 = 0 THEN 'other_agent' ELSE 'claude_code' END AS vendor, source, kind,
    CASE WHEN kind = 'unknown' THEN 'mystery_' || (k % 5) ELSE replace(kind, '.', '_') END AS event_name, CASE WHEN source <> 'hook' THEN event_id % 1000 END AS vendor_seq, tool_name,
    CASE WHEN kind LIKE 'tool.%' THEN coalesce(prompt_id, session_id) || '-' || tool_name || '-' || (k // 25) END AS tool_use_id,
    CASE WHEN kind = 'tool.decision' THEN CASE WHEN k % 5 < 3 THEN 'accept' WHEN k % 5 = 3 THEN 'reject' END END AS decision,
    CASE WHEN kind = 'tool.decision' OR kind = 'tool.result' AND source = 'otel_log' THEN ['config', 'hook', 'user_permanent', 'user_temporary', 'user_reject', NULL][k % 6 + 1] END AS decision_source,
    CASE WHEN kind = 'tool.decision' AND k % 7 < 4 THEN 'builtin' END AS tool_source, CASE WHEN kind IN ('llm.request', 'llm.error') THEN ['main', 'subagent', 'compact', NULL][k % 4 + 1] END AS query_source,
    CASE WHEN kind IN ('llm.request', 'llm.error') THEN ['opal-2', 'opal-2-20240110', 'quartz-1'][k % 3 + 1] END AS model,
    CASE WHEN kind = 'llm.request' THEN k * 10 + f END AS input_tokens, CASE WHEN kind = 'llm.request' THEN k * 3::BIGINT END AS output_tokens, CASE WHEN kind = 'llm.request' THEN f * 2 END AS cache_read_tokens, CASE WHEN kind = 'llm.request' THEN k::BIGINT END AS cache_creation_tokens,
    CASE WHEN kind = 'llm.request' AND k % 4 <> 0 THEN CAST(value / 100 AS DECIMAL(16, 8)) END AS cost_usd, CASE WHEN kind = 'llm.request' THEN 'reported' END AS cost_source,
    CASE WHEN kind IN ('llm.request', 'tool.result', 'hook.execution_end') AND k % 9 <> 0 THEN CAST(trunc(value * 10) AS INTEGER) END AS duration_ms,
    CASE kind WHEN 'llm.request' THEN true WHEN 'llm.error' THEN false WHEN 'tool.result' THEN k % 5 <> 0 WHEN 'turn.end' THEN k % 3 <> 0 WHEN 'hook.execution_end' THEN k % 8 <> 0 WHEN 'subagent.stop' THEN CASE WHEN n % 3 = 0 THEN NULL ELSE n % 2 = 0 END END AS success,
    CASE WHEN kind = 'llm.error' THEN 'http_' || (400 + k % 4) WHEN kind = 'tool.result' AND k % 5 = 0 THEN 'tool_error' END AS error_type,
    CASE WHEN n IS NOT NULL THEN 'a' || n WHEN kind IN ('tool.pre', 'tool.result') AND source = 'hook' AND k % 3 = 0 THEN 'a' || (k % 10) END AS agent_id,
    CASE WHEN kind = 'subagent.start' THEN CASE WHEN n = 3 AND user_id % 13 = 0 THEN 'a9' WHEN n >= 3 THEN 'a' || (n // 3) END END AS parent_agent_id,
    CASE WHEN n IS NOT NULL THEN ['explore', 'plan', 'review'][n % 3 + 1] END AS agent_type,
    CASE WHEN kind = 'permission.mode_changed' THEN 'acceptEdits' WHEN source = 'hook' THEN ['default', 'plan', NULL][k % 3 + 1] END AS permission_mode,
    CASE WHEN kind = 'tool.pre' AND tool_name IN ('Read', 'Edit') THEN '/f/' || k END AS file_path, CASE WHEN kind = 'llm.request' THEN 'r' || event_id END AS request_id, k % 50 = 49 AS clock_skewed, 'e:' || event_id AS dedup_key,
    CASE WHEN kind = 'session.start' THEN '/work/p' || (user_id % 7) || CASE WHEN k % 8 = 0 THEN '/' ELSE '' END END AS a_cwd, CASE WHEN kind = 'session.start' THEN 'p' || (user_id % 7) END AS a_project,
    CASE WHEN kind = 'session.start' THEN CASE WHEN k % 3 = 0 THEN 'resume' ELSE 'startup' END END AS a_source, CASE WHEN kind = 'session.end' THEN CASE WHEN k % 3 = 0 THEN 'logout' ELSE 'other' END END AS a_reason,
    CASE WHEN source = 'otel_log' THEN CASE WHEN k % 5 > 0 THEN '1.' || (k % 4) ELSE '0.9' END END AS a_version, CASE WHEN source = 'otel_log' AND k % 6 = 0 THEN 'xterm' END AS a_terminal, CASE WHEN source = 'otel_log' THEN 'u' || user_id || '@example.com' END AS a_email,
    CASE WHEN kind = 'permission.mode_changed' THEN CASE WHEN k % 8 = 3 THEN 'shift_tab' ELSE 'command' END END AS a_trigger, CASE WHEN kind = 'hook.execution_end' THEN ['PreToolUse', 'PostToolUse', 'Stop'][k % 9 // 3 + 1] END AS a_hook, CASE WHEN kind = 'hook.execution_end' THEN k % 4 END AS a_cancelled,
    CASE WHEN kind = 'tool.result' AND source = 'otel_log' THEN k * 7 END AS a_in, CASE WHEN kind = 'tool.result' AND source = 'otel_log' THEN k * 11 END AS a_out, CASE WHEN kind = 'tool.pre' AND tool_name = 'Task' THEN ['explore', 'plan', 'review'][k % 3 + 1] END AS a_subagent,
    CASE WHEN source = 'otel_log' THEN 30 ELSE 20 END AS rank, user_id, k
  FROM e2)"""


def pick(value: str, rank: str | None = "rank", when: str = "true") -> str:
    order = f"row({rank}, ts, seq)" if rank else "row(ts, seq)"
    return f"arg_max({value}, {order}) FILTER (WHERE {value} IS NOT NULL AND ({when}))"


def uuid5(name: str) -> str:
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"({h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || '89ab'[(instr('0123456789abcdef', {h}[17]) - 1) % 4 + 1] || {h}[18:20] || '-' || {h}[21:32])"


_TOKENS = ", ".join(f"coalesce(sum({c}) FILTER (WHERE kind = 'llm.request'), 0)::BIGINT AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"))
_DR = "CASE WHEN source = 'otel_log' AND kind = 'tool.decision' THEN 30 WHEN source = 'otel_log' AND kind = 'tool.result' THEN 20 WHEN source = 'hook' THEN 10 ELSE 0 END"

TC = f""",
tc0 AS (SELECT *, {uuid5("session_id || '|' || tool_use_id")} AS id, {_DR} AS dr FROM ev WHERE kind IN ('tool.pre', 'tool.decision', 'tool.permission_request', 'tool.result')),
tc AS (SELECT session_id, id, arg_min(prompt_id, row(ts, seq)) FILTER (WHERE prompt_id IS NOT NULL) AS prompt_id, any_value(tool_use_id) AS tool_use_id, any_value(tool_name) AS tool_name,
    {pick("tool_source", "dr")} AS tool_source, {pick("decision", "dr")} AS decision, {pick("decision_source", "dr")} AS decision_source, {pick("agent_id")} AS agent_id, {pick("permission_mode")} AS permission_mode, {pick("duration_ms")} AS duration_ms,
    {pick("success")} AS success, {pick("error_type")} AS error_type, {pick("file_path")} AS file_path, {pick("a_in")} AS input_size_bytes, {pick("a_out")} AS result_size_bytes,
    coalesce(min(ts) FILTER (WHERE kind IN ('tool.pre', 'tool.decision')), min(ts)) AS started_at, {pick("ts", "dr", "kind = 'tool.decision'")} AS decided_at, max(ts) FILTER (WHERE kind = 'tool.result') AS ended_at,
    CASE WHEN bool_or(source = 'otel_log') AND bool_or(source = 'hook') THEN 'exact' WHEN bool_or(source = 'otel_log') THEN 'otel_only' ELSE 'hook_only' END AS correlation, count(*) AS event_count FROM tc0 GROUP BY session_id, id),
tcw AS (SELECT *, floor((epoch_us(decided_at) - epoch_us(started_at)) / 1000)::BIGINT AS wait_ms FROM tc)"""

SE = f""",
cm AS (SELECT session_id, coalesce(query_source, '') AS qs, coalesce(sum(cost_usd), 0)::DECIMAL(16, 8) AS cost FROM ev WHERE kind = 'llm.request' GROUP BY ALL),
se AS (SELECT session_id, {pick("vendor", None)} AS vendor, {pick("a_project")} AS project, {pick("a_cwd")} AS cwd, {pick("a_source")} AS start_type, {pick("a_reason")} AS end_reason, {pick("permission_mode")} AS permission_mode, {pick("a_version")} AS app_version,
    {pick("a_terminal")} AS terminal_type, {pick("a_email")} AS user_email, min(ts) FILTER (WHERE kind = 'session.start') AS started_at, max(ts) FILTER (WHERE kind = 'session.end') AS ended_at, min(ts) AS first_seen_at, max(ts) AS last_event_at,
    count(*) AS event_count, {_TOKENS}, coalesce(sum(cost_usd) FILTER (WHERE kind = 'llm.request'), 0)::DECIMAL(16, 8) AS cost_usd, 0::DECIMAL(16, 8) AS cost_estimated_usd,
    list_sort(list(DISTINCT model) FILTER (WHERE kind = 'llm.request')) AS models,
    CASE WHEN bool_or(kind = 'session.end') THEN 'ended' WHEN bool_or(kind = 'session.start') THEN 'active' ELSE 'unknown' END AS status,
    count(*) FILTER (WHERE kind = 'llm.error' OR kind = 'tool.result' AND NOT success) AS derived_error_count FROM ev GROUP BY session_id)"""

TU = f""",
tu AS (SELECT session_id, prompt_id, min(ts) FILTER (WHERE kind = 'turn.start') AS started_at, max(ts) FILTER (WHERE kind = 'turn.end') AS ended_at, min(ts) AS first_seen_at, max(ts) AS last_event_at,
    CASE {pick("success", None, "kind = 'turn.end'")} WHEN true THEN 'complete' WHEN false THEN 'failed' ELSE 'open' END AS status, count(*) FILTER (WHERE kind = 'llm.request') AS api_request_count, {_TOKENS},
    coalesce(sum(cost_usd) FILTER (WHERE kind = 'llm.request'), 0)::DECIMAL(16, 8) AS cost_usd, list_sort(list(DISTINCT model) FILTER (WHERE kind = 'llm.request')) AS models FROM ev WHERE prompt_id IS NOT NULL GROUP BY session_id, prompt_id),
tui AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_seen_at, prompt_id) - 1 AS turn_index FROM tu)"""

SA = f""",
sa0 AS (SELECT session_id, agent_id, {pick("parent_agent_id")} AS stated, {pick("agent_type")} AS agent_type, {pick("prompt_id")} AS prompt_id, min(ts) FILTER (WHERE kind = 'subagent.start') AS started_at,
    max(ts) FILTER (WHERE kind = 'subagent.stop') AS ended_at, {pick("success", None, "kind = 'subagent.stop'")} AS ok FROM ev WHERE kind IN ('subagent.start', 'subagent.stop') GROUP BY session_id, agent_id),
spawn AS (SELECT a.session_id, a.agent_id, arg_max(row(c.agent_id, c.tool_use_id), row(c.ts, c.seq)) AS found FROM sa0 a JOIN ev c ON c.kind = 'tool.pre' AND c.a_subagent = a.agent_type AND c.session_id = a.session_id AND c.prompt_id = a.prompt_id AND c.ts <= a.started_at AND c.agent_id IS DISTINCT FROM a.agent_id WHERE a.stated IS NULL GROUP BY ALL),
sa AS (SELECT a.session_id, a.agent_id, coalesce(stated, found[1]) AS parent_agent_id, found[2] AS spawn_tool_use_id, agent_type, prompt_id, started_at, ended_at,
    CASE WHEN started_at IS NULL THEN 'unknown' WHEN ended_at IS NULL THEN 'running' WHEN coalesce(ok, true) THEN 'complete' ELSE 'failed' END AS status FROM sa0 a LEFT JOIN spawn USING (session_id, agent_id)),
tree AS (SELECT session_id, agent_id, 1 AS depth, agent_id AS path FROM sa WHERE parent_agent_id IS NULL UNION ALL
    SELECT s.session_id, s.agent_id, t.depth + 1, t.path || '/' || s.agent_id FROM tree t JOIN sa s ON s.session_id = t.session_id AND s.parent_agent_id = t.agent_id WHERE t.depth < 16)"""

_PRICES = ", ".join(f"('{m}', DATE '{d}', {i}, {o}, {r}, {w})" for m, d, i, o, r, w in PRICE_ROWS)
_UN = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
RH = f""",
prices(pm, d, pi, po, pr, pw) AS (VALUES {_PRICES}),
re AS (SELECT date_trunc('hour', ts) AS bucket, coalesce(se.project, '') AS project, ev.vendor, coalesce(model, '') AS model, count(*) FILTER (WHERE kind = 'session.start') AS sessions_started, count(*) FILTER (WHERE kind = 'turn.start') AS turns,
    count(*) FILTER (WHERE kind = 'llm.request') AS api_requests, count(*) FILTER (WHERE kind = 'llm.error') AS api_errors, 0 AS tool_calls, 0 AS tool_rejects, {", ".join(f"coalesce(sum(ev.{c}) FILTER (WHERE kind = 'llm.request'), 0) AS {c}" for c in _UN)},
    coalesce(sum(ev.cost_usd) FILTER (WHERE cost_source = 'reported'), 0) AS cost_reported_usd, {", ".join(f"coalesce(sum(ev.{c}) FILTER (WHERE kind = 'llm.request' AND ev.cost_usd IS NULL), 0) AS un_{c}" for c in _UN)}
    FROM ev LEFT JOIN se USING (session_id) GROUP BY ALL),
rt AS (SELECT date_trunc('hour', tc.started_at) AS bucket, coalesce(se.project, '') AS project, coalesce(se.vendor, 'unknown') AS vendor, '' AS model, 0, 0, 0, 0, count(*), count(*) FILTER (WHERE decision = 'reject'), 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM tc LEFT JOIN se USING (session_id) GROUP BY ALL),
rb AS (SELECT bucket, project, vendor, model, sum(sessions_started)::BIGINT AS sessions_started, sum(turns)::BIGINT AS turns, sum(api_requests)::BIGINT AS api_requests, sum(api_errors)::BIGINT AS api_errors, sum(tool_calls)::BIGINT AS tool_calls, sum(tool_rejects)::BIGINT AS tool_rejects,
    {", ".join(f"sum({c})::BIGINT AS {c}" for c in _UN)}, sum(cost_reported_usd)::DECIMAL(16, 8) AS cost_reported_usd, {", ".join(f"sum(un_{c})::BIGINT AS un_{c}" for c in _UN)} FROM (SELECT * FROM re UNION ALL SELECT * FROM rt) GROUP BY ALL),
pm AS (SELECT model, arg_max(pm, length(pm)) AS pm FROM (SELECT DISTINCT model FROM rb WHERE model <> ''), prices WHERE starts_with(model, pm) GROUP BY model),
rh AS (SELECT rb.bucket, rb.project, rb.vendor, rb.model, 'event' AS source, sessions_started, turns, api_requests, api_errors, tool_calls, tool_rejects, {", ".join(_UN)}, cost_reported_usd,
    CAST(CASE WHEN rb.model <> '' AND un_input_tokens + un_output_tokens + un_cache_read_tokens + un_cache_creation_tokens > 0 THEN coalesce((SELECT round(un_input_tokens * arg_max(pi, d)::DOUBLE / 1e6 + un_output_tokens * arg_max(po, d)::DOUBLE / 1e6 + un_cache_read_tokens * arg_max(pr, d)::DOUBLE / 1e6 + un_cache_creation_tokens * arg_max(pw, d)::DOUBLE / 1e6, 8)
        FROM prices WHERE prices.pm = pm.pm AND d <= rb.bucket::DATE), 0) ELSE 0 END AS DECIMAL(16, 8)) AS cost_estimated_usd, 0::BIGINT AS loc_added, 0::BIGINT AS loc_removed, 0::BIGINT AS active_seconds, 0::BIGINT AS commits, 0::BIGINT AS pull_requests, 0::BIGINT AS edit_decisions_accept, 0::BIGINT AS edit_decisions_reject
    FROM rb LEFT JOIN pm USING (model))"""

MS = r""",
m0 AS (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
m1 AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m0),
m2 AS (SELECT *, sum(cents) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS total FROM m1),
ms AS (SELECT *, name || '|' || coalesce(d, '') || '|' || coalesce(m, '') || '|' || a || '|' || user_id || '|' || temporality AS series, 'm:' || event_id || ':' || temporality AS dedup_key, CASE WHEN user_id % 5 = 0 THEN 'other_agent' ELSE 'claude_code' END AS vendor, 's' || user_id AS session_id FROM (
    SELECT event_id, ts, user_id, 'claude_code.token.usage' AS name, total::DOUBLE AS value, 'cumulative' AS temporality, 'input' AS a, 'opal-2' AS m, NULL AS d FROM m2 UNION ALL
    SELECT event_id, ts, user_id, ['claude_code.cost.usage', 'claude_code.lines_of_code.count', 'claude_code.active_time.total', 'claude_code.commit.count', 'claude_code.pull_request.count', 'claude_code.code_edit_tool.decision', 'other.thing'][k % 7 + 1], cents / 100, 'delta', CASE WHEN k % 2 = 0 THEN 'added' ELSE 'removed' END, 'opal-2', CASE WHEN k % 3 = 0 THEN 'reject' ELSE 'accept' END FROM m2 UNION ALL
    SELECT event_id, ts, user_id, 'claude_code.active_time.total', k::DOUBLE, CASE WHEN user_id % 2 = 0 THEN 'gauge' ELSE 'unspecified' END, 'user', NULL, NULL FROM m2)),
md AS (SELECT *, CASE temporality WHEN 'cumulative' THEN CASE WHEN value < lag(value) OVER w OR lag(value) OVER w IS NULL THEN value ELSE value - lag(value) OVER w END WHEN 'delta' THEN value
    ELSE CASE WHEN row_number() OVER (PARTITION BY series, date_trunc('hour', ts) ORDER BY ts DESC, dedup_key DESC) = 1 THEN value ELSE 0 END END AS delta FROM ms WINDOW w AS (PARTITION BY series ORDER BY ts, dedup_key))"""

_R = "CASE WHEN delta >= 0 THEN floor(delta + 0.5) ELSE ceil(delta - 0.5) END"


def _msum(name: str, extra: str, column: str, money: bool = False) -> str:
    body = "delta" if money else _R
    return f"coalesce(sum({body}) FILTER (WHERE name = '{name}'{extra}), 0)::{'DECIMAL(16, 8)' if money else 'BIGINT'} AS {column}"


RM = f""",
rm AS (SELECT date_trunc('hour', md.ts) AS bucket, coalesce(se.project, '') AS project, md.vendor, CASE WHEN name IN ('claude_code.cost.usage', 'claude_code.token.usage') THEN coalesce(m, '') ELSE '' END AS model, 'metric' AS source,
    0::BIGINT AS sessions_started, 0::BIGINT AS turns, 0::BIGINT AS api_requests, 0::BIGINT AS api_errors, 0::BIGINT AS tool_calls, 0::BIGINT AS tool_rejects,
    {_msum("claude_code.token.usage", " AND a = 'input'", "input_tokens")}, {_msum("claude_code.token.usage", " AND a = 'output'", "output_tokens")}, {_msum("claude_code.token.usage", " AND a = 'cacheRead'", "cache_read_tokens")}, {_msum("claude_code.token.usage", " AND a = 'cacheCreation'", "cache_creation_tokens")},
    {_msum("claude_code.cost.usage", "", "cost_reported_usd", True)}, 0::DECIMAL(16, 8) AS cost_estimated_usd, {_msum("claude_code.lines_of_code.count", " AND a = 'added'", "loc_added")}, {_msum("claude_code.lines_of_code.count", " AND a = 'removed'", "loc_removed")},
    {_msum("claude_code.active_time.total", "", "active_seconds")}, {_msum("claude_code.commit.count", "", "commits")}, {_msum("claude_code.pull_request.count", "", "pull_requests")},
    {_msum("claude_code.code_edit_tool.decision", " AND d = 'accept'", "edit_decisions_accept")}, {_msum("claude_code.code_edit_tool.decision", " AND d = 'reject'", "edit_decisions_reject")}
    FROM md LEFT JOIN se USING (session_id) WHERE name <> 'other.thing' GROUP BY ALL)"""

ALL = EV + TC + SE + TU + SA + RH + MS + RM
