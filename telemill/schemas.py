"""Schemas of the canonical tables.  ``attrs`` is canonical JSON text."""

from __future__ import annotations

MONEY = "decimal(16,8)"

EVENTS = (
    "seq long, ts timestamp, ingested_at timestamp, session_id string, prompt_id string, vendor string, source string, kind string, event_name string, "
    "vendor_seq long, tool_name string, tool_use_id string, decision string, decision_source string, tool_source string, query_source string, model string, "
    "input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, cost_usd decimal(16,8), cost_source string, duration_ms int, "
    "success boolean, error_type string, agent_id string, parent_agent_id string, agent_type string, permission_mode string, file_path string, request_id string, "
    "message_uuid string, clock_skewed boolean, dedup_key string, attrs string"
)
EVENT_COLUMNS = [x.split()[0] for x in EVENTS.split(", ")]

METRIC_SAMPLES = "ts timestamp, ingested_at timestamp, name string, vendor string, session_id string, value double, temporality string, series_hash string, attrs string, dedup_key string"

PRICES = "model string, effective_from date, currency string, input_per_mtok decimal(12,6), output_per_mtok decimal(12,6), cache_read_per_mtok decimal(12,6), cache_write_per_mtok decimal(12,6), source string"

#: Counters of a rollup row that come from events and tool calls, and those that only metrics fill.
EVENT_COUNTERS = ["sessions_started", "turns", "api_requests", "api_errors", "tool_calls", "tool_rejects", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]
METRIC_COUNTERS = ["loc_added", "loc_removed", "active_seconds", "commits", "pull_requests", "edit_decisions_accept", "edit_decisions_reject"]
COSTS = ["cost_reported_usd", "cost_estimated_usd"]
ROLLUP_KEY = ["bucket", "project", "vendor", "model"]
MEASURES = EVENT_COUNTERS + COSTS + METRIC_COUNTERS

#: Kinds of event by group.
KIND_GROUPS = {
    "session": ["session.start", "session.end"],
    "turn": ["turn.start", "turn.end", "turn.prompt_expanded"],
    "llm": ["llm.request", "llm.error", "llm.refusal", "llm.request_body", "llm.response_body", "assistant.message"],
    "tool": ["tool.pre", "tool.decision", "tool.permission_request", "tool.result", "tool.batch"],
    "agentic": ["subagent.start", "subagent.stop", "task.created", "task.completed"],
    "permission": ["permission.mode_changed"],
    "hooks": ["hook.registered", "hook.execution_start", "hook.execution_end"],
    "fs": ["fs.file_changed"],
    "workspace": ["workspace.cwd_changed", "workspace.directory_added", "workspace.config_changed", "workspace.instructions_loaded", "workspace.worktree_created", "workspace.worktree_removed"],
    "context": ["context.compact_start", "context.compact_end"],
    "mcp": ["mcp.connection", "mcp.elicitation", "mcp.elicitation_result"],
    "agent": ["agent.auth", "agent.setup", "agent.plugin", "agent.internal_error", "agent.notification", "agent.idle"],
    "fallback": ["unknown"],
}
