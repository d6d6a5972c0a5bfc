"""From event names and attributes to kinds and promoted columns.

``v`` is the record's attributes as a VARIANT.  A name that no table knows
keeps its event as kind ``unknown``; nothing is dropped for its vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.functions.attributes import string_like, variant_bool, variant_number, variant_string

#: Log event names and their kinds.
LOG_KINDS = {
    "user_prompt": "turn.start", "assistant_response": "assistant.message", "api_request": "llm.request", "api_error": "llm.error", "api_refusal": "llm.refusal",
    "api_request_body": "llm.request_body", "api_response_body": "llm.response_body", "tool_result": "tool.result", "tool_decision": "tool.decision", "permission_mode_changed": "permission.mode_changed",
    "hook_registered": "hook.registered", "hook_execution_start": "hook.execution_start", "hook_execution_complete": "hook.execution_end", "auth": "agent.auth", "mcp_server_connection": "mcp.connection",
    "internal_error": "agent.internal_error", "plugin_installed": "agent.plugin", "plugin_loaded": "agent.plugin",
}

#: Hook event names and their kinds.
HOOK_KINDS = {
    "SessionStart": "session.start", "SessionEnd": "session.end", "Setup": "agent.setup", "UserPromptSubmit": "turn.start", "Stop": "turn.end", "StopFailure": "turn.end", "PreToolUse": "tool.pre",
    "PostToolUse": "tool.result", "PostToolUseFailure": "tool.result", "PostToolBatch": "tool.batch", "PermissionRequest": "tool.permission_request", "PermissionDenied": "tool.decision",
    "SubagentStart": "subagent.start", "SubagentStop": "subagent.stop", "TaskCreated": "task.created", "TaskCompleted": "task.completed", "TeammateIdle": "agent.idle", "FileChanged": "fs.file_changed",
    "CwdChanged": "workspace.cwd_changed", "DirectoryAdded": "workspace.directory_added", "ConfigChange": "workspace.config_changed", "InstructionsLoaded": "workspace.instructions_loaded",
    "WorktreeCreate": "workspace.worktree_created", "WorktreeRemove": "workspace.worktree_removed", "PreCompact": "context.compact_start", "PostCompact": "context.compact_end",
    "UserPromptExpansion": "turn.prompt_expanded", "Elicitation": "mcp.elicitation", "ElicitationResult": "mcp.elicitation_result", "Notification": "agent.notification",
}

FILE_TOOLS = ["Read", "Edit", "Write", "NotebookEdit", "Glob"]


def kind_of(name: Column, kinds: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit("unknown"))


def log_columns(name: Column, v: Column) -> dict[str, Column]:
    """Promoted columns of a log record by its event name."""
    is_ = lambda *names: name.isin(*names)
    text = lambda a: variant_string(v, a)
    whole = lambda a: variant_number(v, a, "long")
    request, result, decision, error, hook = is_("api_request"), is_("tool_result"), is_("tool_decision"), is_("api_error"), is_("hook_execution_complete")
    micros = whole("cost_usd_micros")
    tokens = {c: F.when(request, whole(c)) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")}
    return tokens | {
        "kind": kind_of(name, LOG_KINDS),
        "model": F.when(is_("api_request", "api_error", "api_refusal"), text("model")),
        "cost_usd": F.when(request, F.coalesce(micros / 1e6, variant_number(v, "cost_usd"))).cast("decimal(16,8)"),
        "cost_source": F.when(request, "reported"),
        "duration_ms": F.when(is_("api_request", "api_error", "tool_result"), whole("duration_ms")).when(hook, whole("total_duration_ms")).cast("int"),
        "request_id": F.when(request | error, text("request_id")),
        "query_source": F.when(request | error, text("query_source")),
        "success": F.when(request, True).when(is_("api_error", "api_refusal", "internal_error"), False).when(is_("tool_result", "auth", "mcp_server_connection"), variant_bool(v, "success")).when(hook, hook_success(v)),
        "error_type": F.when(error, F.coalesce(text("error_type"), string_like(v, "status_code"))).when(is_("api_refusal"), text("category")).when(is_("tool_result", "internal_error"), text("error_type")),
        "tool_name": F.when(result | decision, text("tool_name")),
        "tool_use_id": F.when(result | decision, text("tool_use_id")),
        "decision": F.when(decision, text("decision")),
        "decision_source": F.when(result, text("decision_source")).when(decision, text("source")),
        "tool_source": F.when(decision, text("tool_source")),
        "file_path": F.when(result, F.try_variant_get(v, "$.tool_parameters.file_path", "string")),
        "agent_type": F.when(result, F.try_variant_get(v, "$.tool_parameters.subagent_type", "string")),
        "permission_mode": F.when(is_("permission_mode_changed"), text("to_mode")),
        "message_uuid": F.when(is_("assistant_response"), text("message.uuid")),
    }


def hook_success(v: Column) -> Column:
    """Null unless both counts are there; true when both are 0."""
    a, b = variant_number(v, "num_non_blocking_error", "long"), variant_number(v, "num_cancelled", "long")
    return F.when(a.isNotNull() & b.isNotNull(), (a == 0) & (b == 0))


def hook_columns(name: Column, v: Column) -> dict[str, Column]:
    """Promoted columns of a hook payload by its event name."""
    is_ = lambda *names: name.isin(*names)
    text = lambda a: variant_string(v, a)
    tool = text("tool_name")
    path = F.when(tool.isin(*FILE_TOOLS), F.coalesce(F.try_variant_get(v, "$.tool_input.file_path", "string"), F.try_variant_get(v, "$.tool_input.path", "string")))
    return {
        "kind": kind_of(name, HOOK_KINDS),
        "permission_mode": text("permission_mode"),
        "agent_id": text("agent_id"),
        "agent_type": text("agent_type"),
        "parent_agent_id": F.when(is_("SubagentStart"), text("parent_agent_id")),
        "tool_name": F.when(is_("PreToolUse", "PostToolUse", "PostToolUseFailure", "PermissionRequest", "PermissionDenied"), tool),
        "tool_use_id": F.when(is_("PreToolUse", "PostToolUse", "PostToolUseFailure"), text("tool_use_id")),
        "success": F.when(is_("Stop", "PostToolUse"), True).when(is_("StopFailure", "PostToolUseFailure"), False).when(is_("SubagentStop", "TaskCreated", "TaskCompleted"), variant_bool(v, "success")),
        "error_type": F.when(is_("StopFailure", "PostToolUseFailure"), text("error_type")),
        "decision": F.when(is_("PermissionRequest"), "pending").when(is_("PermissionDenied"), "reject"),
        "decision_source": F.when(is_("PermissionDenied"), "unknown"),
        "file_path": F.when(is_("PreToolUse"), path).when(is_("FileChanged", "DirectoryAdded", "WorktreeCreate", "WorktreeRemove"), text("file_path")),
    }


def event_name(record_name: Column, v: Column, body: Column) -> Column:
    """The record's name, else its attribute, else a text body; vendor prefix and line breaks off, at most 255 characters."""
    name = F.coalesce(F.nullif(record_name, F.lit("")), variant_string(v, "event.name"), body, F.lit(""))
    return F.left(F.regexp_replace(F.regexp_replace(name, r"^claude_code\.", ""), r"[\r\n]", ""), F.lit(255))


def vendor_of(service: Column) -> Column:
    return F.when(F.coalesce(service, F.lit("")) == "", "unknown").when(service == "claude-code", "claude_code").otherwise(service)


def timestamp_of(nanos: Column, text: Column, most_seconds: float = 5.0) -> tuple[Column, Column]:
    """(time, whether both sources are there and differ by more than ``most_seconds``)."""
    n = nanos.try_cast("decimal(20,0)")
    from_nanos = F.when(n > 0, F.timestamp_micros(F.floor(n / 1000).cast("long")))
    from_text = text.try_cast("timestamp")
    apart = F.abs(F.unix_micros(from_nanos) - F.unix_micros(from_text)) > most_seconds * 1e6
    return F.coalesce(from_nanos, from_text), F.coalesce(apart, F.lit(False))


def clamped(ts: Column, now: Column, retention_days: int) -> tuple[Column, Column]:
    """(time, whether it was outside of [now - retention, now + 1 h] and so became now)."""
    odd = ts.isNull() | (ts < now - F.expr(f"INTERVAL {int(retention_days)} DAY")) | (ts > now + F.expr("INTERVAL 1 HOUR"))
    return F.when(odd, now).otherwise(ts), odd


def temporality(code: Column) -> Column:
    """Aggregation temporality as a name or a number."""
    c = F.upper(code.cast("string"))
    return F.when(c.isin("1", "AGGREGATION_TEMPORALITY_DELTA"), "delta").when(c.isin("2", "AGGREGATION_TEMPORALITY_CUMULATIVE"), "cumulative").otherwise("unspecified")


def digest32(text: Column) -> Column:
    """128 bits of SHA-256, in hex."""
    return F.left(F.sha2(text, 256), F.lit(32))


def log_key(session: Column, number: Column, name: Column, canonical: Column) -> Column:
    h = digest32(canonical)
    return F.when(number.isNotNull(), F.concat_ws(":", F.lit("otel"), session, number.cast("string"), name, h)).otherwise(F.concat_ws(":", F.lit("otel"), session, F.lit("h"), h))


def metric_key(name: Column, ts: Column, canonical: Column) -> Column:
    return F.concat(F.lit("metric:"), digest32(F.concat_ws("|", name, F.unix_micros(ts).cast("string"), canonical)))


def hook_key(name: Column, session: Column, prompt: Column, canonical: Column) -> Column:
    return F.concat(F.lit("hook:"), digest32(F.concat_ws("|", name, session, F.coalesce(prompt, F.lit("")), canonical)))


def series_key(name: Column, canonical: Column) -> Column:
    return F.sha2(F.concat_ws("|", name, canonical), 256)
