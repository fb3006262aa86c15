"""Canonical tables: column names, types and the small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USAGE = [
    "input_tokens",
    "output_tokens",
    "cache_read_tokens",
    "cache_creation_5m_tokens",
    "cache_creation_1h_tokens",
    "cache_creation_tokens",
    "web_search_calls",
]

SESSION_COLUMNS = [
    "agent", "session_id", "path", "cwd", "model", "prompt",
    "turns", "last_active_ts", "started_at_ts", "is_scripted",
]
TOKEN_COLUMNS = ["agent", "path", "session_id", "ord", "ts", "is_user_turn", "model", *USAGE]
TRANSCRIPT_COLUMNS = ["agent", "path", "session_id", "event_index", "ts", "kind", "body"]

# Agents in display order with their short tags.
AGENTS = {"claude": "CLA", "codex": "COD", "hermes": "HER", "qwen": "QWN"}

# Transcript kinds with their labels.
KINDS = {
    "User": "USER",
    "Assistant": "ASSIS",
    "Thinking": "THINK",
    "ToolUse": "TOOL→",
    "ToolResult": "TOOL←",
    "System": "SYS  ",
}


def label_of(column: Column, labels: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, label in labels.items():
        out = F.when(column == key, label).otherwise(out)
    return out


def agent_short(agent: Column) -> Column:
    return label_of(agent, AGENTS)


def kind_label(kind: Column) -> Column:
    return label_of(kind, KINDS)


def no_usage() -> dict[str, Column]:
    return {name: F.lit(0).cast("bigint") for name in USAGE}


def select_tokens(df: DataFrame) -> DataFrame:
    """Canonical column order; usage columns the dialect lacks are zero."""
    missing = {name: col for name, col in no_usage().items() if name not in df.columns}
    return df.withColumns(missing).select(*TOKEN_COLUMNS) if missing else df.select(*TOKEN_COLUMNS)
