"""The Codex dialect: typed lines with a payload, token counts as deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions import jsonval as J
from sessionmeter.functions.text import EXIT_MARK, first_chars
from sessionmeter.functions.times import rfc3339_seconds
from sessionmeter.operators.logs import explode_events, first_value, parsed_lines, summary_row
from sessionmeter.operators.ordered import carry_last
from sessionmeter.schema import select_tokens

AGENT = "codex"


def sessions(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    kind, sub = J.word_at(v, "$.type"), J.word_at(v, "$.payload.type")
    is_meta = (kind == "session_meta") & J.at(v, "$.payload").isNotNull()
    scripted = (J.word_at(v, "$.payload.originator") == "codex_exec") | (J.word_at(v, "$.payload.source") == "exec")
    rows = parsed_lines(lines, AGENT, keep_bad=True).select(
        "path", "session_id", "file_mtime", "ord",
        rfc3339_seconds(J.word_at(v, "$.timestamp")).alias("ts"),
        F.when(is_meta, F.col("ord")).alias("meta_ord"),
        J.text_at(v, "$.payload.cwd").alias("cwd"),
        F.when(is_meta, scripted).alias("is_exec"),
        F.when(kind == "turn_context", J.text_at(v, "$.payload.model")).alias("model"),
        F.when((kind == "event_msg") & (sub == "user_message"), first_chars(J.text_at(v, "$.payload.message"), 120)).alias("prompt"),
        ((kind == "event_msg") & (sub == "task_complete")).alias("is_done"),
    )
    return summary_row(
        rows,
        AGENT,
        # the last meta line decides, also when it has no cwd
        cwd=F.max_by("cwd", "meta_ord"),
        model=first_value("model"),
        prompt=first_value("prompt"),
        turns=F.count_if("is_done"),
        is_scripted=F.coalesce(F.bool_or("is_exec"), F.lit(False)),
    )


def token_events(lines: DataFrame) -> DataFrame:
    """User turns, token deltas and web searches, each with the model in force."""
    return events_with_model(carry_last(role_rows(lines), ["path"], "set_model", "carried"))


def role_rows(lines: DataFrame) -> DataFrame:
    """One row per line that counts or that sets the model."""
    v = F.col("v")
    kind, sub = J.word_at(v, "$.type"), J.word_at(v, "$.payload.type")
    last = "$.payload.info.last_token_usage"
    is_event = kind == "event_msg"
    role = (
        F.when(kind == "turn_context", "context")
        .when(is_event & (sub == "user_message"), "turn")
        .when(is_event & (sub == "token_count"), "tokens")
        .when(is_event & (sub == "web_search_end"), "search")
    )
    return (
        parsed_lines(lines, AGENT)
        .select(
            "path", "session_id", "ord",
            role.alias("role"),
            F.coalesce(rfc3339_seconds(J.word_at(v, "$.timestamp")), F.lit(0).cast("bigint")).alias("ts"),
            F.when(kind == "turn_context", J.text_at(v, "$.payload.model")).alias("set_model"),
            J.count_at(v, f"{last}.input_tokens").alias("inp"),
            J.count_at(v, f"{last}.output_tokens").alias("out"),
            J.count_at(v, f"{last}.cached_input_tokens").alias("cached"),
        )
        .where(F.col("role").isNotNull())
        .where((F.col("role") != "tokens") | (F.col("inp") + F.col("out") + F.col("cached") > 0))
    )


def events_with_model(rows: DataFrame) -> DataFrame:
    """Role rows with the `carried` model as token events."""
    with_model = rows.where(F.col("role") != "context")
    is_tokens = F.col("role") == "tokens"
    zero = F.lit(0).cast("bigint")
    return select_tokens(
        with_model.select(
            F.lit(AGENT).alias("agent"), "path", "session_id", "ord", "ts",
            (F.col("role") == "turn").alias("is_user_turn"),
            F.coalesce("carried", F.lit("")).alias("model"),
            F.when(is_tokens, F.col("inp")).otherwise(zero).alias("input_tokens"),
            F.when(is_tokens, F.col("out")).otherwise(zero).alias("output_tokens"),
            F.when(is_tokens, F.col("cached")).otherwise(zero).alias("cache_read_tokens"),
            F.when(F.col("role") == "search", 1).otherwise(0).cast("bigint").alias("web_search_calls"),
        )
    )


def _event(kind: str, body: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), body.alias("body")))


def transcript(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    kind, sub = J.word_at(v, "$.type"), J.word_at(v, "$.payload.type")
    message = J.text_at(v, "$.payload.message")
    ran = F.concat(
        F.lit(f"{EXIT_MARK}exit="),
        F.coalesce(J.int_at(v, "$.payload.exit_code"), F.lit(0).cast("bigint")).cast("string"),
        F.lit("\n"),
        F.coalesce(J.text_at(v, "$.payload.aggregated_output"), F.lit("")),
    )
    said = F.filter(
        F.transform(
            J.list_at(v, "$.payload.content"),
            lambda b: F.struct(F.lit("Assistant").alias("kind"), J.text_at(b, "$.text").alias("body")),
        ),
        lambda e: e["body"].isNotNull(),
    )
    called = F.concat(
        F.coalesce(J.text_at(v, "$.payload.name"), F.lit("fn")),
        F.lit(": "),
        F.coalesce(J.text_at(v, "$.payload.arguments"), F.lit("")),
    )
    is_event, is_item = kind == "event_msg", kind == "response_item"
    events = (
        F.when(is_event & (sub == "user_message") & message.isNotNull(), _event("User", message))
        .when(is_event & (sub == "exec_command_end"), _event("ToolResult", ran))
        .when(is_item & (sub == "message") & (J.word_at(v, "$.payload.role") == "assistant"), said)
        .when(is_item & (sub == "function_call"), _event("ToolUse", called))
    )
    rows = (
        parsed_lines(lines, AGENT)
        .where(kind.isin("event_msg", "response_item"))
        .select(
            "path", "session_id", "ord",
            F.coalesce(J.text_at(v, "$.timestamp"), F.lit("")).alias("ts"),
            events.alias("events"),
        )
    )
    return explode_events(rows, AGENT)
