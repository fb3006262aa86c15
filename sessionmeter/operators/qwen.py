"""The Qwen dialect: lines with message parts and usage metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions import jsonval as J
from sessionmeter.functions.text import first_chars
from sessionmeter.functions.times import rfc3339_seconds
from sessionmeter.operators.logs import explode_events, first_value, parsed_lines, summary_row
from sessionmeter.schema import select_tokens

AGENT = "qwen"
# The telemetry event, and the mark of prompts typed by a person.
API_RESPONSE = "qwen-code.api_response"
TYPED_MARK = "########"


def sessions(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    kind = J.word_at(v, "$.type")
    texts = F.filter(
        F.transform(
            F.filter(J.list_at(v, "$.message.parts"), lambda p: ~J.flag_at(p, "$.thought")),
            lambda p: J.text_at(p, "$.text"),
        ),
        lambda t: t.isNotNull(),
    )
    is_reply = (
        (kind == "system")
        & (J.word_at(v, "$.subtype") == "ui_telemetry")
        & (J.word_at(v, '$.systemPayload.uiEvent["event.name"]') == API_RESPONSE)
    )
    rows = parsed_lines(lines, AGENT, keep_bad=True).select(
        "path", "session_id", "file_mtime", "ord",
        rfc3339_seconds(J.word_at(v, "$.timestamp")).alias("ts"),
        J.text_at(v, "$.cwd").alias("cwd"),
        J.text_at(v, "$.model").alias("model"),
        (kind == "user").alias("is_user"),
        F.when(kind == "user", first_chars(F.try_element_at(texts, F.lit(1)), 120)).alias("prompt"),
        F.when(is_reply, J.text_at(v, "$.systemPayload.uiEvent.prompt_id").contains(TYPED_MARK)).alias("is_typed"),
    )
    no = F.lit(False)
    return summary_row(
        rows,
        AGENT,
        cwd=first_value("cwd"),
        model=first_value("model"),
        prompt=first_value("prompt"),
        turns=F.count_if("is_user"),
        is_scripted=F.coalesce(F.bool_or(~F.col("is_typed")), no) & ~F.coalesce(F.bool_or("is_typed"), no),
    )


def token_events(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    kind = J.word_at(v, "$.type")
    is_turn = kind == "user"

    def used(name: str) -> Column:
        return F.when(is_turn, F.lit(0).cast("bigint")).otherwise(J.count_at(v, f"$.usageMetadata.{name}"))

    rows = (
        parsed_lines(lines, AGENT)
        .where(kind.isin("user", "assistant"))
        .select(
            F.lit(AGENT).alias("agent"), "path", "session_id", "ord",
            F.coalesce(rfc3339_seconds(J.word_at(v, "$.timestamp")), F.lit(0).cast("bigint")).alias("ts"),
            is_turn.alias("is_user_turn"),
            F.coalesce(F.when(~is_turn, J.text_at(v, "$.model")), F.lit("")).alias("model"),
            used("promptTokenCount").alias("input_tokens"),
            used("candidatesTokenCount").alias("output_tokens"),
            used("cachedContentTokenCount").alias("cache_read_tokens"),
        )
    )
    spent = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens")
    return select_tokens(rows.where(F.col("is_user_turn") | (spent > 0)))


def transcript(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    kind = J.word_at(v, "$.type")
    status = F.coalesce(J.text_at(v, "$.toolCallResult.status"), F.lit(""))
    failed = F.when((status != "") & (status != "success"), F.lit("exit=1\n")).otherwise(F.lit(""))
    # Line type to kind of a plain text part.
    plain = (
        F.when(kind == "user", "User").when(kind == "assistant", "Assistant")
        .when(kind == "tool_result", "ToolResult").otherwise("System")
    )

    def one(part: Column) -> Column:
        call = F.concat(
            F.coalesce(J.text_at(part, "$.functionCall.name"), F.lit("fn")),
            F.lit(": "),
            F.coalesce(F.to_json(J.at(part, "$.functionCall.args")), F.lit("")),
        )
        name = F.coalesce(J.text_at(part, "$.functionResponse.name"), F.lit(""))
        header = F.when(name != "", F.concat(F.lit("["), name, F.lit("] "))).otherwise(F.lit(""))
        answer = F.coalesce(
            J.text_at(part, "$.functionResponse.response"),
            J.text_at(part, "$.functionResponse.response.output"),
            F.to_json(J.at(part, "$.functionResponse.response")),
            F.lit(""),
        )
        text_kind = F.when(J.flag_at(part, "$.thought"), F.lit("Thinking")).otherwise(plain)
        is_call = J.at(part, "$.functionCall").isNotNull()
        is_answer = J.at(part, "$.functionResponse").isNotNull()
        return F.struct(
            F.when(is_call, F.lit("ToolUse")).when(is_answer, F.lit("ToolResult")).otherwise(text_kind).alias("kind"),
            F.when(is_call, call)
            .when(is_answer, F.concat(failed, header, answer))
            .otherwise(J.text_at(part, "$.text"))
            .alias("body"),
        )

    parts = F.filter(F.transform(J.list_at(v, "$.message.parts"), one), lambda e: e["body"].isNotNull())
    payload = J.text_or_json(v, "$.systemPayload")
    notice = F.when(
        payload.isNotNull(), F.array(F.struct(F.lit("System").alias("kind"), payload.alias("body")))
    )
    rows = parsed_lines(lines, AGENT).select(
        "path", "session_id", "ord",
        F.coalesce(J.text_at(v, "$.timestamp"), F.lit("")).alias("ts"),
        F.when(kind == "system", notice).otherwise(parts).alias("events"),
    )
    return explode_events(rows, AGENT)
