"""Derived views of transcript bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions import jsonval as J
from sessionmeter.functions.text import exit_code, line_status, output_lines, trim_ws, without_exit_code
from sessionmeter.operators.logs import parsed_lines
from sessionmeter.operators.ordered import line_chunk, number_rows


def with_exit_codes(transcript: DataFrame) -> DataFrame:
    """Split the exit code off tool results."""
    is_result = F.col("kind") == "ToolResult"
    code = F.when(is_result, exit_code(F.col("body")))
    return transcript.select(
        *[c for c in transcript.columns if c != "body"],
        code.alias("exit_code"),
        F.coalesce(code != 0, F.lit(False)).alias("failed"),
        F.when(is_result, without_exit_code(F.col("body"))).otherwise(F.col("body")).alias("output"),
    )


def status_counts(transcript: DataFrame) -> DataFrame:
    """Per session: tool results, failed ones, and output lines that report an error or success."""
    results = with_exit_codes(transcript.where(F.col("kind") == "ToolResult"))
    statuses = F.transform(output_lines(F.col("output")), line_status)

    def count(word: str):
        return F.size(F.filter(statuses, lambda s: s == word)).cast("bigint")

    return (
        results.select("agent", "path", "session_id", "failed", count("error").alias("err"), count("ok").alias("ok"))
        .groupBy("agent", "path", "session_id")
        .agg(
            F.count(F.lit(1)).alias("results"),
            F.count_if("failed").alias("failed"),
            F.sum("err").alias("error_lines"),
            F.sum("ok").alias("ok_lines"),
        )
    )


def slim_transcript(lines: DataFrame, most_thinking: int = 400, most_input: int = 200) -> DataFrame:
    """A short text form of the Claude dialect for another reader.

    Tool results shrink to their id, thinking and tool input to so many characters. The tags in square brackets
    are fixed values.
    """
    v = F.col("v")
    kind = J.word_at(v, "$.type")
    blocks = J.list_at(v, "$.message.content")

    def tagged(tag: str, text):
        return F.concat(F.lit(f"[{tag}] "), text)

    def text_of(block, path):
        return F.coalesce(J.text_at(block, path), F.lit(""))

    def user_block(block):
        what = J.word_at(block, "$.type")
        use_id = F.coalesce(J.text_at(block, "$.tool_use_id"), F.lit("?"))
        return F.when(
            what == "tool_result", F.concat(F.lit("[tool_result] (omitted, id="), use_id, F.lit(")"))
        ).when(what == "text", tagged("user", trim_ws(text_of(block, "$.text"))))

    def assistant_block(block):
        what = J.word_at(block, "$.type")
        name = F.coalesce(J.text_at(block, "$.name"), F.lit("?"))
        # a null input counts as none given
        given = J.at(block, "$.input")
        given = F.coalesce(F.when(~F.is_variant_null(given), F.to_json(given)), F.lit("{}"))
        return (
            F.when(what == "text", tagged("assistant", trim_ws(text_of(block, "$.text"))))
            .when(what == "thinking", tagged("thinking", F.substring(trim_ws(text_of(block, "$.thinking")), 1, most_thinking)))
            .when(what == "tool_use", F.concat(F.lit("[tool_use] "), name, F.lit(" "), F.substring(given, 1, most_input)))
        )

    plain = J.text_at(v, "$.message.content")
    out = (
        F.when((kind == "user") & plain.isNotNull(), F.array(tagged("user", trim_ws(plain))))
        .when(kind == "user", F.array_compact(F.transform(blocks, user_block)))
        .when(kind == "assistant", F.array_compact(F.transform(blocks, assistant_block)))
    )
    flat = (
        parsed_lines(lines, "claude")
        .where(kind.isin("user", "assistant"))
        .select("path", "session_id", "ord", F.posexplode(out).alias("pos", "line"))
    )
    return number_rows(flat, ["path"], ["ord", "pos"], line_chunk(), "line_no").select(
        "path", "session_id", "line_no", "line"
    )
