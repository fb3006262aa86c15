"""The four dialects, transcripts and search over the given conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions.text import fold_command_tags
from sessionmeter.functions.times import minus_floor_zero, rfc3339_seconds
from sessionmeter.operators import claude, codex, hermes, lookup, output, qwen, search
from sessionmeter.operators.ordered import carry_last
from sessionmeter.registry import logs
from sessionmeter.registry import tables as T
from sessionmeter.schema import kind_label

TERM = "the"


def _no_path(df: DataFrame) -> DataFrame:
    return df.drop("path")


def _log_query(dialect, source, part):
    def query(spark, sf):
        out = getattr(dialect, part)(source(spark, sf))
        return _no_path(out.drop("ord"))

    return query


def hermes_sessions(spark, sf):
    return _no_path(hermes.sessions(*logs.hermes(spark, sf)))


def hermes_token_events(spark, sf):
    return _no_path(hermes.token_events(*logs.hermes(spark, sf)).drop("ord"))


def hermes_transcript(spark, sf):
    return _no_path(hermes.transcript(logs.hermes(spark, sf)[1]))


def all_sessions(spark, sf):
    return lookup.all_sessions(
        claude.sessions(logs.claude(spark, sf)),
        codex.sessions(logs.codex(spark, sf)),
        hermes.sessions(*logs.hermes(spark, sf)),
        qwen.sessions(logs.qwen(spark, sf)),
    ).select("agent", "session_id", "last_active_ts", "turns")


def event_lines(events: DataFrame) -> DataFrame:
    """The given events of a user as streamed lines: the type is the message id, errors break a run."""
    zero = F.lit(0).cast("bigint")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return T.as_token_events(events).select(
        user.alias("path"),
        user.alias("session_id"),
        "ord",
        F.when(F.col("is_user_turn"), "user").when(F.col("web_search_calls") > 0, "other").otherwise("assistant").alias("kind"),
        "ts", "model",
        # a third of the users give their messages no id
        F.when(F.col("user_id") % 3 != 0, F.col("model")).otherwise("").alias("mid"),
        "input_tokens",
        F.when(F.col("output_tokens") % 3 == 0, zero).otherwise(F.col("output_tokens")).alias("output_tokens"),
    )


def merged_calls(spark, sf):
    out = claude.merge_streamed(event_lines(T.table(spark, sf, "events")), "claude")
    return out.select("session_id", "ts", "is_user_turn", "model", "input_tokens", "output_tokens")


def carried_model(spark, sf):
    """The latest model named before each event of a user."""
    rows = T.as_token_events(T.table(spark, sf, "events")).select(
        "user_id", F.col("ord").alias("event_id"), "ord",
        F.when(F.col("model").isin("gamma", "ALPHA-2024"), F.col("model")).alias("named"),
    )
    return carry_last(rows, ["user_id"], "named", "model").select("user_id", "event_id", "model")


def read_times(spark, sf):
    """Times written in several shapes; only RFC 3339 counts."""
    rows = T.table(spark, sf, "events")
    full = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 5
    shape = (
        F.when(kind == 0, F.concat(full, F.lit("Z")))
        .when(kind == 1, F.concat(full, F.lit(".250+02:00")))
        .when(kind == 2, full)
        .when(kind == 3, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(full, F.lit("-05:30")))
    )
    return rows.select("event_id", F.coalesce(rfc3339_seconds(shape), F.lit(0).cast("bigint")).alias("ts"))


def transcript_labels(spark, sf):
    """Labels of the events' kinds, and how far each event lies behind the third."""
    said = T.transcript(spark, sf)
    return said.select(
        "session_id", "event_index", kind_label(F.col("kind")).alias("label"), minus_floor_zero(F.col("event_index"), F.lit(3)).cast("bigint").alias("behind")
    )


def slash_commands(spark, sf):
    """Conversation texts inside the command wrappers."""
    body, kind = F.col("body"), F.col("event_index") % 5
    esc = "\u001b[1;31m"
    rows = T.transcript(spark, sf)
    wrapped = (
        F.when(kind == 0, F.concat(F.lit("  <local-command-caveat>"), body, F.lit("</local-command-caveat>\n")))
        .when(kind == 1, F.concat(F.lit("<local-command-stdout> "), F.lit(esc), body, F.lit("\u001b[0m </local-command-stdout>")))
        .when(kind == 2, F.concat(F.lit("<command-name> /go </command-name>\n<command-args>\n"), body, F.lit(" </command-args>")))
        .when(kind == 3, F.concat(F.lit("<command-name>/go</command-name> then "), body))
        .otherwise(body)
    )
    return rows.select("session_id", "event_index", fold_command_tags(wrapped).alias("said"))


def exit_codes(spark, sf):
    out = output.with_exit_codes(codex.transcript(logs.codex(spark, sf)))
    return out.where(F.col("kind") == "ToolResult").select("session_id", "event_index", "exit_code", "failed", "output")


def output_status(spark, sf):
    """Lines that report an error or success, in tool results that carry some."""
    marked = T.transcript(spark, sf).withColumn(
        "body",
        F.when(F.col("event_index") % 3 == 0, F.concat(F.lit("\u001eexit=2\nFatal: "), F.col("body")))
        .when(F.col("event_index") % 3 == 1, F.concat(F.col("body"), F.lit("\nall ok")))
        .otherwise(F.col("body")),
    ).withColumn("kind", F.lit("ToolResult"))
    return _no_path(output.status_counts(marked))


def slim_transcript(spark, sf):
    return _no_path(output.slim_transcript(logs.claude(spark, sf)))


def search_hits(spark, sf):
    rows = T.transcript(spark, sf)
    return _no_path(search.ranked_hits(search.hits(rows, TERM), T.transcript_sessions(rows)))


def search_all_hits(spark, sf):
    return _no_path(search.hits(T.transcript(spark, sf), TERM))


def search_documents(spark, sf):
    """The same search over the given documents, as one-event transcripts."""
    rows = T.table(spark, sf, "documents").select(
        F.lit("claude").alias("agent"), F.col("source").alias("path"), F.col("source").alias("session_id"),
        F.col("doc_id").alias("event_index"), F.lit("").alias("ts"), F.lit("User").alias("kind"),
        F.col("text").alias("body"),
    )
    return search.hits(rows, TERM).select("event_index", "snippet", "match_start", "match_len")


def sessions_with_prompt(spark, sf):
    rows = T.transcript(spark, sf)
    return _no_path(search.sessions_with_prompt(T.transcript_sessions(rows), rows, "der"))


QUERIES = {
    **{
        f"{name}_{part}": _log_query(dialect, source, part)
        for name, dialect, source in (
            ("claude", claude, logs.claude), ("codex", codex, logs.codex), ("qwen", qwen, logs.qwen)
        )
        for part in ("sessions", "token_events", "transcript")
    },
    "hermes_sessions": hermes_sessions,
    "hermes_token_events": hermes_token_events,
    "hermes_transcript": hermes_transcript,
    "all_sessions": all_sessions,
    "merged_calls": merged_calls,
    "carried_model": carried_model,
    "read_times": read_times,
    "transcript_labels": transcript_labels,
    "slash_commands": slash_commands,
    "exit_codes": exit_codes,
    "output_status": output_status,
    "slim_transcript": slim_transcript,
    "search_hits": search_hits,
    "search_all_hits": search_all_hits,
    "search_documents": search_documents,
    "sessions_with_prompt": sessions_with_prompt,
}
