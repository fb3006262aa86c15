"""The Hermes dialect: two tables, `sessions` and `messages`, instead of log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions import jsonval as J
from sessionmeter.functions.text import first_chars
from sessionmeter.functions.times import real_iso, real_seconds
from sessionmeter.operators.ordered import sum_before
from sessionmeter.schema import SESSION_COLUMNS, TRANSCRIPT_COLUMNS, select_tokens

AGENT = "hermes"


def _labels(raw_id: Column) -> list[Column]:
    """session_id and path of a stored session."""
    return [
        F.concat(F.lit("hermes:"), raw_id).alias("session_id"),
        F.concat(F.lit("sessions/session_"), raw_id, F.lit(".json")).alias("path"),
    ]


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint")


def _positive(name: str) -> Column:
    return F.greatest(_n(name), F.lit(0).cast("bigint"))


def seen_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions that saw traffic; a bare boot leaves an empty row behind."""
    return sessions.where((_n("input_tokens") > 0) | (_n("output_tokens") > 0) | (_n("message_count") > 0))


def sessions(stored: DataFrame, messages: DataFrame) -> DataFrame:
    opening = (
        messages.where((F.col("role") == "user") & F.col("content").isNotNull())
        .groupBy(F.col("session_id").alias("id"))
        .agg(F.min_by(first_chars(F.col("content"), 120), F.struct("timestamp", F.col("id"))).alias("opening"))
    )
    started = real_seconds(F.col("started_at"))
    return (
        seen_sessions(stored)
        .join(opening, "id", "left")
        .select(
            F.lit(AGENT).alias("agent"),
            *_labels(F.col("id")),
            F.lit(None).cast("string").alias("cwd"),
            "model",
            F.coalesce("title", "opening").alias("prompt"),
            _positive("message_count").alias("turns"),
            F.greatest(real_seconds(F.col("ended_at")), started).alias("last_active_ts"),
            started.alias("started_at_ts"),
            F.lit(False).alias("is_scripted"),
        )
        .select(*SESSION_COLUMNS)
    )


def token_events(stored: DataFrame, messages: DataFrame) -> DataFrame:
    """One turn per user message, and one event with the session totals at its start."""
    totals = seen_sessions(stored).select(
        "id",
        F.coalesce("model", F.lit("")).alias("model"),
        real_seconds(F.col("started_at")).alias("ts"),
        _positive("input_tokens").alias("input_tokens"),
        (_positive("output_tokens") + _positive("reasoning_tokens")).alias("output_tokens"),
        _positive("cache_read_tokens").alias("cache_read_tokens"),
        _positive("cache_write_tokens").alias("cache_creation_tokens"),
    )
    spent = (
        F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    )
    usage = totals.where(spent > 0).select(
        "id", "model", "ts", F.lit(False).alias("is_user_turn"),
        # after every user message of its session
        F.lit((1 << 62)).cast("bigint").alias("ord"),
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens",
    )
    zero = F.lit(0).cast("bigint")
    turns = (
        messages.where(F.col("role") == "user")
        .select(F.col("session_id").alias("id"), F.col("id").alias("ord"), real_seconds(F.col("timestamp")).alias("ts"))
        .join(totals.select("id", "model"), "id")
        .select(
            "id", "model", "ts", F.lit(True).alias("is_user_turn"), "ord",
            *[zero.alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")],
        )
    )
    both = turns.unionByName(usage)
    return select_tokens(both.select(F.lit(AGENT).alias("agent"), *_labels(F.col("id")), *both.columns).drop("id"))


def tool_calls(raw: Column) -> Column:
    """`name: arguments` per stored call; text that is not JSON is shown as it is."""
    v = J.parse_line(raw)

    def one(item: Column) -> Column:
        def field(name: str) -> Column:
            # a call is wrapped in `function`, or stands for itself
            wrapped = J.at(item, "$.function").isNotNull()
            return F.when(wrapped, J.text_at(item, f"$.function.{name}")).otherwise(J.text_at(item, f"$.{name}"))

        return F.concat(
            F.coalesce(field("name"), F.lit("fn")), F.lit(": "), F.coalesce(field("arguments"), F.lit(""))
        )

    # fixed value: the mark of a list that cannot be read
    broken = F.array(F.concat(F.lit("(unparsed tool_calls) "), raw))
    return (
        F.when(raw.isNull(), F.array().cast("array<string>"))
        .when(v.isNull(), broken)
        .otherwise(F.coalesce(F.transform(J.list_at(v, "$"), one), F.array().cast("array<string>")))
    )


def transcript(messages: DataFrame) -> DataFrame:
    """Readable events in order; message ids are unique, as the stored table's key."""

    def event(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("body"))

    def if_text(kind: str, column: str) -> Column:
        body = F.col(column)
        return F.when(body != "", F.array(event(kind, body)))

    none = F.array().cast("array<struct<kind:string,body:string>>")
    call_id, name = F.coalesce("tool_call_id", F.lit("")), F.coalesce("tool_name", F.lit(""))
    label = F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(call_id, F.lit("")))
    header = F.when(label != "", F.concat(F.lit("["), label, F.lit("] "))).otherwise(F.lit(""))
    role = F.col("role")
    events = (
        F.when(role == "user", if_text("User", "content"))
        .when(
            role == "assistant",
            F.concat(
                F.coalesce(if_text("Thinking", "reasoning"), none),
                F.coalesce(if_text("Assistant", "content"), none),
                F.transform(tool_calls(F.col("tool_calls")), lambda t: event("ToolUse", t)),
            ),
        )
        .when(role == "tool", F.array(event("ToolResult", F.concat(header, F.coalesce("content", F.lit(""))))))
        .when(role == "system", if_text("System", "content"))
    )
    # a message's first number follows from narrow rows; texts move once, to meet it, or stay where that side is small
    counts = messages.select("session_id", F.col("timestamp").alias("at"), "id", F.size(events).alias("n")).where("n > 0")
    firsts = sum_before(counts, ["session_id"], [F.asc("at"), F.asc("id")], "n", "first").select("id", "first")
    return (
        messages.join(firsts, "id")
        .select(
            F.lit(AGENT).alias("agent"), *_labels(F.col("session_id")),
            "first", real_iso(F.col("timestamp")).alias("ts"),
            F.posexplode(events).alias("pos", "event"),
        )
        .withColumn("event_index", F.col("first") + F.col("pos"))
        .select(*[c for c in TRANSCRIPT_COLUMNS if c not in ("kind", "body")], "event.kind", "event.body")
        .select(*TRANSCRIPT_COLUMNS)
    )
