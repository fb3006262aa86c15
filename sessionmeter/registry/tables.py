"""The given tables projected to the canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.functions.pricing import ContextBook, PriceBook
from sessionmeter.functions.times import epoch_seconds
from sessionmeter.session import prepare

# the given events end on 2024-01-30; every range ends here
NOW = 1_706_659_200

# key, input, output, 5-minute cache write, 1-hour cache write, cache read
SAMPLE_PRICES = [
    ("alpha", 3.0, 15.0, 3.75, 6.0, 0.3),
    ("alpha-mini", 0.8, 4.0, 1.0, 1.6, 0.08),
    ("beta", 5.0, 25.0, 6.25, 10.0, 0.5),
]
SAMPLE_CONTEXTS = [("alpha", 1_000_000), ("alpha-mini", 128_000)]


def sample_prices() -> PriceBook:
    return PriceBook(SAMPLE_PRICES)


def sample_contexts() -> ContextBook:
    return ContextBook(SAMPLE_CONTEXTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_token_events(events: DataFrame) -> DataFrame:
    """Each given event as a token event; sign-ups stand for user turns."""
    kind, eid = F.col("event_type"), F.col("event_id")
    is_turn = kind == "signup"
    zero = F.lit(0).cast("bigint")

    def only(cond, value):
        return F.when(cond, value).otherwise(zero).cast("bigint")

    agent = (
        F.when(F.col("user_id") % 4 == 0, "claude").when(F.col("user_id") % 4 == 1, "codex")
        .when(F.col("user_id") % 4 == 2, "hermes").otherwise("qwen")
    )
    day = F.date_format("ts", "yyyy-MM-dd")
    sid = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), day)
    return events.select(
        agent.alias("agent"),
        sid.alias("path"),
        sid.alias("session_id"),
        eid.alias("ord"),
        epoch_seconds(F.col("ts")).alias("ts"),
        is_turn.alias("is_user_turn"),
        F.when(kind == "purchase", "ALPHA-2024").when(kind == "click", "x-alpha-mini")
        .when(kind == "view", "gamma").otherwise("").alias("model"),
        only(~is_turn, F.floor(F.col("value") * 100)).alias("input_tokens"),
        only(~is_turn, F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")).alias("output_tokens"),
        only(kind == "purchase", eid % 50).alias("cache_read_tokens"),
        only((kind == "click") & (eid % 3 == 0), eid % 13).alias("cache_creation_5m_tokens"),
        only((kind == "click") & (eid % 5 == 0), eid % 11).alias("cache_creation_1h_tokens"),
        only(kind == "click", eid % 30).alias("cache_creation_tokens"),
        only(kind == "error", F.lit(1)).alias("web_search_calls"),
        F.col("user_id"),
    )


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_token_events(table(spark, sf_dir, "events")).drop("user_id")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user and day; one agent names no directory, like its real logs."""
    user = F.col("user_id")
    rows = as_token_events(table(spark, sf_dir, "events"))
    return (
        rows.groupBy("agent", "path", "session_id", "user_id")
        .agg(
            F.min("ts").alias("started_at_ts"),
            F.max("ts").alias("last_active_ts"),
            F.count_if("is_user_turn").alias("turns"),
            F.min("ord").alias("first_ord"),
        )
        .select(
            "agent", "session_id", "path",
            F.when(F.col("agent") != "hermes", F.concat(F.lit("/w/u"), user.cast("string"))).alias("cwd"),
            F.when(user % 3 == 0, F.lit("beta-1")).alias("model"),
            F.when(user % 7 != 0, F.concat(F.lit("ask "), F.col("first_ord").cast("string"))).alias("prompt"),
            "turns", "last_active_ts", "started_at_ts",
            (user % 5 == 0).alias("is_scripted"),
        )
    )


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each given conversation as a transcript."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.lit("claude").alias("agent"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("turn").alias("event_index"),
        F.lit("").alias("ts"),
        F.when(role == "user", "User").when(role == "assistant", "Assistant").otherwise("System").alias("kind"),
        F.col("text").alias("body"),
    )


def transcript_sessions(transcript: DataFrame) -> DataFrame:
    return transcript.groupBy("agent", "path", "session_id").agg(
        (F.count(F.lit(1)) * 1000 + F.max("event_index")).alias("last_active_ts")
    )
