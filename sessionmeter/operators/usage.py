"""Usage of each session inside a trailing window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions.pricing import PriceBook, with_cost
from sessionmeter.functions.ranges import Range
from sessionmeter.schema import USAGE


def is_llm_call() -> Column:
    used = (F.col("input_tokens") > 0) | (F.col("output_tokens") > 0) | (F.col("cache_read_tokens") > 0)
    return ~F.col("is_user_turn") & used


def usage_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in USAGE]


def scan_window(token_events: DataFrame, cutoff: int) -> DataFrame:
    """Per (agent, path): summed usage, calls, turns, and the last model in file order.

    The first aggregation also groups by model, so its buffers are numbers only and a session of any
    size shrinks before the shuffle; what remains to merge is one row per session and model.
    """
    turn = F.col("is_user_turn")
    by_model = (
        token_events.where(F.col("ts") >= cutoff)
        .groupBy("agent", "path", F.when(turn, F.lit("")).otherwise(F.col("model")).alias("model"))
        .agg(
            *[F.sum(F.when(turn, 0).otherwise(F.col(c))).alias(c) for c in USAGE],
            F.count_if(is_llm_call()).alias("calls"),
            F.count_if(turn).alias("turns"),
            F.max("ord").alias("last_ord"),
        )
    )
    named = F.when(F.col("model") != "", F.col("last_ord"))
    return by_model.groupBy("agent", "path").agg(
        *usage_sums(),
        F.sum("calls").alias("calls"),
        F.sum("turns").alias("turns"),
        F.max_by("model", named).alias("last_model"),
    )


def is_active() -> Column:
    """Cache writes alone do not make a session active."""
    out = F.col("turns") > 0
    for name in ("input_tokens", "output_tokens", "cache_read_tokens", "web_search_calls"):
        out = out | (F.col(name) > 0)
    return out


def per_session(token_events: DataFrame, sessions: DataFrame, r: Range, book: PriceBook) -> DataFrame:
    """Active sessions of the range with usage, calls, model and `session_cost`.

    The summed usage is priced once, with the last model of the window or else the session's own.
    """
    scanned = scan_window(token_events, r.cutoff).where(is_active())
    meta = sessions.select(
        "agent", "path", "session_id", "cwd", "prompt", "started_at_ts", "last_active_ts", "is_scripted",
        F.coalesce("model", F.lit("")).alias("meta_model"),
    )
    joined = scanned.join(meta, ["agent", "path"]).withColumn("model", F.coalesce("last_model", "meta_model"))
    return with_cost(joined.drop("last_model"), book, F.col("model"), "session_cost")
