"""Windowed sums and session groups over streams, as their sinks keep them.

Logs arrive late by nature. The state of a windowed sum is a row per agent and bucket, whatever the number of events:
ten years of five-minute buckets of four agents are four million rows. So no watermark is set, no bucket is ever
closed, and a row of any age corrects its bucket. A sink takes what a micro-batch has changed; a repeated
micro-batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionmeter.functions.pricing import PriceBook, with_cost
from sessionmeter.operators.grouping import DEFAULT_GAP
from sessionmeter.operators.usage import is_llm_call
from sessionmeter.streaming import state
from sessionmeter.streaming.files import run_batches


def bucket_sums(token_events: DataFrame, book: PriceBook, width: int) -> DataFrame:
    """(bucket_ts, agent, event_cost, calls) by tumbling event-time window; events priced by their own model.

    Sums are made inside each task before the shuffle, as in the batch form.
    """
    counted = token_events.where(~F.col("is_user_turn") & (F.col("ts") > 0))
    priced = with_cost(counted, book, F.col("model"), "cost").withColumn("is_call", is_llm_call())
    sums = priced.groupBy(F.window(F.timestamp_seconds("ts"), f"{width} seconds").alias("w"), "agent").agg(
        F.sum("cost").alias("event_cost"), F.count_if("is_call").alias("calls")
    )
    return sums.select(F.unix_seconds("w.start").alias("bucket_ts"), "agent", "event_cost", "calls")


def stream_buckets(token_events: DataFrame, book: PriceBook, width: int, sink: str, checkpoint: str) -> StreamingQuery:
    """Write the buckets each micro-batch has changed."""
    return run_batches(bucket_sums(token_events, book, width), lambda rows: rows, sink, checkpoint, "update")


def current_buckets(written: DataFrame) -> DataFrame:
    """Every bucket as the latest micro-batch that touched it left it."""
    return written.groupBy("bucket_ts", "agent").agg(
        F.max_by("event_cost", "stream_batch").alias("event_cost"), F.max_by("calls", "stream_batch").alias("calls")
    )


def stream_groups(sessions: DataFrame, sink: str, checkpoint: str, gap: int = DEFAULT_GAP) -> StreamingQuery:
    """Write the groups of each directory that a micro-batch has sessions of."""
    return run_batches(state.session_groups(sessions, gap), lambda rows: rows, sink, checkpoint, "update")


def current_groups(written: DataFrame) -> DataFrame:
    """The groups of every directory as its latest micro-batch left them, open ones included."""
    newest = written.groupBy("agent", "dir").agg(F.max("stream_batch").alias("stream_batch"))
    return written.join(newest, ["agent", "dir", "stream_batch"]).withColumnRenamed("dir", "cwd").drop("stream_batch")
