"""Streams over the given tables; each must end with the rows of its batch form.

A table arrives in three parts. Where order matters the stream runs after each until it has taken all there is, ends, and is
started again from its checkpoint for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionmeter.registry import log_queries, logs
from sessionmeter.registry import tables as T
from sessionmeter.session import work_path
from sessionmeter.streaming import state, windows
from sessionmeter.streaming.files import run_batches

SIX_HOURS = 21_600
ARRIVALS = 3
TEN_DAYS = 864_000


def _arriving(rows: DataFrame, arrival: Column, start: Callable[[DataFrame, str, str], StreamingQuery]) -> DataFrame:
    """What `start(stream, sink, checkpoint)` has written when all rows have come, part by part."""
    spark = rows.sparkSession
    landed, sink, checkpoint = (work_path(spark, n) for n in ("landed", "stream", "offsets"))
    for k in range(ARRIVALS):
        rows.where(arrival == k).write.mode("append").parquet(landed)
        start(spark.readStream.schema(rows.schema).parquet(landed), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink)


def _at_once(rows: DataFrame, arrival: Column, start: Callable[[DataFrame, str, str], StreamingQuery]) -> DataFrame:
    """The same for rows in no order: one run of the stream over files that come in at least `ARRIVALS` micro-batches."""
    spark = rows.sparkSession
    landed, sink, checkpoint = (work_path(spark, n) for n in ("landed", "stream", "offsets"))
    rows.withColumn("_arrival", arrival).write.partitionBy("_arrival").parquet(landed)
    files = len(spark.read.parquet(landed).inputFiles())
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(max(1, files // ARRIVALS)))
    start(reader.parquet(f"{landed}/*"), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink)


def _by_time() -> Column:
    """Events in order of time: ten days each."""
    age = F.floor((T.NOW - F.unix_seconds(F.col("ts").cast("timestamp"))) / TEN_DAYS)
    return F.lit(ARRIVALS - 1) - F.least(age, F.lit(ARRIVALS - 1))


def _at_random(column: str) -> Column:
    """In no order of time: rows come up to a month late."""
    return F.pmod(F.xxhash64(column), F.lit(ARRIVALS))


def _events_of(lines: DataFrame, agent: str, arrival: Column) -> DataFrame:
    def start(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
        return run_batches(state.token_events(stream, agent), lambda rows: rows, sink, checkpoint, "update")

    return state.current_events(_arriving(lines, arrival, start)).drop("path", "ord")


def streamed_calls(spark, sf):
    """Streamed lines of a user merged over ten-day parts, calls at the borders included."""

    def start(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
        calls = state.merged_calls(log_queries.event_lines(stream), "claude")
        return run_batches(calls, lambda rows: rows, sink, checkpoint, "update")

    out = state.current_events(_arriving(T.table(spark, sf, "events"), _by_time(), start))
    return out.select("session_id", "ts", "is_user_turn", "model", "input_tokens", "output_tokens")


def _cut_inside_turns() -> Column:
    """The first parts end in the middle of the lines of a turn."""
    return F.when(F.col("ord") < 16, 0).when(F.col("ord") < 38, 1).otherwise(2)


def streamed_claude_events(spark, sf):
    return _events_of(logs.claude(spark, sf), "claude", _cut_inside_turns())


def streamed_codex_events(spark, sf):
    return _events_of(logs.codex(spark, sf), "codex", _cut_inside_turns())


def streamed_buckets(spark, sf):
    def start(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
        return windows.stream_buckets(T.as_token_events(stream), T.sample_prices(), SIX_HOURS, sink, checkpoint)

    out = windows.current_buckets(_at_once(T.table(spark, sf, "events"), _at_random("event_id"), start))
    return out.withColumn("event_cost", F.round("event_cost", 6))


def streamed_groups(spark, sf):
    """Session groups, with sessions in no order of time."""
    return windows.current_groups(_at_once(T.sessions(spark, sf), _at_random("session_id"), windows.stream_groups))


QUERIES = {
    "streamed_calls": streamed_calls,
    "streamed_claude_events": streamed_claude_events,
    "streamed_codex_events": streamed_codex_events,
    "streamed_buckets": streamed_buckets,
    "streamed_groups": streamed_groups,
}
