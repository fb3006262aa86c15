"""Cost and calls by time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions.pricing import PriceBook, with_cost
from sessionmeter.functions.ranges import Range, bucket_seconds, spanned
from sessionmeter.operators.usage import is_llm_call
from sessionmeter.schema import AGENTS, USAGE


def bucket_sums(token_events: DataFrame, active: DataFrame, sessions: DataFrame, r: Range, book: PriceBook) -> DataFrame:
    """(agent, idx, event_cost, calls) over the active sessions; at most agents x buckets rows.

    Every event is priced alone, with its own model or else its session's. Events that name a model are
    priced before the shuffle and summed on the map side. Events without one keep their usage in the
    grouping key, with a count, until the session's model is joined; equal ones still merge.
    """
    span = spanned(r, sessions)
    zero = F.lit(0).cast("bigint")
    unnamed = F.col("model") == ""
    events = (
        token_events.where((F.col("ts") >= r.cutoff) & ~F.col("is_user_turn"))
        .withColumn("idx", F.floor((F.col("ts") - span["start"]) / span["width"]))
        .where((F.col("idx") >= 0) & (F.col("idx") < r.n_buckets))
        .withColumn("idx", F.col("idx").cast("int"))
    )
    priced = with_cost(events, book, F.col("model"), "cost")
    summed = (
        priced.groupBy(
            "agent", "path", "idx",
            unnamed.alias("unnamed"),
            *[F.when(unnamed, F.col(c)).otherwise(zero).alias(c) for c in USAGE],
        )
        .agg(F.sum("cost").alias("named_cost"), F.count_if(is_llm_call()).alias("calls"), F.count(F.lit(1)).alias("n"))
    )
    joined = summed.join(active.select("agent", "path", "meta_model"), ["agent", "path"])
    repriced = with_cost(joined, book, F.col("meta_model"), "meta_cost")
    cost = F.when(F.col("unnamed"), F.col("meta_cost") * F.col("n")).otherwise(F.col("named_cost"))
    return repriced.groupBy("agent", "idx").agg(F.sum(cost).alias("event_cost"), F.sum("calls").alias("calls"))


def _grid(df: DataFrame, sessions: DataFrame, r: Range, by_agent: bool) -> DataFrame:
    """Every bucket (of every agent), made from constants."""
    one = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(0), F.lit(r.n_buckets - 1))).alias("idx"), spanned(r, sessions).alias("_span")
    )
    one = one.select(
        "idx", F.col("_span.width").alias("bucket_seconds"),
        (F.col("_span.start") + F.col("idx") * F.col("_span.width")).alias("bucket_ts"),
    )
    return one.withColumn("agent", F.explode(F.array(*[F.lit(a) for a in AGENTS]))) if by_agent else one


def _per_hour(calls: Column) -> Column:
    return calls / F.greatest(F.col("bucket_seconds") / F.lit(3600.0), F.lit(0.0001))


def time_series(sums: DataFrame, sessions: DataFrame, r: Range) -> DataFrame:
    """All buckets of the range, empty ones included."""
    totals = sums.groupBy("idx").agg(F.sum("event_cost").alias("event_cost"), F.sum("calls").alias("calls"))
    zero = F.lit(0).cast("bigint")
    return (
        _grid(sums, sessions, r, by_agent=False)
        .join(totals, "idx", "left")
        .select(
            "idx", "bucket_ts",
            F.coalesce("event_cost", F.lit(0.0)).alias("event_cost"),
            F.coalesce("calls", zero).alias("calls"),
            _per_hour(F.coalesce("calls", zero)).alias("calls_per_hour"),
        )
    )


def agent_series(sums: DataFrame, sessions: DataFrame, r: Range, measure: str) -> DataFrame:
    """(agent, idx, bucket_ts, value) of one measure; agents that are zero throughout are left out."""
    shown = sums.groupBy("agent").agg((F.max(measure) > 0).alias("shown")).where("shown").select("agent")
    grid = _grid(sums, sessions, r, by_agent=True).join(shown, "agent", "left_semi")
    values = sums.select("agent", "idx", F.col(measure).alias("value"))
    nothing = F.lit(0).cast(dict(values.dtypes)["value"])
    return grid.join(values, ["agent", "idx"], "left").select(
        "agent", "idx", "bucket_ts", F.coalesce("value", nothing).alias("value")
    )


def agents_by_peak(sums: DataFrame, sessions: DataFrame, r: Range, measure: str) -> DataFrame:
    """Agents by falling peak bucket; calls as an hourly rate."""
    peaks = (
        sums.groupBy("agent")
        .agg(F.max(measure).cast("double").alias("peak"))
        .where(F.col("peak") > 0)
        .withColumn("bucket_seconds", bucket_seconds(r, sessions))
    )
    peak = _per_hour(F.col("peak")) if measure == "calls" else F.col("peak")
    return peaks.select("agent", peak.alias("peak")).orderBy(F.desc("peak"), "agent")
