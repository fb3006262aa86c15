"""Order-dependent work on keys of any size.

A window over a whole key puts that key into one task. Here a key is cut into chunks that keep the
order; the work runs per chunk, and what must cross a chunk border travels as one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmeter.session import materialize

CHUNK_BITS = 14


def line_chunk(order: str = "ord") -> Column:
    """At most 2^14 consecutive lines of one file."""
    return F.shiftright(F.col(order), CHUNK_BITS)


def carry_last(df: DataFrame, keys: list[str], value: str, out: str, order: str = "ord") -> DataFrame:
    """The latest non-NULL `value` at or before each row of its key."""
    rows = df.withColumn("_chunk", line_chunk(order))
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # grouping by value first leaves numbers only to aggregate, and few rows to pick the last from
    last_seen = rows.groupBy(*keys, "_chunk", value).agg(F.max(order).alias("_at"))
    ends = last_seen.groupBy(*keys, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_end")
    )
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    local = rows.withColumn("_local", F.last(value, ignorenulls=True).over(within))
    return (
        local.join(carried, [*keys, "_chunk"], "left")
        .withColumn(out, F.coalesce("_local", "_carried"))
        .drop("_local", "_carried", "_chunk")
    )


def number_rows(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str) -> DataFrame:
    """Row numbers from 0 inside each key; `chunk` must not fall while `order` rises."""
    rows = df.withColumn("_chunk", chunk)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    local = rows.withColumn("_local", F.row_number().over(within))
    return (
        local.join(offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_local") - 1 + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset", "_chunk")
    )


def cut_by_order(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows with a chunk `_part`, for an order without a natural one.

    A range partitioning by key and order spreads even a single key over all tasks; it is computed once
    into reliable storage so that all uses see the same cut.
    """
    spread = df.repartitionByRange(_partitions(df), *[F.col(k) for k in keys], *order)
    return materialize(spread.withColumn("_part", F.spark_partition_id()))


def sum_before(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows before each one in its key, for an order without a natural chunk; pass narrow rows."""
    rows = cut_by_order(df, keys, order)
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        local.join(offsets, [*keys, "_part"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset", "_part")
    )


def with_neighbours(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Add `_row` (from 1), `_rows` (of the key), and `value` of the row before and after, NULL at either end.

    Neighbours are found inside a chunk; a row per chunk carries what crosses its borders. `value` is never NULL.
    """
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    rows = cut_by_order(df, keys, order).withColumns(
        {"_at": F.row_number().over(within), "_before": F.lag(value).over(within), "_after": F.lead(value).over(within)}
    )
    ends = rows.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("_before").isNull(), F.col(value))).alias("_first"),
        F.max(F.when(F.col("_after").isNull(), F.col(value))).alias("_last"),
    )
    chunks, whole = Window.partitionBy(*keys).orderBy("_part"), Window.partitionBy(*keys)
    border = ends.select(
        *keys, "_part",
        F.lag("_last").over(chunks).alias("_last_before"),
        F.lead("_first").over(chunks).alias("_first_after"),
        (F.sum("_n").over(chunks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(whole).alias("_rows"),
    )
    return (
        rows.join(border, [*keys, "_part"])
        .withColumn("_row", F.col("_offset") + F.col("_at"))
        .withColumn("_before", F.coalesce("_before", "_last_before"))
        .withColumn("_after", F.coalesce("_after", "_first_after"))
        .drop("_part", "_at", "_last_before", "_first_after", "_offset")
    )


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_max(df: DataFrame, keys: list[str], order: str, bucket: str, value: str, out: str, include_row: bool) -> DataFrame:
    """Running maximum of `value` inside a key; rows of a key are unique in `order`."""
    end = 0 if include_row else -1
    within = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, bucket).agg(F.max(value).alias("_top"))
    carried = tops.withColumn("_carried", F.max("_top").over(before)).drop("_top")
    return (
        df.withColumn("_local", F.max(value).over(within))
        .join(carried, [*keys, bucket])
        .withColumn(out, F.greatest("_local", "_carried"))
        .drop("_local", "_carried")
    )
