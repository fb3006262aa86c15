"""Connected components and stored intermediate tables."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmeter.session import remove, work_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, and safe from the loss of executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def unstore(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does as the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bit_place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def bit_filter(keys: DataFrame, place: Column, bits: int) -> bytes:
    """A bit set at each `place`, 2^bits in all whatever the number of rows: hashed keys give false positives only."""
    rows = (
        # bitmap functions number their buckets from 1
        keys.select(F.bitmap_bucket_number(place + 1).alias("_bucket"), F.bitmap_bit_position(place + 1).alias("_bit"))
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
        .collect()
    )
    size = 32768 // 8
    out = bytearray((1 << bits) // 8)
    for r in rows:
        out[(r["_bucket"] - 1) * size : r["_bucket"] * size] = r["_bits"]
    return bytes(out)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the least node of the component.

    Alternating large and small stars: each round hangs a node's neighbours on its least neighbour, so that the
    rounds grow with the logarithm of the component's size. No component meets in one task: minima are
    aggregated before the shuffle, and the joins are plain equality joins that Spark splits where they are skewed.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        older, edges = edges, stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        unstore(older)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.groupBy("b").agg(F.min("b").alias("_r")).select("b", "_r")
    )
