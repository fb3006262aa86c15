"""SimHash near copies by multi-index hashing.

A text's words are runs of characters other than the space and U+0009 to U+000D, with A-Z in lower case; its features
are all shingles of four words (a shorter text is one shingle), each hashed by XXH64 with seed 42. A bit of the
fingerprint is set where more than half the features set it. Fingerprints that differ in at most `DISTANCE` bits are
linked, and linked ones, with all documents that hold them, are one component.

Links are looked for among distinct fingerprints, in three tables, one per segment of the bits. Where two fingerprints
differ in four bits at most, they differ in one bit at most in the first or the second segment, or in none in the
third (`segments`). So each fingerprint asks a table for its own segment and for those of a small Hamming ball around
it, each pair of buckets meets once, and the whole distance decides.

A bucket of more than `HOT` fingerprints, as a large group of near copies fills it, is cut into blocks that meet two
at a time. Such a meeting gives back a spanning forest of its links, never all of them, and compares a fingerprint
only with those that no chain has reached yet.

A null or blank text has the fingerprint zero, which links like any other. Repeated rows and null ids are rows like
any other; the least id of a component ignores nulls and is null only where all its ids are. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.llm.base import byte_words, ready
from sessionmeter.llm.graph import components, stored, unstore

SHINGLE = 4
SEED = 42
BITS = 64
DISTANCE = 4
SEGMENTS = 3
# a bucket with more fingerprints than this is cut into blocks of about BLOCK
HOT = 512
BLOCK = 1 << 15
# shingles hashed at a time, so that a long text needs no more memory than its words
PIECE = 1 << 16
# a fingerprint with more than this share of all rows is joined apart, so that there are 1,000 of them at most
FREQUENT = 1_000


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    from xxhash import xxh64_intdigest as h

    words = byte_words(text)
    if not words:
        return 0
    words = [w.lower() for w in words]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    joined = b" ".join(words)
    k = min(SHINGLE, len(words))
    first, last = (end - size)[: len(words) - k + 1], end[k - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), PIECE):
        spans = zip(first[at : at + PIECE].tolist(), last[at : at + PIECE].tolist())
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in spans), "<u8", min(PIECE, len(first) - at))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "fp": [fingerprint(t) for t in part["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(work, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def segments(distance: int = DISTANCE, count: int = SEGMENTS) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment.

    Two fingerprints outside the radius in every segment differ in at least the sum of (radius + 1) bits, and that sum
    is distance + 1. So no link is missed.
    """
    out, at = [], 0
    for i in range(count):
        bits = BITS // count + (i < BITS % count)
        spare = distance + 1 - count
        out.append((at, bits, spare // count + (i < spare % count)))
        at += bits
    return out


def _masks(distance: int, count: int) -> Column:
    """Per segment the ball around zero, as (mask, its highest bit)."""
    balls = []
    for first, bits, radius in segments(distance, count):
        ball = []
        for r in range(radius + 1):
            for places in combinations(range(first, first + bits), r):
                mask = sum(1 << p for p in places)
                ball.append((mask, 1 << places[-1] if places else 0))
        balls.append(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(t)).alias("top")) for m, t in ball]))
    return F.array(*balls)


def _in_tables(prints: DataFrame, distance: int, count: int) -> DataFrame:
    """fp, s, v: a row per fingerprint and segment."""
    own = [
        F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(((1 << bits) - 1) << first))).alias("v"))
        for i, (first, bits, _) in enumerate(segments(distance, count))
    ]
    return prints.select("fp", F.explode(F.array(*own)).alias("o")).select("fp", "o.s", "o.v")


def _ball(rows: DataFrame, distance: int, count: int) -> DataFrame:
    """A row per mask of the row's segment that makes its value larger, or leaves it: a pair of buckets comes up once."""
    ball = F.element_at(_masks(distance, count), F.col("s") + 1)
    return rows.withColumn("m", F.explode(ball)).where(F.col("v").bitwiseAND(F.col("m.top")) == 0)


def forest(prints: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect all that any links connect."""
    left = np.unique(prints).view(np.uint64)
    links = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found, left = left[near], left[~near]
                a = int(x.view(np.int64))
                links += [(a, b) for b in found.view(np.int64).tolist()]
                queue.extend(found)
    return links


def linked(prints: DataFrame, distance: int = DISTANCE, count: int = SEGMENTS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """a, b: enough links between the distinct fingerprints `fp` to connect all that are linked."""
    rows = _in_tables(prints, distance, count)
    sizes = stored(rows.groupBy("s", "v").agg(F.count(F.lit(1)).alias("k")), "buckets")
    rows = rows.join(sizes.where(F.col("k") > hot), ["s", "v"], "left")

    cold = rows.where(F.col("k").isNull()).drop("k")
    asking = _ball(cold, distance, count).select("s", F.col("v").bitwiseXOR(F.col("m.mask")).alias("v"), F.col("fp").alias("a"), F.col("m.top").alias("top"))
    met = asking.join(cold.withColumnRenamed("fp", "b"), ["s", "v"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    links = met.where(near & ((F.col("top") != 0) | (F.col("a") < F.col("b")))).select("a", "b").distinct()

    # pairs of buckets of which at least one is large; a bucket also meets itself
    ball = F.element_at(_masks(distance, count), F.col("s") + 1)
    pairs = (
        sizes.where(F.col("k") > hot)
        .withColumn("m", F.explode(ball))
        .withColumn("w", F.col("v").bitwiseXOR(F.col("m.mask")))
        .select("s", F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w"))
        .distinct()
    )
    blocks = sizes.select("s", "v", F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    count_to = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = (
        pairs.join(blocks, ["s", "v"]).withColumn("i", F.explode(count_to)).drop("blocks")
        .join(blocks.withColumnRenamed("v", "w"), ["s", "w"]).withColumn("j", F.explode(count_to)).drop("blocks")
        .where("v <> w or i <= j")
        .withColumn("cell", F.struct("s", "v", "w", "i", "j"))
    )
    seats = cells.select("s", "v", F.col("i").alias("place"), "cell").union(cells.select("s", "w", "j", "cell")).distinct()
    place = F.pmod(F.xxhash64("fp"), F.coalesce(F.ceil(F.col("k") / block), F.lit(1))).cast("int")
    seated = rows.withColumn("place", place).join(seats, ["s", "v", "place"]).select("cell", "fp")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(part["fp"].to_numpy(np.int64), distance), columns=["a", "b"]).astype("int64")

    links = stored(links.unionByName(seated.groupBy("cell").applyInPandas(meet, "a long, b long")), "links")
    unstore(sizes)
    return links


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    ready(docs.sparkSession)
    rows = stored(fingerprints(docs), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")), "prints")
    links = linked(prints)
    found = components(links).withColumnRenamed("node", "fp")
    least = found.join(prints, "fp").groupBy("root").agg(F.min("first").alias("least"))
    of_print = stored(
        prints.join(found.join(least, "root"), "fp", "left").select(
            "fp", "k", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")
        ),
        "components",
    )
    total = prints.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    unstore(links, prints)
    # at most FREQUENT rows of two numbers: a proven bound
    often = of_print.where(F.col("k") * FREQUENT > total).select("fp", F.lit(True).alias("often"), F.col("component_id").alias("c"))
    marked = rows.join(F.broadcast(often), "fp", "left")
    rest = of_print.where(F.col("k") * FREQUENT <= total).select("fp", "component_id")
    out = marked.where("often").select("doc_id", "fp", F.col("c").alias("component_id")).unionByName(
        marked.where("often is null").join(rest, "fp").select("doc_id", "fp", "component_id")
    )
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
