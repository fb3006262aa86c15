"""Price match and cost.

A price book is a short fixed table, so the match is a ladder of column tests rather than a join: no
shuffle, nothing broadcast, and a model that holds a third of all events costs no more than others. A book
of more rows than a ladder should have is a table, matched by equality with the pieces of the distinct models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BOOK_ROWS = 500
SEARCH_PRICE = 0.01
DEFAULT_CONTEXT = 200_000

# USD per million tokens, price snapshot of 2026-04-17.
# key, input, output, 5-minute cache write, 1-hour cache write, cache read
PRICES = [
    ("claude-opus-4-6", 5.00, 25.00, 6.25, 10.00, 0.50),
    ("claude-opus-4-5", 5.00, 25.00, 6.25, 10.00, 0.50),
    ("claude-opus-4-1", 15.00, 75.00, 18.75, 30.00, 1.50),
    ("claude-opus-4", 15.00, 75.00, 18.75, 30.00, 1.50),
    ("claude-sonnet-4-6", 3.00, 15.00, 3.75, 6.00, 0.30),
    ("claude-sonnet-4-5", 3.00, 15.00, 3.75, 6.00, 0.30),
    ("claude-sonnet-4", 3.00, 15.00, 3.75, 6.00, 0.30),
    ("claude-haiku-4-5", 1.00, 5.00, 1.25, 2.00, 0.10),
    ("claude-haiku-3-5", 0.80, 4.00, 1.00, 1.60, 0.08),
    ("claude-haiku-3", 0.25, 1.25, 0.30, 0.50, 0.03),
    ("gpt-5.4", 5.00, 15.00, 0.0, 0.0, 1.25),
    ("gpt-5.3-codex", 3.50, 14.00, 0.0, 0.0, 0.875),
    ("gpt-5.3", 2.00, 8.00, 0.0, 0.0, 0.50),
    ("gpt-4.1", 2.00, 8.00, 0.0, 0.0, 0.50),
    ("gpt-4.1-mini", 0.40, 1.60, 0.0, 0.0, 0.10),
    ("gpt-4.1-nano", 0.10, 0.40, 0.0, 0.0, 0.025),
    ("o3", 2.00, 8.00, 0.0, 0.0, 0.50),
    ("o3-pro", 20.00, 80.00, 0.0, 0.0, 5.00),
    ("o4-mini", 1.10, 4.40, 0.0, 0.0, 0.275),
    ("qwen3.6-plus", 0.548, 2.192, 0.0, 0.0, 0.137),
    ("qwen3-coder", 0.548, 2.192, 0.0, 0.0, 0.137),
    ("qwen-plus", 0.548, 2.192, 0.0, 0.0, 0.137),
    ("qwen-max", 2.740, 10.96, 0.0, 0.0, 0.685),
    ("gemma", 0.0, 0.0, 0.0, 0.0, 0.0),
    ("llama", 0.0, 0.0, 0.0, 0.0, 0.0),
    (".gguf", 0.0, 0.0, 0.0, 0.0, 0.0),
]

# Context window in tokens.
CONTEXT_WINDOWS = [
    ("claude-opus-4-6", 1_000_000),
    ("claude-sonnet-4-6", 1_000_000),
    ("claude-opus-4-5", 200_000),
    ("claude-opus-4-1", 200_000),
    ("claude-opus-4", 200_000),
    ("claude-sonnet-4-5", 200_000),
    ("claude-sonnet-4", 200_000),
    ("claude-haiku-4-5", 200_000),
    ("claude-haiku-3-5", 200_000),
    ("claude-haiku-3", 200_000),
]


class KeyedBook:
    """Rows found by the longest key contained in a model name.

    An exact name is also the longest possible contained key, so one ladder in order of falling key
    length (ties in table order) covers both rules.
    """

    def __init__(self, rows: Sequence[tuple]):
        if len(rows) > MAX_BOOK_ROWS:
            raise ValueError(f"a ladder holds at most {MAX_BOOK_ROWS} rows, got {len(rows)}; use PriceTable")
        self.rows = sorted(rows, key=lambda r: -len(r[0]))

    @classmethod
    def from_table(cls, df: DataFrame, *columns: str):
        """A book from a small table whose rows are ordered by `pos`; the read is bounded."""
        found = df.orderBy("pos").select(*columns).limit(MAX_BOOK_ROWS + 1).collect()
        return cls([tuple(r) for r in found])

    def pick(self, model: Column, make) -> Column:
        """`make(row)` of the matching row, else NULL."""
        name = F.lower(model)
        out = None
        for row in self.rows:
            test = name.contains(row[0])
            out = F.when(test, make(row)) if out is None else out.when(test, make(row))
        return F.when(model != "", out)

    def key(self, model: Column) -> Column:
        return self.pick(model, lambda row: F.lit(row[0]))


class PriceBook(KeyedBook):
    FIELDS = ("inp", "out", "cw5m", "cw1h", "cr")

    def attach(self, df: DataFrame, model: Column, out: str) -> DataFrame:
        """Add the prices of the matching row as a struct, else NULL."""
        return df.withColumn(out, self.prices(F.coalesce(model, F.lit(""))))

    def prices(self, model: Column) -> Column:
        return self.pick(
            model,
            lambda row: F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(self.FIELDS, row[1:])]),
        )


class PriceTable:
    """A price book of any size: a table (pos, key, inp, out, cw5m, cw1h, cr)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.where("key is not null")

    def matched(self, models: DataFrame) -> DataFrame:
        """model, key and price of the distinct `models` that contain a key: the longest, the first of equal ones.

        A model is cut into its pieces of the lengths that keys have, so the work of a model grows with its
        length and never with the book.
        """
        # as many lengths as the longest key has characters, at most
        lengths = [r[0] for r in self.rows.select(F.length("key")).distinct().collect()]
        name, n = F.lower("model"), F.col("n")
        pieces = (
            models.select("model").distinct().where("model <> ''")
            .select("model", F.explode(F.array(*[F.lit(k) for k in lengths]).cast("array<int>")).alias("n"))
            .where(n <= F.length(name))
            # without characters a key is contained everywhere
            .select("model", "n", F.explode(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1)))).alias("at"))
            .select("model", F.substring(name, F.col("at"), n).alias("key"))
            .distinct()
        )
        price = F.struct(*[F.col(c).cast("double").alias(c) for c in PriceBook.FIELDS])
        rank = F.struct(F.length("key"), -F.col("pos"))
        return pieces.join(self.rows, "key").groupBy("model").agg(
            F.max_by("key", rank).alias("key"), F.max_by(price, rank).alias("price")
        )

    def attach(self, df: DataFrame, model: Column, out: str) -> DataFrame:
        """Add the prices of the matching row as a struct, else NULL."""
        named = df.withColumn("_model", F.coalesce(model, F.lit("")))
        found = self.matched(named.select(F.col("_model").alias("model")))
        # a row per distinct model on one side: Spark broadcasts it where it is small, else splits a frequent model
        return named.join(found.select(F.col("model").alias("_model"), F.col("price").alias(out)), "_model", "left").drop("_model")


class ContextBook(KeyedBook):
    def window(self, model: Column) -> Column:
        return F.coalesce(
            self.pick(model, lambda row: F.lit(row[1]).cast("bigint")), F.lit(DEFAULT_CONTEXT).cast("bigint")
        )


def default_prices() -> PriceBook:
    return PriceBook(PRICES)


def price_book(rows: DataFrame) -> PriceBook | PriceTable:
    """The book of a table (pos, key, inp, out, cw5m, cw1h, cr); both forms find the same rows."""
    if len(rows.limit(MAX_BOOK_ROWS + 1).collect()) > MAX_BOOK_ROWS:
        return PriceTable(rows)
    return PriceBook.from_table(rows, "key", *PriceBook.FIELDS)


def default_contexts() -> ContextBook:
    return ContextBook(CONTEXT_WINDOWS)


def with_cost(df: DataFrame, book: PriceBook | PriceTable, model: Column, out: str, exclude_cached_from_input: bool = False) -> DataFrame:
    """Add the USD cost of the usage columns, priced as `model`.

    Legacy cache writes count at the 5-minute rate only when neither of the newer fields is set. An
    unknown model pays for web searches only. Cached tokens stay in the input count unless asked.
    """
    priced = book.attach(df, model, "_price")
    p = F.col("_price")
    legacy = (F.col("cache_creation_5m_tokens") == 0) & (F.col("cache_creation_1h_tokens") == 0)
    write5m = F.when(legacy, F.col("cache_creation_tokens")).otherwise(F.col("cache_creation_5m_tokens"))
    inp = F.col("input_tokens")
    if exclude_cached_from_input:
        inp = F.greatest(inp - F.col("cache_read_tokens"), F.lit(0).cast("bigint"))
    searches = F.col("web_search_calls") * F.lit(SEARCH_PRICE)
    million = F.lit(1_000_000.0)
    total = (
        inp * p["inp"] / million
        + F.col("output_tokens") * p["out"] / million
        + F.col("cache_read_tokens") * p["cr"] / million
        + write5m * p["cw5m"] / million
        + F.col("cache_creation_1h_tokens") * p["cw1h"] / million
        + searches
    )
    rounded = F.floor(total * million + F.lit(0.5)).cast("double") / million
    return priced.withColumn(out, F.when(p.isNull(), searches).otherwise(rounded)).drop("_price")
