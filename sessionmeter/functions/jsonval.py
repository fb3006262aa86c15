"""Typed reads from VARIANT values, with the strictness of a typed JSON reader.

The plain casts are too lax: a number becomes text, "5" becomes 5. Each reader here checks the stored
type first and gives NULL for any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_values(text: Column) -> Column:
    """The JSON values a text holds, separated by commas; NULL when it is not JSON.

    The brackets make anything after a value an error: a torn line must not pass for its first half.
    """
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")


def only_value(values: Column) -> Column:
    """The list again if it holds exactly one value, else NULL."""
    return F.when(F.size(values) == 1, values)


def parse_line(text: Column) -> Column:
    """One JSON value, else NULL."""
    return F.try_element_at(only_value(parse_values(text)), F.lit(1))


def at(value: Column, path: str) -> Column:
    """The value at a path; NULL only when there is none (a JSON null is a value)."""
    return F.try_variant_get(value, path, "variant")


def _typed(value: Column, path: str, stored: str, cast: str) -> Column:
    return F.when(F.schema_of_variant(at(value, path)) == stored, F.try_variant_get(value, path, cast))


def text_at(value: Column, path: str) -> Column:
    return _typed(value, path, "STRING", "string")


def word_at(value: Column, path: str) -> Column:
    """Text only ever compared with known words, so other JSON types need no type check."""
    return F.try_variant_get(value, path, "string")


def flag_at(value: Column, path: str) -> Column:
    """True only for JSON true."""
    return F.coalesce(_typed(value, path, "BOOLEAN", "boolean"), F.lit(False))


def int_at(value: Column, path: str) -> Column:
    return _typed(value, path, "BIGINT", "bigint")


def count_at(value: Column, path: str) -> Column:
    """A non-negative JSON integer, anything else 0."""
    return F.greatest(F.coalesce(int_at(value, path), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def list_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def text_or_json(value: Column, path: str) -> Column:
    """Text as it is, any other value as JSON; NULL when absent."""
    found = at(value, path)
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string")).otherwise(
        F.to_json(found)
    )
