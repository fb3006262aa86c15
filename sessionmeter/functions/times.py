"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: the RFC 3339 date-time shape, offset required.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def rfc3339_seconds(text: Column) -> Column:
    """Whole epoch seconds, not below 0; NULL when the text is not RFC 3339."""
    parsed = F.unix_seconds(F.try_to_timestamp(F.upper(text)))
    # not greatest(), which would turn an impossible date into 0
    return F.when(text.rlike(RFC3339), F.when(parsed < 0, 0).otherwise(parsed))


def epoch_seconds(ntz: Column) -> Column:
    """Epoch seconds of a zone-less timestamp read as UTC, whatever the session zone."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ntz)


def real_seconds(real: Column) -> Column:
    """REAL epoch seconds cut to whole seconds, not below 0, NULL as 0."""
    return F.coalesce(F.greatest(real, F.lit(0.0)).cast("bigint"), F.lit(0).cast("bigint"))


def real_iso(real: Column) -> Column:
    """REAL epoch seconds as RFC 3339 text in UTC."""
    whole = F.greatest(real, F.lit(0.0)).cast("bigint")
    nanos = (F.greatest(real - real.cast("bigint"), F.lit(0.0)) * 1e9).cast("bigint")
    base = F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss")
    digits = F.lpad(nanos.cast("string"), 9, "0")
    # the fraction is printed with 3, 6 or 9 digits, whichever loses nothing
    fraction = (
        F.when(nanos == 0, F.lit(""))
        .when(nanos % 1_000_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .when(nanos % 1_000 == 0, F.concat(F.lit("."), F.substring(digits, 1, 6)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.concat(base, fraction, F.lit("+00:00"))


def clock_part(text: Column) -> Column:
    """HH:MM:SS of an ISO text; anything else unchanged."""
    is_iso = (F.length(text) >= 19) & (F.substring(text, 11, 1) == "T")
    return F.when(is_iso, F.substring(text, 12, 8)).otherwise(text)


def minute_label(seconds: Column) -> Column:
    """MM-DD HH:MM in the session zone; empty for 0."""
    return F.when(seconds == 0, F.lit("")).otherwise(F.date_format(F.timestamp_seconds(seconds), "MM-dd HH:mm"))


def duration_label(seconds: Column) -> Column:
    """Largest whole unit: 3d, 5h, 7m, 9s."""
    out = F.concat(seconds.cast("string"), F.lit("s"))
    for size, unit in ((60, "m"), (3_600, "h"), (86_400, "d")):
        out = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))).otherwise(out)
    return out


def minus_floor_zero(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("bigint"))
