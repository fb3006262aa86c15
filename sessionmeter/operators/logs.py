"""What the line-based dialects share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions.jsonval import only_value, parse_values
from sessionmeter.operators.ordered import line_chunk, number_rows
from sessionmeter.schema import SESSION_COLUMNS, TRANSCRIPT_COLUMNS
from sessionmeter.sources.lines import session_id


def parsed_lines(lines: DataFrame, agent: str, keep_bad: bool = False) -> DataFrame:
    """Add the parsed value `v` and the session id; lines that are not JSON are dropped unless kept.

    The value comes out of a generator on purpose: a filter on `v` written by the caller would
    otherwise be moved below the projection and parse the line again for every test it makes.
    """
    label = F.col("session_id") if "session_id" in lines.columns else session_id(agent, F.col("path"))
    values = lines.withColumn("session_id", label).withColumn("_values", parse_values(F.col("value")))
    spread = F.explode_outer if keep_bad else F.explode
    columns = [c for c in values.columns if c not in ("value", "_values")]
    return values.select(*columns, spread(only_value(F.col("_values"))).alias("v"))


def first_value(column: str) -> Column:
    """First non-NULL value in line order."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("ord")))


def summary_row(rows: DataFrame, agent: str, **measures: Column) -> DataFrame:
    """One session row per file; needs path, session_id, file_mtime, ord, ts."""
    started = F.min_by("ts", F.when(F.col("ts") > 0, F.col("ord")))
    out = rows.groupBy("path").agg(
        F.min("session_id").alias("session_id"),
        F.max("file_mtime").alias("last_active_ts"),
        started.alias("started_at_ts"),
        *[column.alias(name) for name, column in measures.items()],
    )
    return out.select(
        F.lit(agent).alias("agent"), "session_id", "path", "cwd", "model", "prompt",
        F.col("turns").cast("bigint").alias("turns"),
        "last_active_ts",
        F.coalesce("started_at_ts", "last_active_ts").alias("started_at_ts"),
        "is_scripted",
    ).select(*SESSION_COLUMNS)


def explode_events(rows: DataFrame, agent: str, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Flatten `events` (array of kind, body) and number them per file in file order."""
    flat = rows.select(
        *[c for c in rows.columns if c != "events"], F.posexplode("events").alias("pos", "event")
    ).select("path", "session_id", "ord", "pos", "ts", "event.kind", "event.body")
    numbered = number_rows(flat, list(keys), ["ord", "pos"], line_chunk(), "event_index")
    return numbered.withColumn("agent", F.lit(agent)).select(*TRANSCRIPT_COLUMNS)
