"""Literal search over transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_CAP = 500
RADIUS = 40


def _quoted(query: str) -> str:
    return "(?iu)\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def contains_text(body: Column, query: str) -> Column:
    """The case does not matter; the query is taken literally."""
    return body.rlike(_quoted(query))


def _match_at(body: Column, query: str) -> Column:
    """1-based position of the first match, in characters: one past the text before it."""
    return F.length(F.split(body, _quoted(query), 2)[0]) + 1


def _snippet(body: Column, at: Column, length: Column) -> Column:
    """The match with 40 characters on each side; positions are in characters."""
    first = F.greatest(at - RADIUS, F.lit(1))
    last = F.least(at + length - 1 + RADIUS, F.length(body))
    lead = F.when(first > 1, F.lit("…")).otherwise(F.lit(""))
    tail = F.when(last < F.length(body), F.lit("…")).otherwise(F.lit(""))
    text = F.translate(F.substring(body, first, last - first + 1), "\n\r\t", "   ")
    return F.struct(
        F.concat(lead, text, tail).alias("snippet"),
        (F.length(lead) + at - first).alias("match_start"),
    )


def hits(transcript: DataFrame, query: str) -> DataFrame:
    """At most one hit per event: its first match. An empty query finds nothing."""
    if query == "":
        return _with_snippet(transcript.where(F.lit(False)), query)
    return _with_snippet(transcript.where(contains_text(F.col("body"), query)), query)


def _with_snippet(found: DataFrame, query: str) -> DataFrame:
    at = _match_at(F.col("body"), query)
    # case folding keeps the length of a literal, so the match is as long as the query
    length = F.lit(len(query))
    return found.withColumn("_s", _snippet(F.col("body"), at, length)).select(
        "agent", "path", "session_id", "event_index", "ts", "kind",
        F.col("_s.snippet").alias("snippet"),
        F.col("_s.match_start").cast("bigint").alias("match_start"),
        length.cast("bigint").alias("match_len"),
    )


def ranked_hits(found: DataFrame, sessions: DataFrame, cap: int = HIT_CAP) -> DataFrame:
    """Newest session first, then event order; the cap is that of a result page, the total is kept."""
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    active = sessions.select("agent", "path", "last_active_ts")
    return (
        found.join(active, ["agent", "path"])
        .orderBy(F.desc("last_active_ts"), "session_id", "path", "event_index")
        .limit(cap)
        .withColumn("total_hits", total)
    )


def sessions_with_prompt(sessions: DataFrame, transcript: DataFrame, query: str) -> DataFrame:
    """Sessions in which the user wrote the text."""
    found = transcript.where((F.col("kind") == "User") & contains_text(F.col("body"), query))
    return sessions.join(found.select("agent", "path"), ["agent", "path"], "left_semi")
