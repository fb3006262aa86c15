"""Usage, cost, series and grouping over the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmeter.functions.pricing import PriceTable, with_cost
from sessionmeter.functions.ranges import RANGES, Range, bucket_seconds, bucket_start, window_hours
from sessionmeter.operators import grouping, lookup, rollups, series, usage
from sessionmeter.registry import tables as T
from sessionmeter.schema import USAGE
from sessionmeter.session import materialize

NOW = T.NOW
DAY = 86_400


def _money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _inputs(spark, sf):
    return T.token_events(spark, sf), T.sessions(spark, sf)


def _active(spark, sf, label):
    events, sessions = _inputs(spark, sf)
    return usage.per_session(events, sessions, Range(label, NOW), T.sample_prices())


def _hours(spark, sf, label):
    return window_hours(Range(label, NOW), T.sessions(spark, sf))


def _sums(spark, sf, label):
    events, sessions = _inputs(spark, sf)
    r = Range(label, NOW)
    active = usage.per_session(events, sessions, r, T.sample_prices())
    return series.bucket_sums(events, active, sessions, r, T.sample_prices()), sessions, r


def _by_group(spark, sf, label):
    return rollups.by_group(materialize(_active(spark, sf, label)), _hours(spark, sf, label), grouping.DEFAULT_GAP)


def price_match(spark, sf):
    book = T.sample_prices()
    models = T.token_events(spark, sf).select("model").distinct()
    return models.select("model", book.key(F.col("model")).alias("price_key"))


def context_window(spark, sf):
    models = T.token_events(spark, sf).select("model").distinct()
    return models.select("model", T.sample_contexts().window(F.col("model")).alias("context_window"))


def event_cost_by_model(spark, sf):
    priced = with_cost(T.token_events(spark, sf), T.sample_prices(), F.col("model"), "cost")
    return _money(priced.groupBy("agent", "model").agg(F.sum("cost").alias("event_cost")), "event_cost")


def cost_without_cached_input(spark, sf):
    priced = with_cost(
        T.token_events(spark, sf), T.sample_prices(), F.col("model"), "cost", exclude_cached_from_input=True
    )
    return _money(priced.groupBy("model").agg(F.sum("cost").alias("event_cost")), "event_cost")


def usage_by_agent(spark, sf):
    rows = T.token_events(spark, sf).groupBy("agent").agg(*usage.usage_sums())
    created = F.col("cache_creation_tokens") + F.col("cache_creation_5m_tokens") + F.col("cache_creation_1h_tokens")
    return rows.withColumn("cache_creation_total", created)


def window_scan_7d(spark, sf):
    scanned = usage.scan_window(T.token_events(spark, sf), Range("7d", NOW).cutoff)
    return scanned.withColumn("last_model", F.coalesce("last_model", F.lit("")))


def _per_session(label):
    def query(spark, sf):
        out = _active(spark, sf, label).select(
            "agent", "session_id", "model", "turns", "calls", *USAGE, "session_cost"
        )
        return _money(out, "session_cost")

    return query


def cost_with_subagents(spark, sf):
    """A fifth of the users work as subagents of the user before them, day by day."""
    user = F.regexp_extract("path", "^u([0-9]+)-", 1).cast("bigint")
    parent = F.concat(F.lit("u"), (user - 1).cast("string"), F.regexp_extract("path", "^u[0-9]+(-.*)$", 1))
    spent = _active(spark, sf, "all").withColumn("parent_path", F.when(user % 5 == 1, parent))
    return _money(rollups.with_subagents(spent), "own_cost", "cost")


def priced_by_table(spark, sf):
    """Models priced by a book of as many rows as there are parts; names of models are cut from their texts."""
    part = T.table(spark, sf, "part")
    rows = part.select(
        F.col("p_partkey").alias("pos"), F.lower(F.concat("p_brand", F.lit("/"), (F.col("p_partkey") % 1000).cast("string"))).alias("key"),
        F.col("p_retailprice").alias("inp"), F.lit(0.0).alias("out"), F.lit(0.0).alias("cw5m"), F.lit(0.0).alias("cw1h"), F.lit(0.0).alias("cr"),
    )
    models = part.where(F.col("p_partkey") % 3 == 0).select(F.concat(F.lit("X-"), "p_brand", F.lit("/"), (F.col("p_partkey") % 1500).cast("string")).alias("model"))
    return PriceTable(rows).matched(models).select("model", F.col("key").alias("price_key"), F.col("price.inp").alias("price"))


def range_cutoffs(spark, sf):
    events = T.token_events(spark, sf)
    counts = events.agg(*[F.count_if(F.col("ts") >= Range(n, NOW).cutoff).alias(n) for n in RANGES])
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("range"),
                        F.lit(Range(n, NOW).cutoff).cast("bigint").alias("cutoff"),
                        F.col(n).alias("events"),
                    )
                    for n in RANGES
                ]
            )
        ).alias("row")
    ).select("row.*")


def bucket_specs(spark, sf):
    sessions = T.sessions(spark, sf)
    rows = None
    for name in RANGES:
        r = Range(name, NOW)
        one = spark.range(1).select(
            F.lit(name).alias("range"),
            bucket_start(r, sessions).alias("bucket_start"),
            bucket_seconds(r, sessions).alias("bucket_seconds"),
            F.lit(r.n_buckets).alias("n_buckets"),
            F.round(window_hours(r, sessions), 6).alias("window_hours"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _time_series(label):
    def query(spark, sf):
        return _money(series.time_series(*_sums(spark, sf, label)), "event_cost", "calls_per_hour")

    return query


def _agent_series(measure, label):
    def query(spark, sf):
        out = series.agent_series(*_sums(spark, sf, label), measure)
        return _money(out, "value") if measure == "event_cost" else out

    return query


def _agents_by_peak(measure):
    def query(spark, sf):
        return _money(series.agents_by_peak(*_sums(spark, sf, "30d"), measure), "peak")

    return query


def _totals(label):
    def query(spark, sf):
        row = rollups.totals(materialize(_active(spark, sf, label)), _hours(spark, sf, label), grouping.DEFAULT_GAP)
        return _money(row, "cost", "window_hours", "calls_per_hour")

    return query


def _by_agent(label):
    def query(spark, sf):
        return _money(rollups.by_agent(_active(spark, sf, label), _hours(spark, sf, label)), "cost", "calls_per_hour")

    return query


def _by_model(label):
    def query(spark, sf):
        return _money(rollups.by_model(_active(spark, sf, label), _hours(spark, sf, label)), "cost", "calls_per_hour")

    return query


def _by_group_query(label):
    def query(spark, sf):
        return _money(rollups.sorted_groups(_by_group(spark, sf, label)), "cost", "calls_per_hour")

    return query


def _top_groups(measure):
    def query(spark, sf):
        return _money(rollups.top_groups(_by_group(spark, sf, "30d"), measure), "value", "share")

    return query


def filtered_by_agent(spark, sf):
    """The dashboard of one agent without scripted sessions."""
    events, sessions = _inputs(spark, sf)
    kept = lookup.filter_sessions(sessions, "claude", exclude_scripted=True)
    r = Range("30d", NOW)
    active = usage.per_session(events, kept, r, T.sample_prices())
    return _money(rollups.by_agent(active, window_hours(r, kept)), "cost", "calls_per_hour")


def index_counts(spark, sf):
    return rollups.index_counts(T.sessions(spark, sf))


def newest_sessions(spark, sf):
    return rollups.newest_sessions(T.sessions(spark, sf))


def _grouped(spark, sf):
    return grouping.group_sessions(T.sessions(spark, sf))


def session_groups(spark, sf):
    return grouping.groups(_grouped(spark, sf))


def session_group_of(spark, sf):
    return _grouped(spark, sf).select("agent", "session_id", "group_key", "group_id")


def group_members(spark, sf):
    return grouping.members(_grouped(spark, sf)).drop("path")


def group_size_histogram(spark, sf):
    return rollups.group_size_histogram(grouping.groups(_grouped(spark, sf)))


def largest_groups(spark, sf):
    return rollups.largest_groups(grouping.groups(_grouped(spark, sf)))


def session_id_prefix(spark, sf):
    return lookup.by_id_prefix(T.sessions(spark, sf), "u12-2024-01-1")


def sessions_by_cwd(spark, sf):
    return lookup.by_cwd(T.sessions(spark, sf), "/w/u12").select("agent", "session_id", "last_active_ts")


def sessions_by_day(spark, sf):
    day = NOW - 10 * DAY
    return lookup.by_day(T.sessions(spark, sf), "/w/u12", day).select("agent", "session_id", "last_active_ts")


QUERIES = {
    "price_match": price_match,
    "priced_by_table": priced_by_table,
    "cost_with_subagents": cost_with_subagents,
    "context_window": context_window,
    "event_cost_by_model": event_cost_by_model,
    "cost_without_cached_input": cost_without_cached_input,
    "usage_by_agent": usage_by_agent,
    "window_scan_7d": window_scan_7d,
    "active_sessions_1d": _per_session("1d"),
    "session_cost_7d": _per_session("7d"),
    "session_cost_all": _per_session("all"),
    "range_cutoffs": range_cutoffs,
    "bucket_specs": bucket_specs,
    "time_series_1h": _time_series("1h"),
    "time_series_4h": _time_series("4h"),
    "time_series_1d": _time_series("1d"),
    "time_series_7d": _time_series("7d"),
    "time_series_30d": _time_series("30d"),
    "time_series_all": _time_series("all"),
    "agent_cost_series_7d": _agent_series("event_cost", "7d"),
    "agent_calls_series_7d": _agent_series("calls", "7d"),
    "agents_by_peak_cost": _agents_by_peak("event_cost"),
    "agents_by_peak_calls": _agents_by_peak("calls"),
    "totals_7d": _totals("7d"),
    "totals_all": _totals("all"),
    "cost_by_agent_1h": _by_agent("1h"),
    "cost_by_agent_7d": _by_agent("7d"),
    "cost_by_agent_all": _by_agent("all"),
    "cost_by_model_7d": _by_model("7d"),
    "cost_by_model_all": _by_model("all"),
    "cost_by_group_7d": _by_group_query("7d"),
    "cost_by_group_30d": _by_group_query("30d"),
    "top_groups_by_cost": _top_groups("cost"),
    "top_groups_by_rate": _top_groups("calls_per_hour"),
    "filtered_by_agent": filtered_by_agent,
    "index_counts": index_counts,
    "newest_sessions": newest_sessions,
    "session_groups": session_groups,
    "session_group_of": session_group_of,
    "group_members": group_members,
    "group_size_histogram": group_size_histogram,
    "largest_groups": largest_groups,
    "session_id_prefix": session_id_prefix,
    "sessions_by_cwd": sessions_by_cwd,
    "sessions_by_day": sessions_by_day,
}
