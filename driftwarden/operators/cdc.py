"""Capture-gap analysis of change events.

Events carry ``table_name, event_ts, captured, gap_reason`` and optionally ``after`` (JSON text).
There are few tables and reasons, so every aggregate combines on the map side and a table that
owns most events costs nothing extra.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.config import DEFAULT_LOOKBACK_HOURS
from driftwarden.functions.conversion import parse_iso_ts, percent_of
from driftwarden.sources.local import table_list


def captured_flag() -> Column:
    return F.coalesce(F.col("captured"), F.lit(True))


def gap_reason() -> Column:
    return F.coalesce(F.col("gap_reason"), F.lit("UNKNOWN"))


def filter_events(events: DataFrame, as_of: dt.datetime | None = None,
                  hours_back: int = DEFAULT_LOOKBACK_HOURS, table: str | None = None) -> DataFrame:
    """Events of the look-back window (inclusive), and those whose time is unknown.

    ``as_of`` is UTC (or carries its zone); ``None`` takes the whole log.
    """
    if table is not None:
        events = events.filter(F.col("table_name") == table)
    if as_of is None:
        return events
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    # through text, so that neither the session's nor the driver's zone shifts it
    cutoff = F.lit(str(as_of - dt.timedelta(hours=hours_back))).cast("timestamp_ntz")
    return events.filter((F.col("event_ts") >= cutoff) | F.col("event_ts").isNull())


def _gap_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_events"), F.count_if(captured_flag()).alias("captured"),
            F.count_if(~captured_flag()).alias("missed")]


def cdc_gap(events: DataFrame, tables: Sequence[str], summary: DataFrame | None = None) -> DataFrame:
    """Total, captured and missed events and the gap rate, one row for each listed table.

    ``summary`` holds precomputed figures that replace the computed ones for its tables; a table that it lists twice
    fails the query. Every joined side has at most one row per listed table.
    """
    figures = ("total_events", "captured", "missed")
    counted = events.filter(F.col("table_name").isin(*tables)).groupBy("table_name").agg(*_gap_counts())
    gaps = table_list(events.sparkSession, tables).join(F.broadcast(counted), "table_name", "left").fillna(0, figures)
    gaps = gaps.select("table_name", *figures, percent_of(F.col("missed"), F.col("total_events")).alias("gap_rate"))
    if summary is None:
        return gaps
    columns = (*figures, "gap_rate")
    once = lambda c: F.when(F.count(F.lit(1)) == 1, F.max(c)).otherwise(F.raise_error(
        F.concat(F.lit("the gap summary lists a table twice: "), F.max("table_name"))))
    given = summary.filter(F.col("table_name").isin(*tables)).groupBy("table_name").agg(*[once(c).alias(f"given_{c}") for c in columns])
    return gaps.join(F.broadcast(given), "table_name", "left").select(
        "table_name", *[F.coalesce(f"given_{c}", c).alias(c) for c in columns])


def cdc_gap_patterns(events: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Missed events per table and reason with a rank by count (ties by reason).

    A ``summary`` replaces the patterns of every table for which it gives some, and adds what it says of them:
    description, columns, first and last time (NULL for computed patterns).
    """
    patterns = events.filter(~captured_flag()).groupBy("table_name", gap_reason().alias("reason")).agg(
        F.count(F.lit(1)).alias("event_count"))
    if summary is None:
        return ranked_patterns(patterns)
    given = summary.select("table_name", F.inline("gap_patterns")).select(
        "table_name", F.coalesce("reason", F.lit("UNKNOWN")).alias("reason"), F.col("count").alias("event_count"),
        "description", "affected_columns", *[parse_iso_ts(F.col(c)).alias(c) for c in ("first_occurrence", "last_occurrence")])
    computed = patterns.join(given.select("table_name").distinct(), "table_name", "left_anti")
    return ranked_patterns(given.unionByName(computed, allowMissingColumns=True))


def ranked_patterns(patterns: DataFrame, k: int | None = None) -> DataFrame:
    """Order reasons within their table, all of them or the top ``k``.

    Ranks an aggregate with one row per table and reason, never the events themselves.
    """
    order = Window.partitionBy("table_name").orderBy(F.desc("event_count"), "reason")
    ranked = patterns.withColumn("pattern_no", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("pattern_no") <= k)


def _by_column_set(events: DataFrame) -> DataFrame:
    """Missed events per table, reason and set of changed columns, with their first and last time."""
    return events.filter(~captured_flag()).groupBy(
        "table_name", gap_reason().alias("reason"), F.json_object_keys("after").alias("changed"),
    ).agg(F.count(F.lit(1)).alias("n"), F.min("event_ts").alias("first"), F.max("event_ts").alias("last"))


def cdc_pattern_columns(events: DataFrame) -> DataFrame:
    """One row per table, reason and changed column of the missed events, with their number and their first and last time.

    Column names come from the events' JSON, so any number of them may occur: nothing is gathered per reason. A name that an event
    holds twice counts once; events without a readable image have a NULL column.
    """
    columns = _by_column_set(events).select(
        "table_name", "reason", "n", "first", "last", F.explode_outer(F.array_distinct("changed")).alias("column_name"))
    return columns.groupBy("table_name", "reason", "column_name").agg(
        F.sum("n").alias("event_count"), F.min("first").alias("first_occurrence"), F.max("last").alias("last_occurrence"))


def cdc_pattern_detail(events: DataFrame) -> DataFrame:
    """Per table and reason: missed events, first and last time, and the columns they touched.

    Events with the same set of changed columns are counted first, then the sets are unfolded
    to single columns. The names are gathered per reason, for tables whose events name their own columns;
    ``cdc_pattern_columns`` gives a row per name, whatever the events hold.
    """
    unfolded = _by_column_set(events).select(
        "table_name", "reason", "n", "first", "last", F.posexplode_outer("changed").alias("pos", "column_name"))
    once = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("n"))  # a set counts with its first column only
    by_column = unfolded.groupBy("table_name", "reason", "column_name").agg(
        F.sum(once).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return by_column.groupBy("table_name", "reason").agg(
        F.sum("n").alias("event_count"), F.min("first").alias("first_occurrence"),
        F.max("last").alias("last_occurrence"), F.array_sort(F.collect_list("column_name")).alias("affected_columns"))


def cdc_summary(gaps: DataFrame) -> DataFrame:
    """One row over all tables, with the sorted list of tables that miss events."""
    totals = gaps.agg(
        F.sum("total_events").alias("total_events"), F.sum("captured").alias("captured"),
        F.sum("missed").alias("missed"),
        F.array_sort(F.collect_list(F.when(F.col("missed") > 0, F.col("table_name")))).alias("tables_affected"))
    return totals.withColumn("gap_rate", percent_of(F.col("missed"), F.col("total_events")))


def cdc_gap_windowed(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """The gap figures per table and event-time window; events without a readable time have a row with a NULL window."""
    undated = events.filter(F.col("event_ts").isNull()).groupBy("table_name").agg(*_gap_counts())
    dated = cdc_gap_dated_windows(events, width)
    none = {c: F.lit(None).cast(dated.schema[c].dataType) for c in ("window_start", "window_end")}
    return dated.unionByName(undated.withColumns(
        none | {"gap_rate": percent_of(F.col("missed"), F.col("total_events"))}))


def cdc_gap_dated_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """The gap figures per table and event-time window, of the events that have a time."""
    per_window = events.groupBy("table_name", F.window("event_ts", width).alias("w")).agg(*_gap_counts())
    return per_window.select(
        "table_name", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "total_events", "captured", "missed", percent_of(F.col("missed"), F.col("total_events")).alias("gap_rate"))


def cdc_gap_by_run_day(events: DataFrame, lookback_days: int = DEFAULT_LOOKBACK_HOURS // 24) -> DataFrame:
    """The look-back gap figures as each daily run would have seen them.

    A run at midnight covers the ``lookback_days`` days before it, and there is one run after
    every day with events. Events are counted per day first, so each one is read once and only
    day counts are repeated for the runs that include them. Events without a readable time count in every run of
    their table, as the look-back keeps them (with a NULL ``as_of`` if it has none).
    """
    day = F.col("event_ts").cast("date").alias("day")
    per_day = events.filter(F.col("event_ts").isNotNull()).groupBy("table_name", day).agg(*_gap_counts())
    age = F.explode(F.sequence(F.lit(1), F.lit(lookback_days))).alias("age")
    seen_by = per_day.select("*", age).withColumn("as_of", F.date_add("day", F.col("age")).cast("timestamp_ntz"))
    undated = events.filter(F.col("event_ts").isNull()).groupBy("table_name").agg(*_gap_counts())
    always = undated.join(seen_by.select("table_name", "as_of").distinct(), "table_name", "left").select(
        "table_name", "total_events", "captured", "missed", F.lit(None).cast("int").alias("age"), "as_of")
    seen_by = seen_by.drop("day").unionByName(always)
    return seen_by.groupBy("as_of", "table_name").agg(
        *[F.sum(c).alias(c) for c in ("total_events", "captured", "missed")],
        F.max(F.col("age") == 1).alias("follows_activity"),
    ).withColumn("gap_rate", percent_of(F.col("missed"), F.col("total_events")))
