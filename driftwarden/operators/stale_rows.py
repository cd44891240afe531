"""Stale rows: every row of a table held against the change log as of the row's own time.

Rows and events are dealt together to written ranges of (key, time), so the events of one key may fill any number of tasks. Inside
a range the last event is carried forward to the rows. A key that goes on in other ranges is the first or the last of its range, so
what crosses the borders are at most two lines a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.functions.conversion import percent_of
from driftwarden.functions.names import quoted
from driftwarden.operators.cdc import captured_flag
from driftwarden.session import materialize

_EVENT = "struct<event_ts:timestamp_ntz,event_id:string>"


def _dealt(rows: DataFrame, events: DataFrame, key: str, time: str) -> DataFrame:
    """Dated rows and events, in the order of key, time and kind (events of the same time first), with their ``range__``."""
    k = F.col(quoted(key))
    log = events.where("primary_key IS NOT NULL AND event_ts IS NOT NULL").select(
        F.col("primary_key").cast("string").alias("place"), F.col("event_ts").cast("timestamp_ntz").alias("at"), F.lit(0).alias("kind"),
        F.struct(F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), F.col("event_id").cast("string").alias("event_id")).alias("event"),
        captured_flag().alias("captured"), F.lit(None).cast(rows.schema[key].dataType).alias("key"), F.lit(0).cast("bigint").alias("spread"))
    held = rows.where(k.isNotNull() & F.col(quoted(time)).isNotNull()).select(
        k.cast("string").alias("place"), F.col(quoted(time)).cast("timestamp_ntz").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast(_EVENT).alias("event"), F.lit(None).cast("boolean").alias("captured"), k.alias("key"),
        F.monotonically_increasing_id().alias("spread"))  # rows alike in key and time may fill several ranges
    dealt = log.unionByName(held).repartitionByRange("place", "at", "kind", "event", "spread").drop("spread")
    return materialize(dealt.withColumn("range__", F.spark_partition_id()), "rows-and-events")


def _borders(dealt: DataFrame) -> DataFrame:
    """For the first and the last key of each range: its events in earlier ranges and in all of them."""
    ends = dealt.groupBy("range__").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    edge = dealt.join(F.broadcast(ends), "range__").where("place IN (lo, hi)").groupBy("place", "range__").agg(
        F.max("event").alias("last"), F.count("event").alias("n"), F.count_if("captured").alias("got"))
    whole = Window.partitionBy("place")  # over ranges, not rows
    before = whole.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(edge.select(
        "place", "range__", F.max("last").over(before).alias("before_last"), F.sum("n").over(before).alias("before_n"),
        F.sum("got").over(before).alias("before_got"), F.max("last").over(whole).alias("newest"), F.sum("n").over(whole).alias("all_n"),
        F.sum("got").over(whole).alias("all_got")), "borders")


def verdict(event: Column, later: Column, later_captured: Column) -> Column:
    """What the log says of a row whose last event is ``event`` and which is followed by ``later`` events."""
    return (F.when((later > 0) & (later_captured == 0), "NEVER_CAPTURED").when(later > 0, "LAGGING")
            .when(event.isNull(), "NO_EVENTS").otherwise("CURRENT"))


def stale_rows(rows: DataFrame, events: DataFrame, key: str, time: str) -> DataFrame:
    """Every row with the last event before its time, and whether the log has gone on since.

    ``(key, row_ts, event_ts, event_id, later_events, later_captured, behind_seconds, verdict)``, one line per row, repeated rows
    included. An event at the row's time is before it; of events at one time the largest id is the last. Verdicts: ``CURRENT``
    (no later event), ``LAGGING`` (later events, of which some were captured), ``NEVER_CAPTURED`` (later events, none captured),
    ``NO_EVENTS`` (the log never mentions the key), ``UNDATED`` (no key or no time). ``behind_seconds`` reaches to the newest event.
    Events without a key or a time take no part.
    """
    dealt = _dealt(rows, events, key, time)
    here = Window.partitionBy("range__", "place")
    upto = here.orderBy("at", "kind", "event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = dealt.select(
        "*", F.max("event").over(upto).alias("own_last"), F.count("event").over(upto).alias("own_n"), F.count_if("captured").over(upto).alias("own_got"),
        F.max("event").over(here).alias("here_newest"), F.count("event").over(here).alias("here_n"), F.count_if("captured").over(here).alias("here_got"),
    ).where("kind = 1")
    held = counted.join(F.broadcast(_borders(dealt)), ["range__", "place"], "left")
    zero = F.lit(0).cast("bigint")
    event, newest = F.coalesce("own_last", "before_last"), F.coalesce("newest", "here_newest")
    later = F.coalesce("all_n", "here_n") - F.coalesce("before_n", zero) - F.col("own_n")
    got = F.coalesce("all_got", "here_got") - F.coalesce("before_got", zero) - F.col("own_got")
    found = held.select(
        "key", F.col("at").alias("row_ts"), event.getField("event_ts").alias("event_ts"), event.getField("event_id").alias("event_id"),
        later.alias("later_events"), got.alias("later_captured"),
        F.when(later > 0, F.timestamp_diff("SECOND", F.col("at"), newest.getField("event_ts"))).alias("behind_seconds"),
        verdict(event, later, got).alias("verdict"))
    k, ts = F.col(quoted(key)), F.col(quoted(time)).cast("timestamp_ntz")
    undated = rows.where(k.isNull() | ts.isNull()).select(
        k.alias("key"), ts.alias("row_ts"), F.lit(None).cast("timestamp_ntz").alias("event_ts"), F.lit(None).cast("string").alias("event_id"),
        zero.alias("later_events"), zero.alias("later_captured"), F.lit(None).cast("bigint").alias("behind_seconds"), F.lit("UNDATED").alias("verdict"))
    return found.unionByName(undated)


def stale_counts(stale: DataFrame, *by: str) -> DataFrame:
    """Per verdict (and the columns ``by``): rows, their share of all in percent, and the longest delay."""
    counts = stale.groupBy(*by, "verdict").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("later_events").alias("later_events"), F.max("behind_seconds").alias("longest_seconds"))
    total = F.sum("row_count").over(Window.partitionBy(*by))  # over verdicts, not rows
    return counts.withColumn("share_pct", percent_of(F.col("row_count"), total))
