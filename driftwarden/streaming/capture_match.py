"""The stream of source changes matched with the stream of captured events, so that a change that is never captured shows.

A change and an event belong together if table and event id agree and the event is captured no earlier than the change and
no later than ``within`` after it. A change without one is reported as MISSED once that time has passed on both streams, as
their watermarks tell; until then it is pending and not reported. State holds what may still be matched: changes and events
of about the last ``within`` plus ``lateness`` of event time. What arrives later than the watermark is not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwarden.streaming.gap_stream import utc_instant, utc_time

MATCHED, MISSED = "MATCHED", "MISSED"
RESULT = ("table_name", "event_id", "event_ts", "captured_ts", "status")


def _interval(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def _sides(changes: DataFrame, captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (changes.select("table_name", "event_id", utc_instant(F.col("event_ts")).alias("changed_at")),
            captured.select(F.col("table_name").alias("captured_table"), F.col("event_id").alias("captured_id"),
                            utc_instant(F.col("captured_ts")).alias("captured_at")))


def _joined(left: DataFrame, right: DataFrame, within: str) -> DataFrame:
    same = (F.col("table_name") == F.col("captured_table")) & (F.col("event_id") == F.col("captured_id"))
    in_time = (F.col("captured_at") >= F.col("changed_at")) & (F.col("captured_at") <= F.col("changed_at") + _interval(within))
    return left.join(right, same & in_time, "left_outer").withColumn(
        "status", F.when(F.col("captured_at").isNull(), MISSED).otherwise(MATCHED))


def _with_times(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"event_ts": utc_time("changed_at"), "captured_ts": utc_time("captured_at")}).select(*RESULT)


def match_stream(changes: DataFrame, captured: DataFrame, within: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Changes (table_name, event_id, event_ts) with their captured events (table_name, event_id, captured_ts), of two streams.

    One row per change and event; a change that was captured twice in time has two. Changes without a time are neither
    matched nor reported: count them before.
    """
    left, right = _sides(changes.where(F.col("event_ts").isNotNull()), captured.where(F.col("captured_ts").isNotNull()))
    return _joined(left.withWatermark("changed_at", lateness), right.withWatermark("captured_at", lateness), within)


def write_matches(matches: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append finished rows under ``path``. The sink's log and the checkpoint make a restart write each row once."""
    writer = matches.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return _with_times(spark.read.parquet(path))


def match_batch(changes: DataFrame, captured: DataFrame, within: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """The batch twin of ``match_stream`` over all that has arrived: what the stream has reported when it has read the same rows.

    The watermark is the lesser of the latest times of both sides, less ``lateness``; changes whose time to be captured has not
    passed by then are pending, as in the stream.
    """
    left, right = _sides(changes.where(F.col("event_ts").isNotNull()), captured.where(F.col("captured_ts").isNotNull()))
    last = [df.agg(F.max(c)).scalar() for df, c in ((left, "changed_at"), (right, "captured_at"))]
    rows = _joined(left, right, within)
    passed = (F.col("changed_at") + _interval(within) < last[0] - _interval(lateness)) & (
        F.col("changed_at") + _interval(within) < last[1] - _interval(lateness))
    return _with_times(rows.where((F.col("status") == MATCHED) | passed))


def match_counts(matches: DataFrame) -> DataFrame:
    """Matches and misses per table, and the longest time to capture in seconds."""
    lag = F.timestamp_diff("SECOND", F.col("event_ts"), F.col("captured_ts"))
    return matches.groupBy("table_name").agg(
        F.count_if(F.col("status") == MATCHED).alias("matched"), F.count_if(F.col("status") == MISSED).alias("missed"),
        F.max(lag).alias("longest_lag"))
