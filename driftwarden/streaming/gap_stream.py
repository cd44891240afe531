"""Capture gaps per event-time window over a stream of change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from driftwarden.functions.conversion import percent_of
from driftwarden.operators.cdc import cdc_gap_dated_windows

RESULT = ("table_name", "window_start", "window_end", "total_events", "captured", "missed", "gap_rate")


def utc_instant(ntz: Column) -> Column:
    """The instant of a zone-less time in UTC, whatever the session's zone; daylight-saving changes do not touch it."""
    return F.concat(ntz.cast("string"), F.lit("Z")).cast("timestamp")


def utc_time(instant: str) -> Column:
    """The zone-less UTC time of an instant, by arithmetic on its microseconds."""
    seconds = f"CAST(CAST(unix_micros({instant}) AS DECIMAL(20, 0)) / 1000000 AS DECIMAL(18, 6))"
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})")


def stream_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None,
                  file_format: str = "parquet") -> DataFrame:
    """Event files as a stream."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def cdc_gap_stream(events: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """The streaming twin of ``cdc_gap_windowed``.

    State is one row per table and open window; events later than the watermark are dropped.
    Watermarks need an instant, hence the conversion from the zone-less event time. Events without a time have no window.
    """
    timed = events.withColumn("event_ts", utc_instant(F.col("event_ts"))).withWatermark("event_ts", watermark)
    return cdc_gap_dated_windows(timed, width)


def write_gap_updates(gaps: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each trigger's changed windows under ``path``.

    Every trigger owns the directory of its batch id and replaces it when it is retried, so a
    restart after a lost executor or driver leaves no duplicates.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = gaps.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_gap_windows(spark: SparkSession, path: str) -> DataFrame:
    """The latest figures of every window from the written updates."""
    updates = spark.read.parquet(path)
    newest = updates.groupBy("table_name", "window_start", "window_end").agg(*[
        F.max_by(c, "batch_id").alias(c) for c in ("total_events", "captured", "missed")])
    rate = percent_of(F.col("missed"), F.col("total_events"))
    return newest.withColumns({
        "gap_rate": rate,
        "window_start": utc_time("window_start"),
        "window_end": utc_time("window_end"),
    }).select(*RESULT)
