"""Change-event logs and their precomputed gap summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.functions.conversion import parse_iso_ts
from driftwarden.schemas import EVENT_DDL, GAP_SUMMARY_DDL


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "table_name", "operation", parse_iso_ts(F.col("timestamp")).alias("event_ts"),
        "primary_key", "updated_by", "before", "after", "captured", "gap_reason")


def read_cdc_events(spark: SparkSession, path: str, document: bool = False, skip_corrupt: bool = False) -> DataFrame:
    """Change events as rows, one JSON object per line (the form that splits across tasks).

    ``document=True`` reads exports that hold a single JSON document with an ``events`` array. A line that is no JSON
    object of events fails the read; ``skip_corrupt=True`` leaves such lines to ``read_corrupt_lines`` instead.
    """
    if skip_corrupt:
        if document:
            raise ValueError("a single document is either whole or corrupt")
        return _event_columns(_parsed_lines(spark, path).where("_corrupt_record IS NULL"))
    if document:
        fields = ", ".join(f.strip().replace(" ", ": ") for f in EVENT_DDL.split(","))
        raw = spark.read.schema(f"events ARRAY<STRUCT<{fields}>>").option("mode", "FAILFAST").option("multiLine", True).json(path).select(F.inline("events"))
    else:
        raw = spark.read.schema(EVENT_DDL).option("mode", "FAILFAST").json(path)
    return _event_columns(raw)


def _parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{EVENT_DDL}, _corrupt_record STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, options).alias("e")).select("e.*")


def read_corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line)``: the lines of an event log that hold no whole event."""
    return _parsed_lines(spark, path).where("_corrupt_record IS NOT NULL").select(F.col("_corrupt_record").alias("line"))


def write_cdc_events(events: DataFrame, path: str) -> None:
    """Write events as JSON lines with ISO-8601 timestamps, the format ``read_cdc_events`` reads."""
    iso = F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    events.withColumn("timestamp", iso).drop("event_ts").write.mode("overwrite").json(path)


def read_cdc_summary(spark: SparkSession, path: str) -> DataFrame:
    """Precomputed gap figures, one row per table, from a summary document."""
    schema = f"gap_analysis MAP<STRING, {GAP_SUMMARY_DDL}>"
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    return document.select(F.explode("gap_analysis").alias("table_name", "gap")).select("table_name", "gap.*")
