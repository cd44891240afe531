"""Metrics hidden in the text of a task log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the log lines look like. (?d) keeps line ends to \n only.
FAILED_MARKS = ("State set to FAILED", "ERROR")
SKIPPED_MARK = "State set to SKIPPED"
ERROR_LINE = r"(?md)ERROR.*?$"
DURATION = r"(?id)duration:\s*([\d.]+)"
ROWS_EXTRACTED = r"(?d)Total rows extracted:\s*(\d+)"
ROWS_UPSERTED = r"(?d)rows_upserted.*?(\d+)"
PARTITIONS = r"(?id)partitions.*?(\d+)"
SHUFFLE_BYTES = r"(?id)shuffle.*?bytes.*?(\d+)"
FAILED_TASKS = r"(?id)failed tasks.*?(\d+)"


def _found(text: Column, pattern: str) -> Column:
    """First capture, or NULL (the built-in returns '' when nothing matches)."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _number(text: Column, pattern: str) -> Column:
    return _found(text, pattern).try_cast("bigint")


def last_match(text: Column, pattern: str, max_chars: int | None = None) -> Column:
    hit = F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))
    return hit if max_chars is None else F.substring(hit, 1, max_chars)


def parse_task_log(text: Column, error_chars: int | None = None) -> dict[str, Column]:
    """Named metric columns for a log text. ``error_chars`` cuts the error line, for reports with little room."""
    zero = F.lit(0).cast("bigint")
    failed = text.contains(FAILED_MARKS[0]) | text.contains(FAILED_MARKS[1])
    partitions = _number(text, PARTITIONS)

    def spark_metric(pattern: str) -> Column:
        return F.when(partitions.isNotNull(), F.coalesce(_number(text, pattern), zero))

    return {
        "status": F.when(text.contains(SKIPPED_MARK), "SKIPPED").when(failed, "FAILED").otherwise("SUCCESS"),
        "duration_seconds": F.coalesce(_found(text, DURATION).try_cast("double").cast("bigint"), zero),
        "records_processed": F.coalesce(_number(text, ROWS_UPSERTED), _number(text, ROWS_EXTRACTED), zero),
        "records_failed": zero,
        "error_message": F.when(failed, last_match(text, ERROR_LINE, error_chars)),
        "partitions": partitions,
        "shuffled_bytes": spark_metric(SHUFFLE_BYTES),
        "failed_tasks": spark_metric(FAILED_TASKS),
    }
