from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions import conversion as cv
from driftwarden.functions import labels
from driftwarden.functions.fingerprint import digest, portable_fingerprint, row_text
from driftwarden.functions.log_text import parse_task_log
from driftwarden.sources.catalog import format_type, raw_type


def value(spark, ddl, data, column):
    return spark.createDataFrame([data], ddl).select(column).first()[0]


@pytest.mark.parametrize(("flag", "expected"), [("Y", True), ("y", True), ("N", False), ("n", False), ("X", None), ("", None), (None, None)])
def test_char_to_boolean(spark, flag, expected):
    assert value(spark, "f STRING", (flag,), cv.char_to_boolean(F.col("f"))) is expected


def test_decimal_to_float_keeps_the_widened_value(spark):
    assert value(spark, "x DECIMAL(10,4)", (Decimal("12.3456"),), cv.decimal_to_float(F.col("x"))) == 12.345600128173828


@pytest.mark.parametrize(("text", "expected"), [("", None), ("   ", None), (None, None), ("\t", "\t"), (" a ", " a ")])
def test_empty_to_null(spark, text, expected):
    assert value(spark, "t STRING", (text,), cv.empty_to_null(F.col("t"))) == expected


@pytest.mark.parametrize(("status", "expected"), [("DEL", True), ("ACT", False), (None, False)])
def test_is_soft_deleted(spark, status, expected):
    assert value(spark, "s STRING", (status,), cv.is_soft_deleted(F.col("s"))) is expected


@pytest.mark.parametrize(("part", "base", "expected"), [(6, 25, 24.0), (1, 3, 33.33), (5, 0, 0.0), (-1, 4, -25.0), (1, 800, 0.12), (847, 47832, 1.77)])
def test_percent_of(spark, part, base, expected):
    assert value(spark, "p BIGINT, b BIGINT", (part, base), cv.percent_of(F.col("p"), F.col("b"))) == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_parse_iso_ts_is_utc_in_every_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        parse = cv.parse_iso_ts(F.col("t"))
        assert value(spark, "t STRING", ("2024-01-02T03:00:01Z",), parse) == dt.datetime(2024, 1, 2, 3, 0, 1)
        assert value(spark, "t STRING", ("2024-01-02T03:00:01+05:00",), parse) == dt.datetime(2024, 1, 1, 22, 0, 1)
        assert value(spark, "t STRING", ("yesterday",), parse) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(("column", "source", "target", "expected"), [
    ("notes", "", None, "NULL_EMPTY"),
    ("notes", "a", None, "MISSING_VALUE"),
    ("updated_ts", "2024", None, "MISSING_VALUE"),
    ("flag", "Y", "true", "TYPE_COERCION_BOOL"),
    ("flag", "N", "f", "TYPE_COERCION_BOOL"),
    ("flag", "y", "true", "VALUE_MISMATCH"),
    ("cost", "12.3456", "12.345600128173828", "FLOAT_ROUNDING"),
    ("cost", "1", "2", "VALUE_MISMATCH"),
    ("cost", "1.00", "1.01", "VALUE_MISMATCH"),
    ("updated_ts", "2024-01-01 00:00:00", "2024-01-01 05:00:00", "TZ_DRIFT"),
    ("parts", "a", "b", "TZ_DRIFT"),
    ("Event_TIMESTAMP", "a", "b", "TZ_DRIFT"),
    ("LAST_TS", "a", "b", "VALUE_MISMATCH"),
    ("name", None, "b", "VALUE_MISMATCH"),
])
def test_classify_diff(spark, column, source, target, expected):
    label = labels.classify_diff(column, F.col("s"), F.col("t"))
    assert value(spark, "s STRING, t STRING", (source, target), label) == expected


def test_classify_diff_uses_types_only_to_skip_rules(spark):
    typed = labels.classify_diff("unit_cost", F.col("s"), F.col("t"), T.DecimalType(10, 4), T.DoubleType())
    assert value(spark, "s DECIMAL(10,4), t DOUBLE", (Decimal("1.2345"), 1.2344999), typed) == "FLOAT_ROUNDING"
    flag = labels.classify_diff("flag", F.col("s"), F.col("t"), T.StringType(), T.BooleanType())
    assert value(spark, "s STRING, t BOOLEAN", ("Y", True), flag) == "TYPE_COERCION_BOOL"


@pytest.mark.parametrize(("source", "target", "expected"), [
    ("character varying", "boolean", "TYPE_COERCION_BOOL"), ("character(1)", "boolean", "TYPE_COERCION_BOOL"),
    ("numeric(10,4)", "double precision", "FLOAT_ROUNDING"), ("numeric(10,4)", "real", "TYPE_COERCION_BOOL"),
    ("timestamp without time zone", "timestamp with time zone", "TZ_DRIFT"), ("integer", "bigint", "TYPE_COERCION_BOOL")])
def test_mismatch_type_of(spark, source, target, expected):
    assert value(spark, "s STRING, t STRING", (source, target), labels.mismatch_type_of(F.col("s"), F.col("t"))) == expected


@pytest.mark.parametrize(("score", "report", "dashboard", "modal"), [
    (0, "CRITICAL", "CRITICAL", "CRITICAL"), (19, "CRITICAL", "CRITICAL", "CRITICAL"), (20, "AT RISK", "SEVERE", "CRITICAL"),
    (39, "AT RISK", "SEVERE", "CRITICAL"), (40, "AT RISK", "DEGRADED", "WARNING"), (59, "AT RISK", "DEGRADED", "WARNING"),
    (60, "HEALTHY", "DEGRADED", "WARNING"), (69, "HEALTHY", "DEGRADED", "WARNING"), (70, "HEALTHY", "HEALTHY", "HEALTHY"),
    (100, "HEALTHY", "HEALTHY", "HEALTHY")])
def test_score_band(spark, score, report, dashboard, modal):
    got = [value(spark, "s INT", (score,), labels.score_band(F.col("s"), scheme)) for scheme in ("report", "dashboard", "modal")]
    assert got == [report, dashboard, modal]


def test_small_labels(spark):
    df = spark.createDataFrame([(0.94, 101, "HEALTHY", "P3")], "conf DOUBLE, missed INT, cause STRING, pri STRING")
    got = df.select(labels.confidence_pct(F.col("conf")), labels.cdc_risk(F.col("missed")), labels.cdc_risk(F.lit(1)),
                    labels.cdc_risk(F.lit(0)), labels.finding_status(F.col("cause"), F.col("pri")),
                    labels.finding_severity(F.lit("X"), F.lit("P3"))).first()
    assert tuple(got) == ("94%", "HIGH", "LOW", "NONE", "HEALTHY", "info")


@pytest.mark.parametrize(("dtype", "full", "raw"), [
    (T.DecimalType(10, 4), "numeric(10,4)", "numeric"), (T.DecimalType(10, 0), "numeric", "numeric"),
    (T.StringType(), "character varying", "character varying"), (T.VarcharType(9), "character varying(9)", "character varying"),
    (T.CharType(1), "character(1)", "character"), (T.DoubleType(), "double precision", "double precision"),
    (T.TimestampNTZType(), "timestamp without time zone", "timestamp without time zone"), (T.LongType(), "bigint", "bigint")])
def test_type_names(dtype, full, raw):
    assert (format_type(dtype), raw_type(dtype)) == (full, raw)


def test_row_text_tells_null_empty_and_n_apart(spark):
    df = spark.createDataFrame([(None,), ("",), ("n",)], "a STRING")
    assert df.select(row_text([F.col("a")])).distinct().count() == 3


def test_digest_tells_null_positions_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", ""), ("", "a"), (None, None), ("", "")], "x STRING, y STRING")
    assert df.select(digest([F.col("x"), F.col("y")])).distinct().count() == 6


def test_fingerprint_ignores_order_and_partitioning_but_not_repeats(spark):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    print_of = lambda df: df.agg(portable_fingerprint(F.col("k"))).first()[0]
    assert print_of(keys) == print_of(keys.repartition(7)) == print_of(keys.orderBy(F.desc("k")))
    assert print_of(keys) != print_of(keys.union(keys.filter("k IN ('1', '2')")))
    assert print_of(keys.limit(0)) == 0


def parsed(spark, text):
    return spark.createDataFrame([(text,)], "t STRING").select(
        *[c.alias(n) for n, c in parse_task_log(F.col("t")).items()]).first().asDict()


def test_parse_task_log_success(spark):
    got = parsed(spark, "duration: 12.9\nTotal rows extracted: 92\npartitions: 4\nshuffle read bytes: 24576\n")
    assert got == {"status": "SUCCESS", "duration_seconds": 12, "records_processed": 92, "records_failed": 0,
                   "error_message": None, "partitions": 4, "shuffled_bytes": 24576, "failed_tasks": 0}


def test_parse_task_log_failure_keeps_the_last_error_line(spark):
    got = parsed(spark, "ERROR one\r\nok\nERROR two " + "x" * 600 + "\nState set to FAILED\n")
    assert got["status"] == "FAILED" and got["error_message"].startswith("ERROR two") and len(got["error_message"]) == 610
    assert got["partitions"] is None and got["shuffled_bytes"] is None


def test_parse_task_log_precedence(spark):
    assert parsed(spark, "ERROR x\nState set to SKIPPED")["status"] == "SKIPPED"
    assert parsed(spark, "ERROR x\nState set to SKIPPED")["error_message"] == "ERROR x"
    assert parsed(spark, "Total rows extracted: 5\nrows_upserted: 19")["records_processed"] == 19
    assert parsed(spark, "rows_upserted:\n19 Total rows extracted: 5")["records_processed"] == 5
    assert parsed(spark, "DURATION: 7")["duration_seconds"] == 7
    assert parsed(spark, "")["status"] == "SUCCESS"
    assert parsed(spark, "State set to FAILED")["error_message"] is None
