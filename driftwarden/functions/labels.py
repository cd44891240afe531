"""Labels, bands and message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from driftwarden.config import BAND_ADVICE
from driftwarden.functions.names import orderable

ROUNDING_TOLERANCE = 0.01  # fixed value


def values_differ(source: Column, target: Column, source_type: DataType, target_type: DataType) -> Column:
    """NULL-safe inequality. Equal types compare natively, different types by their text."""
    if source_type == target_type:
        return ~orderable(source, source_type).eqNullSafe(orderable(target, target_type))
    return ~source.cast("string").eqNullSafe(target.cast("string"))


def _as_double(value: Column, dtype: DataType) -> Column | None:
    if isinstance(dtype, NumericType):
        return value.cast("double")
    return value.try_cast("double") if isinstance(dtype, StringType) else None


def classify_diff(column: str, source: Column, target: Column,
                  source_type: DataType | None = None, target_type: DataType | None = None) -> Column:
    """Name the kind of difference between two values already known to differ.

    The first rule that applies wins: lost value (empty or not), Y/N against boolean, numbers
    within the rounding tolerance, clock columns by name, any other difference. The types
    only skip rules that cannot apply; both default to text.
    """
    source_type = source_type or StringType()
    target_type = target_type or StringType()
    lost = source.isNotNull() & target.isNull()
    label = F.when(lost & (source.cast("string") == ""), "NULL_EMPTY").when(lost, "MISSING_VALUE")
    if isinstance(source_type, StringType) and isinstance(target_type, (StringType, BooleanType)):
        flags = source.isin("Y", "N") & target.cast("string").isin("true", "false", "t", "f")
        label = label.when(flags, "TYPE_COERCION_BOOL")
    left, right = _as_double(source, source_type), _as_double(target, target_type)
    if left is not None and right is not None:
        label = label.when(F.abs(left - right) < ROUNDING_TOLERANCE, "FLOAT_ROUNDING")
    is_clock = "ts" in column or "timestamp" in column.lower()
    return label.otherwise("TZ_DRIFT" if is_clock else "VALUE_MISMATCH")


def mismatch_type_of(source_type: Column, target_type: Column) -> Column:
    """Kind of a column type change, from the two SQL type names."""
    to_float = target_type.contains("float") | target_type.contains("double")
    clocks = source_type.contains("timestamp") & target_type.contains("timestamp")
    return (
        F.when(source_type.startswith("character") & (target_type == "boolean"), "TYPE_COERCION_BOOL")
        .when(source_type.contains("numeric") & to_float, "FLOAT_ROUNDING")
        .when(clocks & (source_type != target_type), "TZ_DRIFT")
        .otherwise("TYPE_COERCION_BOOL")
    )


# For each scheme, (upper score limit exclusive, label), last label above all limits.
SCORE_BANDS: dict[str, tuple[tuple[int, str], ...]] = {
    "report": ((20, "CRITICAL"), (60, "AT RISK"), (101, "HEALTHY")),
    "dashboard": ((20, "CRITICAL"), (40, "SEVERE"), (70, "DEGRADED"), (101, "HEALTHY")),
    "modal": ((40, "CRITICAL"), (70, "WARNING"), (101, "HEALTHY")),
}


def score_band(score: Column, scheme: str = "report") -> Column:
    *lower, (_, top) = SCORE_BANDS[scheme]
    band = F.when(score.isNull(), F.lit(None).cast("string"))
    for limit, label in lower:
        band = band.when(score < limit, label)
    return band.otherwise(top)


def recommendation(band: Column) -> Column:
    pairs = [F.lit(x) for item in BAND_ADVICE.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[band], F.lit(BAND_ADVICE["CRITICAL"]))


def confidence_pct(confidence: Column) -> Column:
    return F.concat(F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%"))


def percent_text(pct: Column) -> Column:
    return F.concat(pct.cast("string"), F.lit("%"))


def cdc_risk(missed: Column) -> Column:
    return F.when(missed > 100, "HIGH").when(missed > 0, "LOW").otherwise("NONE")


def finding_status(root_cause: Column, priority: Column) -> Column:
    return F.when(root_cause == "HEALTHY", "HEALTHY").when(priority == "P1", "CRITICAL").otherwise("WARNING")


def finding_severity(root_cause: Column, priority: Column) -> Column:
    """Display severity of a finding."""
    return (
        F.when(root_cause == "HEALTHY", "healthy").when(priority == "P1", "critical")
        .when(priority == "P2", "warning").otherwise("info")
    )


def schema_severity_display(missing: Column, mismatched: Column, severity: Column) -> Column:
    return (
        F.when((missing == 0) & (mismatched == 0), "healthy")
        .when(severity == "CRITICAL", "critical").otherwise("warning")
    )


def recon_severity_display(row_status: Column, delta_pct: Column) -> Column:
    return F.when(row_status == "MATCH", "healthy").when(delta_pct > 5, "critical").otherwise("warning")


def cdc_severity_display(missed: Column) -> Column:
    return F.when(missed == 0, "healthy").otherwise("critical")


SEVERITY_RANK = ("HEALTHY", "WARNING", "CRITICAL")


def severity_rank(status: Column) -> Column:
    """Position in ``SEVERITY_RANK``, so that ``max`` picks the worst status."""
    return F.when(status == "CRITICAL", 2).when(status == "WARNING", 1).otherwise(0)


def status_of_rank(rank: Column) -> Column:
    return F.when(rank == 2, "CRITICAL").when(rank == 1, "WARNING").otherwise("HEALTHY")


# Message texts; the wording is fixed.
def missing_column_detail(column: Column, dtype: Column) -> Column:
    return F.format_string("Column '%s' (%s) missing in target", column, dtype)


def type_mismatch_detail(column: Column, source_type: Column, target_type: Column) -> Column:
    return F.format_string("Column '%s': source=%s target=%s", column, source_type, target_type)


def extra_column_detail(column: Column, dtype: Column) -> Column:
    return F.format_string("Column '%s' (%s) only in target", column, dtype)


def row_mismatch_detail(source: Column, target: Column, delta: Column, pct: Column) -> Column:
    return F.format_string("source=%d target=%d delta=%d (%s%%)", source, target, delta, pct.cast("string"))


def cdc_gap_detail(missed: Column, rate: Column) -> Column:
    return F.format_string("%d events missed (%s%% gap rate)", missed, rate.cast("string"))
