"""A reconciliation run: table pairs and events in, evidence out, then issues and root causes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.config import DEFAULT_LOOKBACK_HOURS, TablePair
from driftwarden.operators import cdc, issues, root_cause, row_recon, schema_diff, value_diff
from driftwarden.session import materialize
from driftwarden.sources.catalog import column_catalog, raw_type


@dataclass
class Reconciliation:
    """Lazy plan of one run. Nothing executes until a result is read.

    Key columns of the tables and the event log are each scanned once for the evidence; all
    later results derive from its few rows. ``persisted()`` writes the evidence to the shared
    folder first, for runs that produce several reports.
    """

    spark: SparkSession
    pairs: Sequence[TablePair]
    events: DataFrame
    as_of: dt.datetime | None = None
    hours_back: int = DEFAULT_LOOKBACK_HOURS
    gap_summary: DataFrame | None = None
    checksum_scope: str = "key"

    @property
    def tables(self) -> list[str]:
        return [p.name for p in self.pairs]

    @cached_property
    def changes(self) -> DataFrame:
        return schema_diff.column_changes(column_catalog(self.spark, self.pairs))

    @cached_property
    def schema(self) -> DataFrame:
        return schema_diff.schema_diff(self.changes)

    @cached_property
    def recon(self) -> DataFrame:
        return row_recon.row_recon(self.pairs, self.checksum_scope)

    @cached_property
    def window_events(self) -> DataFrame:
        return cdc.filter_events(self.events, self.as_of, self.hours_back)

    @cached_property
    def gaps(self) -> DataFrame:
        return cdc.cdc_gap(self.window_events, self.tables, self.gap_summary)

    @cached_property
    def evidence(self) -> DataFrame:
        return issues.assemble_evidence(self.schema, self.recon, self.gaps, self.tables)

    def persisted(self) -> Reconciliation:
        self.__dict__["evidence"] = materialize(self.evidence, "evidence")
        return self

    @property
    def issues(self) -> DataFrame:
        return issues.recon_issues(self.evidence)

    @property
    def health(self) -> DataFrame:
        return issues.table_health(self.evidence)

    @property
    def score(self) -> DataFrame:
        return issues.health_score(self.health)

    @property
    def patterns(self) -> DataFrame:
        """Gap patterns of the look-back; those of a given summary win, like its figures."""
        return cdc.cdc_gap_patterns(self.window_events, self.gap_summary)

    def run_record(self, run_id: str, migration: str, started_at: dt.datetime) -> DataFrame:
        """The finished run as one row of the run history, from its issues."""
        return self.score.select(
            F.lit(run_id).alias("run_id"), F.lit(migration).alias("migration"), F.lit("recon_complete").alias("status"),
            F.lit(str(started_at)).cast("timestamp_ntz").alias("started_at"), "health_score", "issues_found")

    @property
    def findings(self) -> DataFrame:
        return root_cause.root_causes(self.evidence)

    def sampled_evidence(self, all_columns: bool = False) -> DataFrame:
        """Evidence with the extent and kind of the first drifted column of each table.

        Columns and their order are known from the schemas alone, so the plan holds exactly one
        comparison per table. ``all_columns`` also compares columns whose type did not change,
        which finds drift that the schema does not show, such as shifted clocks.
        """
        totals = []
        for pair in self.pairs:
            columns = sampling_columns(pair, all_columns)
            if columns:
                order = F.array(*[F.lit(c) for c in columns])
                totals.append(value_diff.sampled_totals(pair, columns).withColumn(
                    "step", F.array_position(order, F.col("column_name"))))
        if not totals:
            return self.evidence.selectExpr(
                "*", "CAST(NULL AS BIGINT) AS sample_affected", "CAST(NULL AS STRING) AS diff_type")
        first = reduce(DataFrame.unionByName, totals).filter("affected_rows > 0").groupBy("table_name").agg(
            F.min_by(F.struct("affected_rows", "diff_type"), "step").alias("first"))
        per_table = first.select(
            "table_name", F.col("first.affected_rows").alias("sample_affected"), "first.diff_type")
        return self.evidence.join(F.broadcast(per_table), "table_name", "left")  # one row per table


def sampling_columns(pair: TablePair, all_columns: bool = False) -> list[str]:
    """Columns of a pair to compare by value: changed types, columns the target lacks, then the rest if wanted."""
    source = {f.name: raw_type(f.dataType) for f in pair.source.schema}
    target = {f.name: raw_type(f.dataType) for f in pair.target.schema}
    changed = sorted(c for c in source if c in target and source[c] != target[c])
    missing = sorted(c for c in source if c not in target)
    rest = sorted(set(pair.shared_columns()) - set(changed)) if all_columns else []
    return changed + missing + rest
