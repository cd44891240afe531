"""Moving tables from source to target: extract, transform, load."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftwarden.config import TABLES, TableSpec, Transform, load_levels
from driftwarden.operators.declared import require_declared
from driftwarden.operators.load import project_to_target, require_unique, write_overwrite, write_upsert
from driftwarden.operators.transforms import TRANSFORMS
from driftwarden.sources.local import small_frame
from driftwarden.sources.staging import read_stage, stage_extract


@dataclass
class TransformMetrics:
    table_name: str
    input_rows: int
    output_rows: int
    rows_filtered: int
    columns_in: int
    columns_out: int


def transform_table(name: str, staged: DataFrame, path: str,
                    transforms: Mapping[str, Transform] = TRANSFORMS) -> TransformMetrics:
    """Transform a staged table into ``path``; rows in and out are counted while it is written."""
    before, after = Observation(), Observation()
    rows = F.count(F.lit(1)).alias("rows")
    out = transforms[name](staged.observe(before, rows))
    out.observe(after, rows).write.mode("overwrite").parquet(path)
    rows_in, rows_out = before.get["rows"], after.get["rows"]
    return TransformMetrics(name, rows_in, rows_out, rows_in - rows_out, len(staged.columns), len(out.columns))


def transform_metrics_frame(spark: SparkSession, metrics: list[TransformMetrics]) -> DataFrame:
    return small_frame(
        spark, [tuple(asdict(m).values()) for m in metrics],
        "table_name STRING, input_rows BIGINT, output_rows BIGINT, rows_filtered BIGINT, columns_in INT, columns_out INT")


@dataclass
class TableRun:
    """What one migration run did with one table. Row counts stay None past a failed step."""

    table_name: str
    status: str = "SUCCESS"
    rows_extracted: int | None = None
    rows_transformed: int | None = None
    rows_loaded: int | None = None
    target_total: int | None = None
    method: str | None = None
    error: str | None = None
    target_path: str | None = None


class MigrationFailed(RuntimeError):
    def __init__(self, failed: list[str]):
        super().__init__(f"tables failed: {failed}")
        self.failed = failed


def run_migration(spark: SparkSession, read_source: Callable[[str], DataFrame], work_dir: str,
                  current: Mapping[str, DataFrame] | None = None,
                  tables: Mapping[str, TableSpec] = TABLES,
                  transforms: Mapping[str, Transform] = TRANSFORMS, parallel_tables: int = 4,
                  run_id: str | None = None, schemas: Mapping[str, str | StructType] | None = None) -> list[TableRun]:
    """Extract, transform and load every table, parents before children.

    Tables without a dependency on each other run side by side, so small ones do not leave the
    cluster idle. A table that fails at any step is recorded and does not stop the others. A batch that cannot be upserted
    because its columns do not fit the current table replaces it, with status REPLACED; any other error (a lost executor, a
    full disk, a repeated key) fails the table and leaves its last version alone. Each load writes a new version under
    ``work_dir/runs/<run_id>``; publish it when it is done. A run repeated under its ``run_id`` replaces its own files and
    upserts again; without one, every call is a run of its own. ``schemas`` declares source tables (``SOURCE_DDL``): one whose columns or
    types differ fails before it is read, one with a NULL in a column declared NOT NULL while it is staged.
    """
    current = current or {}
    work_dir = f"{work_dir}/runs/{run_id or uuid.uuid4().hex}"

    def migrate_table(name: str) -> TableRun:
        run, spec = TableRun(name), tables[name]
        try:
            source = read_source(name)
            if schemas and name in schemas:
                source = require_declared(source, schemas[name])
            run.rows_extracted = stage_extract(source, f"{work_dir}/staged/{name}")
            staged = read_stage(spark, f"{work_dir}/staged/{name}", source.schema)
            metrics = transform_table(name, staged, f"{work_dir}/transformed/{name}", transforms)
            run.rows_transformed = metrics.output_rows
            transformed = read_stage(spark, f"{work_dir}/transformed/{name}", transforms[name](staged).schema)
            batch = project_to_target(transformed, spec.target_columns)
            require_unique(batch, spec.key)
            _load(run, batch, current.get(name), spec.key, f"{work_dir}/target/{name}")
        except Exception as error:  # noqa: BLE001 - one table's failure must not stop the others
            run.status, run.error = "FAILED", f"{type(error).__name__}: {error}"
        return run

    with ThreadPoolExecutor(max_workers=parallel_tables) as pool:
        return [run for level in load_levels(dict(tables)) for run in pool.map(migrate_table, level)]


def _load(run: TableRun, batch: DataFrame, current: DataFrame | None, key: str, path: str) -> None:
    if current is not None:
        try:
            done = write_upsert(current, batch, key, f"{path}/upsert")
            run.rows_loaded, run.target_total = done["rows_upserted"], done["target_total"]
            run.method, run.target_path = "upsert", f"{path}/upsert"
            return
        except AnalysisException as error:  # raised before anything is read or written
            if not set(current.columns) - set(batch.columns):
                raise
            run.status, run.error = "REPLACED", f"upsert: {type(error).__name__}: {error}"
    done = write_overwrite(batch, f"{path}/overwrite")
    run.rows_loaded = run.target_total = done["rows_loaded"]
    run.method, run.target_path = done["method"], f"{path}/overwrite"


def migration_summary(spark: SparkSession, runs: list[TableRun]) -> DataFrame:
    """The run as a table: one row per migrated table."""
    return small_frame(
        spark, [(r.table_name, r.status, r.rows_extracted, r.rows_transformed, r.rows_loaded, r.target_total,
                 r.method, r.error) for r in runs],
        """table_name STRING, status STRING, rows_extracted BIGINT, rows_transformed BIGINT, rows_loaded BIGINT,
           target_total BIGINT, method STRING, error STRING""")


def migration_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("rows_extracted").alias("rows_extracted"), F.sum("rows_loaded").alias("rows_loaded"),
        F.count_if(F.col("status") == "FAILED").alias("failed_tables"),
        F.count_if(F.col("status") == "REPLACED").alias("replaced_tables"))


def raise_for_failures(runs: list[TableRun], allow_replaced: bool = False) -> None:
    """Raise if a table failed, or was replaced by a batch that lacks some of its columns, which drops the rows only it had."""
    bad = {"FAILED"} if allow_replaced else {"FAILED", "REPLACED"}
    failed = [r.table_name for r in runs if r.status in bad]
    if failed:
        raise MigrationFailed(failed)
