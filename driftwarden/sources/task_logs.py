"""Task log files laid out as ``{dag}/{task}/{run}/{attempt}.log``."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from driftwarden.session import scratch_path
from driftwarden.sources.local import small_frame

LOG_FOLDERS = ("dag_id", "task_id", "run_id")
FILES_PER_TASK = 5000  # written or read by one task
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20  # rows and bytes that a task holds before it hands them on
SCAN_TASKS = 256  # read by no more tasks, or by four a core: a split holds few files, however small they are
PLAIN = (".log", ".txt")  # the text source may unpack files of other names


def _path_parts() -> dict[str, Column]:
    parts = F.split(F.col("_metadata.file_path"), "/")

    def part(position: int) -> Column:  # the path is percent-encoded but keeps a plus as it is
        return F.url_decode(F.replace(F.element_at(parts, position), F.lit("+"), F.lit("%2B")))

    return {"dag_id": part(-4), "task_id": part(-3), "run_id": part(-2), "file_name": part(-1),
            "modified_at": F.col("_metadata.file_modification_time")}


def _folder(base: str, *names: str | None) -> str:
    """The listed folder: the given names lead into it as far as they go without a gap."""
    folder = base.rstrip("/")
    for name in names:
        if name is None:
            break
        folder += f"/{name}"
    return folder


def scan_task_logs(spark: SparkSession, base: str, dag: str | None = None, task: str | None = None,
                   run: str | None = None, suffix: str = ".log", paths: Sequence[str] | None = None) -> DataFrame:
    """One row per log file with its whole text. A log file is one task attempt, so it fits a row.

    Given names narrow the listed folder as far as they lead without a gap, and filter below it.
    Folders are listed, not globbed, because run names often hold colons. ``paths``, as ``list_task_logs``
    gives them, leaves all other files unopened.
    """
    folder, named = _folder(base, dag, task, run), [(c, n) for c, n in zip(LOG_FOLDERS, (dag, task, run)) if n is not None]
    plain = paths is None and suffix.endswith(PLAIN)
    mounted = _mounted(spark, folder) if plain and not re.search(r"[*?\[\]{}\\]", folder + suffix) else None
    if mounted and os.path.isdir(mounted):
        return _scan_mounted(spark, mounted, suffix, named)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    if plain:  # many files: the same bytes, opened in less time
        files, text = reader.format("binaryFile").load(folder), F.col("content").cast("string")
    else:
        files, text = reader.text(folder, wholetext=True), F.col("value")
    if paths is not None:
        files = files.filter(F.col("_metadata.file_path").isin(*paths))
    logs = files.select(*[c.alias(n) for n, c in _path_parts().items()], text.alias("log_text"))
    for column, name in named:
        logs = logs.filter(F.col(column) == name)
    return logs.coalesce(max(SCAN_TASKS, 4 * spark.sparkContext.defaultParallelism))


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the folders hold, without the names that Spark's readers pass over."""
    def listed(paths: list[bytes], folders: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(folders, pa.bool_())], ["path", "is_folder"])

    paths, folders = [], []
    for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
        with os.scandir(folder) as entries:
            for entry in entries:
                name = entry.name
                if name.startswith(b".") or name.startswith(b"_") and b"=" not in name or name.endswith(b"._COPYING_"):
                    continue
                if (is_folder := entry.is_dir()) or entry.is_file():
                    paths.append(entry.path)
                    folders.append(is_folder)
                if len(paths) >= 10 * BATCH_ROWS:
                    yield listed(paths, folders)
                    paths, folders = [], []
    yield listed(paths, folders)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the time, in microseconds, and the bytes of the file at ``path``."""
    for batch in batches:
        paths, start, size, times, contents = batch.column("path").to_pylist(), 0, 0, [], []
        for n, path in enumerate(paths, 1):
            with open(path, "rb") as file:
                times.append(os.fstat(file.fileno()).st_mtime_ns // 1_000_000 * 1000)  # whole milliseconds, as Spark's readers tell
                contents.append(file.read())
            size += len(contents[-1])
            if n == len(paths) or n - start >= BATCH_ROWS or size >= BATCH_BYTES:
                own = batch.slice(start, n - start)
                columns = [*own.columns, pa.array(times, pa.int64()), pa.array(contents, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*own.schema.names, "modified", "content"])
                start, size, times, contents = n, 0, [], []


def _scan_mounted(spark: SparkSession, folder: str, suffix: str, named: Sequence[tuple[str, str]]) -> DataFrame:
    """``scan_task_logs`` of a folder that Python opens.

    Spark's readers hold a list of all files in the driver. Here, tasks list the folders, level by level, into written
    lists and then read the files, so the driver knows the number of files only.
    """
    def tasks(n: int) -> int:
        return max(spark.sparkContext.defaultParallelism, n // FILES_PER_TASK)

    level, n, listed = small_frame(spark, [(os.fsencode(folder),)], "path BINARY"), 1, scratch_path(spark, "log-list")
    depth = 0
    while n:
        found = level.repartition(tasks(n)).mapInArrow(_list_folders, "path BINARY, is_folder BOOLEAN")
        lines = found.select(F.concat(F.when(F.col("is_folder"), "d").otherwise("f"), F.hex("path")))  # packed files are not split
        lines.write.option("compression", "gzip").text(f"{listed}/level={depth}")
        level = spark.read.text(f"{listed}/level={depth}").filter("value LIKE 'd%'").select(F.unhex(F.substring("value", 2, 2**31 - 1)).alias("path"))
        n, depth = level.count(), depth + 1
    files = spark.read.text([f"{listed}/level={i}" for i in range(depth)]).filter("value LIKE 'f%'")
    files = files.select(F.unhex(F.substring("value", 2, 2**31 - 1)).alias("path"))
    parts = F.split(F.concat(F.lit("file://"), F.col("path").cast("string")), "/")
    names = {c: F.element_at(parts, i) for c, i in zip((*LOG_FOLDERS, "file_name"), (-4, -3, -2, -1))}
    files = files.select("path", *[c.alias(n) for n, c in names.items()])
    files = files.filter(F.endswith("file_name", F.lit(suffix)))
    for column, name in named:
        files = files.filter(F.col(column) == name)
    columns = ", ".join(f"{c} STRING" for c in names)
    read = files.repartition(tasks(files.count())).mapInArrow(_read_files, f"path BINARY, {columns}, modified BIGINT, content BINARY")
    read = read.filter(F.octet_length("content") > 0)  # Spark's readers give no row for an empty file
    return read.select(*names, F.timestamp_micros("modified").alias("modified_at"), F.col("content").cast("string").alias("log_text"))


def list_task_logs(spark: SparkSession, base: str, dag: str | None = None, suffix: str = ".log") -> DataFrame:
    """One row per log file with its ``file_path`` and without its text. File names and times only: no file is opened."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
        .load(_folder(base, dag))
    )
    return files.select(*[c.alias(n) for n, c in _path_parts().items()], F.col("_metadata.file_path").alias("file_path"))


def _mounted(spark: SparkSession, base: str) -> str | None:
    """The folder as Python opens it, if it is local or mounted on all machines."""
    scheme, folder = re.fullmatch(r"(?:(\w+):(?=/))?(?://(?=/))?(.*)", base).groups()
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    return os.path.abspath(folder) if (scheme or default.split(":")[0]) == "file" else None


def _folder_value(value: str | None) -> str:
    """A folder's value as Spark's own writer spells it."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)


def _log_writer(base: str) -> Callable[[Iterable[Row]], None]:
    def write(rows: Iterable[Row]) -> None:
        task = TaskContext.get()
        made = set()
        for n, row in enumerate(rows):
            folder = "/".join([base, *[f"{c}={_folder_value(row[c])}" for c in LOG_FOLDERS]])
            if folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            name = f"part-{task.partitionId():05d}-{n}.txt"  # the same in each attempt, which meets the same rows
            hidden = f"{folder}/.{name}.{task.taskAttemptId()}"
            with open(hidden, "wb") as file:
                file.write(bytes(row["log_text"] or b"") + b"\n")
            os.replace(hidden, f"{folder}/{name}")

    return write


def write_task_logs(logs: DataFrame, base: str) -> None:
    """A ``.txt`` file per log in folders of ``dag_id``, ``task_id`` and ``run_id`` named as ``partitionBy`` does.

    Spark's writer starts a process (``chmod``) for every file of a local or mounted file system, which costs
    far more than the file. There, tasks write the files themselves; elsewhere Spark's writer does.
    """
    tasks = max(logs.sparkSession.sparkContext.defaultParallelism, logs.count() // FILES_PER_TASK)
    spread = logs.select(*LOG_FOLDERS, "log_text").repartition(tasks)
    folder = _mounted(logs.sparkSession, base)
    if folder is None:
        spread.write.option("maxRecordsPerFile", 1).partitionBy(*LOG_FOLDERS).text(base)
        return
    os.makedirs(folder)  # an archive without any log is a folder, too; one that is there is not added to
    columns = [F.col(c).cast("string").alias(c) for c in LOG_FOLDERS]
    spread.select(*columns, F.col("log_text").cast("binary").alias("log_text")).foreachPartition(_log_writer(folder))
