"""Templates of error lines: a parse tree over their words, with slots where words vary.

Lines are first counted by their shape (words with a digit become slots), an aggregate that combines in each task; shapes of several
batches add up. The tree stands on the different shapes only: its first level is the number of words, the next levels are the first
words, and a node with more than ``branches`` next words takes them all for one slot. Under a leaf the same rule holds for every
further position. The rule looks at sets of words, so neither the order of lines nor their partitions matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.log_text import ERROR_LINE
from driftwarden.functions.names import quoted
from driftwarden.session import materialize

SLOT = "<*>"
#: Different words at one place of the tree beyond which the place is a slot, and levels of the tree below the number of words.
BRANCHES, DEPTH = 16, 2


def error_lines(logs: DataFrame, by: Sequence[str] = ("dag_id", "task_id")) -> DataFrame:
    """``(by, line)``: every error line of the logs, whole."""
    return logs.select(*map(quoted, by), F.explode(F.regexp_extract_all("log_text", F.lit(ERROR_LINE), F.lit(0))).alias("line"))


def line_shapes(lines: DataFrame, by: Sequence[str] = ("dag_id", "task_id")) -> DataFrame:
    """``(by, words, lines, example)``: lines counted by their words, those with a digit taken for slots. NULL lines take no part.

    ``example`` is the least line of the shape.
    """
    words = F.transform(F.split(F.trim("line"), r"\s+"), lambda w: F.when(w.rlike("[0-9]"), SLOT).otherwise(w))
    return lines.where("line IS NOT NULL").groupBy(*map(quoted, by), words.alias("words")).agg(
        F.count(F.lit(1)).alias("lines"), F.min("line").alias("example"))


def merged(*shapes: DataFrame, by: Sequence[str] = ("dag_id", "task_id")) -> DataFrame:
    """The shapes of several batches of lines as one."""
    first, *others = shapes
    for other in others:
        first = first.unionByName(other)
    return first.groupBy(*map(quoted, by), "words").agg(F.sum("lines").alias("lines"), F.min("example").alias("example"))


def _tree(shapes: DataFrame, branches: int, depth: int) -> DataFrame:
    """``(words, template)`` for the different ``words``: each level is an aggregate over them."""
    tree = materialize(shapes.select("words").distinct().withColumns(
        {"path": F.array().cast("array<string>"), "size": F.size("words")}), "shapes")
    for level in range(depth):
        word = F.get("words", F.lit(level))
        wide = tree.where(F.col("size") > level).select("size", "path", word.alias("word")).distinct().groupBy("size", "path").agg(
            F.count(F.lit(1)).alias("n")).where(F.col("n") > branches).select("size", "path", F.lit(SLOT).alias("slot"))
        step = F.when(F.col("size") > level, F.array(F.coalesce("slot", word))).otherwise(F.array().cast("array<string>"))
        tree = materialize(tree.join(wide, ["size", "path"], "left").select("words", "size", F.concat("path", step).alias("path")), "tree")
    rest = tree.select("path", "size", F.posexplode("words").alias("at", "word")).where(F.col("at") >= depth)
    slots = rest.distinct().groupBy("path", "size", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > branches).groupBy(
        "path", "size").agg(F.collect_list("at").alias("slots"))  # places of one line
    place = F.transform("words", lambda w, i: F.when(i < depth, F.get("path", i)).when(F.array_contains("slots", i), SLOT).otherwise(w))
    return tree.join(slots, ["path", "size"], "left").select("words", F.array_join(place, " ").alias("template"))


def error_templates(shapes: DataFrame, by: Sequence[str] = ("dag_id", "task_id"), branches: int = BRANCHES, depth: int = DEPTH) -> DataFrame:
    """``(by, template, line_count, shape_count, example)`` from ``line_shapes``: one tree over all lines, counts for each of ``by``.

    Lines of one template have as many words. A blank line has the empty template; the example is the least line.
    """
    shapes = materialize(shapes, "line-shapes")
    return shapes.join(_tree(shapes, branches, depth), "words").groupBy(*map(quoted, by), "template").agg(
        F.sum("lines").alias("line_count"), F.count(F.lit(1)).alias("shape_count"), F.min("example").alias("example"))
