from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import error_templates as et

DDL = "dag_id STRING, task_id STRING, line STRING"


def plain(lines, branches, depth):
    """Template of each line, by walking the different shapes place by place."""
    shape = {line: tuple("<*>" if re.search("[0-9]", w) else w for w in re.split(r"\s+", line.strip(" "))) for line in lines}
    path = {s: () for s in shape.values()}
    for level in range(depth):
        kids = {}
        for s, p in path.items():
            if len(s) > level:
                kids.setdefault((len(s), p), set()).add(s[level])
        path = {s: p + (("<*>" if len(kids[len(s), p]) > branches else s[level],) if len(s) > level else ()) for s, p in path.items()}
    seen = {}
    for s, p in path.items():
        for i in range(depth, len(s)):
            seen.setdefault((len(s), p, i), set()).add(s[i])
    return {line: " ".join(p if i < depth else "<*>" if len(seen[len(s), path[s], i]) > branches else w
                           for i, (w, p) in enumerate(zip(s, path[s] + s[depth:])))
            for line, s in shape.items()}


def some_lines(seed):
    draw = random.Random(seed)
    name = lambda: "".join(draw.choice("abcd") for _ in range(3))
    kinds = [lambda: f"ERROR disk {draw.randrange(99)} full", lambda: f"ERROR host {name()} down", lambda: f"{name()} ERROR lost",
             lambda: f"ERROR in {draw.choice(['read', 'write'])} of {name()} at {name()}", lambda: "ERROR", lambda: "", lambda: f"  {name()}\t{name()} "]
    return [("d", draw.choice("xy"), draw.choice(kinds)()) for _ in range(600)]


@pytest.mark.parametrize("seed, branches, depth", [(1, 4, 2), (2, 8, 1), (3, 1, 3), (4, 16, 0)])
def test_templates_equal_brute_force(spark, seed, branches, depth):
    rows = some_lines(seed)
    named = plain({line for *_, line in rows}, branches, depth)
    want = {}
    for dag, task, line in rows:
        got = want.setdefault((dag, task, named[line]), [0, line])
        want[dag, task, named[line]] = [got[0] + 1, min(got[1], line)]
    lines = spark.createDataFrame([*rows, ("d", "x", None)], DDL)
    found = et.error_templates(et.line_shapes(lines), branches=branches, depth=depth).collect()
    assert {(r.dag_id, r.task_id, r.template): [r.line_count, r.example] for r in found} == want


def test_order_partitions_and_batches_do_not_matter(spark):
    rows = some_lines(5)
    whole = et.error_templates(et.line_shapes(spark.createDataFrame(rows, DDL).coalesce(1)), branches=4)
    shuffled = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), DDL).repartition(7)
    parts = [et.line_shapes(shuffled.where(F.length("line") % 2 == i)) for i in (0, 1)]
    merged = et.error_templates(et.merged(*parts), branches=4)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_slots_and_words(spark):
    lines = [("d", "t", f"ERROR user {chr(97 + i)} has no right") for i in range(20)] + [("d", "t", "ERROR attempt 1 gave up")] * 3
    found = et.error_templates(et.line_shapes(spark.createDataFrame(lines, DDL))).collect()
    assert {(r.template, r.line_count, r.shape_count) for r in found} == {("ERROR user <*> has no right", 20, 20), ("ERROR attempt <*> gave up", 3, 1)}


def test_no_lines(spark):
    assert et.error_templates(et.line_shapes(spark.createDataFrame([], DDL))).collect() == []
