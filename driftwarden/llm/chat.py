"""Chat formatting with minimum-cost role repair.

A legal conversation starts with a system or user turn, goes on with the user after the system, and then alternates. A
dynamic program over this automaton chooses for each turn, at the least total cost, to keep it, merge it into the turn
before, relabel it, or put an empty turn before it; the repaired turns are rendered in order.

The program runs over blocks of turns. A block's effect is a 4 x 4 table of least costs from the state before it to the
state behind it; the tables of a long conversation are chained first, and then every block is repaired by itself between
the two states found for it. So a conversation of any length is neither one group nor one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftwarden.llm.common import materialize, small_side

#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("start", "system", "user", "assistant")
LEGAL = ((START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
ENDS = (USER, ASSISTANT)
#: Roles by name; any other, or NULL, is unknown.
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}

MERGE, INSERT, RELABEL, NAME_UNKNOWN = 1, 2, 3, 1
NEVER = 1 << 40
#: Turns of a block on average, and at most this many times as many before a block is split further.
BLOCK, CROWDED = 512, 8


def moves(role: int | None, before: int, after: int) -> tuple[int, str, int | None]:
    """Cheapest way for a turn of ``role`` from one state to another: cost, action, role of the empty turn put before it."""
    naming = 0 if role == after else NAME_UNKNOWN if role is None else RELABEL
    named = "keep" if role == after else "relabel"
    options = []
    if (before, after) in LEGAL:
        options.append((naming, named, None))
    if before == after != START:
        options.append((MERGE + naming, "merge" if role == after else "merge_relabel", None))
    options += [(INSERT + naming, f"insert_{named}", x) for x in (SYSTEM, USER, ASSISTANT) if (before, x) in LEGAL and (x, after) in LEGAL]
    return min(options, key=lambda o: o[0], default=(NEVER, "", None))


MOVES = {role: [[moves(role, a, b) for b in range(4)] for a in range(4)] for role in (None, SYSTEM, USER, ASSISTANT)}
COSTS = {role: np.array([[m[0] for m in row] for row in table]) for role, table in MOVES.items()}


def role_of(name: str | None) -> int | None:
    return ROLES.get((name or "").strip().lower())


def block_costs(roles: list[int | None]) -> np.ndarray:
    """Least costs from each state before the turns to each state behind them."""
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for role in roles:
        total = np.minimum((total[:, :, None] + COSTS[role][None]).min(axis=1), NEVER)
    return total


def repair(roles: list[int | None], before: int, after: int | None) -> tuple[int, list[int]]:
    """Cost and states behind each turn of the cheapest repair; without ``after`` it ends in any legal end.

    Of equally cheap repairs the one whose states come first in the order of ``NAMES``, looked at from the end.
    """
    costs = [np.where(np.arange(4) == before, 0, NEVER)]
    for role in roles:
        costs.append(np.minimum((costs[-1][:, None] + COSTS[role]).min(axis=0), NEVER))
    state = after if after is not None else min(ENDS, key=lambda s: (costs[-1][s], s))
    total, states = int(costs[-1][state]), [state]
    for i in range(len(roles) - 1, 0, -1):
        state = int(np.argmin(costs[i] + COSTS[roles[i]][:, state]))
        states.append(state)
    return total, states[::-1]


def chain(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """States before and behind each block on the cheapest way through all of them."""
    costs = [np.where(np.arange(4) == START, 0, NEVER)]
    for table in tables:
        costs.append(np.minimum((costs[-1][:, None] + table).min(axis=0), NEVER))
    states = [min(ENDS, key=lambda s: (costs[-1][s], s))]
    for i in range(len(tables) - 1, -1, -1):
        states.append(int(np.argmin(costs[i] + tables[i][:, states[-1]])))
    states = states[::-1]
    return list(zip(states[:-1], states[1:]))


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """``(conv_id, at, turns)``: blocks of turns in order, ``at`` giving their order in the conversation."""
    # a turn number says which rows are the same turn; without one every row is a turn
    once = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).select(
        "conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("turn").isNull(), F.col("n") - 1).otherwise(0))).alias("copy"))
    keyed = once.withColumns({"h": F.xxhash64("role", "text"), "b": F.floor(F.col("turn") / block)})
    sizes = materialize(keyed.groupBy(F.col("conv_id").alias("c__"), F.col("b").alias("b__")).agg(F.count("*").alias("n__")).where(
        F.col("n__") > CROWDED * block), "crowded-blocks")
    # only where many rows share turn numbers: cut by turn, then by hash
    keyed = keyed.join(small_side(sizes), F.expr("conv_id <=> c__ AND b <=> b__"), "left")
    part = F.floor((F.shiftrightunsigned("h", 32)) * F.ceil(F.col("n__") / block) / F.lit(float(1 << 32)))
    order = F.struct(F.col("b").isNull().alias("none"), "b", F.when(F.col("n__").isNotNull(), F.col("turn")).alias("t"),
                     F.floor(F.col("copy") / block).alias("c"), F.when(F.col("n__").isNotNull(), part).alias("p"))
    return keyed.withColumn("at", order).groupBy("conv_id", "at").agg(F.array_sort(F.collect_list(
        F.struct(F.col("turn").isNull().alias("none"), "turn", F.shiftrightunsigned("h", 32).alias("p"), "h", "role", "text"))).alias("turns"))


def _ways(blocks: DataFrame) -> DataFrame:
    """``(c__, a__, before, after, last)`` for the blocks of conversations that have several."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_costs([role_of(r) for r in roles]).ravel().tolist() for roles in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["conv_id", "at", "costs"])

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"before": a, "after": b} for a, b in chain([np.array(t["costs"]).reshape(4, 4) for t in row])] for row in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["conv_id", "blocks", "ways"])

    at = blocks.schema["at"].dataType.simpleString()
    several = materialize(blocks.groupBy(F.col("conv_id").alias("c__")).agg(F.count("*").alias("n__")).where("n__ > 1"), "long-conversations")
    inside = blocks.select("conv_id", "at", "turns.role").join(small_side(several), F.expr("conv_id <=> c__")).select("conv_id", "at", "role")
    costs = inside.mapInArrow(tables, f"conv_id long, at {at}, costs array<bigint>")
    lists = costs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "costs"))).alias("blocks"))
    found = lists.mapInArrow(ways, f"conv_id long, blocks array<struct<at: {at}, costs: array<bigint>>>, ways array<struct<before: int, after: int>>")
    return found.select(F.col("conv_id").alias("c__"), F.posexplode(F.arrays_zip("blocks", "ways")), F.size("ways").alias("n")).select(
        "c__", F.col("col.blocks.at").alias("a__"), F.col("col.ways.before").alias("before"), F.col("col.ways.after").alias("after"),
        (F.col("pos") == F.col("n") - 1).alias("last"))


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``turns (conv_id, turn, role, text)`` to one row per turn: ``conv_id, turn, role, new_role, action, inserted, cost, fragment``.

    ``fragment`` is what the turn adds to the rendered conversation, so its fragments in order (of turn, NULL last, then
    of the hash of role and text) are the rendered text. Rows alike in all four columns are one turn, but where turn is
    NULL each is a turn, with those past ``block`` alike rows after the others, ``block`` at a time; a NULL text is
    empty; a NULL or other role is unknown and may take any name; NULL conv_ids are one conversation.
    """
    blocks = materialize(_blocks(turns, block), "turn-blocks")
    known = blocks.join(small_side(materialize(_ways(blocks), "block-ways")), F.expr("conv_id <=> c__ AND at <=> a__"), "left").select(
        "conv_id", "turns", F.coalesce("before", F.lit(START)).alias("before"), "after", F.coalesce("last", F.lit(True)).alias("last"))
    kind = "turn long, role string, new_role string, action string, inserted string, cost int, fragment string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()),
                  ("inserted", pa.string()), ("cost", pa.int32()), ("fragment", pa.string())]
        for batch in batches:
            columns = batch.to_pydict()
            out, ids = {n: [] for n, _ in fields}, []
            for conv, turns, state, after, last in zip(*(columns[c] for c in ("conv_id", "turns", "before", "after", "last"))):
                roles = [role_of(t["role"]) for t in turns]
                for i, (t, role, new) in enumerate(zip(turns, roles, repair(roles, state, after)[1])):
                    cost, action, extra = MOVES[role][state][new]
                    head = "\n" if action.startswith("merge") else (
                        ("" if state == START else "<|end|>\n") + (f"<|{NAMES[extra]}|>\n<|end|>\n" if extra else "") + f"<|{NAMES[new]}|>\n")
                    tail = "<|end|>\n" if last and i == len(turns) - 1 else ""
                    ids.append(conv)
                    for n, v in zip(out, (t["turn"], t["role"], NAMES[new], action, extra and NAMES[extra], cost, head + (t["text"] or "") + tail)):
                        out[n].append(v)
                    state = new
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(out[n], t) for n, t in fields]], ["conv_id", *out])

    return known.mapInArrow(run, f"conv_id long, {kind}")
