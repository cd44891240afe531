from __future__ import annotations

import itertools
import random
from collections import defaultdict

from driftwarden.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string, cost int"
NAMES = ["system", "user", "assistant", "tool", None]


def cheapest(roles):
    """Least cost over all ways, tried one by one."""
    best = chat.NEVER
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        total, before = 0, chat.START
        for role, after in zip(roles, states):
            total += chat.moves(role, before, after)[0]
            before = after
        if before in chat.ENDS:
            best = min(best, total)
    return best


def test_repair_is_optimal_for_all_short_conversations():
    for n in range(1, 6):
        for roles in itertools.product((None, 1, 2, 3), repeat=n):
            assert chat.repair(list(roles), chat.START, None)[0] == cheapest(roles)


def test_rendered_turns_are_legal_whatever_the_blocks(spark):
    draw = random.Random(7)
    rows = [(c, t, draw.choice(NAMES), f"text {c} {t}", 0) for c in range(30) for t in range(draw.randint(1, 12))]
    rows += [(99, t, draw.choice(NAMES), f"long {t}", 0) for t in range(300)]
    rows += [(None, 1, "user", None, 0), (50, None, "user", "late", 0), (50, 1, "user", "soon", 0), (50, 1, "user", "soon", 0)]
    rows += [(77, 5, draw.choice(NAMES), f"same turn {i}", 0) for i in range(200)]
    turns = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (chat.repaired(turns, block=b).collect() for b in (512, 4))
    costs = [defaultdict(int), defaultdict(int)]
    for total, found in zip(costs, (whole, cut)):
        assert len(found) == len(set(rows))
        states = defaultdict(list)
        for r in found:
            total[r.conv_id] += r.cost
            states[r.conv_id].append(r)
        for conv, turns_ in states.items():
            text = "".join(r.fragment for r in turns_)
            heads = [x for x in chat.NAMES[1:] if f"<|{x}|>" in text]
            assert heads and text.count("<|end|>") == sum(text.count(f"<|{x}|>") for x in heads)
            assert all(t is None or t in text for c, _, _, t, _ in rows if c == conv)
    assert costs[0] == costs[1]
    by_turn = sorted((r for r in cut if r.conv_id == 99), key=lambda r: r.turn)
    order = [x for r in by_turn for x in __import__("re").findall(r"<\|(system|user|assistant)\|>", r.fragment)]
    assert order[0] in ("system", "user") and order[-1] in ("user", "assistant")
    legal = {(chat.NAMES[a], chat.NAMES[b]) for a, b in chat.LEGAL}
    assert all(pair in legal for pair in itertools.pairwise(order))


def test_turns_without_a_number_are_all_kept(spark):
    rows = [(1, None, "user", "hello", 0)] * 30 + [(1, 0, "system", "rules", 0), (1, None, "assistant", "hi", 0), (2, 3, "user", "one", 0), (2, 3, "user", "one", 0)]
    for block in (512, 4):
        found = chat.repaired(spark.createDataFrame(rows, SCHEMA), block=block).collect()
        assert sorted(r.fragment.count("hello") for r in found if r.conv_id == 1) == [0, 0] + [1] * 30
        assert sum(r.conv_id == 2 for r in found) == 1


def test_examples(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 0), (1, 1, "user", "b", 0), (1, 2, "assistant", "c", 0),
                                   (2, 0, "assistant", "x", 0), (2, 1, "user", "y", 0), (2, 2, "assistant", "z", 0)], SCHEMA)
    text = defaultdict(str)
    for r in sorted(chat.repaired(turns).collect(), key=lambda r: (r.conv_id, r.turn)):
        text[r.conv_id] += r.fragment
    assert text[1] == "<|user|>\na\nb<|end|>\n<|assistant|>\nc<|end|>\n"
    assert text[2] == "<|user|>\n<|end|>\n<|assistant|>\nx<|end|>\n<|user|>\ny<|end|>\n<|assistant|>\nz<|end|>\n"
    assert chat.repaired(turns.limit(0)).count() == 0


def test_query_keeps_every_turn(spark, sf_dir):
    rows = registry.op5_chat_format(spark, sf_dir)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").distinct()
    assert rows.count() == turns.count()
