import random
from itertools import product

import pytest

from codeassay.llm import chat_repair as cr

DDL = "conv_id long, turn long, role string, text string, lang string"
P = cr.Program(cr.Costs())


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body)) and (body or not roles)


def cheapest(roles, costs):
    """Every choice for every turn: merge, or one of three roles, after zero or one empty turn."""
    best = None
    options = [("merge",)] + [(q, t) for q in (None, *cr.ROLES) for t in cr.ROLES]
    for choice in product(options, repeat=len(roles)):
        out, cost = [], 0
        for role, c in zip(roles, choice, strict=True):
            if c[0] == "merge":
                if not out:
                    break
                cost += costs.merge + costs.take(role, cr.ROLES.index(out[-1]) + 1)
                continue
            if c[0]:
                out.append(c[0])
                cost += costs.insert
            out.append(c[1])
            cost += costs.take(role, cr.ROLES.index(c[1]) + 1)
        else:
            for end in ([], ["assistant"], ["user", "assistant"]):
                if legal(out + end) and (best is None or cost + costs.insert * len(end) < best):
                    best = cost + costs.insert * len(end)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_costs_are_least(seed):
    r = random.Random(seed)
    for _ in range(12):
        roles = [r.choice([*cr.ROLES, None]) for _ in range(r.randrange(1, 4))]
        moves = P.path(roles, 0, None)
        cost = sum(m[0] for m in moves) + P.costs.ending()[moves[-1][1]][0]
        assert cost == cheapest(roles, P.costs)


def whole(rows):
    """Every conversation repaired in one piece."""
    by: dict = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((turn is None, turn or 0, role, text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: t[:2])
        moves = P.path([cr.role_of(t[2]) for t in turns], 0, None)
        out[conv] = "".join(cr.render(moves, [t[3] or "" for t in turns], True, True, P))
    return out


def collected(found):
    by: dict = {}
    for r in found.collect():
        by.setdefault(r.conv_id, []).append((r.turn is None, r.turn or 0, r.piece))
    return {c: "".join(p for *_, p in sorted(v)) for c, v in by.items()}


def rendered_roles(text):
    return [line[2:-2] for line in text.split("\n") if line.startswith("<|") and line != "<|end|>"]


def sample(n, hot, r):
    for i in range(n):
        conv = 7 if i < hot else 100 + i % 17
        role = r.choice(["user", "assistant", "user", "assistant", "system", "Human", "tool", None])
        yield conv, i, role, r.choice([f"text {i}", "", None]), "en"


@pytest.mark.parametrize("parts", [1, 9])
def test_a_conversation_over_many_ranges(spark, parts):
    rows = list(sample(400, 250, random.Random(5)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = cr.repair(spark.createDataFrame(rows, DDL))
        got = collected(found)
        costs = found.groupBy("conv_id").sum("cost").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = whole(rows)
    assert got.keys() == want.keys()
    assert all(legal(rendered_roles(t)) for t in got.values())
    for conv, total in costs:
        roles = [cr.role_of(r[2]) for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert total == sum(m[0] for m in P.path(roles, 0, None))
    if parts == 1:
        assert got == want


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (1, 0, "user", "x" * 200_000, "e"), (1, 0, "user", "x" * 200_000, "e"),
        (2, 5, "assistant", "late", "e"), (3, 0, "system", "only", "e"), (4, 0, "user", "a", "e"), (4, 1, "user", "b", "e"),
    ]
    got = collected(cr.repair(spark.createDataFrame(rows, DDL)))
    assert got[2] == "<|user|>\n\n<|end|>\n<|assistant|>\nlate\n<|end|>\n"
    assert rendered_roles(got[3]) == ["system", "user", "assistant"] and legal(rendered_roles(got[None]))
    assert got[4] == "<|user|>\na\nb\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    assert len(got[1]) > 400_000
    assert cr.repair(spark.createDataFrame([], DDL)).count() == 0


def test_legal_conversations_stay(spark):
    found = cr.op2_chat_repair(spark, "/root/testdata/sf0.01")
    assert {r.action for r in found.select("action").distinct().collect()} == {"keep"}
    assert found.agg({"cost": "sum"}).first()[0] == 0
    assert all(legal(rendered_roles(t)) for t in collected(found).values())
