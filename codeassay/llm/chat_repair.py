"""Chat formatting with minimum-cost role repair.

A conversation is legal if an optional system turn is followed by user and assistant turns in
alternation, from a user turn to an assistant turn. A dynamic program over that automaton chooses,
at least total cost, which turns keep their role, are relabelled, are merged into the turn before,
or have an empty turn inserted before them; the repaired sequence is then rendered.

A turn maps the costs of the automaton's states to new ones, a matrix in the (min, +) semiring.
Products of such matrices stand for whole stretches of turns: a conversation may span many tasks,
each of which reduces its stretch to one matrix; the states at the joints then fix every stretch.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeassay.llm.common import in_batches, order_id, ranges, shared, table

ROLES = ("system", "user", "assistant")
#: Other usual names of the roles (fixed values).
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: States: 0 start, then the role of the last turn.
_AFTER = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
KEEP, MERGE, RELABEL = "keep", "merge", "relabel"
_NEVER = 10**15


@dataclass(frozen=True)
class Costs:
    """Costs of the repairs. A turn without a known role takes any for ``unknown``."""

    merge: int = 1
    insert: int = 3
    relabel: int = 5
    unknown: int = 1
    relabel_system: int = 7

    def take(self, role: str | None, state: int) -> int:
        """The cost of giving a turn the role of ``state``."""
        if role is None:
            return self.unknown
        if ROLES[state - 1] == role:
            return 0
        return self.relabel_system if "system" in (role, ROLES[state - 1]) else self.relabel

    def moves(self, role: str | None) -> list[list[tuple[int, int, str, tuple[int, ...]]]]:
        """From each state: (cost, new state, action, states of inserted empty turns), best first."""
        found = []
        for s in range(4):
            best: dict[int, tuple[int, int, str, tuple[int, ...]]] = {}
            options = [((), t) for t in _AFTER[s]] + [((q,), t) for q in _AFTER[s] for t in _AFTER[q]]
            moves = []
            for inserted, t in options:
                action = KEEP if role is None or ROLES[t - 1] == role else RELABEL
                moves.append((self.take(role, t) + self.insert * len(inserted), t, action, inserted))
            if s:
                moves.append((self.merge + self.take(role, s), s, MERGE, ()))
            for m in sorted(moves, key=lambda m: (m[0], m[2] != KEEP, m[2], len(m[3]), m[3], m[1])):
                best.setdefault(m[1], m)
            found.append(list(best.values()))
        return found

    def ending(self) -> list[tuple[int, tuple[int, ...]]]:
        """For each state: cost and states of the empty turns that end the conversation legally."""
        return [(0, ()), (2 * self.insert, (2, 3)), (self.insert, (3,)), (0, ())]


def role_of(role: str | None) -> str | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


@dataclass
class Program:
    """The moves for each role, worked out once."""

    costs: Costs
    table: dict[str | None, list] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.table = {r: self.costs.moves(r) for r in (*ROLES, None)}

    def step(self, values: list[int], role: str | None) -> tuple[list[int], list]:
        """Costs after a turn, and for each state (state before, move) that reaches it."""
        after, via = [_NEVER] * 4, [None] * 4
        for s, value in enumerate(values):
            if value < _NEVER:
                for move in self.table[role][s]:
                    if value + move[0] < after[move[1]]:
                        after[move[1]], via[move[1]] = value + move[0], (s, move)
        return after, via

    def path(self, roles: list[str | None], entry: int, leave: int | None) -> list[tuple]:
        """The moves of a stretch between two states; without ``leave`` the cheapest legal end."""
        values = [0 if s == entry else _NEVER for s in range(4)]
        steps = []
        for role in roles:
            values, via = self.step(values, role)
            steps.append(via)
        state = self.last_state(values) if leave is None else leave
        moves = []
        for via in reversed(steps):
            state, move = via[state]
            moves.append(move)
        return moves[::-1]

    def last_state(self, values: list[int]) -> int:
        ends = self.costs.ending()
        return min(range(4), key=lambda s: (values[s] + ends[s][0], -s))


def _open(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


CLOSE = "\n<|end|>\n"


def render(moves: list[tuple], texts: list[str], first: bool, last: bool, program: Program) -> list[str]:
    """A piece for each turn; the pieces of a conversation in order are its rendered text."""
    pieces = []
    for k, ((_, state, action, inserted), text) in enumerate(zip(moves, texts, strict=True)):
        if action == MERGE:
            piece = "\n" + text
        else:
            empty = "".join(_open(s) + CLOSE for s in inserted)
            piece = ("" if first and k == 0 else CLOSE) + empty + _open(state) + text
        if last and k == len(moves) - 1:
            piece += CLOSE + "".join(_open(s) + CLOSE for s in program.costs.ending()[state][1])
        pieces.append(piece)
    return pieces


_ORDER = ("conv", "at", "digest")


def _turns(conversations: DataFrame, *more: str) -> DataFrame:
    digest = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return conversations.select(
        order_id("conv_id").alias("conv"), order_id("turn").alias("at"), digest.alias("digest"), F.col("role").cast("string").alias("role"), *more
    )


def repair(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per row of ``conversations`` (conv_id, turn, role, text; others are ignored) the repaired turn.

    Columns: conv_id, turn, role (new), action (keep, merge, relabel), n_inserted (empty turns
    before it), cost, piece (what it adds to the rendered conversation: the pieces in order of
    turn make the whole). Turns are ordered by number, null ones last, and rows with the same
    number by a digest. Rows without a conversation id form one conversation. A null text is empty.

    Ranges of that order are dealt to tasks. One small matrix for a range's first and last
    conversation comes to the driver, a few numbers for each range whatever its size.
    """
    spark = conversations.sparkSession
    turns = _turns(conversations)
    bounds = ranges(turns, _ORDER)
    lows = shared(spark, [low for low, _ in bounds])
    program = shared(spark, Program(costs))

    def dealt(df: DataFrame) -> DataFrame:
        def run(*keys: pa.Array) -> pa.Array:
            rows = zip(*[k.to_pylist() for k in keys], strict=True)
            return pa.array([max(0, bisect_right(lows(), row) - 1) for row in rows], pa.int32())

        part = F.arrow_udf(run, T.IntegerType())(*_ORDER)
        return (
            df.withColumn("part", part).repartitionById(max(1, len(bounds)), F.col("part")).sortWithinPartitions("part", *_ORDER)
        )

    def stretches(batches: Iterator[dict], also: tuple[str, ...]) -> Iterator[tuple[int, int, dict[str, list]]]:
        """(part, conversation, columns) of each stretch."""
        at, held = None, {}
        for b in batches:
            for part, conv, *values in zip(*(b[c] for c in ("part", "conv", *also)), strict=True):
                if (part, conv) != at:
                    if at is not None:
                        yield (*at, held)
                    at, held = (part, conv), {c: [] for c in also}
                for c, v in zip(also, values, strict=True):
                    held[c].append(v)
        if at is not None:
            yield (*at, held)

    def names(roles: list[bytes | None]) -> list[str | None]:
        return [role_of(r and r.decode()) for r in roles]

    joints = {low[0] for low, _ in bounds} & {high[0] for _, high in bounds}
    between = shared(spark, {c for c in joints if sum(low[0] <= c <= high[0] for low, high in bounds) > 1})

    def matrices(batches: Iterator[dict]) -> Iterator[dict]:
        p = program()
        for part, conv, held in stretches(batches, ("role",)):
            if conv in between():
                rows = []
                for s in range(4):
                    values = [0 if t == s else _NEVER for t in range(4)]
                    for role in names(held["role"]):
                        values, _ = p.step(values, role)
                    rows += values
                yield {"part": [part], "conv": [conv], "m": [rows]}

    spanning = in_batches(
        dealt(turns).select("part", "conv", "role"), matrices, "part int, conv long, m array<long>"
    ).collect() if between() else []
    joined = shared(spark, _joints(sorted((r.conv, r.part, list(r.m)) for r in spanning), Program(costs)))

    def decide(batches: Iterator[dict]) -> Iterator[dict]:
        p, states = program(), joined()
        out: dict[str, list] = {}
        size = 0
        for part, conv, held in stretches(batches, ("conv_id", "turn", "role", "text")):
            entry, leave, first, last = states.get((part, conv), (0, None, True, True))
            moves = p.path(names(held["role"]), entry, leave)
            pieces = render(moves, [(t or b"").decode() for t in held["text"]], first, last, p)
            found = {
                "conv_id": held["conv_id"],
                "turn": held["turn"],
                "role": [ROLES[m[1] - 1] for m in moves],
                "action": [m[2] for m in moves],
                "n_inserted": [len(m[3]) for m in moves],
                "cost": [m[0] for m in moves],
                "piece": pieces,
            }
            for k, v in found.items():
                out.setdefault(k, []).extend(v)
            size += sum(map(len, pieces))
            if size > 1 << 22:
                yield out
                out, size = {}, 0
        if out:
            yield out

    whole = _turns(conversations, F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    columns = dealt(whole).select("part", "conv", "conv_id", "turn", "role", "text")
    return in_batches(
        columns, decide, "conv_id long, turn long, role string, action string, n_inserted int, cost long, piece string"
    )


def _joints(stretches: list[tuple[int, int, list[int]]], program: Program) -> dict[tuple[int, int], tuple]:
    """(state before, state after, is first, is last) of each stretch of the spanning conversations."""
    found: dict[tuple[int, int], tuple] = {}
    k = 0
    while k < len(stretches):
        end = k
        while end < len(stretches) and stretches[end][0] == stretches[k][0]:
            end += 1
        values = [[0] + [_NEVER] * 3]
        for _, _, m in stretches[k:end]:
            v = values[-1]
            values.append([min(v[s] + m[4 * s + t] for s in range(4)) for t in range(4)])
        state = program.last_state(values[-1])
        for i in range(end - 1, k - 1, -1):
            conv, part, m = stretches[i]
            before = values[i - k]
            entry = min(range(4), key=lambda s: (before[s] + m[4 * s + state], s))
            found[part, conv] = (entry, state, i == k, i == end - 1)
            state = entry
        k = end
    return found


def op2_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
