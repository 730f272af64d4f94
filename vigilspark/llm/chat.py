"""Chat formatting by minimum-cost role repair.

A legal conversation is a walk of an automaton over the role spoken last: an optional
system turn, then user and assistant by turns, ending with the assistant. Dynamic
programming over its states chooses for every turn to keep it, relabel it, merge it into
the turn before, or put an empty turn before it, at the least total cost (ties: the
first choice in the order of CHOICES), then the repaired sequence is rendered.

A conversation may hold any share of the rows: turns are range-partitioned by their
order, each partition sums up its part of a conversation that others share as a matrix
of least costs from state to state, the few matrices are combined, and every partition
then solves its part between known states.

Defined results: turns are ordered by (turn, role, text), nulls first; null or unknown
roles may become any role for the cost of a relabel; null text counts as empty; repeated
rows are turns of their own; rows of null conv_id form one conversation; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, map_arrow, record_batch, table, written

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role spoken last.
START = 3
#: Legal next roles by state.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, RELABEL, RELABEL_SYSTEM, INSERT = 6, 10, 20, 15
FAR = 1 << 40
#: (role to emit, or -1 for a merge; roles of empty turns before it), in order of preference.
CHOICES = ((0, ()), (1, ()), (2, ()), (-1, ()), (1, (0,)), (1, (2,)), (2, (1,)))


def relabel_cost(role: int, to: int) -> int:
    if role == to:
        return 0
    return RELABEL if role < 0 or role and to else RELABEL_SYSTEM


def _steps(role: int) -> list[list[tuple[int, int, int]]]:
    """By state: (next state, cost, choice) of a turn of this role."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(4)]
    for state in range(4):
        for k, (to, empty) in enumerate(CHOICES):
            if to < 0:
                if state != START:
                    out[state].append((state, MERGE + relabel_cost(role, state), k))
                continue
            at, legal = state, True
            for x in (*empty, to):
                legal, at = legal and x in NEXT[at], x
            if legal:
                out[state].append((to, INSERT * len(empty) + relabel_cost(role, to), k))
    return out


STEPS = {role: _steps(role) for role in (-1, 0, 1, 2)}
#: Cost of ending in a state: empty turns up to an assistant's.
END = {START: 0, 0: 2 * INSERT, 1: INSERT, 2: 0}


def advance(costs: list[int], role: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Least costs by state after one more turn, and (state before, choice) by state."""
    new, back = [FAR] * 4, [(-1, -1)] * 4
    for state, base in enumerate(costs):
        if base < FAR:
            for to, cost, k in STEPS[role][state]:
                if base + cost < new[to] or base + cost == new[to] and k < back[to][1]:
                    new[to], back[to] = base + cost, (state, k)
    return new, back


def matrix(roles: list[int]) -> list[list[int]]:
    """Least costs from each state to each over these turns."""
    rows = []
    for state in range(4):
        costs = [FAR] * 4
        costs[state] = 0
        for r in roles:
            costs, _ = advance(costs, r)
        rows.append(costs)
    return rows


def solve(roles: list[int], start: int = START, end: int | None = None) -> list[tuple[int, int]]:
    """(state before, choice) of every turn on the cheapest way from start to end (any legal end if None)."""
    costs = [FAR] * 4
    costs[start] = 0
    trail = []
    for r in roles:
        costs, back = advance(costs, r)
        trail.append(back)
    if end is None:
        end = min(range(4), key=lambda s: costs[s] + END[s])
    out = []
    for back in reversed(trail):
        before, k = back[end]
        out.append((before, k))
        end = before
    return out[::-1]


def between(parts: list[list[list[int]]]) -> list[tuple[int, int]]:
    """States before and after each part of a conversation, on the cheapest way through all."""
    costs = [FAR] * 4
    costs[START] = 0
    trail = []
    for m in parts:
        new, back = [FAR] * 4, [-1] * 4
        for a in range(4):
            for b in range(4):
                if costs[a] + m[a][b] < new[b]:
                    new[b], back[b] = costs[a] + m[a][b], a
        costs = new
        trail.append(back)
    end = min(range(4), key=lambda s: costs[s] + END[s])
    out = []
    for back in reversed(trail):
        out.append((back[end], end))
        end = back[end]
    return out[::-1]


def render(role: int, text: str, before: int, choice: int, last: bool) -> tuple[str, str, int, str]:
    """New role, action, cost and text of one turn; the pieces of a conversation in order are its rendering."""
    to, empty = CHOICES[choice]
    new = before if to < 0 else to
    parts = []
    if to < 0:
        parts.append("\n" + text)
    else:
        if before != START:
            parts.append("<|end|>\n")
        parts += [f"<|{ROLES[x]}|>\n<|end|>\n" for x in empty]
        parts.append(f"<|{ROLES[to]}|>\n{text}")
    cost = (MERGE if to < 0 else INSERT * len(empty)) + relabel_cost(role, new)
    action = "merge" if to < 0 else "insert" if empty else "keep"
    if role != new:
        action = "relabel" if action == "keep" else f"{action}+relabel"
    if last:
        parts.append("<|end|>\n")
        while new != 2:
            nxt = NEXT[new][0]
            parts.append(f"<|{ROLES[nxt]}|>\n<|end|>\n")
            cost += INSERT
            new = nxt
            action += "" if action.endswith("+close") else "+close"
        new = before if to < 0 else to
    return ROLES[new], action, cost, "".join(parts)


def role_number(role: str | None) -> int:
    r = (role or "").strip().lower()
    return ROLES.index(r) if r in ROLES else -1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, object, list[int], list[int]]]:
    """(shard, number, conv, idx, roles) of every run of one conversation in sorted rows."""
    shard = conv = None
    number, idx, roles, begun = 0, [], [], False
    for b in batches:
        for s, i, c, r in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if begun and (s, c) != (shard, conv):
                yield shard, number, conv, idx, roles
                number, idx, roles = (number + 1 if s == shard else 0), [], []
            shard, conv, begun = s, c, True
            idx.append(i)
            roles.append(role_number(r))
    if begun:
        yield shard, number, conv, idx, roles


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, position, role, new_role, action, cost, rendered of every turn of conversations (conv_id, turn, role, text)."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, shard, np.int64)), pa.array(np.arange(at, at + n))], names=[*order, "shard", "idx"])
            at += n

    ranged = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = written(map_arrow(ranged, numbered, "conv_id long, turn long, role string, text string, shard long, idx long"), "turns")
    ends = rows.groupBy("shard").agg(F.min_by("conv_id", "idx").alias("first"), F.max_by("conv_id", "idx").alias("last"), F.count("*").alias("n"), F.count_distinct("conv_id").alias("convs")).orderBy("shard").collect()  # a row per partition
    shared: dict[object, list[int]] = {}
    for e in ends:
        for c in {e["first"], e["last"]}:
            shared.setdefault(c, []).append(e["shard"])
    shared = {c: s for c, s in shared.items() if len(s) > 1}  # conversations that go over partitions: fewer than partitions
    narrow = rows.select("shard", "idx", "conv_id", "role").repartition("shard").sortWithinPartitions("shard", "idx")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, conv, _, roles in _runs(batches):
            if conv in shared:  # two of a partition at most
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([conv], pa.int64()), pa.array([[x for row in matrix(roles) for x in row]], pa.list_(pa.int64()))], names=["shard", "conv_id", "costs"])

    known: dict[tuple, tuple[int, int, int, bool]] = {}
    if shared:
        got: dict[object, list] = {}
        sizes = {}
        for shard, conv, costs in map_arrow(narrow, sums, "shard long, conv_id long, costs array<long>").collect():  # two rows per partition at most
            got.setdefault(conv, []).append((shard, [costs[i : i + 4] for i in range(0, 16, 4)]))
        for r in rows.where(F.coalesce(F.col("conv_id"), F.lit(-1)).isin([c for c in shared if c is not None]) | (F.col("conv_id").isNull() if None in shared else F.lit(False))).groupBy("conv_id", "shard").count().collect():
            sizes[r[0], r[1]] = r[2]
        for conv, found in got.items():
            found.sort()
            at = 0
            for k, ((shard, _), (a, b)) in enumerate(zip(found, between([m for _, m in found]), strict=True)):
                known[shard, conv] = (a, b, at, k == len(found) - 1)
                at += sizes[conv, shard]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"shard": pa.int64(), "idx": pa.int64(), "position": pa.int64(), "before": pa.int32(), "choice": pa.int32(), "is_last": pa.bool_()}
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], names=list(types))

        for shard, _, conv, idx, roles in _runs(batches):
            start, end, at, last = known.get((shard, conv), (START, None, 0, True))
            n = len(idx)
            out += [(shard, i, at + j, s, k, last and j == n - 1) for j, (i, (s, k)) in enumerate(zip(idx, solve(roles, start, end), strict=True))]
            if len(out) >= BATCH_ROWS:
                yield batch()
                out.clear()
        if out:
            yield batch()

    decisions = map_arrow(narrow, decide, "shard long, idx long, position long, before int, choice int, is_last boolean")
    names = ["conv_id", "turn", "position", "role", "new_role", "action", "cost", "rendered"]
    schema = pa.schema([(n, pa.int64() if n in ("conv_id", "turn", "position", "cost") else pa.string()) for n in names])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, turn, position, role, text, before, choice, last = (c.to_pylist() for c in b.columns)
            out = [render(role_number(r), t or "", s, k, e) for r, t, s, k, e in zip(role, text, before, choice, last, strict=True)]
            yield record_batch(schema, [conv, turn, position, role, *(list(c) for c in zip(*out, strict=True))] if out else [[] for _ in names])

    joined = rows.join(decisions, ["shard", "idx"]).select("conv_id", "turn", "position", "role", "text", "before", "choice", "is_last")
    return map_arrow(joined, write, "conv_id long, turn long, position long, role string, new_role string, action string, cost long, rendered string")


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
