"""Packing token pieces into sequences by cutting-stock column generation.

The length histogram (at most `capacity` classes, whatever the corpus) is the demand of
a cutting-stock problem. Its linear program is solved over patterns; a knapsack dynamic
program prices new patterns. A sequence costs its capacity, or its length if that is a
power of two, which needs no padding. The program ends within GAP of a lower bound, which
the dual values give. The rounded-down solution packs nearly all pieces; what is left
fills one sequence after another, largest pieces first. Pieces get their pattern by
their rank among the pieces of the same length, so nothing but the histogram reaches
the driver.

Defined results: null text counts as empty, so the document is its end id alone; a
document longer than the capacity is cut into full sequences and one rest; repeated rows
are packed each; rows with null doc_id are packed like others; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, record_batch, table, written
from .tokens import encoder, tokenizer_path

CAPACITY = 1024
#: Column generation ends within this share, or one sequence, of a lower bound of the cost.
GAP = 2e-3
TOLERANCE = 1e-7


def costs_of(capacity: int) -> np.ndarray:
    """What a sequence of each fill costs: it is padded to the capacity, except at a power of two."""
    fill = np.arange(capacity + 1)
    return np.where((fill > 0) & (fill & fill - 1 == 0), fill / capacity, 1.0)


def price(values: np.ndarray, capacity: int) -> tuple[float, float, np.ndarray]:
    """Pattern of the largest worth over its cost, by an unbounded knapsack over exact fills: values[l] is the worth of a piece of length l. Returns worth minus cost, the largest worth by cost, and counts by length."""
    sizes = np.flatnonzero(values > 1e-12)
    counts = np.zeros(capacity + 1, np.int64)
    if not len(sizes):
        return -1.0, 0.0, counts
    worth, best = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    worth[0] = 0
    v = values[sizes]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        got = worth[c - sizes[: fits[c]]] + v[: fits[c]]
        k = int(got.argmax())
        worth[c], best[c] = got[k], sizes[k]
    cost = costs_of(capacity)
    c = over = int((worth[1:] - cost[1:]).argmax()) + 1
    while c > 0:
        counts[best[c]] += 1
        c -= best[c]
    return float(worth[over] - cost[over]), float((worth[1:] / cost[1:]).max()), counts


def solve(demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Patterns and their fractional use that meet demand[l] pieces of each length l at least cost, and the gap to a lower bound of it.

    Revised simplex. The first basis fills sequences with the largest lengths that fit; each
    of its patterns is used until one length is met, so it is triangular and feasible. Then
    every pivot brings in the pattern that price() finds, until the cost is within `gap`, or
    one sequence, of the bound: that of the dual values, or of sequences without padding.
    """
    lengths = np.flatnonzero(demand)
    m = len(lengths)
    left, basis, met, use = demand[lengths].astype(float), [], [], np.zeros(m)
    alive = np.ones(m, bool)
    for i in range(m):
        counts, room = np.zeros(m, np.int64), capacity
        while len(fit := np.flatnonzero(alive & (lengths <= room) & (counts == 0))):
            k = fit[-1]
            n = max(1, min(room // lengths[k], int(left[k])))
            counts[k], room = n, room - n * lengths[k]
        has = np.flatnonzero(counts)
        ratio = left[has] / counts[has]
        out = has[ratio.argmin()]
        use[i] = ratio.min()
        left = np.maximum(left - use[i] * counts, 0)
        alive[out] = False
        met.append(out)
        basis.append(counts)
    rows = np.zeros((m, m))  # inverse of the basis, by forward substitution in the order in which lengths are met
    uses = np.array(basis)[:, met]
    for i in range(m):
        rows[i, i] = 1
        for j in np.flatnonzero(uses[:i, i]):
            rows[i] -= uses[j, i] * rows[j]
        rows[i] /= uses[i, i]
    inverse = np.zeros((m, m))
    inverse[:, met] = rows
    by_fill = costs_of(capacity)
    cost = by_fill[np.array(basis) @ lengths]
    bound = float(demand @ np.arange(capacity + 1)) / capacity
    while True:
        values = np.zeros(capacity + 1)
        values[lengths] = cost @ inverse  # dual values
        over, most, counts = price(values, capacity)
        total = float(cost @ use)
        bound = max(bound, total / max(most, 1.0))
        if over <= TOLERANCE or total - bound <= max(gap * bound, 1.0):
            return basis, use, total / bound - 1
        column = counts[lengths].astype(float)
        has = np.flatnonzero(column)
        step = (inverse[:, has] * column[has]).sum(axis=1)
        able = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[able] = use[able] / step[able]
        r = int(ratio.argmin())
        use = np.maximum(use - ratio[r] * step, 0)
        use[r] = ratio[r]
        inverse[r] /= step[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(step[others], inverse[r])
        basis[r], cost[r] = counts[lengths], by_fill[counts @ np.arange(capacity + 1)]


def plan(demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) patterns that hold exactly demand[l] pieces of each length l, 1 <= l <= capacity."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[int, dict[int, int]]] = []
    if left.sum():
        lengths = np.flatnonzero(left)
        for counts, x in zip(*solve(left, capacity, gap)[:2], strict=True):
            has = counts > 0
            times = int(min(np.floor(x + 1e-6), (left[lengths][has] // counts[has]).min())) if has.any() else 0
            if times > 0:
                left[lengths] -= times * counts
                out.append((times, {int(a): int(n) for a, n in zip(lengths[has], counts[has], strict=True)}))
    while left.any():  # the rest: fill one sequence with the largest pieces that fit, and repeat it as often as they last
        room, pattern, c = capacity, {}, capacity
        while room and c:
            n = min(int(left[c]), room // c)
            if n:
                pattern[c], room = n, room - n * c
            c = min(c - 1, room)
        times = min(int(left[a]) // n for a, n in pattern.items())
        for a, n in pattern.items():
            left[a] -= times * n
        out.append((times, pattern))
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: rows (length, rank from, pieces per sequence, first sequence, offset), sorted."""
    rows, seen, base = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, seen.get(length, 0), n, base, offset))
            seen[length] = seen.get(length, 0) + times * n
            offset += length * n
        base += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: np.ascontiguousarray(a[:, i]) for i, k in enumerate(("length", "rank", "each", "base", "offset"))}


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard long, rank_in long"
_PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, word_ends: bool, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most `capacity` ids; rank_in is a piece's rank among those of its length in its shard (the task that made it)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, end, enc = TaskContext.get().partitionId(), struct.pack("<I", end_id), encoder(tokenizer, word_ends)
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), enc.ids(texts), strict=True):
                view = memoryview(raw + end)
                n = len(view) // 4
                for at in range(0, n, capacity):
                    k = min(capacity, n - at)
                    rows.append((doc, at, k, zlib.crc32(view[4 * at : 4 * (at + k)]), n, shard, seen[k]))
                    seen[k] += 1
            if rows:
                yield record_batch(_PIECES, list(np.array(rows, dtype=object).T.astype(np.int64)) if all(r[0] is not None for r in rows) else list(zip(*rows, strict=True)))

    return written(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES, keeps="tokens"), "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY, gap: float = GAP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of token_pieces()."""
    counts = written(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "piece-counts")
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        demand[length] = n
    where = slots(plan(demand, capacity, gap))
    key = where["length"] * (1 << 44) + where["rank"]
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_from"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (2, 5))
            k = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            turn = rank - where["rank"][k]
            seq, off = where["base"][k] + turn // where["each"][k], where["offset"][k] + turn % where["each"][k] * length
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = pieces.join(first, ["shard", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank_in") + F.col("rank_from")).alias("rank"))
    return map_arrow(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, word_ends: bool, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, end_id, word_ends, capacity), capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, word_ends=False)
