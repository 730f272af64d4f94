"""Exact Jaccard join of word n-gram sets by count-vector R-trees.

Shingles are hashed into groups; a document is the point of its group counts. Two sets
share at most the sum of the smaller of their counts, group by group, so a point, or a
whole R-tree node by its largest counts, is ruled out where that bound is too low.
Surviving pairs are verified on the shingles.

Which points meet in one tree: at similarity t, sets of sizes a and b differ in at most
(1 - t) / (1 + t) * (a + b) shingles. With more groups than that, linked sets have a
group with equal content, here two of them at least. So every set is listed under the
content of each of its groups (per band of sizes), and linked sets meet in two blocks.

1. Equal sets form classes. Blocks of one class are dropped at once.
2. Every class is compared with one other only, the first class of most of its blocks
   (a star, so groups of copies cost no more than their size); links give components.
3. Blocks that still hold several components go through R-trees, which yield the pairs
   of different components whose bound allows a link. First only a spanning forest of
   them by the largest bound is verified, which joins what mostly belongs together; then
   all that remain between different components are, and the components are final. The
   members of a block of more than BLOCK classes (a line that many texts share can fill
   one) meet under every two such blocks that they have in common instead; only what is
   still too large then is dealt out in chunks, each pair of chunks being one tree.

Shingles are 64-bit hashes and classes 64-bit digests with the set's size; chance
collisions are the only inexactness (below 1e-6 for 10^9 documents of 1000 shingles).

Defined results: null text or text without words has an empty set, n_shingles 0, and is
linked with nothing; fewer words than a shingle form one shingle; repeated rows with one
doc_id give that many rows; other columns are ignored; an empty table gives no rows. Rows
with null doc_id are linked like others; their component_id is the smallest doc_id of the
component, null if it has none.

near_copies() joins components only and leaves the links inside a found component aside.
near_links() then compares all classes of one component, which every link lies in, and
gives the number of links of each document; a group of n classes costs n * n / 2
comparisons there, but never as many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, map_arrow, table, written

WORDS = 4
SIMILARITY = Fraction(85, 100)
#: Ratio of the largest to the smallest size of a band.
BAND = 1.4
#: Counts of one point for each group of a key, so that about one shingle falls on each, and at most.
FINER, COUNTS = 5, 2048
#: Classes of one tree at most, and of one leaf.
BLOCK, LEAF = 4096, 32
#: Members that one task compares with a class at the centre of a star.
STAR = 500
#: Classes of one side that one task of near_links() compares with another side's.
SIDE = 256
#: Digests a task remembers so as to list equal sets once.
REMEMBERED = 50_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), 1 << 14)
        for i, b in enumerate((_BASE, _BASE_INVERSE)):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b)]))
    return _powers


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams (A-Z lower-cased, words between ASCII white space)."""
    raw = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8)
    solid = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers_to(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
    word = _mix((total[end] - total[start]) * inverse[start])
    n = min(words, len(word))
    out = np.full(len(word) - n + 1, np.uint64(n))
    for i in range(n):
        out = _mix(out * _BASE + word[i : len(word) - n + 1 + i])
    return np.unique(out)


def differ(similarity: Fraction, a: int, b: int) -> int:
    """How many shingles linked sets of these sizes differ in at most."""
    return floor((1 - similarity) * (a + b) / (1 + similarity))


class Bands:
    """Groups by band of sizes: band i holds sizes from BAND**i up to, not including, BAND**(i+1)."""

    def __init__(self, similarity: Fraction):
        self.similarity, self._groups = similarity, {}

    def of(self, n: int) -> list[int]:
        """The bands that a set of size n is listed in: its own, and the next lower if a smaller partner can be there."""
        i = floor(log(n) / log(BAND) + 1e-9)
        while BAND ** (i + 1) <= n:
            i += 1
        return [i, i - 1] if ceil(self.similarity * n) < BAND**i and i else [i]

    def groups(self, band: int) -> int:
        if band not in self._groups:
            top = ceil(BAND ** (band + 1)) - 1  # the smaller set's size at most
            most = differ(self.similarity, top, floor(top / self.similarity))
            self._groups[band] = most + 3 + most // 100
        return self._groups[band]

    def cuts(self, hashes: np.ndarray, band: int) -> np.ndarray:
        """Where each group begins in the sorted hashes: a group is a range of hashes."""
        g = self.groups(band)
        return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(g) >> np.uint64(32), np.arange(g + 1))

    def keys(self, hashes: np.ndarray, band: int) -> np.ndarray:
        cuts, n = self.cuts(hashes, band), len(hashes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes + _BASE))])
        full = np.diff(cuts) > 0
        g = len(full)
        keys = _mix((sums[cuts[1:]] - sums[cuts[:-1]]) * _M1 + np.arange(g, dtype=np.uint64) * _M2 + np.uint64(band))
        # linked sets share two listed groups at least: where equal empty groups could make up nearly all that they share, empty ones are listed too
        most = differ(self.similarity, n, floor(n / self.similarity))
        return keys if g - np.count_nonzero(full) >= g - most - 1 else keys[full]

    def dimensions(self, band: int) -> int:
        return min(FINER * self.groups(band), COUNTS)

    def point(self, hashes: np.ndarray, band: int) -> np.ndarray:
        n = np.uint64(self.dimensions(band))
        counts = np.bincount(((hashes >> np.uint64(32)) * n >> np.uint64(32)).astype(np.int64), minlength=int(n))
        return counts.astype(np.uint8 if counts.max() < 256 else "<u4")


def packed(point: np.ndarray) -> bytes:
    """A point's counts in half bytes where they fit."""
    if point.max(initial=0) >= 16:
        return point.tobytes()
    even = np.append(point, 0) if len(point) % 2 else point
    return (even[::2] | even[1::2] << 4).astype(np.uint8).tobytes()


def unpacked(raw: bytes, dimensions: int) -> np.ndarray:
    if len(raw) < dimensions:
        pairs = np.frombuffer(raw, np.uint8)
        return np.stack([pairs & 15, pairs >> 4], axis=1).ravel()[:dimensions]
    return np.frombuffer(raw, np.uint8 if len(raw) == dimensions else "<u4")


def linked(a: np.ndarray, b: np.ndarray, similarity: Fraction = SIMILARITY) -> bool:
    if not len(a) or not len(b):
        return False
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return similarity.denominator * both >= similarity.numerator * (len(a) + len(b) - both)


class RTree:
    """Points bulk-loaded by size into leaves; a node keeps the largest counts and the smallest size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, similarity: Fraction):
        self.order = np.lexsort((*points.T[:2], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.share = float(similarity / (1 + similarity)) - 1e-9
        self.levels = []
        high, least, most = self.points, self.sizes, self.sizes
        while True:
            at = np.arange(0, len(high), LEAF)
            high, least, most = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((high, least, most))
            if len(high) == 1:
                break
        self.ratio = float(similarity) - 1e-9

    def _near(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bound) of the rows of a and b (counts, smallest, largest size) that can hold linked points."""
        (ha, la, ma), (hb, lb, mb) = a, b
        i, j = np.nonzero((ma[:, None] >= self.ratio * lb) & (mb >= self.ratio * la[:, None]))
        bound = np.empty(len(i), np.int64)
        for k in range(0, len(i), 1 << 12):
            s = slice(k, k + (1 << 12))
            bound[s] = np.minimum(ha[i[s]], hb[j[s]]).sum(axis=1, dtype=np.int64)
        fit = bound >= self.share * (la[i] + lb[j])
        return i[fit], j[fit], bound[fit]

    def pairs(self, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) rows of all points of different components whose bound allows a link, and the share that the bound allows."""
        comp = component[self.order]
        out, shares, todo = [np.zeros((0, 2), np.int64)], [np.zeros(0)], [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, x, y = todo.pop()
            below = self.levels[level - 1] if level else (self.points, self.sizes, self.sizes)
            rx, ry = (slice(k * LEAF, (k + 1) * LEAF) for k in (x, y))
            i, j, bound = self._near(tuple(t[rx] for t in below), tuple(t[ry] for t in below))
            i, j = i + rx.start, j + ry.start
            if level:
                todo += [(level - 1, a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if x != y or a <= b]
                continue
            keep = comp[i] != comp[j]
            if x == y:
                keep &= i < j
            i, j = i[keep], j[keep]
            out.append(np.stack([self.order[i], self.order[j]], axis=1))
            shares.append(bound[keep] / (self.sizes[i] + self.sizes[j]))
        return np.concatenate(out), np.concatenate(shares)


def spanning(pairs: np.ndarray, shares: np.ndarray, component: np.ndarray) -> np.ndarray:
    """The pairs of a spanning forest of the components, by the largest share."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k in np.argsort(-shares, kind="stable").tolist():
        a, b = (root(int(component[i])) for i in pairs[k])
        if a != b:
            parent[a] = b
            kept.append(k)
    return pairs[kept]


def _digest(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes() + len(hashes).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)


def _runs(batches: Iterator[pa.RecordBatch], by: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted batches, cut so that rows with equal first `by` columns are never parted."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.ones(len(cols[0]), bool)
        for c in cols[:by]:
            last &= c == c[-1]
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield tuple(c[:cut] for c in cols)
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield tuple(held)


def _edges_of(cols: tuple[np.ndarray, ...], by: int) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols[:by]:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _blocks(docs: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """key, band, class of every block of two classes or more, with its first class."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(similarity), set()
        for b in batches:
            ks, bs, cs = [], [], []
            for t in b.column(0).to_pylist():
                h = shingles(t, words)
                if not differ(similarity, len(h), floor(len(h) / similarity)):
                    continue  # links with equal sets only
                c = _digest(h)
                if c in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
                for band in bands.of(len(h)):
                    k = bands.keys(h, band)
                    ks.append(k)
                    bs.append(np.full(len(k), band, np.int32))
                    cs.append(np.full(len(k), c, np.int64))
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([k.view(np.int64) for k in ks], bs, cs)], names=["key", "band", "class"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = first = last_class = None  # of the run that goes on in the next batch
        told = True
        for b in batches:
            key, band, cls = (c.to_numpy() for c in b.columns)
            if not len(key):
                continue
            same_key = np.concatenate([[key[0] == last_key], key[1:] == key[:-1]])
            fresh = ~same_key | np.concatenate([[cls[0] != last_class], cls[1:] != cls[:-1]])
            key, band, cls, same_key = key[fresh], band[fresh], cls[fresh], same_key[fresh]
            last_key, last_class = (key[-1], cls[-1]) if len(key) else (last_key, last_class)
            if not len(key):
                continue
            start = np.flatnonzero(~same_key)
            run = np.cumsum(~same_key)
            heads = np.concatenate([[0 if first is None else first], cls[start]])
            head = heads[run]
            size = np.bincount(run, minlength=len(heads))
            keep = size[run] > 1
            if run[0] == 0:  # rows of the earlier batch's run
                keep |= run == 0
            out = [key[keep], band[keep], head[keep], cls[keep]]
            if run[0] == 0 and not told:
                out = [np.concatenate([[x], o]) for x, o in zip((key[0], band[0], first, first), out, strict=True)]
            told = bool(size[-1] > 1) or (run[-1] == 0)
            first = head[-1]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["key", "band", "head", "class"])

    listed = map_arrow(docs.select("text"), keys, "key long, band int, class long")
    return map_arrow(listed.repartition("key").sortWithinPartitions("key", "class"), shared, "key long, band int, head long, class long")


def _sets(docs: DataFrame, firsts: DataFrame, classes: DataFrame, star: DataFrame, words: int) -> DataFrame:
    """class, its sorted hashes and its partner a of the star with the part it is dealt to, from the text of each class's first document (rows repeated in full give it once a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            fresh = []
            for c in b.column(0).to_pylist():
                fresh.append(c not in seen)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(c)
            b = b.filter(pa.array(fresh, pa.bool_()))
            hashes = [shingles(t, words) for t in b.column(3).to_pylist()]
            keep = pa.array([_digest(h) == c for c, h in zip(b.column(0).to_pylist(), hashes, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([h.tobytes() for h in hashes], pa.binary())], names=["class", "a", "part", "hashes"]).filter(keep)

    parts = star.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    dealt = star.join(parts, "a").select(F.col("b").alias("class"), "a", _part("b").alias("part"))
    wanted = firsts.join(classes, "class").join(dealt, "class", "left").select("class", "a", "part", "first", F.col("mark").alias("its"))
    return map_arrow(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("mark") == F.col("its"))).select("class", "a", "part", "text"), run, "class long, a long, part int, hashes binary")


def _part(column: str):
    return F.pmod(F.xxhash64(column), F.col("parts")).cast("int")


def _verified(pairs: DataFrame | None, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are linked; without pairs those of the star. Each a is dealt out by the number of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, centre, own = Bands(similarity), None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, _, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(raw, np.uint64)
                if b is None:
                    centre, own = a, h
                    continue
                if a != centre:
                    raise ValueError("a pair's first set is missing")
                band = bands.of(min(len(own), len(h)))[0]
                bound = int(np.minimum(bands.point(own, band), bands.point(h, band)).sum())
                if bound * (1 + similarity) >= similarity * (len(own) + len(h)) and linked(own, h, similarity):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    plain = sets.select("class", "hashes")
    if pairs is None:
        others = sets.where("a is not null").select("a", "part", F.col("class").alias("b"), "hashes")
        dealt_to = written(sets.where("a is not null").select("a", "part").distinct(), "dealt-to")  # a table of known size: where it is small, the join does not shuffle the sets
    else:
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
        dealt_pairs = written(pairs.join(parts, "a").select("a", "b", _part("b").alias("part")), "dealt-pairs")
        others = dealt_pairs.join(plain.withColumnRenamed("class", "b"), "b").select("a", "part", "b", "hashes")
        dealt_to = dealt_pairs.select("a", "part").distinct()
    centres = plain.withColumnRenamed("class", "a").join(dealt_to, "a").select("a", "part", F.lit(None).cast("long").alias("b"), "hashes")
    dealt = centres.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    found = written(map_arrow(dealt, run, "a long, b long"), "links")
    drop_written(dealt_to if pairs is None else dealt_pairs)
    return found


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of all ends of edges (a, b): smallest labels spread along edges, labels of labels follow."""
    both = written(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("n"))
        hop = labels.join(near, "x").select("x", "c", F.least("c", "n").alias("n"))
        up = labels.select(F.col("x").alias("n"), F.col("c").alias("up"))
        new = written(hop.join(up, "n").select("x", "c", F.least("n", "up").alias("n")), "labels")
        changed = new.where("c <> n").limit(1).count()
        drop_written(labels)
        labels = new.select("x", F.col("n").alias("c"))
        labels._vigil_path = new._vigil_path
        if not changed:
            drop_written(both)
            return labels.select(F.col("x").alias("id"), F.col("c").alias("component"))


def _tree_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: Fraction, forest: bool) -> DataFrame:
    """Pairs of classes in one block but in different components whose count vectors allow a link; of each block a forest only, if asked for."""
    labelled = members.select("key", "band", "class").join(labels.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = written(labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi"), "open-blocks")
    blocks = labelled.join(open_.where(F.col("n") <= BLOCK).select("key"), "key").withColumn("parts", F.lit(1))
    hot = open_.where(F.col("n") > BLOCK).select("key")
    if not hot.isEmpty():
        # linked sets that meet in no smaller block share two of these: they meet under every pair of their large blocks
        large = labelled.join(hot, "key").distinct()
        again = large.select("band", "class", F.col("key").alias("key_2"))
        both = large.join(again, ["class", "band"]).where("key < key_2").withColumn("key", F.xxhash64("key", "key_2")).drop("key_2")
        sizes = both.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("parts")).where("lo <> hi")
        blocks = blocks.unionByName(both.join(sizes.select("key", "parts"), "key").select(*blocks.columns))
    part = F.pmod(F.xxhash64("class", "key"), F.col("parts")).cast("int")
    rows = blocks.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "band", "class", "component")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        for b in batches:
            cls, band, size, point = [], [], [], []
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(raw, np.uint64)
                for k in bands.of(len(h)):
                    cls.append(c)
                    band.append(k)
                    size.append(len(h))
                    point.append(packed(bands.point(h, k)))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(band, pa.int32()), pa.array(size, pa.int64()), pa.array(point, pa.binary())], names=["class", "band", "size", "point"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, told = Bands(similarity), set()
        for cols in _runs(batches, 3):
            key, p, q, cls, comp, band, size, point = cols
            found = []
            edge = _edges_of(cols, 3)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a < 2 or (comp[a:b] == comp[a]).all():
                    continue
                wide = bands.dimensions(int(band[a]))
                pts = np.array([unpacked(x, wide) for x in point[a:b]])
                got, shares = RTree(pts, size[a:b], similarity).pairs(comp[a:b])
                if forest:
                    got = spanning(got, shares, comp[a:b])
                if len(got):
                    two = np.sort(cls[a:b][got], axis=1)
                    found += [x for x in map(tuple, two.tolist()) if x not in told]
                    told.update(found[-len(two) :])
                    if len(told) > REMEMBERED:
                        told.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*set(found), strict=True)], names=["a", "b"])

    pts = map_arrow(sets.select("class", "hashes"), points, "class long, band int, size long, point binary")
    dealt = rows.distinct().join(pts, ["class", "band"]).select("key", "p", "q", "class", "component", "band", "size", "point").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    found = written(map_arrow(dealt, search, "a long, b long").distinct(), "tree-pairs")
    drop_written(open_)
    return found


def _link_counts(classes: DataFrame, labels: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """class and n, the rows of other classes that it is linked with: all pairs of classes of one component, dealt out by pairs of sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        for cols in _runs(batches, 3):
            edge, names, counts = _edges_of(cols, 3), [], []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                cls, at = np.unique(cols[4][lo:hi], return_index=True)
                _, p, q, part, _, copies, raw = (c[lo:hi][at] for c in cols)
                hashes = [np.frombuffer(x, np.uint64) for x in raw]
                sizes = np.array([len(h) for h in hashes], np.int64)
                band = bands.of(int(sizes.max()))[0]
                points = [bands.point(h, band) for h in hashes]
                pairs, _ = RTree(np.array(points), sizes, similarity).pairs(part if p[0] != q[0] else np.arange(len(cls)))
                values, ids = np.unique(np.concatenate(hashes), return_inverse=True)
                ids, own, n = np.split(ids, np.cumsum(sizes)[:-1]), np.zeros(len(values), bool), np.zeros(len(cls), np.int64)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                for i, js in zip(*_grouped(pairs), strict=True):
                    own[ids[i]] = True
                    both = np.add.reduceat(own[np.concatenate([ids[j] for j in js])], np.concatenate([[0], np.cumsum(sizes[js])[:-1]]), dtype=np.int64)
                    own[ids[i]] = False
                    js = js[similarity.denominator * both >= similarity.numerator * (sizes[i] + sizes[js] - both)]
                    n[i] += copies[js].sum()
                    n[js] += copies[i]
                names.append(cls[n > 0])
                counts.append(n[n > 0])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (names, counts)], names=["class", "n"])

    copies = classes.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"))
    parts = labels.groupBy("component").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts"))
    sided = labels.select(F.col("id").alias("class"), "component").join(parts, "component").join(copies, "class").withColumn("part", _part("class")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = sets.select("class", "hashes").join(sided, "class").select("component", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "class", "copies", "hashes")
    dealt = rows.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")
    return map_arrow(dealt, run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))


def _grouped(pairs: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The first ends of pairs sorted by them, and the second ends of each."""
    first, at = np.unique(pairs[:, 0], return_index=True)
    return first.tolist(), np.split(pairs[:, 1], at[1:]) if len(first) else []


def _least(doc_id: str, mark: str):
    """The smallest (doc_id, mark), null ids last."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(mark).alias("mark"))).alias("least")


def _joined(docs: DataFrame, words: int, similarity: Fraction) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, mark, n_shingles, class), mark being a hash of the text, the classes (class, first, mark, component, component_id), the labels of linked classes and the sets of classes that share a block."""

    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_ = [shingles(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(h) for h in sets_], pa.int64()), pa.array([_digest(h) if len(h) else None for h in sets_], pa.int64())], names=["doc_id", "mark", "n_shingles", "class"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    classes = written(map_arrow(docs, classes_of, "doc_id long, mark long, n_shingles long, class long"), "classes")
    firsts = classes.where("class is not null").groupBy("class").agg(_least("doc_id", "mark")).select("class", F.col("least.id").alias("first"), "least.mark")
    members = written(_blocks(docs, words, similarity), "blocks")
    heads = members.where("head <> class").groupBy("head", "class").count()
    star = written(heads.groupBy(F.col("class").alias("b")).agg(F.max_by("head", F.struct("count", "head")).alias("a")), "star")
    sets = written(_sets(docs, firsts, members.select("class").distinct(), star, words), "sets")
    found = [_verified(None, sets, similarity)]
    labels = components(found[0])
    for forest in (True, False):
        pairs = _tree_pairs(members, labels, sets, similarity, forest)
        found.append(_verified(pairs, sets, similarity))
        labels = components(reduce(DataFrame.union, found))
        drop_written(pairs)
    drop_written(members, star, *found)
    first_of = firsts.join(labels.select(F.col("id").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = first_of.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = first_of.join(smallest, "component").select("class", "first", "mark", "component", "component_id")
    return classes, by_class, labels, sets


def near_copies(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    classes, by_class, _, sets = _joined(docs, words, similarity)
    drop_written(sets)
    return classes.join(by_class.select("class", "component_id"), "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_links(docs: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """near_copies() with class_id, the smallest doc_id of equal sets, and n_links, the number of other rows that the row is linked with."""
    classes, by_class, labels, sets = _joined(docs, words, similarity)
    others = written(_link_counts(classes, labels, sets, similarity), "link-counts")
    drop_written(sets)
    copies = classes.where("class is not null").groupBy("class").agg((F.count("*") - 1).alias("copies"))
    counted = by_class.select("class", "first", "component_id").join(copies, "class").join(others, "class", "left").withColumn("n_links", F.col("copies") + F.coalesce("n", F.lit(0)))
    ids = (F.coalesce(c, "doc_id").alias(name) for c, name in (("first", "class_id"), ("component_id", "component_id")))
    return classes.join(counted, "class", "left").select("doc_id", "n_shingles", *ids, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op2_near_copies(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op2_near_links(spark, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "documents"))


def keep_firsts(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies one row with the smallest doc_id stays, and each row without words (five-word shingles, similarity 0.8). Null ids come last."""
    classes, by_class, _, sets = _joined(docs, 5, Fraction(80, 100))
    drop_written(sets)
    key = lambda c: (F.coalesce(c, F.lit(0)).alias("id"), c.isNull().alias("none"))
    firsts = by_class.groupBy("component").agg(_least("first", "mark")).select(*key(F.col("least.id")), "least.mark", F.lit(True).alias("one"))
    kept = firsts.union(classes.where("class is null").select(*key(F.col("doc_id")), "mark", F.lit(False)).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key(F.col("doc_id").cast("long")), F.xxhash64("text").alias("mark")).join(kept, ["id", "none", "mark"])
    turn = F.row_number().over(Window.partitionBy("id", "none", "mark").orderBy("row"))
    return rows.withColumn("turn", turn).where("turn = 1 or not one").select("row.*")
