"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages of words. A passage is a TF-IDF vector over
hashed words; a distributed randomised SVD of all passages gives a latent space. A
passage whose latent cosine with a benchmark passage is high is a candidate. Candidates are verified in the document:
by the longest common subsequence of words with the item, and by the item's answer (its
rarest words, in order of appearance) being there.

Short items and paraphrases in longer texts can fall below the latent gate. So a second
route takes every place where enough of an item's answer words stand within SPREAD times
its length, whatever the cosine. All items of LEAST words or more whose common
subsequence and answer lie within such a span are found by it.

Document frequencies, the SVD and the search cover all documents and whole texts. What
reaches the driver is bounded by BUCKETS and RANK, not by the corpus. Benchmark items
are broadcast in parts of about ITEMS_BYTES; more are searched in several rounds.
What the latent search proposes is held to the same span, so both routes report the
same items, and no share comes from words further apart.

Defined results: null or empty texts match nothing; items with fewer than LEAST words
must stand in the text word for word; items without item_id are looked for, too, and
reported with a null one; items of one item_id are one item of several texts, whose
largest share counts; documents with null doc_id are judged like others; repeated rows
are judged each; other columns are ignored; empty documents or an empty benchmark give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table, written

BUCKETS = 1 << 14
RANK, OVERSAMPLED = 64, 8
#: Words of a passage and between the starts of passages.
PASSAGE, STRIDE = 32, 16
#: A passage of fewer words than this has no vector of its own.
LEAST = 8
COSINE = 0.42
#: Share of an item's words that the common subsequence must hold, in at most SPREAD times its length.
COMMON, SPREAD = 0.7, 1.5
ANSWER_WORDS, ANSWER_SHARE = 5, 0.6
ITEMS_BYTES = 8 << 20
#: Sketches that one task adds up.
SUMMED = 64
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return (text or "").lower().encode().translate(_LOWER).split()


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of words_of(text), from each word's first and last eight bytes and its length."""
    raw = b" " + (text or "").lower().encode().translate(_LOWER) + b" " * 9
    solid = np.frombuffer(raw, np.uint8) != 32
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    head = eight[start] & _MASKS[np.minimum(size, 8)]
    tail = eight[start + np.maximum(size - 8, 0)] & _MASKS[np.minimum(size, 8)]
    x = (head * _MIX ^ head >> np.uint64(29)) + tail * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)
    return (x ^ x >> np.uint64(32)) * _MIX


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 14)).astype(np.int32)


def bucket_ids(text: str | None) -> np.ndarray:
    """Hash buckets of words_of(text)."""
    return buckets_of(word_hashes(text))


def passages(texts: list[str | None]) -> np.ndarray:
    """Bucket ids of the texts' passages laid end to end (rows of PASSAGE; BUCKETS fills up the last)."""
    out = [np.full(0, 0, np.int32)]
    for t in texts:
        ids = bucket_ids(t)
        if len(ids) >= LEAST:
            out += [ids, np.full(-len(ids) % PASSAGE, BUCKETS, np.int32)]
    return np.concatenate(out).reshape(-1, PASSAGE)


def starts_of(n: int, size: int = PASSAGE, stride: int = STRIDE) -> np.ndarray:
    """Where passages start: every stride, the last one ending with the text."""
    if n < LEAST:
        return np.zeros(0, np.int64)
    if n <= size:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - size + 1, stride)
    return s if s[-1] == n - size else np.append(s, n - size)


def random_rows(n: int, k: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, k)).astype(np.float32)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """In how many whole passages (laid end to end) each bucket occurs, their number, and that of the tasks that had any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            rows = np.sort(passages(b.column(0).to_pylist()), axis=1)
            first = np.ones(rows.shape, bool)
            first[:, 1:] = rows[:, 1:] != rows[:, :-1]
            seen += np.bincount(rows[first], minlength=BUCKETS + 1)[:BUCKETS]
            n += len(rows)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, BUCKETS)), pa.array(np.concatenate([[1, n], seen]))], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 2, np.int64)
    for bucket, n in map_arrow(docs.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS + 2 rows
        out[bucket + 2] = n
    return out[2:], int(out[1]), int(out[0])


def latent_space(docs: DataFrame, idf: np.ndarray, tasks: int, rank: int = RANK) -> np.ndarray:
    """Rows of the latent space by bucket (BUCKETS x rank), weighted by idf.

    Randomised range finder: every one of about `tasks` tasks sums A'(A O) over its passages A for
    random O, the sums meet by blocks of buckets, and one task orthogonalises the result (Nystroem).
    """
    k = rank + OVERSAMPLED
    block = 512

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        omega = np.concatenate([random_rows(BUCKETS, k) * idf[:, None], np.zeros((1, k), np.float32)]).T.copy()
        squares = np.append(idf, 0) ** 2
        total = np.zeros((k, BUCKETS + 1))
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), 256):
                rows = passages(texts[i : i + 256])
                flat = rows.ravel()
                length = np.maximum(squares[rows].sum(axis=1), 1e-9)  # passages count alike, whatever their weight
                for j in range(k):
                    y = omega[j][flat].reshape(rows.shape).sum(axis=1) / length
                    total[j] += np.bincount(flat, np.repeat(y, PASSAGE), BUCKETS + 1)
        total = (total[:, :BUCKETS] * idf).T.astype(np.float32)  # half as much to send; sums of them are doubles
        at = np.arange(0, BUCKETS, block)
        for i in at.tolist():
            yield sums_of(i, TaskContext.get().partitionId(), total[i : i + block])

    def sums_of(at: int, part: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["at", "part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = None, None
        for b in batches:
            for at, part, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != (at, part):
                    if own:
                        yield sums_of(*own, sums)
                    own, sums = (at, part), np.zeros(block * k)
                sums += np.frombuffer(raw, np.float32 if len(raw) == 4 * block * k else np.float64)
        if own:
            yield sums_of(*own, sums)

    summed = map_arrow(docs.select("text"), product, "at long, part long, sums binary")
    while tasks > 1:  # a task adds up to SUMMED sketches of one block of buckets, so the rounds grow, not the tasks
        tasks = -(-tasks // SUMMED)
        grouped = summed.withColumn("part", F.pmod("part", F.lit(tasks))).repartition("at", "part").sortWithinPartitions("at", "part")
        summed = map_arrow(grouped, added, "at long, part long, sums binary")

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = np.zeros((BUCKETS, k))
        for b in batches:
            for at, _, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                b_[at : at + block] += np.frombuffer(raw, np.float32 if len(raw) == 4 * block * k else np.float64).reshape(block, k)
        if not b_.any():
            return
        omega = random_rows(BUCKETS, k).astype(np.float64)
        core = omega.T @ b_
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > values.max() * 1e-9
        f = b_ @ (vectors[:, good] / np.sqrt(values[good]))
        u, scale, _ = np.linalg.svd(f, full_matrices=False)
        u = u[:, :rank] / scale[:rank]  # every latent dimension counts alike
        yield pa.RecordBatch.from_arrays([pa.array([(u * 1e3).astype(np.float32).tobytes()], pa.binary())], names=["space"])

    got = map_arrow(summed.repartition(1), decompose, "space binary").collect()  # BUCKETS / block rows meet; one row returns
    return np.frombuffer(got[0][0], np.float32).reshape(BUCKETS, -1) * idf[:, None] if got else np.zeros((BUCKETS, 1), np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of a (bit-parallel rows over b)."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = at.get(y, 0)
        u = row & m
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Finder:
    """Searches texts for benchmark items."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, space: np.ndarray, cosine: float = COSINE):
        self.space, self.cosine = space.T.copy(), cosine
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        vectors, own = [], []
        for k, (_, t) in enumerate((i, t) for i, t in items if words_of(t)):
            ids = bucket_ids(t)
            for x in starts_of(len(ids)):
                vectors.append(space[ids[x : x + PASSAGE]].sum(axis=0))
                own.append(k)
        self.own = np.array(own, np.int64)
        v = np.array(vectors, np.float32).reshape(-1, space.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.answers = []
        for _, w in self.items:
            first = list(dict.fromkeys(w))
            rare = sorted(first, key=lambda x: (-float(idf[bucket_ids(x.decode())[0]]), -len(x), x))[:ANSWER_WORDS]
            self.answers.append(frozenset(rare))
        long = [k for k, (_, w) in enumerate(self.items) if len(w) >= LEAST]
        self.span = np.array([ceil(SPREAD * len(w)) for _, w in self.items], np.int64)
        self.need = np.array([ceil(ANSWER_SHARE * len(a) - 1e-9) for a in self.answers], np.int64)
        listed = sorted((int(word_hashes(x.decode())[0]), k) for k in long for x in self.answers[k])
        hashes = np.array([h for h, _ in listed], np.uint64)
        self.answer_items = np.array([k for _, k in listed], np.int64)
        self.answer_hashes, first = np.unique(hashes, return_index=True)
        self.answer_from = np.append(first, len(hashes))
        self.flags = np.zeros(BUCKETS, bool)
        self.flags[buckets_of(self.answer_hashes)] = True
        self.short = [(i, b" " + b" ".join(w) + b" ") for i, w in self.items if len(w) < LEAST]

    def places(self, hashes: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(text, start, item) where as many answer words as the item needs stand within its span; a word may count twice here."""
        base, flat = np.cumsum([0, *(len(x) for x in hashes)]), np.concatenate(hashes)
        at = np.flatnonzero(self.flags[buckets_of(flat)])
        if not len(at):
            return
        k = np.minimum(np.searchsorted(self.answer_hashes, flat[at]), len(self.answer_hashes) - 1)
        hit = self.answer_hashes[k] == flat[at]
        at, k = at[hit], k[hit]
        n = self.answer_from[k + 1] - self.answer_from[k]
        item = self.answer_items[np.repeat(self.answer_from[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        text = np.searchsorted(base, at, side="right") - 1
        order = np.lexsort((at, item, text))
        at, item, text = at[order], item[order], text[order]
        last = np.arange(len(at)) + self.need[item] - 1
        fit = last < len(at)
        last = np.minimum(last, len(at) - 1)
        fit &= (text[last] == text) & (item[last] == item) & (at[last] - at < self.span[item])
        yield from zip(text[fit].tolist(), (at - base[text])[fit].tolist(), item[fit].tolist(), strict=True)

    def closest(self, words: list[bytes], start: int, item: int, share: float) -> float:
        """Largest share, above the given one, of the item's words in a common subsequence with a span of the text that holds start and the answer, or 0. An answer word stands at start."""
        return self.best(words, start - int(self.span[item]) + 1, start, item, share)

    def best(self, words: list[bytes], first: int, last: int, item: int, share: float) -> float:
        """Largest share, above the given one, of the item's words in a common subsequence with a span of the text that begins from first to last and holds the answer, or 0."""
        want, span, answer = self.items[item][1], int(self.span[item]), self.answers[item]
        n, lo = len(want), max(0, first)
        least = max(COMMON * n - 1e-9, share * n + 1e-9)
        around = words[lo : last + span]
        if len(answer.intersection(around)) < self.need[item] or common_subsequence(want, around) < least:
            return 0.0
        best, own = 0, set(want)
        for s in range(min(last, len(words) - 1), lo - 1, -1):
            if words[s] not in own:
                continue
            part = words[s : s + span]
            if len(answer.intersection(part)) >= self.need[item]:
                best = max(best, common_subsequence(want, part))
                if best == n:
                    break
        return best / n if best >= least else 0.0

    def candidates(self, texts: list[str | None], hashes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, starts of passages, items) for texts that have passages with a high latent cosine to an item's."""
        ids = [buckets_of(x) for x in hashes]
        starts = [starts_of(len(x)) for x in ids]
        own = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        if not len(own) or not len(self.own):
            return
        base = np.cumsum([0, *(len(x) for x in ids)])
        size = np.diff(base)
        start = np.concatenate(starts)
        lo = start + base[own]
        hi = np.minimum(lo + PASSAGE, base[own] + size[own])
        flat = np.concatenate(ids)
        v = np.empty((len(self.space), len(lo)), np.float32)
        total = np.zeros(len(flat) + 1)
        for j, column in enumerate(self.space):
            np.cumsum(column[flat], out=total[1:], dtype=np.float64)
            v[j] = total[hi] - total[lo]
        v /= np.maximum(np.sqrt((v * v).sum(axis=0)), 1e-9)
        for k in range(0, len(lo), 8192):
            i, j = np.nonzero(v[:, k : k + 8192].T @ self.vectors.T >= self.cosine)
            text = own[k + i]
            cut = np.flatnonzero(np.diff(text, prepend=-1))
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(text))[: len(cut)].tolist(), strict=True):
                yield int(text[a]), start[k + i[a:b]], self.own[j[a:b]]

    def verify(self, words: list[bytes], start: int, item: int, share: float) -> float:
        """The same over all spans that meet the passage at start."""
        return self.best(words, start - int(self.span[item]) + 1, start + PASSAGE - 1, item, share)

    def find(self, texts: list[str | None]) -> list[dict[int, float]]:
        """For each text: item id -> share of its words found, for items that the text holds."""
        out: list[dict[int, float]] = [{} for _ in texts]
        hashes = [word_hashes(t) for t in texts]
        for text, starts, items in self.candidates(texts, hashes):
            words = words_of(texts[text])
            present = self._present(words, set(items.tolist()))
            for s, k in zip(starts.tolist(), items.tolist(), strict=True) if present else ():
                name = self.items[k][0]
                if k in present and out[text].get(name, 0) < 1:
                    share = self.verify(words, s, k, out[text].get(name, 0))
                    if share:
                        out[text][name] = share
        own, words = -1, []
        for text, start, k in self.places(hashes):
            name = self.items[k][0]
            if out[text].get(name, 0) == 1:
                continue
            if text != own:
                own, words = text, words_of(texts[text])
            share = self.closest(words, start, k, out[text].get(name, 0))
            if share:
                out[text][name] = share
        for text, found in zip(texts, out, strict=True) if self.short else ():
            joined = b" " + b" ".join(words_of(text)) + b" "
            found |= {i: 1.0 for i, w in self.short if w in joined}
        return out

    def _present(self, words: list[bytes], items: set[int]) -> set[int]:
        have = set(words)
        return {k for k in items if len(self.answers[k] & have) >= ANSWER_SHARE * len(self.answers[k])}


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id and share of every document of docs (doc_id, text) that holds an item of benchmark (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    items = written(benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-size // ITEMS_BYTES))
    seen, n, tasks = frequencies(docs)
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32)
    space = latent_space(docs, idf, tasks)
    space_ = spark.sparkContext.broadcast((idf, space))  # BUCKETS x RANK floats
    out = None
    for k in range(rounds):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k).orderBy("item_id", "text").collect()]  # about ITEMS_BYTES
        items_ = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], items_=items_) -> Iterator[pa.RecordBatch]:
            finder = Finder(items_.value, *space_.value, cosine)
            for b in batches:
                names, texts = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)), b.column(1).to_pylist()
                rows = []
                for k in range(0, len(texts), 128):
                    rows += [(*d, i, s) for d, found in zip(names[k : k + 128], finder.find(texts[k : k + 128]), strict=True) for i, s in sorted(found.items(), key=lambda x: (x[0] is None, x[0] or 0))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "row", "item_id", "share"])

        found = map_arrow(docs, search, "doc_id long, row long, item_id long, share double")
        out = found if out is None else out.union(found)
    if rounds > 1:  # texts of one item can be in several rounds
        out = out.groupBy("doc_id", "row", "item_id").agg(F.max("share").alias("share"))
    return out.drop("row")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text holds a benchmark item go, whatever their doc_id."""
    mark = F.xxhash64("text")
    found = written(contaminated(docs.select(mark.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return docs.join(found.select(F.col("doc_id").alias("its_mark")), mark == F.col("its_mark"), "left_anti").select(*docs.columns)
