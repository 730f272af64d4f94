"""Spelling variants: frequent words one edit apart, found by sharded Aho-Corasick automata.

A word is two segments, its first half and the rest. One inserted, deleted or replaced code
point leaves one of them whole, so a near word has it at its own beginning (first half) or
end (rest). Segments are dealt by length class and hash to shards of about SHARD_SEGMENTS
segments; a shard's automaton scans every word whose length is at most one off, block by
block of BLOCK_WORDS words. A hit counts if it lies at the beginning or end that it should,
and the other parts, looked up among those that share the segment, are one edit apart.
Each pair of words is found once from either side, also where both segments are whole.

A task holds one shard and streams a block; it returns a row for each word with near words.
The work is (words of a length)^2 / (SHARD_SEGMENTS * BLOCK_WORDS) tasks, each of bounded size.

Defined results: null text has no words; a null doc_id counts as the empty text in the
crc; repeated rows count each; of near words with equal counts the first in code-point
order is the form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, map_arrow, table, written

WORD = "[A-Za-z\u00C0-\u00FF]+"
DAMAGED, LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 97, 5, 3, 2
SHARD_SEGMENTS, BLOCK_WORDS = 60_000, 200_000
#: Words of this many code points or more are one length class.
LONG = 48
#: Distinct words whose counts a task gathers before it hands them on.
GATHERED = 200_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of docs (doc_id, text): runs of letters; every run whose crc with the doc_id DAMAGED divides has lost a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, sums = re.compile(WORD).findall, Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], names=["word", "n"])
            sums.clear()
            return batch

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(find(text.translate(_LOWER))).items():
                    h = zlib.crc32(run.encode(), head)
                    if not h % DAMAGED:
                        i = h % len(run)
                        run = run[:i] + run[i + 1 :]
                    if len(run) >= LEAST_LENGTH:
                        sums[run] += n
                if len(sums) >= GATHERED:
                    yield out()
        if sums:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").where("text is not null")
    return map_arrow(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _class(length: Column) -> Column:
    return F.least(length, F.lit(LONG))


def gaps(text: str) -> set[str]:
    """text without one of its code points, each way."""
    return {text[:i] + text[i + 1 :] for i in range(len(text))}


class Shard:
    """Segments of words (word, n, first half?), and the near words of others by one scan each.

    longer: by how many code points the words that are scanned may be longer: some of -1, 0, 1.
    """

    def __init__(self, words: list[tuple[str, int, bool]], longer: set[int]):
        import ahocorasick

        self.words, self.longer = words, longer
        segments: dict[str, int] = {}
        #: of each segment: (those that are first halves, those that are rests), by pattern of the other part
        self.others: list[tuple[dict, dict]] = []
        automaton = ahocorasick.Automaton()
        for at, (word, _, first) in enumerate(words):
            half = len(word) // 2
            segment, other = (word[:half], word[half:]) if first else (word[half:], word[:half])
            i = segments.setdefault(segment, len(segments))
            if i == len(self.others):
                self.others.append((defaultdict(list), defaultdict(list)))
                automaton.add_word(segment, (i, len(segment)))
            by = self.others[i][not first]
            if 1 in longer:
                by[other].append(at)
            if -1 in longer:
                for g in gaps(other):
                    by[g, -1].append(at)
            if 0 in longer:
                for j in range(len(other)):
                    by[other[:j] + other[j + 1 :], j].append(at)
        automaton.make_automaton()
        self.scan = automaton.iter

    def near(self, word: str) -> list[int]:
        """Places of the words one edit from word whose first half is at its beginning, or else whose rest is at its end."""
        found, words, size = [], self.words, len(word)
        for end, (i, length) in self.scan(word):
            for rest, by in enumerate(self.others[i]):
                if not by or (end + 1 != size if rest else end + 1 != length):
                    continue
                other = word[:-length] if rest else word[length:]
                hits = set(by.get((other, -1), ()))
                if 0 in self.longer:
                    for j in range(len(other)):
                        hits.update(by.get((other[:j] + other[j + 1 :], j), ()))
                if 1 in self.longer:
                    for g in gaps(other):
                        hits.update(by.get(g, ()))
                for at in hits:
                    near = words[at][0]
                    if near != word and not (rest and word.startswith(near[: len(near) // 2])):
                        found.append(at)
        return found


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of the words (word, n) that have near words; form is that of largest n."""
    spark = words.sparkSession
    sized = words.withColumn("c", _class(F.length("word")))
    sizes = {r["c"]: r["count"] for r in sized.groupBy("c").count().collect()}  # LONG rows at most
    shards = {c: math.ceil(2 * n / SHARD_SEGMENTS) for c, n in sizes.items()}
    blocks = {c: math.ceil(n / BLOCK_WORDS) for c, n in sizes.items()}
    # a task for each shard of segments and block of words whose lengths are at most one apart
    tasks = {k: i for i, k in enumerate((c, s, d, b) for c in sizes for s in range(shards[c]) for d in (c - 1, c, c + 1) if d in sizes for b in range(blocks[d]))}
    first_task = {(c, d): tasks[c, 0, d, 0] for c in sizes for d in (c - 1, c, c + 1) if d in sizes}
    width = {c: sum(blocks.get(d, 0) for d in (c - 1, c, c + 1)) for c in sizes}  # tasks of one shard
    if not tasks:
        return spark.createDataFrame([], "word string, n_near long, form string, form_n long")

    def number(c: Column, d: Column, shard: Column, block: Column) -> Column:
        start = F.element_at(F.create_map(*(x for (a, b), t in first_task.items() for x in (F.lit(a * 1000 + b), F.lit(t)))), c * 1000 + d)
        return start + shard * of(width, c) + block

    def of(values: dict[int, int], c: Column) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v)))), c), F.lit(0))

    def both(c: Column) -> Column:
        return F.explode(F.filter(F.array(c - 1, c, c + 1), lambda d: of(blocks, d) > 0))

    half = "cast(floor(length(word) / 2) as int)"
    segment = F.when(F.col("first"), F.expr(f"left(word, {half})")).otherwise(F.expr(f"substring(word, {half} + 1)"))
    held = sized.withColumn("first", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("shard", F.pmod(F.xxhash64(segment, "first"), of(shards, F.col("c"))).cast("int"))
    held = held.withColumn("d", both(F.col("c"))).withColumn("block", F.explode(F.sequence(F.lit(0), of(blocks, F.col("d")) - 1)))
    asked = sized.withColumnRenamed("c", "d").withColumn("block", F.pmod(F.xxhash64("word"), of(blocks, F.col("d"))).cast("int")).withColumn("c", both(F.col("d")))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), of(shards, F.col("c")) - 1))).withColumn("first", F.lit(None).cast("boolean"))
    task = number(F.col("c"), F.col("d"), F.col("shard"), F.col("block")).alias("task")
    names = ["word", "n", "first"]
    dealt = held.select(task, *names).unionByName(asked.select(task, *names)).repartition(len(tasks), "task").sortWithinPartitions("task", F.col("first").isNull())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, held = None, None, []
        for b in batches:
            got = []
            for task, word, n, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if task != now:
                    now, shard, held = task, None, []
                if first is not None:
                    held.append((word, n, first))
                    continue
                if held:  # all segments of the shard have come
                    c, d = min(len(held[0][0]), LONG), min(len(word), LONG)
                    shard, held = Shard(held, {d - c} if max(c, d) < LONG else {-1, 0, 1}), []
                if shard and (found := shard.near(word)):
                    most, form = min((-shard.words[i][1], shard.words[i][0]) for i in found)
                    got.append((word, len(found), form, -most))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "form", "form_n"])

    found = map_arrow(dealt, search, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("least"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.least")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form (word, form): forms are followed to the last, twice as far each round. Counts double with each form, so there are few rounds."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling")
    while not at.where("moved").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = at.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        at, old = written(moved, "spelling"), at
        drop_written(old)
    return at.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text) with at least LEAST_COUNT occurrences."""
    words = written(word_counts(docs).where(F.col("n") >= LEAST_COUNT), "spelling")
    near = near_words(words)
    has = F.col("_n") >= F.col("n") * FORM_TIMES
    near = near.withColumnsRenamed({"form": "_form", "form_n": "_n"})
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("_form")).alias("form"), F.when(has, F.col("_n")).alias("form_n"))
    named = written(named, "spelling")
    followed = roots(named.where("form is not null"))
    return named.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
