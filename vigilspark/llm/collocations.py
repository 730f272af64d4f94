"""Phrase collocations: scored phrases of 2 to 5 words, counted in DuckDB by hash bucket.

1. Texts become pieces between punctuation; identical pieces of a language are one row with
   a multiplicity, so copies and repeated lines cost one row however many there are.
2. Words are counted. A word of fewer than LEAST occurrences is in no candidate, so runs end
   there: a bitmap of fixed size (FILTER_BITS) tells tasks which words may be frequent (a
   false yes costs time only).
3. Every place of a piece gives its run of up to 5 such words. Runs are dealt to buckets by
   hash of their first words: two, or as many as it takes to meet a word that holds less
   than 1/HEAVY of all words, so no key holds a larger share. They travel compressed, a
   block for each bucket, as its words and rows of their numbers. A bucket's task counts all
   beginnings of its runs, as rows of numbers, in a DuckDB that spills to the task's own disk. Only phrases of
   heavy words alone can be in several buckets; their counts are added up.
4. Cuts: each candidate sends a lookup request for both parts of each cut; requests and
   counts meet by a shuffle on (lang, part), and the answers by one on the candidate.
5. A candidate sends its count to its beginning and its end of one word less; one that gets
   its own count back is dropped. (Counts fall with length, so those two tell of all.)

Defined results: null text has no pieces, null lang is `und`; doc_id is not used, repeated
rows count each; ties in score and count go by phrase; an empty table gives no rows; other
columns are ignored. A word longer than all memory aside, texts of any length are whole.
"""

from __future__ import annotations

import os
import shutil
import struct
import tempfile
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, map_arrow, table, written

MOST_WORDS, LEAST, TOP, SCALE = 5, 100, 2000, 1000
#: Bits of the bitmap of words that may be frequent (2 MB).
FILTER_BITS = 24
#: Runs that begin with words which hold 1/HEAVY of all words or more (or half a task's share, if less) are dealt by more words.
HEAVY = 256
#: Places of words that a task gathers before it hands on their runs, and bytes of text or of rows.
GATHERED, GATHERED_BYTES = 1_600_000, 16 << 20
#: Places of words that one counting task, which is one hash bucket, gets on average, at most.
RUNS_PER_TASK = 4_000_000
#: Memory of the DuckDB of one task; it spills beyond.
DUCKDB_MEMORY = "200MB"
#: Parts of a language in each of which the first TOP are found before the last ranking.
RANK_PARTS = 64
#: Bytes that end a piece become line feeds, A-Z become lower case.
_TO_PIECES = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (its words with single spaces), m (how often it occurs)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: defaultdict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            langs = [lang for lang, own in sums.items() for _ in range(len(own))]
            columns = [pa.array(langs, pa.string()), pa.array([p for own in sums.values() for p in own], pa.binary()).cast(pa.string()), pa.array([m for own in sums.values() for m in own.values()], pa.int64())]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "m"])

        held = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # bytes beyond ASCII are no white space here
                found = [b" ".join(p.split()) for p in text.encode().translate(_TO_PIECES).split(b"\n")]
                sums[lang].update(found)
                held += len(text)
                if held >= GATHERED_BYTES:
                    for own in sums.values():
                        own.pop(b"", None)
                    yield out()
                    held = 0
        for own in sums.values():
            own.pop(b"", None)
        if any(sums.values()):
            yield out()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    return map_arrow(rows, cut, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _slot(lang: Column, word: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit("\0"), word).cast("binary")).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def frequent_filter(words: DataFrame) -> bytes:
    """Bitmap of the slots of words (lang, word): FILTER_BITS bits, whatever their number."""
    slot = _slot(F.col("lang"), F.col("word")) + 1
    rows = words.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    size = len(rows[0]["bits"]) if rows else 4096
    out = bytearray((1 << FILTER_BITS) // 8)
    for r in rows:  # buckets are numbered from 1, and their first bit is that of a multiple of their size
        at = (r["k"] - 1) * size
        out[at : at + size] = r["bits"]
    return bytes(out)


def _head_hash(lang: str, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the first `size` words of each run; ids are numbers of words, 0 for none, and hashes theirs."""
    out = np.full(len(ids), zlib.crc32(lang.encode()), np.uint64)
    for j in range(ids.shape[1]):
        mixed = (out ^ hashes[ids[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
        out = np.where(j < size, mixed ^ mixed >> np.uint64(29), out)
    return out >> np.uint64(8)


def _order(columns: list[np.ndarray], limits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by columns of numbers below their limits, and whether each row in this order differs from the one before."""
    keys, room = [], 1
    for column, limit in zip(columns, limits, strict=True):  # as many columns to a key as 63 bits hold
        if not keys or room * limit >= 1 << 63:
            keys.append(column.astype(np.int64))
            room = limit
        else:
            keys[-1] = keys[-1] * limit + column
            room *= limit
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order, new


def _planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next: high bytes are alike and compress well."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _unplaned(data: bytes, kind: np.dtype, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).ravel()


def _runs_of(lang: str, texts: pa.Array, times: np.ndarray, bitmap: bytes, weighty: set[str], buckets: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of the runs in pieces of one language; _read_blocks() reads blocks."""
    cut = pc.split_pattern(texts, " ")
    coded = cut.values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    raw = [w.encode() for w in words]
    prefix, mask = zlib.crc32(f"{lang}\0".encode()), (1 << FILTER_BITS) - 1
    crcs = np.fromiter((zlib.crc32(w, prefix) for w in raw), np.uint32, len(raw))
    slots = crcs & mask
    yes = (np.frombuffer(bitmap, np.uint8)[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
    at = coded.indices.to_numpy()
    n = len(at)
    last = np.zeros(n, bool)
    last[cut.offsets.to_numpy()[1:] - 1] = True  # a piece has words
    # where the stretch of words that may be frequent ends for each place: behind the piece's last word, or at a word that isn't
    place = np.arange(n, dtype=np.int32)
    stop = np.where(~yes[at], place, np.where(last, place + 1, n))
    length = np.minimum(np.minimum.accumulate(stop[::-1])[::-1] - place, most)
    starts = np.flatnonzero(length >= 2)
    if not len(starts):
        return
    length = length[starts]
    times = np.repeat(times, np.diff(cut.offsets.to_numpy()))[starts]
    ids = np.zeros((len(starts), most), np.int32)  # of words, from 1
    for j in range(most):
        has = length > j
        ids[has, j] = at[starts[has] + j] + 1
    heavy = np.append(False, np.fromiter((w in weighty for w in words), bool, len(words)))
    lead = np.logical_and.accumulate(heavy[ids], axis=1).sum(axis=1)
    head = np.minimum(np.maximum(lead + 1, 2), length)  # goes on to the first word that isn't heavy
    bucket = (_head_hash(lang, np.append(0, crcs).astype(np.uint64), ids, head) % np.uint64(buckets)).astype(np.int64)
    order, new = _order([bucket, *ids.T], [buckets, *[len(words) + 1] * most])
    first = np.flatnonzero(new)
    times = np.add.reduceat(times[order], first)
    ids, lead, bucket = (x[order[first]] for x in (ids, lead, bucket))
    # the words of each block: places of (bucket, word), each once
    spread = np.repeat(bucket, most)
    flat = ids.ravel()
    has = flat > 0
    key = spread[has] * (len(words) + 1) + flat[has]
    own, local = np.unique(key, return_inverse=True)
    of_bucket, of_word = own // (len(words) + 1), own % (len(words) + 1) - 1
    begins = np.searchsorted(of_bucket, bucket)
    flat = np.zeros_like(flat)
    flat[has] = local + 1 - np.repeat(begins, most)[has]
    ids = flat.reshape(-1, most)
    lead = lead.astype(np.uint8)
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    for a, b in pairwise(edges.tolist()):
        k = bucket[a]
        lo, hi = np.searchsorted(of_bucket, [k, k + 1]).tolist()
        listed = b"\n".join([raw[i] for i in of_word[lo:hi].tolist()])
        narrow = np.uint16 if hi - lo < 1 << 16 else np.int32
        name = lang.encode()
        yield int(k), b"".join([struct.pack("<QQQ", len(name), len(listed), b - a), name, listed, _planes(ids[a:b].T.astype(narrow)), lead[a:b].tobytes(), _planes(times[a:b])])


def _read_blocks(data: bytes, most: int) -> Iterator[tuple[bytes, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """The language and the words of each block, then for each run the numbers of its words from 1 (0 for none), lead and m."""
    at = 0
    while at < len(data):
        name, size, n = struct.unpack_from("<QQQ", data, at)
        at += 24 + name + size
        words = data[at - size : at].split(b"\n")
        narrow = np.dtype(np.uint16 if len(words) < 1 << 16 else np.int32)
        ids = _unplaned(data, narrow, n * most, at).reshape(most, n)
        to = at + narrow.itemsize * n * most
        yield data[at - size - name : at - size], words, ids, np.frombuffer(data, np.uint8, n, to), _unplaned(data, np.dtype(np.int64), n, to + n)
        at = to + 9 * n


def runs(found: DataFrame, bitmap: bytes, heavy: set[tuple[str, str]], buckets: int, most: int = MOST_WORDS) -> DataFrame:
    """bucket, data: runs of up to `most` words at every place whose word and the next may be frequent.

    data is Zstandard of a block for each language: its words, and runs as numbers of words with m and lead, which is how many
    words the run begins with are heavy. Equal runs of what a task gathers are added up.
    """
    heavy_of: dict[str, set[str]] = {}
    for lang, word in heavy:
        heavy_of.setdefault(lang, set()).add(word)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=6).compress
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            held.clear()
            made: defaultdict[int, list[bytes]] = defaultdict(list)
            for lang in pc.unique(rows.column(0)).to_pylist():
                own = rows.filter(pc.equal(rows.column(0), lang))
                texts = own.column(1).cast(pa.large_string()).combine_chunks()
                for k, block in _runs_of(lang, texts, own.column(2).to_numpy(), bitmap, heavy_of.get(lang, set()), buckets, most):
                    made[k].append(block)
            return pa.RecordBatch.from_arrays([pa.array(made, pa.int32()), pa.array([squeeze(b"".join(x)) for x in made.values()], pa.binary())], names=["bucket", "data"])

        words = 0  # over batches: one of short pieces has few words
        for b in batches:
            held.append(b)
            words += len(b) + (pc.sum(pc.count_substring(b.column(1), " ")).as_py() or 0)
            if words >= GATHERED:
                yield out()
                words = 0
        if held:
            yield out()

    return map_arrow(found.select("lang", "piece", "m"), make, "bucket int, data binary")


def counted(dealt: DataFrame, partitions: int, least: int = LEAST, most: int = MOST_WORDS) -> DataFrame:
    """lang, phrase, f of the phrases of 2 to `most` words with at least `least` occurrences, from runs.

    A bucket is a partition. Its task keeps them, and a table of their words, in a DuckDB beside itself
    and removes it; runs are rows of numbers of words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import zstandard

        folder = tempfile.mkdtemp(prefix="collocations-")  # of this task alone: nothing else reads it
        con = duckdb.connect(os.path.join(folder, "runs.db"), config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": os.path.join(folder, "spill"), "preserve_insertion_order": False})
        names = [f"w{j}" for j in range(most + 1)]  # w0: the language, listed like a word
        blocks: list[np.ndarray] = []
        listed: dict[bytes, int] = {}

        def insert() -> None:
            if not blocks:
                return
            arrived = pa.table({"pos": pa.array(np.arange(len(listed), dtype=np.int32)), "word": pa.array(list(listed), pa.binary()).cast(pa.string())})
            con.register("arrived", arrived)
            con.execute("INSERT INTO words SELECT (SELECT count(*) FROM words) + row_number() OVER (), word FROM arrived ANTI JOIN words USING (word)")
            known = con.execute("SELECT pos, id FROM arrived JOIN words USING (word)").fetchnumpy()
            con.unregister("arrived")
            ids = np.zeros(len(listed) + 1, np.int32)
            ids[known["pos"] + 1] = known["id"]
            rows = np.concatenate(blocks, axis=1)
            con.register("arrived", pa.table({**{w: ids[rows[j]] for j, w in enumerate(names)}, "lead": rows[most + 1], "f": rows[most + 2]}))
            con.execute("INSERT INTO c SELECT * FROM arrived")
            con.unregister("arrived")
            blocks.clear()
            listed.clear()

        try:
            con.execute("CREATE TABLE words (id INTEGER, word VARCHAR)")
            con.execute(f"CREATE TABLE c ({', '.join(f'{w} INTEGER' for w in names)}, lead INTEGER, f BIGINT)")
            expand, held = zstandard.ZstdDecompressor().decompress, 0
            for data in (x for b in batches for x in b.column(0).to_pylist()):
                for lang, words, ids, lead, m in _read_blocks(expand(data), most):
                    own = np.fromiter((listed.setdefault(w, len(listed) + 1) for w in words), np.int64, len(words))
                    rows = np.empty((most + 3, len(m)), np.int64)
                    rows[0] = listed.setdefault(lang, len(listed) + 1)
                    rows[1 : most + 1] = np.append(0, own)[ids]
                    rows[most + 1], rows[most + 2] = lead, m
                    blocks.append(rows)
                    held += rows.nbytes
                    if held >= GATHERED_BYTES:
                        insert()
                        held = 0
            insert()
            # the longest first: rows that are added up already lose their last word and meet the shorter ones
            for k in range(most, 1, -1):
                by = ", ".join(names[: k + 1])
                con.execute(f"CREATE TABLE d AS SELECT {by}, max(lead) AS lead, sum(f)::BIGINT AS f FROM c GROUP BY {by}")
                con.execute("DROP TABLE c")
                con.execute("ALTER TABLE d RENAME TO c")
                con.execute(f"CREATE OR REPLACE TABLE e AS SELECT {by}, f FROM c WHERE w{k} > 0 AND (f >= {int(least)} OR lead >= {k})")
                joins = " ".join(f"JOIN words AS x{j} ON x{j}.id = e.w{j}" for j in range(k + 1))
                reader = con.sql(f"SELECT x0.word AS lang, concat_ws(' ', {', '.join(f'x{j}.word' for j in range(1, k + 1))}) AS phrase, f FROM e {joins}").to_arrow_reader(10_000)
                for batch in reader:
                    yield pa.RecordBatch.from_arrays([batch.column(i).cast(t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    per_bucket = map_arrow(dealt.repartitionById(partitions, F.col("bucket")).select("data"), count, "lang string, phrase string, f long")
    return per_bucket.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, most: int = MOST_WORDS, scale: int = SCALE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate: phrases and words (lang, phrase, f), totals (lang, n)."""
    parts = F.split("phrase", " ")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array(
        F.struct((i * 2).alias("ask"), F.array_join(F.slice(parts, F.lit(1), i), " ").alias("part")),
        F.struct((i * 2 + 1).alias("ask"), F.array_join(F.slice(parts, i + 1, F.size(parts) - i), " ").alias("part")),
    )))
    requests = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    counts = phrases.unionByName(words).select("lang", F.col("phrase").alias("part"), F.col("f").alias("answer"))
    answers = [F.max(F.when(F.col("ask") == ask, F.col("answer"))).alias(f"_{ask}") for ask in range(2, 2 * most)]
    got = requests.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a").agg(*answers).join(totals, "lang")

    def cut(k: int) -> Column:
        # products of up to 38 digits; the quotient is at most scale * n
        score = F.expr(f"(cast({scale} as decimal(6,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(_{2 * k} as decimal(19,0)) * cast(_{2 * k + 1} as decimal(19,0)))")
        return F.when(F.col(f"_{2 * k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"_{2 * k}").alias("l"), F.col(f"_{2 * k + 1}").alias("r")))

    lowest = F.array_min(F.array(*(cut(k) for k in range(1, most))))
    return got.withColumn("_low", lowest).select("lang", "phrase", "a", "_low.l", "_low.r", "n", "_low.score")


def contained(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longest: the largest count of a candidate of one word more that holds the phrase."""
    parts = F.split("phrase", " ")
    n = F.size(parts) - 1
    ends = F.array_distinct(F.array(F.array_join(F.slice(parts, F.lit(1), n), " "), F.array_join(F.slice(parts, F.lit(2), n), " ")))
    return phrases.where(F.size(parts) > 2).select("lang", "f", F.explode(ends).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = MOST_WORDS, scale: int = SCALE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of docs (text, lang)."""
    found = written(pieces(docs), "collocations")
    counts = written(found.select("lang", F.explode(F.split("piece", " ")).alias("word"), "m").groupBy("lang", "word").agg(F.sum("m").alias("f")), "collocations")
    totals = written(counts.groupBy("lang").agg(F.sum("f").alias("n")), "collocations")  # a row for each language; a table, so that Spark knows its size
    all_words = counts.agg(F.sum("f")).first()[0] or 0
    frequent = counts.where(F.col("f") >= least)
    partitions = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-all_words // RUNS_PER_TASK))
    share = max(HEAVY, 2 * partitions)  # a key then holds less than half of what a task reads on average
    heavy = {(r["lang"], r["word"]) for r in counts.where(F.col("f") * share >= all_words).select("lang", "word").collect()}  # that many at most
    dealt = runs(found, frequent_filter(frequent), heavy, partitions, most)
    phrases = written(counted(dealt, partitions, least, most), "collocations")
    drop_written(found)
    marked = scored(phrases, frequent.withColumnRenamed("word", "phrase"), totals, most, scale).join(contained(phrases), ["lang", "phrase"], "left")
    kept = marked.where(F.col("longest").isNull() | (F.col("longest") < F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = kept.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
