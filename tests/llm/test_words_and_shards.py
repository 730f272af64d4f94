"""Spelling variants, sharding and collocations: SQL, brute force, planted cases, nulls, ties, repeated rows, empty tables, clashing columns."""

import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import collocations, registry, sharding, spelling, sql

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, word string, n int, m int, shard int, slot string, phrase string, score string, f int, _at int, _key string, task int"
ODD = [None, "", " \n\t", "w", "é", "÷÷÷×× aaaaa", "日本 語", "a" * 60 + " " + "a" * 59 + " " + "a" * 61, "\0 odd\x0b x", "tab\tand  two   spaces ."]


def docs_of(spark, rows):
    """rows: (doc_id, text, lang)"""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y", "z", "s", 4, 5, "k", 6) for r in rows], CLASH)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.query(name)(spark, SF)
    r = duck.execute(sql.ORACLES[name])
    cols = [x[0] for x in r.description]
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(r.fetchall())


# -- spelling


def brute_words(rows):
    n = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows):
    words = brute_words(rows)
    form, out = {}, []
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return Counter(out)


def spelled(df):
    return Counter(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("shard,block", [(60_000, 200_000), (7, 5)])
def test_spelling_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(spelling, "SHARD_SEGMENTS", shard)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rng = random.Random(3)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aabaa", "x" * 46, "x" * 47, "x" * 48, "x" * 49]
    words = []
    for w in base:
        words += [w] * rng.randrange(1, 30)
        for _ in range(4):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1 :]])] * rng.randrange(1, 12)
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", ", ", "-"]).join(words[i::40]), "en") for i in range(40)] + [(100 + i, t, None) for i, t in enumerate(ODD)] + [(None, "nullid nullid nullid", None)] * 2 + [(7, "Repeated repeated REPEATED", "en")] * 3
    got = spelled(spelling.spelling_variants(docs_of(spark, rows)))
    assert got == brute_spelling(rows) and sum(got.values()) > 100
    assert any(f is not None and r not in (f, w) for w, f, r, *_ in got)  # a chain of forms


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(docs_of(spark, [])).count() == 0
    assert spelling.spelling_variants(docs_of(spark, [(1, None, None), (2, "abcde", "x")])).count() == 0


# -- sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards,steps", [(1, 64), (2, 64), (16, 64), (1000, 64), (1000, 2), (16, 1)])
def test_jump_hash_equals_its_definition(spark, monkeypatch, shards, steps):
    monkeypatch.setattr(sharding, "STEPS", steps)
    rng = random.Random(shards)
    keys = [0, 1, (1 << 64) - 1, 1 << 63] + [rng.getrandbits(64) for _ in range(300)]
    df = spark.createDataFrame([(k >> 32, k & 0xFFFFFFFF) for k in keys], "hi long, lo long")
    got = df.select(sharding.jump_hash(F.col("hi"), F.col("lo"), shards).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [(jump(k, shards), jump(k, shards + 1)) for k in keys]


def test_shards_are_even_gapless_and_move_only_to_the_new_one(spark):
    rows = [(i, f"text {i % 7}", None) for i in range(4000)] + [(10_000 + i, t, None) for i, t in enumerate(ODD)] + [(5, "again", "x")] * 400 + [(None, None, None)] * 3
    df = docs_of(spark, rows)
    got = sharding.shard_table(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert len(got) == len(rows) and sorted(by) == list(range(16))
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    assert all(abs(len({r["doc_id"] for r in rs}) - 250) < 80 for rs in by.values())
    moved = sum(r["grown_shard"] == 16 for r in got)
    assert 0.5 < moved / (len(rows) / 17) < 1.6
    for rs in by.values():  # slots follow the ids
        ids = [r["doc_id"] for r in sorted(rs, key=lambda r: r["slot"])]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))
    texts = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    grown = {r["doc_id"]: r["shard"] for r in sharding.sharded(df, 17).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in got)
    assert sharding.shard_table(docs_of(spark, [])).count() == 0


def test_ids_of_any_type_and_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(f"id-{i}", f"t{i}") for i in range(300)] + [(None, "x")], "doc_id string, text string")
    assert sharding.shard_table(df).where("doc_id like 'id-%'").count() == 300
    sharding.write_shards(df, str(tmp_path / "s"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    want = Counter((r["doc_id"], r["text"], r["shard"]) for r in sharding.sharded(df, 4).collect())
    assert Counter((r["doc_id"], r["text"], r["shard"]) for r in back.collect()) == want
    with pytest.raises(ValueError):
        sharding.sharded(df, 0)


# -- collocations


def brute_collocations(rows, least, top, most, scale):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        if any(len(v) > len(w) and lang == other and b >= a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (other, v), b in cand.items()):
            continue
        score, k = min((scale * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own[:top], 1)]
    return Counter(ranked)


@pytest.mark.parametrize("heavy,gathered,parts", [(256, 200_000, 64), (10**9, 50, 1), (4, 20, 3)])
def test_collocations_equal_brute_force(spark, monkeypatch, heavy, gathered, parts):
    monkeypatch.setattr(collocations, "HEAVY", heavy)
    monkeypatch.setattr(collocations, "GATHERED", gathered)
    monkeypatch.setattr(collocations, "RANK_PARTS", parts)
    rng = random.Random(5)
    vocabulary = ["the", "of", "a", "New", "york", "́mark", "x y", "日本", "e"]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(60)] + ["new", "york", "city", "hall", "steps"] * (i % 3) + ["the"] * (i % 7)
        rng.shuffle(words) if i % 4 else None
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]) for w in words)
        rows.append((i, text, rng.choice(["en", "fr", None, "und"])))
    rows += [(1000 + i, "new york city hall steps. one notice that is everywhere", "en") for i in range(30)] + [(5, rows[5][1], rows[5][2])] * 4 + [(2000 + i, t, None) for i, t in enumerate(ODD)]
    got = collocations.collocations(docs_of(spark, rows), least=12, top=40)
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.columns == cols
    want = brute_collocations(rows, 12, 40, 5, 1000)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 60
    assert any(r[2] == "one notice that is everywhere" for r in want) and not any(r[2] == "one notice that" for r in want)


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r, n = 3_000_000_019, 5_000_000_029, 7_000_000_001, 9_000_000_000_000_021
    phrases = spark.createDataFrame([("en", "u v", a)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", "u", l), ("en", "v", r)], phrases.schema)
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    got = collocations.scored(phrases, words, totals).first()
    assert 1000 * a * n > 1 << 64 and got["score"] == 1000 * a * n // (l * r) and math.isclose(got["score"], 1000 * a * n / (l * r))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, None, None), (2, "a b c", "en")])).count() == 0


def test_short_pieces_are_handed_on_before_they_fill_a_task(spark, monkeypatch):
    """What a task gathers is bounded over its batches, however few words each of them holds."""
    monkeypatch.setattr(collocations, "GATHERED", 800)
    df = spark.range(0, 20_000, 1, 1).select(F.lit("en").alias("lang"), F.format_string("a%d b%d", "id", "id").alias("piece"), F.lit(1).cast("long").alias("m"))
    bitmap = b"\xff" * ((1 << collocations.FILTER_BITS) // 8)
    assert collocations.runs(df.where("id < 20000"), bitmap, set(), 1).count() >= 10


def test_runs_travel_as_numbers_of_words(spark):
    """A block lists a word once however many runs hold it, in each language, and gives every run with its count."""
    import zstandard

    words = [f"{'x' * 40}{i}" for i in range(50)]
    rng = random.Random(3)
    rows = [(rng.choice(["en", "fr"]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))), rng.randrange(1, 4)) for _ in range(3000)]
    want = Counter()
    for lang, piece, m in rows:
        w = piece.split(" ")
        for i in range(len(w) - 1):
            want[lang, " ".join(w[i : i + 5])] += m
    bitmap = b"\xff" * ((1 << collocations.FILTER_BITS) // 8)
    blocks = [zstandard.ZstdDecompressor().decompress(r["data"]) for r in collocations.runs(spark.createDataFrame(rows, "lang string, piece string, m long").coalesce(1), bitmap, {("en", words[0])}, 3).collect()]
    got = Counter()
    for lang, listed, ids, _, m in (x for b in blocks for x in collocations._read_blocks(b, 5)):
        for run, n in zip(ids.T.tolist(), m.tolist(), strict=True):
            got[lang.decode(), " ".join(listed[i - 1].decode() for i in run if i)] += n
    assert got == want and sum(map(len, blocks)) < 30 * len(want)
