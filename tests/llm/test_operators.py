"""Operators on small tables: brute force, planted cases, nulls, ties, empty tables, clashing columns."""

import random
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest

from test_codecs import brute_sets
from vigilspark.llm import chat, decontaminate, edit_counts, language, licenses, media, near_copies, packing, registry, token_files, urls
from vigilspark.llm.tokens import PieceEncoder, tokenizer_path

SF = "/root/testdata/sf0.001"
#: Columns that operators use inside, on top of those of documents.
CLASH = "doc_id long, text string, lang string, class long, key long, component string, score string, rejected string, a int, n int"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, 1, 2, "x", "y", "z", 3, 4) for i, t in enumerate(texts)], CLASH)


ODD = [None, "", " \n\t", "word", "ONE two", "Ünï çödé ß 日本", "the same text here twice over", "the same text here twice over", "x " * 5000, "\0\x01 odd   chars"]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(800)]


def group_texts(words, seed=1):
    """Bases with copies that drop or change some words, in groups of several sizes, and lone texts that share a passage."""
    rng = random.Random(seed)
    shared = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for size in (1, 2, 3, 30, 90):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [shared + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(25)]
    texts += [texts[4]] * 3 + ODD
    rng.shuffle(texts)
    return texts


def brute_components(texts, words, num, den):
    sets = [brute_sets(t or "", words) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n,num,den,block", [(4, 85, 100, 4096), (5, 80, 100, 16)])
def test_near_copies_equal_brute_force(spark, words, monkeypatch, n, num, den, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    texts = group_texts(words)
    got = near_copies.near_copies(docs_of(spark, texts), n, Fraction(num, den)).collect()
    assert sorted(map(tuple, got)) == brute_components(texts, n, num, den)


@pytest.mark.parametrize("side", [256, 16])
def test_near_links_equal_brute_force(spark, words, monkeypatch, side):
    monkeypatch.setattr(near_copies, "SIDE", side)
    texts = group_texts(words)
    sets = [brute_sets(t or "", 4) for t in texts]
    linked = [[j for j, b in enumerate(sets) if j != i and a and 100 * len(a & b) >= 85 * len(a | b)] for i, a in enumerate(sets)]
    want = [(i, n, min([i, *(j for j in linked[i] if sets[j] == sets[i])]), c, len(linked[i])) for i, n, c in brute_components(texts, 4, 85, 100)]
    assert sorted(map(tuple, near_copies.near_links(docs_of(spark, texts)).collect())) == want
    assert any(len(linked[i]) + 1 < sum(w[3] == want[i][3] for w in want) for i in range(len(texts)) if linked[i])  # chains, too


def test_near_copies_with_one_doc_id_for_several_texts(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, a), (1, "another text altogether with other words in it"), (2, a + " more"), (2, a + " more")]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 1), (1, 17, 1), (2, 18, 1), (2, 18, 1)]


def test_null_ids_and_repeated_rows(spark, words):
    rng = random.Random(3)
    a, b, c, d = ([rng.choice(words) for _ in range(80)] for _ in range(4))
    a, b, c, d, near, nearer = (" ".join(x) for x in (a, b, c, d, [*a, "more"], [*b, "more"]))
    rows = [(None, a), (3, near), (None, b), (None, nearer), (None, c), (5, d), (5, d), (7, "other text of its own"), (7, d), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(df).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (None, None), (None, None), (None, None), (5, 5), (5, 5), (7, 7), (7, 5), (None, None), (None, None)], key=str)
    kept = [tuple(r) for r in near_copies.keep_firsts(spark, df, SF).collect()]
    assert [r for r in kept if r[1] in (b, nearer)] in ([(None, b)], [(None, nearer)])
    assert sorted((r for r in kept if r[1] not in (b, nearer)), key=str) == sorted([(3, near), (None, c), (5, d), (7, "other text of its own"), (None, None), (None, None)], key=str)
    files = token_files.write_token_files(df, tokenizer_path("word_bpe_49k.json"), 2, True, file_ids=100)
    out = token_files.read_token_files(files).orderBy("start", "n_tokens").collect()
    assert [r.doc_id for r in out] == [None] * 6 + [3, 5, 5, 7, 7]
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]


def test_decontaminate_stage_drops_rows_with_null_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    df = spark.createDataFrame([(None, item), (None, "clean words"), (1, item), (1, "more clean words")], "doc_id long, text string")
    assert {tuple(r) for r in decontaminate.drop_contaminated(spark, df, SF).collect()} == {(None, "clean words"), (1, "more clean words")}


def test_near_copies_of_nothing(spark):
    assert near_copies.near_copies(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in near_copies.near_copies(docs_of(spark, ["only one text of five words"])).collect()] == [(0, 3, 0)]


def test_licenses_equal_brute_force(spark, words):
    import re

    texts = [*ODD, "MIT License", "an mit  license, mit-license and THE Apache License; gnu General Public License", "mité license"]
    for r in licenses.scan_licenses(docs_of(spark, texts)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").translate({i: i + 32 for i in range(65, 91)}))
        at = [i for p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None)) and 0 <= r.score <= 1
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


def test_url_rules_and_templates(spark):
    cases = {
        "http://a.example.com/en/1": ("example.com/en/", "block"), "https://WWW.example.com/en/1?x": ("www.example.com/en/", "allow"), "http://b.net/es/x#f": ("net/es/", "block"),
        "http://b.net/de/x": (None, "allow"), "http://example.com": (None, "allow"), "http://q.com/": ("com/", "allow"), None: (None, "allow"), "no scheme": (None, "allow"), "http://notexample.com/en/1": ("com/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "host?", 1) for i, u in enumerate(cases)], "page_id long, url string, host string, n int")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_url_templates_learn_from_labels(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"http://h.org/{'bad' if i % 2 else 'good'}/{i}.html") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    label = F.when(F.crc32(F.col("path").cast("binary")) % 2 == 0, F.col("path").startswith("/good"))
    out = {r.template: r.verdict for r in urls.filter_urls(df, labels=label).collect()}
    assert {k.split("/")[1]: v for k, v in out.items()} == {"bad": "block", "good": "allow"} and all("{n}.html" in k for k in out)


def test_url_templates_of_any_depth(spark):
    paths = ["/1/2/3/44/55", "/1/2/3/45/55", "/1/2/3/45/56/a/b/c/d", "/a\nb/c", "//", "", "/es/1", "/es/2", "/es/3", "/de/9"]
    rows = [(i, f"http://{'a.net' if i > 5 else 'x.org'}{p}") for i, p in enumerate(paths)]
    rows += [(i, f"http://v.org/w{'abcdefghijklmnopqrst'[i - 100]}/deep/er/{'x' if i % 2 else 'y'}/{i}") for i in range(100, 120)] + [(None, "http://x.org/1/2/3/4/5")] * 2
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert {by[i].template for i in (0, 1, None)} == {"x.org/{n}/{n}/{n}/{n}/{n}"} and by[2].template == "x.org/{n}/{n}/{n}/{n}/{n}/a/b/c/d"
    assert by[3].template == "x.org/a\nb/c" and by[5].template == "x.org/"
    assert {r.template for r in got if (r.page_id or 0) >= 100} == {"v.org/{*}/deep/er/x/{n}", "v.org/{*}/deep/er/y/{n}"}
    # three blocked of three labelled pages: (0 + 4 * 0.7) / 7 for the host, which the branch without labels inherits
    assert by[9].rule is None and by[9].by_template and by[9].purity == pytest.approx(2.8 / 7) and by[9].verdict == "block"
    assert not by[6].by_template and by[0].verdict == "allow" and by[0].purity == pytest.approx(0.7)


def test_token_counts_equal_whole_encoding(spark, words):
    from pyspark.sql import functions as F

    texts = [*ODD, *group_texts(words)[:20]]
    df = docs_of(spark, texts).withColumn("edits", edit_counts.sample_edits(F.col("text")))
    enc = PieceEncoder(tokenizer_path("byte_bpe_50k.json"), False)
    for r in edit_counts.count_with_edits(df, tokenizer_path("byte_bpe_50k.json")).collect():
        t = texts[r.doc_id] or ""
        n = len(t)
        assert r.n_tokens == len(enc.encode_whole(t)) // 4
        for at, gone, new in ((n // 3, 5, " revised"), (2 * n // 3, 0, " one more clause,"), (n - 9, 7, "")):
            at = min(max(0, at), len(t))
            t = t[:at] + new + t[at + gone :]
        assert (r.n_tokens_after, r.text_crc32) == (len(enc.encode_whole(t)) // 4, zlib.crc32(t.encode()))


def test_stored_trees_go_through_rounds_of_edits(spark, words):
    from pyspark.sql import functions as F

    path = tokenizer_path("byte_bpe_50k.json")
    enc = PieceEncoder(path, False)
    rng = random.Random(12)
    texts = [*ODD, *group_texts(words)[:12], None]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    trees = edit_counts.build_trees(spark.createDataFrame(rows, "doc_id long, text string").withColumn("counts", F.lit("clash")), path)
    now = {i if i else None: t or "" for i, t in enumerate(texts)}
    for turn in range(3):
        edits = {k: [(rng.randrange(-2, len(t) + 3), rng.choice([0, 3, None, 10_000]), rng.choice(["", " and more words", None, "x"])) for _ in range(rng.randrange(0, 4))] for k, t in now.items()}
        table = spark.createDataFrame([(k, [*e, None, (None, 5, "y")]) for k, e in edits.items()], f"id long, edits array<{edit_counts.EDIT}>")
        trees = edit_counts.edit_trees(trees.join(table, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id"), path)
        for k, e in edits.items():
            t = now[k]
            for at, gone, new in e:
                at = min(max(0, at), len(t))
                t = t[:at] + (new or "") + t[at + (gone or 0) :]
            now[k] = t
        got = trees.collect()
        assert len(got) == len(texts)
        for r in got:
            assert "".join(r.leaves) == now[r.doc_id] and sum(r.counts) == r.n_tokens_after == len(enc.encode_whole(now[r.doc_id])) // 4
    assert edit_counts.build_trees(docs_of(spark, []), path).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = registry.queries()["op5_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert not any(r.rejected for r in out)


def test_language_of_odd_texts(spark):
    train = docs_of(spark, ["the cat sat on the mat and looked at the dog"] * 3, "en").union(docs_of(spark, ["der hund und die katze sind nicht im haus"] * 3, "de"))
    model = language.fit(train)
    got = [tuple(r) for r in language.predict(docs_of(spark, [None, "", "123 !!", "the dog and the cat", "die katze und der hund"]), model).orderBy("doc_id").select("lang_pred", "rejected").collect()]
    assert got == [("und", True), ("und", True), ("und", True), ("en", False), ("de", False)]
    some = language.fit(train.union(docs_of(spark, ["12 34", "?!", None], "xx")).union(docs_of(spark, ["zz qq ww xx kk jj"] * 2000, "yy")))
    assert sorted(set(some.langs)) == ["de", "en", "yy"]  # a language without letters has no centroid, one of copies has
    junk = ["qzx wvk jjq xzzq vkqw" * 3, "Ελληνικά γράμματα και λέξεις", "the dog sat"]
    assert [r.rejected for r in language.predict(docs_of(spark, junk), model).orderBy("doc_id").collect()] == [True, True, False]
    assert language.predict(docs_of(spark, []), model).count() == 0
    nothing = language.fit(train.limit(0))
    assert [r.lang_pred for r in language.predict(docs_of(spark, ["some words"]), nothing).collect()] == ["und"]


def test_media_of_odd_texts(spark):
    import hashlib

    texts = [*ODD, "y" * 200_000]
    rows = media.describe(media.to_images(docs_of(spark, texts))).collect()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    images = media.to_images(docs_of(spark, ["abc"])).union(spark.createDataFrame([(9, 0, 0, bytearray(b"RIFF damaged")), (10, 0, 0, None)], media.IMAGES))
    px = {r.doc_id: r for r in media.pixels_of(images).collect()}
    assert px[0].pixels[:4] == b"abc\xff" and px[9].pixels is None and px[9].error and px[10].error == "no image"


def test_token_files_hold_all_ids(spark, words):
    texts = [*ODD, *group_texts(words)[:30]]
    files = token_files.write_token_files(docs_of(spark, texts), tokenizer_path("word_bpe_49k.json"), 2, True, file_ids=500)
    assert files.count() > 2
    enc = PieceEncoder(tokenizer_path("word_bpe_49k.json"), True)
    start = 0
    for i, r in enumerate(token_files.read_token_files(files).orderBy("doc_id").collect()):
        raw = enc.encode_whole(texts[i] or "") + struct.pack("<I", 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    assert token_files.read_token_files(token_files.write_token_files(docs_of(spark, []), tokenizer_path("word_bpe_49k.json"), 2, True)).count() == 0


def test_packing_holds_all_ids(spark, words):
    texts = [*ODD, *group_texts(words)[:60]]
    enc = PieceEncoder(tokenizer_path("byte_bpe_50k.json"), False)
    rows = packing.pack_documents(docs_of(spark, texts), tokenizer_path("byte_bpe_50k.json"), 0, False, capacity=256).collect()
    seqs, docs = {}, {}
    for r in rows:
        raw = (enc.encode_whole(texts[r.doc_id] or "") + struct.pack("<I", 0))
        assert r.doc_tokens == len(raw) // 4 and r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for parts in docs.values():
        assert sum(n for _, n, _ in parts) == parts[0][2]
    assert len(docs) == len(texts)
    assert sum(r.length for r in rows) / 256 / len(seqs) > 0.9
    assert packing.pack_documents(docs_of(spark, []), tokenizer_path("byte_bpe_50k.json"), 0, False).count() == 0


def test_decontamination_of_planted_items(spark, words):
    rng = random.Random(5)
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, fill(rng.randrange(15, 60))) for i in range(20)] + [(20, "short item of five words"), (21, None), (22, "")]
    texts, planted = [], set()
    for i in range(120):
        t = fill(rng.randrange(30, 400))
        if i % 4 == 0:
            item = items[i % 21]
            w = item[1].upper().split() if i % 8 == 0 else item[1].split()
            if len(w) > 20 and i % 12 == 0:
                w[3], w[9] = rng.choice(words), rng.choice(words)
            cut = rng.randrange(0, len(t.split()))
            t = " ".join([*t.split()[:cut], *w, *t.split()[cut:]])
            planted.add((i, item[0]))
        texts.append(t)
    found = decontaminate.contaminated(docs_of(spark, texts + ODD), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs_of(spark, texts), none).count() == 0
    assert decontaminate.contaminated(docs_of(spark, []), spark.createDataFrame(items, none.schema)).count() == 0


def test_decontamination_with_null_ids_and_repeats(spark, words, monkeypatch):
    monkeypatch.setattr(decontaminate, "SUMMED", 2)
    rng = random.Random(7)
    a, b, c = (" ".join(rng.choice(words) for _ in range(20)) for _ in range(3))
    items = spark.createDataFrame([(None, a), (None, b), (4, c), (4, a)], "item_id long, text string")
    fill = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(40)]
    docs = [(None, f"x {a} y {b}"), (1, c), (1, c), (2, f"{a} {c}"), *((10 + i, t) for i, t in enumerate(fill)), (9, None)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), items).collect()
    assert sorted((tuple(r)[:2] for r in found), key=str) == sorted([(None, None), (None, 4), (1, 4), (1, 4), (2, None), (2, 4)], key=str)
    assert all(r.share == 1 for r in found)


def brute_contaminated(texts, items, idf):
    """All (text, item) where a span of 1.5 times the item's length holds 0.7 of its words in order and 0.6 of its five rarest."""
    out = set()
    for i, w in ((i, decontaminate.words_of(t)) for i, t in items):
        rare = sorted(dict.fromkeys(w), key=lambda x: (-float(idf[decontaminate.bucket_ids(x.decode())[0]]), -len(x), x))[:5]
        for d, t in enumerate(texts):
            v = decontaminate.words_of(t)
            parts = (v[s : s + -(-3 * len(w) // 2)] for s in range(len(v)) if len(set(v[s : s + 90]) & set(rare)) >= 0.6 * len(rare))
            if any(len(set(p) & set(rare)) >= 0.6 * len(rare) and 10 * decontaminate.common_subsequence(w, p) >= 7 * len(w) for p in parts):
                out.add((d, i))
    return out


def test_decontamination_finds_what_brute_force_finds(spark, words):
    rng = random.Random(8)
    fill = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(fill((8, 9, 10, 12, 16, 20, 40)[i % 7]))) for i in range(70)]
    texts = []
    for i in range(280):
        w = items[i % 70][1].split()
        for k in rng.sample(range(len(w)), len(w) * (i % 4) // 12):  # up to a quarter replaced
            w[k] = rng.choice(words)
        t = fill(rng.randrange(100, 300))
        cut = rng.randrange(len(t))
        texts.append(" ".join([*t[:cut], *w, *t[cut:]]))
    docs = docs_of(spark, texts)
    seen, n, _ = decontaminate.frequencies(docs)
    want = brute_contaminated(texts, items, np.log((1 + n) / (1 + seen)).astype(np.float32))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    lengths = sorted({len(t.split()) for _, t in items})
    print({k: (sum(len(items[i][1].split()) == k for _, i in found & want), sum(len(items[i][1].split()) == k for _, i in want)) for k in lengths})
    assert len(want) > 200 and want == found


def test_decontamination_holds_to_the_span(spark, words, monkeypatch):
    """An item whose words stand too far apart is not found, whatever the latent space proposes; many rounds give one row of an item's texts."""
    rng = random.Random(9)
    item = [rng.choice(words) for _ in range(12)]
    wide = [w for x in item for w in (x, rng.choice(words), rng.choice(words))]
    other = [rng.choice(words) for _ in range(30)]
    texts = [" ".join(wide), " ".join(item), " ".join(other), None, " ".join(other + item)] + [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (2, " ".join(other[:20])), (None, " ".join(other[5:25]))], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEMS_BYTES", 60)
    found = decontaminate.contaminated(docs_of(spark, texts), items, cosine=-1.0).collect()  # every passage is a candidate of every item
    assert sorted((tuple(r) for r in found), key=str) == sorted([(1, 1, 1.0), (2, 2, 1.0), (2, None, 1.0), (4, 1, 1.0), (4, 2, 1.0), (4, None, 1.0)], key=str)


def test_chat_repair_over_partitions(spark):
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["user", "assistant", "system", None, "Bot"]), f"t{i}", 0) for i in range(300)] + [(c, t, rng.choice(["user", "assistant"]), "x", 0) for c in range(20) for t in range(rng.randrange(1, 5))] + [(None, 0, "user", None, 0)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int")
    out = chat.repair(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    for conv, turns in by.items():
        turns.sort(key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(len(turns)))
        said = [m for m in "".join(r.rendered for r in turns).split("<|end|>\n") if m]
        roles = [m.split("|")[1] for m in said]
        legal = all(chat.ROLES.index(b) in chat.NEXT[chat.ROLES.index(a) if a else chat.START] for a, b in zip([None, *roles], roles, strict=False))
        assert legal and roles[-1] == "assistant"
        numbers = [chat.role_number(r.role) for r in turns]
        assert sum(r.cost for r in turns) == sum(chat.render(n, "", s, k, i == len(numbers) - 1)[2] for i, (n, (s, k)) in enumerate(zip(numbers, chat.solve(numbers), strict=True)))
    assert chat.repair(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= n
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} < {r.doc_id for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = {i: root for i, _, root in ((d, n, sorted(texts)[r]) for d, n, r in [(sorted(texts)[a], b, c) for a, b, c in brute_components([texts[k] for k in sorted(texts)], 5, 80, 100)])}
    assert all(groups[r.doc_id] == r.doc_id for r in rows)


def test_names():
    assert sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0])) == [n for i in range(1, 14) for n in registry.queries() if n.startswith(f"op{i}_")]


def test_licence_identifiers_are_whole_words():
    for name, label in (("mit", "mit"), ("mitre", None), ("iscsi", None), ("bsdiff", None), ("bsd-3-clause", "bsd"), ("gplv3", "gpl"), ("gpl-2.0+", "gpl"), ("apache2", "apache"), ("unlicensed", None)):
        assert licenses.label_of(name) == label
    free = lambda x: licenses.evaluate(licenses.to_postfix(licenses.tokens_of(x)))
    assert [free(x) for x in ("gpl-2.0 with classpath-exception-2.0", "agpl-3.0 with anything", "mit or agpl-3.0 with anything", "mitre")] == [True, False, True, None]


def test_numerals_are_no_letters():
    assert [language.has_letter(t) for t in ("", "½ ² 7 _", "Ⅳ 12", "x", "½ é", "日")] == [False, False, False, True, True, True]


def test_a_payload_beyond_one_image_is_several(spark, monkeypatch):
    texts = ["", None, "short", "x" * 5000, "grüße " * 400, "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "short")], "doc_id long, text string")
    whole = {r.doc_id: r for r in media.describe(media.to_images(df)).collect()}
    monkeypatch.setattr(media, "IMAGE_BYTES", 192 * 4)
    got = {r.doc_id: r for r in media.describe(media.to_images(df)).collect()}
    for i, r in got.items():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (whole[i].n_bytes, whole[i].payload_bytes, whole[i].payload_sha256, whole[i].tail_crc32)
        assert r.feature.count(";") == (r.payload_bytes - 1) // (192 * 4)
    assert got[3].media_sha256 == got[5].media_sha256 and len(media.files_of(media.to_images(df).where("doc_id = 3").first()["image"])) == 7
    assert media.describe(media.to_images(df.limit(0))).count() == 0
