"""Plain rewrites: URL trees, language centroids, and the pipeline's stages one by one."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import brute_components, brute_contaminated
from vigilspark.llm import decontaminate, language, near_copies, urls

SF = "/root/testdata/sf0.001"


# -- URL trees


def plain_shape(segment):
    m = re.match(r"(?s)\A(.*?)(\.[A-Za-z]{1,5})?\Z", segment)
    stem, ext = m[1], m[2] or ""
    if re.fullmatch("[0-9]+", stem):
        stem = "{n}"
    elif re.fullmatch("[0-9]{4}-[0-9]{2}(-[0-9]{2})?", stem):
        stem = "{date}"
    elif re.fullmatch("[0-9A-Fa-f-]{8,}", stem) and re.search("[0-9]", stem):
        stem = "{hex}"
    elif len(stem) >= 16 and re.search("[0-9]", stem):
        stem = "{id}"
    return stem + ext


def plain_urls(rows):
    """rows: (page_id, url); the tree of each host walked level by level with dicts."""
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    base, shapes = [], defaultdict(lambda: [0, 0, 0])
    for page, url in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(r, v) for r, v in urls.RULES if (lambda n, p: (host == n or host.endswith("." + n)) and path.startswith("/" + p))(*r.split("/", 1))]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, None)
        parts = tuple(plain_shape(s) for s in re.sub(r"\A/", "", path).split("/"))
        base.append((page, host, path, rule, verdict, parts))
        s = shapes[host, parts]
        s[0] += 1
        s[1] += verdict == "allow"
        s[2] += verdict == "block"
    smooth = lambda g, b, above: (g + urls.STRENGTH * above) / (g + b + urls.STRENGTH)
    judged, nodes = {}, []
    for host in {h for h, _ in shapes}:
        own = [(p, *v) for (h, p), v in shapes.items() if h == host]
        nodes.append((host, "", own, smooth(sum(x[2] for x in own), sum(x[3] for x in own), urls.PRIOR), 0))
    while nodes:
        host, prefix, members, above, level = nodes.pop()
        kids = defaultdict(list)
        for x in members:
            kids[x[0][level]].append(x)
        n, good, bad = (sum(x[i] for x in members) for i in (1, 2, 3))
        groups = defaultdict(list)
        for name, own in kids.items():
            g, b = sum(x[2] for x in own), sum(x[3] for x in own)
            alike = False
            if len(kids) > 1 and g + b > 0:
                share = good / (good + bad)
                alike = abs(g / (g + b) - share) <= urls.SIMILAR * (share * (1 - share) / (g + b) + 1 / (good + bad) / 4) ** 0.5
            variable = len(kids) >= urls.CHILDREN and len(kids) > urls.DISTINCT * n
            label = "" if name == "" else "{*}" if variable else "{~}" if alike else name
            for x in own:
                groups[label, len(x[0]) == level + 1].append(x)
        for (label, last), own in groups.items():
            g, b = sum(x[2] for x in own), sum(x[3] for x in own)
            purity, deeper = smooth(g, b, above), f"{prefix}/{label}"
            if last or len(own) == 1:
                for x in own:
                    rest = "" if last else "/" + "/".join(x[0][level + 1 :])
                    judged[host, x[0]] = (re.sub(r"/+\Z", "/", host + deeper + rest), purity, g + b)
            else:
                nodes.append((host, deeper, own, purity, level + 1))
    out = []
    for page, host, path, rule, verdict, parts in base:
        template, purity, labelled = judged[host, parts]
        out.append((page, host, path, rule, verdict or ("block" if purity < urls.PURITY else "allow"), template, round(purity, 9), labelled, verdict is None))
    return sorted(out, key=str)


def odd_urls():
    rng = random.Random(2)
    hosts = ["a.com", "WWW.example.com", "x.net", "example.com", "deep.org", ""]
    words = ["en", "es", "fr", "item", "tag", "2024-01", "page7", "0123456789abcdef", "aaaaaaaaaaaaaaaaaaaa1", "x.html", "é", ""]
    rows = [(i, f"http://{rng.choice(hosts)}/{'/'.join(rng.choice(words) for _ in range(rng.randrange(0, 5)))}{rng.choice(['', '?q=1', '#x', '/'])}") for i in range(500)]
    rows += [(1000 + i, f"http://x.net/es/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}q/{i % 3}") for i in range(60)]
    rows += [(None, None), (None, None), (5, "no scheme"), (5, "no scheme"), (6, "http://a.com"), (7, "http://deep.org/" + "/".join("abcdefgh")), (8, "http://deep.org/" + "/".join("abcdefgi")), (9, "://net/fr/x" + "/y" * 400)]
    return rows


def url_rows(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9), r.n_labelled, r.by_template) for r in df.collect()), key=str)


def test_url_trees_equal_plain_trees(spark):
    rows = odd_urls()[:-1]  # the last is deep; its one shape leaves the loop at once, below
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, host string, n int")
    got = url_rows(urls.filter_urls(df))
    assert got == plain_urls(rows)
    assert {r[4] for r in got if r[8]} == {"allow", "block"} and any("{~}" in r[5] for r in got) and any("{*}" in r[5] for r in got)
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_a_very_long_path_of_its_own(spark):
    rows = [odd_urls()[-1], (1, "http://net/de/x")]
    assert url_rows(urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"))) == plain_urls(rows)


# -- languages


def plain_grams(text):
    letters = "".join(c if ord(c) >= 128 else c.lower() if c.isalpha() else " " for c in (text if text.isascii() else text.lower()))
    return (" " + " ".join(x for x in letters.split(" ") if x) + " ").encode()


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, language.fit(docs.where(~language.held_out(F.col("doc_id"))))


def test_language_frequencies_are_those_of_all_training_texts(languages):
    docs, model = languages
    train = [r for r in docs.collect() if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    seen = sum((language.grams(r.text) > 0).astype(int) for r in train)
    want = np.log((1 + len(train)) / (1 + seen))
    assert np.corrcoef(want, model.idf)[0, 1] > 0.999999


def test_language_is_that_of_the_nearest_centroid(spark, languages):
    docs, model = languages
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "the of and"), (None, "the of and"), (9001, None), (9002, ""), (9003, "½ ²"), (9004, "der die und " * 20_000), (9005, "日本語")]
    got = language.predict(spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, lang_pred string, score double"), model).collect()
    assert len(got) == len(rows)
    for (_, text), r in zip(rows, got, strict=True):
        assert r.text == text
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        counts = language.grams(text).astype(float)
        v = np.log1p(counts) * model.idf
        v = v / max(np.linalg.norm(v), 1e-12)
        cosines = [float(np.dot(v, c)) for c in model.centres]
        best = max(cosines)
        assert abs(r.score - min(max(best, 0), 1)) < 1e-5 and model.langs[cosines.index(best)] == r.lang_pred or sorted(cosines)[-2] > best - 1e-6
    assert np.allclose(np.linalg.norm(model.centres, axis=1), 1, atol=1e-5)
    assert plain_grams("Ab, c") == b" ab c "


# -- the pipeline's stages


def planted(words):
    rng = random.Random(12)
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [fill(rng.randrange(40, 120)) for _ in range(60)]
    for i in range(0, 40, 2):  # near copies
        w = texts[i].split()
        w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return texts + [texts[0]] * 3 + [None, "", " ", "one two", "one two"]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(500)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, class string, rejected int, row string, mark long"


def test_stage_near_copies_keeps_what_brute_force_keeps(spark, words):
    texts = planted(words)
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2, "c", 3, "r", 4) for i, t in enumerate(texts)], SCHEMA)
    kept = near_copies.keep_firsts(spark, df, SF)
    want = {i for i, _, root in brute_components(texts, 5, 80, 100) if i == root or not (texts[i] or "").split()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == df.columns
    assert near_copies.keep_firsts(spark, df.limit(0), SF).count() == 0


def test_stage_decontaminate_drops_what_brute_force_finds(spark, words, tmp_path):
    rng = random.Random(13)
    texts = planted(words)
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((5, 8, 12, 20, 40, 64))]
    for i, t in items:
        w = t.split()
        w[len(w) // 2] = rng.choice(words)
        texts += [f"{texts[3]} {t} {texts[4]}", f"{texts[5]} {' '.join(w)}"]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    items_df.write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2, "c", 3, "r", 4) for i, t in enumerate(texts)], SCHEMA)
    seen, n, _ = decontaminate.frequencies(df)
    long = [(i, t) for i, t in items if len(t.split()) >= decontaminate.LEAST]
    bad = {d for d, _ in brute_contaminated([t or "" for t in texts], long, np.log((1 + n) / (1 + seen)).astype(np.float32))}
    bad |= {d for d, t in enumerate(texts) for _, x in items if len(x.split()) < decontaminate.LEAST and f" {x} " in f" {t} "}
    kept = decontaminate.drop_contaminated(spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - bad) and len(bad) >= 9 and kept.columns == df.columns
    assert decontaminate.drop_contaminated(spark, df.limit(0), str(tmp_path)).count() == 0


def test_stage_language_and_pack(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "½ 12", "en", "s", 3), (90_003, "", None, None, 0)], docs.schema)
    kept = language.keep_identified(spark, docs.unionByName(extra), SF)
    model = language.fit(docs.unionByName(extra).where(~language.held_out(F.col("doc_id"))))
    want = {r.doc_id for r in language.predict(docs.unionByName(extra), model).collect() if not r.rejected}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == want and not ids & {90_001, 90_002, 90_003} and len(ids) > 0.9 * docs.count()
    assert language.keep_identified(spark, docs.limit(0), SF).count() == 0
    pieces = corpus_pipeline.pack_kept(spark, kept, SF).collect()
    by = defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
    assert set(by) == ids
    for rows in by.values():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))] and sum(r.length for r in rows) == rows[0].doc_tokens
    assert corpus_pipeline.pack_kept(spark, kept.limit(0), SF).count() == 0
