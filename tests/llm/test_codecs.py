"""Codecs and kernels without Spark: exact round trips and brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from vigilspark.llm import chat, decontaminate, edit_counts, licenses, media, near_copies, packing, token_files, webp
from vigilspark.llm.tokens import PieceEncoder, tokenizer_path

TEXTS = ["", " ", "a", "Hello world", "two  spaces", "line\nbreak and\n\nblank", " lead", "trail ", "tab\tand nbsp x", "Ünïcödé ß ﬁ Σίσυφος", "x" * 3000, "don't we'll 12345 !!! <|endoftext|>", "日本語 テキスト", "\0zero \0 byte"]


@pytest.mark.parametrize("file,word_ends", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_give_the_library_ids(file, word_ends):
    enc = PieceEncoder(tokenizer_path(file), word_ends, cache_pieces=8)
    rng = random.Random(1)
    more = [" ".join(rng.choice(TEXTS) for _ in range(5)) for _ in range(60)]
    plain = Tokenizer.from_file(tokenizer_path(file))
    specials = [f"{a}{t.content}{b}" for t in plain.get_added_tokens_decoder().values() for a in ("", "word ", "x") for b in ("", " word", "\n", "y z")]
    want = [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS + more + specials]
    assert enc.ids(TEXTS + more + specials) == want and [enc.encode_whole(t) for t in TEXTS + more + specials] == want
    assert len(specials) >= 12 and all(len(want[-len(specials) + 12 * k]) == 4 for k in range(len(specials) // 12))


@pytest.mark.parametrize("file,word_ends", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_words_in_any_case_and_with_marks_give_the_library_ids(file, word_ends):
    rng = random.Random(5)
    alphabet = "aabcdehistHSTIXßéÉñÜüÿÿÀªµº×÷ıİſKΣσς.,;:!?&#*$%|()<>'’\"_-0129½²\u0300\u0307\u0331\u0338\u0301\u0301가中😀\u00a0\u200b\u00ad\u2028\t\r\0"
    short = ["".join(rng.choice(alphabet[:14] if rng.random() < 0.5 else alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(6000)]
    short += [f"{w}{m}" for w in ("H\u0331", "I\u0307", "don't", "WE'LL", "it's", "x" * 400, "É" * 300, "<", "'s", "a'", "") for m in ("", ".", ".,", "'s", "'.", "<\u0338", "\u0338", "!'s", "1.", "_")]
    texts = [rng.choice(("", " ", "\n")) * (rng.random() < 0.1) + "".join(rng.choice(short) + rng.choice("    \n") for _ in range(n))[:-1] for n in [*range(1, 60), *(rng.randrange(1, 400) for _ in range(60))]]
    texts += ["".join(c for c in t if c == "\n" or c.isprintable()) for t in texts]  # these are cut with either vocabulary
    plain = Tokenizer.from_file(tokenizer_path(file))
    want = [np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for pieces in (50, 1_000_000):
        enc = PieceEncoder(tokenizer_path(file), word_ends, cache_pieces=pieces)
        assert enc.ids(texts) == want and enc.ids(texts[::-1]) == want[::-1]
        assert [enc.ids([t])[0] for t in texts[:80]] == want[:80]


@pytest.mark.parametrize("file,word_ends,most", [("byte_bpe_50k.json", False, 2 * 676 + 4), ("word_bpe_49k.json", True, 676 + 4)])
def test_a_word_is_encoded_once_whatever_case_and_marks(file, word_ends, most):
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = [" ".join(f"{w}{m}" for w in case) for m in ("", ".", ",", "?!") for case in (words, [w.title() for w in words])] * 2
    enc = PieceEncoder(tokenizer_path(file), word_ends)
    assert enc.ids(texts) == [enc.encode_whole(t) for t in texts]
    assert len(enc._cache) <= most + 2  # and the words that begin a text


@pytest.mark.parametrize("file,word_ends", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_met_once_are_not_kept(file, word_ends):
    """Most pieces of large texts are met once; a worker's memory is for those that come again."""
    texts = [" ".join(f"q{'abcdefghij'[i % 10]}x{i}" for i in range(k, k + 2000)) for k in (0, 2000, 4000)]
    enc = PieceEncoder(tokenizer_path(file), word_ends)
    want = [enc.encode_whole(t) for t in texts]
    assert enc.ids(texts) == want and len(enc._cache) + len(enc._old) < 60
    assert enc.ids(texts[:1]) == want[:1] and len(enc._cache) + len(enc._old) >= 2000
    assert enc.ids(texts) == want


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_token_file_round_trip(plane):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << int(rng.integers(1, 32)), n).astype("<u4")
        lengths = np.array([n // 3, n - n // 3], np.int64)
        content = token_files.write_file(np.array([5, 5], np.int64), lengths, ids, plane, block_ids=64)
        docs, got_lengths, got = token_files.read_file(content)
        assert docs.tolist() == [5, 5] and got_lengths.tolist() == lengths.tolist() and (got == ids).all()
        if n > 64:
            assert (token_files.read_block(content, 1) == ids[64:128]).all()


@pytest.mark.parametrize("seed", range(25))
def test_webp_round_trip(seed):
    r = np.random.default_rng(seed)
    h, w, k = int(r.integers(1, 30)), int(r.integers(1, 30)), int(r.choice([1, 2, 4, 16, 200, 256]))
    px = r.integers(0, k, (h, w, 4)).astype(np.uint8)
    if seed % 3 == 0:
        px = np.repeat(px[:, :1], w, axis=1)
    blocks = (-(-h // 4), -(-w // 4))
    assert (webp.decode(webp.encode(px, palette=True, cache_bits=int(r.choice([0, 1, 11])), copies=bool(seed % 2))) == px).all()
    options = {"predictor": r.integers(0, 14, blocks), "cross": r.integers(0, 1 << 32, blocks).astype(np.uint32), "bits": 2, "subtract_green": True, "palette": False}
    assert (webp.decode(webp.encode(px, **options)) == px).all()


def test_webp_payloads_and_damage():
    rng = np.random.default_rng(4)
    prose = "the quick brown fox jumps over the lazy dog, und der Hund schläft. "
    raws = [b"", b"a", bytes(range(256)) * 9, "ü€😀".encode() * 100, prose.encode() * 3, prose.encode() * 700, b"\xff" * 700, bytes(range(256)), *(rng.integers(0, 256, int(n)).astype(np.uint8).tobytes() for n in rng.integers(1, 4000, 12))] * 2
    payloads = [media.padded(raw) for raw in raws]
    assert all(len(p) % 192 == 0 and p.startswith(r) for p, r in zip(payloads, raws, strict=True))
    seen = np.bincount(np.frombuffer(prose.encode() * 50, np.uint8), minlength=256)
    shared = webp.Shared(seen, 10)
    files = webp.encode_many([media.samples_of(p) for p in payloads], shared)
    assert [media.payload_of(webp.decode(f), len(p)) for f, p in zip(files, payloads, strict=True)] == payloads
    assert [media.payload_of(x, len(p)) for x, p in zip(webp.decode_many(files), payloads, strict=True)] == payloads
    assert files == [webp.encode_many([media.samples_of(p)], shared)[0] for p in payloads]  # whatever the neighbours
    own = [webp.encode(np.concatenate([media.samples_of(p), np.full((len(p) // 192, 64, 1), 255, np.uint8)], axis=2)) for p in payloads]
    assert own[2] == files[2] and own[4] != files[4]  # some have own codes, some the shared ones
    for decode in (webp.decode, lambda data: webp.decode_many([data])):
        for image in (files[4], files[5], own[0]):
            with pytest.raises((webp.WebpError, IndexError, ValueError)):
                decode(image[: len(image) // 2])


def test_webp_images_of_several_widths_side_by_side():
    rng = np.random.default_rng(8)
    images = [rng.integers(0, k, (h, w, 3)).astype(np.uint8) for h, w, k in ((1, 1, 2), (3, 7, 2), (20, 5, 1), (9, 64, 3), (2, 300, 256))]
    images.append(np.repeat(images[-1], 4, axis=0))
    files = webp.encode_many(images, webp.Shared(np.ones(256, int), 5))
    for decoded in (webp.decode_many(files), [webp.decode(f) for f in files]):
        assert all((d[..., :3] == i).all() and (d[..., 3] == 255).all() for d, i in zip(decoded, images, strict=True))


def first_tool(data: bytes) -> str | None:
    """The first transform of a file, or else its colour cache."""
    r = webp.Reader(webp._body(data))
    r.at = webp.SIDE_BITS + 4
    if r.read(1):
        return ("predictor", "cross", "green", "palette")[r.read(2)]
    return "cache" if r.read(1) else None


def test_webp_tries_every_tool_of_the_format(monkeypatch):
    rng = np.random.default_rng(6)
    prose = " ".join(rng.choice(["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "und", "der"], 9000)).encode()
    y, x = np.mgrid[:96, :64]
    smooth = (np.stack([x + 2 * y, 3 * x + y, x + y], axis=-1) // 2 + rng.integers(0, 2, (96, 64, 3))).astype(np.uint8)
    green = rng.integers(0, 256, (96, 64, 1)).astype(np.uint8)
    images = {
        "long": media.samples_of(media.padded(prose)), "short": media.samples_of(media.padded(prose[:2000])), "smooth": smooth,
        "grey": green + np.array([3, 0, 9], np.uint8) + rng.integers(0, 2, (96, 64, 3)).astype(np.uint8), "half": np.concatenate([(green.view(np.int8) >> 1).view(np.uint8), green, (green.view(np.int8) >> 2).view(np.uint8)], axis=2),
    }
    shared = webp.Shared(*webp.symbols_of([images["long"], images["short"]]))
    files = dict(zip(images, webp.encode_many(list(images.values()), shared), strict=True))
    for decoded in (webp.decode_many(list(files.values())), [webp.decode(f) for f in files.values()]):
        assert all((d[..., :3] == i).all() and (d[..., 3] == 255).all() for d, i in zip(decoded, images.values(), strict=True))
    assert [first_tool(files[k]) for k in ("long", "short", "grey", "half")] == ["cache", "cache", "green", "cross"]
    predicted, undo = [], webp._unpredict
    monkeypatch.setattr(webp, "_unpredict", lambda *a: predicted.append(1) or undo(*a))
    assert (webp.decode(files["smooth"])[..., :3] == smooth).all() and predicted
    assert all(f == webp.encode_many([images[k]], shared)[0] for k, f in files.items())  # whatever the neighbours
    opaque = lambda i: np.concatenate([i, np.full((*i.shape[:2], 1), 255, np.uint8)], axis=2)
    for name, most in (("long", 0.9), ("smooth", 0.5), ("grey", 0.7), ("half", 0.75)):
        assert len(files[name]) < most * len(webp.encode(opaque(images[name]), palette=False, cache_bits=0))


def test_webp_trials_do_not_depend_on_neighbours():
    rng = np.random.default_rng(9)
    images = [np.cumsum(rng.integers(0, 9, (h, 7, 3)), axis=0).astype(np.uint8) for h in (33, 2, 70, 40)]
    sides = [i.shape[:2] for i in images]
    together = webp._trials(np.concatenate([i.reshape(-1, 3) for i in images]), sides)
    assert (together == np.concatenate([webp._trials(i.reshape(-1, 3), [s]) for i, s in zip(images, sides, strict=True)], axis=1)).all()


@pytest.mark.parametrize("seed", range(12))
def test_webp_colour_cache_behind_copies(seed):
    """What a back-reference copies is in the cache for the pixels that follow it."""
    r = np.random.default_rng(seed)
    parts = []
    for _ in range(12):
        parts += [r.integers(0, 3, (int(r.integers(1, 40)), 3)) * 90, np.repeat(r.integers(0, 3, (1, 3)) * 90, int(r.integers(1, 30)), axis=0)]
    flat = np.concatenate(parts).astype(np.uint8)
    image = np.resize(flat, (-(-len(flat) // 16), 16, 3))
    opaque = np.concatenate([image, np.full((*image.shape[:2], 1), 255, np.uint8)], axis=2)
    files = [webp.encode(opaque, palette=False, cache_bits=b) for b in (1, 2, 4, 8, 11)]
    assert all(first_tool(f) == "cache" for f in files)
    for decoded in (webp.decode_many(files * 2), [webp.decode(f) for f in files]):
        assert all((d == opaque).all() for d in decoded)
    shared = webp.Shared(*webp.symbols_of([image]))
    assert (webp.decode_many(webp.encode_many([image] * 3, shared))[2] == opaque).all()


def test_plan_holds_all_pieces():
    rng = np.random.default_rng(5)
    for demand in (np.zeros(65, int), np.bincount([64] * 9, minlength=65), np.bincount(rng.integers(1, 65, 3000), minlength=65), np.bincount(np.full(5000, 33), minlength=65)):
        patterns = packing.plan(demand, 64)
        held = np.zeros(65, int)
        for times, pattern in patterns:
            assert sum(a * n for a, n in pattern.items()) <= 64
            for a, n in pattern.items():
                held[a] += times * n
        assert (held == demand).all()
    over, most, counts = packing.price(np.where(np.arange(65) == 33, 0.8, 0) + np.where(np.arange(65) == 31, 0.45, 0), 64)
    assert over == pytest.approx(0.25) and most == pytest.approx(1.25) and counts[33] == counts[31] == 1


def test_plan_pads_little_and_leaves_powers_of_two():
    rng = np.random.default_rng(9)
    for demand in (np.bincount(rng.integers(1, 257, 3000), minlength=257), np.bincount(rng.integers(100, 200, 3000), minlength=257), np.bincount([128] * 5 + [192] * 40, minlength=257)):
        patterns, use, gap = packing.solve(demand, 256)
        cost = packing.costs_of(256)
        assert gap <= max(packing.GAP, 256 / (demand @ np.arange(257)))
        held = sum(x * p for p, x in zip(patterns, use, strict=True))
        assert np.allclose(held, demand[demand > 0])
        total = sum(times * cost[sum(a * n for a, n in p.items())] for times, p in packing.plan(demand, 256))
        lengths = np.flatnonzero(demand)
        fractional = sum(x * cost[int(p @ lengths)] for p, x in zip(patterns, use, strict=True))
        assert fractional - 1e-6 <= total <= fractional + len(lengths)
    assert cost[128] == 0.5 and cost[129] == 1 and cost[256] == 1


def brute_sets(text, words=4):
    import re

    low = text.translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_shingles_count_as_brute_force():
    for t in (*TEXTS, "A b c d a B c d a b", "one two three"):
        assert len(near_copies.shingles(t)) == len(brute_sets(t))
    assert (near_copies.shingles("ONE two\nthree") == near_copies.shingles("one\ttwo three")).all()


def test_linked_sets_share_a_key_and_pass_the_bound():
    rng = np.random.default_rng(7)
    bands = near_copies.Bands(Fraction(85, 100))
    for n in (6, 7, 13, 40, 133, 700, 3000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            most = near_copies.differ(Fraction(85, 100), n, n) // 2
            b = np.unique(np.concatenate([a[: n - int(rng.integers(0, most + 1))], rng.integers(0, 1 << 64, int(rng.integers(0, most + 1)), dtype=np.uint64)]))
            if not near_copies.linked(a, b):
                continue
            common = set(bands.of(len(a))) & set(bands.of(len(b)))
            assert any(set(bands.keys(a, k).tolist()) & set(bands.keys(b, k).tolist()) for k in common)
            k = common.pop()
            assert np.minimum(bands.point(a, k), bands.point(b, k)).sum() >= len(np.intersect1d(a, b))


def test_r_tree_equals_all_pairs():
    rng = np.random.default_rng(9)
    base = rng.poisson(2, (6, 40))
    points = np.maximum(base[rng.integers(0, 6, 150)] + rng.integers(-1, 2, (150, 40)) * (rng.random((150, 40)) < 0.1), 0).astype(np.uint8)
    sizes, comp = points.sum(axis=1).astype(np.int64), rng.integers(0, 40, 150)
    got, _ = near_copies.RTree(points, sizes, Fraction(85, 100)).pairs(comp)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if comp[i] != comp[j] and np.minimum(points[i], points[j]).sum() * 1.85 >= 0.85 * (sizes[i] + sizes[j]) - 1e-6 and min(sizes[i], sizes[j]) >= 0.85 * max(sizes[i], sizes[j]) - 1e-6}
    assert {tuple(sorted(p)) for p in got.tolist()} == want


def test_edits_count_as_whole_texts():
    enc = PieceEncoder(tokenizer_path("byte_bpe_50k.json"), False)
    count = lambda xs: [len(r) // 4 for r in enc.ids(xs)]
    rng = random.Random(2)
    for _ in range(40):
        text = " ".join(rng.choice(["alpha", "beta,", "γάμμα", "x1y2", "end.\nNew", "  ", "\t"]) for _ in range(rng.randrange(0, 120)))
        tree = edit_counts.EditTree(text, count)
        for _ in range(6):
            at, gone, new = rng.randrange(-3, len(text) + 9), rng.randrange(0, 40), rng.choice(["", " ", "word", " two words", "\n", "  ", "é" * 400])
            tree.edit(at, gone, new)
            lo = min(max(0, at), len(text))
            text = text[:lo] + new + text[lo + gone :]
            assert tree.text == text and tree.tokens == len(enc.encode_whole(text)) // 4 and tree.chars == len(text)


def test_edit_reads_only_its_region():
    enc = PieceEncoder(tokenizer_path("byte_bpe_50k.json"), False)
    tree = edit_counts.EditTree("some ordinary words " * 2000 + "end", lambda xs: [len(r) // 4 for r in enc.ids(xs)])
    tree.encoded_chars = 0
    tree.edit(20_000, 3, "abc")
    assert tree.encoded_chars < 500


def brute_repair(roles):
    best = {(chat.START, 0): 0}
    costs = [chat.FAR] * 4
    costs[chat.START] = 0
    for r in roles:
        costs, _ = chat.advance(costs, r)
    del best
    return min(c + chat.END[s] for s, c in enumerate(costs) if c < chat.FAR)


@pytest.mark.parametrize("roles,cost", [([1, 2], 0), ([0, 1, 2, 1, 2], 0), ([1, 1, 2], chat.MERGE), ([1], chat.INSERT), ([2], chat.INSERT), ([1, 2, 0], chat.MERGE + chat.RELABEL_SYSTEM), ([-1, 2], chat.RELABEL), ([], 0)])
def test_repair_costs(roles, cost):
    assert brute_repair(roles) == cost


def test_parts_join_to_the_same_repair():
    rng = random.Random(4)
    for _ in range(100):
        roles = [rng.choice([-1, 0, 1, 2]) for _ in range(rng.randrange(1, 14))]
        cuts = sorted(rng.randrange(0, len(roles) + 1) for _ in range(2))
        parts = [p for p in (roles[: cuts[0]], roles[cuts[0] : cuts[1]], roles[cuts[1] :]) if p]
        ends = chat.between([chat.matrix(p) for p in parts])
        steps = [s for p, (a, b) in zip(parts, ends, strict=True) for s in chat.solve(p, a, b)]

        def total(steps, roles=roles):
            return sum(chat.render(r, "", s, k, i == len(roles) - 1)[2] for i, (r, (s, k)) in enumerate(zip(roles, steps, strict=True)))

        assert total(steps) == total(chat.solve(roles)) == brute_repair(roles)


@pytest.mark.parametrize("expression,free", [("mit", True), ("gpl-3.0", False), ("mit or gpl-3.0", True), ("mit and gpl-3.0", False), ("gpl-2.0 with classpath-exception", True), ("(mit or gpl) and apache-2.0", True), ("mit and unknown", None), ("gpl or mit and apache", True)])
def test_license_expressions(expression, free):
    assert licenses.evaluate(licenses.to_postfix(licenses.tokens_of(expression))) is free


@pytest.mark.parametrize("bad", ["", "and", "mit mit", "(mit", "mit)", "mit or", "()"])
def test_malformed_expressions(bad):
    assert licenses.to_postfix(licenses.tokens_of(bad)) is None


def test_license_places():
    s = licenses.Scanner()
    got = s.scan("The MIT License; mit license. GNU General  Public-License\nSPDX-License-Identifier: MIT OR Apache-2.0\n")
    assert got[:5] == (17, 3, 1, 6, "gpl,mit") and got[5] == "apache,gpl,mit" and got[7] == "mit or apache-2.0" and got[8] is True
    assert s.scan(None)[:5] == (0, 0, None, None, "") and s.scan("mit licenses")[1] == 0


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]
