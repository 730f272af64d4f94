"""License scans: Aho-Corasick over words finds notice phrases and identifier tags, a
shunting-yard parser evaluates the and/or/with expressions behind the tags.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of all non-ASCII bytes.
A phrase fits where its words stand consecutively; overlapping places all count.

Defined results: null or empty text has no words, no labels, null places and score 0;
a malformed expression yields its known identifiers as labels and no verdict; repeated
rows are judged each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, record_batch, table

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases of the method, in the words' own form.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
}
#: Tags that an expression follows on the same line.
TAGS = ("spdx license identifier", "license expression")
#: Identifier prefixes of expressions, longest first, and their labels.
IDENTIFIERS = {"cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by": "cc-by", "cc0": "cc0", "apache": "apache", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "mit": "mit", "mpl": "mpl", "bsd": "bsd", "isc": "isc", "bsl": "bsl", "unlicense": "unlicense"}
#: Labels whose texts may be used freely; an exception behind "with" lifts a copyleft label.
FREE = frozenset({"mit", "apache", "bsd", "isc", "cc0", "cc-by", "public-domain", "bsl", "unlicense", "mpl"})
#: Weight of one place of a phrase or tag in the score: 1 - (1 - WEIGHT) ** places.
WEIGHT = 0.5
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Bytes that separate words become spaces, A-Z become lower case.
_TO_WORDS = bytes(32 if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_EXPRESSION_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.+-() \t")


def tokens_of(expression: str) -> list[str]:
    return expression.replace("(", " ( ").replace(")", " ) ").split()


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: operators by precedence with over and over or; None if malformed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for t in tokens:
        if t in _PRECEDENCE:
            if operand_next:
                return None
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[t]:
                out.append(held.pop())
            held.append(t)
            operand_next = True
        elif t == "(":
            if not operand_next:
                return None
            held.append(t)
        elif t == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


#: What follows a listed identifier within a word: no letter, or a version.
_ENDS = re.compile(r"(?![^\W\d_])|v[0-9]")


def label_of(identifier: str) -> str | None:
    """Label of an identifier that is a listed one, alone or followed by a version or variant; a longer word is another identifier."""
    return next((label for prefix, label in IDENTIFIERS.items() if identifier.startswith(prefix) and _ENDS.match(identifier, len(prefix))), None)


def evaluate(postfix: list[str]) -> bool | None:
    """Whether the expression leaves a free choice: or needs one side, and both; an identifier with an exception counts as free. None: an unknown identifier decides."""
    stack: list = []
    for t in postfix:
        if t not in _PRECEDENCE:
            label = label_of(t)
            stack.append((None if label is None else label in FREE, t))
            continue
        (b, name), (a, _) = stack.pop(), stack.pop()
        if t == "with":  # other words behind it lift nothing
            value = True if a is not None and "exception" in name else a
        elif t == "or":
            value = True if a or b else None if a is None or b is None else False
        else:
            value = False if a is False or b is False else None if a is None or b is None else True
        stack.append((value, ""))
    return stack[0][0]


def expression_after(text: str) -> str:
    """The expression at the start of text: up to the line's end or the first character or word that can't belong to one."""
    line = text.split("\n", 1)[0].lstrip(": \t").lower()
    end = next((i for i, c in enumerate(line) if c not in _EXPRESSION_CHARS), len(line))
    kept: list[str] = []
    depth = 0
    for t in tokens_of(line[:end]):
        operand_next = not kept or kept[-1] in _PRECEDENCE or kept[-1] == "("
        if operand_next == (t in _PRECEDENCE or t == ")") or t == ")" and not depth:
            break
        depth += (t == "(") - (t == ")")
        kept.append(t)
    return " ".join(kept).rstrip(".") if kept else ""


class Scanner:
    """Finds phrases and tags in whole texts; phrases: extra {words: label} of the caller."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS):
        self._found = ahocorasick.Automaton()
        for kind, phrases in (("base", base), ("notice", notices), ("tag", {t: t for t in tags})):
            for phrase, label in phrases.items():
                old = self._found.get(f" {phrase} ", ())
                self._found.add_word(f" {phrase} ", (*old, (kind, label, len(phrase) + 2)))
        self._found.make_automaton()
        self._tags = ahocorasick.Automaton()
        for tag in tags:
            for form in {tag, tag.replace(" ", "-"), tag.replace(" ", "_")}:
                self._tags.add_word(form, form)
        self._tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, allowed."""
        words = (text or "").encode().translate(_TO_WORDS).split()
        joined = " " + b" ".join(words).decode() + " "
        places: list[int] = []
        base, labels, n, tagged = set(), set(), 0, False
        for end, kinds in self._found.iter(joined):
            for kind, label, length in kinds:
                if kind == "tag":
                    tagged = True
                    continue
                n += 1
                labels.add(label)
                if kind == "base":
                    base.add(label)
                    places.append(end + 1 - length)
        expressions, allowed = [], None
        if tagged:
            lower = text.lower()
            for end, _ in self._tags.iter(lower):
                expression = expression_after(lower[end + 1 : stop if (stop := lower.find("\n", end)) >= 0 else None])
                if not expression:
                    continue
                n += 1
                postfix = to_postfix(tokens_of(expression))
                labels |= {x for t in tokens_of(expression) if t not in _PRECEDENCE and (x := label_of(t))}
                expressions.append(expression)
                if postfix:
                    free = evaluate(postfix)
                    allowed = free if allowed is None else allowed and free
        if not expressions and labels:
            allowed = labels <= FREE
        first = joined.count(" ", 0, min(places) + 1) - 1 if places else None
        last = joined.count(" ", 0, max(places) + 1) - 1 if places else None
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - (1 - WEIGHT) ** n, "; ".join(expressions), allowed


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, allowed boolean"
_OUT = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in OUT.split(", ")])


def scan_licenses(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices=notices)
        for b in batches:
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            yield record_batch(_OUT, [b.column(0), *map(list, zip(*rows, strict=True))] if rows else [[] for _ in _OUT])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, OUT)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
