"""Edit-aware token counts.

A document is cut into leaves of pre-tokens at places that no token can span (before a
single space between other characters). A segment tree holds the sums of the leaves'
token and character counts. An edit finds its leaves by descending the character sums,
re-encodes only these and as much boundary context as makes both ends safe cuts again,
and updates the sums above them.

build_trees() keeps the trees as rows: a document's leaves and their token counts, from
which the sums above follow. edit_trees() takes stored trees with edits and gives the
trees after them, without encoding any leaf that an edit does not touch, so tables of
trees go from one round of edits to the next.

Defined results: null text counts as empty and has one empty leaf; an edit's position and
length are clipped to the text; a null edit or position changes nothing, a null length or
insertion counts as none; null doc_ids and repeated rows are counted each; other columns
stay (those named leaves and counts are replaced); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table, written
from .tokens import PieceEncoder, encoder, tokenizer_path

#: Characters of a leaf at least, and of a leaf that is split anew.
LEAF, SPLIT = 96, 768


def safe(text: str, at: int) -> bool:
    """Whether text may be cut before position at."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    out, start, at = [], 0, size
    while (at := text.find(" ", at)) >= 0:
        if safe(text, at):
            out.append(text[start:at])
            start, at = at, at + size
        else:
            at += 1
    out.append(text[start:])
    return out


class EditTree:
    """Token counts of one text under edits. count: token counts of texts that begin and end at safe cuts."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]]):
        self._count, self.encoded_leaves, self.encoded_chars = count, 0, 0
        self._load(*self._encode(leaves_of(text)))

    @classmethod
    def stored(cls, leaves: list[str], counts: list[int], count: Callable[[list[str]], list[int]]) -> EditTree:
        """The tree of stored leaves; nothing is encoded."""
        tree = cls.__new__(cls)
        tree._count, tree.encoded_leaves, tree.encoded_chars = count, 0, 0
        tree._load(leaves, counts)
        return tree

    def rows(self) -> tuple[list[str], list[int]]:
        """Leaves that hold text (one at least) and their counts, to be stored."""
        kept = [k for k, leaf in enumerate(self.leaves) if leaf] or [0]
        return [self.leaves[k] for k in kept], [self._sums[0][self._base + k] for k in kept]

    def _encode(self, leaves: list[str]) -> tuple[list[str], list[int]]:
        self.encoded_leaves += len(leaves)
        self.encoded_chars += sum(map(len, leaves))
        return leaves, self._count(leaves)

    def _load(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves = leaves
        self._base = 1 << max(0, len(leaves) - 1).bit_length()
        self._sums = [[0] * (2 * self._base) for _ in range(2)]
        for sums, values in zip(self._sums, (counts, map(len, leaves)), strict=True):
            sums[self._base : self._base + len(leaves)] = values
            for i in range(self._base - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def tokens(self) -> int:
        return self._sums[0][1]

    @property
    def chars(self) -> int:
        return self._sums[1][1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (or the last one), and the characters before it."""
        i, before, chars = 1, 0, self._sums[1]
        while i < self._base:
            i *= 2
            if at >= before + chars[i] and chars[i + 1]:
                before += chars[i]
                i += 1
        return i - self._base, before

    def _set(self, k: int, leaf: str, count: int) -> None:
        self.leaves[k] = leaf
        i = k + self._base
        self._sums[0][i], self._sums[1][i] = count, len(leaf)
        while i > 1:
            i //= 2
            for sums in self._sums:
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    def _neighbour(self, k: int, step: int) -> int | None:
        k += step
        while 0 <= k < len(self.leaves) and not self.leaves[k]:
            k += step
        return k if 0 <= k < len(self.leaves) else None

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace `delete` characters from `at` by insert."""
        at = min(max(0, at), self.chars)
        delete = min(max(0, delete), self.chars - at)
        if not delete and not insert:
            return
        first, before = self._find(at)
        last, start = self._find(max(at, at + delete - 1))
        first, last = min(first, last), max(first, last)
        old = "".join(self.leaves[first : last + 1])
        new = old[: at - before] + insert + old[at - before + delete :]
        while (k := self._neighbour(first, -1)) is not None and not (new and safe(self.leaves[k][-1] + new, 1)):
            first, new = k, self.leaves[k] + new
        while (k := self._neighbour(last, 1)) is not None and not (new and safe(new[-1] + self.leaves[k], 1)):
            last, new = k, new + self.leaves[k]
        parts, counts = self._encode(leaves_of(new))
        if len(new) <= SPLIT or len(parts) <= last + 1 - first:
            for k in range(first, last + 1):
                self._set(k, "", 0)
            if len(parts) <= last + 1 - first:
                for k, (leaf, count) in enumerate(zip(parts, counts, strict=True), first):
                    self._set(k, leaf, count)
            else:
                self._set(first, new, sum(counts))
            return
        kept = [(leaf, self._sums[0][self._base + k]) for k, leaf in enumerate(self.leaves) if not first <= k <= last]  # a new shape, nothing encoded anew
        all_ = [*kept[:first], *zip(parts, counts, strict=True), *kept[first:]]
        self._load([leaf for leaf, _ in all_], [n for _, n in all_])


EDIT = "struct<at:long,delete:long,insert:string>"
TREE = [T.StructField("leaves", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))]
_STORED = (pa.list_(pa.string()), pa.list_(pa.int64()))
#: What edit_trees() adds: tokens before and after, characters and CRC-32 of the text after, leaves, and what the edits had encoded anew.
COUNTED = ("n_tokens", "n_tokens_after", "n_chars_after", "text_crc32", "n_leaves", "leaves_encoded", "chars_encoded")


def build_trees(docs: DataFrame, tokenizer: str, word_ends: bool = False) -> DataFrame:
    """docs with the tree of each text (leaves, counts) in place of the text."""
    docs = docs.drop("leaves", "counts")
    at = docs.columns.index("text")
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc: PieceEncoder = encoder(tokenizer, word_ends)
        for b in batches:
            leaves, counts = [], []
            texts = b.column(at).to_pylist()
            for i in range(0, len(texts), 128):
                cut = [leaves_of(t or "") for t in texts[i : i + 128]]
                found = iter(enc.ids([x for c in cut for x in c]))
                leaves += cut
                counts += [[len(next(found)) // 4 for _ in c] for c in cut]
            own = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip((leaves, counts), _STORED, strict=True))], names=[*rest, "leaves", "counts"])

    return map_arrow(docs, run, T.StructType([*(docs.schema[c] for c in rest), *TREE]), keeps="tokens")


def edit_trees(trees: DataFrame, tokenizer: str, word_ends: bool = False) -> DataFrame:
    """Stored trees after their edits (array of EDIT, applied in order), and COUNTED; the edits are dropped."""
    trees = trees.drop(*COUNTED)
    rest = [c for c in trees.columns if c not in ("leaves", "counts", "edits")]
    trees = trees.select(*rest, "leaves", "counts", F.col("edits").cast(f"array<{EDIT}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc: PieceEncoder = encoder(tokenizer, word_ends)

        def count(leaves: list[str]) -> list[int]:
            return [len(x) // 4 for x in enc.ids(leaves)]

        for b in batches:
            leaves, counts, rows = [], [], []
            for own_leaves, own_counts, edits in zip(*(b.column(len(rest) + k).to_pylist() for k in range(3)), strict=True):
                tree = EditTree.stored(own_leaves, own_counts, count)
                before = tree.tokens
                for e in edits or ():
                    if e and e["at"] is not None:
                        tree.edit(e["at"], e["delete"] or 0, e["insert"] or "")
                stored = tree.rows()
                leaves.append(stored[0])
                counts.append(stored[1])
                rows.append((before, tree.tokens, tree.chars, zlib.crc32(tree.text.encode()), len(stored[0]), tree.encoded_leaves, tree.encoded_chars))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in COUNTED]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *(pa.array(v, t) for v, t in zip((leaves, counts), _STORED, strict=True)), *(pa.array(c, pa.int64()) for c in columns)], names=[*rest, "leaves", "counts", *COUNTED])

    return map_arrow(trees, run, T.StructType([*(trees.schema[c] for c in rest), *TREE, *(T.StructField(c, T.LongType()) for c in COUNTED)]), keeps="tokens")


def count_with_edits(docs: DataFrame, tokenizer: str, word_ends: bool = False) -> DataFrame:
    """Token counts of docs (text, edits: array of EDIT, applied in order) before and after the edits, without the trees."""
    return edit_trees(build_trees(docs, tokenizer, word_ends), tokenizer, word_ends).drop("leaves", "counts")


def sample_edits(text) -> Column:
    """Three edits of every text: a replacement at a third, an insertion at two thirds, a deletion before the end."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("long")

    def edit(at, delete: int, insert: str):
        return F.struct(at.cast("long").alias("at"), F.lit(delete).cast("long").alias("delete"), F.lit(insert).alias("insert"))

    return F.array(edit(F.floor(n / 3), 5, " revised"), edit(F.floor(2 * n / 3), 0, " one more clause,"), edit(n - 9, 7, ""))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    trees = written(build_trees(table(spark, sf_dir, "documents").select("doc_id", "text"), path), "trees")
    edited = edit_trees(trees.withColumn("edits", sample_edits(F.array_join("leaves", ""))), path)
    return edited.select(F.col("doc_id").cast("long"), *COUNTED)
