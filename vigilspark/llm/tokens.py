"""Token ids of whole texts by the tokenizers library, with a bounded cache of the ids of text pieces.

A text is cut only where no token of its vocabulary can span the cut, each piece is
encoded by the library once, and the ids of the pieces are joined. Texts with other
white space than single spaces and line feeds, or with a token that the vocabulary adds
(like its end of text, which gives one id), are encoded in one go.

A text's words are told apart by Arrow, group by group, so that Python sees each distinct
word of a group once. A word that ends in punctuation is two pieces, and where the
tokenizer lower-cases, words in either case are one. A piece of letters alone goes to the
library's model at once; all others take the whole way through its normaliser and
pre-tokenizer. Whether a tokenizer allows either is tried for each letter and mark.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import caches

#: Pieces whose ids one worker keeps (about 120 MB); a full cache keeps those used since it was half full.
CACHE_PIECES = 500_000
#: Bits that tell which pieces have been met (1 MB); most are met once, and a piece is kept from its second time on.
MET_BITS = 1 << 23
#: New pieces that one call of the library encodes.
JOINED_PIECES = 2000
#: Characters of the texts whose words are told apart at once; a longer text is a group of its own.
GROUP_CHARS = 4 << 20
#: Fewer characters than this are not worth Arrow's calls.
FEW_CHARS = 1 << 13
_FIRST = "\0"
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "\u00aa\u00b5\u00ba")
#: ASCII punctuation without the apostrophe, which begins contractions.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_PLAIN = f"[\\x00-\\x7f{_LETTERS}]*"
#: The character that stands for each byte in vocabularies of bytes.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _taken(ids: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the runs named by index, one after another, and their sizes; runs of these sizes lie in ids."""
    n = sizes[index]
    places = np.repeat((np.cumsum(sizes) - sizes)[index] - np.cumsum(n) + n, n)
    places += np.arange(len(places))
    return ids[places], n


class PieceEncoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    word_ends: the vocabulary drops white space, so every space or line feed is a safe cut.
    Otherwise a safe cut is before a space or line feed that has other characters on both sides.
    """

    def __init__(self, path: str, word_ends: bool, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tok = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values() if t.content]
        self._word_ends, self._limit = word_ends, cache_pieces
        self._cache: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._met, self._n_met = bytearray(MET_BITS // 8), 0
        self._model, show = self._tok.model, self._tok.normalizer
        whole = self.encode_whole
        self._folds = word_ends and show is not None and all(show.normalize_str(f"x{c}x") == f"x{c.lower()}x" for c in _LETTERS)
        self._parts = all(whole(f"{c}{m}{n}") == whole(c) + whole(m + n) for c, m in [*((c, ".") for c in _LETTERS), *(("a", m) for m in _MARKS)] for n in ("", m))
        letters = _LETTERS.lower() if self._folds else _LETTERS
        direct = all(whole(t) == self._by_model(t) for c in letters for t in (c, f"a{c}b", *([] if word_ends else [f" {c}", f" a{c}b"])))
        self._word = re.compile((f"[{letters}]+" if word_ends else f" ?[{letters}]+") if direct else "(?!)")

    def encode_whole(self, text: str) -> bytes:
        return np.asarray(self._tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _by_model(self, text: str) -> bytes:
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(_BYTES)
        elif text[0] == " ":
            text = _BYTES[32] + text[1:]
        ids = [t.id for t in self._model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cuts(self, text: str) -> bool:
        """Whether a text may be cut at its spaces and line feeds."""
        if any(t in text for t in self._added):
            return False
        if self._word_ends:
            return True
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or not text.replace("\n", "").isprintable() or text[:1] == "\n" or text[-1:] in (" ", "\n"))

    def _text_of(self, key: str) -> str:
        if self._word_ends or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == _FIRST else " " + key

    def _again(self, key: str) -> bool:
        """Whether a piece has been met before, by its hash: a false yes only keeps a piece early."""
        at = hash(key) % MET_BITS
        bit = 1 << (at & 7)
        if self._met[at >> 3] & bit:
            return True
        if self._n_met >= MET_BITS // 4:
            self._met, self._n_met = bytearray(MET_BITS // 8), 0
        self._met[at >> 3] |= bit
        self._n_met += 1
        return False

    def _learn(self, keys: list[str]) -> list[bytes]:
        """Encode the pieces side by side in one text, which their safe cuts allow, and part the ids by offset."""
        texts = [self._text_of(k) for k in keys]
        if self._word_ends:
            lead = [" "] * len(texts)
        else:  # a piece without a leading space or line feed is set off by a line feed
            lead = ["" if t[:1] in (" ", "\n") else "\n" for t in texts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        gap = np.fromiter(map(len, lead), np.int64, len(lead))
        start = np.cumsum(size + gap) - size
        enc = self._tok.encode("".join(chain.from_iterable(zip(lead, texts, strict=True))), add_special_tokens=False)
        ids = np.array(enc.ids, dtype="<u4")
        at = np.fromiter((o[0] for o in enc.offsets), np.int64, len(ids))
        cut = np.searchsorted(at, start).tolist()
        end = np.searchsorted(at, start + size).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cut, end, strict=True)]

    def _encoded(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct pieces, from the cache or else by the library."""
        cache, old = self._cache, self._old
        out = list(map(cache.get, keys))
        new, rest = [i for i, raw in enumerate(out) if raw is None], []
        texts = [keys[i] for i in new] if self._word_ends else [self._text_of(keys[i]) for i in new]
        is_word, by_model, again = self._word.fullmatch, self._by_model, self._again
        for i, text in zip(new, texts, strict=True):
            key = keys[i]
            raw = old.get(key) if text else b""
            if raw is not None:
                cache[key] = raw
            elif is_word(text):
                raw = by_model(text)
                if again(key):
                    cache[key] = raw
            else:
                rest.append(i)
            out[i] = raw
        for at in range(0, len(rest), JOINED_PIECES):
            own = rest[at : at + JOINED_PIECES]
            for i, raw in zip(own, self._learn([keys[i] for i in own]), strict=True):
                out[i] = raw
                if again(keys[i]):
                    cache[keys[i]] = raw
        return out

    def _marked(self, text: str) -> str:
        return text.replace("\n", " ") if self._word_ends else _FIRST + text.replace("\n", " \n")

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts that may be cut."""
        cut = [self._marked(t).split(" ") for t in texts]
        keys = list(set(chain.from_iterable(cut)))
        get = dict(zip(keys, self._encoded(keys), strict=True)).__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def _halves(self, words: pa.Array) -> pa.Array:
        """Each word, in lower case where the tokenizer makes it so, as two: itself without marks behind a letter, and these marks."""
        if self._folds:
            words = pc.if_else(pc.match_substring_regex(words, f"^{_PLAIN}$"), pc.utf8_lower(words), words)
        _, at, data = words.buffers()
        at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
        ends = at[1:]
        if self._parts:
            stems = pc.ascii_rtrim(words, _MARKS)
            ends = np.where(pc.match_substring_regex(stems, f"[{_LETTERS}]$").to_numpy(zero_copy_only=False), at[:-1] + pc.binary_length(stems).to_numpy(), ends)
        at = np.append(np.stack([at[:-1], ends], axis=1).ravel(), at[-1])
        return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(at), data)

    def _gathered(self, texts: list[str]) -> list[bytes]:
        """As _joined(), for texts of many words: words are told apart first, then their halves."""
        cut = pc.split_pattern(pa.array(map(self._marked, texts), pa.large_string()), " ")
        words = cut.values.dictionary_encode()
        halves = self._halves(words.dictionary)
        odd = np.arange(len(halves)) % 2 == 1
        parts = [halves.filter(pa.array(odd == k)).dictionary_encode() for k in (False, True)]
        stems, marks = (p.dictionary.to_pylist() for p in parts)
        known = self._encoded(stems) + self._encoded([m if self._word_ends else _FIRST + m for m in marks])
        index = np.stack([parts[0].indices.to_numpy(), parts[1].indices.to_numpy() + len(stems)], axis=1).ravel()
        ids, sizes = _taken(np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4, index)
        ids, sizes = _taken(ids, sizes.reshape(-1, 2).sum(axis=1), words.indices.to_numpy())
        ends = 4 * np.append(0, np.cumsum(sizes))[cut.offsets.to_numpy()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in pairwise(ends.tolist())]

    def ids(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        group: list[int] = []
        chars = 0

        def close() -> None:
            got = (self._gathered if chars >= FEW_CHARS else self._joined)([texts[k] for k in group])
            for k, raw in zip(group, got, strict=True):
                out[k] = raw
            if len(self._cache) > self._limit // 2:
                self._cache, self._old = {}, self._cache

        for i, text in enumerate(texts):
            if text and not self._cuts(text):
                out[i] = self.encode_whole(text)
            elif text:
                if group and chars + len(text) > GROUP_CHARS:
                    close()
                    group, chars = [], 0
                group.append(i)
                chars += len(text)
        if group:
            close()
        return out


_encoders: dict[tuple, PieceEncoder] = caches.setdefault("tokens", {})


def encoder(path: str, word_ends: bool) -> PieceEncoder:
    """One encoder per worker process, kept between tasks that keep `tokens`."""
    key = (path, word_ends)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, word_ends)
    return _encoders[key]
