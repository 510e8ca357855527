"""Token ids of whole texts by a public tokenizer file, memoised per white-space word."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import is_normalized, ucd_3_2_0

import numpy as np

_MEMO_LIMIT = 350_000
_ODD_SPACES = "\x1c\x1d\x1e\x1f"
_CACHE: dict[str, WordTokenizer] = {}
# The normaliser and pre-tokenizer under which a text's ids are its words' ids.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def _packed(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(1 << 16)
def settled(letter: str) -> bool:
    """A letter, and letters when lower-cased, since a version of Unicode that every tool knows."""
    return all(ucd_3_2_0.category(c)[0] == "L" for c in letter + letter.lower())


def letters_only(word: str) -> bool:
    """Whether a word's lower-case form is letters whichever version of Unicode splits it."""
    return word.isascii() or all(map(settled, word))


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes.

    Where a file's normaliser and pre-tokenizer are the ones below, which drop white space and split
    letters, digits and signs, a text's ids are the ids of its white-space words one after another: each
    distinct word is encoded once per worker, and the memo is emptied when it is full. Other files'
    texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_word = (told["normalizer"], told["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(size, dtype=bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.closes[i] = piece.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Put new words into the memo. Lower-case ASCII letters go straight to the model; other
        letters-only words are encoded together, each ending at the next piece that closes a word."""
        memo, one_word = self.memo, self.tokenizer.model.tokenize
        pack = _packed
        tailed = [w for w in words if w[-1] in ".,!?" and w[:-1].isalpha() and letters_only(w[:-1]) and is_normalized("NFC", w[:-1])]
        plain = {w for w in words if w.isalpha()}
        plain.update(w[:-1] for w in tailed)
        letters = []
        for w in plain.difference(memo):
            if w.isascii():
                memo[w] = pack(*[t.id for t in one_word(w.lower())])
            elif "Σ" not in w and letters_only(w) and is_normalized("NFC", w):
                memo[w] = pack(*[t.id for t in one_word(w.lower().encode().decode("latin-1").translate(_BYTE_LETTERS))])
            else:
                letters.append(w)
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(letters) and ends[-1] == len(ids):
                at = 0
                for w, end in zip(letters, ends.tolist(), strict=True):
                    memo[w] = ids[at:end].tobytes()
                    at = end
            else:
                for w in letters:
                    memo[w] = self._encode(w)
        for w in tailed:
            memo[w] = memo[w[:-1]] + self._tail(w[-1])
        for w in words.difference(memo):
            memo[w] = self._encode(w)

    def _tail(self, mark: str) -> bytes:
        found = self.memo.get(mark)
        if found is None:
            found = self.memo[mark] = self._encode(mark)
        return found

    def ids(self, text: str | None) -> bytes:
        return next(self.ids_of([text]))

    def ids_of(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; the new words of all of them are learned together."""
        split = [None if t and (not self.by_word or any(c in t for c in _ODD_SPACES)) else (t.lower() if t.isascii() else t).split() if t else [] for t in texts]
        new = set()
        for words in split:
            if words:
                new.update(set(words).difference(self.memo))
        if len(self.memo) + len(new) > _MEMO_LIMIT:
            self.memo.clear()
            new = {w for words in split if words for w in words}
        if new:
            self._learn(new)
        known = self.memo.__getitem__
        for text, words in zip(texts, split, strict=True):
            yield self._encode(text) if words is None else b"".join(map(known, words))


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _CACHE:
        _CACHE[path] = WordTokenizer(path)
    return _CACHE[path]


def public_path(name: str) -> Callable[[], str]:
    """A function that finds a public tokenizer's file on whichever machine it runs."""
    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find
