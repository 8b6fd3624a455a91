"""Merge tables of byte-level BPE vocabularies (``tokenizers`` JSON files), shared by token counts and BPE coding.

A word is a string of symbols: ``chr(b)`` for byte ``b``, ``chr(256 + b)`` for
the last byte of a word where the vocabulary marks word ends.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Regex, normalizers, pre_tokenizers

INFINITE = 1 << 60
#: Pairs of tokens whose fit is remembered; the table is emptied when it is full.
MAX_PAIRS = 300_000
#: Bits of a token id in the key of a pair.
ID_BITS = 24


def byte_letters() -> dict[str, int]:
    """Letter of the file -> byte: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Merges:
    """Tokens, how each was merged, and which tokens may stand next to each other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.word_end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}

        def symbols(token: str) -> str:
            ends = bool(self.word_end) and token.endswith(self.word_end)
            units = [letters[c] for c in (token.removesuffix(self.word_end) if ends else token)]
            return "".join(map(chr, units[:-1])) + chr(units[-1] + 256 * ends)

        vocab = model["vocab"]
        size = max(vocab.values()) + 1
        self.ids: dict[str, int] = {}
        #: by token: rank of the merge that makes it (-1: a single symbol), and its two halves
        self.rank, self.left, self.right = (array("i", [-2]) * size for _ in range(3))
        self.pairs: dict[int, int] = {}
        for token, i in vocab.items():
            if len(s := symbols(token)) == 1:
                self.ids[s], self.rank[i] = i, -1
        for r, (a, b) in enumerate(model["merges"]):
            token, a, b = a + b, vocab[a], vocab[b]
            i = vocab[token]
            self.pairs[a << ID_BITS | b] = i
            if self.rank[i] == -2:
                self.ids[symbols(token)] = i
                self.rank[i], self.left[i], self.right[i] = r, a, b
        self.text = {i: s for s, i in self.ids.items()}
        #: pairs tried so far
        self.known: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """True if token *b* may follow token *a*: no merge across their border comes before those that made them.

        The pieces on both sides of the border are taken apart from the latest
        merge back to the first. A cross merge of rank r would win if it ranks
        before the merge that used up the left piece, and not after the one that
        used up the right piece (equal ranks go from left to right).
        """
        key = a << ID_BITS | b
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= MAX_PAIRS:
                self.known.clear()
            known = self.known[key] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        rank, used_a, used_b = self.rank, INFINITE, INFINITE
        while True:
            cross = self.pairs.get(a << ID_BITS | b)
            if cross is not None and rank[cross] < used_a and rank[cross] <= used_b:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                used_a, a = ra, self.right[a]
            else:
                used_b, b = rb, self.left[b]

    def trim(self) -> None:
        """Empty the table of tried pairs; it fills again."""
        self.known.clear()

    def special_pattern(self) -> re.Pattern | None:
        """Finds the added tokens, which the library takes out of a text before anything else."""
        if not self.added:
            return None
        return re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    """One table per worker process."""
    return Merges(path)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def every_char() -> str:
    return "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)


def chars_matching(runs: re.Pattern) -> np.ndarray:
    """Which characters Python's own engine takes for a class, given as a pattern of its runs."""
    out = np.zeros(0x110000, bool)
    text = every_char()
    codes = codes_of(text)
    for m in runs.finditer(text):
        out[codes[m.start(): m.end()]] = True
    return out


def chars_of(pattern: str) -> str:
    """The characters that the library's own regex engine takes for a class; its Unicode version is not Python's."""
    split, text = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True), every_char()
    blocks = (text[at: at + (1 << 15)] for at in range(0, len(text), 1 << 15))  # the library holds far more per character
    return "".join(piece for block in blocks for piece, _ in split.pre_tokenize_str(block))


def lower_exceptions() -> dict[str, str]:
    """Characters whose lower case differs between the library and Python, word-final sigma aside."""
    low = normalizers.Lowercase()
    return {c: x for c in every_char() if c != "Σ" and (x := low.normalize_str(c)) != c.lower()}
