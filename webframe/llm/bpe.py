"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can end the encoding of that
prefix. An Aho-Corasick automaton of the vocabulary gives the longest token that
ends at a place, and suffix links the shorter ones. The first that fits behind
the stored last token of the prefix before it is this prefix's last token; one
pass stores it for each prefix, and the back-pointers (prefix minus last token)
give the ids from the end. This needs time linear in the word, however long,
and gives exactly what merging by rank gives.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.merges import ID_BITS, Merges, chars_matching, chars_of, codes_of, load_merges

#: Characters of text whose words are encoded together, and bytes that the tables of words may hold before they are emptied.
GROUP, MAX_HELD = 4 << 20, 40 << 20
#: Spark type of each column that :func:`encode_decode` can return.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


class Matcher:
    """Aho-Corasick automaton over the tokens, in flat tables: ``longest[state]`` is the longest token that ends here, or -1.

    ``step`` has one key per edge, the state above the ten bits of a symbol.
    """

    def __init__(self, tokens: dict[str, int]):
        self.step: dict[int, int] = {}
        self.longest, self.fail = array("i", [-1]), array("i", [0])
        above: list[tuple[int, int]] = [(0, 0)]
        for text, i in tokens.items():
            at = 0
            for c in map(ord, text):
                following = self.step.get(at << 10 | c)
                if following is None:
                    following = self.step[at << 10 | c] = len(self.longest)
                    above.append((at, c))
                    self.longest.append(-1)
                    self.fail.append(0)
                at = following
            self.longest[at] = i
        depth = array("i", [0])
        for at, _ in above[1:]:  # a state is numbered after the one above it
            depth.append(depth[at] + 1)
        #: token -> the longest other token that is a suffix of it, or -1
        self.shorter = array("i", [-1]) * (max(tokens.values(), default=0) + 1)
        for state in sorted(range(1, len(above)), key=depth.__getitem__):
            at, c = above[state]
            back = self.next(self.fail[at], c) if at else 0
            self.fail[state] = back
            own = self.longest[state]
            if own < 0:
                self.longest[state] = self.longest[back]
            else:
                self.shorter[own] = self.longest[back]

    def next(self, at: int, c: int) -> int:
        while (following := self.step.get(at << 10 | c)) is None:
            if not at:
                return 0
            at = self.fail[at]
        return following


class Coder:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, path: str):
        self.merges: Merges = load_merges(path)
        self.matcher = Matcher(self.merges.ids)
        self.length = array("i", [0]) * len(self.merges.rank)
        for s, i in self.merges.ids.items():
            self.length[i] = len(s)
        self.special = self.merges.special_pattern()
        self.bytes_of = {i: bytes(ord(c) % 256 for c in s) for s, i in self.merges.ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.merges.added.items()}
        #: of the words met so far: their ids as decimals joined by commas, and the bytes that these decode to
        self.digits: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.held = 0
        # Python's own classes are fast, but not quite the library's: texts that hold a character of the difference
        # are cut by the library's classes, spelled out.
        classes = {r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d", r"\s": r"\s"}
        own = [chars_of(p) for p in classes]
        self.fast = re.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
        ).findall
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
        self.spelled_out = regex.compile(_pattern(*map(_ranges, own))).findall
        self.differs = np.zeros(0x110000, bool)
        for here, chars in zip(classes.values(), own, strict=True):
            library = np.zeros(0x110000, bool)
            library[codes_of(chars)] = True
            self.differs |= library ^ chars_matching(re.compile(f"(?:{here})+"))
        ascii_own = [r"[A-Za-z]+", r"[0-9]+", r"\s+"]
        self.plain_fits = all(
            not (chars_matching(re.compile(here, re.ASCII))[:128] ^ np.isin(np.arange(128), codes_of(chars))).any()
            for here, chars in zip(ascii_own, own, strict=True))

    def forget(self) -> None:
        """Empty all tables that grow with the texts."""
        self.digits.clear()
        self.decoded.clear()
        self.held = 0
        self.merges.trim()

    def encode_words(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of each word, given as its bytes. Prefixes shared with the word before are not gone through again: sort the words."""
        edges, longest, shorter, fail = self.matcher.step, self.matcher.longest, self.matcher.shorter, self.matcher.fail
        length, known, fits = self.length, self.merges.known, self.merges.fits
        last: list[int] = []  # the last token of every prefix
        states = [0]
        before_word = b""
        for word in words:
            same, most = 0, min(len(word), len(before_word))
            while same < most and word[same] == before_word[same]:
                same += 1
            del last[same:], states[same + 1:]
            before_word = word
            at = states[same]
            for i in range(same, len(word)):
                c = word[i]
                following = edges.get(at << 10 | c)
                while following is None and at:
                    at = fail[at]
                    following = edges.get(at << 10 | c)
                at = following or 0
                token = longest[at]
                before = i - length[token]
                while before >= 0:
                    fit = known.get(last[before] << ID_BITS | token)
                    if fit or (fit is None and fits(last[before], token)):
                        break
                    token = shorter[token]
                    before = i - length[token]
                last.append(token)
                states.append(at)
            ids = []
            end = len(word)
            while end:
                token = last[end - 1]
                ids.append(token)
                end -= length[token]
            ids.reverse()
            yield ids

    def encode_word(self, word: bytes) -> list[int]:
        return next(self.encode_words([word]))

    def learn(self, words: set[str]) -> None:
        """Enter what is not known yet of the words of some texts; the tables are emptied first if they have grown too large."""
        if self.held > MAX_HELD:
            self.digits.clear()
            self.decoded.clear()
            self.held = 0
        new = sorted(words.difference(self.digits))
        added, bytes_of = self.merges.added, self.bytes_of
        ordinary = [w for w in new if w not in added]  # ordinary words are cut so that none looks like a special string
        for w, ids in zip(ordinary, self.encode_words(w.encode() for w in ordinary), strict=True):
            self.digits[w] = ",".join(map(str, ids))
            self.decoded[w] = b"".join([bytes_of[i] for i in ids])
            self.held += 200 + 8 * len(w)
        for w in words.intersection(added):
            self.digits[w], self.decoded[w] = str(added[w]), bytes_of[added[w]]

    def words_in(self, text: str) -> list[str]:
        """The words and special strings of a text, in order; special strings are taken out first, as the library does."""
        if self.plain_fits and text.isascii():
            find = self.plain
        else:
            find = self.spelled_out if self.differs[codes_of(text)].any() else self.fast
        if not self.special or "<|" not in text:
            return find(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(part)
            else:
                out += find(part)
        return out

    def encode(self, text: str | None) -> list[int]:
        words = self.words_in(text or "")
        self.learn(set(words))
        joined = ",".join(map(self.digits.__getitem__, words))
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def _ranges(chars: str) -> str:
    """Ascending characters as ranges for a set of the ``regex`` module."""
    codes = [ord(c) for c in chars]
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i == len(codes) - 1 or codes[i + 1] != c + 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def _pattern(letter: str, digit: str, space: str) -> str:
    """How the byte-level vocabularies cut a text into words."""
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One coder per worker process."""
    return Coder(path)


def _rows(c: Coder, texts: Iterable[str | None], wanted: tuple[str, ...]) -> Iterator[list]:
    """The wanted outputs of each text; the distinct words of some texts are encoded together."""
    waiting: list[list[str]] = []
    size = 0
    for text in texts:
        waiting.append(c.words_in(text or ""))
        size += len(text or "")
        if size >= GROUP:
            c.learn(set().union(*waiting))
            yield from (_row(c, words, wanted) for words in waiting)
            waiting, size = [], 0
    c.learn(set().union(*waiting))
    yield from (_row(c, words, wanted) for words in waiting)


def _row(c: Coder, words: list[str], wanted: tuple[str, ...]) -> list:
    joined = ",".join(map(c.digits.__getitem__, words))
    decoded = b""
    if "decoded" in wanted or "decoded_sha256" in wanted:
        decoded = b"".join(map(c.decoded.__getitem__, words)).decode("utf-8", "replace").encode()
    made = {
        "ids": lambda: [int(x) for x in joined.split(",")] if joined else [],
        "decoded": lambda: decoded.decode(),
        "n_tokens": lambda: joined.count(",") + bool(joined),
        "ids_sha256": lambda: hashlib.sha256(joined.encode()).hexdigest(),
        "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest(),
    }
    return [made[w]() for w in wanted]


def encode_decode(
    docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded"), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id`` and the chosen outputs (names in ``OUTPUTS``) per row, in one pass without a shuffle.

    ``path`` is a tokenizer file that every executor can read. A null text is
    encoded as empty. Repeated rows and repeated or null keys give a row each;
    only key and text are read, so other columns cannot clash.
    """
    outputs = tuple(outputs)
    kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            rows = list(_rows(c, (t.as_py() for t in batch.column(1)), outputs))
            made = [pa.array([r[j] for r in rows], kinds.get(o, pa.string())) for j, o in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *outputs])
        c.forget()  # the worker may serve another stage next

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs))
