"""Token counts by compiled finite-state transducers.

Two deterministic machines, both compiled from the tokenizer's file:

* The *splitter* reads character classes and marks where words begin. It has
  seven states, so a chunk of text is a map from entry state to exit state. A
  batch of texts is cut into equal chunks, all chunk maps are computed side by
  side, and a parallel prefix scan composes them, which gives each chunk's entry
  state; then all chunks are marked side by side.
* The *counter* reads the bytes of a word; each of its transitions carries the
  number of tokens it adds to the count (negative where a byte completes a merge
  of what were several tokens). A state is what later tokens can depend on: the
  longest suffix that begins some token, and for each place in it the last token
  of the best encoding up to there and its count relative to now. States are
  made when first reached; the table is emptied when it grows too large, which
  changes no count.

Counts equal those of the tokenizer's own library, without added begin or end.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.merges import Merges, chars_of, codes_of, load_merges, lower_exceptions

CHUNK = 128
PIECE = 1 << 20
MAX_STATES = 150_000
MAX_WORDS = 500_000

# Character classes of the splitter.
CLASSES = ("space", "letter", "digit", "other", "quote", "stmd", "r", "v", "l", "e")
SPACE, LETTER, DIGIT, OTHER, QUOTE, STMD, R, V, L, E = range(len(CLASSES))
# States: free (the next character begins a word), in letters, in others, after a quote, after a quote and r, v or l.
FREE, LETTERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
# What a transition says: a word begins here, a word began one character back, or both.
NOTHING, HERE, BACK, BOTH = range(4)


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """``next[state, class]`` and ``mark[state, class]`` of: 's 't 'm 'd 're 've 'll | letters | digit | run of others."""
    n_states, n_classes = 7, len(CLASSES)
    step, mark = np.zeros((n_states, n_classes), np.uint8), np.zeros((n_states, n_classes), np.uint8)
    letters = {LETTER, STMD, R, V, L, E}
    fresh = {SPACE: (FREE, NOTHING), DIGIT: (FREE, HERE), OTHER: (OTHERS, HERE), QUOTE: (QUOTED, HERE)}
    fresh |= {c: (LETTERS, HERE) for c in letters}
    wanted = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}
    for c in range(n_classes):
        step[FREE, c], mark[FREE, c] = fresh[c]
        step[LETTERS, c], mark[LETTERS, c] = (LETTERS, NOTHING) if c in letters else fresh[c]
        step[OTHERS, c], mark[OTHERS, c] = (OTHERS, NOTHING) if c in (OTHER, QUOTE) else fresh[c]
        if c in (OTHER, QUOTE):
            step[QUOTED, c], mark[QUOTED, c] = OTHERS, NOTHING
        elif c == STMD:
            step[QUOTED, c], mark[QUOTED, c] = FREE, NOTHING
        elif c in (R, V, L):
            step[QUOTED, c], mark[QUOTED, c] = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], NOTHING
        else:
            step[QUOTED, c], mark[QUOTED, c] = fresh[c]
        for state, ends in wanted.items():
            if c == ends:
                step[state, c], mark[state, c] = FREE, NOTHING
            else:  # the letter after the quote began a word of its own
                after, said = (LETTERS, NOTHING) if c in letters else fresh[c]
                step[state, c], mark[state, c] = after, BOTH if said == HERE else BACK
    return step, mark


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for chars, c in ((chars_of(r"\p{L}"), LETTER), (chars_of(r"\p{N}"), DIGIT), (chars_of(r"\s"), SPACE)):
        table[np.fromiter(map(ord, chars), np.int64)] = c
    for chars, c in (("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(x) for x in chars]] = c
    return table


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """State maps of "first, then second", row by row."""
    return np.take_along_axis(second, first.astype(np.intp), axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of state maps under composition, in log2(n) rounds of all rows at once."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = compose(out[:-reach].copy(), out[reach:])
        reach *= 2
    return out


def word_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a word begins, for one text or several with spaces between, entered in state FREE."""
    step, mark = splitter()
    flat_step, flat_mark, width = step.ravel(), mark.ravel(), np.uint8(len(CLASSES))
    n = len(classes)
    lanes = -(-(n + 1) // chunk)
    padded = np.full(lanes * chunk, SPACE, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    # Maps of all chunks side by side. A space sends every state to FREE, so most maps are soon constant: one state
    # says it all from then on, and only the other chunks go on with a full map.
    maps = np.tile(np.arange(len(step), dtype=np.uint8), (lanes, 1))
    head = min(16, chunk)
    for column in columns[:head]:
        maps = flat_step[maps * width + column[:, None]]
    open_lanes = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    wide, one = maps[open_lanes], maps[:, 0].copy()
    for column in columns[head:]:
        one = flat_step[one * width + column]
        if len(open_lanes):
            wide = flat_step[wide * width + column[open_lanes, None]]
    maps = np.repeat(one[:, None], len(step), axis=1)
    maps[open_lanes] = wide
    entry = np.zeros(lanes, np.uint8)
    entry[1:] = prefix_scan(maps)[:-1, FREE]
    marks = np.empty((chunk, lanes), np.uint8)
    for i, column in enumerate(columns):
        at = entry * width + column
        marks[i], entry = flat_mark[at], flat_step[at]
    marks = marks.T.ravel()
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BACK) > 0
    return starts[:n]


class Counter:
    """The counting transducer of a merge table; ``count(word)`` runs it over the bytes of one word."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.merges, self.max_states = merges, max_states
        self.beginnings = {s[:i] for s in merges.ids for i in range(len(s))}
        self.end = 256 if merges.word_end else 0
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.start = self._state("", (-1,), (0,))

    def _state(self, context: str, last: tuple, counts: tuple) -> dict:
        key = (context, last, counts)
        row = self.states.get(key)
        if row is None:
            row = self.states[key] = {None: key}
        return row

    def _compile(self, row: dict, symbol: int):
        context, last, counts = row[None]
        text = context + chr(symbol)
        ids, fits = self.merges.ids, self.merges.fits
        for at in range(len(text)):
            token = ids.get(text[at:])
            if token is not None and (last[at] < 0 or fits(last[at], token)):
                break
        added = counts[at] + 1
        if self.end and symbol >= 256:
            row[symbol] = added
            return added
        keep = text
        while keep not in self.beginnings:
            keep = keep[1:]
        n = len(keep) + 1
        row[symbol] = (self._state(keep, (*last, token)[-n:], tuple(c - added for c in (*counts, added))[-n:]), added)
        return row[symbol]

    def count(self, word: bytes) -> int:
        if len(self.states) > self.max_states:
            self._reset()
            self.merges.trim()
        row, n = self.start, 0
        for b in word[:-1] if self.end else word:
            step = row.get(b)
            row, added = step if step is not None else self._compile(row, b)
            n += added
        if self.end:
            b = word[-1] + 256
            added = row.get(b)
            n += added if added is not None else self._compile(row, b)
        return n


class WordCounts(dict):
    """Counts of the words met so far, emptied when full."""

    def __init__(self, counter: Counter):
        super().__init__({"": 0})
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count(word.encode())
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
                self[""] = 0
            self[word] = n
        return n


class TextCounter:
    """Counts the tokens of whole texts."""

    def __init__(self, path: str):
        merges = load_merges(path)
        self.special, self.classes = merges.special_pattern(), class_table()
        self.words = WordCounts(Counter(merges))
        self.odd = lower_exceptions()
        self.is_odd = np.zeros(0x110000, bool)
        self.is_odd[[ord(c) for c in self.odd]] = True

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if self.odd and self.is_odd[codes_of(text)].any():
            return "".join(self.odd.get(c) or c.replace("Σ", "σ").lower() for c in text)
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> Iterator[str]:
        """A long text in pieces that end before an ASCII space, where a word and a normal form end in any case."""
        at = 0
        while len(text) - at > PIECE:
            cut = text.find(" ", at + PIECE)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Token counts of some texts; their parts are read together, a batch of about ``PIECE`` characters at a time."""
        totals = [0] * len(texts)
        waiting: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.special and "<|" in text:
                parts = self.special.split(text)
                totals[i] += len(parts) // 2
                parts = parts[::2]
            for part in parts:
                for piece in self.pieces(part):
                    waiting.append((i, self.normal(piece)))
                    size += len(piece)
                    if size >= PIECE:
                        self._count(waiting, totals)
                        waiting, size = [], 0
        self._count(waiting, totals)
        return totals

    def _count(self, waiting: list[tuple[int, str]], totals: list[int]) -> None:
        if not waiting:
            return
        codes = codes_of("\n".join(t for _, t in waiting))
        classes = self.classes[codes]
        starts = word_starts(classes)
        ends_of_text = np.cumsum([len(t) + 1 for _, t in waiting])[:-1] - 1
        codes = np.where(classes == SPACE, np.uint32(32), codes)
        codes[ends_of_text] = 10
        starts[1:] &= classes[:-1] != SPACE
        starts[0] = False
        cuts = np.flatnonzero(starts)
        given = np.ones(len(codes) + len(cuts), bool)
        given[cuts + np.arange(len(cuts))] = False
        out = np.full(len(given), 32, np.uint32)
        out[given] = codes
        look = self.words.__getitem__
        for (i, _), line in zip(waiting, out.tobytes().decode("utf-32-le").split("\n"), strict=True):
            totals[i] += sum(map(look, line.split(" ")))


@lru_cache(maxsize=2)
def text_counter(path: str) -> TextCounter:
    return TextCounter(path)


def token_counts(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row, in one pass without a shuffle.

    ``path`` is a tokenizer file that every executor can read. A null text
    counts as empty: no bytes and no tokens. Repeated rows and repeated or null
    keys give a row each. Only key and text are read, so other columns cannot
    clash. The largest thing held is one Arrow batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = text_counter(path)
        for batch in batches:
            n = counter.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    content = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("doc_id"), content.alias("text"), F.octet_length(content).cast("long").alias("n_bytes"))
    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
