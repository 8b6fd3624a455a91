"""Spelling variants by a trie of letter counts.

A word is a vector of counts, one per letter group; one edit adds one to a group,
takes one from a group, or both. The vectors of all words form a trie, a level per
group. A search walks it depth first with a budget of one surplus and one deficit;
the words of the leaves that it reaches are verified letter by letter. To meet every
pair once, a surplus is spent on an earlier level than a deficit, and a deficit only
after a surplus: the search goes to the word that is longer or, among words of one
length, to the one that has more of the first group in which they differ.

Spark deals the trie out by its first levels: each word goes to its own subtree, and
its search to the subtrees that the budget reaches. A subtree with many words, or
with many searches, is cut into cells of bounded size that meet in a grid, so no
task holds more than one cell. Searches run for many words at a time in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import saved
from webframe.plans.lineage import release

MIN_LENGTH = 5
MIN_COUNT = 3
#: A word of which this divides the checksum loses a letter.
DROP = 97
#: A form is at least this many times as frequent.
RATIO = 2
RUN = re.compile("[a-zÀ-ÿ]+")
#: Levels of the trie: letters, the most frequent of most languages first, then the others by code point.
ORDER = "eainrtoslducmphgbfvkwyxzjq"
OTHERS = 6
GROUPS = len(ORDER) + OTHERS
#: Levels by which subtrees are dealt out.
TOP = 5
#: Words, and searches, of one cell at most (on average, as they are dealt by a hash).
CELL = 20_000
#: Largest count that is told apart.
MOST = 15
#: Letters up to which words are verified side by side in arrays.
WIDE = 24
#: Searches that are verified at a time, pairs that are compared at a time, words that a task counts before it hands them on.
PART, PAIRS, MAX_WORDS = 4_000, 50_000, 100_000


def words_of(doc_id: str, text: str) -> Counter:
    """Words of a text with their counts, after the loss of letters."""
    start = crc32(f"{doc_id}:".encode("utf-8", "surrogatepass"))
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        h = crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def _counted(d: DataFrame) -> DataFrame:
    """``word, n`` per task of ``d(id, text)``, words of enough letters only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if len(w) >= MIN_LENGTH]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                held.update(words_of(doc_id.as_py(), text.as_py()))
                if len(held) >= MAX_WORDS:
                    yield flush()
        yield flush()

    return d.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of at least five letters that occur at least three times."""
    d = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _counted(d).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def vectors(words: list[str]) -> np.ndarray:
    """Letter-group counts, one row per word."""
    table = np.zeros(256, np.int64)
    for c in range(256):
        at = ORDER.find(chr(c))
        table[c] = at if at >= 0 else len(ORDER) + c % OTHERS
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(row * GROUPS + table[codes], minlength=len(words) * GROUPS)
    return np.minimum(flat.reshape(len(words), GROUPS), MOST).astype(np.int8)


def _searches(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Subtrees that the budget reaches over the first levels: rows, subtree codes, budget spent (0 none, 1 surplus, 2 both)."""
    radix = (MOST + 2) ** np.arange(TOP, dtype=np.int64)[::-1]
    top = counts[:, :TOP].astype(np.int64)
    own, every = top @ radix, np.arange(len(top))
    yield every, own, 0
    for i in range(TOP):
        # a count that is as large as can be told apart also stands for the next larger one
        up = every[top[:, i] < MOST]
        yield up, own[up] + radix[i], 1
        for j in range(i + 1, TOP):
            both = up[top[up, j] > 0]
            yield both, own[both] + radix[i] - radix[j], 2


def _dealt(words: DataFrame) -> DataFrame:
    """``subtree, spent, word, n``: every word in its own subtree (``spent`` -1) and its search in all it must visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = vectors(batch.column(0).to_pylist())
            for k, (rows, subtrees, spent) in enumerate(_searches(counts)):
                for kind in ([-1, spent] if k == 0 else [spent]):
                    at = pa.array(rows)
                    made = [pa.array(subtrees), pa.array(np.full(len(rows), kind, np.int32)), batch.column(0).take(at), batch.column(1).take(at)]
                    yield pa.RecordBatch.from_arrays(made, ["subtree", "spent", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "subtree long, spent int, word string, n long")


class Trie:
    """Levels of count vectors: ``keys[l]`` holds ``parent * (MOST + 1) + count`` of the nodes below level l, in order."""

    def __init__(self, counts: np.ndarray):
        node = np.zeros(len(counts), np.int64)
        self.keys = []
        for level in range(counts.shape[1]):
            found, node = np.unique(node * (MOST + 1) + counts[:, level], return_inverse=True)
            node = node.astype(np.int64)
            self.keys.append(found)
        self.order = np.argsort(node, kind="stable")
        self.begin = np.searchsorted(node[self.order], np.arange(len(self.keys[-1]) + 1) if self.keys else [0, 1])

    def search(self, counts: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Depth first, all searches at once: those that reach a leaf, the leaf, what they have spent."""
        stack = [(0, at, np.zeros(len(at), np.int64), s) for s in (0, 1, 2) if len(at := np.flatnonzero(spent == s))]
        while stack:
            level, at, node, s = stack.pop()
            if level == len(self.keys):
                yield at, node, s
                continue
            own = counts[at, level]
            # spend nothing; a surplus; a deficit
            for step, before, after in ((0, s, s), (1, 0, 1), (-1, 1, 2)):
                if s != before:
                    continue
                wanted = own + step
                key = node * (MOST + 1) + wanted
                place = np.minimum(np.searchsorted(self.keys[level], key), len(self.keys[level]) - 1)
                alive = (self.keys[level][place] == key) & (wanted >= 0) & (wanted <= MOST)
                if alive.any():
                    stack.append((level + 1, at[alive], place[alive], after))

    def words_at(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each leaf its number of words; all of them in one list."""
        n = self.begin[leaf + 1] - self.begin[leaf]
        ends = np.cumsum(n)
        return n, self.order[np.repeat(self.begin[leaf] - (ends - n), n) + np.arange(int(n.sum()))]


def one_edit(a: str, b: str) -> bool:
    """True if one letter is put in, taken out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


class Spelled:
    """Words as rows of letters, for verification side by side."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        short = "".join(w[:WIDE].ljust(WIDE, "\0") for w in words).encode("latin-1")
        self.letters = np.frombuffer(short, np.uint8).reshape(len(words), WIDE)


def verified(x: Spelled, i: np.ndarray, y: Spelled, j: np.ndarray) -> np.ndarray:
    """Which pairs of words are one edit apart."""
    out = np.zeros(len(i), bool)
    a, b = x.length[i], y.length[j]
    long = (a > WIDE) | (b > WIDE)
    for k in np.flatnonzero(long & (abs(a - b) <= 1)):
        out[k] = one_edit(x.words[i[k]], y.words[j[k]])
    for k in np.array_split(np.flatnonzero(~long & (abs(a - b) <= 1)), max(1, len(i) // PAIRS)):
        p, q = x.letters[i[k]], y.letters[j[k]]
        differs = p != q
        where = differs.argmax(axis=1)
        equal = a[k] == b[k]
        one = differs.sum(axis=1) == 1
        # with a letter more: what follows the first difference, shifted by one, is equal
        shorter, longer = np.where((a[k] < b[k])[:, None], p, q), np.where((a[k] < b[k])[:, None], q, p)
        shifted = np.concatenate([longer[:, 1:], np.zeros((len(k), 1), np.uint8)], axis=1)
        before = np.arange(WIDE)[None, :] < where[:, None]
        out[k] = np.where(equal, one, (before | (shorter == shifted)).all(axis=1))
    return out


def _cell(words: list[str], n: np.ndarray, searched: list[str], searched_n: np.ndarray, spent: np.ndarray) -> pa.Table:
    """``word, near, near_n`` in both directions for the pairs of one cell."""
    x, y = Spelled(searched), Spelled(words)
    trie, rest = Trie(vectors(words)[:, TOP:]), vectors(searched)[:, TOP:]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at, leaf, s in trie.search(rest, spent):
        for part in np.array_split(np.arange(len(at)), max(1, len(at) // PART)):
            count, j = trie.words_at(leaf[part])
            i = np.repeat(at[part], count)
            ok = verified(x, i, y, j)
            if s == 0:  # equal vectors: both words search for each other
                ok[ok] = [searched[p] < words[q] for p, q in zip(i[ok], j[ok], strict=True)]
            if ok.any():
                found.append((i[ok], j[ok]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    a, b = pa.array(searched, pa.string()).take(pa.array(i)), pa.array(words, pa.string()).take(pa.array(j))
    numbers = pa.array(np.concatenate([n[j], searched_n[i]]).astype(np.int64))
    return pa.table({"word": pa.concat_arrays([a, b]), "near": pa.concat_arrays([b, a]), "near_n": numbers})


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """``word, near, near_n``: all pairs of ``words(word, n)`` that are one edit apart, in both directions."""
    dealt = saved(_dealt(words))
    stored = F.col("spent") < 0
    sizes = dealt.groupBy("subtree").agg(F.count_if(stored).alias("w"), F.count_if(~stored).alias("s")).where((F.col("w") > 0) & (F.col("s") > 0))
    cuts = lambda c: F.ceil(F.col(c) / cell).cast("int")
    d = dealt.join(saved(sizes.select("subtree", cuts("w").alias("rows"), cuts("s").alias("cols"))), "subtree")
    mine = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    along = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    grid = d.where(stored).select("subtree", mine("rows").alias("i"), along("cols").alias("j"), "spent", "word", "n").union(
        d.where(~stored).select("subtree", along("rows").alias("i"), mine("cols").alias("j"), "spent", "word", "n"))

    def search(cell: pa.Table) -> pa.Table:
        spent, n = cell.column("spent").to_numpy(), cell.column("n").to_numpy()
        own = spent < 0
        mine, others = (cell.column("word").filter(pa.array(x)).to_pylist() for x in (own, ~own))
        return _cell(mine, n[own], others, n[~own], spent[~own])

    out = saved(grid.groupBy("subtree", "i", "j").applyInArrow(search, "word string, near string, near_n long"))
    release(dealt)
    return out


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary.

    Words are runs of ``[A-Za-z]`` and U+00C0 to U+00FF, A-Z lower-cased; where 97
    divides the CRC-32 of ``<key>:<run>`` the run loses one letter. The form of a word
    is its near word (one edit) of largest count, ties to the smaller in code-point
    order, if that is at least twice as frequent; the root follows forms to the last.
    A null key is written as nothing, a null or empty text has no words, repeated rows
    count as often as they occur. Only key and text are read, so other columns cannot
    clash. No words give an empty table.
    """
    words = saved(vocabulary(docs, key, text))
    near = near_words(words, cell)
    best = near.groupBy(F.col("word").alias("_w")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    d = words.join(best, F.col("word") == F.col("_w"), "left")
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    d = saved(d.select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    ))
    release(near, words)
    roots = _roots(d)
    return d.join(roots.select(F.col("word").alias("_w"), "root"), F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(d: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: each round doubles the steps taken; counts double along a step, so rounds are few."""
    links = saved(d.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        stepped = saved(links.join(further, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if not stepped.where("moved").limit(1).count():
            return links
        links = stepped.select("word", "root")
