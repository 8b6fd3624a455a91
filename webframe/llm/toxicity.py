"""Toxicity scores: subword-bag embeddings, averaged into a linear softmax.

A word is the bag of its character n-grams (with word borders) and of itself,
hashed to buckets; its vector is the mean of their embeddings, a text's vector
the mean over its words, and a two-class linear softmax reads that. Embeddings
and softmax are trained together, in numpy on the driver, on a bounded sample of
labelled rows; misspellings share most n-grams with the word they come from.

Scoring is one pass without a shuffle. As everything up to the softmax is
linear, each word adds one number, remembered per worker. Repeats of a word are
damped and a number of neutral words is added to every mean, so that neither a
phrase repeated a hundred times nor a text of five words is judged by chance.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import held_out

BUCKETS = 1 << 17
DIMENSION = 8
GRAMS = (3, 4, 5)
#: A word that occurs n times in a text weighs n to this power, so that a repeated phrase is not all that counts.
DAMPING = 0.5
#: So many words that say nothing are added to every text: a few words alone are weak evidence.
NEUTRAL = 30.0
EPOCHS = 10
#: Small samples get more epochs, up to so many steps.
MIN_STEPS = 500
BATCH = 64
RATE = 3.0
DECAY = 1e-3
#: Start of the sums of squared gradients: buckets whose gradients stay far below it hardly move.
INERTIA = 0.03
GAIN = 32.0
#: Labelled rows to learn from, of each label at most; the sample's only bound.
SAMPLE = 2000
MAX_WORDS = 400_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word with its borders and of all its n-grams."""
    marked = f"<{word}>"
    parts = [marked, *(marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
    return [crc32(p.encode("utf-8", "surrogatepass")) % buckets for p in parts]


def word_weights(words: list[str]) -> tuple[dict[str, float], float]:
    """Damped weight of each distinct word, and the total they are divided by."""
    weights = {w: n**DAMPING for w, n in Counter(words).items()}
    return weights, sum(weights.values()) + NEUTRAL


def bag(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the weight of each in the text's mean."""
    weights, total = word_weights(words_of(text))
    dense = np.zeros(buckets)
    for word, weight in weights.items():
        found = subwords(word, buckets)
        np.add.at(dense, found, weight / (total * len(found)))
    at = np.flatnonzero(dense)
    return at.astype(np.int32), dense[at].astype(np.float32)


@dataclass
class Toxicity:
    """A trained model, folded to what scoring needs: one number per bucket and one per text."""

    weights: np.ndarray
    bias: float
    _words: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_words": {}}

    def forget(self) -> None:
        """Empty the table of words; the worker may serve another stage next."""
        self._words.clear()

    def word(self, word: str) -> float:
        known = self._words.get(word)
        if known is None:
            found = subwords(word, len(self.weights))
            known = float(self.weights[found].mean())
            if len(word) <= 64:
                if len(self._words) >= MAX_WORDS:
                    self._words.clear()
                self._words[word] = known
        return known

    def score(self, text: str | None) -> float:
        weights, total = word_weights(words_of(text))
        logit = self.bias + sum(weight * self.word(word) for word, weight in weights.items()) / total
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray | None = None, seed: int = 0) -> Toxicity:
    """Train on bags of subwords and 0/1 labels. With labels of one kind only, every score is that kind's share."""
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Toxicity(np.zeros(BUCKETS), 40.0 * (2 * share - 1))
    weights = np.ones(len(labels)) if weights is None else np.asarray(weights, float)
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.01, (BUCKETS, DIMENSION)).astype(np.float32)
    head = rng.normal(0, 0.5, DIMENSION)
    head, bias = np.stack([-head, head], 1), np.array([1.0, -1.0])
    squares = [np.full((BUCKETS, 1), INERTIA), np.ones_like(head), np.ones_like(bias)]
    for _ in range(max(EPOCHS, -(-MIN_STEPS // max(1, len(labels) // BATCH)))):
        order = rng.permutation(len(labels))
        for rows in np.array_split(order, max(1, len(order) // BATCH)):
            at = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            lengths = np.array([len(bags[r][0]) for r in rows])
            filled = lengths > 0
            mean = np.zeros((len(rows), DIMENSION))
            if filled.any():
                begins = (np.cumsum(lengths) - lengths)[filled]
                mean[filled] = GAIN * np.add.reduceat(embedding[at] * share[:, None], begins, axis=0)
            logits = mean @ head + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.stack([1 - labels[rows], labels[rows]], 1)) * (weights[rows] / weights[rows].mean())[:, None]
            back, row = GAIN * (error @ head.T), np.repeat(np.arange(len(rows)), lengths)
            grad = np.stack([np.bincount(at, share * back[row, j], BUCKETS) for j in range(DIMENSION)], 1)
            squares[0] += (grad * grad).mean(1, keepdims=True)
            embedding *= 1 - DECAY
            embedding -= RATE * grad / np.sqrt(squares[0])
            for value, own, k, rate in ((head, mean.T @ error, 1, 0.1), (bias, error.sum(0), 2, 0.3)):
                squares[k] += own * own
                value -= rate * own / np.sqrt(squares[k])
    return Toxicity(GAIN * (embedding @ (head[:, 1] - head[:, 0])), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Toxicity:
    """Fit on at most ``sample`` rows of each label, the first by a hash of the key, none of them held out.

    The ids are picked from the labels alone, so one pass over the documents
    with a list of bounded size finds their texts; these are reduced to bags in
    the tasks. Several labels of one id count as the highest; rows without a
    label are not learned from. Each label weighs as often as it occurs among
    all labelled rows that may be learned from.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    spread = F.xxhash64("_id")
    picked = [known.where(F.col("toxic") == t).orderBy(spread, "_id").limit(sample) for t in (0, 1)]
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = picked[0].union(picked[1])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [bag(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32())), batch.column(1)],
                ["at", "share", "toxic"],
            )

    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("_key") == F.col("_id"))
    found = d.select("text", "toxic").limit(4 * sample).mapInArrow(bags, "at array<int>, share array<float>, toxic int").toArrow()
    y = np.array(found.column("toxic").to_pylist(), float)
    at, share = ([x.values.to_numpy() for x in found.column(c)] for c in ("at", "share"))
    n = {t: max(1, int((y == t).sum())) for t in (0, 1)}
    w = np.array([total.get(int(t), 0) / n[int(t)] for t in y])
    return fit(list(zip(at, share, strict=True)), y, w)


def score(docs: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` per row: 0 to 1, and 1 from 0.5 on. A null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.score(t.as_py()) for t in batch.column(1)]
            made = [pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "score", "predicted"])
        model.forget()

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """The rows of *docs* that the model does not reject, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < 0.5 for t in batch.column(text)], pa.bool_()))
        model.forget()

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row, by a model trained on the rows that are not held out.

    Null and empty texts score by the model's bias alone. Repeated rows and repeated or
    null keys give a row each (a null key counts as held out). Empty tables give none;
    without labels, or with labels of one kind, every score is that kind's share. Only
    key and text are read, so other columns cannot clash.
    """
    model = train(docs, labels, key, text, sample)
    d = score(docs, model, key, text)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
