"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (one to three
characters of the lower-cased text, everything but letters read as a space),
scaled to length one. The document frequencies are counted over every row that
may be learned from. The regression is fitted on the driver, with the
follow-the-regularised-leader method and an elastic net, on a bounded sample of
labelled rows reduced to features in the tasks; a part of the sample is kept
back to calibrate the temperature of the softmax. Scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import held_out

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
GRAMS = (1, 2, 3)
#: Labelled rows to fit on, over all languages together; the only bound of the sample.
SAMPLE = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2e-3, 1e-4
#: Every so many sampled rows one is kept for the temperature.
CALIBRATE = 5
PIECE = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket is hit; None for a text without letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.concatenate(([32], np.where(is_letter, codes, 32), [32])).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(codes), PIECE):  # a long text piece by piece; the last n - 1 characters are read again
        part = codes[at:at + PIECE + max(GRAMS) - 1]
        mixed = np.zeros(len(part), np.uint32)
        for n in GRAMS:
            k = len(part) - n + 1
            if k <= 0:
                break
            mixed = (mixed[:k] if n > 1 else mixed[:k] + np.uint32(2166136261)) * np.uint32(16777619) ^ part[n - 1:]
            keep = min(k, PIECE)
            hashed = (mixed[:keep] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
            counts += np.bincount(hashed, minlength=BUCKETS)
    return counts


@dataclass
class Languages:
    """A fitted model: ``weights`` (languages x buckets) already hold the inverse document frequencies."""

    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text)
        if counts is None or not self.names:
            return UNKNOWN, 0.0
        at = np.flatnonzero(counts)
        return self._best(*self._features(at, counts[at]))

    def _features(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = n * self.idf[at]
        length = np.sqrt(x @ x)
        return at, x / (length if length > 0 else 1.0)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x + self.bias

    def _best(self, at: np.ndarray, x: np.ndarray) -> tuple[str, float]:
        z = self.logits(at, x) / self.temperature
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.names[best], float(p[best] / p.sum())


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, seed: int = 0) -> Languages:
    """Fit on ``(buckets, counts)`` per text; equal input gives an equal model."""
    names = sorted(set(labels))
    c = len(names)
    model = Languages(names, idf, np.zeros((c, BUCKETS)), np.zeros(c))
    if c < 2:
        return model
    data = [model._features(np.asarray(at), np.asarray(n, float)) for at, n in bags]
    target = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    kept, learned = order[::CALIBRATE], np.delete(order, np.s_[::CALIBRATE])
    if len(learned) == 0 or len(data) < 2 * CALIBRATE:
        kept, learned = order, order
    # Column BUCKETS is the bias: always on, not penalised.
    z, n = np.zeros((c, BUCKETS + 1)), np.zeros((c, BUCKETS + 1))

    def weights(at: np.ndarray) -> np.ndarray:
        part = z[:, at]
        l1, l2 = np.where(at == BUCKETS, 0.0, L1), np.where(at == BUCKETS, 0.0, L2)
        shrunk = np.sign(part) * np.maximum(np.abs(part) - l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[:, at])) / ALPHA + l2)

    for _ in range(EPOCHS):
        for i in rng.permutation(learned):
            at, x = np.append(data[i][0], BUCKETS), np.append(data[i][1], 1.0)
            w = weights(at)
            logit = w @ x
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[target[i]] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    everything = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = everything[:, :BUCKETS], everything[:, BUCKETS]
    logits = np.array([model.logits(*data[i]) for i in kept])

    def loss(temperature: float) -> float:
        q = logits / temperature
        q = q - q.max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(kept)), target[kept]]).mean())

    model.temperature = float(min(np.geomspace(0.02, 20, 121), key=loss))
    return model


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        counts = gram_counts(t.as_py())
        at = np.flatnonzero(counts) if counts is not None else np.zeros(0, np.int64)
        out.append((at, counts[at] if counts is not None else at))
    return out


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts have letters: sums per task, then one small aggregate."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                counts = gram_counts(t.as_py())
                if counts is not None:
                    seen += counts > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["bucket", "n"])

    sums = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    df, total = np.zeros(BUCKETS), 0
    for bucket, n in zip(found.column("bucket").to_pylist(), found.column("n").to_pylist(), strict=True):
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    return df, total


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Languages:
    """Fit on the rows that are not held out and have a language and text.

    Every language gets an equal part of the sample (all of its rows, if fewer),
    chosen by a hash of key and text. The number of languages is small by nature.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    d = d.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    df, total = document_frequencies(d)
    idf = np.log((1 + total) / (1 + df)) + 1
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Languages([], idf, np.zeros((0, BUCKETS)), np.zeros(0))
    share = max(1.0, sample / len(counts))
    rates = d.sparkSession.createDataFrame([(k, min(1.0, share / n)) for k, n in counts.items()], "lang string, rate double")
    part = (F.xxhash64("doc_id", "text") / F.lit(float(1 << 63)) + 1) / 2
    picked = d.join(F.broadcast(rates), "lang").where(part < F.col("rate")).select("text", "lang").limit(2 * sample)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _bags(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int64())), batch.column(1)],
                ["at", "n", "lang"],
            )

    found = picked.mapInArrow(bags, "at array<int>, n array<long>, lang string").toArrow()
    rows = [(a.values.to_numpy(), b.values.to_numpy(), c.as_py()) for a, b, c in zip(*(found.column(x) for x in ("at", "n", "lang")), strict=True)]
    rows = sorted((r for r in rows if len(r[0])), key=lambda r: (r[2], len(r[0]), int(r[1].sum()), r[0].tolist(), r[1].tolist()))
    return fit([(a, b) for a, b, _ in rows], [c for _, _, c in rows], idf)


def predict(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row; ``und`` with score 0 for a text that is null or has no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row. Repeated rows give a row each; other columns are not read.

    With no labelled row at all every text is ``und``; with one language only,
    every text with a letter is of that language.
    """
    d = predict(docs, train(docs, key, text, lang, sample), key, text)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
