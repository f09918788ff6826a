"""Toxicity: a factorization machine over hashed terms, fitted here on labelled rows and run over every whole text.

Terms are words and word beginnings, hashed. The terms that tell the classes apart best get a linear weight and a vector;
the score adds to the linear part the products of the vectors of all pairs of terms that meet in a text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, slices, with_field

#: Labelled rows that are fitted at most, picked by a hash of doc_id: the bound of the sample.
FIT_ROWS = 20_000
BUCKETS = 1 << 20
TERMS = 1024
FACTORS = 8
#: Lengths of the word beginnings that are terms beside the word.
STARTS = (3, 4, 5, 6)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def buckets_of(word: str) -> tuple[int, ...]:
    """Hashed terms of one lower-case word: the word without marks at its ends, and its beginnings."""
    w = _EDGES.sub("", word)
    terms = [f"={w}", *(f"^{w[:k]}" for k in STARTS if len(w) > k)] if w else []
    return tuple({zlib.crc32(t.encode()) % BUCKETS for t in terms})


class Model:
    """Terms (bucket to column), linear weights and vectors; small: TERMS rows."""

    def __init__(self, buckets: list[int]):
        self.column = {b: i for i, b in enumerate(buckets)}
        self.bias, self.linear = 0.0, np.zeros(len(buckets))
        self.vectors = np.zeros((len(buckets), FACTORS))

    def logit(self, cols: list[list[int]]) -> np.ndarray:
        """cols: for each text the columns of its terms. Sums run over the terms met, so short texts take little memory."""
        size = np.fromiter(map(len, cols), np.int64, len(cols))
        out = np.full(len(cols), self.bias)
        some = np.flatnonzero(size)
        if len(some):
            flat, starts = np.fromiter(chain.from_iterable(cols), np.int64, size.sum()), (np.cumsum(size) - size)[some]
            v = self.vectors[flat]
            pairs = np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)
            out[some] += np.add.reduceat(self.linear[flat], starts) + 0.5 * pairs.sum(1)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 20, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> Model:
        """Logistic loss by Adam over small batches."""
        rnd = np.random.default_rng(seed)
        self.vectors = rnd.normal(0, 0.02, self.vectors.shape)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        weights = [np.array([self.bias]), self.linear, self.vectors]
        mean, square, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rnd.permutation(len(y))
            for i in range(0, len(y), 256):
                a, b = x[order[i : i + 256]].astype(np.float64), y[order[i : i + 256]]
                v = a @ weights[2]
                z = weights[0] + a @ weights[1] + 0.5 * (v * v - a @ weights[2] ** 2).sum(1)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - b) / len(b)
                grads = [g.sum(keepdims=True), a.T @ g + decay * weights[1], a.T @ (g[:, None] * v) - weights[2] * (a.T @ g)[:, None] + decay * weights[2]]
                t += 1
                for k, d in enumerate(grads):
                    mean[k] = 0.9 * mean[k] + 0.1 * d
                    square[k] = 0.999 * square[k] + 0.001 * d * d
                    weights[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        self.bias, self.linear, self.vectors = float(weights[0][0]), weights[1], weights[2]
        return self


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text is 2 modulo 4; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """A model from labelled rows that are not held out, `rows` of them at most; None without both classes.

    Terms are counted over these rows in Spark, by class; the TERMS with the largest gain of information are kept. Only
    those terms of these rows come to the driver. Null labels and texts are left out; of several documents with one id the
    least text is taken, of several labels the highest.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows_of = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Memo(buckets_of, 50_000), np.zeros((2, BUCKETS), np.int32)
        for b in slices(batches):
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
                total[y, list({k for w in set(text.lower().split()) for k in known[w]})] += 1
        used = np.flatnonzero(total.any(0))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "clean", "toxic"])

    counts = rows_of.mapInArrow(count, "bucket int, clean int, toxic int").groupBy("bucket").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    n = rows_of.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in n}
    if len(n) < 2:
        return None
    # Twice the log-likelihood ratio of the term's two rates against one rate.
    total = n[0] + n[1]
    part = lambda k, of, rate: F.when(k > 0, k * F.log(k / (of * rate))).otherwise(0.0)
    c, t = F.col("c"), F.col("t")
    both = (c + t) / total
    gain = part(c, n[0], both) + part(t, n[1], both) + part(n[0] - c, n[0], 1 - both + 1e-12) + part(n[1] - t, n[1], 1 - both + 1e-12)
    best = counts.where("c + t >= 3").select("bucket", F.round(gain, 6).alias("gain")).orderBy(F.desc("gain"), "bucket").limit(TERMS).collect()
    model = Model([r["bucket"] for r in best])
    if not best:
        return None
    column = model.column

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda w: tuple(column[k] for k in buckets_of(w) if k in column), 100_000)
        for b in slices(batches):
            cols = [sorted({k for w in set(t.lower().split()) for k in known[w]}) for t in b["text"].to_pylist()]
            yield pa.record_batch([b["doc_id"], b["y"], pa.array(cols, pa.list_(pa.int32()))], ["doc_id", "y", "cols"])

    sample = sorted(rows_of.mapInArrow(pick, "doc_id long, y int, cols array<int>").collect())
    x = np.zeros((len(sample), len(column)), np.float32)
    for i, r in enumerate(sample):
        x[i, r["cols"]] = 1
    return model.fit(x, np.array([r["y"] for r in sample], float))


def _scores(model: Model | None, texts: list[str | None], known: Memo) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    cols = [sorted({k for w in set((t or "").lower().split()) for k in known[w]}) for t in texts]
    return 1 / (1 + np.exp(-np.clip(model.logit(cols), -30, 30)))


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs' columns with the score, 0 to 1 (higher: toxic is likelier). Null and empty texts get the score of no terms; no model: 0."""
    base = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda w: tuple(model.column[k] for k in buckets_of(w) if k in model.column), 100_000)
        for b in slices(batches, most=2 << 20):
            s = _scores(model, b.column(b.schema.get_field_index("text")).to_pylist(), known)
            yield pa.record_batch([*b.columns, pa.array(s)], [*b.schema.names, name])

    return base.mapInArrow(run, with_field(base, name, "double"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) for each row of docs.

    Rows are scored one by one, so null ids, ties and repeated rows are as any row. Only text is an input of a score.
    """
    scored = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, that score under the threshold.

    Null and empty texts score as no terms do, ties and repeated rows as any row; without labels of both classes all stay.
    """
    name = "_toxic"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels), name).where(F.col(name) < threshold).drop(name)
