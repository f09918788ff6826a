"""Language identification: a blended-spectrum string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression.

A text's grams are its distinct runs of 1 to 4 characters, hashed. The kernel of two texts is the number of grams that both
have, over the root of the product of their numbers. Each language's function is a weighted sum of kernels with landmark
texts; as the kernel is linear in a text's grams, all functions of a batch are one matrix product of its grams' presence
with (grams of landmarks, languages).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, with_field

#: Lengths of the grams, and buckets that these are hashed to.
SPECTRUM, BUCKETS = (1, 2, 3, 4), 1 << 20
#: The bound of the fit: languages (the most frequent), labelled rows of each, landmarks of each, characters of a landmark at most.
LANGUAGES, FIT_ROWS, LANDMARKS, LANDMARK_CHARS = 64, 400, 40, 20_000
RIDGE = 1e-3
#: Grams of a batch that are held at once as a matrix of presence, in cells.
CELLS = 1 << 23


def _folded() -> np.ndarray:
    """For each code point of the basic plane its small letter, or a space where it is no letter."""
    fold = np.full(1 << 16, 32, np.uint32)
    for k in range(1 << 16):
        c = chr(k)
        if c.isalpha():
            small = c.lower()
            fold[k] = ord(small) if len(small) == 1 and ord(small) < 1 << 16 else k
    return fold


_FOLD = _folded()
#: Where a bucket was met last in the text at hand: tells distinct grams without clearing anything between texts.
_SLOT = np.zeros(BUCKETS, np.int32)


def letters(text: str | None) -> np.ndarray:
    """Small letters of all scripts, all else as single spaces, one at either end; empty without a letter."""
    x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    far = x >= 1 << 16
    folded = _FOLD[np.where(far, 0, x)]
    if far.any():
        for k in np.unique(x[far]).tolist():
            folded[x == k] = k if chr(k).isalpha() else 32
    full = folded != 32
    if not full.any():
        return np.zeros(0, np.uint32)
    keep = full.copy()
    keep[1:] |= full[:-1]
    x = folded[keep]
    return np.concatenate([[32] * int(x[0] != 32), x, [32] * int(x[-1] != 32)]).astype(np.uint32)


def grams(x: np.ndarray) -> np.ndarray:
    """Buckets of the distinct grams of letters(text)."""
    seen, h = [], np.zeros(len(x), np.uint32)
    for n in range(1, max(SPECTRUM) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :]
        if n in SPECTRUM:
            seen.append((h + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(12))
    at = np.concatenate(seen)
    order = np.arange(len(at), dtype=np.int32)
    _SLOT[at] = order
    return at[_SLOT[at] == order]


@dataclass
class Model:
    """languages, the landmarks' grams (a place for each bucket, or -1) and weights (grams, languages)."""

    languages: list[str]
    place: np.ndarray
    weights: np.ndarray

    def outputs(self, texts: list[np.ndarray]) -> np.ndarray:
        """The functions of all languages for texts as letters(), by products of the batch's presence with the weights."""
        out, width = np.zeros((len(texts), len(self.languages))), len(self.weights)
        step = max(1, CELLS // max(1, width))
        for i in range(0, len(texts), step):
            part = texts[i : i + step]
            presence, size = np.zeros((len(part), width), np.float32), np.ones(len(part))
            for j, t in enumerate(part):
                g = grams(t)
                size[j] = len(g)
                at = self.place[g]
                presence[j, at[at >= 0]] = 1
            out[i : i + step] = (presence @ self.weights) / np.sqrt(size)[:, None]
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is 1 modulo 3; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def kernels(landmarks: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """(texts, landmarks): shared grams over the root of both numbers; texts as letters()."""
    marks = np.zeros((len(landmarks), BUCKETS), bool)
    for i, g in enumerate(landmarks):
        marks[i, g] = True
    size = np.sqrt(np.array([len(g) for g in landmarks], float))
    found = (grams(t) for t in texts)
    return np.stack([marks[:, g].sum(1) / (size * np.sqrt(len(g))) for g in found]) if texts else np.zeros((0, len(landmarks)))


def ridge(shared: np.ndarray, among: np.ndarray, y: np.ndarray, decay: float = RIDGE) -> np.ndarray:
    """Nystroem's approximation: weights of landmarks, a column a class, with the least squares of y and decay times the norm."""
    n = len(shared)
    a = shared.T @ shared + decay * n * among + 1e-8 * n * np.eye(len(among))
    return np.linalg.solve(a, shared.T @ y)


def sampled(docs: DataFrame, rows: int, languages: int) -> DataFrame:
    """lang, doc_id, text: `rows` labelled texts of each of the most frequent languages at most, picked by a hash of doc_id.

    A language's rows are thinned by its count first, so that only a bounded number is ranked.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    base = base.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).where(F.col("text").rlike(r"\p{L}"))
    counts = base.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    thin = base.join(counts, "lang").withColumn("u", hashed).where(F.col("u") * F.col("n") < 4 * rows)
    one = thin.groupBy("lang", "doc_id", "u").agg(F.min("text").alias("text"))
    ranked = one.withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY u, doc_id)"))
    return ranked.where(F.col("k") <= rows).select("lang", "doc_id", "text", "k")


def fit(docs: DataFrame, rows: int = FIT_ROWS, landmarks: int = LANDMARKS, languages: int = LANGUAGES, chars: int = LANDMARK_CHARS) -> Model | None:
    """A model from labelled rows that are not held out; None without any.

    Landmarks are the first of each language's sampled rows that have `chars` characters at most; the kernels of the sampled
    rows with them are worked out in Spark, and only these numbers come to the driver. Null langs and texts and texts
    without a letter are left out; of several rows with one lang and id the least text is taken.
    """
    sample = sampled(docs, rows, languages)
    few = sample.where(F.length("text") <= chars).withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY k)")).where(F.col("k") <= landmarks)
    found = sorted((r["lang"], r["k"], r["text"]) for r in few.select("lang", "k", "text").collect())
    if not found:
        return None
    texts = [letters(t) for _, _, t in found]
    marks = [grams(t) for t in texts]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            k = kernels(marks, [letters(t) for t in b["text"].to_pylist()])
            yield pa.record_batch([b["lang"], b["doc_id"], pa.array(list(k), pa.list_(pa.float64()))], ["lang", "doc_id", "k"])

    got = sorted((r["lang"], r["doc_id"], r["k"]) for r in sample.mapInArrow(shared, "lang string, doc_id long, k array<double>").collect())
    names = sorted({r[0] for r in got})
    y = np.array([[1.0 if r[0] == n else -1.0 for n in names] for r in got])
    # Classes weigh the same, whatever their numbers.
    share = np.sqrt(1 / np.array([sum(r[0] == g[0] for r in got) for g in got], float))[:, None]
    share *= np.sqrt(len(got)) / np.sqrt((share**2).sum())
    among = kernels(marks, texts)
    alpha = ridge(np.array([r[2] for r in got]) * share, among, y * share)
    used = np.unique(np.concatenate(marks))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    weights = np.zeros((len(used), len(names)), np.float32)
    for g, a in zip(marks, alpha, strict=True):
        weights[place[g]] += (a / np.sqrt(len(g))).astype(np.float32)
    return Model(names, place, weights)


def predict(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs' columns with the language and a score from 0 to 1, a logistic share of the language's function among all.

    Null texts and texts without a letter are `und` with score 0, as are all without a model; ties go to the first language
    in order. Each row is judged alone, whatever its length.
    """
    base = docs.drop(lang, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [letters(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            some = [i for i, t in enumerate(texts) if model is not None and len(t)]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            if some:
                z = model.outputs([texts[i] for i in some])
                e = np.exp(4 * (z - z.max(1, keepdims=True)))
                best = z.argmax(1)
                scores[some] = e[np.arange(len(some)), best] / e.sum(1)
                for i, k in zip(some, best.tolist(), strict=True):
                    names[i] = model.languages[k]
            yield pa.record_batch([*b.columns, pa.array(names, pa.string()), pa.array(scores)], [*b.schema.names, lang, score])

    return base.mapInArrow(run, with_field(base, lang, "string").add(score, "double"))


def languages_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs; only text is an input of a prediction."""
    told = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs))
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
