"""The factorization machine: its score, pairs that no linear weights separate, and texts it has not seen."""

import random
import zlib

import numpy as np
import pytest

from strikelab.llm import toxicity


def test_logit_like_a_double_loop():
    rnd = np.random.default_rng(1)
    model = toxicity.Model(list(range(30)))
    model.bias, model.linear, model.vectors = 0.3, rnd.normal(size=30), rnd.normal(size=(30, 8))
    cols = [sorted(rnd.choice(30, size=n, replace=False).tolist()) for n in (0, 1, 2, 9, 0, 30)]
    want = [model.bias + sum(model.linear[i] for i in c) + sum(model.vectors[i] @ model.vectors[j] for i in c for j in c if i < j) for c in cols]
    assert model.logit(cols) == pytest.approx(want)


def test_a_pair_that_linear_weights_miss():
    """Toxic: an insult and a group together, or neither; each word alone says nothing, so linear weights stay at chance."""
    x = np.array([[1, 1], [0, 0], [1, 0], [0, 1]] * 100, np.float32)
    y = np.array([1, 1, 0, 0] * 100, float)
    model = toxicity.Model([0, 1]).fit(x, y, epochs=300, rate=0.05)
    cols = [[0, 1], [], [0], [1]]
    assert (model.logit(cols) > 0).tolist() == [True, True, False, False]
    a = np.c_[np.ones(len(x)), x]
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    assert abs(a @ w - 0.5).max() < 1e-6


def test_held_out_pairs(spark):
    """Documents are toxic only where an insult meets a group."""
    rnd = random.Random(3)
    filler = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(1600):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        w = rnd.sample(filler, 12) + ["grumblefool"] * insult + ["zorgians"] * group
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult and group)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks, 0.5).collect()}
    held = [i for i in range(1600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) / len(held) > 0.97


def test_repeated_documents_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(1, "bad words")] * 500 + [(i, f"fine text {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0)] + [(i, 0) for i in range(2, 60)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 558
