"""op13: kernels against sets of grams, ridge against its normal equations, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from strikelab.llm import langid as g

SCHEMA = "doc_id long, text string, lang string, lang_pred int, score string"


def test_letters():
    text = lambda s: "".join(map(chr, g.letters(s)))
    assert text("Ab1c -- Éß\n日本!") == " ab c éß 日本 "
    assert text("x") == " x " and text("  x") == " x "
    assert [len(g.letters(t)) for t in (None, "", "12 .,", "😀 1", "１")] == [0] * 5
    assert text("𝒳a😀b") == " 𝒳a b "


def test_kernels_are_shares_of_grams():
    texts = ["the cat sat", "the dog sat on the mat", "xyz", "a"]

    def plain(s):
        s = f" {s} "
        return {s[i : i + n] for n in g.SPECTRUM for i in range(len(s) - n + 1)}

    sets = [plain(t) for t in texts]
    got = g.kernels([g.grams(g.letters(t)) for t in texts], [g.letters(t) for t in texts])
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(got, want)


def test_ridge_solves_its_equations():
    rnd = np.random.default_rng(0)
    k = rnd.normal(size=(30, 5))
    m = k[:5] @ k[:5].T
    y = rnd.normal(size=(30, 2))
    a = g.ridge(k, m, y, 0.1)
    assert np.allclose(k.T @ (k @ a - y) + 0.1 * 30 * m @ a + 30e-8 * a, 0, atol=1e-6)


def test_collapsed_weights_equal_kernel_sums():
    texts = ["abc abd", "bcd ace", "zzz yzy"]
    marks = [g.grams(g.letters(t)) for t in texts]
    alpha = np.array([[0.5, -1.0], [2.0, 0.25], [-0.75, 1.5]])
    used = np.unique(np.concatenate(marks))
    place = np.full(g.BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    weights = np.zeros((len(used), 2), np.float32)
    for m, a in zip(marks, alpha, strict=True):
        weights[place[m]] += a / np.sqrt(len(m))
    asked = [g.letters(t) for t in ("abd zz", "bc", "qqq")]
    assert np.allclose(g.Model(["a", "b"], place, weights).outputs(asked), g.kernels(marks, asked) @ alpha, atol=1e-5)


def documents(n=240):
    words = {"x": ["lorem", "ipsum", "dolor"], "y": ["kata", "rinko", "suwa"], "z": ["ώρα", "λόγος", "νερό"]}
    rows = []
    for i in range(n):
        lang = "xyz"[i % 3]
        rows.append((i, " ".join(words[lang][(i * k) % 3] for k in range(1, 9)), lang, 1, "s"))
    return rows


def test_held_out_accuracy(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in g.languages_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, _, lang, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1


def test_labels_of_held_out_rows_are_not_seen(spark):
    rows = documents()
    other = [(i, t, "q" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, 1, "s") for i, t, lang, *_ in rows]
    a, b = ({tuple(r) for r in g.languages_of(spark.createDataFrame(x, SCHEMA)).collect()} for x in (rows, other))
    assert a == b


def test_odd_rows(spark):
    odd = [(None, "lorem ipsum", "x", 1, "s"), (1000, None, "x", 1, "s"), (1001, "", "y", 1, "s"), (1002, "12 34 😀", "y", 1, "s"), (1003, "lorem ipsum dolor " * 20000, None, 1, "s"), (0, "kata rinko", "x", 1, "s"), (0, "kata rinko", "x", 1, "s")]
    got = g.languages_of(spark.createDataFrame(documents() + odd, SCHEMA).repartition(3)).collect()
    assert len(got) == 240 + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["held_out"] and by[None]["lang_pred"] == "x" and by[1003]["lang_pred"] == "x"
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))


@pytest.mark.parametrize("rows", [[], [(3, "no language here", None, 1, "s")]])
def test_nothing_to_learn(spark, rows):
    assert [(r["lang_pred"], r["score"]) for r in g.languages_of(spark.createDataFrame(rows, SCHEMA)).collect()] == [("und", 0.0)] * len(rows)


def test_one_language_is_all_there_is(spark):
    rows = [(i, "lorem ipsum", "x", 1, "s") for i in range(9)]
    assert {r["lang_pred"] for r in g.languages_of(spark.createDataFrame(rows, SCHEMA)).collect()} == {"x"}
