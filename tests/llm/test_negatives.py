"""op12: hard negatives against brute force, with ties, copies, odd rows; the trees' bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikelab.llm import negatives as n

SCHEMA = "id long, label int, vector array<double>, rank int, score double"


def plain(rows, is_anchor, low=50, high=95):
    rows = [r for r in rows if None not in r[:3] and None not in r[2]]
    anchors = {}
    for r in rows:
        if is_anchor(r[0]):
            anchors[r[0]] = min(anchors.get(r[0], (r[2], r[1])), (r[2], r[1]))
    out = []
    for a, (v, label) in anchors.items():
        dim = len(v)
        scored = sorted((-int(sum(x * y for x, y in zip(v, r[2], strict=True))), r[0], r[1]) for r in rows if r[0] != a and len(r[2]) == dim)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            near = [(t, i) for t, i, k in scored if k != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, j + 1, i, -s, -t) for j, (t, i) in enumerate(near[:3])]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("kind", ["random", "clusters", "copies", "none"])
@pytest.mark.parametrize("block,batch,cell", [(2048, 256, 8192), (30, 7, 40)])
def test_against_brute_force(spark, kind, block, batch, cell):
    rnd = random.Random(5)
    centres = [[rnd.randrange(-200, 200) for _ in range(6)] for _ in range(8)]

    def vector():
        if kind == "random":
            return [float(rnd.randrange(-9, 9)) for _ in range(6)]
        if kind == "copies" and rnd.random() < 0.5:
            return [float(x) for x in centres[0]]
        return [float(x + rnd.randrange(-8, 8)) for x in rnd.choice(centres)]

    rows = [] if kind == "none" else [(i, rnd.randrange(4), vector()) for i in range(260)]
    if rows:
        rows += [(300, None, vector()), (None, 1, vector()), (310, 1, None), (320, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (330, 2, []), (331, 2, []), (332, 3, []), (340, 1, [3.0, 4.0]), (341, 1, [3.0, 4.0]), (342, 2, [2.0, 3.0]), (20, 1, vector()), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], SCHEMA).repartition(3)
    got = n.hard_negatives(df, F.col("id") % 10 == 0, block=block, batch=batch, cell=cell)
    want = plain(rows, lambda i: i is not None and i % 10 == 0)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == want
    assert want or kind == "none"


def test_radii_cover_what_lies_under():
    rnd = np.random.default_rng(2)
    x = np.floor(rnd.normal(size=(300, 5)) * 20)
    tree = n.cover_tree(np.concatenate([x, x[:50]]), np.arange(350), np.zeros(350, int))
    norms = (tree.points**2).sum(1)
    grown = np.column_stack([tree.points, np.sqrt(norms.max() - norms)])
    kids = set(tree.parent.tolist())
    leaves = [i for i in range(len(tree.centre)) if i not in kids]
    assert sorted(tree.centre[leaves].tolist()) == list(range(len(tree.points))) and len(tree.ids) == 350
    for i in leaves:
        at = i
        while (at := tree.parent[at]) >= 0:
            assert np.sqrt(((grown[tree.centre[at]] - grown[tree.centre[i]]) ** 2).sum()) <= tree.radius[at] + 1e-6


def test_first_of_many(spark):
    """Enough points for several rounds of opening nodes, in 16 dimensions."""
    rnd = np.random.default_rng(9)
    x, labels = np.floor(rnd.normal(size=(1500, 16)) * 60), rnd.integers(0, 3, 1500)
    tree = n.cover_tree(x, np.arange(1500), labels)
    q = np.arange(0, 1500, 13)
    at, scores, ids = n.positives_in(tree, x[q], q, labels[q], 5)
    for i, a in enumerate(q.tolist()):
        s = (x @ x[a]).astype(int)
        first = sorted((-s[j], j) for j in range(1500) if j != a and labels[j] == labels[a])[:5]
        assert [(-int(u), int(v)) for u, v in zip(scores[at == i], ids[at == i], strict=True)] == [(int(u), v) for u, v in first]
    goals = [[-int(s[0]) for s in sorted((-int(x[j] @ x[a]), j) for j in range(1500) if j != a and labels[j] == labels[a])[:5]] for a in q.tolist()]
    at, place, scores, ids = n.negatives_in(tree, x[q], q, labels[q], goals, 50, 95, 3)
    for i, a in enumerate(q.tolist()):
        s = (x @ x[a]).astype(int)
        for w, p in enumerate(goals[i]):
            first = sorted((-s[j], j) for j in range(1500) if labels[j] != labels[a] and 50 * p <= 100 * s[j] <= 95 * p)[:3]
            here = (at == i) & (place == w)
            assert [(-int(u), int(v)) for u, v in zip(scores[here], ids[here], strict=True)] == [(int(u), v) for u, v in first]


def test_search_skips_clusters_out_of_reach():
    rnd = np.random.default_rng(4)
    centres = np.eye(12) * 400
    x = np.floor(np.repeat(centres, 60, 0) + rnd.normal(size=(720, 12)) * 4)
    tree = n.cover_tree(x, np.arange(720), np.repeat(np.arange(12), 60))
    seen = np.isfinite(n.best_first(tree, x[:1], lambda f: n._kth(f, 5)))
    assert 6 <= seen.sum() < 200
