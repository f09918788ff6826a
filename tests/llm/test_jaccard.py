import random
from math import ceil

from strikelab.llm.jaccard import jaccard_components, keep_one

SCHEMA = "doc_id long, text string, n long, key string, rep long"


def brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", None) for d, t in rows], SCHEMA).repartition(5)


def test_like_all_pairs(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 120))] for _ in range(12)]
    rows = []
    for d in range(420):
        w = list(rnd.choice(base[:3] if d % 2 else base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            i = rnd.randrange(len(w))
            w[i : i + rnd.randint(0, 2)] = [rnd.choice(vocab)] * rnd.randint(0, 2) if len(w) > 3 else w[i : i + 1]
        rows.append((d, " ".join(w).upper() if d % 7 == 0 else "\n".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "a b"), (1004, "A  B"), (1005, "a c"), (1006, "é è"), (1007, "É è")]
    for width, percent in ((4, 85), (5, 80), (2, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows), width, percent).collect()}
        assert got == brute(rows, width, percent)


def test_odd_input(spark):
    assert jaccard_components(frame(spark, []), 4, 85).count() == 0
    same = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")]
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_components(frame(spark, same), 4, 85).collect()) == [(-1, -1), (3, 3), (7, 3), (7, 3)]
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, None)]
    assert {(r.doc_id, r.component_id) for r in jaccard_components(frame(spark, rows), 5, 80).collect()} == {(1, 1), (2, 1), (3, 3)}
    kept = keep_one(frame(spark, rows + same))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "None"]
    assert kept.columns == ["doc_id", "text", "n", "key", "rep"]
