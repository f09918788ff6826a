"""Repeated windows of three words are counted exactly, hashes that collide included."""

import random

from strikelab.llm import host_quality


def plain(text: str) -> int:
    w = text.split()
    seen: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_like_a_plain_count(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(40))) for _ in range(300)] + ["", "a", "a a", "a a a", "a a a a"]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    want = {i: plain(t) for i, t in enumerate(texts)}
    for hashed in ("xxhash64(w[i], w[i + 1], w[i + 2])", "xxhash64(w[i])", "0L"):
        got = {r["doc_id"]: r["n_repeat_words"] for r in host_quality.figures(docs, window_hash=hashed).collect()}
        assert got == want
