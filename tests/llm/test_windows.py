"""Benchmark windows against a plain search, in one block and in many."""

import hashlib
import random
import re

from strikelab.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(10, len(v))
        for j in range(len(v) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[j : j + k]:
                    hit.update(range(i, i + k))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_like_a_plain_search(spark):
    rnd = random.Random(8)
    say = lambda n: " ".join(rnd.choice(["a", "B", "cé", "d,", "(e)"]) for _ in range(n))
    items = [(i if i % 7 else None, say(rnd.choice([0, 1, 4, 9, 10, 11, 14]))) for i in range(30)]
    items += [(100 + i, f"q{i} " + say(10)) for i in range(5)] + [(5, items[6][1]), (200, None)]
    docs = [(i, say(rnd.randrange(60)) + rnd.choice(["", " x ", " " + (items[rnd.randrange(30)][1] or "")])) for i in range(80)] + [(None, None), (3, ""), (3, items[8][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), *plain(t, items)) for d, t in docs)
    for size in (1 << 20, 60):
        rows = decontam.contamination(frame, bench, nodes=size).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows) == want
        kept = decontam.without_benchmark(frame, bench, nodes=size).collect()
        assert sorted((str(d), t or "") for d, t in docs if plain(t, items)[1] == 0) == sorted((str(r["doc_id"]), r["text"] or "") for r in kept)


def test_pieces_hold_each_window_once():
    for n in range(25):
        text = " ".join(f"w{i}" for i in range(n)).encode()
        for nodes in (1, 40, 100, 1000):
            pieces = [p for p, _ in decontam.pieces_of(text, 10, nodes)]
            assert [w for p in pieces for w in decontam.windows_of(p, 10)] == decontam.windows_of(text, 10)
            assert all(size == sum(map(len, decontam.windows_of(p, 10))) for p, size in decontam.pieces_of(text, 10, nodes))


def test_nodes_are_bounded():
    rnd = random.Random(1)
    text = " ".join(f"{rnd.randrange(20000):x}" for _ in range(30_000)).encode()
    for piece, size in decontam.pieces_of(text, 10, 200_000):
        assert size <= 200_000 + 100 and decontam.automaton([("a", piece)], 10).get_stats()["nodes_count"] <= size + 1
