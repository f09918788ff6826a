"""op11: counts and phrases against plain loops, with tries that burst and spill; odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strikelab.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def plain(rows, least, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:most])]
    return sorted(out)


@pytest.mark.parametrize("entries,burst", [(1_500_000, 8192), (40, 3)])
def test_against_loops(spark, entries, burst):
    rnd = random.Random(7)
    words = ["Ab", "cd", "éf", "g h", "日本", "x1", "x2", "x3"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "\t ", ". ", "\n"]) for _ in range(rnd.randrange(60))) for _ in range(60)]
    rows = [(i, t, rnd.choice(["en", "de", None]), 7, "k") for i, t in enumerate(texts)]
    rows += [(None, None, "en", 7, "k"), (1, "", None, 7, "k"), (2, "a a a a a a " * 2000, "en", 7, "k"), (2, "a a a a a a " * 2000, "en", 7, "k"), (3, " .,;\n", "fr", 7, "k")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in c.collocations(docs, 5, 20, entries=entries, burst=burst).collect())
    assert got == plain(rows, 5, 20)


def test_no_rows(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trie_bursts_and_spills():
    rnd = random.Random(3)
    trie, want, out = c.HatTrie(burst=4), Counter(), Counter()
    for _ in range(40):
        batch = Counter((rnd.randrange(5), rnd.randrange(6) | rnd.randrange(6) << 32) for _ in range(50))
        want.update(batch)
        keys = sorted(batch)
        trie.add(*(np.array(x, np.int64) for x in ([p for p, _ in keys], [s for _, s in keys], [batch[k] for k in keys])))
        if trie.size > 60:
            for p, s, n in zip(*(x.tolist() for x in trie.take(30)), strict=True):
                out[p, s] += n
            assert trie.size <= 30
    assert trie.nodes
    for p, s, n in zip(*(x.tolist() for x in trie.take(0)), strict=True):
        out[p, s] += n
    assert trie.size == 0 and out == want
