"""Trust and distrust reach any distance, and their limit."""

import numpy as np
import pytest

from strikelab.llm import hostrank


def test_distrust_far_down_a_chain(spark):
    hosts = [f"h{i}.dev" for i in range(12)]
    rows = [(0, "https://example.com/de/x", "")]
    rows += [(1 + i, f"https://{h}/", f'<a href="https://{hosts[i - 1] if i else "example.com"}/">x</a>') for i, h in enumerate(hosts)]
    rows += [(100 + i, f"https://alone{i}.dev/", "") for i in range(60)]
    got = {r["host"]: r["verdict"] for r in hostrank.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    over = {h: 0.15 * 0.85 ** (i + 1) * len(rows) > 1 for i, h in enumerate(hosts)}
    assert over["h10.dev"]
    assert {h for h in hosts if got[h] == "block"} == {h for h in hosts if over[h]} and got["alone1.dev"] == "allow"


def test_scores_reach_their_limit(spark):
    names = "abcd"
    edges = [("a", "b", 2), ("b", "a", 1), ("b", "c", 1), ("c", "a", 3), ("c", "d", 1)]
    seeds = [("trust", "a", 0.7), ("trust", "d", 0.3), ("distrust", "c", 1.0)]
    got = hostrank.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "kind string, host string, seed double"), tolerance=1e-3).collect()
    got = {(r["kind"], r["host"]): r["score"] for r in got}
    for kind in ("trust", "distrust"):
        m, s = np.zeros((4, 4)), np.zeros(4)
        for a, b, n in edges:
            m[(names.index(b), names.index(a)) if kind == "trust" else (names.index(a), names.index(b))] = n
        m /= np.maximum(m.sum(0), 1)
        for k, h, x in seeds:
            s[names.index(h)] += x * (k == kind)
        want = np.linalg.solve(np.eye(4) - 0.85 * m, 0.15 * s)
        assert [got.get((kind, h), 0.0) for h in names] == pytest.approx(list(want), abs=1e-3)
