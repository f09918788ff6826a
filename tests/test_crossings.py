"""Crossings where the two means are equal, or nearly: flat series and small steps in cents."""

import random
from fractions import Fraction

import pytest
from strikelab.operators import indicators


def series(k):
    """Closes in cents."""
    rnd = random.Random(k)
    close = 100_000 + rnd.randrange(400)
    return [close := close + (rnd.choice([-1, 0, 1]) if k % 2 else 0) for _ in range(60)]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(f"S{k}", 1, t, c / 100) for k in range(60) for t, c in enumerate(series(k))]
    return spark.createDataFrame(rows, "idx string, trade_date int, t int, close double").repartition(3)


def test_equal_simple_means_do_not_cross(bars):
    got = {(r["idx"], r["t"]): (r["signal"], r["positions"]) for r in indicators.moving_cross(bars, 5, 20, places=6).collect()}
    want = {}
    for k in range(60):
        s, before = series(k), None
        for t in range(19, 60):
            up = int(Fraction(sum(s[t - 4 : t + 1]), 5) > Fraction(sum(s[t - 19 : t + 1]), 20))
            want[f"S{k}", t] = (up, None if before is None else up - before)
            before = up
    assert got == want


def test_equal_exponential_means_do_not_cross(bars):
    """Flat series never cross, and means are those of weights 2 / (n + 1) and 1 - 2 / (n + 1), to the last bit."""
    got = {(r["idx"], r["t"]): r for r in indicators.moving_cross(bars, 5, 20, short_type="EXPONENTIAL", long_type="EXPONENTIAL").collect()}
    assert len(got) == 3600
    for k in range(60):
        s = [c / 100 for c in series(k)]
        means = [s[0], s[0]]
        for t, c in enumerate(s):
            means = [2 / (n + 1) * c + (1 - 2 / (n + 1)) * m if t else m for n, m in zip((5, 20), means, strict=True)]
            r = got[f"S{k}", t]
            assert [r["short_ma"], r["long_ma"]] == means
            assert r["signal"] == int(round(means[0], 9) > round(means[1], 9))
            assert k % 2 or r["signal"] == 0
