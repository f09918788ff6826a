"""Trails on whole ticks, and strangles whose premium unit is that of the first minute, against plain loops."""

import pytest
from loops import trail
from test_strategy_loops import SF, books  # noqa: F401

from strikelab import instrument_queries as q


def test_trails_on_ticks(spark, books):  # noqa: F811
    n = 0
    for r in q.ix_trail(spark, SF).collect():
        own = {"rate": 0.005, "tick": 1.0} if r["idx"] == "IDX1" else {"rate": 0.01}
        want = trail(books[r["idx"], r["trade_date"]].bars[r["scrip"]], 565, 900, r["rule"], r["side"], 8.0, **own, **q.TRAILS[r["rule"]])
        assert (r["t"], r["moved"], r["pnl"]) == (want["t"], want["moved"], pytest.approx(want["pnl"], abs=0.011)), r
        n += want["moved"]
        if r["idx"] == "IDX1" and r["stop"] is not None:
            assert r["stop"] == int(r["stop"])
    assert n > 300


def test_unit_of_the_first_minute(spark, books):  # noqa: F811
    later = 0
    for r in q.strangle_asof(spark, SF).collect():
        b, (units, flips) = books[r["idx"], r["trade_date"]], q._VALUES[r["om"]]
        first = next((t for t in sorted(b.fut) if t >= r["start"]), None)
        want = None
        if first is not None:
            f = b.fut[first][2]
            want = b.strangle(first, r["end"], (f // 100 if r["idx"] == "IDX1" else round(f) / 100) * units)
            if want and flips and float(want[1][:-2]) < float(want[2][:-2]):
                want = b.pick(want[0], r["end"])
        assert (r["t"], r["ce"], r["pe"]) == (want[:3] if want else (None,) * 3), (r, want)
        later += bool(want) and want[0] > first
    assert later > 20
