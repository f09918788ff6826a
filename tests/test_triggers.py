import random

from pyspark.sql import functions as F

from strikelab.functions import triggers


def loop(bars, start, end, side, sl, intra, closes):
    """A plain bar-by-bar stop, for comparison."""
    w = [b for b in bars if start <= b[0] <= end]
    if len(w) < 2:
        return None
    o, g = w[0][3], 1 if side == "SELL" else -1
    stop, far = (100 + g * sl) / 100 * o if sl else None, (100 + g * intra) / 100 * o if intra else None
    for t, h, low, c in w[1:]:
        x = h if side == "SELL" else low
        if far is not None and g * x >= g * far:
            return o, t, far
        if stop is not None and g * (c if closes else x) >= g * stop:
            return o, t, c if closes else stop
    return o, None, w[-1][3]


def test_stop_like_a_loop(spark):
    rnd = random.Random(3)
    legs, want = [], {}
    for k in range(120):
        p, bars = 100.0, []
        for t in range(540, 700, rnd.choice([5, 10, 80])):
            c = p + rnd.randint(-6, 6)
            bars.append((t, max(p, c) + rnd.randint(0, 3), min(p, c) - rnd.randint(0, 3), float(c)))
            p = c
        side, sl, intra, closes = rnd.choice(["SELL", "BUY"]), rnd.choice([0.0, 5.0, 9.0]), rnd.choice([0.0, 12.0]), rnd.random() < 0.5
        start = rnd.choice([540, 563, 690, 699])
        legs.append((k, bars, start, 680, side, sl, intra, closes))
        want[k] = loop(bars, start, 680, side, sl, intra, closes)
    df = spark.createDataFrame(legs, "k int, bars array<struct<t:int,high:double,low:double,close:double>>, start int, end int, side string, sl double, intra double, closes boolean")
    r = triggers.stop(F.col("bars"), F.col("start"), F.col("end"), side=F.col("side"), sl=F.col("sl"), intra=F.col("intra"), closes=F.col("closes"))
    for r in df.select("k", r.alias("r")).select("k", "r.*").collect():
        assert (None if r.o is None else (r.o, r.t, r.exit)) == want[r.k]
        assert r.pnl == 0 if r.o is None else True


def test_step_trail(spark):
    bars = [(1, 100.0, 100.0, 100.0), (2, 100.0, 96.0, 97.0), (3, 97.0, 90.0, 91.0), (4, 104.5, 91.0, 104.0)]
    df = spark.createDataFrame([(bars,)], "bars array<struct<t:int,high:double,low:double,close:double>>")
    stepped = lambda step: df.select(triggers.trail(F.col("bars"), F.lit(1), F.lit(9), mode="STEP", side=F.lit("SELL"), sl=8.0, step=step, sl_step=2.0).alias("r")).select("r.*").first()
    r = stepped(3.0)
    assert r.moved and r.t == 4 and abs(r.exit - 108 * 0.98 * 0.98) < 1e-9
    r = stepped(0.0)
    assert (r.pnl, r.status) == (0.0, "invalid_trail")


def test_legs_that_miss_minutes(spark):
    bar = "array<struct<t:int,high:double,low:double,close:double>>"
    rows = [(1, [(1, 5.0, 3.0, 4.0), (3, 8.0, 6.0, 7.0), (4, 2.0, 1.0, 1.5)], [(2, 1.0, 1.0, 1.0), (3, 3.0, 1.0, 2.0), (4, 5.0, 4.0, 4.0)]), (2, [], [(3, 1.0, 1.0, 1.0)]), (3, None, [(3, 1.0, 1.0, 1.0)])]
    df = spark.createDataFrame(rows, f"k int, ce {bar}, pe {bar}")
    got = {r["k"]: r for r in df.select("k", triggers.straddle_bars(F.col("ce"), F.col("pe")).alias("b"), triggers.common(F.col("pe"), F.col("ce")).alias("c")).collect()}
    assert [tuple(b) for b in got[1]["b"]] == [(3, 9.0, 9.0, 9.0), (4, 6.0, 5.5, 5.5)] and [b["t"] for b in got[1]["c"]] == [3, 4]
    assert got[2]["b"] == [] and not got[3]["b"]


def test_odd_slices(spark):
    """No bars, no legs, one bar, null levels: nothing is traded, and nothing fails."""
    bar = "array<struct<t:int,high:double,low:double,close:double>>"
    df = spark.createDataFrame([(None, 1), ([], 1), ([(5, 1.0, 1.0, 1.0)], 1), ([(5, 1.0, 1.0, 1.0), (6, 2.0, 2.0, 2.0)], None)], f"bars {bar}, start int")
    b, s, e = F.col("bars"), F.col("start"), F.lit(9)
    out = df.select(
        triggers.stop(b, s, e, side=F.lit("SELL"), sl=5.0).alias("a"), triggers.decay(b, s, e, side=F.lit("SELL"), percent=F.lit(5.0)).alias("d"), triggers.trail(b, s, e, mode="RATIO", side=F.lit("BUY"), sl=5.0).alias("q"),
        triggers.trail_combined(b, s, e, mode="STEP", side=F.lit("BUY"), sl=5.0, step=2.0, sl_step=1.0).alias("c"),
    )
    for r in out.collect():
        assert (r["a"]["o"], r["a"]["t"], r["a"]["pnl"]) == (None, None, 0.0)
        assert r["d"]["t"] is None and not r["d"]["hit"]
        assert (r["q"]["pnl"], r["c"]["pnl"], r["q"]["hit"]) == (0.0, 0.0, False)


def test_limited_trail(spark):
    bar = "array<struct<t:int,high:double,low:double,close:double>>"
    bars = [(1, 100.0, 100.0, 100.0), (2, 100.0, 96.0, 97.0), (3, 97.0, 90.0, 91.0), (4, 107.0, 91.0, 106.0)]
    df = spark.createDataFrame([(bars,)], f"bars {bar}")
    got = df.select(triggers.trail_limited(F.col("bars"), F.lit(1), F.lit(9), side=F.lit("SELL"), o=F.lit(100.0), sl=8.0, sl_step=2.0, step=3.0, most=3).alias("g")).first()["g"]
    once, twice = 108 * 0.98, 108 * 0.98 * 0.98
    assert [round(x, 9) for x in got] == [round(100 - once, 9), round(100 - twice, 9), round(100 - twice, 9)]
