"""Indicators against plain loops over one series each: random, flat and short ones."""

import random

import pytest
from pyspark.sql import functions as F

from strikelab.operators import indicators


def series(seed):
    rnd = random.Random(seed)
    close, out = 100.0, []
    for t in range(rnd.choice([3, 14, 15, 60, 120])):
        step = rnd.choice([0, 0, 1, -1, 2, -2, 5, -5]) if seed % 5 else 0
        close += step * rnd.choice([0.5, 1.0])
        out.append((t, close + rnd.choice([0, 0.5, 1]), close - rnd.choice([0, 0.5, 1]), close))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(f"S{k}", 1, t, h, lo, c) for k in range(40) for t, h, lo, c in series(k)]
    return spark.createDataFrame(rows, "idx string, trade_date int, t int, high double, low double, close double")


def cut_up(bars):
    """The same series in blocks of seven bars."""
    return bars.withColumn("day", F.floor(F.col("t") / 7).cast("int")).drop("trade_date")


LONG = {"keys": ("idx",), "block": ("day",)}


def same(df, wanted, columns):
    got = {}
    for r in df.collect():
        got[r["idx"], r["t"]] = tuple(r[c] for c in columns)
    want = {}
    for k in range(40):
        for (t, *_), row in zip(series(k), wanted(series(k)), strict=True):
            want[f"S{k}", t] = row
    assert got.keys() == want.keys()
    for key, row in want.items():
        for g, w, c in zip(got[key], row, columns, strict=True):
            assert (g is None) == (w is None) and (g is None or (g == pytest.approx(w, abs=1e-9) if isinstance(w, float) else g == w)), (key, c, g, w)


def ranges(s):
    return [h - lo if i == 0 else max(h - lo, abs(h - s[i - 1][3]), abs(lo - s[i - 1][3])) for i, (_, h, lo, _) in enumerate(s)]


def wilder(x, n, first):
    out = [None] * len(x)
    at = first + n - 1
    for i in range(at, len(x)):
        out[i] = sum(x[first : at + 1]) / n if i == at else (out[i - 1] * (n - 1) + x[i]) / n
    return out


def test_supertrend(bars):
    def loop(s, n=10, times=3.0):
        a = wilder(ranges(s), n, 0)
        rows, side, up, down = [], None, None, None
        for i, (_, h, lo, c) in enumerate(s):
            was, level = side, None
            if i >= n - 1:
                u, d = (h + lo) / 2 + times * a[i], (h + lo) / 2 - times * a[i]
                if i == n - 1:
                    side = 1
                else:
                    if c > up:
                        side = 1
                    elif c < down:
                        side = -1
                    elif side == 1:
                        d = max(d, down)
                    else:
                        u = min(u, up)
                    level = d if side == 1 else u
                up, down = u, d
            change = None if was is None or side is None else (side - was) / 2
            rows.append((side, level, change, {None: None, 0: "", 1: "CE", -1: "PE"}[change], {None: None, 0: "", 1: "PE", -1: "CE"}[change]))
        return rows

    for df in (indicators.supertrend(bars), indicators.supertrend(cut_up(bars), **LONG)):
        same(df, loop, ["up", "level", "positions", "buy", "sell"])


def test_rsi(bars):
    def loop(s, n=14):
        d = [0.0] + [b[3] - a[3] for a, b in zip(s, s[1:], strict=False)]
        up, down = wilder([max(x, 0.0) for x in d], n, 1), wilder([max(-x, 0.0) for x in d], n, 1)
        rows, before = [], None
        for u, v in zip(up, down, strict=True):
            value = None if u is None or u == v == 0 else 100.0 if v == 0 else 100 - 100 / (1 + u / v)
            signal = 0 if value is None else 1 if value < 30 else -1 if value > 70 else 0
            change = None if before is None else float(signal - before)
            rows.append((value, signal, change, None if change is None else {1.0: "CE", 0.0: "", -1.0: ""}.get(change, str(change)), None if change is None else {-1.0: "PE", 0.0: "", 1.0: ""}.get(change, str(change))))
            before = signal
        return rows

    for df in (indicators.rsi(bars), indicators.rsi(cut_up(bars), **LONG)):
        same(df, loop, ["rsi", "signal", "positions", "buy", "sell"])


def test_macd(bars):
    def ema(x, n):
        out = []
        for v in x:
            out.append(v if not out else out[-1] + 2 / (n + 1) * (v - out[-1]))
        return out

    def loop(s):
        close = [b[3] for b in s]
        line = [f - g for f, g in zip(ema(close, 12), ema(close, 26), strict=True)]
        slow = ema(line[33:], 9)
        rows, before = [], None
        for i in range(len(s)):
            m = line[i] if i >= 33 else None
            g = slow[i - 33] if i >= 41 else None
            h = None if g is None else m - g
            cross = 0 if h is None or before is None else 1 if h > 0 >= before else -1 if h < 0 <= before else 0
            rows.append((m, g, h, cross, "CE" if cross == 1 else "", "PE" if cross == -1 else ""))
            before = h
        return rows

    for df in (indicators.macd(bars), indicators.macd(cut_up(bars), **LONG)):
        same(df, loop, ["macd", "signal_line", "hist", "crossing", "buy", "sell"])


def test_means(bars):
    def loop(s):
        e, out = None, []
        for tr, a, b in zip(ranges(s), wilder(ranges(s), 10, 0), s, strict=True):
            e = b[3] if e is None else e + 2 / 6 * (b[3] - e)
            out.append((tr, a, e))
        return out

    for how, df in (({}, bars), (LONG, cut_up(bars))):
        same(indicators.ema(indicators.atr(df, **how), 5, "e", **how), loop, ["tr", "atr", "e"])
