"""Weeks, hedges and portfolio stops against plain loops."""

from collections import defaultdict

import pytest
from loops import cents, decay, stop
from test_strategy_loops import RATE, SF, b120, books, compare, params  # noqa: F401

from strikelab import modifier_queries as mq
from strikelab import strategy_queries as q
from strikelab.catalog import FIRST, LAST

WEEK = 1440


@pytest.fixture(scope="module")
def weeks(books):  # noqa: F811
    """For each index the weeks: [(day, Book)] in order."""
    out = defaultdict(list)
    days = sorted({d for _, d in books})
    for i, d in enumerate(days):
        for idx in ("IDX0", "IDX1"):
            if (idx, d) in books:
                out[idx, i // 5].append((d, books[idx, d]))
    return out


class Week:
    """One week on one line of minutes; a day's opening bars are flat."""

    def __init__(self, days):
        self.days, self.n = days, len(days)

    def bars(self, scrip):
        out = []
        for i, (_, b) in enumerate(self.days):
            for t, h, low, c in b.bars[scrip]:
                out.append((i * WEEK + t, c, c, c) if t == FIRST else (i * WEEK + t, h, low, c))
        return out

    def pick(self, t, end, om="0"):
        i = t // WEEK
        k = self.days[i][1].pick(t % WEEK, LAST, om)
        if k is None and i + 1 < self.n:
            k = self.days[i + 1][1].pick(FIRST, FIRST, om)
            i += 1
        return (i * WEEK + k[0], *k[1:]) if k and i * WEEK + k[0] <= end else None

    def futures(self):
        return {i * WEEK + t: (c, c, c) if t == FIRST else (h, low, c) for i, (_, b) in enumerate(self.days) for t, (h, low, c) in b.fut.items()}

    def straddle(self, ce, pe):
        p, out = {x[0]: x for x in self.bars(pe)}, []
        for t, h, low, c in self.bars(ce):
            if t in p:
                s = (h + p[t][2], low + p[t][1], c + p[t][3])
                out.append((t, max(s), min(s), s[2]))
        return out

    def evening(self, i):
        late = [b for t in sorted(self.days[i][1].fut) if t > LAST - 15 and (b := self.days[i][1].pick(t, t))]
        return late[-1][3] + late[-1][4] if late else None


def ranged(w, p, k, std, trailed):
    """o, t, intra, pnl of a range stop."""
    bars = [x for x in w.straddle(k[1], k[2]) if k[0] <= x[0] <= p["end"]]
    if len(bars) < 2:
        return None, None, False, 0.0
    o, rest = bars[0][3], bars[1:]
    strike = float(std[1][:-2])
    low = band = std[3] + std[4]
    ce, pe, fut = {x[0]: x for x in w.bars(std[1])}, {x[0]: x for x in w.bars(std[2])}, w.futures()
    g = 1 if p["side"] == "SELL" else -1
    px, out, inner = rest[-1][3], None, False
    for j, (t, h, lo, c) in enumerate(rest[:-1]):
        if t in ce and t in pe and t in fut:
            if trailed and (x := w.days[t // WEEK][1].pick(t % WEEK, t % WEEK)) and x[3] + x[4] < low:
                low = band = x[3] + x[4]
            f = (strike + ce[t][1] - pe[t][2], strike + ce[t][2] - pe[t][1], strike + ce[t][3] - pe[t][3]) if p["synthetic_future"] else fut[t]
            if p["intra_sl"] and t % WEEK != FIRST and (f[0] >= strike + band * p["intra_sl"] / 100 or f[1] <= strike - band * p["intra_sl"] / 100):
                px, out, inner = (h if g > 0 else lo), t, True
                break
            if f[2] >= strike + band * p["sl"] / 100 or f[2] <= strike - band * p["sl"] / 100:
                px, out = c, t
                break
        if p["fixed_or_dynamic"] != "FIXED" and t // WEEK != rest[j + 1][0] // WEEK:
            for i in range(t // WEEK, rest[j + 1][0] // WEEK):
                band = w.evening(i) if w.evening(i) is not None else band
    return o, out, inner, cents(g * (o - px) - o * RATE)


def range_rounds(w, p, trailed, go=None, chosen=None):
    """(round, pick, o, t, intra, pnl) of a week's range stops from go on; chosen: the first straddle."""
    go, left = p["start"] if go is None else go, {i: p[f"dte{i}re"] for i in range(1, 6)}
    for i in range(21):
        k = (chosen if i == 0 and chosen else w.pick(go, p["end"])) if go is not None else None
        std = w.pick(k[0], p["end"]) if k else None
        if std is None:
            return
        o, t, inner, gain = ranged(w, p, k, std, trailed)
        yield i, k, o, t, inner, gain
        if t is None or t >= p["end"] - 5:
            return
        dte = 5 - t // WEEK
        if left[dte] == 0 or p["normal_or_cut"] == "CUT":
            go = None if dte == 1 else max(t, t // WEEK * WEEK + LAST - 15)
        else:
            left[dte] -= 1
            go = t


def by_week(df, sets, columns, weeks, loop):  # noqa: F811
    """Rows of df and of loop(week, parameters), which yields tuples of the columns."""
    names, got, n = [c.split()[0] for c in sets[1].split(", ")], defaultdict(list), 0
    for r in df.collect():
        got[(r["idx"], r["trade_date"], *(r[x] for x in names))].append(tuple(r[c] for c in columns))
    order = lambda x: tuple("" if v is None else f"{v:012.4f}" if isinstance(v, float) else str(v) for v in x)
    for (idx, _), days in weeks.items():
        w = Week(days)
        for p in params(sets):
            want, have = sorted(loop(w, p), key=order), sorted(got.pop((idx, days[0][0], *(p[x] for x in names)), []), key=order)
            assert len(have) == len(want), (idx, p, have, want)
            for x, y in zip(have, want, strict=True):
                assert all(u == v or (isinstance(u, float) and v is not None and u == pytest.approx(v, abs=0.011)) for u, v in zip(x, y, strict=True)), (idx, p, x, y)
            n += len(want)
    assert not got and n


@pytest.mark.parametrize("name,trailed", [("st_srew_range", False), ("st_srew_range_trail", True)])
def test_range(spark, weeks, name, trailed):
    by_week(getattr(q, name)(spark, SF), q.S_RANGE, ("round", "entry_t", "exit_t", "intra_hit", "pnl"), weeks, lambda w, p: ((i, k[0], t, inner, gain) for i, k, _, t, inner, gain in range_rounds(w, p, trailed)))


def test_range_first_alone(spark, weeks):
    by_week(q.range_sl_trail(spark, SF), q.S_RANGE, ("entry_t", "exit_t", "intra_hit", "pnl"), weeks, lambda w, p: ((k[0], t, inner, gain) for i, k, _, t, inner, gain in range_rounds(w, p, True) if i == 0))


def test_last_five_days(spark, weeks):
    def loop(w, p):
        by_day = defaultdict(float)
        g = 1 if p["side"] == "SELL" else -1
        for _, k, o, t, _, gain in range_rounds(w, p, False):
            bars = [x for x in w.straddle(k[1], k[2]) if k[0] < x[0] <= (p["end"] if t is None else t)]
            if o is None or not bars:
                continue
            before, total = o, 0.0
            ends = [x for x, y in zip(bars, bars[1:], strict=False) if x[0] // WEEK != y[0] // WEEK]
            for x in ends:
                by_day[x[0] // WEEK] += g * (before - x[3])
                before, total = x[3], total + g * (before - x[3])
            by_day[bars[-1][0] // WEEK] += gain - total
        if by_day:
            days = sorted(by_day, reverse=True)
            yield tuple(round(by_day[days[i]], 4) if i < len(days) else None for i in range(4, -1, -1))

    by_week(q.daywise_last5(spark, SF), q.S_RANGE, tuple(f"Dte{i}" for i in range(5, 0, -1)), weeks, loop)


def test_strangle_to_straddle(spark, weeks):
    def loop(w, p):
        k = w.pick(p["start"], p["end"], p["starting_om"])
        if k is None:
            return
        up, down = float(k[1][:-2]), float(k[2][:-2])
        scrips = (k[1], k[2], f"{int(down)}CE", f"{int(up)}PE")
        bars = [{x[0]: x[3] for x in w.bars(s)} for s in scrips]
        fut = {t: x[2] for t, x in w.futures().items()}
        pair = [t for t in sorted(bars[0]) if k[0] <= t <= p["end"] and t in bars[1]]
        five = [t for t in pair if t in bars[2] and t in bars[3] and t in fut]
        a, b = next((t for t in five if fut[t] >= up), None), next((t for t in five if fut[t] <= down), None)
        way = "up" if a is not None and (b is None or a < b) else "down" if b is not None and (a is None or b < a) else None
        at = {"up": a, "down": b}.get(way)
        opened = at is not None and at % WEEK == FIRST
        end, gain = at if at is not None else pair[-1], 0.0
        for i, side in ((0, "up"), (1, "down")):
            stays = way == side and not opened
            gain += k[3 + i] - bars[i][end] - (0.0 if stays else k[3 + i] * RATE)
        yield -1, k[0], k[1], k[2], at, cents(gain)
        if at is None:
            return
        if opened:
            chosen = w.pick(at, p["end"])
        else:
            ce, pe = (0, 3) if way == "up" else (2, 1)
            chosen = at, scrips[ce], scrips[pe], bars[ce][at], bars[pe][at]
        if chosen:
            for i, x, _, t, _, g in range_rounds(w, p, False, at, chosen):
                yield i, x[0], x[1], x[2], t, g

    by_week(q.st_str_to_std(spark, SF), q.S_TO_STD, ("round", "entry_t", "ce", "pe", "exit_t", "pnl"), weeks, loop)


def test_hedges(spark, books):  # noqa: F811
    def loop(b, p):
        cc = p["method"] == "CC"
        for t in sorted(b.fut):
            k = b.pick(t, t) if p["start"] <= t <= p["end"] else None
            h = b.above(t, t, (k[3] + k[4]) / 2 * 0.3) if k else None
            if h:
                break
        else:
            return
        yield "std", 0, k[0], stop(b.straddle(k[1], k[2]), k[0], p["end"], combined=True, rate=RATE)["pnl"]
        for leg, i in (("ce", 1), ("pe", 2)):
            goal, at = h[i + 2] * (100 + p["hedge_decay"]) / 100, k[0]
            for n in range(8):
                t, _ = decay(b.bars[h[i]], at, p["end"], "BUY", price=goal, cc=cc) if at is not None else (None, None)
                if t is None:
                    break
                r = stop(b.bars[h[i]], t, p["end"], "BUY", p["hedge_sl"], cc=cc, entry=None if cc else goal, rate=RATE)
                yield leg, n, t, r["pnl"]
                at = r["t"]

    compare(q.st_hedge_bre(spark, SF), books, q.S_HEDGE, loop, ("leg", "round", "entry_t", "pnl"))


def series(b, p, start, times=1.0):
    """Series of the legs and the followed one, and the exit."""
    x = b120(b, p, start)
    if x is None:
        return None
    legs = {k: x[k]["points"] for k in ("ce", "pe")}
    if x["u"]:
        other = "pe" if x["first"] == "ce" else "ce"
        legs[other] = [v for v in legs[other] if v[0] <= x["u"]["points"][0][0] - 1]
    return x, legs["ce"], legs["pe"], [(t, v * times) for t, v in x["u"]["points"]] if x["u"] else []


def test_doubled_follow(spark, books):  # noqa: F811
    def loop(b, p):
        go = p["start"]
        for n in range(6):
            s = series(b, p, go, 2.0) if go is not None else None
            if s is None:
                return
            yield n, s[0]["pick"][0], s[0]["exit"], cents(sum(x[-1][1] for x in s[1:] if x))
            go = s[0]["exit"] if s[0]["exit"] is not None and s[0]["exit"] < p["end"] - 5 else None

    compare(q.st_b120_dut_re(spark, SF), books, q.S_B120, loop, ("round", "entry_t", "exit_t", "total_pnl"))


def test_portfolio_stop(spark, books):  # noqa: F811
    def loop(b, p):
        grid = list(range(FIRST, LAST + 1, 10))
        total, times = [0.0] * len(grid), range(p["start"], p["last_trade_time"] + 1, p["trade_interval"])
        traded = False
        for start in times:
            if s := series(b, p, start):
                traded = True
                for points in s[1:]:
                    for i, t in enumerate(grid):
                        before = [v for u, v in points if u <= t]
                        total[i] += before[-1] if before else 0.0
        if not traded:
            return
        n = int(int(1e9 / len(times)) / (b.fut[min(b.fut)][2] * 0.12))
        cash = [round(x * n, 2) for x in total]
        for level in q.LEVELS:
            hit = next((i for i, x in enumerate(cash) if (x > level * 1e7 if level > 0 else x < level * 1e7)), None)
            if hit is None or hit + 1 == len(cash):
                yield float(level), None, cash[-1]
            else:
                yield float(level), grid[hit], cash[hit + 1]

    got = mq.mod_psl(spark, SF).collect()
    names, want = [c.split()[0] for c in q.S_PSL[1].split(", ")], {}
    for day, b in books.items():
        for p in params(q.S_PSL):
            want |= {(*day, *(p[n] for n in names), level): (t, paid) for level, t, paid in loop(b, p)}
    assert len(got) == len(want)
    for r in got:
        t, paid = want[(r["idx"], r["trade_date"], *(r[n] for n in names), r["level"])]
        assert r["paid"] == pytest.approx(paid, rel=1e-6, abs=20_000) and r["paid"] == pytest.approx(r["paid_std"] + r["paid_ut"], abs=0.05)
        assert r["t"] == t or abs(paid) < 1
