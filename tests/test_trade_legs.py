"""Portfolio stops, gates and weeks by trade legs against plain loops, over the whole small tape."""

from collections import defaultdict

import pytest
from loops import cents, cut, decay, earlier, stop
from test_strategy_loops import RATE, SF, b120, books, params  # noqa: F401
from test_week_loops import Week, series, weeks  # noqa: F401

from strikelab import modifier_queries as mq
from strikelab import strategy_queries as q
from strikelab.catalog import FIRST, LAST

GRID = range(FIRST, LAST + 1, 10)


def paid(points, shares, lag):
    """level, time, what is paid, of the summed series of one set."""
    cash = []
    for t in GRID:
        cash.append(round(sum(next((v for u, v in reversed(p) if u <= t), 0.0) for p in points) * shares, 2))
    for level in q.LEVELS:
        hit = next((i for i, x in enumerate(cash) if (x > level * 1e7 if level > 0 else x < level * 1e7)), None)
        if hit is None or hit + lag >= len(cash):
            yield float(level), None, cash[-1]
        else:
            yield float(level), GRID[hit], cash[hit + lag]


def check(got, books, sets, trades, margin=12.0, lag=1, whole=True):  # noqa: F811
    """got against trades(book, set, start), the series of one entry's legs, or None without a choice."""
    names, want = [c.split()[0] for c in sets[1].split(", ")], {}
    for day, b in books.items():
        price = b.fut[min(b.fut)][2] * margin / 100
        for p in params(sets):
            rungs = range(p["start"], p["last_trade_time"] + 1, p["trade_interval"]) if whole else [p["start"]]
            found = [x for s in rungs if (x := trades(b, p, s)) is not None]
            if found:
                shares = int(int(1e9 / len(rungs)) / price) if whole else 1e9 / price
                for level, t, cash in paid([s for x in found for s in x], shares, lag):
                    want[(*day, *(p[n] for n in names), level)] = t, cash
    rows = got.collect()
    assert len(rows) == len(want) > 100
    for r in rows:
        t, cash = want[(r["idx"], r["trade_date"], *(r[n] for n in names), r["level"])]
        assert r["paid"] == pytest.approx(cash, rel=1e-6, abs=20_000) and (r["t"] == t or abs(cash) < 1), (r, t, cash)


def plain(bars, start, until, side="SELL"):
    """The series of bars held from start to until, realised at the last close."""
    w, g = cut(bars, start, until), 1 if side == "SELL" else -1
    out = [(t, g * (w[0][3] - c) - w[0][3] * RATE) for t, _, _, c in w[1:]]
    return [*out[:-1], (out[-1][0], cents(out[-1][1]))] if out else []


def test_b120_rounds(spark, books):  # noqa: F811
    def trades(b, p, start):
        out = None
        for n in range(p["re_entries"] + 1):
            s = series(b, p, start) if start is not None else None
            if s is None:
                break
            out = (out or []) + list(s[1:])
            start = s[0]["exit"] if s[0]["exit"] is not None and s[0]["exit"] < p["end"] - 5 else None
        return out

    check(mq.mod_psl_b120_re(spark, SF), books, mq.S_PSL_RE, trades)


def test_separate_stops(spark, books):  # noqa: F811
    def trades(b, p, start):
        out = None
        for _ in range(p["re_entries"] + 1):
            k = b.pick(start, p["end"]) if start is not None else None
            if k is None:
                break
            r = {x: stop(b.common(k[i], k[j]), k[0], p["end"], p["side"], p["sl"], rate=RATE) for x, i, j in (("ce", 1, 2), ("pe", 2, 1))}
            first = earlier(r["ce"]["t"], r["pe"]["t"])
            at = r[first]["t"] if first else r["ce"]["t"]
            out = out or []
            for x, i in (("ce", 1), ("pe", 2)):
                out.append(r[x]["points"] if first == x else plain(b.bars[k[i]], k[0], p["end"] if at is None else at))
            start = at if at is not None and at < p["end"] - 5 else None
        return out

    check(mq.mod_psl_sre_sep(spark, SF), books, mq.S_PSL_SEP, trades)


def test_premium_shift(spark, books):  # noqa: F811
    def trades(b, p, start):
        k = b.pick(start, p["end"], p["om"])
        if k is None:
            return None
        leg, t0, end, cc = {"ce": k[1], "pe": k[2]}, {"ce": k[0], "pe": k[0]}, p["end"], p["method"] == "CC"
        premium, out, exit_t = k[3] + k[4], [], p["end"]
        for _ in range(21):
            move, divider = premium * p["movement"] / 100, premium * p["divider"] / 100
            t = {x: stop(b.common(leg[x], leg[y]), max(t0.values()), end, p["side"], slp=move, cc=cc)["t"] for x, y in (("ce", "pe"), ("pe", "ce"))}
            first = earlier(t["ce"], t["pe"])
            if first is None and t["ce"] is None:
                break
            at, gone = (t[first], ["pe" if first == "ce" else "ce"]) if first else (t["ce"], ["pe", "ce"])
            now = {x: b.close(leg[x], at) for x in gone}
            out += [plain(b.bars[leg[x]], t0[x], at) for x in gone]
            new = {x: b.above(at, end, now[x] + divider) for x in gone}
            if None in new.values():
                for x in gone:
                    leg[x] = None
                exit_t = at
                break
            for x in gone:
                i = 1 if x == "ce" else 2
                leg[x], t0[x] = new[x][i], new[x][0]
                premium += new[x][i + 2] - now[x]
        return out + [plain(b.bars[leg[x]], t0[x], exit_t) for x in leg if leg[x]]

    check(mq.mod_psl_shift(spark, SF), books, q.S_SHIFT, trades, 14.0, 0, whole=False)


def gate(b, p, start):
    """The first minute from start on at which the premium is low enough."""
    lo = max(FIRST, start - p["buffer_minute"])
    seen = {t: x[3] + x[4] for t in sorted(b.fut) if (x := b.pick(t, t))}
    looks = []
    for t in range(lo, start):
        nxt = next((u for u in sorted(seen) if t <= u <= t + 1), None)
        if nxt is not None:
            looks.append(seen[nxt])
    inside = [v for t, v in seen.items() if lo <= t <= start]
    kind = p["std_indicator"].upper()
    level = (min(inside, default=None) if kind == "LOW" else max(inside, default=None) if kind == "HIGH" else sum(looks) / len(looks) if looks else None)
    if level is None:
        return None
    return next((t for t in sorted(seen) if start <= t <= p["end"] - 4 and seen[t] <= level * (1 + p["indicator_buffer"])), None)


def test_gated_ladder(spark, books):  # noqa: F811
    def trades(b, p, start):
        at = gate(b, p, start)
        k = b.pick(at, p["end"]) if at is not None else None
        if k is None:
            return None
        out, cc = [], p["method"] == "CC"
        for s in k[1:3]:
            t, price = decay(b.bars[s], k[0], p["end"], p["side"], p["decay"], cc=cc)
            if t is not None:
                out.append(stop(b.bars[s], t, p["end"], p["side"], p["sl"], cc=cc, entry=None if cc else price, rate=RATE)["points"])
        return out

    check(mq.mod_si_psl(spark, SF), books, mq.S_SI_PSL, trades)



def week_rows(df, sets, columns):
    names, got = [c.split()[0] for c in sets[1].split(", ")], defaultdict(list)
    for r in df.collect():
        got[(r["idx"], r["trade_date"], *(r[n] for n in names))].append(tuple(r[c] for c in columns))
    return names, got


def week_stop(bars, start, end, side, sl, intra=0.0, cc=False, entry=None, combined=False):
    """A stop whose levels fill at the close on a day's opening bar."""
    r = stop(bars, start, end, side, sl, intra=intra, cc=cc, entry=entry, rate=RATE, combined=combined)
    if r["t"] is not None and r["t"] % 1440 == FIRST:
        g = 1 if side == "SELL" else -1
        close = next(b[3] for b in bars if b[0] == r["t"])
        r["pnl"] = cents(g * (r["o"] - close) - r["o"] * RATE)
        r["points"][-1] = r["t"], r["pnl"]
    return r


def same(got, key, want):
    have = got.pop(key, [])
    order = lambda x: tuple("" if v is None else f"{v:012.4f}" if isinstance(v, float) else str(v) for v in x)
    assert len(have) == len(want), (key, have, want)
    for x, y in zip(sorted(have, key=order), sorted(want, key=order), strict=True):
        assert all(u == v or (isinstance(u, float) and u == pytest.approx(v, abs=0.011)) for u, v in zip(x, y, strict=True)), (key, x, y)
    return len(want)


def straddles(w, p):
    """(round, pick, outcome) of a week's straddles."""
    go = p["start"]
    for n in range(8):
        k = w.pick(go, p["end"]) if go is not None else None
        if k is None:
            return
        r = week_stop(w.straddle(k[1], k[2]), k[0], p["end"], p["side"], p["sl"], p["intra_sl"], combined=True)
        yield n, k, r
        go = r["t"] if r["t"] is not None and r["t"] < p["end"] - 5 else None


def test_weekly_straddles(spark, weeks):  # noqa: F811
    names, got = week_rows(mq.mod_weekly_sre(spark, SF), mq.S_WEEK_SRE, ("round", "entry_t", "exit_t", "pnl"))
    names, daily = week_rows(mq.mod_weekly_daywise(spark, SF), mq.S_WEEK_SRE, ("d", "pnl"))
    n = 0
    for (idx, _), days in weeks.items():
        w = Week(days)
        for p in params(mq.S_WEEK_SRE):
            key = (idx, days[0][0], *(p[x] for x in names))
            rounds = list(straddles(w, p))
            n += same(got, key, [(i, k[0], r["t"], r["pnl"]) for i, k, r in rounds])
            by_day = defaultdict(float)
            for _, _, r in rounds:
                before = 0.0
                for d in sorted({t // 1440 for t, _ in r["points"]}):
                    now = [v for t, v in r["points"] if t // 1440 == d][-1]
                    by_day[d] += now - before
                    before = now
            same(daily, key, [(d, round(v, 4)) for d, v in by_day.items()])
    assert n and not got and not daily


def test_weekly_re_entry(spark, weeks):  # noqa: F811
    names, got = week_rows(mq.mod_weekly_nre(spark, SF), mq.S_WEEK_NRE, ("leg", "round", "scrip", "entry_t", "exit_t", "pnl"))
    n = 0
    for (idx, _), days in weeks.items():
        w = Week(days)
        for p in params(mq.S_WEEK_NRE):
            k, cc, want = w.pick(p["start"], p["end"]), p["method"] == "CC", []
            for leg, i in (("ce", 1), ("pe", 2)) if k else ():
                bars = w.bars(k[i])
                r = week_stop(bars, k[0], p["end"], p["side"], p["sl"], cc=cc)
                want.append((leg, 0, k[i], k[0], r["t"], r["pnl"]))
                for j in range(1, 11):
                    at, _ = decay(bars, r["t"], p["end"], p["side"], price=k[i + 2], cc=cc) if r["t"] is not None else (None, None)
                    if at is None:
                        break
                    r = week_stop(bars, at, p["end"], p["side"], p["re_sl"], cc=cc, entry=None if cc else k[i + 2])
                    want.append((leg, j, k[i], at, r["t"], r["pnl"]))
            n += same(got, (idx, days[0][0], *(p[x] for x in names)), want)
    assert n and not got


def test_weekly_b120(spark, weeks):  # noqa: F811
    names, got = week_rows(q.mod_weekly(spark, SF), q.S_WEEK_B120, ("entry_t", "ce_t", "pe_t", "ut_t", "total_pnl"))
    n = 0
    for (idx, _), days in weeks.items():
        w = Week(days)
        for p in params(q.S_WEEK_B120):
            k, cc, want = w.pick(p["start"], p["end"]), p["method"] == "CC", []
            if k:
                bars = {"ce": w.bars(k[1]), "pe": w.bars(k[2])}
                r = {x: week_stop(bars[x], k[0], p["end"], p["side"], p["sl"], cc=cc) for x in bars}
                first = earlier(r["ce"]["t"], r["pe"]["t"])
                total, ut_t = cents(r["ce"]["pnl"] + r["pe"]["pnl"]), None
                if first:
                    o, at = "pe" if first == "ce" else "ce", r[first]["t"]
                    cost, old, held = k[4 if o == "pe" else 3], r[o]["level"], cut(bars[o], at, p["end"])
                    slp = (old if held[0][3] > cost else cost) if p["ut_sl"] == "TTC" and held else None
                    u = stop(bars[o], at, p["end"], p["side"], 0.0 if p["ut_sl"] == "TTC" else float(p["ut_sl"]), slp=slp, cc=cc)
                    if u["o"] is not None:
                        gain = u["pnl"]
                        if u["t"] is not None and u["t"] % 1440 == FIRST:
                            g = 1 if p["side"] == "SELL" else -1
                            gain = cents(g * (u["o"] - next(b[3] for b in bars[o] if b[0] == u["t"])))
                        total, ut_t = cents(r[first]["pnl"] + cost - u["o"] - cost * RATE + gain), u["t"]
                want.append((k[0], r["ce"]["t"], r["pe"]["t"], ut_t, total))
            n += same(got, (idx, days[0][0], *(p[x] for x in names)), want)
    assert n and not got
