"""The butterfly and a week's shift to straddles against plain loops, over the whole small tape."""

from collections import defaultdict

import pytest
from loops import cents, cut, earlier, near, stop
from test_strategy_loops import RATE, SF, books, compare, params  # noqa: F401
from test_week_loops import Week, weeks  # noqa: F401

from strikelab import spread_queries as q
from strikelab.catalog import FIRST, LAST, Market

GAP = 50.0


def test_butterfly(spark, books):  # noqa: F811
    spot = defaultdict(dict)
    for r in Market(spark, SF).spot.collect():
        if FIRST <= r["t"] <= LAST:
            spot[r["idx"], r["trade_date"]][r["t"]] = (r["high"], r["low"], r["close"])
    before = {}
    for idx in ("IDX0", "IDX1"):
        days = sorted(d for i, d in spot if i == idx)
        before |= {(idx, b): (idx, a) for a, b in zip(days, days[1:], strict=False)}

    def loop(b, p):
        day = next(d for d, x in books.items() if x is b)
        k = None
        for t in sorted(b.fut):
            s = near(b.fut[t][2], GAP)
            if p["start"] <= t <= p["end"] and (s, "CE") in b.chain[t] and (s, "PE") in b.chain[t]:
                k = t, s, b.chain[t][s, "CE"] + b.chain[t][s, "PE"]
                break
        if k is None or day not in before or k[0] not in spot[day]:
            return
        bars = spot[before[day]]
        h, low, c = max(x[0] for x in bars.values()), min(x[1] for x in bars.values()), bars[max(bars)][2]
        pp = (h + low + c) / 3
        up, down = [2 * pp - low, pp + h - low, h + 2 * (pp - low)], [2 * pp - h, pp - (h - low), low - 2 * (h - pp)]
        for x in (up, down):
            x.append(x[2] + x[1] - x[0])
            x.append(x[3] + x[2] - x[1])
        levels = [cents(x) for x in (*down[::-1], pp, *up)]
        now, wing = spot[day][k[0]][2], max(near(k[2] * p["width"] / 100, GAP), GAP)
        if now > levels[10] or now < levels[0] or now == levels[5]:
            return
        puts = now < levels[5]
        behind = [x for x in levels if x > now][1:2] if puts else [x for x in levels if x < now][-2:-1]
        if not behind:
            return
        body = (k[1] if wing == GAP else k[1] + GAP) - wing if puts else k[1] + wing
        out = p["end"]
        for t in sorted(spot[day]):
            c = spot[day][t][2]
            if k[0] < t < p["end"] and ((c < body or c > behind[0]) if puts else (c > body or c < behind[0])):
                out = t
                break
        kind, m = ("PE", 1) if puts else ("CE", -1)
        gains = [stop(b.bars[f"{int(body + i * wing)}{kind}"], k[0], out, side, rate=RATE)["pnl"] for i, side in ((m, "BUY"), (0, "SELL"), (-m, "BUY"))]
        yield k[0], kind, wing, behind[0], out, gains[1], cents(gains[0] + 2 * gains[1] + gains[2])

    compare(q.st_butterfly(spark, SF), books, q.S_BUTTERFLY, loop, ("entry_t", "kind", "wing", "stop", "exit_t", "body_pnl", "total_pnl"))


def shifted(w, p):
    """entry_t, rolls, straddles, total of a week; None for no row."""
    k = w.pick(p["start"], p["end"], p["om"])
    if k is None:
        return None
    end, cc, strike = p["end"], p["method"] == "CC", lambda x: float(x[:-2])
    common = lambda a, b: [x for x in w.bars(a) if x[0] in {y[0] for y in w.bars(b)}]
    close = lambda s, t: next(b[3] for b in w.bars(s) if b[0] == t)
    upto = lambda s, t: [b[3] for b in w.bars(s) if b[0] <= t][-1]
    hits = lambda ce, pe, start, move: tuple(stop(common(a, b), start, end, p["side"], slp=move, cc=cc)["t"] for a, b in ((ce, pe), (pe, ce)))
    gain = lambda cost, now: cents(cost - now - cost * RATE)

    def above(t, target):
        for u in sorted(w.futures()):
            if t <= u <= end and (a := w.days[u // 1440][1].above(u % 1440, u % 1440, target)):
                return u, *a[1:]
        return None

    total, rolls, go = 0.0, 0, None
    if strike(k[1]) <= strike(k[2]):
        go = p["start"]
    else:
        leg, price, t0, premium = {"ce": k[1], "pe": k[2]}, {"ce": k[3], "pe": k[4]}, {"ce": k[0], "pe": k[0]}, k[3] + k[4]
        for _ in range(21):
            a, b = hits(leg["ce"], leg["pe"], max(t0.values()), premium * p["movement1"] / 100)
            first = earlier(a, b)
            if first is None and a is None:
                total += sum(gain(price[x], upto(leg[x], end + 10)) for x in leg)
                break
            gone, at = (["pe" if first == "ce" else "ce"], a if first == "ce" else b) if first else (["pe", "ce"], a)
            now, divider = {x: close(leg[x], at) for x in leg}, premium * p["divider"] / 100
            total += sum(gain(price[x], now[x]) for x in gone)
            new = {x: above(at, now[x] + divider) for x in gone}
            if None in new.values():
                if first:
                    other = "ce" if gone == ["pe"] else "pe"
                    total += gain(price[other], upto(leg[other], at))
                break
            i = {"ce": 1, "pe": 2}
            after = {x: new[x][i[x]] if x in new else leg[x] for x in leg}
            rolls += 1
            if strike(after["ce"]) <= strike(after["pe"]):
                total += sum(gain(price[x], now[x]) for x in leg if x not in gone)
                go = at
                break
            for x in gone:
                premium += new[x][i[x] + 2] - now[x]
                leg[x], price[x], t0[x] = after[x], new[x][i[x] + 2], new[x][0]
    n = 0
    while go is not None and n < 21:
        s = w.pick(go, end)
        if s is None:
            return None
        a, b = hits(s[1], s[2], s[0], (s[3] + s[4]) * p["movement2"] / 100)
        at = min((x for x in (a, b) if x is not None), default=None)
        total += sum(gain(s[j + 2], close(s[j], at) if at is not None else upto(s[j], end + 10)) for j in (1, 2))
        go, n = at, n + 1
    return k[0], rolls, n, cents(total)


def test_shift_to_straddles(spark, weeks):  # noqa: F811
    names, got = [c.split()[0] for c in q.S_PS_WEEK[1].split(", ")], {}
    for r in q.st_ps_w_straddle(spark, SF).collect():
        got[(r["idx"], r["trade_date"], *(r[n] for n in names))] = (r["entry_t"], r["rolls"], r["straddles"], r["total_pnl"])
    n = both = 0
    for (idx, _), days in weeks.items():
        w = Week(days)
        for p in params(q.S_PS_WEEK):
            want, have = shifted(w, p), got.pop((idx, days[0][0], *(p[x] for x in names)), None)
            assert (want is None) == (have is None), (idx, p, want, have)
            if want:
                assert have[:3] == want[:3] and have[3] == pytest.approx(want[3], abs=0.02 * (1 + want[1] + want[2])), (idx, p, want, have)
                n, both = n + 1, both + (want[1] > 0 and want[2] > 0)
    assert not got and n > 20 and both
