"""Strategies without SQL against plain loops, over the whole small tape."""

from collections import defaultdict

import pytest
from loops import Book, cents, cut, decay, earlier, stop, trail, trail_combined

from strikelab import strategy_queries as q
from strikelab.catalog import FIRST, LAST, Market

SF = "/root/testdata/sf0.001"
RATE = 0.01


@pytest.fixture(scope="module")
def books(spark):
    out = defaultdict(Book)
    m = Market(spark, SF)
    for r in m.session_futures.collect():
        out[r["idx"], r["trade_date"]].fut[r["t"]] = (r["high"], r["low"], r["close"])
    for r in m.session.orderBy("t").collect():
        b = out[r["idx"], r["trade_date"]]
        b.bars[r["scrip"]].append((r["t"], r["high"], r["low"], r["close"]))
        if r["t"] in b.fut:
            b.chain[r["t"]][r["strike"], r["opt_type"]] = r["close"]
    return out


def params(sets):
    rows, schema = sets
    names = [c.split()[0] for c in schema.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in rows]


def compare(df, books, sets, loop, columns, keys=None):
    """Rows of df and of loop(book, parameters), which yields tuples of the columns."""
    names = keys or [c.split()[0] for c in sets[1].split(", ")]
    got = defaultdict(list)
    for r in df.collect():
        got[(r["idx"], r["trade_date"], *(r[n] for n in names))].append(tuple(r[c] for c in columns))
    n = 0
    for day, b in books.items():
        for p in params(sets):
            want = list(loop(b, p))
            have = got.pop((*day, *(p[k] for k in names)), [])
            order = lambda x: tuple("" if v is None else f"{v:012.4f}" if isinstance(v, float) else str(v) for v in x)
            assert len(have) == len(want), (day, p, have, want)
            for x, y in zip(sorted(have, key=order), sorted(want, key=order), strict=True):
                assert all(u == v or (isinstance(u, float) and u == pytest.approx(v, abs=0.011)) for u, v in zip(x, y, strict=True)), (day, p, x, y)
            n += len(want)
    assert not got and n


def b120(b, p, start, ut=None, names=("sl",), pick=None):
    """pick, legs' stops, first, at, followed leg, cost, old stop, followed result, total, exit."""
    k = pick or b.pick(start, p["end"], p["om"])
    if k is None:
        return None
    cc = p["method"] == "CC"
    r = {x: stop(b.bars[k[i]], k[0], p["end"], p["side"], p["sl"], cc=cc, rate=RATE) for x, i in (("ce", 1), ("pe", 2))}
    first = earlier(r["ce"]["t"], r["pe"]["t"])
    out = {"pick": k, **r, "first": first, "ut": None, "u": None, "total": cents(r["ce"]["pnl"] + r["pe"]["pnl"]), "exit": r["ce"]["t"] if first is None and r["ce"]["t"] == r["pe"]["t"] else None}
    if first:
        at, i = r[first]["t"], 2 if first == "ce" else 1
        cost, old = k[i + 2], r["pe" if first == "ce" else "ce"]["level"]
        w = cut(b.bars[k[i]], at, p["end"])
        slp = (old if w[0][3] > cost else cost) if p["ut_sl"] == "TTC" and w else None
        u = ut(b.bars[k[i]], at, slp) if ut else stop(b.bars[k[i]], at, p["end"], p["side"], 0.0 if p["ut_sl"] == "TTC" else float(p["ut_sl"]), slp=slp, cc=cc)
        out["at"], out["ut"] = at, k[i]
        if u["o"] is not None and u.get("some", True):
            out["base"] = r[first]["pnl"] + cost - u["o"] - cost * RATE
            out.update(u=u, total=cents(out["base"] + u["pnl"]), exit=u["t"])
    return out


def test_ratio_followed(spark, books):
    def loop(b, p):
        def ut(bars, at, slp):
            r = trail(bars, at, p["end"], "RATIO", p["side"], 0.0 if p["ut_sl"] == "TTC" else float(p["ut_sl"]), slp, p["ut_trail"], cc=p["method"] == "CC", to_cost=p["trail_upto_cost"])
            return r | {"some": len(cut(bars, at, p["end"])) > 1}

        if x := b120(b, p, p["start"], ut):
            yield x["pick"][0], x["u"] and x["u"]["t"], x["total"]

    compare(q.st_b120_ut_trail2(spark, SF), books, q.S_RATIO, loop, ("entry_t", "ut_t", "total_pnl"))


def test_limited_trails(spark, books):
    def limited(bars, at, p, o, k):
        g = 1 if p["side"] == "SELL" else -1
        level, best, n = o * (1 + g * float(p["ut_sl"]) / 100), o * (1 - g * p["tp_trail"] / 100), 0
        for _, h, low, _ in cut(bars, at, p["end"]):
            worst, good = (h, low) if g > 0 else (low, h)
            if g * worst >= g * level:
                return g * (o - level) if n else None
            if n < k and g * good <= g * best:
                n, level, best = n + 1, level * (1 - g * p["sl_trail"] / 100), best * (1 - g * p["tp_trail"] / 100)
                if g * level <= g * best:
                    return None
        return None

    def loop(b, p):
        if x := b120(b, p, p["start"]):
            gains = [limited(b.bars[x["ut"]], x["at"], p, x["u"]["o"], k) if x["u"] else None for k in range(1, 8)]
            yield (x["total"], *(x["total"] if v is None else cents(x["base"] + v) for v in gains))

    compare(q.st_b120_ut_trail(spark, SF), books, q.S_LIMITED, loop, ("total_pnl", *(f"trail_{i}_pnl" for i in range(1, 8))))


def test_no_follow(spark, books):
    def loop(b, p):
        if k := b.pick(p["start"], p["end"]):
            r = [trail(b.bars[s], k[0], p["end"], "RATIO", p["side"], p["sl"], gap=p["trail"], cc=p["method"] == "CC", to_cost=p["trail_upto_cost"], rate=RATE) for s in k[1:3]]
            yield r[0]["t"], r[1]["t"], cents(r[0]["pnl"] + r[1]["pnl"])

    compare(q.st_b120_no_ut(spark, SF), books, q.S_NO_UT, loop, ("ce_t", "pe_t", "total_pnl"))


def test_targets_of_the_followed_leg(spark, books):
    def loop(b, p):
        goal = {}

        def ut(bars, at, slp):
            w = cut(bars, at, p["end"])
            goal["price"] = w[0][3] * (100 - p["ut_target"]) / 100 if w else None
            return stop(bars, at, p["end"], p["side"], float(p["ut_sl"]), target=goal["price"], cc=p["method"] == "CC")

        x = b120(b, p, p["start"], ut)
        if x is None:
            return
        yield 0, x["ut"], x["exit"] if x["u"] else None, x["total"]
        u, far, n = x["u"], x["u"] and x["u"]["level"], 1
        t, on = (u["t"], u["target"]) if u else (None, False)
        while on and t < p["end"] - 5 and n < 5:
            k = b.strangle(t, p["end"], x["u"]["o"])
            if k is None:
                return
            i = 1 if x["first"] == "ce" else 2
            far = k[i + 2] + far - goal["price"]
            r = stop(b.bars[k[i]], k[0], p["end"], p["side"], slp=far, target=goal["price"], cc=p["method"] == "CC")
            yield n, k[i], r["t"], r["pnl"]
            t, on, n = r["t"], r["target"], n + 1

    compare(q.st_b120_re_ut(spark, SF), books, q.S_UT, loop, ("round", "scrip", "exit_t", "pnl"))


def test_step_trail_after_decay(spark, books):
    def loop(b, p):
        if k := b.pick(p["start"], p["end"]):
            total, out = 0.0, []
            for s in k[1:3]:
                t, price = decay(b.bars[s], k[0], p["end"], p["side"], p["decay"], cc=p["method"] == "CC")
                how = {"side": p["side"], "sl": p["sl"], "cc": p["method"] == "CC", "entry": None if p["method"] == "CC" else price, "rate": RATE}
                r = stop(b.bars[s], t, p["end"], **how) if p["trail_sl"] == p["trail_profit"] == 0 else trail(b.bars[s], t, p["end"], "STEP", step=p["trail_profit"], sl_step=p["trail_sl"], **how)
                total, out = total + r["pnl"], [*out, t, r["t"]]
            yield (*out, cents(total))

    compare(q.st_dt_trail(spark, SF), books, q.S_DT_TRAIL, loop, ("ce_entry_t", "ce_t", "pe_entry_t", "pe_t", "total_pnl"))


def test_nre_decay(spark, books):
    def loop(b, p):
        if not (k := b.pick(p["start"], p["end"])):
            return
        cc = p["method"] == "CC"
        for leg, i in (("ce", 1), ("pe", 2)):
            r = trail(b.bars[k[i]], k[0], p["end"], "RATIO", p["side"], p["sl"], gap=p["ratio"], cc=cc, rate=RATE)
            far, t = r["level"], r["t"]
            yield 0, leg, k[i], k[0], t, r["pnl"]
            for n in range(1, 8):
                new = b.above(t, p["end"], far) if t is not None else None
                at, _ = decay(b.bars[new[i]], new[0], p["end"], p["side"], price=k[i + 2], cc=cc) if new else (None, None)
                if at is None:
                    break
                r = trail(b.bars[new[i]], at, p["end"], "RATIO", p["side"], p["sl"], gap=p["ratio"], cc=cc, entry=None if cc else k[i + 2], rate=RATE)
                t = r["t"]
                yield n, leg, new[i], at, t, r["pnl"]

    compare(q.st_nre_dt(spark, SF), books, q.S_NRE_DT, loop, ("round", "leg", "scrip", "entry_t", "exit_t", "pnl"))


def test_nre_trailed(spark, books):
    def loop(b, p):
        if not (k := b.pick(p["start"], p["end"])):
            return
        cc = p["method"] == "CC"
        for leg, i in (("ce", 1), ("pe", 2)):
            s, cost = k[i], k[i + 2]
            r = stop(b.bars[s], k[0], p["end"], p["side"], p["sl"], cc=cc, rate=RATE)
            t = r["t"]
            yield 0, leg, s, k[0], t, r["pnl"]
            for n in range(1, 8):
                if t is None:
                    break
                if cost <= b.close(s, t):
                    at, _ = decay(b.bars[s], t, p["end"], p["side"], price=cost, cc=cc)
                else:
                    new = b.strangle(t, p["end"], cost)
                    at, s, cost = (new[0], new[i], new[i + 2]) if new else (None, s, cost)
                if at is None:
                    break
                how = {"side": p["side"], "sl": p["re_sl"], "cc": cc, "entry": None if cc else cost, "rate": RATE}
                t = stop(b.bars[s], at, p["end"], **how)["t"]
                yield n, leg, s, at, t, trail(b.bars[s], at, p["end"], "RATIO", gap=p["trail"], to_cost=p["trail_upto_cost"], **how)["pnl"]

    compare(q.st_nre_cc_trail(spark, SF), books, q.S_CC_TRAIL, loop, ("round", "leg", "scrip", "entry_t", "exit_t", "pnl"))


def test_sell_buy_sell(spark, books):
    def trade(b, p, s, t, kind, track):
        how = {"side": "SELL" if kind == "sell" else "BUY", "sl": p[f"{kind}_sl"], "rate": RATE}
        plain = stop(b.bars[s], t, p["end"], **how)
        r = trail(b.bars[s], t, p["end"], "STEP", step=p[f"{kind}_trail"], sl_step=p[f"{kind}_sl_trail"], **how) if p[f"{kind}_sl_trail"] else plain
        return r["t"], plain["t"] if track else r["t"], r["pnl"]

    def loop(b, p):
        if not (k := b.pick(p["start"], p["end"])):
            return
        for leg, i in (("ce", 1), ("pe", 2)):
            t, nxt, gain = trade(b, p, k[i], k[0], "sell", p["sell_track_original"])
            yield 0, leg, k[i], k[0], t, gain
            for n, kind, track, on in ((1, "buy", p["buy_track_original"], p["buy_flag"]), (2, "sell", False, p["sell2_flag"])):
                new = b.pick(nxt, p["end"]) if nxt is not None and on else None
                if new is None:
                    break
                t, nxt, gain = trade(b, p, new[i], new[0], kind, track)
                yield n, leg, new[i], new[0], t, gain

    compare(q.st_sbs(spark, SF), books, q.S_SBS, loop, ("round", "leg", "scrip", "entry_t", "exit_t", "pnl"))


def test_combined_trail(spark, books):
    how = {"RATIO": {"gap": 0.5}, "POINT": {}, "PCT": {}, "STEP": {"step": 3.0, "sl_step": 2.0}}
    n = 0
    for r in q.trail_combined(spark, SF).collect():
        b = books[r["idx"], r["trade_date"]]
        k = int(r["strike"])
        want = trail_combined(b.straddle(f"{k}CE", f"{k}PE"), 565, 900, r["rule"], r["side"], 6.0, 9.0, rate=RATE, **how[r["rule"]])
        assert want is None and r["t"] is None and r["pnl"] == 0 or (r["t"], r["pnl"]) == (want[0], pytest.approx(want[1], abs=0.011)), r
        n += want is not None
    assert n > 1000


def test_queue(spark, books):
    rows = sorted(q.QUEUE)

    def loop(trim):
        def run(day, p):
            b, live, n, total = books[day], [], 0, 0.0
            mine = [r for r in rows if r[0] == day[0]]
            for j, (_, g, _, start, om, sl, ut) in enumerate(mine):
                if len(live) < p["lots"]:
                    k = b.pick(start, start, om)
                    if k and k[0] == start:
                        x = b120(b, {"end": p["end"], "side": p["side"], "method": p["method"], "sl": sl, "ut_sl": ut, "om": om}, start, pick=k)
                        live.append(x["exit"])
                        n, total = n + 1, total + x["total"]
                if trim == "row" or j + 1 == len(mine) or mine[j + 1][1] != g:
                    live = [t for t in live if t is None or t >= start]
            return n, total

        return run

    got = q.st_b120_queue(spark, SF).collect()
    assert len(got) == 2 * 2 * len(books)
    for r in got:
        n, total = loop(r["rule"])((r["idx"], r["trade_date"]), r.asDict())
        assert r["n"] == n and r["total_pnl"] == pytest.approx(total, abs=0.02 * (n + 1)), r


def shifted(b, p, ending, closing_by, most=20, with_exit=False):
    """One shift by the rules; (rolls, ce, pe, total) or None. with_exit: and when it ended (None: both legs went at once)."""
    k = b.pick(p["start"], p["end"], p["om"])
    if k is None:
        return None
    end, cc, side = p["end"], p["method"] == "CC", p["side"]
    t0 = {"ce": k[0], "pe": k[0]}
    leg, price = {"ce": k[1], "pe": k[2]}, {"ce": k[3], "pe": k[4]}
    premium, gained, rolls, check, exit_t, own = k[3] + k[4], 0.0, 0, False, end, None
    strike = lambda x: float(x[:-2])
    action, move, nothing = p.get("action"), 0.0, False
    for n in range(most + 1):
        divider = premium / 2 if "trail" in p else premium * p["divider"] / 100
        move, start = premium * p["movement"] / 100, max(t0.values())
        t = {x: stop(b.common(leg[x], leg[y]), start, end, side, slp=move, cc=cc)["t"] for x, y in (("ce", "pe"), ("pe", "ce"))}
        if "trail" in p:
            goal = (premium - max(0, strike(leg["pe"]) - strike(leg["ce"]))) * (100 - p["trail"]) / 100
            hit = stop(b.straddle(leg["ce"], leg["pe"]), start, end, side, target=goal, combined=True)
            if hit["t"] is not None and hit["t"] < min(x if x is not None else end + 10 for x in t.values()):
                exit_t = hit["t"]
                break
        first = earlier(t["ce"], t["pe"])
        both = first is None and t["ce"] is not None
        if first is None and not both:
            break
        at = t["ce"] if both else t[first]
        now = {x: b.close(leg[x], at) for x in leg}
        gain = lambda x: cents(price[x] - now[x] - price[x] * RATE)
        gone = ["pe", "ce"] if both else ["pe" if first == "ce" else "ce"]
        new = {x: b.above(at, end, now[x] + divider) for x in gone}
        index = {"ce": 1, "pe": 2}
        if closing_by == "separate" and not both:
            x = gone[0]
            wide = new[x] and (strike(new[x][2]) if x == "pe" else strike(leg["pe"])) - (strike(new[x][1]) if x == "ce" else strike(leg["ce"])) > premium - now[x] + new[x][index[x] + 2]
            if new[x] is None or wide:
                check, own = True, t
                break
        gained += sum(gain(x) for x in gone)
        full = action is not None and rolls == action
        if full or None in new.values():
            for x in gone:
                leg[x] = None
            exit_t = at
            nothing = both
            break
        found = {x: (new[x][index[x]], new[x][index[x] + 2], new[x][0]) for x in gone}
        crossed = strike(found.get("pe", (leg["pe"],))[0]) - strike(found.get("ce", (leg["ce"],))[0])
        after = premium + sum(found[x][1] - now[x] for x in gone)
        if ending == "premium" and crossed > after:
            for x in gone:
                leg[x] = None
            rolls += not both
            exit_t = at
            break
        if ending in ("straddle", "nstraddle") and crossed >= 0 and not (both and crossed == 0):
            x = gone[0]
            if ending == "straddle" and not both:
                same = f"{int(strike(leg['ce' if x == 'pe' else 'pe']))}{x.upper()}"
                bar = next((y for y in b.bars[same] if y[0] >= at), None)
                if bar is None:
                    leg[x], exit_t = None, at
                    break
                premium += bar[3] - now[x]
                leg[x], price[x], t0[x], check, rolls = same, bar[3], bar[0], True, rolls + 1
                break
            if crossed > 0:
                if not both:
                    gained += gain("ce" if x == "pe" else "pe")
                z = b.pick(at, end, "0")
                if z is None:
                    leg = {"ce": None, "pe": None}
                    nothing = True
                    break
                premium += z[3] + z[4] - now["ce"] - now["pe"]
                leg, price, t0, check, rolls = {"ce": z[1], "pe": z[2]}, {"ce": z[3], "pe": z[4]}, {"ce": z[0], "pe": z[0]}, True, rolls + 1
                break
        for x in gone:
            leg[x], price[x], t0[x] = found[x]
        premium, rolls = after, rolls + 1
        if ending in ("straddle", "nstraddle") and crossed == 0:
            check = True
            break
    ends, over = {}, None if nothing else exit_t
    if check and closing_by != "separate":
        move, start = premium * p["movement"] / 100, max(t0.values())
        r = {x: stop(b.bars[leg[x]], start, end, side, slp=move, cc=cc, entry=price[x], rate=RATE) for x in leg}
        when = {x: r[x]["t"] if r[x]["t"] is not None else end for x in r}
        first = earlier(when["ce"], when["pe"])
        over = min(when.values())
        for x, y in (("ce", "pe"), ("pe", "ce")):
            ends[x] = cents(price[x] - b.upto(leg[x], when[x]) - price[x] * RATE)
            if closing_by in ("both", "price"):
                ends[x] = r[x]["pnl"]
            if closing_by == "both" and first == y:
                ends[x] = cents(price[x] - b.upto(leg[x], when[y]) - price[x] * RATE)
            if closing_by == "ut":
                ends[x] = 0.0
                if first == y:
                    cost = b.close(leg[x], when[y])
                    ends[x] = None if cost is None else cents(cost - (b.upto(leg[x], end) if when[x] == end else move) - cost * RATE)
    else:
        for x in leg:
            at = exit_t if own is None else own[x] if own[x] is not None else end
            last = move if closing_by == "price" and exit_t != end else None if leg[x] is None else b.upto(leg[x], at)
            ends[x] = 0.0 if leg[x] is None or closing_by == "ut" else cents(price[x] - last - price[x] * RATE)
    return *((over,) if with_exit else ()), rolls, leg["ce"], leg["pe"], None if None in ends.values() else cents((0.0 if closing_by == "ut" else gained) + ends["ce"] + ends["pe"])


SHIFT_COLUMNS = ("rolls", "ce", "pe", "total_pnl")


@pytest.mark.parametrize("name,sets,ending,closing_by", [("st_shift", q.S_SHIFT, "none", "close"), ("st_shift_trail", q.S_SHIFT_TRAIL, "premium", "close"), ("st_shift_action", q.S_SHIFT_ACTION, "premium", "close")])
def test_shift(spark, books, name, sets, ending, closing_by):
    compare(getattr(q, name)(spark, SF), books, sets, lambda b, p: filter(None, [shifted(b, p, ending, closing_by)]), SHIFT_COLUMNS)


@pytest.mark.parametrize("name,rules", [("st_shift_stop", {x: (x, "close") for x in ("premium", "straddle", "nstraddle")}), ("st_shift_exit", {"price": ("premium", "price"), "both": ("straddle", "both"), "separate": ("premium", "separate"), "ut": ("straddle", "ut")})])
def test_shift_rules(spark, books, name, rules):
    df = getattr(q, name)(spark, SF).cache()
    for rule, (ending, closing_by) in rules.items():
        compare(df.where(df["rule"] == rule), books, q.S_SHIFT, lambda b, p: filter(None, [shifted(b, p, ending, closing_by)]), SHIFT_COLUMNS)  # noqa: B023


def test_shift_once_more(spark, books):
    def loop(b, p):
        one = shifted(b, p, "straddle", "both", with_exit=True)
        if one:
            again = one[0] is not None and one[0] + 6 < p["end"] and shifted(b, p | {"start": one[0] + 1}, "straddle", "close")
            two = again[-1] if again else 0.0
            yield one[-1], two, cents(one[-1] + two)

    compare(q.st_shift_re(spark, SF), books, q.S_SHIFT, loop, ("pnl1", "pnl2", "total_pnl"))


def test_stops_of_the_outer_legs(spark, books):
    def loop(b, p):
        held, minutes, go, n, cc = [], None, p["start"], 0, p["method"] == "CC"
        while True:
            k = b.pick(go, p["end"])
            if k is None:
                out, hit = go, False
                break
            held.append(k)
            here = {x[0] for x in b.straddle(k[1], k[2]) if k[0] <= x[0] <= p["end"]}
            minutes = here if minutes is None else minutes & here
            strike = lambda i: lambda x: float(x[i][:-2])
            hi = max((x for x in held if strike(1)(x) == max(map(strike(1), held))), key=lambda x: x[0])
            lo = max((x for x in held if strike(2)(x) == min(map(strike(2), held))), key=lambda x: x[0])
            ends = [stop([x for x in b.bars[h[i]] if x[0] in minutes], h[0], p["end"], p["side"], p["sl"], cc=cc, entry=h[i + 2])["t"] for h, i in ((hi, 1), (lo, 2))]
            out = min(p["end"] if t is None else t for t in ends)
            if n >= p["re_entries"] or out >= p["end"] - 5:
                hit = out != p["end"]
                break
            go, n = out, n + 1
        for i, x in enumerate(held):
            yield i, x[0], x[1], x[2], hit, out, stop(b.straddle(x[1], x[2]), held[0][0], out, "SELL", combined=True, rate=RATE)["pnl"]

    compare(q.st_csre_hclp(spark, SF), books, q.S_EXTREMES, loop, ("round", "entry_t", "ce", "pe", "sl_hit", "exit_t", "pnl"))
