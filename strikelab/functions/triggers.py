"""First-hit triggers as column expressions over one leg's bars of the session.

A leg is one row with `bars`: an array of (t, high, low, close) in order of t, no longer than a session. A trigger slices
it, finds the first bar that hits and prices the exit, so that no bar is ever exploded or shuffled. What an expression
needs more than once is bound to a name by `let`, so that it is computed once a row wherever the optimiser puts it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import money, ticked

BARS = "array<struct<t:int,high:double,low:double,close:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def rest(array: Column) -> Column:
    """All but the first; null if array is null."""
    return F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(0)))


def lit(x: Column | float | str | bool | None, kind: str = "double") -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast(kind)


def legs(options: DataFrame) -> DataFrame:
    """idx, trade_date, scrip, bars. Of several bars of one minute the one with the greatest (high, low, close) stays."""
    one = options.groupBy("idx", "trade_date", "scrip", "t").agg(F.max(F.struct("high", "low", "close")).alias("b"))
    bar = F.struct(F.col("t").cast("int").alias("t"), F.col("b.high").alias("high"), F.col("b.low").alias("low"), F.col("b.close").alias("close"))
    return one.groupBy("idx", "trade_date", "scrip").agg(F.sort_array(F.collect_list(bar)).alias("bars"))


def all_legs(legs: list[Column], join: Callable[..., Column]) -> Column:
    """join(a bar of each leg) for each minute that all legs have. Their bars may be of different kinds: all lie in one sorted array with
    a field for each leg, so a minute's bars are neighbours."""

    def tag(bars: Column, k: int) -> Column:
        return F.transform(bars, lambda x: F.struct(x["t"].alias("t"), F.lit(k).alias("k"), *((x if i == k else F.lit(None)).alias(f"x{i}") for i in range(len(legs)))))

    def near(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.struct(*((x if k == 0 else F.get(s, i + k)).alias(f"y{k}") for k in range(len(legs)))))

    def met(p: Column) -> Column:
        here = [(p["y0"]["k"] == 0), *(p[f"y{k}"]["k"] == k for k in range(1, len(legs))), *(p[f"y{k}"]["t"] == p["y0"]["t"] for k in range(1, len(legs)))]
        return F.coalesce(reduce(lambda a, b: a & b, here), F.lit(False))

    rows = F.filter(let(F.array_sort(F.concat(*(tag(x, k) for k, x in enumerate(legs)))), near), met)
    return F.transform(rows, lambda p: join(*(p[f"y{k}"][f"x{k}"] for k in range(len(legs)))))


def both_legs(a: Column, b: Column, join: Callable[[Column, Column], Column]) -> Column:
    """join(bar of a, bar of b) for each minute that both have."""
    return all_legs([a, b], join)


def straddle_bars(ce: Column, pe: Column) -> Column:
    """Both legs on the minutes that both have: close is the sum, high and low the cross sums of the extremes."""
    sums = lambda a, b: (a["high"] + b["low"], a["low"] + b["high"], a["close"] + b["close"])
    return both_legs(ce, pe, lambda a, b: F.struct(a["t"].alias("t"), F.greatest(*sums(a, b)).alias("high"), F.least(*sums(a, b)).alias("low"), sums(a, b)[2].alias("close")))


def common(bars: Column, other: Column) -> Column:
    """The bars on the minutes that other has too."""
    return both_legs(bars, other, lambda a, b: a)


def window(bars: Column, start: Column, end: Column) -> Column:
    """The bars from start to end, both included; none if either is null."""
    return F.filter(bars, lambda b: F.coalesce((b["t"] >= start) & (b["t"] <= end), F.lit(False)))


def close_at(bars: Column, at: Column) -> Column:
    """The close of that minute's bar; null without one."""
    return first(F.filter(bars, lambda b: b["t"] == at))["close"]


def close_before(bars: Column, at: Column) -> Column:
    """The last close up to that minute."""
    return last(F.filter(bars, lambda b: b["t"] <= at))["close"]


def signs(side: Column) -> Column:
    """1 for SELL, -1 for BUY: prices times it rise against the trade."""
    return F.when(side == "SELL", 1.0).otherwise(-1.0)


def stop(
    bars: Column, start: Column, end: Column, *, side: Column, sl: Column | float = 0.0, intra: Column | float = 0.0, sl_price: Column | None = None, target: Column | None = None, closes: Column | bool = False,
    combined: bool = False, rate: Column | float = 0.0, entry: Column | None = None, opens: Callable[[Column], Column] | None = None, tick: Column | None = None,
) -> Column:
    """A struct (o, h, l, c, sl_price, sl_hit, intra_hit, target_hit, t, exit, pnl): the outcome of a stop.

    The entry price o is the close of the first bar unless given; that bar is not tested. The first later bar that meets
    the intra stop, the stop or the target ends the trade, in that order of precedence within the bar; otherwise it ends
    at the last close with t null. Intra stops and targets fill at their level. A stop is met by the extreme and fills at
    its level, or by the close and fills there (closes); combined legs always test stop and target on the close. A level
    of 0 is off. Without a bar after the entry, the struct's pnl is 0 and the rest null. rate: slippage as a share of o.
    opens: says of a bar whether it opens a session, where stops fill at the close. tick: levels are whole ticks (null: as they
    are), stops away from the trade, targets further along.
    """
    closes = F.lit(True) if combined else lit(closes, "boolean")
    sl, intra, target = lit(sl), lit(intra), lit(target)

    def judged(w: Column, o: Column, g: Column) -> Column:
        level = lambda pct: F.when(pct > 0, (100 + g * pct) / 100 * o)
        levels = F.struct(ticked(level(sl) if sl_price is None else F.coalesce(sl_price, level(sl)), tick, g > 0).alias("sl"), ticked(level(intra), tick, g > 0).alias("intra"), ticked(target, tick, g < 0).alias("target"))
        return let(levels, lambda v: let(rest(w), lambda r: ended(r, o, g, v)))

    def ended(r: Column, o: Column, g: Column, v: Column) -> Column:
        against = lambda x: F.when(g > 0, x["high"]).otherwise(x["low"])
        along = lambda x: x["close"] if combined else F.when(g > 0, x["low"]).otherwise(x["high"])
        met = lambda test: F.coalesce(test, F.lit(False))
        intra_hit = lambda x: met(g * against(x) >= g * v["intra"])
        sl_hit = lambda x: met(g * F.when(closes, x["close"]).otherwise(against(x)) >= g * v["sl"])
        target_hit = lambda x: met(g * along(x) <= g * v["target"])
        hit = first(F.filter(r, lambda x: intra_hit(x) | sl_hit(x) | target_hit(x)))
        return let(hit, lambda x: outcome(r, o, g, v, x, x.isNotNull() & intra_hit(x), x.isNotNull() & sl_hit(x), x.isNotNull() & target_hit(x)))

    def outcome(r: Column, o: Column, g: Column, v: Column, x: Column, i: Column, s: Column, t: Column) -> Column:
        at = lambda level: level if opens is None else F.when(opens(x), x["close"]).otherwise(level)
        price = F.when(i, at(v["intra"])).when(s, F.when(closes, x["close"]).otherwise(at(v["sl"]))).when(t, x["close"] if combined else v["target"]).otherwise(last(r)["close"])
        some = F.coalesce(F.size(r) > 0, F.lit(False)) & o.isNotNull()
        shown = lambda c: F.when(some, c)
        return F.struct(
            shown(o).alias("o"), shown(F.array_max(F.transform(r, lambda y: y["high"]))).alias("h"), shown(F.array_min(F.transform(r, lambda y: y["low"]))).alias("l"), shown(last(r)["close"]).alias("c"),
            shown(v["sl"]).alias("sl_price"), (some & (i | s)).alias("sl_hit"), (some & i).alias("intra_hit"), (some & ~i & ~s & t).alias("target_hit"),
            shown(x["t"]).alias("t"), shown(price).alias("exit"), F.when(some, money(g * (o - price) - o * lit(rate))).otherwise(F.lit(0.0)).alias("pnl"),
        )

    return let(window(bars, start, end), lambda w: let(F.coalesce(entry, first(w)["close"]) if entry is not None else first(w)["close"], lambda o: let(signs(side), lambda g: judged(w, o, g))))


def decay(bars: Column, start: Column, end: Column, *, side: Column, percent: Column | None = None, price: Column | None = None, closes: Column | bool = False, tick: Column | None = None) -> Column:
    """A struct (o, price, hit, t): the first bar after the entry whose premium has fallen (SELL) or risen (BUY) to the level.

    The level is price, or `percent` away from the first close o. percent 0 or price -1: at once, at start; a slice of one
    bar never hits. tick: as in stop, a decay as a target.
    """
    closes, percent, price = lit(closes, "boolean"), lit(percent), lit(price)

    def judged(w: Column, g: Column) -> Column:
        o = first(w)["close"]
        now = F.coalesce(price == -1, F.lit(False)) | F.coalesce(percent == 0, F.lit(False))
        return let(F.struct(o.alias("o"), now.alias("now"), F.when(now, o).otherwise(ticked(F.coalesce(price, (100 - g * percent) / 100 * o), tick, g < 0)).alias("price")), lambda v: found(w, g, v))

    def found(w: Column, g: Column, v: Column) -> Column:
        along = lambda b: F.when(closes, b["close"]).when(g > 0, b["low"]).otherwise(b["high"])
        hit = first(F.filter(rest(w), lambda b: F.coalesce(g * along(b) <= g * v["price"], F.lit(False))))["t"]
        t = F.when(F.size(w) >= 2, F.when(v["now"], start).otherwise(hit)).cast("int")
        return F.struct(v["o"].alias("o"), v["price"].alias("price"), t.isNotNull().alias("hit"), t.alias("t"))

    return let(window(bars, start, end), lambda w: let(signs(side), lambda g: judged(w, g)))


def trail(
    bars: Column, start: Column, end: Column, *, mode: str, side: Column, sl: Column | float = 0.0, sl_price: Column | None = None, gap: Column | float = 1.0, step: Column | float = 0.0, sl_step: Column | float = 0.0,
    closes: Column | bool = False, to_cost: Column | bool = False, rate: Column | float = 0.0, entry: Column | None = None, tick: Column | None = None,
) -> Column:
    """A struct (o, stop, moved, hit, t, exit, pnl, status) of a trailed stop; mode RATIO, POINT, PCT or STEP.

    A fold over the bars after the entry. RATIO: the stop moves by `gap` of the best profit. POINT: it stays the first
    risk away from the best price. PCT: it stays `sl` percent away. STEP: each time the trigger, `step` percent away, is
    reached (once a bar at most), the stop moves by `sl_step` percent and the trigger by `step` percent. to_cost: the stop
    never passes the entry price. In RATIO and STEP the trade ends if the stop reaches the best price or the trigger.
    STEP with step <= 0, sl_step <= 0 or sl_step > step: pnl 0, status `invalid_trail`. tick: as in stop, for each new stop
    and trigger.
    """
    closes, to_cost, sl, gap, step, sl_step = lit(closes, "boolean"), lit(to_cost, "boolean"), lit(sl), lit(gap), lit(step), lit(sl_step)
    none_t, none_p = F.lit(None).cast("int"), F.lit(None).cast("double")
    state = lambda stop, best, moved, t, price: F.struct(stop.cast("double").alias("stop"), best.cast("double").alias("best"), moved.alias("moved"), t.cast("int").alias("t"), price.cast("double").alias("price"))

    def folded(w: Column, o: Column, g: Column, first_stop: Column) -> Column:
        against = lambda b: F.when(closes, b["close"]).when(g > 0, b["high"]).otherwise(b["low"])
        along = lambda b: F.when(closes, b["close"]).when(g > 0, b["low"]).otherwise(b["high"])
        cap = lambda x: F.when(to_cost, g * F.greatest(g * x, g * o)).otherwise(x)
        far = lambda x: ticked(x, tick, g > 0)

        def moved(s: Column, b: Column) -> Column:
            if mode == "STEP":
                stop2, best2, next_ = far(cap(s["stop"] * (1 - g * sl_step / 100))), s["best"], ticked(s["best"] * (1 - g * step / 100), tick, g < 0)
            else:
                best2 = next_ = along(b)
                stop2 = far(cap({"RATIO": first_stop - g * F.abs(o - best2) * gap, "POINT": best2 + (first_stop - o), "PCT": best2 * (1 + g * sl / 100)}[mode]))
            going = state(stop2, next_, F.lit(True), none_t, none_p)
            if mode in ("POINT", "PCT"):
                return going
            return F.when(g * stop2 <= g * best2, state(stop2, best2, F.lit(True), b["t"], F.when(closes, b["close"]).otherwise(best2))).otherwise(going)

        def fold(s: Column, b: Column) -> Column:
            hit = g * against(b) >= g * s["stop"]
            further = g * along(b) <= g * s["best"] if mode == "STEP" else g * along(b) < g * s["best"]
            return F.when(s["t"].isNotNull(), s).when(hit, state(s["stop"], s["best"], s["moved"], b["t"], F.when(closes, b["close"]).otherwise(s["stop"]))).when(further, moved(s, b)).otherwise(s)

        start_best = ticked((100 - g * step) / 100 * o, tick, g < 0) if mode == "STEP" else o
        return let(rest(w), lambda r: let(F.aggregate(r, state(first_stop, start_best, F.lit(False), none_t, none_p), fold), lambda s: outcome(r, o, g, s)))

    def outcome(r: Column, o: Column, g: Column, s: Column) -> Column:
        price = F.coalesce(s["price"], last(r)["close"])
        ok = (step > 0) & (sl_step > 0) & (sl_step <= step) if mode == "STEP" else F.lit(True)
        some = ok & F.coalesce(F.size(r) > 0, F.lit(False))
        pnl = money(g * (o - price) - o * lit(rate))
        return F.struct(o.alias("o"), F.when(some, s["stop"]).alias("stop"), (some & s["moved"]).alias("moved"), (some & s["t"].isNotNull()).alias("hit"), F.when(some, s["t"]).alias("t"), F.when(some, price).alias("exit"), F.when(some, pnl).otherwise(0.0).alias("pnl"), F.when(ok, "ok").otherwise("invalid_trail").alias("status"))

    def started(w: Column, o: Column, g: Column) -> Column:
        level = (100 + g * sl) / 100 * o
        return let(ticked(level if sl_price is None else F.coalesce(sl_price, level), tick, g > 0), lambda f: folded(w, o, g, f))

    return let(window(bars, start, end), lambda w: let(first(w)["close"] if entry is None else F.coalesce(entry, first(w)["close"]), lambda o: let(signs(side), lambda g: started(w, o, g))))


def trail_combined(bars: Column, start: Column, end: Column, *, mode: str, side: Column, sl: Column | float, intra: Column | float = 0.0, gap: Column | float = 1.0, step: Column | float = 0.0, sl_step: Column | float = 0.0, to_cost: Column | bool = False, rate: Column | float = 0.0) -> Column:
    """A struct (o, stop, intra, moved, hit, intra_hit, t, exit, pnl, status) of a straddle's two trailed stops.

    bars: the straddle's. The stop is tested on the close and fills there, the intra stop on the extreme and fills at its
    level, before it; 0 turns either off. The best price is that of the close. Modes as in `trail`, for both stops; where
    a moved stop reaches the best price (RATIO) the trade ends at that stop, the intra stop first; in STEP a trigger is
    reached by the close for the stop, by the extreme for the intra stop, and a stop that reaches it ends the trade there.
    """
    to_cost, sl, intra, gap, step, sl_step = lit(to_cost, "boolean"), lit(sl), lit(intra), lit(gap), lit(step), lit(sl_step)
    none_t, none_p, no = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(False)
    off = lambda c: F.coalesce(c, no)

    def state(stop, far, best, moved, t, price, inner):
        return F.struct(stop.cast("double").alias("stop"), far.cast("double").alias("far"), best.cast("double").alias("best"), moved.alias("moved"), t.cast("int").alias("t"), price.cast("double").alias("price"), inner.alias("inner"))

    def folded(w: Column, o: Column, g: Column) -> Column:
        level = lambda pct: F.when(pct > 0, (100 + g * pct) / 100 * o)
        cap = lambda x: F.when(to_cost, g * F.greatest(g * x, g * o)).otherwise(x)
        worst = lambda b: F.when(g > 0, b["high"]).otherwise(b["low"])
        finest = lambda b: F.when(g > 0, b["low"]).otherwise(b["high"])

        def moved(s: Column, b: Column) -> Column:
            if mode == "STEP":
                best2, next_ = s["best"], s["best"] * (1 - g * step / 100)
                new = lambda old, pct: cap(old * (1 - g * sl_step / 100))
            else:
                best2 = next_ = b["close"]
                new = lambda old, pct: cap({"RATIO": level(pct) - g * F.abs(o - best2) * gap, "POINT": best2 + (level(pct) - o), "PCT": best2 * (1 + g * pct / 100)}[mode])
            stop2, far2 = F.when(sl > 0, new(s["stop"], sl)), F.when(intra > 0, new(s["far"], intra))
            going = state(stop2, far2, next_, F.lit(True), none_t, none_p, no)
            if mode in ("POINT", "PCT"):
                return going
            crossed, far_crossed = off(g * stop2 <= g * best2), off(g * far2 <= g * best2)
            price = best2 if mode == "STEP" else F.when(far_crossed, far2).otherwise(stop2)
            return F.when(crossed | far_crossed, state(stop2, far2, best2, F.lit(True), b["t"], price, far_crossed)).otherwise(going)

        def fold(s: Column, b: Column) -> Column:
            inner, hit = off(g * worst(b) >= g * s["far"]), off(g * b["close"] >= g * s["stop"])
            if mode == "STEP":
                further = ((sl > 0) & (g * b["close"] <= g * s["best"])) | ((intra > 0) & (g * finest(b) <= g * s["best"]))
            else:
                further = g * b["close"] < g * s["best"]
            return F.when(s["t"].isNotNull(), s).when(inner | hit, state(s["stop"], s["far"], s["best"], s["moved"], b["t"], F.when(inner, s["far"]).otherwise(b["close"]), inner)).when(further, moved(s, b)).otherwise(s)

        start_best = (100 - g * step) / 100 * o if mode == "STEP" else o
        return let(rest(w), lambda r: let(F.aggregate(r, state(level(sl), level(intra), start_best, no, none_t, none_p, no), fold), lambda s: outcome(r, o, g, s)))

    def outcome(r: Column, o: Column, g: Column, s: Column) -> Column:
        price = F.coalesce(s["price"], last(r)["close"])
        ok = (step > 0) & (sl_step > 0) & (sl_step <= step) if mode == "STEP" else F.lit(True)
        some = ok & F.coalesce(F.size(r) > 0, no)
        return F.struct(
            o.alias("o"), F.when(some, s["stop"]).alias("stop"), F.when(some, s["far"]).alias("intra"), (some & s["moved"]).alias("moved"), (some & s["t"].isNotNull()).alias("hit"), (some & s["inner"]).alias("intra_hit"),
            F.when(some, s["t"]).alias("t"), F.when(some, price).alias("exit"), F.when(some, money(g * (o - price) - o * lit(rate))).otherwise(0.0).alias("pnl"), F.when(ok, "ok").otherwise("invalid_trail").alias("status"),
        )

    return let(window(bars, start, end), lambda w: let(first(w)["close"], lambda o: let(signs(side), lambda g: folded(w, o, g))))


def trail_limited(bars: Column, start: Column, end: Column, *, side: Column, o: Column, sl: Column | float, sl_step: Column | float, step: Column | float, most: int = 7) -> Column:
    """Array of `most` gains, of a stop that tightens 1, 2, ... `most` times at most; null where it is not hit after a move.

    Every bar from start on is tested, the first too: first the stop, which fills at its level, then the trigger, which
    moves both as in STEP. A stop that passes the trigger ends the trade without a gain of its own.
    """
    sl, sl_step, step = lit(sl), lit(sl_step), lit(step)
    state = lambda stop, best, n, done, price: F.struct(stop.cast("double").alias("stop"), best.cast("double").alias("best"), n.cast("int").alias("n"), done.alias("done"), price.cast("double").alias("price"))
    none = F.lit(None).cast("double")

    def limited(w: Column, g: Column, k: int) -> Column:
        def fold(s: Column, b: Column) -> Column:
            against, along = F.when(g > 0, b["high"]).otherwise(b["low"]), F.when(g > 0, b["low"]).otherwise(b["high"])
            hit, further = g * against >= g * s["stop"], (s["n"] < k) & (g * along <= g * s["best"])
            stop2, best2 = s["stop"] * (1 - g * sl_step / 100), s["best"] * (1 - g * step / 100)
            return F.when(s["done"], s).when(hit, state(s["stop"], s["best"], s["n"], F.lit(True), s["stop"])).when(further, state(stop2, best2, s["n"] + 1, g * stop2 <= g * best2, none)).otherwise(s)

        begin = state(o * (1 + g * sl / 100), o * (1 - g * step / 100), F.lit(0), F.lit(False), none)
        return let(F.aggregate(w, begin, fold), lambda s: F.when(s["n"] > 0, g * (o - s["price"])))

    return let(window(bars, start, end), lambda w: let(signs(side), lambda g: F.array(*(limited(w, g, k) for k in range(1, most + 1)))))


def range_levels(ce: Column, pe: Column, futures: Column, strike: Column, synthetic: Column | bool) -> Column:
    """(t, high, low, close) of the future, or of the synthetic one of a strike's legs, on the minutes that all three have."""
    synthetic = lit(synthetic, "boolean")
    legs = both_legs(ce, pe, lambda a, b: F.struct(a["t"].alias("t"), (strike + a["high"] - b["low"]).alias("high"), (strike + a["low"] - b["high"]).alias("low"), (strike + a["close"] - b["close"]).alias("close")))
    one = lambda s, f, c: F.when(synthetic, s[c]).otherwise(f[c]).alias(c)
    return both_legs(legs, futures, lambda s, f: F.struct(s["t"].alias("t"), one(s, f, "high"), one(s, f, "low"), one(s, f, "close")))


def range_stop(
    bars: Column, levels: Column, start: Column, end: Column, *, side: Column, strike: Column, premium: Column, sl: Column | float, intra: Column | float = 0.0, rate: Column | float = 0.0,
    opening: int = -1, day: int = 1440, dynamic: Column | bool = False, evenings: Column | None = None, premiums: Column | None = None,
) -> Column:
    """A struct (o, hit, intra_hit, t, exit, pnl, days): a straddle's trade that ends when levels leave a band about strike.

    The band is `sl` (and `intra`) percent of the premium wide on either side; the close is tested, and the extremes
    against the intra band, first, but not on bars that open a day (minute `opening`). A close fills at the close, an
    intra hit at the straddle's high (SELL) or low. The entry bar and the last bar are never tested, nor are minutes
    without a level. dynamic: a later day's band comes from the last of `evenings` (d, premium) before it. premiums
    (t, premium) of the straddle at the money: the band shrinks to every new low. days: (d, pnl) from close to close.
    """
    sl, intra, dynamic = lit(sl), lit(intra), lit(dynamic, "boolean")
    evenings = F.array().cast("array<struct<d:int,premium:double>>") if evenings is None else evenings
    day_of = lambda t: F.floor(t / day).cast("int")
    no, none_t, none_p = F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("double")
    state = lambda low, band, d, t, price, inner: F.struct(low.cast("double").alias("low"), band.cast("double").alias("band"), d.cast("int").alias("d"), t.cast("int").alias("t"), price.cast("double").alias("price"), inner.alias("inner"))

    def joined(tested: Column) -> Column:
        two = both_legs(tested, levels, lambda b, v: F.struct(b["t"].alias("t"), b.alias("b"), v.alias("v")))
        if premiums is None:
            return F.transform(two, lambda x: F.struct(x["b"].alias("b"), x["v"].alias("v"), none_p.alias("p")))
        # Minutes without a premium stay: their own array entries, matched by time.
        tagged = F.concat(F.transform(two, lambda x: F.struct(x["t"].alias("t"), F.lit(1).alias("k"), x.alias("x"), none_p.alias("p"))), F.transform(premiums, lambda y: F.struct(y["t"].alias("t"), F.lit(0).alias("k"), F.lit(None).cast("struct<t:int,b:struct<t:int,high:double,low:double,close:double>,v:struct<t:int,high:double,low:double,close:double>>").alias("x"), y["premium"].alias("p"))))
        side_by_side = let(F.array_sort(tagged), lambda s: F.transform(s, lambda z, i: F.struct(z["x"].alias("x"), F.when((i > 0) & (F.get(s, i - 1)["k"] == 0) & (F.get(s, i - 1)["t"] == z["t"]), F.get(s, i - 1)["p"]).alias("p"))))
        return F.transform(F.filter(side_by_side, lambda z: z["x"].isNotNull()), lambda z: F.struct(z["x"]["b"].alias("b"), z["x"]["v"].alias("v"), z["p"].alias("p")))

    def fold(s: Column, x: Column) -> Column:
        b, v = x["b"], x["v"]
        d = day_of(b["t"])
        reset = last(F.filter(evenings, lambda e: (e["d"] >= s["d"]) & (e["d"] < d)))["premium"]
        band = F.when(dynamic, F.coalesce(reset, s["band"])).otherwise(s["band"])
        lower = F.coalesce(x["p"] < s["low"], no)
        low, band = F.when(lower, x["p"]).otherwise(s["low"]), F.when(lower, x["p"]).otherwise(band)
        out = lambda pct, up, down: F.coalesce((up >= strike + band * pct / 100) | (down <= strike - band * pct / 100), no)
        inner = (intra > 0) & (b["t"] % day != opening) & out(intra, v["high"], v["low"])
        hit = (sl > 0) & out(sl, v["close"], v["close"])
        price = F.when(inner, F.when(side == "SELL", b["high"]).otherwise(b["low"])).when(hit, b["close"])
        return F.when(s["t"].isNotNull(), s).otherwise(state(low, band, d, F.when(inner | hit, b["t"]), price, inner))

    def outcome(r: Column, o: Column, g: Column, s: Column) -> Column:
        some = F.coalesce(F.size(r) > 0, no)
        price = F.coalesce(s["price"], last(r)["close"])
        slip = o * lit(rate)
        held = F.filter(r, lambda b: b["t"] <= F.coalesce(s["t"], last(r)["t"]))
        ends = let(held, lambda h: F.transform(F.filter(F.transform(h, lambda b, i: F.struct(b.alias("b"), F.get(h, i + 1)["t"].alias("next"))), lambda y: y["next"].isNull() | (day_of(y["next"]) != day_of(y["b"]["t"]))), lambda y: F.struct(day_of(y["b"]["t"]).alias("d"), F.when(y["next"].isNull(), price).otherwise(y["b"]["close"]).alias("c"))))
        days = let(ends, lambda e: F.transform(e, lambda y, i: F.struct(y["d"].alias("d"), (g * (F.when(i == 0, o).otherwise(F.get(e, i - 1)["c"]) - y["c"]) - F.when(i == F.size(e) - 1, slip).otherwise(0.0)).alias("pnl"))))
        return F.struct(F.when(some, o).alias("o"), (some & s["t"].isNotNull()).alias("hit"), (some & s["inner"]).alias("intra_hit"), F.when(some, s["t"]).alias("t"), F.when(some, price).alias("exit"), F.when(some, money(g * (o - price) - slip)).otherwise(0.0).alias("pnl"), F.when(some, days).alias("days"))

    def judged(w: Column, g: Column) -> Column:
        o = first(w)["close"]
        begin = state(premium, premium, day_of(first(w)["t"]), none_t, none_p, no)
        return let(rest(w), lambda r: let(F.aggregate(joined(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))), begin, fold), lambda s: outcome(r, o, g, s)))

    return let(window(bars, start, end), lambda w: let(signs(side), lambda g: judged(w, g)))
