"""One table of trade legs for all families of strategies, and what is worked out on it: minute series, portfolio stop.

A row is one leg of a trade: the caller's keys (idx and trade_date among them) and `leg`, a struct of part, kind (`leg`: a
scrip; `straddle`: both scrips' sums; `common`: a scrip on the minutes that other has too), scrip, other, start, until (the
last minute held), t (the exit; null: held to until), o (entry price; null: the first close), pnl (realised; null: at the
last close), side, rate (slippage, a share of o), times (multiple of the profit), last (minutes beyond it do not count).
A strategy gives its legs as such rows, whatever its rules; nothing that works on them knows which one it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelab.functions.scalars import money
from strikelab.functions.triggers import common, first, last, let, rest, signs, straddle_bars, window
from strikelab.operators import mtm, rollup
from strikelab.plans import shift
from strikelab.plans import strategies as st
from strikelab.plans.lineage import cut
from strikelab.plans.steps import DAY, Desk, answered, session

_POINTS = "array<struct<t:int,mtm:double>>"
#: Entries (with keys of any kind) and a desk to legs with the entries' columns as keys.
Trader = Callable[[DataFrame, Desk], DataFrame]


def leg(part: str, scrip: Column, start: Column, until: Column, *, kind: str = "leg", other: Column | None = None, t: Column | None = None, o: Column | None = None, pnl: Column | None = None, side: Column | None = None, rate: Column | float = 0.0, times: float = 1.0, last: Column | None = None) -> Column:
    null = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    fields = {
        "part": F.lit(part), "kind": F.lit(kind), "scrip": scrip, "other": null(other, "string"), "start": start.cast("int"), "until": until.cast("int"), "t": null(t, "int"), "o": null(o, "double"), "pnl": null(pnl, "double"),
        "side": F.col("side") if side is None else side, "rate": (rate if isinstance(rate, Column) else F.lit(rate)).cast("double"), "times": F.lit(float(times)), "last": null(last, "int"),
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def legs_of(rows: DataFrame, keys: list[str], *legs: Column) -> DataFrame:
    """keys and leg, for each leg of each row. Those without a scrip or a start go, but one of them stays where all are so: a trade that
    was chosen and held nothing is a row of zeros."""
    real = F.filter(F.array(*legs), lambda x: x["scrip"].isNotNull() & x["start"].isNotNull())
    return rows.select(*keys, real.alias("_legs"), legs[0].alias("_one")).select(*keys, F.explode(F.when(F.size("_legs") > 0, F.col("_legs")).otherwise(F.array("_one"))).alias("leg"))


def with_points(legs: DataFrame, desk: Desk) -> DataFrame:
    """legs with points: an array of (t, mtm), the profit at each bar after the entry's to the exit, less slippage; the last is what is
    realised. Legs that agree in all that counts are worked out once."""

    def answer(q: DataFrame) -> DataFrame:
        bars = lambda k: desk.legs.select(*DAY, F.col("scrip").alias(k), F.col("bars").alias(f"{k}_bars"))
        q = q.join(bars("scrip"), [*DAY, "scrip"], "left").join(bars("other"), [*DAY, "other"], "left")
        own = window(F.col("scrip_bars"), F.col("start"), F.col("until"))
        held = F.when(F.col("kind") == "leg", own).when(F.col("kind") == "straddle", straddle_bars(own, F.col("other_bars"))).otherwise(common(own, F.col("other_bars")))

        def series(w: Column) -> Column:
            o = F.coalesce(F.col("o"), first(w)["close"])
            kept = F.filter(rest(w), lambda b: b["t"] <= F.coalesce(F.col("t"), F.col("until")))
            value = lambda b: signs(F.col("side")) * (o - b["close"]) - o * F.col("rate")
            return let(kept, lambda k: F.transform(k, lambda b: F.struct(b["t"].alias("t"), F.when(b["t"] == last(k)["t"], F.coalesce(F.col("pnl"), money(value(b)))).otherwise(value(b)).alias("mtm"))))

        return q.select("_key", F.coalesce(let(held, series), F.array().cast(_POINTS)).alias("points"))

    key = session(**{c: F.col(f"leg.{c}") for c in ("kind", "scrip", "other", "start", "until", "t", "o", "pnl", "side", "rate")})
    rows = answered(legs, key, answer, "points")
    inside = F.filter("points", lambda p: F.col("leg.last").isNull() | (p["t"] <= F.col("leg.last")))
    return rows.withColumn("points", F.transform(inside, lambda p: F.struct(p["t"].alias("t"), (p["mtm"] * F.col("leg.times")).alias("mtm"))))


def minutes(legs: DataFrame, keys: list[str], desk: Desk, step: int = 1, parts: tuple[str, ...] = ()) -> DataFrame:
    """keys, _t, mtm and a column for each of parts: the legs' profit added up on every step-th minute of the session."""
    grid = with_points(legs, desk).select(*keys, F.col("leg.part").alias("_part"), F.explode(mtm.filled(F.col("points"), desk.first, desk.last, step)).alias("_g"))
    return grid.groupBy(*keys, F.col("_g.t").alias("_t")).agg(F.sum("_g.mtm").alias("mtm"), *(F.sum(F.when(F.col("_part") == p, F.col("_g.mtm")).otherwise(0.0)).alias(p) for p in parts))


def portfolio_stop(entries: DataFrame, desk: Desk, trader: Trader, levels: list[float], fund: float = 1e9, margin_percent: float = 12.0, step: int = 1, lag: int = 1, parts: tuple[str, ...] = ()) -> DataFrame:
    """keys, level, t and paid (and paid_{part}): what each level of the fund pays, for the trades of trader.

    entries with last_trade_time and trade_interval make a ladder of entries from start on, among which the fund is divided,
    into whole shares; an entry that several sets share is traded once. Without these columns one entry gets the fund in
    fractions of shares.
    """
    keys = entries.columns
    if "trade_interval" in keys:
        rungs = entries.withColumn("_go", F.explode(F.sequence("start", "last_trade_time", F.col("trade_interval").cast("int"))))
        asked = [c for c in keys if c not in ("start", "last_trade_time", "trade_interval")]
        trades = cut(rungs.select(*asked, F.col("_go").alias("start")).distinct(), "rungs")
        once = minutes(trader(trades, desk), trades.columns, desk, step, parts).withColumnRenamed("start", "_go")
        rows = rungs.join(once, [*asked, "_go"]).groupBy(*keys, "_t").agg(*(F.sum(c).alias(c) for c in ("mtm", *parts)))
        n = F.floor((F.col("last_trade_time") - F.col("start")) / F.col("trade_interval")) + 1
    else:
        rows, n = minutes(trader(entries, desk), keys, desk, step, parts), None
    price = desk.futures.select(*DAY, F.element_at("fut", 1)["close"].alias("_price"))
    rows = rows.join(price, DAY).withColumn("_n", rollup.shares(fund, margin_percent, F.col("_price"), n))
    rows = rows.select(*keys, F.col("_t").alias("t"), *(money(F.round(c, 6) * F.col("_n")).alias(c) for c in ("mtm", *parts)))
    return rollup.crossings(rows, keys, levels, F.lit(float(fund)), lag, list(parts))


def gated(trader: Trader) -> Trader:
    """The same trades, each entered only when the straddle's premium is low enough (strategies.gated)."""

    def run(entries: DataFrame, desk: Desk) -> DataFrame:
        legs = trader(st.gated(entries, desk), desk)
        return legs.select(*(F.col("from_t").alias("start") if c == "start" else c for c in entries.columns), "leg")

    return run


def daywise(legs: DataFrame, keys: list[str], desk: Desk, day: int = 1440) -> DataFrame:
    """keys, d (day of the session), pnl: the legs' profit by day, from one day's last bar to the next one's."""
    ends = with_points(legs, desk).select(*keys, "points", F.explode(F.array_distinct(F.transform("points", lambda p: F.floor(p["t"] / day)))).alias("d"))
    at = lambda d: F.coalesce(last(F.filter("points", lambda p: F.floor(p["t"] / day) <= d))["mtm"], F.lit(0.0))
    return ends.select(*keys, F.col("d").cast("int").alias("d"), (at(F.col("d")) - at(F.col("d") - 1)).alias("v")).groupBy(*keys, "d").agg(F.round(F.sum("v"), 4).alias("pnl"))


# --- families -----------------------------------------------------------------------------------------------------------


def _within(log: DataFrame, keys: list[str]) -> DataFrame:
    """A log's rounds up to re_entries, where the entries have that."""
    return log.where(F.col("round") <= F.col("re_entries")) if "re_entries" in keys else log


def b120(most: int = 0, times_ut: float = 1.0) -> Trader:
    """Separate stops and the leg that is followed (part ut); again from its exit, up to `most` times.

    The leg that is followed counts for itself up to the minute before its following's first bar.
    """

    def run(entries: DataFrame, desk: Desk) -> DataFrame:
        keys = entries.columns

        def followed(b: Column, k) -> Column:
            return let(st.follow(b, k, desk), lambda r: F.struct(*(r[c].alias(c) for c in ("o", "t", "pnl", "sl_price")), first(rest(window(b, k.start, k.end)))["t"].alias("began")))

        def step(rows: DataFrame, n: int) -> DataFrame:
            rows = st.b120_legs(st.picked(rows.select(*keys, "_go"), desk, start=F.col("_go")), desk, followed)
            on = F.col("ut_r.o").isNotNull()
            both = [leg("std", F.col(f"pick.{k}"), F.col("pick.t"), F.col("end"), t=F.col(f"{k}_r.t"), o=F.col(f"{k}_r.o"), pnl=F.col(f"{k}_r.pnl"), rate=desk.rate, last=F.when(on & (F.col("first") == o), F.col("ut_r.began") - 1)) for k, o in (("ce", "pe"), ("pe", "ce"))]
            ut = leg("ut", F.when(on, F.col("ut")), F.col("at"), F.col("end"), t=F.col("ut_r.t"), o=F.col("ut_r.o"), pnl=F.col("ut_r.pnl"), times=times_ut)
            more = F.lit(n) < (F.col("re_entries") if "re_entries" in keys else F.lit(most))
            return rows.select(*keys, F.filter(F.array(*both, ut), lambda x: x["scrip"].isNotNull()).alias("legs"), F.col("exit_t").alias("_go"), ((F.col("exit_t") < F.col("end") - 5) & more).alias("live"))

        log = st.rounds(entries.withColumn("_go", F.col("start")), step, most, [*keys, "legs"], "b120-legs")
        return log.select(*keys, F.explode("legs").alias("leg"))

    return run


def logged(strategy: Callable[[DataFrame, Desk, int], DataFrame], most: int = 7) -> Trader:
    """The legs of a strategy whose log has a row for each leg and round (scrip, entry_t, o, exit_t, pnl), the first of each entry among
    them: st.nre, st.nre_cc, st.red."""

    def run(entries: DataFrame, desk: Desk) -> DataFrame:
        log = _within(strategy(entries, desk, most), entries.columns)
        return legs_of(log, entries.columns, leg("std", F.col("scrip"), F.col("entry_t"), F.col("end"), t=F.col("exit_t"), o=F.col("o"), pnl=F.col("pnl"), rate=desk.rate))

    return run


def nre(most: int = 7) -> Trader:
    """Each leg with a stop, and again at its first price after each."""
    return logged(st.nre, most)


def sut(entries: DataFrame, desk: Desk) -> DataFrame:
    """A straddle with a combined stop, then one leg (part ut)."""
    rows = st.with_ut(st.combined(st.picked(entries, desk), desk), desk)
    straddle = leg("std", F.col("pick.ce"), F.col("pick.t"), F.col("end"), kind="straddle", other=F.col("pick.pe"), t=F.col("r.t"), o=F.col("r.o"), pnl=F.col("r.pnl"), rate=desk.rate)
    return legs_of(rows, entries.columns, straddle, leg("ut", F.col("ut_scrip"), F.col("up.t"), F.col("end"), t=F.col("ut_r.t"), o=F.col("ut_r.o"), pnl=F.col("ut_r.pnl"), side=F.col("ut_side"), rate=desk.rate))


def dt(entries: DataFrame, desk: Desk) -> DataFrame:
    """Each leg once it has decayed, with a stop."""
    rows = st.decay_legs(st.picked(entries, desk), desk)
    one = lambda k: leg("std", F.col(f"pick.{k}"), F.col(f"{k}_r.d.t"), F.col("end"), t=F.col(f"{k}_r.r.t"), o=F.col(f"{k}_r.r.o"), pnl=F.col(f"{k}_r.r.pnl"), rate=desk.rate)
    return legs_of(rows, entries.columns, one("ce"), one("pe"))


def sre(most: int = 7) -> Trader:
    """A straddle with a combined stop, and a fresh one after each."""

    def run(entries: DataFrame, desk: Desk) -> DataFrame:
        log = _within(st.sre(entries, desk, most), entries.columns)
        return legs_of(log, entries.columns, leg("std", F.col("ce"), F.col("entry_t"), F.col("end"), kind="straddle", other=F.col("pe"), t=F.col("exit_t"), o=F.col("o"), pnl=F.col("pnl"), rate=desk.rate))

    return run


def sre_separate(most: int = 7) -> Trader:
    """A straddle that a stop on either leg closes, and a fresh one after each. The stopped leg counts on the minutes that both have; the
    other is sold to that minute's close, and so are both where both are stopped at once, or neither."""

    def run(entries: DataFrame, desk: Desk) -> DataFrame:
        keys = entries.columns
        log = _within(st.sre_separate(entries, desk, most, more=["first", "ce_stop", "pe_stop"]), keys)

        def one(k: str, o: str) -> list[Column]:
            own = F.col("first") == k
            until = F.coalesce("exit_t", "end")
            stopped = leg("std", F.when(own, F.col(k)), F.col("entry_t"), F.col("end"), kind="common", other=F.col(o), t=F.col("exit_t"), o=F.col(f"{k}_stop.o"), pnl=F.col(f"{k}_stop.pnl"), rate=desk.rate)
            sold = leg("std", F.when(own, None).otherwise(F.col(k)), F.col("entry_t"), until, side=F.lit("SELL"), rate=desk.rate)
            return [stopped, sold]

        return legs_of(log, keys, *one("ce", "pe"), *one("pe", "ce"))

    return run


def premium_shift(most: int = 20) -> Trader:
    """A straddle whose cheaper leg is rolled to a dearer one whenever the other reaches its price limit, sold throughout."""

    def run(entries: DataFrame, desk: Desk) -> DataFrame:
        keys = entries.columns
        held = shift.held(entries, desk, ending="none", most=most)
        sold = lambda scrip, start, until: leg("std", scrip, start, until, side=F.lit("SELL"), rate=desk.rate)
        gone = held.select(*keys, F.explode("gone").alias("_x"))
        return legs_of(held, keys, *(sold(F.col(k), F.col(f"{k}_t"), F.col("exit_t")) for k in ("ce", "pe"))).unionByName(legs_of(gone, keys, sold(F.col("_x.scrip"), F.col("_x.start"), F.col("_x.until"))))

    return run
