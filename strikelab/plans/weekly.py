"""Weeks as sessions: bars of a week on one line of minutes, and the range stops that run over days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelab.functions.scalars import money
from strikelab.functions.triggers import all_legs, both_legs, first, last, let, range_levels, range_stop, straddle_bars, window
from strikelab.plans.grid import week_slice, weeks
from strikelab.plans.steps import DAY, DAY_MINUTES, Desk, answered, enter, rounds, scrip_of, session


def week_days(calendar: DataFrame, from_dte: int, to_dte: int) -> DataFrame:
    """idx, day, trade_date (the first day of the week's slice), place (0, 1, ...), dte of calendar's (idx, trade_date, dte) days."""
    sliced = week_slice(weeks(calendar), from_dte, to_dte).dropDuplicates(["idx", "week", "trade_date"])
    rows = sliced.groupBy("idx", "week").agg(F.sort_array(F.collect_list(F.struct("trade_date", "dte"))).alias("d"))
    return rows.select("idx", F.element_at("d", 1)["trade_date"].alias("_first"), F.posexplode("d").alias("place", "x")).select("idx", F.col("x.trade_date").alias("day"), F.col("_first").alias("trade_date"), "place", F.col("x.dte").alias("dte"))


def on_weeks(bars: DataFrame, days: DataFrame, opening: int | None = None) -> DataFrame:
    """bars (idx, trade_date, t, ...) keyed by their week, t going on from day to day; opening: that minute's bars are flat."""
    rows = bars.withColumnRenamed("trade_date", "day").join(days.select("idx", "day", "trade_date", "place"), ["idx", "day"])
    if opening is not None:
        flat = F.col("t") == opening
        rows = rows.withColumns({c: F.when(flat, F.col("close")).otherwise(F.col(c)) for c in ("high", "low")})
    return rows.withColumn("t", (F.col("place") * DAY_MINUTES + F.col("t")).cast("int")).drop("day", "place")


def week_dtes(days: DataFrame) -> DataFrame:
    """idx, trade_date, dtes of each week."""
    return days.groupBy(*DAY).agg(F.sort_array(F.collect_list(F.struct("place", "dte"))).alias("d")).select(*DAY, F.col("d.dte").alias("dtes"))


def evenings(picks: Column, closing: int, minutes: int = 15) -> Column:
    """(d, premium) of the last valid straddle in the final minutes of each day that has one."""
    late = F.filter(picks, lambda p: (p["t"] % DAY_MINUTES > closing - minutes) & (p["t"] % DAY_MINUTES <= closing))
    kept = let(late, lambda q: F.filter(F.transform(q, lambda p, i: F.struct(p.alias("p"), F.get(q, i + 1)["t"].alias("next"))), lambda x: x["next"].isNull() | (F.floor(x["next"] / DAY_MINUTES) != F.floor(x["p"]["t"] / DAY_MINUTES))))
    return F.transform(kept, lambda x: F.struct(F.floor(x["p"]["t"] / DAY_MINUTES).cast("int").alias("d"), (x["p"]["ce_price"] + x["p"]["pe_price"]).alias("premium")))


def ask_range(rows: DataFrame, desk: Desk, name: str, *, ce: Column, pe: Column, std: str = "std", start: Column, trailed: bool = False) -> DataFrame:
    """rows with `name`: the range stop of a straddle; the band is about the pick in `std`. rows have end, side, sl, intra_sl,
    fixed_or_dynamic, synthetic_future."""
    strike = F.regexp_extract(F.col(f"{std}.ce"), r"^(.*)..$", 1).cast("double")
    key = session(ce=ce, pe=pe, sce=F.col(f"{std}.ce"), spe=F.col(f"{std}.pe"), strike=strike, premium=F.col(f"{std}.ce_price") + F.col(f"{std}.pe_price"), start=start, end=F.col("end"), side=F.col("side"), sl=F.col("sl"), intra=F.col("intra_sl"), dynamic=F.col("fixed_or_dynamic") != "FIXED", synthetic=F.col("synthetic_future"))
    leg = lambda k: desk.legs.select(*DAY, F.col("scrip").alias(k), F.col("bars").alias(f"{k}_bars"))
    middle = desk.menus.where("om = '0'").select(*DAY, "picks")

    def answer(q: DataFrame) -> DataFrame:
        for k in ("ce", "pe", "sce", "spe"):
            q = q.join(leg(k), [*DAY, k])
        q = q.join(desk.futures, DAY).join(middle, DAY)
        levels = range_levels(window(F.col("sce_bars"), F.col("start"), F.col("end")), F.col("spe_bars"), F.col("fut"), F.col("strike"), F.col("synthetic"))
        premiums = F.transform("picks", lambda p: F.struct(p["t"].alias("t"), (p["ce_price"] + p["pe_price"]).alias("premium"))) if trailed else None
        r = range_stop(
            straddle_bars(F.col("ce_bars"), F.col("pe_bars")), levels, F.col("start"), F.col("end"), side=F.col("side"), strike=F.col("strike"), premium=F.col("premium"), sl=F.col("sl"), intra=F.col("intra"), rate=desk.rate,
            opening=desk.first, day=DAY_MINUTES, dynamic=F.col("dynamic"), evenings=evenings(F.col("picks"), desk.last), premiums=premiums,
        )
        return q.select("_key", r.alias(name))

    return answered(rows, key, answer, name)


RANGE_OUT = ["entry_t", "ce", "pe", "o", "hit", "intra_hit", "exit_t", "pnl", "days"]


def _range_rounds(entries: DataFrame, desk: Desk, begin: DataFrame, most: int, trailed: bool, name: str, chosen=None) -> DataFrame:
    """Straddles from go on, each with a range stop, re-entered while the day's budget (dte1re .. dte5re) lasts.

    A stop on a day without budget, or under the rule CUT, waits for the day's last 15 minutes, or ends it on the day of
    dte 1. begin: entries' columns, go, and with `chosen` the first straddle as pick.
    """
    keys = entries.columns
    budget = F.array(*(F.col(f"dte{i}re") for i in range(1, 6)))

    def step(rows: DataFrame, n: int) -> DataFrame:
        if n == 0 and chosen is not None:
            rows = rows.withColumn("pick", chosen)
        else:
            rows = enter(rows, desk, "pick", start=F.col("go"))
        rows = rows.where("pick IS NOT NULL").withColumn("left", budget if n == 0 else F.col("left"))
        rows = enter(rows, desk, "std", om=F.lit("0"), start=F.col("pick.t")).where("std IS NOT NULL")
        rows = ask_range(rows, desk, "r", ce=F.col("pick.ce"), pe=F.col("pick.pe"), start=F.col("pick.t"), trailed=trailed)
        rows = rows.join(desk.days, DAY)
        d = F.floor(F.col("r.t") / DAY_MINUTES).cast("int")
        dte = F.get("dtes", d)
        rows = rows.withColumn("dte", dte).withColumn("out", F.coalesce(F.get("left", F.col("dte") - 1) == 0, F.lit(True)) | (F.upper("normal_or_cut") == "CUT"))
        due = F.when(~F.col("out"), F.col("r.t")).when(F.col("dte") != 1, F.greatest(F.col("r.t"), d * DAY_MINUTES + desk.last - 15))
        rows = rows.withColumn("go", F.when(F.col("r.t") < F.col("end") - 5, due))
        spent = F.transform("left", lambda x, i: F.when(~F.col("out") & (i == F.col("dte") - 1), x - 1).otherwise(x))
        return rows.select(*keys, F.col("pick.t").alias("entry_t"), F.col("pick.ce").alias("ce"), F.col("pick.pe").alias("pe"), F.col("r.o").alias("o"), F.col("r.hit").alias("hit"), F.col("r.intra_hit").alias("intra_hit"), F.col("r.t").alias("exit_t"), F.coalesce("r.pnl", F.lit(0.0)).alias("pnl"), F.col("r.days").alias("days"), spent.alias("left"), "go", F.col("go").isNotNull().alias("live"))

    return rounds(begin, step, most, [*keys, *RANGE_OUT], name)


def srew_range(entries: DataFrame, desk: Desk, most: int = 20, trailed: bool = False) -> DataFrame:
    """A week's straddle with a range stop and re-entries; a row a round. trailed: the band shrinks with the premium.

    entries: start, end, om, side, sl, intra_sl, fixed_or_dynamic, normal_or_cut, synthetic_future, dte1re .. dte5re.
    """
    return _range_rounds(entries, desk, entries.withColumn("go", F.col("start")), most, trailed, "srew-range")


def strangle_to_straddle(entries: DataFrame, desk: Desk, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """A strangle by starting_om until the future touches one of its strikes, then a straddle there (or a fresh one by om, if that
    was a day's opening bar) with the range stop and re-entries: the strangles, and a row a round.

    Only minutes that both pairs of legs and the future have count. The strangle's P&L is at closes; the leg that stays in the
    straddle pays no slippage.
    """
    keys = entries.columns
    rows = enter(entries, desk, "p0", om=F.col("starting_om")).where("p0 IS NOT NULL")
    strike = lambda k: F.regexp_extract(F.col(f"p0.{k}"), r"^(.*)..$", 1).cast("double")
    rows = rows.withColumns({"kc": strike("ce"), "kp": strike("pe"), "rce": scrip_of(strike("pe"), "CE"), "rpe": scrip_of(strike("ce"), "PE")})
    key = session(ce=F.col("p0.ce"), pe=F.col("p0.pe"), rce=F.col("rce"), rpe=F.col("rpe"), kc=F.col("kc"), kp=F.col("kp"), start=F.col("p0.t"), end=F.col("end"))
    leg = lambda k: desk.legs.select(*DAY, F.col("scrip").alias(k), F.col("bars").alias(f"{k}_bars"))

    def answer(q: DataFrame) -> DataFrame:
        for k in ("ce", "pe", "rce", "rpe"):
            q = q.join(leg(k), [*DAY, k])
        q = q.join(desk.futures, DAY)
        names = ["ce", "pe", "rce", "rpe", "f"]
        inside = window(F.col("ce_bars"), F.col("start"), F.col("end"))
        pair = both_legs(inside, F.col("pe_bars"), lambda x, y: F.struct(x["t"].alias("t"), x["close"].alias("a"), y["close"].alias("b")))
        all_five = all_legs([inside, *(F.col(f"{k}_bars") for k in names[1:4]), F.col("fut")], lambda *x: F.struct(x[0]["t"].alias("t"), *(y["close"].alias(n) for n, y in zip(names, x, strict=True))))

        def touched(m: Column) -> Column:
            up, down = first(F.filter(m, lambda z: z["f"] >= F.col("kc"))), first(F.filter(m, lambda z: z["f"] <= F.col("kp")))
            return F.struct(up.alias("up"), down.alias("down"))

        return q.select("_key", F.struct(let(all_five, touched).alias("m"), let(pair, last).alias("z")).alias("f"))

    rows = answered(rows, key, answer, "f")
    up, down = F.col("f.m.up"), F.col("f.m.down")
    way = F.when(up.isNotNull() & (down.isNull() | (up["t"] < down["t"])), "up").when(down.isNotNull() & (up.isNull() | (down["t"] < up["t"])), "down")
    rows = rows.withColumn("way", way).withColumn("hit", F.when(F.col("way") == "up", up).when(F.col("way") == "down", down))
    opened = F.col("hit.t") % DAY_MINUTES == desk.first
    cost = lambda k: F.col(f"p0.{k}_price")
    stays = lambda k: F.col("way").isNotNull() & ~opened & (F.col("way") == ("up" if k == "ce" else "down"))
    at = lambda k, i: F.coalesce(F.col(f"hit.{k}"), F.col(f"f.z.{i}"))
    pnl = sum((cost(k) - at(k, i) - F.when(stays(k), 0.0).otherwise(cost(k) * desk.rate) for k, i in (("ce", "a"), ("pe", "b"))), F.lit(0.0))
    rows = rows.withColumns({"first_pnl": money(pnl), "touch_t": F.col("hit.t")})
    rows = enter(rows, desk, "fresh", start=F.when(F.col("way").isNotNull() & opened, F.col("hit.t")))
    here = F.struct(F.col("hit.t").alias("t"), F.lit(None).cast("double").alias("future"), F.when(F.col("way") == "up", F.col("p0.ce")).otherwise(F.col("rce")).alias("ce"), F.when(F.col("way") == "up", F.col("rpe")).otherwise(F.col("p0.pe")).alias("pe"), F.when(F.col("way") == "up", F.col("hit.ce")).otherwise(F.col("hit.rce")).alias("ce_price"), F.when(F.col("way") == "up", F.col("hit.rpe")).otherwise(F.col("hit.pe")).alias("pe_price"))
    rows = rows.withColumn("chosen", F.when(F.col("way").isNotNull(), F.when(opened, F.col("fresh")).otherwise(here)))
    strangles = rows.select(*keys, F.col("p0.t").alias("entry_t"), F.col("p0.ce").alias("ce"), F.col("p0.pe").alias("pe"), "touch_t", "first_pnl")
    begin = rows.where("chosen IS NOT NULL").select(*keys, "chosen", F.col("touch_t").alias("go"))
    return strangles, _range_rounds(entries, desk, begin, most, False, "strangle-straddle", chosen=F.col("chosen"))


def daywise(rounds_: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d (day of the session), pnl: the rounds' profit by day."""
    one = rounds_.select(*keys, F.explode("days").alias("x"))
    return one.groupBy(*keys, F.col("x.d").alias("d")).agg(F.round(F.sum("x.pnl"), 4).alias("pnl"))


def last_five(days: DataFrame, keys: list[str]) -> DataFrame:
    """keys, Dte5 .. Dte1: the last five daily values, right-aligned; days without one are null."""
    rows = days.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("d", "pnl")), asc=False).alias("x"))
    return rows.select(*keys, *(F.get("x", F.lit(i))["pnl"].alias(f"Dte{i + 1}") for i in range(4, -1, -1)))


def daywise_leg(legs: DataFrame, keys: list[str], *, side: str, rate: float = 0.0) -> DataFrame:
    """keys, d, pnl of legs (keys, bars) held from their first bar to their last: the first day from the entry, then from close to close;
    slippage, a share of the first close, on the last day."""
    g = 1.0 if side == "SELL" else -1.0
    bars = legs.select(*keys, F.explode("bars").alias("b")).select(*keys, F.floor(F.col("b.t") / DAY_MINUTES).cast("int").alias("d"), "b.t", "b.close")
    per = bars.groupBy(*keys, "d").agg(F.min_by("close", "t").alias("o"), F.max_by("close", "t").alias("c"))
    rows = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("d", "o", "c"))).alias("e"))
    value = lambda e, y, i: g * (F.when(i == 0, y["o"]).otherwise(F.get(e, i - 1)["c"]) - y["c"]) - F.when(i == F.size(e) - 1, first(e)["o"] * rate).otherwise(0.0)
    split = let(F.col("e"), lambda e: F.transform(e, lambda y, i: F.struct(y["d"].alias("d"), value(e, y, i).alias("pnl"))))
    return rows.select(*keys, F.explode(split).alias("x")).select(*keys, "x.d", F.round("x.pnl", 4).alias("pnl"))
