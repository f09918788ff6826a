"""The steps that strategies are made of: choose, ask a leg, go another round.

A step asks each distinct question once (session, scrip, times, levels), joins it to the session's arrays, and joins the
answer back to the rows that asked: parameter sets that agree on a question share its work, and no row carries bars.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelab.functions.scalars import one_om
from strikelab.functions.triggers import both_legs, first
from strikelab.operators import strikes
from strikelab.plans.lineage import cut

DAY = ["idx", "trade_date"]
#: Minutes from one day of a week to the next.
DAY_MINUTES = 1440


class Keys:
    """The columns of a question by name."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


@dataclass
class Desk:
    """What a strategy looks up: legs (bars of each scrip and session), menus (choices of each session and om), futures
    (each session's minutes), options (rows, for choices by a target premium).

    A session is a day, from minute `first` to `last`; or a week, whose minutes go on from day to day by DAY_MINUTES, with
    `days` (idx, trade_date: its first day, dtes: an array with its days' dte) and flat opening bars.
    """

    legs: DataFrame
    menus: DataFrame
    futures: DataFrame
    options: DataFrame
    gap: float
    rate: Column | float = 0.01
    tick: Column | None = None
    step: Column | None = None
    strangles: dict[str, tuple[float, bool]] = field(default_factory=dict)
    first: int = 0
    last: int = 1439
    days: DataFrame | None = None

    @property
    def opens(self) -> Callable[[Column], Column] | None:
        """In weeks, whether a bar opens a day: stops on it fill at its close."""
        return None if self.days is None else lambda x: x["t"] % DAY_MINUTES == self.first


def scrip_of(strike: Column, kind: str) -> Column:
    """The scrip's name, as 1000CE."""
    return F.concat(strike.cast("int").cast("string"), F.lit(kind))


def menu(choice: DataFrame, om: str) -> DataFrame:
    """idx, trade_date, om, picks: a session's valid choices (t, future, ce, pe, ce_price, pe_price) in order of time."""
    legs = [F.col("strike"), F.col("strike")] if "strike" in choice.columns else [F.col("ce_strike"), F.col("pe_strike")]
    pick = F.struct(F.col("t").cast("int").alias("t"), "future", scrip_of(legs[0], "CE").alias("ce"), scrip_of(legs[1], "PE").alias("pe"), F.col("ce").alias("ce_price"), F.col("pe").alias("pe_price"))
    return choice.select(*DAY, pick.alias("p")).groupBy(*DAY).agg(F.sort_array(F.collect_list("p")).alias("picks")).withColumn("om", F.lit(om))


def session_bars(futures: DataFrame) -> DataFrame:
    """idx, trade_date, fut: the session's (t, high, low, close) in order of time."""
    bar = F.struct(F.col("t").cast("int").alias("t"), "high", "low", "close")
    return futures.groupBy(*DAY).agg(F.sort_array(F.collect_list(bar)).alias("fut"))


def answered(rows: DataFrame, key: dict[str, Column], answer: Callable[[DataFrame], DataFrame], name: str, kept: bool = False) -> DataFrame:
    """rows with `name`: answer's column of that name for the row's key. answer gets the distinct keys, as _key and its fields."""
    return answered_each(rows, {name: key}, answer, kept)


def answered_each(rows: DataFrame, keys: dict[str, dict[str, Column]], answer: Callable[[DataFrame], DataFrame], kept: bool = False) -> DataFrame:
    """rows with a column for each name of keys: the answer to that key. All keys have the same fields, so their questions are one set of
    distinct ones; answer's column has the first name.

    The rows are read by the questions and by the answers' way back. So they are stored first, and a strategy's plan grows by
    one such step at a time; kept: they are a narrow view of a stored table, or short, and are just read twice.
    """
    keyed = rows.withColumns({f"_{n}": F.struct(*(c.alias(k) for k, c in key.items())) for n, key in keys.items()})
    keyed = keyed if kept else cut(keyed, "asked")
    first_name = next(iter(keys))
    asked = keyed.select(F.col(f"_{first_name}").alias("_key")) if len(keys) == 1 else keyed.select(F.explode(F.array(*(f"_{n}" for n in keys))).alias("_key"))
    found = answer(asked.distinct().select("_key", "_key.*")).select("_key", F.col(first_name).alias("_answer"))
    found = found if len(keys) == 1 else cut(found, "answers")
    for n in keys:
        keyed = keyed.join(found.select(F.col("_key").alias(f"_{n}"), F.col("_answer").alias(n)), f"_{n}", "left").drop(f"_{n}")
    return keyed


def session(**key: Column) -> dict[str, Column]:
    return {"idx": F.col("idx"), "trade_date": F.col("trade_date")} | key


def ask_leg(rows: DataFrame, desk: Desk, name: str, scrip: Column, f: Callable[[Column, Keys], Column], **key: Column) -> DataFrame:
    """rows with `name`: f of the scrip's bars (null without any) and the key's columns."""
    return ask_legs(rows, desk, f, {name: {"scrip": scrip} | key})


def ask_legs(rows: DataFrame, desk: Desk, f: Callable[[Column, Keys], Column], keys: dict[str, dict[str, Column]]) -> DataFrame:
    """rows with a column for each name of keys, as ask_leg; a key has its scrip."""
    name = next(iter(keys))
    return answered_each(rows, {n: session(**key) for n, key in keys.items()}, lambda q: q.join(desk.legs, [*DAY, "scrip"], "left").select("_key", f(F.col("bars"), Keys()).alias(name)))


def ask_pair(rows: DataFrame, desk: Desk, name: str, ce: Column, pe: Column, f: Callable[[Column, Column, Keys], Column], **key: Column) -> DataFrame:
    """rows with `name`: f of the bars of both scrips and the key's columns."""
    leg = lambda k: desk.legs.select(*DAY, F.col("scrip").alias(k), F.col("bars").alias(f"{k}_bars"))
    return answered(rows, session(ce=ce, pe=pe, **key), lambda q: q.join(leg("ce"), [*DAY, "ce"], "left").join(leg("pe"), [*DAY, "pe"], "left").select("_key", f(F.col("ce_bars"), F.col("pe_bars"), Keys()).alias(name)), name)


def ask_futures(rows: DataFrame, desk: Desk, name: str, f: Callable[[Column, Keys], Column], **key: Column) -> DataFrame:
    """rows with `name`: f of the session's futures bars and the key's columns."""
    return answered(rows, session(**key), lambda q: q.join(desk.futures, DAY).select("_key", f(F.col("fut"), Keys()).alias(name)), name)


def enter(rows: DataFrame, desk: Desk, name: str = "pick", *, om: Column | None = None, start: Column | None = None, end: Column | None = None, kept: bool = False) -> DataFrame:
    """rows with `name`: the first choice of the row's om from start to end; null without one, or without a start."""
    if desk.strangles:
        return _enter_any(rows, desk, name, F.col("om") if om is None else om, F.col("start") if start is None else start, F.col("end") if end is None else end)
    key = session(om=F.col("om") if om is None else om, start=F.col("start") if start is None else start, end=F.col("end") if end is None else end)
    # In a week the search stays on its day, but the next day's first minute is still tried.
    until = F.col("end") if desk.days is None else F.least(F.col("end"), (F.floor(F.col("start") / DAY_MINUTES) + 1) * DAY_MINUTES + desk.first)
    fits = lambda p: F.coalesce((p["t"] >= F.col("start")) & (p["t"] <= until), F.lit(False))
    return answered(rows, key, lambda q: q.join(desk.menus, [*DAY, "om"]).select("_key", first(F.filter("picks", fits)).alias(name)), name, kept)


def _enter_any(rows: DataFrame, desk: Desk, name: str, om: Column, start: Column, end: Column) -> DataFrame:
    """enter where some oms are strangles by the premium unit: the unit is that of the first future from start on, and is kept for the
    whole search; an inverted strangle becomes the first straddle from its minute on."""
    plain = replace(desk, strangles={})
    of = lambda i: F.coalesce(*(F.when(om == k, F.lit(v[i])) for k, v in desk.strangles.items()))
    rows = enter(rows, plain, "_menu", om=om, start=start, end=end)
    rows = ask_futures(rows.withColumns({"_unit": of(0), "_flips": of(1)}), desk, "_first", lambda f, k: first(F.filter(f, lambda b: b["t"] >= k.start))["close"], start=F.when(F.col("_unit").isNotNull(), start))
    rows = enter_at_target(rows, desk, "strangle", end, _wide=(F.when(F.col("_unit").isNotNull(), start), one_om(F.col("_first"), F.lit(None).cast("double") if desk.step is None else desk.step) * F.col("_unit")))
    strike = lambda k: F.regexp_extract(F.col(f"_wide.{k}"), r"^(.*)..$", 1).cast("double")
    rows = rows.withColumn("_flip", F.coalesce(F.col("_flips") & (strike("ce") < strike("pe")), F.lit(False)))
    rows = enter(rows, plain, "_straddle", om=F.lit("0"), start=F.when(F.col("_flip"), F.col("_wide.t")), end=end)
    picked = F.coalesce(F.col("_menu"), F.when(F.col("_flip"), F.col("_straddle")).otherwise(F.col("_wide")))
    return rows.withColumn(name, picked).drop("_menu", "_unit", "_flips", "_first", "_wide", "_flip", "_straddle")


def enter_pair(rows: DataFrame, desk: Desk, name: str, om: Column, om2: Column, start: Column, end: Column) -> DataFrame:
    """rows with `name`: (t, a, b, before) at the first minute at which both choices are valid; before: the last minute
    before it, from start on, at which the first choice alone was."""
    second = desk.menus.select(*DAY, F.col("om").alias("om2"), F.col("picks").alias("picks2"))
    inside = lambda p: F.coalesce((p["t"] >= F.col("start")) & (p["t"] <= F.col("end")), F.lit(False))

    def answer(q: DataFrame) -> DataFrame:
        both = q.join(desk.menus, [*DAY, "om"]).join(second, [*DAY, "om2"])
        met = both_legs(F.filter("picks", inside), F.filter("picks2", inside), lambda a, b: F.struct(a["t"].alias("t"), a.alias("a"), b.alias("b")))
        both = both.select("_key", "picks", "start", first(met).alias("m"))
        before = F.try_element_at(F.filter("picks", lambda p: (p["t"] >= F.col("start")) & (p["t"] < F.col("m.t"))), F.lit(-1))["t"]
        return both.select("_key", F.when(F.col("m").isNotNull(), F.struct("m.t", "m.a", "m.b", before.alias("before"))).alias(name))

    return answered(rows, session(om=om, om2=om2, start=start, end=end), answer, name)


def enter_at_target(rows: DataFrame, desk: Desk, kind: str, end: Column, **asked: tuple[Column, Column]) -> DataFrame:
    """rows with a column for each of asked, name=(start, target): the first choice from start to end by a target premium, as a
    menu's pick.

    kind: `strangle` (above the target, balanced) or `above` or `closest` (each side's nearest premium). All questions are
    one set of distinct keys. Nearly always the first minutes decide, so these are tried first and the rest of the session
    only for what they leave open. The rows and answers are stored, as both are read more than once.
    """

    def chosen(cand: DataFrame) -> DataFrame:
        targets = cand.select(*DAY, "t", "target").distinct()
        found = strikes.strangle(desk.options, targets, desk.gap) if kind == "strangle" else strikes.nearest_premium(desk.options, targets, kind)
        pick = F.struct("t", "future", scrip_of(F.col("ce_strike"), "CE").alias("ce"), scrip_of(F.col("pe_strike"), "PE").alias("pe"), F.col("ce").alias("ce_price"), F.col("pe").alias("pe_price"))
        return cand.join(found, [*DAY, "t", "target"]).groupBy("_key").agg(F.min(pick).alias("_pick"))

    keyed = rows
    for name, (start, target) in asked.items():
        keyed = keyed.withColumn(f"_{name}", F.when(start.isNotNull() & target.isNotNull(), F.struct("idx", "trade_date", start.cast("int").alias("start"), end.cast("int").alias("end"), target.alias("target"))))
    keyed = cut(keyed, "target-rows")
    keys = reduce(DataFrame.unionByName, (keyed.select(F.col(f"_{name}").alias("_key")) for name in asked)).where("_key IS NOT NULL").distinct()
    q = keys.select("_key", "_key.*").join(desk.futures, DAY)
    minutes = q.select("_key", *DAY, "target", F.filter("fut", lambda b: (b["t"] >= F.col("start")) & (b["t"] <= F.col("end"))).alias("fut"))
    part = lambda df, bars: df.select("_key", *DAY, "target", F.explode_outer(bars).alias("b")).select("_key", *DAY, "target", F.col("b.t").alias("t"), F.col("b.close").alias("future"))
    soon = cut(chosen(part(minutes, F.slice("fut", 1, 3))), "target-soon")
    open_ = minutes.join(soon.select("_key"), "_key", "left_anti")
    found = soon if open_.isEmpty() else soon.unionByName(chosen(part(open_, F.slice(F.col("fut"), F.lit(4), F.greatest(F.size("fut"), F.lit(0))))))
    for name in asked:
        keyed = keyed.join(found.select(F.col("_key").alias(f"_{name}"), F.col("_pick").alias(name)), f"_{name}", "left").drop(f"_{name}")
    return keyed


def rounds(rows: DataFrame, step: Callable[[DataFrame, int], DataFrame], most: int, out: list[str], name: str) -> DataFrame:
    """The rows of every round, with `round`; step gives each round's rows, and `live` for those that go on.

    Each round is a stored table, so that a chain of any length has a short plan and lost work is one round's; it ends
    when nothing is live. out: the columns to return.
    """
    done = []
    for n in range(most + 1):
        now = cut(step(rows, n), f"{name}-{n}")
        done.append(now.withColumn("round", F.lit(n)).select("round", *out))
        rows = now.where("live")
        if n < most and rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)
