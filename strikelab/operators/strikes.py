"""Strike choice: for every minute once, then the first minute from an entry on at which the choice is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikelab.functions.scalars import near, one_om

KEY = ["idx", "trade_date", "t"]


def strike_gap(options: DataFrame) -> DataFrame:
    """idx, trade_date, gap: the smallest difference between distinct strikes of the day."""
    days = Window.partitionBy("idx", "trade_date").orderBy("strike")
    steps = options.select("idx", "trade_date", "strike").distinct().withColumn("gap", F.col("strike") - F.lag("strike").over(days))
    return steps.groupBy("idx", "trade_date").agg(F.min("gap").alias("gap"))


def on_grid(options: DataFrame, gap: float, slack: float = 1e-6) -> DataFrame:
    """The rows whose strike is a multiple of gap."""
    return options.where(F.abs(F.col("strike") - near(F.col("strike"), gap)) < slack)


def side_by_side(options: DataFrame) -> DataFrame:
    """idx, trade_date, t, strike, ce, pe: closes of both types at one strike."""
    of = lambda kind: F.max(F.when(F.col("opt_type") == kind, F.col("close")))
    return options.groupBy(*KEY, "strike").agg(of("CE").alias("ce"), of("PE").alias("pe"))


def atm(futures: DataFrame, options: DataFrame, gap: float, *, spot: bool = False) -> DataFrame:
    """idx, trade_date, t, future, strike, ce, pe for every minute with a valid choice.

    From the strike nearest to the future the synthetic future is formed; of the strike nearest to that, one gap up and
    one gap down, the one whose call and put are closest is chosen, ties in that order. spot: the strike nearest to the
    given price, without the test.
    """
    wide = side_by_side(options)
    both = wide.where("ce IS NOT NULL AND pe IS NOT NULL")
    start = futures.select(*KEY, F.col("close").alias("future"), near(F.col("close"), gap).alias("strike")).join(both, [*KEY, "strike"])
    if spot:
        return start.select(*KEY, "future", "strike", "ce", "pe")
    centre = near(F.col("ce") - F.col("pe") + F.col("strike"), gap)
    tries = start.select(*KEY, "future", F.posexplode(F.array(centre, centre + gap, centre - gap)).alias("i", "strike")).join(both, [*KEY, "strike"])
    best = tries.groupBy(*KEY, "future").agg(F.min(F.struct(F.abs(F.col("ce") - F.col("pe")).alias("d"), "i", "strike", "ce", "pe")).alias("b"))
    return best.select(*KEY, "future", "b.strike", "b.ce", "b.pe")


def shifted(choice: DataFrame, options: DataFrame, up: Column) -> DataFrame:
    """The choice with the call `up` higher and the put as much lower, where both have a price: ce_strike, pe_strike, ce, pe."""
    wide = side_by_side(options)
    legs = choice.withColumn("ce_strike", F.col("strike") + up).withColumn("pe_strike", F.col("strike") - up).drop("ce", "pe", "strike")
    ce = wide.where("ce IS NOT NULL").select(*KEY, F.col("strike").alias("ce_strike"), "ce")
    pe = wide.where("pe IS NOT NULL").select(*KEY, F.col("strike").alias("pe_strike"), "pe")
    return legs.join(ce, [*KEY, "ce_strike"]).join(pe, [*KEY, "pe_strike"])


def sd_shift(factor: float, gap: float, round_off: bool = False) -> Column:
    """How far sd moves the legs: a multiple of the straddle's premium to the nearest gap, one gap at least unless round_off."""
    wide = near(F.abs((F.col("ce") + F.col("pe")) * factor), gap)
    return (1 if factor > 0 else -1) * (wide if round_off else F.greatest(F.lit(float(gap)), wide))


def nearest_premium(options: DataFrame, targets: DataFrame, pick: str = "above", factor: float = 1.0) -> DataFrame:
    """For each row of targets (idx, trade_date, t, target, ...) the strikes and prices of the call and put nearest to target * factor.

    above: the cheapest that costs as much; below: the dearest that does not cost more; closest: either way. Of equals the
    lower strike. Both sides must exist.
    """
    goal = F.col("target") * factor
    rows = targets.join(options.select(*KEY, "opt_type", "strike", "close"), KEY)
    if pick != "closest":
        rows = rows.where(F.col("close") >= goal if pick == "above" else F.col("close") <= goal)
    far = F.abs(F.col("close") - goal)
    of = lambda kind: F.min(F.when(F.col("opt_type") == kind, F.struct(far.alias("d"), "strike", "close")))
    best = rows.groupBy(*targets.columns).agg(of("CE").alias("c"), of("PE").alias("p")).where("c IS NOT NULL AND p IS NOT NULL")
    return best.select(*targets.columns, F.col("c.strike").alias("ce_strike"), F.col("p.strike").alias("pe_strike"), F.col("c.close").alias("ce"), F.col("p.close").alias("pe"))


def strangle(options: DataFrame, targets: DataFrame, gap: float, pick: str = "above", factor: float = 1.0, low: float = 2.0, high: float = 3.0) -> DataFrame:
    """The nearest premiums, then the best balanced of five pairs: as found, put or call a gap down, put or call a gap up.

    A pair's sum must lie in [low * target * factor, high * target]; a strike without a price counts as 0; of equals the
    first. A leg is found by its price, so of equal prices the earlier candidate's strike is meant, and a leg at price 0
    has none.
    """
    near_ = nearest_premium(options, targets, pick, factor).drop("ce", "pe")
    wide = side_by_side(options).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("strike", F.struct("ce", "pe")))).alias("at"))
    rows = near_.join(wide, KEY)
    price = lambda strike, kind: F.coalesce(F.try_element_at("at", strike)[kind], F.lit(0.0))
    steps = [0.0, -gap, gap]
    rows = rows.withColumn("cs", F.array(*(F.col("ce_strike") + s for s in steps))).withColumn("ps", F.array(*(F.col("pe_strike") + s for s in steps)))
    rows = rows.withColumn("cp", F.array(*(price(F.col("ce_strike") + s, "ce") for s in steps))).withColumn("pp", F.array(*(price(F.col("pe_strike") + s, "pe") for s in steps)))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col("cp")[c].alias("ce"), F.col("pp")[p].alias("pe")) for i, (c, p) in enumerate([(0, 0), (0, 1), (1, 0), (0, 2), (2, 0)])))
    fits = F.filter(pairs, lambda x: (x["ce"] + x["pe"] >= F.col("target") * low * factor) & (x["ce"] + x["pe"] <= F.col("target") * high))
    best = F.array_min(F.transform(fits, lambda x: F.struct(F.abs(x["ce"] - x["pe"]).alias("d"), x["i"].alias("i"), x["ce"].alias("ce"), x["pe"].alias("pe"))))
    rows = rows.withColumn("b", best).where("b IS NOT NULL AND b.ce > 0 AND b.pe > 0")
    strike = lambda prices, strikes, p: F.element_at(strikes, F.array_position(prices, p).cast("int"))
    return rows.select(*targets.columns, strike(F.col("cp"), F.col("cs"), F.col("b.ce")).alias("ce_strike"), strike(F.col("pp"), F.col("ps"), F.col("b.pe")).alias("pe_strike"), F.col("b.ce").alias("ce"), F.col("b.pe").alias("pe"))


def upright(choice: DataFrame, straddles: DataFrame) -> DataFrame:
    """Choices whose call strike lies under the put strike, replaced by the minute's straddle; without one they go."""
    s = straddles.select(*KEY, F.col("strike").alias("_k"), F.col("ce").alias("_c"), F.col("pe").alias("_p"))
    flip = F.col("ce_strike") < F.col("pe_strike")
    rows = choice.join(s, KEY, "left").where(~flip | F.col("_k").isNotNull())
    new = {"ce_strike": "_k", "pe_strike": "_k", "ce": "_c", "pe": "_p"}
    return rows.withColumn("inverted", flip).select("*", *(F.when(F.col("inverted"), F.col(b)).otherwise(F.col(a)).alias(f"_{a}") for a, b in new.items())).drop(*new, "_k", "_c", "_p").withColumnsRenamed({f"_{a}": a for a in new})


def first_valid(choice: DataFrame, entries: DataFrame, on: list[str] | None = None) -> DataFrame:
    """entries (idx, trade_date, start, end, ...) with the first choice at start or later, up to end; entries without one go.

    Each distinct (session, start, end) is looked up once, in the session's choices as one array in order of time.
    """
    on = on or ["idx", "trade_date"]
    key = [*on, "start", "end"]
    others = [c for c in choice.columns if c not in (*on, "t")]
    menu = choice.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("t", *others))).alias("_c"))
    asked = entries.select(*key).distinct().join(menu, on)
    found = asked.select(*key, F.try_element_at(F.filter("_c", lambda x: (x["t"] >= F.col("start")) & (x["t"] <= F.col("end"))), F.lit(1)).alias("_f"))
    return entries.join(found.where("_f IS NOT NULL"), key).select(*entries.columns, *(F.col(f"_f.{c}").alias(c) for c in choice.columns if c not in on))


def last_valid(choice: DataFrame, last: int, minutes: int = 15) -> DataFrame:
    """idx, trade_date and the last choice in the final minutes of the day."""
    rest = [c for c in choice.columns if c not in ("idx", "trade_date")]
    rows = choice.where((F.col("t") > last - minutes) & (F.col("t") <= last))
    return rows.groupBy("idx", "trade_date").agg(F.max_by(F.struct(*rest), "t").alias("_f")).select("idx", "trade_date", "_f.*")


def price_at(options: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (idx, trade_date, scrip, at, ...) with exact (the close at that minute) and price (the last close up to it)."""
    bars = options.select("idx", "trade_date", "scrip", "t", "close")
    rows = asked.join(bars, ["idx", "trade_date", "scrip"], "left")
    upto = F.col("t") <= F.col("at")
    return rows.groupBy(*asked.columns).agg(F.max(F.when(F.col("t") == F.col("at"), F.col("close"))).alias("exact"), F.max_by(F.when(upto, F.col("close")), F.when(upto, F.col("t"))).alias("price"))


def strangle_spec(om: str) -> tuple[float, bool] | None:
    """(multiple of the premium unit, whether inverted ones become straddles) of specs like 1.5, 50% or 2-I; None for others."""
    spec = om.upper().replace(" ", "")
    inverted, spec = spec.endswith("-I"), spec.removesuffix("-I")
    try:
        value = float(spec.removesuffix("%")) / (100 if spec.endswith("%") else 1)
    except ValueError:
        return None
    return (value, inverted) if value > 0 else None


def by_om(futures: DataFrame, options: DataFrame, om: str, gap: float, step: float | None = None) -> DataFrame:
    """Every minute's choice by a strike spec: 0 or ATM, ATM+1, ATM-2, ATM+1.5%, ATMS (and with an offset), 1SD, -0.5SD, 1.5 (a strangle
    of so many premium units), P>50, P<50, P=50, 50% (the README's share of a premium unit); -I at its end: an inverted
    strangle becomes the straddle. A strangle's unit is here that of its own minute; for a search that keeps its first minute's
    unit see plans.steps.enter. ce_strike, pe_strike, ce, pe with t and future; strike where both are one.
    """
    spec = om.upper().replace(" ", "")
    inverted, spec = spec.endswith("-I"), spec.removesuffix("-I")
    at = futures.select(*KEY, F.col("close").alias("future"))
    if spec.startswith("P") and spec[1] in "<>=":
        pick = {"<": "below", ">": "above", "=": "closest"}[spec[1]]
        targets = at.withColumn("target", F.lit(float(spec[2:])))
        return nearest_premium(options, targets, pick).drop("target")
    if spec.endswith("SD"):
        factor = float(spec[:-2])
        middle = atm(futures, options, gap)
        return shifted(middle.withColumn("up", sd_shift(factor, gap)), options, F.col("up")).drop("up") if factor else middle
    if spec.startswith("ATM"):
        spot = spec.startswith("ATMS")
        middle, off = atm(futures, options, gap, spot=spot), spec[4 if spot else 3 :]
        if not off:
            return middle
        up = near(F.col("strike") * float(off[:-1]) / 100, gap) if off.endswith("%") else F.lit(float(off) * gap)
        return shifted(middle, options, up)
    value = float(spec.removesuffix("%")) / (100 if spec.endswith("%") else 1)
    if value <= 0:
        return atm(futures, options, gap)
    unit = one_om(F.col("future"), F.lit(step).cast("double"))
    targets = at.withColumn("target", unit * value)
    found = strangle(options, targets, gap).drop("target")
    return upright(found, atm(futures, options, gap)).drop("inverted") if inverted else found
