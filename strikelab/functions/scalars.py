"""Column functions of the price and parameter rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Index, market, slippage as a share of the price, premium step, tick.
INSTRUMENTS = [
    ("IDX0", "NSE", 0.01, 5000.0, 0.05),
    ("IDX1", "MCX", 0.005, 100.0, 1.0),
]


def near(x: Column, gap: Column | float) -> Column:
    """x rounded to a multiple of gap, ties to even."""
    gap = gap if isinstance(gap, Column) else F.lit(float(gap))
    return F.rint(x / gap) * gap


def money(x: Column) -> Column:
    """x to two places, ties to even."""
    return F.rint(x * 100) / 100 + 0.0


def strike_of(scrip: Column) -> Column:
    return F.regexp_extract(scrip, r"^(.*)..$", 1).cast("double")


def type_of(scrip: Column) -> Column:
    return F.regexp_extract(scrip, r"(..)$", 1)


def om_kind(om: Column) -> Column:
    """What a strike choice asks for: strangle, sd, atm, atms, premium or percent; null if it can't be read."""
    s = F.upper(F.replace(F.regexp_replace(om, "(?i)-I$", ""), F.lit(" "), F.lit("")))
    number = r"^[+-]?\d+(\.\d+)?$"
    return (
        F.when(s.rlike(r"^[+-]?\d+(\.\d+)?SD$"), "sd").when(s.rlike(r"^ATMS([+-]\d+(\.\d+)?%?)?$"), "atms").when(s.rlike(r"^ATM([+-]\d+(\.\d+)?%?)?$"), "atm")
        .when(s.rlike(r"^P[<>=]\d+(\.\d+)?$"), F.concat(F.lit("premium"), F.substring(s, 2, 1))).when(s.rlike(r"^\d+(\.\d+)?%$"), "percent").when(s.rlike(number) & (s.cast("double") == 0), "atm").when(s.rlike(number), "strangle")
    )


def om_value(om: Column) -> Column:
    """The number of a strike choice; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(om, r"([+-]?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double"), F.lit(0.0))


def om_checks_inverted(om: Column) -> Column:
    return om.rlike("(?i)-I$")


def one_om(price: Column, step: Column) -> Column:
    """Premium unit: a hundredth of the price's whole steps; without a step (null) 1 % of the rounded price."""
    return F.coalesce(F.floor(price / step) * step, F.rint(price)) / 100


def to_tick(x: Column, tick: Column, side: Column, order: Column) -> Column:
    """Up for a seller's stop and a buyer's target or decay, down for the others; then two places."""
    up = ((side == "SELL") & (order == "STOPLOSS")) | ((side == "BUY") & (order != "STOPLOSS"))
    n = F.round(x / tick, 6)
    return F.round(F.when(up, F.ceil(n)).otherwise(F.floor(n)) * tick, 2)


def ticked(x: Column, tick: Column | None, up: Column) -> Column:
    """x to a whole number of ticks, up or down, and two places; as it is without a tick (None or null)."""
    if tick is None:
        return x
    n = F.round(x / tick, 6)
    return F.when(tick.isNull(), x).otherwise(F.round(F.when(up, F.ceil(n)).otherwise(F.floor(n)) * tick, 2))


def instrument(field: str, idx: str = "idx") -> Column:
    """An index's slippage rate, tick (of MCX indices, which always round; else null) or step (of these too), from the fixed values."""
    values = {i: {"rate": rate, "tick": tick if market == "MCX" else None, "step": step if market == "MCX" else None}[field] for i, market, rate, step, tick in INSTRUMENTS}
    out = F.lit(0.01 if field == "rate" else None).cast("double")
    for i, v in values.items():
        out = F.when(F.col(idx) == i, F.lit(v).cast("double")).otherwise(out)
    return out


def percent_of(price: Column, percent: Column) -> Column:
    return price * percent / 100


def number_label(text: Column) -> Column:
    """Canonical text of a number; other text as it is."""
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text.cast("double").cast("string")).otherwise(text)


def synthetic_future(strike: Column, ce: Column, pe: Column) -> Column:
    return strike + ce - pe


def band(strike: Column, premium: Column, percent: Column) -> tuple[Column, Column]:
    """Lower and upper edge; null where percent is 0."""
    width = F.when(percent > 0, premium * percent / 100)
    return strike - width, strike + width


def pivots(h: Column, l: Column, c: Column) -> dict[str, Column]:
    """Floor pivots of a day's high, low and close, to two places."""
    p = (h + l + c) / 3
    up, down = [2 * p - l, p + (h - l), h + 2 * (p - l)], [2 * p - h, p - (h - l), l - 2 * (h - p)]
    for levels in (up, down):  # the fourth and fifth lie as far out as the levels two before them lie apart
        levels.append(levels[2] + levels[1] - levels[0])
        levels.append(levels[3] + levels[2] - levels[1])
    return {"p": money(p)} | {f"r{i + 1}": money(x) for i, x in enumerate(up)} | {f"s{i + 1}": money(x) for i, x in enumerate(down)}


def order_key(label: Column) -> Column:
    """Sorts plain numbers first, numbers with a suffix next by suffix and number, then other text."""
    number = F.regexp_extract(label, r"^([+-]?\d+(?:\.\d+)?)", 1)
    suffix = F.regexp_extract(label, r"^[+-]?\d+(?:\.\d+)?(.*)$", 1)
    kind = F.when(number == "", 2).when(suffix == "", 0).otherwise(1)
    return F.struct(kind.alias("kind"), F.when(kind == 1, suffix).otherwise("").alias("suffix"), F.coalesce(F.nullif(number, F.lit("")).cast("double"), F.lit(0.0)).alias("number"), F.when(kind == 2, label).otherwise("").alias("text"))
