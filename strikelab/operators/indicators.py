"""Technical indicators over series of any length, as column expressions.

A series (keys) may be cut into blocks (say, its days): each block is one row with an array of its bars, worked out in its
own task. Means that carry state (exponential, Wilder's) are affine in the value before a block, so a block's effect is two
numbers; one short pass over a series' blocks gives each its starting value. Without `block` a series is one block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikelab.functions.triggers import let
from strikelab.plans.lineage import cut

DAY = ("idx", "trade_date")
Names = tuple[str, ...]


def sma(bars: DataFrame, period: int, name: str, keys: Names = DAY) -> DataFrame:
    """The mean of the last `period` closes; null until there are as many."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(1 - period, 0)
    return bars.withColumn(name, F.when(F.count("close").over(w) == period, F.avg("close").over(w)))


def _blocks(bars: DataFrame, keys: Names, block: Names) -> DataFrame:
    """keys, block, _b (bars in order of t), _n (bars of the series before), _p (the close before); one row a block."""
    rest = [c for c in bars.columns if c not in (*keys, *block, "t")]
    rows = bars.groupBy(*keys, *block).agg(F.sort_array(F.collect_list(F.struct("t", *rest))).alias("_b"))
    if not block:
        return rows.withColumns({"_n": F.lit(0).cast("long"), "_p": F.lit(None).cast("double")})
    before = Window.partitionBy(*keys).orderBy(*block)
    n = F.coalesce(F.sum(F.size("_b")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"_n": n.cast("long"), "_p": F.lag(F.element_at("_b", -1)["close"]).over(before)})


def _unrolled(rows: DataFrame, bars: DataFrame, keys: Names, block: Names, arrays: dict[str, Column | str]) -> DataFrame:
    """bars' columns and an element of each array."""
    zipped = rows.select(*keys, *block, F.col("_b"), *((F.col(v) if isinstance(v, str) else v).alias(f"_{k}") for k, v in arrays.items()))
    at = F.transform("_b", lambda b, i: F.struct(b.alias("b"), *(F.get(f"_{k}", i).alias(k) for k in arrays)))
    out = zipped.select(*keys, *block, F.explode(at).alias("x"))
    return out.select(*(c if c in (*keys, *block) else F.col(f"x.b.{c}").alias(c) for c in bars.columns), *(f"x.{k}" for k in arrays))


def _kept(fold: Callable[[Column, Column], Column], begin: Column, kind: str, xs: Column, out: Callable[[Column], Column]) -> Column:
    """out of the state after each element; an array as long as xs."""
    state = lambda s, done: F.struct(s.alias("s"), done.alias("done"))
    step = lambda acc, x: let(fold(acc["s"], x), lambda s: state(s, F.concat(acc["done"], F.array(out(s)))))
    return F.aggregate(xs, state(begin, F.array().cast(f"array<{kind}>")), step)["done"]


def _mean(rows: DataFrame, keys: Names, block: Names, x: str, name: str, keep: float, first: int, seed: int, add: float | None = None) -> DataFrame:
    """rows with the array `name`: at bar first + seed - 1 the mean of `seed` values of the array x, from there on
    keep * before + add * x (1 - keep by default); null before."""
    add = 1 - keep if add is None else add
    at = first + seed - 1
    placed = rows.withColumn("_x", F.transform(x, lambda v, i: F.struct((F.col("_n") + i).alias("n"), v.cast("double").alias("v"))))
    inside = F.filter("_x", lambda e: (e["n"] >= first) & (e["n"] <= at))
    moved = lambda s, e: s * keep + e["v"] * add
    later = lambda xs: F.filter(xs, lambda e: e["n"] > at)
    total = F.aggregate(inside, F.lit(0.0), lambda a, e: a + e["v"])
    if block:
        place = F.struct(*block)
        short = placed.select(*keys, place.alias("_k"), total.alias("_t"), F.size(inside).alias("_c"), F.pow(F.lit(keep), F.size(later("_x"))).alias("_a"), F.aggregate(later("_x"), F.lit(0.0), moved).alias("_z"))
        one = short.groupBy(*keys).agg((F.sum("_t") / seed).alias("_s"), F.sum("_c").alias("_m"), F.sort_array(F.collect_list(F.struct("_k", "_a", "_z"))).alias("_l"))
        # A series' blocks in order, two numbers each: the value before each of them.
        starts = _kept(lambda s, e: F.struct(e["_k"].alias("_k"), s["next"].alias("_v"), (e["_a"] * s["next"] + e["_z"]).alias("next")), F.struct(F.lit(None).cast(placed.select(place.alias("_k")).schema["_k"].dataType).alias("_k"), F.lit(None).cast("double").alias("_v"), F.col("_s").alias("next")), f"struct<_k:{placed.select(place.alias('_k')).dtypes[0][1]},_v:double>", F.col("_l"), lambda s: F.struct(s["_k"], s["_v"].alias("_v")))
        began = one.where(F.col("_m") == seed).select(*keys, "_s", F.explode(starts).alias("_e")).select(*keys, F.col("_e._k").alias("_k"), F.col("_e._v").alias("_v"), "_s")
        placed = placed.withColumn("_k", place).join(began, [*keys, "_k"], "left").drop("_k")
    else:
        ok = F.size(inside) == seed
        placed = placed.withColumns({"_s": F.when(ok, total / seed), "_v": F.when(ok, total / seed)})
    fold = lambda s, e: F.when(e["n"] > at, moved(s, e)).otherwise(s)
    values = _kept(lambda s, e: F.struct(e["n"].alias("n"), F.when(e["n"] > at, fold(s["v"], e)).otherwise(s["v"]).alias("v")), F.struct(F.lit(-1).cast("long").alias("n"), F.col("_v").alias("v")), "double", F.col("_x"), lambda s: F.when(s["n"] >= at, s["v"]))
    return placed.withColumn(name, values).drop("_x", "_s", "_v")


def ema(bars: DataFrame, period: int, name: str, keys: Names = DAY, block: Names = ()) -> DataFrame:
    """The exponential mean of the closes, from the first bar on."""
    rows = _blocks(bars, keys, block).withColumn("_c", F.transform("_b", lambda b: b["close"]))
    return _unrolled(_mean(rows, keys, block, "_c", "_e", 1 - 2 / (period + 1), 0, 1, 2 / (period + 1)), bars, keys, block, {name: "_e"})


def moving_cross(bars: DataFrame, short: int, long: int, keys: Names = DAY, short_type: str = "NORMAL", long_type: str = "NORMAL", places: int = 9) -> DataFrame:
    """short_ma, long_ma (types NORMAL or EXPONENTIAL), signal (1 while the short mean is above), positions (its change), and what to
    buy and sell at a change (CE or PE, else empty); rows before both means exist go. Means are compared to `places` decimals:
    sums of other lengths leave equal means apart in their last bits."""
    of = {"NORMAL": sma, "EXPONENTIAL": ema}
    both = of[long_type](of[short_type](bars, short, "short_ma", keys), long, "long_ma", keys).where("short_ma IS NOT NULL AND long_ma IS NOT NULL")
    both = both.withColumn("signal", (F.round("short_ma", places) > F.round("long_ma", places)).cast("int"))
    both = both.withColumn("positions", F.col("signal") - F.lag("signal").over(Window.partitionBy(*keys).orderBy("t")))
    call = lambda up, down: F.when(F.col("positions") == 1, up).when(F.col("positions") == -1, down).when(F.col("positions") == 0, "")
    return both.withColumn("buy", call("CE", "PE")).withColumn("sell", call("PE", "CE"))


def _before(name: str) -> Callable[[Column], Column]:
    """The close before a block's i-th bar."""
    return lambda i: F.when(i == 0, F.col("_p")).otherwise(F.get("_b", i - 1)["close"])


def _ranges(rows: DataFrame) -> DataFrame:
    """rows with tr: the true ranges; the first bar's is its own."""
    before = _before("close")
    return rows.withColumn("_tr", F.transform("_b", lambda b, i: let(before(i), lambda p: F.greatest(b["high"] - b["low"], F.abs(b["high"] - p), F.abs(b["low"] - p)))))


def atr(bars: DataFrame, period: int = 10, keys: Names = DAY, block: Names = ()) -> DataFrame:
    rows = _mean(_ranges(_blocks(bars, keys, block)), keys, block, "_tr", "_atr", (period - 1) / period, 0, period)
    return _unrolled(rows, bars, keys, block, {"tr": "_tr", "atr": "_atr"})


def _changed(rows: DataFrame, array: str, keys: Names, block: Names) -> Column:
    """An array of the element before each, the last of the block before for the first."""
    first = F.lag(F.element_at(array, -1)).over(Window.partitionBy(*keys).orderBy(*block)) if block else F.lit(None)
    return F.concat(F.array(first.cast(dict(rows.dtypes)[array].removeprefix("array<").removesuffix(">"))), F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0))))


def _called(df: DataFrame, now: Column, before: Column, buy: dict[float, str], sell: dict[float, str]) -> DataFrame:
    """df with positions (the change of a signal, null where either is) and what to buy and sell; a change of 2 is told as a number."""

    def told(names: dict[float, str]) -> Column:
        out = F.col("positions").cast("string")
        for x, text in ({0.0: "", 1.0: "", -1.0: ""} | names).items():
            out = F.when(F.col("positions") == x, text).otherwise(out)
        return out

    return df.withColumn("positions", (now - before).cast("double")).withColumn("buy", told(buy)).withColumn("sell", told(sell))


_STATE = "struct<side:int,u:double,l:double>"


def supertrend(bars: DataFrame, period: int = 10, multiplier: float = 3.0, keys: Names = DAY, block: Names = ()) -> DataFrame:
    """up (1 or -1, from bar `period` on, null before), level (the band of the side at hand, from the bar after), positions, buy, sell.

    It starts up. A close beyond the last bar's band takes that side; on a bar without such a break the side's band only
    tightens. With blocks, each starts from the state that the one before ended in; states are passed on in rounds until
    none changes, which a break in a block ends early.
    """
    rows = _mean(_ranges(_blocks(bars, keys, block)), keys, block, "_tr", "_atr", (period - 1) / period, 0, period)
    band = F.transform("_b", lambda b, i: F.struct((F.col("_n") + i).alias("n"), b["close"].alias("c"), ((b["high"] + b["low"]) / 2 + multiplier * F.get("_atr", i)).alias("u"), ((b["high"] + b["low"]) / 2 - multiplier * F.get("_atr", i)).alias("l")))
    rows = rows.withColumn("_x", band)
    state = lambda side, u, l, level: F.struct(side.cast("int").alias("side"), u.alias("u"), l.alias("l"), level.cast("double").alias("level"))  # noqa: E731, E741

    def fold(s: Column, e: Column) -> Column:
        broke = F.when(e["c"] > s["u"], 1).when(e["c"] < s["l"], -1)

        def kept(x: Column) -> Column:
            side = F.coalesce(x, s["side"])
            u = F.when(x.isNull() & (side == -1), F.least(e["u"], s["u"])).otherwise(e["u"])
            l = F.when(x.isNull() & (side == 1), F.greatest(e["l"], s["l"])).otherwise(e["l"])  # noqa: E741
            return state(side, u, l, F.when(side == 1, l).otherwise(u))

        return F.when(e["n"] == period - 1, state(F.lit(1), e["u"], e["l"], F.lit(None))).when((e["n"] >= period) & s["side"].isNotNull(), let(broke, kept)).when(e["n"] >= period, state(F.lit(1), e["u"], e["l"], F.lit(None))).otherwise(state(F.lit(None), e["u"], e["l"], F.lit(None)))

    begin = lambda start: state(start["side"], start["u"], start["l"], F.lit(None))
    none = F.lit(None).cast(_STATE)
    rows = rows.withColumn("_start", none)
    if block:
        rows = cut(rows, "supertrend")
        before, ends = Window.partitionBy(*keys).orderBy(*block), lambda r: F.aggregate("_x", begin(F.col("_start")), fold)
        while True:
            ended = rows.withColumn("_end", ends(rows))
            passed = ended.withColumn("_new", F.lag(F.struct(F.col("_end.side").alias("side"), F.col("_end.u").alias("u"), F.col("_end.l").alias("l"))).over(before))
            passed = cut(passed.withColumn("_moved", ~F.col("_new").eqNullSafe(F.col("_start"))).drop("_end"), "supertrend")
            over = passed.where("_moved").isEmpty()
            rows = passed.withColumn("_start", F.col("_new")).drop("_new", "_moved")
            if over:
                break
    values = _kept(lambda s, e: fold(s, e), begin(F.col("_start")), "struct<side:int,level:double>", F.col("_x"), lambda s: F.struct(s["side"].alias("side"), s["level"].alias("level")))
    rows = rows.withColumn("_v", values).withColumn("_side", F.transform("_v", lambda v: v["side"]))
    rows = rows.withColumn("_was", _changed(rows, "_side", keys, block))
    out = _unrolled(rows, bars, keys, block, {"up": "_side", "level": F.transform("_v", lambda v: v["level"]), "_was": "_was"})
    return _called(out, F.col("up") / 2, F.col("_was") / 2, {1.0: "CE", -1.0: "PE"}, {1.0: "PE", -1.0: "CE"}).drop("_was")


def rsi(bars: DataFrame, period: int = 14, upper: float = 70.0, lower: float = 30.0, keys: Names = DAY, block: Names = ()) -> DataFrame:
    """rsi (null before bar period + 1 and where nothing has moved), signal (1 under lower, -1 over upper, else 0), positions, buy, sell."""
    rows, before = _blocks(bars, keys, block), _before("close")
    moved = lambda g: F.transform("_b", lambda b, i: F.coalesce(F.greatest(g * (b["close"] - before(i)), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumns({"_up": moved(1), "_down": moved(-1)})
    for x in ("_up", "_down"):
        rows = _mean(rows, keys, block, x, f"{x}_m", (period - 1) / period, 1, period)
    value = F.transform("_up_m", lambda u, i: let(F.get("_down_m", i), lambda d: F.when(d == 0, F.when(u > 0, 100.0)).otherwise(100 - 100 / (1 + F.try_divide(u, d)))))
    rows = rows.withColumn("_rsi", value).withColumn("_signal", F.transform("_rsi", lambda v: F.when(v < lower, 1).when(v > upper, -1).otherwise(0)))
    rows = rows.withColumn("_was", _changed(rows, "_signal", keys, block))
    out = _unrolled(rows, bars, keys, block, {"rsi": "_rsi", "signal": "_signal", "_was": "_was"})
    return _called(out, F.col("signal"), F.col("_was"), {1.0: "CE"}, {-1.0: "PE"}).drop("_was")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: Names = DAY, block: Names = ()) -> DataFrame:
    """macd, null for the first slow + signal - 2 bars, its signal line, signal - 1 bars later, their difference hist, and crossing (1,
    -1 or 0: which way macd has passed its line since the bar before, on which both must be valid), buy, sell."""
    first = slow + signal - 2
    rows = _blocks(bars, keys, block).withColumn("_c", F.transform("_b", lambda b: b["close"]))
    for name, n in (("_fast", fast), ("_slow", slow)):
        rows = _mean(rows, keys, block, "_c", name, 1 - 2 / (n + 1), 0, 1, 2 / (n + 1))
    rows = rows.withColumn("_line", F.transform("_fast", lambda v, i: F.when(F.col("_n") + i >= first, v - F.get("_slow", i))))
    rows = _mean(rows, keys, block, "_line", "_even", 1 - 2 / (signal + 1), first, 1, 2 / (signal + 1))
    rows = rows.withColumn("_sl", F.transform("_even", lambda v, i: F.when(F.col("_n") + i >= first + signal - 1, v))).withColumn("_hist", F.transform("_line", lambda v, i: v - F.get("_sl", i)))
    rows = rows.withColumn("_was", _changed(rows, "_hist", keys, block))
    out = _unrolled(rows, bars, keys, block, {"macd": "_line", "signal_line": "_sl", "hist": "_hist", "_was": "_was"})
    cross = F.when((F.col("hist") > 0) & (F.col("_was") <= 0), 1).when((F.col("hist") < 0) & (F.col("_was") >= 0), -1).otherwise(0)
    out = out.withColumn("crossing", cross).drop("_was")
    return out.withColumn("buy", F.when(F.col("crossing") == 1, "CE").otherwise("")).withColumn("sell", F.when(F.col("crossing") == -1, "PE").otherwise(""))
