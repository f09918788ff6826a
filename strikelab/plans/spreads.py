"""Spreads whose exit is decided on spot bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikelab.functions.scalars import money, near, pivots, strike_of
from strikelab.functions.triggers import close_at, first, let, stop
from strikelab.plans.steps import DAY, Desk, answered, ask_legs, session
from strikelab.plans.strategies import picked, pnl

#: The levels from the lowest to the highest.
LEVELS = ["s5", "s4", "s3", "s2", "s1", "p", "r1", "r2", "r3", "r4", "r5"]


def day_levels(spot: DataFrame) -> DataFrame:
    """idx, trade_date and levels: the floor pivots of the session before, of its spot bars, as an array; days without one go.

    One row a day goes through the window.
    """
    days = spot.groupBy(*DAY).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "t").alias("c"))
    before = Window.partitionBy("idx").orderBy("trade_date")
    last_ = days.select(*DAY, *(F.lag(x).over(before).alias(x) for x in ("h", "l", "c"))).where("c IS NOT NULL")
    of = pivots(F.col("h"), F.col("l"), F.col("c"))
    return last_.select(*DAY, F.array(*(of[x] for x in LEVELS)).alias("levels"))


def butterfly(entries: DataFrame, desk: Desk, spot: DataFrame, levels: DataFrame) -> DataFrame:
    """A long 1-2-1 butterfly on the side that spot's place about yesterday's pivot says: puts below it, calls above.

    entries: start, end, om, width (percent of the straddle's premium between strikes, a gap at least). spot: (idx,
    trade_date, spot: bars). It ends at the first spot bar between the entry and the end that closes beyond the body's
    strike, or beyond the second level behind the price, else at the end. No row: no spot bar at the entry, a price
    outside the outer levels or on the pivot, or no second level.
    """
    rows = picked(entries, desk).withColumn("k", strike_of(F.col("pick.ce")))
    premium = F.col("pick.ce_price") + F.col("pick.pe_price")
    rows = rows.withColumn("wing", F.greatest(near(premium * F.col("width") / 100, desk.gap), F.lit(float(desk.gap))))

    def judged(q: DataFrame) -> DataFrame:
        q = q.join(spot, DAY).join(levels, DAY)
        now = close_at(F.col("spot"), F.col("start"))
        centre = F.element_at("levels", LEVELS.index("p") + 1)

        def placed(price: Column) -> Column:
            inside = (price <= F.element_at("levels", -1)) & (price >= F.element_at("levels", 1))
            kind = F.when(inside & (price < centre), "PE").when(inside & (price > centre), "CE")
            down = kind == "PE"
            body = F.when(down, F.when(F.col("wing") == desk.gap, F.col("k")).otherwise(F.col("k") + desk.gap) - F.col("wing")).otherwise(F.col("k") + F.col("wing"))
            behind = F.when(down, F.get(F.filter("levels", lambda x: x > price), F.lit(1))).otherwise(F.try_element_at(F.filter("levels", lambda x: x < price), F.lit(-2)))
            return let(F.struct(price.alias("price"), kind.alias("kind"), body.alias("body"), behind.alias("behind")), ended)

        def ended(x: Column) -> Column:
            g = F.when(x["kind"] == "PE", -1.0).otherwise(1.0)
            out = first(F.filter("spot", lambda b: (b["t"] > F.col("start")) & (b["t"] < F.col("end")) & ((g * b["close"] > g * x["body"]) | (g * b["close"] < g * x["behind"]))))
            return F.when(x["kind"].isNotNull() & x["behind"].isNotNull(), F.struct(x["price"].alias("price"), x["kind"].alias("kind"), x["body"].alias("body"), x["behind"].alias("behind"), F.coalesce(out["t"], F.col("end")).alias("t")))

        return q.select("_key", let(now, placed).alias("b"))

    rows = answered(rows, session(start=F.col("pick.t"), end=F.col("end"), k=F.col("k"), wing=F.col("wing")), judged, "b").where("b IS NOT NULL")
    names = {"near": F.when(F.col("b.kind") == "PE", 1.0).otherwise(-1.0), "body": F.lit(0.0), "far": F.when(F.col("b.kind") == "PE", -1.0).otherwise(1.0)}
    rows = rows.withColumns({n: F.concat((F.col("b.body") + m * F.col("wing")).cast("int").cast("string"), F.col("b.kind")) for n, m in names.items()})
    key = lambda n: {"scrip": F.col(n), "start": F.col("pick.t"), "end": F.col("b.t"), "side": F.lit("SELL" if n == "body" else "BUY")}
    rows = ask_legs(rows, desk, lambda b, k: stop(b, k.start, k.end, side=k.side, rate=desk.rate), {f"{n}_r": key(n) for n in names})
    total = money(pnl("near_r") + 2 * pnl("body_r") + pnl("far_r"))
    return rows.select(*entries.columns, F.col("pick.t").alias("entry_t"), F.col("b.price").alias("spot"), F.col("b.kind").alias("kind"), "wing", *names, F.col("b.body").alias("target"), F.col("b.behind").alias("stop"), F.col("b.t").alias("exit_t"), *(pnl(f"{n}_r").alias(f"{n}_pnl") for n in names), total.alias("total_pnl"))
