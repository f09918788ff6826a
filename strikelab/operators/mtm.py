"""Minute-by-minute profit of trades on a dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelab.functions.triggers import last, let, rest, signs, window


def minute_grid(days: DataFrame, first: int, last: int, step: int = 1) -> DataFrame:
    """days with t: every step-th minute from first to last."""
    return days.withColumn("t", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))


def series(bars: Column, start: Column, end: Column, r: Column, side: Column, rate: Column | float = 0.0) -> Column:
    """Array of (t, mtm) of a trade with the outcome r (of a stop or trail) on bars entered at start: the bars after the entry to
    the exit, profit at the close less slippage; the last is the realised pnl. Empty without an outcome."""
    kept = F.filter(rest(window(bars, start, end)), lambda b: b["t"] <= F.coalesce(r["t"], end))
    value = lambda b: signs(side) * (r["o"] - b["close"]) - r["o"] * (rate if isinstance(rate, Column) else F.lit(float(rate)))
    return let(kept, lambda k: F.when(r["o"].isNull(), F.array().cast("array<struct<t:int,mtm:double>>")).otherwise(F.transform(k, lambda b: F.struct(b["t"].alias("t"), F.when(b["t"] == last(k)["t"], r["pnl"]).otherwise(value(b)).alias("mtm")))))


def filled(points: Column, first: int, last: int, step: int = 1) -> Column:
    """Array of (t, mtm) on the grid: 0 before the series starts, the latest value after each point.

    Each point fills the grid up to the next one, so the work is that of the points and the grid.
    """
    n = (last - first) // step
    at = lambda t: F.when(t.isNotNull(), F.greatest(F.ceil((t - first) / step).cast("int"), F.lit(0)))  # noqa: E731  the grid's first place at t or later
    run = lambda a, b, v: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda i: F.struct((i * step + first).alias("t"), v.cast("double").alias("mtm")))).otherwise(F.array().cast("array<struct<t:int,mtm:double>>"))

    def spread(p: Column) -> Column:
        end = lambda t: F.least(F.coalesce(at(t), F.lit(n + 1)), F.lit(n + 1))
        head = run(F.lit(0), end(F.get(p, F.lit(0))["t"]), F.lit(0.0))
        return F.flatten(F.concat(F.array(head), F.transform(p, lambda x, i: run(at(x["t"]), end(F.get(p, i + 1)["t"]), x["mtm"]))))

    return let(F.coalesce(points, F.array().cast("array<struct<t:int,mtm:double>>")), spread)


def portfolio(trades: DataFrame, keys: list[str], grid: str = "grid", value: str = "mtm") -> DataFrame:
    """keys, t, mtm: the sum over trades of their gridded series."""
    return trades.select(*keys, F.explode_outer(grid).alias("_g")).groupBy(*keys, F.col("_g.t").alias("t")).agg(F.sum("_g.mtm").alias(value))


def wide(mtm: DataFrame, keys: list[str], minutes: list[int]) -> DataFrame:
    """One column a minute."""
    return mtm.groupBy(*keys).pivot("t", minutes).agg(F.first("mtm"))
