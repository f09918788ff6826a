"""Rollups of trade logs and the report's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikelab.functions.triggers import let
from strikelab.plans.grid import split_columns


def cube_sum(log: DataFrame, day: str = "Date", period: tuple[str, ...] = ("Year", "Month", "DTE")) -> DataFrame:
    """Each measure summed by all parameters, year, month and DTE (log has DTE)."""
    keys, measures = split_columns(log)
    dated = log.withColumn("Year", F.year(day)).withColumn("Month", F.month(day))
    return dated.groupBy(*keys, *period).agg(*(F.sum(f"`{m}`").alias(m) for m in measures))


def week_labelled(log: DataFrame, first: str, last: str) -> DataFrame:
    """A log of weeks with DTE, as `5_1`: the days before expiry that a week runs from and to."""
    return log.withColumn("DTE", F.concat_ws("_", F.col(first).cast("string"), F.col(last).cast("string"))).drop(first, last)


def cube_unpivot(cube: DataFrame) -> DataFrame:
    """A row for each measure: PL Basis and Points; parameters lose their P_."""
    _, measures = split_columns(cube)
    ids = [c for c in cube.columns if c not in measures]
    long = cube.unpivot([f"`{c}`" for c in ids], [f"`{m}`" for m in measures], "PL Basis", "Points")
    return long.withColumnsRenamed({c: c[2:] for c in ids if c.startswith("P_")})


def normalised_log(log: DataFrame, values: DataFrame, index: str = "P_index", future: str = "Future") -> DataFrame:
    """Each measure as pnl * 10000 / (future * nv); values (index, nv) is a short list; a future of 0 gives null.

    values has one row an index and goes to the tasks: a log has few indices, each of which would be one task's rows otherwise.
    """
    _, measures = split_columns(log)
    rows = log.join(F.broadcast(values.withColumnRenamed(values.columns[0], index)), index, "left")
    new = {m: F.rint(F.try_divide(F.col(f"`{m}`") * 10_000, F.col(future) * F.col("nv")) * 100) / 100 for m in measures}
    return rows.withColumns(new).drop("nv")


def dim_catalog(df: DataFrame, *columns: str) -> DataFrame:
    """dimension, value: the distinct values of each column as text."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x"))
    return long.select("x.*").distinct()


def stacked(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def heatmap(df: DataFrame, row: str, column: str, values: list, points: str = "Points") -> DataFrame:
    """Points by row and by the given column values; missing cells 0, two places."""
    wide = df.groupBy(row).pivot(column, values).agg(F.sum(points))
    return wide.select(row, *(F.coalesce(F.round(F.col(f"`{v}`"), 2), F.lit(0.0)).alias(f"{column}_{v}") for v in values))


def heatmap_totals(df: DataFrame, row: str, column: str, points: str = "Points", means: bool = False) -> DataFrame:
    """Cells with row, column and grand totals: level 0, 1, 2 and 3 (grouping id). means: the totals are means of the cells."""
    if not means:
        return df.cube(row, column).agg(F.grouping_id().cast("int").alias("level"), F.sum(points).alias("points"))
    cells = df.groupBy(row, column).agg(F.sum(points).alias("points"))
    return cells.cube(row, column).agg(F.grouping_id().cast("int").alias("level"), F.avg("points").alias("points"))


def period_pnl(df: DataFrame, cell: list[str], points: str = "Points", by_dte: bool = False) -> DataFrame:
    """Points of each cell by year and month; by_dte (MCX): and by DTE."""
    return df.groupBy(*cell, "Year", "Month", *(["DTE"] if by_dte else [])).agg(F.sum(points).alias("points"))


def order_of(by_dte: bool = False) -> list[Column | str]:
    """The periods' order in time; DTE counts down."""
    return ["Year", "Month", *([F.desc("DTE")] if by_dte else [])]


def max_drawdown(periods: DataFrame, cell: list[str], order: list[Column | str]) -> DataFrame:
    """The deepest fall of the running sum below its peak so far, both from 0."""
    w = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = periods.withColumn("_s", F.sum("points").over(w))
    rows = rows.withColumn("_p", F.greatest(F.max("_s").over(w), F.lit(0.0)))
    return rows.groupBy(*cell).agg(F.min(F.col("_s") - F.col("_p")).alias("drawdown"))


def averages(periods: DataFrame, cell: list[str]) -> DataFrame:
    """avg_year: total over the cell's active months times 12; avg_month: total over all months that occur."""
    months = periods.select("Year", "Month").distinct().agg(F.count("*").alias("_all"))
    out = periods.groupBy(*cell).agg(F.sum("points").alias("total"), F.countDistinct("Year", "Month").alias("months"))
    return out.crossJoin(F.broadcast(months)).select(*cell, "total", (F.col("total") / F.col("months") * 12).alias("avg_year"), (F.col("total") / F.col("_all")).alias("avg_month"))


def calmar(periods: DataFrame, cell: list[str]) -> DataFrame:
    """avg_year over the size of the drawdown; 0 without one."""
    both = averages(periods, cell).join(max_drawdown(periods, cell, ["Year", "Month"]), cell)
    return both.select(*cell, "avg_year", "drawdown", F.coalesce(F.try_divide(F.col("avg_year"), F.abs("drawdown")), F.lit(0.0)).alias("calmar"))


def leg_ohlc(bars: DataFrame, keys: list[str]) -> DataFrame:
    """First close, highest high, lowest low and last close."""
    return bars.groupBy(*keys).agg(F.min_by("close", "t").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "t").alias("c"))


def sliced(df: DataFrame, **choices: list) -> DataFrame:
    """The rows with one of the given values in each named column."""
    for c, values in choices.items():
        df = df.where(F.col(c).isin(values))
    return df


def crossings(mtm: DataFrame, keys: list[str], levels: list[float], limit: Column, lag: int = 1, parts: list[str] | None = None) -> DataFrame:
    """keys, level, t, paid: for each level the first minute whose mtm is beyond level percent of limit, and what is paid.

    mtm (keys, t, mtm, parts). A level above 0 is crossed from below, one below 0 from above, strictly. t is the minute of
    the crossing, paid the mtm `lag` rows later; without a crossing, or where no later row exists, the last mtm, with t
    null. parts: columns of mtm paid at the same minute, as paid_{part}. A key's minutes are one array, and all levels are
    worked out on it, so nothing is copied for a level.
    """
    fields = ["mtm", *(parts or [])]
    out = mtm.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", *fields))).alias("_m"), F.first(limit).alias("_limit"))

    def judged(level: Column) -> Column:
        edge = level * F.col("_limit") / 100
        crossed = F.array_position(F.transform("_m", lambda x: F.when(level > 0, x["mtm"] > edge).otherwise(x["mtm"] < edge)), True).cast("int")
        return let(F.when((crossed > 0) & (crossed + lag <= F.size("_m")), crossed), lambda at: paid(level, at))

    def paid(level: Column, at: Column) -> Column:
        row = F.coalesce(F.get("_m", at - 1 + lag), F.element_at("_m", -1))
        return F.struct(level.alias("level"), F.get("_m", at - 1)["t"].alias("t"), row["mtm"].alias("paid"), *(row[p].alias(f"paid_{p}") for p in parts or []))

    found = out.select(*keys, F.explode_outer(F.transform(F.array(*map(F.lit, map(float, levels))), judged)).alias("_x"))
    return found.select(*keys, "_x.*")


def shares(fund: float, margin_percent: float, price: Column, entries: int | Column | None) -> Column:
    """Shares to trade: whole ones for each of `entries` of a ladder, each with its whole part of the fund; without a ladder the fund's, in fractions."""
    margin = price * margin_percent / 100
    if entries is None:
        return fund / margin
    return F.floor(F.floor(F.lit(float(fund)) / entries) / margin).cast("double")
