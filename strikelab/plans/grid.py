"""Calendar and parameter grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivoted(wide: DataFrame) -> DataFrame:
    """trade_date, idx, dte from a calendar with a column for each index; dates as dd-MM-yyyy or yyyy-MM-dd."""
    day = F.coalesce(F.try_to_date("Date", "dd-MM-yyyy"), F.try_to_date("Date", "yyyy-MM-dd"))
    names = [c for c in wide.columns if c != "Date"]
    return wide.select(day.alias("trade_date"), *names).unpivot("trade_date", names, "idx", "dte").where("dte IS NOT NULL")


def run_dates(calendar: DataFrame, meta: DataFrame) -> DataFrame:
    """The calendar's days that a row of meta (idx, dte, from_date, to_date, run) asks for; meta is a short list."""
    asked = meta.where("run").select("idx", "dte", "from_date", "to_date")
    return calendar.join(asked, ["idx", "dte"]).where("trade_date BETWEEN from_date AND to_date").select("idx", "trade_date", "dte").distinct()


def weeks(days: DataFrame) -> DataFrame:
    """days (idx, trade_date, dte) with week: a new one starts where dte does not fall."""
    order = Window.partitionBy("idx").orderBy("trade_date")
    new = F.when(F.col("dte") < F.lag("dte").over(order), 0).otherwise(1)
    return days.withColumn("_new", new).withColumn("week", F.sum("_new").over(order).cast("int")).drop("_new")


def week_slice(week_days: DataFrame, from_dte: int, to_dte: int) -> DataFrame:
    """Of each week the days from from_dte to to_dte, counted from its end; shorter weeks repeat their first day: place counts down."""
    order = Window.partitionBy("idx", "week").orderBy(F.desc("trade_date"))
    ranked = week_days.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("idx", "week")))
    real = ranked.where(F.col("place").between(to_dte, from_dte))
    pad = ranked.where((F.col("place") == F.col("n")) & (F.col("n") < from_dte))
    pad = pad.withColumn("place", F.explode(F.sequence(F.greatest(F.col("n") + 1, F.lit(to_dte)).cast("int"), F.lit(from_dte))))
    return real.unionByName(pad).select("idx", "week", "trade_date", "dte", F.col("place").cast("int").alias("place"))


def grid(*columns: DataFrame) -> DataFrame:
    """Every combination of the columns' distinct values; each column is a short list."""
    return reduce(lambda a, b: a.crossJoin(b), [c.where(F.col(c.columns[0]).isNotNull()).distinct() for c in columns])


def time_rules(sets: DataFrame, entry: str = "entry_time", exit: str = "exit_time", last: str | None = None) -> DataFrame:
    """Entry more than five minutes before the exit; with a last trade, entry <= last < exit - 5."""
    ok = F.col(entry) < F.col(exit) - 5
    if last:
        ok = ok & (F.col(entry) <= F.col(last)) & (F.col(last) < F.col(exit) - 5)
    return sets.where(ok)


def normalised(sets: DataFrame) -> DataFrame:
    """Without a stop (sl 0) the method is HL and what depends on it 0; `sl+N` in intra_sl is worked out; sets whose intra
    stop is on but not wider than the stop go; texts are upper case."""
    sl = F.col("sl").cast("double")
    intra = F.upper(F.replace(F.col("intra_sl"), F.lit(" "), F.lit("")))
    value = F.when(intra.rlike(r"^SL\+"), sl + F.regexp_extract(intra, r"^SL\+(.*)$", 1).try_cast("double")).otherwise(intra.try_cast("double"))
    value = F.when(sl == 0, 0.0).otherwise(value)
    out = sets.withColumn("sl", sl).withColumn("intra_sl", value).withColumn("method", F.when(F.col("sl") == 0, "HL").otherwise(F.upper("method")))
    return out.where((F.col("intra_sl") == 0) | (F.col("intra_sl") > F.col("sl")))


def ladder(sets: DataFrame, entry: str = "entry_time", spec: str = "last_trade_time_and_interval") -> DataFrame:
    """sets with start: each entry time from `entry` to the last trade; spec is `HH:mm:ss,Nmin`."""
    clock = F.split(F.element_at(F.split(spec, ","), 1), ":")
    last = clock[0].cast("int") * 60 + clock[1].cast("int")
    step = F.regexp_extract(spec, r",\s*(\d+)", 1).cast("int")
    return sets.withColumn("start", F.explode(F.sequence(F.col(entry).cast("int"), last, step)))


def split_columns(log: DataFrame) -> tuple[list[str], list[str]]:
    """Parameter columns (P_...) and measures (...PNL) of a trade log."""
    return [c for c in log.columns if c.startswith("P_")], [c for c in log.columns if c.upper().endswith("PNL")]


def weekday(c: Column) -> Column:
    return F.date_format(c, "EEEE")
