"""Indicators over an index's whole history, a block a day, with the SQL of the daily ones on the days end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikelab.catalog import SQL, Market, query
from strikelab.operators import indicators

LONG = {"keys": ("idx",), "block": ("trade_date",)}


def _end_to_end(name: str) -> str:
    """The SQL of a daily indicator on one long day an index, whose minutes are the bars' numbers."""
    line = "fl AS (SELECT idx, DATE '2000-01-01' AS trade_date, (row_number() OVER (PARTITION BY idx ORDER BY trade_date, t))::INT AS t, high, low, close FROM fut), "
    text = SQL[name].replace("b AS (SELECT idx, trade_date, t, high", f"{line}b AS (SELECT idx, trade_date, t, high").replace("FROM fut WINDOW", "FROM fl WINDOW")
    return f"SELECT * EXCLUDE (trade_date) FROM ({text})"


def _numbered(df: DataFrame) -> DataFrame:
    """t: the bar's number in its index's history."""
    return df.withColumn("t", F.row_number().over(Window.partitionBy("idx").orderBy("trade_date", "t"))).drop("trade_date")


def _bars(spark, sf_dir) -> DataFrame:
    return Market(spark, sf_dir).futures.select("idx", "trade_date", "t", "high", "low", "close")


@query(_end_to_end("atr"), market=False)
def atr_long(spark, sf_dir):
    return _numbered(indicators.atr(_bars(spark, sf_dir), **LONG).withColumns({c: F.round(c, 6) for c in ("tr", "atr")}))


@query(_end_to_end("supertrend"), market=False)
def supertrend_long(spark, sf_dir):
    return _numbered(indicators.supertrend(_bars(spark, sf_dir), **LONG).withColumn("level", F.round("level", 6)))


@query(_end_to_end("rsi"), market=False)
def rsi_long(spark, sf_dir):
    return _numbered(indicators.rsi(_bars(spark, sf_dir), **LONG).withColumn("rsi", F.round("rsi", 6)))


@query(_end_to_end("macd"), market=False)
def macd_long(spark, sf_dir):
    return _numbered(indicators.macd(_bars(spark, sf_dir), **LONG).withColumns({c: F.round(c, 6) for c in ("macd", "signal_line", "hist")}))
