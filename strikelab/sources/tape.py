"""Market tables derived from an event stream: futures, spot and option-chain bars and the expiry calendar.

Bars are keyed by (idx, trade_date, t), t in minutes of the day. Prices are whole ticks over 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["idx", "trade_date", "t"]
GAP = 50.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(c) -> F.Column:
    return F.floor(c).cast("long")


def _futures_ticks(events: DataFrame) -> DataFrame:
    bar = (F.hour("ts") * 6 + F.floor(F.minute("ts") / 10)).cast("int")
    slots = events.select(F.concat(F.lit("IDX"), (F.col("user_id") % 2).cast("string")).alias("idx"), F.to_date("ts").alias("trade_date"), bar.alias("bar"), F.rint(F.col("value") * 100).cast("long").alias("cents"))
    slots = slots.groupBy("idx", "trade_date", "bar").agg(_whole((_whole(F.sum("cents") / F.count("*")) - 5000) / 8).alias("inc"))
    close = (F.lit(100_000) + F.sum("inc").over(Window.partitionBy("idx", "trade_date").orderBy("bar"))).cast("long")
    rows = slots.withColumn("close", close).withColumn("open", F.col("close") - F.col("inc"))
    edge = _whole(F.abs("inc") / 4)
    return rows.select("idx", "trade_date", "bar", "open", (F.greatest("open", "close") + edge).alias("high"), (F.least("open", "close") - edge).alias("low"), "close")


def _prices(ticks: DataFrame, *keys: str) -> DataFrame:
    return ticks.select("idx", "trade_date", (F.col("bar") * 10).alias("t"), *keys, *((F.col(c) / 100).alias(c) for c in ("open", "high", "low", "close") if c in ticks.columns))


def futures(events: DataFrame) -> DataFrame:
    """idx, trade_date, t, open, high, low, close."""
    return _prices(_futures_ticks(events))


def spot(events: DataFrame) -> DataFrame:
    """Futures less 300 ticks, on six bars of seven."""
    return _prices(_futures_ticks(events).where("bar % 7 <> 0").select("idx", "trade_date", "bar", *((F.col(c) - 300).alias(c) for c in ("open", "high", "low", "close"))))


def options(events: DataFrame) -> DataFrame:
    """idx, trade_date, t, scrip, strike, opt_type, high, low, close; some minutes are missing."""
    ticks = _futures_ticks(events).withColumn("k", F.explode(F.sequence(F.lit(80_000), F.lit(120_000), F.lit(5_000))))

    def premium(of: str, sign: int):
        fade = F.expr(f"greatest(500, 6000 - abs({of} - k) div 4) * (200 - bar) div 200")
        return F.greatest(sign * (F.col(of) - F.col("k")), F.lit(0)) + fade

    sides = [F.struct(F.lit("CE").alias("opt_type"), premium("high", 1).alias("h"), premium("low", 1).alias("l"), premium("close", 1).alias("c")), F.struct(F.lit("PE").alias("opt_type"), premium("low", -1).alias("h"), premium("high", -1).alias("l"), premium("close", -1).alias("c"))]
    rows = ticks.select("idx", "trade_date", "bar", "k", F.inline(F.array(*sides))).where("(bar + k div 5000 + if(opt_type = 'PE', 4, 0)) % 11 <> 0")
    rows = rows.select("idx", "trade_date", "bar", F.concat((F.col("k") / 100).cast("int").cast("string"), "opt_type").alias("scrip"), (F.col("k") / 100).alias("strike"), "opt_type", F.greatest("h", "c").alias("high"), F.least("l", "c").alias("low"), F.col("c").alias("close"))
    return _prices(rows, "scrip", "strike", "opt_type")


def calendar(events: DataFrame) -> DataFrame:
    """trade_date, n (its number), dte; weeks run 5 to 1."""
    days = events.select(F.to_date("ts").alias("trade_date")).distinct()
    n = F.row_number().over(Window.orderBy("trade_date"))  # one row a trading day
    return days.select("trade_date", n.alias("n")).withColumn("dte", 5 - (F.col("n") - 1) % 5)


#: The same tables for DuckDB: fut, opt, spt, cal.
TAPE_SQL = """
WITH slots AS (SELECT 'IDX' || (user_id % 2) AS idx, CAST(ts AS DATE) AS trade_date, (hour(ts) * 6 + minute(ts) // 10)::INT AS bar, round_even(value * 100, 0)::BIGINT AS cents FROM events),
inc AS (SELECT idx, trade_date, bar, floor((floor(sum(cents) / count(*)) - 5000) / 8)::BIGINT AS inc FROM slots GROUP BY ALL),
ft0 AS (SELECT *, (100000 + sum(inc) OVER (PARTITION BY idx, trade_date ORDER BY bar))::BIGINT AS close FROM inc),
ft AS (SELECT idx, trade_date, bar, close - inc AS open, greatest(close - inc, close) + abs(inc) // 4 AS high, least(close - inc, close) - abs(inc) // 4 AS low, close FROM ft0),
fut AS (SELECT idx, trade_date, bar * 10 AS t, open / 100.0::DOUBLE AS open, high / 100.0::DOUBLE AS high, low / 100.0::DOUBLE AS low, close / 100.0::DOUBLE AS close FROM ft),
spt AS (SELECT idx, trade_date, bar * 10 AS t, (open - 300) / 100.0::DOUBLE AS open, (high - 300) / 100.0::DOUBLE AS high, (low - 300) / 100.0::DOUBLE AS low, (close - 300) / 100.0::DOUBLE AS close FROM ft WHERE bar % 7 <> 0),
kk AS (SELECT *, unnest(range(80000, 120001, 5000)) AS k FROM ft),
ot AS (SELECT idx, trade_date, bar, k, 'CE' AS opt_type,
  greatest(high - k, 0) + greatest(500, 6000 - abs(high - k) // 4) * (200 - bar) // 200 AS h, greatest(low - k, 0) + greatest(500, 6000 - abs(low - k) // 4) * (200 - bar) // 200 AS l, greatest(close - k, 0) + greatest(500, 6000 - abs(close - k) // 4) * (200 - bar) // 200 AS c FROM kk WHERE (bar + k // 5000) % 11 <> 0
  UNION ALL SELECT idx, trade_date, bar, k, 'PE',
  greatest(k - low, 0) + greatest(500, 6000 - abs(low - k) // 4) * (200 - bar) // 200, greatest(k - high, 0) + greatest(500, 6000 - abs(high - k) // 4) * (200 - bar) // 200, greatest(k - close, 0) + greatest(500, 6000 - abs(close - k) // 4) * (200 - bar) // 200 FROM kk WHERE (bar + k // 5000 + 4) % 11 <> 0),
opt AS (SELECT idx, trade_date, bar * 10 AS t, (k // 100) || opt_type AS scrip, k / 100.0::DOUBLE AS strike, opt_type, greatest(h, c) / 100.0::DOUBLE AS high, least(l, c) / 100.0::DOUBLE AS low, c / 100.0::DOUBLE AS close FROM ot),
wide AS (SELECT idx, trade_date, t, strike, max(close) FILTER (opt_type = 'CE') AS ce, max(close) FILTER (opt_type = 'PE') AS pe FROM opt GROUP BY ALL),
cal AS (SELECT trade_date, n, 5 - (n - 1) % 5 AS dte FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date)::INT AS n FROM (SELECT DISTINCT trade_date FROM ft)))
"""
