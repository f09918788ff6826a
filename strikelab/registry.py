"""The registered queries of the library and their SQL.

Market queries read the bars that sources.tape derives from `events`; report queries read a trade log formed from
`lineitem`. Parameter sets are short lists, as a caller would give them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strikelab.catalog import FIRST, GAP, LAST, LEVELS, QUERIES, SQL, Market, query
from strikelab.functions import scalars as fn
from strikelab.functions import triggers
from strikelab.operators import indicators, mtm, rollup, strikes
from strikelab.plans import grid
from strikelab.plans.lineage import cut, scratch
from strikelab.sources import files, tape
from strikelab.strategy_sql import ATM as _ATM

queries = lambda: dict(QUERIES)
oracle_sql = lambda: dict(SQL)


def _entries(m: Market, rows: list[tuple], schema: str) -> DataFrame:
    return m.entries(rows, schema)


# --- bars, calendar, sessions ------------------------------------------------------------------------------------------


@query(f"SELECT idx, trade_date, t, open, high, low, close FROM fut WHERE t BETWEEN {FIRST} AND {LAST}")
def read_bars(spark, sf_dir):
    return Market(spark, sf_dir).futures.where(F.col("t").between(FIRST, LAST))


def _wide_calendar(m: Market) -> DataFrame:
    return m.calendar.select(F.date_format("trade_date", "dd-MM-yyyy").alias("Date"), F.col("dte").alias("IDX0"), F.when(F.col("dte") > 1, F.col("dte")).alias("IDX1"))


_CAL = "cal2 AS (SELECT trade_date, 'IDX0' AS idx, dte FROM cal UNION ALL SELECT trade_date, 'IDX1', dte FROM cal WHERE dte > 1)"


@query(f", {_CAL} SELECT * FROM cal2")
def read_calendar(spark, sf_dir):
    return grid.unpivoted(_wide_calendar(Market(spark, sf_dir)))


def _meta(spark: SparkSession) -> DataFrame:
    rows = [("IDX0", 1, "2024-01-03", "2024-01-25", True), ("IDX0", 3, "2024-01-01", "2024-12-31", True), ("IDX1", 2, "2024-01-10", "2024-01-20", True), ("IDX1", 4, "2024-01-01", "2024-12-31", False)]
    return spark.createDataFrame(rows, "idx string, dte int, f string, e string, run boolean").select("idx", "dte", F.to_date("f").alias("from_date"), F.to_date("e").alias("to_date"), "run")


@query(f", {_CAL} SELECT idx, trade_date, dte FROM cal2 WHERE (idx = 'IDX0' AND (dte = 1 AND trade_date BETWEEN '2024-01-03' AND '2024-01-25' OR dte = 3 AND trade_date BETWEEN '2024-01-01' AND '2024-12-31')) OR (idx = 'IDX1' AND dte = 2 AND trade_date BETWEEN '2024-01-10' AND '2024-01-20')")
def run_dates(spark, sf_dir):
    return grid.run_dates(grid.unpivoted(_wide_calendar(Market(spark, sf_dir))), _meta(spark))


_WEEKS = f"{_CAL}, wk AS (SELECT idx, trade_date, dte, sum(CASE WHEN dte < p THEN 0 ELSE 1 END) OVER (PARTITION BY idx ORDER BY trade_date)::INT AS week FROM (SELECT *, lag(dte) OVER (PARTITION BY idx ORDER BY trade_date) AS p FROM cal2))"


@query(f", {_WEEKS} SELECT idx, trade_date, dte, week FROM wk")
def expiry_weeks(spark, sf_dir):
    return grid.weeks(grid.unpivoted(_wide_calendar(Market(spark, sf_dir))))


@query(f""", {_WEEKS}, rk AS (SELECT *, row_number() OVER (PARTITION BY idx, week ORDER BY trade_date DESC)::INT AS place, count(*) OVER (PARTITION BY idx, week)::INT AS n FROM wk)
SELECT idx, week, trade_date, dte, place FROM rk WHERE place BETWEEN 2 AND 5
UNION ALL SELECT idx, week, trade_date, dte, unnest(range(greatest(n + 1, 2), 6))::INT FROM rk WHERE place = n AND n < 5""")
def week_slice(spark, sf_dir):
    return grid.week_slice(grid.weeks(grid.unpivoted(_wide_calendar(Market(spark, sf_dir)))), 5, 2)


@query("SELECT idx, trade_date, min(d) AS gap FROM (SELECT idx, trade_date, strike - lag(strike) OVER (PARTITION BY idx, trade_date ORDER BY strike) AS d FROM (SELECT DISTINCT idx, trade_date, strike FROM opt)) GROUP BY ALL")
def strike_gap(spark, sf_dir):
    return strikes.strike_gap(Market(spark, sf_dir).options)


@query("SELECT idx, trade_date, count(*) AS bars FROM opt WHERE strike % 100 = 0 GROUP BY ALL")
def strike_grid_filter(spark, sf_dir):
    return strikes.on_grid(Market(spark, sf_dir).options, 100.0).groupBy("idx", "trade_date").agg(F.count("*").alias("bars"))


@query("SELECT idx, trade_date FROM (SELECT DISTINCT idx, trade_date FROM fut) WHERE (idx, trade_date) NOT IN (SELECT (idx, trade_date) FROM spt GROUP BY idx, trade_date HAVING count(*) >= 100)")
def pending_work(spark, sf_dir):
    m = Market(spark, sf_dir)
    return files.pending_work(m.days, m.spot, 100)


# --- scalar rules ------------------------------------------------------------------------------------------------------


@query("SELECT scrip, opt_type, strike, count(*) AS n FROM opt GROUP BY ALL")
def parse_scrip(spark, sf_dir):
    rows = Market(spark, sf_dir).options.select("scrip", fn.type_of(F.col("scrip")).alias("opt_type"), fn.strike_of(F.col("scrip")).alias("strike"))
    return rows.groupBy("scrip", "opt_type", "strike").agg(F.count("*").alias("n"))


_OM = "CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' SD' WHEN 3 THEN 'ATM+' || CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 4 THEN 'atms-' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '%' WHEN 5 THEN 'P<' || CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 6 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '%-I' ELSE '0' END"


@query(f"""WITH o AS (SELECT {_OM} AS om, CAST(l_quantity AS INT) AS q, l_linenumber AS n FROM lineitem)
SELECT om, CASE n WHEN 1 THEN 'strangle' WHEN 2 THEN 'sd' WHEN 3 THEN 'atm' WHEN 4 THEN 'atms' WHEN 5 THEN 'premium<' WHEN 6 THEN 'percent' ELSE 'atm' END AS kind,
  CASE WHEN n = 4 THEN -q WHEN n >= 7 THEN 0 ELSE q END::DOUBLE AS value, n = 6 AS checks, count(*) AS rows FROM o GROUP BY ALL""", market=False)
def om_parse(spark, sf_dir):
    om = tape.table(spark, sf_dir, "lineitem").select(F.expr(_OM.replace("VARCHAR", "STRING")).alias("om"))
    return om.groupBy("om").agg(F.count("*").alias("rows")).select("om", fn.om_kind(F.col("om")).alias("kind"), fn.om_value(F.col("om")).alias("value"), fn.om_checks_inverted(F.col("om")).alias("checks"), "rows")


def _instruments(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(fn.INSTRUMENTS, "idx string, market string, rate double, step double, tick double"))


_INST = "inst AS (SELECT * FROM (VALUES ('IDX0', 'NSE', 0.01::DOUBLE, 5000::DOUBLE, 0.05::DOUBLE), ('IDX1', 'MCX', 0.005::DOUBLE, 100::DOUBLE, 1::DOUBLE)) AS v(idx, market, rate, step, tick))"


@query(f", {_INST} SELECT idx, trade_date, t, scrip, round(close * rate, 6) AS slippage FROM opt JOIN inst USING (idx) WHERE t BETWEEN {FIRST} AND {LAST}")
def slippage(spark, sf_dir):
    return Market(spark, sf_dir).session.join(_instruments(spark), "idx").select("idx", "trade_date", "t", "scrip", F.round(F.col("close") * F.col("rate"), 6).alias("slippage"))


@query(f", {_INST} SELECT idx, trade_date, t, CASE WHEN idx = 'IDX0' THEN round_even(close, 0) ELSE floor(close / step) * step END / 100 AS one_om FROM fut JOIN inst USING (idx)")
def one_om(spark, sf_dir):
    rows = Market(spark, sf_dir).futures.join(_instruments(spark), "idx")
    return rows.select("idx", "trade_date", "t", fn.one_om(F.col("close"), F.when(F.col("idx") != "IDX0", F.col("step"))).alias("one_om"))


@query(f""", {_INST}, x AS (SELECT idx, trade_date, t, scrip, s.s AS side, o.o AS kind, close * 1.137 AS p, tick FROM opt JOIN inst USING (idx), (VALUES ('SELL'), ('BUY')) s(s), (VALUES ('STOPLOSS'), ('TARGET')) o(o) WHERE t BETWEEN {FIRST} AND {LAST})
SELECT idx, trade_date, t, scrip, side, kind, round(CASE WHEN (side = 'SELL') = (kind = 'STOPLOSS') THEN ceil(round(p / tick, 6)) ELSE floor(round(p / tick, 6)) END * tick, 2) AS price FROM x""")
def tick_round(spark, sf_dir):
    rows = Market(spark, sf_dir).session.join(_instruments(spark), "idx").withColumn("side", F.explode(F.array(F.lit("SELL"), F.lit("BUY")))).withColumn("kind", F.explode(F.array(F.lit("STOPLOSS"), F.lit("TARGET"))))
    return rows.select("idx", "trade_date", "t", "scrip", "side", "kind", fn.to_tick(F.col("close") * 1.137, F.col("tick"), F.col("side"), F.col("kind")).alias("price"))


@query(f", {_INST} SELECT idx, market, count(*) AS bars FROM fut JOIN inst USING (idx) GROUP BY ALL")
def market_of(spark, sf_dir):
    return Market(spark, sf_dir).futures.join(_instruments(spark), "idx").groupBy("idx", "market").agg(F.count("*").alias("bars"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * l_quantity / 100 AS part FROM lineitem", market=False)
def pct_of(spark, sf_dir):
    return tape.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.percent_of(F.col("l_extendedprice"), F.col("l_quantity")).alias("part"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'TTC' ELSE (p_size::VARCHAR || '.0') END AS label FROM part) GROUP BY ALL", market=False)
def num_label(spark, sf_dir):
    text = F.expr("CASE WHEN p_size % 3 = 0 THEN 'TTC' WHEN p_size % 3 = 1 THEN concat(CAST(p_size AS STRING), '.00') ELSE CAST(p_size AS STRING) END")
    return tape.table(spark, sf_dir, "part").select(fn.number_label(text).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT idx, trade_date, t, strike, strike + ce - pe AS future FROM wide")
def synthetic_future(spark, sf_dir):
    return strikes.side_by_side(Market(spark, sf_dir).options).select("idx", "trade_date", "t", "strike", fn.synthetic_future(F.col("strike"), F.col("ce"), F.col("pe")).alias("future"))


@query("SELECT idx, trade_date, t, strike, strike - (ce + pe) * 40 / 100 AS lower, strike + (ce + pe) * 40 / 100 AS upper, NULL::DOUBLE AS intra_lower FROM wide")
def sl_band(spark, sf_dir):
    rows = strikes.side_by_side(Market(spark, sf_dir).options)
    lower, upper = fn.band(F.col("strike"), F.col("ce") + F.col("pe"), F.lit(40))
    return rows.select("idx", "trade_date", "t", "strike", lower.alias("lower"), upper.alias("upper"), fn.band(F.col("strike"), F.col("ce"), F.lit(0))[0].alias("intra_lower"))


@query("""SELECT idx, trade_date, round_even(p, 2) AS p, round_even(2 * p - l, 2) AS r1, round_even(p + (h - l), 2) AS r2, round_even(h + 2 * (p - l), 2) AS r3, round_even(h + 2 * (p - l) + (p + (h - l)) - (2 * p - l), 2) AS r4, round_even(h + 2 * (p - l) + (p + (h - l)) - (2 * p - l) + (h + 2 * (p - l)) - (p + (h - l)), 2) AS r5, round_even(2 * p - h, 2) AS s1, round_even(p - (h - l), 2) AS s2, round_even(l - 2 * (h - p), 2) AS s3, round_even(l - 2 * (h - p) + (p - (h - l)) - (2 * p - h), 2) AS s4, round_even(l - 2 * (h - p) + (p - (h - l)) - (2 * p - h) + (l - 2 * (h - p)) - (p - (h - l)), 2) AS s5
FROM (SELECT *, (h + l + c) / 3 AS p FROM (SELECT idx, trade_date, lag(h) OVER w AS h, lag(l) OVER w AS l, lag(c) OVER w AS c FROM (SELECT idx, trade_date, max(high) AS h, min(low) AS l, arg_max(close, t) AS c FROM spt GROUP BY ALL) WINDOW w AS (PARTITION BY idx ORDER BY trade_date)))""")
def pivot_levels(spark, sf_dir):
    days = rollup.leg_ohlc(Market(spark, sf_dir).spot, ["idx", "trade_date"])
    w = Window.partitionBy("idx").orderBy("trade_date")
    before = days.select("idx", "trade_date", *(F.lag(c).over(w).alias(c) for c in ("h", "l", "c")))
    levels = fn.pivots(F.col("h"), F.col("l"), F.col("c"))
    return before.select("idx", "trade_date", *(levels[k].alias(k) for k in ("p", "r1", "r2", "r3", "r4", "r5", "s1", "s2", "s3", "s4", "s5")))


# --- parameter grids ---------------------------------------------------------------------------------------------------


def _lists(spark, sf_dir):
    line = tape.table(spark, sf_dir, "lineitem")
    entry = line.select((560 + F.col("l_linenumber") * 10).alias("entry_time"))
    exit_ = line.select((600 + F.col("l_linenumber") * 5).alias("exit_time"))
    sl = line.select(F.expr("CAST(CAST(l_quantity AS INT) % 4 * 10 AS STRING)").alias("sl"))
    intra = line.select(F.expr("CASE l_linenumber WHEN 1 THEN 'sl+10' WHEN 2 THEN '0' WHEN 3 THEN '25' WHEN 4 THEN NULL ELSE 'sl+5' END").alias("intra_sl"))
    method = line.select(F.expr("CASE l_returnflag WHEN 'A' THEN 'hl' ELSE 'cc' END").alias("method"))
    return entry, exit_, sl, intra, method


_LISTS = """WITH e AS (SELECT DISTINCT 560 + l_linenumber * 10 AS entry_time FROM lineitem), x AS (SELECT DISTINCT 600 + l_linenumber * 5 AS exit_time FROM lineitem), s AS (SELECT DISTINCT CAST(l_quantity AS INT) % 4 * 10 AS sl FROM lineitem),
i AS (SELECT DISTINCT CASE l_linenumber WHEN 1 THEN 'sl+10' WHEN 2 THEN '0' WHEN 3 THEN '25' ELSE 'sl+5' END AS intra_sl FROM lineitem WHERE l_linenumber <> 4), m AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'hl' ELSE 'cc' END AS method FROM lineitem), g AS (SELECT * FROM e, x, s, i, m)"""


@query(f"{_LISTS} SELECT entry_time, exit_time, sl::VARCHAR AS sl, intra_sl, method FROM g", market=False)
def param_grid(spark, sf_dir):
    return grid.grid(*_lists(spark, sf_dir))


@query(f"{_LISTS} SELECT entry_time, exit_time FROM e, x WHERE entry_time < exit_time - 5", market=False)
def grid_time_rules(spark, sf_dir):
    entry, exit_, *_ = _lists(spark, sf_dir)
    return grid.time_rules(grid.grid(entry, exit_))


_NORMAL = "n AS (SELECT entry_time, exit_time, sl::DOUBLE AS sl, CASE WHEN sl = 0 THEN 0 WHEN intra_sl LIKE 'sl+%' THEN sl + substring(intra_sl, 4)::INT ELSE intra_sl::INT END::DOUBLE AS intra_sl, CASE WHEN sl = 0 THEN 'HL' ELSE upper(method) END AS method FROM g)"


@query(f"{_LISTS}, {_NORMAL} SELECT * FROM n WHERE intra_sl = 0 OR intra_sl > sl", market=False)
def grid_normalise(spark, sf_dir):
    return grid.normalised(grid.grid(*_lists(spark, sf_dir)))


@query(f"{_LISTS}, {_NORMAL} SELECT DISTINCT * FROM n WHERE intra_sl = 0 OR intra_sl > sl", market=False)
def grid_dedupe(spark, sf_dir):
    return grid.normalised(grid.grid(*_lists(spark, sf_dir))).dropDuplicates()


@query(f"{_LISTS} SELECT entry_time, unnest(range(entry_time, 661, 10)) AS start FROM e", market=False)
def entry_ladder(spark, sf_dir):
    entry, *_ = _lists(spark, sf_dir)
    return grid.ladder(entry.distinct().withColumn("spec", F.lit("11:00:00,10min")), spec="spec").select("entry_time", "start")


# --- strikes -----------------------------------------------------------------------------------------------------------

@query(f", {_ATM} SELECT * FROM atm")
def atm_straddle(spark, sf_dir):
    return Market(spark, sf_dir).atm


@query(f""", {_ATM} SELECT a.idx, a.trade_date, a.t, a.future, a.strike + {GAP} AS ce_strike, a.strike - {GAP} AS pe_strike, c.ce, p.pe FROM atm a JOIN ses c ON c.idx = a.idx AND c.trade_date = a.trade_date AND c.t = a.t AND c.strike = a.strike + {GAP} AND c.ce IS NOT NULL JOIN ses p ON p.idx = a.idx AND p.trade_date = a.trade_date AND p.t = a.t AND p.strike = a.strike - {GAP} AND p.pe IS NOT NULL""")
def atm_offset(spark, sf_dir):
    m = Market(spark, sf_dir)
    return strikes.shifted(m.atm, m.session, F.lit(GAP))


@query(f""", {_ATM}, sd AS (SELECT *, greatest({GAP}, round_even((ce + pe) * 0.8 / {GAP}, 0) * {GAP}) AS d FROM atm) SELECT a.idx, a.trade_date, a.t, a.future, a.strike + d AS ce_strike, a.strike - d AS pe_strike, c.ce, p.pe FROM sd a JOIN ses c ON c.idx = a.idx AND c.trade_date = a.trade_date AND c.t = a.t AND c.strike = a.strike + d AND c.ce IS NOT NULL JOIN ses p ON p.idx = a.idx AND p.trade_date = a.trade_date AND p.t = a.t AND p.strike = a.strike - d AND p.pe IS NOT NULL""")
def atm_offset_sd(spark, sf_dir):
    m = Market(spark, sf_dir)
    return strikes.shifted(m.atm.withColumn("up", strikes.sd_shift(0.8, GAP)), m.session, F.col("up")).drop("up")


def _targets(m: Market) -> DataFrame:
    return m.futures.where(F.col("t").between(FIRST, LAST)).select("idx", "trade_date", "t", (fn.one_om(F.col("close"), F.lit(None).cast("double")) * 3).alias("target"))


_NEAR = f"""tg AS (SELECT idx, trade_date, t, round_even(close, 0) / 100 * 3 AS target FROM fut WHERE t BETWEEN {FIRST} AND {LAST}),
nr AS (SELECT g.idx, g.trade_date, g.t, target, opt_type, strike, close, row_number() OVER (PARTITION BY g.idx, g.trade_date, g.t, opt_type ORDER BY abs(close - target), strike) AS r FROM tg g JOIN opt o ON o.idx = g.idx AND o.trade_date = g.trade_date AND o.t = g.t WHERE close >= target),
np AS (SELECT idx, trade_date, t, target, max(strike) FILTER (opt_type = 'CE') AS ce_strike, max(strike) FILTER (opt_type = 'PE') AS pe_strike, max(close) FILTER (opt_type = 'CE') AS ce, max(close) FILTER (opt_type = 'PE') AS pe FROM nr WHERE r = 1 GROUP BY ALL HAVING count(*) = 2)"""


@query(f", {_NEAR} SELECT * FROM np")
def premium_strike(spark, sf_dir):
    m = Market(spark, sf_dir)
    return strikes.nearest_premium(m.session, _targets(m))


_STRANGLE = f"""{_NEAR}, cand AS (SELECT n.idx, n.trade_date, n.t, n.target, v.i, CASE WHEN v.side = 'ce' THEN n.ce_strike + v.d ELSE n.ce_strike END AS ck, CASE WHEN v.side = 'pe' THEN n.pe_strike + v.d ELSE n.pe_strike END AS pk FROM np n, (VALUES (0, 'ce', 0.0), (1, 'pe', -{GAP}), (2, 'ce', -{GAP}), (3, 'pe', {GAP}), (4, 'ce', {GAP})) v(i, side, d)),
pr AS (SELECT c.*, a.ce, b.pe FROM cand c JOIN wide a ON a.idx = c.idx AND a.trade_date = c.trade_date AND a.t = c.t AND a.strike = c.ck JOIN wide b ON b.idx = c.idx AND b.trade_date = c.trade_date AND b.t = c.t AND b.strike = c.pk),
sg AS (SELECT *, row_number() OVER (PARTITION BY idx, trade_date, t ORDER BY abs(ce - pe), i) AS r FROM pr WHERE ce + pe >= target * 2 AND ce + pe <= target * 3)"""


@query(f", {_STRANGLE} SELECT idx, trade_date, t, target, ck AS ce_strike, pk AS pe_strike, ce, pe FROM sg WHERE r = 1")
def otm_strangle(spark, sf_dir):
    m = Market(spark, sf_dir)
    return strikes.strangle(m.session, _targets(m), GAP)


@query(f""", {_ATM}, {_STRANGLE}, u AS (SELECT s.idx, s.trade_date, s.t, s.target, ck < pk AS inverted, ck, pk, s.ce, s.pe, a.strike AS k, a.ce AS ace, a.pe AS ape FROM sg s LEFT JOIN atm a ON a.idx = s.idx AND a.trade_date = s.trade_date AND a.t = s.t WHERE r = 1)
SELECT idx, trade_date, t, target, inverted, CASE WHEN inverted THEN k ELSE ck END AS ce_strike, CASE WHEN inverted THEN k ELSE pk END AS pe_strike, CASE WHEN inverted THEN ace ELSE ce END AS ce, CASE WHEN inverted THEN ape ELSE pe END AS pe FROM u WHERE NOT inverted OR k IS NOT NULL""")
def inverted_check(spark, sf_dir):
    m = Market(spark, sf_dir)
    return strikes.upright(strikes.strangle(m.session, _targets(m), GAP), m.atm)


_SETS = [(565, 900), (610, 900), (700, 800)]
_ENT = 'ent AS (SELECT idx, trade_date, start, "end" FROM (SELECT DISTINCT idx, trade_date FROM ft), (VALUES (565, 900), (610, 900), (700, 800)) v(start, "end"))'


@query(f""", {_ATM}, {_ENT} SELECT e.idx, e.trade_date, start, "end", min(t) AS t, arg_min(future, t) AS future, arg_min(strike, t) AS strike, arg_min(ce, t) AS ce, arg_min(pe, t) AS pe FROM ent e JOIN atm a ON a.idx = e.idx AND a.trade_date = e.trade_date AND t BETWEEN start AND "end" GROUP BY e.idx, e.trade_date, start, "end" """)
def strike_asof(spark, sf_dir):
    m = Market(spark, sf_dir)
    return strikes.first_valid(m.atm, _entries(m, _SETS, "start int, end int"))


@query(f", {_ATM} SELECT idx, trade_date, max(t) AS t, arg_max(future, t) AS future, arg_max(strike, t) AS strike, arg_max(ce, t) AS ce, arg_max(pe, t) AS pe FROM atm WHERE t > {LAST - 150} GROUP BY ALL")
def eod_straddle(spark, sf_dir):
    return strikes.last_valid(Market(spark, sf_dir).atm, LAST, 150)


@query(f""", {_ATM}, {_STRANGLE}, bo AS (SELECT a.idx, a.trade_date, a.t, a.strike, s.ck AS ce_strike, s.pk AS pe_strike FROM atm a JOIN sg s ON a.idx = s.idx AND a.trade_date = s.trade_date AND a.t = s.t AND s.r = 1), {_ENT}
SELECT e.idx, e.trade_date, start, "end", min(t) AS t, arg_min(strike, t) AS strike, arg_min(ce_strike, t) AS ce_strike, arg_min(pe_strike, t) AS pe_strike FROM ent e JOIN bo b ON b.idx = e.idx AND b.trade_date = e.trade_date AND t BETWEEN start AND "end" GROUP BY e.idx, e.trade_date, start, "end" """)
def paired_entry(spark, sf_dir):
    m = Market(spark, sf_dir)
    both = m.atm.select("idx", "trade_date", "t", "strike").join(strikes.strangle(m.session, _targets(m), GAP).select("idx", "trade_date", "t", "ce_strike", "pe_strike"), ["idx", "trade_date", "t"])
    return strikes.first_valid(both, _entries(m, _SETS, "start int, end int"))


@query("""SELECT a.idx, a.trade_date, a.scrip, a.at, max(close) FILTER (o.t = a.at) AS exact, arg_max(close, o.t) FILTER (o.t <= a.at) AS price FROM (SELECT DISTINCT idx, trade_date, scrip, 650 AS at FROM opt) a LEFT JOIN opt o ON o.idx = a.idx AND o.trade_date = a.trade_date AND o.scrip = a.scrip GROUP BY a.idx, a.trade_date, a.scrip, a.at""")
def price_at(spark, sf_dir):
    options = Market(spark, sf_dir).options
    return strikes.price_at(options, options.select("idx", "trade_date", "scrip").distinct().withColumn("at", F.lit(650)))


@query("SELECT idx, trade_date, scrip, t, high, low, close FROM opt WHERE t BETWEEN 600 AND 700")
def leg_slice(spark, sf_dir):
    legs = Market(spark, sf_dir).legs
    return legs.select("idx", "trade_date", "scrip", F.inline(triggers.window(F.col("bars"), F.lit(600), F.lit(700))))


def _both_legs(m: Market) -> DataFrame:
    """idx, trade_date, strike, bars of every strike's straddle."""
    leg = lambda kind: m.legs.where(fn.type_of(F.col("scrip")) == kind).select("idx", "trade_date", fn.strike_of(F.col("scrip")).alias("strike"), F.col("bars").alias(kind.lower()))
    return leg("CE").join(leg("PE"), ["idx", "trade_date", "strike"]).select("idx", "trade_date", "strike", triggers.straddle_bars(F.col("ce"), F.col("pe")).alias("bars"))


_STRADDLE = f"sb AS (SELECT c.idx, c.trade_date, c.strike, c.t, greatest(c.high + p.low, c.low + p.high, c.close + p.close) AS high, least(c.high + p.low, c.low + p.high, c.close + p.close) AS low, c.close + p.close AS close FROM opt c JOIN opt p ON p.idx = c.idx AND p.trade_date = c.trade_date AND p.t = c.t AND p.strike = c.strike WHERE c.opt_type = 'CE' AND p.opt_type = 'PE' AND c.t BETWEEN {FIRST} AND {LAST})"


@query(f", {_STRADDLE} SELECT * FROM sb")
def straddle_bars(spark, sf_dir):
    return _both_legs(Market(spark, sf_dir)).select("idx", "trade_date", "strike", F.explode("bars").alias("b")).select("idx", "trade_date", "strike", "b.*")


_WINGS = (("CE", 0.0), ("PE", 0.0), ("CE", GAP), ("PE", -GAP))


@query("SELECT o0.idx, o0.trade_date, o0.strike, o0.t, " + ", ".join(f"o{i}.close AS c{i}" for i in range(4)) + " FROM opt o0 " + " ".join(f"JOIN opt o{i} ON o{i}.idx = o0.idx AND o{i}.trade_date = o0.trade_date AND o{i}.t = o0.t AND o{i}.opt_type = '{k}' AND o{i}.strike = o0.strike + {d}" for i, (k, d) in enumerate(_WINGS) if i) + f" WHERE o0.opt_type = 'CE' AND o0.t BETWEEN {FIRST} AND {LAST}")
def common_minutes4(spark, sf_dir):
    """The closes of every strike's straddle and of the wings a gap away, on the minutes that all four have."""
    legs = cut(Market(spark, sf_dir).legs.withColumn("strike", fn.strike_of(F.col("scrip"))), "legs")
    rows = None
    for i, (kind, away) in enumerate(_WINGS):
        one = legs.where(F.col("scrip").endswith(kind)).select("idx", "trade_date", (F.col("strike") - away).alias("strike"), F.col("bars").alias(f"b{i}"))
        rows = one if rows is None else rows.join(one, ["idx", "trade_date", "strike"])
    met = triggers.all_legs([F.col(f"b{i}") for i in range(4)], lambda *x: F.struct(x[0]["t"].alias("t"), *(y["close"].alias(f"c{i}") for i, y in enumerate(x))))
    return rows.select("idx", "trade_date", "strike", F.explode(met).alias("x")).select("idx", "trade_date", "strike", "x.*")


# --- triggers ----------------------------------------------------------------------------------------------------------

_STOPS = [(565, 900, "SELL", "HL", 8.0, 12.0), (565, 900, "SELL", "CC", 5.0, 0.0), (610, 900, "BUY", "HL", 6.0, 0.0), (610, 800, "SELL", "HL", 0.0, 0.0), (700, 880, "BUY", "CC", 4.0, 9.0)]
_STOP_SCHEMA = "start int, end int, side string, method string, sl double, intra_sl double"
_STOP_ROWS = "sr AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, '{c}', '{d}', {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, d, e, f in _STOPS) + ') v(start, "end", side, method, sl, intra_sl))'


def _stop_sql(src: str, keys: str, rate: float, combined: bool = False, target: str = "NULL") -> str:
    """Outcome of stops over src (keys, start, end, side, method, sl, intra_sl, t, high, low, close), a row for each bar, by first hits."""
    cc = "TRUE" if combined else "method = 'CC'"
    fav = "close" if combined else "CASE WHEN side = 'SELL' THEN low ELSE high END"
    k = f'{keys}, start, "end", side, method, sl, intra_sl'
    return f"""o0 AS (SELECT *, first_value(close) OVER (PARTITION BY {k} ORDER BY t) AS o, row_number() OVER (PARTITION BY {k} ORDER BY t) AS i FROM {src} WHERE t BETWEEN start AND "end"),
o1 AS (SELECT *, CASE WHEN sl > 0 THEN (100 + CASE WHEN side = 'SELL' THEN sl ELSE -sl END) / 100 * o END AS lv, CASE WHEN intra_sl > 0 THEN (100 + CASE WHEN side = 'SELL' THEN intra_sl ELSE -intra_sl END) / 100 * o END AS iv, {target} AS tv, CASE WHEN side = 'SELL' THEN 1 ELSE -1 END AS g FROM o0 WHERE i > 1),
o2 AS (SELECT *, coalesce(g * CASE WHEN side = 'SELL' THEN high ELSE low END >= g * iv, false) AS hi, coalesce(g * CASE WHEN {cc} THEN close WHEN side = 'SELL' THEN high ELSE low END >= g * lv, false) AS hs, coalesce(g * ({fav}) <= g * tv, false) AS ht FROM o1),
o3 AS (SELECT {k}, any_value(o) AS o, min(t) FILTER (hi OR hs OR ht) AS x, max(t) AS z FROM o2 GROUP BY {k}),
res AS (SELECT {", ".join(f"b.{c.strip()}" for c in k.split(","))}, b.o, x AS t, CASE WHEN x IS NULL THEN close WHEN hi THEN iv WHEN hs THEN CASE WHEN {cc} THEN close ELSE lv END ELSE {"close" if combined else "tv"} END AS exit, x IS NOT NULL AND (hi OR hs) AS sl_hit, x IS NOT NULL AND hi AS intra_hit, g FROM o3 a JOIN o2 b USING ({k}) WHERE b.t = coalesce(x, z))
SELECT {k}, o, t, exit, sl_hit, intra_hit, round_even(g * (o - exit) - o * {rate}, 2) + 0 AS pnl FROM res"""


_STOP_KEYS = [c.split()[0] for c in _STOP_SCHEMA.split(", ")]
_STOP_OUT = ["r.o", "r.t", "r.exit", "r.sl_hit", "r.intra_hit", "r.pnl"]


def _stopped(rows: DataFrame, keys: list[str], **how) -> DataFrame:
    """Every leg of rows (keys, bars) with every set of stops."""
    sets = rows.sparkSession.createDataFrame(_STOPS, _STOP_SCHEMA)
    r = triggers.stop(F.col("bars"), F.col("start"), F.col("end"), side=F.col("side"), sl=F.col("sl"), intra=F.col("intra_sl"), **how)
    out = rows.crossJoin(F.broadcast(sets)).select(*keys, *_STOP_KEYS, r.alias("r"))
    return out.select(*keys, *_STOP_KEYS, *_STOP_OUT).where("o IS NOT NULL")


@query(f", {_STOP_ROWS}, src AS (SELECT * FROM opt, sr WHERE opt.t BETWEEN {FIRST} AND {LAST}), {_stop_sql('src', 'idx, trade_date, scrip', 0.01)}")
def sl_single(spark, sf_dir):
    return _stopped(Market(spark, sf_dir).legs, ["idx", "trade_date", "scrip"], closes=F.col("method") == "CC", rate=0.01)


@query(f", {_STOP_ROWS}, {_STRADDLE}, src AS (SELECT * FROM sb, sr), {_stop_sql('src', 'idx, trade_date, strike', 0.01, True)}")
def sl_combined(spark, sf_dir):
    return _stopped(_both_legs(Market(spark, sf_dir)), ["idx", "trade_date", "strike"], combined=True, rate=0.01)


@query(f", {_STOP_ROWS}, src AS (SELECT c.*, sr.* FROM opt c JOIN opt p ON p.idx = c.idx AND p.trade_date = c.trade_date AND p.t = c.t AND p.strike = c.strike AND p.opt_type <> c.opt_type, sr WHERE c.t BETWEEN {FIRST} AND {LAST}), {_stop_sql('src', 'idx, trade_date, scrip', 0.0, target='(55.5)::DOUBLE')}")
def sl_given(spark, sf_dir):
    """Bars that the caller has filtered, here to the minutes that the strike's other leg has too, with a target price."""
    legs = Market(spark, sf_dir).legs.withColumn("strike", fn.strike_of(F.col("scrip")))
    other = legs.select("idx", "trade_date", "strike", F.col("scrip").alias("_o"), F.col("bars").alias("_b"))
    given = legs.join(other, ["idx", "trade_date", "strike"]).where("scrip <> _o").select("idx", "trade_date", "scrip", triggers.common(F.col("bars"), F.col("_b")).alias("bars"))
    return _stopped(given, ["idx", "trade_date", "scrip"], target=F.lit(55.5), closes=F.col("method") == "CC")


@query(f""", dr AS (SELECT * FROM (VALUES (565, 900, 'SELL', 10::DOUBLE), (565, 900, 'BUY', 10::DOUBLE), (610, 900, 'SELL', 0::DOUBLE)) v(start, "end", side, decay)),
d0 AS (SELECT *, first_value(close) OVER w AS o, row_number() OVER w AS i FROM opt, dr WHERE t BETWEEN start AND "end" AND t <= {LAST} WINDOW w AS (PARTITION BY idx, trade_date, scrip, start, "end", side, decay ORDER BY t)),
d1 AS (SELECT *, CASE WHEN decay = 0 THEN o WHEN side = 'SELL' THEN (100 - decay) / 100 * o ELSE (100 + decay) / 100 * o END AS price FROM d0)
SELECT idx, trade_date, scrip, start, "end", side, decay, any_value(price) AS price, CASE WHEN max(i) < 2 THEN NULL WHEN decay = 0 THEN start ELSE min(t) FILTER (i > 1 AND CASE WHEN side = 'SELL' THEN low <= price ELSE high >= price END) END AS t FROM d1 GROUP BY idx, trade_date, scrip, start, "end", side, decay""")
def decay_check(spark, sf_dir):
    sets = spark.createDataFrame([(565, 900, "SELL", 10.0), (565, 900, "BUY", 10.0), (610, 900, "SELL", 0.0)], "start int, end int, side string, decay double")
    keys = ["idx", "trade_date", "scrip", "start", "end", "side", "decay"]
    d = triggers.decay(F.col("bars"), F.col("start"), F.col("end"), side=F.col("side"), percent=F.col("decay"))
    return Market(spark, sf_dir).legs.crossJoin(F.broadcast(sets)).select(*keys, d.alias("d")).select(*keys, "d.o", "d.price", "d.t").where("o IS NOT NULL").drop("o")


def _trailed(spark, sf_dir, mode, **options):
    rows = Market(spark, sf_dir).legs.crossJoin(F.broadcast(spark.createDataFrame([("SELL",), ("BUY",)], "side string")))
    r = triggers.trail(F.col("bars"), F.lit(565), F.lit(900), mode=mode, side=F.col("side"), sl=8.0, **options)
    return rows.select("idx", "trade_date", "scrip", "side", r.alias("r")).select("idx", "trade_date", "scrip", "side", *(f"r.{c}" for c in ("o", "moved", "hit", "t", "exit", "pnl", "status"))).where("o IS NOT NULL")


def _trail_sql(best0: str, stop: str, cross: str, cap: bool = False, sl: str = "8.0", step: str | None = None) -> str:
    """A trailed stop bar by bar in a recursive query. g: 1 for SELL, -1 for BUY; prices times g make both sides alike."""
    best, move, fill = ("nb", "<", "nb") if step is None else (f"CASE WHEN cr THEN best ELSE {step} END", "<=", "best")
    capped = f"CASE WHEN g > 0 THEN greatest({stop}, o) ELSE least({stop}, o) END" if cap else stop
    return f""", b0 AS (SELECT idx, trade_date, scrip, t, high, low, close, g, row_number() OVER (PARTITION BY idx, trade_date, scrip, g ORDER BY t) AS i, first_value(close) OVER (PARTITION BY idx, trade_date, scrip, g ORDER BY t) AS o FROM opt, (VALUES (1), (-1)) v(g) WHERE t BETWEEN 565 AND 900),
b AS (SELECT *, CASE WHEN g > 0 THEN high ELSE low END AS ag, CASE WHEN g > 0 THEN low ELSE high END AS al, (100 + g * {sl}) / 100 * o AS f FROM b0),
f(idx, trade_date, scrip, g, i, o, stop, best, moved, xt, px, last_) AS (SELECT idx, trade_date, scrip, g, i, o, f, ({best0})::DOUBLE, false, NULL::INT, NULL::DOUBLE, NULL::DOUBLE FROM b WHERE i = 1
UNION ALL SELECT idx, trade_date, scrip, g, i, o, CASE WHEN hit OR NOT mv THEN stop ELSE ns END, CASE WHEN hit OR NOT mv THEN best ELSE {best} END, moved OR (mv AND NOT hit), CASE WHEN hit OR cr THEN t END, CASE WHEN hit THEN stop WHEN cr THEN {fill} END, close
 FROM (SELECT *, mv AND NOT hit AND ({cross}) AS cr FROM (SELECT *, {capped} AS ns FROM (SELECT b.idx, b.trade_date, b.scrip, b.g, b.i, b.o, b.t, b.close, b.f, s.stop, s.best, s.moved, b.g * b.ag >= b.g * s.stop AS hit, b.g * b.al {move} b.g * s.best AS mv, b.al AS nb FROM f s JOIN b ON b.idx = s.idx AND b.trade_date = s.trade_date AND b.scrip = s.scrip AND b.g = s.g AND b.i = s.i + 1 WHERE s.xt IS NULL))))
SELECT idx, trade_date, scrip, CASE WHEN g > 0 THEN 'SELL' ELSE 'BUY' END AS side, o, n > 1 AND moved AS moved, xt IS NOT NULL AS hit, xt AS t, CASE WHEN n > 1 THEN coalesce(px, last_) END AS exit, CASE WHEN n > 1 THEN round_even(g * (o - coalesce(px, last_)), 2) + 0 ELSE 0 END AS pnl, 'ok' AS status
FROM (SELECT *, i AS n, row_number() OVER (PARTITION BY idx, trade_date, scrip, g ORDER BY i DESC) AS r FROM f) WHERE r = 1"""


_recursive = lambda s: tape.TAPE_SQL.replace("WITH", "WITH RECURSIVE", 1) + s


@query(_recursive(_trail_sql("o", "f - g * abs(o - nb) * 0.5", "g * ns <= g * nb")), market=False)
def trail_ratio(spark, sf_dir):
    return _trailed(spark, sf_dir, "RATIO", gap=0.5)


@query(_recursive(_trail_sql("o", "nb + (f - o)", "false")), market=False)
def trail_point(spark, sf_dir):
    return _trailed(spark, sf_dir, "POINT")


@query(_recursive(_trail_sql("o", "nb * (1 + g * 8.0 / 100)", "false")), market=False)
def trail_pct(spark, sf_dir):
    return _trailed(spark, sf_dir, "PCT")


@query(_recursive(_trail_sql("o", "f - g * abs(o - nb) * 2.0", "g * ns <= g * nb", cap=True)), market=False)
def trail_cost_cap(spark, sf_dir):
    return _trailed(spark, sf_dir, "RATIO", gap=2.0, to_cost=True)


@query(_recursive(_trail_sql("(100 - g * 3.0) / 100 * o", "stop * (1 - g * 2.0 / 100)", "g * ns <= g * best", step="best * (1 - g * 3.0 / 100)")), market=False)
def trail_step(spark, sf_dir):
    return _trailed(spark, sf_dir, "STEP", step=3.0, sl_step=2.0)


@query(f""", {_ATM}, p AS (SELECT idx, trade_date, t, ce + pe AS premium FROM atm), lb AS (SELECT idx, trade_date, min(premium) * 1.02 AS level FROM p WHERE t BETWEEN 565 AND 625 GROUP BY ALL)
SELECT p.idx, p.trade_date, level, min(t) FILTER (t > 625 AND t <= 895 AND premium <= level) AS t FROM p JOIN lb ON lb.idx = p.idx AND lb.trade_date = p.trade_date GROUP BY ALL""")
def straddle_indicator(spark, sf_dir):
    """The lowest premium of an hour, 2 % up; the first later minute at or under it."""
    premium = Market(spark, sf_dir).atm.select("idx", "trade_date", "t", (F.col("ce") + F.col("pe")).alias("premium"))
    rows = premium.groupBy("idx", "trade_date").agg(F.sort_array(F.collect_list(F.struct("t", "premium"))).alias("m"))
    rows = rows.withColumn("level", F.array_min(F.transform(F.filter("m", lambda x: x["t"].between(565, 625)), lambda x: x["premium"])) * 1.02)
    hit = F.try_element_at(F.filter("m", lambda x: (x["t"] > 625) & (x["t"] <= 895) & (x["premium"] <= F.col("level"))), F.lit(1))
    return rows.where("level IS NOT NULL").select("idx", "trade_date", "level", hit["t"].alias("t"))


@query(f""", {_ATM}, {_ENT}, fv AS (SELECT e.idx, e.trade_date, start, "end", min(t) AS t0, arg_min(strike, t) AS strike, arg_min(ce + pe, t) AS premium FROM ent e JOIN atm a ON a.idx = e.idx AND a.trade_date = e.trade_date AND t BETWEEN start AND "end" GROUP BY e.idx, e.trade_date, start, "end"),
x AS (SELECT v.idx, v.trade_date, start, "end", t0, strike, strike - premium * 20 / 100 AS lower, strike + premium * 20 / 100 AS upper, f.t, f.close, max(f.t) OVER (PARTITION BY v.idx, v.trade_date, start, "end") AS z FROM fv v JOIN fut f ON f.idx = v.idx AND f.trade_date = v.trade_date AND f.t > t0 AND f.t <= "end")
SELECT idx, trade_date, start, "end", t0, lower, upper, min(t) FILTER (t < z AND (close <= lower OR close >= upper)) AS t FROM x GROUP BY idx, trade_date, start, "end", t0, lower, upper""")
def range_sl(spark, sf_dir):
    """The first close of the future out of the band of 20 % of the premium about the strike; the last bar is never tested."""
    m = Market(spark, sf_dir)
    rows = strikes.first_valid(m.atm, _entries(m, _SETS, "start int, end int")).withColumnRenamed("t", "t0")
    lower, upper = fn.band(F.col("strike"), F.col("ce") + F.col("pe"), F.lit(20))
    day = m.futures.groupBy("idx", "trade_date").agg(F.sort_array(F.collect_list(F.struct("t", "close"))).alias("f"))
    rows = rows.withColumn("lower", lower).withColumn("upper", upper).join(day, ["idx", "trade_date"])
    rows = rows.withColumn("w", F.filter("f", lambda x: (x["t"] > F.col("t0")) & (x["t"] <= F.col("end")))).where("size(w) > 0")
    hit = F.filter("w", lambda x: (x["t"] < F.element_at("w", -1)["t"]) & ((x["close"] <= F.col("lower")) | (x["close"] >= F.col("upper"))))
    return rows.select("idx", "trade_date", "start", "end", "t0", "lower", "upper", F.try_element_at(hit, F.lit(1))["t"].alias("t"))


# --- minute by minute --------------------------------------------------------------------------------------------------


_LEVELS = LEVELS
_LADDER = list(range(570, 700, 30))
_FUND, _MARGIN = 1_000_000_000.0, 12.0


def _gridded(m: Market) -> DataFrame:
    """Trades of every leg, entered on a ladder, each with its series on the grid."""
    sets = m.futures.sparkSession.createDataFrame([(t, 900, "SELL", 8.0) for t in _LADDER], "start int, end int, side string, sl double")
    rows = m.legs.crossJoin(F.broadcast(sets))
    r = triggers.stop(F.col("bars"), F.col("start"), F.col("end"), side=F.col("side"), sl=F.col("sl"), rate=0.01)
    points = triggers.let(r, lambda r: mtm.series(F.col("bars"), F.col("start"), F.col("end"), r, F.col("side"), 0.01))
    rows = rows.select("idx", "trade_date", "scrip", "start", points.alias("points"))
    return rows.select("*", mtm.filled(F.col("points"), FIRST, LAST, 10).alias("grid"))


def _exploded(rows: DataFrame, array: str) -> DataFrame:
    out = rows.select("idx", "trade_date", "scrip", "start", F.explode_outer(array).alias("x"))
    return out.select("idx", "trade_date", "scrip", "start", "x.t", F.round("x.mtm", 4).alias("mtm")).where("t IS NOT NULL")


def _portfolio(m: Market, *parts: str) -> DataFrame:
    """The session's profit a minute, and that of its calls and puts as ce and pe."""
    rows = _gridded(m).withColumn("kind", F.lower(fn.type_of(F.col("scrip"))))
    one = mtm.portfolio(rows, ["idx", "trade_date", "kind"]) if parts else mtm.portfolio(rows, ["idx", "trade_date"])
    if parts:
        one = one.groupBy("idx", "trade_date", "t").agg(F.sum("mtm").alias("mtm"), *(F.sum(F.when(F.col("kind") == k, F.col("mtm")).otherwise(0.0)).alias(k) for k in parts))
    return one.select("idx", "trade_date", "t", *(F.round(c, 4).alias(c) for c in ("mtm", *parts)))


@query(f"SELECT idx, trade_date, unnest(range({FIRST}, {LAST + 1}, 10))::INT AS t FROM (SELECT DISTINCT idx, trade_date FROM ft)")
def minute_grid(spark, sf_dir):
    return mtm.minute_grid(Market(spark, sf_dir).days, FIRST, LAST, 10)


_MSETS = f"sr AS (SELECT unnest({_LADDER}) AS start, 900 AS \"end\", 'SELL' AS side, 'HL' AS method, 8.0::DOUBLE AS sl, 0.0::DOUBLE AS intra_sl)"
_MTM = f"{_MSETS}, src AS (SELECT * FROM opt, sr WHERE opt.t BETWEEN {FIRST} AND {LAST}), tr AS (WITH {_stop_sql('src', 'idx, trade_date, scrip', 0.01)})"
_SERIES = f"""{_MTM}, se0 AS (SELECT tr.*, o2.t AS bt, o2.close, row_number() OVER (PARTITION BY tr.idx, tr.trade_date, tr.scrip, tr.start ORDER BY o2.t) AS i FROM tr JOIN opt o2 ON o2.idx = tr.idx AND o2.trade_date = tr.trade_date AND o2.scrip = tr.scrip AND o2.t BETWEEN tr.start AND 900),
se AS (SELECT idx, trade_date, scrip, start, bt AS t, CASE WHEN bt = max(bt) OVER (PARTITION BY idx, trade_date, scrip, start) THEN pnl ELSE o - close - o * 0.01 END AS mtm FROM se0 WHERE i > 1 AND bt <= coalesce(t, 900))"""


@query(f", {_SERIES} SELECT idx, trade_date, scrip, start, t, round(mtm, 4) + 0 AS mtm FROM se")
def mtm_series(spark, sf_dir):
    return _exploded(_gridded(Market(spark, sf_dir)), "points")


_FILLED = f"""{_SERIES}, gr AS (SELECT idx, trade_date, scrip, start, unnest(range({FIRST}, {LAST + 1}, 10)) AS t FROM (SELECT DISTINCT idx, trade_date, scrip FROM opt WHERE t BETWEEN {FIRST} AND {LAST}), (SELECT start FROM sr)),
fl AS (SELECT g.idx, g.trade_date, g.scrip, g.start, g.t, coalesce(s.mtm, 0) AS mtm FROM gr g ASOF LEFT JOIN se s ON s.idx = g.idx AND s.trade_date = g.trade_date AND s.scrip = g.scrip AND s.start = g.start AND s.t <= g.t)"""


@query(f", {_FILLED} SELECT idx, trade_date, scrip, start, t, round(mtm, 4) + 0 AS mtm FROM fl")
def mtm_fill(spark, sf_dir):
    return _exploded(_gridded(Market(spark, sf_dir)), "grid")


@query(f", {_FILLED} SELECT idx, trade_date, t, round(sum(mtm), 4) AS mtm FROM fl GROUP BY ALL")
def mtm_portfolio(spark, sf_dir):
    return _portfolio(Market(spark, sf_dir))


_PF = f"""{_FILLED}, pf AS (SELECT idx, trade_date, t, round(sum(mtm), 4) AS mtm, round(sum(CASE WHEN scrip LIKE '%CE' THEN mtm ELSE 0 END), 4) AS ce, round(sum(CASE WHEN scrip LIKE '%PE' THEN mtm ELSE 0 END), 4) AS pe FROM fl GROUP BY ALL),
f0 AS (SELECT idx, trade_date, arg_min(close, t) AS future FROM fut WHERE t BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
ps AS (SELECT idx, trade_date, t, round(mtm * n, 2) AS mtm, round(ce * n, 2) AS ce, round(pe * n, 2) AS pe FROM (SELECT pf.*, floor({_FUND} // {len(_LADDER)} / (future * {_MARGIN} / 100)) AS n FROM pf JOIN f0 USING (idx, trade_date))),
lv AS (SELECT unnest({[float(x) for x in _LEVELS]})::DOUBLE AS level),
cr AS (SELECT ps.*, level, row_number() OVER w AS i, count(*) OVER (PARTITION BY idx, trade_date, level) AS n, CASE WHEN level > 0 THEN mtm > level * {_FUND} / 100 ELSE mtm < level * {_FUND} / 100 END AS b FROM ps, lv WINDOW w AS (PARTITION BY idx, trade_date, level ORDER BY t)),
fc AS (SELECT idx, trade_date, level, min(i) FILTER (b) AS due, any_value(n) AS n FROM cr GROUP BY idx, trade_date, level)"""
_PAID = """FROM fc f JOIN cr c ON c.idx = f.idx AND c.trade_date = f.trade_date AND c.level = f.level AND c.i = CASE WHEN due < f.n THEN due + 1 ELSE f.n END
LEFT JOIN cr x ON x.idx = f.idx AND x.trade_date = f.trade_date AND x.level = f.level AND x.i = CASE WHEN due < f.n THEN due END"""


def _levels(m: Market, *parts: str) -> DataFrame:
    """The portfolio's profit in money, of whole shares by fund and margin, and what each level pays a minute after its crossing."""
    m.stored()
    price = m.session_futures.groupBy("idx", "trade_date").agg(F.min_by("close", "t").alias("future"))
    total = _portfolio(m, *parts).join(price, ["idx", "trade_date"]).withColumn("n", rollup.shares(_FUND, _MARGIN, F.col("future"), len(_LADDER)))
    total = total.select("idx", "trade_date", "t", *(F.round(F.col(c) * F.col("n"), 2).alias(c) for c in ("mtm", *parts)))
    return rollup.crossings(total, ["idx", "trade_date"], _LEVELS, F.lit(_FUND), 1, [*parts])


@query(f", {_PF} SELECT c.idx, c.trade_date, c.level, x.t AS t, c.mtm AS paid {_PAID}")
def psl_levels(spark, sf_dir):
    return _levels(Market(spark, sf_dir))


@query(f", {_PF} SELECT c.idx, c.trade_date, c.level, x.t AS t, c.mtm AS paid, c.ce AS paid_ce, c.pe AS paid_pe {_PAID}")
def psl_by_part(spark, sf_dir):
    """The crossing is the total's; calls and puts are paid apart at its minute."""
    return _levels(Market(spark, sf_dir), "ce", "pe")


_MINUTES = list(range(FIRST, LAST + 1, 10))


@query(f""", {_FILLED} SELECT idx, trade_date, {", ".join(f'round(sum(mtm) FILTER (t = {t}), 4) AS m{t}' for t in _MINUTES)} FROM fl GROUP BY ALL""")
def mtm_wide(spark, sf_dir):
    """A column for each minute of the session."""
    wide = mtm.wide(_portfolio(Market(spark, sf_dir)), ["idx", "trade_date"], _MINUTES)
    return wide.withColumnsRenamed({str(t): f"m{t}" for t in _MINUTES})


# --- reports -----------------------------------------------------------------------------------------------------------


def _log(spark, sf_dir) -> DataFrame:
    line = tape.table(spark, sf_dir, "lineitem")
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    return line.select(
        F.concat(F.lit("IDX"), (F.col("l_suppkey") % 3).cast("string")).alias("P_index"), F.col("l_returnflag").alias("P_flag"), F.col("l_linestatus").alias("P_status"), F.col("l_linenumber").alias("P_line"),
        F.to_date("l_shipdate").alias("Date"), (F.dayofmonth("l_shipdate") % 5 + 1).alias("DTE"), F.col("l_quantity").alias("Future"),
        (cents % 2001 - 1000).cast("double").alias("A_PNL"), (cents % 1501 - 700).cast("double").alias("B_PNL"),
    )


_LOG = "WITH log AS (SELECT 'IDX' || (l_suppkey % 3) AS P_index, l_returnflag AS P_flag, l_linestatus AS P_status, l_linenumber AS P_line, CAST(l_shipdate AS DATE) AS Date, day(l_shipdate) % 5 + 1 AS DTE, l_quantity AS Future, (round_even(l_extendedprice * 100, 0)::BIGINT % 2001 - 1000)::DOUBLE AS A_PNL, (round_even(l_extendedprice * 100, 0)::BIGINT % 1501 - 700)::DOUBLE AS B_PNL FROM lineitem)"
_CUBE = f"{_LOG}, cube_ AS (SELECT P_index, P_flag, P_status, P_line, year(Date) AS Year, month(Date) AS Month, DTE, sum(A_PNL) AS A_PNL, sum(B_PNL) AS B_PNL FROM log GROUP BY ALL), long AS (SELECT P_index AS index, P_flag AS flag, P_status AS status, P_line AS line, Year, Month, DTE, 'A_PNL' AS \"PL Basis\", A_PNL AS Points FROM cube_ UNION ALL SELECT P_index, P_flag, P_status, P_line, Year, Month, DTE, 'B_PNL', B_PNL FROM cube_)"


@query(f"{_CUBE} SELECT * FROM cube_", market=False)
def cube_sum(spark, sf_dir):
    return rollup.cube_sum(_log(spark, sf_dir))


def _long(spark, sf_dir) -> DataFrame:
    return rollup.cube_unpivot(rollup.cube_sum(_log(spark, sf_dir)))


@query(f"{_CUBE} SELECT * FROM long", market=False)
def cube_unpivot(spark, sf_dir):
    return _long(spark, sf_dir)


_NV = "nv AS (SELECT * FROM (VALUES ('IDX0', 50), ('IDX1', 25)) v(i, nv))"


@query(f"{_LOG}, {_NV}, nl AS (SELECT log.* REPLACE (round_even(A_PNL * 10000 / (Future * nv), 2) AS A_PNL, round_even(B_PNL * 10000 / (Future * nv), 2) AS B_PNL) FROM log LEFT JOIN nv ON i = P_index) SELECT P_index, P_flag, round(sum(A_PNL), 2) AS a, round(sum(B_PNL), 2) AS b, count(A_PNL) AS n FROM nl GROUP BY ALL", market=False)
def normalise_pnl(spark, sf_dir):
    rows = rollup.normalised_log(_log(spark, sf_dir), spark.createDataFrame([("IDX0", 50), ("IDX1", 25)], "i string, nv int"))
    return rows.groupBy("P_index", "P_flag").agg(F.round(F.sum("A_PNL"), 2).alias("a"), F.round(F.sum("B_PNL"), 2).alias("b"), F.count("A_PNL").alias("n"))


@query(f"{_LOG}, {_NV}, nl AS (SELECT log.* REPLACE (round_even(A_PNL * 10000 / (Future * nv), 2) AS A_PNL, round_even(B_PNL * 10000 / (Future * nv), 2) AS B_PNL) FROM log LEFT JOIN nv ON i = P_index) SELECT P_index, P_flag, P_status, P_line, year(Date) AS Year, month(Date) AS Month, DTE, round(sum(A_PNL), 2) AS A_PNL, round(sum(B_PNL), 2) AS B_PNL FROM nl GROUP BY ALL", market=False)
def cube_normalised(spark, sf_dir):
    rows = rollup.normalised_log(_log(spark, sf_dir), spark.createDataFrame([("IDX0", 50), ("IDX1", 25)], "i string, nv int"))
    cube = rollup.cube_sum(rows)
    return cube.withColumns({c: F.round(c, 2) for c in ("A_PNL", "B_PNL")})


@query(f"{_CUBE} SELECT DISTINCT 'flag' AS dimension, flag AS value FROM long UNION SELECT 'line', line::VARCHAR FROM long UNION SELECT 'Month', Month::VARCHAR FROM long", market=False)
def dim_catalog(spark, sf_dir):
    return rollup.dim_catalog(_long(spark, sf_dir), "flag", "line", "Month")


@query(f"{_LOG} SELECT P_index, count(*) AS n, sum(A_PNL) AS a FROM (SELECT P_index, A_PNL FROM log UNION ALL SELECT P_index, NULL FROM log) GROUP BY ALL", market=False)
def log_union(spark, sf_dir):
    log = _log(spark, sf_dir)
    return rollup.stacked(log, log.drop("A_PNL")).groupBy("P_index").agg(F.count("*").alias("n"), F.sum("A_PNL").alias("a"))


@query(f"{_CUBE} SELECT flag, {', '.join(f'coalesce(round(sum(Points) FILTER (line = {i}), 2), 0) AS line_{i}' for i in range(1, 9))} FROM long GROUP BY flag", market=False)
def heatmap(spark, sf_dir):
    return rollup.heatmap(_long(spark, sf_dir), "flag", "line", list(range(1, 9)))


@query(f"{_CUBE} SELECT flag, line, (grouping(flag) * 2 + grouping(line))::INT AS level, sum(Points) AS points FROM long GROUP BY CUBE (flag, line)", market=False)
def heatmap_totals(spark, sf_dir):
    return rollup.heatmap_totals(_long(spark, sf_dir), "flag", "line")


_PERIODS = "per AS (SELECT flag, line, Year, Month, sum(Points) AS points FROM long GROUP BY ALL)"


def _periods(spark, sf_dir) -> DataFrame:
    return rollup.period_pnl(_long(spark, sf_dir), ["flag", "line"])


@query(f"{_CUBE}, {_PERIODS} SELECT * FROM per", market=False)
def period_pnl(spark, sf_dir):
    return _periods(spark, sf_dir)


_DD = "run AS (SELECT flag, line, Year, Month, sum(points) OVER (PARTITION BY flag, line ORDER BY Year, Month) AS s FROM per), dd AS (SELECT flag, line, min(s - p) AS drawdown FROM (SELECT *, greatest(max(s) OVER (PARTITION BY flag, line ORDER BY Year, Month), 0) AS p FROM run) GROUP BY ALL)"


@query(f"{_CUBE}, {_PERIODS}, {_DD} SELECT * FROM dd", market=False)
def max_drawdown(spark, sf_dir):
    return rollup.max_drawdown(_periods(spark, sf_dir), ["flag", "line"], ["Year", "Month"])


_AVG = "av AS (SELECT flag, line, sum(points) AS total, sum(points) / count(DISTINCT (Year, Month)) * 12 AS avg_year, sum(points) / (SELECT count(DISTINCT (Year, Month)) FROM per) AS avg_month FROM per GROUP BY flag, line)"


@query(f"{_CUBE}, {_PERIODS}, {_AVG} SELECT flag, line, total, avg_year FROM av", market=False)
def avg_year(spark, sf_dir):
    return rollup.averages(_periods(spark, sf_dir), ["flag", "line"]).drop("avg_month")


@query(f"{_CUBE}, {_PERIODS}, {_AVG} SELECT flag, line, total, avg_month FROM av", market=False)
def avg_month(spark, sf_dir):
    return rollup.averages(_periods(spark, sf_dir), ["flag", "line"]).drop("avg_year")


@query(f"{_CUBE}, {_PERIODS}, {_AVG}, {_DD} SELECT flag, line, avg_year, drawdown, CASE WHEN drawdown = 0 THEN 0 ELSE avg_year / abs(drawdown) END AS calmar FROM av JOIN dd USING (flag, line)", market=False)
def calmar(spark, sf_dir):
    return rollup.calmar(_periods(spark, sf_dir), ["flag", "line"])


@query("SELECT idx, trade_date, scrip, arg_min(close, t) AS o, max(high) AS h, min(low) AS l, arg_max(close, t) AS c FROM opt GROUP BY ALL")
def leg_ohlc(spark, sf_dir):
    return rollup.leg_ohlc(Market(spark, sf_dir).options, ["idx", "trade_date", "scrip"])


@query(f"{_CUBE} SELECT * FROM long WHERE flag IN ('A', 'R') AND Month IN (1, 2) AND \"PL Basis\" = 'A_PNL'", market=False)
def slicer_filter(spark, sf_dir):
    return rollup.sliced(_long(spark, sf_dir), flag=["A", "R"], Month=[1, 2], **{"PL Basis": ["A_PNL"]})


@query("""SELECT label, row_number() OVER (ORDER BY k, CASE WHEN k = 1 THEN suffix ELSE '' END, x, CASE WHEN k = 2 THEN label ELSE '' END)::INT AS place FROM (SELECT *, CASE WHEN x IS NULL THEN 2 WHEN suffix = '' THEN 0 ELSE 1 END AS k FROM (
SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size::VARCHAR || 'SD' ELSE 'ATM' || p_size END AS label, CASE WHEN p_size % 3 < 2 THEN p_size END AS x, CASE WHEN p_size % 3 = 1 THEN 'SD' ELSE '' END AS suffix FROM part))""", market=False)
def natural_order(spark, sf_dir):
    label = F.expr("CASE p_size % 3 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(CAST(p_size AS STRING), 'SD') ELSE concat('ATM', CAST(p_size AS STRING)) END")
    labels = tape.table(spark, sf_dir, "part").select(label.alias("label")).distinct()
    return labels.select("label", F.row_number().over(Window.orderBy(fn.order_key(F.col("label")))).alias("place"))  # a dimension's values


@query(f"""{_CUBE}, cells AS (SELECT flag, line, sum(Points) AS p FROM long GROUP BY ALL)
SELECT flag, line, (grouping(flag) * 2 + grouping(line))::INT AS level, round(avg(p), 6) AS points FROM cells GROUP BY CUBE (flag, line)""", market=False)
def heatmap_means(spark, sf_dir):
    """heatmap_totals as the other sheets have them: means of the cells."""
    return rollup.heatmap_totals(_long(spark, sf_dir), "flag", "line", means=True).withColumn("points", F.round("points", 6))


# --- files: written, read back ------------------------------------------------------------------------------------------


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/strikelab/{name}-{uuid.uuid4().hex}"


@query(f"{_LOG} SELECT P_index AS idx, date_trunc('month', Date)::DATE AS trade_date, P_flag, count(*) AS n, sum(A_PNL) AS a, count(*) FILTER (P_status <> 'O') AS with_status FROM log WHERE P_line % 4 <> 0 GROUP BY ALL", market=False)
def write_log(spark, sf_dir):
    """Rows without an entry time are not written, blank texts are null."""
    log = _log(spark, sf_dir).withColumnsRenamed({"P_index": "idx", "Date": "trade_date"}).withColumn("trade_date", F.trunc("trade_date", "month"))
    log = log.withColumn("EntryTime", F.when(F.col("P_line") % 4 == 0, "").otherwise("09:20:00")).withColumn("P_status", F.when(F.col("P_status") == "O", "").otherwise(F.col("P_status")))
    at = _new_folder(spark, "log")
    files.write_log(log.repartition("idx", "trade_date"), at)
    return spark.read.parquet(at).groupBy("idx", "trade_date", "P_flag").agg(F.count("*").alias("n"), F.sum("A_PNL").alias("a"), F.count("P_status").alias("with_status"))


@query(f'{_CUBE} SELECT index AS "Index", Year, "PL Basis", flag, count(*) AS n, sum(Points) AS points FROM long GROUP BY ALL', market=False)
def write_cube(spark, sf_dir):
    at, keys = _new_folder(spark, "cube"), ("Index", "Year", "PL Basis")
    files.write_cube(_long(spark, sf_dir).withColumnRenamed("index", "Index"), at, keys, rows=1000)
    return spark.read.parquet(at).groupBy(*keys, "flag").agg(F.count("*").alias("n"), F.sum("Points").alias("points"))


@query(f"{_LOG} SELECT P_index AS \"Index\", year(Date) AS Year, dayname(Date) AS Day, P_flag, count(DISTINCT (P_status, P_line, DTE)) AS n, sum(A_PNL) AS a FROM log GROUP BY ALL", market=False)
def write_cube_csv(spark, sf_dir):
    """The cube by weekday, as text."""
    log = _log(spark, sf_dir).withColumn("Day", grid.weekday(F.col("Date")))
    cube = rollup.cube_sum(log, period=("Year", "Day", "DTE")).withColumnRenamed("P_index", "Index")
    at = _new_folder(spark, "cube-csv")
    files.write_cube_csv(cube, at)
    back = spark.read.option("header", True).schema(cube.schema).csv(at)
    return back.groupBy("Index", "Year", "Day", "P_flag").agg(F.count("*").alias("n"), F.sum("A_PNL").alias("a"))


@query(f"{_LOG} SELECT P_index, P_flag, P_status, P_line, count(*) AS n, sum(A_PNL) AS a, 1::BIGINT AS buckets FROM log GROUP BY P_index, P_flag, P_status, P_line", market=False)
def write_by_param(spark, sf_dir):
    """Every set lies in one bucket."""
    at = _new_folder(spark, "by-param")
    files.write_by_param(_log(spark, sf_dir), at, 8)
    return spark.read.parquet(at).groupBy("P_index", "P_flag", "P_status", "P_line").agg(F.count("*").alias("n"), F.sum("A_PNL").alias("a"), F.countDistinct("bucket").alias("buckets"))


@query("""SELECT 'sl' AS name, (p_size % 7)::VARCHAR AS value, count(*) AS n FROM part WHERE p_size % 7 <> 0 GROUP BY ALL
UNION ALL SELECT 'method', CASE WHEN p_size % 2 = 0 THEN 'HL' ELSE 'CC' END, count(*) FROM part WHERE p_size % 3 <> 0 GROUP BY ALL""", market=False)
def read_params(spark, sf_dir):
    """Each column of a text file is a list of its own; blanks go."""
    part, at = tape.table(spark, sf_dir, "part"), _new_folder(spark, "params")
    part.select(F.when(F.col("p_size") % 7 != 0, F.concat(F.lit(" "), (F.col("p_size") % 7).cast("string"))).otherwise(" ").alias("sl"), F.expr("CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'HL' ELSE 'CC' END").alias("method")).write.option("header", True).csv(at)
    lists = files.read_params(spark, at)
    return lists["sl"].select(F.lit("sl").alias("name"), F.col("sl").alias("value")).unionByName(lists["method"].select(F.lit("method").alias("name"), F.col("method").alias("value"))).groupBy("name", "value").agg(F.count("*").alias("n"))


@query("""SELECT n_name AS idx, g::INT AS group_no, entry, om, sl, ut_sl FROM (
SELECT n_name, 0 AS g, (540 + n_nationkey)::VARCHAR AS entry, '0' AS om, n_regionkey::VARCHAR AS sl, 'TTC' AS ut_sl FROM nation
UNION ALL SELECT n_name, 1, (600 + n_nationkey)::VARCHAR, 'ATM+1', '5', n_regionkey::VARCHAR FROM nation WHERE n_nationkey % 3 <> 0)""", market=False)
def read_queue(spark, sf_dir):
    """Blocks of four columns, a group each; blank blocks go."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    blank = lambda c: F.when(n % 3 != 0, c)
    wide = tape.table(spark, sf_dir, "nation").select("n_name", (540 + n).cast("string").alias("e1"), F.lit("0").alias("o1"), r.alias("s1"), F.lit("TTC").alias("u1"), blank((600 + n).cast("string")).alias("e2"), blank(F.lit("ATM+1")).alias("o2"), blank(F.lit("5")).alias("s2"), blank(r).alias("u2"))
    return files.read_queue(wide)


@query("SELECT DISTINCT 'bad-' || l_linenumber || '.parquet' AS file FROM lineitem WHERE l_linenumber <= 2", market=False)
def audit_files(spark, sf_dir):
    """Files that are no Parquet among a log's files are found."""
    at = _new_folder(spark, "audit")
    log = _log(spark, sf_dir)
    log.write.parquet(at)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for r in log.where("P_line <= 2").select("P_line").distinct().collect():  # one row a line number
        path = hadoop(f"{at}/bad-{r[0]}.parquet")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(b"not a parquet file"))
        out.close()
    return files.unreadable(spark, at).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"))


# --- indicators ---------------------------------------------------------------------------------------------------------

_CALLS = "CASE positions WHEN 1 THEN 'CE' WHEN -1 THEN 'PE' WHEN 0 THEN '' END AS buy, CASE positions WHEN 1 THEN 'PE' WHEN -1 THEN 'CE' WHEN 0 THEN '' END AS sell"


@query(f"""SELECT *, {_CALLS} FROM (SELECT idx, trade_date, t, close, short_ma, long_ma, signal, signal - lag(signal) OVER (PARTITION BY idx, trade_date ORDER BY t) AS positions FROM (SELECT *, (short_ma > long_ma)::INT AS signal FROM (SELECT idx, trade_date, t, close, round(avg(close) OVER (w ROWS 4 PRECEDING), 6) AS short_ma, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN round(avg(close) OVER (w ROWS 19 PRECEDING), 6) END AS long_ma FROM fut WINDOW w AS (PARTITION BY idx, trade_date ORDER BY t)) WHERE long_ma IS NOT NULL))""")
def ma_cross(spark, sf_dir):
    bars = Market(spark, sf_dir).futures.select("idx", "trade_date", "t", "close")
    return indicators.moving_cross(bars, 5, 20, places=6).withColumns({c: F.round(c, 6) for c in ("short_ma", "long_ma")})


_FUT_I = "b AS (SELECT idx, trade_date, t, high, low, close, row_number() OVER w AS i, lag(close) OVER w AS before FROM fut WINDOW w AS (PARTITION BY idx, trade_date ORDER BY t))"
_NEXT = "JOIN b ON b.idx = s.idx AND b.trade_date = s.trade_date AND b.i = s.i + 1"


@query(_recursive(f""", {_FUT_I}, e(idx, trade_date, t, i, close, a, z) AS (SELECT idx, trade_date, t, i, close, close, close FROM b WHERE i = 1 UNION ALL SELECT b.idx, b.trade_date, b.t, b.i, b.close, 2.0::DOUBLE / 6 * b.close + (1 - 2.0::DOUBLE / 6) * s.a, 2.0::DOUBLE / 21 * b.close + (1 - 2.0::DOUBLE / 21) * s.z FROM e s {_NEXT})
SELECT *, {_CALLS} FROM (SELECT *, signal - lag(signal) OVER (PARTITION BY idx, trade_date ORDER BY t) AS positions FROM (SELECT idx, trade_date, t, close, round(a, 6) AS short_ma, round(z, 6) AS long_ma, (round(a, 9) > round(z, 9))::INT AS signal FROM e))"""), market=False)
def ma_cross_ema(spark, sf_dir):
    """Exponential means."""
    bars = Market(spark, sf_dir).futures.select("idx", "trade_date", "t", "close")
    return indicators.moving_cross(bars, 5, 20, short_type="EXPONENTIAL", long_type="EXPONENTIAL", places=9).withColumns({c: F.round(c, 6) for c in ("short_ma", "long_ma")})


_TR = f"{_FUT_I}, tr AS (SELECT *, greatest(high - low, coalesce(abs(high - before), 0), coalesce(abs(low - before), 0)) AS tr FROM b)"


def _wilder_sql(name: str, src: str, x: str, seed: int, first: int, period: int) -> str:
    """name: idx, trade_date, i, v from i = seed on: the mean of x from row `first` to the seed, then (before * (n - 1) + x) / n."""
    return f"""{name}(idx, trade_date, i, v) AS (SELECT idx, trade_date, {seed}, avg({x}) FROM {src} WHERE i BETWEEN {first} AND {seed} GROUP BY idx, trade_date HAVING count(*) = {period}
UNION ALL SELECT c.idx, c.trade_date, c.i::INT, (s.v * {period - 1} + c.{x}) / {period} FROM {name} s JOIN {src} c ON c.idx = s.idx AND c.trade_date = s.trade_date AND c.i = s.i + 1)"""


@query(_recursive(f", {_TR}, {_wilder_sql('w', 'tr', 'tr', 10, 1, 10)} SELECT tr.idx, tr.trade_date, tr.t, high, low, close, round(tr, 6) AS tr, round(v, 6) AS atr FROM tr LEFT JOIN w ON w.idx = tr.idx AND w.trade_date = tr.trade_date AND w.i = tr.i"), market=False)
def atr(spark, sf_dir):
    return indicators.atr(_bars(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("tr", "atr")})


_BANDS = "m AS (SELECT tr.*, v, (high + low) / 2 + 3.0 * v AS ub, (high + low) / 2 - 3.0 * v AS lb FROM tr JOIN w ON w.idx = tr.idx AND w.trade_date = tr.trade_date AND w.i = tr.i)"


@query(_recursive(f""", {_TR}, {_wilder_sql("w", "tr", "tr", 10, 1, 10)}, {_BANDS},
st(idx, trade_date, i, up, u, l) AS (SELECT idx, trade_date, i, 1, ub, lb FROM m WHERE i = 10
UNION ALL SELECT idx, trade_date, i, coalesce(side, was), CASE WHEN side IS NULL AND was = -1 THEN least(ub, pu) ELSE ub END, CASE WHEN side IS NULL AND was = 1 THEN greatest(lb, pl) ELSE lb END
 FROM (SELECT m.idx, m.trade_date, m.i, m.ub, m.lb, s.up AS was, s.u AS pu, s.l AS pl, CASE WHEN m.close > s.u THEN 1 WHEN m.close < s.l THEN -1 END AS side FROM st s JOIN m ON m.idx = s.idx AND m.trade_date = s.trade_date AND m.i = s.i + 1)),
y AS (SELECT tr.idx, tr.trade_date, tr.t, high, low, close, up::INT AS up, round(CASE WHEN tr.i > 10 THEN CASE WHEN up = 1 THEN l WHEN up = -1 THEN u END END, 6) AS level, (up - lag(up) OVER (PARTITION BY tr.idx, tr.trade_date ORDER BY tr.t)) / 2.0::DOUBLE AS positions FROM tr LEFT JOIN st ON st.idx = tr.idx AND st.trade_date = tr.trade_date AND st.i = tr.i)
SELECT *, {_CALLS} FROM y"""), market=False)
def supertrend(spark, sf_dir):
    return indicators.supertrend(_bars(spark, sf_dir)).withColumn("level", F.round("level", 6))


@query(_recursive(f""", {_FUT_I}, d AS (SELECT *, greatest(coalesce(close - before, 0), 0) AS u, greatest(coalesce(before - close, 0), 0) AS dn FROM b), {_wilder_sql('wu', 'd', 'u', 15, 2, 14)}, {_wilder_sql('wd', 'd', 'dn', 15, 2, 14)},
r AS (SELECT d.*, CASE WHEN wd.v = 0 THEN CASE WHEN wu.v > 0 THEN 100 END ELSE 100 - 100 / (1 + wu.v / wd.v) END AS rsi FROM d LEFT JOIN wu ON wu.idx = d.idx AND wu.trade_date = d.trade_date AND wu.i = d.i LEFT JOIN wd ON wd.idx = d.idx AND wd.trade_date = d.trade_date AND wd.i = d.i),
y AS (SELECT idx, trade_date, t, high, low, close, round(rsi, 6) AS rsi, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END::INT AS signal FROM r),
x AS (SELECT *, (signal - lag(signal) OVER (PARTITION BY idx, trade_date ORDER BY t))::DOUBLE AS positions FROM y)
SELECT *, CASE positions WHEN 1 THEN 'CE' WHEN 0 THEN '' WHEN -1 THEN '' ELSE positions::VARCHAR END AS buy, CASE positions WHEN -1 THEN 'PE' WHEN 0 THEN '' WHEN 1 THEN '' ELSE positions::VARCHAR END AS sell FROM x"""), market=False)
def rsi(spark, sf_dir):
    return indicators.rsi(_bars(spark, sf_dir)).withColumn("rsi", F.round("rsi", 6))


def _ema_sql(name: str, src: str, x: str, start: int, n: int) -> str:
    a = f"(2.0::DOUBLE / {n + 1})"
    return f"""{name}(idx, trade_date, i, v) AS (SELECT idx, trade_date, i, {x} FROM {src} WHERE i = {start} UNION ALL SELECT c.idx, c.trade_date, c.i, {a} * c.{x} + (1 - {a}) * s.v FROM {name} s JOIN {src} c ON c.idx = s.idx AND c.trade_date = s.trade_date AND c.i = s.i + 1)"""


@query(_recursive(f""", {_FUT_I}, {_ema_sql("f", "b", "close", 1, 12)}, {_ema_sql("sl", "b", "close", 1, 26)},
ml AS (SELECT b.idx, b.trade_date, b.i, f.v - sl.v AS m FROM b JOIN f ON f.idx = b.idx AND f.trade_date = b.trade_date AND f.i = b.i JOIN sl ON sl.idx = b.idx AND sl.trade_date = b.trade_date AND sl.i = b.i WHERE b.i > 33), {_ema_sql("sg", "ml", "m", 34, 9)},
z AS (SELECT b.*, m, CASE WHEN sg.i >= 42 THEN sg.v END AS g FROM b LEFT JOIN ml ON ml.idx = b.idx AND ml.trade_date = b.trade_date AND ml.i = b.i LEFT JOIN sg ON sg.idx = b.idx AND sg.trade_date = b.trade_date AND sg.i = b.i),
y AS (SELECT *, m - g AS h, lag(m - g) OVER (PARTITION BY idx, trade_date ORDER BY t) AS ph FROM z),
x AS (SELECT *, CASE WHEN h > 0 AND ph <= 0 THEN 1 WHEN h < 0 AND ph >= 0 THEN -1 ELSE 0 END::INT AS crossing FROM y)
SELECT idx, trade_date, t, high, low, close, round(m, 6) AS macd, round(g, 6) AS signal_line, round(h, 6) AS hist, crossing, CASE crossing WHEN 1 THEN 'CE' ELSE '' END AS buy, CASE crossing WHEN -1 THEN 'PE' ELSE '' END AS sell FROM x"""), market=False)
def macd(spark, sf_dir):
    return indicators.macd(_bars(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("macd", "signal_line", "hist")})


def _bars(spark, sf_dir) -> DataFrame:
    return Market(spark, sf_dir).futures.select("idx", "trade_date", "t", "high", "low", "close")


from strikelab import grid_queries, instrument_queries, modifier_queries, series_queries, spread_queries, strategy_queries  # noqa: E402, F401  register the strategies


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total points of B120 by entry time, stop and month."""
    trades = strategy_queries.st_b120(spark, sf_dir)
    return trades.groupBy("start", "side", "method", "sl", F.month("trade_date").alias("month")).agg(F.round(F.sum("total_pnl"), 2).alias("points"), F.count("*").alias("trades"))
