"""Parameter rules by strategy, and a sweep from a parameter file to the cube."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelab import registry as r
from strikelab import strategy_sql as sql
from strikelab.catalog import Market, query
from strikelab.operators import rollup
from strikelab.plans import grid, rules
from strikelab.plans import strategies as st
from strikelab.sources import files, tape

#: A table of sets with the columns of all families, a row a part: the same text for Spark and DuckDB.
_SETS = """SELECT 540 + k % 9 * 20 AS entry_time, 560 + k % 7 * 40 AS exit_time, 550 + k % 11 * 15 AS last_trade_time, concat((k % 3 + 1) * 10, 'min') AS trade_interval, 700 + k % 4 * 10 AS entry_time2, 760 + k % 5 * 10 AS exit_time2, 700 + k % 6 * 10 AS last_trade_time2,
concat((k % 2 + 1) * 10, 'min') AS trade_interval2, 540 + k % 13 * 15 AS till_time, CASE WHEN k % 2 = 0 THEN 'sell' ELSE 'Buy' END AS orderside, CASE WHEN k % 3 = 0 THEN 'hl' ELSE 'cc' END AS method, CASE WHEN k % 5 = 0 THEN 'buy' ELSE 'Sell' END AS ut_orderside, CASE WHEN k % 7 = 0 THEN 'hl' ELSE 'Cc' END AS ut_method,
CASE WHEN k % 3 = 1 THEN 'buy' ELSE 'Sell' END AS tt_orderside, CASE WHEN k % 4 = 0 THEN 'hl' ELSE 'cc' END AS tt_method, CASE WHEN k % 2 = 0 THEN 'low' ELSE 'Avg' END AS std_indicator, k % 4 * 5 AS sl, k % 3 * 5 AS sl2,
CASE k % 5 WHEN 0 THEN '0' WHEN 1 THEN 'sl+5' WHEN 2 THEN '10' WHEN 3 THEN '20' ELSE 'sl+0' END AS intra_sl, CASE k % 3 WHEN 0 THEN 'ttc' WHEN 1 THEN '10' ELSE '0' END AS ut_sl, CASE k % 4 WHEN 0 THEN 'ttc' WHEN 1 THEN '5' ELSE '0' END AS ut_sl2, CASE k % 3 WHEN 0 THEN 'sl+5' WHEN 1 THEN '10' ELSE '0' END AS re_sl,
k % 2 * 4 AS dt_sl, k % 3 * 4 AS fsl, k % 2 * 6 AS ssl, k % 4 * 3 AS sre_sl, CASE k % 4 WHEN 0 THEN '0' WHEN 1 THEN 'sre+2' ELSE '6' END AS sre_intra_sl, k % 6 * 2 + 2 AS decay, k % 3 AS re_entries, k % 4 AS trail_profit, k % 3 AS trail_sl,
k % 3 * 4 AS sell_sl, k % 2 * 3 AS sell_trail, k % 4 * 3 AS sell_sl_trail, k % 5 = 0 AS sell_track_original, k % 3 <> 0 AS buy_flag, k % 4 * 2 AS buy_sl, k % 3 * 2 AS buy_trail, k % 5 * 2 AS buy_sl_trail, k % 2 = 0 AS buy_track_original, k % 4 <> 0 AS sell2_flag, 40 + k % 5 * 10 AS movement1, 80 + k % 7 * 10 AS movement2, k % 9 AS short_period, k % 11 AS long_period, CASE WHEN k % 2 = 0 THEN 'normal' ELSE 'Exponential' END AS short_type, CASE WHEN k % 5 = 0 THEN 'normal' ELSE 'Exponential' END AS long_type
FROM (SELECT p_partkey AS k FROM part)"""

_TIMES = ["entry_time", "exit_time"]
_RUNGS = [*_TIMES, "last_trade_time", "trade_interval"]
_SBS = ["method", "sell_sl", "sell_trail", "sell_sl_trail", "sell_track_original", "buy_flag", "buy_sl", "buy_trail", "buy_sl_trail", "buy_track_original", "sell2_flag"]
#: The columns of each code's parameters.
CODES = {
    "B120_SI": [*_TIMES, "orderside", "method", "sl", "ut_sl", "std_indicator"],
    "B120G_PSL": [*_RUNGS, "entry_time2", "exit_time2", "last_trade_time2", "trade_interval2", "orderside", "method", "sl", "sl2", "ut_sl", "ut_sl2"],
    "DT_TRAIL": [*_TIMES, "orderside", "method", "sl", "trail_profit", "trail_sl"],
    "DT_FS_SRE": [*_TIMES, "orderside", "method", "dt_sl", "sre_sl", "sre_intra_sl"],
    "DT_FS_UT": [*_TIMES, "orderside", "method", "fsl", "ssl"],
    "NRE": [*_TIMES, "orderside", "method", "sl", "re_sl"],
    "NRE_CC_RE_TillTime_PSL": [*_RUNGS, "till_time", "orderside", "method", "sl", "re_sl"],
    "RED_PSL": [*_RUNGS, "orderside", "method", "sl", "decay", "re_entries"],
    "SBS": [*_TIMES, *_SBS],
    "SBS_PSL": [*_RUNGS, *_SBS],
    "SRE": [*_TIMES, "orderside", "sl", "intra_sl"],
    "SRE_SI_PSL": [*_RUNGS, "orderside", "sl", "intra_sl", "std_indicator"],
    "SUT_TT": [*_TIMES, "orderside", "ut_orderside", "ut_method", "tt_orderside", "tt_method", "sl", "intra_sl", "ut_sl"],
    "SUT_SRE": [*_TIMES, "orderside", "ut_orderside", "ut_method", "sl", "intra_sl", "ut_sl", "sre_sl", "sre_intra_sl"],
    "SRE_PS_W_Straddle": [*_TIMES, "orderside", "method", "movement1", "movement2"],
    "IRONFLY": [*_TIMES, "sl"],
    "MAC": [*_TIMES, "orderside", "short_period", "long_period", "short_type", "long_type"],
}


def _cells(columns: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({c} AS STRING)" for c in columns) + ")"


def _rules_sql() -> str:
    """Each code's rules written out as steps: REPLACE for values, WHERE for what stays."""
    big = lambda *c: ", ".join(f"upper({x}) AS {x}" for x in c)
    hl = lambda where: f"CASE WHEN {where} THEN 'HL' ELSE upper(method) END AS method"
    zero = lambda where, *c, v="0": ", ".join(f"CASE WHEN {where} THEN {v} ELSE {x} END AS {x}" for x in c)
    plus = lambda x, base: f"CASE WHEN {x} LIKE '%+%' THEN {base} + split_part({x}, '+', 2)::DOUBLE ELSE {x}::DOUBLE END AS {x}"
    psl = "entry_time <= last_trade_time AND last_trade_time < exit_time - 5"
    n = lambda i: f"(last_trade_time{i} - entry_time{i}) // regexp_extract(trade_interval{i}, '[0-9]+')::INT"
    side, gap = big("orderside"), "trade_interval"
    sbs_off = zero("sell_sl = 0", "sell_trail", "sell_sl_trail", "buy_sl", "buy_trail", "buy_sl_trail") + ", " + zero("sell_sl = 0", "buy_flag", "buy_track_original", "sell2_flag", v="false") + ", " + zero("sell_sl = 0", "sell_track_original", v="true") + ", " + hl("sell_sl = 0")
    sut = [(big("orderside", "ut_orderside", "ut_method") + ", " + plus("intra_sl", "sl"), "true"), (zero("sl = 0 AND intra_sl = 0", "ut_sl", v="'0'"), "NOT (intra_sl <> 0 AND intra_sl < sl)")]
    steps = {
        "B120_SI": [(hl("sl = 0") + ", " + side + ", CASE WHEN sl = 0 THEN '0' ELSE upper(ut_sl) END AS ut_sl, " + big("std_indicator"), "true")],
        "B120G_PSL": [(hl("sl = 0 OR sl2 = 0") + ", " + side + ", CASE WHEN sl = 0 THEN '0' ELSE upper(ut_sl) END AS ut_sl, CASE WHEN sl2 = 0 THEN '0' ELSE upper(ut_sl2) END AS ut_sl2, " + big(gap, f"{gap}2"), f"{psl} AND {psl.replace('_time', '_time2')} AND exit_time <= entry_time2 AND entry_time2 < exit_time2 - 5 AND {n('')} = {n('2')}")],
        "DT_TRAIL": [(hl("sl = 0") + ", " + side + ", " + zero("sl = 0", "trail_profit", "trail_sl"), "trail_profit >= trail_sl"), (zero("trail_sl = 0", "trail_profit"), "true"), (zero("trail_profit = 0", "trail_sl", v="sl"), "true")],
        "DT_FS_SRE": [(hl("dt_sl = 0") + ", " + side + ", " + plus("sre_intra_sl", "sre_sl"), "true"), ("entry_time AS entry_time", "NOT (sre_intra_sl <> 0 AND sre_intra_sl <= sre_sl)")],
        "DT_FS_UT": [(hl("fsl = 0 AND ssl = 0") + ", " + side, "true")],
        "NRE": [(hl("sl = 0") + ", " + side + ", " + zero("sl = 0", "re_sl", v="'0'"), "true"), (plus("re_sl", "sl"), "true")],
        "NRE_CC_RE_TillTime_PSL": [(hl("sl = 0") + ", " + side + ", " + big(gap) + ", " + plus("re_sl", "sl"), f"{psl} AND entry_time <= till_time")],
        "RED_PSL": [(hl("sl = 0") + ", " + side + ", " + big(gap), psl), ("CASE WHEN re_entries = 0 THEN min(decay) OVER () ELSE decay END AS decay", "true")],
        "SBS": [(sbs_off, "true"), (zero("sell_trail = 0", "sell_sl_trail", v="sell_sl"), "sell_trail = sell_sl_trail"), (zero("buy_trail = 0", "buy_sl_trail", v="buy_sl"), "buy_trail = buy_sl_trail"),
                (zero("NOT buy_flag", "buy_sl", "buy_sl_trail", "buy_trail") + ", " + zero("NOT buy_flag", "buy_track_original", "sell2_flag", v="false"), "true"), (zero("buy_sl = 0", "buy_trail", "buy_sl_trail") + ", " + zero("buy_sl = 0", "buy_track_original", v="true") + ", " + zero("buy_sl = 0", "sell2_flag", v="false"), "true")],
        "SBS_PSL": [(hl("sell_sl = 0") + ", " + big(gap) + ", " + zero("sell_sl = 0 AND sell_trail = 0", "buy_sl", "buy_trail", "buy_sl_trail") + ", " + zero("sell_sl = 0 OR sell_trail = 0", "sell_sl_trail"), psl), (zero("buy_sl = 0 OR buy_trail = 0", "buy_sl_trail"), "true"),
                    (zero("NOT buy_flag", "buy_sl", "buy_sl_trail", "buy_trail") + ", " + zero("NOT buy_flag", "sell2_flag", v="false"), "true")],
        "SRE": [(side + ", " + plus("intra_sl", "sl"), "true"), ("sl AS sl", "NOT (intra_sl <> 0 AND intra_sl <= sl)")],
        "SRE_SI_PSL": [(side + ", " + big(gap, "std_indicator") + ", " + plus("intra_sl", "sl"), psl), ("sl AS sl", "NOT (intra_sl <> 0 AND intra_sl < sl)")],
        "SUT_TT": [*sut, (big("tt_orderside") + ", ut_method AS tt_method", "true")],
        "SUT_SRE": [(plus("sre_intra_sl", "sre_sl"), "true"), ("sl AS sl", "NOT (sre_intra_sl <> 0 AND sre_intra_sl < sre_sl)"), *sut, (zero("ut_sl = '0'", "sre_sl", "sre_intra_sl"), "true")],
        "SRE_PS_W_Straddle": [(side + ", " + big("method"), "movement1 >= 50 AND movement2 >= 100")],
        "IRONFLY": [("sl AS sl", "sl <> 0")],
        "MAC": [(side + ", " + big("short_type", "long_type"), "short_period < long_period")],
    }
    text, out = [f"WITH pp AS ({_SETS})"], []
    for code, columns in CODES.items():
        last = "pp"
        for i, (new, where) in enumerate(steps[code]):
            text.append(f"{code}_{i} AS (SELECT * REPLACE ({new}) FROM {last} WHERE {where}{' AND entry_time < exit_time - 5' if i == 0 else ''})")
            last = f"{code}_{i}"
        out.append(f"SELECT DISTINCT '{code}' AS code, {_cells(columns)} AS cells FROM {last}")
    return ",\n".join(text) + "\n" + " UNION ALL ".join(out)


@query(_rules_sql(), market=False)
def grid_rules(spark, sf_dir):
    """The sets that each code keeps, of one table of parameters."""
    part = tape.table(spark, sf_dir, "part")
    sets = spark.sql(_SETS.replace("FROM part", "FROM {part}"), part=part)
    one = lambda code, columns: rules.ruled(sets.select(*columns), code).selectExpr(f"'{code}' AS code", f"{_cells(columns)} AS cells")
    return reduce(DataFrame.unionByName, (one(code, columns) for code, columns in CODES.items()))


# --- a sweep, from a parameter file to the cube -------------------------------------------------------------------------

#: A parameter file: each column a list of its own, blanks below the shorter ones.
_FILE = "SELECT CASE WHEN k <= 3 THEN CAST(545 + k * 20 AS STRING) END AS entry_time, CASE WHEN k <= 2 THEN CAST(480 + k * 210 AS STRING) END AS exit_time, CASE k WHEN 1 THEN 'sell' WHEN 2 THEN 'Buy' END AS orderside, CASE k WHEN 1 THEN 'hl' WHEN 2 THEN 'cc' END AS method, CASE WHEN k <= 3 THEN CAST(k * 4 - 4 AS STRING) END AS sl, CASE k WHEN 1 THEN 'ttc' WHEN 2 THEN '10' END AS ut_sl FROM (SELECT DISTINCT p_size AS k FROM part WHERE p_size <= 5)"
_COLUMNS = ["entry_time", "exit_time", "orderside", "method", "sl", "ut_sl"]
_SWEEP_SETS = f"pf AS ({_FILE}), gd AS (SELECT * FROM " + ", ".join(f"(SELECT DISTINCT {c} FROM pf WHERE {c} <> '')" for c in _COLUMNS) + """),
gs AS (SELECT DISTINCT entry_time::INT AS start, exit_time::INT AS "end", upper(orderside) AS side, CASE WHEN sl::DOUBLE = 0 THEN 'HL' ELSE upper(method) END AS method, sl::DOUBLE AS sl, CASE WHEN sl::DOUBLE = 0 THEN '0' ELSE upper(ut_sl) END AS ut_sl, '0' AS om FROM gd WHERE entry_time::INT < exit_time::INT - 5)"""


@query(f""", {sql.menu()},\n{_SWEEP_SETS},
ds AS (SELECT DISTINCT idx, trade_date FROM ft), en AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM ds, gs WHERE NOT (day(trade_date) % 4 = 0)),
{sql.pick('p', 'en')},\n{sql.b120('x', 'p')}
SELECT idx AS index, start, "end", side, method, sl, ut_sl, year(trade_date)::INT AS "Year", month(trade_date)::INT AS "Month", dte AS "DTE", 'Total.PNL' AS "PL Basis", round(sum(total_pnl), 2) AS "Points" FROM x JOIN cal USING (trade_date) GROUP BY ALL""")
def sweep(spark, sf_dir):
    """A parameter file's lists, the grid, its rules, the sessions that are not done yet, the strategy, its log on disk, the cube of the log."""
    m = Market(spark, sf_dir)
    at, log_at = r._new_folder(spark, "sweep-params"), r._new_folder(spark, "sweep-log")
    spark.sql(_FILE.replace("FROM part", "FROM {part}"), part=tape.table(spark, sf_dir, "part")).write.option("header", True).csv(at)
    lists = files.read_params(spark, at)
    kinds = {"entry_time": "int", "exit_time": "int", "sl": "double"}
    sets = rules.ruled(grid.grid(*(lists[c].select(F.col(c).cast(kinds.get(c, "string")).alias(c)) for c in _COLUMNS)), "B120")
    desk = m.desk()
    planned = m.days
    done = planned.where(F.dayofmonth("trade_date") % 4 == 0)  # as if their logs were there
    todo = files.pending_work(planned, done, 1)
    entries = m.entries_of(sets.select(F.col("entry_time").alias("start"), F.col("exit_time").alias("end"), F.col("orderside").alias("side"), "method", "sl", "ut_sl", F.lit("0").alias("om")), todo)
    trades = st.b120(entries, desk)
    named = {"start": "P_start", "end": "P_end", "side": "P_side", "method": "P_method", "sl": "P_sl", "ut_sl": "P_ut_sl", "entry_t": "EntryTime", "total_pnl": "Total.PNL"}
    files.write_log(trades.select("idx", "trade_date", *(F.col(a).alias(b) for a, b in named.items())), log_at)
    log = spark.read.parquet(log_at).withColumns({"P_index": F.col("idx").cast("string"), "trade_date": F.col("trade_date").cast("date")})
    log = log.join(m.calendar.select("trade_date", F.col("dte").alias("DTE")), "trade_date").drop("idx", "EntryTime")
    return rollup.cube_unpivot(rollup.cube_sum(log, "trade_date")).withColumn("Points", F.round("Points", 2))
