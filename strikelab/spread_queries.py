"""Spreads on spot, the intraday range stop with its intra band, and rollups of weeks and by DTE."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelab import registry as r
from strikelab import strategy_queries as q
from strikelab import strategy_sql as sql
from strikelab.catalog import FIRST, GAP, LAST, Market, query
from strikelab.operators import rollup
from strikelab.plans import shift, spreads, weekly
from strikelab.plans.lineage import cut
from strikelab.plans.steps import enter, session_bars

S_BUTTERFLY = [(t, 900, w, "ATMS") for t in (550, 565, 650) for w in (30.0, 150.0)], "start int, end int, width double, om string"


def _butterfly_sql() -> str:
    lag = lambda x: f"lag({x}) OVER (PARTITION BY idx ORDER BY trade_date) AS {x}"
    leg = lambda n: f"CASE kind WHEN 'PE' THEN (body - {n} * wing)::INT ELSE (body + {n} * wing)::INT END || kind"
    legs = []
    for i, (name, n, side) in enumerate((("near", -1, "BUY"), ("body", 0, "SELL"), ("far", 1, "BUY"))):
        legs.append(sql.stop(f"y{i + 1}", f"y{i}", f"l{i}", leg(n), "t0", end="exit_t", side=f"'{side}'", sl="0", cc="false"))
    return f""", {sql.ATM},
menu AS MATERIALIZED (SELECT fu.idx, fu.trade_date, 'ATMS' AS om, fu.t, future, k::INT || 'CE' AS ce, k::INT || 'PE' AS pe, ce AS ce_price, pe AS pe_price FROM fu JOIN ses ON fu.idx = ses.idx AND fu.trade_date = ses.trade_date AND fu.t = ses.t AND strike = k WHERE ce IS NOT NULL AND pe IS NOT NULL),
{sql.entries(*S_BUTTERFLY)},\n{sql.pick('p', 'en')},
sp AS (SELECT * FROM spt WHERE t BETWEEN {FIRST} AND {LAST}),
dy AS (SELECT idx, trade_date, {lag('h')}, {lag('l')}, {lag('c')} FROM (SELECT idx, trade_date, max(high) AS h, min(low) AS l, arg_max(close, t) AS c FROM sp GROUP BY ALL)),
pv AS (SELECT *, (h + l + c) / 3 AS pp FROM dy WHERE c IS NOT NULL),
p1 AS (SELECT *, 2 * pp - l AS r1, pp + (h - l) AS r2, h + 2 * (pp - l) AS r3, 2 * pp - h AS s1, pp - (h - l) AS s2, l - 2 * (h - pp) AS s3 FROM pv),
p2 AS (SELECT *, r3 + r2 - r1 AS r4, s3 + s2 - s1 AS s4 FROM p1), p3 AS (SELECT *, r4 + r3 - r2 AS r5, s4 + s3 - s2 AS s5 FROM p2),
lv AS (SELECT idx, trade_date, round_even(pp, 2) AS p_, [{', '.join(f'round_even({x}, 2)' for x in ('s5', 's4', 's3', 's2', 's1', 'pp', 'r1', 'r2', 'r3', 'r4', 'r5'))}] AS pls FROM p3),
x0 AS (SELECT p.*, p_t AS t0, p_ce[:-3]::DOUBLE AS k, greatest(round_even((p_cep + p_pep) * width / 100 / {GAP}, 0) * {GAP}, {GAP}) AS wing, s.close AS now, p_, pls FROM p JOIN sp s ON s.idx = p.idx AND s.trade_date = p.trade_date AND s.t = p_t JOIN lv ON lv.idx = p.idx AND lv.trade_date = p.trade_date),
x1 AS (SELECT *, CASE WHEN now < p_ THEN 'PE' WHEN now > p_ THEN 'CE' END AS kind, CASE WHEN now < p_ THEN k + CASE WHEN wing = {GAP} THEN 0 ELSE {GAP} END - wing ELSE k + wing END AS body,
 CASE WHEN now < p_ THEN list_filter(pls, lambda x: x > now)[2] ELSE list_filter(pls, lambda x: x < now)[-2] END AS behind FROM x0 WHERE now <= pls[11] AND now >= pls[1]),
x2 AS (SELECT * FROM x1 WHERE kind IS NOT NULL AND behind IS NOT NULL),
x3 AS (SELECT x2.rid, min(s.t) AS hit_t FROM x2 JOIN sp s ON s.idx = x2.idx AND s.trade_date = x2.trade_date AND s.t > t0 AND s.t < "end" AND CASE kind WHEN 'PE' THEN s.close < body OR s.close > behind ELSE s.close > body OR s.close < behind END GROUP BY ALL),
y0 AS (SELECT x2.*, coalesce(hit_t, "end") AS exit_t FROM x2 LEFT JOIN x3 USING (rid)),
{', '.join(legs)}
SELECT {sql.keys(S_BUTTERFLY[1])}, t0 AS entry_t, now AS spot, kind, wing, {leg(-1)} AS near, {leg(0)} AS body, {leg(1)} AS far, body AS target, behind AS stop, exit_t, l0_pnl AS near_pnl, l1_pnl AS body_pnl, l2_pnl AS far_pnl, round_even(l0_pnl + 2 * l1_pnl + l2_pnl, 2) + 0 AS total_pnl FROM y3"""


@query(_butterfly_sql())
def st_butterfly(spark, sf_dir):
    m = Market(spark, sf_dir)
    spot = m.spot.where(F.col("t").between(FIRST, LAST))
    bars = cut(session_bars(spot).withColumnRenamed("fut", "spot"), "session-spot")
    return spreads.butterfly(m.entries(*S_BUTTERFLY), m.desk("ATMS"), bars, cut(spreads.day_levels(spot), "levels"))


S_RANGE_DAY = q.sets([(t, 900, s, sl, i, "FIXED", y) for t in (565, 650) for s, sl, i, y in (("SELL", 12.0, 0.0, False), ("SELL", 20.0, 15.0, True), ("BUY", 15.0, 18.0, False))], "start int, end int, side string, sl double, intra_sl double, fixed_or_dynamic string, synthetic_future boolean")
_OUT = lambda pct, up, down: f"(({pct}) > 0 AND ({up} >= k + band * ({pct}) / 100 OR {down} <= k - band * ({pct}) / 100))"


@query(f""", {sql.menu()},\n{sql.entries(*S_RANGE_DAY)},\n{sql.pick('p', 'en')},
b0 AS (SELECT p.*, c.t AS bt, greatest(c.high + e.low, c.low + e.high, c.close + e.close) AS bh, least(c.high + e.low, c.low + e.high, c.close + e.close) AS bl, c.close + e.close AS bc, p_ce[:-3]::DOUBLE AS k, p_cep + p_pep AS band,
 CASE WHEN synthetic_future THEN p_ce[:-3]::DOUBLE + c.high - e.low ELSE f.high END AS fh, CASE WHEN synthetic_future THEN p_ce[:-3]::DOUBLE + c.low - e.high ELSE f.low END AS fl, CASE WHEN synthetic_future THEN p_ce[:-3]::DOUBLE + c.close - e.close ELSE f.close END AS fc, f.t IS NOT NULL AS there
 FROM p JOIN opt c ON c.idx = p.idx AND c.trade_date = p.trade_date AND c.scrip = p_ce AND c.t BETWEEN p_t AND "end" AND c.t BETWEEN {FIRST} AND {LAST} JOIN opt e ON e.idx = p.idx AND e.trade_date = p.trade_date AND e.scrip = p_pe AND e.t = c.t LEFT JOIN fut f ON f.idx = p.idx AND f.trade_date = p.trade_date AND f.t = c.t),
b1 AS (SELECT *, row_number() OVER w AS bi, first_value(bc) OVER w AS o, last_value(bc) OVER (PARTITION BY rid ORDER BY bt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, max(bt) OVER (PARTITION BY rid) AS zt FROM b0 WINDOW w AS (PARTITION BY rid ORDER BY bt)),
b2 AS (SELECT *, there AND bt <> {FIRST} AND {_OUT('intra_sl', 'fh', 'fl')} AS inner_, there AND {_OUT('sl', 'fc', 'fc')} AS hit FROM b1 WHERE bi > 1),
b3 AS (SELECT rid, any_value(o) AS o, any_value(z) AS z, min(bt) FILTER (bt < zt AND (inner_ OR hit)) AS xt, arg_min(inner_, bt) FILTER (bt < zt AND (inner_ OR hit)) AS xi, arg_min(CASE WHEN inner_ THEN CASE side WHEN 'SELL' THEN bh ELSE bl END ELSE bc END, bt) FILTER (bt < zt AND (inner_ OR hit)) AS xp FROM b2 GROUP BY rid)
SELECT {sql.keys(S_RANGE_DAY[1])}, p_t AS entry_t, p_ce AS ce, p_pe AS pe, o, coalesce(xi, false) AS intra_hit, xt AS exit_t, coalesce(round_even(CASE side WHEN 'SELL' THEN 1.0 ELSE -1.0 END::DOUBLE * (o - coalesce(xp, z)) - o * 0.01, 2) + 0, 0) AS pnl FROM p LEFT JOIN b3 USING (rid)""")
def range_sl_intra(spark, sf_dir):
    """A straddle's trade that ends when the future, or the synthetic one, leaves a band: its close, or its extremes a wider one."""
    m = Market(spark, sf_dir)
    desk = m.desk()
    rows = enter(m.entries(*S_RANGE_DAY), desk, kept=True).where("pick IS NOT NULL").withColumn("std", F.col("pick"))
    rows = weekly.ask_range(rows, desk, "r", ce=F.col("pick.ce"), pe=F.col("pick.pe"), start=F.col("pick.t"))
    keys = [c.split()[0] for c in S_RANGE_DAY[1].split(", ")]
    return rows.select("idx", "trade_date", *keys, F.col("pick.t").alias("entry_t"), F.col("pick.ce").alias("ce"), F.col("pick.pe").alias("pe"), F.col("r.o").alias("o"), F.coalesce(F.col("r.intra_hit"), F.lit(False)).alias("intra_hit"), F.col("r.t").alias("exit_t"), F.coalesce(F.col("r.pnl"), F.lit(0.0)).alias("pnl"))


_WEEK_LOG = r._LOG.replace("day(l_shipdate) % 5 + 1 AS DTE,", "day(l_shipdate) % 3 + 3 AS FromDTE, day(l_shipdate) % 2 + 1 AS ToDTE,")


@query(f"""{_WEEK_LOG} SELECT P_index, P_flag, P_status, P_line, year(Date) AS Year, month(Date) AS Month, FromDTE || '_' || ToDTE AS DTE, sum(A_PNL) AS A_PNL, sum(B_PNL) AS B_PNL FROM log GROUP BY ALL""", market=False)
def cube_sum_weekly(spark, sf_dir):
    """A log of weeks, whose DTE is the days that a week runs from and to."""
    day = F.dayofmonth("Date")
    log = r._log(spark, sf_dir).drop("DTE").withColumns({"FromDTE": day % 3 + 3, "ToDTE": day % 2 + 1})
    return rollup.cube_sum(rollup.week_labelled(log, "FromDTE", "ToDTE"))


_BY_DTE = "per AS (SELECT flag, line, Year, Month, DTE, sum(Points) AS points FROM long GROUP BY ALL)"


@query(f"{r._CUBE}, {_BY_DTE} SELECT * FROM per", market=False)
def period_pnl_mcx(spark, sf_dir):
    return rollup.period_pnl(r._long(spark, sf_dir), ["flag", "line"], by_dte=True)


_RUN = "OVER (PARTITION BY flag, line ORDER BY Year, Month, DTE DESC)"


@query(f"{r._CUBE}, {_BY_DTE}, run AS (SELECT *, sum(points) {_RUN} AS s FROM per) SELECT flag, line, min(s - p) AS drawdown FROM (SELECT *, greatest(max(s) {_RUN}, 0) AS p FROM run) GROUP BY ALL", market=False)
def max_drawdown_mcx(spark, sf_dir):
    """A month's days before expiry count down."""
    periods = rollup.period_pnl(r._long(spark, sf_dir), ["flag", "line"], by_dte=True)
    return rollup.max_drawdown(periods, ["flag", "line"], rollup.order_of(by_dte=True))


S_PS_WEEK = [(t, q.WEEK_END, "SELL", k, d, m1, m2, om) for t in (565, 650) for k, d, m1, m2 in (("HL", 5.0, 60.0, 65.0), ("CC", 10.0, 65.0, 75.0)) for om in ("0", "ATM+1")], "start int, end int, side string, method string, divider double, movement1 double, movement2 double, om string"


@query()
def st_ps_w_straddle(spark, sf_dir):
    """A week's shift until the strikes meet, then straddles."""
    return shift.shift_to_straddles(*q._weekly(spark, sf_dir, *S_PS_WEEK, "0", "ATM+1"))
