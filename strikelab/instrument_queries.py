"""Strategies with each index's own slippage, ticks and premium step; strikes whose unit is that of the search's first minute."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelab import strategy_queries as q
from strikelab import strategy_sql as sql
from strikelab.catalog import FIRST, GAP, LAST, Market, query
from strikelab.functions import triggers
from strikelab.functions.scalars import instrument
from strikelab.plans import strategies as st
from strikelab.plans.steps import enter


def _run(strategy, spark, sf_dir, rows, schema, oms=q.OM, **how):
    m = Market(spark, sf_dir)
    return strategy(m.entries(rows, schema), m.desk(*oms, instruments=True), **how)


@query(sql.instruments(lambda: sql.single(*q.S_B120, sql.b120("x", "p"), f"p_t AS entry_t, {sql.LEGS}, {sql.UT}, total_pnl")))
def ix_b120(spark, sf_dir):
    return _run(st.b120, spark, sf_dir, *q.S_B120)


@query(sql.instruments(lambda: sql.single(*q.S_DT, q._waited_legs(), f"p_t AS entry_t, p_f AS future, {q._DT_OUT}, round_even(ces_pnl + pes_pnl, 2) + 0 AS total_pnl")))
def ix_dt(spark, sf_dir):
    return _run(st.dt, spark, sf_dir, *q.S_DT)


@query(sql.instruments(lambda: sql.chained(*q.S_SRE, q._sre_round, 7, q.STRADDLE)))
def ix_sre(spark, sf_dir):
    return _run(st.sre, spark, sf_dir, *q.S_SRE)


@query(sql.instruments(lambda: q._leg_chain(*q.S_NRE, q._plain_leg, q._nre_again, 7)))
def ix_nre(spark, sf_dir):
    return _run(st.nre, spark, sf_dir, *q.S_NRE)


TRAILS = {"RATIO": {"gap": 0.5}, "POINT": {}, "PCT": {}, "STEP": {"step": 3.0, "sl_step": 2.0}}


@query()
def ix_trail(spark, sf_dir):
    """Every scrip's trailed stop in the four modes, sold and bought, on whole ticks where the index has them."""
    legs = Market(spark, sf_dir).legs.select("*", F.explode(F.array(F.lit("SELL"), F.lit("BUY"))).alias("side"))
    one = lambda mode, how: triggers.trail(F.col("bars"), F.lit(565), F.lit(900), mode=mode, side=F.col("side"), sl=8.0, rate=instrument("rate"), tick=instrument("tick"), **how)
    return q._labelled({mode: legs.select("idx", "trade_date", "scrip", "side", one(mode, how).alias("r")).select("idx", "trade_date", "scrip", "side", "r.*").where("o IS NOT NULL") for mode, how in TRAILS.items()})


# --- strangles by the premium unit --------------------------------------------------------------------------------------

STRANGLES = ("3", "2.5", "4-I", "150%")
S_STRANGLE = [(t, 900, om) for t in (540, 565, 610, 745) for om in STRANGLES], "start int, end int, om string"
_VALUES = {"3": (3.0, False), "2.5": (2.5, False), "4-I": (4.0, True), "150%": (1.5, False)}


def _strangle_sql() -> str:
    values = ", ".join(f"('{k}', {v}::DOUBLE, {str(i).lower()})" for k, (v, i) in _VALUES.items())
    return f""", {sql.menu()},\n{sql.entries(*S_STRANGLE)},
f0 AS (SELECT en.rid, arg_min(f.close, f.t) AS f0 FROM en JOIN fut f ON f.idx = en.idx AND f.trade_date = en.trade_date AND f.t >= en.start AND f.t BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
tg AS (SELECT en.*, v.units * CASE idx WHEN 'IDX1' THEN floor(f0 / 100) * 100 ELSE round_even(f0, 0) END / 100 AS goal, v.flips FROM en LEFT JOIN f0 USING (rid) JOIN (VALUES {values}) v(om, units, flips) USING (om)),
{q._at_target("w", "tg", "goal", "start")},
wf AS (SELECT *, flips AND coalesce(n_ce[:-3]::DOUBLE < n_pe[:-3]::DOUBLE, false) AS flip FROM w),
{sql.pick("y", "wf", p="p", om="'0'", start="CASE WHEN flip THEN n_t END", inner=False)}
SELECT idx, trade_date, start, "end", om, CASE WHEN flip THEN p_t ELSE n_t END AS t, CASE WHEN flip THEN p_ce ELSE n_ce END AS ce, CASE WHEN flip THEN p_pe ELSE n_pe END AS pe, CASE WHEN flip THEN p_cep ELSE n_cep END AS ce_price, CASE WHEN flip THEN p_pep ELSE n_pep END AS pe_price FROM y"""


@query(_strangle_sql())
def strangle_asof(spark, sf_dir):
    """The first valid strangle from each start on, by the premium unit of the first minute."""
    m = Market(spark, sf_dir)
    rows = enter(m.entries(*S_STRANGLE), m.desk(*STRANGLES, instruments=True))
    return rows.select("idx", "trade_date", "start", "end", "om", *(F.col(f"pick.{c}").alias(c) for c in ("t", "ce", "pe", "ce_price", "pe_price")))
