"""Portfolio stops, indicator gates and weeks for the families of strategies, by their trade legs; and their SQL."""

from __future__ import annotations

from strikelab import strategy_queries as q
from strikelab import strategy_sql as sql
from strikelab.catalog import FIRST, LAST, Market, query
from strikelab.plans import strategies as st
from strikelab.plans import trades

STEP = 10


def _ladder(rows: list[tuple], schema: str, rungs=((625, 30), (685, 60))) -> tuple[list[tuple], str]:
    """The same sets (their om last) on two ladders."""
    return [(*r, last, n) for r in rows for last, n in rungs], f"{schema}, last_trade_time int, trade_interval int"


_LAD = "lad AS MATERIALIZED (SELECT * EXCLUDE (rid, start, i), rid AS set_rid, start AS start0, rid * 1000 + i AS rid, start + i * trade_interval AS start FROM en, unnest(range(0, 100)) v(i) WHERE start + i * trade_interval <= last_trade_time)"


def _stop_sql(schema: str, legs: str, margin: float = 12.0, lag: int = 1, parts: tuple[str, ...] = ()) -> str:
    """The portfolio stop of the trade legs tl (rid, part, kind, scrip, other, a, z, x, o, pnl, side, rate, lastm) of the ladder's rungs."""
    shares = f"floor(floor(1000000000.0 / n) / (price * {margin} / 100))"
    names = [c.split()[0] for c in schema.split(", ")]
    k = "idx, trade_date, " + ", ".join('start0 AS "start"' if n == "start" else f'"{n}"' for n in names)
    return f"""{legs},
ll AS MATERIALIZED (SELECT tl.*, l.idx, l.trade_date, l.set_rid, row_number() OVER () AS lid FROM tl JOIN lad l USING (rid)),
pb AS (SELECT l.lid, l.o, l.pnl, l.rate, l.lastm, CASE WHEN l.side = 'SELL' THEN 1.0 ELSE -1.0 END::DOUBLE AS g, coalesce(l.x, l.z) AS x, b.t AS bt, CASE kind WHEN 'straddle' THEN b.close + c.close ELSE b.close END AS bc,
 row_number() OVER w AS bi, first_value(CASE kind WHEN 'straddle' THEN b.close + c.close ELSE b.close END) OVER w AS c1
 FROM ll l JOIN opt b ON b.idx = l.idx AND b.trade_date = l.trade_date AND b.scrip = l.scrip AND b.t BETWEEN l.a AND l.z AND b.t BETWEEN {FIRST} AND {LAST} LEFT JOIN opt c ON c.idx = l.idx AND c.trade_date = l.trade_date AND c.scrip = l.other AND c.t = b.t
 WHERE kind = 'leg' OR c.t IS NOT NULL WINDOW w AS (PARTITION BY l.lid ORDER BY b.t)),
pv AS (SELECT *, g * (coalesce(o, c1) - bc) - coalesce(o, c1) * rate AS v, max(bt) OVER (PARTITION BY lid) AS zt FROM pb WHERE bi > 1 AND bt <= x),
pp AS MATERIALIZED (SELECT lid, bt, CASE WHEN bt = zt THEN coalesce(pnl, round_even(v, 2)) ELSE v END AS v FROM pv WHERE lastm IS NULL OR bt <= lastm),
gr AS (SELECT unnest(range({FIRST}, {LAST + 1}, {STEP}))::INT AS t),
fi AS (SELECT s.set_rid, s.t, s.part, coalesce(p.v, 0) AS v FROM (SELECT lid, set_rid, part, gr.t FROM ll, gr) s ASOF LEFT JOIN pp p ON p.lid = s.lid AND p.bt <= s.t),
pr AS (SELECT idx, trade_date, arg_min(close, t) AS price FROM fut WHERE t BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
nn AS (SELECT set_rid, count(*) AS n FROM lad GROUP BY ALL),
ca AS MATERIALIZED (SELECT s.set_rid, s.t, round_even(round(s.v, 6) * {shares}, 2) + 0 AS cash{"".join(f", round_even(round(s.v_{p}, 6) * {shares}, 2) + 0 AS cash_{p}" for p in parts)}, row_number() OVER (PARTITION BY s.set_rid ORDER BY s.t) AS i
 FROM (SELECT set_rid, t, sum(v) AS v{"".join(f", coalesce(sum(v) FILTER (part = '{p}'), 0) AS v_{p}" for p in parts)} FROM fi GROUP BY ALL) s JOIN nn USING (set_rid) JOIN (SELECT DISTINCT set_rid, idx, trade_date FROM lad) USING (set_rid) JOIN pr USING (idx, trade_date)),
lv AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in q.LEVELS)}]) AS level),
cx AS (SELECT set_rid, level, min(i) AS i, max(zi) AS zi FROM (SELECT set_rid, level, CASE WHEN CASE WHEN level > 0 THEN cash > level * 10000000 ELSE cash < level * 10000000 END THEN i END AS i, max(i) OVER (PARTITION BY set_rid) AS zi FROM ca, lv) GROUP BY ALL),
cy AS (SELECT set_rid, level, CASE WHEN i + {lag} <= zi THEN i END AS i, CASE WHEN i + {lag} <= zi THEN i + {lag} ELSE zi END AS j FROM cx)
SELECT {k}, level, a.t, b.cash AS paid{"".join(f", b.cash_{p} AS paid_{p}" for p in parts)} FROM cy JOIN (SELECT DISTINCT ON (set_rid) * FROM lad) USING (set_rid) LEFT JOIN ca a ON a.set_rid = cy.set_rid AND a.i = cy.i JOIN ca b ON b.set_rid = cy.set_rid AND b.i = cy.j"""


def _psl(spark, sf_dir, trader, rows, schema, oms=q.OM, **how):
    m = Market(spark, sf_dir)
    desk = m.desk(*oms)
    return trades.portfolio_stop(m.entries(rows, schema), desk, trader, q.LEVELS, step=STEP, **how)


_TL = "SELECT rid, 'std' AS part, NULL::INT AS lastm, '{kind}' AS kind, {scrip} AS scrip, {other} AS other, {a} AS a, \"end\" AS z, {x} AS x, {o} AS o, {pnl} AS pnl, side, 0.01 AS rate FROM {src}"


def _tl(src: str, scrip: str, a: str, x: str, o: str, pnl: str, kind: str = "leg", other: str = "NULL::VARCHAR") -> str:
    return _TL.format(src=src, scrip=scrip, a=a, x=x, o=o, pnl=pnl, kind=kind, other=other)


def _open(rows, schema, oms: tuple[str, ...] = q.OM) -> str:
    return f", {sql.menu(*oms)},\n{sql.entries(rows, schema)},\n{_LAD}"


# --- portfolio stops ----------------------------------------------------------------------------------------------------

S_PSL_DT = _ladder([r for r in q.S_DT[0] if r[0] == 565], q.S_DT[1])
_PSL_DT = f"{_open(*S_PSL_DT)},\n{sql.pick('p', 'lad')},\n{q._waited_legs()},\ntl AS ({' UNION ALL '.join(_tl('x', f'p_{k}', f'{k}_dt', f'{k}s_t', f'{k}s_o', f'{k}s_pnl') for k in ('ce', 'pe'))})"


@query(_stop_sql(S_PSL_DT[1], _PSL_DT))
def mod_psl_dt(spark, sf_dir):
    return _psl(spark, sf_dir, trades.dt, *S_PSL_DT)


S_PSL_NRE = _ladder([(*r, n) for r in q.S_NRE[0] if r[0] == 565 for n in (0, 3)], f"{q.S_NRE[1]}, re_entries int")


def _log_legs(given: tuple[list[tuple], str], again, most: int, oms: tuple[str, ...] = q.OM) -> str:
    """The legs of each leg's rounds: a plain stop first, then again(out, source) after each exit."""
    k = ", ".join(f'"{c.split()[0]}"' for c in given[1].split(", "))
    two = "r0 AS (SELECT * EXCLUDE (rid), rid AS top, rid * 2 + i AS rid, CASE i WHEN 0 THEN 'ce' ELSE 'pe' END AS leg, CASE i WHEN 0 THEN p_ce ELSE p_pe END AS scrip, CASE i WHEN 0 THEN p_cep ELSE p_pep END AS cost, p_t AS go FROM p, (VALUES (0), (1)) v(i))"
    text, parts = [sql.pick("p", "lad"), two], []
    for n in range(most + 1):
        text.append((q._plain_leg if n == 0 else again)(f"s{n}", f"r{n}"))
        parts.append(_tl(f"(SELECT * REPLACE (top AS rid) FROM s{n} WHERE {n} <= re_entries)", "scrip", "entry_t", "exit_t", "o", "pnl"))
        text.append(f"r{n + 1} AS (SELECT rid, top, idx, trade_date, {k}, leg, scrip, cost, exit_t AS go FROM s{n} WHERE exit_t IS NOT NULL)")
    return f"{_open(*given, oms)},\n" + ",\n".join(text) + f",\ntl AS ({' UNION ALL '.join(parts)})"


@query(_stop_sql(S_PSL_NRE[1], _log_legs(S_PSL_NRE, q._nre_again, 3)))
def mod_psl_nre(spark, sf_dir):
    return _psl(spark, sf_dir, trades.nre(3), *S_PSL_NRE)


@query(_stop_sql(S_PSL_NRE[1], _log_legs(S_PSL_NRE, q._cc_again, 3)))
def mod_psl_nre_cc(spark, sf_dir):
    return _psl(spark, sf_dir, trades.logged(st.nre_cc, 3), *S_PSL_NRE)


S_PSL_RED = _ladder([(*r, n) for r in q.S_RED[0] if r[0] == 565 for n in (0, 3)], f"{q.S_RED[1]}, re_entries int")


@query(_stop_sql(S_PSL_RED[1], _log_legs(S_PSL_RED, q._new_strike, 3)))
def mod_psl_red(spark, sf_dir):
    return _psl(spark, sf_dir, trades.logged(st.red, 3), *S_PSL_RED)


S_PSL_SUT = _ladder([r for r in q.S_SUT[0] if r[0] == 565], q.S_SUT[1])
_SUT_TL = f"tl AS ({_TL.format(src='x', kind='straddle', scrip='p_ce', other='p_pe', a='p_t', x='r_t', o='r_o', pnl='r_pnl')} UNION ALL SELECT rid, 'ut', NULL::INT, 'leg', ut_scrip, NULL::VARCHAR, q_t, \"end\", ut_t, ut_o, ut_pnl, ut_side, 0.01 FROM x WHERE ut_scrip IS NOT NULL)"


@query(_stop_sql(S_PSL_SUT[1], f"{_open(*S_PSL_SUT, q.TWO)},\n{sql.pick('p', 'lad')},\n{q._SUT_CTES},\n{_SUT_TL}", parts=("std", "ut")))
def mod_psl_sut(spark, sf_dir):
    return _psl(spark, sf_dir, trades.sut, *S_PSL_SUT, q.TWO, parts=("std", "ut"))


S_PSL_SRE = _ladder([(*r, n) for r in q.S_SRE[0] if r[0] == 565 for n in (0, 7)], f"{q.S_SRE[1]}, re_entries int")


def _sre_legs() -> str:
    k = ", ".join(f'"{c.split()[0]}"' for c in S_PSL_SRE[1].split(", "))
    text, parts = ["r0 AS (SELECT *, start AS go FROM lad)"], []
    for n in range(8):
        text.append(q._sre_round(f"s{n}", f"r{n}"))
        parts.append(_tl(f"(SELECT * FROM s{n} WHERE {n} <= re_entries)", "p_ce", "p_t", "r_t", "r_o", "r_pnl", "straddle", "p_pe"))
        text.append(f'r{n + 1} AS (SELECT rid, idx, trade_date, {k}, exit_t AS go FROM s{n} WHERE exit_t < "end" - 5)')
    return f"{_open(*S_PSL_SRE)},\n" + ",\n".join(text) + f",\ntl AS ({' UNION ALL '.join(parts)})"


@query(_stop_sql(S_PSL_SRE[1], _sre_legs()))
def mod_psl_sre(spark, sf_dir):
    return _psl(spark, sf_dir, trades.sre(), *S_PSL_SRE)


S_PSL_SEP = _ladder([(*r, n) for r in q.S_SRE_SEP[0] if r[0] == 565 for n in (0, 2)], f"{q.S_SRE_SEP[1]}, re_entries int")


@query()
def mod_psl_sre_sep(spark, sf_dir):
    return _psl(spark, sf_dir, trades.sre_separate(2), *S_PSL_SEP)


S_PSL_RE = _ladder([(*r, n) for r in q.S_B120[0] if r[0] == 565 for n in (0, 2)], f"{q.S_B120[1]}, re_entries int")


def _b120_legs(given: tuple[list[tuple], str], most: int) -> str:
    """The legs and the followed one of each round; the followed leg counts for itself until its following's first bar."""
    k = ", ".join(f'"{c.split()[0]}"' for c in given[1].split(", "))
    text, parts = ["r0 AS (SELECT *, start AS go FROM lad)"], []
    more = "AND {n} < re_entries" if "re_entries" in given[1] else ""
    for n in range(most + 1):
        text.append(f"{sql.pick(f's{n}_p', f'r{n}', start='go')},\n{sql.b120(f's{n}', f's{n}_p')}")
        text.append(f"""g{n} AS (SELECT s.*, b.began FROM s{n} s LEFT JOIN (SELECT s.rid, list_sort(list(o.t))[2] AS began FROM s{n} s JOIN opt o ON o.idx = s.idx AND o.trade_date = s.trade_date AND o.scrip = ut_k AND o.t BETWEEN at_ AND "end" AND o.t BETWEEN {FIRST} AND {LAST} WHERE on_ GROUP BY s.rid) b USING (rid))""")
        for x, first in (("ce", "pe"), ("pe", "ce")):
            parts.append(f"SELECT rid, 'std' AS part, CASE WHEN on_ AND first = '{first}' THEN began - 1 END AS lastm, 'leg' AS kind, p_{x} AS scrip, NULL::VARCHAR AS other, p_t AS a, \"end\" AS z, {x}_t AS x, {x}_o AS o, {x}_pnl AS pnl, side, 0.01 AS rate FROM g{n}")
        parts.append(f"SELECT rid, 'ut', NULL::INT, 'leg', ut_k, NULL::VARCHAR, at_, \"end\", ut_t, ut_o, ut_pnl, side, 0.0 FROM g{n} WHERE on_")
        text.append(f'r{n + 1} AS (SELECT rid, idx, trade_date, {k}, exit_t AS go FROM s{n} WHERE exit_t < "end" - 5 {more.format(n=n)})')
    return f"{_open(*given)},\n" + ",\n".join(text) + f",\ntl AS ({' UNION ALL '.join(parts)})"


@query(_stop_sql(S_PSL_RE[1], _b120_legs(S_PSL_RE, 2), parts=("std", "ut")))
def mod_psl_b120_re(spark, sf_dir):
    return _psl(spark, sf_dir, trades.b120(2), *S_PSL_RE, parts=("std", "ut"))


@query(_stop_sql(q.S_PSL[1], _b120_legs(q.S_PSL, 0), parts=("std", "ut")))
def mod_psl(spark, sf_dir):
    """The separate-stop strategy on a ladder of entries, with the 37 levels of a portfolio stop."""
    return _psl(spark, sf_dir, trades.b120(), *q.S_PSL, parts=("std", "ut"))


@query()
def mod_psl_shift(spark, sf_dir):
    """One entry with the whole fund, in fractions of shares, 14 % margin, paid at the crossing's minute."""
    return _psl(spark, sf_dir, trades.premium_shift(), *q.S_SHIFT, q.SHIFT_OM, margin_percent=14.0, lag=0)


# --- indicator gates ----------------------------------------------------------------------------------------------------

_SI = [(i, b, 60) for i, b in (("low", 0.02), ("high", -0.05), ("avg", 0.0))]
_SI_SCHEMA = "std_indicator string, indicator_buffer double, buffer_minute int"


def _gate(rows: list[tuple], schema: str) -> tuple[list[tuple], str]:
    return [(*r, *i) for r in rows for i in _SI], f"{schema}, {_SI_SCHEMA}"


def _gated(strategy, spark, sf_dir, rows, schema):
    m = Market(spark, sf_dir)
    desk = m.desk()
    return strategy(st.gated(m.entries(rows, schema), desk), desk)


S_SI_DT, S_SI_NRE, S_SI_SRE = _gate(*q.S_DT), _gate(*q.S_NRE), _gate(*q.S_SRE)


def _si_sql(given: tuple[list[tuple], str]) -> str:
    return f", {sql.menu()},\n{sql.entries(*given)},\n{q._GATE}"


@query(f"{_si_sql(S_SI_DT)},\n{sql.pick('p', 'gate')},\n{q._waited_legs()}\nSELECT {sql.keys(S_SI_DT[1])}, from_t, p_t AS entry_t, p_f AS future, {q._DT_OUT}, round_even(ces_pnl + pes_pnl, 2) + 0 AS total_pnl FROM x")
def mod_si_dt(spark, sf_dir):
    """Wait for decay, entered only when the premium is low enough."""
    return _gated(st.dt, spark, sf_dir, *S_SI_DT)


def _si_nre_sql() -> str:
    k = sql.keys(S_SI_NRE[1])
    two = "r0 AS (SELECT * EXCLUDE (rid), rid * 2 + i AS rid, CASE i WHEN 0 THEN 'ce' ELSE 'pe' END AS leg, CASE i WHEN 0 THEN p_ce ELSE p_pe END AS scrip, CASE i WHEN 0 THEN p_cep ELSE p_pep END AS cost, p_t AS go FROM p, (VALUES (0), (1)) v(i))"
    text, parts = [sql.pick("p", "gate"), two], []
    for n in range(8):
        text.append((q._plain_leg if n == 0 else q._nre_again)(f"s{n}", f"r{n}"))
        parts.append(f"SELECT {n}::INT AS round, {k}, from_t, leg, scrip, entry_t, o, exit_t, pnl FROM s{n}")
        text.append(f"r{n + 1} AS (SELECT rid, {k}, from_t, leg, scrip, cost, exit_t AS go FROM s{n} WHERE exit_t IS NOT NULL)")
    return f"{_si_sql(S_SI_NRE)},\n" + ",\n".join(text) + "\n" + " UNION ALL ".join(parts)


@query(_si_nre_sql())
def mod_si_nre(spark, sf_dir):
    return _gated(st.nre, spark, sf_dir, *S_SI_NRE)


def _si_sre_sql() -> str:
    k = sql.keys(S_SI_SRE[1])
    text, parts = ["r0 AS (SELECT *, start AS go FROM gate)"], []
    for n in range(8):
        text.append(q._sre_round(f"s{n}", f"r{n}"))
        parts.append(f"SELECT {n}::INT AS round, {k}, from_t, {q.STRADDLE} FROM s{n}")
        text.append(f'r{n + 1} AS (SELECT rid, {k}, from_t, exit_t AS go FROM s{n} WHERE exit_t < "end" - 5)')
    return f"{_si_sql(S_SI_SRE)},\n" + ",\n".join(text) + "\n" + " UNION ALL ".join(parts)


@query(_si_sre_sql())
def mod_si_sre(spark, sf_dir):
    return _gated(st.sre, spark, sf_dir, *S_SI_SRE)


S_SI_PSL = _gate(*_ladder([r for r in q.S_DT[0] if r[0] == 565][:1], q.S_DT[1]))


@query()
def mod_si_psl(spark, sf_dir):
    """The portfolio stop of a ladder whose rungs wait for their gate."""
    return _psl(spark, sf_dir, trades.gated(trades.dt), *S_SI_PSL)


# --- weeks --------------------------------------------------------------------------------------------------------------

S_WEEK_NRE = q.sets([(t, q.WEEK_END, s, k, 20.0, 15.0) for t in (565, 650) for s, k in (("SELL", "HL"), ("SELL", "CC"), ("BUY", "HL"))], "start int, end int, side string, method string, sl double, re_sl double")
S_WEEK_SRE = q.sets([(t, q.WEEK_END, s, sl, i) for t in (565, 650) for s, sl, i in (("SELL", 12.0, 0.0), ("SELL", 15.0, 25.0), ("BUY", 10.0, 0.0))], q.SRE_SCHEMA)


@query()
def mod_weekly_nre(spark, sf_dir):
    entries, desk = q._weekly(spark, sf_dir, *S_WEEK_NRE)
    return st.nre(entries, desk, 10)


@query()
def mod_weekly_sre(spark, sf_dir):
    entries, desk = q._weekly(spark, sf_dir, *S_WEEK_SRE)
    return st.sre(entries, desk)


@query()
def mod_weekly_daywise(spark, sf_dir):
    """The daily profit of a week's straddles and of their fresh ones."""
    entries, desk = q._weekly(spark, sf_dir, *S_WEEK_SRE)
    return trades.daywise(trades.sre()(entries, desk), entries.columns, desk)
