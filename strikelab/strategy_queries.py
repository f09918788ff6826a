"""The registered queries of the strategies, and their SQL.

Each runs over all sessions of the tape with a short list of parameter sets.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelab import strategy_sql as sql
from strikelab.catalog import FIRST, LAST, LEVELS, Market, query  # noqa: F401  LEVELS: for the modifiers' queries
from strikelab.functions import triggers
from strikelab.operators import strikes
from strikelab.plans import shift, weekly
from strikelab.plans import strategies as st
from strikelab.plans.lineage import cut
from strikelab.plans.steps import menu

OM = ("0",)
TIMES = (565, 610, 650)
B120 = [(t, 900, s, k, sl, ut) for t in TIMES for s, k, sl, ut in (("SELL", "HL", 8.0, "10"), ("SELL", "CC", 5.0, "TTC"), ("BUY", "HL", 6.0, "8"))]
B120_SCHEMA = "start int, end int, side string, method string, sl double, ut_sl string"




def _run(strategy, spark, sf_dir, rows, schema, oms=OM, **how):
    """strategy with the sets over the whole tape."""
    m = Market(spark, sf_dir)
    desk = m.desk(*oms)
    return strategy(m.entries(rows, schema), desk, **how)


def sets(rows: list[tuple], schema: str, om: str = "0") -> tuple[list[tuple], str]:
    """The same with one strike spec."""
    return [(*r, om) for r in rows], f"{schema}, om string"


# --- separate stops -----------------------------------------------------------------------------------------------------

S_B120 = sets(B120, B120_SCHEMA)


@query(sql.single(*S_B120, sql.b120("x", "p"), f"p_t AS entry_t, {sql.LEGS}, {sql.UT}, total_pnl"))
def st_b120(spark, sf_dir):
    return _run(st.b120, spark, sf_dir, *S_B120)


ROUND = "p_t AS entry_t, p_ce AS ce, p_pe AS pe, exit_t, total_pnl"


def _b120_round(**how):
    return lambda out, src: sql.pick(f"{out}_p", src, start="go") + ",\n" + sql.b120(out, f"{out}_p", **how)


@query(sql.chained(*S_B120, _b120_round(), 5, ROUND))
def st_b120_re(spark, sf_dir):
    return _run(st.b120_rounds, spark, sf_dir, *S_B120)


S_UNIVERSAL = sets([(*r[:5], 2 * r[4], r[5], 12.0) for r in B120], "start int, end int, side string, method string, sl double, intra_sl double, ut_sl string, ut_intra_sl double")


@query(sql.chained(*S_UNIVERSAL, _b120_round(intra="intra_sl", ut_intra="ut_intra_sl"), 5, ROUND))
def st_b120_universal(spark, sf_dir):
    return _run(st.b120_rounds, spark, sf_dir, *S_UNIVERSAL)


S_TWICE = sets([(*r, 700, 900, 4.0, "TTC", "0") for r in B120], f"{B120_SCHEMA}, start2 int, end2 int, sl2 double, ut_sl2 string, om2 string")
_SECOND = 'e2 AS (SELECT rid, idx, trade_date, side, method, start2 AS start, end2 AS "end", sl2 AS sl, ut_sl2 AS ut_sl, om2 AS om FROM en)'


@query(sql.single(*S_TWICE, f"{sql.b120('a', 'p')},\n{_SECOND},\n{sql.pick('p2', 'e2')},\n{sql.b120('b', 'p2')},\nx AS (SELECT a.* EXCLUDE (total_pnl), a.total_pnl AS pnl1, coalesce(b.total_pnl, 0) AS pnl2, round_even(a.total_pnl + coalesce(b.total_pnl, 0), 2) + 0 AS total_pnl FROM a LEFT JOIN b USING (rid))", "pnl1, pnl2, total_pnl"))
def st_b120g(spark, sf_dir):
    return _run(st.b120_twice, spark, sf_dir, *S_TWICE)


S_TT = sets([(*r, "SELL", "CC", 5.0, "ATM+1") for r in B120], f"{B120_SCHEMA}, tt_side string, tt_method string, tt_sl double, tt_om string")


@query(sql.single(*S_TT, f"{sql.b120('a', 'p')},\n{sql.pick('b', 'a', 'q', 'tt_om', 'at_', inner=False)},\nc AS (SELECT *, CASE first WHEN 'ce' THEN q_ce WHEN 'pe' THEN q_pe END AS tk FROM b),\n{sql.stop('x', 'c', 'tt', 'tk', 'q_t', side='tt_side', sl='tt_sl', cc='tt_method = ' + chr(39) + 'CC' + chr(39))}", f"p_t AS entry_t, {sql.UT}, tk AS tt, tt_t, tt_pnl, round_even(total_pnl + tt_pnl, 2) + 0 AS total_pnl", ("0", "ATM+1")))
def st_b120_tt(spark, sf_dir):
    return _run(st.b120_tt, spark, sf_dir, *S_TT, ("0", "ATM+1"))


S_UT = sets([(t, 900, "SELL", k, 5.0, "10", 6.0) for t in TIMES for k in ("HL", "CC")], f"{B120_SCHEMA}, ut_target double")


@query()
def st_b120_re_ut(spark, sf_dir):
    return _run(st.b120_ut_rounds, spark, sf_dir, *S_UT)


S_LIMITED = sets([(*r[:5], "10", 2.0, 3.0) for r in B120], f"{B120_SCHEMA}, sl_trail double, tp_trail double")


@query()
def st_b120_ut_trail(spark, sf_dir):
    return _run(st.b120_trail_limited, spark, sf_dir, *S_LIMITED)


S_RATIO = sets([(*r, g, c) for r in B120 for g, c in ((0.5, False), (2.0, True))], f"{B120_SCHEMA}, ut_trail double, trail_upto_cost boolean")


@query()
def st_b120_ut_trail2(spark, sf_dir):
    return _run(st.b120_trail_ratio, spark, sf_dir, *S_RATIO)


S_NO_UT = sets([(t, 900, s, k, 8.0, g, c) for t in TIMES for s, k in (("SELL", "HL"), ("BUY", "CC")) for g, c in ((0.5, False), (2.0, True))], "start int, end int, side string, method string, sl double, trail double, trail_upto_cost boolean")


@query()
def st_b120_no_ut(spark, sf_dir):
    return _run(st.b120_no_ut, spark, sf_dir, *S_NO_UT)


# --- combined stops -----------------------------------------------------------------------------------------------------

SRE = [(t, 900, s, sl, i) for t in (565, 650) for s, sl, i in (("SELL", 4.0, 0.0), ("SELL", 6.0, 9.0), ("BUY", 5.0, 0.0))]
SRE_SCHEMA = "start int, end int, side string, sl double, intra_sl double"
S_SRE = sets(SRE, SRE_SCHEMA)
STRADDLE = "p_t AS entry_t, p_ce AS ce, p_pe AS pe, r_o AS o, exit_t, pnl"


def _sre_round(out, src, om="om", **how):
    return f"{sql.pick(f'{out}_p', src, start='go', om=om)},\n{sql.combined(f'{out}_r', f'{out}_p', 'r', 'p_ce', 'p_pe', 'p_t', **how)},\n{out} AS (SELECT *, r_t AS exit_t, r_pnl AS pnl FROM {out}_r)"


@query(sql.chained(*S_SRE, _sre_round, 7, STRADDLE))
def st_sre(spark, sf_dir):
    return _run(st.sre, spark, sf_dir, *S_SRE)


S_SRE_SEP = sets([(t, 900, s, sl) for t in (565, 650) for s, sl in (("SELL", 6.0), ("BUY", 5.0))], "start int, end int, side string, sl double")


def _sep_round(out, src):
    other = {"ce": "pe", "pe": "ce"}
    legs = []
    for n, (k, source) in enumerate((("ce", f"{out}_p"), ("pe", f"{out}_ce"))):
        name = f"{out}_{k}"
        pair = sql.pair_bars(name, source, f"p_{k}", f"p_{other[k]}", "p_t", '"end"').replace(" AS (SELECT s.*, c.t AS bt,", " AS (SELECT s.*, c.t AS bt,")
        pair = pair.replace("greatest(c.high + q.low, c.low + q.high, c.close + q.close) AS bh, least(c.high + q.low, c.low + q.high, c.close + q.close) AS bl, c.close + q.close AS bc", "c.high AS bh, c.low AS bl, c.close AS bc").replace("first_value(c.close + q.close)", "first_value(c.close)")
        legs.append(pair + ",\n" + sql._judged(name, source, k, side="side", sl="sl", cc="false", slp="NULL", intra="0", target="NULL", entry="NULL", rate="0.01", combined=False).replace(f"min(bt) FILTER (hi OR hs OR ht) AS {k}_t", f"min(bt) FILTER (hi OR hs OR ht) AS {k}_t, arg_min(bpe, bt) FILTER (hi OR hs OR ht) AS {k}_other"))
    both = sql.first_of("ce_t", "pe_t", "ce_pnl + (p_pep - ce_other - p_pep * 0.01)", "pe_pnl + (p_cep - pe_other - p_cep * 0.01)")
    return ",\n".join([sql.pick(f"{out}_p", src, start="go"), *legs, f"{out} AS MATERIALIZED (SELECT *, p_cep + p_pep AS r_o, coalesce({sql.first_of('ce_t', 'pe_t', 'ce_t', 'pe_t')}, ce_t) AS exit_t, round_even(coalesce({both}, ce_pnl + pe_pnl), 2) + 0 AS pnl FROM {out}_pe)"])


@query(sql.chained(*S_SRE_SEP, _sep_round, 7, STRADDLE))
def st_sre_sep(spark, sf_dir):
    return _run(st.sre_separate, spark, sf_dir, *S_SRE_SEP)


S_CSRE = sets([(*r, n) for r in SRE[:4] for n in (1, 3)], f"{SRE_SCHEMA}, re_entries int")


def _csre_sql() -> str:
    text, logs, k = [sql.menu(), sql.entries(*S_CSRE), "r0 AS (SELECT *, start AS go FROM en)"], [], sql.keys(S_CSRE[1])
    for n in range(8):
        text += [_sre_round(f"s{n}", f"r{n}"), f'r{n + 1} AS (SELECT rid, {k}, exit_t AS go FROM s{n} WHERE exit_t < "end" - 5)']
        logs.append(f"SELECT {n}::INT AS round, rid, {k}, {STRADDLE} FROM s{n} WHERE {n} <= re_entries")
    text += [f"lg AS ({' UNION ALL '.join(logs)})", "fx AS (SELECT rid, exit_t AS x FROM lg WHERE round = re_entries AND pnl <> 0)", 'ag AS (SELECT lg.* REPLACE (lg.rid * 10 + round AS rid), coalesce(x, "end") AS final_t FROM lg LEFT JOIN fx ON fx.rid = lg.rid)']
    text.append(sql.combined("x", "ag", "a", "ce", "pe", "entry_t", end="final_t", sl="0", intra="0"))
    return ", " + ",\n".join(text) + f" SELECT round, {k}, entry_t, ce, pe, o, final_t, CASE WHEN round < re_entries THEN a_pnl ELSE pnl END AS pnl FROM x"


@query(_csre_sql())
def st_csre(spark, sf_dir):
    return _run(st.csre, spark, sf_dir, *S_CSRE)


S_EXTREMES = sets([(t, 900, "SELL", k, sl, n) for t in (565, 650) for k, sl in (("HL", 8.0), ("CC", 5.0)) for n in (0, 2)], "start int, end int, side string, method string, sl double, re_entries int")


@query()
def st_csre_hclp(spark, sf_dir):
    return _run(st.csre_extremes, spark, sf_dir, *S_EXTREMES)


UT_SETS = [(*r, u, k, sl, "ATM+1") for r in SRE[:4] for u, k, sl in (("SELL", "HL", 10.0), ("BUY", "CC", 6.0))]
UT_SCHEMA = f"{SRE_SCHEMA}, ut_side string, ut_method string, ut_sl double, ut_om string"
S_SUT = sets(UT_SETS, UT_SCHEMA)
TWO = ("0", "ATM+1")
UT_CC = "ut_method = 'CC'"


def _rises(p: str, r: str, less: bool) -> str:
    rise = lambda k: f"({r}_{k}_at - {p}_{k}p) / {p}_{k}p"
    a, b = ("'pe'", "'ce'") if less else ("'ce'", "'pe'")
    return f"CASE WHEN {r}_t < \"end\" - 5 THEN CASE WHEN {rise('ce')} > {rise('pe')} THEN {a} WHEN {rise('ce')} < {rise('pe')} THEN {b} END END"


def _ut_sql(out: str, src: str, p: str = "p", r: str = "r") -> str:
    return f"""{out}_a AS (SELECT *, CASE WHEN ut_side = 'SELL' THEN {_rises(p, r, True)} ELSE {_rises(p, r, False)} END AS ut FROM {src}),
{sql.pick(f"{out}_b", f"{out}_a", "q", "ut_om", f"CASE WHEN ut IS NOT NULL THEN {r}_t END", inner=False)},
{out}_c AS (SELECT *, CASE ut WHEN 'ce' THEN q_ce WHEN 'pe' THEN q_pe END AS ut_scrip FROM {out}_b),
{sql.stop(out, f"{out}_c", "ut", "ut_scrip", "q_t", side="ut_side", sl="ut_sl", cc=UT_CC)}"""


_SUT_CTES = f"{sql.combined('r_', 'p', 'r', 'p_ce', 'p_pe', 'p_t')},\n{_ut_sql('x', 'r_')}"
_SUT_OUT = "p_t AS entry_t, p_ce AS ce, p_pe AS pe, r_o AS o, r_t AS std_t, r_pnl AS std_pnl, ut_scrip, q_t AS ut_entry_t, ut_t, ut_pnl, round_even(r_pnl + ut_pnl, 2) + 0 AS total_pnl"


@query(sql.single(*S_SUT, _SUT_CTES, _SUT_OUT, TWO))
def st_sut(spark, sf_dir):
    return _run(st.sut, spark, sf_dir, *S_SUT, TWO)


S_SUT_TT = sets([(*r, "SELL", "HL", 7.0, "0") for r in UT_SETS], f"{UT_SCHEMA}, tt_side string, tt_method string, tt_sl double, tt_om string")
_TT_CTES = f"""{sql.combined("r_", "p", "r", "p_ce", "p_pe", "p_t")},
a AS (SELECT *, CASE WHEN ut_side = 'SELL' THEN {_rises("p", "r", True)} ELSE {_rises("p", "r", False)} END AS ut, CASE WHEN tt_side = 'SELL' THEN {_rises("p", "r", False)} ELSE {_rises("p", "r", True)} END AS tt FROM r_),
b AS (SELECT a.rid, min(m.t) AS m_t FROM a JOIN menu m ON m.idx = a.idx AND m.trade_date = a.trade_date AND m.om = a.ut_om AND m.t BETWEEN a.r_t AND a."end" JOIN menu n ON n.idx = a.idx AND n.trade_date = a.trade_date AND n.om = a.tt_om AND n.t = m.t WHERE a.ut IS NOT NULL GROUP BY a.rid),
c AS (SELECT a.*, m_t, CASE ut WHEN 'ce' THEN m.ce WHEN 'pe' THEN m.pe END AS ut_scrip, CASE tt WHEN 'ce' THEN n.ce WHEN 'pe' THEN n.pe END AS tt_scrip FROM a LEFT JOIN b USING (rid) LEFT JOIN menu m ON m.idx = a.idx AND m.trade_date = a.trade_date AND m.om = a.ut_om AND m.t = m_t LEFT JOIN menu n ON n.idx = a.idx AND n.trade_date = a.trade_date AND n.om = a.tt_om AND n.t = m_t),
{sql.stop("d", "c", "ut", "ut_scrip", "m_t", side="ut_side", sl="ut_sl", cc=UT_CC)},
{sql.stop("x", "d", "tt", "tt_scrip", "m_t", side="tt_side", sl="tt_sl", cc=UT_CC.replace("ut_", "tt_"))}"""


@query(sql.single(*S_SUT_TT, _TT_CTES, "p_t AS entry_t, r_t AS std_t, r_pnl AS std_pnl, m_t AS both_t, ut_scrip, ut_t, ut_pnl, tt_scrip, tt_t, tt_pnl, round_even(r_pnl + ut_pnl + tt_pnl, 2) + 0 AS total_pnl", TWO))
def st_sut_tt(spark, sf_dir):
    return _run(st.sut_tt, spark, sf_dir, *S_SUT_TT, TWO)


S_SUT_SRE = sets([(*r, "SELL", 5.0, 0.0, "0") for r in UT_SETS[:4]], f"{UT_SCHEMA}, sre_side string, sre_sl double, sre_intra_sl double, sre_om string")


def _after(schema: str, begin: str, most: int = 7) -> str:
    """The straddles from the rows of begin (with go) on."""
    text, parts = [f"r0 AS ({begin})"], []
    for n in range(most):
        text.append(_sre_round(f"s{n}", f"r{n}", "sre_om", side="sre_side", sl="sre_sl", intra="sre_intra_sl"))
        parts.append(f"SELECT {n}::INT AS round, {sql.keys(schema)}, {STRADDLE} FROM s{n}")
        text.append(f'r{n + 1} AS (SELECT rid, {sql.keys(schema)}, exit_t AS go FROM s{n} WHERE exit_t < "end" - 5)')
    return ",\n".join(text) + "\n" + " UNION ALL ".join(parts)


@query(f", {sql.menu(*TWO)},\n{sql.entries(*S_SUT_SRE)},\n{sql.pick('p', 'en')},\n{_SUT_CTES},\n" + _after(S_SUT_SRE[1], f'SELECT rid, {sql.keys(S_SUT_SRE[1])}, ut_t AS go FROM x WHERE ut_t < "end" - 5'))
def st_sut_sre(spark, sf_dir):
    """The straddles after the single leg; the trades before them are st_sut's."""
    return _run(st.sut_sre, spark, sf_dir, *S_SUT_SRE, TWO)[1]


_S2UT = f"""{sql.combined("r1_", "p", "r1", "p_ce", "p_pe", "p_t")},
{sql.pick("p2", "r1_", "p2", start='CASE WHEN r1_t < "end" - 5 THEN r1_t END', inner=False)},
{sql.combined("r2_", "p2", "r2", "p2_ce", "p2_pe", "p2_t")},
{_ut_sql("x", "r2_", "p2", "r2")}"""


@query(sql.single(*S_SUT, _S2UT, "p_t AS entry_t, r1_t AS std1_t, r1_pnl AS std1_pnl, p2_t AS entry2_t, r2_t AS std2_t, r2_pnl AS std2_pnl, ut_scrip, ut_t, ut_pnl, round_even(r1_pnl + r2_pnl + ut_pnl, 2) + 0 AS total_pnl", TWO))
def st_s2ut(spark, sf_dir):
    return _run(st.s2ut, spark, sf_dir, *S_SUT, TWO)


S_ITARGET = sets([(t, 900, "SELL", 6.0, 0.0, p) for t in (565, 610) for p in (0.0, 5.0, 10.0)], f"{SRE_SCHEMA}, target_percent double")
_WINGS = f"w AS (SELECT *, left(p_ce, len(p_ce) - 2)::DOUBLE AS k, round_even(p_f * target_percent / 100 / {sql.GAP}, 0) * {sql.GAP} AS wing FROM p), w2 AS (SELECT *, (k + wing)::INT || 'CE' AS wce, (k - wing)::INT || 'PE' AS wpe FROM w)"


@query(sql.single(*S_ITARGET, f"{_WINGS},\n{sql.combined('x', 'w2', 'r', 'wce', 'wpe', 'p_t')}", "p_t AS entry_t, wce AS ce, wpe AS pe, r_o AS o, r_t AS exit_t, r_pnl AS total_pnl"))
def st_itarget(spark, sf_dir):
    return _run(st.itarget, spark, sf_dir, *S_ITARGET)


S_STARGET = sets([(t, 900, "SELL", 6.0, i, p, 2.0) for t in (565, 610) for p, i in ((600.0, 0.0), (400.0, 9.0))], f"{SRE_SCHEMA}, target_percent double, nv double")
_STARGET = f"""f0 AS (SELECT idx, trade_date, arg_min(close, t) AS f FROM fut WHERE t BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
e1 AS (SELECT en.*, round_even(f * nv * target_percent / 10000 / 2, 2) + 0 AS target FROM en JOIN f0 USING (idx, trade_date)),
e2 AS (SELECT e1.rid, o.t, o.opt_type, arg_min(o.scrip, (abs(o.close - target), o.strike)) AS scrip FROM e1 JOIN opt o ON o.idx = e1.idx AND o.trade_date = e1.trade_date AND o.t BETWEEN start AND "end" JOIN fut f ON f.idx = o.idx AND f.trade_date = o.trade_date AND f.t = o.t GROUP BY ALL),
e3 AS (SELECT rid, t, max(scrip) FILTER (opt_type = 'CE') AS ce, max(scrip) FILTER (opt_type = 'PE') AS pe FROM e2 GROUP BY rid, t HAVING count(*) = 2),
e4 AS (SELECT rid, min(t) AS p_t, arg_min(ce, t) AS p_ce, arg_min(pe, t) AS p_pe FROM e3 GROUP BY rid),
p AS (SELECT * FROM e1 JOIN e4 USING (rid))"""


@query(f", {sql.entries(*S_STARGET)},\n{_STARGET},\n{sql.combined('x', 'p', 'r', 'p_ce', 'p_pe', 'p_t')}\nSELECT {sql.keys(S_STARGET[1])}, p_t AS entry_t, target, p_ce AS ce, p_pe AS pe, r_o AS o, r_t AS exit_t, r_pnl AS total_pnl FROM x")
def st_starget(spark, sf_dir):
    return _run(st.starget, spark, sf_dir, *S_STARGET)


# --- decay --------------------------------------------------------------------------------------------------------------

DT = [(t, 900, s, k, d, sl) for t in (565, 650) for s, k, d, sl in (("SELL", "HL", 5.0, 8.0), ("BUY", "CC", 4.0, 6.0), ("SELL", "HL", 0.0, 8.0), ("SELL", "CC", 6.0, 5.0))]
DT_SCHEMA = "start int, end int, side string, method string, decay double, sl double"
S_DT = sets(DT, DT_SCHEMA)


def _goal(d: str, goal: str) -> str:
    return f"{d} * (1 - CASE WHEN side = 'SELL' THEN 1.0 ELSE -1.0 END::DOUBLE * {goal} / 100)"


def _waited(out: str, src: str, k: str, scrip: str, start: str, *, sl: str = "sl", pct: str = "decay", price: str = "NULL", goal: str | None = None) -> str:
    """{k}_d, {k}_dt of a decay and {k}s_o, {k}s_t, {k}s_tg, {k}s_pnl of the stop after it."""
    target = _goal(f"{k}_d", goal) if goal else "NULL"
    return f"{sql.decay(f'{out}_w', src, k, scrip, start, pct=pct, price=price)},\n{sql.stop(out, f'{out}_w', f'{k}s', scrip, f'{k}_dt', sl=sl, entry=f'CASE WHEN NOT (method = {chr(39)}CC{chr(39)}) THEN {k}_d END', target=target)}"


def _waited_legs(sl: str = "sl", goal: str | None = None) -> str:
    return _waited("a", "p", "ce", "p_ce", "p_t", sl=sl, goal=goal) + ",\n" + _waited("x", "a", "pe", "p_pe", "p_t", sl=sl, goal=goal)


_DT_OUT = ", ".join(f"p_{k} AS {k}, {k}_dt AS {k}_entry_t, {k}_d AS {k}_entry, {k}s_t AS {k}_t, {k}s_pnl AS {k}_pnl" for k in ("ce", "pe"))
_FIRST = sql.first_of("ce_dt", "pe_dt", "'ce'", "'pe'")


@query(sql.single(*S_DT, _waited_legs(), f"p_t AS entry_t, p_f AS future, {_DT_OUT}, round_even(ces_pnl + pes_pnl, 2) + 0 AS total_pnl"))
def st_dt(spark, sf_dir):
    return _run(st.dt, spark, sf_dir, *S_DT)


@query(sql.single(*S_DT, _waited_legs(), f"p_t AS entry_t, {_FIRST} AS first, {_DT_OUT}, round_even(CASE {_FIRST} WHEN 'ce' THEN ces_pnl WHEN 'pe' THEN pes_pnl ELSE ces_pnl + pes_pnl END, 2) + 0 AS total_pnl"))
def st_dt_fs(spark, sf_dir):
    return _run(st.dt_first, spark, sf_dir, *S_DT)


S_DT_UT = sets([(*r[:5], r[5], r[5] + 2) for r in DT], "start int, end int, side string, method string, decay double, fsl double, ssl double")
_SIGNAL = f"g AS (SELECT *, {_FIRST} AS first, {sql.first_of('ce_dt', 'pe_dt', 'ce_dt', 'pe_dt')} AS signal_t, {sql.first_of('ce_dt', 'pe_dt', 'ces_t', 'pes_t')} AS fs_t, coalesce({sql.first_of('ce_dt', 'pe_dt', 'ces_pnl', 'pes_pnl')}, 0) AS fs_pnl, {sql.first_of('ce_dt', 'pe_dt', 'p_pe', 'p_ce')} AS other FROM x)"


@query(sql.single(*S_DT_UT, f"{_waited_legs('fsl')},\n{_SIGNAL},\n{sql.stop('y', 'g', 'u', 'other', 'CASE WHEN fs_t < {e} - 5 THEN fs_t END'.format(e=chr(34) + 'end' + chr(34)), sl='ssl')}", "p_t AS entry_t, first, signal_t, fs_t, fs_pnl, other, u_t AS ut_t, u_pnl AS ut_pnl, round_even(fs_pnl + u_pnl, 2) + 0 AS total_pnl", last="y"))
def st_dt_fs_ut(spark, sf_dir):
    return _run(st.dt_first_ut, spark, sf_dir, *S_DT_UT)


_DT5 = "start int, end int, side string, method string, decay double, dt_sl double, dt_om string"
S_DT_SRE = ([(*r, "0", "SELL", 5.0, 0.0, "0") for r in DT], f"{_DT5}, sre_side string, sre_sl double, sre_intra_sl double, sre_om string")


@query(f", {sql.menu()},\n{sql.entries(*S_DT_SRE)},\n{sql.pick('p', 'en', om='dt_om')},\n{_waited_legs('dt_sl')},\n{_SIGNAL},\n" + _after(S_DT_SRE[1], f'SELECT rid, {sql.keys(S_DT_SRE[1])}, fs_t AS go FROM g WHERE fs_t < "end" - 5'))
def st_dt_fs_sre(spark, sf_dir):
    """The straddles after the first signal; the signals are st_dt_fs's."""
    return _run(st.dt_first_sre, spark, sf_dir, *S_DT_SRE)[1]


S_DT_SUT = ([(*r, "0", 4.0, 0.0, "0", 6.0, "ATM+1") for r in DT], f"{_DT5}, sut_sl double, sut_intra_sl double, sut_om string, ut_sl double, ut_om string")
_DT_SUT = f"""{_waited_legs("dt_sl")},
{_SIGNAL},
h AS (SELECT rid, {sql.keys(S_DT_SUT[1])}, first, signal_t, fs_t, fs_pnl, side AS ut_side, method AS ut_method FROM g),
{sql.pick("h2", "h", "q1", "sut_om", 'CASE WHEN fs_t < "end" - 5 THEN fs_t END', inner=False)},
{sql.combined("h3", "h2", "r", "q1_ce", "q1_pe", "q1_t", sl="sut_sl", intra="sut_intra_sl")},
{_ut_sql("y", "h3", "q1", "r")}"""


@query(f", {sql.menu(*TWO)},\n{sql.entries(*S_DT_SUT)},\n{sql.pick('p', 'en', om='dt_om')},\n{_DT_SUT}\nSELECT {sql.keys(S_DT_SUT[1])}, first, signal_t, fs_pnl, q1_t AS std_entry_t, r_t AS std_t, r_pnl AS std_pnl, ut_scrip, ut_pnl, round_even(fs_pnl + r_pnl + ut_pnl, 2) + 0 AS total_pnl FROM y")
def st_dt_fs_sut(spark, sf_dir):
    return _run(st.dt_first_sut, spark, sf_dir, *S_DT_SUT, TWO)


S_DT_TRAIL = sets([(*r, a, b) for r in DT for a, b in ((0.0, 0.0), (3.0, 2.0))], f"{DT_SCHEMA}, trail_profit double, trail_sl double")


@query()
def st_dt_trail(spark, sf_dir):
    return _run(st.dt_trail, spark, sf_dir, *S_DT_TRAIL)


S_DTN = sets([(*r, 4.0) for r in DT], f"{DT_SCHEMA}, target double")
_OTHER = "CASE WHEN side = 'SELL' THEN 'BUY' ELSE 'SELL' END"


def _again(out: str, src: str, k: str) -> str:
    entry = f"CASE WHEN NOT (method = 'CC') THEN {k}_d END"
    return f"{sql.decay(f'{out}_w', src, f'{k}2', f'p_{k}', f'CASE WHEN {k}s_tg THEN {k}s_t END', side=_OTHER, price=f'{k}_d')},\n{sql.stop(out, f'{out}_w', f'{k}3', f'p_{k}', f'{k}2_dt', entry=entry, target=_goal(f'{k}_d', 'target'))}"


@query(sql.single(*S_DTN, f"{_waited_legs(goal='target')},\n{_again('y', 'x', 'ce')},\n{_again('z', 'y', 'pe')}", f"p_t AS entry_t, {_DT_OUT}, {', '.join(f'coalesce({k}s_tg, false) AS {k}_target, {k}2_dt AS {k}_re_t, {k}3_pnl AS {k}_re_pnl' for k in ('ce', 'pe'))}, round_even(ces_pnl + ce3_pnl + pes_pnl + pe3_pnl, 2) + 0 AS total_pnl", last="z"))
def st_dtn(spark, sf_dir):
    return _run(st.dtn, spark, sf_dir, *S_DTN)


# --- rounds of single legs ----------------------------------------------------------------------------------------------


def _leg_chain(rows: list[tuple], schema: str, first, again, most: int, live: str = "exit_t IS NOT NULL", out: str = "scrip, entry_t, o, exit_t, pnl") -> str:
    """first and again give CTEs s from rows with leg, scrip, cost, cost0 and go (the first entry, or the last exit)."""
    k = sql.keys(schema)
    legs = f"r0 AS (SELECT * EXCLUDE (rid), rid * 2 + i AS rid, CASE i WHEN 0 THEN 'ce' ELSE 'pe' END AS leg, CASE i WHEN 0 THEN p_ce ELSE p_pe END AS scrip, CASE i WHEN 0 THEN p_cep ELSE p_pep END AS cost, CASE i WHEN 0 THEN p_cep ELSE p_pep END AS cost0, p_t AS go FROM p, (VALUES (0), (1)) v(i))"
    text, parts = [sql.menu(), sql.entries(rows, schema), sql.pick("p", "en"), legs], []
    for n in range(most + 1):
        text.append((first if n == 0 else again)(f"s{n}", f"r{n}"))
        parts.append(f"SELECT {n}::INT AS round, {k}, leg, {out} FROM s{n}")
        text.append(f"r{n + 1} AS (SELECT rid, {k}, leg, scrip, cost, cost0, exit_t AS go FROM s{n} WHERE {live})")
    return ", " + ",\n".join(text) + "\n" + " UNION ALL ".join(parts)


def _plain_leg(out: str, src: str) -> str:
    return f"{sql.stop(f'{out}_r', src, 'r', 'scrip', 'go')},\n{out} AS (SELECT *, go AS entry_t, r_o AS o, r_t AS exit_t, r_pnl AS pnl FROM {out}_r)"


def _entered(out: str, src: str, when: str, sl: str, entry: str, target: str = "NULL", exit_t: str = "r_t") -> str:
    return f"{sql.stop(f'{out}_r', src, 'r', 'scrip', when, sl=sl, entry=f'CASE WHEN NOT (method = {chr(39)}CC{chr(39)}) THEN {entry} END', target=target)},\n{out} AS (SELECT *, {when} AS entry_t, r_o AS o, {exit_t} AS exit_t, r_pnl AS pnl FROM {out}_r)"


S_NRE = sets([(t, 900, s, k, 5.0, 4.0) for t in (565, 650) for s, k in (("SELL", "HL"), ("SELL", "CC"), ("BUY", "HL"))], "start int, end int, side string, method string, sl double, re_sl double")


def _nre_again(out, src):
    return f"{sql.decay(f'{out}_d', src, 'd', 'scrip', 'go', price='cost')},\n{out}_f AS (SELECT * FROM {out}_d WHERE d_dt IS NOT NULL),\n{_entered(out, f'{out}_f', 'd_dt', 're_sl', 'cost')}"


@query(_leg_chain(*S_NRE, _plain_leg, _nre_again, 7))
def st_nre(spark, sf_dir):
    return _run(st.nre, spark, sf_dir, *S_NRE)


def _at_target(out: str, src: str, target: str, start: str) -> str:
    """n_t, n_ce, n_pe, n_cep, n_pep: the first balanced strangle from start on with premiums above target; others: null."""
    return f"""{out}_1 AS (SELECT s.rid, o.t, o.opt_type, s._g AS target, arg_min(o.strike, (o.close, o.strike)) AS strike FROM (SELECT *, {target} AS _g, {start} AS _a FROM {src}) s JOIN opt o ON o.idx = s.idx AND o.trade_date = s.trade_date AND o.t BETWEEN s._a AND s."end" AND o.close >= s._g AND o.t BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
{out}_2 AS (SELECT rid, t, any_value(target) AS target, max(strike) FILTER (opt_type = 'CE') AS ck, max(strike) FILTER (opt_type = 'PE') AS pk FROM {out}_1 GROUP BY rid, t HAVING count(*) = 2),
{out}_3 AS (SELECT w.rid, w.t, w.target, v.i, w.ck + v.c AS ck, w.pk + v.p AS pk, s.idx, s.trade_date FROM {out}_2 w JOIN {src} s USING (rid), (VALUES (0, 0, 0), (1, 0, -{sql.GAP}), (2, -{sql.GAP}, 0), (3, 0, {sql.GAP}), (4, {sql.GAP}, 0)) v(i, c, p)),
{out}_4 AS (SELECT c.rid, c.t, arg_min({{'ck': c.ck, 'pk': c.pk, 'ce': a.ce, 'pe': b.pe}}, (abs(a.ce - b.pe), c.i)) AS z FROM {out}_3 c JOIN wide a ON a.idx = c.idx AND a.trade_date = c.trade_date AND a.t = c.t AND a.strike = c.ck JOIN wide b ON b.idx = c.idx AND b.trade_date = c.trade_date AND b.t = c.t AND b.strike = c.pk WHERE a.ce + b.pe >= c.target * 2 AND a.ce + b.pe <= c.target * 3 GROUP BY c.rid, c.t),
{out}_5 AS (SELECT rid, min(t) AS n_t, arg_min(z, t) AS z FROM {out}_4 GROUP BY rid),
{out} AS MATERIALIZED (SELECT s.*, n_t, z.ck::INT || 'CE' AS n_ce, z.pk::INT || 'PE' AS n_pe, z.ce AS n_cep, z.pe AS n_pep FROM {src} s LEFT JOIN {out}_5 USING (rid))"""


def _cc_again(out, src):
    stays = "coalesce(cost <= px_, false)"
    leg = lambda a: f"CASE WHEN leg = 'ce' THEN n_ce{a} ELSE n_pe{a} END"
    return f"""{out}_n AS (SELECT s.*, o.close AS px_ FROM {src} s JOIN opt o ON o.idx = s.idx AND o.trade_date = s.trade_date AND o.scrip = s.scrip AND o.t = s.go),
{sql.decay(f"{out}_d", f"{out}_n", "d", "scrip", "go", price="cost")},
{_at_target(f"{out}_t", f"{out}_d", "cost", f"CASE WHEN NOT {stays} THEN go END")},
{out}_u AS (SELECT * REPLACE (CASE WHEN {stays} THEN scrip ELSE {leg("")} END AS scrip, CASE WHEN {stays} THEN cost ELSE {leg("p")} END AS cost), CASE WHEN {stays} THEN d_dt ELSE n_t END AS in_t FROM {out}_t),
{out}_f AS (SELECT * FROM {out}_u WHERE in_t IS NOT NULL),
{_entered(out, f"{out}_f", "in_t", "re_sl", "cost")}"""


@query(_leg_chain(*S_NRE, _plain_leg, _cc_again, 7))
def st_nre_cc(spark, sf_dir):
    return _run(st.nre_cc, spark, sf_dir, *S_NRE)


S_TILL = sets([(*r[:6], 750) for r in S_NRE[0]], "start int, end int, side string, method string, sl double, re_sl double, till_time int")


@query(_leg_chain(*S_TILL, _plain_leg, _cc_again, 7, "exit_t < till_time"))
def st_nre_cc_till(spark, sf_dir):
    return _run(st.nre_cc, spark, sf_dir, *S_TILL, till=True)


S_CC_TRAIL = sets([(*r[:6], 0.5, False) for r in S_NRE[0]], "start int, end int, side string, method string, sl double, re_sl double, trail double, trail_upto_cost boolean")


@query()
def st_nre_cc_trail(spark, sf_dir):
    return _run(st.nre_cc, spark, sf_dir, *S_CC_TRAIL, trailed="plain")


S_NRE_DT = sets([(t, 900, s, k, 6.0, 0.5) for t in (565, 650) for s, k in (("SELL", "HL"), ("SELL", "CC"))], "start int, end int, side string, method string, sl double, ratio double")


@query()
def st_nre_dt(spark, sf_dir):
    return _run(st.nre_decay, spark, sf_dir, *S_NRE_DT)


def _new_strike(out, src, goal=None):
    return f"""{sql.pick(f"{out}_p", src, "q", start="go")},
{out}_s AS (SELECT * REPLACE (CASE WHEN leg = 'ce' THEN q_ce ELSE q_pe END AS scrip) FROM {out}_p),
{sql.decay(f"{out}_d", f"{out}_s", "d", "scrip", "q_t", pct="decay")},
{out}_f AS (SELECT * FROM {out}_d WHERE d_dt IS NOT NULL),
{_entered(out, f"{out}_f", "d_dt", "sl", "d_d", _goal("d_d", goal) if goal else "NULL")}"""


S_RED = sets([(t, 900, s, k, 3.0, 5.0) for t in (565, 650) for s, k in (("SELL", "HL"), ("BUY", "CC"))], DT_SCHEMA)


@query(_leg_chain(*S_RED, _plain_leg, _new_strike, 7))
def st_red(spark, sf_dir):
    return _run(st.red, spark, sf_dir, *S_RED)


S_DT_RE = sets([(t, 900, s, k, 3.0, 8.0, 5.0) for t in (565, 650) for s, k in (("SELL", "HL"), ("SELL", "CC"), ("BUY", "HL"))], f"{DT_SCHEMA}, re_decay double")


def _first_decay(out, src):
    return f"""{sql.decay(f"{out}_d", src, "d", "scrip", "go", pct="decay")},
{out}_f AS (SELECT * FROM {out}_d WHERE d_dt IS NOT NULL),
{_entered(out, f"{out}_f", "d_dt", "sl", "d_d", _goal("d_d", "re_decay"))}"""


@query(_leg_chain(*S_DT_RE, _first_decay, lambda out, src: _new_strike(out, src, "re_decay"), 7, "r_tg"))
def st_dt_re(spark, sf_dir):
    return _run(st.dt_rounds, spark, sf_dir, *S_DT_RE)


_SBS = "start int, end int, method string, sell_sl double, sell_trail double, sell_sl_trail double, sell_track_original boolean, buy_flag boolean, buy_sl double, buy_trail double, buy_sl_trail double, buy_track_original boolean, sell2_flag boolean"
S_SBS = sets([(t, 900, "HL", 5.0, a, b, o, True, 4.0, c, d, False, z) for t in (565, 650) for a, b, o, c, d, z in ((0.0, 0.0, False, 0.0, 0.0, True), (3.0, 2.0, True, 3.0, 2.0, True), (3.0, 2.0, False, 0.0, 0.0, False))], f"{_SBS}, side string")
S_SBS = ([(*r[:13], "SELL", r[14] if len(r) > 14 else "0") for r in [(*x[:-1], "SELL", x[-1]) for x in S_SBS[0]]], S_SBS[1])


@query()
def st_sbs(spark, sf_dir):
    return _run(st.sbs, spark, sf_dir, *S_SBS)


# --- breakouts and spreads ----------------------------------------------------------------------------------------------

S_OPT_BREAK = sets([(t, 900, s, k, 60, 8.0) for t in (565, 610) for s, k in (("SELL", "HL"), ("BUY", "HL"), ("SELL", "CC"))], "start int, end int, side string, method string, minutes int, sl double")


def _edge(out: str, src: str, k: str) -> str:
    edge = f"e_{k} AS MATERIALIZED (SELECT s.*, (SELECT CASE WHEN s.side = 'SELL' THEN min(o.low) ELSE max(o.high) END FROM opt o WHERE o.idx = s.idx AND o.trade_date = s.trade_date AND o.scrip = s.p_{k} AND o.t BETWEEN s.p_t AND s.p_t + s.minutes AND o.t <= {LAST}) AS {k}_edge FROM {src} s)"
    return f"{edge},\n{_waited(out, f'e_{k}', k, f'p_{k}', 'p_t + minutes', pct='NULL', price=f'{k}_edge')}"


@query(sql.single(*S_OPT_BREAK, f"{_edge('a', 'p', 'ce')},\n{_edge('x', 'a', 'pe')}", f"p_t AS entry_t, {_DT_OUT}, round_even(ces_pnl + pes_pnl, 2) + 0 AS total_pnl"))
def st_opt_breakout(spark, sf_dir):
    return _run(st.option_breakout, spark, sf_dir, *S_OPT_BREAK)


S_FUT_BREAK = sets([(t, 900, k, 60, 8.0) for t in (565, 650) for k in ("HL", "CC")], "start int, end int, method string, minutes int, sl double")
_BREAK = f"""b1 AS (SELECT en.rid, min(low) AS lo, max(high) AS hi FROM en JOIN fut f ON f.idx = en.idx AND f.trade_date = en.trade_date AND f.t BETWEEN start AND start + minutes AND f.t BETWEEN {FIRST} AND {LAST} GROUP BY en.rid),
b2 AS (SELECT en.*, lo, hi, f.t AS ft, f.low, f.high, f.close, row_number() OVER (PARTITION BY en.rid ORDER BY f.t) AS i FROM en JOIN b1 USING (rid) JOIN fut f ON f.idx = en.idx AND f.trade_date = en.trade_date AND f.t >= start + minutes AND f.t BETWEEN {FIRST} AND {LAST}),
b3 AS (SELECT rid, min(ft) FILTER (i > 1 AND CASE WHEN method = 'CC' THEN close ELSE low END <= lo) AS down, min(ft) FILTER (i > 1 AND CASE WHEN method = 'CC' THEN close ELSE high END >= hi) AS up FROM b2 GROUP BY rid),
b4 AS (SELECT en.*, {sql.first_of("down", "up", "'down'", "'up'")} AS way, least(down, up) AS break_t FROM en JOIN b3 USING (rid)),
b5 AS (SELECT * FROM b4 WHERE way IS NOT NULL),
{sql.pick("p", "b5", start="break_t")},
q AS (SELECT *, CASE WHEN way = 'down' THEN p_ce ELSE p_pe END AS sold, CASE WHEN way = 'down' THEN p_pe ELSE p_ce END AS bought FROM p),
{sql.stop("y", "q", "s", "sold", "p_t", side="'SELL'")},
{sql.stop("x", "y", "b", "bought", "p_t", side="'BUY'")}"""


@query(f", {sql.menu()},\n{sql.entries(*S_FUT_BREAK)},\n{_BREAK}\nSELECT {sql.keys(S_FUT_BREAK[1])}, way, break_t, p_t AS entry_t, sold, s_t AS sold_t, s_pnl AS sold_pnl, bought, b_t AS bought_t, b_pnl AS bought_pnl, round_even(s_pnl + b_pnl, 2) + 0 AS total_pnl FROM x")
def st_fut_breakout(spark, sf_dir):
    return _run(st.future_breakout, spark, sf_dir, *S_FUT_BREAK)


WINGS = ("0", "ATM+2")
S_FLY = ([(t, 900, "0", "ATM+2", sl) for t in (565, 650) for sl in (5.0, 20.0)], "start int, end int, sell_om string, buy_om string, sl double")
_FLY = f"""m1 AS (SELECT en.rid, min(a.t) AS m_t FROM en JOIN menu a ON a.idx = en.idx AND a.trade_date = en.trade_date AND a.om = sell_om AND a.t BETWEEN start AND "end" JOIN menu b ON b.idx = en.idx AND b.trade_date = en.trade_date AND b.om = buy_om AND b.t = a.t GROUP BY en.rid),
m2 AS (SELECT en.*, m_t, a.ce AS sell_ce, a.pe AS sell_pe, b.ce AS buy_ce, b.pe AS buy_pe, coalesce((SELECT max(z.t) + 1 FROM menu z WHERE z.idx = en.idx AND z.trade_date = en.trade_date AND z.om = sell_om AND z.t >= start AND z.t < m_t), start) AS from_t FROM en JOIN m1 USING (rid) JOIN menu a ON a.idx = en.idx AND a.trade_date = en.trade_date AND a.om = sell_om AND a.t = m_t JOIN menu b ON b.idx = en.idx AND b.trade_date = en.trade_date AND b.om = buy_om AND b.t = m_t),
m3 AS (SELECT m2.*, c.t AS bt, c.close + p.close AS body_, d.close + q.close AS wing_ FROM m2 {" ".join(f"JOIN opt {x} ON {x}.idx = m2.idx AND {x}.trade_date = m2.trade_date AND {x}.scrip = {k} AND {x}.t {'BETWEEN from_t AND ' + chr(34) + 'end' + chr(34) if x == 'c' else '= c.t'}" for x, k in (("c", "sell_ce"), ("p", "sell_pe"), ("d", "buy_ce"), ("q", "buy_pe")))}),
m4 AS (SELECT *, first_value(body_) OVER w AS body, first_value(wing_) OVER w AS wing FROM m3 WINDOW w AS (PARTITION BY rid ORDER BY bt)),
m5 AS (SELECT rid, min(bt) AS entry_t, any_value(body) AS body, any_value(wing) AS wing, min(bt) FILTER (body_ - wing_ >= (body - wing) * (1 + sl / 100)) AS exit_t, coalesce(arg_min(body_ - wing_, bt) FILTER (body_ - wing_ >= (body - wing) * (1 + sl / 100)), arg_max(body_ - wing_, bt)) AS px FROM m4 GROUP BY rid)"""


@query(f", {sql.menu(*WINGS)},\n{sql.entries(*S_FLY)},\n{_FLY}\nSELECT {sql.keys(S_FLY[1])}, entry_t, sell_ce, sell_pe, buy_ce, buy_pe, body, wing, exit_t, round_even((body - wing) - px - (body + wing) * 0.01, 2) + 0 AS total_pnl FROM m2 JOIN m5 USING (rid) WHERE body * 0.9 > wing")
def st_ironfly(spark, sf_dir):
    return _run(st.ironfly, spark, sf_dir, *S_FLY, WINGS)


# --- premium shift ------------------------------------------------------------------------------------------------------

SHIFT = [(t, 900, "SELL", k, d, mv) for t in (565, 650) for k, d, mv in (("HL", 5.0, 60.0), ("CC", 10.0, 65.0))]
SHIFT_SCHEMA = "start int, end int, side string, method string, divider double, movement double"
S_SHIFT = sets(SHIFT, SHIFT_SCHEMA, "ATM+1")
SHIFT_OM = ("ATM+1", "0")


def _shifted(spark, sf_dir, given=None, **how):
    return _run(shift.shift, spark, sf_dir, *(given or S_SHIFT), SHIFT_OM, **how)


def _labelled(parts: dict) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.withColumn("rule", F.lit(name)) for name, df in parts.items()))


@query()
def st_shift(spark, sf_dir):
    return _shifted(spark, sf_dir, ending="none")


@query()
def st_shift_stop(spark, sf_dir):
    """The ending rules, one beside the other."""
    m = Market(spark, sf_dir)
    desk = m.desk(*SHIFT_OM)
    return _labelled({rule: shift.shift(m.entries(*S_SHIFT), desk, ending=rule) for rule in ("premium", "straddle", "nstraddle")})


@query()
def st_shift_exit(spark, sf_dir):
    """The exit rules, one beside the other."""
    m = Market(spark, sf_dir)
    desk = m.desk(*SHIFT_OM)
    entries = m.entries(*S_SHIFT)
    left = {"premium": shift.held(entries, desk), "straddle": shift.held(entries, desk, ending="straddle"), "separate": shift.held(entries, desk, separate=True)}
    rules = {"price": "premium", "both": "straddle", "ut": "straddle", "separate": "separate"}
    return _labelled({rule: shift.closed(left[x], entries.columns, desk, rule) for rule, x in rules.items()})


S_SHIFT_TRAIL = sets([(*r, 10.0) for r in SHIFT], f"{SHIFT_SCHEMA}, trail double", "ATM+1")
S_SHIFT_ACTION = sets([(*r, n) for r in SHIFT for n in (1, 2)], f"{SHIFT_SCHEMA}, action int", "ATM+1")


@query()
def st_shift_trail(spark, sf_dir):
    return _shifted(spark, sf_dir, S_SHIFT_TRAIL, trailed=True)


@query()
def st_shift_action(spark, sf_dir):
    return _shifted(spark, sf_dir, S_SHIFT_ACTION, limited=True)


@query()
def st_shift_re(spark, sf_dir):
    return _run(shift.shift_again, spark, sf_dir, *S_SHIFT, SHIFT_OM)


# --- weeks --------------------------------------------------------------------------------------------------------------

WEEK_END = 4 * 1440 + 900
S_WEEK_B120 = sets([(t, WEEK_END, s, k, sl, ut) for t in (565, 650) for s, k, sl, ut in (("SELL", "HL", 20.0, "20"), ("SELL", "CC", 15.0, "TTC"), ("BUY", "HL", 15.0, "20"))], B120_SCHEMA)
_RANGE_SCHEMA = "start int, end int, side string, sl double, intra_sl double, fixed_or_dynamic string, normal_or_cut string, synthetic_future boolean, dte1re int, dte2re int, dte3re int, dte4re int, dte5re int"
RANGE = [(565, WEEK_END, "SELL", sl, i, f, c, y, 1, 1, 1, 1, 1) for sl, i, f, c, y in ((12.0, 0.0, "FIXED", "NORMAL", False), (20.0, 30.0, "DYNAMIC", "NORMAL", True), (15.0, 0.0, "DYNAMIC", "CUT", False))]
S_RANGE = sets(RANGE, _RANGE_SCHEMA)


def _weekly(spark, sf_dir, rows, schema, *oms):
    m = Market(spark, sf_dir).weekly()
    return m.entries(rows, schema), m.weekly_desk(*(oms or OM))


@query()
def mod_weekly(spark, sf_dir):
    """The separate-stop strategy over weeks."""
    return st.b120(*_weekly(spark, sf_dir, *S_WEEK_B120))


def _ranges(spark, sf_dir, **how):
    entries, desk = _weekly(spark, sf_dir, *S_RANGE)
    return weekly.srew_range(entries, desk, **how), entries.columns


@query()
def st_srew_range(spark, sf_dir):
    return _ranges(spark, sf_dir)[0].drop("days")


@query()
def st_srew_range_trail(spark, sf_dir):
    return _ranges(spark, sf_dir, trailed=True)[0].drop("days")


@query()
def range_sl_trail(spark, sf_dir):
    """The first trade alone, whose band shrinks with the premium."""
    return _ranges(spark, sf_dir, trailed=True, most=0)[0].drop("days", "round")


@query()
def daywise_last5(spark, sf_dir):
    rows, keys = _ranges(spark, sf_dir)
    return weekly.last_five(weekly.daywise(rows, keys), keys)


S_TO_STD = ([(*r, "0", "ATM+2") for r in RANGE], f"{_RANGE_SCHEMA}, om string, starting_om string")


@query()
def st_str_to_std(spark, sf_dir):
    """The strangles and, as further rows, the straddles that follow."""
    entries, desk = _weekly(spark, sf_dir, *S_TO_STD, "0", "ATM+2")
    strangles, rows = weekly.strangle_to_straddle(entries, desk)
    first_rows = strangles.select(F.lit(-1).alias("round"), *entries.columns, "entry_t", "ce", "pe", F.col("touch_t").alias("exit_t"), F.col("first_pnl").alias("pnl"))
    return first_rows.unionByName(rows.select("round", *entries.columns, "entry_t", "ce", "pe", "exit_t", "pnl"))


_DAYS = """dw AS (SELECT f.idx, f.trade_date, o.scrip, o.t, o.close, dense_rank() OVER (PARTITION BY f.idx, f.wk ORDER BY f.trade_date)::INT - 1 AS d, min(f.trade_date) OVER (PARTITION BY f.idx, f.wk) AS first_day
 FROM (SELECT DISTINCT q.idx, q.trade_date, (n - 1) // 5 AS wk FROM ft q JOIN cal USING (trade_date)) f JOIN opt o ON o.idx = f.idx AND o.trade_date = f.trade_date WHERE o.t BETWEEN {a} AND {b}),
de AS (SELECT idx, first_day, scrip, d, arg_min(close, t) AS o, arg_max(close, t) AS c FROM dw GROUP BY ALL)"""


@query(f""", {_DAYS.format(a=FIRST, b=LAST)}, dv AS (SELECT *, lag(c) OVER w AS p, row_number() OVER (PARTITION BY idx, first_day, scrip ORDER BY d DESC) AS r, first_value(o) OVER w AS o1 FROM de WINDOW w AS (PARTITION BY idx, first_day, scrip ORDER BY d))
SELECT idx, first_day AS trade_date, scrip, d, round(coalesce(p, o) - c - CASE WHEN r = 1 THEN o1 * 0.01 ELSE 0 END, 4) + 0 AS pnl FROM dv""")
def daywise_mtm(spark, sf_dir):
    """Each scrip sold for the whole week."""
    m = Market(spark, sf_dir).weekly()
    return weekly.daywise_leg(m.weekly_desk().legs, ["idx", "trade_date", "scrip"], side="SELL", rate=0.01)


# --- hedge, queue, modifiers --------------------------------------------------------------------------------------------

S_HEDGE = ([(t, 900, k, "hedge", 20.0, 10.0) for t in (565, 650) for k in ("HL", "CC")], "start int, end int, method string, hedge_om string, hedge_sl double, hedge_decay double")


@query()
def st_hedge_bre(spark, sf_dir):
    """Hedges cost at least 30 % of the straddle's mean leg."""
    m = Market(spark, sf_dir)
    desk = m.desk()
    targets = m.atm.select("idx", "trade_date", "t", "future", ((F.col("ce") + F.col("pe")) / 2 * 0.3).alias("target"))
    cheap = menu(strikes.nearest_premium(m.session, targets).drop("target"), "hedge")
    desk = replace(desk, menus=desk.menus.unionByName(cut(cheap, "menus")))
    return st.hedged(m.entries(*S_HEDGE), desk)


QUEUE = [("IDX0", g, n, 570 + 30 * g + 10 * n, "0", 6.0 + g, u) for g in range(4) for n, u in ((1, "10"), (2, "TTC"), (3, "0"))] + [("IDX1", g, n, 600 + 40 * g + 10 * n, "ATM+1", 8.0, "12") for g in range(3) for n in (1, 2)]


def _queued(spark, sf_dir, trim):
    m = Market(spark, sf_dir)
    desk = m.desk("0", "ATM+1")
    queue = spark.createDataFrame(QUEUE, "idx string, group_no int, seq_no int, start int, om string, sl double, ut_sl string")
    return st.b120_queue(m.entries([(900, "SELL", "HL", n) for n in (2, 4)], "end int, side string, method string, lots int"), queue, desk, trim)


@query()
def st_b120_queue(spark, sf_dir):
    """Trimmed after each group, and after each row."""
    return _labelled({trim: _queued(spark, sf_dir, trim) for trim in ("group", "row")})


S_SI = sets([(*r, i, b, 60) for r in B120 for i, b in (("low", 0.02), ("high", -0.05), ("avg", 0.0))], f"{B120_SCHEMA}, std_indicator string, indicator_buffer double, buffer_minute int")
_GATE = f"""g1 AS (SELECT en.rid, m.t, m.ce_price + m.pe_price AS v, lag(m.t) OVER (PARTITION BY en.rid ORDER BY m.t) AS was FROM en JOIN menu m ON m.idx = en.idx AND m.trade_date = en.trade_date AND m.om = '0'),
g2 AS (SELECT en.rid, start, std_indicator, indicator_buffer, t, v, greatest({FIRST}, start - buffer_minute) AS lo, (t < start)::INT + (t - 1 >= greatest({FIRST}, start - buffer_minute) AND coalesce(was <> t - 1, true))::INT AS w FROM en JOIN g1 USING (rid)),
g3 AS (SELECT rid, CASE upper(any_value(std_indicator)) WHEN 'LOW' THEN min(v) WHEN 'HIGH' THEN max(v) ELSE sum(v * w) / nullif(sum(w), 0) END * (1 + any_value(indicator_buffer)) AS level FROM g2 WHERE t BETWEEN lo AND start GROUP BY rid),
g4 AS (SELECT en.rid, min(t) AS at_ FROM en JOIN g3 USING (rid) JOIN g1 USING (rid) WHERE t >= start AND t <= "end" - 4 AND v <= level GROUP BY en.rid),
gate AS (SELECT en.* REPLACE (at_ AS start), start AS from_t FROM en JOIN g4 USING (rid))"""


@query(f", {sql.menu()},\n{sql.entries(*S_SI)},\n{_GATE},\n{sql.pick('p', 'gate')},\n{sql.b120('x', 'p')}\nSELECT {sql.keys(S_SI[1])}, from_t, p_t AS entry_t, {sql.LEGS}, {sql.UT}, total_pnl FROM x")
def mod_si(spark, sf_dir):
    """The separate-stop strategy, entered only when the premium is low enough."""
    m = Market(spark, sf_dir)
    desk = m.desk()
    return st.b120(st.gated(m.entries(*S_SI), desk), desk)


S_PSL = sets([(565, 900, s, k, sl, u, last, n) for s, k, sl, u in (("SELL", "HL", 8.0, "10"), ("SELL", "CC", 5.0, "TTC")) for last, n in ((625, 30), (685, 60))], f"{B120_SCHEMA}, last_trade_time int, trade_interval int")


@query()
def st_b120_dut_re(spark, sf_dir):
    return _run(st.b120_double_ut, spark, sf_dir, *S_B120)


def _straddles(m: Market) -> DataFrame:
    leg = lambda k: m.legs.where(F.col("scrip").endswith(k)).select("idx", "trade_date", F.regexp_extract("scrip", "^(.*)..$", 1).cast("double").alias("strike"), F.col("bars").alias(k))
    return leg("CE").join(leg("PE"), ["idx", "trade_date", "strike"]).select("idx", "trade_date", "strike", triggers.straddle_bars(F.col("CE"), F.col("PE")).alias("bars"))


@query()
def trail_combined(spark, sf_dir):
    """All strikes' straddles, in the four modes, sold and bought."""
    rows = cut(_straddles(Market(spark, sf_dir)), "straddles").crossJoin(F.broadcast(spark.createDataFrame([("SELL",), ("BUY",)], "side string")))
    modes = {"RATIO": {"gap": 0.5}, "POINT": {}, "PCT": {}, "STEP": {"step": 3.0, "sl_step": 2.0}}
    one = lambda mode, how: triggers.trail_combined(F.col("bars"), F.lit(565), F.lit(900), mode=mode, side=F.col("side"), sl=6.0, intra=9.0, rate=0.01, **how)
    return _labelled({mode: rows.select("idx", "trade_date", "strike", "side", one(mode, how).alias("r")).select("idx", "trade_date", "strike", "side", "r.*").where("o IS NOT NULL") for mode, how in modes.items()})


@query()
def trail_limited(spark, sf_dir):
    """Every scrip, with 1 to 7 tightenings at most."""
    legs = Market(spark, sf_dir).legs.crossJoin(F.broadcast(spark.createDataFrame([("SELL",), ("BUY",)], "side string")))
    o = triggers.first(triggers.window(F.col("bars"), F.lit(565), F.lit(900)))["close"]
    rows = legs.select("idx", "trade_date", "scrip", "side", "bars", o.alias("o")).where("o IS NOT NULL")
    gains = triggers.trail_limited(F.col("bars"), F.lit(565), F.lit(900), side=F.col("side"), o=F.col("o"), sl=8.0, sl_step=2.0, step=3.0)
    return rows.select("idx", "trade_date", "scrip", "side", gains.alias("g")).select("idx", "trade_date", "scrip", "side", *(F.round(F.get("g", F.lit(i)), 6).alias(f"gain_{i + 1}") for i in range(7)))
