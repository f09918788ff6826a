"""SQL of the strategies: common table expressions for choices, stops and decays, chained like the trades.

A step reads rows of a table with a unique rid, and gives them with the step's columns, whose names start with a prefix.
Arguments are SQL over those rows' columns. The rows' sessions are in idx and trade_date.
"""

from __future__ import annotations

from strikelab.catalog import FIRST, GAP, LAST

#: Slippage of an index and its tick, where SQL follows the instruments' rules (see `instruments`).
PLAIN, OWN = ("0.01", None), ("(CASE idx WHEN 'IDX1' THEN 0.005 ELSE 0.01 END)", "(CASE idx WHEN 'IDX1' THEN 1.0 END)")
_rules = PLAIN


def instruments(build):
    """build(), whose SQL follows each index's own slippage and ticks."""
    global _rules
    _rules = OWN
    try:
        return build()
    finally:
        _rules = PLAIN


def ticked(x: str, up: str) -> str:
    tick = _rules[1]
    return x if tick is None else f"(CASE WHEN {tick} IS NULL THEN {x} ELSE round((CASE WHEN {up} THEN ceil(round(({x}) / {tick}, 6)) ELSE floor(round(({x}) / {tick}, 6)) END) * {tick}, 2) END)"


ATM = f"""ses AS (SELECT * FROM wide WHERE t BETWEEN {FIRST} AND {LAST}), fu AS (SELECT idx, trade_date, t, close AS future, round_even(close / {GAP}, 0) * {GAP} AS k FROM fut WHERE t BETWEEN {FIRST} AND {LAST}),
cen AS (SELECT fu.idx, fu.trade_date, fu.t, future, round_even((ce - pe + strike) / {GAP}, 0) * {GAP} AS k FROM fu JOIN ses ON fu.idx = ses.idx AND fu.trade_date = ses.trade_date AND fu.t = ses.t AND strike = k WHERE ce IS NOT NULL AND pe IS NOT NULL),
tri AS (SELECT c.idx, c.trade_date, c.t, future, strike, ce, pe, row_number() OVER (PARTITION BY c.idx, c.trade_date, c.t ORDER BY abs(ce - pe), o.o) AS r FROM cen c, (VALUES (0, 0), (1, {GAP}), (2, -{GAP})) o(o, d), ses s WHERE s.idx = c.idx AND s.trade_date = c.trade_date AND s.t = c.t AND s.strike = c.k + o.d AND s.ce IS NOT NULL AND s.pe IS NOT NULL),
atm AS (SELECT idx, trade_date, t, future, strike, ce, pe FROM tri WHERE r = 1)"""


def menu(*oms: str) -> str:
    """menu: idx, trade_date, om, t, future, ce, pe, ce_price, pe_price of every minute; om 0 or ATM+n."""
    parts = []
    for om in oms or ("0",):
        d = float(om[3:]) * GAP if om.startswith("ATM") else 0.0
        parts.append(f"""SELECT a.idx, a.trade_date, '{om}' AS om, a.t, a.future, (a.strike + {d})::INT || 'CE' AS ce, (a.strike - {d})::INT || 'PE' AS pe, c.ce AS ce_price, p.pe AS pe_price FROM atm a JOIN ses c ON c.idx = a.idx AND c.trade_date = a.trade_date AND c.t = a.t AND c.strike = a.strike + {d} AND c.ce IS NOT NULL
 JOIN ses p ON p.idx = a.idx AND p.trade_date = a.trade_date AND p.t = a.t AND p.strike = a.strike - {d} AND p.pe IS NOT NULL""")
    return f"{ATM}, menu AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def literal(x) -> str:
    return f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def entries(rows: list[tuple], schema: str) -> str:
    """en: every session with every set, with rid."""
    names = ", ".join(f'"{c.split()[0]}"' for c in schema.split(", "))
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"en AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM (SELECT DISTINCT idx, trade_date FROM ft), (VALUES {values}) v({names}))"


def keys(schema: str) -> str:
    return "idx, trade_date, " + ", ".join(f'"{c.split()[0]}"' for c in schema.split(", "))


def pick(out: str, src: str, p: str = "p", om: str = "om", start: str = "start", inner: bool = True) -> str:
    """{p}_t, {p}_ce, {p}_pe, {p}_cep, {p}_pep, {p}_f: the first choice from start on, to the end; inner: rows without one go."""
    cols = ", ".join(f"CASE WHEN m.t <= s.\"end\" THEN m.{a} END AS {p}_{b}" for a, b in (("t", "t"), ("ce", "ce"), ("pe", "pe"), ("ce_price", "cep"), ("pe_price", "pep"), ("future", "f")))
    body = f"SELECT s.*, {cols} FROM (SELECT *, {om} AS _om, {start} AS _go FROM {src}) s ASOF LEFT JOIN menu m ON m.idx = s.idx AND m.trade_date = s.trade_date AND m.om = s._om AND s._go <= m.t"
    return f"{out} AS MATERIALIZED (SELECT * EXCLUDE (_om, _go) FROM ({body}){f' WHERE {p}_t IS NOT NULL' if inner else ''})"


def bars(out: str, src: str, scrip: str, start: str, end: str) -> str:
    """{out}_1: the rows with each bar (bt, bh, bl, bc), its number bi and the first close c1."""
    return f"""{out}_1 AS (SELECT s.*, o.t AS bt, o.high AS bh, o.low AS bl, o.close AS bc, row_number() OVER w AS bi, first_value(o.close) OVER w AS c1
 FROM (SELECT *, {scrip} AS _k, {start} AS _a, {end} AS _z FROM {src}) s JOIN opt o ON o.idx = s.idx AND o.trade_date = s.trade_date AND o.scrip = s._k AND o.t BETWEEN s._a AND s._z AND o.t BETWEEN {FIRST} AND {LAST} WINDOW w AS (PARTITION BY s.rid ORDER BY o.t))"""


def pair_bars(out: str, src: str, ce: str, pe: str, start: str, end: str) -> str:
    """As bars, of a straddle: the minutes that both legs have; bce and bpe their closes."""
    return f"""{out}_1 AS (SELECT s.*, c.t AS bt, greatest(c.high + q.low, c.low + q.high, c.close + q.close) AS bh, least(c.high + q.low, c.low + q.high, c.close + q.close) AS bl, c.close + q.close AS bc, c.close AS bce, q.close AS bpe, row_number() OVER w AS bi, first_value(c.close + q.close) OVER w AS c1
 FROM (SELECT *, {ce} AS _k, {pe} AS _k2, {start} AS _a, {end} AS _z FROM {src}) s JOIN opt c ON c.idx = s.idx AND c.trade_date = s.trade_date AND c.scrip = s._k AND c.t BETWEEN s._a AND s._z AND c.t BETWEEN {FIRST} AND {LAST}
 JOIN opt q ON q.idx = s.idx AND q.trade_date = s.trade_date AND q.scrip = s._k2 AND q.t = c.t WINDOW w AS (PARTITION BY s.rid ORDER BY c.t))"""


def _judged(out: str, src: str, p: str, *, side: str, sl: str, cc: str, slp: str, intra: str, target: str, entry: str, rate: str, combined: bool) -> str:
    along = "bc" if combined else "CASE WHEN g > 0 THEN bl ELSE bh END"
    closes = "true" if combined else cc
    extra = f", arg_min(bce, bt) FILTER (hi OR hs OR ht) AS {p}_ce_at, arg_min(bpe, bt) FILTER (hi OR hs OR ht) AS {p}_pe_at" if combined else ""
    return f"""{out}_2 AS (SELECT *, CASE WHEN {side} = 'SELL' THEN 1.0 ELSE -1.0 END::DOUBLE AS g, coalesce(({entry})::DOUBLE, c1) AS o_ FROM {out}_1),
{out}_3 AS (SELECT *, {ticked(f"coalesce(({slp})::DOUBLE, CASE WHEN ({sl}) > 0 THEN (100 + g * ({sl})) / 100 * o_ END)", "g > 0")} AS lv, {ticked(f"CASE WHEN ({intra}) > 0 THEN (100 + g * ({intra})) / 100 * o_ END", "g > 0")} AS iv, {ticked(f"({target})::DOUBLE", "g < 0")} AS tv FROM {out}_2),
{out}_4 AS (SELECT *, coalesce(g * CASE WHEN g > 0 THEN bh ELSE bl END >= g * iv, false) AS hi, coalesce(g * CASE WHEN {closes} THEN bc WHEN g > 0 THEN bh ELSE bl END >= g * lv, false) AS hs, coalesce(g * ({along}) <= g * tv, false) AS ht FROM {out}_3 WHERE bi > 1),
{out}_5 AS (SELECT rid, any_value(o_) AS {p}_o, any_value(lv) AS {p}_slp, any_value(g) AS g, min(bt) FILTER (hi OR hs OR ht) AS {p}_t, coalesce(arg_min(CASE WHEN hi THEN iv WHEN hs THEN CASE WHEN {closes} THEN bc ELSE lv END ELSE {"bc" if combined else "tv"} END, bt) FILTER (hi OR hs OR ht), arg_max(bc, bt)) AS ex, coalesce(arg_min(ht AND NOT hi AND NOT hs, bt) FILTER (hi OR hs OR ht), false) AS {p}_tg{extra} FROM {out}_4 GROUP BY rid),
{out} AS MATERIALIZED (SELECT s.*, r.* EXCLUDE (rid, g, ex), coalesce(round_even(g * ({p}_o - ex) - {p}_o * {_rules[0] if rate == "0.01" else rate}, 2) + 0, 0) AS {p}_pnl FROM {src} s LEFT JOIN {out}_5 r USING (rid))"""


def stop(out: str, src: str, p: str, scrip: str, start: str, *, end: str = '"end"', side: str = "side", sl: str = "sl", cc: str = "method = 'CC'", slp: str = "NULL", intra: str = "0", target: str = "NULL", entry: str = "NULL", rate: str = "0.01") -> str:
    """{p}_o, {p}_slp (its stop), {p}_t, {p}_tg (target met), {p}_pnl."""
    return bars(out, src, scrip, start, end) + ",\n" + _judged(out, src, p, side=side, sl=sl, cc=cc, slp=slp, intra=intra, target=target, entry=entry, rate=rate, combined=False)


def combined(out: str, src: str, p: str, ce: str, pe: str, start: str, *, end: str = '"end"', side: str = "side", sl: str = "sl", intra: str = "intra_sl", rate: str = "0.01") -> str:
    """As stop, of a straddle; {p}_ce_at and {p}_pe_at are the legs' closes at its minute."""
    return pair_bars(out, src, ce, pe, start, end) + ",\n" + _judged(out, src, p, side=side, sl=sl, cc="true", slp="NULL", intra=intra, target="NULL", entry="NULL", rate=rate, combined=True)


def decay(out: str, src: str, p: str, scrip: str, start: str, *, end: str = '"end"', side: str = "side", cc: str = "method = 'CC'", pct: str = "NULL", price: str = "NULL") -> str:
    """{p}_d (its price) and {p}_dt (when)."""
    return bars(out, src, scrip, start, end) + f""",
{out}_2 AS (SELECT *, coalesce(({pct}) = 0, false) AS now_, CASE WHEN {side} = 'SELL' THEN 1.0 ELSE -1.0 END::DOUBLE AS g FROM {out}_1),
{out}_3 AS (SELECT *, CASE WHEN now_ THEN c1 ELSE {ticked(f"coalesce(({price})::DOUBLE, (100 - g * ({pct})) / 100 * c1)", "g < 0")} END AS lv FROM {out}_2),
{out}_4 AS (SELECT rid, any_value(lv) AS {p}_d, CASE WHEN count(*) < 2 THEN NULL WHEN bool_and(now_) THEN any_value(_a) ELSE min(bt) FILTER (bi > 1 AND g * CASE WHEN {cc} THEN bc WHEN g > 0 THEN bl ELSE bh END <= g * lv) END AS {p}_dt FROM {out}_3 GROUP BY rid),
{out} AS MATERIALIZED (SELECT s.*, r.* EXCLUDE (rid) FROM {src} s LEFT JOIN {out}_4 r USING (rid))"""


def first_of(a: str, b: str, yes: str, no: str) -> str:
    """yes if a comes first, no if b does, else null."""
    return f"CASE WHEN {a} IS NOT NULL AND ({b} IS NULL OR {a} < {b}) THEN {yes} WHEN {b} IS NOT NULL AND ({a} IS NULL OR {b} < {a}) THEN {no} END"


def b120(out: str, src: str, intra: str = "0", ut_intra: str = "0", target: str = "NULL") -> str:
    """The legs' stops (ce_, pe_), the leg stopped first and the other followed (ut_), and total and exit_t, of rows with a pick p."""
    one = lambda yes, no: first_of("ce_t", "pe_t", yes, no)
    ttc = "CASE WHEN ut_sl = 'TTC' THEN CASE WHEN c1 > ut_cost THEN ut_old ELSE ut_cost END END"
    return f"""{stop(f"{out}_a", src, "ce", "p_ce", "p_t", intra=intra)},
{stop(f"{out}_b", f"{out}_a", "pe", "p_pe", "p_t", intra=intra)},
{out}_c AS (SELECT *, {one("'ce'", "'pe'")} AS first, {one("ce_t", "pe_t")} AS at_, {one("p_pe", "p_ce")} AS ut_k, {one("p_pep", "p_cep")} AS ut_cost, {one("pe_slp", "ce_slp")} AS ut_old, {one("ce_pnl", "pe_pnl")} AS hit_pnl FROM {out}_b),
{stop(f"{out}_d", f"{out}_c", "ut", "ut_k", "at_", sl="coalesce(TRY_CAST(ut_sl AS DOUBLE), 0)", slp=ttc, intra=ut_intra, target=target, rate="0")},
{out}_e AS (SELECT *, ut_o IS NOT NULL AS on_ FROM {out}_d),
{out}_f AS (SELECT *, CASE WHEN on_ THEN 0 ELSE ce_pnl + pe_pnl END AS b_pl, CASE WHEN on_ THEN hit_pnl ELSE 0 END AS tt_pl, CASE WHEN on_ THEN ut_cost - ut_o - ut_cost * {_rules[0]} ELSE 0 END AS at_sl, CASE WHEN on_ THEN ut_pnl ELSE 0 END AS gain FROM {out}_e),
{out} AS MATERIALIZED (SELECT *, round_even(b_pl + tt_pl + at_sl + gain, 2) + 0 AS total_pnl, CASE WHEN on_ THEN ut_t WHEN ce_t = pe_t THEN ce_t END AS exit_t FROM {out}_f)"""


UT = "CASE WHEN on_ THEN ut_k END AS ut, ut_t, b_pl, tt_pl, round_even(at_sl, 2) + 0 AS ut_pl_at_sl, gain AS ut_pnl"
LEGS = "p_f AS future, p_ce AS ce, ce_t, ce_pnl, p_pe AS pe, pe_t, pe_pnl"


def chained(rows: list[tuple], schema: str, step, most: int, out: str, oms: tuple[str, ...] = ("0",), live: str = 'exit_t < "end" - 5') -> str:
    """Rounds: step(name, source) gives CTEs from rows with go; the next source is the live rows, go their exit_t."""
    text = [menu(*oms), entries(rows, schema), "r0 AS (SELECT *, start AS go FROM en)"]
    parts = []
    for n in range(most + 1):
        text.append(step(f"s{n}", f"r{n}"))
        parts.append(f"SELECT {n}::INT AS round, {keys(schema)}, {out} FROM s{n}")
        text.append(f"r{n + 1} AS (SELECT rid, {keys(schema)}, exit_t AS go FROM s{n} WHERE {live})")
    return ", " + ",\n".join(text) + "\n" + " UNION ALL ".join(parts)


def single(rows: list[tuple], schema: str, ctes: str, out: str, oms: tuple[str, ...] = ("0",), last: str = "x") -> str:
    """One trade a set: ctes from p, the entries with their pick, to `last`."""
    return f", {menu(*oms)},\n{entries(rows, schema)},\n{pick('p', 'en')},\n{ctes}\nSELECT {keys(schema)}, {out} FROM {last}"
