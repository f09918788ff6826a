"""What a strategy's parameter sets must keep: a table of rules by the strategy's code, applied as column expressions.

Times are minutes of the day. A rule takes the table of sets and gives it back, with values changed or rows left out; the
rules of a code are applied in order, and equal sets are one in the end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[DataFrame], DataFrame]


def upper(*names: str) -> Rule:
    """Texts in capitals; numbers become their text."""
    return lambda df: df.withColumns({n: F.upper(F.col(n).cast("string")) for n in names})


def of(text: str) -> Callable[[], Column]:
    """A value that is an SQL expression, made when the rule is applied."""
    return lambda: F.expr(text)


def put(where: str, **values: object) -> Rule:
    """Values (or SQL expressions, by `of`) where a condition holds, in the column's own type; columns that are missing stay so."""

    def run(df: DataFrame) -> DataFrame:
        types = dict(df.dtypes)
        new = lambda v, n: (v() if callable(v) else F.lit(v)).cast(types[n])
        return df.withColumns({n: F.when(F.expr(where), new(v, n)).otherwise(F.col(n)) for n, v in values.items() if n in types})

    return run


def keep(where: str) -> Rule:
    return lambda df: df.where(where)


def plus(name: str, base: str) -> Rule:
    """A value like `sl+5` is so much more than base; others are numbers."""

    def run(df: DataFrame) -> DataFrame:
        if name not in df.columns:
            return df
        text = F.col(name).cast("string")
        return df.withColumn(name, F.when(F.contains(text, F.lit("+")), F.col(base).cast("double") + F.element_at(F.split(text, r"\+"), -1).cast("double")).otherwise(text.cast("double")))

    return run


def wider(name: str, base: str, strict: bool = True) -> list[Rule]:
    """A second stop that is on must lie beyond the first (strict), or not before it; `sl+N` is worked out."""
    return [plus(name, base), keep(f"coalesce(NOT ({name} <> 0 AND {name} {'<=' if strict else '<'} try_cast({base} AS DOUBLE)), true)")]


def ladder(n: str = "") -> list[Rule]:
    """Entry no later than the last trade, and that more than five minutes before the exit."""
    return [keep(f"entry_time{n} <= last_trade_time{n}"), keep(f"last_trade_time{n} < exit_time{n} - 5")]


def least_where(where: str, name: str) -> Rule:
    """The table's least value of a column where a condition holds; one number, joined to every row."""

    def run(df: DataFrame) -> DataFrame:
        low = df.agg(F.min(name).alias("_low"))
        return df.crossJoin(low).withColumn(name, F.when(F.expr(where), F.col("_low")).otherwise(F.col(name))).drop("_low")

    return run


_PLAIN = put("sl = 0", method="HL")
_SIDE = upper("orderside", "method")
_FOLLOWED = [put("sl = 0", ut_sl=0, method="HL"), upper("ut_sl"), _SIDE]
_SINGLE = [*wider("intra_sl", "sl", strict=False), put("sl = 0 AND intra_sl = 0", ut_sl=0), upper("orderside", "ut_orderside", "ut_method")]
_RANGE = [*wider("intra_sl", "sl"), upper("fixed_or_dynamic", "normal_or_cut", "orderside")]
_TILL = keep("entry_time <= till_time")
_TWO = [keep("exit_time <= entry_time2"), keep("entry_time2 < exit_time2 - 5")]
_RUNGS = "floor((last_trade_time{0} - entry_time{0}) / CAST(regexp_extract(trade_interval{0}, '[0-9]+', 0) AS INT))"
_NO_SELL = put("sell_sl = 0", method="HL", sell_trail=0, sell_sl_trail=0, sell_track_original=True, buy_flag=False, buy_sl=0, buy_trail=0, buy_sl_trail=0, buy_track_original=False, sell2_flag=False)

#: The rules of a family, by its code without _SI and _PSL.
FAMILIES: dict[str, list[Rule]] = {
    **dict.fromkeys(("B120", "B120_TTC_RE", "B120W", "B120M", "B120_RE", "B120W_RE", "B120_DUT_RE"), _FOLLOWED),
    **dict.fromkeys(("B120_RE_UT", "B120_UT_TRAIL"), [put("sl = 0", ut_sl=0, method="HL"), _SIDE]),
    "B120_UNIVERSAL": [
        *wider("intra_sl", "sl"), *wider("ut_intra_sl", "ut_sl"), put("sl = 0", intra_sl=0, ut_sl=0, ut_intra_sl=0, method="HL"), put("try_cast(ut_sl AS DOUBLE) = 0", ut_intra_sl=0), put("method = 'HL'", intra_sl=0, ut_intra_sl=0), upper("ut_sl"), put("ut_sl = 'TTC'", ut_intra_sl=0), _SIDE,
    ],
    "B120G": [*_TWO, put("sl = 0", ut_sl=0), put("sl2 = 0", ut_sl2=0), put("sl = 0 OR sl2 = 0", method="HL"), upper("ut_sl", "ut_sl2"), _SIDE],
    **dict.fromkeys(("DT", "DT_RE", "DTN", "DTB_RE", "DTW", "DT_FS", "B120_NO_UT_TRAIL", "NRE_DT", "RED", "REDW", "OPTIONS_RANGE_BREAKOUT"), [_PLAIN, _SIDE]),
    "DT_TRAIL": [_PLAIN, _SIDE, keep("trail_profit >= trail_sl"), put("sl = 0", trail_profit=0, trail_sl=0), put("trail_sl = 0", trail_profit=0), put("trail_profit = 0", trail_sl=of("sl"))],
    "DT_FS_SRE": [put("dt_sl = 0", method="HL"), _SIDE, *wider("sre_intra_sl", "sre_sl")],
    "DT_FS_SUT": [put("dt_sl = 0", method="HL"), _SIDE, *wider("sut_intra_sl", "sut_sl", strict=False)],
    "DT_FS_UT": [put("fsl = 0 AND ssl = 0", method="HL"), _SIDE],
    "FUTURE_RANGE_BREAKOUT": [_PLAIN, upper("method")],
    **dict.fromkeys(("NRE", "NREW", "NRE_CC", "NREW_CC", "NRE_CC_TRAIL"), [put("sl = 0", method="HL", re_sl=0), plus("re_sl", "sl"), _SIDE]),
    "NRE_CC_RE_TillTime": [put("sl = 0", method="HL", re_sl=0), plus("re_sl", "sl"), _SIDE, _TILL],
    "SBS": [
        _NO_SELL, keep("sell_trail = sell_sl_trail"), put("sell_trail = 0", sell_sl_trail=of("sell_sl")), keep("buy_trail = buy_sl_trail"), put("buy_trail = 0", buy_sl_trail=of("buy_sl")),
        put("NOT buy_flag", buy_sl=0, buy_sl_trail=0, buy_trail=0, buy_track_original=False, sell2_flag=False), put("buy_sl = 0", buy_trail=0, buy_sl_trail=0, buy_track_original=True, sell2_flag=False), upper("method"),
    ],
    **dict.fromkeys(("SRE", "SREW", "CSRE"), [*wider("intra_sl", "sl"), upper("orderside")]),
    **dict.fromkeys(("SRE_SEPARATE_LEG_SL", "SREW_SEPARATE_LEG_SL", "SRE_PREMIUM_SHIFT", "SRE_PREMIUM_SHIFT_TRAIL", "SRE_PREMIUM_SHIFT_ACTION"), [upper("orderside")]),
    "CSRE_HCLP": [_SIDE],
    **dict.fromkeys(("SREW_RANGE", "SREW_RANGE_TRAIL", "SREW_RANGE_STR_TO_STD"), _RANGE),
    **dict.fromkeys(("SUT", "SUTW", "S2UT"), _SINGLE),
    **dict.fromkeys(("STARGET", "ITARGET"), [*wider("intra_sl", "sl", strict=False), upper("orderside")]),
    "SUT_TT": [*_SINGLE, upper("tt_orderside"), put("true", tt_method=of("upper(ut_method)"))],
    "SUT_SRE": [*wider("intra_sl", "sl", strict=False), *wider("sre_intra_sl", "sre_sl", strict=False), put("sl = 0 AND intra_sl = 0", ut_sl=0), put("try_cast(ut_sl AS DOUBLE) = 0", sre_sl=0, sre_intra_sl=0), upper("orderside", "ut_orderside", "ut_method")],
    "SRE_PS_W_Straddle": [_SIDE, keep("movement1 >= 50"), keep("movement2 >= 100")],
    "IRONFLY": [keep("sl <> 0")],
    "StraddleSELL_LaterHedgeBRE": [upper("method")],
    "MAC": [keep("short_period < long_period"), upper("orderside", "short_type", "long_type")],
}
#: The rules of a family's portfolio stop where they are others, after those of the ladder.
_LADDERED: dict[str, list[Rule]] = {
    "B120_UT_TRAIL": _FOLLOWED,
    "B120G": [*FAMILIES["B120G"], *ladder("2"), keep(f"{_RUNGS.format('')} = {_RUNGS.format('2')}"), upper("trade_interval2")],
    **dict.fromkeys(("NRE", "NREW", "NRE_CC", "NRE_DT"), [_PLAIN, plus("re_sl", "sl"), _SIDE]),
    "NRE_CC_RE_TillTime": [_PLAIN, plus("re_sl", "sl"), _SIDE, _TILL],
    "RED": [_PLAIN, least_where("re_entries = 0", "decay"), _SIDE],
    "SBS": [
        put("sell_sl = 0", method="HL"), put("sell_sl = 0 AND sell_trail = 0", buy_sl=0, buy_trail=0, buy_sl_trail=0), put("sell_sl = 0", sell_sl_trail=0), put("buy_sl = 0", buy_sl_trail=0), put("sell_trail = 0", sell_sl_trail=0), put("buy_trail = 0", buy_sl_trail=0),
        put("NOT buy_flag", buy_sl=0, buy_sl_trail=0, buy_trail=0, sell2_flag=False), upper("method"),
    ],
    **dict.fromkeys(("SRE", "SREW"), [*wider("intra_sl", "sl", strict=False), upper("orderside")]),
    "SUT_TT": [*_SINGLE, upper("tt_orderside", "tt_method")],
}
#: Families whose portfolio stop has one entry, not a ladder.
_ONE_ENTRY = ("SRE_PREMIUM_SHIFT", "SRE_PREMIUM_SHIFT_TRAIL", "SRE_PREMIUM_SHIFT_ACTION", "SRE_PS_W_Straddle")


def rules_of(code: str) -> list[Rule]:
    """All rules of a code, as NRE_SI_PSL; an unknown code is an error."""
    psl, family = code.endswith("_PSL"), code.removesuffix("_PSL")
    gate, family = family.endswith("_SI"), family.removesuffix("_SI")
    if family not in FAMILIES:
        raise ValueError(f"no rules for {code}")
    own = _LADDERED.get(family, FAMILIES[family]) if psl else FAMILIES[family]
    rungs = [*ladder(), upper("trade_interval")] if psl and family not in _ONE_ENTRY else []
    return [keep("entry_time < exit_time - 5"), *rungs, *own, *([upper("std_indicator")] if gate else [])]


def ruled(sets: DataFrame, code: str) -> DataFrame:
    """The sets that a strategy is run with: its rules kept, equal ones once."""
    return reduce(lambda df, rule: rule(df), rules_of(code), sets).distinct()
