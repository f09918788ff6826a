"""Strategies: trade logs with a row for each session and parameter set (or each of its rounds), composed of the steps.

entries: (idx, trade_date, start, end, om, ...parameters). Sessions without a valid choice have no row. Prices of an
entry are the choice's; a stop's o is the close of the leg's first bar, or the price it was entered at. Columns ending in
pl or pnl are points a share, less slippage where the trade pays it; a column t or ending in _t is a minute of the day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelab.functions.scalars import money
from strikelab.functions.triggers import both_legs, close_at, common, decay, first, let, stop, straddle_bars, trail, trail_limited, window
from strikelab.operators import mtm
from strikelab.plans.steps import DAY, Desk, answered, ask_futures, ask_leg, ask_legs, ask_pair, enter, enter_at_target, enter_pair, rounds, scrip_of, session


def closing() -> Column:
    return F.col("method") == "CC"


def num(text: Column) -> Column:
    """The number in a parameter that may be text; 0 without one."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def optional(entries: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in entries.columns else default


def picked(rows: DataFrame, desk: Desk, **how: Column) -> DataFrame:
    """rows (entries, or a view of a stored table) with a valid choice, as pick and entry_t."""
    return enter(rows, desk, **how, kept=True).where("pick IS NOT NULL").withColumn("entry_t", F.col("pick.t"))


def pnl(c: str) -> Column:
    return F.coalesce(F.col(f"{c}.pnl"), F.lit(0.0))


def earlier(a: Column, b: Column) -> Column:
    """`ce` or `pe`: whose time a or b comes first; null if neither or both at once."""
    return F.when(a.isNotNull() & (b.isNull() | (a < b)), "ce").when(b.isNotNull() & (a.isNull() | (b < a)), "pe")


# --- separate stops, the other leg followed -----------------------------------------------------------------------------


def leg_stops(rows: DataFrame, desk: Desk, f=None, names=("ce", "pe"), start: Column | None = None, **key: Column) -> DataFrame:
    """rows with ce_r and pe_r: a stop on each leg of the pick from its minute on, or f of the leg's bars and the key."""
    usual = lambda b, k: stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, intra=k.intra, closes=k.closes, rate=desk.rate, opens=desk.opens)
    key = {"side": F.col("side"), "sl": F.col("sl"), "intra": optional(rows, "intra_sl", F.lit(0.0)), "closes": closing(), "end": F.col("end"), "start": F.col("pick.t") if start is None else start} | key
    return ask_legs(rows, desk, f or usual, {f"{k}_r": {"scrip": F.col(f"pick.{k}")} | key for k in names})


def with_first_hit(rows: DataFrame) -> DataFrame:
    """first (ce or pe, the leg stopped first), at (when), ut (the other leg), ut_cost, ut_old (its stop), tt_pnl of the leg stopped."""
    a, b = F.col("ce_r.t"), F.col("pe_r.t")
    rows = rows.withColumn("first", earlier(a, b))
    of = lambda ce, pe: F.when(F.col("first") == "ce", ce).when(F.col("first") == "pe", pe)
    return rows.withColumns({
        "at": of(a, b), "ut": of(F.col("pick.pe"), F.col("pick.ce")), "ut_cost": of(F.col("pick.pe_price"), F.col("pick.ce_price")),
        "ut_old": of(F.col("pe_r.sl_price"), F.col("ce_r.sl_price")), "tt_pnl": of(pnl("ce_r"), pnl("pe_r")), "both_t": F.when(a == b, a),
    })


def follow_key(rows: DataFrame) -> dict[str, Column]:
    return {
        "start": F.col("at"), "end": F.col("end"), "side": F.col("side"), "closes": closing(), "ttc": F.col("ut_sl") == "TTC", "sl": num(F.col("ut_sl")),
        "intra": optional(rows, "ut_intra_sl", F.lit(0.0)), "cost": F.when(F.col("ut_sl") == "TTC", F.col("ut_cost")), "old": F.when(F.col("ut_sl") == "TTC", F.col("ut_old")),
    }


def to_cost_level(b: Column, k) -> Column:
    """A stop at the leg's cost (TTC), or its old one where it stands above its cost already; null for other stops."""
    return F.when(k.ttc, F.when(first(window(b, k.start, k.end))["close"] > k.cost, k.old).otherwise(k.cost))


def follow(b: Column, k, desk: Desk) -> Column:
    return stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, intra=k.intra, sl_price=to_cost_level(b, k), closes=k.closes, opens=desk.opens)


def settled(rows: DataFrame, rate: float) -> DataFrame:
    """b_pl, tt_pl, ut_pl_at_sl, ut_pnl, total_pnl and exit_t from the legs' stops and the followed leg's, ut_r."""
    on = F.col("ut_r.o").isNotNull()
    at_sl = F.when(on, F.col("ut_cost") - F.col("ut_r.o") - F.col("ut_cost") * rate).otherwise(0.0)
    both, tt, gain = F.when(on, 0.0).otherwise(pnl("ce_r") + pnl("pe_r")), F.when(on, F.col("tt_pnl")).otherwise(0.0), F.when(on, pnl("ut_r")).otherwise(0.0)
    return rows.withColumns({"b_pl": both, "tt_pl": tt, "ut_pl_at_sl": at_sl, "ut_pnl": gain, "total_pnl": money(both + tt + at_sl + gain), "exit_t": F.when(on, F.col("ut_r.t")).otherwise(F.col("both_t"))})


def b120_legs(rows: DataFrame, desk: Desk, f=None, **more: Column) -> DataFrame:
    """The whole of one separate-stop trade for rows with a pick."""
    f = f or (lambda b, k: follow(b, k, desk))
    rows = with_first_hit(leg_stops(rows, desk))
    return settled(ask_leg(rows, desk, "ut_r", F.col("ut"), f, **follow_key(rows), **more), desk.rate)


def b120_out() -> list[Column]:
    return [F.col("pick.future").alias("future"), F.col("pick.ce").alias("ce"), F.col("ce_r.t").alias("ce_t"), F.col("ce_r.pnl").alias("ce_pnl"), F.col("pick.pe").alias("pe"), F.col("pe_r.t").alias("pe_t"), F.col("pe_r.pnl").alias("pe_pnl")]


def ut_out() -> list[Column | str]:
    return [F.when(F.col("ut_r.o").isNotNull(), F.col("ut")).alias("ut"), F.col("ut_r.t").alias("ut_t"), "b_pl", "tt_pl", money(F.col("ut_pl_at_sl")).alias("ut_pl_at_sl"), "ut_pnl"]


def b120(entries: DataFrame, desk: Desk) -> DataFrame:
    """Separate stops on call and put; after the first hit the other leg is followed with ut_sl percent, or to its cost (TTC).

    entries also has side, method (HL or CC), sl and ut_sl (text). If the followed leg already stands above its cost, its
    old stop is kept. Stops hit in the same minute, or none, leave both legs' results (b_pl).
    """
    rows = b120_legs(picked(entries, desk), desk)
    return rows.select(*entries.columns, "entry_t", *b120_out(), *ut_out(), "total_pnl")


def b120_rounds(entries: DataFrame, desk: Desk, most: int = 5) -> DataFrame:
    """b120 again from its exit, up to `most` times, if that is more than five minutes before the end; a row a round.

    With intra_sl and ut_intra_sl (the universal form) legs and followed leg have intra stops too.
    """

    def step(rows: DataFrame, n: int) -> DataFrame:
        done = b120_legs(picked(rows.select(*entries.columns, F.col("go")), desk, start=F.col("go")), desk)
        done = done.withColumns({"ce": F.col("pick.ce"), "pe": F.col("pick.pe"), "go": F.col("exit_t"), "live": F.col("exit_t") < F.col("end") - 5})
        return done.select(*entries.columns, "entry_t", "ce", "pe", "exit_t", "total_pnl", "go", "live")

    return rounds(entries.withColumn("go", F.col("start")), step, most, [*entries.columns, "entry_t", "ce", "pe", "exit_t", "total_pnl"], "b120-round")


def b120_twice(entries: DataFrame, desk: Desk) -> DataFrame:
    """Two b120 trades in two windows, added: start2, end2, sl2, ut_sl2, om2 for the second, which may have no choice."""
    one = b120_legs(picked(entries, desk), desk).select(*entries.columns, F.col("total_pnl").alias("pnl1"))
    second = entries.withColumns({"start": F.col("start2"), "end": F.col("end2"), "sl": F.col("sl2"), "ut_sl": F.col("ut_sl2"), "om": F.col("om2")})
    asked = [*DAY, "side", "method", "start2", "end2", "sl2", "ut_sl2", "om2"]
    two = b120_legs(picked(second.dropDuplicates(asked), desk), desk).select(*asked, F.col("total_pnl").alias("pnl2"))
    rows = one.join(two, asked, "left").withColumn("pnl2", F.coalesce("pnl2", F.lit(0.0)))
    return rows.select(*entries.columns, "pnl1", "pnl2", money(F.col("pnl1") + F.col("pnl2")).alias("total_pnl"))


def b120_tt(entries: DataFrame, desk: Desk) -> DataFrame:
    """b120, and on the first hit a new trade on the hit side: tt_side, tt_method, tt_sl, tt_om."""
    rows = b120_legs(picked(entries, desk), desk)
    rows = enter(rows, desk, "tt", om=F.col("tt_om"), start=F.col("at"))
    scrip = F.when(F.col("first") == "ce", F.col("tt.ce")).when(F.col("first") == "pe", F.col("tt.pe"))
    rows = ask_leg(rows, desk, "tt_r", scrip, lambda b, k: stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens), start=F.col("tt.t"), end=F.col("end"), side=F.col("tt_side"), sl=F.col("tt_sl"), closes=F.col("tt_method") == "CC")
    return rows.select(*entries.columns, "entry_t", *ut_out(), scrip.alias("tt"), F.col("tt_r.t").alias("tt_t"), pnl("tt_r").alias("tt_pnl"), money(F.col("total_pnl") + pnl("tt_r")).alias("total_pnl"))


def b120_ut_rounds(entries: DataFrame, desk: Desk, most: int = 5) -> DataFrame:
    """b120 whose followed leg has a target, ut_target percent below; each time it is met, a strike of like premium on the stopped
    side is entered, with the distance of stop and target kept and the same target. Round 0 is b120; a row a round."""

    def followed(b: Column, k) -> Column:
        now = first(window(b, k.start, k.end))["close"]
        return stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, target=now * (100 - k.goal) / 100, closes=k.closes)

    def step(rows: DataFrame, n: int) -> DataFrame:
        if n == 0:
            done = b120_legs(picked(entries, desk), desk, followed, goal=F.col("ut_target"))
            done = done.withColumns({"scrip": F.col("ut"), "leg": F.col("first"), "o": F.col("ut_r.o"), "goal": F.col("ut_r.o") * (100 - F.col("ut_target")) / 100, "far": F.col("ut_r.sl_price"), "pnl": F.col("total_pnl"), "t": F.col("entry_t"), "exit_t": F.col("ut_r.t")})
            done = done.withColumn("live", F.col("ut_r.target_hit") & (F.col("exit_t") < F.col("end") - 5))
        else:
            kept = rows.select(*entries.columns, "leg", "o", "goal", "far", F.col("exit_t").alias("go"))
            done = enter_at_target(kept, desk, "strangle", F.col("end"), pick=(F.col("go"), F.col("o"))).where("pick IS NOT NULL")
            ce = F.col("leg") == "ce"
            done = done.withColumns({"scrip": F.when(ce, F.col("pick.ce")).otherwise(F.col("pick.pe")), "t": F.col("pick.t"), "far": F.when(ce, F.col("pick.ce_price")).otherwise(F.col("pick.pe_price")) + F.col("far") - F.col("goal")})
            done = ask_leg(done, desk, "r", F.col("scrip"), lambda b, k: stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl_price=k.far, target=k.goal, closes=k.closes), start=F.col("t"), end=F.col("end"), side=F.col("side"), far=F.col("far"), goal=F.col("goal"), closes=closing())
            done = done.withColumns({"pnl": pnl("r"), "exit_t": F.col("r.t"), "live": F.col("r.target_hit") & (F.col("r.t") < F.col("end") - 5)})
        return done.select(*entries.columns, "leg", "o", "goal", "far", "scrip", "t", "exit_t", "pnl", "live")

    return rounds(entries, step, most - 1, [*entries.columns, "scrip", "t", "exit_t", "pnl"], "b120-ut")


def b120_trail_limited(entries: DataFrame, desk: Desk, most: int = 7) -> DataFrame:
    """b120, and its total with the followed leg's stop tightened 1 .. `most` times at most (sl_trail, tp_trail percent): trails."""
    rows = b120_legs(picked(entries, desk), desk)
    key = {"start": F.col("at"), "end": F.col("end"), "side": F.col("side"), "o": F.col("ut_r.o"), "sl": num(F.col("ut_sl")), "sl_step": F.col("sl_trail"), "step": F.col("tp_trail")}
    rows = ask_leg(rows, desk, "gains", F.col("ut"), lambda b, k: trail_limited(b, k.start, k.end, side=k.side, o=k.o, sl=k.sl, sl_step=k.sl_step, step=k.step, most=most), **key)
    each = lambda i: F.when(F.col("ut_r.o").isNotNull(), money(F.coalesce(F.col("tt_pl") + F.col("ut_pl_at_sl") + F.get("gains", F.lit(i)), F.col("total_pnl")))).otherwise(F.col("total_pnl"))
    return rows.select(*entries.columns, "entry_t", "ut", "total_pnl", *(each(i).alias(f"trail_{i + 1}_pnl") for i in range(most)))


def b120_trail_ratio(entries: DataFrame, desk: Desk) -> DataFrame:
    """b120 whose followed leg has a RATIO trail (ut_trail of the profit), to its cost at most with trail_upto_cost."""
    f = lambda b, k: trail(b, k.start, k.end, mode="RATIO", side=k.side, tick=desk.tick, sl=k.sl, sl_price=to_cost_level(b, k), gap=k.gap, closes=k.closes, to_cost=k.to_cost)
    rows = with_first_hit(leg_stops(picked(entries, desk), desk))
    rows = ask_leg(rows, desk, "ut_r", F.col("ut"), lambda b, k: let(f(b, k), lambda r: F.when(r["t"].isNotNull() | r["exit"].isNotNull(), r)), **follow_key(rows), gap=F.col("ut_trail"), to_cost=F.col("trail_upto_cost"))
    return settled(rows, desk.rate).select(*entries.columns, "entry_t", *b120_out(), *ut_out(), F.coalesce(F.col("ut_r.moved"), F.lit(False)).alias("ut_moved"), "total_pnl")


def b120_no_ut(entries: DataFrame, desk: Desk) -> DataFrame:
    """Both legs with a RATIO trail (trail of the profit), no leg followed."""
    f = lambda b, k: trail(b, k.start, k.end, mode="RATIO", side=k.side, tick=desk.tick, sl=k.sl, gap=k.gap, closes=k.closes, to_cost=k.to_cost, rate=desk.rate)
    rows = leg_stops(picked(entries, desk), desk, f, gap=F.col("trail"), to_cost=F.col("trail_upto_cost"))
    out = [x for k in ("ce", "pe") for x in (F.col(f"pick.{k}").alias(k), F.col(f"{k}_r.t").alias(f"{k}_t"), F.col(f"{k}_r.moved").alias(f"{k}_moved"), F.col(f"{k}_r.pnl").alias(f"{k}_pnl"))]
    return rows.select(*entries.columns, "entry_t", *out, money(pnl("ce_r") + pnl("pe_r")).alias("total_pnl"))


def b120_queue(entries: DataFrame, queue: DataFrame, desk: Desk, trim: str = "group") -> DataFrame:
    """b120 for each row of queue (idx, group_no, seq_no, start, om, sl, ut_sl), with at most `lots` live at once.

    entries: (idx, trade_date, end, side, method, lots, ...). Rows are taken in the order of the queue while fewer than lots
    are live; a row that finds no choice in its own minute takes no place. Trades that are over before the last row's
    start leave the live ones after each group (trim `group`) or each row (`row`). n, total_pnl and avg_pnl (null if none).
    The count runs through a session's queue in one fold: a queue is a short list.
    """
    keys = [c for c in entries.columns]
    rows = entries.join(queue, "idx")
    traded = enter(rows, desk, end=F.col("start")).withColumn("entry_t", F.col("pick.t"))
    traded = b120_legs(traded, desk)
    item = F.struct("group_no", "seq_no", "start", F.col("pick").isNotNull().alias("valid"), F.col("exit_t").alias("exit_t"), F.col("total_pnl").alias("pnl"))
    per = traded.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("q"))
    state = lambda live, n, total: F.struct(live.cast("array<int>").alias("live"), n.cast("int").alias("n"), total.cast("double").alias("total"))
    never = 1 << 30

    def walk(q: Column) -> Column:
        def fold(s: Column, i: Column) -> Column:
            x, after = F.get(q, i), F.get(q, i + 1)
            taken = (F.size(s["live"]) < F.col("lots")) & x["valid"]
            live = F.when(taken, F.concat(s["live"], F.array(F.coalesce(x["exit_t"], F.lit(never))))).otherwise(s["live"])
            due = F.lit(True) if trim == "row" else F.coalesce(after["group_no"] != x["group_no"], F.lit(True))
            kept = F.when(due, F.filter(live, lambda t: t >= x["start"])).otherwise(live)
            return state(kept, s["n"] + taken.cast("int"), s["total"] + F.when(taken, x["pnl"]).otherwise(0.0))

        return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), state(F.array(), F.lit(0), F.lit(0.0)), fold)

    out = per.withColumn("s", let(F.col("q"), walk))
    return out.select(*keys, F.col("s.n").alias("n"), money(F.col("s.total")).alias("total_pnl"), money(F.try_divide(F.col("s.total"), F.col("s.n"))).alias("avg_pnl"))


# --- combined stops -----------------------------------------------------------------------------------------------------


def combined(rows: DataFrame, desk: Desk, name: str = "r", pick: str = "pick", **key: Column) -> DataFrame:
    """rows with `name`: the outcome of a combined stop on the pick's straddle, and both legs' closes at its minute, ce_at and pe_at."""

    def f(a: Column, b: Column, k) -> Column:
        return let(stop(straddle_bars(a, b), k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, intra=k.intra, combined=True, rate=desk.rate, opens=desk.opens), lambda r: F.struct(r["o"].alias("o"), r["h"].alias("h"), r["l"].alias("l"), r["c"].alias("c"), r["sl_hit"].alias("sl_hit"), r["intra_hit"].alias("intra_hit"), r["t"].alias("t"), r["pnl"].alias("pnl"), close_at(a, r["t"]).alias("ce_at"), close_at(b, r["t"]).alias("pe_at")))

    key = {"side": F.col("side"), "sl": F.col("sl"), "intra": F.col("intra_sl"), "end": F.col("end"), "start": F.col(f"{pick}.t")} | key
    return ask_pair(rows, desk, name, F.col(f"{pick}.ce"), F.col(f"{pick}.pe"), f, **key)


def straddle_rounds(entries: DataFrame, desk: Desk, most: int, judged, name: str, begin: DataFrame | None = None, more: list[str] | None = None) -> DataFrame:
    """A straddle again from each stop, if that is more than five minutes before the end, up to `most` times; a row a round.

    judged: rows with a pick to rows with o, exit_t and pnl, and more. begin: rows with go, the first start; entries' own without.
    """
    keys, more = [*entries.columns], more or []

    def step(rows: DataFrame, n: int) -> DataFrame:
        done = judged(picked(rows.select(*keys, "go"), desk, start=F.col("go")))
        done = done.withColumns({"ce": F.col("pick.ce"), "pe": F.col("pick.pe"), "go": F.col("exit_t"), "live": F.col("exit_t") < F.col("end") - 5})
        return done.select(*keys, "entry_t", "ce", "pe", "o", "exit_t", "pnl", *more, "go", "live")

    return rounds(entries.withColumn("go", F.col("start")) if begin is None else begin, step, most, [*keys, "entry_t", "ce", "pe", "o", "exit_t", "pnl", *more], name)


def by_combined_stop(desk: Desk, **key: Column):
    return lambda rows: combined(rows, desk, **key).withColumns({"o": F.col("r.o"), "exit_t": F.col("r.t"), "pnl": pnl("r")})


def sre(entries: DataFrame, desk: Desk, most: int = 7) -> DataFrame:
    """A straddle with a combined stop; when it is hit, a fresh one. entries also has side, sl, intra_sl."""
    return straddle_rounds(entries, desk, most, by_combined_stop(desk), "sre")


def sre_separate(entries: DataFrame, desk: Desk, most: int = 7, more: list[str] | None = None) -> DataFrame:
    """As sre, but a stop on either leg closes both at that minute, the other at its close. entries also has side, sl. more, of
    first (the leg that is stopped), ce_stop, pe_stop (both legs' own outcomes)."""

    def f(a: Column, b: Column, k) -> Column:
        of = lambda x, y: stop(common(window(x, k.start, k.end), y), k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, rate=desk.rate, opens=desk.opens)
        both = let(F.struct(of(a, b).alias("ce"), of(b, a).alias("pe")), lambda r: F.struct(r["ce"].alias("ce"), r["pe"].alias("pe"), close_at(b, r["ce"]["t"]).alias("pe_at"), close_at(a, r["pe"]["t"]).alias("ce_at")))
        return both

    def judged(rows: DataFrame) -> DataFrame:
        rows = ask_pair(rows, desk, "r", F.col("pick.ce"), F.col("pick.pe"), f, start=F.col("pick.t"), end=F.col("end"), side=F.col("side"), sl=F.col("sl"))
        rows = rows.withColumns({"first": earlier(F.col("r.ce.t"), F.col("r.pe.t")), "ce_stop": F.col("r.ce"), "pe_stop": F.col("r.pe")})
        cost = lambda k: F.col(f"pick.{k}_price")
        other = lambda k: cost(k) - F.col(f"r.{k}_at") - cost(k) * desk.rate
        gain = F.when(F.col("first") == "ce", F.col("r.ce.pnl") + other("pe")).when(F.col("first") == "pe", F.col("r.pe.pnl") + other("ce")).otherwise(F.col("r.ce.pnl") + F.col("r.pe.pnl"))
        return rows.withColumns({"o": cost("ce") + cost("pe"), "exit_t": F.when(F.col("first") == "ce", F.col("r.ce.t")).when(F.col("first") == "pe", F.col("r.pe.t")).otherwise(F.col("r.ce.t")), "pnl": money(gain)})

    return straddle_rounds(entries, desk, most, judged, "sre-separate", more=more)


def csre(entries: DataFrame, desk: Desk, most: int = 7) -> DataFrame:
    """sre whose straddles are all held until the exit of the last one that may be entered (the end, if there are fewer), and
    priced again to it without a stop; a row a round. entries also has re_entries."""
    keys = entries.columns
    logs = straddle_rounds(entries, desk, most, by_combined_stop(desk), "csre").where(F.col("round") <= F.col("re_entries"))
    exits = logs.where((F.col("round") == F.col("re_entries")) & (F.col("pnl") != 0)).select(*keys, F.col("exit_t").alias("_x"))
    rows = logs.join(exits, keys, "left").withColumn("final_t", F.coalesce("_x", "end")).drop("_x")
    again = ask_pair(rows, desk, "a", F.col("ce"), F.col("pe"), lambda a, b, k: stop(straddle_bars(a, b), k.start, k.end, side=k.side, tick=desk.tick, combined=True, rate=desk.rate, opens=desk.opens), start=F.col("entry_t"), end=F.col("final_t"), side=F.col("side"))
    return again.select("round", *keys, "entry_t", "ce", "pe", "o", "final_t", F.when(F.col("round") < F.col("re_entries"), pnl("a")).otherwise(F.col("pnl")).alias("pnl"))


def csre_extremes(entries: DataFrame, desk: Desk, most: int = 5) -> DataFrame:
    """Straddles added at each stop, whose stops are on the highest call and the lowest put held, on the minutes that all have.

    entries also has side, method, sl, re_entries. The exit of all is the first stop after the last one allowed (or
    without a choice), else the end. Every straddle is then priced from the first entry to that exit, sold, as one row.
    """
    keys = entries.columns
    held_type = "array<struct<ce_strike:double,pe_strike:double,ce:string,pe:string,ce_price:double,pe_price:double,t:int>>"
    strike = lambda c: F.regexp_extract(c, r"^(.*)..$", 1).cast("double")
    latest = lambda best: F.array_max(F.transform(best, lambda x: F.struct(x["t"].alias("t"), x.alias("x"))))["x"]

    def judged(rows: DataFrame, n: int) -> DataFrame:
        rows = enter(rows.select(*keys, "go", "held", "minutes"), desk, start=F.col("go"))
        new = F.struct(strike(F.col("pick.ce")).alias("ce_strike"), strike(F.col("pick.pe")).alias("pe_strike"), "pick.ce", "pick.pe", "pick.ce_price", "pick.pe_price", "pick.t")
        rows = rows.withColumn("held", F.when(F.col("pick").isNotNull(), F.concat("held", F.array(new))).otherwise(F.col("held")))
        top, low = F.array_max(F.transform("held", lambda x: x["ce_strike"])), F.array_min(F.transform("held", lambda x: x["pe_strike"]))
        rows = rows.withColumn("hi", latest(F.filter("held", lambda x: x["ce_strike"] == top))).withColumn("lo", latest(F.filter("held", lambda x: x["pe_strike"] == low)))
        # The minutes that all straddles held have, no more than a session's: asked one straddle after another.
        rows = ask_pair(rows, desk, "seen", F.col("pick.ce"), F.col("pick.pe"), lambda a, b, k: F.transform(straddle_bars(window(a, k.start, k.end), b), lambda x: x["t"]), start=F.col("pick.t"), end=F.col("end"))
        rows = rows.withColumn("minutes", F.col("seen") if n == 0 else F.array_intersect("minutes", "seen"))
        f = lambda b, q: stop(F.filter(b, lambda y: F.array_contains(q.minutes, y["t"])), q.start, q.end, side=q.side, tick=desk.tick, sl=q.sl, closes=q.closes, entry=q.o)
        key = lambda k, x: {"scrip": F.col(f"{x}.{k}"), "start": F.col(f"{x}.t"), "end": F.col("end"), "side": F.col("side"), "sl": F.col("sl"), "closes": closing(), "o": F.col(f"{x}.{k}_price"), "minutes": F.col("minutes")}
        rows = ask_legs(rows, desk, f, {"ce_r": key("ce", "hi"), "pe_r": key("pe", "lo")})
        at = F.least(F.coalesce(F.col("ce_r.t"), F.col("end")), F.coalesce(F.col("pe_r.t"), F.col("end")))
        failed = F.col("pick").isNull()
        rows = rows.withColumn("live", ~failed & (F.lit(n) < F.col("re_entries")) & (at < F.col("end") - 5))
        return rows.select(*keys, F.when(failed, F.col("go")).otherwise(at).alias("go"), "held", "minutes", "live", failed.alias("failed"))

    begin = entries.withColumn("go", F.col("start")).withColumn("held", F.array().cast(held_type)).withColumn("minutes", F.lit(None).cast("array<int>"))
    all_rounds = rounds(begin, judged, most, [*keys, "go", "held", "live", "failed"], "csre-extremes")
    over = all_rounds.where(~F.col("live") & (F.size("held") > 0)).withColumnRenamed("go", "exit_t")
    trades = over.select(*keys, "exit_t", (~F.col("failed") & (F.col("exit_t") != F.col("end"))).alias("sl_hit"), F.get("held", F.lit(0))["t"].alias("entry_t"), F.posexplode("held").alias("round", "x"))
    priced = ask_pair(trades, desk, "r", F.col("x.ce"), F.col("x.pe"), lambda a, b, k: stop(straddle_bars(a, b), k.start, k.end, side=F.lit("SELL"), tick=desk.tick, combined=True, rate=desk.rate, opens=desk.opens), start=F.col("entry_t"), end=F.col("exit_t"))
    return priced.select("round", *keys, F.col("x.t").alias("entry_t"), F.col("x.ce").alias("ce"), F.col("x.pe").alias("pe"), (F.col("x.ce_price") + F.col("x.pe_price")).alias("o"), "sl_hit", "exit_t", pnl("r").alias("pnl"))


def untouched(pick: str = "pick", r: str = "r") -> tuple[Column, Column]:
    """The side that rose less from the entry to the stop, and the one that rose more; null if they rose alike."""
    rise = lambda k: (F.col(f"{r}.{k}_at") - F.col(f"{pick}.{k}_price")) / F.col(f"{pick}.{k}_price")
    less = F.when(rise("ce") > rise("pe"), "pe").when(rise("ce") < rise("pe"), "ce")
    return less, F.when(less == "pe", "ce").when(less == "ce", "pe")


def with_ut(rows: DataFrame, desk: Desk, pick: str = "pick", r: str = "r") -> DataFrame:
    """rows with ut, ut_scrip, ut_r: after a combined stop more than five minutes before the end, a single leg by ut_om of the side
    that rose less (ut_side SELL) or more (BUY), with its own stop."""
    less, more = untouched(pick, r)
    due = F.col(f"{r}.t") < F.col("end") - 5
    rows = rows.withColumn("ut", F.when(due, F.when(F.col("ut_side") == "SELL", less).otherwise(more)))
    rows = enter(rows, desk, "up", om=F.col("ut_om"), start=F.when(F.col("ut").isNotNull(), F.col(f"{r}.t")))
    rows = rows.withColumn("ut_scrip", F.when(F.col("ut") == "ce", F.col("up.ce")).when(F.col("ut") == "pe", F.col("up.pe")))
    return ask_leg(rows, desk, "ut_r", F.col("ut_scrip"), lambda b, k: stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens), start=F.col("up.t"), end=F.col("end"), side=F.col("ut_side"), sl=F.col("ut_sl"), closes=F.col("ut_method") == "CC")


def sut_out() -> list[Column | str]:
    return ["entry_t", F.col("pick.ce").alias("ce"), F.col("pick.pe").alias("pe"), F.col("r.o").alias("o"), F.col("r.t").alias("std_t"), pnl("r").alias("std_pnl"), "ut_scrip", F.col("up.t").alias("ut_entry_t"), F.col("ut_r.t").alias("ut_t"), pnl("ut_r").alias("ut_pnl")]


def sut(entries: DataFrame, desk: Desk) -> DataFrame:
    """A combined stop, then one leg. entries also has side, sl, intra_sl, ut_side, ut_method, ut_sl, ut_om."""
    rows = with_ut(combined(picked(entries, desk), desk), desk)
    return rows.select(*entries.columns, *sut_out(), money(pnl("r") + pnl("ut_r")).alias("total_pnl"))


def sut_tt(entries: DataFrame, desk: Desk) -> DataFrame:
    """sut with a trade on the other side too (tt_side, tt_method, tt_sl, tt_om), both entered at the first minute that has both choices."""
    rows = combined(picked(entries, desk), desk)
    less, more = untouched()
    due = F.col("r.t") < F.col("end") - 5
    rows = rows.withColumn("ut", F.when(due, F.when(F.col("ut_side") == "SELL", less).otherwise(more))).withColumn("tt", F.when(due, F.when(F.col("tt_side") == "SELL", more).otherwise(less)))
    rows = enter_pair(rows, desk, "m", F.col("ut_om"), F.col("tt_om"), F.when(F.col("ut").isNotNull(), F.col("r.t")), F.col("end"))
    for k, x in (("ut", "a"), ("tt", "b")):
        rows = rows.withColumn(f"{k}_scrip", F.when(F.col(k) == "ce", F.col(f"m.{x}.ce")).when(F.col(k) == "pe", F.col(f"m.{x}.pe")))
    key = lambda k: {"scrip": F.col(f"{k}_scrip"), "start": F.col("m.t"), "end": F.col("end"), "side": F.col(f"{k}_side"), "sl": F.col(f"{k}_sl"), "closes": F.col(f"{k}_method") == "CC"}
    rows = ask_legs(rows, desk, lambda b, q: stop(b, q.start, q.end, side=q.side, tick=desk.tick, sl=q.sl, closes=q.closes, rate=desk.rate, opens=desk.opens), {f"{k}_r": key(k) for k in ("ut", "tt")})
    out = [x for k in ("ut", "tt") for x in (f"{k}_scrip", F.col(f"{k}_r.t").alias(f"{k}_t"), pnl(f"{k}_r").alias(f"{k}_pnl"))]
    return rows.select(*entries.columns, "entry_t", F.col("r.t").alias("std_t"), pnl("r").alias("std_pnl"), F.col("m.t").alias("both_t"), *out, money(pnl("r") + pnl("ut_r") + pnl("tt_r")).alias("total_pnl"))


def sut_sre(entries: DataFrame, desk: Desk, most: int = 7) -> tuple[DataFrame, DataFrame]:
    """sut, and sre from the single leg's exit with sre_side, sre_sl, sre_intra_sl, sre_om: the trades, and a row a straddle."""
    first_part = sut(entries, desk)
    begin = first_part.where(F.col("ut_t") < F.col("end") - 5).select(*entries.columns, F.col("ut_t").alias("go"))
    return first_part, _sre_after(entries, desk, begin, most)


def _sre_after(entries: DataFrame, desk: Desk, begin: DataFrame, most: int) -> DataFrame:
    judged = by_combined_stop(desk, side=F.col("sre_side"), sl=F.col("sre_sl"), intra=F.col("sre_intra_sl"))
    keys = entries.columns

    def step(rows: DataFrame, n: int) -> DataFrame:
        done = judged(picked(rows.select(*keys, "go"), desk, start=F.col("go"), om=F.col("sre_om")))
        return done.select(*keys, "entry_t", F.col("pick.ce").alias("ce"), F.col("pick.pe").alias("pe"), "o", "exit_t", "pnl", F.col("exit_t").alias("go"), (F.col("exit_t") < F.col("end") - 5).alias("live"))

    return rounds(begin, step, most - 1, [*keys, "entry_t", "ce", "pe", "o", "exit_t", "pnl"], "sre-after")


def s2ut(entries: DataFrame, desk: Desk) -> DataFrame:
    """A straddle with a combined stop, a second one from its stop, then one leg as in sut."""
    rows = combined(picked(entries, desk), desk, "r1")
    rows = enter(rows, desk, "pick2", start=F.when(F.col("r1.t") < F.col("end") - 5, F.col("r1.t")))
    rows = with_ut(combined(rows, desk, "r2", "pick2"), desk, "pick2", "r2")
    return rows.select(*entries.columns, "entry_t", F.col("r1.t").alias("std1_t"), pnl("r1").alias("std1_pnl"), F.col("pick2.t").alias("entry2_t"), F.col("r2.t").alias("std2_t"), pnl("r2").alias("std2_pnl"), "ut_scrip", F.col("ut_r.t").alias("ut_t"), pnl("ut_r").alias("ut_pnl"), money(pnl("r1") + pnl("r2") + pnl("ut_r")).alias("total_pnl"))


def itarget(entries: DataFrame, desk: Desk) -> DataFrame:
    """The straddle's legs moved apart by a percentage of the future to the nearest gap, with a combined stop. entries has side, sl, intra_sl, target_percent."""
    rows = picked(entries, desk)
    wing = F.rint(F.col("pick.future") * F.col("target_percent") / 100 / desk.gap) * desk.gap
    strike = lambda k: F.regexp_extract(F.col(f"pick.{k}"), r"^(.*)..$", 1).cast("double")
    rows = rows.withColumn("wide", F.struct(F.col("pick.t").alias("t"), scrip_of(strike("ce") + wing, "CE").alias("ce"), scrip_of(strike("pe") - wing, "PE").alias("pe")))
    rows = combined(rows, desk, "r", "wide")
    return rows.select(*entries.columns, "entry_t", F.col("wide.ce").alias("ce"), F.col("wide.pe").alias("pe"), F.col("r.o").alias("o"), F.col("r.t").alias("exit_t"), pnl("r").alias("total_pnl"))


def starget(entries: DataFrame, desk: Desk) -> DataFrame:
    """Strikes whose premium is nearest to half of future * nv * target_percent / 10000, with a combined stop. entries has side, sl, intra_sl, target_percent, nv."""
    rows = ask_futures(entries, desk, "future", lambda f, k: first(f)["close"])
    rows = rows.withColumn("target", money(F.col("future") * F.col("nv") * F.col("target_percent") / 10000 / 2))
    rows = enter_at_target(rows, desk, "closest", F.col("end"), pick=(F.col("start"), F.col("target"))).where("pick IS NOT NULL")
    rows = combined(rows, desk)
    return rows.select(*entries.columns, F.col("pick.t").alias("entry_t"), "target", F.col("pick.ce").alias("ce"), F.col("pick.pe").alias("pe"), F.col("r.o").alias("o"), F.col("r.t").alias("exit_t"), pnl("r").alias("total_pnl"))


# --- wait for decay -----------------------------------------------------------------------------------------------------


def wait_and_stop(b: Column, k, desk: Desk, *, percent: Column | None = None, price: Column | None = None, start: Column | None = None, goal: Column | None = None, wait_side: Column | None = None) -> Column:
    """A struct (d, r): a decay, then a stop from its minute on, entered at the decay's price (HL) or the close (CC).

    goal: a target so many percent further on.
    """

    def stopped(d: Column) -> Column:
        target = None if goal is None else d["price"] * (1 - F.when(k.side == "SELL", 1.0).otherwise(-1.0) * goal / 100)
        r = stop(b, d["t"], k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens, entry=F.when(~k.closes, d["price"]), target=target)
        return F.struct(d.alias("d"), r.alias("r"))

    return let(decay(b, k.start if start is None else start, k.end, side=k.side if wait_side is None else wait_side, tick=desk.tick, percent=percent, price=price, closes=k.closes), stopped)


def decay_legs(rows: DataFrame, desk: Desk, f=None, **key: Column) -> DataFrame:
    f = f or (lambda b, k: wait_and_stop(b, k, desk, percent=k.decay))
    return leg_stops(rows, desk, f, decay=F.col("decay"), **key)


def decay_out(k: str) -> list[Column]:
    return [F.col(f"pick.{k}").alias(k), F.col(f"{k}_r.d.t").alias(f"{k}_entry_t"), F.col(f"{k}_r.d.price").alias(f"{k}_entry"), F.col(f"{k}_r.r.t").alias(f"{k}_t"), pnl(f"{k}_r.r").alias(f"{k}_pnl")]


def dt(entries: DataFrame, desk: Desk) -> DataFrame:
    """Wait for each leg's decay, then enter it with a stop. entries also has side, method, decay, sl."""
    rows = decay_legs(picked(entries, desk), desk)
    return rows.select(*entries.columns, "entry_t", F.col("pick.future").alias("future"), *decay_out("ce"), *decay_out("pe"), money(pnl("ce_r.r") + pnl("pe_r.r")).alias("total_pnl"))


def dt_first(entries: DataFrame, desk: Desk) -> DataFrame:
    """dt of which only the leg that decays first counts; both if they decay at once."""
    rows = decay_legs(picked(entries, desk), desk).withColumn("first", earlier(F.col("ce_r.d.t"), F.col("pe_r.d.t")))
    total = F.when(F.col("first") == "ce", pnl("ce_r.r")).when(F.col("first") == "pe", pnl("pe_r.r")).otherwise(pnl("ce_r.r") + pnl("pe_r.r"))
    return rows.select(*entries.columns, "entry_t", "first", *decay_out("ce"), *decay_out("pe"), money(total).alias("total_pnl"))


def first_signal(rows: DataFrame) -> DataFrame:
    """fs (its decay and stop) and other (the other leg's scrip) of the leg that decays first; null if none or both at once."""
    rows = rows.withColumn("first", earlier(F.col("ce_r.d.t"), F.col("pe_r.d.t")))
    of = lambda ce, pe: F.when(F.col("first") == "ce", F.col(ce)).when(F.col("first") == "pe", F.col(pe))
    return rows.withColumn("fs", of("ce_r.r", "pe_r.r")).withColumn("signal_t", of("ce_r.d.t", "pe_r.d.t")).withColumn("other", of("pick.pe", "pick.ce"))


def dt_first_ut(entries: DataFrame, desk: Desk) -> DataFrame:
    """The leg that decays first with a stop fsl; after it, more than five minutes before the end, the other leg with a stop ssl."""
    rows = first_signal(decay_legs(picked(entries, desk), desk, sl=F.col("fsl")))
    due = F.when(F.col("fs.t") < F.col("end") - 5, F.col("fs.t"))
    rows = ask_leg(rows, desk, "ut_r", F.col("other"), lambda b, k: stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens), start=due, end=F.col("end"), side=F.col("side"), sl=F.col("ssl"), closes=closing())
    return rows.select(*entries.columns, "entry_t", "first", "signal_t", F.col("fs.t").alias("fs_t"), pnl("fs").alias("fs_pnl"), "other", F.col("ut_r.t").alias("ut_t"), pnl("ut_r").alias("ut_pnl"), money(pnl("fs") + pnl("ut_r")).alias("total_pnl"))


def dt_first_sre(entries: DataFrame, desk: Desk, most: int = 7) -> tuple[DataFrame, DataFrame]:
    """The leg that decays first (stop dt_sl, choice dt_om), then sre from its stop: the trades, and a row a straddle."""
    rows = first_signal(decay_legs(picked(entries, desk, om=F.col("dt_om")), desk, sl=F.col("dt_sl")))
    trades = rows.select(*entries.columns, "entry_t", "first", "signal_t", F.col("fs.t").alias("fs_t"), pnl("fs").alias("fs_pnl"))
    return trades, _sre_after(entries, desk, trades.where(F.col("fs_t") < F.col("end") - 5).select(*entries.columns, F.col("fs_t").alias("go")), most)


def dt_first_sut(entries: DataFrame, desk: Desk) -> DataFrame:
    """The leg that decays first (stop dt_sl, choice dt_om), then sut from its stop with sut_sl, sut_intra_sl, sut_om, ut_sl and ut_om."""
    rows = first_signal(decay_legs(picked(entries, desk, om=F.col("dt_om")), desk, sl=F.col("dt_sl")))
    rows = rows.select(*entries.columns, "signal_t", "fs", "first")
    rows = enter(rows, desk, "pick", om=F.col("sut_om"), start=F.when(F.col("fs.t") < F.col("end") - 5, F.col("fs.t")))
    rows = combined(rows, desk, sl=F.col("sut_sl"), intra=F.col("sut_intra_sl"))
    rows = with_ut(rows.withColumns({"ut_side": F.col("side"), "ut_method": F.col("method")}), desk)
    return rows.select(*entries.columns, "first", "signal_t", pnl("fs").alias("fs_pnl"), F.col("pick.t").alias("std_entry_t"), F.col("r.t").alias("std_t"), pnl("r").alias("std_pnl"), "ut_scrip", pnl("ut_r").alias("ut_pnl"), money(pnl("fs") + pnl("r") + pnl("ut_r")).alias("total_pnl"))


def dt_trail(entries: DataFrame, desk: Desk) -> DataFrame:
    """dt whose stop trails in steps (trail_profit, trail_sl percent); both 0: a plain stop."""

    def f(b: Column, k) -> Column:
        def stopped(d: Column) -> Column:
            o = F.when(~k.closes, d["price"])
            plain = stop(b, d["t"], k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens, entry=o)
            stepped = trail(b, d["t"], k.end, mode="STEP", side=k.side, tick=desk.tick, sl=k.sl, step=k.step, sl_step=k.sl_step, closes=k.closes, rate=desk.rate, entry=o)
            of = lambda r, moved: F.struct(r["t"].alias("t"), r["pnl"].alias("pnl"), moved.alias("moved"))
            return F.struct(d.alias("d"), F.when((k.step == 0) & (k.sl_step == 0), let(plain, lambda r: of(r, F.lit(False)))).otherwise(let(stepped, lambda r: of(r, r["moved"]))).alias("r"))

        return let(decay(b, k.start, k.end, side=k.side, tick=desk.tick, percent=k.decay, closes=k.closes), stopped)

    rows = decay_legs(picked(entries, desk), desk, f, step=F.col("trail_profit"), sl_step=F.col("trail_sl"))
    return rows.select(*entries.columns, "entry_t", *decay_out("ce"), *decay_out("pe"), money(pnl("ce_r.r") + pnl("pe_r.r")).alias("total_pnl"))


def dtn(entries: DataFrame, desk: Desk) -> DataFrame:
    """dt with a target (percent of the entry); when it is met, the leg is entered once more on the return to its first entry price."""

    def f(b: Column, k) -> Column:
        other = F.when(k.side == "SELL", "BUY").otherwise("SELL")

        def again(x: Column) -> Column:
            goal = x["d"]["price"] * (1 - F.when(k.side == "SELL", 1.0).otherwise(-1.0) * k.goal / 100)

            def stopped(d: Column) -> Column:
                return F.struct(x["d"].alias("d"), x["r"].alias("r"), d.alias("d2"), stop(b, d["t"], k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens, entry=F.when(~k.closes, x["d"]["price"]), target=goal).alias("r2"))

            return let(decay(b, F.when(x["r"]["target_hit"], x["r"]["t"]), k.end, side=other, tick=desk.tick, price=x["d"]["price"], closes=k.closes), stopped)

        return let(wait_and_stop(b, k, desk, percent=k.decay, goal=k.goal), again)

    rows = decay_legs(picked(entries, desk), desk, f, goal=F.col("target"))
    more = [x for k in ("ce", "pe") for x in (F.col(f"{k}_r.r.target_hit").alias(f"{k}_target"), F.col(f"{k}_r.d2.t").alias(f"{k}_re_t"), pnl(f"{k}_r.r2").alias(f"{k}_re_pnl"))]
    return rows.select(*entries.columns, "entry_t", *decay_out("ce"), *decay_out("pe"), *more, money(pnl("ce_r.r") + pnl("ce_r.r2") + pnl("pe_r.r") + pnl("pe_r.r2")).alias("total_pnl"))


# --- rounds of single legs ----------------------------------------------------------------------------------------------

LEG = ["leg", "scrip", "entry_t", "o", "exit_t", "pnl"]


def per_leg(rows: DataFrame) -> DataFrame:
    """A row for each leg of the pick: leg (ce or pe), scrip, cost, t."""
    leg = F.explode(F.array(*(F.struct(F.lit(k).alias("leg"), F.col(f"pick.{k}").alias("scrip"), F.col(f"pick.{k}_price").alias("cost")) for k in ("ce", "pe"))))
    return rows.withColumn("_l", leg).select(*(c for c in rows.columns if c != "pick"), "_l.*", F.col("pick.t").alias("t"))


def leg_of(pick: str, what: str = "") -> Column:
    return F.when(F.col("leg") == "ce", F.col(f"{pick}.ce{what}")).otherwise(F.col(f"{pick}.pe{what}"))


def leg_key(**more: Column) -> dict[str, Column]:
    return {"end": F.col("end"), "side": F.col("side"), "closes": closing()} | more


def nre(entries: DataFrame, desk: Desk, most: int = 7) -> DataFrame:
    """Each leg on its own: after a stop wait for the return to the entry price and enter the same strike again, up to `most` times.

    entries also has side, method, sl, re_sl. One row for each leg and round that was entered. All rounds of a leg work on
    the one array of its bars, so they are one fold and one question.
    """

    def f(b: Column, k) -> Column:
        log = lambda n, t, r: F.struct(n.cast("int").alias("round"), t.cast("int").alias("entry_t"), r["o"].alias("o"), r["t"].cast("int").alias("exit_t"), r["pnl"].alias("pnl"))
        state = lambda done, out: F.struct(done.alias("done"), out.cast("int").alias("out"))
        begin = let(stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens), lambda r: state(F.array(log(F.lit(0), k.start, r)), r["t"]))

        def fold(s: Column, n: Column) -> Column:
            def entered(d: Column) -> Column:
                r = stop(b, d["t"], k.end, side=k.side, tick=desk.tick, sl=k.re_sl, closes=k.closes, rate=desk.rate, opens=desk.opens, entry=F.when(~k.closes, k.cost))
                return let(r, lambda r: state(F.when(d["hit"], F.concat(s["done"], F.array(log(n, d["t"], r)))).otherwise(s["done"]), r["t"]))

            return let(decay(b, s["out"], k.end, side=k.side, tick=desk.tick, price=k.cost, closes=k.closes), entered)

        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), begin, fold)["done"]

    rows = per_leg(picked(entries, desk))
    rows = ask_leg(rows, desk, "x", F.col("scrip"), f, **leg_key(start=F.col("t"), sl=F.col("sl"), re_sl=F.col("re_sl"), cost=F.col("cost")))
    return rows.select(*entries.columns, "leg", "scrip", F.explode_outer("x").alias("x")).select(*entries.columns, "leg", "scrip", "x.*")


def leg_rounds(entries: DataFrame, desk: Desk, first_round, again, most: int, name: str) -> DataFrame:
    """Rounds of single legs; first_round and again: rows to rows with scrip, cost, entry_t, o, exit_t, pnl, live and what they carry (far)."""
    keys = entries.columns
    carry = ["leg", "scrip", "cost", "far", "cost0", "entry_t", "o", "exit_t", "pnl", "live"]

    def step(rows: DataFrame, n: int) -> DataFrame:
        done = first_round(per_leg(picked(entries, desk)).withColumn("cost0", F.col("cost"))) if n == 0 else again(rows)
        return done.select(*keys, *(c if c in done.columns else F.lit(None).cast("double").alias(c) for c in carry))

    return rounds(entries, step, most, [*keys, *LEG], name)


def plain_first(desk: Desk):
    """The first round: a stop sl on each leg."""

    def run(rows: DataFrame) -> DataFrame:
        rows = ask_leg(rows, desk, "r", F.col("scrip"), lambda b, k: stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens), **leg_key(start=F.col("t"), sl=F.col("sl")))
        return rows.withColumns({"entry_t": F.col("t"), "o": F.col("r.o"), "exit_t": F.col("r.t"), "pnl": pnl("r"), "live": F.col("r.t").isNotNull()})

    return run


def nre_cc(entries: DataFrame, desk: Desk, most: int = 7, till: bool = False, trailed: str | None = None) -> DataFrame:
    """As nre, but a leg that already stands below its cost at the stop is replaced by a new strike of like premium at once.

    till: no re-entry from the minute till_time on. trailed: the P&L of a re-entry is that of a RATIO trail (trail,
    trail_upto_cost), while its time is that of the plain stop (`plain`) or of the trail (`trail`).
    """

    def again(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("was_t", F.col("exit_t"))
        rows = ask_leg(rows, desk, "at", F.col("scrip"), lambda b, k: F.struct(close_at(b, k.start).alias("close"), decay(b, k.start, k.end, side=k.side, tick=desk.tick, price=k.cost, closes=k.closes).alias("d")), **leg_key(start=F.col("was_t"), cost=F.col("cost")))
        stays = F.col("cost") <= F.col("at.close")
        rows = enter_at_target(rows.withColumn("stays", stays), desk, "strangle", F.col("end"), new=(F.when(~stays, F.col("was_t")), F.col("cost")))
        rows = rows.withColumns({"scrip": F.when(F.col("stays"), F.col("scrip")).otherwise(leg_of("new")), "cost": F.when(F.col("stays"), F.col("cost")).otherwise(leg_of("new", "_price")), "t": F.when(F.col("stays"), F.col("at.d.t")).otherwise(F.col("new.t"))})
        rows = rows.where("t IS NOT NULL AND scrip IS NOT NULL")
        plain = lambda b, k: stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens, entry=F.when(~k.closes, k.cost))
        key = leg_key(start=F.col("t"), sl=F.col("re_sl"), cost=F.col("cost"))
        if trailed:
            by = lambda b, k: trail(b, k.start, k.end, mode="RATIO", side=k.side, tick=desk.tick, sl=k.sl, gap=k.gap, closes=k.closes, to_cost=k.to_cost, rate=desk.rate, entry=F.when(~k.closes, k.cost))
            f = lambda b, k: let(F.struct(plain(b, k).alias("p"), by(b, k).alias("q")), lambda x: F.struct(x["p"]["o"].alias("o"), (x["p"] if trailed == "plain" else x["q"])["t"].alias("t"), x["q"]["pnl"].alias("pnl")))
            rows = ask_leg(rows, desk, "r", F.col("scrip"), f, **key, gap=F.col("trail"), to_cost=F.col("trail_upto_cost"))
        else:
            rows = ask_leg(rows, desk, "r", F.col("scrip"), plain, **key)
        return timed(rows.withColumns({"entry_t": F.col("t"), "o": F.col("r.o"), "exit_t": F.col("r.t"), "pnl": pnl("r"), "live": F.col("r.t").isNotNull()}))

    def timed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("live", F.col("live") & (F.col("exit_t") < F.col("till_time"))) if till else rows

    return leg_rounds(entries, desk, lambda rows: timed(plain_first(desk)(rows)), again, most, "nre-cc")


def nre_decay(entries: DataFrame, desk: Desk, most: int = 7) -> DataFrame:
    """Each leg with a RATIO trail (ratio); after its stop the strike with the nearest premium above the stop, once that has decayed to
    the first entry price. entries also has side, method, sl, ratio."""
    by = lambda b, k, start, o=None: trail(b, start, k.end, mode="RATIO", side=k.side, tick=desk.tick, sl=k.sl, gap=k.gap, closes=k.closes, rate=desk.rate, entry=o)
    done = lambda rows: rows.withColumns({"o": F.col("r.o"), "exit_t": F.col("r.t"), "pnl": pnl("r"), "live": F.col("r.t").isNotNull()})

    def first_round(rows: DataFrame) -> DataFrame:
        rows = ask_leg(rows, desk, "r", F.col("scrip"), lambda b, k: by(b, k, k.start), **leg_key(start=F.col("t"), sl=F.col("sl"), gap=F.col("ratio")))
        return done(rows.withColumns({"entry_t": F.col("t"), "far": F.col("r.stop")}))

    def again(rows: DataFrame) -> DataFrame:
        rows = enter_at_target(rows.withColumn("was_t", F.col("exit_t")), desk, "above", F.col("end"), new=(F.col("was_t"), F.col("far"))).where("new IS NOT NULL")
        rows = rows.withColumn("scrip", leg_of("new"))
        f = lambda b, k: let(decay(b, k.start, k.end, side=k.side, tick=desk.tick, price=k.cost, closes=k.closes), lambda d: F.struct(d.alias("d"), by(b, k, d["t"], F.when(~k.closes, k.cost)).alias("r")))
        rows = ask_leg(rows, desk, "x", F.col("scrip"), f, **leg_key(start=F.col("new.t"), sl=F.col("sl"), gap=F.col("ratio"), cost=F.col("cost0"))).where("x.d.hit")
        return done(rows.withColumns({"entry_t": F.col("x.d.t"), "r": F.col("x.r")}))

    return leg_rounds(entries, desk, first_round, again, most, "nre-decay")


def red(entries: DataFrame, desk: Desk, most: int = 7) -> DataFrame:
    """After a leg's stop a new strike by om, entered once it has decayed, with a stop; up to `most` times. entries has side, method, decay, sl."""

    def again(rows: DataFrame) -> DataFrame:
        rows = enter(rows.withColumn("was_t", F.col("exit_t")), desk, "new", start=F.col("was_t")).where("new IS NOT NULL").withColumn("scrip", leg_of("new"))
        rows = ask_leg(rows, desk, "x", F.col("scrip"), lambda b, k: wait_and_stop(b, k, desk, percent=k.decay), **leg_key(start=F.col("new.t"), sl=F.col("sl"), decay=F.col("decay"))).where("x.d.hit")
        return rows.withColumns({"entry_t": F.col("x.d.t"), "o": F.col("x.r.o"), "exit_t": F.col("x.r.t"), "pnl": pnl("x.r"), "live": F.col("x.r.t").isNotNull()})

    return leg_rounds(entries, desk, plain_first(desk), again, most, "red")


def dt_rounds(entries: DataFrame, desk: Desk, most: int = 7) -> DataFrame:
    """dt of each leg with a target (re_decay percent); when it is met, a new strike by om is entered after its decay, up to `most` times."""

    def one(rows: DataFrame, start: Column) -> DataFrame:
        rows = ask_leg(rows, desk, "x", F.col("scrip"), lambda b, k: wait_and_stop(b, k, desk, percent=k.decay, goal=k.goal), **leg_key(start=start, sl=F.col("sl"), decay=F.col("decay"), goal=F.col("re_decay"))).where("x.d.hit")
        return rows.withColumns({"entry_t": F.col("x.d.t"), "o": F.col("x.r.o"), "exit_t": F.col("x.r.t"), "pnl": pnl("x.r"), "live": F.coalesce(F.col("x.r.target_hit"), F.lit(False))})

    def again(rows: DataFrame) -> DataFrame:
        rows = enter(rows.withColumn("was_t", F.col("exit_t")), desk, "new", start=F.col("was_t")).where("new IS NOT NULL").withColumn("scrip", leg_of("new"))
        return one(rows, F.col("new.t"))

    return leg_rounds(entries, desk, lambda rows: one(rows, F.col("t")), again, most, "dt-rounds")


def sbs(entries: DataFrame, desk: Desk) -> DataFrame:
    """Each leg sold; after its stop a leg by om bought (buy_flag), after that one's stop sold again (sell2_flag).

    Each may trail in steps (sell_trail and sell_sl_trail, buy_trail and buy_sl_trail; sl trail 0: plain). With
    sell_track_original or buy_track_original the next entry waits for the untrailed stop. One row a leg and round.
    """

    def traded(rows: DataFrame, kind: str, start: Column, track: Column) -> DataFrame:
        side = F.lit("SELL" if kind == "sell" else "BUY")

        def f(b: Column, k) -> Column:
            plain = stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens)
            stepped = trail(b, k.start, k.end, mode="STEP", side=k.side, tick=desk.tick, sl=k.sl, step=k.step, sl_step=k.sl_step, closes=k.closes, rate=desk.rate)

            def out(x: Column) -> Column:
                on = k.sl_step != 0
                t = F.when(on, x["q"]["t"]).otherwise(x["p"]["t"])
                return F.struct(x["p"]["o"].alias("o"), t.alias("t"), F.when(k.track, x["p"]["t"]).otherwise(t).alias("next"), F.when(on, x["q"]["pnl"]).otherwise(x["p"]["pnl"]).alias("pnl"))

            return let(F.struct(plain.alias("p"), stepped.alias("q")), out)

        rows = ask_leg(rows, desk, "r", F.col("scrip"), f, **leg_key(side=side, start=start, sl=F.col(f"{kind}_sl"), step=F.col(f"{kind}_trail"), sl_step=F.col(f"{kind}_sl_trail"), track=track))
        return rows.withColumns({"entry_t": start, "o": F.col("r.o"), "exit_t": F.col("r.t"), "far": F.col("r.next").cast("double"), "pnl": pnl("r")})

    def again(rows: DataFrame) -> DataFrame:
        rows = enter(rows.withColumn("was_t", F.col("far").cast("int")), desk, "new", start=F.col("was_t")).where("new IS NOT NULL").withColumn("scrip", leg_of("new"))
        bought = rows.select("*").where("NOT coalesce(cost0 < 0, false)")
        sold = rows.where("coalesce(cost0 < 0, false)")
        one = traded(bought, "buy", F.col("new.t"), F.col("buy_track_original")).withColumn("cost0", F.lit(-1.0)).withColumn("live", F.col("far").isNotNull() & F.col("sell2_flag"))
        two = traded(sold, "sell", F.col("new.t"), F.lit(False)).withColumn("live", F.lit(False))
        return one.unionByName(two)

    first_round = lambda rows: traded(rows, "sell", F.col("t"), F.col("sell_track_original")).withColumn("live", F.col("far").isNotNull() & F.col("buy_flag"))
    return leg_rounds(entries, desk, first_round, again, 2, "sbs")


# --- breakouts, spreads, hedges -----------------------------------------------------------------------------------------


def option_breakout(entries: DataFrame, desk: Desk) -> DataFrame:
    """The low (SELL) or high (BUY) of each leg's first `minutes` is the price to enter at; then a stop. entries has side, method, minutes, sl."""

    def f(b: Column, k) -> Column:
        head = window(b, k.start, k.start + k.minutes)
        edge = F.when(k.side == "SELL", F.array_min(F.transform(head, lambda x: x["low"]))).otherwise(F.array_max(F.transform(head, lambda x: x["high"])))
        return wait_and_stop(b, k, desk, price=edge, start=k.start + k.minutes)

    rows = leg_stops(picked(entries, desk), desk, f, minutes=F.col("minutes"))
    return rows.select(*entries.columns, "entry_t", *decay_out("ce"), *decay_out("pe"), money(pnl("ce_r.r") + pnl("pe_r.r")).alias("total_pnl"))


def future_breakout(entries: DataFrame, desk: Desk) -> DataFrame:
    """The futures' range of the first `minutes`; when it is left downwards sell the call and buy the put, upwards the other way, each
    with a stop. Sessions that never leave it, or both ways in one minute, have no row. entries has method, minutes, sl."""

    def f(b: Column, k) -> Column:
        head = window(b, k.start, k.start + k.minutes)
        edges = F.struct(F.array_min(F.transform(head, lambda x: x["low"])).alias("low"), F.array_max(F.transform(head, lambda x: x["high"])).alias("high"))
        left = lambda side, price: decay(b, k.start + k.minutes, F.lit(24 * 60 * 40), side=F.lit(side), price=price, closes=k.closes)["t"]
        return let(edges, lambda e: F.struct(e["low"].alias("low"), e["high"].alias("high"), left("SELL", e["low"]).alias("down"), left("BUY", e["high"]).alias("up")))

    rows = ask_futures(entries, desk, "b", f, start=F.col("start"), minutes=F.col("minutes"), closes=closing())
    rows = rows.withColumn("way", earlier(F.col("b.down"), F.col("b.up"))).where("way IS NOT NULL")
    rows = rows.withColumn("break_t", F.least("b.down", "b.up"))
    rows = picked(rows, desk, start=F.col("break_t"))
    down = F.col("way") == "ce"
    rows = rows.withColumn("sold", F.when(down, F.col("pick.ce")).otherwise(F.col("pick.pe"))).withColumn("bought", F.when(down, F.col("pick.pe")).otherwise(F.col("pick.ce")))
    key = lambda name, side: {"scrip": F.col(name)} | leg_key(side=F.lit(side), start=F.col("pick.t"), sl=F.col("sl"))
    rows = ask_legs(rows, desk, lambda b, k: stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens), {"sold_r": key("sold", "SELL"), "bought_r": key("bought", "BUY")})
    out = [x for k in ("sold", "bought") for x in (k, F.col(f"{k}_r.t").alias(f"{k}_t"), pnl(f"{k}_r").alias(f"{k}_pnl"))]
    return rows.select(*entries.columns, F.when(down, "down").otherwise("up").alias("way"), "break_t", "entry_t", *out, money(pnl("sold_r") + pnl("bought_r")).alias("total_pnl"))


def ironfly(entries: DataFrame, desk: Desk, wings: float = 0.9) -> DataFrame:
    """Sell a straddle (sell_om) and buy wings (buy_om) in the first minute that has both; a stop (sl percent) on the net premium's close.

    Only the minutes that all four legs have count, from the last search's start on; wings that cost `wings` of the body
    or more: no row.
    """
    rows = enter_pair(entries, desk, "m", F.col("sell_om"), F.col("buy_om"), F.col("start"), F.col("end")).where("m IS NOT NULL")
    rows = rows.withColumn("from_t", F.coalesce(F.col("m.before") + 1, F.col("start")))

    def part(x: str) -> DataFrame:
        f = lambda a, b, k: straddle_bars(window(a, k.start, k.end), b)
        return ask_pair(rows, desk, x, F.col(f"m.{x}.ce"), F.col(f"m.{x}.pe"), f, start=F.col("from_t"), end=F.col("end"))

    rows = part("a")
    rows = part("b")
    rate = desk.rate

    def net(body: Column, wing: Column) -> Column:
        def judged(x: Column) -> Column:
            o, w = first(x)["body"], first(x)["wing"]
            level = (o - w) * (1 + F.col("sl") / 100)
            end = F.try_element_at(x, F.lit(-1))
            hit = first(F.filter(x, lambda y: y["body"] - y["wing"] >= level))
            price = F.coalesce(hit["body"] - hit["wing"], end["body"] - end["wing"])
            return F.struct(first(x)["t"].alias("entry_t"), o.alias("body"), w.alias("wing"), hit["t"].alias("exit_t"), money((o - w) - price - (o + w) * rate).alias("pnl"))

        return let(both_legs(body, wing, lambda p, q: F.struct(p["t"].alias("t"), p["close"].alias("body"), q["close"].alias("wing"))), judged)

    rows = rows.withColumn("r", net(F.col("a"), F.col("b"))).where(F.col("r.body") * wings > F.col("r.wing"))
    return rows.select(*entries.columns, "r.entry_t", F.col("m.a.ce").alias("sell_ce"), F.col("m.a.pe").alias("sell_pe"), F.col("m.b.ce").alias("buy_ce"), F.col("m.b.pe").alias("buy_pe"), "r.body", "r.wing", "r.exit_t", F.col("r.pnl").alias("total_pnl"))


def hedged(entries: DataFrame, desk: Desk, most: int = 7) -> DataFrame:
    """Sell a straddle to the end; buy each cheap hedge (menu om `hedge_om`, pairs of legs valid in the straddle's minute) once it has
    risen by hedge_decay percent, with a stop hedge_sl, and again at that price after each stop, up to `most` times.

    One row for the straddle (leg std, round 0) and one for each hedge entered. entries also has method, hedge_om, hedge_sl, hedge_decay.
    """
    keys = entries.columns
    rows = enter_pair(entries, desk, "m", F.lit("0"), F.col("hedge_om"), F.col("start"), F.col("end")).where("m IS NOT NULL")
    rows = ask_pair(rows, desk, "std", F.col("m.a.ce"), F.col("m.a.pe"), lambda a, b, k: stop(straddle_bars(a, b), k.start, k.end, side=F.lit("SELL"), tick=desk.tick, combined=True, rate=desk.rate, opens=desk.opens), start=F.col("m.t"), end=F.col("end"))

    def f(b: Column, k) -> Column:
        state = lambda done, out: F.struct(done.alias("done"), out.cast("int").alias("out"))
        log = lambda n, d, r: F.struct(n.cast("int").alias("round"), d["t"].cast("int").alias("entry_t"), r["o"].alias("o"), r["t"].cast("int").alias("exit_t"), r["pnl"].alias("pnl"))
        none = F.array().cast("array<struct<round:int,entry_t:int,o:double,exit_t:int,pnl:double>>")

        def fold(s: Column, n: Column) -> Column:
            entered = lambda d: let(stop(b, d["t"], k.end, side=F.lit("BUY"), tick=desk.tick, sl=k.sl, closes=k.closes, rate=desk.rate, opens=desk.opens, entry=F.when(~k.closes, k.goal)), lambda r: state(F.when(d["hit"], F.concat(s["done"], F.array(log(n, d, r)))).otherwise(s["done"]), r["t"]))
            return let(decay(b, s["out"], k.end, side=F.lit("BUY"), tick=desk.tick, price=k.goal, closes=k.closes), entered)

        return F.aggregate(F.sequence(F.lit(0), F.lit(most)), state(none, k.start), fold)["done"]

    out = [rows.select(*keys, F.lit("std").alias("leg"), F.concat_ws(",", "m.a.ce", "m.a.pe").alias("scrip"), F.lit(0).alias("round"), F.col("m.t").alias("entry_t"), F.col("std.o").alias("o"), F.lit(None).cast("int").alias("exit_t"), pnl("std").alias("pnl"))]
    for k in ("ce", "pe"):
        goal = F.col(f"m.b.{k}_price") * (100 + F.col("hedge_decay")) / 100
        one = ask_leg(rows, desk, "x", F.col(f"m.b.{k}"), f, start=F.col("m.t"), end=F.col("end"), sl=F.col("hedge_sl"), closes=closing(), goal=goal)
        out.append(one.select(*keys, F.lit(k).alias("leg"), F.col(f"m.b.{k}").alias("scrip"), F.explode("x").alias("x")).select(*keys, "leg", "scrip", "x.*"))
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- modifiers ----------------------------------------------------------------------------------------------------------


def gated(entries: DataFrame, desk: Desk) -> DataFrame:
    """entries whose start is the first minute, from start to five minutes before the end, at which the straddle's premium is at or
    under its LOW, HIGH or AVG (std_indicator) of the buffer_minute before, times 1 + indicator_buffer; others go.

    A look at a minute may find the next one's straddle, so in the average a premium counts for its own minute, and for the
    one before if that has none. The asked start is kept as from_t.
    """

    def answer(q: DataFrame) -> DataFrame:
        low = F.greatest(F.lit(desk.first), F.col("start") - F.col("minutes"))
        premium = F.transform("picks", lambda p, i: F.struct(p["t"].alias("t"), (p["ce_price"] + p["pe_price"]).alias("v"), F.get("picks", i - 1)["t"].alias("was")))
        near = F.filter(premium, lambda x: (x["t"] >= low) & (x["t"] <= F.col("start")))
        count = lambda x: (x["t"] < F.col("start")).cast("int") + ((x["t"] - 1 >= low) & F.coalesce(x["was"] != x["t"] - 1, F.lit(True))).cast("int")
        total = lambda of: F.aggregate(near, F.lit(0.0), lambda a, x: a + of(x))
        values = F.transform(near, lambda x: x["v"])
        extreme = F.when(F.col("kind") == "LOW", F.array_min(values)).when(F.col("kind") == "HIGH", F.array_max(values)).otherwise(F.try_divide(total(lambda x: x["v"] * count(x)), total(lambda x: count(x).cast("double"))))
        q = q.join(desk.menus.where("om = '0'").select(*DAY, "picks"), DAY).select("_key", "start", "end", "picks", (extreme * (1 + F.col("buffer"))).alias("level"))
        hit = first(F.filter("picks", lambda p: (p["t"] >= F.col("start")) & (p["t"] <= F.col("end") - 4) & F.coalesce(p["ce_price"] + p["pe_price"] <= F.col("level"), F.lit(False))))
        return q.select("_key", hit["t"].alias("_at"))

    key = session(start=F.col("start"), end=F.col("end"), kind=F.upper("std_indicator"), buffer=F.col("indicator_buffer"), minutes=F.col("buffer_minute"))
    rows = answered(entries, key, answer, "_at").where("_at IS NOT NULL")
    return rows.withColumn("from_t", F.col("start")).withColumn("start", F.col("_at")).drop("_at")


def b120_series(rows: DataFrame, desk: Desk, times_ut: float = 1.0) -> DataFrame:
    """rows (with a pick) and exit_t, std and ut: the minute series of the two legs and of the followed one, each an array of series.

    The leg that is followed counts for itself up to the minute before its following begins, and is held from there.
    """

    def both(f, opens=desk.opens):
        def run(b: Column, k) -> Column:
            return let(f(b, k), lambda r: F.struct(*(r[c].alias(c) for c in ("o", "t", "pnl", "sl_price")), mtm.series(b, k.start, k.end, r, k.side, k.rate).alias("points")))

        return run

    plain = lambda b, k: stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl=k.sl, intra=k.intra, closes=k.closes, rate=desk.rate, opens=desk.opens)
    rows = with_first_hit(leg_stops(rows, desk, both(plain), rate=F.lit(desk.rate)))
    rows = ask_leg(rows, desk, "ut_r", F.col("ut"), both(lambda b, k: follow(b, k, desk)), **follow_key(rows), rate=F.lit(0.0))
    on = F.col("ut_r.o").isNotNull()
    began = F.get("ut_r.points", F.lit(0))["t"]
    cut_ = lambda k, first_leg: F.when(on & (F.col("first") == first_leg), F.filter(F.col(f"{k}_r.points"), lambda p: p["t"] <= began - 1)).otherwise(F.col(f"{k}_r.points"))
    scaled = F.transform("ut_r.points", lambda p: F.struct(p["t"].alias("t"), (p["mtm"] * times_ut).alias("mtm")))
    none = F.array().cast("array<struct<t:int,mtm:double>>")
    return rows.withColumns({"std": F.array(cut_("ce", "pe"), cut_("pe", "ce")), "ut_points": F.when(on, scaled).otherwise(none), "exit_t": F.when(on, F.col("ut_r.t")).otherwise(F.col("both_t"))})


def b120_double_ut(entries: DataFrame, desk: Desk, most: int = 5) -> DataFrame:
    """b120 again from its exit, with the followed leg's profit doubled; a row a round with its profit at the end."""
    keys = entries.columns

    def step(rows: DataFrame, n: int) -> DataFrame:
        done = b120_series(picked(rows.select(*keys, "go"), desk, start=F.col("go")), desk, 2.0)
        end = lambda points: F.coalesce(F.try_element_at(points, F.lit(-1))["mtm"], F.lit(0.0))
        total = money(end(F.col("std")[0]) + end(F.col("std")[1]) + end(F.col("ut_points")))
        return done.select(*keys, "entry_t", F.col("pick.ce").alias("ce"), F.col("pick.pe").alias("pe"), "exit_t", total.alias("total_pnl"), F.col("exit_t").alias("go"), (F.col("exit_t") < F.col("end") - 5).alias("live"))

    return rounds(entries.withColumn("go", F.col("start")), step, most, [*keys, "entry_t", "ce", "pe", "exit_t", "total_pnl"], "b120-double")
