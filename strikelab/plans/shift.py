"""Premium shift: when one leg reaches `movement` percent of the pair's premium, the other is closed and rolled to a richer strike.

One loop with switches: when it ends (ending), how what is left is closed (closing_by), a combined target that trails, and
a limit on rolls. Rounds are stored tables; a round asks the pair of legs, then the chain for a strike by its premium.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelab.functions.scalars import money
from strikelab.functions.triggers import close_at, close_before, common, first, let, stop, straddle_bars, window
from strikelab.plans.lineage import cut
from strikelab.plans.steps import Desk, ask_leg, ask_legs, ask_pair, enter, enter_at_target, rounds, scrip_of
from strikelab.plans.strategies import closing, earlier, picked

STATE = ["ce", "ce_price", "ce_t", "pe", "pe_price", "pe_t", "premium", "shifted", "exit_t", "check", "move", "rolls", "ce_x", "pe_x", "gone", "live"]

#: The legs closed on the way: scrip, start, until.
GONE = "array<struct<scrip:string,start:int,until:int>>"


def _strike(scrip: Column) -> Column:
    return F.regexp_extract(scrip, r"^(.*)..$", 1).cast("double")


def shift(entries: DataFrame, desk: Desk, *, ending: str = "premium", closing_by: str = "close", trailed: bool = False, limited: bool = False, most: int = 20) -> DataFrame:
    """held, and what is left closed by one rule; see there."""
    return closed(held(entries, desk, ending=ending, separate=closing_by == "separate", trailed=trailed, limited=limited, most=most), entries.columns, desk, closing_by)


def held(entries: DataFrame, desk: Desk, *, ending: str = "premium", separate: bool = False, trailed: bool = False, limited: bool = False, most: int = 20) -> DataFrame:
    """The rolls of each session and set, and what is held when they end: a stored table for `closed`, whose rows have, per session and set: rolls, gone (the legs closed on the way), shifted_pnl (of these), ce, pe (held at the end; null if closed), exit_t,
    ce_pnl, pe_pnl, total_pnl. entries also has side, method, divider (percent of the premium added to the closed leg's
    price as the target of the new one) and movement.

    ending: `none`; `premium`, if the strikes have crossed by more than the premium; `straddle`, where a roll that would
    reach or pass the other strike makes a straddle there; `nstraddle`, where one that passes it makes a new straddle by
    the market; `meet`, where one that reaches or passes it closes both (check says so). A straddle then has a stop at movement percent on each leg. The rules of `closed`, closing_by: `close`, each leg at its own
    minute's close; `price`, stops at their level; `both`, the first stop closes both; `ut`, only the leg that was not
    stopped first counts, from that stop on; `separate` (with ending premium): a roll that would end it is not made, and
    each leg closes at its own stop. trailed: the divider is half the premium, and a combined close `trail` percent under the
    premium (less what the strikes have crossed) ends it. limited: `action` rolls at most.
    """
    keys = entries.columns
    rate = desk.rate

    def begin() -> DataFrame:
        rows = picked(entries, desk)
        null_t, null_s = F.lit(None).cast("int"), F.lit(None).cast("boolean")
        return rows.select(
            *keys, F.col("pick.ce").alias("ce"), F.col("pick.ce_price").alias("ce_price"), F.col("pick.t").alias("ce_t"), F.col("pick.pe").alias("pe"), F.col("pick.pe_price").alias("pe_price"), F.col("pick.t").alias("pe_t"),
            (F.col("pick.ce_price") + F.col("pick.pe_price")).alias("premium"), F.lit(0.0).alias("shifted"), null_t.alias("exit_t"), F.coalesce(null_s, F.lit(False)).alias("check"), F.lit(None).cast("double").alias("move"),
            F.lit(0).alias("rolls"), null_t.alias("ce_x"), null_t.alias("pe_x"), F.array().cast(GONE).alias("gone"), F.lit(True).alias("live"),
        )

    def asked(a: Column, b: Column, k) -> Column:
        of = lambda x, y: stop(common(window(x, k.start, k.end), y), k.start, k.end, side=k.side, tick=desk.tick, sl_price=k.move, closes=k.closes)["t"]
        goal = stop(straddle_bars(a, b), k.start, k.end, side=k.side, tick=desk.tick, target=k.goal, combined=True)["t"] if trailed else F.lit(None).cast("int")

        def prices(x: Column) -> Column:
            at = F.least(x["ce"], x["pe"])
            return F.struct(x["ce"].alias("ce"), x["pe"].alias("pe"), x["goal"].alias("goal"), at.alias("at"), close_at(a, at).alias("ce_at"), close_at(b, at).alias("pe_at"))

        return let(F.struct(of(a, b).alias("ce"), of(b, a).alias("pe"), goal.alias("goal")), prices)

    def step(rows: DataFrame, n: int) -> DataFrame:
        rows = (begin() if n == 0 else rows).withColumn("move", F.col("premium") * F.col("movement") / 100)
        divider = F.col("premium") / 2 if trailed else F.col("premium") * F.col("divider") / 100
        goal = (F.col("premium") - F.greatest(F.lit(0.0), _strike(F.col("pe")) - _strike(F.col("ce")))) * (100 - F.col("trail")) / 100 if trailed else F.lit(None).cast("double")
        rows = ask_pair(rows, desk, "x", F.col("ce"), F.col("pe"), asked, start=F.greatest("ce_t", "pe_t"), end=F.col("end"), side=F.col("side"), closes=closing(), move=F.col("move"), goal=goal)
        target_first = F.coalesce(F.col("x.goal") < F.coalesce(F.col("x.at"), F.col("end") + 10), F.lit(False))
        way = F.when(target_first, "end").otherwise(F.coalesce(earlier(F.col("x.ce"), F.col("x.pe")), F.when(F.col("x.ce") == F.col("x.pe"), "both"), F.lit("end")))
        # `ce` reached first: the put is rolled, and the other way round.
        rows = rows.withColumn("way", way).withColumn("divider_price", divider).withColumn("at", F.when(F.col("way") != "end", F.col("x.at")))
        roll = lambda k: F.col("way").isin("both", "pe" if k == "ce" else "ce")
        new = {f"new_{k}": (F.when(roll(k), F.col("at")), F.when(roll(k), F.col(f"x.{k}_at") + F.col("divider_price"))) for k in ("pe", "ce")}
        rows = enter_at_target(rows, desk, "above", F.col("end"), **new)
        if ending in ("straddle", "nstraddle"):
            rows = cut(enter(rows, desk, "atm", om=F.lit("0"), start=F.col("at")), "shift-atm")
            for k, o in (("pe", "ce"), ("ce", "pe")):
                rows = rows.withColumn(f"same_{k}", scrip_of(_strike(F.col(o)), k.upper()))
                rows = ask_leg(rows, desk, f"same_{k}_bar", F.col(f"same_{k}"), lambda b, q: first(F.filter(b, lambda y: y["t"] >= q.start)), start=F.when(roll(k), F.col("at")))
        gain = lambda k: money(F.col(f"{k}_price") - F.col(f"x.{k}_at") - F.col(f"{k}_price") * rate)
        return settle_round(rows, gain)

    def settle_round(rows: DataFrame, gain) -> DataFrame:
        """What each way of ending a round leaves, as one struct: the state's columns."""
        c = F.col
        none_s, none_p = F.lit(None).cast("string"), F.lit(None).cast("double")
        no = F.lit(False)
        full = (c("rolls") == c("action")) if limited else no

        def closed_(*legs: str) -> Column:
            new = F.array(*(F.struct(c(k).alias("scrip"), c(f"{k}_t").alias("start"), c("at").alias("until")) for k in legs))
            return F.concat("gone", new.cast(GONE))

        def state(**over) -> Column:
            base = {s: c(s) for s in STATE} | {"live": no} | over
            types = dict(rows.dtypes)
            return F.struct(*(base[s].cast(types[s]).alias(s) for s in STATE))

        def rolled(k: str) -> Column:
            """One leg, k, is rolled at `at`."""
            o = "pe" if k == "ce" else "ce"
            off = closed_(k)
            new, gone = c(f"new_{k}"), {k: none_s, f"{k}_price": none_p, "exit_t": c("at"), "gone": off}
            shifted = c("shifted") + gain(k)
            premium = c("premium") - c(f"x.{k}_at") + new[f"{k}_price"]
            ce = new["ce"] if k == "ce" else c("ce")
            pe = new["pe"] if k == "pe" else c("pe")
            crossed = _strike(pe) - _strike(ce)
            held = {k: new[k], f"{k}_price": new[f"{k}_price"], f"{k}_t": new["t"], "premium": premium, "shifted": shifted, "rolls": c("rolls") + 1, "gone": off}
            going = state(**held, live=F.lit(True))
            if separate:
                stay = state(check=F.lit(True), ce_x=c("x.ce"), pe_x=c("x.pe"))
                return F.when(new.isNull() | (crossed > premium), stay).otherwise(going)
            ended = state(**gone, shifted=shifted)
            out = F.when(full | new.isNull(), ended)
            if ending == "premium":
                out = out.when(crossed > premium, state(**gone, shifted=shifted, premium=premium, rolls=c("rolls") + 1))
            elif ending == "meet":
                out = out.when(crossed >= 0, state(ce=none_s, pe=none_s, exit_t=c("at"), shifted=shifted + gain(o), gone=closed_("ce", "pe"), check=F.lit(True), rolls=c("rolls") + 1))
            elif ending == "straddle":
                bar = c(f"same_{k}_bar")
                met = {k: c(f"same_{k}"), f"{k}_price": bar["close"], f"{k}_t": bar["t"], "premium": c("premium") - c(f"x.{k}_at") + bar["close"], "shifted": shifted, "rolls": c("rolls") + 1, "gone": off}
                out = out.when((crossed >= 0) & bar.isNull(), ended).when(crossed >= 0, state(**met, check=F.lit(True)))
            elif ending == "nstraddle":
                out = out.when(crossed == 0, state(**held, check=F.lit(True))).when(crossed > 0, new_straddle(shifted + gain(o), none=state(ce=none_s, pe=none_s, shifted=shifted + gain(o), gone=closed_("ce", "pe"))))
            return out.otherwise(going)

        def new_straddle(shifted: Column, none: Column) -> Column:
            a = c("atm")
            met = {"ce": a["ce"], "pe": a["pe"], "ce_price": a["ce_price"], "pe_price": a["pe_price"], "ce_t": a["t"], "pe_t": a["t"], "shifted": shifted, "rolls": c("rolls") + 1, "gone": closed_("ce", "pe"), "premium": c("premium") - c("x.ce_at") + a["ce_price"] - c("x.pe_at") + a["pe_price"]}
            return F.when(a.isNull(), none).otherwise(state(**met, check=F.lit(True)))

        def both() -> Column:
            a, b = c("new_ce"), c("new_pe")
            shifted = c("shifted") + gain("ce") + gain("pe")
            premium = c("premium") - c("x.ce_at") + a["ce_price"] - c("x.pe_at") + b["pe_price"]
            held = {"ce": a["ce"], "ce_price": a["ce_price"], "ce_t": a["t"], "pe": b["pe"], "pe_price": b["pe_price"], "pe_t": b["t"], "premium": premium, "shifted": shifted, "rolls": c("rolls") + 1, "gone": closed_("ce", "pe")}
            ended = state(ce=none_s, pe=none_s, shifted=shifted, gone=closed_("ce", "pe"))
            crossed = _strike(b["pe"]) - _strike(a["ce"])
            out = F.when(full | a.isNull() | b.isNull(), ended)
            if ending == "premium":
                out = out.when(crossed > premium, ended)
            elif ending == "meet":
                out = out.when(crossed >= 0, state(ce=none_s, pe=none_s, exit_t=c("at"), shifted=shifted, gone=closed_("ce", "pe"), check=F.lit(True), rolls=c("rolls") + 1))
            elif ending in ("straddle", "nstraddle"):
                out = out.when(crossed == 0, state(**held, check=F.lit(True))).when(crossed > 0, new_straddle(shifted, ended))
            return out.otherwise(state(**held, live=F.lit(True)))

        at_end = state(exit_t=F.when(F.col("x.goal").isNotNull() & (F.col("way") == "end"), F.col("x.goal")).otherwise(F.col("end")))
        now = F.when(c("way") == "end", at_end).when(c("way") == "both", both()).when(c("way") == "ce", rolled("pe")).otherwise(rolled("ce"))
        return rows.select(*keys, now.alias("s")).select(*keys, "s.*")

    logs = rounds(entries, step, most, [*keys, *STATE], f"shift-{ending}")
    last = logs.where(~F.col("live") | (F.col("round") == most))
    last = last.withColumn("exit_t", F.when(F.col("live"), F.col("end")).otherwise(F.col("exit_t")))
    return cut(last, "shift-last")


def closed(rows: DataFrame, keys: list[str], desk: Desk, closing_by: str) -> DataFrame:
    """The P&L of what `held` leaves, by one of its rules. closing_by `separate` needs rows held so."""
    c, rate = F.col, desk.rate
    own = lambda k: F.when(c("check"), F.when(F.lit(closing_by == "separate"), F.coalesce(c(f"{k}_x"), c("end")))).otherwise(c("exit_t"))
    move = c("premium") * c("movement") / 100

    def f(b: Column, k) -> Column:
        r = stop(b, k.start, k.end, side=k.side, tick=desk.tick, sl_price=k.move, closes=k.closes, rate=rate, entry=k.o)
        return let(r, lambda r: F.struct(r["t"].alias("t"), r["pnl"].alias("pnl"), close_before(b, F.coalesce(k.at, r["t"], k.end)).alias("close"), F.filter(b, lambda y: F.coalesce(y["t"] >= k.start, F.lit(False))).alias("after")))

    for k in ("ce", "pe"):
        straddle = c("check") & F.lit(closing_by != "separate")
        rows = ask_leg(rows, desk, f"{k}_r", c(k), f, start=F.when(straddle, F.greatest("ce_t", "pe_t")), end=c("end"), side=c("side"), closes=closing(), move=F.when(straddle, move), o=c(f"{k}_price"), at=own(k))
    gain = lambda k, price, cost: money(cost - price - cost * rate)
    first_hit = earlier(F.coalesce(c("ce_r.t"), c("end")), F.coalesce(c("pe_r.t"), c("end")))
    rows = rows.withColumn("first", F.when(c("check"), first_hit)).withColumn("first_t", F.least(F.coalesce(c("ce_r.t"), c("end")), F.coalesce(c("pe_r.t"), c("end"))))
    out = {}
    for k, o in (("ce", "pe"), ("pe", "ce")):
        cost, after = c(f"{k}_price"), c(f"{k}_r.after")
        at_other = close_before(after, c("first_t"))
        plain = gain(k, c(f"{k}_r.close"), cost)
        if closing_by == "price":
            ended = F.when(c("exit_t") == c("end"), plain).otherwise(gain(k, c("move"), cost))
            value = F.when(c("check"), c(f"{k}_r.pnl")).otherwise(ended)
        elif closing_by == "both":
            value = F.when(c("check") & (c("first") == o), gain(k, at_other, cost)).when(c("check"), c(f"{k}_r.pnl")).otherwise(plain)
        elif closing_by == "ut":
            late = F.when(c(f"{k}_r.t").isNull(), close_before(after, c("end"))).otherwise(move)
            value = F.when(c("check") & (c("first") == o), gain(k, late, at_other)).otherwise(0.0)
        else:
            value = plain
        out[f"{k}_pnl"] = F.when(c(k).isNull(), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))
    shifted = F.lit(0.0) if closing_by == "ut" else money(c("shifted"))
    exit_t = F.when(c("check"), c("first_t") if closing_by == "both" else F.greatest(*(F.coalesce(c(f"{k}_x" if closing_by == "separate" else f"{k}_r.t"), c("end")) for k in ("ce", "pe")))).otherwise(c("exit_t"))
    rows = rows.withColumns(out).withColumn("exit_t", exit_t).withColumn("shifted_pnl", shifted)
    return rows.select(*keys, "rolls", "shifted_pnl", "ce", "pe", "exit_t", "ce_pnl", "pe_pnl", money(c("shifted_pnl") + c("ce_pnl") + c("pe_pnl")).alias("total_pnl"))


def shift_again(entries: DataFrame, desk: Desk, gap: int = 1) -> DataFrame:
    """A shift till straddle that closes both legs at the first stop, and once more `gap` minutes after its exit if more than five
    minutes are left: pnl1, pnl2, total_pnl."""
    keys = entries.columns
    one = cut(shift(entries, desk, ending="straddle", closing_by="both"), "shift-first")
    second = one.where(F.col("exit_t") + gap + 5 < F.col("end")).select(*keys, "exit_t").withColumn("_was", F.col("start")).withColumn("start", F.col("exit_t") + gap).drop("exit_t")
    two = shift(second, desk, ending="straddle", closing_by="close").select(*(k for k in keys if k != "start"), F.col("_was").alias("start"), F.col("total_pnl").alias("pnl2"))
    rows = one.join(two, keys, "left").withColumn("pnl2", F.coalesce("pnl2", F.lit(0.0)))
    return rows.select(*keys, F.col("exit_t"), F.col("total_pnl").alias("pnl1"), "pnl2", money(F.col("total_pnl") + F.col("pnl2")).alias("total_pnl"))


def shift_to_straddles(entries: DataFrame, desk: Desk, most: int = 20) -> DataFrame:
    """A shift at movement1 until the strikes meet, then straddles at movement2: each ends where a leg's stop, so many percent of its
    premium, is reached, both legs at that minute's closes, and a fresh one is entered there, up to `most` times.

    A choice whose strikes have met already starts with straddles. Legs held at the end are closed at their last close.
    Sets without a choice, or whose next straddle finds none, have no row. entries: start, end, om, side, method, divider,
    movement1, movement2.
    """
    keys, rate = entries.columns, desk.rate
    c = F.col
    first_picks = cut(picked(entries, desk).select(*keys, "entry_t", _strike(c("pick.ce")).alias("_a"), _strike(c("pick.pe")).alias("_b")), "shift-choices")
    apart = first_picks.where("_a > _b").select(*keys)
    rows = held(apart.withColumn("movement", c("movement1")), desk, ending="meet", most=most).drop("movement")
    counts = ~c("live")
    names = {k: {"scrip": F.when(counts, c(k)), "start": c(f"{k}_t"), "at": F.when(c("exit_t") == c("end"), c("end") + 10).otherwise(c("exit_t"))} for k in ("ce", "pe")}
    rows = ask_legs(rows, desk, lambda b, k: close_before(b, k.at), {f"{k}_z": key for k, key in names.items()})
    left = sum((F.when(c(f"{k}_z").isNotNull(), money(c(f"{k}_price") - c(f"{k}_z") - c(f"{k}_price") * rate)).otherwise(0.0) for k in ("ce", "pe")), F.lit(0.0))
    shifts = cut(rows.select(*keys, "rolls", money(c("shifted")).alias("shifted_pnl"), money(left).alias("left_pnl"), F.when(c("check"), c("exit_t")).alias("_go")), "shift-phase")
    begin = first_picks.where("_a <= _b").select(*keys, c("start").alias("_go")).unionByName(shifts.where("_go IS NOT NULL").select(*keys, "_go"))

    def asked(a: Column, b: Column, k) -> Column:
        of = lambda x, y: stop(common(window(x, k.start, k.end), y), k.start, k.end, side=k.side, tick=desk.tick, sl_price=k.move, closes=k.closes)["t"]
        at = lambda t: F.struct(t.alias("t"), F.coalesce(close_at(a, t), close_before(a, k.end + 10)).alias("ce"), F.coalesce(close_at(b, t), close_before(b, k.end + 10)).alias("pe"))
        return let(F.least(of(a, b), of(b, a)), at)

    def step(rows: DataFrame, n: int) -> DataFrame:
        rows = enter(rows.select(*keys, "_go"), desk, start=c("_go"), om=F.lit("0"), kept=True)
        move = (c("pick.ce_price") + c("pick.pe_price")) * c("movement2") / 100
        rows = ask_pair(rows, desk, "x", c("pick.ce"), c("pick.pe"), asked, start=c("pick.t"), end=c("end"), side=c("side"), closes=closing(), move=move)
        gain = lambda k: money(c(f"pick.{k}_price") - c(f"x.{k}") - c(f"pick.{k}_price") * rate)
        return rows.select(*keys, c("pick").isNull().alias("failed"), (gain("ce") + gain("pe")).alias("pnl"), c("x.t").alias("_go"), c("x.t").isNotNull().alias("live"))

    logs = rounds(begin, step, most, [*keys, "failed", "pnl"], "shift-straddles")
    straddles = logs.groupBy(*keys).agg(F.max("failed").alias("failed"), F.count("pnl").cast("int").alias("straddles"), F.sum("pnl").alias("_std"))
    out = first_picks.select(*keys, "entry_t").join(shifts.drop("_go"), keys, "left").join(straddles, keys, "left").where("NOT coalesce(failed, false)")
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    return out.select(*keys, "entry_t", F.coalesce("rolls", F.lit(0)).alias("rolls"), zero("shifted_pnl").alias("shifted_pnl"), zero("left_pnl").alias("left_pnl"), F.coalesce("straddles", F.lit(0)).alias("straddles"), money(zero("_std")).alias("straddle_pnl"), money(zero("shifted_pnl") + zero("left_pnl") + zero("_std")).alias("total_pnl"))
