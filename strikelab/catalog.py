"""Where queries are registered, and the market that they read."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelab.functions import triggers
from strikelab.functions.scalars import instrument
from strikelab.operators import strikes
from strikelab.plans import weekly
from strikelab.plans.lineage import cut
from strikelab.plans.steps import Desk, menu, session_bars
from strikelab.sources import tape

GAP = tape.GAP
FIRST, LAST = 540, 930
# The portfolio stop's levels, in percent of the fund.
LEVELS = [-0.1, -0.2, -0.3, -0.4, -0.5, -0.6, -0.7, -0.8, -0.9, -1, -1.25, -1.5, -1.75, -2, -2.5, -3, -3.5, -4, -100, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1, 1.25, 1.5, 1.75, 2, 2.5, 3, 3.5, 4]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, market: bool = True):
    """Registers a query and its SQL; market: the SQL reads the tape's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{tape.TAPE_SQL}{sql}" if market else sql
        return f

    return add


class Market:
    """The tape's tables; what a query reads more than once it can have stored."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        events = tape.table(spark, sf_dir, "events").select("ts", "user_id", "value")
        self.futures, self.spot, self.options, self.calendar = tape.futures(events), tape.spot(events), tape.options(events), tape.calendar(events)

    def stored(self) -> Market:
        """The same with futures and the session's options written once."""
        self.futures, self.options = cut(self.futures, "futures"), cut(self.session, "options")
        return self

    @property
    def days(self) -> DataFrame:
        return self.futures.select("idx", "trade_date").distinct()

    @property
    def session(self) -> DataFrame:
        return self.options.where(F.col("t").between(FIRST, LAST))

    @property
    def session_futures(self) -> DataFrame:
        return self.futures.where(F.col("t").between(FIRST, LAST))

    @cached_property
    def legs(self) -> DataFrame:
        return triggers.legs(self.session)

    @property
    def atm(self) -> DataFrame:
        return strikes.atm(self.session_futures, self.session, GAP)

    def weekly(self, from_dte: int = 5, to_dte: int = 1) -> Market:
        """The same with weeks as sessions."""
        calendar = self.futures.select("idx", "trade_date").distinct().join(self.calendar, "trade_date").select("idx", "trade_date", "dte")
        self.weeks = cut(weekly.week_days(calendar, from_dte, to_dte), "week-days")
        self.futures, self.options = (cut(weekly.on_weeks(df, self.weeks, opening), name) for df, opening, name in ((self.session_futures, FIRST, "week-futures"), (self.session, FIRST, "week-options")))
        return self

    def weekly_desk(self, *oms: str) -> Desk:
        menus = [menu(strikes.by_om(self.futures, self.options, om, GAP), om) for om in oms or ("0",)]
        return Desk(legs=cut(triggers.legs(self.options), "legs"), menus=cut(reduce(DataFrame.unionByName, menus), "menus"), futures=cut(session_bars(self.futures), "session-futures"), options=self.options, gap=GAP, first=FIRST, last=LAST, days=cut(weekly.week_dtes(self.weeks), "week-dtes"))

    def desk(self, *oms: str, instruments: bool = False) -> Desk:
        """What strategies look up, stored; menus of these strike specs (multiples of the premium unit are searched for instead).
        instruments: with each index's own slippage, ticks and premium step, else 1 % and neither."""
        self.stored()
        strangles = {om: x for om in oms if (x := strikes.strangle_spec(om))}
        listed = {x: None for x in oms if x not in strangles} | ({"0": None} if strangles or not oms else {})
        menus = [menu(strikes.by_om(self.session_futures, self.session, om, GAP), om) for om in listed]
        rules = {"rate": instrument("rate"), "tick": instrument("tick"), "step": instrument("step")} if instruments else {}
        return Desk(legs=cut(self.legs, "legs"), menus=cut(reduce(DataFrame.unionByName, menus), "menus"), futures=cut(session_bars(self.session_futures), "session-futures"), options=self.session, gap=GAP, first=FIRST, last=LAST, strangles=strangles, **rules)

    def entries_of(self, sets: DataFrame, days: DataFrame | None = None) -> DataFrame:
        """Each session (or each of `days`) with each set of a grid of any size; how the two meet is left to Spark."""
        return (self.days if days is None else days).crossJoin(sets)

    def entries(self, rows: list[tuple], schema: str) -> DataFrame:
        """Each session with each parameter set of a short list in the driver's memory, which bounds what is broadcast; grids: entries_of."""
        return self.days.crossJoin(F.broadcast(self.days.sparkSession.createDataFrame(rows, schema)))
