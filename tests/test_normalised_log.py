"""Normalised logs: values by index, and how they meet the log."""

import math

from strikelab.operators import rollup


def test_a_log_is_not_dealt_by_index(spark):
    """The few indices of a log would be its only tasks; indices without a value and futures of 0 give null."""
    log = spark.createDataFrame([("A", 100.0, 3.0), ("A", 50.0, -1.0), ("B", 0.0, 5.0), ("C", 10.0, 2.0), (None, 10.0, 2.0)], "P_index string, Future double, A_PNL double")
    out = rollup.normalised_log(log, spark.createDataFrame([("A", 50), ("B", 25)], "i string, nv int"))
    assert "hashpartitioning(P_index" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["P_index", "Future", "A_PNL"]
    got = sorted((r["P_index"] or "", r["Future"], math.inf if r["A_PNL"] is None else r["A_PNL"]) for r in out.collect())
    assert got == [("", 10.0, math.inf), ("A", 50.0, -4.0), ("A", 100.0, 6.0), ("B", 0.0, math.inf), ("C", 10.0, math.inf)]
