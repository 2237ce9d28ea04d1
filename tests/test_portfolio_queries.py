"""Registered portfolio queries that have no SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from barloom.operators import backtest
from barloom.plans import portfolio_queries as pq


@pytest.mark.parametrize("name", ["opt_min_variance", "opt_grouped"])
def test_optimizers_solve_every_date(spark, sf, name):
    got = {r.as_of for r in entry_mod.queries()[name](spark, sf).select("as_of").distinct().collect()}
    want = {r.d for r in pq._returns(spark, sf).where("ret IS NOT NULL").select(F.col("date").cast("string").alias("d")).distinct().collect()}
    assert want and {str(x)[:10] for x in got} >= want


def test_covariances_of_every_date(spark, sf):
    got = {r.as_of for r in entry_mod.queries()["agg_covar"](spark, sf).select("as_of").distinct().collect()}
    want = {r.d for r in pq._returns(spark, sf).select(F.col("date").cast("string").alias("d")).distinct().collect()}
    assert len(want) > 70 and got == want


def test_bt_run_optimized_takes_all_signals(spark, sf, monkeypatch):
    seen = {}

    def note(prices, signals, *args, **kw):
        seen.update(kw, months=signals.select(F.month("date")).distinct().count())
        raise InterruptedError

    monkeypatch.setattr(backtest, "run_backtest", note)
    with pytest.raises(InterruptedError):
        entry_mod.queries()["bt_run_optimized"](spark, sf)
    assert seen["months"] == 12 and "window" not in seen
