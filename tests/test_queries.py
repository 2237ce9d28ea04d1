"""Registered queries against DuckDB, and the contract of the entry module.

By default a third of the checked queries run; BARLOOM_ALL_CHECKS=1 runs all.
"""

import os

import pytest
from check import compare, duck

import __spark_entry__ as entry_mod

CHECKED = sorted(entry_mod.oracle_sql())
NAMES = CHECKED if os.environ.get("BARLOOM_ALL_CHECKS") else [
    n for n in CHECKED if n.split("_")[0] in ("wgt", "con", "jn", "scl", "sig", "set", "flagship") or n in (
        "win_macd", "win_rollmet", "win_allind", "met_all", "met_period", "agg_costreport", "agg_covar", "bt_run",
        "bt_trades", "met_portstats", "ev_class", "ev_fin", "fp_scale_robust", "ml_split", "ppr_ledger", "snk_bars_merge",
        "snk_delete", "pre_bars", "chk_report", "agg_reqstats", "st_signal", "st_ledger", "reb_trigger", "reb_execute",
    )
]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, con, name):
    got = entry_mod.queries()[name](spark, sf).toPandas()
    want = con.execute(entry_mod.oracle_sql()[name]).df()
    assert compare(got, want) is None


def test_entry(spark):
    assert entry_mod.entry(spark).count() == 25


def test_checks_belong_to_queries():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
