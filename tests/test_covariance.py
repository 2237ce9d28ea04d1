"""Covariances of many symbols: bounded blocks, and the factored form the optimizer multiplies with."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from barloom.operators import covariance as cv
from barloom.operators import optimize as op


def _wide(symbols=40, days=30, seed=3):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame(rng.normal(size=(days, symbols)), columns=[f"s{i:02d}" for i in range(symbols)],
                        index=pd.date_range("2020-01-01", periods=days))
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide.iloc[: days // 2, 0] = np.nan  # these two share no date
    wide.iloc[days // 2 :, 1] = np.nan
    wide.iloc[:, 2] = 0.25  # does not move
    return wide


def _tall(spark, wide):
    tall = wide.stack().dropna().rename("ret").reset_index().set_axis(["date", "symbol", "ret"], axis=1)
    tall["date"] = tall["date"].dt.date
    return spark.createDataFrame(tall, "date date, symbol string, ret double")


def _wanted(wide):
    """Matrix as asof_moments defines it."""
    c = wide.cov().fillna(0.0).to_numpy(copy=True)
    d = np.diag(c).copy()
    np.fill_diagonal(c, np.where(d > 0, d, 1e-4))
    return c


def test_blocks_follow_the_number_of_symbols(spark, monkeypatch):
    wide = _wide()
    monkeypatch.setattr(cv, "BLOCK", 4)
    got = cv.pairwise(_tall(spark, wide)).toPandas().set_index(["sym_i", "sym_j"])
    shared = wide.notna().astype(int)
    n = shared.T @ shared
    pairs = [(a, b) for i, a in enumerate(wide) for b in list(wide)[i:] if n.loc[a, b]]
    assert sorted(got.index) == sorted(pairs)  # no pair without a common date
    want = wide.cov()
    assert np.allclose(got["cov"], [want.loc[k] for k in got.index], equal_nan=True)
    assert all(got["n"] == [n.loc[k] for k in got.index])


def test_blocks_are_counted_from_the_symbols(spark, monkeypatch):
    seen = []
    sequence = F.sequence
    monkeypatch.setattr(cv, "BLOCK", 4)
    monkeypatch.setattr(cv.F, "sequence", lambda a, b, *r: seen.append(b) or sequence(a, b, *r))
    cv.pairwise(_tall(spark, _wide()), blocks=1)
    assert "9" in str(seen[0])  # 40 symbols, 10 blocks


def test_rows_are_sent_to_a_bounded_number_of_blocks(spark, monkeypatch):
    seen = []
    sequence = F.sequence
    wide = _wide()
    monkeypatch.setattr(cv, "BLOCK", 1)
    want = sorted(map(tuple, cv.pairwise(_tall(spark, wide), blocks=40).select("sym_i", "sym_j", "n").collect()))
    monkeypatch.setattr(cv.F, "sequence", lambda a, b, *r: seen.append(b) or sequence(a, b, *r))
    monkeypatch.setattr(cv, "PAIRS_OF_STRIP", 3, raising=False)
    got = cv.pairwise(_tall(spark, wide))
    assert "15" in str(seen[0])  # 16 blocks of two or three symbols, not 40
    assert sorted(map(tuple, got.select("sym_i", "sym_j", "n").collect())) == want and len(want) > 800
    cov = got.toPandas().set_index(["sym_i", "sym_j"])["cov"]
    assert np.allclose(cov, [wide.cov().loc[k] for k in cov.index], equal_nan=True)


def test_blocks_hold_a_bounded_number_of_returns(spark, monkeypatch):
    seen = []
    sequence = F.sequence
    monkeypatch.setattr(cv, "CELLS", 30)
    monkeypatch.setattr(cv.F, "sequence", lambda a, b, *r: seen.append(b) or sequence(a, b, *r))
    rows = cv.series(_tall(spark, _wide()))
    days = max(len(r.days) for r in rows.collect())
    cv.framed_pairs(rows, [(None, 0, 2**31 - 1)])
    assert str(-(-40 * days // 30) - 1) in str(seen[0])


def test_windows_multiply_like_the_matrix():
    wide = _wide()
    c, want = op.WindowCovariance(wide.to_numpy().T), _wanted(wide)
    w = np.random.default_rng(1).normal(size=40)
    assert np.allclose(c @ w, want @ w) and np.allclose(c.diagonal(), np.diag(want))
    c.cached, c.STRIP = None, 7  # counts of patterns taken a strip at a time
    assert np.allclose(c @ w, want @ w)


@pytest.mark.parametrize("method", ["mean_variance", "min_variance", "risk_parity"])
def test_factored_form_gives_the_same_weights(spark, method):
    r = _tall(spark, _wide(days=20))
    as_of = r.select(F.col("date").alias("as_of")).where("date >= '2020-01-15'").distinct()
    found = []
    for factored in (False, True):
        cov, mu = cv.asof_moments(r, as_of, 10, factored=factored)
        w = op.optimize(mu, cov, op.OptimizerRules(method=method, upper=0.1, iterations=200))
        found.append(w.toPandas().set_index(["as_of", "symbol"]).sort_index())
    assert len(found[0]) == len(found[1]) > 200
    assert np.allclose(found[0]["weight"], found[1]["weight"], atol=1e-6) and np.allclose(found[0]["objective_end"], found[1]["objective_end"], atol=1e-8)


@pytest.mark.parametrize("name", ["opt_max_sharpe", "opt_grouped"])
def test_optimizer_queries_form_no_pairs(spark, sf, name, monkeypatch):
    monkeypatch.setattr(cv, "framed_pairs", lambda *a: pytest.fail("pairs were formed"))
    assert entry_mod.queries()[name](spark, sf).columns[:2] == ["as_of", "symbol"]
