import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind


def series(df, *cols):
    return df.orderBy("date").select(*cols).toPandas()


def test_all_families_on_the_literal_bars(bars20):
    out = series(ind.all_indicators(bars20), "close", "ma_5", "ma_20", "ema_12", "macd", "macd_signal", "macd_hist", "rsi_14",
                 "boll_middle", "boll_upper", "boll_lower", "kdj_k", "williams_r", "volume_ma_5", "volume_ratio")
    c = out["close"]
    assert np.allclose(out["ma_5"], c.rolling(5, min_periods=1).mean())
    assert out["ma_20"].isna().all()  # the window is not shorter than the history
    assert np.allclose(out["ema_12"], c.ewm(span=12, adjust=False).mean())
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    assert np.allclose(out["macd"], macd)
    assert np.allclose(out["macd_signal"], macd.ewm(span=9, adjust=False).mean())
    assert np.allclose(out["macd_hist"], out["macd"] - out["macd_signal"])
    rsi = out["rsi_14"].dropna()
    assert ((rsi >= 0) & (rsi <= 100)).all() and np.isnan(out["rsi_14"][0]) and out["rsi_14"][1] == 100
    assert (out["boll_upper"][1:] >= out["boll_middle"][1:]).all() and (out["boll_lower"][1:] <= out["boll_middle"][1:]).all()
    assert out["williams_r"].between(-100, 0).all()
    assert out["kdj_k"].between(0, 100).all()


@pytest.mark.parametrize("span", [1, 2, 9, 26, 200])
def test_ewm_of_a_long_series(spark, span):
    n = 6000
    rng = np.random.default_rng(1)
    x = rng.normal(size=n) * np.where(np.arange(n) < 3000, 1e4, 1.0)
    pdf = pd.DataFrame({"symbol": "a", "date": pd.date_range("1990-01-01", periods=n).date, "x": x})
    out = ind.ewm(spark.createDataFrame(pdf), {"e": (F.col("x"), span)}).orderBy("date").toPandas()
    want = pd.Series(x).ewm(span=span, adjust=False).mean()
    assert np.allclose(out["e"], want, rtol=1e-9, atol=1e-9)


def test_spans_that_share_no_block_are_grouped(spark):
    assert ind._span_groups((2, 12, 26, 2000)) == [[2000], [26, 12, 2]]


def test_unknown_family(bars20):
    with pytest.raises(ValueError):
        ind.all_indicators(bars20, ("nope",))


def test_ffill_limit(spark):
    pdf = pd.DataFrame({"symbol": "a", "date": pd.date_range("2024-01-01", periods=7).date, "x": [1.0, None, None, None, None, 6.0, None]})
    out = ind.ffill(spark.createDataFrame(pdf, "symbol string, date date, x double"), ["x"], 3).orderBy("date").toPandas()["x"]
    assert np.allclose(out, pd.Series([1, np.nan, np.nan, np.nan, np.nan, 6, np.nan]).ffill(limit=3), equal_nan=True)
