"""Trading signals: -1, 0 or 1 per symbol and date (SIG_*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import by_date, div
from . import indicators as ind


def _crossing(fast: Column, slow: Column) -> Column:
    pf, ps = F.lag(fast).over(by_date()), F.lag(slow).over(by_date())
    return (
        F.when((fast > slow) & (pf <= ps), 1)
        .when((fast < slow) & (pf >= ps), -1)
        .otherwise(0)
    )


def ma_cross(bars: DataFrame, fast: int = 5, slow: int = 20, strict: bool = True) -> DataFrame:
    """Crossing of two moving averages.

    `strict` waits for full windows; otherwise averages start with the first row.
    """
    df = (
        ind.ma_strict(bars, (fast, slow))
        if strict
        else bars.withColumns({f"ma_{n}": F.avg("close").over(ind.trailing(n)) for n in (fast, slow)})
    )
    return df.withColumn("signal", _crossing(F.col(f"ma_{fast}"), F.col(f"ma_{slow}")))


def rsi_cross(bars: DataFrame, window: int = 14, oversold: float = 30, overbought: float = 70) -> DataFrame:
    """Signal on the day the strict RSI crosses a threshold."""
    df = ind.rsi_strict(bars, window)
    r = F.col(f"rsi_{window}")
    p = F.lag(r).over(by_date())
    return df.withColumn(
        "signal",
        F.when((r < oversold) & (p >= oversold), 1).when((r > overbought) & (p <= overbought), -1).otherwise(0),
    )


def rsi_level(bars: DataFrame, window: int = 14, oversold: float = 30, overbought: float = 70) -> DataFrame:
    """Signal on every day the RSI is beyond a threshold."""
    df = ind.rsi(bars, (window,))
    r = F.col(f"rsi_{window}")
    return df.withColumn("signal", F.when(r > overbought, -1).when(r < oversold, 1).otherwise(0))


def momentum(bars: DataFrame, lookback: int = 20, threshold: float = 0.02) -> DataFrame:
    m = div("close", F.lag("close", lookback).over(by_date())) - 1
    df = bars.withColumn("momentum", m)
    return df.withColumn(
        "signal",
        F.when(F.col("momentum") < -threshold, -1).when(F.col("momentum") > threshold, 1).otherwise(0),
    )


STRATEGIES = {"ma": ma_cross, "rsi": rsi_cross, "momentum": momentum}


def register_strategy(name: str, fn) -> None:
    """Make `fn(bars, **params) -> bars + signal` available by name."""
    if name in STRATEGIES:
        raise ValueError(f"strategy {name} exists")
    STRATEGIES[name] = fn


def run_strategies(bars: DataFrame, names, params: dict[str, dict] | None = None, failures: dict[str, Exception] | None = None) -> DataFrame:
    """Signals of several strategies over one universe, in one table.

    With `failures` a strategy that cannot be built leaves its error there and
    stops no other; without any signals the table is empty.
    """
    params = params or {}
    out = bars.select(F.lit("").alias("strategy"), "symbol", "date", "close", F.lit(0).alias("signal")).limit(0)
    for n in names:
        try:
            s = STRATEGIES[n](bars, **params.get(n, {})).select(
                F.lit(n).alias("strategy"), "symbol", "date", "close", F.col("signal").cast("int").alias("signal")
            )
        except Exception as e:
            if failures is None:
                raise
            failures[n] = e
            continue
        out = out.unionByName(s)
    return out


def position_size(signal: Column, close: Column | None = None, kind: str = "percentage",
                  size: float = 0.05, cap: float = 0.20) -> Column:
    """Signal times a fixed share, or a fixed amount over the price; capped from above."""
    raw = signal * size if kind != "fixed_amount" else signal * div(F.lit(float(size)), close)
    return F.least(raw, F.lit(cap))


def held(df: DataFrame, signal: str = "signal", key: str = "symbol") -> DataFrame:
    """Held state after each day: in from the first buy while flat to the first sell while in."""
    last_move = F.last(F.when(F.col(signal) != 0, F.col(signal)), ignorenulls=True)
    w = by_date(key)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(last_move.over(before), F.lit(-1))
    return df.withColumns(
        {
            "entry": (F.col(signal) > 0) & (prev < 0),
            "exit": (F.col(signal) < 0) & (prev > 0),
            "held": F.coalesce(last_move.over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)) > 0,
        }
    )
