"""Market-rule constraints on signals (WIN_TPLUS1, WIN_PRICELIMIT, CON_*)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.guards import by_date


@dataclass(frozen=True)
class MarketRules:
    """Which rules apply. The last three change nothing on daily bars."""

    t_plus_1: bool = True
    price_limit: bool = True
    suspension: bool = True
    new_stock: bool = True
    st: bool = True
    auction_time: bool = False


LENIENT = MarketRules(False, False, False, False, False, False)


def t_plus_1(df: DataFrame, signal: str = "signal", out: str = "signal") -> DataFrame:
    """Cap a sell by the sum of earlier buys, strictly before the day.

    Sells do not use up earlier buys, as in the rule this follows.
    """
    before = by_date().rowsBetween(Window.unboundedPreceding, -1)
    bought = F.coalesce(F.sum(F.when(F.col(signal) > 0, F.col(signal))).over(before), F.lit(0))
    capped = F.when(F.col(signal) < 0, F.greatest(F.col(signal), -bought)).otherwise(F.col(signal))
    return df.withColumn(out, capped)


def with_limits(df: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Add lower and upper limit price from the previous close.

    `info(symbol, market_type, status, listing_date)` overrides what the code
    itself tells; a stock listed at most 30 days ago has the wide limit.
    """
    if info is not None:
        known = info.select(
            "symbol",
            F.col("market_type").alias("_m"),
            F.col("status").alias("_s"),
            F.col("listing_date").alias("_l"),
        )
        df = df.join(known, "symbol", "left")
    else:
        df = df.withColumns(
            {"_m": F.lit(None).cast("string"), "_s": F.lit(None).cast("string"), "_l": F.lit(None).cast("date")}
        )
    ratio = rules.limit_ratio(
        F.coalesce("_m", rules.market_type("symbol")),
        F.coalesce("_s", rules.stock_status("symbol")),
        rules.is_new_stock("date", "_l"),
    )
    prev = F.lag("close").over(by_date())
    return df.withColumns({"lower_limit": prev * (1 - ratio), "upper_limit": prev * (1 + ratio)}).drop("_m", "_s", "_l")


def price_limit(df: DataFrame, signal: str = "signal", out: str = "signal") -> DataFrame:
    """No buys at the upper limit, no sells at the lower one."""
    s, c = F.col(signal), F.col("close")
    at_upper = c >= F.col("upper_limit") * 0.999
    at_lower = c <= F.col("lower_limit") * 1.001
    zero = F.lit(0).cast(df.schema[signal].dataType)
    return df.withColumn(
        out, F.when(at_upper, F.when(s > 0, zero).otherwise(s)).when(at_lower, F.when(s < 0, zero).otherwise(s)).otherwise(s)
    )


def suspend(df: DataFrame, suspensions: DataFrame | None = None, signal: str = "signal") -> DataFrame:
    """Zero the signal on suspended days, listed or shown by zero volume."""
    zero = F.lit(0).cast(df.schema[signal].dataType)
    off = F.coalesce(F.col("volume") == 0, F.lit(False))
    if suspensions is not None:
        marked = suspensions.select("symbol", "date").distinct().withColumn("_off", F.lit(True))
        df = df.join(marked, ["symbol", "date"], "left")
        off = off | F.col("_off").isNotNull()
    return df.withColumn(signal, F.when(off, zero).otherwise(F.col(signal))).drop("_off")


def apply_rules(
    df: DataFrame,
    market: MarketRules = MarketRules(),
    info: DataFrame | None = None,
    suspensions: DataFrame | None = None,
) -> DataFrame:
    """Constrain `signal`; `raw_signal` keeps the input.

    Price limits look at the raw signal's direction and at T+1's result, in the
    order T+1, price limit, suspension.
    """
    df = df.withColumn("raw_signal", F.col("signal"))
    if market.t_plus_1:
        df = t_plus_1(df)
    if market.price_limit:
        df = price_limit(with_limits(df, info))
    if market.suspension:
        df = suspend(df, suspensions)
    return df
