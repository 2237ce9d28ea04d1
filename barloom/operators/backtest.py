"""Backtests from signals and from weights (BT_*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import by_date, div, running
from ..session import cut_lineage


def signal_summary(df: DataFrame) -> DataFrame:
    """Counts of signals and the log return of being held, per symbol.

    Input carries `signal`, `held` and `close`; a day earns its return when the
    symbol was held at the close of the day before.
    """
    w = by_date()
    df = df.withColumns(
        {
            "_h": F.coalesce(F.lag("held").over(w), F.lit(False)),
            "_lr": F.log(div("close", F.lag("close").over(w))),
        }
    )
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("signal") == 1).alias("buys"),
        F.count_if(F.col("signal") == -1).alias("sells"),
        F.count_if("_h").alias("held_days"),
        F.sum(F.when(F.col("_h") & F.col("_lr").isNotNull(), F.col("_lr")).otherwise(0.0)).alias("log_return"),
    )


def densify(df: DataFrame, dates: DataFrame, cols) -> DataFrame:
    """All dates for every symbol of `df`; `cols` are NULL where a symbol has no row.

    The dates travel as one array, which the calendar bounds.
    """
    calendar = dates.agg(F.sort_array(F.collect_set("date")))
    grid = (
        df.select("symbol").distinct().withColumn("_d", calendar.scalar())
        .select("symbol", F.explode("_d").alias("date"))
    )
    return grid.join(df.select("symbol", "date", *cols), ["symbol", "date"], "left")


def union_align(prices: DataFrame, signals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Price, signal and size on the union of their dates (JN_UNION_INDEX).

    Prices are carried forward and days without any price dropped; signals and
    sizes are 0 where missing.
    """
    dates = prices.select("date").union(signals.select("date")).union(sizes.select("date")).distinct()
    grid = densify(prices, dates, ["close"])
    grid = grid.withColumn("close", F.last("close", ignorenulls=True).over(running()))
    first = prices.where("close IS NOT NULL").agg(F.min("date"))
    grid = grid.withColumn("_first", first.scalar()).where("date >= _first").drop("_first")
    out = grid.join(signals.select("symbol", "date", "signal"), ["symbol", "date"], "left")
    out = out.join(sizes.select("symbol", "date", "size"), ["symbol", "date"], "left")
    return out.fillna(0, ["signal"]).fillna(0.0, ["size"])


def hold(grid: DataFrame, weights: DataFrame, key: str = "symbol") -> DataFrame:
    """Carry the weights of each rebalance date to the next one (WIN_HOLD).

    On a rebalance date every symbol gets its weight or 0; between two such
    dates the last one counts; before the first, 0.
    """
    marks = weights.select("date").distinct().withColumn("_m", F.lit(True))
    df = grid.join(marks, "date", "left").join(weights.select("symbol", "date", "weight"), ["symbol", "date"], "left")
    at = F.when(F.col("_m"), F.coalesce("weight", F.lit(0.0)))
    held_w = F.coalesce(F.last(at, ignorenulls=True).over(running(key)), F.lit(0.0))
    return df.withColumn("weight", held_w).drop("_m")


def shares(df: DataFrame, capital: float = 1_000_000.0) -> DataFrame:
    """Shares = weight x capital / price; a zero or missing price gives 0."""
    return df.withColumn("shares", F.coalesce(div(F.col("weight") * capital, "close"), F.lit(0.0)))


def portfolio(
    held_weights: DataFrame, initial: float = 1_000_000.0, fee: float = 0.0003, slip: float = 0.001,
    keys: tuple[str, ...] = ("strategy",),
) -> DataFrame:
    """Daily return and value of held weights (keys, symbol, date, close, weight).

    Weights of the evening earn the next day's return; changing them costs fee
    and slippage on the turnover. Drift of weights between rebalances is left
    out.
    """
    w = by_date(*keys, "symbol")
    df = held_weights.withColumns(
        {
            "_pw": F.coalesce(F.lag("weight").over(w), F.lit(0.0)),
            "_r": F.coalesce(div("close", F.lag("close").over(w)) - 1, F.lit(0.0)),
        }
    )
    daily = df.groupBy(*keys, "date").agg(
        F.sum(F.col("_pw") * F.col("_r")).alias("gross"),
        F.sum(F.abs(F.col("weight") - F.col("_pw"))).alias("turnover"),
        F.sum("weight").alias("invested"),
    )
    daily = daily.withColumn("ret", F.col("gross") - F.col("turnover") * (fee + slip))
    return daily.withColumn("value", initial * F.product(1 + F.col("ret")).over(running(*keys)))


def paired_trades(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Entry and exit pairs with their return (BT_TRADES), from `signals.held` output.

    A position still open at the end has no exit date and is marked at the last
    close.
    """
    w = by_date(*keys)
    pair = F.sum(F.col("entry").cast("int")).over(running(*keys))
    df = df.withColumns({"_p": pair, "_last": F.last("close").over(w.rowsBetween(0, Window.unboundedFollowing))})
    ends = df.where("entry OR exit").where("_p > 0")
    t = ends.groupBy(*keys, "_p").agg(
        F.max(F.when(F.col("entry"), F.col("date"))).alias("entry_date"),
        F.max(F.when(F.col("exit"), F.col("date"))).alias("exit_date"),
        F.max(F.when(F.col("entry"), F.col("close"))).alias("entry_price"),
        F.coalesce(F.max(F.when(F.col("exit"), F.col("close"))), F.max("_last")).alias("exit_price"),
    )
    return t.select(
        *keys,
        "entry_date",
        "exit_date",
        "entry_price",
        "exit_price",
        (F.col("exit_price") - F.col("entry_price")).alias("pnl"),
        (div("exit_price", "entry_price") - 1).alias("returns"),
        F.when(F.col("exit_date").isNull(), "Open").otherwise("Closed").alias("status"),
    )


def portfolio_stats(
    daily: DataFrame, trades: DataFrame, initial: float = 1_000_000.0, risk_free: float = 0.02, key: str = "strategy"
) -> DataFrame:
    """Engine statistics per strategy from daily values and trades (MET_PORTSTATS)."""
    df = daily.withColumn("_peak", F.greatest(F.max("value").over(running(key)), F.lit(float(initial))))
    cash = F.col("value") * (1 - F.col("invested"))
    a = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("value", "date").alias("final_value"),
        F.min(F.col("value") / F.col("_peak") - 1).alias("max_drawdown"),
        F.stddev_samp("ret").alias("_sd"),
        F.avg("ret").alias("_m"),
        F.max(cash).alias("max_cash"),
        F.min(cash).alias("min_cash"),
    )
    t = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("_win"),
        F.sum(F.when(F.col("pnl") < 0, -F.col("pnl"))).alias("_loss"),
        F.avg("returns").alias("avg_trade_return"),
    )
    g = F.col("final_value") / initial
    ann = F.when(g > 0, F.pow(g, 252.0 / F.col("_n")) - 1).otherwise(0.0)
    vol = F.col("_sd") * F.sqrt(F.lit(252.0))
    a = a.join(t, key, "left")
    return a.select(
        key,
        (g - 1).alias("total_return"),
        ann.alias("annualized_return"),
        "max_drawdown",
        vol.alias("volatility"),
        F.coalesce(div(F.col("_m") - risk_free / 252, "_sd") * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe_ratio"),
        F.when(F.col("max_drawdown") != 0, ann / F.abs("max_drawdown")).otherwise(0.0).alias("calmar_ratio"),
        F.coalesce("total_trades", F.lit(0)).alias("total_trades"),
        F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"),
        F.coalesce(div("_win", "_loss"), F.lit(0.0)).alias("profit_factor"),
        F.coalesce("avg_trade_return", F.lit(0.0)).alias("avg_trade_return"),
        "max_cash",
        "min_cash",
        "final_value",
    )


def signal_weights(signals: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Equal shares of the whole universe for the held symbols; cash otherwise."""
    n = signals.groupBy(*keys).agg(F.count_distinct("symbol").alias("_n"))
    return signals.join(n, list(keys)).withColumn("weight", F.col("held").cast("double") / F.col("_n")).drop("_n")


def run_backtest(
    prices: DataFrame, signals: DataFrame, frequency: str = "daily", weight_rules=None, optimizer_rules=None,
    industry: DataFrame | None = None, capital: float = 1_000_000.0, window: int = 60, blocks: int = 1,
) -> dict[str, DataFrame]:
    """Signals to weights to held positions to daily values (BT_PIPELINE).

    Returns the weights at rebalance dates, the held positions with their
    shares, and the daily portfolio. Without `optimizer_rules` the transformed
    weights are held as they are.
    """
    from ..functions.rules import is_label_rebalance_day
    from .covariance import asof_moments
    from .indicators import returns as with_returns
    from .optimize import optimize
    from .weights import WeightRules, post_process, transform

    due = signals.where(is_label_rebalance_day("date", frequency))
    base = transform(due, weight_rules or WeightRules()).select("date", "symbol", "weight")
    if optimizer_rules is not None:
        base = cut_lineage(base, "selected")
        # only the names selected on a date enter its solve
        rets = with_returns(prices).select("date", "symbol", F.col("returns").alias("ret"))
        as_of = base.select(F.col("date").alias("as_of")).distinct()
        picked = base.select(F.col("date").alias("as_of"), "symbol")
        cov, mu = asof_moments(rets, as_of, window, blocks, picked)
        solved = optimize(mu, cov, optimizer_rules, industry)
        base = post_process(
            solved.withColumnRenamed("as_of", "date"), industry, optimizer_rules.lower, optimizer_rules.upper,
            optimizer_rules.industry_cap,
        ).select("date", "symbol", "weight")
    # holding reads the weights twice; they are small next to the grid
    base = cut_lineage(base, "weights")
    grid = densify(prices, prices.select("date"), ["close"])
    grid = grid.withColumn("close", F.last("close", ignorenulls=True).over(running()))
    positions = shares(hold(grid, base), capital).withColumn("strategy", F.lit("weights"))
    return {"weights": base, "positions": positions, "daily": portfolio(positions, capital)}
