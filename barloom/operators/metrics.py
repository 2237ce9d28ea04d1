"""Return, risk and drawdown metrics per strategy (MET_*, WIN_CUMRET, WIN_DRAWDOWN, WIN_ROLLMET).

Input is returns(strategy, date, ret) with one row per strategy and date, so
one series is bounded by the calendar. All metrics of a strategy come from one
exchange by strategy: the running columns and the aggregates share it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import by_date, div, running, trailing, with_group_stats

TRADING_DAYS = 252
RISK_FREE = 0.03

RETURN = ["total_return", "cumulative_return", "annualized_return"]
RISK = ["volatility", "downside_volatility"]
RISK_ADJUSTED = ["sharpe_ratio", "sortino_ratio", "calmar_ratio"]
DRAWDOWN = ["max_drawdown", "avg_drawdown", "max_drawdown_duration", "recovery_factor"]
DISTRIBUTION = ["skewness", "kurtosis", "var_95", "cvar_95"]
TRADING = ["win_rate", "profit_loss_ratio", "expectancy"]
RELATIVE = ["tracking_error", "information_ratio", "beta", "alpha", "r_squared"]
ABSOLUTE = RETURN + RISK + RISK_ADJUSTED + DRAWDOWN + DISTRIBUTION + TRADING
BASIC = ["total_return", "annualized_return", "volatility", "sharpe_ratio", "max_drawdown", "win_rate"]


def curve(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """Cumulative net value, its running peak and the drawdown from it."""
    w = running(key)
    df = returns.where(F.col("ret").isNotNull())
    df = df.withColumn("value", F.product(1 + F.col("ret")).over(w))
    df = df.withColumn("peak", F.max("value").over(w))
    return df.withColumn("drawdown", div(F.col("value") - F.col("peak"), "peak"))


def annualize(growth: Column, n: Column) -> Column:
    return F.when(growth > 0, F.pow(growth, F.lit(float(TRADING_DAYS)) / n) - 1).otherwise(0.0)


def metrics(
    returns: DataFrame, benchmark: DataFrame | None = None, key: str = "strategy", risk_free: float = RISK_FREE
) -> DataFrame:
    """One row of metrics per strategy; with benchmark(date, bench) the relative ones too."""
    df = curve(returns, key)
    order = by_date(key)
    df = df.withColumns(
        {
            "_rn": F.row_number().over(order),
            "_var": F.percentile("ret", 0.05).over(Window.partitionBy(key)),
        }
    )
    last_high = F.max(F.when(F.col("drawdown") >= 0, F.col("_rn"))).over(running(key))
    df = df.withColumn("_run", F.col("_rn") - F.coalesce(last_high, F.lit(0)))
    ret = F.col("ret")
    aggs = [
        F.count(F.lit(1)).alias("_n"),
        F.max_by("value", "date").alias("_growth"),
        F.stddev_samp("ret").alias("_sd"),
        F.stddev_samp(F.when(ret < 0, ret)).alias("_dsd"),
        F.count_if(ret < 0).alias("_neg"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))), F.lit(0.0)).alias("avg_drawdown"),
        F.max("_run").alias("max_drawdown_duration"),
        F.skewness("ret").alias("_g1"),
        F.kurtosis("ret").alias("_g2"),
        F.max("_var").alias("var_95"),
        F.avg(F.when(ret <= F.col("_var"), ret)).alias("cvar_95"),
        F.count_if(ret > 0).alias("_pos"),
        F.avg(F.when(ret > 0, ret)).alias("_win"),
        F.avg(F.when(ret < 0, ret)).alias("_loss"),
        F.avg("ret").alias("expectancy"),
    ]
    if benchmark is not None:
        df = df.join(benchmark.where(F.col("bench").isNotNull()), "date", "left")
        pair = F.when(F.col("bench").isNotNull(), ret)
        aggs += [
            F.stddev_samp(pair - F.col("bench")).alias("_te"),
            F.avg(pair - F.col("bench")).alias("_ex"),
            F.var_samp("bench").alias("_bv"),
            F.covar_samp(pair, "bench").alias("_cov"),
            F.corr(pair, "bench").alias("_corr"),
            F.avg("bench").alias("_bm"),
        ]
    a = df.groupBy(key).agg(*aggs)
    n = F.col("_n").cast("double")
    root = math.sqrt(TRADING_DAYS)
    a = a.withColumns(
        {
            "total_return": F.col("_growth") - 1,
            "annualized_return": annualize(F.col("_growth"), n),
            "volatility": F.col("_sd") * root,
            "downside_volatility": F.when(F.col("_neg") > 0, F.col("_dsd") * root).otherwise(0.0),
        }
    )
    excess = F.col("annualized_return") - risk_free
    mdd = F.abs("max_drawdown")
    a = a.withColumns(
        {
            "cumulative_return": F.col("total_return"),
            "sharpe_ratio": F.when(F.col("volatility") > 0, div(excess, "volatility")).otherwise(0.0),
            "sortino_ratio": F.when(F.col("downside_volatility") > 0, div(excess, "downside_volatility")).otherwise(0.0),
            "calmar_ratio": F.when(mdd > 0, div("annualized_return", mdd)).otherwise(0.0),
            "recovery_factor": F.when(mdd > 0, div("total_return", mdd)).otherwise(0.0),
            "skewness": F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)),
            "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)),
            "win_rate": F.col("_pos") / n,
            "profit_loss_ratio": F.coalesce(F.abs(div("_win", "_loss")), F.lit(0.0)),
        }
    )
    cols = list(ABSOLUTE)
    if benchmark is not None:
        te = F.col("_te") * root
        beta = F.when(F.col("_bv") > 0, div("_cov", "_bv"))
        bench_year = F.pow(1 + F.col("_bm"), F.lit(float(TRADING_DAYS))) - 1
        a = a.withColumns(
            {
                "tracking_error": te,
                "information_ratio": F.when(te > 0, div(F.col("_ex") * TRADING_DAYS, te)),
                "beta": beta,
                "alpha": F.col("annualized_return") - (risk_free + beta * (bench_year - risk_free)),
                "r_squared": F.when(F.col("_bv") > 0, F.col("_corr") * F.col("_corr")),
            }
        )
        cols += RELATIVE
    return a.select(key, *cols)


def compare(returns: DataFrame, benchmark: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """Metrics of every strategy, and of the benchmark itself as one more row."""
    own = metrics(returns, benchmark, risk_free=risk_free)
    base = metrics(
        benchmark.select(F.lit("Benchmark").alias("strategy"), "date", F.col("bench").alias("ret")),
        risk_free=risk_free,
    )
    return own.unionByName(base, allowMissingColumns=True)


_PERIOD_END = {
    "weekly": lambda d: F.date_add(F.date_trunc("week", d).cast("date"), 6),
    "monthly": lambda d: F.last_day(d),
    "quarterly": lambda d: F.last_day(F.add_months(F.date_trunc("quarter", d).cast("date"), 2)),
    "yearly": lambda d: F.make_date(F.year(d), F.lit(12), F.lit(31)),
    "daily": lambda d: d,
}


_UNIT = {"weekly": ("week", "INTERVAL 1 WEEK"), "monthly": ("month", "INTERVAL 1 MONTH"), "quarterly": ("quarter", "INTERVAL 3 MONTHS"), "yearly": ("year", "INTERVAL 1 YEAR")}


def _all_periods(p: DataFrame, period: str, key: str) -> DataFrame:
    """Periods without data between a key's first and last one: a return of 0, and the metrics of the period before."""
    unit, step = _UNIT[period]
    start = lambda c: F.date_trunc(unit, c).cast("date")
    span = p.groupBy(key).agg(F.min("period_end").alias("_from"), F.max("period_end").alias("_to"))
    grid = span.select(key, F.explode(F.sequence(start("_from"), start("_to"), F.expr(step))).alias("_start"))
    grid = grid.select(key, _PERIOD_END[period](F.col("_start")).alias("period_end"))
    w = Window.partitionBy(key).orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    carried = [c for c in p.columns if c not in (key, "period_end", "period_return")]
    return grid.join(p, [key, "period_end"], "left").select(
        key,
        "period_end",
        F.coalesce("period_return", F.lit(0.0)).alias("period_return"),
        *[F.last(c, ignorenulls=True).over(w).alias(c) for c in carried],
    )


def period_metrics(
    returns: DataFrame, period: str = "monthly", key: str = "strategy", risk_free: float = RISK_FREE
) -> DataFrame:
    """Compounded return per period, and metrics from the start to each period's end; periods without data are there too."""
    w = running(key)
    df = curve(returns, key).withColumns(
        {
            "_n": F.count(F.lit(1)).over(w),
            "_sd": F.stddev_samp("ret").over(w),
            "_mdd": F.min("drawdown").over(w),
            "period_end": _PERIOD_END[period](F.col("date")),
        }
    )
    p = df.groupBy(key, "period_end").agg(
        (F.product(1 + F.col("ret")) - 1).alias("period_return"),
        F.max_by("value", "date").alias("_v"),
        F.max("_n").alias("_n"),
        F.max_by("_sd", "date").alias("_sd"),
        F.min("_mdd").alias("max_drawdown"),
    )
    if period in _UNIT:
        p = _all_periods(p, period, key)
    p = p.withColumn("volatility", F.col("_sd") * math.sqrt(TRADING_DAYS))
    ann = annualize(F.col("_v"), F.col("_n").cast("double"))
    return p.select(
        key,
        "period_end",
        "period_return",
        (F.col("_v") - 1).alias("cumulative_return"),
        "volatility",
        F.when(F.col("volatility") > 0, div(ann - risk_free, "volatility")).otherwise(0.0).alias("sharpe_ratio"),
        "max_drawdown",
    )


def rolling_metrics(
    returns: DataFrame, window: int = TRADING_DAYS, key: str = "strategy", risk_free: float = RISK_FREE
) -> DataFrame:
    """Metrics over the last `window` rows, from the first full window on.

    The worst drawdown inside a sliding frame has no sliding aggregate, but
    (highest value, lowest value, worst drawdown) of two adjacent stretches
    combine into those of the joined stretch. Stretches of length 1, 2, 4, ...
    are built by doubling, and the window is joined from them: log2(window)
    lags per row in place of a scan of the frame.
    """
    order = by_date(key)
    w = trailing(window, key)
    df = returns.where(F.col("ret").isNotNull()).withColumn("value", F.product(1 + F.col("ret")).over(running(key)))

    def join_stretches(df, out, left, right):
        """left and right are (max, min, mdd) column triples, left being earlier."""
        lmax, lmin, lmdd = left
        rmax, rmin, rmdd = right
        return df.withColumns(
            {
                f"{out}_max": F.greatest(lmax, rmax),
                f"{out}_min": F.least(lmin, rmin),
                f"{out}_mdd": F.least(lmdd, rmdd, div(rmin, lmax) - 1),
            }
        )

    def cols(name):
        return tuple(F.col(f"{name}_{p}") for p in ("max", "min", "mdd"))

    def lagged(name, k):
        return tuple(F.lag(f"{name}_{p}", k).over(order) for p in ("max", "min", "mdd"))

    df = df.withColumns({"s1_max": F.col("value"), "s1_min": F.col("value"), "s1_mdd": F.lit(0.0)})
    size = 1
    while size * 2 <= window:
        df = join_stretches(df, f"s{2 * size}", lagged(f"s{size}", size), cols(f"s{size}"))
        size *= 2
    bits = [1 << b for b in range(window.bit_length()) if window >> b & 1]
    acc, covered = f"s{bits[0]}", bits[0]
    for b in bits[1:]:
        df = join_stretches(df, f"j{covered + b}", lagged(f"s{b}", covered), cols(acc))
        acc, covered = f"j{covered + b}", covered + b
    before = F.coalesce(F.lag("value", window).over(order), F.lit(1.0))
    df = df.withColumns(
        {
            "_n": F.count(F.lit(1)).over(w),
            "volatility": F.stddev_samp("ret").over(w) * math.sqrt(TRADING_DAYS),
            "annualized_return": annualize(div("value", before), F.lit(float(window))),
        }
    ).where(F.col("_n") == window)
    return df.select(
        key,
        "date",
        "annualized_return",
        "volatility",
        F.when(F.col("volatility") > 0, div(F.col("annualized_return") - risk_free, "volatility"))
        .otherwise(0.0)
        .alias("sharpe_ratio"),
        F.col(f"{acc}_mdd").alias("max_drawdown"),
    )


def monthly_table(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """Year rows, month columns m01..m12, compounded return in percent."""
    monthly = returns.groupBy(
        key, F.year("date").alias("year"), F.date_format("date", "'m'MM").alias("month")
    ).agg(((F.product(1 + F.col("ret")) - 1) * 100).alias("r"))
    return (
        monthly.groupBy(key, "year").pivot("month", [f"m{m:02d}" for m in range(1, 13)]).agg(F.max("r"))
    )


def histogram(returns: DataFrame, bins: int = 50, key: str = "strategy") -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest return."""
    df = with_group_stats(returns, [key], lo=F.min("ret"), hi=F.max("ret"))
    pos = div(F.col("ret") - F.col("lo"), F.col("hi") - F.col("lo")) * bins
    b = F.least(F.coalesce(F.floor(pos), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(key, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """Box-plot numbers of the return in percent: quartiles and whiskers at 1.5 IQR."""
    r = F.col("ret") * 100
    df = returns.withColumn(
        "_q", F.percentile(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(Window.partitionBy(key))
    ).withColumns({"q1": F.col("_q")[0], "median": F.col("_q")[1], "q3": F.col("_q")[2]})
    iqr = F.col("q3") - F.col("q1")
    low = F.when(r >= F.col("q1") - 1.5 * iqr, r)
    high = F.when(r <= F.col("q3") + 1.5 * iqr, r)
    return df.groupBy(key).agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(low).alias("whisker_low"),
        F.max(high).alias("whisker_high"),
    )


# Coefficients of Acklam's rational approximation of the inverse
# normal distribution (relative error below 1.2e-9), highest power first.
_CENTRE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
_TAIL_FROM = 0.02425


def normal_quantile(p: str) -> str:
    """SQL text of the inverse normal distribution at the expression `p`, for Spark and DuckDB."""

    def poly(coefficients, x: str) -> str:
        return reduce(lambda acc, k: f"({acc} * {x} + {k:.17e})", coefficients[1:], f"{coefficients[0]:.17e}")

    def tail(x: str) -> str:
        t = f"sqrt(-2e0 * ln({x}))"
        return f"({poly(_TAIL[0], t)} / {poly(_TAIL[1], t)})"

    mid = f"(({p}) - 0.5e0)"
    square = f"({mid} * {mid})"
    return (
        f"CASE WHEN ({p}) < {_TAIL_FROM}e0 THEN {tail(p)} WHEN ({p}) > 1e0 - {_TAIL_FROM}e0 THEN -{tail(f'1e0 - ({p})')} "
        f"ELSE {mid} * {poly(_CENTRE[0], square)} / {poly(_CENTRE[1], square)} END"
    )


def qq_points(returns: DataFrame, key: str = "strategy") -> DataFrame:
    """Ordered returns in percent against normal order-statistic medians."""
    w = Window.partitionBy(key)
    df = returns.withColumns(
        {"rank": F.row_number().over(w.orderBy("ret", "date")), "_n": F.count(F.lit(1)).over(w)}
    )
    half = F.pow(F.lit(0.5), 1 / F.col("_n"))
    p = (
        F.when(F.col("rank") == F.col("_n"), half)
        .when(F.col("rank") == 1, 1 - half)
        .otherwise((F.col("rank") - 0.3175) / (F.col("_n") + 0.365))
    )
    df = df.withColumn("p", p)
    return df.select(key, "rank", "p", F.expr(normal_quantile("p")).alias("theoretical"), (F.col("ret") * 100).alias("ordered"))


def trade_stats(trades: DataFrame, pnl: str = "pnl", key: str = "symbol") -> DataFrame:
    """Trade count, win rate, mean profit and loss, and their ratio."""
    p = F.col(pnl)
    a = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(p > 0).alias("_w"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_profit"),
        F.coalesce(F.avg(F.when(p < 0, p)), F.lit(0.0)).alias("avg_loss"),
    )
    return a.select(
        key,
        "total_trades",
        (F.col("_w") / F.col("total_trades")).alias("win_rate"),
        "avg_profit",
        "avg_loss",
        F.coalesce(F.abs(div("avg_profit", "avg_loss")), F.lit(0.0)).alias("profit_loss_ratio"),
    )
