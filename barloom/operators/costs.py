"""Trading costs as column expressions (SCL_COMMISSION .. SCL_COST, AGG_COST*)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import div, with_row
from .quantiles import exact_quantiles

# Commission rate by broker.
BROKER_RATES = {"discount": 0.0003, "standard": 0.0005, "premium": 0.0008}


@dataclass(frozen=True)
class CostRules:
    """Rates and thresholds of the cost model; `broker="custom"` uses commission_rate."""

    broker: str = "standard"
    commission_rate: float = 0.0003
    commission_min: float = 5.0
    commission_both_ways: bool = True
    stamp_tax_rate: float = 0.001
    stamp_tax_sell_only: bool = True
    transfer_fee_rate: float = 0.00002
    transfer_fee_min: float = 1.0
    transfer_fee_both_ways: bool = True
    transfer_fee_shanghai_only: bool = True
    base_slippage_rate: float = 0.0005
    volume_impact_factor: float = 0.1
    volatility_impact_factor: float = 0.05
    liquidity_threshold: float = 1_000_000.0
    market_impact: bool = True
    large_order_threshold: float = 100_000.0

    @property
    def effective_commission_rate(self) -> float:
        return BROKER_RATES.get(self.broker, self.commission_rate)


STANDARD = CostRules()
DISCOUNT = CostRules(broker="discount", commission_min=1.0, base_slippage_rate=0.0003)
# the broker stays standard here, so the low commission rate has no effect
MINIMAL = CostRules(
    commission_rate=0.0001, commission_min=0.1, transfer_fee_rate=0.00001, base_slippage_rate=0.0001,
    market_impact=False,
)

COMPONENTS = ["commission", "stamp_tax", "transfer_fee", "slippage", "market_impact"]


def commission(rules: CostRules = STANDARD) -> Column:
    c = F.greatest(F.col("amount") * rules.effective_commission_rate, F.lit(rules.commission_min))
    return c if rules.commission_both_ways else F.when(F.col("side") == "sell", 0.0).otherwise(c)


def stamp_tax(rules: CostRules = STANDARD) -> Column:
    c = F.col("amount") * rules.stamp_tax_rate
    return F.when(F.col("side") == "sell", c).otherwise(0.0) if rules.stamp_tax_sell_only else c


def transfer_fee(rules: CostRules = STANDARD) -> Column:
    c = F.greatest(F.col("amount") * rules.transfer_fee_rate, F.lit(rules.transfer_fee_min))
    if not rules.transfer_fee_both_ways:
        c = F.when(F.col("side") == "sell", 0.0).otherwise(c)
    return F.when(F.col("symbol").startswith("6"), c).otherwise(0.0) if rules.transfer_fee_shanghai_only else c


def slippage(rules: CostRules = STANDARD, market_data: bool = True) -> Column:
    base = F.col("amount") * rules.base_slippage_rate
    if not market_data:
        return base
    vol = F.when(
        F.col("avg_volume") > 0, base * div("quantity", "avg_volume") * rules.volume_impact_factor
    ).otherwise(0.0)
    sig = F.when(F.col("volatility") > 0, base * F.col("volatility") * rules.volatility_impact_factor).otherwise(0.0)
    thin = F.when(F.col("avg_volume") < rules.liquidity_threshold, 1.5).otherwise(1.0)
    return F.when(F.col("avg_volume").isNull(), base).otherwise(F.greatest((base + vol + sig) * thin, F.lit(0.0)))


def market_impact(rules: CostRules = STANDARD) -> Column:
    if not rules.market_impact:
        return F.lit(0.0)
    t = rules.large_order_threshold
    base = F.col("amount") * 0.0001 * ((F.col("amount") - t) / t)
    spread = F.coalesce(F.col("amount") * F.col("bid_ask_spread") * 0.5, F.lit(0.0))
    small_cap = F.when(F.col("market_cap") < 10_000_000_000.0, 1.2).otherwise(1.0)
    return F.when(F.col("amount") < t, 0.0).otherwise(F.greatest((base + spread) * small_cap, F.lit(0.0)))


def with_costs(trades: DataFrame, rules: CostRules = STANDARD, market_data: bool = True) -> DataFrame:
    """Add the five components, the total and the rate to a trades table."""
    for c in ("avg_volume", "volatility", "bid_ask_spread", "market_cap"):
        if c not in trades.columns:
            trades = trades.withColumn(c, F.lit(None).cast("double"))
    amount = F.when(F.col("amount") == 0, F.col("quantity") * F.col("price")).otherwise(F.col("amount"))
    df = trades.withColumn("amount", F.coalesce(amount, F.col("quantity") * F.col("price")))
    df = df.withColumns(
        {
            "commission": commission(rules),
            "stamp_tax": stamp_tax(rules),
            "transfer_fee": transfer_fee(rules),
            "slippage": slippage(rules, market_data),
            "market_impact": market_impact(rules),
        }
    )
    total = F.col("commission")
    for c in COMPONENTS[1:]:
        total = total + F.col(c)
    df = df.withColumn("total_cost", total)
    return df.withColumn(
        "cost_rate", F.when(F.col("amount") > 0, div("total_cost", "amount")).otherwise(0.0)
    )


def cost_report(costs: DataFrame) -> DataFrame:
    """One row: totals, cost-rate statistics and quantiles, share of each component in percent."""
    total = F.sum("total_cost")
    a = costs.agg(
        F.count(F.lit(1)).alias("total_trades"),
        total.alias("total_cost"),
        F.sum("amount").alias("total_amount"),
        F.coalesce(div(total, F.sum("amount")), F.lit(0.0)).alias("average_cost_rate"),
        F.avg("cost_rate").alias("rate_mean"),
        F.stddev_samp("cost_rate").alias("rate_std"),
        F.min("cost_rate").alias("rate_min"),
        F.max("cost_rate").alias("rate_max"),
        *[(div(F.sum(c), total) * 100).alias(f"{c}_pct") for c in COMPONENTS],
    )
    names = {"rate_p25": 0.25, "rate_p50": 0.5, "rate_p75": 0.75, "rate_p95": 0.95}
    quant = exact_quantiles(costs, [], "cost_rate", names)
    return with_row(a, quant.drop("n_values"))


ADVICE = {
    "high_cost_rate": "cost rate is high: use a cheaper broker or larger trades",
    "high_commission": "commission dominates: use a cheaper broker",
    "high_slippage": "slippage is high: avoid volatile trading hours",
    "too_frequent": "trading is too frequent",
    "fine": "costs are under control",
}


def cost_advice(costs: DataFrame) -> DataFrame:
    """Advice rows (code, text) that follow from the aggregated costs."""
    a = costs.agg(
        F.avg("cost_rate").alias("rate"),
        div(F.sum("commission"), F.sum("total_cost")).alias("com"),
        div(F.sum("slippage"), F.sum("total_cost")).alias("slip"),
        F.count(F.lit(1)).alias("n"),
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("rate") > 0.005, F.lit("high_cost_rate")),
            F.when(F.col("com") > 0.4, F.lit("high_commission")),
            F.when(F.col("slip") > 0.3, F.lit("high_slippage")),
            F.when(F.col("n") > 1000, F.lit("too_frequent")),
        )
    )
    code = F.explode(F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit("fine")))).alias("code")
    text = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return a.select(code).withColumn("advice", text[F.col("code")])


def cost_impact(
    returns: DataFrame, cost_rate: DataFrame | float, turnover: float = 2.0, key: str = "strategy"
) -> DataFrame:
    """Yearly drag of costs on each strategy's return.

    `cost_rate` is a number or a one-row frame with `average_cost_rate`.
    """
    a = returns.groupBy(key).agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_sd"))
    if isinstance(cost_rate, DataFrame):
        a = a.withColumn("average_cost_rate", cost_rate.select("average_cost_rate").scalar())
    else:
        a = a.withColumn("average_cost_rate", F.lit(float(cost_rate)))
    drag = F.col("average_cost_rate") * turnover
    gross = F.pow(1 + F.col("_m"), F.lit(252.0)) - 1
    net_mean = F.col("_m") - drag / 252
    return a.select(
        key,
        "average_cost_rate",
        drag.alias("annual_cost_drag"),
        gross.alias("gross_annual_return"),
        (gross - drag).alias("net_annual_return"),
        F.coalesce(div(drag, F.abs(gross)), F.lit(0.0)).alias("cost_impact_on_return"),
        F.coalesce(div(net_mean - 0.03 / 252, "_sd") * math.sqrt(252), F.lit(0.0)).alias("cost_adjusted_sharpe_ratio"),
    )
