"""Rebalance decisions and trades (JN_FULL_WEIGHTS, REB_*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def align(current: DataFrame, target: DataFrame, keys=("portfolio", "symbol")) -> DataFrame:
    """Full outer alignment of two weight tables; a missing name weighs 0."""
    a = current.select(*keys, F.col("weight").alias("current_weight"))
    b = target.select(*keys, F.col("weight").alias("target_weight"))
    return a.join(b, list(keys), "full_outer").fillna(0.0, ["current_weight", "target_weight"])


def drift(current: DataFrame, target: DataFrame, keys=("portfolio", "symbol")) -> DataFrame:
    return _drift_of(align(current, target, keys), keys)


def _drift_of(aligned: DataFrame, keys) -> DataFrame:
    group = [k for k in keys if k != "symbol"]
    return aligned.groupBy(*group).agg(
        F.sum(F.abs(F.col("current_weight") - F.col("target_weight"))).alias("drift")
    )


def trades(
    current: DataFrame, target: DataFrame, value: float = 1_000_000.0, min_trade: float = 0.01,
    cost: float | None = 0.001, keys=("portfolio", "symbol"),
) -> DataFrame:
    """Weight changes of at least `min_trade` as trades; order them by `abs_value` for a report."""
    return _trades_of(align(current, target, keys), value, min_trade, cost)


def _trades_of(aligned: DataFrame, value: float, min_trade: float = 0.01, cost: float | None = 0.001) -> DataFrame:
    df = aligned.withColumn("weight_change", F.col("target_weight") - F.col("current_weight"))
    df = df.where(F.abs("weight_change") >= min_trade)
    moved = F.col("weight_change") * value
    df = df.withColumns(
        {
            "value_change": moved,
            "side": F.when(F.col("weight_change") > 0, "BUY").otherwise("SELL"),
            "abs_value": F.abs(moved),
        }
    )
    return df.withColumn("transaction_cost", F.col("abs_value") * cost) if cost is not None else df


def execute(
    decisions: DataFrame, current: DataFrame, target: DataFrame, value: float = 1_000_000.0, **kw
) -> tuple[DataFrame, DataFrame]:
    """Trades and statistics of the portfolios whose decision row says `rebalance`.

    `decisions` carries portfolio, date and rebalance.
    """
    go = decisions.where("rebalance").select("portfolio", F.col("date").alias("rebalance_date"))
    # trades and drift both read the aligned weights: write them once
    aligned = cut_lineage(align(current, target).join(go.select("portfolio"), "portfolio", "left_semi"), "aligned")
    tr = _trades_of(aligned, value, **kw)
    sums = tr.groupBy("portfolio").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.sum("abs_value").alias("total_turnover"),
        F.sum("transaction_cost").alias("total_cost"),
    )
    stats = (
        go.join(sums, "portfolio", "left")
        .join(_drift_of(aligned, ("portfolio", "symbol")).withColumnRenamed("drift", "drift_before"), "portfolio", "left")
        .fillna(0, ["n_trades", "total_turnover", "total_cost"])
    )
    return tr, stats


def scheduled(date: Column, last: Column, frequency: str, weekday: int = 0, month_day: int = 1) -> Column:
    """Is a rebalance due on `date` when the last one was on `last` (NULL: always due)?"""
    days = F.datediff(date, last)
    on_day = F.weekday(date) == weekday
    due = {
        "daily": F.lit(True),
        "weekly": (days >= 7) & on_day,
        "biweekly": (days >= 14) & on_day,
        "monthly": (F.month(date) != F.month(last)) & (F.dayofmonth(date) >= month_day),
        "quarterly": (F.year(date) - F.year(last)) * 12 + F.month(date) - F.month(last) >= 3,
    }[frequency]
    return last.isNull() | due


def triggers(
    drifts: DataFrame, kind: str = "scheduled", frequency: str = "weekly", threshold: float = 0.05,
    weekday: int = 0, month_day: int = 1,
) -> DataFrame:
    """Dates on which each portfolio rebalances, from (portfolio, date, drift).

    Whether a date is due depends on the last date taken, so the dates of a
    portfolio are folded in order. The array holds one entry per calendar day.
    """
    if kind == "threshold":
        return drifts.where(F.col("drift") > threshold).select("portfolio", "date")

    def step(acc, x):
        due = scheduled(x["date"], F.element_at(acc, -1), frequency, weekday, month_day)
        if kind == "hybrid":
            due = due | (x["drift"] > threshold)
        return F.when(due, F.concat(acc, F.array(x["date"]))).otherwise(acc)

    days = drifts.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("date", "drift"))).alias("d"))
    # element_at of an empty array raises, so the first date seeds the fold
    first = F.array(F.col("d")[0]["date"])
    taken = F.aggregate(F.slice("d", 2, F.greatest(F.size("d") - 1, F.lit(0))), first, step)
    return days.select("portfolio", F.explode(taken).alias("date"))


def schedule(spans: DataFrame, frequency: str = "weekly", weekday: int = 0, month_day: int = 1) -> DataFrame:
    """All scheduled dates between `start` and `end` of each input row."""
    keep = [c for c in spans.columns if c not in ("start", "end")]
    days = spans.select(*keep, F.explode(F.sequence("start", "end")).alias("date"))
    if frequency == "weekly":
        return days.where(F.weekday("date") == weekday)
    if frequency == "monthly":
        return days.where(F.dayofmonth("date") == month_day)
    if frequency == "daily":
        return days
    return days.where(F.lit(False))


