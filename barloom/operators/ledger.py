"""Order fills and position ledger (JN_ASOF_FILL, PPR_*, SCL_FILLPRICE, AGG_SUMMARY ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import div
from ..session import cut_lineage
from .asof import asof_join
from .runs import dealt

SLIPPAGE = 0.001
COMMISSION = 0.0003
INITIAL_CAPITAL = 1_000_000.0


def asof_close(orders: DataFrame, bars: DataFrame, days: int | None = 5) -> DataFrame:
    """Attach the last close up to each order's date, at most `days` days old (of any age with None)."""
    closes = bars.select("symbol", "date", F.col("close").alias("last_close"))
    return asof_join(orders, closes, ["symbol"], "date", ["last_close"], tolerance_days=days)


def fill(orders: DataFrame, bars: DataFrame, days: int | None = 5) -> DataFrame:
    """Fill pending market orders at the as-of close with slippage; without a price they stay pending."""
    df = asof_close(orders, bars, days)
    traded = F.col("quantity") * F.col("fill_price")
    df = df.withColumn("fill_price", fill_price("last_close", "side"))
    return df.withColumns(
        {
            "status": F.when(F.col("fill_price").isNull(), "PENDING").otherwise("FILLED"),
            "commission": traded * COMMISSION,
            "total_amount": traded + traded * COMMISSION,
        }
    )


def fill_price(price: str, side: str) -> Column:
    """Price with slippage against the order: higher for a BUY, lower for a SELL."""
    return F.col(price) * F.when(F.col(side) == "BUY", 1 + SLIPPAGE).otherwise(1 - SLIPPAGE)


def _fold_orders(orders: Column, start_qty: Column) -> Column:
    """Fold a run of orders without knowing the average cost before it.

    The average cost after the run is a * before + b, and the realized profit
    r0 + r1 * before; so runs can be folded in parallel and joined later.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    init = F.struct(
        start_qty.alias("q"), one.alias("a"), zero.alias("b"), zero.alias("r0"), zero.alias("r1")
    )

    def step(s, o):
        qty, px = o["quantity"], o["price"]
        buy = o["side"] == "BUY"
        new_q = F.when(buy, s["q"] + qty).otherwise(s["q"] - qty)
        mixes = buy & (new_q > 0)
        return F.struct(
            new_q.alias("q"),
            F.when(mixes, s["a"] * s["q"] / new_q).otherwise(s["a"]).alias("a"),
            F.when(mixes, (s["b"] * s["q"] + qty * px) / new_q).otherwise(s["b"]).alias("b"),
            F.when(buy, s["r0"]).otherwise(s["r0"] + (px - s["b"]) * qty).alias("r0"),
            F.when(buy, s["r1"]).otherwise(s["r1"] - s["a"] * qty).alias("r1"),
        )

    return F.aggregate(orders, init, step)


def positions(orders: DataFrame, order: tuple[str, ...] = ("date", "seq"), keys: tuple[str, ...] = ("strategy", "symbol")) -> DataFrame:
    """Orders (keys, date, seq, side, quantity, price) to one ledger row per key.

    Weighted average cost on buys, realized profit on sells. A ledger is a
    sequential fold, but its steps are linear in the average cost: blocks of
    orders are folded in parallel, then the blocks of a range, then the ranges
    of a key. So one key may own any share of the orders, on one day too.
    """
    k = list(keys)
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    names = [f"o{i}" for i in range(len(order))]
    place = F.struct(*[F.col(c).alias(n) for c, n in zip(order, names)])
    row = F.struct(place.alias("at"), "side", "quantity", "price")
    blocks = dealt(orders, k, list(order)).groupBy(*k, "_range", "_block").agg(
        F.sum(signed).alias("_dq"),
        F.array_sort(F.collect_list(row)).alias("_o"),
        F.max_by("price", place).alias("_px"),
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col("side") == "BUY", F.col("date"))).alias("_first"),
    )
    # ranges are told apart by the tasks that made them, so they are settled before two branches use them
    blocks = cut_lineage(blocks, "ledger-blocks")
    # quantity before a block: of the ranges below it, and of the blocks before it in its range
    before = lambda by, o: Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    in_range = blocks.withColumn("_q1", F.coalesce(F.sum("_dq").over(before([*k, "_range"], "_block")), F.lit(0.0)))
    last = F.row_number().over(Window.partitionBy(*k, "_range").orderBy(F.desc("_block"))) == 1
    in_range = in_range.withColumn("_last", last)
    ends = in_range.where("_last").select(*k, "_range", (F.col("_q1") + F.col("_dq")).alias("_t"))
    below = ends.select(*k, "_range", F.coalesce(F.sum("_t").over(before(k, "_range")), F.lit(0.0)).alias("_q2"))
    started = in_range.join(below, [*k, "_range"]).withColumn("_s", _fold_orders(F.col("_o"), F.col("_q1") + F.col("_q2"))).drop("_o")

    def joined(df: DataFrame, by: list[str], o: str) -> DataFrame:
        link = F.struct(F.col(o).alias("c"), *[F.col(f"_s.{x}").alias(x) for x in ("a", "b", "r0", "r1")])
        one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("r0"), F.lit(0.0).alias("r1"))
        fold = F.aggregate(
            F.array_sort(F.collect_list(link)),
            one,
            lambda s, x: F.struct(
                (x["a"] * s["a"]).alias("a"),
                (x["a"] * s["b"] + x["b"]).alias("b"),
                (s["r0"] + x["r0"] + x["r1"] * s["b"]).alias("r0"),
                (s["r1"] + x["r1"] * s["a"]).alias("r1"),
            ),
        )
        return df.groupBy(*by).agg(
            F.sum("_dq").alias("_dq"), fold.alias("_s"), F.max_by("_px", o).alias("_px"), F.sum("_n").alias("_n"), F.min("_first").alias("_first")
        )

    per_key = joined(joined(started, [*k, "_range"], "_block"), k, "_range")
    # before the first order nothing is held and nothing earned
    p = per_key.select(
        *k, F.col("_dq").alias("quantity"), F.col("_s.b").alias("_avg"), F.col("_s.r0").alias("_real"), "_px",
        F.col("_n").alias("orders"), F.col("_first").alias("first_buy_date"),
    )
    avg = F.col("_avg")
    value = F.col("quantity") * F.col("_px")
    return p.select(
        *k,
        "orders",
        "quantity",
        avg.alias("avg_cost"),
        (F.col("quantity") * avg).alias("total_cost"),
        F.col("_px").alias("last_price"),
        value.alias("market_value"),
        (value - F.col("quantity") * avg).alias("unrealized_pnl"),
        F.col("_real").alias("realized_pnl"),
        "first_buy_date",
    )


def deviation(pos: DataFrame, backtest: DataFrame) -> DataFrame:
    """Paper return of each open position against the backtest return of its symbol (JN_LOOP_DEVIATION, SCL_DEVIATION)."""
    df = pos.where("quantity != 0").join(backtest.select("symbol", "backtest_return"), "symbol")
    paper = F.when(F.col("total_cost") > 0, div("unrealized_pnl", "total_cost")).otherwise(0.0)
    df = df.withColumn("paper_return", paper).withColumn("deviation", F.col("paper_return") - F.col("backtest_return"))
    return df.withColumns(
        {
            "slippage": F.abs("deviation") * 0.5,
            "execution_quality_score": F.greatest(F.lit(0.0), 1.0 - F.abs("deviation") * 10),
        }
    )


def summary(pos: DataFrame, orders: DataFrame, today, initial: float = INITIAL_CAPITAL) -> DataFrame:
    """Portfolio overview per strategy; cash is the initial capital less the stock value.

    Only open positions count; a strategy that has sold everything keeps its cash row.
    """
    is_open = F.col("quantity") != 0
    of_open = lambda c: F.coalesce(F.sum(F.when(is_open, F.col(c))), F.lit(0.0))
    held = pos.groupBy("strategy").agg(
        of_open("market_value").alias("stock_value"),
        of_open("unrealized_pnl").alias("today_pnl"),
        of_open("realized_pnl").alias("_real"),
        F.count_if(is_open).alias("positions_count"),
    )
    placed = orders.where(F.col("date") >= F.lit(today)).groupBy("strategy").agg(F.count(F.lit(1)).alias("orders_count"))
    df = held.join(placed, "strategy", "left").fillna(0, ["orders_count"])
    pnl = F.col("today_pnl") + F.col("_real")
    return df.select(
        "strategy",
        F.lit(float(initial)).alias("total_value"),
        (initial - F.col("stock_value")).alias("cash_balance"),
        "stock_value",
        pnl.alias("total_pnl"),
        (pnl / initial).alias("total_pnl_ratio"),
        "today_pnl",
        "positions_count",
        "orders_count",
    )


def account(pos: DataFrame) -> DataFrame:
    """Market value, profit, cost and profit ratio over all positions."""
    a = pos.agg(F.sum("market_value").alias("market_value"), F.sum("unrealized_pnl").alias("total_pnl"), F.sum("total_cost").alias("_c"))
    return a.select(
        "market_value", "total_pnl", F.when(F.col("_c") > 0, div("total_pnl", "_c")).otherwise(0.0).alias("total_pnl_ratio")
    )
