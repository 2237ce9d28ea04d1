"""Views over the supplied star-schema tables in the shape the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks_to_bars(ticks: DataFrame) -> DataFrame:
    """Ticks (symbol, date, seq, price, quantity, amount) to one bar per symbol and date.

    `seq` is a number that orders the ticks of a day. Everything is an algebraic aggregate: each map task sends at most one row
    per (symbol, date), so a symbol that owns a third of the ticks adds no
    skew to the shuffle.
    """
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("quantity").alias("volume"),
        F.round(F.sum("amount"), 2).alias("amount"),
    )


def _two_part_key(high, low):
    """(high, low) as one exact number, low below 1e18.

    A decimal of any precision fits a hash aggregate's buffer, a struct does
    not: ordering by a struct would sort all raw rows before aggregating them.
    """
    return high.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + low.cast("decimal(18,0)")


def _line_key():
    """Arrival order within a day: order and line; price and quantity decide between copies."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rest = F.round(F.col("l_extendedprice") * 100).cast("long") * 1000 + F.col("l_quantity").cast("long")
    return line, rest


def _lineitem_ticks(li: DataFrame, symbol, date) -> DataFrame:
    return li.select(
        symbol.alias("symbol"),
        date.alias("date"),
        _two_part_key(*_line_key()).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
    )


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one symbol per part brand."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    return ticks_to_bars(
        _lineitem_ticks(joined, F.col("p_brand"), F.col("l_shipdate").cast("date"))
    )


def bars_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month bars: one six-digit symbol per supplier, with the volume-weighted price."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    code = F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    bars = ticks_to_bars(_lineitem_ticks(li, code, month))
    return bars.withColumn("vwap", (F.col("amount") / F.col("volume")))


def prices_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, close): monthly volume-weighted prices.

    Built from sums alone, so it skips the first/last bookkeeping of bars.
    """
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    return (
        li.groupBy(
            F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol"),
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"),
        )
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.sum("l_quantity").alias("volume"))
        .select("symbol", "date", (F.col("amount") / F.col("volume")).alias("close"), "volume")
    )


def bars_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event values, one symbol per event type."""
    ev = table(spark, sf_dir, "events")
    return ticks_to_bars(
        ev.select(
            F.col("event_type").alias("symbol"),
            F.col("ts").cast("date").alias("date"),
            _two_part_key(
                F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")
            ).alias("seq"),
            F.col("value").alias("price"),
            F.lit(1.0).alias("quantity"),
            F.col("value").alias("amount"),
        )
    )


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, industry): nation of the suppliers that are not in debt; the others have no known industry."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal >= 0")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("symbol"),
        F.col("n_name").alias("industry"),
    )


def returns_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, date, ret): mean discount above par per flag pair and day."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("strategy"),
            F.col("l_shipdate").cast("date").alias("date"),
        )
        .agg(F.round(F.avg("l_discount") - 0.05, 8).alias("ret"))
    )


def returns_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, bench): mean tax above par per day."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.round(F.avg("l_tax") - 0.04, 8).alias("bench"))
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades; returned items are sells, suppliers are symbols."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        # a leading digit 6 for even suppliers puts half the codes on the Shanghai board
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("6"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")))
        .otherwise(F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
        .alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_partkey") * 5000).cast("double").alias("avg_volume"),
        F.col("l_tax").alias("volatility"),
        (F.col("l_discount") / 100).alias("bid_ask_spread"),
        (F.col("l_linenumber") * 3.0e9).alias("market_cap"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as HTTP request rows."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.lit("GET").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.col("ts"),
        F.col("event_id").alias("request_id"),
        F.col("value").alias("response_time"),
        F.when(F.col("user_id") % 10 == 0, 500)
        .when(F.col("user_id") % 7 == 0, 404)
        .otherwise(200)
        .alias("status_code"),
    )


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as filled orders: strategy = line status, symbol = part brand."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_linestatus").alias("strategy"),
        F.col("p_brand").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        _two_part_key(*_line_key()).alias("seq"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, date, seq, y_true, y_pred): each flag pair is a model."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
        ).alias("seq"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_orderkey").alias("row_id"),
        F.round(F.col("l_discount") - 0.05, 4).alias("y_true"),
        F.round(F.col("l_tax") - 0.04, 4).alias("y_pred"),
    )
