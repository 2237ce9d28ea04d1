"""Vendor landing frames to standard tables (SRC_STDCOLS .. SRC_INDEX)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.guards import finite

# Vendor headers of daily bars.
BAR_HEADERS = {
    "日期": "date", "开盘": "open_price", "收盘": "close_price", "最高": "high_price", "最低": "low_price",
    "成交量": "volume", "成交额": "amount", "涨跌幅": "pct_change", "涨跌额": "change", "换手率": "turnover",
}
BAR_COLUMNS = ["date", "open_price", "close_price", "high_price", "low_price", "volume", "amount"]

# Vendor headers of fundamentals.
FUNDAMENTAL_HEADERS = {
    "每股收益": "eps", "净资产收益率": "roe", "营业收入": "operating_revenue", "净利润": "net_profit",
    "总资产": "total_assets", "总负债": "total_liabilities", "销售毛利率": "gross_profit_margin",
    "资产负债比率": "debt_to_asset_ratio",
}

# Vendor headers of the quote snapshot.
QUOTE_HEADERS = {
    "代码": "symbol", "名称": "name", "最新价": "latest_price", "涨跌幅": "change_pct", "涨跌额": "change_amount",
    "成交量": "volume", "成交额": "amount", "今开": "open_price", "最高": "high_price", "最低": "low_price",
    "昨收": "pre_close",
}


def standardize(df: DataFrame) -> DataFrame:
    """Rename vendor headers, read dates and numbers (bad ones NULL), keep the standard columns."""
    df = df.withColumnsRenamed({k: v for k, v in BAR_HEADERS.items() if k in df.columns})
    keys = [c for c in ("symbol", "name") if c in df.columns]
    have = [c for c in BAR_COLUMNS if c in df.columns]
    read = {c: finite(F.col(c).try_cast("double")) for c in have if c != "date"}
    read["date"] = F.col("date").try_cast("date")
    return df.withColumns(read).select(*keys, *have)


def to_bars(df: DataFrame) -> DataFrame:
    """Standard frame to bars: missing prices and volume are 0, a missing amount stays NULL."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in BAR_COLUMNS if c not in ("date", "amount")}
    short = {f"{c}_price": c for c in ("open", "high", "low", "close")}
    return df.withColumns(zero).withColumnsRenamed(short)


def symbol_list(df: DataFrame, market: str = "all") -> DataFrame:
    """Zero-padded codes with exchange; `sh` and `sz` filter by prefix."""
    code = F.lpad(F.col("code").cast("string"), 6, "0")
    out = df.select(code.alias("symbol"), F.col("name").cast("string").alias("name"))
    two = F.substring("symbol", 1, 2)
    if market == "sh":
        out = out.where(two.isin("60", "68", "90"))
    elif market == "sz":
        out = out.where(two.isin("00", "30", "20"))
    return out.withColumn("exchange", rules.exchange("symbol"))


def latest_fundamentals(df: DataFrame) -> DataFrame:
    """Newest quarter per symbol, vendor headers renamed."""
    cols = [F.col(k).cast("double").alias(v) for k, v in FUNDAMENTAL_HEADERS.items() if k in df.columns]
    picked = df.groupBy("symbol").agg(F.max("季度").alias("date"), F.max_by(F.struct(*cols), "季度").alias("_r"))
    return picked.select("symbol", "date", "_r.*")


def industry_classification(df: DataFrame) -> DataFrame:
    """Attribute rows (symbol, seq, item, value) to industry and sector list.

    The last industry row counts; sectors keep their order. The list of one
    symbol is bounded by the attributes a vendor delivers per symbol.
    """
    is_ind = F.col("item").contains("行业")
    is_sec = ~is_ind & (F.col("item").contains("板块") | F.col("item").contains("概念"))
    a = df.groupBy("symbol").agg(
        F.max_by(F.when(is_ind, F.col("value")), F.when(is_ind, F.col("seq"))).alias("industry"),
        F.array_sort(F.collect_list(F.when(is_sec, F.struct("seq", "value")))).alias("_s"),
    )
    return a.select("symbol", "industry", F.transform("_s", lambda x: x["value"]).alias("sectors")).where(
        F.col("industry").isNotNull() | (F.size("sectors") > 0)
    )


def quotes(df: DataFrame, symbol: str | None = None, at: Column | None = None) -> DataFrame:
    """Quotes by their field names, with the time they were taken at (now by default)."""
    if symbol is not None:
        df = df.where(F.col("代码") == symbol)
    text = ("代码", "名称")
    return df.select(
        *[(F.col(k) if k in text else F.col(k).cast("double")).alias(v) for k, v in QUOTE_HEADERS.items()],
        (F.current_timestamp() if at is None else at).alias("timestamp"),
    )


def trading_calendar(dates: DataFrame, year: int) -> DataFrame:
    return dates.where(F.year("trade_date") == year).select("trade_date").distinct().orderBy("trade_date")


def index_bars(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None, today: dt.date | None = None) -> DataFrame:
    """Index bars of a date range, by default the last 365 days."""
    end = end or today or dt.date.today()
    start = start or end - dt.timedelta(days=365)
    out = df.where(F.col("date").between(start, end))
    return out.withColumnsRenamed({c: f"{c}_price" for c in ("open", "high", "low", "close")})
