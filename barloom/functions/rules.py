"""Row rules of the market: boards, limits, dates, text topics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import _c

# Price-limit ratios.
LIMIT_NEW = 0.44
LIMIT_ST = 0.05
LIMIT_STAR = 0.20
LIMIT_BEIJING = 0.30
LIMIT_MAIN = 0.10

# Keyword lists of the message topics, in order of priority.
TOPIC_KEYWORDS = {
    "market": ["市场", "行情", "趋势", "指数", "板块", "热点"],
    "strategy": ["策略", "回测", "参数", "优化", "算法", "模型"],
    "stock": ["个股", "股票", "公司", "估值", "基本面", "财务"],
    "factor": ["因子", "量化", "特征", "指标", "相关性", "预测"],
}

# Display names of the topics.
TOPIC_NAMES = {
    "market": "市场分析",
    "strategy": "策略优化",
    "stock": "个股研究",
    "factor": "因子分析",
    "general": "通用问答",
}


def market_type(symbol) -> Column:
    """Board of a stock code, from its prefix."""
    s = _c(symbol)
    return (
        F.when(s.startswith("00"), "main_board")
        .when(s.startswith("30"), "chinext")
        .when(s.startswith("68"), "star_market")
        .when(s.startswith("6"), "main_board")
        .when(s.startswith("8") | s.startswith("4"), "beijing_stock")
        .otherwise("main_board")
    )


def stock_status(symbol) -> Column:
    s = _c(symbol)
    return F.when(s.contains("*ST"), "star_st").when(s.startswith("ST"), "st").otherwise("normal")


def is_new_stock(date, listing_date, threshold_days: int = 30) -> Column:
    return F.coalesce(F.datediff(_c(date), _c(listing_date)) <= threshold_days, F.lit(False))


def limit_ratio(market, status, is_new=None) -> Column:
    """Daily price-limit ratio; a new listing wins over ST, ST over the board."""
    m, s = _c(market), _c(status)
    new = F.lit(False) if is_new is None else _c(is_new)
    return (
        F.when(new, F.lit(LIMIT_NEW))
        .when(s.isin("st", "star_st"), F.lit(LIMIT_ST))
        .when(m == "star_market", F.lit(LIMIT_STAR))
        .when(m == "beijing_stock", F.lit(LIMIT_BEIJING))
        .otherwise(F.lit(LIMIT_MAIN))
    )


def exchange(code) -> Column:
    return F.when(F.substring(_c(code), 1, 2).isin("60", "68", "90"), "SH").otherwise("SZ")


def normalize_date(text) -> Column:
    """Text `yyyy-MM-dd` to date; anything else gives NULL."""
    return F.try_to_timestamp(_c(text), F.lit("yyyy-MM-dd")).cast("date")


def is_trading_day(date) -> Column:
    return F.weekday(_c(date)) < 5


def previous_trading_day(date) -> Column:
    d = _c(date)
    back = F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1)
    return F.date_sub(d, back)


def is_label_rebalance_day(date, frequency: str) -> Column:
    """Rebalance label dates: Friday, calendar month end, or every day.

    A label counts only when it is itself a bar date.
    """
    d = _c(date)
    if frequency == "weekly":
        return F.weekday(d) == 4
    if frequency == "monthly":
        return d == F.last_day(d)
    return F.lit(True)


def valid_symbol(symbol) -> Column:
    return _c(symbol).rlike("^[0-9]{6}$")


def topic_hits(text, keywords: dict[str, list[str]] | None = None) -> Column:
    """Keywords found in the text, in list order."""
    keywords = keywords or TOPIC_KEYWORDS
    low = F.lower(_c(text))
    return F.array_compact(
        F.array(*[F.when(low.contains(k), F.lit(k)) for ks in keywords.values() for k in ks])
    )


def topic(text, keywords: dict[str, list[str]] | None = None) -> Column:
    """First topic with a keyword in the text, else `general`."""
    keywords = keywords or TOPIC_KEYWORDS
    low = F.lower(_c(text))
    out = F
    for name, ks in keywords.items():
        hit = F.lit(False)
        for k in ks:
            hit = hit | low.contains(k)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("general"))


def topic_label(name) -> Column:
    n = _c(name)
    out = F
    for k, v in TOPIC_NAMES.items():
        out = out.when(n == k, F.lit(v))
    return out.otherwise(n)
