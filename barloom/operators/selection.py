"""Filters, ordering, paging and set operators (FLT_*, SRT_*, SET_*)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(f"%{v}%"),
    "ilike": lambda c, v: c.ilike(f"%{v}%"),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
    "between": lambda c, v: c.between(v[0], v[1]),
}


def predicate(columns, filters: dict[str, Any]) -> Column:
    """AND of a filter dictionary; unknown columns are skipped.

    A dictionary value names an operator (the first of `_OPS` found counts), a
    list means IN, anything else equality.
    """
    out = F.lit(True)
    for name, want in filters.items():
        if name not in columns:
            continue
        c = F.col(name)
        if isinstance(want, dict):
            op = next((o for o in _OPS if o in want), None)
            if op is not None:
                out = out & _OPS[op](c, want[op])
        elif isinstance(want, list):
            out = out & c.isin(want)
        else:
            out = out & (c == want)
    return out


def apply_filters(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    return df.where(predicate(df.columns, filters))


def get_multi(
    df: DataFrame, skip: int = 0, limit: int = 100, order_by: str | None = None, order_desc: bool = False,
    filters: dict | None = None, tie: list[str] | None = None,
) -> DataFrame:
    """Filter, order, skip and limit; `tie` columns make the order total."""
    if filters:
        df = apply_filters(df, filters)
    order = []
    if order_by:
        order.append(F.col(order_by).desc() if order_desc else F.col(order_by).asc())
    order += [F.col(c) for c in tie or []]
    return (df.orderBy(*order) if order else df).offset(skip).limit(limit)


def clamp_page(page: int, page_size: int, max_page_size: int = 100) -> tuple[int, int]:
    return max(page, 1), min(max_page_size, max(1, page_size))


def paginate(df: DataFrame, order: list, page: int = 1, page_size: int = 10, max_page_size: int = 100) -> DataFrame:
    """One page, each row with total, page count and has_next / has_prev.

    The page is a top-k, not a numbering of the table, so no global sort of all
    rows takes place.
    """
    page, page_size = clamp_page(page, page_size, max_page_size)
    total = df.agg(F.count(F.lit(1)))
    rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    pages = F.ceil(F.col("total") / page_size)
    return rows.withColumn("total", total.scalar()).withColumns(
        {
            "page": F.lit(page),
            "total_pages": pages,
            "has_next": F.lit(page) < pages,
            "has_prev": F.lit(page > 1),
        }
    )


def newest(df: DataFrame, n: int, order_col: str = "date", tie: list[str] | None = None) -> DataFrame:
    """The newest n rows, oldest first."""
    top = df.orderBy(F.col(order_col).desc_nulls_last(), *[F.col(c).desc() for c in tie or []]).limit(n)
    return top.orderBy(order_col, *(tie or []))


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First k rows per group; the planner limits each group map-side as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def aligned(frames: list[DataFrame], value: str = "close") -> DataFrame:
    """Series of any number of symbols on the union of their dates, in long form: date, symbol, value, present, absent.

    `present` symbols have a value on the date and `absent` ones lack it; of
    repeated (date, symbol) rows the largest value counts. No column per
    symbol is made, so the number of symbols is not bounded.
    """
    rows = union_all([f.select("date", "symbol", value) for f in frames]).groupBy("date", "symbol").agg(F.max(value).alias(value))
    per_date = rows.groupBy("date").agg(F.count(F.lit(1)).alias("present"))
    total = rows.agg(F.count_distinct("symbol")).scalar()
    return rows.join(per_date, "date").withColumn("absent", total - F.col("present"))


def page_after(df: DataFrame, order: list[str], after: dict | None = None, page_size: int = 10, max_page_size: int = 100) -> DataFrame:
    """The rows that follow the one with the values `after` of the `order` columns (the first ones without it).

    The condition on the last row's key reaches the scan, so a late page costs
    what the first one costs and nothing before it is sorted or skipped. The
    order columns ascend, hold no nulls and are unique together; `next_of`
    gives the key of the page after.
    """
    _, page_size = clamp_page(1, page_size, max_page_size)
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for c in order:
            beyond = beyond | (same & (F.col(c) > F.lit(after[c])))
            same = same & (F.col(c) == F.lit(after[c]))
        df = df.where((F.col(order[0]) >= F.lit(after[order[0]])) & beyond)
    return df.orderBy(*order).limit(page_size)


def next_of(page: DataFrame, order: list[str]) -> dict | None:
    """Key of a page's last row, or None for an empty page."""
    last = page.orderBy(*[F.col(c).desc() for c in order]).select(*order).first()
    return None if last is None else last.asDict()


def select_query(
    df: DataFrame, sort_by: str = "date", ascending: bool = False, include_volume: bool = True,
    include_amount: bool = True, limit: int = 1000, offset: int = 0, symbols: list[str] | None = None, start=None, end=None,
) -> DataFrame:
    """Bars ordered by a chosen column, with optional columns, from `offset` on; at most 10,000 rows."""
    allowed = {"date", "open", "high", "low", "close", "volume"}
    if sort_by not in allowed:
        raise ValueError(f"cannot sort by {sort_by}")
    cols = ["symbol", "date", "open", "high", "low", "close"]
    cols += ["volume"] * include_volume + ["amount"] * include_amount
    key = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    return df.orderBy(key, "symbol", "date").select(*cols).offset(max(offset, 0)).limit(min(max(limit, 1), 10_000))
