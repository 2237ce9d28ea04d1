"""Null and division rules shared by all operators.

Missing values are NULL (never NaN), a division by zero gives NULL, and
results are rounded only at the edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def div(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(_c(a), _c(b))


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = _c(c)
    inf = float("inf")
    return F.when(F.isnan(c) | (c == F.lit(inf)) | (c == F.lit(-inf)), F.lit(None).cast("double")).otherwise(c)


# Prices are often exact decimals, and means of them exact halves of the last
# digit kept. Engines break such ties differently, so values are moved off the
# tie by an amount far below the last digit before they are rounded.
TIE_SHIFT = 1.2345678e-8


def rnd(c, digits: int = 6) -> Column:
    return F.round(_c(c).cast("double") + F.lit(TIE_SHIFT), digits)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def by_date(*keys: str):
    """Window of one series in date order.

    A series holds at most one row per date, so a window partition is bounded
    by the calendar, however much raw data one symbol owns.
    """
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("date")


def trailing(n: int, *keys: str):
    return by_date(*keys).rowsBetween(-(n - 1), 0)


def running(*keys: str):
    return by_date(*keys).rowsBetween(Window.unboundedPreceding, 0)


def with_group_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Add per-group aggregates by aggregate-and-join.

    Unlike a window over the group this never brings one group's rows into
    one task: the aggregate combines map-side and the join is against one row
    per group, which the optimizer broadcasts when it measures it to be small.
    """
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(agg, keys)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as one scalar subquery."""
    one = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_row", one).select(*df.columns, "_row.*")


def _c(x):
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(x)
