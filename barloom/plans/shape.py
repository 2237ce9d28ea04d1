"""Output helpers of the registered queries: same names, types and rounding as the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import TIE_SHIFT, rnd


def rounded(df: DataFrame, keys, cols, digits: int = 6) -> DataFrame:
    """Select `keys` as they are and `cols` as rounded doubles."""
    picks = [F.col(k) if isinstance(k, str) else k for k in keys]
    if isinstance(cols, dict):
        picks += [rnd(c, d).alias(c) for c, d in cols.items()]
    else:
        picks += [rnd(c, digits).alias(c) for c in cols]
    return df.select(*picks)


def q(expr: str, digits: int = 6, name: str | None = None) -> str:
    """SQL twin of `rounded`: moved off ties, rounded, without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE) + {TIE_SHIFT}, {digits}) + 0) AS {name or expr}"


def qs(names, digits: int = 6) -> str:
    return ", ".join(q(n, digits) for n in names)
