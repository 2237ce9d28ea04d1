"""Registered queries and the SQL text each one is checked against.

Dates leave a registered query as `yyyy-MM-dd` text, so that both engines
hand over the same values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = ""):
    """Register `fn(spark, sf_dir) -> DataFrame`, optionally with its check SQL."""
    cols = dates.split()

    def deco(fn):
        assert name not in QUERIES, name

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols}) if cols else df

        QUERIES[name] = run
        if sql is not None:
            if cols:
                text = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in cols)
                CHECKS[name] = f"SELECT * REPLACE ({text}) FROM (\n{sql}\n)"
            else:
                CHECKS[name] = sql
        return fn

    return deco


dated = partial(query, dates="date")
