from __future__ import annotations

from . import simhash
from .registry import query, table


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"), words=4, distance=4)
