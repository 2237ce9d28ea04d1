"""Ordered folds of series of any length.

A fold that is associative over stretches is taken in levels: rows are dealt
into ranges of their order, each range is cut into blocks of a bounded number
of rows, blocks are folded one by one, then the blocks of a range, then the
ranges of a key. No array holds more than a block's rows, a range's blocks or a
key's ranges, whichever share of the rows a key owns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1000


def dealt(df: DataFrame, keys: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """Add `_range` and `_block`: ascending with `order` within a key, at most `block` rows in each."""
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return ranged.withColumn("_block", F.floor(place / block))
