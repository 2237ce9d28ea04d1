"""As-of joins: each row meets the newest row of the other side that is not later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    at: str,
    columns: list[str],
    right_at: str | None = None,
    tolerance_days: int | None = None,
    matched_at: str | None = None,
) -> DataFrame:
    """`left` with `columns` of the newest row of `right` that has the same keys and is not later than `at`.

    Rows of any age count, or those at most `tolerance_days` old. Both sides
    are merged into one order and dealt into ranges of it, so a key may own
    any share of the rows: within a range the last row of `right` is carried
    forward, and what a range ends with is handed to the ranges after it. Of
    several rows of `right` at one time the one with the largest values
    counts. Rows of `right` without key or time take no part; rows of `left`
    without a match keep nulls. `matched_at` names a column for the time met.
    """
    right_at = right_at or at
    value = F.struct(F.col(right_at).alias("at"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    known = right.dropna(subset=[*keys, right_at]).select(*keys, F.col(right_at).alias(at), value.alias("_value"))
    asked = left.withColumns({"_asked": F.lit(1), "_value": F.lit(None).cast(known.schema["_value"].dataType)})
    merged = asked.unionByName(known, allowMissingColumns=True).withColumn("_asked", F.coalesce("_asked", F.lit(0)))
    order = [at, "_asked", "_value"]
    ranged = merged.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    # ranges are told apart by the tasks that made them, so they are settled before two branches use them
    ranged = cut_lineage(ranged, "asof")
    last = F.last("_value", ignorenulls=True)
    here = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy(*keys, "_range").agg(F.max("_value").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    carried = carried.where("_carried IS NOT NULL")
    found = ranged.withColumn("_here", last.over(here)).where("_asked = 1")
    value = F.coalesce("_here", "_carried")
    out = found.join(carried, [*keys, "_range"], "left").withColumn("_value", value)
    if tolerance_days is not None:
        fresh = F.datediff(at, F.col("_value.at")) <= tolerance_days
        out = out.withColumn("_value", F.when(fresh, F.col("_value")))
    picks = [F.col(f"_value.v{i}").alias(c) for i, c in enumerate(columns)]
    if matched_at:
        picks.append(F.col("_value.at").alias(matched_at))
    return out.select(*left.columns, *picks)
