"""Exact quantiles of groups too large for one task.

The built-in exact percentile keeps every distinct value of a group in one
aggregation buffer. Here a mergeable sketch first brackets each wanted rank.
Rows inside a bracket are counted per value, rows between brackets only as a
bulk. Counted values are dealt into ranges of their order and ranked range by
range behind the totals of the ranges before, so no task sees more than a range
of them. A bracket that misses its rank is widened and taken again. The result
equals linear interpolation on the sorted group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import with_row
from ..session import cut_lineage

_INF = float("inf")
#: Factor by which a bracket is widened when it has missed its rank.
WIDEN = 16


def exact_quantiles(df: DataFrame, by: list[str], value, probs: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """One row per group with a column per wanted quantile, and the count as `n_values`.

    Without `by` the whole table is one group and one row comes back. The
    result, a row per group, is written once.
    """
    v = F.col(value) if isinstance(value, str) else value
    # NULLs stay in and count as nothing: a filter would be pushed down to the
    # scan and evaluate the whole value expression a second time
    base = df.select(*by, v.cast("double").alias("_v"))
    eps = 4 / accuracy  # the sketch errs by 1/accuracy of the rows
    while True:
        found = cut_lineage(_attempt(base, by, probs, accuracy, eps), "quantiles")
        if eps >= 1 or not found.where("_missed").limit(1).count():
            return found.drop("_missed")
        eps *= WIDEN


def _attempt(base: DataFrame, by: list[str], probs: dict[str, float], accuracy: int, eps: float) -> DataFrame:
    names, ps = list(probs), list(probs.values())
    m = len(ps)
    cuts = [max(p - eps, 0.0) for p in ps] + [min(p + eps, 1.0) for p in ps]
    sketch = base.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", cuts, accuracy).alias("_cut")
    )
    # a rank is fractional, so a bracket needs room for the rows on both sides of it
    tight = F.col("_n") * F.lit(eps) < 2
    bounds = {}
    for i, p in enumerate(ps):
        bounds[f"_lo{i}"] = F.when(tight | F.lit(p - eps <= 0), -_INF).otherwise(F.col("_cut")[i])
        bounds[f"_hi{i}"] = F.when(tight | F.lit(p + eps >= 1), _INF).otherwise(F.col("_cut")[m + i])
    sketch = sketch.withColumns(bounds).drop("_cut")
    tagged = base.join(sketch, by) if by else with_row(base, sketch)

    val = F.col("_v")
    inside, floor = F.lit(False), F.lit(-_INF)
    for i in range(m):
        inside = inside | val.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        floor = F.greatest(floor, F.when(val > F.col(f"_hi{i}"), F.col(f"_hi{i}")).otherwise(-_INF))
    # a bulk row stands right behind the last bracket below it
    counted = (
        tagged.withColumn("_bulk", ~inside)
        .withColumn("_at", F.when(F.col("_bulk"), floor).otherwise(val))
        .groupBy(*by, "_n", "_at", "_bulk")
        .agg(F.count("_v").alias("_c"))
    )
    ranged = counted.repartitionByRange(*by, "_at", "_bulk").withColumn("_range", F.spark_partition_id())
    # ranges are told apart by the tasks that made them, so they are settled before two branches use them
    ranged = cut_lineage(ranged, "ranged")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum("_c").alias("_t"))
        .select(*by, "_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_below"))
    )
    order = Window.partitionBy(*by, "_range").orderBy("_at", "_bulk").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(below, [*by, "_range"]).withColumn("_cum", F.col("_below") + F.sum("_c").over(order))
    n = F.col("_n")

    # the row that holds a rank is the first one whose running count exceeds it
    picks = {}
    for i, p in enumerate(ps):
        k = F.floor((n - 1) * p)
        for side, rank in (("a", k), ("b", F.least(k + 1, n - 1))):
            reached = F.when(F.col("_cum") > rank, F.col("_cum"))
            picks[f"_{side}{i}"] = F.min_by("_at", reached)
            picks[f"_{side}{i}_bulk"] = F.min_by("_bulk", reached)
    found = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *[c.alias(a) for a, c in picks.items()])
    outs, missed = [], F.lit(False)
    for i, p in enumerate(ps):
        h = (n - 1) * p
        frac = h - F.floor(h)
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        missed = missed | F.coalesce(F.col(f"_a{i}_bulk") | ((frac > 0) & F.col(f"_b{i}_bulk")), F.lit(False))
        outs.append((a + F.when(frac > 0, frac * (b - a)).otherwise(0.0)).alias(names[i]))
    return found.select(*by, F.col("_n").alias("n_values"), *outs, missed.alias("_missed"))
