"""Connected components of a distributed list of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _links(pairs: DataFrame) -> DataFrame:
    """Larger end as u, smaller as v, each link once."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `pairs` (u long, v long) that has a link; root is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours likewise, so paths shorten and no list of
    neighbours is gathered. Rounds are written to the shared folder. Empty
    input gives no rows; loops and repeated links change nothing.
    """
    links = cut_lineage(_links(pairs), "links")
    seen = None
    for _ in range(most_rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(_links(small.union(root.select("u", F.col("m").alias("v")))), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
