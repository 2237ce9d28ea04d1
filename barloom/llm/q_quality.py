from __future__ import annotations

from . import quality
from .registry import query, table


@query("op5_quality")
def op5_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
