from __future__ import annotations

from . import toxicity
from .registry import query, table


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
