from __future__ import annotations

from . import ann
from .registry import query, table


@query("op4_ann")
def op4_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)
