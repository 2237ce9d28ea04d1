from __future__ import annotations

from . import suffix_dedup
from .registry import query, table


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
