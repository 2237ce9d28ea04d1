from __future__ import annotations

from . import weighted_sampling
from .registry import query, table


@query("op13_fingerprints")
def op13_fingerprints(spark, sf_dir):
    return weighted_sampling.edited_likeness(table(spark, sf_dir, "documents"))
