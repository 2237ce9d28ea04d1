"""Operators as Spark ML pipeline stages (UDF_INDICATOR, UDF_MODEL)."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

from .indicators import ALL_FAMILIES, all_indicators


class IndicatorTransformer(Transformer):
    """Technical indicators as a transformer, to stand in front of an estimator."""

    def __init__(self, families=ALL_FAMILIES, **params):
        super().__init__()
        self.families = tuple(families)
        self.params_by_family = params

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return all_indicators(dataset, self.families, **self.params_by_family)
