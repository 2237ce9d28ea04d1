"""Model training on Spark ML (ML_*)."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator,
)
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .indicators import lag_features, ma_features, target
from .quality import numeric_columns

# what a missing feature becomes inside a model
MISSING, FILLED = "1e300", "_filled_"
#: Models trained side by side; each keeps its rows cached while it trains.
TOGETHER = 3
DEFAULTS = {"maxDepth": 6, "stepSize": 0.1, "maxIter": 100, "seed": 42}


def prepare(
    features: DataFrame, kind: str = "return", horizon: int = 1, lookback: int = 30, cols: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Features with lags, trailing means and target; incomplete rows dropped.

    Lags and targets stay within a symbol.
    """
    cols = cols or numeric_columns(features)
    lags = [k for k in (1, 2, 3, 5) if k <= lookback]
    windows = [n for n in (5, 10, 20) if n <= lookback]
    df = ma_features(lag_features(target(features, kind, horizon), cols, lags), cols, windows)
    all_cols = cols + [f"{c}_lag_{k}" for k in lags for c in cols] + [f"{c}_ma_{n}" for n in windows for c in cols]
    return df.select("symbol", "date", *all_cols, "target").dropna(), all_cols


def _cut(df: DataFrame, per: list, position: int) -> Column:
    """Condition of the rows before `position` in (date, symbol) order; `per` has the rows of each date in order."""
    before = 0
    for date, n in per:
        if position < before + n:
            # the symbol at the cut; a date's rows are told apart by symbol
            names = df.where(F.col("date") == F.lit(date)).select("symbol").orderBy("symbol")
            at = names.offset(position - before).limit(1).first()[0] if position > before else None
            earlier = F.col("date") < F.lit(date)
            return earlier if at is None else earlier | ((F.col("date") == F.lit(date)) & (F.col("symbol") < F.lit(at)))
        before += n
    return F.lit(True)


def time_split(df: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Label rows train, validation or test by their place in (date, symbol) order.

    The rows of each date are counted (the calendar bounds them) and the symbol
    is looked up at which a cut runs through its date; the label then follows
    from a row's own date and symbol, and `df` is neither joined nor shuffled.
    `df` is read for each of these, so a costly one should be stored. A symbol
    has one row per date.
    """
    per = [tuple(r) for r in df.groupBy("date").count().orderBy("date").collect()]
    total = sum(n for _, n in per)
    a, b = (_cut(df, per, math.floor(total * share)) for share in (train, train + validation))
    return df.withColumn("split", F.when(a, "train").when(b, "validation").otherwise("test"))


def time_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Add `fold` 0..folds by date: fold k is tested on a model of folds 0..k-1.

    The distinct dates (the calendar bounds them) are dealt in order, the first
    folds taking one more; the fold then follows from a row's own date, so
    `df` is neither joined nor shuffled. Rows without a date have no fold.
    """
    days = [d for (d,) in df.select("date").distinct().orderBy("date").collect()]
    each, more = divmod(len(days), folds + 1)
    fold, at = F.lit(None).cast("int"), len(days)
    for k in reversed(range(min(folds + 1, len(days)))):
        last, at = days[at - 1], at - each - (k < more)
        if last is not None:
            fold = F.when(F.col("date") <= F.lit(last), k).otherwise(fold)
    return df.withColumn("fold", fold).where("date IS NOT NULL")


def _stage(kind: str, params: dict):
    if kind == "regression":
        return GBTRegressor(labelCol="label", featuresCol="features", **params)
    if kind == "binary":
        return GBTClassifier(labelCol="label", featuresCol="features", **params)
    if kind == "multiclass":
        p = {k: v for k, v in params.items() if k not in ("maxIter", "stepSize")}
        unknown = [k for k in p if not RandomForestClassifier.hasParam(RandomForestClassifier(), k)]
        if unknown or params["stepSize"] != DEFAULTS["stepSize"]:
            raise ValueError(f"a random forest has no {', '.join(unknown) or 'stepSize'}")
        return RandomForestClassifier(labelCol="label", featuresCol="features", **{"numTrees": params["maxIter"], **p})
    raise ValueError(kind)


# trainers by name; a plug-in adds its own
TRAINERS = {}


def register_trainer(name: str, build) -> None:
    """`build(params) -> Estimator` reading `features` and `label`."""
    TRAINERS[name] = build


def train(df: DataFrame, cols: list[str], kind: str = "regression", label: str = "target", **params) -> PipelineModel:
    """Gradient-boosted trees (random forest for more than two classes), or a registered trainer.

    A missing feature counts as larger than any number, so every row is used
    and predicted. For a forest `maxIter` is the number of trees; a parameter
    it does not know raises.
    """
    params = {**DEFAULTS, **params}
    filled = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), {MISSING}), {MISSING}) AS `{FILLED}{c}`" for c in cols)
    stages = [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[FILLED + c for c in cols], outputCol="features"),
    ]
    if kind == "multiclass" or dict(df.dtypes)[label] == "string":
        stages.append(StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"))
    else:
        df = df.withColumn("label", F.col(label).cast("double"))
    stages.append(TRAINERS[kind](params) if kind in TRAINERS else _stage(kind, params))
    model = Pipeline(stages=stages).fit(df)
    if kind == "multiclass":
        labels = next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels
        model.stages.append(IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels))
    return model


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds `prediction` (and `predicted_label`); works on rows without a label."""
    out = df
    for s in model.stages:
        if not s.__class__.__name__.startswith("StringIndexer"):
            out = s.transform(out)
    return out.drop(*[c for c in out.columns if c.startswith(FILLED)])


def predict_proba(model: PipelineModel, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return predict(model, df).withColumn("proba", vector_to_array("probability"))


def importances(model: PipelineModel, cols: list[str]) -> list[tuple[str, float]]:
    tree = next(s for s in model.stages if hasattr(s, "featureImportances"))
    v = tree.featureImportances.toArray()
    return sorted(zip(cols, map(float, v)), key=lambda p: (-p[1], p[0]))


def importance_table(spark, model: PipelineModel, cols: list[str]) -> DataFrame:
    return spark.createDataFrame(importances(model, cols), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def evaluator(kind: str, metric: str | None = None):
    if kind == "regression":
        return RegressionEvaluator(labelCol="label", metricName=metric or "r2")
    if metric in ("areaUnderROC", "areaUnderPR"):
        return BinaryClassificationEvaluator(labelCol="label", metricName=metric)
    return MulticlassClassificationEvaluator(labelCol="label", metricName=metric or "accuracy")


def score(model: PipelineModel, df: DataFrame, kind: str, label: str = "target", metric: str | None = None) -> float:
    indexer = next((s for s in model.stages if isinstance(s, StringIndexerModel)), None)
    if indexer:  # a class that training has not seen gets an index no prediction has
        df = indexer.copy().setHandleInvalid("keep").transform(df)
    else:
        df = df.withColumn("label", F.col(label).cast("double"))
    out = predict(model, df)
    return float(evaluator(kind, metric).evaluate(out))


def _together(run, inputs, spark) -> list:
    """`run` of each input, in their order, `TOGETHER` at a time.

    A model is trained in hundreds of short passes over its rows; cores that
    one of them leaves idle at its end, another model's can use.
    """
    with ThreadPool(TOGETHER) as pool:
        return pool.map(inheritable_thread_target(spark)(run), inputs, chunksize=1)


@dataclass
class CrossValidation:
    params: dict
    scores: list[float] = field(default_factory=list)

    @property
    def mean(self) -> float:
        return sum(self.scores) / len(self.scores)

    @property
    def std(self) -> float:
        m = self.mean
        return (sum((s - m) ** 2 for s in self.scores) / len(self.scores)) ** 0.5


def cross_validate(
    df: DataFrame, cols: list[str], kind: str = "regression", folds: int = 5, metric: str | None = None, **params
) -> CrossValidation:
    """Expanding window: every fold is scored by a model of all earlier dates."""
    fd = time_folds(df, folds)

    def one(k: int) -> float:
        m = train(fd.where(F.col("fold") < k), cols, kind, **params)
        return score(m, fd.where(F.col("fold") == k), kind, metric=metric)

    return CrossValidation(params, _together(one, range(1, folds + 1), df.sparkSession))


def grid_search(
    df: DataFrame, cols: list[str], grid: dict[str, list], kind: str = "regression", folds: int = 3,
    metric: str | None = None,
) -> list[CrossValidation]:
    """Every combination of the grid, best first.

    Regression is scored by mean squared error (lower is better), two classes
    by area under ROC, more by weighted F1.
    """
    metric = metric or {"regression": "mse", "binary": "areaUnderROC"}.get(kind, "weightedFMeasure")
    names = list(grid)
    runs = [
        cross_validate(df, cols, kind, folds, metric, **dict(zip(names, values)))
        for values in itertools.product(*grid.values())
    ]
    return sorted(runs, key=lambda r: r.mean if metric in ("mse", "rmse", "mae") else -r.mean)


def train_many(df: DataFrame, cols: list[str], configs: dict[str, dict]) -> dict[str, PipelineModel | Exception]:
    """Train several configurations; a failing one leaves its error and stops no other."""

    def one(cfg: dict) -> PipelineModel | Exception:
        try:
            return train(df, cols, **cfg)
        except Exception as e:  # noqa: BLE001
            return e

    return dict(zip(configs, _together(one, configs.values(), df.sparkSession)))
