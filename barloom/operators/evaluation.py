"""Evaluation of predictions (EV_*, WIN_ROLLACC).

Input is predictions(model, ..., y_true, y_pred), any number of rows per model:
everything is an aggregate by model, order statistics come from
`exact_quantiles`, and the drawdown of the prediction series from folds of
sorted ranges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import div
from .quantiles import exact_quantiles

# Metrics for which a larger value ranks first; all others rank
# lower-is-better, `correlation` and `max_drawdown` included.
HIGHER_BETTER = [
    "r2", "accuracy", "precision", "recall", "f1", "roc_auc", "auc_hard", "sharpe_ratio", "information_ratio", "hit_rate",
    "directional_accuracy", "calmar_ratio", "sortino_ratio",
]

BASIC = ["y_true_mean", "y_true_std", "y_pred_mean", "y_pred_std", "residual_mean", "residual_std", "correlation"]
REGRESSION = [
    "mse", "mae", "rmse", "r2", "mape", "explained_variance", "max_error", "median_absolute_error", "mean_bias",
    "normalized_rmse",
]
CLASSIFICATION = [
    "accuracy", "precision", "recall", "f1", "precision_macro", "recall_macro", "f1_macro", "auc_hard",
    "true_negative_rate", "false_positive_rate", "false_negative_rate",
]
FINANCIAL = [
    "sharpe_ratio", "hit_rate", "directional_accuracy", "max_drawdown", "calmar_ratio", "sortino_ratio", "var_95",
    "cvar_95",
]


def basic(pred: DataFrame, key: str = "model") -> DataFrame:
    r = F.col("y_pred") - F.col("y_true")
    return pred.groupBy(key).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("y_true").alias("y_true_mean"),
        F.stddev_pop("y_true").alias("y_true_std"),
        F.avg("y_pred").alias("y_pred_mean"),
        F.stddev_pop("y_pred").alias("y_pred_std"),
        F.avg(r).alias("residual_mean"),
        F.stddev_pop(r).alias("residual_std"),
        F.coalesce(F.corr("y_true", "y_pred"), F.lit(0.0)).alias("correlation"),
    )


def regression(pred: DataFrame, key: str = "model") -> DataFrame:
    e = F.col("y_pred") - F.col("y_true")
    a = pred.groupBy(key).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop("y_true").alias("_vy"),
        F.var_pop(e).alias("_ve"),
        F.bool_or(F.col("y_true") == 0).alias("_zero"),
        F.avg(F.abs(div(e, "y_true"))).alias("_mape"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(e).alias("mean_bias"),
    )
    med = exact_quantiles(pred, [key], F.abs(e), {"median_absolute_error": 0.5}).drop("n_values")
    rmse = F.sqrt("mse")
    return a.join(med, key).select(
        key,
        "mse",
        "mae",
        rmse.alias("rmse"),
        (1 - div("mse", "_vy")).alias("r2"),
        F.when(~F.col("_zero"), F.col("_mape")).alias("mape"),
        (1 - div("_ve", "_vy")).alias("explained_variance"),
        "max_error",
        "median_absolute_error",
        "mean_bias",
        div(rmse, F.sqrt("_vy")).alias("normalized_rmse"),
    )


def classification(pred: DataFrame, key: str = "model") -> DataFrame:
    """Accuracy, weighted and macro scores from the confusion counts.

    `auc_hard` is the area for two classes when labels stand in for scores.
    """
    cm = pred.groupBy(key, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("c"))
    # cm has one row per pair of classes; all that follows is tiny
    act = cm.groupBy(key, F.col("y_true").alias("k")).agg(
        F.sum("c").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("c")).otherwise(0)).alias("tp")
    )
    prd = cm.groupBy(key, F.col("y_pred").alias("k")).agg(F.sum("c").alias("predicted"))
    per = act.join(prd, [key, "k"], "full_outer").fillna(0, ["support", "tp", "predicted"])
    p = F.coalesce(div("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(div("tp", "support"), F.lit(0.0))
    per = per.withColumns({"p": p, "r": r}).withColumn(
        "f", F.coalesce(div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    )
    n = F.sum("support")
    scores = per.groupBy(key).agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("p") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / n).alias("f1"),
        F.avg("p").alias("precision_macro"),
        F.avg("r").alias("recall_macro"),
        F.avg("f").alias("f1_macro"),
        F.count(F.lit(1)).alias("_k"),
        F.min("k").alias("_neg"),
        F.max("k").alias("_pos"),
    )
    two = cm.join(scores.select(key, "_k", "_neg", "_pos"), key).where("_k = 2")
    cell = lambda t, y: F.sum(
        F.when((F.col("y_true") == F.col(t)) & (F.col("y_pred") == F.col(y)), F.col("c")).otherwise(0)
    )
    b = two.groupBy(key).agg(
        cell("_neg", "_neg").alias("tn"), cell("_neg", "_pos").alias("fp"),
        cell("_pos", "_neg").alias("fn"), cell("_pos", "_pos").alias("tp"),
    )
    zero = F.lit(0.0)
    tnr = F.coalesce(div("tn", F.col("tn") + F.col("fp")), zero)
    tpr = F.coalesce(div("tp", F.col("tp") + F.col("fn")), zero)
    b = b.select(
        key,
        ((tnr + tpr) / 2).alias("auc_hard"),
        tnr.alias("true_negative_rate"),
        F.coalesce(div("fp", F.col("tn") + F.col("fp")), zero).alias("false_positive_rate"),
        F.coalesce(div("fn", F.col("tp") + F.col("fn")), zero).alias("false_negative_rate"),
    )
    return scores.drop("_k", "_neg", "_pos").join(b, key, "left")


def _fold(xs: Column) -> Column:
    """Join stretches of a value series: growth, highest, lowest, worst fall from a high."""

    def step(acc, x):
        return F.struct(
            (acc["g"] * x["g"]).alias("g"),
            F.greatest(acc["hi"], acc["g"] * x["hi"]).alias("hi"),
            F.least(acc["lo"], acc["g"] * x["lo"]).alias("lo"),
            F.least(acc["dd"], x["dd"], acc["g"] * x["lo"] / acc["hi"] - 1).alias("dd"),
        )

    pick = lambda x: F.struct(*[x[c].alias(c) for c in ("g", "hi", "lo", "dd")])
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), pick(xs[0]), step)


def series_drawdown(df: DataFrame, ret: str, key: str = "model", order: tuple[str, ...] = ("date", "seq")) -> DataFrame:
    """Worst drawdown of the compounded series of each key, in the given order; a missing return changes nothing.

    Rows are dealt into sorted ranges of that order and folded as they pass, a
    batch at a time; the pieces of a range are joined, then the ranges of a key.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            runs, out = pc.run_end_encode(batch.column(0)), []
            start, growth = 0, batch.column(1).to_numpy(zero_copy_only=False)
            for end in runs.run_ends.to_pylist():
                g = growth[start:end]
                v = np.cumprod(g[~np.isnan(g)])  # NULLs come as NaN
                if len(v):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        fall = float(np.fmin.reduce(v / np.maximum.accumulate(v) - 1))
                    out.append((part, piece, v[-1], v.max(), v.min(), min(fall, 0.0)))
                else:
                    out.append((part, piece, 1.0, None, None, 0.0))
                start, piece = end, piece + 1
            cols = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), pa.int64(), *[pa.float64()] * 4])]
            if out:
                yield pa.RecordBatch.from_arrays([runs.values, *cols], names=["key", "_range", "_block", "g", "hi", "lo", "dd"])

    placed = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    growth = placed.select(key, (1 + F.col(ret)).cast("double").alias("g"))
    schema = f"key {df.select(key).schema[0].dataType.simpleString()}, _range int, _block long, g double, hi double, lo double, dd double"
    folded = growth.mapInArrow(run, schema).select(F.col("key").alias(key), "_range", "_block", F.struct("g", "hi", "lo", "dd").alias("s"))
    for level in ("_block", "_range"):
        link = F.struct(F.col(level).alias("o"), *[F.col(f"s.{c}").alias(c) for c in ("g", "hi", "lo", "dd")])
        by = [key, "_range"] if level == "_block" else [key]
        folded = folded.groupBy(*by).agg(_fold(F.array_sort(F.collect_list(link))).alias("s"))
    return folded.select(key, F.col("s.dd").alias("max_drawdown"))


def financial(pred: DataFrame, risk_free: float = 0.02, key: str = "model", benchmark: str | None = None) -> DataFrame:
    p, y = F.col("y_pred"), F.col("y_true")
    same = (F.signum(p) == F.signum(y)).cast("double")
    var = exact_quantiles(pred, [key], p, {"var_95": 0.05}).drop("n_values")
    aggs = [
        F.avg(p).alias("_m"),
        F.stddev_pop(p).alias("_sd"),
        F.avg(same).alias("hit_rate"),
        F.coalesce(F.avg(F.when((p != 0) & (y != 0), same)), F.lit(0.0)).alias("directional_accuracy"),
        F.stddev_pop(F.when(p < 0, p)).alias("_dsd"),
        F.max("var_95").alias("var_95"),
        F.avg(F.when(p <= F.col("var_95"), p)).alias("cvar_95"),
    ]
    if benchmark:
        ex = p - F.col(benchmark)
        aggs.append(F.coalesce(div(F.avg(ex), F.stddev_pop(ex)), F.lit(0.0)).alias("information_ratio"))
    a = pred.join(var, key).groupBy(key).agg(*aggs).join(series_drawdown(pred, "y_pred", key), key)
    zero = F.lit(0.0)
    return a.select(
        key,
        F.coalesce(div(F.col("_m") - risk_free, "_sd"), zero).alias("sharpe_ratio"),
        "hit_rate",
        "directional_accuracy",
        "max_drawdown",
        F.coalesce(div("_m", F.abs("max_drawdown")), zero).alias("calmar_ratio"),
        F.coalesce(div(F.col("_m") - risk_free, "_dsd"), zero).alias("sortino_ratio"),
        "var_95",
        "cvar_95",
        *(["information_ratio"] if benchmark else []),
    )


def rank_models(results: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """Rank of each model per metric, from a wide table of one row per model."""
    tall = results.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [key], metrics, "metric", "value").where("value IS NOT NULL")
    signed = F.when(F.col("metric").isin(HIGHER_BETTER), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("metric")
    return tall.withColumns(
        {
            "rank": F.row_number().over(w.orderBy(signed, key)),
            "mean": F.avg("value").over(w),
            "std": F.stddev_pop("value").over(w),
            "min": F.min("value").over(w),
            "max": F.max("value").over(w),
        }
    ).withColumn("range", F.col("max") - F.col("min"))


def overall_ranking(ranked: DataFrame, key: str = "model") -> DataFrame:
    mean = ranked.groupBy(key).agg(F.avg("rank").alias("mean_rank"))
    return mean.orderBy("mean_rank", key)


def rolling_accuracy(pred: DataFrame, key: str = "model") -> DataFrame:
    """Hit rate over a trailing tenth of each model's dates, on daily hit counts.

    Per date first: the window then runs over at most one row per calendar day.
    """
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    daily = pred.groupBy(key, "date").agg(F.sum(hit).alias("_h"), F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(key).orderBy("date")
    days = F.count(F.lit(1)).over(Window.partitionBy(key))
    daily = daily.withColumns(
        {
            "_rn": F.row_number().over(order),
            "_w": F.greatest(F.floor(days / 10), F.lit(1)),
            "_ch": F.sum("_h").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_cc": F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    back = daily.select(
        key, (F.col("_rn") + F.col("_w")).alias("_rn"), F.col("_ch").alias("_ph"), F.col("_cc").alias("_pc")
    )
    j = daily.join(back, [key, "_rn"], "left").where(F.col("_rn") >= F.col("_w"))
    return j.select(
        key,
        "date",
        (
            (F.col("_ch") - F.coalesce("_ph", F.lit(0))) / (F.col("_cc") - F.coalesce("_pc", F.lit(0)))
        ).alias("accuracy"),
    )
