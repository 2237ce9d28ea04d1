"""Registered queries: feature pipeline, models, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import features as fp
from ..operators import indicators as ind
from ..operators import models as ml
from ..session import cut_lineage, scratch_path
from ..sources import tables as t
from .indicator_queries import _ALL_COLS, _ALL_EXTRA, W
from .registry import dated, query
from .shape import q, qs, rounded
from .views_sql import sql

K = ("symbol", "date")
#: Prices, sizes and the indicators of all families.
COLS = ["open", "high", "low", "close", "volume", "amount", *_ALL_COLS]
BEST = 20

FT = f"""{_ALL_EXTRA},
ft AS (SELECT symbol, date, b.open, b.high, b.low, b.close, b.volume, b.amount, {", ".join(_ALL_COLS)} FROM bars_brand b
 JOIN m USING (symbol, date) JOIN r14 USING (symbol, date) JOIN r6 USING (symbol, date) JOIN e5 USING (symbol, date)
 JOIN b2 USING (symbol, date) JOIN k3 USING (symbol, date) JOIN wv USING (symbol, date))"""
MED = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in COLS)
FI = f"md AS (SELECT {MED} FROM ft), fi AS (SELECT symbol, date, " + ", ".join(
    f"coalesce({c}, m_{c}) AS {c}" for c in COLS) + " FROM ft, md)"


def _features(spark, sf):
    df = ind.all_indicators(t.bars_brand(spark, sf))
    # the fit reads the features several times
    return cut_lineage(df.select(*K, *COLS), "features")


def fsql(body: str, extra: str = "") -> str:
    return sql("bars_brand", extra=FT + ", " + FI + (", " + extra if extra else ""), body=body)


@dated("fp_raw", sql("bars_brand", extra=FT + ", big AS (SELECT symbol FROM bars_brand GROUP BY 1 HAVING count(*) >= 30)",
                     body=f"SELECT symbol, date, {qs(COLS, 4)} FROM ft WHERE symbol IN (SELECT symbol FROM big)"))
def fp_raw(spark, sf):
    return rounded(fp.raw_features(t.bars_brand(spark, sf), 30), K, COLS, 4)


@dated("fp_impute", fsql(f"SELECT symbol, date, {qs(COLS, 4)} FROM fi"))
def fp_impute(spark, sf):
    f = _features(spark, sf)
    return rounded(fp.impute(f, fp.medians(f, COLS)), K, COLS, 4)


_SC = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}


def _scaler(name: str, kind: str) -> None:
    a, b = _SC[kind]
    par = "sc AS (SELECT " + ", ".join(f"{a.format(c=c)} AS a_{c}, {b.format(c=c)} AS b_{c}" for c in COLS) + " FROM fi)"
    out = ", ".join(q(f"(fi.{c} - a_{c}) / CASE WHEN b_{c} = 0 THEN 1 ELSE b_{c} END", 5, c) for c in COLS)

    @dated(name, fsql(f"SELECT symbol, date, {out} FROM fi, sc", par))
    def run(spark, sf):
        f = _features(spark, sf)
        filled = fp.impute(f, fp.medians(f, COLS))
        return rounded(fp.scale(filled, fp.scale_params(filled, COLS, kind)), K, COLS, 5)


_scaler("fp_scale_std", "standard")
_scaler("fp_scale_minmax", "minmax")
_scaler("fp_scale_robust", "robust")

_TG = f"tg AS (SELECT *, coalesce(lead(close) OVER ({W}) / nullif(close, 0) - 1, 0) AS target FROM fi)"
_LONG = "lf AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, target AS y FROM tg" for c in COLS) + ")"
_FS = "fs AS (SELECT feature, power(corr(x, y), 2) * (count(*) - 2) / (1 - power(corr(x, y), 2)) AS f_score FROM lf GROUP BY 1)"


def _filled(spark, sf):
    f = _features(spark, sf)
    return fp.next_return(fp.impute(f, fp.medians(f, COLS)))


@query("fp_select_f", fsql(f"SELECT feature, {q('f_score', 5)} FROM fs ORDER BY f_score DESC LIMIT {BEST}", f"{_TG}, {_LONG}, {_FS}"))
def fp_select_f(spark, sf):
    s = fp.f_scores(_filled(spark, sf), COLS).orderBy(F.desc("f_score"), "feature").limit(BEST)
    return rounded(s, ["feature"], ["f_score"], 5)


_CUT = "ct AS (SELECT feature, " + ", ".join(
    f"quantile_cont({v}, {k / 10}) AS {v}{k}" for v in "xy" for k in range(1, 10)) + " FROM lf GROUP BY 1)"
_BIN = "bn AS (SELECT feature, " + ", ".join(
    " + ".join(f"({v} > {v}{k})::INTEGER" for k in range(1, 10)) + f" AS bin_{v}" for v in "xy") + " FROM lf JOIN ct USING (feature))"
_MI = """jc AS (SELECT feature, bin_x, bin_y, count(*)::DOUBLE AS c FROM bn GROUP BY 1, 2, 3),
mi AS (SELECT feature, sum(c / n * ln(c * n / (cx * cy))) AS mutual_info FROM (SELECT *, sum(c) OVER (PARTITION BY feature) AS n,
 sum(c) OVER (PARTITION BY feature, bin_x) AS cx, sum(c) OVER (PARTITION BY feature, bin_y) AS cy FROM jc) GROUP BY 1)"""
_ALL_MI = f"{_TG}, {_LONG}, {_FS}, {_CUT}, {_BIN}, {_MI}"


@query("fp_select_mi", fsql(f"SELECT feature, {q('mutual_info')} FROM mi", _ALL_MI))
def fp_select_mi(spark, sf):
    return rounded(fp.mutual_information(_filled(spark, sf), COLS), ["feature"], ["mutual_info"])


@query("fp_importance", fsql(
    f"SELECT feature, {q('f_score', 5)}, {q('mutual_info')}, {q('(f_score + mutual_info) / 2', 5, 'combined')} FROM fs JOIN mi USING (feature)", _ALL_MI))
def fp_importance(spark, sf):
    return rounded(fp.importance(_filled(spark, sf), COLS), ["feature"], {"f_score": 5, "mutual_info": 6, "combined": 5})


@query("fp_select_var", fsql(f"""SELECT feature, {q('v', 4, 'variance')} FROM (SELECT feature, var_samp(x) AS v FROM lf GROUP BY 1) WHERE v <= 0.5""", f"{_TG}, {_LONG}"))
def fp_select_var(spark, sf):
    return rounded(fp.low_variance(_filled(spark, sf), COLS, 0.5), ["feature"], ["variance"], 4)


_CORR = f"""nm AS (SELECT unnest({COLS!r}) AS feature, unnest(range(1, {len(COLS) + 1})) AS i),
cm AS (SELECT """ + ", ".join(f"corr({a}, {b}) AS c_{i}_{j}" for i, a in enumerate(COLS, 1) for j, b in enumerate(COLS[: i - 1], 1)) + """ FROM fi),
ca AS (SELECT CAST(split_part(k, '_', 2) AS INTEGER) AS i, CAST(split_part(k, '_', 3) AS INTEGER) AS j FROM (UNPIVOT cm ON COLUMNS(*) INTO NAME k VALUE v) WHERE abs(v) > 0.95),
gr AS (SELECT 0 AS i, []::INTEGER[] AS kept UNION ALL SELECT i + 1,
 CASE WHEN EXISTS (SELECT 1 FROM ca WHERE ca.i = gr.i + 1 AND list_contains(kept, ca.j)) THEN kept ELSE list_append(kept, i + 1) END FROM gr WHERE i < """ + f"{len(COLS)})"


@query("fp_select_corr", fsql(f"SELECT feature FROM nm, (SELECT kept FROM gr WHERE i = {len(COLS)}) WHERE NOT list_contains(kept, nm.i)", _CORR).replace("WITH ", "WITH RECURSIVE ", 1))
def fp_select_corr(spark, sf):
    """Columns dropped because they correlate with an earlier one that stays."""
    gone = fp.correlated_columns(_filled(spark, sf), COLS)
    return spark.createDataFrame([(c,) for c in gone], "feature string")


_TR_SC = "sc AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in COLS) + " FROM fi)"
_TR_COLS = ", ".join(f"(fi.{c} - a_{c}) / b_{c} AS {c}" for c in COLS)
_TR_LONG = "un AS (" + " UNION ALL ".join(f"SELECT symbol, date, '{c}' AS feature, {c} AS v FROM (SELECT symbol, date, {_TR_COLS} FROM fi, sc)" for c in COLS) + ")"


@query("fp_transform", fsql(f"""SELECT symbol, count(*) AS cells, {q('sum(abs(v))', 3, 'total')} FROM un
WHERE feature IN (SELECT feature FROM fs ORDER BY f_score DESC LIMIT {BEST}) GROUP BY symbol""", f"{_TG}, {_LONG}, {_FS}, {_TR_SC}, {_TR_LONG}"))
def fp_transform(spark, sf):
    f = _features(spark, sf)
    out = fp.FeaturePipeline(n_features=BEST).fit(f).transform(f)
    cols = [c for c in out.columns if c not in K]
    total = sum((F.abs(F.col(c)) for c in cols[1:]), F.abs(F.col(cols[0])))
    g = out.groupBy("symbol").agg((F.count(F.lit(1)) * len(cols)).alias("cells"), F.sum(total).alias("total"))
    return rounded(g, ["symbol", "cells"], ["total"], 3)


@query("fp_persist", fsql(f"SELECT feature FROM fs ORDER BY f_score DESC LIMIT {BEST}", f"{_TG}, {_LONG}, {_FS}"))
def fp_persist(spark, sf):
    """Fitted pipeline saved and loaded again; its selected features."""
    path = scratch_path(spark, "pipeline")
    fp.FeaturePipeline(n_features=BEST).fit(_features(spark, sf)).save(spark, path)
    return spark.createDataFrame([(c,) for c in fp.FeaturePipeline.load(spark, path).selected], "feature string")


@dated("udf_indicator", sql("bars_brand", extra=FT, body=f"SELECT symbol, date, {q('rsi_14', 5)} FROM ft"))
def udf_indicator(spark, sf):
    """The indicators as a pipeline stage."""
    from ..operators.stages import IndicatorTransformer

    out = IndicatorTransformer(families=["rsi"]).transform(t.bars_brand(spark, sf))
    return rounded(out, K, ["rsi_14"], 5)


# -- models ---------------------------------------------------------------

_P = ["close", "volume"]
_LG = [f"{c}_lag_{k}" for k in (1, 2, 3, 5) for c in _P]
_MAF = [f"{c}_ma_{n}" for n in (5, 10, 20) for c in _P]
_PREP = f"""pq AS (SELECT symbol, date, close, volume, """ + ", ".join(
    f"lag({c}, {k}) OVER ({W}) AS {c}_lag_{k}" for k in (1, 2, 3, 5) for c in _P) + ", " + ", ".join(
    f"avg({c}) OVER ({W} ROWS {n - 1} PRECEDING) AS {c}_ma_{n}" for n in (5, 10, 20) for c in _P) + f""",
 (lead(close) OVER ({W}) - close) / nullif(close, 0) AS target FROM prices_supp),
pp AS (SELECT * FROM pq WHERE target IS NOT NULL AND close_lag_5 IS NOT NULL)"""


def _prepared(spark, sf, kind="return"):
    return ml.prepare(t.prices_supp(spark, sf), kind, cols=_P)


@dated("ml_prepare", sql("prices_supp", extra=_PREP, body=f"SELECT symbol, date, {qs(_P + _LG + _MAF, 4)}, {q('target', 5)} FROM pp"))
def ml_prepare(spark, sf):
    df, cols = _prepared(spark, sf)
    return rounded(df, K, {**dict.fromkeys(cols, 4), "target": 5})


_SPLIT = """sp AS (SELECT symbol, date, CASE WHEN rn < floor(n * 0.7) THEN 'train' WHEN rn < floor(n * (0.7 + 0.15)) THEN 'validation' ELSE 'test' END AS split
 FROM (SELECT *, row_number() OVER (ORDER BY date, symbol) - 1 AS rn, count(*) OVER () AS n FROM prices_supp))"""


@dated("ml_split", sql("prices_supp", extra=_SPLIT, body="SELECT symbol, date, split FROM sp"))
def ml_split(spark, sf):
    return ml.time_split(t.prices_supp(spark, sf)).select(*K, "split")


def _train_test(spark, sf, kind="return"):
    df, cols = _prepared(spark, sf, kind)
    df = ml.time_split(cut_lineage(df, "training"))
    return df.where("split = 'train'"), df.where("split = 'test'"), cols


# tree models have no SQL form: rows only, with invariants in the tests
@dated("ml_train")
def ml_train(spark, sf):
    tr, te, cols = _train_test(spark, sf)
    return rounded(ml.predict(ml.train(tr, cols), te), K, ["target", "prediction"])


@dated("ml_predict")
def ml_predict(spark, sf):
    tr, te, cols = _train_test(spark, sf, "direction")
    return rounded(ml.predict(ml.train(tr, cols, "binary"), te), K, ["target", "prediction"])


@dated("ml_proba")
def ml_proba(spark, sf):
    tr, te, cols = _train_test(spark, sf, "direction")
    p = ml.predict_proba(ml.train(tr, cols, "binary"), te)
    return rounded(p.withColumn("proba_up", F.col("proba")[1]), K, ["proba_up"])


@dated("ml_labels", sql("prices_supp", extra=_SPLIT + ", " + _PREP, body="""
SELECT symbol, date, true AS known_label FROM (SELECT symbol, date, row_number() OVER (ORDER BY date, symbol) - 1 AS rn, count(*) OVER () AS n FROM pp)
WHERE rn >= floor(n * (0.7 + 0.15))"""))
def ml_labels(spark, sf):
    """Text labels encoded for training and decoded in the prediction."""
    tr, te, cols = _train_test(spark, sf)
    name = F.when(F.col("target") > 0.1, "up").when(F.col("target") < -0.1, "down").otherwise("flat")
    m = ml.train(tr.withColumn("cls", name), cols, "multiclass", label="cls")
    return ml.predict(m, te).select(*K, F.col("predicted_label").isin("up", "down", "flat").alias("known_label"))


@query("ml_importance")
def ml_importance(spark, sf):
    tr, _, cols = _train_test(spark, sf)
    return rounded(ml.importance_table(spark, ml.train(tr, cols), cols), ["feature"], ["importance"])


@query("srt_importance")
def srt_importance(spark, sf):
    """The five most important features."""
    tr, _, cols = _train_test(spark, sf)
    top = ml.importance_table(spark, ml.train(tr, cols), cols).limit(5)
    return rounded(top, ["feature"], ["importance"])


@query("ml_tscv")
def ml_tscv(spark, sf):
    tr, _, cols = _train_test(spark, sf)
    cv = ml.cross_validate(tr, cols, maxIter=20)
    return spark.createDataFrame([(i + 1, float(s), cv.mean, cv.std) for i, s in enumerate(cv.scores)],
                                 "fold int, score double, mean double, std double")


@query("ml_grid")
def ml_grid(spark, sf):
    tr, _, cols = _train_test(spark, sf)
    runs = ml.grid_search(tr, cols, {"maxDepth": [3, 6], "maxIter": [ml.DEFAULTS["maxIter"]]})
    return spark.createDataFrame([(i + 1, r.params["maxDepth"], r.params["maxIter"], r.mean) for i, r in enumerate(runs)],
                                 "rank int, max_depth int, max_iter int, score double")


@query("ml_batch")
def ml_batch(spark, sf):
    """Two configurations train with the model defaults, one with an unknown kind fails alone."""
    tr, _, cols = _train_test(spark, sf)
    tr = tr.withColumn("cls", F.when(F.col("target") > 0, "up").otherwise("down"))
    out = ml.train_many(tr, cols, {"a": {}, "b": {"kind": "multiclass", "label": "cls"}, "broken": {"kind": "no such kind"}})
    return spark.createDataFrame([(k, not isinstance(v, Exception)) for k, v in out.items()], "name string, trained boolean")


@query("ml_persist")
def ml_persist(spark, sf):
    """A saved and loaded model predicts what the original does."""
    from ..sources.results import ModelRegistry

    tr, te, cols = _train_test(spark, sf)
    m = ml.train(tr, cols)
    reg = ModelRegistry(spark, scratch_path(spark, "models"))
    reg.save("gbt", m, "gbt_regressor", {"r2": ml.score(m, te, "regression")}, created="2024-01-01T00:00:00")
    a = ml.predict(m, te).select(*K, F.col("prediction").alias("p"))
    b = ml.predict(reg.load("gbt"), te).select(*K, F.col("prediction").alias("p2"))
    return a.join(b, list(K)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("p") - F.col("p2")) > 1e-12).alias("different"))


@query("udf_model")
def udf_model(spark, sf):
    """A plug-in trainer, used by name."""
    from pyspark.ml.regression import LinearRegression

    ml.register_trainer("linear", lambda p: LinearRegression(labelCol="label", featuresCol="features", regParam=0.1))
    tr, te, cols = _train_test(spark, sf)
    m = ml.train(tr, cols, "linear")
    return rounded(ml.predict(m, te).agg(F.count(F.lit(1)).alias("rows"), F.avg("prediction").alias("mean_prediction")), ["rows"], ["mean_prediction"])


# -- evaluation -----------------------------------------------------------


@query("ev_basic", sql("predictions", body="SELECT model, sample_count, " + qs(ev.BASIC) + """ FROM (SELECT model, count(*) AS sample_count, avg(y_true) AS y_true_mean,
 stddev_pop(y_true) AS y_true_std, avg(y_pred) AS y_pred_mean, stddev_pop(y_pred) AS y_pred_std, avg(y_pred - y_true) AS residual_mean,
 stddev_pop(y_pred - y_true) AS residual_std, corr(y_true, y_pred) AS correlation FROM predictions GROUP BY model)"""))
def ev_basic(spark, sf):
    return rounded(ev.basic(t.predictions(spark, sf)), ["model", "sample_count"], ev.BASIC)


_PNZ = "pn AS (SELECT * FROM predictions)"
_REG = """rg AS (SELECT model, avg(e * e) AS mse, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - avg(e * e) / var_pop(y_true) AS r2,
 CASE WHEN NOT bool_or(y_true = 0) THEN avg(abs(e / nullif(y_true, 0))) END AS mape, 1 - var_pop(e) / var_pop(y_true) AS explained_variance, max(abs(e)) AS max_error,
 quantile_cont(abs(e), 0.5) AS median_absolute_error, avg(e) AS mean_bias, sqrt(avg(e * e)) / stddev_pop(y_true) AS normalized_rmse
 FROM (SELECT *, y_pred - y_true AS e FROM pn) GROUP BY model)"""


@query("ev_reg", sql("predictions", extra=f"{_PNZ}, {_REG}", body=f"SELECT model, {qs(ev.REGRESSION)} FROM rg"))
def ev_reg(spark, sf):
    return rounded(ev.regression(t.predictions(spark, sf)), ["model"], ev.REGRESSION)


def _class_sql(k: int) -> tuple[str, str]:
    if k == 2:
        return "(y_true > 0)::INTEGER", "(y_pred > 0)::INTEGER"
    case = "CASE WHEN {c} > 0.02 THEN 2 WHEN {c} < -0.02 THEN 0 ELSE 1 END"
    return case.format(c="y_true"), case.format(c="y_pred")


def _with_classes(pred, k: int):
    """Two or three classes by sign or by thirds of the range."""
    def cls(c):
        if k == 2:
            return (F.col(c) > 0).cast("int")
        return F.when(F.col(c) > 0.02, 2).when(F.col(c) < -0.02, 0).otherwise(1)

    return pred.withColumns({c: cls(c) for c in ("y_true", "y_pred")})


def _class_query(name: str, k: int) -> None:
    yt, yp = _class_sql(k)
    cols = ev.CLASSIFICATION if k == 2 else ev.CLASSIFICATION[:7]
    extra = f"""pc AS (SELECT model, {yt} AS y, {yp} AS p FROM predictions),
ks AS (SELECT model, k, count(*) FILTER (WHERE y = k) AS s, count(*) FILTER (WHERE p = k) AS pr, count(*) FILTER (WHERE p = k AND y = k) AS tp
 FROM pc JOIN (SELECT unnest(range({k})) AS k) ON true GROUP BY 1, 2),
kp AS (SELECT *, coalesce(tp / nullif(pr, 0), 0) AS pp, coalesce(tp / nullif(s, 0), 0) AS rr FROM ks),
kf AS (SELECT *, coalesce(2 * pp * rr / nullif(pp + rr, 0), 0) AS ff FROM kp),
sc AS (SELECT model, sum(tp) / sum(s) AS accuracy, sum(pp * s) / sum(s) AS precision, sum(rr * s) / sum(s) AS recall, sum(ff * s) / sum(s) AS f1,
 avg(pp) AS precision_macro, avg(rr) AS recall_macro, avg(ff) AS f1_macro, max(rr) FILTER (WHERE k = 0) AS true_negative_rate,
 1 - max(rr) FILTER (WHERE k = 0) AS false_positive_rate, 1 - max(rr) FILTER (WHERE k = 1) AS false_negative_rate,
 (max(rr) FILTER (WHERE k = 0) + max(rr) FILTER (WHERE k = 1)) / 2 AS auc_hard FROM kf GROUP BY 1)"""

    @query(name, sql("predictions", extra=extra, body=f"SELECT model, {qs(cols)} FROM sc"))
    def run(spark, sf):
        return rounded(ev.classification(_with_classes(t.predictions(spark, sf), k)), ["model"], cols)


_class_query("ev_class", 2)
_class_query("ev_class_multi", 3)

_FIN = """v0 AS (SELECT *, product(1 + y_pred) OVER (PARTITION BY model ORDER BY seq ROWS UNBOUNDED PRECEDING) AS v,
 quantile_cont(y_pred, 0.05) OVER (PARTITION BY model) AS q5 FROM predictions),
v1 AS (SELECT *, v / max(v) OVER (PARTITION BY model ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM v0),
v2 AS (SELECT model, avg(y_pred) AS m, stddev_pop(y_pred) AS sd, stddev_pop(y_pred) FILTER (WHERE y_pred < 0) AS dsd, min(dd) AS max_drawdown,
 avg((sign(y_pred) = sign(y_true))::INTEGER) AS hit_rate, avg((sign(y_pred) = sign(y_true))::INTEGER) FILTER (WHERE y_pred <> 0 AND y_true <> 0) AS directional_accuracy,
 coalesce(avg(y_pred - y_true) / nullif(stddev_pop(y_pred - y_true), 0), 0) AS information_ratio,
 max(q5) AS var_95, avg(y_pred) FILTER (WHERE y_pred <= q5) AS cvar_95 FROM v1 GROUP BY model),
v3 AS (SELECT *, (m - 0.02) / sd AS sharpe_ratio, m / abs(max_drawdown) AS calmar_ratio, (m - 0.02) / dsd AS sortino_ratio FROM v2)"""


@query("ev_fin", sql("predictions", extra=_FIN, body=f"SELECT model, {qs([*ev.FINANCIAL, 'information_ratio'])} FROM v3"))
def ev_fin(spark, sf):
    """Financial metrics of predictions, the information ratio against what came true."""
    found = ev.financial(t.predictions(spark, sf), benchmark="y_true")
    return rounded(found, ["model"], [*ev.FINANCIAL, "information_ratio"])


_RM = ["mse", "mae", "r2", "max_error", "mean_bias"]
_RK = "ur AS (" + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM rg" for m in _RM) + """),
rr AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('r2') THEN -value ELSE value END, model) AS rank,
 avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std, min(value) OVER w AS min, max(value) OVER w AS max FROM ur WINDOW w AS (PARTITION BY metric))"""


@query("ev_rank", sql("predictions", extra=f"{_PNZ}, {_REG}, {_RK}", body=f"""SELECT model, metric, CAST(rank AS INTEGER) AS rank, {qs(['value', 'mean', 'std', 'min', 'max'])} FROM rr"""))
def ev_rank(spark, sf):
    r = ev.rank_models(ev.regression(t.predictions(spark, sf)), _RM)
    return rounded(r, ["model", "metric", "rank"], ["value", "mean", "std", "min", "max"])


@query("ev_rank_overall", sql("predictions", extra=f"{_PNZ}, {_REG}, {_RK}", body=f"SELECT model, {q('avg(rank)', 6, 'mean_rank')} FROM rr GROUP BY model"))
def ev_rank_overall(spark, sf):
    return rounded(ev.overall_ranking(ev.rank_models(ev.regression(t.predictions(spark, sf)), _RM)), ["model"], ["mean_rank"])


@dated("win_rollacc", sql("predictions", extra="""
d AS (SELECT model, date, sum(((y_true > 0) = (y_pred > 0))::INTEGER) AS h, count(*) AS c FROM predictions GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date) AS rn, greatest(count(*) OVER (PARTITION BY model) // 10, 1) AS w FROM d)""",
    body=f"""SELECT a.model, a.date, {q('sum(b.h) / sum(b.c)', 6, 'accuracy')} FROM n a JOIN n b ON a.model = b.model
AND b.rn BETWEEN a.rn - a.w + 1 AND a.rn WHERE a.rn >= a.w GROUP BY 1, 2"""))
def win_rollacc(spark, sf):
    return rounded(ev.rolling_accuracy(_with_classes(t.predictions(spark, sf), 2)), ["model", "date"], ["accuracy"])
