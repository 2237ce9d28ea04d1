"""Registered model queries that have no SQL."""

import threading

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from barloom.operators import models


def test_ml_batch_trains_full_models(spark, sf, monkeypatch):
    trained = []
    fit = models.Pipeline.fit

    def note(self, df):
        trained.append(self.getStages()[-1])
        return fit(self, df)

    monkeypatch.setattr(models.Pipeline, "fit", note)
    got = {r.name: r.trained for r in entry_mod.queries()["ml_batch"](spark, sf).collect()}
    assert got == {"a": True, "b": True, "broken": False}
    trees = [s.getNumTrees() if s.hasParam("numTrees") else s.getMaxIter() for s in trained]
    assert trees == [models.DEFAULTS["maxIter"]] * 2 and {s.getMaxDepth() for s in trained} == {models.DEFAULTS["maxDepth"]}


def test_ml_grid_scores_full_models(spark, sf, monkeypatch):
    trained = []
    monkeypatch.setattr(models, "train", lambda df, cols, kind="regression", **p: trained.append({**models.DEFAULTS, **p}))
    monkeypatch.setattr(models, "score", lambda m, df, *a, **k: 1.0)
    got = entry_mod.queries()["ml_grid"](spark, sf).collect()
    full = models.DEFAULTS["maxIter"]
    assert [(r.max_depth, r.max_iter) for r in got] == [(3, full), (6, full)]
    assert sorted((p["maxDepth"], p["maxIter"]) for p in trained) == [(3, full)] * 3 + [(6, full)] * 3


def test_time_split_neither_joins_nor_shuffles_rows(spark):
    df = spark.range(200).select(F.format_string("s%02d", F.col("id") % 20).alias("symbol"), F.date_add(F.lit("2024-01-01"), (F.col("id") / 20).cast("int")).alias("date"))
    for train, validation in ((0.7, 0.15), (0.333, 0.333), (0.5, 0.5), (1.0, 0.0)):
        out = models.time_split(df, train, validation)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan
        got = [r.split for r in out.collect()]
        want = [int(200 * train), int(200 * (train + validation)) - int(200 * train)]
        assert [got.count("train"), got.count("validation"), got.count("test")] == [*want, 200 - sum(want)]
    assert models.time_split(df.limit(0)).count() == 0


def test_time_folds_neither_join_nor_shuffle_rows(spark):
    for days, folds in ((20, 3), (23, 5), (4, 3), (2, 5), (1, 1)):
        df = spark.range(days * 7).select(F.date_add(F.lit("2024-01-01"), (F.col("id") % days * 3).cast("int")).alias("date"), "id")
        df = df.union(spark.createDataFrame([(None, -1)], df.schema)) if days == 23 else df
        out = models.time_folds(df, folds)
        assert out.schema["fold"].dataType.simpleString() == "int"
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan
        # the dates in order, dealt by ntile
        dates = df.select("date").distinct().withColumn("fold", F.expr(f"ntile({folds + 1}) OVER (ORDER BY date) - 1"))
        assert sorted(out.select("id", "fold").collect()) == sorted(df.join(dates, "date").select("id", "fold").collect())
    assert models.time_folds(df.limit(0), 3).count() == 0


def test_models_are_trained_side_by_side(spark, monkeypatch):
    both, ends = threading.Barrier(2, timeout=30), []

    def train(df, cols, kind="regression", **params):
        if kind == "broken":
            raise ValueError(kind)
        both.wait()  # for another model's training
        return (kind, params)

    monkeypatch.setattr(models, "train", train)
    monkeypatch.setattr(models, "score", lambda m, df, *a, **k: float(df.select("date").distinct().count() + df.agg(F.min("x")).first()[0]))
    df = spark.range(50).select(F.date_add(F.lit("2024-01-01"), (F.col("id") / 5).cast("int")).alias("date"), F.col("id").alias("x"))
    assert models.cross_validate(df, ["x"], folds=4, maxIter=3) == models.CrossValidation({"maxIter": 3}, [12.0, 22.0, 32.0, 42.0])
    out = models.train_many(df, ["x"], {"a": {"maxIter": 1}, "c": {"kind": "broken"}, "b": {"maxIter": 2}})
    assert list(out) == ["a", "c", "b"] and isinstance(out["c"], ValueError)
    assert out["a"] == ("regression", {"maxIter": 1}) and out["b"] == ("regression", {"maxIter": 2})
