import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import constraints as con
from barloom.operators import costs, evaluation, indicators, ledger, metrics, models, quality, rebalance, runs, selection, signals, weights
from barloom.operators import covariance as cv
from barloom.operators import optimize as op
from barloom.operators.quantiles import exact_quantiles
from barloom.functions import rules
from barloom.sources.results import FeatureStore, describe
from barloom.sources import store
from barloom.sources.store import BarStore, update_table
from barloom.session import scratch_path

D = dt.date


def test_t_plus_1_uses_strictly_earlier_buys(spark):
    rows = [("000001", D(2024, 1, 1), 1), ("000001", D(2024, 1, 2), -1), ("000001", D(2024, 1, 3), -1), ("000002", D(2024, 1, 1), -1)]
    df = spark.createDataFrame(rows, "symbol string, date date, signal int")
    out = {(r.symbol, r.date.day): r.signal for r in con.t_plus_1(df).collect()}
    assert out == {("000001", 1): 1, ("000001", 2): -1, ("000001", 3): -1, ("000002", 1): 0}


@pytest.mark.parametrize("code,board,limit", [
    ("000001", "main_board", 0.10), ("002001", "main_board", 0.10), ("300001", "chinext", 0.10), ("600001", "main_board", 0.10),
    ("688001", "star_market", 0.20), ("830001", "beijing_stock", 0.30)])
def test_boards(spark, code, board, limit):
    r = spark.createDataFrame([(code,)], "s string").select(
        rules.market_type("s").alias("m"), rules.limit_ratio(rules.market_type("s"), rules.stock_status("s")).alias("l")).first()
    assert (r.m, r.l) == (board, limit)


def test_cost_of_a_buy_and_a_sell(spark):
    tr = spark.createDataFrame([("000001", "buy", 1000.0, 10.0, 10000.0), ("000001", "sell", 1000.0, 10.5, 10500.0)],
                               "symbol string, side string, quantity double, price double, amount double")
    out = {r.side: r for r in costs.with_costs(tr).collect()}
    assert out["buy"].total_cost == pytest.approx(10.0) and out["buy"].stamp_tax == 0
    assert out["sell"].stamp_tax == pytest.approx(10.5) and out["sell"].total_cost == pytest.approx(21.0)


def test_rebalance_of_five_names(spark):
    cur = [("a", .15), ("b", .20), ("c", .10), ("d", .25), ("e", .30)]
    tgt = [("a", .20), ("b", .20), ("c", .15), ("d", .20), ("e", .25)]
    mk = lambda x: spark.createDataFrame([("p", s, w) for s, w in x], "portfolio string, symbol string, weight double")
    t = rebalance.trades(mk(cur), mk(tgt)).toPandas()
    assert len(t) == 4 and np.allclose(t["abs_value"], 50000) and np.allclose(t["transaction_cost"], 50)
    assert rebalance.drift(mk(cur), mk(tgt)).first().drift == pytest.approx(0.20)


def test_weight_limits(spark):
    w = spark.createDataFrame([(D(2024, 1, 1), s, x) for s, x in zip("abcde", (.04, .06, .03, .05, .05))], "date date, symbol string, weight double")
    ind = spark.createDataFrame(list(zip("abcde", ["finance", "consumer", "property", "finance", "insurance"])), "symbol string, industry string")
    r = weights.validate(w, ind).first()
    assert not r.position_limit and r.industry_limit and r.violations == ["position_limit"]


def test_weights_sum_to_one(spark):
    sig = [.85, .92, .45, .78, .15, .88, .25, .95]
    df = spark.createDataFrame([(D(2024, 1, 1), f"s{i}", x) for i, x in enumerate(sig)], "date date, symbol string, signal double")
    for m in ("equal", "proportional", "rank"):
        w = weights.transform(df, weights.WeightRules(method=m)).toPandas()
        assert w["weight"].sum() == pytest.approx(1) and len(w) <= 5


def test_quantiles_match_numpy_beyond_the_sketch(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=60000), np.full(30000, 0.5), [np.nan]])
    g = np.concatenate([np.zeros(90000), [0]]).astype(int)
    small = rng.normal(size=57)
    pdf = pd.DataFrame({"g": np.concatenate([g, np.ones(57, int)]), "x": np.concatenate([x, small])})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(7)
    probs = {"lo": 0.0, "a": 0.05, "m": 0.5, "b": 0.777, "hi": 1.0}
    for acc in (1000, 10000):
        out = {r.g: r for r in exact_quantiles(df, ["g"], "x", probs, acc).collect()}
        for key, ref in ((0, x[~np.isnan(x)]), (1, small)):
            assert out[key].n_values == len(ref)
            for name, p in probs.items():
                assert out[key][name] == pytest.approx(np.quantile(ref, p), abs=1e-12)
    whole = exact_quantiles(df, [], "x", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.nanquantile(pdf["x"], 0.5))


def test_covariance_matches_pandas_for_any_blocking(spark):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(size=(500, 9)), columns=[f"s{i}" for i in range(9)], index=pd.date_range("2020-01-01", periods=500))
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    tall = wide.stack().rename("ret").reset_index().set_axis(["date", "symbol", "ret"], axis=1)
    tall["date"] = tall["date"].dt.date
    want = wide.cov()
    for blocks in (1, 4):
        out = cv.pairwise(spark.createDataFrame(tall), blocks).toPandas()
        assert len(out) == 45
        assert np.allclose(out["cov"], [want.loc[i, j] for i, j in zip(out["sym_i"], out["sym_j"])])


@pytest.mark.parametrize("method", ["mean_variance", "min_variance", "max_sharpe", "risk_parity", "max_diversification"])
def test_solver_keeps_bounds_and_improves(method):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(60, 20))
    c, mu = np.cov(a.T), rng.normal(size=20) * 0.01
    w, start, end = op.solve(mu, c, op.OptimizerRules(method=method, upper=0.1))
    assert w.sum() == pytest.approx(1, abs=1e-6) and w.min() >= -1e-9 and w.max() <= 0.1 + 1e-9 and end <= start + 1e-12


def test_solver_infeasible_cap():
    w, *_ = op.solve(np.zeros(5), np.eye(5), op.OptimizerRules(upper=0.05))
    assert np.allclose(w / w.sum(), 0.2)


def test_solver_takes_any_number_of_assets(spark):
    mu = spark.range(501).select(F.lit(D(2024, 1, 1)).alias("as_of"), F.col("id").cast("string").alias("symbol"), F.lit(0.1).alias("mu"))
    cov = mu.select("as_of", F.col("symbol").alias("sym_i"), F.col("symbol").alias("sym_j"), F.lit(1.0).alias("cov"))
    w = op.optimize(mu, cov).toPandas()["weight"]
    assert len(w) == 501 and w.sum() == pytest.approx(1.0)


def test_metrics_of_one_series(spark):
    rng = np.random.default_rng(42)
    r = pd.Series(rng.normal(0.001, 0.02, 252))
    pdf = pd.DataFrame({"strategy": "s", "date": pd.date_range("2023-01-01", periods=252).date, "ret": r})
    m = metrics.metrics(spark.createDataFrame(pdf)).first()
    value = (1 + r).cumprod()
    dd = value / value.cummax() - 1
    assert m.total_return == pytest.approx(value.iloc[-1] - 1)
    assert m.max_drawdown == pytest.approx(dd.min()) and m.skewness == pytest.approx(r.skew()) and m.kurtosis == pytest.approx(r.kurtosis())
    assert m.var_95 == pytest.approx(r.quantile(0.05))
    roll = metrics.rolling_metrics(spark.createDataFrame(pdf), 37).orderBy("date").toPandas()
    want = []
    for i in range(37, 253):
        v = (1 + r.iloc[i - 37:i]).cumprod()
        want.append((v / v.cummax() - 1).min())
    assert np.allclose(roll["max_drawdown"], want)


def test_qq_points_use_the_inverse_normal(spark):
    pdf = pd.DataFrame({"strategy": "s", "date": pd.date_range("2023-01-01", periods=10).date, "ret": np.arange(10.0)})
    q = metrics.qq_points(spark.createDataFrame(pdf)).orderBy("rank").toPandas()
    assert np.allclose(q["theoretical"], [NormalDist().inv_cdf(p) for p in q["p"]])


@pytest.mark.parametrize("block", [7, 1000])
def test_ledger_for_any_block_size(spark, monkeypatch, block):
    monkeypatch.setattr(runs.dealt, "__defaults__", (block,))
    rng = np.random.default_rng(9)
    n = 400
    rows = [("s", "x", D(2024, 1, 1) + dt.timedelta(days=i // 40), i, i // 13, "BUY" if b else "SELL", float(q), float(p))
            for i, (b, q, p) in enumerate(zip(rng.random(n) < 0.55, rng.integers(1, 9, n), rng.integers(10, 20, n)))]
    df = spark.createDataFrame(rows, "strategy string, symbol string, date date, seq int, part int, side string, quantity double, price double")
    q = avg = real = 0.0
    for *_, side, qty, px in rows:
        if side == "BUY":
            if q + qty > 0:
                avg = (q * avg + qty * px) / (q + qty)
            q += qty
        else:
            real += (px - avg) * qty
            q -= qty
    # all orders of the second key on one day
    crowd = df.union(df.select("strategy", F.lit("y"), F.lit(D(2024, 1, 1)), "seq", "part", "side", "quantity", "price"))
    for r in ledger.positions(crowd).collect():
        assert (r.quantity, r.avg_cost, r.realized_pnl) == (pytest.approx(q), pytest.approx(avg), pytest.approx(real)), r.symbol


def test_sold_out_strategy_keeps_its_cash_row_and_no_deviation(spark):
    rows = [("s", "x", D(2024, 1, 1), 1, "BUY", 10.0, 5.0), ("s", "x", D(2024, 1, 2), 2, "SELL", 10.0, 6.0), ("h", "x", D(2024, 1, 1), 1, "BUY", 10.0, 5.0)]
    o = spark.createDataFrame(rows, "strategy string, symbol string, date date, seq int, side string, quantity double, price double")
    p = ledger.positions(o)
    out = {r.strategy: (r.cash_balance, r.positions_count) for r in ledger.summary(p, o, D(2024, 1, 2)).collect()}
    assert out == {"s": (1_000_000.0, 0), "h": (999_950.0, 1)}
    back = spark.createDataFrame([("x", 0.1)], "symbol string, backtest_return double")
    assert [r.strategy for r in ledger.deviation(p, back).collect()] == ["h"]


def test_drawdown_of_a_series_of_one_day(spark, monkeypatch):
    monkeypatch.setattr(runs.dealt, "__defaults__", (16,))
    ret = np.random.default_rng(4).normal(0, 0.02, 500)
    df = spark.createDataFrame([("m", D(2024, 1, 1), i, float(r)) for i, r in enumerate(ret)], "model string, date date, seq int, y double").repartition(5)
    v = np.cumprod(1 + ret)
    want = (v / np.maximum.accumulate(v) - 1).min()
    assert evaluation.series_drawdown(df, "y").first().max_drawdown == pytest.approx(want)


def test_series_drawdown_of_many_batches_and_missing_returns(spark):
    """Folded as rows pass: keys and batches meet anywhere, a missing return changes nothing."""
    import random

    rnd = random.Random(9)
    rows = [(m, k // 7, k, None if rnd.random() < 0.1 or k < 3 else rnd.uniform(-0.1, 0.1)) for m in "abc" for k in range(500)]
    df = spark.createDataFrame(rows + [("none", 1, 1, None)], "model string, date int, seq int, y double").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.model: r.max_drawdown for r in evaluation.series_drawdown(df, "y").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got.pop("none") == 0 and len(got) == 3
    for m, found in got.items():
        v, high, worst = 1.0, None, 0.0
        for r in rows:
            if r[0] == m and r[3] is not None:
                v *= 1 + r[3]
                high = max(v, high or v)
                worst = min(worst, v / high - 1)
        assert found == pytest.approx(worst)



def test_last_copy_of_a_key_in_a_batch_wins(spark):
    for values in ((1.0, 2.0), (2.0, 1.0)):
        s = BarStore(spark, scratch_path(spark, "t"))
        batch = spark.createDataFrame([("a", D(2023, 1, 2), v) for v in values], "symbol string, date date, close double").coalesce(1)
        s.merge(batch)
        assert s.read().first().close == values[1]
        s.merge(batch.withColumn("close", F.col("close") + 5), F.col("close"))
        assert s.read().first().close == 7.0
    changes = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string").coalesce(1)
    assert [tuple(r) for r in update_table(spark.createDataFrame([(1, "o"), (2, "o")], "id int, v string"), changes, ["id"]).orderBy("id").collect()] == [(1, "y"), (2, "o")]


def test_store_without_files(spark):
    s = BarStore(spark, scratch_path(spark, "t"))
    s.delete("a")
    assert s.read(["a"], D(2023, 1, 1)).count() == s.symbols().count() == 0
    assert s.stats().first().total_records == 0


def test_a_failing_strategy_stops_no_other(spark):
    bars = spark.createDataFrame([("a", D(2023, 1, 2), 1.0)], "symbol string, date date, close double")
    failures = {}
    out = signals.run_strategies(bars, ["momentum", "nope", "rsi"], {"rsi": {"no_such": 1}}, failures)
    assert set(failures) == {"nope", "rsi"} and {r.strategy for r in out.collect()} <= {"momentum"}
    with pytest.raises(KeyError):
        signals.run_strategies(bars, ["nope"])


def test_feature_versions_by_time_of_writing(spark):
    s = FeatureStore(spark, scratch_path(spark, "t"))
    f = spark.createDataFrame([("a", D(2023, 1, 2), 1.0), ("a", D(2023, 1, 2), 1.0)], "symbol string, date date, score double")
    for v in ("9", "10", "010", "10"):
        s.write(f, v)
    assert sorted(r.feature_version for r in s.metadata().collect()) == ["010", "10", "9"]
    assert s.read(version="010").count() == 2 and s.read(version="10").first().feature_version == "10"
    assert [r.feature_version for r in s.clean(1).collect()] == ["10"] and s.read().count() == 2
    one = describe(f.limit(1), "v", "raw").first().checksum
    assert one != describe(f, "v", "raw").first().checksum


def test_multi_class_scores_and_parameters(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(days=i // 6), f"s{i % 6}", float(i % 3), None if i % 10 == 0 else float(i % 3), ("low", "mid", "top")[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "date date, symbol string, x double, z double, name string").withColumn("target", F.col("x") - 1)
    for label in ("name", "target"):
        m = models.train(df, ["x", "z"], "multiclass", label=label, maxIter=5, maxDepth=3)
        assert models.score(m, df, "multiclass", label) == 1.0
        assert models.predict(m, df).count() == 300
    cv = models.cross_validate(df, ["x"], "multiclass", folds=2, maxIter=3, maxDepth=2)
    assert cv.scores == [1.0, 1.0]
    best = models.grid_search(df, ["x"], {"maxDepth": [0, 2], "maxIter": [3]}, "multiclass", folds=2)
    assert best[0].params["maxDepth"] == 2 and best[0].mean == 1.0
    with pytest.raises(ValueError):
        models.train(df, ["x"], "multiclass", label="name", stepSize=0.3)


def test_auc_ranks_higher_first(spark):
    wide = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "model string, auc_hard double")
    assert evaluation.rank_models(wide, ["auc_hard"]).where("rank = 1").first().model == "b"


def test_far_apart_spans(spark):
    pdf = pd.DataFrame({"symbol": "a", "date": pd.date_range("2000-01-01", periods=1500).date, "close": np.random.default_rng(1).normal(10, 1, 1500).cumsum()})
    out = indicators.ema(spark.createDataFrame(pdf), (2, 12, 2000)).orderBy("date").toPandas()
    for n in (2, 12, 2000):
        assert np.allclose(out[f"ema_{n}"], pdf["close"].ewm(span=n, adjust=False).mean(), rtol=1e-9)


def test_store_round_trip(spark):
    s = BarStore(spark, scratch_path(spark, "t"))
    mk = lambda v, year: spark.createDataFrame([("a", D(year, 1, 2), v), ("b", D(year, 1, 2), v)], "symbol string, date date, close double")
    s.append(mk(1.0, 2022))
    s.append(mk(1.0, 2023))
    s.merge(mk(5.0, 2023).where("symbol = 'a'"))
    got = {(r.symbol, r.date.year): r.close for r in s.read().collect()}
    assert got == {("a", 2022): 1, ("b", 2022): 1, ("a", 2023): 5, ("b", 2023): 1}
    assert s.read(["a"], D(2023, 1, 1)).count() == 1
    s.delete("a", 2022)
    s.delete("b")
    assert [(r.symbol, r.date.year) for r in s.read().collect()] == [("a", 2023)]
    plan = s.read(["a"], D(2023, 1, 1), D(2023, 12, 31))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan


def test_time_split_is_ordered(spark):
    df = spark.createDataFrame([(f"s{i % 7}", D(2024, 1, 1) + dt.timedelta(days=i // 7)) for i in range(100)], "symbol string, date date")
    out = models.time_split(df).orderBy("date", "symbol").toPandas()["split"].tolist()
    assert out == ["train"] * 70 + ["validation"] * 15 + ["test"] * 15


def test_only_the_first_operator_of_a_column_counts(spark):
    df = spark.range(10)
    assert selection.apply_filters(df, {"id": {"gt": 4, "lt": 0}, "nope": 1}).count() == 5


def test_triggers_follow_the_last_taken_date(spark):
    days = [(("p"), D(2024, 1, 1) + dt.timedelta(days=i), 0.0) for i in range(40)]
    out = rebalance.triggers(spark.createDataFrame(days, "portfolio string, date date, drift double"), "scheduled", "weekly")
    assert [r.date.day for r in out.orderBy("date").collect()] == [1, 8, 15, 22, 29, 5]


def test_plans_hold_no_cross_join_and_no_row_udf(spark, sf):
    import __spark_entry__ as e

    for name in ("wgt_transform", "agg_costreport", "bt_run", "con_all", "jn_asof_fill", "win_allind", "met_all"):
        plan = e.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert bad not in plan, (name, bad)


def test_pages_by_key_reach_the_scan(spark):
    path = scratch_path(spark, "t")
    spark.range(5000).selectExpr("id % 7 AS a", "id AS b").write.parquet(path)
    df = spark.read.parquet(path)
    after, seen = None, []
    for _ in range(60):
        page = selection.page_after(df, ["a", "b"], after, 100)
        seen += [tuple(r) for r in page.collect()]
        after = selection.next_of(page, ["a", "b"])
        if after is None:
            break
    assert seen == sorted((k % 7, k) for k in range(5000))
    plan = selection.page_after(df, ["a", "b"], {"a": 5, "b": 40}, 100)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,5)" in plan


def test_store_rewrites_only_the_folders_it_must(spark):
    s = BarStore(spark, scratch_path(spark, "t"), buckets=4)
    rows = [(f"s{k}", D(y, 1, 2), 1.0) for k in range(20) for y in (2022, 2023)]
    s.append(spark.createDataFrame(rows, "symbol string, date date, close double"))
    files = lambda: {r[0] for r in s._table().select("_metadata.file_path").distinct().collect()}
    before = files()
    s.delete("s3", 2023)
    touched = {f.rsplit("/", 1)[0] for f in before ^ files()}
    assert len(touched) == 1 and "year=2023" in touched.pop()
    assert s.read(["s3"]).count() == 1 and s.read().count() == 39
    again = files()
    s.merge(spark.createDataFrame([("s4", D(2022, 1, 2), 9.0)], "symbol string, date date, close double"))
    assert len({f.rsplit("/", 1)[0] for f in again ^ files()}) == 1
    assert s.read(["s4"], end=D(2022, 12, 31)).first().close == 9.0 and s.read().count() == 39


def test_stored_tables_are_written_back(spark):
    path = scratch_path(spark, "t")
    spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string").write.parquet(path)
    store.write_updates(spark, path, spark.createDataFrame([(3, "z")], "id int, v string"), ["id"])
    assert store.write_retention(spark, path, F.col("v") == "a") == 1 and store.write_retention(spark, path, F.col("v") == "a") == 0
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, None), (3, "z")]


def test_columns_and_types_are_checked(spark):
    good = spark.createDataFrame([("a", D(2023, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, date date, open double, high double, low double, close double, volume double")
    assert quality.check_bars(good).first().is_valid
    bad = good.drop("low").withColumn("high", F.lit("x"))
    r = quality.check_bars(bad).first()
    assert (r.columns_ok, r.is_valid, r.price_ok, r.rows) == (False, False, None, 1)
    faults = {(x.column, x.reason) for x in quality.check_schema(quality.frame_types(bad)).collect()}
    assert faults == {("low", "missing column"), ("high", "not a number: string")}


def test_periods_without_data_are_there(spark):
    days = [D(2023, 1, 3), D(2023, 1, 4), D(2023, 4, 5), D(2023, 4, 6)]
    df = spark.createDataFrame([("s", d, 0.1) for d in days], "strategy string, date date, ret double")
    got = metrics.period_metrics(df, "monthly").orderBy("period_end").collect()
    assert [r.period_end.month for r in got] == [1, 2, 3, 4]
    assert [round(r.period_return, 6) for r in got] == [0.21, 0.0, 0.0, 0.21]
    assert [round(r.cumulative_return, 6) for r in got] == [0.21, 0.21, 0.21, round(1.1**4 - 1, 6)]
    assert got[1].sharpe_ratio == got[0].sharpe_ratio and metrics.period_metrics(df, "weekly").count() == 14


def test_pipeline_selects_by_variance_and_correlation(spark):
    from barloom.operators.features import FeaturePipeline

    rows = [(f"s{k % 3}", float(k), float(2 * k + 1), 4.0, float((k * 7) % 11)) for k in range(60)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double, c double, d double")
    assert FeaturePipeline(scaler="none", selection="variance").fit(df).selected == ["a", "b", "d"]
    p = FeaturePipeline(scaler="none", selection="correlation").fit(df)
    assert "b" not in p.selected and {"a", "d"} <= set(p.selected)
    assert FeaturePipeline(selection="correlation", threshold=1.5).fit(df).selected == ["a", "b", "c", "d"]


def test_backtest_ids_keep_their_zeros(spark):
    from barloom.sources.results import BacktestStore

    s = BacktestStore(spark, scratch_path(spark, "t"))
    one = spark.createDataFrame([(1.0,)], "x double")
    for i in ("007", "12"):
        s.save(i, {"name": i, "status": "completed", "created_at": "2024"}, one, one, one)
    assert sorted(r.backtest_id for r in s.table("meta").collect()) == ["007", "12"] and s.get("007").count() == 1
