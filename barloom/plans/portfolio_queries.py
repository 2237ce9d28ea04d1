"""Registered queries: weights, rebalancing, covariance, optimizer, backtests."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import covariance as cv
from ..operators import metrics as met
from ..operators import optimize as op
from ..operators import rebalance as rb
from ..operators import signals as sig
from ..operators import weights as wt
from ..functions.guards import by_date, div
from ..session import cut_lineage
from ..sources import tables as t
from .indicator_queries import HELD_CTE, SIG_MA_CTE, SIG_MOM_CTE
from .registry import dated, query
from .shape import q, qs, rounded
from .views_sql import sql

K = ("symbol", "date")
W = "PARTITION BY symbol ORDER BY date"
psql = partial(sql, "prices_supp")
isql = partial(sql, "prices_supp", "industries")

SIG = f"""sg AS (SELECT * FROM (SELECT symbol, date, close, close / nullif(lag(close, 3) OVER ({W}), 0) - 1 AS signal FROM prices_supp)
  WHERE signal IS NOT NULL)"""
Z = """zs AS (SELECT * EXCLUDE (mu, sd), CASE WHEN sd = 0 THEN 0 ELSE greatest(-3.0, least(3.0, (signal - mu) / sd)) END AS z
  FROM (SELECT *, avg(signal) OVER (PARTITION BY date) AS mu, stddev_samp(signal) OVER (PARTITION BY date) AS sd FROM sg))"""
SEL = """se AS (SELECT * EXCLUDE (hi, rk) FROM (SELECT *, quantile_cont(z, 0.8) OVER (PARTITION BY date) AS hi,
  row_number() OVER (PARTITION BY date ORDER BY z DESC, symbol) AS rk FROM zs) WHERE (z >= hi AND rk <= 50) OR rk <= 5)"""
SEL_SHORT = """ss AS (SELECT * EXCLUDE (hi, lo, rk) FROM (SELECT *, quantile_cont(z, 0.8) OVER (PARTITION BY date) AS hi,
  quantile_cont(z, 0.2) OVER (PARTITION BY date) AS lo,
  row_number() OVER (PARTITION BY date ORDER BY z DESC, symbol) AS rk FROM zs) WHERE (z >= hi AND rk <= 50) OR rk <= 5 OR z <= lo)"""


def _signals(spark, sf):
    p = t.prices_supp(spark, sf)
    s = p.withColumn("signal", div("close", F.lag("close", 3).over(by_date())) - 1)
    return s.where("signal IS NOT NULL").select("symbol", "date", "close", "signal")


def weights_cte(src: str, raw: str, name: str = "wt") -> str:
    """Raw weight expression over `src` to capped and normalized weights."""
    return f"""{name}0 AS (SELECT *, {raw} AS w0 FROM {src}),
{name} AS (SELECT *, w1 / sum(w1) OVER (PARTITION BY date) AS weight FROM (SELECT *, least(w0, 0.05) AS w1 FROM {name}0) WHERE w1 >= 0.01)"""


def shifted(expr: str) -> str:
    lo = f"min({expr}) OVER (PARTITION BY date)"
    return f"CASE WHEN {lo} < 0 THEN {expr} - {lo} + 1e-6 ELSE {expr} END"


def prop_cte(src: str, expr: str, name: str = "wt") -> str:
    return f"{name}s AS (SELECT *, {shifted(expr)} AS sh FROM {src}),\n" + weights_cte(
        f"{name}s", "sh / nullif(sum(sh) OVER (PARTITION BY date), 0)", name)


@dated("win_zscore", psql(extra=f"{SIG}, {Z}", body=f"SELECT symbol, date, {q('z')} FROM zs"))
def win_zscore(spark, sf):
    return rounded(wt.zscore(_signals(spark, sf)), K, ["z"])


@dated("wgt_select", psql(extra=f"{SIG}, {Z}, {SEL}", body=f"SELECT symbol, date, {q('z')} FROM se"))
def wgt_select(spark, sf):
    return rounded(wt.select(wt.zscore(_signals(spark, sf))), K, ["z"])


@dated("wgt_select_short", psql(extra=f"{SIG}, {Z}, {SEL_SHORT}", body=f"SELECT symbol, date, {q('z')} FROM ss"))
def wgt_select_short(spark, sf):
    return rounded(wt.select(wt.zscore(_signals(spark, sf)), wt.WeightRules(short=True)), K, ["z"])


_RANKS = "rank() OVER (PARTITION BY date ORDER BY z) + (count(*) OVER (PARTITION BY date, z) - 1) / 2.0"


@dated("win_rankw", psql(extra=f"{SIG}, {Z}, {SEL}, rk AS (SELECT *, {_RANKS} AS r FROM se)", body=
    f"SELECT symbol, date, {q('r / sum(r) OVER (PARTITION BY date)', 6, 'weight')} FROM rk"))
def win_rankw(spark, sf):
    return rounded(wt.weigh(wt.select(wt.zscore(_signals(spark, sf))), "rank"), K, ["weight"])


_EXTRA = """ex AS (SELECT *, abs(signal) + 0.1 AS volatility, signal * 2 - 0.5 AS sharpe FROM se)"""


def _weighting(name: str, method: str, cte: str, src: str) -> None:
    @dated(name, psql(extra=f"{SIG}, {Z}, {SEL}, {_EXTRA}, {cte}", body=f"SELECT symbol, date, {q('weight')} FROM {src}"))
    def run(spark, sf):
        s = wt.select(wt.zscore(_signals(spark, sf)))
        s = s.withColumns({"volatility": F.abs("signal") + 0.1, "sharpe": F.col("signal") * 2 - 0.5})
        return rounded(wt.weigh(s, method), K, ["weight"])


_EQ = "wq AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM ex)"


def _prop(expr: str) -> str:
    return f"wq0 AS (SELECT *, {shifted(expr)} AS sh FROM ex), wq AS (SELECT *, sh / sum(sh) OVER (PARTITION BY date) AS weight FROM wq0)"


_weighting("wgt_equal", "equal", _EQ, "wq")
_weighting("wgt_prop", "proportional", _prop("z"), "wq")
_weighting("wgt_rank", "rank", f"wq AS (SELECT *, r / sum(r) OVER (PARTITION BY date) AS weight FROM (SELECT *, {_RANKS} AS r FROM ex))", "wq")
_weighting("wgt_vol", "volatility", _prop("(z / (volatility + 1e-6))"), "wq")
_weighting("wgt_sharpe", "sharpe", _prop("sharpe"), "wq")

WEIGHTS = f"{SIG}, {Z}, {SEL}, {prop_cte('se', 'z')}"


@dated("wgt_clip", psql(extra=f"{SIG}, {Z}, {SEL}, " + weights_cte("se", "1.0::DOUBLE / count(*) OVER (PARTITION BY date)"),
                        body=f"SELECT symbol, date, {q('weight')} FROM wt"))
def wgt_clip(spark, sf):
    s = wt.weigh(wt.select(wt.zscore(_signals(spark, sf))), "equal")
    return rounded(wt.clip_normalize(s), K, ["weight"])


@dated("wgt_transform", psql(extra=WEIGHTS, body=f"SELECT symbol, date, {q('weight')} FROM wt"))
def wgt_transform(spark, sf):
    return rounded(wt.transform(_signals(spark, sf)), K, ["weight"])


_IND = "wi AS (SELECT w.symbol, w.date, w.weight, coalesce(i.industry, 'Unknown') AS industry FROM wt w LEFT JOIN industries i USING (symbol))"


def _industry(spark, sf):
    return t.industries(spark, sf)


@dated("jn_lookup_industry", isql(extra=f"{WEIGHTS}, {_IND}", body=f"SELECT symbol, date, industry, {q('weight')} FROM wi"))
def jn_lookup_industry(spark, sf):
    return rounded(wt.with_industry(wt.transform(_signals(spark, sf)), _industry(spark, sf)), [*K, "industry"], ["weight"])


_STAT = ["total_weight", "max_weight", "min_weight", "mean_weight", "concentration_top5", "concentration_top10"]


@dated("agg_wstats", isql(extra=f"{WEIGHTS}, {_IND}", body=f"""
SELECT date, n_positions, n_industries, {q('top_industry')}, {qs(_STAT)} FROM (
 SELECT date, count(*) FILTER (WHERE weight > 0) AS n_positions, sum(weight) AS total_weight, max(weight) AS max_weight, min(weight) AS min_weight,
  avg(weight) AS mean_weight, sum(weight) FILTER (WHERE rk <= 5) AS concentration_top5, sum(weight) FILTER (WHERE rk <= 10) AS concentration_top10
 FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY weight DESC, symbol) AS rk FROM wi) GROUP BY date)
JOIN (SELECT date, count(*) AS n_industries, max(w) AS top_industry FROM (SELECT date, industry, sum(weight) AS w FROM wi GROUP BY 1, 2) GROUP BY 1) USING (date)"""))
def agg_wstats(spark, sf):
    s = wt.statistics(_weights(spark, sf), _industry(spark, sf))
    return rounded(s.withColumn("top_industry", F.array_max(F.map_values("industry_distribution"))),
                   ["date", "n_positions", "n_industries"], ["top_industry", *_STAT])


def _prev_month(w):
    """Last month's weights under this month's date, as the current holdings."""
    return w.withColumn("date", F.add_months("date", 1))


_PREV = "pv AS (SELECT symbol, CAST(date + INTERVAL 1 MONTH AS DATE) AS date, weight FROM wt)"
_VAL = """va AS (SELECT w.date, max(w.weight) <= 0.07 AS position_limit FROM wt w GROUP BY 1),
vi AS (SELECT date, max(s) <= 0.2 AS industry_limit FROM (SELECT date, industry, sum(weight) AS s FROM wi GROUP BY 1, 2) GROUP BY 1),
vt AS (SELECT coalesce(w.date, p.date) AS date, sum(abs(coalesce(w.weight, 0) - coalesce(p.weight, 0))) AS t FROM wt w FULL JOIN pv p ON w.symbol = p.symbol AND w.date = p.date GROUP BY 1),
vc AS (SELECT date, sum(weight) <= 0.3 AS concentration FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY weight DESC, symbol) AS rk FROM wt) WHERE rk <= 5 GROUP BY 1)"""


@dated("wgt_validate", isql(extra=f"{WEIGHTS}, {_IND}, {_PREV}, {_VAL}", body="""
SELECT date, position_limit, industry_limit, t <= 1.4 AS turnover_limit, concentration,
 position_limit AND industry_limit AND t <= 1.4 AND concentration AS is_valid
FROM va JOIN vi USING (date) JOIN vt USING (date) JOIN vc USING (date)"""))
def wgt_validate(spark, sf):
    w = _weights(spark, sf)
    v = wt.validate(w, _industry(spark, sf), _prev_month(w), 0.07, 0.2, None, 1.4, 0.3)
    return v.select("date", "position_limit", "industry_limit", "turnover_limit", "concentration", "is_valid")


def _adjust_sql(rounds: int) -> str:
    out, src = [], "wi"
    for k in range(rounds):
        out.append(f"""a{k} AS (SELECT symbol, date, industry, CASE WHEN NOT bad THEN weight ELSE w2 / sum(w2) OVER (PARTITION BY date) END AS weight FROM (
 SELECT *, w1 * CASE WHEN sum(w1) OVER (PARTITION BY date, industry) > 0.2 THEN 0.2 / sum(w1) OVER (PARTITION BY date, industry) ELSE 1 END AS w2 FROM (
 SELECT *, least(weight, 0.08) AS w1, max(weight) OVER (PARTITION BY date) > 0.08 OR max(iw) OVER (PARTITION BY date) > 0.2 AS bad FROM (
 SELECT *, sum(weight) OVER (PARTITION BY date, industry) AS iw FROM {src}))))""")
        src = f"a{k}"
    return ", ".join(out)


@dated("wgt_adjust", isql(extra=f"{WEIGHTS}, {_IND}, {_adjust_sql(10)}", body=f"SELECT symbol, date, {q('weight')} FROM a9"))
def wgt_adjust(spark, sf):
    return rounded(wt.adjust(wt.transform(_signals(spark, sf)), _industry(spark, sf), 0.08, 0.2), K, ["weight"])


_POST = """p1 AS (SELECT *, greatest(0.0, least(0.055, weight)) AS c FROM wi),
p2 AS (SELECT *, c * CASE WHEN sum(c) OVER (PARTITION BY date, industry) > 0.15 THEN 0.15 / sum(c) OVER (PARTITION BY date, industry) ELSE 1 END AS d FROM p1),
p3 AS (SELECT symbol, date, d / sum(d) OVER (PARTITION BY date) AS weight FROM p2)"""


@dated("opt_post", isql(extra=f"{WEIGHTS}, {_IND}, {_POST}", body=f"SELECT symbol, date, {q('weight')} FROM p3"))
def opt_post(spark, sf):
    w = wt.post_process(wt.transform(_signals(spark, sf)), _industry(spark, sf), 0.0, 0.055, 0.15)
    return rounded(w, K, ["weight"])


# -- rebalancing ----------------------------------------------------------

_FULL = f"""tg AS (SELECT strftime(date, '%Y-%m') AS portfolio, symbol, weight FROM wt),
cu AS (SELECT strftime(date, '%Y-%m') AS portfolio, symbol, weight FROM pv),
al AS (SELECT coalesce(t.portfolio, c.portfolio) AS portfolio, coalesce(t.symbol, c.symbol) AS symbol,
 coalesce(c.weight, 0) AS current_weight, coalesce(t.weight, 0) AS target_weight FROM cu c FULL JOIN tg t ON c.portfolio = t.portfolio AND c.symbol = t.symbol)"""


def _weights(spark, sf):
    """Transformed weights, written once for the queries that read them several times."""
    return cut_lineage(wt.transform(_signals(spark, sf)), "weights")


def _cur_tgt(spark, sf):
    w = _weights(spark, sf)
    name = F.date_format("date", "yyyy-MM")
    tgt = w.select(name.alias("portfolio"), "symbol", "weight")
    cur = _prev_month(w).select(name.alias("portfolio"), "symbol", "weight")
    return cur, tgt


@query("jn_full_weights", psql(extra=f"{WEIGHTS}, {_PREV}, {_FULL}", body=f"SELECT portfolio, symbol, {qs(['current_weight', 'target_weight'])} FROM al"))
def jn_full_weights(spark, sf):
    return rounded(rb.align(*_cur_tgt(spark, sf)), ["portfolio", "symbol"], ["current_weight", "target_weight"])


@query("reb_drift", psql(extra=f"{WEIGHTS}, {_PREV}, {_FULL}", body=f"SELECT portfolio, {q('sum(abs(current_weight - target_weight))', 6, 'drift')} FROM al GROUP BY 1"))
def reb_drift(spark, sf):
    return rounded(rb.drift(*_cur_tgt(spark, sf)), ["portfolio"], ["drift"])


_TR = ["weight_change", "value_change", "abs_value", "transaction_cost"]
_TRD = {"weight_change": 6, "value_change": 3, "abs_value": 3, "transaction_cost": 4}
_TRADES = """tr AS (SELECT *, ch AS weight_change, ch * 1000000 AS value_change, CASE WHEN ch > 0 THEN 'BUY' ELSE 'SELL' END AS side,
 abs(ch * 1000000) AS abs_value, abs(ch * 1000000) * 0.001 AS transaction_cost FROM (SELECT *, target_weight - current_weight AS ch FROM al) WHERE abs(ch) >= 0.01)"""


@query("reb_trades", psql(extra=f"{WEIGHTS}, {_PREV}, {_FULL}, {_TRADES}", body="SELECT portfolio, symbol, side, " + ", ".join(q(c, d) for c, d in _TRD.items()) + " FROM tr"))
def reb_trades(spark, sf):
    return rounded(rb.trades(*_cur_tgt(spark, sf)), ["portfolio", "symbol", "side"], _TRD)


@query("srt_trades", psql(extra=f"{WEIGHTS}, {_PREV}, {_FULL}, {_TRADES}", body=f"""SELECT portfolio, symbol, {q('abs_value', 3)} FROM tr
ORDER BY round(abs_value, 4) DESC, portfolio, symbol LIMIT 100"""))
def srt_trades(spark, sf):
    tr = rb.trades(*_cur_tgt(spark, sf))
    top = tr.orderBy(F.round("abs_value", 4).desc(), "portfolio", "symbol").limit(100)
    return rounded(top, ["portfolio", "symbol"], ["abs_value"], 3)


_EXE = {"total_turnover": 2, "total_cost": 3, "drift_before": 6}


@query("reb_execute", psql(extra=f"{WEIGHTS}, {_PREV}, {_FULL}, {_TRADES}", body="""
SELECT d.portfolio, coalesce(n, 0) AS n_trades, """ + ", ".join(q(c, d) for c, d in _EXE.items()) + """ FROM
 (SELECT portfolio, sum(abs(current_weight - target_weight)) AS drift_before FROM al GROUP BY 1 HAVING sum(abs(current_weight - target_weight)) > 1.23) d
 LEFT JOIN (SELECT portfolio, count(*) AS n, sum(abs_value) AS total_turnover, sum(transaction_cost) AS total_cost FROM tr GROUP BY 1) t USING (portfolio)"""))
def reb_execute(spark, sf):
    cur, tgt = _cur_tgt(spark, sf)
    due = rb.drift(cur, tgt).select("portfolio", F.current_date().alias("date"), (F.col("drift") > 1.23).alias("rebalance"))
    _, stats = rb.execute(due, cur, tgt)
    return rounded(stats, ["portfolio", "n_trades"], _EXE)


_DRIFTS = """dr AS (SELECT l_returnflag AS portfolio, CAST(l_shipdate AS DATE) AS date, round(avg(l_discount), 8) AS drift FROM lineitem GROUP BY 1, 2)"""


def _drifts(spark, sf):
    return t.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("portfolio"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(F.round(F.avg("l_discount"), 8).alias("drift"))


# the fold again, as a chain that jumps from one taken date to the next
_TRIG = """WITH RECURSIVE {drifts},
tk AS (SELECT '{kind}' AS kind, portfolio, min(date) AS date FROM dr GROUP BY portfolio
  UNION ALL
  SELECT kind, portfolio, nxt FROM (SELECT tk.kind, tk.portfolio, (SELECT min(d.date) FROM dr d WHERE d.portfolio = tk.portfolio AND d.date > tk.date AND ({due})) AS nxt FROM tk)
  WHERE nxt IS NOT NULL)
SELECT kind, portfolio, date FROM tk"""
_DUE = {
    "weekly": "d.date - tk.date >= 7 AND isodow(d.date) = 1",
    "biweekly": "d.date - tk.date >= 14 AND isodow(d.date) = 1",
    "monthly": "month(d.date) <> month(tk.date) AND day(d.date) >= 1",
    "quarterly": "(year(d.date) - year(tk.date)) * 12 + month(d.date) - month(tk.date) >= 3",
    "hybrid": "(d.date - tk.date >= 7 AND isodow(d.date) = 1) OR d.drift > 0.07",
}


@dated("reb_trigger", " UNION ALL ".join(
    "SELECT * FROM (" + _TRIG.format(drifts=_DRIFTS, kind=k, due=d) + ")" for k, d in _DUE.items())
    + f" UNION ALL SELECT 'threshold', portfolio, date FROM (WITH {_DRIFTS} SELECT * FROM dr) WHERE drift > 0.05")
def reb_trigger(spark, sf):
    d = _drifts(spark, sf)
    parts = [rb.triggers(d, "scheduled", f).withColumn("kind", F.lit(f)) for f in ("weekly", "biweekly", "monthly", "quarterly")]
    parts.append(rb.triggers(d, "hybrid", "weekly", 0.07).withColumn("kind", F.lit("hybrid")))
    parts.append(rb.triggers(d, "threshold", threshold=0.05).withColumn("kind", F.lit("threshold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "portfolio", "date")


@dated("reb_schedule", """
WITH sp AS (SELECT l_returnflag AS portfolio, CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem GROUP BY 1),
ds AS (SELECT portfolio, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM sp)
SELECT 'weekly' AS kind, * FROM ds WHERE isodow(date) = 1 UNION ALL SELECT 'monthly', * FROM ds WHERE day(date) = 15 UNION ALL SELECT 'daily', * FROM ds""")
def reb_schedule(spark, sf):
    sp = t.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("portfolio")).agg(
        F.min("l_shipdate").cast("date").alias("start"), F.max("l_shipdate").cast("date").alias("end"))
    out = rb.schedule(sp, "weekly").withColumn("kind", F.lit("weekly"))
    out = out.unionByName(rb.schedule(sp, "monthly", month_day=15).withColumn("kind", F.lit("monthly")))
    return out.unionByName(rb.schedule(sp, "daily").withColumn("kind", F.lit("daily"))).select("kind", "portfolio", "date")


# -- covariance and optimizer --------------------------------------------

RET = f"rt AS (SELECT * FROM (SELECT symbol, date, close / nullif(lag(close) OVER ({W}), 0) - 1 AS ret FROM prices_supp) WHERE ret IS NOT NULL)"


def _returns(spark, sf):
    p = t.prices_supp(spark, sf)
    return p.select("symbol", "date", (div("close", F.lag("close").over(by_date())) - 1).alias("ret")).where("ret IS NOT NULL")


def _asof(rets):
    return rets.select(F.col("date").alias("as_of")).distinct()


_MONTHLY = """dd AS (SELECT date, row_number() OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM rt)),
fr AS (SELECT a.date AS as_of, d.date FROM dd a JOIN dd d ON d.o BETWEEN a.o - 59 AND a.o WHERE month(a.date) % 1 = 0),
fx AS (SELECT fr.as_of, rt.* FROM fr JOIN rt USING (date))"""


@query("agg_covar", psql(extra=f"{RET}, {_MONTHLY}", body=f"""
SELECT as_of, sym_i, sym_j, {q("CASE WHEN sym_i = sym_j AND c <= 0 THEN 1e-4 ELSE c END", 6, "cov")} FROM (
 SELECT a.as_of, a.symbol AS sym_i, b.symbol AS sym_j, coalesce(covar_samp(a.ret, b.ret), 0) AS c
 FROM fx a JOIN fx b ON a.as_of = b.as_of AND a.date = b.date AND a.symbol <= b.symbol GROUP BY 1, 2, 3)"""), dates="as_of")
def agg_covar(spark, sf):
    r = cut_lineage(_returns(spark, sf), "returns")
    cov, _ = cv.asof_moments(r, _asof(r), 60, blocks=2)
    return rounded(cov, ["as_of", "sym_i", "sym_j"], ["cov"])


@query("agg_expret", psql(extra=f"{RET}, {_MONTHLY}", body=f"SELECT as_of, symbol, {q('avg(ret)', 6, 'mu')} FROM fx GROUP BY 1, 2"), dates="as_of")
def agg_expret(spark, sf):
    r = _returns(spark, sf)
    _, mu = cv.asof_moments(r, _asof(r), 60)
    return rounded(mu, ["as_of", "symbol"], ["mu"])


@query("jn_cov_self", psql(extra=RET, body=f"""
SELECT a.symbol AS sym_i, b.symbol AS sym_j, count(*) AS n, {q('covar_samp(a.ret, b.ret)', 6, 'cov')} FROM rt a JOIN rt b
ON a.date = b.date AND a.symbol <= b.symbol GROUP BY 1, 2"""))
def jn_cov_self(spark, sf):
    return rounded(cv.pairwise(_returns(spark, sf), blocks=4), ["sym_i", "sym_j", "n"], ["cov"])


@query("met_corrmatrix", sql("returns_book", body=f"""
SELECT a.strategy AS sym_i, b.strategy AS sym_j, count(*) AS n, {q('corr(a.ret, b.ret)', 6, 'corr')} FROM returns_book a JOIN returns_book b
ON a.date = b.date AND a.strategy <= b.strategy GROUP BY 1, 2"""))
def met_corrmatrix(spark, sf):
    r = t.returns_book(spark, sf).withColumnRenamed("strategy", "symbol")
    return rounded(cv.pairwise(r), ["sym_i", "sym_j", "n"], ["corr"])


_KPI = ["expected_return", "volatility", "sharpe_ratio"]


@query("agg_portkpi", psql(extra=f"{WEIGHTS}, {RET}, {_MONTHLY}" + """,
ww AS (SELECT date AS as_of, symbol, weight FROM wt), mu AS (SELECT as_of, symbol, avg(ret) AS mu FROM fx GROUP BY 1, 2),
cw AS (SELECT a.as_of, a.symbol AS i, b.symbol AS j, coalesce(covar_samp(a.ret, b.ret), 0) AS c FROM fx a JOIN fx b ON a.as_of = b.as_of AND a.date = b.date GROUP BY 1, 2, 3),
c2 AS (SELECT * REPLACE (CASE WHEN i = j AND c <= 0 THEN 1e-4 ELSE c END AS c) FROM cw),
er AS (SELECT as_of, count(*) AS n_positions, sum(weight * mu) AS expected_return FROM ww JOIN mu USING (as_of, symbol) GROUP BY 1),
vr AS (SELECT w.as_of, sum(w.weight * v.weight * c) AS v FROM ww w JOIN c2 ON w.as_of = c2.as_of AND w.symbol = c2.i JOIN ww v ON v.as_of = c2.as_of AND v.symbol = c2.j GROUP BY 1)""",
    body=f"SELECT as_of, n_positions, {qs(_KPI)} FROM (SELECT *, sqrt(v) AS volatility, expected_return / sqrt(v) AS sharpe_ratio FROM er JOIN vr USING (as_of))"), dates="as_of")
def agg_portkpi(spark, sf):
    r = _returns(spark, sf)
    w = wt.transform(_signals(spark, sf)).withColumnRenamed("date", "as_of")
    cov, mu = cv.asof_moments(r, _asof(r), 60, held=w.where("weight != 0"))
    return rounded(cv.portfolio_kpi(w, mu, cov), ["as_of", "n_positions"], _KPI)


# solver output has no SQL form; tests check bounds, sums and the falling objective
def _optimizer(method):
    def run(spark, sf):
        r = cut_lineage(_returns(spark, sf), "returns")
        cov, mu = cv.asof_moments(r, _asof(r), 60, factored=True)
        w = op.optimize(mu, cov, op.OptimizerRules(method=method, upper=0.1))
        return rounded(w, ["as_of", "symbol", "feasible"], ["weight", "objective_start", "objective_end"])

    return run


for _m in ("mean_variance", "min_variance", "max_sharpe", "risk_parity", "max_diversification"):
    query(f"opt_{_m}", dates="as_of")(_optimizer(_m))


@query("opt_grouped", dates="as_of")
def opt_grouped(spark, sf):
    """Mean-variance with industry caps and a turnover limit, post-processed."""
    r = cut_lineage(_returns(spark, sf), "returns")
    cov, mu = cv.asof_moments(r, _asof(r), 60, factored=True)
    ind = _industry(spark, sf)
    n = mu.groupBy("as_of").agg(F.count(F.lit(1)).alias("n"))
    current = mu.join(n, "as_of").select("as_of", "symbol", (1.0 / F.col("n")).alias("weight"))
    w = op.optimize(mu, cov, op.OptimizerRules(upper=0.1, industry_cap=0.25, max_turnover=1.0), ind, current)
    w = wt.post_process(w, ind, 0.0, 0.1, 0.25, by="as_of")
    return rounded(w, ["as_of", "symbol", "industry", "feasible"], ["weight"])


# -- backtests ------------------------------------------------------------

GRID = f"""cal AS (SELECT DISTINCT date FROM prices_supp), gr AS (SELECT s.symbol, c.date, p.close AS c0 FROM (SELECT DISTINCT symbol FROM prices_supp) s
 JOIN cal c ON true LEFT JOIN prices_supp p ON p.symbol = s.symbol AND p.date = c.date),
gd AS (SELECT symbol, date, last_value(c0 IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS close FROM gr)"""
HOLD = f"""mk AS (SELECT DISTINCT date FROM wq),
ho AS (SELECT symbol, date, close, coalesce(last_value(aw IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS weight FROM (
 SELECT g.*, CASE WHEN mk.date IS NOT NULL THEN coalesce(wq.weight, 0) END AS aw FROM gd g LEFT JOIN mk USING (date) LEFT JOIN wq ON wq.symbol = g.symbol AND wq.date = g.date))"""
QUARTER = "wq AS (SELECT symbol, date, weight FROM wt WHERE month(date) % 3 = 0)"
PORT = f"""pr AS (SELECT date, coalesce(lag(weight) OVER ({W}), 0) AS pw, weight, coalesce(close / nullif(lag(close) OVER ({W}), 0) - 1, 0) AS r FROM ho),
pd AS (SELECT date, sum(pw * r) AS gross, sum(abs(weight - pw)) AS turnover, sum(weight) AS invested FROM pr GROUP BY date),
po AS (SELECT *, 'weights' AS strategy, gross - turnover * 0.0013 AS ret, 1000000 * product(1 + gross - turnover * 0.0013) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM pd)"""
_BT = f"{WEIGHTS}, {GRID}, {QUARTER}, {HOLD}"


def _quarter_weights(spark, sf):
    w = wt.transform(_signals(spark, sf).where(F.month("date") % 3 == 0)).select("symbol", "date", "weight")
    return cut_lineage(w, "weights")


def _grid(spark, sf):
    from ..functions.guards import running

    p = t.prices_supp(spark, sf)
    g = bt.densify(p, p.select("date"), ["close"])
    return g.withColumn("close", F.last("close", ignorenulls=True).over(running()))


@dated("jn_left_reindex", psql(extra=GRID, body=f"SELECT symbol, date, {q('close')} FROM gd"))
def jn_left_reindex(spark, sf):
    return rounded(_grid(spark, sf), K, ["close"])


@dated("win_hold", psql(extra=_BT, body=f"SELECT symbol, date, {q('weight')} FROM ho"))
def win_hold(spark, sf):
    return rounded(bt.hold(_grid(spark, sf), _quarter_weights(spark, sf)), K, ["weight"])


@dated("scl_shares", psql(extra=_BT, body=f"SELECT symbol, date, {q('coalesce(weight * 1000000 / nullif(close, 0), 0)', 5, 'shares')} FROM ho"))
def scl_shares(spark, sf):
    return rounded(bt.shares(bt.hold(_grid(spark, sf), _quarter_weights(spark, sf))), K, ["shares"], 5)


_SIZE = "least(signal * 0.05::DOUBLE, 0.2::DOUBLE)"


@dated("scl_sizing", sql("bars_brand", extra=SIG_MOM_CTE, body=f"""SELECT symbol, date, {q(_SIZE, 6, 'size')},
 {q('least(signal * (300.0::DOUBLE / nullif(close, 0)), 0.2::DOUBLE)', 6, 'size_amount')} FROM mo"""))
def scl_sizing(spark, sf):
    m = sig.momentum(t.bars_brand(spark, sf))
    s, c = F.col("signal"), F.col("close")
    return rounded(m.withColumns({
        "size": sig.position_size(s), "size_amount": sig.position_size(s, c, "fixed_amount", 300.0)}), K, ["size", "size_amount"])


_UNI = f"""pp AS (SELECT * FROM prices_supp WHERE month(date) % 2 = 0), sgx AS (SELECT symbol, date, 1 AS signal FROM sg WHERE signal > 0 AND month(date) % 3 = 0),
szx AS (SELECT symbol, date, 0.05::DOUBLE AS size FROM sg WHERE month(date) = 5),
ud AS (SELECT date FROM pp UNION SELECT date FROM sgx UNION SELECT date FROM szx),
ug AS (SELECT s.symbol, ud.date, last_value(pp.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY ud.date ROWS UNBOUNDED PRECEDING) AS close
 FROM (SELECT DISTINCT symbol FROM pp) s JOIN ud ON true LEFT JOIN pp ON pp.symbol = s.symbol AND pp.date = ud.date)"""


@dated("jn_union_index", psql(extra=f"{SIG}, {_UNI}", body=f"""SELECT u.symbol, u.date, {q('close')}, coalesce(g.signal, 0) AS signal, {q('coalesce(z.size, 0)', 6, 'size')}
FROM ug u LEFT JOIN sgx g ON g.symbol = u.symbol AND g.date = u.date LEFT JOIN szx z ON z.symbol = u.symbol AND z.date = u.date
WHERE u.date >= (SELECT min(date) FROM pp)"""))
def jn_union_index(spark, sf):
    s = _signals(spark, sf)
    m = F.month("date")
    prices = t.prices_supp(spark, sf).where(m % 2 == 0)
    signals = s.where((F.col("signal") > 0) & (m % 3 == 0)).select("symbol", "date", F.lit(1).alias("signal"))
    sizes = s.where(m == 5).select("symbol", "date", F.lit(0.05).alias("size"))
    return rounded(bt.union_align(prices, signals, sizes), [*K, "signal"], ["close", "size"])


_PO = ["gross", "turnover", "ret"]


@dated("bt_portfolio", psql(extra=f"{_BT}, {PORT}", body=f"SELECT date, {qs(_PO)}, {q('value', 2)} FROM po"))
def bt_portfolio(spark, sf):
    h = bt.hold(_grid(spark, sf), _quarter_weights(spark, sf)).withColumn("strategy", F.lit("weights"))
    return rounded(bt.portfolio(h), ["date"], {**dict.fromkeys(_PO, 6), "value": 2})


@dated("bt_run", psql(extra=f"{_BT}, {PORT}".replace("WHERE month(date) % 3 = 0)", "WHERE isodow(date) = 5)"),
                      body=f"SELECT date, {qs(['ret', 'invested'])}, {q('value', 2)} FROM po"))
def bt_run(spark, sf):
    out = bt.run_backtest(t.prices_supp(spark, sf), _signals(spark, sf), "weekly")
    return rounded(out["daily"], ["date"], {"ret": 6, "invested": 6, "value": 2})


# with the optimizer inside there is no SQL form
@dated("bt_run_optimized")
def bt_run_optimized(spark, sf):
    out = bt.run_backtest(t.prices_supp(spark, sf), _signals(spark, sf), "daily", optimizer_rules=op.OptimizerRules(upper=0.1))
    return rounded(out["daily"], ["date"], {"ret": 6, "invested": 6, "value": 2})


_TRD_SQL = f"""pt AS (SELECT *, sum(entry::INTEGER) OVER ({W} ROWS UNBOUNDED PRECEDING) AS p, last_value(close) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lc FROM hd),
tx AS (SELECT symbol, p, max(date) FILTER (WHERE entry) AS entry_date, max(date) FILTER (WHERE exit) AS exit_date, max(close) FILTER (WHERE entry) AS entry_price,
 coalesce(max(close) FILTER (WHERE exit), max(lc)) AS exit_price FROM pt WHERE (entry OR exit) AND p > 0 GROUP BY 1, 2),
td AS (SELECT *, exit_price - entry_price AS pnl, exit_price / entry_price - 1 AS returns, CASE WHEN exit_date IS NULL THEN 'Open' ELSE 'Closed' END AS status FROM tx)"""


@query("bt_trades", sql("bars_brand", extra=f"{SIG_MA_CTE}, {HELD_CTE}, {_TRD_SQL}",
    body=f"SELECT symbol, entry_date, exit_date, status, {q('pnl', 5)}, {q('returns', 5)} FROM td"), dates="entry_date exit_date")
def bt_trades(spark, sf):
    tr = bt.paired_trades(sig.held(sig.ma_cross(t.bars_brand(spark, sf))))
    return rounded(tr, ["symbol", "entry_date", "exit_date", "status"], ["pnl", "returns"], 5)


_TS = ["win_rate", "avg_profit", "avg_loss", "profit_loss_ratio"]


@query("met_tradestats", sql("bars_brand", extra=f"{SIG_MA_CTE}, {HELD_CTE}, {_TRD_SQL}", body=f"""
SELECT symbol, total_trades, {qs(_TS, 5)} FROM (SELECT *, coalesce(abs(avg_profit / nullif(avg_loss, 0)), 0) AS profit_loss_ratio FROM (
SELECT symbol, count(*) AS total_trades, avg((pnl > 0)::INTEGER) AS win_rate, coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0) AS avg_profit,
 coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0) AS avg_loss FROM td GROUP BY symbol))"""))
def met_tradestats(spark, sf):
    tr = bt.paired_trades(sig.held(sig.ma_cross(t.bars_brand(spark, sf))))
    return rounded(met.trade_stats(tr), ["symbol", "total_trades"], _TS, 5)


# monthly strategies over the supplier universe
def _multi(spark, sf):
    p = t.prices_supp(spark, sf)
    s = sig.run_strategies(p, ["ma", "rsi", "momentum"], {
        "ma": {"fast": 3, "slow": 6}, "rsi": {"window": 6}, "momentum": {"lookback": 3, "threshold": 0.1}})
    keyed = s.withColumn("sym", F.col("symbol")).withColumn("symbol", F.concat_ws("|", "strategy", "symbol"))
    return sig.held(keyed).withColumn("symbol", F.col("sym")).drop("sym")


def _multi_sql() -> str:
    w3 = lambda n: f"({W} ROWS {n - 1} PRECEDING)"
    st = lambda c, n: f"CASE WHEN count({c}) OVER {w3(n)} = {n} THEN avg({c}) OVER {w3(n)} END"
    return f"""
q0 AS (SELECT *, close - lag(close) OVER ({W}) AS chg FROM prices_supp),
q1 AS (SELECT *, CASE WHEN chg > 0 THEN chg ELSE 0.0 END AS gn, CASE WHEN chg < 0 THEN -chg ELSE 0.0 END AS ls FROM q0),
q2 AS (SELECT *, {st('close', 3)} AS f, {st('close', 6)} AS s, {st('gn', 6)} AS g, {st('ls', 6)} AS l, close / nullif(lag(close, 3) OVER ({W}), 0) - 1 AS m FROM q1),
q3 AS (SELECT *, CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 END ELSE 100 - 100 / (1 + g / l) END AS rsi FROM q2),
q4 AS (SELECT *, lag(f) OVER ({W}) AS pf, lag(s) OVER ({W}) AS ps, lag(rsi) OVER ({W}) AS pr FROM q3),
q5 AS (SELECT 'ma' AS strategy, symbol, date, close, CASE WHEN f > s AND pf <= ps THEN 1 WHEN f < s AND pf >= ps THEN -1 ELSE 0 END AS signal FROM q4
 UNION ALL SELECT 'rsi', symbol, date, close, CASE WHEN rsi < 30 AND pr >= 30 THEN 1 WHEN rsi > 70 AND pr <= 70 THEN -1 ELSE 0 END FROM q4
 UNION ALL SELECT 'momentum', symbol, date, close, CASE WHEN m < -0.1 THEN -1 WHEN m > 0.1 THEN 1 ELSE 0 END FROM q4),
q6 AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING), -1) > 0 AS held,
 coalesce(last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev FROM q5),
q7 AS (SELECT *, held::INTEGER::DOUBLE / (SELECT count(DISTINCT symbol) FROM prices_supp) AS weight, signal > 0 AND prev < 0 AS entry, signal < 0 AND prev > 0 AS exit FROM q6),
q8 AS (SELECT strategy, date, weight, coalesce(lag(weight) OVER v, 0) AS pw, coalesce(close / nullif(lag(close) OVER v, 0) - 1, 0) AS r FROM q7 WINDOW v AS (PARTITION BY strategy, symbol ORDER BY date)),
q9 AS (SELECT strategy, date, sum(pw * r) - sum(abs(weight - pw)) * 0.0013 AS ret, sum(weight) AS invested FROM q8 GROUP BY 1, 2),
qa AS (SELECT *, 1000000 * product(1 + ret) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM q9),
qb AS (SELECT *, greatest(max(value) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING), 1000000) AS peak FROM qa),
qc AS (SELECT strategy, count(*) AS n, arg_max(value, date) AS final_value, min(value / peak - 1) AS max_drawdown, stddev_samp(ret) AS sd, avg(ret) AS m,
 max(value * (1 - invested)) AS max_cash, min(value * (1 - invested)) AS min_cash FROM qb GROUP BY 1),
qd AS (SELECT *, sum(entry::INTEGER) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS p,
 last_value(close) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lc FROM q7),
qe AS (SELECT strategy, max(close) FILTER (WHERE entry) AS a, coalesce(max(close) FILTER (WHERE exit), max(lc)) AS b FROM qd WHERE (entry OR exit) AND p > 0 GROUP BY strategy, symbol, p),
qf AS (SELECT strategy, count(*) AS total_trades, avg((b > a)::INTEGER) AS win_rate, sum(b - a) FILTER (WHERE b > a) / sum(a - b) FILTER (WHERE b < a) AS profit_factor, avg(b / a - 1) AS avg_trade_return FROM qe GROUP BY 1),
ms AS (SELECT strategy, final_value / 1000000 - 1 AS total_return, pow(final_value / 1000000, 252.0 / n) - 1 AS annualized_return, max_drawdown, sd * sqrt(252) AS volatility,
 (m - 0.02 / 252) / sd * sqrt(252) AS sharpe_ratio, (pow(final_value / 1000000, 252.0 / n) - 1) / abs(max_drawdown) AS calmar_ratio, total_trades, win_rate, profit_factor, avg_trade_return,
 max_cash, min_cash, final_value FROM qc JOIN qf USING (strategy))"""


_MS = {"total_return": 6, "annualized_return": 1, "max_drawdown": 6, "volatility": 6, "sharpe_ratio": 6, "calmar_ratio": 0, "win_rate": 6,
       "profit_factor": 6, "avg_trade_return": 6, "max_cash": 2, "min_cash": 2, "final_value": 2}


def _stats(spark, sf):
    m = _multi(spark, sf)
    daily = bt.portfolio(bt.signal_weights(m))
    return bt.portfolio_stats(daily, bt.paired_trades(m, ("strategy", "symbol")))


@query("met_portstats", psql(extra=_multi_sql(), body="SELECT strategy, total_trades, " + ", ".join(q(c, d) for c, d in _MS.items()) + " FROM ms"))
def met_portstats(spark, sf):
    return rounded(_stats(spark, sf), ["strategy", "total_trades"], _MS)


_SUM = ["total_return", "annualized_return", "max_drawdown", "sharpe_ratio", "win_rate"]


@query("bt_multi", psql(extra=_multi_sql(), body="SELECT strategy, total_trades, " + ", ".join(q(c, _MS[c]) for c in _SUM) + " FROM ms"))
def bt_multi(spark, sf):
    return rounded(_stats(spark, sf), ["strategy", "total_trades"], {c: _MS[c] for c in _SUM})


@query("udf_strategy", psql(extra=f"""vv AS (SELECT symbol, date, CASE WHEN close > 1.1::DOUBLE * avg(close) OVER ({W} ROWS 2 PRECEDING) THEN 1 ELSE 0 END AS signal FROM prices_supp)""",
    body="SELECT symbol, count(*) FILTER (WHERE signal = 1) AS buys FROM vv GROUP BY symbol"))
def udf_strategy(spark, sf):
    """A user function registered by name and run like a built-in strategy."""
    def breakout(bars, n=3, factor=1.1):
        from ..functions.guards import trailing

        return bars.withColumn("signal", F.when(F.col("close") > factor * F.avg("close").over(trailing(n)), 1).otherwise(0))

    if "breakout" not in sig.STRATEGIES:
        sig.register_strategy("breakout", breakout)
    s = sig.run_strategies(t.prices_supp(spark, sf), ["breakout"])
    return s.groupBy("symbol").agg(F.count_if(F.col("signal") == 1).alias("buys"))
