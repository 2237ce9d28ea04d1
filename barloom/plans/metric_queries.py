"""Registered queries: return series, metrics, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as met
from ..sources import tables as t
from .registry import dated, query
from .shape import q, qs, rounded
from .views_sql import sql

WS = "PARTITION BY strategy ORDER BY date"
WU = f"({WS} ROWS UNBOUNDED PRECEDING)"

# The SQL engine multiplies window frames in tree order, so on a day without a
# return its value may differ from the peak by one unit in the last place.
# Returns have 8 digits; a real drawdown is never below 1e-12.
CURVE = f"""
cv AS (SELECT *, product(1 + ret) OVER {WU} AS value, row_number() OVER ({WS}) AS rn FROM returns_book),
cp AS (SELECT *, max(value) OVER {WU} AS peak FROM cv),
cd AS (SELECT *, round((value - peak) / peak, 12) AS drawdown FROM cp)"""


def metrics_cte(src: str, cv: str, out: str, bench: bool) -> str:
    join = "LEFT JOIN returns_benchmark USING (date)" if bench else ""
    pair = "CASE WHEN bench IS NOT NULL THEN ret END"
    rel_a = f""", stddev_samp({pair} - bench) AS te0, avg({pair} - bench) AS ex, var_samp(bench) AS bv,
      covar_samp({pair}, bench) AS cov, corr({pair}, bench) AS co, avg(bench) AS bm""" if bench else ""
    rel_c = """, te0 * sqrt(252) AS tracking_error,
      CASE WHEN te0 > 0 THEN ex * 252 / (te0 * sqrt(252)) END AS information_ratio,
      CASE WHEN bv > 0 THEN cov / bv END AS beta,
      annualized_return - (0.03 + cov / bv * (pow(1 + bm, 252) - 1 - 0.03)) AS alpha,
      CASE WHEN bv > 0 THEN co * co END AS r_squared""" if bench else ""
    return f"""
{out}0 AS (SELECT *, rn - coalesce(max(CASE WHEN drawdown >= 0 THEN rn END) OVER {WU}, 0) AS run,
      quantile_cont(ret, 0.05) OVER (PARTITION BY strategy) AS var FROM {cv} {join}),
{out}1 AS (SELECT strategy, count(*) AS n, arg_max(value, date) AS growth, stddev_samp(ret) AS sd,
      stddev_samp(ret) FILTER (WHERE ret < 0) AS dsd, count(*) FILTER (WHERE ret < 0) AS neg,
      min(drawdown) AS max_drawdown, coalesce(avg(drawdown) FILTER (WHERE drawdown < 0), 0) AS avg_drawdown,
      max(run) AS max_drawdown_duration, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis, max(var) AS var_95,
      avg(ret) FILTER (WHERE ret <= var) AS cvar_95, count(*) FILTER (WHERE ret > 0) AS pos,
      avg(ret) FILTER (WHERE ret > 0) AS win, avg(ret) FILTER (WHERE ret < 0) AS loss, avg(ret) AS expectancy
      {rel_a} FROM {out}0 GROUP BY strategy),
{out}2 AS (SELECT *, growth - 1 AS total_return, growth - 1 AS cumulative_return,
      CASE WHEN growth > 0 THEN pow(growth, 252.0 / n) - 1 ELSE 0 END AS annualized_return,
      sd * sqrt(252) AS volatility, CASE WHEN neg > 0 THEN dsd * sqrt(252) ELSE 0 END AS downside_volatility,
      pos::DOUBLE / n AS win_rate, coalesce(abs(win / nullif(loss, 0)), 0) AS profit_loss_ratio FROM {out}1),
{out} AS (SELECT *, CASE WHEN volatility > 0 THEN (annualized_return - 0.03) / volatility ELSE 0 END AS sharpe_ratio,
      CASE WHEN downside_volatility > 0 THEN (annualized_return - 0.03) / downside_volatility ELSE 0 END AS sortino_ratio,
      CASE WHEN abs(max_drawdown) > 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar_ratio,
      CASE WHEN abs(max_drawdown) > 0 THEN total_return / abs(max_drawdown) ELSE 0 END AS recovery_factor
      {rel_c} FROM {out}2)"""


MET = CURVE + "," + metrics_cte("returns_book", "cd", "met", True)
VIEWS = ("returns_book", "returns_benchmark")
DIG = {c: 6 for c in met.ABSOLUTE + met.RELATIVE} | {"max_drawdown_duration": 0}


def _family(name: str, cols: list[str], bench: bool = False) -> None:
    body = "SELECT strategy, " + ", ".join(q(c, DIG[c]) for c in cols) + " FROM met"

    @query(name, sql(*VIEWS, extra=MET, body=body))
    def run(spark, sf):
        m = met.metrics(t.returns_book(spark, sf), t.returns_benchmark(spark, sf) if bench else None)
        return rounded(m, ["strategy"], {c: DIG[c] for c in cols})


_family("met_return", met.RETURN)
_family("met_risk", met.RISK)
_family("met_riskadj", met.RISK_ADJUSTED)
_family("met_drawdown", met.DRAWDOWN)
_family("met_dist", met.DISTRIBUTION)
_family("met_trading", met.TRADING)
_family("met_relative", met.RELATIVE, bench=True)
_family("jn_inner_bench", ["tracking_error", "beta", "r_squared"], bench=True)
_family("met_all", met.ABSOLUTE + met.RELATIVE, bench=True)
_family("met_basic", met.BASIC)
_family("met_riskreturn", ["annualized_return", "volatility"])

_BENCH_CTE = f""",
bcv AS (SELECT 'Benchmark' AS strategy, date, bench AS ret, product(1 + bench) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS value,
   row_number() OVER (ORDER BY date) AS rn FROM returns_benchmark),
bcp AS (SELECT *, max(value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM bcv),
bcd AS (SELECT *, round((value - peak) / peak, 12) AS drawdown FROM bcp),""" + metrics_cte("", "bcd", "bm", False)


@query(
    "met_compare",
    sql(*VIEWS, extra=MET + _BENCH_CTE, body="SELECT strategy, "
        + ", ".join(q(c, DIG[c]) for c in met.ABSOLUTE + ["beta"]) + " FROM (SELECT * FROM met UNION ALL BY NAME SELECT * FROM bm)"),
)
def met_compare(spark, sf):
    m = met.compare(t.returns_book(spark, sf), t.returns_benchmark(spark, sf))
    return rounded(m, ["strategy"], {c: DIG[c] for c in met.ABSOLUTE + ["beta"]})


@dated("win_cumret", sql("returns_book", extra=CURVE, body=f"SELECT strategy, date, {q('value')} FROM cd"))
def win_cumret(spark, sf):
    return rounded(met.curve(t.returns_book(spark, sf)), ["strategy", "date"], ["value"])


@dated("win_drawdown", sql("returns_book", extra=CURVE, body=f"SELECT strategy, date, {qs(['peak', 'drawdown'])} FROM cd"))
def win_drawdown(spark, sf):
    return rounded(met.curve(t.returns_book(spark, sf)), ["strategy", "date"], ["peak", "drawdown"])


_ROLL = ["annualized_return", "volatility", "sharpe_ratio", "max_drawdown"]
# the worst fall inside each frame by brute force: every later low against every earlier high
_ROLL_SQL = f"""
rw AS (SELECT strategy, date, rn, value, stddev_samp(ret) OVER ({WS} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) * sqrt(252) AS volatility,
       value / coalesce(lag(value, 252) OVER ({WS}), 1) - 1 AS annualized_return FROM cv),
pk AS (SELECT a.strategy, a.rn AS first_rn, b.rn, b.value / max(b.value) OVER (PARTITION BY a.strategy, a.rn ORDER BY b.rn) - 1 AS dd
       FROM cv a JOIN cv b ON a.strategy = b.strategy AND b.rn BETWEEN a.rn AND a.rn + 251),
md AS (SELECT strategy, first_rn + 251 AS rn, min(dd) AS max_drawdown FROM pk GROUP BY 1, 2)"""


@dated(
    "win_rollmet",
    sql("returns_book", extra=CURVE + "," + _ROLL_SQL, body=f"""
SELECT strategy, date, {qs(_ROLL)} FROM (SELECT *, (annualized_return - 0.03) / volatility AS sharpe_ratio
FROM rw JOIN md USING (strategy, rn) WHERE rn >= 252)"""),
)
def win_rollmet(spark, sf):
    return rounded(met.rolling_metrics(t.returns_book(spark, sf)), ["strategy", "date"], _ROLL)


_PER = ["period_return", "cumulative_return", "volatility", "sharpe_ratio", "max_drawdown"]
_PER_END = {
    "weekly": "CAST(date_trunc('week', date) AS DATE) + 6",
    "monthly": "last_day(date)",
    "quarterly": "last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE))",
    "yearly": "make_date(year(date), 12, 31)",
}
_PER_STEP = {"weekly": ("week", "1 WEEK"), "monthly": ("month", "1 MONTH"), "quarterly": ("quarter", "3 MONTH"), "yearly": ("year", "1 YEAR")}
_PER_GRID = " UNION ALL ".join(
    f"SELECT strategy, period, {_PER_END[k]} AS period_end FROM (SELECT strategy, period, "
    f"CAST(unnest(generate_series(date_trunc('{u}', lo), hi::TIMESTAMP, INTERVAL {i})) AS DATE) AS date FROM ps WHERE period = '{k}')"
    for k, (u, i) in _PER_STEP.items())
_PER_LAST = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY strategy, period ORDER BY period_end ROWS UNBOUNDED PRECEDING) AS {c}"
    for c in ("cumulative_return", "volatility", "n", "max_drawdown"))
_PER_SQL = f"""
p0 AS (SELECT *, count(*) OVER {WU} AS n, stddev_samp(ret) OVER {WU} AS sd, min(drawdown) OVER {WU} AS mdd FROM cd),
p1 AS ({' UNION ALL '.join(f"SELECT '{k}' AS period, {e} AS period_end, * FROM p0" for k, e in _PER_END.items())}),
p2 AS (SELECT strategy, period, period_end, product(1 + ret) - 1 AS period_return, arg_max(value, date) - 1 AS cumulative_return,
   arg_max(sd, date) * sqrt(252) AS volatility, max(n) AS n, min(mdd) AS max_drawdown FROM p1 GROUP BY 1, 2, 3),
ps AS (SELECT strategy, period, min(period_end) AS lo, max(period_end) AS hi FROM p2 GROUP BY 1, 2),
pg AS ({_PER_GRID}),
pf AS (SELECT strategy, period, period_end, coalesce(period_return, 0) AS period_return, {_PER_LAST} FROM pg LEFT JOIN p2 USING (strategy, period, period_end)),
p3 AS (SELECT *, CASE WHEN volatility > 0 THEN (pow(1 + cumulative_return, 252.0 / n) - 1 - 0.03) / volatility ELSE 0 END AS sharpe_ratio FROM pf)"""


@query(
    "met_period",
    # the first weeks are annualized from a few days; the ratio is compared by its leading digits
    sql("returns_book", extra=CURVE + "," + _PER_SQL, body="SELECT strategy, period, period_end, "
        + qs([c for c in _PER if c != "sharpe_ratio"]) + ", " + "format('{:.4e}', sharpe_ratio::DOUBLE) AS sharpe_ratio FROM p3"),
    dates="period_end",
)
def met_period(spark, sf):
    r = t.returns_book(spark, sf)
    out = None
    for p in _PER_END:
        m = met.period_metrics(r, p).withColumn("period", F.lit(p))
        out = m if out is None else out.unionByName(m)
    text = F.format_string("%.4e", F.col("sharpe_ratio").cast("double")).alias("sharpe_ratio")
    return rounded(out, ["strategy", "period", "period_end", text], [c for c in _PER if c != "sharpe_ratio"])


_MON = [f"m{m:02d}" for m in range(1, 13)]


@query(
    "met_monthly",
    sql("returns_book", body="SELECT strategy, year, " + ", ".join(
        q(f"max(r) FILTER (WHERE m = {i + 1})", 5, c) for i, c in enumerate(_MON))
        + """ FROM (SELECT strategy, CAST(year(date) AS INTEGER) AS year, month(date) AS m, (product(1 + ret) - 1) * 100 AS r
FROM returns_book GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
)
def met_monthly(spark, sf):
    return rounded(met.monthly_table(t.returns_book(spark, sf)), ["strategy", "year"], _MON, 5)


@query(
    "met_hist",
    sql("returns_book", body="""
SELECT strategy, CAST(least(floor((ret - lo) / nullif(hi - lo, 0) * 50), 49) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT *, min(ret) OVER (PARTITION BY strategy) AS lo, max(ret) OVER (PARTITION BY strategy) AS hi FROM returns_book)
GROUP BY 1, 2"""),
)
def met_hist(spark, sf):
    return met.histogram(t.returns_book(spark, sf))


_BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query(
    "met_qq_box",
    sql("returns_book", body=f"""
SELECT strategy, {qs(_BOX)} FROM (
 SELECT strategy, max(q1) AS q1, max(median) AS median, max(q3) AS q3,
   min(r) FILTER (WHERE r >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(r) FILTER (WHERE r <= q3 + 1.5 * (q3 - q1)) AS whisker_high
 FROM (SELECT strategy, ret * 100 AS r, quantile_cont(ret * 100, 0.25) OVER p AS q1, quantile_cont(ret * 100, 0.5) OVER p AS median,
   quantile_cont(ret * 100, 0.75) OVER p AS q3 FROM returns_book WINDOW p AS (PARTITION BY strategy)) GROUP BY 1)"""),
)
def met_qq_box(spark, sf):
    return rounded(met.box(t.returns_book(spark, sf)), ["strategy"], _BOX)


@query(
    "met_qq_points",
    sql("returns_book", body=f"""SELECT strategy, rank, {qs(["p", "theoretical", "ordered"])} FROM (SELECT *, {met.normal_quantile("p")} AS theoretical FROM (
 SELECT strategy, rank, ret * 100 AS ordered, CASE WHEN rank = n THEN pow(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - pow(0.5, 1.0 / n)
  ELSE (rank - 0.3175) / (n + 0.365) END AS p
 FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY ret, date) AS rank, count(*) OVER (PARTITION BY strategy) AS n FROM returns_book)))"""),
)
def met_qq_points(spark, sf):
    return rounded(met.qq_points(t.returns_book(spark, sf)), ["strategy", "rank"], ["p", "theoretical", "ordered"])
