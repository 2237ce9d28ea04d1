"""Registered queries: constraints and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as con
from ..operators import costs
from ..operators import signals as sig
from ..functions import rules
from ..sources import tables as t
from .indicator_queries import SIG_MOM_CTE, W, cross_sql, strict_sql
from .registry import dated, query
from .shape import q, qs, rounded
from .views_sql import sql

# -- constraints ----------------------------------------------------------

_MOM = ("bars_brand",)


def _raw(spark, sf):
    return sig.momentum(t.bars_brand(spark, sf)).select("symbol", "date", "close", "volume", "signal")


_SM = """sm AS (SELECT b.symbol, b.date, b.close, b.volume, m.signal FROM bars_brand b JOIN mo m USING (symbol, date))"""
_T1 = f"""t1 AS (SELECT * REPLACE (CAST(CASE WHEN signal < 0 THEN greatest(signal, -bought) ELSE signal END AS BIGINT) AS signal)
  FROM (SELECT *, signal AS raw_signal, coalesce(sum(CASE WHEN signal > 0 THEN signal END)
    OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bought FROM sm))"""


@dated("win_tplus1", sql(*_MOM, extra=f"{SIG_MOM_CTE}, {_SM}, {_T1}", body="SELECT symbol, date, raw_signal, signal FROM t1"))
def win_tplus1(spark, sf):
    df = _raw(spark, sf).withColumn("raw_signal", F.col("signal"))
    return con.t_plus_1(df).select("symbol", "date", "raw_signal", F.col("signal").cast("long").alias("signal"))


_INFO = """inf AS (SELECT p_brand AS symbol, CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 3 = 0 THEN 'star_market'
    WHEN CAST(substr(p_brand, 7) AS INTEGER) % 3 = 1 THEN 'beijing_stock' ELSE 'main_board' END AS market_type,
    CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 5 = 0 THEN 'st' ELSE 'normal' END AS status,
    make_date(1995 + CAST(max(p_size) % 3 AS INTEGER), 1, 1) AS listing_date FROM part GROUP BY p_brand)"""


def _info(spark, sf):
    no = F.substring("p_brand", 7, 9).cast("int")
    return t.table(spark, sf, "part").groupBy(F.col("p_brand").alias("symbol")).agg(
        F.max("p_size").alias("_s")
    ).select(
        "symbol",
        F.when(F.substring("symbol", 7, 9).cast("int") % 3 == 0, "star_market")
        .when(F.substring("symbol", 7, 9).cast("int") % 3 == 1, "beijing_stock")
        .otherwise("main_board")
        .alias("market_type"),
        F.when(F.substring("symbol", 7, 9).cast("int") % 5 == 0, "st").otherwise("normal").alias("status"),
        F.make_date(1995 + F.col("_s") % 3, F.lit(1), F.lit(1)).alias("listing_date"),
    )


_LIM = f"""lm AS (SELECT *, prev * (1 - ratio) AS lower_limit, prev * (1 + ratio) AS upper_limit FROM (
  SELECT s.*, lag(close) OVER ({W}) AS prev, CASE WHEN date - listing_date <= 30 THEN 0.44::DOUBLE
   WHEN status IN ('st', 'star_st') THEN 0.05::DOUBLE WHEN market_type = 'star_market' THEN 0.2::DOUBLE
   WHEN market_type = 'beijing_stock' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS ratio FROM {{src}} s JOIN inf USING (symbol)))"""
_PL = "CASE WHEN close >= upper_limit * 0.999::DOUBLE THEN CASE WHEN signal > 0 THEN 0 ELSE signal END " \
      "WHEN close <= lower_limit * 1.001::DOUBLE THEN CASE WHEN signal < 0 THEN 0 ELSE signal END ELSE signal END"


@dated(
    "win_pricelimit",
    sql(*_MOM, extra=f"{SIG_MOM_CTE}, {_SM}, {_INFO}, {_LIM.format(src='sm')}",
        body=f"SELECT symbol, date, {qs(['lower_limit', 'upper_limit'], 5)}, CAST({_PL} AS INTEGER) AS signal FROM lm"),
)
def win_pricelimit(spark, sf):
    df = con.price_limit(con.with_limits(_raw(spark, sf), _info(spark, sf)))
    return rounded(df, ["symbol", "date", "signal"], ["lower_limit", "upper_limit"], 5)


_SUSP = "sus AS (SELECT DISTINCT symbol, date FROM bars_brand WHERE extract(day FROM date) = 13)"


def _suspensions(spark, sf):
    return t.bars_brand(spark, sf).where(F.dayofmonth("date") == 13).select("symbol", "date")


@dated(
    "con_suspend",
    sql(*_MOM, extra=f"{SIG_MOM_CTE}, {_SM}, {_SUSP}", body="""SELECT s.symbol, s.date,
 CAST(CASE WHEN sus.date IS NOT NULL OR volume = 0 THEN 0 ELSE signal END AS INTEGER) AS signal
FROM sm s LEFT JOIN sus ON s.symbol = sus.symbol AND s.date = sus.date"""),
)
def con_suspend(spark, sf):
    return con.suspend(_raw(spark, sf), _suspensions(spark, sf)).select("symbol", "date", "signal")


@dated(
    "con_all",
    sql(*_MOM, extra=f"{SIG_MOM_CTE}, {_SM}, {_T1}, {_INFO}, {_LIM.format(src='t1')}, {_SUSP}", body=f"""
SELECT l.symbol, l.date, raw_signal, CAST(CASE WHEN sus.date IS NOT NULL OR volume = 0 THEN 0 ELSE {_PL} END AS BIGINT) AS signal
FROM lm l LEFT JOIN sus ON l.symbol = sus.symbol AND l.date = sus.date"""),
)
def con_all(spark, sf):
    df = con.apply_rules(_raw(spark, sf), info=_info(spark, sf), suspensions=_suspensions(spark, sf))
    return df.select("symbol", "date", "raw_signal", F.col("signal").cast("long").alias("signal"))


@dated(
    "jn_suspension",
    sql("bars_brand", extra=f"{SIG_MOM_CTE}, {_SUSP}", body="""SELECT m.symbol, m.date, sus.date IS NOT NULL AS suspended
FROM mo m LEFT JOIN sus ON m.symbol = sus.symbol AND m.date = sus.date"""),
)
def jn_suspension(spark, sf):
    marked = _suspensions(spark, sf).withColumn("_m", F.lit(True))
    df = _raw(spark, sf).join(marked, ["symbol", "date"], "left")
    return df.select("symbol", "date", F.col("_m").isNotNull().alias("suspended"))


@dated(
    "jn_limitlookup",
    sql(*_MOM, extra=f"{SIG_MOM_CTE}, {_SM}, {_INFO}, {_LIM.format(src='sm')}", body=f"""
SELECT symbol, date, n, {qs(['lower_limit', 'upper_limit'], 5)} FROM lm JOIN (
 SELECT p_brand AS symbol, CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders JOIN part ON o_custkey = p_partkey GROUP BY 1, 2)
USING (symbol, date)"""),
)
def jn_limitlookup(spark, sf):
    """Limit prices of the (symbol, date) pairs that orders ask for."""
    o, p = t.table(spark, sf, "orders"), t.table(spark, sf, "part")
    asked = (
        o.join(p, o.o_custkey == p.p_partkey)
        .groupBy(F.col("p_brand").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    lim = con.with_limits(_raw(spark, sf), _info(spark, sf))
    return rounded(asked.join(lim, ["symbol", "date"]), ["symbol", "date", "n"], ["lower_limit", "upper_limit"], 5)


@query(
    "jn_stockinfo",
    "WITH " + _INFO + """, cs AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN p_brand
   ELSE lpad(CAST((l_partkey * 7919) % 1000000 AS VARCHAR), 6, '0') END AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT symbol, coalesce(inf.market_type, CASE WHEN starts_with(symbol, '00') THEN 'main_board' WHEN starts_with(symbol, '30') THEN 'chinext'
  WHEN starts_with(symbol, '68') THEN 'star_market' WHEN starts_with(symbol, '6') THEN 'main_board'
  WHEN starts_with(symbol, '8') OR starts_with(symbol, '4') THEN 'beijing_stock' ELSE 'main_board' END) AS market_type,
  coalesce(inf.status, 'normal') AS status FROM cs LEFT JOIN inf USING (symbol)""",
)
def jn_stockinfo(spark, sf):
    li, p = t.table(spark, sf, "lineitem"), t.table(spark, sf, "part")
    code = F.lpad(((F.col("l_partkey") * 7919) % 1000000).cast("string"), 6, "0")
    codes = li.join(p, li.l_partkey == p.p_partkey).select(
        F.when(F.col("l_partkey") % 2 == 0, F.col("p_brand")).otherwise(code).alias("symbol")
    ).distinct()
    return codes.join(_info(spark, sf), "symbol", "left").select(
        "symbol",
        F.coalesce("market_type", rules.market_type("symbol")).alias("market_type"),
        F.coalesce("status", rules.stock_status("symbol")).alias("status"),
    )


# -- costs ----------------------------------------------------------------


def cost_sql(rate: float, com_min: float, slip: float, impact: bool, fee: float = 0.00002) -> str:
    base = f"(amount * {slip!r}::DOUBLE)"
    mi = f"""CASE WHEN amount < 100000 THEN 0 ELSE greatest((amount * 0.0001::DOUBLE * ((amount - 100000) / 100000)
      + coalesce(amount * bid_ask_spread * 0.5::DOUBLE, 0)) * CASE WHEN market_cap < 1e10 THEN 1.2::DOUBLE ELSE 1 END, 0) END""" if impact else "0"
    return f"""
c0 AS (SELECT *, greatest(amount * {rate!r}::DOUBLE, {com_min}) AS commission, CASE WHEN side = 'sell' THEN amount * 0.001::DOUBLE ELSE 0 END AS stamp_tax,
  CASE WHEN starts_with(symbol, '6') THEN greatest(amount * {fee!r}::DOUBLE, 1.0) ELSE 0 END AS transfer_fee,
  CASE WHEN avg_volume IS NULL THEN {base} ELSE greatest(({base} + CASE WHEN avg_volume > 0 THEN {base} * (quantity / avg_volume) * 0.1::DOUBLE ELSE 0 END
    + CASE WHEN volatility > 0 THEN {base} * volatility * 0.05::DOUBLE ELSE 0 END)
    * CASE WHEN avg_volume < 1000000 THEN 1.5::DOUBLE ELSE 1 END, 0) END AS slippage,
  {mi} AS market_impact FROM trades),
c1 AS (SELECT *, commission + stamp_tax + transfer_fee + slippage + market_impact AS total_cost FROM c0),
cs AS (SELECT *, total_cost / nullif(amount, 0) AS cost_rate FROM c1)"""


STANDARD_SQL = cost_sql(0.0005, 5.0, 0.0005, True)
_CK = ["order_id", "line", "symbol", "side"]


def _component(name: str, cols: list[str], model=costs.STANDARD, text: str = STANDARD_SQL) -> None:
    @query(name, sql("trades", extra=text, body=f"SELECT {', '.join(_CK)}, {q('amount', 2)}, {qs(cols, 5)} FROM cs"))
    def run(spark, sf):
        df = costs.with_costs(t.trades(spark, sf), model)
        return rounded(df, _CK, {"amount": 2, **dict.fromkeys(cols, 5)})


_component("scl_commission", ["commission"])
_component("scl_stamp", ["stamp_tax"])
_component("scl_transfer", ["transfer_fee"])
_component("scl_slippage", ["slippage"])
_component("scl_impact", ["market_impact"])
_component("scl_cost", costs.COMPONENTS + ["total_cost", "cost_rate"])
_component("scl_cost_discount", ["total_cost", "cost_rate"], costs.DISCOUNT, cost_sql(0.0003, 1.0, 0.0003, True))
_component("scl_cost_minimal", ["total_cost", "cost_rate"], costs.MINIMAL,
           cost_sql(0.0005, 0.1, 0.0001, False, 0.00001))

_REP = {
    "total_cost": 2, "total_amount": 2, "average_cost_rate": 8, "rate_mean": 8, "rate_std": 8, "rate_min": 8, "rate_max": 8,
    "rate_p25": 8, "rate_p50": 8, "rate_p75": 8, "rate_p95": 8, **{f"{c}_pct": 5 for c in costs.COMPONENTS},
}
_REP_SQL = f"""rp AS (SELECT count(*) AS total_trades, sum(total_cost) AS total_cost, sum(amount) AS total_amount,
 sum(total_cost) / sum(amount) AS average_cost_rate, avg(cost_rate) AS rate_mean, stddev_samp(cost_rate) AS rate_std,
 min(cost_rate) AS rate_min, max(cost_rate) AS rate_max, quantile_cont(cost_rate, 0.25) AS rate_p25, quantile_cont(cost_rate, 0.5) AS rate_p50,
 quantile_cont(cost_rate, 0.75) AS rate_p75, quantile_cont(cost_rate, 0.95) AS rate_p95,
 {', '.join(f'sum({c}) / sum(total_cost) * 100 AS {c}_pct' for c in costs.COMPONENTS)} FROM cs)"""


@query(
    "agg_costreport",
    sql("trades", extra=STANDARD_SQL + ", " + _REP_SQL,
        body="SELECT total_trades, " + ", ".join(q(c, d) for c, d in _REP.items()) + " FROM rp"),
)
def agg_costreport(spark, sf):
    return rounded(costs.cost_report(costs.with_costs(t.trades(spark, sf))), ["total_trades"], _REP)


@query(
    "agg_costadvice",
    sql("trades", extra=STANDARD_SQL, body="""
SELECT code FROM (SELECT avg(cost_rate) AS r, sum(commission) / sum(total_cost) AS c, sum(slippage) / sum(total_cost) AS s, count(*) AS n FROM cs),
LATERAL (SELECT 'high_cost_rate' AS code WHERE r > 0.005 UNION ALL SELECT 'high_commission' WHERE c > 0.4
  UNION ALL SELECT 'high_slippage' WHERE s > 0.3 UNION ALL SELECT 'too_frequent' WHERE n > 1000
  UNION ALL SELECT 'fine' WHERE NOT (r > 0.005 OR c > 0.4 OR s > 0.3 OR n > 1000))"""),
)
def agg_costadvice(spark, sf):
    return costs.cost_advice(costs.with_costs(t.trades(spark, sf))).select("code")


_IMP = ["average_cost_rate", "annual_cost_drag", "gross_annual_return", "net_annual_return", "cost_impact_on_return",
        "cost_adjusted_sharpe_ratio"]


@query(
    "agg_costimpact",
    sql("trades", "returns_book", extra=STANDARD_SQL, body=f"""
SELECT strategy, {qs(_IMP)} FROM (SELECT strategy, r AS average_cost_rate, r * 2 AS annual_cost_drag, g AS gross_annual_return,
 g - r * 2 AS net_annual_return, r * 2 / abs(g) AS cost_impact_on_return,
 (m - r * 2 / 252 - 0.03 / 252) / sd * sqrt(252) AS cost_adjusted_sharpe_ratio
FROM (SELECT strategy, avg(ret) AS m, stddev_samp(ret) AS sd, pow(1 + avg(ret), 252) - 1 AS g FROM returns_book GROUP BY 1)
JOIN (SELECT avg(cost_rate) AS r FROM cs) ON true)"""),
)
def agg_costimpact(spark, sf):
    rate = costs.with_costs(t.trades(spark, sf)).agg(F.avg("cost_rate").alias("average_cost_rate"))
    return rounded(costs.cost_impact(t.returns_book(spark, sf), rate), ["strategy"], _IMP)
