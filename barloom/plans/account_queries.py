"""Registered queries: orders, ledger, request and chat statistics, business tables, result stores, reports."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import ledger as lg
from ..operators import metrics as met
from ..operators import selection as sl
from ..operators import signals as sig
from ..operators import stats as ss
from ..operators import backtest as bt
from ..operators.asof import asof_join
from ..session import cut_lineage, scratch_path
from ..sources import business as bz
from ..sources import plugins
from ..sources import results as rs
from ..sources import tables as t
from ..sources.store import BarStore
from ..streaming.jobs import to_files
from .indicator_queries import HELD_CTE, SIG_MA_CTE
from .metric_queries import MET
from .registry import dated, query
from .shape import q, qs, rounded
from .views_sql import sql

# -- orders and fills -----------------------------------------------------

_ORD = """od AS (SELECT o_orderkey AS order_id, 'Brand#' || (1 + o_custkey % 27) AS symbol, CAST(o_orderdate AS DATE) AS date,
 CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(1 + o_custkey % 50 AS DOUBLE) AS quantity FROM orders)"""
_ASOF = """af AS (SELECT od.*, (SELECT arg_max(b.close, b.date) FROM bars_brand b WHERE b.symbol = od.symbol AND b.date BETWEEN od.date - 5 AND od.date) AS last_close FROM od)"""
_FILL = """fl AS (SELECT *, CASE WHEN fill_price IS NULL THEN 'PENDING' ELSE 'FILLED' END AS status, quantity * fill_price * 0.0003 AS commission,
 quantity * fill_price * 1.0003 AS total_amount FROM (SELECT *, last_close * CASE WHEN side = 'BUY' THEN 1.001 ELSE 0.999 END AS fill_price FROM af))"""


def _orders(spark, sf):
    o = t.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 27).cast("string")).alias("symbol"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        (1 + F.col("o_custkey") % 50).cast("double").alias("quantity"),
    )


@query("jn_asof_fill", sql("bars_brand", extra=f"{_ORD}, {_ASOF}", body=f"SELECT order_id, symbol, {q('last_close', 5)} FROM af"))
def jn_asof_fill(spark, sf):
    return rounded(lg.asof_close(_orders(spark, sf), t.bars_brand(spark, sf)), ["order_id", "symbol"], ["last_close"], 5)


@query("jn_asof_any", sql("bars_brand", extra=_ORD, body=f"""SELECT od.order_id, od.symbol, b.date AS bar_date, {q('b.close', 5, 'last_close')}
FROM od ASOF LEFT JOIN bars_brand b ON od.symbol = b.symbol AND od.date >= b.date"""), dates="bar_date")
def jn_asof_any(spark, sf):
    """The last close before each order, however old."""
    closes = t.bars_brand(spark, sf).select("symbol", "date", F.col("close").alias("last_close"))
    met_at = asof_join(_orders(spark, sf), closes, ["symbol"], "date", ["last_close"], matched_at="bar_date")
    return rounded(met_at, ["order_id", "symbol", "bar_date"], ["last_close"], 5)


_FQ = {"fill_price": 5, "commission": 5, "total_amount": 3}


@query("ppr_fill", sql("bars_brand", extra=f"{_ORD}, {_ASOF}, {_FILL}", body="SELECT order_id, status, " + ", ".join(q(c, d) for c, d in _FQ.items()) + " FROM fl"))
def ppr_fill(spark, sf):
    return rounded(lg.fill(_orders(spark, sf), t.bars_brand(spark, sf)), ["order_id", "status"], _FQ)


@query("scl_fillprice", f"""SELECT o_orderkey, {q("o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1.001 ELSE 0.999 END", 3, "fill_price")} FROM orders""")
def scl_fillprice(spark, sf):
    o = t.table(spark, sf, "orders")
    sided = o.withColumn("side", F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL"))
    return rounded(sided.withColumn("fill_price", lg.fill_price("o_totalprice", "side")), ["o_orderkey"], ["fill_price"], 3)


_LED = """o AS (SELECT * FROM ledger_orders),
led AS (SELECT strategy, symbol, 0::BIGINT AS seq, 0.0::DOUBLE AS q, 0.0::DOUBLE AS avg, 0.0::DOUBLE AS realized, 0.0::DOUBLE AS px FROM (SELECT DISTINCT strategy, symbol FROM o)
 UNION ALL
 SELECT o.strategy, o.symbol, o.seq, CASE WHEN side = 'BUY' THEN q + quantity ELSE q - quantity END,
  CASE WHEN side = 'BUY' AND q + quantity > 0 THEN (q * avg + quantity * price) / (q + quantity) ELSE avg END,
  CASE WHEN side = 'SELL' THEN realized + (price - avg) * quantity ELSE realized END, price
 FROM led JOIN o ON o.strategy = led.strategy AND o.symbol = led.symbol AND o.seq = led.seq + 1)"""
_POS = """ps AS (SELECT strategy, symbol, max(seq) AS orders, arg_max(q, seq) AS quantity, arg_max(avg, seq) AS avg_cost, arg_max(px, seq) AS last_price,
 arg_max(realized, seq) AS realized_pnl FROM led GROUP BY 1, 2),
po AS (SELECT *, quantity * avg_cost AS total_cost, quantity * last_price AS market_value, quantity * last_price - quantity * avg_cost AS unrealized_pnl FROM ps)"""
_PQ = {"quantity": 2, "avg_cost": 4, "total_cost": 2, "last_price": 4, "market_value": 2, "unrealized_pnl": 2, "realized_pnl": 2}


def ledger_sql(body: str, extra: str = "") -> str:
    return sql("ledger_orders", extra=f"{_LED}, {_POS}" + (", " + extra if extra else ""), body=body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("ppr_ledger", ledger_sql("""SELECT strategy, symbol, orders, (SELECT min(date) FROM o WHERE o.strategy = po.strategy AND o.symbol = po.symbol AND side = 'BUY') AS first_buy_date, """
    + ", ".join(q(c, d) for c, d in _PQ.items()) + " FROM po"), dates="first_buy_date")
def ppr_ledger(spark, sf):
    return rounded(lg.positions(t.ledger_orders(spark, sf)), ["strategy", "symbol", "orders", "first_buy_date"], _PQ)


_SUMQ = {"cash_balance": 2, "stock_value": 2, "total_pnl": 2, "total_pnl_ratio": 5, "today_pnl": 2}


@query("agg_summary", ledger_sql("SELECT strategy, positions_count, orders_count, " + ", ".join(q(c, d) for c, d in _SUMQ.items()) + """ FROM (
 SELECT strategy, 1000000 - sum(market_value * op) AS cash_balance, sum(market_value * op) AS stock_value, sum((unrealized_pnl + realized_pnl) * op) AS total_pnl,
 sum((unrealized_pnl + realized_pnl) * op) / 1000000 AS total_pnl_ratio, sum(unrealized_pnl * op) AS today_pnl, CAST(sum(op) AS BIGINT) AS positions_count,
 (SELECT count(*) FROM o WHERE o.strategy = po.strategy AND o.date >= DATE '2001-10-01') AS orders_count FROM (SELECT *, (quantity <> 0)::INT AS op FROM po) po GROUP BY strategy)"""))
def agg_summary(spark, sf):
    o = t.ledger_orders(spark, sf)
    return rounded(lg.summary(lg.positions(o), o, dt.date(2001, 10, 1)), ["strategy", "positions_count", "orders_count"], _SUMQ)


@query("agg_account", ledger_sql(f"SELECT {q('market_value', 2)}, {q('total_pnl', 2)}, {q('total_pnl / c', 6, 'total_pnl_ratio')} FROM (SELECT sum(market_value) AS market_value, sum(unrealized_pnl) AS total_pnl, sum(total_cost) AS c FROM po)"))
def agg_account(spark, sf):
    return rounded(lg.account(lg.positions(t.ledger_orders(spark, sf))), [], {"market_value": 2, "total_pnl": 2, "total_pnl_ratio": 6})


_DEV = ["backtest_return", "paper_return", "deviation", "slippage", "execution_quality_score"]
_DEVSQL = """bk AS (SELECT p_brand AS symbol, (avg(p_size) - 25) / 100 AS backtest_return FROM part GROUP BY 1),
dv AS (SELECT strategy, symbol, backtest_return, CASE WHEN total_cost > 0 THEN unrealized_pnl / total_cost ELSE 0 END AS paper_return FROM po JOIN bk USING (symbol) WHERE quantity <> 0),
dw AS (SELECT *, paper_return - backtest_return AS deviation, abs(paper_return - backtest_return) * 0.5 AS slippage,
 greatest(0, 1 - abs(paper_return - backtest_return) * 10) AS execution_quality_score FROM dv)"""


def _deviation(name: str, cols: list[str]) -> None:
    @query(name, ledger_sql(f"SELECT strategy, symbol, {qs(cols)} FROM dw", _DEVSQL))
    def run(spark, sf):
        back = t.table(spark, sf, "part").groupBy(F.col("p_brand").alias("symbol")).agg(((F.avg("p_size") - 25) / 100).alias("backtest_return"))
        return rounded(lg.deviation(lg.positions(t.ledger_orders(spark, sf)), back), ["strategy", "symbol"], cols)


_deviation("jn_loop_deviation", ["backtest_return", "paper_return"])
_deviation("scl_deviation", _DEV)

# -- service statistics ---------------------------------------------------

REQUEST_COLS = [f"{x}_response_time" for x in ("avg", "min", "max", "p50", "p95", "p99")] + ["success_rate"]


REQUEST_SQL = sql("requests", body=f"""
SELECT method, path, count, n2, n4, n5, {qs(REQUEST_COLS, 5)} FROM (SELECT method, path, count(*) AS count, avg(response_time) AS avg_response_time,
 min(response_time) AS min_response_time, max(response_time) AS max_response_time, quantile_cont(response_time, 0.5) AS p50_response_time,
 quantile_cont(response_time, 0.95) AS p95_response_time, quantile_cont(response_time, 0.99) AS p99_response_time,
 count(*) FILTER (WHERE status_code BETWEEN 200 AND 299) / count(*) * 100 AS success_rate, count(*) FILTER (WHERE status_code = 200) AS n2,
 count(*) FILTER (WHERE status_code = 404) AS n4, count(*) FILTER (WHERE status_code = 500) AS n5
 FROM (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY method, path ORDER BY ts DESC, request_id DESC) <= 1000) GROUP BY 1, 2)""")


@query("agg_reqstats", REQUEST_SQL)
def agg_reqstats(spark, sf):
    s = ss.request_stats(t.requests(spark, sf))
    d = F.col("status_distribution")
    return rounded(s.withColumns({f"n{k}": d[f"{k}xx"] for k in (2, 4, 5)}), ["method", "path", "count", "n2", "n4", "n5"], REQUEST_COLS, 5)


@query("agg_statuscnt", """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS active, count(*) FILTER (WHERE o_orderstatus = 'P') AS paused,
 count(*) FILTER (WHERE o_orderstatus = 'F') AS stopped FROM orders""")
def agg_statuscnt(spark, sf):
    return ss.status_counts(t.table(spark, sf, "orders"), "o_orderstatus", {"active": "O", "paused": "P", "stopped": "F"})


_OUT = """ou AS (SELECT user_id AS task_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'pending' ELSE 'completed' END ELSE 'completed' END AS outcome FROM events)"""


def outcomes(ev, *more):
    return ev.select(
        *more,
        F.col("user_id").alias("task_id"),
        F.when(F.col("event_type") == "error", "failed")
        .when((F.col("event_type") == "click") & (F.col("user_id") % 3 == 0), "pending")
        .otherwise("completed")
        .alias("outcome"),
    )


SYNC_SQL = f"""WITH {_OUT} SELECT task_id, symbols_completed, symbols_failed, symbols_total, {q('(symbols_completed + symbols_failed) / symbols_total * 100', 5, 'progress')},
 CASE WHEN symbols_completed + symbols_failed < symbols_total THEN 'running' WHEN symbols_failed > 0 THEN 'failed' ELSE 'success' END AS status
FROM (SELECT task_id, count(*) FILTER (WHERE outcome = 'completed') AS symbols_completed, count(*) FILTER (WHERE outcome = 'failed') AS symbols_failed, count(*) AS symbols_total FROM ou GROUP BY 1)"""
SYNC_KEYS = ["task_id", "symbols_completed", "symbols_failed", "symbols_total", "status"]


@query("agg_syncstats", SYNC_SQL)
def agg_syncstats(spark, sf):
    return rounded(ss.sync_stats(outcomes(t.table(spark, sf, "events"))), SYNC_KEYS, ["progress"], 5)


@query("agg_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def agg_count(spark, sf):
    return ss.count_where(t.table(spark, sf, "orders"), {"o_orderstatus": "F", "o_totalprice": {"gt": 100000}})


@query("agg_exists", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 400000")
def agg_exists(spark, sf):
    return ss.exists_where(t.table(spark, sf, "orders"), {"o_totalprice": {"gt": 400000}})


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query("agg_tablecounts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in _TABLES))
def agg_tablecounts(spark, sf):
    return ss.table_counts({n: t.table(spark, sf, n) for n in _TABLES})


_KW = {"market": ["the ", "ou "], "strategy": ["que", "ein"], "stock": ["市", "的"], "factor": ["a"]}


def _topic_sql(kw: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(
        f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{k}{chr(39)})' for k in ks)} THEN '{n}'" for n, ks in kw.items()) + " ELSE 'general' END"


def _hits_sql(kw: dict[str, list[str]]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN '{k}' END" for ks in kw.values() for k in ks) + ")"


@query("scl_topic", f"SELECT conv_id, turn, {_topic_sql(_KW)} AS category, {_hits_sql(_KW)} AS hits, {_topic_sql(rules.TOPIC_KEYWORDS)} AS default_category FROM conversations")
def scl_topic(spark, sf):
    c = t.table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", rules.topic("text", _KW).alias("category"), F.array_join(rules.topic_hits("text", _KW), "|").alias("hits"),
        rules.topic("text").alias("default_category"))


def _messages(spark, sf):
    c = t.table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), "text", F.when(F.col("role") == "assistant", F.length("text") / 100.0).alias("response_time"))


@query("agg_chatstats", f"""SELECT count(*) AS total_conversations, CAST(sum(n) AS BIGINT) AS total_messages, CAST(sum(least(n, 200)) AS BIGINT) AS stored_messages,
 {q('sum(t) / sum(k)', 4, 'response_time_avg')}, round(4.0 + least(0.9, sum(n) * 0.02), 2)::DOUBLE AS user_satisfaction FROM (
 SELECT conv_id // 200, count(*) AS n, sum(length(text) / 100.0) FILTER (WHERE role = 'assistant') AS t, count(text) FILTER (WHERE role = 'assistant') AS k FROM conversations GROUP BY 1)""")
def agg_chatstats(spark, sf):
    # 200 conversations form a session here, so that sessions are longer than what is stored of them
    s = ss.chat_totals(_messages(spark, sf).withColumn("session_id", F.floor(F.col("session_id") / 200)))
    return rounded(s, ["total_conversations", "total_messages", "stored_messages", "user_satisfaction"], ["response_time_avg"], 4)


@query("agg_chatcategories", f"""SELECT category, count, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.TOPIC_NAMES.items())} ELSE category END AS label
FROM (SELECT {_topic_sql(_KW)} AS category, count(*) AS count FROM conversations GROUP BY 1)""")
def agg_chatcategories(spark, sf):
    return ss.chat_categories(_messages(spark, sf), _KW)


@query("agg_histsum", f"""SELECT count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS completed,
 {q("avg(c_acctbal / 10000) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))", 6, "avg_return")} FROM customer""")
def agg_histsum(spark, sf):
    c = t.table(spark, sf, "customer")
    b = c.select(F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "completed").otherwise("failed").alias("status"),
                 (F.col("c_acctbal") / 10000).alias("total_return"))
    return rounded(ss.history_summary(b), ["completed"], ["avg_return"])


@query("agg_cards", f"""SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS active, count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS testing,
 {q('avg(c_acctbal / 10000)', 6, 'mean_return')}, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS total_symbols, true AS has_files FROM customer""")
def agg_cards(spark, sf):
    c = t.table(spark, sf, "customer")
    s = c.select(F.when(F.col("c_mktsegment") == "BUILDING", "active").when(F.col("c_mktsegment") == "HOUSEHOLD", "testing").otherwise("x").alias("status"),
                 (F.col("c_acctbal") / 10000).alias("total_return"))
    store = BarStore(spark, scratch_path(spark, "card-bars"))
    days = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"))
    store.append(days)
    kept = store.stats().select(F.col("total_files").alias("files"), F.col("total_size_mb").alias("size_mb"), F.col("symbols_count").alias("symbols"))
    stored = cut_lineage(ss.storage_cards(kept), "cards")
    cards = ss.strategy_cards(s).withColumns({
        "total_symbols": stored.select("total_symbols").scalar(),
        "has_files": stored.select((F.col("total_files") > 0) & (F.col("total_size_mb") > 0)).scalar()})
    return rounded(cards, ["active", "testing", "total_symbols", "has_files"], ["mean_return"])


# -- business tables and joins -------------------------------------------


def _business_orders(spark, sf):
    o = t.table(spark, sf, "orders")
    return bz.conform(o.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderpriority").alias("strategy_id"),
        F.col("o_custkey").cast("string").alias("user_id"), (F.col("o_totalprice") / 7).alias("total_amount"),
        F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "P", "pending").otherwise("cancelled").alias("status"),
        F.col("o_orderdate").alias("placed_at")), "orders")


_DEC = "CAST(o_totalprice / 7 AS DECIMAL(15,4))"


@query("src_sql", f"""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'pending' ELSE 'cancelled' END AS status,
 {q('o_totalprice / 7', 3, 'total_amount')}, true AS is_decimal FROM orders""")
def src_sql(spark, sf):
    """Business orders written and read back with their declared types."""
    base = scratch_path(spark, "business")
    _business_orders(spark, sf).write.parquet(f"{base}/orders")
    o = bz.read_table(spark, base, "orders")
    return rounded(o.withColumn("is_decimal", F.lit(dict(o.dtypes)["total_amount"] == bz.MONEY)), ["order_id", "status", "is_decimal"], ["total_amount"], 3)


@query("jn_fk", f"""SELECT o_orderkey, c_name AS username, n_name AS region_name, {q('o_totalprice', 2, 'total')} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def jn_fk(spark, sf):
    o, c, n = (t.table(spark, sf, x) for x in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rounded(j.select("o_orderkey", F.col("c_name").alias("username"), F.col("n_name").alias("region_name"), F.col("o_totalprice").alias("total")),
                   ["o_orderkey", "username", "region_name"], ["total"], 2)


@query("jn_semi_symbols", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn_semi_symbols(spark, sf):
    c = t.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("jn_anti_missing", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn_anti_missing(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return t.table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@dated("jn_full_prices", sql("prices_supp", "bars_event", extra="""al AS (SELECT date, symbol, max(close) AS close FROM
 (SELECT symbol, date, close FROM prices_supp UNION ALL SELECT symbol, date, close FROM bars_event) GROUP BY 1, 2)""", body=f"""
SELECT date, symbol, count(*) OVER (PARTITION BY date) AS present, (SELECT count(DISTINCT symbol) FROM al) - count(*) OVER (PARTITION BY date) AS absent,
 {q('close', 5)} FROM al"""))
def jn_full_prices(spark, sf):
    """Series of all symbols of two universes on the union of their dates."""
    both = sl.aligned([t.prices_supp(spark, sf), t.bars_event(spark, sf)])
    return rounded(both, ["date", "symbol", "present", "absent"], ["close"], 5)


@query("scl_typecoerce", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS missing FROM events""")
def scl_typecoerce(spark, sf):
    e = t.table(spark, sf, "events")
    return e.select("event_id", bz.config_value("props", "k").try_cast("int").alias("k"), bz.config_value("props", "none").alias("missing"))


# -- feature store --------------------------------------------------------


def _feature_store(spark, sf, versions=("v1", "v2", "v3")):
    s = rs.FeatureStore(spark, scratch_path(spark, "features"))
    p = t.prices_supp(spark, sf)
    for i, v in enumerate(versions):
        s.write(p.withColumn("score", F.col("close") * (i + 1)), v, "raw", {"n": i})
    s.write(p.withColumn("score", F.col("close") - 1), versions[-1], "processed")
    return s


_FS = "symbol IN ('000001', '000004', '000009') AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"


@dated("snk_feat", sql("prices_supp", body=f"SELECT symbol, date, 'v2' AS feature_version, {q('close * 2', 4, 'score')} FROM prices_supp"))
def snk_feat(spark, sf):
    return rounded(_feature_store(spark, sf).read("raw", "v2"), ["symbol", "date", "feature_version"], ["score"], 4)


@dated("src_feat", sql("prices_supp", body=f"SELECT symbol, date, {q('close - 1', 4, 'score')} FROM prices_supp WHERE {_FS}"))
def src_feat(spark, sf):
    f = _feature_store(spark, sf).read("processed", "v3", ["000001", "000004", "000009"], dt.date(1996, 1, 1), dt.date(1999, 12, 31))
    return rounded(f, ["symbol", "date"], ["score"], 4)


@dated("flt_featq", sql("prices_supp", body=f"SELECT symbol, date, {q('close', 4, 'score')} FROM prices_supp WHERE {_FS} ORDER BY symbol, date LIMIT 100"))
def flt_featq(spark, sf):
    f = _feature_store(spark, sf).read("raw", "v1", ["000001", "000004", "000009"], dt.date(1996, 1, 1), dt.date(1999, 12, 31))
    return rounded(f.orderBy("symbol", "date").limit(100), ["symbol", "date"], ["score"], 4)


@query("src_featver", sql("prices_supp", body="SELECT DISTINCT 'v' || v AS feature_version FROM prices_supp, range(1, 4) r(v)"))
def src_featver(spark, sf):
    return _feature_store(spark, sf).versions("raw")


@query("src_featmeta", sql("prices_supp", body="""SELECT 'v' || v AS feature_version, count(DISTINCT symbol) AS symbols, min(date) AS start_date, max(date) AS end_date,
 3 AS feature_count, count(*) AS sample_count FROM prices_supp, range(1, 4) r(v) GROUP BY v"""), dates="start_date end_date")
def src_featmeta(spark, sf):
    m = _feature_store(spark, sf).metadata().where("feature_type = 'raw'")
    return m.select("feature_version", F.size("symbols").cast("long").alias("symbols"), "start_date", "end_date", "feature_count", "sample_count")


@query("snk_featclean", sql("prices_supp", body="SELECT 'v' || v AS feature_version, count(*) AS rows FROM prices_supp, range(2, 4) r(v) GROUP BY v"))
def snk_featclean(spark, sf):
    s = _feature_store(spark, sf)
    s.clean(keep=2)
    left = s.versions("raw")
    rows = s.read("raw").groupBy(F.col("feature_version").cast("string").alias("feature_version")).agg(F.count(F.lit(1)).alias("rows"))
    return left.join(rows, "feature_version")


@query("src_featinfo", sql("prices_supp", body="""SELECT 'raw' AS kind, count(*) * 3 AS rows, count(DISTINCT symbol) AS symbols, true AS has_files FROM prices_supp
UNION ALL SELECT 'processed', count(*), count(DISTINCT symbol), true FROM prices_supp"""))
def src_featinfo(spark, sf):
    i = _feature_store(spark, sf).info()
    return i.select("kind", "rows", "symbols", ((F.col("files") > 0) & (F.col("size_mb") > 0)).alias("has_files"))


# -- stored backtests, models, reports -----------------------------------


def _saved(spark, sf):
    """Each strategy of the returns book saved as one backtest."""
    s = rs.BacktestStore(spark, scratch_path(spark, "backtests"))
    r = t.returns_book(spark, sf)
    # one row per strategy
    place = F.row_number().over(Window.orderBy("strategy")) - 1
    ids = cut_lineage(r.select("strategy").distinct().withColumn("i", place), "ids").withColumn("backtest_id", F.concat(F.lit("bt"), "i"))
    meta = ids.select(
        "backtest_id", F.col("strategy").alias("name"), F.when(F.col("i") % 2 == 0, "completed").otherwise("failed").alias("status"),
        F.format_string("2024-01-%02dT00:00:00", F.col("i") + 1).alias("created_at"), F.lit("{}").alias("config"))
    named = lambda df: df.join(ids.select("strategy", "backtest_id"), "strategy")
    held = t.table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("strategy"), F.col("l_suppkey").alias("symbol"))
    s.save_many(meta, named(met.metrics(r)), named(r), named(held.agg(F.sum("l_quantity").alias("quantity"))))
    return s


def msql(body: str) -> str:
    return sql("returns_book", "returns_benchmark", extra=MET, body=body)


_ID = "'bt' || (row_number() OVER (ORDER BY strategy) - 1)"


@query("snk_result", sql("returns_book", body=f"SELECT backtest_id, count(*) AS days, {q('sum(ret)', 5, 'total')} FROM (SELECT *, 'bt' || (dense_rank() OVER (ORDER BY strategy) - 1) AS backtest_id FROM returns_book) GROUP BY 1"))
def snk_result(spark, sf):
    r = _saved(spark, sf).table("returns").groupBy("backtest_id").agg(F.count(F.lit(1)).alias("days"), F.sum("ret").alias("total"))
    return rounded(r, ["backtest_id", "days"], ["total"], 5)


@query("src_resultlist", sql("returns_book", body=f"""SELECT backtest_id, strategy AS name FROM (SELECT strategy, {_ID} AS backtest_id, row_number() OVER (ORDER BY strategy) AS k
 FROM (SELECT DISTINCT strategy FROM returns_book)) WHERE k % 2 = 1 ORDER BY k DESC LIMIT 2"""))
def src_resultlist(spark, sf):
    return _saved(spark, sf).list("completed", "2024-01-01T00:00:00", 2).select("backtest_id", "name")


@query("src_resultget", msql(f"SELECT strategy, {q('total_return')}, {q('sharpe_ratio')} FROM met WHERE strategy = 'NF'"))
def src_resultget(spark, sf):
    return rounded(_saved(spark, sf).get("bt2"), ["strategy"], ["total_return", "sharpe_ratio"])


@query("snk_resultdel", sql("returns_book", body=f"SELECT backtest_id FROM (SELECT {_ID} AS backtest_id FROM (SELECT DISTINCT strategy FROM returns_book)) WHERE backtest_id <> 'bt2'"))
def snk_resultdel(spark, sf):
    s = _saved(spark, sf)
    s.delete("bt2")
    return s.table("metrics").select("backtest_id")


_CMP = ["total_return", "sharpe_ratio", "max_drawdown"]


@query("bt_compare", msql(f"SELECT {_ID} AS backtest_id, strategy AS name, {qs(_CMP)}, 0.0::DOUBLE AS no_such_metric FROM met WHERE strategy IN (SELECT strategy FROM met) QUALIFY backtest_id IN ('bt0', 'bt3', 'bt5')"))
def bt_compare(spark, sf):
    c = _saved(spark, sf).compare(["bt0", "bt3", "bt5"], [*_CMP, "no_such_metric"])
    return rounded(c, ["backtest_id", "name", "no_such_metric"], _CMP)


def _models(spark, sf):
    """Model metadata, one model per brand, with metrics from its parts."""
    p = t.table(spark, sf, "part")
    g = p.groupBy(F.col("p_brand").alias("model_id")).agg(
        F.min("p_type").alias("model_type"), F.avg(F.col("p_size") / 50).alias("acc"), F.avg("p_retailprice").alias("mse"), F.count(F.lit(1)).alias("n"))
    return g.select(
        "model_id", "model_type", F.when(F.col("n") % 2 == 0, "trained").otherwise("draft").alias("status"), F.col("model_id").alias("created_at"),
        F.when(F.col("n") % 3 == 0, F.create_map(F.lit("accuracy"), "acc")).otherwise(F.create_map(F.lit("accuracy"), "acc", F.lit("mse"), "mse")).alias("metrics"))


_MODELS = """mo AS (SELECT p_brand AS model_id, min(p_type) AS model_type, CASE WHEN count(*) % 2 = 0 THEN 'trained' ELSE 'draft' END AS status,
 avg(p_size / 50) AS accuracy, CASE WHEN count(*) % 3 = 0 THEN 0 ELSE avg(p_retailprice) END AS mse FROM part GROUP BY 1)"""


@query("src_modelreg", f"WITH {_MODELS} SELECT model_id, model_type FROM mo WHERE status = 'trained'")
def src_modelreg(spark, sf):
    path = scratch_path(spark, "registry")
    _models(spark, sf).write.parquet(f"{path}/meta")
    return rs.ModelRegistry(spark, path).list(status="trained").select("model_id", "model_type")


@query("ev_table", f"WITH {_MODELS} SELECT model_id, {q('accuracy')}, {q('mse', 4)}, {q('0', 6, 'recall')} FROM mo")
def ev_table(spark, sf):
    return rounded(rs.performance_table(_models(spark, sf), ["accuracy", "mse", "recall"]), ["model_id"], {"accuracy": 6, "mse": 4, "recall": 6})


@query("snk_report_json", msql(f"SELECT strategy, n AS total_days, {q('total_return')}, {q('var_95')} FROM met"))
def snk_report_json(spark, sf):
    path = scratch_path(spark, "report")
    rs.report_json(t.returns_book(spark, sf), path)
    m = spark.read.schema("strategy string, total_days bigint, total_return double, var_95 double").json(f"{path}/metrics")
    return rounded(m, ["strategy", "total_days"], ["total_return", "var_95"])


@query("snk_report_sheets", sql("returns_book", "bars_brand", extra=f"{SIG_MA_CTE}, {HELD_CTE}", body="""
SELECT 'metrics' AS sheet, count(DISTINCT strategy) AS rows FROM returns_book UNION ALL SELECT 'series', count(*) FROM returns_book
UNION ALL SELECT 'trades', count(*) FROM hd WHERE entry UNION ALL SELECT 'positions', count(*) FROM sg"""))
def snk_report_sheets(spark, sf):
    path = scratch_path(spark, "sheets")
    s = sig.held(sig.ma_cross(t.bars_brand(spark, sf)))
    rs.report_sheets(t.returns_book(spark, sf), bt.paired_trades(s), s.select("symbol", "date", "held"), path)
    return ss.table_counts({n: spark.read.option("header", True).csv(f"{path}/{n}") for n in ("metrics", "series", "trades", "positions")}).withColumnRenamed("table_name", "sheet")


# -- user functions -------------------------------------------------------


@dated("udf_sizing", sql("bars_brand", extra=SIG_MA_CTE, body=f"SELECT symbol, date, {q('signal * 100.0::DOUBLE / (100 + close)', 6, 'size')} FROM sg"))
def udf_sizing(spark, sf):
    """A user sizing function over Arrow batches."""
    @F.pandas_udf("double")
    def size(signal: pd.Series, close: pd.Series) -> pd.Series:
        return signal * 100.0 / (100 + close)

    s = sig.ma_cross(t.bars_brand(spark, sf))
    return rounded(s.withColumn("size", size("signal", "close")), ["symbol", "date"], ["size"])


@dated("udf_source", sql("prices_supp", body=f"""SELECT mode, symbol, date, {q('close')} FROM prices_supp, (VALUES ('batch'), ('stream')) m(mode)
WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"""))
def udf_source(spark, sf):
    """A user's feed of CSV files as a Spark format: all symbols, read in batch with a pushed condition and as a stream in two runs."""
    folder = scratch_path(spark, "feed")
    p = t.prices_supp(spark, sf).select("symbol", "date", "close")
    symbols = [r[0] for r in p.select("symbol").distinct().orderBy("symbol").collect()]  # the user's list
    firsts = plugins.write_csv_feed(p, symbols, folder)
    plugins.register_source(spark, "csv_feed", plugins.csv_feed(folder, firsts), "symbol string, date date, close double")
    lo, mid, hi = dt.date(1997, 1, 1), dt.date(1998, 3, 31), dt.date(1998, 12, 31)
    batch = plugins.load(spark, "csv_feed", symbols).where(F.col("date").between(lo, hi))
    out, checkpoint = scratch_path(spark, "fed"), scratch_path(spark, "feed-checkpoint")
    for end in (mid, hi):
        run = to_files(plugins.load_stream(spark, "csv_feed", symbols, lo, end), out, checkpoint)
        run.awaitTermination()
        if run.exception() is not None:
            raise run.exception()
    both = batch.withColumn("mode", F.lit("batch")).unionByName(spark.read.parquet(out).withColumn("mode", F.lit("stream")))
    return rounded(both, ["mode", "symbol", "date"], ["close"])
