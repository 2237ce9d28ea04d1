"""The derived views again, as SQL text for the checks."""

from __future__ import annotations

_SEQ = "l_orderkey, l_linenumber, l_extendedprice, l_quantity"


def _bars(symbol: str, date: str, frm: str) -> str:
    return f"""
  SELECT symbol, date,
         first(px ORDER BY {_SEQ}) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY {_SEQ}) AS close,
         sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
  FROM (SELECT *, {symbol} AS symbol, {date} AS date, l_extendedprice / l_quantity AS px
        FROM {frm} WHERE l_quantity > 0) GROUP BY symbol, date"""


VIEWS = {
    "bars_brand": _bars("p_brand", "CAST(l_shipdate AS DATE)", "lineitem JOIN part ON l_partkey = p_partkey"),
    "bars_supp": "SELECT *, amount / volume AS vwap FROM ("
    + _bars("lpad(CAST(l_suppkey AS VARCHAR), 6, '0')", "CAST(date_trunc('month', l_shipdate) AS DATE)", "lineitem")
    + ")",
    "prices_supp": """
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         round(sum(l_extendedprice), 2) / sum(l_quantity) AS close, sum(l_quantity) AS volume
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""",
    "bars_event": """
  SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close,
         sum(1.0::DOUBLE) AS volume, round(sum(value), 2) AS amount
  FROM events GROUP BY 1, 2""",
    "industries": """
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0""",
    "returns_book": """
  SELECT l_returnflag || l_linestatus AS strategy, CAST(l_shipdate AS DATE) AS date,
         round(avg(l_discount) - 0.05, 8) AS ret
  FROM lineitem GROUP BY 1, 2""",
    "returns_benchmark": """
  SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_tax) - 0.04, 8) AS bench
  FROM lineitem GROUP BY 1""",
    "trades": """
  SELECT CASE WHEN l_suppkey % 2 = 0 THEN '6' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0')
              ELSE lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END AS symbol,
         CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
         l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS amount,
         l_shipdate AS timestamp, CAST(l_partkey * 5000 AS DOUBLE) AS avg_volume, l_tax AS volatility,
         l_discount / 100 AS bid_ask_spread, l_linenumber * 3.0e9 AS market_cap,
         l_orderkey AS order_id, l_linenumber AS line
  FROM lineitem""",
    "requests": """
  SELECT 'GET' AS method, '/' || event_type AS path, ts, event_id AS request_id, value AS response_time,
         CASE WHEN user_id % 10 = 0 THEN 500 WHEN user_id % 7 = 0 THEN 404 ELSE 200 END AS status_code
  FROM events""",
    "ledger_orders": """
  SELECT l_linestatus AS strategy, p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
         row_number() OVER (PARTITION BY l_linestatus, p_brand ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber,
                            l_extendedprice, l_quantity, l_returnflag) AS seq,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity,
         l_extendedprice / l_quantity AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0""",
    "predictions": """
  SELECT l_returnflag || l_linestatus AS model, CAST(l_shipdate AS DATE) AS date, l_orderkey AS row_id,
         row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber,
                            l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq,
         round(l_discount - 0.05, 4) AS y_true, round(l_tax - 0.04, 4) AS y_pred
  FROM lineitem""",
}


def sql(*views: str, body: str, extra: str = "") -> str:
    """`body` with the named views (and further CTE text) in front."""
    ctes = [f"{v} AS ({VIEWS[v]})" for v in views]
    if extra:
        ctes.append(extra.strip().rstrip(","))
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
