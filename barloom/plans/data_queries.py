"""Registered queries: sources, sinks, cleaning and checks, filters, ordering, set operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import quality as ql
from ..operators import selection as sl
from ..session import scratch_path
from ..sources import store as st
from ..sources import tables as t
from ..sources import vendor as vn
from .registry import dated, query
from .shape import q, qs, rounded
from .views_sql import sql

K = ("symbol", "date")
OHLCV = ["open", "high", "low", "close", "volume"]
_EXT = {c: 6 for c in OHLCV[:4]} | {"volume": 2}

# -- a dirtied copy of the brand bars -------------------------------------

_D = "CAST(extract(day FROM date) AS INTEGER)"
DIRTY = f"""
d0 AS (SELECT *, CAST(substr(symbol, 7) AS INTEGER) AS bn, {_D} AS dd FROM bars_brand),
d1 AS (SELECT symbol, date, open / 20 AS open, CASE WHEN bn % 7 = 0 AND dd = 11 THEN low / 20 - 1 ELSE high / 20 END AS high, low / 20 AS low,
  CASE WHEN bn % 4 = 0 AND dd % 7 = 0 THEN NULL WHEN bn % 5 = 0 AND dd = 3 THEN -close / 20
       WHEN bn % 9 = 0 AND dd = 4 THEN 'inf'::DOUBLE ELSE close / 20 END AS close,
  CASE WHEN bn % 6 = 1 AND dd = 20 THEN -volume ELSE volume END AS volume, amount, 0 AS seq, bn, dd FROM d0),
dirty AS (SELECT symbol, date, open, high, low, close, volume, amount, seq FROM d1
  UNION ALL SELECT symbol, date, open, high, low, close * 1.5::DOUBLE, volume, amount, 1 FROM d1 WHERE bn % 8 = 0 AND dd = 15)"""


def dirty(spark, sf):
    b = t.bars_brand(spark, sf).withColumns(
        {"bn": F.substring("symbol", 7, 9).cast("int"), "dd": F.dayofmonth("date")}
    )
    bn, dd = F.col("bn"), F.col("dd")
    d1 = b.select(
        "symbol",
        "date",
        (F.col("open") / 20).alias("open"),
        F.when((bn % 7 == 0) & (dd == 11), F.col("low") / 20 - 1).otherwise(F.col("high") / 20).alias("high"),
        (F.col("low") / 20).alias("low"),
        F.when((bn % 4 == 0) & (dd % 7 == 0), F.lit(None).cast("double"))
        .when((bn % 5 == 0) & (dd == 3), -F.col("close") / 20)
        .when((bn % 9 == 0) & (dd == 4), F.lit(float("inf")))
        .otherwise(F.col("close") / 20)
        .alias("close"),
        F.when((bn % 6 == 1) & (dd == 20), -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        "amount",
        F.lit(0).alias("seq"),
        "bn",
        "dd",
    )
    copies = d1.where((bn % 8 == 0) & (dd == 15)).withColumns({"close": F.col("close") * 1.5, "seq": F.lit(1)})
    return d1.unionByName(copies).drop("bn", "dd")


_LAST = "SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) = 1"
_POS = ", ".join(f"CASE WHEN {c} > 0 AND {c} < 'inf'::DOUBLE THEN {c} END AS {c}" for c in OHLCV[:4])


@dated("pre_clean", sql("bars_brand", extra=DIRTY, body=f"""
SELECT symbol, date, {', '.join(q(c, d) for c, d in _EXT.items())} FROM (SELECT * REPLACE ({_POS}) FROM ({_LAST.format(src='dirty')}))"""))
def pre_clean(spark, sf):
    return rounded(ql.clean(dirty(spark, sf)), K, _EXT)


@dated("set_dedupe", sql("bars_brand", extra=DIRTY, body=f"SELECT symbol, date, seq, {q('volume', 2)} FROM ({_LAST.format(src='dirty')})"))
def set_dedupe(spark, sf):
    return rounded(ql.keep_last(dirty(spark, sf), list(K), "seq"), ["symbol", "date", "seq"], ["volume"], 2)


_W = "PARTITION BY symbol ORDER BY date"
_FILL = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}" for c in OHLCV)
_PRE = f"""
f0 AS (SELECT * REPLACE (CASE WHEN close < 'inf'::DOUBLE THEN close END AS close) FROM dirty),
f1 AS ({_LAST.format(src='f0')}), f2 AS (SELECT symbol, date, {_FILL} FROM f1),
f3 AS (SELECT *, close / nullif(lag(close) OVER ({_W}), 0) AS ratio,
  CASE WHEN count(close) OVER ({_W} ROWS 4 PRECEDING) = 5 THEN avg(close) OVER ({_W} ROWS 4 PRECEDING) END AS sma_5,
  CASE WHEN count(close) OVER ({_W} ROWS 19 PRECEDING) = 20 THEN avg(close) OVER ({_W} ROWS 19 PRECEDING) END AS sma_20 FROM f2)"""
_PREC = {"close": 6, "volume": 2, "returns": 5, "log_returns": 6, "sma_5": 4, "sma_20": 4}


@dated("pre_bars", sql("bars_brand", extra=DIRTY + "," + _PRE, body=f"""
SELECT symbol, date, {', '.join(q(c, d) for c, d in _PREC.items())}
FROM (SELECT *, ratio - 1 AS returns, CASE WHEN ratio > 0 THEN ln(ratio) END AS log_returns FROM f3)"""))
def pre_bars(spark, sf):
    d = dirty(spark, sf).withColumn("close", F.when(F.col("close") < float("inf"), F.col("close")))
    return rounded(ql.preprocess(d), K, _PREC)


@dated("prj_coerce", sql("bars_brand", extra=DIRTY, body=f"""
SELECT symbol, date, {', '.join(q(c, d) for c, d in _EXT.items())} FROM dirty WHERE close < 'inf'::DOUBLE
 AND extract(day FROM date) <> 9"""))
def prj_coerce(spark, sf):
    d = dirty(spark, sf)
    as_text = d.withColumns({c: F.col(c).cast("string") for c in OHLCV})
    as_text = as_text.withColumn("open", F.when(F.dayofmonth("date") == 9, F.lit("n/a")).otherwise(F.col("open")))
    return rounded(ql.coerce_numeric(as_text), K, _EXT)


@dated("prj_alias", sql("bars_brand", body=f"SELECT symbol, date, {', '.join(q(c, d) for c, d in _EXT.items())} FROM bars_brand"))
def prj_alias(spark, sf):
    b = t.bars_brand(spark, sf).withColumnsRenamed(
        {"date": "trade_date", "open": "open_price", "high": "high_price", "low": "low_price", "close": "close_price",
         "volume": "vol", "amount": "turnover", "symbol": "stock_code"}
    )
    return rounded(ql.rename_aliases(b), K, _EXT)


@dated("prj_numeric", sql("bars_brand", body="""SELECT symbol, date, 6 AS numeric_columns, (round(open + high + low + close + volume + amount + 1.2345678e-8, 2) + 0) AS total FROM bars_brand"""))
def prj_numeric(spark, sf):
    b = t.bars_brand(spark, sf)
    cols = ql.numeric_columns(b)
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return rounded(b.withColumns({"numeric_columns": F.lit(len(cols)), "total": total}), [*K, "numeric_columns"], ["total"], 2)


@query("prj_fill0", sql("bars_brand", body=f"""
SELECT symbol, count(*) AS points, {q('sum(ma_5)', 2, 'ma_5_sum')}, {q('sum(ma_60)', 2, 'ma_60_sum')} FROM (
 SELECT symbol, coalesce(CASE WHEN count(*) OVER ({_W} ROWS 4 PRECEDING) = 5 THEN avg(close) OVER ({_W} ROWS 4 PRECEDING) END, 0) AS ma_5,
  coalesce(CASE WHEN count(*) OVER ({_W} ROWS 59 PRECEDING) = 60 THEN avg(close) OVER ({_W} ROWS 59 PRECEDING) END, 0) AS ma_60 FROM bars_brand)
GROUP BY symbol"""))
def prj_fill0(spark, sf):
    """Indicator series per symbol with NULL as 0; one value per date, so bounded by the calendar."""
    from ..operators.indicators import ma_strict

    df = ma_strict(t.bars_brand(spark, sf), (5, 60)).fillna(0.0, ["ma_5", "ma_60"])
    series = df.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "ma_5", "ma_60"))).alias("series"))
    add = lambda c: F.aggregate("series", F.lit(0.0), lambda a, x: a + x[c])
    return rounded(
        series.withColumns({"points": F.size("series").cast("long"), "ma_5_sum": add("ma_5"), "ma_60_sum": add("ma_60")}),
        ["symbol", "points"], ["ma_5_sum", "ma_60_sum"], 2)


# -- checks ---------------------------------------------------------------

_OUT = " OR ".join(f"({c} <= 0 OR {c} > 10000)" for c in OHLCV[:4])
_BROKEN = "(high < low OR high < open OR high < close OR low > open OR low > close)"
_NULLS = " AND ".join(f"(count(*) - count({c})) / count(*) <= 0.1" for c in ("date", *OHLCV))
_PRICE_OK = f"NOT coalesce(bool_or(coalesce({_OUT}, false) OR coalesce({_BROKEN}, false)), false)"
_DATE_OK = "count(date) = count(DISTINCT date) AND min(date) >= DATE '1990-01-01' AND max(date) <= DATE '2002-01-01'"


@query("chk_bars", sql("bars_brand", extra=DIRTY, body=f"""
SELECT symbol, count(*) AS rows, true AS columns_ok, {_NULLS} AS nulls_ok, {_PRICE_OK} AS price_ok, {_DATE_OK} AS dates_ok,
  ({_NULLS}) AND {_PRICE_OK} AND ({_DATE_OK}) AS is_valid FROM dirty GROUP BY symbol"""))
def chk_bars(spark, sf):
    return ql.check_bars(dirty(spark, sf), now=F.lit(dt.date(2001, 12, 31)))


@query("chk_price", sql("bars_brand", extra=DIRTY, body=f"SELECT symbol, {_PRICE_OK} AS price_ok FROM dirty GROUP BY symbol"))
def chk_price(spark, sf):
    return ql.check_bars(dirty(spark, sf)).select("symbol", "price_ok")


@query("chk_dates", sql("bars_brand", extra=DIRTY, body=f"SELECT symbol, {_DATE_OK} AS dates_ok FROM dirty GROUP BY symbol"))
def chk_dates(spark, sf):
    return ql.check_bars(dirty(spark, sf), now=F.lit(dt.date(2001, 12, 31))).select("symbol", "dates_ok")


_SUMQ = ["close_mean", "close_min", "close_max", "close_std"]
_ISSUES = "concat_ws('; ', " + ", ".join(
    f"CASE WHEN count(*) - count({c}) > 0 THEN '{c}: ' || (count(*) - count({c})) || ' missing' END" for c in ("date", *OHLCV)) + ")"


@query("chk_summary", sql("bars_brand", extra=DIRTY, body=f"""
SELECT symbol, total_records, close_nulls, first_day, last_day, {qs(_SUMQ, 4)}, issues, issues = '' AS is_valid FROM (
SELECT symbol, count(*) AS total_records, count(*) - count(close) AS close_nulls, min(date) AS first_day, max(date) AS last_day,
 CASE WHEN bool_or(close = 'inf'::DOUBLE) THEN 'inf'::DOUBLE ELSE avg(CASE WHEN close < 'inf'::DOUBLE THEN close END) END AS close_mean,
 min(close) AS close_min, max(close) AS close_max,
 CASE WHEN NOT bool_or(coalesce(close = 'inf'::DOUBLE, false)) THEN stddev_samp(CASE WHEN close < 'inf'::DOUBLE THEN close END) END AS close_std, {_ISSUES} AS issues
FROM dirty GROUP BY symbol)"""), dates="first_day last_day")
def chk_summary(spark, sf):
    s = ql.quality_summary(dirty(spark, sf)).withColumn("issues", F.array_join("issues", "; "))
    return rounded(s, ["symbol", "total_records", "close_nulls", "first_day", "last_day", "issues", "is_valid"], _SUMQ, 4)


@query("chk_enough", sql("bars_brand", body="SELECT symbol, count(*) AS n FROM bars_brand GROUP BY symbol HAVING count(*) >= 1530"))
def chk_enough(spark, sf):
    return ql.enough(t.bars_brand(spark, sf), 1530).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


_S, _E = dt.date(1995, 1, 1), dt.date(2001, 11, 30)
_REASON = f"""CASE WHEN rows < 30 THEN 'too few rows' WHEN lo > DATE '{_S}' + 30 THEN 'starts too late' WHEN hi < DATE '{_E}' - 30 THEN 'ends too early'
 WHEN o THEN 'open not positive' WHEN h THEN 'high not positive' WHEN l THEN 'low not positive' WHEN c THEN 'close not positive'
 WHEN br THEN 'inconsistent OHLC' WHEN v THEN 'negative volume' END"""
_PANEL = f"""pn AS (SELECT symbol, rows, lo AS first_date, hi AS last_date, {_REASON} AS reason FROM (
 SELECT symbol, count(*) AS rows, min(date) AS lo, max(date) AS hi, bool_or(open <= 0) AS o, bool_or(high <= 0) AS h, bool_or(low <= 0) AS l,
  coalesce(bool_or(close <= 0), false) AS c, coalesce(bool_or({_BROKEN}), false) AS br, bool_or(volume < 0) AS v
 FROM dirty WHERE date BETWEEN DATE '{_S}' AND DATE '{_E}' GROUP BY symbol))"""


@query("chk_panel", sql("bars_brand", extra=DIRTY + "," + _PANEL, body="SELECT * FROM pn"), dates="first_date last_date")
def chk_panel(spark, sf):
    return ql.check_panel(dirty(spark, sf).where(F.col("date").between(_S, _E)), _S, _E)


@dated("src_panel", sql("bars_brand", extra=DIRTY + "," + _PANEL + "," + f"""
u AS (SELECT d.* FROM dirty d WHERE date BETWEEN DATE '{_S}' AND DATE '{_E}' AND symbol IN (SELECT symbol FROM pn WHERE reason IS NULL)
  AND symbol IN (SELECT p_brand FROM part WHERE p_size > 3)),
u1 AS ({_LAST.format(src='u')}), u2 AS (SELECT symbol, date, {_FILL} FROM u1)""",
    body=f"SELECT symbol, date, {q('close')}, {q(f'close / nullif(lag(close) OVER ({_W}), 0) - 1', 5, 'returns')} FROM u2"))
def src_panel(spark, sf):
    wanted = t.table(spark, sf, "part").where("p_size > 3").select(F.col("p_brand").alias("symbol"))
    return rounded(ql.load_panel(dirty(spark, sf), wanted, _S, _E), K, {"close": 6, "returns": 5})


@query("chk_file", sql("bars_brand", body="SELECT count(*) AS rows, true AS ok FROM bars_brand"))
def chk_file(spark, sf):
    s = st.BarStore(spark, scratch_path(spark, "bars"))
    s.append(t.bars_brand(spark, sf))
    return ql.check_file(s.read())


@query("chk_fileschema", sql("bars_brand", body="""SELECT kind, col AS "column", reason, CAST(files AS BIGINT) AS files FROM (VALUES
 ('narrow', 'volume', 'missing column', 1), ('text', 'close', 'not a number: string', 1)) v(kind, col, reason, files) WHERE (SELECT count(*) FROM bars_brand) > 0"""))
def chk_fileschema(spark, sf):
    """A folder with sound files, one without a column and one with text for numbers: the faults are rows, by the files' footers."""
    b = t.bars_brand(spark, sf)
    path = scratch_path(spark, "files")
    b.write.parquet(f"{path}/sound")
    b.drop("volume").coalesce(1).write.parquet(f"{path}/narrow")
    b.withColumn("close", F.col("close").cast("string")).coalesce(1).write.parquet(f"{path}/text")
    faults = ql.check_schema(st.file_schemas(spark, path))
    kind = F.regexp_extract("file", "/([a-z]+)/[^/]*$", 1)
    return faults.groupBy(kind.alias("kind"), "column", "reason").agg(F.count_distinct("file").alias("files"))


@query("chk_ohlcv", sql("bars_brand", extra=DIRTY, body="""
SELECT symbol, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad FROM (
SELECT symbol, coalesce(high = greatest(open, high, low, close) AND low = least(open, high, low, close) AND coalesce(volume, 0) >= 0, false) AS ok FROM dirty)
GROUP BY symbol"""))
def chk_ohlcv(spark, sf):
    return ql.check_rows(dirty(spark, sf)).groupBy("symbol").agg(
        F.count_if("row_ok").alias("good"), F.count_if(~F.col("row_ok")).alias("bad"))


@query("chk_report", sql("bars_brand", extra=DIRTY, body=f"""
SELECT symbol, total, valid, missing, abnormal_price, duplicate_dates, {q('valid::DOUBLE / total', 6, 'score')} FROM (
SELECT symbol, count(*) AS total, count(*) FILTER (WHERE NOT m AND NOT a) AS valid, count(*) FILTER (WHERE m) AS missing,
 count(*) FILTER (WHERE a) AS abnormal_price, count(*) - count(DISTINCT date) AS duplicate_dates
FROM (SELECT symbol, date, close IS NULL AS m, coalesce({_OUT}, false) OR coalesce(high < low, false) AS a FROM dirty) GROUP BY symbol)"""))
def chk_report(spark, sf):
    return rounded(ql.quality_report(dirty(spark, sf)),
                   ["symbol", "total", "valid", "missing", "abnormal_price", "duplicate_dates"], ["score"])


@query("chk_train", sql("bars_brand", extra=DIRTY, body=f"""
SELECT count(*) AS rows, count(*) >= 100 AS enough_rows, 7 AS numeric_columns,
 {q('sum((close IS NULL)::INTEGER) / (count(*) * 9.0)', 8, 'null_ratio')}, false AS too_many_nulls FROM dirty"""))
def chk_train(spark, sf):
    return rounded(ql.check_training(dirty(spark, sf)),
                   ["rows", "enough_rows", "numeric_columns", "too_many_nulls"], ["null_ratio"], 8)


@query("chk_stale", sql("bars_brand", body="""
SELECT symbol, last_date, DATE '2001-11-15' - last_date > 12 AS stale,
 CASE WHEN DATE '2001-11-15' - last_date > 12 THEN 'run a data sync' END AS recommendation
FROM (SELECT symbol, max(date) AS last_date FROM bars_brand GROUP BY symbol)"""), dates="last_date")
def chk_stale(spark, sf):
    return ql.check_stale(t.bars_brand(spark, sf), dt.date(2001, 11, 15), 12).select(
        "symbol", "last_date", "stale", "recommendation")


@query("agg_daterange", sql("bars_brand", body="""
SELECT min(date) AS start_date, max(date) AS end_date, CAST(max(date) - min(date) AS INTEGER) AS total_days FROM bars_brand"""),
    dates="start_date end_date")
def agg_daterange(spark, sf):
    return ql.date_range(t.table(spark, sf, "lineitem").where("l_quantity > 0").select(F.col("l_shipdate").cast("date").alias("date")))


# -- sources and sinks ----------------------------------------------------

_PC = {"close": 6, "volume": 2}
_PQ = ", ".join(q(c, d) for c, d in _PC.items())


def _prices(spark, sf):
    return t.prices_supp(spark, sf)


def _filled_store(spark, sf):
    s = st.BarStore(spark, scratch_path(spark, "prices"))
    s.append(_prices(spark, sf))
    return s


@dated("src_bars", sql("bars_brand", body=f"""SELECT symbol, date, {', '.join(q(c, d) for c, d in _EXT.items())} FROM bars_brand
WHERE symbol IN ('Brand#1', 'Brand#12', 'Brand#7') AND date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'"""))
def src_bars(spark, sf):
    s = st.BarStore(spark, scratch_path(spark, "bars"))
    s.append(t.bars_brand(spark, sf))
    return rounded(s.read(["Brand#1", "Brand#12", "Brand#7"], dt.date(1996, 3, 1), dt.date(1998, 2, 28)), K, _EXT)


@dated("src_matrix", sql("bars_brand", body="SELECT date, " + ", ".join(
    q(f"avg(close) FILTER (WHERE symbol = 'Brand#{i}')", 6, f"b{i}") for i in (1, 2, 3, 4, 5))
    + " FROM bars_brand WHERE symbol IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5') GROUP BY date"))
def src_matrix(spark, sf):
    names = [f"Brand#{i}" for i in (1, 2, 3, 4, 5)]
    m = st.matrix(t.bars_brand(spark, sf), names, dt.date(1990, 1, 1), dt.date(2010, 1, 1))
    return rounded(m.withColumnsRenamed({f"Brand#{i}": f"b{i}" for i in (1, 2, 3, 4, 5)}), ["date"], [f"b{i}" for i in (1, 2, 3, 4, 5)])


def _landing(spark, sf):
    """The brand bars as a vendor would deliver them: vendor headers, text, some rubbish."""
    b = t.bars_brand(spark, sf)
    d = F.dayofmonth("date")
    return b.select(
        "symbol",
        F.date_format("date", "yyyy-MM-dd").alias("日期"),
        F.col("open").cast("string").alias("开盘"),
        F.when(d == 7, F.lit("-")).otherwise(F.col("close").cast("string")).alias("收盘"),
        F.col("high").cast("string").alias("最高"),
        F.col("low").cast("string").alias("最低"),
        F.when(d == 8, F.lit(None)).otherwise(F.col("volume").cast("string")).alias("成交量"),
        F.when(d == 9, F.lit("")).otherwise(F.col("amount").cast("string")).alias("成交额"),
        F.lit("0.1").alias("换手率"),
    )


_STD = "SELECT symbol, date, {open}, {close}, {high}, {low}, {volume}, {amount} FROM bars_brand"
_NB = {"close": f"CASE WHEN {_D} <> 7 THEN close END", "volume": f"CASE WHEN {_D} <> 8 THEN volume END",
       "amount": f"CASE WHEN {_D} <> 9 THEN amount END"}


@dated("src_stdcols", sql("bars_brand", body=_STD.format(
    open=q("open", 6, "open_price"), close=q(_NB["close"], 6, "close_price"), high=q("high", 6, "high_price"),
    low=q("low", 6, "low_price"), volume=q(_NB["volume"], 2, "volume"), amount=q(_NB["amount"], 2, "amount"))))
def src_stdcols(spark, sf):
    return rounded(vn.standardize(_landing(spark, sf)), K, {
        **{f"{c}_price": 6 for c in ("open", "close", "high", "low")}, "volume": 2, "amount": 2})


@dated("src_tobars", sql("bars_brand", body=_STD.format(
    open=q("open"), close=q(f"coalesce({_NB['close']}, 0)", 6, "close"), high=q("high"), low=q("low"),
    volume=q(f"coalesce({_NB['volume']}, 0)", 2, "volume"), amount=q(_NB["amount"], 2, "amount"))))
def src_tobars(spark, sf):
    return rounded(vn.to_bars(vn.standardize(_landing(spark, sf))), K, {**_EXT, "amount": 2})


_CODES = "SELECT (c_custkey * 7919) % 1000000 AS code, c_name AS name FROM customer"


@query("src_symlist", f"""SELECT lpad(CAST(code AS VARCHAR), 6, '0') AS symbol, name,
 CASE WHEN substr(lpad(CAST(code AS VARCHAR), 6, '0'), 1, 2) IN ('60', '68', '90') THEN 'SH' ELSE 'SZ' END AS exchange FROM ({_CODES})""")
def src_symlist(spark, sf):
    c = t.table(spark, sf, "customer")
    return vn.symbol_list(c.select(((F.col("c_custkey") * 7919) % 1000000).alias("code"), F.col("c_name").alias("name")))


_FUND = list(vn.FUNDAMENTAL_HEADERS.values())
_FEXPR = ["avg(o_totalprice) / 1000", "max(o_totalprice) / 1000", "sum(o_totalprice)", "min(o_totalprice)", "count(*)", "count(DISTINCT o_custkey)",
          "max(o_orderkey)", "min(o_orderkey)"]


@query("src_fund", "SELECT symbol, qtr AS date, " + ", ".join(q(f"c{i}", 4, n) for i, n in enumerate(_FUND)) + """
FROM (SELECT lpad(CAST(o_custkey % 500 AS VARCHAR), 6, '0') AS symbol, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS qtr, """
    + ", ".join(f"{e} AS c{i}" for i, e in enumerate(_FEXPR)) + """ FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY qtr DESC) = 1""")
def src_fund(spark, sf):
    o = t.table(spark, sf, "orders")
    p = F.col("o_totalprice")
    heads = list(vn.FUNDAMENTAL_HEADERS)
    vals = [F.avg(p) / 1000, F.max(p) / 1000, F.sum(p), F.min(p), F.count(F.lit(1)), F.count_distinct("o_custkey"),
            F.max("o_orderkey"), F.min("o_orderkey")]
    quarterly = o.groupBy(
        F.lpad((F.col("o_custkey") % 500).cast("string"), 6, "0").alias("symbol"),
        F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("季度"),
    ).agg(*[v.alias(h) for v, h in zip(vals, heads)])
    return rounded(vn.latest_fundamentals(quarterly), ["symbol", "date"], _FUND, 4)


@query("src_industry", """
WITH a AS (SELECT p_brand AS symbol, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN '所属行业' WHEN 1 THEN '概念板块' ELSE '总股本' END AS item,
 p_type AS value FROM part)
SELECT symbol, arg_max(value, seq) FILTER (WHERE item = '所属行业') AS industry,
 coalesce(string_agg(value, ',' ORDER BY seq) FILTER (WHERE item = '概念板块'), '') AS sectors FROM a GROUP BY symbol""")
def src_industry(spark, sf):
    p = t.table(spark, sf, "part")
    k = F.col("p_partkey") % 3
    a = p.select(
        F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("seq"),
        F.when(k == 0, "所属行业").when(k == 1, "概念板块").otherwise("总股本").alias("item"), F.col("p_type").alias("value"))
    return vn.industry_classification(a).select("symbol", "industry", F.array_join("sectors", ",").alias("sectors"))


_QT = [v for v in vn.QUOTE_HEADERS.values() if v not in ("symbol", "name")]


@query("src_quote", sql("bars_brand", body="SELECT symbol, name, '2001-12-31 15:00:00' AS timestamp, " + qs(_QT, 4) + f""" FROM (
SELECT symbol, 'N' || symbol AS name, close AS latest_price, (close / p - 1) * 100 AS change_pct, close - p AS change_amount, volume, amount,
 open AS open_price, high AS high_price, low AS low_price, p AS pre_close
FROM (SELECT *, lag(close) OVER ({_W}) AS p FROM bars_brand) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"""))
def src_quote(spark, sf):
    from ..functions.guards import by_date

    b = t.bars_brand(spark, sf).withColumn("p", F.lag("close").over(by_date()))
    snap = ql.keep_last(b, ["symbol"], "date")
    found = vn.quotes(snap.select(
        F.col("symbol").alias("代码"), F.concat(F.lit("N"), "symbol").alias("名称"), F.col("close").alias("最新价"),
        ((F.col("close") / F.col("p") - 1) * 100).alias("涨跌幅"), (F.col("close") - F.col("p")).alias("涨跌额"),
        F.col("volume").alias("成交量"), F.col("amount").alias("成交额"), F.col("open").alias("今开"),
        F.col("high").alias("最高"), F.col("low").alias("最低"), F.col("p").alias("昨收")), at=F.lit("2001-12-31 15:00:00").cast("timestamp"))
    taken = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    return rounded(found, ["symbol", "name", taken], _QT, 4)


@query("src_calendar", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem WHERE year(l_shipdate) = 1998", dates="trade_date")
def src_calendar(spark, sf):
    return vn.trading_calendar(t.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("trade_date")), 1998)


@dated("src_index", sql("bars_brand", body=f"""SELECT date, {q('open', 6, 'open_price')}, {q('close', 6, 'close_price')}
FROM bars_brand WHERE symbol = 'Brand#1' AND date BETWEEN DATE '2000-11-05' AND DATE '2001-11-05'"""))
def src_index(spark, sf):
    b = t.bars_brand(spark, sf).where("symbol = 'Brand#1'")
    return rounded(vn.index_bars(b, today=dt.date(2001, 11, 5)), ["date"], ["open_price", "close_price"])


@query("src_rawsql", """SELECT l_returnflag, count(*) AS n, (round(sum(l_quantity), 2) + 0) AS qty FROM lineitem
WHERE l_shipdate >= DATE '1997-01-01' AND l_quantity > 10 GROUP BY l_returnflag""")
def src_rawsql(spark, sf):
    return st.raw_sql(spark, """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM barloom_lineitem
        WHERE l_shipdate >= :since AND l_quantity > :qty GROUP BY l_returnflag""",
        {"since": dt.date(1997, 1, 1), "qty": 10}, {"barloom_lineitem": t.table(spark, sf, "lineitem")})


@dated("snk_bars_append", sql("prices_supp", body=f"""
SELECT symbol, date, count(*) AS copies, {q('max(close)', 6, 'close')} FROM (SELECT * FROM prices_supp
UNION ALL SELECT * FROM prices_supp WHERE date >= DATE '2000-01-01') GROUP BY 1, 2"""))
def snk_bars_append(spark, sf):
    s = _filled_store(spark, sf)
    s.append(_prices(spark, sf).where("date >= '2000-01-01'"))
    back = s.read().groupBy(*K).agg(F.count(F.lit(1)).alias("copies"), F.max("close").alias("close"))
    return rounded(back, [*K, "copies"], ["close"])


_UPD = "date BETWEEN DATE '1998-06-01' AND DATE '1999-03-31' AND symbol < '000040'"


def _updates(spark, sf):
    return _prices(spark, sf).where(
        "date BETWEEN '1998-06-01' AND '1999-03-31' AND symbol < '000040'"
    ).withColumn("close", F.col("close") + 1000)


@dated("snk_bars_overwrite", sql("prices_supp", extra=f"""
up AS (SELECT symbol, date, close + 1000 AS close, volume FROM prices_supp WHERE {_UPD}),
tk AS (SELECT DISTINCT symbol, year(date) AS y FROM up)""", body=f"""
SELECT symbol, date, {_PQ} FROM (SELECT * FROM up UNION ALL
 SELECT symbol, date, close, volume FROM prices_supp p WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.symbol = p.symbol AND tk.y = year(p.date)))"""))
def snk_bars_overwrite(spark, sf):
    s = _filled_store(spark, sf)
    s.overwrite(_updates(spark, sf))
    return rounded(s.read(), K, _PC)


@dated("snk_bars_merge", sql("prices_supp", body=f"""
SELECT symbol, date, {q(f'CASE WHEN {_UPD} THEN close + 1000 ELSE close END', 6, 'close')}, {q('volume', 2)} FROM prices_supp"""))
def snk_bars_merge(spark, sf):
    s = _filled_store(spark, sf)
    s.merge(_updates(spark, sf))
    return rounded(s.read(), K, _PC)


@dated("snk_delete", sql("prices_supp", body=f"""
SELECT symbol, date, {_PQ} FROM prices_supp WHERE symbol <> '000003' AND NOT (symbol = '000005' AND year(date) = 1997)"""))
def snk_delete(spark, sf):
    s = _filled_store(spark, sf)
    s.delete("000003")
    s.delete("000005", 1997)
    return rounded(s.read(), K, _PC)


@query("src_listsym", sql("prices_supp", body="SELECT DISTINCT symbol FROM prices_supp"))
def src_listsym(spark, sf):
    return _filled_store(spark, sf).symbols()


@query("src_stats", sql("prices_supp", body="""SELECT count(DISTINCT symbol) AS symbols_count, count(*) AS total_records,
 CAST(min(year(date)) AS INTEGER) AS first_year, CAST(max(year(date)) AS INTEGER) AS last_year, true AS has_files FROM prices_supp"""))
def src_stats(spark, sf):
    return _filled_store(spark, sf).stats().select(
        "symbols_count", "total_records", "first_year", "last_year",
        ((F.col("total_files") > 0) & (F.col("total_size_mb") > 0)).alias("has_files"))


@query("src_datastats", sql("bars_brand", body="""SELECT count(DISTINCT symbol) AS total_symbols, count(*) AS total_records,
 min(date) AS first_date, max(date) AS last_date FROM bars_brand"""), dates="first_date last_date")
def src_datastats(spark, sf):
    return st.data_statistics(t.bars_brand(spark, sf))


@query("snk_bulk", f"""SELECT c_custkey, c_mktsegment, {q('c_acctbal', 2)} FROM (
SELECT c_custkey, c_mktsegment, CASE WHEN n IS NOT NULL THEN c_acctbal + n ELSE c_acctbal END AS c_acctbal FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey
UNION ALL SELECT c_custkey + 1000000, c_mktsegment, c_acctbal FROM customer WHERE c_nationkey = 3)""")
def snk_bulk(spark, sf):
    """Bulk insert (append) and bulk update (by key) of a stored table, which is read again."""
    c = t.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    extra = t.table(spark, sf, "customer").where("c_nationkey = 3").select(
        (F.col("c_custkey") + 1000000).alias("c_custkey"), "c_mktsegment", "c_acctbal")
    path = scratch_path(spark, "customer")
    c.write.parquet(path)
    extra.write.mode("append").parquet(path)
    n = t.table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).count()
    current = spark.read.parquet(path)
    changes = current.join(n, "c_custkey").select("c_custkey", (F.col("c_acctbal") + F.col("count")).alias("c_acctbal"))
    st.write_updates(spark, path, changes, ["c_custkey"])
    return rounded(spark.read.parquet(path), ["c_custkey", "c_mktsegment"], ["c_acctbal"], 2)


@query("snk_retention", """SELECT o_orderkey, o_orderstatus FROM orders
WHERE NOT (o_orderdate < TIMESTAMP '1999-01-01' AND o_orderstatus IN ('F', 'O'))""")
def snk_retention(spark, sf):
    """Finished task rows older than the cutoff go from the stored table, which is read again."""
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    old = (F.col("o_orderdate") < F.lit(dt.datetime(1999, 1, 1))) & F.col("o_orderstatus").isin("F", "O")
    path = scratch_path(spark, "tasks")
    o.write.parquet(path)
    st.write_retention(spark, path, old)
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus")


# -- filters --------------------------------------------------------------


@query("flt_dsl", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice BETWEEN 50000 AND 300000 AND o_orderstatus IN ('F', 'O')
 AND o_orderpriority LIKE '%-N%' AND o_custkey >= 10 AND o_orderkey NOT IN (1, 2, 3)""")
def flt_dsl(spark, sf):
    return sl.apply_filters(t.table(spark, sf, "orders"), {
        "o_totalprice": {"between": (50000, 300000)}, "o_orderstatus": ["F", "O"], "o_orderpriority": {"like": "-N"},
        "o_custkey": {"gte": 10}, "o_orderkey": {"not_in": [1, 2, 3]}, "no_such_column": 1}).select("o_orderkey", "o_orderstatus")


@query("flt_dsl_more", """SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%' AND p_size <> 7 AND p_brand IS NOT NULL AND p_type = 'ECONOMY' AND p_retailprice > 901""")
def flt_dsl_more(spark, sf):
    return sl.apply_filters(t.table(spark, sf, "part"), {
        "p_name": {"ilike": "RED"}, "p_size": {"ne": 7}, "p_brand": {"is_null": False}, "p_type": "ECONOMY",
        # only the first operator of a column counts
        "p_retailprice": {"gt": 901, "lt": 0}}).select("p_partkey")


@query("flt_symbols", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#3', 'Brand#14')")
def flt_symbols(spark, sf):
    return t.table(spark, sf, "part").where(F.col("p_brand").isin("Brand#3", "Brand#14")).select("p_partkey", "p_brand")


@query("flt_dates", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
def flt_dates(spark, sf):
    lo, hi = dt.datetime(1996, 2, 1), dt.datetime(1996, 3, 1)
    # half-open bounds on the stored column, so that row groups are pruned
    return t.table(spark, sf, "orders").where((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi)).select("o_orderkey")


@query("flt_pattern", "SELECT DISTINCT p_brand AS symbol FROM part WHERE contains(p_brand, '#2')")
def flt_pattern(spark, sf):
    return t.table(spark, sf, "part").where(F.col("p_brand").contains("#2")).select(F.col("p_brand").alias("symbol")).distinct()


@query("flt_name", """SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '42') AND c_mktsegment = 'MACHINERY' AND c_nationkey = 19""")
def flt_name(spark, sf):
    c = t.table(spark, sf, "customer")
    return c.where(F.col("c_name").contains("42") & (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") == 19)).select("c_custkey", "c_name")


@query("flt_orders", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'O'
 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-07-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""")
def flt_orders(spark, sf):
    o = t.table(spark, sf, "orders").where(
        (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= dt.datetime(1996, 1, 1))
        & (F.col("o_orderdate") < dt.datetime(1998, 7, 1)))
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("flt_nonzero", f"""SELECT strategy, symbol, {q('qty', 2)} FROM (SELECT l_linestatus AS strategy, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol,
 sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS qty FROM lineitem GROUP BY 1, 2) WHERE qty <> 0""")
def flt_nonzero(spark, sf):
    li = t.table(spark, sf, "lineitem")
    sgn = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)
    g = li.groupBy(F.col("l_linestatus").alias("strategy"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("symbol")).agg(F.sum(sgn).alias("qty"))
    return rounded(g.where("qty != 0"), ["strategy", "symbol"], ["qty"], 2)


@query("flt_errors", """SELECT event_id, event_type FROM events WHERE event_type IN ('error') AND ts >= TIMESTAMP '2024-01-30'
ORDER BY ts DESC, event_id DESC LIMIT 50""")
def flt_errors(spark, sf):
    e = t.table(spark, sf, "events")
    return e.where(F.col("event_type").isin("error") & (F.col("ts") >= dt.datetime(2024, 1, 30))).orderBy(
        F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


# -- ordering and paging --------------------------------------------------


@query("srt_multi", f"""SELECT c_custkey, {q('c_acctbal', 2)} FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 40 OFFSET 20""")
def srt_multi(spark, sf):
    df = sl.get_multi(t.table(spark, sf, "customer"), 20, 40, "c_acctbal", True, {"c_mktsegment": "BUILDING"}, ["c_custkey"])
    return rounded(df, ["c_custkey"], ["c_acctbal"], 2)


@query("srt_page", """SELECT c_custkey, n AS total, 3 AS page, CAST(ceil(n / 100.0) AS BIGINT) AS total_pages, 3 < ceil(n / 100.0) AS has_next, true AS has_prev
FROM customer, (SELECT count(*) AS n FROM customer) ORDER BY c_acctbal, c_custkey LIMIT 100 OFFSET 200""")
def srt_page(spark, sf):
    c = t.table(spark, sf, "customer")
    return sl.paginate(c, ["c_acctbal", "c_custkey"], 3, 500).select("c_custkey", "total", "page", "total_pages", "has_next", "has_prev")


@query("srt_pageafter", f"""SELECT o_orderkey, {q('o_totalprice', 2)} FROM orders ORDER BY o_custkey, o_orderkey LIMIT 300""")
def srt_pageafter(spark, sf):
    """Three pages of a listing, each found from the key of the row before it."""
    o, order, after, pages = t.table(spark, sf, "orders"), ["o_custkey", "o_orderkey"], None, []
    for _ in range(3):
        pages.append(sl.page_after(o, order, after, 100))
        after = sl.next_of(pages[-1], order)
    return rounded(sl.union_all(pages), ["o_orderkey"], ["o_totalprice"], 2)


@dated("srt_offset", sql("bars_brand", body=f"""
SELECT date, {q('close')}, n AS total_count, true AS has_more, 150 AS next_offset FROM bars_brand,
 (SELECT count(*) AS n FROM bars_brand WHERE symbol = 'Brand#3') WHERE symbol = 'Brand#3' ORDER BY date LIMIT 100 OFFSET 50"""))
def srt_offset(spark, sf):
    b = t.bars_brand(spark, sf).where("symbol = 'Brand#3'")
    page = b.orderBy("date").offset(50).limit(100).withColumn("total_count", b.agg(F.count(F.lit(1))).scalar())
    more = F.col("total_count") > 150
    return rounded(page.withColumns({"has_more": more, "next_offset": F.when(more, 150)}),
                   ["date", "total_count", "has_more", "next_offset"], ["close"])


@dated("srt_tail", sql("bars_brand", body=f"SELECT date, {q('close')} FROM (SELECT * FROM bars_brand WHERE symbol = 'Brand#3' ORDER BY date DESC LIMIT 30)"))
def srt_tail(spark, sf):
    return rounded(sl.newest(t.bars_brand(spark, sf).where("symbol = 'Brand#3'"), 30), ["date"], ["close"])


@dated("srt_query", sql("bars_brand", body=f"SELECT symbol, date, {q('volume', 2)} FROM bars_brand ORDER BY volume DESC, symbol, date LIMIT 200"))
def srt_query(spark, sf):
    return rounded(sl.select_query(t.bars_brand(spark, sf), "volume", False, limit=200), K, ["volume"], 2)


@query("srt_recent", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 5")
def srt_recent(spark, sf):
    return sl.newest(t.table(spark, sf, "orders"), 5, "o_orderdate", ["o_orderkey"]).select("o_orderkey")


@query("srt_tailper", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def srt_tailper(spark, sf):
    return sl.top_per_group(t.table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role")


@dated("srt_batch", sql("bars_brand", body=f"""SELECT symbol, date, {q('close')} FROM bars_brand WHERE symbol IN ('Brand#1', 'Brand#2', 'Brand#9')
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date) <= 120"""))
def srt_batch(spark, sf):
    b = t.bars_brand(spark, sf).where(F.col("symbol").isin("Brand#1", "Brand#2", "Brand#9"))
    return rounded(sl.top_per_group(b, ["symbol"], ["date"], 120), K, ["close"])


@dated("srt_topk", sql("prices_supp", body=f"SELECT symbol, date, {q('close')} FROM prices_supp QUALIFY row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) <= 10"))
def srt_topk(spark, sf):
    return rounded(sl.top_per_group(_prices(spark, sf), ["date"], [F.desc("close"), "symbol"], 10), K, ["close"])


# -- set operators --------------------------------------------------------


@dated("set_union", sql("prices_supp", "bars_brand", body=f"""SELECT symbol, date, {q('close')}, {q('amount', 2)} FROM (
SELECT symbol, date, close, NULL::DOUBLE AS amount FROM prices_supp UNION ALL SELECT symbol, date, close, amount FROM bars_brand)"""))
def set_union(spark, sf):
    u = sl.union_all([_prices(spark, sf), t.bars_brand(spark, sf)])
    return rounded(u, K, {"close": 6, "amount": 2})


@query("set_uniondates", "SELECT DISTINCT d AS date FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders)", dates="date")
def set_uniondates(spark, sf):
    a = t.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    b = t.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return a.union(b).distinct()


@query("set_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_except(spark, sf):
    found = t.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.table(spark, sf, "customer").select("c_custkey").subtract(found)


@query("set_intersect", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_intersect(spark, sf):
    found = t.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.table(spark, sf, "customer").select("c_custkey").join(found, "c_custkey", "left_semi")
