"""Registered queries: indicators, window features, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import backtest as bt
from ..operators import indicators as ind
from ..operators import signals as sig
from ..sources import tables as t
from .registry import dated, query
from .shape import q, qs, rounded
from .views_sql import sql

W = "PARTITION BY symbol ORDER BY date"
K = ("symbol", "date")


def rows(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _brand(body: str, extra: str = "") -> str:
    return sql("bars_brand", body=body, extra=extra)


# -- moving averages ------------------------------------------------------

_MA = ", ".join(
    f"CASE WHEN count(*) OVER (PARTITION BY symbol) > {n} THEN avg(close) OVER {rows(n)} END AS ma_{n}"
    for n in ind.MA_WINDOWS
)
_MA_OUT = [f"ma_{n}" for n in ind.MA_WINDOWS]
_RATIO_OUT = [f"close_ma_{n}_ratio" for n in ind.MA_WINDOWS]


@dated(
    "win_ma",
    _brand(
        f"SELECT symbol, date, {qs(_MA_OUT, 4)}, "
        + ", ".join(q(f"close / nullif(ma_{n}, 0)", 6, f"close_ma_{n}_ratio") for n in ind.MA_WINDOWS)
        + " FROM m",
        extra=f"m AS (SELECT symbol, date, close, {_MA} FROM bars_brand)",
    ),
)
def win_ma(spark, sf):
    df = ind.ma(t.bars_brand(spark, sf))
    return rounded(df, K, {**dict.fromkeys(_MA_OUT, 4), **dict.fromkeys(_RATIO_OUT, 6)})


def strict_sql(expr: str, n: int) -> str:
    return f"CASE WHEN count({expr}) OVER {rows(n)} = {n} THEN avg({expr}) OVER {rows(n)} END"


@dated(
    "win_ma_strict",
    _brand(
        "SELECT symbol, date, "
        + ", ".join(q(strict_sql("close", n), 4, f"ma_{n}") for n in (5, 20))
        + " FROM bars_brand"
    ),
)
def win_ma_strict(spark, sf):
    return rounded(ind.ma_strict(t.bars_brand(spark, sf), (5, 20)), K, ["ma_5", "ma_20"], 4)


# -- exponential means ----------------------------------------------------


def ema_cte(name: str, src: str, col: str, span: int, out: str, keep: str = "*") -> str:
    a, d = 2 / (span + 1), 1 - 2 / (span + 1)
    return f"""{name} AS (
  SELECT {keep}, pow({d!r}, _i) * sum((CASE WHEN _i = 0 THEN 1.0 ELSE {a!r} END) * {col} * pow({d!r}, -_i))
         OVER ({W} ROWS UNBOUNDED PRECEDING) AS {out}
  FROM {src})"""


_NUM = f"n0 AS (SELECT symbol, date, close, row_number() OVER ({W}) - 1 AS _i FROM bars_brand)"
_EMA = ", ".join([_NUM, ema_cte("e1", "n0", "close", 12, "ema_12"), ema_cte("e2", "e1", "close", 26, "ema_26")])


@dated("win_ema", _brand(f"SELECT symbol, date, {qs(['ema_12', 'ema_26'], 4)} FROM e2", extra=_EMA))
def win_ema(spark, sf):
    return rounded(ind.ema(t.bars_brand(spark, sf)), K, ["ema_12", "ema_26"], 4)


_MACD = ", ".join(
    [_EMA, "e3 AS (SELECT *, ema_12 - ema_26 AS macd FROM e2)", ema_cte("e4", "e3", "macd", 9, "macd_signal")]
)
_MACD_OUT = ["macd", "macd_signal", "macd_hist"]


@dated(
    "win_macd",
    _brand(f"SELECT symbol, date, {qs(_MACD_OUT, 4)} FROM (SELECT *, macd - macd_signal AS macd_hist FROM e4)",
           extra=_MACD),
)
def win_macd(spark, sf):
    return rounded(ind.macd(t.bars_brand(spark, sf)), K, _MACD_OUT, 4)


# -- RSI ------------------------------------------------------------------

MOVES = f"""mv AS (
  SELECT *, CASE WHEN chg > 0 THEN chg ELSE 0.0 END AS gain, CASE WHEN chg < 0 THEN -chg ELSE 0.0 END AS loss
  FROM (SELECT *, close - lag(close) OVER ({W}) AS chg FROM bars_brand))"""


def rsi_sql(gain: str, loss: str) -> str:
    return (
        f"CASE WHEN {loss} = 0 THEN CASE WHEN {gain} > 0 THEN 100.0 END "
        f"ELSE 100 - 100 / (1 + {gain} / {loss}) END"
    )


def _rsi_cte(n: int, strict: bool) -> str:
    g = strict_sql("gain", n) if strict else f"avg(gain) OVER {rows(n)}"
    l = strict_sql("loss", n) if strict else f"avg(loss) OVER {rows(n)}"
    return f"r{n} AS (SELECT *, {rsi_sql('g', 'l')} AS rsi_{n} FROM (SELECT *, {g} AS g, {l} AS l FROM mv))"


@dated(
    "win_rsi",
    _brand(
        f"SELECT symbol, date, {qs(['rsi_14', 'rsi_6'])} FROM r14 JOIN r6 USING (symbol, date)",
        extra=", ".join([MOVES, _rsi_cte(14, False), _rsi_cte(6, False)]),
    ),
)
def win_rsi(spark, sf):
    return rounded(ind.rsi(t.bars_brand(spark, sf)), K, ["rsi_14", "rsi_6"])


@dated(
    "win_rsi_strict",
    _brand(f"SELECT symbol, date, {q('rsi_14')} FROM r14", extra=f"{MOVES}, {_rsi_cte(14, True)}"),
)
def win_rsi_strict(spark, sf):
    return rounded(ind.rsi_strict(t.bars_brand(spark, sf)), K, ["rsi_14"])


@dated(
    "win_rsi_fast",
    _brand(
        "SELECT symbol, date, "
        + q("CASE WHEN n = 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END END", 6, "rsi_14")
        + f" FROM (SELECT *, count(chg) OVER {rows(14)} AS n, avg(gain) OVER {rows(14)} AS g,"
        f" avg(loss) OVER {rows(14)} AS l FROM mv)",
        extra=MOVES,
    ),
)
def win_rsi_fast(spark, sf):
    return rounded(ind.rsi_full_changes(t.bars_brand(spark, sf)), K, ["rsi_14"])


# -- bands and oscillators ------------------------------------------------

_BOLL = ["boll_middle", "boll_upper", "boll_lower", "boll_width", "boll_position"]
_BOLL_DIG = dict(zip(_BOLL, (4, 4, 4, 6, 6)))
_BOLL_CTE = f"""
b0 AS (SELECT *, avg(close) OVER {rows(20)} AS boll_middle, stddev_samp(close) OVER {rows(20)} AS sd FROM bars_brand),
b1 AS (SELECT *, boll_middle + 2 * sd AS boll_upper, boll_middle - 2 * sd AS boll_lower FROM b0),
b2 AS (SELECT *, (boll_upper - boll_lower) / nullif(boll_middle, 0) AS boll_width,
       (close - boll_lower) / nullif(boll_upper - boll_lower, 0) AS boll_position FROM b1)"""


@dated(
    "win_boll",
    _brand("SELECT symbol, date, " + ", ".join(q(c, d) for c, d in _BOLL_DIG.items()) + " FROM b2", extra=_BOLL_CTE),
)
def win_boll(spark, sf):
    return rounded(ind.boll(t.bars_brand(spark, sf)), K, _BOLL_DIG)


_KDJ = ["kdj_k", "kdj_d", "kdj_j"]
_KDJ_CTE = f"""
k0 AS (SELECT *, (close - lo) / nullif(hi - lo, 0) * 100 AS rsv FROM (
  SELECT *, min(low) OVER {rows(9)} AS lo, max(high) OVER {rows(9)} AS hi FROM bars_brand)),
k1 AS (SELECT *, avg(rsv) OVER {rows(3)} AS kdj_k FROM k0),
k2 AS (SELECT *, avg(kdj_k) OVER {rows(3)} AS kdj_d FROM k1),
k3 AS (SELECT *, 3 * kdj_k - 2 * kdj_d AS kdj_j FROM k2)"""


@dated("win_kdj", _brand(f"SELECT symbol, date, {qs(_KDJ)} FROM k3", extra=_KDJ_CTE))
def win_kdj(spark, sf):
    return rounded(ind.kdj(t.bars_brand(spark, sf)), K, _KDJ)


_WILL = f"(hi - close) / nullif(hi - lo, 0) * -100"
_WILL_SRC = f"(SELECT *, max(high) OVER {rows(14)} AS hi, min(low) OVER {rows(14)} AS lo FROM bars_brand)"


@dated("win_williams", _brand(f"SELECT symbol, date, {q(_WILL, 6, 'williams_r')} FROM {_WILL_SRC}"))
def win_williams(spark, sf):
    return rounded(ind.williams(t.bars_brand(spark, sf)), K, ["williams_r"])


_VOL = ["volume_ma_5", "volume_ma_10", "volume_ratio"]


@dated(
    "win_volma",
    _brand(
        f"SELECT symbol, date, {q(f'avg(volume) OVER {rows(5)}', 6, 'volume_ma_5')}, "
        f"{q(f'avg(volume) OVER {rows(10)}', 6, 'volume_ma_10')}, "
        f"{q(f'volume / nullif(avg(volume) OVER {rows(5)}, 0)', 6, 'volume_ratio')} FROM bars_brand"
    ),
)
def win_volma(spark, sf):
    return rounded(ind.volume_ma(t.bars_brand(spark, sf)), K, _VOL)


_ALL_EXTRA = ", ".join(
    [MOVES, _rsi_cte(14, False), _rsi_cte(6, False), _MACD, _BOLL_CTE, _KDJ_CTE,
     "e5 AS (SELECT *, macd - macd_signal AS macd_hist FROM e4)",
     f"m AS (SELECT symbol, date, close, {_MA}, "
     + ", ".join(f"close / nullif(ma_{n}, 0) AS close_ma_{n}_ratio" for n in ind.MA_WINDOWS) + " FROM bars_brand)",
     f"wv AS (SELECT symbol, date, {_WILL} AS williams_r, avg(volume) OVER {rows(5)} AS volume_ma_5,"
     f" avg(volume) OVER {rows(10)} AS volume_ma_10,"
     f" volume / nullif(avg(volume) OVER {rows(5)}, 0) AS volume_ratio FROM {_WILL_SRC})"]
)
_ALL_COLS = (
    {c: 4 for c in _MA_OUT + ["ema_12", "ema_26", *_MACD_OUT, "boll_middle", "boll_upper", "boll_lower"]}
    | {c: 6 for c in [*_RATIO_OUT, "rsi_14", "rsi_6", "boll_width", "boll_position", *_KDJ, "williams_r", *_VOL]}
)


@dated(
    "win_allind",
    _brand(
        "SELECT symbol, date, " + ", ".join(q(c, d) for c, d in _ALL_COLS.items())
        + " FROM m JOIN r14 USING (symbol, date) JOIN r6 USING (symbol, date) JOIN e5 USING (symbol, date)"
        " JOIN b2 USING (symbol, date) JOIN k3 USING (symbol, date) JOIN wv USING (symbol, date)",
        extra=_ALL_EXTRA,
    ),
)
def win_allind(spark, sf):
    return rounded(ind.all_indicators(t.bars_brand(spark, sf)), K, _ALL_COLS)


# -- returns, fills, lags, targets ---------------------------------------

_RET = f"close / nullif(lag(close) OVER ({W}), 0)"


@dated(
    "win_returns",
    _brand(f"SELECT symbol, date, {q(f'{_RET} - 1', 6, 'returns')}, {q(f'ln({_RET})', 6, 'log_returns')} FROM bars_brand"),
)
def win_returns(spark, sf):
    return rounded(ind.returns(t.bars_brand(spark, sf)), K, ["returns", "log_returns"])


# every fifth calendar day, and two full weeks a month, lose their close
_GAPPY = """g AS (SELECT symbol, date, CASE WHEN extract(day FROM date) BETWEEN 10 AND 16
                 OR extract(day FROM date) % 5 = 0 THEN NULL ELSE close END AS close FROM bars_brand)"""


def _gappy(spark, sf):
    d = F.dayofmonth("date")
    return t.bars_brand(spark, sf).select(
        "symbol", "date", F.when(~(d.between(10, 16) | (d % 5 == 0)), F.col("close")).alias("close")
    )


@dated(
    "win_ffill",
    sql("bars_brand", extra=_GAPPY, body=f"""
SELECT symbol, date,
  {q(f"last_value(close IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)", 6, "filled")},
  {q(f"last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", 6, "filled_3")}
FROM g"""),
)
def win_ffill(spark, sf):
    df = _gappy(spark, sf).withColumns({"filled": F.col("close"), "filled_3": F.col("close")})
    df = ind.ffill(ind.ffill(df, ["filled"]), ["filled_3"], limit=3)
    return rounded(df, K, ["filled", "filled_3"])


_FEAT = ["close", "volume"]


@dated(
    "win_lagfeat",
    _brand("SELECT symbol, date, " + ", ".join(
        q(f"lag({c}, {k}) OVER ({W})", 6, f"{c}_lag_{k}") for k in (1, 2, 3, 5) for c in _FEAT) + " FROM bars_brand"),
)
def win_lagfeat(spark, sf):
    df = ind.lag_features(t.bars_brand(spark, sf), _FEAT)
    return rounded(df, K, [f"{c}_lag_{k}" for k in (1, 2, 3, 5) for c in _FEAT])


@dated(
    "win_mafeat",
    _brand("SELECT symbol, date, " + ", ".join(
        q(f"avg({c}) OVER {rows(n)}", 4, f"{c}_ma_{n}") for n in (5, 10, 20) for c in _FEAT) + " FROM bars_brand"),
)
def win_mafeat(spark, sf):
    df = ind.ma_features(t.bars_brand(spark, sf), _FEAT)
    return rounded(df, K, [f"{c}_ma_{n}" for n in (5, 10, 20) for c in _FEAT], 4)


def _target(kind, horizon):
    def run(spark, sf):
        df = ind.target(t.bars_brand(spark, sf), kind, horizon)
        return rounded(df, K, ["target"], 5)

    return run


_LEAD = f"lead(close, 5) OVER ({W})"
dated("win_target_price", _brand(f"SELECT symbol, date, {q(_LEAD, 5, 'target')} FROM bars_brand"))(_target("price", 5))
dated(
    "win_target_return",
    _brand(f"SELECT symbol, date, {q(f'({_LEAD} - close) / nullif(close, 0)', 5, 'target')} FROM bars_brand"),
)(_target("return", 5))
dated(
    "win_target_direction",
    _brand(f"SELECT symbol, date, {q(f'CASE WHEN {_LEAD} > close THEN 1 ELSE 0 END', 5, 'target')} FROM bars_brand"),
)(_target("direction", 5))
_AHEAD = f"({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
dated(
    "win_target_vol",
    _brand(
        f"SELECT symbol, date, {q(f'CASE WHEN count(r) OVER {_AHEAD} = 5 THEN stddev_samp(r) OVER {_AHEAD} END', 5, 'target')}"
        f" FROM (SELECT symbol, date, {_RET} - 1 AS r FROM bars_brand)"
    ),
)(_target("volatility", 5))


# -- signals --------------------------------------------------------------


def cross_sql(fast: str, slow: str) -> str:
    pf, ps = f"lag({fast}) OVER ({W})", f"lag({slow}) OVER ({W})"
    return (
        f"CAST(CASE WHEN {fast} > {slow} AND {pf} <= {ps} THEN 1 "
        f"WHEN {fast} < {slow} AND {pf} >= {ps} THEN -1 ELSE 0 END AS INTEGER)"
    )


SIG_MA_CTE = (
    f"s0 AS (SELECT symbol, date, close, {strict_sql('close', 5)} AS f, {strict_sql('close', 20)} AS s FROM bars_brand),"
    f" sg AS (SELECT symbol, date, close, {cross_sql('f', 's')} AS signal FROM s0)"
)


@dated("sig_ma", _brand("SELECT symbol, date, signal FROM sg", extra=SIG_MA_CTE))
def sig_ma(spark, sf):
    return sig.ma_cross(t.bars_brand(spark, sf)).select("symbol", "date", "signal")


@dated(
    "sig_ma_api",
    _brand(f"SELECT symbol, date, {cross_sql('f', 's')} AS signal FROM "
           f"(SELECT symbol, date, avg(close) OVER {rows(5)} AS f, avg(close) OVER {rows(20)} AS s FROM bars_brand)"),
)
def sig_ma_api(spark, sf):
    return sig.ma_cross(t.bars_brand(spark, sf), strict=False).select("symbol", "date", "signal")


@dated(
    "sig_rsi",
    _brand(
        "SELECT symbol, date, CAST(CASE WHEN rsi_14 < 30 AND p >= 30 THEN 1 WHEN rsi_14 > 70 AND p <= 70 THEN -1 "
        f"ELSE 0 END AS INTEGER) AS signal FROM (SELECT *, lag(rsi_14) OVER ({W}) AS p FROM r14)",
        extra=f"{MOVES}, {_rsi_cte(14, True)}",
    ),
)
def sig_rsi(spark, sf):
    return sig.rsi_cross(t.bars_brand(spark, sf)).select("symbol", "date", "signal")


@dated(
    "sig_rsi_api",
    _brand(
        "SELECT symbol, date, CAST(CASE WHEN rsi_14 > 70 THEN -1 WHEN rsi_14 < 30 THEN 1 ELSE 0 END AS INTEGER) AS signal"
        " FROM r14",
        extra=f"{MOVES}, {_rsi_cte(14, False)}",
    ),
)
def sig_rsi_api(spark, sf):
    return sig.rsi_level(t.bars_brand(spark, sf)).select("symbol", "date", "signal")


SIG_MOM_CTE = f"""mo AS (SELECT *, CAST(CASE WHEN m < -0.02 THEN -1 WHEN m > 0.02 THEN 1 ELSE 0 END AS INTEGER) AS signal
  FROM (SELECT symbol, date, close, close / nullif(lag(close, 20) OVER ({W}), 0) - 1 AS m FROM bars_brand))"""


@dated("sig_mom", _brand("SELECT symbol, date, signal FROM mo", extra=SIG_MOM_CTE))
def sig_mom(spark, sf):
    return sig.momentum(t.bars_brand(spark, sf)).select("symbol", "date", "signal")


HELD_CTE = f"""hp AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS) OVER
    ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev,
    coalesce(last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS) OVER
    ({W} ROWS UNBOUNDED PRECEDING), -1) > 0 AS held,
    close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM sg),
hd AS (SELECT *, signal > 0 AND prev < 0 AS entry, signal < 0 AND prev > 0 AS exit FROM hp)"""


@query(
    "flagship_ma_cross",
    _brand(
        """SELECT symbol, count(*) AS days, count(*) FILTER (WHERE signal = 1) AS buys, count(*) FILTER (WHERE signal = -1) AS sells,
  count(*) FILTER (WHERE h) AS held_days, """
        + q("sum(CASE WHEN h AND r IS NOT NULL THEN ln(1 + r) ELSE 0 END)", 4, "log_return")
        + f" FROM (SELECT *, coalesce(lag(held) OVER ({W}), false) AS h FROM hd) GROUP BY symbol",
        extra=SIG_MA_CTE + ", " + HELD_CTE,
    ),
)
def flagship_ma_cross(spark, sf):
    df = sig.held(sig.ma_cross(t.bars_brand(spark, sf)))
    return rounded(bt.signal_summary(df), ["symbol", "days", "buys", "sells", "held_days"], ["log_return"], 4)


# -- scalar rules on dates and text --------------------------------------


@query(
    "scl_weekday",
    """SELECT CAST(d AS DATE) AS day, isodow(d) < 6 AS trading_day,
  CAST(CASE isodow(d) WHEN 1 THEN d - INTERVAL 3 DAY WHEN 7 THEN d - INTERVAL 2 DAY ELSE d - INTERVAL 1 DAY END AS DATE)
    AS previous_day
FROM (SELECT unnest(generate_series(min(l_shipdate), max(l_shipdate), INTERVAL 1 DAY)) AS d FROM lineitem)""",
    dates="day previous_day",
)
def scl_weekday(spark, sf):
    span = t.table(spark, sf, "lineitem").agg(
        F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi")
    )
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.select(
        "day",
        rules.is_trading_day("day").alias("trading_day"),
        rules.previous_trading_day("day").alias("previous_day"),
    )


@query(
    "scl_rebaldate",
    _brand("""SELECT date, isodow(date) = 5 AS weekly, date = last_day(date) AS monthly, true AS daily
FROM (SELECT DISTINCT date FROM bars_brand)"""),
    dates="date",
)
def scl_rebaldate(spark, sf):
    d = t.table(spark, sf, "lineitem").where("l_quantity > 0").select(F.col("l_shipdate").cast("date").alias("date"))
    return d.distinct().select(
        "date",
        *[rules.is_label_rebalance_day("date", f).alias(f) for f in ("weekly", "monthly", "daily")],
    )


_CODE = "lpad(CAST((l_partkey * 7919 + l_suppkey * 104729) % 1000000 AS VARCHAR), 6, '0')"
_BOARD = """CASE WHEN starts_with(symbol, '00') THEN 'main_board' WHEN starts_with(symbol, '30') THEN 'chinext'
  WHEN starts_with(symbol, '68') THEN 'star_market' WHEN starts_with(symbol, '6') THEN 'main_board'
  WHEN starts_with(symbol, '8') OR starts_with(symbol, '4') THEN 'beijing_stock' ELSE 'main_board' END"""
_STATUS = """CASE WHEN contains(symbol, '*ST') THEN 'star_st' WHEN starts_with(symbol, 'ST') THEN 'st' ELSE 'normal' END"""
_LIMIT = """CAST(CASE WHEN is_new THEN 0.44 WHEN status IN ('st', 'star_st') THEN 0.05
  WHEN market_type = 'star_market' THEN 0.2 WHEN market_type = 'beijing_stock' THEN 0.3 ELSE 0.1 END AS DOUBLE)"""
_CODES_SQL = f"""codes AS (SELECT CASE WHEN l_partkey % 11 = 0 THEN 'ST' || c WHEN l_partkey % 13 = 0 THEN '*ST' || c
   ELSE c END AS symbol, CAST(min(l_shipdate) AS DATE) AS listed, CAST(max(l_shipdate) AS DATE) AS seen
  FROM (SELECT *, {_CODE} AS c FROM lineitem) GROUP BY 1)"""


def _codes(spark, sf):
    """Six-digit codes over all boards, some with an ST mark, with first and last day."""
    li = t.table(spark, sf, "lineitem")
    c = F.lpad(((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 1000000).cast("string"), 6, "0")
    symbol = (
        F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("ST"), c))
        .when(F.col("l_partkey") % 13 == 0, F.concat(F.lit("*ST"), c))
        .otherwise(c)
    )
    return li.groupBy(symbol.alias("symbol")).agg(
        F.min("l_shipdate").cast("date").alias("listed"), F.max("l_shipdate").cast("date").alias("seen")
    )


@query("scl_market", f"WITH {_CODES_SQL} SELECT symbol, {_BOARD} AS market_type FROM codes")
def scl_market(spark, sf):
    return _codes(spark, sf).select("symbol", rules.market_type("symbol").alias("market_type"))


@query("scl_status", f"WITH {_CODES_SQL} SELECT symbol, {_STATUS} AS status FROM codes")
def scl_status(spark, sf):
    return _codes(spark, sf).select("symbol", rules.stock_status("symbol").alias("status"))


@query("scl_newstock", f"WITH {_CODES_SQL} SELECT symbol, seen - listed <= 30 AS is_new FROM codes")
def scl_newstock(spark, sf):
    return _codes(spark, sf).select("symbol", rules.is_new_stock("seen", "listed").alias("is_new"))


@query(
    "scl_limitratio",
    f"""WITH {_CODES_SQL} SELECT *, {_LIMIT} AS limit_ratio FROM
(SELECT symbol, {_BOARD} AS market_type, {_STATUS} AS status, seen - listed <= 30 AS is_new FROM codes)""",
)
def scl_limitratio(spark, sf):
    df = _codes(spark, sf).select(
        "symbol",
        rules.market_type("symbol").alias("market_type"),
        rules.stock_status("symbol").alias("status"),
        rules.is_new_stock("seen", "listed").alias("is_new"),
    )
    return df.withColumn("limit_ratio", rules.limit_ratio("market_type", "status", F.col("is_new")))


@query(
    "scl_date",
    """SELECT o_orderkey, txt, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS txt FROM orders)""",
    dates="day",
)
def scl_date(spark, sf):
    o = t.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 2, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("txt"),
    )
    return o.withColumn("day", rules.normalize_date("txt"))


@query("flt_symvalid", f"WITH {_CODES_SQL} SELECT symbol FROM codes WHERE regexp_full_match(symbol, '[0-9]{{6}}')")
def flt_symvalid(spark, sf):
    return _codes(spark, sf).where(rules.valid_symbol("symbol")).select("symbol")
