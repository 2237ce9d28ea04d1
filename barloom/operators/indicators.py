"""Technical indicators (WIN_*).

Input is bars(symbol, date, open, high, low, close, volume), at most one row
per symbol and date. All indicators share the partitioning by symbol, so any
mix of them costs one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import by_date, div, running, trailing

MA_WINDOWS = (5, 10, 20, 30, 60)
EMA_WINDOWS = (12, 26)
RSI_WINDOWS = (14, 6)
VOLUME_WINDOWS = (5, 10)
ALL_FAMILIES = ("ma", "ema", "rsi", "macd", "boll", "kdj", "williams", "volume_ma")


def strict_avg(c, n: int, *keys: str) -> Column:
    """Mean over the last n rows, NULL until n values are there."""
    c = F.col(c) if isinstance(c, str) else c
    w = trailing(n, *keys)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def _apply(df: DataFrame, *families: list[dict]) -> DataFrame:
    """Add the columns of several families, level by level.

    A family is a list of levels; a level reads only earlier ones. All windows
    of one level go into one projection, so Spark evaluates them in one pass
    over one sort, whatever the number of families. Columns starting with an
    underscore are dropped at the end.
    """
    for i in range(max(len(f) for f in families)):
        level = {}
        for f in families:
            if i < len(f):
                level.update(f[i])
        df = df.withColumns(level)
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _ma(windows=MA_WINDOWS) -> list[dict]:
    every = by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.count(F.lit(1)).over(every)
    raw = {f"_ma_{n}": F.avg("close").over(trailing(n)) for n in windows}
    mas = {f"ma_{n}": F.when(F.col("_size") > n, F.col(f"_ma_{n}")) for n in windows}
    return [{"_size": size, **raw}, mas, {f"close_ma_{n}_ratio": div("close", f"ma_{n}") for n in windows}]


def ma(bars: DataFrame, windows=MA_WINDOWS) -> DataFrame:
    """Moving averages and close/MA ratios.

    A window not shorter than the history gives NULL columns.
    """
    return _apply(bars, _ma(windows))


def ma_strict(bars: DataFrame, windows=MA_WINDOWS) -> DataFrame:
    return bars.withColumns({f"ma_{n}": strict_avg("close", n) for n in windows})


def _rates(spans) -> list[float]:
    return [-math.log(1 - 2 / (n + 1)) for n in spans if n > 1]


def _block_rows(spans) -> int:
    """Block length at which two blocks back no longer matter."""
    return max(2, math.ceil(38 / min(_rates(spans), default=38)))


def _span_groups(spans) -> list[list[int]]:
    """Spans that can share a block length without their weights overflowing."""
    groups: list[list[int]] = []
    for n in sorted(set(spans), reverse=True):
        for g in groups:
            both = [*g, n]
            if _block_rows(both) * max(_rates(both), default=0) <= 650:
                g.append(n)
                break
        else:
            groups.append([n])
    return groups


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Row number `_i` of each row of a series."""
    return df.withColumn("_i", F.row_number().over(by_date(key)) - 1)


def _ewm_blocks(df: DataFrame, inputs: dict[str, tuple[Column, int]], key: str) -> DataFrame:
    """The means of `inputs`, one pass per group of spans; `_b` is a row's block, `_k` its place in it."""
    for spans in _span_groups(n for _, n in inputs.values()):
        block = _block_rows(spans)
        df = df.withColumns({"_b": F.floor(F.col("_i") / block), "_k": F.col("_i") % block})
        df = _ewm_group(df, {o: x for o, x in inputs.items() if x[1] in spans}, block, key)
    return df


def _ewm_group(df: DataFrame, inputs: dict[str, tuple[Column, int]], block: int, key: str) -> DataFrame:
    inside = Window.partitionBy(key, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(key).orderBy("_b")
    one_back, two_back = blocks.rangeBetween(-1, -1), blocks.rangeBetween(-2, -2)
    local, out = {}, {}
    for o, (c, span) in inputs.items():
        d, a = 1 - 2 / (span + 1), 2 / (span + 1)
        if d <= 0:
            local[f"_l_{o}"] = c
            out[o] = F.col(f"_l_{o}")
            continue
        gain = F.when(F.col("_i") == 0, 1.0).otherwise(a)
        local[f"_l_{o}"] = F.pow(F.lit(d), F.col("_k")) * F.sum(
            gain * c * F.pow(F.lit(d), -F.col("_k"))
        ).over(inside)
        end = f"_l_{o}"
        carry = F.coalesce(F.max_by(end, "_i").over(one_back), F.lit(0.0)) + F.lit(d**block) * F.coalesce(
            F.max_by(end, "_i").over(two_back), F.lit(0.0)
        )
        out[o] = F.col(end) + F.pow(F.lit(d), F.col("_k") + 1) * carry
    return df.withColumns(local).withColumns(out)


def ewm(df: DataFrame, inputs: dict[str, tuple[Column, int]], key: str = "symbol") -> DataFrame:
    """Recursive exponential means `out = (value, span)`, seeded with the first value.

    ema_t = d * ema_{t-1} + a * x_t is unrolled into prefix sums over blocks of
    rows: inside a block the weights d^-k stay far from overflow, and across
    blocks only the ends of the two preceding blocks matter, because d^block
    is below the precision of a double. So a series of any length needs plain
    windows only, with no Python worker.
    """
    return _ewm_blocks(_numbered(df, key), inputs, key).select(*df.columns, *inputs)


def _means(bars: DataFrame, ema_windows=(), macd_periods: tuple[int, int, int] | None = None) -> DataFrame:
    """EMAs and MACD from one blocked pass; a span used twice is computed once."""
    fast, slow, signal = macd_periods or (0, 0, 0)
    spans = sorted({*ema_windows, *([fast, slow] if macd_periods else [])})
    keep = [*bars.columns, *[f"ema_{n}" for n in ema_windows]]
    df = _ewm_blocks(_numbered(bars, "symbol"), {f"ema_{n}": (F.col("close"), n) for n in spans}, "symbol")
    if macd_periods:
        df = df.withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
        df = _ewm_blocks(df, {"macd_signal": (F.col("macd"), signal)}, "symbol")
        df = df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
        keep += ["macd", "macd_signal", "macd_hist"]
    return df.select(*keep)


def ema(bars: DataFrame, windows=EMA_WINDOWS) -> DataFrame:
    return _means(bars, windows)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return _means(bars, (), (fast, slow, signal))


def rsi_from(gain: Column, loss: Column) -> Column:
    """100 where nothing was lost, NULL where nothing moved."""
    return F.when(
        loss == 0, F.when(gain == 0, F.lit(None).cast("double")).otherwise(F.lit(100.0))
    ).otherwise(100 - 100 / (1 + div(gain, loss)))


def _move_levels() -> list[dict]:
    """Gains and losses; the first row counts as no move."""
    chg = F.col("_chg")
    return [
        {"_chg": F.col("close") - F.lag("close").over(by_date())},
        {"_gain": F.when(chg > 0, chg).otherwise(0.0), "_loss": F.when(chg < 0, -chg).otherwise(0.0)},
    ]


def _rsi(windows=RSI_WINDOWS) -> list[dict]:
    avgs = {}
    for n in windows:
        avgs[f"_g{n}"] = F.avg("_gain").over(trailing(n))
        avgs[f"_l{n}"] = F.avg("_loss").over(trailing(n))
    return [*_move_levels(), avgs, {f"rsi_{n}": rsi_from(F.col(f"_g{n}"), F.col(f"_l{n}")) for n in windows}]


def rsi(bars: DataFrame, windows=RSI_WINDOWS) -> DataFrame:
    return _apply(bars, _rsi(windows))


def rsi_strict(bars: DataFrame, window: int = 14) -> DataFrame:
    avgs = {"_g": strict_avg("_gain", window), "_l": strict_avg("_loss", window)}
    return _apply(bars, [*_move_levels(), avgs, {f"rsi_{window}": rsi_from(F.col("_g"), F.col("_l"))}])


def rsi_full_changes(bars: DataFrame, window: int = 14) -> DataFrame:
    """RSI over exactly `window` changes; 100 whenever there was no loss."""
    w = trailing(window)
    avgs = {"_g": F.avg("_gain").over(w), "_l": F.avg("_loss").over(w), "_n": F.count("_chg").over(w)}
    value = F.when(F.col("_l") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + div("_g", "_l")))
    return _apply(bars, [*_move_levels(), avgs, {f"rsi_{window}": F.when(F.col("_n") == window, value)}])


def _boll(window: int = 20, std_dev: float = 2.0) -> list[dict]:
    w = trailing(window)
    span = F.col("boll_upper") - F.col("boll_lower")
    return [
        {"boll_middle": F.avg("close").over(w), "_sd": F.stddev_samp("close").over(w)},
        {
            "boll_upper": F.col("boll_middle") + std_dev * F.col("_sd"),
            "boll_lower": F.col("boll_middle") - std_dev * F.col("_sd"),
        },
        {
            "boll_width": div(span, "boll_middle"),
            "boll_position": div(F.col("close") - F.col("boll_lower"), span),
        },
    ]


def boll(bars: DataFrame, window: int = 20, std_dev: float = 2.0) -> DataFrame:
    return _apply(bars, _boll(window, std_dev))


def _kdj(k_period: int = 9, d_period: int = 3) -> list[dict]:
    return [
        {"_klo": F.min("low").over(trailing(k_period)), "_khi": F.max("high").over(trailing(k_period))},
        {"_rsv": div(F.col("close") - F.col("_klo"), F.col("_khi") - F.col("_klo")) * 100},
        {"kdj_k": F.avg("_rsv").over(trailing(d_period))},
        {"kdj_d": F.avg("kdj_k").over(trailing(d_period))},
        {"kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d")},
    ]


def kdj(bars: DataFrame, k_period: int = 9, d_period: int = 3) -> DataFrame:
    return _apply(bars, _kdj(k_period, d_period))


def _williams(window: int = 14) -> list[dict]:
    return [
        {"_whi": F.max("high").over(trailing(window)), "_wlo": F.min("low").over(trailing(window))},
        {"williams_r": div(F.col("_whi") - F.col("close"), F.col("_whi") - F.col("_wlo")) * -100},
    ]


def williams(bars: DataFrame, window: int = 14) -> DataFrame:
    return _apply(bars, _williams(window))


def _volume_ma(windows=VOLUME_WINDOWS) -> list[dict]:
    mas = {f"volume_ma_{n}": F.avg("volume").over(trailing(n)) for n in windows}
    return [mas, {"volume_ratio": div("volume", "volume_ma_5")} if 5 in windows else {}]


def volume_ma(bars: DataFrame, windows=VOLUME_WINDOWS) -> DataFrame:
    return _apply(bars, _volume_ma(windows))


_LEVELS = {"ma": _ma, "rsi": _rsi, "boll": _boll, "kdj": _kdj, "williams": _williams, "volume_ma": _volume_ma}


def all_indicators(bars: DataFrame, families=ALL_FAMILIES, **params) -> DataFrame:
    """Any subset of the families; `params` maps a family to its keyword arguments."""
    unknown = set(families) - set(ALL_FAMILIES)
    if unknown:
        raise ValueError(f"unknown indicators: {sorted(unknown)}")
    levels = [_LEVELS[f](**params.get(f, {})) for f in families if f in _LEVELS]
    out = _apply(bars, *levels) if levels else bars
    if "ema" in families or "macd" in families:
        ema_windows = params.get("ema", {}).get("windows", EMA_WINDOWS) if "ema" in families else ()
        p = {"fast": 12, "slow": 26, "signal": 9, **params.get("macd", {})}
        out = _means(out, ema_windows, (p["fast"], p["slow"], p["signal"]) if "macd" in families else None)
    return out


def returns(df: DataFrame, price: str = "close", key: str = "symbol") -> DataFrame:
    prev = F.lag(price).over(by_date(key))
    return df.withColumns({"returns": div(price, prev) - 1, "log_returns": F.log(div(price, prev))})


def ffill(df: DataFrame, cols, limit: int | None = None, key: str = "symbol") -> DataFrame:
    """Carry the last value forward, over at most `limit` rows in a gap."""
    w = running(key)
    if limit is None:
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    near = by_date(key).rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(near) for c in cols})


def lag_features(df: DataFrame, cols, lags=(1, 2, 3, 5), key: str = "symbol") -> DataFrame:
    w = by_date(key)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for k in lags for c in cols})


def ma_features(df: DataFrame, cols, windows=(5, 10, 20), key: str = "symbol") -> DataFrame:
    return df.withColumns({f"{c}_ma_{n}": F.avg(c).over(trailing(n, key)) for n in windows for c in cols})


def target(df: DataFrame, kind: str, horizon: int = 1, key: str = "symbol") -> DataFrame:
    """Forward-looking target: price, return, direction or volatility."""
    w = by_date(key)
    future = F.lead("close", horizon).over(w)
    if kind == "price":
        t = future
    elif kind == "return":
        t = div(future - F.col("close"), "close")
    elif kind == "direction":
        t = F.coalesce(future > F.col("close"), F.lit(False)).cast("int")
    elif kind == "volatility":
        df = df.withColumn("_r", div("close", F.lag("close").over(w)) - 1)
        ahead = w.rowsBetween(1, horizon)
        t = F.when(F.count("_r").over(ahead) == horizon, F.stddev_samp("_r").over(ahead))
        return df.withColumn("target", t).drop("_r")
    else:
        raise ValueError(kind)
    return df.withColumn("target", t)
