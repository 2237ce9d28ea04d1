"""Cleaning and quality checks of bars (PRE_*, CHK_*, PRJ_*).

Every check is one aggregation per symbol of conditional counts, so the whole
universe is checked in one pass with map-side combining.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import all_of, by_date, div, finite
from .indicators import ffill, strict_avg

PRICES = ("open", "high", "low", "close")
REQUIRED = ("open", "high", "low", "close", "volume")

# Alternative column names accepted on input.
ALIASES = {
    "trade_date": "date", "open_price": "open", "high_price": "high", "low_price": "low", "close_price": "close",
    "vol": "volume", "turnover": "amount", "adj_factor": "adjust_factor", "stock_code": "symbol", "code": "symbol",
}

_FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def rename_aliases(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    aliases = aliases or ALIASES
    have = set(df.columns)
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in have and b not in have})


def numeric_columns(df: DataFrame, exclude=("symbol", "name", "date", "year")) -> list[str]:
    numeric = {"byte", "tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c not in exclude]


def coerce_numeric(df: DataFrame, cols=REQUIRED, drop: bool = True) -> DataFrame:
    """Text or numbers to double; what cannot be read becomes NULL and drops the row."""
    df = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in cols})
    return df.dropna(subset=list(cols)) if drop else df


def keep_last(df: DataFrame, keys, order, cols=None) -> DataFrame:
    """One row per key: the one with the highest `order` (SET_DEDUPE).

    An aggregate, so copies of a key collapse before the shuffle. With
    fixed-width columns it is a hash aggregate of one pick per column (all
    picks see the same rows in the same order, so they agree on the row);
    otherwise the row is picked as a whole.
    """
    cols = cols or [c for c in df.columns if c not in keys]
    types = dict(df.dtypes)
    if all(types[c] in _FIXED_WIDTH for c in cols):
        return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in cols])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def clean(bars: DataFrame, order="seq") -> DataFrame:
    """Drop empty rows, unreadable and non-positive prices to NULL, last row per date."""
    value_cols = [c for c in (*REQUIRED, "amount") if c in bars.columns]
    df = bars.dropna(how="all")
    fixed = {c: finite(c) for c in value_cols}
    for c in PRICES:
        fixed[c] = F.when(fixed[c] > 0, fixed[c])
    return keep_last(df.withColumns(fixed), ["symbol", "date"], order)


def preprocess(bars: DataFrame, order="seq") -> DataFrame:
    """Last row per date, gaps filled over at most 3 rows, returns and short averages."""
    df = keep_last(bars, ["symbol", "date"], order)
    df = ffill(df, REQUIRED, limit=3)
    prev = F.lag("close").over(by_date())
    ratio = div("close", prev)
    return df.withColumns(
        {
            "returns": ratio - 1,
            "log_returns": F.when(ratio > 0, F.log(ratio)),
            "sma_5": strict_avg("close", 5),
            "sma_20": strict_avg("close", 20),
        }
    )


def _ohlc_broken() -> Column:
    h, l, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    return (h < l) | (h < o) | (h < c) | (l > o) | (l > c)


def _any(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


def price_logic_ok(max_price: float = 10000.0) -> Column:
    """Aggregate: prices in (0, max], high not under low, open and close between them."""
    outside = F.lit(False)
    for c in PRICES:
        outside = outside | F.coalesce((F.col(c) <= 0) | (F.col(c) > max_price), F.lit(False))
    return ~_any(outside | F.coalesce(_ohlc_broken(), F.lit(False)))


def date_logic_ok(now: Column) -> Column:
    """Aggregate: no repeated date, none before 1990 or after tomorrow."""
    return (
        (F.count("date") == F.count_distinct("date"))
        & (F.min("date") >= F.lit(dt.date(1990, 1, 1)))
        & (F.max("date") <= F.date_add(now, 1))
    )


def check_bars(bars: DataFrame, max_null_ratio: float = 0.1, now: Column | None = None) -> DataFrame:
    """Per symbol: required columns there and numbers, few missing values, sound prices and dates.

    Without its columns a frame fails as a whole; the other checks are then null.
    """
    now = F.current_date() if now is None else now
    n = F.count(F.lit(1))
    if not check_schema(frame_types(bars)).isEmpty():
        unknown = [F.lit(None).cast("boolean").alias(c) for c in ("nulls_ok", "price_ok", "dates_ok")]
        return bars.groupBy("symbol").agg(n.alias("rows")).select("symbol", "rows", F.lit(False).alias("columns_ok"), *unknown, F.lit(False).alias("is_valid"))
    nulls_ok = all_of([(n - F.count(c)) / n <= max_null_ratio for c in ("date", *REQUIRED)])
    return bars.groupBy("symbol").agg(
        n.alias("rows"),
        F.lit(True).alias("columns_ok"),
        nulls_ok.alias("nulls_ok"),
        price_logic_ok().alias("price_ok"),
        date_logic_ok(now).alias("dates_ok"),
        (nulls_ok & price_logic_ok() & date_logic_ok(now)).alias("is_valid"),
    )


def quality_summary(bars: DataFrame) -> DataFrame:
    """Counts, null ratios, date range, close statistics and the list of issues.

    All rows count: with an infinite close the mean is infinite and the deviation null.
    """
    n = F.count(F.lit(1))
    cols = ("date", *REQUIRED)
    a = bars.groupBy("symbol").agg(
        n.alias("total_records"),
        *[(n - F.count(c)).alias(f"{c}_nulls") for c in cols],
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        F.avg("close").alias("close_mean"),
        F.min("close").alias("close_min"),
        F.max("close").alias("close_max"),
        F.nanvl(F.stddev_samp("close"), F.lit(None).cast("double")).alias("close_std"),
    )
    issue = [
        F.when(
            F.col(f"{c}_nulls") > 0,
            F.concat(F.lit(f"{c}: "), F.col(f"{c}_nulls").cast("string"), F.lit(" missing")),
        )
        for c in cols
    ]
    a = a.withColumn("issues", F.array_compact(F.array(*issue)))
    return a.withColumn("is_valid", F.size("issues") == 0)


def enough(bars: DataFrame, min_rows: int = 30) -> DataFrame:
    """Bars of the symbols that have at least `min_rows` rows."""
    ok = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return bars.join(ok.select("symbol"), "symbol", "left_semi")


def check_panel(bars: DataFrame, start: dt.date, end: dt.date, min_rows: int = 30, tolerance_days: int = 30) -> DataFrame:
    """Per symbol the first failing reason, NULL when the symbol is usable."""
    s, e = F.lit(start), F.lit(end)
    a = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *[_any(F.col(c) <= 0).alias(f"_{c}") for c in PRICES],
        _any(_ohlc_broken()).alias("_ohlc"),
        _any(F.col("volume") < 0).alias("_vol"),
    )
    reason = (
        F.when(F.col("rows") < min_rows, "too few rows")
        .when(F.col("first_date") > F.date_add(s, tolerance_days), "starts too late")
        .when(F.col("last_date") < F.date_sub(e, tolerance_days), "ends too early")
    )
    for c in PRICES:
        reason = reason.when(F.col(f"_{c}"), f"{c} not positive")
    reason = reason.when(F.col("_ohlc"), "inconsistent OHLC").when(F.col("_vol"), "negative volume")
    return a.select("symbol", "rows", "first_date", "last_date", reason.alias("reason"))


def load_panel(bars: DataFrame, symbols: DataFrame, start: dt.date, end: dt.date, order="seq") -> DataFrame:
    """Requested universe, checked and preprocessed; bad and missing symbols drop out (SRC_PANEL)."""
    picked = bars.where(F.col("date").between(start, end)).join(symbols, "symbol", "left_semi")
    good = check_panel(picked, start, end).where("reason IS NULL").select("symbol")
    return preprocess(picked.join(good, "symbol", "left_semi"), order)


def check_rows(bars: DataFrame) -> DataFrame:
    """Row rule: high is the largest price, low the smallest, no negative volume or amount."""
    p = [F.col(c) for c in PRICES]
    ok = (
        (F.col("high") == F.greatest(*p))
        & (F.col("low") == F.least(*p))
        & (F.coalesce("volume", F.lit(0.0)) >= 0)
        & (F.coalesce("amount", F.lit(0.0)) >= 0)
    )
    return bars.withColumn("row_ok", F.coalesce(ok, F.lit(False)))


NUMERIC = ("tinyint", "smallint", "int", "bigint", "int8", "int16", "int32", "int64", "float", "double", "decimal")


def check_schema(types: DataFrame, required=("date", *REQUIRED), numeric=REQUIRED) -> DataFrame:
    """Rows (file, column, reason) for what is wrong with (file, column, type): columns that lack, columns that are not numbers."""
    files = types.groupBy("file").agg(F.collect_set("column").alias("has"))
    lacking = F.explode(F.array_except(F.array(*[F.lit(c) for c in required]), "has"))
    missing = files.select("file", lacking.alias("column"), F.lit("missing column").alias("reason"))
    kind = F.regexp_extract(F.lower("type"), "^[a-z0-9]+", 0)
    wrong = types.where(F.col("column").isin(*numeric) & ~(kind.isin(*NUMERIC) | kind.startswith("decimal")))
    return missing.unionByName(wrong.select("file", "column", F.concat(F.lit("not a number: "), "type").alias("reason")))


def frame_types(df: DataFrame, name: str = "frame") -> DataFrame:
    """(file, column, type) of a frame, for `check_schema`."""
    return df.sparkSession.createDataFrame([(name, c, t) for c, t in df.dtypes], "file string, column string, type string")


def check_file(bars: DataFrame) -> DataFrame:
    """One row for a written set: not empty, prices positive, high at or above low."""
    bad_price = F.lit(False)
    for c in PRICES:
        bad_price = bad_price | F.coalesce(F.col(c) <= 0, F.lit(False))
    return bars.agg(
        F.count(F.lit(1)).alias("rows"),
        (
            (F.count(F.lit(1)) > 0) & ~_any(bad_price) & ~_any(F.col("high") < F.col("low"))
        ).alias("ok"),
    )


def quality_report(bars: DataFrame, max_price: float = 10000.0) -> DataFrame:
    """Counts of missing, abnormal and repeated rows, and the share of sound rows."""
    missing = F.lit(False)
    abnormal = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    for c in PRICES:
        abnormal = abnormal | F.coalesce((F.col(c) <= 0) | (F.col(c) > max_price), F.lit(False))
    abnormal = abnormal | F.coalesce(F.col("high") < F.col("low"), F.lit(False))
    n = F.count(F.lit(1))
    return bars.groupBy("symbol").agg(
        n.alias("total"),
        F.count_if(~missing & ~abnormal).alias("valid"),
        F.count_if(missing).alias("missing"),
        F.count_if(abnormal).alias("abnormal_price"),
        (n - F.count_distinct("date")).alias("duplicate_dates"),
        (F.count_if(~missing & ~abnormal) / n).alias("score"),
    )


def check_training(df: DataFrame, min_rows: int = 100) -> DataFrame:
    """One row: enough rows, numeric columns there, share of NULLs over all cells."""
    cols = df.columns
    nulls = F.lit(0)
    for c in cols:
        nulls = nulls + F.col(c).isNull().cast("int")
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("rows"),
        (n >= min_rows).alias("enough_rows"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        (F.sum(nulls) / (n * len(cols))).alias("null_ratio"),
    ).withColumn("too_many_nulls", F.col("null_ratio") > 0.5)


def check_stale(bars: DataFrame, as_of, max_days: int = 7) -> DataFrame:
    a = bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    age = F.datediff(F.lit(as_of), "last_date")
    stale = age > max_days
    return a.select(
        "symbol",
        "last_date",
        stale.alias("stale"),
        F.when(stale, f"no update for more than {max_days} days").alias("issue"),
        F.when(stale, "run a data sync").alias("recommendation"),
    )


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date")).withColumn(
        "total_days", F.datediff("end_date", "start_date")
    )
