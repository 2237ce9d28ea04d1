"""Covariance and correlation between symbols (AGG_COVAR, AGG_EXPRET, JN_COV_SELF, MET_CORRMATRIX).

Pairs of rows are never formed. The returns of a symbol become one row, which
the calendar bounds. Two blocks of such rows meet in one group and matrix
products there give the pairs, a strip at a time. A row is sent once to every
block, not joined with every other symbol. A block has about `BLOCK` symbols;
from `BLOCKS` blocks on their size grows instead of their number, so that what is
shuffled grows as the rows do, until a block would have more than `CELLS` returns,
which bounds a group's memory for any universe. A covariance of
windows may also stay in factored form, as the windows themselves.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PAIRS = "sym_i string, sym_j string, n double, cov double"
#: Symbols of a block, rows of a strip of pairs, groups wanted where blocks are few.
BLOCK, STRIP, GROUPS = 512, 64, 64
#: Blocks from which on they get larger, returns of a block and pairs of a strip at most.
BLOCKS, CELLS, PAIRS_OF_STRIP = 16, 1 << 21, 1 << 18
EPOCH = dt.date(1970, 1, 1)

#: (as_of, first day, last day), days counted from 1970.
Frame = tuple[dt.date | None, int, int]


def _moments(table: pa.Table, bi: int, bj: int) -> dict[str, np.ndarray | pa.Array]:
    """Moments of the pairs of block `bi` with block `bj` in one matrix product each."""
    dates = table["date"].combine_chunks().dictionary_encode()
    symbols = table["symbol"].combine_chunks().dictionary_encode()
    t, s = dates.indices.to_numpy(), symbols.indices.to_numpy()
    names = symbols.dictionary
    order = np.argsort(np.asarray(names.to_pylist(), dtype=object))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    s, names = rank[s], names.take(pa.array(order))
    block = np.zeros(len(names), dtype=np.int64)
    block[s] = table["_b"].to_numpy()
    x = np.full((len(dates.dictionary), len(names)), np.nan)
    x[t, s] = table["ret"].to_numpy()
    have = ~np.isnan(x)
    x0, m = np.where(have, x, 0.0), have.astype(float)
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    xl, xr, ml, mr = x0[:, left], x0[:, right], m[:, left], m[:, right]
    i, j = np.meshgrid(left, right, indexing="ij")
    keep = (i <= j) if bi == bj else np.ones_like(i, dtype=bool)
    a, b = i[keep], j[keep]
    swap = a > b
    si, sj = (xl.T @ mr)[keep], (ml.T @ xr)[keep]
    sii, sjj = ((xl * xl).T @ mr)[keep], (ml.T @ (xr * xr))[keep]
    return {
        "sym_i": names.take(pa.array(np.where(swap, b, a))),
        "sym_j": names.take(pa.array(np.where(swap, a, b))),
        "n": (ml.T @ mr)[keep],
        "si": np.where(swap, sj, si),
        "sj": np.where(swap, si, sj),
        "sij": (xl.T @ xr)[keep],
        "sii": np.where(swap, sjj, sii),
        "sjj": np.where(swap, sii, sjj),
    }


def pair_moments(returns: DataFrame, chunk: list[str], blocks: int = 1) -> DataFrame:
    """Covariance of every pair of symbols per chunk, from rows.

    `returns` has date, symbol, ret and the chunk columns; a chunk must hold a
    bounded number of dates and symbols.
    """
    b = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    df = returns.where("ret IS NOT NULL").select(*chunk, "date", "symbol", "ret", b.alias("_b"))
    # a row of block b meets every block o once, in group (min, max) of the two
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    df = df.withColumns({"_bi": F.least("_b", "_o"), "_bj": F.greatest("_b", "_o")}).drop("_o")
    types = dict(returns.dtypes)
    schema = ", ".join([*[f"_k{i} {types[c]}" for i, c in enumerate(chunk)], PAIRS])
    width = len(chunk)

    def run(keys, table):
        *head, bi, bj = keys
        v = _moments(table, bi.as_py(), bj.as_py())
        n = v["n"]
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (v["sij"] - v["si"] * v["sj"] / n) / (n - 1)
        v = {"sym_i": v["sym_i"], "sym_j": v["sym_j"], "n": n, "cov": pa.array(c, mask=n < 2)}
        size = len(v["n"])
        cols = {f"_k{i}": pa.array([head[i].as_py()], head[i].type).take(pa.array(np.zeros(size, np.int64))) for i in range(width)}
        return pa.table({**cols, **v})

    out = df.groupBy(*chunk, "_bi", "_bj").applyInArrow(run, schema)
    return out.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(chunk)})


def series(returns: DataFrame) -> DataFrame:
    """(symbol, days, rets): one row per symbol, days (from 1970) ascending; written once."""
    at = F.struct(F.unix_date(F.col("date").cast("date")).alias("day"), F.col("ret").cast("double").alias("ret"))
    rows = returns.where("ret IS NOT NULL AND NOT isnan(ret)").groupBy("symbol").agg(F.sort_array(F.collect_list(at)).alias("at"))
    return cut_lineage(rows.select("symbol", F.col("at.day").alias("days"), F.col("at.ret").alias("rets")), "series")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the values of a list column."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def dense(days: pa.Array, rets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(days of the columns, matrix with NaN where a row has no return that day)."""
    offsets, day = _flat(days)
    _, ret = _flat(rets)
    cols, at = np.unique(day, return_inverse=True)
    x = np.full((len(days), len(cols)), np.nan)
    x[np.repeat(np.arange(len(days)), np.diff(offsets)), at] = ret
    return cols, x


def _strips(names: pa.Array, block: np.ndarray, x: np.ndarray, bi: int, bj: int) -> Iterator[dict[str, np.ndarray | pa.Array]]:
    """Pairs of block `bi` with block `bj` that share a date; rows of `x` are sorted by name."""
    some = ~np.isnan(x).all(axis=1)
    left, right = np.flatnonzero((block == bi) & some), np.flatnonzero((block == bj) & some)
    have = ~np.isnan(x)
    x, m = np.where(have, x, 0.0), have.astype(float)
    xr, mr = x[right].T, m[right].T
    step = max(min(STRIP, PAIRS_OF_STRIP // max(len(right), 1)), 1)
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        xl, ml = x[rows], m[rows]
        n = ml @ mr
        keep = n > 0
        if bi == bj:
            keep &= rows[:, None] <= right[None, :]
        i, j = np.nonzero(keep)
        n, si, sj, sij = n[keep], (xl @ mr)[keep], (ml @ xr)[keep], (xl @ xr)[keep]
        vi, vj = ((xl * xl) @ mr)[keep] - si * si / n, (ml @ (xr * xr))[keep] - sj * sj / n
        with np.errstate(divide="ignore", invalid="ignore"):
            both = sij - si * sj / n
            cov, corr = both / (n - 1), both / np.sqrt(vi * vj)
        a, b = rows[i], right[j]
        yield {
            "sym_i": names.take(pa.array(np.minimum(a, b))),
            "sym_j": names.take(pa.array(np.maximum(a, b))),
            "n": n.astype(np.int64),
            "cov": pa.array(cov, mask=n < 2),
            "corr": pa.array(corr, mask=(n < 2) | ~(vi > 0) | ~(vj > 0)),
        }


def framed_pairs(rows: DataFrame, frames: list[Frame], blocks: int = 1) -> DataFrame:
    """(as_of, sym_i, sym_j, n, cov, corr) of every pair with a common date in a frame; `rows` as from `series`.

    `blocks` is raised so that a block has about `BLOCK` symbols, beyond `BLOCKS`
    only as far as its returns take. Where that leaves few groups, the frames
    are dealt over groups as well.
    """
    symbols, days = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("days")), F.lit(0))).first()
    blocks = max(blocks, min(math.ceil(symbols / BLOCK), BLOCKS), math.ceil(symbols * days / CELLS))
    slices = min(max(len(frames), 1), math.ceil(GROUPS / (blocks * (blocks + 1) // 2)))

    def every(size: int):
        return F.explode(F.sequence(F.lit(0), F.lit(size - 1)))

    # a row of block b meets every block o once, in group (min, max) of the two
    df = rows.withColumn("b", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")).withColumn("o", every(blocks))
    df = df.withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o")}).drop("o").withColumn("part", every(slices))

    def run(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bi, bj = (k.as_py() for k in keys)
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        names = table["symbol"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        table = table.take(pa.array(order)).combine_chunks()
        names, block = table["symbol"].chunk(0), table["b"].to_numpy()
        days, x = dense(table["days"].chunk(0), table["rets"].chunk(0))
        for as_of, first, last in frames[part::slices]:
            lo, hi = np.searchsorted(days, first, "left"), np.searchsorted(days, last, "right")
            for v in _strips(names, block, x[:, lo:hi], bi, bj) if lo < hi else ():
                v = {"as_of": pa.array([as_of], pa.date32()).take(pa.array(np.zeros(len(v["n"]), np.int64))), **v}
                yield pa.RecordBatch.from_pydict(v)

    schema = "as_of date, sym_i string, sym_j string, n long, cov double, corr double"
    return df.groupBy("part", "bi", "bj").applyInArrow(run, schema)


def pairwise(returns: DataFrame, blocks: int = 1) -> DataFrame:
    """Covariance and correlation over the whole history, pairs with sym_i <= sym_j that share a date."""
    whole = (None, -(2**31), 2**31 - 1)
    return framed_pairs(series(returns), [whole], blocks).drop("as_of")


def windows(rows: DataFrame, frames: list[Frame], values: bool = True) -> DataFrame:
    """(as_of, symbol, mu) of each frame, with `values` also its days and rets; `rows` as from `series`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (offsets, day), (_, ret) = _flat(batch.column(1)), _flat(batch.column(2))
            row = np.arange(batch.num_rows, dtype=np.int64) << 33
            place = np.repeat(row, np.diff(offsets)) + day
            for as_of, first, last in frames:
                lo, hi = np.searchsorted(place, row + first, "left"), np.searchsorted(place, row + last, "right")
                kept = np.flatnonzero(hi > lo)
                if not len(kept):
                    continue
                size = (hi - lo)[kept]
                starts = np.append(0, np.cumsum(size))
                at = np.repeat(lo[kept] - starts[:-1], size) + np.arange(starts[-1])
                cols = {
                    "as_of": pa.array([as_of], pa.date32()).take(pa.array(np.zeros(len(kept), np.int64))),
                    "symbol": batch.column(0).take(pa.array(kept)),
                    "mu": np.add.reduceat(ret[at], starts[:-1]) / size,
                }
                if values:
                    ends = pa.array(starts.astype(np.int32))
                    cols |= {c: pa.ListArray.from_arrays(ends, pa.array(v[at])) for c, v in (("days", day), ("rets", ret))}
                yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(cut, "as_of date, symbol string, mu double" + (", days array<int>, rets array<double>" if values else ""))


def asof_frames(returns: DataFrame, as_of: DataFrame, window: int = 60) -> DataFrame:
    """Attach to each as_of date its last `window` return dates.

    Works on the table of distinct dates, which the calendar bounds.
    """
    dates = returns.where("ret IS NOT NULL").select("date").distinct()
    ordered = dates.withColumn("_ord", F.row_number().over(Window.orderBy("date")))
    # an as_of date that is no return date sees the dates before it
    marks = as_of.select(F.col("as_of").alias("date"), F.lit(True).alias("_asof")).distinct()
    both = ordered.join(marks, "date", "full_outer").withColumn(
        "_last", F.max("_ord").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    )
    frames = both.where("_asof AND _last IS NOT NULL").select(
        F.col("date").alias("as_of"),
        F.explode(F.sequence(F.greatest(F.col("_last") - (window - 1), F.lit(1)), F.col("_last"))).alias("_ord"),
    )
    return frames.join(ordered, "_ord").drop("_ord")


def asof_moments(
    returns: DataFrame, as_of: DataFrame, window: int = 60, blocks: int = 1, held: DataFrame | None = None, factored: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(cov(as_of, sym_i, sym_j, cov), mu(as_of, symbol, mu)) of the last `window` dates.

    `held` (as_of, symbol) names the symbols wanted on each date; no other pair is formed.
    `factored` leaves the covariance as the windows it is made of (as_of, symbol, days, rets):
    the optimizer multiplies with those, and no pair of symbols is formed.
    """
    frames = asof_frames(returns, as_of, window)
    if held is not None:
        framed = returns.select("date", "symbol", "ret").join(frames, "date")
        framed = framed.join(held.select("as_of", "symbol").distinct(), ["as_of", "symbol"], "left_semi")
        pairs = pair_moments(framed, ["as_of"], blocks)
        mu = framed.groupBy("as_of", "symbol").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("mu"))
    else:
        # one row per as_of date, bounded by the calendar
        spans = frames.groupBy("as_of").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).orderBy("as_of").collect()
        spans = [(r.as_of, (r.lo - EPOCH).days, (r.hi - EPOCH).days) for r in spans]
        rows = series(returns)
        mu = windows(rows, spans, values=False)
        if factored:
            return windows(rows, spans).drop("mu"), mu
        pairs = framed_pairs(rows, spans, blocks)
    cov = pairs.select("as_of", "sym_i", "sym_j", F.coalesce("cov", F.lit(0.0)).alias("cov"))
    diag = F.col("sym_i") == F.col("sym_j")
    return cov.withColumn("cov", F.when(diag & (F.col("cov") <= 0), 1e-4).otherwise(F.col("cov"))), mu


def portfolio_kpi(weights: DataFrame, mu: DataFrame, cov: DataFrame) -> DataFrame:
    """Expected return, volatility sqrt(w'Cw) and their ratio per as_of date.

    `cov` holds one triangle; a pair off the diagonal counts twice.
    """
    w = weights.select("as_of", "symbol", "weight").where("weight != 0")
    ret = w.join(mu, ["as_of", "symbol"]).groupBy("as_of").agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"))
    wi = w.select("as_of", F.col("symbol").alias("sym_i"), F.col("weight").alias("_wi"))
    wj = w.select("as_of", F.col("symbol").alias("sym_j"), F.col("weight").alias("_wj"))
    twice = F.when(F.col("sym_i") == F.col("sym_j"), 1.0).otherwise(2.0)
    var = (
        cov.join(wi, ["as_of", "sym_i"])
        .join(wj, ["as_of", "sym_j"])
        .groupBy("as_of")
        .agg(F.sum(F.col("_wi") * F.col("_wj") * F.col("cov") * twice).alias("_v"))
    )
    n = w.groupBy("as_of").agg(F.count_if(F.col("weight") > 0).alias("n_positions"))
    vol = F.sqrt(F.greatest(F.col("_v"), F.lit(0.0)))
    return ret.join(var, "as_of").join(n, "as_of").select(
        "as_of",
        "n_positions",
        "expected_return",
        vol.alias("volatility"),
        F.when(vol > 0, F.col("expected_return") / vol).otherwise(0.0).alias("sharpe_ratio"),
    )
