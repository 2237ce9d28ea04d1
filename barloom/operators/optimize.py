"""Portfolio optimization, one solve per portfolio date (OPT_GROUPED).

Means and covariances come from Spark aggregations. Each (as_of) group then
holds one problem, solved with NumPy by projected gradient. Given the windows of
returns instead of pairs, it multiplies with those and holds no matrix of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covariance import dense


@dataclass(frozen=True)
class OptimizerRules:
    method: str = "mean_variance"  # min_variance, max_sharpe, risk_parity, max_diversification
    lower: float = 0.0
    upper: float = 0.05
    industry_cap: float = 1.0
    max_turnover: float | None = None
    risk_aversion: float = 1.0
    iterations: int = 1000
    tolerance: float = 1e-6


def _to_box_simplex(v: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Nearest point with entries in [lo, hi] and sum 1 (bisection on the shift)."""
    n = len(v)
    if n * hi <= 1.0:
        return np.full(n, hi)
    if n * lo >= 1.0:
        return np.full(n, lo)
    a, b = v.min() - hi, v.max() - lo
    for _ in range(100):
        mid = (a + b) / 2
        if mid == a or mid == b:  # no number lies between
            break
        if np.minimum(np.maximum(v - mid, lo), hi).sum() > 1.0:
            a = mid
        else:
            b = mid
    return np.clip(v - (a + b) / 2, lo, hi)


def _project(v: np.ndarray, r: OptimizerRules, groups: list[np.ndarray]) -> np.ndarray:
    """Box-simplex, and industry caps by alternating corrections."""
    w = _to_box_simplex(v, r.lower, r.upper)
    for _ in range(50 if groups else 0):
        over = False
        for g in groups:
            excess = w[g].sum() - r.industry_cap
            if excess > 1e-10:
                w[g] -= excess / len(g)
                over = True
        if not over:
            break
        w = _to_box_simplex(w, r.lower, r.upper)
    return w


class WindowCovariance:
    """The covariance matrix of the rows of `x` (NaN: no return that day) by its products with vectors.

    Entries are as `asof_moments` defines them: over the days two rows share, 0
    with fewer than two, 1e-4 for a row that does not move. Rows with the same
    days form a pattern. Between two patterns every pair shares the same days,
    so a product needs one sum by day and pattern and the counts of patterns.
    """

    CACHED, STRIP = 1024, 256  # patterns whose counts are kept; patterns taken at once otherwise

    def __init__(self, x: np.ndarray):
        have = ~np.isnan(x)
        n = have.sum(axis=1)
        # a covariance does not change by the level of a row
        x = np.where(have, x - (np.where(have, x, 0.0).sum(axis=1) / np.maximum(n, 1))[:, None], 0.0)
        variance = np.where(n > 1, (x * x).sum(axis=1) / np.maximum(n - 1, 1), 0.0)
        self.diag = np.where(variance > 0, variance, 1e-4)
        self.raised = self.diag - variance
        packed, of = np.unique(np.packbits(have, axis=1), axis=0, return_inverse=True)
        self.order = np.argsort(of.ravel(), kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(of.ravel(), minlength=len(packed))))
        self.rows = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
        self.x = x[self.order]
        self.m = np.unpackbits(packed, axis=1, count=x.shape[1]).astype(float)
        self.cached = self._counts(slice(None)) if len(self.m) <= self.CACHED else None

    def _counts(self, some: slice) -> tuple[np.ndarray, np.ndarray]:
        n = self.m[some] @ self.m.T
        a = np.where(n > 1, 1 / np.maximum(n - 1, 1), 0.0)
        return a, a / np.maximum(n, 1)

    def diagonal(self) -> np.ndarray:
        return self.diag

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        ordered = w[self.order]
        y = np.stack([ordered[s] @ self.x[s] for s in self.rows])
        u = np.empty_like(y)
        step = len(self.m) if self.cached else self.STRIP
        for k in range(0, len(self.m), step):
            some = slice(k, k + step)
            a, b = self.cached or self._counts(some)
            u[some] = a @ y - (b * (self.m[some] @ y.T)) @ self.m
        out = np.empty(len(w))
        out[self.order] = np.concatenate([self.x[s] @ v for s, v in zip(self.rows, u)])
        return out + self.raised * w


def _objective(w: np.ndarray, mu: np.ndarray, c: np.ndarray | WindowCovariance, r: OptimizerRules) -> tuple[float, np.ndarray]:
    """Value to minimize and its gradient."""
    cw = c @ w
    var = max(float(w @ cw), 0.0)
    sd = np.sqrt(var)
    if r.method == "min_variance":
        return var, 2 * cw
    if r.method == "max_sharpe":
        d = sd + 1e-6
        ret = float(w @ mu)
        return -ret / d, -mu / d + ret / d**2 * cw / max(sd, 1e-12)
    if r.method == "risk_parity":
        d = sd + 1e-6
        gap = w * cw / d - var / len(w)
        dvar = 2 * cw
        grad = 2 * (gap * cw / d + c @ (gap * w) / d - (gap @ (w * cw)) / d**2 * cw / max(sd, 1e-12))
        return float(gap @ gap), grad - 2 * gap.sum() * dvar / len(w)
    if r.method == "max_diversification":
        vol = np.sqrt(c.diagonal())
        d = sd + 1e-6
        num = float(w @ vol)
        return -num / d, -vol / d + num / d**2 * cw / max(sd, 1e-12)
    return -(float(w @ mu) - r.risk_aversion * var), -(mu - 2 * r.risk_aversion * cw)


def solve(mu: np.ndarray, c: np.ndarray | WindowCovariance, r: OptimizerRules, industry=None, current=None) -> tuple[np.ndarray, float, float]:
    """Weights with the objective at the equal-weight start and at the end."""
    n = len(mu)
    groups = []
    if industry is not None and r.industry_cap < 1.0:
        groups = [np.flatnonzero(industry == g) for g in pd.unique(industry)]
    w = _project(np.full(n, 1.0 / n), r, groups)
    start, grad = _objective(w, mu, c, r)
    value, step = start, 1.0
    for _ in range(r.iterations):
        trial = _project(w - step * grad, r, groups)
        new, new_grad = _objective(trial, mu, c, r)
        if new > value - 1e-12:
            step *= 0.5
            if step < 1e-12:
                break
            continue
        done = value - new < r.tolerance * max(1e-9, abs(value)) * 1e-3
        w, value, grad, step = trial, new, new_grad, step * 1.5
        if done:
            break
    if current is not None and r.max_turnover is not None:
        moved = np.abs(w - current).sum()
        if moved > r.max_turnover:
            # stay on the line to the current weights, which keeps every convex limit
            w = current + (w - current) * (r.max_turnover / moved)
    return w, start, value


OUT = "as_of date, symbol string, weight double, feasible boolean, objective_start double, objective_end double"
ARROW_OUT = {"as_of": pa.date32(), "symbol": pa.string(), "weight": pa.float64(), "feasible": pa.bool_(),
             "objective_start": pa.float64(), "objective_end": pa.float64()}


def optimize(
    mu: DataFrame, cov: DataFrame, rules: OptimizerRules = OptimizerRules(), industry: DataFrame | None = None,
    current: DataFrame | None = None,
) -> DataFrame:
    """Solve per as_of date. `mu`(as_of, symbol, mu), `cov`(as_of, sym_i, sym_j, cov) upper triangle
    or, in factored form, the windows (as_of, symbol, days, rets): memory then grows with the assets, not with their pairs.

    `industry`(symbol, industry) and `current`(as_of, symbol, weight) are optional.
    """
    assets = mu
    if industry is not None:
        assets = assets.join(industry, "symbol", "left").fillna("Unknown", ["industry"])
    else:
        assets = assets.withColumn("industry", F.lit("Unknown"))
    if current is not None:
        assets = assets.join(current.select("as_of", "symbol", F.col("weight").alias("cur")), ["as_of", "symbol"], "left")
        assets = assets.fillna(0.0, ["cur"])
    else:
        assets = assets.withColumn("cur", F.lit(None).cast("double"))
    has_current = current is not None

    factored = "rets" in cov.columns

    def matrix(symbols: list[str], right: pa.Table) -> np.ndarray | WindowCovariance:
        n = len(symbols)
        at = {s: i for i, s in enumerate(symbols)}
        if factored:
            right = right.combine_chunks()
            if not right.num_rows:
                return WindowCovariance(np.full((n, 1), np.nan))
            row = np.array([at.get(s, -1) for s in right["symbol"].to_pylist()])
            _, known = dense(right["days"].chunk(0), right["rets"].chunk(0))
            x = np.full((n, known.shape[1]), np.nan)
            x[row[row >= 0]] = known[row >= 0]
            return WindowCovariance(x)
        right = right.select(["sym_i", "sym_j", "cov"]).to_pandas()
        pair = right[right["sym_i"].isin(at) & right["sym_j"].isin(at)]
        i, j = pair["sym_i"].map(at).to_numpy(), pair["sym_j"].map(at).to_numpy()
        c = np.zeros((n, n))
        c[i, j] = pair["cov"].to_numpy()
        c[j, i] = pair["cov"].to_numpy()
        return c

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["as_of", "symbol", "mu", "industry", "cur"]).to_pandas().sort_values("symbol")
        n = len(left)
        if not n:
            return pa.table({c: pa.array([], t) for c, t in ARROW_OUT.items()})
        cur = left["cur"].to_numpy(dtype=float) if has_current else None
        c = matrix(left["symbol"].tolist(), right)
        w, start, end = solve(left["mu"].to_numpy(dtype=float), c, rules, left["industry"].to_numpy(), cur)
        feasible = n * rules.upper >= 1.0 and n * rules.lower <= 1.0
        cols = (left["as_of"], left["symbol"], w, np.full(n, feasible), np.full(n, start, float), np.full(n, end, float))
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(ARROW_OUT.items(), cols)})

    # a date takes long for its few bytes: partitions are not to be merged by size
    parts = int(mu.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.repartition(parts, "as_of").groupBy("as_of") for df in (assets, cov))
    return left.cogroup(right).applyInArrow(run, OUT)
