"""Feature pipeline: impute, scale, select (FP_*).

Fitting aggregates over the whole table and leaves a few numbers per column on
the driver; applying them is a plain projection without a join.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import by_date, div
from .indicators import all_indicators
from .quality import coerce_numeric, enough, numeric_columns
from .quantiles import exact_quantiles


def raw_features(bars: DataFrame, min_rows: int = 30, **kw) -> DataFrame:
    """Indicators of every symbol with enough bars."""
    return all_indicators(enough(coerce_numeric(bars), min_rows), **kw)


def long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value) rows; aggregates over it combine map-side per feature."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")


def column_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float]) -> dict[str, dict[str, float]]:
    """Exact quantiles of each column: one small row per column reaches the driver."""
    rows = exact_quantiles(long_form(df, cols), ["feature"], "value", probs).collect()
    found = {r["feature"]: {p: r[p] for p in probs} for r in rows}
    return {c: found.get(c, {p: 0.0 for p in probs}) for c in cols}


def medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    return {c: v["m"] for c, v in column_quantiles(df, cols, {"m": 0.5}).items()}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in fill.items()})


def scale_params(filled: DataFrame, cols: list[str], kind: str) -> dict[str, tuple[float, float]]:
    """(centre, width) per column; a zero width counts as 1."""
    if kind == "robust":
        qs = column_quantiles(filled, cols, {"a": 0.25, "m": 0.5, "b": 0.75})
        pairs = {c: (v["m"], v["b"] - v["a"]) for c, v in qs.items()}
    else:
        if kind == "standard":
            aggs = [(F.avg(c), F.stddev_pop(c)) for c in cols]
        elif kind == "minmax":
            aggs = [(F.min(c), F.max(c) - F.min(c)) for c in cols]
        else:
            raise ValueError(kind)
        flat = [x.alias(f"{i}_{j}") for i, p in enumerate(aggs) for j, x in enumerate(p)]
        row = filled.agg(*flat).first()
        pairs = {c: (row[f"{i}_0"], row[f"{i}_1"]) for i, c in enumerate(cols)}
    return {c: (a or 0.0, b if b else 1.0) for c, (a, b) in pairs.items()}


def scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(float(a))) / F.lit(float(b)) for c, (a, b) in params.items()})


def next_return(df: DataFrame) -> DataFrame:
    """Add `target`: the symbol's next-day return, 0 on its last day."""
    nxt = F.lead("close").over(by_date())
    return df.withColumn("target", F.coalesce(div(nxt, "close") - 1, F.lit(0.0)))


def f_scores(filled: DataFrame, cols: list[str], target: str = "target") -> DataFrame:
    """F statistic of the correlation of each column with the target."""
    df = filled.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(target).cast("double").alias("_y"))
    rows = df.unpivot(["_y"], cols, "feature", "value").groupBy("feature").agg(
        F.corr("value", "_y").alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    r2 = F.col("_r") * F.col("_r")
    return rows.select("feature", F.coalesce(r2 * (F.col("_n") - 2) / (1 - r2), F.lit(0.0)).alias("f_score"))


def _bin(value, cuts: list[float]):
    out = F.lit(0)
    for c in cuts:
        out = out + (value > F.lit(float(c))).cast("int")
    return out


def mutual_information(filled: DataFrame, cols: list[str], target: str = "target", bins: int = 10) -> DataFrame:
    """Mutual information from joint counts of equal-frequency bins."""
    probs = {f"q{k}": k / bins for k in range(1, bins)}
    cuts = column_quantiles(filled, [*cols, target], probs)
    line = {c: sorted(v.values()) for c, v in cuts.items()}
    df = filled.select(
        *[_bin(F.col(c), line[c]).alias(c) for c in cols], _bin(F.col(target), line[target]).alias("_y")
    )
    joint = df.unpivot(["_y"], cols, "feature", "_x").groupBy("feature", "_x", "_y").agg(F.count(F.lit(1)).alias("c"))
    # from here on there are at most bins^2 rows per feature
    px = joint.groupBy("feature", "_x").agg(F.sum("c").alias("cx"))
    py = joint.groupBy("feature", "_y").agg(F.sum("c").alias("cy"))
    n = joint.groupBy("feature").agg(F.sum("c").alias("n"))
    j = joint.join(px, ["feature", "_x"]).join(py, ["feature", "_y"]).join(n, "feature")
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    return j.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def importance(filled: DataFrame, cols: list[str], target: str = "target", bins: int = 10) -> DataFrame:
    both = f_scores(filled, cols, target).join(mutual_information(filled, cols, target, bins), "feature")
    both = both.withColumn("combined", (F.col("f_score") + F.col("mutual_info")) / 2)
    return both.orderBy(F.desc("combined"), "feature")


def low_variance(filled: DataFrame, cols: list[str], threshold: float = 0.0) -> DataFrame:
    """Columns whose variance does not exceed the threshold."""
    v = long_form(filled, cols).groupBy("feature").agg(F.var_samp("value").alias("variance"))
    return v.where(F.coalesce("variance", F.lit(0.0)) <= threshold)


def correlated_columns(filled: DataFrame, cols: list[str], limit: float = 0.95) -> list[str]:
    """Columns to drop so that no two kept ones correlate above the limit (kept in column order)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vec = VectorAssembler(inputCols=cols, outputCol="v").transform(filled)
    m = Correlation.corr(vec, "v").first()[0].toArray()
    kept: list[int] = []
    for i in range(len(cols)):
        if all(not abs(m[i, j]) > limit for j in kept):
            kept.append(i)
    return [c for i, c in enumerate(cols) if i not in kept]


@dataclass
class FeaturePipeline:
    """Fit once, then transform any bars with the same numbers."""

    scaler: str = "standard"  # minmax, robust, none
    selection: str = "k_best_f"  # mutual_info, variance, correlation, none
    n_features: int = 20
    threshold: float | None = None  # variance to exceed (0 by default), correlation not to exceed (0.95)
    fill: dict[str, float] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    selected: list[str] = field(default_factory=list)

    def fit(self, features: DataFrame) -> FeaturePipeline:
        cols = numeric_columns(features)
        self.fill = medians(features, cols)
        filled = impute(features, self.fill)
        if self.scaler != "none":
            self.scales = scale_params(filled, cols, self.scaler)
        self.selected = cols
        if self.selection == "variance":
            gone = {r["feature"] for r in low_variance(filled, cols, self.threshold or 0.0).collect()}
            self.selected = [c for c in cols if c not in gone]
        elif self.selection == "correlation":
            gone = set(correlated_columns(filled, cols, 0.95 if self.threshold is None else self.threshold))
            self.selected = [c for c in cols if c not in gone]
        elif self.selection != "none" and "close" in cols:
            scored = next_return(filled)
            if self.selection == "k_best_f":
                s, name = f_scores(scored, cols), "f_score"
            else:
                s, name = mutual_information(scored, cols), "mutual_info"
            best = s.orderBy(F.desc(name), "feature").limit(min(self.n_features, len(cols))).collect()
            keep = {r["feature"] for r in best}
            self.selected = [c for c in cols if c in keep]
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        other = [c for c in features.columns if c not in self.fill]
        out = impute(features, self.fill)
        if self.scales:
            out = scale(out, self.scales)
        return out.select(*other, *self.selected)

    def save(self, spark, path: str) -> None:
        text = json.dumps(asdict(self))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> FeaturePipeline:
        d = json.loads(spark.read.text(path).first()[0])
        d["scales"] = {c: tuple(v) for c, v in d["scales"].items()}
        return FeaturePipeline(**d)
