"""Stored results: feature sets, backtests, models, reports (SNK_FEAT .. SNK_REPORT_*)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import curve, metrics
from ..operators.quality import numeric_columns


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


META = (
    "feature_version string, feature_type string, symbols array<string>, start_date date, end_date date, "
    "feature_count int, sample_count bigint, checksum string, config string, created_at timestamp"
)


@dataclass
class FeatureStore:
    """Raw and processed features by version; metadata in a table of its own.

    One folder per version, sorted by symbol and date inside: a folder per
    symbol would mean thousands of small files.
    """

    spark: SparkSession
    path: str

    def _dir(self, kind: str) -> str:
        return f"{self.path}/{kind}"

    def write(self, features: DataFrame, version: str, kind: str = "raw", config: dict | None = None) -> None:
        out = features.withColumn("feature_version", F.lit(version))
        (
            out.repartitionByRange("symbol", "date").sortWithinPartitions("symbol", "date")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
            .partitionBy("feature_version").parquet(self._dir(kind))
        )
        meta = describe(self.read(kind, version), version, kind, json.dumps(config or {}))
        self._write_meta(meta.withColumn("created_at", F.current_timestamp()))

    def _write_meta(self, meta: DataFrame) -> None:
        """One file per version, so writing a version again replaces its row."""
        (
            meta.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("feature_type", "feature_version").parquet(self._dir("metadata"))
        )

    def _table(self, kind: str) -> DataFrame:
        # versions stay text even when all of them look like numbers
        kinds = self.spark.read.parquet(self._dir(kind)).schema
        kinds["feature_version"].dataType = T.StringType()
        return self.spark.read.schema(kinds).parquet(self._dir(kind))

    def read(self, kind: str = "raw", version: str | None = None, symbols=None, start=None, end=None) -> DataFrame:
        df = self._table(kind)
        if version is not None:
            df = df.where(F.col("feature_version") == version)
        if symbols is not None:
            df = df.where(F.col("symbol").isin(list(symbols)))
        if start is not None:
            df = df.where(F.col("date") >= F.lit(start))
        if end is not None:
            df = df.where(F.col("date") <= F.lit(end))
        return df

    def metadata(self) -> DataFrame:
        names = [c.strip().split(" ")[0] for c in META.split(", ")]
        return self.spark.read.schema(META).parquet(self._dir("metadata")).select(*names)

    def versions(self, kind: str = "raw") -> DataFrame:
        return self.metadata().where(F.col("feature_type") == kind).select("feature_version").distinct().orderBy("feature_version")

    def clean(self, keep: int = 5) -> DataFrame:
        """Drop all but the `keep` versions of each kind written last; returns the metadata that stays."""
        w = Window.partitionBy("feature_type").orderBy(F.desc("created_at"), F.desc("feature_version"))
        ranked = self.metadata().select("feature_type", "feature_version", "created_at").withColumn("_rn", F.row_number().over(w))
        # one row per version: the list of folders to drop is small by nature
        for r in ranked.where(F.col("_rn") > keep).collect():
            _delete(self.spark, f"{self._dir(r['feature_type'])}/feature_version={r['feature_version']}")
            _delete(self.spark, f"{self._dir('metadata')}/feature_type={r['feature_type']}/feature_version={r['feature_version']}")
        return self.metadata()

    def info(self) -> DataFrame:
        """Files, megabytes, rows and symbols per kind."""
        out = None
        for kind in ("raw", "processed"):
            if not _exists(self.spark, self._dir(kind)):
                continue
            df = self.spark.read.parquet(self._dir(kind))
            files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"), "symbol")
            per = files.groupBy("f", "b", "symbol").agg(F.count(F.lit(1)).alias("n"))
            size = per.groupBy("f").agg(F.max("b").alias("b")).agg(
                F.count(F.lit(1)).alias("files"), (F.sum("b") / 1048576).alias("size_mb")).withColumn("kind", F.lit(kind))
            rows = per.agg(F.sum("n").alias("rows"), F.count_distinct("symbol").alias("symbols")).withColumn("kind", F.lit(kind))
            one = rows.join(size, "kind")
            out = one if out is None else out.unionByName(one)
        return out


def describe(features: DataFrame, version: str, kind: str, config: str = "{}") -> DataFrame:
    """One metadata row; the checksum does not depend on row order."""
    cols = sorted(features.columns)
    count = len(numeric_columns(features))
    return features.agg(
        F.sort_array(F.collect_set("symbol")).alias("symbols"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("checksum"),
    ).select(
        F.lit(version).alias("feature_version"), F.lit(kind).alias("feature_type"), "symbols", "start_date", "end_date",
        F.lit(count).alias("feature_count"), "sample_count", "checksum", F.lit(config).alias("config"),
    )


@dataclass
class BacktestStore:
    """Backtests as tables keyed by `backtest_id`: meta, metrics, returns, positions."""

    spark: SparkSession
    path: str

    def save(self, backtest_id: str, meta: dict, metric_row: DataFrame, returns: DataFrame, positions: DataFrame) -> None:
        m = self.spark.createDataFrame(
            [(backtest_id, meta["name"], meta["status"], meta["created_at"], json.dumps(meta.get("config", {})))],
            "backtest_id string, name string, status string, created_at string, config string",
        )
        for table, df in (("meta", m), ("metrics", metric_row), ("returns", returns), ("positions", positions)):
            (
                df.withColumn("backtest_id", F.lit(backtest_id)).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy("backtest_id").parquet(f"{self.path}/{table}")
            )

    def save_many(self, meta: DataFrame, metric_rows: DataFrame, returns: DataFrame, positions: DataFrame) -> None:
        """Any number of backtests in one write per table; every frame carries `backtest_id`."""
        for table, df in (("meta", meta), ("metrics", metric_rows), ("returns", returns), ("positions", positions)):
            (
                df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("backtest_id").parquet(f"{self.path}/{table}")
            )

    def table(self, name: str) -> DataFrame:
        # ids stay text, leading zeros included, even when all of them look like numbers
        kinds = self.spark.read.parquet(f"{self.path}/{name}").schema
        kinds["backtest_id"].dataType = T.StringType()
        return self.spark.read.schema(kinds).parquet(f"{self.path}/{name}")

    def list(self, status: str | None = None, since: str | None = None, limit: int = 20) -> DataFrame:
        df = self.table("meta")
        if status is not None:
            df = df.where(F.col("status") == status)
        if since is not None:
            df = df.where(F.col("created_at") >= since)
        return df.orderBy(F.desc("created_at"), F.desc("backtest_id")).limit(limit)

    def get(self, backtest_id: str, name: str = "metrics") -> DataFrame:
        return self.table(name).where(F.col("backtest_id") == backtest_id)

    def delete(self, backtest_id: str) -> None:
        for name in ("meta", "metrics", "returns", "positions"):
            _delete(self.spark, f"{self.path}/{name}/backtest_id={backtest_id}")

    def compare(self, ids: list[str], wanted: list[str]) -> DataFrame:
        """Chosen metrics of several backtests, one row each; a missing metric is 0."""
        m = self.table("metrics").where(F.col("backtest_id").isin(ids))
        names = self.table("meta").select("backtest_id", "name")
        cols = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in m.columns else F.lit(0.0).alias(c) for c in wanted]
        return names.join(m, "backtest_id").select("backtest_id", "name", *cols)


@dataclass
class ModelRegistry:
    """Saved pipeline models with a metadata table."""

    spark: SparkSession
    path: str
    SCHEMA = "model_id string, model_type string, status string, created_at string, metrics map<string,double>"

    def save(self, model_id: str, model: PipelineModel | None, model_type: str, metric_map: dict[str, float], created: str,
             status: str = "trained") -> None:
        if model is not None:
            model.write().overwrite().save(f"{self.path}/models/{model_id}")
        row = [(model_id, model_type, status, created, {k: float(v) for k, v in metric_map.items()})]
        self.spark.createDataFrame(row, self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    def load(self, model_id: str) -> PipelineModel:
        return PipelineModel.load(f"{self.path}/models/{model_id}")

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/meta")

    def list(self, model_type: str | None = None, status: str | None = None) -> DataFrame:
        return list_models(self.table(), model_type, status)

    def performance(self, ids: list[str], wanted: list[str]) -> DataFrame:
        return performance_table(self.table().where(F.col("model_id").isin(ids)), wanted)


def list_models(meta: DataFrame, model_type: str | None = None, status: str | None = None) -> DataFrame:
    if model_type is not None:
        meta = meta.where(F.col("model_type") == model_type)
    if status is not None:
        meta = meta.where(F.col("status") == status)
    return meta.orderBy(F.desc("created_at"), "model_id")


def performance_table(meta: DataFrame, wanted: list[str]) -> DataFrame:
    """Chosen metrics per model, a missing one is 0."""
    return meta.select("model_id", "model_type", *[F.coalesce(F.col("metrics")[m], F.lit(0.0)).alias(m) for m in wanted])


def report_json(returns: DataFrame, path: str, benchmark: DataFrame | None = None) -> None:
    """Period, metrics and series of each strategy as JSON lines, one folder per table."""
    span = returns.groupBy("strategy").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("total_days"))
    span.join(metrics(returns, benchmark), "strategy").write.mode("overwrite").json(f"{path}/metrics")
    curve(returns).select("strategy", "date", "ret", F.col("value").alias("cumulative")).write.mode("overwrite").json(f"{path}/series")


def report_sheets(returns: DataFrame, trades: DataFrame, positions: DataFrame, path: str, fmt: str = "csv") -> None:
    """The four report tables: metrics, series, trades, positions."""
    tables = {
        "metrics": metrics(returns),
        "series": curve(returns).select("strategy", "date", "ret", F.col("value").alias("cumulative")),
        "trades": trades,
        "positions": positions,
    }
    for name, df in tables.items():
        w = df.write.mode("overwrite").format(fmt)
        (w.option("header", True) if fmt == "csv" else w).save(f"{path}/{name}")
