"""Bar store: Parquet partitioned by year, sorted by symbol and date inside files."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import with_row
from ..operators.quality import keep_last
from ..session import cut_lineage


BARS = "symbol string, date date, open double, high double, low double, close double, volume double, amount double, year int, bucket int"
STATS = "total_files long, total_size_mb double, symbols_count long, total_records long, first_year int, last_year int"


def file_time() -> Column:
    """When a row's file was written, then the file's name and the row's stretch of it. Spark reads files by size, not by age."""
    return F.struct(*[F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "file_block_start")])


def arrival(df: DataFrame) -> Column:
    """Order in which the rows of a frame arrived: by the time of their file if it is one of files, then by place."""
    place = F.monotonically_increasing_id()
    try:
        df.select(file_time())
    except AnalysisException:
        return place
    return F.struct(file_time().alias("file"), place.alias("place"))


def _folder(spark: SparkSession, path: str):
    """File system and path of a folder, wherever Spark keeps it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass
class BarStore:
    """Bars under one path, in folders of a year and a bucket of symbols.

    A rewrite touches only the (year, bucket) folders that hold keys of the
    new rows. It is staged in the shared folder first, because the old files
    are read while the new ones are made, and then replaces those folders.
    The number of buckets belongs to the store and stays what it was made with;
    large stores want more of them, so that a folder holds some gigabytes.
    """

    spark: SparkSession
    path: str
    buckets: int = 4

    def _exists(self) -> bool:
        fs, p = _folder(self.spark, self.path)
        return fs.exists(p)

    def _table(self) -> DataFrame:
        """All folders; no rows where nothing has been written yet."""
        if not self._exists():
            return self.spark.createDataFrame([], BARS)
        return self.spark.read.parquet(self.path)

    def _bucket(self, symbol: Column | str = "symbol") -> Column:
        return F.pmod(F.xxhash64(symbol), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, mode: str) -> None:
        # range partitioning splits a large symbol or year over many files of
        # like size, and gives row groups narrow symbol ranges to prune by
        out = df.withColumns({"year": F.year("date"), "bucket": self._bucket()})
        order = ["year", "bucket", "symbol", "date"]
        (
            out.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "snappy")
            .partitionBy("year", "bucket")
            .parquet(self.path)
        )

    def _touched(self, df: DataFrame) -> list[tuple[int, int]]:
        """(year, bucket) of the rows: bounded by the calendar and the number of buckets, so safe to bring to the driver."""
        pairs = df.select(F.year("date").alias("year"), self._bucket().alias("bucket")).distinct().collect()
        return sorted((r.year, r.bucket) for r in pairs if r.year is not None)

    @staticmethod
    def _within(folders: list[tuple[int, int]]) -> Column:
        out = F.lit(False)
        for year in sorted({y for y, _ in folders}):
            out = out | ((F.col("year") == year) & F.col("bucket").isin([b for y, b in folders if y == year]))
        return out

    def read(
        self, symbols: list[str] | DataFrame | None = None, start: dt.date | None = None,
        end: dt.date | None = None, columns: list[str] | None = None,
    ) -> DataFrame:
        """Bars of many symbols in one scan; either bound alone prunes years, and listed symbols prune buckets."""
        df = self._table()
        if start is not None:
            df = df.where((F.col("year") >= start.year) & (F.col("date") >= F.lit(start)))
        if end is not None:
            df = df.where((F.col("year") <= end.year) & (F.col("date") <= F.lit(end)))
        if isinstance(symbols, DataFrame):
            df = df.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
        elif symbols is not None:
            df = df.where(F.col("symbol").isin(symbols) & F.col("bucket").isin([self._bucket(F.lit(x)) for x in symbols]))
        return df.select(*columns) if columns else df.drop("year", "bucket")

    def append(self, bars: DataFrame) -> None:
        self._write(bars, "append")

    def overwrite(self, bars: DataFrame) -> None:
        """Replace the (symbol, year) pairs present in `bars`."""
        if not self._exists():
            return self._write(bars, "append")
        bars = cut_lineage(bars, "new-bars")
        touched = bars.select("symbol", F.year("date").alias("year")).distinct()
        old = self._table().where(self._within(self._touched(bars)))
        kept = old.join(touched, ["symbol", "year"], "left_anti").drop("year", "bucket")
        self._write(cut_lineage(kept.unionByName(bars, allowMissingColumns=True), "overwrite"), "overwrite")

    def merge(self, bars: DataFrame, order: Column | None = None, skip: tuple[str, ...] = ()) -> None:
        """New rows win over old ones; among new copies of a key the highest `order` wins.

        Without `order` the copy of the latest file wins, in a file the last
        one, and in a frame without files the last one; a frame that has
        passed a shuffle has no such places and needs an order. Columns of
        `skip` serve the order only.
        """
        order = arrival(bars) if order is None else order
        bars = cut_lineage(bars.withColumn("_o", order).drop(*skip), "new-bars")
        new = bars.withColumn("_src", F.lit(1))
        if self._exists():
            old = self._table().where(self._within(self._touched(bars))).drop("year", "bucket")
            old = old.withColumn("_src", F.lit(0)).withColumn("_o", F.lit(None).cast(new.schema["_o"].dataType))
            new = old.unionByName(new, allowMissingColumns=True)
        rank = F.struct("_src", "_o")
        cols = [c for c in new.columns if c not in ("symbol", "date", "_o", "_src")]
        merged = keep_last(new, ["symbol", "date"], rank, cols)
        self._write(cut_lineage(merged, "merge"), "overwrite")

    def delete(self, symbol: str, year: int | None = None) -> None:
        """Remove a symbol from all years or one: one folder a year is rewritten.

        A folder that held nothing else is removed.
        """
        if not self._exists():
            return
        df = self._table()
        hit = (F.col("symbol") == symbol) & (F.col("bucket") == self._bucket(F.lit(symbol)))
        if year is not None:
            hit = hit & (F.col("year") == year)
        folders = [(r.year, r.bucket) for r in df.where(hit).select("year", "bucket").distinct().collect()]
        kept = df.where(self._within(folders) & (F.col("symbol") != symbol)).drop("year", "bucket")
        kept = cut_lineage(kept, "delete")
        left = self._touched(kept)
        self._write(kept, "overwrite")
        for y, b in set(folders) - set(left):
            fs, p = _folder(self.spark, f"{self.path}/year={y}/bucket={b}")
            fs.delete(p, True)

    def symbols(self) -> DataFrame:
        return self._table().select("symbol").distinct().orderBy("symbol")

    def stats(self) -> DataFrame:
        """Files, megabytes, symbols and years, without reading price columns."""
        if not self._exists():
            return self.spark.createDataFrame([(0, 0.0, 0, 0, None, None)], STATS)
        df = self._table()
        files = df.select(
            F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"), "symbol", "year"
        )
        per_file = files.groupBy("f", "b", "symbol", "year").agg(F.count(F.lit(1)).alias("n"))
        sizes = per_file.groupBy("f").agg(F.max("b").alias("b")).agg(
            F.count(F.lit(1)).alias("total_files"), (F.sum("b") / (1024 * 1024)).alias("total_size_mb")
        )
        rest = per_file.agg(
            F.count_distinct("symbol").alias("symbols_count"),
            F.sum("n").alias("total_records"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
        )
        return with_row(rest, sizes)


def matrix(bars: DataFrame, symbols: list[str], start, end, field: str = "close") -> DataFrame:
    """date x symbol matrix of one field, mean of repeated rows; wide only at this edge."""
    picked = bars.where(F.col("symbol").isin(symbols) & F.col("date").between(start, end))
    return picked.groupBy("date").pivot("symbol", symbols).agg(F.avg(field))


def data_statistics(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.count_distinct("symbol").alias("total_symbols"),
        F.count(F.lit(1)).alias("total_records"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options
) -> DataFrame:
    """A relational table in parallel slices of a numeric column."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper,
            numPartitions=partitions, **options,
        )
        .load()
    )


def write_jdbc(df: DataFrame, url: str, table: str, **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def update_table(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Bulk update: changed columns replace the current ones where the key exists.

    Of several changes of a key the last one in `changes` counts.
    """
    cols = [c for c in changes.columns if c not in keys]
    last = keep_last(changes.withColumn("_o", arrival(changes)), keys, F.col("_o"), cols)
    marked = last.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = current.join(marked, keys, "left")
    return out.select(
        *[
            F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in current.columns
        ]
    )


def _replace(spark: SparkSession, path: str, df: DataFrame) -> None:
    """Put the rows in place of a stored table; they are staged in the shared folder, where they stay if the last step fails."""
    cut_lineage(df, "replace").write.mode("overwrite").parquet(path)


def write_updates(spark: SparkSession, path: str, changes: DataFrame, keys: list[str]) -> None:
    """Bulk update of a stored table: `update_table`, written back."""
    _replace(spark, path, update_table(spark.read.parquet(path), changes, keys))


def write_retention(spark: SparkSession, path: str, expired: Column) -> int:
    """Take rows that are `expired` out of a stored table; how many they were. Rows for which that is unknown stay."""
    rows = spark.read.parquet(path)
    gone = rows.where(expired).count()
    if gone:
        _replace(spark, path, rows.where(~F.coalesce(expired, F.lit(False))))
    return gone


def file_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(file, column, type) of all Parquet files below `path`.

    Spark lists the files; each task opens some of them and reads their
    footers alone, through pyarrow, so the store must be one that it reaches.
    """

    def footers(batches):
        from pyarrow import fs, parquet

        for pdf in batches:
            for file in pdf["path"]:
                system, name = fs.FileSystem.from_uri(file)
                with system.open_input_file(name) as f:
                    schema = parquet.read_schema(f)
                yield pd.DataFrame({"file": file, "column": schema.names, "type": [str(t) for t in schema.types]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path").mapInPandas(footers, "file string, column string, type string")


def raw_sql(spark: SparkSession, text: str, params: dict | None = None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text with named parameters over the given views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=params or {})
