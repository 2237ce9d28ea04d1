"""Service statistics: requests, tasks, messages, counts (AGG_REQSTATS ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import div
from ..functions.rules import topic, topic_label
from .selection import apply_filters, top_per_group


def request_stats(requests: DataFrame, latest: int = 1000, pattern: str | None = None) -> DataFrame:
    """Per method and path over the latest rows: count, times, percentiles, success, status classes.

    The per-key limit applies map-side too, so a route with a third of all
    requests sends only `latest` rows per task; percentiles then see at most
    `latest` values.
    """
    if pattern:
        requests = requests.where(F.concat_ws(" ", "method", "path").contains(pattern))
    df = top_per_group(requests, ["method", "path"], [F.desc("ts"), F.desc("request_id")], latest)
    t, s = F.col("response_time"), F.col("status_code")
    pct = F.percentile(t, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    cls = [F.count_if((s >= 100 * k) & (s < 100 * (k + 1))) for k in (1, 2, 3, 4, 5)]
    return df.groupBy("method", "path").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(t).alias("avg_response_time"),
        F.min(t).alias("min_response_time"),
        F.max(t).alias("max_response_time"),
        (F.count_if((s >= 200) & (s < 300)) / F.count(F.lit(1)) * 100).alias("success_rate"),
        pct[0].alias("p50_response_time"),
        pct[1].alias("p95_response_time"),
        pct[2].alias("p99_response_time"),
        F.map_filter(
            F.map_from_arrays(F.array(*[F.lit(f"{k}xx") for k in (1, 2, 3, 4, 5)]), F.array(*cls)), lambda _, v: v > 0
        ).alias("status_distribution"),
    )


def status_counts(df: DataFrame, status: str, names: dict[str, str]) -> DataFrame:
    """One row: total and the count of each named status value."""
    s = F.col(status)
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == v).alias(n) for n, v in names.items()])


def sync_stats(outcomes: DataFrame) -> DataFrame:
    """Per task: completed, failed, total, progress in percent and final status."""
    o = F.col("outcome")
    a = outcomes.groupBy("task_id").agg(
        F.count_if(o == "completed").alias("symbols_completed"),
        F.count_if(o == "failed").alias("symbols_failed"),
        F.count(F.lit(1)).alias("symbols_total"),
    )
    return progress(a)


def progress(counts: DataFrame) -> DataFrame:
    """Progress in percent and status of tasks from their counts."""
    done = F.col("symbols_completed") + F.col("symbols_failed")
    return counts.withColumns(
        {
            "progress": done / F.col("symbols_total") * 100,
            "status": F.when(done < F.col("symbols_total"), "running")
            .when(F.col("symbols_failed") > 0, "failed")
            .otherwise("success"),
        }
    )


def count_where(df: DataFrame, filters: dict) -> DataFrame:
    return apply_filters(df, filters).agg(F.count(F.lit(1)).alias("n"))


def exists_where(df: DataFrame, filters: dict) -> DataFrame:
    """One row, true when any row matches; stops at the first one found."""
    return apply_filters(df, filters).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def chat_totals(messages: DataFrame, stored_per_session: int = 200) -> DataFrame:
    """One row: sessions, messages, stored messages, mean response time, derived satisfaction."""
    per = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("response_time").alias("t"), F.count("response_time").alias("k"))
    a = per.agg(
        F.count_if(F.col("n") > 0).alias("total_conversations"),
        F.sum("n").alias("total_messages"),
        F.sum(F.least(F.col("n"), F.lit(stored_per_session))).alias("stored_messages"),
        F.coalesce(div(F.sum("t"), F.sum("k")), F.lit(0.0)).alias("response_time_avg"),
    )
    liked = F.round(4.0 + F.least(F.lit(0.9), F.col("total_messages") * 0.02), 2)
    return a.withColumn("user_satisfaction", F.when(F.col("total_messages") > 0, liked).otherwise(0.0))


def chat_categories(messages: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """Messages per category, with the name it is shown by."""
    c = messages.groupBy(topic("text", keywords).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("label", topic_label("category")).orderBy(F.desc("count"), "category")


def history_summary(backtests: DataFrame) -> DataFrame:
    """Completed backtests and their mean return."""
    done = F.col("status") == "completed"
    return backtests.agg(
        F.count_if(done).alias("completed"),
        F.coalesce(F.avg(F.when(done, F.coalesce("total_return", F.lit(0.0)))), F.lit(0.0)).alias("avg_return"),
    )


def strategy_cards(strategies: DataFrame) -> DataFrame:
    return strategies.agg(
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "testing").alias("testing"),
        F.avg("total_return").alias("mean_return"),
    )


def storage_cards(stores: DataFrame) -> DataFrame:
    return stores.agg(F.sum("files").alias("total_files"), F.sum("size_mb").alias("total_size_mb"), F.sum("symbols").alias("total_symbols"))
