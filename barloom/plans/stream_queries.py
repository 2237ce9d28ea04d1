"""Registered queries: streaming jobs replayed over the tables, checked against their batch results."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..operators import ledger as lg
from ..session import cut_lineage, scratch_path
from ..sources import tables as t
from ..sources.store import BarStore
from ..streaming import jobs
from .account_queries import REQUEST_COLS, REQUEST_SQL, SYNC_KEYS, SYNC_SQL, ledger_sql, outcomes
from .registry import dated, query
from .shape import q, qs, rounded
from .views_sql import sql

W = "PARTITION BY symbol ORDER BY date"


def _replay(spark, df, label, splits, start, on="date", closing=False):
    """Land `df` in steps of the column `on` and run the job after each step.

    `start(stream, checkpoint)` starts the job; every run resumes from the
    checkpoint of the one before, as a scheduled job would. With `closing` a
    last step lands the row that closes what is still open.
    """
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    bounds = [None, *splits, None]
    steps = []
    if closing:
        df = df.withColumn("closing", F.lit(False))
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        if lo is not None:
            part = part.where(F.col(on) >= lo)
        if hi is not None:
            part = part.where(F.col(on) < hi)
        steps.append(part)
    if closing:
        steps.append(jobs.closing_marker(df))
    for part in steps:
        part.write.mode("append").parquet(path)
        _run(start(spark.readStream.schema(df.schema).parquet(path), checkpoint))


def _events(spark, sf):
    return t.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(query_):
    query_.awaitTermination()
    err = query_.exception()
    if err is not None:
        raise err


@dated("st_barmerge", sql("prices_supp", body=f"""
SELECT symbol, date, {q("CASE WHEN date >= DATE '2001-01-01' AND symbol < '000050' THEN close + 2 ELSE close END", 6, "close")} FROM prices_supp"""))
def st_barmerge(spark, sf):
    """Bars and their corrections; the later of two corrections of a key counts, though both come in one batch and its file is the smaller one."""
    p = t.prices_supp(spark, sf).select("symbol", "date", "close")
    store = BarStore(spark, scratch_path(spark, "stream-store"))
    start = lambda stream, cp: jobs.merge_bars(stream, store, cp)
    _replay(spark, p, "bars-in", ["1998-01-01"], start)
    fix = p.where("date >= '2001-01-01' AND symbol < '000050'")
    path = scratch_path(spark, "bars-fix")
    once = fix.withColumn("close", F.col("close") + 1)
    once.union(fix.where("symbol >= '000025'").withColumn("close", F.col("close") + 1)).coalesce(1).write.parquet(path)
    time.sleep(1.1)  # file times may be whole seconds
    fix.withColumn("close", F.col("close") + 2).repartition(3).write.mode("append").parquet(path)
    _run(start(spark.readStream.schema(fix.schema).parquet(path), scratch_path(spark, "bars-fix-checkpoint")))
    return rounded(store.read(), ["symbol", "date"], ["close"])


_CROSS = f"""c0 AS (SELECT *, CASE WHEN count(*) OVER ({W} ROWS 2 PRECEDING) = 3 THEN avg(close) OVER ({W} ROWS 2 PRECEDING) END AS f,
 CASE WHEN count(*) OVER ({W} ROWS 5 PRECEDING) = 6 THEN avg(close) OVER ({W} ROWS 5 PRECEDING) END AS s,
 close / lag(close, 12) OVER ({W}) - 1 AS m FROM prices_supp),
c1 AS (SELECT *, lag(f) OVER ({W}) AS pf, lag(s) OVER ({W}) AS ps FROM c0),
c2 AS (SELECT symbol, date, close, 'MA_3_6' AS strategy, abs(f - s) / s AS confidence,
  CASE WHEN f > s AND pf <= ps THEN 'BUY' WHEN f < s AND pf >= ps THEN 'SELL' END AS action FROM c1
 UNION ALL SELECT symbol, date, close, 'MOM_12', abs(m), CASE WHEN m > 0.05 THEN 'BUY' WHEN m < -0.05 THEN 'SELL' END FROM c1)"""


@dated("st_signal", sql("prices_supp", extra=_CROSS, body=f"""
SELECT symbol, date, action, strategy, CASE action WHEN 'BUY' THEN 'entry' ELSE 'exit' END AS signal_type,
 CAST(CAST(floor(floor(100000 / close) / 100) AS BIGINT) * 100 AS BIGINT) AS quantity, {q('close', 6, 'price')}, {q('confidence', 5)} FROM c2 WHERE action IS NOT NULL"""))
def st_signal(spark, sf):
    """All signals of the price stream, the last month's too: a closing marker moves the watermark past it."""
    p = t.prices_supp(spark, sf).select("symbol", "date", "close").withColumn("ts", F.col("date").cast("timestamp"))
    out = scratch_path(spark, "signals")
    run = lambda stream, cp: jobs.signals(stream, out, cp, 3, 6, lookback=12, threshold=0.05, stretch_ms=30 * jobs.DAY_MS)
    with jobs.rocksdb_state(spark):
        _replay(spark, p, "ticks", ["1998-01-01"], run, closing=True)
    r = spark.read.schema(jobs.SIGNAL_SCHEMA).parquet(out)
    keys = ["symbol", "date", "action", "strategy", "signal_type", "quantity"]
    return rounded(r.withColumn("date", F.timestamp_millis("ts_ms").cast("date")), keys, {"price": 6, "confidence": 5})


_LQ = {"quantity": 2, "avg_cost": 4, "realized_pnl": 2}


@query("st_ledger", ledger_sql("SELECT strategy, symbol, orders, " + ", ".join(q(c, d) for c, d in _LQ.items()) + " FROM po"))
def st_ledger(spark, sf):
    """The ledger goes on from the batch ledger of earlier years and takes the fills of the others, the last day's too, from a stream."""
    o = t.ledger_orders(spark, sf)
    start = lg.positions(o.where("date < '1996-01-01'")).select("strategy", "symbol", "orders", "quantity", "avg_cost", "realized_pnl")
    start = cut_lineage(start, "ledger-start")
    flat = o.where("date >= '1996-01-01'").select(
        "strategy", "symbol", "date", F.col("date").cast("timestamp").alias("ts"), "side", "price", "quantity",
        F.floor(F.col("seq") / F.lit(10**18)).cast("bigint").alias("s1"), (F.col("seq") % F.lit(10**18)).cast("bigint").alias("s2"))
    out = scratch_path(spark, "ledger")
    with jobs.rocksdb_state(spark):
        _replay(spark, flat, "fills", ["1998-01-01"], lambda stream, cp: jobs.ledger(stream, out, cp, start=start, stretch_ms=30 * jobs.DAY_MS), closing=True)
    return rounded(jobs.latest_positions(spark, out, start), ["strategy", "symbol", "orders"], _LQ)


_RS = ["avg_response_time", "min_response_time", "max_response_time", "success_rate"]


@query("st_reqstats", sql("requests", body=f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, path, count, {qs(_RS, 5)} FROM (
 SELECT time_bucket(INTERVAL '5 minutes', ts) AS w, path, count(*) AS count, avg(response_time) AS avg_response_time, min(response_time) AS min_response_time,
  max(response_time) AS max_response_time, count(*) FILTER (WHERE status_code = 200) / count(*) * 100 AS success_rate FROM requests GROUP BY 1, 2)"""))
def st_reqstats(spark, sf):
    """Every window of the table; a closing marker ends the last ones."""
    r = t.requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "reqstats")
    _replay(spark, r, "requests", [], lambda stream, cp: jobs.request_stats(stream, out, cp), closing=True)
    s = spark.read.parquet(out).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
    return rounded(s, ["window_start", "path", "count"], _RS, 5)


@query("st_reqlatest", REQUEST_SQL)
def st_reqlatest(spark, sf):
    """Statistics of the last 1000 requests of every route, kept up to date by a stream that comes in two parts."""
    r = t.requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    mid = r.agg(F.percentile_approx(F.col("ts").cast("double"), 0.5).cast("timestamp")).first()[0]
    out = scratch_path(spark, "reqlatest")
    with jobs.rocksdb_state(spark):
        _replay(spark, r, "requests", [F.lit(mid)], lambda stream, cp: jobs.latest_requests(stream, out, cp), on="ts")
    newest = jobs.newest_rows(spark, out, ["method", "path"])
    return rounded(newest, ["method", "path", "count", "n2", "n4", "n5"], REQUEST_COLS, 5)


@query("st_errors", """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS errors FROM (
 SELECT date_trunc('hour', ts) - k * INTERVAL '1 hour' AS w, ts FROM events, range(24) r(k) WHERE event_type = 'error') GROUP BY w""")
def st_errors(spark, sf):
    """All windows, open ones included; the last two hours of events are sent a second time and count once."""
    e = _events(spark, sf).withColumn("level", F.col("event_type"))
    recent = F.col("ts") >= e.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("t")).first()[0]
    path, checkpoint, out = scratch_path(spark, "events"), scratch_path(spark, "cp"), scratch_path(spark, "errors")
    for part in (e, e.where(recent)):
        part.write.mode("append").parquet(path)
        _run(jobs.error_counts(spark.readStream.schema(e.schema).parquet(path), out, checkpoint))
    s = jobs.newest_rows(spark, out, ["window_start", "window_end"])
    return s.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "errors")


@query("st_syncprogress", SYNC_SQL)
def st_syncprogress(spark, sf):
    """Progress of every task; recent outcomes are sent a second time and count once."""
    e = _events(spark, sf)
    o = outcomes(e, "event_id", "ts")
    recent = F.col("ts") >= e.agg((F.max("ts") - F.expr("INTERVAL 2 HOURS")).alias("t")).first()[0]
    path, checkpoint, out = scratch_path(spark, "outcomes"), scratch_path(spark, "cp"), scratch_path(spark, "progress")
    with jobs.rocksdb_state(spark):
        for part in (o, o.where(recent)):
            part.write.mode("append").parquet(path)
            # tasks of this table pause for weeks: they end after a year
            _run(jobs.sync_progress(spark.readStream.schema(o.schema).parquet(path), out, checkpoint, idle_ms=366 * jobs.DAY_MS))
    return rounded(jobs.latest_progress(spark, out), SYNC_KEYS, ["progress"], 5)
