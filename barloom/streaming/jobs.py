"""Structured Streaming jobs (ST_*).

Each job takes a streaming DataFrame and returns a started query; the caller
picks the source and the trigger. Stateful jobs buffer rows until the watermark
has passed them and then take them in event-time order, so the order of files
or messages does not change results.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.quality import keep_last
from ..operators.stats import progress
from ..sources.store import BarStore, file_time

STATE_CONF = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Arbitrary state needs the RocksDB store; the session's own choice is put back afterwards."""
    before = spark.conf.get(STATE_CONF, None)
    spark.conf.set(STATE_CONF, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_CONF)
        else:
            spark.conf.set(STATE_CONF, before)


def _start(df: DataFrame, checkpoint: str, mode: str):
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return _start(df, checkpoint, "append").format("parquet").option("path", path).start()


# -- merge of incoming bars ----------------------------------------------


def merge_bars(bars: DataFrame, store: BarStore, checkpoint: str, order: Column | None = None) -> StreamingQuery:
    """Every micro-batch is merged into the store; the last write of a key wins.

    `order` tells which of several rows of a key in one batch is the last (an
    arrival time with a sequence number). A stream of files needs none: the
    later file counts, and in a file the later row.

    A repeated batch after a failure merges the same rows again and changes
    nothing.
    """
    if order is None:
        bars = bars.withColumn("_file", file_time())

    def merge(batch: DataFrame, batch_id: int) -> None:
        if order is None:
            store.merge(batch, F.struct("_file", F.monotonically_increasing_id()), skip=("_file",))
        else:
            store.merge(batch, order)

    return _start(bars, checkpoint, "append").foreachBatch(merge).start()


# -- ordered state machines ----------------------------------------------


def _opened(df: DataFrame, delay: str) -> DataFrame:
    """Watermark on `ts`; rows marked as `closing` move it and go no further.

    The condition names the event time (no row is that old), so that it stays above the watermark.
    """
    df = df.withWatermark("ts", delay)
    never = F.col("ts") < F.lit("0001-01-01").cast("timestamp")
    return df.where(~F.col("closing") | never) if "closing" in df.columns else df


def closing_marker(df: DataFrame, after: str = "INTERVAL 400 DAYS") -> DataFrame:
    """One row like those of the batch frame `df`, later than all of them by `after`: it closes what they left open."""
    names = [c for c in df.columns if c not in ("ts", "closing")]
    nulls = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    last = df.agg((F.max("ts") + F.expr(after)).alias("ts"))
    return last.select(*nulls, "ts", F.lit(True).alias("closing")).select(*df.columns)


class OrderedProcessor(StatefulProcessor):
    """Buffers the rows of a key and hands them over in event-time order.

    Rows wait in map states in pieces of 1, 2, 4, ... stretches of event time,
    chunks of bounded size, under the first stretch of each, with one timer at
    the end of the earliest. It reads the pieces that hold what is due, takes
    that in order and stores what is still to wait again in such pieces, so a
    row is stored about log2(stretches it waits) times and a long replay takes
    few state calls. Subclasses set `FIELDS` (name and type of a buffered row's values, first
    `ts_ms`; rows are taken in their order), `STATE` (schema of the value
    state) and implement `advance`.
    """

    FIELDS: tuple[tuple[str, str], ...] = ()
    STATE = ""
    STRETCH_MS = DAY_MS
    CHUNK = 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.names = [name for name, _ in self.FIELDS]
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in self.FIELDS)
        self.chunks = handle.getMapState("chunks", "stretch bigint, place bigint", arrays)
        self.counts = handle.getMapState("counts", "stretch bigint", "chunks bigint")
        self.value = handle.getValueState("value", self.STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        names = [f.strip().split(" ")[0] for f in self.STATE.split(",")]
        self.value.update(tuple(initialState[names].astype(object).values.tolist()[0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            known = self._known()
            earliest = min(known, default=None)
            order = np.argsort(pdf["ts_ms"].to_numpy(), kind="stable")
            self._store([pdf[c].to_numpy()[order].tolist() for c in self.names], known)
            if earliest is None or min(known) < earliest:
                self.handle.registerTimer(self._end(min(known)))
        yield from ()

    def _known(self) -> dict[int, int]:
        """Number of chunks under each stretch."""
        return {int(k[0]): int(v[0]) for k, v in self.counts.iterator()}

    def _store(self, values: list[list], known: dict[int, int]) -> None:
        """Store columns in order of time; `known` is kept up to date."""
        of = np.asarray(values[0]) // self.STRETCH_MS
        starts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist()]
        k, span = 0, 1
        while k < len(starts):
            stop = starts[k + span] if k + span < len(starts) else len(of)
            for lo in range(starts[k], stop, self.CHUNK):
                first, hi = int(of[lo]), min(lo + self.CHUNK, stop)
                n = known.get(first, 0)
                self.chunks.updateValue((first, n), tuple(v[lo:hi] for v in values))
                self.counts.updateValue((first,), (n + 1,))
                known[first] = n + 1
            k, span = k + span, span * 2

    def _end(self, stretch: int) -> int:
        return (stretch + 1) * self.STRETCH_MS - 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        due = sorted(stretch for stretch in known if self._end(stretch) <= mark)
        if not due:  # an earlier timer of the key took this stretch along
            return
        state = self.value.get() if self.value.exists() else None
        rows, late = [], (mark + 1) // self.STRETCH_MS  # the first stretch that is not due
        for stretch, until in zip(due, [*due[1:], late]):
            for place in range(known.pop(stretch)):
                rows += zip(*self.chunks.getValue((stretch, place)))
                self.chunks.removeKey((stretch, place))
            self.counts.removeKey((stretch,))
            if len(rows) >= self.CHUNK or until == late:
                # rows of later stretches may lie in pieces not yet read
                ready = [r for r in rows if r[0] // self.STRETCH_MS < until]
                rows = [r for r in rows if r[0] // self.STRETCH_MS >= until]
                state, out = self.advance(key, state, sorted(ready)) if ready else (state, ())
                if len(out):
                    yield out
        if rows:
            self._store([list(v) for v in zip(*sorted(rows, key=lambda r: r[0]))], known)
        self.value.update(state)
        if known:
            self.handle.registerTimer(self._end(min(known)))

    def advance(self, key, state, rows):
        raise NotImplementedError

    def close(self) -> None:
        pass


class BarSignals(OrderedProcessor):
    """Crossings of two moving averages and momentum, from the last closes of a symbol."""

    FIELDS = (("ts_ms", "bigint"), ("close", "double"))
    STATE = "closes array<double>"
    FAST, SLOW, LOOKBACK, THRESHOLD, BUDGET, LOT = 5, 20, 20, 0.02, 100_000.0, 100

    def advance(self, key, state, rows):
        closes = list(state[0]) if state else []
        keep, out = max(self.SLOW, self.LOOKBACK) + 1, []
        for ms, close in rows:
            closes = [*closes, float(close)][-keep:]
            found = []
            if len(closes) > self.SLOW:
                now, prev = closes[-self.SLOW :], closes[-self.SLOW - 1 : -1]
                f, s = sum(now[-self.FAST :]) / self.FAST, sum(now) / self.SLOW
                pf, ps = sum(prev[-self.FAST :]) / self.FAST, sum(prev) / self.SLOW
                crossed = "BUY" if f > s and pf <= ps else "SELL" if f < s and pf >= ps else None
                found.append((crossed, f"MA_{self.FAST}_{self.SLOW}", abs(f - s) / s if s else 0.0))
            if len(closes) > self.LOOKBACK and closes[-1 - self.LOOKBACK]:
                m = closes[-1] / closes[-1 - self.LOOKBACK] - 1
                moved = "BUY" if m > self.THRESHOLD else "SELL" if m < -self.THRESHOLD else None
                found.append((moved, f"MOM_{self.LOOKBACK}", abs(m)))
            lots = int(self.BUDGET / closes[-1] // self.LOT) if closes[-1] > 0 else 0
            for action, strategy, confidence in found:
                if action:
                    kind = "entry" if action == "BUY" else "exit"
                    out.append((kind, key[0], int(ms), action, float(close), lots * self.LOT, strategy, confidence))
        cols = ["signal_type", "symbol", "ts_ms", "action", "price", "quantity", "strategy", "confidence"]
        return (closes,), pd.DataFrame(out, columns=cols)


SIGNAL_SCHEMA = (
    "signal_type string, symbol string, ts_ms bigint, action string, price double, quantity bigint, strategy string, confidence double"
)


def signals(
    bars: DataFrame, path: str, checkpoint: str, fast: int = 5, slow: int = 20, delay: str = "1 day",
    lookback: int = 20, threshold: float = 0.02, budget: float = 100_000.0, lot: int = 100, stretch_ms: int = DAY_MS,
) -> StreamingQuery:
    """Trading signals of a bar stream (symbol, ts, close): moving averages that cross, and momentum.

    A signal's quantity is what `budget` buys in whole lots. Bars wait until
    the watermark has passed the end of their stretch; long stretches suit a
    replay of history, short ones give signals early.
    """
    own = {"STRETCH_MS": stretch_ms} | {"FAST": fast, "SLOW": slow, "LOOKBACK": lookback, "THRESHOLD": threshold, "BUDGET": budget, "LOT": lot}
    df = _opened(bars, delay).withColumn("ts_ms", F.unix_millis("ts"))
    out = df.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=type("BarSignals", (BarSignals,), own)(), outputStructType=SIGNAL_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    return to_files(out, path, checkpoint)


class LedgerState(OrderedProcessor):
    """Position of a (strategy, symbol) after each run of fills."""

    FIELDS = (("ts_ms", "bigint"), ("s1", "bigint"), ("s2", "bigint"), ("side", "string"), ("quantity", "double"), ("price", "double"))
    STATE = "orders bigint, quantity double, avg_cost double, realized_pnl double"

    def advance(self, key, state, rows):
        n, q, avg, real = state if state else (0, 0.0, 0.0, 0.0)
        for r in rows:
            side, qty, px = r[3], float(r[4]), float(r[5])
            if side == "BUY":
                new_q = q + qty
                if new_q > 0:
                    avg = (q * avg + qty * px) / new_q
                q = new_q
            else:
                real += (px - avg) * qty
                q -= qty
            n += 1
        row = (key[0], key[1], int(n), float(q), float(avg), float(real))
        cols = ["strategy", "symbol", "orders", "quantity", "avg_cost", "realized_pnl"]
        return (int(n), float(q), float(avg), float(real)), pd.DataFrame([row], columns=cols)


LEDGER_SCHEMA = "strategy string, symbol string, orders bigint, quantity double, avg_cost double, realized_pnl double"


def ledger(
    fills: DataFrame, path: str, checkpoint: str, delay: str = "1 day", start: DataFrame | None = None, stretch_ms: int = DAY_MS
) -> StreamingQuery:
    """Ledger rows of a fill stream; the row with the most orders of a key is its state.

    `start` holds positions (one row a key, as `LEDGER_SCHEMA`) that the
    stream goes on from; it is read with the first batch only. Fills wait
    until the watermark has passed the end of their stretch.
    """
    df = _opened(fills, delay).withColumn("ts_ms", F.unix_millis("ts"))
    keys = ["strategy", "symbol"]
    out = df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=type("LedgerState", (LedgerState,), {"STRETCH_MS": stretch_ms})(), outputStructType=LEDGER_SCHEMA, outputMode="Append", timeMode="EventTime",
        initialState=None if start is None else start.groupBy(*keys),
    )
    return to_files(out, path, checkpoint)


def latest_positions(spark: SparkSession, path: str, start: DataFrame | None = None) -> DataFrame:
    """The newest ledger row of every key; keys without new fills keep the row they started with."""
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    return keep_last(rows if start is None else rows.unionByName(start.select(*rows.columns)), ["strategy", "symbol"], "orders")


# -- statistics -----------------------------------------------------------


def to_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update-mode sink: every micro-batch writes the rows it changed under its number; a repeated batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(df, checkpoint, "update").foreachBatch(write).start()


def newest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What `to_batches` last wrote of every key."""
    return keep_last(spark.read.parquet(path), keys, "batch").drop("batch")


class LatestRequests(StatefulProcessor):
    """Statistics of the newest requests of a route, from a ring of bounded size in the state."""

    STATE = "seen bigint, ts array<bigint>, request_id array<bigint>, response_time array<double>, status_code array<bigint>"
    LATEST = 1000

    def init(self, handle) -> None:
        self.ring = handle.getValueState("ring", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cols = ["ts_us", "request_id", "response_time", "status_code"]
        seen, kept = 0, []
        if self.ring.exists():
            seen, *held = self.ring.get()
            kept = [pd.DataFrame(dict(zip(cols, held)))]
        for pdf in rows:
            seen += len(pdf)
            kept = [pd.concat([*kept, pdf[cols]]).sort_values(cols[:2]).tail(self.LATEST)]
        ring = kept[0]
        self.ring.update((int(seen), *(ring[c].tolist() for c in cols)))
        t, s = ring["response_time"], ring["status_code"]
        classes = {f"n{k}": int((s // 100 == k).sum()) for k in (1, 2, 3, 4, 5)}
        p50, p95, p99 = (float(t.quantile(x)) for x in (0.5, 0.95, 0.99))
        row = {
            "method": key[0], "path": key[1], "seen": int(seen), "count": len(ring), "avg_response_time": float(t.mean()),
            "min_response_time": float(t.min()), "max_response_time": float(t.max()), "p50_response_time": p50,
            "p95_response_time": p95, "p99_response_time": p99, "success_rate": classes["n2"] / len(ring) * 100, **classes,
        }
        yield pd.DataFrame([row])

    def close(self) -> None:
        pass


ROUTE_SCHEMA = (
    "method string, path string, seen bigint, count bigint, avg_response_time double, min_response_time double, max_response_time double, "
    "p50_response_time double, p95_response_time double, p99_response_time double, success_rate double, "
    "n1 bigint, n2 bigint, n3 bigint, n4 bigint, n5 bigint"
)


def latest_requests(requests: DataFrame, path: str, checkpoint: str, latest: int = 1000) -> StreamingQuery:
    """Statistics of the `latest` newest requests per method and path (ts, then request_id), with exact percentiles.

    Every batch writes the routes it touched; no older request is kept.
    """
    df = requests.withColumns({"ts_us": F.unix_micros("ts"), "status_code": F.col("status_code").cast("bigint")})
    out = df.groupBy("method", "path").transformWithStateInPandas(
        statefulProcessor=type("LatestRequests", (LatestRequests,), {"LATEST": latest})(), outputStructType=ROUTE_SCHEMA,
        outputMode="Update", timeMode="None",
    )
    return to_batches(out, path, checkpoint)


def request_stats(requests: DataFrame, path: str, checkpoint: str, window: str = "5 minutes", delay: str = "10 minutes") -> StreamingQuery:
    """Request statistics per route and tumbling window; percentiles are approximate here."""
    t, s = F.col("response_time"), F.col("status_code")
    pct = F.percentile_approx(t, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = (
        _opened(requests, delay)
        .groupBy(F.window("ts", window).alias("w"), "method", "path")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(t).alias("avg_response_time"),
            F.min(t).alias("min_response_time"),
            F.max(t).alias("max_response_time"),
            (F.count_if((s >= 200) & (s < 300)) / F.count(F.lit(1)) * 100).alias("success_rate"),
            pct.alias("percentiles"),
        )
    )
    out = out.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"]
    )
    return to_files(out, path, checkpoint)


def error_counts(
    events: DataFrame, path: str, checkpoint: str, window: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour", ident: str = "event_id"
) -> StreamingQuery:
    """Errors in a sliding day, windows that are still open included; an event sent again within `delay` counts once."""
    out = (
        events.where(F.col("level").isin("error", "critical"))
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark([ident])
        .groupBy(F.window("ts", window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("errors"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "errors")
    )
    return to_batches(out, path, checkpoint)


class TaskProgress(StatefulProcessor):
    """Counts of a task's outcomes; they end once no outcome has come for `IDLE_MS` of event time."""

    STATE = "completed bigint, failed bigint, total bigint, last_ms bigint"
    IDLE_MS = DAY_MS

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, failed, total, last = self.counts.get() if self.counts.exists() else (0, 0, 0, 0)
        for pdf in rows:
            done += int((pdf["outcome"] == "completed").sum())
            failed += int((pdf["outcome"] == "failed").sum())
            total += len(pdf)
            last = max(last, int(pdf["ts_ms"].max()))
        self.counts.update((done, failed, total, last))
        self.handle.registerTimer(last + self.IDLE_MS)
        yield pd.DataFrame({"task_id": [key[0]], "symbols_completed": [done], "symbols_failed": [failed], "symbols_total": [total]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers set before a later outcome find the task alive
        if self.counts.exists() and self.counts.get()[3] + self.IDLE_MS <= timerValues.getCurrentWatermarkInMs():
            self.counts.clear()
        yield from ()

    def close(self) -> None:
        pass


PROGRESS_SCHEMA = "task_id bigint, symbols_completed bigint, symbols_failed bigint, symbols_total bigint"


def sync_progress(
    outcomes: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", idle_ms: int = DAY_MS, ident: str = "event_id"
) -> StreamingQuery:
    """Progress per task (task_id, outcome, ts, `ident`), written as it changes.

    An outcome sent again within `delay` counts once; a task without outcomes
    for `idle_ms` has ended and its state is dropped, a later outcome begins a new run.
    """
    df = outcomes.withWatermark("ts", delay).dropDuplicatesWithinWatermark([ident]).withColumn("ts_ms", F.unix_millis("ts"))
    out = df.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=type("TaskProgress", (TaskProgress,), {"IDLE_MS": idle_ms})(), outputStructType=PROGRESS_SCHEMA,
        outputMode="Update", timeMode="EventTime",
    )
    return to_batches(out, path, checkpoint)


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every task, with progress in percent and status."""
    return progress(newest_rows(spark, path, ["task_id"]))
