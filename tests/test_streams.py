"""Streaming jobs on small frames: order, state that ends, rows sent again, files of one batch."""

import datetime as dt
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.session import scratch_path
from barloom.sources.store import BarStore, update_table
from barloom.streaming import jobs

T = dt.datetime(2024, 1, 1)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def land(spark, df, path, start):
    df.coalesce(1).write.mode("append").parquet(path)
    run = start(spark.readStream.schema(df.schema).parquet(path))
    run.awaitTermination()
    assert run.exception() is None


@pytest.fixture()
def paths(spark):
    return lambda: [scratch_path(spark, x) for x in ("in", "checkpoint", "out")]


def test_ledger_goes_on_from_positions_and_takes_fills_in_order(spark, paths):
    src, cp, out = paths()
    start = spark.createDataFrame([("s", "A", 2, 10.0, 5.0, 1.0), ("s", "B", 1, 3.0, 2.0, 0.0)], jobs.LEDGER_SCHEMA)
    schema = "strategy string, symbol string, ts timestamp, s1 long, s2 long, side string, quantity double, price double, closing boolean"
    row = lambda m, n, side, q, p, s="A": ("s", s, at(m), n, 0, side, q, p, False)
    steps = [[row(5, 1, "SELL", 4.0, 8.0), row(3, 0, "BUY", 10.0, 7.0)], [row(5, 0, "BUY", 4.0, 1.0), row(4000, 0, "BUY", 1.0, 9.0, "C")]]
    frames = [spark.createDataFrame(x, schema) for x in steps]
    frames.append(jobs.closing_marker(frames[0].union(frames[1])))
    with jobs.rocksdb_state(spark):
        for f in frames:
            land(spark, f, src, lambda s: jobs.ledger(s, out, cp, start=start, delay="1 hour", stretch_ms=60_000))
    got = {r.symbol: r for r in jobs.latest_positions(spark, out, start).collect()}
    # 10 at 5, then 10 at 7 -> 20 at 6; 4 at 1 -> 24 at 124/24; 4 sold at 8
    avg = (20 * 6.0 + 4.0) / 24
    assert got["A"].orders == 5 and got["A"].quantity == 20 and got["A"].avg_cost == pytest.approx(avg)
    assert got["A"].realized_pnl == pytest.approx(1.0 + 4 * (8 - avg))
    assert tuple(got["B"])[2:] == (1, 3.0, 2.0, 0.0) and got["C"].orders == 1


def test_latest_requests_keep_a_bounded_ring(spark, paths):
    src, cp, out = paths()
    schema = "method string, path string, ts timestamp, request_id long, response_time double, status_code int"
    rows = [("GET", "/a", at(i % 7), i, float(i), 200 if i % 3 else 500) for i in range(50)]
    with jobs.rocksdb_state(spark):
        for part in (rows[:20], rows[20:]):
            land(spark, spark.createDataFrame(part, schema), src, lambda s: jobs.latest_requests(s, out, cp, latest=8))
    (r,) = jobs.newest_rows(spark, out, ["method", "path"]).collect()
    want = sorted(x[4] for x in sorted(rows, key=lambda x: (x[2], x[3]))[-8:])
    assert r.seen == 50 and r["count"] == 8 and r.min_response_time == want[0] and r.max_response_time == want[-1]
    assert r.p50_response_time == pytest.approx((want[3] + want[4]) / 2)


def test_progress_counts_resent_outcomes_once_and_ends(spark, paths):
    src, cp, out = paths()
    schema = "task_id long, event_id long, outcome string, ts timestamp"
    a, b = (1, 10, "completed", at(0)), (1, 11, "failed", at(1))
    late = [(2, 20, "completed", at(3000))]
    steps = [[a, b], [a, (1, 12, "completed", at(2))], late, [(2, 21, "pending", at(3001))], [(1, 13, "completed", at(3002))]]
    run = lambda s: jobs.sync_progress(s, out, cp, delay="1 hour", idle_ms=3_600_000)
    with jobs.rocksdb_state(spark):
        for k, part in enumerate(steps):
            land(spark, spark.createDataFrame(part, schema), src, run)
            if k == 1:
                (r,) = jobs.latest_progress(spark, out).collect()
                assert (r.symbols_completed, r.symbols_failed, r.symbols_total, r.status) == (2, 1, 3, "failed")
    got = {r.task_id: r.symbols_total for r in jobs.latest_progress(spark, out).collect()}
    assert got == {1: 1, 2: 2}  # the first run of task 1 had ended


def test_open_error_windows_are_there_and_resent_errors_count_once(spark, paths):
    src, cp, out = paths()
    schema = "event_id long, level string, ts timestamp"
    rows = [(k, "error" if k % 2 else "info", at(k)) for k in range(60)]
    for part in (rows, rows[30:]):
        land(spark, spark.createDataFrame(part, schema), src, lambda s: jobs.error_counts(s, out, cp, "2 hours", "1 hour"))
    got = {r.window_start: r.errors for r in jobs.newest_rows(spark, out, ["window_start", "window_end"]).collect()}
    assert got == {T: 30, T - dt.timedelta(hours=1): 30}


def test_the_later_file_wins_whatever_its_size(spark, paths):
    src, cp, out = paths()
    day = dt.date(2024, 1, 2)
    small = spark.createDataFrame([("A", day, 1.0)], "symbol string, date date, close double")
    large = spark.createDataFrame([("A", day, 2.0)] + [(f"S{k}", day, float(k)) for k in range(5000)], small.schema)
    small.coalesce(1).write.parquet(src)
    time.sleep(1.1)
    large.coalesce(1).write.mode("append").parquet(src)
    streamed, batch = BarStore(spark, out), BarStore(spark, out + "-batch")
    run = jobs.merge_bars(spark.readStream.schema(small.schema).parquet(src), streamed, cp)
    run.awaitTermination()
    batch.merge(spark.read.parquet(src))
    for store in (streamed, batch):
        assert store.read().where("symbol = 'A'").select("close").collect() == [(2.0,)]
        assert store.read().columns == ["symbol", "date", "close"]
    current = spark.createDataFrame([("A", 0.0), ("Z", 7.0)], "symbol string, close double")
    changed = update_table(current, spark.read.parquet(src).select("symbol", "close"), ["symbol"])
    assert dict(changed.collect()) == {"A": 2.0, "Z": 7.0}
    with_ties = spark.createDataFrame([("Q", day, 1.0), ("Q", day, 3.0)], small.schema).coalesce(1)
    batch.merge(with_ties)
    assert batch.read().where(F.col("symbol") == "Q").select("close").collect() == [(3.0,)]


class _Map(dict):
    """A map state that counts calls."""

    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def _count(self):
        self.calls.append(1)

    def containsKey(self, k):
        self._count()
        return k in self

    def getValue(self, k):
        self._count()
        return self[k]

    def updateValue(self, k, v):
        self._count()
        self[k] = v

    def removeKey(self, k):
        self._count()
        del self[k]

    def iterator(self):
        self._count()
        return iter(list(self.items()))

    def keys(self):
        self._count()
        return iter(list(super().keys()))


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v


class _Handle:
    def __init__(self, calls):
        self.calls, self.timers = calls, set()

    def getMapState(self, *a):
        return _Map(self.calls)

    def getValueState(self, *a):
        return _Value()

    def registerTimer(self, ms):
        self.calls.append(1)
        self.timers.add(ms)


class _Seen(jobs.OrderedProcessor):
    FIELDS = (("ts_ms", "bigint"), ("v", "bigint"))
    STATE = "n bigint"
    STRETCH_MS, CHUNK = 10, 4

    def advance(self, key, state, rows):
        return ((state or (0,))[0] + len(rows),), pd.DataFrame(rows, columns=["ts_ms", "v"])


def test_buffered_rows_come_once_in_order_with_few_state_calls():
    rng = np.random.default_rng(4)
    calls, got, sent = [], [], []
    p = _Seen()
    p.init(_Handle(calls))

    def expire(mark):
        while due := sorted(t for t in p.handle.timers if t <= mark):
            p.handle.timers.discard(due[0])
            for out in p.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None):
                got.extend(out.itertuples(index=False, name=None))

    mark = -1
    for step in range(12):  # rows up to 80 stretches ahead, watermarks in the middle of stretches
        ts = mark + 1 + rng.integers(0, 800, 30)
        rows = [(int(t), 100 * step + i) for i, t in enumerate(ts)]
        sent += rows
        list(p.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=["ts_ms", "v"])]), None))
        mark += int(rng.integers(5, 120))
        expire(mark)
        bound = (mark + 1) // 10 * 10
        assert got == sorted(r for r in sent if r[0] < bound)
        # rows of a stretch that is over are late: the watermark drops them
        assert len(p.handle.timers) >= 1
        mark = bound + 9
        expire(mark)
    expire(10**6)
    assert got == sorted(sent) and not p.counts and not p.chunks and p.value.held == (len(sent),)

    calls.clear()
    p.CHUNK = 1000
    list(p.handleInputRows(("k",), iter([pd.DataFrame([(2 * 10**6 + 10 * i, i) for i in range(80)], columns=["ts_ms", "v"])]), None))
    expire(10**8)
    assert len(calls) < 80  # one stretch each: 80 rows took over 500 calls
