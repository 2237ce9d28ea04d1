"""As-of joins held against a plain search."""

import datetime as dt
import random

import pytest

from barloom.operators.asof import asof_join
from barloom.operators.ledger import asof_close

D = dt.date(2020, 1, 1)


def day(k):
    return None if k is None else D + dt.timedelta(k)


def plain(orders, bars, tolerance):
    out = []
    for i, s, k in orders:
        met = [(b, c) for z, b, c in bars if s is not None and k is not None and z == s and b is not None and b <= k]
        best = max(met, default=None)
        ok = best is not None and (tolerance is None or k - best[0] <= tolerance)
        out.append((i, s, day(k), *((best[1], day(best[0])) if ok else (None, None))))
    return out


@pytest.mark.parametrize("tolerance", [None, 5, 0])
def test_one_symbol_holds_all_rows(spark, tolerance):
    r = random.Random(1)
    orders = [(i, "A", r.randrange(900)) for i in range(700)] + [(900, None, 5), (901, "A", None), (902, "Z", 3)]
    bars = [("A", k, float(r.randrange(50))) for k in range(100, 800) if r.random() < 0.3]
    bars += [("A", 300, 1.0), ("A", 300, 99.0), (None, 5, 7.0), ("A", None, 8.0), ("B", 10, 9.0)]
    o = spark.createDataFrame([(i, s, day(k)) for i, s, k in orders], "id int, symbol string, date date").repartition(5)
    b = spark.createDataFrame([(s, day(k), c) for s, k, c in bars], "symbol string, on date, close double").repartition(3)
    got = asof_join(o, b, ["symbol"], "date", ["close"], right_at="on", tolerance_days=tolerance, matched_at="bar_date")
    assert got.columns == ["id", "symbol", "date", "close", "bar_date"]
    assert sorted(map(tuple, got.collect()), key=lambda x: x[0]) == sorted(plain(orders, bars, tolerance), key=lambda x: x[0])


def test_ranges_without_bars_take_what_was_carried(spark):
    o = spark.createDataFrame([(i, "A", day(10 + i)) for i in range(2000)], "id int, symbol string, date date")
    b = spark.createDataFrame([("A", D, 3.5)], "symbol string, date date, close double")
    assert asof_close(o, b, None).where("last_close = 3.5").count() == 2000
    assert asof_close(o, b, 5).where("last_close IS NULL").count() == 2000
    assert asof_close(o.limit(0), b).count() == 0 and asof_close(o, b.limit(0)).where("last_close IS NULL").count() == 2000
