"""Fingerprints by consistent weighted sampling, held against plain Jaccard and a row-by-row version."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import catalog
from barloom.llm.weighted_sampling import Sampler, bag, edited_likeness, fingerprints, likeness

from .conftest import odd_rows, prose


def jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / sum((a | b).values())


@pytest.mark.parametrize("width", [1, 2])
def test_collisions_estimate_generalised_jaccard(width):
    sampler = Sampler(2048, width)
    words = prose(7, 300).split()
    for keep in (20, 150, 290):
        one = " ".join(words) + " in the" * 40
        two = " ".join(words[:keep] + prose(8, 300 - keep).split()) + " in the" * 25
        got = float((sampler(one) == sampler(two)).mean())
        assert abs(got - jaccard(bag(one, width), bag(two, width))) < 0.04
    single = Sampler(2048)
    assert abs(float((single.of_bag({b"a": 1}) == single.of_bag({b"a": 4})).mean()) - 0.25) < 0.04


def test_a_small_memory_changes_nothing():
    texts = [prose(k, 400) for k in range(4)]
    large, small = Sampler(64), Sampler(64, room=1)
    assert all((large(t) == small(t)).all() for t in texts + texts)


def rows_of(docs, sampler):
    """(doc_id, text) in order -> expected rows."""
    out = []
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (sampler(x) for x in (t, edited, after))
        hexes = [x.tobytes().hex() for x in (a, b)]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *hexes, float((a == b).mean()), float((a == c).mean())))
    return out


def test_query_equals_row_by_row(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in catalog.queries()["op13_fingerprints"](spark, sf).collect())
    assert got == rows_of(docs, Sampler())
    near, following = np.mean([r[5] for r in got]), np.mean([r[6] for r in got])
    assert near > 0.3 and near > following + 0.1


def test_odd_rows(spark, odd, none):
    got = edited_likeness(odd, samples=32).collect()
    assert len(got) == len(odd_rows()) and got[0].__fields__[0] == "doc_id"
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows())
    texts = {(i, len(t or "")): t or "" for i, t, *_ in odd_rows()}
    sampler = Sampler(32)
    for r in got:
        assert r.fingerprint == sampler(texts[r.doc_id, r.n_chars]).tobytes().hex()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    empty = {r.fingerprint for r in got if not texts[r.doc_id, r.n_chars].split()}
    assert empty == {"0000" * 32}
    ids = [r for r in got if r.doc_id in (5, 6)]
    assert ids[0].fingerprint == ids[1].fingerprint
    assert edited_likeness(none).count() == 0 and fingerprints(none).count() == 0


def test_single_row_follows_itself(spark):
    (r,) = edited_likeness(spark.createDataFrame([(1, "ab cd ef")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"ab cab c").hexdigest() and r.near_next == 1.0


def test_likeness_of_columns(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c e"), (3, "x")], "doc_id long, text string")
    prints = fingerprints(df)
    pair = prints.alias("p").join(prints.alias("q"), "doc_id").select(likeness("p.fingerprint", "q.fingerprint").alias("x"))
    assert {r.x for r in pair.collect()} == {1.0}
    got = {r.doc_id: r.fingerprint for r in prints.collect()}
    want = np.mean([got[1][k : k + 4] == got[2][k : k + 4] for k in range(0, 512, 4)])
    row = spark.createDataFrame([(got[1], got[2])], "a string, b string").select(likeness("a", "b").alias("x")).first()
    assert row.x == pytest.approx(want) and 0.4 < want < 0.8


def test_only_a_slice_of_a_batch_becomes_strings():
    import tracemalloc

    import pyarrow as pa

    from barloom.llm.common import text_runs

    texts = [None, "", "é" * 9000, *(f"{k:09d}" * 300 for k in range(8000)), "x" * 3_000_000, None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    want, at, most = [t or "" for t in texts], 0, 0
    tracemalloc.start()
    for some, held in text_runs([batch, batch.slice(5, 0)], "text", 1 << 20):
        assert held == want[at : at + len(some)] and some.column(0)[0].as_py() == at
        assert len(held) == 1 or sum(map(len, held)) < 5e6
        at += len(held)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == len(texts) and most < 10e6
