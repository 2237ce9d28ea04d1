import numpy as np
import pytest

from barloom.llm import ann


def brute(rows, k, every):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % every == 0:
            out[i] = sorted(((-(q @ v), j) for j, v in fine if j != i))[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, block string").repartition(3)


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(3000, 24)) * r.uniform(0.5, 2, (3000, 1))
    rows = [(k, np.float32(x).tolist()) for k, x in enumerate(v)]
    got = ann.nearest(frame(spark, [(k, x, 0, "s", "b") for k, x in rows]), k=20, every=50, block=700).collect()
    want = brute(rows, 20, 50)
    hits = 0
    for q, best in want.items():
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        assert [x["rank"] for x in mine] == list(range(1, 21)) and all(x.vec_id != q for x in mine)
        assert [(-x.score, x.vec_id) for x in mine] == sorted((-x.score, x.vec_id) for x in mine)
        for x in mine:
            assert x.score == pytest.approx(float(np.dot(np.array(rows[q][1]), np.array(rows[x.vec_id][1]))), rel=1e-12, abs=1e-12)
        hits += len({j for _, j in best} & {x.vec_id for x in mine})
    assert hits / sum(map(len, want.values())) >= 0.9


def test_odd_vectors(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(0, one), (1, one), (2, one), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (None, one), (8, []), (9, [0.5, 0.5, 0.5]), (1, one)]
    got = ann.nearest(frame(spark, [(k, x, 0, "s", "b") for k, x in rows]), k=3, every=5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 1, 1.25), (0, 2, 1, 1.25), (0, 3, 2, 1.25)]
    with pytest.raises(ValueError):
        ann.nearest(frame(spark, [(0, one, 0, "s", "b"), (1, [1.0], 0, "s", "b")]))


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty).count() == 0
    alone = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(alone).count() == 0


def test_a_repeated_query_is_searched_once(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(1, 40)]
    asked = [(0, [1.0, 0.0, 0.0, 0.0])] * 2 + [(0, [2.0, 0.0, 0.0, 0.0])]
    got = ann.nearest(frame(spark, [(k, x, 0, "s", "b") for k, x in rows + asked]), k=5, every=100).collect()
    want = sorted(((-v[0], k) for k, v in rows))[:5]
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(j + 1, k) for j, (_, k) in enumerate(want)]
