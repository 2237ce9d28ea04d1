"""Spelling variants, held against plain comparison of all words."""

import random
from collections import Counter

import numpy as np
import pytest

from barloom.llm.spelling import BidirectionalIndex, near_words, runs, variants, vocabulary, without
from pyspark.sql import functions as F


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def made_words(seed: int, n: int, letters: str, most: int) -> list[str]:
    r = random.Random(seed)
    return sorted({"".join(r.choices(letters, k=r.randint(1, most))) for _ in range(n)})


@pytest.mark.parametrize("letters", ["ab", "abcdé漢\x00", "abcdefghijklmnopqrstuvwxyzàéüß"])
def test_intervals_locate_patterns(letters):
    words = made_words(1, 120, letters, 7)
    index = BidirectionalIndex(words)
    for k, w in enumerate(words):
        codes = [1, *(np.searchsorted(index.alphabet, [ord(c) for c in w]) + 2), 1]
        near, far, size = np.array([0]), np.array([0]), np.array([index.size])
        mid = len(codes) // 2
        for c in codes[mid::-1]:
            near, far, size = index.extend(False, near, far, size, np.array([c]))
        for c in codes[mid + 1 :]:
            far, near, size = index.extend(True, far, near, size, np.array([c]))
        assert size[0] == 1 and near[0] - 1 == k


@pytest.mark.parametrize("largest", [40, 1 << 18])
@pytest.mark.parametrize("letters,most", [("ab", 9), ("abcé漢", 6)])
def test_all_pairs_one_edit_apart(spark, letters, most, largest):
    words = made_words(2, 220, letters, most)
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long")
    got = [tuple(r) for r in near_words(df, largest).collect()]
    want = [(a, b, k) for a in words for k, b in enumerate(words) if one_edit(a, b)]
    assert sorted(got) == sorted(want)


def brute(counts: dict[str, int]) -> set:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def test_forms_and_roots(spark):
    r = random.Random(3)
    counts = {w: 6 ** r.randint(0, 6) for w in made_words(4, 300, "abc", 6)}
    counts |= {"aaaaaaaa": 3, "aaaaaaa": 15, "aaaaaab": 15}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(x) for x in variants(df, largest=300).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute(counts)
    with pytest.raises(ValueError):
        variants(df, ratio=1)


def test_runs_and_vocabulary_of_odd_rows(spark, odd, none):
    from .conftest import odd_rows
    import re

    want = Counter()
    for _, t, *_ in odd_rows():
        want.update("".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    words = runs(odd).select(F.col("run").alias("word"))
    assert dict(words.groupBy("word").count().collect()) == want
    got = variants(vocabulary(words, 6, 3))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 6 and n >= 3}
    assert variants(vocabulary(runs(none).select(F.col("run").alias("word")))).count() == 0


def test_very_long_words_and_deleted_letters(spark):
    long = "ab" * 2000
    df = spark.createDataFrame([(long, 5), (long + "a", 50), ("b" + long, 7), ("x" * 3000, 9)], "word string, n long")
    got = {r.word: (r.root, r.n_near) for r in variants(df).collect()}
    assert got[long] == (long + "a", 2) and got["x" * 3000] == ("x" * 3000, 0)
    row = spark.createDataFrame([("aébc", 1)], "run string, p long")
    assert row.select(without("run", F.col("p"))).first()[0] == "abc"
