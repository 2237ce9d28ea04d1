"""The prefix trie of conversations, held against plain sets of prefixes."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from barloom.llm.conversation_trie import DoubleArray, numbered, trie, turns


def brute(seqs: dict[int, tuple]) -> set:
    """seqs: conversation -> ((role, text), ...)"""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = set()
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(y[:-1] == x for y in members if y)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in own if seqs[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        kids = sum(1 for x in members if x and x[:-1] == node)
        out.add((min(own), len(node), parent, len(own), kids, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frames(spark, seqs):
    rows = [(c, k, r, t) for c, s in seqs.items() for k, (r, t) in enumerate(s)]
    own = numbered(turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)))
    return spark.createDataFrame([(c,) for c in seqs], "conv_id long"), own


def made(seed: int, n: int, most: int, kinds: int) -> dict[int, tuple]:
    r = random.Random(seed)
    seqs = {c: tuple((r.choice("ua"), "w " * r.randrange(kinds)) for _ in range(r.randint(0, most))) for c in range(n)}
    for c in range(n, 2 * n):  # copies, beginnings and longer forms of others
        s = seqs[r.randrange(n)]
        seqs[c] = s + s if r.random() < 0.3 else s[: r.randint(0, len(s))]
    return seqs


@pytest.mark.parametrize("segment,shard", [(2, 5), (3, 1), (2, 1 << 17), (64, 7), (64, 1 << 17)])
def test_trie_equals_plain_prefixes(spark, segment, shard):
    seqs = made(segment + shard, 40, 7, 2)
    got = [tuple(r) for r in trie(*frames(spark, seqs), segment=segment, shard=shard).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(seqs)


def test_one_conversation_of_many_turns_and_many_equal_ones(spark):
    long = tuple(("u", f"t{k}") for k in range(300))
    seqs = {1: long, 2: long[:200], 3: long[:150] + (("u", "x y"),)} | {c: long[:3] for c in range(10, 200)} | {500: ()}
    got = [tuple(r) for r in trie(*frames(spark, seqs), segment=16, shard=50).collect()]
    assert set(got) == brute(seqs) and len(got) == 302


def test_double_array_transitions():
    r = random.Random(5)
    t = DoubleArray(4)
    want, level = {}, [0]
    for _ in range(4):
        pairs = [(p, c) for p in level for c in sorted(r.sample(range(200), r.randint(0, 9)))]
        if not pairs:
            break
        a, b = (np.array(x) for x in zip(*pairs))
        level = t.add(a, b).tolist()
        want |= dict(zip(pairs, level))
    assert len(set(want.values())) == len(want)
    for s in {0, *want.values()}:
        got = t.step(np.full(220, s), np.arange(220))
        assert [want.get((s, c), -1) for c in range(220)] == got.tolist()


def test_odd_rows(spark):
    rows = [
        (5, None, "u", "b", "k", 1),
        (5, 0, None, None, "k", 1),
        (5, 0, None, None, "k", 1),
        (5, 1, "u", "a " * 50_000, "k", 1),
        (None, 1, "u", "lost", "k", 1),
        (6, None, "u", "b", None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, seg int")
    own = numbered(turns(df))
    got = {tuple(r) for r in trie(own.select("conv_id").distinct(), own).collect()}
    assert got == brute({5: (("u", "b"), ("", ""), ("", ""), ("u", "a " * 50_000)), 6: (("u", "b"),)})
    none = numbered(turns(df.limit(0)))
    assert trie(none.select("conv_id").distinct(), none).count() == 0
