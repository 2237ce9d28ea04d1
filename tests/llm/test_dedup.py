import hashlib
import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom import session
from barloom.llm import components, exact_dedup, simhash, similar, suffix_dedup

from .conftest import odd_rows, prose


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# exact copies


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_copies(odd, keep):
    got = exact_dedup.copies(odd, keep, pieces=3).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in groups[text] if i is not None]
        assert r.keep_id == ((min if keep == "smallest" else max)(known) if known else None)
        assert r.group_size == len(groups[text])
    assert sum(r.kept for r in got) == len(groups)


def test_exact_copies_normalised(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = exact_dedup.copies(df, normalise=F.lower)
    assert rows_of(got.select("doc_id", "keep_id", "kept")) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    with pytest.raises(ValueError):
        exact_dedup.copies(df, "first")


def test_drop_copies_keeps_columns_and_one_row_of_each_text(odd, none):
    got = exact_dedup.drop_copies(odd)
    assert got.columns == odd.columns
    texts = Counter(r.text or "" for r in got.select("text").collect())
    assert set(texts) == {t or "" for _, t, *_ in odd_rows()} and max(texts.values()) == 1
    assert exact_dedup.drop_copies(none).count() == exact_dedup.copies(none).count() == 0


def test_one_text_with_a_third_of_the_rows_is_dealt_out(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.copies(df)
    assert got.where("kept").count() == 2001
    assert got.where("group_size = 1000 and keep_id = 0").count() == 1000


# SimHash


def brute_fingerprint(text, words=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = text.encode().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_near_copies_against_brute_force(odd, none):
    got = simhash.near_copies(odd).collect()
    rows = odd_rows()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    roots = brute_components(fps, 4)
    least = {}
    for (i, *_), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{fp:016x}", least.get(r)) for (i, *_), fp, r in zip(rows, fps, roots)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert simhash.near_copies(none).count() == 0


def test_links_miss_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for n in range(1, 7):
            x = b
            for k in rng.choice(64, n, replace=False).tolist():
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.root for r in components.components(simhash.link(df)).collect()}
    label = [found.get(s, s) for s in signed]
    want = brute_components(fps, 4)
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert groups(label) == groups(want)


def test_links_of_a_crowded_anchor(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOMES", 16)
    near = [sum(1 << k for k in range(b)) ^ (1 << (40 + c)) for b in range(3) for c in range(20)]
    df = spark.createDataFrame([(x,) for x in sorted(set(near))], "fp long")
    found = components.components(simhash.link(df)).collect()
    assert {r.root for r in found} == {min(near)} and len(found) == len(set(near))


def test_links_of_two_lanes_miss_nothing(spark):
    rng = np.random.default_rng(7)
    pairs = []
    for spread in range(60):
        a = int.from_bytes(rng.bytes(16), "little")
        n = (20, 20, 20, 19, 21)[spread % 5]
        # two bits at least in each of 8, 7 and 6 equal segments, or anywhere
        cuts = (8, 7, 6, 1)[spread % 4]
        at = [128 * k // cuts + int(x) for k in range(cuts) for x in rng.choice(128 // cuts, 2, replace=False)]
        at += rng.permutation([k for k in range(128) if k not in at])[: n - len(at)].tolist()
        pairs.append((a, a ^ sum(1 << k for k in at), n))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    rows = [(signed(x & (1 << 64) - 1), signed(x >> 64)) for a, b, _ in pairs for x in (a, b)]
    df = spark.createDataFrame(rows, "fp long, fp1 long")
    nodes = {(r.fp, r.fp1): r.node for r in df.selectExpr("*", "xxhash64(fp, fp1) AS node").collect()}
    found = {frozenset(r) for r in simhash.link(df, 20, 2).collect()}
    want = {frozenset((nodes[a], nodes[b])) for a, b, (*_, n) in zip(rows[::2], rows[1::2], pairs) if n <= 20}
    assert found == want and len(want) == 48


@pytest.mark.parametrize("distance", [0, 3, 7, 8, 20])
def test_thresholds_of_the_segments_cover_the_distance(distance):
    limits = [x[3] for lane in simhash.covering(distance, 2) for x in lane]
    assert sum(t + 1 for t in limits) == distance + 1


def shingle_set(text, words=5):
    parts = text.encode().lower().split()
    return {b" ".join(parts[k : k + words]) for k in range(max(len(parts) - words + 1, 1))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_similar(texts, least=0.8):
    """Component number of each text; texts are linked at a Jaccard similarity of `least` of their shingles."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in combinations(range(len(texts)), 2):
        if similarity(sets[i], sets[j]) >= least:
            i, j = sorted((find(i), find(j)))
            root[j] = i
    return [find(k) for k in range(len(texts))]


def edited(rng, words, share):
    return [f"n{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def test_similar_groups_recall_against_brute_force(spark):
    """Pairs on both sides of 0.8; none below is linked, at least 0.9 of those above are."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(150):
        base = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(60, 300))]
        texts += [" ".join(base), " ".join(edited(rng, base, rng.choice([0.005, 0.015, 0.025, 0.04])))]
    sets = [shingle_set(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.similar_groups(df).collect()}
    above = [k for k in range(0, 300, 2) if similarity(sets[k], sets[k + 1]) >= 0.8]
    linked = [k for k in range(0, 300, 2) if got[k + 1] == k]
    assert set(linked) <= set(above) and len(above) > 60
    assert len(linked) >= 0.9 * len(above)
    assert all(got[k] == k for k in range(0, 300, 2))


def test_similar_groups_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOMES", 32)
    monkeypatch.setattr(simhash, "HOMES", 32)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(edited(rng, base, 0.01)) for _ in range(200)] + ["other words stand here", "Other  WORDS stand here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.component_id for r in similar.similar_groups(df).sort("doc_id").collect()]
    assert got == brute_similar(texts)


@pytest.mark.parametrize("homes", [4096, 8])
def test_similar_groups_miss_no_link(spark, monkeypatch, homes):
    """Hardly any anchors: the exact join finds what they miss, in hot groups too."""
    monkeypatch.setattr(similar, "MEETINGS", 0.01)
    monkeypatch.setattr(similar, "HOMES", homes)
    monkeypatch.setattr(simhash, "HOMES", homes)
    rng = np.random.default_rng(5)
    texts = ["", "one", "two words", "Two WORDS"]
    for size in (5, 9, 40, 300):
        for _ in range(6):
            base = [f"w{k}" for k in rng.integers(0, 3000, size)]
            texts += [" ".join(edited(rng, base, share)) for share in (0, 0.01, 0.02, 0.03, 0.04, 0.06)]
            texts += [" ".join(base + base[: size // 5]), " ".join(base[: size - size // 6])]
    # unrelated texts with many common shingles
    line = [f"c{k}" for k in range(60)]
    texts += [" ".join(line + [f"v{j}x{k}" for k in range(rng.integers(5, 60))]) for j in range(60)]
    # exactly 0.8: 4 of 5 shingles shared
    texts += ["a b c d e f g h", "a b c d e f g h i", "p q r s t u v w x", "p q r s t u v w y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.component_id for r in similar.similar_groups(df).sort("doc_id").collect()]
    assert got == brute_similar(texts)
    assert len(set(got)) < len(texts) - 40


@pytest.mark.parametrize("order", ["none", "reversed", "other shingles", "sampled"])
def test_similar_groups_do_not_depend_on_the_order_of_shingles(spark, monkeypatch, order):
    """Whichever shingles are known as common, none, wrong ones or those of few texts: the links are those of brute force."""
    rng = np.random.default_rng(8)
    line = [f"c{k}" for k in range(60)]
    texts = [" ".join(line + [f"v{j}x{k}" for k in range(rng.integers(5, 40))]) for j in range(30)]
    for _ in range(10):
        base = [f"w{k}" for k in rng.integers(0, 3000, 60)]
        texts += [" ".join(edited(rng, base, share)) for share in (0, 0.02, 0.04)]
    counted = similar.common_shingles
    monkeypatch.setattr(similar, "MEETINGS", 0.01)
    if order == "sampled":
        monkeypatch.setattr(similar, "COUNTED", 10)
    else:
        change = {"none": lambda x: x[:0], "reversed": lambda x: x[::-1].copy(), "other shingles": lambda x: similar.shingles(texts[-1], 5).view(np.int64)}[order]
        monkeypatch.setattr(similar, "common_shingles", lambda *a: change(counted(*a)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.component_id for r in similar.similar_groups(df).sort("doc_id").collect()]
    assert got == brute_similar(texts) and len(set(got)) < len(texts)


def test_whole_sets_are_sent_for_likely_pairs_only(spark, monkeypatch):
    stored = {}

    def note(df, label="stage"):
        stored[label] = kept(df, label)
        return stored[label]

    kept = similar.cut_lineage
    monkeypatch.setattr(similar, "cut_lineage", note)
    rng = np.random.default_rng(9)
    texts = ["a b c d e f g h", "a b c d e f g h i", "", "one"]
    for size in (6, 12, 80, 400):
        for _ in range(4):
            base = [f"w{k}" for k in rng.integers(0, 5000, size)]
            texts += [" ".join(edited(rng, base, share)) for share in (0, 0.01, 0.02, 0.03)]
    sets = [shingle_set(t) for t in texts]
    every = list(combinations(range(len(texts)), 2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = similar.links(df, spark.createDataFrame(every, "u long, v long"), 5, 0.8)
    want = [(i, j) for i, j in every if similarity(sets[i], sets[j]) >= 0.8]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    likely = {tuple(r) for r in stored["likely"].collect()}
    assert set(want) <= likely
    assert not any(similarity(sets[i], sets[j]) < 0.1 for i, j in likely if min(len(sets[i]), len(sets[j])) > 50)


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    before = spark.conf.get(session.CLEANUP_CONF, None)
    there = files()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    df.write.parquet(str(tmp_path / "kept"))
    left = files() - there
    with session.without_old_shuffles(spark):
        df.write.parquet(str(tmp_path / "dropped"))
    deadline = time.time() + 20
    while (more := files() - there - left) and time.time() < deadline:
        time.sleep(0.2)
    assert left and not more
    assert spark.conf.get(session.CLEANUP_CONF, None) == before
    assert sorted(spark.read.parquet(str(tmp_path / "dropped")).collect()) == sorted(df.collect())


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    common = np.unique(rng.integers(0, 1000, 300))
    at = rng.permutation(len(common))
    for _ in range(300):
        both = rng.choice(1000, rng.integers(8, 200), replace=False)
        n = len(both)
        cut = rng.integers(0, n // 5 + 1)
        extra = rng.integers(0, n // 5 - cut + 1) if n // 5 > cut else 0
        a, b = np.unique(both[cut:]), np.unique(np.append(both, 1000 + np.arange(extra)))
        if len(a) / len(b) >= 0.8:
            mine, other = (set(similar.prefix(x, common, at, 0.8)) for x in (a, b))
            assert mine & other
            apart = sum(int(np.bitwise_count(x ^ y)) for x, y in zip(*(similar.parities(s).view(np.uint64) for s in (a, b))))
            assert apart <= len(b) - len(a)


def test_segments_grow_with_the_texts():
    few, many = (similar.segments_for(n, 0.8) for n in (1 << 16, 1 << 24))
    assert len(many[0]) == len(few[0]) + 8 and len(few) < len(many) < 5 * len(few)
    texts = np.random.default_rng(1).integers(0, 1 << 63, (50, 8), np.uint64)
    # equal and neighbouring words of a segment have anchors within one bit
    keys = similar.homes_of(texts, few)
    bits = np.unpackbits(texts.view(np.uint8).reshape(50, -1), axis=1, bitorder="little")
    for k, chosen in enumerate(few):
        word = (bits[:, chosen].astype(np.int64) << np.arange(len(chosen))).sum(axis=1)
        assert (np.bitwise_count((word ^ keys[:, k]) & (1 << 40) - 1) <= 1).all() and (keys[:, k] >> 40 == k).all()


def test_drop_similar_keeps_the_first(odd, none):
    got = similar.drop_similar(odd)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert got.columns == odd.columns
    assert 5 in ids and 6 not in ids and 7 not in ids and 9 not in ids and ids.count(None) == 2
    assert similar.drop_similar(none).count() == 0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (7, 7)] + [(100 + k, 101 + k) for k in range(40)]
    got = components.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {(r.node, r.root) for r in got} == {(k, 1) for k in range(1, 5)} | {(8, 8), (9, 8)} | {(100 + k, 100) for k in range(41)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# repeats


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.view(np.int8))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
    return out


def check_repeats(df, rows, length=200):
    got = suffix_dedup.remove_repeats(df, length).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows], length)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)


def test_repeats_of_odd_rows(odd, none):
    small = odd.where("doc_id is null or doc_id not between 5 and 7")
    check_repeats(small, [(i, t) for i, t, *_ in odd_rows() if i not in (5, 6, 7)])
    assert suffix_dedup.remove_repeats(none).count() == 0


def made_rows(seed):
    r = random.Random(seed)
    shared = [prose(k, r.randint(15, 120)) for k in range(6)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts.append(r.choice(shared) if r.random() < 0.5 else prose(1000 * seed + r.randint(0, 10**6), r.randint(1, 60)))
            if r.random() < 0.3:
                cut = r.randint(0, len(parts[-1]))
                parts[-1] = parts[-1][cut:] + "ü" + parts[-1][:cut]
        rows.append((k, "\n".join(parts)))
    return rows + [(60, "ab" * 300), (61, "ba" * 120), (62, "é" * 200)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_made_rows(spark, seed, monkeypatch):
    rows = made_rows(seed)
    if seed == 2:  # small blocks and pieces, and buckets that are too large to sort
        monkeypatch.setattr(suffix_dedup, "LARGEST", 3)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    texts = [prose(7, 3000).encode(), b"short", prose(8, 500).encode() * 3]
    whole = {(t, p): (g, a) for x in suffix_dedup.anchors(texts) for t, p, g, a in zip(*(y.tolist() for y in x))}
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 1000)
    parts = {(t, p): (g, a) for x in suffix_dedup.anchors(texts) for t, p, g, a in zip(*(y.tolist() for y in x))}
    assert whole and whole == parts


def test_repeated_suffixes_of_a_block():
    r = np.random.default_rng(0)
    rows = r.integers(97, 99, (300, 368)).astype(np.uint8)
    rows[100:200, 50:300] = rows[0, 50:300]
    bucket = np.repeat([0, 1, 2], 100)
    rows[250] = rows[210]
    first, end = r.integers(0, 60, 300), r.integers(300, 369, 300)
    got = suffix_dedup.repeated(bucket, rows, first, end)
    for b in range(3):
        at = np.flatnonzero(bucket == b)
        for j in range(169):
            fits = [k for k in at if first[k] <= j and end[k] >= j + 200]
            count = Counter(rows[k, j : j + 200].tobytes() for k in fits)
            assert [got[k, j] for k in at] == [k in fits and count[rows[k, j : j + 200].tobytes()] > 1 for k in at]
