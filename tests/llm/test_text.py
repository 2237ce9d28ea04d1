import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, licenses, mixing, quality, token_files, toxicity
from barloom.llm.tokenizer_files import BYTE_BPE, WORD_BPE

from .conftest import odd_rows, prose


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE), Tokenizer.from_file(WORD_BPE)


TEXTS = [
    "", "a", "aaaaaaaaaaaaa", " aaaaa aaa\n\n  x", "x<|endoftext|>y  <|endoftext|>", "it's WE'LL\x1c\x1d \x85 é　é 漢字 🙂🙂 12345 ½",
    " " * 50 + "a" + "\t" * 9, "<|endoftext|>", "don't. foo!? İstanbul ΣΑΣ ςx. a.b.c,, d;e; 3. x9. --.", "<|STARTOFTEXT|> <|startoftext|>", "abababababab cdcdcd",
]


def test_pair_index_equals_the_library(libraries):
    texts = TEXTS + [prose(k, 200) for k in range(5)]
    ours = bpe.codec(open(BYTE_BPE, encoding="utf-8").read())
    for t, raw in zip(texts, ours.encode(texts)):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == libraries[0].encode(t, add_special_tokens=False).ids
        assert ours.decode(ids) == libraries[0].decode(ids.tolist(), skip_special_tokens=False) == t


def test_round_trip(odd, none, libraries):
    got = bpe.round_trip(odd, BYTE_BPE, tuple(bpe.COLUMNS)).collect()
    want = []
    for i, t, *_ in odd_rows():
        ids = libraries[0].encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, ids, t or "", len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(none, BYTE_BPE).count() == 0


def test_words_encoder_equals_the_library(libraries):
    ours = token_files.encoder(open(WORD_BPE, encoding="utf-8").read())
    texts = TEXTS + [prose(k, 200) for k in range(5)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts)] == [libraries[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_known_words_take_little_memory(libraries, monkeypatch):
    import tracemalloc

    spec = open(WORD_BPE, encoding="utf-8").read()
    ours, letters = token_files.WordEncoder(spec), "abcdefghij"
    words = ["".join(letters[int(c)] for c in f"{k:06d}") + "." * (k % 2) for k in range(100_000)]
    tracemalloc.start()
    got = ours.encode([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held - sum(map(len, got)) < 4e6
    assert got[7] == np.array(libraries[1].encode(" ".join(words[7000:8000]), add_special_tokens=False).ids, "<u4").tobytes()
    # words that are forgotten and met again
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    ours, texts = token_files.WordEncoder(spec), [prose(k, 60) for k in range(8)] + TEXTS
    for some in (texts, texts[::-1], texts[:3], [], texts):
        want = [libraries[1].encode(t, add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(some)] == want


def test_token_files(odd, none, libraries):
    manifest = token_files.write(odd, WORD_BPE, end_id=1)
    got = token_files.read(manifest).orderBy("start").collect()
    start, ids_before = 0, []
    texts = {}
    for i, t, *_ in odd_rows():
        texts.setdefault(i, []).append(t or "")
    for r in got:
        assert r.start == start
        options = [libraries[1].encode(t, add_special_tokens=False).ids + [1] for t in texts[r.doc_id]]
        assert list(r.ids) in options and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
        ids_before.append(r.doc_id)
    known = [i for i in ids_before if i is not None]
    assert known == sorted(known) and ids_before[len(known) :] == [None, None] and len(got) == len(odd_rows())
    assert token_files.read(token_files.write(none, WORD_BPE)).count() == 0


def test_shards_are_read_frame_by_frame(tmp_path):
    data = [np.arange(n, dtype="<u4").tobytes() for n in (1, 5, 30, 300, 2, 0, 4)]
    path = f"file://{tmp_path}/sub/a.zst"
    w = token_files.ShardWriter(path, frame_bytes=100)
    for k, x in enumerate(data):
        w.add(k, x)
    w.close()
    r = token_files.ShardReader(path)
    assert [r.ids(k) for k in range(len(data))] == data and len(r.frames) == 4
    assert r.find(3)[0].tolist() == list(range(300)) and r.find(99) == []
    r.close()
    import zstandard

    raw = open(f"{tmp_path}/sub/a.zst", "rb").read()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as s:  # any zstd reader passes over the tables
        assert s.read() == b"".join(data)
    spoilt = bytearray(raw)
    spoilt[-9 - 12 * 4 + 8] ^= 1  # a stored checksum
    (tmp_path / "b.zst").write_bytes(bytes(spoilt))
    with pytest.raises(ValueError):
        token_files.ShardReader(str(tmp_path / "b.zst")).ids(0)


def test_licenses(spark, odd, none):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500)
    rows = [
        (1, "MIT License text follows\n\nCopyright (c) 2020 Somebody\n" + mit.upper().replace(",", " ;")),
        (2, "Copyright (c) 2001, Me\n" + mit.replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")),
        (3, "prose\nreleased under the mit LICENCE!\nmore\nReleased under the MIT License."),
        (4, "Released under the MIT License with exceptions."),
        (5, "All rights reserved."),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == {(1, "MIT", False, 0, 1), (2, "MIT", True, 0, 1), (3, "MIT", False, 2, 0), (5, "proprietary", True, 1, 1)}
    assert licenses.scan(odd).count() == licenses.scan(none).count() == 0
    assert licenses.scan(odd, known=()).count() == 0


def test_trees_learn_and_bound():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.grow(x[:2000], y[:2000], trees=30)
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert (quality.grow(x[:0], y[:0]).score(x) == 0.5).all()
    assert (quality.grow(x[:50], np.ones(50)).score(x[:50]) > 0.9).all()
    # flattened traversal equals walking each tree
    t, row = 3, x[2001]
    at = 0
    while at < m.feature.shape[1]:
        at = 2 * at + 1 + int(row[m.feature[t, at]] > m.threshold[t, at])
    alone = quality.Trees(0.0, m.feature[t : t + 1], m.threshold[t : t + 1], m.value[t : t + 1])
    assert alone.margin(row[None, :])[0] == m.value[t, at - m.feature.shape[1]]


def test_quality_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 5 and sum(r.predicted == r.quality for r in got) / len(got) > 0.9


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 1, 0), (None, 1, 1), (99, 0, 0), (10, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert quality.keep_good(odd, labels).columns == odd.columns
    empty = labels.where("false")
    assert {r.score for r in quality.classify(odd, empty).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(k, prose(k, 10 + k % 7), "en" if k % 3 else "de", f"s{min(k % 8, 4)}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs).select("source", "lang", "_mix.*")
    for key in ("source", "lang"):
        n = {r[0]: r[1] for r in out.groupBy(key).agg(F.sum("tokens")).collect()}
        raised = {k: v ** mixing.POWERS[key] for k, v in n.items()}
        got = {r[0]: r[1] for r in out.groupBy(key).agg(F.sum(F.col("tokens") * F.col("weight"))).collect()}
        for k in n:
            assert abs(got[k] / sum(got.values()) - raised[k] / sum(raised.values())) < 1e-4
    kept = out.agg(F.sum("probability"), F.count_if("sampled")).first()
    assert abs(kept[0] - kept[1]) < 120 and out.agg(F.max("probability")).first()[0] == 1.0


def test_mixing_of_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert out.columns[:-1] == odd.columns and out.count() == len(odd_rows())
    assert out.where("_mix.probability is null").count() == 0
    assert mixing.sample(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0


def test_cumulative_link_gradient_and_order():
    r = np.random.default_rng(3)
    x = r.integers(0, 3, (600, 5)).astype(float)
    latent = x @ [1.5, -1.0, 0.0, 0.0, 2.0] + r.logistic(size=600)
    grade = (latent[:, None] > [0.0, 2.0, 4.0]).sum(1)
    row, col = np.nonzero(x)
    w, cuts = toxicity.fit_cumulative(row, col, x[row, col], grade, 5, 4, l1=1e-4, steps=800)
    assert np.allclose(w, [1.5, -1.0, 0, 0, 2.0], atol=0.35) and (np.diff(cuts) > 0).all() and np.allclose(cuts, [0, 2, 4], atol=0.6)


def toxic_frames(spark):
    docs, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        docs.append((k, prose(k, 60) + (" zornwort zornwortes" * (1 + k % 4) if bad else "") + " " + prose(k + 9999, 20)))
        if k < 300:
            labels.append((k, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, odd, none):
    docs, labels = toxic_frames(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[k].toxic == (k % 5 == 0) for k in range(400))
    mild = np.mean([got[k].expected_severity for k in range(0, 400, 20)])
    hard = np.mean([got[k].expected_severity for k in range(15, 400, 20)])
    assert hard > mild > got[1].expected_severity
    assert toxicity.score(odd, model).where("toxic").count() == 0 and toxicity.score(odd, model).count() == len(odd_rows())
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.expected_severity for r in toxicity.score(odd, blank).collect()} == {0.0}
    assert toxicity.fit(none, labels).weights == {} and toxicity.fit(docs, labels.where("false")).weights == {}
