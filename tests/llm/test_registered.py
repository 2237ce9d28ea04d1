"""The registered queries and the pipeline, over whole tables."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from check import compare, duck, frame

import __spark_entry__ as entry_mod
import corpus_pipeline
from barloom.llm import catalog, mixing, quality
from barloom.llm.tokenizer_files import BYTE_BPE

from .conftest import odd_rows
from .test_dedup import brute_components, brute_fingerprint, brute_repeats, brute_similar


@pytest.mark.parametrize("name", sorted(catalog.checks()))
def test_matches_sql(spark, sf, name):
    got = frame(entry_mod.queries()[name](spark, sf))
    assert compare(got, duck(sf).execute(entry_mod.oracle_sql()[name]).df()) is None


def test_every_dealt_operator_is_registered_once():
    names = [n.split("_")[0] for n in catalog.queries()]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14))
    assert "pipeline" in entry_mod.queries()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_near_copies_query(spark, sf, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.queries()["op6_simhash"](spark, sf).collect()}
    fps = [brute_fingerprint(t) for _, t in docs]
    roots = brute_components(fps, 4)
    least = defaultdict(lambda: 1 << 60)
    for (i, _), r in zip(docs, roots):
        least[r] = min(least[r], i)
    assert got == {i: (f"{fp:016x}", least[r]) for (i, _), fp, r in zip(docs, fps, roots)}


def test_repeats_query(spark, sf, docs):
    got = {r.doc_id: tuple(r)[1:] for r in catalog.queries()["op8_suffix_dedup"](spark, sf).collect()}
    want = brute_repeats([t.encode() for _, t in docs], 200)
    assert got == {i: w[:4] for (i, _), w in zip(docs, want)}


def brute_pipeline(rows, labels, model):
    """The pipeline on (doc_id, text, lang, source) rows, a stage after the other in plain Python."""
    from tokenizers import Tokenizer

    good = [r for r in rows if walk(model, quality.statistics(r[1] or "")) >= quality.THRESHOLD]
    by_text = {}
    for r in sorted(good, key=lambda r: (r[0] is None, r[0] or 0)):
        by_text.setdefault(r[1] or "", r)
    single = list(by_text.values())
    roots = brute_similar([r[1] or "" for r in single])
    least = {}
    for r, root in zip(single, roots):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    apart = [r for r, root in zip(single, roots) if r[0] is None or r[0] == least[root]]
    mixed = [r for r, p in zip(apart, rates(apart)) if draw(r[0]) < p]
    lib = Tokenizer.from_file(BYTE_BPE)
    out = []
    for i, t, *_ in mixed:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def walk(model, x):
    margin = model.prior
    for feature, threshold, value in zip(model.feature, model.threshold, model.value):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + (x[feature[at]] > threshold[at])
        margin += value[at - len(feature)]
    return 1 / (1 + np.exp(-margin))


def topic(t):
    if "icense" in t:
        return "licensed"
    return "table" if " | " in t else "short" if len(t) < 500 else "article" if len(t) < 4000 else "long"


def rates(rows):
    cells = [(r[3] or "(none)", r[2] or "(none)", topic(r[1] or "")) for r in rows]
    tokens = defaultdict(float)
    for c, r in zip(cells, rows):
        tokens[c] += len((r[1] or "").encode().split())
    total = sum(tokens.values())
    weight = dict.fromkeys(tokens, 1.0)
    for _ in range(mixing.SWEEPS):
        for k, key in enumerate(mixing.KEYS):
            n, met = defaultdict(float), defaultdict(float)
            for c, v in tokens.items():
                n[c[k]] += v
                met[c[k]] += v * weight[c]
            raised = {x: v ** mixing.POWERS[key] for x, v in n.items() if v}
            for c in tokens:
                if met[c[k]]:
                    weight[c] *= raised[c[k]] / sum(raised.values()) * total / met[c[k]]
    most = max(weight.values(), default=1.0)
    return [round(weight[c] / most, 6) for c in cells]


def draw(doc_id):
    return int(hashlib.md5((mixing.SEED + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()[:8], 16) / 2**32


def stages(spark, docs, sf):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == docs.columns
    return corpus_pipeline.STAGES[-1][1](spark, docs, sf)


def test_pipeline_against_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr)
    assert got == brute_pipeline(rows, labels, quality.fit(docs, labels)) and 0 < len(got) < len(rows)


def test_stages_take_odd_rows(spark, sf, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert 0 < out.count() <= len(odd_rows()), name
        assert stage(spark, none, sf).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns, name
    want = brute_pipeline([r for r in odd_rows()], labels, quality.fit(odd, labels))
    assert sorted(map(tuple, stages(spark, odd, sf).collect()), key=repr) == want
