"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(cut_k - w.x) for ordered cuts: all thresholds share
the weights w. x holds log2(1 + count) of each word of the vocabulary and of
each stem, the first letters of longer words, so that inflected insults count
as one. The labels only say toxic or not, so grades above 0 are made from them: words that
the toxic training documents carry significantly more often are counted, and
toxic documents are graded by the terciles of that count. The fit drives the
weights of all other words to exactly 0, so long clean texts gather nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_text, text_runs

#: Most labelled rows the model is fitted on.
TRAIN_ROWS = 20_000
#: Training documents a feature must be in, and most features of the vocabulary (those whose log odds lie furthest from 0).
LEAST_DOCS = 4
VOCABULARY = 5_000
#: Standard errors by which a feature's log odds must lie above 0 to count towards the grade.
LIFT = 5.0
GRADES = 4
L1 = 5e-4
STEPS = 600
THRESHOLD = 0.3

#: Letters of the stems, taken of words at least one letter longer.
STEMS = (4, 5, 6)
#: Words whose features a worker remembers; beyond that it starts anew.
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself and its stems, marked by a hyphen."""
    return [word, *(f"{word[:k]}-" for k in STEMS if len(word) > k)]


def bag(text: str) -> dict[str, int]:
    """Count of every feature of a text."""
    out: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        for f in features(word):
            out[f] += n
    return out


@dataclass
class Ordinal:
    weights: dict[str, float]
    cuts: np.ndarray  # ascending, one fewer than grades
    _held: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(self.cuts[None, :] - margins[:, None]))

    def margin(self, text: str) -> float:
        if len(self._held) > REMEMBERED:
            self._held.clear()
        held, known = self._held, self.weights
        words = _WORD.findall(text.lower())
        for w in set(words).difference(held):
            held[w] = tuple(f for f in features(w) if f in known)
        counts = Counter(f for some in map(held.__getitem__, words) if some for f in some)
        return sum(known[f] * np.log2(1 + counts[f]) for f in sorted(counts))


def fit_cumulative(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, n_cols: int, grades: int = GRADES, l1: float = L1, steps: int = STEPS, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by Adam with a proximal L1 step; `row`, `col`, `value` are the nonzero features.

    Cuts are cut_0 plus a running sum of exponentials, so they stay ordered.
    """
    n = len(grade)
    share = np.clip([(grade > k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    share = np.minimum.accumulate(share - np.arange(grades - 1) * 1e-5)
    cuts = -np.log(share / (1 - share))
    raw = np.append(cuts[0], np.log(np.maximum(np.diff(cuts), 1e-3)))
    theta = np.append(np.zeros(n_cols), raw)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, raw = theta[:n_cols], theta[n_cols:]
        gaps = np.exp(raw[1:])
        cuts = raw[0] + np.append(0, np.cumsum(gaps))
        margin = np.bincount(row, value * w[col], n)
        edge = np.concatenate(([-np.inf], cuts, [np.inf]))
        low, high = (1 / (1 + np.exp(-(edge[grade + k] - margin))) for k in (0, 1))
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low), high * (1 - high)
        d_margin = (d_high - d_low) / p / n  # of minus log likelihood
        d_cut = np.zeros(grades + 1)
        np.add.at(d_cut, grade + 1, -d_high / p / n)
        np.add.at(d_cut, grade, d_low / p / n)
        d_cut = d_cut[1:-1]
        tail = np.cumsum(d_cut[::-1])[::-1]
        g = np.concatenate((np.bincount(col, value * d_margin[row], n_cols), [tail[0]], tail[1:] * gaps))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta = theta - step * m / (1 - 0.9**t)
        w = theta[:n_cols]
        theta[:n_cols] = np.sign(w) * np.maximum(np.abs(w) - step[:n_cols] * l1, 0)
    raw = theta[n_cols:]
    return theta[:n_cols], raw[0] + np.append(0, np.cumsum(np.exp(raw[1:])))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, grades: int = GRADES, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Ordinal:
    """Fit on at most `rows` labelled documents outside the fold crc32(doc_id as text) mod 5 = 0.

    A document labelled more than once counts as toxic if any label is. Labels
    other than 0 and 1, null ids and labels without a document are left out.
    Without toxic or without other documents every score is 0.
    """
    ids = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("y"))
    ids = ids.where(F.col("y").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = ids.count()
    chance = 1.0 if n <= rows else 1.2 * rows / n
    some = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.lit(int(chance * (1 << 30)))).limit(rows)

    # `some` holds at most `rows` rows of 12 bytes
    picked = cut_lineage(id_text(docs, doc_id, text).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]), "sample")
    n_docs, n_toxic = picked.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches, "text"):
            docs_of, toxic_of = Counter(), Counter()
            for t, y in zip(texts, batch.column(2).to_pylist()):
                found = set(bag(t))
                docs_of.update(found)
                if y:
                    toxic_of.update(found)
            names = sorted(docs_of)
            yield pa.RecordBatch.from_pydict({"feature": names, "docs": [docs_of[f] for f in names], "toxic": [toxic_of[f] for f in names]})

    found = picked.mapInArrow(count, "feature string, docs long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic") + 0.5, F.col("docs") - F.col("toxic") + 0.5
    rest_a, rest_b = F.lit(n_toxic) - F.col("toxic") + 0.5, F.lit(n_docs - n_toxic) - F.col("docs") + F.col("toxic") + 0.5
    z = (F.log(a / rest_a) - F.log(b / rest_b)) / F.sqrt(1 / a + 1 / rest_a + 1 / b + 1 / rest_b)
    # bounded by VOCABULARY
    vocabulary = found.where(F.col("docs") >= LEAST_DOCS).select("feature", z.alias("z")).orderBy(F.abs("z").desc(), "feature").limit(VOCABULARY).toPandas()
    if not n_toxic or n_toxic == n_docs or not len(vocabulary):
        return Ordinal({}, np.full(grades - 1, np.inf))
    names = vocabulary["feature"].tolist()
    place = {w: k for k, w in enumerate(names)}

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches, "text"):
            kept = [sorted((place[f], n) for f, n in bag(t).items() if f in place) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([[k for k, _ in x] for x in kept], pa.list_(pa.int32())), pa.array([[n for _, n in x] for x in kept], pa.list_(pa.int32()))],
                names=["doc_id", "y", "cols", "counts"],
            )

    data = picked.mapInArrow(pick, "doc_id long, y int, cols array<int>, counts array<int>").toPandas().sort_values("doc_id")
    sizes = data["cols"].map(len).to_numpy()
    row = np.repeat(np.arange(len(data)), sizes)
    col = np.concatenate(data["cols"].tolist() or [[]]).astype(np.int64)
    counts = np.concatenate(data["counts"].tolist() or [[]]).astype(np.float64)
    y = data["y"].to_numpy(np.int64)
    lifted = vocabulary["z"].to_numpy() > LIFT
    weight = np.bincount(row, counts * lifted[col], len(data))
    bounds = np.quantile(weight[y == 1], np.linspace(0, 1, grades)[1:-1])
    grade = np.where(y == 1, 1 + (weight[:, None] > bounds[None, :]).sum(1), 0)
    w, cuts = fit_cumulative(row, col, np.log2(1 + counts), grade, len(names), grades)
    return Ordinal({x: float(k) for x, k in zip(names, w) if k}, cuts)


def score(docs: DataFrame, model: Ordinal, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade, p_toxic, toxic for every row of `docs`.

    expected_severity is the mean grade (0 to grades - 1), grade the likeliest
    one, p_toxic = P(grade > 0), toxic = p_toxic >= threshold. Null and empty
    texts are scored as texts without words. Rows stand for themselves.
    """
    last = len(model.cuts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches, "text"):
            above = model.above(np.array([model.margin(t) for t in texts], np.float64))
            p = -np.diff(np.concatenate((np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(above.sum(axis=1)),
                    pa.array(p.argmax(axis=1).astype(np.int32)),
                    pa.array(above[:, 0]),
                    pa.array(above[:, 0] >= threshold),
                ],
                names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    assert last >= 1
    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")


def grade(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Fit on `labels` and score every document."""
    return score(docs, fit(docs, labels, **settings))
