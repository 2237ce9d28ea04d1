"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled documents and
flattened into arrays (feature, threshold, leaf value); scoring walks all rows
of a batch down all trees with numpy. Statistics are taken over whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, text_runs

#: Most labelled rows a model is fitted on; they are the bound of what comes to the driver.
TRAIN_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.2
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": [32],
    "other_white": [9, 11, 12, 13],
    "line": [10],
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "control": [*range(9), *range(14, 32), 127],
    "high": range(128, 256),
}
FEATURES = (
    "log_bytes", "log_words", "word_length", *(f"{c}_share" for c in _CLASSES), "upper_of_letters", "bangs_per_word", "bars_per_word",
    "symbols_per_word", "distinct_words", "distinct_pairs", "top_word", "distinct_lines", "words_per_line", "words_per_stop", "symbol_words",
)
_ENDS = frozenset(b"#$%&*!|")


def _class_of() -> np.ndarray:
    out = np.zeros((256, len(_CLASSES)))
    for k, members in enumerate(_CLASSES.values()):
        out[list(members), k] = 1
    return out


_CLASS_OF = _class_of()


def statistics(text: str) -> list[float]:
    """The numbers in FEATURES; all zero for an empty text."""
    raw = text.encode("utf-8")
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_OF
    by = dict(zip(_CLASSES, counts.tolist()))
    words = raw.split()
    n = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = by["upper"] + by["lower"] + by["high"] / 2
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        *(counts / len(raw)).tolist(),
        by["upper"] / max(letters, 1),
        by["bang"] / n,
        by["bar"] / n,
        by["symbol"] / n,
        len(seen) / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1),
        max(seen.values(), default=0) / n,
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        n / (1 + raw.count(b".")),
        sum(c for w, c in seen.items() if w[-1] in _ENDS) / n,
    ]


@dataclass
class Trees:
    """Complete trees in level order, flattened: inner node k has children 2k+1 and 2k+2."""

    prior: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2^depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.prior)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Fit boosted trees with logistic loss on histograms of at most `bins` quantile bins a feature.

    Without rows the score is 0.5 throughout; with one class only it is that
    class's smoothed share.
    """
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    model = Trees(float(np.log(share / (1 - share))), feature, threshold, value)
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)  # bin b holds x <= edges[b]
    margin = np.full(n, model.prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            node = at - first
            best = np.full(wide, 1e-9)
            for k in range(m):
                if not len(edges[k]):
                    continue
                cell = node * bins + binned[:, k]
                gs = np.bincount(cell, g, wide * bins).reshape(wide, bins).cumsum(1)
                hs = np.bincount(cell, h, wide * bins).reshape(wide, bins).cumsum(1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = 0
                gain = gain[:, : len(edges[k])]
                top = gain.argmax(1)
                won = gain[np.arange(wide), top]
                better = won > best
                best[better] = won[better]
                feature[t, first : first + wide][better] = k
                threshold[t, first : first + wide][better] = edges[k][top[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        leaf = at - inner
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[t][leaf]
    return model


def _features(docs: DataFrame, text: str, keep: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], names=["y", "x"])

    return docs.select(F.col(keep).alias("y"), F.col(text).alias("text")).mapInArrow(run, "y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **settings) -> Trees:
    """Fit on at most `rows` labelled documents outside the held-out fold.

    The fold is crc32(doc_id as text) mod 5 = 0; the sample is chosen by a hash
    of doc_id. A document labelled more than once counts as 0 if any label is.
    Labels other than 0 and 1, null ids and labels without a document are left out.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    marked = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("y"))
    marked = marked.where(F.col("y").isin(0, 1) & (fold != 0)).groupBy("doc_id").agg(F.min("y").alias("y"))
    n = marked.count()
    chance = 1.0 if n <= rows else 1.2 * rows / n
    some = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.lit(int(chance * (1 << 30)))).limit(rows)
    body = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # `some` holds at most `rows` rows of 12 bytes
    got = _features(body.join(F.broadcast(some), "doc_id"), "text", "y").limit(rows).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return grow(x, got["y"].to_numpy(np.float64), **settings)


def score(docs: DataFrame, model: Trees, name: str, text: str = "text") -> DataFrame:
    """`docs` with the score of each whole text in a last column `name`; a null text counts as empty."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType(), False)])
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches, text):
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, name])

    assert docs.columns[at] == text
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Rows stand for themselves: repeated rows and null ids are scored like any
    (a null id counts as held out). An empty table gives an empty result.
    """
    model = fit(docs, labels, rows, doc_id, text)
    body = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    out = score(body, model, "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, all columns as they were."""
    mark = free_name(docs, "_score")
    return score(docs, fit(docs, labels, rows, doc_id, text), mark, text).where(F.col(mark) >= threshold).drop(mark)
