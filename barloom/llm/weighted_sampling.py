"""Document fingerprints by consistent weighted sampling.

A document is the bag of its terms (runs of `width` words, each weighing as
often as it occurs). Every sample j draws, for each term k, two gamma
variables and a uniform one from a hash of (k, j) alone, and keeps the term
with the smallest a = c / (y e^r), where y is the largest e^(r (t - beta)) not
above the weight. The pair (k, t) of the minimum is the sample; two documents
agree in it with a chance equal to their generalised Jaccard similarity, the
sum of the smaller weights over the sum of the larger ones.

Documents lie in one range sort by doc_id. A task streams through its range
and needs only the row after the one at hand; the last row of a range meets
the first of the next one in a join of two rows per range.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_text, text_runs

#: Samples in a fingerprint; the likeness of two has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 128
#: Terms whose draws a worker remembers (4 bytes a sample each; half as many with 12 bytes for weights above one).
ROOM = 1 << 16
#: Terms looked at in one go.
STRIDE = 256

_MASK = (1 << 64) - 1


def _stream(seed: int, n: int) -> np.ndarray:
    """n well-mixed 64-bit numbers (the splitmix64 sequence)."""
    out = []
    for k in range(1, n + 1):
        z = (seed + k * 0x9E3779B97F4A7C15) & _MASK
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def bag(text: str, width: int = 1) -> Counter:
    """Terms and how often they occur: ASCII letters lower-cased, words split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if width == 1:
        return Counter(words)
    return Counter(zip(*(words[k:] for k in range(width)))) if len(words) >= width else Counter([tuple(words)] if words else [])


class _Memory:
    """Rows of numbers per term in arrays of bounded size; when they are full, all is forgotten."""

    def __init__(self, make, room: int):
        self.make, self.room, self.rows, self.arrays = make, max(room, STRIDE), {}, None

    def __call__(self, terms: list) -> list[np.ndarray]:
        """The arrays' rows of at most STRIDE terms."""
        at = [self.rows.get(t, -1) for t in terms]
        if -1 in at:
            fresh = [t for t, k in zip(terms, at) if k < 0]
            if len(self.rows) + len(fresh) > self.room:
                self.rows, fresh = {}, terms
            first, made = len(self.rows), self.make(fresh)
            if self.arrays is None:
                self.arrays = [np.empty((self.room, *m.shape[1:]), m.dtype) for m in made]
            for kept, m in zip(self.arrays, made):
                kept[first : first + len(fresh)] = m
            self.rows.update(zip(fresh, range(first, first + len(fresh))))
            at = [self.rows[t] for t in terms]
        at = np.array(at)
        return [kept.take(at, 0) for kept in self.arrays]


class Sampler:
    """Signatures of texts; what was drawn for frequent terms is kept between calls, which changes no result."""

    def __init__(self, samples: int = SAMPLES, width: int = 1, room: int = ROOM):
        self.samples, self.width = samples, width
        self.factors = _stream(42, 2 * samples).reshape(2, samples) | np.uint64(1)
        self.once, self.often = _Memory(self._single, room), _Memory(self._draw, room // 2)

    def _draw(self, terms: list) -> tuple[np.ndarray, ...]:
        """(mark, r, beta, log c) of each term: a hash, and for each sample Gamma(2, 1), U(0, 1) and Gamma(2, 1)."""
        import xxhash

        joined = terms if self.width == 1 else [b" ".join(t) for t in terms]
        h = np.array([xxhash.xxh64_intdigest(t, seed=13) for t in joined], np.uint64)
        scale, half = np.float32(2.0**-23), np.float32(0.5)  # numbers strictly between 0 and 1
        logs, rest = [], None
        for factor in self.factors:
            x = h[:, None] * factor
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            u = (x >> np.uint64(41)).astype(np.uint32).astype(np.float32) + half
            v = ((x >> np.uint64(16)).astype(np.uint32) & np.uint32(0x7FFFFF)).astype(np.float32) + half
            u *= scale
            v *= scale
            u *= v
            logs.append(-np.log(u))
            rest = x.astype(np.uint16) if rest is None else rest
        beta = rest.astype(np.float32) + half
        beta *= np.float32(2.0**-16)
        return h, logs[0], beta, np.log(logs[1])

    def _single(self, terms: list) -> tuple[np.ndarray, ...]:
        """(mark, log a) for a weight of one, where t is 0."""
        mark, r, beta, log_c = self._draw(terms)
        return mark, log_c - r * (0 - beta + 1)

    def of_bag(self, weights: dict) -> np.ndarray:
        """One 16-bit sample each; all zero for a bag without terms. Weights are above 0."""
        best = np.full(self.samples, np.inf, np.float32)
        out, j = np.zeros(self.samples, np.uint64), np.arange(self.samples)
        light = [t for t, w in weights.items() if w == 1]
        heavy = [(t, w) for t, w in weights.items() if w != 1]
        for terms in (light, heavy):
            for start in range(0, len(terms), STRIDE):
                some = terms[start : start + STRIDE]
                if terms is light:
                    mark, a = self.once(some)
                    k = a.argmin(0)
                    took = np.uint64(0)
                else:
                    mark, r, beta, log_c = self.often([t for t, _ in some])
                    log_w = np.log(np.array([w for _, w in some], np.float64)).astype(np.float32)
                    t = np.floor(log_w[:, None] / r + beta)
                    a = log_c - r * (t - beta + 1)
                    k = a.argmin(0)
                    took = t[k, j].astype(np.int64).view(np.uint64)
                low = a[k, j]
                won = low < best
                best[won] = low[won]
                x = (mark[k] ^ took) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(31)
                x *= np.uint64(0x94D049BB133111EB)
                out[won] = (x >> np.uint64(48))[won]
        return out.astype(">u2")

    def __call__(self, text: str) -> np.ndarray:
        return self.of_bag(bag(text, self.width))


def fingerprints(
    docs: DataFrame, samples: int = SAMPLES, width: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint) of every row: `samples` times four hex digits, equal for equal texts.

    A null text counts as empty; texts without words have the fingerprint of
    zeros. Repeated rows stay repeated, null ids stay, an empty table gives an
    empty result and other columns are not looked at.
    """

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, width)
        for batch, texts in text_runs(batches, "text"):
            prints = pa.array([sampler(t).tobytes().hex() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fingerprint"])

    return id_text(docs, doc_id, text).mapInArrow(sign, "doc_id long, fingerprint string")


def likeness(a: str | Column, b: str | Column, samples: int = SAMPLES) -> Column:
    """Estimated generalised Jaccard similarity of two fingerprint columns: the share of equal samples."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    at = F.sequence(F.lit(0), F.lit(samples - 1))
    same = F.filter(at, lambda k: F.substr(a, k * 4 + 1, F.lit(4)) == F.substr(b, k * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(samples)


RESULT = "doc_id long, n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double"


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_RESULT = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("own", pa.binary()),
    ("edited", pa.binary()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
_WALKED = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("text", pa.string()), *_RESULT])


def _compared(sampler: Sampler, doc_id, text: str, own: np.ndarray, after: str, after_print: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    other = sampler(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    near = [float((own == x).mean()) for x in (other, after_print)]
    return (doc_id, len(text), digest, own.tobytes(), other.tobytes(), *near)


def edited_likeness(
    docs: DataFrame, samples: int = SAMPLES, width: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last floor(n_chars / 2) code
    points replaced by the first as many (or all) of the document after it by
    doc_id; the last one is followed by the first, a single one by itself.
    Null ids come first and rows of one doc_id follow each other by a hash of
    their text, so one id may own any share of the rows. Null texts count as
    empty, texts without words are alike to each other (likeness 1) and to
    nothing else. Repeated rows stay; an empty table gives an empty result;
    other columns are not looked at.
    """
    placed = id_text(docs, doc_id, text).withColumn("mark", F.xxhash64("text")).repartitionByRange("doc_id", "mark")
    sorted_docs = placed.sortWithinPartitions("doc_id", "mark").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, last, out, part = Sampler(samples, width), None, [], None
        for batch, texts in text_runs(batches, "text"):
            part = batch.column(2)[0].as_py()
            for ident, body in zip(batch.column(0).to_pylist(), texts):
                own = sampler(body)
                if last is None:
                    out.append((part, "head", body, ident, *[None] * 6))
                else:
                    out.append((part, "row", None, *_compared(sampler, *last, body, own)))
                last = (ident, body, own)
            yield _columns(out, _WALKED)
            out = []
        if last is not None:
            yield _columns([(part, "tail", last[1], last[0], *[None] * 6)], _WALKED)

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples, width)
        for batch, texts in text_runs(batches, "text"):
            following = batch.column(2).to_pylist()
            rows = [
                _compared(sampler, i, t, sampler(t), after, sampler(after))
                for i, t, after in zip(batch.column(0).to_pylist(), texts, following)
            ]
            yield _columns(rows, pa.schema(_RESULT))

    walked = cut_lineage(sorted_docs.mapInArrow(walk, f"part int, kind string, text string, {RESULT}"), "walked")
    # two rows for each range: which range follows which, then the texts at the borders side by side
    heads, tails = (walked.where(F.col("kind") == k).select("part", "doc_id", "text") for k in ("head", "tail"))
    order = W.orderBy("part")
    parts = heads.select("part").select("part", F.lead("part").over(order).alias("after"), F.min("part").over(W.partitionBy()).alias("first"))
    parts = parts.select("part", F.coalesce("after", "first").alias("after"))
    borders = (
        tails.join(parts, "part")
        .join(heads.select(F.col("part").alias("after"), F.col("text").alias("next_text")), "after")
        .select("doc_id", "text", "next_text")
    )
    rows = walked.where("kind = 'row'").drop("part", "kind", "text").union(borders.mapInArrow(close, RESULT))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("own")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
