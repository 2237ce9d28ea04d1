"""Approximate nearest neighbours by collision counting.

Vectors are hashed by single random projections; per block of vectors every
projection is one sorted array. Around a query's own projection a window opens
in each array and is widened by a constant factor (virtual rehashing: no table
is built anew). A vector collides once per window that holds it; vectors whose
collisions pass the threshold are verified with the true inner product. A
block is done when enough of its vectors have passed.

Inner products are searched as distances: with M the largest norm, x becomes
(x, sqrt(M^2 - |x|^2)) and a query (q, 0), whose nearest vectors are those of
largest inner product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Vectors of a block, and queries that visit it together.
BLOCK = 8192
QUERIES = 1024
PROJECTIONS = 128
#: Stretches into which a sorted array is cut.
CUTS = 128
#: Share of the projections in which a vector must collide.
COLLISIONS = 0.5
#: Vectors of a block to verify before its search ends: a share of them, and so many for each neighbour wanted.
VERIFY = 0.1
SPARE = 12
#: First half-width of the windows in units of the largest norm, and the factor of each widening.
FIRST, WIDEN = 0.65, 1.06
SEED = 20


def projections(dim: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, count))


class BlockIndex:
    """Sorted projections of one block of vectors.

    Each sorted array is cut into stretches of like size. For every cut the
    vectors below it are kept as a bitmap, so that a window between two cuts is
    the difference of two bitmaps. Cuts are values: equal projections are never
    parted, and so equal vectors collide alike.
    """

    def __init__(self, vectors: np.ndarray, planes: np.ndarray, norm: float):
        x = vectors.astype(np.float64)
        lift = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", x, x), 0))
        at = np.hstack((x, lift[:, None])) @ planes
        self.norm, self.n, lanes = norm, len(x), planes.shape[1]
        self.reach = 2 * float(np.abs(at).max(initial=0)) + 1
        cuts = np.sort(at, axis=0)[np.arange(CUTS) * self.n // CUTS]
        cuts[0] = -self.reach
        self.cuts = np.vstack((cuts, np.full(lanes, self.reach)))
        self.below = np.empty((lanes, CUTS + 1, -(-self.n // 64)), np.uint64)
        rows = np.arange(self.n)
        for j in range(lanes):
            mine = np.zeros((CUTS + 1, self.below.shape[2] * 64), bool)
            mine[np.searchsorted(self.cuts[:, j], at[:, j], "right"), rows] = True
            np.bitwise_or.accumulate(np.packbits(mine, axis=1).view(np.uint64), axis=0, out=self.below[j])

    def _window(self, marks: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """The cuts around marks -+ half, in each lane."""
        shift = np.arange(marks.shape[1]) * 4 * self.reach
        flat = (self.cuts + shift).T.ravel()
        first = np.arange(marks.shape[1]) * (CUTS + 1)
        low = np.searchsorted(flat, np.maximum(marks - half, -self.reach) + shift, "right") - first - 1
        high = np.searchsorted(flat, np.minimum(marks + half, self.reach * 0.999) + shift, "right") - first
        return low, high

    def search(self, queries: np.ndarray, planes: np.ndarray, wanted: int, share: float = COLLISIONS, verify: float = VERIFY) -> Iterator[tuple[int, np.ndarray]]:
        """(query, rows of the block to verify) for each query, in no set order."""
        lanes = planes.shape[1]
        need = min(self.n, SPARE * wanted + int(np.ceil(verify * self.n)))
        limit = max(1, int(np.ceil(share * lanes)))
        marks = np.hstack((queries.astype(np.float64), np.zeros((len(queries), 1)))) @ planes
        marks = np.clip(marks, -self.reach / 2, self.reach / 2)
        open_, half = np.arange(len(queries)), FIRST * self.norm
        while len(open_):
            low, high = self._window(marks[open_], half)
            found = at_least((self.below[j][high[:, j]] & ~self.below[j][low[:, j]] for j in range(lanes)), limit)
            done = (np.bitwise_count(found).sum(axis=1) >= need) | ((low == 0) & (high == CUTS)).all(axis=1)
            for q in np.flatnonzero(done).tolist():
                yield int(open_[q]), np.flatnonzero(np.unpackbits(found[q].view(np.uint8), count=self.n))
            open_, half = open_[~done], half * WIDEN


def at_least(bitmaps: Iterable[np.ndarray], limit: int) -> np.ndarray:
    """Bits that are set in at least `limit` of the bitmaps, counted bit by bit for a word at a time."""
    levels: list[list[np.ndarray]] = [[]]
    for b in bitmaps:
        levels[0].append(b)
        k = 0
        while len(levels[k]) == 3:  # three words of one weight: their sum, and their carry of twice the weight
            x, y, z = levels[k]
            both = x ^ y
            levels[k] = [both ^ z]
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append((x & y) | (both & z))
            k += 1
    k = 0
    while k < len(levels):
        if len(levels[k]) == 2:
            x, y = levels[k]
            levels[k] = [x ^ y]
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(x & y)
        if len(levels[k]) == 3:
            x, y, z = levels[k]
            both = x ^ y
            levels[k] = [both ^ z]
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append((x & y) | (both & z))
        k += 1
    zero = np.zeros_like(next(x[0] for x in levels if x))
    digits = [x[0] if x else zero for x in levels]
    if limit >> len(digits):
        return zero
    more, same = zero, ~zero
    for k in reversed(range(len(digits))):
        if limit >> k & 1:
            same = same & digits[k]
        else:
            more = more | (same & digits[k])
            same = same & ~digits[k]
    return more | same


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>): vectors that are neither null nor zero and hold finite numbers only, with an id."""
    v = vectors[embedding].cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(vectors[vec_id].cast("long").alias("vec_id"), v.alias("v")).where(fine & F.col("vec_id").isNotNull())


def _pack(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Rows of (`key` int, vec_id, v) as one row per key: ids and vectors as bytes. A key holds about `size` rows."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        by = np.argsort(ids, kind="stable")
        v = np.array(table.column("v").to_pylist(), np.float64)[by]
        return pa.table({key: table.column(key)[:1].cast(pa.int32()), f"{name}_ids": [ids[by].tobytes()], f"{name}_vectors": [v.tobytes()], "dim": pa.array([v.shape[1]], pa.int32())})

    return rows.groupBy(key).applyInArrow(run, f"{key} int, {name}_ids binary, {name}_vectors binary, dim int")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, verify: float = VERIFY) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` rows of largest inner product with each query, nearest first.

    Queries are the rows whose id is divisible by `every`; candidates all other
    rows (of rows that share the query's id, none). A query id that occurs
    several times is searched once, with the smallest of its vectors (component
    by component). Ties go to the smaller id.
    Vectors that are null, zero or hold null or non-finite components, and rows
    without an id, take no part. Vectors must share one length; those of a
    length other than the commonest raise. An empty table gives no rows.
    """
    rows = cut_lineage(_usable(vectors, vec_id, embedding), "vectors")
    n, norm, short, long = rows.agg(
        F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.min(F.size("v")), F.max(F.size("v"))
    ).first()
    if short != long:
        raise ValueError(f"vectors of {short} and of {long} components can't be compared")
    blocks = max(1, -(-n // block))
    spread = lambda parts: F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")
    packs = max(1, -(-n // every // QUERIES))
    index = _pack(rows.withColumn("block", spread(blocks)), "block", block, "base")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("pack", spread(packs))
    queries = _pack(asked, "pack", QUERIES, "query").drop("dim")
    # each pack of queries visits each block; both sides are packed rows, so the visits are few and even
    visits = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(index, "block")
    lanes = max(1, min(blocks * packs, 100_000))
    norm = float(norm or 0.0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                planes = projections(r["dim"])
                ids = np.frombuffer(r["base_ids"], np.int64)
                base = np.frombuffer(r["base_vectors"]).reshape(len(ids), r["dim"])
                q_ids = np.frombuffer(r["query_ids"], np.int64)
                q = np.frombuffer(r["query_vectors"]).reshape(len(q_ids), r["dim"])
                tree = BlockIndex(base, planes, norm)
                out: list[tuple] = []
                for at, found in tree.search(q, planes, k + 1, verify=verify):
                    one, vector = q_ids[at], q[at]
                    found = found[ids[found] != one]
                    close = base[found] @ vector
                    if len(found) > k:  # all that rounding could still bring to the front
                        found = found[close >= np.partition(close, -k)[-k] - 1e-9 * norm * norm]
                    scores = (base[found] * vector).sum(axis=1)
                    top = np.lexsort((ids[found], -scores))[:k]
                    out.append((np.full(len(top), one), ids[found][top], scores[top]))
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    found = visits.repartition(lanes, "block", "pack").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
