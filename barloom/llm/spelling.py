"""Groups of spelling variants: words one insertion, deletion or replacement apart.

If two words differ by one edit, one half of the first is found unchanged in
the second: its left half as a beginning or its right half as an end. Words
are dealt by such halves; a half that more than `LARGEST` characters of words
share is dealt by the half together with one half of the rest, and so on, so
that every bucket ends bounded and no two words are compared for sharing a
hot beginning. Buckets are packed into shards. A shard indexes its delimited
vocabulary in a bidirectional FM-index (the suffix ranks of the text and of
the text reversed), matches the unchanged part exactly, then turns and extends
across the rest with one error: a search scheme over pairs of rank intervals.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_text

#: Characters of words in a bucket before it is split, and in a shard on average.
LARGEST = 1 << 18
#: Positions of queries searched at a time.
CELLS = 1 << 14
BLOCK = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[a-zÀ-ÿ]+"


class _Ranks:
    """Rank structure of one direction: symbols before each suffix, in suffix order."""

    def __init__(self, codes: np.ndarray, sigma: int):
        n = len(codes)
        before = codes[self._sorted(codes, sigma) - 1]
        blocks = -(-(n + 1) // BLOCK)
        self.sigma, self.n = sigma, n
        padded = np.full(blocks * BLOCK, sigma + 1, np.uint16 if sigma > 254 else np.uint8)
        padded[:n] = before
        self.blocks = padded.reshape(blocks, BLOCK)
        counts = np.zeros((blocks + 1, sigma + 2), np.int32)
        np.add.at(counts, (np.arange(n) // BLOCK + 1, before + 1), 1)
        # below[k, c]: symbols smaller than c in the blocks before k
        self.below = counts.cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)
        self.first = np.concatenate([[0, 0], np.cumsum(np.bincount(codes, minlength=sigma + 1)[1:])]).astype(np.int64)

    @staticmethod
    def _sorted(codes: np.ndarray, sigma: int) -> np.ndarray:
        """Suffix order by prefix doubling; the first key packs as many symbols as 62 bits hold."""
        n, bits = len(codes), int(sigma + 1).bit_length()
        width = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for k in range(width):
            key <<= bits
            key[: max(n - k, 0)] += codes[k:]
        while True:
            order = np.argsort(key, kind="stable")
            fresh = np.ones(n, bool)
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            if fresh.all():
                return order
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            key = rank * (n + 1)
            key[: max(n - width, 0)] += rank[width:]
            width *= 2

    def two(self, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols smaller than c, and up to c, before the ranks `at`."""
        k, rest = np.divmod(at, BLOCK)
        inside = np.where(np.arange(BLOCK) < rest[:, None], self.blocks[k], self.sigma + 1)
        small = self.below[k, c] + (inside < c[:, None]).sum(1)
        return small, self.below[k, c + 1] + (inside <= c[:, None]).sum(1)

    def all(self, at: np.ndarray) -> np.ndarray:
        """For every symbol c, symbols smaller than c before the ranks `at` (columns 0 to sigma + 1)."""
        k, rest = np.divmod(at, BLOCK)
        width = self.sigma + 2
        inside = np.where(np.arange(BLOCK) < rest[:, None], self.blocks[k], self.sigma + 1).astype(np.int64)
        inside += (np.arange(len(at)) * width)[:, None]
        counts = np.bincount(inside.ravel(), minlength=len(at) * width).reshape(len(at), width)
        here = counts.cumsum(1) - counts
        return self.below[k] + here


class BidirectionalIndex:
    """Rank intervals of patterns in the text `|w1|w2|...|wn|` of sorted distinct words."""

    def __init__(self, words: list[str]):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet = np.unique(points)
        codes = np.ones(len(points) + len(words) + 1, np.int64)  # 1: the delimiter
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        place = np.ones(len(codes), bool)
        place[starts] = False
        codes[place] = np.searchsorted(self.alphabet, points) + 2
        self.codes, self.starts, self.lengths = codes, starts[:-1] + 1, lengths
        sigma = len(self.alphabet) + 1
        self.size = len(codes)
        self.left, self.right = _Ranks(codes, sigma), _Ranks(codes[::-1], sigma)

    def extend(self, rightwards: bool, near: np.ndarray, far: np.ndarray, size: np.ndarray, c: np.ndarray):
        """Intervals after one more symbol; `near` is the start in the ranks of that direction, `far` in the other's."""
        ranks = self.right if rightwards else self.left
        low, low_c = ranks.two(near, c)
        high, high_c = ranks.two(near + size, c)
        return ranks.first[c] + low_c - low, far + high - low, high_c - high - low_c + low

    def branches(self, rightwards: bool, near: np.ndarray, far: np.ndarray, size: np.ndarray):
        """All extensions by a letter: (row, symbol, near, far, size) of those that occur."""
        ranks = self.right if rightwards else self.left
        low, high = ranks.all(near), ranks.all(near + size)
        sizes = np.diff(high, axis=1) - np.diff(low, axis=1)
        sizes[:, :2] = 0  # no symbol and the delimiter
        row, c = np.nonzero(sizes)
        return row, c, ranks.first[c] + low[row, c + 1] - low[row, c], far[row] + high[row, c] - low[row, c], sizes[row, c]

    def one_error(self, rightwards: bool, who: np.ndarray, fixed: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, found) word numbers: words that equal the query but for one edit in its free part.

        `fixed` characters at the query's beginning (rightwards) or end are
        matched first, then `free` ones with one error, then the others.
        """
        n, reach = self.lengths[who], int(self.lengths[who].max()) + 1
        step = np.arange(reach)[None, :]
        if rightwards:
            at = self.starts[who][:, None] + fixed[:, None] + step
        else:
            at = (self.starts[who] + n - 1)[:, None] - fixed[:, None] - step
        rest = n - fixed + 1  # the delimiter too
        ahead = np.where(step < rest[:, None], self.codes[np.clip(at, 0, self.size - 1)], 0)
        near = np.zeros(len(who), np.int64)
        far, size = near.copy(), near + self.size
        # the exact part, away from the free one
        for k in range(int(fixed.max()) + 1):
            go = np.nonzero((fixed >= k) & (size > 0))[0]
            if rightwards:
                c = self.codes[self.starts[who[go]] + fixed[go] - 1 - k]
            else:
                c = self.codes[self.starts[who[go]] + n[go] - fixed[go] + k]
            far[go], near[go], size[go] = self.extend(not rightwards, far[go], near[go], size[go], c)
        pool = []
        q = np.nonzero(size > 0)[0]
        for p in range(int(free.max()) + 1):
            q = q[free[q] >= p]
            if not len(q):
                break
            c = ahead[q, p]
            inner = p < free[q]
            skip = q[inner & (n[q] > 1)]  # nothing is left of a single character
            pool.append((skip, near[skip], far[skip], size[skip], np.full(len(skip), p + 1)))
            row, sym, *there = self.branches(rightwards, near[q], far[q], size[q])
            other = (sym != c[row]) | ~inner[row]
            row, there = row[other], [x[other] for x in there]
            pool.append((q[row], *there, np.full(len(row), p)))
            swapped = inner[row]
            pool.append((q[row[swapped]], *[x[swapped] for x in there], np.full(int(swapped.sum()), p + 1)))
            q, c = q[inner], c[inner]
            near[q], far[q], size[q] = self.extend(rightwards, near[q], far[q], size[q], c)
            q = q[size[q] > 0]
        row, near, far, size, at = (np.concatenate(x) for x in zip(*pool)) if pool else (np.zeros(0, np.int64),) * 5
        asked, found = [], []
        while len(row):
            near, far, size = self.extend(rightwards, near, far, size, ahead[row, at])
            at = at + 1
            live = size > 0
            done = live & (at == rest[row])
            asked.append(who[row[done]])
            found.append((far if rightwards else near)[done] - 1)
            live &= ~done
            row, near, far, size, at = (x[live] for x in (row, near, far, size, at))
        return (np.concatenate(asked), np.concatenate(found)) if asked else (np.zeros(0, np.int64),) * 2


def _search(shard: pa.Table) -> pa.Table:
    column = {k: shard.column(k).to_pylist() for k in ("word", "n", "m", "head", "tail")}
    count = dict(zip(column["word"], column["n"]))
    words = sorted(count)
    number = {w: k for k, w in enumerate(words)}
    asked = sorted(
        {
            (len(w), number[w], len(h), len(t))
            for w, m, h, t in zip(column["word"], column["m"], column["head"], column["tail"])
            if len(w) == m
        }
    )
    index = BidirectionalIndex(words)
    found = set()
    for rightwards in (True, False):
        mine = np.array([a[1:] for a in asked if (a[2] >= a[3]) == rightwards], np.int64).reshape(-1, 3)
        start = 0
        while start < len(mine):
            stop = start + 1
            while stop < len(mine) and (stop + 1 - start) * (index.lengths[mine[stop, 0]] + 1) <= CELLS:
                stop += 1
            who, head, tail = mine[start:stop].T
            fixed = head if rightwards else tail
            pairs = index.one_error(rightwards, who, fixed, index.lengths[who] - head - tail)
            found.update(zip(*(x.tolist() for x in pairs)))
            start = stop
    pairs = sorted(found)
    near = [words[b] for _, b in pairs]
    return pa.table(
        {
            "word": pa.array([words[a] for a, _ in pairs], pa.string()),
            "near": pa.array(near, pa.string()),
            "near_n": pa.array([count[w] for w in near], pa.int64()),
        }
    )


def near_words(vocabulary: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words of `vocabulary` (word, n) that are one edit apart.

    Words are distinct and not empty. An empty vocabulary gives no pairs.
    """
    length = F.length("word")
    parts = []
    for other in (-1, 0, 1):
        m = length + other
        half = F.floor(m / 2).cast("int")
        parts.append(F.struct(m.alias("m"), F.left("word", half).alias("head"), F.lit("").alias("tail")))
        parts.append(F.struct(m.alias("m"), F.lit("").alias("head"), F.right("word", m - half).alias("tail")))
    open_rows = vocabulary.select("word", "n", F.explode(F.array(*parts)).alias("k")).select("word", "n", "k.*").where("m > 0")
    key, settled = ["m", "head", "tail"], []
    free = F.col("m") - F.length("head") - F.length("tail")
    while True:
        open_rows = cut_lineage(open_rows, "halves")
        sizes = open_rows.groupBy(*key).agg(F.sum(F.length("word") + 1).alias("size"))
        hot = cut_lineage(sizes.where((F.col("size") > largest) & (free > 1)).select(*key), "hot")
        if hot.isEmpty():
            settled.append(open_rows)
            break
        settled.append(open_rows.join(hot, key, "left_anti").select("word", "n", *key))
        # the edit spares one half of what is still free: that half becomes part of the key
        first = F.floor(free / 2).cast("int")
        longer_head = F.struct("m", F.left("word", F.length("head") + first).alias("head"), "tail")
        longer_tail = F.struct("m", "head", F.right("word", F.length("tail") + free - first).alias("tail"))
        split = open_rows.join(hot, key).select("word", "n", F.explode(F.array(longer_head, longer_tail)).alias("k"))
        open_rows = split.select("word", "n", "k.*")
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.union(more)
    total = rows.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = -(-total // largest) or 1
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(_search, "word string, near string, near_n long").distinct()


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run): maximal runs of Latin letters in whole texts, only A-Z lower-cased; null texts have none."""
    folded = F.translate(F.col("text"), UPPER, LOWER)
    return id_text(docs, doc_id, text).select("doc_id", F.explode(F.regexp_extract_all(folded, F.lit(LETTERS), F.lit(0))).alias("run"))


def without(word: str, at: Column) -> Column:
    """The word without its code point number `at`, counted from 0."""
    at = at.cast("int")
    return F.concat(F.substring(F.col(word), F.lit(1), at), F.substring(F.col(word), at + 2, F.length(word)))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the column `word`: words of `least_length` code points that occur `least_count` times."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def variants(words: DataFrame, ratio: int = 5, largest: int = LARGEST) -> DataFrame:
    """One row per row of `words` (word, n): word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest in code-point
    order) if that n is at least `ratio` times the word's, else null; root is
    where following the forms ends, the word itself without a form. Counts
    grow along forms, so there is no circle. Words are distinct and not
    empty; an empty vocabulary gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least, or forms could lead in circles")
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_words(words, largest).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    good = -F.col("best.minus") >= F.col("n") * ratio
    formed = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"),
        F.when(good, -F.col("best.minus")).alias("form_n"),
    )
    formed = cut_lineage(formed, "forms")
    most = formed.agg(F.max("n")).first()[0] or 1
    # a path has at most log_ratio(most) links, and each round doubles what is followed
    hops = int(math.log(most, ratio)) + 2
    ends = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(hops - 1, 1).bit_length()):
        ends = cut_lineage(ends, "ends")
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
