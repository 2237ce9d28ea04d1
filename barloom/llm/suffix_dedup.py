"""Removal of long repeats, by difference-cover suffix sorting one bucket at a time.

A string of L bytes that occurs twice has the same smallest gram (by hash) at
the same place in both occurrences, so only suffixes near such anchors whose
gram occurs again can begin a repeat; that bounds what is sorted. The suffixes
around the occurrences of one gram form a bucket. Occurrences whose whole
surroundings are alike need no sorting, only counting. The others' surroundings
are gathered per bucket and sorted by suffix, a bounded block at a time: the
columns of a block that lie in a difference cover are ranked beforehand over a
fixed depth, and suffixes are ordered by the rank of their next cover column,
ties by the bytes before and behind it. Neighbours that share L bytes, compared
in full, are repeats. Buckets too large for a block are resolved by counting
digests of their suffixes instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_runs

LENGTH = 200
GRAM = 32
#: A perfect difference cover: every residue mod PERIOD is the difference of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Rows of a block, and of the largest bucket that is sorted as a block.
BLOCK, LARGEST = 4096, 32768
#: Bytes of text whose hashes are held at once; longer texts are cut with margins that overlap.
AT_ONCE = 1 << 20
NO_ID = -(1 << 63)

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTES = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, factor = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            out[done : 2 * done] = out[: min(done, n - done)] * factor
            done, factor = 2 * done, factor * factor
    return out


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for each i; what lies beyond the end is left out."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int, int, int, int]]]:
    """Groups of (text, first byte, end, first and end of what the piece answers for, text length)."""
    margin, held, size = 2 * length, [], 0
    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        for core in range(0, len(t), AT_ONCE):
            end = min(core + AT_ONCE, len(t))
            first, last = max(core - margin, 0), min(end + margin, len(t))
            held.append((k, first, last, core, end, len(t)))
            size += last - first
            if size >= AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs_of_equals(text: np.ndarray, pos: np.ndarray, gram: np.ndarray, around: np.ndarray, gap: int) -> tuple[np.ndarray, ...]:
    """Anchors of one text that are alike and no further apart than `gap` as one row.

    Returns (text, first position, last position, how many, gram, around).
    They are each other's copies, and their surroundings overlap, so all of
    what lies between goes with them; periodic texts are full of them.
    """
    by = np.lexsort((pos, around, gram, text))
    text, pos, gram, around = text[by], pos[by], gram[by], around[by]
    new = np.ones(len(pos), bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]) | (around[1:] != around[:-1]) | (pos[1:] - pos[:-1] > gap)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(pos)))
    return text[start], pos[start], pos[start + count - 1], count, gram[start], around[start]


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, position, gram hash, hash of the surroundings) of every anchor, a group of texts at a time.

    The surroundings reach from the first to behind the last string of
    `length` bytes that holds the gram, as far as the text goes.
    """
    wide = length - gram + 1
    for some in _pieces(texts, length):
        raw = b"".join(texts[k][a:b] for k, a, b, *_ in some)
        n = len(raw)
        sizes = np.array([b - a for _, a, b, *_ in some])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(some)), sizes)
        at = np.arange(n)
        room = ends[owner] - at  # bytes from here to the end of the piece
        room_for = n + AT_ONCE if n > 2 * AT_ONCE else 2 * AT_ONCE + 4 * length
        up, down = _powers(_BASE, room_for)[: n + 1], _powers(pow(_BASE, -1, 1 << 64), room_for)[: n + 1]
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * up[:n], out=total[1:])
            h = np.full(n, _MAX)
            h[: n - gram + 1] = _mix((total[gram:] - total[:-gram]) * down[: n - gram + 1]) | np.uint64(1)
            h[room < gram] = _MAX
            least = _slide(h, wide, np.minimum)
            least[room < length] = 0
            reach = _slide(least[::-1], wide, np.maximum)[::-1]
            found = np.flatnonzero((h == reach) & (room >= gram))
            part = owner[found]
            info = np.array([(k, a - e + (b - a), core, stop, size) for (k, a, b, core, stop, size), e in zip(some, ends)], np.int64)
            text, shift, core, stop, size = info[part].T
            pos = found + shift
            mine = (pos >= core) & (pos < stop)
            found, text, pos, size, shift = found[mine], text[mine], pos[mine], size[mine], shift[mine]
            low, high = np.maximum(pos - wide + 1, 0), np.minimum(pos + length, size)
            around = (total[high - shift] - total[low - shift]) * down[low - shift]
            around = _mix(around ^ _mix((pos - low).astype(np.uint64) * np.uint64(1 << 20) + (high - pos).astype(np.uint64)))
        yield text, pos, h[found].view(np.int64), around.view(np.int64)


def repeated(bucket: np.ndarray, rows: np.ndarray, first: np.ndarray, end: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which suffixes share `length` bytes with another row's of the same bucket and column.

    `rows` holds surroundings with the anchor in one column, bytes from
    `first` to `end` of each row being text. Returns (rows, columns) flags.
    """
    n, width = rows.shape
    columns = width - length + 1
    rows = np.pad(rows, ((0, 0), (8, 8)))
    word = lambda c, some=slice(None): np.ascontiguousarray(rows[some, c + 8 : c + 16]).view(">u8").ravel().astype(np.uint64)
    dense = lambda a, b: np.unique(a.astype(np.int64) * n + b, return_inverse=True)[1]

    @lru_cache(maxsize=None)
    def rank(c: int, periods: int) -> np.ndarray:
        """Rank among all rows of the bytes from column c over so many periods."""
        if periods == 1:
            keys = [word(c + k) for k in (*range(0, PERIOD - 8, 8), PERIOD - 8)]
            by = np.lexsort(keys[::-1])
            new = np.zeros(n, np.int64)
            new[1:] = np.logical_or.reduce([k[by[1:]] != k[by[:-1]] for k in keys])
            out = np.empty(n, np.int64)
            out[by] = np.cumsum(new)
            return out
        half = 1 << (periods - 1).bit_length() - 1
        return dense(rank(c, half), rank(c + half * PERIOD, periods - half))

    deep = (length - PERIOD + 1) // PERIOD  # periods that fit behind any cover column
    group = np.unique(bucket, return_inverse=True)[1]
    flags = np.zeros((n, columns), bool)
    for j in range(columns):
        skip = next(d for d in range(PERIOD) if (j + d) % PERIOD in COVER)
        fits = np.flatnonzero((first <= j) & (end >= j + length))
        if len(fits) < 2:
            continue
        key = group[fits] * n + rank(j + skip, deep)[fits]
        by = np.argsort(key, kind="stable")
        key = key[by]
        tied = np.append(False, key[1:] == key[:-1])
        tied[:-1] |= tied[1:]
        if not tied.any():
            continue
        some, key = fits[by[tied]], key[tied]
        before = [word(j + k, some) for k in range(0, skip, 8)]
        rest = length - skip - deep * PERIOD
        behind = [word(j + length - 8 * (k + 1), some) for k in range(-(-rest // 8))]
        by = np.lexsort((*behind, *before[::-1], key))
        some, key = some[by], key[by]
        pair = np.flatnonzero(key[1:] == key[:-1])
        alike = (rows[some[pair], j + 8 : j + 8 + length] == rows[some[pair + 1], j + 8 : j + 8 + length]).all(axis=1)
        flags[some[pair[alike]], j] = True
        flags[some[pair[alike] + 1], j] = True
    return flags


def _runs(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, end of its last string) of each run of flags."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    return row, start, stop - 1 + length


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches, "text"):
            ids = batch.column(0).to_numpy()
            raw = [t.encode("utf-8") for t in texts]
            check = np.array([zlib.crc32(t) for t in raw], np.int64)
            for found in anchors(raw, length):
                text, pos, last, count, gram, around = runs_of_equals(*found, gap=length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, around, ids[text], check[text], pos, last, count)], names=names)

    names = ["gram", "around", "id", "check", "pos", "last", "count"]
    return docs.select("id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _packed(docs: DataFrame) -> DataFrame:
    """The texts as zstandard frames, for the shuffles that need them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch, texts in text_runs(batches, "text"):
            raw = [t.encode("utf-8") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([zlib.crc32(t) for t in raw], pa.int64()), pa.array([pack.compress(t) for t in raw], pa.binary())],
                names=["doc_id", "id", "check", "packed"],
            )

    return docs.mapInArrow(run, "doc_id long, id long, check long, packed binary")


def _surroundings(packed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes around each wanted anchor, and where they begin and end."""
    wide = length - GRAM + 1
    per_text = wanted.groupBy("id", "check").agg(F.collect_list(F.struct("pos", "gram", "alone", "large")).alias("at"))
    met = packed.dropDuplicates(["id", "check"]).join(per_text, ["id", "check"]).select("id", "check", "packed", "at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("gram", "id", "check", "pos", "alone", "large", "first", "bytes")}
            size = 0
            for doc, check, packed, at in zip(*(c.to_pylist() for c in batch.columns)):
                raw = unpack.decompress(packed)
                for a in at:
                    pos = a["pos"]
                    low, high = max(pos - wide + 1, 0), min(pos + length, len(raw))
                    for c, x in zip(out, (a["gram"], doc, check, pos, a["alone"], a["large"], low - (pos - wide + 1), raw[low:high])):
                        out[c].append(x)
                    size += high - low
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict(out)
                        out, size = {c: [] for c in out}, 0
            if size:
                yield pa.RecordBatch.from_pydict(out)

    return met.mapInArrow(run, "gram long, id long, check long, pos long, alone boolean, large boolean, first long, bytes binary")


def _sorted_blocks(around: DataFrame, length: int) -> DataFrame:
    """Removed spans (id, check, low, high) found by sorting the buckets of `around`."""
    wide = length - GRAM + 1
    width = wide - 1 + length
    names = ["gram", "id", "check", "pos", "alone", "first", "bytes"]

    def solve(t: pa.Table) -> pa.RecordBatch:
        gram, doc, check, pos, alone, first = (t.column(c).to_numpy() for c in names[:-1])
        raw = t.column("bytes").to_pylist()
        rows = np.zeros((len(raw), width), np.uint8)
        for k, (a, x) in enumerate(zip(first.tolist(), raw)):
            rows[k, a : a + len(x)] = np.frombuffer(x, np.uint8)
        end = first + np.fromiter(map(len, raw), np.int64, len(raw))
        flags = repeated(gram, rows, first, end, length)
        flags[~alone.astype(bool)] = False  # known already
        row, low, high = _runs(flags, length)
        origin = pos[row] - wide + 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], check[row], origin + low, origin + high)], names=["id", "check", "low", "high"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BLOCK:
                continue
            t = pa.Table.from_batches(held)
            grams = t.column("gram").to_numpy()
            done = int(np.searchsorted(grams, grams[-1]))  # the last bucket may go on
            cuts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            lo = 0
            while lo < done:
                hi = int(cuts[min(np.searchsorted(cuts, lo + BLOCK), len(cuts) - 1)])
                yield solve(t.slice(lo, hi - lo))
                lo = hi
            held, n = t.slice(lo).combine_chunks().to_batches(), t.num_rows - lo
        if n:
            yield solve(pa.Table.from_batches(held))

    placed = around.where("not large").select(*names).repartition("gram").sortWithinPartitions("gram")
    return placed.mapInArrow(run, "id long, check long, low long, high long")


def _counted_suffixes(around: DataFrame, length: int) -> DataFrame:
    """Removed spans (id, check, low, high) of buckets that are too large to sort, from digests of their suffixes."""
    wide = length - GRAM + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, check, pos, alone, first, raw in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(raw) - length + 1
                digests = [xxhash.xxh3_128_digest(raw[k : k + length]) for k in range(n)]
                start = pos - wide + 1 + first
                yield pa.RecordBatch.from_pydict({"digest": digests, "id": [doc] * n, "check": [check] * n, "low": list(range(start, start + n)), "alone": [alone] * n})

    each = around.where("large").select("id", "check", "pos", "alone", "first", "bytes").mapInArrow(run, "digest binary, id long, check long, low long, alone boolean")
    # surroundings of several anchors overlap, so one suffix can come more than once: count places, not rows
    place = F.struct("id", "check", "low")
    again = each.groupBy("digest").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one <> other").select("digest")
    return each.where("alone").join(again, "digest").select("id", "check", "low", (F.col("low") + length).alias("high"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `keep_text` the bytes left, `kept`, per row of `docs`.

    Removed is every byte that a string of `length` bytes covers which also
    starts anywhere else in the table, in the same text too; overlapping
    occurrences count and all strings are judged on the input. Texts are taken
    as UTF-8, null as empty, and nothing reaches across texts. Texts shorter
    than `length` stay whole. Rows repeated with the same id and text are each
    other's copies; null ids are kept as null. An empty table gives no rows.
    """
    if length < 2 * GRAM + PERIOD:
        raise ValueError(f"strings shorter than {2 * GRAM + PERIOD} bytes aren't served")
    plain = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    )
    # written, as they are read twice; and so is the other side of each join, so that a common gram can be split there
    found = cut_lineage(_anchor_rows(plain, length), "anchors")
    again = found.groupBy("gram").agg(F.sum("count").alias("n")).where("n > 1").select("gram")
    live = cut_lineage(found.join(cut_lineage(again, "grams"), "gram"), "live")
    alike = live.groupBy("gram", "around").agg(F.sum("count").alias("n"), F.min(F.struct("id", "check", "pos")).alias("first"))
    alike = cut_lineage(alike, "alike")
    buckets = cut_lineage(alike.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")), "buckets")
    marked = live.join(alike, ["gram", "around"]).select(
        "gram", "id", "check", "pos", "last", (F.col("n") == 1).alias("alone"), (F.struct("id", "check", "pos") == F.col("first")).alias("speaks")
    )
    marked = cut_lineage(marked, "marked")
    wide = length - GRAM + 1
    copied = marked.where("not alone").select("id", "check", (F.col("pos") - wide + 1).alias("low"), (F.col("last") + length).alias("high"))
    several = buckets.where("kinds > 1").select("gram", (F.col("kinds") > LARGEST).alias("large"))
    # of equal surroundings one speaks for all; repeated rows of one text share it
    wanted = marked.drop("last").where("alone or speaks").dropDuplicates(["gram", "id", "check", "pos"]).join(several, "gram")
    packed = _packed(plain)
    around = cut_lineage(_surroundings(packed, wanted, length), "around")
    spans = _sorted_blocks(around, length).union(_counted_suffixes(around, length)).union(copied)
    per_text = spans.groupBy("id", "check").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    met = packed.join(per_text, ["id", "check"], "left").select("doc_id", "packed", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for doc, packed, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = unpack.decompress(packed)
                kept, at, removed, n = [], 0, 0, 0
                runs: list[list[int]] = []
                for low, high in sorted((max(s["low"], 0), min(s["high"], len(raw))) for s in spans or ()):
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
                for low, high in runs:
                    kept.append(raw[at:low])
                    at, removed, n = high, removed + high - low, n + 1
                left = b"".join((*kept, raw[at:]))
                for c, x in zip(out, (doc, len(raw), removed, n, sha256(left).hexdigest(), left)):
                    out[c].append(x)
            if not keep_text:
                del out["kept"]
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    schema = pa.schema([(c, k) for c, k in kinds.items() if keep_text or c != "kept"])
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
