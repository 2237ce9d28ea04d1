"""Prefix trie of conversations: double-array tries over ranges of sorted turn sequences.

A conversation is a sequence of turns, each known by the SHA-256 of its role
and text. It is cut into segments of a bounded number of turns; what comes
before a segment is known by a digest chained over the earlier ones. Equal
segments after equal beginnings are counted together, the distinct ones are
range-sorted, and every stretch of that order becomes one shard: its turn ids
are made dense, its BASE and CHECK arrays packed, and its nodes found by
traversing them. Only nodes on a shard's first or last sequence, and those
between two segments, can also lie in another shard: these "open" nodes are
merged by their digest, and their sums handed to the nodes above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import words_of

#: Turns in a segment of a conversation.
SEGMENT = 64
#: Turns in a shard.
SHARD = 1 << 17
#: Characters of joined ids in a piece.
PIECE = 1 << 20
MARK = 64  # hex digits of a turn's digest
EMPTY = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """Trie transitions in two arrays: `check[base[s] + c] == s` where node s has a child by symbol c."""

    TRIES, WINDOW = 64, 4096

    def __init__(self, room: int):
        self.base, self.check = np.zeros(room + 1, np.int64), np.full(room + 1, -1, np.int64)
        self.check[0] = 0  # the root's own place
        self.low = self.end = 1  # no place before `low` is free, none from `end` on is taken

    def _reach(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            more = max(more, len(self.check) // 2)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Places for children given by ascending runs of one parent each; a parent gets all its children at once."""
        new = np.ones(len(parents), bool)
        new[1:] = parents[1:] != parents[:-1]
        starts = np.nonzero(new)[0]
        stops = np.append(starts[1:], len(parents))
        out = np.empty(len(parents), np.int64)
        many = np.nonzero(stops - starts > 1)[0]
        for k in many[np.argsort(starts[many] - stops[many], kind="stable")]:  # the widest first
            own = symbols[starts[k] : stops[k]]
            out[starts[k] : stops[k]] = self._fit(parents[starts[k]], own)
        single = starts[stops - starts == 1]
        free = np.nonzero(self.check < 0)[0][: len(single)]
        if len(free) < len(single):
            short = len(single) - len(free)
            free = np.concatenate([free, np.arange(len(self.check), len(self.check) + short)])
            self._reach(int(free[-1]) + 1)
        self.base[parents[single]] = free - symbols[single]
        self.check[free] = parents[single]
        self.end = max(self.end, int(free[-1]) + 1) if len(free) else self.end
        out[single] = free
        return out

    def _fit(self, parent: int, symbols: np.ndarray) -> np.ndarray:
        self._reach(self.low + self.WINDOW)
        while not (free := np.nonzero(self.check[self.low : self.low + self.WINDOW] < 0)[0][: self.TRIES] + self.low).size:
            self.low += self.WINDOW
            self._reach(self.low + self.WINDOW)
        self.low = int(free[0])
        for slot in free:
            places = slot + symbols - symbols[0]
            self._reach(int(places[-1]) + 1)
            if (self.check[places] < 0).all():
                break
        else:
            places = self.end + symbols - symbols[0]
            self._reach(int(places[-1]) + 1)
        self.base[parent] = places[0] - symbols[0]
        self.check[places] = parent
        self.end = max(self.end, int(places[-1]) + 1)
        return places

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children by those symbols, -1 where there is none."""
        places = self.base[states] + symbols
        inside = (places > 0) & (places < len(self.check))
        places = np.where(inside, places, 0)
        return np.where(inside & (self.check[places] == states), places, -1)


def _packed(sequences: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """Double-array trie of sorted distinct sequences (rows of symbols)."""
    trie = DoubleArray(int(lengths.sum()) + 1)
    states = np.zeros(len(sequences), np.int64)
    for d in range(int(lengths.max())):
        rows = np.nonzero(lengths > d)[0]
        parents, symbols = states[rows], sequences[rows, d]
        new = np.ones(len(rows), bool)
        new[1:] = (parents[1:] != parents[:-1]) | (symbols[1:] != symbols[:-1])
        states[rows] = trie.add(parents[new], symbols[new])[np.cumsum(new) - 1]
    return trie


_NODES = pa.schema(
    [
        ("open", pa.bool_()),
        ("key", pa.string()),
        ("parent_key", pa.string()),
        ("prefix", pa.string()),
        ("above", pa.list_(pa.string())),
        ("depth", pa.int64()),
        ("words", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
    ]
)
_NODES_SQL = (
    "open boolean, key string, parent_key string, prefix string, above array<string>, depth long, words long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def key_of(prefix: str | Column, path: str | Column):
    """Identity of the node at the end of `path` after the beginning `prefix`; '' is the root."""
    if isinstance(prefix, str):
        return _digest(prefix + _digest(path)) if path else prefix
    return F.when(path == "", prefix).otherwise(F.sha2(F.concat(prefix, F.sha2(path, 256)), 256))


def _shard_nodes(rows: list[tuple], segment: int) -> pa.RecordBatch:
    """Nodes of one shard: sorted distinct (prefix, path, seg, words, n, first, n_end)."""
    prefixes, paths, segs, words, count, first, n_end = zip(*rows)
    count, first, n_end = (np.array(x, np.int64) for x in (count, first, n_end))
    lengths = np.array([len(p) // MARK for p in paths], np.int64)
    # dense symbols: turns first, then the beginnings, which are the first symbols of their paths
    marks = np.array([p[k : k + MARK] for p in paths for k in range(0, len(p), MARK)], f"S{MARK}")
    known, dense = np.unique(marks, return_inverse=True)
    starts, which = np.unique(np.array(prefixes), return_inverse=True)
    reach = int(lengths.max()) + 1
    sequences = np.full((len(rows), reach), -1, np.int64)
    sequences[:, 0] = which + len(known)
    inside = np.arange(1, reach)[None, :] <= lengths[:, None]
    sequences[:, 1:][inside] = dense
    spoken = np.zeros((len(rows), reach), np.int64)
    spoken[:, 1:][inside] = np.array([w for some in words for w in some], np.int64)
    trie = _packed(sequences, lengths + 1)

    size = len(trie.check)
    n, least, said, depth = (np.zeros(size, np.int64) for _ in range(4))
    least[:] = np.iinfo(np.int64).max
    level, top = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    opened = np.zeros(size, bool)
    keys: dict[int, str] = {}
    states = np.zeros(len(rows), np.int64)
    held = [hashlib.sha256() for _ in range(reach)]  # of the path at hand, by depth
    for d in range(reach):
        at = np.nonzero(lengths + 1 > d)[0]
        states[at] = trie.step(states[at], sequences[at, d])
        t = states[at]
        np.add.at(n, t, count[at])
        np.minimum.at(least, t, first[at])
        said[t], level[t], depth[t], top[t] = spoken[at, d], d, np.array(segs)[at] * segment + d, which[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = t[1:] != t[:-1]
        for row, node in zip(at[fresh].tolist(), t[fresh].tolist()):
            keys[node] = (row, d)
        if d == 0:
            opened[t] = True
        opened[t[(at == 0) | (at == len(rows) - 1)]] = True
        ends_here = (lengths[at] == d) & (count[at] > n_end[at])
        opened[t[ends_here]] = True
    nodes = np.array(sorted(keys, key=keys.get), np.int64)  # by path, then depth
    for node in nodes.tolist():
        row, d = keys[node]
        if d:
            h = held[d - 1].copy() if d > 1 else hashlib.sha256()
            h.update(paths[row][(d - 1) * MARK : d * MARK].encode())
            held[d] = h
            keys[node] = _digest(prefixes[row] + h.hexdigest())
        else:
            keys[node] = prefixes[row]
    parent = trie.check
    kids, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    closed = ~opened
    for d in range(reach - 1, 0, -1):
        t = nodes[(level[nodes] == d) & closed[nodes]]
        leaves[t] += kids[t] == 0
        # children that are open count where they are merged, but they keep their parent from being childless
        saved[t] += (n[t] - 1) * said[t]
        np.add.at(kids, parent[t], 1)
        np.add.at(leaves, parent[t], leaves[t])
        np.add.at(saved, parent[t], saved[t])
        below = nodes[(level[nodes] == d) & opened[nodes]]
        np.add.at(kids, parent[below][closed[parent[below]]], 1)
    out = []
    for node in nodes.tolist():
        is_open, d, up = bool(opened[node]), int(level[node]), int(parent[node])
        prefix = str(starts[top[node]])
        border = d == 0 and prefix != ""
        above = None
        if is_open and d:
            above, x = [], up
            while level[x] > 0 or (level[x] == 0 and prefix == ""):
                above.append(keys[x])
                if level[x] == 0:
                    break
                x = int(parent[x])
        out.append(
            (
                is_open,
                keys[node],
                keys[up] if d else None,
                prefix if d else None,
                above,
                int(depth[node]),
                None if border else int(said[node]),
                None if border else int(least[node]),
                int(least[up]) if d and closed[up] else None,
                0 if border else int(n[node]),
                int(kids[node]),
                int(leaves[node]),
                int(saved[node]),
            )
        )
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODES)], schema=_NODES)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, words): each turn's digest and number of words. Null roles and texts count as empty.

    Rows without conv_id take no part.
    """
    role, body = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, body), 256)
    named = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), mark.alias("mark"), words_of(body).alias("words")
    )
    return named.where("conv_id IS NOT NULL")


def numbered(turn_rows: DataFrame) -> DataFrame:
    """(conv_id, pos, mark, words): positions from 1 by turn (null first), ties by digest.

    Rows lie in ranges of (conv_id, turn, mark), so that a conversation with
    any share of the rows is numbered range by range.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("mark")]
    ranged = turn_rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged, "turns")
    sizes = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order))
    placed = ranged.select("conv_id", "part", "mark", "words", place.alias("place"))
    return placed.join(sizes, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("place")).alias("pos"), "mark", "words")


def _chained(segments: DataFrame) -> DataFrame:
    """(conv_id, seg, prefix) of every segment after a conversation's first: the digest of all before it."""

    def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = prefix = None
        for batch in batches:
            out = []
            for conv, seg, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != last:
                    last, prefix = conv, ""
                if seg:
                    out.append((conv, seg, prefix))
                prefix = _digest(prefix + digest)
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["conv_id", "seg", "prefix"]
            )

    narrow = segments.where("longer OR seg > 0").select("conv_id", "seg", F.sha2("path", 256).alias("digest"))
    placed = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return placed.mapInArrow(chain, "conv_id long, seg long, prefix string")


def _ends(enders: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): ids of one key are joined piece by piece, so no list of them is gathered."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size, out = None, None, [], 0, []

        def close():
            if ids:
                out.append((key, first, ",".join(ids)))

        def flush():
            a, b, c = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["key", "first", "ids"]
            )

        for batch in batches:
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or size > PIECE:
                    close()
                    key, first, ids, size = k, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield flush()
            out.clear()
        close()
        yield flush()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k == key:
                    h.update(b",")
                else:
                    if h:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                h.update(ids.encode())
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["key", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [h.hexdigest()]})

    ordered = enders.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = ordered.mapInArrow(pieces, "key string, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key string, ends_sha256 string")


def trie(convs: DataFrame, rows: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """One row per node of the prefix trie, the textless root (depth 0) included.

    `convs` holds the distinct conv_id of all conversations, `rows` their
    turns as (conv_id, pos from 1, mark, words); conversations without turns
    end at the root. Columns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Equal conversations share their nodes. Without any conversation there is
    no node at all.
    """
    rows = rows.select("conv_id", F.floor((F.col("pos") - 1) / segment).alias("seg"), "pos", "mark", "words")
    spoken = F.array_sort(F.collect_list(F.struct("pos", "mark", "words")))  # `segment` turns at most
    parts = rows.groupBy("conv_id", "seg").agg(spoken.alias("turns"))
    parts = parts.select("conv_id", "seg", F.array_join("turns.mark", "").alias("path"), F.col("turns.words").alias("words"))
    parts = cut_lineage(parts, "segments")
    onward = parts.where("seg > 0").select("conv_id", (F.col("seg") - 1).alias("seg"), F.lit(True).alias("longer"))
    has_long = not onward.isEmpty()
    bare = convs.join(parts.where("seg = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("seg"), F.lit("").alias("path"), F.array().cast("array<long>").alias("words")
    )
    if has_long:
        parts = parts.join(onward, ["conv_id", "seg"], "left").withColumn("longer", F.coalesce("longer", F.lit(False)))
        chained = cut_lineage(_chained(parts), "chained")
        parts = parts.join(chained, ["conv_id", "seg"], "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))
    else:
        parts = parts.withColumns({"longer": F.lit(False), "prefix": F.lit("")})
    parts = parts.unionByName(bare.withColumns({"longer": F.lit(False), "prefix": F.lit("")}))
    parts = cut_lineage(parts, "parts")

    distinct = parts.groupBy("prefix", "path", "seg", "words").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.count_if(~F.col("longer")).alias("n_end")
    )

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3]) + 1
                if size >= shard:
                    yield _shard_nodes(held, segment)
                    held, size = [], 0
        if held:
            yield _shard_nodes(held, segment)

    ordered = distinct.repartitionByRange("prefix", "path").sortWithinPartitions("prefix", "path")
    nodes = cut_lineage(ordered.mapInArrow(shards, _NODES_SQL), "nodes")

    # open nodes: what the shards know of one node is put together
    merged = nodes.where("open").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"),
        F.max("prefix").alias("prefix"),
        F.max("above").alias("above"),
        F.max("depth").alias("depth"),
        F.max("words").alias("words"),
        F.min("conv_id").alias("conv_id"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed_children"),
        F.sum("n_leaves").alias("closed_leaves"),
        F.sum("saved_tokens").alias("closed_saved"),
    )
    merged = cut_lineage(merged, "merged")
    kids = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    n_children = F.col("closed_children") + F.coalesce("kids", F.lit(0))
    valued = merged.join(kids, "key", "left").select(
        "key",
        "parent_key",
        "prefix",
        "above",
        "depth",
        "conv_id",
        "parent_conv_id",
        "n_convs",
        "closed_leaves",
        "closed_saved",
        n_children.alias("n_children"),
        (F.col("closed_leaves") + (n_children == 0).cast("long")).alias("leaves"),
        (F.col("closed_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    valued = cut_lineage(valued, "valued")
    added = valued.select("key", "above", "leaves", "saved")
    if has_long:
        added = added.join(_beyond(valued, parts), "key", "left").select(
            "key",
            "above",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
    receivers = F.explode(F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("key")))
    sums = added.select(receivers.alias("key"), "leaves", "saved").groupBy("key").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    sums = cut_lineage(sums, "sums")
    columns = ["key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    opened = valued.join(sums, "key").select(*columns)
    closed = nodes.where("NOT open").select(*columns)
    if has_long:  # nodes of one shard above a border between segments
        late = sums.select("key", F.col("n_leaves").alias("late_leaves"), F.col("saved_tokens").alias("late_saved"))
        closed = closed.join(late, "key", "left").withColumns(
            {
                "n_leaves": F.col("n_leaves") + F.coalesce("late_leaves", F.lit(0)),
                "saved_tokens": F.col("saved_tokens") + F.coalesce("late_saved", F.lit(0)),
            }
        )
        closed = closed.select(*columns)
    found = cut_lineage(closed.union(opened), "found")

    # a parent inside the shard is known already, an open one by its digest
    ids = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    known = found.where("parent_conv_id IS NOT NULL OR parent_key IS NULL")
    asking = found.where("parent_conv_id IS NULL AND parent_key IS NOT NULL").drop("parent_conv_id")
    named = asking.join(ids, "parent_key").withColumnRenamed("up", "parent_conv_id")
    enders = parts.where("NOT longer").select(key_of(F.col("prefix"), F.col("path")).alias("key"), "conv_id")
    ends = cut_lineage(_ends(enders), "ends")
    whole = cut_lineage(known.unionByName(named), "named")
    return whole.join(ends, "key", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def _beyond(valued: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, more_leaves, more_saved) of nodes between segments: sums over all later segments below them.

    A segment's sums are booked on the smallest conversation that enters it, and each
    conversation hands what is booked on it to its earlier borders, so no
    border waits for a deeper one.
    """
    borders = parts.where("seg > 0").select("conv_id", "seg", F.col("prefix").alias("key"))
    keys = cut_lineage(borders.groupBy("key").agg(F.min("conv_id").alias("keeper")), "border_keys")
    own = keys.join(valued.select("key", "closed_leaves", "closed_saved"), "key")
    # what lies closed under a border belongs to the segment after it
    inside = valued.where("prefix <> ''").join(keys.select("key", F.lit(True).alias("border")), "key", "left")
    inner = inside.groupBy(F.col("prefix").alias("key")).agg(
        F.sum(F.when(F.col("border"), F.col("leaves") - F.col("closed_leaves")).otherwise(F.col("leaves"))).alias("rest_leaves"),
        F.sum(F.when(F.col("border"), F.col("saved") - F.col("closed_saved")).otherwise(F.col("saved"))).alias("rest_saved"),
    )
    own = own.join(inner, "key", "left").na.fill(0, ["rest_leaves", "rest_saved"])
    own = cut_lineage(own, "borders")
    booked = borders.join(own, "key")
    mine = F.col("conv_id") == F.col("keeper")
    later = W.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(W.unboundedPreceding, -1)
    deep = booked.select(
        "key",
        F.sum(F.when(mine, F.col("closed_leaves") + F.col("rest_leaves")).otherwise(0)).over(later).alias("deep_leaves"),
        F.sum(F.when(mine, F.col("closed_saved") + F.col("rest_saved")).otherwise(0)).over(later).alias("deep_saved"),
    )
    deep = deep.groupBy("key").agg(F.sum("deep_leaves").alias("deep_leaves"), F.sum("deep_saved").alias("deep_saved"))
    return own.join(deep, "key", "left").select(
        "key",
        (F.col("rest_leaves") + F.coalesce("deep_leaves", F.lit(0))).alias("more_leaves"),
        (F.col("rest_saved") + F.coalesce("deep_saved", F.lit(0))).alias("more_saved"),
    )
