"""Near copies by SimHash, linked through anchor points of a covering code.

Two 64-bit fingerprints that differ in at most `distance` bits differ in at
most `distance // 3` bits of one of three segments. In a segment the words of
a covering code (a Hamming code of 15 bits next to all words of the other 6 or
7 bits; covering radius 1) are the anchors. A fingerprint's home is its
nearest anchor; it is replicated to every anchor within covering radius plus
segment threshold, so the home of either of two such fingerprints holds both.
Per anchor the homes are compared with all that came there.

Fingerprints of several lanes have four segments of 16 bits a lane. Their
thresholds t differ: with the sum of t + 1 one above `distance`, two
fingerprints that exceed t in every segment differ in more than `distance`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_text, text_runs
from .components import components

SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
LANE_SEGMENTS = ((0, 16), (16, 16), (32, 16), (48, 16))
RADIUS = 1
#: Homes of one anchor that are compared in one task; more are dealt over several.
HOMES = 4096
#: Comparisons made at once.
AT_ONCE = 1 << 21


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """Further hashes made of a hash; the first is itself."""
    if not lane:
        return h
    h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of a text's shingles of `words` words: bit set where over half the shingles' XXH64 have it."""
    return fingerprint_lanes(text, words, 1)[0]


def fingerprint_lanes(text: str, words: int, lanes: int) -> list[int]:
    """SimHash of 64 bits a lane; the first lane is `fingerprint`."""
    parts = text.encode("utf-8").lower().split()
    if not parts:
        return [0] * lanes
    body = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = max(len(parts) - words + 1, 1)
    pairs = zip(starts[:last].tolist(), ends[-last:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[a:b], SEED) for a, b in pairs), np.uint64, last)
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for k in range(0, last, 1 << 14):
            part = _mix(hashes[k : k + (1 << 14)], lane).astype("<u8").view(np.uint8)
            bits = np.unpackbits(part, bitorder="little").reshape(-1, 64)
            at = np.arange(0, len(bits), 255)  # as many ones as a byte can count
            counts += np.add.reduceat(bits, at, axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > last, bitorder="little").view("<u8")[0]))
    return out


def lane_names(lanes: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, lanes))]


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text", lanes: int = 1) -> DataFrame:
    """(doc_id, fp long and a column for each further lane) per row.

    A text without words (null or empty too) has fingerprint 0, a short one is one shingle.
    """
    names = lane_names(lanes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_runs(batches, "text"):
            fps = np.array([fingerprint_lanes(t, words, lanes) for t in texts], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, k]) for k in range(lanes))], names=["doc_id", *names])

    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))


def _reach(free: int, within: int) -> list[np.ndarray]:
    """By syndrome: the changes that lead to the anchors within that distance, the nearest first."""
    out = []
    flips = [1 << (15 + k) for k in range(free)]
    for s in range(16):
        code = [0] if s == 0 else []
        for n in range(1, within + 1):
            for some in combinations(range(1, 16), n):
                x = 0
                for i in some:
                    x ^= i
                if x == s:
                    code.append(sum(1 << (i - 1) for i in some))
        reach = []
        for c in code:
            for n in range(within - c.bit_count() + 1):
                reach += [c + sum(some) for some in combinations(flips, n)]
        out.append(np.array(sorted(reach, key=int.bit_count), np.int64))
    return out


def _syndromes() -> np.ndarray:
    s = np.zeros(1 << 15, np.int64)
    words = np.arange(1 << 15)
    for i in range(15):
        s ^= np.where(words >> i & 1, i + 1, 0)
    return s


def covering(distance: int, lanes: int) -> list[list[tuple[int, int, int, int]]]:
    """By lane: (number, lowest bit, size, threshold) of each segment; one threshold at least holds within `distance`."""
    if lanes == 1:
        return [[(k, low, size, distance // len(SEGMENTS)) for k, (low, size) in enumerate(SEGMENTS)]]
    n = len(LANE_SEGMENTS)
    each, more = divmod(distance + 1, lanes * n)  # t + 1 of all segments sum to distance + 1
    limits = [each - 1 + (k < more) for k in range(lanes * n)]
    return [
        [(lane * n + k, low, size, limits[lane * n + k]) for k, (low, size) in enumerate(LANE_SEGMENTS) if limits[lane * n + k] >= 0]
        for lane in range(lanes)
    ]


def anchors(fps: np.ndarray, segments: list[tuple[int, int, int, int]], homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row of `fps`, home flag) of every replica."""
    syndrome = _syndromes()
    keys, rows, homes = [], [], []
    for k, low, size, limit in segments:
        part = (fps.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << size) - 1)
        by = syndrome[part & 0x7FFF]
        for s, reach in enumerate(_reach(size - 15, RADIUS + limit)):
            reach = reach[:1] if homes_only else reach
            at = np.flatnonzero(by == s)
            keys.append(((part[at, None] ^ reach) | (k << 32)).ravel())
            rows.append(np.repeat(at, len(reach)))
            homes.append(np.tile(np.arange(len(reach)) == 0, len(at)))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b reduced to one link per value, to the smallest value it can reach through them."""
    values, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def pairs_within(
    group: np.ndarray, fps: list[np.ndarray], home: np.ndarray, distance: int, may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, home it is near, differing bits) within sorted groups whose homes come first, some at a time.

    `may(rows, homes)` tells which pairs need their bits compared.
    """
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    n_homes = np.add.reduceat(home.astype(np.int64), starts)
    mine = np.repeat(np.arange(len(starts)), sizes)  # group of each row
    work = n_homes[mine]  # homes each row is compared with
    done = np.cumsum(work)
    lo = 0
    while lo < len(group):
        hi = max(int(np.searchsorted(done, (done[lo - 1] if lo else 0) + AT_ONCE, "right")), lo + 1)
        w = work[lo:hi]
        row = np.repeat(np.arange(lo, hi), w)
        with_home = starts[mine[row]] + np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
        if may:
            chosen = may(row, with_home)
            row, with_home = row[chosen], with_home[chosen]
        apart = np.zeros(len(row), np.int64)
        for lane in fps:
            apart += np.bitwise_count(lane[row] ^ lane[with_home])
        near = (apart <= distance) & (row != with_home)
        if near.any():
            yield row[near], with_home[near], apart[near]
        lo = hi


def compare_groups(group: np.ndarray, fps: list[np.ndarray], home: np.ndarray, node: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within sorted groups whose homes come first, as forests."""
    for row, with_home, _ in pairs_within(group, fps, home, distance):
        yield forest(node[row], node[with_home])


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by (group, home first), cut between groups.

    A long group comes in parts, each with all homes seen so far.
    """
    held: list[np.ndarray] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        if held:
            now = [np.concatenate(x) for x in zip(held, now)]
        at = int(np.searchsorted(now[0], now[0][-1]))  # the last group may go on
        whole, held = [x[:at] for x in now], [x[at:] for x in now]
        if at:
            yield whole
        elif len(held[0]) > 2 * HOMES:  # a long group: its homes stay, the others can go once compared
            yield held
            held = [x[held[1]] for x in held]
    if held:
        yield held


def link(prints: DataFrame, distance: int = 4, lanes: int = 1) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints (fp long) differing in at most `distance` bits.

    No link is missed. With several lanes the distance is that of all lanes
    together, and u and v are hashes of the fingerprints.
    """
    if lanes == 1 and not 0 <= distance < 6:
        raise ValueError("three segments with covering radius 1 serve distances 0 to 5")
    names = lane_names(lanes)
    segments = covering(distance, lanes)

    def replicate(batches: Iterable[pa.RecordBatch], homes_only: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, *every = (c.to_numpy() for c in batch.columns)
            for k in range(0, len(node), 5000):
                for lane, parts in enumerate(segments):
                    if not parts:
                        continue
                    keys, rows, homes = anchors(every[lane][k : k + 5000], parts, homes_only)
                    rows = rows + k
                    cols = [keys, node[rows], *(x[rows] for x in every), homes]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["anchor", "node", *names, "home"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, home, node, *fps in whole_groups(batches):
            for u, v in compare_groups(group, [x.view(np.uint64) for x in fps], home, node, distance):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    of_node = F.col("fp") if lanes == 1 else F.xxhash64(*names)
    longs = ", ".join(f"{c} long" for c in names)
    schema = f"anchor long, node long, {longs}, home boolean"
    distinct = prints.select(of_node.alias("node"), *names).distinct()
    if lanes == 1:
        replicas = cut_lineage(distinct.mapInArrow(replicate, schema), "replicas")
        homes = replicas.where("home")
    else:  # some 240 replicas each: only the homes are written
        distinct = cut_lineage(distinct, "distinct")
        replicas = distinct.mapInArrow(replicate, schema)
        homes = cut_lineage(distinct.mapInArrow(lambda batches: replicate(batches, True), schema), "homes")
    hot = homes.groupBy("anchor").agg(F.count(F.lit(1)).alias("homes")).where(F.col("homes") > HOMES)
    parts = hot.select("anchor", F.ceil(F.col("homes") / HOMES).cast("int").alias("parts"))
    if lanes > 1:  # read with each side of the union
        parts = cut_lineage(parts, "hot")
    dealt = replicas.join(parts, "anchor", "left").select(
        "node",
        *names,
        "home",
        "anchor",
        F.explode(
            F.when(F.col("parts").isNull(), F.array(F.lit(0)))
            .when(F.col("home"), F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
            .otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        ).alias("part"),
    )
    # homes of different parts meet as well: in a part all other homes of the anchor appear as guests
    guests = homes.join(parts, "anchor").select(
        "node",
        *names,
        F.lit(False).alias("home"),
        "anchor",
        F.explode(
            F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.pmod(F.xxhash64("node"), F.col("parts")))
        ).alias("part"),
    )
    keyed = dealt.union(guests).select(F.xxhash64("anchor", "part").alias("group"), "home", "node", *names)
    placed = keyed.repartition("group").sortWithinPartitions("group", F.col("home").desc())
    return placed.mapInArrow(compare, "u long, v long")


def near_copies(docs: DataFrame, words: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links of at
    most `distance` differing bits, the row's own included; null where a
    component has no doc_id at all. Equal texts share a fingerprint and so a
    component, as do all texts without words. Repeated rows stay repeated. An
    empty table gives an empty result; other columns are not looked at.
    """
    prints = cut_lineage(fingerprints(docs, words, doc_id, text), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(link(prints, distance))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = cut_lineage(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(first, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
