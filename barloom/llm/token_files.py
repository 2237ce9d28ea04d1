"""Token ids as seekable binary files.

A shard file holds independent zstandard frames, each the little-endian
unsigned 32-bit ids of some whole documents; then, in a skippable frame, the
table of its documents; then the seek table of the public zstd seekable
format, with both sizes and a checksum (low half of XXH64) for every frame. A
reader takes the tail of the file, then only the frames it needs.

Shards are written by the tasks themselves under names of their own, and a
task reports the name it has finished; a lost or repeated task leaves at most
a file that no manifest names.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .common import id_text, slices

#: Fixed values of the zstd formats.
SKIPPABLE_TABLE, SKIPPABLE_SEEK, SEEKABLE, HAS_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of ids after which a frame is closed; a document is never cut.
FRAME_BYTES = 1 << 20
LEVEL = 1
REMEMBERED = 600_000

_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI as Spark writes it, and the path in it."""
    if re.match(r"file:/*", path):
        path = re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (pafs.LocalFileSystem(), path)


class ShardWriter:
    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.fs, where = filesystem(path)
        self.fs.create_dir(os.path.dirname(where), recursive=True)
        self.out = self.fs.open_output_stream(where, compression=None)
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frame_bytes = frame_bytes
        self.docs: list[tuple] = []
        self.frames: list[tuple] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > self.frame_bytes:
            self.flush()
        self.docs.append((doc_id or 0, doc_id is not None, len(self.frames), self.size // 4, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)

    def flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        table = self.pack.compress(np.array(self.docs, _DOC).tobytes())
        seek = np.array(self.frames, _SEEK).tobytes() + struct.pack("<IBI", len(self.frames), HAS_CHECKSUM, SEEKABLE)
        # the table's length, so that a reader of the tail finds its start
        table += struct.pack("<I", len(table))
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.out.close()


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, path: str):
        fs, where = filesystem(path)
        self.file = fs.open_input_file(where)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or flags != HAS_CHECKSUM:
            raise ValueError(f"{path} ends without a seek table")
        start = end - 9 - n * _SEEK.itemsize
        self.frames = np.frombuffer(self._at(start, n * _SEEK.itemsize), _SEEK)
        self.begins = np.append(0, np.cumsum(self.frames["packed"], dtype=np.int64))
        (size,) = struct.unpack("<I", self._at(start - 12, 4))
        self.unpack = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.unpack.decompress(self._at(start - 12 - size, size)), _DOC)
        self.held: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            raw = self.unpack.decompress(self._at(int(self.begins[k]), int(self.frames["packed"][k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames["check"][k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.held = (k, raw)
        return self.held[1]

    def ids(self, row: int) -> bytes:
        """Ids of the row-th document; only its frame is read."""
        d = self.docs[row]
        return self.frame(int(d["frame"]))[int(d["at"]) * 4 : int(d["at"] + d["n"]) * 4]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with that doc_id."""
        return [np.frombuffer(self.ids(int(k)), "<u4") for k in np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["known"] == 1))]

    def close(self) -> None:
        self.file.close()


class WordEncoder:
    """The tokenizers library behind a memory of the words it has seen.

    For files that drop white space: pieces never reach across it, so a text's
    ids are those of its words one after the other. Words are cut and numbered
    by Arrow; only new ones become Python strings, and what is known lies in
    three arrays. Words of letters alone go
    to the library side by side and are told apart by the mark that ends a
    word; everything else goes by itself.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_padding()
        self.lib.no_truncation()
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(self.lib.get_vocab_size(with_added_tokens=True) + 1, bool)
        self.closing[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.words, self.ids, self.begins = pa.array([], pa.string()), np.empty(0, "<u4"), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words that are not known."""
        tails = {w: b for w in words if (b := w.rstrip(".,;:!?")) != w and b.isalpha()}
        bare = pa.array({*tails.values()}, pa.string())
        made = {
            b: self.ids[self.begins[k] : self.begins[k + 1]].tobytes()
            for b, k in zip(bare.to_pylist(), pc.index_in(bare, self.words).to_pylist())
            if k is not None
        }
        todo = [w for w in dict.fromkeys([*words, *tails.values(), *(w[len(b) :] for w, b in tails.items())]) if w not in tails and w not in made]
        plain = [w for w in todo if w.isalpha()]
        rest = [w for w in todo if not w.isalpha()]
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            ids = np.frombuffer(self.whole([" ".join(some)])[0], "<u4")
            ends_at = np.flatnonzero(self.closing[ids]) + 1
            if len(ends_at) == len(some) and ends_at[-1] == len(ids):
                raw = ids.tobytes()
                cuts = [0, *(ends_at * 4).tolist()]
                made.update(zip(some, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))
            else:  # a letter that lower-cases to more than letters
                made.update(zip(some, self.whole(some)))
        made.update(zip(rest, self.whole(rest)))
        return [made[tails[w]] + made[w[len(tails[w]) :]] if w in tails else made[w] for w in words]

    def keep(self, rows: np.ndarray) -> None:
        """Forget all words but these."""
        sizes = np.diff(self.begins)[rows]
        self.ids = self.ids[_ranges(self.begins[rows], sizes)]
        self.words, self.begins = self.words.take(pa.array(rows)), np.append(0, np.cumsum(sizes))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        # characters that Arrow takes for white space and the library does not
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        cut = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        # the known words come first and keep their numbers, new ones follow; the empty words at white space on the outside have no ids
        coded = pa.chunked_array([self.words, cut.flatten()]).dictionary_encode().chunks[-1]
        new = coded.dictionary[len(self.words) :].to_pylist()
        if new:
            made = self.learn(new)
            self.words = coded.dictionary
            self.ids = np.append(self.ids, np.frombuffer(b"".join(made), "<u4"))
            self.begins = np.append(self.begins, self.begins[-1] + np.cumsum([len(b) // 4 for b in made]))
        rows = coded.indices.to_numpy()
        sizes = np.diff(self.begins)[rows]
        raw = self.ids[_ranges(self.begins[rows], sizes)].tobytes()
        cuts = np.append(0, 4 * np.cumsum(sizes))[cut.offsets.to_numpy()].tolist()
        if len(self.words) > REMEMBERED:  # words met again stay
            self.keep(np.flatnonzero(np.bincount(rows) > 1))
        return [
            self.whole([texts[k].as_py()])[0] if strange else raw[a:b]
            for k, (strange, a, b) in enumerate(zip(odd.to_pylist(), cuts, cuts[1:]))
        ]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


_OPEN: dict[str, WordEncoder] = {}


def encoder(spec: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = WordEncoder(spec)
    return _OPEN[key]


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the manifest.

    The manifest has a row per shard, in file order: shard, path, n_docs,
    n_tokens. `folder` (a new one in the shared folder by default) must be
    reachable from all executors. Every document ends with `end_id`, so a null
    or empty text gives that id alone. A null doc_id comes last; rows that
    share a doc_id stand together, in the order of their texts' hashes. Only
    the two columns named are read. An empty table gives no shard.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec).encode
        path = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
        out, tokens = None, 0
        for batch in slices(batches, "text", 8 << 20):
            out = out or ShardWriter(path)
            for k, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                out.add(k, ids + end)
                tokens += len(ids) // 4 + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [TaskContext.get().partitionId()], "path": [path], "n_docs": [len(out.docs)], "n_tokens": [tokens]}
            )

    rows = id_text(docs, doc_id, text).withColumn("mark", F.xxhash64("text"))
    order = (F.col("doc_id").asc_nulls_last(), F.col("mark"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = placed.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")
    return cut_lineage(made, "manifest")


def read(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """Every document of the files in the manifest: doc_id, start, n_tokens, ids_crc32, and with `ids` the ids.

    `start` counts the ids of all documents before it. The running sum over
    shards sees one row per file.
    """
    begin = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(begin), F.lit(0)).alias("begin"))
    lanes = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                shard = ShardReader(path)
                for lo in range(0, len(shard.docs), 1000):
                    some = shard.docs[lo : lo + 1000]
                    raw = [shard.ids(k) for k in range(lo, lo + len(some))]
                    counts = some["n"].astype(np.int64)
                    cols = {
                        "doc_id": pa.array(some["doc_id"].astype(np.int64), mask=some["known"] == 0),
                        "start": pa.array(start + np.cumsum(counts) - counts),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    }
                    if ids:
                        cols["ids"] = pa.array([np.frombuffer(r, "<i4") for r in raw], pa.list_(pa.int32()))
                    start += int(counts.sum())
                    yield pa.RecordBatch.from_pydict(cols)
                shard.close()

    return shards.repartition(lanes, "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    )
