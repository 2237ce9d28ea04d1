"""Byte-level BPE by a pair occurrence index.

The distinct pieces of a partition's texts lie behind each other in one array
of symbols. The index maps each pair that has a merge to all its positions.
Active merge ranks are applied in ascending order, each to all its positions
at once, and the lists of the pairs beside them are updated. A merge only
makes pairs of higher rank, so one pass over the ranks encodes every piece as
merging piece by piece would.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, text_runs

#: How byte-level BPE cuts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

COLUMNS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}
#: Pieces a worker remembers between tasks; beyond that it starts anew.
REMEMBERED = 400_000
_NONE = np.int64(1) << 40


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, and its byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder for the JSON text of a byte-level BPE tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        kind = (model["type"], spec["normalizer"], spec["pre_tokenizer"]["type"], spec["pre_tokenizer"]["add_prefix_space"])
        if kind != ("BPE", None, "ByteLevel", False):
            raise ValueError("only byte-level BPE files without a normalizer or prefix space are read here")
        vocab = model["vocab"]
        byte_of = printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, k in vocab.items():
            if token not in self.special:
                self.bytes_of[k] = bytes(byte_of[c] for c in token)
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        self.first = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.first[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = np.full(size, -1, np.int64)
        born[self.made] = np.arange(len(merges))
        if len(np.unique(self.made)) < len(merges) or (np.maximum(born[self.left], born[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that a later merge makes; ranks can't be applied in one ascending pass")
        self.base = np.int64(size + 1)  # `size` marks the end of a piece and is in no merge
        keys = self.left * self.base + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.cut = regex.compile(PIECES)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], _NONE)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Token ids of each piece, as little-endian unsigned 32-bit integers."""
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        n = int(sizes.sum())
        ends = np.cumsum(sizes)
        sym = np.append(self.first[np.frombuffer(b"".join(raw), np.uint8)], self.base - 1)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[ends - 1] = n
        before[ends - sizes] = n
        alive = np.ones(n, bool)
        rank = np.append(self.ranks(sym[:-1], sym[after[:-1]]), _NONE)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter positions in the lists of the pairs that begin there."""
            r = rank[at]
            held = r < _NONE
            at, r = at[held], r[held]
            if not len(at):
                return
            if len(at) > 1:
                by = np.argsort(r, kind="stable")
                at, r = at[by], r[by]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for lo, hi in zip(bounds, bounds[1:]):
                k = int(r[lo])
                if k in index:
                    index[k].append(at[lo:hi])
                else:
                    index[k] = [at[lo:hi]]
                    heapq.heappush(active, k)

        note(np.arange(n))
        while active:
            k = heapq.heappop(active)
            found = index.pop(k)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = at[rank[at] == k]
            if not len(at):
                continue
            if self.left[k] == self.right[k]:  # occurrences may overlap: every second one of a chain, from its left end
                at = np.unique(at)
                place = np.arange(len(at))
                starts = np.append(True, after[at[:-1]] != at[1:])
                at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
            gone = after[at]
            sym[at] = made = self.made[k]
            alive[gone] = False
            rank[gone] = _NONE
            follow = after[gone]
            after[at] = follow
            before[follow] = at
            lead = before[at]
            lead = lead[(lead < n) & (sym[lead] != made)]
            near = np.concatenate((at, lead)) if len(lead) else at
            rank[near] = self.ranks(sym[near], sym[after[near]])
            note(near)
        ids = sym[:-1][alive].astype("<u4").tobytes()
        count = np.append(0, np.cumsum(np.add.reduceat(alive, ends - sizes, dtype=np.int64))) * 4
        return [ids[a:b] for a, b in zip(count.tolist(), count[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for t in texts:
            cut: list[str] = []
            for k, s in enumerate(self.cut_special.split(t) if self.cut_special else [t]):
                if k % 2:
                    cut.append(s)
                else:
                    cut += self.cut.findall(s)
            parts.append(cut)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list(set().union(*parts).difference(known, self.special))
        if new:
            known.update(zip(new, self.encode_pieces(new)))
        for token, k in self.special.items():
            known[token] = k.to_bytes(4, "little")
        return [b"".join(map(known.__getitem__, cut)) for cut in parts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


_OPEN: dict[str, ByteBpe] = {}


def codec(text: str) -> ByteBpe:
    """The codec of a tokenizer file, built once in a worker process."""
    key = hashlib.md5(text.encode()).hexdigest()
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = ByteBpe(text)
    return _OPEN[key]


def round_trip(docs: DataFrame, tokenizer: str, columns: tuple[str, ...] = ("ids", "decoded"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again: doc_id and the `columns` asked for.

    `tokenizer` is the path of a byte-level BPE file in the tokenizers
    library's JSON format, read on the driver. Columns: ids, decoded,
    n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and
    decoded_sha256 (of UTF-8). A null or empty text has no ids and decodes to
    the empty text; the strings of special tokens give their ids. Each row
    stands for itself, so repeated rows, ties and null ids stay as they are.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(spec)
        for batch, texts in text_runs(batches, "text"):
            out: dict[str, list] = {c: [] for c in columns}
            for raw in bpe.encode(texts):
                ids = np.frombuffer(raw, "<u4")
                decoded = bpe.decode(ids) if {"decoded", "decoded_sha256"} & out.keys() else ""
                for c, values in out.items():
                    if c == "ids":
                        values.append(ids.astype(np.int32))
                    elif c == "decoded":
                        values.append(decoded)
                    elif c == "n_tokens":
                        values.append(len(ids))
                    elif c == "ids_sha256":
                        values.append(hashlib.sha256(raw).hexdigest())
                    else:
                        values.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[c], COLUMNS[c][1]) for c in columns)], names=["doc_id", *columns]
            )

    return id_text(docs, doc_id, text).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {COLUMNS[c][0]}" for c in columns))
