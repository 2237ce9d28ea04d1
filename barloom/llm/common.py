"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no extra column can clash; a null text counts as empty."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def words_of(body: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def free_name(df: DataFrame, label: str) -> str:
    """A column name that `df` does not use."""
    taken = {c.lower() for c in df.columns}
    while label.lower() in taken:
        label = f"_{label}"
    return label


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes (one row at least)."""
    for batch in batches:
        size = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < len(batch):
            held = ends[start - 1] if start else 0
            end = min(int(np.searchsorted(ends, held + limit)) + 1, len(batch))
            yield batch.slice(start, end - start)
            start = end


def text_runs(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts; only a slice's texts become Python strings at a time."""
    for batch in slices(batches, column, limit):
        yield batch, [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
