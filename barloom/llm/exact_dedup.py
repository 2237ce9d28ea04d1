"""Exact copies by content sort.

Texts are range-partitioned by splitters that Spark samples from their keys,
sorted externally inside each partition, and compared in full with their
neighbour. A run of equal texts is dealt over `pieces` ranges, so a text that
a third of the rows carry does not meet in one task; what the pieces found is
joined by the SHA-256 of the one text left in each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import free_name, id_text

#: Bytes of a text that lead its sort key. Whole texts as keys would make the sampled splitters grow with text length.
HEAD = 32
#: Ranges over which the copies of one text are dealt.
PIECES = 32


def copies(
    docs: DataFrame,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = lambda body: body,
    doc_id: str = "doc_id",
    text: str = "text",
    pieces: int = PIECES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when `normalise` gives equal bytes; a null text counts as
    empty, and all empty texts are copies of each other. Of a group the row
    with the smallest (or largest) doc_id stays; a null doc_id comes after all
    others, and of repeated rows with the same doc_id one stays. An empty
    table gives an empty result. Other columns of `docs` are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    first = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    rows = id_text(docs, doc_id, text).select("doc_id", normalise(F.col("text")).alias("body"))
    keyed = rows.select(
        "doc_id",
        "body",
        F.substring("body", 1, HEAD).alias("head"),
        F.xxhash64("body").alias("mark"),
        F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).alias("piece"),
    )
    # the window's keys begin with the range keys, so it sorts in place and exchanges nothing more
    run = W.partitionBy("head", "mark", "piece", "body").orderBy(first)
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    local = keyed.repartitionByRange("head", "mark", "piece").select(
        "doc_id", "body", F.row_number().over(run).alias("place"), F.count(F.lit(1)).over(whole).alias("size")
    )
    local = cut_lineage(local.select("doc_id", "place", "size", F.sha2("body", 256).alias("text_sha256")), "copies")
    groups = (
        local.where("place = 1")
        .groupBy("text_sha256")
        .agg(best("doc_id").alias("keep_id"), F.sum("size").alias("group_size"))
    )
    groups = cut_lineage(groups, "copies")  # so that a text with very many rows can be split in the join
    return local.join(groups, "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were."""
    found = copies(docs, keep, doc_id=doc_id, text=text)
    stays = found.where("kept").select(F.struct("doc_id", "text_sha256").alias(free_name(docs, "_stays")))
    stays_row = stays[stays.columns[0]]
    mark, ident = free_name(docs, "_sha"), free_name(docs, "_id")
    rows = docs.withColumns({mark: F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")), 256), ident: docs[doc_id].cast("long")})
    met = rows.join(stays, (rows[mark] == stays_row["text_sha256"]) & rows[ident].eqNullSafe(stays_row["doc_id"]), "left_semi")
    # rows repeated with the same doc_id and text pass the join together; they already lie side by side
    return met.dropDuplicates([mark, ident]).drop(mark, ident)
