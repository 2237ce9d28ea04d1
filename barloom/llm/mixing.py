"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed once per cell (source, language, topic). The cell weights
are raked: each sweep scales them so that one marginal after the other meets
its target shares. Documents are then sampled with the calibrated probability
of their cell, from a hash of their id, so a rerun keeps the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import free_name, words_of

KEYS = ("source", "lang", "topic")
#: Target share of a value: its share of all tokens to this power, made to sum to 1.
POWERS = {"source": 0.85, "lang": 0.9, "topic": 0.9}
SWEEPS = 20
#: Sweeps between two written tables.
STRETCH = 4
SETTLED = 1e-10
SEED = "mix-1:"
#: Kinds of documents, told by their text; the expression runs in Spark SQL and in DuckDB.
TOPIC = """CASE WHEN {t} LIKE '%icense%' THEN 'licensed' WHEN {t} LIKE '% | %' THEN 'table'
    WHEN length({t}) < 500 THEN 'short' WHEN length({t}) < 4000 THEN 'article' ELSE 'long' END"""
#: Stands for a null source, language or topic.
NONE = "(none)"


def topic_of(text: str = "text") -> Column:
    return F.expr(TOPIC.format(t=f"coalesce(`{text}`, '')"))


def tempered(cells: DataFrame, key: str, power: float) -> DataFrame:
    """(key, share): the key's token shares flattened by `power`. Values without tokens get no share."""
    sums = cells.groupBy(key).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    raised = sums.select(key, F.pow("n", F.lit(float(power))).alias("r"))
    return raised.select(key, (F.col("r") / raised.agg(F.sum("r")).scalar()).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, settled: float = SETTLED) -> DataFrame:
    """(keys, tokens, weight): weights that make each marginal of tokens x weight meet its target shares.

    `cells` has the keys of `targets` and tokens, a row per cell. A value
    without target keeps its tokens' share; cells without tokens get weight 1.
    The windows run over cells, whose number is that of the distinct keys.
    """
    keys = list(targets)
    whole = cells.agg(F.sum("tokens").cast("double")).scalar()
    now = cells.select(*keys, F.col("tokens").cast("double").alias("tokens"), F.lit(1.0).alias("weight"), whole.alias("_all"))
    for k in keys:
        now = now.join(targets[k].select(F.col(k), (F.col("share")).alias(f"_share_{k}")), k, "left")
    now = cut_lineage(now, "cells")
    for done in range(0, sweeps, STRETCH):
        for _ in range(min(STRETCH, sweeps - done)):
            for k in keys:
                met = F.sum(F.col("tokens") * F.col("weight")).over(W.partitionBy(k))
                now = now.withColumn("_met", met).withColumn(
                    "weight",
                    F.when((F.col("_met") > 0) & F.col(f"_share_{k}").isNotNull(), F.col("weight") * F.col(f"_share_{k}") * F.col("_all") / F.col("_met"))
                    .otherwise(F.col("weight")),
                ).drop("_met")
        now = cut_lineage(now, "cells")
        off = [
            now.groupBy(k).agg(F.max(f"_share_{k}").alias("s"), (F.sum(F.col("tokens") * F.col("weight")) / F.max("_all")).alias("m"))
            .select(F.abs(F.col("m") / F.col("s") - 1).alias("off"))
            for k in keys[:-1]
        ]
        if (reduce(DataFrame.union, off).agg(F.max("off")).first()[0] or 0.0) < settled:
            break
    return now.select(*keys, "tokens", "weight")


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, topic: Column | None = None, doc_id: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, seed: str = SEED) -> DataFrame:
    """`docs` with the last column `_mix`: struct(tokens, weight, probability, sampled).

    A document's tokens are its words between ASCII white space. Null sources,
    languages and topics form a value of their own. Probabilities are the
    weights over the largest weight, so none exceeds 1 and expected token
    shares are the targets. Rows that share a doc_id are drawn together, null
    ids too; texts without words have no tokens and are drawn by their cell's
    weight. An empty table gives an empty result.
    """
    mark = free_name(docs, "_mix")
    named = {k: free_name(docs, f"_mix_{k}") for k in powers}
    held = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    cols = {named[k]: held((topic_of(text) if topic is None else topic) if k == "topic" else docs[k]) for k in powers}
    count = free_name(docs, "_mix_tokens")
    rows = docs.withColumns({**cols, count: words_of(F.coalesce(docs[text].cast("string"), F.lit("")))})
    cells = rows.groupBy(*(F.col(c).alias(k) for k, c in named.items())).agg(F.sum(count).alias("tokens"))
    cells = cut_lineage(cells, "cells")
    raked = rake(cells, {k: tempered(cells, k, p) for k, p in powers.items()}, sweeps)
    most = raked.agg(F.max("weight")).scalar()
    rates = raked.select(
        *(F.col(k).alias(f"{named[k]}_r") for k in powers),
        F.round("weight", 6).alias("weight"),
        F.round(F.col("weight") / most, 6).alias("probability"),
    )
    rates = cut_lineage(rates, "rates")
    met = rows.join(rates, reduce(Column.__and__, [rows[c] == rates[f"{c}_r"] for c in named.values()]))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(docs[doc_id].cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out = F.struct(F.col(count).alias("tokens"), rates["weight"], rates["probability"], (draw < rates["probability"]).alias("sampled"))
    return met.select(*(docs[c] for c in docs.columns), out.alias(mark))


def sample(docs: DataFrame, powers: dict[str, float] = POWERS, topic: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled rows of `docs`, all columns as they were."""
    out = mix(docs, powers, topic, doc_id, text)
    return out.where(out[out.columns[-1]]["sampled"]).select(*docs.columns)
