from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import conversation_trie
from .registry import query, table


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations and their rebuilt turns: h turns of conversation c - c % 20, then its own after its first h."""
    convs = own.groupBy("conv_id").agg(F.min("pos").alias("first"))
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = cut_lineage(own.where((F.col("conv_id") % 20 == 0) & (F.col("pos") <= 3)), "heads")
    has = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("has"))
    plan = convs.select("conv_id", base.alias("base"), h.alias("h")).join(has, "base", "left")
    plan = plan.select("conv_id", "base", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("borrowed"))
    plan = cut_lineage(plan, "plan")
    taken = plan.join(heads.withColumnRenamed("conv_id", "base"), "base").where("pos <= h").select("conv_id", "pos", "mark", "words")
    rest = own.join(plan, "conv_id").where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("borrowed")).alias("pos"), "mark", "words")
    return plan.select("conv_id"), cut_lineage(taken.union(rest), "rebuilt")


@query(
    "op12_conversation_trie",
    r"""
    WITH poly AS (
      SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
      FROM (SELECT unnest(range(256)) AS i)
    ), named AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (
      SELECT conv_id, role, text, row_number() OVER (
               PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS pos
      FROM named
    ), convs AS (
      SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: unicode(ch)::BIGINT)),
               lambda h, v: xor(h >> 8, t[1 + (xor(h, v) & 255)]))) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM named) CROSS JOIN poly
    ), taken AS (
      SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
    ), kinds AS (
      SELECT *, dense_rank() OVER (ORDER BY role, text) AS kind FROM taken
    ), seqs AS (
      SELECT c.conv_id, coalesce(list(kind ORDER BY part, pos) FILTER (kind IS NOT NULL), []) AS seq
      FROM convs c LEFT JOIN kinds k ON c.conv_id = k.conv_id GROUP BY c.conv_id
    ), words AS (
      SELECT DISTINCT kind, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM kinds
    ), steps AS (
      SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM seqs
    ), members AS (
      SELECT seq[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(seq)), '')) AS ends_sha256
      FROM steps GROUP BY ALL
    ), kids AS (
      SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM members WHERE depth > 0 GROUP BY ALL
    ), valued AS (
      SELECT m.*, coalesce(n_children, 0) AS n_children, coalesce((n_convs - 1) * w.words, 0) AS saved
      FROM members m LEFT JOIN kids k ON m.node = k.node AND m.depth = k.depth LEFT JOIN words w ON w.kind = m.node[m.depth]
    ), spread AS (
      SELECT node, n_children, saved, unnest(range(0, depth + 1)) AS d FROM valued
    ), sums AS (
      SELECT node[1:d] AS node, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM spread GROUP BY ALL
    )
    SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
    FROM valued v JOIN sums s ON v.node = s.node AND v.depth = s.depth
    LEFT JOIN members p ON p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]
    """,
)
def op12_conversation_trie(spark, sf_dir):
    own = cut_lineage(conversation_trie.numbered(conversation_trie.turns(table(spark, sf_dir, "conversations"))), "numbered")
    return conversation_trie.trie(*rebuilt(own))
