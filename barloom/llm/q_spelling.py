from __future__ import annotations

from pyspark.sql import functions as F

from . import spelling
from .registry import query, table


@query(
    "op11_spelling",
    r"""
    WITH RECURSIVE poly AS (
      SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
      FROM (SELECT unnest(range(256)) AS i)
    ), runs AS (
      SELECT doc_id, unnest(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
      FROM documents
    ), counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
    bytes AS (
      SELECT run, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
               lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
                     ELSE [192 + (unicode(ch) >> 6)::BIGINT, 128 + (unicode(ch) & 63)::BIGINT] END)) AS b
      FROM counted
    ), hashed AS (
      SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b),
               lambda h, v: xor(h >> 8, t[1 + (xor(h, v) & 255)]))) AS h
      FROM bytes CROSS JOIN poly
    ), words AS (
      SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                  ELSE run END AS word, c
      FROM hashed
    ), vocab AS (
      SELECT word, sum(c)::BIGINT AS n FROM words GROUP BY word HAVING length(word) >= 6 AND sum(c) >= 5
    ), cuts AS (
      SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocab
    ), holes AS (
      SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS hole FROM cuts
    ), near AS (
      SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.p = b.p AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM holes a JOIN vocab b ON a.hole = b.word
      UNION SELECT b.word, a.word, a.n FROM holes a JOIN vocab b ON a.hole = b.word
    ), best AS (
      SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word
    ), firsts AS (
      SELECT near.word, min(near.near) AS near FROM near JOIN best ON near.word = best.word AND near_n = top GROUP BY near.word
    ), formed AS (
      SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN f.near END AS form,
             CASE WHEN top >= 5 * v.n THEN top END AS form_n
      FROM vocab v LEFT JOIN best b ON v.word = b.word LEFT JOIN firsts f ON v.word = f.word
    ), paths(word, stop, k) AS (
      SELECT word, word, 0 FROM formed
      UNION ALL SELECT p.word, f.form, k + 1 FROM paths p JOIN formed f ON p.stop = f.word WHERE f.form IS NOT NULL
    ), roots AS (SELECT word, arg_max(stop, k) AS root FROM paths GROUP BY word)
    SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON f.word = r.word
    """,
)
def op11_spelling(spark, sf_dir):
    found = spelling.runs(table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    hashed = found.withColumn("h", h)
    shorter = spelling.without("run", F.col("h") % F.length("run"))
    words = hashed.select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.vocabulary(words))
