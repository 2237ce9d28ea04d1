from __future__ import annotations

from . import mixing
from .registry import query, table


def _sql() -> str:
    text = "coalesce(text, '')"
    steps, last = [], "w0"
    for n in range(mixing.SWEEPS):
        for k in mixing.KEYS:
            new = f"w{len(steps) + 1}"
            steps.append(
                f"{new} AS MATERIALIZED (SELECT * REPLACE (weight * s_{k} * total / sum(tokens * weight) OVER (PARTITION BY {k}) AS weight) FROM {last})"
            )
            last = new
    shares = ",\n".join(
        f"t_{k} AS (SELECT {k}, pow(n, {p}) / sum(pow(n, {p})) OVER () AS s_{k} FROM (SELECT {k}, sum(tokens)::DOUBLE AS n FROM cells GROUP BY {k}))"
        for k, p in mixing.POWERS.items()
    )
    return f"""
    WITH docs AS (
      SELECT doc_id, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang, {mixing.TOPIC.format(t=text)} AS topic,
             CAST(len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
    cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
    {shares},
    w0 AS (SELECT source, lang, topic, tokens, 1.0::DOUBLE AS weight, s_source, s_lang, s_topic, (SELECT sum(tokens) FROM cells) AS total
           FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
    {", ".join(steps)},
    rates AS (SELECT source, lang, topic, round(weight, 6) AS weight, round(weight / max(weight) OVER (), 6) AS probability FROM {last})
    SELECT doc_id, docs.tokens, weight, probability,
           ('0x' || substr(md5('{mixing.SEED}' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < probability AS sampled
    FROM docs JOIN rates USING (source, lang, topic)
    """


@query("op7_mixing", _sql())
def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "_mix.*")
