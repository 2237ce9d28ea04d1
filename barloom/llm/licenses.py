"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, one spelling for words that
differ, no copyright lines, no punctuation) and its digest is looked up among
those of the known licences, brought to the same form. Looked up are the whole
text, each of its paragraphs and each of its lines, always in full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text

#: Spellings that count as one; the left one, a regular expression of whole words, becomes the right one.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("sub licenses", "sublicenses"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("https", "http"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Known licences and the short notices that stand for them, as published.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "All rights reserved."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. """
        + _WARRANTY,
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)

#: Steps of the canonical form as (pattern, replacement), the same in Spark SQL and DuckDB; applied to the lower-cased text.
STEPS = (
    ("[^a-z0-9\\n]+", " "),
    (" ?\\n ?", "\n"),
    ("(^|\\n)copyright( c)? [0-9][^\\n]*", "\n"),
    ("(^|\\n)c copyright [^\\n]*", "\n"),
)


SPELLING_STEPS = tuple((f"\\b{a}\\b", b) for a, b in SPELLINGS)


def canonical(body: Column) -> Column:
    """Canonical form with its lines and empty lines kept."""
    plain = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), STEPS, F.lower(body))
    # most texts hold none of the spellings; one look tells
    some = plain.rlike("\\b(?:" + "|".join(a for a, _ in SPELLINGS) + ")\\b")
    return F.when(some, reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), SPELLING_STEPS, plain)).otherwise(plain)


def one_line(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, "[ \\n]+", " "))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license, form, digest) of each known text, one row per canonical form; the first name of a form counts."""
    listed = [F.struct(F.lit(k).alias("k"), F.lit(n).alias("license"), F.lit(t).alias("text")) for k, (n, t) in enumerate(known)]
    none = F.array().cast("array<struct<k:int,license:string,text:string>>")
    rows = spark.range(1).select(F.explode(F.array(*listed) if listed else none).alias("v")).select("v.*")
    forms = rows.select("k", "license", one_line(canonical(F.col("text"))).alias("form")).where("form <> ''")
    return forms.groupBy("form").agg(F.min_by("license", "k").alias("license")).select("license", "form", F.sha2("form", 256).alias("digest"))


def scan(docs: DataFrame, known=KNOWN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, whole, n_lines, n_paragraphs: a row per document and licence found in it.

    `whole` tells that the document's entire text is the licence, the counts
    how many of its lines and paragraphs (stretches between empty lines) are.
    Null and empty texts hold no licence. Rows that share a doc_id, null
    included, are counted together. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    digests = known_digests(spark, known)
    # equal forms have equal lengths, so other lengths need no digest; the list is as long as `known`
    lengths = sorted({r[0] for r in digests.select(F.length("form")).collect()})
    form = id_text(docs, doc_id, text).select("doc_id", canonical(F.col("text")).alias("form"))
    paragraphs = F.split(F.col("form"), "\\n\\n+")
    unit = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), one_line(x).alias("form"))
    units = F.concat(
        F.array(F.struct(F.lit("whole").alias("kind"), one_line(F.col("form")).alias("form"))),
        F.transform(paragraphs, unit("paragraph")),
        F.transform(F.split(F.col("form"), "\\n"), unit("line")),
    )
    fitting = F.filter(units, lambda u: F.length(u["form"]).isin(lengths)) if lengths else F.filter(units, lambda u: F.lit(False))
    found = form.select("doc_id", F.explode(fitting).alias("u")).select("doc_id", "u.kind", F.sha2("u.form", 256).alias("digest"))
    return (
        found.join(digests.select("license", "digest"), "digest")
        .groupBy("doc_id", "license")
        .agg(
            F.max(F.col("kind") == "whole").alias("whole"),
            F.count_if(F.col("kind") == "line").alias("n_lines"),
            F.count_if(F.col("kind") == "paragraph").alias("n_paragraphs"),
        )
    )
