from __future__ import annotations

from functools import reduce

from . import licenses
from .registry import query, table


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _form(body: str) -> str:
    """The canonical form in DuckDB; its patterns write a line end as \\n too."""
    step = lambda c, s: f"regexp_replace({c}, {_quoted(s[0])}, {'chr(10)' if s[1] == chr(10) else _quoted(s[1])}, 'g')"
    return reduce(step, licenses.STEPS + licenses.SPELLING_STEPS, f"lower({body})")


def _line(form: str) -> str:
    return f"trim(regexp_replace({form}, '[ \\n]+', ' ', 'g'))"


def _sql() -> str:
    rows = ", ".join(f"({k}, {_quoted(n)}, {_quoted(t)})" for k, (n, t) in enumerate(licenses.KNOWN))
    return f"""
    WITH known AS (SELECT arg_min(license, k) AS license, form FROM (
        SELECT k, license, {_line(_form("t"))} AS form FROM (VALUES {rows}) v(k, license, t)) GROUP BY form),
    forms AS (SELECT doc_id, {_form("coalesce(text, '')")} AS form FROM documents),
    units AS (
      SELECT doc_id, 'whole' AS kind, {_line("form")} AS form FROM forms
      UNION ALL SELECT doc_id, 'line', {_line("x")} FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS x FROM forms)
      UNION ALL SELECT doc_id, 'paragraph', {_line("x")} FROM (SELECT doc_id, unnest(string_split_regex(form, '\\n\\n+')) AS x FROM forms))
    SELECT doc_id, license, bool_or(kind = 'whole') AS whole,
           count(*) FILTER (kind = 'line') AS n_lines, count(*) FILTER (kind = 'paragraph') AS n_paragraphs
    FROM units JOIN known USING (form) GROUP BY doc_id, license
    """


@query("op3_licenses", _sql())
def op3_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))
