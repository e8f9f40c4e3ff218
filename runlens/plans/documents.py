"""Queries over documents and their edit requests (documents, conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docedit as E
from ..sources.tables import table


def docs(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                             F.lit(".txt")).alias("path"), "doc_id", "source", "lang",
                    F.col("text").alias("content"))


def q_replace_unique(spark, d):
    dd = docs(spark, d)
    # old text: the document's last line, its whole text, or that reversed
    last = F.element_at(F.split("content", "\n", -1), -1)
    edits = dd.select("path", F.when(F.col("doc_id") % 7 == 0, F.reverse("content")).when(F.col("doc_id") % 7 == 1, F.col("content"))
                      .otherwise(last).alias("old"),
                      F.lit("REPLACED\ttext").alias("new"))
    out = E.replace_unique(dd.select("path", "content"), edits)
    return out.select("path", "error", F.md5("content").alias("content_md5"), "snippet", "message")


def q_insert_lines(spark, d):
    dd = docs(spark, d)
    ins = dd.select("path", (F.col("doc_id") % 5).cast("int").alias("line"),
                    F.lit("inserted line\nsecond").alias("text"))
    out = E.insert_lines(dd.select("path", "content"), ins)
    return out.select("path", "error", F.md5("content").alias("content_md5"), "snippet", "message")


def q_create_if_absent(spark, d):
    dd = docs(spark, d)
    cr = dd.select(
        F.when(F.col("lang") == "en", F.col("path"))
        .otherwise(F.concat(F.lit("new/"), F.col("doc_id").cast("string"))).alias("path"),
        F.lit("fresh").alias("content"))
    return E.create_if_absent(dd.select("path", "content"), cr).select("path", "created", "error", "message")


def q_view_lines(spark, d):
    dd = docs(spark, d)
    m = F.col("doc_id") % 5
    v = dd.select("path",
                  F.when(m == 0, F.lit(None)).when(m == 1, 1).when(m == 2, 2).when(m == 3, 0).otherwise(3)
                  .cast("int").alias("start"),
                  F.when(m == 0, F.lit(None)).when(m == 1, -1).when(m == 2, 3).when(m == 3, 2).otherwise(1)
                  .cast("int").alias("end"))
    out = E.view_lines(dd.select("path", "content"), v)
    return out.select("path", "error", F.md5("output").alias("output_md5"),
                      F.length("output").cast("bigint").alias("output_chars"))


def _budget_parts(spark, d):
    """Documents as entries of a report per source: body after the number,
    and header."""
    dd = docs(spark, d).withColumn("n_lines", F.size(F.split("content", "\n", -1)))
    body = F.concat(F.col("path"), F.lit(":1-"), F.col("n_lines").cast("string"), F.lit("\n"), F.col("content"), F.lit("\n\n"))

    def header(n):
        return F.concat(F.lit("Found "), n.cast("string"), F.lit(" functions named "), F.col("source"), F.lit(":\n"))

    return dd, body, header


def q_char_budget(spark, d):
    dd, body, header = _budget_parts(spark, d)
    out = E.char_budget(dd, "source", ["doc_id"], body, header, min_entry_len=11, payload=["content"])
    return out.select("source", "doc_id", F.col("i").cast("bigint").alias("i"), "cum_chars", "remaining", "clipped")


def q_char_budget_report(spark, d):
    dd, body, header = _budget_parts(spark, d)
    out = E.budget_report(dd, "source", ["doc_id"], body, header, min_entry_len=11, payload=["content"])
    return out.select("source", "remaining", "clipped", F.md5("output").alias("output_md5"),
                      F.length("output").cast("bigint").alias("output_chars"))


def q_undo_last_edit(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("version"),
                                                F.col("text").alias("content"))
    out = E.undo_last_edit(c)
    return out.select("path", "restored_version", F.md5("content").alias("content_md5"), "error",
                      F.md5("message").alias("message_md5"))


QUERIES = {
    "replace_unique": q_replace_unique,
    "insert_lines": q_insert_lines,
    "create_if_absent": q_create_if_absent,
    "view_lines": q_view_lines,
    "char_budget": q_char_budget,
    "char_budget_report": q_char_budget_report,
    "undo_last_edit": q_undo_last_edit,
}

_DOCS = """docs AS (SELECT 'docs/' || source || '/' || CAST(doc_id AS VARCHAR(20)) || '.txt' AS path, doc_id, source, lang,
                 text AS content FROM documents)"""
_TRUNC = ("CASE WHEN length({x}) <= 16000 THEN {x} ELSE substr({x}, 1, 16000) || '<response clipped><NOTE>To save on "
          "context only part of this file has been shown to you. You should retry this tool after you have searched "
          "inside the file with `grep -n` in order to find the line numbers of what you are looking for.</NOTE>' END")


def _num(x: str, init: str) -> str:
    """cat -n numbering of text x starting at line init (no tabs in fixture text)."""
    return (f"array_to_string(list_transform(string_split({_TRUNC.format(x=x)}, chr(10)), "
            f"lambda l, i: printf('%6d', i - 1 + {init}) || chr(9) || l), chr(10))")


ORACLE = {
    "replace_unique": "WITH " + _DOCS + f""",
e AS (SELECT path, content AS c,
        CASE doc_id % 7 WHEN 0 THEN reverse(content) WHEN 1 THEN content ELSE string_split(content, chr(10))[-1] END AS o,
        'REPLACED' || '        ' || 'text' AS n FROM docs),
x AS (SELECT *, CASE WHEN length(o) = 0 THEN length(c) + 1 ELSE (length(c) - length(replace(c, o, ''))) // length(o) END AS occ FROM e),
y AS (SELECT *,
  CASE WHEN occ = 0 THEN 'No replacement was performed, old_str `' || o || '` did not appear verbatim in ' || path || '.'
       WHEN occ > 1 THEN 'No replacement was performed. Multiple occurrences of old_str `' || o || '` in lines ['
         || array_to_string(list_filter(list_transform(string_split(c, chr(10)), lambda l, i: CASE WHEN contains(l, o) THEN i END),
                                        lambda v: v IS NOT NULL), ', ') || ']. Please ensure it is unique' END AS error
  FROM x),
z AS (SELECT *, CASE WHEN error IS NULL THEN replace(c, o, n) ELSE c END AS nc,
        greatest(0, len(string_split(split_part(c, o, 1), chr(10))) - 1 - 4) AS st,
        len(string_split(split_part(c, o, 1), chr(10))) - 1 + 4 + len(string_split(n, chr(10))) - 1 AS en
      FROM y)
SELECT path, error, md5(nc) AS content_md5,
       CASE WHEN error IS NULL THEN sn END AS snippet,
       CASE WHEN error IS NULL THEN 'The file ' || path || ' has been edited. Here''s the result of running `cat -n` on '
            || 'a snippet of ' || path || ':' || chr(10) || sn || chr(10)
            || 'Review the changes and make sure they are as expected. Edit the file again if necessary.' END AS message
FROM (SELECT *, {_num("array_to_string(list_slice(string_split(nc, chr(10)), st + 1, en + 1), chr(10))", "st + 1")} AS sn
      FROM z)""",
    "insert_lines": "WITH " + _DOCS + f""",
x AS (SELECT path, content, CAST(doc_id % 5 AS INTEGER) AS line, string_split(content, chr(10)) AS l,
             ['inserted line', 'second'] AS t FROM docs),
y AS (SELECT *, line >= 0 AND line <= len(l) AS ok FROM x)
SELECT path,
  CASE WHEN NOT ok THEN 'Invalid `insert_line` parameter: ' || CAST(line AS VARCHAR) ||
       '. It should be within the range of lines of the file: [0, ' || CAST(len(l) AS VARCHAR) || ']' END AS error,
  md5(CASE WHEN ok THEN array_to_string(list_concat(list_concat(l[1:line], t), l[line + 1:]), chr(10)) ELSE content END)
    AS content_md5,
  CASE WHEN ok THEN sn END AS snippet,
  CASE WHEN ok THEN 'The file ' || path || ' has been edited. Here''s the result of running `cat -n` on a snippet of '
       || 'the edited file:' || chr(10) || sn || chr(10) || 'Review the changes and make sure they are as expected '
       || '(correct indentation, no duplicate lines, etc). Edit the file again if necessary.' END AS message
FROM (SELECT *, {_num("array_to_string(list_concat(list_concat(l[greatest(line - 4, 0) + 1:line], t), l[line + 1:line + 4]), chr(10))", "greatest(1, greatest(0, line - 4) + 1)")} AS sn
      FROM y)""",
    "create_if_absent": "WITH " + _DOCS + """,
cr AS (SELECT CASE WHEN lang = 'en' THEN path ELSE 'new/' || CAST(doc_id AS VARCHAR(20)) END AS path FROM docs)
SELECT cr.path, d.path IS NULL AS created,
       CASE WHEN d.path IS NOT NULL THEN 'File already exists at: ' || cr.path ||
            '. Cannot overwrite files using command `create`.' END AS error,
       CASE WHEN d.path IS NULL THEN 'File created successfully at: ' || cr.path END AS message
FROM cr LEFT JOIN (SELECT DISTINCT path FROM docs) d ON cr.path = d.path""",
    "view_lines": "WITH " + _DOCS + f""",
v AS (SELECT path, content, string_split(content, chr(10)) AS l,
        CAST(CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 3 END AS INTEGER) AS s,
        CAST(CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS e
      FROM docs),
r AS (SELECT *, '[' || CAST(s AS VARCHAR) || ', ' || CAST(e AS VARCHAR) || ']' AS rng,
  CASE WHEN s IS NOT NULL AND (s < 1 OR s > len(l)) THEN 'Invalid `view_range`: [' || CAST(s AS VARCHAR) || ', ' || CAST(e AS VARCHAR)
         || ']. Its first element `' || CAST(s AS VARCHAR) || '` should be within the range of lines of the file: [1, '
         || CAST(len(l) AS VARCHAR) || ']'
       WHEN s IS NOT NULL AND e > len(l) THEN 'Invalid `view_range`: [' || CAST(s AS VARCHAR) || ', ' || CAST(e AS VARCHAR)
         || ']. Its second element `' || CAST(e AS VARCHAR) || '` should be smaller than the number of lines in the file: `'
         || CAST(len(l) AS VARCHAR) || '`'
       WHEN s IS NOT NULL AND e <> -1 AND e < s THEN 'Invalid `view_range`: [' || CAST(s AS VARCHAR) || ', ' || CAST(e AS VARCHAR)
         || ']. Its second element `' || CAST(e AS VARCHAR) || '` should be larger or equal than its first `' || CAST(s AS VARCHAR) || '`'
  END AS error FROM v),
p AS (SELECT *, CASE WHEN s IS NULL THEN content WHEN e = -1 THEN array_to_string(l[s:], chr(10))
                     ELSE array_to_string(l[s:e], chr(10)) END AS part FROM r)
SELECT path, error, md5(o) AS output_md5, CAST(length(o) AS BIGINT) AS output_chars
FROM (SELECT path, error, CASE WHEN error IS NULL THEN 'Here''s the result of running `cat -n` on ' || path || ':'
                                  || chr(10) || {_num("part", "coalesce(s, 1)")} || chr(10) END AS o FROM p)""",
    "char_budget": "WITH " + _DOCS + """,
en AS (SELECT source, doc_id,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i,
         count(*) OVER (PARTITION BY source) AS n, content, path,
         len(string_split(content, chr(10))) AS n_lines FROM docs),
ln AS (SELECT *, length(CAST(i AS VARCHAR) || '. ' || path || ':1-' || CAST(n_lines AS VARCHAR) || chr(10) || content
                        || chr(10) || chr(10)) AS len_,
              length('Found ' || CAST(n AS VARCHAR) || ' functions named ' || source || ':' || chr(10)) AS hdr FROM en),
cu AS (SELECT *, hdr + sum(len_) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 AS cum_chars FROM ln),
kept AS (SELECT * FROM cu WHERE cum_chars - len_ <= 16000)
SELECT source, doc_id, i, CAST(cum_chars AS BIGINT) AS cum_chars,
       CAST(CASE WHEN max(cum_chars) OVER (PARTITION BY source) > 16000 THEN n - max(i) OVER (PARTITION BY source)
                 ELSE 0 END AS BIGINT) AS remaining,
       max(cum_chars) OVER (PARTITION BY source) > 16000 AS clipped
FROM kept""",
    "char_budget_report": "WITH " + _DOCS + """,
en AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i,
         count(*) OVER (PARTITION BY source) AS n, content, path,
         len(string_split(content, chr(10))) AS n_lines FROM docs),
tx AS (SELECT *, CAST(i AS VARCHAR) || '. ' || path || ':1-' || CAST(n_lines AS VARCHAR) || chr(10) || content
                 || chr(10) || chr(10) AS t,
              'Found ' || CAST(n AS VARCHAR) || ' functions named ' || source || ':' || chr(10) AS h FROM en),
cu AS (SELECT *, length(h) + sum(length(t)) OVER (PARTITION BY source ORDER BY i
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM tx),
kept AS (SELECT * FROM cu WHERE cum - length(t) <= 16000),
agg AS (SELECT source, max(n) AS n, max(i) AS last_i, max(cum) > 16000 AS clipped, min(h) AS h,
               string_agg(t, '' ORDER BY i) AS body FROM kept GROUP BY source)
SELECT source, CAST(CASE WHEN clipped THEN n - last_i ELSE 0 END AS BIGINT) AS remaining, clipped,
       md5(o) AS output_md5, CAST(length(o) AS BIGINT) AS output_chars
FROM (SELECT *, CASE WHEN clipped THEN substr(h || body, 1, 16000) || chr(10) || '<response clipped> '
                       || CAST(n - last_i AS VARCHAR) || ' more entries not shown'
                     ELSE h || body END AS o FROM agg)""",
    "undo_last_edit": f"""
SELECT path, CASE WHEN n >= 2 THEN v2 END AS restored_version, CASE WHEN n >= 2 THEN md5(c2) END AS content_md5,
       CASE WHEN n < 2 THEN 'No edit history found for ' || CAST(path AS VARCHAR) || '.' END AS error,
       CASE WHEN n >= 2 THEN md5('Last edit to ' || CAST(path AS VARCHAR) || ' undone successfully. '
            || 'Here''s the result of running `cat -n` on ' || CAST(path AS VARCHAR) || ':' || chr(10)
            || {_num("c2", "1")} || chr(10)) END AS message_md5
FROM (SELECT conv_id AS path, count(*) AS n,
             max(turn) FILTER (WHERE r = 2) AS v2, max(text) FILTER (WHERE r = 2) AS c2
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
      GROUP BY conv_id)""",
}
