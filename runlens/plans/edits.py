"""Queries over sequences of edits: every document is edited many times, in an
order of its own, and every source has a log that all its documents write to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edit_chain as C
from ..sources.tables import table
from .documents import _DOCS, _num, docs

STEPS = 11


def _edits(spark, d):
    """Eleven edits a document, the k-th at a place that depends on the
    document; a log per source is created, written to by each of its documents
    and taken back now and then; some paths are edited without existing."""
    dd = docs(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda k, command, old=None, new=None, line=None, text=None: F.struct(
        ((F.lit(k) * (F.col("doc_id") % 5 * 2 + 1)) % STEPS).cast("long").alias("seq"), F.lit(command).alias("command"),
        (none("string") if old is None else old).alias("old"), (none("string") if new is None else new).alias("new"),
        (none("long") if line is None else line.cast("long")).alias("line"), (none("string") if text is None else text).alias("text"))
    last = F.element_at(F.split("content", "\n", -1), -1)
    own = dd.select("path", F.explode(F.array(
        row(0, "insert", new=F.concat(F.lit("note "), F.col("doc_id").cast("string"), F.lit("\nTODO mark")), line=F.col("doc_id") % 5),
        row(1, "str_replace", old=F.lit("TODO mark"), new=F.lit("DONE\tmark")), row(2, "str_replace", old=F.lit("TODO mark")),
        row(3, "str_replace", old=last, new=F.lit("LAST")), row(4, "undo_edit"), row(5, "insert", new=F.lit("far"), line=F.lit(10**6)),
        row(6, "undo_edit"), row(7, "undo_edit"), row(8, "undo_edit"), row(9, "create", text=F.lit("x")), row(10, "view"))).alias("e")).select("path", "e.*")
    log = F.concat(F.lit("log/"), F.col("source"))
    entry = dd.select(log.alias("path"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 7 == 3, "undo_edit").otherwise("insert").alias("command"),
                      none("string").alias("old"), F.concat(F.lit("entry "), F.col("doc_id").cast("string")).alias("new"), none("long").alias("line"), none("string").alias("text")).withColumn("line", F.lit(0).cast("long"))
    begin = dd.select(log.alias("path")).distinct().select("path", F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("command"), none("string").alias("old"),
                                                          none("string").alias("new"), none("long").alias("line"), F.lit("end of log").alias("text"))
    lost = dd.select(F.concat(F.lit("lost/"), F.col("lang")).alias("path")).distinct().select(
        "path", F.lit(0).cast("long").alias("seq"), F.lit("undo_edit").alias("command"), none("string").alias("old"), none("string").alias("new"), none("long").alias("line"), none("string").alias("text"))
    return dd.select("path", "content"), own.unionByName(entry).unionByName(begin).unionByName(lost)


def q_edit_sequence(spark, d):
    out = C.edit_sequence(*_edits(spark, d), versions=True, digest=True)
    return out.select("path", "seq", "command", "error", F.md5("message").alias("message_md5"), "depth", "last", "content_md5")


def q_edited_documents(spark, d):
    out = C.edited_documents(*_edits(spark, d))
    return out.select("path", F.md5("content").alias("content_md5"), "edits", "failed", "depth")


QUERIES = {"edit_sequence": q_edit_sequence, "edited_documents": q_edited_documents}

_FOLD = "WITH RECURSIVE " + _DOCS + f""",
edits AS (
  SELECT path, (k * (doc_id % 5 * 2 + 1)) % {STEPS} AS seq, command, CASE k WHEN 1 THEN 'TODO mark' WHEN 2 THEN 'TODO mark' WHEN 3 THEN string_split(content, chr(10))[-1] END AS o,
         CASE k WHEN 0 THEN 'note ' || doc_id || chr(10) || 'TODO mark' WHEN 1 THEN 'DONE    mark' WHEN 3 THEN 'LAST' WHEN 5 THEN 'far' ELSE '' END AS n,
         CASE k WHEN 0 THEN doc_id % 5 WHEN 5 THEN 1000000 END AS line, 'x' AS t
  FROM docs, (SELECT unnest(range({STEPS})) AS k, unnest(['insert', 'str_replace', 'str_replace', 'str_replace', 'undo_edit', 'insert', 'undo_edit', 'undo_edit', 'undo_edit', 'create', 'view']) AS command)
  UNION ALL SELECT 'log/' || source, doc_id, CASE WHEN doc_id % 7 = 3 THEN 'undo_edit' ELSE 'insert' END, NULL, 'entry ' || doc_id, 0, NULL FROM docs
  UNION ALL SELECT DISTINCT 'log/' || source, -1, 'create', NULL, NULL, NULL, 'end of log' FROM docs
  UNION ALL SELECT DISTINCT 'lost/' || lang, 0, 'undo_edit', NULL, NULL, NULL, NULL FROM docs),
e AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS k, lead(1) OVER (PARTITION BY path ORDER BY seq) IS NULL AS last FROM edits),
s AS (
  SELECT path, 0::BIGINT AS k, any_value(content) AS c, []::VARCHAR[] AS h, ''::VARCHAR AS status, ''::VARCHAR AS extra, 0::BIGINT AS st, ''::VARCHAR AS sn
  FROM (SELECT DISTINCT path FROM edits) LEFT JOIN docs USING (path) GROUP BY path
  UNION ALL
  SELECT path, k,
         CASE status WHEN 'replaced' THEN replace(c, o, n) WHEN 'inserted' THEN array_to_string(list_concat(list_concat(l[1:line], nl), l[line + 1:]), chr(10))
                     WHEN 'created' THEN t WHEN 'undone' THEN h[-1] ELSE c END,
         CASE status WHEN 'replaced' THEN list_append(h, c) WHEN 'inserted' THEN list_append(h, c) WHEN 'created' THEN list_append(h, t)
                     WHEN 'undone' THEN h[1:len(h) - 1] ELSE h END,
         status,
         CASE status WHEN 'not_unique' THEN array_to_string(list_filter(list_transform(l, lambda x, i: CASE WHEN contains(x, o) THEN i END), lambda v: v IS NOT NULL), ', ')
                     WHEN 'bad_insert' THEN len(l)::VARCHAR ELSE '' END,
         CASE status WHEN 'replaced' THEN rs + 1 WHEN 'inserted' THEN greatest(1, line - 3) ELSE 1 END,
         CASE status WHEN 'replaced' THEN array_to_string(list_slice(string_split(replace(c, o, n), chr(10)), rs + 1, rl + 5 + len(nl) - 1), chr(10))
                     WHEN 'inserted' THEN array_to_string(list_concat(list_concat(l[greatest(line - 4, 0) + 1:line], nl), l[line + 1:line + 4]), chr(10))
                     WHEN 'undone' THEN h[-1] WHEN 'viewed' THEN c ELSE '' END
  FROM (SELECT *, greatest(0, rl - 4) AS rs,
               CASE WHEN c IS NULL AND command <> 'create' THEN 'missing' WHEN c IS NOT NULL AND command = 'create' THEN 'exists'
                    WHEN command = 'create' THEN 'created' WHEN command = 'view' THEN 'viewed'
                    WHEN command = 'undo_edit' THEN CASE WHEN len(h) = 0 THEN 'no_history' ELSE 'undone' END
                    WHEN command = 'insert' THEN CASE WHEN line > len(l) THEN 'bad_insert' ELSE 'inserted' END
                    WHEN occ = 0 THEN 'not_found' WHEN occ > 1 THEN 'not_unique' ELSE 'replaced' END AS status
        FROM (SELECT e.path, e.k, e.command, e.o, e.n, e.line, e.t, s.c, s.h, string_split(s.c, chr(10)) AS l, string_split(e.n, chr(10)) AS nl,
                     len(string_split(split_part(s.c, e.o, 1), chr(10))) - 1 AS rl,
                     CASE WHEN length(e.o) = 0 THEN length(s.c) + 1 ELSE (length(s.c) - length(replace(s.c, e.o, ''))) // length(e.o) END AS occ
              FROM s JOIN e ON e.path = s.path AND e.k = s.k + 1))),
r AS (SELECT s.*, e.seq, e.command, e.o, e.line, e.last FROM s JOIN e USING (path, k)),
v AS (SELECT *, 'Here''s the result of running `cat -n` on ' AS head, {_num("sn", "st")} || chr(10) AS body FROM r)"""
_ERROR = """CASE status WHEN 'not_found' THEN 'No replacement was performed, old_str `' || o || '` did not appear verbatim in ' || path || '.'
   WHEN 'not_unique' THEN 'No replacement was performed. Multiple occurrences of old_str `' || o || '` in lines [' || extra || ']. Please ensure it is unique'
   WHEN 'bad_insert' THEN 'Invalid `insert_line` parameter: ' || line || '. It should be within the range of lines of the file: [0, ' || extra || ']'
   WHEN 'exists' THEN 'File already exists at: ' || path || '. Cannot overwrite files using command `create`.'
   WHEN 'no_history' THEN 'No edit history found for ' || path || '.'
   WHEN 'missing' THEN 'The path ' || path || ' does not exist. Please provide a valid path.' END"""
_REVIEW = "'Review the changes and make sure they are as expected"
ORACLE = {
    "edit_sequence": _FOLD + f"""
SELECT path, seq, command, {_ERROR} AS error,
       md5(CASE status WHEN 'replaced' THEN 'The file ' || path || ' has been edited. ' || head || 'a snippet of ' || path || ':' || chr(10) || body || {_REVIEW}. Edit the file again if necessary.'
            WHEN 'inserted' THEN 'The file ' || path || ' has been edited. ' || head || 'a snippet of the edited file:' || chr(10) || body
                 || {_REVIEW} (correct indentation, no duplicate lines, etc). Edit the file again if necessary.'
            WHEN 'undone' THEN 'Last edit to ' || path || ' undone successfully. ' || head || path || ':' || chr(10) || body
            WHEN 'viewed' THEN head || path || ':' || chr(10) || body
            WHEN 'created' THEN 'File created successfully at: ' || path END) AS message_md5,
       len(h) AS depth, last, md5(c) AS content_md5
FROM v""",
    "edited_documents": _FOLD + f"""
SELECT path, md5(max(c) FILTER (last)) AS content_md5, count(*) FILTER (({_ERROR}) IS NULL) AS edits, count({_ERROR}) AS failed, max(len(h)) FILTER (last) AS depth
FROM r GROUP BY path HAVING max(c) FILTER (last) IS NOT NULL""",
}
