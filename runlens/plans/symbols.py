"""Queries over code symbols, source files and thoughts (fx_spans, fx_files,
fx_thoughts)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import docedit as E
from ..operators import symbols as Y
from ..operators import thoughts as H
from ..session import checkpoint_path
from ..sources import symbol_index as I
from ..sources.named import write_named_files
from ..sources.fixtures import fx_files, fx_spans, fx_thoughts, with_fx
from ..sources.tables import table


def q_enclosing_symbol(spark, d):
    return Y.enclosing_symbol(fx_spans(spark, d)).select(
        "file_path", "sid", "name", "parent_function", "parent_class")


def q_enclosing_class(spark, d):
    return Y.enclosing_symbol(fx_spans(spark, d), rule="nearest_class").select("file_path", "sid", "parent_class")


def _members(spans):
    """Field and method lists of the classes, as the extractor writes them;
    every second class has fields, every third methods."""
    sid = F.col("sid").cast("string")
    cls = F.col("kind") == "class"
    return (spans.withColumn("fields", F.when(cls & (F.col("sid") % 2 == 0), F.concat(F.lit("- x"), sid)))
            .withColumn("methods", F.when(cls & (F.col("sid") % 3 == 0), F.concat(F.lit("- m"), sid, F.lit("(self)")))))


def q_symbol_lookup(spark, d):
    return Y.lookup_in_spans(_members(fx_spans(spark, d)), _lookups(spark, d))


def q_symbol_index_lookup(spark, d):
    """The same lookups, answered from the stored index."""
    path = checkpoint_path(spark, f"symbol-index-{uuid.uuid4().hex[:12]}")
    I.write_index(_members(fx_spans(spark, d)), path)
    return I.lookup(spark, path, _lookups(spark, d))


# Report nouns per entry type, as the code-search tool prints them.
_NOUN = {"function": "functions", "class": "classes", "class_method": "class methods"}


def _lookups(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("identifier"),
                    F.element_at(F.array(F.lit("function"), F.lit("class_method"), F.lit("class")),
                                 (F.col("p_partkey") % 3 + 1).cast("int")).alias("entry_type"))


def q_symbol_search_report(spark, d):
    """Lookup -> report text per (identifier, kind), locations only, cut at
    the output budget; identifiers without a match get the tool's message."""
    lookups = _lookups(spark, d)
    hits = Y.lookup_in_spans(_members(fx_spans(spark, d)), lookups)
    noun = F.create_map(*[x for k, v in _NOUN.items() for x in (F.lit(k), F.lit(v))])
    hits = hits.withColumn("key", F.concat_ws("|", "identifier", "entry_type"))

    line = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c, F.lit("\n"))).otherwise(F.lit(""))
    body = F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"),
                    F.when(F.col("entry_type") == "class_method", F.concat(F.lit(" within class "), F.col("parent_class"))).otherwise(F.lit("")),
                    F.lit("\n"), line("Fields:\n", F.col("fields")), line("Methods:\n", F.col("methods")))

    def header(n):
        return F.concat(F.lit("Found "), n.cast("string"), F.lit(" "), F.element_at(noun, F.col("entry_type")),
                        F.lit(" named "), F.col("identifier"), F.lit(":\n"))

    rep = E.budget_report(hits, "key", ["file_path", "start_line", "end_line", "parent_class", "fields", "methods"], body, header,
                          min_entry_len=len("1. x:1-1\n"))
    found = lookups.withColumn("key", F.concat_ws("|", "identifier", "entry_type")).join(rep, "key", "left")
    msg = F.concat(F.lit("No "), F.element_at(noun, F.col("entry_type")), F.lit(" named "), F.col("identifier"),
                   F.lit(" found."))
    return found.select("identifier", "entry_type", F.coalesce("output", msg).alias("output"))


def q_scan_source_files(spark, d):
    """A source tree with a file for each document, package files, hidden
    files and folders and other kinds of text among them, scanned."""
    path = checkpoint_path(spark, f"tree-{uuid.uuid4().hex[:12]}")
    t = table(spark, d, "documents")
    id = F.col("doc_id").cast("string")
    end = F.element_at(F.array(*[F.lit(x) for x in ("/__init__.py", "/_own.py", "/Main.java", "/.hidden.py", "/notes.txt", "/.git/x.py")]), (F.col("doc_id") % 6 + 1).cast("int"))
    write_named_files(t.select(F.concat("source", F.lit("/p"), id, end).alias("name"), F.col("text").alias("content")), path)
    found = Y.scan_source_files(spark, path, listing="tasks")
    return found.select(F.regexp_extract("path", r"/tree-[0-9a-f]+/(.*)$", 1).alias("path"), "size", "language", F.md5("content").alias("content_md5"))


def q_visible_files(spark, d):
    return Y.visible_files(fx_files(spark, d)).select("doc_id", "path", "language")


def q_snapshot_fingerprint(spark, d):
    return Y.snapshot_fingerprint(fx_files(spark, d))


def q_validate_thoughts(spark, d):
    return H.validate_thoughts(fx_thoughts(spark, d)).select(
        "session_id", "pos", "error", "total_adj", "branch_from_norm")


def q_thought_branches(spark, d):
    return H.thought_branches(fx_thoughts(spark, d))


def q_branch_thoughts(spark, d):
    return H.branch_thoughts(fx_thoughts(spark, d)).select("session_id", "branch_id", "ord", "pos", "thought")


def q_thought_history(spark, d):
    return H.thought_history(fx_thoughts(spark, d))


QUERIES = {
    "enclosing_symbol": q_enclosing_symbol,
    "enclosing_class": q_enclosing_class,
    "symbol_lookup": q_symbol_lookup,
    "symbol_index_lookup": q_symbol_index_lookup,
    "symbol_search_report": q_symbol_search_report,
    "scan_source_files": q_scan_source_files,
    "visible_files": q_visible_files,
    "snapshot_fingerprint": q_snapshot_fingerprint,
    "validate_thoughts": q_validate_thoughts,
    "thought_branches": q_thought_branches,
    "branch_thoughts": q_branch_thoughts,
    "thought_history": q_thought_history,
}

_PAIRS = """
pairs AS (SELECT c.file_path, c.sid, c.name, p.kind AS p_kind, p.name AS p_name, p.start_line AS ps, p.end_line AS pe,
                 p.sid AS psid
          FROM fx_spans c JOIN fx_spans p ON c.file_path = p.file_path AND p.start_line <= c.start_line
               AND p.end_line >= c.end_line AND p.sid <> c.sid
          WHERE c.kind = 'function'),
best AS (SELECT file_path, sid,
           arg_max(p_name, (ps, -pe, -psid)) FILTER (WHERE p_kind = 'function') AS f_name,
           arg_max(ps, (ps, -pe, -psid)) FILTER (WHERE p_kind = 'function') AS f_s,
           arg_max(pe, (ps, -pe, -psid)) FILTER (WHERE p_kind = 'function') AS f_e,
           arg_max(p_name, (ps, -pe, -psid)) FILTER (WHERE p_kind = 'class') AS c_name,
           arg_max(ps, (ps, -pe, -psid)) FILTER (WHERE p_kind = 'class') AS c_s,
           arg_max(pe, (ps, -pe, -psid)) FILTER (WHERE p_kind = 'class') AS c_e
         FROM pairs GROUP BY file_path, sid),
funcs AS (SELECT s.file_path, s.sid, s.name, s.start_line, s.end_line,
  CASE WHEN b.f_name IS NOT NULL AND b.c_name IS NOT NULL THEN CASE WHEN b.f_s >= b.c_s AND b.f_e <= b.c_e THEN b.f_name END
       ELSE b.f_name END AS parent_function,
  CASE WHEN b.f_name IS NOT NULL AND b.c_name IS NOT NULL THEN CASE WHEN NOT (b.f_s >= b.c_s AND b.f_e <= b.c_e) THEN b.c_name END
       ELSE b.c_name END AS parent_class, b.c_name AS nearest_class
  FROM fx_spans s LEFT JOIN best b USING (file_path, sid) WHERE s.kind = 'function')"""


def _sp(body):
    return with_fx("SELECT 1", "fx_spans").rsplit("\nSELECT 1", 1)[0] + ",\n" + _PAIRS.strip() + "\n" + body.strip()


_VALID = """
SELECT *,
  CASE WHEN thought IS NULL THEN 'Invalid thought: must be a string'
       WHEN thought_number IS NULL THEN 'Invalid thought_number: must be a number'
       WHEN total_thoughts IS NULL THEN 'Invalid total_thoughts: must be a number'
       WHEN next_thought_needed IS NULL THEN 'Invalid next_thought_needed: must be a boolean'
       WHEN thought_number < 1 THEN 'thought_number must be at least 1'
       WHEN total_thoughts < 1 THEN 'total_thoughts must be at least 1'
       WHEN branch_from_thought IS NOT NULL AND branch_from_thought <> 0 AND branch_from_thought < 1
         THEN 'branch_from_thought must be a positive integer' END AS error
FROM fx_thoughts"""

ORACLE = {
    "enclosing_symbol": _sp("SELECT file_path, sid, name, parent_function, parent_class FROM funcs"),
    "enclosing_class": _sp("SELECT file_path, sid, nearest_class AS parent_class FROM funcs"),
    "symbol_lookup": _sp("""
, lk AS (SELECT 'n' || CAST(p_partkey AS VARCHAR(20)) AS identifier,
                (['function', 'class_method', 'class'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS entry_type
         FROM part)
SELECT lk.identifier, lk.entry_type, f.file_path, f.start_line, f.end_line, f.parent_class, NULL AS fields, NULL AS methods
FROM lk JOIN funcs f ON f.name = lk.identifier
  AND lk.entry_type = CASE WHEN f.parent_class IS NULL THEN 'function' ELSE 'class_method' END
UNION ALL
SELECT lk.identifier, lk.entry_type, c.file_path, c.start_line, c.end_line, NULL AS parent_class,
       CASE WHEN c.sid % 2 = 0 THEN '- x' || CAST(c.sid AS VARCHAR(20)) END AS fields, CASE WHEN c.sid % 3 = 0 THEN '- m' || CAST(c.sid AS VARCHAR(20)) || '(self)' END AS methods
FROM lk JOIN fx_spans c ON c.name = lk.identifier AND c.kind = 'class' AND lk.entry_type = 'class'""").replace(
        "\n, lk AS", ",\nlk AS"),
    "symbol_search_report": _sp("""
, lk AS (SELECT 'n' || CAST(p_partkey AS VARCHAR(20)) AS identifier,
                (['function', 'class_method', 'class'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS entry_type
         FROM part),
hits AS (SELECT lk.identifier, lk.entry_type, f.file_path, f.start_line, f.end_line, f.parent_class, NULL AS fields, NULL AS methods
         FROM lk JOIN funcs f ON f.name = lk.identifier
           AND lk.entry_type = CASE WHEN f.parent_class IS NULL THEN 'function' ELSE 'class_method' END
         UNION ALL
         SELECT lk.identifier, lk.entry_type, c.file_path, c.start_line, c.end_line, NULL AS parent_class,
       CASE WHEN c.sid % 2 = 0 THEN '- x' || CAST(c.sid AS VARCHAR(20)) END AS fields, CASE WHEN c.sid % 3 = 0 THEN '- m' || CAST(c.sid AS VARCHAR(20)) || '(self)' END AS methods
         FROM lk JOIN fx_spans c ON c.name = lk.identifier AND c.kind = 'class' AND lk.entry_type = 'class'),
en AS (SELECT *, row_number() OVER (PARTITION BY identifier, entry_type ORDER BY file_path, start_line, end_line, parent_class NULLS FIRST, fields NULLS FIRST, methods NULLS FIRST) AS i,
              count(*) OVER (PARTITION BY identifier, entry_type) AS n,
              CASE entry_type WHEN 'function' THEN 'functions' WHEN 'class' THEN 'classes' ELSE 'class methods' END AS noun
       FROM hits),
tx AS (SELECT *, CAST(i AS VARCHAR) || '. ' || file_path || ':' || CAST(start_line AS VARCHAR) || '-'
                 || CAST(end_line AS VARCHAR) || CASE WHEN entry_type = 'class_method' THEN ' within class ' || parent_class ELSE '' END || chr(10)
                 || CASE WHEN fields <> '' THEN 'Fields:' || chr(10) || fields || chr(10) ELSE '' END
                 || CASE WHEN methods <> '' THEN 'Methods:' || chr(10) || methods || chr(10) ELSE '' END AS t,
              'Found ' || CAST(n AS VARCHAR) || ' ' || noun || ' named ' || identifier || ':' || chr(10) AS h FROM en),
cu AS (SELECT *, length(h) + sum(length(t)) OVER (PARTITION BY identifier, entry_type ORDER BY i
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM tx),
agg AS (SELECT identifier, entry_type, max(n) AS n, max(i) AS last_i, max(cum) > 16000 AS clipped, min(h) AS h,
               string_agg(t, '' ORDER BY i) AS body FROM cu WHERE cum - length(t) <= 16000
        GROUP BY identifier, entry_type)
SELECT lk.identifier, lk.entry_type,
       coalesce(CASE WHEN a.clipped THEN substr(a.h || a.body, 1, 16000) || chr(10) || '<response clipped> '
                       || CAST(a.n - a.last_i AS VARCHAR) || ' more entries not shown' ELSE a.h || a.body END,
                'No ' || CASE lk.entry_type WHEN 'function' THEN 'functions' WHEN 'class' THEN 'classes'
                              ELSE 'class methods' END || ' named ' || lk.identifier || ' found.') AS output
FROM lk LEFT JOIN agg a ON lk.identifier = a.identifier AND lk.entry_type = a.entry_type""").replace(
        "\n, lk AS", ",\nlk AS"),
    "visible_files": with_fx("""
SELECT doc_id, path, CASE regexp_extract(path, '(\\.[^./]+)$', 1)
    WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.c' THEN 'c' WHEN '.cpp' THEN 'cpp'
    WHEN '.ts' THEN 'typescript' END AS language
FROM fx_files
WHERE NOT starts_with(regexp_extract(path, '([^/]*)$', 1), '.') AND NOT contains(path, '/.')
  AND regexp_extract(path, '(\\.[^./]+)$', 1) IN ('.py', '.java', '.c', '.cpp', '.ts')""", "fx_files"),
    "snapshot_fingerprint": with_fx("""
SELECT root, count(*) AS files,
  CAST(count(*) AS VARCHAR) || '-' || CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)::HUGEINT) AS VARCHAR)
  || '-' || CAST(sum(CAST(('0x' || substr(h, 16, 15)) AS BIGINT)::HUGEINT) AS VARCHAR) AS fingerprint
FROM (SELECT root, md5(path || '|' || CAST(mtime AS VARCHAR) || '|' || CAST(size AS VARCHAR)) AS h FROM fx_files)
GROUP BY root""", "fx_files"),
    "validate_thoughts": with_fx(f"""
SELECT session_id, pos, error, CASE WHEN error IS NULL THEN greatest(total_thoughts, thought_number) END AS total_adj,
       CASE WHEN error IS NULL THEN nullif(branch_from_thought, 0) END AS branch_from_norm
FROM ({_VALID})""", "fx_thoughts"),
    "thought_branches": with_fx(f"""
SELECT session_id, branch_id, count(*) AS n_thoughts, min(pos) AS first_pos, max(pos) AS last_pos
FROM ({_VALID}) WHERE error IS NULL AND nullif(branch_from_thought, 0) IS NOT NULL AND branch_id IS NOT NULL
GROUP BY session_id, branch_id""", "fx_thoughts"),
    "branch_thoughts": with_fx(f"""
SELECT session_id, branch_id, row_number() OVER (PARTITION BY session_id, branch_id ORDER BY pos) AS ord, pos, thought
FROM ({_VALID}) WHERE error IS NULL AND nullif(branch_from_thought, 0) IS NOT NULL AND branch_id IS NOT NULL""", "fx_thoughts"),
    "thought_history": with_fx(f"""
SELECT session_id, pos,
  count(*) OVER w AS history_length,
  CAST(sum(CASE WHEN is_br AND fr = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS branches
FROM (SELECT *, row_number() OVER (PARTITION BY session_id, CASE WHEN is_br THEN branch_id END ORDER BY pos) AS fr
      FROM (SELECT *, nullif(branch_from_thought, 0) IS NOT NULL AND branch_id IS NOT NULL AS is_br
            FROM ({_VALID}) WHERE error IS NULL))
WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "fx_thoughts"),
}
ORACLE["symbol_index_lookup"] = ORACLE["symbol_lookup"]
ORACLE["scan_source_files"] = """
SELECT source || '/p' || doc_id || CASE doc_id % 6 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '/_own.py' ELSE '/Main.java' END AS path,
       octet_length(encode(text)) AS size, CASE doc_id % 6 WHEN 2 THEN 'java' ELSE 'python' END AS language, md5(text) AS content_md5
FROM documents WHERE doc_id % 6 < 3"""
