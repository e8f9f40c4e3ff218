"""Queries over candidate patches (fx_patch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patch as P
from ..sources.fixtures import with_fx


def q_clean_patch(spark, d):
    from ..sources.fixtures import fx_patch
    return P.with_clean_patch(fx_patch(spark, d)).select("doc_id", "cleaned")


def q_drop_test_files(spark, d):
    from ..sources.fixtures import fx_patch
    p = fx_patch(spark, d).withColumn("kept", P.drop_test_files(F.col("patch")))
    return p.select("doc_id", "kept", P.non_empty(F.col("kept")).alias("non_empty"))


def q_dedup_patches(spark, d):
    """F01 then W01: per language, the first document of each normalised
    patch and how many documents share it (one aggregate gives both)."""
    from ..sources.fixtures import fx_patch
    c = P.with_clean_patch(fx_patch(spark, d)).select("lang", "doc_id", "cleaned")
    return c.groupBy("lang", "cleaned").agg(F.min("doc_id").alias("doc_id"),
                                             F.count(F.lit(1)).alias("copies")).select("lang", "doc_id", "copies")


QUERIES = {"clean_patch": q_clean_patch, "drop_test_files": q_drop_test_files,
           "dedup_patches": q_dedup_patches}

_LINES = """
lines AS (SELECT doc_id, pos, line, total,
  max(CASE WHEN starts_with(line, '@@') THEN pos END) OVER w AS last_hunk,
  max(CASE WHEN starts_with(line, 'diff --git ') THEN pos END) OVER w AS last_diff,
  max(CASE WHEN starts_with(line, 'diff --git a/') THEN pos END) OVER w AS last_sec
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line, len(parts) AS total
        FROM (SELECT doc_id, string_split(patch, chr(10)) AS parts FROM fx_patch))
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

ORACLE = {
    "clean_patch": with_fx("SELECT 1", "fx_patch").rsplit("\nSELECT 1", 1)[0] + ",\n" + _LINES.strip() + """,
chg AS (SELECT doc_id, pos, left(line, 1) AS sign,
          regexp_replace(CASE WHEN starts_with(line, '+') THEN regexp_replace(substr(line, 2), '^[+]+', '')
                              ELSE regexp_replace(substr(line, 2), '^[-]+', '') END, '\\s+$', '') AS c
        FROM lines
        WHERE last_hunk IS NOT NULL AND last_hunk > coalesce(last_diff, 0) AND pos <> last_hunk
          AND (starts_with(line, '+') OR starts_with(line, '-'))),
kept AS (SELECT doc_id, pos, sign || regexp_replace(split_part(c, '#', 1), '\\s+$', '') AS l FROM chg
         WHERE regexp_replace(c, '\\s', '', 'g') <> '' AND NOT regexp_matches(c, '^\\s*#'))
SELECT f.doc_id, coalesce(regexp_replace(string_agg(k.l, chr(10) ORDER BY k.pos), '\\s+', '', 'g'), '') AS cleaned
FROM fx_patch f LEFT JOIN kept k USING (doc_id) GROUP BY f.doc_id""",
    "dedup_patches": with_fx("SELECT 1", "fx_patch").rsplit("\nSELECT 1", 1)[0] + ",\n" + _LINES.strip() + """,
chg AS (SELECT doc_id, pos, left(line, 1) AS sign,
          regexp_replace(CASE WHEN starts_with(line, '+') THEN regexp_replace(substr(line, 2), '^[+]+', '')
                              ELSE regexp_replace(substr(line, 2), '^[-]+', '') END, '\\s+$', '') AS c
        FROM lines
        WHERE last_hunk IS NOT NULL AND last_hunk > coalesce(last_diff, 0) AND pos <> last_hunk
          AND (starts_with(line, '+') OR starts_with(line, '-'))),
kept AS (SELECT doc_id, pos, sign || regexp_replace(split_part(c, '#', 1), '\\s+$', '') AS l FROM chg
         WHERE regexp_replace(c, '\\s', '', 'g') <> '' AND NOT regexp_matches(c, '^\\s*#')),
keys AS (SELECT f.doc_id, f.lang,
                coalesce(regexp_replace(string_agg(k.l, chr(10) ORDER BY k.pos), '\\s+', '', 'g'), '') AS cleaned
         FROM fx_patch f LEFT JOIN kept k USING (doc_id) GROUP BY f.doc_id, f.lang)
SELECT lang, min(doc_id) AS doc_id, count(*) AS copies FROM keys GROUP BY lang, cleaned""",
    "drop_test_files": with_fx("SELECT 1", "fx_patch").rsplit("\nSELECT 1", 1)[0] + ",\n" + _LINES.strip() + """,
sec AS (SELECT l.*, h.line AS header FROM lines l LEFT JOIN lines h ON h.doc_id = l.doc_id AND h.pos = l.last_sec),
flag AS (SELECT *, header IS NOT NULL AND starts_with(regexp_extract(header, '(\\S+)\\s*$', 1), 'b/')
           AND (contains(regexp_extract(header, '(\\S+)\\s*$', 1), '/test/')
             OR contains(regexp_extract(header, '(\\S+)\\s*$', 1), '/tests/')
             OR contains(regexp_extract(header, '(\\S+)\\s*$', 1), '/testing/')
             OR contains(regexp_extract(header, '(\\S+)\\s*$', 1), 'test_')
             OR contains(regexp_extract(header, '(\\S+)\\s*$', 1), 'tox.ini')) AS is_test FROM sec),
txt AS (SELECT doc_id,
          coalesce(string_agg(line || CASE WHEN pos < total THEN chr(10) ELSE '' END, '' ORDER BY pos)
                   FILTER (WHERE NOT is_test), '') AS kept
        FROM flag GROUP BY doc_id)
SELECT doc_id, kept, regexp_replace(kept, '\\s', '', 'g') <> '' AS non_empty FROM txt""",
}
