"""Boilerplate lines by their frequency within a site.

Pages are grouped by host; a line's frequency is the number of the host's
pages that contain it, divided by the host's pages.  Lines over a ratio are
dropped.  Only DataFrame functions are used.

Lines are counted as two 64-bit hashes, so that the shuffle carries 16 bytes a
line and not its text, and map-side combining makes a hot line one row a task.
The lines a host drops fit beside a page: their frequencies add up to at most
the lines of all its pages, so there are at most (mean lines a page) / ratio of
them.  Host totals and dropped lines are written first, so Spark knows their
size: while they are small they are sent to the pages, which are then not
shuffled at all; beyond the broadcast threshold they are joined by host, where
adaptive execution splits a hot host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, read

RATIO, MIN_PAGES = 0.1, 3


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, dropped): the keys of the lines that each host drops."""
    keys = F.array_distinct(F.transform(F.filter(F.col(lines), lambda x: ~_blank(x)), _key))
    rows = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), keys.alias("keys"))
    totals = cut(pages.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages")), "hosts")
    held = rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return cut(held.join(totals, "host").where(F.col("n") > F.col("pages") * ratio)
               .groupBy("host").agg(F.collect_list("key").alias("dropped")), "boilerplate")


def drop_site_lines(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                    separator: str = "\n", detail: bool = False) -> DataFrame:
    """``pages`` with every boilerplate line gone from ``text``.

    A line is boilerplate if it stands on more than ``ratio`` of its host's
    pages and on ``min_pages`` pages at least.  A page counts a line once
    however often it holds it; repeated rows are pages of their own.  Blank
    lines are neither counted nor dropped.  Null texts stay null, empty texts
    empty; pages with a null host belong to no site and stay as they are.
    With ``detail`` the columns ``n_lines`` and ``n_dropped`` (long, non-blank
    lines; underscores appended on a clash) follow.  An empty table gives an
    empty table."""
    columns = pages.columns
    own = free_name(columns, "site_host")
    gone = free_name(columns, "site_dropped")
    lines = free_name(columns, "site_lines")
    split = pages.withColumn(lines, F.split(F.col(f"`{text}`"), separator.replace("\\", "\\\\")))
    found = boilerplate(split.withColumn(own, F.col(f"`{host}`")), own, lines, ratio, min_pages)
    found = found.select(F.col("host").alias(own), F.col("dropped").alias(gone))
    joined = split.join(found, F.col(f"`{host}`") == F.col(own), "left")
    keep = F.filter(F.col(lines), lambda x: _blank(x) | ~F.array_contains(F.col(gone), _key(x)))
    cleaned = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(keep, separator))
    out = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in columns]
    if detail:
        full = F.coalesce(F.size(F.filter(F.col(lines), lambda x: ~_blank(x))), F.lit(0)).cast("long")
        less = F.coalesce(F.size(F.filter(F.col(lines), lambda x: ~_blank(x) & F.array_contains(F.col(gone), _key(x)))), F.lit(0))
        zero = F.when(F.col(lines).isNull(), F.lit(0))
        out += [F.coalesce(zero, full).cast("long").alias(free_name(columns, "n_lines")),
                F.coalesce(zero, F.when(F.col(gone).isNull(), F.lit(0)), less).cast("long").alias(free_name(columns, "n_dropped"))]
    return joined.select(*out)


def page_lines(html: Column) -> Column:
    """The text of a page: every tag and every run of line ends is one line
    end, without one at either side."""
    return F.btrim(F.regexp_replace(html, r"(?:<[^>]*>|[\r\n])+", "\n"), F.lit("\n"))


def url_host(url: Column) -> Column:
    """The host of an http(s) URL in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))
    return F.when(host != "", host)


def q_op6(spark, sf_dir: str) -> DataFrame:
    """Pages of the crawl without the boilerplate lines of their hosts."""
    pages = read(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text"))
    return drop_site_lines(pages, "host", detail=True)


ORACLE = {"op6_site_lines": rf"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '') AS host,
         trim(regexp_replace(html, '(?:<[^>]*>|[\r\n])+', chr(10), 'g'), chr(10)) AS text,
         row_number() OVER () AS r
  FROM pages),
l AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM p),
t AS (SELECT host, count(*) AS n FROM p WHERE host IS NOT NULL GROUP BY host),
b AS (SELECT l.host, line FROM l JOIN t USING (host) WHERE trim(line, ' ') <> ''
      GROUP BY l.host, line, t.n HAVING count(DISTINCT r) > t.n * {RATIO} AND count(DISTINCT r) >= {MIN_PAGES}),
k AS (SELECT l.r, string_agg(line, chr(10) ORDER BY pos) FILTER (b.line IS NULL) AS text,
             count(*) FILTER (trim(l.line, ' ') <> '') AS n_lines, count(b.line) AS n_dropped
      FROM l LEFT JOIN b USING (host, line) GROUP BY l.r)
SELECT p.page_id, p.host, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM p LEFT JOIN k USING (r)"""}
QUERIES = {"op6_site_lines": q_op6}
