"""Bulk document editing: a table of documents joined with a table of edit
requests gives new documents plus a status column (F11-F14, W07, W09).

``docs`` has ``path, content``; every edit request names a ``path``.  All
text work is per row with built-in string/array functions; the only
shuffles are the equi-joins on ``path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Snippet context, output truncation limit and notice, and the
# edit tool's messages (printf-style formats, in the order the checks run).
SNIPPET_LINES = 4
MAX_RESPONSE_LEN = 16000
TRUNCATED_MESSAGE = ("<response clipped><NOTE>To save on context only part of this file has been "
                     "shown to you. You should retry this tool after you have searched inside the "
                     "file with `grep -n` in order to find the line numbers of what you are looking "
                     "for.</NOTE>")
MSG = {
    "not_found": "No replacement was performed, old_str `%s` did not appear verbatim in %s.",
    "not_unique": ("No replacement was performed. Multiple occurrences of old_str `%s` in lines [%s]. "
                   "Please ensure it is unique"),
    "bad_insert": ("Invalid `insert_line` parameter: %d. It should be within the range of lines of the "
                   "file: [0, %d]"),
    "exists": "File already exists at: %s. Cannot overwrite files using command `create`.",
    "range_first": ("Invalid `view_range`: %s. Its first element `%d` should be within the range of lines "
                    "of the file: [1, %d]"),
    "range_second": ("Invalid `view_range`: %s. Its second element `%d` should be smaller than the number "
                     "of lines in the file: `%d`"),
    "range_order": ("Invalid `view_range`: %s. Its second element `%d` should be larger or equal than its "
                    "first `%d`"),
    "no_history": "No edit history found for %s.",
    "line_number": "%6d\t%s",
    "cat_n": "Here's the result of running `cat -n` on %s:\n",
    "edited": "The file %s has been edited. ",
    "review": "Review the changes and make sure they are as expected. Edit the file again if necessary.",
    "review_insert": ("Review the changes and make sure they are as expected (correct indentation, no duplicate "
                      "lines, etc). Edit the file again if necessary."),
    "snippet_of": "a snippet of %s",
    "snippet_edited": "a snippet of the edited file",
    "created": "File created successfully at: %s",
    "undone": "Last edit to %s undone successfully. ",
    "clipped": "\n<response clipped> %d more entries not shown",
}


def expand_tabs(c: Column, size: int = 8) -> Column:
    """Python ``str.expandtabs``: each tab pads to the next multiple of
    ``size`` columns, counted from the start of its line.  Text without a
    tab is returned as is."""
    def line(ln: Column) -> Column:
        segs = F.split(ln, "\t", -1)
        head = F.aggregate(
            F.slice(segs, 1, F.size(segs) - 1), F.lit(""),
            lambda acc, s: F.concat(acc, s, F.repeat(
                F.lit(" "), F.lit(size) - F.length(F.concat(acc, s)) % F.lit(size))))
        return F.concat(head, F.element_at(segs, -1))

    expanded = F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")
    return F.when(F.contains(c, F.lit("\t")), expanded).otherwise(c)


def truncate(c: Column, limit: int = MAX_RESPONSE_LEN) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.substring(c, 1, limit), F.lit(TRUNCATED_MESSAGE)))


def numbered(c: Column, init_line: Column | int = 1) -> Column:
    """``cat -n`` style: ``%6d\\t`` + line, after truncation and tab expansion."""
    i0 = F.lit(init_line) if isinstance(init_line, int) else init_line
    lines = F.split(expand_tabs(truncate(c)), "\n", -1)
    return F.array_join(F.transform(lines, lambda ln, i: F.format_string(MSG["line_number"], i + i0, ln)), "\n")


def with_numbered(df: DataFrame, text: str, init_line: Column | int, out: str) -> DataFrame:
    """``df`` with ``out`` as :func:`numbered` of the column ``text``, in steps:
    what is used more than once is a column first, so it is computed once."""
    i0 = F.lit(init_line) if isinstance(init_line, int) else init_line
    return (df.withColumn(out, truncate(F.col(text))).withColumn(out, F.split(expand_tabs(F.col(out)), "\n", -1))
            .withColumn(out, F.array_join(F.transform(out, lambda ln, i: F.format_string(MSG["line_number"], i + i0, ln)), "\n")))


def make_output(text: Column, descriptor: Column, init_line: Column | int = 1) -> Column:
    """The ``cat -n`` block the tool prints: header, numbered lines, newline."""
    return F.concat(F.format_string(MSG["cat_n"], descriptor), numbered(text, init_line), F.lit("\n"))


def _count(content: Column, old: Column) -> Column:
    """Non-overlapping occurrences (Python ``str.count``; the empty string
    occurs ``len + 1`` times)."""
    n = F.length(old)
    return F.when(n == 0, F.length(content) + 1).otherwise(
        F.floor((F.length(content) - F.length(F.replace(content, old, F.lit("")))) / n))


# -- F11 ---------------------------------------------------------------------
def replace_unique(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace ``old`` by ``new`` only where it occurs exactly once (after tab
    expansion).  Output: path, content (new or unchanged), error, snippet."""
    x = docs.join(edits, "path").select("path", expand_tabs(F.col("content")).alias("c"), expand_tabs(F.col("old")).alias("o"),
                                        F.coalesce(expand_tabs(F.col("new")), F.lit("")).alias("n"))
    # each step is a column before the next one uses it, so it is computed once
    x = x.withColumn("occ", _count(F.col("c"), F.col("o")))
    once, many = F.col("occ") == 1, F.col("occ") > 1
    hits = F.filter(F.transform(F.split("c", "\n", -1), lambda ln, i: F.when(F.contains(ln, F.col("o")), i + 1)), lambda v: v.isNotNull())
    x = x.withColumn("error", F.when(F.col("occ") == 0, F.format_string(MSG["not_found"], F.col("o"), F.col("path")))
                     .when(many, F.format_string(MSG["not_unique"], F.col("o"), F.array_join(F.transform(hits, lambda v: v.cast("string")), ", "))))
    x = x.withColumn("rl", F.when(once, F.size(F.split(F.expr("substring_index(c, o, 1)"), "\n", -1)) - 1))
    x = x.withColumn("content", F.when(once, F.replace("c", "o", "n")).otherwise(F.col("c")))
    x = x.withColumn("start", F.greatest(F.lit(0), F.col("rl") - SNIPPET_LINES) + 1)
    upto = F.col("rl") + SNIPPET_LINES + F.size(F.split("n", "\n", -1))
    x = x.withColumn("shown", F.when(once, F.array_join(F.slice(F.split("content", "\n", -1), F.col("start"), upto - F.col("start") + 1), "\n")))
    x = with_numbered(x, "shown", F.col("start"), "snippet")
    msg = F.concat(F.format_string(MSG["edited"], F.col("path")), F.format_string(MSG["cat_n"], F.format_string(MSG["snippet_of"], F.col("path"))),
                   F.col("snippet"), F.lit("\n"), F.lit(MSG["review"]))
    return x.select("path", "content", "error", "snippet", F.when(once, msg).alias("message"))


# -- F12 ---------------------------------------------------------------------
def insert_lines(docs: DataFrame, inserts: DataFrame) -> DataFrame:
    """Insert ``text`` after line ``line`` (0 = top); valid 0..line count."""
    x = docs.join(inserts, "path").select("path", "line", F.split(expand_tabs(F.col("content")), "\n", -1).alias("l"),
                                          F.split(expand_tabs(F.col("text")), "\n", -1).alias("t"), "content")
    n = F.size("l")
    ok = (F.col("line") >= 0) & (F.col("line") <= n)
    body = F.concat(F.expr("slice(l, 1, line)"), F.col("t"),
                    F.expr("slice(l, line + 1, greatest(size(l) - line, 0))"))
    snip = F.concat(F.expr(f"slice(l, greatest(line - {SNIPPET_LINES}, 0) + 1, line - greatest(line - {SNIPPET_LINES}, 0))"),
                    F.col("t"), F.expr(f"slice(l, line + 1, {SNIPPET_LINES})"))
    x = x.select("path", F.when(ok, F.array_join(body, "\n")).otherwise(F.col("content")).alias("content"),
                 F.when(~ok, F.format_string(MSG["bad_insert"], F.col("line"), n)).alias("error"),
                 F.when(ok, F.array_join(snip, "\n")).alias("shown"),
                 F.greatest(F.lit(1), F.col("line") - SNIPPET_LINES + 1).alias("start"))
    x = with_numbered(x, "shown", F.col("start"), "snippet")
    msg = F.concat(F.format_string(MSG["edited"], F.col("path")), F.format_string(MSG["cat_n"], F.lit(MSG["snippet_edited"])),
                   F.col("snippet"), F.lit("\n"), F.lit(MSG["review_insert"]))
    return x.select("path", "content", "error", "snippet", F.when(F.col("error").isNull(), msg).alias("message"))


# -- F13 ---------------------------------------------------------------------
def create_if_absent(docs: DataFrame, creates: DataFrame) -> DataFrame:
    """Rows to add (path is new) and error rows (path exists), with a
    ``created`` flag; the caller appends the created rows."""
    new = creates.join(docs.select("path"), "path", "left_anti").select(
        "path", "content", F.lit(True).alias("created"), F.lit(None).cast("string").alias("error"),
        F.format_string(MSG["created"], F.col("path")).alias("message"))
    dup = creates.join(docs.select("path"), "path", "left_semi").select(
        "path", "content", F.lit(False).alias("created"),
        F.format_string(MSG["exists"], F.col("path")).alias("error"),
        F.lit(None).cast("string").alias("message"))
    return new.unionByName(dup)


# -- F14 ---------------------------------------------------------------------
def view_lines(docs: DataFrame, views: DataFrame) -> DataFrame:
    """Line-numbered view with optional ``[start, end]`` (end -1 = last)."""
    j = docs.join(views, "path")
    lines = F.split(F.col("content"), "\n", -1)
    x = j.select("path", "start", "end", "content", lines.alias("l"))
    n = F.size("l")
    s, e = F.col("start"), F.col("end")
    rng = F.format_string("[%d, %d]", s, e)
    has = s.isNotNull()
    err = (F.when(has & ((s < 1) | (s > n)), F.format_string(MSG["range_first"], rng, s, n))
           .when(has & (e > n), F.format_string(MSG["range_second"], rng, e, n))
           .when(has & (e != -1) & (e < s), F.format_string(MSG["range_order"], rng, e, s)))
    part = (F.when(~has, F.col("content"))
            .when(e == -1, F.array_join(F.expr("slice(l, start, size(l) - start + 1)"), "\n"))
            .otherwise(F.array_join(F.expr("slice(l, start, end - start + 1)"), "\n")))
    return x.select("path", "start", "end", err.alias("error"),
                    F.when(err.isNull(), make_output(part, F.col("path"), F.coalesce(s, F.lit(1))))
                    .alias("output"))


# -- W07 ---------------------------------------------------------------------
def char_budget(entries: DataFrame, key: str, order: list[str], body: Column, header,
                budget: int = MAX_RESPONSE_LEN, min_entry_len: int = 1, payload: list[str] = ()) -> DataFrame:
    """Emit entries ``i. body`` in order until the report (``header(n)``, then
    the entries) exceeds ``budget`` characters; the crossing entry is
    included, and the entries after it are counted in ``remaining``.

    Lengths are taken first and the ``payload`` columns (the long texts) left
    behind.  A key's entries are dealt into 256 parts, ranges of a hash of their
    order, and numbered and summed up in order within each part.  What comes before an entry
    in its part comes before it in the report too, so an entry with more than
    the budget before it in its part cannot be shown, nor can one that follows
    it; the others of all parts, a few for each part whatever the key's size,
    are the only ones that meet in one window of the key.  (All shown entries
    are among them; whatever follows the first one left out has more than the
    budget before it in this window as well.)  The payload of the shown entries
    is joined back on (key, order), which must tell entries apart if there is
    one."""
    k_max = budget // max(1, min_entry_len) + 1
    light = entries.where(F.col(key).isNotNull()).withColumn("_body", F.length(body).cast("bigint")).drop(*payload)
    part = Window.partitionBy(key, "_range").orderBy(*order)
    least = F.col("_body") + 3  # a number has a digit, a point and a space at least
    near = (light.withColumn("_range", F.shiftrightunsigned(F.xxhash64(*order), 56))
            .withColumn("_nth", F.row_number().over(part)).withColumn("_all", F.count(F.lit(1)).over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .where(F.col("_nth") <= k_max)
            .withColumn("_spent", F.sum(least).over(part.rowsBetween(Window.unboundedPreceding, 0)) - least)
            # the first of a part stays for the part's count, even if it has no text to show
            .withColumn("_in", F.coalesce(F.col("_spent") <= budget, F.lit(False))).where(F.col("_in") | (F.col("_nth") == 1))
            .withColumn("_all", F.when(F.col("_nth") == 1, F.col("_all"))).drop("_range", "_nth", "_spent"))
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = (near.withColumn("i", F.count(F.when(F.col("_in"), 1)).over(upto)).withColumn("n", F.sum("_all").over(Window.partitionBy(key)))
           .where(F.col("_in") & (F.col("i") <= k_max)).drop("_all", "_in"))
    top = (top.withColumn("_len", (F.length(F.col("i").cast("string")) + 2 + F.col("_body")).cast("bigint"))
           .withColumn("_hdr", F.length(header(F.col("n"))).cast("bigint")))
    wr = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("cum_chars", F.col("_hdr") + F.sum("_len").over(wr))
    kept = top.where(F.col("cum_chars") - F.col("_len") <= budget)
    wl = Window.partitionBy(key)
    crossed = F.max("cum_chars").over(wl) > budget
    kept = (kept.withColumn("remaining", F.when(crossed, F.col("n") - F.max("i").over(wl))
                            .otherwise(F.lit(0)).cast("bigint"))
            .withColumn("clipped", crossed).drop("_len", "_hdr", "_body"))
    return kept.join(entries.select(key, *order, *payload), [key, *order]) if payload else kept


def budget_report(entries: DataFrame, key: str, order: list[str], body: Column, header,
                  budget: int = MAX_RESPONSE_LEN, min_entry_len: int = 1, payload: list[str] = ()) -> DataFrame:
    """The rendered report per key: ``header(n)`` and the shown entries,
    cut at ``budget`` characters with a note of how many entries were not
    shown; ``report_chars`` is its length before the cut.  Only the shown
    entries are gathered, each cut to ``budget`` characters, so a key's text is
    bounded by twice the budget however many entries the key has."""
    kept = char_budget(entries, key, order, body, header, budget, min_entry_len, payload)
    piece = F.substring(F.concat(F.col("i").cast("string"), F.lit(". "), body), 1, budget)
    g = kept.groupBy(key).agg(
        F.first(header(F.col("n"))).alias("_h"), F.max("remaining").alias("remaining"),
        F.max("clipped").alias("clipped"), F.max("cum_chars").cast("bigint").alias("report_chars"),
        F.array_sort(F.collect_list(F.struct(F.col("i"), piece.alias("t")))).alias("_l"))
    out = F.concat(F.col("_h"), F.array_join(F.transform("_l", lambda x: x["t"]), ""))
    cut = F.when(F.col("clipped"), F.concat(F.substring(out, 1, budget),
                                           F.format_string(MSG["clipped"], F.col("remaining"))))
    return g.select(key, "remaining", "clipped", "report_chars", F.coalesce(cut, out).alias("output"))


# -- W09 ---------------------------------------------------------------------
def undo_last_edit(versions: DataFrame, path: str = "path", version: str = "version") -> DataFrame:
    """The version before the latest one; an error row when a path has no
    history."""
    w = Window.partitionBy(path).orderBy(F.col(version).desc())
    top2 = versions.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
    g = top2.groupBy(path).agg(F.max_by(F.struct(version, "content"), F.col("_r")).alias("v"),
                               F.max("_r").alias("_n"))
    return g.select(
        path, F.when(F.col("_n") == 2, F.col("v." + version)).alias("restored_version"),
        F.when(F.col("_n") == 2, F.col("v.content")).alias("content"),
        F.when(F.col("_n") < 2, F.format_string(MSG["no_history"], F.col(path).cast("string")))
        .alias("error"),
        F.when(F.col("_n") == 2, F.concat(F.format_string(MSG["undone"], F.col(path).cast("string")),
                                          make_output(F.col("v.content"), F.col(path).cast("string"))))
        .alias("message"))
