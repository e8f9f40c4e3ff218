"""Patch functions: normal form for deduplication (F01), dropping test-file
sections (F02) and the tokenizer-based comment stripper (X03).

Everything is a column expression over one patch per row (split, filter and
transform are linear in the patch), except trailing-comment removal, which
needs Python's tokenizer to tell a ``#`` in a string from a comment.  That
one step is an Arrow-batched pandas UDF, and it only ever sees the patches
that have a ``#`` on a changed line.
"""

from __future__ import annotations

import io
import tokenize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Path fragments that mark a test file in a diff target.
HUNK_RE = r"\A@@ -\d+(?:,(\d+))? \+\d+(?:,\d+)? @@"
PLAIN_STRING = r"""'[^'\\{]*'|"[^"\\{]*\""""
NEXT_FILE_RE = r"\n--- [^\n]*\n\+\+\+ [^\n]*\n?\z"
TEST_PATH_PATTERNS = ["/test/", "/tests/", "/testing/", "test_", "tox.ini"]


# -- X03 ---------------------------------------------------------------------
def strip_comment(line: str) -> str:
    """Drop a trailing ``#`` comment that is outside string literals and
    right-strip.  Python's tokenizer finds where the comment starts; a line
    it cannot tokenize is cut at its first ``#`` (and left as is without
    one)."""
    head = line.split("#", 1)[0]
    if "#" in line and "'" not in head and '"' not in head:
        # no string can be open at the first '#': that is where the comment
        # starts (and where the fallback would cut too), no tokenizer needed
        return head.rstrip()
    try:
        for tok in tokenize.generate_tokens(io.StringIO(line).readline):
            if tok.type == tokenize.COMMENT:
                # stop here: an unclosed bracket later on does not matter
                return line[:tok.start[1]].rstrip()
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return line.split("#", 1)[0].rstrip() if "#" in line else line
    return line.rstrip()


@F.pandas_udf(T.ArrayType(T.StringType()))
def strip_comments_udf(lines: pd.Series) -> pd.Series:
    """Vectorised X03 over ``array<string>`` rows; only lines with ``#`` go
    through the tokenizer."""
    return lines.map(lambda arr: None if arr is None else
                     [strip_comment(x) if x is not None and "#" in x else x for x in arr])


# -- F01 ---------------------------------------------------------------------
def hunk_lines(patch: Column) -> Column:
    """Lines inside hunks, in order: the text is cut before every ``@@`` and
    ``diff --git`` line; pieces that start with ``@@`` are hunks (their first
    line is the hunk header)."""
    pieces = F.split(patch, r"(?m)^(?=@@|diff --git )")
    hunks = F.filter(pieces, lambda p: F.startswith(p, F.lit("@@")))
    return F.flatten(F.transform(hunks, lambda h: _body(F.split(F.regexp_replace(h, r"\n\z", ""), "\n"), h)))


def _body(lines: Column, hunk: Column) -> Column:
    """A hunk's lines without its header and without the header of the next
    file of a plain diff.  That header's two lines look like a removed and an
    added line; the counts in the hunk's own header tell which they are."""
    size = F.regexp_extract(hunk, HUNK_RE, 1)
    old = F.when(size == "", F.lit(1)).otherwise(size.try_cast("int"))
    rest = F.slice(lines, 2, 1 << 30)
    found = F.size(F.filter(rest, lambda x: (x == "") | F.startswith(x, F.lit(" ")) | F.startswith(x, F.lit("-"))))
    header = hunk.rlike(NEXT_FILE_RE) & hunk.rlike(HUNK_RE) & (found > old)
    return F.when(header, F.slice(rest, 1, F.greatest(F.size(rest) - 2, F.lit(0)))).otherwise(rest)


def change_lines(patch: Column) -> Column:
    """Added and removed lines as ``+content`` / ``-content``: leading extra
    markers stripped from the content, blank and whole-line ``#`` comment
    lines dropped, content right-stripped."""
    lines = F.filter(hunk_lines(patch),
                     lambda x: F.startswith(x, F.lit("+")) | F.startswith(x, F.lit("-")))

    def content(x: Column) -> Column:
        body = F.substring(x, 2, 1 << 30)
        # only the marker of this line's own sign is stripped from the content
        lead = F.when(F.startswith(x, F.lit("+")), F.regexp_replace(body, r"^[+]+", "")).otherwise(
            F.regexp_replace(body, r"^[-]+", ""))
        return F.regexp_replace(lead, r"\s+$", "")

    signed = F.transform(lines, lambda x: F.struct(F.substring(x, 1, 1).alias("sign"), content(x).alias("c")))
    kept = F.filter(signed, lambda s: s["c"].rlike(r"\S") & ~s["c"].rlike(r"^\s*#"))
    return F.transform(kept, lambda s: F.concat(s["sign"], s["c"]))


def clean_patch(patch: Column, comments: bool = True) -> Column:
    """Normal form of a diff: its change lines with trailing comments removed
    and *all* whitespace dropped.  Two patches that differ only in
    whitespace, blank lines and comments get the same key."""
    lines = change_lines(patch)
    if comments:
        has_hash = F.exists(lines, lambda x: F.contains(x, F.lit("#")))
        lines = F.when(has_hash, strip_comments_udf(lines)).otherwise(lines)
    return F.regexp_replace(F.array_join(lines, "\n"), r"\s+", "")


# -- F02 ---------------------------------------------------------------------
def drop_test_files(patch: Column) -> Column:
    """Remove file sections whose ``b/`` target path (last token of the
    ``diff --git a/`` line) looks like a test path; text before the first
    section is kept."""
    sections = F.split(patch, r"(?m)^(?=diff --git a/)")

    def is_test(sec: Column) -> Column:
        first = F.regexp_extract(sec, r"^[^\n]*", 0)
        target = F.regexp_extract(first, r"(\S+)\s*$", 1)
        hit = F.lit(False)
        for p in TEST_PATH_PATTERNS:
            hit = hit | F.contains(target, F.lit(p))
        return F.startswith(sec, F.lit("diff --git a/")) & F.startswith(target, F.lit("b/")) & hit

    return F.array_join(F.filter(sections, lambda s: ~is_test(s)), "")


def non_empty(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "") != ""


def readable(patch: Column) -> Column:
    """Whether a patch has a hunk, or nothing at all."""
    return patch.rlike(r"(?m)^@@") | ~non_empty(patch)


def _cut_at_hash(line: Column) -> Column:
    """A line's text before its first ``#``, right-stripped."""
    return F.regexp_replace(F.substring_index(line, "#", 1), r"\s+$", "")


def _needs_tokenizer(line: Column) -> Column:
    """Whether the first ``#`` may be in a string: a quote is open before it,
    or a triple quote, a backslash or a replacement field (``{`` in a string)
    makes what a quote does there a matter for the tokenizer.  With closed
    plain strings before it the ``#`` begins a comment, and a line that does
    not tokenize is cut at the same place."""
    head = F.substring_index(line, "#", 1)
    rest = F.regexp_replace(head, PLAIN_STRING, "")
    unclear = rest.rlike(r"""['"\\]""") | F.contains(head, F.lit('''"""''')) | F.contains(head, F.lit("'''"))
    return F.contains(line, F.lit("#")) & unclear


def with_clean_patch(df, patch: str = "patch", out: str = "cleaned"):
    """DataFrame form of :func:`clean_patch`; null where the text has content
    but no hunk (such a patch is a class of its own, see W01).  A ``#`` with
    none but closed plain strings before it starts a comment, so such lines
    are cut in Spark.  Rows with a line where the first ``#`` may be in a string
    take the tokenizer's answer; for all other rows the UDF gets a null.  The table is read once."""
    x = df.withColumn("_lines", change_lines(F.col(patch)))
    tokenized = strip_comments_udf(F.when(F.exists("_lines", _needs_tokenizer), F.col("_lines")))
    x = x.withColumn("_tok", tokenized)
    plain = F.transform("_lines", lambda ln: F.when(F.contains(ln, F.lit("#")), _cut_at_hash(ln)).otherwise(ln))
    key = F.regexp_replace(F.array_join(F.coalesce("_tok", plain), "\n"), r"\s+", "")
    return x.withColumn(out, F.when(readable(F.col(patch)), key)).drop("_lines", "_tok")
