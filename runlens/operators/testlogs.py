"""Test logs and test statuses (S08, W04, W05, F04, X01, A08, J07-J09, T02,
U02, P08, F03).

Statuses are rows ``(instance, phase, test, status, seq)``; "last wins" is a
``max_by`` over an explicit sequence column (Spark has no file order), which
Catalyst runs as a partial + final aggregate.  Log parsing is line-oriented:
logs become ``(log_id, line_no, line)`` rows and per-line state (current
file header, previous bare id) comes from windows over ``line_no``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.named import list_files, read_pieces
from .candidates import with_dropped
from .messages import strip
from .scan import positions, running

# Patterns of the two addressable log formats.
SYMPY_FILE_RE = r"(?U)^(sympy/[\w./]+\.py)\[\d+\]"
SYMPY_RESULT_RE = r"(?U)^(test_\w+)\s+(ok|F|E|Skipped|s)\b"
DJANGO_NAME_RE = r"(?U)^(\S+)\s+\(([\w.]+)\)$"
DJANGO_TAIL_ID_RE = r"(?U)(\S+ \([\w.]+\))$"
# What ends a line (\r\n is one end).
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
LINE_END_BYTES = rb"\r\n|[\n\r\x0B\x0C\x1C-\x1E]|\xC2\x85|\xE2\x80[\xA8\xA9]"  # the same in UTF-8
STATUS_LINE_RE = r"^(PASSED|FAILED|ERROR|SKIPPED) (.+)$"
# Django status suffixes, in the order they are tried.
DJANGO_SUFFIXES = [(" ... ok", "PASSED"), (" ... OK", "PASSED"), (" ...  OK", "PASSED"),
                   (" ... FAIL", "FAILED"), (" ... ERROR", "ERROR")]


# -- S08 ---------------------------------------------------------------------
def log_lines(logs: DataFrame, log_id: str = "log_id", text: str = "value") -> DataFrame:
    """Whole-text logs -> ordered lines; ``line_no`` is 1-based and
    deterministic (lines end where Python's ``splitlines`` ends them)."""
    return logs.select(F.col(log_id).alias("log_id"), F.posexplode(split_lines(F.col(text))).alias("pos", "line")
                       ).select("log_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def split_lines(text: Column) -> Column:
    """Python ``str.splitlines``: an end at the end of the text opens no
    further line, and an empty text has no line."""
    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def read_log_lines(spark, path: str, whole_text: bool = False, listing: str = "spark") -> DataFrame:
    """One log per file, ``log_id`` = file path, contiguous 1-based
    ``line_no``.  Lines are read split by split, ordered by (file, row id) and
    numbered with a chunked running count, so no file is ever held by one task;
    a row that holds further line ends (the reader ends rows at line feeds) is
    split again, so both modes number the same lines.  ``whole_text`` reads each
    file as one row instead (for many small files).  With ``listing="tasks"`` the
    files are listed by tasks and dealt to them by size
    (:mod:`runlens.sources.named`), for very many of them: a log is streamed by
    one task, which counts its lines, and no row is numbered by a shuffle."""
    if listing == "tasks":
        pieces = read_pieces(list_files(spark, path), LINE_END_BYTES)
        return (pieces.select("path", "before", F.posexplode(split_lines(F.col("piece").cast("string"))).alias("pos", "line"))
                .select(F.col("path").alias("log_id"), (F.col("before") + F.col("pos") + 1).cast("bigint").alias("line_no"), "line"))
    if whole_text:
        raw = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("log_id"), "value")
        return log_lines(raw)
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("log_id"), F.regexp_replace("value", r"\r\z", "").alias("value"),
        F.monotonically_increasing_id().alias("_id"))
    parts = F.when(F.col("value") == "", F.array(F.lit(""))).otherwise(F.split("value", LINE_END))
    rows = raw.select("log_id", "_id", parts.alias("_parts"))
    # lines before a row: the running sum of line counts, less its own
    out = running(rows, "log_id", "_id", {"_upto": ("sum", F.size("_parts"))})
    return (out.select("log_id", (F.col("_upto") - F.size("_parts")).alias("_before"), F.posexplode("_parts").alias("_k", "line"))
            .select("log_id", (F.col("_before") + F.col("_k") + 1).cast("bigint").alias("line_no"), "line"))


# -- forward fill ----------------------------------------------------------
def forward_fill(df: DataFrame, key: str, order: str, value: str, out: str,
                 chunk: int = 65536) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row, per ``key``
    ordered by the integer ``order`` (skew-safe, see :mod:`runlens.operators.scan`)."""
    return running(df, key, order, {out: ("last", value)}, chunk=chunk)


# -- W04 ---------------------------------------------------------------------
def parse_grouped_log(lines: DataFrame) -> DataFrame:
    """sympy verbose logs: a ``sympy/..py[N]`` header sets the current file,
    ``test_x ok|F|E|Skipped|s`` lines become ``file::test_x``; results before
    any header are dropped; the last result of a name wins."""
    hdr, test, verdict = _grouped_columns(strip(F.col("line")))
    x = lines.select("log_id", "line_no", hdr.alias("_hdr"), test.alias("_test"), verdict.alias("_v"))
    x = forward_fill(x, "log_id", "line_no", "_hdr", "_file")
    res = x.where(F.col("_test").isNotNull() & F.col("_file").isNotNull()).select(
        "log_id", "line_no", F.concat(F.col("_file"), F.lit("::"), F.col("_test")).alias("test"), F.col("_v").alias("status"))
    return last_wins(res)


def _grouped_columns(s: Column) -> tuple[Column, Column, Column]:
    """File header, test name and status of a stripped line, null where it
    has none."""
    h = F.regexp_extract(s, SYMPY_FILE_RE, 1)
    t = F.regexp_extract(s, SYMPY_RESULT_RE, 1)
    v = F.regexp_extract(s, SYMPY_RESULT_RE, 2)
    status = F.when(v == "ok", "PASSED").when(v.isin("s", "Skipped"), "SKIPPED").otherwise("FAILED")
    return F.when(h != "", h), F.when((h == "") & (t != ""), t), status


def last_wins(results: DataFrame, keys: Sequence[str] = ("log_id",), test: str = "test",
              seq: str = "line_no") -> DataFrame:
    """Latest status per (keys, test)."""
    return results.groupBy(*keys, test).agg(F.max_by("status", seq).alias("status"))


# -- W05 ---------------------------------------------------------------------
def _is_name(c: Column) -> Column:
    return c.rlike(DJANGO_NAME_RE)


def parse_docstring_log(lines: DataFrame) -> DataFrame:
    """django verbose logs.  Status suffixes (`` ... ok``, FAIL, ERROR,
    `` ... skipped``) and ``FAIL:``/``ERROR:`` lines.  A name that is not
    ``method (module.Class)`` is repaired from the text after the last
    ``...`` or a trailing id; if it still is not an id, the status is also
    credited to the previous line when that line was a bare id.  A blank
    line resets the previous id.  Last wins."""
    status, name, fail_line, bare = _docstring_columns()
    x = lines.withColumn("line_s", strip(F.col("line"))).select(
        "log_id", "line_no", "line_s", name.alias("_name"), status.alias("_status"), fail_line.alias("_fail_line"), bare.alias("_bare"))
    # Previous bare id: the previous line fell through every rule and is an
    # id.  Line numbers are contiguous, so "previous line" is an equi-join on
    # (log, line_no - 1) between the status lines and the bare-id lines: unique
    # keys (no hot partition however long a log is) and only two small
    # subsets of the log move.
    before = x.where(F.col("_bare").isNotNull()).select(
        "log_id", (F.col("line_no") + 1).alias("line_no"), F.col("_bare").alias("_prev"))
    x = _named(x.where(F.col("_status").isNotNull()).join(before, ["log_id", "line_no"], "left"))
    out = x.select("log_id", "line_no", F.col("_status").alias("status"), F.explode("_tests").alias("test"))
    return last_wins(out)


def _docstring_columns() -> tuple[Column, Column, Column, Column]:
    """Status, raw name, whether it is a FAIL:/ERROR: line, and the line
    itself where it is a bare id, of the stripped line ``line_s``."""
    s = F.col("line_s")
    cases_st, cases_nm, suffix_or_skip = None, None, F.lit(False)
    for suf, st in DJANGO_SUFFIXES:
        hit = F.endswith(s, F.lit(suf))
        nm = F.expr(f"substring(line_s, 1, length(line_s) - {len(suf)})")
        cases_st = F.when(hit, F.lit(st)) if cases_st is None else cases_st.when(hit, F.lit(st))
        cases_nm = F.when(hit, nm) if cases_nm is None else cases_nm.when(hit, nm)
        suffix_or_skip = suffix_or_skip | hit
    skip_hit = F.contains(s, F.lit(" ... skipped"))
    fail_hit = F.startswith(s, F.lit("FAIL:")) | F.startswith(s, F.lit("ERROR:"))
    status = (cases_st.when(skip_hit, F.lit("SKIPPED"))
              .when(F.startswith(s, F.lit("FAIL:")), F.lit("FAILED"))
              .when(F.startswith(s, F.lit("ERROR:")), F.lit("ERROR")))
    after = strip(F.expr("substring(line_s, instr(line_s, ':') + 1)"))
    fail_name = F.when(_is_name(after), after).otherwise(F.split_part(after, F.lit(" "), F.lit(1)))
    name = (cases_nm.when(skip_hit, F.split_part(s, F.lit(" ... skipped"), F.lit(1)))
            .when(fail_hit, fail_name))
    return status, name, ~(suffix_or_skip | skip_hit) & fail_hit, F.when(status.isNull() & (s != "") & _is_name(s), s)


def _named(x: DataFrame) -> DataFrame:
    """``_tests``: the ids a status line credits, from ``_name``,
    ``_fail_line`` and ``_prev``; one step per column so each regex runs once."""
    x = x.withColumn("_n0", strip(F.col("_name")))
    x = x.withColumn("_cand", strip(F.substring_index(F.col("_n0"), "...", -1)))
    x = x.withColumn("_n1", F.when(~_is_name(F.col("_n0")) & F.contains(F.col("_n0"), F.lit("..."))
                                   & _is_name(F.col("_cand")), F.col("_cand")).otherwise(F.col("_n0")))
    x = x.withColumn("_tail", F.regexp_extract(F.col("_n1"), DJANGO_TAIL_ID_RE, 1))
    x = x.withColumn("_n2", F.when(~_is_name(F.col("_n1")) & (F.col("_tail") != "") & _is_name(F.col("_tail")),
                                   F.col("_tail")).otherwise(F.col("_n1")))
    x = x.withColumn("_n", F.when(F.col("_fail_line"), F.col("_name")).otherwise(F.col("_n2")))
    credit_prev = (~F.col("_fail_line")) & ~_is_name(F.col("_n")) & F.col("_prev").isNotNull()
    return x.withColumn("_tests", F.when(credit_prev, F.array(F.col("_prev"), F.col("_n"))).otherwise(F.array(F.col("_n"))))


# -- F04 ---------------------------------------------------------------------
def parse_status_lines(lines: DataFrame) -> DataFrame:
    """``<STATUS> <nodeid>`` lines (the streamed plugin format); last wins."""
    s = F.col("line")
    st = F.regexp_extract(s, STATUS_LINE_RE, 1)
    out = lines.where(st != "").select("log_id", "line_no", st.alias("status"),
                                       F.regexp_extract(s, STATUS_LINE_RE, 2).alias("test"))
    return last_wins(out)


def report_status(when: Column, outcome: Column) -> Column:
    """Test report event -> status line status: call passed/failed ->
    PASSED/FAILED, setup skipped/failed -> SKIPPED/ERROR, else none."""
    return (F.when((when == "call") & (outcome == "passed"), "PASSED")
            .when((when == "call") & (outcome == "failed"), "FAILED")
            .when((when == "setup") & (outcome == "skipped"), "SKIPPED")
            .when((when == "setup") & (outcome == "failed"), "ERROR"))


def retry_passes(lines: DataFrame, requested: DataFrame, key: str = "log_id") -> DataFrame:
    """``RPASS::name`` lines: a requested test passed iff its line is present."""
    passed = lines.where(F.startswith(F.col("line"), F.lit("RPASS::"))).select(
        key, F.expr("substring(line, 8)").alias("test")).distinct().withColumn("_p", F.lit(True))
    return (requested.join(passed, [key, "test"], "left")
            .withColumn("passed", F.coalesce("_p", F.lit(False))).drop("_p"))


# -- X01 ---------------------------------------------------------------------
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sympy/sympy": parse_grouped_log,
    "django/django": parse_docstring_log,
}


def parse_logs(lines: DataFrame, repo_of_log: DataFrame | None = None) -> DataFrame:
    """Every log by its repo's rules (see ``PARSERS``; other repos print status
    lines), in one pass: the rules are column expressions chosen by ``repo``,
    the state a line needs (current file header, previous bare id) comes from
    one chunked running scan, and one aggregate keeps the last status of each
    name.  A malformed log yields no rows rather than failing the job.

    ``lines`` either carries a ``repo`` column or gets it from
    ``repo_of_log`` (log_id -> repo)."""
    lr = lines if repo_of_log is None else lines.join(repo_of_log, "log_id")
    grouped, docstring = (F.col("repo") == r for r in PARSERS)
    hdr, test, verdict = _grouped_columns(F.col("line_s"))
    status, name, fail_line, bare = _docstring_columns()
    plain = F.regexp_extract("line", STATUS_LINE_RE, 1)
    x = lr.withColumn("line_s", strip(F.col("line"))).select(
        "log_id", "line_no", "repo", F.when(grouped, hdr).alias("_hdr"), F.when(grouped, test).alias("_test"),
        F.when(grouped, verdict).when(docstring, status).when(plain != "", plain).alias("_status"),
        F.when(docstring, name).alias("_name"), F.when(docstring, fail_line).alias("_fail_line"), F.when(docstring, bare).alias("_bare"),
        F.when(~(grouped | docstring) & (plain != ""), F.regexp_extract("line", STATUS_LINE_RE, 2)).alias("_plain"))
    x = running(x, "log_id", "line_no", {"_file": ("last", "_hdr"), "_prev": ("lag", "_bare")})
    x = _named(x.where(F.col("_status").isNotNull()))
    tests = (F.when(grouped, F.array(F.concat(F.col("_file"), F.lit("::"), F.col("_test"))))
             .when(docstring, F.col("_tests")).otherwise(F.array("_plain")))
    rows = x.select("log_id", "line_no", F.col("_status").alias("status"), F.explode(tests).alias("test"))
    return last_wins(rows.where(F.col("test").isNotNull()))


# -- A08 ---------------------------------------------------------------------
def latest_status(status: DataFrame, keys: Sequence[str] = ("instance_id", "phase"),
                  test: str = "test", seq: str = "seq", earliest: bool = False) -> DataFrame:
    agg = F.min_by if earliest else F.max_by
    return status.groupBy(*keys, test).agg(agg(F.col("status"), F.col(seq)).alias("status"))


def passing_tests(status: DataFrame, instance: str = "instance_id", phase: str = "find_passing",
                  test: str = "test", seq: str = "seq") -> DataFrame:
    """Latest status per test in ``phase``, PASSED only."""
    s = status.where(F.col("phase") == phase)
    return latest_status(s, [instance], test, seq).where(F.col("status") == "PASSED").drop("status")


# -- J07 ---------------------------------------------------------------------
def failed_regressions(selected: DataFrame, status: DataFrame,
                       keys: Sequence[str] = ("instance_id",), test: str = "test",
                       apply_failed: DataFrame | None = None) -> DataFrame:
    """Selected regression tests that failed: status missing or not PASSED
    (null-safe compare: a missing status is a failure).  Candidates whose
    patch did not apply fail every selected test."""
    k = list(keys)
    j = selected.join(status.select(*k, test, F.col("status").alias("_st")), k + [test], "left")
    cond = ~F.col("_st").eqNullSafe(F.lit("PASSED"))
    if apply_failed is not None:
        j = j.join(apply_failed.select(*k).distinct().withColumn("_af", F.lit(True)), k, "left")
        cond = cond | F.coalesce(F.col("_af"), F.lit(False))
        j = j.where(cond).drop("_af")
    else:
        j = j.where(cond)
    return j.drop("_st")


# -- J08 ---------------------------------------------------------------------
def confirm_failures(failed: DataFrame, retry_status: DataFrame,
                     keys: Sequence[str] = ("instance_id",), test: str = "test",
                     cap: int | None = None) -> DataFrame:
    """Keep only tests that still do not pass on retry.  With ``cap``, a
    candidate with more failures than that is taken as broken and keeps them
    all without a retry."""
    k = list(keys)
    if cap is None:
        r = retry_status.select(*k, test, F.col("status").alias("_rs"))
        return failed.join(r, k + [test], "left").where(~F.col("_rs").eqNullSafe(F.lit("PASSED"))).drop("_rs")
    cnt = failed.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    r = retry_status.select(*k, test, F.col("status").alias("_rs"))
    j = failed.join(cnt, k).join(r, k + [test], "left")
    keep = (F.col("_n") > cap) | ~F.col("_rs").eqNullSafe(F.lit("PASSED"))
    return j.where(keep).drop("_n", "_rs")


# -- J09 ---------------------------------------------------------------------
def differential_regressions(failing: DataFrame, patched: DataFrame, pristine: DataFrame,
                             keys: Sequence[str] = ("instance_id",), test: str = "test",
                             apply_failed: DataFrame | None = None) -> DataFrame:
    """A failure is a regression iff the isolated run fails with the patch
    and passes on the pristine tree; a missing status is "not passed" on
    both sides; if the patch did not apply all failures stay."""
    k = list(keys)
    p = patched.select(*k, test, (F.col("status") == "PASSED").alias("_pp"))
    q = pristine.select(*k, test, (F.col("status") == "PASSED").alias("_qp"))
    j = failing.join(p, k + [test], "left").join(q, k + [test], "left")
    cond = ~F.coalesce("_pp", F.lit(False)) & F.coalesce("_qp", F.lit(False))
    if apply_failed is not None:
        j = j.join(apply_failed.select(*k).distinct().withColumn("_af", F.lit(True)), k, "left")
        cond = cond | F.coalesce(F.col("_af"), F.lit(False))
    return j.where(cond).drop("_pp", "_qp", *(["_af"] if apply_failed is not None else []))


# -- T02 ---------------------------------------------------------------------
def first_n_per_instance(tests: DataFrame, n: int, instance: str = "instance_id",
                         order: Sequence[str] = ("test",), dropped: str | None = None) -> DataFrame:
    """First ``n`` tests per instance in order (window group limit prunes
    each partition to n rows before the sort completes).  ``dropped`` names a
    column for the number of the instance's tests left out."""
    w = Window.partitionBy(instance).orderBy(*order)
    kept = tests.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return kept if dropped is None else with_dropped(kept, tests, [instance], n, dropped)


# -- U02 ---------------------------------------------------------------------
def covering_files(tests: DataFrame, test: str = "test") -> DataFrame:
    """Distinct covering files and distinct test names of ``file::test`` ids
    (one pass: each id yields both parts, one distinct)."""
    parts = F.array(
        F.struct(F.lit("file").alias("kind"), F.split_part(F.col(test), F.lit("::"), F.lit(1)).alias("value")),
        F.struct(F.lit("test").alias("kind"), F.split_part(F.col(test), F.lit("::"), F.lit(2)).alias("value")))
    return tests.select(F.inline(parts)).distinct()


# -- P08 ---------------------------------------------------------------------
def addressable(repo: Column, name: Column) -> Column:
    """django needs ``method (module.Class)`` names; other repos take all."""
    return F.when(repo == "django/django", strip(name).rlike(DJANGO_NAME_RE)).otherwise(F.lit(True))


def addressable_counts(names: DataFrame, key: Sequence[str] = ("instance_id", "repo")) -> DataFrame:
    a = addressable(F.col("repo"), F.col("name"))
    return names.groupBy(*key).agg(F.count_if(a).cast("bigint").alias("kept"),
                                   F.count_if(~a).cast("bigint").alias("dropped"))


# -- F03 ---------------------------------------------------------------------
def test_selector(names: DataFrame, key: str = "instance_id", pos: str = "pos") -> DataFrame:
    """Runner-specific selector per name: django ``m (a.B)`` -> ``a.B.m``;
    sympy sorted distinct names; pylint/requests strip a path-like
    ``[/...]`` parameter then dedupe keeping first occurrence; others
    unchanged.  Output ``(key, repo, ord, directive)`` with ``ord`` the
    position in the runner's list."""
    repo, n = F.col("repo"), F.col("name")
    dj = F.when(strip(n).rlike(DJANGO_NAME_RE),
                F.concat(F.regexp_extract(strip(n), DJANGO_NAME_RE, 2), F.lit("."),
                         F.regexp_extract(strip(n), DJANGO_NAME_RE, 1))).otherwise(n)
    directive = (F.when(repo == "django/django", dj)
                 .when(repo.isin("pylint-dev/pylint", "psf/requests"),
                       F.regexp_replace(n, r"\[/.*\]$", ""))
                 .otherwise(n))
    d = names.select(key, "repo", F.col(pos).alias("pos"), directive.alias("directive"))
    dedup_repos = ["sympy/sympy", "pylint-dev/pylint", "psf/requests"]
    plain = d.where(~F.col("repo").isin(*dedup_repos))
    firsts = (d.where(F.col("repo").isin(*dedup_repos))
              .groupBy(key, "repo", "directive").agg(F.min("pos").alias("pos")))
    both = plain.unionByName(firsts.select(key, "repo", "pos", "directive"))
    # sympy lists sorted names, the others keep first-occurrence order; the
    # ordinal is an exact position without a per-instance window
    b = both.withColumn("_o", F.when(F.col("repo") == "sympy/sympy", F.col("directive")))
    out = positions(b, key, ["_o", "pos", "directive"], out="ord")
    return out.select(key, "repo", (F.col("ord") + 1).cast("bigint").alias("ord"), "directive")


# -- one-pass form of A08 + J07-J09 --------------------------------------------
def status_matrix(status: DataFrame, keys: Sequence[str] = ("instance_id",), test: str = "test",
                  seq: str = "seq", latest: dict[str, str] | None = None,
                  earliest: dict[str, str] | None = None) -> DataFrame:
    """One row per (keys, test) with one status column per phase: the latest
    (``max_by`` over ``seq``) for ``latest`` phases, the first for
    ``earliest`` phases.  When all phases live in one status table this
    replaces one aggregate per phase plus the joins between them with a
    single aggregate (one scan, one shuffle, map-side combine)."""
    latest = latest or {"pristine": "find_passing", "patched": "validate"}
    earliest = earliest or {}
    ph, st, sq = F.col("phase"), F.col("status"), F.col(seq)
    aggs = [F.max_by(F.when(ph == p, st), F.when(ph == p, sq)).alias(n) for n, p in latest.items()]
    aggs += [F.min_by(F.when(ph == p, st), F.when(ph == p, sq)).alias(n) for n, p in earliest.items()]
    return status.groupBy(*keys, test).agg(*aggs)


def failed_from_matrix(m: DataFrame, selected: str = "pristine", run: str = "patched") -> DataFrame:
    """J07 on a status matrix: selected (passing in ``selected``) and not
    passing in ``run`` (missing counts as failed)."""
    return m.where((F.col(selected) == "PASSED") & ~F.col(run).eqNullSafe(F.lit("PASSED")))


def confirm_from_matrix(failed: DataFrame, keys: Sequence[str] = ("instance_id",), retry: str = "retry",
                        cap: int | None = None) -> DataFrame:
    """J08 on the rows of :func:`failed_from_matrix`, whose retry status is
    already a column: no join back to a retry table, and with ``cap`` only the
    per-candidate failure count (a partial aggregate)."""
    k = list(keys)
    if cap is None:
        return failed.where(~F.col(retry).eqNullSafe(F.lit("PASSED")))
    cnt = failed.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    keep = (F.col("_n") > cap) | ~F.col(retry).eqNullSafe(F.lit("PASSED"))
    return failed.join(cnt, k).where(keep).drop("_n")
