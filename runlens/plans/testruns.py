"""Queries over test statuses and test logs (fx_status, fx_log, events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import testlogs as T
from ..sources.fixtures import fx_log, fx_prefix, fx_status, with_fx
from ..sources.tables import table


def q_passing_tests(spark, d):
    return T.passing_tests(fx_status(spark, d))


def _matrix(spark, d):
    """find_passing latest (pristine), validate latest (patched) and validate
    first (the retry / isolated run) per (instance, test), in one pass."""
    return T.status_matrix(fx_status(spark, d), earliest={"retry": "validate"})


def _failed(spark, d):
    return T.failed_from_matrix(_matrix(spark, d))


def q_failed_regressions(spark, d):
    return _failed(spark, d).select("instance_id", "test")


def q_confirm_failures(spark, d):
    return T.confirm_from_matrix(_failed(spark, d)).select("instance_id", "test")


def q_confirm_failures_capped(spark, d):
    """As the reference runs it: more than 100 failures are not retried."""
    return T.confirm_from_matrix(_failed(spark, d), cap=100).select("instance_id", "test")


def _run_tables(spark, d):
    """Selected tests, latest run, and isolated retry as tables of their own,
    and the instances whose patch did not apply (suppliers in debt)."""
    st = fx_status(spark, d)
    va = st.where(F.col("phase") == "validate")
    latest = T.latest_status(va, ["instance_id"])
    retry = T.latest_status(va, ["instance_id"], earliest=True)
    bad = table(spark, d, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("instance_id"))
    return T.passing_tests(st), latest, retry, bad


def q_failed_regressions_joined(spark, d):
    selected, latest, _, bad = _run_tables(spark, d)
    return T.failed_regressions(selected, latest, apply_failed=bad).select("instance_id", "test")


def q_confirm_failures_joined(spark, d):
    selected, latest, retry, bad = _run_tables(spark, d)
    failed = T.failed_regressions(selected, latest, apply_failed=bad)
    return T.confirm_failures(failed, retry).select("instance_id", "test")


def q_differential_joined(spark, d):
    selected, latest, retry, bad = _run_tables(spark, d)
    failed = T.failed_regressions(selected, latest, apply_failed=bad)
    pristine = T.latest_status(fx_status(spark, d).where(F.col("phase") == "find_passing"), ["instance_id"])
    return T.differential_regressions(failed, retry, pristine, apply_failed=bad).select("instance_id", "test")


def q_differential_regressions(spark, d):
    f = _failed(spark, d)
    return (f.where(~F.coalesce(F.col("retry") == "PASSED", F.lit(False))
                    & F.coalesce(F.col("pristine") == "PASSED", F.lit(False)))
            .select("instance_id", "test"))


def q_first_n_per_instance(spark, d):
    return T.first_n_per_instance(T.passing_tests(fx_status(spark, d)), n=50, dropped="dropped")


def q_seeded_sample(spark, d):
    return C.seeded_sample(T.passing_tests(fx_status(spark, d)), "instance_id", "test", k=50, seed="0", dropped="dropped")


def _batched(spark, d):
    return C.batch_and_stride(T.passing_tests(fx_status(spark, d)), "instance_id", "test",
                              batch_size=20, shards=8)


def q_batch_and_stride(spark, d):
    return _batched(spark, d).select("instance_id", "test", "pos", "batch", "shard")


def q_render_batches(spark, d):
    return C.render_batches(_batched(spark, d), "instance_id", name="test")


def q_union_batches(spark, d):
    b = _batched(spark, d)
    whole = b.select("instance_id", "batch", "test")
    samp = C.seeded_sample(b, ["instance_id", "batch"], "test", k=3, seed="s").select(
        "instance_id", "batch", "test")
    return C.union_batches(whole, samp)


def _replies_for_batches(passing, batch_size):
    """One reply per (instance, batch), derived from the keys: a truncated
    index list, or no decision for every fifth batch.  The batches of an
    instance are 0 .. ceil(n / batch_size) - 1."""
    nb = passing.groupBy("instance_id").agg(F.count(F.lit(1)).alias("_n"))
    ib = nb.select("instance_id", F.explode(F.sequence(
        F.lit(0).cast("bigint"), (F.ceil(F.col("_n") / batch_size) - 1).cast("bigint"))).alias("batch"))
    x = (F.col("instance_id") * 7 + F.col("batch") * 3) % 25
    y = (F.col("instance_id") + F.col("batch")) % 20
    reply = F.when((F.col("instance_id") + F.col("batch")) % 5 == 0, F.lit("no idea")).otherwise(
        F.concat(F.lit("["), x.cast("string"), F.lit(", "), y.cast("string"), F.lit(", "), x.cast("string"),
                 F.lit(", 99999999999999")))
    return ib.select("instance_id", "batch", reply.alias("reply"))


def q_select_regression_tests(spark, d):
    passing = T.passing_tests(fx_status(spark, d))
    b = C.batch_and_stride(passing, "instance_id", "test", batch_size=20)
    return C.select_regression_tests(b, _replies_for_batches(passing, 20), k=5)


def q_select_regression_tests_capped(spark, d):
    passing = T.passing_tests(fx_status(spark, d))
    b = C.batch_and_stride(passing, "instance_id", "test", batch_size=20)
    return C.select_regression_tests(b, _replies_for_batches(passing, 20), k=5, cap=12)


def q_parse_grouped_log(spark, d):
    return T.parse_grouped_log(fx_log(spark, d))


def q_covering_files(spark, d):
    return T.covering_files(T.parse_grouped_log(fx_log(spark, d)))


def status_log(spark, d) -> DataFrame:
    """fx_log rewritten as streamed ``<STATUS> <nodeid>`` lines."""
    lg = fx_log(spark, d)
    name = F.split_part(F.col("line"), F.lit(" "), F.lit(1))
    node = F.concat(F.lit("tests/m"), (F.col("log_id") % 7).cast("string"), F.lit("/test_x.py::"), name)
    line = (F.when(F.endswith("line", F.lit(" ok")), F.concat(F.lit("PASSED "), node))
            .when(F.endswith("line", F.lit(" s")), F.concat(F.lit("SKIPPED "), node))
            .when(F.endswith("line", F.lit(" F")), F.concat(F.lit("FAILED "), node))
            .otherwise(F.col("line")))
    return lg.select("log_id", "line_no", line.alias("line"))


def django_log(spark, d) -> DataFrame:
    """A django verbose log per user built from events (bare ids, docstring
    lines, FAIL: lines, blank lines, glued output, skips)."""
    ev = table(spark, d, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') AS INT)").cast("string")
    nm = F.concat(F.lit("test_k"), k, F.lit(" (m.C)"))
    et = F.col("event_type")
    kk = F.expr("try_cast(get_json_object(props, '$.k') AS INT)")
    line = (F.when((et == "click") & (kk % 5 == 0),
                   F.concat(F.lit("Applying m"), k, F.lit("..."), nm, F.lit(" ... ok")))
            .when(et == "click", F.concat(nm, F.lit(" ... ok")))
            .when((et == "view") & (kk % 4 == 0), F.concat(nm, F.lit(" ... skipped 'r'")))
            .when(et == "view", nm)
            .when(et == "purchase", F.concat(F.lit("Doc text "), k, F.lit(" ... ok")))
            .when(et == "error", F.concat(F.lit("FAIL: "), nm))
            .otherwise(F.lit("")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(F.col("user_id").alias("log_id"),
                     F.row_number().over(w).cast("bigint").alias("line_no"), line.alias("line"))


def q_parse_status_lines(spark, d):
    return T.parse_status_lines(status_log(spark, d))


def q_parse_docstring_log(spark, d):
    return T.parse_docstring_log(django_log(spark, d))


def q_parse_logs(spark, d):
    """Every user has a log in each of the three formats."""
    logs = [("sympy/sympy", fx_log), ("django/django", django_log), ("pytest-dev/pytest", status_log)]
    parts = [f(spark, d).select((F.col("log_id") * 3 + k).alias("log_id"), "line_no", "line", F.lit(repo).alias("repo"))
             for k, (repo, f) in enumerate(logs)]
    return T.parse_logs(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def test_names(spark, d) -> DataFrame:
    """Runner-style test names per user (one repo per user)."""
    ev = table(spark, d, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') AS INT)").cast("string")
    et = F.col("event_type")
    repo = F.element_at(F.array(*[F.lit(r) for r in
                                  ["django/django", "sympy/sympy", "pylint-dev/pylint", "astropy/astropy"]]),
                        (F.col("user_id") % 4 + 1).cast("int"))
    name = (F.when(F.col("user_id") % 4 == 0,
                   F.when(et == "signup", F.lit("--version is equivalent to version"))
                   .otherwise(F.concat(F.lit("test_"), et, F.lit(" (m"), k, F.lit(".C)"))))
            .when(F.col("user_id") % 4 == 1,
                  F.concat(F.lit("sympy/m"), k, F.lit("/test_f.py::test_"), et))
            .when(F.col("user_id") % 4 == 2,
                  F.concat(F.lit("tests/t"), k, F.lit(".py::test_"), et, F.lit("[/a/b/"),
                           F.col("event_id").cast("string"), F.lit("]")))
            .otherwise(F.concat(F.lit("tests/t.py::test_"), et, F.lit("["), k, F.lit("]"))))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(F.col("user_id").alias("instance_id"), repo.alias("repo"),
                     F.row_number().over(w).cast("bigint").alias("pos"), name.alias("name"))


def q_addressable_tests(spark, d):
    return T.addressable_counts(test_names(spark, d))


def q_test_selector(spark, d):
    return T.test_selector(test_names(spark, d))


QUERIES = {
    "passing_tests": q_passing_tests,
    "failed_regressions": q_failed_regressions,
    "confirm_failures": q_confirm_failures,
    "confirm_failures_capped": q_confirm_failures_capped,
    "failed_regressions_joined": q_failed_regressions_joined,
    "confirm_failures_joined": q_confirm_failures_joined,
    "differential_joined": q_differential_joined,
    "differential_regressions": q_differential_regressions,
    "first_n_per_instance": q_first_n_per_instance,
    "seeded_sample": q_seeded_sample,
    "batch_and_stride": q_batch_and_stride,
    "render_batches": q_render_batches,
    "union_batches": q_union_batches,
    "select_regression_tests": q_select_regression_tests,
    "select_regression_tests_capped": q_select_regression_tests_capped,
    "parse_grouped_log": q_parse_grouped_log,
    "covering_files": q_covering_files,
    "parse_status_lines": q_parse_status_lines,
    "parse_docstring_log": q_parse_docstring_log,
    "parse_logs": q_parse_logs,
    "addressable_tests": q_addressable_tests,
    "test_selector": q_test_selector,
}

# -- DuckDB oracles ----------------------------------------------------------
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_LATEST = """
{name} AS (SELECT instance_id, test, status FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_id, test
                               ORDER BY s_d {dir}, s_o {dir}, s_l {dir}, s_p {dir}, s_f {dir}) AS r
  FROM fx_status WHERE phase = '{phase}') WHERE r = 1)"""
_STATUS_CTES = ",\n".join([
    _LATEST.format(name="fp", phase="find_passing", dir="DESC").strip(),
    _LATEST.format(name="va", phase="validate", dir="DESC").strip(),
    _LATEST.format(name="va_first", phase="validate", dir="ASC").strip(),
    "passing AS (SELECT instance_id, test FROM fp WHERE status = 'PASSED')",
    """failed AS (SELECT p.instance_id, p.test FROM passing p LEFT JOIN va v USING (instance_id, test)
                  WHERE v.status IS DISTINCT FROM 'PASSED')""",
    """batched AS (SELECT instance_id, test, pos, CAST(floor(pos / 20) AS BIGINT) AS batch,
                          pos % least(8, n) AS shard
                   FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY test) - 1 AS pos,
                                count(*) OVER (PARTITION BY instance_id) AS n FROM passing))""",
])


def _st(body: str) -> str:
    body = body.strip()
    return fx_prefix("fx_status") + ",\n" + _STATUS_CTES + ("" if body.startswith(",") else "\n") + body


_W04_SQL = f"""
SELECT log_id, test, arg_max(status, line_no) AS status FROM (
  SELECT log_id, line_no, file || '::' || t AS test,
         CASE WHEN v = 'ok' THEN 'PASSED' WHEN v IN ('s', 'Skipped') THEN 'SKIPPED' ELSE 'FAILED' END AS status
  FROM (SELECT *, last_value(hdr IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file
        FROM (SELECT log_id, line_no,
                     nullif(regexp_extract(s, '^(sympy/[\\w./]+\\.py)\\[\\d+\\]', 1), '') AS hdr,
                     CASE WHEN regexp_extract(s, '^(sympy/[\\w./]+\\.py)\\[\\d+\\]', 1) = ''
                          THEN nullif(regexp_extract(s, '^(test_\\w+)\\s+(ok|F|E|Skipped|s)\\b', 1), '') END AS t,
                     regexp_extract(s, '^(test_\\w+)\\s+(ok|F|E|Skipped|s)\\b', 2) AS v
              FROM (SELECT *, {_STRIP.format(x='line')} AS s FROM {{src}})))
  WHERE t IS NOT NULL AND file IS NOT NULL)
GROUP BY log_id, test"""

_STATUS_LOG_SQL = """
status_log AS (SELECT log_id, line_no,
  CASE WHEN ends_with(line, ' ok') THEN 'PASSED ' || node
       WHEN ends_with(line, ' s') THEN 'SKIPPED ' || node
       WHEN ends_with(line, ' F') THEN 'FAILED ' || node ELSE line END AS line
  FROM (SELECT *, 'tests/m' || CAST(log_id % 7 AS VARCHAR(20)) || '/test_x.py::' || split_part(line, ' ', 1) AS node
        FROM fx_log))"""

_F04_SQL = """
SELECT log_id, test, arg_max(status, line_no) AS status FROM (
  SELECT log_id, line_no, regexp_extract(line, '^(PASSED|FAILED|ERROR|SKIPPED) (.+)$', 1) AS status,
         regexp_extract(line, '^(PASSED|FAILED|ERROR|SKIPPED) (.+)$', 2) AS test
  FROM {src}) WHERE status <> '' GROUP BY log_id, test"""

_K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"
_DJ_LOG_SQL = f"""
dj_log AS (SELECT user_id AS log_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no,
  CASE WHEN event_type = 'click' AND {_K} % 5 = 0 THEN 'Applying m' || ks || '...' || nm || ' ... ok'
       WHEN event_type = 'click' THEN nm || ' ... ok'
       WHEN event_type = 'view' AND {_K} % 4 = 0 THEN nm || ' ... skipped ''r'''
       WHEN event_type = 'view' THEN nm
       WHEN event_type = 'purchase' THEN 'Doc text ' || ks || ' ... ok'
       WHEN event_type = 'error' THEN 'FAIL: ' || nm
       ELSE '' END AS line
  FROM (SELECT *, CAST({_K} AS VARCHAR(20)) AS ks, 'test_k' || CAST({_K} AS VARCHAR(20)) || ' (m.C)' AS nm
        FROM events))"""

_NAME = "'^(\\S+)\\s+\\(([\\w.]+)\\)$'"
_W05_SQL = f"""
SELECT log_id, test, arg_max(status, line_no) AS status FROM (
  SELECT log_id, line_no, status, n AS test FROM named
  UNION ALL
  SELECT log_id, line_no, status, prev FROM named
  WHERE NOT fail_line AND NOT regexp_matches(n, {_NAME}) AND prev IS NOT NULL)
GROUP BY log_id, test"""
_W05_CTES = f"""
dj_s AS (SELECT log_id, line_no, {_STRIP.format(x='line')} AS s FROM {{src}}),
dj_c AS (SELECT *,
  CASE WHEN ends_with(s, ' ... ok') THEN 'PASSED' WHEN ends_with(s, ' ... OK') THEN 'PASSED'
       WHEN ends_with(s, ' ...  OK') THEN 'PASSED' WHEN ends_with(s, ' ... FAIL') THEN 'FAILED'
       WHEN ends_with(s, ' ... ERROR') THEN 'ERROR' WHEN contains(s, ' ... skipped') THEN 'SKIPPED'
       WHEN starts_with(s, 'FAIL:') THEN 'FAILED' WHEN starts_with(s, 'ERROR:') THEN 'ERROR' END AS status,
  CASE WHEN ends_with(s, ' ... ok') THEN left(s, length(s) - 7) WHEN ends_with(s, ' ... OK') THEN left(s, length(s) - 7)
       WHEN ends_with(s, ' ...  OK') THEN left(s, length(s) - 8) WHEN ends_with(s, ' ... FAIL') THEN left(s, length(s) - 9)
       WHEN ends_with(s, ' ... ERROR') THEN left(s, length(s) - 10)
       WHEN contains(s, ' ... skipped') THEN split_part(s, ' ... skipped', 1) END AS raw_name,
  NOT (ends_with(s, ' ... ok') OR ends_with(s, ' ... OK') OR ends_with(s, ' ...  OK') OR ends_with(s, ' ... FAIL')
       OR ends_with(s, ' ... ERROR') OR contains(s, ' ... skipped'))
  AND (starts_with(s, 'FAIL:') OR starts_with(s, 'ERROR:')) AS fail_line
  FROM dj_s),
dj_p AS (SELECT *, lag(CASE WHEN status IS NULL AND s <> '' AND regexp_matches(s, {_NAME}) THEN s END)
                    OVER (PARTITION BY log_id ORDER BY line_no) AS prev FROM dj_c),
dj_f AS (SELECT *, {_STRIP.format(x="substr(s, instr(s, ':') + 1)")} AS after FROM dj_p WHERE status IS NOT NULL),
dj_n0 AS (SELECT *, {_STRIP.format(x='raw_name')} AS n0 FROM dj_f),
dj_n1 AS (SELECT *, CASE WHEN NOT regexp_matches(n0, {_NAME}) AND contains(n0, '...')
                          AND regexp_matches({_STRIP.format(x="string_split(n0, '...')[-1]")}, {_NAME})
                         THEN {_STRIP.format(x="string_split(n0, '...')[-1]")} ELSE n0 END AS n1 FROM dj_n0),
dj_n2 AS (SELECT *, regexp_extract(n1, '(\\S+ \\([\\w.]+\\))$', 1) AS tail FROM dj_n1),
named AS (SELECT log_id, line_no, status, fail_line, prev,
  CASE WHEN fail_line THEN CASE WHEN regexp_matches(after, {_NAME}) THEN after ELSE split_part(after, ' ', 1) END
       WHEN NOT regexp_matches(n1, {_NAME}) AND tail <> '' AND regexp_matches(tail, {_NAME}) THEN tail
       ELSE n1 END AS n
  FROM dj_n2)"""

_NAMES_SQL = f"""
names AS (SELECT user_id AS instance_id,
  (['django/django', 'sympy/sympy', 'pylint-dev/pylint', 'astropy/astropy'])[CAST(user_id % 4 AS INTEGER) + 1] AS repo,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
  CASE user_id % 4
    WHEN 0 THEN CASE WHEN event_type = 'signup' THEN '--version is equivalent to version'
                     ELSE 'test_' || event_type || ' (m' || ks || '.C)' END
    WHEN 1 THEN 'sympy/m' || ks || '/test_f.py::test_' || event_type
    WHEN 2 THEN 'tests/t' || ks || '.py::test_' || event_type || '[/a/b/' || CAST(event_id AS VARCHAR(20)) || ']'
    ELSE 'tests/t.py::test_' || event_type || '[' || ks || ']' END AS name
  FROM (SELECT *, CAST({_K} AS VARCHAR(20)) AS ks FROM events))"""

_CHOSEN = """
, rep AS (SELECT DISTINCT instance_id, batch,
                 CASE WHEN (instance_id + batch) % 5 = 0 THEN 'no idea'
                      ELSE '[' || CAST((instance_id * 7 + batch * 3) % 25 AS VARCHAR) || ', '
                           || CAST((instance_id + batch) % 20 AS VARCHAR) || ', '
                           || CAST((instance_id * 7 + batch * 3) % 25 AS VARCHAR) || ', 99999999999999' END AS reply
          FROM batched),
b AS (SELECT *, pos - min(pos) OVER (PARTITION BY instance_id, batch) AS li,
             count(*) OVER (PARTITION BY instance_id, batch) AS n FROM batched),
ints AS (SELECT r.instance_id, r.batch, s.n,
                list_transform(regexp_extract_all(r.reply, '(\\d+)', 1), lambda t: TRY_CAST(t AS INTEGER)) AS xs
         FROM rep r JOIN (SELECT DISTINCT instance_id, batch, n FROM b) s USING (instance_id, batch)),
idx AS (SELECT instance_id, batch,
               list_filter(xs, lambda x, i: x IS NOT NULL AND x >= 0 AND x < n AND list_position(xs, x) = i) AS ix
        FROM ints),
picks AS (SELECT instance_id, batch, unnest(ix) AS li FROM idx),
picked AS (SELECT b.instance_id, b.batch, b.test, 'reply' AS source FROM b JOIN picks p USING (instance_id, batch, li)),
fallback AS (SELECT instance_id, batch, test, 'fallback' AS source FROM (
               SELECT b.*, row_number() OVER (PARTITION BY b.instance_id, b.batch
                         ORDER BY md5('batch:' || CAST(b.instance_id AS VARCHAR) || ':' || CAST(b.batch AS VARCHAR)
                                      || ':' || b.test), b.test) AS r
               FROM b JOIN idx i USING (instance_id, batch) WHERE len(i.ix) = 0) WHERE r <= 5),
chosen AS (SELECT * FROM picked UNION ALL SELECT * FROM fallback)"""
_JOINED = """
, bad AS (SELECT s_suppkey AS instance_id FROM supplier WHERE s_acctbal < 0),
failed2 AS (SELECT p.instance_id, p.test FROM passing p LEFT JOIN va v USING (instance_id, test)
            WHERE v.status IS DISTINCT FROM 'PASSED' OR p.instance_id IN (SELECT * FROM bad))
"""

ORACLE = {
    "passing_tests": _st("SELECT * FROM passing"),
    "failed_regressions": _st("SELECT * FROM failed"),
    "confirm_failures": _st("""
SELECT f.instance_id, f.test FROM failed f LEFT JOIN va_first r USING (instance_id, test)
WHERE r.status IS DISTINCT FROM 'PASSED'"""),
    "failed_regressions_joined": _st(_JOINED + "SELECT * FROM failed2"),
    "confirm_failures_joined": _st(_JOINED + """
SELECT f.instance_id, f.test FROM failed2 f LEFT JOIN va_first r USING (instance_id, test)
WHERE r.status IS DISTINCT FROM 'PASSED'"""),
    "differential_joined": _st(_JOINED + """
SELECT f.instance_id, f.test FROM failed2 f
LEFT JOIN va_first p USING (instance_id, test) LEFT JOIN fp q USING (instance_id, test)
WHERE f.instance_id IN (SELECT * FROM bad)
   OR (NOT coalesce(p.status = 'PASSED', false) AND coalesce(q.status = 'PASSED', false))"""),
    "confirm_failures_capped": _st("""
SELECT f.instance_id, f.test FROM failed f
JOIN (SELECT instance_id, count(*) AS n FROM failed GROUP BY instance_id) c USING (instance_id)
LEFT JOIN va_first r USING (instance_id, test)
WHERE c.n > 100 OR r.status IS DISTINCT FROM 'PASSED'"""),
    "differential_regressions": _st("""
SELECT f.instance_id, f.test FROM failed f
LEFT JOIN va_first p USING (instance_id, test) LEFT JOIN fp q USING (instance_id, test)
WHERE NOT coalesce(p.status = 'PASSED', false) AND coalesce(q.status = 'PASSED', false)"""),
    "first_n_per_instance": _st("""
SELECT instance_id, test, greatest(n - 50, 0) AS dropped FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY test) AS r,
         count(*) OVER (PARTITION BY instance_id) AS n FROM passing) WHERE r <= 50"""),
    "seeded_sample": _st("""
SELECT instance_id, test, greatest(n - 50, 0) AS dropped FROM (
  SELECT *, count(*) OVER (PARTITION BY instance_id) AS n, row_number() OVER (PARTITION BY instance_id
            ORDER BY md5('0:' || CAST(instance_id AS VARCHAR(20)) || ':' || test), test) AS r
  FROM passing) WHERE r <= 50"""),
    "batch_and_stride": _st("SELECT * FROM batched"),
    "render_batches": _st("""
SELECT instance_id, batch, count(*) AS n_items,
       string_agg(CAST(pos - p0 AS VARCHAR(20)) || '. ' || test, chr(10) ORDER BY pos) AS text
FROM (SELECT *, min(pos) OVER (PARTITION BY instance_id, batch) AS p0 FROM batched)
GROUP BY instance_id, batch"""),
    "union_batches": _st("""
SELECT instance_id, batch, test FROM batched
UNION ALL
SELECT instance_id, batch, test FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_id, batch
            ORDER BY md5('s:' || CAST(instance_id AS VARCHAR(20)) || ':' || CAST(batch AS VARCHAR(20)) || ':' || test), test) AS r
  FROM batched) WHERE r <= 3"""),
    "select_regression_tests": _st(_CHOSEN + """
SELECT instance_id, batch, test, source FROM chosen""").replace("\n, rep AS", ",\nrep AS"),
    "select_regression_tests_capped": _st(_CHOSEN + """
SELECT instance_id, batch, test, source, greatest(cn - 12, 0) AS dropped FROM (
  SELECT *, count(*) OVER (PARTITION BY instance_id) AS cn, row_number() OVER (PARTITION BY instance_id
              ORDER BY md5('cap:' || CAST(instance_id AS VARCHAR) || ':' || test), test) AS r FROM chosen)
WHERE r <= 12""").replace("\n, rep AS", ",\nrep AS"),
    "parse_grouped_log": with_fx(_W04_SQL.format(src="fx_log"), "fx_log"),
    "covering_files": with_fx(f"""
SELECT DISTINCT 'file' AS kind, split_part(test, '::', 1) AS value FROM ({_W04_SQL.format(src='fx_log')})
UNION
SELECT DISTINCT 'test', split_part(test, '::', 2) FROM ({_W04_SQL.format(src='fx_log')})""", "fx_log"),
    "parse_status_lines": fx_prefix("fx_log") + ",\n" + _STATUS_LOG_SQL.strip() + "\n"
    + _F04_SQL.format(src="status_log"),
    "parse_docstring_log": "WITH " + _DJ_LOG_SQL.strip() + ",\n" + _W05_CTES.format(src="dj_log").strip()
    + "\n" + _W05_SQL,
    "parse_logs": fx_prefix("fx_log") + ",\n" + _STATUS_LOG_SQL.strip() + ",\n" + _DJ_LOG_SQL.strip() + ",\n"
    + _W05_CTES.format(src="(SELECT log_id * 3 + 1 AS log_id, line_no, line FROM dj_log)").strip() + "\n"
    + _W04_SQL.format(src="(SELECT log_id * 3 AS log_id, line_no, line FROM fx_log)") + "\nUNION ALL\n" + _W05_SQL
    + "\nUNION ALL\n" + _F04_SQL.format(src="(SELECT log_id * 3 + 2 AS log_id, line_no, line FROM status_log)"),
    "addressable_tests": "WITH " + _NAMES_SQL.strip() + f"""
SELECT instance_id, repo,
  count(*) FILTER (WHERE repo <> 'django/django' OR regexp_matches({_STRIP.format(x='name')}, {_NAME})) AS kept,
  count(*) FILTER (WHERE repo = 'django/django' AND NOT regexp_matches({_STRIP.format(x='name')}, {_NAME})) AS dropped
FROM names GROUP BY instance_id, repo""",
    "test_selector": "WITH " + _NAMES_SQL.strip() + f""",
d AS (SELECT instance_id, repo, pos,
  CASE WHEN repo = 'django/django' AND regexp_matches({_STRIP.format(x='name')}, {_NAME})
         THEN regexp_extract({_STRIP.format(x='name')}, {_NAME}, 2) || '.' || regexp_extract({_STRIP.format(x='name')}, {_NAME}, 1)
       WHEN repo IN ('pylint-dev/pylint', 'psf/requests') THEN regexp_replace(name, '\\[/.*\\]$', '')
       ELSE name END AS directive FROM names),
both_ AS (SELECT instance_id, repo, pos, directive FROM d WHERE repo NOT IN ('sympy/sympy', 'pylint-dev/pylint', 'psf/requests')
          UNION ALL
          SELECT instance_id, repo, min(pos), directive FROM d
          WHERE repo IN ('sympy/sympy', 'pylint-dev/pylint', 'psf/requests') GROUP BY instance_id, repo, directive)
SELECT instance_id, repo,
       row_number() OVER (PARTITION BY instance_id ORDER BY CASE WHEN repo = 'sympy/sympy' THEN directive END NULLS FIRST, pos) AS ord,
       directive
FROM both_""",
}
