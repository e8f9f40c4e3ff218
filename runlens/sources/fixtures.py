"""Record-shaped views over the driver tables.

The driver's Parquet tables are TPC-H-like; the operators in this package work
on agent-run records (steps, candidates, votes, test statuses, spans ...).
Each ``fx_*`` function maps a driver table onto one record shape with plain
column expressions (plus one partitioned ``row_number`` where a position is
needed), and ``FX_SQL`` holds the same view in DuckDB SQL so the oracle runs
on identical input.  All views are derived from the whole table: no id subset
or row cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

# The eight step tags known to the step labeller.
KNOWN_TAGS = ["WRITE_TEST", "VERIFY_TEST", "EXAMINE_CODE", "WRITE_FIX",
              "VERIFY_FIX", "REPORT", "THINK", "OUTLIER"]


def _k() -> Column:
    """The integer in ``events.props`` (``{"k": int}``)."""
    return F.expr("try_cast(get_json_object(props, '$.k') AS INT)")


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def fx_steps(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(
        F.col("user_id").alias("run_id"),
        F.row_number().over(w).cast("bigint").alias("step_number"),
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("tool"),
        (F.col("event_type") != "error").alias("success"),
        _k().cast("bigint").alias("input_tokens"),
        F.floor("value").cast("bigint").alias("output_tokens"),
        F.col("value").alias("latency_s"),
        F.concat(F.lit("m"), _s(F.col("user_id") % 5)).alias("model"),
        F.concat(F.lit("p"), _s(F.col("user_id") % 3)).alias("provider"),
        F.col("ts"),
    )


def fx_messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"),
                    "role", F.col("text").alias("content"))


def fx_candidates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    idx = (F.row_number().over(w) - 1).cast("bigint")
    return (o.select(
        F.col("o_custkey").alias("instance_id"),
        idx.alias("idx"),
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderpriority").alias("cleaned"),
        # whitespace-only patch for partially filled orders (blank-patch rule)
        F.when(F.col("o_orderstatus") == "P", F.lit(" \t\n"))
         .otherwise(F.concat(F.lit("diff "), F.col("o_orderpriority"))).alias("patch"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
         .otherwise(-1).cast("bigint").alias("success_id"),
        (F.col("o_totalprice") <= 250000).alias("ok"))
        .withColumn("grp", F.floor(F.col("idx") / 4).cast("bigint")))


def fx_votes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("ballot"),
        (F.row_number().over(w) - 1).cast("bigint").alias("vote_idx"),
        F.col("o_orderpriority").alias("voted"),
        F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).cast("bigint").alias("n"))


def fx_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    lab = table(spark, d, "labels")
    return docs.join(lab, "doc_id").select(
        F.col("source").alias("group_id"),
        F.col("doc_id").alias("instance_id"),
        F.col("quality").cast("bigint").alias("is_success"),
        ((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("is_all_success"),
        ((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("is_all_failed"))


def fx_log(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = _s(_k())
    eid = _s("event_id")
    line = (F.when(F.col("event_type") == "signup",
                   F.concat(F.lit("sympy/m"), k, F.lit("/test_f.py["), k, F.lit("]")))
            .when(F.col("event_type") == "click", F.concat(F.lit("test_e"), eid, F.lit(" ok")))
            .when(F.col("event_type") == "view", F.concat(F.lit("test_e"), eid, F.lit(" s")))
            .otherwise(F.concat(F.lit("test_e"), eid, F.lit(" F"))))
    return ev.select(F.col("user_id").alias("log_id"),
                     F.row_number().over(w).cast("bigint").alias("line_no"),
                     line.alias("line"))


def fx_status(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("instance_id"),
        F.concat(F.lit("t"), _s("l_partkey")).alias("test"),
        F.when(F.col("l_linestatus") == "O", "find_passing").otherwise("validate").alias("phase"),
        F.when(F.col("l_returnflag") == "R", "PASSED").when(F.col("l_returnflag") == "N", "FAILED")
         .otherwise("ERROR").alias("status"),
        F.struct(F.col("l_shipdate").alias("d"), F.col("l_orderkey").alias("o"),
                 F.col("l_linenumber").alias("l"), F.col("l_extendedprice").alias("p"),
                 F.col("l_returnflag").alias("f")).alias("seq"))


def fx_spans(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_extendedprice")
    start = (1 + F.col("l_partkey") % 60).cast("bigint")
    return li.select(
        F.concat(F.lit("src/f"), _s("l_orderkey"), F.lit(".py")).alias("file_path"),
        F.row_number().over(w).cast("bigint").alias("sid"),
        F.concat(F.lit("n"), _s("l_partkey")).alias("name"),
        F.when(F.col("l_returnflag") == "A", "class").otherwise("function").alias("kind"),
        start.alias("start_line"),
        (start + F.col("l_quantity").cast("bigint")).alias("end_line"))


_EXT = ["py", "java", "c", "cpp", "ts", "md"]


def fx_files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % 6 + 1).cast("int"))
    dot = lambda m: F.when(F.col("doc_id") % m == 0, ".").otherwise("")
    path = F.concat(F.lit("/repo/"), dot(13), F.col("source"), F.lit("/"), dot(11),
                    F.lit("f"), _s("doc_id"), F.lit("."), ext)
    return docs.select(
        F.col("doc_id"), path.alias("path"), F.col("source").alias("root"),
        (F.lit(1704067200) + F.col("doc_id") * 3600).cast("bigint").alias("mtime"),
        F.col("n_chars").alias("size"), F.col("text").alias("content"))


def _word() -> Column:
    # the whole document, kept on one diff line (non-letters become "_")
    return F.regexp_replace(F.col("text"), "[^A-Za-z]", "_")


def fx_patch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    top = (F.when(F.col("lang") == "en", "src/").when(F.col("lang") == "de", "pkg/testing/")
           .otherwise("lib/"))
    f1 = F.concat(top, F.lit("m.py"))
    word = _word()
    patch = F.concat(
        F.lit("diff --git a/"), f1, F.lit(" b/"), f1, F.lit("\n--- a/"), f1, F.lit("\n+++ b/"), f1,
        F.lit("\n@@ -1,3 +1,3 @@\n ctx = 0\n-old = 1\n+"), word, F.lit(" = 1  # note\n\n+# added\n"),
        F.lit("diff --git a/tests/test_m.py b/tests/test_m.py\n--- a/tests/test_m.py\n"
              "+++ b/tests/test_m.py\n@@ -1 +1 @@\n-x = 0\n+"), word, F.lit(" = 2\n"))
    return docs.select("doc_id", "lang", patch.alias("patch"))


def fx_json(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select(F.col("event_id").alias("doc_id"), F.col("props").alias("doc"))


def fx_replies(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    k = _s(_k())
    et = F.col("event_type")
    index_reply = F.concat(F.lit("["), k, F.lit(", 3, 17, "), k, F.lit(", 99999999999999"))
    select_reply = F.when(et == "error", F.lit("no decision")).otherwise(
        F.concat(F.lit("### Status: succeed\n### Result: Patch-"), _s(_k() % 7),
                 F.lit("\n### Analysis: ok")))
    tag_reply = (F.when(et == "click", "<tags>THINK</tags>")
                 .when(et == "view", "<tags>WRITE_FIX, VERIFY_FIX</tags>")
                 .when(et == "error", "<tags>WRITE_FIX,BOGUS</tags>")
                 .when(et == "purchase", "<tags></tags>")
                 .otherwise("no tags here"))
    return ev.select(F.col("event_id").alias("reply_id"), F.col("user_id").alias("run_id"),
                     index_reply.alias("index_reply"), select_reply.alias("select_reply"),
                     tag_reply.alias("tag_reply"))


def fx_thoughts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    t = F.col("turn")
    return c.select(
        F.col("conv_id").alias("session_id"), t.alias("pos"), F.col("text").alias("thought"),
        t.alias("thought_number"), F.lit(3).cast("bigint").alias("total_thoughts"),
        (F.col("role") != "assistant").alias("next_thought_needed"),
        F.when(t % 3 == 2, t - 1).otherwise(F.lit(0)).cast("bigint").alias("branch_from_thought"),
        F.when(t % 2 == 0, F.concat(F.lit("b"), _s(t % 4))).alias("branch_id"))


# --------------------------------------------------------------------------
# The same views in DuckDB SQL (for the oracle).
# --------------------------------------------------------------------------
_K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"
_W = "regexp_replace(text, '[^A-Za-z]', '_', 'g')"
_NL = "chr(10)"

FX_SQL: dict[str, str] = {
    "fx_steps": f"""
SELECT user_id AS run_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_number,
       event_id AS call_id, event_type AS tool, event_type <> 'error' AS success,
       CAST({_K} AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens,
       value AS latency_s,
       'm' || CAST(user_id % 5 AS VARCHAR(20)) AS model,
       'p' || CAST(user_id % 3 AS VARCHAR(20)) AS provider, ts
FROM events""",
    "fx_messages": "SELECT conv_id AS run_id, turn AS step, role, text AS content FROM conversations",
    "fx_candidates": """
SELECT instance_id, idx, order_key, cleaned, patch, success_id, ok,
       CAST(floor(idx / 4) AS BIGINT) AS grp
FROM (SELECT o_custkey AS instance_id,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx,
             o_orderkey AS order_key, o_orderpriority AS cleaned,
             CASE WHEN o_orderstatus = 'P' THEN ' ' || chr(9) || chr(10)
                  ELSE 'diff ' || o_orderpriority END AS patch,
             CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS BIGINT) AS success_id,
             o_totalprice <= 250000 AS ok
      FROM orders)""",
    "fx_votes": """
SELECT o_custkey AS ballot,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS vote_idx,
       o_orderpriority AS voted,
       count(*) OVER (PARTITION BY o_custkey) AS n
FROM orders""",
    "fx_stats": """
SELECT d.source AS group_id, d.doc_id AS instance_id, CAST(l.quality AS BIGINT) AS is_success,
       (l.quality = 1 AND l.toxic = 1) AS is_all_success,
       (l.quality = 0 AND l.toxic = 1) AS is_all_failed
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_log": f"""
SELECT user_id AS log_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no,
       CASE WHEN event_type = 'signup'
              THEN 'sympy/m' || CAST({_K} AS VARCHAR(20)) || '/test_f.py[' || CAST({_K} AS VARCHAR(20)) || ']'
            WHEN event_type = 'click' THEN 'test_e' || CAST(event_id AS VARCHAR(20)) || ' ok'
            WHEN event_type = 'view' THEN 'test_e' || CAST(event_id AS VARCHAR(20)) || ' s'
            ELSE 'test_e' || CAST(event_id AS VARCHAR(20)) || ' F' END AS line
FROM events""",
    "fx_status": """
SELECT l_suppkey AS instance_id, 't' || CAST(l_partkey AS VARCHAR(20)) AS test,
       CASE WHEN l_linestatus = 'O' THEN 'find_passing' ELSE 'validate' END AS phase,
       CASE l_returnflag WHEN 'R' THEN 'PASSED' WHEN 'N' THEN 'FAILED' ELSE 'ERROR' END AS status,
       l_shipdate AS s_d, l_orderkey AS s_o, l_linenumber AS s_l, l_extendedprice AS s_p,
       l_returnflag AS s_f
FROM lineitem""",
    "fx_spans": """
SELECT 'src/f' || CAST(l_orderkey AS VARCHAR(20)) || '.py' AS file_path,
       row_number() OVER (PARTITION BY l_orderkey
                          ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS sid,
       'n' || CAST(l_partkey AS VARCHAR(20)) AS name,
       CASE WHEN l_returnflag = 'A' THEN 'class' ELSE 'function' END AS kind,
       1 + l_partkey % 60 AS start_line,
       1 + l_partkey % 60 + CAST(l_quantity AS BIGINT) AS end_line
FROM lineitem""",
    "fx_files": """
SELECT doc_id,
       '/repo/' || CASE WHEN doc_id % 13 = 0 THEN '.' ELSE '' END || source || '/'
         || CASE WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || 'f' || CAST(doc_id AS VARCHAR(20)) || '.'
         || (['py', 'java', 'c', 'cpp', 'ts', 'md'])[CAST(doc_id % 6 AS INTEGER) + 1] AS path,
       source AS root, CAST(1704067200 + doc_id * 3600 AS BIGINT) AS mtime,
       n_chars AS size, text AS content
FROM documents""",
    "fx_patch": f"""
SELECT doc_id, lang,
  'diff --git a/' || f1 || ' b/' || f1 || {_NL} || '--- a/' || f1 || {_NL} || '+++ b/' || f1 || {_NL}
  || '@@ -1,3 +1,3 @@' || {_NL} || ' ctx = 0' || {_NL} || '-old = 1' || {_NL} || '+' || word
  || ' = 1  # note' || {_NL} || {_NL} || '+# added' || {_NL}
  || 'diff --git a/tests/test_m.py b/tests/test_m.py' || {_NL} || '--- a/tests/test_m.py' || {_NL}
  || '+++ b/tests/test_m.py' || {_NL} || '@@ -1 +1 @@' || {_NL} || '-x = 0' || {_NL} || '+' || word
  || ' = 2' || {_NL} AS patch
FROM (SELECT doc_id, lang, {_W} AS word,
             CASE lang WHEN 'en' THEN 'src/' WHEN 'de' THEN 'pkg/testing/' ELSE 'lib/' END || 'm.py' AS f1
      FROM documents)""",
    "fx_json": "SELECT event_id AS doc_id, props AS doc FROM events",
    "fx_replies": f"""
SELECT event_id AS reply_id, user_id AS run_id,
       '[' || CAST({_K} AS VARCHAR(20)) || ', 3, 17, ' || CAST({_K} AS VARCHAR(20)) || ', 99999999999999' AS index_reply,
       CASE WHEN event_type = 'error' THEN 'no decision'
            ELSE '### Status: succeed' || {_NL} || '### Result: Patch-' || CAST({_K} % 7 AS VARCHAR(20))
                 || {_NL} || '### Analysis: ok' END AS select_reply,
       CASE event_type WHEN 'click' THEN '<tags>THINK</tags>'
                       WHEN 'view' THEN '<tags>WRITE_FIX, VERIFY_FIX</tags>'
                       WHEN 'error' THEN '<tags>WRITE_FIX,BOGUS</tags>'
                       WHEN 'purchase' THEN '<tags></tags>'
                       ELSE 'no tags here' END AS tag_reply
FROM events""",
    "fx_thoughts": """
SELECT conv_id AS session_id, turn AS pos, text AS thought, turn AS thought_number,
       CAST(3 AS BIGINT) AS total_thoughts, role <> 'assistant' AS next_thought_needed,
       CAST(CASE WHEN turn % 3 = 2 THEN turn - 1 ELSE 0 END AS BIGINT) AS branch_from_thought,
       CASE WHEN turn % 2 = 0 THEN 'b' || CAST(turn % 4 AS VARCHAR(20)) END AS branch_id
FROM conversations""",
}

FIXTURES = {
    "fx_steps": fx_steps, "fx_messages": fx_messages, "fx_candidates": fx_candidates,
    "fx_votes": fx_votes, "fx_stats": fx_stats, "fx_log": fx_log, "fx_status": fx_status,
    "fx_spans": fx_spans, "fx_files": fx_files, "fx_patch": fx_patch, "fx_json": fx_json,
    "fx_replies": fx_replies, "fx_thoughts": fx_thoughts,
}


def fx_prefix(*names: str) -> str:
    """``WITH`` clause defining the fixture views an oracle query reads; more
    CTEs can follow after a comma."""
    return "WITH " + ",\n".join(f"{n} AS ({FX_SQL[n].strip()})" for n in names)


def with_fx(body: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the fixture views it reads."""
    if not names:
        return body.strip()
    return f"{fx_prefix(*names)}\n{body.strip()}"
