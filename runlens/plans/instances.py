"""Queries over instances, predictions, JSON documents and build statuses
(customer, orders, part, events, fx_json, fx_candidates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonpath as J
from ..operators import candidates as C
from ..operators import instances as I
from ..operators import stats as S
from ..sources.fixtures import fx_candidates, fx_json, fx_prefix, with_fx
from ..sources.tables import table

_REPOS = ["django/django", "sympy/sympy"] + I.PYTEST_REPOS


def _instances(spark, d):
    c = table(spark, d, "customer")
    repo = F.element_at(F.array(*[F.lit(r) for r in _REPOS]), (F.col("c_custkey") % 12 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("instance_id"), repo.alias("repo"),
                    F.col("c_mktsegment").alias("org"), F.col("c_nationkey").cast("bigint").alias("number"))


def q_join_issue_text(spark, d):
    p = table(spark, d, "part")
    issues = F.array(F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("body")),
                     F.struct(F.col("p_brand").alias("title"), F.lit(None).cast("string").alias("body")))
    return p.select("p_partkey", I.join_issue_text(issues).alias("problem_statement"))


def q_repo_subset(spark, d):
    req = table(spark, d, "orders").select(F.col("o_custkey").alias("instance_id"))
    return I.repo_subset(_instances(spark, d), requested=req).select("instance_id", "repo")


def q_submission_join(spark, d):
    preds = table(spark, d, "orders").select(
        F.col("o_custkey").alias("instance_id"),
        F.concat(F.lit("patch "), F.col("o_orderkey").cast("string")).alias("model_patch"))
    # predictions by supplier key too: beyond the last customer they find no
    # instance and keep nulls
    more = table(spark, d, "lineitem").select(
        (F.col("l_partkey") + F.col("l_suppkey")).alias("instance_id"),
        F.concat(F.lit("patch "), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("model_patch"))
    return I.submission_join(preds.unionByName(more), _instances(spark, d))


def q_instances_with_candidates(spark, d):
    return C.instances_with_candidates(_instances(spark, d), fx_candidates(spark, d)).select("instance_id", "idx", "repo")


def q_candidates_passthrough(spark, d):
    # suppliers are the known instances: customers beyond them pass through
    inst = table(spark, d, "supplier").select(F.col("s_suppkey").alias("instance_id"))
    return C.instances_with_candidates(inst, fx_candidates(spark, d), passthrough=True).select(
        "instance_id", "idx", "supported")


def q_pending_instances(spark, d):
    done = fx_candidates(spark, d).groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_patches"))
    return C.pending_instances(_instances(spark, d), done, complete=F.col("n_patches") >= 10).select(
        "instance_id")


def q_trial_numbers(spark, d):
    # earlier trials of a (group, instance): the in-group positions of its
    # failing candidates (so the used numbers have gaps); new outputs: the rest
    c = fx_candidates(spark, d).withColumn("group_id", F.col("grp"))
    existing = c.where(~F.col("ok")).select("group_id", "instance_id",
                                            (F.col("idx") - F.col("grp") * 4 + 1).alias("trial"))
    return I.next_trial_numbers(c.where("ok"), existing).select("group_id", "instance_id", "idx", "trial")


def _build_status(spark, d):
    ev = table(spark, d, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') AS INT)").cast("string")
    et = F.col("event_type")
    st = (F.when(et == "click", "built").when(et == "view", "exists")
          .when(et == "error", F.concat(F.lit("error(exit "), k, F.lit("): boom")))
          .when(et == "purchase", F.concat(F.lit("failed: exit "), k))
          .otherwise(F.lit("skipped: no tests")))
    return ev.select(F.col("event_id").alias("instance_id"), st.alias("status"))


def q_status_histogram(spark, d):
    return S.status_histogram(_build_status(spark, d), "status", "instance_id")


def q_fallback_items(spark, d):
    return S.fallback_items(_build_status(spark, d), "status", "instance_id")


def q_status_items(spark, d):
    return S.status_items(_build_status(spark, d), "status", "instance_id")


def q_json_view(spark, d):
    j = J.with_json_view(fx_json(spark, d), "doc", "$.k", "value")
    return J.with_json_view(j, "doc", "$.missing", "missing").select("doc_id", "value", "missing")


def q_json_view_recursive(spark, d):
    return J.with_json_view(fx_json(spark, d), "doc", "$..k", "value").select("doc_id", "value")


def q_json_set(spark, d):
    j = fx_json(spark, d).withColumn("r", J.json_set(F.col("doc"), F.lit("$.k"), F.lit("0")))
    return j.select("doc_id", F.col("r.doc").alias("doc"), F.col("r.matches").alias("matches"),
                    F.col("r.error").alias("error"))


def q_json_add(spark, d):
    j = fx_json(spark, d).withColumn("r", J.json_add(F.col("doc"), F.lit("$.seen"), F.lit("true")))
    return j.select("doc_id", F.col("r.doc").alias("doc"), F.col("r.error").alias("error"))


def q_json_remove(spark, d):
    j = fx_json(spark, d).withColumn("r", J.json_remove(F.col("doc"), F.lit("$.k")))
    return j.select("doc_id", F.col("r.doc").alias("doc"), F.col("r.matches").alias("matches"),
                    F.col("r.error").alias("error"))


QUERIES = {
    "join_issue_text": q_join_issue_text,
    "repo_subset": q_repo_subset,
    "submission_join": q_submission_join,
    "instances_with_candidates": q_instances_with_candidates,
    "candidates_passthrough": q_candidates_passthrough,
    "pending_instances": q_pending_instances,
    "trial_numbers": q_trial_numbers,
    "status_histogram": q_status_histogram,
    "fallback_items": q_fallback_items,
    "status_items": q_status_items,
    "json_view": q_json_view,
    "json_view_recursive": q_json_view_recursive,
    "json_set": q_json_set,
    "json_add": q_json_add,
    "json_remove": q_json_remove,
}

_REPO_LIST = "[" + ", ".join(f"'{r}'" for r in _REPOS) + "]"
_INST = f"""inst AS (SELECT c_custkey AS instance_id, ({_REPO_LIST})[CAST(c_custkey % 12 AS INTEGER) + 1] AS repo,
                 c_mktsegment AS org, CAST(c_nationkey AS BIGINT) AS number FROM customer)"""
_K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"
_BUILD = f"""bs AS (SELECT event_id AS instance_id,
  CASE event_type WHEN 'click' THEN 'built' WHEN 'view' THEN 'exists'
       WHEN 'error' THEN 'error(exit ' || CAST({_K} AS VARCHAR(20)) || '): boom'
       WHEN 'purchase' THEN 'failed: exit ' || CAST({_K} AS VARCHAR(20)) ELSE 'skipped: no tests' END AS status
  FROM events)"""
_PRETTY = ("CASE WHEN {x} = '{{}}' THEN '{{}}' ELSE replace(replace(replace(replace({x}, '{{', '{{' || chr(10) || '  '), "
           "',', ',' || chr(10) || '  '), ':', ': '), '}}', chr(10) || '}}') END")
_PYTEST = "(" + ", ".join(f"'{r}'" for r in I.PYTEST_REPOS) + ")"

ORACLE = {
    "join_issue_text": """
SELECT p_partkey, coalesce(p_name, '') || chr(10) || coalesce(p_type, '') || chr(10) || coalesce(p_brand, '') || chr(10)
       AS problem_statement FROM part""",
    "repo_subset": f"""WITH {_INST}
SELECT instance_id, repo FROM inst WHERE repo IN {_PYTEST}
  AND instance_id IN (SELECT o_custkey FROM orders)""",
    "submission_join": f"""WITH {_INST}
SELECT i.org, i.repo, i.number, 'patch ' || CAST(o.o_orderkey AS VARCHAR(20)) AS fix_patch
FROM orders o LEFT JOIN inst i ON o.o_custkey = i.instance_id
UNION ALL
SELECT i.org, i.repo, i.number, 'patch ' || CAST(l.l_orderkey AS VARCHAR(20)) || '.' || CAST(l.l_linenumber AS VARCHAR(20))
FROM lineitem l LEFT JOIN inst i ON l.l_partkey + l.l_suppkey = i.instance_id""",
    "instances_with_candidates": f"""WITH {_INST}, """ + with_fx("SELECT 1", "fx_candidates")[5:].rsplit("\nSELECT 1", 1)[0]
    + """
SELECT c.instance_id, c.idx, i.repo FROM fx_candidates c JOIN inst i ON c.instance_id = i.instance_id""",
    "candidates_passthrough": f"""WITH {_INST}, """ + with_fx("SELECT 1", "fx_candidates")[5:].rsplit("\nSELECT 1", 1)[0]
    + """
SELECT c.instance_id, c.idx, s.s_suppkey IS NOT NULL AS supported
FROM fx_candidates c LEFT JOIN supplier s ON c.instance_id = s.s_suppkey""",
    "pending_instances": f"""WITH {_INST}
SELECT instance_id FROM inst
WHERE instance_id NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 10)""",
    "trial_numbers": fx_prefix("fx_candidates") + """
, nw AS (SELECT grp, instance_id, idx, row_number() OVER (PARTITION BY grp, instance_id ORDER BY idx) AS r
         FROM fx_candidates WHERE ok),
used AS (SELECT grp, instance_id, idx - grp * 4 + 1 AS t FROM fx_candidates WHERE NOT ok),
sizes AS (SELECT n.grp, n.instance_id, max(n.r) + coalesce(max(u.k), 0) AS m
          FROM nw n LEFT JOIN (SELECT grp, instance_id, count(*) AS k FROM used GROUP BY 1, 2) u
            ON n.grp = u.grp AND n.instance_id = u.instance_id GROUP BY 1, 2, u.k),
cand AS (SELECT grp, instance_id, unnest(range(1, m + 1)) AS t FROM sizes),
free AS (SELECT c.grp, c.instance_id, c.t,
                row_number() OVER (PARTITION BY c.grp, c.instance_id ORDER BY c.t) AS fr
         FROM cand c LEFT JOIN used u ON c.grp = u.grp AND c.instance_id = u.instance_id AND c.t = u.t
         WHERE u.t IS NULL)
SELECT n.grp AS group_id, n.instance_id, n.idx, f.t AS trial
FROM nw n JOIN free f ON n.grp = f.grp AND n.instance_id = f.instance_id AND n.r = f.fr""",
    "status_histogram": f"""WITH {_BUILD}
SELECT prefix, count(*) AS n, count(DISTINCT instance_id) AS n_items,
       row_number() OVER (ORDER BY count(*) DESC, prefix) AS rank
FROM (SELECT *, split_part(split_part(status, '(', 1), ':', 1) AS prefix FROM bs) GROUP BY prefix""",
    "fallback_items": f"""WITH {_BUILD}
SELECT instance_id, status FROM bs WHERE status NOT IN ('built', 'exists')""",
    "status_items": f"""WITH {_BUILD}
SELECT DISTINCT split_part(status, ':', 1) AS prefix, instance_id AS item FROM bs""",
    "json_view": with_fx("""
SELECT doc_id, coalesce(CAST(json_extract(doc, '$.k') AS VARCHAR), 'No matches found for JSONPath: $.k') AS value,
       coalesce(CAST(json_extract(doc, '$.missing') AS VARCHAR), 'No matches found for JSONPath: $.missing') AS missing
FROM fx_json""", "fx_json"),
    # 2-space indented JSON (as the edit tool writes files) from DuckDB's
    # compact JSON: valid here because the documents are flat objects of
    # numbers and booleans (no ':', ',', braces inside strings).
    "json_set": with_fx(f"""
SELECT doc_id,
       CASE WHEN json_extract(doc, '$.k') IS NOT NULL
            THEN {_PRETTY.format(x="CAST(json_merge_patch(doc, '{\"k\":0}') AS VARCHAR)")}
            ELSE doc END AS doc,
       CAST(CASE WHEN json_extract(doc, '$.k') IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS matches,
       CASE WHEN json_extract(doc, '$.k') IS NULL THEN 'No matches found for JSONPath: $.k' END AS error
FROM fx_json""", "fx_json"),
    "json_add": with_fx(f"""
SELECT doc_id, {_PRETTY.format(x="CAST(json_merge_patch(doc, '{\"seen\":true}') AS VARCHAR)")} AS doc,
       CAST(NULL AS VARCHAR) AS error
FROM fx_json""", "fx_json"),
    "json_remove": with_fx(f"""
SELECT doc_id,
       CASE WHEN json_extract(doc, '$.k') IS NOT NULL
            THEN {_PRETTY.format(x="CAST(json_merge_patch(doc, '{\"k\":null}') AS VARCHAR)")}
            ELSE doc END AS doc,
       CAST(CASE WHEN json_extract(doc, '$.k') IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS matches,
       CASE WHEN json_extract(doc, '$.k') IS NULL THEN 'No matches found for JSONPath: $.k' END AS error
FROM fx_json""", "fx_json"),
    "json_view_recursive": with_fx("""
SELECT doc_id, coalesce(CAST(json_extract(doc, '$.k') AS VARCHAR), 'No matches found for JSONPath: $..k') AS value
FROM fx_json""", "fx_json"),
}
