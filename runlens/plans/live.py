"""Streaming twins of the batch aggregates, run to completion with an
``availableNow`` trigger over the driver tables read as file streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_path
from ..streaming import live as L


def _src(spark, d, name):
    path = f"{d.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a file stream watches a folder; the glob picks this table's file(s)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", f"{name}.parquet").parquet(d.rstrip("/")))


def _run(spark, start, name, view):
    out = checkpoint_path(spark, f"out-{name}-{uuid.uuid4().hex[:8]}")
    q = start(out)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return view(out)


def q_stream_test_status(spark, d):
    li = _src(spark, d, "lineitem")
    st = li.select(
        F.col("l_suppkey").alias("instance_id"),
        F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("test"),
        F.when(F.col("l_linestatus") == "O", "find_passing").otherwise("validate").alias("phase"),
        F.when(F.col("l_returnflag") == "R", "PASSED").when(F.col("l_returnflag") == "N", "FAILED")
         .otherwise("ERROR").alias("status"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag").alias("seq"))
    name = f"test_status_{uuid.uuid4().hex[:8]}"
    return _run(spark, lambda out: L.stream_test_status(spark, st, out, name=name), name,
                lambda out: L.status_view(spark, out))


def q_stream_status_lines(spark, d):
    """R01 from raw output: streamed ``<STATUS> <nodeid>`` lines (plus noise
    lines), parsed and reduced to the latest status per (log, test)."""
    ev = _src(spark, d, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') AS INT)").cast("string")
    et = F.col("event_type")
    status = (F.when(et == "click", "PASSED").when(et == "view", "SKIPPED")
              .when(et == "error", "FAILED").otherwise("ERROR"))
    node = F.concat(F.lit("tests/m"), (F.col("user_id") % 7).cast("string"), F.lit("/test_x.py::test_k"), k)
    line = F.when(et == "signup", F.concat(F.lit("collected "), k, F.lit(" items"))).otherwise(
        F.concat(status, F.lit(" "), node))
    lines = ev.select(F.col("user_id").alias("log_id"), line.alias("line"),
                      F.struct("ts", "event_id").alias("seq"))
    name = f"status_lines_{uuid.uuid4().hex[:8]}"
    return _run(spark, lambda out: L.stream_test_status(spark, L.status_from_lines(lines), out, name=name,
                                                        keys=("log_id", "test")), name,
                lambda out: L.status_view(spark, out, ["log_id", "test"]))


def q_stream_token_totals(spark, d):
    ev = _src(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("input_tokens"),
        F.floor("value").cast("bigint").alias("output_tokens"))
    name = f"token_totals_{uuid.uuid4().hex[:8]}"
    return _run(spark, lambda out: L.stream_token_totals(spark, ev, out, name=name), name,
                lambda out: L.latest_view(spark, out, ["run_id"]))


def q_stream_majority_vote(spark, d):
    votes = _src(spark, d, "orders").select(
        F.col("o_custkey").alias("ballot"), F.col("o_orderpriority").alias("voted"),
        F.col("o_orderkey").alias("vote_idx"))
    ballots = (spark.read.parquet(f"{d.rstrip('/')}/orders.parquet").groupBy(F.col("o_custkey").alias("ballot"))
               .agg(F.count(F.lit(1)).alias("n")))
    name = f"majority_vote_{uuid.uuid4().hex[:8]}"
    return _run(spark, lambda out: L.stream_majority_vote(spark, votes, ballots, out, name=name), name,
                lambda out: L.vote_decisions(spark, out))


def q_stream_pending(spark, d):
    c = _src(spark, d, "orders").select(F.col("o_custkey").alias("instance_id"))
    name = f"pending_{uuid.uuid4().hex[:8]}"
    return _run(spark, lambda out: L.stream_pending(spark, c, out, name=name), name,
                lambda out: spark.read.parquet(out).select("instance_id"))


def q_stream_pending_by_time(spark, d):
    """R04 with an event time: repeats go in the state store while their key is
    there, other keys are looked up in the log.  Order dates span less than the
    lateness, so no row is late, however many files the table has."""
    c = _src(spark, d, "orders").select(F.col("o_custkey").alias("instance_id"),
                                        F.col("o_orderdate").cast("timestamp").alias("at"))
    name = f"pending_by_time_{uuid.uuid4().hex[:8]}"
    return _run(spark, lambda out: L.stream_pending(spark, c, out, name=name, event_time="at", lateness="4000 days"), name,
                lambda out: spark.read.parquet(out).select("instance_id"))


QUERIES = {
    "stream_test_status": q_stream_test_status,
    "stream_status_lines": q_stream_status_lines,
    "stream_token_totals": q_stream_token_totals,
    "stream_majority_vote": q_stream_majority_vote,
    "stream_pending": q_stream_pending,
    "stream_pending_by_time": q_stream_pending_by_time,
}

_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
ORACLE = {
    "stream_test_status": """
SELECT instance_id, phase, test, status FROM (
  SELECT l_suppkey AS instance_id, 't' || CAST(l_partkey AS VARCHAR(20)) AS test,
         CASE WHEN l_linestatus = 'O' THEN 'find_passing' ELSE 'validate' END AS phase,
         CASE l_returnflag WHEN 'R' THEN 'PASSED' WHEN 'N' THEN 'FAILED' ELSE 'ERROR' END AS status,
         row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_linestatus = 'O'
                            ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC,
                                     l_returnflag DESC) AS r
  FROM lineitem) WHERE r = 1""",
    "stream_status_lines": f"""
SELECT log_id, test, status FROM (
  SELECT user_id AS log_id,
         'tests/m' || CAST(user_id % 7 AS VARCHAR) || '/test_x.py::test_k' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS test,
         CASE event_type WHEN 'click' THEN 'PASSED' WHEN 'view' THEN 'SKIPPED' WHEN 'error' THEN 'FAILED'
                         ELSE 'ERROR' END AS status,
         row_number() OVER (PARTITION BY user_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)
                            ORDER BY ts DESC, event_id DESC) AS r
  FROM events WHERE event_type <> 'signup') WHERE r = 1""",
    "stream_token_totals": f"""
SELECT user_id AS run_id, CAST(sum({_K}) AS BIGINT) AS input_tokens,
       CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS output_tokens
FROM events GROUP BY user_id""",
    "stream_majority_vote": """
WITH c AS (SELECT o_custkey AS ballot, o_orderpriority AS voted, count(*) AS cnt, min(o_orderkey) AS first_idx
           FROM orders GROUP BY 1, 2)
SELECT ballot, voted AS winner FROM (
  SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY cnt DESC, first_idx) AS r FROM c) WHERE r = 1""",
    "stream_pending": "SELECT DISTINCT o_custkey AS instance_id FROM orders",
    "stream_pending_by_time": "SELECT DISTINCT o_custkey AS instance_id FROM orders",
}
