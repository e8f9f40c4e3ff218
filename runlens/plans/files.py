"""Queries over files: records made from the driver tables are written to the
shared folder and read back by the real readers, malformed records included."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators import testlogs as T
from ..operators.flatten import flatten_trajectories, read_flat, write_flat
from ..session import checkpoint_path
from ..sinks import manifest as M
from ..sinks import writers as W
from ..sources import readers as R
from ..sources.named import write_named_files
from ..sources.fixtures import fx_candidates, fx_log, fx_stats, with_fx
from ..sources.tables import table
from .selection import _GROUP_STATS_SQL


def _place(spark, name: str) -> str:
    return checkpoint_path(spark, f"files-{name}-{uuid.uuid4().hex[:12]}")


def _one_file_each(df: DataFrame, path: str, *by: str) -> str:
    """One JSON or text file for each row; ``by`` names its folder."""
    named = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in by], F.lit("record.json"))
    write_named_files(df.select(named.alias("name"), F.col("value").alias("content")), path)
    return path


def _folder_id(name: str):
    return F.regexp_extract("run_id", f"/{name}=([^/]+)/", 1).cast("bigint")


def _trajectories(spark, d) -> DataFrame:
    """A trajectory per conversation, the agent's turns as steps; every ninth
    file is caught half written."""
    c = table(spark, d, "conversations")
    step = F.struct(F.col("turn").cast("int").alias("step_number"), F.col("role").alias("state"),
                    F.struct(F.col("text").alias("content"), F.struct(F.length("text").cast("bigint").alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage")).alias("llm_response"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("turn", step.alias("s")))), lambda x: x["s"])
    t = c.groupBy("conv_id").agg(steps.alias("agent_steps")).select("conv_id", F.to_json(F.struct(
        F.concat(F.lit("task "), F.col("conv_id").cast("string")).alias("task"), F.lit("p").alias("provider"), F.lit("m").alias("model"),
        F.size("agent_steps").alias("max_steps"), "agent_steps", (F.col("conv_id") % 2 == 0).alias("success"))).alias("value"))
    half = F.expr("substring(value, 1, cast(length(value) / 2 as int))")
    t = t.withColumn("value", F.when(F.col("conv_id") % 9 == 4, half).otherwise(F.col("value")))
    return R.read_trajectories(spark, _one_file_each(t, _place(spark, "trajectories"), "conv_id"), listing="tasks")


def q_read_trajectories(spark, d):
    t = _trajectories(spark, d)
    size = F.coalesce(F.size("agent_steps"), F.lit(0)).cast("bigint")
    return t.select(_folder_id("conv_id").alias("conv_id"), "task", "success", size.alias("steps"), F.col("_bad").isNotNull().alias("bad"))


def q_flatten_trajectories(spark, d):
    s = flatten_trajectories(_trajectories(spark, d))["steps"]
    return s.select(_folder_id("conv_id").alias("conv_id"), F.col("step_pos").cast("bigint").alias("step_pos"), F.col("step_number").cast("bigint").alias("step_number"),
                    "state", "content", "input_tokens", "output_tokens")


def _full_trajectories(spark, d) -> DataFrame:
    """A trajectory per conversation with every nested field: the assistant's
    turns as interactions, all turns as steps, tool calls and their results
    on every third turn; every ninth file is caught half written."""
    c = table(spark, d, "conversations")
    turn, long = F.col("turn"), F.col("turn").cast("bigint")
    some = turn % 3 == 1
    call = F.struct(F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), F.col("role").alias("name"), F.concat(F.lit('{"n": '), turn.cast("string"), F.lit("}")).alias("arguments"), F.lit("i").alias("id"))
    result = F.struct(F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), (turn % 2 == 0).alias("success"), F.col("text").alias("result"), turn.cast("int").alias("exit_code"),
                      (long * 1000000000).alias("started_at_ns"), (long * 1500000000).alias("ended_at_ns"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    usage = F.struct(F.length("text").cast("bigint").alias("input_tokens"), long.alias("output_tokens"), F.lit(3).cast("bigint").alias("reasoning_tokens"))
    inter = F.struct((turn / 4).cast("double").alias("latency_s"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.array(message("user", F.col("text")), message("tool", turn.cast("string"))).alias("input_messages"),
                     F.struct(F.concat(F.lit("r"), turn.cast("string")).alias("response_id"), F.col("text").alias("content"), F.lit("stop").alias("finish_reason"), usage.alias("usage"), F.when(some, F.array(call, call)).alias("tool_calls")).alias("response"),
                     F.array(F.lit("a"), F.lit("b")).alias("tools_available"), F.struct(F.lit("e").alias("endpoint_api"), F.when(some, F.col("text")).alias("body")).alias("wire_request"))
    step = F.struct(turn.cast("int").alias("step_number"), F.col("role").alias("state"), F.struct(F.col("text").alias("content"), F.struct(F.length("text").cast("bigint").alias("input_tokens"), long.alias("output_tokens")).alias("usage")).alias("llm_response"),
                    F.when(some, F.array(call)).alias("tool_calls"), F.when(some, F.array(result)).alias("tool_results"), F.when(turn % 4 == 0, F.lit("why")).alias("reflection"))
    in_order = lambda rows: F.transform(F.array_sort(rows), lambda x: x["s"])
    t = c.groupBy("conv_id").agg(in_order(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", inter.alias("s"))))).alias("llm_interactions"),
                                 in_order(F.collect_list(F.struct("turn", step.alias("s")))).alias("agent_steps"))
    t = t.select("conv_id", F.to_json(F.struct(F.lit("t").alias("task"), F.lit("2024-05-01T10:00:00").alias("start_time"), F.when(F.col("conv_id") % 2 == 0, "2024-05-01T10:30:00").otherwise("").alias("end_time"),
                                               F.lit("p").alias("provider"), F.lit("m").alias("model"), F.size("agent_steps").alias("max_steps"), "llm_interactions", "agent_steps", (F.col("conv_id") % 3 == 0).alias("success"))).alias("value"))
    half = F.expr("substring(value, 1, cast(length(value) / 2 as int))")
    t = t.withColumn("value", F.when(F.col("conv_id") % 9 == 4, half).otherwise(F.col("value")))
    return R.read_trajectories(spark, _one_file_each(t, _place(spark, "trajectories"), "conv_id"), listing="tasks")


def _flat(name: str, *columns: str):
    """The query of one of the seven tables, out of one pass over the files."""
    def query(spark, d):
        path = _place(spark, "flat")
        write_flat(_full_trajectories(spark, d), path)
        out = read_flat(spark, path)[name]
        kept = [F.col(c).cast("bigint").alias(c) if c.endswith(("_pos", "step_number", "exit_code")) or c.startswith(("n_", "max_")) else F.col(c) for c in columns]
        return out.select(_folder_id("conv_id").alias("conv_id"), *kept)
    return query


def _candidate_lines(spark, d) -> DataFrame:
    """Candidate sets as JSON lines, each instance twice (the second line
    counts), and a broken line for every tenth."""
    c = fx_candidates(spark, d)
    rows = F.array_sort(F.collect_list(F.struct("idx", "patch", F.col("success_id").cast("int").alias("label"))))
    sets = c.groupBy("instance_id").agg(rows.alias("r"))
    line = lambda issue: F.to_json(F.struct(F.col("instance_id").cast("string").alias("instance_id"), issue.alias("issue"),
                                            F.col("r.patch").alias("patches"), F.col("r.label").alias("success_id")))
    old, new = line(F.lit("old")), line(F.lit("new"))
    broken = F.when(F.col("instance_id") % 10 == 0, F.concat(F.lit('{"instance_id": '), F.col("instance_id").cast("string")))
    return sets.select("instance_id", F.explode(F.filter(F.array(old, F.lit(""), new, broken), lambda x: x.isNotNull())).alias("value")).select("value")


def q_read_candidates(spark, d):
    path = _place(spark, "candidates")
    _candidate_lines(spark, d).write.text(path)
    r = R.read_candidates(spark, path)
    empty = F.coalesce(F.forall("regressions", lambda x: F.size(x) == 0), F.lit(False))
    return r.select(F.col("instance_id").try_cast("bigint").alias("instance_id"), "issue", F.coalesce(F.size("patches"), F.lit(0)).cast("bigint").alias("patches"),
                    F.aggregate(F.coalesce("success_id", F.array()), F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"), empty.alias("no_regressions"), F.col("_bad").alias("bad"))


def q_read_instances(spark, d):
    path = _place(spark, "instances")
    c = table(spark, d, "customer")
    row = F.to_json(F.struct(F.when(F.col("c_custkey") % 8 != 0, F.col("c_custkey").cast("string")).alias("instance_id"), F.col("c_mktsegment").alias("org"), F.col("c_custkey").alias("number"),
                             F.to_json(F.array(F.col("c_name"), F.lit("t2"))).alias("PASS_TO_PASS")))
    c.select(F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("!"), row)).when(F.col("c_custkey") % 13 == 0, F.lit("  ")).otherwise(row).alias("value")).write.text(path)
    r = R.read_instances(spark, path)
    tests = R.pass_to_pass(r).groupBy("instance_id").agg(F.count(F.lit(1)).alias("tests"))
    # a malformed line has no fields that count
    good = r.where(F.col("_bad").isNull()).join(tests, "instance_id", "left").select(
        F.col("instance_id").cast("bigint").alias("instance_id"), "org", "number", "tests", F.lit(False).alias("bad"))
    return good.unionByName(r.where(F.col("_bad").isNotNull()).select(
        F.lit(None).cast("bigint").alias("instance_id"), F.lit(None).cast("string").alias("org"), F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("bigint").alias("tests"), F.lit(True).alias("bad")))


def q_read_selection_stats(spark, d):
    """A file per record; every seventh has a text for a number."""
    path = _place(spark, "statistics")
    label = F.when(F.col("instance_id") % 7 == 0, F.lit('"x"')).otherwise(F.col("is_success").cast("string"))
    record = F.struct(F.col("instance_id").cast("string").alias("instance_id"), F.lit(0).alias("patch_id"), F.parse_json(label).alias("is_success"), "is_all_success", "is_all_failed")
    rows = fx_stats(spark, d).select(F.col("group_id").alias("group_of"), F.col("instance_id").alias("of"), F.to_json(record).alias("value"))
    r = R.read_selection_stats(spark, _one_file_each(rows, path, "group_of", "of"), listing="tasks")
    return r.groupBy("group_id").agg(F.count_if(F.col("_bad").isNull()).alias("read"), F.count_if(F.col("_bad").isNotNull()).alias("bad"),
                                     F.count_if(F.col("is_success") == 1).alias("right"))


def q_read_run_timings(spark, d):
    path = _place(spark, "timings")
    e = table(spark, d, "events")
    row = F.to_json(F.struct(F.col("value").alias("wall_s"), F.col("user_id").cast("string").alias("instance_id"), F.col("event_type").alias("phase"),
                             F.when(F.col("event_type") == "signup", F.lit("create")).alias("stage"), F.lit(0).alias("exit_code")))
    e.select(F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("!"), row)).otherwise(row).alias("value")).write.text(path)
    r = R.read_run_timings(spark, path)
    return r.select("instance_id", "phase", "record", "wall_s", F.col("_bad").isNotNull().alias("bad"))


def q_read_log_lines(spark, d):
    """Logs as files with every kind of line end, read back line by line."""
    lg = fx_log(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(
        x["line"], F.element_at(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\r"), F.lit("\u2028")), (x["line_no"] % 4 + 1).cast("int")))), "")
    path = _place(spark, "logs")
    _one_file_each(lg.groupBy("log_id").agg(text.alias("value")), path, "log_id")
    out = T.read_log_lines(spark, path, listing="tasks")
    # a log without an id has no folder; it is not read, as partition discovery passes over it
    out = out.where(F.contains("log_id", F.lit("/log_id=")) & (F.col("line") != ""))
    return out.select(F.regexp_extract("log_id", "/log_id=([^/]+)/", 1).cast("bigint").alias("log_id"), "line_no", "line")


def q_collect_patches(spark, d):
    """A patch file in a folder of its own for each document; those of the
    labelled ids are wanted, of which some have none."""
    path = _place(spark, "patches")
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    write_named_files(t.select(F.concat("id", F.lit("/"), "id", F.lit(".patch")).alias("name"), F.col("text").alias("content")), path)
    wanted = table(spark, d, "labels").select(F.explode(F.array(F.col("doc_id").cast("string"), F.concat(F.lit("none-"), F.col("doc_id").cast("string")))).alias("instance_id"))
    return R.collect_patches(spark, path, wanted, "m", listing="tasks").select("instance_id", "model_name_or_path", F.md5("model_patch").alias("patch_md5"))


def q_selected_patches(spark, d):
    """Patches picked in two rounds, each written under the next free trial
    numbers, and read back from their files."""
    path = _place(spark, "selected")
    c = fx_candidates(spark, d).select((F.col("instance_id") % 5).cast("string").alias("group_id"), F.concat(F.lit("i_"), F.col("instance_id").cast("string")).alias("instance_id"), "idx", "patch")
    W.write_patch_files(spark, c.where(F.col("idx") % 2 == 0), path)
    W.write_patch_files(spark, c.where(F.col("idx") % 2 == 1), path)
    return R.read_selected_patches(spark, path).select("group_id", "instance_id", "trial", F.md5("patch").alias("patch_md5"))


def q_write_predictions(spark, d):
    path = _place(spark, "predictions")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("instance_id"), F.lit("m").alias("model_name_or_path"),
                                         F.concat(F.lit("--- a\n+++ \""), F.col("o_orderpriority")).alias("model_patch"))
    W.write_predictions(o, path)
    return spark.read.schema(o.schema).json(path)


def q_append_attempts(spark, d):
    """Four attempts of one resumable output: half of the orders, some of them
    unfinished; an attempt that dies before it is visible; all orders; and the
    first attempt once more with other rows."""
    path = _place(spark, "attempts")
    schema = "instance_id string, regression_done boolean, price double"
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("instance_id"), (F.col("o_orderstatus") != "O").alias("regression_done"), F.col("o_totalprice").alias("price"))
    finished = F.col("regression_done")
    M.append_attempt(spark, o.where(F.col("instance_id").cast("long") % 2 == 0), path, schema, "a", complete=finished)
    o.withColumn("price", F.lit(-1.0)).write.json(f"{path}/{M.ROWS}/dead")
    M.append_attempt(spark, o, path, schema, "b", complete=finished)
    M.append_attempt(spark, o.withColumn("price", F.lit(-2.0)), path, schema, "a", complete=finished)
    return M.read_committed(spark, path, schema)


def q_write_group_report(spark, d):
    path = _place(spark, "report")
    W.write_group_report(S.best_group(S.group_statistics(fx_stats(spark, d))), path)
    return spark.read.option("header", True).csv(path).select("group_id", F.col("total").cast("bigint").alias("total"), F.col("success_selection").cast("bigint").alias("success_selection"))


QUERIES = {
    "read_trajectories": q_read_trajectories,
    "flatten_trajectories": q_flatten_trajectories,
    "flat_runs": _flat("runs", "task", "start_time", "end_time", "provider", "model", "max_steps", "success", "final_result", "n_steps", "n_interactions"),
    "flat_interactions": _flat("interactions", "interaction_pos", "latency_s", "provider", "model", "response_id", "content", "finish_reason", "input_tokens", "output_tokens",
                               "cache_read_input_tokens", "reasoning_tokens", "tools_available", "wire_request.body"),
    "flat_messages": _flat("messages", "interaction_pos", "message_pos", "role", "content"),
    "flat_response_tool_calls": _flat("response_tool_calls", "interaction_pos", "call_pos", "call_id", "name", "arguments", "id"),
    "flat_steps": _flat("steps", "step_pos", "step_number", "state", "content", "input_tokens", "output_tokens", "reflection", "error"),
    "flat_step_tool_calls": _flat("step_tool_calls", "step_pos", "step_number", "call_pos", "call_id", "name", "arguments"),
    "flat_step_tool_results": _flat("step_tool_results", "step_pos", "step_number", "result_pos", "call_id", "success", "result", "exit_code", "duration_s"),
    "read_candidates": q_read_candidates,
    "read_instances": q_read_instances,
    "read_selection_stats": q_read_selection_stats,
    "read_run_timings": q_read_run_timings,
    "read_log_lines": q_read_log_lines,
    "collect_patches": q_collect_patches,
    "selected_patches": q_selected_patches,
    "append_attempts": q_append_attempts,
    "write_predictions": q_write_predictions,
    "write_group_report": q_write_group_report,
}

_TURNS = """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_pos FROM conversations WHERE conv_id % 9 <> 4),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM s WHERE role = 'assistant')"""
ORACLE = {
    "read_trajectories": """
SELECT conv_id, CASE WHEN conv_id % 9 <> 4 THEN 'task ' || CAST(conv_id AS VARCHAR) END AS task, CASE WHEN conv_id % 9 <> 4 THEN conv_id % 2 = 0 END AS success,
       CASE WHEN conv_id % 9 <> 4 THEN count(*) ELSE 0 END AS steps, conv_id % 9 = 4 AS bad
FROM conversations GROUP BY conv_id""",
    "flatten_trajectories": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_pos, turn AS step_number, role AS state, text AS content,
       length(text) AS input_tokens, turn AS output_tokens
FROM conversations WHERE conv_id % 9 <> 4""",
    "flat_runs": """
SELECT conv_id, 't' AS task, TIMESTAMP '2024-05-01 10:00:00' AS start_time, CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP '2024-05-01 10:30:00' END AS end_time, 'p' AS provider, 'm' AS model,
       count(*) AS max_steps, conv_id % 3 = 0 AS success, CAST(NULL AS VARCHAR) AS final_result, count(*) AS n_steps, count(*) FILTER (role = 'assistant') AS n_interactions
FROM conversations WHERE conv_id % 9 <> 4 GROUP BY conv_id""",
    "flat_interactions": _TURNS + """
SELECT conv_id, pos AS interaction_pos, turn / 4 AS latency_s, 'p' AS provider, 'm' AS model, 'r' || turn AS response_id, text AS content, 'stop' AS finish_reason, length(text) AS input_tokens,
       turn AS output_tokens, CAST(NULL AS BIGINT) AS cache_read_input_tokens, 3 AS reasoning_tokens, ['a', 'b'] AS tools_available, CASE WHEN turn % 3 = 1 THEN text END AS body FROM i""",
    "flat_messages": _TURNS + """
SELECT conv_id, pos AS interaction_pos, 0 AS message_pos, 'user' AS role, text AS content FROM i
UNION ALL SELECT conv_id, pos, 1, 'tool', CAST(turn AS VARCHAR) FROM i""",
    "flat_response_tool_calls": _TURNS + """
SELECT conv_id, pos AS interaction_pos, call_pos, 'c' || turn AS call_id, role AS name, '{"n": ' || turn || '}' AS arguments, 'i' AS id
FROM i, (SELECT unnest([0, 1]) AS call_pos) WHERE turn % 3 = 1""",
    "flat_steps": _TURNS + """
SELECT conv_id, step_pos, turn AS step_number, role AS state, text AS content, length(text) AS input_tokens, turn AS output_tokens, CASE WHEN turn % 4 = 0 THEN 'why' END AS reflection, CAST(NULL AS VARCHAR) AS error FROM s""",
    "flat_step_tool_calls": _TURNS + """
SELECT conv_id, step_pos, turn AS step_number, 0 AS call_pos, 'c' || turn AS call_id, role AS name, '{"n": ' || turn || '}' AS arguments FROM s WHERE turn % 3 = 1""",
    "flat_step_tool_results": _TURNS + """
SELECT conv_id, step_pos, turn AS step_number, 0 AS result_pos, 'c' || turn AS call_id, turn % 2 = 0 AS success, text AS result, turn AS exit_code, turn * 0.5::DOUBLE AS duration_s FROM s WHERE turn % 3 = 1""",
    "read_candidates": with_fx("""
SELECT instance_id, 'new' AS issue, count(*) AS patches, CAST(sum(success_id) AS BIGINT) AS labels, true AS no_regressions, NULL AS bad
FROM fx_candidates GROUP BY instance_id
UNION ALL
SELECT DISTINCT NULL, NULL, 0, 0, false, '{"instance_id": ' || CAST(instance_id AS VARCHAR) FROM fx_candidates WHERE instance_id % 10 = 0""", "fx_candidates"),
    "read_instances": """
SELECT c_custkey AS instance_id, c_mktsegment AS org, c_custkey AS number, 2 AS tests, false AS bad
FROM customer WHERE c_custkey % 8 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM customer WHERE c_custkey % 11 = 0""",
    "read_selection_stats": with_fx("""
SELECT 'group_of=' || group_id AS group_id, count(*) FILTER (WHERE instance_id % 7 <> 0) AS read, count(*) FILTER (WHERE instance_id % 7 = 0) AS bad,
       count(*) FILTER (WHERE instance_id % 7 <> 0 AND is_success = 1) AS "right"
FROM fx_stats GROUP BY group_id""", "fx_stats"),
    "read_run_timings": """
SELECT CASE WHEN event_id % 17 <> 0 THEN CAST(user_id AS VARCHAR) END AS instance_id, CASE WHEN event_id % 17 <> 0 THEN event_type END AS phase,
       CASE WHEN event_id % 17 <> 0 AND event_type = 'signup' THEN 'container' ELSE 'test_run' END AS record,
       CASE WHEN event_id % 17 <> 0 THEN value END AS wall_s, event_id % 17 = 0 AS bad
FROM events""",
    "read_log_lines": with_fx("SELECT log_id, line_no, line FROM fx_log WHERE line <> ''", "fx_log"),
    "collect_patches": """
SELECT CAST(doc_id AS VARCHAR) AS instance_id, 'm' AS model_name_or_path, md5(text) AS patch_md5 FROM documents SEMI JOIN labels USING (doc_id)""",
    "selected_patches": with_fx("""
SELECT CAST(instance_id % 5 AS VARCHAR) AS group_id, 'i_' || CAST(instance_id AS VARCHAR) AS instance_id,
       row_number() OVER (PARTITION BY instance_id ORDER BY idx % 2, idx) AS trial, md5(patch) AS patch_md5
FROM fx_candidates""", "fx_candidates"),
    "append_attempts": """
SELECT CAST(o_orderkey AS VARCHAR) AS instance_id, o_orderstatus <> 'O' AS regression_done, o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderstatus <> 'O', o_totalprice FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderstatus <> 'O')""",
    "write_predictions": """
SELECT CAST(o_orderkey AS VARCHAR) AS instance_id, 'm' AS model_name_or_path, '--- a' || chr(10) || '+++ "' || o_orderpriority AS model_patch FROM orders""",
    "write_group_report": with_fx("SELECT group_id, total, success_selection FROM (" + _GROUP_STATS_SQL.format(src="fx_stats") + ")", "fx_stats"),
}
