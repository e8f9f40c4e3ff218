"""Queries over agent steps and messages (fx_steps, fx_messages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import messages as M
from ..operators import usage as U
from ..sources.fixtures import fx_messages, fx_steps, with_fx


# Provider client style of a fixture run (run_id % 5).
_STYLES = ["anthropic", "openai", "google", "compatible", "ollama"]


def _raw_usage(steps):
    style = F.element_at(F.array(*[F.lit(s) for s in _STYLES]), (F.col("run_id") % 5 + 1).cast("int"))
    raw = F.when(F.col("tool") != "signup", F.struct(
        F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"),
        (F.col("input_tokens") % 5).alias("cache_creation"),
        (F.col("output_tokens") % 7).alias("cache_read"),
        (F.col("output_tokens") % 3).alias("reasoning")))
    return steps.select("run_id", "step_number", style.alias("style"), raw.alias("raw_usage"))


def q_add_durations(spark, d):
    s = fx_steps(spark, d)
    s = s.select("run_id", "step_number",
                 # epoch of a zone-less timestamp: no session time zone involved
                 (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000)
                 .alias("started_at_ns"),
                 F.col("latency_s"), F.col("success"), F.col("input_tokens"), F.col("output_tokens"))
    s = (s.withColumn("ended_at_ns", F.col("started_at_ns") + F.round(F.col("latency_s") * 1e9).cast("bigint"))
         .withColumn("cpu0", F.when(F.col("success"), F.col("input_tokens") * 1000))
         .withColumn("cpu1", F.col("cpu0") + F.col("output_tokens") * 1000))
    s = U.add_durations(s, {"duration_s": ("started_at_ns", "ended_at_ns", 1e9),
                            "cpu_s": ("cpu0", "cpu1", 1e6)})
    return s.select("run_id", "step_number", "started_at_ns", "ended_at_ns",
                    F.round("duration_s", 6).alias("duration_s"), F.round("cpu_s", 6).alias("cpu_s"))


def _usage(spark, d):
    return U.normalize_usage(_raw_usage(fx_steps(spark, d)), provider="style").drop("raw_usage")


def q_normalize_usage(spark, d):
    return _usage(spark, d)


def q_run_token_totals(spark, d):
    return U.run_token_totals(_usage(spark, d))


def _runs(steps):
    return steps.where(F.col("step_number") == 1).select(
        "run_id",
        F.concat(F.lit("task "), F.col("provider"), F.lit(" "),
                 F.repeat(F.lit("abc "), (F.col("run_id") % 20).cast("int"))).alias("task"),
        "success", (F.col("latency_s") * 10).alias("execution_time"))


def q_run_summary(spark, d):
    s = fx_steps(spark, d)
    return U.run_summary(_runs(s), s)


def q_tool_usage(spark, d):
    return U.tool_usage(fx_steps(spark, d).withColumnRenamed("latency_s", "duration_s"))


def q_model_comparison(spark, d):
    return U.model_comparison(fx_steps(spark, d))


def q_calls_with_results(spark, d):
    s = fx_steps(spark, d)
    calls = s.select("run_id", "step_number", "call_id", "tool")
    res = s.where("success").select(
        "run_id", "step_number", "call_id", F.lit(0).alias("pos"),
        F.concat(F.col("tool"), F.lit(":"), F.col("output_tokens").cast("string")).alias("result"))
    again = s.where(F.col("tool") == "purchase").select(
        "run_id", "step_number", "call_id", F.lit(1).alias("pos"), F.lit("retry").alias("result"))
    return U.calls_with_results(calls, res.unionByName(again)).select(
        "run_id", "step_number", "call_id", "result")


def q_attach_step_summary(spark, d):
    s = fx_steps(spark, d).select("run_id", "step_number", F.col("call_id").alias("pos"), "tool")
    summ = s.where(F.col("tool") == "purchase").select(
        "run_id", "step_number",
        F.concat(F.lit("summary "), F.col("pos").cast("string")).alias("lakeview_summary"))
    return U.attach_step_summary(s, summ).select("run_id", "step_number", "lakeview_summary")


def _test_runs(steps):
    return steps.select(
        "run_id", "step_number",
        F.when(F.col("tool") == "error", 255).when(F.col("tool") == "purchase", 1).otherwise(0)
         .alias("exit_code"),
        F.when(F.col("input_tokens") % 3 == 0, "exec /bin/bash: no such file")
         .when(F.col("input_tokens") % 3 == 1, "bash: argument list too long")
         .otherwise("FAILED tests/test_a.py::t").alias("output"))


def q_executed_runs(spark, d):
    return U.executed_runs(_test_runs(fx_steps(spark, d)), ["run_id", "step_number"]).select(
        "run_id", "step_number", "exit_code")


def q_to_chat_messages(spark, d):
    return M.to_chat_messages(fx_messages(spark, d), "anthropic").select(
        "run_id", "step", "chat_role", "chat_content", "is_system", "error")


def q_to_chat_messages_google(spark, d):
    return M.to_chat_messages(fx_messages(spark, d), "google").select(
        "run_id", "step", "chat_role", "chat_content", "is_system", "error")


def _with_tools(spark, d):
    """Messages of which every second carries a tool call or its result."""
    m, step = fx_messages(spark, d), F.col("step")
    call = F.struct(F.lit("c").alias("call_id"), F.lit("bash").alias("name"),
                    F.concat(F.lit('{"k":'), F.col("run_id").cast("string"), F.lit("}")).alias("arguments"))
    result = F.struct(F.lit("c").alias("call_id"), (step % 8 == 3).alias("success"), F.col("content").alias("result"),
                      F.when(step % 8 == 7, "boom").alias("error"))
    return m.withColumn("tool_call", F.when(step % 4 == 1, call)).withColumn("tool_result", F.when(step % 4 == 3, result))


def _chat_with_tools(style):
    def query(spark, d):
        return M.to_chat_messages(_with_tools(spark, d), style).select("run_id", "step", "chat_role", "chat_content", "is_system", "error")
    query.__doc__ = f"P13 in the {style} style, tool calls and results included."
    return query


def q_step_text(spark, d):
    """the text of a step with its tool-call lines, in full."""
    m = fx_messages(spark, d)
    calls = F.when(F.col("step") % 2 == 1, F.array(*[F.struct(F.lit(n).alias("name"), a.alias("arguments")) for n, a in (
        ("bash", F.concat(F.lit('{"k":'), F.col("run_id").cast("string"), F.lit(',"ok":true}'))), ("done", F.lit("not json")))]))
    return M.with_step_text(m.withColumn("tool_calls", calls)).select("run_id", "step", "step_text")


def q_previous_step(spark, d):
    return M.previous_step(fx_messages(spark, d)).select("run_id", "step", "previous")


def q_prompt_prefix(spark, d):
    return M.prompt_prefix(fx_messages(spark, d)).select(
        "run_id", "step", "prompt_messages", "prompt_chars", "system_chars")


def q_assemble_step_text(spark, d):
    m = fx_messages(spark, d).withColumn("step_text", M.step_text(F.col("content")))
    return M.assemble_step_text(m).select(
        "run_id", "step", F.length("block").cast("bigint").alias("block_chars"),
        "context_chars", "skip_tagging")


def q_completion_flags(spark, d):
    m, step = fx_messages(spark, d), F.col("step")
    names = F.when(step % 3 == 0, F.array(F.lit("bash"), F.lit("task_done"))).when(step % 3 == 1, F.array(F.lit("bash")))
    calls = F.transform(names, lambda n: F.struct(n.alias("name")))
    return m.select("run_id", "step", M.completion_default(F.col("content")).alias("completed"),
                    M.completion_task_done(calls).alias("task_done"))


QUERIES = {
    "add_durations": q_add_durations,
    "normalize_usage": q_normalize_usage,
    "run_token_totals": q_run_token_totals,
    "run_summary": q_run_summary,
    "tool_usage": q_tool_usage,
    "model_comparison": q_model_comparison,
    "calls_with_results": q_calls_with_results,
    "attach_step_summary": q_attach_step_summary,
    "executed_runs": q_executed_runs,
    "to_chat_messages": q_to_chat_messages,
    "to_chat_messages_google": q_to_chat_messages_google,
    "previous_step": q_previous_step,
    **{f"to_chat_messages_{s}_tools": _chat_with_tools(s) for s in ("openai", "compatible", "anthropic", "google")},
    "step_text": q_step_text,
    "prompt_prefix": q_prompt_prefix,
    "assemble_step_text": q_assemble_step_text,
    "completion_flags": q_completion_flags,
}

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

_ARGS = "'{\"k\": ' || CAST(run_id AS VARCHAR) || '}'"
_NO_CONTENT = "content IS NULL OR content = ''"
_CHAT_ERROR = "CASE WHEN step % 8 = 7 THEN chr(10) || 'Tool call failed with error:' || chr(10) || 'boom' ELSE '' END"
# style, role of a call, of a result, of other rows; a call as text; what
# follows a result; other texts; system rows; error
_TOOL_STYLES = [
    ("openai", "'function_call'", "'function_call_output'", "role", _ARGS, "CASE WHEN step % 8 = 7 THEN chr(10) || 'Error: boom' ELSE '' END", "content", "false",
     f"CASE WHEN step % 2 = 0 AND ({_NO_CONTENT}) THEN 'Message content is required' END"),
    ("compatible", "'function'", "'tool'", "role", "'{\"name\": \"bash\", \"arguments\": ' || " + _ARGS + " || '}'", _CHAT_ERROR, "content", "false",
     f"CASE WHEN step % 2 = 0 AND ({_NO_CONTENT}) THEN upper(left(role, 1)) || substr(role, 2) || ' message content is required' END"),
    ("anthropic", "CASE WHEN role = 'system' THEN 'system' ELSE 'assistant' END", "CASE WHEN role = 'system' THEN 'system' ELSE 'user' END", "role", _ARGS, _CHAT_ERROR,
     "content", "role = 'system'", f"CASE WHEN role <> 'system' AND step % 2 = 0 AND ({_NO_CONTENT}) THEN 'Message content is required' END"),
    ("google", "CASE WHEN role = 'system' THEN 'system' ELSE 'model' END", "CASE WHEN role = 'system' THEN 'system' ELSE 'tool' END",
     "CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'user' ELSE 'model' END", _ARGS, _CHAT_ERROR, "coalesce(content, '')", "role = 'system'", "CAST(NULL AS VARCHAR)"),
]

_USAGE_SQL = """
SELECT run_id, step_number, style,
  CASE WHEN has THEN input_tokens ELSE 0 END AS input_tokens,
  CASE WHEN has THEN output_tokens ELSE 0 END AS output_tokens,
  CASE WHEN has THEN CASE WHEN style = 'anthropic' THEN input_tokens % 5 ELSE 0 END END AS cache_creation_input_tokens,
  CASE WHEN has THEN CASE WHEN style IN ('anthropic', 'openai', 'google') THEN output_tokens % 7 ELSE 0 END END AS cache_read_input_tokens,
  CASE WHEN has THEN CASE WHEN style = 'openai' THEN output_tokens % 3 ELSE 0 END END AS reasoning_tokens
FROM (SELECT *, (['anthropic', 'openai', 'google', 'compatible', 'ollama'])[CAST(run_id % 5 AS INTEGER) + 1] AS style,
             tool <> 'signup' AND run_id % 5 <> 4 AS has
      FROM fx_steps)"""

ORACLE = {
    "add_durations": with_fx("""
SELECT run_id, step_number, started_at_ns, ended_at_ns,
       round((ended_at_ns - started_at_ns) / 1e9, 6) AS duration_s,
       round((cpu1 - cpu0) / 1e6, 6) AS cpu_s
FROM (SELECT *, started_at_ns + CAST(round(latency_s * 1e9) AS BIGINT) AS ended_at_ns,
             cpu0 + output_tokens * 1000 AS cpu1
      FROM (SELECT *, epoch_us(ts) * 1000 AS started_at_ns,
                   CASE WHEN success THEN input_tokens * 1000 END AS cpu0 FROM fx_steps))""", "fx_steps"),
    "normalize_usage": with_fx(_USAGE_SQL, "fx_steps"),
    "run_token_totals": with_fx(f"""
SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(cache_creation_input_tokens) AS BIGINT) AS cache_creation_input_tokens,
       CAST(sum(cache_read_input_tokens) AS BIGINT) AS cache_read_input_tokens,
       CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens
FROM ({_USAGE_SQL}) GROUP BY run_id""", "fx_steps"),
    "run_summary": with_fx("""
SELECT r.run_id,
       CASE WHEN length(r.task) > 50 THEN substr(r.task, 1, 50) || '...' ELSE r.task END AS task_preview,
       r.success, coalesce(p.steps, 0) AS steps, round(r.execution_time, 2) AS execution_time,
       p.input_tokens + p.output_tokens AS total_tokens
FROM (SELECT run_id, 'task ' || provider || ' ' || repeat('abc ', CAST(run_id % 20 AS INTEGER)) AS task,
             success, latency_s * 10 AS execution_time
      FROM fx_steps WHERE step_number = 1) r
LEFT JOIN (SELECT run_id, count(*) AS steps, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
                  CAST(sum(output_tokens) AS BIGINT) AS output_tokens
           FROM fx_steps GROUP BY run_id) p USING (run_id)""", "fx_steps"),
    "tool_usage": with_fx("""
SELECT lower(replace(tool, '_', '')) AS tool, count(*) AS calls,
       count(*) FILTER (WHERE success) AS succeeded,
       round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS success_rate,
       round(avg(latency_s), 6) AS avg_duration_s
FROM fx_steps GROUP BY 1""", "fx_steps"),
    "model_comparison": with_fx("""
SELECT provider, model, count(DISTINCT run_id) AS runs, count(*) AS steps,
       round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS success_rate,
       CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens,
       round(avg(latency_s), 6) AS avg_latency_s
FROM fx_steps GROUP BY provider, model""", "fx_steps"),
    "calls_with_results": with_fx("""
SELECT c.run_id, c.step_number, c.call_id, coalesce(r.result, '') AS result
FROM fx_steps c LEFT JOIN (
  SELECT run_id, step_number, call_id, arg_min(result, pos) AS result FROM (
    SELECT run_id, step_number, call_id, 0 AS pos, tool || ':' || CAST(output_tokens AS VARCHAR(20)) AS result
    FROM fx_steps WHERE success
    UNION ALL
    SELECT run_id, step_number, call_id, 1, 'retry' FROM fx_steps WHERE tool = 'purchase')
  GROUP BY 1, 2, 3) r USING (run_id, step_number, call_id)""", "fx_steps"),
    "attach_step_summary": with_fx("""
SELECT run_id, step_number,
       CASE WHEN tool = 'purchase' THEN 'summary ' || CAST(call_id AS VARCHAR(20)) END AS lakeview_summary
FROM fx_steps""", "fx_steps"),
    "executed_runs": with_fx("""
SELECT run_id, step_number, exit_code FROM (
  SELECT run_id, step_number,
         CASE tool WHEN 'error' THEN 255 WHEN 'purchase' THEN 1 ELSE 0 END AS exit_code,
         CASE input_tokens % 3 WHEN 0 THEN 'exec /bin/bash: no such file'
              WHEN 1 THEN 'bash: argument list too long' ELSE 'FAILED tests/test_a.py::t' END AS output
  FROM fx_steps)
WHERE NOT (exit_code = 255 AND (contains(output, 'argument list too long') OR starts_with(output, 'exec ')))""",
                             "fx_steps"),
    "to_chat_messages": with_fx("""
SELECT run_id, step, CASE WHEN role = 'system' THEN 'system' ELSE role END AS chat_role,
       content AS chat_content, role = 'system' AS is_system,
       CASE WHEN role = 'system' THEN NULL
            WHEN role NOT IN ('user', 'assistant') THEN 'Invalid message role: ' || role
            WHEN content IS NULL OR content = '' THEN 'Message content is required' END AS error
FROM fx_messages""", "fx_messages"),
    "to_chat_messages_google": with_fx("""
SELECT run_id, step,
       CASE WHEN role = 'system' THEN 'system' WHEN role = 'user' THEN 'user' ELSE 'model' END AS chat_role,
       CASE WHEN role = 'system' THEN content ELSE coalesce(content, '') END AS chat_content,
       role = 'system' AS is_system, CAST(NULL AS VARCHAR) AS error
FROM fx_messages""", "fx_messages"),
    **{f"to_chat_messages_{style}_tools": with_fx(f"""
SELECT run_id, step, CASE step % 4 WHEN 1 THEN {call} WHEN 3 THEN {result} ELSE {plain} END AS chat_role,
  CASE WHEN {sys} THEN content WHEN step % 4 = 1 THEN {dumped}
       WHEN step % 4 = 3 THEN {_STRIP.format(x="coalesce(content, '') || " + tail)} ELSE {text} END AS chat_content,
  {sys} AS is_system, {error} AS error
FROM fx_messages""", "fx_messages") for style, call, result, plain, dumped, tail, text, sys, error in _TOOL_STYLES},
    "step_text": with_fx(f"""
SELECT run_id, step, {_STRIP.format(x="coalesce(content, '')")} || CASE WHEN step % 2 = 1 THEN chr(10) || chr(10) || 'Tool calls:' || chr(10)
       || '[`bash`] `{{''k'': ' || CAST(run_id AS VARCHAR) || ', ''ok'': True}}`' || chr(10) || '[`done`] `not json`' ELSE '' END AS step_text
FROM fx_messages""", "fx_messages"),
    "previous_step": with_fx("""
SELECT run_id, step, coalesce(lag(content) OVER (PARTITION BY run_id ORDER BY step), '(none)') AS previous
FROM fx_messages""", "fx_messages"),
    "prompt_prefix": with_fx("""
SELECT run_id, step,
  count(*) OVER w AS prompt_messages,
  CAST(sum(coalesce(length(content), 0)) OVER w AS BIGINT) AS prompt_chars,
  length(last_value(CASE WHEN role = 'system' THEN content END IGNORE NULLS) OVER w) AS system_chars
FROM fx_messages
WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
                             "fx_messages"),
    "assemble_step_text": with_fx(f"""
SELECT run_id, step, block_chars,
       CAST(sum(block_chars) OVER w + 2 * (count(*) OVER w - 1) AS BIGINT) AS context_chars,
       sum(block_chars) OVER w + 2 * (count(*) OVER w - 1) > 300000 AS skip_tagging
FROM (SELECT run_id, step,
             length('<step id="' || CAST(row_number() OVER (PARTITION BY run_id ORDER BY step) AS VARCHAR(20))
                    || '">' || chr(10) || {_STRIP.format(x="coalesce(content, '')")} || chr(10) || '</step>') AS block_chars
      FROM fx_messages)
WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
                                  "fx_messages"),
    "completion_flags": with_fx("""
SELECT run_id, step,
       contains(lower(coalesce(content, '')), 'task completed') OR contains(lower(coalesce(content, '')), 'task finished')
       OR contains(lower(coalesce(content, '')), 'done') OR contains(lower(coalesce(content, '')), 'completed successfully')
       OR contains(lower(coalesce(content, '')), 'finished successfully') AS completed,
       step % 3 = 0 AS task_done
FROM fx_messages""", "fx_messages"),
}
