"""Nested trajectories -> seven flat tables keyed by array positions.

Each table is a ``posexplode`` of one nesting level of the same scan;
Catalyst prunes the nested columns each table does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten_trajectories(traj: DataFrame) -> dict[str, DataFrame]:
    if "_bad" in traj.columns:
        # Spark refuses a raw JSON scan that ends up reading only the corrupt-
        # record column (nested pruning can get there), so the filter also
        # reads a data column; the second test is always true
        t = traj.where(F.col("_bad").isNull() & (F.length(F.coalesce(F.col("task"), F.lit(""))) >= 0))
    else:
        t = traj
    runs = t.select("run_id", "task", "start_time", F.expr("try_cast(nullif(end_time, '') AS TIMESTAMP_NTZ)")
                    .alias("end_time"), "provider", "model", "max_steps", "success", "final_result",
                    "execution_time", F.size("agent_steps").alias("n_steps"),
                    F.size("llm_interactions").alias("n_interactions"))
    inter = t.select("run_id", F.posexplode("llm_interactions").alias("interaction_pos", "i"))
    interactions = inter.select(
        "run_id", "interaction_pos", "i.timestamp", "i.latency_s", "i.provider", "i.model",
        F.col("i.response.response_id").alias("response_id"), F.col("i.response.content").alias("content"),
        F.col("i.response.finish_reason").alias("finish_reason"), "i.response.usage.*",
        F.col("i.tools_available").alias("tools_available"),
        F.when(F.col("i.wire_request.body").isNotNull(), F.col("i.wire_request")).alias("wire_request"))
    messages = inter.select("run_id", "interaction_pos",
                            F.posexplode("i.input_messages").alias("message_pos", "m")).select(
        "run_id", "interaction_pos", "message_pos", "m.role", "m.content",
        F.col("m.tool_call").alias("tool_call"), F.col("m.tool_result").alias("tool_result"))
    response_calls = inter.select("run_id", "interaction_pos",
                                  F.posexplode("i.response.tool_calls").alias("call_pos", "c")).select(
        "run_id", "interaction_pos", "call_pos", "c.*")
    st = t.select("run_id", F.posexplode("agent_steps").alias("step_pos", "s"))
    steps = st.select("run_id", "step_pos", "s.step_number", "s.timestamp", "s.state",
                      F.col("s.llm_response.content").alias("content"),
                      F.col("s.llm_response.usage.input_tokens").alias("input_tokens"),
                      F.col("s.llm_response.usage.output_tokens").alias("output_tokens"),
                      "s.reflection", "s.error", "s.lakeview_summary")
    step_calls = st.select("run_id", "step_pos", "s.step_number",
                           F.posexplode("s.tool_calls").alias("call_pos", "c")).select(
        "run_id", "step_pos", "step_number", "call_pos", "c.*")
    step_results = st.select("run_id", "step_pos", "s.step_number",
                             F.posexplode("s.tool_results").alias("result_pos", "r")).select(
        "run_id", "step_pos", "step_number", "result_pos", "r.*",
        ((F.col("r.ended_at_ns") - F.col("r.started_at_ns")) / 1e9).alias("duration_s"))
    return {"runs": runs, "interactions": interactions, "messages": messages,
            "response_tool_calls": response_calls, "steps": steps,
            "step_tool_calls": step_calls, "step_tool_results": step_results}


TABLES = ("runs", "interactions", "messages", "response_tool_calls", "steps", "step_tool_calls", "step_tool_results")


def flatten_once(traj: DataFrame) -> DataFrame:
    """The seven tables in one pass: a row for each of their rows, with
    ``table`` its name, ``run_id``, and a struct column for each table that is
    null but for its own.  Each trajectory is parsed once and exploded once;
    nothing is shuffled.  Unreadable trajectories (``_bad``) have no rows; a
    null array has none either."""
    t = traj.where(F.col("_bad").isNull() & (F.length(F.coalesce(F.col("task"), F.lit(""))) >= 0)) if "_bad" in traj.columns else traj
    none = lambda a: F.coalesce(a, F.array())
    at = lambda pos, name: pos.alias(name)

    def calls(of, name):
        return lambda x, *where: F.transform(of(x), lambda c, k: F.struct(*where, at(k, name), c["call_id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("arguments"), c["id"].alias("id")))

    run = F.struct("task", "start_time", F.expr("try_cast(nullif(end_time, '') AS TIMESTAMP_NTZ)").alias("end_time"), "provider", "model", "max_steps", "success", "final_result",
                   "execution_time", F.size("agent_steps").alias("n_steps"), F.size("llm_interactions").alias("n_interactions"))
    usage = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "reasoning_tokens")

    def interaction(i, k):
        return F.struct(at(k, "interaction_pos"), *[i[c].alias(c) for c in ("timestamp", "latency_s", "provider", "model")],
                        *[i["response"][c].alias(c) for c in ("response_id", "content", "finish_reason")], *[i["response"]["usage"][c].alias(c) for c in usage],
                        i["tools_available"].alias("tools_available"), F.when(i["wire_request"]["body"].isNotNull(), i["wire_request"]).alias("wire_request"))

    def message(i, k):
        return F.transform(i["input_messages"], lambda m, n: F.struct(at(k, "interaction_pos"), at(n, "message_pos"), *[m[c].alias(c) for c in ("role", "content", "tool_call", "tool_result")]))

    def step(s, k):
        return F.struct(at(k, "step_pos"), *[s[c].alias(c) for c in ("step_number", "timestamp", "state")], s["llm_response"]["content"].alias("content"),
                        *[s["llm_response"]["usage"][c].alias(c) for c in ("input_tokens", "output_tokens")], *[s[c].alias(c) for c in ("reflection", "error", "lakeview_summary")])

    def result(s, k):
        fields = ("call_id", "success", "result", "error", "id", "exit_code", "executed_command", "executor", "started_at_ns", "ended_at_ns")
        return F.transform(s["tool_results"], lambda r, n: F.struct(at(k, "step_pos"), s["step_number"].alias("step_number"), at(n, "result_pos"), *[r[c].alias(c) for c in fields],
                                                                    ((r["ended_at_ns"] - r["started_at_ns"]) / 1e9).alias("duration_s")))

    def nested(rows, each):
        return F.flatten(F.filter(F.transform(rows, each), lambda a: a.isNotNull()))

    inter, steps = none(F.col("llm_interactions")), none(F.col("agent_steps"))
    found = {
        "runs": F.array(run),
        "interactions": F.transform(inter, interaction),
        "messages": nested(inter, message),
        "response_tool_calls": nested(inter, lambda i, k: calls(lambda x: x["response"]["tool_calls"], "call_pos")(i, at(k, "interaction_pos"))),
        "steps": F.transform(steps, step),
        "step_tool_calls": nested(steps, lambda s, k: calls(lambda x: x["tool_calls"], "call_pos")(s, at(k, "step_pos"), s["step_number"].alias("step_number"))),
        "step_tool_results": nested(steps, result),
    }
    t = t.select("run_id", *[rows.alias(name) for name, rows in found.items()])
    kinds = {f.name: f.dataType.elementType for f in t.schema.fields if f.name != "run_id"}

    def tagged(own):
        return F.transform(own, lambda r: F.struct(F.lit(own).alias("table"), *[r.alias(n) if n == own else F.lit(None).cast(kinds[n]).alias(n) for n in TABLES]))

    return t.select("run_id", F.explode(F.concat(*map(tagged, TABLES))).alias("r")).select("r.table", "run_id", *[f"r.{n}" for n in TABLES])


def write_flat(traj: DataFrame, path: str) -> None:
    """All seven tables under ``path`` in one job, a folder each."""
    flatten_once(traj).write.mode("overwrite").partitionBy("table").parquet(path)


def read_flat(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The seven tables that :func:`write_flat` wrote; reading one opens its
    folder and its columns only."""
    flat = spark.read.parquet(path)
    return {t: flat.where(F.col("table") == t).select("run_id", f"{t}.*") for t in TABLES}


def trajectory_reports(flat: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The reports read off flattened trajectories: per-run summary (task
    preview, success, steps, execution time, total tokens), token totals per
    run, tool usage, model comparison, and each tool call with its first
    result.  Every report is a grouped aggregate or an equi-join on run and
    step keys."""
    from .usage import calls_with_results, run_token_totals, task_preview, tool_usage

    totals = run_token_totals(flat["interactions"])
    n_steps = flat["steps"].groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"))
    runs = flat["runs"]
    summary = (runs.join(n_steps, "run_id", "left").join(totals, "run_id", "left").select(
        "run_id", task_preview("task").alias("task_preview"), "success",
        F.coalesce(F.col("steps"), F.lit(0)).cast("bigint").alias("steps"),
        F.round("execution_time", 2).alias("execution_time"),
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens")))
    results = flat["step_tool_results"].select(
        "run_id", "step_pos", "call_id", F.col("result_pos").alias("pos"), "result", "success", "duration_s")
    calls = flat["step_tool_calls"].select("run_id", "step_pos", "call_id", F.col("name").alias("tool"))
    with_res = calls_with_results(calls, results.select("run_id", "step_pos", "call_id", "pos", "result"),
                                  keys=("run_id", "step_pos"))
    outcome = results.groupBy("run_id", "step_pos", "call_id").agg(
        F.min_by(F.struct("success", "duration_s"), F.col("pos")).alias("o"))
    tools = tool_usage(calls.join(outcome, ["run_id", "step_pos", "call_id"], "left").select(
        "tool", F.coalesce(F.col("o.success"), F.lit(False)).alias("success"),
        F.col("o.duration_s").alias("duration_s")))
    per_run = runs.select("run_id", "provider", "model", "success").join(summary.select(
        "run_id", "steps", "total_tokens"), "run_id")
    lat = flat["interactions"].groupBy("run_id").agg(F.avg("latency_s").alias("_lat"))
    models = per_run.join(lat, "run_id", "left").groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        F.sum("steps").cast("bigint").alias("steps"), F.sum("total_tokens").cast("bigint").alias("tokens"),
        F.round(F.avg("_lat"), 6).alias("avg_latency_s"))
    return {"summary": summary, "token_totals": totals, "tool_usage": tools,
            "model_comparison": models, "calls_with_results": with_res}
