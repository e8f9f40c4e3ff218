"""Agent steps, LLM usage and run-level summaries (P02-P04, P09, A01, A11,
A12, J05, J06).

All aggregates are grouped (partial + final aggregation by Catalyst); the
joins are equi-joins on (run, step/call) keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Exit code and output markers of a test command that never ran.
EXEC_FAILED_CODE = 255
EXEC_FAILED_TEXT = "argument list too long"
EXEC_FAILED_PREFIX = "exec "

USAGE_FIELDS = ["input_tokens", "output_tokens", "cache_creation_input_tokens",
                "cache_read_input_tokens", "reasoning_tokens"]


# -- P02 ---------------------------------------------------------------------
def seconds_between(start: Column | str, end: Column | str, unit: float = 1.0) -> Column:
    """``(end - start) / unit`` in seconds; null when either side is null
    (``unit`` 1e9 for ns epochs, 1e6 for µs CPU counters)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return (e - s).cast("double") / F.lit(float(unit))


def add_durations(df: DataFrame, pairs: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Add one duration column per ``name -> (start, end, unit)``."""
    for name, (s, e, u) in pairs.items():
        df = df.withColumn(name, seconds_between(s, e, u))
    return df


# -- P03 ---------------------------------------------------------------------
def normalize_usage(df: DataFrame, provider: str = "provider", raw: str = "raw_usage") -> DataFrame:
    """Provider usage record -> the five recorded usage columns.

    ``raw`` is a struct ``input, output, cache_creation, cache_read,
    reasoning`` holding what the provider reported (null when it reported
    nothing).  A missing usage records ``0, 0, null, null, null``.  Mapping:
    anthropic keeps creation and read; openai keeps read and reasoning;
    google keeps read (creation 0); openai-compatible clients keep only
    input/output; ollama never reports usage."""
    p, u = F.lower(F.col(provider)), F.col(raw)
    has = u.isNotNull() & (p != "ollama")

    def val(field: str) -> Column:
        return F.coalesce(u[field].cast("bigint"), F.lit(0).cast("bigint"))

    zero = F.lit(0).cast("bigint")
    creation = F.when(p == "anthropic", val("cache_creation")).otherwise(zero)
    read = F.when(p.isin("anthropic", "openai", "google"), val("cache_read")).otherwise(zero)
    reasoning = F.when(p == "openai", val("reasoning")).otherwise(zero)
    nul = F.lit(None).cast("bigint")
    return df.select(
        "*",
        F.when(has, val("input")).otherwise(zero).alias("input_tokens"),
        F.when(has, val("output")).otherwise(zero).alias("output_tokens"),
        F.when(has, creation).otherwise(nul).alias("cache_creation_input_tokens"),
        F.when(has, read).otherwise(nul).alias("cache_read_input_tokens"),
        F.when(has, reasoning).otherwise(nul).alias("reasoning_tokens"))


# -- A01 ---------------------------------------------------------------------
def run_token_totals(interactions: DataFrame, run: str = "run_id",
                     fields: Sequence[str] = USAGE_FIELDS) -> DataFrame:
    """Per run: sum of each usage field over interactions; null usage is
    skipped and a run without any usage gets nulls."""
    return interactions.groupBy(run).agg(
        *[F.sum(F.col(f)).cast("bigint").alias(f) for f in fields if f in interactions.columns])


# -- P04 ---------------------------------------------------------------------
def task_preview(task: Column | str, width: int = 50) -> Column:
    t = F.col(task) if isinstance(task, str) else task
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)


def run_summary(runs: DataFrame, steps: DataFrame, run: str = "run_id") -> DataFrame:
    """Task preview, success, step count, execution time and total tokens
    (input + output) per run."""
    per = steps.groupBy(run).agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"))
    return (runs.join(per, run, "left").select(
        run, task_preview("task").alias("task_preview"), "success",
        F.coalesce(F.col("steps"), F.lit(0)).cast("bigint").alias("steps"),
        F.round("execution_time", 2).alias("execution_time"),
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens")))


# -- A11 ---------------------------------------------------------------------
def tool_key(name: Column | str) -> Column:
    """Tool names are matched lower-case without underscores."""
    n = F.col(name) if isinstance(name, str) else name
    return F.lower(F.replace(n, F.lit("_"), F.lit("")))


def tool_usage(calls: DataFrame, tool: str = "tool", success: str = "success",
               duration: str = "duration_s") -> DataFrame:
    return calls.groupBy(tool_key(tool).alias("tool")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col(success)).cast("bigint").alias("succeeded"),
        F.round(F.avg(F.col(success).cast("double")), 6).alias("success_rate"),
        F.round(F.avg(duration), 6).alias("avg_duration_s"))


# -- A12 ---------------------------------------------------------------------
def model_comparison(steps: DataFrame, run: str = "run_id") -> DataFrame:
    return steps.groupBy("provider", "model").agg(
        F.count_distinct(run).alias("runs"),
        F.count(F.lit(1)).alias("steps"),
        F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("bigint").alias("tokens"),
        F.round(F.avg("latency_s"), 6).alias("avg_latency_s"))


# -- J05 ---------------------------------------------------------------------
def calls_with_results(calls: DataFrame, results: DataFrame,
                       keys: Sequence[str] = ("run_id", "step_number"),
                       call_id: str = "call_id", pos: str = "pos",
                       result: str = "result") -> DataFrame:
    """Each tool call with the first result (lowest ``pos``) carrying the
    same call id in the same step; empty text when there is none."""
    k = list(keys) + [call_id]
    first = results.groupBy(*k).agg(F.min_by(F.col(result), F.col(pos)).alias("_res"))
    return (calls.join(first, k, "left")
            .withColumn(result, F.coalesce(F.col("_res"), F.lit(""))).drop("_res"))


# -- J06 ---------------------------------------------------------------------
def attach_step_summary(steps: DataFrame, summaries: DataFrame, run: str = "run_id",
                        step: str = "step_number", order: str = "pos",
                        col: str = "lakeview_summary", seq: str | None = None) -> DataFrame:
    """Set ``col`` on the first step (lowest ``order``) with each step number;
    other rows keep their old value.  Of several summaries of a step the last
    by ``seq`` counts (without ``seq``, the greatest text)."""
    k = [run, step]
    # a (run, step) group is one step (a retried step at most a few rows), so
    # a window min over it is cheap, and its output is already partitioned
    # on (run, step): only the summaries move for the join
    first = F.min(order).over(Window.partitionBy(*k))
    last = F.max_by(F.col(col), F.col(seq)) if seq else F.max(F.col(col))
    s = summaries.groupBy(*k).agg(last.alias("_new"))
    old = F.col(col) if col in steps.columns else F.lit(None).cast("string")
    j = steps.withColumn("_first", first).join(s, k, "left")
    return j.withColumn(col, F.when(F.col(order) == F.col("_first"), F.coalesce("_new", old))
                        .otherwise(old)).drop("_first", "_new")


# -- P09 ---------------------------------------------------------------------
def exec_failed(exit_code: str = "exit_code", output: str = "output") -> Column:
    """The test command never ran: exit 255 and an exec diagnostic."""
    o = F.col(output)
    return (F.col(exit_code) == EXEC_FAILED_CODE) & (F.contains(o, F.lit(EXEC_FAILED_TEXT))
                                                     | F.startswith(o, F.lit(EXEC_FAILED_PREFIX)))


def failed_exec_runs(runs: DataFrame, key: Sequence[str] = ("run_id",)) -> DataFrame:
    """Runs that never executed; callers exclude them with ``left_anti``
    instead of reading them as all-failed."""
    return runs.where(exec_failed()).select(*key).distinct()


def executed_runs(runs: DataFrame, key: Sequence[str] = ("run_id",)) -> DataFrame:
    return runs.join(failed_exec_runs(runs, key), list(key), "left_anti")
