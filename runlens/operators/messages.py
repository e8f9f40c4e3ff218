"""Message-level operators: provider chat rows (P13), previous step (W03),
prompt prefix sizes (W06), step text for labelling (F09) and completion
flags (F10).

Per-conversation running aggregates go through the chunked scan of
``scan.running``; prefix *sizes* are running sums instead of collected prefixes,
which would be quadratic per conversation.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import running

# Phrases that mark a finished task in the default agent.
COMPLETION_PHRASES = ["task completed", "task finished", "done",
                      "completed successfully", "finished successfully"]
# Default text for a failed tool result without details, the
# two ways tool errors are appended to results, and message errors.
SILENT_FAILURE_TEXT = "Tool execution failed without providing error details."
ERROR_SUFFIX_OPENAI = "\nError: "
ERROR_PREFIX_CHAT = "Tool call failed with error:\n"
CONTENT_REQUIRED = "Message content is required"
ROLE_CONTENT_REQUIRED = {"system": "System message content is required",
                         "user": "User message content is required",
                         "assistant": "Assistant message content is required"}
INVALID_ROLE = "Invalid message role: "
STEP_CONTEXT_LIMIT = 300_000


def strip(c: Column) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def _opt(df: DataFrame, name: str, ddl: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(ddl)


def tool_result_text(res: Column, style: str) -> Column:
    """Render a tool result struct (result, error, success) for a provider.
    ``openai``: ``result\\nError: err``; ``compatible``/``anthropic``:
    ``result\\nTool call failed with error:\\nerr``; anthropic adds a default
    text when a failed result carries no text.  Always stripped."""
    r, e = res["result"], res["error"]
    if style == "openai":
        txt = F.concat(F.coalesce(r, F.lit("")),
                       F.when(F.length(e) > 0, F.concat(F.lit(ERROR_SUFFIX_OPENAI), e)).otherwise(F.lit("")))
    else:
        txt = F.concat(F.when(F.length(r) > 0, F.concat(r, F.lit("\n"))).otherwise(F.lit("")),
                       F.when(F.length(e) > 0, F.concat(F.lit(ERROR_PREFIX_CHAT), e))
                        .otherwise(F.lit("")))
    txt = strip(txt)
    if style == "anthropic":
        txt = F.when(~F.coalesce(res["success"], F.lit(False)) & (txt == ""),
                     F.lit(SILENT_FAILURE_TEXT)).otherwise(txt)
    return txt


def to_chat_messages(msgs: DataFrame, provider: str) -> DataFrame:
    """Message rows -> provider chat rows with ``chat_role``,
    ``chat_content``, ``is_system`` (system split out for anthropic and
    google) and ``error`` (the reference raises; we keep the row)."""
    role, content = F.col("role"), F.col("content")
    tc = _opt(msgs, "tool_call", "struct<call_id:string,name:string,arguments:string>")
    tr = _opt(msgs, "tool_result",
              "struct<call_id:string,success:boolean,result:string,error:string>")
    empty = content.isNull() | (content == "")
    p = provider.lower()
    if p == "google":
        is_sys = role == "system"
        chat_role = (F.when(is_sys, "system").when(tr.isNotNull(), "tool")
                     .when(tc.isNotNull(), "model").when(role == "user", "user").otherwise("model"))
        chat_content = (F.when(is_sys, content).when(tr.isNotNull(), tool_result_text(tr, "compatible"))
                        .when(tc.isNotNull(), tc["arguments"]).otherwise(F.coalesce(content, F.lit(""))))
        error = F.lit(None).cast("string")
    elif p == "anthropic":
        is_sys = role == "system"
        chat_role = (F.when(is_sys, "system").when(tr.isNotNull(), "user")
                     .when(tc.isNotNull(), "assistant").otherwise(role))
        chat_content = (F.when(is_sys, content).when(tr.isNotNull(), tool_result_text(tr, "anthropic"))
                        .when(tc.isNotNull(), tc["arguments"]).otherwise(content))
        error = (F.when(is_sys | tr.isNotNull() | tc.isNotNull(), F.lit(None))
                 .when(~role.isin("user", "assistant"), F.concat(F.lit(INVALID_ROLE), role))
                 .when(empty, F.lit(CONTENT_REQUIRED)))
    elif p in ("openai", "compatible"):
        is_sys = F.lit(False)
        if p == "openai":
            chat_role = (F.when(tr.isNotNull(), "function_call_output")
                         .when(tc.isNotNull(), "function_call").otherwise(role))
            tr_txt = tool_result_text(tr, "openai")
            # the responses API checks the tool result before the call
            first_tr = tr.isNotNull()
        else:
            chat_role = (F.when(tc.isNotNull(), "function").when(tr.isNotNull(), "tool")
                         .otherwise(role))
            tr_txt = tool_result_text(tr, "compatible")
            first_tr = tr.isNotNull() & tc.isNull()
        chat_content = (F.when(first_tr, tr_txt)
                        .when(tc.isNotNull(), F.to_json(F.struct(tc["name"].alias("name"),
                                                                 tc["arguments"].alias("arguments"))))
                        .otherwise(content))
        valid = role.isin("system", "user", "assistant")
        if p == "openai":
            # content is checked before the role
            error = (F.when(tr.isNotNull() | tc.isNotNull(), F.lit(None))
                     .when(empty, F.lit(CONTENT_REQUIRED))
                     .when(~valid, F.concat(F.lit(INVALID_ROLE), role)))
        else:
            # an empty role is skipped without error (chat_role null);
            # the content message names the role
            by_role = F.create_map(*[x for k, v in ROLE_CONTENT_REQUIRED.items() for x in (F.lit(k), F.lit(v))])
            error = (F.when(tr.isNotNull() | tc.isNotNull(), F.lit(None))
                     .when(role.isNull() | (role == ""), F.lit(None))
                     .when(~valid, F.concat(F.lit(INVALID_ROLE), role))
                     .when(empty, F.element_at(by_role, role)))
            chat_role = F.when(tr.isNull() & tc.isNull() & (role.isNull() | (role == "")),
                               F.lit(None)).otherwise(chat_role)
    else:
        raise ValueError(f"unknown provider style {provider!r}")
    out = msgs.select("*", chat_role.alias("chat_role"), chat_content.alias("chat_content"),
                      is_sys.alias("is_system"), error.cast("string").alias("error"))
    if "tool_call" not in msgs.columns:
        return out
    # Tool-call rows carry the arguments as the client serialised them
    # (json.dumps spacing).  Which rows are calls follows each client's
    # precedence; the UDF gets nulls for all other rows, and the table is read
    # once.
    if p == "compatible":
        is_call = tc.isNotNull()
    elif p == "openai":
        is_call = tc.isNotNull() & tr.isNull()
    else:
        is_call = (role != "system") & tr.isNull() & tc.isNotNull()
    call = F.coalesce(is_call, F.lit(False))
    x = out.withColumn("_dumped", _dump_call_udf(p == "compatible")(F.when(call, tc["name"]), F.when(call, tc["arguments"])))
    return x.withColumn("chat_content", F.when(call, F.col("_dumped")).otherwise(F.col("chat_content"))).drop("_dumped")


def _dump_call(name: str | None, arguments: str | None, with_name: bool) -> str | None:
    try:
        args = json.loads(arguments) if arguments is not None else None
    except ValueError:
        return arguments
    return json.dumps({"name": name, "arguments": args} if with_name else args)


def _dump_call_udf(with_name: bool):
    @F.pandas_udf(T.StringType())
    def dump(names: pd.Series, args: pd.Series) -> pd.Series:
        return pd.Series([_dump_call(n, a, with_name) for n, a in zip(names, args)])
    return dump


def system_prompt(msgs: DataFrame, run: str = "run_id", order: str = "step") -> DataFrame:
    """The system message held separately: the last one wins."""
    s = msgs.where(F.col("role") == "system")
    return s.groupBy(run).agg(F.max_by("content", order).alias("system"))


# -- W03 ---------------------------------------------------------------------
def previous_step(msgs: DataFrame, run: str = "run_id", order: str = "step",
                  text: str = "content") -> DataFrame:
    """Text of the preceding step, ``(none)`` for the first one (chunked lag,
    so one very long run is not one task; ``order`` is an integer step)."""
    out = running(msgs, run, order, {"_prev": ("lag", text)})
    return out.withColumn("previous", F.coalesce(F.col("_prev"), F.lit("(none)"))).drop("_prev")


# -- W06 ---------------------------------------------------------------------
def prompt_prefix(msgs: DataFrame, run: str = "run_id", order: str = "step",
                  reuse_history: bool = True) -> DataFrame:
    """Per turn: how many messages and characters are sent, and the length of
    the system prompt in force (last system message so far).  With history
    reuse every earlier message is resent; otherwise only the new one.
    Running sums, not collected prefixes, and chunked per conversation (see
    :func:`runlens.operators.scan.running`); ``order`` is an integer turn."""
    ln = F.coalesce(F.length("content"), F.lit(0)).cast("bigint")
    sys_msg = F.when(F.col("role") == "system", F.col("content"))
    if reuse_history:
        out = running(msgs, run, order, {"prompt_messages": ("count", F.lit(1)),
                                         "prompt_chars": ("sum", ln), "_sys": ("last", sys_msg)})
    else:
        out = running(msgs, run, order, {"_sys": ("last", sys_msg)}).select(
            "*", F.lit(1).cast("bigint").alias("prompt_messages"), ln.alias("prompt_chars"))
    return (out.withColumn("prompt_messages", F.col("prompt_messages").cast("bigint"))
            .withColumn("prompt_chars", F.col("prompt_chars").cast("bigint"))
            .withColumn("system_chars", F.length("_sys").cast("bigint")).drop("_sys"))


# -- F09 ---------------------------------------------------------------------
def step_text(content: Column, tool_calls: Column | None = None) -> Column:
    """Content, then ``Tool calls:`` and one ``[`name`] `args``` line per call."""
    c = strip(F.coalesce(content, F.lit("")))
    if tool_calls is None:
        return c
    lines = strip(F.array_join(F.transform(tool_calls, lambda t: F.concat(
        F.lit("[`"), t["name"], F.lit("`] `"), t["arguments"], F.lit("`"))), "\n"))
    return F.when(tool_calls.isNull(), c).otherwise(F.concat(c, F.lit("\n\nTool calls:\n"), lines))


def _digit_sum(k: Column) -> Column:
    """Total number of decimal digits of 1..k: (k+1)*D - (10^D - 1)/9 with D
    the digit count of k (0 for k = 0)."""
    d = F.length(k.cast("string"))
    return F.when(k <= 0, F.lit(0)).otherwise(
        ((k + 1) * d - (F.pow(F.lit(10), d).cast("bigint") - 1) / 9).cast("bigint"))


def assemble_step_text(steps: DataFrame, run: str = "run_id", order: str = "step",
                       limit: int = STEP_CONTEXT_LIMIT) -> DataFrame:
    """Per step: the ``<step id="i">..</step>`` block and the size of all
    blocks so far joined by blank lines; labelling is skipped when that size
    exceeds ``limit``.  One chunked running scan (a long run is not one task)
    gives the position i and the running text length; the id digits of
    blocks 1..i are summed in closed form.  ``order`` is an integer step."""
    body = strip(F.col("step_text"))
    out = running(steps, run, order, {"_i": ("count", F.lit(1)),
                                      "_text": ("sum", F.length(body).cast("bigint"))})
    block = F.concat(F.lit('<step id="'), F.col("_i").cast("string"), F.lit('">\n'), body, F.lit("\n</step>"))
    fixed = len('<step id="') + len('">\n') + len("\n</step>")
    total = F.col("_text") + fixed * F.col("_i") + _digit_sum(F.col("_i")) + 2 * (F.col("_i") - 1)
    return (out.withColumn("block", block).withColumn("context_chars", total.cast("bigint"))
            .withColumn("skip_tagging", F.col("context_chars") > limit).drop("_i", "_text"))


def _render_calls(calls) -> list | None:
    """``[`name`] `args``` lines with the arguments printed as the agent
    printed them (a Python dict), falling back to the raw text."""
    if calls is None:
        return None
    out = []
    for c in calls:
        raw = c["arguments"]
        try:
            args = json.loads(raw) if raw is not None else None
        except ValueError:
            args = raw
        out.append(f"[`{c['name']}`] `{args}`")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tool_call_lines(calls: pd.Series) -> pd.Series:
    return calls.map(_render_calls)


def with_step_text(steps: DataFrame, content: str = "content", tool_calls: str = "tool_calls",
                   out: str = "step_text") -> DataFrame:
    """F09 step text with tool-call arguments printed exactly as the agent
    did; for steps without tool calls the UDF gets a null."""
    text = strip(F.coalesce(F.col(content), F.lit("")))
    x = steps.withColumn("_calls", _tool_call_lines(F.col(tool_calls)))
    lines = F.concat(text, F.lit("\n\nTool calls:\n"), strip(F.array_join("_calls", "\n")))
    return x.withColumn(out, F.when(F.col(tool_calls).isNull(), text).otherwise(lines)).drop("_calls")


# -- F10 ---------------------------------------------------------------------
def completion_default(content: Column) -> Column:
    low = F.lower(F.coalesce(content, F.lit("")))
    out = F.lit(False)
    for ph in COMPLETION_PHRASES:
        out = out | F.contains(low, F.lit(ph))
    return out


def completion_task_done(tool_calls: Column) -> Column:
    return F.coalesce(F.exists(tool_calls, lambda t: t["name"] == "task_done"), F.lit(False))
