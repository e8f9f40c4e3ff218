"""Queries over model replies and tool output (fx_replies, events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies as R
from ..sources.fixtures import fx_replies, with_fx
from ..sources.tables import table

BATCH = 20
N_CANDIDATES = 5


def q_parse_index_selection(spark, d):
    r = fx_replies(spark, d).withColumn("idx", R.parse_index_selection(F.col("index_reply"), BATCH))
    return r.select("reply_id", F.array_join(F.transform("idx", lambda i: i.cast("string")), ",").alias("picked"),
                    F.size("idx").cast("bigint").alias("n_picked"))


def q_parse_selection_reply(spark, d):
    r = fx_replies(spark, d)
    return r.select("reply_id", R.selection_decided(F.col("select_reply")).alias("decided"),
                    R.selection_choice(F.col("select_reply"), N_CANDIDATES).cast("bigint").alias("choice"))


def q_selector_decision(spark, d):
    """Per run: the first decided turn picks; undecided after all turns -> 1."""
    r = fx_replies(spark, d).withColumn(
        "choice", R.selection_choice(F.col("select_reply"), N_CANDIDATES).cast("bigint"))
    g = r.groupBy("run_id").agg(
        F.min_by("choice", F.when(F.col("choice").isNotNull(), F.col("reply_id"))).alias("c"),
        F.count("choice").alias("decided_turns"))
    return g.select("run_id", F.coalesce("c", F.lit(1).cast("bigint")).alias("final_choice"), "decided_turns")


def _tool_text(spark, d):
    ev = table(spark, d, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') AS INT)")
    status = F.when(F.col("event_type") == "error", "Tool Call Status: -1").otherwise("Tool Call Status: 0")
    text = F.concat(F.lit("ran "), F.col("event_type"), F.lit("\n  "), status, F.lit("\nresult "),
                    F.col("event_id").cast("string"))
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("no status\nresult "), F.col("event_id").cast("string"))
                  ).otherwise(text)
    exit_text = F.when(F.col("event_type") == "signup", F.lit("n/a")).otherwise(
        F.concat(F.lit("  "), k.cast("string"), F.lit("\n"), (k % 3).cast("string"), F.lit("  ")))
    return ev.select("event_id", text.alias("text"), exit_text.alias("exit_text"))


def q_split_tool_output(spark, d):
    t = _tool_text(spark, d).withColumn("o", R.split_tool_output(F.col("text")))
    return t.select("event_id", F.col("o.content").alias("content"), F.col("o.success").alias("success"),
                    R.exit_code(F.col("exit_text")).alias("exit_code"))


def q_parse_step_labels(spark, d):
    r = fx_replies(spark, d).withColumn("tags", R.step_tags(F.col("tag_reply")))
    return r.select("reply_id", F.size("tags").cast("bigint").alias("n_tags"),
                    R.step_label(F.col("tags")).alias("label"))


QUERIES = {
    "parse_index_selection": q_parse_index_selection,
    "parse_selection_reply": q_parse_selection_reply,
    "selector_decision": q_selector_decision,
    "split_tool_output": q_split_tool_output,
    "parse_step_labels": q_parse_step_labels,
}

_STATUS = "'(?:###\\s*)?Status:\\s*(success|succeed|successfully|successful)\\s*\\n\\s*(?:###\\s*)?Result:'"
_RESULT = "'(?:###\\s*)?Result:\\s*(.+?)\\s*(?:###\\s*)?Analysis:'"
_CHOICE = f"""
CASE WHEN regexp_matches(select_reply, {_STATUS}) AND regexp_matches(select_reply, {_RESULT}) THEN
  CASE WHEN regexp_matches(tl, '^[1-9][0-9]*$') AND TRY_CAST(tl AS INTEGER) BETWEEN 1 AND 5
       THEN CAST(tl AS BIGINT) ELSE 1 END END"""
_CHOICE_SRC = f"""(SELECT *, string_split(regexp_replace(regexp_extract(select_reply, {_RESULT}, 1),
                                    '^\\s+|\\s+$', '', 'g'), 'Patch-')[-1] AS tl FROM fx_replies)"""
_KNOWN = "['WRITE_TEST', 'VERIFY_TEST', 'EXAMINE_CODE', 'WRITE_FIX', 'VERIFY_FIX', 'REPORT', 'THINK', 'OUTLIER']"
_EMOJI = "['☑️', '✅', '👁️', '📝', '🔥', '📣', '🧠', '⁉️']"
_K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"

ORACLE = {
    "parse_index_selection": with_fx("""
SELECT reply_id, array_to_string(list_transform(idx, lambda i: CAST(i AS VARCHAR)), ',') AS picked,
       CAST(len(idx) AS BIGINT) AS n_picked
FROM (SELECT reply_id,
        list_filter(ints, lambda x, i: x IS NOT NULL AND x >= 0 AND x < 20
                    AND list_position(ints, x) = i) AS idx
      FROM (SELECT reply_id, list_transform(regexp_extract_all(index_reply, '(\\d+)', 1),
                                            lambda s: TRY_CAST(s AS INTEGER)) AS ints FROM fx_replies))""",
                                      "fx_replies"),
    "parse_selection_reply": with_fx(f"""
SELECT reply_id, regexp_matches(select_reply, {_STATUS}) AS decided, {_CHOICE} AS choice
FROM {_CHOICE_SRC}""", "fx_replies"),
    "selector_decision": with_fx(f"""
SELECT run_id, coalesce(arg_min(choice, reply_id) FILTER (WHERE choice IS NOT NULL), 1) AS final_choice,
       count(choice) AS decided_turns
FROM (SELECT run_id, reply_id, {_CHOICE} AS choice FROM {_CHOICE_SRC}) GROUP BY run_id""", "fx_replies"),
    "split_tool_output": f"""
WITH t AS (
  SELECT event_id,
    CASE WHEN event_type = 'view' THEN 'no status' || chr(10) || 'result ' || CAST(event_id AS VARCHAR(20))
         ELSE 'ran ' || event_type || chr(10) || '  ' ||
              CASE WHEN event_type = 'error' THEN 'Tool Call Status: -1' ELSE 'Tool Call Status: 0' END
              || chr(10) || 'result ' || CAST(event_id AS VARCHAR(20)) END AS text,
    CASE WHEN event_type = 'signup' THEN 'n/a'
         ELSE '  ' || CAST({_K} AS VARCHAR(20)) || chr(10) || CAST({_K} % 3 AS VARCHAR(20)) || '  ' END AS exit_text
  FROM events),
l AS (SELECT *, string_split(text, chr(10)) AS lines FROM t),
p AS (SELECT *, list_position(list_transform(lines, lambda x: starts_with(regexp_replace(x, '^\\s+|\\s+$', '', 'g'),
                                                                          'Tool Call Status:')), true) AS pos
      FROM l)
SELECT event_id,
       array_to_string(list_filter(lines, lambda x, i: i <> coalesce(pos, 0)), chr(10)) AS content,
       coalesce(lines[pos] <> 'Tool Call Status: -1', true) AS success,
       CAST(regexp_extract_all(exit_text, '(?m)^\\s*([0-9]+)\\s*$', 1)[-1] AS BIGINT) AS exit_code
FROM p""",
    "parse_step_labels": with_fx(f"""
SELECT reply_id, CAST(len(tags) AS BIGINT) AS n_tags,
       array_to_string(list_transform(tags, lambda t: {_EMOJI}[list_position({_KNOWN}, t)] || t), ' · ') AS label
FROM (SELECT reply_id,
        CASE WHEN raw <> '' AND list_bool_and(list_transform(ts, lambda t: list_contains({_KNOWN}, t)))
             THEN ts ELSE [] END AS tags
      FROM (SELECT reply_id, raw,
                   list_transform(string_split(raw, ','), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS ts
            FROM (SELECT reply_id, regexp_extract(tag_reply, '<tags>([A-Z_,\\s]+)</tags>', 1) AS raw
                  FROM fx_replies)))""", "fx_replies"),
}
