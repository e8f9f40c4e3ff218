"""Column functions that read model replies and tool output.

All are built-in expressions (regex, higher-order array functions,
``try_cast``), so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.messages import strip

# Step tags and their emoji, as shown in step labels.
TAG_EMOJI = {
    "WRITE_TEST": "☑️",
    "VERIFY_TEST": "✅",
    "EXAMINE_CODE": "👁️",
    "WRITE_FIX": "📝",
    "VERIFY_FIX": "🔥",
    "REPORT": "📣",
    "THINK": "🧠",
    "OUTLIER": "⁉️",
}
# Reply patterns.
TAGS_RE = r"<tags>([A-Z_,\s]+)</tags>"
STATUS_RE = r"(?:###\s*)?Status:\s*(success|succeed|successfully|successful)\s*\n\s*(?:###\s*)?Result:"
RESULT_RE = r"(?:###\s*)?Result:\s*(.+?)\s*(?:###\s*)?Analysis:"
EXIT_CODE_RE = r"(?m)^\s*([0-9]+)\s*$"
STATUS_PREFIX = "Tool Call Status:"
FAILED_STATUS_LINE = "Tool Call Status: -1"


# -- F05 ---------------------------------------------------------------------
def reply_integers(reply: Column) -> Column:
    """All integers in a free-text reply that fit an int, first occurrence
    order, deduplicated.  A truncated array still parses; an overflowing
    integer is dropped (``try_cast``)."""
    ints = F.transform(F.regexp_extract_all(reply, F.lit(r"(\d+)"), 1), lambda s: s.try_cast("int"))
    return F.array_distinct(F.filter(ints, lambda i: i.isNotNull()))


def parse_index_selection(reply: Column, batch_size: Column | int) -> Column:
    """The reply's integers that index into a batch of ``batch_size`` names."""
    n = F.lit(batch_size) if isinstance(batch_size, int) else batch_size
    return F.filter(reply_integers(reply), lambda i: (i >= 0) & (i < n))


def pick_names(indexes: Column, names: Column) -> Column:
    """Map 0-based indexes to the batch's names."""
    # try_: an index past a short name list gives null instead of failing (ANSI)
    return F.transform(indexes, lambda i: F.try_element_at(names, i + 1))


# -- F06 ---------------------------------------------------------------------
def selection_decided(reply: Column) -> Column:
    return reply.rlike(STATUS_RE)


def selection_choice(reply: Column, n_candidates: Column | int) -> Column:
    """1-based candidate chosen by a final-answer reply: ``Result: Patch-x``
    on one line before ``Analysis:``; x outside 1..n picks candidate 1.  Null
    when the reply is undecided (no status line, or no one-line result)."""
    n = F.lit(n_candidates) if isinstance(n_candidates, int) else n_candidates
    res = F.regexp_extract(reply, RESULT_RE, 1)
    has_res = reply.rlike(RESULT_RE)
    tail = F.substring_index(strip(res), "Patch-", -1)
    x = tail.try_cast("int")
    valid = tail.rlike(r"^[1-9][0-9]*$") & x.isNotNull() & (x >= 1) & (x <= n)
    choice = F.when(valid, x).otherwise(F.lit(1))
    return F.when(selection_decided(reply) & has_res, choice)


# -- F07 ---------------------------------------------------------------------
def split_tool_output(text: Column) -> Column:
    """Struct (content, success): the first line starting (after strip) with
    ``Tool Call Status:`` is removed; success unless that line is exactly
    ``Tool Call Status: -1`` (no status line counts as success)."""
    lines = F.split(text, "\n", -1)
    flags = F.transform(lines, lambda ln: F.startswith(strip(ln), F.lit(STATUS_PREFIX)))
    pos = F.array_position(flags, F.lit(True))  # 1-based, 0 = none
    kept = F.filter(lines, lambda ln, i: (i + 1) != pos)
    status_line = F.when(pos > 0, F.element_at(lines, pos.cast("int")))
    return F.struct(F.array_join(kept, "\n").alias("content"),
                    F.coalesce(status_line != F.lit(FAILED_STATUS_LINE), F.lit(True)).alias("success"))


def exit_code(exit_text: Column) -> Column:
    """Last digits-only line of the captured exit text; null (an error in
    the reference) when there is none."""
    codes = F.regexp_extract_all(exit_text, F.lit(EXIT_CODE_RE), 1)
    return F.try_element_at(codes, F.lit(-1)).cast("bigint")


# -- F08 ---------------------------------------------------------------------
def step_tags(reply: Column) -> Column:
    """Tags of a tagging reply: the first ``<tags>..</tags>``, split on
    commas and stripped; empty unless every tag is known (the reference
    raises on a reply without tags; we return empty)."""
    raw = F.regexp_extract(reply, TAGS_RE, 1)
    tags = F.transform(F.split(raw, ","), lambda t: strip(t))
    known = F.array(*[F.lit(t) for t in TAG_EMOJI])
    ok = (raw != "") & F.forall(tags, lambda t: F.array_contains(known, t))
    return F.when(ok, tags).otherwise(F.array().cast("array<string>"))


def step_label(tags: Column, emoji: bool = True) -> Column:
    """``emoji+TAG`` joined by `` · ``."""
    m = F.create_map(*[x for k, v in TAG_EMOJI.items() for x in (F.lit(k), F.lit(v))])
    if not emoji:
        return F.array_join(tags, " · ")
    return F.array_join(F.transform(tags, lambda t: F.concat(F.element_at(m, t), t)), " · ")


def task_description(reply: Column) -> Column:
    """Struct (task, details): text before the last ``</task>`` and the rest
    with ``<details>`` turned into ``[italic]`` markers; both empty if any of
    ``</task>``, ``<details>``, ``</details>`` is missing."""
    c = strip(reply)
    ok = F.contains(c, F.lit("</task>")) & F.contains(c, F.lit("<details>")) & F.contains(c, F.lit("</details>"))
    # text before the last "</task>": drop the part after it
    after = F.substring_index(c, "</task>", -1)
    task = F.substring(c, F.lit(1), F.length(c) - F.length(after) - F.lit(7))
    details = F.replace(F.replace(after, F.lit("<details>"), F.lit("[italic]")),
                        F.lit("</details>"), F.lit("[/italic]"))
    return F.struct(F.when(ok, task).otherwise(F.lit("")).alias("task"),
                    F.when(ok, details).otherwise(F.lit("")).alias("details"))
