"""Sequential-thinking records: validation (P12) and branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import positions, running

# Validation messages, in the order the checks run.
MSG = {
    "thought": "Invalid thought: must be a string",
    "thought_number": "Invalid thought_number: must be a number",
    "total_thoughts": "Invalid total_thoughts: must be a number",
    "next_thought_needed": "Invalid next_thought_needed: must be a boolean",
    "number_min": "thought_number must be at least 1",
    "total_min": "total_thoughts must be at least 1",
    "revises_thought": "revises_thought must be a positive integer",
    "branch_from_thought": "branch_from_thought must be a positive integer",
}


def validate_thoughts(t: DataFrame) -> DataFrame:
    """One ``error`` per bad record (first failing rule), good records
    normalised: ``total_thoughts = greatest(total, number)``, and
    ``revises_thought`` / ``branch_from_thought`` of 0 become null."""
    def opt(c: str, msg: str):
        v = F.col(c) if c in t.columns else F.lit(None).cast("bigint")
        return v, F.when(v.isNotNull() & (v != 0) & (v < 1), F.lit(msg))

    rev, rev_err = opt("revises_thought", MSG["revises_thought"])
    br, br_err = opt("branch_from_thought", MSG["branch_from_thought"])
    n, tot = F.col("thought_number"), F.col("total_thoughts")
    err = F.coalesce(
        F.when(F.col("thought").isNull(), F.lit(MSG["thought"])),
        F.when(n.isNull(), F.lit(MSG["thought_number"])),
        F.when(tot.isNull(), F.lit(MSG["total_thoughts"])),
        F.when(F.col("next_thought_needed").isNull(), F.lit(MSG["next_thought_needed"])),
        F.when(n < 1, F.lit(MSG["number_min"])),
        F.when(tot < 1, F.lit(MSG["total_min"])),
        rev_err, br_err)
    return t.select(
        "*", err.alias("error"),
        F.when(err.isNull(), F.greatest(tot, n)).alias("total_adj"),
        F.when(err.isNull(), F.nullif(rev, F.lit(0))).alias("revises_norm"),
        F.when(err.isNull(), F.nullif(br, F.lit(0))).alias("branch_from_norm"))


def thought_branches(t: DataFrame, session: str = "session_id", pos: str = "pos") -> DataFrame:
    """Per (session, branch): thoughts recorded in the branch (valid ones
    with both a branch origin and a branch id), first and last position."""
    v = validate_thoughts(t).where(F.col("error").isNull())
    # both must be truthy: a set branch origin and a non-empty branch id
    b = v.where(F.col("branch_from_norm").isNotNull() & (F.coalesce(F.col("branch_id"), F.lit("")) != ""))
    return b.groupBy(session, "branch_id").agg(
        F.count(F.lit(1)).alias("n_thoughts"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"))


def branch_thoughts(t: DataFrame, session: str = "session_id", pos: str = "pos") -> DataFrame:
    """The thoughts of every branch in order, one row each (``ord`` from 1)."""
    v = validate_thoughts(t).where(F.col("error").isNull())
    b = v.where(F.col("branch_from_norm").isNotNull() & (F.coalesce(F.col("branch_id"), F.lit("")) != ""))
    out = positions(b.select(session, "branch_id", pos, "thought"), [session, "branch_id"], [pos], out="ord")
    return out.withColumn("ord", F.col("ord") + 1)


def thought_history(t: DataFrame, session: str = "session_id", pos: str = "pos") -> DataFrame:
    """Per valid thought: history length so far and distinct branches so far
    (first thought of each branch found by a partial aggregate; running
    counts chunked per session)."""
    v = validate_thoughts(t).where(F.col("error").isNull())
    is_br = F.col("branch_from_norm").isNotNull() & (F.coalesce(F.col("branch_id"), F.lit("")) != "")
    # one thought per (session, pos), so first-of-branch rows are unique per position
    firsts = (v.where(is_br).groupBy(session, "branch_id").agg(F.min(pos).alias(pos))
              .select(session, pos, F.lit(1).alias("_new")))
    x = v.select(session, pos).join(firsts, [session, pos], "left")
    out = running(x, session, pos, {"history_length": ("count", F.lit(1)), "branches": ("sum", "_new")})
    return out.select(session, pos, F.col("history_length").cast("bigint").alias("history_length"),
                      F.col("branches").cast("bigint").alias("branches"))
