"""A04 majority vote with early stop.

Votes of a ballot arrive in order ``vote_idx``; voting stops after the first
vote where some id holds more than ``n/2`` of the ``n`` possible votes.  The
winner is the id with most cast votes, ties going to the id seen first; the
winning patch is the one of the winner's first vote.

Order-free formulation: an id can pass ``n/2`` in a prefix only if it holds
a majority of the whole ballot, so the winner is decided by per-(ballot, id)
counts (a partial aggregate).  Only ``votes_cast`` needs positions: it is the
position of the majority id's ``floor(n/2)+1``-th vote, found by a window
over that id's votes in the ballot (at most ``n``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority_vote(votes: DataFrame, ballot: str = "ballot", voted: str = "voted",
                  idx: str = "vote_idx", n: str | int = "n") -> DataFrame:
    """Columns out: ballot, winner, winner_votes, votes_cast, winner_first_vote.

    Plan: a row number per (ballot, id) marks the vote that takes an id past
    n/2 (only the majority id has one); the per-(ballot, id) aggregate shares
    that partitioning, and one per-ballot aggregate picks the winner and the
    stop.  Two exchanges; a (ballot, id) partition holds at most n votes."""
    nn = F.lit(n) if isinstance(n, int) else F.col(n)
    v = votes.select(F.col(ballot).alias("ballot"), F.col(voted).alias("voted"),
                     F.col(idx).alias("vote_idx"), nn.cast("bigint").alias("n"))
    rc = F.row_number().over(Window.partitionBy("ballot", "voted").orderBy("vote_idx"))
    v = v.withColumn("_past_half", rc == F.floor(F.col("n") / 2) + 1)
    per_id = v.groupBy("ballot", "voted").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("vote_idx").alias("first_idx"),
        F.min(F.when(F.col("_past_half"), F.col("vote_idx"))).alias("stop_idx"),
        F.max(F.when(F.col("_past_half"), F.floor(F.col("n") / 2) + 1)).alias("k"))
    per = per_id.groupBy("ballot").agg(
        F.max_by(F.struct("voted", "cnt", "first_idx"),
                 F.struct(F.col("cnt"), -F.col("first_idx"))).alias("w"),
        F.sum("cnt").alias("total"), F.min("stop_idx").alias("stop_idx"), F.max("k").alias("k"))
    return per.select(
        "ballot",
        F.col("w.voted").alias("winner"),
        F.coalesce(F.col("k"), F.col("w.cnt")).cast("bigint").alias("winner_votes"),
        F.coalesce(F.col("stop_idx") + 1, F.col("total")).cast("bigint").alias("votes_cast"),
        F.col("w.first_idx").cast("bigint").alias("winner_first_vote"))


def majority_winner(votes: DataFrame, ballot: str = "ballot", voted: str = "voted",
                    idx: str = "vote_idx") -> DataFrame:
    """Only the winner of each ballot (no ``votes_cast``): two partial
    aggregates, no window.  An id past n/2 has the most votes, so the
    early stop never changes the winner."""
    counts = votes.groupBy(F.col(ballot).alias("ballot"), F.col(voted).alias("voted")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(idx).alias("first_idx"))
    return counts.groupBy("ballot").agg(
        F.max_by("voted", F.struct(F.col("cnt"), -F.col("first_idx"))).alias("winner"))
