"""Candidate selection end to end (label short-circuit, prune, dedup, vote,
statistics per group) and the single-operator queries of that subject.

Every query reads the whole driver tables through the ``fx_*`` views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import stats as S
from ..functions.replies import selection_choice
from ..operators import testlogs as T
from ..operators.votes import majority_vote, majority_winner
from ..sources.fixtures import fx_candidates, fx_prefix, fx_stats, fx_status, fx_votes, with_fx

GROUP_SIZE = 4


def selection_outcomes(cands: DataFrame, votes: DataFrame, group_size: int = GROUP_SIZE) -> DataFrame:
    """One statistics row per (instance, group): what the selector picked and
    whether it was right.  Short-circuited groups pick candidate 0.

    Plan: a candidate group holds at most ``group_size`` candidates, so the
    label flags (A05) and "some non-blank candidate passed its regression
    tests" (W02) are window aggregates over the group; the vote winner comes
    from two partial aggregates; one aggregate per group then yields either
    the short-circuit row or the pick.  Deduplication (W01) is not a separate
    step here because it cannot change the pick: the first candidate overall
    and the first candidate with the winning key are both the first of their
    key, so both survive deduplication."""
    g = ["instance_id", "grp"]
    w = Window.partitionBy(*g)
    lab, nonblank = F.col("success_id"), F.col("patch").rlike(r"\S")
    c = (cands.withColumn("all_failed", ~F.bool_or(lab == 1).over(w))
         .withColumn("all_success", F.bool_and(lab == 1).over(w))
         .withColumn("known", F.bool_or(lab.isin(0, 1)).over(w))
         .withColumn("any_ok", F.bool_or(F.col("ok") & nonblank).over(w))
         .withColumn("skip", C.skip_flag()))
    eligible = ~F.col("skip") & nonblank & (F.col("ok") | ~F.col("any_ok"))
    winners = majority_winner(votes).withColumnRenamed("ballot", "instance_id")
    miss = F.col("cleaned") != F.coalesce(F.col("winner"), F.lit(""))
    per = (c.join(winners, "instance_id", "left").groupBy(*g).agg(
        F.first("skip").alias("skip"), F.first("all_success").alias("all_success"),
        F.min_by(F.struct("idx", "success_id"),
                 F.when(eligible, F.struct(miss.alias("miss"), F.col("idx")))).alias("p")))
    skip, ok_all = F.col("skip"), F.col("all_success")
    return per.where(skip | F.col("p").isNotNull()).select(
        F.concat(F.lit("group_"), F.col("grp").cast("string")).alias("group_id"), "instance_id",
        F.when(skip, F.lit(0)).otherwise(F.col("p.idx") - F.col("grp") * group_size).cast("bigint")
        .alias("patch_id"),
        F.when(skip, F.when(ok_all, 1).otherwise(0))
        .otherwise(F.col("p.success_id")).cast("bigint").alias("is_success"),
        (skip & ok_all).alias("is_all_success"), (skip & ~ok_all).alias("is_all_failed"))


def selection_report(cands: DataFrame, votes: DataFrame, total_num_instances: int = 500) -> DataFrame:
    rep = S.group_statistics(selection_outcomes(cands, votes), total_num_instances)
    return S.rank_groups(S.best_group(rep))


# -- registered queries ------------------------------------------------------
def q_selection_report(spark: SparkSession, d: str) -> DataFrame:
    return selection_report(fx_candidates(spark, d), fx_votes(spark, d))


def q_dedup_candidates(spark, d):
    return C.dedup_candidates(fx_candidates(spark, d)).select("instance_id", "grp", "idx", "cleaned")


def q_prune_or_keep_all(spark, d):
    return C.prune_or_keep_all(fx_candidates(spark, d)).select("instance_id", "grp", "idx", "ok")


def q_prune_then_dedup(spark, d):
    c = C.dedup_candidates(C.prune_or_keep_all(fx_candidates(spark, d)))
    return c.select("instance_id", "grp", "idx", "cleaned")


def q_label_short_circuit(spark, d):
    return C.label_short_circuit(fx_candidates(spark, d))


def q_majority_vote(spark, d):
    return majority_vote(fx_votes(spark, d))


def q_group_statistics(spark, d):
    return S.group_statistics(fx_stats(spark, d))


def q_best_group(spark, d):
    return S.best_group(S.group_statistics(fx_stats(spark, d)))


def q_rank_groups(spark, d):
    return S.rank_groups(S.group_statistics(fx_stats(spark, d))).select(
        "group_id", "success_rate_among_all", "rank")


def q_explode_candidates(spark, d):
    """P06 over arrays: candidate sets as the files hold them, exploded with
    their indexes, blank patches dropped, none cut off."""
    c = fx_candidates(spark, d)
    at = lambda f: F.transform(F.array_sort(F.collect_list(F.struct("idx", "patch", "success_id", F.col("ok").alias("good")))), f)
    sets = c.groupBy("instance_id").agg(
        at(lambda x: x["patch"]).alias("patches"), at(lambda x: x["success_id"]).alias("success_id"),
        at(lambda x: F.when(x["good"], F.array().cast("array<string>")).otherwise(F.array(F.lit("t")))).alias("regressions"))
    return C.explode_candidates(sets).select("instance_id", "idx", "success_id", "ok")


def q_candidate_counts(spark, d):
    return C.candidate_counts(fx_candidates(spark, d))


def q_propagate_to_duplicates(spark, d):
    c = fx_candidates(spark, d)
    reps = C.dedup_candidates(c, ["instance_id"]).select(
        "instance_id", "cleaned", F.col("idx").alias("rep_idx"),
        F.when(F.col("ok"), 0).otherwise(1).cast("bigint").alias("failed"))
    return C.propagate_to_duplicates(c, reps, value_cols=["rep_idx", "failed"]).select(
        "instance_id", "idx", "rep_idx", "failed")


def pruning(cands: DataFrame, selected: DataFrame, runs: DataFrame) -> DataFrame:
    """The regression-pruning pipeline: copies by normalised key, failed tests
    of each representative (all of them where its patch did not apply), the
    counts handed on to its copies, and per group the candidates without a
    failure, or all where none is without."""
    k = ["instance_id", "idx"]
    reps = C.dedup_candidates(cands, ["instance_id"])
    tests = reps.select(*k).join(selected, "instance_id")
    failed = T.failed_regressions(tests, runs, k, apply_failed=reps.where(~F.col("ok")))
    counts = failed.groupBy(*k).agg(F.count(F.lit(1)).alias("failed"))
    done = reps.join(counts, k, "left").select("instance_id", "idx", "cleaned", F.coalesce("failed", F.lit(0)).alias("failed"))
    out = C.propagate_to_duplicates(cands, done).withColumn("ok", F.col("failed") == 0)
    return C.prune_or_keep_all(out)


def q_regression_pruning(spark, d):
    st = fx_status(spark, d)
    latest = T.latest_status(st.where(F.col("phase") == "validate"), ["instance_id"])
    cands = fx_candidates(spark, d)
    # every representative runs the tests: those of odd index recover from errors
    reps = C.dedup_candidates(cands, ["instance_id"]).select("instance_id", "idx")
    better = F.when((F.col("idx") % 2 == 1) & (F.col("status") == "ERROR"), "PASSED").otherwise(F.col("status"))
    runs = reps.join(latest, "instance_id").withColumn("status", better)
    return pruning(cands, T.passing_tests(st), runs).select("instance_id", "grp", "idx", "failed")


def select_by_replies(cands: DataFrame, replies: DataFrame) -> DataFrame:
    """Selection inside each candidate group: a reply's ``Patch-x`` is the x-th
    candidate of the group's pruned and deduplicated list (out of range: the
    first), the most chosen one wins (ties: the one chosen first), and a group
    without a decided reply keeps the first of its list.

    ``replies``: instance_id, grp, vote_idx, reply."""
    g = ["instance_id", "grp"]
    listed = C.dedup_candidates(C.prune_or_keep_all(cands))
    listed = listed.withColumn("place", F.row_number().over(Window.partitionBy(*g).orderBy("idx")))
    sizes = listed.groupBy(*g).agg(F.count(F.lit(1)).cast("int").alias("size"))
    votes = (replies.join(sizes, g).withColumn("voted", selection_choice(F.col("reply"), F.col("size")))
             .where(F.col("voted").isNotNull()).withColumn("ballot", F.struct(*g)))
    winners = majority_winner(votes).select("ballot.*", "winner")
    return (listed.join(winners, g, "left").where(F.col("place") == F.coalesce("winner", F.lit(1)))
            .select(*g, "idx", "place", F.col("winner").isNotNull().alias("decided")))


def q_selection_by_replies(spark, d):
    c = fx_candidates(spark, d)
    k = F.col("order_key")
    text = F.when(k % 4 == 0, F.lit("no decision")).otherwise(F.concat(
        F.lit("### Status: succeed\n### Result: Patch-"), (k % 6).cast("string"), F.lit("\n### Analysis: ok")))
    return select_by_replies(c, c.select("instance_id", "grp", F.col("idx").alias("vote_idx"), text.alias("reply")))


QUERIES = {
    "regression_pruning": q_regression_pruning,
    "selection_by_replies": q_selection_by_replies,
    "selection_report": q_selection_report,
    "dedup_candidates": q_dedup_candidates,
    "prune_or_keep_all": q_prune_or_keep_all,
    "prune_then_dedup": q_prune_then_dedup,
    "label_short_circuit": q_label_short_circuit,
    "majority_vote": q_majority_vote,
    "group_statistics": q_group_statistics,
    "best_group": q_best_group,
    "rank_groups": q_rank_groups,
    "explode_candidates": q_explode_candidates,
    "candidate_counts": q_candidate_counts,
    "propagate_to_duplicates": q_propagate_to_duplicates,
}

# -- DuckDB oracles ----------------------------------------------------------
_VOTE_SQL = """
v AS (SELECT *, count(*) OVER (PARTITION BY ballot, voted ORDER BY vote_idx
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rc
      FROM fx_votes),
stops AS (SELECT ballot, min(vote_idx) AS stop FROM v WHERE rc * 2 > n GROUP BY ballot),
cast_votes AS (SELECT v.* FROM v LEFT JOIN stops s USING (ballot)
               WHERE s.stop IS NULL OR v.vote_idx <= s.stop),
cnt AS (SELECT ballot, voted, count(*) AS c, min(vote_idx) AS first_idx FROM cast_votes
        GROUP BY ballot, voted),
tot AS (SELECT ballot, count(*) AS votes_cast FROM cast_votes GROUP BY ballot),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ballot ORDER BY c DESC, first_idx) AS r
           FROM cnt),
votes_out AS (SELECT r.ballot, r.voted AS winner, r.c AS winner_votes, t.votes_cast,
                     r.first_idx AS winner_first_vote
              FROM ranked r JOIN tot t USING (ballot) WHERE r.r = 1)"""

_GROUP_STATS_SQL = """
SELECT group_id, count(*) AS total, count(*)::DOUBLE / 500 AS completion_rate,
       count(*) FILTER (WHERE is_all_success) AS all_success,
       count(*) FILTER (WHERE is_all_failed) AS all_failed,
       count(*) FILTER (WHERE NOT is_all_success AND NOT is_all_failed) AS need_to_select,
       count(*) FILTER (WHERE is_success = 1) AS success_selection,
       count(*) FILTER (WHERE NOT is_all_success AND NOT is_all_failed AND is_success = 1)
         AS success_selection_in_need_to_select,
       CASE WHEN count(*) FILTER (WHERE NOT is_all_success AND NOT is_all_failed) > 0
            THEN (count(*) FILTER (WHERE NOT is_all_success AND NOT is_all_failed AND is_success = 1))::DOUBLE
                 / count(*) FILTER (WHERE NOT is_all_success AND NOT is_all_failed)
            ELSE 0.0 END AS success_rate_in_need_to_select,
       (count(*) FILTER (WHERE is_success = 1))::DOUBLE / count(*) AS success_rate_among_all
FROM {src} GROUP BY group_id"""

_BEST_SQL = """
SELECT *,
  (row_number() OVER (ORDER BY success_rate_in_need_to_select DESC, success_rate_among_all DESC, group_id) = 1
   AND success_rate_in_need_to_select > 0) AS best_in_need_to_select,
  (row_number() OVER (ORDER BY success_rate_among_all DESC, success_rate_among_all DESC, group_id) = 1
   AND success_rate_among_all > 0) AS best_among_all
FROM {src}"""

_LABELS_SQL = """
SELECT instance_id, grp,
       NOT bool_or(success_id = 1) AS all_failed, bool_and(success_id = 1) AS all_success,
       bool_or(success_id IN (0, 1)) AS known
FROM fx_candidates GROUP BY instance_id, grp"""

_SELECTION_SQL = f"""
, {_VOTE_SQL.strip()},
flags AS (SELECT *, known AND (all_failed OR all_success) AS skip FROM ({_LABELS_SQL})),
live AS (SELECT c.* FROM fx_candidates c JOIN flags f USING (instance_id, grp)
         WHERE NOT f.skip AND regexp_matches(c.patch, '\\S')),
anyok AS (SELECT instance_id, grp, bool_or(ok) AS any_ok FROM live GROUP BY instance_id, grp),
pruned AS (SELECT l.* FROM live l JOIN anyok a USING (instance_id, grp) WHERE l.ok OR NOT a.any_ok),
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, grp, cleaned ORDER BY idx) AS r
                         FROM pruned) WHERE r = 1),
pick AS (SELECT * FROM (
           SELECT d.*, row_number() OVER (PARTITION BY d.instance_id, d.grp
                     ORDER BY (d.cleaned <> coalesce(w.winner, '')), d.idx) AS r2
           FROM dedup d LEFT JOIN votes_out w ON d.instance_id = w.ballot) WHERE r2 = 1),
outcomes AS (
  SELECT 'group_' || CAST(grp AS VARCHAR(20)) AS group_id, instance_id, CAST(0 AS BIGINT) AS patch_id,
         CAST(CASE WHEN all_success THEN 1 ELSE 0 END AS BIGINT) AS is_success,
         all_success AS is_all_success, NOT all_success AS is_all_failed
  FROM flags WHERE skip
  UNION ALL
  SELECT 'group_' || CAST(grp AS VARCHAR(20)), instance_id, idx - grp * 4,
         success_id, false, false
  FROM pick),
rep AS ({_GROUP_STATS_SQL.format(src='outcomes')}),
best AS ({_BEST_SQL.format(src='rep')})
SELECT *, row_number() OVER (ORDER BY success_rate_among_all DESC, group_id) AS rank FROM best"""

ORACLE = {
    "regression_pruning": fx_prefix("fx_candidates", "fx_status") + """,
lst AS (SELECT instance_id, test, phase, arg_max(status, (s_d, s_o, s_l, s_p, s_f)) AS status FROM fx_status GROUP BY ALL),
sel AS (SELECT instance_id, test FROM lst WHERE phase = 'find_passing' AND status = 'PASSED'),
reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, cleaned ORDER BY idx) AS r
                        FROM fx_candidates) WHERE r = 1),
fails AS (SELECT r.instance_id, r.cleaned, count(*) FILTER (WHERE s.test IS NOT NULL AND (NOT r.ok
            OR CASE WHEN r.idx % 2 = 1 AND v.status = 'ERROR' THEN 'PASSED' ELSE v.status END IS DISTINCT FROM 'PASSED')) AS failed
          FROM reps r LEFT JOIN sel s ON r.instance_id = s.instance_id
          LEFT JOIN lst v ON v.phase = 'validate' AND v.instance_id = s.instance_id AND v.test = s.test
          GROUP BY r.instance_id, r.cleaned),
all_ AS (SELECT c.instance_id, c.grp, c.idx, f.failed FROM fx_candidates c JOIN fails f USING (instance_id, cleaned))
SELECT instance_id, grp, idx, failed
FROM (SELECT *, bool_or(failed = 0) OVER (PARTITION BY instance_id, grp) AS any_ok FROM all_) WHERE failed = 0 OR NOT any_ok""",
    "selection_by_replies": fx_prefix("fx_candidates") + """,
pruned AS (SELECT * FROM (SELECT *, bool_or(ok) OVER (PARTITION BY instance_id, grp) AS any_ok FROM fx_candidates)
           WHERE ok OR NOT any_ok),
listed AS (SELECT *, row_number() OVER (PARTITION BY instance_id, grp ORDER BY idx) AS place,
                  count(*) OVER (PARTITION BY instance_id, grp) AS size
           FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, grp, cleaned ORDER BY idx) AS r FROM pruned) WHERE r = 1),
sizes AS (SELECT DISTINCT instance_id, grp, size FROM listed),
votes AS (SELECT c.instance_id, c.grp, c.idx, CASE WHEN c.order_key % 6 BETWEEN 1 AND s.size THEN c.order_key % 6 ELSE 1 END AS v
          FROM fx_candidates c JOIN sizes s USING (instance_id, grp) WHERE c.order_key % 4 <> 0),
won AS (SELECT instance_id, grp, v FROM (
          SELECT *, row_number() OVER (PARTITION BY instance_id, grp ORDER BY n DESC, f) AS r
          FROM (SELECT instance_id, grp, v, count(*) AS n, min(idx) AS f FROM votes GROUP BY ALL)) WHERE r = 1)
SELECT l.instance_id, l.grp, l.idx, l.place, w.v IS NOT NULL AS decided
FROM listed l LEFT JOIN won w USING (instance_id, grp) WHERE l.place = coalesce(w.v, 1)""",
    "selection_report": fx_prefix("fx_candidates", "fx_votes") + _SELECTION_SQL,
    "dedup_candidates": with_fx("""
SELECT instance_id, grp, idx, cleaned FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_id, grp, cleaned ORDER BY idx) AS r
  FROM fx_candidates) WHERE r = 1""", "fx_candidates"),
    "prune_or_keep_all": with_fx("""
SELECT instance_id, grp, idx, ok FROM (
  SELECT *, bool_or(ok) OVER (PARTITION BY instance_id, grp) AS any_ok FROM fx_candidates)
WHERE ok OR NOT any_ok""", "fx_candidates"),
    "prune_then_dedup": with_fx("""
SELECT instance_id, grp, idx, cleaned FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_id, grp, cleaned ORDER BY idx) AS r
  FROM (SELECT *, bool_or(ok) OVER (PARTITION BY instance_id, grp) AS any_ok FROM fx_candidates)
  WHERE ok OR NOT any_ok) WHERE r = 1""", "fx_candidates"),
    "label_short_circuit": with_fx(
        f"SELECT *, known AND (all_failed OR all_success) AS skip FROM ({_LABELS_SQL})", "fx_candidates"),
    "majority_vote": fx_prefix("fx_votes") + ",\n" + _VOTE_SQL.strip() + "\nSELECT * FROM votes_out",
    "group_statistics": with_fx(_GROUP_STATS_SQL.format(src="fx_stats"), "fx_stats"),
    "best_group": with_fx(_BEST_SQL.format(src=f"({_GROUP_STATS_SQL.format(src='fx_stats')})"),
                          "fx_stats"),
    "rank_groups": with_fx(f"""
SELECT group_id, success_rate_among_all,
       row_number() OVER (ORDER BY success_rate_among_all DESC, group_id) AS rank
FROM ({_GROUP_STATS_SQL.format(src='fx_stats')})""", "fx_stats"),
    "explode_candidates": with_fx("""
SELECT instance_id, idx, success_id, ok FROM fx_candidates
WHERE regexp_matches(patch, '\\S')""", "fx_candidates"),
    "candidate_counts": with_fx("""
SELECT instance_id, count(*) AS candidates, count(DISTINCT cleaned) AS unique_candidates,
       count(*) FILTER (WHERE ok) AS passing, count(*) FILTER (WHERE NOT ok) AS failing
FROM fx_candidates GROUP BY instance_id""", "fx_candidates"),
    "propagate_to_duplicates": with_fx("""
SELECT c.instance_id, c.idx, r.idx AS rep_idx, CAST(CASE WHEN r.ok THEN 0 ELSE 1 END AS BIGINT) AS failed
FROM fx_candidates c JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, cleaned ORDER BY idx) AS r
                 FROM fx_candidates) WHERE r = 1) r
  ON c.instance_id = r.instance_id AND c.cleaned = r.cleaned""", "fx_candidates"),
}
