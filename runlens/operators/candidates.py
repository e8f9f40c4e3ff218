"""Candidate-patch operators: explode, prune, dedup, label short-circuit,
counts, batching and resumable work lists.

A candidate row carries ``instance_id``, its index ``idx`` inside the
instance, the normalised patch key (``cleaned``), its label ``success_id``
(1 right, 0 wrong, -1 unknown) and ``ok`` (no failed regression test).
Per-key results (label flags, first of each key, counts) are grouped
aggregates, combined map-side before the shuffle, so a hot key is never
buffered whole in one task; the one window (W02) runs over a candidate
group, whose size the group size bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import positions


def _cols(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# -- P06 ---------------------------------------------------------------------
def explode_candidates(sets: DataFrame, num_candidate: int | None = None,
                       id_col: str = "instance_id") -> DataFrame:
    """Candidate sets (parallel arrays ``patches``, ``regressions``,
    ``success_id``) -> one row per candidate with its original index.

    Missing ``regressions`` means one empty list per patch.  The set is
    truncated to ``num_candidate``; blank patches (whitespace only) are
    dropped *after* indexing so indexes keep their meaning."""
    regs = F.coalesce(F.col("regressions"),
                      F.transform(F.col("patches"), lambda _: F.array().cast("array<string>")))
    sid = F.coalesce(F.col("success_id"),
                     F.transform(F.col("patches"), lambda _: F.lit(-1)))
    z = sets.select(id_col, F.posexplode(F.arrays_zip(
        F.col("patches").alias("patch"), regs.alias("regressions"), sid.alias("success_id"))))
    out = z.select(id_col, F.col("pos").cast("bigint").alias("idx"), "col.patch",
                   "col.regressions", F.col("col.success_id").cast("bigint").alias("success_id"),
                   (F.coalesce(F.size("col.regressions"), F.lit(0)) <= 0).alias("ok"))
    return keep_candidates(out, num_candidate)


def keep_candidates(cands: DataFrame, num_candidate: int | None = None) -> DataFrame:
    """Row-level half of P06: drop whitespace-only patches (Python
    ``str.strip() == ''``).  With ``num_candidate`` the set is cut at that
    index first, and ``dropped`` says how many of the instance that cut off."""
    c = cands
    if num_candidate is not None:
        id_col = c.columns[0]
        past = F.greatest(F.max("idx") + 1 - num_candidate, F.lit(0)).cast("bigint").alias("dropped")
        c = c.where(F.col("idx") < F.lit(num_candidate)).join(c.groupBy(id_col).agg(past), id_col)
    return c.where(F.col("patch").rlike(r"(?U)[^\s\x1C-\x1F]"))


# -- W02 ---------------------------------------------------------------------
def prune_or_keep_all(cands: DataFrame, group: Sequence[str] | str = ("instance_id", "grp"),
                      ok: str = "ok") -> DataFrame:
    """Keep candidates with no failed regression test; when none in a group
    qualifies keep the whole group."""
    g = _cols(group)
    # a candidate group holds at most group_size / num_candidate rows, so a
    # window over it is bounded; it needs no exchange when the candidates are
    # already partitioned by instance
    any_ok = F.bool_or(F.col(ok)).over(Window.partitionBy(*g))
    return cands.withColumn("_any_ok", any_ok).where(F.col(ok) | ~F.col("_any_ok")).drop("_any_ok")


# -- W01 ---------------------------------------------------------------------
def dedup_candidates(cands: DataFrame, group: Sequence[str] | str = ("instance_id", "grp"),
                     key: str = "cleaned", order: str = "idx") -> DataFrame:
    """Keep the first candidate (lowest ``order``) per normalised key; a
    candidate without a key (its patch could not be read) is a class of its
    own.

    Written as ``min_by`` in a grouped aggregate: Spark combines partial
    minima map-side, so a hot key never lands whole in one task."""
    g = _cols(group) + [key]
    own = F.when(F.col(key).isNull(), F.col(order)).alias("_own")
    rest = [c for c in cands.columns if c not in g]
    agg = cands.groupBy(*g, own).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return agg.select(*g, "_r.*").select(*cands.columns)


# -- J01 ---------------------------------------------------------------------
def propagate_to_duplicates(cands: DataFrame, reps: DataFrame,
                            keys: Sequence[str] = ("instance_id",), key: str = "cleaned",
                            value_cols: Sequence[str] = ("failed",), order: str = "idx") -> DataFrame:
    """Every candidate inherits the result columns of the representative of
    its normalised key (representatives come from ``dedup_candidates`` and
    were the only ones tested).  A candidate without a key has its own result,
    found by ``order``.  Row count of ``cands`` is kept."""
    k = list(keys) + [key]
    if order not in cands.columns or order not in reps.columns:
        return cands.join(reps.select(*k, *value_cols), k, "left")
    # one equi-join for both: the key, or the place of a candidate without one
    own = F.when(F.col(key).isNull(), F.col(order))
    r = reps.select(*[F.col(c).alias(f"_r_{c}") for c in k], own.alias("_r_own"), *value_cols)
    c = cands.withColumn("_own", own)
    same = F.lit(True)
    for x in k:
        same = same & F.col(x).eqNullSafe(F.col(f"_r_{x}"))
    j = c.join(r, same & F.col("_own").eqNullSafe(F.col("_r_own")), "left")
    return j.drop("_own", "_r_own", *[f"_r_{x}" for x in k])


# -- A05 ---------------------------------------------------------------------
def label_flag_aggs(label: str = "success_id") -> list[Column]:
    """Aggregates behind A05 (usable inside a larger ``agg``)."""
    lab = F.col(label)
    return [(~F.bool_or(lab == 1)).alias("all_failed"), F.bool_and(lab == 1).alias("all_success"),
            F.bool_or(lab.isin(0, 1)).alias("known")]


def skip_flag() -> Column:
    return F.col("known") & (F.col("all_failed") | F.col("all_success"))


def label_short_circuit(cands: DataFrame, group: Sequence[str] | str = ("instance_id", "grp"),
                        label: str = "success_id") -> DataFrame:
    """Per candidate group: skip selection iff some label is known (0/1) and
    either no label is 1 (all failed) or every label is 1 (all success).
    A skipped group selects candidate 0."""
    g = _cols(group)
    return cands.groupBy(*g).agg(*label_flag_aggs(label)).withColumn("skip", skip_flag())


# -- A09 ---------------------------------------------------------------------
def candidate_counts(cands: DataFrame, instance: str = "instance_id",
                     key: str = "cleaned", ok: str = "ok") -> DataFrame:
    """Per instance: candidates, unique candidates (by normalised key) and
    how many pass / fail their regression tests."""
    return cands.groupBy(instance).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_distinct(key).alias("unique_candidates"),
        F.count_if(F.col(ok)).cast("bigint").alias("passing"),
        F.count_if(~F.col(ok)).cast("bigint").alias("failing"))


# -- W08 ---------------------------------------------------------------------
def batch_and_stride(items: DataFrame, key: Sequence[str] | str, order: Sequence[str] | str,
                     batch_size: int = 2000, group_size: int | None = None,
                     shards: int | None = None) -> DataFrame:
    """Position ``pos`` (0-based, per key) plus contiguous batch number
    ``pos div batch_size``, group number and index restarting per group
    (``pos div group_size``), and strided shard ``pos mod k`` with
    ``k = max(1, min(shards, #items))``."""
    k = _cols(key)
    # exact positions without a per-key window (see scan.positions)
    out = positions(items, k, _cols(order))
    out = out.withColumn("batch", F.floor(F.col("pos") / batch_size).cast("bigint"))
    if group_size:
        out = (out.withColumn("group_no", F.floor(F.col("pos") / group_size).cast("bigint"))
               .withColumn("group_idx", F.pmod(F.col("pos"), F.lit(group_size)).cast("bigint")))
    if shards:
        n = items.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
        kk = F.greatest(F.lit(1), F.least(F.lit(shards), F.col("_n")))
        out = out.join(n, k).withColumn("shard", F.pmod(F.col("pos"), kk).cast("bigint")).drop("_n")
    return out


def render_batches(items: DataFrame, key: Sequence[str] | str, name: str = "name") -> DataFrame:
    """One numbered text per (key, batch): ``i. name`` lines, i from 0 inside
    the batch.  Batches are bounded by ``batch_size``, so the ordered
    ``collect_list`` holds at most one batch."""
    k = _cols(key) + ["batch"]
    g = items.groupBy(*k).agg(
        F.min("pos").alias("_p0"),
        F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(name).alias("n")))).alias("_l"))
    txt = F.array_join(F.transform(
        "_l", lambda x: F.concat((x["pos"] - F.col("_p0")).cast("string"), F.lit(". "), x["n"])),
        "\n")
    return g.select(*k, F.size("_l").cast("bigint").alias("n_items"), txt.alias("text"))


# -- T03 ---------------------------------------------------------------------
def seeded_sample(items: DataFrame, key: Sequence[str] | str, item: str, k: int,
                  seed: str = "0", dropped: str | None = None) -> DataFrame:
    """Exactly ``min(k, n)`` items per key, stable for a seed: rank items by
    ``md5(seed || key || item)`` (ties by item) and keep the first k.  The
    window group limit lets Spark cut each partition to k before the sort.
    ``dropped`` names a column for the number of items of the key left out."""
    kc = _cols(key)
    h = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in kc],
                          F.col(item).cast("string")))
    w = Window.partitionBy(*kc).orderBy(h, F.col(item))
    kept = items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return kept if dropped is None else with_dropped(kept, items, kc, k, dropped)


def with_dropped(kept: DataFrame, items: DataFrame, key: Sequence[str], k: int, out: str) -> DataFrame:
    """How many of the key's items a limit of ``k`` left out."""
    n = items.groupBy(*key).agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).cast("bigint").alias(out))
    return kept.join(n, list(key))


# -- U01 ---------------------------------------------------------------------
def union_batches(*selections: DataFrame) -> DataFrame:
    """Union-all of per-batch selections (no dedup across batches; the cap
    and sample come after)."""
    out = selections[0]
    for s in selections[1:]:
        out = out.unionByName(s)
    return out


# -- J04 / K02 ---------------------------------------------------------------
def pending_instances(wanted: DataFrame, done: DataFrame, key: str = "instance_id",
                      complete: Column | None = None) -> DataFrame:
    """Work not yet complete: ``wanted`` rows whose key has no complete row
    in ``done`` (``complete`` is the completion test, e.g.
    ``size(patches) >= N`` or ``regression_done``)."""
    d = done if complete is None else done.where(complete)
    return wanted.join(d.select(key).distinct(), key, "left_anti")


# -- J03 ---------------------------------------------------------------------
def instances_with_candidates(instances: DataFrame, cands: DataFrame,
                              key: str = "instance_id", passthrough: bool = False) -> DataFrame:
    """Selector mode (``passthrough=False``): inner join, every instance must
    have candidates (see ``missing_candidates``).  Tester mode: candidates
    whose instance is absent pass through unchanged, flagged ``supported``."""
    if not passthrough:
        return cands.join(instances, key, "inner")
    inst = instances.withColumn("supported", F.lit(True))
    return (cands.join(inst, key, "left")
            .withColumn("supported", F.coalesce(F.col("supported"), F.lit(False))))


def missing_candidates(instances: DataFrame, cands: DataFrame, key: str = "instance_id"):
    """Instances with no candidate entry (a ``KeyError`` in the reference)."""
    return instances.join(cands.select(key), key, "left_anti")


# -- F05 + W08 + T03 + U01: regression-test selection -------------------------
def select_regression_tests(batched: DataFrame, replies: DataFrame, k: int = 50, cap: int | None = None,
                            key: str = "instance_id", item: str = "test") -> DataFrame:
    """The tests kept for regression checking, per instance.

    ``batched`` comes from :func:`batch_and_stride` (``pos``, ``batch``);
    ``replies`` holds one model reply per (instance, batch).  A reply's
    in-range integers pick tests of its batch (F05); a batch without a
    usable pick falls back to a seeded sample of ``min(k, size)`` of its
    tests (T03); the per-batch selections are unioned (U01).  With ``cap`` an
    instance with more tests is sampled down to ``cap``, and ``dropped`` says
    how many that left out.

    Plan: one window over each batch (bounded by the batch size) gives a
    test's index in its batch and the batch size; the parsed replies join in
    once on (instance, batch); picks and fallback are filters of that one
    frame."""
    from ..functions.replies import reply_integers  # local: functions import operators

    wb = Window.partitionBy(key, "batch")
    b = (batched.withColumn("_li", F.col("pos") - F.min("pos").over(wb))
         .withColumn("_n", F.count(F.lit(1)).over(wb)))
    # the reply is parsed once per batch, before it meets the batch's tests
    r = replies.select(key, "batch", reply_integers(F.col("reply")).alias("_ints"))
    x = (b.join(r, [key, "batch"], "left")
         .withColumn("_ints", F.coalesce(F.col("_ints"), F.array().cast("array<int>"))))
    picked = x.where(F.array_contains(F.col("_ints"), F.col("_li").cast("int"))).withColumn(
        "source", F.lit("reply"))
    no_pick = ~F.exists(F.col("_ints"), lambda i: i < F.col("_n"))
    fallback = seeded_sample(x.where(no_pick), [key, "batch"], item, k, seed="batch").withColumn(
        "source", F.lit("fallback"))
    cols = [key, "batch", item, "source"]
    chosen = union_batches(picked.select(*cols), fallback.select(*cols))
    return chosen if cap is None else seeded_sample(chosen, key, item, cap, seed="cap", dropped="dropped")
