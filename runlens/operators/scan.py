"""Running aggregates per key that stay skew-safe.

A window partitioned by key puts every row of a key into one task; with one
run, log or conversation holding a third of all rows that task holds a third
of the data.  ``running`` cuts each key's rows into chunks of consecutive
integer positions, evaluates the running frame per (key, chunk), and adds
what earlier chunks contribute from a per-chunk table that has one row per
chunk.  That table is joined back on (key, chunk), the partitioning the row
side already has, so only the small table moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536
RANGES = 64


def running(df: DataFrame, key: str, order: str, specs: dict[str, tuple[str, str | Column]],
            chunk: int = CHUNK) -> DataFrame:
    """Add one column per ``out -> (kind, expr)``: ``sum`` / ``count`` (of
    non-null values) / ``last`` (last non-null), over all rows of the key with
    ``order`` at or before the current row, or ``lag`` (the value on the
    previous row, null or not; null on the key's first row).  ``order`` must
    be an integer position, unique per key."""
    c = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    w = Window.partitionBy(key, "_chunk").orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols, tot_aggs, carry, final = {}, [], {}, {}
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    for out, (kind, e) in specs.items():
        col = F.col(e) if isinstance(e, str) else e
        if kind == "sum":
            cols[f"_l_{out}"], cols[f"_t_{out}"] = F.sum(col).over(upto), F.sum(col).over(whole)
        elif kind == "count":
            cols[f"_l_{out}"], cols[f"_t_{out}"] = F.count(col).over(upto), F.count(col).over(whole)
        elif kind == "last":
            cols[f"_l_{out}"] = F.last(col, ignorenulls=True).over(upto)
            cols[f"_t_{out}"] = F.last(col, ignorenulls=True).over(whole)
        elif kind == "lag":
            # inside a chunk an ordinary lag; a chunk's first row takes the last
            # row of the nearest earlier chunk (wrapped so a null value still
            # counts as "a row was there")
            first_row = F.row_number().over(w) == 1
            cols[f"_l_{out}"] = F.when(~first_row, F.struct(F.lag(col).over(w).alias("v")))
            cols[f"_t_{out}"] = F.last(F.struct(col.alias("v"))).over(whole)
        else:
            raise ValueError(f"unknown running aggregate {kind!r}")
        tot_aggs.append(F.first(f"_t_{out}").alias(f"_t_{out}"))
        t = F.col(f"_t_{out}")
        carry[f"_c_{out}"] = (F.last(t, ignorenulls=True) if kind in ("last", "lag") else F.sum(t)).over(before)
        loc, car = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if kind == "last":
            final[out] = F.coalesce(loc, car)
        elif kind == "lag":
            final[out] = F.coalesce(loc, car)["v"]
        else:
            final[out] = F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
    c = c.withColumns(cols)
    per_chunk = c.groupBy(key, "_chunk").agg(*tot_aggs).withColumns(carry).select(key, "_chunk", *carry)
    drop = ["_chunk"] + [f"_{p}_{o}" for o in specs for p in ("l", "t", "c")]
    return c.join(per_chunk, [key, "_chunk"], "left").withColumns(final).drop(*drop)


def positions(df: DataFrame, key: str | list[str], order: list[str], out: str = "pos",
              chunk: int = 32) -> DataFrame:
    """0-based position of each row within its key, in ``order`` (any
    sortable columns; include enough of them to make the order total).

    A window ``row_number`` would hold each key in one task.  Instead a key's
    rows are cut into ranges of the order, numbered within (key, range), and
    moved up by the sizes of the ranges before.  The cuts are rows of the key:
    of one row in ``chunk``, chosen by a hash of the order columns, those with the
    least hash in each of ``RANGES`` hash classes.  They depend on nothing but
    the data, so every pass over the plan finds the same ranges; there are at
    most ``RANGES`` of them, map-side combined; nothing runs or is written
    while the plan is built."""
    keys = [key] if isinstance(key, str) else list(key)
    x = df.withColumn("_pkey", F.struct(*[F.col(c) for c in keys])).withColumn("_porder", F.struct(*[F.col(c) for c in order]))
    h = F.xxhash64("_porder", F.lit("cut"))
    drawn = x.select("_pkey", "_porder", h.alias("_h")).where(F.pmod("_h", F.lit(chunk)) == 0)
    least = drawn.groupBy("_pkey", F.pmod(F.xxhash64("_h"), F.lit(RANGES)).alias("_class")).agg(F.min(F.struct("_h", "_porder")).alias("_m"))
    cuts = least.groupBy("_pkey").agg(F.collect_list("_m._porder").alias("_cuts"))
    x = x.join(cuts, "_pkey", "left").withColumn(
        "_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_porder"))), F.lit(0))).drop("_cuts")
    sizes = x.groupBy("_pkey", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_pkey").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_pkey", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_pkey", "_range").orderBy("_porder")) - 1
    return (x.withColumn(out, within).join(sizes, ["_pkey", "_range"])
            .withColumn(out, (F.col(out) + F.col("_before")).cast("bigint")).drop("_pkey", "_range", "_before", "_porder"))
