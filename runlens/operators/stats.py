"""Selection statistics and reports.

The inputs are one row per (group, instance) selection outcome; the outputs
are one row per group, which is tiny, so the ranking windows at the end are
global on purpose (a report, not a data-sized table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The report's columns, in report order.
REPORT_COLUMNS = [
    "group_id", "total", "completion_rate", "all_success", "all_failed", "need_to_select",
    "success_selection", "success_selection_in_need_to_select",
    "success_rate_in_need_to_select", "success_rate_among_all",
]


def group_statistics(stats: DataFrame, total_num_instances: int = 500,
                     group: str = "group_id") -> DataFrame:
    """Per group counts and rates; a rate with a zero denominator is 0."""
    s, a, f = F.col("is_success") == 1, F.col("is_all_success"), F.col("is_all_failed")
    need = ~a & ~f
    g = stats.groupBy(F.col(group).alias("group_id")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(a).cast("bigint").alias("all_success"),
        F.count_if(f).cast("bigint").alias("all_failed"),
        F.count_if(need).cast("bigint").alias("need_to_select"),
        F.count_if(s).cast("bigint").alias("success_selection"),
        F.count_if(need & s).cast("bigint").alias("success_selection_in_need_to_select"))

    def rate(num, den):
        return F.coalesce(F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")),
                          F.lit(0.0))

    return g.select(
        "group_id", "total",
        (F.col("total") / F.lit(float(total_num_instances))).alias("completion_rate"),
        "all_success", "all_failed", "need_to_select", "success_selection",
        "success_selection_in_need_to_select",
        F.when(F.col("need_to_select") > 0,
               rate("success_selection_in_need_to_select", "need_to_select"))
         .otherwise(0.0).alias("success_rate_in_need_to_select"),
        F.when(F.col("total") > 0, rate("success_selection", "total"))
         .otherwise(0.0).alias("success_rate_among_all"))


def rank_groups(report: DataFrame) -> DataFrame:
    """Rank by overall success rate, descending; ties by group id."""
    w = Window.orderBy(F.col("success_rate_among_all").desc(), F.col("group_id"))
    return report.withColumn("rank", F.row_number().over(w).cast("bigint"))


def best_group(report: DataFrame) -> DataFrame:
    """Flag the best group for each rate.  Strictly greater than 0 (no
    flag when all rates are 0); ties go to the first group in report order
    (rate among all desc, then group id)."""
    order = [F.col("success_rate_among_all").desc(), F.col("group_id")]

    def flag(rate: str) -> F.Column:
        w = Window.orderBy(F.col(rate).desc(), *order)
        return (F.row_number().over(w) == 1) & (F.col(rate) > 0)

    return (report.withColumn("best_in_need_to_select", flag("success_rate_in_need_to_select"))
            .withColumn("best_among_all", flag("success_rate_among_all")))


def status_histogram(events: DataFrame, status: str, item: str) -> DataFrame:
    """Count by status prefix (cut at the first ``(`` then the first
    ``:``), most common first (ties by key, not by first appearance)."""
    prefix = F.split_part(F.split_part(F.col(status), F.lit("("), F.lit(1)), F.lit(":"), F.lit(1))
    g = events.withColumn("prefix", prefix).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.col(item)).alias("n_items"))
    w = Window.orderBy(F.col("n").desc(), F.col("prefix"))
    return g.withColumn("rank", F.row_number().over(w).cast("bigint"))


def fallback_items(events: DataFrame, status: str, item: str,
                   ok: tuple[str, ...] = ("built", "exists")) -> DataFrame:
    """The items whose status is not one of ``ok`` (sort on output)."""
    return events.where(~F.col(status).isin(*ok)).select(item, status)


def status_items(events: DataFrame, status: str, item: str) -> DataFrame:
    """A06 alternative: status cut at the first ``:`` -> items, one row per
    (prefix, item)."""
    prefix = F.split_part(F.col(status), F.lit(":"), F.lit(1))
    return events.select(prefix.alias("prefix"), F.col(item).alias("item")).distinct()
