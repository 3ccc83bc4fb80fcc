"""Distribution tables (A10–A14): counts, shares, box statistics, describe.

Exact quantiles (linear interpolation, like pandas / numpy) are selected from a distributed
histogram (``ranks``): no task holds the distinct values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlab.operators.ranks import join_groups, quantiles


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per value, most frequent first (equal counts by value)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)


def category_share(df: DataFrame, hue_col: str, cat_col: str, order: Sequence[str]) -> DataFrame:
    """Percent of *all* rows per (hue, category); categories in ``order`` get
    their position, others are dropped (as a fixed-order count plot does)."""
    from pyspark.sql import Window
    pos = F.array_position(F.array(*[F.lit(c) for c in order]), F.col(cat_col))
    counts = df.groupBy(hue_col, cat_col).agg(F.count(F.lit(1)).alias("n"))
    # the total is a window over the grouped counts (bounded by hues × categories)
    counts = counts.withColumn("_total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return counts.filter(F.col(cat_col).isin(*order)).select(
        hue_col, cat_col, pos.cast("int").alias("ord"), "n", (F.col("n") * 100.0 / F.col("_total")).alias("percent"))


def describe(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (exact, linear), max."""
    v = F.col(value_col).cast("double")
    x = df.groupBy(*group_cols).agg(F.count(v).alias("count"), F.avg(v).alias("mean"),
                                    F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, group_cols, value_col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return join_groups(x, q, group_cols, "left").select(*group_cols, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def box_stats(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """Quartiles, 1.5·IQR fences, whiskers (extreme values inside the fences)
    and outlier count per group. The fence test joins the quartile row of each group back
    onto the values, reduced to one row per group and value first."""
    v = F.col(value_col).cast("double")
    q = quantiles(df, group_cols, value_col, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    values = df.select(*group_cols, v.alias("_v")).groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_n"))
    x = join_groups(values, q, group_cols)
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    return x.groupBy(*group_cols, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outliers"),
        F.sum("_n").alias("n"))


def rows_per(df: DataFrame, group_cols: Sequence[str], nonnull_col: str | None = None) -> DataFrame:
    """Rows per group, plus non-null count of ``nonnull_col``."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if nonnull_col:
        aggs.append(F.count(nonnull_col).alias(f"n_{nonnull_col}"))
    return df.groupBy(*group_cols).agg(*aggs)
