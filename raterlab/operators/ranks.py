"""Ranks and exact quantiles without holding a group's values in one place.

Values are first reduced to a histogram (one row per group and value). Cells are an expression
of the value alone: equal widths between the group's extremes on a signed logarithmic scale, and equal widths
between the extremes of each of these cells again. So nothing is sampled, nothing needs a checkpoint, and
a plan that is evaluated twice cuts the same cells. Running sums go over at most ``cells`` rows of a group, over at
most ``cells`` rows of a cell, and over the values of a cell of the second level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null key is a group of its own."""
    if not keys:
        return left.join(right, F.lit(True), how)
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


def _cell(x: Column, low: Column, high: Column, cells: int) -> Column:
    """0 to cells - 1, rising with x."""
    part = F.floor((x - low) / (high - low) * cells)
    return F.when(high > low, F.least(part, F.lit(cells - 1))).otherwise(F.lit(0)).cast("int")


def positions(histogram: DataFrame, keys: Sequence[str], value_col: str, weights: Sequence[str], cells: int = CELLS) -> DataFrame:
    """``histogram`` (one row per group and non-null value) with ``before_<w>``, the sum of each weight over the group's smaller
    values, and ``total_<w>`` over all of them. Infinite values lie at the ends, NaN beyond (as Spark sorts)."""
    keys, v = list(keys), F.col("_v")
    x = histogram.withColumn("_v", F.col(value_col).cast("double"))
    finite = (v > float("-inf")) & (v < float("inf"))
    x = x.withColumn("_f", F.when(finite, F.signum(v) * F.log1p(F.abs(v))))
    ends = x.groupBy(*keys).agg(F.min("_f").alias("_low"), F.max("_f").alias("_high"), *[F.sum(w).alias(f"total_{w}") for w in weights])
    x = join_groups(x, ends, keys)
    x = x.withColumn("_one", F.when(F.isnan(v), cells + 1).when(v == float("inf"), cells).when(v == float("-inf"), -1)
                     .otherwise(_cell(F.col("_f"), F.col("_low"), F.col("_high"), cells)))
    sums = [F.sum(w).alias(f"_s_{w}") for w in weights]

    def running(frame: DataFrame, within: list[str], order: str, columns: list[str], prefix: str) -> DataFrame:
        w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
        w = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumns({f"{prefix}_{name}": F.coalesce(F.sum(c).over(w), F.lit(0)) for name, c in zip(weights, columns)})
    held = [f"_s_{w}" for w in weights]
    one = x.groupBy(*keys, "_one").agg(*sums, F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    one = running(one, keys, "_one", held, "_a").drop(*held)
    x = join_groups(x, one, [*keys, "_one"]).withColumn("_two", _cell(v, F.col("_from"), F.col("_to"), cells))
    two = x.groupBy(*keys, "_one", "_two").agg(*sums)
    two = running(two, [*keys, "_one"], "_two", held, "_b").drop(*held)
    x = running(join_groups(x, two, [*keys, "_one", "_two"]), [*keys, "_one", "_two"], "_v", list(weights), "_c")
    return x.select(*histogram.columns, *[f"total_{w}" for w in weights],
                    *[(F.col(f"_a_{w}") + F.col(f"_b_{w}") + F.col(f"_c_{w}")).alias(f"before_{w}") for w in weights])


def quantiles(df: DataFrame, keys: Sequence[str], value_col: str, parts: dict[str, float], cells: int = CELLS) -> DataFrame:
    """One row per group with a non-null value: the exact quantiles ``parts`` (name to share), linear between the two neighbours."""
    v = F.col(value_col).cast("double")
    counts = df.select(*keys, v.alias("_value")).filter("_value is not null").groupBy(*keys, "_value").agg(F.count("*").alias("n"))
    ranked = positions(counts, keys, "_value", ["n"], cells)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), F.col("_value")))
    found = []
    for name, share in parts.items():
        place = share * (F.col("total_n") - 1)
        found += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    out = ranked.groupBy(*keys).agg(F.max("total_n").alias("total_n"), *found)

    def between(name: str, share: float) -> Column:
        place, low, high = share * (F.col("total_n") - 1), F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        part = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        return F.when(low == high, low).otherwise(part).alias(name)
    return out.select(*keys, *[between(n, s) for n, s in parts.items()])
