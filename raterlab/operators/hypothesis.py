"""Hypothesis tests (A16 p-value, A17, A18) and the tail probabilities they need (U4).

Statistics are aggregates over the data; tail probabilities are built-in expressions (series and
continued fraction as array folds), as Spark has no ``erf``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlab.operators.ranks import CELLS, positions


# ---------------------------------------------------------------------------
# tails (closed forms; scipy is not required)
# ---------------------------------------------------------------------------

def _upper_erfc(x: Column) -> Column:
    """erfc for x >= 0: the power series of erf below 2, Legendre's continued fraction from there on."""
    twice = 2 * x * x

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * twice / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("term"), x.alias("sum")), add, lambda acc: acc["sum"])
    far = F.greatest(x, F.lit(2.0))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), far, lambda t, k: far + k / 2 / t)
    return (F.when(x < 2, 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series)
            .otherwise(F.exp(-x * x) / (math.sqrt(math.pi) * fraction)))


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of χ² with integer ``dof``: a finite sum, plus an erfc for odd ``dof``. NULL and NaN stay."""
    h = F.greatest(x, F.lit(0.0)) / 2
    odd = dof % 2 == 1
    steps = F.floor(dof / 2).cast("int")
    first = F.exp(-h) * F.when(odd, F.sqrt(h) / math.gamma(1.5)).otherwise(1.0)
    half = F.when(odd, 0.5).otherwise(0.0)

    def add(acc: Column, j: Column) -> Column:
        term = F.when(j == 1, first).otherwise(acc["term"] * h / F.greatest(j - 1 + half, F.lit(0.5)))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))
    terms = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum")), add, lambda acc: acc["sum"])
    tail = total + F.when(odd, _upper_erfc(F.sqrt(h))).otherwise(0.0)
    return (F.when(x.isNull() | dof.isNull(), F.lit(None).cast("double")).when(dof <= 0, 1.0).when(F.isnan(x), x)
            .when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), tail)))


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail of a statistic that counts as 0 where it is negative. NULL and NaN stay."""
    return (F.when(z.isNull() | F.isnan(z), z).when(z <= 0, 1.0)
            .otherwise(_upper_erfc(F.greatest(z, F.lit(0.0)) / math.sqrt(2.0))))


def with_chi2_p(chi2: DataFrame) -> DataFrame:
    """A16 p-value column on the (tiny) statistic frame."""
    return chi2.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("dof")))


# ---------------------------------------------------------------------------
# A17 D'Agostino–Pearson K²
# ---------------------------------------------------------------------------

def normality_k2(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """K² = Zs² + Zk² from population skewness g1 and excess kurtosis g2; p = exp(−K²/2)
    (χ² with 2 dof), all built-in math. Groups with fewer than 8 values get NULLs."""
    x = df.groupBy(*group_cols).agg(F.count(value_col).alias("n"),
                                    F.skewness(value_col).alias("skew"), F.kurtosis(value_col).alias("kurt"))
    # each step refers to columns of the step before: one that is used more than once is not written out again
    n = F.col("n").cast("double")
    x = x.withColumns({
        "_y": F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))),
        "_beta2": 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)),
        "_e": 3.0 * (n - 1) / (n + 1),
        "_var": 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)),
        "_sb1": 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))})
    x = x.withColumns({
        "_w2": -1.0 + F.sqrt(2.0 * (F.col("_beta2") - 1)),
        "_xk": (F.col("kurt") + 3.0 - F.col("_e")) / F.sqrt("_var"),
        "_a": 6.0 + 8.0 / F.col("_sb1") * (2.0 / F.col("_sb1") + F.sqrt(1 + 4.0 / (F.col("_sb1") * F.col("_sb1"))))})
    a = F.col("_a")
    x = x.withColumns({
        "_zs": F.asinh(F.col("_y") / F.sqrt(2.0 / (F.col("_w2") - 1))) / F.sqrt(0.5 * F.log("_w2")),
        "_denom": 1 + F.col("_xk") * F.sqrt(2.0 / (a - 4))})
    x = x.withColumn("_zk", (1 - 2.0 / (9 * a) - F.signum("_denom") * F.cbrt((1 - 2.0 / a) / F.abs("_denom"))) / F.sqrt(2.0 / (9 * a)))
    x = x.withColumn("_k2", F.col("_zs") * F.col("_zs") + F.col("_zk") * F.col("_zk"))
    ok = F.col("n") >= 8          # the skewness test is undefined below 8 observations
    return x.select(*group_cols, "n", "skew", "kurt", F.when(ok, F.col("_zs")).alias("z_skew"), F.when(ok, F.col("_zk")).alias("z_kurt"),
                    F.when(ok, F.col("_k2")).alias("k2"), F.when(ok, F.exp(-F.col("_k2") / 2)).alias("p_value"))


# ---------------------------------------------------------------------------
# A18 Mann–Whitney U
# ---------------------------------------------------------------------------

def mann_whitney(samples: DataFrame, test_col: str, side_col: str, value_col: str,
                 cells: int = CELLS) -> DataFrame:
    """Two-sided Mann–Whitney U per ``test_col`` (sides ``'a'`` / ``'b'``), tie-corrected
    normal approximation with continuity correction.

    Works on the value histogram: U1 = Σ_x na(x)·(Nb(<x) + nb(x)/2); tie term Σ(t³ − t).
    """
    # a value that is missing has no rank
    samples = samples.filter(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
    h = samples.groupBy(test_col, value_col).agg(
        F.count_if(F.col(side_col) == "a").alias("na"), F.count_if(F.col(side_col) == "b").alias("nb"))
    h = positions(h, [test_col], value_col, ["nb"], cells)
    t = (F.col("na") + F.col("nb")).cast("double")
    agg = h.groupBy(test_col).agg(
        F.sum("na").alias("n1"), F.sum("nb").alias("n2"),
        F.sum(F.col("na") * (F.col("before_nb") + F.col("nb") / 2.0)).alias("u1"),
        F.sum(t * t * t - t).alias("tie_term"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.greatest(F.col("u1"), n1 * n2 - F.col("u1"))
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    z = F.try_divide(u - n1 * n2 / 2.0 - 0.5, sigma)
    return agg.select(test_col, "n1", "n2", "u1", u.alias("u"), "tie_term", z.alias("z"))


def with_mann_whitney_p(mw: DataFrame) -> DataFrame:
    return mw.withColumn("p_value", normal_two_sided(F.col("z")))

