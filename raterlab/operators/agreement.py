"""Inter-rater agreement (J7, A15, A19) and span overlap between raters.

Raters are paired by item id in one aggregation, two named ones or every pair of them; an item
that one rater labelled twice raises, so an item holds at most one label per rater.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlab.functions import text as T


def pair_raters(ann: DataFrame, rater_a: str, rater_b: str, columns: Sequence[str],
                rater_col: str = "created_by", id_col: str = "id") -> DataFrame:
    """One row per item labelled by both raters; columns get ``a_`` / ``b_`` prefixes.
    One pass over the annotations; an item that a rater labelled twice raises."""
    label = F.struct(*columns)
    sides = {"a": F.col(rater_col) == rater_a, "b": F.col(rater_col) == rater_b}
    pairs = ann.filter(sides["a"] | sides["b"]).filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        *[F.count_if(on).alias(f"n_{k}") for k, on in sides.items()],
        *[F.first(F.when(on, label), ignorenulls=True).alias(k) for k, on in sides.items()])
    twice = F.greatest("n_a", "n_b") > 1
    checked = F.when(twice, F.raise_error(F.concat(F.lit("labelled twice by one rater: "), F.col(id_col).cast("string"))))
    pairs = pairs.select(checked.otherwise(F.col(id_col)).alias(id_col), "n_a", "n_b", "a", "b")
    return pairs.filter((F.col("n_a") > 0) & (F.col("n_b") > 0)).select(
        id_col, *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in sides for c in columns])


def pair_all_raters(ann: DataFrame, columns: Sequence[str], rater_col: str = "created_by", id_col: str = "id") -> DataFrame:
    """J7 for every pair of raters: (rater_a, rater_b, id, a_*, b_*) with rater_a < rater_b. One aggregation by id; an item
    holds one label per rater, and its pairs are made in its row, without a self-join."""
    label = F.struct(F.col(rater_col).alias("rater"), *columns)
    items = ann.filter(F.col(id_col).isNotNull() & F.col(rater_col).isNotNull()).groupBy(id_col).agg(F.collect_list(label).alias("labels"))
    twice = F.size("labels") > F.size(F.array_distinct(F.transform("labels", lambda x: x["rater"])))
    checked = F.when(twice, F.raise_error(F.concat(F.lit("labelled twice by one rater: "), F.col(id_col).cast("string"))))
    items = items.select(id_col, checked.otherwise(F.col("labels")).alias("labels"))
    pairs = F.flatten(F.transform("labels", lambda x: F.transform(
        F.filter("labels", lambda y: y["rater"] > x["rater"]), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return items.select(id_col, F.explode(pairs).alias("p")).select(
        F.col("p.a.rater").alias("rater_a"), F.col("p.b.rater").alias("rater_b"), id_col,
        *[F.col(f"p.{k}.{c}").alias(f"{k}_{c}") for k in "ab" for c in columns])


def crosstab_long(pairs: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Contingency counts ``(field, a, b, n)`` for each paired field (and value of ``by``), one aggregation."""
    e = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("string").alias("a"),
                                     F.col(f"b_{f}").cast("string").alias("b")) for f in fields]))
    return (pairs.select(*by, e.alias("c")).select(*by, "c.*")
            .groupBy(*by, "field", "a", "b").agg(F.count(F.lit(1)).alias("n")))


def crosstab_wide(long: DataFrame, field: str) -> DataFrame:
    """A15 wide form (pandas ``crosstab``): rows = a labels, one column per b label, zeros filled."""
    return long.filter(F.col("field") == field).groupBy("a").pivot("b").agg(F.sum("n")).na.fill(0)


def _margins(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (field, label): row margin (rater a), column margin (rater b), diagonal count."""
    both = F.explode(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("r"), F.lit(0).cast("long").alias("c"),
                 F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("d")),
        F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("r"), F.col("n").alias("c"),
                 F.lit(0).cast("long").alias("d"))))
    return (long.select(*by, "field", both.alias("e")).select(*by, "field", "e.*").groupBy(*by, "field", "label")
            .agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("d").alias("d")))


def cohen_kappa(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted Cohen's κ per field (and value of ``by``): ``(po - pe) / (1 - pe)``; pe = 1 → NULL."""
    m = _margins(long, by)
    x = m.groupBy(*by, "field").agg(F.sum("r").alias("n"), F.sum("d").alias("agree"),
                                    F.sum(F.col("r").cast("double") * F.col("c")).alias("rc"))
    po = F.col("agree") / F.col("n")
    pe = F.col("rc") / (F.col("n").cast("double") * F.col("n"))
    return x.select(*by, "field", "n", po.alias("po"), pe.alias("pe"),
                    F.try_divide(po - pe, F.lit(1.0) - pe).alias("kappa"))


def chi2_statistic(long: DataFrame) -> DataFrame:
    """χ² test of independence per field (statistic and dof; p-value via ``hypothesis``).

    Only observed cells are touched: without correction χ² = Σ o²/e − n. For a 2×2
    table (dof = 1) Yates' correction applies; there every |o − e| is the same D,
    so χ² = max(D − ½, 0)² · n · Σ 1/rᵢ · Σ 1/cⱼ. No label × label grid is built;
    margins are windows over the (label²-bounded) contingency table, one linear chain.
    """
    from pyspark.sql import Window
    by_f = Window.partitionBy("field")
    x = (long.withColumn("r", F.sum("n").over(Window.partitionBy("field", "a")))
             .withColumn("c", F.sum("n").over(Window.partitionBy("field", "b")))
             .withColumn("n_tot", F.sum("n").over(by_f))
             .withColumn("_first_a", F.row_number().over(Window.partitionBy("field", "a").orderBy("b")) == 1)
             .withColumn("_first_b", F.row_number().over(Window.partitionBy("field", "b").orderBy("a")) == 1))
    e = F.col("r").cast("double") * F.col("c") / F.col("n_tot")
    per = x.groupBy("field").agg(
        F.max("n_tot").alias("n"), F.count_if("_first_a").alias("n_rows"), F.count_if("_first_b").alias("n_cols"),
        F.sum(F.when(F.col("_first_a"), 1.0 / F.col("r"))).alias("inv_r"),
        F.sum(F.when(F.col("_first_b"), 1.0 / F.col("c"))).alias("inv_c"),
        F.sum(F.col("n").cast("double") ** 2 / e).alias("o2e"), F.max(F.abs(F.col("n") - e)).alias("dev"))
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    yates = F.greatest(F.col("dev") - 0.5, F.lit(0.0)) ** 2 * F.col("n") * F.col("inv_r") * F.col("inv_c")
    stat = (F.when(dof == 0, F.lit(0.0))
             .when(dof == 1, yates)
             .otherwise(F.greatest(F.col("o2e") - F.col("n"), F.lit(0.0))))
    return per.select("field", F.col("n"), dof.cast("long").alias("dof"), stat.alias("chi2"))


def span_pairs_overlap(pairs: DataFrame, loc_col: str = "context_locations", id_col: str = "id") -> DataFrame:
    """J12 per item: overlaps between the two raters' span lists (``a_``/``b_`` prefixed)."""
    return pairs.select(id_col, "text", F.col(f"a_{loc_col}").alias("a_spans"), F.col(f"b_{loc_col}").alias("b_spans"),
                        T.span_overlaps(F.col(f"a_{loc_col}"), F.col(f"b_{loc_col}")).alias("overlaps"))


def overlap_sweep(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """J12 in long form: (id, start, end) of every overlap between a span of ``a`` and one of ``b`` (inclusive ends) of the same
    id. Spans are cut into bins as wide as the id's mean span, so bins are at most about twice as many as spans; only
    spans that meet in a bin are compared, and a pair counts in the bin in which the later one starts. Lists of any
    length work, and one id's spans are spread over its bins. Spans with a null or that end before they start meet nothing."""
    whole = F.col("end") >= F.col("start")
    a, b = (x.select(id_col, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter(whole) for x in (a, b))
    lengths = a.unionByName(b).groupBy(id_col).agg(F.greatest(F.lit(1), F.ceil(F.avg(F.col("end") - F.col("start") + 1))).alias("_width"))

    def binned(x: DataFrame, side: str) -> DataFrame:
        x = x.join(lengths, id_col)
        bins = F.sequence(F.floor(F.col("start") / F.col("_width")), F.floor(F.col("end") / F.col("_width")))
        return x.select(id_col, F.explode(bins).alias("_bin"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), "_width")
    both = binned(a, "a").join(binned(b, "b").drop("_width"), [id_col, "_bin"])
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    both = both.filter((start <= end) & (F.floor(start / F.col("_width")) == F.col("_bin")))
    return both.select(id_col, start.alias("start"), end.alias("end"))


def overlap_summary(ov: DataFrame) -> DataFrame:
    """Span counts and inclusive lengths per rater, overlap count/length, mean
    length per rater and the overlap Jaccard ``ov / (a + b − ov)``."""
    x = ov.agg(
        F.sum(T.span_chars(F.col("a_spans"))).alias("ann1_labels_len"),
        F.sum(F.size(F.coalesce("a_spans", F.array()))).cast("long").alias("ann1_labels_total"),
        F.sum(T.span_chars(F.col("b_spans"))).alias("ann2_labels_len"),
        F.sum(F.size(F.coalesce("b_spans", F.array()))).cast("long").alias("ann2_labels_total"),
        F.sum(T.span_chars(F.col("overlaps"))).alias("overlap_labels_len"),
        F.sum(F.size("overlaps")).cast("long").alias("overlap_labels_total"))
    return x.select("*",
                    F.try_divide(F.col("ann1_labels_len").cast("double"), F.col("ann1_labels_total")).alias("ann1_mean_len"),
                    F.try_divide(F.col("ann2_labels_len").cast("double"), F.col("ann2_labels_total")).alias("ann2_mean_len"),
                    F.try_divide(F.col("overlap_labels_len").cast("double"),
                                 F.col("ann1_labels_len") + F.col("ann2_labels_len") - F.col("overlap_labels_len"))
                    .alias("overlap_jaccard"))


def overlap_text(ov: DataFrame, id_col: str = "id") -> DataFrame:
    """Text covered by each overlap, joined by a space per item."""
    return ov.select(id_col, F.array_join(F.transform("overlaps", lambda s: T.span_text(F.col("text"), s)), " ")
                     .alias("overlap_text"), F.size("overlaps").alias("n_overlaps"))


def mean_span_length(ann: DataFrame, rater_col: str = "created_by", loc_col: str = "context_locations") -> DataFrame:
    """Mean ``end − start`` over exploded spans per rater (items without spans ignored)."""
    x = ann.select(rater_col, F.explode(loc_col).alias("s"))
    return x.groupBy(rater_col).agg(F.avg(F.col("s.end") - F.col("s.start")).alias("mean_span_len"),
                                    F.count(F.lit(1)).alias("n_spans"))
