"""Date-ordered splits (O1) and split membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raterlab import constants as C


def date_split(pubs: DataFrame, n_train: int = C.FT_TRAIN_NUM, n_val: int = C.FT_VAL_NUM,
               date_col: str = "date", id_col: str = "id") -> DataFrame:
    """O1: first ``n_train`` by date → ft_training, next ``n_val`` → ft_validation, rest → evaluation.

    Dates are compared as text (never parsed), nulls last, id breaks ties. Only the
    ``n_train + n_val`` head is ordered (TakeOrderedAndProject: a bounded top-k per
    partition); it is broadcast back, so no global sort or window over the corpus.
    Returns ``(id, split_name)``.
    """
    order = [F.col(date_col).asc_nulls_last(), F.col(id_col).asc()]
    head = pubs.select(id_col, date_col).orderBy(*order).limit(n_train + n_val)
    # window over at most n_train + n_val rows
    ranked = head.withColumn("_pos", F.row_number().over(Window.orderBy(*order)))
    ranked = ranked.select(id_col, F.when(F.col("_pos") <= n_train, F.lit("ft_training"))
                           .otherwise(F.lit("ft_validation")).alias("_head_split"))
    out = pubs.select(id_col).join(F.broadcast(ranked), id_col, "left")
    return out.select(id_col, F.coalesce("_head_split", F.lit("evaluation")).alias("split_name"))


def in_split(df: DataFrame, splits: DataFrame, split_name: str, id_col: str = "id") -> DataFrame:
    """Rows whose id belongs to ``split_name`` (left semi join on a split table)."""
    ids = splits.filter(F.col("split_name") == split_name).select(id_col)
    return df.join(ids, id_col, "left_semi")


def head_ids(pubs: DataFrame, n_train: int = C.FT_TRAIN_NUM, n_val: int = C.FT_VAL_NUM,
             date_col: str = "date", id_col: str = "id") -> DataFrame:
    """The ``n_train + n_val`` earliest publications with their head split name —
    a bounded top-k (size fixed by the two parameters)."""
    order = [F.col(date_col).asc_nulls_last(), F.col(id_col).asc()]
    head = pubs.select(id_col, date_col).orderBy(*order).limit(n_train + n_val)
    ranked = head.withColumn("_pos", F.row_number().over(Window.orderBy(*order)))  # ≤ n_train + n_val rows
    return ranked.select(id_col, F.when(F.col("_pos") <= n_train, F.lit("ft_training"))
                         .otherwise(F.lit("ft_validation")).alias("split_name"))


def in_date_split(df: DataFrame, pubs: DataFrame, split_name: str, n_train: int = C.FT_TRAIN_NUM,
                  n_val: int = C.FT_VAL_NUM, id_col: str = "id") -> DataFrame:
    """O1 + J1 without shuffling the corpus: the head is broadcast; ``evaluation`` is
    the anti-join with it, the head splits are semi-joins."""
    head = F.broadcast(head_ids(pubs, n_train, n_val, id_col=id_col))
    if split_name == "evaluation":
        return df.join(head.select(id_col), id_col, "left_anti")
    return df.join(head.filter(F.col("split_name") == split_name).select(id_col), id_col, "left_semi")


def attach_split(pubs: DataFrame, splits: DataFrame, id_col: str = "id") -> DataFrame:
    """Publications with their split name (unmapped → null)."""
    return pubs.join(splits.select(id_col, "split_name"), id_col, "left")


def split_sizes(splits: DataFrame) -> DataFrame:
    """A10: rows per split."""
    return splits.groupBy("split_name").agg(F.count(F.lit(1)).alias("n"))


def missing_annotations(splits: DataFrame, annotations: DataFrame, raters: DataFrame,
                        id_col: str = "id", rater_col: str = "created_by") -> DataFrame:
    """J8 / U-b: (rater, split_name, id) that a rater left unannotated.

    Per id, the set of raters present (bounded by the rater count) is compared to
    the full rater list, a scalar subquery; no id × rater product is built.
    """
    all_raters = raters.select(F.array_sort(F.collect_set(rater_col))).scalar()
    have = annotations.groupBy(id_col).agg(F.collect_set(rater_col).alias("_have"))
    x = splits.select(id_col, "split_name").join(have, id_col, "left")
    lacking = F.array_except(all_raters, F.coalesce("_have", F.array().cast("array<string>")))
    return x.select(F.explode(lacking).alias(rater_col), "split_name", id_col)


def duplicate_annotations(annotations: DataFrame, id_col: str = "id",
                          rater_col: str = "created_by") -> DataFrame:
    """(rater, id) labelled more than once — the other half of the J8 completeness check."""
    return (annotations.groupBy(rater_col, id_col).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def assert_complete(missing: DataFrame, duplicates: DataFrame, sample: int = 20) -> None:
    """Raise with a bounded sample of offending ids if the completeness check fails."""
    bad = missing.limit(sample).collect()
    dup = duplicates.limit(sample).collect()
    if bad or dup:
        raise ValueError(f"incomplete annotations: missing={bad} duplicated={dup}")
