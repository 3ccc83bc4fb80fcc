"""Annotation export flattening (S10, F1, F2, P7) and description override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlab import constants as C
from raterlab.functions import text as T


def _last_classification(classes: Column, value: str) -> Column:
    """The last classification entry named ``value`` (later entries overwrite earlier)."""
    return F.try_element_at(F.filter(classes, lambda c: c["value"] == value), F.lit(-1))


def flatten_export(export: DataFrame, project: str) -> DataFrame:
    """S10 + F1 + F2: one flat row per label of ``project``.

    Rows whose label has no ``emotion`` answer keep ``emotion = null``; use
    :func:`split_quarantine` to set them aside (P7).
    """
    labels = export.select(F.col("data_row.row_data").alias("text"), F.col("data_row.global_key").alias("id"),
                           F.explode(F.try_element_at(F.col("projects"), F.lit(project))["labels"]).alias("l"))
    cls = F.col("l.annotations.classifications")
    phrases = F.filter(F.col("l.annotations.objects"), lambda o: o["value"] == C.EXPORT_PHRASES)

    def first_answer(c: Column) -> Column:
        return F.try_element_at(c["checklist_answers"], F.lit(1))["value"]

    return labels.select(
        first_answer(_last_classification(cls, C.EXPORT_EMOTION)).alias("emotion"),
        _last_classification(cls, C.EXPORT_EMOTION_CLASS)["radio_answer"]["value"].alias("emotion_class"),
        first_answer(_last_classification(cls, C.EXPORT_TRIGGER_LEVEL)).alias("trigger_level"),
        F.transform(phrases, lambda o: o["location"]["token"]).alias("context"),
        F.transform(phrases, lambda o: F.struct(o["location"]["start"].alias("start"),
                                                o["location"]["end"].alias("end"))).alias("context_locations"),
        _last_classification(cls, C.EXPORT_DESCRIPTION)["text_answer"]["content"].alias("description"),
        F.col("l.label_details.created_at").alias("created_at"),
        T.pseudonym(F.col("l.label_details.created_by")).alias("created_by"),
        "text", "id")


def split_quarantine(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels with an emotion, labels without one)."""
    return flat.filter(F.col("emotion").isNotNull()), flat.filter(F.col("emotion").isNull())


def first_per_key(df: DataFrame, key: str | list[str], order_col: str, value_col: str) -> DataFrame:
    """First non-null ``value_col`` per ``key`` in ``order_col`` order.

    ``min_by`` is an ordinary aggregate with map-side partial aggregation, so a hot
    key is pre-reduced in every task instead of being sorted in one.
    """
    keys = [key] if isinstance(key, str) else key
    return (df.filter(F.col(value_col).isNotNull()).groupBy(*keys)
            .agg(F.min_by(value_col, order_col).alias(value_col)))


def override_descriptions(annotated: DataFrame, descriptions: DataFrame | None, key: str | list[str] = "id",
                          order_col: str = "pos") -> DataFrame:
    """A description from ``descriptions`` wins, else the annotation's own.
    ``None`` leaves the input unchanged (S9: optional file absent). With ``key`` = (rater, id) the
    descriptions of all raters are one table and every annotation is joined once."""
    if descriptions is None:
        return annotated
    best = first_per_key(descriptions, key, order_col, "description").withColumnRenamed("description", "_desc_y")
    x = annotated.join(best, key, "left")
    return x.withColumn("description", F.coalesce("_desc_y", "description")).drop("_desc_y")
