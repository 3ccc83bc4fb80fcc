"""Validation of free-form model output.

The chain is projections of higher-order functions over the parsed variant. Only context texts that
the native literal parser cannot read reach Python, in Arrow batches (``functions.text.parse_python_literal``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlab import constants as C
from raterlab.functions import coerce, text as T

_ITEM = "struct<s:string,raw:string>"


LOWER_TEXT = "_text_lc"
_EMPTY_ITEMS = f"array<{_ITEM}>"


def _with_items(x: DataFrame, ctx: Column) -> DataFrame:
    """V4: context variant → ``_items`` (array<struct<s,raw>>) and ``_pre`` (corrupted
    before locating).

    list → its items (non-string items get ``s = null`` and their JSON as ``raw``);
    text → Python-literal parse, unparsable text is one corrupted item; null /
    missing → nothing; other scalars or objects → one corrupted item. Each piece is
    its own column, so the variant is inspected once per row.
    """
    x = x.withColumn("_ctx", ctx).withColumn("_arr", F.try_variant_get("_ctx", "$", "array<variant>"))
    x = x.withColumn("_kind", F.when(F.col("_arr").isNull() & F.col("_ctx").isNotNull(), F.schema_of_variant("_ctx")))
    x = x.withColumn("_txt", F.when(F.col("_kind") == "STRING", F.variant_get("_ctx", "$", "string")))
    x = x.withColumn("_parsed", T.parse_python_literal(F.col("_txt")))

    def from_variant(it):
        is_str = F.schema_of_variant(it) == "STRING"
        return F.struct(F.when(is_str, F.variant_get(it, "$", "string")).alias("s"),
                        F.when(~is_str, F.to_json(it)).alias("raw"))
    empty_items = F.array().cast(_EMPTY_ITEMS)
    empty_str = F.array().cast("array<string>")
    items = (F.when(F.col("_arr").isNotNull(), F.transform("_arr", from_variant))
              .when(F.col("_parsed").isNotNull(),
                    F.transform("_parsed", lambda s: F.struct(s.alias("s"), s.alias("raw"))))
              .otherwise(empty_items))
    pre = (F.when(F.col("_arr").isNotNull() | F.col("_kind").isNull() | (F.col("_kind") == "VOID"), empty_str)
            .when(F.col("_kind") == "STRING",
                  F.when(F.col("_parsed").isNull(), F.array("_txt")).otherwise(empty_str))
            .otherwise(F.array(F.to_json("_ctx"))))
    return x.withColumn("_items", F.coalesce(items, empty_items)).withColumn("_pre", pre)


def parse_output(df: DataFrame, output_col: str = "output") -> DataFrame:
    """V1–V4, all that needs no text: adds ``emotion, emotion_class, trigger_level, description, _items, _pre`` and drops
    ``output``. Done before the text join, so the join moves parsed rows and nothing between it and
    the truth disturbs their partitioning."""
    x = df.withColumn("_v", F.try_parse_json(F.col(output_col)))
    x = _with_items(x, F.try_variant_get("_v", "$.context", "variant"))
    return x.select(
        *[c for c in df.columns if c != output_col],
        coerce.coerce_category(F.try_variant_get("_v", "$.emotion", "string"), C.EMOTIONS).alias("emotion"),
        coerce.coerce_category(F.try_variant_get("_v", "$.emotion_class", "string"), C.EMOTION_CLASSES).alias("emotion_class"),
        coerce.lenient_int_variant(F.col("_v"), "$.trigger_level").alias("trigger_level"),
        F.try_variant_get("_v", "$.description", "string").alias("description"), "_items", "_pre")


def locate(df: DataFrame, text_col: str = "text") -> DataFrame:
    """V5–V7 on parsed rows that carry ``text`` or its lower-cased form ``_text_lc`` (see :func:`attach_text`).

    Adds ``context, context_locations, context_corrupted, has_text, failed``.
    Offsets refer to the lower-cased text, as in the original.
    """
    x = df if LOWER_TEXT in df.columns else df.withColumn(LOWER_TEXT, F.lower(F.col(text_col)))
    located = F.transform("_items", lambda it: F.struct(
        it["s"].alias("s"), it["raw"].alias("raw"),
        F.when(it["s"].isNull(), F.lit(-1)).otherwise(F.instr(F.col(LOWER_TEXT), F.lower(it["s"])) - 1).alias("pos")))
    x = x.withColumn("_loc", located)
    found = F.filter("_loc", lambda it: it["pos"] >= 0)
    lost = F.filter("_loc", lambda it: it["pos"] < 0)
    parsed = ["emotion", "emotion_class", "trigger_level"]
    out = x.select(
        *[c for c in df.columns if c not in (*parsed, "description", "_items", "_pre", LOWER_TEXT)], *parsed,
        F.transform(found, lambda it: it["s"]).alias("context"),
        F.transform(found, lambda it: F.struct(it["pos"].cast("int").alias("start"),
                                               (it["pos"] + F.length(it["s"])).cast("int").alias("end")))
         .alias("context_locations"),
        F.concat("_pre", F.transform(lost, lambda it: F.coalesce(it["s"], it["raw"]))).alias("context_corrupted"),
        "description", F.col(LOWER_TEXT).isNotNull().alias("has_text"),
    )
    return out.withColumn("failed", failed_predicate())


def validate_output(df: DataFrame, output_col: str = "output", text_col: str = "text") -> DataFrame:
    """V1–V7 on a frame that carries ``text`` (or ``_text_lc``); drops ``output``."""
    return locate(parse_output(df, output_col), text_col)


def failed_predicate() -> Column:
    """V7: a row is unusable if a category is corrupted or the level is -1."""
    return ((F.col("emotion") == C.CORRUPTED) | (F.col("emotion_class") == C.CORRUPTED)
            | (F.col("trigger_level") == C.UNUSABLE_LEVEL))


def attach_text(pred: DataFrame, texts: DataFrame, id_col: str = "id") -> DataFrame:
    """Left join of publication text onto predictions (by id).

    Only the lower-cased text is needed to locate phrases; it is computed once per
    publication *before* the join (a publication meets one prediction per run).
    A null ``_text_lc`` marks a prediction without text (the V8 gate).
    """
    return pred.join(texts.select(id_col, F.lower(F.col("text")).alias(LOWER_TEXT)), id_col, "left")


def validate_predictions(pred: DataFrame, texts: DataFrame, id_col: str = "id") -> DataFrame:
    """J2 + V1–V7."""
    return locate(attach_text(parse_output(pred), texts, id_col))


def expand_baseline(pred: DataFrame, personas: Sequence[str] = C.PERSONAS,
                    baseline_approach: str = C.BASELINE_APPROACH) -> DataFrame:
    """The baseline approach has one prediction set that is evaluated against every
    persona; its rows are expanded in place. Rows of all other approaches and personas,
    known or not, pass through as they are."""
    every = F.when(F.col("approach") == baseline_approach, F.array(*[F.lit(p) for p in personas])) \
        .otherwise(F.array("persona"))
    return pred.withColumn("persona", F.explode(every))
