"""Lenient coercions of model output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from raterlab import constants as C


def coerce_category(x: Column, domain: Sequence[str], other: str = C.CORRUPTED) -> Column:
    """V2: keep values of ``domain``; anything else, null included, becomes ``other``."""
    return F.when(x.isin(*domain), x).otherwise(F.lit(other))


def lenient_int_variant(v: Column, path: str, default: int = C.UNUSABLE_LEVEL) -> Column:
    """V3 on a variant: ints kept, floats truncated, integer text parsed, bools 1/0, rest → default."""
    return F.coalesce(F.try_variant_get(v, path, "int"), F.lit(default))


def parse_or_failed(raw: Column) -> Column:
    """parse model text as JSON, or substitute the failure record."""
    return F.coalesce(F.try_parse_json(raw), F.parse_json(F.lit(C.FAILED_OUTPUT_JSON)))


def map_values(x: Column, mapping: dict) -> Column:
    """Constant dictionary lookup; unmapped keys give NULL."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), x)


def strict_int(x: Column) -> Column:
    """P5: ANSI cast to int — malformed input fails the job, as ``astype(int)`` does."""
    return x.cast("int")
