"""Exact duplicates by two passes over a Bloom filter (native DataFrame operations only).

Pass one fingerprints every row and counts, per cell of a Bloom filter, how many rows set
it; the cells set at least twice form a bounded bit array. Pass two tests each row: a row
with any cell set once has a text of its own and passes straight through. Only the rest
(repeated texts and a few false positives) shuffles, pre-aggregated per fingerprint.

Defined results: a null text counts as empty; texts are equal when identical after
lower-casing A-Z; of equal texts the row with the largest doc_id stays (a null doc_id is
smallest); of repeated rows with that doc_id exactly one stays; an empty table gives an
empty result; further columns are ignored by ``exact_duplicates`` and kept by ``drop_duplicates``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlab.llm.common import ascii_lower, attach_groups, scratch_table, text_or_empty

HASHES = 3
#: 64-bit words of the filter: one per ROWS_PER_WORD rows, a power of two, at most MAX_WORDS
#: (8 MB, the proven bound of what is sent to the executors). Past that the filter only
#: lets more rows through to the exact grouping; results don't change.
ROWS_PER_WORD = 4
MAX_WORDS = 1 << 20


def fingerprint(text_col: str) -> Column:
    """SHA-256 (32 bytes) of the normalised text."""
    return F.unhex(F.sha2(ascii_lower(text_or_empty(text_col)), 256))


def filter_words(rows: int) -> int:
    want = max(64, -(-rows // ROWS_PER_WORD))
    return min(MAX_WORDS, 1 << (want - 1).bit_length())


def _cells(fp: Column, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(fp, F.lit(i)), F.lit(words * 64).cast("bigint")) for i in range(HASHES)]


def repeated_cells(prints: DataFrame, words: int) -> DataFrame:
    """One row, one column ``bits``: the filter of cells that at least two rows set, as longs."""
    cells = (prints.select(F.explode(F.array(*_cells(F.col("fp"), words))).alias("cell"))
             .groupBy("cell").count().filter("count >= 2"))
    one = F.expr("shiftleft(1L, int(cell & 63))")
    held = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    every = prints.sparkSession.range(words).withColumnRenamed("id", "word")
    return (every.join(held, "word", "left")
            .agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
                 .alias("pairs"))
            .select(F.col("pairs.bits").alias("bits")))


def maybe_repeated(fp: Column, bits: Column, words: int) -> Column:
    """False only when no other row has the same fingerprint."""
    def test(cell: Column) -> Column:
        word = F.get(bits, F.shiftright(cell, 6).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                               cell.bitwiseAND(F.lit(63)).cast("int"))) != 0
    return reduce(Column.__and__, [test(c) for c in _cells(fp, words)])


def _passes(docs: DataFrame, id_col: str, text_col: str):
    """The fingerprint table, its row count, the filter and the repeated groups."""
    prints = scratch_table(
        docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_col).alias("fp"),
                    F.monotonically_increasing_id().alias("row_no")), "fingerprints")
    total = prints.count()
    words = filter_words(total)
    bits = scratch_table(repeated_cells(prints, words), "bloom")
    # the filter reaches the tasks as the value of a one-row scalar subquery, at most MAX_WORDS longs
    flagged = prints.withColumn("maybe", maybe_repeated(F.col("fp"), bits.scalar(), words))
    groups = (flagged.filter("maybe").groupBy("fp")
              .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_no")).alias("keep"))
              .filter("group_size > 1"))
    groups = scratch_table(groups, "groups")
    return flagged, total, words, bits, groups


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    flagged, total, _, _, groups = _passes(docs, id_col, text_col)
    single = flagged.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "fp")
    joined = attach_groups(flagged.filter("maybe").select("doc_id", "fp", "row_no"), groups, "fp", "group_size",
                           total, F.encode(F.col("row_no").cast("string"), "UTF-8"))
    several = joined.select(
        "doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (F.col("keep").isNull() | (F.col("keep.row_no") == F.col("row_no"))).alias("kept"), "fp")
    return single.unionByName(several).select("doc_id", "keep_id", "group_size", "kept",
                                              F.lower(F.hex("fp")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows that the filter proves single are not shuffled. The others meet their group's
    keeper on (fingerprint, id), a key that only repeated rows share.
    """
    _, _, words, bits, groups = _passes(docs, id_col, text_col)
    parts = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), fingerprint(text_col).alias("fp"))
    parts = parts.withColumn("maybe", maybe_repeated(F.col("fp"), bits.scalar(), words))
    single = parts.filter("not maybe").select("row.*")
    several = parts.filter("maybe")
    lone = several.join(groups.select("fp"), "fp", "left_anti").select("row.*")
    keepers = groups.select(F.col("fp").alias("keep_fp"), F.col("keep.doc_id").alias("keep_id"))
    kept = several.join(keepers, (F.col("fp") == F.col("keep_fp")) & F.col("id").eqNullSafe(F.col("keep_id")), "inner")
    kept = kept.dropDuplicates(["fp"]).select("row.*")
    return single.unionByName(lone).unionByName(kept)
