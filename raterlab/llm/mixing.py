"""Mixing sources to target weights by hash thresholds (native DataFrame operations only).

Every document gets a 48-bit hash of its id. Per source, document sizes are summed into a
histogram over the hash's top bits; the running sum finds the bucket in which the budget
runs out, and only that bucket is refined by the next bits. Selecting is then a filter
``hash < threshold``: no document is sorted, smaller budgets are nested in larger ones and
reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; a source without words has target 0; documents with equal ids share a hash and are
taken or left together; an empty table gives an empty result; a document is taken at most
MAX_EPOCHS times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlab.llm.common import scratch_table, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
LEVELS, LEVEL_BITS = 4, 12


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")


def hash48(id_col: str) -> Column:
    """The first 48 bits of the SHA-256 of the id as text (null: empty)."""
    return F.conv(F.substring(F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 256), 1, 12), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): the total shared by weight, no source above ``max_epochs``
    times its size. Sources in the order of cap per weight fill up first; the first whose cap
    exceeds its share of what is left sets the level for itself and all later ones.
    The windows run over one row per source, after full aggregation."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    per = per.withColumn("rank", rank).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)))
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(cap / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    per = per.withColumn("level", F.col("left").cast("double") / F.sum("weight").over(onward))
    free = F.when(cap >= F.col("weight") * F.col("level"), F.col("level"))
    per = per.withColumn("level", F.first(free, ignorenulls=True).over(everything))
    return per.select("source", "source_size",
                      F.least(cap.cast("double"), F.col("weight") * F.col("level")).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, threshold): each document is taken ``epochs``
    times, and once more where its hash is below ``threshold``."""
    empty = F.col("source_size") == 0
    plan = targets.select("source", "source_size", "target",
                          F.when(empty, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint").alias("epochs"))
    plan = plan.withColumn("budget", F.when(empty, 0.0).otherwise(F.col("target") - F.col("epochs") * F.col("source_size")))
    # done: words below `prefix`, all of them taken; cell: words in the bucket at `prefix`
    state = plan.select("*", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("done"),
                        F.lit(0).cast("bigint").alias("cell"))
    state = scratch_table(state, "mix-plan")
    rest = sizes.filter("size > 0").select(F.col("source").alias("src"), "hash", "size")
    for level in range(1, LEVELS + 1):
        shift, above = (LEVELS - level) * LEVEL_BITS, (LEVELS - level + 1) * LEVEL_BITS
        if level > 1:
            edge = state.select(F.col("source").alias("edge"), F.col("prefix").alias("at"))
            rest = rest.join(edge, F.col("src").eqNullSafe(F.col("edge")) & (F.shiftright("hash", above) == F.col("at")),
                             "inner").select("src", "hash", "size")
            rest = scratch_table(rest, "mix-edge") if level == 2 else rest
        hist = rest.groupBy("src", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        # at most 4096 buckets a source and level
        run = Window.partitionBy("src").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(run))
        hist = hist.join(state.select("source", "budget", F.col("done").alias("was")),
                         F.col("src").eqNullSafe(F.col("source")), "inner")
        over = F.col("was") + F.col("upto") > F.col("budget")
        edge = (hist.filter(over).groupBy("src").agg(F.min(F.struct(
            "bucket", "words", (F.col("was") + F.col("upto") - F.col("words")).alias("below"))).alias("e")))
        state = state.join(edge, F.col("source").eqNullSafe(F.col("src")), "left").select(
            "source", "source_size", "target", "epochs", "budget",
            F.coalesce("e.bucket", F.shiftleft("prefix", LEVEL_BITS)).alias("prefix"),
            F.coalesce("e.below", "done").alias("done"), F.coalesce("e.words", F.lit(0).cast("bigint")).alias("cell"))
        state = scratch_table(state, "mix-level")
    # the last bucket is one hash value: taken where that comes nearer to the budget
    nearer = F.col("done") + F.col("cell") - F.col("budget") < F.col("budget") - F.col("done")
    return state.select("source", "source_size", "target", "epochs",
                        (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...],
             max_epochs: int) -> tuple[DataFrame, DataFrame]:
    sizes = scratch_table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                      word_count(text_col).alias("size"), hash48(id_col).alias("hash")), "mix-sizes")
    return sizes, thresholds(sizes, source_targets(sizes, weights, max_epochs))


def _copies(hash_col: Column) -> Column:
    return F.col("epochs") + F.when(hash_col < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes, plan = _planned(docs, id_col, source_col, text_col, weights, max_epochs)
    plan = plan.withColumnRenamed("source", "plan_source")
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "inner")
    out = out.withColumn("copies", _copies(F.col("hash")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    _, plan = _planned(docs, id_col, source_col, text_col, weights, max_epochs)
    plan = plan.select(F.col("source").alias("plan_source"), "epochs", "threshold")
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("src"), hash48(id_col).alias("hash"))
    taken = rows.join(plan, F.col("src").eqNullSafe(F.col("plan_source")), "inner")
    return (taken.withColumn("copies", _copies(F.col("hash"))).filter("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
            .select("row.*"))
