"""Term frequencies without stopwords (A28, U-c)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# a word starts with a letter/digit/underscore and has at least two characters; an
# apostrophe may continue it. Unicode classes, never bare \w (ASCII-only in Java).
WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


def tokens(df: DataFrame, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Lower-cased word tokens, one row each (pure digit runs dropped)."""
    t = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD_PATTERN), 0))
    x = df.select(*keep, t.alias("term"))
    return x.filter(~F.col("term").rlike(r"^[0-9]+$"))


def given_stopwords(spark: SparkSession, *lists: Iterable[str]) -> DataFrame:
    """The union of given stopword lists (U-c), lower-cased, each word once."""
    words = sorted({w.strip().lower() for words in lists for w in words if w and w.strip()})
    return spark.createDataFrame([(w,) for w in words], "term string")


def corpus_stopwords(docs: DataFrame, text_col: str = "text", group_col: str = "lang", top: int = 50) -> DataFrame:
    """The ``top`` most frequent terms per group (ties by term), unioned over groups (U-c)."""
    c = tokens(docs, text_col, [group_col]).groupBy(group_col, "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group_col).orderBy(F.desc("n"), F.asc("term"))
    return c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).select("term").distinct()


def term_frequencies(df: DataFrame, text_col: str, stopwords: DataFrame, group_cols: Sequence[str] = (),
                     top: int = 200) -> DataFrame:
    """Counts of non-stopword terms per group, the ``top`` most frequent kept
    (ties by term) — the report is a top-k by design — and relative frequency n / max n.

    ``stopwords`` (column ``term``) are a given list (:func:`given_stopwords`) or the commonest terms
    (:func:`corpus_stopwords`). Terms are counted first, so the list meets one row per term, not every token.
    """
    c = tokens(df, text_col, list(group_cols)).groupBy(*group_cols, "term").agg(F.count(F.lit(1)).alias("n"))
    c = c.join(stopwords.select("term"), "term", "left_anti").select(*group_cols, "term", "n")
    if group_cols:
        # row_number ≤ top is planned as a WindowGroupLimit, applied before the shuffle too
        w = Window.partitionBy(*group_cols).orderBy(F.desc("n"), F.asc("term"))
        c = c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
        wmax = Window.partitionBy(*group_cols)
    else:
        # TakeOrderedAndProject: each task keeps its own top rows only
        c = c.orderBy(F.desc("n"), F.asc("term")).limit(top)
        c = c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("term"))))  # ≤ top rows
        wmax = Window.partitionBy(F.lit(0))
    return c.withColumn("rel_freq", F.col("n") / F.max("n").over(wmax))
