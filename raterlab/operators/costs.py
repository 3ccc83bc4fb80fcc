"""Chat-set quality and fine-tuning cost estimate.

Per-example quantities are plain aggregates over message rows (no message list is
collected), then a second aggregation gives the distribution and the estimate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlab import constants as C
from raterlab.functions.tokens import regex_tokens
from raterlab.operators.ranks import quantiles


def example_stats(turns: DataFrame, key: str = "conv_id", role_col: str = "role", text_col: str = "text",
                  tok: Callable[[Column], Column] = regex_tokens,
                  tokens_per_message: int = C.TOKENS_PER_MESSAGE) -> DataFrame:
    """A23/A24 per example: message count, system/user presence, total tokens
    (``3 + tok(role) + tok(content)`` per message, ``+ 3`` priming) and assistant tokens."""
    per_msg = tokens_per_message + tok(F.col(role_col)) + tok(F.col(text_col))
    return turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.max((F.col(role_col) == "system").cast("int")).alias("has_system"),
        F.max((F.col(role_col) == "user").cast("int")).alias("has_user"),
        (F.sum(per_msg) + C.REPLY_PRIMING_TOKENS).alias("n_tokens"),
        F.sum(F.when(F.col(role_col) == "assistant", tok(F.col(text_col))).otherwise(0)).alias("n_assistant_tokens"))


def example_stats_in_row(examples: DataFrame, key: str, messages_col: str = "messages",
                         tok: Callable[[Column], Column] = regex_tokens,
                         tokens_per_message: int = C.TOKENS_PER_MESSAGE) -> DataFrame:
    """A23/A24 on rows that hold their message list: nothing is exploded or shuffled, and an example
    without messages (or with none at all) counts as one with zero messages. A message's ``name`` counts as its
    tokens and TOKENS_PER_NAME more where the list has that field."""
    messages = F.coalesce(F.col(messages_col), F.array().cast(examples.schema[messages_col].dataType))
    named = "name" in examples.schema[messages_col].dataType.elementType.names

    def tokens(text: Column) -> Column:
        return F.coalesce(tok(text), F.lit(0)).cast("long")

    def of(m: Column) -> Column:
        n = tokens_per_message + tokens(m["role"]) + tokens(m["content"])
        return n + F.when(m["name"].isNotNull(), tokens(m["name"]) + C.TOKENS_PER_NAME).otherwise(0) if named else n

    def total(each: Callable[[Column], Column]) -> Column:
        return F.aggregate(messages, F.lit(0).cast("long"), lambda acc, m: acc + each(m))

    def has(role: str) -> Column:
        return F.exists(messages, lambda m: F.coalesce(m["role"] == role, F.lit(False))).cast("int")
    return examples.select(
        key, F.size(messages).cast("long").alias("n_messages"), has("system").alias("has_system"), has("user").alias("has_user"),
        (total(of) + C.REPLY_PRIMING_TOKENS).alias("n_tokens"),
        total(lambda m: F.when(m["role"] == "assistant", tokens(m["content"])).otherwise(0)).alias("n_assistant_tokens"))


def chat_quality(stats: DataFrame) -> DataFrame:
    """Examples missing a system / user message."""
    return stats.agg(F.count(F.lit(1)).alias("n_examples"),
                     F.count_if(F.col("has_system") == 0).alias("n_missing_system"),
                     F.count_if(F.col("has_user") == 0).alias("n_missing_user"))


def distribution(stats: DataFrame, cols=("n_messages", "n_tokens", "n_assistant_tokens")) -> DataFrame:
    """Min, max, mean, median and the 0.1 / 0.9 quantiles (printed as "p5/p95"
    by the original; named for what they are here), linear interpolation."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols]))
    x = stats.select(rows.alias("r")).select("r.*")
    q = quantiles(x, ["name"], "v", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return x.groupBy("name").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean")).join(q, "name", "left")


def billing_estimate(stats: DataFrame, n_epochs: int = C.TARGET_EPOCHS, price: float | None = C.PRICE_PER_MILLION,
                     max_tokens: float = C.MAX_TOKENS_PER_EXAMPLE) -> DataFrame:
    """Over-limit count, billed tokens (each example capped), the epoch rule
    and the price. ``charged_price`` is billed·price/1e6 as the original prints it;
    ``charged_price_all_epochs`` multiplies by the epochs."""
    x = stats.agg(F.count(F.lit(1)).alias("n_examples"),
                  F.count_if(F.col("n_tokens") > max_tokens).alias("n_too_long"),
                  F.sum(F.least(F.col("n_tokens").cast("double"), F.lit(float(max_tokens)))).alias("billing_tokens"))
    n = F.col("n_examples")
    # an empty data set has no epoch count (NULL) instead of a division by zero
    epochs = (F.when(n == 0, F.lit(None))
               .when(n * C.TARGET_EPOCHS < C.MIN_TARGET_EXAMPLES,
                     F.least(F.lit(C.MAX_DEFAULT_EPOCHS), F.floor(F.try_divide(F.lit(C.MIN_TARGET_EXAMPLES), n))))
               .when(n * C.TARGET_EPOCHS > C.MAX_TARGET_EXAMPLES,
                     F.greatest(F.lit(C.MIN_DEFAULT_EPOCHS), F.floor(F.try_divide(F.lit(C.MAX_TARGET_EXAMPLES), n))))
               .otherwise(F.lit(n_epochs))).cast("long")
    x = x.withColumn("n_epochs", epochs).withColumn("charged_tokens", F.col("n_epochs") * F.col("billing_tokens"))
    if price is not None:
        x = (x.withColumn("charged_price", F.col("billing_tokens") * float(price) / 1e6)
              .withColumn("charged_price_all_epochs", F.col("charged_tokens") * float(price) / 1e6))
    return x
