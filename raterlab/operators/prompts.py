"""Prompt, example and fine-tuning rendering.

Messages are ``array<struct<role:string,content:string>>`` columns built with
literal (non-regex) substitution; serialisation is ``to_json``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raterlab import constants as C
from raterlab.functions import text as T


def message(role: str | Column, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def template_content(template: Sequence[tuple[str, str]], i: int) -> Column:
    return F.lit(template[i][1])


def persona_grid(pubs: DataFrame, personas: DataFrame, seeds: Sequence[int] | None = None,
                 persona_cols: Sequence[str] = ("persona", "narrative")) -> DataFrame:
    """Every publication × persona (× seed).

    The persona table is configuration (a handful of rows); it is turned into one
    array by a scalar subquery and exploded per publication — a Generate, not a
    join, so the publication side is never shuffled.
    """
    arr = personas.select(F.array_sort(F.collect_list(F.struct(*persona_cols)))).scalar()
    x = pubs.withColumn("_p", F.explode(arr)).select("*", "_p.*").drop("_p")
    if seeds is not None:
        x = x.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    return x


def zero_shot_messages(narrative: Column, text: Column,
                       template: Sequence[tuple[str, str]] = C.EVALUATE_TEMPLATE) -> Column:
    """L1: system message with the persona narrative, user message with the publication."""
    sys_msg = message(template[0][0], T.literal_replace(template_content(template, 0), C.CONTEXT_TOKEN, narrative))
    usr_msg = message(template[1][0], T.literal_replace(template_content(template, 1), C.PUBLICATION_TOKEN, text))
    return F.array(sys_msg, usr_msg)


def first_examples(examples: DataFrame, n: int = C.FEW_SHOT_EXAMPLES, key: str = "persona",
                   order_col: str = "pos") -> DataFrame:
    """O2: first ``n`` examples per persona in file order (planned as a WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy(order_col)
    return examples.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def few_shot_table(personas: DataFrame, examples: DataFrame, n: int = C.FEW_SHOT_EXAMPLES) -> DataFrame:
    """L2 pieces: per persona the narrative and its first ``n`` (user, assistant) shots
    as alternating messages (at most 2·n per persona)."""
    shots = (first_examples(examples, n)
             .groupBy("persona")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "input", "output"))).alias("_ex")))
    shots = shots.select("persona", F.flatten(F.transform(
        "_ex", lambda e: F.array(message("user", e["input"]), message("assistant", e["output"])))).alias("shots"))
    return personas.join(shots, "persona", "left").select(
        "persona", "narrative", F.coalesce("shots", F.array().cast("array<struct<role:string,content:string>>"))
        .alias("shots"))


def few_shot_messages(narrative: Column, shots: Column, text: Column,
                      template: Sequence[tuple[str, str]] = C.EVALUATE_TEMPLATE) -> Column:
    """L2: template[0], the shots, then template[1]."""
    z = zero_shot_messages(narrative, text, template)
    return F.concat(F.array(z[0]), shots, F.array(z[1]))


def label_json(emotion: Column, emotion_class: Column, level: Column, context: Column,
               description: Column) -> Column:
    """the assistant answer, key order and separators as Python's ``json.dumps``
    (non-ASCII kept, null kept). ``context`` is already serialised (text or list)."""
    def s(c):
        return F.when(c.isNull(), F.lit("null")).otherwise(T.json_string(c))
    lvl = F.when(level.isNull(), F.lit("null")).otherwise(level.cast("string"))
    return F.concat(F.lit('{"emotion": '), s(emotion), F.lit(', "emotion_class": '), s(emotion_class),
                    F.lit(', "trigger_level": '), lvl, F.lit(', "context": '), context,
                    F.lit(', "description": '), s(description), F.lit("}"))


def finetune_messages(narrative: Column, text: Column, answer: Column,
                      template: Sequence[tuple[str, str]] = C.EVALUATE_TEMPLATE) -> Column:
    """L3: system (persona), user (the fenced publication token replaced, backticks
    included), assistant (the label JSON)."""
    sys_msg = message(template[0][0], T.literal_replace(template_content(template, 0), C.CONTEXT_TOKEN, narrative))
    usr_msg = message(template[1][0], T.literal_replace(template_content(template, 1), C.FENCED_PUBLICATION_TOKEN, text))
    return F.array(sys_msg, usr_msg, message("assistant", answer))


def finetune_examples(annotations: DataFrame, personas: DataFrame, splits: DataFrame,
                      split_names: Sequence[str] = ("ft_training", "ft_validation"),
                      context_as: str = "text", on_missing_description: str = "raise",
                      template: Sequence[tuple[str, str]] = C.EVALUATE_TEMPLATE) -> DataFrame:
    """L3 + P6 over all personas with an annotator; returns (persona, split_name, id, messages).

    ``context_as='text'`` serialises the phrase list as the Python-literal text the
    original read back from CSV; ``'list'`` writes a JSON list.
    ``on_missing_description``: ``'raise'`` (original), ``'keep'`` (writes null).
    """
    need = {"emotion", "emotion_class", "trigger_level", "context", "description"}
    missing = need - set(annotations.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    per = personas.filter(F.col("annotator").isNotNull()).select("persona", "narrative",
                                                                  F.col("annotator").alias("created_by"))
    x = annotations.join(F.broadcast(per), "created_by").join(
        splits.filter(F.col("split_name").isin(*split_names)), "id")
    if on_missing_description == "raise":
        bad = x.filter(F.col("description").isNull()).select("persona", "id").limit(20).collect()
        if bad:
            raise ValueError(f"annotations without description: {bad}")
    ctx = T.python_literal_list(F.col("context")) if context_as == "text" else T.json_string_array(F.col("context"))
    if context_as == "text":
        ctx = T.json_string(ctx)
    ans = label_json(F.col("emotion"), F.col("emotion_class"), F.col("trigger_level"), ctx, F.col("description"))
    return x.select("persona", "split_name", "id",
                    finetune_messages(F.col("narrative"), F.col("text"), ans, template).alias("messages"))


def persona_prompts(clusters: DataFrame, template: Sequence[tuple[str, str]] = C.PERSONA_TEMPLATE) -> DataFrame:
    """Persona-narrative prompt for each cluster description."""
    msgs = F.array(message(template[0][0], template_content(template, 0)),
                   message(template[1][0], T.literal_replace(template_content(template, 1), C.CLUSTER_TOKEN,
                                                             F.col("cluster_description"))))
    return clusters.select("*", msgs.alias("messages"))


def messages_by_conversation(turns: DataFrame) -> DataFrame:
    """Chat examples from turn rows: (conv_id, messages ordered by turn)."""
    return (turns.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
            .select("conv_id", F.transform("_m", lambda m: message(m["role"], m["text"])).alias("messages")))


def chat_jsonl(messages: Column) -> Column:
    """K3 line format: ``{"messages": [...]}`` (compact JSON)."""
    return F.to_json(F.struct(messages.alias("messages")))
