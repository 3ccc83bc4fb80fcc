"""Derived views over the driver tables (see FIXTURES.md part B).

Each view is a pure DataFrame expression over the parquet inputs, so its work
grows with them; nothing here is collected or generated on the driver.
The matching DuckDB CTEs live in ``raterlab.plans.oracle``.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlab import constants as C
from raterlab.functions import text as T
from raterlab.operators import splits as S

RATERS = ["a", "b"]
PERSONA_RATER = {"persona_1": "a", "persona_2": "b"}
PERSONA_NARRATIVE = {
    "persona_1": "You are a retired teacher from a small town who reads the news every morning.",
    "persona_2": "You are a young software developer living in the capital who follows politics online.",
}
CLUSTERS = {
    "persona_1": "older, rural, reads print media, values stability",
    "persona_2": "younger, urban, reads social media, values change",
}
ABSENT_PHRASE = "zzq absent phrase"
NESTED_ITEM_JSON = '["nested"]'


def view(fn):
    """Memoise a view *definition* per (session, arguments).

    DataFrames are immutable lazy plans, so handing the same object to every query
    that uses a view is safe; it saves re-building (and re-analysing) large
    expression trees in each query. No data is cached.
    """
    @functools.wraps(fn)
    def wrapper(spark, *args, **kw):
        views = vars(spark).setdefault("_raterlab_views", {})  # ends with its session
        key = (fn.__name__, args, tuple(sorted(kw.items())))
        if key not in views:
            views[key] = fn(spark, *args, **kw)
        return views[key]
    return wrapper


@view
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table, as it is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rater_id(letter: str | Column) -> Column:
    """Annotator pseudonym of fixture rater ``letter`` (F1 over ``rater_<letter>``)."""
    lit = F.lit(letter) if isinstance(letter, str) else letter
    return T.pseudonym(F.concat(F.lit("rater_"), lit))


@view
def publications(spark: SparkSession, sf_dir: str, with_lang: bool = False) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    m = F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    cols = [F.col("doc_id").alias("id"), "text", F.concat(F.lit("2024-"), m, F.lit("-"), day).alias("date")]
    if with_lang:
        cols.append("lang")
    return d.select(*cols)


@view
def personas(spark: SparkSession) -> DataFrame:
    """personas(persona, annotator, narrative) — a literal of two rows."""
    rows = [(p, PERSONA_RATER[p], PERSONA_NARRATIVE[p]) for p in C.PERSONAS]
    df = spark.createDataFrame(rows, "persona string, rater string, narrative string")
    return df.select("persona", rater_id(F.col("rater")).alias("annotator"), "narrative")


@view
def clusters(spark: SparkSession) -> DataFrame:
    rows = [(p, CLUSTERS[p]) for p in C.PERSONAS]
    return spark.createDataFrame(rows, "persona string, cluster_description string")


def _emotion_at(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in C.EMOTIONS]), (k + 1).cast("int"))


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))


@view
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (rater, publication) for both fixture raters (rater letter expanded in-row)."""
    pubs = publications(spark, sf_dir, with_lang=True)
    x = pubs.withColumn("rater", F.explode(F.array(*[F.lit(r) for r in RATERS])))
    i = F.col("id")
    is_a = F.col("rater") == "a"
    k = F.when(is_a, i % 7).otherwise((i + F.when(i % 5 == 0, 1).otherwise(0)) % 7)
    level = F.when(is_a, i % 5 + 1).otherwise((i + i % 3) % 5 + 1)
    spans = F.when(is_a, F.array(_span(i % 7, i % 7 + 11))).otherwise(
        F.array(_span(i % 5, i % 5 + 7), _span(i % 5 + 20, i % 5 + 25)))
    spans = F.filter(spans, lambda s: s["end"] < F.length("text"))
    x = (x.withColumn("k", k)
          .withColumn("context_locations", spans)
          .select(
              rater_id(F.col("rater")).alias("created_by"), "rater", "id", "text", "lang",
              _emotion_at(F.col("k")).alias("emotion"),
              F.when(F.col("k").isin(1, 2, 3), "positive").otherwise("negative").alias("emotion_class"),
              level.cast("int").alias("trigger_level"),
              F.transform("context_locations", lambda s: T.span_text(F.col("text"), s)).alias("context"),
              "context_locations",
              F.when(i % 4 == 0, F.lit(None).cast("string"))
               .otherwise(F.concat(F.lit("rater "), F.col("rater"), F.lit(" note "), i.cast("string")))
               .alias("description"),
              F.col("date").alias("created_at")))
    return x


@view
def runs(spark: SparkSession) -> DataFrame:
    """Scored runs: (approach, approach_no, persona key, source rater, seed) — 27 literal rows."""
    rows = []
    for n, a in enumerate(C.APPROACHES, start=1):
        keys = [(C.BASELINE_PERSONA, "a")] if a == C.BASELINE_APPROACH else [(p, PERSONA_RATER[p]) for p in C.PERSONAS]
        for p, r in keys:
            for s in C.SEEDS:
                rows.append((a, n, p, r, s))
    return spark.createDataFrame(rows, "approach string, approach_no int, persona string, rater string, seed int")


@view
def predictions(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Prediction envelopes for every publication and run; ``output`` is free-form JSON text. ``tasks``: for writers, so
    many tasks; without it, adaptive execution chooses by the bytes of the rows that are still to become 27 each.

    By ``id % 11``: 0 failure record; 1 level as text; 2 level 3.7-style; 3 level as "3.7";
    4 emotion outside the domain; 5 context as Python-literal text; 6 extra absent phrase;
    7 nested-list item; 8 class null; 9 context key missing; else clean.
    """
    # the given documents are one file: its (text-free) annotation rows are dealt to all tasks before they
    # become 27 predictions each, as result files would be
    ann = annotations(spark, sf_dir).drop("text")
    ann = ann.repartition(tasks, "id") if tasks else ann.repartition("id")
    x = ann.join(F.broadcast(runs(spark)), "rater")
    i = F.col("id")
    shift = (i + F.col("seed") + F.col("approach_no")) % 4 == 0
    k = F.array_position(F.array(*[F.lit(e) for e in C.EMOTIONS]), F.col("emotion")) - 1
    emo = F.when(shift, _emotion_at((k + 1) % 7)).otherwise(F.col("emotion"))
    cls = F.when(shift, F.when(F.col("emotion_class") == "positive", "negative").otherwise("positive")) \
           .otherwise(F.col("emotion_class"))
    lvl = F.when(shift, F.col("trigger_level") % 5 + 1).otherwise(F.col("trigger_level")).cast("string")
    phrases = F.when(F.col("lang") == "en", F.transform("context", F.upper)).otherwise(F.col("context"))
    v = i % 11
    emo_j = F.when(v == 4, F.lit('"happiness"')).otherwise(T.json_string(emo))
    cls_j = F.when(v == 8, F.lit("null")).otherwise(T.json_string(cls))
    lvl_j = (F.when(v == 1, F.concat(F.lit('"'), lvl, F.lit('"')))
              .when(v == 2, F.concat(lvl, F.lit(".7")))
              .when(v == 3, F.concat(F.lit('"'), lvl, F.lit('.7"')))
              .otherwise(lvl))
    items = F.array_join(F.transform(phrases, T.json_string), ", ")
    ctx_j = (F.when(v == 5, T.json_string(T.python_literal_list(phrases)))
              .when(v == 6, T.json_string_array(F.concat(phrases, F.array(F.lit(ABSENT_PHRASE)))))
              .when(v == 7, F.concat(F.lit("[" + NESTED_ITEM_JSON),
                                     F.when(F.size(phrases) > 0, F.concat(F.lit(", "), items)).otherwise(F.lit("")),
                                     F.lit("]")))
              .otherwise(T.json_string_array(phrases)))
    ctx_part = F.when(v == 9, F.lit("")).otherwise(F.concat(F.lit(', "context": '), ctx_j))
    body = F.concat(F.lit('{"emotion": '), emo_j, F.lit(', "emotion_class": '), cls_j,
                    F.lit(', "trigger_level": '), lvl_j, ctx_part,
                    F.lit(', "description": '), T.json_string(F.concat(F.lit("felt "), emo)), F.lit("}"))
    output = F.when(v == 0, F.lit(C.FAILED_OUTPUT_JSON)).otherwise(body)
    return x.select("approach", "persona", "seed", "id",
                    F.lit(C.MODEL_NAME).alias("model_name"), F.lit(C.TEMPERATURE).alias("temperature"),
                    F.lit(C.MAX_TOKENS).alias("max_tokens"), output.alias("output"))


@view
def evaluation_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth per persona on the evaluation split: personas ⋈ annotations ⋉ split."""
    ann = annotations(spark, sf_dir)
    per = personas(spark).select("persona", F.col("annotator").alias("created_by"))
    t = ann.join(F.broadcast(per), "created_by")
    return S.in_date_split(t, publications(spark, sf_dir), "evaluation")


@view
def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels.quality as rater 1 and labels.toxic as rater 2, paired by doc."""
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")


@view
def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations → one chat example per conversation, messages ordered by turn."""
    from raterlab.operators import prompts as P
    return P.messages_by_conversation(read(spark, sf_dir, "conversations"))


PROJECT = "emotion_triggers"
_CLS_ARRAY = ("array<struct<value:string,checklist_answers:array<struct<value:string>>,"
              "radio_answer:struct<value:string>,text_answer:struct<content:string>>>")
SHORT_TEXT = 40


@view
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw annotation export (one data row per publication, labels of both raters).

    Rater ``b`` gives no emotion answer on texts shorter than ``SHORT_TEXT`` chars,
    which exercises the quarantine path (P7) and the completeness check (J8).
    """
    a = annotations(spark, sf_dir)
    skip_emotion = (F.col("rater") == "b") & (F.length("text") < SHORT_TEXT)
    null_cl = F.lit(None).cast("array<struct<value:string>>")
    null_radio = F.lit(None).cast("struct<value:string>")
    null_text = F.lit(None).cast("struct<content:string>")

    def entry(value, checklist=None, radio=None, text=None):
        return F.struct(F.lit(value).alias("value"),
                        (checklist if checklist is not None else null_cl).alias("checklist_answers"),
                        (radio if radio is not None else null_radio).alias("radio_answer"),
                        (text if text is not None else null_text).alias("text_answer"))

    emo = entry(C.EXPORT_EMOTION, checklist=F.array(F.struct(F.col("emotion").alias("value"))))
    cls = entry(C.EXPORT_EMOTION_CLASS, radio=F.struct(F.col("emotion_class").alias("value")))
    lvl = entry(C.EXPORT_TRIGGER_LEVEL,
                checklist=F.array(F.struct(F.col("trigger_level").cast("string").alias("value"))))
    desc = entry(C.EXPORT_DESCRIPTION, text=F.struct(F.col("description").alias("content")))
    classifications = F.concat(
        F.when(skip_emotion, F.array().cast(_CLS_ARRAY))
         .otherwise(F.array(emo)),
        F.array(cls, lvl),
        F.when(F.col("description").isNull(), F.array().cast(_CLS_ARRAY))
         .otherwise(F.array(desc)))
    objects = F.transform(F.arrays_zip("context", "context_locations"), lambda z: F.struct(
        F.lit(C.EXPORT_PHRASES).alias("value"),
        F.struct(z["context_locations"]["start"].alias("start"), z["context_locations"]["end"].alias("end"),
                 z["context"].alias("token")).alias("location")))
    label = F.struct(
        F.struct(F.concat(F.lit("rater_"), F.col("rater")).alias("created_by"), F.col("created_at")).alias("label_details"),
        F.struct(classifications.alias("classifications"), objects.alias("objects")).alias("annotations"))
    per_doc = a.groupBy("id", "text").agg(F.collect_list(label).alias("labels"))  # ≤ one label per rater
    return per_doc.select(
        F.create_map(F.lit(PROJECT), F.struct(F.col("labels").alias("labels"))).alias("projects"),
        F.struct(F.col("text").alias("row_data"), F.col("id").cast("string").alias("global_key")).alias("data_row"))


@view
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-publication description file: conversation turns keyed by conversation id,
    system turns carry no description (null), file order = turn."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"),
                    F.when(F.col("role") == "system", F.lit(None).cast("string")).otherwise(F.col("text"))
                    .alias("description"))


ASSISTANT_NARRATIVE = "You are a helpful assistant."


@view
def personas_with_assistant(spark: SparkSession) -> DataFrame:
    """Zero-shot persona list: the two personas plus the context-free assistant."""
    extra = spark.createDataFrame([(C.BASELINE_PERSONA, None, ASSISTANT_NARRATIVE)],
                                  "persona string, annotator string, narrative string")
    return personas(spark).unionByName(extra)


@view
def few_shot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few-shot example file per persona: the persona annotator's ft_training rows in
    split order; input = rendered user message, output = label JSON."""
    from raterlab.operators import prompts as P
    ann = annotations(spark, sf_dir)
    per = personas(spark).select("persona", F.col("annotator").alias("created_by"))
    x = S.in_date_split(ann.join(F.broadcast(per), "created_by"), publications(spark, sf_dir), "ft_training")
    user = T.literal_replace(F.lit(C.EVALUATE_TEMPLATE[1][1]), C.PUBLICATION_TOKEN, F.col("text"))
    out = P.label_json(F.col("emotion"), F.col("emotion_class"), F.col("trigger_level"),
                       T.json_string_array(F.col("context")), F.col("description"))
    return x.select("persona", F.struct(F.col("created_at").alias("date"), F.col("id")).alias("pos"),
                    user.alias("input"), out.alias("output"))


@view
def source_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster descriptions derived from the corpus: one per document source."""
    d = read(spark, sf_dir, "documents")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"),
                                F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("langs"),
                                F.sum("n_chars").alias("chars"))
    desc = F.concat(F.lit("source "), F.col("source"), F.lit(": "), F.col("n").cast("string"),
                    F.lit(" documents in "), F.col("langs"), F.lit(", "), F.col("chars").cast("string"),
                    F.lit(" characters"))
    return g.select("source", desc.alias("cluster_description"))


GRID_APPROACH = "context_zero_shot"


@view
def work_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append log of an earlier run: grid rows of labelled documents; documents with
    quality 0 were scored twice, the later line being a failure record."""
    from raterlab.operators import scoring as SC
    pubs = S.in_date_split(publications(spark, sf_dir), publications(spark, sf_dir), "evaluation")
    grid = SC.work_grid(pubs.select("id"), personas(spark), GRID_APPROACH)
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    x = grid.join(lab, "id", "inner")
    x = x.withColumn("ingest_ts", F.explode(F.when(F.col("quality") == 0, F.array(F.lit(1), F.lit(2)))
                                            .otherwise(F.array(F.lit(1))).cast("array<bigint>")))
    out = F.when(F.col("ingest_ts") == 2, F.lit(C.FAILED_OUTPUT_JSON)).otherwise(
        F.lit('{"emotion": "fear", "emotion_class": "negative", "trigger_level": 2}'))
    return x.select("persona", "approach", "seed", "id", "ingest_ts", out.alias("output"))
