"""End-to-end jobs: the preparation, scoring and evaluation workflows as single
Spark plans over files (each is a composition of the operators).

Outputs are written with the sinks; every job returns the DataFrame it wrote or
the small report it computed.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raterlab import constants as C
from raterlab.operators import annotations as AN
from raterlab.operators import costs as CS
from raterlab.operators import evaluation as E
from raterlab.operators import prompts as PR
from raterlab.operators import scoring as SC
from raterlab.operators import splits as SP
from raterlab.operators import validate as V
from raterlab.session import ensure_checkpoint_dir, read_if_exists
from raterlab.sources import files as SRC
from raterlab.sources import sinks as SNK


def prepare_splits(spark: SparkSession, publications: DataFrame, annotations: DataFrame, out_dir: str,
                   descriptions: dict[str, DataFrame] | None = None, refresh: bool = False) -> DataFrame:
    """E3 middle: date split (kept once computed), description override per annotator,
    completeness check, one folder per (annotator, split)."""
    splits = SNK.split_table(SP.date_split(publications), f"{out_dir}/splits", refresh=refresh)
    ann = annotations
    if descriptions:
        parts = [d.select(F.lit(who).alias("created_by"), "id", "description", "pos") for who, d in descriptions.items() if d is not None]
        given = functools.reduce(DataFrame.unionByName, parts) if parts else None
        ann = AN.override_descriptions(ann, given, ["created_by", "id"])
    SP.assert_complete(SP.missing_annotations(splits, ann, ann), SP.duplicate_annotations(ann))
    out = ann.join(splits, "id")
    SNK.annotation_splits(out, f"{out_dir}/annotations")
    return out


def prepare_finetune(spark: SparkSession, annotations: DataFrame, personas: DataFrame, splits: DataFrame,
                     out_dir: str, **kw) -> DataFrame:
    """E3 tail: fine-tuning JSONL per (persona, split)."""
    ex = PR.finetune_examples(annotations, personas, splits, **kw)
    SNK.finetune_jsonl(ex, out_dir)
    return ex


def estimate_costs(spark: SparkSession, chat_dir: str, price: float | None = C.PRICE_PER_MILLION) -> dict:
    """A23–A27 over a folder of chat-example JSONL files; returns the three small tables."""
    ex = SRC.chat_examples(spark, chat_dir).withColumn("conv_id", F.monotonically_increasing_id())
    stats = CS.example_stats_in_row(ex, "conv_id")
    return {"quality": CS.chat_quality(stats), "distribution": CS.distribution(stats),
            "billing": CS.billing_estimate(stats, price=price)}


def run_inference(spark: SparkSession, publications: DataFrame, splits: DataFrame, personas: DataFrame,
                  approach: str, scorer, result_dir: str, seeds: Sequence[int] = C.SEEDS,
                  few_shot_examples: DataFrame | None = None, n_examples: int = C.FEW_SHOT_EXAMPLES,
                  parallelism: int | None = None, model_name: str | dict[str, str] = C.MODEL_NAME,
                  temperature: float = C.TEMPERATURE, max_tokens: int = C.MAX_TOKENS) -> DataFrame:
    """Score the evaluation split for every persona and seed, skipping what the
    result table already holds; zero-shot prompts, or few-shot when examples are given.
    ``model_name`` may map each persona to its own (fine-tuned) model."""
    pubs = SP.in_split(publications, splits, "evaluation")
    done = read_if_exists(lambda: spark.read.parquet(result_dir))
    if few_shot_examples is not None:
        table = PR.few_shot_table(personas, few_shot_examples, n_examples)
        todo = SC.pending_with_texts(pubs, table, approach, seeds, done, ("persona", "narrative", "shots"))
        msgs = PR.few_shot_messages(F.col("narrative"), F.col("shots"), F.col("text"))
    else:
        todo = SC.pending_with_texts(pubs, personas, approach, seeds, done)
        msgs = PR.zero_shot_messages(F.col("narrative"), F.col("text"))
    scored = SC.run_scorer(todo.select(*SC.KEY, msgs.alias("messages")), scorer, model_name, temperature, max_tokens, parallelism)
    SC.append_results(scored, result_dir)
    return spark.read.parquet(result_dir)


def evaluate(spark: SparkSession, truth: DataFrame, predictions: DataFrame, publications: DataFrame,
             report_dir: str | None = None, penalty: str = "original", strict_alignment: bool = True) -> DataFrame:
    """Validate, align (V8 gate), metric row per run, mean ± 3·std per approach.

    With the gate on, the validated predictions (text already dropped) have two
    consumers; they are checkpointed to ``spark.checkpoint.dir`` once so the text
    join and validation run a single time and the lineage is cut.
    """
    valid = V.expand_baseline(V.validate_predictions(predictions, publications))
    if strict_alignment:
        ensure_checkpoint_dir(spark)
        valid = valid.checkpoint(eager=True)
        E.check_alignment(E.alignment_gaps(truth, valid))
    report = E.evaluation_report(E.run_cells(E.align(truth, valid)), penalty)
    if report_dir:
        # a few rows, needed three times
        ensure_checkpoint_dir(spark)
        report = report.checkpoint(eager=True)
    summary = E.report_mean_3std(report)
    if report_dir:
        SNK.report_csv(report, f"{report_dir}/report_runs")
        SNK.report_csv(summary, f"{report_dir}/report_all")
    return summary


def evaluate_files(spark: SparkSession, truth_dir: str, completed_dir: str, publications_csv: str,
                   persona_annotator: dict[str, str], report_dir: str | None = None,
                   penalty: str = "original", expected_rows: int | None = None,
                   strict_alignment: bool = True) -> DataFrame:
    """E1 straight from the original file layout: ``{annotator}_{split}.csv`` truth
    files (Python-literal list columns), ``{persona}_{approach}_seed={n}.jsonl``
    prediction files and the publications CSV; ``persona_annotator`` maps each
    evaluated persona to its annotator pseudonym."""
    truth = SRC.annotation_splits_flat(spark, truth_dir).filter(F.col("split_name") == "evaluation")
    per = spark.createDataFrame(list(persona_annotator.items()), "persona string, created_by string")
    truth = truth.join(F.broadcast(per), "created_by").withColumn("trigger_level", F.col("trigger_level").cast("int"))
    preds = SRC.predictions_flat(spark, completed_dir)
    if expected_rows is not None:
        bad = (preds.groupBy("persona", "approach", "seed").count()
               .filter(F.col("count") != expected_rows).limit(20).collect())
        if bad:
            raise ValueError(f"runs with a row count other than {expected_rows}: {bad}")
    pubs = SRC.publications_csv(spark, publications_csv)
    return evaluate(spark, truth, preds, pubs, report_dir, penalty, strict_alignment)


def agreement_report(spark: SparkSession, annotations_json: str, rater_a: str, rater_b: str,
                     stopwords: DataFrame | None = None, top_terms: int = 200) -> dict[str, DataFrame]:
    """E4 from the ``{annotator: [records]}`` file: pairing, contingency tables, κ,
    χ² with p, normality per rater, Mann–Whitney with p, span-overlap summary and
    overlap terms. Every entry is a small DataFrame."""
    from raterlab.functions.coerce import strict_int
    from raterlab.operators import agreement as AG
    from raterlab.operators import hypothesis as HY
    from raterlab.operators import terms as TM
    ann = SRC.annotations_by_rater(spark, annotations_json).withColumn(
        "trigger_level", strict_int(F.col("trigger_level")))
    fields = ["emotion", "emotion_class", "trigger_level"]
    pairs = AG.pair_raters(ann, rater_a, rater_b, fields + ["context_locations", "text"]) \
        .withColumnRenamed("a_text", "text").drop("b_text")
    ct = AG.crosstab_long(pairs, fields)
    ov = AG.span_pairs_overlap(pairs)
    levels = ann.filter(F.col("created_by").isin(rater_a, rater_b)).select(
        F.lit("trigger_level").alias("test"), F.when(F.col("created_by") == rater_a, "a").otherwise("b").alias("side"),
        F.col("trigger_level").cast("double").alias("x"))
    out = {
        "crosstab": ct,
        "kappa": AG.cohen_kappa(ct),
        "chi2": HY.with_chi2_p(AG.chi2_statistic(ct.filter(F.col("field") != "trigger_level"))),
        "normality": HY.normality_k2(ann.select("created_by", F.col("trigger_level").cast("double").alias("x")),
                                     ["created_by"], "x"),
        "mann_whitney": HY.with_mann_whitney_p(HY.mann_whitney(levels, "test", "side", "x")),
        "overlap": AG.overlap_summary(ov),
        "mean_span_length": AG.mean_span_length(ann),
    }
    if stopwords is not None:
        out["overlap_terms"] = TM.term_frequencies(AG.overlap_text(ov), "overlap_text", stopwords, top=top_terms)
    return out
