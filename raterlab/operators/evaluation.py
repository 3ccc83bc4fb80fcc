"""Evaluation of predictions against truth.

Plan shape: predictions are shuffled by id once, for the text join; truth, reduced to one row
per id, joins them there. Kept in tables bucketed by id (``sinks.bucketed_table``), neither moves. One partial aggregation then reduces every aligned row to *run cells*:
counts per (approach, persona, seed, field, y, yhat) plus the span sums of §A3/A4.
The cells table is bounded by runs × fields × |labels|², independent of corpus
size; every metric below is computed from it, so no second pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raterlab import constants as C
from raterlab.functions import text as T

RUN_KEY = ["approach", "persona", "seed"]
_EMPTY_SPANS = "array<struct<start:int,end:int>>"


TRUTH = ["emotion", "emotion_class", "trigger_level", "context", "context_locations"]


def truth_by_id(truth: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per id with the truth of all its personas (as many as there are personas), so that predictions
    meet it on the id alone, by which the text join has partitioned them already."""
    return truth.groupBy(id_col).agg(F.collect_list(F.struct("persona", *TRUTH)).alias("truths"))


def align_by_id(truths: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    """J6 on truth reduced to one row per id."""
    p = pred.select(*RUN_KEY, id_col, *TRUTH, "context_corrupted", "failed")
    x = p.join(truths, id_col).withColumn("_own", F.explode(F.filter("truths", lambda t: t["persona"] == F.col("persona"))))
    return x.select(id_col, *[F.col(f"_own.{c}").alias(f"t_{c}") for c in TRUTH], *[c for c in p.columns if c != id_col])


def align(truth: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    """Pair truth and validated predictions on (persona, id).

    Truth columns get a ``t_`` prefix. Row order is irrelevant: the original
    sort-and-zip becomes an equi-join.
    """
    return align_by_id(truth_by_id(truth, id_col), pred, id_col)


def _pred_spans_exclusive(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["end"] - 1).alias("end")))


def run_cells(aligned: DataFrame, pred_end: str = "original") -> DataFrame:
    """Reduce aligned rows to per-run cells.

    Row-level span quantities are computed once per row and summed by a first
    aggregation on the joint label tuple (run × three (y, yhat) pairs — bounded by
    the label domains); only that small result is exploded into the three fields,
    with the span sums kept on the ``emotion`` entry so they are not triple counted.
    ``pred_end='exclusive'`` computes the overlap with predicted ends made exclusive.
    """
    tl = F.coalesce(F.col("t_context_locations"), F.array().cast(_EMPTY_SPANS))
    pl = F.coalesce(F.col("context_locations"), F.array().cast(_EMPTY_SPANS))
    if pred_end == "exclusive":
        pl = _pred_spans_exclusive(pl)
    elif pred_end != "original":
        raise ValueError(pred_end)
    row = {
        "failed": F.col("failed").cast("long"),
        "t_items": F.size(F.coalesce("t_context", F.array())).cast("long"),
        "p_items": F.size(F.coalesce("context", F.array())).cast("long"),
        "strict_correct": F.size(F.array_intersect(F.coalesce("t_context", F.array().cast("array<string>")),
                                                   F.coalesce("context", F.array().cast("array<string>")))).cast("long"),
        "corrupted_items": F.size(F.coalesce("context_corrupted", F.array())).cast("long"),
        "t_chars": T.span_chars(tl),
        "p_chars": T.span_chars(pl),
        "overlap_chars": T.span_chars(T.span_overlaps(tl, pl)),
    }
    pairs = {"emotion": ("t_emotion", "emotion"), "emotion_class": ("t_emotion_class", "emotion_class"),
             "trigger_level": ("t_trigger_level", "trigger_level")}
    label_cols = [F.col(c).cast("string").alias(f"_{c}") for p in pairs.values() for c in p]
    pre = aligned.select(*RUN_KEY, *label_cols, *[v.alias(k) for k, v in row.items()]).groupBy(
        *RUN_KEY, *[f"_{c}" for p in pairs.values() for c in p]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in row])
    zero = F.lit(0).cast("long")
    e = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"_{y}").alias("y"), F.col(f"_{yh}").alias("yhat"),
                 *[(F.col(k) if i == 0 else zero).alias(k) for k in row])
        for i, (f, (y, yh)) in enumerate(pairs.items())]))
    x = pre.select(*RUN_KEY, "n", e.alias("c")).select(*RUN_KEY, "n", "c.*")
    return x.groupBy(*RUN_KEY, "field", "y", "yhat").agg(
        F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in row])


def confusion_matrix(cells: DataFrame) -> DataFrame:
    """A2: (run, field, y, yhat, n)."""
    return cells.select(*RUN_KEY, "field", "y", "yhat", "n")


QUANTS = ["failed", "t_items", "p_items", "strict_correct", "corrupted_items", "t_chars", "p_chars",
          "overlap_chars"]


def field_metrics(cells: DataFrame) -> DataFrame:
    """A1 + run sums in one linear chain: one row per (run, field) with
    support-weighted precision / recall / F1, the row count and the span sums.

    Labels are the union of true and predicted values; an undefined per-class
    precision is 0; labels with zero support weigh nothing (sklearn ``weighted``).
    Each cell feeds its true label (support, tp, row sums) and its predicted label
    (predicted) through one ``explode`` — no self-union, so the upstream join is
    consumed exactly once.
    """
    key = [*RUN_KEY, "field"]
    zero = F.lit(0).cast("long")
    both = F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp"),
                 *[F.col(q).alias(q) for q in QUANTS]),
        F.struct(F.col("yhat").alias("label"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("tp"), *[zero.alias(q) for q in QUANTS])))
    per_label = (cells.select(*key, both.alias("e")).select(*key, "e.*")
                 .groupBy(*key, "label")
                 .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                      F.sum("tp").alias("tp"), *[F.sum(q).alias(q) for q in QUANTS]))
    s = F.col("support").cast("double")
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("support") + F.col("predicted") > 0,
                2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(F.lit(0.0))
    tot = F.sum("support").cast("double")
    return per_label.groupBy(*key).agg(
        F.try_divide(F.sum(s * prec), tot).alias("precision"),
        F.try_divide(F.sum("tp").cast("double"), tot).alias("recall"),
        F.try_divide(F.sum(s * f1), tot).alias("f1_score"),
        F.sum("support").alias("support"), *[F.sum(q).alias(q) for q in QUANTS])


def weighted_prf(cells: DataFrame) -> DataFrame:
    """A1: support-weighted precision / recall / F1 per (run, field)."""
    return field_metrics(cells).select(*RUN_KEY, "field", "precision", "recall", "f1_score", "support")


def _prf(correct: Column, predicted: Column, annotated: Column) -> tuple[Column, Column, Column]:
    p = F.try_divide(correct.cast("double"), predicted.cast("double"))
    r = F.try_divide(correct.cast("double"), annotated.cast("double"))
    f = F.try_divide(2.0 * p * r, p + r)
    return p, r, f


def run_totals(cells: DataFrame) -> DataFrame:
    """Per-run sums of the row-level quantities plus the row count N."""
    m = field_metrics(cells).filter(F.col("field") == "emotion")
    return m.select(*RUN_KEY, F.col("support").alias("n_rows"), *QUANTS)


def _span_exprs(penalty: str):
    n, cor = F.col("n_rows"), F.col("corrupted_items")
    if penalty == "original":
        strict_pen, prop_pen = n * n, n * cor
    elif penalty == "per_row":
        strict_pen, prop_pen = cor, cor
    elif penalty == "none":
        strict_pen = prop_pen = F.lit(0)
    else:
        raise ValueError(penalty)
    pch, och = F.col("p_chars"), F.col("overlap_chars")
    strict = (F.col("strict_correct"), F.col("p_items") + strict_pen, F.col("t_items"))
    prop = (och, pch + prop_pen, F.col("t_chars"))
    return strict, prop


def span_metrics(cells: DataFrame, penalty: str = "original") -> DataFrame:
    """A3/A4/A5: strict and proportional span P/R/F1 per run (long form).

    ``penalty='original'`` adds N·N corrupted predictions to the strict count and
    N·Σ|corrupted_i| to the proportional count, as the original did; ``'per_row'``
    adds each row's own corrupted items once; ``'none'`` adds nothing.
    Predicted ends are counted as the original did unless the cells were built with
    ``run_cells(..., pred_end='exclusive')``.
    Zero denominators give NULL.
    """
    t = run_totals(cells)
    strict, prop = _span_exprs(penalty)

    def entry(name, trip):
        p, r, f = _prf(*trip)
        return F.struct(F.lit(name).alias("overlap"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        trip[0].alias("correct"), trip[1].alias("predicted"), trip[2].alias("annotated"))
    rows = F.explode(F.array(entry("strict", strict), entry("proportional", prop)))
    return t.select(*RUN_KEY, rows.alias("m")).select(*RUN_KEY, "m.*")


def failed_rate(cells: DataFrame) -> DataFrame:
    """V7: share of unusable rows per run."""
    t = run_totals(cells)
    return t.select(*RUN_KEY, F.col("failed").alias("n_failed"), "n_rows",
                    F.try_divide(F.col("failed").cast("double"), F.col("n_rows").cast("double")).alias("failed"))


REPORT_COLUMNS = (["failed"]
                  + [f"{f}_{m}" for f in C.LABEL_FIELDS for m in ("precision", "recall", "f1_score")]
                  + [f"context_{o}_{m}" for o in ("strict", "proportional") for m in ("precision", "recall", "f1-score")])


def evaluation_report(cells: DataFrame, penalty: str = "original") -> DataFrame:
    """One metric row per (approach, persona, seed) with the original column names.

    Linear plan: field metrics → one pivoting aggregation per run → span metrics as
    projections of the run sums.
    """
    m = field_metrics(cells)
    aggs = [F.max(F.when(F.col("field") == f, F.col(k))).alias(f"{f}_{k}")
            for f in C.LABEL_FIELDS for k in ("precision", "recall", "f1_score")]
    aggs.append(F.max(F.when(F.col("field") == "emotion", F.col("support"))).alias("n_rows"))
    aggs += [F.max(F.when(F.col("field") == "emotion", F.col(q))).alias(q) for q in QUANTS]
    wide = m.groupBy(*RUN_KEY).agg(*aggs)
    strict, prop = _span_exprs(penalty)
    sp, sr, sf = _prf(*strict)
    pp, pr, pf = _prf(*prop)
    cols = [F.try_divide(F.col("failed").cast("double"), F.col("n_rows").cast("double")).alias("failed")]
    cols += [F.col(f"{f}_{k}") for f in C.LABEL_FIELDS for k in ("precision", "recall", "f1_score")]
    cols += [sp.alias("context_strict_precision"), sr.alias("context_strict_recall"), sf.alias("context_strict_f1-score"),
             pp.alias("context_proportional_precision"), pr.alias("context_proportional_recall"),
             pf.alias("context_proportional_f1-score")]
    return wide.select(*RUN_KEY, *cols)


def report_mean_3std(report: DataFrame, group_col: str = "approach") -> DataFrame:
    """Per approach, every metric as ``round(mean,3)±round(3·sample std,2)``; label ``average``."""
    cols = [c for c in REPORT_COLUMNS if c in report.columns]
    aggs = [T.mean_pm(F.avg(F.col(f"`{c}`")), 3.0 * F.stddev_samp(F.col(f"`{c}`"))).alias(c) for c in cols]
    return report.groupBy(group_col).agg(*aggs).withColumn("persona", F.lit("average"))


def report_long(cells: DataFrame, penalty: str = "original") -> DataFrame:
    """(approach, name, metric) → mean precision / recall / F1 over personas and seeds
    (an unpivot of the run report, then one aggregation)."""
    rep = evaluation_report(cells, penalty)
    entries = [(f, "weighted avg", f"{f}_precision", f"{f}_recall", f"{f}_f1_score") for f in C.LABEL_FIELDS]
    entries += [("context", o, f"context_{o}_precision", f"context_{o}_recall", f"context_{o}_f1-score")
                for o in ("strict", "proportional")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(mt).alias("metric"),
                                        F.col(f"`{p}`").alias("precision"), F.col(f"`{r}`").alias("recall"),
                                        F.col(f"`{f1}`").alias("f1_score")) for n, mt, p, r, f1 in entries]))
    x = rep.select("approach", rows.alias("e")).select("approach", "e.*")
    return (x.groupBy("approach", "name", "metric")
            .agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                 F.avg("f1_score").alias("f1_score")))


def alignment_gaps(truth: DataFrame, pred: DataFrame, id_col: str = "id") -> DataFrame:
    """V8: per run, truth ids without a prediction, predicted ids without truth, and ids that
    occur more than once on either side. Every persona of the truth is expected in every
    (approach, seed) that predictions have; a run without any prediction has a row too.

    One left join of predictions onto the personas of each truth id; counts per (run, id) reuse
    its partitioning.
    """
    keys = truth.groupBy(id_col).agg(F.collect_list("persona").alias("_personas"))
    nt = keys.select(F.explode(F.array_distinct("_personas")).alias("persona"), "_personas")
    nt = nt.withColumn("_t", F.size(F.filter("_personas", lambda p: p == F.col("persona"))))
    nt = nt.groupBy("persona").agg(F.count("*").alias("n_truth"), (F.sum("_t") - F.count("*")).alias("duplicate_truth"))
    x = pred.select(*RUN_KEY, id_col, (~F.col("has_text")).alias("_no_text")).join(keys, id_col, "left")
    held = F.size(F.filter(F.coalesce("_personas", F.array().cast("array<string>")), lambda p: p == F.col("persona")))
    x = x.withColumn("_t", F.when(held > 0, held)).drop("_personas")
    per_id = x.groupBy(*RUN_KEY, id_col).agg(F.count("*").alias("_n"), F.max("_t").alias("_t"), F.count_if("_no_text").alias("_no_text"))
    npred = per_id.groupBy(*RUN_KEY).agg(F.sum("_n").alias("n_pred"), F.count("_t").alias("n_matched"), F.count("*").alias("_ids"),
                                         F.sum("_no_text").alias("missing_text"))
    # a row per approach, seed and persona: configuration-sized
    personas = nt.agg(F.collect_list("persona")).scalar()
    expected = pred.select("approach", "seed").distinct().select("approach", F.explode(personas).alias("persona"), "seed")
    runs = expected.unionByName(npred.select("approach", "persona", "seed")).distinct()
    y = runs.join(npred, ["approach", "persona", "seed"], "left").join(nt, "persona", "left")
    y = y.fillna(0, ["n_truth", "duplicate_truth", "n_pred", "n_matched", "_ids", "missing_text"])
    return y.select(*RUN_KEY, "n_truth", "n_pred", "n_matched",
                    (F.col("n_truth") - F.col("n_matched")).alias("missing_predictions"),
                    (F.col("_ids") - F.col("n_matched")).alias("unmatched_predictions"), "missing_text",
                    (F.col("n_pred") - F.col("_ids")).alias("duplicate_predictions"), "duplicate_truth")


def disagreements(truth: DataFrame, pred: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    """Rows where truth and prediction differ on ``column`` (null vs null counts as different)."""
    t = truth.select("persona", id_col, "text", F.col(column).alias(f"{column}_true"))
    p = pred.select(*RUN_KEY, id_col, F.col(column).alias(f"{column}_predicted"))
    x = t.join(p, ["persona", id_col])
    return x.filter(F.coalesce(F.col(f"{column}_true") != F.col(f"{column}_predicted"), F.lit(True)))


def check_alignment(gaps: DataFrame, sample: int = 20) -> None:
    """V8 gate: raise (with a bounded sample of runs) if any run has missing, unmatched or
    repeated predictions, repeated truth, or predictions without text."""
    faults = ("missing_predictions", "unmatched_predictions", "missing_text", "duplicate_predictions", "duplicate_truth")
    bad = gaps.filter(" or ".join(f"{c} <> 0" for c in faults)).limit(sample).collect()
    if bad:
        raise ValueError(f"truth and predictions are not aligned: {bad}")
