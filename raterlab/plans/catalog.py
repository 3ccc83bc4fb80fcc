"""Registered queries: name → (spark builder, oracle SQL).

Every query reads the driver tables under ``sf_dir`` (or views derived from them
by ``raterlab.plans.fixtures``) in full. Doubles are rounded to 6 places on both
sides so the engines' different summation orders do not show in the hash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlab import constants as K
from raterlab.functions import coerce as CO
from raterlab.functions import text as TX
from raterlab.functions import tokens as TK
from raterlab.operators import agreement as AG
from raterlab.operators import annotations as AN
from raterlab.operators import costs as CS
from raterlab.operators import describe as DS
from raterlab.operators import evaluation as E
from raterlab.operators import hypothesis as HY
from raterlab.operators import prompts as PR
from raterlab.operators import scoring as SC
from raterlab.operators import splits as SP
from raterlab.operators import terms as TM
from raterlab.operators import validate as V
from raterlab.plans import fixtures as X
from raterlab.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle_sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLE[name] = oracle_sql
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (presentation precision shared with the oracle)."""
    cols = [F.round(F.col(f"`{f.name}`"), places).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*cols)


# ---------------------------------------------------------------------------
# evaluation pipeline
# ---------------------------------------------------------------------------

@X.view
def validated(spark: SparkSession, d: str) -> DataFrame:
    return V.validate_predictions(X.predictions(spark, d), X.publications(spark, d))


@X.view
def aligned(spark: SparkSession, d: str) -> DataFrame:
    return E.align(X.evaluation_truth(spark, d), V.expand_baseline(validated(spark, d)))


@X.view
def cells(spark: SparkSession, d: str) -> DataFrame:
    return E.run_cells(aligned(spark, d))


RUN = "approach, persona, seed"


@register("weighted_prf_by_run", O.sql(
    f"SELECT {RUN}, field, {O.rnd('precision')}, {O.rnd('recall')}, {O.rnd('f1_score')}, support FROM wprf", "wprf"))
def weighted_prf_by_run(spark, d):
    return rounded(E.weighted_prf(cells(spark, d)))


@register("confusion_matrix", O.sql(f"SELECT {RUN}, field, y, yhat, n FROM cells", "cells"))
def confusion_matrix(spark, d):
    return E.confusion_matrix(cells(spark, d))


@register("failed_rate", O.sql(
    f"SELECT {RUN}, CAST(failed AS BIGINT) AS n_failed, n_rows, {O.rnd('CAST(failed AS DOUBLE) / n_rows', 'failed')} "
    "FROM totals", "totals"))
def failed_rate(spark, d):
    return rounded(E.failed_rate(cells(spark, d)))


def _span_sql(kind: str) -> str:
    return O.sql(f"SELECT {RUN}, overlap, {O.rnd('precision')}, {O.rnd('recall')}, {O.rnd('f1_score')}, "
                 f"correct, predicted, annotated FROM spanm WHERE overlap = '{kind}'", "spanm")


@register("strict_match", _span_sql("strict"))
def strict_match(spark, d):
    return rounded(E.span_metrics(cells(spark, d)).filter(F.col("overlap") == "strict"))


@register("proportional_match", _span_sql("proportional"))
def proportional_match(spark, d):
    return rounded(E.span_metrics(cells(spark, d)).filter(F.col("overlap") == "proportional"))


_REPORT_COLS = ", ".join(O.rnd(f'"{c}"', c) for c in E.REPORT_COLUMNS)


@register("evaluation_report", O.sql(f"SELECT {RUN}, {_REPORT_COLS} FROM report_full", "report_full"))
def evaluation_report(spark, d):
    return rounded(E.evaluation_report(cells(spark, d)))


_MEAN_PM = ", ".join(
    f"CAST(round_even(avg(\"{c}\"), 3) AS VARCHAR) || '±' || CAST(round_even(3 * stddev_samp(\"{c}\"), 2) AS VARCHAR) AS \"{c}\""
    for c in E.REPORT_COLUMNS)


@register("report_mean_3std", O.sql(
    f"SELECT approach, {_MEAN_PM}, 'average' AS persona FROM report_full GROUP BY approach", "report_full"))
def report_mean_3std(spark, d):
    return E.report_mean_3std(E.evaluation_report(cells(spark, d)))


@register("report_long", O.sql(
    "SELECT approach, name, metric, " + ", ".join(O.rnd(f"avg({m})", m) for m in ("precision", "recall", "f1_score"))
    + " FROM (SELECT approach, field AS name, 'weighted avg' AS metric, precision, recall, f1_score FROM wprf"
    " UNION ALL SELECT approach, 'context', overlap, precision, recall, f1_score FROM spanm) u GROUP BY ALL",
    "wprf", "spanm"))
def report_long(spark, d):
    return rounded(E.report_long(cells(spark, d)))


@register("alignment_gaps", O.sql(f"""
SELECT r.approach, r.persona, r.seed, COALESCE(t.n_truth, 0) AS n_truth, COALESCE(m.n_pred, 0) AS n_pred,
  COALESCE(a.n_matched, 0) AS n_matched, COALESCE(t.n_truth, 0) - COALESCE(a.n_matched, 0) AS missing_predictions,
  COALESCE(m.n_ids, 0) - COALESCE(a.n_matched, 0) AS unmatched_predictions, COALESCE(m.missing_text, 0) AS missing_text,
  COALESCE(m.n_pred - m.n_ids, 0) AS duplicate_predictions, COALESCE(t.n_rows - t.n_truth, 0) AS duplicate_truth
FROM (SELECT DISTINCT p.approach, t.persona, p.seed FROM mapped p, (SELECT DISTINCT persona FROM truth) t
      UNION SELECT DISTINCT {RUN} FROM mapped) r
LEFT JOIN (SELECT {RUN}, count(*) AS n_pred, count(DISTINCT id) AS n_ids, count(*) FILTER (WHERE text IS NULL) AS missing_text
           FROM mapped GROUP BY ALL) m USING (approach, persona, seed)
LEFT JOIN (SELECT {RUN}, count(DISTINCT id) AS n_matched FROM aligned GROUP BY ALL) a USING (approach, persona, seed)
LEFT JOIN (SELECT persona, count(DISTINCT id) AS n_truth, count(*) AS n_rows FROM truth GROUP BY ALL) t ON r.persona = t.persona""",
    "mapped", "aligned", "truth"))
def alignment_gaps(spark, d):
    truth = X.evaluation_truth(spark, d)
    mapped = V.expand_baseline(validated(spark, d))
    return E.alignment_gaps(truth, mapped)


@register("coerce_category", O.sql(
    f"SELECT {RUN}, id, emotion, emotion_class, failed FROM validf", "validf"))
def coerce_category(spark, d):
    return validated(spark, d).select("approach", "persona", "seed", "id", "emotion", "emotion_class", "failed")


@register("lenient_int", O.sql(f"SELECT {RUN}, id, trigger_level FROM validf", "validf"))
def lenient_int(spark, d):
    return validated(spark, d).select("approach", "persona", "seed", "id", "trigger_level")


@register("locate_context", O.sql(
    f"SELECT {RUN}, id, CAST(to_json(context) AS VARCHAR) AS context, "
    "CAST(to_json(context_locations) AS VARCHAR) AS context_locations, "
    "CAST(len(context_corrupted) AS INT) AS n_corrupted, description FROM validf", "validf"))
def locate_context(spark, d):
    v = validated(spark, d)
    return v.select("approach", "persona", "seed", "id", F.to_json("context").alias("context"),
                    F.to_json("context_locations").alias("context_locations"),
                    F.size("context_corrupted").alias("n_corrupted"), "description")


@register("disagreements", O.sql("""
SELECT p.approach, t.persona, p.seed, t.id, t.emotion AS emotion_true, p.emotion AS emotion_predicted
FROM truth t JOIN mapped p ON t.persona = p.persona AND t.id = p.id
WHERE COALESCE(t.emotion <> p.emotion, TRUE)""", "truth", "mapped"))
def disagreements(spark, d):
    truth = X.evaluation_truth(spark, d)
    mapped = V.expand_baseline(validated(spark, d))
    return E.disagreements(truth, mapped, "emotion").select(
        "approach", "persona", "seed", "id", "emotion_true", "emotion_predicted")


FLAGSHIP = "weighted_prf_by_run"


# ---------------------------------------------------------------------------
# agreement notebook (E4): pairing, contingency, κ, χ², normality, Mann–Whitney
# ---------------------------------------------------------------------------

RATER_A = hashlib.md5(b"rater_a").hexdigest()[:8]
RATER_B = hashlib.md5(b"rater_b").hexdigest()[:8]
PAIR_FIELDS = ["emotion", "emotion_class", "trigger_level"]

O.cte("pairs", ["ann"], """
SELECT a.id, a.text, a.emotion AS a_emotion, b.emotion AS b_emotion, a.emotion_class AS a_emotion_class,
       b.emotion_class AS b_emotion_class, a.trigger_level AS a_trigger_level, b.trigger_level AS b_trigger_level,
       a.context_locations AS a_locs, b.context_locations AS b_locs
FROM ann a JOIN ann b ON a.id = b.id AND a.rater = 'a' AND b.rater = 'b'""")
O.cte("ct", ["pairs"], """
SELECT 'emotion' AS field, a_emotion AS a, b_emotion AS b, count(*) AS n FROM pairs GROUP BY ALL
UNION ALL SELECT 'emotion_class', a_emotion_class, b_emotion_class, count(*) FROM pairs GROUP BY ALL
UNION ALL SELECT 'trigger_level', CAST(a_trigger_level AS VARCHAR), CAST(b_trigger_level AS VARCHAR), count(*) FROM pairs GROUP BY ALL
UNION ALL SELECT 'quality_toxic', CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY ALL""")
O.cte("marg", ["ct"], """
SELECT field, label, sum(r) AS r, sum(c) AS c, sum(d) AS d
FROM (SELECT field, a AS label, n AS r, 0 AS c, CASE WHEN a = b THEN n ELSE 0 END AS d FROM ct
      UNION ALL SELECT field, b, 0, n, 0 FROM ct) u GROUP BY ALL""")


def _pairs(spark, d):
    ann = X.annotations(spark, d)
    return AG.pair_raters(ann, RATER_A, RATER_B, PAIR_FIELDS + ["context_locations", "text"]) \
        .withColumnRenamed("a_text", "text").drop("b_text")


def _crosstab(spark, d):
    ct = AG.crosstab_long(_pairs(spark, d), PAIR_FIELDS)
    lp = X.label_pairs(spark, d).select(F.col("quality").alias("a_quality_toxic"), F.col("toxic").alias("b_quality_toxic"))
    return ct.unionByName(AG.crosstab_long(lp, ["quality_toxic"]))


@register("rater_pairs", O.sql(
    "SELECT id, a_emotion, b_emotion, a_emotion_class, b_emotion_class, a_trigger_level, b_trigger_level FROM pairs", "pairs"))
def rater_pairs(spark, d):
    return _pairs(spark, d).select("id", *[f"{s}_{f}" for f in PAIR_FIELDS for s in ("a", "b")])


@register("crosstab_labels", O.sql("SELECT field, a, b, n FROM ct", "ct"))
def crosstab_labels(spark, d):
    return _crosstab(spark, d)


@register("cohen_kappa", O.sql("""
SELECT field, n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa
FROM (SELECT field, CAST(sum(r) AS BIGINT) AS n, CAST(sum(d) AS DOUBLE) / sum(r) AS po,
             CAST(sum(r * c) AS DOUBLE) / (CAST(sum(r) AS DOUBLE) * sum(r)) AS pe FROM marg GROUP BY field) k""", "marg"))
def cohen_kappa(spark, d):
    return rounded(AG.cohen_kappa(_crosstab(spark, d)))


_THREE = [("three", """
SELECT rater, id, emotion, CAST(trigger_level AS VARCHAR) AS trigger_level FROM ann
UNION ALL SELECT 'c', id, emotion, CAST(trigger_level AS VARCHAR) FROM ann
WHERE rater = CASE WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AND id % 7 <> 0"""),
    ("tp", """
SELECT x.rater AS rater_a, y.rater AS rater_b, f.field, CASE f.field WHEN 'emotion' THEN x.emotion ELSE x.trigger_level END AS a,
  CASE f.field WHEN 'emotion' THEN y.emotion ELSE y.trigger_level END AS b
FROM three x JOIN three y ON x.id = y.id AND x.rater < y.rater CROSS JOIN (VALUES ('emotion'), ('trigger_level')) f(field)"""),
    ("tm", """
SELECT rater_a, rater_b, field, sum(r) AS r, sum(c) AS c FROM (
  SELECT rater_a, rater_b, field, a AS label, count(*) AS r, 0 AS c FROM tp GROUP BY ALL
  UNION ALL SELECT rater_a, rater_b, field, b, 0, count(*) FROM tp GROUP BY ALL) u GROUP BY rater_a, rater_b, field, label""")]


@register("kappa_rater_pairs", O.sql("""
SELECT rater_a, rater_b, field, n, round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa
FROM (SELECT rater_a, rater_b, field, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM tp GROUP BY ALL) p
JOIN (SELECT rater_a, rater_b, field, CAST(sum(r * c) AS DOUBLE) / (CAST(sum(r) AS DOUBLE) * sum(r)) AS pe FROM tm GROUP BY ALL) m
USING (rater_a, rater_b, field)""", "ann", extra=_THREE))
def kappa_rater_pairs(spark, d):
    """J7 and A19 for every pair of three raters; the third agrees with one of the others and leaves items out."""
    fields = ["emotion", "trigger_level"]
    ann = X.annotations(spark, d).select("rater", "id", "emotion", F.col("trigger_level").cast("string").alias("trigger_level"))
    third = ann.filter((F.col("rater") == F.when(F.col("id") % 3 == 0, "b").otherwise("a")) & (F.col("id") % 7 != 0))
    pairs = AG.pair_all_raters(ann.unionByName(third.withColumn("rater", F.lit("c"))), fields, rater_col="rater")
    by = ["rater_a", "rater_b"]
    return rounded(AG.cohen_kappa(AG.crosstab_long(pairs, fields, by), by))


_CHI2 = [("chi", """
SELECT field, CAST(n AS BIGINT) AS n, CAST(dof AS BIGINT) AS dof, chi2 FROM (
  SELECT g.field, g.n, g.dof,
    CASE WHEN g.dof = 0 THEN 0.0 ELSE sum(power(abs(COALESCE(ct.n, 0) - g.e)
         - CASE WHEN g.dof = 1 THEN least(0.5, abs(COALESCE(ct.n, 0) - g.e)) ELSE 0 END, 2) / g.e) END AS chi2
  FROM (SELECT rm.field, rm.label AS a, cm.label AS b, CAST(rm.r AS DOUBLE) * cm.c / t.n AS e, t.n,
               (t.nr - 1) * (t.nc - 1) AS dof
        FROM marg rm JOIN marg cm ON rm.field = cm.field AND rm.r > 0 AND cm.c > 0
        JOIN (SELECT field, sum(r) AS n, count(*) FILTER (WHERE r > 0) AS nr, count(*) FILTER (WHERE c > 0) AS nc
              FROM marg GROUP BY field) t ON t.field = rm.field) g
  LEFT JOIN ct ON ct.field = g.field AND ct.a = g.a AND ct.b = g.b
  GROUP BY g.field, g.n, g.dof) x""")]


@register("chi2_independence", O.sql("SELECT field, n, dof, round(chi2, 6) AS chi2 FROM chi", "marg", "ct", extra=_CHI2))
def chi2_independence(spark, d):
    return rounded(AG.chi2_statistic(_crosstab(spark, d)))


def _normal_samples(spark, d):
    ev = X.read(spark, d, "events").select(F.lit("events").alias("sample"), F.col("event_type").alias("grp"),
                                           F.col("value").cast("double").alias("x"))
    lv = X.annotations(spark, d).select(F.lit("levels").alias("sample"), F.col("rater").alias("grp"),
                                        F.col("trigger_level").cast("double").alias("x"))
    return ev.unionByName(lv)


def _k2_sql() -> str:
    n = "CAST(n AS DOUBLE)"
    y = f"(skew * sqrt(({n} + 1) * ({n} + 3) / (6.0 * ({n} - 2))))"
    beta2 = f"(3.0 * ({n}*{n} + 27*{n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w2 = f"(-1.0 + sqrt(2.0 * ({beta2} - 1)))"
    delta = f"(1.0 / sqrt(0.5 * ln({w2})))"
    alpha = f"sqrt(2.0 / ({w2} - 1))"
    zs = f"({delta} * asinh({y} / {alpha}))"
    e = f"(3.0 * ({n} - 1) / ({n} + 1))"
    var = f"(24.0 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5)))"
    xk = f"((kurt + 3.0 - {e}) / sqrt({var}))"
    sb1 = f"(6.0 * ({n}*{n} - 5*{n} + 2) / (({n} + 7) * ({n} + 9)) * sqrt(6.0 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))))"
    a = f"(6.0 + 8.0 / {sb1} * (2.0 / {sb1} + sqrt(1 + 4.0 / ({sb1} * {sb1}))))"
    den = f"(1 + {xk} * sqrt(2.0 / ({a} - 4)))"
    zk = f"(((1 - 2.0 / (9 * {a})) - sign({den}) * cbrt((1 - 2.0 / {a}) / abs({den}))) / sqrt(2.0 / (9 * {a})))"
    extra = [
        ("s", "SELECT 'events' AS sample, event_type AS grp, CAST(value AS DOUBLE) AS x FROM events "
              "UNION ALL SELECT 'levels', rater, CAST(trigger_level AS DOUBLE) FROM ann"),
        ("m", "SELECT sample, grp, avg(x) AS mu FROM s GROUP BY ALL"),
        ("c", "SELECT s.sample, s.grp, count(*) AS n, avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3, "
              "avg(power(x - mu, 4)) AS m4 FROM s JOIN m USING (sample, grp) GROUP BY ALL"),
        ("g", "SELECT sample, grp, n, m3 / power(m2, 1.5) AS skew, m4 / (m2 * m2) - 3.0 AS kurt FROM c"),
        ("z", f"SELECT sample, grp, n, skew, kurt, {zs} AS z_skew, {zk} AS z_kurt FROM g"),
    ]
    body = """
SELECT sample, grp, n, round(skew, 6) AS skew, round(kurt, 6) AS kurt,
       CASE WHEN n >= 8 THEN round(z_skew, 6) END AS z_skew, CASE WHEN n >= 8 THEN round(z_kurt, 6) END AS z_kurt,
       CASE WHEN n >= 8 THEN round(z_skew * z_skew + z_kurt * z_kurt, 6) END AS k2,
       CASE WHEN n >= 8 THEN round(exp(-(z_skew * z_skew + z_kurt * z_kurt) / 2), 6) END AS p_value FROM z"""
    return O.sql(body, "ann", extra=extra)


ORACLE_K2 = _k2_sql()


@register("normality_k2", ORACLE_K2)
def normality_k2(spark, d):
    return rounded(HY.normality_k2(_normal_samples(spark, d), ["sample", "grp"], "x"))


def _mw_samples(spark, d):
    li = X.read(spark, d, "lineitem").select(
        F.lit("quantity_R_vs_rest").alias("test"), F.when(F.col("l_returnflag") == "R", "a").otherwise("b").alias("side"),
        F.col("l_quantity").cast("double").alias("x"))
    ev = X.read(spark, d, "events").select(
        F.lit("value_purchase_vs_rest").alias("test"),
        F.when(F.col("event_type") == "purchase", "a").otherwise("b").alias("side"), F.col("value").cast("double").alias("x"))
    lv = X.annotations(spark, d).select(F.lit("level_rater_a_vs_b").alias("test"), F.col("rater").alias("side"),
                                        F.col("trigger_level").cast("double").alias("x"))
    return li.unionByName(ev).unionByName(lv)


_MW = [
    ("s", "SELECT 'quantity_R_vs_rest' AS test, CASE WHEN l_returnflag = 'R' THEN 'a' ELSE 'b' END AS side, "
          "CAST(l_quantity AS DOUBLE) AS x FROM lineitem "
          "UNION ALL SELECT 'value_purchase_vs_rest', CASE WHEN event_type = 'purchase' THEN 'a' ELSE 'b' END, "
          "CAST(value AS DOUBLE) FROM events "
          "UNION ALL SELECT 'level_rater_a_vs_b', rater, CAST(trigger_level AS DOUBLE) FROM ann"),
    ("h", "SELECT test, x, count(*) FILTER (WHERE side = 'a') AS na, count(*) FILTER (WHERE side = 'b') AS nb "
          "FROM s GROUP BY ALL"),
    ("hc", "SELECT *, COALESCE(sum(nb) OVER (PARTITION BY test ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING "
           "AND 1 PRECEDING), 0) AS before_nb FROM h"),
    ("agg", "SELECT test, CAST(sum(na) AS BIGINT) AS n1, CAST(sum(nb) AS BIGINT) AS n2, "
            "sum(na * (before_nb + nb / 2.0)) AS u1, sum(power(CAST(na + nb AS DOUBLE), 3) - (na + nb)) AS tie_term "
            "FROM hc GROUP BY test"),
    ("u", "SELECT *, greatest(u1, CAST(n1 AS DOUBLE) * n2 - u1) AS u, CAST(n1 + n2 AS DOUBLE) AS n FROM agg"),
    ("zs", "SELECT test, n1, n2, u1, u, tie_term, (u - CAST(n1 AS DOUBLE) * n2 / 2.0 - 0.5) / "
           "sqrt(CAST(n1 AS DOUBLE) * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))) AS z FROM u"),
]
_MW_COLUMNS = ("test, n1, n2, round(u1, 6) AS u1, round(u, 6) AS u, round(tie_term, 6) AS tie_term, "
               "round(z, 6) AS z")


def _erfc_sql(x: str) -> str:
    """erfc by Simpson's rule over [x, x + 10] in 4,000 steps."""
    return (f"(2 / sqrt(pi()) * 0.0025 / 3 * list_sum(list_transform(range(0, 4001), lambda i: "
            f"(CASE WHEN i % 4000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power({x} + i * 0.0025, 2)))))")


@register("mann_whitney", O.sql(f"SELECT {_MW_COLUMNS} FROM zs", "ann", extra=_MW))
def mann_whitney(spark, d):
    return rounded(HY.mann_whitney(_mw_samples(spark, d), "test", "side", "x"))


def _persona_of(col):
    return CO.map_values(col, {RATER_A: "persona_1", RATER_B: "persona_2"})


O.cte("annp", ["ann"], f"""
SELECT *, CASE created_by WHEN '{RATER_A}' THEN 'persona_1' WHEN '{RATER_B}' THEN 'persona_2' END AS persona FROM ann""")


@register("value_counts", O.sql("SELECT emotion_class, emotion, count(*) AS n FROM ann GROUP BY ALL", "ann"))
def value_counts(spark, d):
    return DS.value_counts(X.annotations(spark, d), ["emotion_class", "emotion"])


@register("strong_triggers_per_persona", O.sql(
    "SELECT persona, count(*) AS n FROM annp WHERE emotion_class = 'negative' AND trigger_level IN (4, 5) GROUP BY ALL",
    "annp"))
def strong_triggers_per_persona(spark, d):
    a = X.annotations(spark, d).withColumn("persona", _persona_of(F.col("created_by")))
    a = a.filter((F.col("emotion_class") == "negative") & F.col("trigger_level").isin(4, 5))
    return DS.value_counts(a, ["persona"])


SHARE_ORDER = ["anger", "sadness", "fear", "surprise", "love", "joy", "undefined"]


@register("category_share", O.sql(
    "SELECT persona, emotion, CAST(list_position(" + O.EMO_LIST.replace(O.EMO_LIST, "[" + ", ".join(f"'{e}'" for e in SHARE_ORDER) + "]")
    + ", emotion) AS INT) AS ord, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM annp), 6) AS percent "
    "FROM annp WHERE emotion IN (" + ", ".join(f"'{e}'" for e in SHARE_ORDER) + ") GROUP BY ALL", "annp"))
def category_share(spark, d):
    a = X.annotations(spark, d).withColumn("persona", _persona_of(F.col("created_by")))
    return rounded(DS.category_share(a, "persona", "emotion", SHARE_ORDER))


@register("box_stats", O.sql("""
SELECT q.emotion_class, q.created_by, q.q1, q.median, q.q3, q.iqr,
  min(CASE WHEN x BETWEEN q.q1 - 1.5 * q.iqr AND q.q3 + 1.5 * q.iqr THEN x END) AS whisker_low,
  max(CASE WHEN x BETWEEN q.q1 - 1.5 * q.iqr AND q.q3 + 1.5 * q.iqr THEN x END) AS whisker_high,
  count(*) FILTER (WHERE NOT (x BETWEEN q.q1 - 1.5 * q.iqr AND q.q3 + 1.5 * q.iqr)) AS n_outliers, count(*) AS n
FROM (SELECT emotion_class, created_by, CAST(trigger_level AS DOUBLE) AS x FROM ann) v
JOIN (SELECT emotion_class, created_by, quantile_cont(CAST(trigger_level AS DOUBLE), 0.25) AS q1,
             quantile_cont(CAST(trigger_level AS DOUBLE), 0.5) AS median, quantile_cont(CAST(trigger_level AS DOUBLE), 0.75) AS q3,
             quantile_cont(CAST(trigger_level AS DOUBLE), 0.75) - quantile_cont(CAST(trigger_level AS DOUBLE), 0.25) AS iqr
      FROM ann GROUP BY ALL) q USING (emotion_class, created_by)
GROUP BY ALL""", "ann"))
def box_stats(spark, d):
    return rounded(DS.box_stats(X.annotations(spark, d), ["emotion_class", "created_by"], "trigger_level"))


@register("describe_levels", O.sql("""
SELECT created_by, count(trigger_level) AS count, round(avg(trigger_level), 6) AS mean,
  round(stddev_samp(trigger_level), 6) AS std, CAST(min(trigger_level) AS DOUBLE) AS min,
  round(quantile_cont(CAST(trigger_level AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST(trigger_level AS DOUBLE), 0.5), 6) AS p50,
  round(quantile_cont(CAST(trigger_level AS DOUBLE), 0.75), 6) AS p75, CAST(max(trigger_level) AS DOUBLE) AS max
FROM ann GROUP BY ALL""", "ann"))
def describe_levels(spark, d):
    return rounded(DS.describe(X.annotations(spark, d), ["created_by"], "trigger_level"))


@register("describe_quantity", O.sql("""
SELECT l_returnflag, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean,
  round(stddev_samp(l_quantity), 6) AS std, round(min(l_quantity), 6) AS min,
  round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS p50,
  round(quantile_cont(l_quantity, 0.75), 6) AS p75, round(max(l_quantity), 6) AS max
FROM lineitem GROUP BY ALL"""))
def describe_quantity(spark, d):
    return rounded(DS.describe(X.read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"))


@register("describe_price", O.sql("""
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean,
  round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(max(l_extendedprice), 6) AS max
FROM (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem) t GROUP BY ALL"""))
def describe_price(spark, d):
    """A14 on a column whose values hardly repeat."""
    return rounded(DS.describe(X.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@register("annotations_per_rater", O.sql(
    "SELECT created_by, count(*) AS n, count(description) AS n_description FROM ann GROUP BY ALL", "ann"))
def annotations_per_rater(spark, d):
    return DS.rows_per(X.annotations(spark, d), ["created_by"], "description")


@register("mean_span_length", O.sql("""
SELECT created_by, round(avg(s['end'] - s['start']), 6) AS mean_span_len, count(*) AS n_spans
FROM (SELECT created_by, unnest(context_locations) AS s FROM ann) u GROUP BY ALL""", "ann"))
def mean_span_length(spark, d):
    return rounded(AG.mean_span_length(X.annotations(spark, d)))


O.cte("ov", ["pairs"], """
SELECT id, text, a_locs, b_locs,
  flatten(list_transform(a_locs, lambda x: list_transform(
     list_filter(b_locs, lambda y: greatest(x['start'], y['start']) <= least(x['end'], y['end'])),
     lambda y: {'start': greatest(x['start'], y['start']), 'end': least(x['end'], y['end'])}))) AS ovl
FROM pairs""")


@register("span_overlap_pairs", O.sql(
    "SELECT id, o['start'] AS start, o['end'] AS \"end\" FROM (SELECT id, unnest(ovl) AS o FROM ov) u", "ov"))
def span_overlap_pairs(spark, d):
    ov = AG.span_pairs_overlap(_pairs(spark, d))
    return ov.select("id", F.explode("overlaps").alias("o")).select("id", "o.start", "o.end")


@register("span_overlap_long", O.sql(
    "SELECT id, CAST(o['start'] AS BIGINT) AS start, CAST(o['end'] AS BIGINT) AS \"end\" FROM (SELECT id, unnest(ovl) AS o FROM ov) u", "ov"))
def span_overlap_long(spark, d):
    """J12 on spans as rows."""
    a, b = (_pairs(spark, d).select("id", F.explode(f"{side}_context_locations").alias("s")).select("id", "s.start", "s.end") for side in "ab")
    return AG.overlap_sweep(a, b)


@register("span_overlap_summary", O.sql(f"""
SELECT *, round(CAST(ann1_labels_len AS DOUBLE) / nullif(ann1_labels_total, 0), 6) AS ann1_mean_len,
  round(CAST(ann2_labels_len AS DOUBLE) / nullif(ann2_labels_total, 0), 6) AS ann2_mean_len,
  round(CAST(overlap_labels_len AS DOUBLE) / nullif(ann1_labels_len + ann2_labels_len - overlap_labels_len, 0), 6) AS overlap_jaccard
FROM (SELECT CAST(sum({O.span_chars('a_locs')}) AS BIGINT) AS ann1_labels_len, CAST(sum(len(a_locs)) AS BIGINT) AS ann1_labels_total,
             CAST(sum({O.span_chars('b_locs')}) AS BIGINT) AS ann2_labels_len, CAST(sum(len(b_locs)) AS BIGINT) AS ann2_labels_total,
             CAST(sum({O.span_chars('ovl')}) AS BIGINT) AS overlap_labels_len, CAST(sum(len(ovl)) AS BIGINT) AS overlap_labels_total
      FROM ov) t""", "ov"))
def span_overlap_summary(spark, d):
    return rounded(AG.overlap_summary(AG.span_pairs_overlap(_pairs(spark, d))))


@register("overlap_text", O.sql("""
SELECT id, array_to_string(list_transform(ovl, lambda s: substring(text, s['start'] + 1, s['end'] - s['start'] + 1)), ' ') AS overlap_text,
  CAST(len(ovl) AS INT) AS n_overlaps FROM ov""", "ov"))
def overlap_text(spark, d):
    return AG.overlap_text(AG.span_pairs_overlap(_pairs(spark, d)))


# ---------------------------------------------------------------------------
# preparation (E3): export flattening, splits, descriptions, parsing
# ---------------------------------------------------------------------------

O.cte("flat", ["ann"], f"""
SELECT created_by, CAST(id AS VARCHAR) AS id, CASE WHEN rater = 'b' AND length(text) < {X.SHORT_TEXT} THEN NULL ELSE emotion END AS emotion,
  emotion_class, CAST(trigger_level AS VARCHAR) AS trigger_level, context, context_locations, description, created_at, rater
FROM ann""")


def _flat(spark, d):
    return AN.flatten_export(X.export(spark, d), X.PROJECT)


@register("flatten_annotations", O.sql("""
SELECT created_by, id, emotion, emotion_class, trigger_level, CAST(trigger_level AS INT) AS trigger_level_int,
  description, created_at, CAST(to_json(context) AS VARCHAR) AS context,
  CAST(to_json(context_locations) AS VARCHAR) AS context_locations
FROM flat WHERE emotion IS NOT NULL""", "flat"))
def flatten_annotations(spark, d):
    kept, _ = AN.split_quarantine(_flat(spark, d))
    return kept.select("created_by", "id", "emotion", "emotion_class", "trigger_level",
                       CO.strict_int(F.col("trigger_level")).alias("trigger_level_int"), "description", "created_at",
                       F.to_json("context").alias("context"), F.to_json("context_locations").alias("context_locations"))


@register("quarantined_labels", O.sql("SELECT created_by, id FROM flat WHERE emotion IS NULL", "flat"))
def quarantined_labels(spark, d):
    _, bad = AN.split_quarantine(_flat(spark, d))
    return bad.select("created_by", "id")


@register("annotator_pseudonym", O.sql(
    "SELECT md5(CAST(user_id AS VARCHAR))[1:8] AS pseudonym, count(*) AS n FROM events GROUP BY ALL"))
def annotator_pseudonym(spark, d):
    ev = X.read(spark, d, "events")
    return ev.groupBy(TX.pseudonym(F.col("user_id")).alias("pseudonym")).agg(F.count(F.lit(1)).alias("n"))


@register("date_split", O.sql("SELECT id, split_name FROM split", "split"))
def date_split(spark, d):
    return SP.date_split(X.publications(spark, d))


@register("split_attach", O.sql("SELECT p.id, p.date, s.split_name FROM pubs p LEFT JOIN split s ON p.id = s.id",
                                "pubs", "split"))
def split_attach(spark, d):
    pubs = X.publications(spark, d)
    return SP.attach_split(pubs.select("id", "date"), SP.date_split(pubs))


@register("split_semi", O.sql(
    "SELECT id, date FROM pubs WHERE id IN (SELECT id FROM split WHERE split_name = 'evaluation')", "pubs", "split"))
def split_semi(spark, d):
    pubs = X.publications(spark, d)
    return SP.in_split(pubs.select("id", "date"), SP.date_split(pubs), "evaluation")


@register("split_sizes", O.sql("SELECT split_name, count(*) AS n FROM split GROUP BY ALL", "split"))
def split_sizes(spark, d):
    return SP.split_sizes(SP.date_split(X.publications(spark, d)))


@register("split_missing", O.sql("""
SELECT f.created_by, s.split_name, f.id FROM flat f JOIN split s ON CAST(s.id AS VARCHAR) = f.id
WHERE f.emotion IS NULL""", "flat", "split"))
def split_missing(spark, d):
    kept, _ = AN.split_quarantine(_flat(spark, d))
    splits = SP.date_split(X.publications(spark, d)).select(F.col("id").cast("string").alias("id"), "split_name")
    return SP.missing_annotations(splits, kept, kept)


@register("description_override", O.sql("""
SELECT a.id, COALESCE(dsc.description, a.description) AS description
FROM ann a LEFT JOIN (SELECT conv_id AS id, arg_min(text, turn) AS description FROM conversations
                      WHERE role <> 'system' AND text IS NOT NULL GROUP BY conv_id) dsc ON a.id = dsc.id
WHERE a.rater = 'a'""", "ann"))
def description_override(spark, d):
    a = X.annotations(spark, d).filter(F.col("rater") == "a").select("id", "description")
    return AN.override_descriptions(a, X.descriptions(spark, d))


@register("python_list_parse", O.sql(f"""
SELECT created_by, id, lit, CAST(to_json({O.py_list_parse('lit')}) AS VARCHAR) AS parsed,
  CAST(to_json(list_transform(json_transform(translate(spans, '()', '[]'), '[["INTEGER"]]'),
          lambda p: {{'start': p[1], 'end': p[2]}})) AS VARCHAR) AS parsed_spans
FROM (SELECT created_by, id,
        '[' || array_to_string(list_transform(context, lambda q: {O._py_str('q')}), ', ') || ']' AS lit,
        '[' || array_to_string(list_transform(context_locations, lambda s: '(' || s['start'] || ', ' || s['end'] || ')'), ', ') || ']' AS spans
      FROM ann) t""", "ann"))
def python_list_parse(spark, d):
    a = X.annotations(spark, d).select("created_by", "id", TX.python_literal_list(F.col("context")).alias("lit"),
                                       TX.spans_to_text(F.col("context_locations")).alias("spans"))
    return a.select("created_by", "id", "lit", F.to_json(TX.parse_python_list(F.col("lit"))).alias("parsed"),
                    F.to_json(TX.parse_python_spans(F.col("spans"))).alias("parsed_spans"))


@register("flatten_output_json", O.sql("""
SELECT event_id, TRY_CAST(json_extract_string(j, '$.k') AS INT) AS k, json_extract_string(j, '$.response') AS response
FROM (SELECT event_id, CASE WHEN json_valid(props) THEN props ELSE '{"response": "failed to generate"}' END AS j FROM events) e"""))
def flatten_output_json(spark, d):
    v = CO.parse_or_failed(F.col("props"))
    ev = X.read(spark, d, "events").select("event_id", v.alias("v"))
    return ev.select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"),
                     F.try_variant_get("v", "$.response", "string").alias("response"))


# ---------------------------------------------------------------------------
# prompts, examples, token costs, terms
# ---------------------------------------------------------------------------

SYS_TPL = O._q(K.EVALUATE_TEMPLATE[0][1])
USR_TPL = O._q(K.EVALUATE_TEMPLATE[1][1])

O.cte("personas_all", ["personas"], f"""
SELECT * FROM personas UNION ALL SELECT '{K.BASELINE_PERSONA}', NULL, {O._q(X.ASSISTANT_NARRATIVE)}""")
O.cte("evalpubs", ["pubs", "split"], "SELECT * FROM pubs WHERE id IN (SELECT id FROM split WHERE split_name = 'evaluation')")


def _label_json_sql(ctx: str) -> str:
    def s(c):
        return f"CASE WHEN {c} IS NULL THEN 'null' ELSE {O._json_str(c)} END"
    return ("('{\"emotion\": ' || " + s("emotion") + " || ', \"emotion_class\": ' || " + s("emotion_class")
            + " || ', \"trigger_level\": ' || CAST(trigger_level AS VARCHAR) || ', \"context\": ' || " + ctx
            + " || ', \"description\": ' || " + s("description") + " || '}')")


O.cte("fs", ["ann", "personas", "split"], f"""
SELECT p.persona, a.created_at AS date, a.id, replace({USR_TPL}, '{K.PUBLICATION_TOKEN}', a.text) AS input,
  {_label_json_sql(O._json_arr('a.context').replace('a.context', 'context'))} AS output
FROM (SELECT * FROM ann WHERE id IN (SELECT id FROM split WHERE split_name = 'ft_training')) a
JOIN personas p ON a.created_by = p.annotator""")


def _zs_messages_sql(narr: str, text: str) -> str:
    return (f"[{{'role': 'system', 'content': replace({SYS_TPL}, '{K.CONTEXT_TOKEN}', {narr})}}, "
            f"{{'role': 'user', 'content': replace({USR_TPL}, '{K.PUBLICATION_TOKEN}', {text})}}]")


def _eval_pubs(spark, d):
    pubs = X.publications(spark, d)
    return SP.in_date_split(pubs, pubs, "evaluation")


@register("zero_shot_prompts", O.sql(f"""
SELECT p.persona, u.id, md5(CAST(to_json({_zs_messages_sql('p.narrative', 'u.text')}) AS VARCHAR)) AS messages_md5,
  CAST(length(u.text) AS INT) AS n_chars
FROM evalpubs u CROSS JOIN personas_all p""", "evalpubs", "personas_all"))
def zero_shot_prompts(spark, d):
    g = PR.persona_grid(_eval_pubs(spark, d), X.personas_with_assistant(spark))
    m = PR.zero_shot_messages(F.col("narrative"), F.col("text"))
    return g.select("persona", "id", F.md5(F.to_json(m)).alias("messages_md5"), F.length("text").alias("n_chars"))


_SHOTS = (f"SELECT persona, flatten(list([{{'role': 'user', 'content': input}}, "
          f"{{'role': 'assistant', 'content': output}}] ORDER BY date, id)) AS shots "
          f"FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY date, id) AS rn FROM fs) r "
          f"WHERE rn <= {K.FEW_SHOT_EXAMPLES} GROUP BY persona")


@register("few_shot_prompts", O.sql(f"""
SELECT p.persona, u.id, CAST(len(s.shots) + 2 AS INT) AS n_messages,
  md5(CAST(to_json(list_concat([{{'role': 'system', 'content': replace({SYS_TPL}, '{K.CONTEXT_TOKEN}', p.narrative)}}], s.shots,
      [{{'role': 'user', 'content': replace({USR_TPL}, '{K.PUBLICATION_TOKEN}', u.text)}}])) AS VARCHAR)) AS messages_md5
FROM evalpubs u CROSS JOIN personas p JOIN shots s ON s.persona = p.persona""", "evalpubs", "personas", "fs",
    extra=[("shots", _SHOTS)]))
def few_shot_prompts(spark, d):
    table = PR.few_shot_table(X.personas(spark), X.few_shot_examples(spark, d))
    g = PR.persona_grid(_eval_pubs(spark, d), table, persona_cols=("persona", "narrative", "shots"))
    m = PR.few_shot_messages(F.col("narrative"), F.col("shots"), F.col("text"))
    return g.select("persona", "id", F.size(m).alias("n_messages"), F.md5(F.to_json(m)).alias("messages_md5"))


_FT_ANSWER = _label_json_sql(O._json_str(
    "('[' || array_to_string(list_transform(context, lambda q: " + O._py_str('q') + "), ', ') || ']')"))


@register("finetune_examples", O.sql(f"""
SELECT persona, split_name, id, answer,
  md5(CAST(to_json([{{'role': 'system', 'content': replace({SYS_TPL}, '{K.CONTEXT_TOKEN}', narrative)}},
                    {{'role': 'user', 'content': replace({USR_TPL}, '{K.FENCED_PUBLICATION_TOKEN}', text)}},
                    {{'role': 'assistant', 'content': answer}}]) AS VARCHAR)) AS messages_md5
FROM (SELECT p.persona, p.narrative, s.split_name, a.id, a.text, {_FT_ANSWER} AS answer
      FROM ann a JOIN personas p ON a.created_by = p.annotator JOIN split s ON s.id = a.id
      WHERE s.split_name IN ('ft_training', 'ft_validation')) t""", "ann", "personas", "split"))
def finetune_examples(spark, d):
    pubs = X.publications(spark, d)
    ex = PR.finetune_examples(X.annotations(spark, d), X.personas(spark), SP.date_split(pubs),
                              context_as="text", on_missing_description="keep")
    return ex.select("persona", "split_name", "id", F.col("messages")[2]["content"].alias("answer"),
                     F.md5(F.to_json("messages")).alias("messages_md5"))


@register("persona_prompts", O.sql(f"""
SELECT source, CAST(to_json([{{'role': 'system', 'content': {O._q(K.PERSONA_TEMPLATE[0][1])}}},
  {{'role': 'user', 'content': replace({O._q(K.PERSONA_TEMPLATE[1][1])}, '{K.CLUSTER_TOKEN}', descr)}}]) AS VARCHAR) AS messages
FROM (SELECT source, 'source ' || source || ': ' || CAST(count(*) AS VARCHAR) || ' documents in '
             || array_to_string(list_sort(list_distinct(list(lang))), ', ') || ', ' || CAST(sum(n_chars) AS VARCHAR) || ' characters' AS descr
      FROM documents GROUP BY source) c"""))
def persona_prompts(spark, d):
    p = PR.persona_prompts(X.source_clusters(spark, d))
    return p.select("source", F.to_json("messages").alias("messages"))


def _stats(spark, d):
    return CS.example_stats(X.read(spark, d, "conversations"))


_TOK = TK.TOKEN_PATTERN


def _tok_sql(x: str) -> str:
    return f"COALESCE(len(regexp_extract_all({x}, {O._q(_TOK)})), 0)"


O.cte("exstats", [], f"""
SELECT conv_id, count(*) AS n_messages, max(CAST(role = 'system' AS INT)) AS has_system, max(CAST(role = 'user' AS INT)) AS has_user,
  CAST(sum({K.TOKENS_PER_MESSAGE} + {_tok_sql('role')} + {_tok_sql('text')}) + {K.REPLY_PRIMING_TOKENS} AS BIGINT) AS n_tokens,
  CAST(sum(CASE WHEN role = 'assistant' THEN {_tok_sql('text')} ELSE 0 END) AS BIGINT) AS n_assistant_tokens
FROM conversations GROUP BY conv_id""")


@register("chat_quality", O.sql("""
SELECT count(*) AS n_examples, count(*) FILTER (WHERE has_system = 0) AS n_missing_system,
       count(*) FILTER (WHERE has_user = 0) AS n_missing_user FROM exstats""", "exstats"))
def chat_quality(spark, d):
    return CS.chat_quality(_stats(spark, d))


@register("example_tokens", O.sql(
    "SELECT conv_id, n_messages, has_system, has_user, n_tokens, n_assistant_tokens FROM exstats", "exstats"))
def example_tokens(spark, d):
    return _stats(spark, d)


@register("token_distribution", O.sql("""
SELECT name, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90
FROM (SELECT 'n_messages' AS name, CAST(n_messages AS DOUBLE) AS v FROM exstats
      UNION ALL SELECT 'n_tokens', CAST(n_tokens AS DOUBLE) FROM exstats
      UNION ALL SELECT 'n_assistant_tokens', CAST(n_assistant_tokens AS DOUBLE) FROM exstats) u GROUP BY name""", "exstats"))
def token_distribution(spark, d):
    return rounded(CS.distribution(_stats(spark, d)))


@register("billing_estimate", O.sql(f"""
SELECT n_examples, n_too_long, round(billing_tokens, 6) AS billing_tokens, n_epochs, round(n_epochs * billing_tokens, 6) AS charged_tokens,
  round(billing_tokens * {float(K.PRICE_PER_MILLION)} / 1e6, 6) AS charged_price,
  round(n_epochs * billing_tokens * {float(K.PRICE_PER_MILLION)} / 1e6, 6) AS charged_price_all_epochs
FROM (SELECT n_examples, n_too_long, billing_tokens,
        CAST(CASE WHEN n_examples * {K.TARGET_EPOCHS} < {K.MIN_TARGET_EXAMPLES} THEN least({K.MAX_DEFAULT_EPOCHS}, floor({K.MIN_TARGET_EXAMPLES} / n_examples))
                  WHEN n_examples * {K.TARGET_EPOCHS} > {K.MAX_TARGET_EXAMPLES} THEN greatest({K.MIN_DEFAULT_EPOCHS}, floor({K.MAX_TARGET_EXAMPLES} / n_examples))
                  ELSE {K.TARGET_EPOCHS} END AS BIGINT) AS n_epochs
      FROM (SELECT count(*) AS n_examples, count(*) FILTER (WHERE n_tokens > {K.MAX_TOKENS_PER_EXAMPLE}) AS n_too_long,
                   sum(least(CAST(n_tokens AS DOUBLE), {K.MAX_TOKENS_PER_EXAMPLE})) AS billing_tokens FROM exstats) a) b""", "exstats"))
def billing_estimate(spark, d):
    return rounded(CS.billing_estimate(_stats(spark, d)))


_WORD = TM.WORD_PATTERN
O.cte("stop", [], f"""
SELECT DISTINCT term FROM (
  SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r
  FROM (SELECT lang, unnest(regexp_extract_all(lower(text), {O._q(_WORD)})) AS term FROM documents) t
  WHERE NOT regexp_full_match(term, '[0-9]+') GROUP BY lang, term) x WHERE r <= 50""")


def _stop(spark, d):
    return TM.corpus_stopwords(X.read(spark, d, "documents"))


_TF_OVERLAP = ("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(array_to_string("
               "list_transform(ovl, lambda s: substring(text, s['start'] + 1, s['end'] - s['start'] + 1)), ' ')), "
               f"{O._q(_WORD)})) AS term FROM ov) t "
               "WHERE NOT regexp_full_match(term, '[0-9]+') AND term NOT IN (SELECT term FROM stop) GROUP BY term")


@register("term_frequencies", O.sql("""
SELECT term, n, rank, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) AS rel_freq
FROM (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rank FROM tf) r WHERE rank <= 200""",
    "ov", "stop", extra=[("tf", _TF_OVERLAP)]))
def term_frequencies(spark, d):
    ot = AG.overlap_text(AG.span_pairs_overlap(_pairs(spark, d)))
    r = TM.term_frequencies(ot, "overlap_text", _stop(spark, d))
    return rounded(r.select("term", "n", F.col("rank").cast("bigint").alias("rank"), "rel_freq"))


#: Two short lists that share a word, as a user would give them.
STOPWORD_LISTS = (["de", "la", "en", "el", "los"], ["le", "La", "les", "de", " et "])
_TF_GIVEN = ("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), " f"{O._q(_WORD)})) AS term FROM pubs) t "
             "WHERE NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ("
             + ", ".join(f"'{w.strip().lower()}'" for words in STOPWORD_LISTS for w in words) + ") GROUP BY term")


@register("term_frequencies_given", O.sql("""
SELECT term, n, rank, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) AS rel_freq
FROM (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rank FROM tf) r WHERE rank <= 200""",
    "pubs", extra=[("tf", _TF_GIVEN)]))
def term_frequencies_given(spark, d):
    """A28 with the union of given stopword lists (U-c), over all texts."""
    r = TM.term_frequencies(X.publications(spark, d), "text", TM.given_stopwords(spark, *STOPWORD_LISTS))
    return rounded(r.select("term", "n", F.col("rank").cast("bigint").alias("rank"), "rel_freq"))


_TF_TRIGGERS = ("SELECT persona, term, count(*) AS n FROM (SELECT persona, unnest(regexp_extract_all("
                f"lower(array_to_string(context, ' ')), {O._q(_WORD)})) AS term FROM annp "
                "WHERE emotion_class = 'negative' AND trigger_level = 5) t "
                "WHERE NOT regexp_full_match(term, '[0-9]+') AND term NOT IN (SELECT term FROM stop) GROUP BY ALL")


@register("trigger_terms", O.sql("""
SELECT persona, term, n, rank, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY persona), 6) AS rel_freq
FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY n DESC, term) AS rank FROM tf) r WHERE rank <= 200""",
    "annp", "stop", extra=[("tf", _TF_TRIGGERS)]))
def trigger_terms(spark, d):
    a = X.annotations(spark, d).withColumn("persona", _persona_of(F.col("created_by")))
    a = a.filter((F.col("emotion_class") == "negative") & (F.col("trigger_level") == 5))
    a = a.select("persona", F.array_join("context", " ").alias("phrases"))
    r = TM.term_frequencies(a, "phrases", _stop(spark, d), ["persona"])
    return rounded(r.select("persona", "term", "n", F.col("rank").cast("bigint").alias("rank"), "rel_freq"))


# ---------------------------------------------------------------------------
# scoring (E2): grid, resume, latest, batch scoring, streaming
# ---------------------------------------------------------------------------
O.cte("grid", ["evalpubs", "personas"], f"""
SELECT p.persona, '{X.GRID_APPROACH}' AS approach, s.seed, u.id, u.text, p.narrative
FROM evalpubs u CROSS JOIN personas p CROSS JOIN (VALUES {", ".join(f"({s})" for s in K.SEEDS)}) s(seed)""")
O.cte("wlog", ["grid"], f"""
SELECT g.persona, g.approach, g.seed, g.id, CAST(t.ts AS BIGINT) AS ingest_ts,
  CASE WHEN t.ts = 2 THEN '{K.FAILED_OUTPUT_JSON}' ELSE '{{"emotion": "fear", "emotion_class": "negative", "trigger_level": 2}}' END AS output
FROM grid g JOIN labels l ON l.doc_id = g.id
CROSS JOIN LATERAL (SELECT unnest(CASE WHEN l.quality = 0 THEN [1, 2] ELSE [1] END) AS ts) t""")
O.cte("pend", ["grid", "wlog"], """
SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM wlog w WHERE w.persona = g.persona AND w.approach = g.approach
                                         AND w.seed = g.seed AND w.id = g.id)""")


def _grid(spark, d):
    return SC.work_grid(_eval_pubs(spark, d), X.personas(spark), X.GRID_APPROACH)


@register("work_grid", O.sql("SELECT persona, approach, seed, id FROM grid", "grid"))
def work_grid(spark, d):
    return _grid(spark, d).select("persona", "approach", "seed", "id")


@register("pending_work", O.sql("SELECT persona, approach, seed, id FROM pend", "pend"))
def pending_work(spark, d):
    return SC.pending(_grid(spark, d), X.work_log(spark, d)).select("persona", "approach", "seed", "id")


@register("latest_result", O.sql(
    "SELECT persona, approach, seed, id, max(ingest_ts) AS ingest_ts, arg_max(output, ingest_ts) AS output FROM wlog GROUP BY ALL",
    "wlog"))
def latest_result(spark, d):
    return SC.latest(X.work_log(spark, d)).select("persona", "approach", "seed", "id", "ingest_ts", "output")


_SCORE_SQL = f"""
SELECT persona, approach, seed, id,
  CASE WHEN n % 13 = 0 THEN 'corrupted' ELSE split_part('{O.EMO_CSV}', ',', CAST(n % 7 + 1 AS INT)) END AS emotion,
  CASE WHEN n % 13 = 0 THEN 'corrupted' WHEN n % 7 IN (1, 2, 3) THEN 'positive' ELSE 'negative' END AS emotion_class,
  CAST(CASE WHEN n % 13 = 0 THEN -1 ELSE n % 5 + 1 END AS INT) AS trigger_level, (n % 13 = 0) AS failed
FROM (SELECT *, length(replace({USR_TPL}, '{K.PUBLICATION_TOKEN}', text)) AS n FROM pend) x"""


def _scored_fields(res: DataFrame) -> DataFrame:
    from raterlab.operators import validate as VV
    v = VV.validate_output(res.withColumn("text", F.lit(None).cast("string")))
    return v.select("persona", "approach", "seed", "id", "emotion", "emotion_class", "trigger_level", "failed")


def _scored(spark, d):
    todo = SC.pending_with_texts(_eval_pubs(spark, d).select("id", "text"), X.personas(spark), X.GRID_APPROACH, K.SEEDS, X.work_log(spark, d))
    todo = todo.select(*SC.KEY, PR.zero_shot_messages(F.col("narrative"), F.col("text")).alias("messages"))
    return SC.run_scorer(todo, SC.length_scorer, model_name={p: f"model of {p}" for p in K.PERSONAS}, temperature=0.25, max_tokens=77)


@register("score_envelopes", O.sql(
    "SELECT persona, approach, seed, id, 'model of ' || persona AS model_name, 0.25::DOUBLE AS temperature, 77 AS max_tokens FROM pend", "pend"))
def score_envelopes(spark, d):
    """L4: the envelope around every answer, with a model per persona."""
    return _scored(spark, d).drop("output")


@register("batch_score", O.sql(_SCORE_SQL, "pend"))
def batch_score(spark, d):
    return _scored_fields(_scored(spark, d))


@register("incremental_score", O.sql(f"""
SELECT persona, approach, seed, id, emotion, trigger_level FROM ({_SCORE_SQL}) s
UNION ALL SELECT persona, approach, seed, id, CASE WHEN max(ingest_ts) = 2 THEN 'corrupted' ELSE 'fear' END,
  CASE WHEN max(ingest_ts) = 2 THEN -1 ELSE 2 END FROM wlog GROUP BY ALL""", "pend", "wlog"))
def incremental_score(spark, d):
    import uuid

    from raterlab.session import checkpoint_path
    from raterlab.streaming import incremental as INC
    base = checkpoint_path(spark, f"incremental-{uuid.uuid4().hex}")
    src, res, ck = f"{base}/drops", f"{base}/results", f"{base}/stream-ckpt"
    pubs = _eval_pubs(spark, d).select("id", "text", "date")
    # the earlier run's log seeds the result table
    log = SC.latest(X.work_log(spark, d))
    (log.select("persona", "approach", "seed", "id", F.lit(K.MODEL_NAME).alias("model_name"),
                F.lit(K.TEMPERATURE).alias("temperature"), F.lit(K.MAX_TOKENS).alias("max_tokens"), "output")
     .withColumn("ingest_ts", F.current_timestamp())
     .write.mode("append").partitionBy("persona", "approach", "seed").parquet(res))
    month = F.substring("date", 6, 2).cast("int")
    # three file drops by publication month; the middle one is dropped twice (replay)
    drops = [(month <= 4), (month > 4) & (month <= 8), (month > 4) & (month <= 8), (month > 8)]
    for i, cond in enumerate(drops):
        pubs.filter(cond).write.mode("overwrite").parquet(f"{src}/drop={i}")
        q = INC.start(spark, src, "id bigint, text string, date string", X.personas(spark), res, ck, scorer=SC.length_scorer)
        INC.run_until_idle(q)
    return _scored_fields(spark.read.parquet(res)).select("persona", "approach", "seed", "id", "emotion", "trigger_level")


# ---------------------------------------------------------------------------
# option variants and p-values
# ---------------------------------------------------------------------------
O.cte("rowq_x", ["aligned"], f"""
SELECT approach, persona, seed, len(context_corrupted) AS corrupted_items, len(t_context) AS t_items, len(context) AS p_items,
  len(list_distinct(list_intersect(t_context, context))) AS strict_correct,
  {O.span_chars('t_locs')} AS t_chars, {O.span_chars('p_locs', 0)} AS p_chars,
  {O.overlap_chars('t_locs', "list_transform(p_locs, lambda z: {'start': z['start'], 'end': z['end'] - 1})")} AS overlap_chars
FROM aligned""")


def _prf_round(correct: str, predicted: str, annotated: str) -> str:
    p = f"(CAST({correct} AS DOUBLE) / nullif(CAST({predicted} AS DOUBLE), 0))"
    r = f"(CAST({correct} AS DOUBLE) / nullif(CAST({annotated} AS DOUBLE), 0))"
    return (f"round({p}, 6) AS precision, round({r}, 6) AS recall, "
            f"round(2.0 * {p} * {r} / nullif({p} + {r}, 0), 6) AS f1_score")


@register("span_metrics_corrected", O.sql(f"""
SELECT approach, persona, seed, 'strict' AS overlap,
  {_prf_round('sum(strict_correct)', 'sum(p_items) + sum(corrupted_items)', 'sum(t_items)')}
FROM rowq_x GROUP BY ALL
UNION ALL
SELECT approach, persona, seed, 'proportional',
  {_prf_round('sum(overlap_chars)', 'sum(p_chars) + sum(corrupted_items)', 'sum(t_chars)')}
FROM rowq_x GROUP BY ALL""", "rowq_x"))
def span_metrics_corrected(spark, d):
    """A3/A4 with the corrected options: each row's own corrupted items as penalty,
    predicted ends exclusive."""
    c = E.run_cells(aligned(spark, d), pred_end="exclusive")
    return rounded(E.span_metrics(c, penalty="per_row").select(
        "approach", "persona", "seed", "overlap", "precision", "recall", "f1_score"))


@register("crosstab_wide_emotion", O.sql("SELECT a, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE b = '{e}') AS BIGINT) AS {e}" for e in K.EMOTIONS)
    + " FROM (SELECT a_emotion AS a, b_emotion AS b FROM pairs) p GROUP BY a", "pairs"))
def crosstab_wide_emotion(spark, d):
    long = AG.crosstab_long(_pairs(spark, d), ["emotion"])
    w = long.filter(F.col("field") == "emotion").groupBy("a").pivot("b", K.EMOTIONS).agg(F.sum("n"))
    return w.select("a", *[F.coalesce(F.col(e), F.lit(0)).cast("bigint").alias(e) for e in K.EMOTIONS])


@register("chi2_pvalue", O.sql(f"""
SELECT field, n, dof, round(chi2, 6) AS chi2, round(CASE WHEN dof <= 0 OR chi2 <= 0 THEN 1 ELSE least(1,
    COALESCE(list_sum(list_transform(range(0, dof // 2), lambda k: exp(-h + (k + o) * ln(h) - lgamma(k + o + 1)))), 0)
    + CASE WHEN dof % 2 = 1 THEN {_erfc_sql('sqrt(h)')} ELSE 0 END) END, 6) AS p_value
FROM (SELECT *, greatest(chi2, 1e-300) / 2 AS h, CASE WHEN dof % 2 = 1 THEN 0.5 ELSE 0.0 END AS o FROM chi) c""",
    "marg", "ct", extra=_CHI2))
def chi2_pvalue(spark, d):
    """A16 with its p-value."""
    return rounded(HY.with_chi2_p(AG.chi2_statistic(_crosstab(spark, d))))


@register("mann_whitney_pvalue", O.sql(
    f"SELECT {_MW_COLUMNS}, round(CASE WHEN z <= 0 THEN 1 ELSE {_erfc_sql('z / sqrt(2)')} END, 6) AS p_value FROM zs",
    "ann", extra=_MW))
def mann_whitney_pvalue(spark, d):
    """A18 with its two-sided p-value."""
    return rounded(HY.with_mann_whitney_p(HY.mann_whitney(_mw_samples(spark, d), "test", "side", "x")))


@register("stream_validation", O.sql(
    f"SELECT {RUN}, id, emotion, emotion_class, trigger_level, failed FROM validf", "validf"))
def stream_validation(spark, d):
    """T1 for validation: prediction files land in two drops (baseline runs, then the
    rest) and are validated by a Structured Streaming job (stream-static text join,
    file sink); the result must equal batch validation."""
    import uuid

    from raterlab.session import checkpoint_path
    from raterlab.sources import sinks as SNK2
    from raterlab.streaming import incremental as INC
    base = checkpoint_path(spark, f"stream-validation-{uuid.uuid4().hex}")
    src, out, ck = f"{base}/predictions", f"{base}/validated", f"{base}/ckpt"
    # a few tasks a core: each writes and sorts less, and none waits for one large one
    preds = X.predictions(spark, d, tasks=4 * spark.sparkContext.defaultParallelism)
    pubs = X.publications(spark, d)
    for cond in (F.col("approach") == K.BASELINE_APPROACH, F.col("approach") != K.BASELINE_APPROACH):
        SNK2.results_json(preds.filter(cond).withColumn("id", F.col("id").cast("string")), src)
        INC.run_until_idle(INC.start_validation(spark, src, pubs.withColumn("id", F.col("id").cast("string")), out, ck))
    v = spark.read.parquet(out)
    return v.select("approach", "persona", F.col("seed").cast("int").alias("seed"), F.col("id").cast("bigint").alias("id"),
                    "emotion", "emotion_class", "trigger_level", "failed")


# ---------------------------------------------------------------------------
# sources / sinks round trips on the real texts
# ---------------------------------------------------------------------------
def _scratch(spark, name: str) -> str:
    import uuid

    from raterlab.session import checkpoint_path
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("publications_csv_roundtrip", O.sql(
    "SELECT CAST(id AS VARCHAR) AS id, text, date, CAST(length(text) AS INT) AS n_chars FROM pubs", "pubs"))
def publications_csv_roundtrip(spark, d):
    """Publications written as CSV (quotes doubled, newlines inside fields) and read
    back with the declared schema."""
    from raterlab.sources import files as SRC2
    path = _scratch(spark, "pubs-csv")
    pubs = X.publications(spark, d).select(F.col("id").cast("string").alias("id"), "text", "date")
    pubs.write.option("header", True).option("escape", '"').csv(path)
    back = SRC2.publications_csv(spark, path)
    return back.select("id", "text", "date", F.length("text").alias("n_chars"))


@register("annotation_csv_roundtrip", O.sql(f"""
SELECT created_by, CAST(id AS VARCHAR) AS id, split_name, CAST(to_json(context) AS VARCHAR) AS context,
  CAST(to_json(context_locations) AS VARCHAR) AS context_locations
FROM ann JOIN split USING (id)""", "ann", "split"))
def annotation_csv_roundtrip(spark, d):
    """K1 → S2: annotation splits written as CSV with Python-literal list columns (one
    folder per annotator and split) and parsed back (F3)."""
    from raterlab.sources import files as SRC2
    from raterlab.sources import sinks as SNK2
    path = _scratch(spark, "ann-csv")
    ann = X.annotations(spark, d)
    split = SP.date_split(X.publications(spark, d))
    flat = ann.join(split, "id").select(
        "emotion", "emotion_class", F.col("trigger_level").cast("string").alias("trigger_level"), "context",
        "context_locations", "description", "created_at", "created_by", "text",
        F.col("id").cast("string").alias("id"), "split_name")
    SNK2.annotation_splits(flat, path, fmt="csv")
    back = SRC2.annotation_split_csv(spark, path)   # created_by / split_name come from the folders
    return back.select("created_by", "id", "split_name", F.to_json("context").alias("context"),
                       F.to_json("context_locations").alias("context_locations"))


@register("weighted_prf_bucketed", O.sql(
    f"SELECT {RUN}, field, {O.rnd('precision')}, {O.rnd('recall')}, {O.rnd('f1_score')}, support FROM wprf", "wprf"))
def weighted_prf_bucketed(spark, d):
    """E1 on stored tables bucketed by id: texts, truth (one row per id) and predictions join without an exchange."""
    from raterlab.sources import sinks as SNK2
    base = _scratch(spark, "bucketed")
    name = "raterlab_" + base.rsplit("-", 1)[1]
    pubs = X.publications(spark, d).select("id", "text")
    buckets = SNK2.bucket_number(pubs)
    texts = SNK2.bucketed_table(pubs, f"{name}_texts", f"{base}/texts", buckets)
    truth = SNK2.bucketed_table(E.truth_by_id(X.evaluation_truth(spark, d)), f"{name}_truth", f"{base}/truth", buckets)
    preds = SNK2.bucketed_table(V.parse_output(X.predictions(spark, d)), f"{name}_predictions", f"{base}/predictions", buckets)
    valid = V.expand_baseline(V.locate(V.attach_text(preds, texts)))
    return rounded(E.weighted_prf(E.run_cells(E.align_by_id(truth, valid))))


@register("prediction_lines", O.sql(
    "SELECT persona, approach, seed, CAST(id AS VARCHAR) AS id, model_name, temperature, max_tokens, emotion, failed FROM "
    f"(SELECT *, '{K.MODEL_NAME}' AS model_name, {K.TEMPERATURE}::DOUBLE AS temperature, {K.MAX_TOKENS} AS max_tokens FROM validf) v", "validf"))
def prediction_lines(spark, d):
    """K4 → S3: result lines under persona=/approach=/seed= read back with their envelopes and validated."""
    from raterlab.sources import files as SRC2
    from raterlab.sources import sinks as SNK2
    path = _scratch(spark, "prediction-lines")
    SNK2.results_json(X.predictions(spark, d).withColumn("id", F.col("id").cast("string")), path)
    back = SRC2.predictions(spark, path).withColumn("seed", F.col("seed").cast("int"))
    texts = X.publications(spark, d).withColumn("id", F.col("id").cast("string"))
    return V.validate_predictions(back, texts).select("persona", "approach", "seed", "id", "model_name", "temperature", "max_tokens",
                                                      "emotion", "failed")


_LINE = ("concat('{\"id\": \"', CAST(doc_id AS VARCHAR), '\", \"model_name\": \"m\", \"temperature\": 0.5, \"max_tokens\": ', "
         "CAST(doc_id % 50 AS VARCHAR), ', \"output\": \"', source, '\"}')")
_BROKEN = (f"CASE WHEN doc_id % 13 = 0 THEN substr({_LINE}, 1, length({_LINE}) - 5) WHEN doc_id % 17 = 0 THEN concat('no json ', CAST(doc_id AS VARCHAR)) "
           f"WHEN doc_id % 19 = 0 THEN replace({_LINE}, '0.5', '\"warm\"') ELSE {_LINE} END")


@register("prediction_quarantine", f"""
SELECT kind, id, max_tokens, output, line FROM (
  SELECT doc_id, 'row' AS kind, CAST(doc_id AS VARCHAR) AS id, CAST(doc_id % 50 AS INT) AS max_tokens, source AS output, NULL AS line
  FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0
  UNION ALL SELECT doc_id, 'quarantine', NULL, NULL, NULL, {_BROKEN}
  FROM documents WHERE doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0) x""")
def prediction_quarantine(spark, d):
    """S3 with lines that are cut off, are no JSON or hold another type: whole ones are rows, the others are kept aside."""
    from raterlab.sources import files as SRC2
    path = _scratch(spark, "quarantine")
    X.read(spark, d, "documents").select(F.expr(_BROKEN.replace("VARCHAR", "STRING")).alias("value")).write.text(path)
    rows, bad = SRC2.json_lines_quarantined(spark, path, SRC2.prediction_schema())
    none = F.lit(None).cast("string")
    return rows.select(F.lit("row").alias("kind"), "id", "max_tokens", "output", none.alias("line")).unionByName(
        bad.select(F.lit("quarantine").alias("kind"), none.alias("id"), F.lit(None).cast("int").alias("max_tokens"), none.alias("output"), "line"))


@register("python_literal_parse", r"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('["p', doc_id, '","it''s"]') WHEN 1 THEN concat('["p', doc_id, ' 😀"]')
  WHEN 2 THEN concat('["p', doc_id, '",null]') WHEN 3 THEN concat('["p', doc_id, '","é"]') WHEN 4 THEN concat('["p', doc_id, 'joined"]') END AS parsed
FROM documents""")
def python_literal_parse(spark, d):
    """F3 on what only Python reads: tuples, 8-digit escapes, None and adjoining strings, beside plain lists and text that is no literal."""
    i = F.col("doc_id").cast("string")
    text = (F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("('p"), i, F.lit("', \"it's\")")))
            .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("['p"), i, F.lit(" \\U0001f600']")))
            .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("['p"), i, F.lit("', None]")))
            .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("['p"), i, F.lit("', '\\xe9']")))
            .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("['p"), i, F.lit("' 'joined']")))
            .otherwise(F.concat(F.lit("[no literal "), i)))
    parsed = TX.parse_python_literal(F.col("lit"))
    return X.read(spark, d, "documents").select("doc_id", text.alias("lit")).select("doc_id", F.to_json(parsed, {"ignoreNullFields": "false"}).alias("parsed"))


# ---------------------------------------------------------------------------
# the file chain: what one step writes is what the next one reads
# ---------------------------------------------------------------------------
@register("annotations_documents", O.sql("""
SELECT created_by AS annotator, CAST(id AS VARCHAR) AS id, emotion, emotion_class, CAST(trigger_level AS VARCHAR) AS trigger_level,
  CAST(to_json(context) AS VARCHAR) AS context, CAST(to_json(context_locations) AS VARCHAR) AS context_locations, description, text
FROM ann""", "ann"))
def annotations_documents(spark, d):
    """K7 → S4: annotations written as ``{annotator: [record, ...]}`` documents and read back by blocks."""
    from raterlab.sources import files as SRC2
    from raterlab.sources import sinks as SNK2
    path = _scratch(spark, "annotations-documents")
    SNK2.annotations_documents(X.annotations(spark, d), path, rows_per_document=20_000)
    return SRC2.annotations_by_rater(spark, path).select(
        "annotator", "id", "emotion", "emotion_class", "trigger_level", F.to_json("context").alias("context"),
        F.to_json("context_locations").alias("context_locations"), "description", "text")


@register("split_ids_documents", O.sql("SELECT CAST(id AS VARCHAR) AS id, split_name FROM split", "split"))
def split_ids_documents(spark, d):
    """K2 → S5: the split written as ``{split_name: [ids]}`` documents and read back by blocks."""
    from raterlab.sources import files as SRC2
    from raterlab.sources import sinks as SNK2
    path = _scratch(spark, "split-ids")
    SNK2.split_ids_documents(SP.date_split(X.publications(spark, d)), path)
    return SRC2.split_ids(spark, path)


@register("publications_with_split", O.sql(
    "SELECT CAST(p.id AS VARCHAR) AS id, p.text, p.date, s.split_name FROM pubs p LEFT JOIN (SELECT * FROM split WHERE split_name <> 'evaluation') s "
    "ON p.id = s.id", "pubs", "split"))
def publications_with_split(spark, d):
    """K2 → S1: publications as CSV with the name of their head split, read back with that column."""
    from raterlab.sources import files as SRC2
    from raterlab.sources import sinks as SNK2
    path = _scratch(spark, "publications-split")
    pubs = X.publications(spark, d).select("id", "text", "date")
    SNK2.publications_with_split(pubs, SP.date_split(pubs).filter(F.col("split_name") != "evaluation"), path)
    return SRC2.publications_csv(spark, path, kept=("split_name",)).select("id", "text", "date", "split_name")


@register("few_shot_file_prompts", ORACLE["few_shot_prompts"])
def few_shot_file_prompts(spark, d):
    """S6, S7, S8 → L2: persona dictionary, chat template and few-shot files are written, read back and rendered."""
    from raterlab.sources import files as SRC2
    path = _scratch(spark, "few-shot-files")
    config = [("personas", dict(X.PERSONA_NARRATIVE)), ("template", [{"role": r, "content": c} for r, c in K.EVALUATE_TEMPLATE])]
    for name, value in config:
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(f"{path}/{name}")
    ex = X.few_shot_examples(spark, d)
    messages = F.array(PR.message("user", F.col("input")), PR.message("assistant", F.col("output")))
    # a persona's file holds its training split, in order
    ex = ex.repartition("persona").sortWithinPartitions("persona", "pos")
    ex.select("persona", PR.chat_jsonl(messages).alias("value")).write.partitionBy("persona").text(f"{path}/fs")
    table = PR.few_shot_table(SRC2.personas_dict(spark, f"{path}/personas"), SRC2.few_shot_examples(spark, f"{path}/fs"))
    g = PR.persona_grid(_eval_pubs(spark, d), table, persona_cols=("persona", "narrative", "shots"))
    m = PR.few_shot_messages(F.col("narrative"), F.col("shots"), F.col("text"), SRC2.prompt_template(spark, f"{path}/template"))
    return g.select("persona", "id", F.size(m).alias("n_messages"), F.md5(F.to_json(m)).alias("messages_md5"))


@register("finetune_files", O.sql(f"""
SELECT persona, split_name, answer,
  md5(CAST(to_json([{{'role': 'system', 'content': replace({SYS_TPL}, '{K.CONTEXT_TOKEN}', narrative)}},
                    {{'role': 'user', 'content': replace({USR_TPL}, '{K.FENCED_PUBLICATION_TOKEN}', text)}},
                    {{'role': 'assistant', 'content': answer}}]) AS VARCHAR)) AS messages_md5
FROM (SELECT p.persona, p.narrative, s.split_name, a.id, a.text, {_FT_ANSWER} AS answer
      FROM (SELECT * REPLACE (coalesce(description, 'none given') AS description) FROM ann) a
      JOIN personas p ON a.created_by = p.annotator JOIN split s ON s.id = a.id
      WHERE s.split_name IN ('ft_training', 'ft_validation')) t""", "ann", "personas", "split"))
def finetune_files(spark, d):
    """P6 → K3 → S8: with every description there, the gate lets the examples pass; written and read back."""
    from raterlab.sources import files as SRC2
    from raterlab.sources import sinks as SNK2
    path = _scratch(spark, "finetune-files")
    ann = X.annotations(spark, d).withColumn("description", F.coalesce("description", F.lit("none given")))
    SNK2.finetune_jsonl(PR.finetune_examples(ann, X.personas(spark), SP.date_split(X.publications(spark, d))), path)
    return SRC2.chat_examples(spark, path).select(
        "persona", "split_name", F.col("messages")[2]["content"].alias("answer"), F.md5(F.to_json("messages")).alias("messages_md5"))


@register("description_files", O.sql("""
SELECT a.created_by, a.id, COALESCE(CASE WHEN a.rater = 'a' THEN dsc.description ELSE 'b: ' || dsc.description END, a.description) AS description
FROM ann a LEFT JOIN (SELECT conv_id AS id, arg_min(text, turn) AS description FROM conversations
                      WHERE role <> 'system' AND text IS NOT NULL GROUP BY conv_id) dsc ON a.id = dsc.id""", "ann"))
def description_files(spark, d):
    """S9 → J3, D1: a description file per rater; the first one of a publication wins, all raters in one join."""
    from raterlab.sources import files as SRC2
    path = _scratch(spark, "description-files")
    given = X.descriptions(spark, d).repartition("id").sortWithinPartitions("id", "pos")
    for rater, lead in (("a", ""), ("b", "b: ")):
        (given.select("id", F.concat(F.lit(lead), "description").alias("description"))
         .write.option("header", True).option("escape", '"').csv(f"{path}/{rater}"))
    parts = [SRC2.descriptions_csv(spark, f"{path}/{r}").withColumn("created_by", X.rater_id(r)) for r in ("a", "b")]
    given = parts[0].unionByName(parts[1]).withColumn("id", F.col("id").cast("bigint"))
    ann = X.annotations(spark, d).select("created_by", "id", "description")
    return AN.override_descriptions(ann, given, ["created_by", "id"]).select("created_by", "id", "description")


@register("split_duplicates", O.sql(
    "SELECT created_by, id, count(*) AS n FROM (SELECT created_by, id FROM ann UNION ALL SELECT created_by, id FROM ann WHERE emotion = 'fear') x "
    "GROUP BY ALL HAVING count(*) > 1", "ann"))
def split_duplicates(spark, d):
    """(rater, publication) labelled more than once, in annotations to which one label's rows were added again."""
    ann = X.annotations(spark, d).select("created_by", "id", "emotion")
    return SP.duplicate_annotations(ann.unionByName(ann.filter(F.col("emotion") == "fear")))


@register("report_file", O.sql(
    f"SELECT approach AS approach_name, {_MEAN_PM}, 'average' AS persona_name FROM report_full GROUP BY approach", "report_full"))
def report_file(spark, d):
    """A8 → K6: the summary report as a file with the report's header, read back."""
    from raterlab.sources import sinks as SNK2
    path = _scratch(spark, "report-file")
    SNK2.report_csv(E.report_mean_3std(E.evaluation_report(cells(spark, d))), path)
    names = ["failed", "persona_name", "approach_name", *[c for c in E.REPORT_COLUMNS if c != "failed"]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


@register("export_lines", ORACLE["flatten_annotations"])
def export_lines(spark, d):
    """S10 → F2, P7: the raw export as JSON lines, read back and flattened."""
    from raterlab.sources import files as SRC2
    path = _scratch(spark, "export-lines")
    X.export(spark, d).write.json(path)
    kept, _ = AN.split_quarantine(AN.flatten_export(SRC2.export_json(spark, path), X.PROJECT))
    return kept.select("created_by", "id", "emotion", "emotion_class", "trigger_level",
                       CO.strict_int(F.col("trigger_level")).alias("trigger_level_int"), "description", "created_at",
                       F.to_json("context").alias("context"), F.to_json("context_locations").alias("context_locations"))
