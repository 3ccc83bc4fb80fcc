"""End-to-end jobs through real files (sf0.001 fixtures)."""
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
import __spark_entry__ as entry
from raterlab.operators import scoring as SC
from raterlab.operators import splits as SP
from raterlab.plans import fixtures as X
from raterlab.plans import jobs as J
from raterlab.sources import files as SRC
from raterlab.sources import sinks as SNK


def test_evaluate_through_files_matches_registered_query(spark, tmp_out):
    res = os.path.join(tmp_out, "completed")
    SNK.results_json(X.predictions(spark, SF_SMALL), res, mode="overwrite")
    preds = SRC.predictions(spark, res)
    got = J.evaluate(spark, X.evaluation_truth(spark, SF_SMALL), preds, X.publications(spark, SF_SMALL),
                     report_dir=os.path.join(tmp_out, "report"), strict_alignment=False)
    # with the gate on, the fixture's extra predictions (the 70 head publications) are reported
    import pytest
    with pytest.raises(ValueError, match="not aligned"):
        J.evaluate(spark, X.evaluation_truth(spark, SF_SMALL), preds, X.publications(spark, SF_SMALL))
    # restricted to the evaluation split, the gate passes and the report is unchanged
    from raterlab.operators import splits as SP2
    ev = SP2.in_date_split(preds, X.publications(spark, SF_SMALL), "evaluation")
    gated = J.evaluate(spark, X.evaluation_truth(spark, SF_SMALL), ev, X.publications(spark, SF_SMALL))
    assert sorted(map(tuple, gated.collect())) == sorted(map(tuple, got.select(*gated.columns).collect()))
    want = entry.queries()["report_mean_3std"](spark, SF_SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert os.path.isdir(os.path.join(tmp_out, "report", "report_all"))


def test_flat_prediction_names(spark, tmp_out):
    d = os.path.join(tmp_out, "flat")
    os.makedirs(d)
    for name in ["persona_1_context_few_shot_10_seed=7.jsonl", "assistant_no_context_seed=42.jsonl"]:
        with open(os.path.join(d, name), "w") as f:
            f.write('{"id": "1", "model_name": "m", "temperature": 0.2, "max_tokens": 5, "seed": 7, "output": {"emotion": "joy"}}\n')
    got = sorted((r.persona, r.approach, r.seed) for r in SRC.predictions_flat(spark, d).collect())
    assert got == [("assistant", "no_context", 42), ("persona_1", "context_few_shot_10", 7)]


def test_inference_job_resumes(spark, tmp_out):
    pubs = X.publications(spark, SF_SMALL)
    splits = SP.date_split(pubs)
    res = os.path.join(tmp_out, "results")
    first = J.run_inference(spark, pubs, splits, X.personas(spark), "context_zero_shot", SC.length_scorer, res).count()
    again = J.run_inference(spark, pubs, splits, X.personas(spark), "context_zero_shot", SC.length_scorer, res).count()
    n_eval = SP.in_split(pubs, splits, "evaluation").count()
    assert first == again == n_eval * 2 * 3
    fs = J.run_inference(spark, pubs, splits, X.personas(spark), "context_few_shot_5", SC.length_scorer, res,
                         few_shot_examples=X.few_shot_examples(spark, SF_SMALL), n_examples=5)
    assert fs.filter(F.col("approach") == "context_few_shot_5").count() == n_eval * 2 * 3


def test_prepare_and_costs(spark, tmp_out):
    pubs = X.publications(spark, SF_SMALL)
    ann = X.annotations(spark, SF_SMALL).drop("rater", "lang")
    out = J.prepare_splits(spark, pubs, ann, os.path.join(tmp_out, "prep"))
    assert out.count() == ann.count()
    splits = spark.read.parquet(os.path.join(tmp_out, "prep", "splits"))
    ft = J.prepare_finetune(spark, ann, X.personas(spark), splits, os.path.join(tmp_out, "ft"),
                            on_missing_description="keep")
    assert ft.count() == 2 * 70
    rep = J.estimate_costs(spark, os.path.join(tmp_out, "ft", "persona=persona_1", "split_name=ft_training"))
    b = rep["billing"].collect()[0]
    assert b.n_examples == 50 and b.n_epochs == 3
    assert rep["quality"].collect()[0].n_missing_system == 0


def test_evaluate_original_file_layout(spark, tmp_out):
    """Files written the way the original scripts write them (pandas CSV with Python
    list reprs, JSON lines per persona/approach/seed) evaluate to the same report as
    the in-memory pipeline."""
    import json as _json
    import pandas as pd
    from raterlab.operators import evaluation as E
    from raterlab.operators import validate as V
    pubs = X.publications(spark, SF_SMALL).toPandas()
    pubs["id"] = pubs["id"].astype(str)
    pubs.to_csv(os.path.join(tmp_out, "pubs.csv"), index=False)
    truth = X.evaluation_truth(spark, SF_SMALL).toPandas()
    tdir = os.path.join(tmp_out, "truth")
    os.makedirs(tdir)
    mapping = {}
    for (persona, who), g in truth.groupby(["persona", "created_by"]):
        mapping[persona] = who
        out = pd.DataFrame({
            "emotion": g.emotion, "emotion_class": g.emotion_class, "trigger_level": g.trigger_level,
            "context": [repr(list(c)) for c in g.context],
            "context_locations": [repr([(int(s["start"]), int(s["end"])) for s in locs]) for locs in g.context_locations],
            "description": g.description, "created_at": g.created_at, "created_by": g.created_by,
            "text": g.text, "id": g.id.astype(str)})
        out.to_csv(os.path.join(tdir, f"{who}_evaluation.csv"), index=False)
    preds = X.predictions(spark, SF_SMALL).toPandas()
    cdir = os.path.join(tmp_out, "completed")
    os.makedirs(cdir)
    for (persona, approach, seed), g in preds.groupby(["persona", "approach", "seed"]):
        with open(os.path.join(cdir, f"{persona}_{approach}_seed={seed}.jsonl"), "w") as f:
            for r in g.itertuples():
                try:
                    out = _json.loads(r.output)
                except Exception:
                    out = {"response": "failed to generate"}
                f.write(_json.dumps({"id": str(r.id), "model_name": r.model_name, "temperature": r.temperature,
                                     "max_tokens": int(r.max_tokens), "seed": int(seed), "output": out},
                                    ensure_ascii=False) + "\n")
    got = J.evaluate_files(spark, tdir, cdir, os.path.join(tmp_out, "pubs.csv"), mapping, strict_alignment=False)
    valid = V.expand_baseline(V.validate_predictions(X.predictions(spark, SF_SMALL), X.publications(spark, SF_SMALL)))
    want = E.report_mean_3std(E.evaluation_report(E.run_cells(E.align(X.evaluation_truth(spark, SF_SMALL), valid))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_agreement_report_from_rater_json(spark, tmp_out):
    import json as _json
    ann = X.annotations(spark, SF_SMALL).toPandas()
    doc = {}
    for r in ann.itertuples():
        doc.setdefault(r.created_by, []).append({
            "emotion": r.emotion, "emotion_class": r.emotion_class, "trigger_level": str(r.trigger_level),
            "context": list(r.context), "context_locations": [[int(s["start"]), int(s["end"])] for s in r.context_locations],
            "description": r.description, "created_at": r.created_at, "created_by": r.created_by,
            "text": r.text, "id": str(r.id)})
    p = os.path.join(tmp_out, "annotated.json")
    with open(p, "w") as f:
        f.write(_json.dumps(doc, ensure_ascii=False))
    a, b = sorted(doc)
    rep = J.agreement_report(spark, p, a, b)
    kappa = {r.field: r.kappa for r in rep["kappa"].collect()}
    assert set(kappa) == {"emotion", "emotion_class", "trigger_level"}
    chi = rep["chi2"].collect()
    assert all(0.0 <= r.p_value <= 1.0 for r in chi)
    mw = rep["mann_whitney"].collect()[0]
    assert mw.n1 + mw.n2 == len(ann)
    ov = rep["overlap"].collect()[0]
    assert ov.ann1_labels_total + ov.ann2_labels_total == sum(len(c) for c in ann.context_locations)
