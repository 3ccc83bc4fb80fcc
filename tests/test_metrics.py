"""A1, A3, A4, J12 against brute force written from the definitions."""
import random

import pytest

from raterlab.operators import evaluation as E


def prf_weighted(y, yhat):
    labels = sorted(set(y) | set(yhat))
    n = len(y)
    p = r = f = 0.0
    for lab in labels:
        tp = sum(1 for a, b in zip(y, yhat) if a == b == lab)
        sup = sum(1 for a in y if a == lab)
        pred = sum(1 for b in yhat if b == lab)
        pl = tp / pred if pred else 0.0
        rl = tp / sup if sup else 0.0
        fl = 2 * pl * rl / (pl + rl) if pl + rl else 0.0
        p += pl * sup
        r += rl * sup
        f += fl * sup
    return p / n, r / n, f / n


def inter(t, p):
    out = []
    for a in t:
        for b in p:
            lo, hi = max(a[0], b[0]), min(a[1], b[1])
            if lo <= hi:
                out.append((lo, hi))
    return out


def spans_brute(rows):
    n = len(rows)
    sc = sp = sa = 0
    pc = pp = pa = 0
    corrupted_total = sum(len(r["cor"]) for r in rows)
    for r in rows:
        sp += len(r["pc"]) + n
        sa += len(r["tc"])
        sc += len(set(r["tc"]) & set(r["pc"]))
        pa += sum(e - s + 1 for s, e in r["tl"])
        pp += sum(e - s + 1 for s, e in r["pl"]) + corrupted_total
        pc += sum(e - s + 1 for s, e in inter(r["tl"], r["pl"]))

    def prf(c, p_, a):
        P = c / p_ if p_ else None
        R = c / a if a else None
        F1 = 2 * P * R / (P + R) if P is not None and R is not None and P + R else None
        return P, R, F1
    return prf(sc, sp, sa), prf(pc, pp, pa)


def make_aligned(spark, rows):
    data = [("ap", "pe", 7, i, r["y"][0], r["y"][1], r["y"][2], r["tc"], [{"start": s, "end": e} for s, e in r["tl"]],
             r["p"][0], r["p"][1], r["p"][2], r["pc"], [{"start": s, "end": e} for s, e in r["pl"]], r["cor"],
             r["p"][0] == "corrupted")
            for i, r in enumerate(rows)]
    schema = ("approach string, persona string, seed int, id long, t_emotion string, t_emotion_class string, "
              "t_trigger_level int, t_context array<string>, t_context_locations array<struct<start:int,end:int>>, "
              "emotion string, emotion_class string, trigger_level int, context array<string>, "
              "context_locations array<struct<start:int,end:int>>, context_corrupted array<string>, failed boolean")
    return spark.createDataFrame(data, schema)


def random_rows(rng, n):
    emos = ["joy", "fear", "anger", "corrupted"]
    rows = []
    for _ in range(n):
        def spans():
            out = []
            for _ in range(rng.randint(0, 3)):
                s = rng.randint(0, 30)
                out.append((s, s + rng.randint(0, 8)))
            return out
        words = ["a", "b", "c", "d"]
        rows.append({"y": (rng.choice(emos[:3]), rng.choice(["positive", "negative"]), rng.randint(1, 5)),
                     "p": (rng.choice(emos), rng.choice(["positive", "negative", "corrupted"]), rng.randint(-1, 5)),
                     "tc": rng.sample(words, rng.randint(0, 3)), "pc": [rng.choice(words) for _ in range(rng.randint(0, 3))],
                     "tl": spans(), "pl": spans(), "cor": ["x"] * rng.randint(0, 2)})
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_weighted_prf_and_spans_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 60)
    cells = E.run_cells(make_aligned(spark, rows))
    got = {r.field: r for r in E.weighted_prf(cells).collect()}
    for k, f in enumerate(["emotion", "emotion_class", "trigger_level"]):
        y = [str(r["y"][k]) for r in rows]
        yhat = [str(r["p"][k]) for r in rows]
        exp = prf_weighted(y, yhat)
        assert got[f].precision == pytest.approx(exp[0])
        assert got[f].recall == pytest.approx(exp[1])
        assert got[f].f1_score == pytest.approx(exp[2])
    strict, prop = spans_brute(rows)
    sm = {r.overlap: r for r in E.span_metrics(cells).collect()}
    for name, exp in (("strict", strict), ("proportional", prop)):
        assert sm[name].precision == pytest.approx(exp[0])
        assert sm[name].recall == pytest.approx(exp[1])
        assert sm[name].f1_score == pytest.approx(exp[2])


def test_no_overlap_and_empty(spark):
    rows = [{"y": ("joy", "positive", 1), "p": ("joy", "positive", 1), "tc": ["a"], "pc": ["b"],
             "tl": [(0, 2)], "pl": [(5, 6)], "cor": []}]
    sm = {r.overlap: r for r in E.span_metrics(E.run_cells(make_aligned(spark, rows)), penalty="none").collect()}
    assert sm["proportional"].precision == 0 and sm["proportional"].recall == 0
    assert sm["proportional"].f1_score is None
    rows = [{"y": ("joy", "positive", 1), "p": ("joy", "positive", 1), "tc": [], "pc": [],
             "tl": [], "pl": [], "cor": []}]
    sm = {r.overlap: r for r in E.span_metrics(E.run_cells(make_aligned(spark, rows)), penalty="none").collect()}
    assert sm["strict"].precision is None and sm["strict"].recall is None and sm["strict"].f1_score is None


def test_two_predictions_over_one_truth(spark):
    rows = [{"y": ("joy", "positive", 1), "p": ("joy", "positive", 1), "tc": [], "pc": [],
             "tl": [(0, 9)], "pl": [(0, 3), (2, 5)], "cor": []}]
    sm = {r.overlap: r for r in E.span_metrics(E.run_cells(make_aligned(spark, rows)), penalty="none").collect()}
    assert sm["proportional"].correct == 4 + 4


def test_identity_metamorphic(spark):
    rows = [{"y": ("joy", "positive", 3), "p": ("joy", "positive", 3), "tc": ["a"], "pc": ["a"],
             "tl": [(0, 3)], "pl": [(0, 3)], "cor": []},
            {"y": ("fear", "negative", 4), "p": ("fear", "negative", 4), "tc": ["b"], "pc": ["b"],
             "tl": [(5, 9)], "pl": [(5, 9)], "cor": []}]
    cells = E.run_cells(make_aligned(spark, rows))
    for r in E.weighted_prf(cells).collect():
        assert r.precision == r.recall == r.f1_score == 1.0
    sm = {r.overlap: r for r in E.span_metrics(cells, penalty="none").collect()}
    assert sm["proportional"].f1_score == 1.0 and sm["strict"].f1_score == 1.0


def test_report_mean_pm_format(spark):
    df = spark.createDataFrame([("a", 0.4), ("a", 0.4)], "approach string, failed double")
    r = E.report_mean_3std(df).collect()[0]
    assert r.failed == "0.4±0.0" and r.persona == "average"


def test_alignment_gate_sees_repeated_ids_and_absent_runs(spark):
    import pytest
    from raterlab.operators import evaluation as E
    truth = spark.createDataFrame([("p1", 1), ("p1", 2), ("p2", 1)], "persona string, id int")
    pred = spark.createDataFrame([("x", "p1", 0, 1, True), ("x", "p1", 0, 1, True)],
                                 "approach string, persona string, seed int, id int, has_text boolean")
    gaps = E.alignment_gaps(truth, pred)
    got = {r.persona: (r.n_pred, r.missing_predictions, r.duplicate_predictions) for r in gaps.collect()}
    assert got == {"p1": (2, 1, 1), "p2": (0, 1, 0)}
    with pytest.raises(ValueError):
        E.check_alignment(gaps)


def test_mann_whitney_leaves_missing_values_out(spark):
    from raterlab.operators import hypothesis as H
    rows = [("t", "a", float(v)) for v in (1, 2, 4, 7, 9)] + [("t", "b", float(v)) for v in (3, 5, 6, 8, 10)]
    schema = "test string, side string, value double"
    clean = H.mann_whitney(spark.createDataFrame(rows, schema), "test", "side", "value").first()
    dirty = rows + [("t", "a", None)] * 5 + [("t", "b", float("nan"))] * 3
    assert H.mann_whitney(spark.createDataFrame(dirty, schema), "test", "side", "value").first() == clean
