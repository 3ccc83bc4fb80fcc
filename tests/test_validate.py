"""V1–V6 edge cases (FIXTURES.md part C)."""
import json

from pyspark.sql import functions as F

from raterlab.operators import validate as V


def run(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, output string")
    return {r["id"]: r for r in V.validate_output(df).collect()}


def out(**kw):
    return json.dumps(kw, ensure_ascii=False)


def test_lenient_level(spark):
    vals = [3, 3.7, "3", "3.7", None, [1], True]
    rows = [(i, "t", out(emotion="joy", emotion_class="positive", trigger_level=v)) for i, v in enumerate(vals)]
    got = run(spark, rows)
    assert [got[i]["trigger_level"] for i in range(len(vals))] == [3, 3, 3, -1, -1, -1, 1]


def test_unusable_outputs(spark):
    rows = [(0, "abc", "not json"), (1, "abc", '{"response": "failed to generate"}'), (2, "abc", "{}")]
    for r in run(spark, rows).values():
        assert r["emotion"] == "corrupted" and r["emotion_class"] == "corrupted"
        assert r["trigger_level"] == -1 and r["failed"]
        assert r["context_locations"] == [] and r["context_corrupted"] == []


def test_context_list_mixed(spark):
    rows = [(0, "Hello Мир world hello", out(context=["МИР", "zzz", ["a"], "hello"]))]
    r = run(spark, rows)[0]
    assert [(s["start"], s["end"]) for s in r["context_locations"]] == [(6, 9), (0, 5)]
    assert len(r["context_corrupted"]) == 2
    assert r["context"] == ["МИР", "hello"]


def test_context_literal_text(spark):
    r = run(spark, [(0, "abc def", out(context="['abc', 'q']"))])[0]
    assert [(s["start"], s["end"]) for s in r["context_locations"]] == [(0, 3)]
    assert r["context_corrupted"] == ["q"]


def test_context_bare_phrase(spark):
    r = run(spark, [(0, "abc def", out(context="bare phrase"))])[0]
    assert r["context_locations"] == [] and r["context_corrupted"] == ["bare phrase"]


def test_context_duplicates_kept(spark):
    r = run(spark, [(0, "abc def", out(context=["abc", "abc"]))])[0]
    assert r["context"] == ["abc", "abc"]
    assert [(s["start"], s["end"]) for s in r["context_locations"]] == [(0, 3), (0, 3)]


def test_null_context_and_domain(spark):
    r = run(spark, [(0, "x", out(emotion="happiness", emotion_class=None, trigger_level=2, context=None))])[0]
    assert r["emotion"] == "corrupted" and r["emotion_class"] == "corrupted" and r["failed"]
    assert r["context"] == [] and r["context_corrupted"] == []


def test_expand_baseline(spark):
    df = spark.createDataFrame([("no_context", "assistant", 1), ("context_zero_shot", "persona_1", 1)],
                               "approach string, persona string, id int")
    got = sorted((r.approach, r.persona) for r in V.expand_baseline(df).collect())
    assert got == [("context_zero_shot", "persona_1"), ("no_context", "persona_1"), ("no_context", "persona_2")]
