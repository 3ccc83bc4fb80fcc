"""Round trips through the file formats."""
import json
import os

from pyspark.sql import functions as F

from raterlab.functions import text as TX
from raterlab.operators import annotations as AN
from raterlab.sources import files as SRC
from raterlab.sources import sinks as SNK


def test_publications_csv_roundtrip(spark, tmp_out):
    import pandas as pd
    p = os.path.join(tmp_out, "pubs.csv")
    pd.DataFrame({"id": ["a", "b"], "text": ['he said "hi"\nthen left', "plain, text"],
                  "date": ["2024-01-02", None]}).to_csv(p, index=False)
    got = {r.id: r for r in SRC.publications_csv(spark, p).collect()}
    assert got["a"].text == 'he said "hi"\nthen left' and got["b"].date is None


def test_split_csv_literals(spark, tmp_out):
    df = spark.createDataFrame(
        [("joy", "positive", "3", ["it's", 'say "x"', "é\\z"], [{"start": 1, "end": 4}], "d", "t0", "r1", "txt", "1", "evaluation")],
        "emotion string, emotion_class string, trigger_level string, context array<string>, "
        "context_locations array<struct<start:int,end:int>>, description string, created_at string, "
        "created_by string, text string, id string, split_name string")
    SNK.annotation_splits(df, tmp_out + "/k1", fmt="csv")
    back = SRC.annotation_split_csv(spark, tmp_out + "/k1/created_by=r1/split_name=evaluation").collect()[0]
    assert back.context == ["it's", 'say "x"', "é\\z"]
    assert [(s.start, s.end) for s in back.context_locations] == [(1, 4)]


def test_python_literal_hex_escape(spark):
    df = spark.createDataFrame([("['a\\xa0b', 'c']",), ("['x\\\\xa0']",), ("not a list",)], "s string")
    got = [r.p for r in df.select(TX.parse_python_list(F.col("s")).alias("p")).collect()]
    assert got[0] == ["a b", "c"] and got[1] == ["x\\xa0"] and got[2] is None


def test_json_documents(spark, tmp_out):
    ann = {"r1": [{"emotion": "joy", "emotion_class": "positive", "trigger_level": "3", "context": ["a"],
                   "context_locations": [[0, 1]], "description": None, "created_at": "t", "created_by": "r1",
                   "text": "a b", "id": "7"}]}
    p = os.path.join(tmp_out, "ann.json")
    open(p, "w").write(json.dumps(ann))
    r = SRC.annotations_by_rater(spark, p).collect()[0]
    assert r.annotator == "r1" and r.context_locations[0].end == 1
    p2 = os.path.join(tmp_out, "split.json")
    open(p2, "w").write(json.dumps({"ft_training": ["1", "2"], "evaluation": ["3"]}))
    assert sorted((x.id, x.split_name) for x in SRC.split_ids(spark, p2).collect()) == [
        ("1", "ft_training"), ("2", "ft_training"), ("3", "evaluation")]
    p3 = os.path.join(tmp_out, "personas.json")
    open(p3, "w").write(json.dumps({"persona_1": "n1"}))
    assert SRC.personas_dict(spark, p3).collect()[0].narrative == "n1"
    p4 = os.path.join(tmp_out, "tpl.json")
    open(p4, "w").write(json.dumps([{"role": "system", "content": "{CONTEXT}"}, {"role": "user", "content": "x"}]))
    assert SRC.prompt_template(spark, p4) == [("system", "{CONTEXT}"), ("user", "x")]


def test_export_flatten(spark, tmp_out):
    label = {"label_details": {"created_by": "someone@x", "created_at": "t"},
             "annotations": {"classifications": [
                 {"value": "emotion", "checklist_answers": [{"value": "fear"}]},
                 {"value": "emotion", "checklist_answers": [{"value": "joy"}]},
                 {"value": "emotion_class", "radio_answer": {"value": "positive"}},
                 {"value": "trigger_level_1_low_5_high", "checklist_answers": [{"value": "4"}]},
                 {"value": "optional_description", "text_answer": {"content": "because"}}],
                 "objects": [{"value": "emotional_triggering_phrases", "location": {"start": 0, "end": 2, "token": "abc"}},
                             {"value": "other", "location": {"start": 5, "end": 6, "token": "zz"}}]}}
    no_emotion = {"label_details": {"created_by": "b@x", "created_at": "t"},
                  "annotations": {"classifications": [], "objects": []}}
    row = {"projects": {"proj": {"labels": [label, no_emotion]}}, "data_row": {"row_data": "abc def", "global_key": "k1"}}
    p = os.path.join(tmp_out, "export.jsonl")
    open(p, "w").write(json.dumps(row) + "\n")
    flat = AN.flatten_export(SRC.export_json(spark, p), "proj")
    kept, bad = AN.split_quarantine(flat)
    r = kept.collect()[0]
    import hashlib
    assert (r.emotion, r.emotion_class, r.trigger_level, r.description) == ("joy", "positive", "4", "because")
    assert r.context == ["abc"] and (r.context_locations[0].start, r.context_locations[0].end) == (0, 2)
    assert r.created_by == hashlib.md5(b"someone@x").hexdigest()[:8]
    assert bad.count() == 1
    assert AN.flatten_export(SRC.export_json(spark, p), "missing_project").count() == 0


def test_results_and_finetune_sinks(spark, tmp_out):
    res = spark.createDataFrame([("p1", "zs", 7, "1", "m", 0.2, 10, '{"emotion": "joy"}')],
                                "persona string, approach string, seed int, id string, model_name string, "
                                "temperature double, max_tokens int, output string")
    SNK.results_json(res, tmp_out + "/res")
    back = SRC.predictions(spark, tmp_out + "/res", expected_rows=1).collect()[0]
    assert json.loads(back.output) == {"emotion": "joy"} and back.seed == 7
    ex = spark.createDataFrame([("p1", "ft_training", [("system", "s"), ("user", "u")])],
                               "persona string, split_name string, messages array<struct<role:string,content:string>>")
    SNK.finetune_jsonl(ex, tmp_out + "/ft")
    chat = SRC.chat_examples(spark, tmp_out + "/ft/persona=p1/split_name=ft_training").collect()[0]
    assert [m.role for m in chat.messages] == ["system", "user"]


def test_csv_columns_are_taken_by_name(spark, tmp_out):
    import pytest
    from raterlab.sources import files
    os.makedirs(f"{tmp_out}/c", exist_ok=True)
    with open(f"{tmp_out}/c/a.csv", "w") as f:
        f.write('date,source,id,text\n2024-01-01,web,7,"a ""b""\nc"\n')
    row = files.publications_csv(spark, f"{tmp_out}/c/a.csv").first()
    assert (row.id, row.text, row.date) == ("7", 'a "b"\nc', "2024-01-01")
    with open(f"{tmp_out}/c/b.csv", "w") as f:
        f.write("id,date\n7,2024-01-01\n")
    with pytest.raises(ValueError, match="missing"):
        files.publications_csv(spark, f"{tmp_out}/c/b.csv")
    with open(f"{tmp_out}/c/d.csv", "w") as f:
        f.write("id,text,date\n7,x,2024-01-01,more,fields\n")
    with pytest.raises(Exception):
        files.publications_csv(spark, f"{tmp_out}/c/d.csv").collect()
    assert files.descriptions_csv(spark, f"{tmp_out}/c/none.csv") is None


def test_malformed_documents_raise_and_templates_are_whole(spark, tmp_out):
    import json
    import pytest
    from raterlab.sources import files
    with open(f"{tmp_out}/t.json", "w") as f:
        json.dump([{"role": "user", "content": str(i)} for i in range(80)], f)
    assert files.prompt_template(spark, f"{tmp_out}/t.json") == [("user", str(i)) for i in range(80)]
    with open(f"{tmp_out}/p.json", "w") as f:
        f.write('{"persona_1": "x", "pers')
    with pytest.raises(Exception):
        files.personas_dict(spark, f"{tmp_out}/p.json").collect()
