"""Bucketed storage, malformed lines, literals, long spans, every pair of raters, scoring keys."""
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlab.functions import text as T
from raterlab.operators import agreement as AG
from raterlab.operators import costs as CS
from raterlab.operators import evaluation as E
from raterlab.operators import scoring as SC
from raterlab.operators import validate as V
from raterlab.sources import files as SRC
from raterlab.sources import sinks as SNK


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def evaluation_inputs(spark):
    ids = spark.range(60).withColumn("id", F.col("id").cast("string"))
    texts = ids.withColumn("text", F.concat(F.lit("Text of "), "id"))
    spans = F.array().cast("array<struct<start:int,end:int>>")
    truth = ids.crossJoin(spark.createDataFrame([("p1",), ("p2",)], "persona string")).select(
        "persona", "id", F.lit("fear").alias("emotion"), F.lit("negative").alias("emotion_class"), F.lit(2).alias("trigger_level"),
        F.array(F.lit("text")).alias("context"), spans.alias("context_locations"))
    preds = truth.select("persona", "id", F.lit("a").alias("approach"), F.explode(F.array(F.lit(7), F.lit(9))).alias("seed"),
                         F.lit('{"emotion": "fear", "emotion_class": "negative", "trigger_level": 2, "context": ["text"]}').alias("output"))
    return texts, truth, preds


def test_bucketed_tables_join_without_moving_rows(spark, tmp_out, no_broadcast):
    texts, truth, preds = evaluation_inputs(spark)
    tables = {"texts": texts, "truth": E.truth_by_id(truth), "preds": V.parse_output(preds)}
    stored = {n: SNK.bucketed_table(df, f"bucketed_{n}", os.path.join(tmp_out, n), 4) for n, df in tables.items()}
    aligned = E.align_by_id(stored["truth"], V.locate(V.attach_text(stored["preds"], stored["texts"])))
    assert "Exchange" not in plan_of(aligned) and aligned.count() == 240
    # a later session opens the files by their place
    for n, df in tables.items():
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        stored[n] = SRC.bucketed_table(spark, f"opened_{n}", os.path.join(tmp_out, n), ddl, 4)
    again = E.align_by_id(stored["truth"], V.locate(V.attach_text(stored["preds"], stored["texts"])))
    assert "Exchange" not in plan_of(again) and sorted(map(str, again.collect())) == sorted(map(str, aligned.collect()))


def test_predictions_are_shuffled_once(spark, no_broadcast):
    texts, truth, preds = evaluation_inputs(spark)
    plan = plan_of(E.align(truth, V.expand_baseline(V.validate_predictions(preds, texts))))
    assert "hashpartitioning(persona" not in plan and len(re.findall(r"Exchange hashpartitioning\(id", plan)) == 3


def test_malformed_lines_raise_or_are_set_aside(spark, tmp_out):
    path = os.path.join(tmp_out, "lines", "persona=p", "approach=a", "seed=7")
    os.makedirs(path)
    good = '{"id": "1", "model_name": "m", "temperature": 0.5, "max_tokens": 9, "output": "{}"}'
    bad = [good[:-9], "no json", good.replace("0.5", '"warm"'), "[1]", "12"]
    with open(os.path.join(path, "part.json"), "w") as f:
        f.write("\n".join([good, *bad, "", "  ", good.replace('"1"', '"2"')]) + "\n")
    root = os.path.join(tmp_out, "lines")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        SRC.predictions(spark, root).collect()
    rows, aside = SRC.json_lines_quarantined(spark, root, SRC.prediction_schema())
    assert sorted((r.id, r.max_tokens, r.persona, str(r.seed)) for r in rows.collect()) == [("1", 9, "p", "7"), ("2", 9, "p", "7")]
    assert sorted(r.line for r in aside.collect()) == sorted(bad) and {r.persona for r in aside.collect()} == {"p"}
    chats = os.path.join(tmp_out, "chats.jsonl")
    with open(chats, "w") as f:
        f.write('{"messages": [{"role": "user", "content": "x"}]}\n{"messages": [{"role"\n')
    for read in (SRC.chat_examples, SRC.export_json):
        with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
            read(spark, chats).collect()
    whole, cut = SRC.json_lines_quarantined(spark, chats, SRC.S.CHAT_EXAMPLE)
    assert (whole.count(), cut.count()) == (1, 1)


def test_every_legal_list_literal_is_read(spark):
    texts = {"('a', 'b')": ["a", "b"], "['\\U0001f600']": ["😀"], "['a', None]": ["a", None], "['a' 'b']": ["ab"], "[]": [], "()": [],
             "['it\\'s', \"x\"]": ["it's", "x"], " ('a',) ": ["a"], "['\\N{BULLET}']": ["•"], "[1, 2": None, "text": None, "{'a': 1}": None}
    rows = spark.createDataFrame([(k,) for k in texts] + [(None,)], "x string")
    got = {r.x: r.v for r in rows.select("x", T.parse_python_literal(F.col("x")).alias("v")).collect()}
    assert got == {**texts, None: None}
    out = spark.createDataFrame([("t", "{\"context\": \"('al', 'zz')\"}")], "text string, output string")
    v = V.validate_output(out.withColumn("text", F.lit("All texts"))).first()
    assert (v.context, v.context_corrupted) == (["al"], ["zz"])


def test_span_sweep_equals_all_pairs_and_takes_long_lists(spark):
    rng = np.random.default_rng(2)

    def spans(n, reach):
        start = rng.integers(0, reach, n)
        return [(int(s), int(s + w)) for s, w in zip(start, rng.integers(0, 12, n) ** 3)]
    few = {i: (spans(9, 300), spans(7, 300)) for i in range(5)}
    few[5] = ([(3, 3), (3, 3), (0, 10 ** 6)], [(3, 3), (10 ** 6, 10 ** 6)])
    long = (spans(10_000, 10 ** 6), spans(10_000, 10 ** 6))
    sides = [[(i, *s) for i, both in [*few.items(), (9, long)] for s in both[k]] + [(1, None, 4), (1, 9, 2)] for k in (0, 1)]
    a, b = (spark.createDataFrame(rows, "id long, start long, end long") for rows in sides)
    got = sorted(tuple(r) for r in AG.overlap_sweep(a, b).filter("id < 9").collect())
    assert got == sorted((i, max(s, x), min(e, y)) for i, (p, q) in few.items() for s, e in p for x, y in q if max(s, x) <= min(e, y))
    starts, ends = (np.sort([s[k] for s in long[1]]) for k in (0, 1))
    expected = sum(int(np.searchsorted(starts, e, "right") - np.searchsorted(ends, s, "left")) for s, e in long[0])
    assert AG.overlap_sweep(a, b).filter("id = 9").count() == expected


def test_every_pair_of_raters_and_no_double_labels(spark):
    rows = [("x", 1, "u"), ("y", 1, "u"), ("z", 1, "v"), ("x", 2, "u"), ("z", 2, "u"), ("y", 3, "u"), (None, 1, "u"), ("x", None, "u")]
    ann = spark.createDataFrame(rows, "created_by string, id int, label string")
    got = sorted(tuple(r) for r in AG.pair_all_raters(ann, ["label"]).collect())
    assert got == [("x", "y", 1, "u", "u"), ("x", "z", 1, "u", "v"), ("x", "z", 2, "u", "u"), ("y", "z", 1, "u", "v")]
    two = AG.pair_raters(ann, "x", "z", ["label"]).collect()
    assert sorted((r.id, r.a_label, r.b_label) for r in two) == [(1, "u", "v"), (2, "u", "u")]
    with pytest.raises(Exception, match="labelled twice"):
        AG.pair_all_raters(ann.unionByName(ann.filter("id = 3")), ["label"]).collect()


def test_examples_without_messages_count(spark):
    schema = "k int, messages array<struct<role:string,content:string,name:string>>"
    rows = [(1, []), (2, None), (3, [("user", "a b", None), ("assistant", "c", "bob"), (None, None, None)])]
    stats = {r.k: r for r in CS.example_stats_in_row(spark.createDataFrame(rows, schema), "k").collect()}
    assert len(stats) == 3 and (stats[1].n_messages, stats[2].n_messages, stats[2].n_tokens) == (0, 0, 3)
    bare = CS.example_stats_in_row(spark.createDataFrame(rows, schema).withColumn("messages", F.transform(
        "messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))), "k").filter("k = 3").first()
    assert (stats[3].n_messages, stats[3].has_user, stats[3].has_system) == (3, 1, 0)
    assert stats[3].n_tokens == bare.n_tokens + 2 and stats[3].n_assistant_tokens == bare.n_assistant_tokens == 1


def test_texts_stay_out_of_the_resume_join(spark, no_broadcast):
    pubs = spark.range(20).select("id", F.concat(F.lit("text "), "id").alias("text"))
    personas = spark.createDataFrame([("p1", "n1"), ("p2", "n2")], "persona string, narrative string")
    done = spark.range(5).select(F.lit("p1").alias("persona"), F.lit("a").alias("approach"), F.lit(7).alias("seed"), "id", F.lit("{}").alias("output"))
    todo = SC.pending_with_texts(pubs, personas, "a", [7, 9], done)
    assert todo.count() == 20 * 2 * 2 - 5
    plan = todo._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftAnti"):]
    below = below[:below.index("Join Inner")] if "Join Inner" in below else below
    assert "text" not in below.split("Project [id")[0]


def test_no_row_is_sent_twice(spark, tmp_out):
    work = spark.range(30, numPartitions=1).select(F.lit("p").alias("persona"), F.lit("a").alias("approach"), F.lit(7).alias("seed"), "id",
                                                   F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))).alias("messages"))

    def scorer(messages, batch):
        with open(os.path.join(tmp_out, "calls"), "a") as f:
            f.write(f"{batch['id'].iloc[0]} {len(batch)}\n")
        if batch["id"].iloc[0] % 3 == 0:
            raise RuntimeError("service down")
        return ['{"emotion": "fear"}']
    os.makedirs(tmp_out, exist_ok=True)
    out = {r.id: r.output for r in SC.run_scorer(work, scorer).collect()}
    assert sorted(open(os.path.join(tmp_out, "calls")).read().split("\n")[:-1]) == sorted(f"{i} 1" for i in range(30))
    assert all(("failed" in out[i]) == (i % 3 == 0) for i in range(30))


def test_buckets_grow_with_the_texts(spark, monkeypatch):
    few = spark.range(100).select("id", F.lit("x" * 100).alias("text"))
    assert SNK.bucket_number(few) == SNK.LEAST_BUCKETS == SNK.bucket_number(few.filter("id < 0"))
    assert SNK.bucket_number(few.withColumn("text", F.lit(None).cast("string"))) == SNK.LEAST_BUCKETS
    assert SNK.bucket_number(spark.range(64 * SNK.BUCKET_ROWS + 1).select(F.lit("x").alias("text"))) == 65
    monkeypatch.setattr(SNK, "BUCKET_BYTES", 250)
    assert SNK.bucket_number(few) == 40


def test_bucketed_query_takes_as_many_buckets_as_its_texts_need(spark, monkeypatch, no_broadcast):
    from conftest import SF_SMALL
    from raterlab.plans import catalog
    made = []
    table = SNK.bucketed_table
    monkeypatch.setattr(SNK, "BUCKET_ROWS", 10)
    monkeypatch.setattr(SNK, "bucketed_table", lambda df, name, path, buckets, **kw: made.append(buckets) or table(df, name, path, buckets, **kw))
    rows = catalog.QUERIES["weighted_prf_bucketed"](spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert rows and made == [-(-docs // 10)] * 3
