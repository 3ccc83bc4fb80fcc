"""JSON documents {key: [element, ...]} read in blocks of a few bytes: whatever is cut, the elements are the same."""
import json
import os
import random

import pytest

from raterlab.sources import documents as D
from raterlab.sources import files as SRC

NASTY = ['}', '{', '"', '\\', '\\"', '}, {"', '], "x": [', ',', 'é😀', '', ' ', '\n', '[1, 2]', '\\\\}', '": [{']


def blocks(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent,size", [(None, 131), (1, 103)])
def test_documents_in_small_blocks(spark, tmp_out, small_blocks, indent, size):
    r = random.Random(size)

    def text():
        return "".join(r.choice(NASTY + ["word"]) for _ in range(r.randint(0, 6)))
    keys = ["r1", 'r"2', "r}3", "r,4: [", "empty"]
    doc = {k: [{"id": str(i), "text": text(), "context": [text() for _ in range(r.randint(0, 3))], "context_locations": [[i, i + 1]],
                "emotion": None} for i in range(0 if k == "empty" else 6)] for k in keys}
    ids = {k: [r.choice([text(), i]) for i in range(0 if k == "empty" else 12)] for k in keys}
    for name, d in (("ann", doc), ("ids", ids)):
        with open(f"{tmp_out}/{name}.json", "w") as f:
            json.dump(d, f, ensure_ascii=False, indent=indent)
    blocks(spark, size)
    got = sorted((x.annotator, int(x.id), x.text, x.context, [tuple(s) for s in x.context_locations], x.emotion)
                 for x in SRC.annotations_by_rater(spark, f"{tmp_out}/ann.json").collect())
    assert got == sorted((k, int(x["id"]), x["text"], x["context"], [tuple(s) for s in x["context_locations"]], None)
                         for k, v in doc.items() for x in v)
    assert spark.read.text(f"{tmp_out}/ann.json", lineSep="}").rdd.getNumPartitions() > 10
    got = sorted((x.split_name, x.id) for x in SRC.split_ids(spark, f"{tmp_out}/ids.json").collect())
    assert got == sorted((k, str(x)) for k, v in ids.items() for x in v)


def test_cut_or_misshapen_documents_raise(spark, tmp_out):
    good = json.dumps({"a": [{"id": "1"}, {"id": "2"}], "b": [{"id": "3"}]})
    bad = [good[:-1], good[:-2], good[:20], good + good, good + " x", "[" + good + "]", '{"a": {"id": "1"}}', '{"a": [{"id": }]}', '{"a": ["1]}']
    for i, text in enumerate(bad):
        with open(f"{tmp_out}/{i}.json", "w") as f:
            f.write(text)
        with pytest.raises(Exception):
            print(text, SRC.annotations_by_rater(spark, f"{tmp_out}/{i}.json").collect())
    for i, text in enumerate(['{"a": ["1", "2"]', '{"a": ["1", "2]}', '{"a": "1"}', '{"a": null}', '["a", "b"]']):
        with open(f"{tmp_out}/ids{i}.json", "w") as f:
            f.write(text)
        with pytest.raises(Exception):
            print(text, SRC.split_ids(spark, f"{tmp_out}/ids{i}.json").collect())
    os.makedirs(f"{tmp_out}/none")
    for i, text in enumerate(["{}", " { }\n", '{"a": []}', '{"a": [], "b": [ ]}\n', ""]):
        with open(f"{tmp_out}/none/{i}.json", "w") as f:
            f.write(text)
    assert SRC.annotations_by_rater(spark, f"{tmp_out}/none").count() == 0
    assert SRC.split_ids(spark, f"{tmp_out}/none").count() == 0


def test_written_documents_are_documents(spark, tmp_out):
    from pyspark.sql import functions as F
    df = spark.range(60).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('k"'), (F.col("id") % 3).cast("string")).alias("k"))
    D.write(df, "k", F.to_json(F.struct("id")), f"{tmp_out}/d", rows_per_document=25)
    import glob
    files = glob.glob(f"{tmp_out}/d/document=*/*.txt")
    assert len(files) == 3
    got = sorted((k, x["id"]) for f in files for k, v in json.load(open(f)).items() for x in v)
    assert got == sorted((f'k"{i % 3}', str(i)) for i in range(60))
    back = D.elements(spark, f"{tmp_out}/d", objects=True).collect()
    assert sorted((x.key, json.loads(x.element)["id"]) for x in back) == got


def test_elements_across_batches_and_one_shuffle_of_texts(spark, tmp_out, small_blocks):
    import re
    doc = {k: [{"id": f"{k}{i}", "text": "} , {" * (i % 4)} for i in range(9)] for k in ("a", "b", "c")}
    with open(f"{tmp_out}/d.json", "w") as f:
        json.dump(doc, f)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for size in (97, 1 << 20):
            blocks(spark, size)
            df = D.elements(spark, f"{tmp_out}/d.json", objects=True)
            assert sorted((r.key, json.loads(r.element)["id"]) for r in df.collect()) == sorted((k, x["id"]) for k, v in doc.items() for x in v)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # pieces stay where they are read, and an element moves once, to its block
    assert not re.findall(r"Exchange hashpartitioning\(file#\d+, element#", plan), plan
    assert len(re.findall(r"\+- Exchange hashpartitioning\(file#\d+, block#\d+L, \d+\)", plan)) == 3, plan
