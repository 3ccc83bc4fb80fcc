"""J9 idempotence, D2, L6 fallback, T1 stream = batch."""
import os

from pyspark.sql import functions as F

from raterlab.operators import prompts as PR
from raterlab.operators import scoring as SC
from raterlab.streaming import incremental as INC


def personas(spark):
    return spark.createDataFrame([("persona_1", "n1"), ("persona_2", "n2")], "persona string, narrative string")


def pubs(spark, ids):
    return spark.createDataFrame([(i, "word " * (i % 17 + 1), f"2024-01-{i % 28 + 1:02d}") for i in ids],
                                 "id long, text string, date string")


def todo_frame(grid):
    return grid.select(*SC.KEY, PR.zero_shot_messages(F.col("narrative"), F.col("text")).alias("messages"))


def test_scoring_twice_adds_nothing(spark, tmp_out):
    path = os.path.join(tmp_out, "res")
    grid = SC.work_grid(pubs(spark, range(40)), personas(spark), "context_zero_shot", [7, 33])
    todo = SC.pending(grid, None)
    SC.append_results(SC.run_scorer(todo_frame(todo), SC.length_scorer), path)
    first = spark.read.parquet(path).count()
    again = SC.pending(grid, spark.read.parquet(path))
    assert again.count() == 0
    SC.append_results(SC.run_scorer(todo_frame(again), SC.length_scorer), path)
    assert spark.read.parquet(path).count() == first == 40 * 2 * 2


def test_scorer_failure_becomes_record(spark):
    grid = SC.work_grid(pubs(spark, range(5)), personas(spark), "a", [7])

    def boom(m, b):
        raise RuntimeError("service down")
    res = SC.run_scorer(todo_frame(grid), boom).collect()
    assert len(res) == 10 and all(r.output == '{"response": "failed to generate"}' for r in res)


def test_latest_per_key(spark):
    log = spark.createDataFrame([("p", "a", 7, 1, 1, "old"), ("p", "a", 7, 1, 2, "new"), ("p", "a", 7, 2, 1, "only")],
                                "persona string, approach string, seed int, id long, ingest_ts long, output string")
    got = {r.id: r.output for r in SC.latest(log).collect()}
    assert got == {1: "new", 2: "only"}


def test_stream_equals_batch(spark, tmp_out):
    ids = list(range(60))
    src, res, ck = (os.path.join(tmp_out, x) for x in ("src", "res", "ck"))
    p = pubs(spark, ids)
    for i, (lo, hi) in enumerate([(0, 20), (10, 40), (40, 60), (40, 60)]):   # overlaps and a replay
        p.filter((F.col("id") >= lo) & (F.col("id") < hi)).write.parquet(f"{src}/drop={i}")
        INC.run_until_idle(INC.start(spark, src, "id bigint, text string, date string", personas(spark), res, ck, scorer=SC.length_scorer))
    stream = spark.read.parquet(res).select(*SC.KEY, "output")
    batch = SC.run_scorer(todo_frame(SC.work_grid(p, personas(spark), "context_zero_shot")), SC.length_scorer)
    assert stream.count() == 60 * 2 * 3
    assert stream.exceptAll(batch.select(*SC.KEY, "output")).count() == 0


def test_model_name_per_persona(spark):
    grid = SC.work_grid(pubs(spark, range(3)), personas(spark), "context_fine_tuning", [7])
    res = SC.run_scorer(todo_frame(grid), SC.length_scorer, model_name={"persona_1": "m1", "persona_2": "m2"})
    assert {(r.persona, r.model_name) for r in res.collect()} == {("persona_1", "m1"), ("persona_2", "m2")}


def test_stream_validation_equals_batch(spark, tmp_out):
    from conftest import SF_SMALL
    from raterlab.operators import validate as V
    from raterlab.plans import fixtures as X
    from raterlab.sources import files as SRC
    from raterlab.sources import sinks as SNK
    preds = X.predictions(spark, SF_SMALL).withColumn("id", F.col("id").cast("string"))
    pubs = X.publications(spark, SF_SMALL).withColumn("id", F.col("id").cast("string"))
    src, out, ck = (os.path.join(tmp_out, x) for x in ("preds", "valid", "ck"))
    # two drops: the no-context runs first, the rest later
    SNK.results_json(preds.filter(F.col("approach") == "no_context"), src)
    INC.run_until_idle(INC.start_validation(spark, src, pubs, out, ck))
    SNK.results_json(preds.filter(F.col("approach") != "no_context"), src)
    INC.run_until_idle(INC.start_validation(spark, src, pubs, out, ck))
    cols = ["persona", "approach", "seed", "id", "emotion", "emotion_class", "trigger_level", "failed"]
    streamed = spark.read.parquet(out).select(*cols)
    batch = V.validate_predictions(SRC.predictions(spark, src), pubs).select(*cols)
    assert streamed.count() == preds.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_only_the_failing_row_fails(spark):
    from raterlab import constants as C
    rows = spark.createDataFrame([("p", "context_zero_shot", 1, i, [("user", f"text {i}")]) for i in range(50)],
                                 "persona string, approach string, seed int, id long, messages array<struct<role:string,content:string>>")

    def scorer(messages, batch):
        if (batch["id"] == 17).any():
            raise RuntimeError("one bad call")
        return ['{"emotion": "joy"}'] * len(batch)
    out = {r.id: r.output for r in SC.run_scorer(rows.coalesce(1), scorer).collect()}
    assert len(out) == 50 and [i for i, o in out.items() if o == C.FAILED_OUTPUT_JSON] == [17]


def test_written_predictions_are_dealt_to_as_many_tasks_as_asked(spark):
    from conftest import SF_SMALL
    from raterlab.plans import fixtures as X
    few, many = X.predictions(spark, SF_SMALL), X.predictions(spark, SF_SMALL, tasks=12)
    # the writer has one task for each
    assert many.rdd.getNumPartitions() == 12 > few.rdd.getNumPartitions()
    assert many.exceptAll(few).count() == 0 and many.count() == few.count()
