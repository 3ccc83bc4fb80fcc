"""Incremental scoring of newly arriving publications.

Structured Streaming file source → ``foreachBatch``: build the work grid for the
new rows, drop what the result table already holds (left-anti on the full key),
score the rest and append. The result table is the state, so a replayed or
duplicated batch adds nothing; the stream checkpoint replaces the append log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raterlab import constants as C
from raterlab.operators import prompts as P
from raterlab.operators import scoring as SC
from raterlab.session import read_if_exists


def _read_results(spark: SparkSession, path: str) -> DataFrame | None:
    return read_if_exists(lambda: spark.read.parquet(path))


def start(spark: SparkSession, source_dir: str, source_schema: str, personas: DataFrame, result_path: str,
          checkpoint_dir: str, scorer, approach: str = "context_zero_shot",
          seeds: Sequence[int] = C.SEEDS, available_now: bool = True) -> StreamingQuery:
    """Start the incremental job over parquet drops in ``source_dir``."""
    stream = spark.readStream.schema(source_schema).parquet(source_dir)

    def each(batch: DataFrame, epoch_id: int) -> None:
        # keys alone meet the results: of these only this approach's folders and the key columns are read
        pubs = batch.dropDuplicates(["id"])
        done = _read_results(spark, result_path)
        if done is not None:
            done = done.filter(F.col("approach") == approach).filter(F.col("seed").isin(*seeds)).select(*SC.KEY)
            done = done.join(pubs.select("id"), "id", "left_semi")
        todo = SC.pending_with_texts(pubs, personas, approach, seeds, done).select(*SC.KEY, P.zero_shot_messages(F.col("narrative"), F.col("text")).alias("messages"))
        SC.append_results(SC.run_scorer(todo, scorer), result_path)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def run_until_idle(q: StreamingQuery, timeout_s: float | None = None) -> None:
    """Block until an ``availableNow`` query has consumed everything."""
    q.awaitTermination(timeout_s)


def start_validation(spark: SparkSession, predictions_dir: str, publications: DataFrame, out_dir: str,
                     checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Validate prediction envelopes as their files land (JSON lines under
    ``persona=/approach=/seed=``): stream-static join with the publication text (J2),
    V1–V7 as stateless projections, appended to a partitioned parquet table. The
    file sink plus the checkpoint give exactly-once output."""
    from pyspark.sql import types as T

    from raterlab import schemas as S
    from raterlab.operators import validate as V
    # persona / approach / seed come from the folder names
    schema = T.StructType([f for f in S.PREDICTION_ENVELOPE.fields if f.name != "seed"]
                          + [T.StructField("persona", T.StringType()), T.StructField("approach", T.StringType()),
                             T.StructField("seed", T.IntegerType())])
    stream = spark.readStream.schema(schema).option("basePath", predictions_dir).json(predictions_dir)
    valid = V.validate_predictions(stream, publications)
    w = (valid.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
         .partitionBy("persona", "approach", "seed").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
