"""Writers (K1–K7). Row data is written partitioned; only report tables are small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlab.functions import text as TX
from raterlab.operators.prompts import chat_jsonl
from raterlab.operators.splits import attach_split
from raterlab.schemas import ANNOTATION_RECORD
from raterlab.sources import documents


def annotation_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: one folder per (annotator, split). CSV output serialises the arrays as
    Python-literal text so that S2 reads them back."""
    out = df
    if fmt == "csv":
        out = (df.withColumn("context", TX.python_literal_list(F.col("context")))
                 .withColumn("context_locations", TX.spans_to_text(F.col("context_locations"))))
        (out.write.mode("overwrite").partitionBy("created_by", "split_name")
         .option("header", True).option("escape", '"').csv(path))
    else:
        out.write.mode("overwrite").partitionBy("created_by", "split_name").parquet(path)


def split_table(splits: DataFrame, path: str, refresh: bool = False) -> DataFrame:
    """K2: the split table is computed once and then reused (``ignore`` mode), as the
    original keeps its first split file; ``refresh=True`` recomputes it."""
    splits.write.mode("overwrite" if refresh else "ignore").parquet(path)
    return splits.sparkSession.read.parquet(path)


def split_ids_documents(splits: DataFrame, path: str, **kw) -> None:
    """K2: ``{split_name: [ids]}`` documents, which ``files.split_ids`` reads."""
    one = F.to_json(F.array(F.col("id").cast("string")))   # a list of one, without its brackets
    documents.write(splits, "split_name", F.regexp_replace(one, r"^\[|\]$", ""), path, **kw)


def publications_with_split(publications: DataFrame, splits: DataFrame, path: str) -> None:
    """K2: the publications as CSV with their ``split_name`` (empty without a split)."""
    (attach_split(publications, splits).write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def finetune_jsonl(examples: DataFrame, path: str) -> None:
    """K3: ``{"messages": [...]}`` lines per (persona, split)."""
    (examples.select("persona", "split_name", chat_jsonl(F.col("messages")).alias("value"))
     .write.mode("overwrite").partitionBy("persona", "split_name").text(path))


def results_json(results: DataFrame, path: str, mode: str = "append") -> None:
    """K4: result envelopes per (persona, approach, seed) as JSON lines; ``output``
    is written as a nested JSON value."""
    out = results.withColumn("output", F.parse_json("output"))
    out.write.mode(mode).partitionBy("persona", "approach", "seed").json(path)


#: What a bucket holds at most, about, if ``bucket_number`` chose their number; the fewest buckets, and Spark's most.
BUCKET_ROWS, BUCKET_BYTES = 20_000, 64 << 20
LEAST_BUCKETS, MOST_BUCKETS = 16, 100_000


def bucket_number(texts: DataFrame, text_col: str = "text") -> int:
    """Buckets for tables that meet ``texts`` by its key. A bucket is read, sorted and joined by one task, so their
    number grows with the rows and bytes of ``texts`` and a task's memory does not."""
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS), -(-size // BUCKET_BYTES)))


def bucketed_table(df: DataFrame, name: str, path: str, buckets: int, by: str = "id") -> DataFrame:
    """``df`` as a table clustered by ``by`` and sorted within its buckets: joins and aggregations of such tables on ``by``
    need no exchange. Rows are brought together once, here; each task writes the buckets it holds.
    A later session opens it with ``files.bucketed_table``."""
    (df.repartition(buckets, by).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


# header of the report file; fixed values
REPORT_HEADER = {"persona": "persona_name", "approach": "approach_name"}


def report_csv(report: DataFrame, path: str) -> None:
    """K6: a metric report (tens of rows) as one CSV file: the failed rate, persona and approach, then the metrics in their order."""
    lead = [c for c in ("failed", "persona", "approach") if c in report.columns]
    out = report.select(*[F.col(c).alias(REPORT_HEADER.get(c, c)) for c in lead],
                        *[F.col(f"`{c}`") for c in report.columns if c not in lead])
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def annotations_by_rater(df: DataFrame, path: str) -> None:
    """K7: flat annotations, one folder per annotator (JSON lines)."""
    df.write.mode("overwrite").partitionBy("created_by").json(path)


def annotations_documents(df: DataFrame, path: str, **kw) -> None:
    """K7: ``{annotator: [record, ...]}`` documents, which ``files.annotations_by_rater`` reads; locations are written as pairs."""
    pairs = F.transform("context_locations", lambda s: F.array(s["start"], s["end"])).alias("context_locations")
    record = F.struct(*[pairs if f == "context_locations" else F.col(f).cast("string").alias(f) if f in ("id", "trigger_level")
                        else F.col(f) for f in ANNOTATION_RECORD.names])
    documents.write(df, "created_by", F.to_json(record, {"ignoreNullFields": "false"}), path, **kw)
