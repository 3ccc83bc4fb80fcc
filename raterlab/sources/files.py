"""Readers for the file formats of the annotation / scoring workflow.

All readers declare their schema; nothing is inferred. Persona and template
dictionaries (configuration-sized) are read with ``wholetext`` and parsed with
``from_json``. ``{annotator: [records]}`` and the split-id map grow with the corpus:
``documents`` reads them by many tasks. Row data is read as CSV / JSON lines /
parquet, which split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raterlab import schemas as S
from raterlab.functions import text as TX
from raterlab.session import read_if_exists
from raterlab.sources import documents


def bucketed_table(spark: SparkSession, name: str, path: str, schema: str, buckets: int, by: str = "id") -> DataFrame:
    """Opens files that ``sinks.bucketed_table`` wrote as the table ``name``, with their buckets."""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under ``path`` (folder names ``column=value`` become columns); a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_quarantined(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): the lines that hold a whole record of ``schema``, and the others as (file, line) with the columns of
    their folder names, to be counted, kept and mended. Blank lines are neither."""
    corrupt = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    lines = lines.filter(F.length(F.trim("value")) > 0).withColumn("file", F.input_file_name())
    lines = lines.withColumn("_r", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}))
    # text that is no JSON object has no record at all
    bad = F.col("_r").isNull() | F.col("_r._line").isNotNull()
    rows = lines.filter(~bad).select(*[F.col("_r").getField(f.name).alias(f.name) for f in schema.fields], *folders)
    return rows, lines.filter(bad).select("file", *folders, F.col("value").alias("line"))


def publications_csv(spark: SparkSession, path: str, schema: T.StructType = S.PUBLICATIONS,
                     optional: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> DataFrame:
    """Publications CSV (texts hold newlines and doubled quotes). Columns are taken by
    their header name: order and further columns don't matter, a missing one raises
    (``optional`` ones are null, ``kept`` ones stay if they are there), and so does a line with another number of fields or a file
    with another header than the first."""
    reader = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
              .option("mode", "FAILFAST").option("columnPruning", False))
    names = reader.csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if set(missing) - set(optional):
        raise ValueError(f"{path}: columns {missing} are missing; the header has {names}")
    found = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = reader.schema(found).option("enforceSchema", False).csv(path)
    extra = [n for n in kept if n in names]
    return df.select(*extra, *[(F.lit(None) if f.name in missing else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def annotation_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-annotator split CSV whose ``context`` / ``context_locations`` are
    Python-literal text; returned as typed arrays (F3). Not sorted: metrics join by id."""
    # the partitioned layout (K1) keeps the rater and the split in folder names
    df = publications_csv(spark, path, S.FLAT_ANNOTATION_TEXT, optional=("created_by",), kept=("split_name",))

    def parsed(name, parse):
        # text that is no literal raises: read as null it would pass for an empty list
        value = parse(F.col(name))  # what no literal at all is, is null
        return F.when(F.col(name).isNotNull() & value.isNull(), F.raise_error(
            F.concat(F.lit(f"{name} is no list literal: "), F.substring(name, 1, 200)))).otherwise(value)
    return (df.withColumn("context", parsed("context", TX.parse_python_literal))
              .withColumn("context_locations", parsed("context_locations", TX.parse_python_spans)))


def prediction_schema() -> T.StructType:
    """The fields of a result line; persona, approach and seed come from folder or file names."""
    return T.StructType([f for f in S.PREDICTION_ENVELOPE.fields if f.name != "seed"])


def predictions(spark: SparkSession, root: str, expected_rows: int | None = None) -> DataFrame:
    """S3: result envelopes under ``root/persona=/approach=/seed=`` (JSON lines).
    ``output`` stays raw JSON text. A malformed line raises (``json_lines_quarantined`` sets
    such lines aside). With ``expected_rows``, every run is checked."""
    df = json_lines(spark, root, prediction_schema())
    if expected_rows is not None:
        bad = (df.groupBy("persona", "approach", "seed").count()
               .filter(F.col("count") != expected_rows).limit(20).collect())
        if bad:
            raise ValueError(f"runs with a row count other than {expected_rows}: {bad}")
    return df


def _whole_json(spark: SparkSession, path: str, ddl: str | T.DataType) -> DataFrame:
    # a malformed document raises
    return spark.read.text(path, wholetext=True).select(F.from_json("value", ddl, {"mode": "FAILFAST"}).alias("doc"))


def annotations_by_rater(spark: SparkSession, path: str) -> DataFrame:
    """``{annotator: [record, ...]}`` → one long row per record with ``created_by``.
    ``context_locations`` pairs become ``struct<start,end>``. One big document is read by many tasks."""
    x = documents.elements(spark, path, objects=True)
    x = x.select(F.col("key").alias("annotator"), F.from_json("element", S.ANNOTATION_RECORD, {"mode": "FAILFAST"}).alias("r"))
    x = x.select("annotator", "r.*")
    return x.withColumn("context_locations", F.transform(
        "context_locations", lambda p: F.struct(p[0].alias("start"), p[1].alias("end"))))


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """``{"ft_training": [ids], ...}`` → ``(id, split_name)``; one big document is read by many tasks."""
    x = documents.elements(spark, path, objects=False)
    one = F.from_json(F.concat(F.lit("["), F.col("element"), F.lit("]")), "array<string>", {"mode": "FAILFAST"})
    return x.select(one[0].alias("id"), F.col("key").alias("split_name"))


def personas_dict(spark: SparkSession, path: str) -> DataFrame:
    """``{persona: narrative}`` → ``(persona, narrative)``."""
    doc = _whole_json(spark, path, "map<string,string>")
    return doc.select(F.explode("doc").alias("persona", "narrative"))


def prompt_template(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """A chat template ``[{role, content}, ...]`` (a few KB) as (role, content) pairs."""
    messages = _whole_json(spark, path, S.MESSAGES).first()["doc"]
    return [(m["role"], m["content"]) for m in messages]


def chat_examples(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines chat examples ``{"messages": [...]}``, with the file position
    (``pos``) needed for "first N examples" semantics. ``pos`` increases with the line
    order inside a file split; example files are far below one split (128 MB), so it
    is the line order of the file."""
    df = json_lines(spark, path, S.CHAT_EXAMPLE)
    return df.withColumn("_file", F.input_file_name()).withColumn("pos", F.monotonically_increasing_id())


def few_shot_examples(spark: SparkSession, path: str) -> DataFrame:
    """S8 for few-shot files ``{persona}_fs_training.jsonl`` (or folders ``persona=``): (persona, pos, input, output) of
    each line's first two messages. A line with fewer messages raises."""
    df = chat_examples(spark, path)
    if "persona" not in df.columns:
        df = df.withColumn("persona", F.regexp_extract("_file", r"([^/]+)_fs_training\.jsonl$", 1))
    two = F.when(F.size("messages") >= 2, F.col("messages")).otherwise(
        F.raise_error(F.concat(F.lit("an example without two messages: "), F.col("_file"))))
    return df.select("persona", "pos", two[0]["content"].alias("input"), two[1]["content"].alias("output"))


def descriptions_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """Optional per-annotator description file; ``None`` when absent. ``pos``
    (line order within a file split) drives the keep-first de-duplication (D1)."""
    return read_if_exists(
        lambda: publications_csv(spark, path, S.DESCRIPTIONS).withColumn("pos", F.monotonically_increasing_id()))


def export_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Exported annotation rows (JSON lines, or one JSON array with ``multiline``)."""
    return spark.read.schema(S.EXPORT).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def _approach_pattern(approaches) -> str:
    return "|".join(sorted(approaches, key=len, reverse=True))


def predictions_flat(spark: SparkSession, path: str, approaches=None) -> DataFrame:
    """S3 for the flat naming ``{persona}_{approach}_seed={seed}.jsonl`` (result and
    backup logs alike): persona, approach and seed are taken from the file name."""
    from raterlab import constants as C
    appr = _approach_pattern(approaches or C.APPROACHES)
    rx = rf"([^/]+)_({appr})_seed=([0-9]+)\.jsonl$"
    df = json_lines(spark, path, prediction_schema()).withColumn("_f", F.input_file_name())
    return df.select(F.regexp_extract("_f", rx, 1).alias("persona"), F.regexp_extract("_f", rx, 2).alias("approach"),
                     F.regexp_extract("_f", rx, 3).cast("int").alias("seed"), *[c for c in df.columns if c != "_f"])


def annotation_splits_flat(spark: SparkSession, path: str, splits=("ft_training", "ft_validation", "evaluation")) -> DataFrame:
    """S2 for the flat naming ``{annotator}_{split}.csv``."""
    rx = rf"([^/_]+)_({'|'.join(splits)})\.csv$"
    df = annotation_split_csv(spark, path).withColumn("_f", F.input_file_name())
    return df.withColumn("split_name", F.regexp_extract("_f", rx, 2)).drop("_f")
