"""Declared schemas (no inference anywhere)."""

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType())])
SPANS = T.ArrayType(SPAN)
MESSAGE = T.StructType([T.StructField("role", T.StringType()),
                        T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)

PUBLICATIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("date", T.StringType()),
])

# flat annotation as kept in split files (context columns are JSON / Python-literal text)
FLAT_ANNOTATION_TEXT = T.StructType([
    T.StructField("emotion", T.StringType()),
    T.StructField("emotion_class", T.StringType()),
    T.StructField("trigger_level", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("context_locations", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("id", T.StringType()),
])

ANNOTATION_RECORD = T.StructType([
    T.StructField("emotion", T.StringType()),
    T.StructField("emotion_class", T.StringType()),
    T.StructField("trigger_level", T.StringType()),
    T.StructField("context", T.ArrayType(T.StringType())),
    T.StructField("context_locations", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("id", T.StringType()),
])
_CLASSIFICATION = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("checklist_answers", T.ArrayType(T.StructType([T.StructField("value", T.StringType())]))),
    T.StructField("radio_answer", T.StructType([T.StructField("value", T.StringType())])),
    T.StructField("text_answer", T.StructType([T.StructField("content", T.StringType())])),
])
_OBJECT = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("token", T.StringType()),
    ])),
])
EXPORT_LABEL = T.StructType([
    T.StructField("label_details", T.StructType([
        T.StructField("created_by", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ])),
    T.StructField("annotations", T.StructType([
        T.StructField("classifications", T.ArrayType(_CLASSIFICATION)),
        T.StructField("objects", T.ArrayType(_OBJECT)),
    ])),
])
EXPORT = T.StructType([
    T.StructField("projects", T.MapType(T.StringType(), T.StructType([
        T.StructField("labels", T.ArrayType(EXPORT_LABEL))]))),
    T.StructField("data_row", T.StructType([
        T.StructField("row_data", T.StringType()),
        T.StructField("global_key", T.StringType()),
    ])),
])

CHAT_EXAMPLE = T.StructType([T.StructField("messages", MESSAGES)])

PREDICTION_ENVELOPE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("seed", T.IntegerType()),
    # free-form JSON kept as text; parsed with try_parse_json downstream
    T.StructField("output", T.StringType()),
])

DESCRIPTIONS = T.StructType([T.StructField("id", T.StringType()),
                             T.StructField("description", T.StringType())])
