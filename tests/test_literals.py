"""F3 and V3 against Python's own semantics on randomised inputs (one Spark job each)."""
import ast
import json
import random

from pyspark.sql import functions as F

from raterlab.functions import text as TX
from raterlab.operators import validate as V

ALPHABET = ["a", "b", "Z", " ", "'", '"', "\\", "\n", "\t", "é", "ß", "Мир", "中", "\xa0", "x1", ",", "[", "]", "(", ")"]


def rand_list(rng):
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 4))]


def test_python_list_literals_roundtrip(spark):
    rng = random.Random(11)
    lists = [rand_list(rng) for _ in range(300)]
    texts = [repr(x) for x in lists]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: r.p for r in df.select("i", TX.parse_python_list(F.col("s")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ast.literal_eval(t), t


def test_invalid_literals_are_null(spark):
    bad = ["bare phrase", "['unterminated", "[1, 2", "", "{'a': 1}"]
    df = spark.createDataFrame([(b,) for b in bad], "s string")
    got = [r.p for r in df.select(TX.parse_python_list(F.col("s")).alias("p")).collect()]
    assert got[:4] == [None] * 4


def py_level(v):
    try:
        return int(v)
    except Exception:
        return -1


def test_lenient_level_matches_python_int(spark):
    vals = [0, 1, -2, 5, 3.0, 3.99, -1.5, "4", "-3", "+2", " 7 ", "3.0", "abc", "", None, True, False, [2], {"a": 1}]
    rows = [(i, "t", json.dumps({"trigger_level": v})) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "id long, text string, output string")
    got = {r.id: r.trigger_level for r in V.validate_output(df).collect()}
    for i, v in enumerate(vals):
        assert got[i] == py_level(v), (v, got[i])


def test_control_characters_survive(spark):
    import json
    from pyspark.sql import functions as F
    from raterlab.functions import text as TX
    words = ["ok", "a\x0bb", "\x00\x1f\n\t'\"\\", "é 🙂"]
    df = spark.createDataFrame([(words,)], "w array<string>")
    row = df.select(TX.json_string_array(F.col("w")).alias("j"), TX.parse_python_list(TX.python_literal_list(F.col("w"))).alias("p")).first()
    assert json.loads(row.j) == words and list(row.p) == words
