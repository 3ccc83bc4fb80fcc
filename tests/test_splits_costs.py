"""O1, J8, D1, A25–A27."""
import random

import numpy as np
import pytest

from raterlab.operators import annotations as AN
from raterlab.operators import costs as CS
from raterlab.operators import splits as SP


def pubs(spark, n, null_every=0):
    rows = []
    for i in range(n):
        d = None if null_every and i % null_every == 0 else f"2024-01-{(i % 5) + 1:02d}"
        rows.append((i, "t", d))
    return spark.createDataFrame(rows, "id long, text string, date string")


def test_split_sizes_and_ties(spark):
    p = pubs(spark, 120, null_every=7)
    s = {r.id: r.split_name for r in SP.date_split(p).collect()}
    assert sum(v == "ft_training" for v in s.values()) == 50
    assert sum(v == "ft_validation" for v in s.values()) == 20
    assert sum(v == "evaluation" for v in s.values()) == 50
    # nulls last, ties broken by id: the first training rows are the smallest ids of the earliest date
    first = sorted(i for i in range(120) if i % 7 and (i % 5) == 0)[:5]
    assert all(s[i] == "ft_training" for i in first)
    assert all(s[i] == "evaluation" for i in range(0, 120, 7))
    ev = SP.in_date_split(p, p, "evaluation").count()
    assert ev == 50


def test_fewer_than_head(spark):
    s = SP.date_split(pubs(spark, 30)).collect()
    assert not any(r.split_name == "evaluation" for r in s)


def test_missing_and_duplicates(spark):
    splits = spark.createDataFrame([(1, "evaluation"), (2, "evaluation"), (3, "ft_training")], "id long, split_name string")
    ann = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 1), ("b", 3)], "created_by string, id long")
    miss = [(r.created_by, r.id) for r in SP.missing_annotations(splits, ann, ann).collect()]
    assert miss == [("b", 2)]
    dup = [(r.created_by, r.id) for r in SP.duplicate_annotations(ann).collect()]
    assert dup == [("b", 1)]
    with pytest.raises(ValueError):
        SP.assert_complete(SP.missing_annotations(splits, ann, ann), SP.duplicate_annotations(ann))


def test_first_description_skips_nulls(spark):
    d = spark.createDataFrame([(1, 0, None), (1, 1, "x"), (1, 2, "y"), (2, 0, None)], "id long, pos long, description string")
    a = spark.createDataFrame([(1, "own1"), (2, "own2"), (3, None)], "id long, description string")
    got = {r.id: r.description for r in AN.override_descriptions(a, d).collect()}
    assert got == {1: "x", 2: "own2", 3: None}
    assert AN.override_descriptions(a, None) is a


@pytest.mark.parametrize("n,epochs", [(16, 3), (17, 3), (66, 3), (67, 2), (10, 5)])
def test_epoch_rule(spark, n, epochs):
    stats = spark.createDataFrame([(i, 100) for i in range(n)], "conv_id long, n_tokens long")
    r = CS.billing_estimate(stats).collect()[0]
    assert r.n_epochs == epochs
    assert r.billing_tokens == 100 * n
    assert r.charged_price == pytest.approx(100 * n * 8 / 1e6)


def test_distribution_quantiles(spark):
    rng = random.Random(2)
    vals = [rng.randint(1, 500) for _ in range(101)]
    stats = spark.createDataFrame([(i, v, v, v) for i, v in enumerate(vals)],
                                  "conv_id long, n_messages long, n_tokens long, n_assistant_tokens long")
    r = {x.name: x for x in CS.distribution(stats).collect()}["n_tokens"]
    assert r.p10 == pytest.approx(float(np.quantile(vals, 0.1)))
    assert r.p90 == pytest.approx(float(np.quantile(vals, 0.9)))
    assert r.median == pytest.approx(float(np.median(vals)))


def test_example_stats(spark):
    turns = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "user", "Hi, you!"), (1, 2, "assistant", "ok"),
                                   (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    s = {r.conv_id: r for r in CS.example_stats(turns).collect()}
    # per message 3 + role (1 token) + content: Be brief . | Hi , you ! | ok  → 3 + 4 + 1; + 3 priming
    assert s[1].n_tokens == 3 * 3 + 3 * 1 + (3 + 4 + 1) + 3
    assert s[1].n_assistant_tokens == 1 and s[2].has_user == 0
    q = CS.chat_quality(CS.example_stats(turns)).collect()[0]
    assert (q.n_missing_system, q.n_missing_user) == (1, 1)


def test_pluggable_tokenizer(spark):
    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf(T.LongType())
    def chars(s: pd.Series) -> pd.Series:
        return s.fillna("").str.len().astype("int64")

    turns = spark.createDataFrame([(1, 0, "user", "abcd"), (1, 1, "assistant", "xy")],
                                  "conv_id long, turn long, role string, text string")
    r = CS.example_stats(turns, tok=chars).collect()[0]
    assert r.n_tokens == (3 + 4 + 4) + (3 + 9 + 2) + 3 and r.n_assistant_tokens == 2


def test_empty_chat_set(spark):
    stats = spark.createDataFrame([], "conv_id long, n_tokens long")
    r = CS.billing_estimate(stats).collect()[0]
    assert r.n_examples == 0 and r.n_epochs is None
