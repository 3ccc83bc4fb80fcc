import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raterlab.operators import describe as DS
from raterlab.operators import ranks as R

SHARES = {"lo": 0.0, "a": 0.1, "b": 0.25, "m": 0.5, "c": 0.9, "hi": 1.0}


@pytest.mark.parametrize("cells", [1, 3, 1024])
def test_quantiles_equal_numpy(spark, cells):
    rng = np.random.default_rng(4)
    groups = {"wide": np.concatenate([rng.normal(size=300), [1e300, -1e300, 0.0]]), "ties": rng.integers(0, 4, 200).astype(float),
              "one": np.array([7.5]), "narrow": 1e6 + rng.random(100) * 1e-3, None: rng.random(51), "signs": -rng.random(40) ** 9}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("nothing", None), ("one", None)]
    got = R.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", SHARES, cells).collect()
    assert {r.g for r in got} == set(groups)
    for r in got:
        assert [r[n] for n in SHARES] == pytest.approx(np.quantile(groups[r.g], list(SHARES.values())).tolist(), rel=1e-12, abs=1e-300)


def test_positions_equal_a_window(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(x), int(n)) for g in ("a", None) for x, n in zip({*rng.normal(size=90) * 10.0 ** rng.integers(-9, 9, 90)}, rng.integers(0, 5, 90))]
    rows += [("a", v, 2) for v in (float("inf"), float("-inf"), float("nan"))]
    got = R.positions(spark.createDataFrame(rows, "g string, x double, n int"), ["g"], "x", ["n"], cells=5).collect()
    assert len(got) == len(rows)
    for r in got:
        below = [n for g, x, n in rows if g == r.g and (math.isnan(r.x) and not math.isnan(x) or x < r.x)]
        assert (r.before_n, r.total_n) == (sum(below), sum(n for g, _, n in rows if g == r.g))


def test_describe_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None), (None, 3.0)], "g string, x double")
    got = {r.g: r for r in DS.describe(df, ["g"], "x").collect()}
    assert (got["a"]["count"], got["a"].p25, got["a"].p50, got["b"]["count"], got["b"].p50, got[None].p75) == (2, 1.25, 1.5, 0, None, 3.0)
    box = DS.box_stats(df.filter("x is not null").unionByName(spark.createDataFrame([("a", 1.5)] * 30 + [("a", 90.0)], df.schema)), ["g"], "x")
    row = box.filter("g = 'a'").first()
    assert (row.n, row.n_outliers, row.whisker_low, row.whisker_high) == (33, 3, 1.5, 1.5)


def test_quantile_plans_hold_no_value_map_and_build_nothing(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 0.37).alias("x"))
    for out in (DS.describe(df, ["g"], "x"), DS.box_stats(df, ["g"], "x")):
        plan = out._jdf.queryExecution().toString()
        assert "percentile" not in plan and "ObjectHashAggregate" not in plan and "Scan ExistingRDD" not in plan
