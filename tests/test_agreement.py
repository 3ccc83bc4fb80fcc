"""A16–A19 against brute force, plus tails."""
import math
import random

import pytest
from pyspark.sql import functions as F

from raterlab.operators import agreement as AG
from raterlab.operators import hypothesis as HY


def crosstab(spark, pairs):
    df = spark.createDataFrame(pairs, "a_x string, b_x string")
    return AG.crosstab_long(df, ["x"])


def chi2_brute(pairs):
    rows = sorted({a for a, _ in pairs})
    cols = sorted({b for _, b in pairs})
    n = len(pairs)
    obs = {(a, b): 0 for a in rows for b in cols}
    for p in pairs:
        obs[p] += 1
    r = {a: sum(obs[(a, b)] for b in cols) for a in rows}
    c = {b: sum(obs[(a, b)] for a in rows) for b in cols}
    dof = (len(rows) - 1) * (len(cols) - 1)
    if dof == 0:
        return 0.0, 0
    stat = 0.0
    for a in rows:
        for b in cols:
            e = r[a] * c[b] / n
            d = abs(obs[(a, b)] - e)
            if dof == 1:
                d -= min(0.5, d)
            stat += d * d / e
    return stat, dof


@pytest.mark.parametrize("k,seed", [(2, 1), (2, 2), (3, 3), (5, 4)])
def test_chi2_matches_grid(spark, k, seed):
    rng = random.Random(seed)
    labs = [str(i) for i in range(k)]
    pairs = [(rng.choice(labs), rng.choice(labs[:max(2, k - 1)])) for _ in range(80)]
    got = AG.chi2_statistic(crosstab(spark, pairs)).collect()[0]
    stat, dof = chi2_brute(pairs)
    assert got.dof == dof
    assert got.chi2 == pytest.approx(stat, abs=1e-9)


def test_chi2_small_deviation_is_zero(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 5 + [("b", "a")] * 5 + [("b", "b")] * 6
    got = AG.chi2_statistic(crosstab(spark, pairs)).collect()[0]
    assert got.chi2 == 0.0


def test_kappa(spark):
    same = [(x, x) for x in "aabbbc"]
    assert AG.cohen_kappa(crosstab(spark, same)).collect()[0].kappa == pytest.approx(1.0)
    const = [("a", "a")] * 4
    assert AG.cohen_kappa(crosstab(spark, const)).collect()[0].kappa is None
    rng = random.Random(5)
    pairs = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(50)]
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    labs = set("abcd")
    pe = sum(sum(a == lab for a, _ in pairs) * sum(b == lab for _, b in pairs) for lab in labs) / n / n
    assert AG.cohen_kappa(crosstab(spark, pairs)).collect()[0].kappa == pytest.approx((po - pe) / (1 - pe))


def test_mann_whitney_pairwise(spark):
    rng = random.Random(7)
    a = [rng.randint(1, 6) for _ in range(40)]
    b = [rng.randint(2, 7) for _ in range(55)]
    rows = [("t", "a", float(x)) for x in a] + [("t", "b", float(x)) for x in b]
    df = spark.createDataFrame(rows, "test string, side string, x double")
    got = HY.with_mann_whitney_p(HY.mann_whitney(df, "test", "side", "x", cells=3)).collect()[0]
    u1 = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got.u1 == pytest.approx(u1)
    n1, n2, n = len(a), len(b), len(a) + len(b)
    counts = {}
    for v in a + b:
        counts[v] = counts.get(v, 0) + 1
    tie = sum(t ** 3 - t for t in counts.values())
    u = max(u1, n1 * n2 - u1)
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1))))
    z = (u - n1 * n2 / 2 - 0.5) / sigma
    assert got.z == pytest.approx(z)
    assert got.p_value == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))))


def test_tails(spark):
    x, dofs = 3.7, (1, 2, 3, 4, 5, 36)
    cases = [(x, d) for d in dofs] + [(0.0, 3), (5.0, 0), (None, 1), (3.7, None), (float("nan"), 2)]
    df = spark.createDataFrame([(i, a, d) for i, (a, d) in enumerate(cases)], "i int, x double, dof long")
    got = [r.p for r in df.select("i", HY.chi2_sf(F.col("x"), F.col("dof")).alias("p")).orderBy("i").collect()]
    for dof, p in zip(dofs, got):
        # numeric integration of the density above x; its root singularity at 0 lies outside
        k = dof / 2
        dens = lambda t: t ** (k - 1) * math.exp(-t / 2) / (2 ** k * math.gamma(k))
        h, tail, t = 0.001, 0.0, x
        while t < x + 400:
            tail += (dens(t) + 4 * dens(t + h / 2) + dens(t + h)) * h / 6
            t += h
        assert p == pytest.approx(tail, rel=1e-6)
    assert got[6:8] == [1.0, 1.0] and got[8:10] == [None, None] and math.isnan(got[10])

    zs = [-1.0, 0.0, 0.3, 1.959963984540054, 2.8, 2.9, 5.0, 12.0]
    df = spark.createDataFrame([(z,) for z in zs] + [(None,), (float("nan"),)], "z double")
    got = [r.p for r in df.select(HY.normal_two_sided(F.col("z")).alias("p")).collect()]
    assert got[:8] == pytest.approx([min(1.0, math.erfc(z / math.sqrt(2))) for z in zs], rel=1e-10)
    assert got[8] is None and math.isnan(got[9])


def test_normality_closed_form(spark):
    rng = random.Random(3)
    xs = [rng.gauss(0, 1) ** 2 for _ in range(200)]
    df = spark.createDataFrame([("g", x) for x in xs], "g string, x double")
    got = HY.normality_k2(df, ["g"], "x").collect()[0]
    n = len(xs)
    mu = sum(xs) / n
    m2 = sum((x - mu) ** 2 for x in xs) / n
    m3 = sum((x - mu) ** 3 for x in xs) / n
    m4 = sum((x - mu) ** 4 for x in xs) / n
    assert got.skew == pytest.approx(m3 / m2 ** 1.5)
    assert got.kurt == pytest.approx(m4 / m2 ** 2 - 3)
    assert got.k2 > 20 and got.p_value < 1e-4   # strongly skewed sample


def test_an_item_labelled_twice_by_one_rater_raises(spark):
    import pytest
    from raterlab.operators import agreement as AG
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 1, "z"), ("a", 2, "x")], "created_by string, id int, emotion string")
    with pytest.raises(Exception, match="labelled twice"):
        AG.pair_raters(df, "a", "b", ["emotion"]).collect()
    one = AG.pair_raters(df.filter("emotion <> 'z'"), "a", "b", ["emotion"]).collect()
    assert [tuple(r) for r in one] == [(1, "x", "y")]
