"""Charts, run lengths and sequential tests against step-by-step loops and published values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gaugework.operators import charts as C
from gaugework.operators import run_length as L
from gaugework.operators import sequential as S


def series(spark, xs):
    return spark.createDataFrame([("s", i + 1, float(x)) for i, x in enumerate(xs)], "series string, ord long, x double")


def test_recursions_equal_loops(spark):
    rng = random.Random(1)
    xs = [rng.gauss(0.3, 1) for _ in range(200)]
    df = series(spark, xs).withColumn("mu", F.lit(0.0)).withColumn("sigma", F.lit(1.0))
    got = C.ewma(C.cusum(df, head_start=2.5)).orderBy("ord").collect()
    plus = minus = 2.5
    z = 0.0
    for x, r in zip(xs, got):
        plus, minus, z = max(0, plus + x - 0.5), max(0, minus - x - 0.5), 0.2 * x + 0.8 * z
        assert r["c_plus"] == pytest.approx(plus, abs=1e-9) and r["c_minus"] == pytest.approx(minus, abs=1e-9)
        assert r["ewma"] == pytest.approx(z, abs=1e-5)
    grown = C.e_detector(df).orderBy("ord").collect()
    m = 1.0
    for x, r in zip(xs, grown):
        m = max(1.0, m * math.exp(-0.5 * math.log(2) + x * x / 4))
        assert r["e_stat"] == pytest.approx(m, rel=1e-9)


def test_shewhart_rules(spark):
    df = series(spark, [57, 50, 55, 49, 54.5, 51, 51, 51, 51, 51, 51, 51, 51]).withColumn("mu", F.lit(50.0)).withColumn("sigma", F.lit(2.0))
    got = [r["rule"] for r in C.shewhart(df, rules=(1, 2, 4)).orderBy("ord").collect()]
    assert got[0] == 1 and got[4] == 2 and got[12] == 4 and got[1] is None


def test_non_finite_values_do_not_signal(spark):
    df = series(spark, [float("nan"), float("inf"), 0.0]).withColumn("mu", F.lit(0.0)).withColumn("sigma", F.lit(1.0))
    assert [r["z"] for r in C.shewhart(df).orderBy("ord").collect()] == [None, None, 0.0]


@pytest.mark.parametrize(("shift", "steps", "tol"), [(0.0, 465, 0.05), (0.5, 38, 0.05), (1.0, 10.4, 0.05)])
def test_cusum_run_length(shift, steps, tol):
    assert L.two_sided_cusum(0.5, 5.0, shift) == pytest.approx(steps, rel=tol)


def test_other_run_lengths():
    assert L.ewma(0.2, 2.962, 0.0) == pytest.approx(500, rel=0.1)
    assert L.shewhart(3.0) == pytest.approx(370.4, rel=0.01)


def test_wald_bounds():
    assert S.wald_bounds(0.05, 0.10) == pytest.approx((18.0, 0.10526), abs=1e-4)
    assert S.wald_bounds(0.05, 0.10, True) == pytest.approx((20.0, 0.10))
    with pytest.raises(ValueError):
        S.wald_bounds(0.6, 0.5)


def test_group_boundaries():
    assert S.group_bounds(5, 0.05, "obf") == pytest.approx([4.5617, 3.2256, 2.6337, 2.2809, 2.0401], abs=0.02)
    for k, c in zip((2, 3, 4, 5), (2.1783, 2.2895, 2.3613, 2.4132)):
        assert S.group_constant(k, 0.05, "pocock") == pytest.approx(c, abs=0.01)


def test_stopping_by_width():
    assert [S.stop_by_width(h) for h in (0.15, 0.10, 0.05, 0.02)] == [121, 293, 1319, 9469]


def test_boosted_equals_loop(spark):
    rng = random.Random(4)
    xs = [float(rng.random() < 0.6) for _ in range(150)]
    got = S.sprt_boosted(series(spark, xs), S.llr_bernoulli(F.col("x"), 0.4, 0.6), 0.05).orderBy("ord").collect()
    m = 0.0
    for x, r in zip(xs, got):
        m = min(math.log(20), m + (math.log(1.5) if x else -math.log(1.5)))
        assert r["log_m"] == pytest.approx(m, abs=1e-9)


def test_coverage_of_the_confidence_sequence(spark):
    """200 observations, p = .3; every look of 300 series at once."""
    rows = spark.range(300).select(F.col("id").cast("string").alias("series"), F.explode(F.sequence(F.lit(1), F.lit(200))).alias("ord"))
    from gaugework.functions import rng

    rows = rows.withColumn("x", (rng.uniform("cover", F.col("series"), F.col("ord")) < 0.3).cast("double"))
    d = S.anytime(rows, theta0=0.3).groupBy("series").agg(F.max(((F.col("lower") > 0.3) | (F.col("upper") < 0.3)).cast("int")).alias("missed"))
    assert d.agg(F.avg("missed")).first()[0] <= 0.07


def test_ewma_of_long_series_and_small_weights(spark):
    from gaugework.operators import charts

    rng = random.Random(8)
    xs = [rng.gauss(1, 1) for _ in range(3000)]
    df = spark.createDataFrame([("s", i + 1, x, 0.0, 1.0) for i, x in enumerate(xs)], "series string, ord long, x double, mu double, sigma double")
    for lam in (0.002, 0.01, 0.2, 0.9, 1.0):
        z, want = 0.0, []
        for x in xs:
            z = lam * x + (1 - lam) * z
            want.append(z)
        got = [r["ewma"] for r in charts.ewma(df, lam=lam).orderBy("ord").collect()]
        assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9
