"""Known indices of test functions, and designs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import designs as D
from gaugework.operators import sensitivity as S


def test_sobol_sequence(spark):
    rows = D.sobol(spark, 8, 2).orderBy("id").collect()
    assert [r["x0"] for r in rows] == [0, 0.5, 0.75, 0.25, 0.375, 0.875, 0.625, 0.125]
    assert [r["x1"] for r in rows] == [0, 0.5, 0.25, 0.75, 0.375, 0.875, 0.125, 0.625]
    many = D.sobol(spark, 256, 21).toPandas()
    for j in range(21):
        assert len(set(np.floor(many[f"x{j}"] * 256))) == 256, j


@pytest.fixture(scope="module")
def wide(spark):
    d = D.saltelli(D.sobol(spark, 2048, 6, skip_first=True), 3, True)
    return S.by_base_row(d.withColumn("y", S.ishigami([F.col(f"x{j}") for j in range(3)])), 3, True).cache()


def test_ishigami(wide):
    for kind in ("saltelli", "jansen", "janon"):
        got = {r["factor"]: r for r in S.sobol_indices(wide, 3, kind=kind).collect()}
        assert [got[j]["s1"] for j in range(3)] == pytest.approx([0.3139, 0.4424, 0.0], abs=0.05)
        assert [got[j]["st"] for j in range(3)] == pytest.approx([0.5576, 0.4424, 0.2436], abs=0.05)
    s2 = {(r["i"], r["j"]): r["s2"] for r in S.second_order(wide, 3).collect()}
    assert s2[(0, 2)] == pytest.approx(0.244, abs=0.06)
    exact = S.ishigami_indices()
    assert exact["s1"] == pytest.approx([0.3139, 0.4424, 0.0], abs=1e-3) and exact["st"] == pytest.approx([0.5576, 0.4424, 0.2436], abs=1e-3)


def points(spark, n=4096):
    return D.sobol(spark, n, 3, skip_first=True).withColumn("y", S.ishigami([F.col(f"x{j}") for j in range(3)]))


def test_given_data_methods(spark):
    p = points(spark).cache()
    for f in (S.given_data, S.rbd_fast):
        got = {r["factor"]: r["s1"] for r in f(p, 3).collect()}
        assert [got[j] for j in range(3)] == pytest.approx([0.3139, 0.4424, 0.0], abs=0.07), f
    delta = {r["factor"]: r["delta"] for r in S.borgonovo(p.where("id < 2000"), 3).collect()}
    assert [delta[j] for j in range(3)] == pytest.approx([0.214, 0.371, 0.157], abs=0.08)
    found, chaos = S.chaos(p, 3, 8)
    got = {r["factor"]: r["s1"] for r in chaos.collect()}
    assert [got[j] for j in range(3)] == pytest.approx([0.3139, 0.4424, 0.0], abs=0.03)
    assert sum(r["share"] for r in S.hdmr(found, spark).collect()) == pytest.approx(1.0)


def test_fast(spark):
    d, omega = D.efast(spark, 1025, 3)
    got = {r["factor"]: r for r in S.fast_indices(d.withColumn("y", S.ishigami([F.col(f"x{j}") for j in range(3)])), omega, 1025).collect()}
    assert [got[j]["s1"] for j in range(3)] == pytest.approx([0.3139, 0.4424, 0.0], abs=0.05)


def test_gradients(spark):
    t = [(2 * F.col(f"x{j}") - 1) * math.pi for j in range(3)]
    g = points(spark).select("y", (F.cos(t[0]) * (1 + 0.1 * t[2] ** 4)).alias("d0"), (14 * F.sin(t[1]) * F.cos(t[1])).alias("d1"), (0.4 * t[2] ** 3 * F.sin(t[0])).alias("d2"))
    nu = {r["factor"]: r["nu"] for r in S.dgsm(g, [math.pi**2 / 3] * 3, 3).collect()}
    assert [nu[j] for j in range(3)] == pytest.approx([7.72, 24.5, 10.99], abs=0.2)
    ridge = spark.range(50).select(F.lit(3.0).alias("d0"), F.lit(4.0).alias("d1"))
    values, _, dim = S.active_subspace(ridge, 2)
    assert values[0] == pytest.approx(25.0, abs=1e-6) and dim == 1


def test_morris_linear(spark):
    d = D.morris(spark, 20, 8, 1)
    y = F.lit(0.0)
    for j in range(8):
        y = y + (j + 1) * F.col(f"x{j}")
    got = {r["factor"]: r for r in S.elementary_effects(d.withColumn("y", y), 8).collect()}
    for j in range(8):
        assert got[j]["mu"] == pytest.approx(j + 1, abs=1e-9) and got[j]["sigma"] == pytest.approx(0, abs=1e-9)


def test_shapley(spark):
    got = {r["factor"]: r["effect"] for r in S.shapley(S.ishigami, spark, 3, 300, 10, 4, 1).collect()}
    assert [got[j] for j in range(3)] == pytest.approx([6.03, 6.125, 1.69], abs=1.2)


@pytest.mark.parametrize("k", [3, 7, 11, 15, 19, 23])
def test_plackett_burman_is_orthogonal(k):
    m = np.array(D.plackett_burman(k))
    assert len(m) % 4 == 0 and (m.T @ m == len(m) * np.eye(k)).all() and (m.sum(0) == 0).all()


def test_anova_fractions(spark):
    rows = [(p, i, r, float(p * 2 + i + (p == i) * r)) for p in range(4) for i in range(3) for r in range(2)]
    got = S.anova(spark.createDataFrame(rows, "p int, i int, r int, x double"), ["p", "i", "r"]).collect()
    assert sum(x["fraction"] for x in got) == pytest.approx(1.0) and len(got) == 7


def test_discrepancy_star(spark):
    p = spark.createDataFrame([(0.5,)], "x0 double")
    assert S.discrepancy(p, 1, "star").first()["value"] == pytest.approx(1 / 3 - (1 - 0.25) + 0.5)


def test_quantiles(spark):
    u = F.col("u")
    d = spark.createDataFrame([(0.5,)], "u double").select(D.quantile("normal", u, 1, 2).alias("n"), D.quantile("exponential", u, 2.0).alias("e"), D.quantile("beta", u, 2.0, 2.0).alias("b"), D.quantile("triangular", u, 0, 1, 2).alias("t"))
    r = d.first()
    assert (r["n"], r["e"], r["b"], r["t"]) == pytest.approx((1.0, math.log(2) / 2, 0.5, 1.0), abs=1e-3)
