"""Published values and degenerate inputs of the agreement statistics."""

import math

import pytest

from gaugework.operators import agreement as A


def long(spark, rows):
    """rows: one tuple of labels an item, None for a gap."""
    return spark.createDataFrame([(i, r, v) for i, row in enumerate(rows) for r, v in enumerate(row) if v is not None], "item int, rater int, label int")


def paired(spark, matrix):
    rows, k = [], 0
    for a, row in enumerate(matrix):
        for b, n in enumerate(row):
            rows += [(k + i, a + 1, b + 1) for i in range(n)]
            k += n
    return spark.createDataFrame(rows, "item int, a int, b int")


@pytest.mark.parametrize(
    ("matrix", "plain", "linear", "quadratic"),
    [
        ([[30, 5, 5], [2, 20, 3], [3, 5, 27]], 0.6528, 0.6649, 0.6759),
        ([[13, 0, 0], [0, 20, 4], [0, 7, 56]], 0.796, 0.843, 0.892),
        ([[40, 4, 4, 17], [6, 25, 2, 13], [4, 1, 21, 12], [15, 5, 9, 45]], 0.432, 0.407, 0.383),
    ],
)
def test_kappa(spark, matrix, plain, linear, quadratic):
    p = paired(spark, matrix)
    assert A.cohen_kappa(p).first()["value"] == pytest.approx(plain, abs=1e-3)
    assert A.cohen_weighted(p, weight="linear").first()["value"] == pytest.approx(linear, abs=1e-3)
    assert A.cohen_weighted(p, weight="quadratic").first()["value"] == pytest.approx(quadratic, abs=1e-3)


def test_gwet_3x3(spark):
    p = paired(spark, [[13, 0, 0], [0, 20, 4], [0, 7, 56]])
    r = p.selectExpr("item", "stack(2, 0, a, 1, b) AS (rater, label)")
    assert A.gwet(r).first()["value"] == pytest.approx(0.84933, abs=1e-4)
    assert A.gwet(r, "quadratic").first()["value"] == pytest.approx(0.94024, abs=1e-4)


def test_fleiss(spark):
    table = [
        [0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1],
        [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7],
    ]
    r = long(spark, [[c for c, n in enumerate(row) for _ in range(n)] for row in table])
    assert A.fleiss_kappa(r).first()["value"] == pytest.approx(0.2099, abs=1e-3)
    assert A.fleiss_kappa(r.where("item > 0 OR rater > 0")).first()["status"] == "incomplete"


KRIPPENDORFF = [(1, 1, None), (2, 2, 3), (3, 3, 3), (3, 3, 3), (2, 2, 2), (1, 2, 3), (4, 4, 4), (1, 1, 2), (2, 2, 2), (None, 5, 5), (None, None, 1), (None, None, 3)]


@pytest.mark.parametrize(("level", "value"), [("nominal", 0.6753), ("interval", 0.8621), ("ordinal", 0.8049), ("ratio", 0.7446)])
def test_alpha(spark, level, value):
    assert A.krippendorff_alpha(long(spark, KRIPPENDORFF), level).first()["value"] == pytest.approx(value, abs=1e-3)


def test_keys_give_each_group_its_own_value(spark):
    r = long(spark, KRIPPENDORFF)
    both = r.selectExpr("'a' AS k", "*").unionByName(r.selectExpr("'b' AS k", "item", "rater", "1 AS label"))
    got = {x["k"]: x for x in A.krippendorff_alpha(both, "nominal", ["k"]).collect()}
    assert got["a"]["value"] == pytest.approx(0.6753, abs=1e-3) and got["b"]["status"] == "degenerate"


def test_degenerate_inputs(spark):
    same = spark.createDataFrame([(i, 1, 1) for i in range(5)], "item int, a int, b int")
    assert A.cohen_kappa(same).first()["value"] == 1.0
    assert A.cohen_kappa(same.limit(0)).first()["status"] == "no_data"
    assert A.bland_altman(spark.createDataFrame([(1.0, 2.0)], "x double, y double")).first()["lower"] is None


def test_leakage(spark):
    w = spark.createDataFrame([("a", "a", 0.8), ("a", "b", 0.4), ("b", "a", 0.6), ("b", "b", 0.9)], "model_i string, model_j string, wr double")
    f = spark.createDataFrame([("a", "x"), ("b", "y")], "model string, family string")
    assert A.preference_leakage(w, f).first()["pls"] == pytest.approx(0.26667, abs=1e-4)


def test_mandel_flags_the_outlier(spark):
    rows = [(f"lab{i}", 10.1 + d) for i in range(4) for d in (0.0, 0.1, -0.1, 0.05)] + [("out", v) for v in (14.0, 14.2, 14.1, 13.9)]
    got = {r["lab"]: r["h_flag"] for r in A.mandel(spark.createDataFrame(rows, "lab string, x double")).collect()}
    assert [k for k, v in got.items() if v] == ["out"]


def test_family_without_mapping_fails(spark):
    r = long(spark, KRIPPENDORFF)
    f = spark.createDataFrame([(0, "x"), (1, "y")], "rater int, family string")
    with pytest.raises(Exception, match="no family"):
        A.family_stratification(r, f).collect()


def test_dawid_skene_toy(spark):
    rows = [(1, 1, 1, 0, 1), (1, 1, 1, 1, 0), (0, 0, 0, 1, 0), (1, 1, 1, 1, 1), (0, 0, 0, 0, 1)]
    post, prior = A.dawid_skene(long(spark, rows), [0, 1], rounds=5)
    assert [r["label"] for r in post.orderBy("item").collect()] == [1, 1, 0, 1, 0]
    assert sum(r["prior"] for r in prior.collect()) == pytest.approx(1.0)


def test_gauge_statistics(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(A.distinct_categories(F.lit(3.0), F.lit(1.0)).alias("n"), A.precision_to_tolerance(F.lit(0.2), F.lit(1.0)).alias("p")).first()
    assert r["n"] == 4 and r["p"] == pytest.approx(1.2) and math.isfinite(r["p"])
