"""Places by stretches equal one window over all rows, whatever the stretches."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugework.functions import ranks
from gaugework.operators import audit, sensitivity


@pytest.fixture(params=[7, 100000])
def rows(request, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS", request.param)


@pytest.fixture
def frame(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(i, rng.choice([0.5, 0.5, rng.random()]), rng.gauss(0, 1), rng.gauss(0, 2)) for i in range(103)], "id long, x0 double, x1 double, y double").repartition(5)


def test_places(rows, frame):
    got = ranks.with_places(frame, {"x0": "a", "x1": "b"}, "id", 103)
    one = lambda c: F.row_number().over(Window.orderBy(c, "id"))
    assert got.withColumn("u", one("x0")).withColumn("v", one("x1")).where("a != u OR b != v").count() == 0
    long = ranks.long_places(frame, ["x0", "x1"], ["id"], "id", 103)
    w = Window.partitionBy("factor").orderBy("x", "id")
    assert long.count() == 206 and long.withColumn("u", F.row_number().over(w)).where("u != place").count() == 0
    for tiles in (1, 10, 103, 200):
        t = long.withColumn("t", ranks.tile(F.col("place"), 103, tiles)).withColumn("u", F.ntile(tiles).over(w))
        assert t.where("t != u OR t IS NULL").count() == 0
    s = ranks.shares_under(frame, "x0", "s", 103).withColumn("u", F.cume_dist().over(Window.orderBy("x0")))
    assert s.where("abs(s - u) > 1e-12").count() == 0
    p = ranks.with_previous(frame, "id", {"y": "before"}, 103).withColumn("u", F.lag("y").over(Window.orderBy("id")))
    assert p.where("NOT (before <=> u)").count() == 0 and p.where("first").select("id").collect()[0][0] == 0
    assert ranks.with_places(frame.limit(0), {"x0": "a"}, "id", 0).count() == 0


def test_chain_in_stretches(spark, rows):
    model = "cd" * 32
    lines = audit.seal([{"a": i} for i in range(60)], model)
    frame = lambda rows: spark.createDataFrame(rows, "idx long, seq long, type string, base string, parent_hash string, entry_hash string")
    assert audit.verify(frame(lines), model).count() == 0
    cut = frame([x for x in lines if x["idx"] != 30])
    assert sorted(map(tuple, audit.verify(cut, model).collect())) == [(31, "parent_mismatch"), (31, "seq_gap")]


def test_regression_on_ranks(rows, frame):
    d = frame.withColumn("y", F.exp(3 * F.col("x1")) + F.col("x0") / 2)
    got = {r.factor: r for r in sensitivity.regression(d, 2).collect()}
    assert 0.95 < got[1].r2_rank < 1 and got[1].srrc > 0.95 and got[1].src < 0.9
    g = {r.factor: r.s1 for r in sensitivity.given_data(d, 2).collect()}
    assert g[1] > g[0]
