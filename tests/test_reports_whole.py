"""Whole reports equal their parts; calibration finds the parameters that answers were drawn from."""

import math
import random

import numpy as np
import pytest

from gaugework.operators import items
from gaugework.operators import sensitivity as S
from gaugework.plans import sensitivity_queries as Q
from gaugework.streaming import monitor as M


def test_analysis_holds_its_parts(spark):
    wide, points = Q._wide(spark, True, 128), Q._points(spark, 200)
    got = {(r.section, r.i, r.j, r.name): r.value for r in S.analysis(wide, Q.K, 10, 1, True, points).collect()}
    own = {r.factor: r for r in S.sobol_indices(wide, Q.K).collect()}
    low = {r.factor: r for r in S.sobol_intervals(wide, Q.K, 10, 1).collect()}
    for j in range(Q.K):
        assert got["index", j, None, "s1"] == pytest.approx(own[j].s1) and got["index", j, None, "st_high"] == pytest.approx(low[j].st_high)
    assert got["summary", None, None, "sum_st"] == pytest.approx(sum(r.st for r in own.values())) and got["summary", None, None, "base_rows"] == 128
    assert {(r.i, r.j): pytest.approx(r.s2) for r in S.second_order(wide, Q.K).collect()} == {k[1:3]: v for k, v in got.items() if k[0] == "second"}
    assert {r.factor: pytest.approx(r.delta) for r in S.borgonovo(points, Q.K).collect()} == {k[1]: v for k, v in got.items() if k[0] == "delta"}


def test_state_of_the_monitor(spark):
    rng = random.Random(2)
    rows = [("a", f"r{i // 3:03d}", i, rng.gauss(0, 1)) for i in range(90)] + [("b", "r0", i, 1.0) for i in range(5)] + [("b", "r0", 9, None), ("b", "r1", 10, float("inf"))]
    frame = spark.createDataFrame(rows, "series string, run_id string, ord long, x double")
    made = M.monitor_batch(frame, theta0=0.0, phase1=20)
    want, phases = 0, {}
    for name in "ab":
        s = M.Series(M.EMPTY, 0.05, 0.0, 1.0, 20, 0.2, 2.962, False)
        want += sum(len(list(s.push(r, o, x))) for n, r, o, x in rows if n == name)
        phases[name] = s.windows >= 20
    r = M.state_summary(frame, made).collect()[0]
    assert (r.observations, r.active, r.in_phase2, r.in_phase1, r.decisions) == (95, 2, sum(phases.values()), 2 - sum(phases.values()), want) and phases["a"]
    assert tuple(M.state_summary(frame.limit(0), made.limit(0)).collect()[0]) == (0, 0, 0, 0, 0)


def test_calibration_finds_the_items(spark):
    rng = random.Random(8)
    true = {k: (a, b) for k, (a, b) in enumerate([(1.0, -1.0), (1.5, 0.0), (0.8, 1.0), (1.2, 0.5), (2.0, -0.5)])}
    rows = []
    for person in range(800):
        theta = rng.gauss(0, 1)
        rows += [(person, k, int(rng.random() < 1 / (1 + math.exp(-a * (theta - b))))) for k, (a, b) in true.items()]
    got = {r.item: r for r in items.calibrate_2pl(spark.createDataFrame(rows, "person int, item int, y int"), rounds=12).collect()}
    for k, (a, b) in true.items():
        assert abs(got[k].difficulty - b) < 0.4 and abs(got[k].discrimination - a) < 0.7


def test_factors_of_one_cause(spark):
    rng = np.random.default_rng(4)
    f, e = rng.normal(size=400), rng.normal(size=(400, 3))
    loads = np.array([0.9, 0.7, 0.5])
    x = f[:, None] * loads + e * np.sqrt(1 - loads**2)
    wide = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    found, values = items.principal_factors(wide, ["a", "b", "c"], 1)
    assert np.allclose(np.abs(found[:, 0]), loads, atol=0.15) and values[0] > 1
