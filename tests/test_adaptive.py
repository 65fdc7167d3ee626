"""Adaptive tests: pruning changes nothing, sessions follow their plan, minimax equals a loop."""

import random

import numpy as np
import pytest

from gaugework.operators import adaptive as A


def bank(spark, n, seed=3, ties=True):
    rng = random.Random(seed)
    rows = [(i, rng.choice([-1.0, 0.0, 0.5, 2.5]) if ties else rng.gauss(0, 1.5), rng.choice([0.6, 1.0, 1.8]) if ties else rng.uniform(0.3, 2), rng.randrange(5)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, difficulty double, discrimination double, exposure_count int")


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("more", [{}, {"top": 4}, {"exposure": "max", "limit": 2}, {"select": "minimax"}])
def test_contenders_change_no_test(spark, ties, more):
    rows, pool = bank(spark, 300, ties=ties)
    people = spark.createDataFrame([(k, (k - 4) * 0.8) for k in range(9)], "person int, theta double")
    got = sorted(map(tuple, A.adaptive_tests(pool, people, 6, least=2, seed=5, **more).collect()))
    plan = A.Plan(6, 2, seed=5, **more)
    whole = A.Bank.of([(i, a, b, e) for i, b, a, e in rows])
    want = []
    for person, theta in ((k, (k - 4) * 0.8) for k in range(9)):
        s = A.run_session(whole, plan, lambda item, a, b: A._draw(5, person, item, "answer") < 1 / (1 + np.exp(-a * (theta - b))), person)
        want.append((person, len(s.given), s.theta, s.se))
    assert got == want
    fewer = A.contenders(pool, plan).count() < 300
    assert fewer or (plan.select == "minimax" and not ties)  # minimax only leaves out repeated parameters


def test_session_steps(spark):
    own = A.Bank.of([(1, 1.0, 0.0, 9), (2, 2.0, 0.0, 0), (3, 1.0, 3.0, 0)])
    s = A.Session(own, A.Plan(2, least=2, se_stop=0.0))
    assert s.next_item() == 2 and not s.record(2, True) and s.theta > 0 and s.next_item() in (1, 3)
    assert s.record(1, False) and s.given == [2, 1] and len(s.history) == 2
    for step in (s.next_item, lambda: s.record(3, True)):
        with pytest.raises(RuntimeError):
            step()
    t = A.Session(own, A.Plan(3, exposure="max", limit=1))
    with pytest.raises(KeyError):
        t.record(7, True)
    assert A.run_session(own, A.Plan(3, se_stop=0.0, exposure="max", limit=1), lambda *_: True).given == [2, 3]
    never, always = A.Plan(3, se_stop=0.0, exposure="conditional", limit=1), A.Plan(3, se_stop=0.0, exposure="conditional", limit=1, chance=1.0)
    assert sorted(A.run_session(own, never, lambda *_: True).given) == [2, 3] and sorted(A.run_session(own, always, lambda *_: True).given) == [1, 2, 3]


def test_own_answers(spark):
    _, pool = bank(spark, 40)
    people = spark.createDataFrame([("p", 0.0)], "person string, theta double")
    got = A.adaptive_tests(pool, people, 5, answer=lambda *_: True).collect()[0]
    assert got["theta"] > 1 and A.adaptive_tests(pool.limit(0), people, 5).collect()[0]["n"] == 0
    assert A.adaptive_tests(pool, people.limit(0), 5).collect() == []


def test_minimax_equals_a_loop(spark):
    rows, pool = bank(spark, 60, ties=False)
    grid, total, left, want = np.linspace(-4, 4, 31), np.zeros(31), {r[0]: r for r in rows}, []
    info = lambda r: r[2] ** 2 / ((1 + np.exp(-r[2] * (grid - r[1]))) * (1 + np.exp(r[2] * (grid - r[1]))))
    for _ in range(4):
        best = max(left.values(), key=lambda r: (round(float((total + info(r)).min()), 12), -r[0]))
        total = total + info(left.pop(best[0]))
        want.append(best[0])
    assert A.select_minimax(pool, 4) == want and len(A.select_minimax(pool.limit(2), 5)) == 2


def test_a_state_is_worked_out_once():
    rng = random.Random(8)
    own = A.Bank.of([(i, rng.choice([0.6, 1.0, 1.8]), rng.gauss(0, 1.5), 0) for i in range(200)])
    for plan in (A.Plan(6, least=2, seed=4), A.Plan(3, least=2, seed=4, top=2)):
        tests = A.Tests(own, plan)
        for person in range(1500):
            answer = lambda item, a, b, p=person: A._draw(4, p, item, "answer") < 1 / (1 + np.exp(-a * ((p % 7) / 2 - 1.5 - b)))
            got, want = tests.run(answer, person), A.run_session(own, plan, answer, person)
            assert (got.given, got.history, got.theta, got.se) == (want.given, want.history, want.theta, want.se)
        assert tests.made == tests.held <= sum((2 * plan.top) ** k for k in range(plan.most + 1))
