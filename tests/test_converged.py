"""The registered EM queries against plain copies that run until the log likelihood stands still."""

import numpy as np
import pytest

from gaugework.plans import bindings as B
from gaugework.plans import catalog

SF = "/root/testdata/sf0.001"


def dawid_skene(ratings, classes, most=100, tol=1e-6):
    """{item: (label, top)} by the reference's rule, and the rounds run."""
    items, raters = sorted({r[0] for r in ratings}), sorted({r[1] for r in ratings})
    n = np.zeros((len(items), len(raters), len(classes)))
    for i, j, v in ratings:
        n[items.index(i), raters.index(j), classes.index(v)] += 1
    t = n.sum(1) / n.sum((1, 2))[:, None]
    last = -np.inf
    for step in range(most):
        prior = t.mean(0)
        num = np.einsum("ik,ijl->jkl", t, n)
        den = num.sum(2, keepdims=True)
        pi = np.where(den > 1e-15, num / np.where(den > 1e-15, den, 1), 1 / len(classes))
        s = np.log(np.maximum(prior, 1e-300)) + np.einsum("ijl,jkl->ik", n, np.log(np.maximum(pi, 1e-300)))
        top = s.max(1, keepdims=True)
        z = top[:, 0] + np.log(np.exp(s - top).sum(1))
        t = np.exp(s - z[:, None])
        if abs(z.sum() - last) < tol:
            break
        last = z.sum()
    label = len(classes) - 1 - t[:, ::-1].argmax(1)
    return {i: (classes[k], p) for i, k, p in zip(items, label, t.max(1))}, step + 1


def calibrate(responses, most=100, points=21, tol=1e-6):
    """{item: (discrimination, difficulty)} of the items kept, and the rounds run."""
    people, items = sorted({r[0] for r in responses}), sorted({r[1] for r in responses})
    there, y = np.zeros((len(people), len(items))), np.zeros((len(people), len(items)))
    pi, ii = {p: k for k, p in enumerate(people)}, {i: k for k, i in enumerate(items)}
    for p, i, v in responses:
        there[pi[p], ii[i]], y[pi[p], ii[i]] = 1, v
    grid, a, b, last = np.linspace(-4, 4, points), np.ones(len(items)), np.zeros(len(items)), None
    for step in range(most):
        p = 1 / (1 + np.exp(-a[:, None] * (grid - b[:, None])))
        ll = y @ np.log(p) + (there - y) @ np.log(1 - p) - grid**2 / 2
        top = ll.max(1, keepdims=True)
        z = np.exp(ll - top).sum(1, keepdims=True)
        post, total = np.exp(ll - top) / z, float((top + np.log(z)).sum())
        size, right = there.T @ post, y.T @ post
        for _ in range(4):
            p = 1 / (1 + np.exp(-a[:, None] * (grid - b[:, None])))
            d, v, x = right - size * p, size * p * (1 - p), grid - b[:, None]
            ga, gb = (d * x).sum(1), -(d * a[:, None]).sum(1)
            haa, hbb, hab = (v * x * x).sum(1) + 1e-6, (v * a[:, None] ** 2).sum(1) + 1e-6, -(v * x * a[:, None]).sum(1)
            det = np.maximum(haa * hbb - hab**2, 1e-9)
            a = np.clip(a + np.clip((hbb * ga - hab * gb) / det, -0.5, 0.5), -4, 4)
            b = np.clip(b + np.clip((haa * gb - hab * ga) / det, -0.5, 0.5), -6, 6)
        if last is not None and abs(total - last) < tol:
            break
        last = total
    return {i: (x, v) for i, x, v in zip(items, a, b) if x > 0}, step + 1


def test_dawid_skene_runs_until_it_stands_still(spark):
    want, _ = dawid_skene([tuple(r) for r in B.ratings(spark, SF).collect()], [0, 1, 2, 3])
    got = {r["item"]: (r["label"], r["top"]) for r in catalog.queries()["irr_dawid_skene"](spark, SF).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert [got[i][1] for i in want] == pytest.approx([v[1] for v in want.values()], abs=2e-3)


def test_calibration_runs_until_it_stands_still(spark):
    want, _ = calibrate([tuple(r) for r in B.responses(spark, SF).collect()])
    got = {r["item"]: (r["discrimination"], r["difficulty"]) for r in catalog.queries()["cal_irt"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, v in want.items():
        assert got[i] == pytest.approx(v, abs=5e-3), i


def test_a_round_of_calibration_is_one_pass(spark, monkeypatch):
    """Few jobs a round, the same results in several partitions, and people with the same answers, or with gaps, count in full."""
    from gaugework.operators import items

    rows = [tuple(r) for r in B.responses(spark, SF).collect()]
    rows += [(p + 10_000, i, y) for p, i, y in rows if p % 3 == 0]
    want, _ = calibrate(rows, most=8)
    answers = spark.createDataFrame([*rows, (None, rows[0][1], 1), (1, None, 1), (1, rows[0][1], None)], "person bigint, item string, y int")
    for block in (1 << 18, 200):
        monkeypatch.setattr(items, "BLOCK", block, raising=False)
        spark.sparkContext.setJobGroup(f"calibrate-{block}", "")
        got = {r["item"]: (r["discrimination"], r["difficulty"]) for r in items.calibrate_2pl(answers, rounds=8).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"calibrate-{block}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got.keys() == want.keys()
        for i, v in want.items():
            assert got[i] == pytest.approx(v, abs=1e-9), i
        assert jobs < 24 + 2 * 8, jobs
