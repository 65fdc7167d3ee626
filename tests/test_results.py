"""Result files, stops, rescoring and the rest of the reports, against plain loops and hand-made cases."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gaugework.operators import agreement, audit, results, sequential
from gaugework.sources import trial_logs


def test_result_documents(spark, tmp_path):
    good = {"eval": "e", "model": "m", "cells": [{"cell_id": "a", "accuracy": 0.5}, {"cell_id": "b", "accuracy": None}], "item_matrix": {"i1": {"a": 1, "b": "1"}, "i2": {"a": 0.25, "b": True, "c": None}}}
    for name, text in {"good": json.dumps(good, indent=1), "bad": "{", "none": json.dumps({"model": "m"})}.items():
        (tmp_path / f"{name}.json").write_text(text)
    docs = results.read_documents(spark, str(tmp_path))
    assert [(r.ord, r.cell_id, r.accuracy) for r in results.result_cells(docs).orderBy("ord").collect()] == [(0, "a", 0.5), (1, "b", None)]
    assert sorted((r.item_id, r.cell_id, r.y) for r in results.result_items(docs).collect()) == [("i1", "a", 1.0), ("i2", "a", 0.25)]
    assert sorted((r.path.rsplit("/", 1)[1], r.problem) for r in results.result_problems(docs).collect()) == [("bad.json", "bad_json"), ("none.json", "missing_eval")]


def test_matrix_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("q1,q2\n1,0\n,1\n")
    got = results.read_matrix(spark, str(tmp_path / "x.csv")).orderBy("person", "item").collect()
    assert [(r.item, r.y) for r in got] == [("q1", 1.0), ("q2", 0.0), ("q2", 1.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 101])
def test_order_pick(spark, n):
    random.seed(n)
    xs = [random.randrange(6) for _ in range(n)]
    r = results.order_pick(spark.createDataFrame([(x,) for x in xs], "n int"), "n").collect()[0]
    xs.sort()
    assert (r.low, r.median, r.high) == (xs[n // 4], xs[n // 2], xs[3 * n // 4])


def test_width_stops(spark):
    cells = spark.createDataFrame([("long", 0.5), ("short", 0.5), ("gone", 0.1), ("null", None)], "cell_id string, accuracy double")
    star = sequential.stop_by_width(0.3)
    rows = [(c, str(i), 1.0) for c, n in (("long", 4 * star), ("short", star), ("null", 9)) for i in range(n)]
    stops = results.width_stops(cells, spark.createDataFrame(rows, "cell_id string, item_id string, y double"), 0.3, reps=10)
    got = {r.cell_id: r for r in stops.collect()}
    assert set(got) == {"long", "short"} and got["long"].n_stopped == 10 and got["long"].by_quarter == 1 and got["short"].n_stopped == 0 and got["short"].before_end == 0
    s = results.width_summary(stops).collect()[0]
    assert (s.cells, s.early, s.median) == (2, 1, star)
    assert results.width_summary(stops.where("false")).count() == 0


def test_temperatures(spark):
    v = [("a", 0.0, 0.5), ("b", 0.0, 0.7), ("c", 1.0, 0.9), ("d", None, 0.1), ("e", 1.0, None)]
    got = {r.temperature: r for r in results.by_temperature(spark.createDataFrame(v, "variant string, temperature double, accuracy double")).collect()}
    assert got[0.0].sd == pytest.approx(statistics.stdev([0.5, 0.7])) and got[1.0].sd == 0 and set(got) == {0.0, 1.0}
    a = spark.createDataFrame([("x", 0.0, 1.0), ("x", 1.0, 0.0), ("y", 0.0, 1.0), ("z", 0.0, 1.0), ("z", 1.0, 0.9)], "item string, temperature double, y double")
    assert {r.item: r.sensitive for r in results.temperature_sensitive(a).collect()} == {"x": True, "y": False, "z": False}


def test_rescoring(spark):
    m = "array<struct<role: string, content: string>>"
    rows = [("c", "t", "A", "C", [("user", "?"), ("assistant", "ANSWER: A"), ("assistant", "ANSWER: B")]), ("c", "t", "B", None, [("assistant", "B.")]), ("c", "t", "B", "I", []), ("c", "t", None, "C", None)]
    s = spark.createDataFrame(rows, f"cell_id string, template string, target string, native string, messages {m}")
    last = results.rescore_cells(results.rescore(s.withColumn("output", results.said(F.col("messages"))))).collect()[0]
    first = results.rescore_cells(results.rescore(s.withColumn("output", results.said(F.col("messages"), "first")))).collect()[0]
    assert (last.total, last.native_right, last.rescored_right, last.mismatches) == (4, 2, 1, 3) and first.rescored_right == 2
    assert results.rescore_templates(results.rescore_cells(results.rescore(s.withColumn("output", F.lit(""))))).count() == 2


def test_hashes_and_levels(spark):
    e = spark.createDataFrame([("a", "1", 0), ("b", "1", 0), ("b", "2", 1), ("c", "1", 0), ("d", "1", 0)], "path string, sha string, ord int")
    got = results.verify_hashes(e, spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "9")], "path string, sha string"))
    assert {r.path: r.status for r in got.collect()} == {"a": "ok", "b": "inconsistent", "c": "mismatch", "d": "missing"}
    pool = spark.createDataFrame([(i, f"i{i}") for i in range(1, 6)], "place int, item string")
    levels = results.shot_levels(pool, 100)
    assert {r.level: r["count"] for r in levels.groupBy("level").count().collect()} == {0.01: 1, 0.025: 2, 0.05: 5}
    texts = pool.select("item", F.concat(F.lit("Q "), "item").alias("text"))
    assert {r.level: r.prefix for r in results.shot_prefix(levels, texts).collect()}[0.025] == "Q i1\n\nQ i2\n\n"


def test_custom_weights(spark):
    r = spark.createDataFrame([(i, k, l) for i, row in enumerate([(0, 0, 1), (2, 2, 2), (1, 2, None), (0, 1, 1)]) for k, l in enumerate(row)], "item int, rater int, label int")
    linear = agreement.custom_weights(spark, [0, 1, 2], [[1, 0.5, 0], [0.5, 1, 0.5], [0, 0.5, 1]])
    own = agreement.custom_weights(spark, [2, 1, 0, 5], [[1, 0.9, 0, 0], [0.9, 1, 0.5, 0], [0, 0.5, 1, 0], [0, 0, 0, 1]])
    assert agreement.gwet(r, weights=linear).collect()[0].value == pytest.approx(agreement.gwet(r, "linear").collect()[0].value)
    assert agreement.coefficient_name(r, linear) == "Gwet AC2(linear)" and agreement.coefficient_name(r, own) == "Gwet AC3" and agreement.coefficient_name(r, None) == "Gwet AC1"
    assert agreement.gwet(r, weights=own).collect()[0].status == "ok"  # a category without labels plays no part
    with pytest.raises(Exception, match="no weights for label"):
        agreement.gwet(r, weights=agreement.custom_weights(spark, [0, 1], [[1, 0], [0, 1]])).collect()
    for bad in ([[1, 0]], [[1, 0.2], [0.3, 1]], [[0.9, 0], [0, 1]], [[1, -0.1], [-0.1, 1]], [[1, 1.1], [1.1, 1]]):
        with pytest.raises(ValueError):
            agreement.custom_weights(spark, [0, 1], bad)


def test_leakage_refuses_rates(spark):
    w = spark.createDataFrame([("a", "a", 0.6), ("b", "b", 0.5), ("a", "b", 0.4), ("b", "a", 0.6)], "model_i string, model_j string, wr double")
    f = spark.createDataFrame([("a", "x"), ("b", "x")], "model string, family string")
    got = {r.regime: r for r in agreement.leakage_means(agreement.preference_leakage(w, f)).collect()}
    want = ((0.6 - 0.5) / 0.5 + (0.5 - 0.55) / 0.55) / 2
    assert got["same_family"].mean_pls == pytest.approx(want) and got["all"].n_pairs == 1
    with pytest.raises(Exception, match="win rate"):
        agreement.preference_leakage(w.withColumn("wr", F.col("wr") + 0.5), f).collect()


def test_chain_file(tmp_path, spark):
    path, model = str(tmp_path / "chain.jsonl"), "ab" * 32
    audit.append_chain(path, [{"a": 1}, {"a": 2}], model)
    with open(path, "a") as f:
        f.write('{"broken')
    head = audit.append_chain(path, [{"a": 3}], model)
    lines = [json.loads(x) for x in open(path)]
    assert lines == audit.seal([{"a": 1}, {"a": 2}, {"a": 3}], model) and lines[-1]["entry_hash"] == head
    chain = spark.createDataFrame(lines, "idx long, seq long, type string, base string, parent_hash string, entry_hash string")
    assert audit.verify(chain, model).count() == 0
    open(path, "w").write("\n".join(json.dumps(x) for x in (lines[0], lines[2])) + "\n")
    with pytest.raises(ValueError, match="does not follow"):
        audit.append_chain(path, [{"a": 4}], model)


def test_line_numbers(spark, tmp_path):
    for name, n in (("a", 5), ("b", 3000)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{i + 1}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = trial_logs.numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 3 and got.count() == 3005 and got.where("ord != cast(line as bigint)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
