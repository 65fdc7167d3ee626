"""Readers, decisions, streaming, audit, change, perturbation and item operators; every query has a unique name."""

import json
import math

import pytest
from pyspark.sql import functions as F

from gaugework.operators import audit, change, decisions, items, perturb, reports
from gaugework.plans import catalog
from gaugework.sources import trial_logs as T
from gaugework.streaming import monitor as M

NOW = 1800000000


def test_jsonl_rows_and_warnings(spark):
    lines = ['{"task_id":"t","agent_id":"a","score":0.5,"timestamp":1700000000}', "", "{bad", '{"task_id":"t","score":1}', '{"task_id":"t","agent_id":"a","score":[1]}', '{"task_id":"t","agent_id":"a","score":true,"timestamp":5}', '{"task_id":"","agent_id":"a","score":true}']
    got = {r["ord"]: r for r in T.from_jsonl(spark.createDataFrame(list(enumerate(lines)), "ord long, line string"), T.Mapping(), NOW).collect()}
    assert {k: v["warning"] for k, v in got.items()} == {0: None, 2: "bad_json", 3: "missing_agent", 4: "bad_outcome", 5: "too_old", 6: "empty_task"}
    assert got[0]["outcome"]["score"] == 0.5 and len(got[0]["trial_id"]) == 32


def test_outcome_modes(spark):
    def mapped(value, **mode):
        df = spark.createDataFrame([(json.dumps({"score": value, "a": {"b": 2.0}}),)], "line string")
        return df.select(T.map_outcome(F.col("line"), T.Mapping(**mode)).alias("o")).first()["o"]

    assert mapped("PASS")["b"] is True and mapped("i")["b"] is False and mapped("maybe") is None
    assert mapped(0, mode="binary")["b"] is False and mapped(0.25)["score"] == 0.25
    assert mapped(300, mode="graded") is None and mapped(300, mode="graded", wrap_grades=True)["graded"] == 44
    assert mapped(1, mode="multi", criteria=(("x", "a.b"),))["criteria"] == {"x": 2.0}


def test_eval_logs(spark):
    doc = {"eval": {"run_id": "r", "task": "t", "model": "lab/m"}, "samples": [
        {"id": 1, "scores": {"m": {"value": "C"}, "n": {"value": 7}}, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "fam/x"}]},
        {"id": 2, "scores": None}, {"id": 3, "scores": {"m": {"value": [1, 2]}}}, {"id": 4, "scores": {"m": {"value": {"a": 0.5}}}},
    ]}
    got = T.from_eval_logs(spark.createDataFrame([("p", json.dumps(doc))], "path string, content string")).orderBy("ord").collect()
    assert [(r["sample_id"], r["scorer"], r["outcome"]["type"] if r["outcome"] else None, r["warning"]) for r in got] == [
        ("1", "m", "Binary", "too_old"), ("1", "n", "Graded", "too_old"), ("3", "m", None, "bad_score"), ("4", "m", "MultiCriterion", "too_old"),  # no time
    ]
    assert got[0]["judge"]["family"] == "fam" and got[0]["ts"] == 0


def test_eval_logs_keep_metadata_and_read_indented(spark, tmp_path):
    doc = {"eval": {"run_id": "r", "task": "t", "model": "lab/m", "metadata": {"a": "eval", "b": "eval"}}, "metadata": {"a": "log", "c": 3}, "samples": [
        {"id": 1, "epoch": 2, "completed_at": "2024-05-01T00:00:00Z", "metadata": {"b": "sample"}, "scores": {"m": {"value": "C"}}},
    ]}
    got = T.from_eval_logs(spark.createDataFrame([("p", json.dumps(doc))], "path string, content string"), now=1_800_000_000).first()
    assert got["warning"] is None and got["metadata"] == {"a": "eval", "b": "sample", "c": "3", "scorer_name": "m", "epoch": "2", "sample_id": "1"}
    (tmp_path / "log.json").write_text(json.dumps(doc, indent=2))
    for name in ("one", "two"):
        (tmp_path / f"{name}.jsonl").write_text('{"task_id": "t", "agent_id": "a", "outcome": true}\n')
    rows = T.read(spark, [f"{tmp_path}/{n}" for n in ("log.json", "one.jsonl", "two.jsonl")], now=1_800_000_000).collect()
    assert len(rows) == 3 and len({r["trial_id"] for r in rows}) == 3


def test_analyze_runs_what_applies(spark):
    rows = [("t", "a", f"r{i // 5}", i, i, float(i % 2), "Binary" if s == 0 else "Score", j, str(i)) for s in (0,) for i in range(30) for j in ("j1", "j2")]
    df = spark.createDataFrame(rows, "task_id string, agent_id string, run_id string, ts long, ord long, value double, outcome_type string, judge_model string, item string")
    got = {r["instrument"]: r for r in decisions.analyze(df).collect()}
    assert set(got) == {"sequential", "spc"}  # the judges agree
    half = {r["upper"] - r["lower"] for r in decisions.analyze_sequential(df).collect()}
    normal = {r["upper"] - r["lower"] for r in decisions.analyze_sequential(df.withColumn("outcome_type", F.lit("Score"))).collect()}
    assert half != normal or half == normal == set()
    with pytest.raises(ValueError):
        decisions.analyze(df.limit(0))
    with pytest.raises(ValueError):
        decisions.analyze(df, decisions.AnalysisConfig(force_disable=("irr", "sequential", "spc")))


def test_formats_and_config():
    assert T.detect_format("x.ndjson") == "jsonl" and T.detect_format("x", '{"eval": {}}') == "evallog" and T.detect_format("x", '{"a":1}\n{"a":2}') == "jsonl"
    with pytest.raises(ValueError):
        T.detect_format("x", "plain")
    assert T.merge_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_conformity(spark):
    d = spark.createDataFrame([(0.8, 0.1, 0.6), (0.65, 0.1, 0.6), (0.4, 0.1, 0.6), (0.6, 0.0, 0.6)], "e double, u double, t double")
    m, cr, decision = decisions.conformity(F.col("e"), F.col("u"), F.col("t"))
    got = d.select(m.alias("m"), cr.alias("c"), decision.alias("d")).collect()
    assert [r["d"] for r in got] == ["accept", "investigate", "reject", "accept"] and math.isnan(got[3]["c"])
    band = spark.range(1).select(decisions.guard_band(F.lit(0.1), 0.05).alias("a"), decisions.guard_band(F.lit(0.1), 0.023).alias("b")).first()
    assert (band["a"], band["b"]) == pytest.approx((0.0823, 0.10), abs=1e-3)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, f"r{i // 5:03d}", i, (1.0 if i < 150 else 3.0) + (i % 7) * 0.1) for s in ("a", "b") for i in range(250)]
    df = spark.createDataFrame(rows, "series string, run_id string, ord long, x double")
    src = str(tmp_path / "in")
    df.where("ord < 100").coalesce(1).write.parquet(src)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def step():
        stream = spark.readStream.schema(df.schema).parquet(src)
        M.monitor(stream, theta0=1.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    step()
    df.where("ord >= 100").coalesce(1).write.mode("append").parquet(src)
    step()  # goes on from the checkpoint
    key = lambda r: tuple(r)
    got = sorted(map(key, spark.read.schema(M.OUTPUT).parquet(out).collect()))
    want = sorted(map(key, M.monitor_batch(df, theta0=1.0).collect()))
    assert got == want and {r[1] for r in want} == {"stop_early", "regression"}


def test_audit_chain(spark):
    sealed = audit.seal([{"event": "x", "n": i} for i in range(6)], "ab" * 32)
    df = spark.createDataFrame(sealed).select("idx", "seq", "type", "base", "parent_hash", "entry_hash")
    assert audit.verify(df, "ab" * 32).collect() == []
    assert {r["finding"] for r in audit.verify(df, "cd" * 32).collect()} == {"genesis_hash"}
    bad = df.withColumn("base", F.when(F.col("idx") == 3, F.lit('{"n":9}')).otherwise(F.col("base")))
    assert [(r["idx"], r["finding"]) for r in audit.verify(bad, "ab" * 32).collect()] == [(3, "entry_hash")]
    assert {r["finding"] for r in audit.verify(df.where("idx != 0"), "ab" * 32).collect()} >= {"missing_genesis"}
    assert audit.verify(df.limit(0), "x").first()["finding"] == "missing_genesis"
    with pytest.raises(ValueError, match=r"\$\.a\[1\]"):
        audit.canonical({"a": [1, 0.5]})
    with pytest.raises(RuntimeError), audit.gate():
        pass


def test_change(spark):
    s = spark.createDataFrame([("a", "t", 1.0, 0.5), ("b", "t", 0.5, 0.9), ("b", "u", 0.5, 0.5)], "sha string, task_id string, before double, after double")
    assert [r["sha"] for r in change.regressions(s, 0.1).collect()] == ["a"] and [r["sha"] for r in change.improvements(s, 0.1).collect()] == ["b"]
    assert change.bisect(list("abcdefgh"), lambda x: x >= "e") == ("e", 3)


def test_perturbations(spark):
    d = spark.createDataFrame([('say "short" and "the \\"long\\" one" end', [("user", "a"), ("assistant", "b")])], "text string, m array<struct<role:string,content:string>>")
    r = d.select(perturb.region(F.col("text")).alias("r"), perturb.reorder(F.col("m"), 1, F.lit("k")).alias("o"), perturb.truncate(F.col("m"), F.lit(1)).alias("t"), perturb.inject(F.col("m"), F.col("m")[0], F.lit(9)).alias("i")).first()
    assert r["r"] == 'the \\"long\\" one' and [x["content"] for x in r["o"]] == ["b", "a"] and len(r["t"]) == 1 and len(r["i"]) == 3


def test_abilities(spark):
    rows = [(p, y, 1.0, b) for p, ys in (("mid", (1, 1, 0, 0)), ("all", (1, 1, 1, 1))) for y, b in zip(ys, (-1.0, 0.0, 0.0, 1.0))]
    a = spark.createDataFrame(rows, "person string, y int, discrimination double, difficulty double")
    got = {r["person"]: r for r in items.estimate(a).collect()}
    assert got["mid"]["theta"] == pytest.approx(0.0, abs=1e-4) and got["all"]["method"] == "eap" and got["all"]["theta"] > 0.5


def test_answers(spark):
    texts = ["ANSWER: b", "c).", "I pick a here", "hm\nD\n", "nothing", "answer: E", "(c)", "pick aé", "ANSWER: z\nANSWER: a", "B\nE\n", "the answer is  d."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reports.parse_answer(F.col("t"), 4)).collect()]
    assert got == ["B", "C", "A", "D", None, None, None, None, "A", "B", "D"]


def test_queries_and_oracles_agree_on_names():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
