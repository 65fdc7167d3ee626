"""Log documents: what a document says is read once, not for each of its samples."""

import json

from pyspark.sql import functions as F

from gaugework.sources import trial_logs as T


def test_documents_are_not_read_for_each_sample(spark):
    samples = [{"id": f"s{i}", "epoch": 1, "completed_at": "2024-01-05T00:00:00Z", "messages": [], "scores": {"match": {"value": "C"}, "size": {"value": i}}} for i in range(3)] + [{"id": "none"}]
    doc = json.dumps({"eval": {"run_id": "r", "task": "chat", "model": "lab/m", "metadata": {"a": "1"}}, "samples": samples})
    got = T.from_eval_logs(spark.createDataFrame([("log", doc)], "path string, content string"))
    plan = got.select("task_id", "agent_id", "run_id", "metadata", "warning")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.rsplit("Generate ", 1)[0]  # the lowest generator lays out the samples
    assert "Generate " in above and "content#" not in above
    rows = got.select("task_id", "agent_id", "scorer", "sample_id", "ord", F.col("metadata")["a"].alias("a")).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [("chat", "lab/m", s, f"s{i}", 1000 * i + k, "1") for i in range(3) for k, s in enumerate(("match", "size"))]
