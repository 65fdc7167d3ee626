"""Change attribution over (sha, task_id, before, after) and changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deltas(scores: DataFrame) -> DataFrame:
    """after - before for tasks scored on both sides; of repeated tasks the one with the least (before, after) counts."""
    both = scores.where("before IS NOT NULL AND after IS NOT NULL")
    one = both.groupBy("sha", "task_id").agg(F.min(F.struct("before", "after")).alias("s")).select("sha", "task_id", "s.before", "s.after")
    return one.withColumn("delta", F.col("after") - F.col("before"))


def regressions(scores: DataFrame, least: float) -> DataFrame:
    return deltas(scores).where(F.col("delta") < -least).select("sha", "task_id", "delta")


def improvements(scores: DataFrame, least: float) -> DataFrame:
    return deltas(scores).where(F.col("delta") > least).select("sha", "task_id", "delta")


def all_regressions(scores: DataFrame, least: float) -> DataFrame:
    """(sha, tasks): the tasks that got worse with each change, for changes that have any."""
    return regressions(scores, least).groupBy("sha").agg(F.array_sort(F.collect_list("task_id")).alias("tasks"))


def affecting(scores: DataFrame, task: str, least: float) -> DataFrame:
    return deltas(scores).where((F.col("task_id") == task) & (F.abs("delta") > least)).select("sha", "delta")


def history(scores: DataFrame, task: str) -> DataFrame:
    return scores.where(F.col("task_id") == task).select("sha", "after")


def churn(files: DataFrame) -> DataFrame:
    """files (sha, path, additions, deletions) to sums a change."""
    g = files.groupBy("sha").agg(F.count(F.lit(1)).alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return g.withColumn("churn", F.col("additions") + F.col("deletions"))


def prefixes(path):
    """All directory prefixes of a path, longest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def blast_history(files: DataFrame, scores: DataFrame, changed: DataFrame, least: float, ignore_paths: bool = False) -> DataFrame:
    """(task_id, hits, confidence): how often past changes that touch one of the changed paths made a task worse.

    ignore_paths: any past change with scores counts.
    """
    past = scores.select("sha").distinct()
    if not ignore_paths:
        past = past.join(files.join(changed, "path", "left_semi").select("sha").distinct(), "sha", "left_semi")
    total = past.agg(F.count(F.lit(1)).alias("total"))
    g = regressions(scores, least).join(past, "sha", "left_semi").groupBy("task_id").agg(F.count(F.lit(1)).alias("hits"))
    return g.crossJoin(total).select("task_id", "hits", (F.col("hits") / F.col("total")).alias("confidence"))


def blast_prefix(changed: DataFrame, owners: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """(task_id, hits, confidence): changed paths under a task's prefix, plus its past regressions; confidence is relative to the largest."""
    hit = changed.select(F.explode(F.array_distinct(prefixes(F.col("path")))).alias("prefix")).join(owners, "prefix").select("task_id")
    g = hit.unionByName(regressions(scores, least).select("task_id")).groupBy("task_id").agg(F.count(F.lit(1)).alias("hits"))
    top = g.agg(F.max("hits").alias("top"))
    return g.crossJoin(top).select("task_id", "hits", (F.col("hits") / F.col("top")).alias("confidence"))


def first_bad(scores: DataFrame, task: str, threshold: float) -> DataFrame:
    """The first change after which a task is below the threshold for good, when all scores are known."""
    w = Window.partitionBy("task_id").orderBy("sha")
    d = scores.where(F.col("task_id") == task).withColumn("n", F.row_number().over(w))
    last_good = d.agg(F.max(F.when(F.col("after") >= threshold, F.col("n"))).alias("good"))
    return d.crossJoin(last_good).where(F.col("n") == F.coalesce("good", F.lit(0)) + 1).select("task_id", "sha", "after")


def bisect(shas: list[str], is_bad) -> tuple[str | None, int]:
    """Binary search between a good first and a bad last change: (first bad, evaluations). is_bad(sha) -> bool."""
    low, high, calls = 0, len(shas) - 1, 0
    if high < 1:
        return None, 0
    while high - low > 1:
        mid, calls = (low + high) // 2, calls + 1
        low, high = (low, mid) if is_bad(shas[mid]) else (mid, high)
    return shas[high], calls
