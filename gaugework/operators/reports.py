"""Report tables: intervals, slices, stability, lifecycle, subsets and rescoring."""

from __future__ import annotations

import uuid

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mathx, rng


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a proportion, clamped to [0, 1]; (0, 0) without observations."""
    n_ = F.when(n == 0, F.lit(1)).otherwise(n)
    p = k / n_
    centre, half = (p + z * z / (2 * n_)) / (1 + z * z / n_), z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / (1 + z * z / n_)
    clip = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return clip(centre - half), clip(centre + half)


def welch(df: DataFrame, group: Column, value: Column, keys=()) -> DataFrame:
    """Welch's t between group true and false: t, df (Satterthwaite), p by the normal; under two in a group: 0 and 1."""
    a, b = F.when(group, value), F.when(~group, value)
    s = df.groupBy(*keys).agg(*[f(c).alias(n) for c, x in ((a, "a"), (b, "b")) for f, n in ((F.count, f"n{x}"), (F.avg, f"m{x}"), (F.var_samp, f"v{x}"))])
    va, vb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    ok = (F.col("na") >= 2) & (F.col("nb") >= 2) & (va + vb > 0)
    s = s.withColumn("t", F.when(ok, (F.col("ma") - F.col("mb")) / F.sqrt(F.when(va + vb > 0, va + vb))).otherwise(0.0))
    freedom = (va + vb) * (va + vb) / F.nullif(va * va / (F.col("na") - 1) + vb * vb / (F.col("nb") - 1), F.lit(0.0))
    s = s.withColumn("df", F.when(ok, freedom).otherwise(0.0))
    return s.select(*keys, "t", "df", F.when(ok, 2 * (1 - mathx.phi(F.abs("t")))).otherwise(1.0).alias("p"))


def histogram(df: DataFrame, value: Column, bins: int, keys=()) -> DataFrame:
    """Counts of values in [0, 1] in equal bins; the last is closed."""
    b = F.least(F.floor(value * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def slices(df: DataFrame, axes: list[str], value: str) -> DataFrame:
    """Statistics of each level of each axis, all axes in one pass by grouping sets; diff is against the whole."""
    sets = ", ".join(f"({a})" for a in axes)
    level = F.coalesce(*[F.col(a).cast("string") for a in axes])
    base = df.select(*[F.col(a).cast("string").alias(a) for a in axes], F.col(value).alias(value))
    view = f"_slices_{uuid.uuid4().hex}"
    base.createOrReplaceTempView(view)
    g = base.sparkSession.sql(
        f"SELECT {', '.join(axes)}, grouping_id({', '.join(axes)}) AS gid, count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS sd, min({value}) AS min, max({value}) AS max FROM {view} GROUP BY GROUPING SETS ({sets}, ())"
    )
    full = (1 << len(axes)) - 1
    axis = F.lit(None).cast("string")
    for i, a in enumerate(axes):
        axis = F.when(F.col("gid") == full - (1 << (len(axes) - 1 - i)), F.lit(a)).otherwise(axis)
    whole = g.where(F.col("gid") == full).select(F.col("mean").alias("overall"))
    rows = g.where(F.col("gid") != full).withColumn("axis", axis).withColumn("level", level)
    return rows.crossJoin(whole).select("axis", "level", "n", "mean", "sd", "min", "max", (F.col("max") - F.col("min")).alias("spread"), (F.col("mean") - F.col("overall")).alias("diff"))


def rollup_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key and for ALL: n, mean, min, max, zeros (below .01)."""
    g = df.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.min(value).alias("min"), F.max(value).alias("max"), F.count_if(F.col(value) < 0.01).alias("zeros"))
    all_ = g.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("zeros").alias("zeros")).select(F.lit("ALL").alias(key), "*")
    return g.withColumn(key, F.col(key).cast("string")).unionByName(all_).select(F.col(key).alias("template"), "n", (F.col("s") / F.col("n")).alias("mean"), "min", "max", "zeros")


def item_stability(answers: DataFrame) -> DataFrame:
    """answers (item, y) to (item, p, class): stable at .9 or more or .1 or less, sensitive from .25 to .75."""
    g = answers.groupBy("item").agg(F.avg("y").alias("p"), F.count("y").alias("n"))
    kind = F.when((F.col("p") >= 0.9) | (F.col("p") <= 0.1), "stable").when(F.col("p").between(0.25, 0.75), "sensitive").otherwise("middling")
    return g.withColumn("class", kind)


def tier(share_sensitive: Column) -> Column:
    return F.when(share_sensitive < 0.1, "strong").when(share_sensitive < 0.3, "middling").otherwise("fragile")


def lifecycle(events: DataFrame) -> DataFrame:
    """events (task, run, status): per task the runs started and completed, those never completed, and retries.

    Retries are the sum of the counts that exceed 1 of starts of a run.
    """
    per = events.groupBy("task", "run").agg(F.count_if(F.col("status") == "started").alias("s"), F.count_if(F.col("status") == "completed").alias("c"))
    return per.groupBy("task").agg(
        F.count_if(F.col("s") > 0).alias("started"), F.count_if(F.col("c") > 0).alias("completed"),
        F.count_if((F.col("s") > 0) & (F.col("c") == 0)).alias("unfinished"), F.sum(F.when(F.col("s") > 1, F.col("s")).otherwise(0)).alias("retries"),
    )


def data_hashes(files: DataFrame) -> DataFrame:
    """files (path, sha) seen in runs: paths whose content differs between runs."""
    return files.groupBy("path").agg(F.count_distinct("sha").alias("versions"), F.count(F.lit(1)).alias("seen"))


def subsets(items: DataFrame, many: int, size: int, seed: int) -> DataFrame:
    """``many`` seeded samples of ``size`` items each: (subset, item)."""
    spark = items.sparkSession
    copies = items.select("item").distinct().crossJoin(F.broadcast(spark.range(many).select(F.col("id").alias("subset"))))
    n = F.row_number().over(Window.partitionBy("subset").orderBy(rng.shuffle_key(seed, F.col("subset"), F.col("item"))))
    return copies.withColumn("n", n).where(F.col("n") <= size).select("subset", "item")


def exemplars(items: DataFrame, seed: int, share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(pool, test): a seeded sample of max(1, floor(share N)) items as exemplars, and the rest."""
    distinct = items.select("item").distinct()
    size = max(1, math.floor(distinct.count() * share))
    pool = distinct.orderBy(rng.shuffle_key(seed, F.col("item")), "item").limit(size)
    return pool, distinct.join(pool, "item", "left_anti")


def factorial(axes: dict[str, list], spark) -> DataFrame:
    """Every combination of the axes' levels."""
    out = None
    for name, levels in axes.items():
        one = spark.createDataFrame([(str(v),) for v in levels], f"{name} string")
        out = one if out is None else out.crossJoin(one)
    return out


def parse_answer(text: Column, choices: int) -> Column:
    """The letter of a multiple-choice answer, by five rules from strict to loose; null if none holds.

    A rule that finds a letter beyond the choices gives way to the next: the first "ANSWER: X"; the text is one letter, perhaps
    with dots or closing brackets after it; "answer, choose, select or pick (is) X"; the last line of one letter; the last "ANSWER: X".
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:choices]
    alone = rf"(?i)\A\s*([{letters}])[.)]*\s*\z"
    lines = F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(alone)))
    found = [
        F.regexp_extract(text, r"(?i)ANSWER\s*:\s*([A-Z])", 1),
        F.regexp_extract(text, alone, 1),
        F.regexp_extract(text, r"(?i)(?:answer|choose|select|pick)\s+(?:is\s+)?([A-Z])(?![\p{L}\p{N}_])", 1),
        F.regexp_extract(F.try_element_at(lines, F.lit(-1)), alone, 1),
        F.regexp_extract(text, r"(?is).*ANSWER\s*:\s*([A-Z])", 1),
    ]
    upper = [F.upper(f) for f in found]
    return F.coalesce(*[F.when(u.isin(*letters), u) for u in upper])
