"""Finished evaluations: result files, cells by items, stopping by width, rescored answers, stability by temperature.

Long form throughout: an item matrix is rows (cell_id, item_id, y), never one wide row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequential
from .reports import parse_answer

RESULTS = "eval string, model string, cells array<struct<cell_id: string, saltelli_index: bigint, accuracy: double, n_samples: bigint>>, item_matrix map<string, map<string, variant>>"
MANIFEST = "task string, model string, total_cells bigint, design struct<name: string, N_base: bigint, k: bigint, calc_second_order: boolean, axes: array<struct<name: string>>>"
#: The shares of a data set that few-shot levels take; fixed values.
LEVELS = (0.0, 0.01, 0.025, 0.05)


def result_cells(docs: DataFrame) -> DataFrame:
    """(path, eval, model, ord, cell_id, saltelli_index, accuracy, n_samples) of result documents (path, content).

    A document that is no JSON object or lacks eval, model or cells gives no rows here and one row in ``result_problems``.
    """
    r = docs.select("path", F.from_json("content", RESULTS).alias("r")).where("r.eval IS NOT NULL AND r.model IS NOT NULL")
    return r.select("path", "r.eval", "r.model", F.posexplode("r.cells").alias("ord", "c")).select("path", "eval", "model", F.col("ord").cast("long").alias("ord"), "c.*")


def result_items(docs: DataFrame) -> DataFrame:
    """(path, item_id, cell_id, y): the item matrix of result documents; values that are no numbers are left out."""
    r = docs.select("path", F.explode(F.from_json("content", RESULTS)["item_matrix"]).alias("item_id", "m"))
    r = r.select("path", "item_id", F.explode("m").alias("cell_id", "v"))
    number = ~F.schema_of_variant("v").isin("STRING", "BOOLEAN", "VOID")
    return r.select("path", "item_id", "cell_id", F.when(number, F.try_variant_get("v", "$", "double")).alias("y")).where("y IS NOT NULL")


def result_problems(docs: DataFrame) -> DataFrame:
    """(path, problem): documents that ``result_cells`` cannot read."""
    r = docs.select("path", F.from_json("content", RESULTS).alias("r"), F.try_parse_json("content").alias("v"))
    problem = F.when(F.col("v").isNull(), "bad_json").when(F.col("r.eval").isNull(), "missing_eval").when(F.col("r.model").isNull(), "missing_model").when(F.col("r.cells").isNull(), "missing_cells")
    return r.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def manifests(docs: DataFrame) -> DataFrame:
    """(path, task, model, total_cells, design, n_base, k, second_order, axes) of manifest documents (path, content)."""
    m = docs.select("path", F.from_json("content", MANIFEST).alias("m")).select("path", "m.*")
    d = F.col("design")
    return m.select(
        "path", "task", "model", "total_cells", d["name"].alias("design"), d["N_base"].alias("n_base"), d["k"].alias("k"), F.coalesce(d["calc_second_order"], F.lit(False)).alias("second_order"),
        d["axes"]["name"].alias("axes"),
    )


def read_documents(spark, path: str) -> DataFrame:
    """(path, content): one JSON document a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def read_matrix(spark, path: str) -> DataFrame:
    """(person, item, y) of a CSV file with a header of items; empty cells are left out. person numbers the rows uniquely, in order."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    long = wide.withColumn("person", F.monotonically_increasing_id()).unpivot("person", wide.columns, "item", "text")
    return long.select("person", "item", F.col("text").try_cast("double").alias("y")).where("y IS NOT NULL")


def order_pick(df: DataFrame, value: str, keys=()) -> DataFrame:
    """(keys, n, low, median, high): the values at places n // 4, n // 2 and 3n // 4 of each sorted group, counted from 0.

    Repeats are counted before they are ordered, so that a large group of few different values is small.
    """
    d = df.select(*keys, F.col(value).alias("_v")).where("_v IS NOT NULL")
    g = d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    g = g.withColumn("_to", F.sum("_c").over(part.orderBy("_v"))).withColumn("n", F.sum("_c").over(part))
    at = lambda place: F.min(F.when(F.col("_to") > F.floor(place), F.col("_v")))
    return g.groupBy(*keys, "n").agg(at(F.col("n") / 4).alias("low"), at(F.col("n") / 2).alias("median"), at(3 * F.col("n") / 4).alias("high"))


def stop_summary(stops: DataFrame, lengths: DataFrame, keys=("series",)) -> DataFrame:
    """Order statistics of stopping times (keys, n) and the shares that stopped by a quarter, by half and before the end of (keys, items)."""
    picks = order_pick(stops, "n", keys).withColumnRenamed("n", "reps")
    d = stops.join(lengths, list(keys))
    share = lambda c: F.avg(c.cast("double"))
    n, items = F.col("n"), F.col("items")
    s = d.groupBy(*keys, "items").agg(share(n <= F.floor(items / 4)).alias("by_quarter"), share(n <= F.floor(items / 2)).alias("by_half"), share(n < items).alias("before_end"))
    return picks.join(s, list(keys))


def width_stops(cells: DataFrame, answers: DataFrame, h: float = 0.05, alpha: float = 0.05, reps: int = 1000) -> DataFrame:
    """When each cell's confidence sequence would be narrower than ``h`` over ``reps`` orders of its items.

    cells: (cell_id, accuracy); answers: (cell_id, item_id, y). The width depends on n alone, so all orders stop at one place
    and no order is drawn. Cells without an accuracy or without answers are left out.
    """
    n_star = sequential.stop_by_width(h, alpha)
    n = answers.where("y IS NOT NULL").groupBy("cell_id").agg(F.count("y").alias("n_items"))
    d = cells.where("accuracy IS NOT NULL").join(n, "cell_id").withColumn("at", F.least(F.col("n_items"), F.lit(n_star).cast("long")))
    by = lambda c: c.cast("double")
    at, items = F.col("at"), F.col("n_items")
    return d.select(
        "cell_id", "n_items", "accuracy", F.when(at < items, F.lit(reps)).otherwise(0).cast("long").alias("n_stopped"), by(at).alias("median"), by(at).alias("low"), by(at).alias("high"),
        by(at <= F.floor(items / 4)).alias("by_quarter"), by(at <= F.floor(items / 2)).alias("by_half"), by(at < items).alias("before_end"),
    )


def width_summary(stops: DataFrame) -> DataFrame:
    """One row over the cells of ``width_stops``: their number, those with any early stop, quantiles of medians, mean shares."""
    q = lambda p: F.percentile("median", F.lit(p))
    return stops.agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("n_stopped") > 0).alias("early"), q(0.5).alias("median"), q(0.25).alias("low"), q(0.75).alias("high"),
        F.avg("by_quarter").alias("by_quarter"), F.avg("by_half").alias("by_half"), F.avg("before_end").alias("before_end"),
    ).where("cells > 0")


def by_temperature(variants: DataFrame) -> DataFrame:
    """(temperature, n_variants, mean, sd, min, max) of variants (variant, temperature, accuracy); a single variant has sd 0."""
    known = variants.where("accuracy IS NOT NULL AND temperature IS NOT NULL")
    a = "accuracy"
    return known.groupBy("temperature").agg(F.count(a).alias("n_variants"), F.avg(a).alias("mean"), F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("sd"), F.min(a).alias("min"), F.max(a).alias("max"))


def temperature_sensitive(answers: DataFrame, gap: float = 0.2) -> DataFrame:
    """(item, temperatures, spread, sensitive) of answers (item, temperature, y): sensitive if the means of two or more temperatures lie over ``gap`` apart."""
    m = answers.where("temperature IS NOT NULL AND y IS NOT NULL").groupBy("item", "temperature").agg(F.avg("y").alias("m"))
    g = m.groupBy("item").agg(F.count(F.lit(1)).alias("temperatures"), (F.max("m") - F.min("m")).alias("spread"))
    return g.withColumn("sensitive", (F.col("temperatures") >= 2) & (F.col("spread") > gap))


def said(messages: Column, which: str = "last") -> Column:
    """What the assistant said: the content of its last (or first) message in an array of (role, content); empty if it said nothing."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.coalesce(F.try_element_at(own, F.lit(-1 if which == "last" else 1))["content"], F.lit(""))


def rescore(samples: DataFrame, choices: int = 4) -> DataFrame:
    """samples (cell_id, template, target, native, output) with ``parsed``, ``native_ok`` (native is C) and ``rescored_ok`` (parsed is the target)."""
    d = samples.withColumn("parsed", parse_answer(F.col("output"), choices))
    return d.withColumn("native_ok", F.coalesce(F.col("native") == "C", F.lit(False))).withColumn("rescored_ok", F.coalesce(F.col("parsed") == F.col("target"), F.lit(False)))


def rescore_cells(rescored: DataFrame) -> DataFrame:
    """Per cell: samples, right ones natively and rescored, both shares, and how many samples differ."""
    g = rescored.groupBy("cell_id", "template").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("native_ok").alias("native_right"), F.count_if("rescored_ok").alias("rescored_right"),
        F.count_if(F.col("native_ok") != F.col("rescored_ok")).alias("mismatches"),
    )
    return g.withColumn("native_acc", F.col("native_right") / F.col("total")).withColumn("rescored_acc", F.col("rescored_right") / F.col("total"))


def rescore_templates(cells: DataFrame) -> DataFrame:
    """Means of the cells' shares by template and for ALL, and the difference."""
    g = cells.rollup("template").agg(F.count(F.lit(1)).alias("cells"), F.avg("native_acc").alias("native"), F.avg("rescored_acc").alias("rescored"))
    return g.withColumn("template", F.coalesce("template", F.lit("ALL"))).withColumn("delta", F.col("rescored") - F.col("native"))


def verify_hashes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status) of files: expected (path, sha, ord) from logs, actual (path, sha) as they are now.

    inconsistent: the log names several hashes; missing: no such file; mismatch: another hash than the first named; else ok.
    """
    e = expected.where("path IS NOT NULL AND sha IS NOT NULL").groupBy("path").agg(F.min_by("sha", "ord").alias("sha"), (F.min("sha") != F.max("sha")).alias("several"))
    a = actual.groupBy("path").agg(F.min("sha").alias("now"))
    status = F.when(F.col("several"), "inconsistent").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha"), "mismatch").otherwise("ok")
    return e.join(a, "path", "left").select("path", status.alias("status"))


def shot_levels(pool: DataFrame, size: int, levels=LEVELS) -> DataFrame:
    """(level, place, item): the first max(1, floor(level * size)) exemplars of a pool (place from 1, item); level 0 has none."""
    spark = pool.sparkSession
    rows = [(float(x), 0 if x <= 0 else max(1, int(x * size))) for x in levels]
    few = spark.createDataFrame(rows, "level double, _n int")
    return pool.join(F.broadcast(few), F.col("place") <= F.col("_n")).select("level", "place", "item")


def shot_prefix(levels: DataFrame, texts: DataFrame) -> DataFrame:
    """(level, prefix): the solved exemplars (item, text) of a level in order, a blank line after each."""
    d = levels.join(texts, "item").groupBy("level").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("e"))
    return d.select("level", F.concat(F.array_join(F.col("e")["text"], "\n\n"), F.lit("\n\n")).alias("prefix"))


def axis_histogram(df: DataFrame, axes: list[str], value: str, bins: int = 20) -> DataFrame:
    """(axis, level, bin, n): values in [0, 1] in equal bins for each level of each axis, all axes in one pass."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes])
    b = F.greatest(F.lit(0), F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))).cast("long")
    counted = df.where(F.col(value).isNotNull()).groupBy(*axes, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.explode(pairs).alias("p"), "bin", "n").groupBy("p.axis", "p.level", "bin").agg(F.sum("n").alias("n"))
