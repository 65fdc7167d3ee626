"""Result files, stopping by width, rescored answers and stability by temperature over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, audit, reports, sequential
from ..operators import results as R
from . import bindings as B

WIDTH = 0.3
CUSTOM = [[1.0, 0.7, 0.2, 0.0, 0.0], [0.7, 1.0, 0.7, 0.2, 0.0], [0.2, 0.7, 1.0, 0.7, 0.2], [0.0, 0.2, 0.7, 1.0, 0.7], [0.0, 0.0, 0.2, 0.7, 1.0]]


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _answers(spark, sf):
    """eval, cell_id, item_id, y: first answers, cells by users and items by the events' property."""
    e = B.table(spark, sf, "events")
    item = F.concat(F.lit("i"), F.floor(F.get_json_object("props", "$.k").cast("int") / 2).cast("string"))
    cell = F.concat(F.col("event_type"), F.lit("-c"), (F.col("user_id") % 12).cast("string"))
    g = e.groupBy(F.col("event_type").alias("eval"), cell.alias("cell_id"), item.alias("item_id"))
    return g.agg(F.min_by((F.col("value") > 35).cast("double"), "event_id").alias("y"))


ANSWERS = """answers AS (SELECT event_type AS eval, event_type || '-c' || CAST(user_id % 12 AS VARCHAR) AS cell_id, 'i' || CAST(CAST(floor(CAST(json_extract(props, '$.k') AS INT) / 2) AS BIGINT) AS VARCHAR) AS item_id,
 arg_min(CAST(value > 35 AS DOUBLE), event_id) AS y FROM events GROUP BY 1, 2, 3), cells AS (SELECT eval, cell_id, avg(y) AS accuracy, count(*) AS n_samples FROM answers GROUP BY 1, 2)"""


def _documents(spark, sf):
    """One result document an event type, as the files hold them."""
    a = _answers(spark, sf)
    cells = a.groupBy("eval", "cell_id").agg(F.avg("y").alias("accuracy"), F.count("y").alias("n_samples"))
    cells = cells.groupBy("eval").agg(F.array_sort(F.collect_list(F.struct("cell_id", "accuracy", "n_samples"))).alias("cells"))
    rows = a.groupBy("eval", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("cell_id", "y"))).alias("m"))
    matrix = rows.groupBy("eval").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "m"))).alias("item_matrix"))
    doc = F.to_json(F.struct("eval", F.lit("m").alias("model"), "cells", "item_matrix"))
    return cells.join(matrix, "eval").select(F.concat("eval", F.lit(".json")).alias("path"), doc.alias("content"))


def src_results(spark, sf):
    return _r(R.result_cells(_documents(spark, sf)).select("path", "eval", "model", "cell_id", "accuracy", "n_samples"))


def src_results_items(spark, sf):
    return R.result_items(_documents(spark, sf))


def src_manifest(spark, sf):
    """A manifest a region, its axes the region's nations."""
    n, r = B.table(spark, sf, "nation"), B.table(spark, sf, "region")
    axes = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name")))).alias("axes"))
    d = r.join(axes, r["r_regionkey"] == axes["n_regionkey"])
    design = F.struct(F.lit("saltelli").alias("name"), F.lit(64).alias("N_base"), F.size("axes").alias("k"), (F.col("r_regionkey") % 2 == 0).alias("calc_second_order"), "axes")
    doc = F.to_json(F.struct(F.col("r_name").alias("task"), F.lit("m").alias("model"), (F.lit(64) * (F.size("axes") + 2)).alias("total_cells"), design.alias("design")))
    m = R.manifests(d.select(F.col("r_name").alias("path"), doc.alias("content")))
    return m.select("task", "total_cells", "n_base", "k", "second_order", F.array_join("axes", ",").alias("axes"))


def ciwidth_cells(spark, sf):
    docs = _documents(spark, sf)
    return _r(R.width_stops(R.result_cells(docs), R.result_items(docs), WIDTH))


def ciwidth_report(spark, sf):
    docs = _documents(spark, sf)
    return _r(R.width_summary(R.width_stops(R.result_cells(docs), R.result_items(docs), WIDTH)))


def order_quantiles(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"))
    return R.order_pick(li, "l_quantity", ["l_returnflag"])


def perm_summary(spark, sf):
    d = B.observations(spark, sf)
    d = d.withColumn("x", F.greatest("x", (F.col("ord") % 3 == 0).cast("double")))
    stops = sequential.permutation_stops(d, 20, 42)
    return _r(R.stop_summary(stops, d.groupBy("series").agg(F.count("x").alias("items"))))


def _variants(spark, sf):
    """variant, temperature, item, y: users as variants of a prompt at three temperatures."""
    e = B.table(spark, sf, "events")
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 2).cast("string")
    return e.select(
        F.format_string("v%03d", F.col("user_id") % 12).alias("variant"), (F.col("user_id") % 3 * 0.5).cast("double").alias("temperature"), F.concat_ws("-", "event_type", k).alias("item"),
        (F.col("value") > 35).cast("double").alias("y"), "event_id",
    )


VARIANTS = """variants AS (SELECT 'v' || lpad(CAST(user_id % 12 AS VARCHAR), 3, '0') AS variant, user_id % 3 * 0.5::DOUBLE AS temperature, event_type || '-' || CAST(CAST(floor(CAST(json_extract(props, '$.k') AS INT) / 2) AS BIGINT) AS VARCHAR) AS item,
 CAST(value > 35 AS DOUBLE) AS y, event_id FROM events)"""


def by_temperature(spark, sf):
    v = _variants(spark, sf).groupBy("variant", "temperature").agg(F.avg("y").alias("accuracy"))
    return _r(R.by_temperature(v))


def temperature_sensitive(spark, sf):
    return _r(R.temperature_sensitive(_variants(spark, sf)))


def baseline_stop(spark, sf):
    """Stopping of the baseline variant over its items, if it has at least 50."""
    base = _variants(spark, sf).where("variant = 'v000'").groupBy("item").agg(F.min_by("y", "event_id").alias("x")).withColumn("series", F.lit("v000")).withColumnRenamed("item", "ord")
    size = base.groupBy("series").agg(F.count("x").alias("items")).where("items >= 50")
    return _r(R.stop_summary(sequential.permutation_stops(base.join(size, "series", "left_semi"), 50, 7), size))


def axis_histogram(spark, sf):
    t = B.trials(spark, sf).groupBy("task_id", "agent_id", "run_id").agg(F.avg(F.col("passed").cast("double")).alias("accuracy"))
    return R.axis_histogram(t, ["task_id", "agent_id", "run_id"], "accuracy")


def _rescored(spark, sf):
    """Conversations as samples: the assistant's last message, with an answer in one of seven forms after it."""
    c = B.table(spark, sf, "conversations").where("conv_id IS NOT NULL")
    talk = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    letter = F.substring(F.lit("ABCDE"), (F.col("conv_id") % 5 + 1).cast("int"), F.lit(1))
    forms = ["\nANSWER: {}", "\n{})", "\nThe answer is {}", "\nI pick  {}!", "\n {}. \nor so", "\nanswer: z\nANSWER :{}", " ({})"]
    tail = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        before, after = form.split("{}")
        tail = F.when(F.col("conv_id") % len(forms) == i, F.concat(F.lit(before), letter, F.lit(after))).otherwise(tail)
    target = F.substring(F.lit("ABCD"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1))
    samples = talk.select(
        "conv_id", F.concat(F.lit("c"), (F.col("conv_id") % 12).cast("string")).alias("cell_id"), F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")).alias("template"), target.alias("target"),
        F.when(F.col("conv_id") % 6 == 0, "C").otherwise("I").alias("native"), F.concat(R.said(F.col("messages")), tail).alias("output"),
    )
    return R.rescore(samples)


def rescore_parse(spark, sf):
    return _rescored(spark, sf).select("conv_id", "parsed", "rescored_ok")


def rescore_cell(spark, sf):
    return _r(R.rescore_cells(_rescored(spark, sf)))


def rescore_template(spark, sf):
    return _r(R.rescore_templates(R.rescore_cells(_rescored(spark, sf))))


def hashes(spark, sf):
    """Documents as files: the log names their texts' hashes, now some are changed, gone or were logged twice."""
    d = B.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    again = d.where("doc_id % 11 = 0").select("path", F.sha2("sha", 256).alias("sha"), F.lit(1).alias("ord"))
    named = d.select("path", "sha", F.lit(0).alias("ord")).unionByName(again)
    now = d.where("doc_id % 7 != 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.sha2("path", 256)).otherwise(F.col("sha")).alias("sha"))
    return R.verify_hashes(named, now).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def shots(spark, sf):
    items = B.table(spark, sf, "part").select(F.col("p_partkey").alias("item"))
    pool, _ = reports.exemplars(items, 42)
    from pyspark.sql import Window

    from ..functions import rng

    placed = pool.withColumn("place", F.row_number().over(Window.orderBy(rng.shuffle_key(42, F.col("item")), "item")))  # a twentieth of the items
    return R.shot_levels(placed, items.distinct().count())


def blob_counts(spark, sf):
    d = B.table(spark, sf, "documents")
    refs = d.where("lang = 'en'").select(F.sha2("text", 256).alias("sha")).unionByName(d.where("doc_id % 50 = 0").select(F.sha2(F.concat("text", F.lit("!")), 256).alias("sha")))
    return audit.blob_counts(audit.blobs(d.select(F.col("text").alias("content"))), refs)


def gwet_custom(spark, sf):
    """AC3: weights of our own over the labels 0 to 4."""
    r = B.gappy(spark, sf).withColumn("label", F.least(F.col("label"), F.lit(4)))
    w = agreement.custom_weights(spark, list(range(5)), CUSTOM)
    return _r(agreement.gwet(r, weights=w)).withColumn("name", F.lit(agreement.coefficient_name(r, w)))


def leakage_means(spark, sf):
    w = B.win_rates(spark, sf)
    families = w.select(F.col("model_i").alias("model")).distinct().withColumn("family", F.length("model") % 2)
    return _r(agreement.leakage_means(agreement.preference_leakage(w, families)))


def spending_custom(spark, sf):
    """A spending function of our own: alpha t cubed."""
    looks = spark.range(1, 6).select((F.col("id") / 5).alias("t"))
    return _r(sequential.spending(looks, 0.05, lambda t, alpha: alpha * t * t * t).select("t", "spent", "increment"))


QUERIES = {
    "src_results": src_results, "src_results_items": src_results_items, "src_manifest": src_manifest, "seq_ciwidth_cells": ciwidth_cells, "seq_ciwidth_report": ciwidth_report,
    "agg_order_quantile": order_quantiles, "seq_perm_summary": perm_summary, "rep_by_temperature": by_temperature, "rep_temperature_sensitive": temperature_sensitive,
    "rep_baseline_stop": baseline_stop, "rep_slice_histogram": axis_histogram, "rescore_parse": rescore_parse, "rescore_cell": rescore_cell, "rescore_template": rescore_template,
    "rep_hash_check": hashes, "rep_nshot_levels": shots, "blob_gc_counts": blob_counts, "irr_gwet_ac3": gwet_custom, "irr_pls_means": leakage_means, "seq_spending_custom": spending_custom,
}

_STOP = f"(SELECT min(n) FROM range(1, 100000) t(n) WHERE 0.5::DOUBLE * sqrt(2 * (1 + 1.0::DOUBLE / n) * ln(sqrt(n + 1) / 0.05::DOUBLE) / n) < {WIDTH}::DOUBLE)"
_WIDTH = f"""WITH {ANSWERS}, w AS (SELECT cell_id, n_samples AS n_items, accuracy, least(n_samples, {_STOP}) AS stop FROM cells),
 stops AS (SELECT cell_id, n_items, accuracy, CASE WHEN stop < n_items THEN 1000 ELSE 0 END::BIGINT AS n_stopped, stop::DOUBLE AS median, (stop <= n_items // 4)::INT::DOUBLE AS by_quarter, (stop <= n_items // 2)::INT::DOUBLE AS by_half, (stop < n_items)::INT::DOUBLE AS before_end FROM w)"""


def _picks(rows: str, keys: str, value: str) -> str:
    """Order statistics by places in the sorted list."""
    s = f"list_sort(list({value}))"
    return f"SELECT {keys}, count(*) AS n, {s}[count(*) // 4 + 1] AS low, {s}[count(*) // 2 + 1] AS median, {s}[3 * count(*) // 4 + 1] AS high FROM {rows} GROUP BY ALL"


def _stops(source: str, seed: int, reps: int) -> str:
    """The permutation test's stopping times of (series, ord, x), as in seq_perm_stop, and their summary."""
    from .sequential_queries import _LB

    beta = _LB.format(a="(s + 1)", b="(ord - s + 1)")
    return f"""p AS (SELECT series, rep, x, row_number() OVER (PARTITION BY series, rep ORDER BY md5('{seed}:' || rep || ':' || ord)) AS ord FROM {source}, range({reps}) t(rep)),
 s AS (SELECT *, sum(x) OVER (PARTITION BY series, rep ORDER BY ord) AS s FROM p), l AS (SELECT series, rep, ord, least(1, exp(-({beta} + ord * ln(2)))) AS p FROM s),
 g AS (SELECT series, rep, coalesce(min(CASE WHEN p <= 0.05 THEN ord END), max(ord))::INT AS n, max(ord) AS items FROM l GROUP BY 1, 2),
 o AS ({_picks("g", "series", "n")})
 SELECT series, o.n AS reps, low, median, high, items, round(avg((g.n <= items // 4)::INT), 6) AS by_quarter, round(avg((g.n <= items // 2)::INT), 6) AS by_half, round(avg((g.n < items)::INT), 6) AS before_end FROM g JOIN o USING (series) GROUP BY ALL"""


_FORMS = """CASE conv_id % 7 WHEN 0 THEN chr(10) || 'ANSWER: ' || letter WHEN 1 THEN chr(10) || letter || ')' WHEN 2 THEN chr(10) || 'The answer is ' || letter WHEN 3 THEN chr(10) || 'I pick  ' || letter || '!'
  WHEN 4 THEN chr(10) || ' ' || letter || '. ' || chr(10) || 'or so' WHEN 5 THEN chr(10) || 'answer: z' || chr(10) || 'ANSWER :' || letter ELSE ' (' || letter || ')' END"""
_RESCORED = rf"""WITH talk AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS said, substr('ABCDE', CAST(conv_id % 5 + 1 AS BIGINT), 1) AS letter FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
 o AS (SELECT conv_id, said || {_FORMS} AS t FROM talk),
 f AS (SELECT conv_id, [regexp_extract(t, '(?i)ANSWER\s*:\s*([A-Z])', 1), regexp_extract(t, '^\s*([A-Da-d])[.)]*\s*$', 1), regexp_extract(t, '(?i)(?:answer|choose|select|pick)\s+(?:is\s+)?([A-Z])(?:[^\pL\pN_]|$)', 1),
  regexp_extract(list_filter(string_split(t, chr(10)), lambda x: regexp_full_match(x, '\s*[A-Da-d][.)]*\s*'))[-1], '([A-Da-d])', 1), regexp_extract(t, '(?is).*ANSWER\s*:\s*([A-Z])', 1)] AS found FROM o),
 q AS (SELECT conv_id, list_filter(list_transform(found, lambda x: upper(x)), lambda x: x IN ('A', 'B', 'C', 'D'))[1] AS parsed FROM f),
 r AS (SELECT conv_id, 'c' || CAST(conv_id % 12 AS VARCHAR) AS cell_id, 't' || CAST(conv_id % 3 AS VARCHAR) AS template, parsed, conv_id % 6 = 0 AS a, coalesce(parsed = substr('ABCD', CAST(conv_id % 4 + 1 AS BIGINT), 1), false) AS b FROM q),
 cells AS (SELECT cell_id, template, count(*) AS total, count(*) FILTER (a) AS native_right, count(*) FILTER (b) AS rescored_right, count(*) FILTER (a <> b) AS mismatches FROM r GROUP BY 1, 2)"""

ORACLES = {
    "src_results": f"WITH {ANSWERS} SELECT eval || '.json' AS path, eval, 'm' AS model, cell_id, round(accuracy, 6) AS accuracy, n_samples FROM cells",
    "src_results_items": f"WITH {ANSWERS} SELECT eval || '.json' AS path, item_id, cell_id, y FROM answers",
    "src_manifest": "SELECT r_name AS task, 64 * (count(*) + 2) AS total_cells, 64::BIGINT AS n_base, count(*) AS k, r_regionkey % 2 = 0 AS second_order, string_agg(n_name, ',' ORDER BY n_name) AS axes FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey",
    "seq_ciwidth_cells": f"{_WIDTH} SELECT cell_id, n_items, round(accuracy, 6) AS accuracy, n_stopped, median, median AS low, median AS high, by_quarter, by_half, before_end FROM stops",
    "seq_ciwidth_report": f"{_WIDTH} SELECT count(*) AS cells, count(*) FILTER (n_stopped > 0) AS early, quantile_cont(median, 0.5) AS median, quantile_cont(median, 0.25) AS low, quantile_cont(median, 0.75) AS high, round(avg(by_quarter), 6) AS by_quarter, round(avg(by_half), 6) AS by_half, round(avg(before_end), 6) AS before_end FROM stops",
    "agg_order_quantile": _picks("(SELECT l_returnflag, l_quantity::DOUBLE AS q FROM lineitem)", "l_returnflag", "q"),
    "seq_perm_summary": f"WITH {B.OBS}, z AS (SELECT series, ord, greatest(x, CAST(ord % 3 = 0 AS DOUBLE)) AS x FROM obs), {_stops('z', 42, 20)}",
    "rep_by_temperature": f"WITH {VARIANTS}, v AS (SELECT variant, temperature, avg(y) AS a FROM variants GROUP BY 1, 2) SELECT temperature, count(*) AS n_variants, round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6) AS sd, round(min(a), 6) AS min, round(max(a), 6) AS max FROM v GROUP BY 1",
    "rep_temperature_sensitive": f"WITH {VARIANTS}, m AS (SELECT item, temperature, avg(y) AS m FROM variants GROUP BY 1, 2) SELECT item, count(*) AS temperatures, round(max(m) - min(m), 6) AS spread, count(*) >= 2 AND max(m) - min(m) > 0.2::DOUBLE AS sensitive FROM m GROUP BY 1",
    "rep_baseline_stop": f"WITH {VARIANTS}, b AS (SELECT 'v000' AS series, item AS ord, arg_min(y, event_id) AS x FROM variants WHERE variant = 'v000' GROUP BY 2), z AS (SELECT * FROM b WHERE (SELECT count(*) FROM b) >= 50), {_stops('z', 7, 50)}",
    "rep_slice_histogram": f"""WITH {B.TRIALS}, c AS (SELECT task_id, agent_id, run_id, avg(CAST(passed AS DOUBLE)) AS v FROM trials GROUP BY 1, 2, 3), a AS (SELECT 'task_id' AS axis, task_id AS level, v FROM c UNION ALL SELECT 'agent_id', agent_id, v FROM c UNION ALL SELECT 'run_id', run_id, v FROM c)
 SELECT axis, level, CAST(least(floor(v * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM a GROUP BY 1, 2, 3""",
    "rescore_parse": f"{_RESCORED} SELECT conv_id, parsed, b AS rescored_ok FROM r",
    "rescore_cell": f"{_RESCORED} SELECT *, round(native_right / total, 6) AS native_acc, round(rescored_right / total, 6) AS rescored_acc FROM cells",
    "rescore_template": f"{_RESCORED} SELECT coalesce(template, 'ALL') AS template, count(*) AS cells, round(avg(native_right / total), 6) AS native, round(avg(rescored_right / total), 6) AS rescored, round(avg(rescored_right / total) - avg(native_right / total), 6) AS delta FROM cells GROUP BY ROLLUP (template)",
    "rep_hash_check": "SELECT CASE WHEN doc_id % 11 = 0 THEN 'inconsistent' WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS status, count(*) AS files FROM documents GROUP BY 1",
    "rep_nshot_levels": "WITH i AS (SELECT DISTINCT p_partkey AS item FROM part), r AS (SELECT item, row_number() OVER (ORDER BY md5('42:' || item), item)::INT AS place, count(*) OVER () AS c FROM i), l AS (SELECT unnest([0.01, 0.025, 0.05])::DOUBLE AS level) SELECT level, place, item FROM r, l WHERE place <= greatest(1, floor(level * c))",
    "blob_gc_counts": """WITH s AS (SELECT DISTINCT text FROM documents), w AS (SELECT text FROM documents WHERE lang = 'en' UNION SELECT text || '!' FROM documents WHERE doc_id % 50 = 0)
 SELECT (SELECT count(*) FROM s) AS scanned, (SELECT count(*) FROM w) AS referenced, (SELECT count(*) FROM s WHERE text NOT IN (SELECT text FROM w)) AS deleted""",
    "irr_gwet_ac3": f"""WITH {B.GAPPY}, r AS (SELECT item, rater, least(label, 4) AS label, count(*) OVER (PARTITION BY item) AS m FROM ratings), c AS (SELECT DISTINCT label FROM r),
 w AS (SELECT a.label AS ca, b.label AS cb, [1.0, 0.7, 0.2, 0.0, 0.0][CAST(abs(a.label - b.label) + 1 AS BIGINT)]::DOUBLE AS w FROM c a, c b),
 pa AS (SELECT avg(a) AS pa FROM (SELECT x.item, sum(w) / any_value(x.m * (x.m - 1.0::DOUBLE)) AS a FROM r x JOIN r y ON x.item = y.item AND x.rater <> y.rater JOIN w ON w.ca = x.label AND w.cb = y.label GROUP BY 1)),
 pi AS (SELECT label, sum(1.0::DOUBLE / m) / (SELECT count(DISTINCT item) FROM r) AS pi FROM r GROUP BY 1), q AS (SELECT count(*) AS q FROM c),
 pe AS (SELECT (SELECT sum(w) FROM w) * sum(pi * (1 - pi)) / (SELECT q * (q - 1.0::DOUBLE) FROM q) AS pe FROM pi) SELECT round((pa - pe) / (1 - pe), 6) AS value, 'ok' AS status, 'Gwet AC3' AS name FROM pa, pe""",
    "seq_spending_custom": "SELECT round(i / 5.0::DOUBLE, 6) AS t, round(0.05::DOUBLE * (i / 5.0::DOUBLE) ** 3, 6) AS spent, round(0.05::DOUBLE * ((i / 5.0::DOUBLE) ** 3 - ((i - 1) / 5.0::DOUBLE) ** 3), 6) AS increment FROM range(1, 6) t(i)",
}


def _leakage_means() -> str:
    from .agreement_queries import ORACLES as other

    pairs = other["irr_pls"].replace("round(0.5 *", "(0.5 *").replace(", 6) AS pls", ") AS pls")
    return f"SELECT coalesce(regime, 'all') AS regime, round(avg(pls), 6) AS mean_pls, count(*) AS n_pairs FROM ({pairs}) GROUP BY ROLLUP (regime)"


ORACLES["irr_pls_means"] = _leakage_means()
