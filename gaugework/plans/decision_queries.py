"""The batch engine, conformity, change attribution and report tables over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change, decisions, reports
from . import bindings as B


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _trials(spark, sf):
    return B.trials(spark, sf).withColumn("outcome_type", F.lit("Score"))


def group(spark, sf):
    return _r(decisions.series_profile(_trials(spark, sf)).drop("all_binary").withColumn("judges", F.col("judges").cast("long")))


def detect(spark, sf):
    return decisions.detect(_trials(spark, sf), decisions.AnalysisConfig(force_disable=("spc",)))


def analyze_seq(spark, sf):
    t = _trials(spark, sf).withColumn("value", F.col("passed").cast("double")).withColumn("outcome_type", F.lit("Binary"))
    return _r(decisions.analyze_sequential(t, decisions.SequentialConfig(theta0=0.5)), 5)


def analyze_all(spark, sf):
    t = _trials(spark, sf).withColumn("value", F.col("passed").cast("double")).withColumn("outcome_type", F.lit("Binary"))
    return _r(decisions.analyze(t, decisions.AnalysisConfig(sequential=decisions.SequentialConfig(theta0=0.5))), 4)


def spc_windows(spark, sf):
    return _r(decisions.windows(_trials(spark, sf), decisions.SpcConfig(window=50)), 4)


def analyze_spc(spark, sf):
    t = _trials(spark, sf).withColumn("agent_id", F.lit("all"))
    return _r(decisions.analyze_spc(t).withColumn("first", F.coalesce("first", F.lit(0).cast("long"))), 4)


def analyze_irr(spark, sf):
    e = B.table(spark, sf, "events")
    r = e.groupBy((F.col("user_id") % 3).alias("task_id"), F.col("user_id").alias("item"), F.col("event_type").alias("rater")).agg(F.avg("value").alias("v"))
    r = r.select("task_id", "item", "rater", F.least(F.lit(3), F.floor(F.col("v") / 15)).alias("label"))
    return _r(decisions.analyze_irr(r, keys=("task_id",)))


def qmu(spark, sf):
    t = B.trials(spark, sf).groupBy("task_id", "agent_id").agg(F.avg(F.col("passed").cast("double")).alias("est"), F.count("passed").alias("n"))
    u = 1 / F.sqrt("n")
    margin, cr, decision = decisions.conformity(F.col("est"), u, F.lit(0.45), decisions.guard_band(u, 0.05))
    return _r(t.select("task_id", "agent_id", margin.alias("margin"), cr.alias("cr"), decision.alias("decision")))


def qmu_interval(spark, sf):
    t = B.trials(spark, sf).groupBy("task_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    est, unc = decisions.from_interval(F.col("lo"), F.col("hi"))
    return _r(t.select("task_id", est.alias("estimate"), unc.alias("uncertainty"), decisions.guard_band(unc, 0.023).alias("guard")), 4)


def hints(spark, sf):
    d = analyze_seq(spark, sf)
    return d.select("task_id", "agent_id", decisions.hint(F.col("kind"), F.col("n").cast("long"), F.col("estimate")).alias("hint"))


LEAST = 3000.0


def chg_regressions(spark, sf):
    return _r(change.regressions(B.changes(spark, sf), LEAST), 4)


def chg_improvements(spark, sf):
    return _r(change.improvements(B.changes(spark, sf), LEAST), 4)


def chg_all(spark, sf):
    return change.all_regressions(B.changes(spark, sf), LEAST).select("sha", F.array_join("tasks", ",").alias("tasks"))


def chg_affecting(spark, sf):
    return _r(change.affecting(B.changes(spark, sf), "ASIA", LEAST), 4)


def chg_history(spark, sf):
    return _r(change.history(B.changes(spark, sf), "EUROPE"), 4)


def _files(spark, sf):
    """Files changed a month: one path a priority and segment, lines from the orders."""
    o, c = B.table(spark, sf, "orders"), B.table(spark, sf, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("sha"), F.concat_ws("/", F.lit("src"), "c_mktsegment", F.concat("o_orderpriority", F.lit(".py"))).alias("path")).agg(
        F.count(F.lit(1)).alias("additions"), F.count_if(F.col("o_orderstatus") == "F").alias("deletions")
    )


def chg_churn(spark, sf):
    return change.churn(_files(spark, sf))


def _changed(spark, sf):
    return _files(spark, sf).where("additions > deletions").select("path").distinct()


def blast_history(spark, sf):
    return _r(change.blast_history(_files(spark, sf), B.changes(spark, sf), _changed(spark, sf), LEAST))


def blast_prefix(spark, sf):
    r, c = B.table(spark, sf, "region"), B.table(spark, sf, "customer")
    owners = c.select("c_mktsegment").distinct().crossJoin(r.select("r_name")).where(F.length("c_mktsegment") % 3 == F.length("r_name") % 3)
    owners = owners.select(F.concat(F.lit("src/"), F.col("c_mktsegment")).alias("prefix"), F.col("r_name").alias("task_id"))
    return _r(change.blast_prefix(_changed(spark, sf), owners, B.changes(spark, sf), LEAST))


def bisect(spark, sf):
    return _r(change.first_bad(B.changes(spark, sf), "AFRICA", 300000.0), 4)


def _cells(spark, sf):
    t = B.trials(spark, sf)
    return t.groupBy("task_id", "agent_id", "run_id").agg(F.avg(F.col("passed").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def rep_wilson(spark, sf):
    t = B.trials(spark, sf).groupBy("task_id").agg(F.count_if("passed").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = reports.wilson(F.col("k"), F.col("n"))
    return _r(t.select("task_id", "n", lo.alias("lower"), hi.alias("upper")))


def rep_cell_wilson(spark, sf):
    c = _cells(spark, sf)
    lo, hi = reports.wilson(F.bround(F.col("accuracy") * F.col("n")), F.col("n"))
    return _r(c.select("task_id", "agent_id", "run_id", lo.alias("lower"), hi.alias("upper")))


def rep_eval_summary(spark, sf):
    c = _cells(spark, sf)
    g = c.groupBy("task_id").agg((F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("pooled"), F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("sd"), F.min("accuracy").alias("min"), F.max("accuracy").alias("max"))
    return _r(g.withColumn("spread", F.col("max") - F.col("min")))


def rep_histogram(spark, sf):
    return reports.histogram(_cells(spark, sf), F.col("accuracy"), 10, ["task_id"])


def rep_slice(spark, sf):
    return _r(reports.slices(_cells(spark, sf), ["task_id", "agent_id", "run_id"], "accuracy"))


def rep_template(spark, sf):
    return _r(reports.rollup_summary(_cells(spark, sf), "task_id", "accuracy"))


def rep_welch(spark, sf):
    return _r(reports.welch(B.trials(spark, sf), F.col("agent_id").isin("u0", "u1", "u2", "u3", "u4"), F.col("value"), ["task_id"]), 5)


def rep_stability(spark, sf):
    s = reports.item_stability(B.responses(spark, sf).select("item", "y"))
    return _r(s.select("item", "p", "n", "class"))


def rep_tier(spark, sf):
    s = reports.item_stability(B.responses(spark, sf).select("item", "y"))
    g = s.agg(F.avg((F.col("class") == "sensitive").cast("double")).alias("share"))
    return _r(g.select("share", reports.tier(F.col("share")).alias("tier")))


def rep_validate(spark, sf):
    t = B.trials(spark, sf).groupBy("task_id", "run_id").agg(F.count(F.lit(1)).alias("n"))
    g = t.groupBy("task_id").agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("least"), F.max("n").alias("most"))
    return g.withColumn("complete", (F.col("runs") == 30) & (F.col("least") == F.col("most")))


def rep_lifecycle(spark, sf):
    e = B.table(spark, sf, "events")
    rows = e.where("event_type IN ('view', 'purchase')").select((F.col("user_id") % 7).alias("task"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "MM-dd")).alias("run"), F.when(F.col("event_type") == "view", "started").otherwise("completed").alias("status"))
    return reports.lifecycle(rows)


def rep_datahash(spark, sf):
    d = B.table(spark, sf, "documents")
    return reports.data_hashes(d.select(F.col("source").alias("path"), F.sha2("text", 256).alias("sha")))


def rep_subsets(spark, sf):
    return reports.subsets(B.table(spark, sf, "benchmark").select(F.col("item_id").alias("item")), 25, 10, 42)


def rep_nshot(spark, sf):
    pool, test = reports.exemplars(B.table(spark, sf, "part").select(F.col("p_partkey").alias("item")), 42)
    return pool.withColumn("part", F.lit("pool")).unionByName(test.withColumn("part", F.lit("test")))


def rep_variants(spark, sf):
    return reports.factorial({"template": ["a", "b", "c"], "temperature": [0.0, 0.5, 1.0], "system": ["none", "brief"]}, spark)


QUERIES = {
    "orch_group": group, "orch_detect": detect, "orch_seq": analyze_seq, "orch_analyze": analyze_all, "orch_spc_windows": spc_windows, "orch_spc": analyze_spc, "orch_irr": analyze_irr,
    "qmu_evaluate": qmu, "qmu_from_pipeline": qmu_interval, "decision_hint": hints,
    "chg_regressions": chg_regressions, "chg_improvements": chg_improvements, "chg_all_regressions": chg_all, "chg_affecting": chg_affecting, "chg_history": chg_history,
    "chg_churn": chg_churn, "blast_history": blast_history, "blast_prefix": blast_prefix, "bisect": bisect,
    "rep_wilson": rep_wilson, "rep_cell_wilson": rep_cell_wilson, "rep_eval_summary": rep_eval_summary, "rep_histogram": rep_histogram, "rep_slice": rep_slice,
    "rep_template_summary": rep_template, "rep_welch": rep_welch, "rep_stability": rep_stability, "rep_tier": rep_tier, "rep_validate": rep_validate,
    "rep_lifecycle": rep_lifecycle, "rep_datahash": rep_datahash, "rep_subsets": rep_subsets, "rep_nshot": rep_nshot, "rep_variants": rep_variants,
}

_T = f"WITH {B.TRIALS}"
_CELLS = f"{_T}, cells AS (SELECT task_id, agent_id, run_id, avg(CAST(passed AS DOUBLE)) AS accuracy, count(*) AS n FROM trials GROUP BY 1, 2, 3)"
_C = f"WITH {B.CHANGES}, dl AS (SELECT *, after - before AS delta FROM changes)"
_FILES = "files AS (SELECT strftime(o_orderdate, '%Y-%m') AS sha, 'src/' || c_mktsegment || '/' || o_orderpriority || '.py' AS path, count(*) AS additions, count(*) FILTER (o_orderstatus = 'F') AS deletions FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), changed AS (SELECT DISTINCT path FROM files WHERE additions > deletions)"


def _wilson(k, n):
    c = f"(({k}) / {n} + 3.8416::DOUBLE / (2 * {n})) / (1 + 3.8416::DOUBLE / {n})"
    h = f"1.96::DOUBLE * sqrt(({k}) / {n} * (1 - ({k}) / {n}) / {n} + 3.8416::DOUBLE / (4 * {n} * {n})) / (1 + 3.8416::DOUBLE / {n})"
    return f"round(greatest(0, {c} - {h}), 6) AS lower, round(least(1, {c} + {h}), 6) AS upper"


def _seq_sql(select: str) -> str:
    from .sequential_queries import _HALF

    w = "OVER (PARTITION BY task_id, agent_id ORDER BY ord ROWS UNBOUNDED PRECEDING)"
    return f"""{_T}, s AS (SELECT task_id, agent_id, (row_number() {w})::DOUBLE AS n, sum(CAST(passed AS INT) - 0.5) {w} AS d, avg(CAST(passed AS DOUBLE)) {w} AS mean, 0.5::DOUBLE AS sg FROM trials),
 l AS (SELECT *, exp(-0.5 * ln(1 + n) + d * d / (2 * (1 + n))) AS e, {_HALF.format(sigma="sg")} AS h FROM s),
 g AS (SELECT task_id, agent_id, min(CASE WHEN e >= 20 THEN n END) AS hit, max(n) AS last FROM l GROUP BY 1, 2)
 SELECT l.task_id, l.agent_id, {select} FROM g JOIN l ON g.task_id = l.task_id AND g.agent_id = l.agent_id AND l.n = coalesce(hit, last)"""


def _erf_phi(z):
    from .sequential_queries import _erf

    return f"(0.5 * (1 + {_erf(f'({z} / sqrt(2))')}))"


def _probit(p):
    from .agreement_queries import probit_sql

    return probit_sql(p)


ORACLES = {
    "orch_group": f"{_T} SELECT task_id, agent_id, count(*) AS records, 0::BIGINT AS judges, count(DISTINCT run_id) AS runs FROM trials GROUP BY 1, 2",
    "orch_detect": f"{_T}, s AS (SELECT count(*) AS n, count(DISTINCT run_id) AS r FROM trials GROUP BY task_id, agent_id) SELECT 'irr' AS instrument, false AS enabled UNION ALL SELECT 'sequential', max(n) >= 10 FROM s UNION ALL SELECT 'spc', false",
    "orch_seq": _seq_sql("CASE WHEN hit IS NOT NULL THEN 'stop_early' ELSE 'continue_running' END AS kind, l.n, round(mean, 5) AS estimate, round(mean - h, 5) AS lower, round(mean + h, 5) AS upper"),
    "decision_hint": _seq_sql("CASE WHEN hit IS NOT NULL THEN 'Evidence is conclusive after ' || CAST(l.n AS BIGINT) || ' observations; stop.' ELSE 'Not conclusive after ' || CAST(l.n AS BIGINT) || ' observations; keep running.' END AS hint"),
    "orch_spc_windows": f"{_T}, w AS (SELECT *, (row_number() OVER (PARTITION BY task_id, agent_id ORDER BY ord) - 1) // 50 + 1 AS w FROM trials) SELECT task_id, agent_id, w AS ord, round(avg(value), 4) AS x FROM w GROUP BY 1, 2, 3",
    "orch_spc": f"""{_T}, r AS (SELECT task_id, run_id, avg(value) AS x, min(ts) AS t FROM trials GROUP BY 1, 2), d AS (SELECT task_id, x, row_number() OVER (PARTITION BY task_id ORDER BY t, run_id) AS ord FROM r),
 lim AS (SELECT task_id, avg(x) FILTER (ord <= 20) AS mu, stddev_samp(x) FILTER (ord <= 20) AS sigma, count(*) AS windows FROM d GROUP BY 1), p AS (SELECT d.*, mu, sigma, ord - 20 AS k FROM d JOIN lim USING (task_id) WHERE ord > 20),
 e AS (SELECT a.task_id, a.ord, a.k, any_value(a.mu) AS mu, any_value(a.sigma) AS sigma, sum(0.2::DOUBLE * 0.8::DOUBLE ** (a.k - b.k) * b.x) + any_value(a.mu) * 0.8::DOUBLE ** a.k AS z FROM p a JOIN p b ON a.task_id = b.task_id AND b.k <= a.k GROUP BY 1, 2, 3),
 h AS (SELECT *, abs(z - mu) > 2.962::DOUBLE * sigma * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - 0.8::DOUBLE ** (2 * k))) AS hit FROM e), f AS (SELECT task_id, count(*) AS charted, count(*) FILTER (hit) AS regressions, min(ord) FILTER (hit) AS first FROM h GROUP BY 1)
 SELECT task_id, 'all' AS agent_id, windows, round(mu, 4) AS mu, round(sigma, 4) AS sigma, coalesce(charted, 0) AS charted, coalesce(regressions, 0) AS regressions, coalesce(first, 0) AS first, CASE WHEN regressions > 0 THEN 'regression' ELSE 'in_control' END AS kind FROM lim LEFT JOIN f USING (task_id)""",
    "orch_irr": """WITH ratings AS (SELECT user_id % 3 AS subset, user_id AS item, event_type AS rater, least(3, floor(avg(value) / 15)) AS label FROM events GROUP BY 1, 2, 3), v AS (SELECT subset, item, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY subset, item) AS m FROM ratings GROUP BY 1, 2, 3),"""
    + " de AS (SELECT subset, (sum(nc) * sum(nc) - sum(nc * nc)) / 2.0::DOUBLE / (sum(nc) - 1) AS dexp FROM (SELECT subset, label, sum(c) AS nc FROM v GROUP BY 1, 2) GROUP BY 1), ob AS (SELECT subset, sum((m * m - s2) / (m - 1.0::DOUBLE)) / 2 AS dobs FROM (SELECT subset, item, any_value(m) AS m, sum(c * c) AS s2 FROM v GROUP BY 1, 2) GROUP BY 1)"
    + " SELECT subset AS task_id, 5::BIGINT AS raters, round(1 - dobs / dexp, 6) AS value, CASE WHEN 1 - dobs / dexp < 0.67 THEN 'low_agreement' END AS warning FROM de JOIN ob USING (subset)",
    "qmu_evaluate": f"{_T}, e AS (SELECT task_id, agent_id, avg(CAST(passed AS DOUBLE)) AS est, 1 / sqrt(count(*)) AS u FROM trials GROUP BY 1, 2), g AS (SELECT {_probit('0.95::DOUBLE')} / 2 AS g) SELECT task_id, agent_id, round(est - 0.45::DOUBLE, 6) AS margin, round((est - 0.45::DOUBLE) / u, 6) AS cr, CASE WHEN est - u >= 0.45::DOUBLE + g * u THEN 'accept' WHEN est + u < 0.45::DOUBLE THEN 'reject' ELSE 'investigate' END AS decision FROM e, g",
    "qmu_from_pipeline": f"{_T}, g AS (SELECT {_probit('0.977::DOUBLE')} / 2 AS g) SELECT task_id, round((min(value) + max(value)) / 2, 4) AS estimate, round((max(value) - min(value)) / 2, 4) AS uncertainty, round(any_value(g) * (max(value) - min(value)) / 2, 4) AS guard FROM trials, g GROUP BY 1",
    "chg_regressions": f"{_C} SELECT sha, task_id, round(delta, 4) AS delta FROM dl WHERE delta < -3000",
    "chg_improvements": f"{_C} SELECT sha, task_id, round(delta, 4) AS delta FROM dl WHERE delta > 3000",
    "chg_all_regressions": f"{_C} SELECT sha, string_agg(task_id, ',' ORDER BY task_id) AS tasks FROM dl WHERE delta < -3000 GROUP BY 1",
    "chg_affecting": f"{_C} SELECT sha, round(delta, 4) AS delta FROM dl WHERE abs(delta) > 3000 AND task_id = 'ASIA'",
    "chg_history": f"{_C} SELECT sha, round(after, 4) AS after FROM changes WHERE task_id = 'EUROPE'",
    "chg_churn": f"WITH {_FILES} SELECT sha, count(*) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(additions + deletions) AS BIGINT) AS churn FROM files GROUP BY 1",
    "blast_history": f"{_C}, {_FILES}, past AS (SELECT DISTINCT sha FROM changes WHERE sha IN (SELECT sha FROM files WHERE path IN (SELECT path FROM changed))) SELECT task_id, count(*) AS hits, round(count(*) / (SELECT count(*) FROM past), 6) AS confidence FROM dl WHERE delta < -3000 AND sha IN (SELECT sha FROM past) GROUP BY 1",
    "blast_prefix": f"""{_C}, {_FILES}, px AS (SELECT unnest(['src', 'src/' || split_part(path, '/', 2)]) AS prefix FROM changed), own AS (SELECT DISTINCT 'src/' || c_mktsegment AS prefix, r_name AS task_id FROM customer, region WHERE length(c_mktsegment) % 3 = length(r_name) % 3),
 h AS (SELECT task_id FROM px JOIN own USING (prefix) UNION ALL SELECT task_id FROM dl WHERE delta < -3000), g AS (SELECT task_id, count(*) AS hits FROM h GROUP BY 1) SELECT task_id, hits, round(hits / (SELECT max(hits) FROM g), 6) AS confidence FROM g""",
    "bisect": f"{_C}, n AS (SELECT *, row_number() OVER (ORDER BY sha) AS n FROM changes WHERE task_id = 'AFRICA'), g AS (SELECT coalesce(max(n) FILTER (after >= 300000), 0) AS good FROM n) SELECT task_id, sha, round(after, 4) AS after FROM n, g WHERE n = good + 1",
    "rep_wilson": f"{_T}, s AS (SELECT task_id, count(*) FILTER (passed) AS k, count(*)::DOUBLE AS n FROM trials GROUP BY 1) SELECT task_id, CAST(n AS BIGINT) AS n, {_wilson('k', 'n')} FROM s",
    "rep_cell_wilson": f"{_CELLS}, c AS (SELECT task_id, agent_id, run_id, round_even(accuracy * n, 0) AS k, n::DOUBLE AS n FROM cells) SELECT task_id, agent_id, run_id, {_wilson('k', 'n')} FROM c",
    "rep_eval_summary": f"{_CELLS} SELECT task_id, round(sum(accuracy * n) / sum(n), 6) AS pooled, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sd, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max, round(max(accuracy) - min(accuracy), 6) AS spread FROM cells GROUP BY 1",
    "rep_histogram": f"{_CELLS} SELECT task_id, CAST(least(floor(accuracy * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM cells GROUP BY 1, 2",
    "rep_slice": f"""{_CELLS}, a AS (SELECT 'task_id' AS axis, task_id AS level, accuracy FROM cells UNION ALL SELECT 'agent_id', agent_id, accuracy FROM cells UNION ALL SELECT 'run_id', run_id, accuracy FROM cells)
 SELECT axis, level, count(*) AS n, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sd, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max, round(max(accuracy) - min(accuracy), 6) AS spread, round(avg(accuracy) - (SELECT avg(accuracy) FROM cells), 6) AS diff FROM a GROUP BY 1, 2""",
    "rep_template_summary": f"{_CELLS} SELECT coalesce(task_id, 'ALL') AS template, count(*) AS n, round(avg(accuracy), 6) AS mean, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max, count(*) FILTER (accuracy < 0.01) AS zeros FROM cells GROUP BY ROLLUP (task_id)",
    "rep_welch": f"""{_T}, s AS (SELECT task_id, agent_id IN ('u0', 'u1', 'u2', 'u3', 'u4') AS g, value FROM trials), m AS (SELECT task_id, avg(value) FILTER (g) - avg(value) FILTER (NOT g) AS d, var_samp(value) FILTER (g) / count(*) FILTER (g) AS a, var_samp(value) FILTER (NOT g) / count(*) FILTER (NOT g) AS b, count(*) FILTER (g) AS na, count(*) FILTER (NOT g) AS nb FROM s GROUP BY 1),
 t AS (SELECT task_id, d / sqrt(a + b) AS t, (a + b) ** 2 / (a * a / (na - 1) + b * b / (nb - 1)) AS df FROM m) SELECT task_id, round(t, 5) AS t, round(df, 5) AS df, round(2 * (1 - {_erf_phi("abs(t)")}), 5) AS p FROM t""",
    "rep_stability": f"WITH {B.RESPONSES}, g AS (SELECT item, avg(y) AS p, count(y) AS n FROM responses GROUP BY 1) SELECT item, round(p, 6) AS p, n, CASE WHEN p >= 0.9 OR p <= 0.1 THEN 'stable' WHEN p BETWEEN 0.25 AND 0.75 THEN 'sensitive' ELSE 'middling' END AS class FROM g",
    "rep_tier": f"WITH {B.RESPONSES}, g AS (SELECT item, avg(y) AS p FROM responses GROUP BY 1), s AS (SELECT avg(CAST(p BETWEEN 0.25 AND 0.75 AS DOUBLE)) AS share FROM g) SELECT round(share, 6) AS share, CASE WHEN share < 0.1 THEN 'strong' WHEN share < 0.3 THEN 'middling' ELSE 'fragile' END AS tier FROM s",
    "rep_validate": f"{_T}, t AS (SELECT task_id, run_id, count(*) AS n FROM trials GROUP BY 1, 2) SELECT task_id, count(*) AS runs, min(n) AS least, max(n) AS most, count(*) = 30 AND min(n) = max(n) AS complete FROM t GROUP BY 1",
    "rep_lifecycle": """WITH r AS (SELECT user_id % 7 AS task, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%m-%d') AS run, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'purchase') AS c FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2)
 SELECT task, count(*) FILTER (s > 0) AS started, count(*) FILTER (c > 0) AS completed, count(*) FILTER (s > 0 AND c = 0) AS unfinished, CAST(sum(CASE WHEN s > 1 THEN s ELSE 0 END) AS BIGINT) AS retries FROM r GROUP BY 1""",
    "rep_datahash": "SELECT source AS path, count(DISTINCT text) AS versions, count(*) AS seen FROM documents GROUP BY 1",
    "rep_subsets": "SELECT subset, item FROM (SELECT s AS subset, item_id AS item, row_number() OVER (PARTITION BY s ORDER BY md5('42:' || s || ':' || item_id)) AS n FROM (SELECT DISTINCT item_id FROM benchmark), range(25) t(s)) WHERE n <= 10",
    "rep_nshot": "WITH i AS (SELECT DISTINCT p_partkey AS item FROM part), r AS (SELECT item, row_number() OVER (ORDER BY md5('42:' || item), item) AS n, count(*) OVER () AS c FROM i) SELECT item, CASE WHEN n <= greatest(1, floor(c * 0.05::DOUBLE)) THEN 'pool' ELSE 'test' END AS part FROM r",
    "rep_variants": "SELECT * FROM (SELECT unnest(['a', 'b', 'c']) AS template), (SELECT unnest(['0.0', '0.5', '1.0']) AS temperature), (SELECT unnest(['none', 'brief']) AS system)",
}


def _analyze_sql() -> str:
    """Both instruments: the sequential part as in orch_seq, the charts as in orch_spc, by task and agent and of pass rates."""
    seq = _seq_sql("CASE WHEN hit IS NOT NULL THEN 'stop_early' ELSE 'continue_running' END AS kind, CAST(l.n AS BIGINT) AS n, round(mean, 4) AS estimate, round(mean - h, 4) AS lower, round(mean + h, 4) AS upper")
    both = "(SELECT task_id || '/' || agent_id AS task_id, run_id, ts, CAST(passed AS DOUBLE) AS value FROM trials)"
    spc = ORACLES["orch_spc"].replace("FROM trials", f"FROM {both}")
    return f"""SELECT 'sequential' AS instrument, task_id, agent_id, kind, n, estimate, lower, upper FROM ({seq})
 UNION ALL SELECT 'spc', split_part(task_id, '/', 1), split_part(task_id, '/', 2), kind, CAST(windows AS BIGINT), mu, NULL, NULL FROM ({spc})"""


ORACLES["orch_analyze"] = _analyze_sql()
