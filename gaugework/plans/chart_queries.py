"""Control charts over the daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as C
from ..operators import run_length
from . import bindings as B


def _phase2(spark, sf):
    return C.with_limits(B.daily(spark, sf)).where("phase = 2")


def _obs(spark, sf):
    """Observations against fixed limits, for charts over long series."""
    return B.observations(spark, sf).withColumn("mu", F.lit(0.5)).withColumn("sigma", F.lit(0.5))


def cusum(spark, sf):
    d = C.cusum(_phase2(spark, sf))
    return d.select("series", "ord", F.round("c_plus", 6).alias("c_plus"), F.round("c_minus", 6).alias("c_minus"), "signal")


def cusum_fir(spark, sf):
    d = C.cusum(_phase2(spark, sf), head_start=2.5)
    return d.select("series", "ord", F.round("c_plus", 6).alias("c_plus"), F.round("c_minus", 6).alias("c_minus"), "signal")


def shewhart(spark, sf):
    d = C.shewhart(C.with_limits(B.daily(spark, sf)), rules=(1, 2, 3, 4))
    return d.select("series", "ord", F.round("z", 6).alias("z"), F.coalesce("rule", F.lit(0)).alias("rule"), "kind")


def ewma(spark, sf):
    d = C.ewma(_phase2(spark, sf))
    return d.select("series", "ord", F.round("ewma", 6).alias("ewma"), F.round("limit", 6).alias("limit"), "signal")


def combined(spark, sf):
    d = C.combined(_obs(spark, sf))
    return d.groupBy("series", F.coalesce("signal", F.lit("none")).alias("signal")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def edetector(spark, sf):
    d = C.e_detector(_phase2(spark, sf)).withColumnRenamed("e_stat", "growing").drop("signal")
    d = C.e_detector(d, window=5)
    return d.select("series", "ord", F.round("growing", 6).alias("growing"), F.round("e_stat", 6).alias("fixed"), "signal")


def first(spark, sf):
    return C.first_signal(C.cusum(_obs(spark, sf), h=4.0)).withColumn("first_signal", F.coalesce("first_signal", F.lit(-1).cast("long")))


def arl(spark, sf):
    rows = [("cusum", d, run_length.two_sided_cusum(0.5, 5.0, d)) for d in (0.0, 0.5, 1.0)] + [("ewma", 0.0, run_length.ewma(0.2, 2.962, 0.0)), ("shewhart", 0.0, run_length.shewhart(3.0))]
    return spark.createDataFrame(rows, "chart string, shift double, arl double").select("chart", "shift", F.round("arl", 3).alias("arl"))


def limits_g(spark, sf):
    g = B.table(spark, sf, "events").groupBy("event_type").agg(F.var_pop("value").alias("v"), F.count_distinct("user_id").alias("n"))
    return g.select("event_type", F.round(C.g_theory_sigma(F.col("v"), F.col("v") / 2, F.col("v") / 4, F.col("n"), F.lit(5)), 6).alias("sigma"))


QUERIES = {
    "spc_cusum": cusum, "spc_cusum_fir": cusum_fir, "spc_shewhart": shewhart, "spc_ewma": ewma, "spc_combined": combined, "spc_edetector": edetector,
    "spc_first_signal": first, "spc_arl": arl, "spc_limits_gtheory": limits_g,
}

_LIM = f"""WITH {B.DAILY}, lim AS (SELECT series, avg(x) AS mu, stddev_samp(x) AS sigma FROM daily WHERE ord <= 20 GROUP BY 1), zs AS (SELECT series, ord, x, mu, sigma, (x - mu) / sigma AS z FROM daily JOIN lim USING (series))"""
_W = "OVER (PARTITION BY series ORDER BY ord ROWS UNBOUNDED PRECEDING)"


def _cusum_sql(start: float) -> str:
    return f"""{_LIM}, s AS (SELECT *, sum(z - 0.5) {_W} AS u, sum(-z - 0.5) {_W} AS d FROM zs WHERE ord > 20),
 c AS (SELECT series, ord, u - least(-{start}::DOUBLE, min(u) {_W}) AS cp, d - least(-{start}::DOUBLE, min(d) {_W}) AS cm FROM s)
 SELECT series, ord, round(cp, 6) AS c_plus, round(cm, 6) AS c_minus, CASE WHEN cp > 5 THEN 'upper' WHEN cm > 5 THEN 'lower' END AS signal FROM c"""


_OBS = f"""WITH {B.OBS}, s AS (SELECT series, ord, (x - 0.5) / 0.5 AS z, sum((x - 0.5) / 0.5 - 0.5) {_W} AS u, sum(-(x - 0.5) / 0.5 - 0.5) {_W} AS d FROM obs),
 c AS (SELECT series, ord, z, u - least(0, min(u) {_W}) AS cp, d - least(0, min(d) {_W}) AS cm FROM s)"""


def _runs(rows: int, need: int, beyond: float) -> str:
    w = f"OVER (PARTITION BY series ORDER BY ord ROWS {rows - 1} PRECEDING)"
    return f"(ord >= {rows} AND (count(*) FILTER (z > {beyond}) {w} >= {need} OR count(*) FILTER (z < -{beyond}) {w} >= {need}))"


ORACLES = {
    "spc_cusum": _cusum_sql(0.0),
    "spc_cusum_fir": _cusum_sql(2.5),
    "spc_shewhart": f"""{_LIM}, r AS (SELECT series, ord, z, CASE WHEN abs(z) > 3 THEN 1 WHEN {_runs(3, 2, 2.0)} THEN 2 WHEN {_runs(5, 4, 1.0)} THEN 3 WHEN {_runs(8, 8, 0.0)} THEN 4 END AS rule FROM zs)
 SELECT series, ord, round(z, 6) AS z, coalesce(rule, 0) AS rule, CASE WHEN rule IS NOT NULL THEN 'out_of_control' WHEN abs(z) > 2 THEN 'warning' ELSE 'in_control' END AS kind FROM r""",
    "spc_ewma": f"""{_LIM}, p AS (SELECT *, ord - 20 AS k FROM zs WHERE ord > 20), e AS (SELECT a.series, a.ord, a.k, any_value(a.mu) AS mu, any_value(a.sigma) AS sigma, sum(0.2::DOUBLE * 0.8::DOUBLE ** (a.k - b.k) * b.x) + any_value(a.mu) * 0.8::DOUBLE ** a.k AS z FROM p a JOIN p b ON a.series = b.series AND b.k <= a.k GROUP BY a.series, a.ord, a.k),
 l AS (SELECT *, 2.962::DOUBLE * sigma * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - 0.8::DOUBLE ** (2 * k))) AS lim FROM e) SELECT series, ord, round(z, 6) AS ewma, round(lim, 6) AS "limit", abs(z - mu) > lim AS signal FROM l""",
    "spc_combined": f"{_OBS} SELECT series, CASE WHEN abs(z) > 3.5 THEN 'shewhart' WHEN cp > 5 THEN 'upper' WHEN cm > 5 THEN 'lower' ELSE 'none' END AS signal, count(*) AS n, min(ord) AS first FROM c GROUP BY 1, 2",
    "spc_first_signal": f"{_OBS} SELECT series, coalesce(min(CASE WHEN cp > 4 OR cm > 4 THEN ord END), -1) AS first_signal FROM c GROUP BY 1",
    "spc_edetector": f"""{_LIM}, l AS (SELECT series, ord, -0.5 * ln(2) + z * z / 4 AS l FROM zs WHERE ord > 20), s AS (SELECT *, sum(l) {_W} AS s FROM l),
 g AS (SELECT series, ord, exp(s - least(0, min(s) {_W})) AS growing, exp(sum(l) OVER (PARTITION BY series ORDER BY ord ROWS 4 PRECEDING)) AS fixed FROM s)
 SELECT series, ord, round(growing, 6) AS growing, round(fixed, 6) AS fixed, fixed >= 20 AS signal FROM g""",
    "spc_limits_gtheory": "SELECT event_type, round(sqrt(var_pop(value) / count(DISTINCT user_id) + var_pop(value) / 2 / 5 + var_pop(value) / 4 / (count(DISTINCT user_id) * 5)), 6) AS sigma FROM events GROUP BY 1",
}
