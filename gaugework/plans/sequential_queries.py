"""Sequential tests over observation streams."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequential as S
from . import bindings as B

_W = "OVER (PARTITION BY series ORDER BY ord ROWS UNBOUNDED PRECEDING)"
_N = "OVER (PARTITION BY series ORDER BY ord)"


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def bounds(spark, sf):
    rows = [(a, b, c, *S.wald_bounds(a, b, c)) for a, b in ((0.05, 0.1), (0.01, 0.2)) for c in (False, True)]
    return _r(spark.createDataFrame(rows, "alpha double, beta double, conservative boolean, upper double, lower double"))


def llr(spark, sf):
    d = B.observations(spark, sf)
    g = d.groupBy("series").agg(F.sum(S.llr_bernoulli(F.col("x"), 0.45, 0.55)).alias("bern"), F.sum(S.llr_normal(F.col("x"), 0.45, 0.55, 0.25)).alias("norm"))
    return _r(g)


def sprt(spark, sf):
    return S.stopping(S.sprt(B.observations(spark, sf), S.llr_bernoulli(F.col("x"), 0.45, 0.55), *S.wald_bounds(0.05, 0.1)))


def boosted(spark, sf):
    d = S.sprt_boosted(B.observations(spark, sf), S.llr_bernoulli(F.col("x"), 0.45, 0.55), 0.05)
    return _r(d.groupBy("series").agg(F.max("log_m").alias("top"), F.max_by("log_m", "ord").alias("last"), F.max_by("decision", "ord").alias("decision")))


def msprt_normal(spark, sf):
    d = S.msprt_normal(B.observations(spark, sf), 0.5)
    return _r(d.groupBy("series").agg(F.max("log_lr").alias("top"), F.min("always_valid_p").alias("least_p"), F.max("n").alias("n")))


def msprt_bernoulli(spark, sf):
    d = S.msprt_bernoulli(B.observations(spark, sf), 0.5)
    return _r(d.groupBy("series").agg(F.max("log_lr").alias("top"), F.min("always_valid_p").alias("least_p"), F.max_by("log_lr", "ord").alias("last")), 4)


def anytime(spark, sf):
    d = S.anytime(B.observations(spark, sf), theta0=0.5)
    return _r(d.select("series", "n", "mean", "lower", "upper", "e_value", "always_valid_p"))


def cs(spark, sf):
    return _r(S.confidence_sequence(B.observations(spark, sf), family="normal"))


def betting(spark, sf):
    d = B.observations(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy("ord")))
    return _r(S.betting_intervals(d, grid=50), 4)


def evalue(spark, sf):
    d = B.observations(spark, sf).groupBy("series", (F.col("ord") % 5).alias("g")).agg(F.avg("x").alias("m"))
    return _r(S.e_product(d.select("series", (2 * F.col("m")).alias("e_value")), ["series"]))


def practical(spark, sf):
    d = B.observations(spark, sf).withColumn("x", F.col("x") - 0.5)
    return _r(S.practical_p(d, 0.02))


def bias(spark, sf):
    d = B.observations(spark, sf).groupBy("series").agg(F.avg("x").alias("mle"), F.count("x").alias("n"))
    return _r(d.select("series", S.mle_bias_corrected(F.col("mle"), 0.45, 0.55, F.col("n")).alias("mean_corrected"), S.median_unbiased(F.col("mle"), 0.45, F.col("n")).alias("median_corrected")))


def spending(spark, sf):
    looks = spark.range(1, 6).select((F.col("id") / 5.0).alias("t"))
    return _r(S.spending(looks, 0.05, "pocock").withColumn("kind", F.lit("pocock")).unionByName(S.spending(looks, 0.05, "obf").withColumn("kind", F.lit("obf"))), 5)


def group_bounds(spark, sf):
    rows = [(kind, k, i + 1, v) for kind in ("pocock", "obf") for k in (2, 5) for i, v in enumerate(S.group_bounds(k, 0.05, kind))]
    return _r(spark.createDataFrame(rows, "kind string, looks int, look int, bound double"), 3)


def _looks(spark, sf):
    """z of the mean against 0.5 after each fifth of a series."""
    d = B.observations(spark, sf)
    n, all_ = F.row_number().over(Window.partitionBy("series").orderBy("ord")), F.count("x").over(Window.partitionBy("series"))
    d = d.withColumn("n", n).withColumn("all", all_).withColumn("s", F.sum("x").over(Window.partitionBy("series").orderBy("ord")))
    d = d.withColumn("look", F.ceil(F.col("n") * 5 / F.col("all")).cast("int"))
    return d.groupBy("series", "look").agg(F.max_by((F.col("s") / F.col("n") - 0.5) / 0.5 * F.sqrt("n"), "n").alias("z"))


OBF5 = [4.5617, 3.2256, 2.6337, 2.2809, 2.0401]


def group_monitor(spark, sf):
    return S.group_monitor(_looks(spark, sf), OBF5)


def perm_stop(spark, sf):
    d = B.observations(spark, sf)
    return _r(S.permutation_stops(d.withColumn("x", F.greatest("x", (F.col("ord") % 3 == 0).cast("double"))), 20, 42), 4)


def perm_width(spark, sf):
    d = B.observations(spark, sf).groupBy("series").agg(F.count("x").alias("n"))
    out = d
    for h in (0.15, 0.10, 0.05, 0.02):
        out = out.withColumn(f"stop_{int(h * 100)}", F.least(F.col("n"), F.lit(S.stop_by_width(h)).cast("long")))
    return out


QUERIES = {
    "seq_wald_bounds": bounds, "seq_llr": llr, "seq_sprt": sprt, "seq_sprt_boosted": boosted, "seq_msprt_gauss": msprt_normal, "seq_msprt_bern": msprt_bernoulli,
    "seq_anytime": anytime, "seq_cs": cs, "seq_betting_cs": betting, "seq_evalue": evalue, "seq_practical_p": practical, "seq_bias": bias,
    "seq_spending": spending, "seq_group_bounds": group_bounds, "seq_group_monitor": group_monitor, "seq_perm_stop": perm_stop, "seq_perm_ciwidth": perm_width,
}

_LLR = f"WITH {B.OBS}, l AS (SELECT series, ord, x * ln(0.55::DOUBLE / 0.45::DOUBLE) + (1 - x) * ln(0.45::DOUBLE / 0.55::DOUBLE) AS l FROM obs), s AS (SELECT series, ord, sum(l) {_W} AS s FROM l)"
_HALF = "{sigma} * sqrt(2 * (1 + 1.0::DOUBLE / n) * ln(sqrt(n + 1) / 0.05::DOUBLE) / n)"
_LB = "(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"


def _probit(p):
    from .agreement_queries import probit_sql

    return probit_sql(p)


def _erf(x):
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x})))"
    poly = f"((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


ORACLES = {
    "seq_wald_bounds": """WITH p AS (SELECT * FROM (VALUES (0.05::DOUBLE, 0.1::DOUBLE), (0.01, 0.2)) v(alpha, beta)), c AS (SELECT unnest([false, true]) AS conservative)
 SELECT alpha, beta, conservative, round(CASE WHEN conservative THEN 1 / alpha ELSE (1 - beta) / alpha END, 6) AS upper, round(CASE WHEN conservative THEN beta ELSE beta / (1 - alpha) END, 6) AS lower FROM p, c""",
    "seq_llr": f"WITH {B.OBS} SELECT series, round(sum(x * ln(0.55::DOUBLE / 0.45::DOUBLE) + (1 - x) * ln(0.45::DOUBLE / 0.55::DOUBLE)), 6) AS bern, round(sum(0.1::DOUBLE * x / 0.25::DOUBLE - (0.55::DOUBLE ** 2 - 0.45::DOUBLE ** 2) / 0.5::DOUBLE), 6) AS norm FROM obs GROUP BY 1",
    "seq_sprt": f"""{_LLR}, d AS (SELECT series, ord, CASE WHEN s >= ln(18) THEN 'reject' WHEN s <= ln(0.1::DOUBLE / 0.95::DOUBLE) THEN 'accept' END AS d FROM s),
 f AS (SELECT series, min(CASE WHEN d IS NOT NULL THEN ord END) AS hit, max(ord) AS last FROM d GROUP BY 1) SELECT f.series, coalesce(hit, last) AS stop, coalesce(d.d, 'continue') AS decision FROM f JOIN d ON d.series = f.series AND d.ord = coalesce(hit, last)""",
    "seq_sprt_boosted": f"""{_LLR}, m AS (SELECT series, ord, s - greatest(0, max(s - ln(20)) {_W}) AS m FROM s) SELECT series, round(max(m), 6) AS top, round(arg_max(m, ord), 6) AS last, CASE WHEN max(m) >= ln(20) - 1e-12 THEN 'reject' ELSE 'continue' END AS decision FROM m GROUP BY 1""",
    "seq_msprt_gauss": f"""WITH {B.OBS}, s AS (SELECT series, (row_number() {_N})::DOUBLE AS n, sum(x - 0.5) {_W} AS d FROM obs), l AS (SELECT series, n, -0.5 * ln(1 + n) + d * d / (2 * (1 + n)) AS l FROM s)
 SELECT series, round(max(l), 6) AS top, round(min(least(1, exp(-l))), 6) AS least_p, max(n) AS n FROM l GROUP BY 1""",
    "seq_msprt_bern": f"""WITH {B.OBS}, s AS (SELECT series, ord, (row_number() {_N})::DOUBLE AS n, sum(x) {_W} AS s FROM obs), l AS (SELECT series, ord, {_LB.format(a="(s + 1)", b="(n - s + 1)")} + n * ln(2) AS l FROM s)
 SELECT series, round(max(l), 4) AS top, round(min(least(1, exp(-l))), 4) AS least_p, round(arg_max(l, ord), 4) AS last FROM l GROUP BY 1""",
    "seq_anytime": f"""WITH {B.OBS}, s AS (SELECT series, (row_number() {_N})::DOUBLE AS n, sum(x - 0.5) {_W} AS d, avg(x) {_W} AS mean FROM obs), l AS (SELECT *, -0.5 * ln(1 + n) + d * d / (2 * (1 + n)) AS l, {_HALF.format(sigma="0.5")} AS h FROM s)
 SELECT series, n, round(mean, 6) AS mean, round(mean - h, 6) AS lower, round(mean + h, 6) AS upper, round(exp(l), 6) AS e_value, round(least(1, exp(-l)), 6) AS always_valid_p FROM l""",
    "seq_cs": f"""WITH {B.OBS}, s AS (SELECT series, count(x)::DOUBLE AS n, avg(x) AS mean, greatest(stddev_pop(x), 1e-10) AS sigma FROM obs GROUP BY 1), h AS (SELECT *, {_HALF.format(sigma="sigma")} AS h FROM s)
 SELECT series, n, round(mean, 6) AS mean, round(mean - h, 6) AS lower, round(mean + h, 6) AS upper, round(2 * h, 6) AS cs_width FROM h""",
    "seq_betting_cs": f"""WITH {B.OBS}, a AS (SELECT *, (row_number() {_N})::DOUBLE AS n, (0.5 + sum(x) {_W}) / ((row_number() {_N}) + 1) AS mu FROM obs),
 v AS (SELECT *, (0.25 + coalesce(sum((x - mu) * (x - mu)) OVER (PARTITION BY series ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n AS v FROM a),
 b AS (SELECT series, x, sqrt(2 * ln(40) / (v * n * ln(n + 2))) AS bet FROM v), g AS (SELECT 1e-4 + i * ((1 - 2e-4) / 49) AS m FROM range(50) t(i)),
 k AS (SELECT series, m, sum(ln(greatest(1 + least(bet, 0.5 / m) * (x - m), 1e-300))) AS u, sum(ln(greatest(1 - least(bet, 0.5 / (1 - m)) * (x - m), 1e-300))) AS d FROM b, g GROUP BY 1, 2)
 SELECT series, round(min(m) FILTER (greatest(u, d) + ln(0.5) < ln(20)), 4) AS lower, round(max(m) FILTER (greatest(u, d) + ln(0.5) < ln(20)), 4) AS upper FROM k GROUP BY 1""",
    "seq_evalue": f"WITH {B.OBS}, m AS (SELECT series, ord % 5 AS g, 2 * avg(x) AS e FROM obs GROUP BY 1, 2), p AS (SELECT series, product(e) AS e FROM m GROUP BY 1) SELECT series, round(e, 6) AS e, round(least(1, 1 / e), 6) AS p, e >= 20 AS reject FROM p",
    "seq_practical_p": f"WITH {B.OBS} SELECT series, round(least(1, exp(-(abs(0.02::DOUBLE * sum(x - 0.5)) - count(x) * 0.0004::DOUBLE / 2))), 6) AS p FROM obs GROUP BY 1",
    "seq_bias": f"WITH {B.OBS} SELECT series, round(avg(x) - 0.1::DOUBLE / (2 * count(x)), 6) AS mean_corrected, round(0.45::DOUBLE + (avg(x) - 0.45::DOUBLE) * (count(x) - 1) / count(x), 6) AS median_corrected FROM obs GROUP BY 1",
    "seq_spending": f"""WITH l AS (SELECT i / 5.0::DOUBLE AS t FROM range(1, 6) r(i)), z AS (SELECT {_probit("0.975::DOUBLE")} AS z), s AS (SELECT 'pocock' AS kind, t, 0.05::DOUBLE * ln(1 + (exp(1) - 1) * t) AS spent FROM l UNION ALL SELECT 'obf', t, 2 * (1 - 0.5 * (1 + {_erf("(z / sqrt(t) / sqrt(2))")})) FROM l, z),
 d AS (SELECT *, spent - coalesce(lag(spent) OVER (PARTITION BY kind ORDER BY t), 0) AS inc FROM s) SELECT kind, round(t, 5) AS t, round(spent, 5) AS spent, round(inc, 5) AS increment, round({_probit("1 - inc / 2")}, 5) AS boundary FROM d""",
    "seq_group_monitor": f"""WITH {B.OBS}, a AS (SELECT series, row_number() {_N} AS n, count(*) OVER (PARTITION BY series) AS al, sum(x) {_W} AS s FROM obs), b AS (SELECT *, CAST(ceil(n * 5 / al::DOUBLE) AS INT) AS look FROM a),
 z AS (SELECT series, look, arg_max((s / n - 0.5) / 0.5 * sqrt(n), n) AS z FROM b GROUP BY 1, 2), bd AS (SELECT unnest({OBF5}::DOUBLE[]) AS bound, unnest([1, 2, 3, 4, 5]) AS look),
 g AS (SELECT series, min(CASE WHEN abs(z) >= bound THEN look END) AS hit, max(look) AS last FROM z JOIN bd USING (look) GROUP BY 1)
 SELECT series, coalesce(hit, last) AS look, CASE WHEN hit IS NOT NULL THEN 'reject' WHEN last = 5 THEN 'accept' ELSE 'continue' END AS decision FROM g""",
    "seq_perm_stop": f"""WITH {B.OBS}, o AS (SELECT series, ord, greatest(x, CAST(ord % 3 = 0 AS DOUBLE)) AS x FROM obs), p AS (SELECT series, rep, x, row_number() OVER (PARTITION BY series, rep ORDER BY md5('42:' || rep || ':' || ord)) AS ord FROM o, range(20) t(rep)),
 s AS (SELECT *, sum(x) OVER (PARTITION BY series, rep ORDER BY ord) AS s FROM p), l AS (SELECT series, rep, ord, least(1, exp(-({_LB.format(a="(s + 1)", b="(ord - s + 1)")} + ord * ln(2)))) AS p FROM s),
 g AS (SELECT series, rep, min(CASE WHEN p <= 0.05 THEN ord END) AS hit, max(ord) AS al, arg_max(p, ord) AS f FROM l GROUP BY 1, 2) SELECT series, rep, hit IS NOT NULL AS stopped, CAST(coalesce(hit, al) AS INT) AS n, round(f, 4) AS final_p FROM g""",
    "seq_perm_ciwidth": f"WITH {B.OBS} SELECT series, count(x) AS n, least(count(x), 121) AS stop_15, least(count(x), 293) AS stop_10, least(count(x), 1319) AS stop_5, least(count(x), 9469) AS stop_2 FROM obs GROUP BY 1",
}
