"""Inter-rater agreement over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mathx
from ..functions.rng import duck_uniform
from ..operators import agreement as A
from . import bindings as B

R1, R2 = "click", "purchase"
LEVELS = ("nominal", "ordinal", "interval", "ratio")


def _r(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names or dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns])


def _raters(spark, sf):
    """The two raters compared: the first two in the alphabet."""
    return A.pair_ratings(B.ratings(spark, sf).where("rater IN (SELECT rater FROM VALUES ('view'), ('click') AS t(rater))"), "click", "view")


def cohen(spark, sf):
    return _r(A.cohen_kappa(_raters(spark, sf)))


def cohen_weighted(spark, sf):
    p = _raters(spark, sf)
    return _r(A.cohen_weighted(p, weight="linear").withColumn("scheme", F.lit("linear")).unionByName(A.cohen_weighted(p, weight="quadratic").withColumn("scheme", F.lit("quadratic"))))


def fleiss(spark, sf):
    return _r(A.fleiss_kappa(B.ratings(spark, sf)))


def alpha(spark, sf):
    r = B.gappy(spark, sf)
    out = None
    for level in LEVELS:
        one = A.krippendorff_alpha(r, level).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return _r(out)


def gwet(spark, sf):
    r, out = B.gappy(spark, sf), None
    for scheme in ("identity", "linear", "quadratic", "ordinal"):
        one = A.gwet(r, scheme).withColumn("scheme", F.lit(scheme))
        out = one if out is None else out.unionByName(one)
    return _r(out)


def weights(spark, sf):
    r, out = B.gappy(spark, sf), None
    for scheme in ("identity", "linear", "quadratic", "ordinal"):
        one = A.weight_table(r, scheme).withColumn("scheme", F.lit(scheme))
        out = one if out is None else out.unionByName(one)
    return _r(out)


def bland_altman(spark, sf):
    d = A.bland_altman(B.paired(spark, sf))
    return d.select("n", *[F.round(c, 4).alias(c) for c in ("mean_diff", "sd", "lower", "upper")])


REPS = 40


def bootstrap(spark, sf):
    items = _raters(spark, sf)
    return _r(A.bootstrap(items, lambda d, keys: A.cohen_kappa(d, keys), REPS, 42, ["a", "b"]))


def with_ci(spark, sf):
    """Point value and interval for alpha, in one row."""
    r = B.ratings(spark, sf)
    point = A.krippendorff_alpha(r, "nominal").select(F.col("value").alias("point"))
    ci = A.bootstrap(r, lambda d, keys: A.krippendorff_alpha(d, "nominal", keys), REPS, 7, ["rater", "label"])
    return _r(point.crossJoin(ci.select("lower", "upper", "valid")))


def dawid_skene(spark, sf):
    post, _ = A.dawid_skene(B.ratings(spark, sf), [0, 1, 2, 3])
    return post.select("item", "label", F.round(F.array_max("p"), 3).alias("top"))


def family(spark, sf):
    r = B.gappy(spark, sf)
    families = r.select("rater").distinct().withColumn("family", F.col("rater") % 2)
    return _r(A.family_stratification(r, families))


def leakage(spark, sf):
    w = B.win_rates(spark, sf)
    families = w.select(F.col("model_i").alias("model")).distinct().withColumn("family", F.length("model") % 2)
    return _r(A.preference_leakage(w, families))


def mandel(spark, sf):
    return _r(A.mandel(B.labs(spark, sf)))


def msa(spark, sf):
    """Gauge statistics of the quantity by part type: parts' spread against the rest."""
    li, p = B.table(spark, sf, "lineitem"), B.table(spark, sf, "part")
    cells = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"))
    s = cells.groupBy("p_type").agg(F.stddev_samp("m").alias("sp"), F.avg("s").alias("sg"))
    return s.select("p_type", A.distinct_categories(F.col("sp") * 100, F.col("sg")).alias("ndc"), F.round(A.precision_to_tolerance(F.col("sg"), F.lit(200.0)), 6).alias("pt"))


QUERIES = {
    "irr_cohen_kappa": cohen, "irr_cohen_weighted": cohen_weighted, "irr_fleiss": fleiss, "irr_kripp_alpha": alpha, "irr_gwet_ac": gwet,
    "irr_weights": weights, "irr_bland_altman": bland_altman, "irr_bootstrap": bootstrap, "irr_with_ci": with_ci, "irr_dawid_skene": dawid_skene,
    "irr_family_strat": family, "irr_pls": leakage, "irr_mandel_hk": mandel, "irr_msa": msa,
}

_PAIR = f"WITH {B.RATINGS}, p AS (SELECT item, x.label AS a, y.label AS b FROM ratings x JOIN ratings y USING (item) WHERE x.rater = 'click' AND y.rater = 'view')"
_ALPHA_PARTS = """ n AS (SELECT item, label, count(*) AS c FROM ratings GROUP BY 1, 2), m AS (SELECT item, sum(c) AS m FROM n GROUP BY 1 HAVING sum(c) >= 2),
 v AS (SELECT n.item, label, c, m FROM n JOIN m USING (item)), t AS (SELECT label, sum(c) AS nc, sum(sum(c)) OVER (ORDER BY label) AS cum FROM v GROUP BY 1),
 size AS (SELECT sum(nc) AS n FROM t),
 lv AS (SELECT unnest(['nominal', 'ordinal', 'interval', 'ratio']) AS level),
 d AS (SELECT level, x.label AS la, y.label AS lb, x.nc AS na, y.nc AS nb, CASE level WHEN 'nominal' THEN 1.0::DOUBLE WHEN 'interval' THEN ((x.label - y.label) ** 2)::DOUBLE
   WHEN 'ratio' THEN CASE WHEN x.label + y.label = 0 THEN 0.0::DOUBLE ELSE ((x.label - y.label)::DOUBLE / (x.label + y.label)) ** 2 END
   ELSE ((y.cum - x.cum + x.nc - (x.nc + y.nc) / 2.0::DOUBLE)) ** 2 END AS d FROM lv, t x, t y WHERE x.label < y.label),
 o AS (SELECT a.label AS la, b.label AS lb, sum(a.c * b.c / (a.m - 1.0::DOUBLE)) AS o FROM v a JOIN v b ON a.item = b.item AND a.label < b.label GROUP BY 1, 2),
 e AS (SELECT d.level, coalesce(sum(o.o * d.d), 0) AS dobs, sum(na * nb * d.d) / (any_value(size.n) - 1) AS dexp FROM size, d LEFT JOIN o USING (la, lb) GROUP BY 1)"""
_FAMILY_ALPHA = """ alphas AS (SELECT subset, 1 - coalesce(dobs, 0) / dexp AS value FROM (SELECT subset, sum(nc) AS n, (sum(nc) * sum(nc) - sum(nc * nc)) / 2.0::DOUBLE / (sum(nc) - 1) AS dexp FROM (SELECT subset, label, sum(c) AS nc FROM v GROUP BY 1, 2) GROUP BY 1) de
  LEFT JOIN (SELECT subset, sum((m * m - s2) / (m - 1.0::DOUBLE)) / 2 AS dobs FROM (SELECT subset, item, any_value(m) AS m, sum(c * c) AS s2 FROM v GROUP BY 1, 2) GROUP BY 1) USING (subset) WHERE dexp > 1e-15)"""
_PROBIT = """CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END * (sqrt(-2 * ln(least({p}, 1 - {p}))) - (2.515517::DOUBLE + sqrt(-2 * ln(least({p}, 1 - {p}))) * (0.802853::DOUBLE + sqrt(-2 * ln(least({p}, 1 - {p}))) * 0.010328::DOUBLE))
 / (1 + sqrt(-2 * ln(least({p}, 1 - {p}))) * (1.432788::DOUBLE + sqrt(-2 * ln(least({p}, 1 - {p}))) * (0.189269::DOUBLE + sqrt(-2 * ln(least({p}, 1 - {p}))) * 0.001308::DOUBLE))))"""


def probit_sql(p: str) -> str:
    return "(" + _PROBIT.replace("{p}", f"({p})") + ")"


_KAPPA_BY_REP = """ k AS (SELECT rep, count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po FROM s GROUP BY 1),
 g AS (SELECT rep, sum(ca * cb) AS s FROM (SELECT rep, label, sum(x) AS ca, sum(y) AS cb FROM (SELECT rep, a AS label, 1 AS x, 0 AS y FROM s UNION ALL SELECT rep, b, 0, 1 FROM s) GROUP BY 1, 2) GROUP BY 1),
 vals AS (SELECT rep, CASE WHEN abs(1 - po) < 1e-15 THEN 1.0 ELSE (po - g.s / (n * n)) / (1 - g.s / (n * n)) END AS value FROM k JOIN g USING (rep)),
 ranked AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS b FROM vals)
SELECT round(max(CASE WHEN k = ceil(0.025::DOUBLE * b) THEN value END), 6) AS lower, round(max(CASE WHEN k = ceil((1 - 0.025::DOUBLE) * b) THEN value END), 6) AS upper, max(b) AS valid FROM ranked"""

ORACLES = {
    "irr_cohen_kappa": f"""{_PAIR}, m AS (SELECT label, sum(x) AS ca, sum(y) AS cb FROM (SELECT a AS label, 1 AS x, 0 AS y FROM p UNION ALL SELECT b, 0, 1 FROM p) GROUP BY 1),
 z AS (SELECT (SELECT avg(CAST(a = b AS DOUBLE)) FROM p) AS po, (SELECT sum(ca * cb) FROM m) / (SELECT count(*) ** 2 FROM p) AS pe)
 SELECT round((po - pe) / (1 - pe), 6) AS value, 'ok' AS status FROM z""",
    "irr_cohen_weighted": f"""{_PAIR}, w AS (SELECT unnest(['linear', 'quadratic']) AS scheme)
 SELECT scheme, round(1 - (SELECT avg(CASE scheme WHEN 'linear' THEN abs(a - b) ELSE (a - b) ** 2 END) FROM p) / (SELECT avg(CASE scheme WHEN 'linear' THEN abs(x.a - y.b) ELSE (x.a - y.b) ** 2 END) FROM p x, p y), 6) AS value, 'ok' AS status FROM w""",
    "irr_fleiss": f"""WITH {B.RATINGS}, n AS (SELECT item, label, count(*) AS c FROM ratings GROUP BY 1, 2), i AS (SELECT item, sum(c) AS k, sum(c * c) AS s2 FROM n GROUP BY 1),
 e AS (SELECT sum(c * c) / sum(c) ** 2 AS pe FROM (SELECT label, sum(c) AS c FROM n GROUP BY 1))
 SELECT round(((SELECT avg((s2 - k) / (k * (k - 1.0::DOUBLE))) FROM i) - pe) / (1 - pe), 6) AS value, 'ok' AS status FROM e""",
    "irr_kripp_alpha": f"WITH {B.GAPPY},{_ALPHA_PARTS} SELECT level, round(1 - dobs / dexp, 6) AS value, 'ok' AS status FROM e",
    "irr_weights": f"""WITH {B.GAPPY}, l AS (SELECT label, row_number() OVER (ORDER BY label) AS i FROM (SELECT DISTINCT label FROM ratings)), q AS (SELECT count(*) AS q FROM l), s AS (SELECT unnest(['identity', 'linear', 'quadratic', 'ordinal']) AS scheme)
 SELECT a.label AS ca, b.label AS cb, round(CASE scheme WHEN 'identity' THEN CAST(a.i = b.i AS DOUBLE) WHEN 'linear' THEN 1 - abs(a.i - b.i) / (q - 1.0::DOUBLE) WHEN 'quadratic' THEN 1 - (a.i - b.i) ** 2 / (q - 1.0::DOUBLE) ** 2 ELSE 1 - (abs(a.i - b.i) + 1) * abs(a.i - b.i) / (q * (q - 1.0::DOUBLE)) END, 6) AS w, scheme FROM l a, l b, q, s""",
    "irr_gwet_ac": f"""WITH {B.GAPPY}, l AS (SELECT label, row_number() OVER (ORDER BY label) AS i FROM (SELECT DISTINCT label FROM ratings)), q AS (SELECT count(*) AS q FROM l), s AS (SELECT unnest(['identity', 'linear', 'quadratic', 'ordinal']) AS scheme),
 w AS (SELECT scheme, a.label AS ca, b.label AS cb, CASE scheme WHEN 'identity' THEN CAST(a.i = b.i AS DOUBLE) WHEN 'linear' THEN 1 - abs(a.i - b.i) / (q - 1.0::DOUBLE) WHEN 'quadratic' THEN 1 - (a.i - b.i) ** 2 / (q - 1.0::DOUBLE) ** 2 ELSE 1 - (abs(a.i - b.i) + 1) * abs(a.i - b.i) / (q * (q - 1.0::DOUBLE)) END AS w FROM l a, l b, q, s),
 r AS (SELECT item, rater, label, count(*) OVER (PARTITION BY item) AS m FROM ratings),
 pa AS (SELECT scheme, avg(a) AS pa FROM (SELECT scheme, x.item, sum(w) / any_value(x.m * (x.m - 1.0::DOUBLE)) AS a FROM r x JOIN r y ON x.item = y.item AND x.rater <> y.rater JOIN w ON w.ca = x.label AND w.cb = y.label GROUP BY 1, 2) GROUP BY 1),
 pi AS (SELECT label, sum(1.0::DOUBLE / m) / (SELECT count(DISTINCT item) FROM r) AS pi FROM r GROUP BY 1),
 pe AS (SELECT scheme, sum(w) * (SELECT sum(pi * (1 - pi)) FROM pi) / (SELECT q * (q - 1.0::DOUBLE) FROM q) AS pe FROM w GROUP BY 1)
 SELECT scheme, round((pa - pe) / (1 - pe), 6) AS value, 'ok' AS status FROM pa JOIN pe USING (scheme)""",
    "irr_bland_altman": f"WITH {B.PAIRED} SELECT count(*) AS n, round(avg(x - y), 4) AS mean_diff, round(stddev_samp(x - y), 4) AS sd, round(avg(x - y) - 1.96::DOUBLE * stddev_samp(x - y), 4) AS lower, round(avg(x - y) + 1.96::DOUBLE * stddev_samp(x - y), 4) AS upper FROM paired",
    "irr_bootstrap": f"""{_PAIR}, i AS (SELECT row_number() OVER (ORDER BY item) - 1 AS idx, a, b FROM p), c AS (SELECT count(*) AS n FROM p),
 dr AS (SELECT rep, pos, CAST(floor({duck_uniform("'42:' || rep || ':' || pos")} * n) AS BIGINT) AS idx FROM c, range({REPS}) t(rep), LATERAL (SELECT unnest(range(n)) AS pos)),
 s AS (SELECT rep, pos, a, b FROM dr JOIN i USING (idx)),{_KAPPA_BY_REP}""",
    "irr_with_ci": f"""WITH {B.RATINGS}, ids AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM ratings)), c AS (SELECT count(*) AS nn FROM ids),
 dr AS (SELECT rep, pos, CAST(floor({duck_uniform("'7:' || rep || ':' || pos")} * nn) AS BIGINT) AS idx FROM c, range({REPS}) t(rep), LATERAL (SELECT unnest(range(nn)) AS pos)),
 u AS (SELECT rep AS subset, pos AS item, label FROM dr JOIN ids USING (idx) JOIN ratings USING (item) UNION ALL SELECT -1, item, label FROM ratings),
 v AS (SELECT subset, item, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY subset, item) AS m FROM u GROUP BY 1, 2, 3),{_FAMILY_ALPHA},
 ranked AS (SELECT value, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS b FROM alphas WHERE subset >= 0)
 SELECT round((SELECT value FROM alphas WHERE subset = -1), 6) AS point, round(max(CASE WHEN k = ceil(0.025::DOUBLE * b) THEN value END), 6) AS lower, round(max(CASE WHEN k = ceil((1 - 0.025::DOUBLE) * b) THEN value END), 6) AS upper, max(b) AS valid FROM ranked""",
    "irr_family_strat": f"""WITH {B.GAPPY}, f AS (SELECT DISTINCT rater, rater % 2 AS family FROM ratings),
 sub AS (SELECT 'overall' AS subset, rater FROM f UNION ALL SELECT 'family:' || family, rater FROM f WHERE family IN (SELECT family FROM f GROUP BY 1 HAVING count(*) >= 2)
  UNION ALL SELECT 'pair:' || a.rater || '|' || b.rater, unnest([a.rater, b.rater]) FROM f a JOIN f b ON a.family < b.family),
 u AS (SELECT subset, item, label FROM ratings JOIN sub USING (rater)), v0 AS (SELECT subset, item, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY subset, item) AS m FROM u GROUP BY 1, 2, 3),
 v AS (SELECT * FROM v0 WHERE m >= 2),{_FAMILY_ALPHA},
 z AS (SELECT avg(CASE WHEN subset = 'overall' THEN value END) AS overall, avg(CASE WHEN subset LIKE 'family:%' THEN value END) AS within, avg(CASE WHEN subset LIKE 'pair:%' THEN value END) AS between_ FROM alphas)
 SELECT round(overall, 6) AS overall, round(within, 6) AS within, round(between_, 6) AS "between", round(within - between_, 6) AS bias_burden FROM z""",
    "irr_pls": f"""WITH {B.WINS}, x AS (SELECT a.model_i, a.model_j, a.wr AS wij, b.wr AS wji, c.wr AS wii, e.wr AS wjj FROM wins a JOIN wins b ON a.model_i = b.model_j AND a.model_j = b.model_i AND a.model_i < a.model_j
  JOIN wins c ON c.model_i = a.model_i AND c.model_j = a.model_i JOIN wins e ON e.model_i = a.model_j AND e.model_j = a.model_j)
 SELECT model_i, model_j, CASE WHEN length(model_i) % 2 = length(model_j) % 2 THEN 'same_family' ELSE 'cross_family' END AS regime,
  round(0.5 * ((wii - (wii + wij) / 2) / ((wii + wij) / 2) + (wjj - (wjj + wji) / 2) / ((wjj + wji) / 2)), 6) AS pls FROM x""",
    "irr_mandel_hk": f"""WITH {B.LABS}, l AS (SELECT lab, count(x) AS n, avg(x) AS mean, var_samp(x) AS v FROM labs GROUP BY 1), a AS (SELECT count(*)::DOUBLE AS p, avg(mean) AS grand, stddev_samp(mean) AS sb, avg(v) AS w, any_value(n)::DOUBLE AS n1 FROM l),
 z AS (SELECT *, -{probit_sql("0.05::DOUBLE / 2 / p")} AS zt, {probit_sql("1 - 0.05::DOUBLE / p")} AS zf, p - 2 AS df, 2 / (9 * (n1 - 1)) AS fa, 2 / (9 * ((p - 1) * (n1 - 1))) AS fb FROM a),
 q AS (SELECT *, zt + (zt ** 3 + zt) / (4 * df) + (5 * zt ** 5 + 16 * zt ** 3 + 3 * zt) / (96 * df ** 2) + (3 * zt ** 7 + 19 * zt ** 5 + 17 * zt ** 3 - 15 * zt) / (384 * df ** 3) AS t,
  (((1 - fb) * (1 - fa) + zf * sqrt((1 - fb) ** 2 * fa + (1 - fa) ** 2 * fb - fa * fb * zf * zf)) / ((1 - fb) ** 2 - fb * zf * zf)) ** 3 AS f FROM z),
 c AS (SELECT *, (p - 1) * t / sqrt(p * (p - 2 + t * t)) AS hc, sqrt(p * f / (p - 1 + f)) AS kc FROM q)
 SELECT lab, round((mean - grand) / sb, 6) AS h, round(sqrt(v / w), 6) AS k, round(hc, 6) AS h_crit, round(kc, 6) AS k_crit, abs((mean - grand) / sb) > hc AS h_flag, sqrt(v / w) > kc AS k_flag, 'ok' AS status FROM l, c""",
    "irr_msa": """WITH c AS (SELECT p_type, p_brand, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), s AS (SELECT p_type, stddev_samp(m) AS sp, avg(s) AS sg FROM c GROUP BY 1)
 SELECT p_type, CAST(floor(1.41::DOUBLE * sp * 100 / sg) AS BIGINT) AS ndc, round(6 * sg / 200, 6) AS pt FROM s""",
}
