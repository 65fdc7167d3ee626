"""Sensitivity analysis of the Ishigami function and of grids made from the test tables.

Designs are generated, so these queries read no table but those of the analyses of variance.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rng
from ..functions.rng import duck_uniform
from ..operators import designs as D
from ..operators import sensitivity as S
from . import bindings as B

N, K = 2000, 3
AXES = [("template", ["plain", "chat", "cot", "few", "none"]), ("order", [0, 1, 2, 3]), ("temperature", [0.0, 0.3, 0.7, 1.0])]


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _xs(k=K):
    return [F.col(f"x{j}") for j in range(k)]


def _base(spark, k, n=N):
    """n points of k hash-uniform coordinates."""
    return spark.range(n).select("id", *[rng.uniform("gsa", j, F.col("id")).alias(f"x{j}") for j in range(k)])


def _points(spark, n=N):
    return _base(spark, K, n).withColumn("y", S.ishigami(_xs()))


def _wide(spark, second=False, n=N):
    d = D.saltelli(_base(spark, 2 * K, n), K, second).withColumn("y", S.ishigami(_xs()))
    return S.by_base_row(d, K, second)


def sobol_seq(spark, sf):
    return D.sobol(spark, 256, 6)


def lhs(spark, sf):
    return _r(D.latin_hypercube(spark, 200, 3, 42))


def saltelli(spark, sf):
    d = D.saltelli(_base(spark, 2 * K, 100), K, True)
    return _r(d.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{j}").alias(f"s{j}") for j in range(K)]))


def manifest(spark, sf):
    d = D.manifest(D.saltelli(_base(spark, 2 * K, 100), K), 100, AXES)
    return d.drop("base_row")


def sobol_si(spark, sf):
    return _r(S.sobol_indices(_wide(spark), K))


def estimators(spark, sf):
    w = _wide(spark)
    return _r(S.sobol_indices(w, K, kind="jansen").withColumn("kind", F.lit("jansen")).unionByName(S.sobol_indices(w, K, kind="janon").withColumn("kind", F.lit("janon"))))


def owen(spark, sf):
    d = D.owen(_base(spark, 3 * K), K).withColumn("y", S.ishigami(_xs()))
    return _r(S.owen_indices(d, K))


def sobol_s2(spark, sf):
    return _r(S.second_order(_wide(spark, True), K))


def sobol_ci(spark, sf):
    return _r(S.sobol_intervals(_wide(spark, n=300), K, 30, 42))


def _analysis(spark):
    w = _wide(spark, n=300)
    return S.sobol_indices(w, K).join(S.sobol_intervals(w, K, 30, 42), "factor")


def analyze(spark, sf):
    return _r(S.analysis(_wide(spark, True, 300), K, 30, 42, True, _points(spark, 1000)), 5)


def diag(spark, sf):
    return S.diagnostics(_analysis(spark)).withColumn("factor", F.coalesce("factor", F.lit(-1)))


def gates(spark, sf):
    c = B.trials(spark, sf).groupBy("task_id", "agent_id").agg(F.avg(F.col("passed").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))
    c = c.withColumn("saltelli_index", F.length("task_id") * 10 + F.substring("agent_id", 2, 2).cast("int"))
    return S.gates(c, 60)


def borgonovo(spark, sf):
    return _r(S.borgonovo(_points(spark, 1000), K), 5)


def morris(spark, sf):
    d = D.morris(spark, 200, K, 42).withColumn("y", S.ishigami(_xs()))
    return _r(S.elementary_effects(d, K))


def fast(spark, sf):
    n = 513
    d, omega = D.efast(spark, n, K)
    return _r(S.fast_indices(d.withColumn("y", S.ishigami(_xs())), omega, n), 5)


def rbd_fast(spark, sf):
    return _r(S.rbd_fast(_points(spark), K))


def given_data(spark, sf):
    return _r(S.given_data(_points(spark), K))


def pawn(spark, sf):
    return _r(S.pawn(_points(spark), K))


def _gradients(spark):
    t = [(2 * c - 1) * math.pi for c in _xs()]
    return _points(spark).select(
        "y", (F.cos(t[0]) * (1 + 0.1 * t[2] ** 4)).alias("d0"), (14 * F.sin(t[1]) * F.cos(t[1])).alias("d1"), (0.4 * t[2] ** 3 * F.sin(t[0])).alias("d2")
    )


def dgsm(spark, sf):
    return _r(S.dgsm(_gradients(spark), [math.pi**2 / 3] * 3, K))


def regression(spark, sf):
    return _r(S.regression(_points(spark), K))


def qosa(spark, sf):
    return _r(S.qosa(_points(spark), K))


def shapley(spark, sf):
    return _r(S.shapley(S.ishigami, spark, K, 60, 10, 4, 42))


def pce(spark, sf):
    return _r(S.chaos(_points(spark), K, 5)[1])


def sparse_pce(spark, sf):
    return _r(S.chaos(_points(spark), K, 6, 0.75, 12)[1])


def hdmr(spark, sf):
    return _r(S.hdmr(S.chaos(_points(spark), K, 5)[0], spark))


def active_subspace(spark, sf):
    values, _, dim = S.active_subspace(_gradients(spark), K)
    return _r(spark.createDataFrame([(i, float(v), i < dim) for i, v in enumerate(values)], "rank int, eigenvalue double, active boolean"), 4)


def discrepancy(spark, sf):
    p, out = D.sobol(spark, 64, K), None
    for kind in ("centred", "wraparound", "modified", "star"):
        one = S.discrepancy(p, K, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return _r(out, 8)


def plackett_burman(spark, sf):
    rows = D.plackett_burman(7)
    d = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"x{j} double" for j in range(7)))
    d = d.withColumn("y", 3 * F.col("x0") - 2 * F.col("x1") + F.col("x2") * 0.5)
    return _r(S.factorial_effects(d, 7))


def iman_conover(spark, sf):
    t = [[1.0, 0.7, 0.0], [0.7, 1.0, -0.4], [0.0, -0.4, 1.0]]
    p = D.iman_conover(_base(spark, 3, 500), t, 42)
    return p.agg(*[F.round(F.corr(f"x{i}", f"x{j}"), 2).alias(f"c{i}{j}") for i, j in ((0, 1), (0, 2), (1, 2))])


def distributions(spark, sf):
    u = rng.uniform("dist", F.col("id"))
    kinds = {"uniform": (2, 5), "triangular": (0, 1, 4), "normal": (1, 2), "lognormal": (0, 0.5), "bernoulli": (0.3,), "weibull": (1.5, 2), "exponential": (0.7,)}
    d = spark.range(1000).select(*[D.quantile(k, u, *p).alias(k) for k, p in kinds.items()])
    return _r(d.agg(*[F.avg(k).alias(k) for k in kinds]), 5)


def distributions_numeric(spark, sf):
    u = rng.uniform("dist", F.col("id"))
    d = spark.range(1000).select(D.quantile("beta", u, 2.0, 3.0).alias("beta"), D.quantile("gamma", u, 2.0, 1.5).alias("gamma"))
    return _r(d.agg(F.avg("beta").alias("beta"), F.avg("gamma").alias("gamma")), 3)


def testfns(spark, sf):
    p = _base(spark, 3).select(S.ishigami(_xs()).alias("i"), S.sobol_g(_xs(), [0.0, 1.0, 9.0]).alias("g"))
    return _r(p.agg(F.avg("i").alias("ishigami"), F.avg("g").alias("sobol_g"), F.var_pop("i").alias("v_ishigami"), F.var_pop("g").alias("v_g")), 5)


def gtheory(spark, sf):
    c = S.g_study(B.grid(spark, sf))
    return _r(spark.createDataFrame([(k, float(v)) for k, v in c.items()], "name string, value double"), 4)


def dstudy(spark, sf):
    c = S.g_study(B.grid(spark, sf))
    rows = [(f"d_study_{k}_coefficient_n_i_{i}_n_r_{r}", float(v)) for i in (1, 4, 10) for r in (1, 2, 5) for k, v in S.d_study(c, i, r).items()]
    return _r(S.d_study_table(spark.createDataFrame(rows, "name string, value double")), 4)


def anova(spark, sf):
    return _r(S.anova(B.grid(spark, sf), ["p", "i", "r"]).select("effect", "df", "ss", "ms", "fraction", F.coalesce("f", F.lit(0.0)).alias("f")), 4)


QUERIES = {
    "gsa_sobol_seq": sobol_seq, "gsa_lhs": lhs, "gsa_saltelli": saltelli, "gsa_manifest": manifest, "gsa_sobol_si": sobol_si, "gsa_jansen_janon": estimators, "gsa_owen": owen,
    "gsa_sobol_s2": sobol_s2, "gsa_sobol_ci": sobol_ci, "gsa_analyze": analyze, "gsa_diag": diag, "gsa_gates": gates, "gsa_borgonovo": borgonovo, "gsa_morris": morris,
    "gsa_fast": fast, "gsa_rbd_fast": rbd_fast, "gsa_given_data": given_data, "gsa_pawn": pawn, "gsa_dgsm": dgsm, "gsa_regression": regression, "gsa_qosa": qosa,
    "gsa_shapley": shapley, "gsa_pce": pce, "gsa_sparse_pce": sparse_pce, "gsa_hdmr": hdmr, "gsa_active_subspace": active_subspace, "gsa_discrepancy": discrepancy,
    "gsa_plackett_burman": plackett_burman, "gsa_iman_conover": iman_conover, "gsa_distributions": distributions, "gsa_distributions_numeric": distributions_numeric,
    "gsa_testfns": testfns, "gsa_gtheory": gtheory, "gsa_dstudy_table": dstudy, "gsa_anova": anova,
}


def _u(j, i="id"):
    return duck_uniform(f"'gsa:{j}:' || {i}")


def _ish(*x):
    t = [f"((2 * ({c}) - 1) * pi())" for c in x]
    return f"(sin({t[0]}) + 7 * sin({t[1]}) ** 2 + 0.1::DOUBLE * {t[2]} ** 4 * sin({t[0]}))"


def _pts(n=N, k=K):
    return f"b AS (SELECT id, {', '.join(f'{_u(j)} AS x{j}' for j in range(k))} FROM range({n}) t(id))"


_POINTS = f"WITH {_pts()}, p AS (SELECT *, {_ish('x0', 'x1', 'x2')} AS y FROM b), l AS (SELECT id, y, f.factor, CASE f.factor WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS x FROM p, (SELECT unnest([0, 1, 2]) AS factor) f)"


def _wide_sql(n=N):
    ab = [["x0", "x1", "x2"], ["x3", "x4", "x5"]]
    cols = [f"{_ish(*ab[0])} AS fa", f"{_ish(*ab[1])} AS fb"]
    for j in range(K):
        cols.append(f"{_ish(*[ab[1][i] if i == j else ab[0][i] for i in range(K)])} AS ab{j}")
        cols.append(f"{_ish(*[ab[0][i] if i == j else ab[1][i] for i in range(K)])} AS ba{j}")
    return f"WITH {_pts(n, 2 * K)}, w AS (SELECT id, {', '.join(cols)} FROM b)"


def _union(f):
    return " UNION ALL ".join(f(j) for j in range(K))


_S1 = "avg(fb * (ab{j} - fa)) / var_pop(fa)"
_DIRECTIONS = ", ".join(f"({d}, {b}, {v})" for d in range(6) for b, v in enumerate(D.direction_numbers(d)))
_LHS = "rk AS (SELECT id, d, row_number() OVER (PARTITION BY d ORDER BY md5('42:' || d || ':' || id)) - 1 AS r FROM range(200) t(id), range(3) s(d))"
_SLICES = "sl AS (SELECT *, ntile({n}) OVER (PARTITION BY factor ORDER BY x, id) AS s FROM l)"
_LEVEL = {name: [str(v) for v in levels] for name, levels in AXES}


def _manifest_sql():
    blocks = {"A": "x0,x1,x2", "B": "x3,x4,x5", "AB0": "x3,x1,x2", "AB1": "x0,x4,x2", "AB2": "x0,x1,x5"}
    parts = []
    for pos, (name, xs) in enumerate(blocks.items()):
        x = xs.split(",")
        levels = ", ".join(f"{_LEVEL[a]}[CAST(least(floor({x[j]} * {len(_LEVEL[a])}), {len(_LEVEL[a]) - 1}) AS INT) + 1] AS \"{a}\"" for j, (a, _) in enumerate(AXES))
        parts.append(f"SELECT {pos * 100} + id AS saltelli_index, '{name}' AS block, {levels} FROM b")
    return f"WITH {_pts(100, 6)}, c AS ({' UNION ALL '.join(parts)}) SELECT 'c' || lpad(CAST(saltelli_index AS VARCHAR), 5, '0') AS cell_id, * FROM c"


def _saltelli_sql():
    a, b = [0, 1, 2], [3, 4, 5]
    blocks = {"A": a, "B": b} | {f"AB{j}": [b[i] if i == j else a[i] for i in range(3)] for j in range(3)} | {f"BA{j}": [a[i] if i == j else b[i] for i in range(3)] for j in range(3)}
    return f"WITH {_pts(100, 6)} " + " UNION ALL ".join(f"SELECT '{n}' AS block, count(*) AS n, " + ", ".join(f"round(sum(x{c[j]}), 6) AS s{j}" for j in range(3)) + " FROM b" for n, c in blocks.items())


def _grid_effects():
    """Means of every subset of the axes on each cell, by windows."""
    parts = {"p": "PARTITION BY p", "i": "PARTITION BY i", "r": "PARTITION BY r", "pi": "PARTITION BY p, i", "pr": "PARTITION BY p, r", "ir": "PARTITION BY i, r"}
    cols = ", ".join(f"avg(x) OVER ({v}) AS m_{k}" for k, v in parts.items())
    return f"""WITH {B.GRID}, m AS (SELECT *, avg(x) OVER () AS g, {cols} FROM grid),
 e AS (SELECT 'p' AS effect, sum((m_p - g) ** 2) AS ss FROM m UNION ALL SELECT 'i', sum((m_i - g) ** 2) FROM m UNION ALL SELECT 'r', sum((m_r - g) ** 2) FROM m
  UNION ALL SELECT 'ixp', sum((m_pi - m_p - m_i + g) ** 2) FROM m UNION ALL SELECT 'pxr', sum((m_pr - m_p - m_r + g) ** 2) FROM m UNION ALL SELECT 'ixr', sum((m_ir - m_i - m_r + g) ** 2) FROM m
  UNION ALL SELECT 'ixpxr', sum((x - m_pi - m_pr - m_ir + m_p + m_i + m_r - g) ** 2) FROM m),
 n AS (SELECT count(DISTINCT p) - 1 AS np, count(DISTINCT i) - 1 AS ni, count(DISTINCT r) - 1 AS nr FROM grid),
 a AS (SELECT effect, CASE effect WHEN 'p' THEN np WHEN 'i' THEN ni WHEN 'r' THEN nr WHEN 'ixp' THEN np * ni WHEN 'pxr' THEN np * nr WHEN 'ixr' THEN ni * nr ELSE np * ni * nr END AS df, ss FROM e, n)"""


def _owen_sql():
    a, b, c = (["x0", "x1", "x2"], ["x3", "x4", "x5"], ["x6", "x7", "x8"])
    cols = [f"{_ish(*a)} AS fa", f"{_ish(*b)} AS fb"]
    for j in range(K):
        cols.append(f"{_ish(*[c[i] if i == j else a[i] for i in range(K)])} AS ca{j}")
        cols.append(f"{_ish(*[a[i] if i == j else b[i] for i in range(K)])} AS ba{j}")
    return f"WITH {_pts(N, 3 * K)}, w AS (SELECT {', '.join(cols)} FROM b) " + _union(lambda j: f"SELECT {j} AS factor, round(avg((fa - ca{j}) * (ba{j} - fb)) / var_pop(fa), 6) AS s1 FROM w")


ORACLES = {
    "gsa_owen": _owen_sql(),
    "gsa_sobol_seq": f"""WITH v(d, b, v) AS (VALUES {_DIRECTIONS}), x AS (SELECT id, d, bit_xor(CASE WHEN (xor(id, id >> 1) >> b) & 1 = 1 THEN v ELSE 0 END) / 1073741824.0::DOUBLE AS x FROM range(256) t(id), v GROUP BY 1, 2)
 SELECT id, {", ".join(f"max(x) FILTER (d = {d}) AS x{d}" for d in range(6))} FROM x GROUP BY 1""",
    "gsa_lhs": f"WITH {_LHS}, x AS (SELECT id, d, (r + {duck_uniform("'42:u:' || d || ':' || id")}) / 200 AS x FROM rk) SELECT id, {', '.join(f'round(max(x) FILTER (d = {d}), 6) AS x{d}' for d in range(3))} FROM x GROUP BY 1",
    "gsa_saltelli": _saltelli_sql(),
    "gsa_manifest": _manifest_sql(),
    "gsa_sobol_si": f"{_wide_sql()} " + _union(lambda j: f"SELECT {j} AS factor, round({_S1.format(j=j)}, 6) AS s1, round(avg((fa - ab{j}) ** 2) / 2 / var_pop(fa), 6) AS st FROM w"),
    "gsa_jansen_janon": f"{_wide_sql()} " + _union(lambda j: f"SELECT 'jansen' AS kind, {j} AS factor, round(1 - avg((fb - ab{j}) ** 2) / 2 / var_pop(fa), 6) AS s1, round(avg((fa - ab{j}) ** 2) / 2 / var_pop(fa), 6) AS st FROM w")
    + " UNION ALL " + _union(lambda j: f"SELECT 'janon', {j}, round((avg(fb * ab{j}) - avg((fb + ab{j}) / 2) ** 2) / (avg((fb * fb + ab{j} * ab{j}) / 2) - avg((fb + ab{j}) / 2) ** 2), 6), round(avg((fa - ab{j}) ** 2) / 2 / var_pop(fa), 6) FROM w"),
    "gsa_sobol_s2": f"{_wide_sql()} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(avg(ba{i} * ab{j} - fa * fb) / var_pop(fa) - {_S1.format(j=i)} - {_S1.format(j=j)}, 6) AS s2 FROM w" for i in range(K) for j in range(i + 1, K)),
    "gsa_sobol_ci": f"""{_wide_sql(300)}, dr AS (SELECT rep, CAST(floor({duck_uniform("'42:' || rep || ':' || pos")} * 300) AS BIGINT) AS id FROM range(30) t(rep), range(300) s(pos)), x AS (SELECT * FROM dr JOIN w USING (id)),
 s AS ({_union(lambda j: f"SELECT rep, {j} AS factor, {_S1.format(j=j)} AS s1, avg((fa - ab{j}) ** 2) / 2 / var_pop(fa) AS st FROM x GROUP BY rep")})
 SELECT factor, round(quantile_cont(s1, 0.025), 6) AS s1_low, round(quantile_cont(s1, 0.975), 6) AS s1_high, round(quantile_cont(st, 0.025), 6) AS st_low, round(quantile_cont(st, 0.975), 6) AS st_high FROM s GROUP BY 1""",
    "gsa_gates": f"""WITH {B.TRIALS}, c AS (SELECT length(task_id) * 10 + CAST(substr(agent_id, 2) AS INT) AS k, avg(CAST(passed AS DOUBLE)) AS a, count(*) AS n FROM trials GROUP BY task_id, agent_id)
 SELECT count(*) FILTER (n = 0) AS empty_cells, count(*) FILTER (a IS NULL) AS missing, 60 - count(DISTINCT k) AS absent, count(*) - count(DISTINCT k) AS repeated, count(*) FILTER (k < 0 OR k >= 60) AS out_of_range FROM c""",
    "gsa_given_data": f"{_POINTS}, {_SLICES.format(n=20)}, g AS (SELECT factor, s, count(y) AS n, var_pop(y) AS v FROM sl GROUP BY 1, 2) SELECT factor, round(least(1, greatest(0, 1 - sum(n * v) / sum(n) / (SELECT var_pop(y) FROM p))), 6) AS s1 FROM g GROUP BY 1",
    "gsa_pawn": f"""{_POINTS}, {_SLICES.format(n=10)}, c AS (SELECT *, cume_dist() OVER (PARTITION BY factor ORDER BY y) AS f, cume_dist() OVER (PARTITION BY factor, s ORDER BY y) AS f0 FROM sl), d AS (SELECT *, coalesce(lag(f0) OVER (PARTITION BY factor, s ORDER BY y), 0) AS b FROM c),
 k AS (SELECT factor, s, max(greatest(abs(f0 - f), abs(b - f))) AS ks FROM d GROUP BY 1, 2) SELECT factor, round(min(ks), 6) AS least, round(median(ks), 6) AS median, round(max(ks), 6) AS most FROM k GROUP BY 1""",
    "gsa_qosa": f"""{_POINTS}, {_SLICES.format(n=20)}, q AS (SELECT factor, s, quantile_cont(y, 0.5) AS q FROM sl GROUP BY 1, 2), z AS (SELECT quantile_cont(y, 0.5) AS q0 FROM p)
 SELECT factor, round(1 - avg((y - q) * (0.5 - CAST(y <= q AS DOUBLE))) / avg((y - q0) * (0.5 - CAST(y <= q0 AS DOUBLE))), 6) AS s FROM sl JOIN q USING (factor, s), z GROUP BY 1""",
    "gsa_rbd_fast": f"""{_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY x, id) AS r, y - avg(y) OVER (PARTITION BY factor) AS c FROM l), q AS (SELECT factor, c, (CASE WHEN r % 2 = 1 THEN (r + 1) / 2.0::DOUBLE ELSE {N} - r / 2.0::DOUBLE + 1 END - 1) * (2 * pi() / {N}) AS s FROM r),
 g AS (SELECT factor, f, avg(c * cos(f * s)) ** 2 + avg(c * sin(f * s)) ** 2 AS p, sum(c * c) / {N} AS v FROM q, range(1, 11) t(f) GROUP BY 1, 2), h AS (SELECT factor, 2 * sum(p) / max(v) AS s FROM g GROUP BY 1) SELECT factor, round(s - 0.01::DOUBLE / 0.99::DOUBLE * (1 - s), 6) AS s1 FROM h""",
    "gsa_dgsm": f"""{_POINTS}, t AS (SELECT y, (2 * x0 - 1) * pi() AS t0, (2 * x1 - 1) * pi() AS t1, (2 * x2 - 1) * pi() AS t2 FROM p), d AS (SELECT y, cos(t0) * (1 + 0.1::DOUBLE * t2 ** 4) AS d0, 14 * sin(t1) * cos(t1) AS d1, 0.4::DOUBLE * t2 ** 3 * sin(t0) AS d2 FROM t)
 {_union(lambda j: f"SELECT {j} AS factor, round(avg(d{j} ** 2), 6) AS nu, round(avg(d{j} ** 2) * 4 / var_pop(y), 6) AS bound FROM d")}""",
    "gsa_testfns": f"WITH {_pts()}, v AS (SELECT {_ish('x0', 'x1', 'x2')} AS i, abs(4 * x0 - 2) * (abs(4 * x1 - 2) + 1) / 2 * (abs(4 * x2 - 2) + 9) / 10 AS g FROM b) SELECT round(avg(i), 5) AS ishigami, round(avg(g), 5) AS sobol_g, round(var_pop(i), 5) AS v_ishigami, round(var_pop(g), 5) AS v_g FROM v",
    "gsa_anova": f"{_grid_effects()} SELECT effect, df, round(ss, 4) AS ss, round(ss / df, 4) AS ms, round(ss / (SELECT sum(ss) FROM a), 4) AS fraction, CASE WHEN effect = 'ixpxr' THEN 0.0 ELSE round(ss / df / (SELECT ss / df FROM a WHERE effect = 'ixpxr'), 4) END AS f FROM a",
    "gsa_plackett_burman": "SELECT unnest(range(7))::INT AS factor, unnest([6.0, -4.0, 1.0, 0.0, 0.0, 0.0, 0.0]) AS effect",
}
