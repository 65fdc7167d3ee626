"""Global sensitivity indices over design and result tables.

Points have columns x0..x(k-1) and y. Sums over rows are plain aggregates; linear algebra is done on the
driver, and only on k x k matrices.
"""

from __future__ import annotations

import uuid

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks, rng


def ishigami(x: list[Column], a: float = 7.0, b: float = 0.1) -> Column:
    """The test function, on coordinates in [0, 1)."""
    u = [(2 * c - 1) * math.pi for c in x]
    return F.sin(u[0]) + a * F.sin(u[1]) ** 2 + b * u[2] ** 4 * F.sin(u[0])


def sobol_g(x: list[Column], a: list[float]) -> Column:
    out = F.lit(1.0)
    for c, ai in zip(x, a):
        out = out * (F.abs(4 * c - 2) + ai) / (1 + ai)
    return out


def ishigami_indices(a: float = 7.0, b: float = 0.1) -> dict[str, list[float]]:
    """Closed-form first-order and total indices."""
    v1, v2, v13 = (1 + b * math.pi**4 / 5) ** 2 / 2, a * a / 8, b * b * math.pi**8 * (1 / 18 - 1 / 50)
    v = v1 + v2 + v13
    return {"s1": [v1 / v, v2 / v, 0.0], "st": [(v1 + v13) / v, v2 / v, v13 / v]}


def sobol_g_indices(a: list[float]) -> list[float]:
    v = [1 / (3 * (1 + ai) ** 2) for ai in a]
    return [x / (math.prod(1 + y for y in v) - 1) for x in v]


def by_base_row(results: DataFrame, k: int, second_order: bool = False, keys=()) -> DataFrame:
    """(keys, base_row, fa, fb, ab0.., ba0..) from (base_row, block, y)."""
    pick = lambda b: F.max(F.when(F.col("block") == b, F.col("y")))
    cols = [pick("A").alias("fa"), pick("B").alias("fb"), *[pick(f"AB{j}").alias(f"ab{j}") for j in range(k)]]
    if second_order:
        cols += [pick(f"BA{j}").alias(f"ba{j}") for j in range(k)]
    return results.groupBy(*keys, "base_row").agg(*cols)


def sobol_indices(wide: DataFrame, k: int, keys=(), kind: str = "saltelli") -> DataFrame:
    """(keys, factor, s1, st). kind: saltelli (first order of 2010), jansen or janon; totals are Jansen's."""
    d = F.var_pop("fa")
    sums = []
    for j in range(k):
        ab = F.col(f"ab{j}")
        if kind == "saltelli":
            s1 = F.avg(F.col("fb") * (ab - F.col("fa"))) / d
        elif kind == "jansen":
            s1 = 1 - F.avg((F.col("fb") - ab) * (F.col("fb") - ab)) / (2 * d)
        else:
            mean = F.avg((F.col("fb") + ab) / 2)
            s1 = (F.avg(F.col("fb") * ab) - mean * mean) / (F.avg((F.col("fb") * F.col("fb") + ab * ab) / 2) - mean * mean)
        sums += [s1.alias(f"s{j}"), (F.avg((F.col("fa") - ab) * (F.col("fa") - ab)) / (2 * d)).alias(f"t{j}")]
    g = wide.groupBy(*keys).agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(j).alias("factor"), F.col(f"s{j}").alias("s1"), F.col(f"t{j}").alias("st")) for j in range(k)]))
    return g.select(*keys, rows.alias("r")).select(*keys, "r.*")


def owen_indices(results: DataFrame, k: int) -> DataFrame:
    """(factor, s1) of an Owen design (base_row, block, y): better than the others for small indices."""
    pick = lambda b: F.max(F.when(F.col("block") == b, F.col("y")))
    wide = results.groupBy("base_row").agg(pick("A").alias("fa"), pick("B").alias("fb"), *[pick(f"CA{j}").alias(f"ca{j}") for j in range(k)], *[pick(f"BA{j}").alias(f"ba{j}") for j in range(k)])
    g = wide.agg(*[(F.avg((F.col("fa") - F.col(f"ca{j}")) * (F.col(f"ba{j}") - F.col("fb"))) / F.var_pop("fa")).alias(f"s{j}") for j in range(k)])
    rows = F.explode(F.array(*[F.struct(F.lit(j).alias("factor"), F.col(f"s{j}").alias("s1")) for j in range(k)]))
    return g.select(rows.alias("r")).select("r.*")


def second_order(wide: DataFrame, k: int) -> DataFrame:
    """(i, j, s2) for i < j."""
    first = {r["factor"]: r["s1"] for r in sobol_indices(wide, k).collect()}  # k rows
    d = F.var_pop("fa")
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    v = wide.agg(*[(F.avg(F.col(f"ba{i}") * F.col(f"ab{j}") - F.col("fa") * F.col("fb")) / d).alias(f"v{i}_{j}") for i, j in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"v{i}_{j}") - first[i] - first[j]).alias("s2")) for i, j in pairs]))
    return v.select(rows.alias("r")).select("r.*")


def sobol_intervals(wide: DataFrame, k: int, reps: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Percentile intervals (linear interpolation) of s1 and st over resampled base rows; values are not computed anew."""
    n = wide.count()
    spark = wide.sparkSession
    numbered = ranks.with_places(wide, {"base_row": "idx"}, "base_row", n).withColumn("idx", F.col("idx") - 1)
    draws = spark.range(reps).select(F.col("id").alias("rep")).crossJoin(spark.range(n).select(F.col("id").alias("pos")))
    draws = draws.select("rep", rng.pick(n, seed, F.col("rep"), F.col("pos")).alias("idx"))
    per = sobol_indices(draws.join(numbered, "idx"), k, ["rep"])
    q = lambda c, p: F.percentile(c, F.lit(p))
    return per.groupBy("factor").agg(q("s1", alpha / 2).alias("s1_low"), q("s1", 1 - alpha / 2).alias("s1_high"), q("st", alpha / 2).alias("st_low"), q("st", 1 - alpha / 2).alias("st_high"))


def analysis(wide: DataFrame, k: int, reps: int, seed: int, second: bool = False, points: DataFrame | None = None) -> DataFrame:
    """The whole report of a Saltelli design as rows (section, i, j, name, value).

    index: s1, st and their intervals of factor i; second: s2 of i and j (wide must hold the BA rows); delta: Borgonovo's of
    factor i over ``points`` (id, x0.., y); summary: base rows, mean and variance of the output, sums of the indices, the share of
    interactions (1 - sum of s1, not under 0); finding: diagnostics, 1 each.
    """
    both = sobol_indices(wide, k).join(sobol_intervals(wide, k, reps, seed), "factor")
    none = F.lit(None).cast("int")

    def rows(df, section, i, j, names):
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]))
        return df.select(F.lit(section).alias("section"), i.alias("i"), j.alias("j"), pairs.alias("p")).select("section", "i", "j", "p.*")

    out = rows(both, "index", F.col("factor"), none, ["s1", "st", "s1_low", "s1_high", "st_low", "st_high"])
    sums = both.agg(F.sum("s1").alias("sum_s1"), F.sum("st").alias("sum_st")).withColumn("interactions", F.greatest(F.lit(0.0), 1 - F.col("sum_s1")))
    moments = wide.agg(F.count("fa").alias("base_rows"), F.avg("fa").alias("mean"), F.var_pop("fa").alias("variance"))
    out = out.unionByName(rows(sums.crossJoin(moments), "summary", none, none, ["base_rows", "mean", "variance", "sum_s1", "sum_st", "interactions"]))  # one row each
    if second:
        out = out.unionByName(rows(second_order(wide, k), "second", F.col("i"), F.col("j"), ["s2"]))
    if points is not None:
        out = out.unionByName(rows(borgonovo(points, k), "delta", F.col("factor"), none, ["delta"]))
    found = diagnostics(both).select(F.lit("finding").alias("section"), F.col("factor").alias("i"), none.alias("j"), F.col("finding").alias("name"), F.lit(1.0).alias("value"))
    return out.unionByName(found)


def diagnostics(indices: DataFrame) -> DataFrame:
    """(factor, finding) from factor, s1, st, s1_low, s1_high, st_low, st_high; factor is null for findings on all."""
    wide = (F.col("s1_high") - F.col("s1_low")) / F.abs("s1")
    tests = [
        (F.col("s1") < 0, "negative_s1"), ((F.col("s1_low") < 0) & (F.col("s1_high") > 0), "s1_interval_crosses_zero"),
        ((F.col("st_low") < 0) | (F.col("st_high") > 1), "st_interval_outside"), ((F.abs("s1") > 0.01) & (wide > 0.10), "wide_interval"),
    ]
    found = F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in tests]), lambda x: x.isNotNull())
    own = indices.select("factor", F.explode(found).alias("finding"))
    total = indices.agg(F.sum("st").alias("s"), F.count_if((F.abs("s1") > 0.01) & (wide > 0.10)).alias("w"))
    extra = F.filter(F.array(F.when(F.col("s") > 1.3, F.lit("strong_interactions")), F.when(F.col("w") > 0, F.lit("recommend_double_n"))), lambda x: x.isNotNull())
    return own.unionByName(total.select(F.lit(None).cast("int").alias("factor"), F.explode(extra).alias("finding")))


def gates(cells: DataFrame, expected: int) -> DataFrame:
    """What keeps a result set (saltelli_index, accuracy, n_samples) from being analysed: counts, all 0 if fine."""
    return cells.agg(
        F.count_if(F.col("n_samples") == 0).alias("empty_cells"), F.count_if(F.col("accuracy").isNull()).alias("missing"),
        (F.lit(expected) - F.count_distinct("saltelli_index")).alias("absent"), (F.count(F.lit(1)) - F.count_distinct("saltelli_index")).alias("repeated"),
        F.count_if((F.col("saltelli_index") < 0) | (F.col("saltelli_index") >= expected)).alias("out_of_range"),
    )


def elementary_effects(points: DataFrame, k: int) -> DataFrame:
    """Morris: (factor, mu, mu_star, sigma) from (t, step, moved, sign, y)."""
    before = F.lag("y").over(Window.partitionBy("t").orderBy("step"))
    d = points.withColumn("ee", (F.col("y") - before) / F.col("sign")).where("moved IS NOT NULL")
    return d.groupBy(F.col("moved").alias("factor")).agg(F.avg("ee").alias("mu"), F.avg(F.abs("ee")).alias("mu_star"), F.stddev_samp("ee").alias("sigma"))


def fast_indices(points: DataFrame, omega: int, n: int, harmonics: int = 4) -> DataFrame:
    """(factor, s1, st) of the eFAST design (factor, s, y): the share of the spectrum at omega's harmonics, and below omega / 2."""
    cut = omega // 2
    wanted = [omega * (h + 1) for h in range(harmonics)]
    freq = list(range(1, cut + 1)) + wanted
    waves = F.explode(F.array(*[F.lit(f) for f in freq]))
    mean = Window.partitionBy("factor")
    d = points.withColumn("c", F.col("y") - F.avg("y").over(mean)).select("factor", "s", "c", waves.alias("f"))
    g = d.groupBy("factor", "f").agg((F.avg(F.col("c") * F.cos(F.col("f") * F.col("s"))) ** 2 + F.avg(F.col("c") * F.sin(F.col("f") * F.col("s"))) ** 2).alias("power"))
    v = points.groupBy("factor").agg(F.var_pop("y").alias("v"))
    top = F.sum(F.when(F.col("f").isin(wanted), F.col("power")).otherwise(0.0))
    low = F.sum(F.when(F.col("f") <= cut, F.col("power")).otherwise(0.0))
    s = g.groupBy("factor").agg((2 * top).alias("a"), (2 * low).alias("b"))
    return s.join(v, "factor").select("factor", (F.col("a") / F.col("v")).alias("s1"), (1 - F.col("b") / F.col("v")).alias("st"))


def long_form(points: DataFrame, k: int, extra=()) -> DataFrame:
    """(id, factor, x, y): one row a point and factor."""
    rows = F.explode(F.array(*[F.struct(F.lit(j).alias("factor"), F.col(f"x{j}").alias("x")) for j in range(k)]))
    return points.select("id", "y", *extra, rows.alias("r")).select("id", "r.*", "y", *extra)


def _sliced(points: DataFrame, k: int, slices: int) -> DataFrame:
    """(id, factor, x, y, slice): equal-frequency slices of each factor's values."""
    n = points.count()
    d = ranks.long_places(points, [f"x{j}" for j in range(k)], ["id", "y"], "id", n)
    return d.withColumn("slice", ranks.tile(F.col("place"), n, slices)).drop("place")


def rbd_fast(points: DataFrame, k: int, harmonics: int = 10) -> DataFrame:
    """(factor, s1): rows sorted by x, up and back down, and the spectrum at low frequencies; bias corrected."""
    n = points.count()
    d = ranks.long_places(points, [f"x{j}" for j in range(k)], ["id", "y"], "id", n).crossJoin(F.broadcast(points.agg(F.avg("y").alias("_m"))))  # one row on the right
    r = F.col("place")
    place = F.when(r % 2 == 1, (r + 1) / 2).otherwise(n - r / 2 + 1) - 1
    d = d.withColumn("s", place * (2 * math.pi / n)).withColumn("c", F.col("y") - F.col("_m"))
    d = d.select("factor", "s", "c", F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("f"))
    g = d.groupBy("factor", "f").agg((F.avg(F.col("c") * F.cos(F.col("f") * F.col("s"))) ** 2 + F.avg(F.col("c") * F.sin(F.col("f") * F.col("s"))) ** 2).alias("p"), (F.sum(F.col("c") * F.col("c")) / n).alias("v"))
    s = g.groupBy("factor").agg((2 * F.sum("p") / F.max("v")).alias("s"))
    bias = 2 * harmonics / n
    return s.select("factor", (F.col("s") - bias / (1 - bias) * (1 - F.col("s"))).alias("s1"))


def given_data(points: DataFrame, k: int, slices: int = 20) -> DataFrame:
    """(factor, s1) = 1 - E[Var(y | slice of x)] / Var(y), in [0, 1]."""
    g = _sliced(points, k, slices).groupBy("factor", "slice").agg(F.count("y").alias("n"), F.var_pop("y").alias("v"))
    v = points.agg(F.var_pop("y").alias("all"))
    s = g.groupBy("factor").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("inner")).crossJoin(v)
    return s.select("factor", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("inner") / F.col("all"))).alias("s1"))


def pawn(points: DataFrame, k: int, slices: int = 10) -> DataFrame:
    """(factor, least, median, most) of the Kolmogorov-Smirnov distances between y within a slice of x and y overall."""
    n = points.count()
    ranked = ranks.shares_under(points.select("id", "y", *[f"x{j}" for j in range(k)]), "y", "f", n)
    d = ranks.long_places(ranked, [f"x{j}" for j in range(k)], ["id", "y", "f"], "id", n).withColumn("slice", ranks.tile(F.col("place"), n, slices))
    inner = Window.partitionBy("factor", "slice").orderBy("y")
    d = d.withColumn("f0", F.cume_dist().over(inner))
    before = F.coalesce(F.lag("f0").over(inner), F.lit(0.0))
    g = d.withColumn("b", before).withColumn("gap", F.greatest(F.abs(F.col("f0") - F.col("f")), F.abs(F.col("b") - F.col("f")))).groupBy("factor", "slice").agg(F.max("gap").alias("ks"))
    return g.groupBy("factor").agg(F.min("ks").alias("least"), F.percentile("ks", F.lit(0.5)).alias("median"), F.max("ks").alias("most"))


def borgonovo(points: DataFrame, k: int, classes: int = 10, grid: int = 100) -> DataFrame:
    """(factor, delta): half the mean area between the density of y and its density within equal-frequency classes of x.

    Densities are Gaussian kernel sums with Silverman's bandwidth on a grid; each point meets the grid once for
    each density, so cost is points x grid x (factors + 1).
    """
    spark = points.sparkSession
    s = points.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.stddev_samp("y").alias("sd"), F.count("y").alias("n")).first()
    sd = s["sd"] or 1.0
    wide = 3 * 1.06 * sd * s["n"] ** -0.2
    lo, step = s["lo"] - wide, (s["hi"] - s["lo"] + 2 * wide) / (grid - 1)
    g = F.broadcast(spark.range(grid).select((F.lit(lo) + F.col("id") * step).alias("g")))
    d = _sliced(points, k, classes)
    h = d.groupBy("factor", "slice").agg((1.06 * F.stddev_samp("y") * F.pow(F.count("y"), F.lit(-0.2))).alias("h"), F.count("y").alias("m"))
    kernel = lambda h: F.avg(F.exp(-((F.col("g") - F.col("y")) ** 2) / (2 * h * h)) / (h * math.sqrt(2 * math.pi)))
    inner = d.join(h, ["factor", "slice"]).crossJoin(g).groupBy("factor", "slice", "m", "g").agg(kernel(F.col("h")).alias("fc"))
    outer = points.crossJoin(g).groupBy("g").agg(kernel(F.lit(1.06 * sd * s["n"] ** -0.2)).alias("f"))
    area = inner.join(outer, "g").groupBy("factor", "slice", "m").agg((F.sum(F.abs(F.col("f") - F.col("fc"))) * step).alias("a"))
    return area.groupBy("factor").agg((F.sum(F.col("a") * F.col("m")) / F.sum("m") / 2).alias("delta"))


def dgsm(gradients: DataFrame, variances: list[float], k: int) -> DataFrame:
    """(factor, nu, bound) from partial derivatives d0.. and y: nu = E[d^2]; bound on the total index for factors uniform over a width."""
    g = gradients.agg(F.var_pop("y").alias("v"), *[F.avg(F.col(f"d{j}") ** 2).alias(f"n{j}") for j in range(k)])
    rows = F.explode(F.array(*[F.struct(F.lit(j).alias("factor"), F.col(f"n{j}").alias("nu"), (F.col(f"n{j}") * (variances[j] * 12 / math.pi**2) / F.col("v")).alias("bound")) for j in range(k)]))
    return g.select(rows.alias("r")).select("r.*")


def _moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Size, means and covariances of columns, from one aggregate."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    return r["n"], np.array([r[f"m{i}"] for i in range(len(cols))]), cov


def regression(points: DataFrame, k: int) -> DataFrame:
    """(factor, src, pcc, srrc, prcc, r2, r2_rank): standardized and partial coefficients on values and on ranks."""
    cols = [f"x{j}" for j in range(k)] + ["y"]
    ranked = ranks.with_places(points, {c: f"_r{c}" for c in cols}, "id", points.count())
    out = {}
    for name, frame, own in (("linear", points, cols), ("rank", ranked, [f"_r{c}" for c in cols])):
        _, _, cov = _moments(frame, own)
        corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
        beta = np.linalg.solve(corr[:k, :k], corr[:k, k])
        inv = np.linalg.inv(corr)
        out[name] = (beta, -inv[:k, k] / np.sqrt(np.diag(inv)[:k] * inv[k, k]), float(beta @ corr[:k, k]))
    rows = [(j, float(out["linear"][0][j]), float(out["linear"][1][j]), float(out["rank"][0][j]), float(out["rank"][1][j]), out["linear"][2], out["rank"][2]) for j in range(k)]
    return points.sparkSession.createDataFrame(rows, "factor int, src double, pcc double, srrc double, prcc double, r2 double, r2_rank double")


def qosa(points: DataFrame, k: int, alpha: float = 0.5, slices: int = 20) -> DataFrame:
    """(factor, s) = 1 - E[pinball loss at the slice's quantile] / pinball loss at the overall quantile."""
    d = _sliced(points, k, slices)
    q = d.groupBy("factor", "slice").agg(F.percentile("y", F.lit(alpha)).alias("q"))
    all_ = points.agg(F.percentile("y", F.lit(alpha)).alias("q0"))
    loss = lambda q: (F.col("y") - q) * (alpha - (F.col("y") <= q).cast("double"))
    g = d.join(q, ["factor", "slice"]).crossJoin(all_)
    return g.groupBy("factor").agg((1 - F.avg(loss(F.col("q"))) / F.avg(loss(F.col("q0")))).alias("s"))


def shapley(model, spark, k: int, permutations: int, outer: int, inner: int, seed: int) -> DataFrame:
    """(factor, effect): Song's random-permutation estimate for independent uniform inputs; effects sum to the variance.

    model: a function of a list of columns. For each permutation and prefix, E[Var(y | the rest)] is estimated
    from outer x inner points, all in one table.
    """
    p = spark.range(permutations).select(F.col("id").alias("p"))
    order = F.transform(F.array_sort(F.array(*[F.struct(rng.shuffle_key(seed, F.lit(f"p{j}"), F.col("p")).alias("o"), F.lit(j).alias("j")) for j in range(k)])), lambda s: s["j"])
    p = p.withColumn("order", order)
    cells = p.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("size")).select("*", F.explode(F.sequence(F.lit(1), F.lit(outer))).alias("o")).select("*", F.explode(F.sequence(F.lit(1), F.lit(inner))).alias("i"))
    xs = []
    for j in range(k):
        free = F.array_position("order", j) <= F.col("size")  # these vary within an outer cell
        xs.append(F.when(free, rng.uniform(seed, F.lit(f"i{j}"), F.col("p"), F.col("size"), F.col("o"), F.col("i"))).otherwise(rng.uniform(seed, F.lit(f"o{j}"), F.col("p"), F.col("size"), F.col("o"))))
    d = cells.withColumn("y", model(xs))
    cost = d.groupBy("p", "order", "size", "o").agg(F.var_samp("y").alias("v")).groupBy("p", "order", "size").agg(F.avg("v").alias("c"))
    gain = F.col("c") - F.coalesce(F.lag("c").over(Window.partitionBy("p").orderBy("size")), F.lit(0.0))
    g = cost.withColumn("gain", gain).withColumn("factor", F.element_at("order", F.col("size")))
    return g.groupBy("factor").agg(F.avg("gain").alias("effect"))


def _legendre(degree: int, u: Column) -> Column:
    """Orthonormal on [0, 1]."""
    x = 2 * u - 1
    a, b = F.lit(1.0), x
    for n in range(1, degree):
        a, b = b, ((2 * n + 1) * x * b - n * a) / (n + 1)
    return (a if degree == 0 else b) * math.sqrt(2 * degree + 1)


def _terms(k: int, degree: int, q: float = 1.0) -> list[tuple[int, ...]]:
    """Exponents with sum (or, for q < 1, q-norm) up to degree."""
    out = []

    def grow(prefix):
        if len(prefix) == k:
            out.append(tuple(prefix))
            return
        for d in range(degree + 1):
            if sum(e**q for e in [*prefix, d] if e) ** (1 / q) <= degree + 1e-9:
                grow([*prefix, d])

    grow([])
    return sorted(out, key=lambda t: (sum(t), t))


def _gram(named: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean products of the columns t0.. with each other and with y: partial sums a batch, added up by position."""

    def partial(batches):
        import pandas as pd

        for b in batches:
            a = b.to_numpy()
            g = a.T @ a
            i, j = np.triu_indices(m + 1)
            yield pd.DataFrame({"i": i, "j": j, "s": g[i, j], "n": len(a)})

    rows = named.mapInPandas(partial, "i int, j int, s double, n long").groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("v")).collect()
    g = np.zeros((m + 1, m + 1))
    for r in rows:  # at most (m + 1)(m + 2) / 2
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
    return g[:m, :m], g[:m, m]


def chaos(points: DataFrame, k: int, degree: int, q: float = 1.0, sparse: int | None = None) -> tuple[list[tuple[tuple[int, ...], float]], DataFrame]:
    """Polynomial chaos: coefficients by least squares (or ``sparse`` terms by orthogonal matching pursuit), and (factor, s1, st).

    The Gram matrix is one aggregate over the points; the system is solved on the driver.
    """
    terms = _terms(k, degree, q)
    basis = []
    for t in terms:
        c = F.lit(1.0)
        for j, d in enumerate(t):
            c = c * _legendre(d, F.col(f"x{j}")) if d else c
        basis.append(c)
    m = len(terms)
    gram, right = _gram(points.select(*[b.alias(f"t{i}") for i, b in enumerate(basis)], F.col("y").cast("double").alias("y")), m)
    if sparse is None:
        active = list(range(m))
        coef = np.linalg.solve(gram, right)
    else:
        active, coef = [], np.zeros(0)
        for _ in range(min(sparse, m)):
            rest = right - (gram[:, active] @ coef if active else 0)
            rest[active] = 0
            best = int(np.abs(rest / np.sqrt(np.diag(gram))).argmax())
            if abs(rest[best]) < 1e-12:
                break
            active.append(best)
            coef = np.linalg.solve(gram[np.ix_(active, active)], right[active])
    found = [(terms[a], float(c)) for a, c in zip(active, coef)]
    var = sum(c * c for t, c in found if any(t)) or 1.0
    rows = [(j, sum(c * c for t, c in found if t[j] and sum(1 for e in t if e) == 1) / var, sum(c * c for t, c in found if t[j]) / var) for j in range(k)]
    return found, points.sparkSession.createDataFrame(rows, "factor int, s1 double, st double")


def hdmr(found: list[tuple[tuple[int, ...], float]], spark) -> DataFrame:
    """(factors, share): the variance of a chaos expansion by the set of active factors."""
    var, groups = sum(c * c for t, c in found if any(t)) or 1.0, {}
    for t, c in found:
        if any(t):
            name = ",".join(str(j) for j, e in enumerate(t) if e)
            groups[name] = groups.get(name, 0.0) + c * c
    return spark.createDataFrame([(n, v / var) for n, v in sorted(groups.items())], "factors string, share double")


def active_subspace(gradients: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), eigenvectors and the dimension before the largest gap, of E[grad grad']."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = gradients.agg(*[F.avg(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    c = np.zeros((k, k))
    for n, (i, j) in enumerate(pairs):
        c[i, j] = c[j, i] = r[n]
    values, vectors = np.linalg.eigh(c)
    values, vectors = values[::-1], vectors[:, ::-1]
    logs = np.log(np.maximum(values, 1e-300))
    return values, vectors, int(np.argmax(logs[:-1] - logs[1:])) + 1 if k > 1 else 1


def discrepancy(points: DataFrame, k: int, kind: str = "centred") -> DataFrame:
    """(value): squared discrepancy: centred, wraparound, modified or star. Each point meets each other: meant for designs of some thousand points."""
    a = points.select(*[F.col(f"x{j}").alias(f"a{j}") for j in range(k)])
    b = points.select(*[F.col(f"x{j}").alias(f"b{j}") for j in range(k)])
    pairs, one, two = F.lit(1.0), F.lit(1.0), {"centred": (13 / 12) ** k, "wraparound": -((4 / 3) ** k), "modified": (19 / 12) ** k, "star": (1 / 3) ** k}[kind]
    for j in range(k):
        x, y = F.col(f"a{j}"), F.col(f"b{j}")
        cx, cy, d = F.abs(x - 0.5), F.abs(y - 0.5), F.abs(x - y)
        if kind == "centred":
            one, pairs = one * (1 + cx / 2 - cx * cx / 2), pairs * (1 + cx / 2 + cy / 2 - d / 2)
        elif kind == "wraparound":
            pairs = pairs * (1.5 - d * (1 - d))
        elif kind == "modified":
            one, pairs = one * (5 / 3 - cx / 4 - cx * cx / 4), pairs * (15 / 8 - cx / 4 - cy / 4 - 0.75 * d + d * d / 2)
        else:
            one, pairs = one * (1 - x * x) / 2, pairs * (1 - F.greatest(x, y))
    n = points.count()
    met = a.crossJoin(b).agg((F.sum(pairs) / n / n).alias("p"))
    if kind == "wraparound":
        return met.select((F.col("p") + two).alias("value"))
    single = a.agg((F.sum(one) * 2 / n).alias("s"))
    return met.crossJoin(single).select((F.lit(two) - F.col("s") + F.col("p")).alias("value"))


def factorial_effects(runs: DataFrame, k: int) -> DataFrame:
    """(factor, effect): mean of y at +1 less that at -1, for columns x0.. of +1 and -1."""
    g = runs.agg(*[(F.avg(F.when(F.col(f"x{j}") > 0, F.col("y"))) - F.avg(F.when(F.col(f"x{j}") < 0, F.col("y")))).alias(f"e{j}") for j in range(k)])
    rows = F.explode(F.array(*[F.struct(F.lit(j).alias("factor"), F.col(f"e{j}").alias("effect")) for j in range(k)]))
    return g.select(rows.alias("r")).select("r.*")


def _effects(grid: DataFrame, axes: list[str]) -> tuple[dict[frozenset, float], dict[str, int], float]:
    """Sums of squares of every effect of a balanced crossed grid, from one pass of grouping sets, and the levels."""
    from itertools import combinations

    sets = [list(c) for r in range(len(axes) + 1) for c in combinations(axes, r)]
    view = f"_effects_{uuid.uuid4().hex}"
    grid.select(*axes, "x").createOrReplaceTempView(view)
    spelled = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    g = grid.sparkSession.sql(f"SELECT grouping_id({', '.join(axes)}) AS gid, count(*) AS n, avg(x) AS m FROM {view} GROUP BY GROUPING SETS ({spelled})")
    per = g.groupBy("gid").agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s"), F.count(F.lit(1)).alias("levels"))
    raw = {}
    levels = {}
    for r in per.collect():  # one row a grouping set
        inside = frozenset(a for i, a in enumerate(axes) if not (r["gid"] >> (len(axes) - 1 - i)) & 1)
        raw[inside] = r["s"]
        if len(inside) == 1:
            levels[next(iter(inside))] = r["levels"]
    ss: dict[frozenset, float] = {}
    for s in sorted(raw, key=len):
        ss[s] = raw[s] - sum(v for t, v in ss.items() if t < s)
    return ss, levels, raw[frozenset(axes)] - raw[frozenset()]


def anova(grid: DataFrame, axes: list[str]) -> DataFrame:
    """(effect, df, ss, ms, fraction, f): balanced crossed analysis of variance, one row a cell; f against the highest interaction."""
    ss, levels, total = _effects(grid, axes)
    top = frozenset(axes)
    rows = []
    df = {s: math.prod(levels[a] - 1 for a in s) for s in ss if s}
    error = ss[top] / max(1, df[top])
    for s in sorted((s for s in ss if s), key=lambda s: (len(s), sorted(s))):
        ms = ss[s] / max(1, df[s])
        rows.append(("x".join(sorted(s)), df[s], ss[s], ms, ss[s] / total if total else 0.0, ms / error if s != top and error > 0 else None))
    return grid.sparkSession.createDataFrame(rows, "effect string, df long, ss double, ms double, fraction double, f double")


def g_study(grid: DataFrame) -> dict[str, float]:
    """Variance components of a crossed p x i x r grid (columns p, i, r, x), negative ones as 0, and the coefficients g and phi."""
    ss, n, _ = _effects(grid, ["p", "i", "r"])
    ms = {"".join(a for a in "pir" if a in s): v / max(1, math.prod(n[a] - 1 for a in s)) for s, v in ss.items() if s}
    np_, ni, nr = n["p"], n["i"], n["r"]
    c = {"pir": ms["pir"], "pi": (ms["pi"] - ms["pir"]) / nr, "pr": (ms["pr"] - ms["pir"]) / ni, "ir": (ms["ir"] - ms["pir"]) / np_}
    c["p"] = (ms["p"] - ms["pi"] - ms["pr"] + ms["pir"]) / (ni * nr)
    c["i"] = (ms["i"] - ms["pi"] - ms["ir"] + ms["pir"]) / (np_ * nr)
    c["r"] = (ms["r"] - ms["pr"] - ms["ir"] + ms["pir"]) / (np_ * ni)
    c = {k: max(0.0, v) for k, v in c.items()}
    return c | {"n_i": ni, "n_r": nr, **d_study(c, ni, nr)}


def d_study(c: dict[str, float], n_i: int, n_r: int) -> dict[str, float]:
    """Generalizability and dependability for so many items and raters."""
    relative = c["pi"] / n_i + c["pr"] / n_r + c["pir"] / (n_i * n_r)
    absolute = relative + c["i"] / n_i + c["r"] / n_r + c["ir"] / (n_i * n_r)
    ratio = lambda e: c["p"] / (c["p"] + e) if c["p"] + e > 0 else 0.0
    return {"g": ratio(relative), "phi": ratio(absolute)}


def d_study_table(values: DataFrame) -> DataFrame:
    """(n_i, n_r, g, phi) from rows (name, value) with names like d_study_g_coefficient_n_i_4_n_r_2."""
    rx = r"^d_study_(g|phi)_coefficient_n_i_(\d+)_n_r_(\d+)$"
    part = lambda i: F.regexp_extract("name", rx, i)
    rows = values.where(F.col("name").rlike(rx)).select(part(1).alias("kind"), part(2).cast("int").alias("n_i"), part(3).cast("int").alias("n_r"), "value")
    return rows.groupBy("n_i", "n_r").agg(F.max(F.when(F.col("kind") == "g", F.col("value"))).alias("g"), F.max(F.when(F.col("kind") == "phi", F.col("value"))).alias("phi"))
