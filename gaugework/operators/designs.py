"""Sampling designs for sensitivity analysis as frames: one row a point, columns x0, x1, ... in [0, 1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mathx, ranks, rng

# The published table of direction numbers of Joe and Kuo for dimensions 2 to 21: degree, coefficients, initial m.
JOE_KUO = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)), (5, 13, (1, 1, 1, 3, 11)), (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)), (6, 13, (1, 1, 1, 15, 21, 21)), (6, 16, (1, 3, 1, 13, 27, 49)), (6, 19, (1, 1, 1, 15, 7, 5)), (6, 22, (1, 3, 1, 15, 13, 25)), (6, 25, (1, 1, 5, 5, 19, 61)),
    (7, 1, (1, 3, 7, 11, 23, 15, 103)), (7, 4, (1, 3, 7, 13, 13, 15, 69)),
)
BITS = 30


def direction_numbers(dim: int, table=JOE_KUO) -> list[int]:
    """The BITS direction numbers of a dimension (from 0), scaled to BITS bits."""
    if dim == 0:
        return [1 << (BITS - 1 - b) for b in range(BITS)]
    if dim - 1 >= len(table):
        raise ValueError(f"no direction numbers for dimension {dim + 1}; pass a longer table")
    s, a, m = table[dim - 1]
    v = [m[b] << (BITS - 1 - b) for b in range(min(s, BITS))]
    for b in range(s, BITS):
        x = v[b - s] ^ (v[b - s] >> s)
        for k in range(1, s):
            if (a >> (s - 1 - k)) & 1:
                x ^= v[b - k]
        v.append(x)
    return v


def sobol_point(i: Column, dim: int, table=JOE_KUO) -> Column:
    """Coordinate ``dim`` of point i, in Gray-code order."""
    gray = i.bitwiseXOR(F.shiftright(i, 1))
    out = F.lit(0).cast("bigint")
    for b, v in enumerate(direction_numbers(dim, table)):
        out = out.bitwiseXOR(F.shiftright(gray, b).bitwiseAND(F.lit(1)) * v)
    return out / float(1 << BITS)


def sobol(spark: SparkSession, n: int, dims: int, skip_first: bool = False, table=JOE_KUO) -> DataFrame:
    i = F.col("id") + (1 if skip_first else 0)
    return spark.range(n).select("id", *[sobol_point(i, d, table).alias(f"x{d}") for d in range(dims)])


def latin_hypercube(spark: SparkSession, n: int, dims: int, seed: int, centred: bool = False) -> DataFrame:
    """One point in each of n strata of every column; columns are shuffled by hashes."""
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(max(dims - 1, 0)))).alias("d"))
    rank = F.row_number().over(Window.partitionBy("d").orderBy(rng.shuffle_key(seed, F.col("d"), F.col("id")))) - 1
    u = F.lit(0.5) if centred else rng.uniform(seed, F.lit("u"), F.col("d"), F.col("id"))
    rows = rows.select("id", "d", ((rank + u) / max(n, 1)).alias("x"))
    return rows.groupBy("id").agg(*[F.max(F.when(F.col("d") == d, F.col("x"))).alias(f"x{d}") for d in range(dims)])


def saltelli(base: DataFrame, k: int, second_order: bool = False) -> DataFrame:
    """base (id, x0..x(2k-1)) to (base_row, block, x0..x(k-1)): blocks A, B, AB0.. and, for second order, BA0.. ."""
    blocks = ["A", "B", *[f"AB{j}" for j in range(k)], *([f"BA{j}" for j in range(k)] if second_order else [])]

    def coordinate(block: str, j: int) -> Column:
        own = block in ("A",) or (block.startswith("AB") and block != f"AB{j}") or block == f"BA{j}"
        return F.col(f"x{j}") if own else F.col(f"x{k + j}")

    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("pos"), F.lit(b).alias("block"), *[coordinate(b, j).alias(f"x{j}") for j in range(k)]) for n, b in enumerate(blocks)]))
    return base.select(F.col("id").alias("base_row"), rows.alias("r")).select("base_row", "r.*")


def owen(base: DataFrame, k: int) -> DataFrame:
    """base (id, x0..x(3k-1)) of three independent samples to blocks A, B, CA0.. (A with one factor of the third) and BA0.. (B with one of A)."""
    blocks = {"A": list(range(k)), "B": list(range(k, 2 * k))}
    for j in range(k):
        blocks[f"CA{j}"] = [2 * k + i if i == j else i for i in range(k)]
        blocks[f"BA{j}"] = [i if i == j else k + i for i in range(k)]
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), *[F.col(f"x{c}").alias(f"x{j}") for j, c in enumerate(cols)]) for b, cols in blocks.items()]))
    return base.select(F.col("id").alias("base_row"), rows.alias("r")).select("base_row", "r.*")


def manifest(points: DataFrame, n: int, axes: list[tuple[str, list]]) -> DataFrame:
    """Cells in the order A, B, AB0, ...: cell_id, saltelli_index and each axis's level, level = min(floor(u L), L - 1)."""
    index = F.col("pos") * n + F.col("base_row")
    cols = []
    for j, (name, levels) in enumerate(axes):
        at = F.least(F.floor(F.col(f"x{j}") * len(levels)), F.lit(len(levels) - 1)).cast("int")
        cols.append(F.element_at(F.array(*[F.lit(str(v)) for v in levels]), at + 1).alias(name))
    return points.select(F.format_string("c%05d", index.cast("long")).alias("cell_id"), index.cast("long").alias("saltelli_index"), "block", "base_row", *cols)


def morris(spark: SparkSession, trajectories: int, k: int, seed: int, levels: int = 4) -> DataFrame:
    """(t, step, moved, sign, x0..): each step moves one factor by levels / (2 (levels - 1)); starts and orders by hashes."""
    delta = levels / (2 * (levels - 1))
    half = levels // 2
    t = spark.range(trajectories).select(F.col("id").alias("t"))
    for j in range(k):
        low = rng.pick(half, seed, F.lit(f"s{j}"), F.col("t")) / float(levels - 1)
        up = rng.uniform(seed, F.lit(f"d{j}"), F.col("t")) < 0.5
        t = t.withColumn(f"b{j}", F.when(up, low).otherwise(low + delta)).withColumn(f"g{j}", F.when(up, delta).otherwise(-delta))
        t = t.withColumn(f"o{j}", rng.shuffle_key(seed, F.lit(f"o{j}"), F.col("t")))
    ranks = F.array_sort(F.array(*[F.struct(F.col(f"o{j}").alias("o"), F.lit(j).alias("j")) for j in range(k)]))
    t = t.withColumn("order", F.transform(ranks, lambda s: s["j"]))
    steps = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("step"))
    moved = [F.array_position("order", j) <= F.col("step") for j in range(k)]
    last = F.when(F.col("step") > 0, F.element_at("order", F.greatest(F.col("step"), F.lit(1))))
    xs = [(F.col(f"b{j}") + F.when(moved[j], F.col(f"g{j}")).otherwise(0.0)).alias(f"x{j}") for j in range(k)]
    step = F.element_at(F.array(*[F.col(f"g{j}") for j in range(k)]), F.coalesce(last, F.lit(0)) + 1)
    return steps.select("t", "step", last.alias("moved"), step.alias("sign"), *xs)


def efast(spark: SparkSession, n: int, k: int, harmonics: int = 4) -> tuple[DataFrame, int]:
    """(factor, i, s, x0..): for each factor a curve on which it oscillates fast, at omega, and the others slowly."""
    omega = (n - 1) // (2 * harmonics)
    slow_most = max(1, omega // (2 * harmonics))
    rows = spark.range(n).select(F.col("id").alias("i"), (F.lit(2 * math.pi / n) * F.col("id")).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("factor"))
    xs = []
    for j in range(k):
        slow = F.lit(0)
        for f in range(k):
            others = [o for o in range(k) if o != f]
            if j != f:
                w = 1 + (others.index(j) * max(1, (slow_most - 1) // max(1, k - 2)) % slow_most if k > 2 else 0)
                slow = F.when(F.col("factor") == f, F.lit(w)).otherwise(slow)
        w = F.when(F.col("factor") == j, F.lit(omega)).otherwise(slow)
        xs.append((0.5 + F.asin(F.sin(w * F.col("s"))) / math.pi).alias(f"x{j}"))
    return rows.select("factor", "i", "s", *xs), omega


def plackett_burman(k: int) -> list[list[int]]:
    """Rows of +1 and -1 for up to 23 factors, from the quadratic residues of a prime (or doubling)."""
    n = 4 * ((k + 1 + 3) // 4)

    def hadamard(n: int) -> list[list[int]]:
        if n == 1:
            return [[1]]
        if n == 2:
            return [[1, 1], [1, -1]]
        p = n - 1
        if p > 2 and all(p % d for d in range(2, int(p**0.5) + 1)) and p % 4 == 3:
            square = {i * i % p for i in range(1, p)}
            chi = [0] + [1 if i in square else -1 for i in range(1, p)]
            rows = [[1] * n]
            for i in range(p):
                rows.append([1] + [-1 if i == j else chi[(j - i) % p] for j in range(p)])
            return rows
        if n % 2 == 0:
            h = hadamard(n // 2)
            return [r + r for r in h] + [r + [-v for v in r] for r in h]
        raise ValueError(f"no design of {n} runs")

    return [row[1 : k + 1] for row in hadamard(n)]


def iman_conover(points: DataFrame, target: list[list[float]], seed: int) -> DataFrame:
    """points (id, x0..) with columns reordered so that their rank correlations come near the target; each column's values stay."""
    import numpy as np

    k = len(target)
    n = points.count()
    scores = points.select("id")
    for j in range(k):
        scores = scores.withColumn(f"_u{j}", rng.uniform(seed, F.lit(j), F.col("id"))).withColumn(f"_t{j}", rng.shuffle_key(seed, F.lit(j), F.col("id")))
    for j in range(k):  # the number is the start of the shuffle key, which settles its ties
        scores = ranks.with_places(scores, {f"_u{j}": f"_r{j}"}, f"_t{j}", n).withColumn(f"s{j}", mathx.probit(F.col(f"_r{j}") / (n + 1.0)))
    have = [[scores.stat.corr(f"s{i}", f"s{j}") if i != j else 1.0 for j in range(k)] for i in range(k)]
    mix = np.linalg.cholesky(np.array(target)) @ np.linalg.inv(np.linalg.cholesky(np.array(have)))
    mixed = scores.select("id", *[sum((F.col(f"s{j}") * float(mix[i, j]) for j in range(k)), F.lit(0.0)).alias(f"m{i}") for i in range(k)])
    out = mixed.select("id")
    for j in range(k):
        places = ranks.with_places(mixed.select("id", f"m{j}"), {f"m{j}": "r"}, "id", n).select("id", "r")
        values = ranks.with_places(points.select("id", f"x{j}"), {f"x{j}": "r"}, "id", n).select(f"x{j}", "r")
        out = out.join(places.join(values, "r").drop("r"), "id")
    return out


def quantile(kind: str, u: Column, *p: float) -> Column:
    """The quantile of a distribution at u; u is held inside (0, 1)."""
    u = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), u))
    if kind == "uniform":
        return p[0] + (p[1] - p[0]) * u
    if kind == "triangular":
        low, mode, high = p
        cut = (mode - low) / (high - low)
        return F.when(u < cut, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))
    if kind == "normal":
        return p[0] + p[1] * mathx.probit(u)
    if kind == "lognormal":
        return F.exp(p[0] + p[1] * mathx.probit(u))
    if kind == "bernoulli":
        return (u > 1 - p[0]).cast("double")
    if kind == "weibull":
        return p[1] * F.pow(-F.log(1 - u), F.lit(1 / p[0]))
    if kind == "exponential":
        return -F.log(1 - u) / p[0]
    if kind in ("beta", "gamma"):
        return _numeric_quantile(kind, p)(u)
    raise ValueError(kind)


def _numeric_quantile(kind: str, p: tuple[float, ...]):
    """Beta and gamma have no closed form: a table of the distribution function, made once, is inverted batch by batch."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    if kind == "beta":
        x = (1 - np.cos(np.linspace(0, np.pi, 20001))) / 2
        mid = (x[1:] + x[:-1]) / 2
        log = (p[0] - 1) * np.log(mid) + (p[1] - 1) * np.log1p(-mid)
    else:
        x = p[1] * np.linspace(0, 1, 20001) ** 2 * (p[0] + 40 * math.sqrt(p[0]) + 40)
        mid = (x[1:] + x[:-1]) / 2
        log = (p[0] - 1) * np.log(mid) - mid / p[1]
    mass = np.exp(log - log.max()) * np.diff(x)
    cdf = np.concatenate([[0], np.cumsum(mass)]) / mass.sum()

    def inverse(u):
        return pd.Series(np.interp(u, cdf, x))

    inverse.__annotations__ = {"u": pd.Series, "return": pd.Series}
    return pandas_udf(inverse, "double")
