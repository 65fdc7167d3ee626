"""Item response models, item selection, adaptive tests, schedules and calibration.

Items: (id, difficulty, discrimination, content_domain, exposure_count). Responses: (person, item, y).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng

#: Answers of different patterns in a partition that calibration goes over, about.
BLOCK = 1 << 18

def probability(theta, a: Column, b: Column) -> Column:
    return 1 / (1 + F.exp(-a * (theta - b)))


def information(theta, a: Column, b: Column) -> Column:
    p = probability(theta, a, b)
    return a * a * p * (1 - p)


def theta_grid(spark, points: int, low: float = -4.0, high: float = 4.0) -> DataFrame:
    return spark.range(points).select((F.lit(low) + F.col("id") * ((high - low) / max(1, points - 1))).alias("theta"))


def test_information(pool: DataFrame, points: int = 61) -> DataFrame:
    """(theta, information, se) of all items together."""
    g = pool.crossJoin(F.broadcast(theta_grid(pool.sparkSession, points)))  # the grid is a parameter
    s = g.groupBy("theta").agg(F.sum(information(F.col("theta"), F.col("discrimination"), F.col("difficulty"))).alias("information"))
    return s.withColumn("se", F.when(F.col("information") > 0, 1 / F.sqrt("information")).otherwise(F.lit(float("inf"))))


def least_information(pool: DataFrame, points: int = 61) -> DataFrame:
    return test_information(pool, points).agg(F.coalesce(F.min("information"), F.lit(0.0)).alias("least"))


def eap(answers: DataFrame, points: int = 61, low: float = -4.0, high: float = 4.0, mean: float = 0.0, sd: float = 1.0) -> DataFrame:
    """(person, theta, se): posterior mean on a grid; answers: (person, y, discrimination, difficulty)."""
    g = answers.crossJoin(F.broadcast(theta_grid(answers.sparkSession, points, low, high)))
    p = probability(F.col("theta"), F.col("discrimination"), F.col("difficulty"))
    ll = F.sum(F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))
    post = g.groupBy("person", "theta").agg((ll - (F.col("theta") - mean) ** 2 / (2 * sd * sd)).alias("l"))
    top = post.groupBy("person").agg(F.max("l").alias("top"))
    w = post.join(top, "person").withColumn("w", F.exp(F.col("l") - F.col("top")))
    s = w.groupBy("person").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("theta")).alias("m1"), F.sum(F.col("w") * F.col("theta") ** 2).alias("m2"))
    return s.select("person", (F.col("m1") / F.col("z")).alias("theta"), F.sqrt(F.greatest(F.lit(0.0), F.col("m2") / F.col("z") - (F.col("m1") / F.col("z")) ** 2)).alias("se"))


def mle(answers: DataFrame, steps: int = 50, bound: float = 6.0) -> DataFrame:
    """(person, theta, se): Newton from 0 within +-bound; null when all answers are right or all wrong.

    The answers of a person are gathered into one row, and Newton's steps are an ``aggregate`` over a sequence, so
    no Python runs.
    """
    rows = answers.groupBy("person").agg(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("discrimination").alias("a"), F.col("difficulty").alias("b"))).alias("r"), F.avg("y").alias("share"))

    def derivatives(theta, r):
        def add(acc, x):
            p = 1 / (1 + F.exp(-x["a"] * (theta - x["b"])))
            return F.struct((acc["g"] + x["a"] * (x["y"] - p)).alias("g"), (acc["h"] + x["a"] * x["a"] * p * (1 - p)).alias("h"))

        return F.aggregate(r, F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h")), add)

    def newton(theta, _):
        moved = F.transform(F.array(derivatives(theta, F.col("r"))), lambda d: theta + d["g"] / F.greatest(d["h"], F.lit(1e-12)))[0]
        return F.greatest(F.lit(-bound), F.least(F.lit(bound), moved))

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), newton)
    mixed = (F.col("share") > 0) & (F.col("share") < 1)
    rows = rows.withColumn("theta", F.when(mixed, theta))
    info = derivatives(F.col("theta"), F.col("r"))["h"]
    return rows.select("person", "theta", F.when(info > 0, 1 / F.sqrt(info)).alias("se"))


def estimate(answers: DataFrame) -> DataFrame:
    """(person, theta, method): maximum likelihood, or the posterior mean where that is undefined."""
    a, b = mle(answers), eap(answers).select("person", F.col("theta").alias("prior_mean"))
    return a.join(b, "person").select("person", F.coalesce("theta", "prior_mean").alias("theta"), F.when(F.col("theta").isNotNull(), "mle").otherwise("eap").alias("method"))


def eligible(pool: DataFrame, rule: str = "none", limit: int = 0, chance: float = 0.0, seed: int = 0) -> DataFrame:
    """Items that their exposure allows: 'none', 'max' (below limit) or 'conditional' (at or over it with a chance)."""
    if rule == "none":
        return pool
    below = F.col("exposure_count") < limit
    return pool.where(below if rule == "max" else below | (rng.uniform(seed, F.lit("exposure"), F.col("id")) < chance))


def select_uniform(pool: DataFrame, n: int, seed: int) -> DataFrame:
    return pool.orderBy(rng.shuffle_key(seed, F.col("id")), "id").limit(n)


def select_stratified(pool: DataFrame, per_domain: int, n: int, seed: int) -> DataFrame:
    """per_domain of each domain; cut to n by a shuffle if that is more, filled up from the rest if less."""
    key = rng.shuffle_key(seed, F.col("id"))
    k = F.row_number().over(Window.partitionBy("content_domain").orderBy(key, "id"))
    return pool.withColumn("_k", key).withColumn("_later", (k > per_domain).cast("int")).orderBy("_later", "_k", "id").limit(n).drop("_k", "_later")


def select_max_info(pool: DataFrame, theta: float, n: int, k: int, seed: int) -> DataFrame:
    """n of the max(k, n) most informative items at theta."""
    best = pool.withColumn("_i", information(F.lit(theta), F.col("discrimination"), F.col("difficulty"))).orderBy(F.desc("_i"), "id").limit(max(k, n))
    return best.orderBy(rng.shuffle_key(seed, F.col("id")), "id").limit(n).drop("_i")


def schedule(items: DataFrame, runs: int, rate: float, families: int, seed: int) -> DataFrame:
    """(run, item, perturbed, family): each item of each run is perturbed with the rate, by one of the families, or a control."""
    spark = items.sparkSession
    cells = items.select("item").distinct().crossJoin(F.broadcast(spark.range(runs).select(F.col("id").alias("run"))))
    hit = rng.uniform(seed, F.lit("hit"), F.col("run"), F.col("item")) < rate
    return cells.select("run", "item", hit.alias("perturbed"), F.when(hit, rng.pick(families, seed, F.lit("family"), F.col("run"), F.col("item"))).alias("family"))


def coverage(plan: DataFrame) -> DataFrame:
    """(item, coverage): the share of runs that perturb an item."""
    return plan.groupBy("item").agg(F.avg(F.col("perturbed").cast("double")).alias("coverage"))


def pool_findings(pool: DataFrame) -> DataFrame:
    """(finding, n): what is wrong with an item pool; empty if nothing is."""
    g = pool.agg(
        (F.count(F.lit(1)) == 0).cast("long").alias("empty"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("repeated_ids"),
        F.count_if(F.col("discrimination") <= 0).alias("discrimination"), F.count_if(F.isnan("difficulty") | F.col("difficulty").isNull()).alias("difficulty"),
    )
    names = ["empty", "repeated_ids", "discrimination", "difficulty"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), F.col(n).alias("n")) for n in names]))
    return g.select(rows.alias("r")).select("r.*").where("n > 0")


def record_exposure(pool: DataFrame, given: DataFrame) -> DataFrame:
    """The pool with exposure counts raised by how often an item was given."""
    g = given.groupBy("id").agg(F.count(F.lit(1)).alias("_g"))
    return pool.join(g, "id", "left").withColumn("exposure_count", F.col("exposure_count") + F.coalesce("_g", F.lit(0))).drop("_g")


def calibrate_2pl(responses: DataFrame, rounds: int = 100, points: int = 21, tol: float = 1e-6) -> DataFrame:
    """(item, discrimination, difficulty) by marginal maximum likelihood: EM over a grid of abilities.

    People with the same answers count as one with a weight, and their answers lie packed in blocks. A round is one pass over
    the blocks: the E step gives each pattern's posterior on the grid and sums the expected counts by item and grid point; the M
    step is a few Newton steps on those (items x points) numbers. EM ends when a round changes the marginal log likelihood
    by less than tol, or after ``rounds``. Items with a discrimination at or under 0 are dropped. Answers without a person, an item
    or a y count for nothing.
    """
    spark, kind = responses.sparkSession, dict(responses.dtypes)["item"]
    n = responses.where("item IS NOT NULL AND person IS NOT NULL AND y IS NOT NULL")
    ids = [r["item"] for r in n.select("item").distinct().orderBy("item").collect()]
    a, b = np.ones(len(ids)), np.zeros(len(ids))
    grid = np.linspace(-4, 4, points)
    packed, parts = _packed_answers(n, ids, kind)
    last = None
    for _ in range(rounds if ids else 0):
        found = packed.mapInArrow(_expected(a, b, grid), "k int, sums binary")
        if parts > 1:
            found = found.repartition(min(parts, 16), "k").mapInArrow(_summed, "k int, sums binary")
        size, right, total = np.zeros((len(ids), points)), np.zeros((len(ids), points)), 0.0
        for k, raw in found.collect():
            if k < 0:
                total = float(np.frombuffer(raw)[0])
            else:
                size[k], right[k] = np.frombuffer(raw).reshape(2, points)
        for _ in range(4):
            p_ = 1 / (1 + np.exp(-a[:, None] * (grid - b[:, None])))
            d, v = right - size * p_, size * p_ * (1 - p_)
            x = grid - b[:, None]
            ga, gb = (d * x).sum(1), -(d * a[:, None]).sum(1)
            haa, hbb, hab = (v * x * x).sum(1) + 1e-6, (v * a[:, None] ** 2).sum(1) + 1e-6, -(v * x * a[:, None]).sum(1)
            det = np.maximum(haa * hbb - hab**2, 1e-9)
            a = np.clip(a + np.clip((hbb * ga - hab * gb) / det, -0.5, 0.5), -4, 4)
            b = np.clip(b + np.clip((haa * gb - hab * ga) / det, -0.5, 0.5), -6, 6)
        if last is not None and abs(total - last) < tol:
            break
        last = total
    packed.unpersist()
    return spark.createDataFrame([(i, float(x), float(y)) for i, x, y in zip(ids, a, b)], f"item {kind}, discrimination double, difficulty double").where("discrimination > 0")


def _packed_answers(answers: DataFrame, ids: list, kind: str) -> tuple[DataFrame, int]:
    """Blocks of different answer patterns, persisted, and their partitions. A block has its patterns' weights and lengths, and of
    each answer in them the item's number, how often it was answered and the sum of y."""
    import pyarrow as pa

    spark = answers.sparkSession
    numbers = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"item {kind}, k int")
    own = answers.join(numbers, "item").groupBy("person", "k").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("y").cast("double")).alias("r"))
    patterns = own.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("k", "n", "r"))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).cast("double").alias("w"))
    patterns = patterns.persist()
    answered = patterns.agg(F.sum(F.size("p"))).first()[0] or 0
    parts = int(answered // BLOCK) + 1
    names = ["w", "lengths", "k", "n", "r"]

    def pack(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                piece = batch.slice(first, 4096)
                p = piece.column("p")
                flat, lengths = p.flatten(), np.diff(p.offsets.to_numpy())
                cols = [piece.column("w").to_numpy(), lengths.astype(np.int32), *(flat.field(i).to_numpy() for i in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names)

    packed = patterns.coalesce(1) if parts == 1 else patterns.repartition(parts)
    packed = packed.mapInArrow(pack, ", ".join(f"{c} binary" for c in names)).persist()
    packed.count()
    patterns.unpersist()
    return packed, parts


def _expected(a: np.ndarray, b: np.ndarray, grid: np.ndarray):
    """Of blocks, by item's number: how often it is answered and solved at each point, as expected; by -1: the log likelihood."""

    def run(batches):
        import pyarrow as pa

        x = a[:, None] * (grid - b[:, None])
        solve, fail = -np.logaddexp(0, -x), -np.logaddexp(0, x)
        sums, seen, total = np.zeros((2, *x.shape)), np.zeros(len(a), bool), 0.0
        for batch in batches:
            for w, lengths, k, n, r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                w, lengths, k, n, r = np.frombuffer(w), np.frombuffer(lengths, np.int32), np.frombuffer(k, np.int32), np.frombuffer(n), np.frombuffer(r)
                starts = np.cumsum(lengths) - lengths
                ll = np.add.reduceat(r[:, None] * solve[k] + (n - r)[:, None] * fail[k], starts) - grid**2 / 2
                top = ll.max(1, keepdims=True)
                post = np.exp(ll - top)
                z = post.sum(1, keepdims=True)
                total += float(w @ (top + np.log(z))[:, 0])
                post = np.repeat(post * (w[:, None] / z), lengths, axis=0)
                order = np.argsort(k, kind="stable")
                own, first = np.unique(k[order], return_index=True)
                seen[own] = True
                for part, times in zip(sums, (n, r)):
                    part[own] += np.add.reduceat((post * times[:, None])[order], first)
        some = np.flatnonzero(seen)
        rows = [sums[:, i].tobytes() for i in some] + [np.array([total]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(rows, pa.binary())], ["k", "sums"])

    return run


def _summed(batches):
    """One row of sums for each k."""
    import pyarrow as pa

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("k").to_pylist(), batch.column("sums").to_pylist()):
            part = np.frombuffer(raw)
            sums[k] = sums[k] + part if k in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["k", "sums"])


def principal_factors(wide: DataFrame, columns: list[str], factors: int) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and eigenvalues of a principal-axis factoring of the columns' correlation matrix, which is one aggregate."""
    from .sensitivity import _moments

    _, _, cov = _moments(wide, columns)
    corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    shared = 1 - 1 / np.diag(np.linalg.inv(corr))
    for _ in range(50):
        reduced = corr.copy()
        np.fill_diagonal(reduced, shared)
        values, vectors = np.linalg.eigh(reduced)
        values, vectors = values[::-1][:factors], vectors[:, ::-1][:, :factors]
        loadings = vectors * np.sqrt(np.maximum(values, 0))
        shared = np.clip((loadings**2).sum(1), 0, 1)
    return loadings, values
