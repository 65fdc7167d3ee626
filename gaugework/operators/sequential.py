"""Anytime-valid sequential inference over ordered series (keys..., ord, x), as window expressions.

All monitors are running sums; a decision is latched by the first crossing. One sort per series serves all.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mathx, rng


def _run(keys):
    return Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)


def wald_bounds(alpha: float, beta: float, conservative: bool = False) -> tuple[float, float]:
    """Upper and lower bound of the likelihood ratio."""
    if not (0 < alpha < 1 and 0 < beta < 1 and alpha + beta < 1):
        raise ValueError("alpha and beta must be in (0, 1) and sum to less than 1")
    return (1 / alpha, beta) if conservative else ((1 - beta) / alpha, beta / (1 - alpha))


def llr_bernoulli(x: Column, p0: float, p1: float) -> Column:
    return x * math.log(p1 / p0) + (1 - x) * math.log((1 - p1) / (1 - p0))


def llr_normal(x: Column, mu0: float, mu1: float, var: float = 1.0) -> Column:
    return (mu1 - mu0) * x / var - (mu1**2 - mu0**2) / (2 * var)


def sprt(series: DataFrame, llr: Column, upper: float, lower: float, keys=("series",)) -> DataFrame:
    """Adds log_lr and decision; after the first crossing the decision stays."""
    w = _run(keys)
    df = series.withColumn("log_lr", F.sum(llr).over(w))
    hit = F.when(F.col("log_lr") >= math.log(upper), "reject").when(F.col("log_lr") <= math.log(lower), "accept")
    return df.withColumn("decision", F.coalesce(F.first(hit, ignorenulls=True).over(w), F.lit("continue")))


def sprt_boosted(series: DataFrame, llr: Column, alpha: float, keys=("series",)) -> DataFrame:
    """Adds log_m: the running product held at most 1/alpha; rejects there and never accepts."""
    w, top = _run(keys), math.log(1 / alpha)
    df = series.withColumn("_s", F.sum(llr).over(w))
    df = df.withColumn("log_m", F.col("_s") - F.greatest(F.lit(0.0), F.max(F.col("_s") - top).over(w))).drop("_s")
    return df.withColumn("decision", F.when(F.max(F.col("log_m")).over(w) >= top - 1e-12, "reject").otherwise("continue"))


def stopping(df: DataFrame, keys=("series",)) -> DataFrame:
    """The row of each series at which its decision is made (the last row if none is)."""
    decided = F.when(F.col("decision") != "continue", F.struct("ord", "decision"))
    g = df.groupBy(*keys).agg(F.min(decided).alias("d"), F.max("ord").alias("end"))
    return g.select(*keys, F.coalesce(F.col("d.ord"), F.col("end")).alias("stop"), F.coalesce(F.col("d.decision"), F.lit("continue")).alias("decision"))


def msprt_normal(series: DataFrame, theta0: float = 0.0, tau2: float = 1.0, keys=("series",)) -> DataFrame:
    """Adds n, log_lr of the Gaussian mixture and always_valid_p."""
    w = _run(keys)
    df = series.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")).cast("double")).withColumn("_d", F.sum(F.col("x") - theta0).over(w))
    spread = 1 + F.col("n") * tau2
    df = df.withColumn("log_lr", -0.5 * F.log(spread) + F.col("_d") * F.col("_d") * tau2 / (2 * spread)).drop("_d")
    return df.withColumn("always_valid_p", F.least(F.lit(1.0), F.exp(-F.col("log_lr"))))


def msprt_bernoulli(series: DataFrame, p0: float = 0.5, a: float = 1.0, b: float = 1.0, keys=("series",)) -> DataFrame:
    """Adds n, log_lr of the beta mixture and always_valid_p."""
    w = _run(keys)
    df = series.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")).cast("double")).withColumn("_s", F.sum("x").over(w))
    s, f = F.col("_s"), F.col("n") - F.col("_s")
    df = df.withColumn("log_lr", mathx.lbeta(s + a, f + b) - mathx.lbeta(F.lit(a), F.lit(b)) - s * math.log(p0) - f * math.log(1 - p0)).drop("_s")
    return df.withColumn("always_valid_p", F.least(F.lit(1.0), F.exp(-F.col("log_lr"))))


def half_width(sigma, n, alpha: float) -> Column:
    """Half width of the confidence sequence after n observations."""
    n = mathx.col(n)
    return sigma * F.sqrt(2 * (1 + 1 / n) * F.log(F.sqrt(n + 1) / alpha) / n)


def anytime(series: DataFrame, alpha: float = 0.05, theta0: float = 0.0, tau2: float = 1.0, family: str = "bernoulli", variance: float | None = None, keys=("series",)) -> DataFrame:
    """Adds n, mean, lower, upper, e_value, always_valid_p after every observation.

    sigma is 0.5 for Bernoulli data, the root of ``variance`` if it is given, else estimated from the running
    population variance; an interval with an estimated sigma has no coverage guarantee. family "by_series" takes
    Bernoulli where the column all_binary holds, else the estimate.
    """
    w = _run(keys)
    df = msprt_normal(series, theta0, tau2, keys).withColumn("mean", F.avg("x").over(w))
    if family == "bernoulli":
        sigma = F.lit(0.5)
    elif variance is not None:
        sigma = F.lit(math.sqrt(variance))
    else:
        df = df.withColumn("_v", F.var_pop("x").over(w))
        sigma = F.greatest(F.sqrt("_v"), F.lit(1e-10))
        if family == "by_series":
            sigma = F.when(F.col("all_binary"), 0.5).otherwise(sigma)
    df = df.withColumn("_h", half_width(sigma, F.col("n"), alpha))
    df = df.withColumn("lower", F.col("mean") - F.col("_h")).withColumn("upper", F.col("mean") + F.col("_h")).withColumn("e_value", F.exp(F.least("log_lr", F.lit(700.0))))
    return df.drop("_h", "_v")


def confidence_sequence(series: DataFrame, alpha: float = 0.05, family: str = "bernoulli", variance: float | None = None, keys=("series",)) -> DataFrame:
    """One row a series after all its observations: n, mean, lower, upper, cs_width (the full width)."""
    s = series.groupBy(*keys).agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"))
    sigma = F.lit(0.5) if family == "bernoulli" else F.lit(math.sqrt(variance)) if variance is not None else F.greatest(F.sqrt("v"), F.lit(1e-10))
    s = s.withColumn("h", half_width(sigma, F.col("n"), alpha))
    return s.select(*keys, "n", "mean", (F.col("mean") - F.col("h")).alias("lower"), (F.col("mean") + F.col("h")).alias("upper"), (2 * F.col("h")).alias("cs_width"))


def betting_intervals(series: DataFrame, alpha: float = 0.05, grid: int = 100, keys=("series",)) -> DataFrame:
    """Confidence intervals by hedged capital on a grid of means: (keys, lower, upper) after all observations.

    The bets depend on earlier observations only. A mean's log capital is a plain sum over the series, so that
    each (series, mean) is one partial aggregate and no window over the grid is needed.
    """
    if grid < 10:
        raise ValueError("the grid needs at least 10 points")
    order = Window.partitionBy(*keys).orderBy("ord")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    df = series.withColumn("n", F.row_number().over(order).cast("double"))
    df = df.withColumn("_s", F.coalesce(F.sum("x").over(past), F.lit(0.0))).withColumn("_mu_all", (0.5 + F.sum("x").over(order.rowsBetween(Window.unboundedPreceding, 0))) / (F.col("n") + 1))
    df = df.withColumn("_q", (F.col("x") - F.col("_mu_all")) * (F.col("x") - F.col("_mu_all")))
    df = df.withColumn("_v", (0.25 + F.coalesce(F.sum("_q").over(past), F.lit(0.0))) / F.col("n"))
    df = df.withColumn("_bet", F.sqrt(2 * math.log(2 / alpha) / (F.col("_v") * F.col("n") * F.log(F.col("n") + 2))))
    points = df.sparkSession.range(grid).select((F.lit(1e-4) + F.col("id") * ((1 - 2e-4) / (grid - 1))).alias("m"))
    met = df.select(*keys, "x", "_bet").crossJoin(F.broadcast(points))  # the grid is a parameter
    m = F.col("m")
    up = 1 + F.least(F.col("_bet"), 0.5 / m) * (F.col("x") - m)
    down = 1 - F.least(F.col("_bet"), 0.5 / (1 - m)) * (F.col("x") - m)
    log = lambda c: F.log(F.greatest(c, F.lit(1e-300)))
    capital = met.groupBy(*keys, "m").agg(F.sum(log(up)).alias("k_up"), F.sum(log(down)).alias("k_down"))
    inside = F.greatest("k_up", "k_down") + math.log(0.5) < math.log(1 / alpha)
    return capital.groupBy(*keys).agg(F.min(F.when(inside, m)).alias("lower"), F.max(F.when(inside, m)).alias("upper"))


def e_product(df: DataFrame, keys) -> DataFrame:
    """The product of e_value by key (1 if there is none; null if one is negative), p = min(1, 1/e) and the decision at alpha .05."""
    e = df.groupBy(*keys).agg(F.when(F.min("e_value") >= 0, F.exp(F.sum(F.log(F.greatest("e_value", F.lit(1e-300)))))).alias("e"))
    return e.select(*keys, "e", F.least(F.lit(1.0), 1 / F.col("e")).alias("p"), (F.col("e") >= 20).alias("reject"))


def practical_p(series: DataFrame, delta: float, keys=("series",)) -> DataFrame:
    """p of an effect within +-delta, by the larger of the two likelihood ratios."""
    s = series.groupBy(*keys).agg(F.count("x").alias("n"), F.sum("x").alias("s"))
    log_lr = F.greatest(delta * F.col("s"), -delta * F.col("s")) - F.col("n") * delta * delta / 2
    return s.select(*keys, F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(-F.least(log_lr, F.lit(700.0))))).alias("p"))


def mle_bias_corrected(mle: Column, mu0: float, mu1: float, n: Column) -> Column:
    return mle - (mu1 - mu0) / (2 * n)


def median_unbiased(mle: Column, mu0: float, n: Column) -> Column:
    return mu0 + (mle - mu0) * (n - 1) / n


def spending(looks: DataFrame, alpha: float, kind) -> DataFrame:
    """looks (t: information fraction): adds spent, increment and the boundary z of each look by itself.

    ``kind``: pocock, obf, or a function of (column t, alpha) to the column of alpha spent by t.
    """
    t = F.col("t")
    if callable(kind):
        spent = kind(t, alpha)
    elif kind == "pocock":
        spent = alpha * F.log(1 + (math.e - 1) * t)
    elif kind != "obf":
        raise ValueError(f"no spending function {kind}")
    else:
        spent = 2 * (1 - mathx.phi(mathx.probit(F.lit(1 - alpha / 2)) / F.sqrt(t)))
    df = looks.withColumn("spent", spent)
    df = df.withColumn("increment", F.col("spent") - F.coalesce(F.lag("spent").over(Window.orderBy("t")), F.lit(0.0)))  # a few looks
    return df.withColumn("boundary", mathx.probit(1 - F.col("increment") / 2))


@lru_cache(maxsize=64)
def group_constant(looks: int, alpha: float, kind: str) -> float:
    """c with P(max |S_k| / sqrt(k) >= c) = alpha (pocock) or P(|S_k| >= c sqrt(K) for some k) = alpha (obf), S a random walk of normals.

    The density of S among paths still inside is carried from look to look on a grid, and c found by bisection.
    """

    def crossing(c: float) -> float:
        points, step_sd = 801, 1.0
        edge = c if kind == "pocock" else c * math.sqrt(looks)
        x = np.linspace(-edge, edge, points)
        density = np.exp(-(x**2) / 2) / math.sqrt(2 * math.pi)
        for k in range(2, looks + 1):
            edge2 = c * math.sqrt(k) if kind == "pocock" else c * math.sqrt(looks)
            y = np.linspace(-edge2, edge2, points)
            w = np.full(points, x[1] - x[0])
            w[[0, -1]] /= 2
            kernel = np.exp(-((y[:, None] - x[None, :]) ** 2) / (2 * step_sd**2)) / math.sqrt(2 * math.pi)
            density, x = kernel @ (density * w), y
        w = np.full(points, x[1] - x[0])
        w[[0, -1]] /= 2
        return 1 - float(density @ w)

    low, high = 0.5, 6.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if crossing(mid) > alpha else (low, mid)
    return (low + high) / 2


def group_bounds(looks: int, alpha: float, kind: str) -> list[float]:
    c = group_constant(looks, alpha, kind)
    return [c if kind == "pocock" else c * math.sqrt(looks / k) for k in range(1, looks + 1)]


def group_monitor(scores: DataFrame, bounds: list[float], keys=("series",)) -> DataFrame:
    """scores (keys, look, z): reject at the first |z| over its bound, accept at the last look, else continue; too many looks: error."""
    spark = scores.sparkSession
    b = spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(bounds)], "look int, bound double")
    met = scores.join(F.broadcast(b), "look", "left")
    hit = F.min(F.when(F.abs("z") >= F.col("bound"), F.col("look")))
    g = met.groupBy(*keys).agg(hit.alias("hit"), F.max("look").alias("last"))
    decision = F.when(F.col("last") > len(bounds), "error").when(F.col("hit").isNotNull(), "reject").when(F.col("last") == len(bounds), "accept").otherwise("continue")
    return g.select(*keys, F.coalesce("hit", "last").alias("look"), decision.alias("decision"))


def permutation_stops(series: DataFrame, reps: int, seed: int, alpha: float = 0.05, p0: float = 0.5, keys=("series",)) -> DataFrame:
    """For each of ``reps`` seeded orders of each series, when the Bernoulli mixture test would have stopped: (keys, rep, stopped, n, final_p)."""
    spark = series.sparkSession
    copies = series.crossJoin(F.broadcast(spark.range(reps).select(F.col("id").alias("rep"))))
    shuffled = copies.withColumn("_k", rng.shuffle_key(seed, F.col("rep"), F.col("ord")))
    order = Window.partitionBy(*keys, "rep").orderBy("_k")
    df = shuffled.select(*keys, "rep", "x", F.row_number().over(order).alias("ord"))
    df = msprt_bernoulli(df, p0, keys=(*keys, "rep"))
    g = df.groupBy(*keys, "rep").agg(F.min(F.when(F.col("always_valid_p") <= alpha, F.col("ord"))).alias("hit"), F.max("ord").alias("all"), F.max_by("always_valid_p", "ord").alias("final_p"))
    return g.select(*keys, "rep", F.col("hit").isNotNull().alias("stopped"), F.coalesce("hit", "all").alias("n"), "final_p")


def stop_by_width(h: float, alpha: float = 0.05, sigma: float = 0.5, most: int = 1 << 40) -> int:
    """The n at which the confidence sequence's half width first is below h: it depends on no data, so no permutation is needed."""

    def wide(n: int) -> bool:
        return sigma * math.sqrt(2 * (1 + 1 / n) * math.log(math.sqrt(n + 1) / alpha) / n) >= h

    low, high = 0, 1
    while wide(high) and high < most:
        low, high = high, high * 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if wide(mid) else (low, mid)
    return high
