"""Control charts as window expressions over ordered series.

Input: (keys..., ord, x) with control limits mu and sigma as columns. One partitioning and one sort serve all
charts of a series; the recursions are the exact closed forms of running sums and running extremes. Non-finite
x gives a null z, which every chart treats as no signal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _run(keys, order="ord"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _back(keys, rows, order="ord"):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, 0)


def with_limits(series: DataFrame, keys=("series",), baseline: int = 20, order="ord") -> DataFrame:
    """Adds mu and sigma from the first ``baseline`` rows of each series (sample standard deviation) and phase 1 or 2."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    numbered = series.withColumn("n", n.cast("long"))
    whole = Window.partitionBy(*keys)
    first = F.when(F.col("n") <= baseline, F.col("x"))
    return numbered.withColumn("mu", F.avg(first).over(whole)).withColumn("sigma", F.stddev_samp(first).over(whole)).withColumn("phase", F.when(F.col("n") <= baseline, 1).otherwise(2))


def standardized(df: DataFrame) -> DataFrame:
    fine = ~F.isnan("x") & (F.abs("x") < F.lit(float("inf")))
    return df.withColumn("z", F.when(fine & (F.col("sigma") > 0), (F.col("x") - F.col("mu")) / F.col("sigma")))


def lindley(df: DataFrame, step: Column, name: str, keys=("series",), start: float = 0.0, order="ord") -> DataFrame:
    """name = max(0, previous + step), from ``start``: the running sum less its running minimum."""
    w = _run(keys, order)
    summed = df.withColumn(f"_{name}", F.sum(step).over(w))
    return summed.withColumn(name, F.col(f"_{name}") - F.least(F.lit(-float(start)), F.min(f"_{name}").over(w))).drop(f"_{name}")


def cusum(df: DataFrame, keys=("series",), k: float = 0.5, h: float = 5.0, head_start: float = 0.0, order="ord") -> DataFrame:
    """Adds c_plus, c_minus and signal ('upper' is reported before 'lower'); the state is not reset after a signal."""
    df = standardized(df)
    df = lindley(df, F.col("z") - k, "c_plus", keys, head_start, order)
    df = lindley(df, -F.col("z") - k, "c_minus", keys, head_start, order)
    return df.withColumn("signal", F.when(F.col("c_plus") > h, "upper").when(F.col("c_minus") > h, "lower"))


def shewhart(df: DataFrame, keys=("series",), rules=(1,), k: float = 3.0, order="ord") -> DataFrame:
    """Adds kind: out_of_control by the first rule that holds (in the order given), else warning beyond 2 sigma."""
    df = standardized(df)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    df = df.withColumn("_n", n)

    def runs(rows: int, need: int, beyond: float) -> Column:
        w = _back(keys, rows - 1, order)
        up, down = F.count_if(F.col("z") > beyond).over(w), F.count_if(F.col("z") < -beyond).over(w)
        return (F.col("_n") >= rows) & ((up >= need) | (down >= need))

    tests = {1: F.abs("z") > k, 2: runs(3, 2, 2.0), 3: runs(5, 4, 1.0), 4: runs(8, 8, 0.0)}
    rule = F.coalesce(*[F.when(tests[r], F.lit(r)) for r in rules])
    df = df.withColumn("rule", rule)
    return df.withColumn("kind", F.when(F.col("rule").isNotNull(), "out_of_control").when(F.abs("z") > 2, "warning").otherwise("in_control")).drop("_n")


def ewma(df: DataFrame, keys=("series",), lam: float = 0.2, width: float = 2.962, order="ord") -> DataFrame:
    """Adds ewma, limit (distance from mu) and signal.

    A series is cut into blocks over which a weight falls by a factor of 10**4. Within a block the weighted sum is a running sum
    of x, scaled up by what the weights fall; what came before is the sums of the five blocks before, for the weight of
    older ones is below 10**-20, or mu at the beginning. A task's state is five blocks, whatever the length of a series.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    df = df.withColumn("_n", n)
    x, mu = F.col("x").cast("double"), F.col("mu").cast("double")
    if lam >= 1:
        z = x
    else:
        keep = 1 - lam
        block = max(1, int(math.log(1e4) / -math.log(keep)))
        df = df.withColumn("_b", F.floor((F.col("_n") - 1) / block).cast("long")).withColumn("_i", (F.col("_n") - 1) % block)
        own = Window.partitionBy(*keys, "_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_s", F.sum(lam * x * F.pow(F.lit(keep), -(F.col("_i") + 1))).over(own)).withColumn("_t", lam * x * F.pow(F.lit(keep), block - 1 - F.col("_i")))
        fall, prior = keep**block, F.when(F.col("_b") <= 5, mu * F.pow(F.lit(keep**block), F.col("_b"))).otherwise(0.0)
        for j in range(1, 6):
            before = F.sum("_t").over(Window.partitionBy(*keys).orderBy("_b").rangeBetween(-j, -j))
            prior = prior + F.coalesce(before, F.lit(0.0)) * fall ** (j - 1)
        z = F.pow(F.lit(keep), F.col("_i") + 1) * (prior + F.col("_s"))
    df = df.withColumn("ewma", z)
    factor = 1 - F.pow(F.lit(1 - lam), 2 * F.col("_n"))
    df = df.withColumn("limit", width * F.col("sigma") * F.sqrt(lam / (2 - lam) * factor)).drop("_n", "_b", "_i", "_s", "_t")
    return df.withColumn("signal", F.abs(F.col("ewma") - F.col("mu")) > F.col("limit"))


def combined(df: DataFrame, keys=("series",), k: float = 0.5, h: float = 5.0, spike: float = 3.5, order="ord") -> DataFrame:
    """Shewhart beyond ``spike`` first, else CUSUM, which goes on either way."""
    df = cusum(df, keys, k, h, 0.0, order)
    return df.withColumn("signal", F.when(F.abs("z") > spike, "shewhart").otherwise(F.col("signal")))


def e_detector(df: DataFrame, keys=("series",), alpha: float = 0.05, tau2: float = 1.0, window: int | None = None, order="ord", log_e: Column | None = None) -> DataFrame:
    """Adds e_stat and signal. log_e: any log e-value of a row; by default that of a Gaussian mixture on z.

    Without a window the detector may restart at every row (growing); with one it multiplies the last rows.
    """
    df = standardized(df)
    log_e = log_e if log_e is not None else -0.5 * F.log(F.lit(1 + tau2)) + F.col("z") * F.col("z") * tau2 / (2 * (1 + tau2))
    if window:
        df = df.withColumn("e_stat", F.exp(F.sum(log_e).over(_back(keys, window - 1, order))))
    else:
        df = lindley(df, log_e, "e_stat", keys, 0.0, order).withColumn("e_stat", F.exp("e_stat"))
    return df.withColumn("signal", F.col("e_stat") >= 1 / alpha)


def first_signal(df: DataFrame, keys=("series",), order="ord") -> DataFrame:
    """The first row of each series with a signal, by position; null without one."""
    hit = F.when(F.col("signal").cast("string").isin("true", "upper", "lower", "shewhart"), F.col(order))
    return df.groupBy(*keys).agg(F.min(hit).alias("first_signal"))


def g_theory_sigma(var_pi: Column, var_pr: Column, var_pir: Column, n_i: Column, n_r: Column) -> Column:
    """Standard error of a mean over items and raters from variance components."""
    return F.sqrt(var_pi / n_i + var_pr / n_r + var_pir / (n_i * n_r))
