"""The batch engine: which instruments apply to which series, their results as decisions, and conformity decisions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mathx
from . import agreement, charts, sequential

SERIES = ("task_id", "agent_id")


@dataclass(frozen=True)
class IrrConfig:
    threshold: float = 0.67
    metric: str = "krippendorff"
    min_raters: int = 2


@dataclass(frozen=True)
class SequentialConfig:
    alpha: float = 0.05
    beta: float = 0.1
    theta0: float = 0.0
    tau2: float = 1.0


@dataclass(frozen=True)
class SpcConfig:
    chart: str = "ewma"
    phase1: int = 20
    window: int | None = None  # None: one window a run; else rows of a window
    lam: float = 0.2
    width: float = 2.962


@dataclass(frozen=True)
class AnalysisConfig:
    irr: IrrConfig = field(default_factory=IrrConfig)
    sequential: SequentialConfig = field(default_factory=SequentialConfig)
    spc: SpcConfig = field(default_factory=SpcConfig)
    force_enable: tuple[str, ...] = ()
    force_disable: tuple[str, ...] = ()


INSTRUMENTS = ("irr", "sequential", "spc")


def series_profile(trials: DataFrame, keys=SERIES) -> DataFrame:
    """One row a series: records, judges, runs, whether all outcomes are binary."""
    judge = F.col("judge_model") if "judge_model" in trials.columns else F.lit(None)
    binary = F.col("outcome_type") == "Binary" if "outcome_type" in trials.columns else F.lit(True)
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(judge).alias("judges"), F.count_distinct("run_id").alias("runs"), F.bool_and(binary).alias("all_binary")
    )


def detect(trials: DataFrame, config: AnalysisConfig = AnalysisConfig(), keys=SERIES) -> DataFrame:
    """(instrument, enabled): by what any series has; forced ones win over blocked ones, which block detection only."""
    s = series_profile(trials, keys).agg(F.max((F.col("judges") >= 2).cast("int")).alias("irr"), F.max((F.col("records") >= 10).cast("int")).alias("sequential"), F.max((F.col("runs") >= 2).cast("int")).alias("spc"))
    rows = s.select(F.explode(F.array(*[F.struct(F.lit(i).alias("instrument"), (F.coalesce(F.col(i), F.lit(0)) == 1).alias("found")) for i in INSTRUMENTS])).alias("r")).select("r.*")
    enabled = F.col("instrument").isin(list(config.force_enable)) | (F.col("found") & ~F.col("instrument").isin(list(config.force_disable)))
    return rows.select("instrument", enabled.alias("enabled"))


def analyze_sequential(trials: DataFrame, config: SequentialConfig = SequentialConfig(), keys=SERIES) -> DataFrame:
    """For each series: stop_early at the first e-value of 1/alpha, with the estimate there, else continue_running.

    The family of a series is Bernoulli if all its outcomes are of type Binary, else normal; without the column
    outcome_type it is normal.
    """
    binary = F.bool_and(F.col("outcome_type") == "Binary").over(Window.partitionBy(*keys)) if "outcome_type" in trials.columns else F.lit(False)
    s = trials.select(*keys, "ord", F.col("value").alias("x"), F.coalesce(binary, F.lit(False)).alias("all_binary"))
    df = sequential.anytime(s, config.alpha, config.theta0, config.tau2, "by_series", None, keys)
    hit = F.when(F.col("e_value") >= 1 / config.alpha, F.struct("n", "lower", "upper", "e_value"))
    last = F.struct("n", "lower", "upper", "e_value")
    g = df.groupBy(*keys).agg(F.min(hit).alias("hit"), F.max(last).alias("last"))
    at = F.coalesce("hit", "last")
    return g.select(
        *keys, F.when(F.col("hit").isNotNull(), "stop_early").otherwise("continue_running").alias("kind"), at["n"].alias("n"),
        ((at["lower"] + at["upper"]) / 2).alias("estimate"), at["lower"].alias("lower"), at["upper"].alias("upper"),
    )


def windows(trials: DataFrame, config: SpcConfig = SpcConfig(), keys=SERIES) -> DataFrame:
    """(keys, ord, x): means of runs in order of (first time, run), or of rows in order, the short tail included."""
    if config.window is None:
        runs = trials.groupBy(*keys, "run_id").agg(F.avg("value").alias("x"), F.min("ts").alias("t"))
        return runs.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("t", "run_id")).cast("long").alias("ord"), "x")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    cut = trials.withColumn("_w", F.floor((n - 1) / config.window).cast("long") + 1)
    return cut.groupBy(*keys, F.col("_w").alias("ord")).agg(F.avg("value").alias("x"))


def analyze_spc(trials: DataFrame, config: SpcConfig = SpcConfig(), keys=SERIES) -> DataFrame:
    """For each series: phase 1 limits, windows charted and regressions (signals) in phase 2; without spread or phase 2: in control."""
    w = charts.with_limits(windows(trials, config, keys), keys, config.phase1)
    two = w.where("phase = 2 AND sigma > 0")
    if config.chart == "ewma":
        signals = charts.ewma(two, keys, config.lam, config.width).withColumn("hit", F.col("signal"))
    elif config.chart == "cusum":
        signals = charts.cusum(two, keys).withColumn("hit", F.col("signal").isNotNull())
    elif config.chart == "shewhart":
        signals = charts.shewhart(two, keys).withColumn("hit", F.col("kind") == "out_of_control")
    else:
        signals = charts.combined(two, keys).withColumn("hit", F.col("signal").isNotNull())
    found = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("charted"), F.count_if("hit").alias("regressions"), F.min(F.when(F.col("hit"), F.col("ord"))).alias("first"))
    base = w.groupBy(*keys).agg(F.max("mu").alias("mu"), F.max("sigma").alias("sigma"), F.count(F.lit(1)).alias("windows"))
    out = base.join(found, list(keys), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        *keys, "windows", "mu", "sigma", F.coalesce("charted", zero).alias("charted"), F.coalesce("regressions", zero).alias("regressions"), "first",
        F.when(F.coalesce("regressions", zero) > 0, "regression").otherwise("in_control").alias("kind"),
    )


def analyze_irr(ratings: DataFrame, config: IrrConfig = IrrConfig(), keys=SERIES) -> DataFrame:
    """ratings (keys, item, rater, label): agreement and a warning per series; all series, in one plan."""
    raters = ratings.groupBy(*keys).agg(F.count_distinct("rater").alias("raters"))
    twice = ratings.groupBy(*keys, "item", "rater").count().where("count > 1").select(*keys).distinct().withColumn("twice", F.lit(True))
    metric = {"krippendorff": lambda: agreement.krippendorff_alpha(ratings, "nominal", keys), "fleiss": lambda: agreement.fleiss_kappa(ratings, keys), "gwet": lambda: agreement.gwet(ratings, "identity", keys)}[config.metric]()
    out = raters.join(twice, list(keys), "left").join(metric, list(keys), "left")
    usable = (F.col("raters") >= config.min_raters) & F.col("twice").isNull()
    warning = F.when(F.col("raters") < config.min_raters, "insufficient_raters").when(F.col("twice"), "insufficient_samples").when(F.col("value") < config.threshold, "low_agreement")
    return out.select(*keys, "raters", F.when(usable, F.col("value")).alias("value"), warning.alias("warning"))


def analyze(trials: DataFrame, config: AnalysisConfig = AnalysisConfig(), keys=SERIES) -> DataFrame:
    """All enabled instruments over all series: (instrument, keys, kind, n, estimate, lower, upper), a decision a row.

    trials: keys, ord, run_id, ts, value; outcome_type, judge_model and item where they are known. Agreement needs
    judge_model and item, and gives a row only where it warns. Raises without trials and without an instrument that applies.
    """
    if trials.isEmpty():
        raise ValueError("there are no trials")
    enabled = [r["instrument"] for r in detect(trials, config, keys).where("enabled").collect()]  # three rows
    parts, none = [], F.lit(None).cast("double")
    if "irr" in enabled and {"judge_model", "item"} <= set(trials.columns):
        ratings = trials.where("judge_model IS NOT NULL").select(*keys, "item", F.col("judge_model").alias("rater"), F.col("value").alias("label"))
        found = analyze_irr(ratings, config.irr, keys).where("warning IS NOT NULL")
        parts.append(found.select(F.lit("irr").alias("instrument"), *keys, F.col("warning").alias("kind"), F.col("raters").cast("long").alias("n"), F.col("value").cast("double").alias("estimate"), none.alias("lower"), none.alias("upper")))
    if "sequential" in enabled:
        found = analyze_sequential(trials, config.sequential, keys)
        parts.append(found.select(F.lit("sequential").alias("instrument"), *keys, "kind", F.col("n").cast("long").alias("n"), "estimate", "lower", "upper"))
    if "spc" in enabled:
        found = analyze_spc(trials, config.spc, keys)
        parts.append(found.select(F.lit("spc").alias("instrument"), *keys, "kind", F.col("windows").cast("long").alias("n"), F.col("mu").alias("estimate"), none.alias("lower"), none.alias("upper")))
    if not parts:
        raise ValueError("no instrument applies")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out



def conformity(estimate: Column, uncertainty: Column, threshold: Column, guard: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """(margin, confidence ratio, decision): accept if the lower end passes threshold + guard, reject if the upper end is below."""
    guard = guard if isinstance(guard, Column) else F.lit(float(guard))
    margin = estimate - threshold
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    cr = F.when(uncertainty != 0, margin / F.when(uncertainty == 0, F.lit(1.0)).otherwise(uncertainty)).when(margin > 0, inf).when(margin < 0, -inf).otherwise(nan)
    decision = F.when(estimate - uncertainty >= threshold + guard, "accept").when(estimate + uncertainty < threshold, "reject").otherwise("investigate")
    return margin, cr, decision


def from_interval(lower: Column, upper: Column) -> tuple[Column, Column]:
    """(estimate, uncertainty) of an interval; null if it is inverted."""
    fine = lower <= upper
    return F.when(fine, (lower + upper) / 2), F.when(fine, (upper - lower) / 2)


def guard_band(uncertainty: Column, risk: float, coverage: float = 2.0) -> Column:
    """The band that holds the risk of a false acceptance."""
    return mathx.probit(F.lit(1 - risk)) / coverage * uncertainty


def hint(kind: Column, n: Column, value: Column) -> Column:
    """A sentence for a decision."""
    return (
        F.when(kind == "stop_early", F.format_string("Evidence is conclusive after %d observations; stop.", n))
        .when(kind == "continue_running", F.format_string("Not conclusive after %d observations; keep running.", n))
        .when(kind == "regression", F.format_string("The mean has moved to %.3f; look for a change.", value))
        .otherwise("Nothing to do.")
    )
