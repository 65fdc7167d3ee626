"""Inter-rater agreement over long tables (item, rater, label), for every value of the key columns at once.

Each function returns one row a key with ``value`` and ``status`` ('ok', or why the value is null).
Counts algebra replaces joins of raters with raters: n(item, label) and its sums carry all statistics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mathx, rng
from ..functions.storage import scratch

TINY = 1e-15


def _settle(df: DataFrame, keys, observed, chance, no_data="no_data", perfect: bool = True) -> DataFrame:
    """value = (observed - chance) / (1 - chance); perfect agreement is 1 even where chance is 1."""
    near1 = F.abs(1 - observed) < TINY
    flat = F.abs(1 - chance) < TINY
    value = F.when(near1 & F.lit(perfect), F.lit(1.0)).when(~flat, (observed - chance) / (1 - chance))
    status = F.when(observed.isNull(), no_data).when(near1 & F.lit(perfect), "ok").when(flat, "degenerate").otherwise("ok")
    return df.select(*keys, value.alias("value"), status.alias("status"))


def pair_ratings(ratings: DataFrame, first, second, keys=()) -> DataFrame:
    """(keys, item, a, b): the labels of two raters on the items that both rated."""
    one = ratings.where(F.col("rater") == F.lit(first)).select(*keys, "item", F.col("label").alias("a"))
    two = ratings.where(F.col("rater") == F.lit(second)).select(*keys, "item", F.col("label").alias("b"))
    return one.join(two, [*keys, "item"])


def _marginals(pairs: DataFrame, keys) -> DataFrame:
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("label"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("s"))
    return sides.groupBy(*keys, F.col("s.label").alias("label")).agg(F.sum("s.x").alias("ca"), F.sum("s.y").alias("cb"))


def _with(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    return left.join(right, list(keys)) if keys else left.crossJoin(right)  # both sides have one row


def cohen_kappa(pairs: DataFrame, keys=()) -> DataFrame:
    """Cohen's kappa of label columns a and b."""
    agree = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"))
    chance = _marginals(pairs, keys).groupBy(*keys).agg(F.sum(F.col("ca") * F.col("cb")).alias("s"))
    both = _with(agree, chance, keys)
    return _settle(both, keys, F.col("po"), mathx.ratio(F.col("s"), F.col("n") * F.col("n")))


def cohen_weighted(pairs: DataFrame, keys=(), weight: str | Callable = "quadratic") -> DataFrame:
    """Weighted kappa by disagreement weights on the label values: 'linear', 'quadratic' or a function of two columns."""
    w = {"linear": lambda a, b: F.abs(a - b), "quadratic": lambda a, b: (a - b) * (a - b)}.get(weight, weight)
    seen = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(w(F.col("a"), F.col("b")).cast("double")).alias("wo"))
    m = _marginals(pairs, keys)
    left, right = m.select(*keys, F.col("label").alias("la"), "ca"), m.select(*keys, F.col("label").alias("lb"), "cb")
    met = _with(left, right, keys).groupBy(*keys).agg(F.sum((F.col("ca") * F.col("cb") * w(F.col("la"), F.col("lb"))).cast("double")).alias("s"))
    both = _with(seen, met, keys).withColumn("we", mathx.ratio(F.col("s"), F.col("n") * F.col("n")))
    value = F.when(F.col("wo") < TINY, F.lit(1.0)).when(F.col("we") >= TINY, 1 - F.col("wo") / F.col("we"))
    status = F.when(F.col("n") == 0, "no_data").when(value.isNull(), "degenerate").otherwise("ok")
    return both.select(*keys, value.alias("value"), status.alias("status"))


def counts(ratings: DataFrame, keys=()) -> DataFrame:
    """(keys, item, label, c): how often an item got a label."""
    return ratings.where("label IS NOT NULL").groupBy(*keys, "item", "label").agg(F.count(F.lit(1)).alias("c"))


def fleiss_kappa(ratings: DataFrame, keys=()) -> DataFrame:
    """Fleiss' kappa; needs the same number of raters, at least two, for every item."""
    n = counts(ratings, keys)
    items = n.groupBy(*keys, "item").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    agree = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.min("k").alias("least"), F.max("k").alias("most"),
        F.avg(F.try_divide(F.col("s2") - F.col("k"), F.col("k") * (F.col("k") - 1))).alias("po"),
    )
    chance = n.groupBy(*keys, "label").agg(F.sum("c").alias("c")).groupBy(*keys).agg(F.sum(F.col("c") * F.col("c")).alias("q"), F.sum("c").alias("all"))
    both = _with(agree, chance, keys)
    whole = (F.col("least") == F.col("most")) & (F.col("least") >= 2)
    settled = _settle(both.withColumn("po", F.when(whole, F.col("po"))), keys, F.col("po"), F.col("q") / (F.col("all") * F.col("all")), "incomplete")
    return settled


def _distance(level: str, a, b, na=None, nb=None, cum_a=None, cum_b=None):
    if level == "nominal":
        return (a != b).cast("double")
    if level == "interval":
        return ((a - b) * (a - b)).cast("double")
    if level == "ratio":
        return F.when(a + b == 0, F.lit(0.0)).otherwise(((a - b) / (a + b)) ** 2)
    between = F.abs(cum_b - cum_a) + F.when(cum_b >= cum_a, na).otherwise(nb)  # labels from a to b, both included
    return (between - (na + nb) / 2) ** 2


def krippendorff_alpha(ratings: DataFrame, level: str, keys=()) -> DataFrame:
    """Krippendorff's alpha at a level: nominal, ordinal, interval or ratio. Items with one rating are left out."""
    n = counts(ratings, keys)
    per_item = Window.partitionBy(*keys, "item")
    n = n.withColumn("m", F.sum("c").over(per_item)).where("m >= 2")
    totals = n.groupBy(*keys, "label").agg(F.sum("c").alias("nc"))
    order = Window.partitionBy(*keys).orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("cum", F.sum("nc").over(order)).withColumn("cum", F.col("cum").cast("double"))
    a, b = (totals.select(*keys, F.col("label").alias(f"l{s}"), F.col("nc").alias(f"n{s}"), F.col("cum").alias(f"c{s}")) for s in "ab")
    pairs = _with(a, b, keys).where("la < lb")
    d = _distance(level, F.col("la"), F.col("lb"), F.col("na"), F.col("nb"), F.col("ca"), F.col("cb"))
    pairs = pairs.select(*keys, "la", "lb", "na", "nb", d.alias("d"))
    x, y = n.select(*keys, "item", F.col("label").alias("la"), F.col("c").alias("x"), "m"), n.select(*keys, "item", F.col("label").alias("lb"), F.col("c").alias("y"))
    met = x.join(y, [*keys, "item"]).where("la < lb").groupBy(*keys, "la", "lb").agg(F.sum(F.col("x") * F.col("y") / (F.col("m") - 1)).alias("o"))
    seen = met.join(pairs.select(*keys, "la", "lb", "d"), [*keys, "la", "lb"]).groupBy(*keys).agg(F.sum(F.col("o") * F.col("d")).alias("do"))
    chance = pairs.groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb") * F.col("d")).alias("de"))
    size = totals.groupBy(*keys).agg(F.sum("nc").alias("n"))
    if keys:
        all_ = size.join(chance, list(keys), "left").join(seen, list(keys), "left")
    else:
        all_ = size.crossJoin(chance).crossJoin(seen)
    de = F.coalesce("de", F.lit(0.0)) / (F.col("n") - 1)
    value = F.when((F.col("n") >= 2) & (de > TINY), 1 - F.coalesce("do", F.lit(0.0)) / de)
    status = F.when(F.coalesce("n", F.lit(0)) < 2, "no_data").when(value.isNull(), "degenerate").otherwise("ok")
    return all_.select(*keys, value.alias("value"), status.alias("status"))


def weight_table(labels: DataFrame, scheme: str) -> DataFrame:
    """(ca, cb, w): agreement weights by the ranks of the labels: identity, linear, quadratic or ordinal."""
    ranked = labels.select("label").distinct().withColumn("rank", F.row_number().over(Window.orderBy("label")))  # few labels
    q = ranked.agg(F.count(F.lit(1)).alias("q"))
    a, b = ranked.select(F.col("label").alias("ca"), F.col("rank").alias("i")), ranked.select(F.col("label").alias("cb"), F.col("rank").alias("j"))
    both = a.crossJoin(b).crossJoin(q)
    gap = F.abs(F.col("i") - F.col("j"))
    w = {
        "identity": (gap == 0).cast("double"),
        "linear": 1 - gap / (F.col("q") - 1),
        "quadratic": 1 - gap * gap / ((F.col("q") - 1) * (F.col("q") - 1)),
        "ordinal": 1 - (gap + 1) * gap / (F.col("q") * (F.col("q") - 1)),
    }[scheme]
    return both.select("ca", "cb", F.when(F.col("q") <= 1, F.lit(1.0)).otherwise(w).alias("w"))


def custom_weights(spark, categories: list, matrix: list[list[float]]) -> DataFrame:
    """(ca, cb, w) of a matrix over the sorted categories: symmetric, ones on the diagonal, within 0 and 1, else ValueError."""
    cats, slack = sorted(set(categories)), 1e-12
    if not cats:
        raise ValueError("no categories")
    if len(matrix) != len(cats) or any(len(row) != len(cats) for row in matrix):
        raise ValueError(f"weights must be {len(cats)} x {len(cats)}")
    for i, row in enumerate(matrix):
        if abs(row[i] - 1) > slack:
            raise ValueError("a weight on the diagonal is not 1")
        for j, w in enumerate(row):
            if not -slack <= w <= 1 + slack:
                raise ValueError("a weight lies outside 0 and 1")
            if abs(w - matrix[j][i]) > slack:
                raise ValueError("the weights are not symmetric")
    return spark.createDataFrame([(a, b, float(matrix[i][j])) for i, a in enumerate(cats) for j, b in enumerate(cats)], "ca int, cb int, w double")


def coefficient_name(labels: DataFrame, weights: DataFrame | None) -> str:
    """Gwet AC1 without weights, AC2 with those of a named scheme over the labels, else AC3."""
    if weights is None:
        return "Gwet AC1"
    for scheme in ("identity", "linear", "quadratic", "ordinal"):
        other = weight_table(labels.where("label IS NOT NULL"), scheme).withColumnRenamed("w", "v")
        if not weights.join(other, ["ca", "cb"], "full").where("v IS NULL OR w IS NULL OR abs(v - w) > 1e-10").limit(1).count():
            return f"Gwet AC2({scheme})"
    return "Gwet AC3"


def gwet(ratings: DataFrame, scheme: str = "identity", keys=(), weights: DataFrame | None = None) -> DataFrame:
    """Gwet's AC1 (identity weights), AC2 (another scheme) or AC3 (``weights`` of one's own; a label without weights is an error)."""
    n = counts(ratings, keys)
    n = n.withColumn("m", F.sum("c").over(Window.partitionBy(*keys, "item")))
    if weights is not None:  # only the labels at hand count
        labels = ratings.where("label IS NOT NULL").select("label").distinct()
        seen = labels.join(weights.select(F.col("ca").alias("label"), F.lit(1).alias("known")).distinct(), "label", "left")
        known = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("no weights for label "), F.col("label").cast("string"))).cast("int")).otherwise(F.col("label"))
        labels = seen.select(known.alias("label"))
        weights = weights.join(labels.select(F.col("label").alias("ca")), "ca").join(labels.select(F.col("label").alias("cb")), "cb")
    if scheme == "identity" and weights is None:
        weights = weight_table(ratings.where("label IS NOT NULL"), scheme)
        inner = n.where("m >= 2").groupBy(*keys, "item").agg((F.sum(F.col("c") * F.col("c")) - F.max("m")).alias("agree"), F.max("m").alias("m"))
    else:
        weights = weight_table(ratings.where("label IS NOT NULL"), scheme) if weights is None else weights
        x, y = n.where("m >= 2").select(*keys, "item", F.col("label").alias("ca"), F.col("c").alias("x"), "m"), n.select(*keys, "item", F.col("label").alias("cb"), F.col("c").alias("y"))
        met = x.join(y, [*keys, "item"]).join(weights, ["ca", "cb"])
        own = F.when(F.col("ca") == F.col("cb"), F.col("x")).otherwise(0)
        inner = met.groupBy(*keys, "item").agg(F.sum((F.col("x") * F.col("y") - own) * F.col("w")).alias("agree"), F.max("m").alias("m"))
    pa = inner.groupBy(*keys).agg(F.avg(F.col("agree") / (F.col("m") * (F.col("m") - 1))).alias("pa"))
    items = n.groupBy(*keys).agg(F.count_distinct("item").alias("items"))
    share = _with(n.groupBy(*keys, "label").agg(F.sum(F.col("c") / F.col("m")).alias("s")), items, keys).withColumn("pi", F.col("s") / F.col("items"))
    chance = share.groupBy(*keys).agg(F.sum(F.col("pi") * (1 - F.col("pi"))).alias("v"), F.count(F.lit(1)).alias("q"))
    total = weights.agg(F.sum("w").alias("tw"))
    both = _with(pa, chance, keys).crossJoin(total)
    pe = F.when(F.col("q") >= 2, F.col("tw") * F.col("v") / (F.col("q") * (F.col("q") - 1)))
    value = F.when(F.abs(1 - pe) >= TINY, (F.col("pa") - pe) / (1 - pe))
    status = F.when(F.col("pa").isNull(), "no_data").when(pe.isNull(), "one_category").when(value.isNull(), "degenerate").otherwise("ok")
    return both.select(*keys, value.alias("value"), status.alias("status"))


def bland_altman(pairs: DataFrame, keys=(), z: float = 1.96) -> DataFrame:
    """Mean difference of x and y, its standard deviation and limits of agreement."""
    d = pairs.select(*keys, (F.col("x") - F.col("y")).alias("d"))
    s = d.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    ok = (F.col("n") >= 2) & (F.col("sd") * F.col("sd") >= TINY)
    return s.select(*keys, "n", "mean_diff", "sd", F.when(ok, F.col("mean_diff") - z * F.col("sd")).alias("lower"), F.when(ok, F.col("mean_diff") + z * F.col("sd")).alias("upper"))


def resample_items(items: DataFrame, reps: int, seed: int, columns: list[str]) -> DataFrame:
    """Draws with replacement: reps copies of the table, each with as many items; key column ``rep``, items renumbered."""
    spark = items.sparkSession
    n = items.select("item").distinct().count()
    order = Window.orderBy("item")  # one row an item
    numbered = items.select("item").distinct().withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))
    draws = spark.range(reps).select(F.col("id").alias("rep")).crossJoin(spark.range(n).select(F.col("id").alias("pos")))
    draws = draws.select("rep", "pos", rng.pick(n, seed, F.col("rep"), F.col("pos")).alias("idx"))
    return draws.join(numbered, "idx").join(items, "item").select("rep", F.col("pos").alias("item"), *columns)


def percentile_interval(values: DataFrame, reps: int, alpha: float = 0.05, keys=()) -> DataFrame:
    """The order statistics ceil(alpha/2 B) and ceil((1-alpha/2) B) of the finite values; null if under half are finite."""
    fine = values.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    ranked = fine.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("value"))).withColumn("b", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    at = lambda p: F.max(F.when(F.col("k") == F.greatest(F.lit(1), F.ceil(p * F.col("b"))), F.col("value")))
    s = ranked.groupBy(*keys).agg(at(alpha / 2).alias("lower"), at(1 - alpha / 2).alias("upper"), F.max("b").alias("valid"))
    ok = F.col("valid") * 2 >= reps
    return s.select(*keys, F.when(ok, F.col("lower")).alias("lower"), F.when(ok, F.col("upper")).alias("upper"), "valid")


def bootstrap(items: DataFrame, statistic: Callable[[DataFrame, list[str]], DataFrame], reps: int, seed: int, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """A percentile interval of any statistic of this module: it is computed once, with the extra key ``rep``."""
    return percentile_interval(statistic(resample_items(items, reps, seed, columns), ["rep"]), reps, alpha)


def dawid_skene(ratings: DataFrame, classes: list[int], rounds: int = 100, tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Latent classes by EM. Returns (item, p: array of class probabilities, label) and (class, prior).

    Repeated ratings of an item by a rater all count. Ties of the argmax go to the last class. Counts by
    (item, rater, label) are made once; parameters are small tables that are joined in. EM ends when a round
    changes the log likelihood by less than tol, or after ``rounds``. The lineage is cut in the checkpoint
    folder every round.
    """
    k = len(classes)
    scratch(ratings.sparkSession, "classes")  # sets a checkpoint folder where there is none
    n = ratings.groupBy("item", "rater", "label").agg(F.count(F.lit(1)).cast("double").alias("c")).persist()
    share = n.groupBy("item").agg(*[(F.sum(F.when(F.col("label") == c, F.col("c")).otherwise(0.0)) / F.sum("c")).alias(f"p{j}") for j, c in enumerate(classes)])
    post, last = share, None
    names = [f"p{j}" for j in range(k)]
    for _ in range(rounds):
        prior = post.agg(*[F.avg(p).alias(p) for p in names]).first()
        cell = n.join(post, "item").groupBy("rater", "label").agg(*[F.sum(F.col(p) * F.col("c")).alias(p) for p in names])
        whole = Window.partitionBy("rater")
        logs = [F.log(F.greatest(F.when(F.sum(p).over(whole) <= TINY, F.lit(1.0 / k)).otherwise(F.col(p) / F.sum(p).over(whole)), F.lit(1e-300))).alias(f"l{j}") for j, p in enumerate(names)]
        cell = cell.select("rater", "label", *logs)
        score = n.join(cell, ["rater", "label"]).groupBy("item").agg(*[(F.sum(F.col("c") * F.col(f"l{j}")) + F.log(F.lit(max(prior[p], 1e-300)))).alias(f"s{j}") for j, p in enumerate(names)])
        top = F.greatest(*[F.col(f"s{j}") for j in range(k)]) if k > 1 else F.col("s0")
        score = score.withColumn("top", top)
        total = sum((F.exp(F.col(f"s{j}") - F.col("top")) for j in range(k)), F.lit(0.0))
        post = score.select("item", *[(F.exp(F.col(f"s{j}") - F.col("top")) / total).alias(f"p{j}") for j in range(k)], (F.col("top") + F.log(total)).alias("ll"))
        post = post.checkpoint()
        ll = post.agg(F.sum("ll")).first()[0]
        if ll is None or (last is not None and abs(ll - last) < tol):
            break
        last = ll
    best = F.array_max(F.array(*[F.struct(F.col(f"p{j}").alias("v"), F.lit(j).alias("j"), F.lit(c).alias("label")) for j, c in enumerate(classes)]))
    out = post.select("item", F.array(*names).alias("p"), best["label"].alias("label"))
    priors = post.agg(*[F.avg(p).alias(p) for p in names]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(p).alias("prior")) for c, p in zip(classes, names)])).alias("r")).select("r.*")
    return out, priors


def family_stratification(ratings: DataFrame, families: DataFrame, level: str = "nominal") -> DataFrame:
    """Alpha overall, within families and across pairs of raters of two families; one plan keyed by subset."""
    known = ratings.join(families, "rater", "left")
    known = known.where(F.when(F.col("family").isNull(), F.raise_error(F.lit("a rater has no family"))).otherwise(F.lit(True)))
    f = families.select("rater", "family").distinct()
    a, b = f.select(F.col("rater").alias("ra"), F.col("family").alias("fa")), f.select(F.col("rater").alias("rb"), F.col("family").alias("fb"))
    pairs = a.crossJoin(b).where("fa < fb")
    of_pair = pairs.select(F.concat(F.lit("pair:"), F.col("ra").cast("string"), F.lit("|"), F.col("rb").cast("string")).alias("subset"), F.explode(F.array("ra", "rb")).alias("rater"))
    multi = f.groupBy("family").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("family")
    of_family = f.join(multi, "family").select(F.concat(F.lit("family:"), F.col("family").cast("string")).alias("subset"), "rater")
    subsets = of_pair.unionByName(of_family).unionByName(f.select(F.lit("overall").alias("subset"), "rater"))
    alphas = krippendorff_alpha(known.select("item", "rater", "label").join(subsets, "rater"), level, ["subset"]).where("value IS NOT NULL")
    kind = F.substring_index("subset", ":", 1)
    s = alphas.agg(
        F.avg(F.when(kind == "overall", F.col("value"))).alias("overall"),
        F.avg(F.when(kind == "family", F.col("value"))).alias("within"),
        F.avg(F.when(kind == "pair", F.col("value"))).alias("between"),
    )
    return s.withColumn("bias_burden", F.col("within") - F.col("between"))


def preference_leakage(wins: DataFrame, families: DataFrame) -> DataFrame:
    """(model_i, model_j, regime, pls) for i < j from win rates (model_i, model_j, wr); a rate outside 0 and 1 is an error."""
    fine = F.coalesce(F.col("wr").between(0, 1), F.lit(False)) & ~F.isnan("wr")
    wins = wins.withColumn("wr", F.when(fine, F.col("wr")).otherwise(F.raise_error("a win rate lies outside 0 and 1").cast("double")))
    diag = wins.where("model_i = model_j").select(F.col("model_i").alias("m"), F.col("wr").alias("own"))
    w = wins.where("model_i < model_j").select("model_i", "model_j", F.col("wr").alias("wij"))
    back = wins.where("model_i > model_j").select(F.col("model_i").alias("model_j"), F.col("model_j").alias("model_i"), F.col("wr").alias("wji"))
    all_ = w.join(back, ["model_i", "model_j"]).join(diag.select(F.col("m").alias("model_i"), F.col("own").alias("wii")), "model_i").join(diag.select(F.col("m").alias("model_j"), F.col("own").alias("wjj")), "model_j")
    ai, aj = (F.col("wii") + F.col("wij")) / 2, (F.col("wjj") + F.col("wji")) / 2
    pls = (mathx.ratio(F.col("wii") - ai, ai) + mathx.ratio(F.col("wjj") - aj, aj)) / 2
    fi, fj = families.select(F.col("model").alias("model_i"), F.col("family").alias("fi")), families.select(F.col("model").alias("model_j"), F.col("family").alias("fj"))
    return all_.join(fi, "model_i").join(fj, "model_j").select("model_i", "model_j", F.when(F.col("fi") == F.col("fj"), "same_family").otherwise("cross_family").alias("regime"), pls.alias("pls"))


def leakage_means(pairs: DataFrame) -> DataFrame:
    """(regime, mean_pls, n_pairs) of ``preference_leakage`` by regime and for all; without pairs one row, 0 of 0."""
    g = pairs.groupBy("regime").agg(F.sum("pls").alias("s"), F.count("pls").alias("n_pairs"))
    whole = g.agg(F.lit("all").alias("regime"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n_pairs"), F.lit(0).cast("long")).alias("n_pairs"))
    return g.unionByName(whole).select("regime", F.coalesce(F.try_divide("s", "n_pairs"), F.lit(0.0)).alias("mean_pls"), "n_pairs")


def mandel(labs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mandel's h and k of each laboratory (lab, x), with critical values."""
    per = labs.groupBy("lab").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    all_ = per.agg(F.count(F.lit(1)).alias("p"), F.avg("mean").alias("grand"), F.stddev_samp("mean").alias("between"), F.avg("var").alias("within"), F.min("n").alias("least"), F.max("n").alias("most"))
    p = F.col("p").cast("double")
    # step by step: the quantiles are long expressions
    all_ = all_.withColumn("t", -mathx.t_quantile(alpha / 2 / p, p - 2)).withColumn("f", mathx.f_quantile(1 - alpha / p, F.col("least") - 1, (p - 1) * (F.col("least") - 1)))
    both = per.crossJoin(all_)  # one row on the right
    t, f = F.col("t"), F.col("f")
    h_crit = (p - 1) * t / F.sqrt(p * (p - 2 + t * t))
    k_crit = F.sqrt(p * f / (p - 1 + f))
    h, k = mathx.ratio(F.col("mean") - F.col("grand"), F.col("between")), F.sqrt(mathx.ratio(F.col("var"), F.col("within")))
    ok = (F.col("p") >= 5) & (F.col("least") == F.col("most")) & (F.col("least") >= 2)
    return both.select(
        "lab", F.when(ok, h).alias("h"), F.when(ok, k).alias("k"), F.when(ok, h_crit).alias("h_crit"), F.when(ok, k_crit).alias("k_crit"),
        F.when(ok, F.abs(h) > h_crit).alias("h_flag"), F.when(ok, k > k_crit).alias("k_flag"), F.when(ok, "ok").otherwise("unbalanced").alias("status"),
    )


def distinct_categories(sigma_parts, sigma_grr):
    """Number of distinct categories, an integer; at least 5 is adequate."""
    return F.floor(1.41 * mathx.ratio(sigma_parts, sigma_grr)).cast("bigint")


def precision_to_tolerance(sigma_grr, tolerance):
    """6 sigma over the tolerance; under 0.30 is adequate."""
    return mathx.ratio(6 * sigma_grr, tolerance)
