"""Split conformal prediction: calibration per group, sets, and their evaluation.

The calibration table has one row per group and one threshold column per alpha, so a grid of
alphas costs one pass over the calibration rows and one over the test rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.functions.probs import label_threshold_set, predicted, raps_score, set_size, true_rank
from alertsieve.functions.random import keyed_uniform
from alertsieve.operators.lookup import lookup_join
from alertsieve.operators.ordering import Quantile, quantiles, with_scalars

LAM, K_REG = 0.01, 5


def conformal_level(alpha: float) -> Quantile:
    """The finite-sample quantile: level min(ceil((n+1)(1-alpha))/n, 1), next higher value."""
    return Quantile(1 - alpha, "higher", lambda n: F.least(F.ceil((n + 1) * F.lit(1 - alpha)) / n, F.lit(1.0)))


def label_level(alpha: float) -> Quantile:
    """The linear quantile at min(1, (1-alpha)(1+1/n))."""
    return Quantile(1 - alpha, "linear", lambda n: F.least(F.lit(1.0), F.lit(1 - alpha) * (F.lit(1.0) + F.lit(1.0) / n)))


def raps_scored(df: DataFrame, probs: Column, lam: float = LAM, k_reg: int = K_REG, salt: str = "raps") -> DataFrame:
    return df.withColumn("score", raps_score(probs, F.col("label"), keyed_uniform(F.col("id"), salt), lam, k_reg))


def calibrate(cal: DataFrame, groups: Sequence[str], alphas: Sequence[float], level=conformal_level) -> DataFrame:
    """One row per group: ``groups, n, q0, q1, ...`` (one threshold per alpha)."""
    return quantiles(cal, groups, "score", {f"q{i}": level(a) for i, a in enumerate(alphas)})


def attach_thresholds(test: DataFrame, groups: Sequence[str], q: DataFrame, n_alpha: int) -> DataFrame:
    """Thresholds joined to the test rows; a group without calibration rows gets 1.0."""
    names = [f"q{i}" for i in range(n_alpha)]
    if not groups:
        return with_scalars(test, q.select(*names))
    out = lookup_join(test, q.select(*groups, *names), list(groups), "left")
    return out.withColumns({n: F.coalesce(n, F.lit(1.0)) for n in names})


def with_sets(test: DataFrame, probs: Column, n_alpha: int, lam: float = LAM, k_reg: int = K_REG) -> DataFrame:
    """Set sizes ``s0, s1, ...``, rank of the label and the point prediction."""
    df = test.withColumns({"_rank": true_rank(probs, F.col("label")), "_pred": predicted(probs)})
    return df.withColumns({f"s{i}": set_size(probs, F.col(f"q{i}"), lam, k_reg) for i in range(n_alpha)})


def set_metrics(df: DataFrame, alphas: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Coverage, set sizes and singleton quality per alpha (and per ``by``)."""
    cols = []
    for i, a in enumerate(alphas):
        s = F.col(f"s{i}")
        cols.append(
            F.struct(
                F.lit(float(a)).alias("alpha"),
                F.avg((F.col("_rank") <= s).cast("int")).alias("coverage"),
                F.avg(s).alias("mean_set_size"),
                F.median(s).alias("median_set_size"),  # at most one distinct value per class
                F.stddev_pop(s).alias("std_set_size"),
                F.avg((s == 1).cast("int")).alias("singleton_rate"),
                F.coalesce(F.avg(F.when(s == 1, (F.col("_pred") == F.col("label")).cast("int"))), F.lit(0.0)).alias("singleton_accuracy"),
                F.count(F.lit(1)).alias("n"),
            ).alias(f"m{i}")
        )
    out = df.groupBy(*by).agg(*cols)
    return out.select(*by, F.inline(F.array(*[F.col(f"m{i}") for i in range(len(alphas))])))


def conformal_run(df: DataFrame, probs: Column, groups: Sequence[str], alphas: Sequence[float], lam: float = LAM, k_reg: int = K_REG) -> DataFrame:
    """Calibrate on split 'cal', build sets on split 'test'; returns the test rows."""
    cal = raps_scored(df.where("split = 'cal'"), probs, lam, k_reg)
    q = calibrate(cal, groups, alphas)
    test = attach_thresholds(df.where("split = 'test'"), groups, q, len(alphas))
    return with_sets(test, probs, len(alphas), lam, k_reg)


def agreement_report(sets: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Metrics for all rows and for the agree/disagree parts in one pass (rollup)."""
    df = sets.withColumn("part", F.when(F.col("agree"), "agree").otherwise("disagree"))
    cols = []
    for i, a in enumerate(alphas):
        s = F.col(f"s{i}")
        cols.append(
            F.struct(
                F.lit(float(a)).alias("alpha"),
                F.avg((F.col("_rank") <= s).cast("int")).alias("coverage"),
                F.avg(s).alias("mean_set_size"),
                F.median(s).alias("median_set_size"),
                F.avg((s == 1).cast("int")).alias("singleton_rate"),
                F.coalesce(F.avg(F.when(s == 1, (F.col("_pred") == F.col("label")).cast("int"))), F.lit(0.0)).alias("singleton_accuracy"),
                F.count(F.lit(1)).alias("n"),
            ).alias(f"m{i}")
        )
    out = df.rollup("part").agg(*cols)
    return out.select(F.coalesce("part", F.lit("overall")).alias("part"), F.inline(F.array(*[F.col(f"m{i}") for i in range(len(alphas))])))


def hybrid_probs(x: str, y: str) -> Column:
    """Vector of model x where the models agree, of model y where they do not."""
    return F.when(F.col("agree"), F.col(x)).otherwise(F.col(y))


def label_threshold_metrics(df: DataFrame, probs: str, alphas: Sequence[float]) -> DataFrame:
    """Sets by probability threshold: coverage, size, share of single and empty sets."""
    cal = df.where("split = 'cal'").withColumn("score", F.lit(1.0) - F.get(F.col(probs), F.col("label")))
    q = calibrate(cal, [], alphas, label_level)
    test = attach_thresholds(df.where("split = 'test'"), [], q, len(alphas))
    cols = []
    for i, a in enumerate(alphas):
        s = label_threshold_set(F.col(probs), F.col(f"q{i}"))
        cols.append(
            F.struct(
                F.lit(float(a)).alias("alpha"),
                F.avg(F.array_contains(s, F.col("label")).cast("int")).alias("coverage"),
                F.avg(F.size(s)).alias("mean_set_size"),
                F.avg((F.size(s) == 1).cast("int")).alias("single_share"),
                F.avg((F.size(s) == 2).cast("int")).alias("both_share"),
                F.avg((F.size(s) == 0).cast("int")).alias("empty_share"),
                (F.lit(1.0) - F.max(f"q{i}")).alias("threshold"),
            ).alias(f"m{i}")
        )
    return test.agg(*cols).select(F.inline(F.array(*[F.col(f"m{i}") for i in range(len(alphas))])))


def class_coverage(sets: DataFrame, size: str = "s0") -> DataFrame:
    """Coverage, mean set size and count per true class."""
    return sets.groupBy("label").agg(
        F.avg((F.col("_rank") <= F.col(size)).cast("int")).alias("coverage"),
        F.avg(size).alias("mean_set_size"),
        F.count(F.lit(1)).alias("n"),
    )


def size_histogram(sets: DataFrame, size: str = "s0", top: int = 15) -> DataFrame:
    """Rows per set size; sizes above ``top`` share one bucket."""
    n = sets.groupBy(F.least(F.col(size), F.lit(top + 1)).alias("size")).count()
    total = n.agg(F.sum("count").alias("_t"))
    return with_scalars(n, total).select("size", F.col("count").alias("n"), (F.col("count") / F.col("_t")).alias("share"))
