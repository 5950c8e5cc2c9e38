"""What the agreement of two models says about their correctness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Confidence bins and the gap labels.
CONFIDENCE_BINS = [(0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.01)]
STRONG_GAP, MODERATE_GAP = 0.15, 0.05
MIN_BIN_ROWS, MIN_SIDE_ROWS = 10, 5


def _i(c: Column) -> Column:
    return c.cast("int")


def contingency(df: DataFrame) -> DataFrame:
    """One row: agreement rate, accuracies by side, joint correctness, oracle accuracy."""
    a, b = F.col("preda") == F.col("label"), F.col("predb") == F.col("label")
    g = F.col("agree")
    r = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(g).alias("n_agree"),
        F.avg(_i(g)).alias("agree_rate"),
        F.avg(_i(a)).alias("acc_a"),
        F.avg(_i(b)).alias("acc_b"),
        F.avg(F.when(g, _i(a))).alias("acc_a_agree"),
        F.avg(F.when(~g, _i(a))).alias("acc_a_disagree"),
        F.avg(F.when(~g, _i(b))).alias("acc_b_disagree"),
        F.avg(F.when(~g, _i(a | b))).alias("either_disagree"),
        F.count_if(a & b).alias("both_right"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"),
        F.count_if(~a & ~b).alias("both_wrong"),
        F.avg(_i(a | b)).alias("oracle_accuracy"),
    )
    return r.withColumn("complementarity", F.try_divide("only_b", F.col("only_b") + F.col("both_wrong")))


def confidence_bin(conf: Column) -> Column:
    """Index of the bin, null outside all bins."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(CONFIDENCE_BINS))):
        out = F.when((conf >= lo) & (conf < hi), F.lit(i)).otherwise(out)
    return out


def gap_by_bin(df: DataFrame, conf: Column) -> DataFrame:
    """Accuracy of model a with and without agreement, inside bins of ``conf``."""
    g, right = F.col("agree"), _i(F.col("preda") == F.col("label"))
    r = df.groupBy(confidence_bin(conf).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(right).alias("acc"),
        F.avg(_i(g)).alias("agree_rate"),
        F.when(F.count_if(g) > MIN_SIDE_ROWS, F.avg(F.when(g, right))).alias("acc_agree"),
        F.when(F.count_if(~g) > MIN_SIDE_ROWS, F.avg(F.when(~g, right))).alias("acc_disagree"),
    )
    r = r.where(F.col("bin").isNotNull() & (F.col("n") >= MIN_BIN_ROWS))
    gap = F.col("acc_agree") - F.col("acc_disagree")
    signal = F.when(F.abs(gap) >= STRONG_GAP, "STRONG").when(F.abs(gap) >= MODERATE_GAP, "moderate").when(gap.isNotNull(), "weak")
    return r.withColumns({"gap": gap, "signal": signal})


def by_class(df: DataFrame, top: int = 15, min_rows: int = 10) -> DataFrame:
    """Agreement and accuracy per true class, the ``top`` largest classes."""
    r = df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_i(F.col("agree"))).alias("agree_rate"),
        F.avg(_i(F.col("preda") == F.col("label"))).alias("acc_a"),
        F.avg(_i(F.col("predb") == F.col("label"))).alias("acc_b"),
    )
    return r.where(F.col("n") >= min_rows).orderBy(F.desc("n"), "label").limit(top)


def viability(cal: DataFrame, test: DataFrame, conf: Column, min_side: int = 20) -> DataFrame:
    """Whether agreement carries enough signal for separate thresholds (one row)."""
    mid = gap_by_bin(test, conf).where("bin in (1, 2)").agg(F.coalesce(F.avg(F.abs("gap")), F.lit(0.0)).alias("avg_gap"))
    rate = test.agg(F.avg(_i(F.col("agree"))).alias("agree_rate"))
    sides = cal.agg(F.count_if("agree").alias("cal_agree"), F.count_if(~F.col("agree")).alias("cal_disagree"))
    one = F.lit(1)
    r = mid.withColumn("_k", one).join(rate.withColumn("_k", one), "_k").join(sides.withColumn("_k", one), "_k").drop("_k")
    return r.withColumns(
        {
            "viable": (F.col("avg_gap") >= 0.05) & (F.col("agree_rate") > 0.15),
            "enough_rows": (F.col("cal_agree") >= min_side) & (F.col("cal_disagree") >= min_side),
        }
    )
