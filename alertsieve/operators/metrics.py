"""Classification metrics from conditional counts; nothing here sorts the rows themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.operators.gating import running_confusion
from alertsieve.operators.ordering import ordered, with_scalars


def _i(c: Column) -> Column:
    return c.cast("int")


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion_metrics(c: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of rows ``keys, tp, fp, fn, tn``; 0/0 counts as 0."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    p, r = _z(F.try_divide(tp, tp + fp)), _z(F.try_divide(tp, tp + fn))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        *keys,
        *[F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")],
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        p.alias("precision"),
        r.alias("recall"),
        _z(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)).alias("f1"),
        _z(F.try_divide(F.lit(5.0) * tp, F.lit(5.0) * tp + F.lit(4.0) * fn + fp)).alias("f2"),
        _z(F.try_divide(fp, fp + tn)).alias("fpr"),
        _z(F.try_divide(tp * tn - fp * fn, den)).alias("mcc"),
    )


def confusion_counts(df: DataFrame, y: Column, pred: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if((pred == 1) & (y == 1)).alias("tp"),
        F.count_if((pred == 1) & (y == 0)).alias("fp"),
        F.count_if((pred == 0) & (y == 1)).alias("fn"),
        F.count_if((pred == 0) & (y == 0)).alias("tn"),
    )


def binary_metrics(df: DataFrame, y: Column, pred: Column, keys: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    c = confusion_counts(df, y, pred, keys)
    if min_rows:
        c = c.where(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= min_rows)
    return confusion_metrics(c, keys)


def ranking_metrics(df: DataFrame, y: Column, p: Column, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision, null for a single class."""
    r = running_confusion(df, y, p, keys)
    pos, neg, tp, fp = F.col("pos"), F.col("neg"), F.col("tp"), F.col("fp")
    out = r.groupBy(*keys).agg(
        F.sum(neg * (tp - pos + pos / F.lit(2.0))).alias("_u"),
        F.sum(pos * tp / (tp + fp)).alias("_ap"),
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
    )
    return out.select(
        *keys,
        F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("roc_auc"),
        F.when(F.col("_n") > 0, F.try_divide("_ap", "_p")).alias("pr_auc"),
    )


def curve_points(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """ROC and PR points at every distinct score."""
    r = running_confusion(df, y, p)
    tot = r.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    r = with_scalars(r, tot)
    return r.select(
        "score",
        F.try_divide("fp", "_n").alias("fpr"),
        F.try_divide("tp", "_p").alias("tpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction."""
    m = confusion_matrix(df, y, pred)
    # each confusion cell feeds its label's row and its prediction's row
    sides = m.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("h")),
                F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")),
            )
        )
    )
    c = sides.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    h = F.col("hits").cast("double")
    return c.withColumns(
        {
            "precision": _z(F.try_divide(h, F.col("predicted"))),
            "recall": _z(F.try_divide(h, F.col("support"))),
            "f1": _z(F.try_divide(F.lit(2.0) * h, F.col("support") + F.col("predicted"))),
        }
    )


def multiclass_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Accuracy, macro and weighted P/R/F1, balanced accuracy (one row)."""
    c = per_class(df, y, pred)
    s = F.col("support")
    aggs = [F.try_divide(F.sum("hits"), F.sum(s)).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs.append(F.avg(m).alias(f"{m}_macro"))
        aggs.append(F.try_divide(F.sum(F.col(m) * s), F.sum(s)).alias(f"{m}_weighted"))
    aggs.append(F.avg(F.when(s > 0, F.col("recall"))).alias("balanced_accuracy"))
    return c.agg(*aggs)


def auc_ovr(df: DataFrame, y: str, probs: str, classes: int) -> DataFrame:
    """One-vs-rest ROC-AUC per class; the vector is unpivoted to one row per class."""
    long = df.select(y, F.posexplode(probs).alias("class", "p"))
    return ranking_metrics(long, (F.col(y) == F.col("class")).cast("int"), F.col("p"), ["class"])


def reliability(df: DataFrame, y: Column, p: Column, bins: int = 10) -> DataFrame:
    """Mean prediction and positive rate in equal-width bins."""
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(_i(y == 1)).alias("positive_rate"), F.count(F.lit(1)).alias("n"))


def stage_metrics(df: DataFrame, y: str, pred: str, confident: Column) -> DataFrame:
    """Coverage of a stage and the quality of its confident rows (one row)."""
    n = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(confident).alias("n_confident"))
    m = multiclass_metrics(df.where(confident), y, pred).select("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")
    out = with_scalars(n, m)
    return out.withColumns({"n_deferred": F.col("n_total") - F.col("n_confident"), "coverage": F.try_divide("n_confident", "n_total")})


def automation(df: DataFrame, y: str, pred: str, automated: str) -> DataFrame:
    """Automated share, accuracy on automated rows and the workload reduction."""
    a = F.col(automated)
    r = df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(a).alias("n_automated"),
        F.avg(F.when(a, _i(F.col(y) == F.col(pred)))).alias("accuracy_auto"),
    )
    return r.withColumns(
        {"n_deferred": F.col("n_total") - F.col("n_automated"), "reduction_pct": F.try_divide(F.col("n_automated") * 100.0, F.col("n_total"))}
    )


def majority_lift(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Accuracy against always predicting the most frequent class (lowest class on ties)."""
    per = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(pred)).alias("hit"))
    r = per.agg(
        F.max_by(y, F.struct("n", -F.col(y))).alias("majority_class"),
        (F.max("n") / F.sum("n")).alias("majority_accuracy"),
        (F.sum("hit") / F.sum("n")).alias("accuracy"),
    )
    return r.withColumn("lift", F.col("accuracy") - F.col("majority_accuracy"))


# --- ranked rows: risk-coverage -----------------------------------------------------------


def risk_coverage(df: DataFrame, err: Column, conf: Column, key: str = "id") -> DataFrame:
    """Rows by confidence (descending, then ``key``) with position and running errors."""
    rows = df.select(F.col(key).alias("_id"), conf.alias("_conf"), _i(err).cast("long").alias("err"))
    o = ordered(rows, [], [F.desc("_conf"), "_id"])
    return o.with_running({"pos": ("count", F.lit(1)), "errors": ("sum", F.col("err"))}).result()


def augrc(df: DataFrame, err: Column, conf: Column, key: str = "id") -> DataFrame:
    """Area under the generalised risk-coverage curve (trapezoids), one row."""
    r = risk_coverage(df, err, conf, key)
    a = r.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("errors").alias("_area"),
        F.min_by("errors", "pos").alias("_first"),
        F.sum("err").alias("n_errors"),
    )
    n = F.col("n").cast("double")
    return a.select("n", "n_errors", ((F.col("_area") - (F.col("_first") + F.col("n_errors")) / 2.0) / (n * n)).alias("augrc"))


def accuracy_at_coverage(df: DataFrame, err: Column, conf: Column, targets: Sequence[float] = (0.70, 0.80, 0.90, 0.95), key: str = "id") -> DataFrame:
    """Accuracy of the int(n*c) most confident rows."""
    r = risk_coverage(df, err, conf, key)
    n = r.count()
    keep = {float(c): int(n * c) for c in targets}
    at = r.where(F.col("pos").isin(list(keep.values()))).select("pos", "errors")
    t = df.sparkSession.createDataFrame([(c, k) for c, k in keep.items()], "coverage double, pos long")
    return at.join(F.broadcast(t), "pos").select("coverage", F.col("pos").alias("n_kept"), (F.lit(1.0) - F.col("errors") / F.col("pos")).alias("accuracy"))


# --- tiers -----------------------------------------------------------------------------

# Tier bounds on the positive probability, from high to low.
TIERS = [("CRITICAL", 0.50), ("HIGH", 0.35), ("ELEVATED", 0.20), ("LOW", 0.10), ("MINIMAL", None)]


def tier(p: Column) -> Column:
    c = None
    for name, t in TIERS[:-1]:
        c = F.when(p >= t, name) if c is None else c.when(p >= t, name)
    return c.otherwise(TIERS[-1][0])


def tier_rank(t: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n, _ in TIERS]), t).cast("int") - 1


def tier_table(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """Counts, defect rate, lift and cumulative recall in tier order."""
    t = df.groupBy(tier(p).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(_i(y == 1)).alias("n_pos"))
    # five rows at most: cumulative values by comparing tier ranks inside one small array
    one = t.agg(
        F.collect_list(F.struct("tier", tier_rank(F.col("tier")).alias("r"), "n", "n_pos")).alias("_all"),
        F.sum("n").alias("_n"),
        F.sum("n_pos").alias("_p"),
    )
    t = one.select("_all", "_n", "_p", F.inline("_all"))

    def upto(f: str) -> Column:
        return F.aggregate(F.filter("_all", lambda x: x["r"] <= F.col("r")), F.lit(0).cast("long"), lambda a, x: a + x[f])

    rate = F.col("n_pos") / F.col("n")
    return t.select(
        "tier",
        "n",
        (F.col("n") / F.col("_n")).alias("share"),
        "n_pos",
        rate.alias("rate"),
        F.try_divide(rate, F.col("_p") / F.col("_n")).alias("lift"),
        upto("n").alias("cum_n"),
        upto("n_pos").alias("cum_pos"),
        F.try_divide(upto("n_pos"), F.col("_p")).alias("cum_recall"),
    )


def tier_change_quality(df: DataFrame, y: Column, before: Column, after: Column) -> DataFrame:
    """Whether moving a row to another tier helped."""
    b, a = tier_rank(before), tier_rank(after)
    # The texts of the verdicts.
    q = (
        F.when(a == b, "unchanged")
        .when((y == 1) & (a < b), "GOOD (defective moved up)")
        .when((y == 0) & (a > b), "GOOD (clean moved down)")
        .when((y == 1) & (a > b), "BAD (defective moved down)")
        .when((y == 0) & (a < b), "BAD (clean moved up)")
        .otherwise("NEUTRAL")
    )
    return df.groupBy(q.alias("quality")).agg(F.count(F.lit(1)).alias("n"))
