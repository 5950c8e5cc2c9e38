"""Confidence gates, threshold searches and cascades over scored rows.

A scored row has a class ``pred``, a confidence ``conf`` and, for searches, the true class.
Searches read their rows once through ``grid_sums``; the search itself runs on one row per
threshold (and class).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.operators.grid import grid_sums, steps
from alertsieve.operators.lookup import lookup_join
from alertsieve.operators.ordering import Quantile, ordered, quantiles, with_scalars

DEFER = -1


def _i(c: Column) -> Column:
    return c.cast("int")


def _n(c: Column) -> Column:
    return c.cast("long")


# --- gates -----------------------------------------------------------------------------


def gate(df: DataFrame, threshold: float | Column, pred: str = "pred", conf: str = "conf") -> DataFrame:
    """Keep the class of rows at or above the threshold, else -1. Works on streams."""
    ok = F.col(conf) >= (F.lit(threshold) if isinstance(threshold, float) else threshold)
    return df.withColumns({"is_confident": ok, "gated": F.when(ok, F.col(pred)).otherwise(F.lit(DEFER))})


def gate_per_class(df: DataFrame, thresholds: DataFrame, pred: str = "pred", conf: str = "conf", default: float = 0.50) -> DataFrame:
    """Gate with one threshold per predicted class: ``thresholds(pred, threshold)``."""
    t = thresholds.select(F.col("pred").alias(pred), F.col("threshold").alias("_t"))
    out = lookup_join(df, t, [pred], "left")
    return gate(out, F.coalesce("_t", F.lit(default)), pred, conf).drop("_t")


def override_classes(p: Column, pred: Column, thresholds: dict[int, float]) -> Column:
    """Replace the class, in the given order, when a class reaches its own threshold."""
    out = pred
    for cls, t in thresholds.items():
        out = F.when(F.get(p, F.lit(cls)) >= t, F.lit(cls)).otherwise(out)
    return out


# --- curves and searches ---------------------------------------------------------------


def coverage_curve(df: DataFrame, right: Column, conf: Column, thresholds: Sequence[float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows kept and their accuracy at each threshold."""
    g = grid_sums(df, keys, conf, thresholds or steps(0.50, 1.00, 0.01), {"n_predicted": F.lit(1), "n_correct": _i(right)})
    return g.select(
        *keys,
        "threshold",
        (F.col("n_predicted") / F.col("total_n_predicted")).alias("coverage"),
        F.try_divide("n_correct", "n_predicted").alias("accuracy"),
        _n(F.col("n_predicted")).alias("n_predicted"),
        _n(F.col("n_correct")).alias("n_correct"),
        _n(F.col("total_n_predicted") - F.col("n_predicted")).alias("n_deferred"),
    )


def selective_risk(df: DataFrame, right: Column, conf: Column, t: float) -> DataFrame:
    c = coverage_curve(df, right, conf, [t])
    return c.withColumn("risk", F.lit(1.0) - F.col("accuracy"))


def operating_point(df: DataFrame, thresholds: DataFrame, right: Column, conf: str = "conf", pred: str = "pred") -> DataFrame:
    """The coverage curve, with the curve point nearest to the per-class gate marked."""
    g = gate_per_class(df, thresholds, pred, conf)
    op = g.agg(
        F.avg(_i(F.col("is_confident"))).alias("op_coverage"),
        F.avg(F.when(F.col("is_confident"), _i(right))).alias("op_accuracy"),
    )
    curve = with_scalars(coverage_curve(df, right, F.col(conf)), op)
    best = curve.agg(F.min_by("threshold", F.struct(F.abs(F.col("coverage") - F.col("op_coverage")), "threshold")).alias("_b"))
    curve = with_scalars(curve, best)
    return curve.withColumn("is_operating_point", F.col("threshold") == F.col("_b")).drop("_b")


def _first_best(score: Column, ok: Column, default: float) -> Column:
    """The threshold with the best score; the lowest one on ties; default if none is ok."""
    return F.coalesce(F.max_by("threshold", F.when(ok, F.struct(score.alias("s"), (-F.col("threshold")).alias("t")))), F.lit(default))


def per_class_thresholds(df: DataFrame, label: str, pred: str, conf: Column, target: float = 0.80, min_samples: int = 5) -> DataFrame:
    """Per predicted class the lowest threshold that reaches the target accuracy."""
    g = grid_sums(df, [pred], conf, steps(0.40, 0.96, 0.01), {"n": F.lit(1), "hit": _i(F.col(label) == F.col(pred))})
    ok = (F.col("n") >= min_samples) & (F.col("hit") / F.col("n") >= target) & (F.col("total_n") >= min_samples)
    return g.groupBy(F.col(pred).alias("pred")).agg(_first_best(F.col("n").cast("double"), ok, 0.50).alias("threshold"))


def threshold_for_precision(df: DataFrame, right: Column, conf: Column, target: float = 0.90, only: Column | None = None) -> DataFrame:
    """The threshold with the largest coverage whose precision reaches the target."""
    of = _i(only) if only is not None else F.lit(1)
    g = grid_sums(df, [], conf, steps(0.50, 0.99, 0.01), {"n": F.lit(1), "m": of, "hit": of * _i(right)})
    ok = (F.col("n") >= 10) & (F.col("m") > 0) & (F.try_divide("hit", "m") >= target)
    return g.agg(_first_best(F.col("n").cast("double"), ok, 0.50).alias("threshold"))


def threshold_for_accuracy(df: DataFrame, right: Column, conf: Column, target: float = 0.90, min_coverage: float = 0.10) -> DataFrame:
    """Largest coverage that reaches the accuracy, else the most accurate threshold."""
    c = coverage_curve(df, right, conf)
    ok = (F.col("accuracy") >= target) & (F.col("coverage") >= min_coverage)
    lowest = -F.col("threshold")
    return c.agg(
        F.coalesce(
            F.max_by("threshold", F.when(ok, F.struct(F.col("coverage").alias("s"), lowest.alias("t")))),
            F.max_by("threshold", F.when(F.col("accuracy").isNotNull(), F.struct(F.col("accuracy").alias("s"), lowest.alias("t")))),
        ).alias("threshold")
    )


def threshold_for_coverage(df: DataFrame, conf: Column, targets: Sequence[float]) -> DataFrame:
    q = quantiles(df, [], conf, {f"c{i}": Quantile(1 - t) for i, t in enumerate(targets)})
    rows = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"c{i}").alias("threshold")) for i, t in enumerate(targets)])
    return q.select(F.inline(rows))


def running_confusion(df: DataFrame, y: Column, p: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from high to low: positives and negatives at or above it.

    Rows are summed per score before anything is ordered.
    """
    agg = df.groupBy(*keys, p.alias("score")).agg(F.sum(_i(y == 1)).alias("pos"), F.sum(_i(y == 0)).alias("neg"))
    run = ordered(agg, list(keys), [F.desc("score")])
    return run.with_running({"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}).result()


def pr_optimal_threshold(df: DataFrame, y: Column, p: Column, target: float = 0.90) -> DataFrame:
    """The score cut with the highest recall at the target precision, else the most precise."""
    r = running_confusion(df, y, p).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    low = -F.col("score")
    best = F.max_by(F.struct("score", "precision", "tp"), F.when(F.col("precision") >= target, F.struct(F.col("tp").alias("a"), low.alias("b"))))
    fall = F.max_by(F.struct("score", "precision", "tp"), F.struct(F.col("precision").alias("a"), low.alias("b")))
    out = r.agg(F.coalesce(best, fall).alias("b"), F.sum("pos").alias("n_pos"))
    return out.select(F.col("b.score").alias("threshold"), F.col("b.precision").alias("precision"), (F.col("b.tp") / F.col("n_pos")).alias("recall"))


def _fbeta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return F.coalesce(F.try_divide(F.lit(1 + b2) * tp, F.lit(1 + b2) * tp + F.lit(b2) * fn + fp), F.lit(0.0))


def gate_sweep(df: DataFrame, y: Column, p: Column, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Quality of the positive class on rows whose confidence reaches each threshold."""
    pred = p >= 0.5
    sums = {
        "n": F.lit(1),
        "tp": _i(pred & (y == 1)),
        "fp": _i(pred & (y == 0)),
        "fn": _i(~pred & (y == 1)),
        "pos": _i(y == 1),
    }
    g = grid_sums(df, [], F.greatest(p, F.lit(1.0) - p), thresholds or steps(0.10, 0.96, 0.05), sums).where("n > 0")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(
        "threshold",
        ((F.col("n") - fp - fn) / F.col("n")).alias("accuracy"),
        (F.col("n") / F.col("total_n")).alias("coverage"),
        _n(F.col("n")).alias("n_covered"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        (tp / F.greatest(F.col("total_pos"), F.lit(1))).alias("true_recall"),
        _fbeta(tp, fp, fn).alias("f1"),
        _fbeta(tp, fp, fn, 2.0).alias("f2"),
    )


def class_sweep(df: DataFrame, y: Column, p: Column, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Quality when every row with p >= t is called positive."""
    g = grid_sums(df, [], p, thresholds or steps(0.10, 0.55, 0.05), {"n": F.lit(1), "tp": _i(y == 1)})
    tp = F.col("tp")
    fp, fn = F.col("n") - tp, F.col("total_tp") - tp
    return g.select(
        "threshold",
        ((F.col("total_n") - fp - fn) / F.col("total_n")).alias("accuracy"),
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        _fbeta(tp, fp, fn).alias("f1"),
        _fbeta(tp, fp, fn, 2.0).alias("f2"),
    )


def flag_recall(df: DataFrame, y: Column, p: Column, thresholds: Sequence[float] = (0.08, 0.10, 0.15, 0.20, 0.30)) -> DataFrame:
    """Share of rows flagged and recall of the positives at each threshold."""
    g = grid_sums(df, [], p, thresholds, {"n": F.lit(1), "tp": _i(y == 1)})
    return g.select(
        "threshold",
        _n(F.col("n")).alias("flagged"),
        (F.col("n") / F.col("total_n")).alias("share"),
        F.coalesce(F.try_divide("tp", "total_tp"), F.lit(0.0)).alias("recall"),
    )


def stage_thresholds(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """The four global threshold rules of the alert stages, on binary scored rows (one row).

    In the first rule "recall" counts all predicted positives, as the original rule does.
    """
    pred = p >= 0.5
    sums = {
        "n": F.lit(1),
        "pp": _i(pred),
        "tp": _i(pred & (y == 1)),
        "fn": _i(~pred & (y == 1)),
        "hit": _i(pred == (y == 1)),
        "pos": _i(y == 1),
    }
    g = grid_sums(df, [], F.greatest(p, F.lit(1.0) - p), steps(0.40, 0.96, 0.01), sums)
    t, n, pp, tp = F.col("threshold"), F.col("n"), F.col("pp"), F.col("tp")
    prec = F.coalesce(F.try_divide(tp, pp), F.lit(0.0))
    rec_all = F.coalesce(F.try_divide(pp, F.col("total_pos")), F.lit(0.0))
    f_inv = F.coalesce(F.try_divide(F.lit(2.0) * prec * rec_all, prec + rec_all), F.lit(0.0))
    acc, cov = F.try_divide("hit", "n"), n / F.col("total_n")
    rec = F.coalesce(F.try_divide(tp, tp + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * prec * rec, prec + rec), F.lit(0.0))
    score = f1 + F.lit(0.1) * cov
    return g.agg(
        _first_best(f_inv, (t >= 0.50) & (n >= 10) & (pp > 0) & (prec >= 0.80) & (f_inv > 0), 0.70).alias("invalid_threshold"),
        _first_best(acc * cov, (t < 0.90) & (n >= 20) & (acc >= 0.70), 0.50).alias("disposition_threshold"),
        F.coalesce(F.min(F.when((t >= 0.70) & (pp > 0) & (prec >= 0.85), t)), F.lit(0.80)).alias("noise_threshold"),
        _first_best(score, (t < 0.90) & (n >= 10) & (score > 0), 0.50).alias("linkage_threshold"),
    )


# --- cascades --------------------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """One stage of a cascade over scored columns.

    ``rows`` selects the rows the stage looks at, ``routing`` maps a class (or -1 for an
    unsure row) to 'terminal', 'next' or 'defer'. Classes without an entry are terminal.
    """

    name: str
    pred: Column
    conf: Column
    confident: Column
    rows: Column | None = None
    routing: dict[int, str] = field(default_factory=dict)


def cascade(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Route rows through the stages; adds per-stage and ``final_*`` columns.

    A confident row routed to 'next' already carries that decision, so it stays automated
    when a later stage defers it.
    """
    df = df.withColumns(
        {"_active": F.lit(True), "final_stage": F.lit("none"), "final_pred": F.lit(DEFER), "final_conf": F.lit(0.0)}
    )
    for s in stages:
        seen = F.col("_active") if s.rows is None else F.col("_active") & s.rows
        df = df.withColumns(
            {
                "_seen": seen,
                f"{s.name}_confident": F.when(seen, s.confident).otherwise(F.lit(False)),
                f"{s.name}_confidence": F.when(seen, s.conf).otherwise(F.lit(0.0)),
                "_cls": s.pred.cast("int"),
            }
        )
        ok = F.col(f"{s.name}_confident")
        nxt = [c for c, r in s.routing.items() if r == "next" and c != DEFER]
        goes_on = F.col("_cls").isin(nxt) if nxt else F.lit(False)
        stays_unsure = F.lit(s.routing.get(DEFER, "defer") != "defer")
        df = df.withColumns(
            {
                f"{s.name}_pred": F.when(ok, F.col("_cls")).otherwise(F.lit(DEFER)),
                "final_stage": F.when(ok, F.lit(s.name)).otherwise(F.col("final_stage")),
                "final_pred": F.when(ok, F.col("_cls")).otherwise(F.col("final_pred")),
                "final_conf": F.when(ok, s.conf).otherwise(F.col("final_conf")),
                "_active": F.when(~F.col("_seen"), F.col("_active")).when(ok, goes_on).otherwise(stays_unsure),
            }
        )
    return df.drop("_active", "_seen", "_cls").withColumn("automated", F.col("final_pred") != DEFER)


def rescue(df: DataFrame, second: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Take the second opinion ``(id, second_pred, second_conf)`` for deferred rows."""
    out = df.join(second, "id", "left")
    saved = ~F.col("automated") & F.coalesce(F.col("second_conf") >= threshold, F.lit(False))
    return out.withColumns(
        {
            "rescued": saved,
            "final_pred_all": F.when(saved, F.col("second_pred")).otherwise(F.col("final_pred")),
            "automated_all": F.col("automated") | saved,
        }
    )


# Thresholds of the cascade curve.
CASCADE_GRID = [0.40, 0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.95]


def cascade_curve(df: DataFrame, label: str, thresholds: Sequence[float] = tuple(CASCADE_GRID)) -> DataFrame:
    """Accuracy and coverage of automated rows per threshold, with the lift over the majority class."""
    g = grid_sums(
        df,
        [],
        F.when(F.col("automated"), F.col("final_conf")).otherwise(F.lit(-1.0)),
        [-0.5, *thresholds],
        {"n": F.lit(1), "hit": _i(F.col("final_pred") == F.col(label))},
    )
    major = df.groupBy(label).count().agg((F.max("count") / F.sum("count")).alias("majority_accuracy"))
    g = with_scalars(g, major).where("n > 0")
    acc = F.col("hit") / F.col("n")
    return g.select(
        F.when(F.col("threshold") < 0, "operating_point").otherwise(F.format_string("t_%.2f", "threshold")).alias("point"),
        acc.alias("accuracy"),
        (F.col("n") / F.col("total_n")).alias("coverage"),
        _n(F.col("n")).alias("n_automated"),
        _n(F.col("total_n") - F.col("n")).alias("n_deferred"),
        (acc - F.col("majority_accuracy")).alias("lift"),
    )
