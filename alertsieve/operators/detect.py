"""Change points over a table of series.

Window detectors read two neighbouring windows of each point, all of them in one pass over the
ordered rows. Rules that go through hits one after the other (gap suppression, greedy matching)
are in ``scans``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.operators.lookup import lookup_join
from alertsieve.operators.ordering import ordered
from alertsieve.operators.scans import match_points, suppress  # noqa: F401  part of this module

# Two-sided 5 % points of the t distribution at 2w-2 degrees of freedom, by window w.
T_CRITICAL = {5: 2.306004, 10: 2.100922, 15: 2.048407, 20: 2.024394}


@dataclass(frozen=True)
class Detector:
    """A rule on the window pair (left: w points before, right: w points from the row on)."""

    name: str
    window: int
    hit: Callable[[dict[str, Column]], Column]
    gap: int  # a hit is kept only if more than gap after the last kept one; -1 keeps all


def _t_over(a: dict[str, Column], threshold: float) -> Column:
    """abs t > threshold for equal windows; a shift without any spread always counts."""
    diff, spread = F.abs(a["ml"] - a["mr"]), a["vl"] + a["vr"]
    return F.when(spread > 0, diff > threshold * F.sqrt(spread / a["w"])).otherwise(diff > 0)


def t_shift(window: int = 10, threshold: float = 2.0, gap: int | None = None, name: str | None = None, test: bool = True) -> Detector:
    """Two-sample t; with ``test`` the 5 % point applies as well."""
    cut = max(threshold, T_CRITICAL[window]) if test else threshold
    return Detector(name or f"t_shift_{window}_{threshold:g}", window, lambda a: _t_over(a, cut), window // 2 if gap is None else gap)


def effect_shift(window: int = 10, effect: float = 0.5, name: str = "effect_shift") -> Detector:
    def hit(a: dict[str, Column]) -> Column:
        pooled = F.sqrt((a["pl"] + a["pr"]) / 2.0) + 1e-10
        return (F.abs(a["mr"] - a["ml"]) / pooled > effect) & _t_over(a, T_CRITICAL[window])

    return Detector(name, window, hit, window)


def mean_shift(window: int = 10, threshold: float = 2.5) -> Detector:
    return Detector(f"mean_shift_{threshold:g}", window, lambda a: (a["pl"] > 0) & (F.abs(a["mr"] - a["ml"]) > threshold * F.sqrt(a["pl"])), window)


def hazard_shift(window: int = 10, hazard: float = 100.0, threshold: float = 0.5) -> Detector:
    def hit(a: dict[str, Column]) -> Column:
        z = F.try_divide(F.abs(a["mr"] - a["ml"]), F.sqrt(a["pl"]))
        return F.lit(1.0) - F.exp(-z / hazard * 10.0) > threshold

    return Detector("hazard_shift", window, hit, window // 2)


def kl_shift(window: int = 5, threshold: float = 1.0) -> Detector:
    def hit(a: dict[str, Column]) -> Column:
        s, t = F.sqrt(a["pl"]) + 1e-10, F.sqrt(a["pr"]) + 1e-10
        return F.ln(t / s) + (s * s + F.pow(a["ml"] - a["mr"], F.lit(2.0))) / (t * t * 2.0) - 0.5 > threshold

    return Detector("kl_shift", window, hit, window)


def variance_shift(window: int = 10, threshold: float = 2.0) -> Detector:
    def hit(a: dict[str, Column]) -> Column:
        lo, hi = F.least(a["pl"], a["pr"]), F.greatest(a["pl"], a["pr"])
        return (lo > 0) & (hi > threshold * lo)

    return Detector("variance_shift", window, hit, -1)


def raw_hits(df: DataFrame, detectors: Sequence[Detector], key: str = "series_id", order: Sequence[str] = ("pos",), value: str = "value") -> DataFrame:
    """``key, pos, detector, gap`` of every point where a rule holds.

    A point counts only with a full window on the left, a full one on the right and one more
    point after it.
    """
    widths = sorted({d.window for d in detectors})
    o = ordered(df.select(key, *order, *([] if "pos" in order else ["pos"]), F.col(value).alias("_v")), [key], list(order), before=max(widths), after=max(widths) + 1)
    cols = {}
    for w in widths:
        left, right = o.rows(-w, -1), o.rows(0, w - 1)
        cols |= {
            f"ml{w}": F.avg("_v").over(left),
            f"mr{w}": F.avg("_v").over(right),
            f"pl{w}": F.var_pop("_v").over(left),
            f"pr{w}": F.var_pop("_v").over(right),
            f"ok{w}": (F.count("_v").over(left) == w) & (F.count("_v").over(o.rows(0, w)) == w + 1),
        }
    rows = o.with_columns(cols).result()
    found = []
    for d in detectors:
        w = d.window
        a = {c: F.col(f"{c}{w}") for c in ("ml", "mr", "pl", "pr")}
        a |= {"vl": a["pl"] * w / (w - 1), "vr": a["pr"] * w / (w - 1), "w": F.lit(float(w))}
        found.append(F.when(F.col(f"ok{w}") & d.hit(a), F.struct(F.lit(d.name).alias("detector"), F.lit(d.gap).alias("gap"))))
    return rows.select(key, "pos", F.inline(F.array_compact(F.array(*found))))


def detect(df: DataFrame, detectors: Sequence[Detector], key: str = "series_id") -> DataFrame:
    """Final change points ``key, detector, pos`` of series rows ``key, pos, value``."""
    return suppress(raw_hits(df, detectors, key), [key, "detector"]).select(key, "detector", "pos")


def cusum_excess(df: DataFrame, drift: float = 0.5, key: str = "series_id") -> DataFrame:
    """``key, pos, excess``: how far a standardised cumulative sum, up or down, is above its lowest value so far.

    For series of 10 points or more. The sums are never rebuilt.
    """
    s = df.groupBy(key).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count(F.lit(1)).alias("_n")).where("_n >= 10")
    z = lookup_join(df.select(key, "pos", "value"), s, [key], "inner")
    z = z.withColumn("_z", F.when(F.col("pos") == 0, 0.0).otherwise((F.col("value") - F.col("_m")) / (F.col("_s") + 1e-10)))
    step = F.when(F.col("pos") == 0, 0.0).otherwise(F.lit(drift))
    o = ordered(z.select(key, "pos", (F.col("_z") - step).alias("_up"), (-F.col("_z") - step).alias("_dn")), [key], ["pos"])
    o = o.with_running({"_su": ("sum", F.col("_up")), "_sd": ("sum", F.col("_dn"))})
    o = o.with_running({"_mu": ("min", F.col("_su")), "_md": ("min", F.col("_sd"))})
    return o.result().select(key, "pos", F.greatest(F.col("_su") - F.col("_mu"), F.col("_sd") - F.col("_md")).alias("excess"))


def cusum(df: DataFrame, threshold: float = 3.0, drift: float = 0.5, key: str = "series_id") -> DataFrame:
    """First point where the excess of the cumulative sum is above the threshold: at most one in a series."""
    return cusum_excess(df, drift, key).where(F.col("excess") > threshold).groupBy(key).agg(F.min("pos").alias("pos"))


def cusum_grid(df: DataFrame, thresholds: Sequence[float], drift: float = 0.5, key: str = "series_id") -> DataFrame:
    """``key, threshold, pos`` for a grid of thresholds, all from one pass over the points."""
    at = {t: F.min(F.when(F.col("excess") > t, F.col("pos"))).alias(f"_{i}") for i, t in enumerate(thresholds)}
    first = cusum_excess(df, drift, key).groupBy(key).agg(*at.values())
    found = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_{i}").alias("pos")) for i, t in enumerate(at)])
    return first.select(key, F.inline(found)).where("pos IS NOT NULL")


# --- evaluation ---------------------------------------------------------------------------------


def series_scores(hits: DataFrame, truth: DataFrame, tolerance: int, population: DataFrame, key: str = "series_id", nearest: bool = True) -> DataFrame:
    """Per series and detector: counts, precision, recall, F1 and mean delay.

    ``population`` lists every (key, detector) to be scored, also those without any hit. ``truth`` may have a column
    detector as well, where each one has its own.
    """
    keys = [key, "detector"]
    t = truth.join(population, keys if "detector" in truth.columns else key)
    m = match_points(hits, t, tolerance, keys, nearest)
    g = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_detected"))
    q = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_true"))
    r = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matches"), F.avg(F.col("det_pos") - F.col("true_pos")).alias("mean_delay"))
    out = population.join(g, keys, "left").join(q, keys, "left").join(r, keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_detected", "n_true", "n_matches")})
    d, n, k = F.col("n_detected"), F.col("n_true"), F.col("n_matches")
    none = n == 0
    empty = (d == 0).cast("double")
    p = F.when(none, empty).otherwise(F.coalesce(F.try_divide(k, d), F.lit(0.0)))
    rec = F.when(none, 1.0).otherwise(F.try_divide(k, n))
    f1 = F.when(none, empty).otherwise(F.coalesce(F.try_divide(F.lit(2.0) * k, d + n), F.lit(0.0)))
    return out.withColumns({"precision": p, "recall": rec, "f1": f1})


def detector_summary(scores: DataFrame, by: Sequence[str] = ("detector",)) -> DataFrame:
    aggs = []
    for c in ("precision", "recall", "f1"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return scores.groupBy(*by).agg(*aggs, F.sum("n_detected").alias("n_detected"), F.sum("n_true").alias("n_true"), F.sum("n_matches").alias("n_matches"), F.count(F.lit(1)).alias("n_series"))


# Distances of a hit from the truth.
TOLERANCES = [1, 3, 5, 7, 10, 15, 20]


def multi_tolerance(hits: DataFrame, population: DataFrame, key: str = "series_id", tolerances: Sequence[int] = tuple(TOLERANCES)) -> DataFrame:
    """Pooled counts and P/R/F1 per detector and tolerance against at most one true point.

    ``population(key, detector, true_pos)`` has a null true_pos where nothing changed. The
    tolerances are counted side by side on one row per series.
    """
    keys = [key, "detector"]
    j = hits.join(population, keys)
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_det"), F.min(F.abs(F.col("pos") - F.col("true_pos"))).alias("dist"))
    g = population.join(g, keys, "left").withColumn("n_det", F.coalesce("n_det", F.lit(0)))
    items = []
    for t in tolerances:
        tp = F.coalesce((F.col("dist") <= t).cast("int"), F.lit(0))
        fn = F.when(F.col("true_pos").isNull(), 0).otherwise(1) - tp
        items.append(F.struct(F.lit(t).alias("tau"), F.sum(tp).alias("tp"), F.sum(F.col("n_det") - tp).alias("fp"), F.sum(fn).alias("fn")).alias(f"t{t}"))
    out = g.groupBy("detector").agg(*items).select("detector", F.inline(F.array(*[F.col(f"t{t}") for t in tolerances])))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns(
        {
            "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)),
            "f1": F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), F.lit(0.0)),
        }
    )


def tolerance_area(curve: DataFrame) -> DataFrame:
    """Mean F1 over the tolerance axis by trapezoids (a handful of rows per detector)."""
    pts = curve.groupBy("detector").agg(F.array_sort(F.collect_list(F.struct(F.col("tau").cast("double").alias("x"), F.col("f1").alias("y")))).alias("p"))
    n = F.size("p")
    a = F.zip_with(F.slice("p", F.lit(1), n - 1), F.slice("p", F.lit(2), n - 1), lambda u, v: (v["x"] - u["x"]) * (u["y"] + v["y"]) / 2.0)
    span = F.element_at("p", -1)["x"] - F.col("p")[0]["x"]
    return pts.select("detector", (F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / span).alias("area"))


def as_prediction(hits: DataFrame, population: DataFrame, tolerance: int, key: str = "series_id") -> DataFrame:
    """One row per series and detector: hit within the tolerance of the alert, and its delay."""
    keys = [key, "detector"]
    j = hits.join(population, keys).withColumn("_d", F.col("pos") - F.col("alert_pos"))
    g = j.groupBy(*keys).agg(F.min_by("_d", F.when(F.abs(F.col("_d")) <= tolerance, F.col("pos"))).alias("delay"), F.max((F.abs(F.col("_d")) <= tolerance).cast("int")).alias("_hit"))
    out = population.join(g, keys, "left")
    return out.withColumns({"pred": F.coalesce("_hit", F.lit(0)), "delay": F.when(F.col("_hit") == 1, F.col("delay"))}).drop("_hit")
