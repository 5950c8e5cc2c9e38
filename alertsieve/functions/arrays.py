"""Statistics of short array<double> columns (windows cut from a series).

Arguments should be plain columns: they are referred to several times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + x)


def mean(w: Column) -> Column:
    return F.try_divide(total(w), F.size(w))


def central(w: Column, m: Column, k: int) -> Column:
    """k-th central moment (population)."""

    def power(d: Column) -> Column:
        out = d
        for _ in range(k - 1):
            out = out * d
        return out

    return F.try_divide(F.aggregate(w, F.lit(0.0), lambda a, x: a + power(x - m)), F.size(w))


def linear_quantile(s: Column, q: float) -> Column:
    """Linear quantile of a sorted array."""
    h = (F.size(s) - 1) * F.lit(q)
    lo, hi = F.get(s, F.floor(h).cast("int")), F.get(s, F.ceil(h).cast("int"))
    return lo + (hi - lo) * (h - F.floor(h))


def slope(w: Column) -> Column:
    """Least-squares slope over positions 0..n-1."""
    n = F.size(w).cast("double")
    at = F.aggregate(
        w,
        F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("c")),
        lambda a, x: F.struct((a["i"] + 1.0).alias("i"), (a["s"] + x).alias("s"), (a["c"] + a["i"] * x).alias("c")),
        lambda a: F.try_divide(a["c"] - a["s"] * (a["i"] - 1.0) / 2.0, a["i"] * (a["i"] * a["i"] - 1.0) / 12.0),
    )
    return F.when(n > 1, at)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two arrays of equal length."""
    z = F.aggregate(
        F.arrays_zip(x.alias("x"), y.alias("y")),
        F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")]),
        lambda a, r: F.struct(
            (a["n"] + 1.0).alias("n"),
            (a["x"] + r["x"]).alias("x"),
            (a["y"] + r["y"]).alias("y"),
            (a["xx"] + r["x"] * r["x"]).alias("xx"),
            (a["yy"] + r["y"] * r["y"]).alias("yy"),
            (a["xy"] + r["x"] * r["y"]).alias("xy"),
        ),
        lambda a: F.try_divide(
            a["n"] * a["xy"] - a["x"] * a["y"],
            F.sqrt(F.greatest((a["n"] * a["xx"] - a["x"] * a["x"]) * (a["n"] * a["yy"] - a["y"] * a["y"]), F.lit(0.0))),
        ),
    )
    return z


def diffs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(2), n), F.slice(w, F.lit(1), n), lambda b, a: b - a)


def direction_changes(w: Column) -> Column:
    """Number of neighbouring differences with another sign."""
    s = F.aggregate(
        w,
        F.struct(F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("s"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            x.alias("p"),
            F.signum(x - a["p"]).alias("s"),
            (a["n"] + F.coalesce((F.signum(x - a["p"]) != a["s"]).cast("int"), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return s


def cusum_range(w: Column, m: Column) -> Column:
    """struct(hi, lo) of the running sum of w - m."""
    return F.aggregate(
        w,
        F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("lo")),
        lambda a, x: F.struct(
            (a["s"] + x - m).alias("s"),
            F.greatest(a["hi"], a["s"] + x - m).alias("hi"),
            F.least(a["lo"], a["s"] + x - m).alias("lo"),
        ),
    )


def ewma_deviation(w: Column, alpha: float = 0.3) -> Column:
    """Population std of w minus its adjusted exponential average."""
    k = 1.0 - alpha

    def step(a: Column, x: Column) -> Column:
        num, den = a["num"] * k + x, a["den"] * k + 1.0
        d = x - num / den
        return F.struct(num.alias("num"), den.alias("den"), (a["n"] + 1.0).alias("n"), (a["d"] + d).alias("d"), (a["dd"] + d * d).alias("dd"))

    return F.aggregate(
        w,
        F.struct(*[F.lit(0.0).alias(c) for c in ("num", "den", "n", "d", "dd")]),
        step,
        lambda a: F.sqrt(F.greatest(F.try_divide(a["dd"], a["n"]) - F.pow(F.try_divide(a["d"], a["n"]), F.lit(2.0)), F.lit(0.0))),
    )


def smoothed_level(w: Column, alpha: float = 0.3) -> Column:
    """Level of simple exponential smoothing started at the first value."""
    return F.aggregate(w, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * a))


def trend_forecast(w: Column, horizon: int, alpha: float = 0.3, beta: float = 0.1) -> Column:
    """Level plus trend smoothing with fixed constants; array of ``horizon`` values."""
    start = F.struct(F.lit(None).cast("double").alias("l"), F.lit(0.0).alias("t"))

    def step(a: Column, x: Column) -> Column:
        level = F.lit(alpha) * x + F.lit(1 - alpha) * (a["l"] + a["t"])
        trend = F.lit(beta) * (level - a["l"]) + F.lit(1 - beta) * a["t"]
        return F.struct(F.when(a["l"].isNull(), x).otherwise(level).alias("l"), F.when(a["l"].isNull(), F.lit(0.0)).otherwise(trend).alias("t"))

    return F.aggregate(w, start, step, lambda a: F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: a["l"] + a["t"] * h))


def histogram_entropy(w: Column, bins: int = 10) -> Column:
    """Entropy of an equal-width histogram over the range of w."""
    lo, hi = F.array_min(w), F.array_max(w)
    k = F.least(F.lit(bins), F.size(w))
    width = F.when(hi > lo, (hi - lo) / k).otherwise(F.lit(1.0))
    # a window of equal values fills a single bin
    idx = F.transform(w, lambda x: F.least(F.floor((x - lo) / width).cast("int"), k - 1))
    parts = F.transform(F.sequence(F.lit(0), k - 1), lambda b: F.size(F.filter(idx, lambda i: i == b)) / F.size(w))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p + F.lit(1e-10))).otherwise(0.0))
