"""Series in long form (series_id, ts, value): positions, windows and window features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.functions import arrays as ar
from alertsieve.operators.lookup import lookup_join
from alertsieve.operators.ordering import Quantile, column_quantiles, ordered, with_scalars

# Feature groups for ablations.
FEATURE_GROUPS = {
    "local_stats": ["ts_mean", "ts_median", "ts_std", "ts_cv", "ts_min", "ts_max", "ts_range", "ts_iqr", "ts_skew", "ts_kurtosis"],
    "change_metrics": ["ts_change_abs", "ts_change_pct", "ts_normalized_change", "ts_zscore"],
    "slope_features": ["ts_local_slope", "ts_slope_r2", "ts_early_slope", "ts_late_slope", "ts_slope_diff"],
    "stability": ["ts_direction_changes", "ts_direction_change_rate", "ts_variance_ratio", "ts_autocorr_lag1"],
    "drift": ["ts_cusum_max", "ts_cusum_min", "ts_ewma_deviation", "ts_trend_strength"],
}


def positioned(df: DataFrame, key: str = "series_id", order: Sequence[str] = ("ts", "eid")) -> DataFrame:
    return ordered(df, [key], list(order)).with_position("pos").result()


def pre_windows(df: DataFrame, at: Column, size: int = 20, key: str = "series_id", order: Sequence[str] = ("ts", "eid")) -> DataFrame:
    """Rows where ``at`` holds, with the ``size`` values before them as array ``w``."""
    o = ordered(df, [key], list(order), before=size)
    o = o.with_columns({"w": F.collect_list("value").over(o.rows(-size, -1))})
    return o.result().where(at & (F.size("w") > 0))


def around_windows(df: DataFrame, at: Column, before: int = 30, after: int = 20, min_size: int = 20, key: str = "series_id", order: Sequence[str] = ("ts", "eid")) -> DataFrame:
    """Signals around the rows where ``at`` holds, with the position of the row in the signal."""
    o = ordered(df, [key], list(order), before=before, after=after)
    o = o.with_columns(
        {
            "signal": F.collect_list("value").over(o.rows(-before, after - 1)),
            "true_pos": F.count(F.lit(1)).over(o.rows(-before, -1)).cast("int"),
        }
    )
    return o.result().where(at & (F.size("signal") >= min_size))


def forecast_windows(df: DataFrame, at: Column, size: int = 30, horizon: int = 5, key: str = "series_id", order: Sequence[str] = ("ts", "eid")) -> DataFrame:
    """``train`` (size values before) and ``actual`` (horizon values from the row on), full ones only."""
    o = ordered(df, [key], list(order), before=size, after=horizon)
    o = o.with_columns({"train": F.collect_list("value").over(o.rows(-size, -1)), "actual": F.collect_list("value").over(o.rows(0, horizon - 1))})
    return o.result().where(at & (F.size("train") == size) & (F.size("actual") == horizon))


def window_stats(df: DataFrame) -> DataFrame:
    """Level, spread and shape of ``w``; null below three values."""
    df = df.withColumns({"_n": F.size("w"), "_m": ar.mean(F.col("w")), "_s": F.array_sort("w")})
    df = df.withColumns({f"_m{k}": ar.central(F.col("w"), F.col("_m"), k) for k in (2, 3, 4)})
    n, m, s, sd = F.col("_n"), F.col("_m"), F.col("_s"), F.sqrt("_m2")
    out = {
        "ts_mean": m,
        "ts_median": ar.linear_quantile(s, 0.5),
        "ts_std": sd,
        "ts_cv": F.try_divide(sd, m),
        "ts_min": F.get(s, F.lit(0)),
        "ts_max": F.get(s, n - 1),
        "ts_range": F.get(s, n - 1) - F.get(s, F.lit(0)),
        "ts_iqr": ar.linear_quantile(s, 0.75) - ar.linear_quantile(s, 0.25),
        "ts_skew": F.try_divide("_m3", F.pow(F.col("_m2"), F.lit(1.5))),
        "ts_kurtosis": F.when(n > 3, F.try_divide(F.col("_m4"), F.col("_m2") * F.col("_m2")) - 3.0).otherwise(0.0),
    }
    df = df.withColumns({k: F.when(n >= 3, v) for k, v in out.items()})
    return df.drop("_n", "_m", "_s", "_m2", "_m3", "_m4")


def change_metrics(df: DataFrame, value: str = "value") -> DataFrame:
    """Change of the row's value against its window; null below two values."""
    df = df.withColumns({"_m": ar.mean(F.col("w"))}).withColumn("_sd", F.sqrt(ar.central(F.col("w"), F.col("_m"), 2)))
    ok = F.size("w") >= 2
    c = F.col(value) - F.col("_m")
    z = F.when(F.col("_sd") > 0, c / F.col("_sd"))
    out = {"ts_change_abs": c, "ts_change_pct": F.try_divide(c * 100.0, F.col("_m")), "ts_normalized_change": z, "ts_zscore": z}
    return df.withColumns({k: F.when(ok, v) for k, v in out.items()}).drop("_m", "_sd")


def slope_features(df: DataFrame) -> DataFrame:
    n, mid = F.size("w"), F.floor(F.size("w") / 2).cast("int")
    df = df.withColumns({"_a": F.slice("w", F.lit(1), F.greatest(mid, F.lit(0))), "_b": F.slice("w", mid + 1, n - mid), "_m": ar.mean(F.col("w"))})
    df = df.withColumns({"_k": ar.slope(F.col("w")), "_ka": ar.slope(F.col("_a")), "_kb": ar.slope(F.col("_b")), "_v": ar.central(F.col("w"), F.col("_m"), 2)})
    nn = n.cast("double")
    r2 = F.try_divide(F.col("_k") * F.col("_k") * (nn * nn - 1.0) / 12.0, F.col("_v"))
    halves = (n >= 3) & (mid > 2)
    out = {
        "ts_local_slope": F.when(n >= 3, F.col("_k")),
        "ts_slope_r2": F.when(n >= 3, r2),
        "ts_early_slope": F.when(halves, F.col("_ka")),
        "ts_late_slope": F.when(halves, F.col("_kb")),
        "ts_slope_diff": F.when(halves, F.col("_kb") - F.col("_ka")),
    }
    return df.withColumns(out).drop("_a", "_b", "_m", "_k", "_ka", "_kb", "_v")


def stability_features(df: DataFrame) -> DataFrame:
    n = F.size("w")
    recent = F.greatest(F.floor(n / 3).cast("int"), F.lit(3))
    df = df.withColumns({"_r": F.slice("w", F.greatest(n - recent + 1, F.lit(1)), recent), "_x": F.slice("w", F.lit(1), n - 1), "_y": F.slice("w", F.lit(2), n - 1), "_d": ar.direction_changes(F.col("w")), "_m": ar.mean(F.col("w"))})
    df = df.withColumn("_rm", ar.mean(F.col("_r")))
    ok = n >= 5
    out = {
        "ts_direction_changes": F.col("_d"),
        "ts_direction_change_rate": F.try_divide(F.col("_d"), n - 1),
        "ts_variance_ratio": F.try_divide(ar.central(F.col("_r"), F.col("_rm"), 2), ar.central(F.col("w"), F.col("_m"), 2)),
        "ts_autocorr_lag1": ar.pearson(F.col("_x"), F.col("_y")),
    }
    return df.withColumns({k: F.when(ok, v) for k, v in out.items()}).drop("_r", "_x", "_y", "_d", "_m", "_rm")


def drift_features(df: DataFrame) -> DataFrame:
    n = F.size("w")
    df = df.withColumn("_m", ar.mean(F.col("w")))
    df = df.withColumns({"_c": ar.cusum_range(F.col("w"), F.col("_m")), "_k": ar.slope(F.col("w")), "_v": ar.central(F.col("w"), F.col("_m"), 2)})
    nn = n.cast("double")
    out = {
        "ts_cusum_max": F.col("_c.hi"),
        "ts_cusum_min": F.col("_c.lo"),
        "ts_ewma_deviation": ar.ewma_deviation(F.col("w")),
        "ts_trend_strength": F.coalesce(F.try_divide(F.col("_k") * F.col("_k") * (nn * nn - 1.0) / 12.0, F.col("_v")), F.lit(0.0)),
    }
    return df.withColumns({k: F.when(n >= 5, v) for k, v in out.items()}).drop("_m", "_c", "_k", "_v")


def all_features(df: DataFrame) -> DataFrame:
    """All five groups and the window size."""
    out = drift_features(stability_features(slope_features(change_metrics(window_stats(df)))))
    return out.withColumn("ts_window_size", F.size("w"))


def direction_free_features(df: DataFrame) -> DataFrame:
    """Features that do not tell up from down; rows below three values are dropped."""
    df = df.where(F.size("w") >= 3)
    n, mid = F.size("w"), F.floor(F.size("w") / 2).cast("int")
    df = df.withColumns(
        {
            "_m": ar.mean(F.col("w")),
            "_s": F.array_sort("w"),
            "_d": ar.diffs(F.col("w")),
            "_a": F.slice("w", F.lit(1), mid),
            "_b": F.slice("w", mid + 1, n - mid),
            "_x": F.slice("w", F.lit(1), n - 1),
            "_y": F.slice("w", F.lit(2), n - 1),
        }
    )
    df = df.withColumns({"_dm": ar.mean(F.col("_d")), "_am": ar.mean(F.col("_a")), "_bm": ar.mean(F.col("_b")), "_sd": F.sqrt(ar.central(F.col("w"), F.col("_m"), 2))})
    df = df.withColumns({"_va": ar.central(F.col("_a"), F.col("_am"), 2) + 1e-10, "_vb": ar.central(F.col("_b"), F.col("_bm"), 2) + 1e-10})
    s = F.col("_s")
    dev = F.aggregate("w", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m")))
    out = {
        "ts_mean": F.col("_m"),
        "ts_std": F.col("_sd"),
        "ts_cv": F.col("_sd") / (F.col("_m") + 1e-10),
        "ts_min": F.get(s, F.lit(0)),
        "ts_max": F.get(s, n - 1),
        "ts_range": F.get(s, n - 1) - F.get(s, F.lit(0)),
        "ts_iqr": ar.linear_quantile(s, 0.75) - ar.linear_quantile(s, 0.25),
        "ts_median": ar.linear_quantile(s, 0.5),
        "ts_diff_std": F.sqrt(ar.central(F.col("_d"), F.col("_dm"), 2)),
        "ts_diff_mean_abs": F.try_divide(F.aggregate("_d", F.lit(0.0), lambda a, x: a + F.abs(x)), n - 1),
        "ts_direction_changes": ar.direction_changes(F.col("w")),
        "ts_trend_abs": F.abs(ar.slope(F.col("w"))),
        "ts_autocorr": F.when(n > 3, F.coalesce(ar.pearson(F.col("_x"), F.col("_y")), F.lit(0.0))).otherwise(0.0),
        "ts_variance_ratio": F.when(mid > 1, F.greatest("_va", "_vb") / F.least("_va", "_vb")).otherwise(1.0),
        "ts_cusum_max": dev,
        "ts_entropy": ar.histogram_entropy(F.col("w")),
    }
    return df.withColumns(out).drop("_m", "_s", "_d", "_a", "_b", "_x", "_y", "_dm", "_am", "_bm", "_sd", "_va", "_vb")


def fill_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinite values to 0, missing ones to the column's median, else 0."""
    inf = float("inf")
    df = df.withColumns({c: F.when(F.abs(F.col(c)) == inf, 0.0).otherwise(F.nanvl(F.col(c), F.lit(None).cast("double"))) for c in cols})
    medians = column_quantiles(df, cols, {"_q": Quantile(0.5)})
    df = with_scalars(df, medians.agg(*[F.max(F.when(F.col("column") == c, F.col("_q"))).alias(f"_q_{c}") for c in cols]))
    return df.withColumns({c: F.coalesce(c, f"_q_{c}", F.lit(0.0)) for c in cols}).drop(*[f"_q_{c}" for c in cols])


def prepare_signal(df: DataFrame, smooth: int = 1, normalise: bool = True, key: str = "series_id", order: Sequence[str] = ("ts", "eid")) -> DataFrame:
    """Drop null values, centred rolling mean, z-scores per series (population std)."""
    df = df.where(F.col("value").isNotNull())
    if smooth > 1:
        k = smooth // 2
        o = ordered(df, [key], list(order), before=k, after=k)
        df = o.with_columns({"signal": F.avg("value").over(o.rows(-k, k))}).result()
    else:
        df = df.withColumn("signal", F.col("value"))
    if not normalise:
        return df
    s = df.groupBy(key).agg(F.avg("signal").alias("_m"), F.stddev_pop("signal").alias("_s"))
    df = lookup_join(df, s, [key], "left")
    return df.withColumn("signal", F.when(F.col("_s") > 0, (F.col("signal") - F.col("_m")) / F.col("_s")).otherwise(F.col("signal"))).drop("_m", "_s")


def lag_matrix(df: DataFrame, n: int, key: str = "series_id", order: Sequence[str] = ("ts", "eid")) -> DataFrame:
    """Columns lag_1..lag_n; rows without all lags are dropped."""
    o = ordered(df, [key], list(order), before=n)
    o = o.with_columns({f"lag_{i}": o.lag("value", i) for i in range(1, n + 1)})
    return o.result().where(F.col(f"lag_{n}").isNotNull())


def padded_sequence(w: Column, length: int) -> Column:
    """The last ``length`` values, padded on the left with their mean, z-normalised later."""
    tail = F.slice(w, F.greatest(F.size(w) - length + 1, F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(ar.mean(tail), F.greatest(F.lit(length) - F.size(tail), F.lit(0))), tail)


def sequences(df: DataFrame, length: int) -> DataFrame:
    """Fixed-length z-normalised sequences from ``w``."""
    df = df.withColumn("_q", padded_sequence(F.col("w"), length))
    df = df.withColumn("_m", ar.mean(F.col("_q"))).withColumn("_s", F.sqrt(ar.central(F.col("_q"), F.col("_m"), 2)))
    return df.withColumn("sequence", F.transform("_q", lambda x: (x - F.col("_m")) / (F.col("_s") + 1e-8))).drop("_q", "_m", "_s")
