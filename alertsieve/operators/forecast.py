"""Forecasts from windows of a series, residual scores and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.functions import arrays as ar
from alertsieve.operators.grid import grid_sums
from alertsieve.operators.lookup import lookup_join
from alertsieve.operators.ordering import Quantile, ordered, quantiles

# The 20 thresholds between 0.5 and 5.
SCORE_GRID = [0.5 + i * 4.5 / 19 for i in range(20)]


def forecasters(horizon: int) -> dict[str, Column]:
    """Forecast arrays from the column ``train``."""
    w = F.col("train")

    def flat(c: Column) -> Column:
        return F.array_repeat(c, horizon)

    return {
        "naive_last": flat(F.element_at(w, -1)),
        "naive_mean": flat(ar.mean(w)),
        "naive_median": flat(ar.linear_quantile(F.array_sort(w), 0.5)),
        "moving_average_5": flat(ar.mean(F.slice(w, -5, 5))),
        "exp_smoothing": flat(ar.smoothed_level(w)),
        "trend_smoothing": ar.trend_forecast(w, horizon),
    }


def forecast(windows: DataFrame, horizon: int, models: Sequence[str] | None = None, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per window and model: ``keep, model, train, actual, forecast``."""
    f = {k: v for k, v in forecasters(horizon).items() if models is None or k in models}
    items = F.array(*[F.struct(F.lit(k).alias("model"), v.alias("forecast")) for k, v in f.items()])
    return windows.select(*keep, "train", "actual", F.inline(items))


def mean_abs_error() -> Column:
    e = F.zip_with("actual", "forecast", lambda a, b: F.abs(a - b))
    return ar.mean(e)


def forecast_scores(df: DataFrame) -> DataFrame:
    """Mean absolute error over the std of the training window."""
    df = df.withColumns({"residual": mean_abs_error(), "_m": ar.mean(F.col("train"))})
    df = df.withColumn("_s", F.sqrt(ar.central(F.col("train"), F.col("_m"), 2)))
    return df.withColumn("score", F.when(F.col("_s") > 0, F.col("residual") / F.col("_s")).otherwise(F.col("residual"))).drop("_m", "_s")


def forecast_errors(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE, MAPE and MAE relative to repeating the previous value."""
    sq = F.zip_with("actual", "forecast", lambda a, b: (a - b) * (a - b))
    pe = F.zip_with("actual", "forecast", lambda a, b: F.abs((a - b) / (a + F.lit(1e-10))))
    step = F.transform(ar.diffs(F.col("actual")), lambda x: F.abs(x))
    r = df.select(*by, mean_abs_error().alias("_mae"), ar.mean(sq).alias("_mse"), ar.mean(pe).alias("_mape"), ar.mean(step).alias("_naive"))
    g = r.groupBy(*by).agg(F.avg("_mae").alias("mae"), F.sqrt(F.avg("_mse")).alias("rmse"), (F.avg("_mape") * 100).alias("mape"), F.avg("_naive").alias("_n"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("relative_mae", F.col("mae") / (F.col("_n") + 1e-10)).drop("_n")


def best_threshold(df: DataFrame, y: Column, score: Column, keys: Sequence[str] = (), thresholds: Sequence[float] = tuple(SCORE_GRID)) -> DataFrame:
    """The lowest grid threshold with the best F1 of score > threshold; 1.0 if F1 is 0 everywhere."""
    g = grid_sums(df, keys, score, thresholds, {"n": F.lit(1), "tp": (y == 1).cast("int")})
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("n") + F.col("total_tp")), F.lit(0.0))
    g = g.withColumn("_f", f1)
    out = g.groupBy(*keys).agg(F.max_by(F.struct("threshold", "_f", "n", "tp", "total_tp"), F.when(F.col("_f") > 0, F.struct(F.col("_f").alias("f"), (-F.col("threshold")).alias("t")))).alias("b"))
    b = F.col("b")
    return out.select(
        *keys,
        F.coalesce(b["threshold"], F.lit(1.0)).alias("threshold"),
        F.coalesce(b["_f"], F.lit(0.0)).alias("f1"),
        F.coalesce(F.try_divide(b["tp"], b["n"]), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(b["tp"], b["total_tp"]), F.lit(0.0)).alias("recall"),
    )


def one_step_residuals(df: DataFrame, window: int = 10, key: str = "series_id", order: Sequence[str] = ("pos",)) -> DataFrame:
    """Value minus the mean of the ``window`` values before it (full windows only)."""
    o = ordered(df, [key], list(order), before=window)
    w = o.rows(-window, -1)
    o = o.with_columns({"_m": F.avg("value").over(w), "_n": F.count("value").over(w)})
    return o.result().where(F.col("_n") == window).withColumn("residual", F.col("value") - F.col("_m")).drop("_m", "_n")


def residual_scores(df: DataFrame, key: str = "series_id") -> DataFrame:
    """z, absolute, squared and MAD scores of the residuals of each series."""
    s = df.groupBy(key).agg(F.avg("residual").alias("_a"), F.stddev_pop("residual").alias("_s"))
    med = quantiles(df, [key], "residual", {"_med": Quantile(0.5)}).select(key, "_med")
    d = lookup_join(lookup_join(df, s, [key], "left"), med, [key], "left")
    mad = quantiles(d.select(key, F.abs(F.col("residual") - F.col("_med")).alias("_d")), [key], "_d", {"_mad": Quantile(0.5)}).select(key, "_mad")
    d = lookup_join(d, mad, [key], "left")
    r = F.col("residual")
    return d.withColumns(
        {
            "z_score": F.when(F.col("_s") > 0, F.abs((r - F.col("_a")) / F.col("_s"))).otherwise(F.abs(r)),
            "abs_score": F.abs(r),
            "squared_score": r * r,
            "mad_score": F.when(F.col("_mad") > 0, F.abs(r - F.col("_med")) / (F.col("_mad") * 1.4826)).otherwise(F.abs(r)),
        }
    ).drop("_a", "_s", "_med", "_mad")


def rolling_anomalies(df: DataFrame, thresholds: Sequence[float] = (1.5, 2.0, 2.5, 3.0), window: int = 10, side: int = 5, effect: float = 0.5, min_rows: int = 30, key: str = "series_id") -> DataFrame:
    """Anomalies by absolute one-step residuals against effect-size truth, per series and threshold."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select(key)
    r = one_step_residuals(lookup_join(df.select(key, "pos", "value"), n, [key], "left_semi"), window, key)
    r = r.withColumn("_r", F.abs("residual"))
    s = r.groupBy(key).agg(F.avg("_r").alias("_a"), F.stddev_pop("_r").alias("_s"))
    o = ordered(r, [key], ["pos"], before=side, after=side + 1)
    left, right = o.rows(-side, -1), o.rows(0, side - 1)
    o = o.with_columns({"_ml": F.avg("value").over(left), "_mr": F.avg("value").over(right), "_pl": F.var_pop("value").over(left), "_pr": F.var_pop("value").over(right), "_ok": (F.count("value").over(left) == side) & (F.count("value").over(o.rows(0, side)) == side + 1)})
    t = o.result()
    t = t.withColumn("y", (F.col("_ok") & (F.abs(F.col("_mr") - F.col("_ml")) / (F.sqrt((F.col("_pl") + F.col("_pr")) / 2.0) + 1e-10) > effect)).cast("int"))
    t = lookup_join(t, s, [key], "left").withColumn("z", (F.col("_r") - F.col("_a")) / (F.col("_s") + 1e-10))
    items = [
        F.struct(
            F.lit(float(c)).alias("threshold"),
            F.count_if(F.col("z") > c).alias("n_flagged"),
            F.sum("y").alias("n_true"),
            F.count_if((F.col("z") > c) & (F.col("y") == 1)).alias("tp"),
        ).alias(f"t{i}")
        for i, c in enumerate(thresholds)
    ]
    g = t.groupBy(key).agg(*items).select(key, F.inline(F.array(*[F.col(f"t{i}") for i in range(len(thresholds))]))).where("n_true > 0")
    tp, f, y = F.col("tp"), F.col("n_flagged"), F.col("n_true")
    return g.withColumns(
        {
            "precision": F.coalesce(F.try_divide(tp, f), F.lit(0.0)),
            "recall": F.try_divide(tp, y),
            "f1": F.coalesce(F.try_divide(F.lit(2.0) * tp, f + y), F.lit(0.0)),
        }
    )


def pooled_lag_model(windows: DataFrame, lags: int, estimator) -> object:
    """Fit one regressor on z-scaled lag rows of all series (features lag_1..lag_n)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    cols = [f"lag_{i}" for i in range(1, lags + 1)]
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), estimator.setLabelCol("value").setFeaturesCol("features")]).fit(windows)


def iterate_lag_model(model, rows: DataFrame, lags: int, horizon: int) -> DataFrame:
    """Forecast ``horizon`` steps: each prediction becomes the newest lag of the next step."""
    cols = [f"lag_{i}" for i in range(1, lags + 1)]
    cur = rows
    steps = []
    for h in range(horizon):
        cur = model.transform(cur).withColumn(f"step_{h + 1}", F.col("prediction")).drop("features", "prediction")
        steps.append(f"step_{h + 1}")
        cur = cur.withColumns({c: F.col(steps[-1]) if i == 0 else F.col(cols[i - 1]) for i, c in enumerate(cols)})
    return cur.withColumn("forecast", F.array(*steps)).drop(*steps)
