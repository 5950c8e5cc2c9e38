"""Bootstrap statistics by Poisson weights, and McNemar's test.

Every row takes part in resample b with a Poisson(1) weight drawn from a hash of its key and b. A task draws the weights
of some rows and resamples at once as a matrix and multiplies it with the rows' values, so no row is copied: it sends
one row of sums for each resample, whatever its rows.

A ``Metric`` is a set of sums over the rows and a formula over them. ``interval`` of its value over the resamples
gives the confidence interval.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.functions.random import POISSON1_CDF, seed31
from alertsieve.operators.metrics import risk_coverage
from alertsieve.operators.ordering import ordered

BLOCK_ROWS = 65_536  # positions whose weights are drawn in one step
CELLS = 1 << 19  # of a matrix of weights
GROUPS_HELD = 256  # keys whose sums a task holds
_M31 = 1 << 31


@dataclass(frozen=True)
class Metric:
    """``value`` of the sums named in ``sums``; a resample without a value (null) is left out of the interval."""

    sums: dict[str, Column]
    value: Callable[[Callable[[str], Column]], Column]


def accuracy(right: Column) -> Metric:
    return Metric({"n": F.lit(1), "hit": right.cast("int")}, lambda s: F.try_divide(s("hit"), s("n")))


def _cells(y: Column, pred: Column) -> dict[str, Column]:
    return {"tp": ((y == 1) & (pred == 1)).cast("int"), "said": (pred == 1).cast("int"), "pos": (y == 1).cast("int")}


def recall(y: Column, pred: Column) -> Metric:
    return Metric(_cells(y, pred), lambda s: F.coalesce(F.try_divide(s("tp"), s("pos")), F.lit(0.0)))


def precision(y: Column, pred: Column) -> Metric:
    return Metric(_cells(y, pred), lambda s: F.coalesce(F.try_divide(s("tp"), s("said")), F.lit(0.0)))


def f1(y: Column, pred: Column) -> Metric:
    return Metric(_cells(y, pred), lambda s: F.coalesce(F.try_divide(2.0 * s("tp"), s("said") + s("pos")), F.lit(0.0)))


def macro_f1(label: Column, pred: Column, classes: Sequence) -> Metric:
    """Mean F1 of the classes that a resample holds as label or prediction."""
    sums = {}
    for i, c in enumerate(classes):
        sums |= {f"tp{i}": ((label == F.lit(c)) & (pred == F.lit(c))).cast("int"), f"all{i}": (label == F.lit(c)).cast("int") + (pred == F.lit(c)).cast("int")}

    def value(s: Callable[[str], Column]) -> Column:
        total, seen = F.lit(0.0), F.lit(0)
        for i in range(len(classes)):
            total = total + F.coalesce(F.try_divide(2.0 * s(f"tp{i}"), s(f"all{i}")), F.lit(0.0))
            seen = seen + (s(f"all{i}") > 0).cast("int")
        return F.try_divide(total, seen)

    return Metric(sums, value)


def cascade_metrics(right: Column, automated: Column, majority: Column) -> dict[str, Metric]:
    """Coverage, accuracy of the automated rows, accuracy of the majority class (``majority``: the row has it), and the lift over it."""
    auto = automated.cast("int")
    sums = {"n": F.lit(1), "auto": auto, "hit": auto * right.cast("int"), "major": majority.cast("int")}
    return {
        "accuracy": Metric(sums, lambda s: F.try_divide(s("hit"), s("auto"))),
        "coverage": Metric(sums, lambda s: F.try_divide(s("auto"), s("n"))),
        "majority_baseline": Metric(sums, lambda s: F.try_divide(s("major"), s("n"))),
        "accuracy_lift": Metric(sums, lambda s: F.try_divide(s("hit"), s("auto")) - F.try_divide(s("major"), s("n"))),
    }


_CUTS = [math.ceil(c * _M31) for c in POISSON1_CDF]


def draws(seed: np.ndarray, low: int, high: int) -> np.ndarray:
    """Weights of rows with these 31-bit seeds in the resamples from ``low`` to below ``high``: rows x resamples."""
    x = (seed.astype(np.int64)[:, None] + np.arange(low, high, dtype=np.int64) * 40503) % _M31
    for _ in range(2):
        x = (x * 1103515245 + 12345) % _M31
        x ^= x >> 16
        x = (x * 1540483477) % _M31
        x ^= x >> 13
    weights = np.zeros(x.shape, np.int8)
    for c in _CUTS:
        weights += x >= c
    return weights


def weighted_sums(df: DataFrame, key: Column, sums: dict[str, Column], b: int, salt: str = "boot", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, b, <name>`` = weighted sum of each column in resample b."""
    keys, names = list(keys), list(sums)
    rows = df.select(*keys, seed31(key, salt).alias("_s"), *[c.cast("double").alias(n) for n, c in sums.items()])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema.fields)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            made = pd.DataFrame({"b": np.tile(np.arange(1, b + 1), len(held))})
            values = np.concatenate(list(held.values()))
            for j, n in enumerate(names):
                made[n] = values[:, j]
            at = np.repeat(np.arange(len(held)), b)
            for i, k in enumerate(keys):
                made.insert(i, k, pd.Series([g[i] for g in held], dtype=object).iloc[at].to_numpy())
            return made

        for pdf in batches:
            parts = [((), pdf)] if not keys else pdf.groupby(keys if len(keys) > 1 else keys[0], dropna=False, sort=False)
            for name, part in parts:
                group = tuple(None if pd.isna(v) else v for v in (name if isinstance(name, tuple) else (name,)))
                total = held.setdefault(group, np.zeros((b, len(names))))
                # nulls add nothing, as in a sum
                seed, values = part["_s"].to_numpy(np.int64), np.nan_to_num(part[names].to_numpy(float))
                step = max(1, CELLS // b)
                for at in range(0, len(seed), step):
                    total += draws(seed[at : at + step], 1, b + 1).T.astype(float) @ values[at : at + step]
            if len(held) > GROUPS_HELD:
                yield out()
                held = {}
        if held:
            yield out()

    parts = rows.where("_s IS NOT NULL").mapInPandas(add, f"{fields}b long, " + ", ".join(f"`{n}` double" for n in names))
    return parts.groupBy(*keys, "b").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap(df: DataFrame, key: Column, metrics: dict[str, Metric], b: int = 1000, keys: Sequence[str] = (), ci: float = 0.95) -> DataFrame:
    """``keys, metric, mean, lower, upper, std`` of any metrics, all over the same resamples."""
    sums = {f"{m}_{n}": c for m, x in metrics.items() for n, c in x.sums.items()}
    boot = weighted_sums(df, key, sums, b, keys=keys)
    values = [F.struct(F.lit(m).alias("metric"), x.value(lambda n, m=m: F.col(f"{m}_{n}")).cast("double").alias("_v")) for m, x in metrics.items()]
    long = boot.select(*keys, F.inline(F.array(*values)))
    found = interval(long, F.col("_v"), [*keys, "metric"], ci)
    spread = long.groupBy(*keys, "metric").agg(F.stddev_pop("_v").alias("std"))
    same = [found[k].eqNullSafe(spread[k]) for k in (*keys, "metric")]
    return found.join(spread, same).select(*[found[c] for c in found.columns], "std")


def weighted_cells(df: DataFrame, sums: dict[str, Column], b: int, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """The same statistic from counts: rows with equal values share one Poisson(n) weight.

    A sum of n independent Poisson(1) weights is Poisson(n), so the rows can be counted first and
    only the few distinct value combinations are drawn ``b`` times. For statistics with few values.
    """
    cells = df.select(*keys, *[c.cast("double").alias(n) for n, c in sums.items()]).groupBy(*keys, *sums).agg(F.count(F.lit(1)).alias("_n"))
    drawn = cells.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(b).cast("long"))).alias("b"))

    @F.pandas_udf("double")
    def poisson(n: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([float(np.random.default_rng(abs(int(x)) + seed).poisson(m)) for m, x in zip(n, h)])

    drawn = drawn.withColumn("_w", poisson("_n", F.xxhash64(*keys, *sums, "b")))
    return drawn.groupBy(*keys, "b").agg(*[F.sum(F.col(n) * F.col("_w")).alias(n) for n in sums])


def interval(boot: DataFrame, stat: Column, keys: Sequence[str] = (), ci: float = 0.95) -> DataFrame:
    """Mean and percentile interval of a statistic over the resamples (b rows per key)."""
    s = boot.select(*keys, stat.alias("_v"))
    return s.groupBy(*keys).agg(
        F.avg("_v").alias("mean"),
        F.percentile("_v", (1 - ci) / 2).alias("lower"),
        F.percentile("_v", (1 + ci) / 2).alias("upper"),
    )


def _one(df: DataFrame, key: Column | None, m: Metric, b: int, keys: Sequence[str] = ()) -> DataFrame:
    w = weighted_cells(df, m.sums, b, keys=keys) if key is None else weighted_sums(df, key, m.sums, b, keys=keys)
    return interval(w, m.value(F.col), keys)


def bootstrap_accuracy(df: DataFrame, key: Column | None, right: Column, b: int = 1000, keys: Sequence[str] = ()) -> DataFrame:
    """Interval of the accuracy; without a ``key`` the rows are counted first (see ``weighted_cells``)."""
    return _one(df, key, accuracy(right), b, keys)


def bootstrap_recall(df: DataFrame, key: Column | None, y: Column, pred: Column, b: int = 1000) -> DataFrame:
    return _one(df, key, recall(y, pred), b)


def bootstrap_curve(df: DataFrame, key: Column, right: Column, conf: Column, thresholds: Sequence[float], b: int = 1000) -> DataFrame:
    """Interval of coverage and accuracy at each threshold. Rows are summed by the number of thresholds that they reach."""
    ts = sorted(float(t) for t in thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: t <= conf))
    bins = weighted_sums(df.withColumn("_bin", reached), key, {"n": F.lit(1), "hit": right.cast("int")}, b, keys=["_bin"])
    at = lambda c, i: F.sum(F.when(F.col("_bin") > i, F.col(c)).otherwise(0.0))
    wide = bins.groupBy("b").agg(F.sum("n").alias("total"), *[F.struct(F.lit(t).alias("threshold"), at("n", i).alias("n"), at("hit", i).alias("hit")).alias(f"_{i}") for i, t in enumerate(ts)])
    g = wide.select("b", "total", F.inline(F.array(*[F.col(f"_{i}") for i in range(len(ts))])))
    cov = interval(g, F.try_divide("n", "total"), ["threshold"]).select("threshold", *[F.col(c).alias(f"coverage_{c}") for c in ("mean", "lower", "upper")])
    acc = interval(g, F.try_divide("hit", "n"), ["threshold"]).select("threshold", *[F.col(c).alias(f"accuracy_{c}") for c in ("mean", "lower", "upper")])
    return cov.join(acc, "threshold")


def bootstrap_augrc(df: DataFrame, err: Column, conf: Column, b: int = 1000, key: str = "id") -> DataFrame:
    """Interval of the area under the risk-coverage curve.

    A resample repeats a row w times in place, so with W and E the weights and weighted errors
    before the row, its w copies add w*E + err*w*(w+1)/2 to the sum of running errors. Rows of
    one error-free or all-error run between two positions differ only in W and E, hence the
    weights are first summed per block of positions, and blocks are then combined in order.
    """
    r = risk_coverage(df, err, conf, key)
    rows = r.select(F.floor(F.col("pos") / BLOCK_ROWS).alias("blk"), "pos", "err", seed31(F.col("_id"), "boot").alias("_s"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        seed, e = pdf["_s"].to_numpy(np.int64), pdf["err"].to_numpy(np.int64)[:, None]
        out, step = [], max(1, CELLS // len(seed))
        for low in range(1, b + 1, step):
            high = min(low + step, b + 1)
            w = draws(seed, low, high).astype(np.int64)
            we = w * e
            before = np.cumsum(we, axis=0) - we
            area = (w * before + e * w * (w + 1) // 2).sum(axis=0)
            first = np.where(w.any(axis=0), e[np.argmax(w > 0, axis=0), 0], -1)
            out.append(pd.DataFrame({"b": np.arange(low, high), "blk": int(pdf["blk"].iloc[0]), "w": w.sum(axis=0), "e": we.sum(axis=0), "area": area, "first": first}))
        return pd.concat(out)

    parts = rows.groupBy("blk").applyInPandas(block, "b long, blk long, w long, e long, area long, first long")
    run = ordered(parts, ["b"], ["blk"]).with_running({"ce": ("sum", F.col("e"))}).result()
    tot = run.groupBy("b").agg(
        F.sum("w").alias("n"),
        F.sum("e").alias("errors"),
        F.sum(F.col("area") + (F.col("ce") - F.col("e")) * F.col("w")).alias("area"),
        F.min_by("first", F.when(F.col("first") >= 0, F.col("blk"))).alias("first"),
    )
    n = F.col("n").cast("double")
    return interval(tot, F.try_divide(F.col("area") - (F.col("first") + F.col("errors")) / 2.0, n * n))


def mcnemar(df: DataFrame, right_a: Column, right_b: Column) -> DataFrame:
    """McNemar's test with continuity correction (one row)."""
    r = df.agg(F.count_if(right_a & ~right_b).alias("a_only"), F.count_if(~right_a & right_b).alias("b_only"))
    b, c = F.col("a_only"), F.col("b_only")
    stat = F.coalesce(F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2.0)), b + c), F.lit(0.0))

    @F.pandas_udf("double")
    def p_value(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2.0)))

    r = r.withColumn("statistic", stat)
    r = r.withColumn("p_value", F.when(b + c == 0, F.lit(1.0)).otherwise(p_value("statistic")))
    return r.withColumn("significant", F.col("p_value") < 0.05)
