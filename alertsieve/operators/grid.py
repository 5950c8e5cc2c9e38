"""Sums of rows at or above each threshold of a grid.

Rows are first summed per (key, number of thresholds reached); only that small table meets
the grid. The grid therefore never multiplies the input rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def steps(start: float, stop: float, step: float) -> list[float]:
    """start, start+step, ... below stop, rounded to 4 digits."""
    n = 0
    out = []
    while round(start + n * step, 6) < stop - 1e-9:
        out.append(round(start + n * step, 4))
        n += 1
    return out


def grid_sums(df: DataFrame, keys: Sequence[str], score: Column, thresholds: Sequence[float], sums: dict[str, Column]) -> DataFrame:
    """``keys, threshold, <name> (rows with score >= threshold), total_<name>``."""
    ts = sorted(float(t) for t in thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: t <= score))
    pre = df.groupBy(*keys, reached.alias("_bin")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    grid = F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(t).alias("threshold")) for i, t in enumerate(ts)])
    wide = pre.select(*keys, "_bin", *sums, F.inline(grid))
    out = wide.groupBy(*keys, "threshold").agg(
        *[F.sum(F.when(F.col("_bin") >= F.col("_i"), F.col(n)).otherwise(0)).alias(n) for n in sums],
        *[F.sum(n).alias(f"total_{n}") for n in sums],
    )
    return out
