"""Joins against tables that are usually small, and of tables that are both large."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.session import materialise_portions, portion_count

TASK_ROWS = 250_000  # rows of a task, where a task sorts or hashes all its rows


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join ``df`` with ``table`` on ``on``; with ``null_safe`` null keys meet null keys.

    A plain join: adaptive execution broadcasts a side whose measured bytes are few enough, and otherwise splits hot keys.
    """
    if not null_safe:
        return df.join(table, on, how)
    keys = {k: f"_on_{i}" for i, k in enumerate(on)}
    right = table.withColumnsRenamed(keys)
    same = F.lit(True)
    for k, other in keys.items():
        same = same & df[k].eqNullSafe(right[other])
    return df.join(right, same, how).drop(*keys.values())


def task_count(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """How many tasks ``df`` needs if none is to get many more than ``rows`` rows. Counted, so ``df`` should be cheap to read."""
    return math.ceil(df.count() / rows)


def large_join(df: DataFrame, table: DataFrame, on: str, how: str = "inner", rows: int = TASK_ROWS) -> DataFrame:
    """Join ``df`` with ``table`` on one column; the rows come partitioned by it.

    Spark estimates a table by its compressed files, so it would broadcast millions of rows, and adaptive execution makes
    the tasks of a join as large as their compressed bytes allow. Sides of more than ``rows`` rows are cut by the key into
    tasks of about that many rows and merged.
    """
    n = max(task_count(df, rows), task_count(table, rows))
    if n <= 1:
        return df.join(table, on, how)
    return df.repartition(n, on).join(table.repartition(n, on).hint("merge"), on, how)


def written_lookup(df: DataFrame, table: DataFrame, on: str, done: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Written: ``done`` of the left join of ``df`` with ``table`` on one column, portion by portion of its hash.

    Only a portion of ``df`` is shuffled at a time, which takes a fraction of the disk. Both sides are read for each
    portion, so they should be cheap to read.
    """
    n = portion_count(df.sparkSession, df.count())
    mine = lambda t, i: t.where(F.pmod(F.xxhash64(on), F.lit(n)) == i) if n > 1 else t
    return materialise_portions(done(lookup_join(mine(df, i), mine(table, i), [on])) for i in range(n))
