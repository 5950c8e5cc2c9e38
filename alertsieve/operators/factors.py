"""Non-negative factors of a sparse table, by multiplicative updates.

X is about W H with k factors. Rows of W and columns of H are tables with a column for each factor. A round needs two joins
with the entries of X and two k x k matrices (W'W and H H'), which are sums over the tables; zeros of X never appear.
The squared error comes from the same sums. Each round is written, so a lost executor repeats one round only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.functions.random import keyed_uniform
from alertsieve.session import materialise, release

TINY = 1e-12


@dataclass
class Factors:
    """``rows``: (row, f0 ...), ``cols``: (col, f0 ...), and the squared error after each round."""

    rows: DataFrame
    cols: DataFrame
    errors: list[float]


def _observed(side: DataFrame, k: int) -> tuple[DataFrame, list[list[float]], float]:
    """``side``, written; from what was written: the k x k matrix of products of its factors, and the sum of their products with the entries.

    A plain aggregate: once a session has an ``Observation``, the closures of MLlib that hold the session can't be sent to tasks.
    """
    sums = [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]  # k (k + 1) / 2 numbers
    hit = F.sum(sum((F.col(f"f{j}") * F.col(f"a{j}") for j in range(1, k)), F.col("f0") * F.col("a0"))) if "a0" in side.columns else F.sum(F.lit(0.0))
    table = materialise(side)
    r = table.agg(*sums, hit.alias("hit")).first()
    return table, [[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], r["hit"] or 0.0


def _start(ids: DataFrame, name: str, k: int, scale: float, salt: str) -> DataFrame:
    return ids.select(name, *[((keyed_uniform(F.col(name), f"{salt}{j}") + 0.01) * scale).alias(f"f{j}") for j in range(k)])


def _step(entries: DataFrame, this: DataFrame, other: DataFrame, name: str, by: str, gram: list[list[float]], k: int) -> tuple[DataFrame, list[list[float]], float]:
    """``this`` after an update (f) and its products with the entries (a), as ``_observed`` gives them."""
    found = entries.join(other, by).groupBy(name).agg(*[F.sum(F.col("weight") * F.col(f"f{j}")).alias(f"a{j}") for j in range(k)])
    both = this.join(found, name)
    numbers = F.lit([x for r in gram for x in r])  # as one array, so that the code of all rounds is the same

    def bottom(j: int) -> Column:
        total = F.lit(TINY)
        for i in range(k):
            total = total + F.get(numbers, F.lit(i * k + j)) * F.col(f"f{i}")
        return total

    new = [(F.col(f"f{j}") * F.col(f"a{j}") / bottom(j)).alias(f"f{j}") for j in range(k)]
    return _observed(both.select(name, *new, *[f"a{j}" for j in range(k)]), k)


def factorise(weights: DataFrame, k: int, rounds: int = 10, row: str = "id", col: str = "term", weight: str = "weight") -> Factors:
    """Factors of the entries (row, col, weight); weights are 0 or more, equal entries are added up.

    Rows and columns are named by values of any type. The start depends on these names only. The error falls in each
    round. Null names, null and zero weights are left out.
    """
    named = weights.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col(weight).cast("double").alias("weight")).where("row IS NOT NULL AND col IS NOT NULL AND weight > 0")
    entries = materialise(named.groupBy("row", "col").agg(F.sum("weight").alias("weight")))
    size = entries.agg(F.count_distinct("row").alias("m"), F.count_distinct("col").alias("n"), F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q")).first()
    scale = 2.0 * ((size["s"] or 0.0) / max(1, size["m"] * size["n"]) / k) ** 0.5
    rows, inner, _ = _observed(_start(entries.select("row").distinct(), "row", k, scale, "w"), k)
    cols = materialise(_start(entries.select("col").distinct(), "col", k, scale, "h"))
    plain = lambda t, name: t.select(name, *[f"f{j}" for j in range(k)])
    errors = []
    for _ in range(rounds):
        before = cols, rows
        cols, across, _ = _step(entries, plain(cols, "col"), plain(rows, "row"), "col", "row", inner, k)
        rows, inner, hit = _step(entries, plain(rows, "row"), plain(cols, "col"), "row", "col", across, k)
        release(*before)
        errors.append((size["q"] or 0.0) - 2.0 * hit + sum(inner[i][j] * across[i][j] for i in range(k) for j in range(k)))
    return Factors(plain(rows, "row"), plain(cols, "col"), errors)
