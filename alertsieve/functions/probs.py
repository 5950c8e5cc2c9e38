"""Probability vectors, conformal scores and prediction sets as Columns.

Everything is built from array functions, so it stays inside generated code and needs no
sort of rows and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    The optimiser may copy a column's expression to every place that names it, for instance when a
    filter moves below a projection; a lambda variable stays one value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def confidence(p: Column) -> Column:
    return F.array_max(p)


def normalised(p: Column) -> Column:
    """Vector divided by its sum."""
    return let(p, lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(v, lambda x: x / t)))


def predicted(p: Column) -> Column:
    """Index of the largest probability, lowest index on ties."""
    return let(p, lambda v: F.array_position(v, F.array_max(v)).cast("int") - 1)


def binary_confidence(p1: Column) -> Column:
    return F.greatest(p1, F.lit(1.0) - p1)


def binary_predicted(p1: Column) -> Column:
    return (p1 >= 0.5).cast("int")


def ranked(p: Column) -> Column:
    """array<struct<neg, cls, p>> by probability descending, class ascending."""
    return F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("neg"), i.cast("int").alias("cls"), v.alias("p"))))


def true_rank(p: Column, label: Column) -> Column:
    """1-based rank of the label in ``ranked`` order."""
    return let(p, lambda v: let(F.get(v, label), lambda py: F.size(_ahead(v, py, label))))


def _ahead(p: Column, py: Column, label: Column) -> Column:
    """Probabilities at or before the label in rank order."""
    return F.filter(p, lambda v, i: (v > py) | ((v == py) & (i <= label)))


def aps_score(p: Column, label: Column, u: Column) -> Column:
    return raps_score(p, label, u, lam=0.0)


def raps_score(p: Column, label: Column, u: Column, lam: float = 0.01, k_reg: int = 5) -> Column:
    """Probability mass down to the label plus the rank penalty, minus u times the label's share."""

    def score(py: Column, ahead: Column) -> Column:
        mass = F.aggregate(ahead, F.lit(0.0), lambda a, v: a + v)
        penalty = F.lit(lam) * F.greatest(F.lit(0), F.size(ahead) - k_reg)
        return mass + penalty - u * (py + penalty)

    return let(p, lambda v: let(F.get(v, label), lambda py: let(_ahead(v, py, label), lambda ahead: score(py, ahead))))


def set_size(p: Column, q: Column, lam: float = 0.01, k_reg: int = 5) -> Column:
    """Classes taken in rank order until mass plus penalty reaches q (never empty)."""
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("r"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        m = a["m"] + x["p"]
        r = a["r"] + 1
        below = m + F.lit(lam) * F.greatest(F.lit(0), r - k_reg) < q
        return F.struct(m.alias("m"), r.alias("r"), (a["n"] + below.cast("int")).alias("n"))

    return F.aggregate(ranked(p), start, step, lambda a: F.least(a["n"] + 1, a["r"]))


def prediction_set(p: Column, size: Column) -> Column:
    """The first ``size`` classes in rank order, array<int>."""
    return F.transform(F.slice(ranked(p), F.lit(1), size), lambda x: x["cls"])


def label_threshold_set(p: Column, q: Column) -> Column:
    """Classes with probability >= 1 - q; may be empty."""
    keep = F.filter(F.transform(p, lambda v, i: F.struct(i.cast("int").alias("i"), v.alias("v"))), lambda x: x["v"] >= F.lit(1.0) - q)
    return F.transform(keep, lambda x: x["i"])


def pad(p: Column, k: int) -> Column:
    """Extend a vector with zeros to k classes."""
    return F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(k) - F.size(p))))


def from_label(label: Column, k: int, top: float = 0.80) -> Column:
    """A vector with ``top`` on the label and the rest shared; uniform if there is no label."""
    known = label.isNotNull() & label.between(0, k - 1)
    rest = (1.0 - top) / (k - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.when(~known, F.lit(1.0 / k)).when(i == label, F.lit(top)).otherwise(F.lit(rest)),
    )


def margin(p: Column) -> Column:
    """Difference of the two largest probabilities."""
    return let(F.sort_array(p, asc=False), lambda s: F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.log(v)).otherwise(0.0))
