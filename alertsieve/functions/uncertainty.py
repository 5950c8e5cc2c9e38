"""Uncertainty of Dirichlet concentrations, and the normal quantile, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digamma(x: Column) -> Column:
    """Digamma for x > 0: shift by 10, then the asymptotic series (error below 1e-12)."""
    y = x + 10.0
    shift = None
    for i in range(10):
        t = F.lit(1.0) / (x + float(i))
        shift = t if shift is None else shift + t
    r = F.lit(1.0) / (y * y)
    tail = r * (F.lit(1 / 12) - r * (F.lit(1 / 120) - r * (F.lit(1 / 252) - r * (F.lit(1 / 240) - r * F.lit(1 / 132)))))
    return F.ln(y) - F.lit(0.5) / y - tail - shift


def digamma_sql(x: str) -> str:
    y = f"({x}+10.0::DOUBLE)"
    shift = "+".join(f"1.0::DOUBLE/({x}+{i})" for i in range(10))
    r = f"(1.0::DOUBLE/({y}*{y}))"
    return f"(ln({y}) - 0.5::DOUBLE/{y} - {r}*(1.0::DOUBLE/12 - {r}*(1.0::DOUBLE/120 - {r}*(1.0::DOUBLE/252 - {r}*(1.0::DOUBLE/240 - {r}/132)))) - ({shift}))"


def dirichlet(alpha: Column, total: Column) -> dict[str, Column]:
    """Entropy of the mean, expected entropy and their difference; ``total`` is sum(alpha)."""
    entropy = F.aggregate(alpha, F.lit(0.0), lambda a, x: a - x / total * F.ln(x / total + F.lit(1e-10)))
    inner = F.aggregate(alpha, F.lit(0.0), lambda a, x: a - x / total * digamma(x + 1.0))
    aleatoric = inner + digamma(total + 1.0)
    return {"total": entropy, "aleatoric": aleatoric, "epistemic": entropy - aleatoric}
