"""Registration of queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles so that the order of float sums does not show."""
    return df.select(
        *[F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return add


def R(expr: str) -> str:
    """The SQL side of ``tidy`` (adding 0.0 turns -0.0 into 0.0)."""
    return f"(round(({expr})::DOUBLE, {DIGITS}) + 0.0)"
