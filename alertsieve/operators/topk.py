"""First k rows per key without sorting whole keys.

For small k Spark keeps k rows per key in every task before the shuffle (window group limit). Above
its threshold a salted ranking does the same, so a hot key sends at most k rows per salt onward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """Rows ranked 1..k per key by a total order; the rank is column ``_rank``."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    conf = df.sparkSession.conf
    if k > int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salts = int(conf.get("spark.sql.shuffle.partitions", "200"))
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not c.startswith("_")]), F.lit(salts))
        part = df.withColumn("_salt", salt)
        part = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*by)))
        df = part.where(F.col("_r") <= k).drop("_r", "_salt")
    top = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return top.where(F.col("_rank") <= k)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Column, cols: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, by partial aggregation."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_v")).select(*keys, "_v.*")
