"""Splits by time, by group and by stratified draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.functions.random import keyed_uniform
from alertsieve.operators.ordering import before_cut, ordered, rank_cut


def temporal_split(df: DataFrame, order: Sequence[str], shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Cut the rows in time order at int(n*share); ``order`` must be a total order.

    The cut tuples are found by exact selection, so the rows are compared with constants and
    neither sorted nor shuffled.
    """
    n = df.count()
    ranks, acc = [], 0.0
    for s in shares[:-1]:
        acc += s
        ranks.append(int(n * round(acc, 9)))
    cuts = rank_cut(df.select(*order), order, ranks)
    split = None
    for name, cut in zip(names, cuts):
        c = before_cut(order, cut)
        split = F.when(c, name) if split is None else split.when(c, name)
    return df.withColumn("split", split.otherwise(names[-1]) if split is not None else F.lit(names[-1]))


def split_summary(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def leakage_check(df: DataFrame, ts: str, train: str = "train", test: str = "test") -> DataFrame:
    """Latest training time against earliest test time (one row)."""
    s = F.col("split")
    r = df.agg(F.max(F.when(s == train, F.col(ts))).alias("train_max"), F.min(F.when(s == test, F.col(ts))).alias("test_min"))
    return r.withColumn("ok", F.col("train_max") <= F.col("test_min"))


def require_no_leakage(df: DataFrame, ts: str, train: str = "train", test: str = "test") -> DataFrame:
    if not leakage_check(df, ts, train, test).first()["ok"]:
        raise ValueError("training rows are newer than test rows")
    return df


def leave_group_out(df: DataFrame, key: str, group) -> tuple[DataFrame, DataFrame]:
    """(all other groups, the group)."""
    return df.where(~F.col(key).eqNullSafe(F.lit(group))), df.where(F.col(key) == group)


def group_folds(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per group: rows and mean value inside it and in all other groups."""
    from alertsieve.operators.ordering import with_scalars

    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_test"), F.sum(value).alias("_s"))
    g = with_scalars(g, g.agg(F.sum("n_test").alias("_n"), F.sum("_s").alias("_t")))
    return g.select(
        key,
        "n_test",
        (F.col("_n") - F.col("n_test")).alias("n_train"),
        (F.col("_s") / F.col("n_test")).alias("mean_test"),
        F.try_divide(F.col("_t") - F.col("_s"), F.col("_n") - F.col("n_test")).alias("mean_train"),
    )


def stratified(df: DataFrame, cls: str, key: str, share: float, salt: str = "split") -> DataFrame:
    """Exactly int(n*share) rows of each class go to 'train', by hashed order."""
    u = keyed_uniform(F.col(key), salt)
    rows = df.withColumn("_u", u)
    n = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    from alertsieve.operators.lookup import lookup_join

    out = ordered(rows, [cls], ["_u", key]).with_position("_p").result()
    out = lookup_join(out, n, [cls], "left")
    return out.withColumn("split", F.when(F.col("_p") < F.floor(F.col("_n") * F.lit(share)), "train").otherwise("test")).drop("_u", "_n", "_p")


def folds(df: DataFrame, cls: str, key: str, k: int = 5, salt: str = "fold") -> DataFrame:
    """Stratified fold number: hashed order inside the class, modulo k."""
    rows = df.withColumn("_u", keyed_uniform(F.col(key), salt))
    out = ordered(rows, [cls], ["_u", key]).with_position("_p").result()
    return out.withColumn("fold", (F.col("_p") % k).cast("int")).drop("_u", "_p")
