"""Profiles and quality of cluster labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.operators.ordering import with_scalars


def cluster_profiles(df: DataFrame, cluster: str, numeric: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Size, mean/std of numbers, most frequent and distinct values of names per cluster."""
    df = df.where(F.col(cluster) >= 0)
    aggs = [F.count(F.lit(1)).alias("size")]
    for c in numeric:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    out = df.groupBy(cluster).agg(*aggs)
    for c in names:
        per = df.groupBy(cluster, c).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(per.groupBy(cluster).agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(f"{c}_mode"), F.count(F.lit(1)).alias(f"{c}_unique")), cluster)
    return out


def _entropy_sum(n: Column, total: Column) -> Column:
    p = n / total
    return F.sum(-p * F.ln(p))


def external_quality(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Homogeneity, completeness, V, adjusted Rand and NMI from the contingency table (one row)."""
    c = df.groupBy(truth, cluster).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").cast("double").alias("total"), F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias("nij"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"))

    def margin(col: str, tag: str) -> DataFrame:
        m = with_scalars(c.groupBy(col).agg(F.sum("n").alias("n")), tot.select("total"))
        return m.agg(_entropy_sum(F.col("n"), F.col("total")).alias(f"h{tag}"), F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias(f"c{tag}"))

    one = with_scalars(with_scalars(tot, margin(truth, "t")), margin(cluster, "k"))
    n, ht, hk = F.col("total"), F.col("ht"), F.col("hk")
    joint = F.ln(n) - F.col("nlogn") / n
    mi = ht + hk - joint
    h = F.when(ht == 0, 1.0).otherwise(mi / F.when(ht == 0, 1.0).otherwise(ht))
    k = F.when(hk == 0, 1.0).otherwise(mi / F.when(hk == 0, 1.0).otherwise(hk))
    pairs = n * (n - 1) / 2.0
    expected = F.col("ct") * F.col("ck") / pairs
    ari = F.coalesce(F.try_divide(F.col("nij") - expected, (F.col("ct") + F.col("ck")) / 2.0 - expected), F.lit(1.0))
    return one.select(
        h.alias("homogeneity"),
        k.alias("completeness"),
        F.coalesce(F.try_divide(F.lit(2.0) * h * k, h + k), F.lit(0.0)).alias("v_measure"),
        ari.alias("ari"),
        F.coalesce(F.try_divide(mi, (ht + hk) / 2.0), F.lit(1.0)).alias("nmi"),
    )


def internal_quality(df: DataFrame, cluster: str, v: str = "v") -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin scores from centroids (one row); noise is left out."""
    vec = array_to_vector(F.col(v).cast("array<double>"))
    m = df.where(F.col(cluster) >= 0).groupBy(cluster).agg(Summarizer.metrics("mean", "variance", "count").summary(vec).alias("_m"))
    n = F.col("_m.count")
    var = F.aggregate(vector_to_array("_m.variance"), F.lit(0.0), lambda s, x: s + x)
    cent_a = m.select(cluster, n.alias("n"), F.when(n > 1, var * (n - 1) / n).otherwise(0.0).alias("spread"), vector_to_array("_m.mean").alias("c"))
    dist = F.sqrt(F.aggregate(F.zip_with(F.col(v).cast("array<double>"), F.col("c"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    mean_d = df.where(F.col(cluster) >= 0).join(cent_a.select(cluster, "c"), cluster).groupBy(cluster).agg(F.avg(dist).alias("s"))
    k = cent_a.join(mean_d, cluster)
    one = k.agg(F.sort_array(F.collect_list(F.struct(cluster, "n", "spread", "c", "s"))).alias("k"))  # one entry per cluster

    def gap(a: Column, b: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a["c"], b["c"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    worst = F.transform("k", lambda a: F.array_max(F.transform(F.filter("k", lambda b: b[cluster] != a[cluster]), lambda b: F.try_divide(a["s"] + b["s"], gap(a, b)))))
    db = F.aggregate(worst, F.lit(0.0), lambda s, x: s + x) / F.size("k")
    n = F.aggregate("k", F.lit(0.0), lambda s, x: s + x["n"])
    within = F.aggregate("k", F.lit(0.0), lambda s, x: s + x["n"] * x["spread"])
    dims = F.size(F.get(F.col("k"), F.lit(0))["c"])
    grand = F.transform(F.sequence(F.lit(0), dims - 1), lambda d: F.aggregate("k", F.lit(0.0), lambda s, x: s + x["n"] * F.get(x["c"], d)) / n)
    one = one.withColumn("g", grand)
    between = F.aggregate("k", F.lit(0.0), lambda s, x: s + x["n"] * F.aggregate(F.zip_with(x["c"], F.col("g"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, y: t + y))
    size = F.size("k")
    return one.select(
        size.alias("n_clusters"),
        F.try_divide(between / (size - 1), within / (n - size)).alias("calinski_harabasz"),
        db.alias("davies_bouldin"),
    )


def noise_share(df: DataFrame, cluster: str) -> DataFrame:
    return df.agg(F.count_if(F.col(cluster) < 0).alias("n_noise"), F.avg((F.col(cluster) < 0).cast("int")).alias("noise_ratio"), F.count_distinct(F.when(F.col(cluster) >= 0, F.col(cluster))).alias("n_clusters"))


def standout_features(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """The feature whose cluster mean is farthest from the overall mean."""
    long = df.select(cluster, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])))
    per = long.groupBy(cluster, "feature").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    glob = per.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("g"))
    d = per.join(F.broadcast(glob), "feature").withColumn("deviation", F.col("s") / F.col("n") - F.col("g"))
    return d.groupBy(cluster).agg(F.min_by(F.struct("feature", "deviation"), F.struct(-F.round(F.abs("deviation"), 9), F.col("feature"))).alias("b")).select(cluster, "b.*")
