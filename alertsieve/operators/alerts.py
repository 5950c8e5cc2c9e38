"""Alerts and their groups: roll-ups, first alert of a group, related groups, matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.operators.lookup import TASK_ROWS, large_join, lookup_join, task_count
from alertsieve.operators.ordering import ordered


def group_rollup(df: DataFrame, key: str, numeric: Sequence[str], flags: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Group features: moments of numbers, sums of flags, distinct counts and most frequent values."""
    aggs = [F.count(F.lit(1)).alias("group_size")]
    for c in numeric:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"), F.stddev_samp(c).alias(f"{c}_std")]
    for c in flags:
        aggs += [F.sum(F.col(c).cast("int")).alias(f"{c}_sum"), F.avg(F.col(c).cast("int")).alias(f"{c}_ratio")]
    out = df.groupBy(key).agg(*aggs)
    for c in dims:
        per = df.groupBy(key, c).agg(F.count(F.lit(1)).alias("_n"))
        top = per.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_unique_{c}"), F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(f"dominant_{c}"))
        out = out.join(top, key, "left")
    return out


def linked_components(links: DataFrame, components: DataFrame, key: str = "summary_id", on: str = "series_id", component: str = "component", rows: int = TASK_ROWS) -> DataFrame:
    """Per component: groups with a link to it and links.

    Links are counted per component and group first, in tasks of about ``rows`` links. ``links`` should be written.
    """
    j = large_join(links, components, on, rows=rows).select(component, key)
    n = task_count(links, rows)
    if n > 1:
        j = j.repartition(n, component, key)
    per = j.groupBy(component, key).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(component).agg(F.count(key).alias("n_summaries"), F.sum("_n").alias("n_links"))


def mark_primary(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``is_primary`` for the first alert of each group, ``is_downstream`` for the others."""
    out = ordered(df, [key], list(order)).with_position("_p").result()
    return out.withColumns({"is_primary": F.col("_p") == 0, "is_downstream": F.col("_p") > 0}).drop("_p")


def downstream_distance(df: DataFrame, key: str, order: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Euclidean distance of the later alerts of a group to its first one (null features skipped).

    The first alert is found by a partial aggregate. All rows are compared with it, and its own
    zero distance is taken out of the sums.
    """
    first = df.groupBy(key).agg(F.min_by(F.struct(*features), F.struct(*order)).alias("_f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    j = lookup_join(df.select(key, *order, *[c for c in features if c not in order]), first, [key], "inner")
    sq = None
    for c in features:
        d = F.coalesce(F.pow(F.col(c) - F.col(f"_f.{c}"), F.lit(2.0)), F.lit(0.0))
        sq = d if sq is None else sq + d
    j = j.withColumn("_d", F.sqrt(sq))
    g = j.groupBy(key).agg(F.max("_n").alias("_n"), F.sum("_d").alias("_s"), F.max("_d").alias("max_distance"), F.min(F.when(F.col("_d") > 0, F.col("_d"))).alias("_m"), F.count_if(F.col("_d") == 0).alias("_z"))
    return g.select(
        key,
        (F.col("_n") - 1).alias("n_downstream"),
        (F.col("_s") / (F.col("_n") - 1)).alias("avg_distance"),
        F.when(F.col("_z") > 1, 0.0).otherwise(F.col("_m")).alias("min_distance"),
        "max_distance",
    )


def cluster_coherence(df: DataFrame, key: str, cluster: str) -> DataFrame:
    """Share of the most frequent cluster in groups of two or more."""
    per = df.groupBy(key, cluster).agg(F.count(F.lit(1)).alias("_n"))
    g = per.groupBy(key).agg(F.sum("_n").alias("n_alerts"), F.count(F.lit(1)).alias("n_clusters"), F.max("_n").alias("_top")).where("n_alerts > 1")
    return g.select(key, "n_alerts", "n_clusters", (F.col("_top") / F.col("n_alerts")).alias("coherence"), (F.col("n_clusters") == 1).alias("all_same"))


def relation_stats(df: DataFrame, key: str, related: str) -> DataFrame:
    """Sizes of alert groups and the share with a related group (one row)."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count(related).alias("_r"))
    return g.agg(
        F.sum("_n").alias("total_alerts"),
        F.count(F.lit(1)).alias("total_summaries"),
        F.avg("_n").alias("avg_alerts"),
        F.max("_n").alias("max_alerts"),
        F.count_if(F.col("_n") == 1).alias("single_alert_summaries"),
        F.count_if(F.col("_n") > 1).alias("multi_alert_summaries"),
        F.sum("_r").alias("alerts_with_related"),
        (F.sum("_r") / F.sum("_n")).alias("related_ratio"),
    )


def alert_graph(df: DataFrame, alert: str, key: str, related: str) -> DataFrame:
    """Edges ``group_key, alert`` of groups with more than one alert, by own and by related group."""
    own = F.concat(F.lit("summary_"), F.col(key).cast("string"))
    rel = F.when(F.col(related).isNotNull() & (F.col(related) != F.col(key)), F.concat(F.lit("related_"), F.col(related).cast("string")))
    edges = df.select(F.explode(F.array_compact(F.array(own, rel))).alias("group_key"), F.col(alert).alias("alert_id"))
    many = edges.groupBy("group_key").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return lookup_join(edges, many, ["group_key"], "inner")


def related_pairs(df: DataFrame, key: str, related: str) -> DataFrame:
    """One hop: groups whose related group exists."""
    left = df.select(F.col(key).alias("summary_id"), F.col(related).alias("related_id")).where("related_id is not null and related_id <> summary_id").distinct()
    return left.join(df.select(F.col(key).alias("related_id")).distinct(), "related_id", "left_semi")


def related_chains(df: DataFrame, key: str, related: str, max_depth: int = 5) -> DataFrame:
    """The path of related groups from each group, at most ``max_depth`` hops, without cycles.

    Each group names one related group, so a hop is one join that keeps the row count.
    """
    nxt = df.select(F.col(key).alias("_last"), F.col(related).alias("_next")).where("_next is not null and _next <> _last").groupBy("_last").agg(F.min("_next").alias("_next"))
    nxt = nxt.withColumn("_ended", F.lit(0))
    ended = F.when(F.col("_last").isNull(), F.pmod(F.xxhash64("summary_id"), F.lit(1 << 20)).cast("int") + 1).otherwise(F.lit(0))  # spreads the ended chains
    cur = df.select(F.col(key).alias("summary_id")).distinct()
    cur = cur.withColumns({"path": F.array("summary_id"), "_last": F.col("summary_id")})
    for _ in range(max_depth):
        cur = cur.withColumn("_ended", ended).join(nxt, ["_last", "_ended"], "left").drop("_ended")
        grow = F.col("_next").isNotNull() & ~F.array_contains("path", F.col("_next"))
        cur = cur.withColumns({"path": F.when(grow, F.array_append("path", F.col("_next"))).otherwise(F.col("path")), "_last": F.when(grow, F.col("_next"))})
        cur = cur.drop("_next")
    return cur.drop("_last").where(F.size("path") > 1)


# --- matching alerts to series points -----------------------------------------------------------


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, right_order: str, cols: Sequence[str], left_id: str) -> DataFrame:
    """For each left row the last right row of its key with ts <= the left ts.

    Both sides form one ordered stream and the last right row is carried forward, so no pair of
    rows is ever built. A right row sorts before a left row of the same time.
    """
    payload = F.struct(F.col(ts).alias("_rts"), *[F.col(c) for c in cols])
    r = right.select(key, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col(right_order).cast("long").alias("_o"), payload.alias("_p"), F.lit(None).cast(left.schema[left_id].dataType).alias(left_id))
    l = left.select(key, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.col(left_id).cast("long").alias("_o"), F.lit(None).cast(r.schema["_p"].dataType).alias("_p"), left_id)
    o = ordered(r.unionByName(l), [key], ["_t", "_side", "_o"]).with_running({"_m": ("last", F.col("_p"))}).result()
    return o.where("_side = 1").select(left_id, key, F.col("_t").alias(ts), F.col("_m._rts").alias("match_ts"), *[F.col(f"_m.{c}").alias(f"match_{c}") for c in cols])


def best_match(alerts: DataFrame, points: DataFrame, key: str, equal: Sequence[tuple[str, str]], value: str, tolerance: float = 0.01) -> DataFrame:
    """Position of the alert in its series by the first rule that hits.

    ``equal`` lists (alert column, point column) pairs tried in order, then the point with the
    nearest value within ``tolerance`` of the alert's value. Alerts have a unique ``id``, points
    a ``pos``. Every rule is an equi-join on one row per (series, key value), and the nearest
    value is read from a merge in value order, so hot series do not multiply.
    """
    out = alerts
    for i, (a, p) in enumerate(equal):
        first = points.where(F.col(p).isNotNull()).groupBy(F.col(key), F.col(p).alias(a)).agg(F.min("pos").alias(f"_p{i}"))
        out = out.join(first, [key, a], "left")
    pts = points.groupBy(key, F.col("value").alias("_v")).agg(F.min("pos").alias("pos"))
    pts = pts.select(key, "_v", F.lit(0).alias("_side"), F.lit(-1).cast("long").alias("id"), F.struct(F.col("_v").alias("v"), "pos").alias("_p"))
    al = alerts.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), F.lit(1).alias("_side"), "id", F.lit(None).cast(pts.schema["_p"].dataType).alias("_p"))
    both = pts.unionByName(al)
    lo = ordered(both, [key], ["_v", "_side", "id"]).with_running({"_m": ("last", F.col("_p"))}).result().where("_side = 1").select("id", F.col("_m").alias("_lo"))
    hi = ordered(both, [key], [F.desc("_v"), "_side", "id"]).with_running({"_m": ("last", F.col("_p"))}).result().where("_side = 1").select("id", F.col("_m").alias("_hi"))
    out = out.join(lo, "id", "left").join(hi, "id", "left")

    def cand(s: str) -> Column:
        return F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(f"{s}.v") - F.col(value)).alias("d"), F.col(f"{s}.pos").alias("pos")))

    near = F.least(cand("_lo"), cand("_hi"))
    near_pos = F.when(near["d"] < F.lit(tolerance) * F.abs(F.col(value)), near["pos"])
    hits = [F.col(f"_p{i}") for i in range(len(equal))] + [near_pos]
    rule = None
    for i, h in enumerate(hits):
        rule = F.when(h.isNotNull(), F.lit(i)) if rule is None else rule.when(h.isNotNull(), F.lit(i))
    return out.withColumns({"pos": F.coalesce(*hits), "rule": rule}).drop("_lo", "_hi", *[f"_p{i}" for i in range(len(equal))])


def match_funnel(alerts: DataFrame, matched: DataFrame, points: DataFrame, key: str, min_window: int = 5) -> DataFrame:
    """Alerts with a series, with a position, with enough points before it (one row)."""
    has = matched.join(points.select(key).distinct().withColumn("_s", F.lit(True)), key, "left")
    return has.agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.count_if(F.col("_s")).alias("n_series_found"),
        F.count_if(F.col("pos").isNotNull()).alias("n_indexed"),
        F.count_if(F.col("pos") >= min_window).alias("n_valid"),
        F.count_if(F.col("pos").isNull() | (F.col("pos") < min_window)).alias("n_skipped"),
    )
