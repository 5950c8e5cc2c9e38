"""Joins, positions and models that have to stay bounded on large tables; the rows are made here."""

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from alertsieve.operators import alerts as al
from alertsieve.operators import models as md
from alertsieve.operators.lookup import large_join
from alertsieve.operators.ordering import ordered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_sides_are_merged_in_bounded_tasks(spark):
    """F8, F15: Spark broadcast the side whose files look small, and made a few large tasks"""
    left = spark.createDataFrame([(i % 40 if i % 9 else None, i) for i in range(200)], "k long, x long")
    right = spark.createDataFrame([(i % 30, str(i)) for i in range(45)] + [(None, "n")], "k long, y string")
    want = left.join(right, "k")
    got = large_join(left, right, "k", rows=20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "SortMergeJoin" in plan(got) and "Broadcast" not in plan(got)
    assert got.rdd.getNumPartitions() == 10
    assert large_join(left, right, "k").rdd.getNumPartitions() != 10


def test_linked_components_count_groups_and_links(spark):
    """the same counts as a distinct count, with and without bounded tasks"""
    links = spark.createDataFrame([(i % 13 if i % 5 else None, i % 7) for i in range(300)], "summary_id long, series_id long").distinct()
    parts = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, None), (3, "b")], "series_id long, component string")
    want = links.join(parts, "series_id").groupBy("component").agg(F.count_distinct("summary_id"), F.count(F.lit(1)))
    for rows in (5, 10_000):
        assert set(map(tuple, al.linked_components(links, parts, rows=rows).collect())) == set(map(tuple, want.collect()))


def test_numbered_rows_need_no_window_and_use_all_cores(spark):
    """F16, F17: rows a little above the limit came in two blocks, read by two tasks, and were shuffled again to be counted"""
    n = 1100
    df = spark.range(n).select(F.col("id"), F.xxhash64("id").alias("v"))
    o = ordered(df, [], ["v", "id"], max_rows=1000)
    assert o.split and o.df.select("_blk").distinct().count() > spark.sparkContext.defaultParallelism
    placed = o.with_position("pos").result()
    assert "Window" not in plan(placed) and placed.columns == ["id", "v", "pos"]
    rows = sorted(placed.collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(n))
    assert [r["v"] for r in rows] == sorted(r["v"] for r in rows)


def test_columns_scaled_once_are_those_of_each_preprocessor(spark):
    """each of the seven models imputed and scaled its columns anew"""
    rows = spark.createDataFrame([(i % 2, float(i * i), None if i % 4 == 0 else float(i), 1.0) for i in range(40)], "label int, a double, b double, c double")
    train, test = rows.where("a < 900"), rows.where("a >= 900")
    got = md.scaled_columns(train, test, ["a", "b", "c"])
    prep = md.preprocessor(numeric=["b", "c"]).fit(train)
    for part, scaled in zip((train, test), got):
        want = [tuple(r[0]) for r in prep.transform(part).select(vector_to_array("features")).collect()]
        have = [(r["b"], r["c"]) for r in scaled.collect()]
        assert len(have) == len(want) and all(math.isclose(x, y, abs_tol=1e-12) for a, b in zip(sorted(have), sorted(want)) for x, y in zip(a, b))
