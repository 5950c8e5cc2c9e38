"""Properties of conformal sets, splits and models."""

import numpy as np
from pyspark.sql import functions as F

from alertsieve.functions import probs as pr
from alertsieve.operators import conformal as cf
from alertsieve.operators import resample as rs
from alertsieve.operators import splits as sp
from alertsieve.operators.ordering import ordered
from alertsieve.operators.topk import first_k
from alertsieve.sources.tables import scores

SF = "/root/testdata/sf0.001"


def test_sets_grow_and_cover(spark):
    s = scores(spark, SF)
    a = s.select("id", *[pr.set_size(F.col("pa"), F.lit(q)).alias(f"n{i}") for i, q in enumerate((0.0, 0.5, 0.9, 2.0))]).collect()
    for r in a:
        assert 1 == r["n0"] <= r["n1"] <= r["n2"] <= r["n3"] == 10
    # with u = 0 the calibration rows themselves are covered at least 1 - alpha
    cal = s.where("split = 'cal'").withColumn("score", pr.raps_score(F.col("pa"), F.col("label"), F.lit(0.0)))
    q = cf.calibrate(cal, ["agree"], [0.1])
    m = cf.set_metrics(cf.with_sets(cf.attach_thresholds(cal, ["agree"], q, 1), F.col("pa"), 1), [0.1]).first()
    assert m["coverage"] >= 0.9


def test_results_do_not_depend_on_partitioning(spark):
    s = scores(spark, SF)
    one = cf.agreement_report(cf.conformal_run(s.coalesce(1), F.col("pa"), ["agree"], [0.1]), [0.1])
    many = cf.agreement_report(cf.conformal_run(s.repartition(7), F.col("pa"), ["agree"], [0.1]), [0.1])
    key = lambda df: sorted((r["part"], round(r["coverage"], 9), round(r["mean_set_size"], 9), r["n"]) for r in df.collect())
    assert key(one) == key(many)


def test_empty_partition_gets_one(spark):
    s = scores(spark, SF)
    q = cf.calibrate(cf.raps_scored(s.where("split = 'cal' and agree"), F.col("pa")), ["agree"], [0.1])
    t = cf.attach_thresholds(s.where("split = 'test'"), ["agree"], q, 1)
    assert {r["q0"] for r in t.where("not agree").select("q0").distinct().collect()} == {1.0}


def test_temporal_split_is_a_partition(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, int(rng.integers(0, 9))) for i in range(200)], "id long, t int")
    out = {r["id"]: r["split"] for r in sp.temporal_split(df, ["t", "id"], [0.7, 0.15, 0.15], ["train", "cal", "test"]).collect()}
    seq = [r["id"] for r in sorted(df.collect(), key=lambda r: (r["t"], r["id"]))]
    assert [out[i] for i in seq] == ["train"] * 140 + ["cal"] * 30 + ["test"] * 30


def test_first_k_with_hot_key(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    got = first_k(df, ["k"], [F.desc("id")], 3)
    want = {}
    for r in df.collect():
        want.setdefault(r["k"], []).append(r["id"])
    for k, v in want.items():
        assert sorted((r["_rank"], r["id"]) for r in got.where(F.col("k") == k).collect()) == [(i + 1, x) for i, x in enumerate(sorted(v)[::-1][:3])]
        if k != "hot":
            break


def test_bootstrap_augrc_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, bool(rng.random() < 0.3), float(rng.random())) for i in range(400)], "id long, err boolean, conf double")
    whole = rs.bootstrap_augrc(df, F.col("err"), F.col("conf"), 20).first()
    monkeypatch.setattr(rs, "BLOCK_ROWS", 37)
    cut = rs.bootstrap_augrc(df, F.col("err"), F.col("conf"), 20).first()
    assert all(abs(whole[c] - cut[c]) < 1e-12 for c in ("mean", "lower", "upper"))


def test_position_is_a_permutation(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 7 % 500)
    r = ordered(df, [], ["x"], max_rows=40).with_position().result()
    assert all(a["pos"] == a["x"] for a in r.collect())


def test_models_sum_to_one(spark):
    from pyspark.ml import classification as cl

    from alertsieve.operators import models as md
    from alertsieve.plans.vector_queries import vectors

    v = md.with_vectors(vectors(spark, SF)).select("id", "label", "features")
    est = cl.LogisticRegression(maxIter=3)
    oof = md.out_of_fold(v, est, 3)
    assert oof.count() == v.count() == oof.select("id").distinct().count()
    c = md.fit_calibrator(oof, 10).apply(oof).select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("t"))
    assert all(abs(r["t"] - 1) < 1e-9 for r in c.collect())
