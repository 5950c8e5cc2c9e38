"""Non-negative factors against a dense loop, keyed permutations, normal quantiles."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertsieve.functions.random import keyed_uniform
from alertsieve.operators import models as md
from alertsieve.operators.factors import TINY, factorise


def test_factors_equal_a_dense_loop(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((12, 8)) * (rng.random((12, 8)) < 0.5), 3)
    x[0, 0] = 1.0
    keep_r, keep_c = np.flatnonzero(x.any(axis=1)), np.flatnonzero(x.any(axis=0))
    big = 1 << 40  # ids beyond 32 bits
    rows = [(big + int(i), f"t{j}", float(x[i, j])) for i in range(12) for j in range(8)] + [(None, "t0", 1.0), (big, None, 1.0), (big, "t1", None)]
    f = factorise(spark.createDataFrame(rows, "id long, term string, weight double").repartition(3), 3, rounds=6)
    assert all(b <= a + 1e-9 for a, b in zip(f.errors, f.errors[1:]))
    x = x[np.ix_(keep_r, keep_c)]
    scale = 2.0 * (x.sum() / x.size / 3) ** 0.5
    names = spark.createDataFrame([(big + int(i),) for i in keep_r], "n long"), spark.createDataFrame([(f"t{j}",) for j in keep_c], "n string")
    start = [np.array([[(r[f"u{j}"] + 0.01) * scale for j in range(3)] for r in sorted(t.select("n", *[keyed_uniform(F.col("n"), f"{s}{j}").alias(f"u{j}") for j in range(3)]).collect())]) for t, s in zip(names, "wh")]
    w, h = start[0], start[1].T
    for i in range(6):
        h = h * (w.T @ x) / (w.T @ w @ h + TINY)
        w = w * (x @ h.T) / (w @ h @ h.T + TINY)
        assert f.errors[i] == pytest.approx(((x - w @ h) ** 2).sum(), rel=1e-6)
    got_w = np.array([[r["f0"], r["f1"], r["f2"]] for r in sorted(f.rows.collect())])
    got_h = np.array([[r["f0"], r["f1"], r["f2"]] for r in sorted(f.cols.collect())])
    assert np.allclose(got_w, w) and np.allclose(got_h.T, h)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65, 1000])
def test_partners_are_a_permutation(spark, n):
    got = spark.range(n).select("id", *[md.partner(F.col("id"), n, s).alias(f"q{s}") for s in (0, 1)]).collect()
    assert sorted(r["q0"] for r in got) == sorted(r["q1"] for r in got) == list(range(n))
    assert n < 64 or sum(r["q0"] == r["id"] for r in got) < n / 8 and [r["q0"] for r in got] != [r["q1"] for r in got]


def test_importance_finds_the_feature(spark):
    from pyspark.ml import classification as cl

    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in (rng.normal(), (i % 2) * 2.0 - 1.0, rng.normal())], i % 2) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, label int")
    model = cl.DecisionTreeClassifier(maxDepth=2, seed=1).fit(md.with_vectors(frame))
    got = {r["feature"]: r["importance"] for r in md.permutation_importance(model, frame, 3, repeats=4).collect()}
    assert set(got) == {0, 1, 2} and got[1] > 0.3 and abs(got[0]) < 0.1 and abs(got[2]) < 0.1


def test_normal_quantile(spark):
    p = [10.0**-k for k in range(1, 300, 7)] + [1 - 10.0**-k for k in range(1, 15)] + [i / 97 for i in range(1, 97)] + [0.075, 0.925, 0.5]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", F.expr(md.probit_sql("p")).alias("z")).collect()
    assert all(r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-15) for r in got)


def test_rank_normal(spark):
    rows = [(i, float(i * 7 % 5), None if i == 3 else float(-i), "k") for i in range(20)]
    got = md.rank_normal(spark.createDataFrame(rows, "id long, a double, b double, s string"), ["a", "b"]).collect()
    for j in (1, 2):
        order = sorted(rows, key=lambda r: (r[j] is not None, r[j] if r[j] is not None else 0, r[0]))
        want = {r[0]: NormalDist().inv_cdf((k + 0.5) / 20) for k, r in enumerate(order)}
        assert all(r[j] == pytest.approx(want[r[0]]) for r in got)
    assert {r["s"] for r in got} == {"k"} and len(got) == 20


def test_models_fit_in_the_session_of_factors(spark):
    """The trees' closures hold the session; before, it couldn't be sent to tasks after the first factors"""
    from pyspark.ml.classification import RandomForestClassifier

    factorise(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, term string, weight double"), 2, 1)
    rows = spark.createDataFrame([(i, [float(i % 3), float(i)], i % 2) for i in range(40)], "id long, v array<double>, label int")
    best, table = md.grid_search(md.with_vectors(rows), RandomForestClassifier(seed=1), {"maxDepth": [2, 3], "numTrees": [2]})
    assert table.count() == 2
