"""The pivot path must give exactly what comparing all pairs gives, also with one dense region."""

import numpy as np
import pytest

from alertsieve.operators import neighbours as nb


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.05, (120, 3)), rng.normal(0, 1.0, (180, 3)), np.zeros((10, 3))])  # a third dense, some equal
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    return x, df.cache()


@pytest.fixture(params=["small", "pivots"])
def path(request, spark, monkeypatch):
    if request.param == "pivots":
        spark.conf.set(nb.SMALL_CONF, "20")
        monkeypatch.setattr(nb, "BLOCK_ROWS", 40)
    yield request.param
    spark.conf.unset(nb.SMALL_CONF)


@pytest.mark.parametrize("skip", [True, False])
def test_knn(cloud, path, skip):
    x, df = cloud
    got = {}
    for r in nb.knn_join(df, df, 4, skip_same=skip, pivots=8).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nid"], r["distance"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        order = sorted((round(d[i, j], 12), j) for j in range(len(x)) if not (skip and i == j))[:4]
        assert [n for _, n, _ in sorted(got[i])] == [j for _, j in order]
        assert np.allclose([q for _, _, q in sorted(got[i])], [q for q, _ in order], atol=1e-9)


def test_within(cloud, path):
    x, df = cloud
    got = {r["id"]: (r["n"], r["low"]) for r in nb.within(df, df, 0.3, pivots=8).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.3
    assert got == {i: (int(d[i].sum()), int(np.nonzero(d[i])[0].min())) for i in range(len(x))}


def test_dbscan_names_clusters_by_smallest_core(cloud):
    x, df = cloud
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in nb.dbscan(df, 0.3, 5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.3
    core = d.sum(1) >= 5
    lab = {i: i for i in range(len(x)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in lab:
            m = min(lab[j] for j in lab if d[i, j])
            if m < lab[i]:
                lab[i], changed = m, True
    for i in range(len(x)):
        near = [lab[j] for j in lab if d[i, j]]
        assert got[i] == ((lab[i], True) if core[i] else (min(near) if near else -1, False))


def test_smote_lies_between(cloud, spark):
    x, df = cloud
    from pyspark.sql import functions as F

    rows = nb.smote(df.withColumn("y", (F.col("id") < 30).cast("int")), "y", 1, 47, 3).collect()
    assert len(rows) == 47
    for r in rows:
        s = x[r["source_id"]]
        others = [o for o in x[:30] if np.linalg.norm(np.cross(np.array(r["v"]) - s, o - s)) < 1e-9 and np.dot(np.array(r["v"]) - s, o - s) >= -1e-12]
        assert others


def test_many_dimensions_meet_in_a_grid(spark, monkeypatch):
    """Pivots leave out nothing here; each row is copied once per block of the other side"""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1.0, (200, 32))
    x[150:170] = x[150]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").cache()
    spark.conf.set(nb.SMALL_CONF, "20")
    monkeypatch.setattr(nb, "GRID_ROWS", 30)
    monkeypatch.setattr(nb, "TILE", 100)
    grids, whole = [], nb._grid
    monkeypatch.setattr(nb, "_grid", lambda *a, **k: grids.append(a[4:]) or whole(*a, **k))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    try:
        got = {(r["id"], r["rank"]): r["nid"] for r in nb.knn_join(df, df, 5, skip_same=True, pivots=8).collect()}
        assert got == {(i, r + 1): j for i in range(200) for r, j in enumerate(sorted((j for j in range(200) if j != i), key=lambda j: (round(d[i, j], 12), j))[:5])}
        near = {r["id"]: (r["n"], r["low"]) for r in nb.within(df, df, 6.5, pivots=8).collect()}
        assert near == {i: (int((d[i] <= 6.5).sum()), int(np.nonzero(d[i] <= 6.5)[0].min())) for i in range(200)}
        assert len(grids) == 2
    finally:
        spark.conf.unset(nb.SMALL_CONF)


def test_linked_blocks_give_the_smallest_id():
    x = np.array([[0.0], [1.0], [2.0], [9.0], [10.0], [50.0]])
    found = nb._linked(np.array([5, 3, 8]), x[[0, 2, 3]], np.array([4, 7, 9]), x[[1, 4, 5]], 1.0)
    assert sorted(found.itertuples(index=False, name=None)) == [(4, 3), (5, 3), (8, 7)]
