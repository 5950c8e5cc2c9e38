"""Sequential rules against plain loops: gap suppression, greedy matching, segmentation."""

import numpy as np
import pytest

from alertsieve.operators import detect as dt


def _suppress(pos, gap):
    kept = []
    for p in sorted(pos):
        if not kept or p - kept[-1] > gap:
            kept.append(p)
    return kept


def _nearest(det, true, tol):
    free, out = sorted(det), []
    for t in sorted(true):
        near = [d for d in free if abs(d - t) <= tol]
        if near:
            b = min(near, key=lambda d: (abs(d - t), d))
            free.remove(b)
            out.append((t, b))
    return out


def _first(det, true, tol):
    used, out = set(), []
    for d in sorted(det):
        for t in sorted(true):
            if t not in used and abs(d - t) <= tol:
                used.add(t)
                out.append((t, d))
                break
    return out


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    det, tru = {}, {}
    for s in range(25):
        det[s] = sorted(rng.choice(120, rng.integers(0, 50), replace=False).tolist())
        tru[s] = sorted(rng.choice(120, rng.integers(0, 20), replace=False).tolist())
    h = spark.createDataFrame([(s, "x", int(p), 6) for s, v in det.items() for p in v], "series_id long, detector string, pos long, gap int")
    t = spark.createDataFrame([(s, "x", int(p)) for s, v in tru.items() for p in v], "series_id long, detector string, pos long")
    return det, tru, h, t


def test_suppress(points):
    det, _, h, _ = points
    got = {}
    for r in dt.suppress(h).collect():
        got.setdefault(r["series_id"], []).append(r["pos"])
    for s, v in det.items():
        assert sorted(got.get(s, [])) == _suppress(v, 6)


@pytest.mark.parametrize("nearest", [True, False])
def test_match(points, nearest):
    det, tru, h, t = points
    got = {}
    for r in dt.match_points(h, t, 5, ["series_id", "detector"], nearest).collect():
        got.setdefault(r["series_id"], []).append((r["true_pos"], r["det_pos"]))
    for s in det:
        want = (_nearest if nearest else _first)(det[s], tru[s], 5)
        assert sorted(got.get(s, [])) == sorted(want), s


@pytest.mark.parametrize("gap", [-1, 0, 1, 6, 40])
def test_suppress_over_blocks(spark, gap):
    """A series with a hit at every point, one with few and one with nulls in the key, cut into blocks of 16 positions"""
    rng = np.random.default_rng(gap + 9)
    series = {1: list(range(500)), 2: sorted(rng.choice(900, 90, replace=False).tolist()), None: sorted(rng.choice(200, 150, replace=False).tolist()), 3: [7]}
    h = spark.createDataFrame([(s, "x", p, gap) for s, v in series.items() for p in v], "series_id long, detector string, pos long, gap int")
    got = {}
    for r in dt.suppress(h.repartition(3), span=16).collect():
        got.setdefault(r["series_id"], []).append(r["pos"])
    assert {s: sorted(v) for s, v in got.items()} == {s: _suppress(v, gap) for s, v in series.items()}
    assert dt.suppress(h.limit(0)).collect() == []


@pytest.mark.parametrize("nearest", [True, False])
@pytest.mark.parametrize("tolerance", [0, 5, 40])
def test_match_over_blocks_and_strips(spark, monkeypatch, nearest, tolerance):
    """Dense points, so that what is used is handed on from strip to strip and from block to block"""
    from alertsieve.operators import scans

    monkeypatch.setattr(scans, "STRIP", 4)
    rng = np.random.default_rng(tolerance)
    det = {1: list(range(400)), 2: list(range(0, 400, 2)), 3: sorted(rng.choice(400, 200, replace=False).tolist()), 4: [], 5: [3]}
    tru = {1: list(range(400)), 2: list(range(400)), 3: sorted(rng.choice(400, 150, replace=False).tolist()), 4: [1], 5: []}
    h = spark.createDataFrame([(s, p) for s, v in det.items() for p in v], "k long, pos long")
    t = spark.createDataFrame([(s, p) for s, v in tru.items() for p in v], "k long, pos long")
    got = {}
    for r in dt.match_points(h, t, tolerance, ["k"], nearest, span=128).collect():
        got.setdefault(r["k"], []).append((r["true_pos"], r["det_pos"]))
    for s in det:
        want = (_nearest if nearest else _first)(det[s], tru[s], tolerance)
        assert sorted(got.get(s, [])) == sorted(want), s
