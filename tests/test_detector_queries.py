"""Detector queries evaluate every detector but the truth itself."""

from collections import defaultdict

import pytest

from alertsieve.operators import detect as dt
from alertsieve.plans import series_queries as sq
from test_sequential import _first, _nearest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("nearest", [True, False])
def test_all_detectors_against_a_loop(spark, nearest):
    p = sq.positioned(spark, SF)
    found = defaultdict(list)
    for r in dt.detect(p, sq.DETECTORS).collect():
        found[r["series_id"], r["detector"]].append(r["pos"])
    series = sorted(r["series_id"] for r in p.select("series_id").distinct().collect())
    names = sorted(set(sq.SQL_HITS) - {"effect_shift"})
    match = _nearest if nearest else _first
    want = {(s, n): (len(found[s, n]), len(found[s, "effect_shift"]), len(match(found[s, n], found[s, "effect_shift"], 5))) for s in series for n in names}
    if nearest:
        got = {(r["series_id"], r["detector"]): (r["n_detected"], r["n_true"], r["n_matches"]) for r in sq.detector_scores(spark, SF).collect()}
        assert got == want
    else:
        got = {r["detector"]: (r["n_detected"], r["n_true"], r["n_matches"]) for r in sq.detector_eval(spark, SF).collect()}
        assert got == {n: tuple(sum(want[s, n][k] for s in series) for k in range(3)) for n in names}


def _f1(det, tru, tol=5):
    if not tru:
        return (1.0 if not det else 0.0, 1.0, 1.0 if not det else 0.0)
    m = len(_nearest(det, tru, tol))
    return (m / len(det) if det else 0.0, m / len(tru), 2 * m / (len(det) + len(tru)))


def test_sensitivity_tables_against_a_loop(spark):
    p = sq.positioned(spark, SF)
    values = defaultdict(dict)
    for r in p.select("series_id", "pos", "value").collect():
        values[r["series_id"]][r["pos"]] = r["value"]
    found = defaultdict(list)
    for r in dt.detect(p, [x for w in sq.WINDOW_GRID for x in (dt.t_shift(w, 2.0, name=f"window_{w}"), dt.effect_shift(w, name=f"truth_{w}"))]).collect():
        found[r["series_id"], r["detector"]].append(r["pos"])
    got = {r["detector"]: (r["precision_mean"], r["recall_mean"], r["f1_mean"]) for r in sq.window_sensitivity(spark, SF).collect()}
    for w in sq.WINDOW_GRID:
        scores = [_f1(found[s, f"window_{w}"], found[s, f"truth_{w}"]) for s, v in values.items() if len(v) >= 2 * w]
        assert got[f"window_{w}"] == pytest.approx([sum(x) / len(scores) for x in zip(*scores)])
    got = {r["detector"]: (r["precision_mean"], r["recall_mean"], r["f1_mean"]) for r in sq.cusum_sensitivity(spark, SF).collect()}
    for t in sq.CUSUM_GRID:
        scores = []
        for s, v in values.items():
            x = [v[i] for i in sorted(v)]
            mean = sum(x) / len(x)
            std = (sum((a - mean) ** 2 for a in x) / len(x)) ** 0.5
            up = down = 0.0
            hit = []
            for i in range(1, len(x) if len(x) >= 10 else 0):
                z = (x[i] - mean) / (std + 1e-10)
                up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
                if max(up, down) > t:
                    hit = [i]
                    break
            scores.append(_f1(hit, found[s, "truth_10"]))
        assert got[f"cusum_{t}"] == pytest.approx([sum(x) / len(scores) for x in zip(*scores)])
