"""Split and unsplit ordering must agree with each other and with NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertsieve.operators.ordering import Quantile, before_cut, column_quantiles, ordered, quantiles, rank_cut


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        key = "hot" if i % 3 else f"k{i % 7}"  # one key holds two thirds
        data.append((i, key, float(np.round(rng.normal(), 1)), int(rng.integers(0, 40))))
    return spark.createDataFrame(data, "id long, k string, v double, t int").cache()


def _seq(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["k"], []).append(r)
    return {k: sorted(v, key=lambda r: (r["t"], r["id"])) for k, v in out.items()}


@pytest.mark.parametrize("limit", [10_000, 37])
def test_bounded_and_running(rows, limit):
    o = ordered(rows, ["k"], ["t", "id"], before=5, after=3, max_rows=limit)
    got = o.with_columns({"m": F.sum("v").over(o.rows(-5, 3)), "lag": o.lag("id"), "lead": o.lead("id")}).result()
    got = {r["id"]: r for r in got.collect()}
    assert len(got) == 600
    run = (
        ordered(rows, ["k"], ["t", "id"], max_rows=limit)
        .with_position()
        .with_running({"s": ("sum", F.col("v")), "mx": ("max", F.col("v")), "l": ("last", F.when(F.col("v") > 1, F.col("v")))})
        .with_running({"mn": ("min", F.col("s"))})
        .result()
    )
    run = {r["id"]: r for r in run.collect()}
    for seq in _seq(rows).values():
        vals = [r["v"] for r in seq]
        cs = np.cumsum(vals)
        last = None
        for i, r in enumerate(seq):
            g = got[r["id"]]
            assert math.isclose(g["m"], sum(vals[max(0, i - 5) : i + 4]), abs_tol=1e-9)
            assert g["lag"] == (seq[i - 1]["id"] if i else None)
            assert g["lead"] == (seq[i + 1]["id"] if i + 1 < len(seq) else None)
            q = run[r["id"]]
            last = r["v"] if r["v"] > 1 else last
            assert q["pos"] == i and math.isclose(q["s"], cs[i], abs_tol=1e-9)
            assert q["mx"] == max(vals[: i + 1]) and q["l"] == last
            assert math.isclose(q["mn"], cs[: i + 1].min(), abs_tol=1e-9)


@pytest.mark.parametrize("limit", [10_000, 37])
@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles(rows, limit, keys):
    wanted = {
        "q9": Quantile(0.9, "higher"),
        "med": Quantile(0.5),
        "c": Quantile(0.9, "higher", lambda n: F.least(F.ceil((n + 1) * 0.9) / n, F.lit(1.0))),
    }
    got = quantiles(rows, keys, "v", wanted, max_rows=limit).collect()
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["k"] if keys else None, []).append(r["v"])
    assert len(got) == len(groups)
    for r in got:
        v = groups[r["k"] if keys else None]
        n = len(v)
        assert r["n"] == n
        assert r["q9"] == np.quantile(v, 0.9, method="higher")
        assert math.isclose(r["med"], np.median(v), abs_tol=1e-12)
        assert r["c"] == np.quantile(v, min(np.ceil((n + 1) * 0.9) / n, 1.0), method="higher")


@pytest.mark.parametrize("limit", [10_000, 37])
def test_rank_cut(rows, limit):
    cuts = rank_cut(rows, ["t", "id"], [100, 360, 599, 600], max_rows=limit)
    seq = sorted((r["t"], r["id"]) for r in rows.collect())
    assert cuts[:3] == [seq[100], seq[360], seq[599]] and cuts[3] is None
    assert rows.where(before_cut(["t", "id"], cuts[1])).count() == 360


@pytest.mark.parametrize("keys", [["k"], []])
def test_quantiles_of_distinct_values(spark, keys):
    rng = np.random.default_rng(8)
    data = [("hot" if i % 3 else "cold", float(x)) for i, x in enumerate(rng.random(900))]
    df = spark.createDataFrame(data, "k string, v double")
    wanted = {f"c{i}": Quantile(1 - a, "higher", lambda n, a=a: F.least(F.ceil((n + 1) * (1 - a)) / n, F.lit(1.0))) for i, a in enumerate((0.01, 0.1, 0.5))}
    for r in quantiles(df, keys, "v", wanted, max_rows=80).collect():
        v = [x for k, x in data if not keys or k == r["k"]]
        for i, a in enumerate((0.01, 0.1, 0.5)):
            assert r[f"c{i}"] == np.quantile(v, min(np.ceil((len(v) + 1) * (1 - a)) / len(v), 1.0), method="higher")


def test_null_keys_and_null_order_values_on_both_paths(spark):
    from pyspark.sql import functions as F

    from alertsieve.operators.ordering import Quantile, before_cut, column_quantiles, ordered, quantiles, rank_cut

    rows = [(i, None if i % 2 else "a", float(i), None if i < 10 else i // 3) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k string, v double, t int")
    wanted = {"m": Quantile(0.5, "linear")}
    small, large = (sorted(map(repr, quantiles(df, ["k"], "v", wanted, max_rows=n).collect())) for n in (1000, 5))
    assert small == large and len(small) == 2
    for limit in (1000, 5):
        got = ordered(df, ["k"], ["id"], max_rows=limit).with_running({"n": ("count", F.lit(1))}).result()
        assert {(r.k, r.n) for r in got.groupBy("k").agg(F.max("n").alias("n")).collect()} == {("a", 20), (None, 20)}
        cuts = rank_cut(df, ["t", "id"], [5, 24, 32], max_rows=limit)
        assert cuts[0] == (None, 5)
        assert [df.where(before_cut(["t", "id"], c)).count() for c in cuts] == [5, 24, 32]


def test_column_quantiles(spark):
    """Several columns at once, by windows and by brackets, with nulls, NaN, ties and a column without values"""
    rng = np.random.default_rng(8)
    rows = [(float(rng.normal()), None if i % 3 else float(i % 7), float("nan") if i % 2 else float(i), None) for i in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    wanted = {"q": Quantile(0.5), "hi": Quantile(0.9, "higher")}
    for limit in (None, 60):
        got = {r["column"]: (r["n"], r["q"], r["hi"]) for r in column_quantiles(df, ["a", "b", "c", "d"], wanted, limit).collect()}
        assert set(got) == {"a", "b", "c"}
        for i, c in enumerate("abc"):
            x = np.array([r[i] for r in rows if r[i] is not None and r[i] == r[i]])
            assert got[c] == (len(x), pytest.approx(np.quantile(x, 0.5)), pytest.approx(np.quantile(x, 0.9, method="higher")))
