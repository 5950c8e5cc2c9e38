"""Models of alerts: all rows and features, fitted to the end, with few copies on disk; the rows are made here."""

import datetime as dt
import math
import random
from pathlib import Path

import pyarrow.dataset as ds
import pytest
from pyspark.ml import classification as cl
from pyspark.sql import functions as F

from alertsieve import session
from alertsieve.operators import models as md
from alertsieve.operators.lookup import written_lookup
from alertsieve.operators.ordering import ordered
from alertsieve.plans import jobs
from alertsieve.plans import model_queries as mq
SCHEMA = "summary_id long, line int, ts timestamp, series_id long, platform long, new_value double, prev_value double, status string, quantity double, is_regression boolean, lower_is_better boolean, opened timestamp"


@pytest.fixture(scope="module")
def alert_frame(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        new, prev, status = r.uniform(1, 100), r.uniform(1, 100), "ANR"[i % 3]
        quantity = r.gauss(0, 1) + (2.0 if status == "A" else 0.0) - (1.0 if status == "N" else 0.0)
        ts = None if i % 50 == 7 else dt.datetime(2024, 1, 1 + r.randrange(28))
        series, platform = (None if i % 41 == 0 else r.randrange(20)), (None if i % 29 == 0 else r.randrange(4))
        rows.append((None if i % 37 == 0 else i // 4, i % 4, ts, series, platform, new, prev, status, quantity, True, i % 2 == 0, None))
    return spark.createDataFrame(rows + rows[::40], SCHEMA)


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    return tmp_path / "alertsieve"


@pytest.fixture
def small_portions(spark):
    spark.conf.set(session.GROUP_ROWS_CONF, "100")
    yield
    spark.conf.unset(session.GROUP_ROWS_CONF)


@pytest.fixture
def fits(monkeypatch):
    seen, fit = [], cl.LogisticRegression._fit

    def recorded(self, df):
        m = fit(self, df)
        seen.append((m.summary.totalIterations, self.getMaxIter(), m.numFeatures))
        return m

    monkeypatch.setattr(cl.LogisticRegression, "_fit", recorded)
    return seen


def copies(folder: Path, rows: int) -> int:
    return sum(ds.dataset(str(p), format="parquet").count_rows() >= rows for p in folder.iterdir())


def test_ablation_fits_each_model_to_the_end(spark, alert_frame, monkeypatch, fits):
    """each of the seven models was stopped after 3 iterations"""
    monkeypatch.setattr(mq, "alerts", lambda spark, d: alert_frame)
    assert mq.feature_group_ablation(spark, "").count() == 7
    assert sorted(n for _, _, n in fits) == [2, 4, 4, 6, 6, 8, 10]
    assert all(done < most for done, most, _ in fits) and max(done for done, _, _ in fits) > 3


def test_models_without_a_group_use_all_features_and_fit_to_the_end(spark, alert_frame, monkeypatch, fits):
    """both models were stopped after 3 iterations and saw four of the ten features"""
    monkeypatch.setattr(mq, "alerts", lambda spark, d: alert_frame)
    got = {r["segment"]: r["accuracy"] for r in mq.leave_one_group_out_models(spark, "").collect()}
    assert set(got) == {"down", "up"} and min(got.values()) > 0.5  # the class shows in the quantity, which was left out
    assert [n for _, _, n in fits] == [10, 10]
    assert all(3 < done < most for done, most, _ in fits)


@pytest.mark.parametrize("name", ["alert_classification", "feature_group_ablation", "leave_one_group_out_models"])
def test_one_copy_of_the_rows_is_left_on_disk(spark, alert_frame, monkeypatch, folder, small_portions, name):
    """up to five copies of the rows stayed on disk until the session ended"""
    monkeypatch.setattr(mq, "alerts", lambda spark, d: alert_frame)
    monkeypatch.setattr(mq, "ROUNDS", 2)
    seen, fit, n = [], cl.LogisticRegression._fit, int(alert_frame.count() * 0.2)
    monkeypatch.setattr(cl.LogisticRegression, "_fit", lambda self, df: (seen.append(copies(folder, n)), fit(self, df))[1])
    assert getattr(mq, name)(spark, "").count()
    assert seen and max(seen) == 1


def test_written_rows_are_those_of_the_plain_features(spark, alert_frame, monkeypatch, folder, small_portions):
    monkeypatch.setattr(mq, "alerts", lambda spark, d: alert_frame)
    every = [c for g in jobs.ALERT_FEATURES.values() for c in g]
    a = alert_frame.withColumn("m", F.abs(F.col("new_value") - F.col("prev_value")))
    g = a.groupBy("summary_id").agg(F.count(F.lit(1)).alias("group_size"), F.avg("m").alias("group_magnitude"), F.count_distinct("platform").alias("group_platforms"))
    s = a.groupBy("series_id").agg(F.avg("m").alias("_m"), F.stddev_samp("m").alias("_s"))
    z = F.coalesce(F.try_divide(F.col("m") - F.col("_m"), F.col("_s")), F.lit(0.0))
    want = a.join(g, "summary_id", "left").join(s, "series_id", "left").select("quantity", "m", "group_size", "group_magnitude", "group_platforms", z.alias("z"))
    got = mq._alert_rows(spark, "")
    placed = got.select("id", "split", *every).collect()
    n = alert_frame.count()
    assert sorted(r["id"] for r in placed) == list(range(n))
    assert sorted(r["id"] for r in placed if r["split"] == "train") == list(range(int(n * 0.8)))
    key = lambda r: tuple(-1.0 if x is None else round(float(x), 9) for x in r)
    have = got.select("quantity", "magnitude_abs", "group_size", "group_magnitude", "group_platforms", "series_z").collect()
    assert sorted(map(key, have)) == sorted(map(key, want.collect()))
    assert all(r["is_anomaly"] == int(abs(r["series_z"]) > 2) and math.isfinite(r["value_ratio_abs"]) for r in placed)


def test_portions_keep_order_and_rows(spark, folder, small_portions):
    """all rows were shuffled at once"""
    df = spark.createDataFrame([(None if i % 9 == 0 else float("nan") if i % 31 == 0 else float(i * 7 % 40), i) for i in range(700)], "x double, id long")
    o = ordered(df, [], ["x", "id"], portions=True)
    assert len(list(next(folder.iterdir()).iterdir())) > 3
    got = sorted(o.with_position("pos").result().collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(700))
    assert [r["id"] for r in got] == [r["id"] for r in df.orderBy("x", "id").collect()]
    one = spark.createDataFrame([(1.0, i) for i in range(300)], "x double, id long")  # no cut inside equal values
    assert [r["id"] for r in sorted(ordered(one, [], ["x", "id"], portions=True).with_position("p").result().collect(), key=lambda r: r["p"])] == list(range(300))
    names = spark.createDataFrame([(float(i), str(i)) for i in range(30)], "x double, name string")
    joined = written_lookup(df, names, "x", lambda j: j.drop("id"))
    assert sorted(map(str, joined.collect())) == sorted(map(str, df.join(names, "x", "left").drop("id").collect()))


def test_columns_are_scaled_without_a_copy(spark, folder):
    """the scaled columns were written beside the rows"""
    rows = spark.createDataFrame([(i % 2, i, None if i % 4 == 0 else float(i), 1.0) for i in range(40)], "label int, a int, b double, c double")
    train, test = md.scaled_columns(rows.where("a < 30"), rows.where("a >= 30"), ["a", "b", "c"])
    assert train.count() == 30 and test.count() == 10 and not folder.exists()
    assert train.where("c <> 0").count() == 0  # a constant column becomes 0
