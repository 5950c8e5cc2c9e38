"""Composed jobs: DataFrames in, result tables out. Column names are those of ``sources.tables``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.functions import explain as ex
from alertsieve.functions import probs as pr
from alertsieve.functions import tickets as tk
from alertsieve.operators import agreement as ag
from alertsieve.operators import alerts as al
from alertsieve.operators import categories as ct
from alertsieve.operators import conformal as cf
from alertsieve.operators import gating as gt
from alertsieve.operators import metrics as mt
from alertsieve.operators import models as md
from alertsieve.operators import neighbours as nb
from alertsieve.operators import resample as rs
from alertsieve.operators import splits as sp
from alertsieve.operators.lookup import lookup_join, written_lookup
from alertsieve.session import drop_shuffles, materialise, release

ALPHAS = (0.01, 0.05, 0.10, 0.20)


def prepare_tickets(df: DataFrame, resolution: Column, component: str, order: Sequence[str], top_k: int, kind: str = "tracker_b", other: bool = True) -> DataFrame:
    """Drop noise, cut 60/20/20 in time, map components by training frequency."""
    clean = df.where(~tk.is_noise(resolution, kind)).where(F.col(component).isNotNull())
    s = sp.temporal_split(clean, order, [0.6, 0.2, 0.2], ["train", "cal", "test"])
    mapping = ct.label_mapping(s.where("split = 'train'"), component, top_k)
    return ct.apply_label_mapping(s, mapping, component, top_k, other)


def conformal_job(scores: DataFrame, probs: str, alphas: Sequence[float] = ALPHAS, resamples: int = 1000) -> dict[str, DataFrame]:
    """One model: set metrics, class coverage, sizes, risk-coverage area with its interval."""
    sets = cf.conformal_run(scores, F.col(probs), [], alphas)
    test = scores.where("split = 'test'")
    err, conf = pr.predicted(F.col(probs)) != F.col("label"), pr.confidence(F.col(probs))
    return {
        "metrics": cf.set_metrics(sets, alphas),
        "class_coverage": cf.class_coverage(sets),
        "sizes": cf.size_histogram(sets),
        "augrc": mt.augrc(test, err, conf),
        "augrc_interval": rs.bootstrap_augrc(test, err, conf, resamples),
        "fixed_coverage": mt.accuracy_at_coverage(test, err, conf),
    }


def agreement_job(scores: DataFrame, alphas: Sequence[float] = ALPHAS) -> dict[str, DataFrame]:
    """Two models: agreement tables, viability, conditioned sets."""
    test, conf = scores.where("split = 'test'"), pr.confidence(F.col("pa"))
    return {
        "contingency": ag.contingency(test),
        "bins": ag.gap_by_bin(test, conf),
        "classes": ag.by_class(test),
        "viability": ag.viability(scores.where("split = 'cal'"), test, conf),
        "sets": cf.agreement_report(cf.conformal_run(scores, F.col("pa"), ["agree"], alphas), alphas),
    }


def train_two_models(a: DataFrame, b: DataFrame, model_a: Estimator, model_b: Estimator) -> DataFrame:
    """Score calibration and test rows with both models (each table: id, split, label, features)."""

    def run(df: DataFrame, est: Estimator, p: str) -> DataFrame:
        df = materialise(df)
        m = est.fit(df.where("split = 'train'"))
        return md.scored(m, df.where("split <> 'train'")).select("id", "split", "label", F.col("probs").alias(f"p{p}"), F.col("pred").alias(f"pred{p}"))

    sa, sb = run(a, model_a, "a"), run(b, model_b, "b").drop("split", "label")
    return materialise(sa.join(sb, "id").withColumn("agree", F.col("preda") == F.col("predb")))


def answer_evaluation(answers: DataFrame, labels: Sequence[str], classes: int, scores: DataFrame) -> DataFrame:
    """Parsed answers: share valid, accuracy, agreement with the text model, accuracy by agreement."""
    p = tk.match_label(answers, F.col("answer"), labels, "name")
    ids = F.create_map(*[F.lit(x) for i, n in enumerate(labels) for x in (n, i)])
    p = p.withColumn("answer_label", F.try_element_at(ids, F.col("name"))).select("id", "answer_label")
    j = scores.select("id", "label", "preda").join(p, "id")
    ok = F.col("answer_label").isNotNull()
    right = (F.col("answer_label") == F.col("label")).cast("int")
    same = F.col("answer_label") == F.col("preda")
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ok.cast("int")).alias("valid_share"),
        F.avg(F.when(ok, right)).alias("accuracy"),
        F.avg(F.when(ok, same.cast("int"))).alias("agree_rate"),
        F.avg(F.when(same, right)).alias("accuracy_agree"),
        F.avg(F.when(~same, right)).alias("accuracy_disagree"),
    )


def explanation_job(scores: DataFrame, alpha: float = 0.10) -> dict[str, DataFrame]:
    t = cf.conformal_run(scores, F.col("pa"), ["agree"], [alpha])
    e = ex.explain(t.withColumn("pset", pr.prediction_set(F.col("pa"), F.col("s0"))), alpha)
    return {"explanations": e, "summary": ex.summary(e)}


def defect_job(rows: DataFrame, resamples: int = 1000) -> dict[str, DataFrame]:
    """Binary triage of rows ``id, split, y, p``: sweeps, tiers, intervals, paired test."""
    t = rows.where("split = 'test'")
    y, p = F.col("y"), F.col("p")
    pred = pr.binary_predicted(p)
    return {
        "gate_sweep": gt.gate_sweep(t, y, p),
        "class_sweep": gt.class_sweep(t, y, p),
        "tiers": mt.tier_table(t, y, p),
        "ranking": mt.ranking_metrics(t, y, p),
        "accuracy_interval": rs.bootstrap_accuracy(t, F.col("id"), pred == y, resamples),
        "recall_interval": rs.bootstrap_recall(t, F.col("id"), y, pred, resamples),
        "paired": rs.mcnemar(t, pred == y, pr.binary_predicted(F.col("p2")) == y),
    }


def noise_job(df: DataFrame, features: Sequence[str], estimator: Estimator) -> DataFrame:
    """Noise classifier: recall of the noise class when rows are flagged at low thresholds.

    Rows carry id, split, label (1 = noise) and numeric features.
    """
    prep = md.preprocessor(numeric=features)
    train = df.where("split = 'train'")
    model = prep.fit(train)
    m = estimator.fit(model.transform(train))
    s = md.scored(m, model.transform(df.where("split = 'test'")))
    return gt.flag_recall(s, F.col("label"), F.get(F.col("probs"), F.lit(1)))


_SIZES = ["magnitude_abs", "magnitude_pct_abs", "value_mean", "value_ratio_abs"]


def _group_context(alerts: DataFrame) -> DataFrame:
    """Alerts with size, mean magnitude and number of platforms of their group; rows that come partitioned by it aren't shuffled."""
    w = Window.partitionBy("summary_id")
    known = F.col("summary_id").isNotNull()
    a = alerts.withColumns(tk.change_magnitudes(F.col("new_value"), F.col("prev_value")))
    a = a.withColumn("_r", F.dense_rank().over(w.orderBy(F.col("platform").asc_nulls_last())).cast("long"))
    return a.withColumns({
        "group_size": F.when(known, F.count(F.lit(1)).over(w)),
        "group_magnitude": F.when(known, F.avg("magnitude_abs").over(w)),
        "group_platforms": F.when(known, F.coalesce(F.max(F.when(F.col("platform").isNotNull(), F.col("_r"))).over(w), F.lit(0).cast("long"))),
    }).drop("_r")


def _series_context(a: DataFrame) -> DataFrame:
    return a.groupBy("series_id").agg(F.avg("magnitude_abs").alias("_m"), F.stddev_samp("magnitude_abs").alias("_s"))


def _series_z(a: DataFrame) -> DataFrame:
    z = F.coalesce(F.try_divide(F.col("magnitude_abs") - F.col("_m"), F.col("_s")), F.lit(0.0))
    return a.withColumn("series_z", z).drop("_m", "_s")


def _is_anomaly(a: DataFrame) -> DataFrame:
    return a.withColumn("is_anomaly", (F.abs("series_z") > 2).cast("int"))


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Direction-free alert features with group context (the unified feature table)."""
    a = _group_context(alerts)
    return _is_anomaly(_series_z(lookup_join(a, _series_context(a), ["series_id"], "left")))


def written_alert_rows(alerts: DataFrame) -> DataFrame:
    """``alert_rows`` written, without the columns that ``value_features`` finds again in the row itself.

    The rows are written after the join by group and after the one by series, and the copy before is deleted, so that
    the disk never holds the shuffle files of both.
    """
    a = materialise(_group_context(alerts).drop(*_SIZES), "zstd")
    sized = lambda df: df.withColumns(tk.change_magnitudes(F.col("new_value"), F.col("prev_value")))
    drop_shuffles(a.sparkSession)
    s = materialise(_series_context(sized(a)), "zstd")
    drop_shuffles(a.sparkSession)
    out = written_lookup(a, s, "series_id", lambda j: _series_z(sized(j)).drop(*_SIZES))
    release(a, s)
    return out


def value_features(rows: DataFrame) -> DataFrame:
    return _is_anomaly(rows.withColumns(tk.change_magnitudes(F.col("new_value"), F.col("prev_value"))))


ALERT_FEATURES = {
    "magnitude": _SIZES,
    "context": ["quantity", "group_size", "group_magnitude", "group_platforms"],
    "anomaly": ["series_z", "is_anomaly"],
}


def alert_classification(rows: DataFrame, models: dict[str, Estimator], features: Sequence[str]) -> DataFrame:
    """Train on 'train' rows and compare on 'test' rows (columns id, split, label, features); ``rows`` are read in each pass."""
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    prep = md.preprocessor(numeric=features).fit(train)
    return md.gauntlet(prep.transform(train).select("id", "label", "features"), prep.transform(test).select("id", "label", "features"), models)


def leave_one_group_out(rows: DataFrame, key: str, groups: Sequence, estimator: Estimator, features: Sequence[str]) -> DataFrame:
    """Accuracy on each group of a model trained on the others."""
    out = None
    for g in groups:
        train, test = sp.leave_group_out(rows, key, g)
        prep = md.preprocessor(numeric=features).fit(train)
        s = md.scored(estimator.fit(prep.transform(train)), prep.transform(test))
        m = mt.multiclass_metrics(s, "label", "pred").select(F.lit(g).alias(key), "accuracy", "f1_macro")
        out = m if out is None else out.unionByName(m)
    return out


def alert_cascade(train: DataFrame, test: DataFrame, stages: Sequence[tuple[md.ConfidenceStage, Column | None, dict[int, str]]]) -> DataFrame:
    """Fit every stage on its rows and route the test rows through the cascade."""
    scored, parts = test, []
    for stage, rows, routing in stages:
        stage.fit(train if rows is None else train.where(rows))
        scored = stage.predict(scored)
        parts.append(stage.as_cascade_stage(rows, routing))
    return gt.cascade(materialise(scored), parts)


def retrieval_over_k(test: DataFrame, train: DataFrame, ks: Sequence[int], cosine: bool = False) -> DataFrame:
    """Vote accuracy for several k from one neighbour search with the largest k."""
    nn = materialise(nb.knn_join(test, train, max(ks), cosine=cosine))
    out = None
    for k in ks:
        v = nb.weighted_vote(nn.where(F.col("rank") <= k), train.select("id", "label"), ["label"], cosine)
        j = v.join(test.select("id", "label"), "id")
        m = j.agg(F.lit(k).alias("k"), F.avg((F.col("pred_label") == F.col("label")).cast("int")).alias("accuracy"), F.avg("label_confidence").alias("mean_confidence"))
        out = m if out is None else out.unionByName(m)
    return out


def root_cause_job(alerts: DataFrame, order: Sequence[str], features: Sequence[str], k: int) -> dict[str, DataFrame]:
    """Clusters of alerts with profiles, coherence inside groups, and distances to the first alert."""
    prep = md.preprocessor(numeric=features)
    x = materialise(prep.fit(alerts).transform(alerts))
    c = materialise(md.kmeans_labels(x, k).drop("features"))
    from alertsieve.operators.clusters import cluster_profiles

    return {
        "profiles": cluster_profiles(c, "cluster", features, ["status"]),
        "coherence": al.cluster_coherence(c, "summary_id", "cluster"),
        "distances": al.downstream_distance(alerts, "summary_id", order, features),
    }


def three_stage_decisions(df: DataFrame) -> DataFrame:
    """Decision counts of a noise/severity/component cascade and how often all stages were right.

    Rows carry s0/s1/s2 ``_pred`` and ``_ok`` columns and the true noise, severity and label.
    """
    n0, ok0, ok1, ok2 = F.col("s0_pred"), F.col("s0_ok"), F.col("s1_ok"), F.col("s2_ok")
    decision = (
        F.when(~ok0, "review: noise unsure")
        .when(n0 == 1, "closed as noise")
        .when(~ok1, "review: severity unsure")
        .when(~ok2, "review: component unsure")
        .otherwise("routed")
    )
    right = F.when(decision == "closed as noise", F.col("noise") == 1).when(
        decision == "routed", (F.col("noise") == 0) & (F.col("s1_pred") == F.col("severity")) & (F.col("s2_pred") == F.col("label"))
    )
    g = df.groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("int")).alias("accuracy"))
    from alertsieve.operators.ordering import with_scalars

    return with_scalars(g, g.agg(F.sum("n").alias("_t"))).select("decision", "n", (F.col("n") / F.col("_t")).alias("share"), "accuracy")
