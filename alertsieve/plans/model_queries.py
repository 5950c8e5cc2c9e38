"""Queries that train models or run whole jobs."""

from __future__ import annotations

from pyspark.ml import classification as cl
from pyspark.ml import regression as rg
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from alertsieve.functions import probs as pr
from alertsieve.functions import tickets as tk
from alertsieve.functions.random import keyed_uniform
from alertsieve.functions.uncertainty import digamma_sql, dirichlet
from alertsieve.operators import conformal as cf
from alertsieve.operators import forecast as fc
from alertsieve.operators import gating as gt
from alertsieve.operators import metrics as mt
from alertsieve.operators import models as md
from alertsieve.operators import series as sr
from alertsieve.operators import splits as sp
from alertsieve.operators import text as tx
from alertsieve.operators.grid import steps
from alertsieve.operators.lookup import large_join
from alertsieve.operators.ordering import ordered
from alertsieve.plans import jobs
from alertsieve.plans import score_queries  # noqa: F401  registers the SQL that is used here
from alertsieve.plans.registry import ORACLE, R, query
from alertsieve.plans.ticket_queries import STOP, _weights
from alertsieve.plans.vector_queries import _NN, _VOTE, vectors
from alertsieve.session import materialise, release
from alertsieve.sources.tables import ALERTS_SQL, SCORES_SQL, TICKETS_SQL, alerts, documents, scores, series, table, tickets

TREES = 15
ROUNDS = 1000  # most iterations of a logistic model that is to be fitted until its loss no longer falls


def _all(spark, d, binary: bool = False):
    v = md.with_vectors(vectors(spark, d))
    if binary:
        v = v.withColumn("label", (F.col("label") < 3).cast("int"))
    return materialise(v)


def _halves(spark, d, binary: bool = False):
    v = _all(spark, d, binary)
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


def _forest(**kw):
    return cl.RandomForestClassifier(numTrees=TREES, maxDepth=6, seed=md.SEED, **kw)


# --- classifiers ---------------------------------------------------------------------------------------


@query("binary_classifiers")
def binary_classifiers(spark, d):
    return md.gauntlet(*_halves(spark, d, True), md.binary_models(TREES))


@query("multiclass_classifiers")
def multiclass_classifiers(spark, d):
    m = md.multiclass_models(TREES)
    return md.gauntlet(*_halves(spark, d), {k: m[k] for k in ("logistic", "forest")})


@query("one_vs_rest")
def one_vs_rest(spark, d):
    train, test = _halves(spark, d)
    ovr = cl.OneVsRest(classifier=cl.LogisticRegression(maxIter=20))
    return md.scored(ovr.fit(train), test).select("id", "pred", F.array_max("probs").alias("conf"))


@query("early_stopping")
def early_stopping(spark, d):
    train, test = _halves(spark, d, True)
    train = train.withColumn("is_val", keyed_uniform(F.col("id"), "val") < 0.2)
    gbt = md.binary_models(TREES, early_stop="is_val")["boosting"]
    return md.scored(gbt.fit(train), test).select("id", "pred", F.array_max("probs").alias("conf"))


@query("weighted_forest")
def weighted_forest(spark, d):
    train, test = _halves(spark, d, True)
    s = md.scored(_forest(weightCol="weight").fit(md.weighted(train)), test)
    return mt.binary_metrics(s, F.col("label"), F.col("pred"))


@query("soft_vote_ensemble")
def soft_vote_ensemble(spark, d):
    train, test = _halves(spark, d)
    tables = [md.scored(m.fit(train), test) for m in (_forest(), cl.LogisticRegression(maxIter=20))]
    v = md.soft_vote(tables).join(test.select("id", "label"), "id")
    return mt.multiclass_metrics(v, "label", "pred")


@query("out_of_fold_scores")
def out_of_fold_scores(spark, d):
    v = materialise(md.with_vectors(vectors(spark, d)).select("id", "label", "features"))
    o = md.out_of_fold(v, cl.LogisticRegression(maxIter=10), 5)
    return o.select("id", "fold", "pred", F.array_max("probs").alias("conf"))


@query("cross_validation")
def cross_validation(spark, d):
    v = materialise(md.with_vectors(vectors(spark, d)).select("id", "label", "features"))
    return md.cross_validate(v, cl.LogisticRegression(maxIter=10), 5)


@query("grid_search")
def grid_search(spark, d):
    return md.grid_search(_all(spark, d, True), cl.LogisticRegression(maxIter=10), {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]})[1]


@query("calibrated_probabilities")
def calibrated_probabilities(spark, d):
    train, test = _halves(spark, d)
    est = cl.LogisticRegression(maxIter=10)
    cal = md.fit_calibrator(md.out_of_fold(train.select("id", "label", "features"), est), 10)
    s = cal.apply(md.scored(est.fit(train), test))
    return s.select("id", F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("probs").alias("conf"), pr.predicted(F.col("probs")).alias("pred"))


@query("isotonic_calibration")
def isotonic_calibration(spark, d):
    train, test = _halves(spark, d, True)
    est = cl.LogisticRegression(maxIter=10)
    cal = md.fit_calibrator(md.out_of_fold(train.select("id", "label", "features"), est), 2, method="isotonic")
    s = cal.apply(md.scored(est.fit(train), test))
    return mt.reliability(s, F.col("label"), F.get(F.col("probs"), F.lit(1)))


@query("confidence_stage")
def confidence_stage(spark, d):
    train, test = _halves(spark, d)
    stage = md.ConfidenceStage("stage", cl.LogisticRegression(maxIter=10), 10, target=0.7, margin=0.05).fit(train.select("id", "label", "features"))
    return stage.predict(test).select("id", "label", "stage_pred", "stage_conf", "stage_ok")


@query("positive_weight_search")
def positive_weight_search(spark, d):
    return md.positive_weight_search(_all(spark, d, True).select("id", "label", "features"), lambda w: cl.LogisticRegression(maxIter=5, weightCol=w))


@query("stacking")
def stacking(spark, d):
    train, test = _halves(spark, d, True)
    bases = {"forest": _forest(), "logistic": cl.LogisticRegression(maxIter=10)}
    s = md.stacking(train.select("id", "label", "features"), test.select("id", "label", "features"), bases, cl.GBTClassifier(maxIter=5, seed=md.SEED), k=5)
    return mt.binary_metrics(s, F.col("label"), F.col("pred"))


@query("permutation_importance")
def permutation_importance(spark, d):
    v = materialise(vectors(spark, d).select("id", "v", (F.col("label") < 3).cast("int").alias("label")))
    m = _forest().fit(md.with_vectors(v.where("id % 2 = 0")))
    return md.permutation_importance(m, v.where("id % 2 = 1"), 64)


@query("tree_importance")
def tree_importance(spark, d):
    imp = _forest().fit(_all(spark, d, True)).featureImportances
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(imp.toArray())], "feature int, importance double").orderBy(F.desc("importance"), "feature")


@query("feature_selection")
def feature_selection(spark, d):
    from pyspark.ml.feature import UnivariateFeatureSelector

    train, test = _halves(spark, d)
    s = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="chosen", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(10)
    from pyspark.ml.functions import vector_to_array

    return s.fit(train).transform(test).select("id", F.size(vector_to_array("chosen")).alias("n_features"), vector_to_array("chosen")[0].alias("first"))


@query(
    "mutual_information",
    """WITH f AS (SELECT label AS y, 'f' || (k-1) AS feature, embedding[k]::DOUBLE AS x FROM embeddings, range(1, 65) r(k)), r AS (SELECT *, min(x) OVER (PARTITION BY feature) AS lo, max(x) OVER (PARTITION BY feature) AS hi FROM f),
b AS (SELECT feature, y, least(floor((x-lo)/(hi-lo)*10),9) AS bin FROM r), n AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nt FROM n) """
    + f"SELECT feature, {R('sum(n/nt*ln(n*nt/(nb*ny)))')} AS mutual_information FROM m GROUP BY feature",
)
def mutual_information(spark, d):
    v = vectors(spark, d).select("label", *[F.col("v")[i].alias(f"f{i}") for i in range(64)])
    return md.mutual_information(v, [f"f{i}" for i in range(64)], "label")


@query("pca_projection")
def pca_projection(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = md.with_vectors(vectors(spark, d))
    p = vector_to_array("p")
    return PCA(k=2, inputCol="features", outputCol="p").fit(v).transform(v).select("id", p[0].alias("x"), p[1].alias("y"))


@query("kmeans_profiles")
def kmeans_profiles(spark, d):
    from alertsieve.operators.clusters import cluster_profiles

    v = md.kmeans_labels(md.with_vectors(vectors(spark, d)), 5).select("cluster", "label", *[F.col("v")[i].alias(f"x{i}") for i in range(64)])
    return cluster_profiles(v, "cluster", [f"x{i}" for i in range(64)], ["label"])


@query("kmeans_search")
def kmeans_search(spark, d):
    return md.kmeans_search(materialise(md.with_vectors(vectors(spark, d)).select("features")), [2, 4, 6])


@query(
    "rank_normal",
    "WITH f AS (SELECT vec_id AS id, k-1 AS feature, embedding[k]::DOUBLE AS x FROM embeddings, range(1, 65) r(k)), p AS (SELECT id, feature, (row_number() OVER (PARTITION BY feature ORDER BY x, id) - 0.5) / count(*) OVER (PARTITION BY feature) AS u FROM f) "
    + f"SELECT id, feature::INT AS feature, {R(md.probit_sql('u'))} AS value FROM p",
)
def rank_normal(spark, d):
    """All dimensions, as id, feature, value."""
    v = vectors(spark, d).select("id", *[F.col("v")[i].alias(f"x{i}") for i in range(64)])
    z = md.rank_normal(v, [f"x{i}" for i in range(64)])
    return z.select("id", F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"x{i}").alias("value")) for i in range(64)])))


# --- text ----------------------------------------------------------------------------------------------------


def _text_model(spark, d):
    doc = documents(spark, d).select(F.col("doc_id").alias("id"), "text", "lang", "source")
    m = md.text_vectoriser(doc, "text", 300, 2, STOP)
    return doc, m


@query("tfidf_vectors")
def tfidf_vectors(spark, d):
    from pyspark.ml.functions import vector_to_array

    doc, m = _text_model(spark, d)
    a = vector_to_array("text_vec")
    return m.transform(doc).select("id", F.size(F.filter(a, lambda x: x != 0)).alias("n_terms"), F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x).alias("norm"))


@query("lda_topics")
def lda_topics(spark, d):
    doc, m = _text_model(spark, d)
    t = md.lda_topics(m.transform(doc), m.stages[0].stages[-1].vocabulary, 4, 6)
    return t.select("topic", F.array_join("terms", ",").alias("terms"))


@query("nmf_topics")
def nmf_topics(spark, d):
    return md.nmf_topics(_weights(spark, d), 4, 6)


@query("text_clusters")
def text_clusters(spark, d):
    doc, m = _text_model(spark, d)
    x = materialise(m.transform(doc).select("lang", F.col("text_vec").alias("features")))
    c = md.kmeans_labels(x, 4)
    return c.groupBy("cluster", "lang").agg(F.count(F.lit(1)).alias("n"))


# --- forecasting with one pooled model ------------------------------------------------------------------------


@query("pooled_lag_forecast")
def pooled_lag_forecast(spark, d):
    s = sr.prepare_signal(series(spark, d)).withColumn("value", F.col("signal")).drop("signal")
    rows = materialise(sr.lag_matrix(s, 5))
    m = fc.pooled_lag_model(rows, 5, rg.RandomForestRegressor(numTrees=10, maxDepth=5, seed=md.SEED))
    last = rows.groupBy("series_id").agg(*[F.max_by(c, F.struct("ts", "eid")).alias(c) for c in [f"lag_{i}" for i in range(1, 6)]])
    f = fc.iterate_lag_model(m, last, 5, 3)
    return f.select("series_id", *[F.col("forecast")[i].alias(f"h{i + 1}") for i in range(3)])


# --- jobs ---------------------------------------------------------------------------------------------------------


_SEG = "seg AS (SELECT t.*, c_mktsegment AS component FROM tickets t JOIN customer ON creator=c_custkey WHERE t.resolution <> 'F')"


@query(
    "prepare_tickets",
    "WITH " + TICKETS_SQL + ", " + _SEG + """, o AS (SELECT *, row_number() OVER (ORDER BY ts, id)-1 AS r, count(*) OVER () AS n FROM seg), s AS (SELECT *, CASE WHEN r < floor(n*0.6) THEN 'train' WHEN r < floor(n*0.8) THEN 'cal' ELSE 'test' END AS split FROM o),
m AS (SELECT component, row_number() OVER (ORDER BY component)-1 AS label FROM (SELECT component FROM s WHERE split='train' GROUP BY component ORDER BY count(*) DESC, component LIMIT 3)) SELECT split, coalesce(label,3)::INT AS label, CASE WHEN label IS NULL THEN 'Other' ELSE s.component END AS component_mapped, count(*) AS n, min(id) AS first_id FROM s LEFT JOIN m USING (component) GROUP BY ALL""",
)
def prepare_tickets(spark, d):
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("creator"), F.col("c_mktsegment").alias("component"))
    t = materialise(large_join(tickets(spark, d), seg, "creator"))  # read by each pass that looks for a cut
    res = F.when(F.col("resolution") == "F", "WontFix").otherwise("FIXED")
    p = jobs.prepare_tickets(t, res, "component", ["ts", "id"], 3)
    return p.groupBy("split", "label", "component_mapped").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def _doc_split(df):
    u = keyed_uniform(F.col("id"), "docs")
    return df.withColumn("split", F.when(u < 0.6, "train").when(u < 0.8, "cal").otherwise("test"))


def doc_scores(spark, d):
    """Text model on TF-IDF and metadata model on lengths and flags, class = language."""
    doc, m = _text_model(spark, d)
    langs = tx.bounded_labels(doc, "lang")
    ids = F.create_map(*[F.lit(x) for i, n in enumerate(langs) for x in (n, i)])
    doc = _doc_split(doc.withColumn("label", F.element_at(ids, F.col("lang"))))
    a = m.transform(doc).withColumnRenamed("text_vec", "features").select("id", "split", "label", "features")
    flags = {k: v.cast("double") for k, v in {**tk.quality_flags(F.col("text")), "n_chars": F.length("text")}.items()}
    meta = materialise(doc.select("id", "split", "label", "source", *[v.alias(k) for k, v in flags.items()]))
    prep = md.preprocessor(numeric=list(flags), categorical=["source"]).fit(meta.where("split = 'train'"))
    b = prep.transform(meta).select("id", "split", "label", "features")
    return jobs.train_two_models(a, b, cl.LogisticRegression(maxIter=10), _forest(maxBins=64))


@query("agreement_run")
def agreement_run(spark, d):
    """Two trained models, then agreement-conditioned sets with the hybrid routing."""
    s = doc_scores(spark, d)
    r = cf.agreement_report(cf.conformal_run(s, cf.hybrid_probs("pa", "pb"), ["agree"], [0.05, 0.10]), [0.05, 0.10])
    return r


@query("channel_ablation")
def channel_ablation(spark, d):
    """Text and metadata channels alone and together."""
    s = doc_scores(spark, d).where("split = 'test'")
    both = s.withColumn("pred", pr.predicted(F.zip_with("pa", "pb", lambda a, b: (a + b) / 2.0)))
    out = None
    for name, df in (("text", s.withColumn("pred", F.col("preda"))), ("metadata", s.withColumn("pred", F.col("predb"))), ("full", both)):
        m = mt.multiclass_metrics(df, "label", "pred").select(F.lit(name).alias("channel"), "accuracy", "f1_macro")
        out = m if out is None else out.unionByName(m)
    return out


@query("incident_routing")
def incident_routing(spark, d):
    """Incidents from an event log, one classifier, conformal sets."""
    from alertsieve.sources.readers import roll_up_events

    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.col("event_type").alias("state"), "value")
    inc = roll_up_events(e, "id", "ts", ["ts", "event_id"], ["state"]).join(e.groupBy("id").agg(F.avg("value").alias("mean_value"), F.max("value").alias("max_value")), "id")
    names = tx.bounded_labels(inc, "final_state")
    ids = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    inc = materialise(sp.temporal_split(inc.withColumn("label", F.element_at(ids, F.col("final_state"))), ["opened_at", "id"], [0.6, 0.2, 0.2], ["train", "cal", "test"]))
    prep = md.preprocessor(numeric=["n_events", "mean_value", "max_value"]).fit(inc.where("split = 'train'"))
    x = prep.transform(inc)
    s = materialise(md.scored(_forest().fit(x.where("split = 'train'")), x.where("split <> 'train'")).select("id", "split", "label", F.col("probs").alias("p")))
    s = s.withColumn("p", pr.pad(F.col("p"), len(names)))
    return cf.set_metrics(cf.conformal_run(s, F.col("p"), [], [0.1, 0.2]), [0.1, 0.2])


@query(
    "answer_evaluation",
    "WITH " + SCORES_SQL + f""", a AS (SELECT *, CASE WHEN id%5=0 THEN NULL ELSE predb END AS ans FROM scores) SELECT count(*) AS n, {R('avg((ans IS NOT NULL)::INT)')} AS valid_share, {R('avg((ans=label)::INT)')} AS accuracy, {R('avg((ans=preda)::INT)')} AS agree_rate, {R('avg((ans=label)::INT) FILTER (WHERE ans=preda)')} AS accuracy_agree, {R('avg((ans=label)::INT) FILTER (WHERE ans<>preda)')} AS accuracy_disagree FROM a""",
)
def answer_evaluation(spark, d):
    s = scores(spark, d)
    names = [f"Component {c}" for c in "ABCDEFGHIJ"]
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("predb"))
    text = F.when(F.col("id") % 5 == 0, "no idea").when(F.col("id") % 5 == 1, F.upper(name)).when(F.col("id") % 5 == 2, F.concat(F.lit("It is "), name, F.lit("!"))).otherwise(F.concat(F.lit(" '"), name, F.lit("' ")))
    return jobs.answer_evaluation(s.select("id", text.alias("answer")), names, 10, s)


@query("noise_experiment")
def noise_experiment(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.lit(1) - F.col("quality")).alias("label"))
    doc = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    flags = {k: v.cast("double") for k, v in {**tk.quality_flags(F.col("text")), "n_chars": F.length("text")}.items()}
    df = materialise(_doc_split(doc.select("id", *[v.alias(k) for k, v in flags.items()]).join(lab, "id")))
    return jobs.noise_job(df, list(flags), _forest())


_UF = """a AS (SELECT *, abs(new_value-prev_value) AS m FROM alerts), g AS (SELECT summary_id, count(*) AS group_size, avg(m) AS group_magnitude, count(DISTINCT platform) AS group_platforms FROM a GROUP BY summary_id), s AS (SELECT series_id, avg(m) AS sm, stddev_samp(m) AS ss FROM a GROUP BY series_id)"""


@query(
    "unified_features",
    "WITH " + ALERTS_SQL + ", " + _UF + f" SELECT summary_id, line, series_id, platform, {R('m')} AS magnitude_abs, group_size, {R('group_magnitude*group_size')} AS group_total_magnitude, group_platforms, {R('coalesce((m-sm)/nullif(ss,0),0)')} AS series_z, (abs(coalesce((m-sm)/nullif(ss,0),0)) > 2)::INT AS is_anomaly FROM a JOIN g USING (summary_id) JOIN s USING (series_id)",
)
def unified_features(spark, d):
    return jobs.alert_rows(alerts(spark, d)).select("summary_id", "line", "series_id", "platform", "magnitude_abs", "group_size", (F.col("group_magnitude") * F.col("group_size")).alias("group_total_magnitude"), "group_platforms", "series_z", "is_anomaly")


def _alert_rows(spark, d):
    """Unified alert rows with a unique id and a time split; class = status.

    Each step writes only what later ones need and deletes what it read.
    """
    codes = F.when(F.col("status") == "A", 0).when(F.col("status") == "N", 1).otherwise(2)
    order = ["ts", "summary_id", "line", "series_id", "platform", "new_value", "prev_value"]
    r = jobs.written_alert_rows(alerts(spark, d).select(*order, "quantity", "lower_is_better", codes.alias("label")))
    o = ordered(r, [], order, portions=True)
    placed = o.with_position("id").result()
    if not o.split:
        placed = o.written = materialise(placed, "zstd")
    release(r)
    kept = ["id", "split", "label", "new_value", "prev_value", "quantity", "lower_is_better", "group_size", "group_magnitude", "group_platforms", "series_z"]
    t = materialise(sp.temporal_split(placed, ["ts", "id"], [0.8, 0.2], ["train", "test"]).select(kept), "zstd")
    release(o.written)
    return jobs.value_features(t)


@query("alert_classification")
def alert_classification(spark, d):
    every = [c for g in jobs.ALERT_FEATURES.values() for c in g]
    return jobs.alert_classification(_alert_rows(spark, d), {"logistic": cl.LogisticRegression(maxIter=5), "forest": _forest()}, every)


@query("feature_group_ablation")
def feature_group_ablation(spark, d):
    from pyspark.ml import Pipeline

    r = _alert_rows(spark, d)
    every = [c for g in jobs.ALERT_FEATURES.values() for c in g]
    train, test = md.scaled_columns(r.where("split = 'train'"), r.where("split = 'test'"), every)
    return md.ablation(train, test, jobs.ALERT_FEATURES, lambda cols: Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep"), cl.LogisticRegression(maxIter=ROUNDS)]))


@query("leave_one_group_out_models")
def leave_one_group_out_models(spark, d):
    r = _alert_rows(spark, d).withColumn("segment", F.when(F.col("lower_is_better"), "down").otherwise("up"))
    every = [c for g in jobs.ALERT_FEATURES.values() for c in g]
    return jobs.leave_one_group_out(r, "segment", ["down", "up"], cl.LogisticRegression(maxIter=ROUNDS), every)


@query("alert_cascade")
def alert_cascade(spark, d):
    """Invalid gate, then a class stage for what is not invalid; unsure rows are deferred."""
    train, test = _halves(spark, d)
    train, test = train.select("id", "label", "features"), test.select("id", "label", "features")
    first = md.ConfidenceStage("invalid", cl.LogisticRegression(maxIter=5), 2, target=0.8, label="y")
    second = md.ConfidenceStage("kind", cl.LogisticRegression(maxIter=5), 10, target=0.6)
    y = (F.col("label") < 3).cast("int")
    out = jobs.alert_cascade(train.withColumn("y", y), test.withColumn("y", y), [(first, None, {0: "next", 1: "terminal"}), (second, None, {})])
    return gt.cascade_curve(out.withColumn("truth", F.when(F.col("final_stage") == "invalid", F.col("y")).otherwise(F.col("label"))), "truth")


@query("retrieval_over_k", _NN.format(k=10) + ", ".join([""] + [f"b{k} AS (WITH j AS (SELECT nn.id, l.label, sum(1/(d+1e-6)) AS s FROM nn JOIN v l ON l.id=nn.nid WHERE rank <= {k} GROUP BY ALL) SELECT id, arg_min(label, (-round(s,9), label)) AS pred_label, max(s)/sum(s) AS conf FROM j GROUP BY id)" for k in (1, 3, 5, 7, 10)]) + " " + " UNION ALL ".join(f"SELECT {k} AS k, {R('avg((pred_label=label)::INT)')} AS accuracy, {R('avg(conf)')} AS mean_confidence FROM b{k} JOIN v USING (id)" for k in (1, 3, 5, 7, 10)))
def retrieval_over_k(spark, d):
    v = vectors(spark, d)
    return jobs.retrieval_over_k(v.where("id % 2 = 1"), v.where("id % 2 = 0"), [1, 3, 5, 7, 10])


@query("root_cause_profiles")
def root_cause_profiles(spark, d):
    from alertsieve.plans.ticket_queries import ORD

    a = alerts(spark, d)
    return jobs.root_cause_job(a, [*ORD, "quantity"], ["new_value", "prev_value", "quantity"], 4)["profiles"]


_DU = "WITH " + SCORES_SQL + f""", a AS (SELECT id, preda=label AS ok, ca, [1.0::DOUBLE + 20.0::DOUBLE*x for x in pa] AS al FROM scores), s AS (SELECT id, ok, ca, list_sum(al) AS s, unnest(al) AS x FROM a),
g AS (SELECT id, ok, ca, max(s) AS s, -sum(x/s*ln(x/s+1e-10)) AS tot, sum(-x/s*{digamma_sql('(x+1.0::DOUBLE)')}) AS i FROM s GROUP BY ALL), u AS (SELECT id, ok, 1-ca AS confidence, tot AS total, tot - (i + {digamma_sql('(s+1.0::DOUBLE)')}) AS epistemic FROM g),
l AS (UNPIVOT u ON confidence, total, epistemic INTO NAME measure VALUE x), o AS (SELECT measure, ok, row_number() OVER (PARTITION BY measure ORDER BY x, id) AS r, count(*) OVER (PARTITION BY measure) AS n FROM l), gr(coverage) AS (VALUES (0.5::DOUBLE),(0.7::DOUBLE),(0.9::DOUBLE)) """


@query("uncertainty_comparison", _DU + f"SELECT measure, coverage, {R('avg(ok::INT)')} AS accuracy FROM o, gr WHERE r <= floor(n*coverage) GROUP BY ALL")
def uncertainty_comparison(spark, d):
    """Accuracy of the most certain rows by three uncertainty measures."""
    s = scores(spark, d)
    s = s.withColumn("alpha", F.transform("pa", lambda x: F.lit(1.0) + F.lit(20.0) * x))
    s = s.withColumn("st", F.aggregate("alpha", F.lit(0.0), lambda a, x: a + x))
    u = dirichlet(F.col("alpha"), F.col("st"))
    s = s.withColumns({"confidence": F.lit(1.0) - pr.confidence(F.col("pa")), "total": u["total"], "epistemic": u["epistemic"]})
    out = None
    for m in ("confidence", "total", "epistemic"):
        a = mt.accuracy_at_coverage(s, F.col("preda") != F.col("label"), -F.col(m), [0.5, 0.7, 0.9]).select(F.lit(m).alias("measure"), "coverage", "accuracy")
        out = a if out is None else out.unionByName(a)
    return out


@query("conformal_job", ORACLE["raps_single_model"])
def conformal_job(spark, d):
    return jobs.conformal_job(scores(spark, d), "pa")["metrics"]


@query("threshold_grid_steps")
def threshold_grid_steps(spark, d):
    """Stage accuracy over a coarse grid for each predicted class."""
    s = scores(spark, d)
    return gt.coverage_curve(s, F.col("preda") == F.col("label"), pr.confidence(F.col("pa")), steps(0.2, 0.9, 0.1), ["preda"])


# --- ticket cascade in three stages, series features against metadata, routing side study -----------------------


@query("ticket_cascade")
def ticket_cascade(spark, d):
    """Noise, then severity, then component: only confident rows go on, a row is right if all stages are."""
    train, test = _halves(spark, d)
    y = {"noise": (F.col("label") == 9).cast("int"), "severity": (F.col("label") % 3).cast("int")}
    cols = ["id", "label", "features", *y]
    train, test = train.withColumns(y).select(cols), test.withColumns(y).select(cols)
    est = cl.LogisticRegression(maxIter=5)
    noise = md.ConfidenceStage("s0", est, 2, target=0.8, label="noise").fit(train)
    severity = md.ConfidenceStage("s1", est, 3, target=0.5, label="severity").fit(train.where("noise = 0"))
    component = md.ConfidenceStage("s2", est, 10, target=0.4, label="label").fit(train.where("noise = 0"))
    out = component.predict(severity.predict(noise.predict(test)))
    return jobs.three_stage_decisions(materialise(out))


@query("series_vs_metadata")
def series_vs_metadata(spark, d):
    """Ablation of series features and alert metadata."""
    from pyspark.ml import Pipeline

    w = sr.all_features(sr.pre_windows(series(spark, d).withColumnRenamed("eid", "id"), F.col("kind") == "error", 20, order=("ts", "id")))
    groups = {"local_stats": sr.FEATURE_GROUPS["local_stats"], "change": ["ts_change_abs", "ts_zscore"], "stability": sr.FEATURE_GROUPS["stability"], "metadata": ["open_hour", "open_dayofweek"]}
    every = [c for g in groups.values() for c in g]
    w = w.withColumns(tk.calendar_features(F.col("ts"))).withColumn("label", (F.col("value") > 50).cast("int"))
    w = materialise(sp.temporal_split(w.select("id", "ts", "label", *[F.col(c).cast("double").alias(c) for c in every]), ["ts", "id"], [0.8, 0.2], ["train", "test"]))
    return md.ablation(w.where("split = 'train'"), w.where("split = 'test'"), groups, lambda cols: Pipeline(stages=[md.preprocessor(numeric=cols), cl.LogisticRegression(maxIter=3)]))


@query("routing_side_study")
def routing_side_study(spark, d):
    """Ticket routing with history profiles of the creator: accuracy before and after."""
    from alertsieve.operators import categories as ct

    t = sp.temporal_split(tickets(spark, d), ["ts", "id"], [0.8, 0.2], ["train", "test"])
    codes = F.create_map(*[F.lit(x) for i, n in enumerate(["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"]) for x in (n, i)])
    t = materialise(t.withColumn("label", F.element_at(codes, F.col("severity"))))
    train = t.where("split = 'train'")
    x = ct.profile_features(ct.entity_profile(train, "creator", "severity"), t, "creator", 5)
    x = ct.entity_mean(train, x, "creator", "value")
    x = materialise(x.withColumns({k: v.cast("double") for k, v in tk.calendar_features(F.col("ts")).items()}))
    before = ["value", "open_dayofweek", "open_month"]
    after = [*before, "profile_entropy", "profile_max", "profile_known", "value_mean", "value_diff"]
    out = None
    for name, cols in (("before", before), ("after", after)):
        m = jobs.alert_classification(x, {name: cl.LogisticRegression(maxIter=5)}, cols).where(F.col("model") == name).select("model", "accuracy", "f1_macro")
        out = m if out is None else out.unionByName(m)
    return out
