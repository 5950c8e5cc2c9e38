"""Classifiers, calibration, out-of-fold scores and model studies on MLlib.

A model here is any MLlib estimator with ``featuresCol``/``labelCol`` and a probability output.
Scored tables carry ``probs array<double>``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml import classification as cl
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Imputer, NGram, Normalizer, OneHotEncoder, RegexTokenizer, StandardScaler, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.functions import probs as pr
from alertsieve.functions.random import keyed_uniform
from alertsieve.operators import gating as gt
from alertsieve.operators import metrics as mt
from alertsieve.operators.categories import class_weights
from alertsieve.operators.lookup import lookup_join
from alertsieve.operators.ordering import ordered
from alertsieve.operators.splits import folds
from alertsieve.session import materialise

# --- preprocessing -----------------------------------------------------------------------------------


def preprocessor(numeric: Sequence[str] = (), categorical: Sequence[str] = (), vectors: Sequence[str] = (), one_hot: bool = False, scale: bool = True) -> Pipeline:
    """Impute, index and scale on the training rows only; the result is column ``features``."""
    stages: list = []
    parts: list[str] = []
    if numeric:
        stages.append(Imputer(inputCols=list(numeric), outputCols=[f"{c}_imp" for c in numeric], strategy="median"))
        stages.append(VectorAssembler(inputCols=[f"{c}_imp" for c in numeric], outputCol="_num"))
        if scale:
            stages.append(StandardScaler(inputCol="_num", outputCol="_numz", withMean=True, withStd=True))
        parts.append("_numz" if scale else "_num")
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_idx" for c in categorical], stringOrderType="alphabetAsc", handleInvalid="keep"))
        if one_hot:
            stages.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], dropLast=True))
        parts += [f"{c}_hot" if one_hot else f"{c}_idx" for c in categorical]
    stages.append(VectorAssembler(inputCols=[*parts, *vectors], outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def text_vectoriser(df: DataFrame, text: str, max_features: int = 500, min_df: int = 2, stop_words: Sequence[str] | None = None) -> PipelineModel:
    """TF-IDF of words and word pairs with smooth idf and unit length, output ``text_vec``.

    MLlib's own idf lacks the constant 1, so the weights are put in by an element-wise product.
    For 1 + ln(tf) use ``operators.text.tfidf``. The vocabulary (ties by name) and its document counts come from one
    aggregate, as the estimator of MLlib keeps the terms of all texts as objects in memory.
    """
    from alertsieve.operators.text import corpus_vocabulary, english_stop_words

    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    stop = StopWordsRemover(inputCol="_tok", outputCol="_stop", stopWords=list(stop_words if stop_words is not None else english_stop_words()))
    pairs = NGram(n=2, inputCol="_stop", outputCol="_pairs")
    from pyspark.ml.feature import SQLTransformer

    both = SQLTransformer(statement="SELECT *, concat(_stop, _pairs) AS _terms FROM __THIS__")
    cut = PipelineModel(stages=[tok, stop, pairs, both])
    rows = corpus_vocabulary(cut.transform(df.select(text)).select(F.col("_terms").alias("t")), df.count(), max_features, min_df, 1.0).collect()  # at most max_features rows
    count = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], "_terms", "_tf")
    fitted = PipelineModel(stages=[*cut.stages, count])
    idf = [r["idf"] for r in rows]
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w")
    tail: list[Transformer] = [weigh, Normalizer(p=2.0, inputCol="_w", outputCol="text_vec")]
    return PipelineModel(stages=[fitted, *tail])


# --- classifiers -----------------------------------------------------------------------------------------

SEED = 42


def binary_models(trees: int = 100, early_stop: str | None = None) -> dict[str, Estimator]:
    gbt = cl.GBTClassifier(maxIter=trees, maxDepth=5, seed=SEED)
    if early_stop:
        gbt = gbt.setValidationIndicatorCol(early_stop)
    return {
        "logistic": cl.LogisticRegression(maxIter=100),
        "forest": cl.RandomForestClassifier(numTrees=trees, maxDepth=10, seed=SEED),
        "boosting": gbt,
    }


def multiclass_models(trees: int = 100) -> dict[str, Estimator]:
    return {
        "logistic": cl.LogisticRegression(maxIter=100, family="multinomial"),
        "forest": cl.RandomForestClassifier(numTrees=trees, maxDepth=10, seed=SEED),
        "one_vs_rest": cl.OneVsRest(classifier=cl.GBTClassifier(maxIter=max(trees // 5, 5), maxDepth=5, seed=SEED)),
    }


def scored(model, df: DataFrame) -> DataFrame:
    """Add ``probs`` and ``pred``; a one-vs-rest model gives its scores as a softmax."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:
        e = F.transform(vector_to_array("rawPrediction"), lambda x: F.exp(x))
        p = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))
    out = out.withColumn("probs", p).drop("probability", "rawPrediction", "prediction")
    return out.withColumn("pred", pr.predicted(F.col("probs")))


def with_vectors(df: DataFrame, v: str = "v") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(v).cast("array<double>")))


def weighted(df: DataFrame, y: str = "label", cap: float | None = 10.0) -> DataFrame:
    return lookup_join(df, class_weights(df, y, cap).select(y, "weight"), [y], "left")


def soft_vote(tables: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Mean of the probability vectors of several score tables."""
    out = tables[0].select(key, F.col("probs").alias("_s"))
    for t in tables[1:]:
        out = out.join(t.select(key, "probs"), key).select(key, F.zip_with("_s", "probs", lambda a, b: a + b).alias("_s"))
    out = out.select(key, F.transform("_s", lambda x: x / float(len(tables))).alias("probs"))
    return out.withColumn("pred", pr.predicted(F.col("probs")))


def out_of_fold(df: DataFrame, estimator: Estimator, k: int = 5, label: str = "label", key: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Scores of every row by a model that did not see it: ``key, label, fold, probs, pred``."""
    f = materialise(folds(df, label, key, k))
    out = None
    for i in range(k):
        m = estimator.fit(f.where(F.col("fold") != i))
        s = scored(m, f.where(F.col("fold") == i)).select(key, label, "fold", "probs", "pred", *keep)
        out = s if out is None else out.unionByName(s)
    return materialise(out)


def cross_validate(df: DataFrame, estimator: Estimator, k: int = 5, label: str = "label") -> DataFrame:
    """Accuracy and macro F1 per fold."""
    oof = out_of_fold(df, estimator, k, label)
    out = None
    for i in range(k):
        m = mt.multiclass_metrics(oof.where(F.col("fold") == i), label, "pred").select("accuracy", "f1_macro").withColumn("fold", F.lit(i))
        out = m if out is None else out.unionByName(m)
    return out


def gauntlet(train: DataFrame, test: DataFrame, models: dict[str, Estimator], label: str = "label") -> DataFrame:
    """Accuracy and macro/weighted F1 of each model and of the majority class, best first."""
    out = None
    for name, est in models.items():
        s = scored(est.fit(train), test)
        m = mt.multiclass_metrics(s, label, "pred").withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    top = train.groupBy(label).count().orderBy(F.desc("count"), label).first()[label]
    base = mt.multiclass_metrics(test.withColumn("pred", F.lit(top)), label, "pred").withColumn("model", F.lit("majority"))
    return out.unionByName(base).orderBy(F.desc("accuracy"), "model")


def scaled_columns(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str = "label") -> tuple[DataFrame, DataFrame]:
    """The label and each column imputed and scaled as ``preprocessor`` does it, fitted once on the training rows.

    Each column is imputed and scaled by itself, so models of any of them find the values that a preprocessor of their own would give.
    They are plain expressions over the rows, so nothing is written and each model computes only the columns that it needs.
    """
    imputer, _, scaler, _ = preprocessor(numeric=cols).fit(train).stages
    mean, std = scaler.mean.toArray(), scaler.std.toArray()

    def done(df: DataFrame) -> DataFrame:
        z = [((F.col(f"{c}_imp").cast("double") - float(m)) * (1.0 / float(s) if s else 0.0)).alias(c) for c, m, s in zip(cols, mean, std)]
        return imputer.transform(df).select(label, *z)

    return done(train), done(test)


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, Sequence[str]], build: Callable[[Sequence[str]], Estimator], label: str = "label") -> DataFrame:
    """Accuracy with all feature groups, with each group alone and without each group."""
    every = [c for g in groups.values() for c in g]
    runs = {"full": every}
    for n, g in groups.items():
        runs[f"only {n}"] = list(g)
        if len(groups) > 1:
            runs[f"without {n}"] = [c for c in every if c not in g]
    out = None
    for n, cols in runs.items():
        m = mt.multiclass_metrics(scored(build(cols).fit(train), test), label, "pred").select(F.lit(n).alias("features"), F.lit(len(cols)).alias("n_features"), "accuracy", "f1_macro")
        out = m if out is None else out.unionByName(m)
    full = materialise(out)
    base = full.where("features = 'full'").first()["accuracy"]
    return full.withColumn("delta", F.col("accuracy") - F.lit(base))


def grid_search(train: DataFrame, estimator: Estimator, grid: dict[str, Sequence], label: str = "label", share: float = 0.8):
    """Best parameters by a train/validation split over all combinations."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    tv = TrainValidationSplit(estimator=estimator, estimatorParamMaps=b.build(), evaluator=ev, trainRatio=share, seed=SEED, parallelism=4)
    fitted = tv.fit(train)
    rows = [tuple([*(float(m[estimator.getParam(n)]) for n in grid), float(s)]) for m, s in zip(tv.getEstimatorParamMaps(), fitted.validationMetrics)]
    return fitted.bestModel, train.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in [*grid, "f1"]))


def positive_weight_search(df: DataFrame, build: Callable[[str], Estimator], label: str = "label", multiples: Sequence[float] = (0.75, 1.0, 1.25, 1.5, 2.0)) -> DataFrame:
    """Out-of-fold F1 of the positive class for multiples of the negative/positive ratio."""
    r = df.agg((F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).alias("r")).first()["r"]
    out = None
    for m in multiples:
        w = df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(m * r))).otherwise(1.0))
        oof = out_of_fold(w, build("weight"), label=label)
        x = mt.binary_metrics(oof, F.col(label), F.col("pred")).select(F.lit(float(m)).alias("multiple"), F.lit(float(m * r)).alias("weight"), "precision", "recall", "f1")
        out = x if out is None else out.unionByName(x)
    return out.orderBy(F.desc("f1"), "multiple")


def stacking(train: DataFrame, test: DataFrame, bases: dict[str, Estimator], meta: Estimator, k: int = 5, label: str = "label") -> DataFrame:
    """Meta model on out-of-fold base scores; test scores are the mean of the fold models."""
    f = materialise(folds(train, label, "id", k))
    tr, te = train.select("id", label), test.select("id", label)
    names = []
    for name, est in bases.items():
        oof, on_test = None, []
        for i in range(k):
            m = est.fit(f.where(F.col("fold") != i))
            s = scored(m, f.where(F.col("fold") == i)).select("id", F.col("probs").alias(name))
            oof = s if oof is None else oof.unionByName(s)
            on_test.append(scored(m, test).select("id", "probs"))
        tr = tr.join(oof, "id")
        te = te.join(soft_vote(on_test).select("id", F.col("probs").alias(name)), "id")
        names.append(name)

    def assemble(df: DataFrame) -> DataFrame:
        return materialise(df.withColumn("features", array_to_vector(F.concat(*names))))

    return scored(meta.fit(assemble(tr)), assemble(te))


def partner(pos: Column, n: int, seed: int) -> Column:
    """Where position ``pos`` of 0 to n - 1 goes in permutation ``seed``: Feistel rounds, repeated until the result is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def rounds(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
        for r in range(4):
            left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed), F.lit(r)).bitwiseAND(F.lit(mask)))
        return F.shiftleft(left, half).bitwiseOR(right)

    # fewer than four numbers of the domain are above n for each one below, so 200 steps are as good as never too few
    found = F.aggregate(F.sequence(F.lit(1), F.lit(200)), rounds(pos.cast("long")), lambda q, _: F.when(q < n, q).otherwise(rounds(q)))
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("no place found")).cast("long"))


def permutation_importance(model, df: DataFrame, size: int, label: str = "label", repeats: int = 10, vector: str = "v", key: str = "id") -> DataFrame:
    """Loss of macro F1 when one feature is exchanged between rows: ``feature, importance, std``.

    In each repeat a bijection of the positions gives each row a partner, whose features it takes one at a time. All
    features and repeats are scored in one pass and counted as cells of confusion matrices.
    """
    n = materialise(ordered(df.select(key, F.col(label).alias("_y"), F.col(vector).cast("array<double>").alias("_v")), [], [key]).with_position("_p").result())
    count = n.count()
    to = F.array(*[F.struct(F.lit(r).alias("_r"), partner(F.col("_p"), count, r).alias("_q")) for r in range(repeats)])
    pairs = n.select("_y", "_v", F.inline(to)).join(n.select(F.col("_p").alias("_q"), F.col("_v").alias("_o")), "_q")
    changed = lambda c: F.transform("_v", lambda x, i: F.when(i == c, F.get(F.col("_o"), c)).otherwise(x))
    every = pairs.select("_y", "_r", "_v", "_o", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("feature")).select("_y", "_r", "feature", changed(F.col("feature")).alias("_x"))
    plain = n.select("_y", F.lit(-1).alias("_r"), F.lit(-1).alias("feature"), F.col("_v").alias("_x"))
    cells = scored(model, with_vectors(every.unionByName(plain), "_x")).groupBy("_r", "feature", "_y", "pred").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, hit: F.struct(F.col(c).cast("double").alias("class"), F.col("n").alias("all"), F.when(F.lit(hit) & (F.col("_y") == F.col("pred")), F.col("n")).otherwise(0).alias("hit"))
    per = cells.select("_r", "feature", F.inline(F.array(side("_y", True), side("pred", False)))).groupBy("_r", "feature", "class").agg((F.lit(2.0) * F.sum("hit") / F.sum("all")).alias("f1"))
    macro = materialise(per.groupBy("_r", "feature").agg(F.avg("f1").alias("f1")))
    base = macro.where("feature < 0").first()["f1"]
    return macro.where("feature >= 0").groupBy("feature").agg(F.avg(F.lit(base) - F.col("f1")).alias("importance"), F.stddev_pop("f1").alias("std"))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of each binned feature with the class, from one contingency count."""
    s = df.agg(*[F.min(c).alias(f"lo_{c}") for c in features], *[F.max(c).alias(f"hi_{c}") for c in features]).first()
    items = []
    for c in features:
        lo, hi = float(s[f"lo_{c}"]), float(s[f"hi_{c}"])
        b = F.least(F.floor((F.col(c) - lo) / ((hi - lo) or 1.0) * bins), F.lit(bins - 1)).cast("int")
        items.append(F.struct(F.lit(c).alias("feature"), b.alias("bin")))
    n = df.select(F.col(label).alias("_y"), F.inline(F.array(*items))).groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).alias("n"))
    # from here on at most features x bins x classes rows
    a = n.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    y = n.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    t = n.groupBy("feature").agg(F.sum("n").alias("nt"))
    j = n.join(a, ["feature", "bin"]).join(y, ["feature", "_y"]).join(t, "feature")
    return j.groupBy("feature").agg(F.sum(F.col("n") / F.col("nt") * F.ln(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))).alias("mutual_information"))


# --- calibration -------------------------------------------------------------------------------------------


@dataclass
class Calibrator:
    """One monotone map per class, fitted on out-of-fold scores; outputs are renormalised."""

    method: str
    models: list

    def apply(self, df: DataFrame, probs: str = "probs") -> DataFrame:
        for c, m in enumerate(self.models):
            df = df.withColumn("_x", F.coalesce(F.get(F.col(probs), F.lit(c)), F.lit(0.0)))
            if self.method == "isotonic":
                df = m.transform(df.withColumnRenamed("_x", "_iso")).withColumnRenamed("prediction", f"_c{c}").drop("_iso")
            else:
                a, b = m
                df = df.withColumn(f"_c{c}", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("_x") + F.lit(b))))).drop("_x")
        raw = F.array(*[F.greatest(F.col(f"_c{c}"), F.lit(1e-12)) for c in range(len(self.models))])
        df = df.withColumn("_raw", raw).withColumn("_t", F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x))
        df = df.withColumn(probs, F.transform("_raw", lambda x: x / F.col("_t")))
        return df.drop("_raw", "_t", *[f"_c{c}" for c in range(len(self.models))])


def fit_calibrator(oof: DataFrame, classes: int, label: str = "label", probs: str = "probs", method: str = "auto") -> Calibrator:
    """Sigmoid or isotonic; auto takes sigmoid if the smallest class has fewer than 500 rows."""
    from pyspark.ml.regression import IsotonicRegression

    if method == "auto":
        small = oof.groupBy(label).count().agg(F.min("count")).first()[0]
        method = "sigmoid" if small < 500 else "isotonic"
    models = []
    for c in range(classes):
        # a class that the model never saw has no entry in its vector
        d = oof.select(F.coalesce(F.get(F.col(probs), F.lit(c)), F.lit(0.0)).alias("_x"), (F.col(label) == c).cast("double").alias("_y"))
        if method == "isotonic":
            models.append(IsotonicRegression(featuresCol="_iso", labelCol="_y").fit(d.withColumnRenamed("_x", "_iso")))
        else:
            v = VectorAssembler(inputCols=["_x"], outputCol="_v").transform(d)
            m = cl.LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=50).fit(v)
            models.append((float(m.coefficients[0]), float(m.intercept)))
    return Calibrator(method, models)


# --- confidence stages ------------------------------------------------------------------------------------------


@dataclass
class ConfidenceStage:
    """A classifier that answers only where it is sure.

    ``fit``: preprocess, out-of-fold scores, per-class thresholds, calibration, final model.
    ``predict``: calibrated probabilities, class, confidence, gate.
    """

    name: str
    estimator: Estimator
    classes: int
    prepare: Pipeline | None = None
    target: float = 0.80
    min_samples: int = 5
    method: str = "auto"
    label: str = "label"
    margin: float | None = None
    fitted: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> ConfidenceStage:
        prep = self.prepare.fit(df) if self.prepare is not None else None
        x = materialise((prep.transform(df) if prep is not None else df).select("id", self.label, "features"))
        est = self.estimator.copy()
        est.set(est.getParam("labelCol"), self.label)
        oof = out_of_fold(x, est, 5, self.label)
        cal = fit_calibrator(oof, self.classes, self.label, method=self.method)
        calibrated = cal.apply(oof).withColumn("pred", pr.predicted(F.col("probs")))
        th = materialise(gt.per_class_thresholds(calibrated, self.label, "pred", pr.confidence(F.col("probs")), self.target, self.min_samples))
        self.fitted = {"prep": prep, "oof": oof, "cal": cal, "thresholds": th, "model": est.fit(x)}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with ``<name>_pred, <name>_conf, <name>_ok`` added."""
        f = self.fitted
        x = f["prep"].transform(df) if f["prep"] is not None else df
        s = f["cal"].apply(scored(f["model"], x))
        s = s.withColumns({"pred": pr.predicted(F.col("probs")), "conf": pr.confidence(F.col("probs"))})
        s = gt.gate_per_class(s, f["thresholds"])
        ok = F.col("is_confident")
        if self.margin is not None:
            ok = ok & (pr.margin(F.col("probs")) >= self.margin)
        out = s.select("id", F.col("pred").alias(f"{self.name}_pred"), F.col("conf").alias(f"{self.name}_conf"), ok.alias(f"{self.name}_ok"))
        return df.join(out, "id")

    def as_cascade_stage(self, rows: Column | None = None, routing: dict[int, str] | None = None) -> gt.Stage:
        n = self.name
        return gt.Stage(n, F.col(f"{n}_pred"), F.col(f"{n}_conf"), F.col(f"{n}_ok"), rows, routing or {})


# --- topics, clusters, projections ---------------------------------------------------------------------------------


# Coefficients of the rational approximations of the normal quantile (Wichura, algorithm AS 241), numerator and
# denominator, for the middle, the tails and the far tails.
_PROBIT = [
    (
        [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
        [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
    ),
    (
        [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
        [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
    ),
    (
        [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
        [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
    ),
]


def _ratio(x: str, tables: tuple[list[float], list[float]]) -> str:
    def poly(c: list[float]) -> str:
        out = f"{c[-1]!r}e0" if "e" not in repr(c[-1]) else repr(c[-1])
        for v in reversed(c[:-1]):
            out = f"({v!r}{'' if 'e' in repr(v) else 'e0'} + {x} * {out})"
        return out

    return f"({poly(tables[0])} / {poly(tables[1])})"


def probit_sql(p: str) -> str:
    """The normal quantile of an expression between 0 and 1, in SQL that Spark and others read; to about 16 digits."""
    q = f"({p} - 0.5e0)"
    r = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    middle = f"{q} * {_ratio(f'(0.180625e0 - {q} * {q})', _PROBIT[0])}"
    tail = f"CASE WHEN {r} <= 5e0 THEN {_ratio(f'({r} - 1.6e0)', _PROBIT[1])} ELSE {_ratio(f'({r} - 5e0)', _PROBIT[2])} END"
    return f"CASE WHEN abs({q}) <= 0.425e0 THEN {middle} ELSE sign({q}) * ({tail}) END"


def rank_normal(df: DataFrame, cols: Sequence[str], key: str = "id") -> DataFrame:
    """Each column replaced by the normal quantile of its rank (r + 0.5)/n; ties by the key. All columns are ranked in one pass."""
    n = df.count()
    long = df.select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])))
    placed = ordered(long, ["_c"], ["_v", key]).with_position("_p").result()
    placed = placed.select(key, "_c", ((F.col("_p") + 0.5) / F.lit(float(max(n, 1)))).alias("_u")).select(key, "_c", F.expr(probit_sql("_u")).alias("_z"))
    wide = placed.groupBy(key).agg(*[F.max(F.when(F.col("_c") == i, F.col("_z"))).alias(c) for i, c in enumerate(cols)])
    return df.drop(*cols).join(wide, key).select(*df.columns)


def kmeans_labels(df: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    m = KMeans(k=k, seed=seed, maxIter=50).fit(df)
    return m.transform(df).withColumn("cluster", F.col("prediction").cast("int")).drop("prediction")


def kmeans_search(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Inertia and silhouette (squared distances) per number of clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = []
    for k in ks:
        m = KMeans(k=k, seed=SEED, maxIter=30).fit(df)
        rows.append((k, float(m.summary.trainingCost), float(ClusteringEvaluator().evaluate(m.transform(df)))))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def lda_topics(df: DataFrame, vocabulary: Sequence[str], k: int = 5, words: int = 8, col: str = "_tf") -> DataFrame:
    from pyspark.ml.clustering import LDA

    m = LDA(k=k, maxIter=10, seed=SEED, featuresCol=col).fit(materialise(df.select(col)))  # each round reads the counts again
    names = F.array(*[F.lit(w) for w in vocabulary])
    t = m.describeTopics(words)
    return t.select("topic", F.transform("termIndices", lambda i: F.get(names, i)).alias("terms"), "termWeights")


def nmf_topics(weights: DataFrame, k: int = 5, words: int = 8, rounds: int = 10) -> DataFrame:
    """Non-negative factors of (id, term, weight): the strongest terms per factor."""
    from alertsieve.operators.factors import factorise
    from alertsieve.operators.topk import first_k

    f = factorise(weights, k, rounds).cols
    long = f.select(F.col("col").alias("term"), F.inline(F.array(*[F.struct(F.lit(j).alias("topic"), F.col(f"f{j}").alias("w")) for j in range(k)])))
    return first_k(long, ["topic"], [F.desc("w"), "term"], words).select("topic", "_rank", "term", "w")
