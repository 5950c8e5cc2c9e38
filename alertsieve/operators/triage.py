"""A cascade over alert groups and their alerts.

Groups pass an invalid gate and a disposition stage; what a group was decided to be tells which stage its alerts go to: the
role stage under a confident group, the noise filter under an unsure one, none under an invalid one. A linkage stage then says
whether a group has a bug, from one of two models: one that knows the disposition, for automated groups, and one that doesn't.

Stages are scored tables here: probabilities, classes and confidences are columns, whatever model made them. Group decisions
travel to the alerts by one join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.functions import probs as pr
from alertsieve.operators import categories as ct
from alertsieve.operators import models as md
from alertsieve.operators.lookup import lookup_join
from alertsieve.session import materialise

# Codes of decisions.
OPEN, VALID, INVALID = -1, 0, 3
UNSURE_BUG, NO_BUG, HAS_BUG = 0, 1, 2
#: merges of group statuses into classes (fixed values)
SCHEMES = {"4 classes": {8: 4, 2: 4}, "5 classes": {8: 4}}
SCHEME_GRID = [0.60, 0.70, 0.80, 0.85, 0.90, 0.95]


@dataclass(frozen=True)
class Thresholds:
    """Least confidences. ``disposition`` has one for each class, others take ``other``."""

    valid: float = 0.50
    invalid: float = 0.70
    disposition: dict[int, float] = field(default_factory=dict)
    other: float = 0.50
    role: float = 0.50
    noise: float = 0.80
    no_bug: float = 0.50
    has_bug: float = 0.50


def merged(status: Column, scheme: dict[int, int]) -> Column:
    out = status
    for a, b in scheme.items():
        out = F.when(status == a, F.lit(b)).otherwise(out)
    return out


def _of_two(p: Column, low: float, high: float) -> tuple[Column, Column, Column]:
    """Whether a probability says yes (ties say no), the confidence in that, and whether it's enough."""
    yes, conf = p > 0.5, F.greatest(p, F.lit(1.0) - p)
    return yes, conf, conf >= F.when(yes, F.lit(high)).otherwise(F.lit(low))


def decide_groups(groups: DataFrame, t: Thresholds) -> DataFrame:
    """Add s0_pred, group_status, automated, s3_pred, s3_confidence, s3_source.

    ``groups``: p_invalid, s1_class, s1_conf, p_bug_a (knows the disposition), p_bug_b. Null scores decide nothing.
    """
    yes, _, sure = _of_two(F.col("p_invalid"), t.valid, t.invalid)
    gate = F.when(F.coalesce(sure, F.lit(False)), F.when(yes, F.lit(INVALID)).otherwise(F.lit(VALID))).otherwise(F.lit(OPEN))
    least = F.lit(t.other)
    for c, x in t.disposition.items():
        least = F.when(F.col("s1_class") == c, F.lit(x)).otherwise(least)
    sure_kind = F.coalesce(F.col("s1_conf") >= least, F.lit(False))
    out = groups.withColumn("s0_pred", gate)
    out = out.withColumn("group_status", F.when(F.col("s0_pred") == INVALID, F.lit(INVALID)).when((F.col("s0_pred") == VALID) & sure_kind, F.col("s1_class").cast("int")).otherwise(F.lit(OPEN)))
    out = out.withColumn("automated", F.col("group_status") != OPEN)
    mode = F.when(F.col("automated"), F.lit("A")).otherwise(F.lit("B"))
    p = F.when(F.col("automated"), F.col("p_bug_a")).otherwise(F.col("p_bug_b"))
    bug, conf, enough = _of_two(p, t.no_bug, t.has_bug)
    enough = F.coalesce(enough, F.lit(False))
    shortcut = F.col("s0_pred") == INVALID
    return out.withColumns(
        {
            "s3_pred": F.when(shortcut, F.lit(NO_BUG)).when(enough, F.when(bug, F.lit(HAS_BUG)).otherwise(F.lit(NO_BUG))).otherwise(F.lit(UNSURE_BUG)),
            "s3_confidence": F.when(shortcut, F.lit(1.0)).otherwise(F.coalesce(conf, F.lit(0.0))),
            "s3_source": F.when(shortcut, F.lit("shortcut_invalid")).when(enough, F.concat(F.lit("model_"), mode)).otherwise(F.lit("uncertain")),
        }
    )


def decide_members(members: DataFrame, decided: DataFrame, t: Thresholds, group: str = "summary_id", group_key: str = "id") -> DataFrame:
    """Add route, member_status, member_automated from the decisions on the groups.

    ``members``: ``group``, s2a_class, s2a_conf, p_noise. Alerts without a group stay open.
    """
    state = decided.select(F.col(group_key).alias(group), F.when(F.col("s0_pred") == INVALID, "invalid").when(F.col("automated"), "roles").otherwise("noise").alias("route"))
    out = lookup_join(members, state, [group], "left").withColumn("route", F.coalesce("route", F.lit("none")))
    role = F.coalesce(F.col("s2a_conf") >= t.role, F.lit(False))
    noise = F.coalesce((F.col("p_noise") > 0.5) & (F.col("p_noise") >= t.noise), F.lit(False))
    invalid = (F.col("route") == "invalid") | ((F.col("route") == "noise") & noise)
    by_role = (F.col("route") == "roles") & role
    return out.withColumns(
        {
            "member_status": F.when(invalid, F.lit(INVALID)).when(by_role, F.col("s2a_class").cast("int")).otherwise(F.lit(OPEN)),
            "member_automated": invalid | by_role,
        }
    )


def group_report(decided: DataFrame, status: str, has_bug: str, scheme: dict[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """End-to-end quality: automation rate, accuracy of automated groups, linkage coverage and accuracy, invalid gate."""
    n, auto, true = F.count(F.lit(1)), F.col("automated"), merged(F.col(status), scheme)
    linked = F.col("s3_pred") != UNSURE_BUG
    said, is_invalid = F.col("s0_pred") == INVALID, F.col(status) == INVALID
    share = lambda a, b: F.try_divide(F.count_if(a), F.count_if(b) if b is not None else n)
    return decided.groupBy(*keys).agg(
        n.alias("n_groups"),
        F.count_if(auto).alias("n_automated"),
        F.count_if(~auto).alias("n_deferred"),
        share(auto, None).alias("automation_rate"),
        share(auto & (F.col("group_status") == true), auto).alias("accuracy"),
        share(linked, None).alias("bug_coverage"),
        share(linked & ((F.col("s3_pred") == HAS_BUG) == (F.col(has_bug) == 1)), linked).alias("bug_accuracy"),
        share(said & is_invalid, said).alias("invalid_precision"),
        share(said & is_invalid, is_invalid).alias("invalid_recall"),
    )


def member_report(decided: DataFrame, status: str) -> DataFrame:
    """Per route: alerts, automated alerts and how many of these were right."""
    auto = F.col("member_automated")
    return decided.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.count_if(auto).alias("n_automated"), F.try_divide(F.count_if(auto & (F.col("member_status") == F.col(status))), F.count_if(auto)).alias("accuracy")
    )


def compare_schemes(gated: DataFrame, status: str, scored: dict[str, tuple[dict[int, int], Column, Column]], thresholds: Sequence[float] = tuple(SCHEME_GRID)) -> DataFrame:
    """Accuracy and coverage of gate and disposition together, for class schemes and thresholds, from one aggregate.

    ``scored``: for each scheme its merges, predicted class and confidence. ``gated`` has s0_pred.
    """
    invalid, valid = F.col("s0_pred") == INVALID, F.col("s0_pred") == VALID
    cells = []
    for name, (scheme, pred, conf) in scored.items():
        for t in thresholds:
            take = valid & F.coalesce(conf >= t, F.lit(False))
            right = F.count_if(invalid & (F.col(status) == INVALID)) + F.count_if(take & (pred == merged(F.col(status), scheme)))
            cells.append(F.struct(F.lit(name).alias("scheme"), F.lit(float(t)).alias("threshold"), (F.count_if(invalid) + F.count_if(take)).alias("automated"), right.alias("right")))
    return gated.agg(F.count(F.lit(1)).alias("_n"), F.array(*cells).alias("_c")).select("_n", F.inline("_c")).select(
        "scheme", "threshold", "automated", (F.col("_n") - F.col("automated")).alias("deferred"), F.try_divide("right", "automated").alias("accuracy"), F.try_divide("automated", "_n").alias("coverage")
    )


# --- training of the stages ----------------------------------------------------------------------------


@dataclass
class TriageModels:
    """Stages fitted on groups of known status, each on its own rows, features and target.

    ``estimator`` makes a fresh model; ``rate``: a column whose rate of invalid groups in training is a feature of the gate.
    """

    numeric: Sequence[str]
    rate: str
    estimator: Estimator
    scheme: dict[int, int]
    classes: Sequence[int]
    fitted: dict = field(default_factory=dict)

    def _rated(self, df: DataFrame) -> DataFrame:
        return ct.target_rate(self.fitted["train"], df, self.rate, (F.col("status") == INVALID).cast("int"), "invalid_rate")

    def _stage(self, name: str, rows: DataFrame, label: Column, numeric: Sequence[str], classes: int) -> md.ConfidenceStage:
        stage = md.ConfidenceStage(name, self.estimator, classes, md.preprocessor(numeric=numeric), label="_y")
        return stage.fit(materialise(rows.withColumn("_y", label.cast("double"))))

    def fit(self, train: DataFrame) -> TriageModels:
        """``train``: id, status, has_bug, the numeric columns and ``rate``. The disposition stage learns from groups that aren't invalid."""
        self.fitted = {"train": materialise(train)}
        rated = materialise(self._rated(train))
        kind = merged(F.col("status"), self.scheme)
        place = F.array_position(F.array(*[F.lit(int(c)) for c in self.classes]), kind.cast("int")) - 1
        valid = rated.where((F.col("status") != INVALID) & (place >= 0))
        self.fitted |= {
            "s0": self._stage("s0", rated, F.col("status") == INVALID, [*self.numeric, "invalid_rate"], 2),
            "s1": self._stage("s1", valid, place, self.numeric, len(self.classes)),
        }
        # the linkage model learns from what the disposition stage says of groups that it wasn't fitted on
        s1 = self.fitted["s1"].fitted
        unseen = s1["cal"].apply(s1["oof"]).select("id", pr.predicted(F.col("probs")).alias("s1_pred"), pr.confidence(F.col("probs")).alias("s1_conf"))
        with_kind = self._named(valid.join(unseen, "id"))
        self.fitted |= {
            "s3a": self._stage("s3a", with_kind, F.col("has_bug"), [*self.numeric, "s1_class", "s1_conf"], 2),
            "s3b": self._stage("s3b", valid, F.col("has_bug"), self.numeric, 2),
        }
        return self

    def _named(self, df: DataFrame) -> DataFrame:
        return df.withColumn("s1_class", F.get(F.array(*[F.lit(int(c)) for c in self.classes]), F.col("s1_pred").cast("int")).cast("double"))

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with p_invalid, s1_class, s1_conf, p_bug_a, p_bug_b."""
        yes = lambda n: F.when(F.col(f"{n}_pred") == 1, F.col(f"{n}_conf")).otherwise(F.lit(1.0) - F.col(f"{n}_conf"))
        out = self._named(self.fitted["s1"].predict(self.fitted["s0"].predict(self._rated(df))))
        out = self.fitted["s3b"].predict(self.fitted["s3a"].predict(out))
        return out.select(*df.columns, yes("s0").alias("p_invalid"), F.col("s1_class").cast("int").alias("s1_class"), "s1_conf", yes("s3a").alias("p_bug_a"), yes("s3b").alias("p_bug_b"))


def cross_group(models: TriageModels, groups: DataFrame, by: str, train: Sequence, test: Sequence, t: Thresholds) -> DataFrame:
    """Stages fitted on the groups of some values of ``by`` and judged on those of others: one row for each of these."""
    models.fit(groups.where(F.col(by).isin(list(train))))
    decided = materialise(decide_groups(models.score(groups.where(F.col(by).isin(list(test)))), t))
    return group_report(decided, "status", "has_bug", models.scheme, [by])
