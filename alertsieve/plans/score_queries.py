"""Queries over score tables: conformal sets, agreement, gates, metrics, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertsieve.functions import explain as ex
from alertsieve.functions import probs as pr
from alertsieve.functions.random import keyed_uniform, keyed_uniform_sql, poisson_weight_sql
from alertsieve.operators import agreement as ag
from alertsieve.operators import conformal as cf
from alertsieve.operators import gating as gt
from alertsieve.operators import metrics as mt
from alertsieve.operators import resample as rs
from alertsieve.operators.grid import steps
from alertsieve.operators.ordering import Quantile, quantiles, with_scalars
from alertsieve.plans.registry import R, query
from alertsieve.sources.tables import CLASSES, DEFECTS_SQL, SCORES_SQL, defects, scores

ALPHAS = [0.01, 0.05, 0.10, 0.20]
TEN = [0.10]


def test_rows(spark, d):
    return scores(spark, d).where("split = 'test'")


# --- SQL building blocks -----------------------------------------------------------------


def alpha_values(alphas) -> str:
    return "alphas(alpha) AS (VALUES " + ", ".join(f"({a}::DOUBLE)" for a in alphas) + ")"


def conformal_sql(p: str, grp: str, alphas, lam: float = 0.01, salt: str = "raps") -> str:
    """CTEs up to ``sets(id, label, agree, preda, pred, grp, alpha, sz, rk, q)`` of the test rows."""
    pen = f"{lam}::DOUBLE * greatest(0, rk-5)" if lam else "0.0::DOUBLE"
    return (
        "WITH "
        + SCORES_SQL
        + f""", {alpha_values(alphas)},
base AS (SELECT id, split, label, agree, preda, predb, ca, {p} AS p FROM scores),
g AS (SELECT *, {grp} AS grp FROM base),
cls AS (SELECT id, unnest(range(0,{CLASSES})) AS k, unnest(p) AS v FROM g),
rk AS (SELECT id, k, v, row_number() OVER (PARTITION BY id ORDER BY v DESC, k) AS rk, sum(v) OVER (PARTITION BY id ORDER BY v DESC, k ROWS UNBOUNDED PRECEDING) AS cum FROM cls),
cal AS (SELECT g.id, grp, cum + {pen} - {keyed_uniform_sql('g.id', salt)} * (v + {pen}) AS score FROM g JOIN rk ON g.id=rk.id AND rk.k=g.label WHERE split='cal'),
ord AS (SELECT grp, score, row_number() OVER (PARTITION BY grp ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY grp) AS n FROM cal),
q AS (SELECT grp, alpha, max(score) AS q FROM ord, alphas WHERE r = ceil(least(ceil((n+1)*(1.0::DOUBLE-alpha))/n, 1.0::DOUBLE)*(n-1)) GROUP BY ALL),
tst AS (SELECT g.id, g.label, g.agree, g.preda, g.predb, g.ca, g.p, g.grp, a.alpha, coalesce(q.q, 1.0::DOUBLE) AS q FROM g CROSS JOIN alphas a LEFT JOIN q ON q.grp = g.grp AND q.alpha = a.alpha WHERE split='test'),
sz AS (SELECT t.id, t.alpha, least({CLASSES}, 1 + count(*) FILTER (WHERE cum + {pen} < q)) AS sz, max(CASE WHEN rk.k = t.label THEN rk END) AS rk, max(CASE WHEN rk = 1 THEN rk.k END) AS pred
  FROM tst t JOIN rk ON t.id = rk.id GROUP BY t.id, t.alpha),
sets AS (SELECT t.*, sz.sz, sz.rk, sz.pred FROM tst t JOIN sz USING (id, alpha))
"""
    )


def metrics_sql(by: str = "", std: bool = True) -> str:
    lead = f"{by}, " if by else ""
    tail = f"GROUP BY {lead} alpha"
    s = f", {R('stddev_pop(sz)')} AS std_set_size" if std else ""
    return f"""SELECT {lead} alpha, {R('avg((rk <= sz)::INT)')} AS coverage, {R('avg(sz)')} AS mean_set_size, {R('median(sz)')} AS median_set_size{s},
 {R('avg((sz = 1)::INT)')} AS singleton_rate, {R('coalesce(avg((pred = label)::INT) FILTER (WHERE sz = 1), 0)')} AS singleton_accuracy, count(*) AS n FROM sets {tail}"""


def report_sql(p: str, grp: str, alphas) -> str:
    return conformal_sql(p, grp, alphas) + ", parts AS (SELECT *, 'overall' AS part FROM sets UNION ALL SELECT *, CASE WHEN agree THEN 'agree' ELSE 'disagree' END FROM sets) " + metrics_sql("part", False).replace("FROM sets", "FROM parts")


# --- conformal -----------------------------------------------------------------------------


@query("agreement_conditioned_sets", report_sql("pa", "agree", ALPHAS))
def agreement_conditioned_sets(spark, d):
    """Agreement-conditioned sets over a grid of alphas, for all rows and both parts."""
    return cf.agreement_report(cf.conformal_run(scores(spark, d), F.col("pa"), ["agree"], ALPHAS), ALPHAS)


@query("aps_sets", conformal_sql("pa", "0", TEN, lam=0.0, salt="aps") + metrics_sql())
def aps_sets(spark, d):
    s = scores(spark, d)
    cal = s.where("split = 'cal'").withColumn("score", pr.aps_score(F.col("pa"), F.col("label"), keyed_uniform(F.col("id"), "aps")))
    q = cf.calibrate(cal, [], TEN)
    test = cf.attach_thresholds(s.where("split = 'test'"), [], q, 1)
    return cf.set_metrics(cf.with_sets(test, F.col("pa"), 1, lam=0.0), TEN)


@query("raps_single_model", conformal_sql("pa", "0", ALPHAS) + metrics_sql())
def raps_single_model(spark, d):
    return cf.set_metrics(cf.conformal_run(scores(spark, d), F.col("pa"), [], ALPHAS), ALPHAS)


@query(
    "raps_scores",
    conformal_sql("pb", "0", TEN) + f"SELECT id, {R('score')} AS score FROM cal",
)
def raps_scores(spark, d):
    return cf.raps_scored(scores(spark, d).where("split = 'cal'"), F.col("pb")).select("id", "score")


@query(
    "conformal_quantiles",
    conformal_sql("pa", "agree", ALPHAS) + f"SELECT grp AS agree, (SELECT count(*) FROM cal c WHERE c.grp=q.grp) AS n, {R('max(q) FILTER (WHERE alpha=0.01::DOUBLE)')} AS q0, {R('max(q) FILTER (WHERE alpha=0.05::DOUBLE)')} AS q1, {R('max(q) FILTER (WHERE alpha=0.1::DOUBLE)')} AS q2, {R('max(q) FILTER (WHERE alpha=0.2::DOUBLE)')} AS q3 FROM q GROUP BY grp",
)
def conformal_quantiles(spark, d):
    cal = cf.raps_scored(scores(spark, d).where("split = 'cal'"), F.col("pa"))
    return cf.calibrate(cal, ["agree"], ALPHAS)


@query(
    "prediction_sets",
    conformal_sql("pa", "agree", TEN) + ", l AS (SELECT s.id, string_agg(rk.k::VARCHAR, ',' ORDER BY rk.rk) AS pset FROM sets s JOIN rk ON s.id=rk.id AND rk.rk <= s.sz GROUP BY s.id) SELECT s.id, s.sz AS set_size, l.pset FROM sets s JOIN l USING (id)",
)
def prediction_sets(spark, d):
    t = cf.conformal_run(scores(spark, d), F.col("pa"), ["agree"], TEN)
    s = pr.prediction_set(F.col("pa"), F.col("s0"))
    return t.select("id", F.col("s0").alias("set_size"), F.array_join(s.cast("array<string>"), ",").alias("pset"))


HYBRIDS = [("A", "pa", "pa"), ("B", "pb", "pb"), ("C", "pa", "pb"), ("D", "pb", "pa")]


@query(
    "hybrid_routing",
    " UNION ALL ".join(
        f"SELECT * FROM ({conformal_sql(f'CASE WHEN agree THEN {x} ELSE {y} END', 'agree', TEN)} {metrics_sql().replace('SELECT  alpha', chr(83) + f'ELECT {chr(39)}{n}{chr(39)} AS config, alpha', 1)})"
        for n, x, y in HYBRIDS
    ),
)
def hybrid_routing(spark, d):
    """All routings in one pass: each row carries one probability vector per routing."""
    s = scores(spark, d)
    routed = F.array(*[F.struct(F.lit(n).alias("config"), cf.hybrid_probs(x, y).alias("p")) for n, x, y in HYBRIDS])
    long = s.select("id", "split", "label", "agree", F.inline(routed))
    return cf.set_metrics(cf.conformal_run(long, F.col("p"), ["config", "agree"], TEN), TEN, ["config"])


MONDRIAN = {
    "mondrian_confidence": ("least(floor(ca*5),4)::INT", lambda: F.least(F.floor(pr.confidence(F.col("pa")) * 5), F.lit(4)).cast("int")),
    "mondrian_predicted_class": ("preda", lambda: F.col("preda")),
    "mondrian_agreement_confidence": ("(CASE WHEN agree THEN 10 ELSE 0 END) + least(floor(ca*5),4)::INT", lambda: F.when(F.col("agree"), 10).otherwise(0) + F.least(F.floor(pr.confidence(F.col("pa")) * 5), F.lit(4)).cast("int")),
}


def _mondrian(col):
    def run(spark, d):
        s = scores(spark, d).withColumn("grp", col())
        return cf.set_metrics(cf.conformal_run(s, F.col("pa"), ["grp"], ALPHAS), ALPHAS)

    return run


for _name, (_sql, _col) in MONDRIAN.items():
    query(_name, conformal_sql("pa", _sql, ALPHAS) + metrics_sql())(_mondrian(_col))


@query(
    "label_threshold_sets",
    "WITH "
    + SCORES_SQL
    + f""", {alpha_values([0.05, 0.1, 0.2])}, cal AS (SELECT 1.0::DOUBLE - pa[label+1] AS score FROM scores WHERE split='cal'),
n AS (SELECT count(*) AS n FROM cal),
lv AS (SELECT alpha, least(1.0::DOUBLE, (1.0::DOUBLE-alpha)*(1.0::DOUBLE+1.0::DOUBLE/n))*(n-1) AS h FROM alphas, n),
ord AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r FROM cal),
q AS (SELECT alpha, max(score) FILTER (WHERE r=floor(h)) + (max(score) FILTER (WHERE r=ceil(h)) - max(score) FILTER (WHERE r=floor(h)))*(max(h)-floor(max(h))) AS q FROM ord, lv GROUP BY alpha),
t AS (SELECT alpha, q, len([x for x in pa if x >= 1.0::DOUBLE - q]) AS sz, pa[label+1] >= 1.0::DOUBLE - q AS hit FROM scores, q WHERE split='test')
SELECT alpha, {R('avg(hit::INT)')} AS coverage, {R('avg(sz)')} AS mean_set_size, {R('avg((sz=1)::INT)')} AS single_share, {R('avg((sz=2)::INT)')} AS both_share, {R('avg((sz=0)::INT)')} AS empty_share, {R('1.0::DOUBLE-max(q)')} AS threshold FROM t GROUP BY alpha""",
)
def label_threshold_sets(spark, d):
    return cf.label_threshold_metrics(scores(spark, d), "pa", [0.05, 0.10, 0.20])


@query(
    "alpha_grid",
    "WITH m AS (SELECT * FROM (" + conformal_sql("pa", "0", ALPHAS) + "SELECT alpha, avg(sz) AS single_size, avg((rk<=sz)::INT) AS single_coverage FROM sets GROUP BY alpha)), "
    "c AS (SELECT * FROM (" + conformal_sql("pa", "agree", ALPHAS) + "SELECT alpha, avg(sz) AS cond_size, avg((rk<=sz)::INT) AS cond_coverage FROM sets GROUP BY alpha)) "
    + f"SELECT alpha, {R('single_size')} AS single_size, {R('single_coverage')} AS single_coverage, {R('cond_size')} AS cond_size, {R('cond_coverage')} AS cond_coverage, {R('(1-cond_size/single_size)*100')} AS size_reduction_pct FROM m JOIN c USING (alpha)",
)
def alpha_grid(spark, d):
    """Single-threshold and agreement-conditioned sets on the same rows, per alpha."""
    s = scores(spark, d)
    one = cf.set_metrics(cf.conformal_run(s, F.col("pa"), [], ALPHAS), ALPHAS).select("alpha", F.col("mean_set_size").alias("single_size"), F.col("coverage").alias("single_coverage"))
    two = cf.set_metrics(cf.conformal_run(s, F.col("pa"), ["agree"], ALPHAS), ALPHAS).select("alpha", F.col("mean_set_size").alias("cond_size"), F.col("coverage").alias("cond_coverage"))
    return one.join(two, "alpha").withColumn("size_reduction_pct", (F.lit(1.0) - F.col("cond_size") / F.col("single_size")) * 100)


@query("class_coverage", conformal_sql("pa", "0", TEN) + f"SELECT label, {R('avg((rk<=sz)::INT)')} AS coverage, {R('avg(sz)')} AS mean_set_size, count(*) AS n FROM sets GROUP BY label")
def class_coverage(spark, d):
    return cf.class_coverage(cf.conformal_run(scores(spark, d), F.col("pa"), [], TEN))


@query("worst_classes", conformal_sql("pa", "0", TEN) + f", c AS (SELECT label, avg((rk<=sz)::INT) AS coverage, avg(sz) AS mean_set_size, count(*) AS n FROM sets GROUP BY label ORDER BY coverage, label LIMIT 5) SELECT label, {R('coverage')} AS coverage, {R('mean_set_size')} AS mean_set_size, n FROM c")
def worst_classes(spark, d):
    c = cf.class_coverage(cf.conformal_run(scores(spark, d), F.col("pa"), [], TEN))
    return c.orderBy("coverage", "label").limit(5)


@query("size_histogram", conformal_sql("pb", "0", TEN) + f"SELECT least(sz, 16)::INT AS size, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()')} AS share FROM sets GROUP BY 1")
def size_histogram(spark, d):
    return cf.size_histogram(cf.conformal_run(scores(spark, d), F.col("pb"), [], TEN))


@query(
    "score_alignment",
    "WITH " + SCORES_SQL + " SELECT s.split, count(*) AS n, count(*) FILTER (WHERE s.label <> e.label) AS mismatches FROM scores s JOIN embeddings e ON s.id = e.vec_id GROUP BY s.split",
)
def score_alignment(spark, d):
    from alertsieve.sources.readers import align_scores
    from alertsieve.sources.tables import table

    truth = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("true_label"))
    return align_scores(scores(spark, d).select("id", "split", "label"), truth)


# --- agreement -----------------------------------------------------------------------------

_TEST = "WITH " + SCORES_SQL + ", t AS (SELECT * FROM scores WHERE split='test') "


@query(
    "agreement_contingency",
    _TEST
    + f""", f AS (SELECT agree, preda=label AS a, predb=label AS b FROM t)
SELECT count(*) AS n, count(*) FILTER (WHERE agree) AS n_agree, {R('avg(agree::INT)')} AS agree_rate, {R('avg(a::INT)')} AS acc_a, {R('avg(b::INT)')} AS acc_b,
{R('avg(a::INT) FILTER (WHERE agree)')} AS acc_a_agree, {R('avg(a::INT) FILTER (WHERE NOT agree)')} AS acc_a_disagree, {R('avg(b::INT) FILTER (WHERE NOT agree)')} AS acc_b_disagree,
{R('avg((a OR b)::INT) FILTER (WHERE NOT agree)')} AS either_disagree, count(*) FILTER (WHERE a AND b) AS both_right, count(*) FILTER (WHERE a AND NOT b) AS only_a,
count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong, {R('avg((a OR b)::INT)')} AS oracle_accuracy,
{R('count(*) FILTER (WHERE NOT a AND b) / nullif(count(*) FILTER (WHERE NOT a), 0)')} AS complementarity FROM f""",
)
def agreement_contingency(spark, d):
    return ag.contingency(test_rows(spark, d))


_BINS = """, f AS (SELECT *, preda=label AS a, CASE WHEN {c} < 0.3 THEN 0 WHEN {c} < 0.5 THEN 1 WHEN {c} < 0.7 THEN 2 WHEN {c} < 0.85 THEN 3 ELSE 4 END AS bin FROM t),
b AS (SELECT bin, count(*) AS n, avg(a::INT) AS acc, avg(agree::INT) AS agree_rate,
  CASE WHEN count(*) FILTER (WHERE agree) > 5 THEN avg(a::INT) FILTER (WHERE agree) END AS acc_agree,
  CASE WHEN count(*) FILTER (WHERE NOT agree) > 5 THEN avg(a::INT) FILTER (WHERE NOT agree) END AS acc_disagree FROM f GROUP BY bin HAVING count(*) >= 10) """
_BIN_OUT = f"""SELECT bin, n, {R('acc')} AS acc, {R('agree_rate')} AS agree_rate, {R('acc_agree')} AS acc_agree, {R('acc_disagree')} AS acc_disagree, {R('acc_agree-acc_disagree')} AS gap,
CASE WHEN abs(acc_agree-acc_disagree) >= 0.15 THEN 'STRONG' WHEN abs(acc_agree-acc_disagree) >= 0.05 THEN 'moderate' WHEN acc_agree-acc_disagree IS NOT NULL THEN 'weak' END AS signal FROM b"""


@query("agreement_bins", _TEST + _BINS.format(c="ca") + _BIN_OUT)
def agreement_bins(spark, d):
    return ag.gap_by_bin(test_rows(spark, d), pr.confidence(F.col("pa")))


@query("agreement_bins_reverse", _TEST + _BINS.format(c="cb") + _BIN_OUT)
def agreement_bins_reverse(spark, d):
    return ag.gap_by_bin(test_rows(spark, d), pr.confidence(F.col("pb")))


@query("agreement_by_class", _TEST + f"SELECT label, count(*) AS n, {R('avg(agree::INT)')} AS agree_rate, {R('avg((preda=label)::INT)')} AS acc_a, {R('avg((predb=label)::INT)')} AS acc_b FROM t GROUP BY label HAVING count(*) >= 10 ORDER BY n DESC, label LIMIT 15")
def agreement_by_class(spark, d):
    return ag.by_class(test_rows(spark, d))


@query(
    "viability_gate",
    _TEST
    + _BINS.format(c="ca")
    + f""", v AS (SELECT coalesce((SELECT avg(abs(acc_agree-acc_disagree)) FROM b WHERE bin IN (1,2)), 0.0::DOUBLE) AS avg_gap, (SELECT avg(agree::INT) FROM t) AS agree_rate,
(SELECT count(*) FROM scores WHERE split='cal' AND agree) AS cal_agree, (SELECT count(*) FROM scores WHERE split='cal' AND NOT agree) AS cal_disagree)
SELECT {R('avg_gap')} AS avg_gap, {R('agree_rate')} AS agree_rate, cal_agree, cal_disagree, avg_gap >= 0.05 AND agree_rate > 0.15 AS viable, cal_agree >= 20 AND cal_disagree >= 20 AS enough_rows FROM v""",
)
def viability_gate(spark, d):
    s = scores(spark, d)
    return ag.viability(s.where("split = 'cal'"), s.where("split = 'test'"), pr.confidence(F.col("pa")))


# --- selective prediction -------------------------------------------------------------------


def _augrc_sql(conf: str) -> str:
    return (
        _TEST
        + f""", o AS (SELECT (preda<>label)::INT AS err, row_number() OVER (ORDER BY {conf} DESC, id) AS pos FROM t),
c AS (SELECT pos, sum(err) OVER (ORDER BY pos) AS ce, count(*) OVER () AS n FROM o),
z AS (SELECT pos, n, ce, lag(ce) OVER (ORDER BY pos) AS pe FROM c)
SELECT max(n) AS n, max(ce)::BIGINT AS n_errors, {R('sum((ce+pe)/2.0) FILTER (WHERE pe IS NOT NULL) / max(n) / max(n)')} AS augrc FROM z"""
    )


@query("augrc", _augrc_sql("ca"))
def augrc(spark, d):
    t = test_rows(spark, d)
    return mt.augrc(t, F.col("preda") != F.col("label"), pr.confidence(F.col("pa")))


@query("augrc_agreement_boost", _augrc_sql("(ca + CASE WHEN agree THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"))
def augrc_agreement_boost(spark, d):
    t = test_rows(spark, d)
    conf = pr.confidence(F.col("pa")) + F.when(F.col("agree"), 1.0).otherwise(0.0)
    return mt.augrc(t, F.col("preda") != F.col("label"), conf)


@query(
    "risk_coverage_curve",
    _TEST + f", o AS (SELECT id, (preda<>label)::INT AS err, row_number() OVER (ORDER BY ca DESC, id) AS pos FROM t) SELECT id, pos, {R('pos/(count(*) OVER ())')} AS coverage, {R('sum(err) OVER (ORDER BY pos)/(count(*) OVER ())')} AS risk FROM o",
)
def risk_coverage_curve(spark, d):
    t = test_rows(spark, d)
    r = mt.risk_coverage(t, F.col("preda") != F.col("label"), pr.confidence(F.col("pa")))
    r = with_scalars(r, t.agg(F.count(F.lit(1)).alias("n")))
    return r.select(F.col("_id").alias("id"), "pos", (F.col("pos") / F.col("n")).alias("coverage"), (F.col("errors") / F.col("n")).alias("risk"))


@query(
    "fixed_coverage_accuracy",
    _TEST
    + f""", o AS (SELECT (preda=label)::INT AS hit, row_number() OVER (ORDER BY ca DESC, id) AS pos, count(*) OVER () AS n FROM t), c(coverage) AS (VALUES (0.7::DOUBLE),(0.8::DOUBLE),(0.9::DOUBLE),(0.95::DOUBLE))
SELECT coverage, count(*) AS n_kept, {R('avg(hit)')} AS accuracy FROM o, c WHERE pos <= floor(n*coverage) GROUP BY coverage""",
)
def fixed_coverage_accuracy(spark, d):
    return mt.accuracy_at_coverage(test_rows(spark, d), F.col("preda") != F.col("label"), pr.confidence(F.col("pa")))


def _grid(a: float, b: float, s: float) -> str:
    return "grid(t) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in steps(a, b, s)) + ")"


_CURVE = _TEST + f", {_grid(0.5, 1.0, 0.01)}, c AS (SELECT t AS threshold, count(*) AS total, count(*) FILTER (WHERE ca >= t) AS n, count(*) FILTER (WHERE ca >= t AND preda=label) AS hit FROM t, grid GROUP BY t) "


@query("coverage_curve", _CURVE + f"SELECT threshold, {R('n/total')} AS coverage, {R('hit/nullif(n,0)')} AS accuracy, n AS n_predicted, hit AS n_correct, total-n AS n_deferred FROM c")
def coverage_curve(spark, d):
    t = test_rows(spark, d)
    return gt.coverage_curve(t, F.col("preda") == F.col("label"), pr.confidence(F.col("pa")))


@query("selective_risk", _CURVE + f"SELECT threshold, {R('n/total')} AS coverage, {R('hit/nullif(n,0)')} AS accuracy, n AS n_predicted, hit AS n_correct, total-n AS n_deferred, {R('1-hit/nullif(n,0)')} AS risk FROM c WHERE threshold = 0.6::DOUBLE")
def selective_risk(spark, d):
    return gt.selective_risk(test_rows(spark, d), F.col("preda") == F.col("label"), pr.confidence(F.col("pa")), 0.60)


_PCT = _grid(0.4, 0.96, 0.01) + """, n AS (SELECT preda AS pred, t, count(*) FILTER (WHERE ca>=t) AS n, count(*) FILTER (WHERE ca>=t AND label=preda) AS hit, count(*) AS tot FROM scores, grid WHERE split='cal' GROUP BY preda, t),
pct AS (SELECT pred, coalesce(arg_max(t, n*1000 - t) FILTER (WHERE n >= 5 AND tot >= 5 AND hit/n >= 0.8::DOUBLE), 0.5::DOUBLE) AS threshold FROM n GROUP BY pred)"""


@query("per_class_thresholds", "WITH " + SCORES_SQL + ", " + _PCT + " SELECT pred, threshold FROM pct")
def per_class_thresholds(spark, d):
    cal = scores(spark, d).where("split = 'cal'")
    return gt.per_class_thresholds(cal, "label", "preda", pr.confidence(F.col("pa")))


def _gated(spark, d):
    s = scores(spark, d).withColumn("conf", pr.confidence(F.col("pa")))
    th = gt.per_class_thresholds(s.where("split = 'cal'"), "label", "preda", F.col("conf"))
    return gt.gate_per_class(s.where("split = 'test'"), th, "preda")


@query("gate_apply", "WITH " + SCORES_SQL + ", " + _PCT + f" SELECT id, {R('ca')} AS conf, ca >= coalesce(threshold, 0.5::DOUBLE) AS is_confident, CASE WHEN ca >= coalesce(threshold, 0.5::DOUBLE) THEN preda ELSE -1 END AS gated FROM scores LEFT JOIN pct ON preda=pred WHERE split='test'")
def gate_apply(spark, d):
    return _gated(spark, d).select("id", "conf", "is_confident", "gated")


@query(
    "operating_point",
    "WITH "
    + SCORES_SQL
    + ", "
    + _PCT
    + f""", {_grid(0.5, 1.0, 0.01).replace('grid(t)', 'grid2(t)')}, op AS (SELECT avg(c::INT) AS op_coverage, avg((label=preda)::INT) FILTER (WHERE c) AS op_accuracy FROM (SELECT label, preda, ca >= coalesce(threshold, 0.5::DOUBLE) AS c FROM scores LEFT JOIN pct ON preda=pred WHERE split='test')),
cv AS (SELECT t AS threshold, count(*) AS total, count(*) FILTER (WHERE ca >= t) AS n, count(*) FILTER (WHERE ca >= t AND preda=label) AS hit FROM scores, grid2 WHERE split='test' GROUP BY t)
SELECT threshold, {R('n/total')} AS coverage, {R('hit/nullif(n,0)')} AS accuracy, n AS n_predicted, hit AS n_correct, total-n AS n_deferred, {R('op_coverage')} AS op_coverage, {R('op_accuracy')} AS op_accuracy,
threshold = (SELECT threshold FROM cv, op ORDER BY abs(n/total - op_coverage), threshold LIMIT 1) AS is_operating_point FROM cv, op""",
)
def operating_point(spark, d):
    s = scores(spark, d).withColumn("conf", pr.confidence(F.col("pa")))
    th = gt.per_class_thresholds(s.where("split = 'cal'"), "label", "preda", F.col("conf"))
    return gt.operating_point(s.where("split = 'test'"), th, F.col("preda") == F.col("label"), pred="preda")


@query("precision_threshold", _TEST + f", {_grid(0.5, 0.99, 0.01)}, c AS (SELECT t, count(*) FILTER (WHERE ca>=t) AS n, count(*) FILTER (WHERE ca>=t AND preda=label) AS hit FROM t, grid GROUP BY t) SELECT coalesce((SELECT t FROM c WHERE n >= 10 AND hit/n >= 0.9::DOUBLE ORDER BY n DESC, t LIMIT 1), 0.5::DOUBLE) AS threshold")
def precision_threshold(spark, d):
    return gt.threshold_for_precision(test_rows(spark, d), F.col("preda") == F.col("label"), pr.confidence(F.col("pa")))


@query("accuracy_threshold", _CURVE + "SELECT coalesce((SELECT threshold FROM c WHERE n>0 AND hit/n >= 0.9::DOUBLE AND n/total >= 0.1::DOUBLE ORDER BY n DESC, threshold LIMIT 1), (SELECT threshold FROM c WHERE n>0 ORDER BY hit/n DESC, threshold LIMIT 1)) AS threshold")
def accuracy_threshold(spark, d):
    return gt.threshold_for_accuracy(test_rows(spark, d), F.col("preda") == F.col("label"), pr.confidence(F.col("pa")))


@query("coverage_thresholds", _TEST + f", g(target) AS (VALUES (0.5::DOUBLE),(0.7::DOUBLE),(0.9::DOUBLE)) SELECT target, {R('(SELECT CASE target WHEN 0.5::DOUBLE THEN quantile_cont(ca, 0.5) WHEN 0.7::DOUBLE THEN quantile_cont(ca, 0.3) ELSE quantile_cont(ca, 0.1) END FROM t)')} AS threshold FROM g")
def coverage_thresholds(spark, d):
    return gt.threshold_for_coverage(test_rows(spark, d), pr.confidence(F.col("pa")), [0.5, 0.7, 0.9])


@query("margin_gate", _TEST + f", m AS (SELECT id, list_sort(pa, 'DESC') AS s, preda FROM t) SELECT id, {R('s[1]-s[2]')} AS margin, CASE WHEN s[1]-s[2] >= 0.1::DOUBLE THEN preda ELSE -1 END AS gated FROM m")
def margin_gate(spark, d):
    t = test_rows(spark, d).withColumn("margin", pr.margin(F.col("pa")))
    return gt.gate(t, 0.10, "preda", "margin").select("id", "margin", "gated")


@query("class_override", _TEST + "SELECT id, CASE WHEN pa[8] >= 0.15::DOUBLE THEN 7 WHEN pa[4] >= 0.2::DOUBLE THEN 3 ELSE preda END AS pred FROM t")
def class_override(spark, d):
    p = gt.override_classes(F.col("pa"), F.col("preda"), {3: 0.20, 7: 0.15})
    return test_rows(spark, d).select("id", p.alias("pred"))


def _cascaded(spark, d):
    t = test_rows(spark, d).withColumns({"ca": pr.confidence(F.col("pa")), "cb": pr.confidence(F.col("pb"))})
    first = gt.Stage("text", F.col("preda"), F.col("ca"), F.col("ca") >= 0.6, routing={-1: "next", 0: "next", 1: "next"})
    second = gt.Stage("meta", F.col("predb"), F.col("cb"), F.col("cb") >= 0.5, rows=F.col("label") < 8)
    return gt.cascade(t, [first, second])


_CASC = (
    _TEST
    + """, s1 AS (SELECT *, ca >= 0.6::DOUBLE AS ok1 FROM t), s2 AS (SELECT *, (NOT ok1 OR preda IN (0,1)) AS act FROM s1),
s3 AS (SELECT *, act AND label < 8 AS seen, act AND label < 8 AND cb >= 0.5::DOUBLE AS ok2 FROM s2),
cas AS (SELECT *, CASE WHEN ok2 THEN 'meta' WHEN ok1 THEN 'text' ELSE 'none' END AS final_stage, CASE WHEN ok2 THEN predb WHEN ok1 THEN preda ELSE -1 END AS final_pred, CASE WHEN ok2 THEN cb WHEN ok1 THEN ca ELSE 0.0::DOUBLE END AS final_conf, ok1 OR ok2 AS automated FROM s3) """
)


@query("cascade_route", _CASC + f"SELECT id, final_stage, final_pred, {R('final_conf')} AS final_conf, automated, ok1 AS text_confident, ok2 AS meta_confident FROM cas")
def cascade_route(spark, d):
    return _cascaded(spark, d).select("id", "final_stage", "final_pred", "final_conf", "automated", "text_confident", "meta_confident")


@query(
    "cascade_evaluation",
    _CASC
    + f""", g(point, t) AS (VALUES ('operating_point', -0.5::DOUBLE), {", ".join(f"('t_{x:.2f}', {x}::DOUBLE)" for x in gt.CASCADE_GRID)}),
m AS (SELECT max(c)/sum(c) AS m FROM (SELECT count(*) AS c FROM cas GROUP BY label))
SELECT point, {R('avg((final_pred=label)::INT)')} AS accuracy, {R('count(*)/(SELECT count(*) FROM cas)')} AS coverage, count(*) AS n_automated, (SELECT count(*) FROM cas)-count(*) AS n_deferred, {R('avg((final_pred=label)::INT) - max(m)')} AS lift FROM cas, g, m WHERE automated AND final_conf >= t GROUP BY point""",
)
def cascade_evaluation(spark, d):
    return gt.cascade_curve(_cascaded(spark, d), "label")


@query(
    "rescue_merge",
    _CASC + "SELECT id, final_pred, automated, NOT automated AND cb >= 0.3::DOUBLE AS rescued, CASE WHEN NOT automated AND cb >= 0.3::DOUBLE THEN predb ELSE final_pred END AS final_pred_all, automated OR cb >= 0.3::DOUBLE AS automated_all FROM cas",
)
def rescue_merge(spark, d):
    second = test_rows(spark, d).select("id", F.col("predb").alias("second_pred"), pr.confidence(F.col("pb")).alias("second_conf"))
    r = gt.rescue(_cascaded(spark, d), second, 0.3)
    return r.select("id", "final_pred", "automated", "rescued", "final_pred_all", "automated_all")


@query("automation_rate", _CASC + f"SELECT count(*) AS n_total, count(*) FILTER (WHERE automated) AS n_automated, {R('avg((label=final_pred)::INT) FILTER (WHERE automated)')} AS accuracy_auto, count(*) FILTER (WHERE NOT automated) AS n_deferred, {R('100.0*avg(automated::INT)')} AS reduction_pct FROM cas")
def automation_rate(spark, d):
    return mt.automation(_cascaded(spark, d), "label", "final_pred", "automated")


# --- binary threshold searches -----------------------------------------------------------------

_DEF = "WITH " + DEFECTS_SQL + ", t AS (SELECT * FROM defects WHERE split='test') "


def _def_test(spark, d):
    return defects(spark, d).where("split = 'test'")


@query(
    "pr_optimal_threshold",
    _DEF
    + f""", s AS (SELECT p, sum(y) AS pos, count(*)-sum(y) AS neg FROM t GROUP BY p), r AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM s),
o AS (SELECT p, tp/(tp+fp) AS prec, tp, tp/(SELECT sum(y) FROM t) AS rec FROM r), a AS (SELECT *, prec >= 0.9::DOUBLE AS ok FROM o)
SELECT {R('p')} AS threshold, {R('prec')} AS precision, {R('rec')} AS recall FROM a ORDER BY ok DESC, CASE WHEN ok THEN tp ELSE prec END DESC, p LIMIT 1""",
)
def pr_optimal_threshold(spark, d):
    return gt.pr_optimal_threshold(_def_test(spark, d), F.col("y"), F.col("p"))


_SWEEP = """c AS (SELECT t AS threshold, count(*) AS tot, sum(y) AS pos, count(*) FILTER (WHERE {k}) AS n, count(*) FILTER (WHERE {k} AND {d} AND y=1) AS tp, count(*) FILTER (WHERE {k} AND {d} AND y=0) AS fp, count(*) FILTER (WHERE {k} AND NOT ({d}) AND y=1) AS fn FROM t, grid GROUP BY t) """
_F = "coalesce({b}*tp/nullif({b}*tp+{c}*fn+fp,0),0)"


@query(
    "gate_sweep",
    _DEF + ", " + _grid(0.1, 0.96, 0.05) + ", " + _SWEEP.format(k="greatest(p,1.0::DOUBLE-p) >= t", d="p >= 0.5::DOUBLE")
    + f"SELECT threshold, {R('(n-fp-fn)/n')} AS accuracy, {R('n/tot')} AS coverage, n AS n_covered, {R('coalesce(tp/nullif(tp+fp,0),0)')} AS precision, {R('coalesce(tp/nullif(tp+fn,0),0)')} AS recall, {R('tp/greatest(pos,1)')} AS true_recall, {R(_F.format(b=2, c=1))} AS f1, {R(_F.format(b=5, c=4))} AS f2 FROM c WHERE n > 0",
)
def gate_sweep(spark, d):
    return gt.gate_sweep(_def_test(spark, d), F.col("y"), F.col("p"))


@query(
    "class_sweep",
    _DEF + ", " + _grid(0.1, 0.55, 0.05) + ", " + _SWEEP.format(k="TRUE", d="p >= t")
    + f"SELECT threshold, {R('(tot-fp-fn)/tot')} AS accuracy, {R('coalesce(tp/nullif(tp+fp,0),0)')} AS precision, {R('coalesce(tp/nullif(tp+fn,0),0)')} AS recall, {R(_F.format(b=2, c=1))} AS f1, {R(_F.format(b=5, c=4))} AS f2 FROM c",
)
def class_sweep(spark, d):
    return gt.class_sweep(_def_test(spark, d), F.col("y"), F.col("p"))


@query("flag_recall", _DEF + f", grid(t) AS (VALUES (0.08::DOUBLE),(0.1::DOUBLE),(0.15::DOUBLE),(0.2::DOUBLE),(0.3::DOUBLE)) SELECT t AS threshold, count(*) FILTER (WHERE p>=t) AS flagged, {R('avg((p>=t)::INT)')} AS share, {R('sum(y) FILTER (WHERE p>=t)/sum(y)')} AS recall FROM t, grid GROUP BY t")
def flag_recall(spark, d):
    return gt.flag_recall(_def_test(spark, d), F.col("y"), F.col("p"))


@query(
    "stage_thresholds",
    _DEF + ", " + _grid(0.4, 0.96, 0.01)
    + """, c AS (SELECT t, count(*) AS tot, sum(y) AS pos, count(*) FILTER (WHERE k) AS n, count(*) FILTER (WHERE k AND d) AS pp, count(*) FILTER (WHERE k AND d AND y=1) AS tp, count(*) FILTER (WHERE k AND NOT d AND y=1) AS fn, count(*) FILTER (WHERE k AND d=(y=1)) AS hit
 FROM (SELECT y, t, p>=0.5::DOUBLE AS d, greatest(p,1.0::DOUBLE-p)>=t AS k FROM t, grid) GROUP BY t),
f AS (SELECT *, coalesce(tp/nullif(pp,0),0) AS prec, pp/pos AS ra, coalesce(tp/nullif(tp+fn,0),0) AS rec, hit/nullif(n,0) AS acc, n/tot AS cov FROM c),
h AS (SELECT *, coalesce(2*prec*ra/nullif(prec+ra,0),0) AS finv, coalesce(2*prec*rec/nullif(prec+rec,0),0)+0.1::DOUBLE*cov AS sc FROM f)
SELECT coalesce((SELECT t FROM h WHERE t>=0.5::DOUBLE AND n>=10 AND pp>0 AND prec>=0.8::DOUBLE AND finv>0 ORDER BY finv DESC, t LIMIT 1), 0.7::DOUBLE) AS invalid_threshold,
coalesce((SELECT t FROM h WHERE t<0.9::DOUBLE AND n>=20 AND acc>=0.7::DOUBLE ORDER BY acc*cov DESC, t LIMIT 1), 0.5::DOUBLE) AS disposition_threshold,
coalesce((SELECT min(t) FROM h WHERE t>=0.7::DOUBLE AND pp>0 AND prec>=0.85::DOUBLE), 0.8::DOUBLE) AS noise_threshold,
coalesce((SELECT t FROM h WHERE t<0.9::DOUBLE AND n>=10 AND sc>0 ORDER BY sc DESC, t LIMIT 1), 0.5::DOUBLE) AS linkage_threshold""",
)
def stage_thresholds(spark, d):
    return gt.stage_thresholds(_def_test(spark, d), F.col("y"), F.col("p"))


# --- metrics -----------------------------------------------------------------------------------

_CONF_OUT = f"""tp, fp, fn, tn, {R('(tp+tn)/(tp+fp+fn+tn)')} AS accuracy, {R('coalesce(tp/nullif(tp+fp,0),0)')} AS precision, {R('coalesce(tp/nullif(tp+fn,0),0)')} AS recall,
{R(_F.format(b=2, c=1))} AS f1, {R(_F.format(b=5, c=4))} AS f2, {R('coalesce(fp/nullif(fp+tn,0),0)')} AS fpr,
{R('coalesce((tp*tn-fp*fn)/nullif(sqrt((tp+fp)::DOUBLE*(tp+fn)*(tn+fp)*(tn+fn)),0),0)')} AS mcc"""
_CONF = "count(*) FILTER (WHERE {d} AND y=1) AS tp, count(*) FILTER (WHERE {d} AND y=0) AS fp, count(*) FILTER (WHERE NOT ({d}) AND y=1) AS fn, count(*) FILTER (WHERE NOT ({d}) AND y=0) AS tn"


@query("binary_metrics", _DEF + f", c AS (SELECT {_CONF.format(d='p>=0.5::DOUBLE')} FROM t) SELECT {_CONF_OUT} FROM c")
def binary_metrics(spark, d):
    return mt.binary_metrics(_def_test(spark, d), F.col("y"), pr.binary_predicted(F.col("p")))


@query("segment_metrics", _DEF + f", c AS (SELECT id%5 AS segment, {_CONF.format(d='p>=0.5::DOUBLE')} FROM t GROUP BY 1 HAVING count(*) >= 50) SELECT segment, {_CONF_OUT} FROM c")
def segment_metrics(spark, d):
    t = _def_test(spark, d).withColumn("segment", F.col("id") % 5)
    return mt.binary_metrics(t, F.col("y"), pr.binary_predicted(F.col("p")), ["segment"], min_rows=50)


@query(
    "threshold_model_comparison",
    _DEF
    + f""", m AS (SELECT 'text' AS model, y, p FROM t UNION ALL SELECT 'meta', y, p2 FROM t), c AS (SELECT model, {_CONF.format(d='p>=0.4::DOUBLE')} FROM m GROUP BY model) SELECT model, {_CONF_OUT} FROM c ORDER BY precision DESC, f1 DESC""",
)
def threshold_model_comparison(spark, d):
    t = _def_test(spark, d)
    long = t.select("y", F.inline(F.array(F.struct(F.lit("text").alias("model"), F.col("p").alias("p")), F.struct(F.lit("meta").alias("model"), F.col("p2").alias("p")))))
    m = mt.binary_metrics(long, F.col("y"), (F.col("p") >= 0.4).cast("int"), ["model"])
    return m.orderBy(F.desc("precision"), F.desc("f1"))


_AUC = """SELECT {o} sum(CASE WHEN a.p>b.p THEN 1.0 WHEN a.p=b.p THEN 0.5 ELSE 0.0 END)/count(*) FROM t a, t b WHERE a.y=1 AND b.y=0"""


@query(
    "ranking_metrics",
    _DEF
    + f""", s AS (SELECT p, sum(y) AS pos, count(*)-sum(y) AS neg FROM t GROUP BY p), r AS (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM s)
SELECT {R('(' + _AUC.format(o='') + ')')} AS roc_auc, {R('sum(pos*tp/(tp+fp))/sum(pos)')} AS pr_auc FROM r""",
)
def ranking_metrics(spark, d):
    return mt.ranking_metrics(_def_test(spark, d), F.col("y"), F.col("p"))


@query("auc_ovr", _TEST + f", l AS (SELECT label, unnest(range(0,{CLASSES}))::INT AS class, unnest(pa) AS p FROM t), x AS (SELECT class, p, (label=class)::INT AS y FROM l), s AS (SELECT class, p, sum(y) AS pos, count(*)-sum(y) AS neg FROM x GROUP BY ALL), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY class ORDER BY p DESC)) SELECT class, {R('sum(neg*(tp-pos/2.0))/(sum(pos)*sum(neg))')} AS roc_auc, {R('sum(pos*tp/(tp+fp))/sum(pos)')} AS pr_auc FROM r GROUP BY class")
def auc_ovr(spark, d):
    return mt.auc_ovr(test_rows(spark, d), "label", "pa", CLASSES)


@query("curve_points", _DEF + f", s AS (SELECT p, sum(y) AS pos, count(*)-sum(y) AS neg FROM t GROUP BY p), r AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM s) SELECT {R('p')} AS score, {R('fp/nn')} AS fpr, {R('tp/np')} AS tpr, {R('tp/(tp+fp)')} AS precision FROM r")
def curve_points(spark, d):
    return mt.curve_points(_def_test(spark, d), F.col("y"), F.col("p"))


_PC = """, u AS (SELECT label AS class FROM t UNION SELECT preda FROM t), pc AS (SELECT class, (SELECT count(*) FROM t WHERE label=class) AS support, (SELECT count(*) FROM t WHERE preda=class) AS predicted, (SELECT count(*) FROM t WHERE preda=class AND label=class) AS hits FROM u),
pm AS (SELECT *, coalesce(hits/nullif(predicted,0),0)::DOUBLE AS precision, coalesce(hits/nullif(support,0),0)::DOUBLE AS recall, coalesce(2.0*hits/nullif(support+predicted,0),0)::DOUBLE AS f1 FROM pc) """


@query("per_class_metrics", _TEST + _PC + f"SELECT class, support, predicted, hits, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1 FROM pm")
def per_class_metrics(spark, d):
    return mt.per_class(test_rows(spark, d), "label", "preda")


_MC = ", ".join(f"{R(f'avg({m})')} AS {m}_macro, {R(f'sum({m}*support)/sum(support)')} AS {m}_weighted" for m in ("precision", "recall", "f1"))


@query("multiclass_metrics", _TEST + _PC + f"SELECT {R('sum(hits)/sum(support)')} AS accuracy, {_MC}, {R('avg(recall) FILTER (WHERE support > 0)')} AS balanced_accuracy FROM pm")
def multiclass_metrics(spark, d):
    return mt.multiclass_metrics(test_rows(spark, d), "label", "preda")


@query("confusion_matrix", _TEST + "SELECT label, predb AS pred, count(*) AS n FROM t GROUP BY ALL")
def confusion_matrix(spark, d):
    return mt.confusion_matrix(test_rows(spark, d), "label", "predb")


@query("reliability_bins", _DEF + f"SELECT least(floor(p*10),9)::INT AS bin, {R('avg(p)')} AS mean_predicted, {R('avg(y)')} AS positive_rate, count(*) AS n FROM t GROUP BY 1")
def reliability_bins(spark, d):
    return mt.reliability(_def_test(spark, d), F.col("y"), F.col("p"))


@query("stage_metrics", "WITH " + SCORES_SQL + ", t AS (SELECT * FROM scores WHERE split='test' AND ca >= 0.5::DOUBLE) " + _PC + f""", n AS (SELECT count(*) AS n_total, count(*) FILTER (WHERE ca >= 0.5::DOUBLE) AS n_confident FROM scores WHERE split='test')
SELECT n_total, n_confident, accuracy, precision_macro, recall_macro, f1_macro, f1_weighted, n_total-n_confident AS n_deferred, {R('n_confident/n_total')} AS coverage FROM n, (SELECT {R('sum(hits)/sum(support)')} AS accuracy, {_MC} FROM pm)""")
def stage_metrics(spark, d):
    return mt.stage_metrics(test_rows(spark, d), "label", "preda", pr.confidence(F.col("pa")) >= 0.5)


@query("majority_lift", _TEST + f", c AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE label=preda) AS hit FROM t GROUP BY label) SELECT (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS majority_class, {R('max(n)/sum(n)')} AS majority_accuracy, {R('sum(hit)/sum(n)')} AS accuracy, {R('sum(hit)/sum(n)-max(n)/sum(n)')} AS lift FROM c")
def majority_lift(spark, d):
    return mt.majority_lift(test_rows(spark, d), "label", "preda")


# --- tiers, uncertainty --------------------------------------------------------------------------

_TIER = "CASE WHEN {p} >= 0.5::DOUBLE THEN 'CRITICAL' WHEN {p} >= 0.35::DOUBLE THEN 'HIGH' WHEN {p} >= 0.2::DOUBLE THEN 'ELEVATED' WHEN {p} >= 0.1::DOUBLE THEN 'LOW' ELSE 'MINIMAL' END"
_TR = "CASE {t} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'ELEVATED' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


@query(
    "risk_tiers",
    _DEF
    + f""", x AS (SELECT id, y, p, abs(p-p2) AS var, {_TIER.format(p='p')} AS tier FROM t), m AS (SELECT quantile_cont(var, 0.85) AS v FROM x WHERE p >= 0.1::DOUBLE AND p < 0.5::DOUBLE)
SELECT id, tier, p >= 0.5::DOUBLE OR p < 0.1::DOUBLE OR var <= v AS confident FROM x, m""",
)
def risk_tiers(spark, d):
    """Tiers; rows of the middle band with a high score variance are marked unsure."""
    t = _def_test(spark, d).withColumn("var", F.abs(F.col("p") - F.col("p2")))
    mid = (F.col("p") >= 0.10) & (F.col("p") < 0.50)
    q = quantiles(t.where(mid), [], "var", {"_v": Quantile(0.85)}).select("_v")
    return with_scalars(t, q).select("id", mt.tier(F.col("p")).alias("tier"), (~mid | (F.col("var") <= F.col("_v"))).alias("confident"))


@query(
    "tier_table",
    _DEF
    + f""", x AS (SELECT {_TIER.format(p='p')} AS tier, count(*) AS n, sum(y) AS n_pos FROM t GROUP BY 1), z AS (SELECT *, sum(n) OVER w AS cum_n, sum(n_pos) OVER w AS cum_pos, sum(n) OVER () AS tn, sum(n_pos) OVER () AS tp FROM x WINDOW w AS (ORDER BY {_TR.format(t='tier')}))
SELECT tier, n, {R('n/tn')} AS share, n_pos, {R('n_pos/n')} AS rate, {R('(n_pos/n)/(tp/tn)')} AS lift, cum_n, cum_pos, {R('cum_pos/tp')} AS cum_recall FROM z""",
)
def tier_table(spark, d):
    return mt.tier_table(_def_test(spark, d), F.col("y"), F.col("p"))


@query("top_share_recall", _DEF + f", q AS (SELECT quantile_cont(p, 0.84) AS c FROM t) SELECT {R('sum(y) FILTER (WHERE p >= c)/sum(y)')} AS recall, count(*) FILTER (WHERE p >= c) AS n_flagged FROM t, q")
def top_share_recall(spark, d):
    """Recall among the 16 % of rows with the highest score."""
    t = _def_test(spark, d)
    t = with_scalars(t, quantiles(t, [], "p", {"_c": Quantile(0.84)}).select("_c"))
    top = F.col("p") >= F.col("_c")
    return t.agg((F.sum(F.when(top, F.col("y"))) / F.sum("y")).alias("recall"), F.count_if(top).alias("n_flagged"))


@query(
    "tier_change_quality",
    _DEF
    + f""", x AS (SELECT y, {_TIER.format(p='p')} AS b, {_TIER.format(p='p2')} AS a FROM t), z AS (SELECT y, {_TR.format(t='b')} AS b, {_TR.format(t='a')} AS a FROM x)
SELECT CASE WHEN a=b THEN 'unchanged' WHEN y=1 AND a<b THEN 'GOOD (defective moved up)' WHEN y=0 AND a>b THEN 'GOOD (clean moved down)' WHEN y=1 THEN 'BAD (defective moved down)' ELSE 'BAD (clean moved up)' END AS quality, count(*) AS n FROM z GROUP BY 1""",
)
def tier_change_quality(spark, d):
    return mt.tier_change_quality(_def_test(spark, d), F.col("y"), mt.tier(F.col("p")), mt.tier(F.col("p2")))


# --- resampling -----------------------------------------------------------------------------------

_B = 1000


def _boot(key: str) -> str:
    return f"boot AS (SELECT t.*, b, {poisson_weight_sql(key, 'boot', 'b')} AS w FROM t, range(1,{_B + 1}) x(b))"


_CI = f"{R('avg(v)')} AS mean, {R('quantile_cont(v, 0.025)')} AS lower, {R('quantile_cont(v, 0.975)')} AS upper"


@query("bootstrap_accuracy", _TEST + f", {_boot('id')}, s AS (SELECT b, sum(w*(preda=label)::INT)/sum(w) AS v FROM boot GROUP BY b) SELECT {_CI} FROM s")
def bootstrap_accuracy(spark, d):
    return rs.bootstrap_accuracy(test_rows(spark, d), F.col("id"), F.col("preda") == F.col("label"), _B)


@query("bootstrap_recall", _DEF + f", {_boot('id')}, s AS (SELECT b, sum(w*y*(p>=0.5::DOUBLE)::INT)/sum(w*y) AS v FROM boot GROUP BY b) SELECT {_CI} FROM s")
def bootstrap_recall(spark, d):
    return rs.bootstrap_recall(_def_test(spark, d), F.col("id"), F.col("y"), pr.binary_predicted(F.col("p")), _B)


@query("bootstrap_accuracy_counts")
def bootstrap_accuracy_counts(spark, d):
    """Rows are counted first; the draws do not grow with the table."""
    return rs.bootstrap_accuracy(test_rows(spark, d), None, F.col("preda") == F.col("label"), 1000)


_BC = ", ".join(f"{R(f'avg({v})')} AS {n}_mean, {R(f'quantile_cont({v}, 0.025)')} AS {n}_lower, {R(f'quantile_cont({v}, 0.975)')} AS {n}_upper" for v, n in (("c", "coverage"), ("a", "accuracy")))


@query("bootstrap_curve", _TEST + f", {_grid(0.4, 0.96, 0.1)}, {_boot('id')}, s AS (SELECT t AS threshold, b, coalesce(sum(w) FILTER (WHERE ca>=t),0)/sum(w) AS c, sum(w*(preda=label)::INT) FILTER (WHERE ca>=t)/nullif(sum(w) FILTER (WHERE ca>=t),0) AS a FROM boot, grid GROUP BY ALL) SELECT threshold, {_BC} FROM s GROUP BY threshold")
def bootstrap_curve(spark, d):
    t = test_rows(spark, d)
    return rs.bootstrap_curve(t, F.col("id"), F.col("preda") == F.col("label"), pr.confidence(F.col("pa")), steps(0.4, 0.96, 0.1), _B)


@query(
    "bootstrap_augrc",
    _TEST
    + f""", {_boot('id')}, o AS (SELECT b, w, (preda<>label)::INT AS err, ca, id FROM boot WHERE w > 0),
x AS (SELECT b, err, row_number() OVER (PARTITION BY b ORDER BY ca DESC, id, c) AS pos FROM o, LATERAL (SELECT unnest(range(0, w)) AS c)),
c AS (SELECT b, pos, err, sum(err) OVER (PARTITION BY b ORDER BY pos) AS ce, count(*) OVER (PARTITION BY b) AS n FROM x),
z AS (SELECT b, n, (ce + lag(ce) OVER (PARTITION BY b ORDER BY pos))/2.0 AS a FROM c), s AS (SELECT b, sum(a)/max(n)/max(n) AS v FROM z GROUP BY b) SELECT {_CI} FROM s""",
)
def bootstrap_augrc(spark, d):
    return rs.bootstrap_augrc(test_rows(spark, d), F.col("preda") != F.col("label"), pr.confidence(F.col("pa")), _B)


_MACRO = " + ".join(f"coalesce(2.0::DOUBLE*sum(w*(label={k} AND preda={k})::INT)/nullif(sum(w*(label={k})::INT)+sum(w*(preda={k})::INT),0),0)" for k in range(10))
_SEEN = " + ".join(f"(sum(w*(label={k})::INT)+sum(w*(preda={k})::INT) > 0)::INT" for k in range(10))


@query(
    "bootstrap_metrics",
    _TEST
    + f""", {_boot('id')}, s AS (SELECT agree, b, sum(w*(preda=label)::INT)/nullif(sum(w),0) AS acc, ({_MACRO})/nullif({_SEEN},0) AS macro FROM boot GROUP BY agree, b),
l AS (SELECT agree, 'accuracy' AS metric, acc AS v FROM s UNION ALL SELECT agree, 'macro_f1', macro FROM s) SELECT agree, metric, {_CI}, {R('stddev_pop(v)')} AS std FROM l GROUP BY agree, metric""",
)
def bootstrap_metrics(spark, d):
    """Two metrics over the same resamples, by agreement of the two models."""
    metrics = {"accuracy": rs.accuracy(F.col("preda") == F.col("label")), "macro_f1": rs.macro_f1(F.col("label"), F.col("preda"), range(10))}
    return rs.bootstrap(test_rows(spark, d), F.col("id"), metrics, _B, ["agree"])


@query(
    "bootstrap_cascade",
    _TEST
    + f""", m AS (SELECT label AS major FROM t GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), {_boot('id')},
s AS (SELECT b, sum(w*(ca>=0.6::DOUBLE)::INT*(preda=label)::INT)/nullif(sum(w*(ca>=0.6::DOUBLE)::INT),0) AS acc, sum(w*(ca>=0.6::DOUBLE)::INT)/sum(w) AS cov, sum(w*(label=(SELECT major FROM m))::INT)/sum(w) AS maj FROM boot GROUP BY b),
l AS (SELECT unnest(['accuracy','coverage','majority_baseline','accuracy_lift']) AS metric, unnest([acc, cov, maj, acc-maj]) AS v FROM s) SELECT metric, {_CI}, {R('stddev_pop(v)')} AS std FROM l GROUP BY metric""",
)
def bootstrap_cascade(spark, d):
    """End-to-end metrics of a gated model with the lift over the majority class."""
    t = test_rows(spark, d)
    major = t.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]  # a row for each class
    return rs.bootstrap(t, F.col("id"), rs.cascade_metrics(F.col("preda") == F.col("label"), pr.confidence(F.col("pa")) >= 0.6, F.col("label") == major), _B)


@query("mcnemar_counts", _TEST + f", c AS (SELECT count(*) FILTER (WHERE preda=label AND predb<>label) AS b, count(*) FILTER (WHERE preda<>label AND predb=label) AS c FROM t) SELECT b AS a_only, c AS b_only, {R('(abs(b-c)-1)**2/(b+c)')} AS statistic, (abs(b-c)-1)**2/(b+c) > 3.841459 AS significant FROM c")
def mcnemar_counts(spark, d):
    return rs.mcnemar(test_rows(spark, d), F.col("preda") == F.col("label"), F.col("predb") == F.col("label")).drop("p_value")


@query("mcnemar_test")
def mcnemar_test(spark, d):
    return rs.mcnemar(test_rows(spark, d), F.col("preda") == F.col("label"), F.col("predb") == F.col("label"))


# --- explanations ---------------------------------------------------------------------------------


def explained(spark, d):
    t = cf.conformal_run(scores(spark, d), F.col("pa"), ["agree"], TEN)
    return ex.explain(t.withColumn("pset", pr.prediction_set(F.col("pa"), F.col("s0"))), 0.10)


_ACT = """CASE WHEN sz=1 AND agree THEN 'AUTO-TRIAGE' WHEN sz=1 THEN 'AUTO-TRIAGE WITH CAUTION' WHEN sz<=3 THEN 'REVIEW SHORTLIST' WHEN sz<=5 THEN 'REVIEW NEEDED' ELSE 'NEEDS CAREFUL REVIEW' END"""
_CT = "CASE WHEN ca > 0.85 OR (agree AND ca > 0.70) THEN 'HIGH' WHEN ca >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"
_PCT_SQL = "(round_even({x}*100, 0)::INT::VARCHAR || '%')"


@query(
    "explanations",
    conformal_sql("pa", "agree", TEN)
    + f""", pb AS (SELECT id AS pid, pb FROM scores), al AS (SELECT s.id, string_agg(CASE WHEN NOT s.agree AND rk.k = s.predb THEN 'Class_' || rk.k || ' -- ranked #1 by the metadata model (' || {_PCT_SQL.format(x='pb.pb[rk.k+1]')} || ' confidence). Highest probability from metadata patterns.'
 ELSE 'Class_' || rk.k || ' -- ranked #' || rk.rk || ' by the text model (' || {_PCT_SQL.format(x='rk.v')} || ' confidence). Included to meet 90% coverage guarantee.' END, '|' ORDER BY rk.rk) FILTER (WHERE rk.k <> s.preda) AS alternatives,
 string_agg('Class_' || rk.k, ',' ORDER BY rk.rk) AS prediction_set FROM sets s JOIN rk ON s.id=rk.id AND rk.rk <= s.sz JOIN pb ON pb.pid=s.id GROUP BY s.id)
SELECT s.id, sz AS set_size, CASE WHEN agree THEN 'AGREE' ELSE 'DISAGREE' END AS agreement_status, {_CT} AS confidence_tier, {_ACT} AS action_kind, prediction_set, coalesce(alternatives,'') AS alternatives,
CASE WHEN agree THEN 'High -- both models agree. In similar cases, accuracy is ~86%.' WHEN {_CT} = 'HIGH' THEN 'Moderate -- models disagree but the text model is very confident. Review recommended.' ELSE 'Low -- models disagree. In similar cases, accuracy is ~27%. Careful review recommended.' END AS reliability_estimate,
'Class_' || preda || ' -- ranked #1 by the text model (' || {_PCT_SQL.format(x='ca')} || ' confidence). ' || CASE WHEN agree THEN 'Both models agree on this component.' ELSE 'Highest probability from text analysis.' END AS top_candidate FROM sets s JOIN al USING (id)""",
)
def explanations(spark, d):
    return explained(spark, d).select(
        "id",
        "set_size",
        "agreement_status",
        "confidence_tier",
        "action_kind",
        F.array_join("prediction_set", ",").alias("prediction_set"),
        F.array_join("alternative_candidates", "|").alias("alternatives"),
        "reliability_estimate",
        "top_candidate",
    )


@query(
    "explanation_reasoning",
    _TEST
    + f""", l AS (SELECT id, unnest(range(0,{CLASSES})) AS k, unnest(pa) AS a, unnest(pb) AS b FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a DESC, k) AS ra, row_number() OVER (PARTITION BY id ORDER BY b DESC, k) AS rb FROM l),
s AS (SELECT id, list('Class_' || k || ' (' || {_PCT_SQL.format(x='a')} || ')' ORDER BY ra) AS ta, list('Class_' || k || ' (' || {_PCT_SQL.format(x='b')} || ')' ORDER BY rb) AS tb FROM r GROUP BY id)
SELECT id, 'Text analysis points to ' || ta[1] || ' over ' || ta[2] || ' and ' || ta[3] || '.' AS text, 'Metadata patterns point to ' || tb[1] || ' over ' || tb[2] || ' and ' || tb[3] || '.' AS metadata FROM s""",
)
def explanation_reasoning(spark, d):
    return explained(spark, d).select("id", "model_reasoning.text", "model_reasoning.metadata")


@query(
    "explanation_summary",
    conformal_sql("pa", "agree", TEN)
    + f""", a AS (SELECT *, {_ACT} AS act, {_CT} AS ct FROM sets), one AS (SELECT count(*)::DOUBLE AS total, """
    + ", ".join(f"count(*) FILTER (WHERE act='{k}')::DOUBLE AS \"action {k}\"" for k in ["AUTO-TRIAGE", "AUTO-TRIAGE WITH CAUTION", "REVIEW SHORTLIST", "REVIEW NEEDED", "NEEDS CAREFUL REVIEW"])
    + ", count(*) FILTER (WHERE agree)::DOUBLE AS \"status AGREE\", count(*) FILTER (WHERE NOT agree)::DOUBLE AS \"status DISAGREE\", "
    + ", ".join(f"count(*) FILTER (WHERE ct='{k}')::DOUBLE AS \"confidence {k}\"" for k in ("HIGH", "MEDIUM", "LOW"))
    + f", avg(sz) AS avg_set_size, avg((NOT agree)::INT) AS different_top FROM a) SELECT metric, {R('value')} AS value FROM (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value)",
)
def explanation_summary(spark, d):
    return ex.summary(explained(spark, d))


@query(
    "example_picks",
    conformal_sql("pa", "agree", TEN)
    + """, c AS (SELECT id, CASE WHEN sz=1 AND agree AND rk<=sz THEN 'agree_singleton_correct' WHEN sz BETWEEN 2 AND 3 AND agree THEN 'agree_small_set' WHEN NOT agree AND rk<=sz THEN 'disagree_correct' WHEN NOT agree THEN 'disagree_incorrect' END AS category FROM sets)
SELECT id, category FROM c WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY id) <= CASE WHEN category LIKE 'agree%' THEN 3 ELSE 2 END""",
)
def example_picks(spark, d):
    """The first rows of each category, as a bounded top-k aggregate."""
    t = cf.conformal_run(scores(spark, d), F.col("pa"), ["agree"], TEN)
    hit, s, g = F.col("_rank") <= F.col("s0"), F.col("s0"), F.col("agree")
    cat = (
        F.when((s == 1) & g & hit, "agree_singleton_correct")
        .when(s.between(2, 3) & g, "agree_small_set")
        .when(~g & hit, "disagree_correct")
        .when(~g, "disagree_incorrect")
    )
    from alertsieve.operators.topk import first_k

    return first_k(t.select("id", cat.alias("category")).where("category is not null"), ["category"], ["id"], 3).where(
        (F.col("_rank") <= 2) | F.col("category").startswith("agree")
    ).select("id", "category")


@query("ranked_classes", _TEST + f", l AS (SELECT id, unnest(range(0,{CLASSES}))::INT AS cls, unnest(pa) AS p FROM t) SELECT id, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls)::INT AS rank, cls, {R('p')} AS prob FROM l")
def ranked_classes(spark, d):
    r = test_rows(spark, d).select("id", F.posexplode(pr.ranked(F.col("pa"))).alias("i", "c"))
    return r.select("id", (F.col("i") + 1).alias("rank"), F.col("c.cls").alias("cls"), F.col("c.p").alias("prob"))


@query(
    "deferral_explanations",
    "WITH " + SCORES_SQL + ", " + _PCT
    + f""", x AS (SELECT id, label, preda, ca, coalesce(threshold, 0.5::DOUBLE) AS th, pa FROM scores LEFT JOIN pct ON preda=pred WHERE split='test'), l AS (SELECT id, th, ca, unnest(range(0,{CLASSES})) AS k, unnest(pa) AS p FROM x WHERE ca < th),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, k) AS rk FROM l) SELECT id, string_agg(k::VARCHAR, ',' ORDER BY rk) FILTER (WHERE rk <= 3) AS top_classes, {R('max(th)')} AS threshold, {R('max(th)-max(ca)')} AS gap FROM r GROUP BY id""",
)
def deferral_explanations(spark, d):
    s = scores(spark, d).withColumn("conf", pr.confidence(F.col("pa")))
    th = gt.per_class_thresholds(s.where("split = 'cal'"), "label", "preda", F.col("conf")).withColumnRenamed("pred", "preda")
    from alertsieve.operators.lookup import lookup_join

    t = lookup_join(s.where("split = 'test'"), th, ["preda"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    t = t.where("conf < threshold")
    top = F.transform(F.slice(pr.ranked(F.col("pa")), 1, 3), lambda x: x["cls"].cast("string"))
    return t.select("id", F.array_join(top, ",").alias("top_classes"), "threshold", (F.col("threshold") - F.col("conf")).alias("gap"))


@query("padded_probs", _TEST + f"SELECT id, 12 AS k, {R('list_sum(pa)')} AS total, {R('pa[1]')} AS p0 FROM t")
def padded_probs(spark, d):
    p = pr.pad(F.col("pa"), 12)
    return test_rows(spark, d).select("id", F.size(p).alias("k"), F.aggregate(p, F.lit(0.0), lambda a, x: a + x).alias("total"), p[0].alias("p0"))
