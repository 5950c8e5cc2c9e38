"""Queries of the cascade over alert groups (orders) and their alerts (lineitem)."""

from __future__ import annotations

from pyspark.ml import classification as cl
from pyspark.sql import functions as F

from alertsieve.functions.random import keyed_uniform, keyed_uniform_sql
from alertsieve.operators import models as md
from alertsieve.operators import triage as tg
from alertsieve.plans.registry import R, query
from alertsieve.session import materialise
from alertsieve.sources.tables import table

STATUSES = [1, 2, 3, 4, 6, 7, 8]
ROLES = [1, 2, 3, 4]
LIMITS = tg.Thresholds(valid=0.55, invalid=0.75, disposition={1: 0.6, 4: 0.7}, other=0.65, role=0.6, noise=0.8, no_bug=0.6, has_bug=0.65)


def groups(spark, d):
    """Groups with a status, a bug flag, a repository and the scores of all stages, drawn by their key."""
    u = lambda s: keyed_uniform(F.col("id"), s)
    g = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("r"), F.col("o_custkey") % 4).alias("repo"),
        F.get(F.array(*[F.lit(s) for s in STATUSES]), (F.col("o_orderkey") % 7).cast("int")).alias("status"),
        (F.col("o_orderpriority") < "3").cast("int").alias("has_bug"),
    )
    kind = lambda scheme, s: F.when(u(s) < 0.7, tg.merged(F.col("status"), tg.SCHEMES[scheme])).otherwise(F.lit(7))
    return g.withColumns(
        {
            "p_invalid": F.when(F.col("status") == tg.INVALID, 0.4 + 0.6 * u("s0")).otherwise(0.6 * u("s0")),
            "s1_class": kind("4 classes", "s1"),
            "s1_conf": 0.4 + 0.6 * u("s1c"),
            "s1_class_5": kind("5 classes", "s5"),
            "s1_conf_5": 0.4 + 0.6 * u("s5c"),
            "p_bug_a": 0.5 * F.col("has_bug") + 0.5 * u("s3a"),
            "p_bug_b": 0.4 * F.col("has_bug") + 0.6 * u("s3b"),
        }
    )


def members(spark, d):
    li = table(spark, d, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    roles = F.array(*[F.lit(s) for s in ROLES])
    return li.select(
        F.col("l_orderkey").alias("summary_id"),
        F.col("l_linenumber").alias("line"),
        F.get(roles, ((F.col("l_orderkey") + F.col("l_linenumber")) % 4).cast("int")).alias("status"),
        F.get(roles, (F.col("l_partkey") % 4).cast("int")).alias("s2a_class"),
        (0.3 + 0.7 * keyed_uniform(key, "s2a")).alias("s2a_conf"),
        keyed_uniform(key, "s2b").alias("p_noise"),
    )


def _u(s: str) -> str:
    return keyed_uniform_sql("id", s)


def _merge_sql(scheme: str, c: str = "status") -> str:
    return "CASE " + " ".join(f"WHEN {c}={a} THEN {b}" for a, b in tg.SCHEMES[scheme].items()) + f" ELSE {c} END"


_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey"
_G = f"""WITH g0 AS (SELECT o_orderkey AS id, 'r' || (o_custkey % 4) AS repo, {STATUSES}[o_orderkey % 7 + 1] AS status, (o_orderpriority < '3')::INT AS has_bug FROM orders),
g AS (SELECT *, CASE WHEN status=3 THEN 0.4::DOUBLE+0.6::DOUBLE*{_u('s0')} ELSE 0.6::DOUBLE*{_u('s0')} END AS p_invalid, CASE WHEN {_u('s1')} < 0.7::DOUBLE THEN {_merge_sql('4 classes')} ELSE 7 END AS s1_class, 0.4::DOUBLE+0.6::DOUBLE*{_u('s1c')} AS s1_conf,
 CASE WHEN {_u('s5')} < 0.7::DOUBLE THEN {_merge_sql('5 classes')} ELSE 7 END AS s1_class_5, 0.4::DOUBLE+0.6::DOUBLE*{_u('s5c')} AS s1_conf_5, 0.5::DOUBLE*has_bug+0.5::DOUBLE*{_u('s3a')} AS pa, 0.4::DOUBLE*has_bug+0.6::DOUBLE*{_u('s3b')} AS pb FROM g0),
s0 AS (SELECT *, CASE WHEN p_invalid > 0.5 THEN CASE WHEN p_invalid >= 0.75 THEN 3 ELSE -1 END ELSE CASE WHEN 1-p_invalid >= 0.55::DOUBLE THEN 0 ELSE -1 END END AS s0_pred FROM g),
s1 AS (SELECT *, CASE WHEN s0_pred=3 THEN 3 WHEN s0_pred=0 AND s1_conf >= CASE s1_class WHEN 1 THEN 0.6::DOUBLE WHEN 4 THEN 0.7::DOUBLE ELSE 0.65::DOUBLE END THEN s1_class ELSE -1 END AS group_status FROM s0),
s2 AS (SELECT *, group_status <> -1 AS automated, CASE WHEN group_status <> -1 THEN pa ELSE pb END AS p FROM s1),
s3 AS (SELECT *, CASE WHEN s0_pred=3 THEN 1 WHEN p > 0.5 AND p >= 0.65::DOUBLE THEN 2 WHEN p <= 0.5 AND 1-p >= 0.6::DOUBLE THEN 1 ELSE 0 END AS s3_pred FROM s2) """
_M = (
    _G
    + f""", m0 AS (SELECT l_orderkey AS summary_id, l_linenumber AS line, {ROLES}[(l_orderkey+l_linenumber) % 4 + 1] AS status, {ROLES}[l_partkey % 4 + 1] AS s2a_class, 0.3::DOUBLE+0.7::DOUBLE*{keyed_uniform_sql('(' + _KEY + ')', 's2a')} AS c, {keyed_uniform_sql('(' + _KEY + ')', 's2b')} AS p_noise FROM lineitem),
m AS (SELECT m0.*, coalesce(CASE WHEN s3.s0_pred=3 THEN 'invalid' WHEN s3.automated THEN 'roles' ELSE 'noise' END, 'none') AS route FROM m0 LEFT JOIN s3 ON s3.id=summary_id),
md AS (SELECT *, CASE WHEN route='invalid' OR (route='noise' AND p_noise >= 0.8::DOUBLE) THEN 3 WHEN route='roles' AND c >= 0.6::DOUBLE THEN s2a_class ELSE -1 END AS member_status FROM m) """
)


@query("triage_groups", _G + "SELECT id, s0_pred, group_status, automated, s3_pred, CASE WHEN s0_pred=3 THEN 'shortcut_invalid' WHEN s3_pred=0 THEN 'uncertain' WHEN automated THEN 'model_A' ELSE 'model_B' END AS s3_source FROM s3")
def triage_groups(spark, d):
    """Gate, disposition and linkage of each group."""
    return tg.decide_groups(groups(spark, d), LIMITS).select("id", "s0_pred", "group_status", "automated", "s3_pred", "s3_source")


@query("triage_members", _M + "SELECT summary_id, line, route, member_status, member_status <> -1 AS member_automated FROM md")
def triage_members(spark, d):
    """Roles under confident groups, the noise filter under unsure ones."""
    decided = tg.decide_groups(groups(spark, d), LIMITS)
    return tg.decide_members(members(spark, d), decided, LIMITS).select("summary_id", "line", "route", "member_status", "member_automated")


_REPORT = f"""count(*) AS n_groups, count(*) FILTER (WHERE automated) AS n_automated, count(*) FILTER (WHERE NOT automated) AS n_deferred, {R('avg(automated::INT)')} AS automation_rate, {R(f"avg((group_status = {_merge_sql('4 classes')})::INT) FILTER (WHERE automated)")} AS accuracy,
{R('avg((s3_pred<>0)::INT)')} AS bug_coverage, {R('avg(((s3_pred=2) = (has_bug=1))::INT) FILTER (WHERE s3_pred<>0)')} AS bug_accuracy, {R('avg((status=3)::INT) FILTER (WHERE s0_pred=3)')} AS invalid_precision, {R('avg((s0_pred=3)::INT) FILTER (WHERE status=3)')} AS invalid_recall"""


@query("triage_report", _G + f"SELECT {_REPORT} FROM s3")
def triage_report(spark, d):
    return tg.group_report(tg.decide_groups(groups(spark, d), LIMITS), "status", "has_bug", tg.SCHEMES["4 classes"])


@query("triage_report_by_repository", _G + f"SELECT repo, {_REPORT} FROM s3 GROUP BY repo")
def triage_report_by_repository(spark, d):
    """The same for each repository, as the cross-group run reports it."""
    return tg.group_report(tg.decide_groups(groups(spark, d), LIMITS), "status", "has_bug", tg.SCHEMES["4 classes"], ["repo"])


@query("triage_member_report", _M + f"SELECT route, count(*) AS n_alerts, count(*) FILTER (WHERE member_status<>-1) AS n_automated, {R('avg((member_status=status)::INT) FILTER (WHERE member_status<>-1)')} AS accuracy FROM md GROUP BY route")
def triage_member_report(spark, d):
    decided = tg.decide_groups(groups(spark, d), LIMITS)
    return tg.member_report(tg.decide_members(members(spark, d), decided, LIMITS), "status")


_SCHEMES_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS scheme, t AS threshold, count(*) FILTER (WHERE {take}) AS automated, count(*) FILTER (WHERE NOT ({take})) AS deferred, {R(f'avg((CASE WHEN s0_pred=3 THEN status=3 ELSE {p}={_merge_sql(n)} END)::INT) FILTER (WHERE {take})')} AS accuracy, {R(f'avg(({take})::INT)')} AS coverage FROM s3, grid GROUP BY t"
    for n, p, take in (("4 classes", "s1_class", "s0_pred=3 OR (s0_pred=0 AND s1_conf>=t)"), ("5 classes", "s1_class_5", "s0_pred=3 OR (s0_pred=0 AND s1_conf_5>=t)"))
)


@query("triage_class_schemes", _G + f", grid AS (SELECT unnest({tg.SCHEME_GRID}::DOUBLE[]) AS t) {_SCHEMES_SQL}")
def triage_class_schemes(spark, d):
    """Four merged classes against five, gate and disposition together, over thresholds."""
    g = tg.decide_groups(groups(spark, d), LIMITS)
    scored = {"4 classes": (tg.SCHEMES["4 classes"], F.col("s1_class"), F.col("s1_conf")), "5 classes": (tg.SCHEMES["5 classes"], F.col("s1_class_5"), F.col("s1_conf_5"))}
    return tg.compare_schemes(g, "status", scored)


FEATURES = ["n_lines", "price_mean", "price_max", "quantity_mean", "n_platforms", "total"]


def group_features(spark, d):
    """Groups with roll-ups of their alerts; the status follows from these and some noise, so that there is something to learn."""
    li = table(spark, d, "lineitem")
    roll = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.avg("l_extendedprice").alias("price_mean"), F.max("l_extendedprice").alias("price_max"), F.avg("l_quantity").alias("quantity_mean"), F.count_distinct("l_suppkey").alias("n_platforms")
    )
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), F.col("o_custkey") % 4).alias("repo"), (F.col("o_custkey") % 25).alias("suite"), F.col("o_totalprice").alias("total"))
    u = keyed_uniform(F.col("id"), "noise")
    status = F.when((F.col("quantity_mean") < 20) & (u < 0.9), 3).when((F.col("n_lines") > 5) & (u < 0.85), 1).when(F.col("n_lines") > 3, 4).when(u < 0.1, 2).otherwise(6)
    g = o.join(roll, "id").withColumn("status", status)
    return g.withColumn("has_bug", ((F.col("status") == 4) | (keyed_uniform(F.col("id"), "bug") < 0.15)).cast("int"))


@query("triage_cross_repository")
def triage_cross_repository(spark, d):
    """All stages fitted on the groups of two repositories and judged on those of two others."""
    models = tg.TriageModels(FEATURES, "suite", cl.LogisticRegression(maxIter=10), tg.SCHEMES["4 classes"], [1, 4, 6])
    return tg.cross_group(models, materialise(group_features(spark, d)), "repo", ["r0", "r1"], ["r2", "r3"], tg.Thresholds(valid=0.5, invalid=0.7, other=0.6))
