"""The cascade over groups and alerts: nulls, alerts without groups, and stages that are fitted on other repositories."""

from pyspark.sql import functions as F

from alertsieve.operators import triage as tg
from alertsieve.plans import triage_queries as tq

SF = "/root/testdata/sf0.001"


def test_null_scores_decide_nothing(spark):
    rows = [(1, None, 4, 0.9, 0.9, 0.9), (2, 0.1, None, None, None, 0.1), (3, 0.9, 4, 0.9, 0.9, 0.9), (4, 0.1, 4, 0.9, None, 0.9), (5, 0.5, 4, 0.9, 0.5, 0.5)]
    g = tg.decide_groups(spark.createDataFrame(rows, "id long, p_invalid double, s1_class int, s1_conf double, p_bug_a double, p_bug_b double"), tg.Thresholds())
    got = {r["id"]: (r["s0_pred"], r["group_status"], r["s3_pred"], r["s3_source"]) for r in g.collect()}
    assert got == {1: (-1, -1, 2, "model_B"), 2: (0, -1, 1, "model_B"), 3: (3, 3, 1, "shortcut_invalid"), 4: (0, 4, 0, "uncertain"), 5: (0, 4, 1, "model_A")}
    members = [(1, 4, 0.9, 0.9), (1, 4, 0.9, None), (3, 4, None, None), (4, 2, 0.9, 0.9), (4, 2, 0.1, 0.9), (9, 2, 0.9, 0.9), (None, 2, 0.9, 0.9)]
    m = tg.decide_members(spark.createDataFrame(members, "summary_id long, s2a_class int, s2a_conf double, p_noise double"), g, tg.Thresholds())
    found = sorted((str(r["summary_id"]), r["route"], r["member_status"], r["member_automated"]) for r in m.collect())
    assert found == sorted([("1", "noise", 3, True), ("1", "noise", -1, False), ("3", "invalid", 3, True), ("4", "roles", 2, True), ("4", "roles", -1, False), ("9", "none", -1, False), ("None", "none", -1, False)])
    assert tg.group_report(g.limit(0).withColumns({"status": F.lit(1), "has_bug": F.lit(0)}), "status", "has_bug", {}).first()["n_groups"] == 0


def test_stages_of_other_repositories(spark):
    """Better than the most frequent status; the disposition stage never saw the judged repositories"""
    truth = tq.group_features(spark, SF).where("repo IN ('r2', 'r3')")
    counts = {r["status"]: r["count"] for r in truth.groupBy("status").count().collect()}
    got = {r["repo"]: r for r in tq.triage_cross_repository(spark, SF).collect()}
    assert set(got) == {"r2", "r3"} and sum(r["n_groups"] for r in got.values()) == sum(counts.values())
    for r in got.values():
        assert r["n_automated"] + r["n_deferred"] == r["n_groups"] and r["automation_rate"] > 0.2
        assert r["accuracy"] > max(counts.values()) / sum(counts.values())
