"""All tables of the composed jobs, each as a query.

A table that a query of its own makes as well is checked by the same SQL: the job has to give the same rows.
"""

from __future__ import annotations

from alertsieve.plans import jobs
from alertsieve.plans.registry import ORACLE, query
from alertsieve.sources.tables import defects, scores

#: table of the job: the query with the same rows, where there is one
AGREEMENT = {"contingency": "agreement_contingency", "bins": "agreement_bins", "classes": "agreement_by_class", "viability": "viability_gate", "sets": "agreement_conditioned_sets"}
CONFORMAL = {"class_coverage": None, "sizes": None, "augrc": "augrc", "augrc_interval": "bootstrap_augrc", "fixed_coverage": "fixed_coverage_accuracy"}
DEFECTS = {"gate_sweep": "gate_sweep", "class_sweep": "class_sweep", "tiers": "tier_table", "ranking": "ranking_metrics", "accuracy_interval": None, "recall_interval": "bootstrap_recall", "paired": None}

for _table, _same in AGREEMENT.items():
    query(f"agreement_job_{_table}", ORACLE.get(_same))(lambda spark, d, t=_table: jobs.agreement_job(scores(spark, d))[t])
for _table, _same in CONFORMAL.items():
    query(f"conformal_job_{_table}", ORACLE.get(_same))(lambda spark, d, t=_table: jobs.conformal_job(scores(spark, d), "pa")[t])
for _table, _same in DEFECTS.items():
    query(f"defect_job_{_table}", ORACLE.get(_same))(lambda spark, d, t=_table: jobs.defect_job(defects(spark, d))[t])
