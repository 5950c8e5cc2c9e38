"""Queries that fit models read all rows that they are given."""

import numpy as np

from alertsieve.operators import models as md
from alertsieve.plans import model_queries as mq


def test_searches_and_importance_use_all_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        label = int(rng.integers(0, 6))
        signal, noise = (1.0 if label < 3 else -1.0), [float(x) for x in rng.normal(size=2)]
        rows.append((i, [0.0, signal, *noise] if i % 2 else [signal, 0.0, *noise], label))  # dimension 1 tells the odd ids only
    frame = spark.createDataFrame(rows, "id long, v array<double>, label int")
    monkeypatch.setattr(mq, "vectors", lambda spark, d: frame)
    importance = {r["feature"]: r["importance"] for r in mq.tree_importance(spark, "").collect()}
    assert importance[0] > 0.1 and importance[1] > 0.1
    seen = []
    grid, weights = md.grid_search, md.positive_weight_search
    monkeypatch.setattr(md, "grid_search", lambda df, *a: (seen.append(df.count()), grid(df, *a))[1])
    monkeypatch.setattr(md, "positive_weight_search", lambda df, *a: (seen.append(df.count()), weights(df, *a))[1])
    assert mq.grid_search(spark, "").count() == 6 and mq.positive_weight_search(spark, "").count() == 5
    assert seen == [240, 240]


def test_vocabulary_takes_ties_by_name(spark):
    from alertsieve.operators import models as md

    words = [f"w{i:02d}" for i in range(40)]
    rows = [(i, " ".join(words[::-1] if i else words)) for i in range(2)] + [(2, "w39"), (3, None), (4, "")]
    frame = spark.createDataFrame([(i, t or "") for i, t in rows], "id long, text string")
    m = md.text_vectoriser(frame, "text", 10, 2, [])
    assert m.stages[0].stages[-1].vocabulary == ["w39", *words[:9]]
    got = {r["id"]: [round(float(x), 6) for x in r["text_vec"].toArray()] for r in m.transform(frame).collect()}
    assert got[2] == [1.0] + [0.0] * 9 and got[4] == [0.0] * 10
