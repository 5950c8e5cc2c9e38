"""Divergence of sources against a plain loop, on rows with nulls, empty texts, ties, repeats and clashing columns."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from alertsieve.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value long, rank int"


def brute(rows, least, smooth, top):
    docs, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        langs[lang].add(source)
        counts[lang, source].update(w)
        docs[lang].update(set(w))
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        of = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + smooth) // (n + smooth * len(kept))
        p = {s: {t: share(c, sum(of[s].values())) for t, c in of[s].items()} for s in sources}
        all_n = sum(sum(x.values()) for x in of.values())
        q = {t: share(sum(of[s][t] for s in sources), all_n) for t in kept}
        for s in sources:
            parts = {
                "pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [(p[s][t] - q[t], t) for t in kept if of[s][t] > 0 and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                for i, (f, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))):
                    if part == "pair" or i < top:
                        out.add((lang, s, part, item, f, i + 1))
    return out


def rows_of(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "漢字", "😀", "ſ", "ı"]
    rows = [(None, None, None), ("", "en", ""), ("1 2 3", "xx", "s1"), ("4", "xx", "s2"), ("A", "yy", None)]
    for i in range(300):
        w = rng.choice(vocabulary, rng.integers(0, 40), p=rng.dirichlet(np.full(len(vocabulary), 0.3)))
        rows.append((rng.choice([" ", "-", "_1_", "\0"]).join(str(x).upper() if i % 3 else str(x) for x in w), ["en", "de", None][i % 3], f"s{i % 7}" if i % 11 else None))
    return rows + rows[10:20] * 3 + [(" ".join(vocabulary) * 3000, "en", "s1")]


@pytest.mark.parametrize("cells, shard_rows", [(1 << 21, 1 << 17), (16, 50)])
def test_equals_loop(spark, monkeypatch, cells, shard_rows):
    monkeypatch.setattr(divergence, "CELLS", cells)  # small: many chunks of terms and tiles of sources
    monkeypatch.setattr(divergence, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(divergence, "TASK_ROWS", 100)
    rows = rows_of(cells)
    docs = spark.createDataFrame([(i, *r, "t", 1, 2, 3) for i, r in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in divergence.audit(docs, least_docs=5, top=4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 5, 4)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_per_billion_is_exact():
    rng = np.random.default_rng(1)
    b = rng.integers(1, 9 * 10**15, 2000)
    a = rng.integers(0, 9 * 10**15, 2000) % (b + 1)
    assert divergence.per_billion(a, b).tolist() == [10**9 * int(x) // int(y) for x, y in zip(a, b)]
