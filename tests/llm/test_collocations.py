"""Collocations against a plain loop; quotient filters: lossless, merged, bit by bit."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertsieve.llm import collocations, quotient_filter as qf

SCHEMA = "doc_id long, text string, lang string, a long, l long, n long, c1 long, shard int"


def brute(rows, least, covered, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and p in [q[i : i + len(p)] for i in range(len(q) - len(p) + 1)] and 100 * b >= covered * a for q, b in c.items()):
                continue
            cuts = [(10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]):  # noqa: E741
            out.add((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return out


def rows_of(seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["New", "york", "CITY", "is", "the", "É", "é", "漢字", "x\x00y", "a\xa0b", *[f"w{i}" for i in range(12)]]
    rows = [(None, None), ("", "en"), (" ., ;\n\t", "en"), ("word", None), ("New York City, new york; new\tyork city", "und")]
    for i in range(160):
        w = [vocabulary[j] for j in rng.integers(0, len(vocabulary), rng.integers(0, 30))]
        cut = rng.choice([" ", "  ", ", ", "\n", "\t"], len(w), p=[0.6, 0.1, 0.1, 0.1, 0.1])
        rows.append(("".join(x + c for x, c in zip(w, cut)) + (" new york city" if i % 3 else ""), ["en", "de", None][i % 3]))
    return rows + rows[20:30] * 2 + [("the same words again and " * 20_000, "de")]


@pytest.mark.parametrize("short, task_keys", [(collocations.SHORT, 1 << 21), (6, 50), (1, 500)])
def test_equals_loop(spark, monkeypatch, short, task_keys):
    """Also with few short numbers, so that most phrases take long keys, and with tasks that send many filters"""
    monkeypatch.setattr(collocations, "TASK_KEYS", task_keys)
    monkeypatch.setattr(collocations, "TASK_ROWS", 10 * task_keys)
    monkeypatch.setattr(collocations, "SLICE", 2000)
    rows = rows_of(short)
    docs = spark.createDataFrame([(i, *r, 1, 2, 3, 4, 5) for i, r in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in collocations.collocations(docs, least=4, top=60, short_words=short).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4, 50, 60)


def test_empty_and_wordless(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, " ,.\n", "en", 1, 1, 1, 1, 1)], SCHEMA)).collect() == []


def test_score_beyond_64_bits(spark):
    big = 5 * 10**12 + 3
    row = spark.sql(f"SELECT {big}L AS a, {big + 7}L AS l, {big + 11}L AS r").select(collocations._score("l", "r").alias("s")).first()
    assert row.s == 10**6 * big * big // ((big + 7) * (big + 11))


def test_names_are_those_of_spark(spark):
    words = ["a", "é", "漢字😀", "x" * 1000]
    got = spark.createDataFrame([("en", w) for w in words], "lang string, word string").select("word", collocations._name("+").alias("c")).collect()
    assert [r.c for r in got] == collocations.names_of("+", ["en"] * 4, words).view(np.int64).tolist()


def test_another_salt_if_names_meet(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_name", lambda salt: F.length("word").cast("bigint") if salt == "" else F.xxhash64("word"))
    counted = spark.createDataFrame([("en", "ab", 20), ("en", "cd", 1)], "lang string, word string, n bigint")
    assert collocations.salt_for(counted, 10) == "+" and collocations.salt_for(counted, 50) == ""


@pytest.mark.parametrize("width", [1, 3])
@pytest.mark.parametrize("shard_bits", [0, 6, 13])
def test_filters_lose_nothing(width, shard_bits):
    rng = np.random.default_rng(width + shard_bits)
    keys = rng.integers(0, 1 << 64, (5000, width), np.uint64)
    keys[::3] = keys[0]
    keys[:4, 0] = [0, (1 << 64) - 1, 1, 1 << 63]
    assert (qf.restore(qf.permute(keys)) == keys).all()
    want = Counter(map(tuple, keys.tolist()))
    want[tuple(keys[0].tolist())] += 10**14
    parts = []
    for some in np.array_split(keys, 4):
        mixed, n = qf.summed(qf.permute(some))
        if (keys[0] == some[0]).all() and not parts:
            n[(qf.restore(mixed) == keys[0]).all(axis=1)] += 10**14
        parts.append([(s, len(k), qf.pack(m, k, shard_bits)) for s, m, k in qf.by_shard(mixed, n, shard_bits)])
    got = Counter()
    for shard in {s for p in parts for s, _, _ in p}:
        merged, n = qf.merge([qf.unpack(width, shard, shard_bits, *f) for p in parts for s, _, f in p if s == shard], room=100)
        assert all(merged[i].tolist() < merged[i + 1].tolist() for i in range(len(n) - 1))
        again = qf.unpack(width, shard, shard_bits, *qf.pack(merged, n, shard_bits))
        assert (again[0] == merged).all() and (again[1] == n).all()
        got.update(dict(zip(map(tuple, qf.restore(merged).tolist()), n.tolist())))
    assert got == want
