"""Shards by virtual slots: sizes, places, versions of the map and odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from alertsieve.llm import sharding
from alertsieve.llm.queries import LLM_QUERIES
from alertsieve.llm.common import read

SF = "/root/testdata/sf0.001"


def check_rows(got, texts, shards):
    """Sizes and sums of the texts, and places gapless from 0 in each shard"""
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    places = {}
    for r in got:
        assert 0 <= r.shard < shards
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_query(spark):
    texts = [r.text for r in read(spark, SF, "documents").collect()]
    got = LLM_QUERIES["op13_slot_shards"](spark, SF).collect()
    check_rows(got, texts, 24)
    loads = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert max(loads) - min(loads) < 0.02 * max(loads)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = LLM_QUERIES["op13_slot_shards"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_one_row_repeated_for_a_third(spark):
    rows = [(7, "same text " * 5)] * 500 + [(i, f"text number {i} " * 3) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 6).collect()
    check_rows(got, [t for _, t in rows], 6)
    loads = [sum(r.size for r in got if r.shard == s) for s in range(6)]
    assert max(loads) - min(loads) < 0.03 * max(loads)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, None), (None, ""), (1, None), (1, "a"), (1, "a"), (2, "é漢😀"), (3, "x" * 300_000)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, shard int, slot int, size int")
    got = sharding.shard(docs, 3).collect()
    check_rows(got, [t for _, t in rows], 3)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)


def test_versions(spark, tmp_path):
    """Rebalancing moves only what is above the mean; a new shard takes rows and gives none"""
    docs = read(spark, SF, "documents")
    rows = sharding.digests(docs)
    versions = sharding.balanced_map(rows, 4)
    first, second = (sharding.version(versions, v) for v in (1, 2))
    loads = {r.shard: r.b for r in sharding.sizes(rows, first).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    mean = sum(loads.values()) / 4
    was = {(r.slot, i): s for r in first.collect() for i, s in enumerate(r.places)}
    now = {(r.slot, i): s for r in second.collect() for i, s in enumerate(r.places)}
    assert set(was) == set(now) and len({k[0] for k in now}) == sharding.SLOTS
    weights = {(r.slot, r.part): r.bytes for r in sharding.sizes(rows, first).collect()}
    assert all(loads[was[k]] > mean for k in now if now[k] != was[k])
    assert sum(weights.get(k, 0) for k in now if now[k] != was[k]) < 2 * sum(max(0, b - mean) for b in loads.values()) + max(weights.values())
    third = sharding.edit(second, sharding.sizes(rows, second), 5, into=4)
    grown = {(r.slot, i): s for r in third.collect() for i, s in enumerate(r.places)}
    moved = {k for k in now if now[k] != grown[k]}
    assert moved and all(grown[k] == 4 for k in moved)
    assert third.first()["version"] == 3
    after = {r.shard: r.b for r in sharding.sizes(rows, third).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert max(after.values()) < 1.3 * sum(after.values()) / 5
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, second, path)
    written = spark.read.parquet(path)
    assert sorted(map(tuple, written.select(docs.columns).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    want = {r.doc_id: r.shard for r in sharding.shard(docs, 4).collect()}
    assert all(want[r.doc_id] == r._shard for r in written.select("doc_id", "_shard").collect())


def test_plan_is_native(spark):
    plan = LLM_QUERIES["op13_slot_shards"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
