"""Memory of the driver and of the workers, and rows in slices; the rows are made here."""

import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.llm import common, jaccard, language, lm_scoring, sentencepiece_fst
from alertsieve.llm.pieces import PieceModel


def test_gradient_sums_are_no_python_rows(spark, monkeypatch):
    """op1: toPandas made Python numbers of 65,536 x 32 sums in the driver when Arrow is off"""

    def no(self):
        raise AssertionError("rows came to the driver as Python numbers")

    monkeypatch.setattr(DataFrame, "toPandas", no)
    docs = spark.createDataFrame([(i, f"the cat {i % 5} sat on the mat the dog {i % 3} ran") for i in range(30)] + [(30, None)], "doc_id long, text string")
    rows = lm_scoring.score(docs, F.col("doc_id") % 4 != 0).collect()
    assert len(rows) == 31 and all(r["score"] < 0 for r in rows)


def test_texts_scored_at_once_are_few(spark):
    """pipeline: a worker held 75 MB to score 256 texts"""
    model = language.LanguageModel(["a", "b"], np.ones((language.DIMS, 2), np.float32), np.zeros(2, np.float32))
    texts = ["some words of a text " * 20] * language.SCORED
    tracemalloc.start()
    model.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6


def test_pieces_of_sliced_rows(spark):
    """op3: ids are read by their offsets, in slices of a batch, with null and empty rows between"""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None if i % 7 == 0 else "" if i % 5 == 0 else f"Wörter {i} and w{i % 11}rds\n{i * 7919}" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coded = sentencepiece_fst.encode(docs, path).withColumn("piece_ids", F.when(F.col("doc_id") % 13 != 0, F.col("piece_ids")))
    for r in sentencepiece_fst.decode(coded, path).collect():
        assert r["decoded"] == (None if r["doc_id"] % 13 == 0 else r["text"] or "")


def test_histories_are_written_once_and_packed(spark, monkeypatch):
    """op1: the histories were written and shuffled twice as plain rows, and each task of many sent a whole table of sums in each round"""
    rng = np.random.default_rng(0)
    docs = [" ".join(f"w{x}" for x in rng.integers(0, 300, 60)) for _ in range(400)] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in docs], "_text string").repartition(20)
    words = lm_scoring.build_vocabulary(frame, lm_scoring.count_words(frame))
    written, plain = [], lm_scoring.materialise
    monkeypatch.setattr(lm_scoring, "materialise", lambda df: (written.append(plain(df)), written[-1])[1])
    monkeypatch.setattr(lm_scoring, "PART", 100)
    table = lm_scoring.count_histories(frame, words)
    rows = table.toArrow()
    assert max(rows["size"].to_pylist()) <= 100
    keys, n = lm_scoring.unpack(rows)
    want = Counter()
    for t in docs:
        tokens, edges = lm_scoring.tokens_of(pa.array([t], pa.string()))
        places = words.look_up(tokens)
        classes = lm_scoring.class_of(words, places)
        want.update((lm_scoring.histories(words, places, classes, edges) * lm_scoring.CLASSES + classes).tolist())
    assert dict(zip(keys.tolist(), n.tolist())) == want and len(keys) == len(want)
    assert sum(len(k) + len(c) for k, c in zip(rows["keys"].to_pylist(), rows["counts"].to_pylist())) < 9 * len(keys)  # three numbers of 8 bytes before
    assert np.array_equal(lm_scoring.from_byte_places(lm_scoring.byte_places(np.array([0, 1 << 52, 255])), 3), [0, 1 << 52, 255])
    written.clear()
    lm_scoring.train(frame, words, rounds=1)
    assert len(written) == 1


def test_workers_forget_the_encoder():
    """pipeline: workers that had encoded pieces kept 60 MB of machines through the other stages, and decoding built them too"""
    path = public_tokenizers.path("piece_bpe_32k.model")
    tracemalloc.start()
    inverse = sentencepiece_fst.Inverse(PieceModel.read(path))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 12e6 and inverse.decode([]) == ""
    common.kept_in_worker("machine", lambda: 1)
    common.drop_kept()
    assert common.kept_in_worker("machine", lambda: 2) == 2
    common.drop_kept()
    before = []
    assert list(common.tidy(lambda b: (before.append(x) or x for x in b))(iter([1, 2]))) == before == [1, 2]


def test_shingles_are_counted_in_place():
    """pipeline, op4: a worker took four more arrays of a chunk's size to count its shingles, and kept them"""
    x = np.random.default_rng(5).integers(0, 1 << 16, 1 << 18).astype(np.uint64) ** 2 // np.uint64(1 << 14)
    values, counts = np.unique(x, return_counts=True)
    for most in (1 << 20, 50):
        keep = np.flatnonzero(counts >= 3)
        keep = keep[np.argsort(-counts[keep], kind="stable")[:most]]
        got = jaccard.thrice(x.copy(), most)
        assert got.column(0).to_pylist() == values[keep].tolist() and got.column(1).to_pylist() == counts[keep].tolist()
    for few in ([], [7], [7, 7], [7, 7, 7]):
        assert jaccard.thrice(np.array(few, np.uint64), 9).num_rows == (len(few) == 3)
    x = np.random.default_rng(6).integers(0, 1 << 62, 1 << 20).astype(np.uint64)  # hardly any number twice, as most shingles
    tracemalloc.start()
    jaccard.thrice(x, 9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes // 2
    assert common.SLICE_BYTES <= 1 << 18  # about 40 bytes for each byte of a slice are held to hash its words


def test_rounds_send_a_table_for_many_histories(spark, monkeypatch):
    """op1: each round sent a table for each core, however few histories there were, so what was sent did not follow the input"""
    frame = spark.createDataFrame([(" ".join(f"w{x}" for x in np.random.default_rng(i).integers(0, 99, 50)),) for i in range(100)], "_text string").repartition(9)
    words = lm_scoring.build_vocabulary(frame, lm_scoring.count_words(frame))
    tasks, plain = [], type(frame).coalesce
    monkeypatch.setattr(type(frame), "coalesce", lambda self, n: (tasks.append(n), plain(self, n))[1])
    one = lm_scoring.train(frame, words, rounds=2)
    assert tasks == [1, 1, 1]
    monkeypatch.setattr(lm_scoring, "TASK_KEYS", 1500)
    two = lm_scoring.train(frame, words, rounds=2)
    assert 1 < tasks[-1] <= spark.sparkContext.defaultParallelism
    assert np.allclose(one, two, rtol=1e-6)


def test_hot_words_are_found_by_slots(monkeypatch):
    """op1: each token of three passes was looked up by bisection over all hot words"""
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 1000, 5000):
        hashes = np.unique(np.append(rng.integers(0, 1 << 62, max(0, n - 2)).astype(np.uint64) << np.uint64(2), np.array([0, 2**64 - 1][:n], np.uint64)))
        words = lm_scoring.Vocabulary(hashes, np.ones(len(hashes), int), np.arange(len(hashes)), np.zeros(len(hashes), int), 1, 1)
        tokens = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, 1 << 62, 500).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        want = [{h: i for i, h in enumerate(hashes.tolist())}.get(t, -1) for t in tokens.tolist()]
        assert words.look_up(tokens).tolist() == want
        if n == 5000:
            assert words.slots[2] <= lm_scoring.STEPS
        monkeypatch.setattr(lm_scoring, "STEPS", 0)  # as for uneven hashes
        assert words.look_up(tokens).tolist() == want
        monkeypatch.undo()
