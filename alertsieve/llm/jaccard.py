"""Exact Jaccard join of documents on word shingles, by vertical partitioning.

All shingles stand in one global order: those that are frequent somewhere come last, the others by hash. The order is
cut into fragments, and each set into segments. Overlaps of two sets are counted for each fragment separately and
summed per pair; a pair whose first fragment differs in more shingles than the whole pair may is dropped early.

Which pairs are counted: two sets of similarity t share at least l shingles among the first ``n - ceil(t n) + l`` of
each in the global order, for any l; here l is a 32nd of the set. Sets with fewer shared shingles there link with
nothing. In each bucket of such a shingle, sets are first compared with a few pivots, which costs a row for each set;
groups of copies become one component that way. After that only pairs of different components remain, and all of
those whose first common shingle stands early enough in both sets are compared. So no link between components is lost
and no group is expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import most_frequent, shingle_hashes, text_slices, tidy, word_hashes
from alertsieve.session import materialise, release

FRAGMENTS = 8
COMMON = 1 << 17  # frequent shingles that the order knows; the rest of the order needs no counts
CHUNK = 1 << 22  # shingles that a task counts at once
PIVOT_ROUNDS = 3
SHARED = 32
PRUNE_ROUNDS = 3
SALTS = 8


def _sets(batch: pa.RecordBatch, text: int, k: int) -> Iterator[np.ndarray]:
    words, edges = word_hashes(batch.column(text))
    for a, b in zip(edges[:-1], edges[1:]):
        yield np.unique(shingle_hashes(words[a:b], k))


def thrice(x: np.ndarray, most: int) -> pa.RecordBatch:
    """s and n of the ``most`` most frequent numbers of those that stand thrice or more in ``x``, which is sorted in place."""
    x.sort()
    found, n = np.unique(x[2:][x[2:] == x[:-2]], return_counts=True)  # all but the first two of each
    keep = np.argsort(-n, kind="stable")[:most]
    return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep].astype(np.int64) + 2)], ["s", "n"])


def frequent_shingles(docs: DataFrame, text_col: str, k: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles (sorted) and their places by count.

    Each task reports the shingles that occur thrice or more in one of its chunks, at most ``most`` / 8 of them. This
    only shapes the order, which is the same for all sets whatever it is, so what it misses costs time and no links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, size = np.empty(CHUNK, np.uint64), 0
        for batch in text_slices(batches, 0):
            for x in _sets(batch, 0, k):
                if size + len(x) > len(room):
                    room = np.append(room[:size], x)
                room[size : size + len(x)] = x
                size += len(x)
                if size >= CHUNK:
                    yield thrice(room[:size], most // 8)
                    size = 0
        if size:
            yield thrice(room[:size], most // 8)

    counted = materialise(docs.select(F.col(text_col).alias("_text")).mapInArrow(tidy(count), "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")))
    top = most_frequent(counted, "n", most).orderBy(F.desc("n"), "s").toPandas()  # bounded by ``most``
    release(counted)
    hashes = top["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    places = (len(hashes) - np.arange(len(hashes))).astype(np.uint64)  # the most frequent one is last
    return hashes[order], places[order]


def _ordered(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, and the order's keys: hashes below 2^63, then the frequent ones by place."""
    hashes, places = common
    keys = shingles >> np.uint64(1)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        known = hashes[at] == shingles
        keys[known] = np.uint64(1 << 63) + places[at[known]]
    order = np.argsort(keys, kind="stable")
    return shingles[order], keys[order]


def set_table(docs: DataFrame, common, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Written: _id, n (size of the set), digest of the set, prefix (its first shingles in the global order, 48 bits of each)."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            n, digests, prefixes = [], [], []
            for x in _sets(batch, 1, k):
                n.append(len(x))
                digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                first = len(x) - (percent * len(x) + 99) // 100 + max(1, len(x) // SHARED) if len(x) else 0
                prefixes.append(_ordered(x, sent.value)[0][:first] >> np.uint64(16))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = pa.array((np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["_id", "n", "digest", "prefix"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return materialise(rows.mapInArrow(tidy(build), "_id bigint, n bigint, digest binary, prefix array<bigint>"))


def segment_table(docs: DataFrame, wanted: DataFrame, common, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """_id, f, seg (the shingles of fragment f) of the documents in ``wanted`` (_id, and whether several rows have it); one row for each.

    Also the written table that it reads.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)
    cuts = np.asarray([(1 << 63) // (FRAGMENTS - 1) * i for i in range(1, FRAGMENTS - 1)] + [1 << 63], np.uint64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            ids, parts, flat, often = [], [], [], []
            for doc, x, many in zip(batch.column(0).to_pylist(), _sets(batch, 1, k), batch.column(2).to_pylist()):
                x, keys = _ordered(x, sent.value)
                for f, part in enumerate(np.split(x, np.searchsorted(keys, cuts))):
                    if len(part):
                        ids.append(doc)
                        parts.append(f)
                        often.append(many)
                        flat.append(part.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in flat])]).astype(np.int32)
            whole = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), whole), pa.array(often, pa.bool_())], ["_id", "f", "seg", "often"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).join(wanted, "_id")
    written = materialise(rows.select("_id", "_text", "often").mapInArrow(tidy(build), "_id bigint, f int, seg array<bigint>, often boolean"))
    once = written.where(~F.col("often")).drop("often")
    return once.unionByName(written.where("often").drop("often").dropDuplicates(["_id", "f"])), written


def linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Written: the pairs (a, na, b, nb) whose similarity reaches the bound, as a, b.

    First fragment 0 of each pair is counted. Two sets may differ in (100 - p) / (100 + p) of their sizes together, so a
    pair that differs in more there is dropped. The other fragments of the rest are counted one by one and summed.
    """
    head = segments.where("f = 0")
    a0, b0 = head.select(F.col("_id").alias("a"), F.col("seg").alias("sa")), head.select(F.col("_id").alias("b"), F.col("seg").alias("sb"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    first = pairs.join(a0, "a", "left").join(b0, "b", "left").withColumn("o0", F.coalesce(F.size(F.array_intersect("sa", "sb")), F.lit(0)).cast("bigint"))
    first = first.where((size("sa") + size("sb") - 2 * F.col("o0")) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    first = materialise(first.select("a", "na", "b", "nb", "o0"))
    rest = segments.where("f > 0")
    left = first.select("a", "b").join(rest.withColumnRenamed("_id", "a"), "a")
    right = rest.select(F.col("_id").alias("b"), "f", F.col("seg").alias("other"))
    parts = left.join(right, ["b", "f"]).select("a", "b", F.size(F.array_intersect("seg", "other")).cast("bigint").alias("o"))
    whole = parts.unionByName(first.select("a", "b", F.col("o0").alias("o"))).groupBy("a", "b").agg(F.sum("o").alias("o"))
    done = whole.join(first.select("a", "na", "b", "nb"), ["a", "b"])
    found = materialise(done.where(F.col("o") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b"))
    release(first)
    return found


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Written: _id, comp (smallest id reachable) of the nodes of ``edges`` (a, b), or of ``start`` and those.

    Labels move along edges and are then replaced by their own labels, so that chains halve in each round. It ends when
    nothing changes.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if start is not None:
        tree = start.where("_id <> comp")
        both = both.unionByName(tree.select(F.col("_id").alias("u"), F.col("comp").alias("v"))).unionByName(tree.select(F.col("comp").alias("u"), F.col("_id").alias("v")))
    both = materialise(both.distinct())
    now = labels = materialise(both.groupBy(F.col("u").alias("_id")).agg(F.least(F.min("v"), F.first("u")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("_id").alias("v"), "comp"), "v").groupBy(F.col("u").alias("_id")).agg(F.min("comp").alias("near"))
        moved = labels.join(near, "_id", "left").select("_id", "comp", F.least("comp", "near").alias("to"))
        up = labels.select(F.col("_id").alias("to"), F.col("comp").alias("top"))
        last, now = now, materialise(moved.join(up, "to", "left").select("_id", F.least("to", "top").alias("comp"), (F.least("to", "top") < F.col("comp")).alias("_moved")))
        labels = now.select("_id", "comp")
        release(last)
        if now.where("_moved").isEmpty():
            done = materialise(labels)
            release(both, start, now)
            return done


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id``, the smallest id that links lead to.

    Two rows link when 100 * common >= ``percent`` * united over their sets of distinct ``k``-word shingles (A-Z
    lower-cased; the whole sequence if there are fewer words). Rows without words, nulls too, link with nothing.
    Equal sets link. Ids are whole numbers; rows may repeat an id together with its text and are one set then. Shingles and digests are
    compared as hashes of 64 and 128 bits. Other columns are not read; an empty table gives an empty result.
    """
    common = frequent_shingles(docs, text_col, k)
    sets = set_table(docs, common, id_col, text_col, k, percent)
    some = sets.where("n > 0")
    # copies become one row in the tasks already, so that a large group of them doesn't meet in one
    reps = some.groupBy("digest").agg(F.min(F.struct("_id", "n", "prefix")).alias("r")).select("r.*").withColumnRenamed("_id", "rep")
    prefixes = reps.select("rep", "n", F.posexplode("prefix").alias("at", "s"))
    shared = materialise(prefixes.join(prefixes.groupBy("s").count().where("count > 1").select("s"), "s"))
    need = lambda n: F.greatest(F.lit(1), F.floor(F.ceil(n * percent / 100) / SHARED))  # noqa: E731  of a set or a partner a little smaller
    for _ in range(PRUNE_ROUNDS):  # sets with too few shared shingles go, and then buckets with one set
        enough = shared.groupBy("rep").agg(F.count("*").alias("_c"), F.first("n").alias("_n")).where(F.col("_c") >= need(F.col("_n"))).select("rep")
        left = shared.join(enough, "rep")
        before, shared = shared, materialise(left.join(left.groupBy("s").count().where("count > 1").select("s"), "s").select("s", "rep", "n", "at"))
        release(before)
    often = some.groupBy("_id").count().select("_id", (F.col("count") > 1).alias("often"))
    segments, written = segment_table(docs, shared.select(F.col("rep").alias("_id")).distinct().join(often, "_id"), common, id_col, text_col, k)

    def fits(n: Column, i: Column, m: Column, j: Column) -> Column:
        """Whether sets of n and m shingles may be similar enough whose first common shingle stands at places i and j.

        What stands before it is in one set only. Later common shingles of a pair may fail this; the first may not.
        """
        least = percent * (n + m)  # times 1 / (100 + percent): the overlap that they need
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((n - i) * (100 + percent) >= least) & ((m - j) * (100 + percent) >= least)

    def pairs_of(a: Column, na: Column, b: Column, nb: Column) -> list[Column]:
        low = F.least(a, b)
        return [low.alias("a"), F.when(a == low, na).otherwise(nb).alias("na"), F.greatest(a, b).alias("b"), F.when(a == low, nb).otherwise(na).alias("nb")]

    comps = None
    tried = None
    rows = shared
    for r in range(rounds):
        # rows of buckets that hold different components; pivots are the set with fewest shingles before, and one by hash
        chance = F.struct(F.xxhash64("rep", F.lit(r)).alias("h"), "rep", "n", "at")
        middle = F.struct(F.col("at").alias("h"), "rep", "n", "at")
        pivots = rows.groupBy("s").agg((F.min(middle) if r == 0 else F.max(chance)).alias("p"), F.min(chance).alias("q"), F.min("comp" if comps is not None else "rep").alias("c0"), F.max("comp" if comps is not None else "rep").alias("c1")).where("c0 < c1")
        near = rows.join(pivots.select("s", F.array(F.col("p"), F.col("q")).alias("pq")), "s").select("rep", "n", "at", F.explode("pq").alias("p"))
        near = near.where((F.col("rep") != F.col("p.rep")) & fits(F.col("n"), F.col("at"), F.col("p.n"), F.col("p.at")))
        pairs = near.select(*pairs_of(F.col("rep"), F.col("n"), F.col("p.rep"), F.col("p.n"))).distinct()
        if comps is not None:
            pairs = _across(pairs, comps)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        links = linked(pairs, segments, percent)
        comps = components(links, comps)
        release(links)
        rows = shared.join(comps.select(F.col("_id").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        rows = rows.select("s", "rep", "n", "at", "comp")
    mixed = rows.groupBy("s").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("s")
    rows = materialise(rows.join(mixed, "s"))
    x = rows.select("s", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("comp").alias("ca"))
    y = rows.select("s", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("comp").alias("cb"))
    last = x.join(y, "s").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib")))
    last = last.select("a", "na", "b", "nb").distinct()
    last = materialise(last.join(tried, ["a", "b"], "left_anti"))
    links = linked(last, segments, percent)
    comps = components(links, comps)
    release(links, last, rows, shared, written)
    # a large group of copies is spread over the salts
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    classes = some.groupBy("digest").agg(F.min("_id").alias("rep"))
    of_class = classes.join(comps.select(F.col("_id").alias("rep"), "comp"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    of_class = of_class.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = sets.select("_id", "n", "digest", salt("_id").alias("_salt")).join(of_class, ["digest", "_salt"], "left")
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "_id").alias("component_id"))


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    left = comps.select(F.col("_id").alias("a"), F.col("comp").alias("ca"))
    right = comps.select(F.col("_id").alias("b"), F.col("comp").alias("cb"))
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "na", "b", "nb")
