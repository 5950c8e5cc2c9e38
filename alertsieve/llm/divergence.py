"""How far the sources of a language are apart in the terms they use.

Texts stay in Arrow: ``ascii_lower``, ``split_pattern_regex`` and ``dictionary_encode`` give the terms of a batch, hash
``group_by`` counts them per language, source and term, with the documents that hold them, and a task merges its counts
before it sends them. One shuffle by (language, term) adds them up and drops rare terms. What is left is dealt to
columnar shards of some terms each with all sources of their language; each shard adds up the divergences of its
terms in integers, and the sums of the shards are the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.llm.common import text_slices
from alertsieve.session import materialise

TERM_BREAKS = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # fixed values: all but letters and what is not ASCII
LEAST_DOCS = 30
SMOOTH = 5
TOP_TERMS = 50
GROUP = "\0"  # begins the rows that name a group; no term holds it
TASK_ROWS = 400_000  # counts that a task merges before it sends them
SLICE = 4 << 20
SHARD_ROWS = 1 << 17
CELLS = 1 << 21  # of a matrix of terms and sources
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_FIELDS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _merged(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables)
    merged = whole.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return merged.rename_columns([c.removesuffix("_sum") for c in merged.column_names]).select(_FIELDS.names)


def count_batch(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """lang, source, term, n, docs of some documents; and a row for each of their groups, named by ``GROUP`` and its source."""
    lang, source = (pc.fill_null(x.cast(pa.string()), "") for x in (lang, source))
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(text.cast(pa.string()), "")), pattern=TERM_BREAKS)
    terms, docs = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    real = pc.not_equal(terms, "")  # a break at either end of a text leaves an empty string
    coded = terms.filter(real).dictionary_encode()
    of_doc = pa.table({"doc": docs.filter(real), "term": coded.indices}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    groups = pa.table({"lang": lang, "source": source, "doc": np.arange(len(lang))}).group_by(["lang", "source"], use_threads=False).aggregate([("doc", "list")])
    number = np.zeros(len(lang), np.int64)
    number[pc.list_flatten(groups["doc_list"]).to_numpy()] = pc.list_parent_indices(groups["doc_list"]).to_numpy()
    rows = pa.table({"group": number[of_doc["doc"].to_numpy()], "term": of_doc["term"], "n": of_doc["count_all"]})
    rows = rows.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    at = rows["group"]
    counts = [groups["lang"].take(at), groups["source"].take(at), coded.dictionary.take(rows["term"].combine_chunks()), rows["n_sum"], rows["n_count"]]
    names = pc.binary_join_element_wise(pa.scalar(GROUP), groups["source"], "")
    zeros = pa.array(np.zeros(groups.num_rows, np.int64))
    return pa.concat_tables([pa.table(counts, _FIELDS), pa.table([groups["lang"], groups["source"], names, zeros, zeros], _FIELDS)])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of the terms of whole texts, added up in the tasks only: lang, source, term, n, docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        fresh = 0
        for batch in text_slices(batches, 2, SLICE):
            held.append(count_batch(*batch.columns))
            fresh += held[-1].num_rows
            if fresh >= TASK_ROWS:
                held, fresh = [_merged(held)], 0
                if held[0].num_rows >= TASK_ROWS:
                    yield from held.pop().to_batches(max_chunksize=65_536)
        if held:
            yield from _merged(held).to_batches(max_chunksize=65_536)

    return docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("_text")).mapInArrow(count, _COUNTS)


def kept_terms(partial: DataFrame, least_docs: int) -> DataFrame:
    """Written: lang, source, term, n, and ``first`` in one row of each kept term; and the rows that name groups."""
    whole = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = whole.withColumns({"_all": F.sum("docs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return materialise(marked.where((F.col("_all") >= least_docs) | F.col("term").startswith(GROUP)).select("lang", "source", "term", "n", "first"))


def per_billion(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """floor(10^9 a / b) in 64 bits, by long division with digits of a thousand; for b below 9 * 10^15."""
    q, r = np.zeros(np.broadcast(a, b).shape, np.int64), np.broadcast_to(a, np.broadcast(a, b).shape)
    for _ in range(3):
        r = r * 1000
        q = q * 1000 + r // b
        r = r % b
    return q


def _shard(table: pa.Table, smooth: int, top: int) -> pa.Table:
    """Divergences of the terms of a shard: lang, source, part, item, value; a row without a term gives a source, its sum and the kept terms."""
    table = table.combine_chunks()
    heads = table.filter(pc.is_null(table["term"])).sort_by("source")
    names = heads["source"].combine_chunks()
    totals = heads["n"].to_numpy() + smooth * heads["kept"].to_numpy()
    all_total = int(heads["n"].to_numpy().sum()) + smooth * int(heads["kept"][0].as_py())
    body = table.filter(pc.is_valid(table["term"]))
    words = pc.unique(body["term"]).sort()  # UTF-8 order
    row = pc.index_in(body["term"], value_set=words).to_numpy()
    col = pc.index_in(body["source"], value_set=names).to_numpy()
    n, width = body["n"].to_numpy(), len(names)
    order = np.argsort(row, kind="stable")
    row, col, n = row[order], col[order], n[order]
    tall, tile = max(1, CELLS // width), max(1, CELLS // width)
    best = [np.zeros(0, np.int64)] * 3
    left, right, value = [], [], []
    for low in range(0, width, tile):
        some = np.arange(low, min(low + tile, width))
        sums = np.zeros((len(some), width), np.int64)
        for start in range(0, len(words), tall):
            a, b = np.searchsorted(row, [start, start + tall])
            counts = np.zeros((min(tall, len(words) - start), width), np.int64)
            counts[row[a:b] - start, col[a:b]] = n[a:b]
            p = 1 + per_billion(counts + smooth, totals)
            for i, s in enumerate(some):
                sums[i] += np.abs(p - p[:, s : s + 1]).sum(axis=0)
            if low == 0:
                q = 1 + per_billion(counts.sum(axis=1) + smooth, np.int64(all_total))
                t, s = np.nonzero((counts > 0) & (p > q[:, None]))
                best = [np.concatenate(x) for x in zip(best, (s, p[t, s] - q[t], t + start))]
                by = np.lexsort((best[2], -best[1], best[0]))
                s = best[0][by]
                best = [x[by[np.arange(len(s)) - np.searchsorted(s, s) < top]] for x in best]
        i, j = np.nonzero(some[:, None] != np.arange(width))
        left.append(some[i])
        right.append(j)
        value.append(sums[i, j])
    items = pa.concat_arrays([names.take(pa.array(np.concatenate(right))), words.take(pa.array(best[2])).cast(names.type)])
    sources = names.take(pa.array(np.concatenate([*left, best[0]])))
    pairs = sum(map(len, left))
    parts = pa.array(["pair"] * pairs + ["term"] * len(best[0]), pa.string())
    langs = pa.repeat(table["lang"][0], len(parts))
    return pa.table([langs, sources, parts, items, pa.array(np.concatenate([*value, best[1]]))], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for each language and source that occur.

    Terms are runs of letters and of anything beyond ASCII, with A-Z lower-cased; a language keeps those in at least
    ``least_docs`` of its rows. A group's share of a term is p = 1 + floor(10^9 (count + smooth) / (sum + smooth * kept
    terms)). Part ``pair``: the other sources of the language by the sum of abs differences of p over its kept terms.
    Part ``term``: the ``top`` terms whose p is most above that of the whole language. Ranks run from the largest value,
    ties by UTF-8. Null text, language and source are empty strings; each row is a document, so repeated rows count
    each time; other columns are not read; an empty table gives no rows. A language's sources have to fit a worker's
    matrix row, as the result has a row for each pair of them.
    """
    kept = kept_terms(term_counts(docs, text_col, lang_col, source_col), least_docs)
    real = kept.where(~F.col("term").startswith(GROUP))
    shards = max(8, -(-kept.count() // SHARD_ROWS))
    vocabulary = real.groupBy("lang").agg(F.sum(F.col("first").cast("bigint")).alias("kept"))
    used = real.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    heads = kept.where(F.col("term").startswith(GROUP)).select("lang", "source").join(used, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    heads = heads.select("lang", "source", F.lit(None).cast("string").alias("term"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"))
    dealt = real.select("lang", "source", "term", "n", F.lit(0).cast("bigint").alias("kept"), F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("_shard"))
    dealt = dealt.unionByName(heads.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    summed = materialise(dealt.groupBy("lang", "_shard").applyInArrow(lambda t: _shard(t, smooth, top), "lang string, source string, part string, item string, value bigint"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = summed.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = summed.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
