"""Phrases whose words occur together more often than they would alone.

Words are counted exactly first. The most frequent ones get short numbers, and an n-gram of up to three of them is packed
into one 64-bit key; n-grams with other words that may matter take a key of three 64-bit word names. Tasks count the
keys in counting quotient filters, cut by shards of the permuted keys; filters of the same shard are merged and stored.
They lose nothing: keys are read back by the inverse permutation, and the phrases are scored by joins.

A phrase that occurs ``least`` times is made of words that do, so n-grams with rarer words are left out before they are
counted, as far as the words with short numbers are all that do. Names are 63-bit hashes of language and word; that no
other word shares the name of one that matters is checked over the whole vocabulary, and another salt is taken if one does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.llm import quotient_filter as qf
from alertsieve.llm.common import most_frequent, text_slices
from alertsieve.session import materialise

PIECE_BREAKS = b".,;:!?\n\x0b\x0c\r"  # fixed values
WORD_BREAKS = b" \t"  # fixed values
NO_LANGUAGE = "und"
LEAST = 10
COVERED = 50  # percent
TOP = 2000
NUMBER_BITS = 21
SHORT = (1 << NUMBER_BITS) - 1  # words with short numbers; 0 is no word
TASK_ROWS = 400_000  # counts of words that a task merges before it sends them
TASK_KEYS = 1 << 21  # keys that a task sorts at once, and about the items that it holds
SHARD_ITEMS = 1 << 22
LEAST_SHARD_BITS = 6
SALTS = 16
SLICE = 2 << 20
_WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_FILTER = "width int, shard bigint, bits int, items bigint, runs binary, remainders binary, counts binary"
_FILTER_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: its lower case, whether it breaks words, whether it breaks pieces."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    hard, gap = np.zeros(256, bool), np.zeros(256, bool)
    hard[list(PIECE_BREAKS)] = True
    gap[list(PIECE_BREAKS + WORD_BREAKS)] = True
    return lower, gap, hard


_LOWER, _GAP, _HARD = _tables()


def tokenise(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of all words of the texts: the place in the list of distinct words, that list, the text, and a number of the piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    none = np.zeros(0, np.int64)
    if n == 0:
        return none, pa.array([], pa.string()), none, none
    edges = offsets - first
    data = np.frombuffer(texts.buffers()[2], np.uint8, n, first)
    gap = _GAP[data]
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    inner = edges[(edges > 0) & (edges < n)]
    begins[inner] |= ~gap[inner]
    ends[inner - 1] |= ~gap[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return none, pa.array([], pa.string()), none, none
    letters = _LOWER[data[~gap]]
    bounds = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters)).dictionary_encode()
    doc = np.searchsorted(edges, starts, "right") - 1
    piece = np.cumsum(_HARD[data])[starts] + doc
    return words.indices.to_numpy().astype(np.int64), words.dictionary.cast(pa.string()), doc, piece


def _of_languages(langs: pa.Array, doc: np.ndarray, code: np.ndarray, distinct: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names of languages; the distinct (language, word) as language * distinct + word; the place of each token in them."""
    coded = pc.fill_null(langs.cast(pa.string()), NO_LANGUAGE).dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64)[doc] * max(distinct, 1) + code
    pairs, place = np.unique(key, return_inverse=True)
    return coded.dictionary, pairs, place


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Written: lang, word, n of all words of all texts."""

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(_WORDS.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        fresh = 0
        for batch in text_slices(batches, 1, SLICE):
            code, words, doc, _ = tokenise(batch.column(1))
            names, pairs, place = _of_languages(batch.column(0), doc, code, len(words))
            if not len(pairs):
                continue
            n = np.bincount(place, minlength=len(pairs))
            held.append(pa.table([names.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words))), pa.array(n)], _WORDS))
            fresh += len(pairs)
            if fresh >= TASK_ROWS:
                held, fresh = [merged(held)], 0
                if held[0].num_rows >= TASK_ROWS:
                    yield from held.pop().to_batches(max_chunksize=65_536)
        if held:
            yield from merged(held).to_batches(max_chunksize=65_536)

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("_text")).mapInArrow(count, "lang string, word string, n bigint")
    return materialise(rows.groupBy("lang", "word").agg(F.sum("n").alias("n")))


def _name(salt: str) -> Column:
    return F.xxhash64(F.concat(F.lit(salt), "lang"), "word").bitwiseOR(F.lit(1).cast("bigint"))


def names_of(salt: str, langs: list[str], words: list[str]) -> np.ndarray:
    """The same names as ``_name`` gives: never 0."""
    seeds = {x: xxhash.xxh64_intdigest((salt + x).encode(), 42) for x in set(langs)}
    return np.asarray([xxhash.xxh64_intdigest(w.encode(), seeds[x]) for x, w in zip(langs, words)], np.uint64) | np.uint64(1)


def salt_for(counted: DataFrame, least: int) -> str:
    """A salt under which no word shares the name of another one that occurs ``least`` times."""
    salt = ""
    while True:
        shared = counted.groupBy(_name(salt).alias("c")).agg(F.count("*").alias("k"), F.max("n").alias("n")).where((F.col("k") > 1) & (F.col("n") >= least))
        if shared.isEmpty():
            return salt
        salt += "+"


def count_filters(docs: DataFrame, short: np.ndarray, all_short: bool, salt: str, tokens: int, least: int, text_col: str, lang_col: str) -> DataFrame:
    """Written: the merged filters of the n-grams of two and three words that occur ``least`` times.

    ``short``: the sorted names of the words with short numbers; ``all_short`` says that all words that matter are there.
    """
    sent = docs.sparkSession.sparkContext.broadcast(short)  # at most SHORT names
    bits = max(LEAST_SHARD_BITS, int(2 * tokens // SHARD_ITEMS).bit_length())

    def rows(width: int, items: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        out = [(width, shard, *qf.pack(m, n, bits), len(n)) for shard, m, n in qf.by_shard(items, counts, bits)]
        columns = list(zip(*[(w, s, b, k, r, rem, c) for w, s, b, r, rem, c, k in out])) or [[]] * len(_FILTER_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, _FILTER_TYPES)], [x.split()[0] for x in _FILTER.split(", ")])

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Permuted keys of a slice: of one limb, and of three"""
        code, words, doc, piece = tokenise(batch.column(1))
        langs, pairs, place = _of_languages(batch.column(0), doc, code, len(words))
        if not len(pairs):
            return
        distinct = names_of(salt, langs.take(pa.array(pairs // len(words))).to_pylist(), words.take(pa.array(pairs % len(words))).to_pylist())
        known = sent.value
        at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
        number = np.where(known[at] == distinct, at + 1, 0).astype(np.uint64) if len(known) else np.zeros(len(distinct), np.uint64)
        name, number = distinct[place], number[place]
        small, large = [], []
        for size in (2, 3):
            first = np.flatnonzero(piece[size - 1 :] == piece[: len(piece) - size + 1])
            limbs = [number[first + j] if j < size else np.zeros(len(first), np.uint64) for j in range(3)]
            is_short = np.logical_and.reduce([x > 0 for x in limbs[:size]])
            small.append((limbs[0] << np.uint64(2 * NUMBER_BITS) | limbs[1] << np.uint64(NUMBER_BITS) | limbs[2])[is_short])
            if not all_short:
                long = first[~is_short]
                large.append(np.stack([name[long + j] if j < size else np.zeros(len(long), np.uint64) for j in range(3)], axis=1))
        yield qf.permute(np.concatenate(small)[:, None])
        if large:
            yield qf.permute(np.concatenate(large))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: dict[int, list[np.ndarray]] = {1: [], 3: []}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def settle(width: int) -> None:
            if fresh[width]:
                new = qf.summed(np.concatenate(fresh[width]))
                held[width] = qf.merge([held[width], new]) if width in held else new
                fresh[width] = []

        for batch in text_slices(batches, 1, SLICE):
            for found in keys(batch):
                width = found.shape[1]
                fresh[width].append(found)
                if sum(map(len, fresh[width])) >= TASK_KEYS:
                    settle(width)
                    if len(held[width][1]) >= TASK_KEYS:
                        yield rows(width, *held.pop(width))
        for width in fresh:
            settle(width)
            if width in held:
                yield rows(width, *held.pop(width))

    def merge(table: pa.Table) -> pa.Table:
        width, shard = table["width"][0].as_py(), table["shard"][0].as_py()
        filters = (qf.unpack(width, shard, bits, *[table[c][i].as_py() for c in ("bits", "runs", "remainders", "counts")]) for i in range(table.num_rows))
        items, counts = qf.merge(filters)
        keep = counts >= least
        return pa.Table.from_batches([rows(width, items[keep], counts[keep])])

    found = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("_text")).mapInArrow(count, _FILTER)
    merged = found.groupBy("width", "shard").applyInArrow(merge, _FILTER)
    return materialise(merged.withColumn("shard_bits", F.lit(bits)))


def read_filters(filters: DataFrame, short: np.ndarray) -> DataFrame:
    """c1, c2, c3 (names of the words, c3 null in pairs) and a, the count, of all items of stored filters."""
    sent = filters.sparkSession.sparkContext.broadcast(short)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                items, n = qf.unpack(r["width"], r["shard"], r["shard_bits"], r["bits"], r["runs"], r["remainders"], r["counts"])
                keys = qf.restore(items)
                if r["width"] == 1:
                    known = np.concatenate([np.zeros(1, np.uint64), sent.value])
                    mask = np.uint64((1 << NUMBER_BITS) - 1)
                    keys = known[np.stack([keys[:, 0] >> np.uint64(NUMBER_BITS * (2 - j)) & mask for j in range(3)], axis=1).astype(np.int64)]
                a, b, c = (keys[:, j].view(np.int64) if keys.flags.f_contiguous else np.ascontiguousarray(keys[:, j]).view(np.int64) for j in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, mask=c == 0), pa.array(n)], ["c1", "c2", "c3", "a"])

    return filters.mapInArrow(decode, "c1 bigint, c2 bigint, c3 bigint, a bigint")


def _score(l: str, r: str) -> Column:  # noqa: E741
    """floor(10^6 a a / (l r)), in decimals of 38 digits"""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"({wide('a')} * {wide('a')} * cast(1000000 as decimal(7,0))) div ({wide(l)} * {wide(r)})")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = TOP, short_words: int = SHORT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two and three words of each language.

    Texts (A-Z lower-cased) are split into pieces at ``.,;:!?`` and line breaks, pieces into words at blanks and tabs.
    a, l and r count the phrase and its two parts, n all words of the language; the score is floor(10^6 a^2 / (l r)) of the
    cut with the lowest one, the first of equal ones. Phrases below ``least`` and those inside a longer one with
    ``covered`` percent of their count are left out. Ties go by a, then by the phrase's UTF-8. Null languages are ``und``,
    null texts are empty, repeated rows count each time, an empty table gives no rows; other columns are not read.
    """
    if not 0 < short_words <= SHORT:
        raise ValueError(f"short_words must be from 1 to {SHORT}")
    counted = word_counts(docs, text_col, lang_col)
    totals = materialise(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    salt = salt_for(counted, least)
    words = materialise(counted.where(F.col("n") >= least).select(_name(salt).alias("c"), "lang", "word", F.col("n").alias("u")))
    best = most_frequent(words, "u", short_words).select("c").toPandas()["c"].to_numpy(np.int64)  # at most short_words
    short = np.sort(best.view(np.uint64))
    tokens = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    filters = count_filters(docs, short, len(short) == words.count(), salt, tokens, least, text_col, lang_col)
    grams = materialise(read_filters(filters, short))
    pairs = grams.where("c3 IS NULL").select("c1", "c2", "a")
    triples = grams.where("c3 IS NOT NULL")
    inside = triples.select(F.explode(F.array(F.struct("c1", "c2"), F.struct(F.col("c2").alias("c1"), F.col("c3").alias("c2")))).alias("p"), "a")
    inside = inside.groupBy("p.c1", "p.c2").agg(F.max("a").alias("_most"))
    pairs_left = pairs.join(inside, ["c1", "c2"], "left").where(F.coalesce(100 * F.col("_most") < covered * F.col("a"), F.lit(True)))
    word = lambda i, *more: words.select(F.col("c").alias(f"c{i}"), F.col("word").alias(f"w{i}"), F.col("u").alias(f"u{i}"), *more)
    two = pairs_left.join(word(1, "lang"), "c1").join(word(2), "c2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("u1").alias("l"), F.col("u2").alias("r"), _score("u1", "u2").alias("score"))
    three = triples.join(pairs.select("c1", "c2", F.col("a").alias("f12")), ["c1", "c2"])
    three = three.join(pairs.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"), F.col("a").alias("f23")), ["c2", "c3"])
    three = three.join(word(1, "lang"), "c1").join(word(2), "c2").join(word(3), "c3").withColumns({"_s1": _score("u1", "f23"), "_s2": _score("f12", "u3")})
    one = F.col("_s1") <= F.col("_s2")
    three = three.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(one, F.col("u1")).otherwise(F.col("f12")).alias("l"),
        F.when(one, F.col("f23")).otherwise(F.col("u3")).alias("r"),
        F.least("_s1", "_s2").alias("score"),
    )
    # the first of each salt contain the first of the language, so no task ranks more than SALTS times ``top`` phrases
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    salted = two.unionByName(three).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    firsts = salted.withColumn("_rank", rank("lang", "_salt")).where(F.col("_rank") <= top).drop("_rank", "_salt")
    ranked = firsts.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
