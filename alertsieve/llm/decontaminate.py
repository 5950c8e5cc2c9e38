"""Benchmark decontamination: bounds of the alignment score find candidates, Smith-Waterman alignment scores them.

No n-gram of an edited copy has to survive. An item that scores ``t`` has a share of ``t`` of its words in the text at
least, each as often as it is matched. A stretch of the text scores at most ``MATCH`` for each word of the item and loses
one for each other word; the highest such sums begin after the running sum was lowest. Only texts and stretches below
these bounds are left out, so each item at or above the threshold is found, with the score of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.llm.common import text_slices, word_hashes

THRESHOLD = 0.5
MATCH, MISS, GAP = 2, 1, 1
BLOCK_SUMS = 1 << 20
PORTION_BYTES = 8 << 20  # text of the test items that one broadcast holds; a larger benchmark takes several passes


@dataclass
class Items:
    ids: list  # item ids
    words: list[np.ndarray]  # word hashes of each item
    known: np.ndarray  # sorted distinct words of all items
    edges: np.ndarray  # where the items of each known word begin
    item: np.ndarray  # items that count the word
    times: np.ndarray  # how often they have it
    sizes: np.ndarray  # words of each item
    least: np.ndarray  # counted words that an alignment at the threshold has

    @staticmethod
    def of(ids: list, texts: list[str | None], threshold: float) -> Items:
        hashed, edges = word_hashes(pa.array(texts, pa.string()), plain=True)
        words = [hashed[a:b] for a, b in zip(edges[:-1], edges[1:])]
        known, code = np.unique(hashed, return_inverse=True)
        item = np.repeat(np.arange(len(ids)), np.diff(edges))
        most = max(1, len(ids))
        pairs, times = np.unique(code.astype(np.int64) * most + item, return_counts=True)
        word, item = np.divmod(pairs, most)
        # an alignment needs `need` equal words; those of up to half as many places, the commonest, are taken as equal and not counted
        sizes = np.diff(edges)
        need = np.array([next(m for m in range(n + 2) if m > n or m / max(1, n) >= threshold) for n in sizes.tolist()], np.int64)
        order = np.lexsort((-np.bincount(word, minlength=len(known))[word], item))
        before = np.append(0, np.cumsum(times[order]))
        own = before[1:] - before[np.searchsorted(item[order], item[order])]
        free = np.zeros(len(pairs), bool)
        free[order] = own <= (need // 2)[item[order]]
        least = need - np.bincount(item[free], times[free], len(ids)).astype(np.int64)
        word, item, times = word[~free], item[~free], times[~free]
        return Items(ids, words, known, np.searchsorted(word, np.arange(len(known) + 1)), item, times, sizes, least)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the known words, ``len(known)`` for all others."""
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, at, len(self.known))


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman score of the best local alignment as a share of the item's own, and where it ends in the window.

    A row of the table is one array: gaps along the row come from a running maximum.
    """
    best, end = 0, 0
    slope = np.arange(len(window) + 1) * GAP
    row = np.zeros(len(window) + 1, np.int64)
    for word in item:
        new = np.maximum(row - GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(window == word, MATCH, -MISS), out=new[1:])
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best / (MATCH * len(item)), end


def stretches(inside: np.ndarray, size: int, threshold: float) -> list[tuple[int, int]]:
    """Parts (begin, end) of a text in which an item of ``size`` words may score ``threshold``; ``inside`` tells its words."""
    total = np.cumsum(np.where(inside, MATCH, -min(MISS, GAP)))
    bound = total - np.minimum(np.minimum.accumulate(total), 0)  # highest sum of a stretch that ends here
    high = np.flatnonzero(bound / (MATCH * size) >= threshold)
    if not len(high):
        return []
    zero = np.flatnonzero(bound == 0)  # no best alignment goes on from here: what is before adds nothing
    begin = np.append(0, zero + 1)[np.searchsorted(zero, high)]
    last = np.append(np.flatnonzero(np.diff(begin)), len(high) - 1)
    return list(zip(begin[last].tolist(), (high[last] + 1).tolist()))


def candidates(codes: np.ndarray, edges: np.ndarray, items: Items, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Texts and items of which some block of the text has ``least`` of the counted words.

    With ``m`` equal words an alignment has ``3 m - 2 t n`` words of the text at most (else the others cost too much), so
    blocks of twice that length, each begun in the middle of the one before, hold every alignment whole.
    """
    reach = int((3 - 2 * min(threshold, 1)) * items.sizes.max()) + 1
    size, known = len(items.ids), len(items.known)
    cells = np.diff(edges) // reach + 1
    text = np.repeat(np.arange(len(cells)), cells)
    places = np.flatnonzero(codes < known)
    of = np.searchsorted(edges, places, "right") - 1
    inner = (places - edges[of]) // reach
    cell, code = (np.cumsum(cells) - cells)[of] + inner, codes[places]
    some = max(1, BLOCK_SUMS // size)
    found = [np.zeros(0, np.int64)]
    for first in range(0, len(text), some):
        a, b = np.searchsorted(cell, [first, first + some + 1])  # the last block ends in the cell after it
        own, word = cell[a:b] - first, code[a:b]
        begun = own < some
        before = (own > 0) & (inner[a:b] > 0)
        at, n = np.unique(np.concatenate([own[begun] * known + word[begun], (own[before] - 1) * known + word[before]]), return_counts=True)
        at, which = np.divmod(at, known)
        count = items.edges[which + 1] - items.edges[which]
        rows = np.repeat(items.edges[which] - np.cumsum(count) + count, count) + np.arange(count.sum())
        equal = np.bincount(np.repeat(at * size, count) + items.item[rows], np.minimum(items.times[rows], np.repeat(n, count)), min(some, len(text) - first) * size)
        block, item = np.nonzero(equal.reshape(-1, size) >= np.maximum(items.least, 1))
        found.append(text[first + block] * size + item)
    return np.divmod(np.unique(np.concatenate(found)), size)


def leaks_of(words: np.ndarray, edges: np.ndarray, items: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text number, item number, score, first word, end) of the items that texts hold, best alignment of each."""
    if not len(items.known) or not len(words):
        return []
    codes = items.codes(words)
    mark = np.zeros(len(items.known) + 1, bool)
    out = []
    for text, i in zip(*(x.tolist() for x in candidates(codes, edges, items, threshold))):
        own, start = items.words[i], int(edges[text])
        numbers = items.codes(own)
        mark[numbers] = True
        inside = mark[codes[start : edges[text + 1]]]
        mark[numbers] = False
        best = (0.0, 0, 0)
        for a, b in stretches(inside, len(own), threshold):
            have, times = np.unique(own, return_counts=True)
            seen = np.searchsorted(have, words[start + a : start + b][inside[a:b]])
            if np.minimum(np.bincount(seen, minlength=len(have)), times).sum() / len(own) < threshold:
                continue
            score, end = align(own, words[start + a : start + b])
            if score > best[0]:
                best = (score, max(0, a + end - len(own)), a + end)
        if best[0] > 0 and best[0] >= threshold:
            out.append((text, i, *best))
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """Rows (id, item_id, score, first_word, end_word) of documents that hold a test item, whole or edited.

    ``score`` is the Smith-Waterman score over words (runs between white space and ASCII marks, all
    letters lower-cased) as a share of an exact copy's, at least ``threshold``. Whole texts are searched. Null or empty texts and items give no rows; repeated documents and items
    give their rows each; other columns are not read. Items are sent to all tasks in portions of ``portion_bytes``.
    """
    tests = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    portions = -(-size // portion_bytes) or 1
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for p in range(portions):
        part = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(portions)) == p).orderBy("item", "text").collect()
        found = _portion(rows, Items.of([r["item"] for r in part], [r["text"] for r in part], threshold), threshold)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("_id").alias(id_col), "item_id", "score", "first_word", "end_word")


def _portion(rows: DataFrame, items: Items, threshold: float) -> DataFrame:
    plain = (items.ids, items.words, items.known, items.edges, items.item, items.times, items.sizes, items.least)  # workers may not know this module
    sent = rows.sparkSession.sparkContext.broadcast(plain)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(*sent.value)
        for batch in text_slices(batches, 1):
            words, edges = word_hashes(batch.column(1), plain=True)
            ids = batch.column(0).to_pylist()
            found = [(ids[at], own.ids[i], *rest) for at, i, *rest in leaks_of(words, edges, own, threshold)]
            if found:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], ["_id", "item_id", "score", "first_word", "end_word"])

    return rows.mapInArrow(search, "_id bigint, item_id bigint, score double, first_word bigint, end_word bigint")
