"""Helpers of the text operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes (fixed values).
WORD_BREAKS = "[\\x20\\x09-\\x0D]+"
ROWS_AT_ONCE = 512
_PLACES = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kept_in_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """A value that later tasks of the same Python worker find again.

    Functions travel to the workers by value, so a global of this module would be new in each task.
    """
    kept = sys.__dict__.setdefault("_alertsieve_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def drop_kept() -> None:
    """Forget what earlier operators kept in this worker."""
    sys.__dict__.get("_alertsieve_kept", {}).clear()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives memory back to the system after its last batch, as workers stay alive between tasks and stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return tidied


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, with A-Z lower-cased (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def words(text: Column) -> Column:
    """The words of a text as an array without empty strings; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAKS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is used where a text is plain ASCII, else a map of 26 letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of the largest counts in column ``n``, at most ``most`` rows.

    A histogram of the counts, to three digits, gives the least count that is taken whole; the room left is filled in the
    order of a hash, down to a 4,096th of those. No task and not the driver sees
    more rows than are returned, as a sorted limit would make them.
    """
    unit = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(n)) - 2, F.lit(0)))
    low = (F.floor(F.col(n) / unit) * unit).cast("bigint")
    found = counts.where(F.col(n) > 0)
    histogram = found.groupBy(low.alias("low")).agg(F.count("*").alias("k")).collect()  # 900 rows for each power of ten
    taken, bound, rest = 0, None, None
    for r in sorted(histogram, reverse=True):
        if taken + r["k"] > most:
            rest = r["low"]
            break
        taken, bound = taken + r["k"], r["low"]
    chosen = F.lit(False) if bound is None else F.col(n) >= bound
    if rest is not None:  # of the counts that don't fit whole, those with the smallest hashes
        place = F.pmod(F.xxhash64(*[c for c in counts.columns if c != n]), F.lit(_PLACES))
        last, end = taken, 0
        for r in sorted(found.where(low == rest).groupBy(place.alias("at")).agg(F.count("*").alias("k")).collect()):  # _PLACES rows
            if last + r["k"] > most:
                break
            last, end = last + r["k"], r["at"] + 1
        chosen = chosen | ((low == rest) & (place < end))
    return found.where(chosen)


SLICE_BYTES = 1 << 18  # numbers of 8 bytes for each byte of a slice then stay in a core's cache
_MIX = np.uint64(0x9E3779B97F4A7C15)


def text_slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose texts (column number ``text``) have about ``most`` bytes together; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit value for each byte, the same for A-Z and a-z; which bytes break words, without and with ASCII marks."""
    values = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX)
    values[65:91] = values[97:123]
    breaks = np.zeros(256, bool)
    breaks[[9, 10, 11, 12, 13, 32]] = True
    marks = breaks.copy()
    marks[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
    return values, breaks, marks


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = 0xD6E8FEB86659FD93
            inverse = pow(base, -1, 1 << 64)
            size = max(n, SLICE_BYTES + 4096)
            for name, x in (("up", base), ("down", inverse)):
                powers = np.full(size, x, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up, self.down


def word_hashes(texts: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, with A-Z lower-cased, and where each text's words begin and end.

    Works on the UTF-8 bytes of the Arrow array without making Python strings. Nulls have no words. ``plain`` lower-cases
    all letters and breaks words at ASCII marks too.
    """
    if plain:
        texts = pc.utf8_lower(texts)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    edges = offsets - first
    n = last - first
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, n, first)
    values, breaks, marks = kept_in_worker("byte values", _byte_values)
    up, down = kept_in_worker("powers", Powers).upto(n + 1)
    gap = (marks if plain else breaks)[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    inner = edges[(edges > 0) & (edges < n)]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64) * _MIX), np.searchsorted(starts, edges)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word windows of one text; of the whole sequence if it is shorter; none without words."""
    if len(words) == 0:
        return words
    size = min(k, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ words[j : j + n]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j + 1)
        h ^= h >> np.uint64(29)
    return mix64(h)
