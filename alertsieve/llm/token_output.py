"""Token ids as files of Simple-8b words.

A shard table has one row per chunk of whole documents:

========  ============================================================================
shard     number of the range of document ids, ascending
chunk     number of the chunk in its shard, ascending
doc_ids   ids of the documents in order
counts    ids of each document, its end id included
n_ids     ids of the chunk
first     ids of the shard before the chunk
offsets   first 64-bit word of each block of ``BLOCK`` ids, so that blocks decode alone
packed    the words: 4 bits of selector, 60 bits of ids, little-endian
escapes   ids that need more than 60 bits, as plain 64-bit words
========  ============================================================================
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertsieve.llm.common import kept_in_worker, slices
from alertsieve.session import materialise

#: Ids per word and bits per id of each selector (fixed values). Selector 0 is an escape: its bits are a place in ``escapes``.
COUNTS = [1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
BLOCK = 4096
CHUNK_IDS = 65536
UNITS_KEPT = 450_000  # in a generation; two are kept
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Byte-level pre-tokens never cross the borders of these units, so a unit has the same ids in any text.
UNIT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A word of Latin letters (one pre-token, as no letter follows) and the marks behind it.
WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_ODD = ["  ", " \n", "\n ", "\n\n", "\0", *"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
CHUNK_SCHEMA = "shard int, chunk int, doc_ids array<bigint>, counts array<int>, n_ids bigint, first bigint, offsets array<int>, packed binary, escapes binary"


def _classes(ids: np.ndarray) -> np.ndarray:
    """The selector with fewest bits that holds each id; 0 for an escape."""
    limits = np.asarray([(1 << b) - 1 for b in BITS[1:]], np.uint64)
    if ids.size and int(ids.max()) < 1 << 17:
        return _small_classes()[ids.astype(np.int64)]
    found = np.searchsorted(limits, ids, "left") + 1
    return np.where(found > 15, 0, found).astype(np.uint8)


def _small_classes(kept: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006  one table for each process
    if not kept:
        limits = np.asarray([(1 << b) - 1 for b in BITS[1:]], np.uint64)
        kept.append((np.searchsorted(limits, np.arange(1 << 17, dtype=np.uint64), "left") + 1).astype(np.uint8))
    return kept[0]


def pack(ids: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """Offsets of the blocks, words and escapes of a chunk.

    Each block is followed by zeros, so that the last word of a block may be half empty and no word crosses blocks.
    """
    n, room = len(ids), COUNTS[1]
    if n == 0:
        return [], b"", b""
    blocks = -(-n // BLOCK)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    kinds = np.zeros(blocks * BLOCK, np.uint8)
    kinds[:n] = _classes(flat[:n])
    real = np.zeros(blocks * BLOCK, bool)
    real[:n] = True
    spaced = lambda x: np.pad(x.reshape(blocks, BLOCK), ((0, 0), (0, room))).ravel()
    wide = real & (kinds == 0)
    escapes = flat[wide]
    kinds[wide] = 16
    flat, kind, wide = spaced(flat), spaced(kinds), spaced(wide)
    choice = np.full(len(kind), 15, np.uint8)
    longest, most, least = 1, kind, int(kinds[:n].min())
    for s in range(14, max(least, 1) - 1, -1):  # selectors with more and more ids: the largest class in each run of that length
        need = COUNTS[s]
        while longest < need:
            add = min(longest, need - longest)
            most = np.maximum(most[: len(most) - add], most[add:])
            longest += add
        choice[: len(most)][most <= s] = s
    choice[wide] = 0
    step = np.asarray(COUNTS)[choice].tolist()
    starts, firsts = [], []
    for k in range(blocks):
        firsts.append(len(starts))
        i = k * (BLOCK + room)
        end = i + min(BLOCK, n - k * BLOCK)
        while i < end:
            starts.append(i)
            i += step[i]
    starts = np.asarray(starts, np.int64)
    chosen = choice[starts]
    out = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        first = starts[rows]
        if s == 0:
            out[rows] |= np.arange(len(rows), dtype=np.uint64)
        elif BITS[s]:
            body = flat[first]
            for j in range(1, COUNTS[s]):
                body |= flat[first + j] << np.uint64(j * BITS[s])
            out[rows] |= body
    return firsts, out.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()


def unpack(n: int, offsets: list[int], packed: bytes, escapes: bytes, block: int | None = None) -> np.ndarray:
    """The ``n`` ids of a chunk, or those of one of its blocks."""
    words, wide = np.frombuffer(packed, "<u8"), np.frombuffer(escapes, "<u8")
    if n == 0:
        return np.zeros(0, np.uint64)
    edges = np.asarray([*offsets, len(words)])
    if block is not None:
        words = words[edges[block] : edges[block + 1]]
        n, edges = min(BLOCK, n - block * BLOCK), np.asarray([0, len(words)])
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.asarray(COUNTS)[chosen]
    ends = np.cumsum(counts)
    # a block's last word may hold fewer ids than its selector says: the next block begins where it should
    over = ends[edges[1:] - 1] - np.minimum(np.arange(1, len(edges)) * BLOCK, n)
    late = np.diff(np.concatenate([[0], over]))
    shift = np.repeat(np.concatenate([[0], np.cumsum(late)[:-1]]), np.diff(edges))
    first_of = ends - counts - shift
    out = np.zeros(n + COUNTS[1], np.uint64)
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        first, body = first_of[rows], words[rows]
        if s == 0:
            out[first] = wide[(body & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[s]:
            mask = np.uint64((1 << BITS[s]) - 1)
            for j in range(COUNTS[s]):
                part = (body >> np.uint64(j * BITS[s])) & mask
                out[first + j] |= part  # by "or": the zeros at the end of a block fall on the next one
    return out[:n]


class Encoder:
    """Ids of whole texts. Each distinct word goes through the tokenizer once and is kept for a while.

    Units are what no pre-token crosses: a word with the space before it, or a line break. Texts with other
    white space, or with two such characters in a row, are cut by ``UNIT``. Texts that hold the string of an added token
    go through the tokenizer whole. Units are kept in two generations, so the frequent ones stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        show = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {i: show(chr(i))[0][0] for i in range(128)}
        self.shown |= {ord(c): show(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self.space = self.shown[32]
        self.fresh: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        if any(x in text for x in _ODD):
            return UNIT.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def word(self, word: str) -> bytes:
        """Ids of a run of letters, which is one pre-token."""
        shown = (self.space + word[1:] if word[0] == " " else word) if word.isascii() else word.translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def unit(self, unit: str) -> bytes:
        """A run of Latin letters at the start and marks behind it are pre-tokens of their own; anything else goes through the whole tokenizer."""
        if unit.isascii() and unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            return self.word(unit)
        if m := WORD.fullmatch(unit):
            return self.find(m[1], self.word) + self.find(m[2], self.whole) if m[2] else self.word(unit)
        return self.whole(unit)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def find(self, unit: str, make: Callable[[str], bytes]) -> bytes:
        if (ids := self.fresh.get(unit)) is None:
            if (ids := self.old.get(unit)) is None:
                ids = make(unit)
            self.fresh[unit] = ids
        return ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if any(x in text for x in self.added):
                out.append(self.whole(text))
                continue
            if len(self.fresh) > UNITS_KEPT:
                self.old, self.fresh = self.fresh, {"": b""}
            known, units = self.fresh, self.cut(text)
            ids = list(map(known.get, units))
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = self.find(units[i], self.unit)
            out.append(b"".join(ids))
        return out


def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker, so that later tasks find the units of earlier ones."""
    return kept_in_worker(("encoder", path), lambda: Encoder(path))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the written shard table.

    Null texts are empty; null ids come first; ids are whole numbers. Strings of added tokens become those tokens, as the library does. Repeated ids keep one entry per row. An empty table gives no chunks.
    Other columns are not read. Each task holds one chunk and the units kept, whatever the size of the table.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        shard, number = TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = before = 0

        def chunk() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            offsets, packed, escapes = pack(ids)
            row = [[shard], [number], [[d for d, _ in held]], [[len(x) // 4 for _, x in held]], [len(ids)], [before], [offsets], [packed], [escapes]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names)

        for batch in slices(batches, 128):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder([t or "" for t in batch.column(1).to_pylist()])):
                held.append((doc_id, ids + end))
                size += len(ids) // 4 + 1
                if size >= CHUNK_IDS:
                    yield chunk()
                    held, before, size, number = [], before + size, 0, number + 1
        if held:
            yield chunk()

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    ordered = rows.repartitionByRange("_id").sortWithinPartitions("_id", F.xxhash64("_text"))
    return materialise(ordered.mapInArrow(encode, CHUNK_SCHEMA))


def read_shards(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the words of a shard table."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            ids = unpack(row["n_ids"], row["offsets"], row["packed"], row["escapes"])
            ends = np.cumsum(row["counts"])
            starts = ends - row["counts"]
            crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + starts, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_all")).select("shard", F.coalesce(F.sum("_all").over(ahead), F.lit(0)).alias("_before"))
    placed = chunks.join(F.broadcast(shards), "shard")  # one small row for each task of the writer
    return placed.select((F.col("_before") + F.col("first")).alias("base"), "doc_ids", "counts", "n_ids", "offsets", "packed", "escapes").mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
