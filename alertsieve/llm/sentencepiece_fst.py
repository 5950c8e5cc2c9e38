"""Encoding and decoding with a sentence-piece vocabulary as a weighted finite-state transducer.

Three machines are compiled from the vocabulary file: the normaliser (text to text with visible spaces), the pieces (an
automaton that reads characters and writes an id at each piece's end) and the byte fallback (an arc of 1 to 4 byte
ids for a character that no piece has). Composed with units of text they give a graph whose nodes are places in the
units; an arc is a piece or a fallback. The weight of an arc is 0 if its piece may follow the piece before it, and
infinite if not: a piece may follow another if merging their joint characters, best score first, gives just the two.
Exactly one path of a unit has finite weight in the tropical semiring, and that shortest path is the encoding that the
vocabulary's merges define.

Many units are composed at once. Their arcs are taken place by place: weights are added to the distance of the place where
an arc begins, the least distance of the place where it ends is kept, and the paths are read backwards. Whether a piece may
follow another is told from the merges inside the two, compiled once for each piece: they run in order of their scores
until one across the border would be better than both, or none is left.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertsieve.llm.common import kept_in_worker, mix64, slices, tidy
from alertsieve.llm.pieces import SPACE, Cutter, PieceModel

UNITS_KEPT = 200_000
START = 0x2545F4914F6CDD1D
CHARACTERS = 200_000  # of the units that are composed at once; a longer unit comes alone
FALLBACK = -1  # the piece before is a fallback or the start: anything may follow


class Table:
    """A hash table of numbers from 1 on, as arrays with open addresses; many keys are looked up at once."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys, self.values, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, missing: int) -> np.ndarray:
        slot, out = self._slots(keys), np.full(len(keys), missing, np.int32)
        at = np.arange(len(keys))
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            out[at[hit]] = self.values[slot[hit]]
            on = np.flatnonzero(~hit & (there != 0))
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet. A table that is half full is emptied first."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            self.__init__(max(self.bits, (4 * len(keys)).bit_length()))
        self.used += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys  # of several keys for a slot the last one stays
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)


def _read(state: np.ndarray, character: np.ndarray) -> np.ndarray:
    """The state of the piece machine after one more character: a hash of what was read since its start."""
    return mix64((state ^ character.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) | np.uint64(1)


class Transducer:
    def __init__(self, model: PieceModel):
        self.model = model
        self.cut = Cutter(model)
        self.normal = model.normal()
        self.bytes = model.bytes()
        self.scores = model.scores
        self.units: dict[str, bytes] = {}
        self.pairs = Table(20)
        self.lengths = np.array([len(p) for p in model.pieces], np.int64)
        self.inner: dict[int, tuple[str, str, tuple, tuple]] = {}  # scores and parts by turns, as few objects as possible
        one = {p: p for p in model.pieces}
        for piece, number in self.normal.items():
            parts, steps = self.merge(piece)
            if parts == [piece]:  # others are never reached by merges
                part = lambda x: one.setdefault(x, x)
                self.inner[number] = (part(piece[0]), part(piece[-1]), tuple(x for s, first, _ in steps for x in (s, part(first))), tuple(x for s, _, last in steps for x in (s, part(last))))
        self.longest = max((len(model.pieces[i]) for i in self.inner), default=0)
        self.machine = self.compile()

    def merge(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Characters merged pairwise, best score first, leftmost among equals; for short strings.

        Also the score of each merge with the first and the last part after it.
        """
        parts, normal, scores = list(text), self.normal, self.scores
        steps = []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                if (k := normal.get(parts[i] + parts[i + 1])) is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def follows(self, a: int, b: int) -> bool:
        """Whether the arc of piece b after piece a has weight 0: no merge across their border is ever the best one left.

        Among equal scores the leftmost goes first: those in a, then the one across, then those in b.
        """
        _, left, _, ours = self.inner[a]
        right, _, theirs, _ = self.inner[b]
        normal, scores = self.normal, self.scores
        i, j, m, n = 0, 0, len(ours), len(theirs)
        while True:
            k = normal.get(left + right)
            if k is not None:
                across = scores[k]
                if (i == m or across > ours[i]) and (j == n or across >= theirs[j]):
                    return False
            if i < m and (j == n or ours[i] >= theirs[j]):
                left = ours[i + 1]
                i += 2
            elif j < n:
                right = theirs[j + 1]
                j += 2
            else:
                return True

    def compile(self) -> Table:
        """The states of the piece machine: the piece that ends there, or -1 inside of pieces."""
        state = {"": START}
        at: dict[int, int] = {}
        layer = [""]
        pieces = {self.model.pieces[i]: i for i in self.inner}
        for size in range(1, self.longest + 1):
            layer = sorted({p[:size] for p in pieces if len(p) >= size})
            after = _read(np.array([state[p[:-1]] for p in layer], np.uint64), np.array([ord(p[-1]) for p in layer], np.uint32))
            state.update(zip(layer, after.tolist()))
            at.update((s, pieces.get(p, -1)) for p, s in zip(layer, after.tolist()))
        if len(at) != len(state) - 1:
            raise ValueError("two states of the piece machine share a name")
        table = Table((4 * len(at)).bit_length())
        table.add(np.fromiter(at.keys(), np.uint64, len(at)), np.fromiter(at.values(), np.int32, len(at)))
        return table

    def compose(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the units in their joint text (a break after each), and where the arcs begin, end, and their pieces."""
        text = "\0".join(units) + "\0"
        ends = np.cumsum([len(u) + 1 for u in units]) - 1
        characters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at, state = np.arange(len(text), dtype=np.int32), np.full(len(text), START, np.uint64)
        begins, tos, pieces = [], [], []
        for size in range(self.longest):
            state = _read(state, characters[at + size])
            piece = self.machine.find(state, -2)
            ends_here = piece >= 0
            begins.append(at[ends_here])
            tos.append(at[ends_here] + size + 1)
            pieces.append(piece[ends_here])
            on = (piece > -2) & (at + size + 1 < len(text))
            at, state = at[on], state[on]
        none = np.zeros(0, np.int32)
        begin, to, piece = np.concatenate([none, *begins]), np.concatenate([none, *tos]), np.concatenate([none, *pieces])
        known = np.zeros(len(text), bool)
        known[begin[to == begin + 1]] = True
        known[ends] = True
        odd = np.flatnonzero(~known).astype(np.int32)  # characters that only the fallback reads
        return ends, np.concatenate([begin, odd]), np.concatenate([to, odd + 1]), np.concatenate([piece, np.full(len(odd), FALLBACK, piece.dtype)])

    def weights(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Weights of arcs after the pieces that come before them."""
        out = np.zeros(len(piece), np.float32)
        both = np.flatnonzero((before != FALLBACK) & (piece != FALLBACK))
        keys = before[both].astype(np.uint64) << np.uint64(20) | piece[both].astype(np.uint64) | np.uint64(1 << 50)
        fits = self.pairs.find(keys, -1)
        while len(new := np.unique(keys[fits < 0])):  # twice if the table was emptied for the new ones
            self.pairs.add(new, np.array([self.follows(k >> 20 & 0xFFFFF, k & 0xFFFFF) for k in new.tolist()], np.int32))
            fits = self.pairs.find(keys, -1)
        out[both[fits == 0]] = np.inf
        return out

    def shortest(self, units: list[str]) -> list[bytes]:
        """Ids of the shortest paths of the units, as 32-bit words."""
        ends, begin, to, piece = self.compose(units)
        sizes = np.diff(ends, prepend=-1) - 1
        starts = ends - sizes
        size = int(ends[-1]) + 1
        distance, last, back = np.full(size, np.inf, np.float32), np.full(size, FALLBACK, np.int32), np.zeros(size, np.int32)
        distance[starts] = 0.0
        longest = int(sizes.max(initial=0))
        depth = (to - np.repeat(starts.astype(np.int32), sizes + 1)[begin]).astype(np.uint16 if longest < 1 << 16 else np.int32)  # short numbers are sorted by their digits
        order = np.argsort(depth, kind="stable")
        begin, to, piece = begin[order], to[order], piece[order]
        levels = np.searchsorted(depth[order], np.arange(1, longest + 2))
        for a, b in zip(levels[:-1], levels[1:]):
            live = a + np.flatnonzero(distance[begin[a:b]] < np.inf)
            source, end = begin[live], to[live]
            total = distance[source] + self.weights(last[source], piece[live])
            better = total < distance[end]
            best, end = live[better], end[better]
            distance[end] = total[better]
            last[end], back[end] = piece[best], source[better]
        owner, path = [], []
        at, unit = ends[sizes > 0], np.flatnonzero(sizes > 0)
        while len(at):
            owner.append(unit)
            path.append(np.where(last[at] == FALLBACK, -1 - at, last[at]))
            at = back[at]
            more = at > starts[unit]
            at, unit = at[more], unit[more]
        owner, path = np.concatenate(owner)[::-1] if owner else np.zeros(0, np.int64), np.concatenate(path)[::-1] if path else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        owner, path = owner[order], path[order]
        cut = (np.searchsorted(owner, np.arange(len(units) + 1)) * 4).tolist()
        raw = path.astype(np.int32).tobytes()
        out = [raw[a:b] for a, b in zip(cut, cut[1:])]
        for u in np.unique(owner[path < 0]).tolist():
            ids: list[int] = []
            for x in path[cut[u] // 4 : cut[u + 1] // 4].tolist():
                ids.extend([x] if x >= 0 else self.fallback(units[u][-2 - x - int(starts[u])]))
            out[u] = array("I", ids).tobytes()
        return out

    def fallback(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")] if self.bytes else [self.model.unknown()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit words. Each distinct unit is composed once and kept for a while."""
        if len(self.units) > UNITS_KEPT:
            self.units.clear()
        known = self.units
        cut = [self.cut(t) for t in texts]
        found = [list(map(known.get, units)) for units in cut]
        lacking = [i for i, ids in enumerate(found) if None in ids]
        new = list({u for i in lacking for u, ids in zip(cut[i], found[i]) if ids is None})
        at = 0
        while at < len(new):
            stop, room = at, CHARACTERS
            while stop < len(new) and (room > 0 or stop == at):
                room -= len(new[stop]) + 1
                stop += 1
            known.update(zip(new[at:stop], self.shortest(new[at:stop])))
            at = stop
        for i in lacking:
            found[i] = map(known.__getitem__, cut[i])
        return [b"".join(ids) for ids in found]


class Inverse:
    """The machines read from output to input: ids to text. It needs no merges, so it's small."""

    def __init__(self, model: PieceModel):
        self.prefix = model.prefix
        self.shown = [p.encode("utf-8") for p in model.pieces]
        for b, i in model.bytes().items():
            self.shown[i] = bytes([b])

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The space that the normaliser put first goes."""
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def transducer(path: str) -> Transducer:
    return kept_in_worker(("transducer", path), lambda: Transducer(PieceModel.read(path)))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of each whole text as an array in ``ids_col`` (taken over if it is there already).

    Null and empty texts get an empty array. Characters outside the vocabulary become byte ids.
    """
    kept = [f for f in docs.schema.fields if f.name != ids_col]
    places = [docs.columns.index(f.name) for f in kept]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path)
        for batch in slices(batches, 256):
            ids = machine.encode(batch.column(at).to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), lists], [*(f.name for f in kept), ids_col])

    schema = docs.select(*[F.col(f"`{f.name}`") for f in kept]).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids in ``text_col``; null ids give null, no ids the empty text."""
    kept = [f for f in rows.schema.fields if f.name != text_col]
    places = [rows.columns.index(f.name) for f in kept]
    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = kept_in_worker(("inverse", model_path), lambda: Inverse(PieceModel.read(model_path)))
        for batch in slices(batches, 256):
            lists = batch.column(at)
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)  # of the whole batch, not only of the slice
            texts = [inverse.decode(ids[a:b].tolist()) if some else None for a, b, some in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(texts, pa.string())], [*(f.name for f in kept), text_col])

    schema = rows.select(*[F.col(f"`{f.name}`") for f in kept]).schema.add(text_col, "string")
    return rows.mapInArrow(tidy(run), schema)
