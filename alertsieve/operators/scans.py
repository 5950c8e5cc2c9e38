"""Rules that go through points one after the other, without doing so.

Each key's points are cut into blocks of ``SPAN`` positions, which tasks take in any order.

*Gap suppression.* Which hit is kept next after a kept one is a function of the position alone. A block's transfer
function says, for each hit that could be the first one kept in it, which is the last one; there are at most gap + 2 of
them. The functions of a key's blocks are composed in order, which gives what each block starts from, and then
each block marks its own hits. Inside a block the chain is followed by pointer doubling.

*Greedy matching.* What a point may still take depends on the partners used within reach of it, a set of bits. Strips of
points run side by side from a guessed state, and those that began with another state than the one before them ended with
run again, until all fit. The same goes for blocks. Few strips do, as a state is forgotten after some points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertsieve.session import materialise

SPAN = 65_536  # positions of a block
STRIP = 256  # points of a strip
_ROWS = 262_144


def _changes(pdf: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """Which rows begin a new group; nulls are equal to each other."""
    new = np.ones(len(pdf), bool)
    new[1:] = False
    for c in by:
        v = pdf[c]
        w = v.shift()
        new |= ((v != w) & ~(v.isna() & w.isna())).to_numpy(bool)
    return new


def whole_groups(batches: Iterator[pd.DataFrame], by: Sequence[str], rows: int = _ROWS) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of about ``rows`` rows with whole groups, of batches that are sorted by ``by``; and where groups begin."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size < rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        starts = np.flatnonzero(_changes(whole, by))
        cut = int(starts[-1])
        held, size = [whole.iloc[cut:]], len(whole) - cut
        if cut:
            yield whole.iloc[:cut], starts[:-1]
    if size:
        whole = pd.concat(held, ignore_index=True)
        yield whole, np.flatnonzero(_changes(whole, by))


def _blocks(df: DataFrame, by: Sequence[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over frames of whole blocks, sorted by position."""
    by = list(by)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, by):
            yield run(pdf.reset_index(drop=True), starts)

    return df.repartition(*by).sortWithinPartitions(*by, "pos").mapInPandas(over, schema)


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)


# --- gap suppression ------------------------------------------------------------------------------------


class _Chain:
    """Hits of some blocks with the hit that is kept next after each; ``end`` stands for none in the block."""

    def __init__(self, pos: np.ndarray, gap: np.ndarray, starts: np.ndarray, span: int):
        self.n = len(pos)
        self.starts = starts
        self.sizes = np.diff([*starts, self.n])
        self.group = np.repeat(np.arange(len(starts)), self.sizes)
        self.base = np.repeat(pos[starts] // span * span, self.sizes)
        self.wide = 2 * span
        self.gap = np.maximum(gap, -1)
        self.place = self.group * self.wide + (pos - self.base)
        self.stops = np.append(starts, self.n)[self.group + 1]
        after = self.first_after(pos, self.group, self.base, self.gap)
        self.next = np.minimum(np.maximum(after, np.arange(self.n) + 1), self.stops)
        self.next[self.next == self.stops] = self.n

    def first_after(self, pos: np.ndarray, group: np.ndarray, base: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Index of the first hit of the group that is more than ``gap`` after ``pos``."""
        off = np.clip(pos - base + gap, -1, self.wide - 2)
        return np.searchsorted(self.place, group * self.wide + off, "right")

    def last(self) -> np.ndarray:
        """For each hit the last one kept in its block if it is kept itself."""
        jump = np.where(self.next < self.n, self.next, np.arange(self.n))
        while True:
            further = jump[jump]
            if (further == jump).all():
                return jump
            jump = further

    def kept(self, first: np.ndarray) -> np.ndarray:
        """All that are kept if those are the first ones."""
        reach = np.zeros(self.n + 1, bool)
        reach[first] = True
        jump = np.append(self.next, self.n)
        reach[self.n] = False
        while True:
            to = jump[np.flatnonzero(reach)]
            if reach[to[to < self.n]].all():
                return reach[:-1]
            reach[to] = True
            reach[self.n] = False
            jump = jump[jump]


def suppress(hits: DataFrame, keys: Sequence[str] = ("series_id", "detector"), span: int = SPAN) -> DataFrame:
    """Keep a hit only if it is more than ``gap`` after the last kept hit of its key; a negative gap keeps all.

    The gap (a column) is the same for all hits of a key. Positions are whole numbers.
    """
    keys = list(keys)
    by = [*keys, "_blk"]
    columns = hits.columns
    rows = materialise(hits.withColumn("_blk", F.floor(F.col("pos") / F.lit(span)).cast("long")))

    def mark(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        pos = pdf["pos"].to_numpy(np.int64)
        chain = _Chain(pos, pdf["gap"].to_numpy(np.int64), starts, span)
        first = starts.copy()
        if "_after" in pdf:
            after = pdf["_after"].to_numpy(float)[starts]
            some = np.flatnonzero(~np.isnan(after))
            at = starts[some]
            first[some] = chain.first_after(after[some].astype(np.int64), some, chain.base[at], chain.gap[at])
            first = first[first < np.append(starts, chain.n)[1:]]
        return pdf.loc[chain.kept(first), columns]

    def transfer(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        pos = pdf["pos"].to_numpy(np.int64)
        chain = _Chain(pos, pdf["gap"].to_numpy(np.int64), starts, span)
        near = np.searchsorted(chain.place, np.arange(len(starts)) * chain.wide + np.clip(chain.gap[starts], 0, span), "right")
        taken = np.arange(chain.n) <= near[chain.group]
        out = pdf.loc[taken, [*by, "gap"]]
        return out.assign(first=pos[taken], last=pos[chain.last()[taken]])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_blk", "first"], ignore_index=True)
        starts = np.flatnonzero(np.r_[True, np.diff(pdf["_blk"]) != 0])
        first, last, gap = pdf["first"].to_numpy(), pdf["last"].to_numpy(), int(pdf["gap"].iloc[0])
        after, at = [], None
        for a, b in zip(starts, [*starts[1:], len(pdf)]):  # one step for each block
            after.append(at)
            i = a if at is None else a + int(np.searchsorted(first[a:b], at + gap, "right"))
            at = at if i == b else int(last[i])
        return pdf.loc[starts, by].assign(_after=np.array(after, float))

    several = rows.groupBy(*keys).agg(F.min("_blk").alias("_lo"), F.max("_blk").alias("_hi")).where("_lo < _hi").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    schema = _fields(hits, columns)
    if several.isEmpty():
        return _blocks(rows, by, mark, schema)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    long = rows.where("gap > 0").join(several, same, "left_semi")
    maps = _blocks(long, by, transfer, f"{_fields(rows, [*by, 'gap'])}, first long, last long")
    # a task holds gap + 2 numbers for each block of its key
    starts = materialise(maps.groupBy(*keys).applyInPandas(compose, f"{_fields(rows, by)}, _after double"))
    named = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_b"), "_after")
    joined = rows.join(named, [*same, F.col("_blk") == F.col("_b")], "left").select(*rows.columns, "_after")
    return _blocks(joined, by, mark, schema)


# --- greedy matching -----------------------------------------------------------------------------------


def _take(free: np.ndarray, tolerance: int, nearest: bool) -> np.ndarray:
    """The bit taken of each set of free partners (bit i stands for a distance of i - tolerance); 0 if there is none."""
    one = free.dtype.type(1) if free.dtype != object else 1
    low = free & (~free + one) if free.dtype != object else free & -free
    if not nearest:
        return low
    best = np.zeros_like(free)
    for d in range(tolerance + 1):
        for side in (tolerance - d, tolerance + d):
            bit = one << free.dtype.type(side) if free.dtype != object else 1 << side
            best = np.where((best == 0) & ((free & bit) != 0), bit, best)
    return best


def _shift(used: np.ndarray, by: np.ndarray, reach: int) -> np.ndarray:
    gone = by > reach
    if used.dtype == object:
        return np.array([0 if g else int(u) >> int(b) for u, b, g in zip(used, by, gone)], object)
    return np.where(gone, np.uint64(0), used >> np.where(gone, 0, by).astype(np.uint64))


def match_sets(lead: np.ndarray, sets: np.ndarray, starts: np.ndarray, tolerance: int, nearest: bool, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bit that each leading point takes of its set of partners, and the used bits after each.

    ``starts``: where groups begin; ``before``: for each group the last leading point before it and what was used then.
    """
    n, reach = len(lead), 2 * tolerance
    sizes = np.diff([*starts, n])
    cut = [np.arange(a, a + s, STRIP) for a, s in zip(starts, sizes)] if (sizes > STRIP).any() else [starts]
    strips = np.concatenate(cut).astype(np.int64)
    group = np.searchsorted(starts, strips, "right") - 1
    heads = np.isin(strips, starts)
    lengths = np.diff([*strips, n])
    taken, used = np.zeros_like(sets), np.zeros_like(sets)
    own = _shift(before[1][group], lead[strips] - before[0][group], reach)
    entry = np.where(heads, own, np.zeros_like(own))
    todo = np.arange(len(strips))
    while len(todo):
        state = entry[todo].copy()
        for j in range(int(lengths[todo].max())):
            live = np.flatnonzero(lengths[todo] > j)
            at = strips[todo[live]] + j
            if j:
                state[live] = _shift(state[live], lead[at] - lead[at - 1], reach)
            bit = _take(sets[at] & ~state[live], tolerance, nearest)
            state[live] |= bit
            taken[at], used[at] = bit, state[live]
        inner = np.flatnonzero(~heads)
        wanted = entry.copy()
        wanted[inner] = _shift(used[strips[inner] - 1], lead[strips[inner]] - lead[strips[inner] - 1], reach)
        todo = np.flatnonzero(wanted != entry)
        entry = wanted
    return taken, used


def match_points(hits: DataFrame, truth: DataFrame, tolerance: int, keys: Sequence[str], nearest: bool = True, span: int = SPAN) -> DataFrame:
    """Matched pairs ``keys, true_pos, det_pos`` within the tolerance, each point used once.

    ``nearest``: every true point in order takes the nearest free hit, the smaller of two. Otherwise every hit in order
    takes the first free true point. Repeated points count once.
    """
    keys = list(keys)
    by = [*keys, "_blk"]
    lead, follow = (truth, hits) if nearest else (hits, truth)
    leaders = lead.select(*keys, "pos", F.lit(True).alias("_lead"), F.floor(F.col("pos") / F.lit(span)).cast("long").alias("_blk"))
    blocks = F.sequence(F.floor((F.col("pos") - tolerance) / F.lit(span)).cast("long"), F.floor((F.col("pos") + tolerance) / F.lit(span)).cast("long"))
    followers = follow.select(*keys, "pos", F.lit(False).alias("_lead"), F.explode(blocks).alias("_blk"))
    rows = materialise(leaders.unionByName(followers).distinct())
    kind = object if tolerance > 31 else np.uint64

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        pos, is_lead = pdf["pos"].to_numpy(np.int64), pdf["_lead"].to_numpy(bool)
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(pos)]))
        a, b = np.flatnonzero(is_lead), np.flatnonzero(~is_lead)
        wide = 4 * (span + tolerance)
        base = pdf["_blk"].to_numpy(np.int64) * span - 2 * tolerance
        place = group * wide + pos - base
        lo = np.searchsorted(place[b], place[a] - tolerance)
        hi = np.searchsorted(place[b], place[a] + tolerance, "right")
        sets = np.zeros(len(a), kind)
        for j in range(int((hi - lo).max(initial=0))):
            has = np.flatnonzero(lo + j < hi)
            bits = pos[b[lo[has] + j]] - (pos[a[has]] - tolerance)
            sets[has] |= np.array([1 << int(x) for x in bits], object) if kind is object else np.uint64(1) << bits.astype(np.uint64)
        first = np.flatnonzero(np.r_[True, np.diff(group[a]) != 0]) if len(a) else np.zeros(0, np.int64)
        last, mask = np.full(len(first), -(1 << 62), np.int64), np.zeros(len(first), kind)
        if "_last" in pdf and len(a):
            given = pdf.iloc[a[first]]
            has = np.flatnonzero(given["_used"].notna())
            last[has] = given["_last"].to_numpy(float)[has].astype(np.int64)
            mask[has] = [int(x) for x in given["_used"].to_numpy(object)[has]]
        taken, used = match_sets(pos[a], sets, first, tolerance, nearest, (last, mask)) if len(a) else (sets, sets)
        hit = np.flatnonzero(taken != 0)
        partner = pos[a[hit]] - tolerance + np.array([int(x).bit_length() - 1 for x in taken[hit]], np.int64)
        pairs = pdf.iloc[a[hit]][by].assign(a=pos[a[hit]], b=partner, used=None)
        ends = np.append(first[1:], len(a)) - 1 if len(a) else first
        exits = pdf.iloc[a[ends]][by].assign(a=pos[a[ends]], b=pos[a[first]], used=[str(int(x)) for x in used[ends]])
        return pd.concat([pairs, exits], ignore_index=True)

    schema = f"{_fields(rows, by)}, a long, b long, used string"
    given = None
    while True:
        joined = rows
        if given is not None:
            named = given.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_b"), "_last", "_used")
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            joined = rows.join(named, [*same, F.col("_blk") == F.col("_b")], "left").select(*rows.columns, "_last", "_used")
        done = materialise(_blocks(joined, by, run, schema))
        exits = done.where("used IS NOT NULL")
        # what the next block starts from, where its first leading point is in reach of what was used
        left = exits.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_blk") + 1).alias("_b"), F.col("a").alias("_last"), F.col("used").alias("_used"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        found = exits.join(left, [*same, F.col("_blk") == F.col("_b")]).where(F.col("b") - F.col("_last") <= 2 * tolerance).select(*by, "_last", "_used")
        found = materialise(found)
        before = given if given is not None else found.limit(0)
        if found.exceptAll(before).isEmpty():
            break
        given = found
    true_pos, det_pos = ("a", "b") if nearest else ("b", "a")
    return done.where("used IS NULL").select(*keys, F.col(true_pos).alias("true_pos"), F.col(det_pos).alias("det_pos"))
