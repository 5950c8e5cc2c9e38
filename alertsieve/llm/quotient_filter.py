"""Counting quotient filters over whole keys, as compact tables that merge.

A key of ``width`` 64-bit limbs is permuted by an invertible mix. Its top bits name a shard, the next ``bits`` its quotient,
and all the rest is kept as the remainder, so a filter loses nothing and its keys can be read back. A filter holds its
items in the order of the permuted keys:

==========  ======================================================================================
runs        for each quotient a one per item and then a zero, as bits
remainders  the low bytes of the first limb and the other limbs of each item
counts      a counter per item, seven bits a byte, as many bytes as it needs
==========  ======================================================================================

As shards and filters are in the same order, filters of the same shard merge like sorted runs.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from alertsieve.llm.common import mix64

ROUNDS = 3
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _unmix64(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix64``."""

    def unshift(x: np.ndarray, s: int) -> np.ndarray:
        y = x
        for _ in range(64 // s):
            y = x ^ (y >> np.uint64(s))
        return y

    h = unshift(h, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = unshift(h, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return unshift(h, 30)


def _steps(width: int) -> list[tuple[int, np.uint64]]:
    return [(j % width, np.uint64((j + 1) * _STEP & _MASK)) for j in range(ROUNDS * width)]


def permute(keys: np.ndarray) -> np.ndarray:
    """A bijection of the rows of ``keys`` (items x limbs): one limb is mixed, several are mixed into each other in turn."""
    width = keys.shape[1]
    if width == 1:
        return mix64(keys + np.uint64(_STEP))
    out = keys.copy()
    for i, c in _steps(width):
        out[:, i] ^= mix64(out[:, i - 1] + c)
    return out


def restore(mixed: np.ndarray) -> np.ndarray:
    """The keys that ``permute`` made these of."""
    width = mixed.shape[1]
    if width == 1:
        return _unmix64(mixed) - np.uint64(_STEP)
    out = mixed.copy()
    for i, c in reversed(_steps(width)):
        out[:, i] ^= mix64(out[:, i - 1] + c)
    return out


def summed(mixed: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and the sums of their counts (of ones). Sorted runs in a row are merged."""
    if not len(mixed):
        return mixed, np.zeros(0, np.int64)
    width = mixed.shape[1]
    if width == 1 and counts is None:
        found, n = np.unique(mixed[:, 0], return_counts=True)
        return found[:, None], n
    order = np.argsort(mixed[:, 0], kind="stable") if width == 1 else np.lexsort(mixed.T[::-1])
    mixed = mixed[order]
    first = np.flatnonzero(np.concatenate([[True], (mixed[1:] != mixed[:-1]).any(axis=1)]))
    n = np.ones(len(mixed), np.int64) if counts is None else counts[order]
    return mixed[first], np.add.reduceat(n, first)


def _pack_counts(n: np.ndarray) -> bytes:
    size = np.ones(len(n), np.int64)
    for j in range(1, 9):
        size += n >= 1 << 7 * j
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for j in range(int(size.max(initial=0))):
        has = size > j
        out[starts[has] + j] = (n[has] >> 7 * j & 127) | np.where(size[has] > j + 1, 128, 0)
    return out.tobytes()


def _unpack_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    n = np.zeros(len(ends), np.int64)
    for j in range(int((ends - starts).max(initial=-1)) + 1):
        has = starts + j <= ends
        n[has] |= (raw[starts[has] + j] & 127).astype(np.int64) << 7 * j
    return n


def pack(mixed: np.ndarray, counts: np.ndarray, shard_bits: int) -> tuple[int, bytes, bytes, bytes]:
    """bits, runs, remainders, counts of the items of one shard, which are distinct and in order."""
    least = (64 - shard_bits) % 8  # so that remainders are whole bytes
    bits = least
    while bits + 8 <= 64 - shard_bits and 1 << bits + 8 <= 8 * len(mixed):
        bits += 8
    low = 64 - shard_bits - bits
    head = mixed[:, 0]
    quotients = (head >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) if bits else np.zeros(len(head), np.int64)
    runs = np.zeros(len(head) + (1 << bits), np.uint8)
    runs[quotients + np.arange(len(head))] = 1
    parts = [np.ascontiguousarray(head.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - low // 8 :]]
    parts += [np.ascontiguousarray(mixed[:, i].astype(">u8")).view(np.uint8).reshape(-1, 8) for i in range(1, mixed.shape[1])]
    return bits, np.packbits(runs).tobytes(), np.hstack(parts).tobytes(), _pack_counts(counts)


def unpack(width: int, shard: int, shard_bits: int, bits: int, runs: bytes, remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Items and counts of a filter."""
    n = _unpack_counts(counts)
    low = 64 - shard_bits - bits
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(runs, np.uint8), count=len(n) + (1 << bits)))
    quotients = (ones - np.arange(len(n))).astype(np.uint64)
    raw = np.frombuffer(remainders, np.uint8).reshape(len(n), low // 8 + 8 * (width - 1))
    wide = np.zeros((len(n), 8 * width), np.uint8)
    wide[:, 8 - low // 8 :] = raw
    mixed = wide.view(">u8").astype(np.uint64).reshape(len(n), width)
    top = np.uint64(shard << 64 - shard_bits & _MASK) if shard_bits else np.uint64(0)
    if bits:
        mixed[:, 0] |= quotients << np.uint64(low)
    mixed[:, 0] |= top
    return mixed, n


def merge(filters: Iterable[tuple[np.ndarray, np.ndarray]], room: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Items and summed counts of several filters. Filters wait until ``room`` items are there, so few are merged often."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for f in filters:
        held.append(f)
        size += len(f[1])
        if size > room and len(held) > 1:
            held = [_join(held)]
            size = 0  # counts what came since
    return _join(held)


def _join(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return held[0] if len(held) == 1 else summed(np.concatenate([m for m, _ in held]), np.concatenate([n for _, n in held]))


def by_shard(mixed: np.ndarray, counts: np.ndarray, shard_bits: int) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """The items of each shard, which are next to each other."""
    shards = mixed[:, 0] >> np.uint64(64 - shard_bits) if shard_bits else np.zeros(len(mixed), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else np.zeros(0, np.int64)
    for a, b in zip(first, [*first[1:], len(shards)]):
        yield int(shards[a]), mixed[a:b], counts[a:b]
