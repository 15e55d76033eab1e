"""Counting quotient filters over 64-bit fingerprints, in numpy.

A filter covers the fingerprints of one shard (their leading bits).  The next
``q`` bits are the quotient and name a home slot; the remaining bits are the
remainder.  Remainders of one quotient form a run, runs are stored in quotient
order, each slot as near to its home as earlier runs allow.  Two bits per slot
(occupied: some fingerprint has this quotient; run end: the run stops here)
recover every quotient, so the filter is lossless and two filters merge by
merging their sorted remainders.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<BBI"


def quotient_bits(distinct: int) -> int:
    """Bits that keep the load of the home slots at three quarters or less."""
    return max(3, int(np.ceil(np.log2(max(1, distinct) / 0.75))))


def build(prints: np.ndarray, counts: np.ndarray, shard_bits: int) -> bytes:
    """Serialise sorted distinct ``prints`` (uint64, one shard) with ``counts``."""
    n = len(prints)
    q = quotient_bits(n)
    r = 64 - shard_bits - q
    own = prints << np.uint64(shard_bits) if shard_bits else prints
    quotients = (own >> np.uint64(64 - q)).astype(np.int64)
    remainders = prints & np.uint64((1 << r) - 1)
    # A slot is its home, or the next free one: position minus index never falls.
    index = np.arange(n)
    slots = np.maximum.accumulate(quotients - index) + index
    size = max(1 << q, int(slots[-1]) + 1 if n else 0)
    occupied, ends, used = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
    occupied[quotients] = True
    used[slots] = True
    last = np.ones(n, bool)
    last[:-1] = quotients[1:] != quotients[:-1]
    ends[slots[last]] = True
    width = 8 - (64 - r) // 8
    body = remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    # Counters: one byte per slot, with the rare large ones spelled out behind.
    large = counts >= 255
    return b"".join(
        [
            struct.pack(_HEAD, q, width, size),
            *(np.packbits(bits).tobytes() for bits in (occupied, ends, used)),
            struct.pack("<II", n, int(large.sum())),
            body.tobytes(),
            np.where(large, 255, counts).astype(np.uint8).tobytes(),
            counts[large].astype("<i8").tobytes(),
        ]
    )


def read(data: bytes, shard: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts that ``build`` was given."""
    q, width, size = struct.unpack_from(_HEAD, data)
    at, packed = struct.calcsize(_HEAD), -(-size // 8)
    bits = []
    for _ in range(3):
        bits.append(np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=size).astype(bool))
        at += packed
    occupied, ends, used = bits
    n, n_large = struct.unpack_from("<II", data, at)
    at += 8
    body = np.zeros((n, 8), np.uint8)
    body[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", n_large, at + n)
    # The k-th run belongs to the k-th occupied quotient.
    closed = np.cumsum(ends[used])
    run = np.concatenate([[0], closed[:-1]]) if n else closed
    quotients = np.flatnonzero(occupied)[run].astype(np.uint64)
    r = 64 - shard_bits - q
    prints = (quotients << np.uint64(r)) | body.view("<u8").ravel()
    if shard_bits:
        prints |= np.uint64(shard) << np.uint64(64 - shard_bits)
    return prints, counts


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted fingerprints of one shard, two runs at a time: equal ones add their counts."""
    runs = [f for f in filters if len(f[0])] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    while len(runs) > 1:
        runs.sort(key=lambda f: -len(f[0]))
        runs.append(_merge_two(runs.pop(), runs.pop()))
    return runs[0]


def _merge_two(small: tuple[np.ndarray, np.ndarray], large: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    prints, counts = large[0], large[1].copy()
    at = np.searchsorted(prints, small[0])
    known = prints[np.minimum(at, len(prints) - 1)] == small[0]
    counts[at[known]] += small[1][known]
    new = ~known
    return np.insert(prints, at[new], small[0][new]), np.insert(counts, at[new], small[1][new])


def merge_filters(filters: list[bytes], shard: int, shard_bits: int) -> bytes:
    """One filter that holds what ``filters`` of the same shard hold, by merging their sorted remainders."""
    return build(*merge([read(f, shard, shard_bits) for f in filters]), shard_bits)
