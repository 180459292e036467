"""Ball hashing: fingerprints that are within a radius of each other meet at a common variant.

A pair at distance d has a variant about d/2 from either, so every fingerprint emits its ball
of half the radius. With radius 3 the halves are 1 and 2: parities of a pair at distance 3
differ, so fingerprints of odd parity emit radius 1 and those of even parity radius 2; of
three bits two lie in the same half of the bits, so pairs of bits within a half suffice.

Variants are dealt by their leading bits. A ball has few different leading bits, so a
fingerprint travels once for each of these and not once for each variant; the task that gets
it makes the variants that begin with its bits. Larger tables use more leading bits: what is
shuffled grows with the logarithm of their number, and a bucket stays as large as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np

#: Variants that a task holds at once; beyond it a bucket is parted by its next bits.
HELD = 3_000_000


def leading_bits(variants: float, least: int, most: int, held: int = HELD) -> int:
    """Leading bits with which about ``held`` of the variants fall into a bucket."""
    return int(min(most, max(least, np.ceil(np.log2(max(1.0, variants / held))))))


def reach_of(prints: np.ndarray, radius: int) -> np.ndarray:
    """Radius of each fingerprint's ball: half the radius, by parity where that is no whole number."""
    low = radius // 2
    if radius % 2 == 0:
        return np.full(len(prints), low, np.int8)
    return (low + 1 - (np.bitwise_count(prints) & 1)).astype(np.int8)


@lru_cache(maxsize=64)
def _masks(width: int, c: int, reach: int, used: int, halves: bool) -> np.ndarray:
    """Flips of the bits after the first ``c`` of ``width``, at most ``reach - used`` of them.

    With ``halves``, two flips (a leading one included) lie in the same half of the bits; the
    leading bits then all belong to the upper half.
    """
    one = [np.uint64(1) << np.uint64(i) for i in range(width - c)]
    out = [np.uint64(0)]
    for n in range(1, reach - used + 1):
        for at in combinations(range(width - c), n):
            upper = [i >= width // 2 for i in at] + [True] * used
            if not halves or n + used < 2 or len(set(upper)) == 1:
                out.append(np.bitwise_or.reduce([one[i] for i in at]))
    return np.array(out, np.uint64)


def deal(prints: np.ndarray, reach: np.ndarray, width: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, bucket) for each bucket that a fingerprint's ball has variants in."""
    head = (prints >> np.uint64(width - c)).astype(np.int64) if c else np.zeros(len(prints), np.int64)
    flips = [0, *(1 << i for i in range(c))]
    two = [1 << a | 1 << b for a, b in combinations(range(c), 2)] if (reach > 1).any() else []
    far = np.flatnonzero(reach > 1)
    who = np.concatenate([np.repeat(np.arange(len(prints)), len(flips)), np.repeat(far, len(two))])
    how = np.concatenate([np.tile(np.array(flips, np.int64), len(prints)), np.tile(np.array(two, np.int64), len(far))])
    return who, head[who] ^ how


def meet(prints: np.ndarray, reach: np.ndarray, width: int, c: int, bucket: int, halves: bool = False, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which, flips, group) of the fingerprints that meet at a variant of the bucket.

    ``group`` numbers the variants where two or more meet; rows are sorted by it. A bucket
    with more variants than ``held`` comes in several parts.
    """
    head = prints >> np.uint64(width - c) if c else np.zeros(len(prints), np.uint64)
    used = np.bitwise_count(head ^ np.uint64(bucket)).astype(np.int8)
    inside = np.flatnonzero(used <= reach)
    if len(inside) < 2:
        return
    kinds = [(r, u) for r in np.unique(reach[inside]).tolist() for u in range(r + 1)]
    rows = {k: inside[(reach[inside] == k[0]) & (used[inside] == k[1])] for k in kinds}
    sizes = {k: len(_masks(width, c, k[0], k[1], halves)) for k in kinds}
    if sum(len(rows[k]) * sizes[k] for k in kinds) > held and c < (width // 2 if halves else width):
        for bit in (0, 1):
            for which, flips, group in meet(prints[inside], reach[inside], width, c + 1, bucket << 1 | bit, halves, held):
                yield inside[which], flips, group
        return
    tail = prints & np.uint64((1 << (width - c)) - 1)
    who, how, variant = [], [], []
    for k in kinds:
        masks = _masks(width, c, k[0], k[1], halves)
        if len(rows[k]):
            who.append(np.repeat(rows[k], len(masks)))
            how.append(np.tile(np.bitwise_count(masks).astype(np.int8) + np.int8(k[1]), len(rows[k])))
            variant.append((tail[rows[k]][:, None] ^ masks[None, :]).ravel())
    who, how, variant = np.concatenate(who), np.concatenate(how), np.concatenate(variant)
    order = np.argsort(variant, kind="stable")
    same = variant[order][1:] == variant[order][:-1]
    kept = np.r_[same, False] | np.r_[False, same]
    which = order[kept]
    if len(which):
        group = np.cumsum(np.r_[False, variant[which][1:] != variant[which][:-1]])
        yield who[which], how[which], group
