"""Hash-based randomness.

Every draw is a pure function of (seed, row key), so a result does not depend on
partitioning, retries or cluster size, and SQL engines can recompute it: the
uniform of lane ``i`` is the ``i``-th 32-bit word of ``md5('seed:key')`` / 2^32. Row draws
use the first 52 bits of the digest, so that every one of n < 2^52 rows can be drawn.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 4294967296.0
WIDE = 4503599627370496.0


def row_key(*cols: Column | str) -> Column:
    """One text key from several columns (integers and strings only)."""
    return F.concat_ws("-", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def digest(seed: str | int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def word(seed: str | int, key: Column, lane: int = 0) -> Column:
    """32 random bits as a non-negative long; ``lane`` is 0..3."""
    return F.conv(F.substring(digest(seed, key), 1 + 8 * lane, 8), 16, 10).cast("bigint")


def uniform(seed: str | int, key: Column, lane: int = 0) -> Column:
    """Uniform on [0, 1)."""
    return word(seed, key, lane) / F.lit(WORD)


def uniforms(seed: str | int, key: Column, n: int) -> Column:
    """Array of n uniforms on [0, 1): four from each digest."""
    def words(h: Column) -> Column:
        return F.array(*[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") / F.lit(WORD) for i in range(4)])

    # a value in a lambda is computed once
    blocks = [F.element_at(F.transform(F.array(digest(f"{seed}/{b}", key)), words), 1) for b in range(-(-n // 4))]
    every = F.concat(*blocks) if len(blocks) > 1 else blocks[0]
    return F.slice(every, 1, n) if n % 4 else every


def uniform_open(seed: str | int, key: Column, lane: int = 0) -> Column:
    """Uniform on (0, 1): half a step away from both ends."""
    return (word(seed, key, lane) + F.lit(0.5)) / F.lit(WORD)


def normal(seed: str | int, key: Column) -> Column:
    """Standard normal by Box-Muller on the first two lanes of one digest."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform_open(seed, key, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform_open(seed, key, 1))


def draw_index(seed: str | int, key: Column, n: int | Column) -> Column:
    """Uniform integer in [0, n), from the first 52 bits of the digest."""
    n = n if isinstance(n, Column) else F.lit(n)
    bits = F.conv(F.substring(digest(seed, key), 1, 13), 16, 10).cast("bigint")
    return F.floor(bits / F.lit(WIDE) * n).cast("bigint")


# ---- draws inside Python blocks ----------------------------------------------------------

# Shifts and multipliers of a published 32-bit integer mixer, and the start of the second chain.
MIX = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))
SECOND_CHAIN = 0x9E3779B9


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words; uint32 arithmetic wraps."""
    x = x.copy()
    moved = np.empty_like(x)
    for shift, factor in MIX:
        np.right_shift(x, np.uint32(shift), out=moved)
        x ^= moved
        if factor != 1:
            x *= np.uint32(factor)
    return x


class Counter:
    """Uniforms and normals that depend only on (seed, row, step, lane), whatever the block or order; SQL can recompute them.

    Two chains of 32-bit words each take in seed, low and high word of the row, and the counter
    step * lanes + lane. Rows beyond 2^32 differ in at least one chain but for a chance of 2^-64 a pair.
    """

    def __init__(self, seed: int, rows: np.ndarray, lanes: int):
        rows = np.asarray(rows, dtype=np.uint64)
        low, high = (rows & np.uint64(0xFFFFFFFF)).astype(np.uint32), (rows >> np.uint64(32)).astype(np.uint32)
        self.lanes = lanes
        self.base = [mixed(mixed(mixed(np.array([(seed & 0xFFFFFFFF) ^ start], dtype=np.uint32)) ^ low) ^ high) for start in (0, SECOND_CHAIN)]

    def uniform(self, step: int, lane: int, n: int, chain: int = 0) -> np.ndarray:
        """(rows, n) values in (0, 1) from lanes lane .. lane + n - 1."""
        at = np.arange(step * self.lanes + lane, step * self.lanes + lane + n).astype(np.uint32)
        # lanes are lines in memory; the quotient by a power of two is exact
        u = mixed(at[:, None] ^ self.base[chain][None, :]).astype(float)
        u += 0.5
        u *= 1.0 / WORD
        return u.T

    def normal(self, step: int, lane: int, n: int) -> np.ndarray:
        """(rows, n) standard normals, one of each pair of chains by Box-Muller."""
        radius, angle = np.log(self.uniform(step, lane, n)), 2.0 * math.pi * self.uniform(step, lane, n, 1)
        radius *= -2.0
        return np.sqrt(radius, out=radius) * np.cos(angle, out=angle)
