"""HyperMinHash sketches: per bucket the leading-zero count of the smallest hash and some bits of its mantissa.

A sketch has ``passes`` independent hash functions; each splits the shingles into ``2**BUCKET_BITS`` buckets and
keeps the smallest remaining hash of each bucket as a 16-bit register: 6 bits of leading-zero count and
``MANTISSA_BITS`` bits that follow the first one.  An empty bucket takes the register of the next full bucket of
the same pass (rotation densification), so that small sets can be banded too.
"""

from __future__ import annotations

import numpy as np

from weftgraph.llm.shingles import mix

_U = np.uint64
BUCKET_BITS = 3
MANTISSA_BITS = 10


def sketch(value: np.ndarray, starts: np.ndarray, passes: int) -> np.ndarray:
    """Registers (uint16) of every text: an array of texts x (passes * buckets). A text without shingles has 0s."""
    n, buckets = len(starts) - 1, 1 << BUCKET_BITS
    out = np.zeros((n, passes * buckets), np.uint16)
    owner = np.repeat(np.arange(n, dtype=np.int64) * buckets, np.diff(starts))
    for p in range(passes):
        h = mix(value + _U((0xA0761D6478BD642F * (p + 1)) % (1 << 64)))
        low = np.full(n * buckets, np.iinfo(np.uint64).max, _U)
        np.minimum.at(low, owner + (h >> _U(64 - BUCKET_BITS)).astype(np.int64), h << _U(BUCKET_BITS))
        out[:, p * buckets : (p + 1) * buckets] = _densify(_registers(low), low.reshape(n, buckets))
    return out


def _registers(low: np.ndarray) -> np.ndarray:
    # the leading-zero count from the exponent of the (inexact, hence halved first) float; the mantissa from the bits
    x = low >> _U(11)  # 53 bits: exact as a float
    exponent = np.frexp(x.astype(np.float64))[1]  # bits in use, 0 for 0
    zeros = np.minimum(53 - exponent, 53)
    aligned = np.where(exponent > 0, x << np.minimum(zeros, 52).astype(_U), _U(0))
    mantissa = (aligned >> _U(52 - MANTISSA_BITS)) & _U((1 << MANTISSA_BITS) - 1)
    return ((zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)) + np.uint16(1)


def _densify(registers: np.ndarray, low: np.ndarray) -> np.ndarray:
    buckets = low.shape[1]
    registers = registers.reshape(low.shape).copy()
    empty = low == np.iinfo(np.uint64).max
    registers[empty] = 0
    if empty.any():
        rows = np.flatnonzero(empty.any(1) & ~empty.all(1))
        sub, hole = registers[rows], empty[rows]
        for step in range(1, buckets):
            from_, full = np.roll(sub, -step, 1), ~np.roll(empty[rows], -step, 1)
            take = hole & full
            sub[take] = from_[take]
            hole &= ~take
        registers[rows] = sub
    return registers


def band_columns(width: int, bands: int, rows: int) -> np.ndarray:
    """Which registers make up each band: bands x rows, chosen by a fixed generator, without repeats in a band."""
    order = np.random.default_rng(20240229)
    return np.stack([np.sort(order.choice(width, rows, replace=False)) for _ in range(bands)])


def band_keys(registers: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """One 64-bit key (as int64) per text and band; the band's number is part of the key."""
    keys = np.repeat(np.arange(1, len(columns) + 1, dtype=_U)[None, :], len(registers), 0)
    for r in range(columns.shape[1]):
        keys = mix(keys * _U(0x9FB21C651E98DF25) + registers[:, columns[:, r]].astype(_U))
    return keys.view(np.int64)


def chance_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The expected share of registers that agree by chance for disjoint sets of n and m shingles: within a
    leading-zero level the minimum falls evenly on the mantissa's cells."""
    per = float(1 << BUCKET_BITS)
    n, m = np.maximum(np.asarray(n, float) / per, 1e-9)[:, None], np.maximum(np.asarray(m, float) / per, 1e-9)[:, None]
    level = np.arange(1, 54)[None, :]
    inside = lambda c: (1 - 2.0**-level) ** c - (1 - 2.0 ** (1 - level)) ** c
    return np.sum(inside(n) * inside(m), axis=1) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard estimate corrected for chance collisions: J + (1 - J) * EC of the registers agree."""
    share = (a == b).mean(axis=1)
    chance = chance_collisions(n, m)
    return np.clip((share - chance) / (1 - chance), 0, 1)
