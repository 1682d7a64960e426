"""Seeded hashes: every random choice of the library is a function of a row key and a seed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the multiplicative ("minimal standard") generator: a prime and a primitive root.
PRIME = 2147483647
ROOT = 48271
SALT = 15485863  # another prime


def shuffle_key(key: Column, seed: int = 0, salt: Column | int = 0) -> Column:
    """Spread an integer key over [0, PRIME) with plain arithmetic, so any SQL engine can repeat it.

    The square breaks the lattice on which the multiplication alone would keep neighbouring keys.
    ``salt`` gives further orders of the same keys.
    """
    salted = key.cast("bigint") + F.lit(seed * 7919 + 1)
    if not isinstance(salt, int) or salt:
        salted = salted + (F.lit(salt) if isinstance(salt, int) else salt) * SALT
    first = F.pmod(F.pmod(salted, F.lit(PRIME)) * ROOT, F.lit(PRIME))
    return F.pmod(first * first, F.lit(PRIME))


ROUNDS = 24


def permuted(rank: Column, size: Column | int, seed: int, salt: Column | int) -> Column:
    """A keyed bijection on [0, size): where ``rank`` goes in the permutation named by ``seed`` and ``salt``.

    Every round pairs each number with its mirror image about a round key and swaps the pair or leaves it, by a hash of
    its larger member. So a row's place in any number of orders is arithmetic on its rank: no sort, no
    further ranking, any size, and every SQL engine can repeat it.
    """
    size, base = F.lit(size).cast("bigint"), F.lit(salt).cast("bigint") * ROUNDS

    def swap(at: Column, number: Column) -> Column:
        # Keys of rounds come from hashes below zero, which no pair can have.
        mirror = F.pmod(shuffle_key(F.lit(-1), seed, base + number) - at, size)
        odd = F.pmod(shuffle_key(F.greatest(at, mirror), seed, base + number), F.lit(2)) == 1
        return F.when(odd, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), rank.cast("bigint"), swap)


def _shuffle_keys(salted: np.ndarray) -> np.ndarray:
    first = salted % PRIME * ROOT % PRIME
    return first * first % PRIME


def permuted_of(rank: np.ndarray, size: int, seed: int, salt: np.ndarray) -> np.ndarray:
    """``permuted`` on arrays: (ranks x salts), ``salt`` being one row of salts for each rank."""
    distinct, at_salt = np.unique(salt, return_inverse=True)
    at_salt, shift = at_salt.reshape(salt.shape), seed * 7919 + 1
    at = np.broadcast_to(rank[:, None], salt.shape).astype(np.int64)
    for number in range(ROUNDS):
        salts = (distinct * ROUNDS + number) * SALT + shift
        # ``np.remainder`` has the sign of the divisor, as ``pmod``.
        mirror = (_shuffle_keys(salts - 1)[at_salt] - at) % size
        odd = _shuffle_keys(np.maximum(at, mirror) + salts[at_salt]) & 1
        at = np.where(odd, mirror, at)
    return at


def unit_uniform(*parts: Column) -> Column:
    """A double in [0, 1) from the 53 top bits of a 64-bit hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def poisson_one(uniform: Column) -> Column:
    """A Poisson(1) draw by inversion: the bootstrap multiplicity of a row.

    The 53 bits of a uniform tell counts up to 18 apart; anything above would be rounded to 1.
    """
    density, total = 0.36787944117144233, 0.36787944117144233  # exp(-1)
    draw = F.when(uniform < total, 0)
    for count in range(1, 19):
        density /= count
        total += density
        draw = draw.when(uniform < total, count)
    return draw.otherwise(19)


# The same on arrays, for draws inside tasks. The constants are those of xxHash64.
XX1, XX2, XX3, XX4, XX5 = (np.uint64(v) for v in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64_next(hashed: np.ndarray, value: int, is_int: bool) -> np.ndarray:
    """``xxhash64(..., value)`` from ``xxhash64(...)``, for a value that Spark holds as an int or a bigint."""
    with np.errstate(over="ignore"):
        x = hashed.astype(np.int64).view(np.uint64) + XX5 + np.uint64(4 if is_int else 8)
        if is_int:
            x = _turned(x ^ (np.array([value & 0xFFFFFFFF], np.uint64) * XX1), 23) * XX2 + XX3
        else:
            x = _turned(x ^ (_turned(np.array([value & 0xFFFFFFFFFFFFFFFF], np.uint64) * XX2, 31) * XX1), 27) * XX1 + XX4
        x = (x ^ (x >> np.uint64(33))) * XX2
        x = (x ^ (x >> np.uint64(29))) * XX3
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def unit_uniform_of(hashed: np.ndarray) -> np.ndarray:
    """``unit_uniform`` from the hash."""
    return (hashed.view(np.uint64) >> np.uint64(11)) / float(1 << 53)


def poisson_one_of(uniform: np.ndarray) -> np.ndarray:
    density, totals = 0.36787944117144233, [0.36787944117144233]
    for count in range(1, 19):
        density /= count
        totals.append(totals[-1] + density)
    return np.searchsorted(totals, uniform, side="right")
