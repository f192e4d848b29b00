"""Hash kernels as Column expressions; all but TEA stay inside codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hashloom.functions.u64 import lit64, shr, umod

# Fixed values of the published hash functions.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
FIBONACCI = 11400714819323198485
FMIX64_1 = 0xFF51AFD7ED558CCD
FMIX64_2 = 0xC4CEB9FE1A85EC53
FMIX32_1 = 0x85EBCA6B
FMIX32_2 = 0xC2B2AE35
TEA_DELTA = 0x9E3779B9
TEA_KEY = (0xA56BAB10, 0x00112233, 0x44556677, 0x8899AABB)
MASK32 = 0xFFFFFFFF


def exponent(p: int) -> int:
    """log2 of a partition count; ValueError unless it is a power of two below 2^32."""
    if not isinstance(p, int) or p < 1 or p & (p - 1) or p >= 1 << 32:
        raise ValueError(f"partition count must be a power of two below 2^32, not {p}")
    return p.bit_length() - 1


def _fold(c: Column, n: int) -> Column:
    return c.bitwiseXOR(shr(c, n))


def mix64(c: Column) -> Column:
    """The splitmix64 finaliser. Needs wrapping()."""
    return _fold(_fold(_fold(c, 30) * lit64(MIX_1), 27) * lit64(MIX_2), 31)


def splitmix64(c: Column) -> Column:
    return mix64(c + lit64(GAMMA))


def _mul32(h: Column, m: int) -> Column:
    """Product modulo 2^32 of a masked h, in 16-bit limbs that never overflow."""
    low, high = h * F.lit(m & 0xFFFF), (h * F.lit(m >> 16)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK32))


def fmix32(c: Column) -> Column:
    """A 64-bit key folded to 32 bits and finalised; unsigned, in a BIGINT."""
    h = _fold(c.cast("bigint"), 32).bitwiseAND(F.lit(MASK32))
    return _fold(_mul32(_fold(_mul32(_fold(h, 16), FMIX32_1), 13), FMIX32_2), 16)


def _top(h: Column, bits: int, width: int) -> Column:
    return shr(h, width - bits) if bits else F.lit(0).cast("bigint")


def hash_modulo(c: Column, p: int) -> Column:
    exponent(p)
    return umod(c, p)


def hash_bitwise_and(c: Column, p: int) -> Column:
    exponent(p)
    return c.bitwiseAND(F.lit(p - 1).cast("bigint"))


def hash_fibonacci(c: Column, p: int) -> Column:
    """Needs wrapping()."""
    return _top(c * lit64(FIBONACCI), exponent(p), 64)


def hash_murmur3_64(c: Column, p: int) -> Column:
    """Needs wrapping()."""
    return _top(_fold(_fold(_fold(c, 33) * lit64(FMIX64_1), 33) * lit64(FMIX64_2), 33), exponent(p), 64)


def hash_murmur3_32(c: Column, p: int) -> Column:
    """The default partition mapping."""
    return _top(fmix32(c), exponent(p), 32)


def hash_tea(c: Column, p: int) -> Column:
    """Eight TEA rounds on both halves. A fold over half rounds keeps the
    expression small; it runs interpreted, so this one is slow."""
    bits = exponent(p)

    def half(v: Column, other: Column, j: Column, k: tuple[int, int]) -> Column:
        total = (F.lit(TEA_DELTA) * F.floor((j + 1) / 2).cast("bigint")).bitwiseAND(F.lit(MASK32))
        add = (F.shiftleft(other, 4) + F.lit(k[0])).bitwiseXOR(other + total).bitwiseXOR(F.shiftright(other, 5) + F.lit(k[1]))
        return (v + add.bitwiseAND(F.lit(MASK32))).bitwiseAND(F.lit(MASK32))

    def step(a: Column, j: Column) -> Column:
        return F.when(j % 2 == 1, F.array(half(a[0], a[1], j, TEA_KEY[:2]), a[1])).otherwise(F.array(a[0], half(a[1], a[0], j, TEA_KEY[2:])))

    start = F.array(c.bitwiseAND(F.lit(MASK32)), shr(c, 32))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, step)
    return _top(done[1], bits, 32)


KERNELS: dict[str, Callable[[Column, int], Column]] = {
    "modulo": hash_modulo,
    "bitwise_and": hash_bitwise_and,
    "fibonacci": hash_fibonacci,
    "murmur3_32": hash_murmur3_32,
    "murmur3_64": hash_murmur3_64,
    "tea": hash_tea,
}


def kernel(name: str) -> Callable[[Column, int], Column]:
    if name not in KERNELS:
        raise ValueError(f"unknown hash {name!r}; one of {', '.join(KERNELS)}")
    return KERNELS[name]
