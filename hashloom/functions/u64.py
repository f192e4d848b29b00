"""Unsigned 64-bit arithmetic on Spark's signed BIGINT.

Bits are kept in two's complement, so equality, xor, and, +, * and << agree
with unsigned arithmetic. Order, remainder and right shift need the helpers
here. + and * only wrap with ANSI mode off; the mode is captured when a
DataFrame is built, so plans are built inside ``wrapping(spark)``, which gives
the session its setting back.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_ANSI = "spark.sql.ansi.enabled"


@contextmanager
def wrapping(spark: SparkSession):
    """Build plans whose BIGINT arithmetic wraps modulo 2^64."""
    before = spark.conf.get(_ANSI)
    spark.conf.set(_ANSI, "false")
    try:
        yield
    finally:
        spark.conf.set(_ANSI, before)


def signed(value: int) -> int:
    """The signed 64-bit number with the bits of value modulo 2^64."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def lit64(value: int) -> Column:
    return F.lit(signed(value)).cast("bigint")


def shr(c: Column, n: int) -> Column:
    """Logical shift right. Java masks the count, so n must be below 64."""
    if not 0 <= n < 64:
        raise ValueError("shift out of range")
    return F.shiftrightunsigned(c, n) if n else c


def umod(c: Column, m: int) -> Column:
    """Unsigned remainder, for 0 < m < 2^62."""
    if not 0 < m < 1 << 62:
        raise ValueError("modulus must be in 1 .. 2^62-1")
    if m & (m - 1) == 0:
        return c.bitwiseAND(lit64(m - 1))
    half = F.pmod(shr(c, 1), lit64(m))
    return (half * 2 + c.bitwiseAND(lit64(1))) % lit64(m)


def to_text(c: Column) -> Column:
    """Unsigned decimal digits."""
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)").cast("string")
