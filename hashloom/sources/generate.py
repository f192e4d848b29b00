"""Deterministic synthetic relations.

The generator's state advances by a constant, so draw j of a seed is
mix64(seed + (j + 1) * GAMMA): each row is computed alone, on any executor.
Only the mt19937_64 stream has no such form: its state is moved on by the
driver, block by block, and the tasks draw from the states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.kernels import GAMMA, mix64
from hashloom.functions.u64 import lit64, signed, umod, wrapping

#: Fixed value: the second relation of a pair is drawn from seed ^ S_SEED.
S_SEED = 0xDEADEBDECDEEDEF1
DISTRIBUTIONS = ("uniform", "multiples", "step_skew", "heavy_skew")
#: Fixed values of step_skew: percent of the rows, and of the key space, in each tier.
TIERS = ((40, 5), (30, 15), (20, 30), (10, 50))
MULTIPLE = 1000
HEAVY_PERCENT = 50


def other_seed(seed: int) -> int:
    return seed ^ S_SEED


def _check(n: int, max_key: int) -> None:
    if n < 0 or not 0 <= max_key < 1 << 62:
        raise ValueError("n must not be negative, max_key in 0 .. 2^62-1")


def _draw(seed: int, j: Column) -> Column:
    return mix64(lit64(seed) + (j + 1) * lit64(GAMMA))


def one_draw(spark: SparkSession, n: int, seed: int, max_key: int) -> DataFrame:
    """id, key: uniform keys, one draw a record; max_key 0 gives key 0."""
    _check(n, max_key)
    with wrapping(spark):
        key = umod(_draw(seed, F.col("id")), max_key) if max_key else F.lit(0).cast("bigint")
        return spark.range(n).select("id", key.alias("key"))


def relation(spark: SparkSession, n: int, seed: int, max_key: int, distribution: str = "uniform") -> DataFrame:
    """id, key: two draws a record, a die and a value; max_key 0 keeps the value whole.

    An unknown distribution raises instead of falling back to uniform.
    """
    _check(n, max_key)
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {distribution!r}; one of {', '.join(DISTRIBUTIONS)}")
    with wrapping(spark):
        # A step of its own: the optimizer keeps it, so the draw is computed once
        # and not in every branch that uses it.
        drawn = spark.range(n).select("id", umod(_draw(seed, F.col("id") * 2), 100).alias("die"), _draw(seed, F.col("id") * 2 + 1).alias("value"))
        die, value = F.col("die"), F.col("value")
        key = value
        if distribution == "multiples":
            key = value - umod(value, MULTIPLE)
        elif distribution == "heavy_skew":
            key = F.when(die < HEAVY_PERCENT, lit64(max_key // 3)).otherwise(value)
        elif distribution == "step_skew":
            key = _tiers(die, value, max_key)
        if max_key and distribution != "step_skew":  # its tiers end at max_key
            key = umod(key, max_key)
        return drawn.select("id", key.alias("key"))


def _tiers(die: Column, value: Column, max_key: int) -> Column:
    widths = [max_key * share // 100 for _, share in TIERS[:-1]]
    widths.append(max_key - sum(widths))
    keys, ends, rows, base = [], [], 0, 0
    for (percent, _), width in zip(TIERS, widths, strict=True):
        keys.append(lit64(base) + (umod(value, width) if width else F.lit(0).cast("bigint")))
        rows, base = rows + percent, base + width
        ends.append(rows)
    # The last tier has no condition: a key that may be null would be computed
    # once more, in every branch, to filter the nulls.
    branch = keys[-1]
    for key, end in reversed(list(zip(keys[:-1], ends[:-1], strict=True))):
        branch = F.when(die < end, key).otherwise(branch)
    return branch


def sequential(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", F.col("id").alias("key"))


def multiples_of_64(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", ((F.col("id") + 1) * 64).alias("key"))


#: Twists of the mt19937_64 state (312 draws each) that one task row stands for.
MERSENNE_BLOCK = 4096
#: Draws at most: the states of all blocks come from one pass on the driver, and
#: some 20 KB of state go out for each 1.3 million draws.
MERSENNE_MOST = 1 << 34
_SIZE, _MIDDLE = 312, 156


def _first_state(seed: int):
    import numpy as np

    # Fixed values of the published mt19937_64 generator.
    whole, spread = (1 << 64) - 1, 6364136223846793005
    state = [seed & whole]
    for i in range(1, _SIZE):
        state.append((spread * (state[-1] ^ (state[-1] >> 62)) + i) & whole)
    return np.array(state, dtype=np.uint64)


def _twist(words) -> None:
    """The next state, in place."""
    import numpy as np

    # Fixed values of the published mt19937_64 generator.
    matrix, upper, lower = 0xB5026F5AA96619E9, 0xFFFFFFFF80000000, 0x7FFFFFFF
    one = np.uint64(1)

    def part(at: slice, after, far) -> None:
        x = (words[at] & np.uint64(upper)) | (after & np.uint64(lower))
        words[at] = far ^ (x >> one) ^ np.where(x & one, np.uint64(matrix), np.uint64(0))

    part(slice(0, _MIDDLE), words[1 : _MIDDLE + 1].copy(), words[_MIDDLE:].copy())
    part(slice(_MIDDLE, _SIZE - 1), words[_MIDDLE + 1 :].copy(), words[: _MIDDLE - 1].copy())
    part(slice(_SIZE - 1, _SIZE), words[:1].copy(), words[_MIDDLE - 1 : _MIDDLE].copy())


def _drawn(words, n: int):
    """The next n draws after a state, which is moved on, as signed 64-bit numbers."""
    import numpy as np

    # Fixed values of the published mt19937_64 generator.
    tempering = ((29, 0x5555555555555555, True), (17, 0x71D67FFFEDA60000, False), (37, 0xFFF7EEE000000000, False))
    out = np.empty(n, dtype=np.uint64)
    for begin in range(0, n, _SIZE):
        _twist(words)
        x = words.copy()
        for shift, mask, right in tempering:
            s = np.uint64(shift)
            x ^= ((x >> s) if right else (x << s)) & np.uint64(mask)
        x ^= x >> np.uint64(43)
        out[begin : begin + _SIZE] = x[: n - begin]
    return out.view(np.int64)


def mersenne_draws(seed: int, n: int):
    """The first n draws of mt19937_64, as signed 64-bit numbers."""
    return _drawn(_first_state(seed), n)


def mersenne_uniform(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, key: full-range keys. The driver only moves the state on from block to
    block; the draws are made by the tasks."""
    import numpy as np
    import pandas as pd

    if not 0 <= n <= MERSENNE_MOST:
        raise ValueError(f"n must be in 0 .. {MERSENNE_MOST}")
    block, words, states = MERSENNE_BLOCK * _SIZE, _first_state(seed), []
    for first in range(0, n, block):
        states.append((first, min(block, n - first), words.tobytes()))
        for _ in range(MERSENNE_BLOCK if first + block < n else 0):
            _twist(words)

    def draw(batches):
        for pdf in batches:
            for first, size, state in zip(pdf["first"], pdf["size"], pdf["state"], strict=True):
                yield pd.DataFrame({"id": np.arange(first, first + size), "key": _drawn(np.frombuffer(state, np.uint64).copy(), int(size))})

    rows = spark.createDataFrame(states, "first bigint, size bigint, state binary")
    return rows.repartition(max(1, len(states)), "first").mapInPandas(draw, "id bigint, key bigint")


def duplicates(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n keys dealt in turn from a pool of max(1, n / 1000) draws."""
    size = max(1, n // 1000)
    pool = mersenne_uniform(spark, size, seed).withColumnRenamed("id", "slot")
    return spark.range(n).withColumn("slot", F.col("id") % size).join(pool, "slot").select("id", "key")


def chunk_of(i: Column, n: int, chunks: int) -> Column:
    """The chunk of row i when n rows are cut evenly and the last chunk takes the rest."""
    width = max(1, n // chunks)
    return F.least(F.floor(i / width).cast("bigint"), F.lit(chunks - 1).cast("bigint"))


__all__ = ["chunk_of", "duplicates", "mersenne_draws", "mersenne_uniform", "multiples_of_64", "one_draw", "other_seed", "relation", "sequential", "signed"]
