"""The inner equi-join over keys with duplicates on both sides, reduced to its
count and two order-free checksums.

The pairs are never built: each side is first counted by key, which the map
side does in part, so a hot key costs one row a task; the join then meets at
most one row a key from each side. The other forms exist to compare plans and
to check this one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.kernels import GAMMA, splitmix64
from hashloom.functions.u64 import lit64, to_text, wrapping
from hashloom.operators.partition import placed, two_level, with_pid

HINTS = {"shuffle_hash": "shuffle_hash", "sort_merge": "merge", "broadcast": "broadcast"}


def multiplicity(df: DataFrame, key: str = "key", n: str = "n") -> DataFrame:
    """key, n: the rows of each key."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("key")).agg(F.count("*").alias(n))


def probe(build: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """key, n: each probing row's multiplicity in build, 0 if it has none."""
    return keys.select(F.col(key).cast("bigint").alias("key")).join(build, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def _sums(pairs: DataFrame, times: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Count and checksums of pairs, in which a row stands for ``times`` matches."""
    key = F.col("key")
    with wrapping(pairs.sparkSession):
        return (pairs.groupBy(*by) if by else pairs.groupBy()).agg(
            F.coalesce(F.sum(times), F.lit(0)).alias("join_count"),
            F.coalesce(F.sum(splitmix64(key) * times), F.lit(0)).alias("c1"),
            F.coalesce(F.sum(splitmix64(key.bitwiseXOR(lit64(GAMMA))) * times), F.lit(0)).alias("c2"),
        )


def _again(parts: DataFrame) -> DataFrame:
    """The sums of parts' sums."""
    with wrapping(parts.sparkSession):
        return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("join_count", "c1", "c2")))


def _as_text(sums: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return sums.select(*by, "join_count", to_text(F.col("c1")).alias("checksum1"), to_text(F.col("c2")).alias("checksum2"))


def _reduced(pairs: DataFrame, times: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return _as_text(_sums(pairs, times, by), by)


def _counts(r: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    return multiplicity(r, n="cr"), multiplicity(s, n="cs"), F.col("cr") * F.col("cs")


def join_checksums(r: DataFrame, s: DataFrame) -> DataFrame:
    """join_count, checksum1, checksum2 of r and s joined on key."""
    a, b, times = _counts(r, s)
    return _reduced(a.join(b, "key"), times)


def join_hinted(r: DataFrame, s: DataFrame, strategy: str) -> DataFrame:
    """The same with one of Spark's strategies asked for by a hint. For
    broadcast the counts of r go to every executor: ask for it where the
    distinct keys of r are known to be few."""
    if strategy not in HINTS:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(HINTS)}")
    a, b, times = _counts(r, s)
    return _reduced(a.hint(HINTS[strategy]).join(b, "key"), times)


def join_per_partition(r: DataFrame, s: DataFrame, p: int) -> DataFrame:
    """pid, join_count, checksum1, checksum2 of every partition that has matches."""
    a, b, times = _counts(r, s)
    return _reduced(with_pid(a.join(b, "key"), "key", p), times, ("pid",))


def join_partitioned(r: DataFrame, s: DataFrame, p: int) -> DataFrame:
    """The join with both sides placed by partition id: task pid joins pair pid,
    and no further exchange stands below the final sum."""
    a, b, times = _counts(r, s)
    both = placed(a, "key", p).hint("shuffle_hash").join(placed(b, "key", p), ["pid", "key"])
    return _reduced(both, times)


def join_two_level(r: DataFrame, s: DataFrame, ranks: int, p_per_rank: int) -> DataFrame:
    """The join reduced within each (rank, pid) first, then over all. Both follow
    from the key, so the sides meet on the key, as they are counted."""
    a, b, times = _counts(r, s)
    cells = _sums(two_level(a.join(b, "key"), "key", ranks, p_per_rank), times, ("rank", "pid"))
    return _as_text(_again(cells))


def join_skew_salted(r: DataFrame, s: DataFrame, salts: int = 16) -> DataFrame:
    """The join on raw probing rows, as when they carry a payload: s is salted,
    and each counted key of r is repeated once a salt, so a hot key of s is
    probed by many tasks."""
    if salts < 1:
        raise ValueError("salts must be positive")
    build = multiplicity(r, n="cr").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = s.where(F.col("key").isNotNull()).select(F.col("key").cast("bigint").alias("key"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    return _reduced(rows.join(build, ["key", "salt"]), F.col("cr"))


def join_naive(r: DataFrame, s: DataFrame, most: int = 500) -> DataFrame:
    """Every pair compared, for checking; refuses more than ``most`` rows a side.

    The equality is written as two inequalities, as Catalyst would turn it into
    an equi-join."""
    a, b = r.select(F.col("key").cast("bigint").alias("key")), s.select(F.col("key").cast("bigint").alias("other"))
    if a.limit(most + 1).count() > most or b.limit(most + 1).count() > most:
        raise ValueError(f"the naive join takes at most {most} rows a side")
    return _reduced(a.join(b, (F.col("key") <= F.col("other")) & (F.col("key") >= F.col("other"))), F.lit(1).cast("bigint"))


def skewed_partitions(r: DataFrame, s: DataFrame, p: int, factor: int = 3) -> DataFrame:
    """pid, r_size, s_size of partitions where either side is beyond factor *
    (rows of s div p), the limit that s sets for both."""
    size = lambda df, n: with_pid(multiplicity(df), "key", p).groupBy("pid").agg(F.sum("n").alias(n))
    both = _ids(s, p).join(size(r, "r_size"), "pid", "left").join(size(s, "s_size"), "pid", "left").na.fill(0)
    limit = s.where(F.col("key").isNotNull()).agg((F.floor(F.count("*") / p) * factor).alias("most"))
    return both.crossJoin(F.broadcast(limit)).where((F.col("s_size") > F.col("most")) | (F.col("r_size") > F.col("most"))).select("pid", "r_size", "s_size")


def _ids(df: DataFrame, p: int) -> DataFrame:
    return df.sparkSession.range(p).withColumnRenamed("id", "pid")
