"""How evenly keys are spread."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.u64 import to_text
from hashloom.operators.partition import histogram, with_pid


def hash_quality(df: DataFrame, key: str, p: int, hash: str) -> DataFrame:
    """overload, cv: largest partition over the mean, and the population
    coefficient of variation, empty partitions counted. Nulls for no rows."""
    h = histogram(df, key, p, hash).agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"))
    mean = F.nullif(F.col("rows"), F.lit(0)) / F.lit(p)
    cv = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / p - mean * mean)) / mean
    return h.select(F.round(F.col("most") / mean, 6).alias("overload"), F.round(cv, 6).alias("cv"))


def partition_checksum(df: DataFrame, key: str, p: int, hash: str = "murmur3_32") -> DataFrame:
    return with_pid(df, key, p, hash).agg(to_text(F.coalesce(F.sum("pid"), F.lit(0))).alias("checksum"))


def load_imbalance(df: DataFrame, key: str, ranks: int) -> DataFrame:
    """max_rows, mean_rows, imbalance (their difference) over ranks."""
    h = histogram(df, key, ranks).agg(F.max("n").alias("max_rows"), (F.sum("n") / F.lit(ranks)).alias("mean_rows"))
    return h.select("max_rows", F.round("mean_rows", 6).alias("mean_rows"), F.round(F.col("max_rows") - F.col("mean_rows"), 6).alias("imbalance"))


def linear_bin(c, bins: int, max_key: int):
    """floor(c * bins / max_key), the last bin at most."""
    return F.least(F.floor(c * bins / F.lit(max_key)).cast("bigint"), F.lit(bins - 1).cast("bigint"))


def key_bins(df: DataFrame, key: str, bins: int, max_key: int) -> DataFrame:
    """bin, n over non-empty bins."""
    return df.groupBy(linear_bin(F.col(key).cast("bigint"), bins, max_key).alias("bin")).agg(F.count("*").alias("n"))


def binned_csv(distributions: dict[str, DataFrame], path: str, bins: int, max_key: int) -> None:
    """A CSV of BinID and one column of counts a distribution."""
    out = next(iter(distributions.values())).sparkSession.range(bins).withColumnRenamed("id", "BinID")
    for name, df in distributions.items():
        out = out.join(key_bins(df, "key", bins, max_key).select(F.col("bin").alias("BinID"), F.col("n").alias(name)), "BinID", "left")
    out.na.fill(0).orderBy("BinID").coalesce(1).write.mode("overwrite").csv(path, header=True)


def partition_bins(distributions: dict[str, DataFrame], p: int) -> DataFrame:
    """PartitionID and one column of counts a distribution, all p partitions."""
    spark = next(iter(distributions.values())).sparkSession
    out = spark.range(p).withColumnRenamed("id", "PartitionID")
    for name, df in distributions.items():
        counts = with_pid(df, "key", p).groupBy(F.col("pid").alias("PartitionID")).agg(F.count("*").alias(name))
        out = out.join(counts, "PartitionID", "left")
    return out.na.fill(0)


def partition_csv(distributions: dict[str, DataFrame], path: str, p: int) -> None:
    """partition_bins as a CSV in order of PartitionID."""
    partition_bins(distributions, p).orderBy("PartitionID").coalesce(1).write.mode("overwrite").csv(path, header=True)


def hash_throughput(spark: SparkSession, hashes: list[str], sizes: list[int], p: int = 1 << 20, runs: int = 7, clock: Callable[[], float] = time.perf_counter) -> list[dict]:
    """N, HashFunction, Throughput_MOps (of the median time of so many runs) and
    StdDev_ms of mapping N keys to p partitions, for each hash and size."""
    out = []
    for n in sizes:
        for name in hashes:
            took = []
            for _ in range(runs):
                began = clock()
                with_pid(spark.range(n), "id", p, name).agg(F.sum("pid")).collect()
                took.append(clock() - began)
            out.append({"N": n, "HashFunction": name, "Throughput_MOps": round(n / statistics.median(took) / 1e6, 3), "StdDev_ms": round(statistics.pstdev(took) * 1e3, 3)})
    return out


def throughput_csv(spark: SparkSession, measured: list[dict], path: str) -> None:
    spark.createDataFrame(measured).select("N", "HashFunction", "Throughput_MOps", "StdDev_ms").coalesce(1).sortWithinPartitions("N", "HashFunction").write.mode("overwrite").csv(path, header=True)


def partition_dump(df: DataFrame, index: str, key: str, p: int, path: str, rows: int = 10_000) -> None:
    """The partition ids of the first rows, one a line."""
    first = with_pid(df, key, p).orderBy(index).limit(rows)
    first.orderBy(index).select(F.col("pid").cast("string")).coalesce(1).write.mode("overwrite").text(path)
