"""The partitioning pipeline: ids, histograms, offsets, cursors, slots, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hashloom.functions.kernels import exponent, fmix32, kernel
from hashloom.functions.u64 import shr, wrapping
from hashloom.sources.generate import chunk_of


def with_pid(df: DataFrame, key: str, p: int, hash: str = "murmur3_32", pid: str = "pid") -> DataFrame:
    """df with the partition id of each key in 0 .. p-1."""
    with wrapping(df.sparkSession):
        return df.withColumn(pid, kernel(hash)(F.col(key).cast("bigint"), p).cast("bigint"))


def dense(counts: DataFrame, p: int, key: str = "pid", n: str = "n") -> DataFrame:
    """counts with a row of 0 for every partition that has none."""
    ids = counts.sparkSession.range(p).withColumnRenamed("id", key)
    return ids.join(counts, key, "left").select(key, F.coalesce(n, F.lit(0)).alias(n))


def histogram(df: DataFrame, key: str, p: int, hash: str = "murmur3_32") -> DataFrame:
    """pid, n: rows of each of the p partitions, empty ones included."""
    return dense(with_pid(df, key, p, hash).groupBy("pid").agg(F.count("*").alias("n")), p)


def chunk_histogram(df: DataFrame, index: str, key: str, n: int, chunks: int, p: int) -> DataFrame:
    """chunk, pid, n: what each chunk of the input sends to each partition; no empty cells."""
    return with_pid(df, key, p).groupBy(chunk_of(F.col(index), n, chunks).alias("chunk"), "pid").agg(F.count("*").alias("n"))


def _before(n: str, window) -> Column:
    return F.coalesce(F.sum(n).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def offsets(hist: DataFrame) -> DataFrame:
    """pid, n, begin, end of each partition in the contiguous layout. The scan
    runs over p histogram rows, never over the data."""
    begin = _before("n", W.orderBy("pid"))
    return hist.select("pid", "n", begin.alias("begin"), (begin + F.col("n")).alias("end"))


def write_cursors(chunk_hist: DataFrame, hist: DataFrame) -> DataFrame:
    """chunk, pid, n, next: where each chunk's rows of a partition begin."""
    within = _before("n", W.partitionBy("pid").orderBy("chunk"))
    return chunk_hist.withColumn("within", within).join(offsets(hist).select("pid", "begin"), "pid").select("chunk", "pid", "n", (F.col("begin") + F.col("within")).alias("next"))


def scatter_slots(df: DataFrame, index: str, key: str, p: int, run: int = 1 << 20) -> DataFrame:
    """index, key, pid, slot: the stable contiguous position of every row.

    Rows are ranked within (pid, run of the dense index), so a hot partition is
    ranked by many tasks; the runs' starts come from their counts.
    """
    rows = with_pid(df.select(index, key), key, p).withColumn("run", F.floor(F.col(index) / run))
    counts = rows.groupBy("pid", "run").agg(F.count("*").alias("n"))
    within = _before("n", W.partitionBy("pid").orderBy("run"))
    begins = offsets(counts.groupBy("pid").agg(F.sum("n").alias("n"))).select("pid", "begin")
    # At most p rows, so they go to every task.
    start = counts.withColumn("within", within).join(F.broadcast(begins) if p <= 1 << 20 else begins, "pid").select("pid", "run", (F.col("begin") + F.col("within")).alias("start"))
    rank = F.row_number().over(W.partitionBy("pid", "run").orderBy(index)) - 1
    return rows.withColumn("rank", rank).join(start, ["pid", "run"]).select(index, key, "pid", (F.col("start") + F.col("rank")).alias("slot"))


def placed(df: DataFrame, key: str, p: int) -> DataFrame:
    """df with pid, where task pid holds exactly the rows of partition pid."""
    return with_pid(df, key, p).repartitionById(p, F.col("pid").cast("int"))


def layout(df: DataFrame, key: str, p: int) -> DataFrame:
    """pid, rows, all_same_task: whether the placement is the mapping."""
    spread = placed(df.select(key), key, p).withColumn("task", F.spark_partition_id())
    got = spread.groupBy("pid").agg(F.count("*").alias("n"), (F.max(F.col("task") == F.col("pid")) & F.min(F.col("task") == F.col("pid"))).alias("same"))
    ids = df.sparkSession.range(p).withColumnRenamed("id", "pid")
    return ids.join(got, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("rows"), F.coalesce("same", F.lit(True)).alias("all_same_task"))


def two_level(df: DataFrame, key: str, ranks: int, p_per_rank: int) -> DataFrame:
    """df with rank and pid, both from the top bits of one hash: within a rank
    the leading bits of pid are fixed, so most of its partitions stay empty."""
    a, b = exponent(ranks), exponent(p_per_rank)
    h = fmix32(F.col(key))
    top = lambda bits: shr(h, 32 - bits) if bits else F.lit(0).cast("bigint")
    with wrapping(df.sparkSession):
        return df.withColumns({"rank": top(a), "pid": top(b)})


def two_level_histogram(df: DataFrame, key: str, ranks: int, p_per_rank: int) -> DataFrame:
    """rank, pid, n: dense over all ranks and partitions."""
    got = two_level(df, key, ranks, p_per_rank).groupBy("rank", "pid").agg(F.count("*").alias("n"))
    cells = df.sparkSession.range(ranks * p_per_rank).select(F.floor(F.col("id") / p_per_rank).alias("rank"), (F.col("id") % p_per_rank).alias("pid"))
    return cells.join(got, ["rank", "pid"], "left").select("rank", "pid", F.coalesce("n", F.lit(0)).alias("n"))


def rank_exchange(df: DataFrame, index: str, key: str, n: int, ranks: int) -> DataFrame:
    """src, dst, n: rows that each input block sends to each rank."""
    src = chunk_of(F.col(index), n, ranks)
    return with_pid(df, key, ranks, pid="dst").groupBy(src.alias("src"), "dst").agg(F.count("*").alias("n"))
