"""Times the headline queries and prints one JSON line.

Published times leave out the generation of data, so the generated relations are
held in memory before their joins are timed; ``phases`` splits one of them."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hashloom.operators import join as J
from hashloom.operators import partition as P
from hashloom.operators import stats as S
from hashloom.plans.catalog import QUERIES
from hashloom.sources import generate as G

RUNS = 3
#: Counting by key has a fast table of 2^16 keys by default; the large joins have 500,000.
AGGREGATE = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
HEADLINE = ("join_checksums", "join_count", "join_partitioned", "join_shuffle_hash", "join_sort_merge", "join_skew_salted", "join_two_level", "join_per_partition", "partition_histogram", "write_cursors", "scatter_slots", "rank_exchange", "hash_quality_murmur3_32")


def timed(job) -> float:
    """Median seconds of some runs."""
    seconds = []
    for _ in range(RUNS):
        began = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - began)
    return round(statistics.median(seconds), 4)


def held(spark, n: int, seed: int, max_key: int, kind: str | None):
    """The keys of a relation, in memory."""
    made = G.one_draw(spark, n, seed, max_key) if kind is None else G.relation(spark, n, seed, max_key, kind)
    made = made.select("key").persist()
    made.count()
    return made


def pairs() -> dict[str, tuple]:
    """Rows of both sides, seed, greatest key, distribution."""
    out = {"join_15m_16m": (15_000_000, 16_000_000, 47, 65_400, None)}
    out |= {f"join_5m_{k}": (5_000_000, 5_000_000, 42, 50_000, k) for k in G.DISTRIBUTIONS}
    return out | {"join_25m_uniform": (25_000_000, 25_000_000, 42, 250_000, "uniform"), "join_50m_uniform": (50_000_000, 50_000_000, 42, 500_000, "uniform"), "join_50m_heavy_skew": (50_000_000, 50_000_000, 42, 500_000, "heavy_skew")}


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config(AGGREGATE, "20").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {n: timed(lambda n=n: QUERIES[n](spark, sf)) for n in HEADLINE}
    phases = {}
    for name, (nr, ns, seed, top, kind) in pairs().items():
        r, s = held(spark, nr, seed, top, kind), held(spark, ns, G.other_seed(seed), top, kind)
        took[name] = timed(lambda r=r, s=s: J.join_checksums(r, s))
        if name == "join_50m_uniform":
            phases = {"histogram": timed(lambda r=r: P.histogram(r, "key", 2048)), "count_r": timed(lambda r=r: J.multiplicity(r)), "count_s": timed(lambda s=s: J.multiplicity(s)), "all": took[name]}
        r.unpersist()
        s.unpersist()
    took["partition_mapping_100m"] = timed(lambda: P.with_pid(spark.range(100_000_000), "id", 1 << 20).agg(F.sum("pid")))
    throughput = S.hash_throughput(spark, ["modulo", "fibonacci", "murmur3_64", "murmur3_32"], [10_000_000], runs=RUNS)
    print(json.dumps({"metric": "headline queries, median of 3, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "phases": phases, "throughput_mops": {x["HashFunction"]: x["Throughput_MOps"] for x in throughput}, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
