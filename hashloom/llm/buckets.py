"""Members of buckets that links have left in several components, dealt to cells.

What is left to compare in a bucket are the pairs with an end outside its
largest component. Members of that component are dealt to chunks of bounded
load, and so are all others; each chunk of others meets each chunk of the
largest component in a cell of its own, and each chunk of others, itself
included. So every such pair meets in just one cell, however large the bucket
is, and a cell holds two chunks at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import Scratch, hash_of, small

CELL = ["key", "band", "a", "b"]


def cells(members: DataFrame, comps: DataFrame, chunk: int, scratch: Scratch | None = None) -> DataFrame:
    """key, band, a, b (the cell), id, comp and part of members (key, band, id, load)
    of buckets in several components, by comps (id, component; a member that is not
    in it is alone). Pairs to compare are those of different parts, and of the
    same part where ``own``."""
    known = members.join(comps.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    per = known.groupBy("key", "band", "comp").agg(F.count("*").alias("m"), F.sum("load").alias("w"))
    stats = per.groupBy("key", "band").agg(F.count("*").alias("comps"), F.max(F.struct("m", "comp", "w")).alias("most"), F.sum("w").alias("w")).where("comps > 1")
    chunks = lambda w: F.greatest(F.lit(1), F.ceil(w / chunk)).cast("int")
    stats = stats.select("key", "band", F.col("most.comp").alias("largest"), chunks(F.col("most.w")).alias("inner"), chunks(F.col("w") - F.col("most.w")).alias("outer"))
    # A table of its own, so that a large bucket's rows need not meet in one task.
    rows = known.join(small(scratch.save(stats, "cell-stats")) if scratch else stats, ["key", "band"]).withColumn("main", F.col("comp") == F.col("largest"))
    place = F.pmod(hash_of("id"), F.when(F.col("main"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    rows = rows.withColumn("place", place)
    every = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    with_main = F.transform(every(F.col("inner")), lambda b: cell(F.col("place"), b))
    with_others = F.transform(every(F.col("outer")), lambda x: cell(F.least(F.col("place"), x), F.col("inner") + F.greatest(F.col("place"), x)))
    at = F.when(F.col("main"), F.transform(every(F.col("outer")), lambda a: cell(a, F.col("place")))).otherwise(F.concat(with_main, with_others))
    dealt = rows.withColumn("at", F.explode(at)).select("key", "band", F.col("at.a").alias("a"), F.col("at.b").alias("b"), "id", "comp", F.when(F.col("main"), -1).otherwise(F.col("place")).alias("part"), "inner")
    return dealt.withColumn("own", F.col("b") == F.col("a") + F.col("inner")).drop("inner")


def groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of batches that are sorted by the given columns."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[by].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            part = pdf.iloc[a:b]
            if kept and (kept[-1][by].iloc[-1].to_numpy() != keys[a]).any():
                yield pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(part)
    if kept:
        yield pd.concat(kept) if len(kept) > 1 else kept[0]


def meetings(part: np.ndarray, comp: np.ndarray, own: bool) -> Iterator[tuple[int, np.ndarray]]:
    """A member of a cell and those of other components that it is compared with,
    so that each pair to compare comes once."""
    if own:
        for i in range(len(part)):
            rest = np.arange(i + 1, len(part))
            yield i, rest[comp[rest] != comp[i]]
        return
    few, many = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    if part.min() == part.max():
        return
    if len(few) > len(many):
        few, many = many, few
    for i in few.tolist():
        yield i, many[comp[many] != comp[i]]
