"""Searching a set of stated queries against all vectors, in shards and blocks.

Queries are written to the shared folder in blocks of bounded size. A task
takes a shard of a bounded number of rows, builds its index once, and runs all
blocks through it, one after the other as it reads them; the shard gives back
its best k a query. All of it is one job, without a loop on the driver or a
broadcast that grows with the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hashloom.llm.common import Scratch, hash_of, pieces, runs, tidy

QUERY_BLOCK, SHARD_ROWS = 2048, 16384


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part: an id, a vector, no
    null and no non-finite component. Of rows that repeat an id, the smallest
    vector stands."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.coalesce(ok, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))


def by_length(ids: np.ndarray, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = ids[at], np.array([vectors[i] for i in at], dtype=np.float64).reshape(len(at), n)
    return out


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _blocks(path: str) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The blocks of queries that were written to path, each by length."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path)
    for info in sorted(files.get_file_info(fs.FileSelector(place)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            for batch in pq.ParquetFile(files.open_input_file(info.path)).iter_batches(QUERY_BLOCK):
                yield by_length(batch["id"].to_numpy(), batch["v"].to_pylist())


def search(rows: DataFrame, is_query: Column, k: int, index: Callable, score_type: str, scratch: Scratch, name: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query.

    index(ids, matrix) makes a search over one shard of vectors of one length:
    a function of (queries, query_ids) that yields (query_id, positions, scores).
    Positions may include the query's own row, which is dropped here, so it
    should give k + 1."""
    schema = f"query_id bigint, vec_id bigint, score {score_type}"
    saved = scratch.save(rows, f"{name}-rows")
    queries = saved.where(is_query).select("id", "v")
    n, q = saved.count(), queries.count()
    table = f"{name}-queries"
    scratch.save(queries.repartition(pieces(q, QUERY_BLOCK), hash_of("id", F.lit("block"))), table)
    path = scratch.path(table)

    @tidy
    def each(batches):
        for pdf in runs(batches, SHARD_ROWS):
            made = {length: (ids, index(ids, x)) for length, (ids, x) in by_length(pdf["id"].to_numpy(np.int64), list(pdf["v"])).items()}
            for block in _blocks(path):
                a, b, c = [], [], []
                for length, (qids, qx) in block.items():
                    ids, find = made.get(length, (None, None))
                    for qid, at, scores in find(qx, qids) if find else ():
                        own = ids[at] != qid
                        a.append(np.full(int(own.sum()), qid))
                        b.append(ids[at][own])
                        c.append(scores[own])
                if a:
                    yield pd.DataFrame({"query_id": np.concatenate(a), "vec_id": np.concatenate(b), "score": np.concatenate(c)})

    found = saved.select("id", "v").repartition(pieces(n, SHARD_ROWS), hash_of("id")).mapInPandas(each, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
