"""Approximate nearest neighbours by cosine over multi-index hashed codes.

Codes: unit vectors, centred, times rotations learned by iterative
quantisation, one bit a coordinate; several rotations give a longer code. A
code is cut into 16-bit substrings, and a shard keeps, for each substring, its
rows bucketed by value. If two codes of s substrings differ in at most R bits,
some substring differs in at most R div s: probing every bucket within that of
the query's substring, in each of the s tables, meets every code within R.
Where there are more values to probe than buckets, the buckets are run through
instead. Candidates beyond R are dropped by their full distance, and the rest
ranked by cosine of the original vectors.

Rotations and R are fitted on a bounded sample: R is the distance within which
99 % of sample queries' neighbours in the sample lie. The whole table is
denser, so its neighbours are nearer. A query that finds fewer than k within R
is searched again without a radius.

Nulls: rows with a null id or vector, a zero vector, or a vector with a null
or non-finite component take no part. An empty table gives no rows. Ties go to
the smaller id; rows that repeat an id count once. A query meets vectors of
its own length only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import Scratch, hash_of
from hashloom.llm.vectors import by_length, search, top, usable

SAMPLE, BITS, PART, ROUNDS, COVER = 4096, 256, 16, 15, 0.99

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
POP16 = (_POP[:, None] + _POP[None, :]).reshape(-1)


class Codes:
    """Learned rotations of one vector length, and the radius that goes with them."""

    def __init__(self, x: np.ndarray, k: int, bits: int = BITS, seed: int = 7):
        rng, d = np.random.default_rng(seed), x.shape[1]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.mean, self.rotations = u.mean(0), []
        z = u - self.mean
        for _ in range(max(1, -(-bits // d))):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(ROUNDS):
                a, _, b = np.linalg.svd(np.sign(z @ r + 1e-300).T @ z)
                r = (a @ b).T
            self.rotations.append(r)
        self.parts = -(-d * len(self.rotations) // PART)
        self.radius = self._radius(u, k)

    def encode(self, u: np.ndarray) -> np.ndarray:
        """Substrings (rows x parts) of unit vectors, 16 bits each."""
        bits = np.concatenate([(u - self.mean) @ r > 0 for r in self.rotations], 1)
        bits = np.pad(bits, ((0, 0), (0, self.parts * PART - bits.shape[1])))
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)

    def _radius(self, u: np.ndarray, k: int) -> int:
        codes, found = self.encode(u), []
        for i in range(min(len(u), 256)):
            near = u @ u[i]
            near[i] = -2
            at = np.argsort(-near, kind="stable")[: min(k, len(u) - 1)]
            found.append(POP16[codes[at] ^ codes[i]].sum(1, dtype=np.int64))
        all_ = np.concatenate(found) if found else np.zeros(0)
        return int(np.quantile(all_, COVER)) if len(all_) else self.parts * PART


class MultiIndex:
    """Rows bucketed by each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, (self.n, self.parts) = codes, codes.shape
        self.rows, self.values, self.starts = [], [], []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.rows.append(order)
            self.values.append(values)
            self.starts.append(np.append(starts, self.n))

    def probe(self, part: int, value: int, within: int) -> np.ndarray:
        """Rows whose substring is within so many bits of value."""
        values, starts = self.values[part], self.starts[part]
        masks = _masks(within)
        if len(masks) < len(values):
            want = np.sort(masks ^ np.uint16(value))
            at = np.searchsorted(values, want)
            hit = at[(at < len(values))]
            hit = hit[values[hit] == want[: len(hit)]]
        else:
            hit = np.flatnonzero(POP16[values ^ np.uint16(value)] <= within)
        if not len(hit):
            return np.zeros(0, np.int64)
        if len(hit) == len(values):
            return self.rows[part]
        size = starts[hit + 1] - starts[hit]
        at = np.repeat(starts[hit] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.rows[part][at]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within radius."""
        if radius >= self.parts * PART:
            return np.arange(self.n)
        seen = np.zeros(self.n, bool)
        for part in range(self.parts):
            seen[self.probe(part, int(code[part]), radius // self.parts)] = True
        rows = np.flatnonzero(seen)
        return rows[POP16[self.codes[rows] ^ code].sum(1, dtype=np.int64) <= radius]


_MASKS: dict[int, np.ndarray] = {}


def _masks(within: int) -> np.ndarray:
    if within not in _MASKS:
        _MASKS[within] = np.flatnonzero(POP16 <= within).astype(np.uint16)
    return _MASKS[within]


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, bits: int = BITS, sample: int = SAMPLE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the k nearest rows found for
    every row of embeddings that is_query (a predicate on the column ``id``) selects."""
    spark, scratch = embeddings.sparkSession, Scratch(embeddings.sparkSession, "multi-index")
    rows = scratch.save(usable(embeddings, id_col, vector).where(F.exists("v", lambda x: x != 0)), "usable")
    fitted = rows.orderBy(hash_of("id"), "id").limit(sample).toPandas()
    learned = {n: Codes(x, k, bits) for n, (_, x) in by_length(fitted["id"].to_numpy(np.int64), list(fitted["v"])).items() if len(x) > k}
    codes = spark.sparkContext.broadcast(learned)

    def index_with(radius):
        def index(ids, x):
            u, book = x / np.linalg.norm(x, axis=1, keepdims=True), codes.value.get(x.shape[1])
            made = MultiIndex(book.encode(u)) if book is not None else None
            norms = np.sqrt(np.einsum("ij,ij->i", x, x))

            def find(queries, query_ids):
                coded = book.encode(queries / np.linalg.norm(queries, axis=1, keepdims=True)) if book is not None else None
                for i, qid in enumerate(query_ids):
                    at = np.arange(len(ids)) if book is None else made.within(coded[i], book.radius if radius is None else radius)
                    at = at[ids[at] != qid]
                    scores = np.einsum("ij,j->i", x[at], queries[i]) / (norms[at] * np.sqrt(queries[i] @ queries[i]))
                    best = top(ids[at], scores, k)
                    yield qid, at[best], scores[best]

            return find

        return index

    first = scratch.save(search(rows, is_query, k, index_with(None), "double", scratch, "all"), "first")
    found = first.groupBy("query_id").agg(F.count("*").alias("n"))
    short = rows.where(is_query).join(found, F.col("id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < k).select("id")
    if not short.take(1):
        return first
    again = scratch.save(short, "short")
    marked = rows.join(again.withColumn("again", F.lit(True)), "id", "left")
    rest = search(marked, is_query & F.col("again"), k, index_with(1 << 30), "double", scratch, "rest")
    return first.join(again.withColumnRenamed("id", "query_id"), "query_id", "left_anti").unionByName(rest)
