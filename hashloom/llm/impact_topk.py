"""Exact top-k by inner product over an impact-ordered index.

Each component of a vector is a posting of its dimension. A shard keeps the
postings of every dimension sorted by value and cut into segments of one
quantised impact. For a query, a posting's impact is its product with the
query's component, less the smallest such product in the shard, so impacts are
never negative and a score only grows. Segments are processed by descending
greatest impact, whatever their dimension. At each check point a row's score
is bounded above by what it has plus, for each dimension in which its posting
is unread, the greatest impact still unread there. Once few rows can still
reach the k-th best score so far, the rest are proven out; the possible
members are scored exactly. If that never happens all segments are read.

Nulls: rows with a null id or vector, or a vector with a null or non-finite
component, take no part. An empty table gives no rows. Ties go to the smaller
id. Rows that repeat an id count once. A query meets the vectors of its own
length only. Components must stay below 2^26 in magnitude, so that integer
products and sums of up to 2^11 of them are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import Scratch
from hashloom.llm.vectors import search, top, usable

LEVELS = 8
CHECKS = (0.7, 0.85)


class ImpactIndex:
    """Postings of integer vectors (rows x dimensions) in segments of one quantised impact."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x, (self.n, self.d) = x, x.shape
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()
        self.columns = x.T.copy()
        self.values = np.take_along_axis(x, self.order.T, 0).T.copy()
        self.cuts = []
        for v in self.values:
            width = max(1, -(-(int(v[-1]) - int(v[0]) + 1) // levels))
            level = (v - v[0]) // width
            self.cuts.append(np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [self.n]]))

    def segments(self, q: np.ndarray):
        """Dimension, begin, end and greatest impact of each segment, by descending impact."""
        out = []
        for j in np.flatnonzero(q):
            cuts, v, w = self.cuts[j], self.values[j], int(q[j])
            base = w * int(v[0] if w > 0 else v[-1])
            edge = v[cuts[1:] - 1] if w > 0 else v[cuts[:-1]]
            out.append(np.stack([np.full(len(edge), j), cuts[:-1], cuts[1:], edge * w - base], 1))
        all_ = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return all_[np.argsort(-all_[:, 3], kind="stable")]

    def possible(self, acc: np.ndarray, q: np.ndarray, unread: dict[int, tuple[int, int]], k: int) -> np.ndarray:
        """Rows that can still be among the k best. unread: by dimension, the
        greatest unread impact and the outermost unread value."""
        least = np.partition(acc, self.n - k)[self.n - k]
        # Rows that could not get there if all that is unread were theirs need no bound of their own.
        rows = np.flatnonzero(acc + sum(most for most, _ in unread.values()) >= least)
        bound = acc[rows]
        for j, (most, edge) in unread.items():
            column = self.columns[j][rows]
            bound += np.where(column <= edge if q[j] > 0 else column >= edge, most, 0)
        return rows[bound >= least]

    def search(self, q: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of the k best rows, and how many segments were read."""
        k = min(k, self.n)
        segments = self.segments(q)
        acc, read = np.zeros(self.n, np.int64), 0
        stops = {int(len(segments) * c) for c in CHECKS}
        members = None
        for i, (j, a, b, _) in enumerate(segments):
            if i in stops and i:
                unread = {}
                for jj, aa, bb, most in segments[i:]:
                    if jj not in unread:
                        unread[jj] = most, self.values[jj][bb - 1 if q[jj] > 0 else aa]
                found = self.possible(acc, q, unread, k)
                if len(found) <= max(4 * k, self.n // 16):
                    members = found
                    break
            w, v = q[j], self.values[j]
            acc[self.order[j, a:b]] += v[a:b] * w - w * (v[0] if w > 0 else v[-1])
            read += 1
        if members is None:
            members = np.flatnonzero(acc >= np.partition(acc, self.n - k)[self.n - k])
        scores = self.x[members] @ q
        best = top(ids[members], scores, k)
        return members[best], scores[best], read


def impact_top_k(embeddings: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (the integer inner product of components
    floor(scale * x)) for every row of embeddings that is_query (a predicate on
    the column ``id``) selects, against all other rows."""
    rows = usable(embeddings, id_col, vector)

    def index(ids, x):
        made = ImpactIndex(np.floor(x * scale).astype(np.int64))

        def find(queries, query_ids):
            for qid, q in zip(query_ids, np.floor(queries * scale).astype(np.int64)):
                at, scores, _ = made.search(q, k + 1, ids)
                yield qid, at, scores

        return find

    return search(rows, is_query, k, index, "bigint", Scratch(embeddings.sparkSession, "impact"), "all")
