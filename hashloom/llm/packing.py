"""Packing documents into windows by lexical retrieval.

Documents are encoded once and written as ids, with how many documents have
each term (token id). Then they are dealt to shards of bounded size so that
related ones meet: by two weighted min-hashes of their terms, rarer terms
weighing more, as ranges of the sorted order, so that a hot key spans as many
tasks as it needs. A shard keeps a BM25 inverted index over the terms of its
documents, with the document frequencies and mean length of the whole corpus.
A seed document opens a window, and the index returns its unused neighbours by
descending score, which fill the window greedily. The neighbour that does not
fit whole is cut: its first ids close the window, and what is left of it seeds
the next one. A seed without neighbours goes on with the next unused document.
Documents of a window or more fill windows of their own first, and only their
rest is packed. What is unused at the end of a shard is carried to the next
shard of the task; at the end of the task the last, short window is cut at
powers of two, which are not padded. So all windows are full.

A byte-pair vocabulary numbers its tokens about by falling frequency, so the
logarithm of the number is the weight of a term in the min-hashes.

Ties in the order go to the id and a hash of the ids, so reruns agree. Nulls:
a null text is empty; a document without ids is its end id alone; null ids are
carried. Rows that repeat an id are documents of their own. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import Scratch, pieces, tidy
from hashloom.llm.tokens import encoder

WINDOW, SHARD_DOCS, SHARD_IDS, TASK_IDS = 2048, 512, 1 << 20, 12 << 20
K1, B = 1.2, 0.75
#: Terms in more than one of so many documents have their weights in rows of all documents.
DENSE = 16
#: Ids of a document from which its terms are counted apart.
LONG = 1 << 17
#: Texts that are encoded in one go.
DOCS = 2000


def term_order(vocabulary: int, turn: int) -> np.ndarray:
    """For each term its place in a random order in which rarer terms come first
    more often: the least place of a document's terms is a weighted min-hash."""
    draws = np.random.default_rng([20240517, turn]).random(vocabulary)
    order = np.argsort(-np.log(draws) / np.log(np.arange(vocabulary) + 4.0), kind="stable")
    place = np.empty(vocabulary, np.int32)
    place[order] = np.arange(vocabulary, dtype=np.int32)
    return place


def counted(ids: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of all distinct terms, by document and term."""
    out, at = [], 0
    while at < len(ids):
        if len(ids[at]) >= LONG:
            n = np.bincount(ids[at], minlength=vocabulary)
            term = np.flatnonzero(n).astype(np.int32)
            out.append((np.full(len(term), at, np.int32), term, n[term].astype(np.int32)))
            at += 1
            continue
        end, size = at, 0
        while end < len(ids) and len(ids[end]) < LONG and (end - at + 1) * vocabulary < 1 << 31:
            size, end = size + len(ids[end]), end + 1
        part = ids[at:end]
        whole = np.repeat(np.arange(len(part), dtype=np.int32) * vocabulary, [len(x) for x in part]) + np.concatenate(part).astype(np.int32)
        whole.sort()
        first = np.flatnonzero(np.diff(whole, prepend=-1))
        pair = whole[first]
        out.append((pair // vocabulary + at, pair % vocabulary, np.diff(np.append(first, len(whole))).astype(np.int32)))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int32),) * 3


class Corpus:
    """What BM25 needs of all documents: their number, mean length, and how many have each term."""

    def __init__(self, documents: int, ids: int, df: np.ndarray):
        self.mean = max(ids / max(documents, 1), 1.0)
        self.idf = np.log(1 + (documents - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.vocabulary = len(df)


class Index:
    """BM25 over the ids of some documents of a corpus; given the size of a
    vocabulary in its place, the documents are the corpus."""

    def __init__(self, ids: list[np.ndarray], corpus: Corpus | int):
        n, vocabulary = len(ids), corpus if isinstance(corpus, int) else corpus.vocabulary
        doc, term, tf = counted(ids, vocabulary)
        df = np.bincount(term, minlength=vocabulary)
        if isinstance(corpus, int):
            corpus = Corpus(n, sum(map(len, ids)), df)
        sizes = np.fromiter(map(len, ids), np.float32, n)
        norm = (K1 * (1 - B + B * sizes / corpus.mean)).astype(np.float32)
        self.n, self.df = n, df
        weight = corpus.idf[term] * tf * np.float32(K1 + 1) / (tf + norm[doc])
        # By document, a seed's terms; by term, the postings.
        self.terms = term
        self.rows = np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.docs, self.scores = doc[order], weight[order]
        self.posts = np.concatenate([[0], np.cumsum(df)])
        often = np.flatnonzero(df * DENSE > n)
        self.row = np.full(vocabulary, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        place = self.row[term]
        self.dense[place[place >= 0], doc[place >= 0]] = weight[place >= 0]

    def neighbours(self, seed: int) -> np.ndarray:
        """BM25 score of each document for all terms of the seed that others share."""
        terms = self.terms[self.rows[seed] : self.rows[seed + 1]]
        terms = terms[self.df[terms] > 1]
        row = self.row[terms]
        out = self.dense[row[row >= 0]].sum(0, dtype=np.float32)
        terms = terms[row < 0]
        size = self.df[terms]
        at = np.arange(size.sum()) + np.repeat(self.posts[terms] - np.cumsum(size) + size, size)
        out += np.bincount(self.docs[at], self.scores[at], self.n).astype(np.float32)
        return out


class Packer:
    """Documents in, pieces out: (document, start, length, sequence, offset)."""

    def __init__(self, first: int, window: int = WINDOW):
        self.sequence, self.window = first, window
        self.keys, self.ids, self.start = [], [], []  # what is not packed yet
        self.out: list[tuple] = []
        self.room, self.offset = window, 0

    def _put(self, i: int, n: int) -> None:
        ids, a = self.ids[i], self.start[i]
        self.out.append((self.keys[i], a, n, zlib.crc32(ids[a : a + n].astype("<u4").tobytes()), len(ids), self.sequence, self.offset, ids[a : a + n]))
        self.start[i] += n
        self.offset += n
        self.room -= n
        if not self.room:
            self.sequence, self.room, self.offset = self.sequence + 1, self.window, 0

    def left(self, i: int) -> int:
        return len(self.ids[i]) - self.start[i]

    def pack(self, keys: list, ids: list[np.ndarray], corpus: Corpus) -> None:
        """Packs a shard; less than a window may be left unpacked."""
        self.keys, self.ids, self.start = self.keys + keys, self.ids + ids, self.start + [0] * len(ids)
        n = len(self.ids)
        for i in range(n):
            while self.left(i) >= self.window:
                self._put(i, self.window)
        unused = np.array([self.left(i) > 0 for i in range(n)])
        total = sum(self.left(i) for i in range(n))
        index = Index(self.ids, corpus)
        queue = iter(sorted(range(n), key=lambda i: (-self.left(i), i)))
        seed = None
        while total >= self.window:
            if seed is None:
                seed = next(i for i in queue if unused[i])
            scores = index.neighbours(seed)
            unused[seed] = False
            scores[~unused] = 0
            total -= self.room
            self._put(seed, self.left(seed))
            near, seed = iter(self._ranked(scores)), None
            while self.offset:
                i = next(near, None)
                i = next(i for i in queue if unused[i]) if i is None else i
                take = min(self.room, self.left(i))
                self._put(i, take)
                if self.left(i):
                    seed = i
                else:
                    unused[i] = False
        rest = [i for i in range(n) if self.left(i)]
        self.keys, self.ids, self.start = ([x[i] for i in rest] for x in (self.keys, self.ids, self.start))

    @staticmethod
    def _ranked(scores: np.ndarray):
        """Positions by descending score, lazily: mostly a few are asked for."""
        while True:
            i = int(scores.argmax())
            if scores[i] <= 0:
                return
            scores[i] = 0
            yield i

    def close(self) -> None:
        """Packs what is left into sequences of powers of two."""
        total, i = sum(map(self.left, range(len(self.ids)))), 0
        while total:
            self.room = self.window if total >= self.window else 1 << (total.bit_length() - 1)
            total -= self.room
            goal = self.sequence
            while self.sequence == goal:
                while not self.left(i):
                    i += 1
                self._put(i, min(self.room, self.left(i)))
            self.room = self.window


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n and ids of each document, and the two keys and the tie that order
    it; rows without ids hold in how many documents of a task each term is."""

    @tidy
    def each(batches):
        tokens = encoder(tokenizer)
        vocabulary = tokens.lib.get_vocab_size()
        first, second = term_order(vocabulary, 0), term_order(vocabulary, 1)
        end, df = np.array([end_id], tokens.dtype), np.zeros(vocabulary, np.int64)
        for pdf in batches:
            for i in range(0, len(pdf), DOCS):
                part = pdf.iloc[i : i + DOCS]
                ids = [np.concatenate([x, end]) for x in tokens.encode(part["text"])]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat, at = np.concatenate(ids), np.cumsum(sizes) - sizes
                df += np.bincount(counted(ids, vocabulary)[1], minlength=vocabulary)
                raw = [x.tobytes() for x in ids]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "n": sizes, "ids": raw,
                    "k1": np.minimum.reduceat(first[flat], at), "k2": np.minimum.reduceat(second[flat], at), "tie": list(map(zlib.crc32, raw)),
                }).assign(terms=None, df=None)
        term = np.flatnonzero(df)
        yield pd.DataFrame({"doc_id": [None], "n": [0], "ids": [None], "k1": [0], "k2": [0], "tie": [0], "terms": [term], "df": [df[term]]})
        tokens.rest()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(each, "doc_id bigint, n bigint, ids binary, k1 int, k2 int, tie bigint, terms array<bigint>, df array<bigint>")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every
    piece of docs (doc_id, text), and with ids the piece's ids, little-endian and
    of 16 bits each (32 for vocabularies over 65,536)."""
    spark = docs.sparkSession
    tokens = encoder(tokenizer)
    vocabulary, kind = tokens.lib.get_vocab_size(), tokens.dtype.str
    saved = Scratch(spark, "packing").save(encoded(docs, tokenizer, end_id), "encoded", "snappy")
    # At most one row a term of the vocabulary.
    told = saved.where("ids is null").select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df")).toPandas()
    df = np.zeros(vocabulary, np.int64)
    df[told["term"].to_numpy(np.int64)] = told["df"].to_numpy(np.int64)
    rows = saved.where("ids is not null")
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    corpus = spark.sparkContext.broadcast(Corpus(documents, total, df))
    order = ["k1", "k2", "tie", "doc_id"]
    dealt = rows.repartitionByRange(pieces(total, TASK_IDS), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    @tidy
    def each(batches):
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 32)

        def flush():
            out, packer.out = packer.out, []
            pdf = pd.DataFrame([x[:7] for x in out], columns=columns).astype({"doc_id": "Int64"})
            return pdf.assign(ids=[x[7].tobytes() for x in out]) if ids else pdf

        keys, held, n = [], [], 0
        for pdf in batches:
            for k, raw in zip(pdf["doc_id"], pdf["ids"], strict=True):
                keys.append(None if pd.isna(k) else int(k))
                held.append(np.frombuffer(raw, kind))
                n += len(held[-1])
                if len(keys) == SHARD_DOCS or n >= SHARD_IDS:
                    packer.pack(keys, held, corpus.value)
                    yield flush()
                    keys, held, n = [], [], 0
        if keys:
            packer.pack(keys, held, corpus.value)
            yield flush()
        packer.close()
        yield flush()

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * ids
    return dealt.mapInPandas(each, schema)
