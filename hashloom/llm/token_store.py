"""Token ids in binary shards with a minimal perfect hash over document keys.

A shard is one file: the ids of its documents, raw and little-endian, then its
index, then a JSON footer with the place of each section.

    ids      u16 (u32 for vocabularies over 65,536), documents in order
    starts   u64 a document and one more: its first id, counted in the shard
    keys     i64 a document: its doc_id; documents without one come first
    bits     u64: the levels of the hash, each a set of bits
    ranks    u32 a word of bits: bits set before it
    prints   u32 a slot: fingerprint of the key that belongs there
    rows     u32 a slot: the first document with that key

A key hashes to one bit of the first level; keys that meet there go to the
next level. A key's slot is the rank of the first bit set for it, so n keys
fill n slots. A lookup reads a few bits, one rank and one fingerprint, then
the start and end of its ids, however large the shard is. Keys that are not
there fail on the fingerprint but for one in 2^32, and those on the key.

Shards hold consecutive key ranges, so the manifest (one row a shard) tells
which shard to ask. Files are written under a name of the attempt and renamed
once whole, so lost and repeated tasks leave one whole file a shard.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hashloom.llm.common import Scratch, pieces, text_bytes, tidy
from hashloom.llm.tokens import encoder

MAGIC = b"HLTOKEN1"
#: Bytes of text that go to a shard, on average.
SHARD_BYTES = 32 << 20
LEVEL_LOAD, LEVELS = 2.0, 60
BATCH = 2000


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """n distinct 64-bit keys to 0 .. n-1."""

    def __init__(self, sizes: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.firsts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, -(-int(len(left) * LEVEL_LOAD) // 64) * 64)
            at = (_mixed(left, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        flags = np.concatenate(levels) if levels else np.zeros(0, bool)
        per_word = flags.reshape(-1, 64).sum(1, dtype=np.int64)
        bits = np.packbits(flags, bitorder="little").view("<u8")
        return cls(sizes, bits, (np.cumsum(per_word) - per_word).astype("<u4"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where none can be."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.firsts[level] + (_mixed(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[at[hit] >> 6].astype(np.int64) + _ones(below)
            left = left[~hit]
        return out


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 0) >> np.uint64(32)).astype("<u4")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shard(path: str, batches) -> dict:
    """Writes (keys or None, list of id arrays) batches in key order; returns what the manifest needs."""
    files, place = _open(path)
    files.create_dir(place.rpartition("/")[0], recursive=True)
    mine = f"{place}.{uuid.uuid4().hex}"
    keys, sizes, nulls, crc, written, width = [], [], 0, 0, 0, 2
    with files.open_output_stream(mine) as out:
        for batch_keys, ids in batches:
            for key in batch_keys:
                nulls += key is None
                keys.append(0 if key is None else key)
            for x in ids:
                width = x.dtype.itemsize
                sizes.append(len(x))
            raw = b"".join(x.tobytes() for x in ids)
            crc, written = zlib.crc32(raw, crc), written + len(raw)
            out.write(raw)
        key = np.array(keys, dtype="<i8")
        distinct, first = np.unique(key[nulls:], return_index=True)
        table = PerfectHash.build(distinct)
        slots = table.slots(distinct)
        prints, rows = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
        prints[slots], rows[slots] = _prints(distinct), first + nulls
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        at, sections = written, {"ids": [0, written]}
        for name, x in (("starts", starts), ("keys", key), ("bits", table.bits), ("ranks", table.ranks), ("prints", prints), ("rows", rows)):
            raw = x.tobytes()
            out.write(raw)
            sections[name] = [at, len(raw)]
            at += len(raw)
        foot = json.dumps({"width": width, "nulls": nulls, "levels": table.sizes, "crc": crc, "sections": sections}).encode()
        out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
    files.move(mine, place)
    return {"first_key": int(key[nulls]) if len(key) > nulls else None, "last_key": int(key[-1]) if len(key) > nulls else None, "docs": len(key), "tokens": int(starts[-1])}


class Shard:
    """A shard file, opened for keyed and for ordered reading."""

    def __init__(self, path: str):
        files, place = _open(path)
        self.file = files.open_input_file(place)
        end = self.file.size()
        size, magic = struct.unpack("<Q8s", self._read(end - 16, 16))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        self.foot = json.loads(self._read(end - 16 - size, size))
        self.dtype = np.dtype("<u2" if self.foot["width"] == 2 else "<u4")
        part = lambda name, kind: np.frombuffer(self._read(*self.foot["sections"][name]), kind)
        self.starts, self.keys = part("starts", "<u8").astype(np.int64), part("keys", "<i8")
        self.prints, self.rows = part("prints", "<u4"), part("rows", "<u4")
        self.table = PerfectHash(self.foot["levels"], part("bits", "<u8"), part("ranks", "<u4"))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.keys)

    def key(self, row: int) -> int | None:
        return None if row < self.foot["nulls"] else int(self.keys[row])

    def ids(self, row: int, upto: int | None = None) -> np.ndarray:
        """The ids of a document, or of the documents from row up to another."""
        a, b = self.starts[row], self.starts[row + 1 if upto is None else upto]
        return np.frombuffer(self._read(int(a) * self.foot["width"], int(b - a) * self.foot["width"]), self.dtype)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 where there is none."""
        slots = self.table.slots(keys)
        hit = np.flatnonzero(slots >= 0)
        hit = hit[self.prints[slots[hit]] == _prints(keys[hit])]
        rows = self.rows[slots[hit]].astype(np.int64)
        true = self.keys[rows] == keys[hit]
        out = np.full(len(keys), -1, np.int64)
        out[hit[true]] = rows[true]
        return out


def write_tokens(docs: DataFrame, tokenizer: str, root: str, scratch: Scratch, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes docs (doc_id, text) into shards under root; returns the manifest:
    shard, path, first_key, last_key, docs, tokens, base (ids before the shard).

    Documents are ordered by doc_id, nulls first, then by text; null texts are
    empty. Every document ends with end_id. Equal ids may span shards.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(pieces(text_bytes(rows), shard_bytes), *order).sortWithinPartitions(*order, "text")

    @tidy
    def write(batches):
        from pyspark import TaskContext

        tokens, any_ = encoder(tokenizer), []

        def encoded():
            for pdf in batches:
                any_.append(len(pdf))
                end = np.array([end_id], tokens.dtype)
                for i in range(0, len(pdf), BATCH):
                    part = pdf.iloc[i : i + BATCH]
                    keys = [None if pd.isna(k) else int(k) for k in part["doc_id"]]
                    yield keys, [np.concatenate([x, end]) for x in tokens.encode(part["text"])]

        shard = TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:07d}.tok"
        made = write_shard(path, encoded())
        tokens.rest()
        if made["docs"]:
            out = pd.DataFrame([{"shard": shard, "path": path} | made])
            yield out.astype({"first_key": "Int64", "last_key": "Int64"})

    schema = "shard bigint, path string, first_key bigint, last_key bigint, docs bigint, tokens bigint"
    manifest = scratch.save(placed.mapInPandas(write, schema), "manifest")
    before = F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


def read_tokens(manifest: DataFrame, raw: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (over the ids as unsigned 32-bit
    little-endian) of every document in the shards, and its ids with raw.

    Each document with an id is fetched through the hash by its key; the row it
    gives must be the document's, or the first of those that share the id."""

    @tidy
    def read(batches):
        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"], strict=True):
                shard = Shard(path)
                nulls = shard.foot["nulls"]
                found = shard.find(shard.keys[nulls:])
                if not (shard.keys[found] == shard.keys[nulls:]).all() or (found < 0).any():
                    raise ValueError(f"the index of {path} misses keys")
                _, again = np.unique(shard.keys[nulls:], return_index=True)
                later = np.ones(len(found), np.int64)
                later[again] = 0
                # The n-th row of a key stands n rows after the row that the hash gives.
                nth = np.arange(len(found)) - np.maximum.accumulate(np.where(later == 0, np.arange(len(found)), 0))
                rows = np.concatenate([np.arange(nulls), found + nth])
                for i in range(0, len(rows), BATCH):
                    part, out = rows[i : i + BATCH], []
                    for row in part:
                        ids = shard.ids(int(row))
                        one = (shard.key(row), int(base + shard.starts[row]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        out.append((*one, ids.tolist()) if raw else one)
                    got = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * raw)
                    yield got.astype({"doc_id": "Int64"})

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * raw
    # One shard a task, as near as hashing comes to that.
    return manifest.repartition(manifest.count() or 1, "shard").mapInPandas(read, schema)


def lookup(manifest: DataFrame, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of the documents with the given keys, a few of them, on the driver."""
    out: dict[int, list[np.ndarray]] = {}
    for key in keys:
        for row in manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("shard").collect():
            shard = Shard(row["path"])
            at = int(shard.find(np.array([key], np.int64))[0])
            while 0 <= at < len(shard) and shard.key(at) == key:
                out.setdefault(key, []).append(shard.ids(at))
                at += 1
    return out
