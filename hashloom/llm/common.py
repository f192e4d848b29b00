"""What several operators share: words, shared folders, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_DIR = "spark.checkpoint.dir"


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8. bytes.split() and
    bytes.lower() know ASCII only, which is just what WORD asks for."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it
    is unset, as in a local test, is a temporary folder set in its place; on a
    cluster that is an error, as executors would not find each other's files."""
    found = spark.conf.get(_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_DIR} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="hashloom-")
        spark.conf.set(_DIR, found)
    return found


class Scratch:
    """Tables of one run of an operator in the shared folder. A table written
    there cuts the lineage and outlives the executors that made it. Results read
    from these tables, so they stay until the application ends, or swept() says
    that no pending result needs them."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/hashloom-{name}-{uuid.uuid4().hex}"
        self.used = False
        Scratch.made.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, compression: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(table))
        if not self.used:
            self.used = True
            path, files = self._at(self.root)
            files.deleteOnExit(path)
        return self.load(table, df.schema)

    def load(self, table: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table))

    def _at(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *tables: str) -> None:
        """Only for tables that no pending result reads."""
        for table in tables:
            path, files = self._at(self.path(table))
            files.delete(path, True)

    @classmethod
    @contextlib.contextmanager
    def swept(cls):
        """Deletes what the operators called within have written for themselves, which
        nothing may read later."""
        before = list(cls.made)
        yield
        for scratch in [x for x in cls.made if x not in before]:
            if scratch.used:
                path, files = scratch._at(scratch.root)
                files.delete(path, True)
            cls.made.remove(scratch)


def release(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files of plans that nothing refers to any more,
    which it else does whenever the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df, marked for broadcasting if its rows are counted at so many bytes at most:
    16 a column, and what strings, binaries and arrays hold. df is best a saved table."""
    held = [F.octet_length(f"`{c}`") if t in ("string", "binary") else F.greatest(F.size(f"`{c}`"), F.lit(0)) * 8 for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    row = sum((F.coalesce(x, F.lit(0)) for x in held), F.lit(16 * (1 + len(df.columns))))
    size = df.agg(F.coalesce(F.sum(row.cast("bigint")), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= most else df


def semi_join(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of df whose key is in ids (distinct, with that one column). ids
    are broadcast if they are small, and shuffled beyond."""
    return df.join(small(ids), on, "left_semi")


#: Bytes that an Arrow batch to a Python worker holds, but for single rows beyond that.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Has batches go to Python workers at a bounded size, whatever the length of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Returns the free memory of a Python worker to the system, as workers are used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, a function for mapInPandas or mapInArrow, that gives memory back at the end of its task."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts."""
    return df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def pieces(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def hash_of(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def held_out(column: str, of: int, rest: int) -> Column:
    """crc32(id as text) mod of = rest; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(of)) == rest


def runs(batches: Iterator, rows: int) -> Iterator:
    """Pandas batches joined and cut to ``rows`` rows each, the last may have fewer."""
    import pandas as pd

    kept, n = [], 0
    for b in batches:
        while len(b):
            take = b.iloc[: rows - n]
            kept.append(take)
            n += len(take)
            b = b.iloc[len(take) :]
            if n == rows:
                yield pd.concat(kept, ignore_index=True)
                kept, n = [], 0
    if n:
        yield pd.concat(kept, ignore_index=True)


def listed(values: pa.Array) -> list[bytes]:
    """Strings without nulls as bytes; by way of NumPy, to_pylist makes a scalar of each first."""
    return values.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def flat_words(texts: list[str | None] | pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, A-Z lower-cased, one text after the other, and how many each has."""
    whole = texts.cast(pa.large_string()).fill_null("") if isinstance(texts, pa.Array) else pa.array([x or "" for x in texts], pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    flat, ends = parts.values, parts.offsets.to_numpy()
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    if empty.any():
        before = np.concatenate([[0], np.cumsum(empty)])
        sizes = sizes - (before[ends[1:]] - before[ends[:-1]])
        flat = flat.filter(pa.array(~empty))
    return flat, sizes.astype(np.int64)


def coded_words(texts: list[str | None] | pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of texts, A-Z lower-cased, one text after the other: the code
    of each word, how many words each text has, and the word of each code."""
    flat, sizes = flat_words(texts, lower)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes, listed(coded.dictionary)
