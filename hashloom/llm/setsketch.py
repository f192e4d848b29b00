"""Near-duplicate texts by SetSketch registers.

A text is the set of its distinct word shingles. Each of 240 registers holds
the least of exponentially distributed hashes over the set, on an exponential
scale and truncated: K = min(q + 1, max(0, floor(1 - log_b(x)))). Registers of
two sets merge by their maximum, and agree about as often as the sets do.

Texts with the same set (128 bits of hash and size) are one class, numbered
once when the table of classes is written. The registers are banded; classes
that share a band of six registers are candidates. At similarity 0.8 a pair is
missed by all 40 bands once in 190,000. First each candidate is matched with
the smallest member of the buckets it shares most often, which links most
groups to stars without pairing their members. Then only buckets that still
hold more than one component are looked into: their members are dealt to cells
(see buckets), and pairs are estimated by the joint likelihood of their
registers (given both sizes) before the exact sets are compared. A pair is
compared only in the first band it shares, and only while its ends are not
linked; so what comes out of a bucket is at most one row a member and cell,
and no link is lost.

All links are confirmed on whole sets of 64-bit shingle hashes. Nulls: a null
text, or one without words, has an empty set and is linked with nothing; with
fewer words than a shingle has, the words as a whole are the one shingle. Rows
with a null id are their own component (null), and link nothing. Rows that
repeat an id keep their classes apart while links are searched; in the end the
id is one node, to which the links of all its texts belong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.buckets import CELL, cells, groups, meetings
from hashloom.llm.common import Scratch, coded_words, small, tidy
from hashloom.llm.components import components

BANDS, PER_BAND = 40, 6
REGISTERS = BANDS * PER_BAND
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Estimates this much below the threshold are still compared; five standard deviations.
MARGIN = 0.13
#: So much further below, the share of equal registers alone rules a pair out.
FURTHER = 0.1
#: Load of a cell's chunk: a member counts 1, and 1 more for each SHINGLES of its set.
CHUNK, SHINGLES = 768, 512
DOCS, SLICE = 500, 2048

_RNG = np.random.default_rng(20240229)
_FLIPS = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_GRID = np.linspace(0, 1, 201)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    codes, sizes, words = coded_words(texts)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[codes]
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled = _mix(rolled + h[i : i + n] + np.uint64(i + 1))
    ends, out = np.cumsum(sizes), []
    for end, size in zip(ends, sizes, strict=True):
        a = end - size
        if size >= width:
            out.append(np.unique(rolled[a : end - width + 1]))
        elif size:
            one = np.zeros(1, np.uint64)
            for i in range(size):
                one = _mix(one + h[a + i : a + i + 1] + np.uint64(i + 1))
            # A short text's one shingle must not meet those of whole width.
            out.append(_mix(one ^ np.uint64(0x5851F42D4C957F2D + int(size))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of shingle hashes."""
    low = np.full(REGISTERS, (1 << 32) - 1, np.uint32)
    h = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(h), SLICE):
        np.minimum(low, ((h[i : i + SLICE, None] ^ _FLIPS) * _TIMES).min(0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / (1 << 32)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of registers, given set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    j = np.minimum(_GRID[None, :], np.minimum(u / v, v / u)[:, None])
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    log = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), log.argmax(1)]


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _print(hashes: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, print (hash of the text), n_shingles, h1 and h2 (hash of the set), regs of every text."""

    @tidy
    def make(batches):
        for pdf in batches:
            for i in range(0, len(pdf), DOCS):
                part = pdf.iloc[i : i + DOCS]
                sets = shingles(list(part["text"]), width)
                prints = list(map(_print, sets))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "print": part["print"].to_numpy(), "n_shingles": [len(s) for s in sets],
                    "h1": [x for x, _ in prints], "h2": [x for _, x in prints], "regs": [registers(s).tobytes() if len(s) else None for s in sets],
                })

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("print"), "text")
    return rows.mapInPandas(make, "doc_id bigint, print bigint, n_shingles bigint, h1 bigint, h2 bigint, regs binary")


def _with_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int, scratch: Scratch, name: str) -> DataFrame:
    """id, hashes of the classes with the given ids (distinct)."""

    @tidy
    def make(batches):
        for pdf in batches:
            for i in range(0, len(pdf), DOCS):
                part = pdf.iloc[i : i + DOCS]
                sets = shingles(list(part["text"]), width)
                # A row that repeats the id may have another text.
                mine = [_print(s) == x for s, x in zip(sets, zip(part["h1"], part["h2"], strict=True), strict=True)]
                yield pd.DataFrame({"id": part["id"], "hashes": [s.tobytes() for s in sets]})[mine]

    wanted = scratch.save(classes.join(ids, "id").select("id", "h1", "h2", F.col("least").alias("doc_id")), name)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.join(small(wanted), "doc_id").select("id", "h1", "h2", "text").mapInPandas(make, "id bigint, hashes binary").dropDuplicates(["id"])


def _likely(regs: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Of others, those whose estimate with i may reach the threshold, best first."""
    others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
    same = (regs[others] == regs[i]).sum(1)
    others = others[same >= (percent / 100 - MARGIN - FURTHER) * REGISTERS]
    if not len(others):
        return others
    e = estimate(np.broadcast_to(regs[i], (len(others), REGISTERS)), regs[others], np.full(len(others), n[i], float), n[others].astype(float))
    good = e >= percent / 100 - MARGIN
    return others[good][np.argsort(-e[good], kind="stable")]


def _first_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band that a shares with each row of b."""
    return (a.reshape(BANDS, PER_BAND) == b.reshape(-1, BANDS, PER_BAND)).all(2).argmax(1)


def _searched(group: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members of a cell, those of other components that they are likely to
    be linked with and meet in this band first."""
    regs = np.frombuffer(b"".join(group["regs"]), "<u2").reshape(len(group), REGISTERS)
    n, comp, part = group["n"].to_numpy(np.int64), group["comp"].to_numpy(), group["part"].to_numpy()
    band, own = int(group["band"].iloc[0]), bool(group["own"].iloc[0])
    for i, others in meetings(part, comp, own):
        found = _likely(regs, n, i, others, percent)
        if len(found):
            found = found[_first_bands(regs[i], regs[found]) == band]
        if len(found):
            yield int(i), found


class Links:
    """Which members of a bucket hang together."""

    def __init__(self, of: np.ndarray):
        _, self.up = np.unique(of, return_inverse=True)
        self.top = {i: i for i in set(self.up.tolist())}

    def root(self, i: int) -> int:
        x = int(self.up[i])
        while self.top[x] != x:
            self.top[x] = x = self.top[self.top[x]]
        return x

    def join(self, i: int, j: int) -> None:
        self.top[self.root(i)] = self.root(j)


def _classes(docs: DataFrame, scratch: Scratch, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, print, n_shingles, h1, h2 of every text; id, least (smallest doc_id),
    h1, h2 of the classes; and links (a, b) of classes."""
    spark = docs.sparkSession
    made = scratch.save(sketch(docs, width), "sketches")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = made.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("least"), F.first("regs").alias("regs"))
    reps = scratch.save(numbered.select(F.monotonically_increasing_id().alias("id"), "least", F.col("n_shingles").alias("n"), "h1", "h2", "regs"), "classes")
    cut = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("regs", 2 * PER_BAND * b + 1, 2 * PER_BAND)).alias("key")) for b in range(BANDS)]
    banded = reps.select("id", "n", F.explode(F.array(*cut)).alias("c")).select("id", "n", "c.band", "c.key")
    buckets = banded.groupBy("key", "band").agg(F.count("*").alias("m"), F.min("id").alias("least")).where("m > 1").select("key", "band", "least")
    shared = scratch.save(banded.join(buckets, ["key", "band"]), "buckets")

    # Each candidate and the bucket head it meets most often.
    often = shared.where("id <> least").groupBy("id", "least").agg(F.count("*").alias("times"))
    pairs = scratch.save(often.groupBy("id").agg(F.max(F.struct("times", (-F.col("least")).alias("l"))).alias("best")).select("id", (-F.col("best.l")).alias("least")), "stars")
    ids = pairs.select("id").union(pairs.select("least")).distinct()
    sets = scratch.save(_with_sets(docs, reps, ids, width, scratch, "star-ids"), "star-sets")
    a, b = sets.withColumnRenamed("hashes", "ha"), sets.select(F.col("id").alias("least"), F.col("hashes").alias("hb"))

    @tidy
    def confirm(batches):
        for pdf in batches:
            ok = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(pdf["ha"], pdf["hb"], strict=True)]
            yield pd.DataFrame({"a": pdf["id"], "b": pdf["least"]})[ok]

    links = scratch.save(pairs.join(a, "id").join(b, "least").mapInPandas(confirm, "a bigint, b bigint"), "star-links")
    comps = components(links, scratch, "stars")

    # Buckets that the stars have left in pieces.
    load = shared.select("key", "band", "id", (1 + F.floor(F.col("n") / SHINGLES)).alias("load"))
    members = scratch.save(cells(load, comps, CHUNK, scratch), "members")
    looked = members.join(reps.select("id", "n", "regs"), "id")
    sorted_ = lambda df: df.repartition(parts, *CELL).sortWithinPartitions(*CELL, "id")
    columns = [*CELL, "id", "comp", "part", "own", "n", "regs"]

    @tidy
    def search(batches):
        for group in groups(batches, CELL):
            at: set[int] = set()
            for i, found in _searched(group, percent):
                at.update([i, *found.tolist()])
            if at:
                yield group.iloc[sorted(at)][columns]

    schema = "key bigint, band int, a int, b int, id bigint, comp bigint, part int, own boolean, n bigint, regs binary"
    likely = scratch.save(sorted_(looked).mapInPandas(search, schema), "likely")
    more_sets = _with_sets(docs, reps, likely.select("id").distinct(), width, scratch, "likely-ids")

    @tidy
    def compare(batches):
        for group in groups(batches, CELL):
            group, out = group.reset_index(drop=True), []
            linked = Links(group["comp"].to_numpy())
            sets = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
            ids = group["id"].to_numpy()
            for i, found in _searched(group, percent):
                for j in found:
                    if linked.root(i) != linked.root(j) and alike(sets[i], sets[j], percent):
                        linked.join(i, j)
                        out.append((ids[i], ids[j]))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    more = sorted_(likely.join(more_sets, "id")).mapInPandas(compare, "a bigint, b bigint")
    all_links = scratch.save(links.unionByName(more), "links")
    return made.drop("regs"), reps.select("id", "least", F.col("n").alias("n_shingles"), "h1", "h2"), all_links


def _smallest(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """h1, h2, n_shingles, component_id (the smallest doc_id of the class's component)."""
    of = classes.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return of.join(least, "component").select("h1", "h2", "n_shingles", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach), kept."""
    out = Scratch(docs.sparkSession, "near-duplicates")
    with Scratch.swept():
        return out.save(_near_duplicates(docs, width, percent), "found")


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "setsketch")
    made, classes, links = _classes(docs, scratch, width, percent)
    keys = ["h1", "h2", "n_shingles"]
    told = made.where("doc_id is not null and n_shingles > 0").join(classes, keys).select("doc_id", "id")
    # An id with several texts ties their classes together.
    several = told.groupBy("doc_id").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("doc_id", "first")
    ties = told.join(several, "doc_id").select(F.col("id").alias("a"), F.col("first").alias("b"))
    comps = components(links.unionByName(scratch.save(ties, "ties")), scratch, "all")
    by_class = made.join(_smallest(classes, comps), keys, "left").select("doc_id", "n_shingles", "component_id")
    # Texts of an id without words go by the id's other texts, if it has any.
    empty = scratch.save(by_class.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct(), "empty")
    other = by_class.where("component_id is not null").join(small(empty), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("other"))
    component = F.coalesce("component_id", "other", "doc_id")
    final = by_class.join(small(scratch.save(other, "other")), "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return final.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: of its texts the first
    by doc_id, then by the text's hash. A row goes only for what its own text
    repeats. Rows without an id, and texts without words, stay; of rows that
    repeat both id and text one stays."""
    out = Scratch(docs.sparkSession, "kept")
    with Scratch.swept():
        scratch = Scratch(docs.sparkSession, "setsketch")
        made, classes, links = _classes(docs, scratch, width, percent)
        keys = ["h1", "h2", "n_shingles"]
        comps = components(links, scratch, "all")
        of = classes.join(comps, "id", "left").select(*keys, F.coalesce("component", "id").alias("__component"))
        texts = made.where("doc_id is not null and n_shingles > 0").join(of, keys).select("doc_id", "print", "__component")
        told = scratch.save(texts, "told")
        first = told.groupBy("__component").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.count("*").alias("m")).where("m > 1")
        gone = told.join(first, "__component").where("first.doc_id <> doc_id or first.print <> print").select("doc_id", "print").distinct()
        twice = told.groupBy("doc_id", "print").agg(F.count("*").alias("m")).where("m > 1").select("doc_id", "print")
        at = lambda df, name: out.save(df.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")), name)
        gone, repeated = at(gone, "gone"), at(twice, "twice")
    gone, repeated = small(gone), small(repeated)
    names = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col("doc_id").cast("bigint").alias("__id"), F.xxhash64("text").alias("__print"))
    left = rows.join(gone, ["__id", "__print"], "left_anti")
    if repeated.take(1):
        once = left.join(repeated, ["__id", "__print"], "left_semi").dropDuplicates(["__id", "__print"])
        left = left.join(repeated, ["__id", "__print"], "left_anti").unionByName(once)
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
