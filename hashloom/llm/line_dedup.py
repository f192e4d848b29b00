"""Fuzzy deduplication of lines over all texts.

A line is normalised to its words, A-Z lower-cased. Equal lines are one class,
however short. Each class has a SimHash of its distinct words, of 128 bits. Two lines
are linked if their word edit similarity reaches the threshold.

Candidates share a block. d edits leave one of d + 1 disjoint blocks of a line as it
was. Blocks are runs of three words, of which similar lines have one in common,
but for lines of five words with another one in the middle, and of four and five
words: these are also met by what is left of five words without any one of them.
All blocks of all different lines are counted, and a line is met by its rarest
ones, up to the first that makes d + 1 of them disjoint: all blocks before the
rarest that two similar lines share are changed by the edits, so that both lines
are met by it. No pair is missed, whatever the length. A block that no other line
has needs not be told, and a line with d + 1 disjoint blocks of its own is done with.

Members of a bucket near its head by SimHash are tried first, which links most
groups to stars without pairing their members. Buckets that are then still in several
components are looked into, dealt to cells (see buckets); there only pairs go
that so many edits cannot account for, by length and by 128 bits of which each
word turns over one. All others are verified on the lines themselves. So no
bucket is dropped, cut or capped. Each connected group keeps one occurrence,
the first by id and line.

Lines are told apart by 64-bit hashes of their word sequences. Nulls: a null
text stays null; a null id is an id of its own, before others. Rows that repeat
both id and text are one text, and get the same decision. Lines without words
are left alone, and those of fewer than min_words words. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.buckets import CELL, cells, groups
from hashloom.llm.common import WORD, Scratch, coded_words, pieces, release, small, tidy
from hashloom.llm.components import components
from hashloom.llm.setsketch import Links, _mix

#: Bits of a SimHash in which a line may differ from a bucket's head to be tried first.
SIMILAR, FAR = 0.8, 24
#: Words of a block; lines of so many words are also met by what one edit leaves.
RUN, FIVE = 3, 5
#: Lines of a cell beyond which pairs are met by their rarest words, and compared in it.
HOT = 32
#: Load of a cell's chunk: a line counts 1, and 1 more for each WORDS of its words.
CHUNK, WORDS = 1536, 64
#: Bytes of lines whose blocks are counted and looked up together, that are hashed at once, and
#: that are dealt out together.
PIECE, AT_ONCE, DEALT = 4 << 20, 128 << 10, 16 << 20
DOCS = 400


@cache
def edits(n: int, similar: float) -> int:
    """The most edits with which lines of at most n words are similar enough."""
    d = min(n, int((1 - similar) * n) + 1)
    while d and 1 - d / n < similar:
        d -= 1
    return d


class Vocabulary:
    """The words of some lines: their codes, one line after the other, and of each
    code its hash and bytes."""

    def __init__(self, codes: np.ndarray, words: list[bytes]):
        self.codes = codes
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        self.width = np.fromiter(map(len, words), np.int32, len(words))

    def simhash(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """SimHashes of the stretches of words that are lines, two times 64 bits; a
        word counts once in a line, or its repeats would make the code."""
        if not len(sizes):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        line = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(line)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        pair = line * len(self.hashes) + self.codes[at]
        pair.sort()
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
        distinct = np.bincount(pair // len(self.hashes), minlength=len(sizes))
        code, first = pair % len(self.hashes), np.cumsum(distinct) - distinct
        return tuple(_majority(_SPREAD[x.view(np.uint8).reshape(-1, 8)], code, first, distinct) for x in (self.hashes, _mix(self.hashes)))


def line_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the word sequence, SimHash and number of words of each line."""
    same, sizes, of = _coded_lines(lines)
    some, sim = np.flatnonzero(sizes), np.zeros(len(sizes), np.uint64)
    sim[some] = of.simhash((np.cumsum(sizes) - sizes)[some], sizes[some])[0]
    return same, sim, sizes


def _coded_lines(lines: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, Vocabulary]:
    """Hash of the word sequence and number of words of each line, and all words."""
    codes, sizes, found = coded_words(lines)
    of = Vocabulary(codes, found)
    some = np.flatnonzero(sizes)
    same = np.zeros(len(sizes), np.uint64)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        place = np.arange(len(codes)) - np.repeat(starts, sizes[some])
        same[some] = np.add.reduceat(_mix(of.hashes[codes] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)
    return same, sizes, of


#: The bits of a byte as eight bytes of one number, the highest bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64)[:, 0]


def _majority(spread: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each line the bits that most of its words have. Eight counters of a
    byte are added at once, over stretches of at most 255 words."""
    parts = -(-sizes // 255)
    cuts = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * 255
    counts = np.add.reduceat(spread[codes], cuts, 0).view(np.uint8).reshape(len(cuts), 64)
    if len(cuts) > len(starts):
        counts = np.add.reduceat(counts, np.cumsum(parts) - parts, 0, dtype=np.int64)
    more = counts.astype(np.int64) * 2 > sizes[:, None]
    return np.packbits(more, axis=1).view(np.uint64)[:, 0]


def edit_similarity(a: list[bytes], b: list[bytes]) -> float:
    """1 - edits / longer length over words, by bit-parallel rows."""
    n = max(len(a), len(b))
    if not n:
        return 1.0
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < min(len(a), len(b)) and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return 1 - max(len(a), len(b)) / n
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    # up and down: where a column's distance rises or falls by one from row to row.
    up, down, distance = full, 0, len(a)
    for w in b:
        eq = at.get(w, 0)
        same = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(same | up)), up & same
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise, fall = rise << 1 | 1, fall << 1
        here = eq | down
        up, down = full & (fall | ~(here | rise)), rise & here
    return 1 - distance / n


def may_reach(a: list[bytes], sa: set[bytes], b: list[bytes], sb: set[bytes], similar: float) -> bool:
    """Whether lines can be similar enough: a word that the other lacks takes an edit."""
    return max(len(sa - sb), len(sb - sa), abs(len(a) - len(b))) <= edits(max(len(a), len(b)), similar)


#: Base of the rolling hash, its inverse, and a number for each byte.
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


@cache
def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n; a table for lines of usual lengths is kept."""
    return _table(base, 2 * AT_ONCE)[: n + 1] if n <= 2 * AT_ONCE else _table.__wrapped__(base, n)


class Rolled:
    """The words of normalised lines (A-Z lower-cased, one space between words), and
    hashes of stretches of them from running sums over the bytes."""

    def __init__(self, values: list[bytes]):
        ends = np.cumsum([len(v) for v in values])
        buf = np.frombuffer(b"".join(values), np.uint8)
        space, first = buf == 32, np.zeros(len(buf) + 1, bool)
        first[1:], first[ends[:-1]], first[0] = space, True, True
        last = np.append(space, False)
        last[ends] = True
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last)
        self.sizes = np.diff(np.searchsorted(self.starts, np.concatenate([[0], ends])))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * _powers(_BASE, len(buf))[:-1], out=self.sums[1:])
        self.back = _powers(_BACK, len(buf))[self.starts]

    def stretch(self, a: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from word a on."""
        return _mix((self.sums[self.ends[a + n - 1]] - self.sums[self.starts[a]]) * self.back[a] + np.uint64(n))


def _some(values: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Stretches of lines of some AT_ONCE bytes, which a processor's cache holds, and where they begin."""
    begin = size = 0
    for i, v in enumerate(values):
        size += len(v)
        if size >= AT_ONCE:
            yield begin, values[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(values):
        yield begin, values[begin:]


def line_blocks(of: Rolled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, key and place in the line of all blocks of lines, line after line: the runs
    of RUN words; of lines of FIVE words (at place -1) also what is left without any one
    word, and of those with a word less, the whole line in the same form."""
    runs = np.maximum(of.sizes - RUN + 1, 0)
    first = np.cumsum(of.sizes) - of.sizes
    line = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(len(line)) - np.repeat(np.cumsum(runs) - runs, runs)
    key = of.stretch(first[line] + at, RUN)
    lines, keys, places = [line], [key], [at]
    for size, lefts in ((FIVE, [[x for x in range(FIVE) if x != gone] for gone in range(FIVE)]), (FIVE - 1, [list(range(FIVE - 1))])):
        some = np.flatnonzero(of.sizes == size)
        for left in lefts:
            k = np.full(len(some), 4, np.uint64)
            for x in left:
                k = _mix(k + of.stretch(first[some] + x, 1) + np.uint64(1))
            lines, keys, places = [*lines, some], [*keys, k], [*places, np.full(len(some), -1)]
    line, key, at = map(np.concatenate, (lines, keys, places))
    if len(at) and at[-1] >= 0:
        return line, key, at
    order = np.argsort(line, kind="stable")
    return line[order], key[order], at[order]


def _disjoint(places: list[int]) -> int:
    """The most of the runs at these sorted places that have no word in common."""
    n, free = 0, 0
    for x in places:
        if x >= free:
            n, free = n + 1, x + RUN
    return n


def rarest(key: np.ndarray, at: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Positions of the blocks of a line by which it is met: the rarest ones, up to the
    first that makes most + 1 of them disjoint, without those that no other line has.
    So many edits cannot change them all, and of the blocks that two similar lines
    share, the rarest is in both their choices."""
    order = np.lexsort((key, count))
    places = at[order].tolist()
    if _disjoint(sorted(places)) > most:
        low, high = 1, len(places)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if _disjoint(sorted(places[:mid])) > most else (mid + 1, high)
        order = order[:low]
    return order[count[order] > 1]


def word_bits(of: Rolled) -> np.ndarray:
    """128 bits a line (as two rows of 64): each word turns over one of them. An edit
    changes two bits at most."""
    bit = (of.stretch(np.arange(len(of.starts)), 1) >> np.uint64(7)) & np.uint64(127)
    one, first = np.left_shift(np.uint64(1), bit & np.uint64(63)), np.cumsum(of.sizes) - of.sizes
    return np.stack([np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == x, one, np.uint64(0)), first) for x in (0, 1)])


def _split(part: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """Row, line number and normalised line of all lines with words of some texts."""
    for i, text in enumerate(part["text"].cast(pa.large_binary()).to_pylist()):
        for j, line in enumerate(text.lower().split(b"\n")):
            if found := line.split():
                yield i, j, b" ".join(found)


def _occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, print, line and h of the lines that take part."""

    @tidy
    def make(batches):
        for got in batches:
            for i in range(0, len(got), DOCS):
                part = got.slice(i, DOCS)
                rows = [(a, j, xxhash.xxh3_64_intdigest(v)) for a, j, v in _split(part) if v.count(b" ") + 1 >= min_words]
                at = pa.array([x[0] for x in rows], pa.int64())
                h = np.array([x[2] for x in rows], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(at), part["print"].take(at), pa.array([x[1] for x in rows], pa.int32()), pa.array(h, pa.int64())], names=["doc_id", "print", "line", "h"])

    return _texts(docs).mapInArrow(make, "doc_id bigint, print bigint, line int, h bigint")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("print"), "text").where("text is not null")


#: Lines travel and lie in packs: their hashes (i64), bytes before compression, and lines.
PACK = ["h", "size", "lines"]


#: Level of compression of packs that lie in a table and travel again; others travel once.
TIGHT = 5


def packed(h: np.ndarray, values: list[bytes], level: int = 1) -> tuple[bytes, int, bytes]:
    """A pack of normalised lines, which hold no line break."""
    whole = b"\n".join(values)
    return h.astype(np.int64, copy=False).tobytes(), len(whole), pa.Codec("zstd", compression_level=level).compress(whole, asbytes=True)


def unpacked(h: bytes, size: int, lines: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The hashes and lines of a pack (of one line at least)."""
    return np.frombuffer(h, np.int64), pa.decompress(lines, size, "zstd", asbytes=True).split(b"\n")


def _packs(rows: list[tuple], names: list[str], first: pa.DataType) -> pa.RecordBatch:
    types = [first, pa.binary(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names=names)


def _classes(docs: DataFrame, parts: int, least: int) -> DataFrame:
    """chunk and pack of the different lines of so many words at least. A chunk is some
    PIECE bytes of lines; those of task t have the numbers from t << 32 on. A task keeps
    the hashes of its lines."""

    @tidy
    def split(batches):
        once: dict[bytes, None] = {}
        held = 0

        def deal():
            values = list(once)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))
            to = (h % np.uint64(parts)).astype(np.int64)
            order, ends = np.argsort(to, kind="stable"), np.cumsum(np.bincount(to, minlength=parts)).tolist()
            for a, b in zip([0, *ends], ends):
                if a < b:
                    own = order[a:b]
                    yield _packs([(int(to[own[0]]), *packed(h[own].view(np.int64), [values[i] for i in own.tolist()]))], ["part", *PACK], pa.int32())

        for got in batches:
            for i in range(0, len(got), DOCS):
                for _, _, v in _split(got.slice(i, DOCS)):
                    if v not in once and v.count(b" ") + 1 >= least:
                        once[v] = None
                        held += len(v)
                if held >= DEALT:
                    yield from deal()
                    once, held = {}, 0
        if once:
            yield from deal()

    @tidy
    def differ(batches):
        from pyspark import TaskContext

        seen: set[int] = set()
        chunk, h, values, held = TaskContext.get().partitionId() << 32, [], [], 0
        for got in batches:
            for row in zip(*(got[c].to_pylist() for c in PACK), strict=True):
                for x, v in zip((found := unpacked(*row))[0].tolist(), found[1], strict=True):
                    if x in seen:
                        continue
                    seen.add(x)
                    h.append(x)
                    values.append(v)
                    held += len(v)
                    if held >= PIECE:
                        yield _packs([(chunk, *packed(np.array(h), values, TIGHT))], ["chunk", *PACK], pa.int64())
                        chunk, h, values, held = chunk + 1, [], [], 0
        if h:
            yield _packs([(chunk, *packed(np.array(h), values, TIGHT))], ["chunk", *PACK], pa.int64())

    pack = "h binary, size int, lines binary"
    rows = _texts(docs).select("text").mapInArrow(split, f"part int, {pack}")
    return rows.repartitionById(parts, "part").mapInArrow(differ, f"chunk bigint, {pack}")


def _counts(classes: DataFrame, bits: int, parts: int) -> DataFrame:
    """chunk, codes and counts (binary: i64, u8) of a chunk's blocks that come again
    anywhere, by how often they do, 255 at most. A block is told by its first
    32 + bits bits, of which the first bits say its range."""

    @tidy
    def tell(batches):
        for chunk, *row in (x for got in batches for x in zip(*(got[c].to_pylist() for c in ("chunk", *PACK)), strict=True)):
            found = [line_blocks(Rolled(x))[1] for _, x in _some(unpacked(*row)[1])]
            code, n = np.unique(np.concatenate(found) >> np.uint64(32 - bits), return_counts=True)
            of, n = (code >> np.uint64(32)).astype(np.int64), np.minimum(n, 255).astype(np.uint8)
            cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist()
            low = code.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, chunk)), pa.array([low[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["range", "chunk", "low", "n"],
            )

    @tidy
    def count(batches):
        for group in groups(batches, ["range"]):
            low = [np.frombuffer(x, "<u4") for x in group["low"]]
            # Sorted with their places in one number.
            code = np.concatenate(low).astype(np.uint64) << np.uint64(32) | np.arange(sum(map(len, low)), dtype=np.uint64)
            code.sort()
            place, code = (code & np.uint64(0xFFFFFFFF)).astype(np.int64), code >> np.uint64(32)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            sums = np.minimum(np.add.reduceat(np.frombuffer(b"".join(group["n"]), np.uint8)[place].astype(np.int64), first), 255).astype(np.uint8)
            total, at, out = np.empty(len(code), np.uint8), 0, []
            total[place] = np.repeat(sums, np.diff(np.append(first, len(code))))
            for chunk, of, x in zip(group["chunk"], group["range"], low, strict=True):
                n = total[at : at + len(x)]
                at += len(x)
                if (n > 1).any():
                    out.append((chunk, ((of << 32) + x[n > 1].astype("<i8")).tobytes(), n[n > 1].tobytes()))
            yield pd.DataFrame(out, columns=["chunk", "codes", "counts"])

    told = classes.mapInArrow(tell, "range bigint, chunk bigint, low binary, n binary")
    return told.repartition(parts, "range").sortWithinPartitions("range").mapInPandas(count, "chunk bigint, codes binary, counts binary")


def near_rows(h: np.ndarray, values: list[bytes], codes: np.ndarray, counts: np.ndarray, bits: int, similar: float) -> pa.RecordBatch:
    """The rows of _near of some lines, by the counts of the blocks that come again."""
    of = Rolled(values)
    line, key, at = line_blocks(of)
    key = (key >> np.uint64(32 - bits)).astype(np.int64)
    found = np.minimum(np.searchsorted(codes, key), max(len(codes) - 1, 0))
    count = np.where(codes[found] == key, counts[found], 1) if len(codes) else np.ones(len(key), np.int64)
    ends, keys, use = np.searchsorted(line, np.arange(len(values) + 1)).tolist(), [], []
    for i in np.flatnonzero(np.bincount(line[count > 1], minlength=len(values))).tolist():
        a, b, n = ends[i], ends[i + 1], int(of.sizes[i])
        most = edits(int(n / similar + 1e-9), similar)
        # A line whose own blocks are out of reach for so many edits has no partner.
        if n <= FIVE or _disjoint(at[a:b][count[a:b] == 1].tolist()) <= most:
            chosen = np.flatnonzero(count[a:b] > 1) if n <= FIVE else rarest(key[a:b], at[a:b], count[a:b], most)
            if len(chosen):
                keys.append(np.unique(key[a:b][chosen]))
                use.append(i)
    held = [values[i] for i in use]
    lines = pa.array(held, pa.binary())
    sim, sig = line_codes(lines.view(pa.string()))[1], word_bits(Rolled(held)) if held else np.zeros((2, 0), np.uint64)
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
    columns = {"h": h[use], "n": of.sizes[use].astype(np.int32), "sim": sim.view(np.int64), "sig": np.ascontiguousarray(sig[0]).view(np.int64), "sig2": np.ascontiguousarray(sig[1]).view(np.int64), "keys": pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))}
    return pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()), lines], names=[*columns, "value"])


def _near(classes: DataFrame, counts: DataFrame, bits: int, parts: int, similar: float) -> DataFrame:
    """h, n (words), sim, sig, sig2, keys (of blocks) and value of the lines that may have
    similar ones. A chunk's counts come before its lines."""

    @tidy
    def choose(batches):
        chunk, codes, held = None, [], []
        for at, told, n, *row in (x for got in batches for x in zip(*(got[c].to_pylist() for c in ("chunk", "codes", "counts", *PACK)), strict=True)):
            if at != chunk:
                chunk, codes, held = at, [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
            if told is not None:
                codes.append(np.frombuffer(told, "<i8"))
                held.append(np.frombuffer(n, np.uint8))
                continue
            all_ = np.concatenate(codes)
            order = np.argsort(all_)
            table = all_[order], np.concatenate(held)[order].astype(np.int64)
            h, lines = unpacked(*row)
            for at_, values in _some(lines):
                yield near_rows(h[at_ : at_ + len(values)], values, *table, bits, similar)

    none = lambda *columns: [F.lit(None).cast(t).alias(c) for c, t in columns]
    rows = counts.select("chunk", "codes", "counts", *none(("h", "binary"), ("size", "int"), ("lines", "binary"))).unionByName(classes.select("chunk", *none(("codes", "binary"), ("counts", "binary")), *PACK))
    rows = rows.repartitionById(parts, F.shiftright("chunk", 32).cast("int")).sortWithinPartitions("chunk", F.col("h").isNotNull())
    return rows.mapInArrow(choose, "h bigint, n int, sim bigint, sig bigint, sig2 bigint, keys array<bigint>, value binary")


def _lines(docs: DataFrame, scratch: Scratch, parts: int, min_words: int, similar: float) -> DataFrame:
    """The rows of _near of the different lines of all texts."""
    spark, least = docs.sparkSession, next(m for m in range(1, 1 << 20) if edits(int(m / similar + 1e-9), similar))
    classes = scratch.save(_classes(docs, parts, max(min_words, least)), "classes")
    release(spark)
    size = classes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    # Ranges of some two million blocks, if words have six bytes.
    bits = min(31, pieces(size, 12 << 20).bit_length() - 1)
    counts = scratch.save(_counts(classes, bits, parts), "counts")
    release(spark)
    near = scratch.save(_near(classes, counts, bits, parts, similar), "near")
    scratch.drop("classes", "counts")
    release(spark)
    return near


def _within(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= FAR


def _buckets(entries: DataFrame) -> DataFrame:
    """key, m (entries), the least and the greatest class (a, b), and, of buckets of two,
    in how many word bits they differ, of the buckets that more than one class is in."""
    bits = F.bit_count(F.bit_xor("sig")) + F.bit_count(F.bit_xor("sig2"))
    return entries.groupBy("key").agg(F.count("*").alias("m"), F.min("h").alias("a"), F.max("h").alias("b"), bits.alias("bits"), F.min("n").alias("least"), F.max("n").alias("most")).where("m > 1")


def _verified(cut: dict, x: bytes, y: bytes, similar: float) -> bool:
    for v in (x, y):
        if v not in cut:
            cut[v] = (w := v.split(), set(w))
    return may_reach(*cut[x], *cut[y], similar) and edit_similarity(cut[x][0], cut[y][0]) >= similar


def _links(full: DataFrame, scratch: Scratch, parts: int, similar: float) -> DataFrame:
    """Links (a, b) of similar classes, that connect each group. full: as _near."""
    entries = full.select("h", "n", "sig", "sig2", F.explode("keys").alias("key"))
    found = scratch.save(_buckets(entries), "buckets")
    # Bounds that no pair similar enough is beyond.
    pairs = found.where("m = 2").where(F.col("bits") <= 2 * (1 - similar) * F.col("most") + 1e-6).where(F.col("least") >= similar * F.col("most") - 1e-6).select("a", "b")
    larger = small(found.where("m > 2").select("key", "a"))
    members = scratch.save(full.select("h", "n", "sim", "sig", "sig2", F.explode("keys").alias("key")).join(larger, "key"), "members")
    # Those near the head by SimHash are tried first; what this leaves is looked into below.
    heads = members.where("h = a").select("key", F.col("sim").alias("sa"))
    stars = members.where("h <> a").join(small(scratch.save(heads, "heads")), "key").where(_within("sim", "sa")).select("a", F.col("h").alias("b"))
    pairs = scratch.save(pairs.unionByName(stars).distinct(), "pairs")
    scratch.drop("buckets", "heads")
    release(full.sparkSession)

    def with_lines(df: DataFrame, on: str, name: str, *more: str) -> DataFrame:
        """df with the line of class df.on as name, and more columns of the class."""
        wanted = scratch.save(df.select(F.col(on).alias("h")).distinct(), f"wanted-{name}")
        lines = full.select("h", "value", *more).join(small(wanted), "h", "left_semi")
        return df.join(lines.select(F.col("h").alias(on), F.col("value").alias(name), *more), on)

    @tidy
    def confirm(batches):
        for pdf in batches:
            cut: dict = {}
            ok = [_verified(cut, x, y, similar) for x, y in zip(pdf.iloc[:, -2], pdf.iloc[:, -1], strict=True)]
            yield pdf[["a", "b"]][ok]

    confirmed = lambda df, name: with_lines(with_lines(df, "a", f"{name}-x"), "b", f"{name}-y").mapInPandas(confirm, "a bigint, b bigint")
    links = scratch.save(confirmed(pairs, "star"), "star-links")
    scratch.drop("pairs", "wanted-star-x", "wanted-star-y")
    release(full.sparkSession)

    comps = components(links, scratch, "stars")
    # Members outside the largest component of a large bucket meet one of that component, drawn by
    # bucket, which links most of what the heads have left of groups of near copies.
    known = members.join(comps.withColumnRenamed("id", "h"), "h", "left").withColumn("comp", F.coalesce("component", "h"))
    drawn = F.min(F.col("h").bitwiseXOR(F.xxhash64("key")))
    per = known.groupBy("key", "comp").agg(F.count("*").alias("m"), drawn.alias("drawn"))
    most = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("m").alias("m"), F.max(F.struct("m", "comp", "drawn")).alias("most")).where((F.col("comps") > 1) & (F.col("m") > HOT))
    most = scratch.save(most.select("key", F.col("most.comp").alias("largest"), F.col("most.drawn").bitwiseXOR(F.xxhash64("key")).alias("head")), "largest")
    left = scratch.save(known.join(small(most), "key").where((F.col("comp") != F.col("largest")) | (F.col("h") == F.col("head"))).select("key", "h", "head", "comp", "largest", "n", "sig", "sig2"), "outside")
    heads = left.where("h = head").select("key", F.col("n").alias("n_"), F.col("sig").alias("sig_"), F.col("sig2").alias("sig2_"))
    turned, longer = (F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_"))) for c in ("sig", "sig2")), F.greatest("n", "n_")
    reach = (sum(turned, F.lit(0)) <= 2 * (1 - similar) * longer + 1e-6) & (F.least("n", "n_") >= similar * longer - 1e-6)
    tries = scratch.save(left.where("h <> head").join(small(scratch.save(heads, "drawn")), "key").where(reach).groupBy(F.col("head").alias("a"), F.col("h").alias("b")).agg(F.max("largest").alias("ca"), F.max("comp").alias("cb")), "tries")
    if tries.take(1):
        again = scratch.save(confirmed(tries, "second").join(tries, ["a", "b"]), "second-links")
        merged = components(again.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, "seconds").withColumnsRenamed({"id": "old", "component": "new"})
        merged = small(scratch.save(merged, "merged"))
        alone = merged.join(comps, F.col("old") == F.col("id"), "left_anti").select(F.col("old").alias("id"), F.col("new").alias("component"))
        comps = scratch.save(comps.join(merged, F.col("component") == F.col("old"), "left").select("id", F.coalesce("new", "component").alias("component")).unionByName(alone), "merged-comps")
        links = links.unionByName(again.select("a", "b"))
    scratch.drop("largest", "outside", "drawn", "wanted-second-x", "wanted-second-y")
    release(full.sparkSession)
    told = members.select("key", F.lit(0).alias("band"), F.col("h").alias("id"), (1 + F.floor(F.col("n") / WORDS)).alias("load"))
    looked = cells(told, comps, CHUNK, scratch).join(members.select("key", F.col("h").alias("id"), "n", "sig", "sig2"), ["key", "id"])
    placed = lambda df: df.repartition(parts, *CELL).sortWithinPartitions(*CELL, "id")
    columns = [*CELL, "id", "comp", "part", "own", "n", "sig", "sig2"]

    @tidy
    def search(batches):
        """Pairs (id, other) of cells of few rows; of larger cells the rows that have any."""
        for pdf in _whole(batches, CELL):
            any_, ids, pairs = np.zeros(len(pdf), bool), pdf["id"].to_numpy(), [np.zeros((0, 2), np.int64)]
            rows = np.diff(_bounds(pdf))
            few = np.repeat(rows <= HOT, rows)
            for i, j in in_reach(pdf, similar):
                any_[i[~few[i]]] = any_[j[~few[i]]] = True
                pairs.append(np.unique(np.sort(np.stack([ids[i[few[i]]], ids[j[few[i]]]], 1), 1), axis=0))
            met = pd.DataFrame(np.unique(np.concatenate(pairs), axis=0), columns=["id", "other"])
            yield pdf[any_][columns].assign(other=None)
            yield met.assign(**{c: None for c in columns if c != "id"})[[*columns, "other"]]

    likely = scratch.save(placed(looked).mapInPandas(search, "key bigint, band int, a int, b int, id bigint, comp bigint, part int, own boolean, n int, sig bigint, sig2 bigint, other bigint"), "likely")
    scratch.drop("members", "cell-stats")
    release(full.sparkSession)
    met = scratch.save(likely.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), "met")
    others = confirmed(met, "other")
    likely = likely.where("other is null").drop("other")

    @tidy
    def compare(batches):
        for group in groups(batches, CELL):
            out = _linked_in(group, similar)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    lined = with_lines(likely, "id", "value", "keys")
    more = placed(lined).mapInPandas(compare, "a bigint, b bigint")
    links = scratch.save(links.unionByName(others).unionByName(more), "links")
    scratch.drop("near", "likely", "met")
    release(full.sparkSession)
    return links


def _linked_in(group: pd.DataFrame, similar: float) -> list[tuple[int, int]]:
    """Links between lines of a cell, that connect what is similar."""
    cut: dict = {}
    linked, lines, ids = Links(group["comp"].to_numpy()), list(group["value"]), group["id"].to_numpy()
    keys, key, out = [frozenset(x.tolist()) for x in group["keys"]], int(group["key"].iloc[0]), []

    def tried(x: int, y: int) -> None:
        # A pair is compared in the bucket of the least block that both have.
        if linked.root(x) != linked.root(y) and min(keys[x] & keys[y]) == key and _verified(cut, lines[x], lines[y], similar):
            linked.join(x, y)
            out.append((int(ids[x]), int(ids[y])))

    # Similar lines have one of their rarest words in common, as so many of these
    # as there may be edits, and one more, cannot all be missing.
    split = [v.split() for v in lines]
    count: dict[bytes, int] = {}
    for w in split:
        for x in set(w):
            count[x] = count.get(x, 0) + 1
    part, own, n = group["part"].to_numpy(), bool(group["own"].iloc[0]), group["n"].to_numpy()
    sig = np.stack([group[c].to_numpy().view(np.uint64) for c in ("sig", "sig2")])
    met: dict[bytes, list[int]] = {}
    for y, w in enumerate(split):
        rare = sorted(w, key=lambda x: (count[x], x))[: edits(int(len(w) / similar + 1e-9), similar) + 1]
        others = np.array(sorted({x for r in set(rare) for x in met.get(r, ())}), np.int64)
        if len(others):
            near = np.bitwise_count(sig[:, others] ^ sig[:, y, None]).sum(0) <= 2 * (1 - similar) * np.maximum(n[others], n[y]) + 1e-6
            near &= (np.minimum(n[others], n[y]) >= similar * np.maximum(n[others], n[y]) - 1e-6) & (own | (part[others] != part[y]))
            for x in others[near].tolist():
                tried(x, y)
        for r in set(rare):
            met.setdefault(r, []).append(y)
    return out


#: Rows of cells that are looked into at once, but for single cells beyond that.
ROWS = 1 << 16


def _whole(batches, by: list[str]):
    """Sorted batches as stretches of whole groups."""
    kept, n = [], 0
    for pdf in batches:
        kept.append(pdf)
        n += len(pdf)
        if n < ROWS:
            continue
        pdf = pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
        keys = pdf[by].to_numpy()
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield pdf.iloc[:cut]
        kept, n = [pdf.iloc[cut:]], len(pdf) - cut
    if n:
        yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]


def _bounds(pdf: pd.DataFrame) -> np.ndarray:
    """Where the cells of sorted rows begin, and the end."""
    keys = pdf[CELL].to_numpy()
    return np.array([0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)])


def in_reach(pdf: pd.DataFrame, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of the pairs of one cell that are to be compared, long enough
    for each other and within the word bits that so many edits may change: all rows meet the next of their cell,
    then the one after."""
    bounds = _bounds(pdf)
    rest = np.repeat(bounds[1:], np.diff(bounds))
    sig, sig2 = (pdf[c].to_numpy().view(np.uint64) for c in ("sig", "sig2"))
    comp, part, own, n = pdf["comp"].to_numpy(), pdf["part"].to_numpy(), pdf["own"].to_numpy(bool), pdf["n"].to_numpy(float)
    i, lag = np.arange(len(pdf)), 1
    while len(i := i[i + lag < rest[i]]):
        j = i + lag
        hit = np.bitwise_count(sig[i] ^ sig[j]) + np.bitwise_count(sig2[i] ^ sig2[j]) <= 2 * (1 - similar) * np.maximum(n[i], n[j]) + 1e-6
        hit &= (comp[i] != comp[j]) & (own[i] | (part[i] != part[j])) & (np.minimum(n[i], n[j]) >= similar * np.maximum(n[i], n[j]) - 1e-6)
        yield i[hit], j[hit]
        lag += 1


def line_groups(docs: DataFrame, min_words: int = 1, similar: float = SIMILAR, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """The lines that take part (doc_id, print, line, group), and of each group of
    more than one occurrence the first one (group, doc_id, print, line). Without
    ``whole`` only equal lines are groups."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark, "lines"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not SIMILAR <= similar < 1:
        raise ValueError("similar: 0.8 to below 1; at less, similar lines need not share a run of three words")
    occurrences = scratch.save(_occurrences(docs, min_words), "lines")
    if whole:
        comps = components(_links(_lines(docs, scratch, parts, min_words, similar), scratch, parts, similar), scratch, "groups")
        grouped = occurrences.join(small(comps), F.col("h") == F.col("id"), "left").select("doc_id", "print", "line", F.coalesce("component", "h").alias("group"))
    else:
        grouped = occurrences.withColumnRenamed("h", "group")
    keepers = grouped.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "print", "line")).alias("first")).where("n > 1")
    return grouped, scratch.save(keepers.select("group", "first.*"), "keepers")


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    """doc_id, print, lines (numbers of the lines to remove), grouped (lines that
    have others in their group) of texts that have any."""
    lines, keepers = line_groups(docs, **options)
    x, y = lines.alias("x"), small(keepers).alias("y")
    kept = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.print") == F.col("y.print")) & (F.col("x.line") == F.col("y.line"))
    marked = x.join(y, "group").select("x.doc_id", "x.print", F.col("x.line").alias("line"), kept.alias("kept"))
    # A text has each line number once, but for rows that repeat it.
    return marked.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set(F.when(~F.col("kept"), F.col("line")))).alias("lines"), F.countDistinct("line").alias("grouped"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text rid of its removed lines, and with the columns __lines,
    __grouped and __removed: line numbers of the text, and how many had others."""
    scratch = Scratch(docs.sparkSession, "removed")
    with Scratch.swept():
        gone = scratch.save(removed_lines(docs, **options), "removed")
    d, g = docs.withColumn("__print", F.xxhash64("text")).alias("d"), small(gone).alias("g")
    same = F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("g.doc_id")) & (F.col("d.__print") == F.col("g.print"))
    split = F.split(F.col("d.text"), "\n")
    none = F.size(F.coalesce(F.col("g.lines"), F.array().cast("array<int>"))) == 0
    text = F.when(none, F.col("d.text")).otherwise(F.array_join(F.filter(split, lambda _, i: ~F.array_contains(F.col("g.lines"), i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    extra = [F.coalesce(F.size(split), F.lit(0)).cast("bigint").alias("__lines"), F.coalesce("g.grouped", F.lit(0)).alias("__grouped"), F.coalesce("g.lines", F.array().cast("array<int>")).alias("__removed")]
    return d.join(g, same, "left").select(*columns, *extra)


def keep_lines(docs: DataFrame, **options) -> DataFrame:
    """docs rid of repeated lines, n_chars renewed; documents of which no word is
    left go."""
    done = dedup_lines(docs, **options)
    left = done.where((F.size("__removed") == 0) | F.col("text").rlike(WORD))
    return left.select(*(F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes))
