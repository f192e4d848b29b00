"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source is a queue of its documents in a shuffled order, met once a turn
for as many turns as a document may be repeated. A document's virtual finish
time is the cumulative words of its source up to its end, divided by the
source's weight. The mix is the documents of all queues in the order of finish
times, cut where the running total of words reaches the total budget: what has
been given by a finish time is the words of the sources that are used up, and
the time times the weights of the others. So a source that is used up leaves
the rest of the budget to the others, in proportion to their weights. The
document that straddles the cut in its queue gives its first words. Times are
compared as whole numbers: words times the least common multiple of the
weights over the weight.

The order is global: documents are dealt to ranges of finish times, the ranges
are summed, and the running totals within a range start from the sums of those
before it. The place in a queue is a running sum over (source, slice of the
shuffled order) in the same way, so a source with a third of all rows is ranked
by as many tasks as there are slices. Nothing runs over all rows in one task.
The shuffled order is by the MD5 of seed and id, so reruns agree.

The target of a source is reported as the closed form of the same rule, and
the mix does not depend on it; a source's words are within one of it.

Nulls: a null text has size 0 and gives nothing; a null source is a source of
its own, last in the order of weights; null ids are ordered as empty text. An
empty table gives no rows. Rows that repeat an id are documents of their own.
Ties in the order go to the smaller id, then the smaller size; ties in time
to the smaller source, a null one first.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hashloom.llm.common import WORD, Scratch, pieces, small

#: Hexadecimal digits of the order that make a slice: 4096 slices a source.
SLICE = 3
#: Rows of a range of finish times, on average.
RANGE = 1 << 20


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """source, source_size, weight, target, from source, source_size; one row a source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    # In the order in which sources run dry: were all before a source full, the
    # rest would share what is left at this time. The cut is the latest of these.
    full = W.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    budget = F.sum("source_size").over(whole) * F.lit(share)
    time = (budget - F.coalesce(F.sum(F.col("source_size") * cap).over(full), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(full), F.lit(0)))
    ranked = weighed.withColumn("time", time).withColumn("cut", F.max("time").over(whole))
    target = F.least((F.col("source_size") * cap).cast("double"), F.col("weight") * F.col("cut"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _queued(docs: DataFrame, weights: tuple[int, ...], share: float, cap: int, seed: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """doc_id, source, size, print (hash of the text), source_size, weight, target,
    per (time that a word takes) and end (cumulative words) of every document; the
    words of all, and the weights of all sources that have any."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("print"), order.alias("order"))
    rows = scratch.save(rows.withColumn("slice", F.substring("order", 1, SLICE)), "sizes")
    slices = scratch.save(rows.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    totals = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    start = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row a source: weights and targets are told in one task.
    targets = scratch.save(_source_targets(totals, weights, share, cap), "targets")
    a, b = slices.withColumn("start", start).alias("a"), targets.alias("b")
    known = a.join(b, _same("a.source", "b.source")).select(F.col("a.source").alias("known_source"), F.col("slice").alias("known_slice"), "start", "source_size", "weight", "target")
    known = small(scratch.save(known, "known"))
    placed = rows.join(known, _same("source", "known_source") & (F.col("slice") == F.col("known_slice")))
    end = F.col("start") + F.sum("size").over(W.partitionBy("source", "slice").orderBy("order", "doc_id", "size", "print").rowsBetween(W.unboundedPreceding, 0))
    per = F.floor(F.lit(math.lcm(*weights)) / F.col("weight")).cast("bigint")
    queued = placed.select("doc_id", "source", "size", "print", "source_size", "weight", "target", per.alias("per"), end.alias("end"))
    total, all_weights = targets.where("source_size > 0").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    return scratch.save(queued, "queued"), total, all_weights


def _cut(queued: DataFrame, total: int, all_weights: int, weights: tuple[int, ...], share: float, cap: int, scratch: Scratch) -> int:
    """The virtual time at which the mix has all words of the budget."""
    if not total:
        return 0
    turns = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    each = queued.where("size > 0").withColumn("turn", turns).withColumn("place", F.col("end") + F.col("turn") * F.col("source_size"))
    last = F.col("place") == F.col("source_size") * cap
    each = each.select((F.col("place") * F.col("per")).alias("finish"), "source", "place", F.when(last, F.col("weight")).otherwise(0).alias("ends"), F.when(last, F.col("place")).otherwise(0).alias("used"))
    dealt = each.repartitionByRange(pieces(queued.count() * cap, RANGE), "finish", "source", "place")
    ranges = scratch.save(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    # One row a range.
    sums = ranges.groupBy("range").agg(F.sum("ends").alias("ends"), F.sum("used").alias("used"))
    upto = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    start = sums.select("range", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_before") for c in ("ends", "used")))
    within = W.partitionBy("range").orderBy("finish", "source", "place").rowsBetween(W.unboundedPreceding, 0)
    run = ranges.join(F.broadcast(start), "range").select("finish", *((F.col(f"{c}_before") + F.sum(c).over(within)).alias(c) for c in ("ends", "used")))
    # Weights that still run, and the words of sources that are used up, by each
    # finish time; the budget is reached at the latest of the times they lead to,
    # as what is given bends down wherever a source ends.
    whole, budget = math.lcm(*weights), Fraction(share) * total * math.lcm(*weights)
    live = F.lit(all_weights) - F.col("ends")
    left = F.lit(budget.numerator) - F.col("used") * (whole * budget.denominator)
    time = F.when(live > 0, _whole(left, live * budget.denominator))
    given = (live * F.col("finish") + F.col("used") * whole) * budget.denominator <= budget.numerator
    most, met = run.agg(F.max("finish"), F.max(F.when(given, time))).first()
    first = budget.numerator // (budget.denominator * all_weights)
    return first if met is None else min(max(met, first), most)


def _whole(a: Column, b: Column) -> Column:
    """a / b rounded down, for whole numbers a >= 0 and b > 0."""
    return F.floor((a - F.pmod(a, b)) / b).cast("bigint")


def _mixed(docs: DataFrame, weights: tuple[int, ...], share: float, cap: int, seed: int, scratch: Scratch) -> DataFrame:
    queued, total, all_weights = _queued(docs, weights, share, cap, seed, scratch)
    cut = _cut(queued, total, all_weights, weights, share, cap, scratch)
    upto = _whole(F.lit(cut).cast("bigint"), F.col("per"))
    taken = sum((F.least(F.col("size"), F.greatest(F.lit(0), upto - F.col("source_size") * turn - F.col("end") + F.col("size"))) for turn in range(cap)), F.lit(0))
    return queued.withColumn("taken", taken.cast("bigint"))


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, finish.

    taken counts the words that the mix takes of the document, repeats
    included: at most cap times its size. finish is the virtual finish time of
    its first turn, in words times the least common multiple of the weights
    over the weight."""
    mixed = _mixed(docs, weights, share, cap, seed, Scratch(docs.sparkSession, "mixing"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", (F.col("end") * F.col("per")).alias("finish"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 0) -> DataFrame:
    """The mixed documents themselves, with the columns of docs: one row a turn
    in which a document gives words, in the order of finish times; the text of
    a document cut by the budget is its first words, and n_chars its length."""
    scratch = Scratch(docs.sparkSession, "mix")
    mixed = _mixed(docs, weights, share, cap, seed, scratch).where("taken > 0")
    known = mixed.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("print").alias("__print"), "size", "source_size", "per", "end", "taken")
    key = ["__id", "__source", "__print"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.xxhash64("text").alias("__print"))
    # Rows that repeat id, source and text are told apart by number; mostly there are none.
    repeated = known.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").take(1)
    number = lambda *by: F.row_number().over(W.partitionBy(*key).orderBy(*by)) if repeated else F.lit(1)
    a = rows.withColumn("__turned", number("__print")).alias("a")
    b = small(known.withColumn("__turned", number("end"))).alias("b")
    each = a.join(b, _same("a.__id", "b.__id") & _same("a.__source", "b.__source") & (F.col("a.__print") == F.col("b.__print")) & (F.col("a.__turned") == F.col("b.__turned")))
    turns = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    each = each.select("a.__row", "a.__source", "size", "source_size", "per", "end", "taken", F.explode(turns).alias("turn")).withColumn("gives", F.least(F.col("size"), F.col("taken") - F.col("size") * F.col("turn")))
    finish = (F.col("end") - F.col("size") + F.col("gives") + F.col("turn") * F.col("source_size")) * F.col("per")
    order = ["__finish", "__source", "end"]
    ordered = each.withColumn("__finish", finish).repartitionByRange(*order).sortWithinPartitions(*order)
    text = F.when(F.col("gives") < F.col("size"), first_words(F.col("__row.text"), F.col("gives"))).otherwise(F.col("__row.text"))
    renewed = {"text": text, "n_chars": F.length(text)}
    return ordered.select(*((renewed.get(c, F.col(f"__row.`{c}`"))).cast(t).alias(c) for c, t in docs.dtypes))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space kept as it is."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")
