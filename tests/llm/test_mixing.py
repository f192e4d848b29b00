"""The mix against the plain rule: shares are dealt by weight until none is above its limit."""

import re
from collections import defaultdict

import pytest

from hashloom.llm.common import WORD
from hashloom.llm.mixing import fair_queue, mix


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()) * share, set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        out |= {s: float(cap * sizes[s]) for s in over}
        left, free = left - sum(cap * sizes[s] for s in over), free - over
    return out


def check(df, docs):
    got = fair_queue(df).collect()
    assert len(got) == len(docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(re.findall(WORD, text or ""))
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    return got


def test_targets_and_taken(spark, corpus):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in corpus.collect()]
    got = check(corpus, docs)
    assert sorted(map(tuple, got)) == sorted(map(tuple, fair_queue(corpus.repartition(7)).collect()))


@pytest.mark.parametrize("shape", ["one", "hot", "odd", "zero"])
def test_odd_tables(spark, shape):
    docs = {
        "one": [(1, "a b c", "s")],
        "hot": [(i, "w " * (i % 7 + 1), "a" if i % 3 else "b") for i in range(300)] + [(1000, "x " * 3000, "c")],
        "odd": [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "a b c\x0bd", "b"), (3, "a b c\x0bd", "b"), (4, "\n\t ", None), (5, "z " * 5000, "é")],
        "zero": [(1, None, "a"), (2, "  ", None)],
    }[shape]
    df = spark.createDataFrame([(i, t, s, "x", 1.0) for i, t, s in docs], "doc_id bigint, text string, source string, size string, target double")
    check(df, docs)
    mixed = mix(df).collect()
    assert all(len(r) == 5 for r in mixed)
    assert sum(len(re.findall(WORD, r["text"])) for r in mixed) == sum(r["taken"] for r in fair_queue(df).collect())


def test_empty(spark, corpus):
    assert fair_queue(corpus.limit(0)).count() == 0 and mix(corpus.limit(0)).count() == 0
