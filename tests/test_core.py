"""Kernels against a plain integer model, fixed results, invariants, plans."""

import random

import pytest
from pyspark.sql import functions as F

from hashloom.functions import kernels as K
from hashloom.functions.u64 import signed, to_text, umod, wrapping
from hashloom.operators import join as J
from hashloom.operators import partition as P
from hashloom.operators import stats as S
from hashloom.sources import generate as G

M = (1 << 64) - 1
EDGES = [0, 1, 2, 2**31, 2**32 - 1, 2**32, 2**53 + 1, 2**63 - 1, 2**63, M - 1, M]


def model(name, key, p):
    b = p.bit_length() - 1
    if name == "modulo":
        return key % p
    if name == "bitwise_and":
        return key & (p - 1)
    if name == "fibonacci":
        return (key * K.FIBONACCI & M) >> (64 - b)
    if name == "murmur3_64":
        for m in (K.FMIX64_1, K.FMIX64_2):
            key = (key ^ (key >> 33)) * m & M
        return (key ^ (key >> 33)) >> (64 - b)
    if name == "murmur3_32":
        h = (key ^ (key >> 32)) & K.MASK32
        h = (h ^ (h >> 16)) * K.FMIX32_1 & K.MASK32
        h = (h ^ (h >> 13)) * K.FMIX32_2 & K.MASK32
        return (h ^ (h >> 16)) >> (32 - b)
    a, c, total = key & K.MASK32, key >> 32, 0
    for _ in range(8):
        total = (total + K.TEA_DELTA) & K.MASK32
        a = (a + (((c << 4) + K.TEA_KEY[0]) ^ (c + total) ^ ((c >> 5) + K.TEA_KEY[1]))) & K.MASK32
        c = (c + (((a << 4) + K.TEA_KEY[2]) ^ (a + total) ^ ((a >> 5) + K.TEA_KEY[3]))) & K.MASK32
    return c >> (32 - b)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_kernels_on_edges(spark, ansi):
    rng = random.Random(5)
    keys = EDGES + [rng.getrandbits(64) for _ in range(50)]
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(i, signed(k)) for i, k in enumerate(keys)], "i int, k bigint")
        with wrapping(spark):
            out = df.select("i", *[f(F.col("k"), 2048).alias(n) for n, f in K.KERNELS.items()], to_text(F.col("k")).alias("text"), umod(F.col("k"), 1_000_003).alias("rest"))
        for row in out.collect():
            key = keys[row["i"]]
            assert row["text"] == str(key) and row["rest"] == key % 1_000_003
            for name in K.KERNELS:
                assert row[name] == model(name, key, 2048), (name, key)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("p", [0, 3, -2, 1 << 32, 2.0])
def test_partition_count_is_checked(p):
    with pytest.raises(ValueError):
        K.hash_murmur3_32(F.lit(1), p)


def test_one_partition(spark):
    assert {r["pid"] for r in P.with_pid(spark.range(5), "id", 1).collect()} == {0}


@pytest.mark.parametrize(
    "kind, args, want",
    [
        (None, (500, 500, 42, 50), (4998, "17897683947881254199", "4064915837248707393")),
        (None, (5, 8, 13, 8), (5, "8842340191968113137", "10794883823239991901")),
        ("uniform", (500, 500, 42, 50), (5056, "4888433314937018190", "12945080384960558220")),
        ("multiples", (500, 500, 42, 50), (250000, "12950599592729043568", "18433132728787114304")),
        ("step_skew", (500, 500, 42, 50), (24188, "11217362533492688049", "8912182044662391795")),
        ("heavy_skew", (500, 500, 42, 50), (70717, "10720938951244233874", "3196104156795896625")),
        (None, (15_000_000, 16_000_000, 47, 65400), (3669723161, "18174694292745652976", "13885619727587441884")),
        ("uniform", (15_000_000, 16_000_000, 47, 65400), (3669640586, "1635802993802706952", "7563415937912943481")),
    ],
)
def test_known_results(spark, kind, args, want):
    nr, ns, seed, top = args
    make = (lambda n, s: G.one_draw(spark, n, s, top)) if kind is None else (lambda n, s: G.relation(spark, n, s, top, kind))
    assert tuple(J.join_checksums(make(nr, seed), make(ns, G.other_seed(seed))).first()) == want


def test_mersenne_stream():
    assert int(G.mersenne_draws(5489, 10_000)[-1]) == signed(9981545732273789042)  # the published check value


@pytest.mark.parametrize("kind", G.DISTRIBUTIONS)
def test_all_forms_agree(spark, kind):
    r, s = (G.relation(spark, 200, seed, 37, kind).cache() for seed in (7, G.other_seed(7)))
    want = tuple(J.join_naive(r, s).first())
    forms = [J.join_checksums(r, s), J.join_skew_salted(r, s, 5), J.join_two_level(r, s, 4, 2)]
    forms += [J.join_partitioned(r, s, p) for p in (2, 16)] + [J.join_hinted(r, s, h) for h in J.HINTS]
    for form in forms:
        assert tuple(form.first()) == want
    parts = J.join_per_partition(r, s, 16).collect()
    assert sum(x["join_count"] for x in parts) == want[0]
    assert str(sum(int(x["checksum1"]) for x in parts) & M) == want[1]


def test_empty_and_null_keys(spark):
    some = spark.createDataFrame([(1,), (None,)], "key bigint")
    none = some.where("key > 5")
    assert tuple(J.join_checksums(some, none).first()) == (0, "0", "0")
    assert J.join_checksums(some, some).first()["join_count"] == 1


def test_layout_invariants(spark):
    n, p = 3000, 64
    rel = G.relation(spark, n, 3, 500, "heavy_skew")
    off = P.offsets(P.histogram(rel, "key", p)).orderBy("pid").collect()
    assert len(off) == p and off[-1]["end"] == n and all(a["end"] == b["begin"] for a, b in zip(off, off[1:]))
    slots = P.scatter_slots(rel, "id", "key", p, run=256).collect()
    assert sorted(x["slot"] for x in slots) == list(range(n))
    assert all(off[x["pid"]]["begin"] <= x["slot"] < off[x["pid"]]["end"] for x in slots)
    order = sorted(slots, key=lambda x: x["slot"])
    assert all(a["pid"] < b["pid"] or a["id"] < b["id"] for a, b in zip(order, order[1:]))
    assert all(x["all_same_task"] for x in P.layout(rel, "key", p).collect())


def test_plans(spark):
    r, s = (G.relation(spark, 100, x, 10) for x in (1, 2))
    plan = J.join_partitioned(r, s, 16)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("ShuffledHashJoin")[1]
    assert above.count("direct_shuffle_partition_id") >= 2 and "ShuffledHashJoin" in plan
    assert "BroadcastHashJoin" in J.join_hinted(r, s, "broadcast")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in J.join_hinted(r, s, "sort_merge")._jdf.queryExecution().executedPlan().toString()


def test_quality_anchors(spark):
    rel = G.multiples_of_64(spark, 1_000_000)
    assert tuple(round(x, 4) for x in S.hash_quality(rel, "key", 1024, "modulo").first()) == (64.0, 7.9373)
    assert tuple(round(x, 4) for x in S.hash_quality(rel, "key", 1024, "murmur3_32").first()) == (1.109, 0.0322)


def test_bad_names(spark):
    for call in (lambda: G.relation(spark, 1, 1, 1, "zipf"), lambda: K.kernel("md5"), lambda: J.join_hinted(None, None, "x"), lambda: umod(F.lit(1), 0)):
        with pytest.raises(ValueError):
            call()


def test_naive_is_bounded(spark):
    big = G.sequential(spark, 501)
    with pytest.raises(ValueError):
        J.join_naive(big, big)


def test_writers(spark, tmp_path):
    rel = {n: G.relation(spark, 300, 1, 100, n) for n in ("uniform", "heavy_skew")}
    S.binned_csv(rel, str(tmp_path / "bins"), 10, 100)
    back = spark.read.csv(str(tmp_path / "bins"), header=True, inferSchema=True)
    assert back.columns == ["BinID", "uniform", "heavy_skew"] and back.agg(F.sum("uniform")).first()[0] == 300
    S.partition_dump(rel["uniform"], "id", "key", 16, str(tmp_path / "pids"), rows=100)
    assert spark.read.text(str(tmp_path / "pids")).count() == 100
