"""Encoding, token shards and packing: exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hashloom.llm.common import Scratch
from hashloom.llm.packing import pack
from hashloom.llm.token_store import PerfectHash, Shard, lookup, read_tokens, write_tokens
from hashloom.llm.tokens import Encoder, default_path

ODD = [None, "", " ", "a  b", " a", "a \n b\n\n c ", "it's  I'll 12 34,, <|endoftext|> é", "　 　a b", "a\0b c", "tail \n", "\U0001f600 \U0001f600  !", "\r\n x\r\n  y", "word " * 6000]


@pytest.fixture(scope="module")
def lib():
    return Encoder(default_path())


def plain(lib, texts):
    return [e.ids for e in lib.lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library(lib, corpus):
    rng = random.Random(3)
    signs = "ab '’ 1é\n\t  \U0001f600.,s  \0"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + [r["text"] for r in corpus.collect()]
    assert [x.tolist() for x in lib.encode(texts)] == plain(lib, texts)
    small = Encoder(default_path(), most=500, keep=100)
    for i in range(0, len(texts), 700):
        assert [x.tolist() for x in small.encode(texts[i : i + 700])] == plain(lib, texts[i : i + 700])


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        table = PerfectHash.build(keys)
        assert sorted(table.slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5]))


def test_store_round_trip(spark, documents, lib):
    docs = [(i * 3 - 5, t) for i, t in enumerate(ODD)] + [(7, "same id"), (7, "same id"), (7, "other text"), (None, "no id")]
    scratch = Scratch(spark, "test")
    manifest = write_tokens(documents(docs), default_path(), scratch.path("shards"), scratch, shard_bytes=4000).cache()
    assert manifest.count() > 1
    got = read_tokens(manifest, raw=True).orderBy("start").collect()
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    ids = plain(lib, [t for _, t in docs])
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=lambda x: (key(x), x[1])) == sorted(((d, [*x, 0]) for (d, _), x in zip(docs, ids)), key=lambda x: (key(x), x[1]))
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in docs), key=lambda d: key((d,)))
    found = lookup(manifest, [7, -5, 9999])
    assert len(found[7]) == 4 and 9999 not in found and found[-5][0].tolist() == [0]
    shard = Shard(manifest.where("first_key <= 7 and last_key >= 7").first()["path"])
    assert (shard.find(np.arange(10**6, 10**6 + 1000)) == -1).all()


def test_empty_store(spark, documents):
    scratch = Scratch(spark, "test")
    assert read_tokens(write_tokens(documents([]), default_path(), scratch.path("shards"), scratch)).count() == 0


def check_packed(pieces, docs, lib):
    want = sorted(tuple([*x, 1]) for x in plain(lib, [t for _, t in docs]))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
        by_doc[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by_sequence.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    assert sum(r["length"] for r in pieces) == sum(map(len, want))
    return by_doc


def test_packing(spark, corpus, lib):
    docs = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    got = pack(corpus, default_path()).collect()
    by_doc = check_packed(got, docs, lib)
    for (d, _), ids in zip(docs, plain(lib, [t for _, t in docs])):
        whole = [i for _, part, n in sorted(by_doc[d]) for i in part]
        assert whole == [*ids, 1] and {n for _, _, n in by_doc[d]} == {len(whole)}
    assert len({r["sequence_id"] for r in got}) <= sum(r["length"] for r in got) / 2048 + 12
    again = pack(corpus.repartition(3), default_path()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_packing_odd_texts(documents, lib):
    docs = list(enumerate(ODD)) + [(3, "a  b"), (None, "z"), (None, "z")]
    check_packed(pack(documents(docs), default_path()).collect(), docs, lib)
    assert pack(documents([]), default_path()).count() == 0


def test_neighbours_by_all_terms():
    """Scores of whole BM25, of documents that share more terms than a dozen."""
    import math

    from hashloom.llm.packing import K1, B, Index

    rng = np.random.default_rng(5)
    ids = [np.minimum(rng.zipf(1.3, rng.integers(1, 400)), 499).astype(np.uint16) for _ in range(90)]
    index, n, mean = Index(ids, 500), len(ids), sum(map(len, ids)) / len(ids)
    sets = [set(x.tolist()) for x in ids]
    df = {t: sum(t in s for s in sets) for t in set().union(*sets)}
    for seed in range(0, n, 9):
        want = np.zeros(n)
        for i, x in enumerate(ids):
            for t in sets[seed] & sets[i]:
                if df[t] > 1:
                    tf = int((x == t).sum())
                    want[i] += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))
        assert np.allclose(index.neighbours(seed), want, rtol=1e-4)


def test_special_tokens_as_the_library_has_them():
    """Against an instance that nothing has touched, whatever surrounds the special token."""
    from tokenizers import Tokenizer

    fresh, special = Tokenizer.from_file(default_path()), "<|endoftext|>"
    texts = ["plain text", *(f"{a}{special}{b}" for a in ("", "a", "a ", "a  ", "\n", "x" + special) for b in ("", "b", " b", "  b", "\n", special + " z")), special[:-1], "<|endoftext |>", "many words " * 500 + special + " end"]
    want = [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(default_path()).encode(texts)] == want
    assert sum(50256 in x for x in want) == 37


def test_term_counts_of_long_documents(monkeypatch):
    from hashloom.llm import packing

    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 50, n).astype(np.uint16) for n in (3, 900, 1, 1000, 5, 40)]
    want = packing.counted(ids, 50)
    monkeypatch.setattr(packing, "LONG", 500)
    assert all((a == b).all() for a, b in zip(want, packing.counted(ids, 50), strict=True))


def test_related_documents_meet(spark, documents):
    """Documents that share rare words are dealt next to each other, and share windows."""
    from tokenizers import Tokenizer

    rng, fresh = random.Random(4), Tokenizer.from_file(default_path())
    single = [w[1:] for w in (fresh.decode([i]) for i in range(1000, 40_000)) if w[:1] == " " and w[1:].isalpha()]
    common = single[:300]
    topics = [single[300 + 30 * k : 330 + 30 * k] for k in range(5)]
    docs = [(i, " ".join(rng.choice(topics[i % 5] if rng.random() < 0.5 else common) for _ in range(60))) for i in range(400)]
    by_sequence = defaultdict(set)
    for r in pack(documents(docs), default_path()).collect():
        by_sequence[r["sequence_id"]].add(r["doc_id"] % 5)
    assert np.mean([len(x) for x in by_sequence.values()]) < 3.5  # some 30 documents each: by chance 5
