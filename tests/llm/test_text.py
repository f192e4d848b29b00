"""Language-model scores, languages and quality."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hashloom.llm.common import WORD, coded_words, held_out
from hashloom.llm.context_mixing import DEPTH, Speller, Tree, score_texts
from hashloom.llm.language_id import Model, Tagger, identify, learn, viterbi
from hashloom.llm.quality import TextView, fit_quality, keep_good, score_quality

ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One two\tTHREE Été"), (5, "One two\tTHREE Été"), (None, "no id here"), (6, "long words " * 3000), (7, "12 34 !!"), (8, "x" * 5000)]


def tokens(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [*re.findall(WORD, lower), ""]


def is_held(i, of, rest):
    return zlib.crc32(("" if i is None else str(i)).encode()) % of == rest


def base_scores(docs):
    c = Counter(w for i, t in docs if not is_held(i, 10, 0) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(i, t): (sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n) for i, t in docs}


@pytest.mark.parametrize("kind", ["corpus", "odd"])
def test_scores(documents, corpus, kind):
    docs = [(r["doc_id"], r["text"]) for r in corpus.collect()] if kind == "corpus" else ODD
    got = score_texts(corpus if kind == "corpus" else documents(ODD)).collect()
    want = base_scores(docs)
    by_id = Counter((i, round(w[0], 6), *w[1:]) for (i, t), w in want.items() for _ in range(docs.count((i, t))))
    assert Counter((r["doc_id"], round(r["base_score"], 6), r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == by_id
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 and r["held_out"] == is_held(r["doc_id"], 10, 0) for r in got)
    if kind == "corpus":  # learned words are worth more than the base gives them
        train = [r for r in got if not r["held_out"]]
        assert sum(r["score"] for r in train) > sum(r["base_score"] for r in train)


def test_scores_of_nothing(documents):
    assert score_texts(documents([])).count() == 0
    only = documents([(i, "a b") for i in range(200) if is_held(i, 10, 0)])
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in score_texts(only).collect())


def test_bit_predictions_are_probabilities():
    rng = np.random.default_rng(2)
    leaves = rng.poisson(0.5, (1 << DEPTH, 3)).astype(float)
    tree = Tree(leaves)
    tree.train(passes=1)
    assert np.exp(tree.log_leaf(np.arange(1 << DEPTH), 0)).sum() == pytest.approx(1, abs=1e-6)
    speller = Speller()
    speller.count([b"abab", b"abba", b"a"] * 50)
    speller.train([b"abab", b"abba", b"a"] * 20)
    one = [bytes([i]) for i in range(256) if i != 32]
    assert np.exp(speller.log_spell(one)).sum() < 1
    assert speller.log_spell([b"abab"])[0] > speller.log_spell([b"zqxj"])[0]


def test_coded_words():
    texts = ["A b C\x0bd", None, "", "  x  "]
    codes, sizes, words = coded_words(texts)
    assert [words[c].decode() for c in codes] == ["a", "b c", "d", "x"] and sizes.tolist() == [3, 0, 0, 1]


def brute(scores, penalty):
    n, k = scores.shape
    best = max(np.ndindex(*(k,) * n), key=lambda p: sum(scores[i, p[i]] for i in range(n)) - penalty * sum(a != b for a, b in zip(p, p[1:])))
    return list(best)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(size=(15, 3)).astype(np.float32)
    got, at = viterbi(scores, sizes, 0.7), 0
    for n in sizes:
        if n:
            assert list(got[at : at + n]) == brute(scores[at : at + n], 0.7)
        at += n


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    apart = held_out("doc_id", 4, 2)
    model = learn(docs.where(~apart))
    got = identify(docs.where(apart), model, "doc_id", "lang").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()
    mixed = Tagger(model)
    en, de = (docs.where(F.col("lang") == x).orderBy("doc_id").first()["text"] for x in ("en", "de"))
    cut = lambda t: " ".join(t.split()[:60])
    spans = mixed.spans(cut(en) + " " + cut(de))
    assert [s[0] for s in spans][:1] == ["en"] and spans[-1][0] == "de" and len(spans) <= 4


def test_languages_of_odd_texts(documents):
    train = documents([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "кот и пес", "ru"), (4, None, "en"), (5, "lost", None)])
    model = learn(train)
    odd = documents([*ODD, (20, "пес"), (21, "אבג"), (22, "µµ 7")])
    got = {r["doc_id"]: r for r in identify(odd, model, "doc_id").collect()}
    assert identify(odd, model, "doc_id").count() == len(ODD) + 3
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 7)] == ["und"] * 4 and got[20]["lang_pred"] == "ru"
    assert got[21]["lang_pred"] in model.names and got[21]["score"] == 0
    assert learn(documents([])) is None
    assert {r["lang_pred"] for r in identify(odd, None, "doc_id").collect()} == {"und"}
    assert isinstance(model, Model)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels.where(~held_out("doc_id", 3, 0)), labelled=2500)
    rest = docs.join(labels.where(held_out("doc_id", 3, 0)).select("doc_id", "quality"), "doc_id")
    got = score_quality(rest.drop("quality"), model).join(labels, "doc_id").toPandas()
    right = (got["score"] >= 0.5) == (got["quality"] == 1)
    assert right[got["quality"] == 1].mean() > 0.97 and right[got["quality"] == 0].mean() > 0.85


def test_quality_of_odd_texts(spark, documents):
    odd = documents([(*r, None, None, None) for r in ODD])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = score_quality(odd, fit_quality(odd, none)).collect()
    assert len(got) == len(ODD) and all(r["kept"] == bool((t or "").split()) for r, (_, t) in zip(sorted(got, key=lambda r: (r["doc_id"] or 0, r["score"])), sorted(ODD, key=lambda r: r[0] or 0)))
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 0), (8, 0), (6, None), (None, 1)], "doc_id bigint, quality int")
    model = fit_quality(odd, labels)
    kept = keep_good(odd, model)
    assert kept.columns == odd.columns and set(kept.select("score").distinct().collect()) <= {("x",)}
    assert score_quality(odd.limit(0), model).count() == 0


def test_sparse_and_linear_scores_agree():
    view, texts = TextView(), ["Some words\nhere, HERE!", "", None, "a a a ###"]
    w = np.random.default_rng(0).normal(size=view.odds(["x"], np.zeros(1 << 16))[0].size + (1 << 15))
    from hashloom.llm.quality import TEXT

    w = np.random.default_rng(0).normal(size=TEXT + 1)
    odds, _ = view.odds(texts, w)
    for (at, x), o in zip(view.sparse(texts), odds):
        assert (x * w[at]).sum() + w[-1] == pytest.approx(o, abs=1e-4)


def test_runs_cover_texts_and_know_their_words():
    """Runs go from the third word to the end of a text; the same words after the same
    context are the same run, wherever they stand, and others are not."""
    from hashloom.llm.context_mixing import CONTEXT, cut_runs

    rng = np.random.default_rng(4)
    words = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    passage = rng.integers(0, 400, 300)
    texts = [rng.integers(0, 400, n) for n in (0, 1, 2, 3, 4, 500)] + [np.concatenate([rng.integers(0, 400, n), passage]) for n in (0, 7, 150)]
    codes = [np.append(t, 399) for t in texts]
    sizes = np.array([len(c) for c in codes])
    of, context, run, start, size = cut_runs(words[np.concatenate(codes)], sizes)
    seen = {}
    for t, c in enumerate(codes):
        mine = np.flatnonzero(of == t)
        assert len(mine) == 0 if len(c) <= CONTEXT else start[mine[0]] == CONTEXT and start[mine[-1]] + size[mine[-1]] == len(c)
        assert (start[mine][1:] == (start + size)[mine][:-1]).all()
        for i in mine:
            told = (tuple(c[start[i] - CONTEXT : start[i]]), tuple(c[start[i] : start[i] + size[i]]))
            assert seen.setdefault((context[i], run[i]), told) == told
    assert len(seen) == len(set(seen.values()))
    assert sum(len(set(np.flatnonzero((context == context[i]) & (run == run[i])))) == 3 for i in np.flatnonzero(of == 6)) > 1


def test_texts_that_occur_again_score_apart(documents):
    """Against a plain sum: a copy costs its first three words and its runs, and a
    training text is left out of its own contexts."""
    import random

    rng = random.Random(9)
    own = [" ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(220)) for _ in range(80)]
    rows = score_texts(documents(list(enumerate(own + own[:8])))).collect()
    per = {r["doc_id"]: r["score"] / r["n_tokens"] for r in rows}
    # Texts whose copy is learned; a copy that is held out tells nothing.
    again = [i for i in [*range(8), *range(80, 88)] if not is_held((i + 80) % 160, 10, 0)]
    assert len(again) > 10 and max(per[i] for i in range(8, 80)) < min(per[i] for i in again) * 3
    assert all(r["score"] < 0 for r in rows)


def test_probabilities_of_runs_are_proper():
    """A bit's two costs add to one, and the runs of a context share what is theirs."""
    import pandas as pd

    from hashloom.llm.context_mixing import Repeats

    cells = pd.DataFrame({"met": [0, 0, 1, 3], "sure": [8, 8, 11, 15], "again": [True, False, True, True], "count": [40, 10, 5, 90]})
    for model in (Repeats(cells), Repeats(cells.iloc[:0])):
        n, d = np.array([1.0, 5.0, 9.0]), np.array([1.0, 2.0, 1.0])
        no = 10 ** model.log_cost(n, np.zeros(3), d)
        yes = 10 ** model.log_cost(n, n, d)
        assert np.allclose(no + yes, 1)
        assert np.allclose(10 ** model.log_cost(n, n / n, d), yes / n)


def test_wide_word_scores_keep_their_values():
    from hashloom.llm.context_mixing import Model, Speller, Tree

    leaves = np.zeros((1 << DEPTH, 3))
    leaves[:, :2], leaves[:, 2] = 5.0, 1.0
    model = Model(Tree(leaves), Speller(), np.array([0.5, 0.5]), np.array([0.1, 0.1]), 10, 10)
    counts = np.array([[3, 2], [1 << 40, 7], [0, 0]])
    total, logs = model.unpacked(model.packed([b"a", b"b", b"c"], counts))
    assert total.tolist() == [5, (1 << 40) + 7, 0]
    assert np.allclose(logs[:2], model.log_words([b"a", b"b"], counts[:2]) / np.log(10), atol=0.0003)


def test_exchange_sums_plain_gradients_of_all_sure_rows(spark):
    """One exchange against a loop over dense rows, and the same however rows are dealt."""
    from hashloom.llm import quality as Q

    rng = np.random.default_rng(8)
    rows, dense = [], []
    for _ in range(200):
        at, meta = np.sort(rng.choice(Q.TEXT, 30, replace=False)), np.sort(rng.choice(Q.META, 4, replace=False))
        x = rng.random(30).astype("<f2")
        rows.append((at.astype("<u2").tobytes(), x.tobytes(), meta.astype("<u2").tobytes()))
        dense.append((at, x.astype(float), meta, np.ones(4)))
    pool = spark.createDataFrame(rows, "at binary, x binary, meta binary")
    w = [rng.normal(size=Q.TEXT + 1) * 2, rng.normal(size=Q.META + 1) * 2]
    teachers = [(w[0], 1.5, 0.2), (w[1], 0.8, -0.1)]
    now = [rng.normal(size=len(x)) for x in w]
    want = [[np.zeros(Q.TEXT + 2), np.zeros(Q.TEXT + 2)], [np.zeros(Q.META + 2), np.zeros(Q.META + 2)]]
    for at, x, meta, ones in dense:
        sides = ((at, x), (meta, ones))
        p = [1 / (1 + math.exp(-(a * ((v * t[i]).sum() + t[-1]) + b))) for (i, v), (t, a, b) in zip(sides, teachers)]
        for view in (0, 1):
            sure = p[1 - view]
            label = 1 if sure >= Q.SURE_GOOD else 0 if sure <= 1 - Q.SURE_BAD else None
            if label is not None:
                i, v = sides[view]
                e = 1 / (1 + math.exp(-((v * now[view][i]).sum() + now[view][-1]))) - label
                want[view][label][i] += v * e
                want[view][label][-2:] += e, 1
    assert all(x[-1] > 5 for view in want for x in view)
    one, many = (Q._exchanged(pool.repartition(n), teachers, now) for n in (1, 7))
    for view in (0, 1):
        for label in (0, 1):
            assert np.allclose(one[view][label], want[view][label], atol=1e-3)
            assert np.allclose(one[view][label], many[view][label], atol=1e-4)


def test_pseudo_labels_move_the_views():
    """A view learns of a feature that labelled rows never show, from the other view's labels."""
    from hashloom.llm import quality as Q

    y = np.array([0.0, 1.0] * 30)
    text = Q.Rows(np.ones(60, int), np.where(y == 1, 5, 6), np.ones(60, np.float32), Q.TEXT)
    meta = Q.Rows(np.ones(60, int), np.where(y == 1, 7, 8), np.ones(60, np.float32), Q.META)
    both = Q.CoTraining(text, meta, y)
    assert both.fits[0].w[9] == 0
    pool = Q.Rows(np.ones(40, int), np.full(40, 9), np.ones(40, np.float32), Q.TEXT), Q.Rows(np.ones(40, int), np.full(40, 7), np.ones(40, np.float32), Q.META)
    for _ in range(3):
        both.step(Q.pseudo_gradients(*pool, both.teachers(), [f.w for f in both.fits]))
    assert both.fits[0].w[9] > 0.1


def test_languages_against_plain_counts(documents):
    """Predictions of whole texts against n-gram counts, word scores and the best path
    written out one by one."""
    from hashloom.llm.language_id import BUCKETS, PENALTY, SMOOTH

    told = [("the cat and the hat sat on the mat", "en"), ("one more of the lines with words", "en"), ("der hund und die katze sind auf dem dach", "de"), ("ein wort und noch ein wort f\u00fcr den tag", "de"), ("le chat et le chien sont dans la maison", "fr")]
    asked = ["the dog and the cat", "die katze und der hund", "le chien est dans la rue", "the cat and die katze und der hund auf dem dach", "xyz", "a", "und the et der la of", "the hat on the mat le chat et le chien sont dans la maison"]
    model = learn(documents([(i, t, lang) for i, (t, lang) in enumerate(told)]))
    names = sorted({lang for _, lang in told})
    mask = (1 << 32) - 1

    def buckets(word):
        out = [zlib.crc32(word)]
        framed = b" " + word + b" "
        for n in (2, 3, 4):
            for a in range(len(framed) - n + 1):
                h = n
                for c, times in zip(framed[a : a + n], (2654435761, 2246822519, 3266489917, 668265263)):
                    h = (h ^ c) * times & mask
                    h ^= h >> 15
                out.append(h)
        return [((h * 2654435761 & mask) >> 8) % BUCKETS for h in out]

    def split(text):
        return re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]", b" ", text.lower().encode()).split()

    counts = {lang: Counter(b for t, of in told if of == lang for w in split(t) for b in buckets(w)) for lang in names}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in identify(documents(list(enumerate(asked))), model, "doc_id").collect()}
    for i, text in enumerate(asked):
        words = split(text)
        s = np.array([[sum(math.log((counts[lang][b] + SMOOTH) / (total[lang] + SMOOTH * BUCKETS)) for b in buckets(w)) / 3 for lang in names] for w in words])
        s -= s.max(1, keepdims=True)
        value, path = np.zeros(len(names)), [[] for _ in names]
        for row in s:
            best = int(value.argmax())
            moved = [(value[best] - PENALTY, path[best]) if value[k] < value[best] - PENALTY else (value[k], path[k]) for k in range(len(names))]
            value, path = np.array([v + row[k] for k, (v, _) in enumerate(moved)]), [[*p, k] for k, (_, p) in enumerate(moved)]
        labels = path[int(value.argmax())]
        share = [sum(len(w) for w, k in zip(words, labels) if k == j) for j in range(len(names))]
        assert got[i]["lang_pred"] == names[int(np.argmax(share))], text
        assert got[i]["score"] == pytest.approx(max(share) / sum(share)), text


def test_classes_and_spelling_are_fitted_on_everything(spark, monkeypatch):
    """Frequent words of all texts, centres that all texts have, and the spelling's weights
    from all words: more of both than the samples of 3,000 and 20,000 once were."""
    from hashloom.llm import context_mixing as M
    from hashloom.llm.common import Scratch, hash_of

    monkeypatch.setattr(M, "FREQUENT", 6)
    texts = [(i, f"{'le la les' if i % 3 else 'the of and'} w{i} {'the' if i % 7 else ''}") for i in range(3600)] + [(None, None)]
    train = spark.createDataFrame(texts, "doc_id bigint, text string")
    count = Counter(w.encode() for _, t in texts for w in tokens(t)[:-1])
    assert M._frequent(train) == sorted(count, key=lambda w: (-count[w], w))[:6]
    made = M.learned(train, Scratch(spark, "test"), 2)
    x = np.array([made.vectors(*M.coded_words([t or ""]))[0] for _, t in texts])
    x = np.rint(x[x.any(1)] * M.FINE)
    near = (x @ made.centres.T).argmax(1)
    sums = np.stack([x[near == j].sum(0) for j in (0, 1)])
    assert np.allclose(sums / np.linalg.norm(sums, axis=1, keepdims=True), made.centres)

    words = spark.createDataFrame([(f"v{i * 7919 % 100003}".encode(),) for i in range(21_000)], "word binary")
    got, want = M._spelling(words, 21_000), Speller()
    plain = [bytes(r["word"]) for r in words.orderBy(hash_of("word"), "word").collect()]
    want.count(plain)
    want.train(plain, 525)
    assert np.array_equal(got.counts, want.counts) and np.allclose(got.mixer.w, want.mixer.w)
    assert np.allclose(got.mixer.ones / got.mixer.seen, want.mixer.ones / want.mixer.seen)


def test_spelling_and_codes_are_told_once_for_all_that_share_them(monkeypatch):
    """The bits of equal bytes after equal ones are looked at once, and counted and priced
    as those of every word; texts' codes are compressed."""
    from hashloom.llm import context_mixing as M

    words = [f"wort{i % 90}s".encode() for i in range(4000)] + [b"", b"\xc3\xa9t\xc3\xa9"]
    seen, plain = [], Speller.bits
    monkeypatch.setattr(Speller, "bits", staticmethod(lambda codes: (seen.append(len(codes)), plain(codes))[1]))
    speller = Speller()
    speller.count(words)
    assert seen == [len({(b"    " + w + b" ")[i : i + 5] for w in words for i in range(len(w) + 1)})]
    assert speller.counts.sum() == 8 * len(M.ORDERS) * sum(len(w) + 1 for w in words)
    one = Speller()
    for w in words:
        one.count([w])
    assert np.array_equal(speller.counts, one.counts)
    speller.train(words, 500)
    assert np.allclose(speller.log_spell(words), [speller.log_spell([w])[0] for w in words])

    codes = np.random.default_rng(3).zipf(1.3, 3000).clip(0, 1 << 20)
    assert np.array_equal(M.unpacked_codes(M.packed_codes(codes), 3000), codes) and len(M.packed_codes(codes)) < 2 * 3000


def test_tasks_of_few_words_put_out_small_tables(spark, monkeypatch):
    """Tables of counts travel by their places that are not 0, so that words cost about
    the same on disk however many tasks they are dealt to."""
    from hashloom.llm import context_mixing as M

    rng = np.random.default_rng(5)
    for n in (np.zeros(9), np.zeros(0), rng.normal(size=500), np.array([0, -1.5, 0, 0, 1e300, np.inf, 2.0**53]), (rng.random(1 << 16) < 0.01) * 3.0):
        size, at, got = M.unpacked_table(M.packed_table(n))
        full = np.zeros(size)
        full[at] = got
        assert size == len(n) and np.array_equal(full, n)

    words = spark.createDataFrame([(f"v{i * 7919 % 100003}".encode(),) for i in range(4000)], "word binary")
    moved, plain = [], M._summed

    def measured(parts, *a):
        rows = parts.select("n").collect()
        moved.append((len(rows), sum(len(pa.compress(bytes(r["n"]), "lz4", asbytes=True)) for r in rows)))
        return plain(parts, *a)

    monkeypatch.setattr(M, "_summed", measured)
    monkeypatch.setattr(M, "SPELL_WORDS", 200)
    got, want = M._spelling(words, 4000), Speller()
    want.count([bytes(r["word"]) for r in words.collect()])
    assert np.array_equal(got.counts, want.counts)
    assert moved[0][0] > 100 and moved[0][1] < 600_000, moved
