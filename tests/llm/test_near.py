"""Near-duplicate texts and lines against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from hashloom.llm.common import Scratch, words
from hashloom.llm.components import components
from hashloom.llm.line_dedup import dedup_lines, edit_similarity, keep_lines, line_codes
from hashloom.llm.setsketch import REGISTERS, alike, estimate, keep_first, near_duplicates, registers, shingles


def sets_of(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def brute(docs, width, percent=80):
    s = {i: sets_of(t, width) for i, t in docs}
    ids = sorted(s)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return {i: len(x) for i, x in s.items()}, groups(ids, near)


def varied(rng, n, base=60, change=4):
    """A family of near copies, most of which are near others but not all."""
    text = [f"w{rng.randrange(500)}" for _ in range(base)]
    out = []
    for _ in range(n):
        x = list(text)
        for _ in range(rng.randrange(change)):
            x[rng.randrange(base)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(documents, width):
    rng = random.Random(width)
    texts = varied(rng, 120) + varied(rng, 30, 200, 20) + ["short", "short", "Short ", "two words", "two  WORDS", "x " * 4000, "x " * 4001] + [" ".join(f"u{rng.randrange(99999)}" for _ in range(40)) for _ in range(60)]
    docs = list(enumerate(texts)) + [(900, None), (901, ""), (902, "  \n")]
    rng.shuffle(docs)
    got = {r["doc_id"]: r for r in near_duplicates(documents(docs), width).collect()}
    n, comp = brute(docs, width)
    assert len(got) == len(docs)
    for i, _ in docs:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n[i], comp[i], comp[i] == i)


def test_near_duplicates_repeated_and_null_ids(documents):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (None, "a b c d e f"), (3, "a b c d e f")]
    got = near_duplicates(documents(docs), 2).collect()
    assert len(got) == 6 and {r["component_id"] for r in got if r["doc_id"] is not None} == {1}
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    # Each text of an id stands for itself: one row of either text stays.
    kept = keep_first(documents(docs), 2)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v")]
    assert near_duplicates(documents([]), 2).count() == 0


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shared in (100, 600, 950):
        a, b = np.unique(x[:1000]), np.unique(x[1000 - shared : 2000 - shared])
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = registers(a), registers(b)
        got = estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - want) < 5 * (0.25 / REGISTERS) ** 0.5
        assert (registers(np.union1d(a, b)) == np.maximum(ra, rb)).all()


def test_threshold_is_exact():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert alike(a, b, 80) and not alike(a, b + np.uint64(1), 80)
    assert [len(x) for x in shingles(["a b a b", "A", None, "a"], 2)] == [2, 1, 0, 1]


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(100, 140)]
    edges = path + [(500, x) for x in range(501, 560)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(50)] + [(7, 7), (3, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components(df, Scratch(spark, "test"), "c").collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == groups({x for e in real for x in e}, real)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edit_similarity():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ([bytes([rng.randint(97, 100)]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert edit_similarity(a, b) == pytest.approx(1 - plain_edits(a, b) / max(len(a), len(b), 1))


def test_lines(documents):
    rng = random.Random(7)
    family = varied(rng, 60, 80, 4)
    lines = family + [" ".join(f"u{rng.randrange(9999)}" for _ in range(12)) for _ in range(40)] + ["same line of five words"] * 5 + ["too short"] * 6 + ["", "  "]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 6 : i * 6 + 6])) for i in range(len(lines) // 6 + 1)] + [(100, None), (101, ""), (102, "\n"), (103, "SAME  line of five words"), (None, "no id: same line of five words")]
    got = {r["doc_id"]: r for r in dedup_lines(documents(docs)).collect()}
    where = [(i, j, tuple(words(x))) for i, t in docs if t for j, x in enumerate(t.split("\n")) if words(x)]
    distinct = sorted({w for _, _, w in where})
    near = [(distinct[a], distinct[b]) for a in range(len(distinct)) for b in range(a) if edit_similarity(list(distinct[a]), list(distinct[b])) >= 0.8]
    comp, met, gone = groups(distinct, near), defaultdict(list), defaultdict(list)
    for i, j, w in where:
        met[comp[w]].append((i is not None, i or 0, j, i))
    for x in met.values():
        for _, _, j, i in sorted(x, key=lambda y: y[:3])[1:]:
            gone[i].append(j)
    assert near and len(got) == len(docs)
    for i, t in docs:
        assert got[i]["__removed"] == sorted(gone[i]), i
        left = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i])
        assert got[i]["text"] == left and got[i]["score"] == "x"
    kept = keep_lines(documents(docs))
    assert kept.columns == documents(docs).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in docs if not gone[i] or words(got[i]["text"])}


def test_lines_of_repeated_rows_and_nothing(documents):
    docs = [(1, "one two three four five"), (1, "one two three four five"), (2, "one two three four five")]
    got = sorted((r["doc_id"], r["text"]) for r in dedup_lines(documents(docs)).collect())
    assert got == [(1, "one two three four five"), (1, "one two three four five"), (2, "")]
    assert dedup_lines(documents([])).count() == 0


def test_lines_beyond_three_bits(documents):
    """All pairs at the threshold, whatever their codes, by edit similarity alone."""
    rng = random.Random(11)
    lines = []
    for n in (5, 6, 9, 10, 14, 20, 35, 60):
        for f in range(4):
            base = [f"w{n}x{f}y{rng.randrange(99)}" for _ in range(n)]
            lines.append(" ".join(base))
            for d in range(1, n // 5 + 2):
                changed = list(base)
                for i in rng.sample(range(n), d):
                    changed[i] = rng.choice(["", "new two", f"z{rng.randrange(9999)}"])
                lines.append(" ".join(changed))
            # Edits at even distances leave the shortest runs.
            lines.append(" ".join("e" if i % 5 == 4 else w for i, w in enumerate(base)))
    lines = [x for x in lines if len(words(x)) >= 5]
    got = {r["doc_id"]: r["__removed"] for r in dedup_lines(documents(list(enumerate(lines))), whole=True).collect()}
    distinct = sorted({tuple(words(x)) for x in lines})
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if edit_similarity(list(a), list(b)) >= 0.8]
    sims = dict(zip(distinct, line_codes([b" ".join(w).decode() for w in distinct])[1], strict=True))
    assert sum(int(sims[a] ^ sims[b]).bit_count() > 3 for a, b in pairs) > len(pairs) / 2
    comp, kept = groups(distinct, pairs), {}
    for i, x in enumerate(lines):
        kept.setdefault(comp[tuple(words(x))], i)
    assert got == {i: [] if kept[comp[tuple(words(x))]] == i else [0] for i, x in enumerate(lines)}


def test_links_of_every_text_of_an_id(documents):
    """Rows that repeat an id lose no link, whichever of its texts has it."""
    rng = random.Random(3)
    a, b = ([f"{c}{rng.randrange(999)}" for _ in range(80)] for c in "ab")
    near = lambda x: " ".join([*x[:40], "changed", *x[41:]])
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "quite another text"), (5, None), (5, "quite another text")]
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(documents(docs), 2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}
    kept = keep_first(documents(docs), 2)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [(1, " ".join(a)), (1, " ".join(b)), (4, "quite another text")]


def test_cells_meet_every_pair_once(spark):
    """Every pair with an end outside the largest component meets in one cell, and cells are bounded."""
    from hashloom.llm.buckets import CELL, cells, meetings

    members = [(1, 0, i, 1) for i in range(900)] + [(2, 0, i, 1) for i in range(50)] + [(3, 0, i, 1) for i in range(7)]
    comp = {i: i // 300 * 300 if i < 600 else i for i in range(900)}
    comps = spark.createDataFrame([(i, c) for i, c in comp.items() if c != i or i in (0, 300)], "id bigint, component bigint")
    got = cells(spark.createDataFrame(members, "key bigint, band int, id bigint, load bigint"), comps, 64).toPandas()
    met = defaultdict(int)
    for (key, *_), cell in got.groupby(CELL):
        assert len(cell) <= 200
        ids = cell["id"].to_numpy()
        for i, others in meetings(cell["part"].to_numpy(), cell["comp"].to_numpy(), bool(cell["own"].iloc[0])):
            for j in others:
                met[key, *sorted((int(ids[i]), int(ids[j])))] += 1
    largest = {1: 0, 2: 0}
    want = {(k, a, b) for k, n in ((1, 900), (2, 50)) for b in range(n) for a in range(b) if comp[a] != comp[b] and k in largest}
    assert set(met) == want and set(met.values()) <= {1}
    assert len({tuple(x) for x in got[got["key"] == 1][CELL].to_numpy()}) > 30


def test_keep_first_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, 2, 3), (2, "a b c d e f g", 4, 5, 6)], "doc_id bigint, text string, `gone.x` int, component int, __print int")
    left = keep_first(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "a b c d e f g", 1, 2, 3)]
    assert keep_first(docs.where("doc_id > 5")).count() == 0


def recall_of_candidates(lines, links_of):
    distinct = sorted({tuple(words(x)) for x in lines if words(x)})
    near = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and edit_similarity(list(a), list(b)) >= 0.8]
    comp = links_of(distinct)
    by_length = defaultdict(list)
    for a, b in near:
        by_length[min(len(a) // 10 * 10, 60)].append(comp[a] == comp[b])
    return {n: (len(x), sum(x) / len(x)) for n, x in sorted(by_length.items())}


def test_recall_of_line_pairs_by_length(documents):
    """Pairs (not groups) at the threshold against all pairs by edit similarity: each
    base has one variant at just 0.8, so nothing else can link the two."""
    rng = random.Random(21)
    pairs = []
    for n in (5, 7, 9, 12, 15, 20, 25, 30, 40, 50, 70, 100, 200):
        for f in range(60):
            base = [f"q{n}x{f}y{rng.randrange(10**6)}" for _ in range(n)]
            changed, out = set(rng.sample(range(n), n // 5)), []
            for i, w in enumerate(base):
                out.append(f"z{rng.randrange(10**6)}" if i in changed else w)
            pairs.append((" ".join(base), " ".join(out)))
    lines = [x for p in pairs for x in p]

    def links_of(distinct):
        removed = {r["doc_id"]: r["__removed"] for r in dedup_lines(documents(list(enumerate(lines)))).collect()}
        return {tuple(words(x)): i - 1 if removed[i] else i for i, x in enumerate(lines)}

    found = recall_of_candidates(lines, links_of)
    assert all(share >= 0.9 for _, share in found.values()), found


def test_hot_blocks_are_cut(documents, monkeypatch):
    from hashloom.llm import line_dedup as L

    monkeypatch.setattr(L, "HOT", 20)
    monkeypatch.setattr(L, "CHUNK", 16)
    rng = random.Random(5)
    lines = [f"{a} {b} one of the {c} {d} {e}" for a, b, c, d, e in ([f"v{rng.randrange(10**6)}" for _ in range(5)] for _ in range(150))]
    copies = [x.split() for x in lines[:60]]
    for x in copies:
        x[0] = "changed"
    docs = list(enumerate(lines + [" ".join(x) for x in copies]))
    got = {r["doc_id"]: r["__removed"] for r in dedup_lines(documents(docs)).collect()}
    assert got == {i: [0] if i >= 150 else [] for i, _ in docs}


def test_pairs_beyond_simhash_and_of_four_words(documents):
    """Every pair at the threshold is linked, however far its SimHashes are, and a line of
    four words with the one of five that has one more."""
    rng = random.Random(31)
    lines = []
    for f in range(60):
        base = [f"{'xyz'[f % 3] * 3}{rng.randrange(10**6)}" for _ in range(4)]
        lines += [" ".join(base), " ".join(base[: f % 5] + [f"m{f}"] + base[f % 5 :])]
    for f in range(40):
        # Few different words, so that two others turn much of the SimHash.
        lines += [" ".join([f"r{f}"] * 4 + [f"{c}{rng.randrange(10**6)}" for c in two] + [f"r{f}"] * 4) for two in ("pq", "st")]
    sims = line_codes(lines)[1]
    assert max(int(a ^ b).bit_count() for a, b in zip(sims[::2], sims[1::2], strict=True)) > 24
    got = {r["doc_id"]: r["__removed"] for r in dedup_lines(documents(list(enumerate(lines)))).collect()}
    assert got == {i: [0] if i % 2 else [] for i in range(len(lines))}


def test_long_lines_share_more_than_a_sketch(documents):
    """Of long lines, of which every fifth word is another, no pair is missed."""
    rng = random.Random(37)
    lines = []
    for n in (50, 120, 400):
        for f in range(40):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            lines += [" ".join(base), " ".join(f"v{rng.randrange(10**8)}" if i % 5 == 4 else w for i, w in enumerate(base))]
    got = {r["doc_id"]: r["__removed"] for r in dedup_lines(documents(list(enumerate(lines)))).collect()}
    assert got == {i: [0] if i % 2 else [] for i in range(len(lines))}


def test_lines_travel_and_lie_in_packs(documents):
    """Each different line is in one pack, and packs take less than half of the lines' bytes."""
    from hashloom.llm.line_dedup import _classes, unpacked

    rng = random.Random(41)
    lines = [" ".join(f"word{rng.randrange(500)}" for _ in range(30)) for _ in range(1500)]
    docs = [(i, "\n".join(lines[i * 10 : i * 10 + 20])) for i in range(150)] + [(999, None), (1000, "one two")]
    rows = _classes(documents(docs), 3, 3).collect()
    found = [v for r in rows for v in unpacked(r["h"], r["size"], r["lines"])[1]]
    assert sorted(found) == sorted({x.encode() for x in lines}) and len({r["chunk"] for r in rows}) == len(rows) <= 3
    assert sum(len(r["lines"]) for r in rows) < sum(map(len, found)) / 2


def test_packs_in_tables_are_tight(documents):
    """Packs that lie in a table take less than at the level of packs that only travel."""
    from hashloom.llm.line_dedup import _classes, packed, unpacked

    rng = random.Random(43)
    lines = ["\n".join(" ".join(f"word{int(rng.paretovariate(0.6)) % 3000}" for _ in range(40)) for _ in range(20)) for _ in range(150)]
    rows = _classes(documents(list(enumerate(lines))), 2, 3).collect()
    found = [(len(r["lines"]), unpacked(r["h"], r["size"], r["lines"])) for r in rows]
    assert sorted(v for _, (_, x) in found for v in x) == sorted(v.encode() for v in set("\n".join(lines).split("\n")))
    assert sum(n for n, _ in found) < 0.97 * sum(len(packed(h, x)[2]) for _, (h, x) in found)
