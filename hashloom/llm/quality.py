"""A quality classifier by co-training over two views of a document.

One view is the text: hashed words and word shapes, and how repetitive and
symbol-laden it is. The other is the page's metadata: source, language and
length. Each view has a logistic classifier, fitted on labelled rows first. In
each round both views score all documents without a label, wherever they are;
each document of which a view is sure, by calibrated probabilities, is a
pseudo-label for the other view. The views learn from them by gradient steps:
tasks sum the gradients over all such documents, and the labelled rows' own
gradient is added with twice the weight of all pseudo-labels, both classes
weighing the same. So nothing depends on how many documents there are but how
much they tell. At the end each view is calibrated on labelled rows kept apart,
their log odds are combined by a logistic model of those rows, and every
document is scored.

Only the labelled rows are a bounded sample: at most ``labelled`` of them,
those of the smallest hashes of their ids. Gradients are summed as whole
numbers, so reruns agree. All documents are scored on their whole texts.

Nulls: a null text or one without words is rejected with score 0; a null
source, lang or length is a value of its own. Labels that repeat a document
count by their mean; of rows that repeat a labelled id, the text of the
smallest hash is learned from. Where the labels lack one of the two classes
nothing can be learned, and every document with words is kept with score 0.5.
"""

from __future__ import annotations

import math
import re
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.llm.common import Scratch, coded_words, hash_of, tidy

#: Labelled rows at most; rounds of exchange, and gradient steps over all documents in each.
LABELLED, ROUNDS, STEPS = 6000, 3, 3
#: Share of all pseudo-labels in a step, the rest being the labelled rows'.
PSEUDO = 1 / 3
WORDS, SHAPES, WHOLE, META = 1 << 14, 1 << 12, 6, 1 << 12
TEXT = WORDS + SHAPES + WHOLE
SURE_GOOD, SURE_BAD = 0.98, 0.9
MEMORY, DOCS = 1 << 17, 500
#: Gradients are summed in steps of GRAIN, in blocks of so many numbers, and first by so many tasks.
GRAIN, BLOCK, SALTS = 2.0**-20, 4096, 16

_SHAPE = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


def shape(word: bytes) -> bytes:
    """Runs of small letters, capitals and digits as one sign each; the rest as it is."""
    for run, sign in _SHAPE:
        word = run.sub(sign, word)
    return word


class TextView:
    """Sparse features of whole texts, remembering words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.places = np.zeros((1 << 12, 2), np.int32)

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.known)
        while n + len(words) > len(self.places):
            self.places = np.concatenate([self.places, np.zeros_like(self.places)])
        for i, w in enumerate(words, n):
            self.places[i] = crc32(w.lower()) % WORDS, WORDS + crc32(shape(w)) % SHAPES
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def places_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word and shape place of each word, words of each text, features of the whole."""
        if len(self.known) > MEMORY:
            self.__init__()
        codes, sizes, words = coded_words(texts, lower=False)
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([words[i] for i in new])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pair = np.sort(doc * max(1, len(words)) + codes)
        distinct = np.bincount(pair[np.diff(pair, prepend=-1) > 0] // max(1, len(words)), minlength=len(sizes))
        whole = np.zeros((len(sizes), WHOLE), np.float32)
        for i in np.flatnonzero(sizes).tolist():
            lines, n = texts[i].split("\n"), int(sizes[i])
            whole[i] = 1, distinct[i] / n, len(set(lines)) / len(lines), len(lines) / n, len(texts[i]) / n / 10, math.log(n) / 10
        # A text without white space must not outweigh all else.
        return self.places[place[codes]], sizes, np.minimum(whole, 1000)

    def sparse(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and values of each text's features."""
        places, sizes, whole = self.places_of(texts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pair = np.sort((doc[:, None] * TEXT + places).reshape(-1))
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        of, at = pair[first] // TEXT, pair[first] % TEXT
        x = (np.diff(np.append(first, len(pair))) * 4 / np.maximum(sizes[of], 1)).astype(np.float32)
        cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
        own = np.arange(TEXT - WHOLE, TEXT)
        return [(np.concatenate([at[a:b], own]), np.concatenate([x[a:b], w])) for a, b, w in zip(cuts, cuts[1:], whole)]

    def odds(self, texts: list[str | None], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linear score of each text under weights w (bias last), and its words."""
        places, sizes, whole = self.places_of(texts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        per_word = w[places].sum(1)
        return np.bincount(doc, per_word, len(sizes)) / np.maximum(sizes, 1) * 4 + whole @ w[TEXT - WHOLE : TEXT] + w[-1], sizes


def meta_features(source, lang, n_chars) -> list[np.ndarray]:
    """Places of the metadata's features; each has value 1."""
    out = []
    for s, lang_, n in zip(source, lang, n_chars, strict=True):
        size = "none" if n is None or pd.isna(n) else str(int(2 * math.log2(max(float(n), 1))))
        keys = f"s{s}", f"l{lang_}", f"n{size}", f"s{s}l{lang_}", f"l{lang_}n{size}"
        out.append(np.unique([crc32(k.encode("utf-8", "surrogatepass")) % META for k in keys]))
    return out


class Rows:
    """Sparse rows for fitting."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, x: np.ndarray, width: int):
        """sizes: features of each row; at, x: their places and values, row after row."""
        self.n, self.width = len(sizes), width
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.at, self.x = at, x

    def odds(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.x * w[self.at], self.n) + w[-1]

    def gradient(self, w: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sum of the rows' gradients, the bias last."""
        e = (sigmoid(self.odds(w)) - y) * weight
        return np.append(np.bincount(self.at, self.x * e[self.row], self.width), e.sum())


class Fit:
    """Weights and bias of a logistic model, moved by AdaGrad."""

    def __init__(self, width: int, rate: float = 0.3, decay: float = 1e-4):
        self.w, self.g2 = np.zeros(width + 1), np.full(width + 1, 1e-8)
        self.rate, self.decay = rate, decay

    def step(self, g: np.ndarray) -> None:
        g = g + self.decay * np.append(self.w[:-1], 0.0)
        self.g2 += g * g
        self.w = self.w - self.rate * g / np.sqrt(self.g2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """A small dense logistic model (bias last), by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        move = np.linalg.solve(h, z.T @ (p - y) + ridge * w)
        w -= np.clip(move, -2, 2)
        if abs(move).max() < 1e-8:
            break
    return w


class CoTrained:
    """Weights of both views, and of their combination (text, meta, bias)."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, combined: np.ndarray):
        self.text, self.meta, self.combined = text, meta, combined


def balanced(y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Weights of the rows in use, that sum to a half for either class."""
    share = lambda mask: np.where(mask, 0.5 / max(1, mask.sum()), 0.0)
    return share(use & (y == 1)) + share(use & (y == 0))


class CoTraining:
    """Both views while they are fitted, on the labelled rows and on what the tasks sum up."""

    def __init__(self, text: Rows, meta: Rows, y: np.ndarray, steps: int = 150):
        """y: 1 or 0. Every fifth labelled row calibrates."""
        self.views, self.y = (text, meta), y
        self.apart = np.zeros(len(y), bool)
        self.apart[::5] = True
        self.train = ~self.apart
        if len(set(y[self.train])) < 2 or len(set(y[self.apart])) < 2:
            self.train = self.apart = np.ones(len(y), bool)
        self.weight = balanced(y, self.train)
        self.fits = [Fit(view.width) for view in self.views]
        for view, fit in zip(self.views, self.fits, strict=True):
            for _ in range(steps):
                fit.step(view.gradient(fit.w, y, self.weight))

    def teachers(self) -> list[tuple[np.ndarray, float, float]]:
        """Weights of each view, and factor and offset that calibrate its odds."""
        return [(fit.w, *logistic(view.odds(fit.w)[self.apart][:, None], self.y[self.apart])) for view, fit in zip(self.views, self.fits, strict=True)]

    def step(self, sums: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """sums: for each view, of the pseudo-labels 0 and 1, gradients and count."""
        for view, fit, classes in zip(self.views, self.fits, sums, strict=True):
            g, told = view.gradient(fit.w, self.y, self.weight), [x[:-1] / x[-1] for x in classes if x[-1] > 0]
            fit.step(g if not told else (1 - PSEUDO) * g + PSEUDO * sum(told) / len(told))

    def finished(self) -> CoTrained:
        # Raw odds go in, so the combination also holds each view's calibration.
        raw = np.column_stack([view.odds(fit.w) for view, fit in zip(self.views, self.fits, strict=True)])
        return CoTrained(self.fits[0].w, self.fits[1].w, logistic(raw[self.apart], self.y[self.apart]))


def pseudo_gradients(text: Rows, meta: Rows, teachers: list, weights: list[np.ndarray]) -> list[list[np.ndarray]]:
    """For each view and pseudo-label (0, 1): the sum of gradients over the rows that
    the other view is sure of, and how many these are."""
    views, out = (text, meta), []
    told = [view.odds(w) for view, (w, _, _) in zip(views, teachers, strict=True)]
    sure = [sigmoid(z * a + b) for z, (_, a, b) in zip(told, teachers, strict=True)]
    for view, z, (own, _, _), p, w in zip(views, told, teachers, reversed(sure), weights, strict=True):
        label = np.where(p >= SURE_GOOD, 1, np.where(p <= 1 - SURE_BAD, 0, -1))
        e = sigmoid(z if np.array_equal(own, w) else view.odds(w)) - label
        # Both labels' sums at once, over the features of rows that have one.
        use = (label >= 0)[view.row]
        row, at = view.row[use], view.at[use]
        sums = np.bincount(at + label[row] * view.width, view.x[use] * e[row], 2 * view.width)
        for k in (0, 1):
            mine = label == k
            out.append(np.concatenate([sums[k * view.width : (k + 1) * view.width], [e[mine].sum(), mine.sum()]]))
    return [out[:2], out[2:]]


def _rows_of(pdf: pd.DataFrame) -> tuple[Rows, Rows]:
    whole = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
    sizes = lambda c, kind: np.fromiter(map(len, pdf[c]), np.int64, len(pdf)) // np.dtype(kind).itemsize
    meta = whole("meta", "<u2").astype(np.int64)
    return Rows(sizes("at", "<u2"), whole("at", "<u2").astype(np.int64), whole("x", "<f2").astype(np.float32), TEXT), Rows(sizes("meta", "<u2"), meta, np.ones(len(meta), np.float32), META)


def _exchanged(pool: DataFrame, teachers: list, weights: list[np.ndarray]) -> list[list[np.ndarray]]:
    """pseudo_gradients summed over all rows of the pool."""
    spark = pool.sparkSession
    shared = spark.sparkContext.broadcast((teachers, weights))

    @tidy
    def local(batches):
        from pyspark import TaskContext

        total: np.ndarray | int = 0
        for pdf in batches:
            for i in range(0, len(pdf), 4 * DOCS):
                got = pseudo_gradients(*_rows_of(pdf.iloc[i : i + 4 * DOCS]), *shared.value)
                total = total + np.rint(np.concatenate([x for view in got for x in view]) / GRAIN).astype(np.int64)
        if not isinstance(total, int):
            cuts = np.array_split(total, range(BLOCK, len(total), BLOCK))
            yield pd.DataFrame({"block": range(len(cuts)), "salt": TaskContext.get().partitionId() % SALTS, "n": cuts})

    @tidy
    def added(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for block, salt, n in zip(pdf["block"], pdf["salt"], pdf["n"], strict=True):
                sums[block, salt] = sums.get((block, salt), 0) + np.asarray(n, np.int64)
        for (block, salt), n in sums.items():
            yield pd.DataFrame({"block": [block], "salt": [salt], "n": [n]})

    # Summed in two steps, so that no task meets the sums of all.
    schema = "block int, salt int, n array<bigint>"
    some = pool.mapInPandas(local, schema).repartition(SALTS, "salt").mapInPandas(added, schema)
    got = some.withColumn("salt", F.lit(0)).coalesce(1).mapInPandas(added, schema).toPandas().sort_values("block")
    sizes = [TEXT + 2, TEXT + 2, META + 2, META + 2]
    flat = np.concatenate(list(got["n"])) * GRAIN if len(got) else np.zeros(sum(sizes))
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    shared.destroy()
    return [parts[:2], parts[2:]]


def _features(docs: DataFrame) -> DataFrame:
    """Sparse features of documents, made on the executors."""

    @tidy
    def make(batches):
        view = TextView()
        for pdf in batches:
            for i in range(0, len(pdf), DOCS):
                part = pdf.iloc[i : i + DOCS]
                sparse = view.sparse(list(part["text"]))
                meta = meta_features(part["source"], part["lang"], part["n_chars"])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "print": part["print"], "y": part["y"], "at": [a.astype("<u2").tobytes() for a, _ in sparse], "x": [v.astype("<f2").tobytes() for _, v in sparse], "meta": [m.astype("<u2").tobytes() for m in meta]})

    return docs.mapInPandas(make, "doc_id bigint, print bigint, y double, at binary, x binary, meta binary")


def _columns(docs: DataFrame) -> list:
    """The columns read, null where docs lacks one of the metadata."""
    has = set(docs.columns)
    return [F.col(c).cast("string").alias(c) if c in has else F.lit(None).cast("string").alias(c) for c in ("source", "lang")] + [F.col("n_chars").cast("double").alias("n_chars") if "n_chars" in has else F.lit(None).cast("double").alias("n_chars")]


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, steps: int = STEPS) -> CoTrained | None:
    """A classifier from docs and labels (doc_id, quality 0 or 1): at most so many
    labelled rows, and all documents beside them."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(hash_of("doc_id"), F.col("doc_id")).limit(labelled)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("print"), "text", *_columns(docs))
    # Bounded by the limit, so it may be broadcast.
    marked = rows.join(F.broadcast(chosen), "doc_id", "left")
    made = scratch.save(_features(marked), "features")
    one = F.min(F.struct("print", "y", "at", "x", "meta")).alias("one")
    got = made.where("y is not null").groupBy("doc_id").agg(one).select("doc_id", "one.*").toArrow().sort_by("doc_id").to_pandas()
    if got["y"].nunique() < 2:
        return None
    both = CoTraining(*_rows_of(got), got["y"].to_numpy(float))
    pool = made.where("y is null").select("at", "x", "meta")
    for _ in range(rounds):
        teachers = both.teachers()
        for _ in range(steps):
            both.step(_exchanged(pool, teachers, [fit.w for fit in both.fits]))
    scratch.drop("features")
    return both.finished()


def _judged(batches, model: CoTrained | None, threshold: float, text: str = "text"):
    """Pandas batches with text_score, meta_score, score and kept of their rows."""
    view = TextView()
    for pdf in batches:
        for i in range(0, len(pdf), DOCS):
            part = pdf.iloc[i : i + DOCS]
            texts = list(part[text])
            if model is None:
                sizes = coded_words(texts)[1]
                a, b, p = np.zeros(len(part)), np.zeros(len(part)), np.full(len(part), 0.5)
            else:
                a, sizes = view.odds(texts, model.text)
                columns = (part[c] if c in part else [None] * len(part) for c in ("source", "lang", "n_chars"))
                b = np.array([model.meta[x].sum() + model.meta[-1] for x in meta_features(*columns)])
                p = sigmoid(a * model.combined[0] + b * model.combined[1] + model.combined[2])
            score = np.where(sizes > 0, p, 0.0)
            yield part, pd.DataFrame({"text_score": a, "meta_score": b, "score": score, "kept": (sizes > 0) & ((score >= threshold) | (model is None))}, index=part.index)


def score_quality(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score (log odds of the views), score (probability
    of good quality) and kept (score at least threshold) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *_columns(docs))

    @tidy
    def judge(batches):
        for part, got in _judged(batches, shared.value, threshold):
            yield part[["doc_id"]].astype("Int64").join(got)

    return rows.mapInPandas(judge, "doc_id bigint, text_score double, meta_score double, score double, kept boolean")


def keep_good(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier keeps, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # The row itself travels beside the metadata, so its columns may have any names.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    judged = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *_columns(docs))
    schema = T.StructType([T.StructField(names[f.name], f.dataType) for f in docs.schema.fields])

    @tidy
    def judge(batches):
        for part, got in _judged(batches, shared.value, threshold, names["text"]):
            yield part.loc[got["kept"], list(names.values())]

    return judged.mapInPandas(judge, schema).toDF(*docs.columns)
