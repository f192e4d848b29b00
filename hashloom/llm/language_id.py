"""Language of texts: script ranges narrow the candidates of each word, and a
Viterbi path over per-word scores with a switching penalty labels spans.

A word (a run of letters) gets, for each candidate language, the log
probability of its hashed byte n-grams and of itself, learned from all
training texts. A language is a candidate for a word if it uses the script of
the word's letters in the training texts. The path over a text's words may
change language at a fixed cost, so a text in two languages becomes spans. The
language of the text is the one whose spans hold the most bytes of words, ties
to the smaller name; the score is their share.

Nulls: a null text, or one without letters, is "und" with score 0. Texts whose
letters are all of unknown scripts take the commonest training language, with
score 0; so does everything if nothing could be learned ("und" then). Rows
with a null lang are not learned from. Repeated rows count each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import tidy

#: Where the blocks of a script begin, by code point.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"),
    (0x31F0, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xF900, "han"), (0x20000, "han"),
)
_STARTS = [a for a, _ in SCRIPTS]

#: ASCII letters and all bytes of other characters stay; the rest parts words.
_PARTS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
NGRAMS = (2, 3, 4)
_TIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
TABLE = 1 << 22
BUCKETS = 1 << 16
SMOOTH, PENALTY, SCRIPT_SHARE = 0.5, 6.0, 0.001
MEMORY, DOCS = 1 << 19, 2000


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).split()


def script_of(word: bytes) -> str:
    """Script of the word's first letter beyond ASCII, latin if it has none."""
    if word.isascii():
        return "latin"
    for c in word.decode("utf-8", "replace"):
        if c > "\x7f" and c.isalpha():
            at = bisect_right(_STARTS, ord(c)) - 1
            return SCRIPTS[at][1]
    return "latin" if any(c.isalpha() for c in word.decode("utf-8", "replace")) else ""


def hashed(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams and whole forms of words, and the word of each."""
    line = b" " + b" ".join(words) + b" "
    b = np.frombuffer(line, np.uint8).astype(np.uint32)
    space = b == 32
    word = np.cumsum(space) - 1
    word[space] = np.minimum(word[space], len(words) - 1)
    got, of = [np.fromiter(map(crc32, words), np.uint32, len(words))], [np.arange(len(words))]
    for n in NGRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h, ok = np.full(m, n, np.uint32), np.ones(m, bool)
        for i in range(n):
            h = (h ^ b[i : i + m]) * _TIMES[i]
            h ^= h >> np.uint32(15)
            if 0 < i < n - 1:
                ok &= ~space[i : i + m]
        at = np.flatnonzero(ok)
        got.append(h[at])
        of.append(word[at])
    h = np.concatenate(got)
    return ((h * np.uint32(2654435761)) >> np.uint32(8)).astype(np.int64) % buckets, np.concatenate(of)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each row of scores (words of consecutive texts x languages); all
    texts go forward together, a word at a time."""
    order = np.argsort(-sizes, kind="stable")
    begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    back = np.zeros(scores.shape, np.int16)
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t, k in enumerate(active):
        rows, v = begin[:k] + t, value[:k]
        best = v.argmax(1)
        change = v[np.arange(k), best] - penalty
        switch = v < change[:, None]
        back[rows] = np.where(switch, best[:, None], own)
        value[:k] = np.where(switch, change[:, None], v) + scores[rows]
    out, now = np.zeros(len(scores), np.int16), value.argmax(1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        rows = begin[:k] + t
        out[rows] = now[:k]
        now[:k] = back[rows, now[:k]]
    return out


class Model:
    """Languages by name, log probabilities (buckets x languages), candidates by script."""

    def __init__(self, names: list[str], logs: np.ndarray, candidates: dict[str, np.ndarray], common: int, penalty: float):
        self.names, self.logs, self.candidates, self.common, self.penalty = names, logs, candidates, common, penalty

    @classmethod
    def learned(cls, counts: pd.DataFrame, scripts: pd.DataFrame, buckets: int, penalty: float) -> Model | None:
        names = sorted(set(scripts["lang"]))
        if not names:
            return None
        at = {x: i for i, x in enumerate(names)}
        table = np.zeros((buckets, len(names)))
        table[counts["bucket"].to_numpy(np.int64), counts["lang"].map(at).to_numpy(np.int64)] = counts["n"]
        logs = np.log((table + SMOOTH) / (table.sum(0) + SMOOTH * buckets)).astype(np.float32)
        of = scripts.groupby("lang")["n"].transform("sum")
        used = scripts[(scripts["n"] >= SCRIPT_SHARE * of) & (scripts["script"] != "")]
        candidates = {s: np.isin(np.arange(len(names)), g.map(at)) for s, g in used.groupby("script")["lang"]}
        total = scripts.groupby("lang")["n"].sum()
        return cls(names, logs, candidates, at[sorted(total[total == total.max()].index)[0]], penalty)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each word in each language, a constant a word apart."""
        at, of = hashed(words, len(self.logs))
        out = np.stack([np.bincount(of, self.logs[at, j], len(words)) for j in range(len(self.names))], 1) / len(NGRAMS)
        for i, script in enumerate(map(script_of, words)):
            can = self.candidates.get(script)
            out[i] = 0 if can is None else np.where(can, out[i] - out[i][can].max(), -50)
        return out.astype(np.float32)


class Tagger:
    """Predicts with a model, remembering the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.names)), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.known)
        while n + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[n : n + len(words)] = self.model.score(words)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def label(self, texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray]:
        """The words of each text, and the language of each word, one text after the other."""
        if len(self.known) > MEMORY:
            self._clear()
        words = [words_of(x) if x else [] for x in texts]
        flat = [w for x in words for w in x]
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(list(dict.fromkeys(flat[i] for i in new)))
            at[new] = [self.known[flat[i]] for i in new]
        scores = self.scores[at]
        return words, viterbi(scores, np.fromiter(map(len, words), np.int64, len(words)), self.model.penalty), scores

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words, labels, scores = self.label(texts)
        n = len(self.model.names)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(words)), sizes)
        bytes_ = np.fromiter((len(w) for x in words for w in x), np.int64, int(sizes.sum()))
        known = scores.any(1) | (n == 1)
        share = np.bincount(doc * n + labels, bytes_ * known, len(words) * n).reshape(-1, n)
        best, total = share.argmax(1), share.sum(1)
        names, score = [], np.zeros(len(words))
        for i, text in enumerate(texts):
            if not text or not _LETTER.search(text):
                names.append("und")
            elif not total[i]:
                names.append(self.model.names[self.model.common])
            else:
                names.append(self.model.names[best[i]])
                score[i] = share[i, best[i]] / total[i]
        return names, score

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Language, first word and end of each span of a text's words."""
        words, labels, _ = self.label([text])
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(labels)] if len(labels) else [0]
        return [(self.model.names[labels[a]], int(a), int(b)) for a, b in zip(cuts, cuts[1:])]


def learn(docs: DataFrame, penalty: float = PENALTY) -> Model | None:
    """A model of docs (text, lang), from all rows that have both.

    Counts are summed in tasks first; what reaches the driver is the table,
    of at most 2^22 counts, as buckets get fewer where languages are many.
    """
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    languages = rows.select("lang").distinct().count()
    if languages > TABLE >> 6:
        raise ValueError(f"{languages} languages; at most {TABLE >> 6} can be told apart")
    buckets = min(BUCKETS, TABLE // max(1, languages))

    @tidy
    def count(batches):
        tables: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()

        def add(seen: dict[str, Counter]):
            for lang, counter in seen.items():
                if not counter:
                    continue
                words, n = list(counter), np.fromiter(counter.values(), np.float64, len(counter))
                at, of = hashed(words, buckets)
                tables.setdefault(lang, np.zeros(buckets))
                tables[lang] += np.bincount(at, n[of], buckets)
                for w, m in counter.items():
                    scripts[lang, script_of(w)] += m * len(w)
                counter.clear()

        seen: dict[str, Counter] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > MEMORY:
                add(seen)
        add(seen)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"lang": lang, "bucket": at, "script": None, "n": table[at].astype(np.int64)})
        if scripts:
            yield pd.DataFrame([(a, -1, s, n) for (a, s), n in scripts.items()], columns=["lang", "bucket", "script", "n"])

    counted = rows.mapInPandas(count, "lang string, bucket bigint, script string, n bigint")
    got = counted.groupBy("lang", "bucket", "script").agg(F.sum("n").alias("n")).toPandas()
    return Model.learned(got[got["bucket"] >= 0], got[got["bucket"] < 0], buckets, penalty)


def identify(docs: DataFrame, model: Model | None, *keep: str | Column) -> DataFrame:
    """docs' kept columns with lang_pred and score."""
    rows = docs.select(*keep, F.col("text").alias("__text"))
    columns = rows.columns[:-1]
    if model is None:
        return rows.select(*columns, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def tag(batches):
        tagger = Tagger(shared.value)
        for pdf in batches:
            for i in range(0, len(pdf), DOCS):
                part = pdf.iloc[i : i + DOCS]
                names, score = tagger.predict([None if x is None else x for x in part["__text"]])
                yield part[columns].assign(lang_pred=names, score=score)

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInPandas(tag, schema)
