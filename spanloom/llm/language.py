"""Problem 9: the language of documents and of the segments of mixed ones.

Sentences are TF-IDF vectors of hashed character trigrams of padded words and of whole words.  Each
language has several centroids, found by spherical k-means over the sentences of a bounded
sample of labelled documents (``SAMPLE_DOCS``); as labels may be wrong, a first
centroid per language moves sentences to the language they are nearest to.  A sentence gets the
language of the nearest centroid by cosine; one farther from all centroids than nearly every
sentence of the sample is rejected.

A full sentence has ``MIN_WORDS`` words of letters, outside of brackets and of quotations that are no whole
sentence, and a closing sign.
Null, empty and blank texts, codes and figures have no sentence and no language (null, confidence 0).
Without labels of two languages at least nothing can be fitted, and no document has a language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asread import as_read
from .shared import small

SAMPLE_DOCS = 1500  # labelled documents the classifier is fitted on, an equal part of them for each language, about
CLUSTERS = 3
DIM = 1 << 15
MIN_WORDS = 7
STRETCH = 3  # words a stretch must have to be judged by itself; a text with only shorter ones is judged as a whole
REJECT = 0.5  # share of the 1st percentile of the sample's own cosines under which a sentence has no language

# Names of a language in labels, by its code; and labels that name none.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "it": ("it", "ita", "italian"),
    "pt": ("pt", "por", "portuguese"),
}
NO_LABEL = ("", "unknown", "n/a", "na", "und", "undetermined", "none", "null", "unk", "mis", "zxx", "?", "-")

# A closing sign before a small letter closes nothing (Inc., Corp.), nor does one after a day's number.
_END = re.compile(
    r"[.!?。！？](?:(?<=[。！？])|(?<!\s\d[.!?])(?<!\s\d\d[.!?])(?:[\"'”’»)]{0,2}|\s?\([^()\n]{1,40}\)[.!?]?)(?=\s+[^\sa-zà-öø-ÿ]|\s*$))"
)
_ASIDE = re.compile(r"\([^()\n]*\)")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»")
_LETTERS = re.compile(r"[^\W\d_]+")


def label_code(label: Column) -> Column:
    """The code of the language a label names, '' for none, and the label itself (lower case) for any other."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    head = F.split(low, "[-_ ]")[0]
    out = F.when(low.isin(*NO_LABEL), "")
    for code, names in NAMES.items():
        out = out.when(head.isin(*names), code)
    return out.otherwise(low)


def shown(text: str | None) -> str:
    """The text as read, with blanks in the place of quoted words that are no whole sentence."""
    whole = lambda q: q[1:2].isupper() and q[-2:-1] in ".?!"
    return _QUOTED.sub(lambda m: m[0] if whole(m[0]) else " " * len(m[0]), as_read(text) or "")


def sentences(text: str | None) -> list[tuple[int, int, bool]]:
    """(start, end, closed) of the stretches between closing signs; ``closed`` where a sign ends it."""
    out, at = [], 0
    for m in _END.finditer(text or ""):
        out.append((at, m.end(), True))
        at = m.end()
    if text and text[at:].strip():
        out.append((at, len(text), False))
    return out


def plain_words(stretch: str) -> list[str]:
    """Words of letters in lower case, without what stands in brackets."""
    return _LETTERS.findall(_ASIDE.sub(" ", stretch).lower())


class _Grams(dict):
    def __missing__(self, word: str) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        padded = f" {word} "
        grams = [padded[i : i + 3] for i in range(len(padded) - 2)] + [padded]
        self[word] = out = np.array([xxhash.xxh32_intdigest(g) % DIM for g in grams], np.int64)
        return out


_GRAMS = _Grams()


def counts(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, times), sorted by row, of each text's grams."""
    parts = [_GRAMS[w] for ws in texts for w in ws]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    row = np.repeat(np.repeat(np.arange(len(texts)), [len(ws) for ws in texts]), sizes)
    key = np.sort(row * DIM + np.concatenate(parts))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first] // DIM, key[first] % DIM, np.diff(np.r_[first, len(key)])


class _Known(dict):
    """Places of words in the table of their own dot products."""

    def __init__(self, owner: Centroids):
        super().__init__()
        self.owner = owner

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.owner.learn(word, at)
        return at


class Centroids:
    """Several centroids per language, the weights of grams, and the rejection threshold."""

    def __init__(self, langs: list[str], idf: np.ndarray, matrix: np.ndarray, least: float = 0.0):
        self.langs, self.idf, self.matrix, self.least = langs, idf.astype(np.float32), matrix.astype(np.float32), least
        self.known = _Known(self)
        self.own = np.zeros((1024, self.matrix.shape[1]), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "own")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, known=_Known(self), own=np.zeros((1024, state["matrix"].shape[1]), np.float32))

    def learn(self, word: str, at: int) -> None:
        """Keeps the word's own dot products at that place."""
        if at >= len(self.own):
            self.own = np.concatenate([self.own, np.zeros_like(self.own)])
        gram = _GRAMS[word]
        self.own[at] = (self.idf[gram, None] * self.matrix[gram]).sum(0)

    def cosines(self, texts: list[list[str]]) -> np.ndarray:
        """Cosine of each text with the nearest centroid of each language."""
        if len(self.known) > 300_000:
            self.known, self.own = _Known(self), self.own[:1024]
        row, gram, times = counts(texts)
        out = np.zeros((len(texts), self.matrix.shape[1]), np.float32)
        if len(row):
            value = times * self.idf[gram]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            norm = np.sqrt(np.add.reduceat(value * value, first))
            # a dot product is linear in the times of grams, so it is summed over words, whose own are remembered
            some = [ws for ws in texts if ws]
            ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(some)), np.int64, sum(map(len, some)))
            dots = np.add.reduceat(self.own[ids], np.cumsum([0, *map(len, some)])[:-1], axis=0)
            out[row[first]] = dots / np.maximum(norm, 1e-9)[:, None]
        return out.reshape(len(texts), len(self.langs), -1).max(2)

    def decide(self, texts: list[list[str]]) -> tuple[list[str | None], np.ndarray]:
        """Language and confidence of each text; none (and 0) where it is too far from every centroid.

        Confidence is the best cosine's part of the best two languages' sum: 0.5 is a draw, 1 no likeness with any other.
        """
        c = self.cosines(texts)
        if not len(c):
            return [], np.zeros(0)
        order = np.sort(c, axis=1)
        best, second = order[:, -1], order[:, -2]
        sure = best / np.maximum(best + second, 1e-9)
        return [self.langs[i] if b >= self.least and b > 0 else None for i, b in zip(c.argmax(1), best, strict=True)], np.where(best >= self.least, sure, 0.0)


def fit(samples: list[tuple[str, list[str]]], clusters: int = CLUSTERS) -> Centroids:
    """Centroids from (language, words of a sentence); some of the languages may be wrong."""
    langs = sorted({lang for lang, _ in samples})
    texts = [ws for _, ws in samples]
    row, gram, times = counts(texts)
    idf = np.log((1 + len(texts)) / (1 + np.bincount(gram, minlength=DIM))) + 1
    value = times * idf[gram]
    value = value / np.sqrt(np.bincount(row, value * value, len(texts)))[row]
    own = np.array([langs.index(lang) for lang, _ in samples])
    # One centroid per language outvotes wrong labels, while one of several would settle on them.
    for k_of in (1, 1, clusters):
        columns = []
        for k in range(len(langs)):
            columns += _clusters(row, gram, value, np.flatnonzero(own == k), k_of)
        model = Centroids(langs, idf, np.array(columns).T)
        c = model.cosines(texts)
        own = c.argmax(1)
    model.least = REJECT * float(np.percentile(c.max(1), 1))
    return model


def _clusters(row: np.ndarray, gram: np.ndarray, value: np.ndarray, members: np.ndarray, k: int) -> list[np.ndarray]:
    """Spherical k-means over the given rows, from evenly spread starts."""
    rank = np.full(row.max() + 1 if len(row) else 0, -1)
    rank[members] = np.arange(len(members))
    use = rank[row] >= 0
    row, gram, value = rank[row[use]], gram[use], value[use]
    at = np.arange(len(members)) * k // max(1, len(members))
    for _ in range(4 if k > 1 else 1):
        centers = [np.bincount(gram[at[row] == j], value[at[row] == j], DIM) for j in range(k)]
        centers = [c / max(np.linalg.norm(c), 1e-9) for c in centers]
        at = np.array([np.bincount(row, value * c[gram], len(members)) for c in centers]).argmax(0)
    return centers


def labelled_sentences(documents: DataFrame, limit: int = SAMPLE_DOCS) -> list[tuple[str, list[str]]]:
    """Sentences of about ``limit`` labelled documents (never twice as many), as many for each language, chosen by a hash of their ids."""
    known = documents.select("doc_id", "text", label_code(F.col("lang")).alias("code")).filter(F.col("code").isin(*NAMES) & F.col("text").isNotNull())
    sizes = {r.code: r.n for r in known.groupBy("code").agg(F.count("*").alias("n")).collect()}  # one row a language
    part = F.lit(0)
    for code, n in sizes.items():
        part = F.when(F.col("code") == code, int(1_000_000 * min(1.0, limit / len(sizes) / n))).otherwise(part)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part
    out = []
    for r in known.filter(share).limit(2 * limit).toLocalIterator():
        text = shown(r.text)
        for a, b, closed in sentences(text):
            ws = plain_words(text[a:b])
            if closed and len(ws) >= MIN_WORDS:
                out.append((r.code, ws))
    return out


SEGMENTS = "doc_id long, label string, start_pos int, end_pos int, n int, closed boolean, lang string, confidence double"


def classified(documents: DataFrame, model: Centroids) -> DataFrame:
    """A row for each sentence: its place in the text as read, its words, its language and confidence."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # DIM by a few centroids
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.float64())
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows, texts = [], []
            for d, text, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = shown(text)
                own = [(a, z, closed, ws) for a, z, closed in sentences(text) if (ws := plain_words(text[a:z]))]
                long = [x for x in own if len(x[3]) >= STRETCH]
                if own and not long:  # all of the text together, as no stretch says enough by itself
                    long = [(own[0][0], own[-1][1], False, [w for x in own for w in x[3]])]
                for a, z, closed, ws in long:
                    rows.append((d, label, a, z, len(ws), closed))
                    texts.append(ws)
            langs, sure = shared.value.decide(texts)
            if rows:
                cols = [*zip(*rows, strict=True), langs, sure.astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return documents.select(F.col("doc_id").cast("long"), F.col("text"), label_code(F.col("lang")).alias("label")).mapInArrow(run, SEGMENTS)


def fitted(documents: DataFrame) -> Centroids | None:
    samples = labelled_sentences(documents)
    return fit(samples) if len({lang for lang, _ in samples}) > 1 else None


def full(sentence: DataFrame) -> DataFrame:
    """Only full sentences that have a language."""
    return sentence.filter((F.col("n") >= MIN_WORDS) & F.col("closed") & F.col("lang").isNotNull())
