"""Language ID by words first, backing off to character n-grams.

Model: for each language the log frequencies of the words of its training texts, and of their character
n-grams (lengths 4 to 1, word ends marked). A known word is scored by its frequencies; an unseen word by the
longest n-grams of which the model knows at least one. Each word gives log posteriors over the languages,
floored so that one word can't decide a text; a text is scored by their sum.

Training reads labelled rows only (text and lang not null) and takes about `sample_docs` of them for each
language, by a hash of doc_id and text, so model and training cost are bounded whatever the corpus. All words
and n-grams of the sample are kept: the model is one sorted array of 64-bit hashes and one matrix of logs,
24 bytes an entry at four languages, which is broadcast. Prediction reads every whole text and nothing else
of a row.

Letters are what str.isalpha takes for letters; other characters of a word (such as fractions and raised
digits) are left out. A text that is null or has no letters is `und` with score 0. Without training rows every
text is `und`. Ties go to the alphabetically first language. Repeated rows get the same prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MUL, in_slices, mix64

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
FLOOR = -6.0
SMOOTH = 0.5


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def words_of(text: str) -> Iterator[str]:
    return filter(None, map(letters, WORD.findall(text.lower())))


def entries(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all words (n = 0), or of all their n-grams: the number of the word and a 64-bit key.
    For n over 1 a word's ends are marked by a blank."""
    if not n:
        return np.arange(len(words)), np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    marked = words if n == 1 else [f" {w} " for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    owner, left = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
    at = np.flatnonzero(left >= n)
    key = np.full(len(at), n, np.uint64)
    for i in range(n):
        key = mix64((key ^ codes[at + i]) * MUL)
    return owner[at], key


@dataclass
class Model:
    """Log posteriors by language of each entry, in the order of the entries' keys."""

    langs: list[str]
    keys: np.ndarray
    logs: np.ndarray
    longest: int

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it isn't known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def rows(self, words: list[str]) -> np.ndarray:
        """The log posteriors of each word."""
        out = np.zeros((len(words), len(self.langs)))
        left = np.arange(len(words))
        for n in (0, *range(self.longest, 0, -1)):
            if not len(left):
                break
            owner, keys = entries([words[i] for i in left], n)
            at = self.places(keys)
            owner, at = owner[at >= 0], at[at >= 0]
            if not len(at):
                continue
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            sums = np.add.reduceat(self.logs[at].astype(np.float64), first, axis=0)
            if n:
                sums = np.maximum(sums - np.logaddexp.reduce(sums, axis=1, keepdims=True), FLOOR)
            out[left[owner[first]]] = sums
            left = np.delete(left, owner[first])
        return out


class Scorer:
    """Scores texts, many at a time; rows of words seen before are kept, up to about `most`."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)))

    def learn(self, found: set[str]) -> None:
        """Rows for new words; those without letters get -1."""
        new, clean = [], []
        for w in found:
            word = letters(w)
            if word:
                new.append(w)
                clean.append(word)
            else:
                self.known[w] = -1
        self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate((self.rows, self.model.rows(clean)))

    def __call__(self, texts: Iterable[str | None], size: int = 1_000_000) -> Iterator[tuple[str, float]]:
        """(language, score) of each text, in runs of about `size` characters."""
        part, chars = [], 0
        for text in texts:
            part.append(text)
            chars += len(text or "")
            if chars >= size:
                yield from self.judged(part)
                part, chars = [], 0
        yield from self.judged(part)

    def judged(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        words = [WORD.findall(t.lower()) if t and self.model.langs else [] for t in texts]
        if len(self.rows) > self.most:
            self.known, self.rows = {}, self.rows[:0]
        self.learn(set().union(*words).difference(self.known))
        for own in words:
            at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            at = at[at >= 0]
            if not len(at):
                yield UNKNOWN, 0.0
                continue
            sums = self.rows[at].sum(axis=0)
            best = int(sums.argmax())
            yield self.model.langs[best], float(np.exp(sums[best] - np.logaddexp.reduce(sums)))


def count_entries(longest: int, most: int = 1_000_000):
    """Rows (lang number, text) -> lang, n, key, uses, for about `most` characters of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[int, Counter] = {}
        chars = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counter in uses.items():
                words, times = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
                for n in range(longest + 1):
                    owner, keys = entries(words, n)
                    keys, at = np.unique(keys, return_inverse=True)
                    sums = np.zeros(len(keys), np.int64)
                    np.add.at(sums, at, times[owner])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), lang, np.int32)), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array(sums)], names=["lang", "n", "key", "uses"])
            uses.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), in_slices(batch.column(1))):
                uses.setdefault(lang, Counter()).update(words_of(text))
                chars += len(text)
                if chars >= most:
                    yield from out()
                    chars = 0
        yield from out()

    return run


def train(labelled: DataFrame, *, sample_docs: int = 1500, longest: int = 4) -> Model:
    """labelled (doc_id, text, lang) -> the model. Rows without text or lang are left out."""
    rows = labelled.select(F.xxhash64("doc_id", F.col("text").cast("string"), F.lit(17)).alias("draw"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.empty(0, np.uint64), np.empty((0, 0), np.float32), longest)
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(sample_docs / sizes[k])) for k in langs))
    place = F.coalesce(*(F.when(F.col("lang") == k, F.lit(i)) for i, k in enumerate(langs)))
    chosen = rows.where(F.pmod("draw", F.lit(1_000_003)) < share * 1_000_003)
    counted = chosen.select(place.alias("lang"), "text").mapInArrow(count_entries(longest), "lang int, n int, key long, uses long").groupBy("lang", "n", "key").agg(F.sum("uses").alias("uses")).toArrow()  # entries of the sample only
    lang, n, key, uses = (counted.column(c).to_numpy() for c in ("lang", "n", "key", "uses"))
    # the keys of different n begin otherwise, so the key alone tells them apart
    keys, first, at = np.unique(key.view(np.uint64), return_index=True, return_inverse=True)
    times = np.zeros((len(keys), len(langs)))
    times[at, lang] = uses
    level = n[first]
    totals = np.zeros((longest + 1, len(langs)))
    np.add.at(totals, (n, lang), uses)
    sizes_of = np.bincount(level, minlength=longest + 1)
    logs = np.log((times + SMOOTH) / (totals[level] + SMOOTH * (sizes_of[level] + 1)[:, None]))
    logs -= np.logaddexp.reduce(logs, axis=1, keepdims=True)
    return Model(langs, keys, np.maximum(logs, FLOOR).astype(np.float32), longest)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            got = list(score(in_slices(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose text is in a learned language with at least `least_score`.
    Null texts and texts without letters go; every other column may be null, and repeated rows share their fate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            got = score(in_slices(batch.column(at)))
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least_score for lang, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """Trains on the labelled rows that aren't held out and predicts all."""
    return predict(docs, train(docs.where(~held_out()), **options))
