"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

1. Labellers look at each whole text and vote good (1), bad (-1) or abstain (0).
2. Votes of all documents are counted by pattern: at most 3 ** labellers rows, whatever the corpus.
   Expectation-maximisation over the patterns estimates the share of good texts and how each labeller
   votes on good and on bad ones, and so its accuracy; it starts from the sum of votes. Labellers whose
   silence is no praise only vote bad. This yields a posterior for each pattern.
3. About `sample_docs` documents, chosen by a hash of doc_id and text, are hashed into `2 ** bits` features (words,
   word shapes, repeats); a logistic scorer is fitted to their posteriors by full gradient steps, whose
   sums are taken on the executors. The sample is the documented bound of the fit; all else covers all rows.
4. Every document is scored by the linear scorer alone.

Null, empty and blank texts score 0 and aren't kept. Repeated rows get the same score.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import chunks
from .common import cut, text_bytes

SPACE = bytes([0x20, *range(0x09, 0x0E)])
LETTER = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha())
UPPER = bytes(range(65, 91))
MARK = b"#$%&*|{}<>=~^@\\/_+[]"
SOLID = np.array([c not in SPACE for c in range(256)])
MARKED_AT_START = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
MARKED_AT_END = np.isin(np.arange(256), list(b"#$%&*|!"))
SHAPE = bytes(ord("0") if 48 <= c < 58 else ord("a") if c >= 128 or 97 <= c < 123 else c for c in range(256))
LABELLERS = ("letters", "marks", "upper", "variety", "stutter", "endings", "word_length", "lines", "marked_words", "top_word")


def votes(text: bytes) -> list[int]:
    """A vote of each labeller; thresholds are (bad from, good from) of one figure each."""
    words = text.split()
    n = len(words)
    if not n:
        return [-1] * len(LABELLERS)
    solid = len(text.translate(None, SPACE))
    letters, marks, upper = (len(text) - len(text.translate(None, kind)) for kind in (LETTER, MARK, UPPER))
    lines = [y for x in text.split(b"\n") if (y := x.strip())]
    ended = sum(x[-1:] in b".!?:\"')" for x in lines)
    each = Counter(words)
    same = sum(map(eq, words, islice(words, 1, None)))
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(SOLID[data], prepend=False, append=False))  # starts and ends of the words in turn
    marked = int(np.count_nonzero(MARKED_AT_START[data[edges[::2]]] | MARKED_AT_END[data[edges[1::2] - 1]]))

    def of(x: float, bad: float, good: float) -> int:
        if bad > good:
            return -1 if x >= bad else 1 if x <= good else 0
        return -1 if x <= bad else 1 if x >= good else 0

    def bad(x: float, least: float) -> int:
        return -1 if x >= least else 0

    return [
        bad(1 - letters / solid, 0.2),
        bad(marks / solid, 0.08),
        bad(upper / max(1, letters), 0.4),
        of(len(each) / n**0.85, 0.55, 0.55) if n >= 20 else 0,
        bad(same / n, 0.2) if n >= 5 else 0,
        of(ended / len(lines), 0.2, 0.6),
        of(abs(letters / n - 5), 5.0, 3.0),
        bad(1 - len(set(lines)) / len(lines), 0.4) if len(lines) > 2 else 0,
        bad(marked / n, 0.4),
        bad(max(each.values()) / n, 0.25) if n >= 10 else 0,
    ]


def fit_labels(counts: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], np.ndarray, float]:
    """Pattern counts -> posterior of good by pattern; accuracy of each labeller where it votes; share of good texts."""
    keys = sorted(counts)
    v = np.array([[ord(c) - ord("1") for c in k] for k in keys])
    n = np.array([counts[k] for k in keys], float)
    p = 1 / (1 + np.exp(-1.5 * v.sum(axis=1)))
    for _ in range(rounds):
        share = float((p @ n + 1) / (n.sum() + 2))
        shares = np.empty((2, v.shape[1], 3))  # of votes, for bad and for good texts
        for c, w in enumerate((n * (1 - p), n * p)):
            for vote in range(3):
                shares[c, :, vote] = w @ (v == vote - 1) + 0.5
        shares /= shares.sum(axis=2, keepdims=True)
        bad, good = (np.log(shares[c][np.arange(v.shape[1]), v + 1]).sum(axis=1) for c in (0, 1))
        p = 1 / (1 + np.exp(np.clip(np.log(1 - share) + bad - np.log(share) - good, -40, 40)))
    right = (n * p) @ (v > 0) + (n * (1 - p)) @ (v < 0)
    return dict(zip(keys, p.tolist())), (right + 0.5) / (n @ (v != 0) + 1), share


class Shapes(dict):
    """A word's shape, its digits and lower-case letters already made alike -> its feature, by hashing."""

    def __init__(self, mask: int):
        super().__init__()
        self.mask = mask

    def __missing__(self, alike: bytes) -> int:
        shape = re.sub(rb"a+", b"a", re.sub(rb"0+", b"0", re.sub(rb"[A-Z]{2,}", b"AA", alike)))[:12]
        self[alike] = got = zlib.crc32(shape, 2) & self.mask
        return got


class Features(dict):
    """word -> its number, by which `pairs` holds its two features, by hashing; Python looks at a new word once, and up to `most`
    words are kept from one slice of texts to the next."""

    def __init__(self, bits: int, most: int = 300_000):
        super().__init__()
        self.bits, self.mask, self.most = bits, (1 << bits) - 1, most
        self.pairs, self.shapes = array("q"), Shapes(self.mask)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.pairs)
        self.pairs.append((zlib.crc32(word.lower(), 1) & self.mask) << self.bits | self.shapes[word.translate(SHAPE)])
        return n

    def slices(self, texts: list[bytes], most_bytes: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of texts of about `most_bytes` together (a longer one alone): how many words each has, and the numbers of all words."""
        for _, part in chunks(texts, texts, most_bytes):
            if len(self) > self.most:
                self.clear()
                self.shapes.clear()
                self.pairs = array("q")
            split = [t.split() for t in part]
            lengths = np.array([len(x) for x in split])
            yield lengths, np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the feature numbers and values, of length below 1; shapes weigh more than words. Without words all values are 0."""
        bits, repeat = self.bits, 2 << self.bits | zlib.crc32(b"repeat", 3) & self.mask
        for lengths, numbers in self.slices(texts):
            owner = np.repeat(np.arange(len(lengths)), lengths)
            pairs, above = np.array(self.pairs)[numbers], owner << bits + 2
            again = np.bincount(owner[1:][(numbers[1:] == numbers[:-1]) & (owner[1:] == owner[:-1])], minlength=len(lengths))
            # a key is text, kind (word, shape, repeats) and feature
            keys = np.sort(np.concatenate((above | pairs >> bits, above | 1 << bits | pairs & self.mask, np.arange(len(lengths)) << bits + 2 | repeat)))
            turns = np.flatnonzero(np.diff(keys, prepend=-1))
            own, kind, index = keys[turns] >> bits + 2, keys[turns] >> bits & 3, keys[turns] & self.mask
            count = np.where(kind == 2, again[own], np.diff(turns, append=len(keys)))
            sure = lengths / (lengths + 10)  # short texts lean on the share of good texts
            value = np.stack((0.3 * sure, sure, 2 * sure))[kind, own] * np.sqrt(count / np.maximum(lengths, 1)[own])
            squares, ends = value * value, np.searchsorted(own, np.arange(len(lengths) + 1)).tolist()
            for a, b in zip(ends, ends[1:]):
                yield index[a:b], value[a:b] / np.sqrt(squares[a:b].sum() + 0.25)


def text_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(["".join(chr(ord("1") + v) for v in votes(t)) for t in text_bytes(batch.column(0))], pa.string())], names=["pattern"])


def train(docs: DataFrame, *, sample_docs: int = 6000, bits: int = 16, steps: int = 30, rate: float = 8.0) -> tuple[np.ndarray, dict]:
    """Weights of the scorer (the last is its offset, the log odds of a good text), and the label model (accuracies by labeller, share of good texts)."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    counts = {r["pattern"]: r["n"] for r in texts.select("text").mapInArrow(text_votes, "pattern string").groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** labellers rows at most
    weights = np.zeros((1 << bits) + 1)
    if not counts:
        return weights, {}
    posterior, accuracy, share = fit_labels(counts)
    weights[-1] = np.log(share / (1 - share))
    part = min(1.0, sample_docs / sum(counts.values()))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            rows = [(*f, posterior["".join(chr(ord("1") + v) for v in votes(t))]) for t, f in zip(texts, features.of(texts))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0].tolist() for r in rows], pa.list_(pa.int32())), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.float64())], names=["i", "x", "y"])

    chosen = F.pmod(F.xxhash64("doc_id", "text", F.lit(29)), F.lit(1_000_003)) < part * 1_000_003
    table = cut(texts.where(chosen).select("text").mapInArrow(sample, "i array<int>, x array<double>, y double").repartition(8))

    def gradient(w: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros(len(w)), 0
            for batch in batches:
                col = batch.column(0)
                ends = np.diff(col.offsets.to_numpy())
                i, x, y = col.flatten().to_numpy(), batch.column(1).flatten().to_numpy(), batch.column(2).to_numpy()
                row = np.repeat(np.arange(len(y)), ends)
                miss = 1 / (1 + np.exp(-w[-1] - np.bincount(row, w[i] * x, len(y)))) - y
                sums += np.bincount(i, miss[row] * x, len(w))
                n += len(y)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["g", "n"])

        return run

    speed = np.zeros_like(weights)  # the offset isn't fitted: no feature has its number
    free = np.arange(len(weights)) < len(weights) - 1
    for _ in range(steps):
        parts = table.mapInArrow(gradient(weights + 0.9 * speed), "g binary, n long").collect()  # 8 partitions at most
        n = sum(r["n"] for r in parts)
        if not n:
            break
        speed = 0.9 * speed - rate * (sum(np.frombuffer(r["g"]) for r in parts) / n + 1e-5 * weights * free)
        weights = weights + speed
    return weights, {"accuracy": dict(zip(LABELLERS, accuracy.tolist())), "good": share}


def score(docs: DataFrame, weights: np.ndarray, *, least: float = 0.5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score (0 to 1), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(len(weights)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(bits), shared.value
        for batch in batches:
            texts = text_bytes(batch.column(1))
            out = [float(1 / (1 + np.exp(-np.clip(w[-1] + w[i] @ x, -40, 40)))) if t.strip() else 0.0 for t, (i, x) in zip(texts, features.of(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([s >= least for s in out], pa.bool_())], names=["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, kept boolean")


def classify(docs: DataFrame, *, least: float = 0.5, **options) -> DataFrame:
    """Trains on docs and scores them all."""
    return score(docs, train(docs, **options)[0], least=least)
