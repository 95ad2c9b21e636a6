"""Benchmark decontamination: training passages query a BM25 inverted index of test items with block-max WAND.

Test items are indexed in shards of about `shard_chars` of text. Tasks build the shards, each from its own items
and the document frequencies of its words, and write them as a table; the driver passes on one built shard at a
time, so that what is broadcast is bounded however many items there are. Each shard costs one pass over the
documents. Document frequencies and the mean length cover all items. Impacts are divided by the item's threshold
(`share` of the score of its own full text), so an item is retrieved when its sum reaches 1.

Every whole text is cut into passages of twice the longest item, one item apart, so that each item that a
text contains lies whole in some passage. The block maxima of a stretch of `STRETCH` passages, summed, leave
the blocks of items that any of them could reach. Over these a passage's terms run as cursors: in order of
their blocks, their lists' maxima are added until the sum reaches 1; the cursor where it does is the pivot, and
those behind it skip to its block. If the block's own maxima reach 1 as well, its items are scored. All items
above the threshold are retrieved. A retrieved item counts as a leak if enough of the word n-grams of its
question and of its answer occur in the passage. The answer is what follows the last question mark or, without
one, the first line feed; otherwise the last quarter of the words.

Words compare in lower case without punctuation at their ends. Null or empty texts and items match
nothing. Repeated items each give rows of their own; a null doc_id is returned as null.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

K1, B = 1.2, 0.75
BLOCK = 4
STRETCH = 2
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»„“”‘’…–—"


def norm(word: str) -> str:
    return word.strip(EDGES).lower()


def words_of(text: str) -> list[str]:
    return [w for w in map(norm, text.split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    for mark, at in (("?", text.rfind("?")), ("\n", text.find("\n"))):
        if at > 0:
            q, a = words_of(text[: at + 1]), words_of(text[at + 1 :])
            if q and a:
                return q, a
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


@dataclass
class Index:
    terms: dict[str, int]
    starts: np.ndarray  # of each term's postings
    items: np.ndarray  # postings: item number
    impacts: np.ndarray  # postings: impact over the item's threshold
    block_starts: np.ndarray  # of each term's block maxima
    blocks: np.ndarray  # block maxima: block number
    tops: np.ndarray  # block maxima: greatest impact within the block
    keys: np.ndarray  # block maxima: term number * number of blocks + block number, ascending
    most: np.ndarray  # of each term: greatest impact in its whole list
    ids: list
    grams: list[tuple]  # of each item: n-grams of question and of answer, in term numbers
    longest: int

    @classmethod
    def build(cls, rows: list[tuple], df: dict[str, int], total: int, mean: float, share: float, n: int) -> Index:
        """rows: (item_id, text)."""
        terms: dict[str, int] = {}
        postings, ids, grams, longest = [], [], [], 1
        for item_id, text in rows:
            words = words_of(text or "")
            if not words:
                continue
            longest = max(longest, len(words))
            uses = Counter(words)
            idf = {w: np.log1p((total - df[w] + 0.5) / (df[w] + 0.5)) for w in uses}
            weight = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in uses.items()}
            limit = share * sum(weight.values())
            for w, x in weight.items():
                postings.append((terms.setdefault(w, len(terms)), len(ids), x / limit))
            sides = []
            for side in question_and_answer(text):
                seq = [terms[w] for w in side]
                k = min(n, len(seq))
                sides.append((k, {tuple(seq[i : i + k]) for i in range(len(seq) - k + 1)} if k else set()))
            ids.append(item_id)
            grams.append(tuple(sides))
        postings.sort()
        t, items, impacts = (np.array(x) for x in zip(*postings)) if postings else (np.empty(0, np.int64),) * 3
        block = items // BLOCK
        first = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        tops = np.maximum.reduceat(impacts, first) if len(first) else impacts
        numbers = np.arange(len(terms) + 1)
        starts, count = np.searchsorted(t[first], numbers), -(-len(ids) // BLOCK)
        most = np.maximum.reduceat(tops, starts[:-1]) if len(terms) else tops
        return cls(terms, np.searchsorted(t, numbers), items.astype(np.int32), impacts.astype(float), starts, block[first].astype(np.int32), tops.astype(float), t[first] * count + block[first], most.astype(float), ids, grams, longest)

    def hopeful(self, terms: np.ndarray) -> np.ndarray:
        """Which blocks could hold an item whose sum over the distinct terms reaches 1."""
        at = spans(self.block_starts, terms)
        return np.bincount(self.blocks[at], self.tops[at], -(-len(self.ids) // BLOCK)) >= 0.999


def spans(starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The places of all entries of the terms."""
    sizes = starts[terms + 1] - starts[terms]
    return np.repeat(starts[terms + 1] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


class TermNumbers(dict):
    """word -> its term number, -1 for a word that no item has, -2 for marks without a word. Words seen before are kept, up to `most`."""

    def __init__(self, terms: dict[str, int], most: int = 200_000):
        super().__init__()
        self.terms, self.most = terms, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        clean = norm(word)
        self[word] = got = self.terms.get(clean, -1) if clean else -2
        return got


class Matcher:
    """Finds the items that leak into a text."""

    def __init__(self, index: Index, least: float):
        self.index, self.least = index, least
        self.known = TermNumbers(index.terms)

    def scores(self, terms: np.ndarray, live: np.ndarray) -> dict[int, float]:
        """Items of the `live` blocks (ascending) whose sum over the distinct terms reaches 1."""
        x, found = self.index, {}
        most = x.most[terms]
        if most.sum() < 0.999:
            return found
        count = -(-len(x.ids) // BLOCK)
        place, end = x.block_starts[terms], x.block_starts[terms + 1]
        now = x.blocks[place].astype(np.int64)  # of each cursor: its block; `count` at the end of its list
        while True:
            order = now.argsort()
            reach = np.cumsum(most[order])
            at = np.searchsorted(reach, 0.999)
            pivot = now[order[at]] if at < len(order) else count
            next_ = np.searchsorted(live, pivot)
            if pivot == count or next_ == len(live):
                return found
            pivot = live[next_]
            behind = np.flatnonzero(now < pivot)
            place[behind] = np.searchsorted(x.keys, terms[behind] * count + pivot)
            self.stand(place, end, now, behind, count)
            here = np.flatnonzero(now == pivot)
            if x.tops[place[here]].sum() >= 0.999:
                at = spans(x.starts, terms[here])
                at = at[x.items[at] // BLOCK == pivot]
                sums = np.bincount(x.items[at] - pivot * BLOCK, x.impacts[at])
                found.update((int(i + pivot * BLOCK), float(sums[i])) for i in np.flatnonzero(sums >= 1 - 1e-9))
            place[here] += 1
            self.stand(place, end, now, here, count)

    def stand(self, place: np.ndarray, end: np.ndarray, now: np.ndarray, moved: np.ndarray, count: int) -> None:
        """Read the blocks of the cursors that moved."""
        inside = place[moved] < end[moved]
        now[moved] = count
        some = moved[inside]
        now[some] = self.index.blocks[place[some]]

    def __call__(self, text: str | None) -> list[tuple]:
        """(item_id, score over threshold, share of question n-grams, share of answer n-grams) of the best passage."""
        x = self.index
        if not text or not x.ids:
            return []
        words = text.split()
        seq = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        seq = seq[seq != -2]  # marks without a word
        distinct = np.unique(seq[seq >= 0])
        if not len(distinct) or not x.hopeful(distinct).any():
            return []
        best: dict[int, tuple] = {}
        step, last, live = x.longest, max(1, len(seq) - x.longest), None
        for number, start in enumerate(range(0, last, step)):
            if number % STRETCH == 0:
                near = seq[start : start + (STRETCH + 1) * step]
                near = np.unique(near[near >= 0])
                live = np.flatnonzero(x.hopeful(near)) if len(near) else near
            if not len(live):
                continue
            part = seq[start : start + 2 * step]
            terms = np.unique(part[part >= 0])
            found = self.scores(terms, live) if len(terms) else {}
            if not found:
                continue
            tokens, made = part.tolist(), {}
            for item, score in found.items():
                shares = []
                for k, own in x.grams[item]:
                    if k and k not in made:
                        made[k] = set(zip(*(tokens[i:] for i in range(k))))
                    shares.append(len(own & made[k]) / len(own) if k else 1.0)
                if min(shares) >= self.least and score > best.get(item, (0,))[0]:
                    best[item] = (score, *shares)
        return [(x.ids[i], *v) for i, v in sorted(best.items())]


def indexes(items: DataFrame, share: float, n: int, shard_chars: int) -> Iterator[bytes]:
    """The shards of the index, built by tasks and pickled; one of them is on the driver at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 + size // shard_chars

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(t) for t in batch.column(1).to_pylist()]
            own = [[w for w in set(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.string())), pa.array([len(x) for x in found], pa.int64())], names=["item_id", "text", "words", "n"])

    split = rows.mapInArrow(lengths, "item_id long, text string, words array<string>, n long").where("n > 0")
    split = cut(split.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))))
    total, mean = split.agg(F.count("*"), F.avg("n")).first()
    if not total:
        return
    uses = split.select(F.col("shard").alias("part"), F.explode("words").alias("word"))
    df = uses.groupBy("word").agg(F.count("*").alias("df"))

    def build(own: pa.Table, known: pa.Table) -> pa.Table:
        found = sorted(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        freq = dict(zip(known.column("word").to_pylist(), known.column("df").to_pylist()))
        made = Index.build(found, freq, total, mean, share, n)
        return pa.table({"shard": pa.array([own.column("shard")[0].as_py()], pa.int64()), "index": pa.array([pickle.dumps(made, protocol=5)], pa.binary())})

    own = split.select("shard", "item_id", "text").groupBy("shard")
    known = uses.distinct().join(df, "word").groupBy("part")
    built = cut(own.cogroup(known).applyInArrow(build, "shard long, index binary"))
    for s in range(shards):
        for row in built.where(F.col("shard") == s).collect():  # one row, or none if the shard has no item
            yield bytes(row["index"])


def leaks(docs: DataFrame, items: DataFrame, *, share: float = 0.6, least: float = 0.7, n: int = 5, shard_chars: int = 8_000_000) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, score, question_overlap, answer_overlap."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for index in indexes(items, share, n, shard_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = Matcher(pickle.loads(shared.value), least)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in match(t)]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.union(texts.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, *, share: float = 0.6, least: float = 0.7, n: int = 5, shard_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs, all their columns, whose text leaks no item."""
    at = docs.columns.index("text")
    for index in indexes(items, share, n, shard_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            match = Matcher(pickle.loads(shared.value), least)
            for batch in batches:
                yield batch.filter(pa.array([not match(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
