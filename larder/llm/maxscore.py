"""Ranked lexical search: an inverted index in shards of documents, searched by block-max MaxScore.

1. Each task cuts its documents into shards of about `shard_bytes` of text and writes a shard's postings at once, with
   no shuffle: for each term blocks of `block` postings in document order, as small integers (gaps and counts), beside
   them the block's competitive pairs (term count, document length) from which its greatest score follows once corpus
   counts are known, as no pair of the block scores more. Postings are written for terms that queries may hold, told by
   a bitmap of fixed size over hashes of the queries' terms; lengths and corpus counts cover every term.
2. Corpus counts and document frequencies are sums over the index rows.
3. The index joins the queries' terms; each task gets one shard's lists for one block of queries. Lists are ordered by
   their greatest score. While the sum over the lowest lists can't exceed the k-th best score so far, these lists are
   not essential: documents come from the other lists only, window by window in document order. On non-essential
   lists, highest first, a document is rejected by what the lists left could add and then by its block's maximum,
   before the block is unpacked.
4. Each shard returns k documents of a query at most; a window merges them.

A shard holds about `shard_bytes` of text or one longer document. A block of queries is `queries` at most, so a term of
all queries and all documents makes lists of bounded size. Nothing but the bitmap and two counts comes to the driver.

Null or empty texts hold no terms: such documents aren't counted and such queries find nothing. Each row of documents
and of queries stands alone; repeated ones are ranked and answered each. A null doc_id ranks last among equal scores;
among rows with one doc_id and score the order doesn't show. Counts: all integers of 64 bits, as in `weight_column`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, text_bytes

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # of UTF-8: ASCII letters and digits and all that isn't ASCII
BITS = 1 << 23
BUCKET = 32768  # bits of one of Spark's bitmaps
INDEX = "shard long, term binary, df long, blocks array<struct<first:int,last:int,tops:array<int>,data:binary>>, ids array<bigint>, sizes array<bigint>"
KINDS = pa.schema(
    [("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("blocks", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("tops", pa.list_(pa.int32())), ("data", pa.binary())]))), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
)


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def place(term: bytes) -> int:
    """The term's place in the bitmap, from 1."""
    return 1 + xxhash.xxh64_intdigest(term) % BITS


def pack(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """Gaps and counts of a block in the fewest bytes each that hold them all; the two sizes come first."""
    columns = np.diff(docs, prepend=docs[0]), tf
    sizes = [next(s for s in (1, 2, 4) if int(x.max()) < 1 << 8 * s) for x in columns]
    return bytes(sizes) + b"".join(x.astype(f"<u{s}").tobytes() for x, s in zip(columns, sizes))


def unpack(first: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap, count = data[0], data[1]
    n = (len(data) - 2) // (gap + count)
    docs = first + np.cumsum(np.frombuffer(data, f"<u{gap}", n, 2).astype(np.int64))
    return docs, np.frombuffer(data, f"<u{count}", n, 2 + gap * n).astype(np.int64)


class Numbers(dict):
    """term -> its number, or -1 if no query holds it. Terms without a number are forgotten when there are `most`."""

    def __init__(self, bits: bytes, most: int = 400_000):
        super().__init__()
        self.bits, self.most, self.own = bits, most, {}

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self.most + len(self.own):
            self.clear()
            self.update(self.own)
        found = self[term] = len(self.own) if self.bits[place(term) - 1] else -1
        if found >= 0:
            self.own[term] = found
        return found


class Shard:
    """Documents of one shard in the making."""

    def __init__(self, bits: bytes):
        self.numbers, self.ids, self.sizes, self.terms, self.bytes = Numbers(bits), [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms_of(text)
        if found:
            t = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
            self.ids.append(doc_id)
            self.sizes.append(len(found))
            self.terms.append(t[t >= 0])
            self.bytes += len(text)

    def rows(self, shard: int, block: int) -> Iterator[pa.RecordBatch]:
        """The shard's document row, then the rows of its terms."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        sizes = np.array(self.sizes, np.int64)[order]
        yield pa.RecordBatch.from_pylist([{"shard": shard, "ids": [self.ids[i] for i in order], "sizes": sizes.tolist()}], KINDS)
        n = len(order)
        keys = np.concatenate([self.terms[i] * n + d for d, i in enumerate(order)])
        self.terms = []
        keys, tf = np.unique(keys, return_counts=True)
        term, doc = np.divmod(keys, n)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        names, rows = list(self.numbers.own), []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(term)]):
            blocks = []
            for i in range(a, b, block):
                d, c = doc[i : min(i + block, b)], tf[i : min(i + block, b)]
                blocks.append({"first": int(d[0]), "last": int(d[-1]), "tops": competitive(c, sizes[d]), "data": pack(d, c)})
            rows.append({"shard": shard, "term": names[term[a]], "df": b - a, "blocks": blocks})
            if len(rows) == 2000:
                yield pa.RecordBatch.from_pylist(rows, KINDS)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, KINDS)


def competitive(tf: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Pairs of count and document length, one after the other, such that every other pair has no greater count in no shorter document."""
    order = np.lexsort((sizes, -tf))
    c, s = tf[order], sizes[order]
    keep = np.flatnonzero(s < np.minimum.accumulate(np.concatenate(([np.iinfo(np.int64).max], s[:-1]))))
    return np.stack((c[keep], s[keep]), axis=1).ravel().tolist()


def indexed(bits: bytes, shard_bytes: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").tobytes()
        number = TaskContext.get().partitionId() << 32
        shard = Shard(flags)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if shard.ids and shard.bytes + len(text) > shard_bytes:
                    yield from shard.rows(number, block)
                    number, shard = number + 1, Shard(flags)
                shard.add(doc_id, text)
        if shard.ids:
            yield from shard.rows(number, block)

    return run


def query_terms(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """q, item_id, text -> a row for each distinct term: q, item_id, term, c (its occurrences), place."""
    rows = [{"q": q, "item_id": item, "term": t, "c": c, "place": place(t)} for q, item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))) for t, c in Counter(terms_of(text)).items()]
    return [pa.RecordBatch.from_pylist(rows, pa.schema([("q", pa.int64()), ("item_id", pa.int64()), ("term", pa.binary()), ("c", pa.int64()), ("place", pa.int64())]))]


def bitmap(terms: DataFrame) -> bytes:
    """One bit for each of BITS places, set where a term has it: 1 MB however many terms there are."""
    parts = terms.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = bytearray(BITS // 8)
    for r in parts.collect():
        out[(r.bucket - 1) * BUCKET // 8 : r.bucket * BUCKET // 8] = r.bits
    return bytes(out)


def weight_column(df: str, n: int) -> Column:
    return F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.col(df) + 1))).cast("long")


def penalties(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """12 * m of each document length."""
    if 25 * int(sizes.max(initial=0)) * n < 1 << 62:
        return 12 * (75 + 25 * sizes * n // total)
    return np.array([12 * (75 + 25 * s * n // total) for s in sizes.tolist()], np.int64)


def impact(tf: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + penalty)


class Lists:
    """The posting lists of one shard, unpacked block by block when they are asked for. `unpacked` counts those blocks."""

    def __init__(self, part: pa.Table, sizes: np.ndarray, n: int, total: int):
        self.penalty = penalties(sizes, n, total)
        column = part.column("blocks").combine_chunks()
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in column]))).astype(np.int64)
        flat = column.flatten()
        self.first, self.last = (flat.field(x).to_numpy() for x in ("first", "last"))
        self.data, tops = flat.field("data"), flat.field("tops")
        ends = np.cumsum(tops.value_lengths().to_numpy()) // 2
        pairs = tops.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
        self.tops = np.maximum.reduceat(impact(pairs[:, 0], penalties(pairs[:, 1], n, total)), ends - np.diff(ends, prepend=0)) if len(ends) else np.empty(0, np.int64)
        self.best = np.maximum.reduceat(self.tops, self.starts[:-1]) if len(self.tops) else self.tops
        self.known: dict = {}
        self.unpacked = 0

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block i."""
        if i not in self.known:
            docs, tf = unpack(int(self.first[i]), self.data[i].as_py())
            self.known[i] = docs, impact(tf, self.penalty[docs])
            self.unpacked += 1
        return self.known[i]

    def within(self, term: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents in low .. high - 1 and their impacts, block by block."""
        a, b = self.starts[term], self.starts[term + 1]
        for i in range(a + np.searchsorted(self.last[a:b], low), a + np.searchsorted(self.first[a:b], high)):
            docs, impacts = self.block(i)
            x, y = np.searchsorted(docs, (low, high))
            yield docs[x:y], impacts[x:y]


def search(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int, window: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a query and their scores, best first; equal scores by document."""
    order = np.argsort(weights * lists.best[terms], kind="stable")
    terms, weights = terms[order].tolist(), weights[order].tolist()
    reach = np.cumsum([0, *(w * int(lists.best[t]) for t, w in zip(terms, weights))]).tolist()  # of the lists before each
    docs, found, limit = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for low in range(0, len(lists.penalty), window):
        essential = next((i for i in range(len(terms)) if reach[i + 1] > limit), None)
        if essential is None:
            break  # no document can exceed the k-th best
        sums = np.zeros(window, np.int64)
        for t, w in zip(terms[essential:], weights[essential:]):
            for d, x in lists.within(t, low, low + window):
                sums[d - low] += w * x
        own = np.flatnonzero(sums)
        for i in range(essential - 1, -1, -1):
            own = own[sums[own] + reach[i + 1] > limit]
            if not len(own):
                break
            a, b = lists.starts[terms[i]], lists.starts[terms[i] + 1]
            at = np.searchsorted(lists.last[a:b], own + low) + a
            inside = at < b
            inside[inside] = lists.first[at[inside]] <= own[inside] + low
            most = np.zeros(len(own), np.int64)
            most[inside] = weights[i] * lists.tops[at[inside]]
            keep = sums[own] + most + reach[i] > limit
            own, at, inside = own[keep], at[keep], inside[keep]
            for j in np.unique(at[inside]).tolist():
                d, x = lists.block(j)
                mine = own[inside & (at == j)]
                p = np.minimum(np.searchsorted(d, mine + low), len(d) - 1)
                sums[mine] += np.where(d[p] == mine + low, weights[i] * x[p], 0)
        own = own[sums[own] > limit]
        if len(own):
            docs, found = np.concatenate((docs, own + low)), np.concatenate((found, sums[own]))
            keep = np.lexsort((docs, -found))[:k]
            docs, found = docs[keep], found[keep]
            limit = int(found[-1]) if len(found) == k else 0
    return docs, found


def searched(k: int, n: int, total: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            ids = right.column("ids")[0].as_py()
            lists = Lists(left, np.array(right.column("sizes")[0].as_py(), np.int64), n, total)
            queries: dict[tuple, list] = {}
            for t, users in enumerate(left.column("users").to_pylist()):
                for u in users:
                    queries.setdefault((u["q"], u["item_id"]), []).append((t, u["weight"]))
            for (q, item), own in queries.items():
                docs, found = search(lists, *np.array(own, np.int64).T, k)
                out += [(q, item, ids[d], s) for d, s in zip(docs.tolist(), found.tolist())]
        return pa.table({x: pa.array(c, pa.int64()) for x, c in zip(("q", "item_id", "doc_id", "score"), list(zip(*out)) or [[]] * 4)})

    return run


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 20, block: int = 128, shard_bytes: int = 32_000_000, queries: int = 1024) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> item_id, rank, doc_id, score of each item's k best documents."""
    asked = items.select(F.monotonically_increasing_id().alias("q"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = cut(map_batches(asked, query_terms, "q long, item_id long, term binary, c long, place long"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(asked))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from indexed(bits.value, shard_bytes, block)(batches)

    index = cut(texts.mapInArrow(run, INDEX))
    shards, postings = index.where("term is null").select("shard", "ids", "sizes"), index.where("term is not null").select("shard", "term", "df", "blocks")
    n, total = shards.agg(F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, total = n or 0, total or 0
    parts = -(-max(1, asked.select("q").distinct().count()) // queries)
    weights = postings.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight_column("df", n).alias("w")).where("w > 0")
    users = asked.join(weights, "term").withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)))
    users = cut(users.groupBy("term", "part").agg(F.collect_list(F.struct("q", "item_id", (F.col("w") * F.col("c")).alias("weight"))).alias("users")))
    lists = postings.join(users, "term").select("shard", "part", "users", "blocks").groupBy("shard", "part")
    shards = shards.toDF(*shards.columns)  # columns of its own beside the postings'
    own = shards.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).groupBy("shard", "part")
    found = lists.cogroup(own).applyInArrow(searched(k, n, total), "q long, item_id long, doc_id long, score long")
    by = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
