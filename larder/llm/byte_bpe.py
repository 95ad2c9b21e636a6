"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Each task splits whole texts into pre-tokens and numbers them. A block (at most about
   `block_chars` of text, or one longer text) keeps each of its distinct words once, with the
   positions of all its pre-tokens as one packed sequence of word numbers per run of documents.
2. The distinct words are shuffled by a hash bucket, so that a word of all blocks meets in one
   partition; there it is encoded once and its ids are joined back to every block that asked for it.
3. A second shuffle brings a block's words and its sequences together; ids are joined to the token-byte
   table to decode them, and both are reassembled by position.

A frequent word is one entry per block, however often it occurs, so no key is hot. Rows shuffled
are at most the distinct words of the blocks; no model or count of the corpus comes to the driver.
The vocabulary (a fixed file of about 50,000 tokens, ranks as ids) is read from its parameter path on
the driver and travels with the task closure: 0.8 MB whatever the input's size.

Null and empty texts have no ids. Repeated rows and repeated doc_ids each give their own row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices

ROUTE = "block long, bucket int, kind int, part int, a binary, b binary"


def load_ranks(spark, path: str) -> dict[bytes, int]:
    """The rank file: a token in base64 and its rank on each line."""
    lines = open(path, "rb").read().split(b"\n")  # the tokenizer's file is part of the installation, not an input table
    return {base64.b64decode(x[0]): int(x[1]) for x in map(bytes.split, lines) if len(x) == 2}


def bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left; a heap keeps long words fast."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 when it was merged away
    before = list(range(-1, n))
    heap = []

    def push(i: int) -> None:
        if end[i] < n:
            r = ranks.get(word[i : end[end[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[i], end[end[i]]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def packed(words: list[bytes]) -> bytes:
    """Words (UTF-8, so without byte 255) joined by byte 255 and compressed."""
    import zstandard

    return zstandard.compress(b"\xff".join(words), 6)


def unpacked(blob: bytes) -> list[bytes]:
    import zstandard

    return zstandard.decompress(blob).split(b"\xff")


def squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 9)


def spread(blob: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def routed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["block", "bucket", "kind", "part", "a", "b"])


def split_job(pattern: str, buckets: int, block_chars: int, part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import xxhash
        import zstandard
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32

        def close(numbers: dict[str, int], parts: list) -> Iterator[pa.RecordBatch]:
            uses = np.zeros(len(numbers), np.int64)
            for _, seq in parts:
                uses += np.bincount(seq, minlength=len(uses))
            rank = np.empty(len(uses), np.uint32)
            rank[np.argsort(-uses, kind="stable")] = np.arange(len(uses), dtype=np.uint32)
            words = [w.encode() for w in numbers]
            place = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.lexsort((rank, place))
            cuts = np.flatnonzero(np.diff(place[order])) + 1
            rows = [(block, int(place[g[0]]), 0, 0, packed([words[i] for i in g]), squeezed(np.diff(rank[g], prepend=np.uint32(0)))) for g in np.split(order, cuts) if len(g)]
            yield routed(rows)
            for n, (docs, seq) in enumerate(parts):
                yield routed([(block, (block * 7919 + n) % buckets, 1, n, zstandard.compress(docs.T.tobytes(), 3), squeezed(rank[seq] if len(seq) else np.empty(0, np.uint32)))])

        numbers: dict[str, int] = {}
        parts, docs, seqs, size, part_size = [], [], [], 0, 0

        def end_part() -> None:
            nonlocal docs, seqs, part_size
            if docs:
                parts.append((np.array(docs, np.int64), np.concatenate(seqs) if seqs else np.empty(0, np.int32)))
            docs, seqs, part_size = [], [], 0

        for batch in batches:
            # a null doc_id travels as a flag, so that it comes back as null
            for doc, text in zip(batch.column(0).to_pylist(), in_slices(batch.column(1))):
                found = find(text) if text else []
                put = numbers.setdefault
                seqs.append(np.fromiter((put(w, len(numbers)) for w in found), np.int32, len(found)))
                docs.append((doc is not None, doc or 0, len(found)))
                size, part_size = size + len(text or ""), part_size + len(text or "")
                if part_size >= part_chars:
                    end_part()
                if size >= block_chars:
                    end_part()
                    yield from close(numbers, parts)
                    numbers, parts, size, block = {}, [], 0, block + 1
        end_part()
        if parts:
            yield from close(numbers, parts)

    return run


def encode_job(ranks: dict[bytes, int]):
    """Rows sorted by bucket: a word is encoded when its bucket first shows it, and its ids are joined to each block's entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        now = None
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block, bucket, kind, part, a, b = row
                if kind:
                    rows.append(row)
                    continue
                if bucket != now:
                    known, now = {}, bucket
                ids = []
                for word in unpacked(a):
                    if word not in known:
                        known[word] = bpe(word, ranks)
                    ids.append(known[word])
                rows.append((block, bucket, 0, 0, squeezed(np.array([*map(len, ids), *(i for x in ids for i in x)], np.uint32)), b))
            yield routed(rows)

    return run


def join_job(ranks: dict[bytes, int], digest: bool):
    """Rows sorted by block, words first: joins each word's ids to the token-byte table, looks up the words of each
    position and closes the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        token_bytes = {i: t for t, i in ranks.items()}
        now, ids, back, counts = None, [], [], None
        for batch in batches:
            out = []
            for block, _, kind, _, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    now, ids, back, counts = block, [], [], None
                if not kind:
                    at, got = np.cumsum(spread(b)).tolist(), spread(a).tolist()
                    more = max(at, default=-1) + 1 - len(ids)
                    if more > 0:
                        ids.extend([b""] * more)
                        back.extend([b""] * more)
                    end = len(at)
                    for i, n in zip(at, got[: len(at)]):
                        own = got[end : end + n]
                        end += n
                        ids[i] = " ".join(map(str, own)).encode()
                        back[i] = b"".join([token_bytes[x] for x in own])
                    continue
                if counts is None:
                    counts = np.fromiter((x.count(b" ") + 1 for x in ids), np.int64, len(ids))
                seq, done = spread(b), 0
                for there, doc, n in np.frombuffer(zstandard.decompress(a), np.int64).reshape(3, -1).T.tolist():
                    own = seq[done : done + n]
                    done += n
                    at = own.tolist()
                    all_ids, text = b" ".join([ids[i] for i in at]), b"".join([back[i] for i in at])
                    tokens = int(counts[own].sum()) if n else 0
                    doc = doc if there else None
                    out.append((doc, tokens, hashlib.sha256(all_ids).hexdigest(), hashlib.sha256(text).hexdigest()) if digest else (doc, tokens, all_ids.decode(), text.decode()))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))])

    return run


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, *, digest: bool = True, buckets: int | None = None, block_chars: int = 32_000_000, part_chars: int = 1_000_000) -> DataFrame:
    """docs (doc_id, text; more columns are ignored) -> doc_id, n_tokens, and either ids_sha256 and decoded_sha256
    or, with digest=False, ids (decimal, joined by one space) and decoded (text).

    buckets: the distinct words of one bucket are held at a time. Without a number there are 1,024, and one for every
    2 * 10**9 characters beyond; partitions follow the input's size too, so that none grows with it.
    """
    size = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    buckets = buckets or max(1024, size // 2_000_000_000)
    parts = 8 + 2 * (size // max(block_chars, 4_000_000))
    ranks = load_ranks(docs.sparkSession, rank_path)
    cols = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids string, decoded string")
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(split_job(pattern, buckets, block_chars, part_chars), ROUTE)
    known = asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(encode_job(ranks), ROUTE)
    return known.repartition(parts, "block").sortWithinPartitions("block", "kind", "part").mapInArrow(join_job(ranks, digest), cols)


def decode(ids: DataFrame, rank_path: str) -> DataFrame:
    """ids (doc_id long, pos long, id int) -> doc_id, data binary: joins the token-byte table (a fixed vocabulary,
    so it is broadcast) and puts the bytes together by position. An unknown id is an error."""
    spark = ids.sparkSession
    table = spark.createDataFrame([(i, bytearray(t)) for t, i in load_ranks(spark, rank_path).items()], "id int, piece binary")
    known = ids.join(F.broadcast(table), "id", "left").withColumn("piece", F.when(F.col("piece").isNull(), F.raise_error(F.concat(F.lit("no token has the id "), F.col("id").cast("string"))).cast("binary")).otherwise(F.col("piece")))
    parts = known.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("piece")))).alias("p"))
    return parts.select("doc_id", F.unhex(F.array_join(F.col("p.piece"), "")).alias("data"))
