"""Substring dedup over words: a compacted de Bruijn graph of token k-mers.

The graph's edges are the token k-mers of length `window` (50): a k-mer that also starts in a document
with a smaller doc_id is a repeated edge, and each word that it covers goes. Building every edge of a
corpus as a row would shuffle a row for every word, so paths are compacted from the start:

1. Each edge belongs to its anchor, the leftmost `k`-gram of smallest hash inside it. Consecutive edges
   with one anchor form a path piece, written with its source coordinates (doc_id, first, last), its
   anchor and the hash of all its words: about one row for 20 words.
2. Anchors seen in one document only have no repeated edge and drop out (an aggregate and a join).
3. A join on (anchor, content) compacts the pieces that repeat as a whole: those not in the smallest
   document go entirely. Where an anchor has one content only, its path does not branch and is done.
4. Where an anchor's path branches (two contents or more), each distinct content is opened once into
   its edges, at its first place in its smallest document, and an aggregate over edges finds those with a
   smaller document. These are joined back, by offset in the content, to all places of the content in that document.
5. Coordinates are joined to the texts and verified there: a span whose words do not have the recorded
   hash is an error. What is left is joined, counted and hashed.

Edges are compared by anchor and content hash, 128 bits together, never by words alone. Aggregates
combine before the shuffle, and joins on hot anchors or contents are plain sort-merge joins that adaptive
execution splits, so a passage in a third of all documents costs rows in proportion.

Null texts have no words. A null doc_id counts as larger than any other. Rows that share a doc_id never
remove each other's words; a text is known by its doc_id and its own hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import Sequence, chunks, covered, groups, runs, word_items
from .common import cut, map_batches, text_bytes

SPAN = "array<struct<first:int,last:int,h:long>>"
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc (never null) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))


def word_pieces(window: int, k: int):
    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for keys, texts in chunks(list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())), text_bytes(batch.column(1))):
            h, owner = word_items(texts)
            g = groups(Sequence(h), owner, window, k)
            base = np.searchsorted(owner, np.arange(len(texts)))[g["owner"]] if len(owner) else g["owner"]
            ids = np.array(keys, np.int64)[g["owner"]]
            out.append(pa.RecordBatch.from_arrays([pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), pa.array((g["first"] - base).astype(np.int32)), pa.array((g["last"] - base).astype(np.int32)), pa.array(g["anchor"]), pa.array(g["content"])], names=["doc", "th", "first", "last", "anchor", "h"]))
        return out

    return run


def confirmed(text: bytes, spans: list[dict], window: int) -> tuple[Sequence, np.ndarray, np.ndarray, np.ndarray]:
    """The text's sequence and first, last and hash of its spans, all of which its words must have."""
    seq = Sequence(word_items([text])[0])
    first, last, h = (np.array([s[x] for s in spans], np.int64) for x in ("first", "last", "h"))
    if len(first) and (last.max() + window >= len(seq.sums) or (seq.spans(first, last + window).view(np.int64) != h).any()):
        raise ValueError("a recorded span doesn't have its words")
    return seq, first, last, h


def opened(window: int):
    """Rows (doc, text, pieces) -> the edges of the pieces."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for doc, text, pieces in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            seq, first, last, h = confirmed(text, pieces, window)
            anchor = np.array([p["anchor"] for p in pieces], np.int64)
            n = last - first + 1
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(first, n) + offset
            edge = seq.spans(at, at + window).view(np.int64)
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc, np.int64)), pa.array(offset.astype(np.int32)), pa.array(np.repeat(anchor, n)), pa.array(np.repeat(h, n)), pa.array(edge)], names=["doc", "offset", "anchor", "content", "h"]))
        return out

    return run


def cleaned(window: int, digest: bool):
    """Rows (doc, text, spans) -> counts and what is left."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            words, gone = text.split(), None
            if spans:
                _, first, last, _ = confirmed(text, spans, window)
                gone = covered(len(words), first, last, window)
            n = len(words)
            if gone is not None:
                words = [words[i] for i in np.flatnonzero(~gone)]
            left = b" ".join(words)
            begin, end = runs(np.flatnonzero(gone)) if gone is not None else ([], [])
            rows.append((None if doc == NO_ID else doc, n, n - len(words), hashlib.sha256(left).hexdigest() if digest else left.decode(), [{"first": int(a), "last": int(b)} for a, b in zip(begin, end)]))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept", "spans"])

    return run


def gathered(spans: DataFrame, *fields: str, by: tuple = ("doc",)) -> DataFrame:
    return spans.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias("spans"))


def remove_repeats(docs: DataFrame, *, window: int = 50, k: int = 8, digest: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 (or kept, the words left), spans (removed word runs)."""
    if not 0 < k <= window:
        raise ValueError("k must lie between 1 and window")
    texts = keyed(docs).withColumn("th", F.xxhash64("text"))
    pieces = cut(map_batches(texts, word_pieces(window, k), "doc long, th long, first int, last int, anchor long, h long"))
    # written tables, so that a join with them deals both sides anew and a hot anchor or content can be split
    shared = cut(pieces.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), (F.min("h") < F.max("h")).alias("branches")).where("lo < hi").select("anchor", "branches"))
    shared_pieces = cut(pieces.join(shared, "anchor"))
    contents = cut(shared_pieces.groupBy("anchor", "h").agg(F.min(F.struct("doc", "th", "first", "last")).alias("source"), F.max("branches").alias("branches")))
    whole = shared_pieces.select("anchor", "h", "doc", "th", "first", "last").join(contents.select("anchor", "h", "source.doc").withColumnRenamed("doc", "least"), ["anchor", "h"]).where("doc > least")
    to_open = contents.where("branches").select("source.doc", "source.th", "source.first", "source.last", "anchor", "h")
    edges = cut(map_batches(texts.join(gathered(to_open, "first", "last", "h", "anchor", by=("doc", "th")), ["doc", "th"]).select("doc", "text", "spans"), opened(window), "doc long, offset int, anchor long, content long, h long"))
    least = cut(edges.groupBy("anchor", "h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"))
    again = edges.join(least, ["anchor", "h"]).where("doc > least").select("anchor", "content", "doc", "offset", "h").distinct()
    places = shared_pieces.where("branches").select("anchor", F.col("h").alias("content"), "doc", "th", "first").distinct()
    single = again.join(places, ["anchor", "content", "doc"]).withColumn("first", F.col("first") + F.col("offset"))
    spans = gathered(whole.select("doc", "th", "first", "last", "h").union(single.select("doc", "th", "first", F.col("first").alias("last"), "h")), "first", "last", "h", by=("doc", "th"))
    return map_batches(texts.join(spans, ["doc", "th"], "left").select("doc", "text", "spans"), cleaned(window, digest), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string, spans array<struct<first:int,last:int>>")
