"""Suffix-array dedup over bytes through run-length compressed Burrows-Wheeler indexes.

Every byte that is covered by a `window` (400) byte string with another start anywhere goes. One index of
a whole corpus would have to pass through one machine, so the index is cut into shards that no match
crosses: a string's anchor (see anchors.py) is a function of its own bytes, hence all starts of a string
lie under one anchor.

1. Windows become groups by anchor, written as (doc, first, last, anchor, hash of the group's bytes).
2. Groups that repeat as a whole are found by an aggregate and marked by a join. Anchors with one start
   have no match and drop out.
3. Anchors with two or more different contents, one of them unique, need their strings compared. Their
   distinct contents are cut from the texts and trimmed: sorted by anchor and the bytes from the anchor on,
   and again by the bytes before it backwards, each keeps no more than it shares with a neighbour in order,
   since bytes beyond belong to no match. Range partitions split hot anchors; a row at the edge of a
   partition isn't trimmed on that side, which costs work and no match. Contents that are equal after
   trimming repeat as a whole and are done, so a passage in many contexts collapses to one content.
4. Distinct trimmed contents are dealt to shards by anchor, about `shard_bytes` each. A shard builds a
   run-length index: the BWT of its contents as runs, each run with its head and the suffix-array samples of
   its two ends. At those samples the match with the neighbouring rank is measured on the bytes; between
   samples it falls by one for each byte, since ranks inside a run keep their neighbours under LF. So matching
   statistics against everything else in the shard are streamed over each content from the run ends alone, and
   starts with `window` or more are marked.
5. An anchor with more than `most_contents` contents is split over shards. A match that covers the anchor has
   three quarters of `window` in one of four places around it, so contents meet under each of those four pieces,
   and each piece may lie in a shard of its own. Only contents that share such a piece stay together.
6. Marks are joined to the texts, verified against the recorded hash, and the rest is counted and hashed.

Texts are UTF-8 bytes; null is empty. Rows count as documents of their own even when they repeat or share
a doc_id; a null doc_id is an ordinary document. Strings are compared by anchor and hash, 128 bits, outside
the shards and byte by byte inside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Sequence, byte_items, chunks, covered, groups, runs
from .common import cut, map_batches, text_bytes
from .debruijn import NO_ID, gathered, keyed

SPANS = "doc long, first int, last int, h long"


@dataclass
class RunLengthIndex:
    """A BWT as runs. Symbols: 0 to m - 1 end the m contents, then the bytes."""

    run_starts: np.ndarray
    run_heads: np.ndarray
    run_start_samples: np.ndarray  # text position of each run's first rank
    run_end_samples: np.ndarray  # and of its last
    start_matches: np.ndarray  # symbols that the suffix at a run's start shares with the rank before
    end_matches: np.ndarray  # and that at its end with the rank after
    window: int

    @classmethod
    def build(cls, contents: list[bytes], window: int) -> RunLengthIndex:
        m = len(contents)
        lengths = np.array([len(c) for c in contents], np.int64)
        stops = np.cumsum(lengths + 1) - 1
        data = np.frombuffer(b"\0".join([*contents, b""]), np.uint8)
        text = data.astype(np.int64) + m
        text[stops] = np.arange(m)
        order = cls.sorted_suffixes(text)
        heads = text[order - 1]
        turns = np.concatenate(([0], np.flatnonzero(heads[1:] != heads[:-1]) + 1))
        ends = np.concatenate((turns[1:], [len(text)])) - 1
        room = np.repeat(stops, lengths + 1) - np.arange(len(text))  # symbols before the stop
        first, last = order[turns], order[ends]
        up, down = np.zeros(len(turns), np.int64), np.zeros(len(turns), np.int64)
        up[1:] = cls.shared(data, room, first[1:], order[turns[1:] - 1])
        down[:-1] = cls.shared(data, room, last[:-1], order[ends[:-1] + 1])
        return cls(turns, heads[turns], first, last, up, down, window)

    @staticmethod
    def sorted_suffixes(text: np.ndarray) -> np.ndarray:
        """By prefix doubling; the stops differ, so it ends at the longest content at the latest."""
        rank, k, n = text, 1, len(text)
        while True:
            later = np.zeros(n, np.int64)
            later[: max(0, n - k)] = rank[k:] + 1
            key = rank * (n + 300 + int(rank.max())) + later
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
            if rank[order[-1]] == n - 1:
                return order
            k *= 2

    @staticmethod
    def shared(data: np.ndarray, room: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b share before a stop, eight at a time."""
        padded = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint64)
        eights = sum(padded[i : i + len(data) + 8] << np.uint64(8 * i) for i in range(8))
        most = np.minimum(room[a], room[b])
        out = np.zeros(len(a), np.int64)
        left = np.flatnonzero(most > 0)
        while len(left):
            differ = eights[a[left] + out[left]] ^ eights[b[left] + out[left]]
            low = differ & (~differ + np.uint64(1))
            out[left] += np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            left = left[(differ == 0) & (out[left] < most[left])]
        return np.minimum(out, most)

    def matching_statistics(self, n: int) -> np.ndarray:
        """For each of n text positions, how much it shares with another suffix of the shard at most."""
        found = np.zeros(n, np.int64)
        for samples, matches in ((self.run_start_samples, self.start_matches), (self.run_end_samples, self.end_matches)):
            order = np.argsort(samples)
            at, length = samples[order], matches[order]
            reach = np.repeat(at + length, np.diff(np.concatenate((at, [n]))))
            found[at[0] :] = np.maximum(found[at[0] :], reach - np.arange(at[0], n))
        return found

    def long_matches(self, lengths: np.ndarray) -> list[np.ndarray]:
        """For each content, the starts whose match elsewhere has `window` bytes or more."""
        starts = np.cumsum(lengths + 1) - lengths - 1
        long = np.flatnonzero(self.matching_statistics(int((lengths + 1).sum())) >= self.window)
        parts = np.split(long, np.searchsorted(long, starts[1:]))
        return [p - s for p, s in zip(parts, starts)]


def byte_pieces(window: int, k: int):
    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for docs, texts in chunks(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            values, owner = byte_items(texts)
            g = groups(Sequence(values), owner, window, k)
            base = np.cumsum([0, *(len(t) for t in texts)])[g["owner"]]
            out.append(pa.RecordBatch.from_arrays([pa.array(np.array(docs, np.int64)[g["owner"]]), pa.array((g["first"] - base).astype(np.int32)), pa.array((g["last"] - base).astype(np.int32)), pa.array(g["anchor"]), pa.array(g["content"])], names=["doc", "first", "last", "anchor", "h"]))
        return out

    return run


def confirmed(text: bytes, spans: list[dict], window: int) -> tuple[Sequence, np.ndarray]:
    """The text's hashes, and which of the spans it has."""
    seq = Sequence(byte_items([text])[0])
    first, last, h = (np.array([s[x] for s in spans], np.int64) for x in ("first", "last", "h"))
    fits = last + window < len(seq.sums)
    fits[fits] = seq.spans(first[fits], last[fits] + window).view(np.int64) == h[fits]
    return seq, fits


PARTS = ("doc", "first", "anchor", "off", "content")


def cut_out(window: int, k: int):
    """Rows (doc, text, spans) -> the bytes of each span and where in them its anchor starts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            seq, right = confirmed(text, spans, window)
            grams = seq.all_of(k).view(np.int64)
            for s, fits in zip(spans, right):
                if fits:
                    a, b = s["first"], s["last"]
                    off = b - a + int((grams[b : a + window - k + 1] == s["anchor"]).argmax())
                    rows.append((doc, a, s["anchor"], off, text[a : b + window]))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(PARTS))

    return run


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def with_shared(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[list, int]]:
    """Sorted rows, each with how much of column `key` it shares with a neighbour of the same anchor (column 2).
    The first and the last row of a partition count as sharing all."""
    before, row, shared = None, None, 0
    for batch in batches:
        for new in zip(*(c.to_pylist() for c in batch.columns)):
            if row is not None:
                both = common(row[key], new[key]) if row[2] == new[2] else 0
                yield row, max(shared, both) if before is not None else len(row[key])
                shared = both
            before, row = row, new
    if row is not None:
        yield row, len(row[key])


def in_batches(rows: Iterator[tuple], names: list[str], kinds: tuple, most: int = 4000) -> Iterator[pa.RecordBatch]:
    from itertools import batched

    for part in batched(rows, most):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=names)


def trim_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, first, anchor, off, content, after), sorted -> after cut to what is shared, and before, backwards."""
    rows = ((r[0], r[1], r[2], r[3], r[5][:n], r[4][: r[3]][::-1]) for r, n in with_shared(batches, 5))
    return in_batches(rows, ["doc", "first", "anchor", "off", "after", "before"], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))


def trim_before(window: int):
    """Rows (doc, first, anchor, off, after, before), sorted -> what is left, where a window fits in it."""

    def rows(batches):
        for r, n in with_shared(batches, 5):
            content = r[5][:n][::-1] + r[4]
            if len(content) >= window:
                h = Sequence(byte_items([content])[0]).spans(np.array([0]), np.array([len(content)])).view(np.int64)[0]
                yield r[0], r[1] + r[3] - n, r[2], n, int(h), content

    return lambda batches: in_batches(rows(batches), ["doc", "first", "anchor", "off", "h", "content"], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))


def span_batch(doc, first, last, h) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(h, pa.int64())], names=["doc", "first", "last", "h"])


def match_shard(window: int):
    """All contents of a shard -> spans of long matches."""

    def run(shard: pa.Table) -> pa.Table:
        content = [x.as_py() for x in shard.column("content")]
        lengths = np.array([len(c) for c in content], np.int64)
        index = RunLengthIndex.build(content, window)
        docs, firsts, lasts, hashes = [], [], [], []
        for doc, first, text, starts in zip(shard.column("doc").to_pylist(), shard.column("first").to_pylist(), content, index.long_matches(lengths)):
            if len(starts):
                a, b = runs(starts)
                hashes.append(Sequence(byte_items([text])[0]).spans(a, b + window).view(np.int64))
                docs.append(np.full(len(a), doc, np.int64))
                firsts.append(a + first)
                lasts.append(b + first)
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (docs, firsts, lasts, hashes)]
        return pa.Table.from_batches([span_batch(joined[0], joined[1].astype(np.int32), joined[2].astype(np.int32), joined[3])])

    return run


def pieces_around(window: int):
    """Of columns (content, off): hashes of the four pieces around the anchor of which a match of `window` has one."""
    quarter = window // 4
    after = F.length("content") - F.col("off")

    def piece(before: int, ahead: int):
        inside = F.substring(F.col("content"), F.col("off") - before * quarter + 1, F.lit(3 * quarter))
        return F.when((F.col("off") >= before * quarter) & (after >= ahead * quarter), F.xxhash64(F.lit(before), "anchor", inside))

    return F.array_compact(F.array(piece(0, 3), piece(1, 2), piece(2, 1), piece(3, 0)))


def cleaned(window: int, digest: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            left, begin, end = text, [], []
            if spans:
                right = confirmed(text, spans, window)[1]
                first, last = (np.array([s[x] for s in spans], np.int64)[right] for x in ("first", "last"))
                gone = covered(len(text), first, last, window)
                begin, end = runs(np.flatnonzero(gone))
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((None if doc == NO_ID else doc, len(text), len(text) - len(left), len(begin), hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace"), [{"first": int(a), "last": int(b)} for a, b in zip(begin, end)]))
        cols = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, *, window: int = 400, k: int = 24, shard_bytes: int = 1_000_000, most_contents: int = 512, digest: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 (or kept, where a cut character
    becomes U+FFFD), spans (first and last removed byte of each run)."""
    if not 0 < k <= window:
        raise ValueError("k must lie between 1 and window")
    texts = keyed(docs)
    pieces = cut(map_batches(texts, byte_pieces(window, k), SPANS.replace("h long", "anchor long, h long")))
    # a written table, so that the join with it deals both sides anew and a hot anchor can be split
    shared = cut(pieces.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("h") < F.max("h")).alias("branches")).where("n > 1").select("anchor", "branches"))
    shared_pieces = cut(pieces.join(shared, "anchor"))
    contents = cut(shared_pieces.groupBy("anchor", "h").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "last")).alias("source"), F.max("branches").alias("branches")))
    whole = shared_pieces.join(contents.where("n > 1").select("anchor", "h"), ["anchor", "h"]).select("doc", "first", "last", "h")
    compared = contents.where("branches").groupBy("anchor").agg(F.count("*").alias("contents"), F.min("n").alias("least")).where("contents > 1 and least = 1").select("anchor")
    to_open = contents.join(compared, "anchor").select("source.doc", "source.first", "source.last", "h", "anchor")
    opened = cut(map_batches(texts.join(gathered(to_open, "first", "last", "h", "anchor"), "doc"), cut_out(window, k), "doc long, first int, anchor long, off int, content binary").withColumn("after", F.expr("substring(content, off + 1)")))
    half = opened.repartitionByRange("anchor", "after").sortWithinPartitions("anchor", "after").mapInArrow(trim_after, "doc long, first int, anchor long, off int, after binary, before binary")
    trimmed = cut(half.repartitionByRange("anchor", "before").sortWithinPartitions("anchor", "before").mapInArrow(trim_before(window), "doc long, first int, anchor long, off int, h long, content binary"))
    left = cut(trimmed.groupBy("anchor", "h").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "off", "content")).alias("s")))
    equal = trimmed.join(left.where("n > 1").select("anchor", "h"), ["anchor", "h"]).select("doc", "first", (F.col("first") + F.length("content") - window).alias("last"), "h")
    still = left.groupBy("anchor").agg(F.count("*").alias("contents"), F.min("n").alias("least")).where("contents > 1 and least = 1").select("anchor", (F.col("contents") > most_contents).alias("big"))
    compared_parts = cut(left.select("anchor", "s.*").join(still, "anchor"))
    size = compared_parts.agg(F.sum(F.length("content"))).first()[0] or 0
    groups_of = F.when(F.col("big"), pieces_around(window)).otherwise(F.array(F.xxhash64("anchor")))
    dealt = compared_parts.select("doc", "first", "content", F.explode(groups_of).alias("g")).withColumn("shard", F.pmod("g", F.lit(1 + size // shard_bytes)))
    shards = dealt.groupBy("shard", "doc", "first").agg(F.first("content").alias("content"))
    matched = shards.groupBy("shard").applyInArrow(match_shard(window), SPANS)
    spans = gathered(whole.union(equal).union(matched), "first", "last", "h")
    return map_batches(texts.join(spans, "doc", "left"), cleaned(window, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256' if digest else 'kept'} string, spans array<struct<first:int,last:int>>")
