"""Near-dedup with SetSketch registers.

Each document's set is its distinct word shingles. Its sketch holds `m` registers; register i is
floor(1 - log_b(x)) of the smallest of the set's exponential variates under hash i, cut to 0 .. q + 1.
Registers merge by maximum, and equal registers are the more likely the more alike the sets are.

1. Whole texts are sketched in one pass; equal sets (128-bit digest) collapse to their smallest doc_id.
2. Bands of registers become bucket keys. At 32 bands of 4 registers a pair at similarity 0.8 shares no
   bucket with probability below 1e-7. Each member of a bucket is paired with the bucket's smallest.
3. Pairs are judged by joint maximum likelihood over register comparisons and known set sizes: a pair goes
   on unless similarity 0.8 is 5 standard errors off. Survivors are confirmed on full sets.
4. Confirmed links give components. Members of one leader's buckets that still lie in different components
   may be linked to each other: they are dealt into blocks of about `block`, two at a time to a task, and
   compared by likelihood. Members with a likely partner are compared again on full sets, by matrix
   products within a task, which emits one link for each pair of components. Pairs are never rows, and no
   bucket is capped.
5. Components of all links.

Aggregates combine before shuffles and joins on hot keys (a set with a third of all rows, a bucket, its
smallest member) are plain sort-merge joins that adaptive execution splits.

Null or empty texts have an empty set, linked with nothing. A null doc_id counts as larger than any other,
and rows that share a doc_id count as one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Sequence, chunks, word_items
from .common import cut, map_batches, mix64, text_bytes
from .components import components
from .debruijn import NO_ID, keyed

BASE = 1.02
Q = 2046
SEEDS = mix64(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; A-Z in lower case. Short texts are one shingle."""
    h, owner = word_items([t.lower() for t in texts])
    seq = Sequence(h)
    grams = seq.all_of(words)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(seq.spans(np.array([a]), np.array([b])) if b > a else np.empty(0, np.uint64))
    return out


def registers(values: np.ndarray, m: int) -> np.ndarray:
    """The m registers of a non-empty set of 64-bit hashes."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    scale, shift = (SEEDS[:m] | np.uint64(1)).astype(np.uint32), (SEEDS[:m] >> np.uint64(32)).astype(np.uint32)
    best = np.full(m, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        part = low[i : i + 1024, None] * scale
        part += shift
        np.minimum(best, part.min(axis=0), out=best)
    x = -np.log1p(-(best + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of `rows` registers."""
    packed = regs.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(packed) + 1, dtype=np.uint64)
    for i in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + packed[:, i])
    return out.view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, errors: float = 5.0) -> np.ndarray:
    """Which pairs (registers by row, set sizes) may have 100 * intersection >= percent * union."""
    u, v = na / (na + nb), nb / (na + nb)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less

    def part(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j):
        up, down = part(u - v * j), part(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    top = np.minimum(u / v, v / u)
    wanted = log_likelihood(np.minimum(percent / 100, top))
    low = np.max([log_likelihood(j * np.minimum(percent / 100, top)) for j in np.linspace(0, 1, 33)], axis=0)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (low - wanted <= errors * errors / 2)


def sketched(words: int, m: int, rows: int):
    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for docs, texts in chunks(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            sets = shingle_sets(texts, words)
            regs = [registers(s, m) if len(s) else None for s in sets]
            digest = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            out.append(
                pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([None if r is None else r.tobytes() for r in regs], pa.binary()), pa.array([None if r is None else band_keys(r, rows) for r in regs], pa.list_(pa.int64()))],
                    names=["doc", "n", "d1", "d2", "regs", "keys"],
                )
            )
        return out

    return run


def matrix(column) -> np.ndarray:
    x = column.to_pylist()
    return np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1)


def judge(percent: int):
    """Rows (a, b, na, ra, nb, rb) -> (a, b) of the likely ones."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = likely(matrix(batch.column(3)), matrix(batch.column(5)), batch.column(2).to_numpy(), batch.column(4).to_numpy(), percent) if batch.num_rows else np.empty(0, bool)
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def confirm(words: int, percent: int):
    """Rows (a, b, text of b, text of a) -> (a, b) whose full sets are alike enough; the sets of the last a are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(batch.column(0).to_pylist(), text_bytes(batch.column(3)), text_bytes(batch.column(2))):
                if (a, text_a) != last:
                    last, own = (a, text_a), shingle_sets([text_a], words)[0]
                other = shingle_sets([text_b], words)[0]
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def sides(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a group's two blocks, which may be the same."""
    block = part.column("block").to_numpy()
    return np.flatnonzero(block == part.column("i")[0].as_py()), np.flatnonzero(block == part.column("j")[0].as_py())


def likely_members(percent: int):
    """Two blocks of a leader's members -> those with a likely partner in another component, never the pairs."""

    def run(part: pa.Table) -> pa.Table:
        leader, rep, comp, n = (part.column(c).to_numpy() for c in ("leader", "rep", "comp", "n"))
        regs, (a_side, b_side) = matrix(part.column("regs")), sides(part)
        found = np.zeros(len(rep), bool)
        for i in a_side:
            others = b_side[comp[b_side] != comp[i]]
            if len(others):
                others = others[likely(np.broadcast_to(regs[i], (len(others), regs.shape[1])), regs[others], np.full(len(others), n[i]), n[others], percent)]
                found[others] = True
                found[i] |= len(others) > 0
        return pa.table({"leader": pa.array(leader[found], pa.int64()), "rep": pa.array(rep[found], pa.int64()), "comp": pa.array(comp[found], pa.int64())})

    return run


def intersections(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of a few sets, by products of 0-1 matrices over a range of elements at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(uses > 1) - 1
    mine = uses[column] > 1
    owner, column = owner[mine], shared[column[mine]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        ones = np.zeros((len(sets), width), np.float32)
        ones[owner[a:b], column[a:b] - start] = 1
        out += (ones @ ones.T).astype(np.int64)
    return out


def linked_components(percent: int):
    """Two blocks of a leader's members with their full sets -> one confirmed link for each pair of components."""

    def run(part: pa.Table) -> pa.Table:
        rep, comp = part.column("rep").to_numpy(), part.column("comp").to_numpy()
        sets, (a_side, b_side) = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()], sides(part)
        both, size = intersections(sets), np.array([len(x) for x in sets])
        alike = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :])
        a, b = np.nonzero(alike[np.ix_(a_side, b_side)])
        a, b = a_side[a], b_side[b]
        _, first = np.unique(np.stack((np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b]))), axis=1, return_index=True)
        return pa.table({"a": pa.array(rep[a[first]], pa.int64()), "b": pa.array(rep[b[first]], pa.int64())})

    return run


def set_batches(words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s.tobytes() for _, texts in chunks(batch.column(0).to_pylist(), text_bytes(batch.column(1))) for s in shingle_sets(texts, words)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "shingles"])

    return run


def dealt(members: DataFrame, block: int) -> DataFrame:
    """Members of each leader in blocks of about `block`, once for each other block they meet."""
    size = cut(members.groupBy("leader").agg(F.ceil(F.count("*") / block).alias("blocks")))
    placed = members.join(size, "leader").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), "blocks"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, m: int = 128, rows: int = 4, block: int = 128) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id)."""
    if m % rows or m > len(SEEDS):
        raise ValueError("m must be a multiple of rows, 1024 at most")
    texts = keyed(docs)
    sketch = cut(map_batches(texts, sketched(words, m, rows), "doc long, n long, d1 long, d2 long, regs binary, keys array<long>"))
    sets = cut(sketch.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc", "n", "regs", "keys")).alias("s")).select("d1", "d2", F.col("s.doc").alias("rep"), "s.n", "s.regs", "s.keys"))
    nodes = sets.select("rep", "n", "regs")
    bands = sets.select("rep", F.explode("keys").alias("key"))
    # written tables, here and in dealt(), so that a join with them deals both sides anew and a hot key can be split
    buckets = cut(bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1"))
    members = cut(bands.join(buckets, "key"))

    ends = [nodes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")) for x in "ab"]
    stars = members.where("leader < rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    judged = map_batches(stars.join(ends[1], "b").join(ends[0], "a").select("a", "b", "na", "ra", "nb", "rb"), judge(percent), "a long, b long")
    full = judged.join(texts.withColumnsRenamed({"doc": "b", "text": "tb"}), "b").join(texts.withColumnsRenamed({"doc": "a", "text": "ta"}), "a")
    links = cut(full.select("a", "b", "tb", "ta").mapInArrow(confirm(words, percent), "a long, b long"))
    first = components(links)
    placed = members.where("size > 2 and leader < rep").select("leader", "rep").distinct().join(first.withColumnsRenamed({"id": "rep", "component_id": "comp"}), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    placed = cut(placed)
    open_leaders = placed.groupBy("leader").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("leader")
    rest = dealt(placed.join(open_leaders, "leader"), block).join(nodes, "rep")
    found = cut(rest.select("leader", "i", "j", "rep", "comp", "n", "regs", "block").groupBy("leader", "i", "j").applyInArrow(likely_members(percent), "leader long, rep long, comp long").distinct())
    own = map_batches(found.select(F.col("rep").alias("doc")).distinct().join(texts, "doc"), set_batches(words), "rep long, shingles binary")
    late = cut(dealt(found, block).join(own, "rep").select("leader", "i", "j", "rep", "comp", "shingles", "block").groupBy("leader", "i", "j").applyInArrow(linked_components(percent), "a long, b long").distinct())
    comps = first if late.isEmpty() else components(links.union(late))
    of_sets = sets.select("d1", "d2", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component_id", "rep").alias("component"))
    out = sketch.select("doc", "n", "d1", "d2").join(of_sets, ["d1", "d2"], "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")))
    shown = {c: F.when(F.col(x) != NO_ID, F.col(x)) for c, x in (("doc_id", "doc"), ("component_id", "component"))}
    return out.select(shown["doc_id"].alias("doc_id"), F.col("n").alias("n_shingles"), shown["component_id"].alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
