"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking by the original vectors.

1. Equal vectors (128-bit hash) collapse to one with a count of copies.
2. On a bounded sample (`sample` vectors) a rotation is learned by iterative quantisation (Gong and
   Lazebnik): principal axes, then alternating signs and orthogonal Procrustes. Vectors aren't
   centred, so signs depend on direction alone, as cosine does. Further rotations start elsewhere.
3. Codes are cut into substrings, each the key of one table. Substrings have about log2(n / 256) bits, and
   there are as many tables as a pair at the threshold needs to share one with probability `recall`; pairs
   closer than the threshold share one more surely. All vectors are indexed. Vectors of different lengths never
   link, so each length has tables of its own; one with at most `block` vectors is a single key.
4. The vectors under one key are compared by cosine in double precision. A pair is counted in the first
   table whose key it shares and nowhere else, so links are summed and no pair is ever a row; each group
   emits a row for each linked vector: its links and the smallest linked id within the group. A
   key with more than `block` vectors is dealt into blocks, two at a time to a task.
5. Components of those rows.

An entry carries its vector as packed numbers, 4 bytes each where the column is of floats, and its keys as
ints. The driver holds one length's sample at a time and a projection for each length with over `block` vectors.

Vectors that are null, zero or hold null or non-finite numbers link with nothing. A null vec_id counts as larger than any other; rows that share a vec_id count as
one node, each with its own links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import cut, map_batches
from .components import components
from .debruijn import NO_ID


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaling by the largest number first avoids overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """A projection (dimension x bits) whose signs are the code."""
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def plan(n: int, dim: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a substring and number of tables."""
    bits = max(1, min(dim, 24, max(4, math.ceil(math.log2(max(n, 2) / 256)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def keyed_vectors(models: dict[int, tuple[np.ndarray, int, int]], kind: str):
    """rep, copies, v -> rep, copies, length, packed vector, key in each table. models: projections, bits and tables by length."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column(2).to_pylist()
        sizes = np.array([len(v) for v in found], np.int32)
        keys: list = [[0]] * len(found)
        for d in set(sizes.tolist()) & models.keys():
            projections, bits, tables = models[d]
            at = np.flatnonzero(sizes == d)
            code = unit(np.array([found[i] for i in at], np.float64)) @ projections >= 0
            own = code.reshape(len(at), tables, bits) @ (1 << np.arange(bits)).astype(np.int64)
            for i, k in zip(at.tolist(), own.tolist()):
                keys[i] = k
        packed = [np.array(v, kind).tobytes() for v in found]
        cols = [batch.column(0), batch.column(1), pa.array(sizes), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, names=["rep", "copies", "d", "v", "keys"])

    return run


def compare(cosine: float, kind: str):
    """One key (or two blocks of it) of one table -> rep, n (links to copies of others), label."""

    def run(part: pa.Table) -> pa.Table:
        rep, copies, block = (part.column(c).to_numpy() for c in ("rep", "copies", "block"))
        d, t, first, second = (part.column(c)[0].as_py() for c in ("d", "t", "i", "j"))
        x = unit(np.frombuffer(b"".join(part.column("v").to_pylist()), kind).reshape(len(rep), d).astype(np.float64))
        keys = pc.list_flatten(part.column("keys")).to_numpy().reshape(len(rep), -1)
        order = np.argsort(rep, kind="stable")
        rep, copies, block, x, keys = rep[order], copies[order], block[order], x[order], keys[order]
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if first != second:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        for s in range(t):  # pairs that share an earlier key are counted there
            new = keys[a, s] != keys[b, s]
            a, b = a[new], b[new]
        n = np.bincount(a, copies[b], len(rep)).astype(np.int64)
        label = np.arange(len(rep))
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            new = new[new]
            if (new == label).all():
                break
            label = new
        has = n > 0
        return pa.table({"rep": pa.array(rep[has]), "n": pa.array(n[has]), "label": pa.array(rep[label[has]])})

    return run


def learn(known: np.ndarray, n: int, cosine: float, recall: float) -> tuple[np.ndarray, int, int]:
    """Projections of all tables, bits and tables for n vectors, from a sample of them."""
    dim = known.shape[1]
    bits, tables = plan(n, dim, cosine, recall)
    per_code = dim // bits
    return np.concatenate([rotation(known, dim, seed)[:, : per_code * bits] for seed in range(-(-tables // per_code))], axis=1)[:, : tables * bits], bits, tables


def near_links(vectors: DataFrame, *, cosine: float = 0.9, recall: float = 0.995, sample: int = 20_000, block: int = 1024, hot_keys: int = 1_000_000) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = rows.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    kind = "<f4" if vectors.select("embedding").schema[0].dataType.elementType == FloatType() else "<f8"
    good = sound.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    distinct = cut(good.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    models = {}
    for d, n in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > block).collect():
        drawn = F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(1_000_003)) <= min(1.0, sample / n) * 1_000_003
        known = [r.v for r in distinct.where((F.size("v") == d) & drawn).select("v").collect()]
        models[d] = learn(unit(np.array(known or [[1.0] * d])), n, cosine, recall)
    spread = cut(map_batches(distinct.select("rep", "copies", "v"), keyed_vectors(models, kind), "rep long, copies long, d int, v binary, keys array<int>"))
    entries = spread.select("*", F.posexplode("keys").alias("t", "key"))
    hot = cut(spread.select("d", F.posexplode("keys").alias("t", "key")).groupBy("d", "t", "key").agg(F.count("*").alias("size")).where(F.col("size") > block).select("d", "t", "key", F.ceil(F.col("size") / block).alias("blocks")))
    placed = entries.join(F.broadcast(hot) if hot.count() <= hot_keys else hot, ["d", "t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # a pair of different blocks has both; the pair of a block with itself has that block alone
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = cut(placed.select("d", "t", "key", "i", "j", "block", "rep", "copies", "v", "keys").groupBy("d", "t", "key", "i", "j").applyInArrow(compare(cosine, kind), "rep long, n long, label long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b"))).withColumnRenamed("id", "rep")
    of_rep = distinct.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(comps, "rep", "left")
    done = good.select("id", "h1", "h2").join(of_rep, ["h1", "h2"]).select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    bad = rows.where(~F.coalesce(F.col("v").isNotNull() & finite, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return shown(done.union(bad))


def shown(df: DataFrame) -> DataFrame:
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return df.select(known("id").alias("vec_id"), "n_links", known("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
