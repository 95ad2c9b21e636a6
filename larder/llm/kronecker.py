"""Hard negatives by Kronecker-packed products: several candidates' components in separated fields of one integer.

Components are integers, floor(scale * x). A packed number holds the components of `fields` candidates, each raised by
a bias so that none is negative and each in a field wide enough for a whole inner product with a raised anchor. One
multiplication for each anchor component serves all fields, sums never carry from one field into the next, and exact
scores are unpacked by shifts and the removal of the biases. While fields fit into 53 bits, doubles hold the integers
exactly and a matrix product does the work; wider fields are packed into Python's unbounded integers.

1. Rows that take part are written once, as the smallest integers that hold them, each with a row number.
2. Anchors and candidates are dealt into blocks of about `block` rows by a hash of the row number, whatever their
   labels or values, so a label with a third of all rows weighs on no task. Each task scores one block of anchors
   against one of candidates.
3. First pass: each task returns an anchor's best `positives` candidates of its label; a window keeps the best of all.
4. Second pass: scores are made again, since the limits depend on the positives of all blocks. For each anchor
   and positive a task returns its best `negatives` rows of other labels between the limits; a window ranks them.

No task holds more than two blocks, and a block returns a bounded number of rows for each anchor and positive.

Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors score only against
vectors of their length; empty ones score 0. Each row stands alone: rows that share a vec_id are others of each other,
and each of several anchors with one vec_id has rows of its own. A null vec_id is never an anchor's and comes last
among equal scores. An empty table gives no rows. Components so large that a score may not fit 64 bits are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

EXACT_BITS = 53  # a double holds all integers below 2 ** 53
WIDE_FIELDS = 16  # fields of an unbounded integer


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x candidates) of rows of 64-bit integers that fit 64 bits."""
    (m, dim), n = anchors.shape, len(candidates)
    if not m or not n or not dim:
        return np.zeros((m, n), np.int64)
    bias_a, bias_c = int(anchors.min()), int(candidates.min())
    span_a, span_c = int(anchors.max()) - bias_a, int(candidates.max()) - bias_c
    width = max(1, (dim * span_a * span_c).bit_length())
    fields = EXACT_BITS // width
    kind = np.float64 if fields else object
    fields = min(fields, n) or WIDE_FIELDS
    raised_a = (anchors.astype(kind) - bias_a).astype(kind)
    raised_c = np.zeros((-(-n // fields) * fields, dim), kind)
    raised_c[:n] = candidates.astype(kind) - bias_c
    parts = raised_c.reshape(-1, fields, dim)
    packed = parts[:, 0]
    for f in range(1, fields):
        packed = packed + parts[:, f] * (1 << width * f)
    sums = raised_a @ packed.T
    if kind is not object:
        sums = sums.astype(np.int64)
    mask = (1 << width) - 1
    found = np.stack([(sums >> (width * f)) & mask for f in range(fields)], axis=2).reshape(m, -1)[:, :n]
    # (a - p)(c - q) summed is ac - pC - qA + dim pq, where A and C are the sums of the components
    of_a, of_c = (x.astype(kind if kind is object else np.int64).sum(axis=1) for x in (anchors, candidates))
    return (found + bias_c * of_a[:, None] + bias_a * of_c[None, :] - dim * bias_a * bias_c).astype(np.int64)


def first(s: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest numbers, greatest first, equal ones in order."""
    at = np.arange(len(s)) if len(s) <= k else np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    return at[np.argsort(-s[at], kind="stable")[:k]]


def by_length(part: pa.Table) -> dict[int, tuple[pa.Table, np.ndarray]]:
    """The rows for each length of vector, by ascending id and row, and their vectors as a matrix."""
    part = part.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls come last
    sizes = pc.list_value_length(part.column("v")).to_numpy()
    out = {}
    for d in np.unique(sizes).tolist():
        own = part.filter(pa.array(sizes == d))
        out[d] = own, pc.list_flatten(own.column("v")).to_numpy().astype(np.int64).reshape(own.num_rows, d)
    return out


def meetings(left: pa.Table, right: pa.Table, most: int = 500_000) -> Iterator[tuple[dict, pa.Table, np.ndarray, np.ndarray]]:
    """For each anchor: its row, the candidates of its length, its scores and whether a candidate has its label; about
    `most` scores are held at a time."""
    candidates = by_length(right)
    for d, (anchors, a) in by_length(left).items():
        if d not in candidates:
            continue
        others, c = candidates[d]
        labels, step = others.column("label").to_numpy(), max(1, most // len(c))
        for start in range(0, len(a), step):
            found = scores(a[start : start + step], c)
            for anchor, s in zip(anchors.slice(start, step).drop_columns("v").to_pylist(), found):
                yield anchor, others, s, labels == anchor["label"]


def best_positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for anchor, others, s, same in meetings(left, right):
            at = np.flatnonzero(same & (others.column("row").to_numpy() != anchor["row"]))
            at = at[first(s[at], k)]
            out += [(anchor["row"], int(s[i]), others["id"][i].as_py(), others["row"][i].as_py()) for i in at.tolist()]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("anchor", "score", "id", "row"), list(zip(*out)) or [[]] * 4)})

    return run


def best_negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for anchor, others, s, same in meetings(left, right):
            differ = np.flatnonzero(~same)
            s = s[differ]
            for p in anchor["positives"]:
                least, most = -(-low * p["score"] // 100), high * p["score"] // 100
                at = np.flatnonzero((s >= least) & (s <= most))
                for i in at[first(s[at], k)].tolist():
                    j = int(differ[i])
                    out.append((anchor["row"], p["place"], anchor["id"], p["id"], p["score"], others["id"][j].as_py(), int(s[i]), others["row"][j].as_py()))
        names = ("anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score", "row")
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, list(zip(*out)) or [[]] * len(names))})

    return run


def taking_part(vectors: DataFrame, scale: int) -> DataFrame:
    """vectors (vec_id, label, embedding) -> row, id, label, v (integers) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * float(scale))).alias("v")
    )


def hard_negatives(vectors: DataFrame, *, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = 8192) -> DataFrame:
    """vectors (vec_id, label, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`. A negative's score lies between `low` and `high` percent
    of the positive's."""
    rows = cut(taking_part(vectors, scale))
    size = F.transform("v", lambda x: F.abs(x))
    n, n_anchors, dim, top = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("v")), F.max(F.array_max(size))).first()
    top = top or 0
    if (dim or 0) * top * top >= 1 << 63:
        raise OverflowError("components are too large for scores of 64 bits")
    kind = "smallint" if top < 1 << 15 else "int" if top < 1 << 31 else "bigint"
    blocks_a, blocks_c = (max(1, math.ceil(x / block)) for x in (n_anchors, n))
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    dealt = lambda df, own, other, own_blocks, other_blocks: df.withColumns({own: F.pmod(F.xxhash64("row"), F.lit(own_blocks)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_blocks - 1).cast("long")))})
    candidates = dealt(rows.toDF(*rows.columns), "c", "a", blocks_c, blocks_a).groupBy("a", "c")  # columns of its own beside the anchors'
    anchors = rows.where(F.col("id") % every == 0)
    order = (F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    near = dealt(anchors, "a", "c", blocks_a, blocks_c).groupBy("a", "c").cogroup(candidates).applyInArrow(best_positives(positives), "anchor long, score long, id long, row long")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= positives)
    near = cut(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "id", "score"))).alias("positives")))
    again = dealt(anchors.join(near.withColumnRenamed("anchor", "row"), "row"), "a", "c", blocks_a, blocks_c).groupBy("a", "c")
    found = again.cogroup(candidates).applyInArrow(best_negatives(negatives, low, high), "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, row long")
    by = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), F.asc("row"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def moved_labels(vectors: DataFrame, modulus: int = 7, labels: int = 10) -> DataFrame:
    """vectors with (label + 1) % labels where vec_id is divisible by `modulus`: label noise that a miner must stand."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", F.when(F.col("vec_id") % modulus == 0, (label + 1) % labels).otherwise(label).alias("label"), "embedding")
