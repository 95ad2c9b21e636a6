"""Helpers that the training-data operators share: tables, lineage cuts, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local master gets a folder of its own; on a
    cluster that would lie on another disk for each machine, so it is an error there."""
    found = spark.conf.get(DIR_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{DIR_KEY} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-cuts-")
        spark.conf.set(DIR_KEY, found)
    return found.rstrip("/")


def cut(df: DataFrame, keep: str | None = None) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by cut() that no later plan reads."""
    path = getattr(df, "cut_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """From here on the session hands Python tasks Arrow batches of about `most_bytes` at most, not whole partitions of texts;
    a smaller limit of its own stays. Batches are made when a plan runs, so the limit can't be taken back before that."""
    amount, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", spark.conf.get(BATCH_KEY).strip().lower()).groups()
    if not 0 < int(amount) << 10 * " kmgtp".index(unit or " ") <= most_bytes:
        spark.conf.set(BATCH_KEY, most_bytes)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = f(batch)
            yield from got if isinstance(got, list) else [got]

    return df.mapInArrow(run, schema)


def in_slices(column, step: int = 256) -> Iterator:
    """The values of an Arrow column, of which `step` at a time are Python objects."""
    for start in range(0, len(column), step):
        yield from column.slice(start, step).to_pylist()


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over an array of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
