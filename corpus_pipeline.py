"""A training-data pipeline over `documents`: five stages, each written as Parquet and reread by the next.

1. language_id: documents whose language isn't recognised (no text, no letters, or no sure language) go.
2. line_dedup: of lines that are equal or within two edits of another, the first stays. A document that had
   lines and has none left goes with them.
3. near_dedup: of documents linked by 0.8 or more of their five-word shingles, the smallest doc_id stays.
4. decontamination: documents that contain a benchmark item's question and answer go.
5. byte_bpe: what is left is encoded and decoded.

Every stage has the session hand its Python tasks small Arrow batches (`small_batches`), so that a task holds a few MB of
texts at a time beside what it remembers, in Python and in the JVM.

All stages but the last return the columns of documents. SQL can't express the trained and approximate
stages, so ORACLE_SQL is None and tests compare with brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.bm25 import without_leaks
from larder.llm.byte_bpe import encode_decode
from larder.llm.common import cut, read_table, small_batches
from larder.llm.langid import held_out, keep_known, train
from larder.llm.line_join import without_repeated_lines
from larder.llm.setsketch import near_duplicates


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with null texts or texts without letters go; null ids and repeated rows are judged by their text alone."""
    return keep_known(docs, train(docs.where(~held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without lines stay. Null doc_ids come last when the first occurrence of a line is sought,
    and rows that share a doc_id, null too, count as one document: at one place an equal line isn't a repeat."""
    counts = fresh("n_lines", docs), fresh("n_removed", docs)
    cleaned = without_repeated_lines(docs, counts=counts)
    return cleaned.where(F.col(counts[1]).isin(0) | (F.col(counts[1]) < F.col(counts[0]))).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is a document of its own, so repeated rows, null doc_ids and doc_ids with two texts are no special case:
    one row of each group stays, that of the smallest doc_id (null last; ties by place in the table). Rows without words stay."""
    row = fresh("row", docs)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), words=5, percent=80).select(F.col("doc_id").alias(row), F.col("component_id").alias("part"))
    groups = groups.join(groups.where(F.col("part") != F.col(row)).select("part").distinct(), "part", "left_semi")
    placed = groups.join(numbered.select(row, F.col("doc_id").cast("long").alias("doc")), row)
    stays = placed.groupBy("part").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", row)).alias("first")).select("part", F.col(f"first.{row}").alias("stays"))
    gone = placed.join(stays, "part").where(F.col(row) != F.col("stays")).select(row)
    return numbered.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts leak nothing and stay; each row is judged by its own text."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: null and empty texts have no ids, a null doc_id stays null."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, in_small_batches(f)) for f in (language_id, line_dedup, near_dedup, decontamination, byte_bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
