"""What changed between two versions of a table, as rows; and the way back from those rows to the later version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """128 bits over the columns in the order given. Each value goes with its being NULL, so that NULLs keep their place."""
    parts = [c for n in columns for c in (F.col(n).isNull(), F.col(n))]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def change_feed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """op (insert, update, delete), key and the columns of `after`: one row for each key whose row is new, differs or is gone;
    the values of a deleted key are NULL. Keys are unique in both tables.

    Only keys and hashes meet in the full join; whole rows move for changed keys alone. Columns that one side lacks count
    as NULL there."""
    fields = [c for c in after.columns if c != key]
    filled = before.select(key, *(F.col(c) if c in before.columns else F.lit(None).cast(after.schema[c].dataType).alias(c) for c in fields))
    old, new = row_hashes(fields), row_hashes(fields)
    a = filled.select(key, F.struct(*old).alias("old"))
    b = after.select(key, F.struct(*new).alias("new"))
    op = F.when(F.col("old").isNull(), INSERT).when(F.col("new").isNull(), DELETE).when(F.col("old") != F.col("new"), UPDATE)
    ops = a.join(b, key, "full_outer").select(key, op.alias("op")).where("op is not null")
    return ops.join(after, key, "left").select("op", key, *fields)


def apply_feed(before: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The version after `before`: changed keys are replaced by the feed's rows. Applied twice it changes nothing more."""
    fields = [c for c in feed.columns if c != "op"]
    filled = before.select(*(F.col(c) if c in before.columns else F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in fields))
    return filled.join(feed.select(key), key, "left_anti").select(*fields).unionByName(feed.where(F.col("op") != DELETE).select(*fields))
