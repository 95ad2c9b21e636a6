"""Merges as new snapshots: read the target and the batch, join, return what the target becomes.

Every function is idempotent: applied twice with the same batch it changes nothing the second time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How an incoming field meets the stored one.
NON_EMPTY = ("product_id", "ean", "title", "brand", "url", "category_ids")  # a value that is neither NULL nor '' wins
NOT_NULL = ("description", "short_description", "long_description", "price", "stock", "stock_status", "raw_json")  # any value wins


def fold_incoming(incoming: DataFrame, order: str, key: str = "sku") -> DataFrame:
    """One row for each key: for each field the last value, in order, that its rule lets win. An aggregate, so a key
    that repeats often combines before the shuffle."""

    def last(c: str) -> Column:
        value = F.nullif(c, F.lit("")) if c in NON_EMPTY else F.col(c)
        return F.max_by(value, F.when(value.isNotNull(), F.col(order)))

    fields = [c for c in incoming.columns if c not in (key, order, "regular_price")]
    aggs = [last(c).alias(c) for c in fields]
    if "regular_price" in incoming.columns:
        either = F.coalesce("regular_price", "price")
        aggs.append(F.max_by(either, F.when(either.isNotNull(), F.col(order))).alias("regular_price"))
    return incoming.groupBy(key).agg(*aggs)


def upsert_products(current: DataFrame, folded: DataFrame, key: str = "sku", at: datetime | None = None) -> DataFrame:
    """current and folded products -> every product with its merged fields, is_new and touched.

    A price without a regular price sets both, and a new product's short description falls back to its description.
    Products of the batch are active, and updated at `at` if it is given. Columns that only the batch has are added.
    """
    if "price" in folded.columns and "regular_price" in current.columns:
        own = [F.col("regular_price")] if "regular_price" in folded.columns else []
        folded = folded.withColumn("regular_price", F.coalesce(*own, "price"))
    current = current.select("*", *(F.lit(None).cast(folded.schema[c].dataType).alias(c) for c in folded.columns if c not in current.columns))
    new = folded.select(F.col(key), *(F.col(c).alias(f"in_{c}") for c in folded.columns if c != key), F.lit(True).alias("touched"))
    both = current.withColumn("known", F.lit(True)).join(new, key, "full_outer")
    added, seen = F.col("known").isNull(), F.coalesce("touched", F.lit(False))

    def merged(c: str) -> Column:
        value = F.coalesce(f"in_{c}", c) if c in folded.columns else F.col(c)
        if c == "short_description" and "description" in folded.columns:
            value = F.when(added, F.coalesce(F.nullif(value, F.lit("")), "in_description")).otherwise(value)
        if c == "is_active":
            value = F.when(seen, F.lit(True)).otherwise(F.col(c))
        if c == "updated_at" and at is not None:
            value = F.when(seen, F.lit(at)).otherwise(F.col(c))
        return value.alias(c)

    fields = [merged(c) for c in current.columns if c != key]
    return both.select(key, *fields, added.alias("is_new"), seen.alias("touched"))


def replace_children(current: DataFrame, incoming: DataFrame, key: str = "product_id") -> DataFrame:
    """Children of keys that the batch has children for are replaced, all others stay."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(current.columns))


def link_products(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """product_id, category_id, and whether the link is created, existing or untouched."""
    both = current.distinct().withColumn("old", F.lit(True)).join(proposed.distinct().withColumn("new", F.lit(True)), ["product_id", "category_id"], "full_outer")
    return both.select("product_id", "category_id", F.when(F.col("old").isNull(), "created").when(F.col("new").isNotNull(), "existing").otherwise("untouched").alias("state"))


def remove_stale(current: DataFrame, seen: DataFrame, complete: DataFrame) -> DataFrame:
    """current links and whether each is removed: its category was read completely and the product wasn't seen there."""
    done = complete.select("category_id").distinct().withColumn("done", F.lit(True))
    there = seen.select("product_id", "category_id").distinct().withColumn("there", F.lit(True))
    both = current.join(done, "category_id", "left").join(there, ["product_id", "category_id"], "left")
    return both.select("product_id", "category_id", (F.col("done").isNotNull() & F.col("there").isNull()).alias("removed"))


def upsert_categories(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """By path: the snapshot's name, slug, level and parent win; seen categories are active with a streak of 0."""
    new = snapshot.select("canonical_path", *(F.col(c).alias(f"in_{c}") for c in ("name", "slug", "level", "parent_path", "source_count")))
    both = current.withColumn("known", F.lit(True)).join(new.withColumn("seen", F.lit(True)), "canonical_path", "full_outer")
    seen = F.coalesce("seen", F.lit(False))
    return both.select(
        "canonical_path", *(F.when(seen, F.col(f"in_{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "slug", "level", "parent_path")),
        (seen | F.coalesce("is_active", F.lit(False))).alias("is_active"), F.when(seen, F.lit(0)).otherwise(F.col("missing_streak")).alias("missing_streak"), F.col("known").isNull().alias("is_new"),
    )


def deactivate_absent(current: DataFrame, snapshot: DataFrame, threshold: int = 2) -> DataFrame:
    """Absent categories count one more miss and go inactive at the threshold; present ones start anew."""
    both = current.join(snapshot.select("canonical_path").distinct().withColumn("seen", F.lit(True)), "canonical_path", "left")
    streak = F.when(F.col("seen").isNotNull(), F.lit(0)).otherwise(F.col("missing_streak") + 1)
    return both.select("canonical_path", streak.alias("missing_streak"), (F.col("is_active") & (F.col("seen").isNotNull() | (streak < max(1, threshold)))).alias("is_active"))


def changed_counts(categories: DataFrame, counts: DataFrame) -> DataFrame:
    """categories (id, product_count) and new counts -> id, product_count, changed."""
    return categories.select("id", F.col("product_count").alias("old")).join(counts, F.col("id") == F.col("category_id"), "left").select("id", F.coalesce("product_count", F.lit(0)).alias("product_count"), (~F.col("old").eqNullSafe(F.coalesce("product_count", F.lit(0)))).alias("changed"))


def conflict_paths(rows: DataFrame, path: Column) -> DataFrame:
    """rows (id, …) -> id, canonical_path, is_active: the first id of a path keeps it, later ones get a path of their own."""
    by = F.row_number().over(Window.partitionBy("p").orderBy("id"))
    n = F.col("id").cast("string")
    numbered = rows.select("id", "is_active", path.alias("p")).withColumn("r", by)
    fixed = F.when(F.col("p").isin("", "/"), F.concat(F.lit("/en/legacy-"), n, F.lit("/"))).when(F.col("r") > 1, F.concat(F.lit("/en/__conflict-"), n, F.lit("/"))).otherwise(F.col("p"))
    return numbered.select("id", fixed.alias("canonical_path"), (F.col("is_active") & ((F.col("r") == 1) | F.col("p").isin("", "/"))).alias("is_active"))
