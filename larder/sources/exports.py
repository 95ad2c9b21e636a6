"""Exports as files: products in order, one document for each SKU."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def write_products_json(products: DataFrame, folder: str, most_rows: int = 1_000_000) -> None:
    """Products in the order they come in, as JSON lines of `most_rows` a file at most. A sorted DataFrame is dealt by ranges,
    so tasks write at once and the files, by name, hold the whole order."""
    products.write.mode("overwrite").option("maxRecordsPerFile", most_rows).json(folder)


def product_documents(products: DataFrame, buckets: int = 64) -> DataFrame:
    """products (sku, ..) -> bucket, file_key, document: the row as JSON under the SKU without slashes."""
    keyed = products.select(text.file_key(F.col("sku")).alias("file_key"), F.to_json(F.struct(*products.columns)).alias("document"))
    return keyed.select(F.pmod(F.xxhash64("file_key"), F.lit(buckets)).alias("bucket"), "file_key", "document")


def write_product_files(products: DataFrame, folder: str, buckets: int = 64, *, one_file_each: bool = False) -> None:
    """Documents below a folder for each bucket of file keys: lines of file_key and document, or with one_file_each a folder
    for each key that holds the document alone. SKUs that share a key share its folder, one line each; none is written over."""
    documents = product_documents(products, buckets)
    if one_file_each:
        documents.repartition("bucket").sortWithinPartitions("bucket", "file_key").write.mode("overwrite").partitionBy("bucket", "file_key").text(folder)
    else:
        documents.repartition("bucket").sortWithinPartitions("bucket", "file_key").write.mode("overwrite").partitionBy("bucket").json(folder)


def file_key_collisions(products: DataFrame) -> DataFrame:
    """file_key, skus: keys that several SKUs have, and how many."""
    return products.groupBy(text.file_key(F.col("sku")).alias("file_key")).agg(F.count_distinct("sku").alias("skus")).where("skus > 1")
