"""A supplier as constants and functions from landed documents to the engine's rows; another shop's forms need another
Supplier only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import extract, listing
from . import html


@dataclass(frozen=True)
class Supplier:
    name: str
    base: str  # address that relative links hang below
    cdn: str  # address of numbered images
    categories: Callable[[DataFrame, str], DataFrame]  # sitemap documents, base -> the snapshot of source categories
    items: Callable[[DataFrame], DataFrame]  # listing pages -> canonical_path, page, pos, item, key
    metadata: Callable[[DataFrame], DataFrame]  # listing pages -> canonical_path, asked, total, total_pages
    summaries: Callable[[DataFrame, str], DataFrame]  # items, base -> the short record of each
    products: Callable[[DataFrame, str], tuple[DataFrame, DataFrame]]  # documents, base -> products and rejects, staged
    descriptions: Callable[[DataFrame], DataFrame]  # documents -> sku and texts
    images: Callable[[DataFrame, str, str], DataFrame]  # documents, base, CDN -> images
    specifications: Callable[[DataFrame], DataFrame]  # documents -> pairs by rank and place
    category_nodes: Callable[[DataFrame, str], DataFrame]  # documents, base -> category nodes


def sitemap_snapshot(docs: DataFrame, base: str) -> DataFrame:
    """docs (doc_id, html) -> canonical_path, name, slug, level, parent_path, source_count; of equal paths the first stays."""
    nodes = html.sitemap_nodes(docs, f"{base}/en")
    first = nodes.groupBy("canonical_path").agg(F.min_by(F.struct("name", "level", "parent_path", "source_count"), F.struct("doc_id", "pos")).alias("x"))
    return first.select("canonical_path", "x.name", paths.slug(F.col("canonical_path")).alias("slug"), "x.level", "x.parent_path", F.col("x.source_count").cast("bigint").alias("source_count"))


SHOP = Supplier(
    "shop", "https://shop.example", "https://cdn.example/", sitemap_snapshot, listing.listing_items, listing.listing_metadata, listing.summaries, extract.products, extract.descriptions, extract.images, extract.product_specs, extract.category_nodes,
)
