"""Composed catalogue queries: a page of products, an export, a family of categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import catalog, taxonomy
from ..sources.tables import staged


@dataclass
class Catalogue:
    """The tables of a catalogue."""

    products: DataFrame
    categories: DataFrame
    links: DataFrame
    images: DataFrame
    attributes: DataFrame
    jobs: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Catalogue:
        names = ("fx_products", "fx_categories", "fx_product_categories", "fx_images", "fx_attributes", "fx_jobs")
        return cls(*(view(spark, sf_dir, n) for n in names))


def scope(c: Catalogue, category: str | None, include_children: bool) -> DataFrame | None:
    """The categories that a key (id, path or slug) means, with all below them if asked; empty if there is none."""
    if category is None:
        return None
    keys = c.categories.sparkSession.createDataFrame([(category,)], "key string")
    categories = staged(c.categories.select("id", "parent_id", "canonical_path", "slug"))  # read for each kind of key and each level
    found = taxonomy.resolve_category(keys, categories).where("category_id is not null").select(F.col("category_id").alias("id"))
    return taxonomy.descendants(categories, found) if include_children else found


def chosen(c: Catalogue, *, category: str | None = None, include_children: bool = False, **filters) -> DataFrame:
    return catalog.filter_products(c.products, links=c.links, categories=scope(c, category, include_children), **filters)


def products_page(c: Catalogue, *, number: int = 1, size: int = 20, sort_by: str | None = None, sort_order: str | None = None, **filters) -> DataFrame:
    """One page of list items with the total of all matches; children are gathered for the page alone."""
    found = chosen(c, **filters)
    total = found.agg(F.count("*").alias("total"))
    rows = staged(catalog.page(found, number, size, sort_by, sort_order))
    return catalog.list_items(rows, c.images, c.attributes, c.links, c.categories).crossJoin(total)  # one row


def export_products(c: Catalogue, *, category: str | None = None, strict_category: bool = False, sort_by: str | None = None, sort_order: str | None = None, **filters) -> DataFrame:
    """All matches. An unknown category filters nothing unless strict_category is set."""
    ids = scope(c, category, False)
    if ids is not None and not strict_category and ids.isEmpty():
        ids = None
    return catalog.filter_products(c.products, links=c.links, categories=ids, **filters).orderBy(*catalog.order(sort_by, sort_order))
