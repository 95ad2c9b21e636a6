"""A whole batch: landed listings and product documents become the next snapshot of every catalogue table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import extract, ledger, listing, merge, taxonomy
from ..sources.supplier import SHOP, Supplier
from ..sources.tables import spread, staged


class Tables(dict):
    """Tables by name; those given as functions are planned when they are first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        found = super().__getitem__(name)
        if not isinstance(found, DataFrame):
            found = self[name] = found()
        return found


def ingest(current: dict[str, DataFrame], snapshot: DataFrame, pages: DataFrame | Callable[[], DataFrame], raw: DataFrame, base: str | None = None, cdn: str | None = None, *, narrowed: bool = False, supplier: Supplier = SHOP, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """current: products (sku, …), categories, links (product key sku, canonical_path), and images and attributes (sku, …) if
    there are any. snapshot: source categories. pages: listing pages, or a function that lands them. raw: product documents. done (canonical_path): categories
    that the run's ledger holds as completed; their listings are left out, so a run that stopped goes on with the rest.
    Returns the tables and reports by name.

    What several outputs read is staged when the first of them is asked for: listed items and their short records, products
    and rejects. So a table costs what it needs, and a caller that takes all may put staged tables in place of these before
    the run's row is asked for.
    Membership comes from listings, never from a document's own categories. Links that a complete listing no longer
    shows go, unless the batch is narrowed to some categories. Children of products without a document in the batch stay.
    """
    base, cdn = base or supplier.base, cdn or supplier.cdn
    categories = merge.upsert_categories(current["categories"], snapshot)

    @cache
    def listings() -> DataFrame:
        found = pages() if callable(pages) else pages
        return found if done is None else found.join(done.select("canonical_path"), "canonical_path", "left_anti")

    @cache
    def items() -> DataFrame:
        return staged(supplier.items(listings()))

    # an item without a code is known by its id, as a document without a SKU is
    @cache
    def every() -> DataFrame:
        known = {"sku": F.coalesce(F.nullif("sku", F.lit("")), "product_id"), "product_id": F.coalesce(F.nullif("product_id", F.lit("")), "sku")}
        return staged(supplier.summaries(items(), base).withColumns(known).where("sku <> ''"))

    @cache
    def listed() -> DataFrame:
        return every().select("sku", "canonical_path").distinct()

    @cache
    def good_and_rejects() -> tuple[DataFrame, DataFrame]:
        return supplier.products(raw, base)

    @cache
    def own() -> DataFrame:
        good = good_and_rejects()[0].select("body")
        # sound documents hold all that rows of a body alone have; whatever else a row has is found by its body
        return good if raw.columns == ["body"] else staged(spread(raw.join(good, "body", "left_semi")))

    def products() -> DataFrame:
        good, fields = good_and_rejects()[0], ("product_id", "name", "price", "url")
        short = every().groupBy("sku").agg(F.min_by(F.struct(*fields), F.struct("canonical_path", "page", "pos")).alias("x")).select("sku", "x.*")
        fallback = listing.fallback_records(good.select("sku", "body"), short).select("sku", "product_id", "title", "price", "url", F.lit("EUR").alias("currency"))
        nodes = extract.legacy_category_ids(supplier.category_nodes(own(), base))
        whole = good.drop("body").join(supplier.descriptions(own()), "sku", "left").join(nodes, "sku", "left")
        incoming = whole.unionByName(fallback, allowMissingColumns=True).withColumn("seq", F.lit(0))
        return merge.upsert_products(current["products"], merge.fold_incoming(incoming, "seq"))

    @cache
    def status() -> DataFrame:
        failed = listing.failed_details(supplier.summaries(items(), base), good_and_rejects()[1])
        return listing.listing_status(listings(), failed, items(), supplier.metadata(listings()))

    @cache
    def kept_and_removed() -> tuple[DataFrame, DataFrame]:
        links = current["links"].select("sku", "canonical_path").union(listed()).distinct()
        if narrowed:
            return links, links.limit(0)
        complete = tables["listing_status"].where("status = 'complete'").select("canonical_path")
        gone = links.join(complete, "canonical_path", "left_semi").join(listed(), ["sku", "canonical_path"], "left_anti")
        return links.join(gone, ["sku", "canonical_path"], "left_anti"), gone

    def children(name: str, incoming: DataFrame) -> DataFrame:
        return merge.replace_children(current[name], incoming, "sku") if name in current else incoming

    @cache
    def counts() -> DataFrame:
        return staged(taxonomy_counts(categories, tables["links"]))

    def run() -> DataFrame:
        created = listed().join(current["links"], ["sku", "canonical_path"], "left_anti").agg(F.count("*").alias("links_created"))
        existing = listed().join(current["links"], ["sku", "canonical_path"], "left_semi").agg(F.count("*").alias("links_existing"))
        removed = kept_and_removed()[1].agg(F.count("*").alias("links_removed"))
        differing = counts().join(snapshot.select("canonical_path", "source_count"), "canonical_path").where("source_count <> 0 and source_count <> product_count")
        counters = ledger.batch_counters(tables["products"], good_and_rejects()[1], tables["listing_status"], listings(), differing)
        return counters.crossJoin(created).crossJoin(existing).crossJoin(removed)  # rows of one

    tables = Tables({
        "categories": categories,
        "products": products,
        "links": lambda: kept_and_removed()[0],
        "images": lambda: children("images", supplier.images(own(), base, cdn)),
        "attributes": lambda: children("attributes", extract.dedupe_specs(supplier.specifications(own()))),
        "rejects": lambda: good_and_rejects()[1],
        "listing_status": status,
        "counts": counts,
        "run": run,
    })
    return tables


def taxonomy_counts(categories: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct products of each path and of all paths below it."""
    pairs = taxonomy.path_pairs(categories).union(categories.select(F.col("canonical_path").alias("ancestor_path"), F.col("canonical_path").alias("descendant_path")))
    own = pairs.join(links.withColumnRenamed("canonical_path", "descendant_path"), "descendant_path").select("ancestor_path", "sku").distinct()
    counts = own.groupBy(F.col("ancestor_path").alias("canonical_path")).agg(F.count("*").alias("product_count"))
    return categories.select("canonical_path").join(counts, "canonical_path", "left").na.fill(0)
