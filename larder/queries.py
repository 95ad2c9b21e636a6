"""The catalogue operators as queries over the given tables, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from html import entities, unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import oracle, view
from .functions import paths, text
from .operators import catalog, taxonomy
from .plans import catalogue
from .plans.catalogue import Catalogue
from .sources import exports, html, tables
from .sources.tables import key_of, shared_folder, spread, staged, write_snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BASE, CDN = "https://shop.example", "https://cdn.example/"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


def over(*views: str):
    """A query as a function of views."""

    def wrap(f):
        return lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))

    return wrap


def simple(name: str, views: str, f, sql: str) -> None:
    query(name, sql)(over(*views.split())(f))


FAMILY = """WITH RECURSIVE up AS (SELECT id AS ancestor_id, id AS descendant_id, 0 AS distance FROM fx_categories
    UNION ALL SELECT c.parent_id, u.descendant_id, u.distance + 1 FROM up u JOIN fx_categories c ON c.id = u.ancestor_id WHERE c.parent_id IS NOT NULL)"""
SPECS = "(SELECT product_id, name, value, row_number() OVER (PARTITION BY product_id ORDER BY sort_order, name) - 1 AS sort_order FROM fx_attributes WHERE trim(value) <> '')"
MAIN = """(SELECT product_id, canonical_path FROM (SELECT l.product_id, c.canonical_path, row_number() OVER (PARTITION BY l.product_id ORDER BY c.level DESC, c.slug DESC, c.id DESC) AS r
    FROM fx_product_categories l JOIN fx_categories c ON c.id = l.category_id) x WHERE r = 1)"""
ITEM = f"""SELECT p.id, p.sku, p.title, p.brand, coalesce(p.regular_price, p.price) AS price, 'EUR' AS currency, p.stock, p.stock_status, p.url,
    coalesce(upper(substr(split_part(m.canonical_path, '/', -2), 1, 1)) || substr(split_part(m.canonical_path, '/', -2), 2), 'Uncategorized') AS category,
    coalesce(replace(substr(m.canonical_path, 5, length(m.canonical_path) - 5), '/', ','), '') AS category_slugs,
    coalesce((SELECT CAST(to_json(list({{'src': i.src, 'sort_order': i.sort_order}} ORDER BY i.sort_order)) AS varchar) FROM fx_images i WHERE i.product_id = p.id), '[]') AS images,
    coalesce((SELECT CAST(to_json(list({{'name': s.name, 'value': s.value, 'sort_order': s.sort_order}} ORDER BY s.sort_order)) AS varchar) FROM {SPECS} s WHERE s.product_id = p.id), '[]') AS specifications,
    strftime(p.updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at"""


# composed queries


@query(
    "products_page",
    f"""{FAMILY}, hit AS (SELECT p.* FROM fx_products p WHERE p.stock_status = 'in_stock' AND p.id IN (SELECT l.product_id FROM fx_product_categories l JOIN up ON up.descendant_id = l.category_id
        JOIN fx_categories c ON c.id = up.ancestor_id WHERE c.canonical_path = '/en/economy/')), cut AS (SELECT * FROM hit ORDER BY regular_price ASC NULLS LAST, id LIMIT 20)
        {ITEM}, (SELECT count(*) FROM hit) AS total FROM cut p LEFT JOIN {MAIN} m ON m.product_id = p.id""",
)
def products_page(spark, sf_dir):
    return catalogue.products_page(Catalogue.of(spark, sf_dir), category="/en/economy/", include_children=True, stock_status="in_stock", sort_by="price", sort_order="asc")


@query("product_list_item", f"{ITEM} FROM fx_products p LEFT JOIN {MAIN} m ON m.product_id = p.id")
def product_list_item(spark, sf_dir):
    c = Catalogue.of(spark, sf_dir)
    return catalog.list_items(c.products, c.images, c.attributes, c.links, c.categories)


QUERIES["product_detail"], ORACLE_SQL["product_detail"] = QUERIES["product_list_item"], ORACLE_SQL["product_list_item"]


@query("export_products", "SELECT id, sku, title, regular_price FROM fx_products WHERE brand = 'Brand#1' OR brand = (SELECT min(brand) FROM fx_products WHERE brand <> '')")
def export_products(spark, sf_dir):
    c = Catalogue.of(spark, sf_dir)
    least = c.products.where("brand <> ''").agg(F.min("brand").alias("brand"))
    c.products = c.products.join(least, "brand", "left_semi").select(*c.products.columns)
    return catalogue.export_products(c, category="no-such-category", sort_by="title", sort_order="asc").select("id", "sku", "title", "regular_price")


@query(
    "category_products_family",
    f"{FAMILY} SELECT p.id, p.sku, p.title FROM fx_products p WHERE p.id IN (SELECT l.product_id FROM fx_product_categories l JOIN up ON up.descendant_id = l.category_id JOIN fx_categories c ON c.id = up.ancestor_id WHERE c.canonical_path = '/en/promo/')",
)
def category_products_family(spark, sf_dir):
    return catalogue.chosen(Catalogue.of(spark, sf_dir), category="promo", include_children=True).select("id", "sku", "title")


@query(
    "filtered_total",
    "SELECT count(DISTINCT p.id) AS total FROM fx_products p JOIN fx_product_categories l ON l.product_id = p.id JOIN fx_categories c ON c.id = l.category_id WHERE c.level = 2 AND p.stock_status = 'in_stock'",
)
def filtered_total(spark, sf_dir):
    c = Catalogue.of(spark, sf_dir)
    return catalog.filter_products(c.products, links=c.links, categories=c.categories.where("level = 2").select("id"), stock_status="in_stock").agg(F.count("*").alias("total"))


# sources and projections

simple(
    "scan_products_with_children",
    "fx_products fx_images fx_attributes fx_product_categories",
    lambda p, i, a, l: p.select("id", "sku").join(i.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("images")), "id", "left").join(a.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("attributes")), "id", "left").join(l.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("categories")), "id", "left").na.fill(0),
    "SELECT p.id, p.sku, (SELECT count(*) FROM fx_images i WHERE i.product_id = p.id) AS images, (SELECT count(*) FROM fx_attributes i WHERE i.product_id = p.id) AS attributes, (SELECT count(*) FROM fx_product_categories i WHERE i.product_id = p.id) AS categories FROM fx_products p",
)
simple("products_keyset_batch", "fx_products", lambda p: p.where("id > 100").orderBy("id").limit(50).select("id", "sku", "title"), "SELECT id, sku, title FROM fx_products WHERE id > 100 ORDER BY id LIMIT 50")
CATALOGUE = ("products", "categories", "product_categories", "images", "attributes")


def catalogue_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {n: view(spark, sf_dir, f"fx_{n}") for n in CATALOGUE}
    number = {n: F.col("product_id") * 1000 + F.col("sort_order") for n in ("images", "attributes")}
    return {n: df.withColumn("id", number[n]) if n in number else df for n, df in tables.items()}


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(key_of(n)).cast("bigint").alias("keys")) for n, df in tables.items()]
    return reduce(DataFrame.union, parts)


CATALOGUE_SIZES = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, CAST(sum({k}) AS bigint) AS keys FROM fx_{n}" for n, k in zip(CATALOGUE, ("id", "id", "product_id", "product_id * 1000 + sort_order", "product_id * 1000 + sort_order")))


@query("load_catalog", CATALOGUE_SIZES)
def load_catalog(spark, sf_dir):
    """Tables written as a snapshot's Parquet and read back."""
    folder = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    write_snapshot(catalogue_tables(spark, sf_dir), folder)
    return sizes(tables.load_catalog(spark, folder, names=CATALOGUE))


@query("load_catalog_jdbc", CATALOGUE_SIZES)
def load_catalog_jdbc(spark, sf_dir):
    """Tables written to a database and read back in ranges of ids."""
    jdbc = tables.database(spark)
    for name, df in catalogue_tables(spark, sf_dir).items():
        tables.write_jdbc(df, name, jdbc)
    return sizes(tables.load_catalog(spark, jdbc=jdbc, names=CATALOGUE))


simple("product_specifications", "fx_attributes", catalog.specifications, f"SELECT product_id, name, value, sort_order FROM {SPECS} s")
QUERIES["reindex_sort_order"], ORACLE_SQL["reindex_sort_order"] = QUERIES["product_specifications"], ORACLE_SQL["product_specifications"]
simple(
    "image_urls_absolute",
    "fx_images",
    lambda i: i.select("product_id", "sort_order", F.when(F.col("sort_order") % 3 == 0, F.regexp_extract("src", r"(\d+)", 1)).when(F.col("sort_order") % 3 == 1, F.regexp_extract("src", r"example(.*)$", 1)).otherwise(F.col("src")).alias("ref")).select("product_id", "sort_order", catalog.image_url(F.col("ref"), BASE, CDN).alias("url")),
    "SELECT product_id, sort_order, CASE sort_order % 3 WHEN 0 THEN 'https://cdn.example/' || regexp_extract(src, '(\\d+)', 1) || '/500x500x2.jpg' WHEN 1 THEN 'https://shop.example' || regexp_extract(src, 'example(.*)$', 1) ELSE src END AS url FROM fx_images",
)
simple(
    "category_node",
    "fx_db_categories fx_source_categories",
    lambda d, s: d.join(s.select("canonical_path", F.col("source_count").alias("source_product_count")), "canonical_path", "left").select("id", "parent_id", "name", "slug", "canonical_path", "level", "product_count", F.coalesce("source_product_count", F.lit(0)).alias("source_product_count"), "is_active", F.lit("[]").alias("children")),
    "SELECT d.id, d.parent_id, d.name, d.slug, d.canonical_path, d.level, d.product_count, coalesce(s.source_count, 0) AS source_product_count, d.is_active, '[]' AS children FROM fx_db_categories d LEFT JOIN fx_source_categories s ON s.canonical_path = d.canonical_path",
)


@query("export_products_json", f"{ITEM} FROM fx_products p LEFT JOIN {MAIN} m ON m.product_id = p.id WHERE p.stock_status = 'in_stock'")
def export_products_json(spark, sf_dir):
    """A filtered and sorted export, written as files and read back."""
    c = Catalogue.of(spark, sf_dir)
    found = catalogue.export_products(c, sort_by="price", sort_order="asc", stock_status="in_stock")
    items = catalog.list_items(found, c.images, c.attributes, c.links, c.categories).withColumn("regular_price", F.col("price"))
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    exports.write_products_json(items.orderBy(*catalog.order("price", "asc")).drop("regular_price"), folder)
    return spark.read.schema(items.drop("regular_price").schema).json(folder)


def slashed(p: DataFrame) -> DataFrame:
    k = F.floor(F.col("id") / 8).cast("string")
    return p.select("id", F.when(F.col("id") % 8 == 0, F.concat(F.lit("A/"), k)).when(F.col("id") % 8 == 1, F.concat(F.lit("A\\"), k)).when(F.col("id") % 8 == 2, F.concat(F.lit("A_"), k)).otherwise(F.col("sku")).alias("sku"))


SLASHED = "(SELECT id, CASE id % 8 WHEN 0 THEN 'A/' || CAST(id // 8 AS varchar) WHEN 1 THEN 'A\\' || CAST(id // 8 AS varchar) WHEN 2 THEN 'A_' || CAST(id // 8 AS varchar) ELSE sku END AS sku FROM fx_products)"


@query("export_product_files", f"SELECT translate(sku, '/\\', '__') AS file_key, CAST(to_json({{'id': id, 'sku': sku}}) AS varchar) AS document FROM {SLASHED} s")
def export_product_files(spark, sf_dir):
    """One document for each SKU, written below buckets and read back."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    exports.write_product_files(slashed(view(spark, sf_dir, "fx_products")), folder)
    return spark.read.schema("file_key string, document string, bucket int").json(folder).select("file_key", "document")


simple("export_file_collisions", "fx_products", lambda p: exports.file_key_collisions(slashed(p)), f"SELECT translate(sku, '/\\', '__') AS file_key, count(DISTINCT sku) AS skus FROM {SLASHED} s GROUP BY 1 HAVING count(DISTINCT sku) > 1")
simple("file_key", "fx_products", lambda p: slashed(p).select("id", text.file_key(F.col("sku")).alias("file_key")), f"SELECT id, translate(sku, '/\\', '__') AS file_key FROM {SLASHED} s")

# filters

simple("filter_brand", "fx_products", lambda p: catalog.filter_products(p, brand="Brand#11").select("id", "sku"), "SELECT id, sku FROM fx_products WHERE brand = 'Brand#11'")
simple("filter_search", "fx_products", lambda p: catalog.filter_products(p, search="ST_el").select("id", "title"), "SELECT id, title FROM fx_products WHERE title ILIKE '%ST_el%' OR sku ILIKE '%ST_el%' OR brand ILIKE '%ST_el%'")
simple("filter_stock_status", "fx_products", lambda p: catalog.filter_products(p, stock_status="on_backorder").select("id", "stock_status"), "SELECT id, stock_status FROM fx_products WHERE stock_status = 'on_backorder'")
simple(
    "filter_category_membership",
    "fx_products fx_product_categories fx_categories",
    lambda p, l, c: catalog.filter_products(p, links=l, categories=c.where("level = 2").select("id")).select("id", "sku"),
    "SELECT DISTINCT p.id, p.sku FROM fx_products p JOIN fx_product_categories l ON l.product_id = p.id JOIN fx_categories c ON c.id = l.category_id WHERE c.level = 2",
)
simple("lookup_product_by_id", "fx_products", lambda p: p.where("id = 42").select("id", "sku", "title"), "SELECT id, sku, title FROM fx_products WHERE id = 42")
simple("lookup_product_by_sku", "fx_products", lambda p: p.where(F.col("sku") == F.url_decode(F.lit("SKU%2D0000041"))).select("id", "sku", "title"), "SELECT id, sku, title FROM fx_products WHERE sku = 'SKU-0000041'")
simple("children_of_category", "fx_categories", lambda c: c.where("parent_id <=> NULL").orderBy("name").select("id", "name"), "SELECT id, name FROM fx_categories WHERE parent_id IS NULL")
simple("changed_since", "fx_products", lambda p: p.where(F.col("updated_at") >= F.try_to_timestamp(F.lit("2001-7-1"), F.lit("yyyy-M-d")).cast("timestamp_ntz")).orderBy(F.desc("updated_at"), "id").select("id"), "SELECT id FROM fx_products WHERE updated_at >= TIMESTAMP '2001-07-01'")
simple(
    "needs_enrichment",
    "fx_products fx_attributes",
    catalog.needs_enrichment,
    "SELECT p.id, p.sku, p.url, count(a.name) AS attributes FROM fx_products p LEFT JOIN fx_attributes a ON a.product_id = p.id AND trim(a.value) <> '' WHERE p.url IS NOT NULL GROUP BY p.id, p.sku, p.url, p.stock, p.stock_status HAVING p.stock IS NULL OR p.stock_status IS NULL OR count(a.name) <= 2",
)
simple("valid_attributes", "fx_attributes", lambda a: a.where(catalog.valid(F.col("value"))).select("product_id", "name", "value"), "SELECT product_id, name, value FROM fx_attributes WHERE trim(value) <> ''")
simple("select_categories_by_token", "fx_categories", lambda c: taxonomy.matching_tokens(c, ["ring", "/en/promo/"]).select("id", "canonical_path"), "SELECT id, canonical_path FROM fx_categories WHERE contains(canonical_path, 'ring') OR contains(canonical_path, '/en/promo/') OR slug IN ('ring', '/en/promo/')")
simple(
    "select_categories_with_ancestors",
    "fx_categories",
    lambda c: taxonomy.with_ancestors(c, F.col("slug").contains("ring")).select("id", "canonical_path"),
    "SELECT DISTINCT a.id, a.canonical_path FROM fx_categories a JOIN fx_categories d ON starts_with(d.canonical_path, a.canonical_path) WHERE contains(d.slug, 'ring')",
)
simple("filter_slug_substring", "fx_categories", lambda c: c.where(F.contains("slug", F.lit("an"))).select("id", "slug"), "SELECT id, slug FROM fx_categories WHERE contains(slug, 'an')")
simple("lookup_run", "fx_jobs", lambda j: j.where("id = 33").select("id", "job_type", "status"), "SELECT id, job_type, status FROM fx_jobs WHERE id = 33")
simple(
    "lookup_category",
    "fx_categories",
    lambda c: taxonomy.resolve_category(c.select(F.explode(F.array(F.col("id").cast("string"), "canonical_path", "slug", F.concat(F.lit("no "), "slug"))).alias("key")).distinct(), c),
    """SELECT k.key, coalesce(a.id, b.id, s.id) AS category_id, CASE WHEN a.id IS NOT NULL THEN 'id' WHEN b.id IS NOT NULL THEN 'path' WHEN s.id IS NOT NULL THEN 'slug' END AS matched_by
        FROM (SELECT CAST(id AS varchar) AS key FROM fx_categories UNION SELECT canonical_path FROM fx_categories UNION SELECT slug FROM fx_categories UNION SELECT 'no ' || slug FROM fx_categories) k
        LEFT JOIN fx_categories a ON CAST(a.id AS varchar) = k.key LEFT JOIN fx_categories b ON b.canonical_path = k.key LEFT JOIN (SELECT slug, min(id) AS id FROM fx_categories GROUP BY slug) s ON s.slug = k.key""",
)
QUERIES["resolve_category"], ORACLE_SQL["resolve_category"] = QUERIES["lookup_category"], ORACLE_SQL["lookup_category"]

# sorts and limits

simple("sort_products", "fx_products", lambda p: p.orderBy(*catalog.order("price", "desc")).limit(100).select("id", "regular_price"), "SELECT id, regular_price FROM fx_products ORDER BY regular_price DESC NULLS FIRST, id LIMIT 100")
simple("page_products", "fx_products", lambda p: catalog.page(p, 3, 20, "stock", "asc").select("id", "stock"), "SELECT id, stock FROM fx_products ORDER BY stock ASC NULLS LAST, id LIMIT 20 OFFSET 40")
simple("categories_ordered", "fx_categories", lambda c: c.orderBy("level", "name", "id").select("id", "level", "name"), "SELECT id, level, name FROM fx_categories")
simple("latest_run", "fx_jobs", lambda j: j.orderBy(F.desc("id")).limit(1).select("id", "status"), "SELECT id, status FROM fx_jobs ORDER BY id DESC LIMIT 1")
simple("last_completed_run", "fx_jobs", lambda j: j.where("status = 'completed'").orderBy(F.desc("finished_at"), F.desc("id")).limit(1).select("id", "finished_at"), "SELECT id, finished_at FROM fx_jobs WHERE status = 'completed' ORDER BY finished_at DESC, id DESC LIMIT 1")
query("latest_samples", "SELECT event_id, user_id, value FROM events ORDER BY event_id DESC LIMIT 25")(lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").orderBy(F.desc("event_id")).limit(25).select("event_id", "user_id", "value"))
simple("run_progress_rows", "fx_progress", lambda p: p.where("job_id = 2").orderBy("id").select("id", "canonical_path", "status"), "SELECT id, canonical_path, status FROM fx_progress WHERE job_id = 2")
simple(
    "failure_samples",
    "fx_progress",
    lambda p: p.where("status = 'failed'").withColumn("r", F.expr("row_number() OVER (PARTITION BY canonical_path ORDER BY id)")).where("r <= 5").groupBy("canonical_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "last_error"))), lambda s: F.concat(s["id"].cast("string"), F.lit(": "), s["last_error"])), "; ").alias("failures")),
    "SELECT canonical_path, string_agg(CAST(id AS varchar) || ': ' || last_error, '; ' ORDER BY id) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY canonical_path ORDER BY id) AS r FROM fx_progress WHERE status = 'failed') x WHERE r <= 5 GROUP BY canonical_path",
)

# joins

joined = lambda c, f: F.array_join(F.transform(c, f), "|")
simple(
    "product_images_nested",
    "fx_products fx_images",
    lambda p, i: p.select("id").join(catalog.nested(i, "product_id", ["src", "sort_order"], ["sort_order", "src"], "x"), "id", "left").select("id", F.coalesce(joined(F.col("x"), lambda s: s["src"]), F.lit("")).alias("images")),
    "SELECT p.id, coalesce(string_agg(i.src, '|' ORDER BY i.sort_order), '') AS images FROM fx_products p LEFT JOIN fx_images i ON i.product_id = p.id GROUP BY p.id",
)
simple(
    "product_attributes_nested",
    "fx_products fx_attributes",
    lambda p, a: p.select("id").join(catalog.nested(a, "product_id", ["name", "value"], ["sort_order", "name"], "x"), "id", "left").select("id", F.coalesce(joined(F.col("x"), lambda s: F.concat(s["name"], F.lit("="), s["value"])), F.lit("")).alias("attributes")),
    "SELECT p.id, coalesce(string_agg(a.name || '=' || a.value, '|' ORDER BY a.sort_order), '') AS attributes FROM fx_products p LEFT JOIN fx_attributes a ON a.product_id = p.id GROUP BY p.id",
)
simple(
    "product_categories_nested",
    "fx_products fx_product_categories fx_categories",
    lambda p, l, c: p.select("id").join(catalog.nested(l.join(c.select(F.col("id").alias("category_id"), "canonical_path"), "category_id"), "product_id", ["canonical_path"], ["canonical_path"], "x"), "id", "left").select("id", F.coalesce(joined(F.col("x"), lambda s: s["canonical_path"]), F.lit("")).alias("categories")),
    "SELECT p.id, coalesce(string_agg(c.canonical_path, '|' ORDER BY c.canonical_path), '') AS categories FROM fx_products p LEFT JOIN fx_product_categories l ON l.product_id = p.id LEFT JOIN fx_categories c ON c.id = l.category_id GROUP BY p.id",
)
simple("resolve_parent_ids", "fx_categories", lambda c: taxonomy.resolve_parents(c.where("id % 7 <> 0")), "SELECT c.id, p.id AS parent_id FROM fx_categories c LEFT JOIN fx_categories p ON p.canonical_path = c.parent_path AND p.id % 7 <> 0 WHERE c.id % 7 <> 0")
simple(
    "resolve_membership_paths",
    "fx_product_paths fx_categories",
    lambda f, c: f.select("id", F.explode(F.array("p1", "p3", F.lit("/en/none/"))).alias("canonical_path")).join(c.select(F.col("id").alias("category_id"), "canonical_path"), "canonical_path").select(F.col("id").alias("product_id"), "category_id"),
    "SELECT f.id AS product_id, c.id AS category_id FROM fx_product_paths f JOIN fx_categories c ON c.canonical_path IN (f.p1, f.p3, '/en/none/')",
)
simple("category_closure", "fx_categories", taxonomy.closure, f"{FAMILY} SELECT ancestor_id, descendant_id, CAST(distance AS bigint) AS distance FROM up")
simple("path_descendants", "fx_categories", taxonomy.path_pairs, "SELECT a.canonical_path AS ancestor_path, d.canonical_path AS descendant_path FROM fx_categories a JOIN fx_categories d ON starts_with(d.canonical_path, a.canonical_path) AND a.canonical_path <> d.canonical_path")
simple(
    "category_tree",
    "fx_db_categories",
    lambda c: taxonomy.tree_rows(c).select("id", "root_id", "depth", F.array_join("path", ">").alias("path")),
    """WITH RECURSIVE t AS (SELECT id, id AS root_id, 1 AS depth, CAST(id AS varchar) AS path FROM fx_db_categories WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM fx_db_categories)
        UNION ALL SELECT c.id, t.root_id, t.depth + 1, t.path || '>' || CAST(c.id AS varchar) FROM t JOIN fx_db_categories c ON c.parent_id = t.id) SELECT id, root_id, CAST(depth AS bigint) AS depth, path FROM t""",
)
query("export_categories_tree")(over("fx_db_categories")(lambda c: taxonomy.nested_tree(c.withColumn("name", F.col("slug")))))
simple(
    "resolve_legacy_refs",
    "fx_legacy_refs fx_categories",
    taxonomy.resolve_legacy_refs,
    """SELECT r.product_id, r.ref, coalesce(a.id, b.id, CASE WHEN s.n = 1 THEN s.id END) AS category_id, CASE WHEN coalesce(a.id, b.id, CASE WHEN s.n = 1 THEN s.id END) IS NOT NULL THEN 'linked' WHEN s.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state
        FROM (SELECT product_id, trim(unnest(string_split(refs, ','))) AS ref FROM fx_legacy_refs) r LEFT JOIN fx_categories a ON CAST(a.id AS varchar) = r.ref LEFT JOIN fx_categories b ON lower(b.canonical_path) = lower(r.ref)
        LEFT JOIN (SELECT slug, min(id) AS id, count(*) AS n FROM fx_categories GROUP BY slug) s ON s.slug = lower(r.ref) WHERE r.ref <> ''""",
)
simple(
    "backfill_report",
    "fx_legacy_refs fx_categories",
    lambda r, c: taxonomy.resolve_legacy_refs(r, c).groupBy("state").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("state") != "linked", F.col("ref")))), ",").alias("refs")),
    """WITH x AS (SELECT r.ref, CASE WHEN coalesce(a.id, b.id, CASE WHEN s.n = 1 THEN s.id END) IS NOT NULL THEN 'linked' WHEN s.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state
        FROM (SELECT product_id, trim(unnest(string_split(refs, ','))) AS ref FROM fx_legacy_refs) r LEFT JOIN fx_categories a ON CAST(a.id AS varchar) = r.ref LEFT JOIN fx_categories b ON lower(b.canonical_path) = lower(r.ref)
        LEFT JOIN (SELECT slug, min(id) AS id, count(*) AS n FROM fx_categories GROUP BY slug) s ON s.slug = lower(r.ref) WHERE r.ref <> '')
        SELECT state, count(*) AS n, coalesce(string_agg(DISTINCT CASE WHEN state <> 'linked' THEN ref END, ',' ORDER BY CASE WHEN state <> 'linked' THEN ref END), '') AS refs FROM x GROUP BY state""",
)

# aggregations

simple(
    "catalog_stats",
    "fx_products fx_categories fx_jobs",
    catalog.stats,
    "SELECT (SELECT count(*) FROM fx_products) AS products, (SELECT count(DISTINCT nullif(brand, '')) FROM fx_products) AS brands, (SELECT count(*) FROM fx_categories) AS categories, (SELECT max(finished_at) FROM fx_jobs WHERE status = 'completed') AS last_run",
)
simple("brand_counts", "fx_products", lambda p: p.where("brand <> ''").groupBy("brand").agg(F.count("*").alias("product_count")).orderBy("brand"), "SELECT brand, count(*) AS product_count FROM fx_products WHERE brand <> '' GROUP BY brand")
QUERIES["export_brands"], ORACLE_SQL["export_brands"] = QUERIES["brand_counts"], ORACLE_SQL["brand_counts"]
simple(
    "direct_category_counts",
    "fx_product_categories fx_categories",
    lambda l, c: l.groupBy("category_id").agg(F.count("*").alias("n")).join(c.select(F.col("id").alias("category_id"), "canonical_path"), "category_id").select("canonical_path", "n"),
    "SELECT c.canonical_path, count(*) AS n FROM fx_product_categories l JOIN fx_categories c ON c.id = l.category_id GROUP BY c.canonical_path",
)
QUERIES["direct_counts_by_path"], ORACLE_SQL["direct_counts_by_path"] = QUERIES["direct_category_counts"], ORACLE_SQL["direct_category_counts"]
FAMILY_COUNTS = f"{FAMILY} SELECT up.ancestor_id AS category_id, count(DISTINCT l.product_id) AS product_count FROM up LEFT JOIN fx_product_categories l ON l.category_id = up.descendant_id GROUP BY up.ancestor_id"
simple("family_category_counts", "fx_categories fx_product_categories", taxonomy.family_counts, FAMILY_COUNTS)
simple("direct_recount", "fx_categories fx_product_categories", taxonomy.direct_counts, "SELECT c.id AS category_id, count(DISTINCT l.product_id) AS product_count FROM fx_categories c LEFT JOIN fx_product_categories l ON l.category_id = c.id GROUP BY c.id")
simple(
    "coverage_snapshot",
    "fx_products fx_product_categories fx_categories fx_jobs",
    catalog.coverage,
    "SELECT (SELECT count(*) FROM fx_products) AS products, (SELECT count(*) FROM fx_products WHERE brand IS NULL) AS fallback_only, (SELECT count(*) FROM fx_product_categories) AS appearances, (SELECT count(DISTINCT product_id) FROM fx_product_categories) AS linked, (SELECT count(*) FROM fx_categories) AS categories, (SELECT arg_max(status, id) FROM fx_jobs) AS last_status",
)
simple(
    "level_histogram",
    "fx_categories",
    lambda c: c.groupBy("level").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active")),
    "SELECT level, count(*) AS n, count(*) FILTER (WHERE is_active) AS active FROM fx_categories GROUP BY level",
)
simple(
    "primary_category",
    "fx_product_categories fx_categories",
    catalog.primary_category,
    f"SELECT m.product_id, upper(substr(split_part(m.canonical_path, '/', -2), 1, 1)) || substr(split_part(m.canonical_path, '/', -2), 2) AS category, array_to_string(list_transform(list_filter(string_split(substr(m.canonical_path, 5), '/'), lambda s: s <> ''), lambda s: upper(substr(s, 1, 1)) || substr(s, 2)), ' > ') AS names, replace(substr(m.canonical_path, 5, length(m.canonical_path) - 5), '/', ',') AS slugs FROM {MAIN} m",
)

# audit

from .operators import ledger, merge, quality  # noqa: E402

LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_path ORDER BY id DESC) AS r FROM fx_progress) x WHERE r = 1)"
EXPECTED = "(SELECT d.canonical_path, d.parent_id, s.parent_path, p.id AS expected_id FROM fx_db_categories d JOIN fx_source_categories s ON s.canonical_path = d.canonical_path LEFT JOIN fx_db_categories p ON p.canonical_path = s.parent_path)"
BELOW = f"(SELECT a.canonical_path, sum(coalesce(nullif(d.product_count, 0), p.total_products, 0)) AS children_sum FROM fx_db_categories a JOIN fx_db_categories d ON starts_with(d.canonical_path, a.canonical_path) AND d.canonical_path <> a.canonical_path LEFT JOIN {LATEST} p ON p.canonical_path = d.canonical_path GROUP BY a.canonical_path)"
COUNTS = f"(SELECT d.canonical_path, d.product_count AS family, s.source_count AS sitemap, p.total_products AS catalog, b.children_sum FROM fx_db_categories d JOIN fx_source_categories s ON s.canonical_path = d.canonical_path LEFT JOIN {LATEST} p ON p.canonical_path = d.canonical_path LEFT JOIN {BELOW} b ON b.canonical_path = d.canonical_path)"
ORPHANS = f"SELECT canonical_path, 'parent_id ' || CAST(parent_id AS varchar) || ' does not exist' AS reason FROM fx_db_categories WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM fx_db_categories) UNION ALL SELECT canonical_path, 'source parent ' || parent_path || ' is missing from DB' FROM {EXPECTED} e WHERE parent_path IS NOT NULL AND expected_id IS NULL"
MISMATCH = f"SELECT canonical_path, parent_path, expected_id, parent_id AS actual_id FROM {EXPECTED} e WHERE (parent_path IS NULL OR expected_id IS NOT NULL) AND parent_id IS DISTINCT FROM expected_id"
LEVELS = "SELECT s.canonical_path, s.level AS source_level, d.level AS stored_level FROM fx_source_categories s JOIN fx_db_categories d ON d.canonical_path = s.canonical_path WHERE s.level <> d.level"
MISSING = "SELECT canonical_path FROM {a} WHERE canonical_path NOT IN (SELECT canonical_path FROM {b})"
DIFFERENCES = f"""SELECT x.canonical_path, x.basis, x.sitemap, CASE WHEN x.basis = 'catalog' THEN x.catalog END AS catalog, x.family, x.expected - x.family AS difference, coalesce(n.n, 0) AS direct
    FROM (SELECT *, CASE WHEN catalog > 0 THEN 'catalog' WHEN sitemap > 0 THEN 'sitemap' END AS basis, CASE WHEN catalog > 0 THEN catalog ELSE sitemap END AS expected FROM {COUNTS} c WHERE NOT (coalesce(catalog, -1) = 0 AND children_sum IS NOT NULL)) x
    LEFT JOIN fx_numbered_paths i ON i.canonical_path = x.canonical_path LEFT JOIN (SELECT category_id, count(*) AS n FROM fx_product_categories GROUP BY category_id) n ON n.category_id = i.id WHERE x.basis IS NOT NULL AND x.expected <> x.family"""
UNSCRAPABLE = f"SELECT canonical_path, status FROM {LATEST} p WHERE status IN ('failed', 'retrying') OR (status = 'completed' AND total_products > 0 AND products_scraped < total_products)"
SLUGS = "SELECT slug AS value, string_agg(canonical_path, ',' ORDER BY canonical_path) AS paths FROM {t} GROUP BY slug HAVING count(*) > 1"
SOURCE, DB = "fx_source_categories", "fx_db_categories"
EMPTY = f"SELECT canonical_path, sitemap AS placeholder, CAST(children_sum AS bigint) AS children_sum FROM {COUNTS} c WHERE catalog = 0 AND children_sum IS NOT NULL"


def direct(links: DataFrame, categories: DataFrame) -> DataFrame:
    counts = links.groupBy("category_id").agg(F.count("*").alias("direct"))
    return counts.join(categories.select(F.col("id").alias("category_id"), "canonical_path"), "category_id").select("canonical_path", "direct")


def findings(source, db, progress, links, categories):
    return quality.audit(source, source.where("level < 3"), db, progress, direct(links, categories))


AUDIT = "fx_source_categories fx_db_categories fx_progress fx_product_categories fx_categories"
FINDINGS = {
    "missing_from_scraper": f"SELECT canonical_path FROM {SOURCE} WHERE level >= 3",
    "missing_from_db": MISSING.format(a=SOURCE, b=DB),
    "db_only": MISSING.format(a=DB, b=SOURCE),
    "duplicate_paths": f"SELECT canonical_path FROM {DB} GROUP BY canonical_path HAVING count(*) > 1",
    "duplicate_slugs": SLUGS.format(t=SOURCE),
    "duplicate_names": SLUGS.format(t=SOURCE).replace("slug", "name"),
    "orphans": ORPHANS,
    "parent_mismatches": MISMATCH,
    "level_mismatches": LEVELS,
    "empty_listing_parents": EMPTY,
    "count_differences": DIFFERENCES,
    "unscrapable": UNSCRAPABLE,
}
AUDIT_SIZES = {"source_categories": f"SELECT * FROM {SOURCE}", "scraper_categories": f"SELECT * FROM {SOURCE} WHERE level < 3", "db_categories": f"SELECT * FROM {DB}"}
SUMMARY = " UNION ALL ".join(f"SELECT '{n}' AS section, count(*) AS n FROM ({s}) x" for n, s in (FINDINGS | AUDIT_SIZES).items())


def report_sql(found: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS section, {'value' if n.startswith('duplicate_') and n != 'duplicate_paths' else 'canonical_path'} AS key FROM ({s}) x" for n, s in found.items())


REPORT = report_sql(FINDINGS)
LOST_PARENTS = ORPHANS[: ORPHANS.index(" UNION ALL ")]
PATH_SLUGS = "SELECT string_split(trim(canonical_path, '/'), '/')[-1] AS value FROM fx_source_categories GROUP BY 1 HAVING count(*) > 1"

simple(
    "source_db_compare",
    f"{SOURCE} {DB}",
    lambda s, d: quality.compare(s, d).select("canonical_path", "in_source", "in_stored", "s_source_count", "d_product_count"),
    f"SELECT coalesce(s.canonical_path, d.canonical_path) AS canonical_path, s.canonical_path IS NOT NULL AS in_source, d.canonical_path IS NOT NULL AS in_stored, s.source_count AS s_source_count, d.product_count AS d_product_count FROM {SOURCE} s FULL JOIN {DB} d ON d.canonical_path = s.canonical_path",
)
simple("expected_parent", f"{SOURCE} {DB}", lambda s, d: quality.expected_parents(s, d).select("canonical_path", "parent_id", "parent_path", "expected_id"), f"SELECT canonical_path, parent_id, parent_path, expected_id FROM {EXPECTED} e")
simple("orphans", f"{SOURCE} {DB}", quality.orphans, ORPHANS)
simple("audit_missing", f"{SOURCE} {DB}", lambda s, d: quality.missing(s, d).withColumn("side", F.lit("db")).union(quality.missing(d, s).withColumn("side", F.lit("source"))), f"SELECT *, 'db' AS side FROM ({MISSING.format(a=SOURCE, b=DB)}) a UNION ALL SELECT *, 'source' FROM ({MISSING.format(a=DB, b=SOURCE)}) b")
simple("audit_parent_mismatch", f"{SOURCE} {DB}", quality.parent_mismatch, MISMATCH)
simple("audit_level_mismatch", f"{SOURCE} {DB}", quality.level_mismatch, LEVELS)
simple("duplicate_values", SOURCE, lambda s: quality.duplicate_values(s, "slug"), SLUGS.format(t=SOURCE))
simple("duplicate_paths", DB, lambda d: quality.duplicate_paths(d.select("canonical_path").union(d.where("id % 50 = 0").select("canonical_path"))), f"SELECT canonical_path, CAST(2 AS bigint) AS n FROM {DB} WHERE id % 50 = 0")
simple("children_product_sum", f"{DB} fx_progress", quality.below_sums, f"SELECT canonical_path, CAST(children_sum AS bigint) AS children_sum FROM {BELOW} b")
simple("audit_empty_listing_parents", f"{SOURCE} {DB} fx_progress", lambda s, d, p: quality.empty_listing_parents(quality.counts(s, d, p)), EMPTY)
simple("audit_count_differences", AUDIT, lambda s, d, p, l, c: quality.count_differences(quality.counts(staged(s), staged(d), p), direct(l, c)), DIFFERENCES)
simple("audit_unscrapable", "fx_progress", lambda p: ledger.unscrapable(p).select("canonical_path", "status"), UNSCRAPABLE)
simple("audit_summary", AUDIT, lambda *t: quality.summary(findings(*t)), SUMMARY)
simple("audit_report", AUDIT, lambda *t: quality.audit_long(findings(*t)).select("section", "key"), REPORT)
simple(
    "audit_from_paths",
    f"{SOURCE} {DB}",
    lambda s, d: quality.audit_long(quality.audit_from_paths(s.select("canonical_path"), d)).select("section", "key"),
    report_sql({
        "missing_from_db": FINDINGS["missing_from_db"], "db_only": FINDINGS["db_only"], "duplicate_slugs": PATH_SLUGS, "orphans": LOST_PARENTS,
        "parent_mismatches": f"SELECT d.canonical_path FROM {DB} d JOIN {SOURCE} s ON s.canonical_path = d.canonical_path WHERE d.parent_id IS NOT NULL",
    }),
)
simple(
    "coverage_audit",
    f"{DB} fx_progress fx_product_categories fx_categories",
    lambda d, p, l, c: quality.audit_long(quality.audit(None, None, d, p, direct(l, c))).select("section", "key"),
    report_sql({"db_only": f"SELECT canonical_path FROM {DB}", "duplicate_slugs": SLUGS.format(t=DB), "duplicate_names": SLUGS.format(t=DB).replace("slug", "name"), "orphans": LOST_PARENTS, "unscrapable": UNSCRAPABLE}),
)
simple(
    "count_discrepancies",
    f"{SOURCE} {DB}",
    lambda s, d: s.where("source_count <> 0").select("canonical_path", "source_count").join(d.select("canonical_path", "product_count"), "canonical_path").where("source_count <> product_count"),
    f"SELECT s.canonical_path, s.source_count, d.product_count FROM {SOURCE} s JOIN {DB} d ON d.canonical_path = s.canonical_path WHERE s.source_count <> 0 AND s.source_count <> d.product_count",
)

# runs and progress

simple("latest_progress", "fx_progress", lambda p: ledger.latest_progress(p).select("canonical_path", "id", "status", "total_products"), f"SELECT canonical_path, id, status, total_products FROM {LATEST} p")
simple("progress_status_counts", "fx_progress", quality.status_counts, f"SELECT lower(status) AS status, count(*) AS n FROM {LATEST} p GROUP BY 1")
simple("incomplete_progress", "fx_categories fx_progress", lambda c, p: ledger.incomplete(c, p.where("job_id = 1")).select("canonical_path"), "SELECT canonical_path FROM fx_categories WHERE canonical_path NOT IN (SELECT canonical_path FROM fx_progress WHERE status = 'completed' AND job_id = 1)")
simple(
    "resume_plan",
    "fx_categories fx_progress",
    lambda c, p: ledger.resume_plan(c, p.where("job_id = 1")),
    "SELECT c.canonical_path, count(p.id) = 0 AS pending, count(p.id) AS checkpoints FROM fx_categories c LEFT JOIN fx_progress p ON p.canonical_path = c.canonical_path AND p.status = 'completed' AND p.job_id = 1 GROUP BY c.canonical_path",
)
simple(
    "upsert_progress",
    "fx_progress fx_categories",
    lambda p, c: ledger.upsert_progress(ledger.latest_progress(p).select("canonical_path", "status", "attempt_count"), c.where("id % 3 <> 0").select("canonical_path")),
    f"SELECT coalesce(p.canonical_path, c.canonical_path) AS canonical_path, CASE WHEN c.canonical_path IS NOT NULL AND coalesce(p.status, '') <> 'completed' THEN 'discovered' ELSE p.status END AS status, coalesce(p.attempt_count, 0) AS attempt_count FROM {LATEST} p FULL JOIN (SELECT canonical_path FROM fx_categories WHERE id % 3 <> 0) c ON c.canonical_path = p.canonical_path",
)
simple(
    "category_scrape_state",
    f"{SOURCE} fx_progress",
    ledger.category_state,
    f"SELECT s.canonical_path, coalesce(p.status, 'discovered') AS scrape_status, coalesce(p.attempt_count, 0) AS attempt_count, p.last_error, coalesce(CASE WHEN p.total_products > 0 THEN p.total_products END, s.source_count) AS source_count FROM {SOURCE} s LEFT JOIN {LATEST} p ON p.canonical_path = s.canonical_path",
)
COUNTERS = "SELECT job_id, count(*) FILTER (WHERE status = 'completed') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS skipped, CAST(sum(total_products) AS bigint) AS listed, CAST(sum(products_scraped) AS bigint) AS scraped FROM (SELECT *, row_number() OVER (PARTITION BY job_id, canonical_path ORDER BY id DESC) AS r FROM fx_progress) x WHERE r = 1 GROUP BY job_id"
simple("run_counters", "fx_progress", ledger.run_counters, COUNTERS)
simple("finalize_runs", "fx_progress", ledger.finalize_runs, f"SELECT *, CASE WHEN failed + skipped + CAST(listed > scraped AS int) = 0 THEN 'SUCCESS' WHEN succeeded = 0 AND (failed > 0 OR skipped > 0) THEN 'FAILED' ELSE 'PARTIAL_SUCCESS' END AS job_status FROM ({COUNTERS}) c")
RUN = ("categories_failed", "categories_succeeded", "categories_skipped", "products_failed", "discrepancies")
simple(
    "run_status",
    "fx_jobs",
    lambda j: j.select("id", ledger.run_status(*(F.col(c) for c in RUN)).alias("job_status")),
    "SELECT id, CASE WHEN categories_failed + categories_skipped + products_failed + discrepancies = 0 THEN 'SUCCESS' WHEN categories_succeeded = 0 AND (categories_failed > 0 OR categories_skipped > 0) THEN 'FAILED' ELSE 'PARTIAL_SUCCESS' END AS job_status FROM fx_jobs",
)
simple("run_summary_json", "fx_jobs", lambda j: j.select("id", F.to_json(F.struct(*RUN)).alias("summary")), f"SELECT id, CAST(to_json({{{', '.join(f'{c!r}: {c}' for c in RUN)}}}) AS varchar) AS summary FROM fx_jobs")
from datetime import datetime  # noqa: E402

simple("stale_runs", "fx_jobs", lambda j: ledger.stale_runs(j, datetime(1997, 1, 1), 900).select("id"), "SELECT id FROM fx_jobs WHERE status = 'running' AND (coalesce(heartbeat_at, started_at) IS NULL OR coalesce(heartbeat_at, started_at) < TIMESTAMP '1997-01-01' - INTERVAL 900 SECOND)")
simple(
    "resumable_run",
    "fx_jobs",
    lambda j: ledger.resumable_runs(j.where("status <> 'running'")),
    "SELECT job_type, CASE WHEN max(CASE WHEN status = 'interrupted' THEN id END) IS NOT NULL THEN 'resumed' ELSE 'created' END AS action, max(CASE WHEN status = 'interrupted' THEN id END) AS run_id FROM fx_jobs WHERE status <> 'running' GROUP BY job_type",
)
query("run_health_windows", "SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS start, user_id, count(*) AS samples FROM events GROUP BY 1, 2")(lambda spark, sf: ledger.health_windows(spark.read.parquet(f"{sf}/events.parquet")))

# merges

LAST = "arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL)"
FOLD = f"(SELECT sku, arg_max(title, seq) FILTER (WHERE title <> '') AS title, {LAST.format(c='price')} AS price, {LAST.format(c='stock')} AS stock, arg_max(coalesce(regular_price, price), seq) FILTER (WHERE coalesce(regular_price, price) IS NOT NULL) AS regular_price FROM fx_incoming_products GROUP BY sku)"
simple(
    "upsert_products",
    "fx_products fx_incoming_products",
    lambda p, i: merge.upsert_products(p.select("sku", "title", "brand", "price", "stock", "regular_price"), merge.fold_incoming(i, "seq")),
    f"SELECT coalesce(p.sku, i.sku) AS sku, coalesce(i.title, p.title) AS title, p.brand, coalesce(i.price, p.price) AS price, coalesce(i.stock, p.stock) AS stock, coalesce(i.regular_price, p.regular_price) AS regular_price, p.sku IS NULL AS is_new, i.sku IS NOT NULL AS touched FROM fx_products p FULL JOIN {FOLD} i ON i.sku = p.sku",
)
simple(
    "replace_product_children",
    "fx_attributes",
    lambda a: merge.replace_children(a, a.where("product_id % 5 = 0 and trim(value) <> ''").withColumn("value", F.upper("value"))),
    "SELECT * FROM fx_attributes WHERE product_id % 5 <> 0 UNION ALL SELECT product_id, name, upper(value), sort_order FROM fx_attributes WHERE product_id % 5 = 0 AND trim(value) <> ''",
)
LINKS = "SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.category_id, b.category_id) AS category_id, CASE WHEN a.product_id IS NULL THEN 'created' WHEN b.product_id IS NOT NULL THEN 'existing' ELSE 'untouched' END AS state FROM fx_product_categories a FULL JOIN (SELECT f.id AS product_id, c.id AS category_id FROM fx_product_paths f JOIN fx_categories c ON c.canonical_path = f.p2 WHERE f.id % 2 = 0) b ON b.product_id = a.product_id AND b.category_id = a.category_id"


def proposed(f: DataFrame, c: DataFrame) -> DataFrame:
    return f.where("id % 2 = 0").select(F.col("id").alias("product_id"), F.col("p2").alias("canonical_path")).join(c.select(F.col("id").alias("category_id"), "canonical_path"), "canonical_path").select("product_id", "category_id")


simple("link_products", "fx_product_categories fx_product_paths fx_categories", lambda l, f, c: merge.link_products(l, proposed(f, c)), LINKS)
QUERIES["listing_driven_links"], ORACLE_SQL["listing_driven_links"] = QUERIES["link_products"], ORACLE_SQL["link_products"]
simple("membership_diff_counts", "fx_product_categories fx_product_paths fx_categories", lambda l, f, c: merge.link_products(l, proposed(f, c)).groupBy("category_id", "state").agg(F.count("*").alias("n")), f"SELECT category_id, state, count(*) AS n FROM ({LINKS}) x GROUP BY category_id, state")
simple(
    "remove_stale_links",
    "fx_product_categories fx_categories",
    lambda l, c: merge.remove_stale(l, l.where("product_id % 3 <> 0"), c.where("id % 2 = 0").select(F.col("id").alias("category_id"))),
    "SELECT product_id, category_id, category_id % 2 = 0 AND product_id % 3 = 0 AS removed FROM fx_product_categories",
)
simple(
    "upsert_categories",
    f"fx_categories {SOURCE}",
    lambda c, s: merge.upsert_categories(c.where("id % 9 <> 0"), s),
    f"SELECT coalesce(c.canonical_path, s.canonical_path) AS canonical_path, coalesce(s.name, c.name) AS name, coalesce(s.slug, c.slug) AS slug, CASE WHEN s.canonical_path IS NOT NULL THEN s.level ELSE c.level END AS level, CASE WHEN s.canonical_path IS NOT NULL THEN s.parent_path ELSE c.parent_path END AS parent_path, s.canonical_path IS NOT NULL OR coalesce(c.is_active, false) AS is_active, CASE WHEN s.canonical_path IS NOT NULL THEN 0 ELSE c.missing_streak END AS missing_streak, c.canonical_path IS NULL AS is_new FROM (SELECT * FROM fx_categories WHERE id % 9 <> 0) c FULL JOIN {SOURCE} s ON s.canonical_path = c.canonical_path",
)
simple(
    "deactivate_absent",
    f"fx_categories {SOURCE}",
    lambda c, s: merge.deactivate_absent(c, s),
    f"SELECT c.canonical_path, CASE WHEN s.canonical_path IS NOT NULL THEN 0 ELSE c.missing_streak + 1 END AS missing_streak, c.is_active AND (s.canonical_path IS NOT NULL OR c.missing_streak + 1 < 2) AS is_active FROM fx_categories c LEFT JOIN {SOURCE} s ON s.canonical_path = c.canonical_path",
)
simple(
    "write_family_counts",
    "fx_db_categories fx_categories fx_product_categories",
    lambda d, c, l: merge.changed_counts(d, taxonomy.family_counts(c, l)),
    f"{FAMILY}, n AS (SELECT up.ancestor_id AS id, count(DISTINCT l.product_id) AS product_count FROM up LEFT JOIN fx_product_categories l ON l.category_id = up.descendant_id GROUP BY up.ancestor_id) SELECT d.id, coalesce(n.product_count, 0) AS product_count, d.product_count IS DISTINCT FROM coalesce(n.product_count, 0) AS changed FROM fx_db_categories d LEFT JOIN n ON n.id = d.id",
)
simple("dedupe_detail_work", "fx_incoming_products", lambda i: i.groupBy("sku").agg(F.min("seq").alias("seq")), "SELECT sku, min(seq) AS seq FROM fx_incoming_products GROUP BY sku")
simple(
    "backfill_canonical_paths",
    "fx_categories",
    lambda c: merge.conflict_paths(c, paths.normalize_path(F.when(F.col("id") % 13 == 0, F.lit("")).when(F.col("id") % 7 == 0, F.concat(F.lit("https://shop.example/EN/"), "slug", F.lit("/;s1?x"))).otherwise(F.col("canonical_path")))),
    """WITH x AS (SELECT id, is_active, CASE WHEN id % 13 = 0 THEN '' WHEN id % 7 = 0 THEN '/en/' || slug || '/' ELSE canonical_path END AS p FROM fx_categories), y AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY id) AS r FROM x)
        SELECT id, CASE WHEN p = '' THEN '/en/legacy-' || CAST(id AS varchar) || '/' WHEN r > 1 THEN '/en/__conflict-' || CAST(id AS varchar) || '/' ELSE p END AS canonical_path, is_active AND (r = 1 OR p = '') AS is_active FROM y""",
)

# supplier JSON; the oracle reads the relational columns that the documents were made from

from .fixtures import listing_pages, raw_products  # noqa: E402
from .operators import extract, listing  # noqa: E402


def raw(name: str, f, sql: str) -> None:
    """A query over landed product documents."""
    query(name, sql)(lambda spark, sf_dir: f(staged(spread(raw_products(spark, sf_dir)))))


SKU = "CASE WHEN id % 5 = 0 THEN CAST(id AS varchar) ELSE sku END"
STOCK = "CASE WHEN id % 4 = 0 THEN stock WHEN id % 4 = 2 THEN coalesce(stock, 0) + 1 END"
STATUS = f"CASE WHEN id % 4 = 1 THEN stock_status WHEN id % 4 = 3 OR ({STOCK}) IS NULL THEN NULL WHEN ({STOCK}) > 0 THEN 'in_stock' ELSE 'out_of_stock' END"
URL = "CASE WHEN id % 2 = 0 THEN 'https://shop.example/en/p/' || CAST(id AS varchar) || '.html' ELSE url END"
raw("scan_product_json", lambda r: r.select("id", F.get_json_object(extract.unwrap(F.col("body")), "$.id").cast("bigint").alias("inner_id")), "SELECT id, id AS inner_id FROM fx_products")
raw("product_identity", lambda r: extract.parsed(r).select("id", extract.product_id().alias("product_id"), extract.sku().alias("sku")), f"SELECT id, CAST(id AS varchar) AS product_id, {SKU} AS sku FROM fx_products")
raw("product_price", lambda r: extract.parsed(r).select("id", extract.price_text().try_cast("double").alias("price")), "SELECT id, price FROM fx_products")
raw("product_stock", lambda r: extract.parsed(r).select("id", extract.stock().alias("stock")), f"SELECT id, {STOCK} AS stock FROM fx_products")
raw("variant_stock_sum", lambda r: extract.parsed(r).select("id", extract.variant_stock().alias("stock")), "SELECT id, CASE WHEN id % 4 = 2 THEN coalesce(stock, 0) + 1 END AS stock FROM fx_products")
raw("product_stock_status", lambda r: extract.parsed(r).select("id", extract.stock_status(extract.stock()).alias("stock_status")), f"SELECT id, {STATUS} AS stock_status FROM fx_products")
raw("product_brand", lambda r: extract.parsed(r).select("id", extract.brand().alias("brand")), "SELECT id, nullif(brand, '') AS brand FROM fx_products")
raw("product_url", lambda r: extract.parsed(r).select("id", extract.url(BASE).alias("url")), f"SELECT id, {URL} AS url FROM fx_products")
raw("first_present", lambda r: extract.parsed(r).select("id", extract.f("sku", "missing", "id").alias("value")), f"SELECT id, {SKU} AS value FROM fx_products")
raw(
    "normalize_products",
    lambda r: extract.products(r, BASE)[0].drop("body"),
    f"SELECT CAST(id AS varchar) AS product_id, {SKU} AS sku, CAST(NULL AS varchar) AS ean, title, price, price AS regular_price, {STOCK} AS stock, {STATUS} AS stock_status, nullif(brand, '') AS brand, 'EUR' AS currency, {URL} AS url FROM fx_products",
)
IMAGES = f"SELECT {SKU} AS sku, x.url, x.sort_order, x.sort_order = 0 AS is_cover FROM fx_products CROSS JOIN (VALUES ('https://cdn.example/77/500x500x2.jpg', 0), ('https://shop.example/a.jpg', 1), ('https://img.example/b.jpg', 3)) x(url, sort_order)"
raw("product_images", lambda r: extract.images(r, BASE, CDN), IMAGES)
QUERIES["dedupe_images"], ORACLE_SQL["dedupe_images"] = QUERIES["product_images"], ORACLE_SQL["product_images"]
SPEC_ROWS = f"""SELECT {SKU} AS sku, 1 AS rank, 0 AS pos, 'Weight:' AS name, CAST(id AS varchar) || ' g' AS value FROM fx_products UNION ALL SELECT {SKU}, 2, 0, 'Name:', title FROM fx_products WHERE id % 2 = 0
    UNION ALL SELECT {SKU}, 2, 1, 'Note', 'Some &amp; such' FROM fx_products WHERE id % 2 = 0 UNION ALL SELECT {SKU}, 2, 2, 'Share this', 'x' FROM fx_products WHERE id % 2 = 0
    UNION ALL SELECT {SKU}, 2, 0, 'name ', 'second' FROM fx_products WHERE id % 2 = 1 UNION ALL SELECT {SKU}, 2, 1, 'Size', sku FROM fx_products WHERE id % 2 = 1"""
raw("json_specs", extract.json_specs, SPEC_ROWS)
CLEAN_SPECS = f"SELECT sku, rank, pos, trim(regexp_replace(name, ':\\s*$', '')) AS name, replace(value, '&amp;', '&') AS value FROM ({SPEC_ROWS}) x WHERE name <> 'Share this'"
raw("spec_key_filter", lambda r: extract.spec_filter(extract.json_specs(r)), CLEAN_SPECS)
DEDUPED = f"SELECT sku, lower(name) AS normalized_name, name, value, row_number() OVER (PARTITION BY sku ORDER BY rank, pos) - 1 AS sort_order FROM ({CLEAN_SPECS}) y"
raw("dedupe_specs", lambda r: extract.dedupe_specs(extract.json_specs(r)), DEDUPED)
ALL_SPECS = f"SELECT sku, rank, pos, name, value FROM ({CLEAN_SPECS}) j UNION ALL SELECT {SKU}, 4, 0, 'Weight', 'late' FROM fx_products WHERE id % 3 = 1 UNION ALL SELECT {SKU}, 4, 1, 'Code', 'C' || CAST(id AS varchar) FROM fx_products WHERE id % 3 = 1 UNION ALL SELECT {SKU}, 5, 0, 'Power', CAST(id AS varchar) || ' W' FROM fx_products WHERE id % 3 = 1 UNION ALL SELECT sku, 7, 0, 'Article number', sku FROM fx_products WHERE id % 5 <> 0"
DEDUPED_SPECS = f"SELECT sku, normalized_name, name, value, row_number() OVER (PARTITION BY sku ORDER BY rank, pos) - 1 AS sort_order FROM (SELECT *, lower(name) AS normalized_name, row_number() OVER (PARTITION BY sku, lower(name) ORDER BY rank, pos) AS r FROM ({ALL_SPECS}) y) z WHERE r = 1"
raw("product_specs", lambda r: extract.dedupe_specs(extract.product_specs(r)), DEDUPED_SPECS)
raw(
    "product_category_nodes",
    lambda r: extract.category_nodes(r, BASE),
    f"SELECT {SKU} AS sku, q.p2 AS canonical_path, split_part(q.p2, '/', 4) AS slug, 'Two' AS name, 0 AS pos FROM fx_products JOIN (SELECT id AS i, p1, p2 FROM fx_product_paths) q ON q.i = id UNION ALL SELECT {SKU}, q.p1, split_part(q.p1, '/', 3), 'One', 1 FROM fx_products JOIN (SELECT id AS i, p1, p2 FROM fx_product_paths) q ON q.i = id",
)
LEGACY_IDS = f"SELECT {SKU} AS sku, CASE WHEN split_part(q.p2, '/', 4) = split_part(q.p1, '/', 3) THEN split_part(q.p1, '/', 3) ELSE split_part(q.p2, '/', 4) || ',' || split_part(q.p1, '/', 3) END AS category_ids FROM fx_products JOIN (SELECT id AS i, p1, p2 FROM fx_product_paths) q ON q.i = id"
raw("legacy_category_ids", lambda r: extract.legacy_category_ids(extract.category_nodes(r, BASE)), LEGACY_IDS)
raw("failure_message", lambda r: r.select("id", text.failure_message(F.concat(F.lit("S"), F.col("id").cast("string")), F.lit("ValueError"), F.lit("bad price")).alias("message")), "SELECT id, 'S' || CAST(id AS varchar) || ': ValueError: bad price' AS message FROM fx_products")

# listings

LISTED = "(SELECT f.id, f.p2 AS canonical_path, c.id AS cid, (row_number() OVER (PARTITION BY f.p2 ORDER BY f.id) - 1) // 10 + 1 AS page, (row_number() OVER (PARTITION BY f.p2 ORDER BY f.id) - 1) % 10 AS pos, count(*) OVER (PARTITION BY f.p2) AS own FROM fx_product_paths f JOIN fx_categories c ON c.canonical_path = f.p2)"
PAGED = f"(SELECT id, canonical_path, cid, page, pos, own FROM {LISTED} a UNION ALL SELECT id, canonical_path, cid, page + 1, pos, own FROM {LISTED} b WHERE cid % 13 = 0 AND page = (own - 1) // 10 + 1)"
META = f"(SELECT DISTINCT canonical_path, page, cid, own + CASE WHEN cid % 17 = 0 THEN 1 ELSE 0 END AS total FROM {PAGED} p)"


def listed(name: str, f, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: f(staged(spread(listing_pages(spark, sf_dir)))))


listed("listing_products", lambda p: listing.listing_items(p).select("canonical_path", "page", "pos", F.get_json_object("item", "$.id").cast("bigint").alias("id")), f"SELECT canonical_path, page, CAST(pos AS int) AS pos, id FROM {PAGED} p")
listed("listing_item_key", lambda p: listing.listing_items(p).select("canonical_path", "page", "key"), f"SELECT canonical_path, page, 'id:' || CAST(id AS varchar) AS key FROM {PAGED} p")
listed("listing_metadata", lambda p: listing.listing_metadata(p).select("canonical_path", "page", "total", "limit"), f"SELECT canonical_path, page, total, CAST(10 AS bigint) AS \"limit\" FROM {META} m")
listed("listing_total_pages", lambda p: listing.listing_metadata(p).select("canonical_path", "page", "total_pages", "more"), f"SELECT canonical_path, page, (total + 9) // 10 AS total_pages, page < (total + 9) // 10 AS more FROM {META} m")
listed("listing_summary", lambda p: listing.summaries(listing.listing_items(p), BASE).select("canonical_path", "page", "product_id", "sku", "name", "price"), f"SELECT p.canonical_path, p.page, CAST(p.id AS varchar) AS product_id, CASE WHEN p.id % 5 = 0 THEN '' ELSE f.sku END AS sku, f.title AS name, f.price FROM {PAGED} p JOIN fx_products f ON f.id = p.id")
listed("first_seen_listing_items", lambda p: listing.first_seen(listing.listing_items(p)).select("canonical_path", "key", "page"), f"SELECT canonical_path, 'id:' || CAST(id AS varchar) AS key, min(page) AS page FROM {PAGED} p GROUP BY canonical_path, id")
listed("repeated_listing_pages", lambda p: listing.repeated_pages(listing.listing_items(p)), f"SELECT DISTINCT canonical_path, page FROM {PAGED} p WHERE cid % 13 = 0 AND page > (own - 1) // 10 + 1")
def with_failures(p: DataFrame) -> DataFrame:
    """Listing status where the document of every 41st product was rejected."""
    items = staged(listing.listing_items(p))
    short = listing.summaries(items, BASE)
    rejects = short.where(F.col("product_id").cast("bigint") % 41 == 0).select(text.first_present("sku", "product_id").alias("key"))
    return listing.listing_status(p, listing.failed_details(short, rejects), items)


listed(
    "listing_completeness",
    with_failures,
    f"SELECT canonical_path, max(own + CASE WHEN cid % 17 = 0 THEN 1 ELSE 0 END) AS list_total, max(own) AS unique_listed, count(DISTINCT id) FILTER (WHERE id % 41 = 0) AS failed, CASE WHEN max(cid) % 13 = 0 OR max(cid) % 17 = 0 OR count(*) FILTER (WHERE id % 41 = 0) > 0 THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN max(cid) % 13 = 0 THEN 'repeated page' WHEN max(cid) % 17 = 0 THEN 'count differs' WHEN count(*) FILTER (WHERE id % 41 = 0) > 0 THEN 'failed details' ELSE '' END AS reason FROM {PAGED} p GROUP BY canonical_path",
)
simple(
    "listing_page_plan",
    "fx_product_paths",
    lambda f: listing.page_plan(f.groupBy(F.col("p2").alias("canonical_path")).agg(F.ceil(F.count("*") / 10).alias("pages")).withColumn("url", F.concat(F.lit(BASE), "canonical_path"))),
    "SELECT canonical_path, CAST(page AS int) AS page, CASE WHEN page = 1 THEN 'https://shop.example' || canonical_path ELSE 'https://shop.example' || rtrim(canonical_path, '/') || '/page' || CAST(page AS varchar) || '.html' END AS url FROM (SELECT p2 AS canonical_path, unnest(range(1, (count(*) + 9) // 10 + 1)) AS page FROM fx_product_paths GROUP BY p2) x",
)


@query("listing_fallback_record", "SELECT sku, CAST(id AS varchar) AS product_id, title, price FROM fx_products WHERE id % 4 = 0 OR id % 7 = 0")
def listing_fallback_record(spark, sf_dir):
    p = view(spark, sf_dir, "fx_products")
    details = p.where("id % 4 <> 0").select("sku", F.when(F.col("id") % 7 == 0, F.lit("<html>")).otherwise(F.to_json(F.struct("id"))).alias("body"))
    return listing.fallback_records(details, p.select("sku", F.col("id").cast("string").alias("product_id"), F.col("title").alias("name"), F.col("price").cast("string").alias("price"), "url")).drop("url")


# paths and text

PAGE_PATH = "lower(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''))"
CANON = f"CASE WHEN trim({PAGE_PATH}, '/') = '' THEN '/' ELSE '/' || trim(regexp_replace(regexp_replace({PAGE_PATH}, '[^a-z0-9_~./-]', '-', 'g'), '-+', '-', 'g'), '/') || '/' END"


def pages(name: str, f, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/pages.parquet")))


pages("normalize_category_path", lambda p: p.select("page_id", paths.normalize_path(F.col("url")).alias("path")), f"SELECT page_id, {CANON} AS path FROM pages")
simple("category_slug", "fx_categories", lambda c: c.select("id", paths.slug(F.col("canonical_path")).alias("slug")), "SELECT id, slug FROM fx_categories")
simple("parent_path", "fx_categories", lambda c: c.select("id", paths.parent(F.col("canonical_path")).alias("parent")), "SELECT id, coalesce(parent_path, '/en/') AS parent FROM fx_categories")
simple("path_level", "fx_categories", lambda c: c.select("id", paths.level(F.col("canonical_path")).alias("level")), "SELECT id, level + 1 AS level FROM fx_categories")
simple("path_segments", "fx_categories", lambda c: c.select("id", F.array_join(paths.segments(F.col("canonical_path")), ">").alias("segments")), "SELECT id, replace(trim(canonical_path, '/'), '/', '>') AS segments FROM fx_categories")
simple("strip_language_prefix", "fx_categories", lambda c: c.select("id", F.array_join(paths.strip_language(paths.segments(F.col("canonical_path"))), ">").alias("segments")), "SELECT id, replace(trim(substr(canonical_path, 5), '/'), '/', '>') AS segments FROM fx_categories")
simple("clean_category_name", "fx_categories", lambda c: c.select("id", text.clean_category_name(F.concat(F.lit(" "), "name", F.lit(" ("), F.col("id").cast("string"), F.lit(") "))).alias("name")), "SELECT id, name FROM fx_categories")
simple("extract_count", "fx_categories", lambda c: c.select("id", text.extract_count(F.when(F.col("id") % 2 == 0, F.concat(F.lit("("), F.col("id").cast("string"), F.lit(")"))), F.when(F.col("id") % 3 == 0, F.concat("name", F.lit(" ("), F.col("level").cast("string"), F.lit(")")))).alias("n")), "SELECT id, CAST(CASE WHEN id % 2 = 0 THEN id WHEN id % 3 = 0 THEN level ELSE 0 END AS int) AS n FROM fx_categories")
simple("slugify", "fx_products", lambda p: p.select("id", text.slugify(F.concat(F.lit(" The "), "title", F.lit("_&_"), "sku", F.lit("! "))).alias("slug")), "SELECT id, 'the-' || replace(title, ' ', '-') || '-' || lower(sku) AS slug FROM fx_products")
simple("format_category_name", "fx_categories", lambda c: c.select("id", text.format_category_name(F.concat(F.lit("usb-"), "slug", F.lit("-kits"))).alias("name")), "SELECT id, 'USB ' || upper(substr(slug, 1, 1)) || substr(slug, 2) || ' Kits' AS name FROM fx_categories")
simple("legacy_primary_category", "fx_categories", lambda c: c.select("id", text.legacy_primary(F.when(F.col("id") % 2 == 0, F.concat("slug", F.lit(", Speakers"))).when(F.col("id") % 3 == 0, F.lit("components,speakers")).otherwise(" , ")).alias("name")), "SELECT id, CASE WHEN id % 2 = 0 THEN upper(substr(slug, 1, 1)) || substr(slug, 2) WHEN id % 3 = 0 THEN 'Speakers' ELSE 'Uncategorized' END AS name FROM fx_categories")
# Character references for DuckDB, from Python's own table of HTML 5 and of the numbers that HTML reads otherwise
REFS = {f"&{k}": v for k, v in entities.html5.items()} | {f"&#{n};": unescape(f"&#{n};") for n in range(128, 160)}
SHORT = "|".join(sorted((k for k in entities.html5 if not k.endswith(";")), key=len, reverse=True))
REF = f"&(?:#[0-9]{{1,7}};|#[xX][0-9a-fA-F]{{1,6}};|[A-Za-z][A-Za-z0-9]{{1,31}};|{SHORT})"
quoted = lambda x: "'" + x.replace("'", "''") + "'"
DECODED = f"""array_to_string(list_transform(list_zip(regexp_split_to_array(html, '{REF}'), regexp_extract_all(html, '{REF}')), lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' WHEN length(refs[x[2]]) > 0 THEN refs[x[2]]
    WHEN starts_with(x[2], '&#x') OR starts_with(x[2], '&#X') THEN chr(CAST('0x' || substr(x[2], 4, length(x[2]) - 4) AS int)) WHEN starts_with(x[2], '&#') THEN chr(CAST(substr(x[2], 3, length(x[2]) - 3) AS int)) ELSE x[2] END), '')"""
DECODING = f"WITH r AS (SELECT MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in REFS.items())}}} AS refs), d AS (SELECT page_id, {DECODED} AS html FROM pages, r) "
WHITE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
pages("normalize_text", lambda p: p.select("page_id", F.md5(text.normalize_text(F.col("html"))).alias("digest")), f"{DECODING} SELECT page_id, md5(lower(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '{WHITE}', ' ', 'g')))) AS digest FROM d")
pages("normalize_paragraph_text", lambda p: p.select("page_id", F.md5(text.normalize_paragraph(F.col("html"))).alias("digest")), f"{DECODING} SELECT page_id, md5(trim(regexp_replace(html, '{WHITE}', ' ', 'g'))) AS digest FROM d")
simple("normalize_spec_name", "fx_attributes", lambda a: a.select("product_id", "sort_order", text.normalize_spec_name(F.concat("name", F.lit("&amp;  Co : "))).alias("name")), "SELECT product_id, sort_order, lower(name) || '& co' AS name FROM fx_attributes")
query("parse_since_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")(
    lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.date_format(F.try_to_timestamp(F.date_format("ts", "yyyy-M-d"), F.lit("yyyy-M-d")), "yyyy-MM-dd").alias("day"))
)
ROOTS = ("/", "/en/", "/en/catalog/", "/en/collection/", "/en/sitemap/")  # fixed values: paths that are no categories
pages("excluded_url_sections", lambda p: p.where(~F.exists(F.array(*(F.lit(e) for e in html.EXCLUDED)), lambda e: F.contains(F.lower("url"), e))).select("page_id", "url"), "SELECT page_id, url FROM pages WHERE " + " AND ".join(f"NOT contains(lower(url), '{e}')" for e in html.EXCLUDED))


def category_urls(p: DataFrame) -> DataFrame:
    path = paths.normalize_path(F.col("url"))
    return p.where(path.startswith("/en/") & ~F.contains("url", F.lit(".html")) & ~path.isin(*ROOTS) & ~path.startswith("/en/tags/")).select("page_id", path.alias("canonical_path"))


pages("category_url_filter", category_urls, f"SELECT page_id, {CANON} AS canonical_path FROM pages WHERE starts_with({CANON}, '/en/') AND NOT contains(url, '.html') AND {CANON} NOT IN {ROOTS}")
def sitemap_documents(p: DataFrame) -> DataFrame:
    """Sitemap XML of 1,024 URLs at most each, whatever the page_ids are."""
    loc = lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    numbered = p.select("url", F.shiftright(F.monotonically_increasing_id(), 10).alias("g"))
    return numbered.groupBy("g").agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.collect_list("url"), loc), ""), F.lit("</urlset>")).alias("xml"))


pages(
    "sitemap_xml_categories",
    lambda p: category_urls(sitemap_documents(p).select(F.explode(F.xpath("xml", F.lit("//loc/text()"))).alias("url"), F.lit(0).alias("page_id"))).groupBy("canonical_path").agg(F.count("*").alias("n")).select("canonical_path", "n", paths.slug(F.col("canonical_path")).alias("slug"), paths.parent(F.col("canonical_path")).alias("parent"), paths.level(F.col("canonical_path")).alias("level")),
    f"SELECT canonical_path, count(*) AS n, string_split(trim(canonical_path, '/'), '/')[-1] AS slug, regexp_replace(canonical_path, '[^/]+/$', '') AS parent, CAST(len(string_split(trim(canonical_path, '/'), '/')) AS int) AS level FROM (SELECT {CANON} AS canonical_path FROM pages WHERE starts_with({CANON}, '/en/') AND NOT contains(url, '.html') AND {CANON} NOT IN {ROOTS}) x GROUP BY canonical_path",
)
NODES = "(SELECT canonical_path, id % 3 AS pos, name || '-' || CAST(id % 3 AS varchar) AS name FROM fx_categories UNION ALL SELECT canonical_path, 5, 'late' FROM fx_categories WHERE id % 2 = 0)"


def repeated_nodes(c: DataFrame) -> DataFrame:
    own = c.select("canonical_path", (F.col("id") % 3).alias("pos"), F.concat("name", F.lit("-"), (F.col("id") % 3).cast("string")).alias("name"))
    return own.union(c.where("id % 2 = 0").select("canonical_path", F.lit(5), F.lit("late")))


simple("dedupe_by_path", "fx_categories", lambda c: repeated_nodes(c).where("canonical_path <> ''").groupBy("canonical_path").agg(F.min_by("name", "pos").alias("name")), f"SELECT canonical_path, arg_min(name, pos) AS name FROM {NODES} n GROUP BY canonical_path")
simple("sitemap_parse_diagnostics", "fx_categories", lambda c: repeated_nodes(c).groupBy("canonical_path").agg(F.count("*").alias("n")).agg(F.sum("n").alias("raw"), F.count("*").alias("normalized"), F.count_if(F.col("n") > 1).alias("duplicates")), f"SELECT CAST(sum(n) AS bigint) AS raw, count(*) AS normalized, count(*) FILTER (WHERE n > 1) AS duplicates FROM (SELECT canonical_path, count(*) AS n FROM {NODES} n GROUP BY canonical_path) x")
simple("merge_sitemaps", f"{SOURCE} {DB}", lambda s, d: s.select("canonical_path", F.lit("html").alias("origin")).unionByName(quality.missing(d, s).withColumn("origin", F.lit("xml"))), f"SELECT canonical_path, 'html' AS origin FROM {SOURCE} UNION ALL SELECT canonical_path, 'xml' FROM {DB} WHERE canonical_path NOT IN (SELECT canonical_path FROM {SOURCE})")

# documents and whole batches: shapes that SQL doesn't express



TITLE = "upper(substr(title, 1, 1)) || substr(title, 2)"


def text_docs(p: DataFrame) -> DataFrame:
    """Product texts: an introduction (every third has none), sections, one that stops, and what doesn't count around them.
    Every fourth has its introduction under a heading; descriptions are the supplier's plain texts."""
    intro = F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("<p class='intro'>Meet the <b>"), "title", F.lit("</b> &amp;\n more</p>")))
    before, after = (F.when((F.col("id") % 4 == 0) == at, intro).otherwise("") for at in (False, True))
    parts = (
        F.lit("<h2>Features of the page</h2><div><p>short</p><div>"), before, F.lit("<h3>Highlights</h3>"), after, F.lit("<ul><li>Size of "), F.col("id").cast("string"),
        F.lit("</li><li>Two</li></ul>loose<p>End</p><h4>Colours</h4><p>None at all of these</p><h3>Usage</h3><!-- no --><table><tr><td>Where</td><td>Anywhere</td></tr></table><h3>Customer Reviews</h3><p>Bad</p><h3>Details</h3><p>Never</p></div></div>"),
    )
    return p.select(F.col("id").alias("doc_id"), F.concat(*parts).alias("html"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(" Plain&nbsp;"), "sku", F.lit(" "))).alias("description"))


INTRO_TEXT = "CASE WHEN id % 3 = 0 THEN '{none}' ELSE 'Meet the ' || title || ' & more' END"
SECTIONS = "'<h3>Highlights</h3><ul><li>Size of ' || CAST(id AS varchar) || '</li><li>Two</li></ul><p>End</p>' || chr(10) || '<h3>Usage</h3><table><tr><td>Where</td><td>Anywhere</td></tr></table>'"
WHOLE_PAGE = "'<h2>Features of the page</h2><div><p>short</p><div>' || CASE WHEN id % 3 <> 0 AND id % 4 <> 0 THEN {i} ELSE '' END || '<h3>Highlights</h3>' || CASE WHEN id % 3 <> 0 AND id % 4 = 0 THEN {i} ELSE '' END || '<ul><li>Size of ' || CAST(id AS varchar) || '</li><li>Two</li></ul>loose<p>End</p><h4>Colours</h4><p>None at all of these</p><h3>Usage</h3><!-- no --><table><tr><td>Where</td><td>Anywhere</td></tr></table><h3>Customer Reviews</h3><p>Bad</p><h3>Details</h3><p>Never</p></div></div>' || chr(10) || ".format(i="'<p class=''intro''>Meet the <b>' || title || '</b> &amp;' || chr(10) || ' more</p>'")
WITH_INTRO = SECTIONS.replace("<h3>Highlights</h3>", "<h3>Highlights</h3>' || CASE WHEN id % 3 <> 0 AND id % 4 = 0 THEN '<p class=''intro''>Meet the <b>' || title || '</b> &amp;' || chr(10) || ' more</p>' ELSE '' END || '")


def text_query(name: str, f, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: f(staged(spread(text_docs(view(spark, sf_dir, "fx_products"))))))


# without an introduction of its own, a page's first fitting paragraph is the one under Colours
text_query("html_intro_paragraph", lambda d: html.intro_paragraph(d, staged(html.html_elements(d))).select("doc_id", "short_description"), f"SELECT id AS doc_id, {INTRO_TEXT.format(none='None at all of these')} AS short_description FROM fx_products")
text_query("html_long_description", lambda d: html.long_description(d, staged(html.html_elements(d))), f"SELECT id AS doc_id, {WHOLE_PAGE} {WITH_INTRO} AS long_description FROM fx_products")
text_query("product_descriptions", html.descriptions, f"SELECT id AS doc_id, {INTRO_TEXT.format(none='None at all of these')} AS short_description, {SECTIONS} AS long_description FROM fx_products")


@query("product_description", f"SELECT id, sku, title, coalesce(regular_price, price) AS regular_price, {INTRO_TEXT.format(none='None at all of these')} AS short_description, {SECTIONS} AS long_description FROM fx_products")
def product_description(spark, sf_dir):
    p = staged(view(spark, sf_dir, "fx_products"))
    texts = html.descriptions(staged(spread(text_docs(p)))).withColumnRenamed("doc_id", "id")
    return p.select("id", "sku", "title", F.coalesce("regular_price", "price").alias("regular_price")).join(texts, "id", "left")


def category_lists(c: DataFrame) -> DataFrame:
    """A document for each first category: its tree as nested lists, every third in a labelled block, with links that are no
    categories and what hangs below them."""
    item = lambda path, name, below: F.concat(F.lit("<li><a href='"), path, F.lit("'><b>"), name, F.lit("</b> <span>(7)</span></a>"), below, F.lit("</li>"))
    joined = lambda x: F.concat(F.lit("<ul>"), F.array_join(F.transform(F.sort_array(x), lambda s: s["item"]), ""), F.lit("</ul>"))
    rows = c.select("id", "canonical_path", "parent_path", "name", "level")
    low = rows.where("level = 3").groupBy("parent_path").agg(joined(F.collect_list(F.struct("id", item(F.col("canonical_path"), F.col("name"), F.lit("")).alias("item")))).alias("low"))
    middle = rows.where("level = 2").join(low.withColumnRenamed("parent_path", "canonical_path"), "canonical_path", "left")
    middle = middle.groupBy("parent_path").agg(joined(F.collect_list(F.struct("id", item(F.col("canonical_path"), F.col("name"), F.coalesce("low", F.lit(""))).alias("item")))).alias("middle"))
    top = rows.where("level = 1").join(middle.withColumnRenamed("parent_path", "canonical_path"), "canonical_path", "left")
    others = F.lit("<li><a href='/en/brands/x/'>Brands</a><ul><li><a href='/en/lost/'>Lost</a></li></ul></li><li>No link<ul><li><a href='/en/gone/'>Gone</a></li></ul></li><li><div><ul><li><a href='/en/deep/'>Deep</a></li></ul></div></li><li><a href='/en/extra-a/'>Extra A</a></li><li><a href='/en/extra-b/'>Extra B</a></li>")
    tree = F.concat(F.lit("<ul>"), item(F.col("canonical_path"), F.col("name"), F.coalesce("middle", F.lit(""))), others, F.lit("</ul>"))
    block = F.concat(F.lit("<ul><li><a href='/en/a/'>A</a></li><li><a href='/en/b/'>B</a></li><li><a href='/en/c/'>C</a></li></ul><div class='x gui-list' aria-labelledby='our categories'>"), tree, F.lit("</div>"))
    return top.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, block).otherwise(F.concat(F.lit("<ul><li><a href='/en/few/'>Few</a></li></ul>"), tree)).alias("html"))


simple(
    "sitemap_html_categories",
    "fx_categories",
    lambda c: html.sitemap_nodes(staged(spread(category_lists(c))), BASE + "/en").drop("pos"),
    "WITH t AS (SELECT id AS doc_id, canonical_path AS root FROM fx_categories WHERE level = 1) SELECT t.doc_id, c.name, replace(c.canonical_path, ' ', '-') AS canonical_path, replace(c.parent_path, ' ', '-') AS parent_path, CAST(c.level AS int) AS level, 7 AS source_count FROM t JOIN fx_categories c ON starts_with(c.canonical_path, t.root) UNION ALL SELECT doc_id, x.name, x.path, NULL, 1, 0 FROM t CROSS JOIN (VALUES ('Extra A', '/en/extra-a/'), ('Extra B', '/en/extra-b/')) x(name, path)",
)


def spec_docs(p: DataFrame, a: DataFrame, k: int) -> DataFrame:
    """A product's attributes as a definition list, a table, a list under a heading or a paragraph (k = 0 to 3)."""
    rows = catalog.nested(a.where(catalog.valid(F.col("value"))), "product_id", ["name", "value"], ["sort_order", "name"], "x")
    put = lambda start, f, end: F.concat(F.lit(start), F.array_join(F.transform("x", f), ""), F.lit(end))
    forms = (
        put('<section id="specs"><dl>', lambda s: F.concat(F.lit("<dt>"), s["name"], F.lit("</dt><dd>"), s["value"], F.lit("</dd>")), "</dl></section>"),
        put("<table>", lambda s: F.concat(F.lit("<tr><td>"), s["name"], F.lit("</td><td>"), s["value"], F.lit("</td></tr>")), "</table>"),
        F.when(F.col("id") % 3 == 0, put("<h3>Technical data</h3><ul>", lambda s: F.concat(F.lit("<li>"), s["name"], F.lit(": "), s["value"], F.lit("</li>")), "</ul><hr><p>Not: here</p>"))
        .when(F.col("id") % 3 == 1, put("<p>On <strong>Technical <!-- x --></strong></p><p><strong>Physical parameters</strong></p><div>", lambda s: F.concat(s["name"], F.lit(" - "), s["value"], F.lit(";")), "</div><h4>Other</h4><p>Not: here</p>"))
        .otherwise(put("<h2>Specificaties</h2><p>below</p><table>", lambda s: F.concat(F.lit("<tr><th>"), s["name"], F.lit("</th><td>"), s["value"], F.lit("</td></tr>")), "</table>")),
        put("<p><strong>Specifications</strong>:", lambda s: F.concat(F.lit(" "), s["name"], F.lit(": "), s["value"], F.lit(" •")), "</p>"),
    )
    return p.select("id").join(rows, "id").select(F.col("id").alias("doc_id"), forms[k].alias("html"))


def spec_query(name: str, k: int, rank: int) -> None:
    simple(
        name,
        "fx_products fx_attributes",
        lambda p, a: html.spec_pairs(staged(spread(spec_docs(p, a, k)))).where(F.col("rank") == rank).select("doc_id", "name", "value"),
        f"SELECT product_id AS doc_id, name, trim(value) AS value FROM fx_attributes WHERE trim(value) <> ''",
    )


for _k, _name in enumerate(("html_specs_dl", "html_specs_table", "html_specs_heading_sections", "html_specs_paragraphs")):
    spec_query(_name, _k, _k + 3)
simple(
    "split_key_value",
    "fx_attributes",
    lambda a: a.where(catalog.valid(F.col("value"))).select("product_id", "sort_order", html.split_key_value(F.concat(F.lit(" "), "name", F.when(F.col("sort_order") % 2 == 0, ": ").otherwise(" - "), "value")).alias("x")).select("product_id", "sort_order", "x.name", "x.value"),
    "SELECT product_id, sort_order, name, value FROM fx_attributes WHERE trim(value) <> ''",
)


from . import batch_queries  # noqa: E402, F401
