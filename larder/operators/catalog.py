"""Filters, sorting, paging and nested children of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text

# What may be asked for.
STOCK_STATES = ("in_stock", "out_of_stock", "on_backorder")
SORT_COLUMNS = {"sku": "sku", "title": "title", "brand": "brand", "price": "regular_price", "stock": "stock", "updated_at": "updated_at", "created_at": "created_at"}


def matches(term: str) -> Column:
    """Title, SKU or brand contains the term, whatever its case; % and _ in it are wildcards."""
    like = f"%{term}%"
    return F.col("title").ilike(like) | F.col("sku").ilike(like) | F.col("brand").ilike(like)


def filter_products(products: DataFrame, *, brand: str | None = None, search: str | None = None, stock_status: str | None = None, links: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """categories (id): products linked to any of them, by a semi-join."""
    if stock_status and stock_status not in STOCK_STATES:
        raise ValueError(f"stock_status must be one of {', '.join(STOCK_STATES)}")
    if brand:
        products = products.where(F.col("brand") == brand)
    if stock_status:
        products = products.where(F.col("stock_status") == stock_status)
    if search:
        products = products.where(matches(search))
    if categories is not None:
        wanted = links.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi").select(F.col("product_id").alias("id"))
        products = products.join(wanted, "id", "left_semi")
    return products


def order(sort_by: str | None = None, sort_order: str | None = None) -> list[Column]:
    """Sort keys: NULLs last when ascending and first when descending, ties by id. Unknown names mean updated_at, descending."""
    column = SORT_COLUMNS.get(sort_by or "")
    if column and (sort_order or "").lower() == "asc":
        return [F.col(column).asc_nulls_last(), F.col("id").asc()]
    return [F.col(column or "updated_at").desc_nulls_first(), F.col("id").asc()]


def page(products: DataFrame, number: int, size: int, sort_by: str | None = None, sort_order: str | None = None) -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page must be at least 1 and its size 1 to 100")
    return products.orderBy(*order(sort_by, sort_order)).offset((number - 1) * size).limit(size)


def nested(children: DataFrame, key: str, fields: list[str], by: list[str], name: str) -> DataFrame:
    """One row for each key with its children as an ordered array of structs."""
    return children.groupBy(F.col(key).alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*by, *(f for f in fields if f not in by)))), lambda s: F.struct(*(s[f].alias(f) for f in fields))).alias(name))


def valid(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def specifications(attributes: DataFrame) -> DataFrame:
    """Attributes with a value, numbered anew from 0 in order within each product."""
    by = Window.partitionBy("product_id").orderBy("sort_order", "name")
    return attributes.where(valid(F.col("value"))).select("product_id", "name", "value", (F.row_number().over(by) - 1).cast("bigint").alias("sort_order"))


def primary_category(links: DataFrame, categories: DataFrame) -> DataFrame:
    """product_id, category, names, slugs of the deepest linked path (language aside); ties go to the greatest slug."""
    slugs = paths.strip_language(paths.segments(F.col("canonical_path")))
    ranked = links.join(categories.select(F.col("id").alias("category_id"), "slug", slugs.alias("slugs")), "category_id")
    best = ranked.groupBy("product_id").agg(F.max_by("slugs", F.struct(F.size("slugs"), F.coalesce("slug", F.lit("")), "category_id")).alias("slugs"))
    names = F.transform("slugs", text.format_category_name)
    return best.select("product_id", F.try_element_at(names, F.lit(-1)).alias("category"), F.array_join(names, " > ").alias("names"), F.array_join("slugs", ",").alias("slugs"))


def needs_enrichment(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Products with a URL and no stock, no stock state or at most two attributes with a value."""
    counts = attributes.where(valid(F.col("value"))).groupBy("product_id").agg(F.count("*").alias("n"))
    joined = products.join(counts, F.col("id") == F.col("product_id"), "left")
    sparse = F.col("stock").isNull() | F.col("stock_status").isNull() | (F.coalesce("n", F.lit(0)) <= 2)
    return joined.where(F.col("url").isNotNull() & sparse).select("id", "sku", "url", F.coalesce("n", F.lit(0)).alias("attributes"))


def list_items(products: DataFrame, images: DataFrame, attributes: DataFrame, links: DataFrame, categories: DataFrame) -> DataFrame:
    """What a product list shows: price and description fallbacks, primary category, nested images and specifications.
    The chosen products are joined to aggregated children, so children of other products drop out by semi-joins first."""
    own = products.select("id")
    near = lambda t: t.join(own, t.product_id == own.id, "left_semi")
    pictures = nested(near(images), "product_id", ["src", "sort_order"], ["sort_order", "src"], "images")
    specs = nested(specifications(near(attributes)), "product_id", ["name", "value", "sort_order"], ["sort_order", "name"], "specifications")
    main = primary_category(near(links), categories).withColumnRenamed("product_id", "id")
    out = products.join(pictures, "id", "left").join(specs, "id", "left").join(main, "id", "left")
    return out.select(
        "id", "sku", "title", "brand", F.coalesce("regular_price", "price").alias("price"), F.lit("EUR").alias("currency"), "stock", "stock_status", "url",
        F.coalesce("category", F.lit("Uncategorized")).alias("category"), F.coalesce("slugs", F.lit("")).alias("category_slugs"),
        F.coalesce(F.to_json("images"), F.lit("[]")).alias("images"), F.coalesce(F.to_json("specifications"), F.lit("[]")).alias("specifications"),
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
    )


def image_url(ref: Column, base: str, cdn: str) -> Column:
    """A number is an image of the CDN, an absolute URL stays, anything else hangs below base."""
    return F.when(ref.rlike("^[0-9]+$"), F.concat(F.lit(cdn), ref, F.lit("/500x500x2.jpg"))).when(ref.rlike("^https?://"), ref).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(ref, "^/+", "")))


def stats(products: DataFrame, categories: DataFrame, jobs: DataFrame) -> DataFrame:
    """Products, categories, distinct brands and the end of the last completed run, in one row."""
    a = products.agg(F.count("*").alias("products"), F.count_distinct(F.nullif("brand", F.lit(""))).alias("brands"))
    b = categories.agg(F.count("*").alias("categories"))
    c = jobs.where("status = 'completed'").agg(F.max("finished_at").alias("last_run"))
    return a.crossJoin(b).crossJoin(c)  # three rows of one


def coverage(products: DataFrame, links: DataFrame, categories: DataFrame, jobs: DataFrame) -> DataFrame:
    a = products.agg(F.count("*").alias("products"), F.count_if(F.col("brand").isNull()).alias("fallback_only"))
    b = links.agg(F.count("*").alias("appearances"), F.count_distinct("product_id").alias("linked"))
    c = categories.agg(F.count("*").alias("categories"))
    d = jobs.agg(F.max_by("status", "id").alias("last_status"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # four rows of one
