"""Listing pages: product items, counters, page plans and completeness of a category's listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_present, once

KEYS = ("id", "code", "sku", "url", "link")


def field(json: Column, *names: str) -> Column:
    """The first of the names that is neither NULL nor ''. One parse for all names; nested values and fractions, which
    get_json_object writes its own way, are left to it."""
    whole = first_present(*(F.get_json_object(json, f"$.{n}") for n in names))
    return once(once(members(json), lambda m: member(m, *names)), lambda v: F.when(v.rlike(r"^(?:[\[{]|-?\d+[.eE])"), whole).otherwise(v))


def members(json: Column) -> Column:
    """The fields of a JSON object as texts, parsed once for all of them; get_json_object parses anew for each."""
    return F.from_json(json, "map<string,string>")


def member(m: Column, *names: str) -> Column:
    """`field` of what `members` gives."""
    return first_present(*(F.try_element_at(m, F.lit(n)) for n in names))


def envelope(page: Column) -> Column:
    return F.coalesce(F.get_json_object(page, "$.collection"), F.get_json_object(page, "$.catalog"), page)


def values(json: Column) -> Column:
    """The members of a JSON list, or the values of an object in document order, as JSON texts."""
    listed = F.from_json(json, "array<string>")
    return F.when(F.trim(json).startswith("["), listed).when(F.trim(json).startswith("{"), F.map_values(F.from_json(json, "map<string,string>"))).otherwise(F.array().cast("array<string>"))


def products(page: Column) -> Column:
    found = F.coalesce(F.get_json_object(envelope(page), "$.products"), *(F.get_json_object(page, f"$.{n}") for n in ("products", "items", "data")))
    return once(F.coalesce(found, F.lit("[]")), values)


def item_key(item: Column) -> Column:
    """'name:value' of the first of id, code, sku, url, link that an item has, else ''."""
    return once(members(item), lambda m: F.coalesce(*(F.concat(F.lit(f"{k}:"), member(m, k)) for k in KEYS), F.lit("")))


def listing_items(pages: DataFrame) -> DataFrame:
    """pages (canonical_path, page, body) -> canonical_path, page, pos, item, key."""
    rows = pages.select("canonical_path", "page", F.posexplode_outer(products(F.col("body"))).alias("pos", "item")).where("pos is not null")  # outer: as in extract
    return rows.withColumn("key", item_key(F.col("item")))


def listing_metadata(pages: DataFrame) -> DataFrame:
    """total, pages, page, limit, category_id of each page; a missing number of pages follows from total and limit."""
    env, body = envelope(F.col("body")), F.col("body")
    number = lambda j, n: F.nullif(F.get_json_object(j, f"$.{n}").try_cast("bigint"), F.lit(0))
    out = pages.select(
        "canonical_path", F.col("page").alias("asked"), F.coalesce(number(env, "count"), number(body, "total"), F.lit(0)).alias("total"), F.coalesce(number(env, "pages"), F.lit(0)).alias("declared"),
        F.coalesce(number(env, "page"), F.lit(1)).alias("page"), F.coalesce(number(env, "limit"), F.lit(100)).alias("limit"), F.get_json_object(env, "$.category_id").alias("category_id"),
    )
    pages_of = F.when(F.col("declared") > 0, F.col("declared")).otherwise(F.ceil(F.col("total") / F.col("limit")))
    return out.withColumn("total_pages", pages_of.cast("bigint")).withColumn("more", F.col("page") < F.col("total_pages"))


def page_plan(categories: DataFrame) -> DataFrame:
    """categories (canonical_path, url, pages) -> a row for each page with its URL."""
    rows = categories.where("pages > 0").select("canonical_path", "url", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"))
    root = F.regexp_replace("url", "/+$", "")
    return rows.select("canonical_path", "page", F.when(F.col("page") == 1, F.col("url")).otherwise(F.concat(root, F.lit("/page"), F.col("page").cast("string"), F.lit(".html"))).alias("url"))


def summaries(items: DataFrame, base: str) -> DataFrame:
    """The short record of each listed item."""
    m = F.col("m")  # a column, named often enough that the parsing stays apart
    url, price = member(m, "url"), F.try_element_at(m, F.lit("price"))
    return items.withColumn("m", members(F.col("item"))).select(
        "canonical_path", "page", "pos", F.coalesce(member(m, "id"), F.lit("")).alias("product_id"), F.coalesce(member(m, "code", "sku"), F.lit("")).alias("sku"),
        F.when(url.rlike("^https?://"), url).when(url.isNotNull(), F.concat(F.lit(f"{base}/en/"), F.regexp_replace(url, "^/+", ""))).otherwise("").alias("url"),
        F.coalesce(member(m, "title", "fulltitle"), F.lit("")).alias("name"), F.when(price.startswith("{"), once(members(price), lambda p: member(p, "price", "price_incl"))).try_cast("double").alias("price"), member(m, "image").alias("image_id"),
    )


def fallback_records(details: DataFrame, short: DataFrame) -> DataFrame:
    """details (sku, body), short (sku, product_id, name, price, url): the listing's record for each SKU whose detail is
    missing or no JSON. Its children are absent, so a merge keeps what is stored."""
    good = details.where(F.try_parse_json("body").isNotNull()).select("sku").distinct()
    return short.where("sku <> '' or product_id <> ''").join(good, "sku", "left_anti").select("sku", "product_id", F.col("name").alias("title"), F.col("price").try_cast("double").alias("price"), "url")


def repeated_pages(items: DataFrame) -> DataFrame:
    """Pages after the first that list the same keys as the page before."""
    keys = items.groupBy("canonical_path", "page").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    by = Window.partitionBy("canonical_path").orderBy("page")
    return keys.withColumn("before", F.lag("keys").over(by)).where((F.size("keys") > 0) & (F.col("keys") == F.col("before"))).select("canonical_path", "page")


def failed_details(short: DataFrame, rejects: DataFrame) -> DataFrame:
    """short records of listed items -> canonical_path, failed. Items fail whose document was rejected, rejects (key)
    being the SKU, or without one the product id, and items that have neither SKU nor product id."""
    short = short.select("canonical_path", first_present(F.col("sku"), F.col("product_id")).alias("key"), F.concat_ws(":", "url", "name").alias("item")).distinct()
    nameless = short.where("key is null")
    known = short.select("canonical_path", "key").distinct().join(rejects.select("key").distinct(), "key", "left_semi")
    return known.select("canonical_path", "key").union(nameless.select("canonical_path", "item")).groupBy("canonical_path").agg(F.count("*").alias("failed"))


def first_seen(items: DataFrame) -> DataFrame:
    """Each key of a category with the page and place that show it first."""
    return items.where("key <> ''").groupBy("canonical_path", "key").agg(F.min(F.struct("page", "pos")).alias("at")).select("canonical_path", "key", "at.page", "at.pos")


def listing_status(pages: DataFrame, failures: DataFrame, items: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """pages, failures (canonical_path, failed) -> list_total, unique_listed, failed, status, reason. items and meta: items and
    counters of the pages, where they are known already."""
    items, meta = listing_items(pages) if items is None else items, listing_metadata(pages) if meta is None else meta
    totals = meta.groupBy("canonical_path").agg(F.max("total").alias("list_total"), F.greatest(F.max("total_pages"), F.max("asked")).alias("last_page"))
    unique = items.where("key <> ''").groupBy("canonical_path").agg(F.count_distinct("key").alias("unique_listed"))
    repeats = repeated_pages(items).groupBy("canonical_path").agg(F.min("page").alias("repeated"))
    filled = items.select("canonical_path", "page").distinct()
    empty = meta.select("canonical_path", F.col("asked").alias("page")).join(filled, ["canonical_path", "page"], "left_anti").join(totals, "canonical_path").where("page < last_page").groupBy("canonical_path").agg(F.min("page").alias("empty_page"))
    out = totals.join(unique, "canonical_path", "left").join(repeats, "canonical_path", "left").join(empty, "canonical_path", "left").join(failures, "canonical_path", "left")
    out = out.withColumns({"unique_listed": F.coalesce("unique_listed", F.lit(0)), "failed": F.coalesce("failed", F.lit(0)).cast("bigint")})
    reason = F.when(F.col("repeated").isNotNull(), "repeated page").when(F.col("empty_page").isNotNull(), "empty page").when((F.col("list_total") > 0) & (F.col("unique_listed") != F.col("list_total")), "count differs").when(F.col("failed") > 0, "failed details")
    return out.select("canonical_path", "list_total", "unique_listed", "failed", F.when(reason.isNull(), "complete").otherwise("incomplete").alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))
