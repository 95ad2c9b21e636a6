"""Raw product JSON to normalised products, images, attributes and category nodes.

A document is parsed once into a map from field to text, where nested values stay JSON text in document
order. Field names come in several spellings; the first that is neither NULL nor '' counts.

Lists are opened by outer generators, and rows without a member dropped after: before others Spark puts a filter on the
list's size, which works the whole list out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.text import first_present, once
from ..sources import html
from ..sources.tables import spread, staged
from .catalog import image_url
from .listing import field, member, members, values

# Words of buttons and sections that aren't specifications.
UI_WORDS = ("review", "reviews", "show more", "show less", "share", "add to cart", "delivery", "what's in the box", "highlights")


def unwrap(body: Column) -> Column:
    return once(F.get_json_object(body, "$.product"), lambda inner: F.when(inner.startswith("{"), inner).otherwise(body))


def parsed(raw: DataFrame) -> DataFrame:
    """raw (…, body) with m: the document's fields."""
    return raw.withColumn("m", F.from_json(unwrap(F.col("body")), "map<string,string>"))


def f(*names: str) -> Column:
    return first_present(*(F.try_element_at("m", F.lit(n)) for n in names))


def is_object(c: Column) -> Column:
    return F.coalesce(c.startswith("{"), F.lit(False))


def product_id() -> Column:
    return F.coalesce(f("id", "productId", "product_id"), F.lit(""))


def sku() -> Column:
    return F.coalesce(f("sku", "number", "articleNumber", "vid", "variantId"), F.nullif(product_id(), F.lit("")))


def price_text() -> Column:
    p = F.coalesce(F.try_element_at("m", F.lit("price")), F.try_element_at("m", F.lit("prices")))
    return F.when(is_object(p), once(members(p), lambda m: member(m, "amount", "value", "price"))).otherwise(F.nullif(p, F.lit("")))


def stock_field() -> Column:
    return F.coalesce(F.try_element_at("m", F.lit("stock")), f("inventory", "availability"))


def variant_stock() -> Column:
    """Sum of the readable stock levels of the variants, NULL if there is none."""
    levels = F.filter(F.transform(F.map_values(F.from_json(f("variants"), "map<string,string>")), lambda v: F.coalesce(F.get_json_object(v, "$.stock.level"), F.get_json_object(v, "$.stock_level")).try_cast("int")), lambda n: n.isNotNull())
    return once(levels, lambda found: F.when(F.size(found) > 0, F.aggregate(found, F.lit(0), lambda a, b: a + b)))


def stock(page: Column | None = None) -> Column:
    s = stock_field()
    out = F.coalesce(F.when(is_object(s), once(members(s), lambda m: member(m, "level", "quantity", "qty", "stock")).try_cast("int")), variant_stock())
    if page is not None:
        out = F.coalesce(out, F.nullif(F.regexp_extract(page, r"(?i)(\d+)\s*\+?\s*in\s*stock", 1), F.lit("")).try_cast("int"), F.when(page.rlike(r"(?i)out\s*of\s*stock"), 0))
    return out


def stock_status(amount: Column, page: Column | None = None) -> Column:
    s = stock_field()
    true, false = (lambda c: c.eqNullSafe(F.lit("true"))), (lambda c: c.eqNullSafe(F.lit("false")))

    def of_object(m: Column) -> Column:
        on, available, level = (F.try_element_at(m, F.lit(n)) for n in ("on_stock", "available", "level"))
        backorder = F.coalesce(member(m, "allow_outofstock_sale", "delivery"), F.lit("false")) != "false"
        words = F.lower(member(m, "status", "text"))
        return (
            F.when(true(on) | (level.try_cast("int") > 0), "in_stock")
            .when(false(on) & (true(available) | backorder), "on_backorder")
            .when(false(on) | false(available) | (level.try_cast("int") == 0), "out_of_stock")
            .when(words.contains("in stock") | words.contains("available"), "in_stock")
            .when(words.contains("out of stock"), "out_of_stock")
            .when(words.contains("backorder") | words.contains("preorder"), "on_backorder")
        )

    def of_words(c: Column) -> Column:
        return once(F.lower(c), lambda c: F.when(c.rlike("in[ _]stock"), "in_stock").when(c.rlike("out[ _]of[ _]stock"), "out_of_stock").when(c.contains("backorder"), "on_backorder"))

    out = F.coalesce(F.when(is_object(s), once(members(s), of_object)).otherwise(of_words(s)), of_words(f("stockStatus", "availabilityText")), F.when(amount > 0, "in_stock").when(amount.isNotNull(), "out_of_stock"))
    if page is not None:
        out = F.coalesce(out, F.when(page.rlike(r"(?i)in\s*stock"), "in_stock").when(page.rlike(r"(?i)out\s*of\s*stock"), "out_of_stock").when(page.rlike("(?i)backorder"), "on_backorder"))
    return out


def brand() -> Column:
    b = f("brand", "manufacturer")
    return F.when(is_object(b), once(members(b), lambda m: member(m, "name", "title"))).otherwise(b)


def url(base: str) -> Column:
    u = f("url", "productUrl", "link")
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit(f"{base}/en/"), F.regexp_replace(u, "^/+", "")))


def products(raw: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Normalised products, and rejects (body, error, key): documents without an identity or with a price that is no number.
    raw may have a column `page`, the product's HTML, for stock that the JSON lacks."""
    page = F.col("page") if "page" in raw.columns else None
    rows = parsed(raw).withColumns({"sku": sku(), "price_text": price_text(), "stock": stock(page)})
    error = F.when(F.col("m").isNull(), "no JSON").when(F.col("sku").isNull(), "no SKU and no product id").when(F.col("price_text").isNotNull() & F.col("price_text").try_cast("double").isNull(), "price is no number")
    # staged, since both results read it, and a filter on the error would work out the fields that it reads again
    rows = staged(rows.select(
        product_id().alias("product_id"), "sku", f("ean", "gtin", "upc").alias("ean"), f("title", "name", "productName").alias("title"), F.col("price_text").try_cast("double").alias("price"), F.col("price_text").try_cast("double").alias("regular_price"),
        "stock", stock_status(F.col("stock"), page).alias("stock_status"), brand().alias("brand"), F.coalesce(f("currency"), F.lit("EUR")).alias("currency"), url(base).alias("url"), "body", error.alias("error"),
    ))
    key = first_present(F.col("sku"), F.get_json_object("body", "$.sku"), F.get_json_object("body", "$.id"))
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("body", "error", key.alias("key"))


def images(raw: DataFrame, base: str, cdn: str) -> DataFrame:
    """sku, url, sort_order, is_cover: cover first, then the gallery; of equal references the first stays, with its place."""
    cover = f("cover", "image", "mainImage", "thumbnail")
    gallery = values(F.coalesce(f("images", "gallery", "pictures"), F.lit("[]")))
    refs = F.concat(F.when(cover.isNotNull(), F.array(F.struct(cover.alias("ref"), F.lit(True).alias("is_cover")))).otherwise(F.array().cast("array<struct<ref:string,is_cover:boolean>>")), F.filter(F.transform(gallery, lambda g: F.struct(F.when(g.startswith("{"), field(g, "url", "src", "path", "image")).otherwise(F.nullif(g, F.lit(""))).alias("ref"), F.lit(False).alias("is_cover"))), lambda s: s["ref"].isNotNull()))
    rows = parsed(raw).select(sku().alias("sku"), F.posexplode_outer(refs).alias("pos", "x")).where("pos is not null")
    first = rows.groupBy("sku", "x.ref").agg(F.min(F.struct("pos", "x.is_cover")).alias("at"))
    return first.select("sku", image_url(F.col("ref"), base, cdn).alias("url"), F.col("at.pos").alias("sort_order"), F.col("at.is_cover").alias("is_cover"))


def json_specs(raw: DataFrame) -> DataFrame:
    """sku, rank, pos, name, value: pairs of `specs`, then of `attributes` or its like, in document order."""
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    of_specs = F.transform(values(F.when(is_object(f("specs")), f("specs")).otherwise("{}")), lambda s: pair(field(s, "title", "name", "label"), field(s, "value", "text")))
    attrs = f("attributes", "specifications", "properties")
    of_dict = F.transform(F.map_entries(F.from_json(attrs, "map<string,string>")), lambda e: pair(e["key"], F.nullif(e["value"], F.lit(""))))
    of_list = F.transform(F.from_json(attrs, "array<string>"), lambda s: pair(field(s, "name", "label", "key", "attribute_name"), field(s, "value", "text", "attribute_value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    of_attrs = F.when(is_object(attrs), of_dict).when(attrs.startswith("["), of_list).otherwise(none)
    ranked = lambda rank, pairs: F.transform(F.coalesce(pairs, none), lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), x["name"].alias("name"), x["value"].alias("value")))
    rows = parsed(raw).select(sku().alias("sku"), F.inline_outer(F.concat(ranked(1, of_specs), ranked(2, of_attrs))))  # both of one parse
    return rows.where("name is not null and value is not null")


def document_rows(raw: DataFrame) -> DataFrame:
    """raw -> doc_id, sku, html (its content), description, number, ean, and page (the
    product's own page, where raw has it)."""
    page = F.col("page") if "page" in raw.columns else F.lit(None).cast("string")
    return parsed(raw).select(F.xxhash64("body", page).alias("doc_id"), sku().alias("sku"), f("content").alias("html"), f("description", "shortDescription").alias("description"), f("sku", "number", "articleNumber").alias("number"), f("ean", "gtin", "upc").alias("ean"), page.alias("page"))


def documents(raw: DataFrame) -> DataFrame:
    """`document_rows`, a row for each distinct document."""
    return spread(document_rows(raw), "doc_id").distinct()  # one shuffle for both


LATER = 100_000_000  # places of a page's pairs begin beyond those of the content, one such step for each kind


def product_specs(raw: DataFrame) -> DataFrame:
    """sku, rank, pos, name, value of every source in order of precedence: JSON (1, 2), the content's HTML (3 to 6), then the
    page's, whose places come after all of the content's (6), the article number (7) and the EAN (8)."""
    rows = staged(documents(raw))
    own = rows.select("doc_id", "sku")
    found = html.spec_pairs(rows.where("html is not null").select("doc_id", "html"))
    if "page" in raw.columns:
        of_page = html.spec_pairs(rows.where("page is not null").select("doc_id", F.col("page").alias("html")))
        found = found.union(of_page.select("doc_id", F.lit(6), F.col("rank") * LATER + F.col("pos"), "name", "value"))
    pair = lambda rank, name, c: F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("pos"), F.lit(name).alias("name"), F.col(c).alias("value"))
    identity = rows.select("sku", F.inline(F.array(pair(7, "Article number", "number"), pair(8, "EAN", "ean")))).where("value is not null")
    return json_specs(raw).union(found.join(own, "doc_id").select("sku", "rank", "pos", "name", "value")).union(identity)


def descriptions(raw: DataFrame) -> DataFrame:
    """sku, description, short_description, long_description; the first two are the same text. Of documents with one SKU the
    one with the smaller hash counts."""
    first = document_rows(raw).groupBy("sku").agg(F.min_by(F.struct("doc_id", "html", "description"), "doc_id").alias("x"))
    rows = staged(spread(first.where("sku is not null").select("sku", "x.*"), "doc_id"))
    found = html.descriptions(rows.select("doc_id", "html", "description"))
    return rows.select("doc_id", "sku").join(found, "doc_id").select("sku", F.col("short_description").alias("description"), "short_description", "long_description")


def records(raw: DataFrame, base: str, cdn: str) -> tuple[DataFrame, DataFrame]:
    """Whole product records, with texts and nested images, specifications and category nodes, and the rejects of `products`.
    SKUs are unique in raw."""
    good, rejects = products(raw, base)
    own = staged(spread(raw.join(good.select("body").distinct(), "body", "left_semi")))
    listed = lambda df, by, fields: df.groupBy("sku").agg(F.transform(F.sort_array(F.collect_list(F.struct(by, *(c for c in fields if c != by)))), lambda s: F.struct(*(s[c].alias(c) for c in fields))).alias("x"))
    nodes = category_nodes(own, base)
    parts = {
        "images": listed(images(own, base, cdn), "sort_order", ("url", "sort_order", "is_cover")),
        "specifications": listed(dedupe_specs(product_specs(own)), "sort_order", ("name", "value", "sort_order")),
        "product_categories": listed(nodes, "pos", ("canonical_path", "slug", "name", "pos")),
    }
    out = good.join(descriptions(own), "sku", "left").join(legacy_category_ids(nodes), "sku", "left")
    for name, df in parts.items():
        out = out.join(df.withColumnRenamed("x", name), "sku", "left")
    return out.withColumnRenamed("body", "raw_json"), rejects


def spec_filter(rows: DataFrame) -> DataFrame:
    """Cleaned pairs whose key has 2 to 70 characters and no word of a button, and whose value isn't empty."""
    key = F.trim(F.regexp_replace(text.squeeze(text.unescape(F.col("name"))), r":\s*$", ""))
    clean = F.struct(key.alias("name"), text.squeeze(text.unescape(F.col("value"))).alias("value"))
    # generated columns, so that the filter reads texts instead of cleaning them again
    out = rows.select(*(c for c in rows.columns if c not in ("name", "value")), F.inline_outer(F.array(clean))).select(*rows.columns)
    return out.where((F.col("value") != "") & F.length("name").between(2, 70) & ~text.has_any(F.lower("name"), UI_WORDS))


def dedupe_specs(rows: DataFrame) -> DataFrame:
    """The first pair of each normalised name by source and place, numbered anew from 0."""
    named = spec_filter(rows).withColumn("normalized_name", text.normalize_spec_name(F.col("name"))).where("normalized_name <> ''")
    first = named.groupBy("sku", "normalized_name").agg(F.min(F.struct("rank", "pos", "name", "value")).alias("x"))
    by = Window.partitionBy("sku").orderBy("x.rank", "x.pos")
    return first.select("sku", "normalized_name", "x.name", "x.value", (F.row_number().over(by) - 1).cast("bigint").alias("sort_order"))


def category_nodes(raw: DataFrame, base: str) -> DataFrame:
    """sku, canonical_path, slug, name: category nodes of a list or an object, one for each path."""
    links = F.transform(values(F.coalesce(f("categories"), F.lit("[]"))), lambda n: F.struct(field(n, "url", "link", "path").alias("link"), field(n, "title", "name").alias("name")))
    nodes = F.transform(links, lambda n: F.struct(paths.normalize_path(n["link"], f"{base}/en").alias("canonical_path"), n["name"].alias("name")))
    rows = parsed(raw).select(sku().alias("sku"), F.posexplode_outer(nodes).alias("pos", "n")).select("sku", "pos", "n.canonical_path", "n.name")
    first = rows.where("canonical_path not in ('', '/')").groupBy("sku", "canonical_path").agg(F.min(F.struct("pos", "name")).alias("x"))
    return first.select("sku", "canonical_path", paths.slug(F.col("canonical_path")).alias("slug"), "x.name", "x.pos")


def legacy_category_ids(nodes: DataFrame) -> DataFrame:
    """sku and its distinct slugs in order, joined by commas."""
    firsts = nodes.groupBy("sku", "slug").agg(F.min("pos").alias("pos"))
    return firsts.groupBy("sku").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "slug"))), lambda s: s["slug"]), ",").alias("category_ids"))
