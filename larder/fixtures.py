"""Views that give the driver's tables the shapes of a product catalogue.

Each view is one SELECT that Spark and DuckDB both accept, over the given tables and earlier views, so the
same definition feeds a query and its oracle and grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "fx_products": """
        SELECT p_partkey + 1 AS id, 'SKU-' || lpad(CAST(p_partkey AS varchar(20)), 7, '0') AS sku, p_name AS title,
               CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 17 = 1 THEN '' ELSE p_brand END AS brand,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS regular_price, p_retailprice AS price,
               CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 0 ELSE p_size END AS stock,
               CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_size % 7 <> 0 THEN 'in_stock'
                    WHEN p_partkey % 2 = 0 THEN 'on_backorder' ELSE 'out_of_stock' END AS stock_status,
               CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 'https://shop.example/en/' || CAST(p_partkey AS varchar(20)) || '.html' END AS url,
               m.updated_at AS updated_at
        FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS updated_at FROM lineitem GROUP BY l_partkey) m ON l_partkey = p_partkey""",
    "fx_product_paths": """
        SELECT p_partkey + 1 AS id, '/en/' || lower(p_type) || '/' AS p1,
               '/en/' || lower(p_type) || '/' || split_part(p_name, ' ', 1) || '/' AS p2,
               '/en/' || lower(p_type) || '/' || split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) || '/' AS p3
        FROM part""",
    "fx_category_paths": """
        SELECT p1 AS canonical_path, CAST(NULL AS varchar(200)) AS parent_path, 1 AS level, min(id) AS first_id FROM fx_product_paths GROUP BY p1
        UNION ALL SELECT p2, p1, 2, min(id) FROM fx_product_paths GROUP BY p2, p1 UNION ALL SELECT p3, p2, 3, min(id) FROM fx_product_paths GROUP BY p3, p2""",
    "fx_numbered_paths": """
        SELECT CAST(first_id * 101 + level AS bigint) AS id, canonical_path, parent_path, level FROM fx_category_paths""",
    "fx_categories": """
        SELECT c.id AS id, p.id AS parent_id, c.canonical_path AS canonical_path, c.parent_path AS parent_path,
               split_part(trim(BOTH '/' FROM c.canonical_path), '/', c.level + 1) AS slug,
               split_part(trim(BOTH '/' FROM c.canonical_path), '/', c.level + 1) AS name,
               c.level AS level, c.id % 31 <> 0 AS is_active, CAST(c.id % 4 AS int) AS missing_streak
        FROM fx_numbered_paths c LEFT JOIN fx_numbered_paths p ON p.canonical_path = c.parent_path""",
    "fx_product_categories": """
        SELECT f.id AS product_id, c.id AS category_id FROM fx_product_paths f JOIN fx_numbered_paths c ON c.canonical_path = f.p3 WHERE f.id % 19 <> 0
        UNION SELECT f.id, c.id FROM fx_product_paths f JOIN fx_numbered_paths c ON c.canonical_path = f.p2 WHERE f.id % 5 = 0
        UNION SELECT f.id, c.id FROM fx_product_paths f JOIN fx_numbered_paths c ON c.canonical_path = f.p1 WHERE f.id % 29 = 0""",
    "fx_images": """
        SELECT product_id, src, CAST(row_number() OVER (PARTITION BY product_id ORDER BY src) - 1 AS int) AS sort_order
        FROM (SELECT DISTINCT l_partkey + 1 AS product_id, 'https://img.example/' || CAST(l_suppkey AS varchar(20)) || '.jpg' AS src FROM lineitem) i""",
    "fx_attributes": """
        SELECT p_partkey + 1 AS product_id, 'Size' AS name, CAST(p_size AS varchar(20)) AS value, 0 AS sort_order FROM part
        UNION ALL SELECT p_partkey + 1, 'Type', CASE WHEN p_partkey % 4 = 0 THEN '   ' ELSE p_type END, 1 FROM part
        UNION ALL SELECT p_partkey + 1, 'Name', p_name, 2 FROM part WHERE p_partkey % 3 <> 0
        UNION ALL SELECT p_partkey + 1, 'Brand', CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END, 3 FROM part""",
    "fx_direct_counts": """
        SELECT c.id AS id, count(l.product_id) AS n FROM fx_numbered_paths c LEFT JOIN fx_product_categories l ON l.category_id = c.id GROUP BY c.id""",
    "fx_source_categories": """
        SELECT c.canonical_path AS canonical_path, c.parent_path AS parent_path, c.name AS name, c.slug AS slug,
               CASE WHEN c.id % 29 = 0 THEN c.level + 1 ELSE c.level END AS level,
               CASE WHEN c.id % 3 = 0 THEN 0 ELSE d.n + c.id % 2 END AS source_count
        FROM fx_categories c JOIN fx_direct_counts d ON d.id = c.id WHERE c.id % 10 <> 3""",
    "fx_db_categories": """
        SELECT c.id AS id, c.canonical_path AS canonical_path, c.name AS name, c.slug AS slug, c.level AS level, c.is_active AS is_active,
               CASE WHEN c.id % 23 = 0 THEN NULL WHEN c.id % 37 = 0 THEN CAST(999999 AS bigint) ELSE c.parent_id END AS parent_id, d.n AS product_count
        FROM fx_categories c JOIN fx_direct_counts d ON d.id = c.id WHERE c.id % 12 <> 5""",
    "fx_progress": """
        SELECT e.event_id + 1 AS id, e.user_id % 5 + 1 AS job_id, CASE e.event_id % 3 WHEN 0 THEN c.p1 WHEN 1 THEN c.p2 ELSE c.p3 END AS canonical_path,
               CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'retrying' WHEN 'click' THEN 'running' ELSE 'completed' END AS status,
               CAST(e.event_id % 3 + 1 AS int) AS attempt_count, CASE WHEN e.event_id % 4 = 0 THEN 0 ELSE e.event_id % 9 + 1 END AS total_products,
               CASE WHEN e.event_id % 4 = 0 THEN 0 WHEN e.event_id % 7 = 0 THEN e.event_id % 9 ELSE e.event_id % 9 + 1 END AS products_scraped,
               CASE WHEN e.event_type = 'error' THEN 'timeout' ELSE NULL END AS last_error, e.ts AS updated_at
        FROM (SELECT x.*, (x.event_id * 7919) % s.n + 1 AS category FROM events x CROSS JOIN (SELECT count(*) AS n FROM fx_product_paths) s) e
        JOIN fx_product_paths c ON c.id = e.category""",
    "fx_jobs": """
        SELECT o_orderkey + 1 AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'incremental' ELSE 'full' END AS job_type,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'interrupted' END AS status, o_orderdate AS started_at,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '1' MINUTE ELSE o_orderdate + INTERVAL '1' HOUR END AS heartbeat_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '2' HOUR ELSE NULL END AS finished_at,
               o_custkey % 4 AS categories_failed, o_custkey % 3 AS categories_succeeded, CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS categories_skipped,
               o_custkey % 2 AS products_failed, 0 AS discrepancies
        FROM orders""",
    "fx_legacy_refs": """
        SELECT f.id AS product_id, CASE f.id % 5 WHEN 0 THEN CAST(c.id AS varchar(20)) WHEN 1 THEN f.p3 WHEN 2 THEN 'economy, nope' WHEN 3 THEN 'ring,standard'
               ELSE upper(split_part(f.p1, '/', 3)) END AS refs
        FROM fx_product_paths f JOIN fx_numbered_paths c ON c.canonical_path = f.p3""",
    "fx_batch": """
        SELECT p.id AS id, CASE WHEN p.id % 5 = 0 THEN CAST(p.id AS varchar(20)) ELSE p.sku END AS k, p.title AS title, p.brand AS brand, p.price AS price, p.regular_price AS regular_price,
               p.stock AS stock, f.p2 AS p2, CASE WHEN n.p2 <> f.p2 THEN n.p2 ELSE NULL END AS stale
        FROM fx_products p JOIN fx_product_paths f ON f.id = p.id LEFT JOIN fx_product_paths n ON n.id = p.id + 1""",
    "fx_incoming_products": """
        SELECT CAST((l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey AS bigint) AS seq,
               'SKU-' || lpad(CAST(CASE WHEN l_partkey % 40 = 0 THEN l_partkey + 9000000 ELSE l_partkey END AS varchar(20)), 7, '0') AS sku,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 4 = 0 THEN '' ELSE 'New ' || l_returnflag END AS title,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_extendedprice END AS price,
               CASE WHEN l_suppkey % 6 = 0 THEN l_extendedprice ELSE NULL END AS regular_price,
               CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_quantity AS int) END AS stock
        FROM lineitem""",
}


def needed(sql: str) -> list[str]:
    """The views that a statement uses, directly or through others, in order of definition."""
    todo, found = [sql], set()
    while todo:
        for name in re.findall(r"\bfx_\w+", todo.pop()):
            if name in VIEWS and name not in found:
                found.add(name)
                todo.append(VIEWS[name])
    return [v for v in VIEWS if v in found]


def oracle(sql: str) -> str:
    """The statement with its views as common table expressions."""
    ctes = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed(sql))
    rest = re.match(r"\s*WITH(\s+RECURSIVE)?\s+(.*)", sql, re.S | re.I)
    if not ctes:
        return sql
    return f"WITH {'RECURSIVE ' if rest and rest[1] else ''}{ctes}, {rest[2]}" if rest else f"WITH {ctes} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view as a DataFrame. known: views that are there already."""
    if known and name in known:
        return known[name]
    sql = VIEWS[name]
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b(?!\.)", sql)}
    args |= {v: view(spark, sf_dir, v, known) for v in dict.fromkeys(re.findall(r"\bfx_\w+", sql))}
    for n in args:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    used = {n: d for n, d in args.items() if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


def raw_products(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """fx_products as supplier JSON in the shapes that occur: id, body."""
    from pyspark.sql import functions as F

    p = view(spark, sf_dir, "fx_products", known).join(view(spark, sf_dir, "fx_product_paths"), "id")
    when = lambda n, k, c: F.when(F.col("id") % n == k, c)
    pairs = F.struct(F.col("title").alias("Name:"), F.lit("Some &amp; such").alias("Note"), F.lit("x").alias("Share this"))

    def q(c):
        """A string as JSON, NULL for NULL."""
        j = F.to_json(F.struct(c.alias("v")))
        return F.when(c.isNotNull(), j.substr(F.lit(6), F.length(j) - 6))

    listed = F.concat(F.lit('[{"name":"name ","value":"second"},{"label":"Size","text":'), q(F.col("sku")), F.lit("}]"))

    def member(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))

    level = F.col("stock").cast("string")
    body = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",", member("id", F.col("id").cast("string")), member("sku", when(5, 0, F.lit(None).cast("string")).otherwise(q(F.col("sku")))), member("title", q(F.col("title"))),
            member("price", when(3, 0, F.concat(F.lit('{"amount":'), F.col("price").cast("string"), F.lit("}"))).otherwise(F.col("price").cast("string"))),
            member("brand", when(2, 0, F.concat(F.lit('{"name":'), q(F.coalesce("brand", F.lit(""))), F.lit("}"))).otherwise(q(F.coalesce("brand", F.lit(""))))),
            member("stock", when(4, 0, F.concat(F.lit('{"level":'), F.coalesce(level, F.lit("null")), F.lit("}"))).when(F.col("id") % 4 == 1, q(F.translate(F.col("stock_status"), "_", " ")))),
            member("variants", when(4, 2, F.concat(F.lit('{"7":{"stock":{"level":'), F.coalesce(level, F.lit('"?"')), F.lit('}},"3":{"stock_level":"1"}}')))),
            member("url", when(2, 0, q(F.concat(F.lit("p/"), F.col("id").cast("string"), F.lit(".html")))).otherwise(q(F.col("url")))),
            member("description", when(5, 1, q(F.concat(F.lit("Plain &amp; text of "), F.col("id").cast("string"))))),
            member("content", F.coalesce(when(3, 2, q(F.concat(F.lit("<p>Intro paragraph of product "), F.col("id").cast("string"), F.lit("</p><h3>Features</h3><p>Good</p>")))), when(3, 1, q(F.concat(F.lit("<table><tr><td>Weight</td><td>late</td></tr><tr><td>Code</td><td>C"), F.col("id").cast("string"), F.lit("</td></tr></table><h3>Technical data</h3><ul><li>Power: "), F.col("id").cast("string"), F.lit(" W</li></ul>")))))),
            F.lit('"image":"77","images":[{"url":"/a.jpg"},"/a.jpg",{"src":"https://img.example/b.jpg"},{}]'),
            member("attributes", when(2, 0, F.to_json(pairs)).otherwise(listed)),
            F.concat(F.lit('"specs":{"9":{"title":"Weight:","value":"'), F.col("id").cast("string"), F.lit(' g"},"1":{"title":"","value":"none"}}')),
            F.concat(F.lit('"categories":{"2":{"url":"'), F.expr("substring(p2, 5)"), F.lit('","title":"Two"},"1":{"url":"'), F.expr("substring(p1, 5)"), F.lit('","title":"One"}}')),
        ),
        F.lit("}"),
    )
    return p.select("id", when(3, 0, F.concat(F.lit('{"product":'), body, F.lit("}"))).otherwise(body).alias("body"))


def listing_pages(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """fx_products as listing pages of ten for each middle category: canonical_path, page, body. Every 13th category
    repeats its last page, every 17th declares one product too many; every fifth product has no code."""
    from pyspark.sql import functions as F

    c = view(spark, sf_dir, "fx_categories", known).select(F.col("canonical_path").alias("p2"), F.col("id").alias("cid"))
    p = view(spark, sf_dir, "fx_products", known).join(view(spark, sf_dir, "fx_product_paths").select("id", "p2"), "id").join(c, "p2")
    p = p.withColumn("page", F.expr("CAST((row_number() OVER (PARTITION BY p2 ORDER BY id) - 1) DIV 10 + 1 AS bigint)")).withColumn("total", F.expr("count(*) OVER (PARTITION BY p2) + IF(cid % 17 = 0, 1, 0)"))
    item = F.struct(F.col("id"), F.when(F.col("id") % 5 != 0, F.col("sku")).alias("code"), F.col("title"), F.struct(F.col("price").alias("price")).alias("price"))
    pages = p.groupBy("p2", "cid", "page", "total").agg(F.sort_array(F.collect_list(item)).alias("items"))
    last = F.expr("max(page) OVER (PARTITION BY p2)")
    pages = pages.withColumn("last", last)
    pages = pages.withColumn("page", F.explode(F.when((F.col("cid") % 13 == 0) & (F.col("page") == F.col("last")), F.array("page", F.col("page") + 1)).otherwise(F.array("page"))))
    listed = F.when(F.col("page") % 2 == 0, F.to_json("items")).otherwise(F.to_json(F.map_from_entries(F.transform("items", lambda i: F.struct(i["id"].cast("string"), i)))))
    text = lambda c: F.col(c).cast("string")
    inner = F.concat(F.lit('{"count":'), text("total"), F.lit(',"page":'), text("page"), F.lit(',"limit":10,"products":'), listed, F.lit("}"))
    flat = F.concat(F.lit('{"total":'), text("total"), F.lit(',"page":'), text("page"), F.lit(',"limit":10,"products":'), listed, F.lit("}"))
    body = F.when(F.col("cid") % 3 == 0, F.concat(F.lit('{"collection":'), inner, F.lit("}"))).when(F.col("cid") % 3 == 1, F.concat(F.lit('{"catalog":'), inner, F.lit("}"))).otherwise(flat)
    return pages.select(F.col("p2").alias("canonical_path"), "page", body.alias("body"))


def stored_links(f: DataFrame) -> DataFrame:
    """fx_batch -> links as stored before a batch: to a path that no source has, to the listed path, to a neighbour's path."""
    from pyspark.sql import functions as F

    paths = F.filter(F.array(F.when(F.col("id") % 5 == 0, F.lit("/en/none/")), F.when(F.col("id") % 6 == 0, F.col("p2")), F.when(F.col("id") % 7 == 0, F.col("stale"))), lambda p: p.isNotNull())
    return f.select(F.col("k").alias("sku"), F.explode(paths).alias("canonical_path")).distinct()


def batch(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A supplier's batch over stored tables: products, categories and links before it (stored_), source categories, listing
    pages and documents. Every 41st document has a price that is no number, every 43rd is missing."""
    from pyspark.sql import functions as F

    from .sources.tables import staged

    known = {"fx_products": staged(view(spark, sf_dir, "fx_products").drop("updated_at"))}  # four results read it
    for name in ("fx_numbered_paths", "fx_categories"):  # small, and each table of the batch would work them out anew
        known[name] = staged(view(spark, sf_dir, name, known))
    f = view(spark, sf_dir, "fx_batch", known)
    broken = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"sku":"'), F.col("k"), F.lit('","price":"dear"}'))
    raw = raw_products(spark, sf_dir, known).join(f.select("id", "k", "p2"), "id").where("id % 41 = 0 or id % 43 <> 0")
    return {
        "stored_products": f.where("id % 3 <> 0").select(F.col("k").alias("sku"), "title", "brand", "price", "stock", "regular_price"),
        "stored_categories": view(spark, sf_dir, "fx_categories", known),
        "stored_links": stored_links(f),
        "snapshot": view(spark, sf_dir, "fx_source_categories", known),
        "pages": listing_pages(spark, sf_dir, known),
        "raw": raw.select(F.when(F.col("id") % 41 == 0, broken).otherwise(F.col("body")).alias("body"), F.col("p2").alias("canonical_path")),
    }
