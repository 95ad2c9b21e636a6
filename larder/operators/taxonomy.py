"""The category tree: closure, roll-up counts, lookups, nesting.

Categories are the small side (thousands of rows for millions of products), yet nothing here assumes it:
joins carry no broadcast hints, so Spark broadcasts a side only when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.tables import staged


def closure(categories: DataFrame) -> DataFrame:
    """categories (id, parent_id) -> ancestor_id, descendant_id, distance; each category is its own ancestor at 0.

    One join a level until no path grows; a path that meets itself stops, so cycles end. Each level is staged, so
    none is computed twice. Driver values are the level and one emptiness test.
    """
    known = staged(categories.select("id", "parent_id"))
    up = known.select(F.col("id").alias("child"), F.col("parent_id").alias("up")).join(known.select(F.col("id").alias("up")), "up", "left_semi")
    step = known.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.array("id").alias("seen"))
    out = step
    while True:
        grown = step.join(up, F.col("ancestor_id") == F.col("child")).where(~F.array_contains("seen", F.col("up")))
        step = staged(grown.select(F.col("up").alias("ancestor_id"), "descendant_id", F.concat("seen", F.array("up")).alias("seen")))
        if step.isEmpty():
            break
        out = out.union(step)
    return out.select("ancestor_id", "descendant_id", (F.size("seen") - 1).cast("bigint").alias("distance"))


def path_pairs(categories: DataFrame) -> DataFrame:
    """ancestor_path, descendant_path for every known path above another: an equi-join over exploded ancestors."""
    below = categories.select(F.col("canonical_path").alias("descendant_path"), F.explode(paths.ancestors(F.col("canonical_path"))).alias("ancestor_path")).where("ancestor_path <> descendant_path")
    return below.join(categories.select(F.col("canonical_path").alias("ancestor_path")).distinct(), "ancestor_path", "left_semi").select("ancestor_path", "descendant_path")


def direct_counts(categories: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct products linked to each category itself; every category is present."""
    counts = links.distinct().groupBy("category_id").agg(F.count("*").alias("n"))
    return categories.select("id").join(counts, F.col("id") == F.col("category_id"), "left").select(F.col("id").alias("category_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("product_count"))


def family_counts(categories: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct products linked to each category or to any below it. Pairs are deduplicated before counting, so the
    count is a partial aggregate, and a root with all products is spread over tasks."""
    pairs = closure(categories).join(links, F.col("descendant_id") == F.col("category_id")).select(F.col("ancestor_id").alias("id"), "product_id").distinct()
    counts = pairs.groupBy("id").agg(F.count("*").alias("n"))
    return categories.select("id").join(counts, "id", "left").select(F.col("id").alias("category_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("product_count"))


def descendants(categories: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (id) -> id of each chosen category and of all below it: one join a level from the chosen ones down, so the
    work follows what lies below them. Categories found before aren't followed again, so cycles end."""
    known = staged(categories.select("id", "parent_id"))
    found = level = staged(known.join(chosen.select("id"), "id", "left_semi").select("id").distinct())
    while True:
        below = known.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").distinct()
        level = staged(below.join(found, "id", "left_anti"))
        if level.isEmpty():
            return found
        found = found.union(level)


def resolve_parents(categories: DataFrame) -> DataFrame:
    """categories (id, canonical_path, parent_path) -> id, parent_id; a root or a missing parent gives NULL."""
    up = categories.select(F.col("canonical_path").alias("parent_path"), F.col("id").alias("parent_id"))
    return categories.select("id", "parent_path").join(up, "parent_path", "left").select("id", "parent_id")


def resolve_category(keys: DataFrame, categories: DataFrame) -> DataFrame:
    """keys (key) -> key, category_id, matched_by: by id, else by path, else by slug (the lowest id), else NULL."""
    by_id = categories.select(F.col("id").cast("string").alias("key"), F.col("id").alias("a"))
    by_path = categories.select(F.col("canonical_path").alias("key"), F.col("id").alias("b"))
    by_slug = categories.groupBy(F.col("slug").alias("key")).agg(F.min("id").alias("c"))
    found = keys.join(by_id, "key", "left").join(by_path, "key", "left").join(by_slug, "key", "left")
    return found.select("key", F.coalesce("a", "b", "c").alias("category_id"), F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "path").when(F.col("c").isNotNull(), "slug").alias("matched_by"))


def resolve_legacy_refs(products: DataFrame, categories: DataFrame) -> DataFrame:
    """products (product_id, refs: comma-separated) -> product_id, ref, category_id, state (linked, unresolved, ambiguous)."""
    refs = products.select("product_id", F.explode(F.transform(F.split("refs", ","), lambda r: F.trim(r))).alias("ref")).where("ref <> ''").withColumn("low", F.lower("ref"))
    by_id = categories.select(F.col("id").cast("string").alias("ref"), F.col("id").alias("a"))
    by_path = categories.groupBy(F.lower("canonical_path").alias("low")).agg(F.max("id").alias("b"))
    by_slug = categories.groupBy(F.lower(F.coalesce("slug", F.lit(""))).alias("low")).agg(F.min("id").alias("c"), F.count("*").alias("n"))
    found = refs.join(by_id, "ref", "left").join(by_path, "low", "left").join(by_slug, "low", "left")
    sure = F.coalesce("a", "b", F.when(F.col("n") == 1, F.col("c")))
    return found.select("product_id", "ref", sure.alias("category_id"), F.when(sure.isNotNull(), "linked").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("state"))


def tree_rows(categories: DataFrame) -> DataFrame:
    """id, root_id, depth, path (ids from the root down); a category whose parent is unknown is a root."""
    up = closure(categories).groupBy("descendant_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("ancestor_id").alias("a")))).alias("x"))
    return up.select(F.col("descendant_id").alias("id"), F.col("x")[0]["a"].alias("root_id"), F.size("x").cast("bigint").alias("depth"), F.transform("x", lambda s: s["a"]).alias("path"))


def nested_tree(categories: DataFrame) -> DataFrame:
    """One JSON document for each root, children nested in order of name and id; levels are built from the leaves up."""
    rows = tree_rows(categories).join(categories.select("id", "parent_id", "name", "slug", "canonical_path"), "id")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below = None
    for depth in range(deepest, 0, -1):
        own = rows.where(F.col("depth") == depth)
        if below is None:
            own = own.withColumn("children", F.lit("[]"))
        else:
            own = own.join(below, own.id == below.parent, "left").withColumn("children", F.coalesce("kids", F.lit("[]")))
        head = F.to_json(F.struct("id", "name", "slug", "canonical_path"))
        own = own.withColumn("node", F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"children":'), F.col("children"), F.lit("}")))
        if depth == 1:
            return own.select(F.col("id").alias("root_id"), "node")
        below = own.groupBy(F.col("parent_id").alias("parent")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "id", "node"))), lambda s: s["node"]), ","), F.lit("]")).alias("kids"))
    return categories.sparkSession.createDataFrame([], "root_id bigint, node string")


def with_ancestors(categories: DataFrame, chosen: Column) -> DataFrame:
    """Categories that match, and all above them by path."""
    wanted = categories.where(chosen).select(F.explode(paths.ancestors(F.col("canonical_path"))).alias("canonical_path")).distinct()
    return categories.join(wanted, "canonical_path", "left_semi")


def matching_tokens(categories: DataFrame, tokens: list[str]) -> DataFrame:
    """Categories whose path contains a token or whose slug is one. No tokens keep all."""
    if not tokens:
        return categories
    words = F.array(*(F.lit(t) for t in tokens))
    return categories.where(F.exists(words, lambda t: F.contains(F.col("canonical_path"), t) | (F.col("slug") == t)))
