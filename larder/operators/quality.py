"""Reconciliation of a source snapshot of categories with the stored ones: one DataFrame for each kind of finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.tables import staged
from . import ledger, taxonomy


def compare(source: DataFrame, stored: DataFrame) -> DataFrame:
    """Full outer join by path; columns of either side with s_ and d_."""
    s = source.select(*(F.col(c).alias(c if c == "canonical_path" else f"s_{c}") for c in source.columns))
    d = stored.select(*(F.col(c).alias(c if c == "canonical_path" else f"d_{c}") for c in stored.columns))
    return s.withColumn("in_source", F.lit(True)).join(d.withColumn("in_stored", F.lit(True)), "canonical_path", "full_outer").na.fill(False, ["in_source", "in_stored"])


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("canonical_path").distinct().join(b.select("canonical_path"), "canonical_path", "left_anti")


def duplicate_values(rows: DataFrame, field: str) -> DataFrame:
    """Values that several rows have, with their paths; NULL and '' are no values."""
    rows = rows.where(F.coalesce(F.col(field), F.lit("")) != "")
    found = rows.groupBy(field).agg(F.sort_array(F.collect_list("canonical_path")).alias("paths")).where(F.size("paths") > 1)
    return found.select(F.col(field).alias("value"), F.array_join("paths", ",").alias("paths"))


def duplicate_paths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("canonical_path").agg(F.count("*").alias("n")).where("n > 1")


def lost_parents(stored: DataFrame) -> DataFrame:
    ids = stored.select(F.col("id").alias("parent_id"))
    return stored.where("parent_id is not null").join(ids, "parent_id", "left_anti").select("canonical_path", F.concat(F.lit("parent_id "), F.col("parent_id").cast("string"), F.lit(" does not exist")).alias("reason"))


def expected_parents(source: DataFrame, stored: DataFrame) -> DataFrame:
    """canonical_path, parent_id stored, the source's parent_path and the id that path has."""
    ids = stored.select(F.col("canonical_path").alias("parent_path"), F.col("id").alias("expected_id"))
    return stored.select("canonical_path", "parent_id").join(source.select("canonical_path", "parent_path"), "canonical_path").join(ids, "parent_path", "left")


def orphans(source: DataFrame, stored: DataFrame) -> DataFrame:
    absent = expected_parents(source, stored).where("parent_path is not null and expected_id is null")
    return lost_parents(stored).union(absent.select("canonical_path", F.concat(F.lit("source parent "), "parent_path", F.lit(" is missing from DB"))))


def parent_mismatch(source: DataFrame, stored: DataFrame) -> DataFrame:
    e = expected_parents(source, stored).where("parent_path is null or expected_id is not null")
    return e.where(~F.col("parent_id").eqNullSafe(F.col("expected_id"))).select("canonical_path", "parent_path", "expected_id", F.col("parent_id").alias("actual_id"))


def level_mismatch(source: DataFrame, stored: DataFrame) -> DataFrame:
    both = source.select("canonical_path", F.col("level").alias("source_level")).join(stored.select("canonical_path", F.col("level").alias("stored_level")), "canonical_path")
    return both.where(F.col("source_level").isNotNull() & ~F.col("source_level").eqNullSafe(F.col("stored_level")))


def below_sums(stored: DataFrame, progress: DataFrame) -> DataFrame:
    """For each path with stored paths below it, the sum over those of the stored count, else of the latest total."""
    latest = ledger.latest_progress(progress).select(F.col("canonical_path").alias("descendant_path"), "total_products")
    counts = stored.select(F.col("canonical_path").alias("descendant_path"), "product_count")
    pairs = taxonomy.path_pairs(stored).join(counts, "descendant_path").join(latest, "descendant_path", "left")
    return pairs.groupBy(F.col("ancestor_path").alias("canonical_path")).agg(F.sum(F.coalesce(F.nullif("product_count", F.lit(0)), "total_products", F.lit(0))).cast("bigint").alias("children_sum"))


def counts(source: DataFrame, stored: DataFrame, progress: DataFrame) -> DataFrame:
    """Stored categories that the source has, with source, catalogue and stored counts and what lies below."""
    latest = ledger.latest_progress(progress).select("canonical_path", F.col("total_products").alias("catalog"))
    own = stored.select("canonical_path", F.coalesce("product_count", F.lit(0)).alias("family")).join(source.select("canonical_path", F.coalesce("source_count", F.lit(0)).alias("sitemap")), "canonical_path")
    return own.join(latest, "canonical_path", "left").join(below_sums(stored, progress), "canonical_path", "left")


def empty_listing_parents(c: DataFrame) -> DataFrame:
    """Of `counts`: categories whose own listing is empty while others lie below."""
    return c.where("catalog = 0 and children_sum is not null").select("canonical_path", F.col("sitemap").alias("placeholder"), "children_sum")


def count_differences(c: DataFrame, direct: DataFrame) -> DataFrame:
    """Of `counts`: those that differ from the stored family count, the catalogue's total if there is one, else the sitemap's."""
    c = c.where("not (coalesce(catalog, -1) = 0 and children_sum is not null)")
    basis = F.when(F.col("catalog") > 0, "catalog").when(F.col("sitemap") > 0, "sitemap")
    c = c.withColumn("basis", basis).withColumn("expected", F.when(F.col("basis") == "catalog", F.col("catalog")).otherwise(F.col("sitemap"))).where("basis is not null and expected <> family")
    return c.join(direct.select("canonical_path", "direct"), "canonical_path", "left").select("canonical_path", "basis", "sitemap", F.when(F.col("basis") == "catalog", F.col("catalog")).alias("catalog"), "family", (F.col("expected") - F.col("family")).alias("difference"), F.coalesce("direct", F.lit(0)).alias("direct"))


def status_counts(progress: DataFrame) -> DataFrame:
    return ledger.latest_progress(progress).groupBy(F.lower(F.coalesce("status", F.lit("unknown"))).alias("status")).agg(F.count("*").alias("n"))


SOURCE = "canonical_path string, parent_path string, name string, slug string, level int, source_count bigint"
PROGRESS = "id bigint, canonical_path string, status string, attempt_count int, total_products bigint, products_scraped bigint, last_error string"


def audit(source: DataFrame | None, scraper: DataFrame | None, stored: DataFrame, progress: DataFrame | None = None, direct: DataFrame | None = None) -> dict[str, DataFrame]:
    """All findings and the sizes of the three sides by name. Without a source, duplicates come from the stored categories;
    without progress nothing is known of listings. What several findings read is staged once."""
    none = lambda schema: stored.sparkSession.createDataFrame([], schema)
    source, scraper = (none(SOURCE) if t is None else staged(t) for t in (source, scraper))
    stored = staged(stored)
    latest = none(PROGRESS) if progress is None else staged(ledger.latest_progress(progress))
    direct = none("canonical_path string, direct bigint") if direct is None else direct
    named = stored if source.isEmpty() else source
    c = staged(counts(source, stored, latest))
    found = {
        "missing_from_scraper": missing(source, scraper),
        "missing_from_db": missing(source, stored),
        "db_only": missing(stored, source),
        "duplicate_paths": duplicate_paths(stored),
        "duplicate_slugs": duplicate_values(named, "slug"),
        "duplicate_names": duplicate_values(named, "name"),
        "orphans": orphans(source, stored),
        "parent_mismatches": parent_mismatch(source, stored),
        "level_mismatches": level_mismatch(source, stored),
        "empty_listing_parents": empty_listing_parents(c),
        "count_differences": count_differences(c, direct),
        "unscrapable": ledger.unscrapable(latest).select("canonical_path", "status", "attempt_count", "total_products", "products_scraped", "last_error"),
    }
    return found | {f"{n}_categories": t.select("canonical_path") for n, t in (("source", source), ("scraper", scraper), ("db", stored))}


SIZES = ("source_categories", "scraper_categories", "db_categories")


def audit_from_paths(source_paths: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """The audit where the source is known by its paths alone (canonical_path): slugs follow from them, parents, levels and
    counts are unknown."""
    known = source_paths.select("canonical_path", paths.slug(F.col("canonical_path")).alias("slug"))
    source = known.select(*(F.col(f.name) if f.name in known.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.sparkSession.createDataFrame([], SOURCE).schema))
    return audit(source, source, stored)


def audit_long(findings: dict[str, DataFrame]) -> DataFrame:
    """section, key (the path or value), detail (the row as JSON) of every finding; sizes aren't findings."""
    findings = {n: df for n, df in findings.items() if n not in SIZES}
    parts = [df.select(F.lit(name).alias("section"), F.col(df.columns[0]).alias("key"), F.to_json(F.struct(*df.columns)).alias("detail")) for name, df in findings.items()]
    return reduce(DataFrame.unionByName, parts)


def summary(findings: dict[str, DataFrame]) -> DataFrame:
    """section, n: the sizes of source, scraper and database, and how many of each finding there are."""
    return reduce(DataFrame.union, (df.agg(F.lit(n).alias("section"), F.count("*").alias("n")) for n, df in findings.items()))
