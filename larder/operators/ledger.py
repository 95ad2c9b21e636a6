"""Runs and their progress rows: latest state, resume plans, health, counters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_progress(progress: DataFrame) -> DataFrame:
    """The row of highest id for each path: an aggregate that combines before the shuffle."""
    fields = [c for c in progress.columns if c != "canonical_path"]
    return progress.groupBy("canonical_path").agg(F.max_by(F.struct(*fields), "id").alias("x")).select("canonical_path", *(F.col(f"x.{f}").alias(f) for f in fields))


def incomplete(categories: DataFrame, progress: DataFrame) -> DataFrame:
    """Categories without a completed row."""
    return categories.join(progress.where("status = 'completed'"), "canonical_path", "left_anti")


def resume_plan(categories: DataFrame, progress: DataFrame) -> DataFrame:
    """canonical_path, pending, and how often the category was completed before."""
    done = progress.where("status = 'completed'").groupBy("canonical_path").agg(F.count("*").alias("checkpoints"))
    return categories.select("canonical_path").join(done, "canonical_path", "left").select("canonical_path", F.col("checkpoints").isNull().alias("pending"), F.coalesce("checkpoints", F.lit(0)).alias("checkpoints"))


def unscrapable(progress: DataFrame) -> DataFrame:
    """Latest rows that failed, wait for a retry, or completed with fewer products than were found."""
    short = (F.col("status") == "completed") & (F.col("total_products") > 0) & (F.col("products_scraped") < F.col("total_products"))
    return latest_progress(progress).where(F.lower("status").isin("failed", "retrying") | short)


def run_status(failed: Column, succeeded: Column, skipped: Column, products_failed: Column, discrepancies: Column) -> Column:
    return F.when(failed + skipped + products_failed + discrepancies == 0, "SUCCESS").when((succeeded == 0) & ((failed > 0) | (skipped > 0)), "FAILED").otherwise("PARTIAL_SUCCESS")


def stale_runs(jobs: DataFrame, as_of: datetime, seconds: int) -> DataFrame:
    """Running jobs whose last sign of life is missing or older than `seconds` before as_of."""
    sign = F.coalesce("heartbeat_at", "started_at")
    return jobs.where((F.col("status") == "running") & (sign.isNull() | (sign < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds)))))


def resumable_runs(jobs: DataFrame) -> DataFrame:
    """For each type of job what asking for a run does: already_running if any type runs, else resumed or created."""
    by_type = jobs.groupBy("job_type").agg(F.max(F.when(F.col("status") == "interrupted", F.col("id"))).alias("interrupted"))
    running = jobs.where("status = 'running'").agg(F.max("id").alias("running"))
    joined = by_type.crossJoin(running)  # one row
    return joined.select("job_type", F.when(F.col("running").isNotNull(), "already_running").when(F.col("interrupted").isNotNull(), "resumed").otherwise("created").alias("action"), F.coalesce("running", "interrupted").alias("run_id"))


def upsert_progress(current: DataFrame, selected: DataFrame) -> DataFrame:
    """current (canonical_path, status, attempt_count), selected (canonical_path): completed rows stay, others are discovered anew."""
    both = current.join(selected.withColumn("asked", F.lit(True)), "canonical_path", "full_outer")
    again = F.coalesce("asked", F.lit(False)) & ~(F.coalesce("status", F.lit("")) == "completed")
    return both.select("canonical_path", F.when(again, "discovered").otherwise(F.col("status")).alias("status"), F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"))


def category_state(categories: DataFrame, progress: DataFrame) -> DataFrame:
    """Status, attempts, error and source count of each category from its latest row; a catalogue total wins over the sitemap's."""
    last = latest_progress(progress).select("canonical_path", "status", "attempt_count", "last_error", "total_products")
    return categories.join(last, "canonical_path", "left").select("canonical_path", F.coalesce("status", F.lit("discovered")).alias("scrape_status"), F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), "last_error", F.coalesce(F.when(F.col("total_products") > 0, F.col("total_products")), "source_count").alias("source_count"))


def run_counters(progress: DataFrame) -> DataFrame:
    """Outcome counts of each run, by its latest row for each path."""
    last = progress.groupBy("job_id", "canonical_path").agg(F.max_by(F.struct("status", "total_products", "products_scraped"), "id").alias("x"))
    return last.groupBy("job_id").agg(F.count_if(F.col("x.status") == "completed").alias("succeeded"), F.count_if(F.col("x.status") == "failed").alias("failed"), F.count_if(~F.col("x.status").isin("completed", "failed")).alias("skipped"), F.sum("x.total_products").alias("listed"), F.sum("x.products_scraped").alias("scraped"))


def finalize_runs(progress: DataFrame) -> DataFrame:
    counters = run_counters(progress)
    return counters.withColumn("job_status", run_status(F.col("failed"), F.col("succeeded"), F.col("skipped"), F.lit(0), (F.col("listed") > F.col("scraped")).cast("int")))


def batch_counters(products: DataFrame, rejects: DataFrame, status: DataFrame, pages: DataFrame, discrepancies: DataFrame) -> DataFrame:
    """One row for a batch: merged products (is_new, touched), rejected documents, listing status, listing pages and categories
    whose count differs from the source's -> distinct products in total, new, updated and failed, categories by outcome,
    pages, discrepancies, and the run's status."""
    a = products.where("touched").agg(F.count("*").alias("products_total"), F.count_if("is_new").alias("products_new"), F.count_if(~F.col("is_new")).alias("products_updated"))
    b = rejects.agg(F.count_distinct(F.coalesce("key", "body")).alias("products_failed"))
    done = F.col("status") == "complete"
    c = status.agg(F.count_if(done).alias("categories_succeeded"), F.count_if(~done).alias("categories_failed"))
    d, e = pages.agg(F.count("*").alias("pages_fetched")), discrepancies.agg(F.count("*").alias("category_discrepancies"))
    out = a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)  # rows of one
    return out.withColumn("job_status", run_status(F.col("categories_failed"), F.col("categories_succeeded"), F.lit(0), F.col("products_failed"), F.col("category_discrepancies")))


# What a run's summary tells.
SUMMARY = (
    "categories_succeeded", "categories_failed", "products_total", "products_new", "products_updated", "products_failed", "links_created", "links_existing", "links_removed",
    "pages_fetched", "category_discrepancies", "job_status",
)


def run_summary(run: DataFrame) -> DataFrame:
    """A run's counters and status packed as JSON, in one column: summary."""
    return run.select(F.to_json(F.struct(*SUMMARY)).alias("summary"))


def health_windows(samples: DataFrame, minutes: int = 60) -> DataFrame:
    """Samples (ts, user_id) counted by window and source; works on streams with a watermark too."""
    return samples.groupBy(F.window("ts", f"{minutes} minutes"), "user_id").agg(F.count("*").alias("samples")).select(F.col("window.start").alias("start"), "user_id", "samples")
