"""Whole batches, streams and change feeds as queries, each with its SQL. Streams land the given tables in lots, and stop
and start again between them."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import batch, raw_products, view
from .operators import extract, feed, ledger, merge
from .plans.ingest import ingest
from .queries import BASE, CDN, DEDUPED_SPECS, IMAGES, LEGACY_IDS, ORACLE_SQL, SKU, STATUS, STOCK, URL, query
from .sources.snapshots import SnapshotStore
from .sources.tables import measured_broadcasts, shared_folder, spread, staged
from .streaming import catalogue as streams


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, folder: str) -> str:
    df.write.mode("append").parquet(folder)
    return folder


# whole batches; the oracle reads the columns that listings and documents were made from

B = f"(SELECT f.*, p.url, {STOCK.replace('id %', 'f.id %').replace('stock', 'p.stock')} AS s, x.st, x.u, g.category_ids AS ids, f.id % 41 = 0 AS bad, f.id % 41 = 0 OR f.id % 43 = 0 AS fallback FROM fx_batch f JOIN fx_products p ON p.id = f.id JOIN (SELECT id AS i, {STATUS} AS st, {URL} AS u FROM fx_products) x ON x.i = f.id JOIN ({LEGACY_IDS}) g ON g.sku = f.k)"
TEXT = "CASE WHEN fallback THEN NULL WHEN id % 3 = 2 THEN 'Intro paragraph of product ' || CAST(id AS varchar) WHEN id % 5 = 1 THEN 'Plain & text of ' || CAST(id AS varchar) END"
INGESTED = f"""SELECT k AS sku, title, CASE WHEN NOT fallback AND nullif(brand, '') IS NOT NULL THEN brand WHEN id % 3 <> 0 THEN brand END AS brand, price,
    CASE WHEN fallback THEN CASE WHEN id % 3 <> 0 THEN stock END ELSE coalesce(s, CASE WHEN id % 3 <> 0 THEN stock END) END AS stock, price AS regular_price, CAST(id AS varchar) AS product_id, CAST(NULL AS varchar) AS ean,
    CASE WHEN NOT fallback THEN st END AS stock_status, 'EUR' AS currency, CASE WHEN NOT fallback THEN u END AS url,
    {TEXT} AS description, {TEXT} AS short_description, CASE WHEN NOT fallback AND id % 3 = 2 THEN '<h3>Features</h3><p>Good</p>' END AS long_description, CASE WHEN NOT fallback THEN ids END AS category_ids FROM {B} b"""
CID = "(SELECT f.k, f.id, f.p2, f.id % 41 = 0 AS bad, c.id AS cid FROM fx_batch f JOIN fx_categories c ON c.canonical_path = f.p2)"
LISTING = f"""SELECT p2 AS canonical_path, count(*) + max(CASE WHEN cid % 17 = 0 THEN 1 ELSE 0 END) AS list_total, count(*) AS unique_listed, count(*) FILTER (WHERE bad) AS failed,
    CASE WHEN max(cid) % 13 = 0 OR max(cid) % 17 = 0 OR count(*) FILTER (WHERE bad) > 0 THEN 'incomplete' ELSE 'complete' END AS status,
    CASE WHEN max(cid) % 13 = 0 THEN 'repeated page' WHEN max(cid) % 17 = 0 THEN 'count differs' WHEN count(*) FILTER (WHERE bad) > 0 THEN 'failed details' ELSE '' END AS reason FROM {CID} c GROUP BY p2"""
STORED_LINKS = "(SELECT DISTINCT * FROM (SELECT k AS sku, '/en/none/' AS canonical_path FROM fx_batch WHERE id % 5 = 0 UNION ALL SELECT k, p2 FROM fx_batch WHERE id % 6 = 0 UNION ALL SELECT k, stale FROM fx_batch WHERE id % 7 = 0 AND stale IS NOT NULL) o)"
GONE_LINKS = f"(SELECT o.* FROM {STORED_LINKS} o JOIN ({LISTING}) t ON t.canonical_path = o.canonical_path AND t.status = 'complete' WHERE (o.sku, o.canonical_path) NOT IN (SELECT (k, p2) FROM fx_batch))"
LINKS = f"SELECT sku, canonical_path FROM (SELECT * FROM {STORED_LINKS} o UNION SELECT k, p2 FROM fx_batch) a WHERE (sku, canonical_path) NOT IN (SELECT (sku, canonical_path) FROM {GONE_LINKS} g)"
COUNTS = f"SELECT c.canonical_path, count(DISTINCT l.sku) AS product_count FROM fx_categories c LEFT JOIN ({LINKS}) l ON starts_with(l.canonical_path, c.canonical_path) GROUP BY c.canonical_path"
RUN = f"""SELECT *, CASE WHEN categories_failed + products_failed + category_discrepancies = 0 THEN 'SUCCESS' WHEN categories_succeeded = 0 AND categories_failed > 0 THEN 'FAILED' ELSE 'PARTIAL_SUCCESS' END AS job_status FROM
    (SELECT count(*) AS products_total, count(*) FILTER (WHERE id % 3 = 0) AS products_new, count(*) FILTER (WHERE id % 3 <> 0) AS products_updated, count(*) FILTER (WHERE id % 41 = 0) AS products_failed FROM fx_batch) a,
    (SELECT count(*) FILTER (WHERE status = 'complete') AS categories_succeeded, count(*) FILTER (WHERE status <> 'complete') AS categories_failed FROM ({LISTING}) t) b,
    (SELECT CAST(sum((n + 9) // 10 + CASE WHEN cid % 13 = 0 THEN 1 ELSE 0 END) AS bigint) AS pages_fetched FROM (SELECT cid, count(*) AS n FROM {CID} c GROUP BY cid) x) c,
    (SELECT count(*) AS category_discrepancies FROM ({COUNTS}) n JOIN fx_source_categories s ON s.canonical_path = n.canonical_path WHERE s.source_count <> 0 AND s.source_count <> n.product_count) d,
    (SELECT count(*) FILTER (WHERE o.sku IS NULL) AS links_created, count(*) FILTER (WHERE o.sku IS NOT NULL) AS links_existing FROM fx_batch f LEFT JOIN {STORED_LINKS} o ON o.sku = f.k AND o.canonical_path = f.p2) e,
    (SELECT count(*) AS links_removed FROM {GONE_LINKS} g) h"""


def ingested(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    b = batch(spark, sf_dir)
    stored = {"products": b["stored_products"], "categories": b["stored_categories"], "links": b["stored_links"]}
    return ingest(stored, b["snapshot"], lambda: staged(spread(b["pages"])), staged(spread(b["raw"].select("body"))), BASE, CDN)


def ingest_query(name: str, table: str, sql: str, f=lambda df: df) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with measured_broadcasts(spark):
            return staged(f(ingested(spark, sf_dir)[table]))

    query(name, sql)(run)


GOOD = "id IN (SELECT id FROM fx_products WHERE id % 41 <> 0 AND id % 43 <> 0)"
ingest_query("ingest_run", "products", INGESTED.replace(" FROM (SELECT f.*", ", id % 3 = 0 AS is_new, true AS touched FROM (SELECT f.*", 1))
ingest_query("ingest_links", "links", LINKS)
ingest_query("ingest_listing_status", "listing_status", LISTING)
ingest_query("ingest_counts", "counts", COUNTS)
ingest_query("ingest_images", "images", f"{IMAGES} WHERE {GOOD}")
ingest_query("ingest_attributes", "attributes", DEDUPED_SPECS.replace("FROM fx_products", f"FROM (SELECT * FROM fx_products WHERE {GOOD}) fx_good"))
ingest_query("ingest_rejects", "rejects", "SELECT k AS \"key\", 'price is no number' AS error FROM fx_batch WHERE id % 41 = 0", lambda r: r.select("key", "error"))
ingest_query("ingest_run_row", "run", RUN)
ingest_query("ingest_run_summary", "run", f"SELECT CAST(to_json({{{', '.join(f'{c!r}: {c}' for c in ledger.SUMMARY)}}}) AS varchar) AS summary FROM ({RUN}) r", ledger.run_summary)


RECORDS = f"""SELECT CAST(p.id AS varchar) AS product_id, {SKU.replace('id %', 'p.id %').replace('(id', '(p.id')} AS sku, {TEXT.replace('fallback', 'false').replace('id %', 'p.id %').replace('(id', '(p.id')} AS short_description, g.category_ids,
    (SELECT CAST(to_json(list({{'url': i.url, 'sort_order': i.sort_order, 'is_cover': i.is_cover}} ORDER BY i.sort_order)) AS varchar) FROM ({IMAGES}) i WHERE i.sku = g.sku) AS images,
    (SELECT CAST(to_json(list({{'name': i.name, 'value': i.value, 'sort_order': i.sort_order}} ORDER BY i.sort_order)) AS varchar) FROM ({DEDUPED_SPECS}) i WHERE i.sku = g.sku) AS specifications
    FROM fx_products p JOIN ({LEGACY_IDS}) g ON g.sku = {SKU.replace('id %', 'p.id %').replace('(id', '(p.id').replace('ELSE sku', 'ELSE p.sku')}""".replace("ELSE sku END AS sku, CASE WHEN false", "ELSE p.sku END AS sku, CASE WHEN false")


@query("product_records", RECORDS)
def product_records(spark, sf_dir):
    """Whole records of the documents, nested children as JSON."""
    found, _ = extract.records(staged(spread(raw_products(spark, sf_dir))), BASE, CDN)
    return found.select("product_id", "sku", "short_description", "category_ids", F.to_json("images").alias("images"), F.to_json("specifications").alias("specifications"))


# streams


@query("stream_upsert_products")
def stream_upsert_products(spark, sf_dir):
    """Stored products, then two lots of landed rows, each merged into the next version."""
    folder = fresh(spark, "upserts")
    store, incoming = SnapshotStore(spark, f"{folder}/store"), staged(view(spark, sf_dir, "fx_incoming_products"))
    streams.seed(store, {"products": view(spark, sf_dir, "fx_products").select("sku", "title", "brand", "price", "stock", "regular_price")})
    for half in (0, 1):
        land(incoming.where(F.floor(F.col("seq") / 100) % 2 == half), f"{folder}/landed")
        landed = spark.readStream.schema(incoming.schema).parquet(f"{folder}/landed")
        streams.stream_upsert_products(landed, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return store.read("products")


# every other hundred comes first here, so the oracle orders by batch and then by seq
ORACLE_SQL["stream_upsert_products"] = ORACLE_SQL["upsert_products"].replace(", p.sku IS NULL AS is_new, i.sku IS NOT NULL AS touched", "").replace(", seq)", ", (seq // 100) % 2 * 1000000000000000 + seq)")


def stream_ingested(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """The batch in two lots: categories with paths of even length, then the others, with their listings and documents."""
    folder = fresh(spark, "ingests")
    store = SnapshotStore(spark, f"{folder}/store")
    with measured_broadcasts(spark):
        b = batch(spark, sf_dir)
        streams.seed(store, {"products": b["stored_products"], "links": b["stored_links"], "categories": b["stored_categories"]})
        kinds = {"category": b["snapshot"], "listing": b["pages"], "product": b["raw"]}
        schema = spark.createDataFrame([], streams.LANDED).schema
        rows = [df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items()]
        rows = [df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)) for df in rows]
        landed = staged(rows[0].union(rows[1]).union(rows[2]))
        for lot in (0, 1):
            land(landed.where(F.length("canonical_path") % 2 == lot), f"{folder}/landed")
            streams.stream_ingest(spark.readStream.schema(schema).parquet(f"{folder}/landed"), f"{folder}/store", f"{folder}/checkpoint", BASE, CDN).awaitTermination()
    return store


query("stream_ingest_products", INGESTED)(lambda spark, sf_dir: stream_ingested(spark, sf_dir).read("products"))
query("stream_ingest_links", LINKS)(lambda spark, sf_dir: stream_ingested(spark, sf_dir).read("links"))
query("stream_ingest_counts", COUNTS)(lambda spark, sf_dir: stream_ingested(spark, sf_dir).read("counts"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("stream_dedupe_listings", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_dedupe_listings(spark, sf_dir):
    """A user's events of one kind and day count once. The second lot repeats rows of the first within the watermark; the
    third comes too late, so its unknown users are dropped."""
    rows = staged(events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")))
    middle = F.to_timestamp(F.lit("2024-01-16"))
    first, again = rows.where(F.col("ts") < middle), rows.where((F.col("ts") < middle) & (F.col("ts") >= middle - F.expr("INTERVAL 12 HOURS")))
    late = rows.where(F.col("ts") < F.to_timestamp(F.lit("2024-01-04"))).withColumn("user_id", F.col("user_id") + 1_000_000_000)
    folder = fresh(spark, "listings")
    for lot in (first, rows.where(F.col("ts") >= middle).union(again), late):
        land(lot, f"{folder}/landed")
        items = streams.stream_dedupe_listings(spark.readStream.schema(rows.schema).parquet(f"{folder}/landed"), "1 day", ("user_id", "event_type", "day"))
        streams.until_used_up(items, streams.append_to(f"{folder}/out"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type", "day")


@query(
    "stream_missing_streak",
    """WITH s AS (SELECT canonical_path, job_id AS snapshot, bool_or(status = 'completed') AS present FROM fx_progress GROUP BY canonical_path, job_id), m AS (SELECT canonical_path, coalesce(max(CASE WHEN present THEN snapshot END), -1) AS last FROM s GROUP BY canonical_path)
        SELECT m.canonical_path, CAST(count(s.snapshot) AS int) AS missing_streak FROM m LEFT JOIN s ON s.canonical_path = m.canonical_path AND s.snapshot > m.last GROUP BY m.canonical_path""",
)
def stream_missing_streak(spark, sf_dir):
    """Snapshots land in two lots; state is kept between them."""
    snapshots = staged(view(spark, sf_dir, "fx_progress").groupBy("canonical_path", F.col("job_id").alias("snapshot")).agg(F.bool_or(F.col("status") == "completed").alias("present")))
    folder = fresh(spark, "streaks")
    for lot in ("snapshot <= 2", "snapshot > 2"):
        land(snapshots.where(lot), f"{folder}/landed")
        streams.stream_missing_streak(spark.readStream.schema(snapshots.schema).parquet(f"{folder}/landed"), f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return streams.latest_streaks(spark.read.parquet(f"{folder}/states"))


GAP, AS_OF = "6 hours", datetime(2024, 1, 31)


@query(
    "run_sessions",
    f"""SELECT run_id, min(ts) AS started_at, max(ts) AS last_beat, count(*) AS beats, max(ts) + INTERVAL {GAP} < TIMESTAMP '{AS_OF}' AS stale FROM
        (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY ts) AS k FROM (SELECT user_id AS run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL {GAP} THEN 0 ELSE 1 END AS opens FROM events) a) b GROUP BY run_id, k""",
)
def run_sessions(spark, sf_dir):
    """A run's heartbeats as sessions, with a last heartbeat of no run far ahead that lets the watermark pass all ends."""
    beats = staged(events(spark, sf_dir).select(F.col("user_id").alias("run_id"), "ts"))
    middle = F.to_timestamp(F.lit("2024-01-16"))
    ahead = beats.agg(F.lit(None).cast("bigint").alias("run_id"), (F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"))
    folder = fresh(spark, "sessions")
    for lot in (beats.where(F.col("ts") < middle), beats.where(F.col("ts") >= middle), ahead):
        land(lot, f"{folder}/landed")
        found = streams.sessions(spark.readStream.schema(beats.schema).parquet(f"{folder}/landed"), GAP, "1 hour")
        streams.until_used_up(found, streams.append_to(f"{folder}/out"), f"{folder}/checkpoint").awaitTermination()
    out = streams.stale_sessions(spark.read.parquet(f"{folder}/out"), GAP, AS_OF).where("run_id is not null")
    return out.select("run_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "last_beat")), "beats", "stale")


# change feeds

FOLDED = ORACLE_SQL["upsert_products"]
NEXT = "(SELECT sku, title, brand, price, stock, regular_price FROM (" + FOLDED[FOLDED.index("SELECT coalesce(p.sku"):] + ") m WHERE sku NOT IN (SELECT sku FROM fx_products WHERE id % 11 = 0))"
FIELDS = ("title", "brand", "price", "stock", "regular_price")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Products before a batch, and after it and without every eleventh."""
    p = view(spark, sf_dir, "fx_products")
    before = p.select("sku", *FIELDS)
    after = merge.upsert_products(before, merge.fold_incoming(view(spark, sf_dir, "fx_incoming_products"), "seq")).drop("is_new", "touched")
    return staged(before), staged(after.join(p.where("id % 11 = 0").select("sku"), "sku", "left_anti"))


@query("change_feed", f"SELECT CASE WHEN p.sku IS NULL THEN 'insert' WHEN n.sku IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(p.sku, n.sku) AS sku, {', '.join(f'n.{c}' for c in FIELDS)} FROM fx_products p FULL JOIN {NEXT} n ON n.sku = p.sku WHERE p.sku IS NULL OR n.sku IS NULL OR {' OR '.join(f'p.{c} IS DISTINCT FROM n.{c}' for c in FIELDS)}")
def change_feed(spark, sf_dir):
    return feed.change_feed(*versions(spark, sf_dir), "sku")


@query("change_feed_replay", f"SELECT * FROM {NEXT} n")
def change_feed_replay(spark, sf_dir):
    """The feed applied to the earlier version gives the later one."""
    before, after = versions(spark, sf_dir)
    return feed.apply_feed(before, feed.change_feed(before, after, "sku"), "sku")
