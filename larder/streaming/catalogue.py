"""Incremental forms: landed files merged into snapshots, deduplicated listings, streaks of absence, sessions of runs.

Every stream reads files as they land, keeps its progress in a checkpoint folder and runs until what has landed is
used up (availableNow), so it can be stopped and started between any two batches. Batch forms of the same results
stand beside the streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import merge
from ..plans.ingest import ingest
from ..sources.snapshots import SnapshotStore
from ..sources.tables import measured_broadcasts, staged

STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_landed(spark: SparkSession, folder: str, schema: str, form: str = "json", files: int | None = None) -> DataFrame:
    """Files as they land, `files` at most in a micro-batch."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)


def until_used_up(frame: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return frame.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(STORE_KEY)
    spark.conf.set(STORE_KEY, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE_KEY, before)


# merges


def stream_upsert_products(incoming: DataFrame, target: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Each micro-batch is folded and merged into the next version of the products in the SnapshotStore at `target`, which
    may hold products before the first batch (`seed`)."""

    def apply(batch: DataFrame, number: int) -> None:
        store = SnapshotStore(batch.sparkSession, target)
        folded = merge.fold_incoming(batch, order)
        current = store.read("products")
        out = folded if current is None else merge.upsert_products(current, folded).drop("is_new", "touched")
        store.commit(number + 1, {"products": out})

    return until_used_up(incoming, apply, checkpoint)


def seed(store: SnapshotStore, tables: dict[str, DataFrame]) -> None:
    """What the tables hold before the first micro-batch: batch 0 of the store; micro-batch n is its batch n + 1."""
    store.commit(0, tables)


LANDED = "kind string, canonical_path string, page bigint, body string, name string, slug string, level bigint, parent_path string, source_count bigint"


def stream_ingest(landed: DataFrame, target: str, checkpoint: str, base: str, cdn: str, narrowed: bool = False) -> StreamingQuery:
    """landed (LANDED): listing pages (kind listing), product documents (product) and source categories (category). Each
    micro-batch is a whole ingest: products, children, links with stale ones removed, categories and counts, committed
    together. The store holds products, links and categories before the first batch (`seed`)."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = SnapshotStore(spark, target)
        if store.manifest()["batch"] > number:
            return  # committed before a restart
        batch.persist()
        try:
            with measured_broadcasts(spark):
                of = lambda kind, *columns: batch.where(F.col("kind") == kind).select(*columns)
                current = {t: df for t in ("products", "links", "categories", "images", "attributes") if (df := store.read(t)) is not None}
                found = ingest(current, of("category", "canonical_path", "name", "slug", F.col("level").cast("int").alias("level"), "parent_path", "source_count"), of("listing", "canonical_path", "page", "body"), of("product", "body"), base, cdn, narrowed=narrowed)
                for t in ("products", "listing_status", "links"):  # the run's row reads these too
                    found[t] = staged(found[t])
                out = {"products": found["products"].drop("is_new", "touched"), "categories": found["categories"].drop("is_new")}
                store.commit(number + 1, out | {t: found[t] for t in ("links", "images", "attributes", "counts", "run")})
        finally:
            batch.unpersist()

    return until_used_up(landed, apply, checkpoint)


# listings


def stream_dedupe_listings(items: DataFrame, within: str = "1 day", keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """items (ts, keys, ..): each key once while its first row is within the watermark. State of keys older than that goes,
    and rows that arrive later than the watermark are dropped."""
    return items.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(keys))


def append_to(target: str) -> Callable[[DataFrame, int], None]:
    """A sink of one folder for each micro-batch; a batch that runs again writes over its own."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")


# streaks


class MissingStreak(StatefulProcessor):
    """Counts the snapshots in a row in which a path was absent. Snapshots come in ascending order; one that is not later
    than the last one seen changes nothing, so a file that lands twice does no harm."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "n int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, None)
        seen = pd.concat(list(rows)).groupby("snapshot")["present"].any().sort_index()
        for snapshot, there in seen.items():
            if last is None or snapshot > last:
                n, last = (0 if there else n + 1), int(snapshot)
        self.state.update((int(n), last))
        yield pd.DataFrame({"canonical_path": [key[0]], "missing_streak": [int(n)], "snapshot": [last]})

    def close(self) -> None:
        pass


def stream_missing_streak(snapshots: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """snapshots (canonical_path, snapshot, present) -> target: canonical_path, missing_streak, snapshot after each micro-batch.
    Keyed state in RocksDB outlives restarts with the checkpoint."""
    states = snapshots.groupBy("canonical_path").transformWithStateInPandas(MissingStreak(), "canonical_path string, missing_streak int, snapshot long", "Update", "None")
    with rocksdb(snapshots.sparkSession):
        return until_used_up(states, append_to(target), checkpoint, "update")


def latest_streaks(states: DataFrame) -> DataFrame:
    """What `stream_missing_streak` wrote -> the last state of each path."""
    return states.groupBy("canonical_path").agg(F.max_by("missing_streak", "batch").alias("missing_streak"))


def missing_streak(snapshots: DataFrame) -> DataFrame:
    """The same over a table: snapshots since a path was last present."""
    last = F.coalesce(F.max(F.when(F.col("present"), F.col("snapshot"))), F.lit(-1))
    per = snapshots.groupBy("canonical_path").agg(last.alias("last"))
    return snapshots.join(per, "canonical_path").where(F.col("snapshot") > F.col("last")).groupBy("canonical_path").agg(F.count("*").cast("int").alias("missing_streak")).join(per.select("canonical_path"), "canonical_path", "right").na.fill(0)


# health of runs


def run_health(samples: DataFrame, watermark: str = "1 hour", minutes: int = 60) -> DataFrame:
    return samples.withWatermark("ts", watermark).groupBy(F.window("ts", f"{minutes} minutes"), "user_id").agg(F.count("*").alias("samples"))


def sessions(beats: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """beats (run_id, ts) -> run_id, started_at, last_beat, beats: stretches whose heartbeats are `gap` apart at most. On a
    stream (with a watermark) a session comes out when the watermark has passed its end."""
    beats = beats.withWatermark("ts", watermark) if watermark else beats
    found = beats.groupBy("run_id", F.session_window("ts", gap)).agg(F.max("ts").alias("last_beat"), F.count("*").alias("beats"))
    return found.select("run_id", F.col("session_window.start").alias("started_at"), "last_beat", "beats")


def stale_sessions(found: DataFrame, gap: str, as_of: datetime) -> DataFrame:
    """sessions -> whether the run went stale after each: no heartbeat within `gap`, as seen at as_of."""
    return found.withColumn("stale", F.col("last_beat") + F.expr(f"INTERVAL {gap}") < F.lit(as_of).cast(dict(found.dtypes)["last_beat"]))
