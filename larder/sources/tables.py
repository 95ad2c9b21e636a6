"""The catalogue's tables as sources, and snapshots as sinks."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

NAMES = ("products", "categories", "product_categories", "images", "attributes", "scrape_jobs", "scrape_progress")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a local master may lack one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-staged-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder, and read back. What several later steps read is computed once, and lost
    executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


STATIC_KEY, MEASURED_KEY, UNION_KEY = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.unionOutputPartitioning"


@contextmanager
def measured_broadcasts(spark: SparkSession):
    """Plans that run inside broadcast a side of a join only if a shuffle has measured it. Else Spark goes by the bytes of
    Parquet files, and columns that compress well pass for small at millions of rows, which the driver then gathers. Frames
    that are only planned inside are not covered: stage them.

    With fewer broadcasts, joins above unions rely on the partitions that Spark 4.1 says a union keeps, while adaptive plans
    coalesce those of its members apart and fail; so unions claim none inside."""
    before = {k: spark.conf.get(k, None) for k in (STATIC_KEY, MEASURED_KEY, UNION_KEY)}
    spark.conf.set(MEASURED_KEY, before[MEASURED_KEY] or spark.conf.get(STATIC_KEY))
    spark.conf.set(STATIC_KEY, "-1")
    spark.conf.set(UNION_KEY, "false")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to spark.sql.shuffle.partitions tasks, however small it is: for rows that cost much more work than bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def key_of(table: str) -> str:
    """The number by which a table is read in ranges."""
    return "product_id" if table == "product_categories" else "id"


def load_jdbc(spark: SparkSession, table: str, key: str, jdbc: dict[str, str], rows_each: int = 100_000, most: int = 64, quote: str = '"') -> DataFrame:
    """A database table read by several connections at once, each a range of the key. Smallest and greatest key and the number
    of rows are asked for first, so that a range holds about `rows_each` rows, in `most` ranges at most."""
    reader = lambda **more: spark.read.format("jdbc").options(**jdbc, **more)
    k = f"{quote}{key}{quote}"
    n, low, high = reader(query=f"SELECT COUNT(*) AS n, MIN({k}) AS low, MAX({k}) AS high FROM {table}").load().first()
    if not n or low is None or low == high:
        return reader(dbtable=table).load()
    ranges = max(1, min(most, -(-n // rows_each)))
    return reader(dbtable=table, partitionColumn=k, lowerBound=low, upperBound=high + 1, numPartitions=ranges).load()


def write_jdbc(df: DataFrame, table: str, jdbc: dict[str, str], rows_each: int = 5_000) -> None:
    """df as a database table, in batches of `rows_each` rows."""
    df.write.format("jdbc").options(**jdbc).option("dbtable", table).option("batchsize", rows_each).mode("overwrite").save()


def load_catalog(spark: SparkSession, folder: str | None = None, *, jdbc: dict[str, str] | None = None, names: tuple[str, ...] = NAMES, rows_each: int = 100_000) -> dict[str, DataFrame]:
    """Tables by name: Parquet below a folder, or a database read in ranges of ids."""
    if folder:
        return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    if not jdbc:
        raise ValueError("a folder or JDBC options are needed")
    return {n: load_jdbc(spark, n, key_of(n), jdbc, rows_each) for n in names}


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table to a new folder; SnapshotStore swaps readers over."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")


JDBC_KEY = "spark.larder.jdbc.url"


def database(spark: SparkSession) -> dict[str, str]:
    """JDBC options of the database that the session names in spark.larder.jdbc.url. A local master without one gets Derby in
    the memory of its one process, which executors of a cluster couldn't reach."""
    url = spark.conf.get(JDBC_KEY, None)
    if url:
        return {"url": url}
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{JDBC_KEY} must name a database that executors reach")
    return {"url": f"jdbc:derby:memory:larder{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
