"""Database reads in ranges, and exports as files."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from larder.operators import catalog
from larder.queries import QUERIES
from larder.sources import exports, tables


def test_a_database_in_ranges(spark):
    jdbc = tables.database(spark)
    df = spark.createDataFrame([(i, f"name {i}", i % 3 == 0, float(i) if i % 5 else None) for i in range(-7, 1000)], "id long, name string, ok boolean, x double")
    tables.write_jdbc(df, "products", jdbc)
    tables.write_jdbc(df.select(df.id.alias("product_id"), "name"), "product_categories", jdbc)
    tables.write_jdbc(df.limit(0), "categories", jdbc)
    back = tables.load_catalog(spark, jdbc=jdbc, names=("products", "product_categories", "categories"), rows_each=100)
    assert back["products"].rdd.getNumPartitions() == 11 and back["categories"].rdd.getNumPartitions() == 1
    assert max(back["products"].rdd.glom().map(len).collect()) <= 100
    assert sorted(map(tuple, back["products"].collect())) == sorted(map(tuple, df.collect())) and back["product_categories"].count() == 1007 and back["categories"].count() == 0


def test_files_by_name_hold_the_order(spark, tmp_path):
    dice = random.Random(1)
    rows = [(i, f"s{i}", dice.choice([None, *map(float, range(50))])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, sku string, regular_price double").repartition(7)
    exports.write_products_json(df.orderBy(*catalog.order("price", "asc")), str(tmp_path / "out"), most_rows=700)
    files = sorted(glob.glob(f"{tmp_path}/out/part-*"))
    found = [json.loads(line) for f in files for line in open(f)]
    assert len(files) > 1 and [r["id"] for r in found] == [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))]


def test_a_document_for_each_sku(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/b"), (2, "a\\b"), (3, "plain"), (4, "a=b c%")], "id long, sku string")
    exports.write_product_files(df, str(tmp_path / "each"), buckets=3, one_file_each=True)
    folders = glob.glob(f"{tmp_path}/each/bucket=*/file_key=*")
    assert len(folders) == 3 and {os.path.basename(f) for f in folders if "plain" in f} == {"file_key=plain"}
    back = spark.read.text(str(tmp_path / "each")).collect()
    assert sorted((r.file_key, json.loads(r.value)["id"]) for r in back) == [("a=b c%", 4), ("a_b", 1), ("a_b", 2), ("plain", 3)]
    assert [tuple(r) for r in exports.file_key_collisions(df).collect()] == [("a_b", 2)]


def test_what_parquet_packs_well_is_not_broadcast(spark, tmp_path):
    for name, n in {"few": 3, "many": 200_000}.items():
        spark.range(n).selectExpr("id div 1000000 as k").coalesce(1).write.parquet(str(tmp_path / name))
    few, many = (spark.read.parquet(str(tmp_path / n)) for n in ("few", "many"))  # some hundred bytes each
    before = {k: spark.conf.get(k, None) for k in (tables.STATIC_KEY, tables.MEASURED_KEY, tables.UNION_KEY)}

    def ran(right):
        found = spark.range(5).withColumnRenamed("id", "k").join(right, "k", "left").agg(F.count("*").alias("n"))
        assert found.first().n == 4 + right.count() and found.collect()
        return found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    assert "BroadcastHashJoin" in ran(many)
    with tables.measured_broadcasts(spark):
        spark.conf.set(tables.MEASURED_KEY, "1m")
        assert "BroadcastHashJoin" in ran(few) and "BroadcastHashJoin" not in ran(many)
    assert {k: spark.conf.get(k, None) for k in before} == before
    with pytest.raises(ZeroDivisionError), tables.measured_broadcasts(spark):
        1 / 0
    assert {k: spark.conf.get(k, None) for k in before} == before


@pytest.mark.parametrize("name", ["ingest_run", "stream_ingest_products"])
def test_an_ingest_broadcasts_by_measured_sizes(spark, monkeypatch, name):
    seen, write = [], DataFrameWriter.parquet

    def watched(self, *args, **more):
        seen.append(self._spark.conf.get(tables.STATIC_KEY))
        return write(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    before = spark.conf.get(tables.STATIC_KEY)
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert set(seen) == {"-1"} and spark.conf.get(tables.STATIC_KEY) == before != "-1"
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # nothing is left to plan outside
