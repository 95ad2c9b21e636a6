"""Streams over files that land in lots: restarts, repeated files, late rows, batches that run twice."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larder.operators import feed
from larder.plans.ingest import ingest
from larder.sources.snapshots import SnapshotStore
from larder.streaming import catalogue as streams

STREAK = "canonical_path string, snapshot bigint, present boolean"


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_streak_outlives_a_lost_batch(spark, tmp_path):
    land, states, check = tmp_path / "land", str(tmp_path / "states"), str(tmp_path / "check")
    land.mkdir()
    history = {"/a/": [1, 0, 0, 1, 0], "/b/": [0, 0, 0, 0, 0], "/c/": [1, 1, 1, 1, 1], "/d/": [0, 1, 0, 0, 0]}

    def put(name, snapshots):
        (land / name).write_text("\n".join(json.dumps({"canonical_path": p, "snapshot": s, "present": bool(seen[s - 1])}) for s in snapshots for p, seen in history.items()))

    def run():
        streams.stream_missing_streak(streams.read_landed(spark, str(land), STREAK, files=1), states, check).awaitTermination()

    put("1.json", [1])
    run()
    put("2.json", [2, 3])
    put("3.json", [2, 3])  # lands twice
    broken = streams.append_to
    streams.append_to = lambda target: lambda batch, number: 1 / 0  # the run dies in the batch
    try:
        with pytest.raises(Exception, match="ZeroDivisionError|division"):
            run()
    finally:
        streams.append_to = broken
    run()
    put("4.json", [4, 5])
    run()
    got = rows_of(streams.latest_streaks(spark.read.parquet(states)))
    table = spark.createDataFrame([(p, s + 1, bool(x)) for p, seen in history.items() for s, x in enumerate(seen)], STREAK)
    assert got == rows_of(streams.missing_streak(table)) == {("/a/", 1), ("/b/", 5), ("/c/", 0), ("/d/", 3)}


def test_late_and_repeated_rows(spark, tmp_path):
    folder, out, check = str(tmp_path / "land"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "ts timestamp, key string, n int"
    lots = [
        [("2024-01-01 10:00", "a", 1), ("2024-01-01 10:05", "a", 1), ("2024-01-01 23:00", "b", 1)],
        [("2024-01-01 23:30", "b", 2), ("2024-01-01 22:30", "c", 2), ("2024-01-01 08:00", "d", 2), ("2024-01-02 09:00", "a", 2)],  # d is late; a's state has gone
        [("2024-01-02 09:10", "a", 3), ("2024-01-01 23:10", "e", 3)],  # e is late now
    ]
    for lot in lots:
        spark.createDataFrame([(datetime.fromisoformat(t), k, n) for t, k, n in lot], "ts timestamp, key string, n int").coalesce(1).write.mode("append").parquet(folder)
        items = streams.stream_dedupe_listings(spark.readStream.schema(schema).parquet(folder), "2 hours")
        streams.until_used_up(items, streams.append_to(out), check).awaitTermination()
    assert sorted((r.key, r.n) for r in spark.read.parquet(out).select("key", "n").collect()) == [("a", 1), ("a", 2), ("b", 1), ("c", 2)]


def test_sessions(spark):
    at = lambda *hours: [datetime(2024, 1, 1, h, m) for h, m in hours]
    rows = [(1, t) for t in at((1, 0), (1, 30), (3, 0), (5, 0))] + [(2, t) for t in at((1, 0), (3, 1))]
    found = streams.stale_sessions(streams.sessions(spark.createDataFrame(rows, "run_id long, ts timestamp"), "2 hours"), "2 hours", datetime(2024, 1, 1, 7))
    assert sorted((r.run_id, r.started_at.hour, r.last_beat.hour, r.beats, r.stale) for r in found.collect()) == [(1, 1, 5, 4, False), (2, 1, 1, 1, True), (2, 3, 3, 1, True)]


def test_store_swaps_all_tables_or_none(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    table = lambda *x: spark.createDataFrame([(i,) for i in x], "n int")
    assert store.versions() == [] and store.read("a") is None
    assert store.commit(0, {"a": table(1), "b": table(1)}) == 1
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|boom"):
        store.commit(1, {"a": table(2), "b": table(2).select(F.raise_error(F.lit("boom")).alias("n"))})
    assert rows_of(store.read("a")) == rows_of(store.read("b")) == {(1,)}  # the half-written version isn't read
    assert store.commit(1, {"a": table(3)}) == 2 == store.commit(1, {"a": table(9)})
    assert rows_of(store.read("a")) == {(3,)} and rows_of(store.read("a", 1)) == {(1,)} and rows_of(store.read("b")) == {(1,)}
    store.commit(2, {"a": table(4)})
    assert store.expire(1) == ["data/a/batch-000000000", "data/a/batch-000000001"] and store.versions() == [3]
    assert rows_of(store.read("a")) == {(4,)} and rows_of(store.read("b")) == {(1,)}
    with pytest.raises(ValueError):
        store.read("a", 1)
    with pytest.raises(RuntimeError):
        store._swap(3, "{}")


def landed(spark, rows):
    names = [f.name for f in spark.createDataFrame([], streams.LANDED).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], streams.LANDED)


def page(path, *items, total=None):
    return {"kind": "listing", "canonical_path": path, "page": 1, "body": json.dumps({"total": len(items) if total is None else total, "page": 1, "limit": 100, "products": list(items)})}


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    categories = spark.createDataFrame([("/en/a/", "A", "a", 1, None, True, 0)], "canonical_path string, name string, slug string, level int, parent_path string, is_active boolean, missing_streak int")
    streams.seed(store, {"products": spark.createDataFrame([("7", "old", 1.0)], "sku string, title string, price double"), "links": spark.createDataFrame([("7", "/en/a/"), ("9", "/en/a/")], "sku string, canonical_path string"), "categories": categories})
    lot = [page("/en/a/", {"id": 7, "title": "new"}, {"id": 8, "title": "eight"}), {"kind": "product", "body": json.dumps({"id": 7, "title": "new", "price": 3, "image": "1", "attributes": {"Size": "5"}})}, {"kind": "category", "canonical_path": "/en/a/", "name": "A", "slug": "a", "level": 1, "source_count": 2}]
    folder = str(tmp_path / "land")
    landed(spark, lot).coalesce(1).write.parquet(folder)

    def run(checkpoint):
        streams.stream_ingest(spark.readStream.schema(spark.createDataFrame([], streams.LANDED).schema).parquet(folder), store.root, str(tmp_path / checkpoint), "https://s.example", "https://cdn.example/").awaitTermination()
        return {t: rows_of(store.read(t)) for t in store.manifest()["tables"] if t != "run"}

    once = run("one")
    assert {(r.sku, r.title, r.price) for r in store.read("products").collect()} == {("7", "new", 3.0), ("8", "eight", None)}
    assert once["links"] == {("7", "/en/a/"), ("8", "/en/a/")} and once["counts"] == {("/en/a/", 2)} and len(once["attributes"]) == 1
    assert run("one") == once and store.versions() == [1, 2]  # nothing new has landed
    assert run("another") == once and store.versions() == [1, 2]  # the same batch under a lost checkpoint
    landed(spark, [page("/en/a/", {"id": 7, "title": "newest"})]).coalesce(1).write.mode("append").parquet(folder)
    assert run("one")["links"] == {("7", "/en/a/")} and {r.title for r in store.read("products").collect()} == {"newest", "eight"}
    assert rows_of(store.read("attributes")) == once["attributes"]  # no document in the batch, so children stay


def test_items_without_a_code(spark):
    stored = {"products": spark.createDataFrame([("7", "old")], "sku string, title string"), "links": spark.createDataFrame([("7", "/en/a/")], "sku string, canonical_path string")}
    stored["categories"] = spark.createDataFrame([], "canonical_path string, name string, slug string, level int, parent_path string, is_active boolean, missing_streak int")
    snapshot = spark.createDataFrame([], "canonical_path string, name string, slug string, level int, parent_path string, source_count bigint")
    pages = landed(spark, [page("/en/a/", {"id": 7}, {"id": 8, "title": "eight", "price": {"price": 2}}), page("/en/b/", {"url": "/x", "title": "nameless"})]).select("canonical_path", "page", "body")
    found = ingest(stored, snapshot, pages, spark.createDataFrame([], "body string"), "https://s.example", "https://cdn.example/")
    assert rows_of(found["links"]) == {("7", "/en/a/"), ("8", "/en/a/")}
    assert {(r.sku, r.title, r.price, r.is_new) for r in found["products"].collect()} == {("7", "old", None, False), ("8", "eight", 2.0, True)}
    assert {(r.canonical_path, r.status, r.reason) for r in found["listing_status"].collect()} == {("/en/a/", "complete", ""), ("/en/b/", "incomplete", "failed details")}
    run = found["run"].first()
    assert (run.links_created, run.links_existing, run.links_removed, run.products_total, run.products_new, run.pages_fetched) == (1, 1, 0, 2, 1, 2)
    rest = ingest(stored, snapshot, pages, spark.createDataFrame([], "body string"), "https://s.example", "https://cdn.example/", done=spark.createDataFrame([("/en/b/",)], "canonical_path string"))
    assert rows_of(rest["listing_status"].select("canonical_path")) == {("/en/a/",)}


def test_change_feed(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, None, 5), (4, "d", 4)], "id int, x string, y int")
    after = spark.createDataFrame([(1, "a", None, "q"), (2, "b", 2, None), (3, "5", None, None), (5, None, None, None), (4, "d", 4, None)], "id int, x string, y int, z string")
    found = feed.change_feed(before, after, "id")
    assert rows_of(found) == {("update", 1, "a", None, "q"), ("update", 2, "b", 2, None), ("update", 3, "5", None, None), ("insert", 5, None, None, None)}
    back = feed.change_feed(after, before, "id")
    assert {(r.op, r.id) for r in back.collect()} == {("update", 2), ("update", 3), ("delete", 5)}
    once = feed.apply_feed(before, found, "id")
    assert rows_of(once) == rows_of(after) == rows_of(feed.apply_feed(once, found, "id"))
    assert feed.change_feed(after, after, "id").count() == 0 == feed.change_feed(after.limit(0), after.limit(0), "id").count()


def test_another_supplier(spark):
    """A shop with forms of its own goes through the same ingest."""
    from larder.operators import listing
    from larder.sources.supplier import SHOP, Supplier

    def items(pages):
        rows = F.posexplode(F.from_json("body", "struct<rows:array<struct<no:string,label:string>>>")["rows"]).alias("pos", "r")
        return pages.select("canonical_path", "page", rows).select("canonical_path", "page", "pos", F.to_json("r").alias("item"), F.concat(F.lit("no:"), "r.no").alias("key"))

    def metadata(pages):
        return pages.select("canonical_path", F.col("page").alias("asked"), F.get_json_object("body", "$.all").cast("bigint").alias("total"), F.lit(1).cast("bigint").alias("total_pages"))

    def summaries(found, base):
        j = lambda n: F.get_json_object("item", f"$.{n}")
        return found.select("canonical_path", "page", "pos", F.lit("").alias("product_id"), j("no").alias("sku"), F.concat(F.lit(base), F.lit("/p/"), j("no")).alias("url"), j("label").alias("name"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("image_id"))

    def products(raw, base):
        j = lambda n: F.get_json_object("body", f"$.{n}")
        rows = raw.select(j("no").alias("sku"), j("label").alias("title"), j("eur").try_cast("double").alias("price"), "body")
        return rows.where("sku is not null"), rows.where("sku is null").select("body", F.lit("no number").alias("error"), F.lit(None).cast("string").alias("key"))

    no = lambda raw, *schema: raw.sparkSession.createDataFrame([], ", ".join(schema))
    texts = lambda raw: raw.select(F.get_json_object("body", "$.no").alias("sku"), F.get_json_object("body", "$.text").alias("description"))
    other = Supplier(
        "other", "https://other.example", "https://img.other.example/", SHOP.categories, items, metadata, summaries, products, texts, lambda raw, base, cdn: no(raw, "sku string", "url string", "sort_order int", "is_cover boolean"),
        lambda raw: no(raw, "sku string", "rank int", "pos int", "name string", "value string"), lambda raw, base: no(raw, "sku string", "canonical_path string", "slug string", "name string", "pos int"),
    )
    sitemap = '<div class="gui-list" aria-labelledby="categories"><ul><li><a href="/en/a/">A (2)</a></li></ul></div>'
    snapshot = other.categories(spark.createDataFrame([(1, sitemap), (2, sitemap)], "doc_id long, html string"), other.base)
    assert [tuple(r) for r in snapshot.collect()] == [("/en/a/", "A", "a", 1, None, 2)]
    stored = {"products": spark.createDataFrame([("x9", "old")], "sku string, title string"), "links": spark.createDataFrame([("x9", "/en/a/")], "sku string, canonical_path string")}
    stored["categories"] = spark.createDataFrame([], "canonical_path string, name string, slug string, level int, parent_path string, is_active boolean, missing_streak int")
    pages = spark.createDataFrame([("/en/a/", 1, '{"all":2,"rows":[{"no":"x1","label":"one"},{"no":"x2","label":"two"}]}')], "canonical_path string, page long, body string")
    raw = spark.createDataFrame([('{"no":"x1","label":"One","eur":"5.5","text":"Good"}',), ('{"label":"lost"}',)], "body string")
    found = ingest(stored, snapshot, pages, raw, supplier=other)
    assert {(r.sku, r.title, r.price, r.url, r.description) for r in found["products"].collect()} == {("x1", "One", 5.5, None, "Good"), ("x2", "two", None, "https://other.example/p/x2", None), ("x9", "old", None, None, None)}
    assert rows_of(found["links"]) == {("x1", "/en/a/"), ("x2", "/en/a/")} and rows_of(found["counts"]) == {("/en/a/", 2)}
    assert listing.listing_items is SHOP.items


def test_specifications_of_the_page_come_after_those_of_the_content(spark):
    from larder.operators import extract

    body = json.dumps({"sku": "s", "content": "<table><tr><td>Weight</td><td>1 kg</td></tr></table>", "ean": "99"})
    page = '<h3>Technical data</h3><ul><li>Weight: 2 kg</li><li>Power: 5 W</li></ul><hr><p>In stock: 12 in stock</p><table><tr><td>Colour</td><td>red</td></tr></table>'
    raw = spark.createDataFrame([(body, page)], "body string, page string")
    found = extract.dedupe_specs(extract.product_specs(raw)).orderBy("sort_order").collect()
    assert [(r.name, r.value) for r in found] == [("Weight", "1 kg"), ("Colour", "red"), ("Power", "5 W"), ("Article number", "s"), ("EAN", "99")]
    good, _ = extract.records(raw, "https://s.example", "https://c.example/")
    row = good.first()
    assert row.stock == 12 and row.stock_status == "in_stock" and [s.name for s in row.specifications] == ["Weight", "Colour", "Power", "Article number", "EAN"] and row.images is None


def test_the_runs_row_reads_what_its_batch_staged(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    empty = lambda schema: spark.createDataFrame([], schema)
    streams.seed(store, {"products": empty("sku string, title string, price double"), "links": empty("sku string, canonical_path string"), "categories": empty("canonical_path string, name string, slug string, level int, parent_path string, is_active boolean, missing_streak int")})
    landed(spark, [page("/en/a/", {"id": 8, "title": "eight"}), {"kind": "product", "body": json.dumps({"id": 8, "title": "eight"})}, {"kind": "category", "canonical_path": "/en/a/", "name": "A", "slug": "a", "level": 1, "source_count": 1}]).coalesce(1).write.parquet(str(tmp_path / "land"))
    plans, commit = {}, SnapshotStore.commit

    def watched(self, batch, tables):
        plans.update({t: df._jdf.queryExecution().optimizedPlan().toString() for t, df in tables.items()})
        return commit(self, batch, tables)

    monkeypatch.setattr(SnapshotStore, "commit", watched)
    streams.stream_ingest(spark.readStream.schema(empty(streams.LANDED).schema).parquet(str(tmp_path / "land")), store.root, str(tmp_path / "checkpoint"), "https://s.example", "https://cdn.example/").awaitTermination()
    assert all("from_json" not in plans[t] for t in ("run", "links", "products", "counts"))
    assert store.read("run").first().products_new == 1 and store.read("links").count() == 1
