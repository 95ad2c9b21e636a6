"""Small cases with pinned results."""

from html import unescape

from larder.fixtures import batch
from larder.functions import paths, text
from larder.operators import catalog, extract, listing, merge, taxonomy
from larder.plans import catalogue
from larder.sources import html
from larder.sources.snapshots import SnapshotStore
from larder.streaming import catalogue as streams
from pyspark.sql import functions as F


def test_paths(spark):
    cases = {"https://a.b/en/Über-uns/;sid1/x?y#z": "/en/uber-uns/x/", "en/a%2Fb/": "/en/a-b/", " ": "", None: "", "/": "/", "/en/../A  B//c.": "/en/a-b/c./", "\\en\\x": "/en/x/", "/en/100%/": "/en/100/"}
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", paths.normalize_path(F.col("u")).alias("p")).collect()
    assert {r.u: r.p for r in got} == cases
    one = spark.createDataFrame([("cables/usb",)], "u string").select(paths.normalize_path(F.col("u"), "https://a.b/en").alias("p")).first()
    assert one.p == "/en/cables/usb/"


def test_descendants(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99), (7, 2)], "id long, parent_id long")
    below = lambda *ids: sorted(r.id for r in taxonomy.descendants(tree, spark.createDataFrame([(i,) for i in ids], "id long")).collect())
    assert below(2) == [2, 3, 7] and below(1, 2) == [1, 2, 3, 7] and below(4) == [4, 5] and below(99) == below() == [] and below(6, 6) == [6]


def test_closure_survives_cycles(spark):
    got = taxonomy.closure(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "id long, parent_id long")).collect()
    assert {(r.ancestor_id, r.descendant_id) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (1, 2), (2, 3), (1, 3), (5, 4), (4, 5)}


def test_nested_tree(spark):
    rows = [(1, None, "a"), (2, 1, "c"), (3, 1, "b"), (4, 77, "lost")]
    got = {r.root_id: r.node for r in taxonomy.nested_tree(spark.createDataFrame([(i, p, n, n, f"/{n}/") for i, p, n in rows], "id long, parent_id long, name string, slug string, canonical_path string")).collect()}
    assert set(got) == {1, 4} and got[1].index('"b"') < got[1].index('"c"') and got[4].endswith('"children":[]}')


def test_merges_are_idempotent(spark):
    current = spark.createDataFrame([("a", "old", 1.0, 3), ("b", "keep", 2.0, 4)], "sku string, title string, price double, stock int")
    batch = spark.createDataFrame([(1, "a", "", 5.0, 0), (2, "a", None, None, None), (3, "c", "new", 0.0, None)], "seq long, sku string, title string, price double, stock int")
    once = merge.upsert_products(current, merge.fold_incoming(batch, "seq"))
    assert {tuple(r) for r in once.collect()} == {("a", "old", 5.0, 0, False, True), ("b", "keep", 2.0, 4, False, False), ("c", "new", 0.0, None, True, True)}
    twice = merge.upsert_products(once.drop("is_new", "touched"), merge.fold_incoming(batch, "seq"))
    assert not twice.where("is_new").count() and {tuple(r)[:4] for r in twice.collect()} == {tuple(r)[:4] for r in once.collect()}


def test_listing_forms(spark):
    bodies = ['{"collection":{"count":250,"limit":100,"products":{"7":{"id":7},"3":{"code":"x"}}}}', '{"products":[{"sku":"s"}],"total":1}', '{"items":[{"url":"u"}]}', '{"data":[{}]}', "{}"]
    pages = spark.createDataFrame([(f"/{i}/", 1, b) for i, b in enumerate(bodies)], "canonical_path string, page long, body string")
    got = [(r.canonical_path, r.key) for r in listing.listing_items(pages).orderBy("canonical_path", "pos").collect()]
    assert got == [("/0/", "id:7"), ("/0/", "code:x"), ("/1/", "sku:s"), ("/2/", "url:u"), ("/3/", "")]
    assert listing.listing_metadata(pages).where("canonical_path = '/0/'").first().total_pages == 3


def test_stock_states_and_rejects(spark):
    bodies = {
        '{"sku":"1","stock":{"on_stock":true}}': "in_stock", '{"sku":"2","stock":{"on_stock":false,"available":true}}': "on_backorder", '{"sku":"3","stock":{"level":0}}': "out_of_stock",
        '{"sku":"4","stock":"Out of stock"}': "out_of_stock", '{"sku":"5","stockStatus":"In stock"}': "in_stock", '{"sku":"6","stock":{"status":"preorder"}}': "on_backorder", '{"sku":"7"}': None,
    }
    raw = spark.createDataFrame([(b,) for b in [*bodies, '{"title":"none"}', '{"sku":"8","price":"dear"}', "<html>"]], "body string")
    good, bad = extract.products(raw, "https://s.example")
    assert {r.sku: r.stock_status for r in good.collect()} == {str(i + 1): v for i, v in enumerate(bodies.values())}
    assert {r.error for r in bad.collect()} == {"no SKU and no product id", "price is no number", "no JSON"}


def test_documents(spark):
    doc = '<p>An intro of some length</p><h3>Highlights</h3><ul><li>One</li><li>Two</li></ul><h3>Reviews</h3><p>Bad text</p><section id="specs"><dl><dt>Weight</dt><dd>5 kg</dd></dl></section><script>x</script>'
    docs = spark.createDataFrame([(1, doc), (2, None)], "doc_id long, html string")
    got = {r.doc_id: r for r in html.descriptions(docs).collect()}
    assert got[1].short_description == "An intro of some length" and got[1].long_description == "<h3>Highlights</h3><ul><li>One</li><li>Two</li></ul>" and got[2].short_description is None
    assert [(r.name, r.value) for r in html.spec_pairs(docs).collect()] == [("Weight", "5 kg")]
    tree = '<div class="gui-list" aria-labelledby="categories"><ul><li><a href="/en/a/">A <span>(5)</span></a><ul><li><a href="/en/a/b/">B</a></li></ul></li><li><a href="/en/a/">A again</a></li></ul></div>'
    got = html.sitemap_nodes(spark.createDataFrame([(1, tree)], "doc_id long, html string"), "https://s.example/en").orderBy("pos").collect()
    assert [(r.name, r.canonical_path, r.parent_path, r.level, r.source_count) for r in got] == [("A", "/en/a/", None, 1, 5), ("B", "/en/a/b/", "/en/a/", 2, 0)]


def test_bad_arguments(spark):
    import pytest

    p = spark.createDataFrame([(1, "a")], "id long, sku string")
    for f in (lambda: catalog.page(p, 0, 20), lambda: catalog.page(p, 1, 101), lambda: catalog.filter_products(p, stock_status="gone")):
        with pytest.raises(ValueError):
            f()


def test_plans(spark):
    c = catalogue.Catalogue.of(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(catalog.page(c.products, 2, 20, "price", "asc"))
    assert "Cartesian" not in plan(taxonomy.path_pairs(c.categories)) and "NestedLoop" not in plan(taxonomy.path_pairs(c.categories))


def test_streams(spark, tmp_path):
    land, target = tmp_path / "land", str(tmp_path / "out")
    land.mkdir()
    (land / "a.json").write_text('{"seq":1,"sku":"a","title":"x"}\n{"seq":2,"sku":"a","title":"y"}\n')
    schema = "seq long, sku string, title string"
    for n in range(2):
        if n:
            (land / "b.json").write_text('{"seq":3,"sku":"b","title":"z"}\n{"seq":4,"sku":"a","title":""}\n')
        streams.stream_upsert_products(streams.read_landed(spark, str(land), schema), target, str(tmp_path / "check")).awaitTermination()
    assert {tuple(r) for r in SnapshotStore(spark, target).read("products").collect()} == {("a", "y"), ("b", "z")}
    rows = spark.createDataFrame([("/a/", 1, True), ("/a/", 2, False), ("/a/", 3, False), ("/b/", 3, True)], "canonical_path string, snapshot int, present boolean")
    assert {tuple(r) for r in streams.missing_streak(rows).collect()} == {("/a/", 2), ("/b/", 0)}


def test_text(spark):
    row = spark.createDataFrame([("Big &amp; <b>Loud</b> (12)",)], "t string").select(text.normalize_text(F.col("t")), text.clean_category_name(F.col("t")), text.extract_count(F.lit(None).cast("string"), F.col("t")), text.slugify(F.lit(" A_b  C! "))).first()
    assert tuple(row) == ("big & loud (12)", "Big &amp; <b>Loud</b>", 12, "a-b-c")


def test_sitemap_documents_are_bounded(spark):
    from larder.queries import sitemap_documents

    rows = [(None if i % 2 else 7, f"https://a.b/en/c{i}/?x&y") for i in range(5000)]
    sizes = [r.xml.count("<loc>") for r in sitemap_documents(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 1024


def test_references_without_python(spark):
    cases = ["a &amp; b", "&notit;&notin;", "&#128;&#x1F600&#xfeff;&#0;&#xD800;&#11;|", "&#99999999999999999999;&#;&;&", "&ampx&amp;lt;&nosuch;", "no reference", "&NotEqualTilde;é", "", None]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r.u for r in df.select(text.unescape(F.col("c")).alias("u")).collect()] == [None if c is None else unescape(c) for c in cases]
    plans = [df.select(text.normalize_text(F.col("c"))), extract.dedupe_specs(spark.createDataFrame([("s", 1, 0, "Weight &amp; size:", "5 &lt; 6 kg")], "sku string, rank int, pos int, name string, value string"))]
    assert not any("ArrowEvalPython" in df._jdf.queryExecution().optimizedPlan().toString() for df in plans)
    assert [tuple(r) for r in plans[1].collect()] == [("s", "weight & size", "Weight & size", "5 < 6 kg", 0)]


def test_each_field_is_worked_out_once(spark):
    """A plan names the long expressions once: no filter repeats them below."""
    raw = spark.createDataFrame([('{"sku":"1","price":"2","categories":[{"url":"/a/Ü/","title":"A"}],"specs":{"1":{"title":"N:","value":"v"}}}',), ('{"sku":"2","price":"dear"}',)], "body string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    nodes = extract.category_nodes(raw, "https://s.example")
    assert plan(nodes).count("[^?#]*)") == 2 and [r.canonical_path for r in nodes.collect()] == ["/a/u/"]
    good, bad = extract.products(raw, "https://s.example")
    assert "from_json" not in plan(good) + plan(bad) and [r.sku for r in good.collect()] == ["1"] and [r.key for r in bad.collect()] == ["2"]
    specs = plan(extract.json_specs(raw))
    assert "size(" not in specs and len(extract.json_specs(raw).collect()) == 1


def test_batch_reads_sales_once(spark):
    """No table of a batch joins lineitem anew for a column that it doesn't have."""
    assert not any("l_shipdate" in df._jdf.queryExecution().analyzed().toString() for n, df in batch(spark, "/root/testdata/sf0.001").items() if n in ("stored_products", "stored_links", "pages", "raw"))


def test_a_table_of_a_batch_costs_what_it_needs(spark):
    """Rejects and images of a batch read no listing and no description."""
    from dataclasses import replace

    from larder.plans.ingest import ingest
    from larder.sources.supplier import SHOP

    def never(*_):
        raise AssertionError("worked out for a table that doesn't hold it")

    stored = {"products": spark.createDataFrame([], "sku string"), "links": spark.createDataFrame([], "sku string, canonical_path string")}
    stored["categories"] = spark.createDataFrame([], "canonical_path string, name string, slug string, level int, parent_path string, is_active boolean, missing_streak int")
    snapshot = spark.createDataFrame([], "canonical_path string, name string, slug string, level int, parent_path string, source_count bigint")
    pages = spark.createDataFrame([], "canonical_path string, page bigint, body string")
    raw = spark.createDataFrame([('{"id":1,"image":"7"}',), ('{"id":2,"price":"dear"}',)], "body string")
    found = ingest(stored, snapshot, pages, raw, supplier=replace(SHOP, items=never, summaries=never, descriptions=never))
    assert [tuple(r) for r in found["rejects"].select("key", "error").collect()] == [("2", "price is no number")]
    assert [tuple(r) for r in found["images"].select("sku", "sort_order").collect()] == [("1", 0)]


def test_pairs_of_a_document_come_from_one_parse(spark):
    body = '{"id":1,"specs":{"1":{"title":"Weight","value":1.50},"2":{"title":"","name":"Box","text":{"a": 1}}},"attributes":[{"name":"Size","value":"5"},{"label":"Size"}]}'
    found = extract.json_specs(spark.createDataFrame([(body,), ("{}",)], "body string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Generate") == 1
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(1, 0, "Weight", "1.5"), (1, 1, "Box", '{"a":1}'), (2, 0, "Size", "5")]
