"""HTML by intervals against a small tree walked node by node."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from larder.sources import html

VOID = html.VOID


class Node:
    def __init__(self, tag, parent, attrs=(), start=0):
        self.tag, self.parent, self.attrs, self.kids, self.start, self.end = tag, parent, dict(attrs), [], start, None

    def all(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.all()

    def texts(self):
        for k in self.kids:
            if isinstance(k, str):
                yield k
            elif k.tag not in ("script", "style", "#comment"):
                yield from k.texts()

    def text(self, between=""):
        return between.join(x for t in self.texts() if (x := " ".join(t.split())))

    def after(self):
        for k in self.parent.kids[self.parent.kids.index(self) + 1 :]:
            if isinstance(k, Node) and k.tag != "#comment":
                if k.tag.startswith("h"):
                    return
                yield k


class Reader(HTMLParser):
    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.source, self.root = source, Node("#root", None)
        self.at = self.root
        self.feed(source)
        self.close()
        while self.at is not self.root:
            self.shut(len(source))

    def place(self):
        line, column = self.getpos()
        return sum(len(x) + 1 for x in self.source.split("\n")[: line - 1]) + column

    def shut(self, end):
        self.at.end = end
        self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        node = Node(tag, self.at, attrs, self.place())
        self.at.kids.append(node)
        if tag in VOID:
            node.end = node.start + len(self.get_starttag_text())
        else:
            self.at = node

    def handle_endtag(self, tag):
        up = self.at
        while up is not self.root and up.tag != tag:
            up = up.parent
        if up is not self.root:
            place = self.place()
            while self.at is not up:
                self.shut(place)
            self.shut(self.source.find(">", place) + 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_comment(self, data):
        self.at.kids.append(Node("#comment", self.at))

    def handle_data(self, data):
        if self.at.kids and isinstance(self.at.kids[-1], str):
            self.at.kids[-1] += data
        else:
            self.at.kids.append(data)


def intro_of(root):
    for n in root.all():
        if n.tag in ("p", "div") and not any(x.tag in (*html.HEADINGS, "table", "ul", "ol") for x in n.all()):
            t = n.text()
            if len(t) >= 15 and not t.startswith("<") and not any(t.lower().startswith(w) for w in html.INTRO_SECTIONS):
                return n
    return None


def descriptions_of(source):
    root = Reader(source or "").root
    intro = intro_of(root)
    sections = []
    for n in (intro.parent if intro else root).all():
        if n.tag in html.HEADINGS:
            name = n.text().lower()
            if any(w in name for w in html.STOP_SECTIONS):
                break
            if any(w in name for w in html.LONG_SECTIONS):
                parts = [n, *(x for x in n.after() if x is not intro)]
                if any(x.text() for x in parts):
                    sections.append("".join(source[x.start : x.end] for x in parts).strip())
    squeezed = " ".join("".join(intro.texts()).split()) if intro else None
    return squeezed, "\n".join(sections) or None


def single(n):
    return len(n.kids) == 1 and (isinstance(n.kids[0], str) or n.kids[0].tag not in ("#comment", *VOID) and single(n.kids[0]))


def heading_texts_of(source):
    out = set()
    for n in Reader(source or "").root.all():
        if n.tag in (*html.HEADINGS, "strong") and single(n) and re.search(html.SPEC_HEADING, n.text()):
            container = n.parent if n.tag == "strong" else n
            if container.parent is None:
                continue
            for x in container.after():
                if x.tag in ("ul", "ol"):
                    out |= {("line", i.text(" ")) for i in x.all() if i.tag == "li"}
                elif x.tag == "table":
                    out |= {("cells", i.text()) for i in x.all() if i.tag in ("td", "th")}
                elif x.tag in ("p", "div"):
                    out.add(("text", x.text(" ")))
    return out


def made(dice, depth=0):
    if depth > 5 or dice.random() < 0.25:
        return dice.choice(["a plain text of words", "short", " ", "&amp; more &lt;", "Features", "x: y", "<!-- c -->", "<br>", "<hr/>", "<script>if (a<b) x</script>", "line\nfeed"])
    tag = dice.choice(["p", "p", "div", "div", "h2", "h3", "ul", "li", "table", "b", "strong", "span", "section"])
    inner = "".join(made(dice, depth + 1) for _ in range(dice.randint(0, 4)))
    if tag in ("h2", "h3", "strong") and dice.random() < 0.7:
        inner = dice.choice(["Highlights", "Usage notes", "Technical data", "<b>Specifications</b>", "Reviews", "Other", "Product details"])
    if tag == "table":
        inner = "".join(f"<tr><td>{made(dice, 5)}</td><td>{made(dice, 5)}</td></tr>" for _ in range(2))
    if dice.random() < 0.15:
        return f"<{tag}>{inner}"  # never closed
    return f"<{tag} class='c'>{inner}</{tag}>" + dice.choice(["", "", "</div>"])


@pytest.fixture(scope="module")
def sources(spark):
    dice = random.Random(9)
    found = ["".join(made(dice) for _ in range(dice.randint(1, 6))) for _ in range(250)]
    found += [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    return found + [None, "", "<", "no markup", "<p", "<p>" * 200 + "an unclosed paragraph"]


def rows(spark, sources):
    return spark.createDataFrame(list(enumerate(sources)), "doc_id long, html string")


def test_descriptions(spark, sources):
    got = {r.doc_id: (r.short_description, r.long_description) for r in html.descriptions(rows(spark, sources)).collect()}
    want = {i: descriptions_of(s) for i, s in enumerate(sources)}
    assert got == want and sum(b is not None for _, b in want.values()) > 20


def test_what_follows_specification_headings(spark, sources):
    docs = rows(spark, sources)
    found = html.sliced(docs, html.heading_spans(docs, html.html_elements(docs).cache()))
    text = F.when(F.col("kind") == "cells", html.text_of(F.col("markup"))).otherwise(html.text_of(F.col("markup"), " "))
    got = {(r.doc_id, r.kind, r.text) for r in found.select("doc_id", "kind", text.alias("text")).collect()}
    want = {(i, *x) for i, s in enumerate(sources) for x in heading_texts_of(s)}
    assert got == want and len(want) > 50


def test_descriptions_deal_elements_once(spark, capsys):
    """Elements move once and meet the documents once."""
    docs = spark.createDataFrame([(1, "<h2>Usage</h2><p>Words</p>")], "doc_id long, html string").repartition(2)
    html.descriptions(docs).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1 and plan.count("Window") == 0
    assert sum("Exchange hashpartitioning" in line for line in plan.split("\n")) == 2


def test_supplier_text_where_there_is_no_intro(spark):
    docs = spark.createDataFrame([(1, "<h2>Usage</h2><p>Highlights only</p>", "  Plain&nbsp;text "), (2, None, " "), (3, "<p>An introduction of words</p>", "unused")], "doc_id long, html string, description string")
    got = {r.doc_id: (r.short_description, r.long_description) for r in html.descriptions(docs).collect()}
    assert got == {1: ("Plain text", "<h2>Usage</h2><p>Highlights only</p>"), 2: (None, None), 3: ("An introduction of words", None)}


def test_the_intro_goes_once(spark):
    """Removed as an element: the same words in another element stay."""
    docs = spark.createDataFrame([(1, "<div><p>The very same words</p><h3>Details</h3><p>The very same words</p></div>")], "doc_id long, html string")
    assert html.descriptions(docs).first().long_description == "<h3>Details</h3><p>The very same words</p>"


def test_deep_lists(spark):
    deep = "".join(f'<ul><li><a href="/en/d{i}/">D{i}</a>' for i in range(30))
    tree = f'<div class="gui-list" aria-labelledby="categories">{deep}</div>'
    skips = '<div class="gui-list" aria-labelledby="categories"><ul><li><a href="/en/a/">A</a><ul><li><a href="/en/cart/">Cart</a><ul><li><a href="/en/x/">X</a></li></ul></li><li><a href="/en/b/">B</a></li></ul><ul><li><a href="/en/second/">Second list</a></li></ul></li><li><p><a href="/en/c/">C</a></p></li><li><a href="/en/a/">A again</a></li></ul></div>'
    got = html.sitemap_nodes(spark.createDataFrame([(1, tree), (2, skips), (3, None), (4, "<ul><li><a href='/en/a/'>A</a></li></ul>")], "doc_id long, html string"), "https://s.example/en").collect()
    assert sorted((r.level, r.canonical_path, r.parent_path) for r in got if r.doc_id == 1) == [(i + 1, f"/en/d{i}/", f"/en/d{i - 1}/" if i else None) for i in range(30)]
    assert sorted((r.name, r.level, r.parent_path) for r in got if r.doc_id == 2) == [("A", 1, None), ("B", 2, "/en/a/")]
    assert not [r for r in got if r.doc_id > 2]


def test_unclosed_paragraphs_stay_small(spark):
    """Elements hold no text, so a text under thousands of open ones isn't repeated."""
    source = "<p>words " * 5000
    r = html.html_elements(spark.createDataFrame([(1, source)], "doc_id long, html string")).agg(F.count("*").alias("n"), F.max("chars").alias("chars"), F.sum(F.length("head")).alias("heads")).first()
    assert (r.n, r.chars) == (5000, 25_000) and r.heads <= 5000 * html.HEAD


def test_pairs_are_planned_in_steps(spark):
    docs = spark.createDataFrame([(1, "<h3>Specifications</h3><ul><li>Size: 5</li></ul>")], "doc_id long, html string")
    found = html.spec_pairs(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2  # the slices of cells and of lines
    assert [tuple(r) for r in found.collect()] == [(1, 5, 2, "Size", "5")]
