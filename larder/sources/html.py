"""HTML documents as rows: elements of the tree by intervals, descriptions, specification pairs, nested link lists.

Each element is a row with its number in document order (pre), the number of the last element inside it (last) and the
number of its parent, and the place of its markup in the source. So one element lies in another if pre is between the
other's pre and last; siblings share a parent; and markup or text of an element is a slice of the source, cut for the
chosen elements alone. Rows hold no text but a short head for tests of how an element begins, so a text under many open
elements is not repeated for each.

Parsing one document is a small helper on the standard library's tokenizer; order, precedence, dedupe and joins are
DataFrame operators over its rows. Documents are spread over tasks, one at a time is in memory. A missing html has no
elements. doc_ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from .tables import staged

# Section names by what they hold.
LONG_SECTIONS = ("highlights", "features", "product details", "benefits", "construction", "applications", "compatibility", "usage", "additional information", "description", "details", "specifications")
INTRO_SECTIONS = ("highlights", "features", "specifications", "product details", "description", "details")  # fixed values: what an intro doesn't begin with
STOP_SECTIONS = ("reviews", "ratings", "alternatives", "related products", "recommended products", "frequently bought together", "recently viewed", "shipping", "returns", "payment", "support", "footer")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", "div", *HEADINGS, "li", "dt", "dd", "td", "th", "a")
SPEC_HEADING = r"(?i)specifications?|specificaties?|technical\s+(specifications?|data|details)|parameters?|physical\s+parameters?"  # fixed value
EXCLUDED = ("/brands/", "/service/", "/blogs/", "/blog/", "/account/", "/compare/", "/cart/", "/wishlist/", "/pages/")  # fixed values: sections without categories
ELEMENTS = "doc_id long, pre int, last int, parent int, list_depth int, row int, in_specs boolean, holds boolean, single boolean, tag string, names string, label string, href string, start int, end int, chars int, head string, section int, parent_last int"
HEAD = 40  # characters of an element's text that its row holds


class _Tree(HTMLParser):
    """Elements as lists in the order of ELEMENTS without doc_id, section and parent_last."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[list] = []  # rows
        self.kids: list[list] = [[0, False, False, -1]]  # of the document and each open element: child nodes; is the last one a single text; is it a text; the last child whose name begins with h
        self.sections: list[int] = []  # of each row
        self.pieces: list[str] = []  # stripped texts of the document, not those of scripts and styles
        self.size = self.hidden = self.lists = 0
        self.row = -1
        self.source, self.lines = source, [0]
        for line in source.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(source)
        self.close()
        while self.open:
            self._shut(len(source))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _child(self, single: bool, is_text: bool = False) -> None:
        own = self.kids[-1]
        if not (is_text and own[2]):  # texts beside each other are one
            own[:3] = own[0] + 1, single, is_text

    def handle_starttag(self, tag, attrs):
        given, at, pre = dict(attrs), self._place(), len(self.rows)
        names = f"{given.get('id') or ''} {given.get('class') or ''}".lower().split()
        above = self.open[-1] if self.open else None
        if tag == "tr":
            self.row = pre
        if tag.startswith("h"):
            self.kids[-1][3] = pre
        self.sections.append(self.kids[-1][3])
        if tag in ("ul", "ol"):
            self.lists += 1
        if tag in ("table", "ul", "ol", *HEADINGS):
            for row in reversed(self.open):
                if row[6]:
                    break  # and so are all above
                row[6] = True
        in_specs = bool(above and above[5]) or any(n in ("specs", "specifications") for n in names)
        row = [pre, pre, above[0] if above else -1, self.lists, self.row, in_specs, False, False, tag, " ".join(names), given.get("aria-labelledby"), given.get("href"), at, at + len(self.get_starttag_text() or ""), len(self.pieces), self.size]
        self.rows.append(row)
        if tag in VOID:
            self._child(False)
            row[14:] = [0, ""]
        else:
            self.open.append(row)
            self.kids.append([0, False, False, -1])
            self.hidden += tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _shut(self, end: int) -> None:
        row, (n, single, *_) = self.open.pop(), self.kids.pop()
        row[1], row[7], row[13] = len(self.rows) - 1, n == 1 and single, end
        self.lists -= row[8] in ("ul", "ol")
        self.hidden -= row[8] in ("script", "style")
        head, at = "", row[14]
        while len(head) < HEAD and at < len(self.pieces):
            head, at = head + self.pieces[at], at + 1
        row[14:] = [self.size - row[15], head[:HEAD]]
        self._child(row[7])

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][8] == tag), None)
        if at is None:
            return
        place = self._place()
        while len(self.open) > at + 1:
            self._shut(place)
        close = self.source.find(">", place)
        self._shut(len(self.source) if close < 0 else close + 1)

    def handle_comment(self, data):
        self._child(False)

    def handle_data(self, data):
        if not self.hidden:
            self._child(True, True)
            piece = " ".join(data.split())
            if piece:
                self.pieces.append(piece)
                self.size += len(piece)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, rows = [f.split()[0] for f in ELEMENTS.split(", ")], []

    def batch_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * len(KINDS), KINDS)], names=names)

    for batch in batches:
        for doc, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree = _Tree(source or "")
            rows += [(doc, *r, section, tree.rows[r[2]][1] if r[2] >= 0 else None) for r, section in zip(tree.rows, tree.sections)]
            if len(rows) > 20_000:
                yield batch_of(rows)
                rows = []
    yield batch_of(rows)


KINDS = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]] for f in ELEMENTS.split(", ")]


def html_elements(docs: DataFrame) -> DataFrame:
    """docs (doc_id, html) -> a row for each element: pre, last and parent (-1 for none) in document order; list_depth (open
    lists, its own included), row (the last table row begun), in_specs (in a specification section), holds (a heading, table
    or list is inside), single (its only content is one text), start and end in the source (counted from 0), chars and head
    of its text, section (the last element up to it within its parent whose name begins with h, -1 for none), parent_last
    (the last element inside its parent)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("html").cast("string")).mapInArrow(_parse, ELEMENTS)


def sliced(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (doc_id, start, end, ..) with `markup`, the slice of the document's source. Spans are gathered by document, so a
    document's source moves once, not once for each span."""
    rest = [c for c in spans.columns if c != "doc_id"]
    of = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct(*rest)).alias("_spans"))
    both = docs.select("doc_id", "html").join(of, F.col("doc_id") == F.col("_doc"))
    cut = F.transform("_spans", lambda s: F.struct(*(s[c].alias(c) for c in rest), F.substring("html", s["start"] + 1, s["end"] - s["start"]).alias("markup")))
    return both.select("doc_id", F.explode(cut).alias("_x")).select("doc_id", "_x.*")


def text_of(markup: Column, between: str = "") -> Column:
    """The text of a slice of markup, without comments, scripts and styles, white space squeezed; tags become `between`."""
    shown = F.regexp_replace(markup, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", between)
    return text.squeeze(text.unescape(F.regexp_replace(shown, r"(?s)</?[a-zA-Z!?][^>]*>", between)))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    return text.has_any(F.lower(c), words)


def is_intro() -> Column:
    """Whether an element is a paragraph or block with 15 characters or more that holds no heading, table or list and opens no
    section."""
    opens = F.exists(F.array(*(F.lit(w) for w in INTRO_SECTIONS)), lambda w: F.startswith(F.lower("head"), w))
    return F.col("tag").isin("p", "div") & ~F.col("holds") & (F.col("chars") >= 15) & ~F.startswith("head", F.lit("<")) & ~opens


def intro_elements(elements: DataFrame) -> DataFrame:
    """The first introduction of each document: doc_id, pre, parent, start, end."""
    return elements.where(is_intro()).groupBy("doc_id").agg(F.min(F.struct("pre", "parent", "start", "end")).alias("x")).select("doc_id", "x.*")


def intro_paragraph(docs: DataFrame, elements: DataFrame) -> DataFrame:
    return sliced(docs, intro_elements(elements)).select("doc_id", F.col("pre").alias("pos"), text_of(F.col("markup")).alias("short_description"))


def long_description(docs: DataFrame, elements: DataFrame, intro: DataFrame | None = None) -> DataFrame:
    """Headings that name a section, each with the markup of its siblings up to the next whose name begins with h, until a
    heading of a section that stops; sections without text are left out, the others joined by line feeds. intro (doc_id,
    pre, parent): an element that counts as removed; only headings inside its parent count then."""
    if intro is None:
        intro = elements.select("doc_id", F.lit(-1).alias("pre"), F.lit(-1).alias("parent")).limit(0)
    removed = intro.select("doc_id", F.col("pre").alias("intro"), F.col("parent").alias("within"))
    container = removed.join(elements.select("doc_id", F.col("pre").alias("within"), F.col("last").alias("until")), ["doc_id", "within"], "left")
    names = elements.where(F.col("tag").isin(*HEADINGS)).join(container, "doc_id", "left").where("until is null or (pre > within and pre <= until)")
    named = sliced(docs, names.select("doc_id", "pre", "start", "end")).withColumn("name", text_of(F.col("markup")))
    in_order = Window.partitionBy("doc_id").orderBy("pre")
    running = named.withColumn("stopped", F.max(contains_any(F.col("name"), STOP_SECTIONS).cast("int")).over(in_order))
    chosen = running.where(contains_any(F.col("name"), LONG_SECTIONS) & (F.col("stopped") == 0)).select("doc_id", F.col("pre").alias("section"))
    parts = elements.where("section >= 0")
    parts = parts.join(chosen, ["doc_id", "section"]).join(removed.select("doc_id", F.col("intro").alias("pre")), ["doc_id", "pre"], "left_anti")
    cut = sliced(docs, parts.select("doc_id", "section", "pre", "start", "end", "chars"))
    one = cut.groupBy("doc_id", "section").agg(F.sum("chars").alias("chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "markup"))), lambda s: s["markup"]), "").alias("markup")).where("chars > 0")
    return one.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "markup"))), lambda s: F.regexp_replace(s["markup"], r"^\s+|\s+$", "")), "\n").alias("long_description"))


def descriptions(docs: DataFrame) -> DataFrame:
    """docs (doc_id, html, and optionally description, the supplier's plain text) -> doc_id, short_description (the intro
    paragraph, else the supplier's), long_description (sections beside the intro paragraph, which is removed as an element).

    As intro_paragraph and long_description, but elements are dealt by document once: their sections are gathered beside the
    source, and what follows are expressions over that row."""
    dealt = html_elements(docs).where((F.col("section") >= 0) | is_intro()).repartition("doc_id")
    first = F.min(F.when(is_intro(), F.struct("pre", "parent", "parent_last", "start", "end")))
    part = F.when(F.col("section") >= 0, F.struct("pre", F.col("tag").isin(*HEADINGS).alias("heading"), "start", "end", "chars"))
    sections = dealt.groupBy("doc_id", "section").agg(first.alias("intro"), F.sort_array(F.collect_list(part)).alias("parts"))
    headed = F.when((F.col("section") >= 0) & F.get("parts", F.lit(0))["heading"], F.struct(F.col("section").alias("pre"), "parts"))  # a section's first part opens it
    of = sections.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("intro").alias("intro"), F.sort_array(F.collect_list(headed)).alias("_sections"))
    rows = docs.join(of, F.col("doc_id") == F.col("_doc"), "left")
    markup = lambda x: F.substring(F.col("html"), x["start"] + 1, x["end"] - x["start"])
    within = lambda s: F.col("intro.parent_last").isNull() | ((s["pre"] > F.col("intro.parent")) & (s["pre"] <= F.col("intro.parent_last")))
    beside = lambda s: F.filter(s["parts"], lambda x: F.col("intro").isNull() | (x["pre"] != F.col("intro.pre")))
    named = F.transform(F.filter("_sections", within), lambda s: F.struct(text_of(markup(s["parts"][0])).alias("name"), beside(s).alias("parts")))
    rows = rows.withColumn("_named", named)
    stop = F.array_position(F.transform("_named", lambda s: contains_any(s["name"], STOP_SECTIONS)), True)
    rows = rows.withColumn("_named", F.slice("_named", F.lit(1), F.when(stop > 0, (stop - 1).cast("int")).otherwise(F.size("_named"))))
    chosen = F.filter("_named", lambda s: contains_any(s["name"], LONG_SECTIONS) & F.exists(s["parts"], lambda x: x["chars"] > 0))
    texts = F.transform(chosen, lambda s: F.regexp_replace(F.array_join(F.transform(s["parts"], markup), ""), r"^\s+|\s+$", ""))
    rows = rows.withColumn("_texts", texts)
    plain = F.nullif(text.normalize_paragraph(F.col("description")), F.lit("")) if "description" in docs.columns else F.lit(None).cast("string")
    rows = rows.withColumn("_short", text_of(markup(F.col("intro"))))
    return rows.select("doc_id", F.coalesce(F.nullif("_short", F.lit("")), plain).alias("short_description"), F.when(F.size("_texts") > 0, F.array_join("_texts", "\n")).alias("long_description"))


def split_key_value(c: Column) -> Column:
    """'k: v' at the first colon, else 'k - v', as a struct; NULL if neither."""
    colon, dash = F.regexp_extract_all(c, F.lit(r"^\s*([^:]+?)\s*:\s*(.+?)\s*$"), F.lit(0)), F.split(c, r"\s+-\s+", 2)
    part = lambda p, i: F.trim(F.regexp_extract(c, p, i))
    by_colon, by_dash = r"^([^:]+):(.*)$", r"^(.+?)\s+-\s+(.*)$"
    return F.when(F.size(colon) > 0, F.struct(part(by_colon, 1).alias("name"), part(by_colon, 2).alias("value"))).when(F.size(dash) == 2, F.struct(part(by_dash, 1).alias("name"), part(by_dash, 2).alias("value")))


def sibling_members(elements: DataFrame, containers: DataFrame) -> DataFrame:
    """containers (doc_id, pre, parent) -> the elements after each within its parent, up to the next whose name begins with h."""
    later = Window.partitionBy("doc_id", "parent").orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    ends = elements.select("doc_id", "pre", "parent", F.min(F.when(F.startswith("tag", F.lit("h")), F.col("pre"))).over(later).alias("until"))
    own = ends.join(containers.select("doc_id", "pre").distinct(), ["doc_id", "pre"]).withColumnsRenamed({"pre": "after"})
    found = elements.join(own, ["doc_id", "parent"]).where("pre > after and (until is null or pre < until)")
    return found.drop("after", "until").distinct()


def heading_spans(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """What follows a heading or a strong label of specifications: kind (line, cells or text), pre, place, start, end. Lines are
    items of lists, cells those of table rows, texts whole paragraphs or blocks."""
    heads = elements.where(F.col("tag").isin(*HEADINGS, "strong") & F.col("single") & (F.col("chars") > 0))
    labels = sliced(docs, heads.select("doc_id", "pre", "parent", "tag", "start", "end")).where(F.regexp_like(text_of(F.col("markup")), F.lit(SPEC_HEADING)))
    containers = labels.select("doc_id", F.when(F.col("tag") == "strong", F.col("parent")).otherwise(F.col("pre")).alias("pre"))
    members = staged(sibling_members(elements, containers).select("doc_id", "pre", "last", "tag", "start", "end"))  # three results read it
    inside = members.where("tag in ('ul', 'ol', 'table')").select("doc_id", F.col("pre").alias("m"), F.col("last").alias("m_last"), (F.col("tag") == "table").alias("table"))
    within = lambda tag: elements.where(F.col("tag") == tag).join(inside, "doc_id").where("pre > m and pre <= m_last")
    lines = within("li").where("not table").select("doc_id", F.lit("line").alias("kind"), "pre", F.lit(0).alias("place"), "start", "end").distinct()
    rows = within("tr").where("table").select("doc_id", F.col("pre").alias("row")).distinct()
    cells = elements.where("tag in ('td', 'th')").join(rows, ["doc_id", "row"]).select("doc_id", F.lit("cells").alias("kind"), F.col("row").alias("pre"), F.col("pre").alias("place"), "start", "end")
    texts = members.where("tag in ('p', 'div')").select("doc_id", F.lit("text").alias("kind"), "pre", F.lit(0).alias("place"), "start", "end")
    return lines.union(cells).union(texts)


PIECES = "[•▪|;\n]"


def spec_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, rank, pos, name, value: definition lists in a specification section (3), table rows of two cells (4), lists,
    tables and paragraphs after a specification heading or strong label (5), and specification paragraphs split at bullets,
    bars, semicolons and line feeds (6)."""
    elements = staged(html_elements(docs))
    by = Window.partitionBy("doc_id").orderBy("pre")
    following = F.lead(F.struct("tag", "pre", "start", "end")).over(by)
    terms = elements.where(F.col("tag").isin(*BLOCKS)).withColumn("next", following).where("in_specs and tag = 'dt' and next.tag = 'dd'")
    span = lambda df, rank, kind, pre, place, start, end: df.select("doc_id", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), pre.alias("pre"), place.alias("place"), start.alias("start"), end.alias("end"))
    c, zero = F.col, F.lit(0)
    spans = span(terms, 3, "cells", c("pre"), zero, c("start"), c("end")).union(span(terms, 3, "cells", c("pre"), F.lit(1), c("next.start"), c("next.end")))
    spans = spans.union(span(elements.where("tag in ('td', 'th') and row >= 0"), 4, "cells", c("row"), c("pre"), c("start"), c("end")))
    spans = spans.union(heading_spans(docs, elements).select("doc_id", F.lit(5), "kind", "pre", "place", "start", "end"))
    spans = spans.union(span(elements.where("tag = 'p'").where(F.lower("head").rlike("^spec[a-z]*:")), 6, "text", c("pre"), zero, c("start"), c("end")))
    texts = sliced(docs, staged(spans)).withColumn("text", F.when(F.col("kind") == "cells", text_of(c("markup"))).otherwise(text_of(c("markup"), " ")))
    pairs = texts.where("kind = 'cells'").groupBy("doc_id", "rank", "pre").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("c")).where(F.size("c") == 2).select("doc_id", "rank", c("pre").alias("pos"), c("c")[0]["text"].alias("name"), c("c")[1]["text"].alias("value"))
    whole = F.when(c("rank") == 6, F.regexp_replace("text", "(?i)^spec[a-z]*\\s*:", "")).otherwise(c("text"))
    lines = texts.where("kind <> 'cells'").select("doc_id", "rank", c("pre").alias("pos"), F.explode(F.when(c("kind") == "text", F.split(whole, PIECES)).otherwise(F.array("text"))).alias("piece"))
    split = lines.select("doc_id", "rank", "pos", split_key_value(c("piece")).alias("x")).where("x is not null").select("doc_id", "rank", "pos", "x.name", "x.value")
    return pairs.union(split)


def sitemap_nodes(docs: DataFrame, base: str) -> DataFrame:
    """Category links of a document's list: doc_id, pos, name, canonical_path, parent_path, level, source_count.

    The list is the first of the block with class gui-list that is labelled by categories; where that gives nothing, the
    first list with three linked items, three links below /en/ and a first-level category. An item is a category if its own
    link has a name, a path and no excluded section; its children are the items of its own first list. What lies below
    an item that is none, or deeper in other markup, is no category: the intervals of such elements cut it off. Lists nest
    to any depth. Of equal paths the first stays."""
    elements = staged(html_elements(docs))
    first = elements.where("tag = 'a' and href is not null").groupBy("doc_id", "parent").agg(F.min(F.struct("pre", "href", "start", "end")).alias("a")).select("doc_id", F.col("parent").alias("pre"), "a.href", "a.start", "a.end")
    lists = elements.where("tag = 'ul'")
    items = elements.where("tag = 'li'").select("doc_id", "pre", "last", "parent", "list_depth")
    own = sliced(docs, items.select("doc_id", "pre").join(first, ["doc_id", "pre"]))
    name = text_of(F.col("markup"))
    linked = own.select("doc_id", "pre", "href", text.clean_category_name(name).alias("name"), text.extract_count(F.lit(""), name).alias("source_count"), paths.normalize_path(F.col("href"), base).alias("canonical_path"))
    sound = (F.col("name") != "") & ~contains_any(F.col("href"), EXCLUDED) & ~F.col("canonical_path").isin("", "/")
    linked = staged(linked.where(sound).withColumn("absolute", F.startswith("href", F.lit("http")) | F.startswith("href", F.lit("/"))))
    # roots: the labelled block's first list, else lists that pass for one
    direct = items.join(lists.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"])
    blocks = elements.where("tag = 'div' and array_contains(split(names, ' '), 'gui-list') and contains(label, 'categories')").groupBy("doc_id").agg(F.min(F.struct("pre", "last")).alias("b"))
    labelled = lists.join(blocks, "doc_id").where("pre > b.pre and pre <= b.last").groupBy("doc_id").agg(F.min(F.struct("pre", "last", "list_depth")).alias("r")).select("doc_id", F.lit(0).alias("choice"), "r.*")
    # links inside an element: those begun by its last element less those begun before it
    is_link = (F.col("tag") == "a") & F.col("href").isNotNull()
    category = is_link & F.contains("href", F.lit("/en/")) & ~F.coalesce(contains_any(F.col("href"), EXCLUDED), F.lit(False))
    so_far = Window.partitionBy("doc_id").orderBy("pre")
    seen = elements.select("doc_id", "pre", *(F.count_if(c).over(so_far).alias(n) for n, c in (("links", is_link), ("categories", category))))
    until = seen.select("doc_id", F.col("pre").alias("last"), F.col("links").alias("l"), F.col("categories").alias("k"))
    counted = lambda rows, *keep: rows.join(seen, ["doc_id", "pre"]).join(until, ["doc_id", "last"]).select("doc_id", "pre", *keep, (F.col("l") - F.col("links")).alias("links"), (F.col("k") - F.col("categories")).alias("categories"))
    enough_items = counted(direct.select("doc_id", "pre", "last", "parent"), "parent").where("links > 0").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.count("*").alias("items")).where("items >= 3").select("doc_id", "pre")
    with_items = lists.join(enough_items, ["doc_id", "pre"]).select("doc_id", "pre", "last", "list_depth")
    enough_links = counted(with_items.select("doc_id", "pre", "last")).where("categories >= 3").select("doc_id", "pre")
    candidates = labelled.unionByName(with_items.join(enough_links, ["doc_id", "pre"]).withColumn("choice", F.lit(1)))
    good = direct.join(linked.select("doc_id", "pre", "absolute"), ["doc_id", "pre"]).groupBy("doc_id", F.col("parent").alias("pre")).agg(F.bool_or("absolute").alias("any_absolute"))
    usable = candidates.join(good, ["doc_id", "pre"]).where("choice = 0 or any_absolute")
    roots = staged(usable.groupBy("doc_id").agg(F.min(F.struct("choice", "pre", "last", "list_depth")).alias("r")))
    # cuts: items that are no category or no list's own, and lists that aren't an item's first
    first_lists = lists.join(items.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"]).groupBy("doc_id", "parent").agg(F.min("pre").alias("pre")).select("doc_id", "pre", F.lit(True).alias("followed"))
    fit = linked.join(direct.select("doc_id", "pre"), ["doc_id", "pre"]).join(roots, "doc_id").where("r.choice = 0 or absolute").select("doc_id", "pre", F.lit(True).alias("fits"))
    inside = elements.where("tag in ('ul', 'ol', 'li')").join(roots, "doc_id").where("pre > r.pre and pre <= r.last").join(fit, ["doc_id", "pre"], "left").join(first_lists, ["doc_id", "pre"], "left")
    cut = F.when(F.coalesce(F.when(F.col("tag") == "li", F.col("fits")).when(F.col("tag") == "ul", F.col("followed")), F.lit(False)), F.lit(-1)).otherwise(F.col("last"))
    swept = inside.withColumn("reach", F.max(cut).over(Window.partitionBy("doc_id").orderBy("pre"))).where("tag = 'li' and reach < pre")
    nodes = swept.select("doc_id", "pre", "parent", (F.col("list_depth") - F.col("r.list_depth") + 1).alias("level")).join(linked, ["doc_id", "pre"])
    above = lists.select("doc_id", F.col("pre").alias("parent"), F.col("parent").alias("above"))
    of = linked.select("doc_id", F.col("pre").alias("above"), F.col("canonical_path").alias("above_path"))
    out = nodes.join(above, ["doc_id", "parent"]).join(of, ["doc_id", "above"], "left")
    out = out.select("doc_id", F.col("pre").alias("pos"), "name", "canonical_path", F.when(F.col("level") > 1, F.col("above_path")).alias("parent_path"), "level", "source_count")
    return out.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "canonical_path").orderBy("pos"))).where("r = 1").drop("r")
