"""HTML extraction by differencing each page against its nearest-URL neighbour on the same host.

1. Each whole page is split into text lines (blocks of markup, references decoded, white space
   collapsed) with the place where each stood: chrome (menus, headers, footers, sidebars, notices,
   adverts, forms, reader comments), body (paragraphs, headings, lists and tables of an article or main
   element), or open (anything else).
2. Pages are sorted by host and URL path over all tasks (a range partition, so hosts and equal paths are
   split at any size), and each is compared within its partition; the first and last page of a partition
   meet their neighbours in the partitions beside it by joins on partition numbers. A page is paired with the neighbour in path order whose
   path shares the longer prefix with its own. Pages of a host with the same html count as one, at the first of their
   paths, so a page is never compared with itself. The number of partitions changes no result.
3. The lines of a pair are aligned by longest common subsequence, on line hashes. Shared lines are
   template text and are deleted. Two exceptions keep the article whole: body lines stay, since
   copies and quotations share whole paragraphs with their neighbours; and pages that share more than
   `copy_share` of their text that could stay (no chrome, nothing beside an article) are copies, whose shared
   lines say nothing about a template; the neighbour on the other side is taken then, if it is no copy.
4. What differencing can't see, because it changes from page to page, goes by its element or by names that mean such
   parts as a whole: menus, adverts, comments (`marks_chrome`). An element that holds lines of its own (a paragraph, a
   heading, a cell) goes only by a name of one such word; a name on a container around an article doesn't count against
   the article. On pages with an article or main element only its lines stay; the rest is joined.

Null or empty html gives an empty text. A null URL is its own host. Repeated rows and repeated or null
page_ids each give their own row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CHROME, OPEN, BODY = 0, 1, 2
# Elements and class or id words that mark text outside an article, and words that may stand beside them in a name.
CHROME_TAGS = frozenset("nav footer aside form button select dialog menu noscript".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice alert newsletter subscribe signup login sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead share sharing social related recommended comment comments discussion review reviews respond replies disqus popup modal widget pagination pager toolbar skip".split()
)
PART_WORDS = frozenset(
    "left right top bottom upper lower main primary secondary global site box bar block wrap wrapper container inner outer section area slot unit list panel zone row group form button buttons "
    "icon icons link links posts articles stories thread user users reader readers media".split()
)
WHOLE_WORDS = frozenset("page post article entry story blog home body content".split())
RAW = "script|style|textarea|title|iframe|template|xmp|svg"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split())
BODY_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption blockquote pre figcaption".split())
PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S | re.I)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def marks_chrome(name: str) -> bool:
    """A class or id names chrome as a whole: each of its words is a word of chrome or one that may stand beside such words; a
    word for the page or its text may stand before a last word of chrome. So cookie-notice, sidebar-left and
    page-footer do, while page-with-sidebar, notice-of-election and menu-item-page don't."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if not words or CHROME_WORDS.isdisjoint(words):
        return False
    allowed = CHROME_WORDS | PART_WORDS | (WHOLE_WORDS if words[-1] in CHROME_WORDS else frozenset())
    return allowed.issuperset(words)


def is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CHROME_TAGS or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main") and "comment" not in attributes.lower() or not attributes:
        return False
    names = [n for m in NAMES.finditer(attributes) for n in "".join(x or "" for x in m.groups()).lower().split()]
    known = CHROME_WORDS - {"header"} if in_article else CHROME_WORDS  # an article's own header is its title
    return any(n in known if tag in BODY_TAGS else marks_chrome(n) and not (in_article and n.endswith("header")) for n in names)


def holds_article(tag: str, attributes: str, stack: list) -> bool:
    """An article or main element, in no other and in no element that is chrome by itself, is no chrome whatever the
    names around it say."""
    inside = any(t in CHROME_TAGS or t == "header" or a for t, _, a in stack)
    return tag in ("article", "main") and not inside and not is_chrome(tag, attributes, False)


def page_lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, place, inside an article or main element) of each line in page order."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, chrome here or above, article here or above
    words: list[str] = []
    done = 0

    def close() -> None:
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        if text:
            chrome, article = stack[-1][1:] if stack else (False, False)
            body = article and any(t in BODY_TAGS for t, _, _ in stack)
            out.append((text, CHROME if chrome else BODY if body else OPEN, article))

    for m in PIECE.finditer(html):
        if m.start() > done:
            words.append(html[done : m.start()])
        done = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            words.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if inline and is_block_between(stack, i):
                        break
                    if inline and stack[i][1] != (stack[i - 1][1] if i else False):
                        close()
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag[0] == "h" and tag[1:].isdigit():
            close_implied(stack, tag)
        chrome, article = stack[-1][1:] if stack else (False, False)
        mine = (chrome or is_chrome(tag, m["more"] or "", article)) and not (chrome and holds_article(tag, m["more"] or "", stack))
        if inline and mine and not chrome:
            close()
        stack.append((tag, mine, article or tag in ("article", "main")))
    if done < len(html):
        words.append(html[done:])
    close()
    return out


def is_block_between(stack: list, i: int) -> bool:
    return any(t not in INLINE for t, _, _ in stack[i + 1 :])


def close_implied(stack: list, tag: str) -> None:
    """An open p ends at the next block; an open li, dt or cell at the next of its kind."""
    kin = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in kin or stack[i][0] == "p":
            del stack[i:]
            return
        if stack[i][0] not in INLINE:
            return


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in own of a longest common subsequence with other."""
    a = [i for s in [set(other)] for i, h in enumerate(own) if h in s]
    b = [h for s in [set(own)] for h in other if h in s]
    if not a or not b:
        return []
    # Hunt and Szymanski: the longest increasing run of matching places
    at: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        at.setdefault(b[j], []).append(j)
    from bisect import bisect_left

    tails: list[int] = []
    links: list[tuple] = []
    for i in a:
        for j in at[own[i]]:
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    found, link = [], links[-1]
    while link:
        found.append(link[0])
        link = link[1]
    return found[::-1]


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [page_lines(h or "") for h in batch.column(3).to_pylist()]
        hashes = [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _, _ in x] for x in lines]
        articles = [any(inside for _, _, inside in x) for x in lines]
        sizes = [[len(t) if place != CHROME and (inside or not a) else 0 for t, place, inside in x] for x, a in zip(lines, articles)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=["key", "host", "path", "hashes", "sizes"])


PAGE = "key long, host string, path string, hashes array<long>, sizes array<int>"
KIND = pa.struct([("key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


def judged(page: dict, before: dict | None, after: dict | None, copy_share: float) -> dict:
    """The lines of a page that go, by its nearer neighbour of the same host, or the other if that is a copy."""
    path, own, sizes = page["path"], page["hashes"], page["sizes"]
    near = [x for x in (before, after) if x is not None and x["host"] == page["host"]]
    for other in sorted(near, key=lambda x: -common_prefix(path, x["path"])):
        found = shared_lines(own, other["hashes"])
        if sum(sizes[i] for i in found) <= copy_share * sum(sizes):
            return {"key": page["key"], "gone": found}
    return {"key": page["key"], "gone": []}


def in_slices(rows: Iterator[dict], kinds: dict) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 500)):
        yield pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in some], k) for c, k in kinds.items()], names=list(kinds))


RESULT = {"key": pa.int64(), "gone": pa.list_(pa.int32())}


def compare(copy_share: float):
    """Pages in order -> key and the lines that go. The first and the last page of a partition come with its number and their
    neighbour inside it instead, since others lie in partitions beside it."""

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, before, held = TaskContext.get().partitionId(), None, None
        for page in (x for batch in batches for x in batch.to_pylist()):
            if held is not None:
                yield judged(held, before, page, copy_share) if before is not None else {"part": part, "page": held, "after": page, "first": True, "last": False}
                before = held
            held = page
        if held is not None:
            yield {"part": part, "page": held, "before": before, "first": before is None, "last": True}

    kinds = RESULT | {"part": pa.int32(), "first": pa.bool_(), "last": pa.bool_()} | {c: KIND for c in ("page", "before", "after")}
    return lambda batches: in_slices(results(batches), kinds)


def compare_ends(copy_share: float):
    """Rows (page, before, after) -> key and the lines that go."""
    return lambda batches: in_slices((judged(**x, copy_share=copy_share) for batch in batches for x in batch.to_pylist()), RESULT)


def beside(ends: DataFrame) -> DataFrame:
    """First and last pages with their neighbours in the partitions before and after, empty ones aside. Only partition numbers
    are put in one order; pages meet by joins on them."""
    order = Window.orderBy("part")
    parts = ends.select("part").distinct().select("part", F.lag("part").over(order).alias("previous"), F.lead("part").over(order).alias("next"))
    lasts = ends.where("last").select(F.col("part").alias("previous"), F.col("page").alias("page_before"))
    firsts = ends.where("first").select(F.col("part").alias("next"), F.col("page").alias("page_after"))
    met = ends.join(parts, "part").join(lasts, "previous", "left").join(firsts, "next", "left")
    return met.select("page", F.coalesce("before", F.when(F.col("first"), F.col("page_before"))).alias("before"), F.coalesce("after", F.when(F.col("last"), F.col("page_after"))).alias("after"))


def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for html, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            lines, gone = page_lines(html or ""), set(gone or ())
            has_article = any(inside for _, _, inside in lines)
            text = " ".join(t for i, (t, place, inside) in enumerate(lines) if place != CHROME and (inside or not has_article) and (place == BODY or i not in gone))
            texts.append(text)
            counts.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, partitions: int | None = None, copy_share: float = 0.8) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?(.*)$", 1), F.lit(""))
    own = own.withColumn("host", host).withColumn("key", F.xxhash64("host", "html"))
    hashed = own.select("key", "host", path.alias("path"), "html").mapInArrow(line_hashes, PAGE)
    hashed = hashed.groupBy("key").agg(F.min(F.struct("host", "path", "hashes", "sizes")).alias("x")).select("key", "x.*")
    order = ["host", "path", "key"]
    page = ", ".join(f"{c} struct<{PAGE.replace(' ', ':').replace(',:', ',')}>" for c in ("page", "before", "after"))
    sorted_pages = hashed.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    inner = cut(sorted_pages.mapInArrow(compare(copy_share), f"key long, gone array<int>, part int, first boolean, last boolean, {page}"))
    ends = beside(inner.where("page is not null").select("part", "first", "last", "page", "before", "after"))
    gone = inner.where("page is null").select("key", "gone").union(ends.mapInArrow(compare_ends(copy_share), "key long, gone array<int>"))
    return own.join(gone, "key", "left").select("page_id", "url", "html", "gone").mapInArrow(main_text, "page_id long, url string, text string, n_chars long")
