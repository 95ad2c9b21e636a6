import os
import random
import re

import pytest

from larder.llm.page_diff import BODY, CHROME, extract, marks_chrome, page_lines, shared_lines

SCHEMA = "page_id long, url string, html string, host string, key string"


def texts(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA)
    return {r.page_id: (r.url, r.text, r.n_chars) for r in extract(df, **options).collect()}


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";go(1);</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
<div class="cookie-notice">We use cookies</div><article><header><h1>A &eacute;  title</h1></header><p><b>First&nbsp;line<br>goes on.<p>Second <i>pa</i>ragraph &lt;x&gt;.</p>
<aside>Aside</aside><form><label>Mail</label></form><ul><li>one<li>two</ul><section id="comments"><article class="comment">Nice!</article></section></article>
<div id="sidebar">Side</div><footer>&copy; x</footer>"""


def test_article_without_chrome(spark):
    want = "A é title First line goes on. Second paragraph <x>. one two"
    got = texts(spark, [(1, "http://h.example/a/1", ARTICLE), (2, None, None), (3, "", ""), (None, "x", "<p>only"), (5, "http://h.example/a/2", "<article><p>unclosed & bare < text")])
    assert got[1][1:] == (want, len(want)) and got[2] == (None, "", 0) and got[3] == ("", "", 0) and got[None][1] == "only" and got[5][1] == "unclosed & bare < text"


def test_shared_lines_of_neighbours_go(spark):
    page = "<html><body><div>Welcome to us</div><div>{0}</div><div>Read more</div><p>Long own text about {0} and on {0}</p><div>All rights</div></body></html>"
    rows = [(i, f"https://h.example/{'ab'[i % 2]}/{i}", page.format(f"topic{i}")) for i in range(6)]
    got = texts(spark, rows)
    assert all(got[i][1] == f"topic{i} Long own text about topic{i} and on topic{i}" for i in range(6))
    assert texts(spark, rows, partitions=3).keys() == got.keys()


def test_neighbours_are_the_same_at_every_size(spark):
    page = "<html><body><div>Section {0} greets you</div><p>Own text of page {1} that is long enough to be no copy {1}</p></body></html>"
    rows = [(i, f"https://h.example/s{i % 9}/{i:03}", page.format(i % 9, i)) for i in range(90)]
    rows += [(i, None, f"<div>Open line</div><p>Text {i} of a page that has no address at all, {i}</p>") for i in range(100, 140)]
    got, small = texts(spark, rows), texts(spark, rows, partitions=3)
    assert got == small and not any("greets" in x[1] or "Open line" in x[1] for x in got.values())


def test_copies_are_judged_without_chrome_and_by_either_neighbour(spark):
    menu = "<nav>" + "".join(f"<a href='/{i}'>A long entry of the menu, number {i}</a> " for i in range(20)) + "</nav>"
    page = "<html><body>{0}<div>Greeting</div><p>Own text about {1} and its {1}</p></body></html>"
    rows = [(i, f"https://h.example/a/{i}", page.format(menu, f"topic{i}")) for i in range(4)]
    rows += [(i, f"https://g.example/a/{i}", page.format("", f"topic{max(i, 11)}")) for i in (10, 11, 12)]
    got = texts(spark, rows)
    assert all(got[i][1] == f"Own text about topic{i} and its topic{i}" for i in (0, 1, 2, 3, 11, 12))


def test_copies_and_shared_paragraphs_stay(spark):
    rows = [(i, f"http://h/{i}", f"<article><h1>Same</h1><p>Shared paragraph.</p><p>Own {i}</p></article>") for i in range(3)]
    rows += [(i, f"http://g/{i}", "<div>Copied text with no article</div>") for i in (7, 8, 8)]
    got = texts(spark, rows)
    assert got[1][1] == "Same Shared paragraph. Own 1" and got[7][1] == got[8][1] == "Copied text with no article"


def test_names_around_and_inside_an_article(spark):
    rows = [(1, "http://h/1", '<div class="with-sidebar"><article><p>Text of one</p></article></div><div class="sidebar">Side</div>'), (2, "http://h/2", '<div id="page-widget"><main><p class="share-price">Shares rose</p><p class="ad">Buy</p></main></div>')]
    got = texts(spark, rows)
    assert got[1][1] == "Text of one" and got[2][1] == "Shares rose"


def test_repeated_pages_bring_no_template_back(spark):
    page = "<html><body><div>Welcome</div><p>Own text of {0}, long enough to be told from the rest, {0}</p><div>Read more</div></body></html>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(3)] + [(1, "http://h/1", page.format(1))] * 2 + [(9, "http://h/1", page.format(1)), (8, "http://h/1b", page.format(1))]
    got = texts(spark, rows)
    assert all(x[1].startswith("Own text") and x[1].endswith(str(min(i, 9))) or i > 2 for i, x in got.items()) and got[9][1] == got[8][1] == got[1][1]


def brute(rows):
    """Pages in path order in one list; each compared with its neighbours by a plain table of common subsequences."""
    def host_path(u):
        m = re.match(r"[a-z]+://([^/?#]*)(.*)", u or "")
        return (m[1], m[2]) if m else ("", u or "")

    first = {}
    for _, u, h in rows:
        k = (host_path(u)[0], h)
        first[k] = min(first.get(k, host_path(u)), host_path(u))
    order = sorted(first, key=lambda k: first[k])
    out = {}
    for n, k in enumerate(order):
        lines = page_lines(k[1] or "")
        has = any(inside for _, _, inside in lines)
        size = [len(t) if place != CHROME and (inside or not has) else 0 for t, place, inside in lines]
        near = [order[i] for i in (n - 1, n + 1) if 0 <= i < len(order) and order[i][0] == k[0]]
        same = lambda o: len(os.path.commonprefix([first[k][1], first[o][1]]))
        gone = set()
        for o in sorted(near, key=lambda o: -same(o)):
            found = set(shared_lines([t for t, _, _ in lines], [t for t, _, _ in page_lines(o[1] or "")]))
            if sum(size[i] for i in found) <= 0.8 * sum(size):
                gone = found
                break
        out[k] = " ".join(t for i, (t, place, inside) in enumerate(lines) if place != CHROME and (inside or not has) and (place == BODY or i not in gone))
    return {i: out[host_path(u)[0], h] for i, u, h in rows}


def test_given_pages_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.select("page_id", "url", "html").collect()]
    # and the same pages without article elements, where differencing alone tells template from text
    rows += [(10**6 + i, f"http://bare.example/{i}", (h or "").replace("<article", "<div").replace("</article>", "</div>").replace("<main", "<div").replace("</main>", "</div>")) for i, _, h in rows]
    want = brute(rows)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string"), partitions=5).collect()}
    assert got == want


def test_longest_common_subsequence():
    dice = random.Random(1)
    for _ in range(200):
        a, b = ([dice.randint(0, 6) for _ in range(dice.randint(0, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(shared_lines(a, b)) == table[-1][-1]


def test_long_and_empty(spark):
    assert len(page_lines("<p>" + "word " * 200_000)) == 1 and len(page_lines("<div>" * 20_000 + "x")) == 1
    assert texts(spark, []) == {}


@pytest.mark.parametrize(
    "markup, text",
    [
        ('<div class="menu-item-page"><p>Text of a page.</p></div>', "Text of a page."),
        ('<div class="social-studies"><p>Text of a school.</p></div>', "Text of a school."),
        ('<div id="page-with-sidebar"><p>Text beside.</p><div id="sidebar-left">Side</div></div>', "Text beside."),
        ('<article><p>Vote.</p><div class="notice-of-election"><p>On Sunday.</p></div></article>', "Vote. On Sunday."),
        ('<article><p>Text.</p><div id="discussion"><p>I disagree</p></div></article>', "Text."),
        ('<article><p>Text.</p><section class="user-reviews"><p>Five stars</p></section></article>', "Text."),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Text.</p><div class="post-footer">By x</div></article>', "Title Text."),
        ('<div class="site-header">Shop</div><div class="cookie-notice">We use</div><div class="main"><p>Text.</p></div><div class="page-footer">Legal</div><div class="related-articles">More</div>', "Text."),
    ],
)
def test_names_mean_chrome_as_a_whole_only(markup, text):
    lines = page_lines(markup)
    has_article = any(inside for _, _, inside in lines)
    assert " ".join(t for t, place, inside in lines if place != CHROME and (inside or not has_article)) == text


def test_names():
    assert all(map(marks_chrome, ("ad", "ad-slot-3", "cookieBanner".lower().replace("banner", "-banner"), "comments_area", "page-footer", "nav", "social-share-buttons")))
    assert not any(map(marks_chrome, ("", "3", "page", "admission", "share-price", "price-alert", "no-sidebar", "header-image-credit", "main", "content-list")))


def test_every_partition_boundary(spark):
    """As many partitions as pages and more, so that every page has its neighbours in other partitions, some of them empty."""
    page = "<html><body><div>Welcome</div><p>Own text of {0}, long enough to be told from the rest, {0}</p></body></html>"
    rows = [(i, f"http://h/{i:02}", page.format(i)) for i in range(12)]
    want = texts(spark, rows, partitions=1)
    assert all(x[1].startswith("Own text") for x in want.values())
    for n in (5, 12, 40):
        assert texts(spark, rows, partitions=n) == want
