"""Operator 11: the parser, the matching against its definition, wrappers of hosts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import html_wrapper as m

SCHEMA = "page_id long, url string, html string"
NAMES = ["row", "host", "trees", "blocks", "weak", "strong", "longest", "class", "title", "c", "v"]


def texts(df):
    return {r.page_id: "\n\n".join(r.blocks) for r in df.collect()}


def paragraph(r, n=30):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(n)).capitalize() + "."


def blocks(source):
    return m.read_page(source).texts


@pytest.mark.parametrize("source,want", [
    ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<p><b>one<br><p>two</b> three", ["one", "two three"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>d", ["a", "b", "c", "d"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
    ("x &amp; y &lt;z&gt; &#233;&hellip; &nbsp; w", ["x & y <z> é… w"]),
    ("<p title='a > b'>in<!-- <p>no</p> -->side</p>", ["inside"]),
    ("<script>var t='</p><p>x';</script>a<style>p{}</style>b", ["ab"]),
    ("<p>a</b></i></p></div>b", ["a", "b"]),
    ("<div>a<p>b</div>c<", ["a", "b", "c<"]),
    ("1 < 2 and <3", ["1 < 2 and <3"]),
    ("<p>never ended <!-- comment", ["never ended"]),
    ("<script>never ended", []),
    ("", []),
    (None, []),
    ("<div>" * 3000 + "deep" + "</div>" * 3000 + "after", ["deep", "after"]),
])
def test_blocks_of_broken_markup(source, want):
    assert blocks(source) == want


def naive(a, b):
    """Simple tree matching as it is defined, with one more for equal texts."""
    if a.label != b.label:
        return 0
    if a.leaf >= 0:
        return 1 + (a.code == b.code)
    grid = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            grid[i + 1][j + 1] = max(grid[i][j + 1], grid[i + 1][j], grid[i][j] + naive(x, y))
    return 1 + grid[-1][-1]


def tree(r, depth=3):
    out = m.Node(r.choice("dp"))
    for _ in range(r.randint(0, 4)):
        if depth and r.random() < 0.5:
            out.kids.append(tree(r, depth - 1))
        else:
            leaf = m.Node("#", 0)
            leaf.code = r.randint(1, 4)
            out.kids.append(leaf)
    return out


def numbered(root):
    number, waiting = 0, [root]
    while waiting:
        node = waiting.pop()
        if node.leaf >= 0:
            node.leaf = number
            number += 1
        waiting.extend(reversed(node.kids))
    m._measure(root)
    return root


def copy(node):
    out = m.Node(node.label, node.leaf)
    out.code, out.kids = node.code, [copy(k) for k in node.kids]
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_matching_is_the_best_one(seed):
    r = random.Random(seed)
    a, b = m.Node("r"), m.Node("r")
    a.kids, b.kids = [tree(r) for _ in range(3)], [tree(r) for _ in range(3)]
    if r.random() < 0.5:
        b.kids[r.randrange(3)] = copy(a.kids[r.randrange(3)])
    a, b = numbered(a), numbered(b)
    assert m.Matching().weight(a, b) == naive(a, b)
    pairs = []
    assert m.Matching()._best(a.kids, b.kids, pairs) == sum(naive(x, y) for x, y in pairs) == naive(a, b) - 1
    where = sorted(([id(n) for n in a.kids].index(id(x)), [id(n) for n in b.kids].index(id(y))) for x, y in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(where, where[1:]))
    found = []
    m.Matching().equal_leaves(a, b, found)
    assert len({x for x, _ in found}) == len(found) == len({y for _, y in found})
    if a.code == b.code:
        assert len(found) == len(m._leaves(a))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(2, 40))
def test_long_lists_are_matched_as_short_ones(seed, n):
    """The results do not depend on the length from which on lists are matched in arrays."""
    r = random.Random(seed)
    a, b = m.Node("r"), m.Node("r")
    a.kids, b.kids = ([tree(r, r.randint(0, 2)) for _ in range(r.randint(1, n))] for _ in range(2))
    for kid in r.sample(a.kids, len(a.kids) // 3):
        b.kids.insert(r.randint(0, len(b.kids)), copy(kid))
    a, b = numbered(a), numbered(b)
    got = []
    for limit in (10**9, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(m, "IN_DEPTH", limit)
            patch.setattr(m, "REMEMBERED", r.choice((3, 1 << 20)), raising=False)
            pairs, found = [], []
            weight, total = m.Matching().weight(a, b), m.Matching()._best(a.kids, b.kids, pairs)
            m.Matching().equal_leaves(a, b, found)
            got.append((weight, total, [(id(x), id(y)) for x, y in pairs], found, m.Matching()._best(a.kids, b.kids, None)))
    assert got[0] == got[1]


def test_a_long_list_of_different_children_is_matched_in_depth():
    """3,000 children on both sides, whose names differ and whose line below does not."""
    page, other = (m.read_page("".join(f"<div><p>{who} {i}</p><p>a line that all have</p></div>" for i in range(3000))) for who in ("one", "two"))
    assert len(m.votes(page, other.root)) == 3000


def site(r, n, host="news.example.org"):
    """Pages without any telling names: menu, teaser list, article, box, footer in plain divs."""
    rows, want = [], {}
    for i in range(n):
        body = [paragraph(r) for _ in range(r.randint(2, 6))]
        promo = "<div><p>Read our weekly letter, it is free and comes on Monday.</p></div>" if i % 3 else ""
        page = (f"<html><head><title>t{i}</title></head><body><div><a href=/>Home</a> <a href=/n>News of the day</a></div>"
                f"{promo}<div><h2>{paragraph(r, 3)}</h2>" + "".join(f"<p>{p}</p>" for p in body) + "</div>"
                f"<div><p>All rights are with the makers of this paper since 1950.</p><p>Contact us by mail or by phone.</p></div>")
        rows.append((i, f"https://{host}/{i}", page))
        want[i] = body
    return rows, want


@pytest.mark.parametrize("sent", [1 << 30, -1])
def test_constant_blocks_of_a_host_go(spark, monkeypatch, sent):
    monkeypatch.setattr(m, "SENT_BYTES", sent)
    monkeypatch.setattr(m, "SENT_HOSTS", sent)
    rows, want = site(random.Random(3), 24)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = texts(m.main_texts(df))
    for i, body in want.items():
        assert got[i].split("\n\n")[1:] == body, i


def test_copies_of_an_article_are_no_template(spark):
    r = random.Random(5)
    same = "".join(f"<p>{paragraph(r)}</p>" for _ in range(4))
    rows = [(i, f"http://a.example.com/{i}", f"<title>{i}</title><nav><a>menu {i}</a></nav><article><h1>Number {i}</h1>{same}"
             "<p>Share this with your friends</p></article>") for i in range(12)]
    other = [(20 + i, f"http://a.example.com/{20 + i}", f"<title>{i}</title><article><p>{paragraph(r)}</p><p>{paragraph(r)}</p>"
              "<p>Share this with your friends</p></article>") for i in range(8)]
    got = texts(m.main_texts(spark.createDataFrame(rows + other, SCHEMA)))
    for i in range(12):
        assert got[i].startswith(f"Number {i}\n\n") and got[i].count("\n\n") == 4 and "Share" not in got[i]
    assert all("Share" not in got[20 + i] and got[20 + i].count("\n\n") == 1 for i in range(8))


PAGE = """<!doctype html><html><body class="has-sidebar no-ads"><div id="cookie-notice"><p>We use cookies.</p></div>
<header class="site-header"><h1>The Paper</h1><form><input><label>Find</label></form></header><nav>Home News</nav>
<div class="layout with-sidebar"><main><article class="post"><header class="entry-header"><h1>A title</h1></header>
<p>First   text&nbsp;with <a href=x>a link</a>.</p><div class="ad-slot">Buy now</div><ul><li>one<li>two</ul>
<aside>Also read</aside><blockquote>said</blockquote><footer>Tags: x</footer></article>
<section id="comments"><article class="comment"><p>I disagree with all of this, and at some length.</p></article></section></main>
<div class="sidebar">Most read</div></div><div role="dialog">Subscribe</div><p hidden>never seen</p><footer>(c)</footer></body></html>"""


def test_tags_roles_and_names(spark):
    df = spark.createDataFrame([(1, "https://x.example.org/a", PAGE), (2, None, PAGE)], SCHEMA)
    want = "A title\n\nFirst text with a link.\n\none\n\ntwo\n\nsaid"
    assert texts(m.main_texts(df)) == {1: want, 2: want}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://h.example.org", "no tags at all"), (None, "http://h.example.org/x", "<nav>menu only</nav>"),
            (5, "http://h.example.org/y", "<p>twice</p>"), (5, "http://h.example.org/y", "<p>twice</p>"),
            (6, "http://h.example.org/z", "<div>" + "<p>row</p>" * 30_000 + "</div>"), (7, "nonsense", "<p>😀 é</p>"),
            (8, "http://h.example.org/w", "<div>" + "".join(f"<p>row {i}</p>" for i in range(300)) + "</div>")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in NAMES:
        df = df.withColumn(name, df.url)
    got = [(r.page_id, "\n\n".join(r.blocks)) for r in m.main_texts(df).collect()]
    assert len(got) == len(rows) and got.count((5, "twice")) == 2
    by = dict(got)
    assert by[1] == by[2] == by[None] == "" and by[3] == "no tags at all"
    assert by[6].count("row") == 30_000 and by[8].count("row") == 300
    assert m.main_texts(df.limit(0)).count() == 0


def test_query_gives_every_page_of_the_table(spark, small_dir):
    from pageloom.llm import queries

    pages = {r.page_id: r for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.QUERIES["op11_html_extraction"](spark, small_dir).collect()}
    assert set(got) == set(pages)
    for i, r in got.items():
        assert r.url == pages[i].url and r.n_chars == len(r.text)
        inner = pages[i].html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        assert r.text.split("\n\n")[0] == " ".join(__import__("html").unescape(inner.split("<h1>")[1].split("</h1>")[0]).split())
