from pyspark.sql import functions as F

from pageloom.functions import html as h
from pageloom.operators import cleaning

T = F.col("t")
PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><meta name="description" content="D &quot;q&quot;">
<meta property="og:title" content="OG"><style>p{}</style><script>var t="</p><a href='/no'>";</script></head>
<body><header>top <nav>menu</nav></header><!-- <p>no</p> -->
<div id="main" class="k"><h1>Head</h1><p>Hello <b>bold</b> <i>it</i> <a href='/y'>link</a> <a href="#t">top</a>
<a href="http://q.com/">http://q.com/</a><br>next<div>in<div>deep</div></div>
<ul><li>one<ol start="3"><li>n1</li><li>n2</li></ol></li><li>two</li></ul>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><img alt="al" src="i.png">
<p>1. not list</p><pre>x  y
z</pre><div id="crumb">crumb<div>c2</div></div></div><footer>f<nav>n</nav>oot</footer></body></html>"""


def test_text_has_no_boilerplate(one):
    out = one(h.page_text(T), t=PAGE)
    for gone in ("menu", "top \n", "oot", "var t", "<", "no"):
        assert gone not in out.replace("not list", "") or gone == "no"
    assert out.split("\n")[:4] == ["A & B", "Head", "Hello", "bold"]


def test_markdown(one):
    lines = one(h.page_markdown(h.main_region(T, ("main",), ("crumb",))), t=PAGE).split("\n")
    assert lines == [
        "# Head", "Hello **bold** _it_ [link](/y) top <http://q.com/>", "next", "in", "deep",
        "* one", "3. n1", "4. n2", "* two", "A| B", "---|---", "1| 2", "![al](i.png)", "1\\. not list", "x y", "z",
    ]


def test_main_region(one):
    out = one(h.main_region(T, ("main",), ("crumb",)), t=PAGE)
    assert out.startswith('<div id="main"') and out.endswith("</div>") and "crumb" not in out and "foot" not in out
    assert one(h.main_region(T, ("content",)), t=PAGE) == PAGE


def test_nested_elements_go_as_a_whole(one):
    assert one(h.drop_elements(T, "nav"), t="a<nav>b<nav>c</nav>d</nav>e</nav>f") == "aef"
    assert one(h.drop_elements(T, "nav"), t="a<nav>b") == "a"
    assert one(h.drop_elements(T, "nav"), t="a<navy>b") == "a<navy>b"


def test_metadata(one):
    assert one(h.metadata(T), t=PAGE) == {"title": "A & B", "meta_description": 'D "q"', "og_title": "OG"}
    assert [tuple(x) for x in one(h.headings(T), t=PAGE)] == [(1, "Head")]
    assert [tuple(x) for x in one(h.images(T), t=PAGE)] == [("i.png", "al")]
    assert one(h.hrefs(T), t=PAGE) == ["/y", "#t", "http://q.com/"]
    assert one(h.hrefs(T, True), t="<a href='#'>x</a><a class=k href=/z>z</a><a href='javascript:x'>") == ["/z"]


def test_routing(one):
    def route(url, mime, content, strategies=cleaning.STRATEGIES):
        return one(cleaning.route(F.col("u"), F.col("m"), F.col("c"), strategies), u=url, m=mime, c=content)

    site = cleaning.page_strategies(search_paths=("find-people",))
    assert route("http://a/find-people", "text/html", '<p id="content">', site) == "search_page"
    assert route("http://a/find-people", "text/html", '<p id="content">') == "markdown"
    assert route("http://a/page/1", "text/html", '<p id="main">') == "common_page"
    assert route("http://a/x", "text/html;charset=x", "") == "markdown"
    assert route("http://a/x", "text/plain", "") == "plain"
    assert route("http://a/x", "text/csv", "") == "unchanged"


HIDDEN = """x<!-- <script> --><p>seen <a href='/a?x=1&amp;b=2'>t</a></p><style><a href='/no'></style>
<script>var c = "<!--";</script><a href=/z>end</a>"""


def test_a_tag_in_a_comment_opens_nothing(one):
    assert one(h.page_text(T), t=HIDDEN).split("\n")[-3:] == ["seen", "t", "end"]
    assert one(h.hrefs(T), t=HIDDEN) == ["/a?x=1&b=2", "/z"]
    assert one(h.page_markdown(T), t=HIDDEN).endswith("seen [t](/a?x=1&b=2)\nend")


def test_table_function_gives_the_same_links(spark, one):
    from pageloom import hooks

    hooks.register_page_links(spark)
    pages = spark.createDataFrame([(HIDDEN,), (PAGE,)], "html string")
    pages.createOrReplaceTempView("hidden_pages")
    got = spark.sql("SELECT href FROM hidden_pages, LATERAL page_links(html)").collect()
    want = one(h.hrefs(T), t=HIDDEN) + one(h.hrefs(T), t=PAGE)
    assert sorted(r.href for r in got) == sorted(want)
