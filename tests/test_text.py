from pyspark.sql import functions as F

from pageloom.functions import labels, text as tx, urls as u

T = F.col("t")


def test_markdown_links(one):
    md = "See ![plan](maps/floor.svg), then [the *long* guide](/guide?p=2)."
    assert one(tx.markdown_links(T), t=md) == ["maps/floor.svg", "/guide?p=2"]


def test_inline_images(one):
    assert one(tx.replace_inline_images(T), t="a ![](data:image/png;base64,QUJD+/=) b") == "a ![](base64_image) b"
    assert one(tx.replace_inline_images(T), t="[f](data:image/gif;base64,x)") == "[f](data:image/gif;base64,x)"


def test_clean_markdown_keeps_the_line_of_an_image_as_empty(one):
    md = "\t# Top \n![logo](data:image/jpeg;base64,Zm9v)\n\n\n   - last item\t"
    assert one(tx.clean_markdown(T), t=md) == "# Top\n\n- last item"


def test_plain_text_and_unicode_space(one):
    assert one(tx.clean_plain(T), t="　a   b\t\n \n\r\nc ") == "a b\nc"
    assert one(tx.squeeze(T), t="a  b\n\nc d") == "a b c d"


def test_repeated_lines(one):
    assert one(tx.drop_repeated_lines(T), t="a\na\na\nb\nab\nab\na") == "a\nb\nab\na"
    many = "\n".join(["same"] * 50_000)
    assert one(tx.drop_repeated_lines(T), t=many) == "same"


def test_flatten_tables(one):
    md = "intro\n| A | B |\n|---|---|\n| 1 | 2 |\n| 3 |  |\nend | x"
    assert one(tx.flatten_tables(T), t=md) == "intro\nA: 1\nB: 2\n\nA: 3\n\nend | x"
    assert one(tx.flatten_tables(T), t="no table | here") == "no table | here"


def test_unescape(one):
    text = "a &amp;lt; &lt; &copy; &#233; &#x4e2d; &zzz; &apos;"
    assert one(tx.unescape(T), t=text) == "a &lt; < © é 中 &zzz; '"


def test_highlight(one):
    q = F.col("q")
    assert one(tx.highlight(T, q), t="The cat. sat", q="the a t.") == "<strong>The</strong> ca<strong>t.</strong> sat"
    assert one(tx.highlight(T, q), t="<em>x</em> the", q="the") == "<em>x</em> the"


def test_content_and_lines(one):
    assert one(tx.flatten_content(T), t='[{"text":"a"},{"type":"img"},{"text":"b"}]') == "a\n\nb"
    assert one(tx.flatten_content(T), t="plain [x]") == "plain [x]"
    assert one(tx.rewrite_lines(T), t="one\ntwo\n \nthree ") == ["one", "two", "three"]
    assert one(tx.integer_keys(T), t='{"7": 0.5}') == {7: 0.5}


def test_hash(one):
    assert one(tx.content_hash(T), t="") == ""
    assert one(tx.content_hash(T), t="a").startswith("ca978112")


def test_url_resolution(one):
    cases = [
        ("http://h.com/a/b?x=1#f", "/En", "http://h.com/En/"),
        ("http://h.com/a/b", "../c/./d.html?q#z", "http://h.com/c/d.html?q"),
        ("http://h.com/a/b", "//o.com/x", "http://o.com/x/"),
        ("http://h.com/a/b", "?p=2", "http://h.com/a/b/?p=2"),
        ("http://h.com", "x%252520y", "http://h.com/x y/"),
        ("http://h.com/a", "50%+c", "http://h.com/50%+c/"),
        ("http://h.com/a/b/c", "..", "http://h.com/a/"),
        ("http://h.com/a/b", "", "http://h.com/a/b/"),
        ("http://h.com/", "p;v=1", "http://h.com/p/;v=1"),
        ("http://h.com/a", "HTTPS://H.com", "https://H.com/"),
    ]
    for base, href, want in cases:
        assert one(u.absolute(F.col("b"), F.col("h")), b=base, h=href) == want, (base, href)


def test_scope_and_pattern(one):
    c = F.col("t")
    assert one(u.in_scope(c, ["/docs"], ["draft"]), t="http://a.com/docs/1#draft") is True
    assert one(u.in_scope(c, ["/docs"], ["draft"]), t="http://a.com/docs/draft") is False
    assert one(u.in_scope(c), t="ftp://a.com/") is False
    assert one(u.matches_task(c, "b"), t="ab") is False
    assert one(u.matches_task(c, "*"), t="ab") is True
    assert one(u.matches_task(c, "("), t="ab") is True


def test_titles_and_mime(one):
    assert one(u.title_from_url(T), t="http://h.com/x/My%20File.pdf") == "My File"
    assert one(u.title_from_url(T), t="http://h.com") == "h.com"
    assert len(one(u.cap_title(T), t="x" * 300)) == 248
    assert one(u.mime_of_file(T), t="a.PDF") == "application/pdf"
    assert one(u.key_hash(T), t="site:a:b") == "a:b"


def test_labels(one):
    ts, now = F.col("t").cast("timestamp"), F.col("n").cast("timestamp")
    at = lambda t: one(labels.relative_date(ts, now), t=t, n="2024-03-02 10:00:00")
    assert at("2024-03-02 09:05:00") == "今天 09:05"
    assert at("2024-03-01 23:59:00") == "昨天 23:59"
    assert at("2024-01-05 00:00:00") == "1/5"
    assert at("2023-12-31 00:00:00") == "2023/12/31"
    d = lambda t: one(labels.duration(F.col("t").cast("double")), t=t)
    assert [d("0.0005"), d("0.5"), d("6"), d("130.5")] == ["500.00µs", "500.00ms", "6.00秒", "2分11秒"]
