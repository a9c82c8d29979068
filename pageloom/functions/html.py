"""Page columns: plain text, Markdown, regions, links and metadata of HTML.

Everything here is a JVM expression over one row, so a page never crosses into
Python and the page table is never shuffled for cleaning.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Elements whose whole content is dropped by the text cleaner.
DROPPED = ("noscript", "header", "footer", "nav", "iframe")
DROPPED_RAW = ("script", "style")
#: comments and raw elements, whichever begins first
WITHOUT_RAW = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(DROPPED_RAW)})\b[^>]*+>.*?(?:</\1\s*>|\z)"

TAG = r"""<(?:[^"'<>]++|"[^"]*"|'[^']*')*+>"""
BLOCKS = (
    "p|div|section|article|main|aside|header|footer|nav|ul|ol|dl|dt|dd|table|thead|tbody|tfoot|"
    "caption|tr|br|form|fieldset|figure|figcaption|blockquote|pre|address|html|body|h[1-6]|li"
)
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def _unquote_attr(c: Column) -> Column:
    return tx.unescape(F.regexp_replace(c, r"""\A["']|["']\z""", ""))


def attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return _unquote_attr(raw)


def without_raw(html: Column) -> Column:
    """Drop comments and the elements whose content is not markup.

    In one pass from left to right: a tag inside a comment opens nothing, nor
    does a comment inside a script.
    """
    return F.regexp_replace(html, WITHOUT_RAW, "")


def drop_elements(html: Column, tag: str) -> Column:
    """Drop every ``tag`` element with all it holds, nested ones included.

    The page is split before each opening or closing tag of that name and the
    pieces are folded with a depth counter; only depth 0 text is kept.
    """
    edge = rf"(?i)(?=<{tag}[\s>/]|</{tag}[\s>])"

    def step(acc: Column, piece: Column) -> Column:
        closes = piece.rlike(rf"(?i)\A</{tag}[\s>]")
        opens = piece.rlike(rf"(?i)\A<{tag}[\s>/]")
        depth = (
            F.when(opens, acc["depth"] + 1)
            .when(closes, F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"])
        )
        kept = F.when(closes, F.regexp_replace(piece, r"\A[^>]*>", "")).otherwise(piece)
        return F.when(
            depth == 0, F.struct(depth.alias("depth"), F.concat(acc["kept"], F.array(kept)).alias("kept"))
        ).otherwise(F.struct(depth.alias("depth"), acc["kept"].alias("kept")))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))


    def folded(page: Column) -> Column:
        return F.aggregate(
            F.split(page, edge), start, step, lambda acc: F.array_join(acc["kept"], "")
        )

    return tx.let(
        html, lambda t: F.when(t.rlike(rf"(?i)<{tag}[\s>/]"), folded(t)).otherwise(t)
    )


def page_text(html: Column, drop=DROPPED) -> Column:
    """Text of a page, one line per text node, boilerplate elements removed."""
    body = without_raw(html)
    for tag in drop:
        body = drop_elements(body, tag)
    text = tx.unescape(F.regexp_replace(F.regexp_replace(body, r"<![^>]*>", ""), TAG, "\n"))
    return tx.replace_inline_images(tx.drop_repeated_lines(tx.tidy_lines(text)))


def _tag_with_id(html: Column, element_id: str) -> Column:
    element_id = re.escape(element_id)
    return F.regexp_extract(
        html,
        rf"""(?is)(<[a-z][a-z0-9]*\s(?:[^<>]*?\s)?id\s*=\s*(?:"{element_id}"|'{element_id}'|{element_id}(?=[\s>]))[^>]*>)""",
        1,
    )


def _balanced(rest: Column, name: Column) -> Column:
    """The element that starts ``rest``: up to the end tag that closes it."""
    pieces = F.split(
        rest, F.concat(F.lit("(?i)(?=<"), name, F.lit(r"[\s>/]|</"), name, F.lit(r"[\s>])"))
    )

    def step(acc: Column, piece: Column) -> Column:
        closes = piece.startswith("</")
        depth = acc["depth"] + F.when(closes, -1).when(piece.startswith("<"), 1).otherwise(0)
        ends = closes & (depth == 0)
        kept = F.when(ends, F.regexp_extract(piece, r"\A[^>]*>", 0)).otherwise(piece)
        return F.when(
            acc["done"], acc
        ).otherwise(
            F.struct(
                depth.alias("depth"),
                ends.alias("done"),
                F.concat(acc["kept"], F.array(kept)).alias("kept"),
            )
        )

    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(False).alias("done"),
        F.array().cast("array<string>").alias("kept"),
    )
    return F.aggregate(
        F.filter(pieces, lambda p: p != ""), start, step, lambda a: F.array_join(a["kept"], "")
    )


def element_by_id(html: Column, element_id: str) -> Column:
    """The element with this id as HTML, or the empty string."""

    def cut(tag: Column) -> Column:
        name = F.regexp_extract(tag, r"\A<([A-Za-z][A-Za-z0-9]*)", 1)
        rest = F.substring(html, F.position(tag, html), F.length(html))
        return F.when(tag == "", F.lit("")).otherwise(_balanced(rest, name))

    return tx.let(_tag_with_id(html, element_id), cut)


def main_region(html: Column, keep=("main",), drop=()) -> Column:
    """Only the elements with the ``keep`` ids, less those with the ``drop`` ids.

    A page with none of the requested ids is returned unchanged.
    """

    def without_one(region: Column, element_id: str) -> Column:
        return tx.let(
            region,
            lambda r: tx.let(
                element_by_id(r, element_id),
                lambda part: F.when(part == "", r).otherwise(F.replace(r, part, F.lit(""))),
            ),
        )

    def without_dropped(region: Column) -> Column:
        for element_id in drop:
            region = without_one(region, element_id)
        return region

    def kept(page: Column) -> Column:
        region = F.concat(*[element_by_id(page, e) for e in keep])
        return tx.let(region, lambda r: F.when(r == "", page).otherwise(without_dropped(r)))

    return tx.let(html, kept)


def _lists(html: Column) -> Column:
    """List items as ``* `` or ``n. ``, numbered within their own list."""

    def step(acc: Column, piece: Column) -> Column:
        return tx.let(
            F.lower(F.regexp_extract(piece, r"(?i)\A<(/?(?:ol|ul|li))[\s>]", 1)),
            lambda opened: take(acc, piece, opened),
        )

    def take(acc: Column, piece: Column, opened: Column) -> Column:
        stack = acc["stack"]
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(-1))
        rest = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        body = F.regexp_replace(piece, r"\A<[^>]*>", "")
        first = F.coalesce(F.regexp_extract(piece, r"""(?i)\A<ol[^>]*\sstart\s*=\s*["']?(\d{1,8})""", 1).try_cast("int"), F.lit(1))

        def out(new_stack: Column, prefix: Column) -> Column:
            return F.struct(
                new_stack.alias("stack"),
                F.concat(acc["kept"], F.array(F.concat(prefix, body))).alias("kept"),
            )

        nl = F.lit("\n")
        return (
            F.when(opened == "ol", out(F.concat(stack, F.array(first)), nl))
            .when(opened == "ul", out(F.concat(stack, F.array(F.lit(-1))), nl))
            .when(opened.isin("/ol", "/ul"), out(rest, nl))
            .when((opened == "li") & (top >= 0), out(
                F.concat(rest, F.array(top + 1)), F.concat(nl, top.cast("string"), F.lit(". "))))
            .when(opened == "li", out(stack, F.lit("\n* ")))
            .when(opened == "/li", out(stack, nl))
            .otherwise(F.struct(stack.alias("stack"), F.concat(acc["kept"], F.array(piece)).alias("kept")))
        )

    start = F.struct(
        F.array().cast("array<int>").alias("stack"), F.array().cast("array<string>").alias("kept")
    )

    def folded(page: Column) -> Column:
        return F.aggregate(
            F.split(page, r"(?i)(?=</?(?:ol|ul|li)[\s>])"),
            start,
            step,
            lambda a: F.array_join(a["kept"], ""),
        )

    return tx.let(html, lambda t: F.when(t.rlike(r"(?i)<li[\s>]"), folded(t)).otherwise(t))


def _tables(html: Column) -> Column:
    """Cells joined by ``|``; a rule line after the first row of each table."""

    def one(piece: Column) -> Column:
        head = F.regexp_extract(piece, r"(?is)\A<table.*?</tr\s*>", 0)
        width = F.size(F.regexp_extract_all(head, F.lit(r"(?i)<t[dh][\s>]"), F.lit(0)))
        rule = F.concat(F.lit("\n"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("\n"))
        return F.when(
            head != "", F.concat(head, rule, F.substring(piece, F.length(head) + 1, F.length(piece)))
        ).otherwise(piece)


    def joined(page: Column) -> Column:
        ruled = F.array_join(F.transform(F.split(page, r"(?i)(?=<table[\s>])"), one), "")
        return F.regexp_replace(ruled, r"(?i)</t[dh]\s*>\s*<t[dh](?:\s[^>]*)?>", "| ")

    return tx.let(html, lambda t: F.when(t.rlike(r"(?i)<table[\s>]"), joined(t)).otherwise(t))


def page_markdown(html: Column) -> Column:
    """Markdown of a page: headings, lists, links, images, emphasis, tables."""
    body = F.regexp_replace(without_raw(html), r"(?is)<head[\s>].*?</head\s*>|<![^>]*>", "")
    # white space means nothing outside <pre>
    body = F.array_join(
        F.transform(
            F.split(body, r"(?i)(?=<pre[\s>])|(?<=</pre>)"),
            lambda p: F.when(p.rlike(r"(?i)\A<pre[\s>]"), p).otherwise(tx.squeeze(p)),
        ),
        "",
    )
    # a text node that would read as a list item is escaped
    body = F.regexp_replace(body, r"(>\s*\d+)\.(?=\s)", r"$1\\.")
    body = F.regexp_replace(body, r"(>\s*)([-+])(?=\s)", r"$1\\$2")
    body = F.regexp_replace(body, r"(?i)<hr(?:\s[^>]*)?/?>", "\n* * *\n")
    body = _tables(_lists(body))
    body = F.regexp_replace(body, r"(?i)<h([1-6])(?:\s[^>]*)?>\s*", "\n\x04$1 ")
    for level in range(1, 7):
        body = F.replace(body, F.lit(f"\x04{level}"), F.lit("#" * level))
    body = F.regexp_replace(body, r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**")
    body = F.regexp_replace(body, r"(?i)</?(?:i|em|u)(?:\s[^>]*)?>", "_")
    body = F.regexp_replace(
        body,
        r"""(?is)<img(?=\s)(?=[^>]*\ssrc\s*=\s*["']([^"']*)["'])(?:(?=[^>]*\salt\s*=\s*["']([^"']*)["']))?[^>]*>""",
        r"![$2]($1)",
    )
    body = F.regexp_replace(body, r"""(?is)<a(?=\s)[^>]*\shref\s*=\s*["']#[^"']*["'][^>]*>(.*?)</a\s*>""", "$1")
    # \x{2} and \x{3} stand for the angle brackets of an automatic link
    body = F.regexp_replace(
        body,
        r"""(?is)<a(?=\s)[^>]*\shref\s*=\s*["']([a-z]+://[^"']*)["'][^>]*>\1</a\s*>""",
        "\x02$1\x03",
    )
    body = F.regexp_replace(
        body,
        r"""(?is)<a(?=\s)[^>]*\shref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""",
        "[$2]($1)",
    )
    body = F.regexp_replace(body, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n")
    text = tx.unescape(F.regexp_replace(body, TAG, ""))
    text = F.translate(text, "\x02\x03", "<>")
    return tx.clean_markdown(tx.replace_inline_images(tx.strip(text)))


def inner_text(fragment: Column) -> Column:
    return tx.strip(tx.unescape(F.regexp_replace(fragment, TAG, "")))


def title(html: Column) -> Column:
    return inner_text(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))


def hrefs(html: Column, drop_anchors: bool = False) -> Column:
    """Raw link targets in page order; script links and empty ones are dropped."""
    found = F.transform(
        F.regexp_extract_all(without_raw(html), F.lit(HREF), F.lit(1)), _unquote_attr
    )
    return F.filter(
        found,
        lambda h: (h != "")
        & ~h.startswith("javascript:")
        & (F.lit(not drop_anchors) | (h != "#")),
    )


def headings(html: Column) -> Column:
    """``array<struct<level,text>>`` of h1 to h6, level by level."""

    def of_level(body: Column, level: int) -> Column:
        found = F.regexp_extract_all(
            body, F.lit(rf"(?is)<h{level}(?:\s[^>]*)?>(.*?)</h{level}\s*>"), F.lit(1)
        )
        return F.transform(
            found, lambda h: F.struct(F.lit(level).alias("level"), inner_text(h).alias("text"))
        )

    return tx.let(
        without_raw(html),
        lambda body: F.filter(
            F.concat(*[of_level(body, n) for n in range(1, 7)]), lambda h: h["text"] != ""
        ),
    )


def images(html: Column) -> Column:
    tags = F.regexp_extract_all(without_raw(html), F.lit(r"(?is)<img\s[^>]*>"), F.lit(0))
    return F.filter(
        F.transform(
            tags,
            lambda t: F.struct(attribute(t, "src").alias("src"), attribute(t, "alt").alias("alt")),
        ),
        lambda i: i["src"] != "",
    )


def meta_tags(html: Column) -> Column:
    """``array<struct<key,value>>``: meta_description, meta_keywords and og_*."""
    tags = F.regexp_extract_all(without_raw(html), F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))

    def pair(tag: Column) -> Column:
        name = F.lower(attribute(tag, "name"))
        prop = F.lower(attribute(tag, "property"))
        key = F.when(name.isin("description", "keywords"), F.concat(F.lit("meta_"), name)).when(
            prop.startswith("og:"), F.concat(F.lit("og_"), F.substring(prop, 4, 2048))
        )
        return F.struct(key.alias("key"), attribute(tag, "content").alias("value"))

    return F.filter(F.transform(tags, pair), lambda p: p["key"].isNotNull() & (p["value"] != ""))


def metadata(html: Column) -> Column:
    """Metadata of a page as one map: title, meta_* and og_*; the last one wins."""
    pairs = F.concat(
        F.array(F.struct(F.lit("title").alias("key"), title(html).alias("value"))),
        meta_tags(html),
    )

    def last_wins(acc: Column, p: Column) -> Column:
        return F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p))

    start = F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(
        F.aggregate(F.filter(pairs, lambda p: p["value"] != ""), start, last_wins)
    )
