"""Text and Markdown columns.

Line work is done with whole-string regular expressions wherever that says the
same thing: they run inside generated code, while array lambdas do not.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as one character class. The same text is valid for
# java.util.regex and RE2.
_OTHERS = (
    r"\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK = f"[ {_OTHERS}]"  # white space but for the line feed
SPACE = rf"[\n {_OTHERS}]"
# what a squeeze must touch: a single space stays as it is
_BLANK_RUN = f"{BLANK}(?:{BLANK}+|(?<! ))"
_SPACE_RUN = f"{SPACE}(?:{SPACE}+|(?<! ))"

# Inline image payloads that are taken out of Markdown.
INLINE_IMAGE = r"data:image/(?:png|jpeg|jpg);base64,"

LINK = r"\[([^\n]*?)\]\(([^\n]*?)\)"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE_RUN, " ")


def content_hash(c: Column) -> Column:
    """SHA-256 of the raw content; nothing hashes to the empty string."""
    return F.when(c.isNull() | (F.length(c) == 0), F.lit("")).otherwise(F.sha2(c, 256))


def tidy_lines(c: Column) -> Column:
    """Trim every line, squeeze its blanks, drop empty lines."""
    one_blank = F.regexp_replace(c, _BLANK_RUN, " ")
    no_empty = F.regexp_replace(one_blank, r" ?\n[ \n]*", "\n")
    return F.btrim(no_empty, F.lit(" \n"))


def clean_markdown(c: Column) -> Column:
    """Tidy lines; a line that held an inline image stays as an empty line."""
    return F.regexp_replace(tidy_lines(c), rf"(?<![^\n])[^\n]*?{INLINE_IMAGE}[^\n]*", "")


def clean_plain(c: Column) -> Column:
    return tidy_lines(c)


def drop_repeated_lines(c: Column) -> Column:
    """Drop a line equal to the line before it."""
    return F.regexp_replace(c, r"(?<![^\n])([^\n]*+)(?:\n\1(?![^\n]))++", "$1")


def markdown_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LINK), F.lit(2))


def replace_inline_images(c: Column) -> Column:
    return F.regexp_replace(
        c, rf"(\[[^\n]*?\]\(){INLINE_IMAGE}[^)\n]*\)", "$1base64_image)"
    )


def flatten_tables(c: Column) -> Column:
    """Markdown tables as ``header: cell`` lines, an empty line after each row.

    A fold over the lines of one text: no shuffle, and rows without a table
    pass through untouched.
    """
    state = (
        "struct<header:array<string>,after_header:boolean,lines:array<string>>"
    )

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(line, r"\A\|+|\|+\z", ""), r"\|"), strip)

    def put(acc: Column, header, after_header, lines: Column) -> Column:
        return F.struct(
            header.alias("header"), after_header.alias("after_header"), lines.alias("lines")
        )

    def step(acc: Column, raw: Column) -> Column:
        return let(strip(raw), lambda line: take(acc, raw, line))

    def take(acc: Column, raw: Column, line: Column) -> Column:
        is_row = line.rlike(r"\A\|.*\|")
        header = acc["header"]
        no_header = F.lit(None).cast("array<string>")
        pairs = F.filter(
            F.zip_with(
                F.slice(header, 1, F.least(F.size(header), F.size(cells(raw)))),
                cells(raw),
                lambda h, x: F.when(h.isNotNull() & (x != ""), F.concat(h, F.lit(": "), x)),
            ),
            lambda x: x.isNotNull(),
        )
        return (
            F.when(~is_row, put(acc, no_header, F.lit(False), F.concat(acc["lines"], F.array(line))))
            .when(header.isNull(), put(acc, cells(line), F.lit(True), acc["lines"]))
            .when(
                acc["after_header"] & line.rlike(r"\A\|[\s\-:]+\|"),
                put(acc, header, F.lit(False), acc["lines"]),
            )
            .otherwise(
                put(acc, header, F.lit(False), F.concat(acc["lines"], pairs, F.array(F.lit(""))))
            )
        )

    start = F.struct(
        F.lit(None).cast("array<string>").alias("header"),
        F.lit(False).alias("after_header"),
        F.array().cast("array<string>").alias("lines"),
    ).cast(state)
    folded = F.aggregate(
        F.split(c, "\n"), start, step, lambda acc: F.array_join(acc["lines"], "\n")
    )
    return F.when(c.rlike(r"\|[^\n]*\|"), folded).otherwise(c)


def words(c: Column) -> Column:
    """White-space tokens, empty ones dropped."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    body = strip(c)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, f"{SPACE}+")))


def terms(c: Column) -> Column:
    """Lower-case letter and digit runs: the tokens of search and embedding."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def rewrite_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def preview(c: Column, size: int) -> Column:
    return F.coalesce(F.substring(c, 1, size), F.lit(""))


def contains_ci(c: Column, needle: Column | str) -> Column:
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(c), F.lower(needle))


def highlight(content: Column, query: Column) -> Column:
    """Wrap query words of two or more characters in ``<strong>``."""
    marked = F.aggregate(
        F.filter(words(query), lambda w: F.length(w) >= 2),
        content,
        lambda text, w: F.regexp_replace(
            text, F.concat(F.lit(r"(?iu)(\Q"), w, F.lit(r"\E)")), F.lit("<strong>$1</strong>")
        ),
    )
    done = content.contains("<em>") | content.contains("<strong>")
    return (
        F.when(content.isNull() | (content == ""), F.lit(""))
        .when(done, content)
        .otherwise(marked)
    )


def flatten_content(c: Column) -> Column:
    """Message content: a plain string, or a JSON list of ``{"text": …}`` parts."""
    parts = F.from_json(c, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return F.when(c.rlike(r"\A\s*\[\s*\{"), F.coalesce(joined, c)).otherwise(c)


def integer_keys(c: Column) -> Column:
    """JSON object of term id to weight, with integer keys."""
    return F.transform_keys(
        F.from_json(c, "map<string,double>"), lambda k, _: k.cast("int")
    )


_NAMED = {name: chr(code) for name, code in name2codepoint.items() if name != "amp"}
_NAMED["apos"] = "'"
# one expression text: building it from single literals costs a call each
_NAMED_MAP = "map({})".format(
    ",".join(f"'{name}',decode(unhex('{char.encode().hex()}'),'UTF-8')" for name, char in sorted(_NAMED.items()))
)


def unescape(c: Column) -> Column:
    """Resolve character references; ``&amp;`` last, so nothing is read twice."""
    table = F.expr(_NAMED_MAP)

    def code_point(ref: Column) -> Column:
        number = F.when(
            F.lower(F.substring(ref, 1, 1)) == "x", F.conv(F.substring(ref, 2, 8), 16, 10)
        ).otherwise(ref)
        return F.decode(F.unhex(F.lpad(F.hex(number.cast("bigint")), 8, "0")), "UTF-32")

    def named(t: Column) -> Column:
        return F.aggregate(
            F.array_distinct(F.regexp_extract_all(t, F.lit(r"&([A-Za-z][A-Za-z0-9]*);"), F.lit(1))),
            t,
            lambda text, n: F.replace(
                text,
                F.concat(F.lit("&"), n, F.lit(";")),
                F.coalesce(F.try_element_at(table, n), F.concat(F.lit("&"), n, F.lit(";"))),
            ),
        )

    def numbered(t: Column) -> Column:
        return F.when(
            t.contains("&#"),
            F.aggregate(
                F.array_distinct(
                    F.regexp_extract_all(t, F.lit(r"&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(1))
                ),
                t,
                lambda text, n: F.replace(
                    text, F.concat(F.lit("&#"), n, F.lit(";")), code_point(n)
                ),
            ),
        ).otherwise(t)

    return let(
        c,
        lambda t: F.when(
            t.contains("&"), F.replace(let(named(t), numbered), F.lit("&amp;"), F.lit("&"))
        ).otherwise(t),
    )
