"""URL columns: resolution, normalisation, scope tests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"\A[^?#]*\?([^#]*)"

# Extension to MIME type for attachments and uploads.
MIME_BY_EXTENSION = {
    "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "gif": "image/gif",
    "htm": "text/html",
    "html": "text/html",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "json": "application/json",
    "md": "text/markdown",
    "pdf": "application/pdf",
    "png": "image/png",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xml": "text/xml",
    "zip": "application/zip",
}

# Content types that are kept.
TEXT_TYPES = (
    "text/plain", "text/csv", "text/xml", "text/javascript",
    "text/css", "text/html", "text/markdown",
)
BINARY_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)


def any_of(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*\z", "")


def percent_decode(c: Column, rounds: int = 5) -> Column:
    """Decode percent escapes until nothing changes, at most ``rounds`` times.

    A plus sign is kept, and a percent sign that starts no escape is literal.
    """

    def decoded(text: Column) -> Column:
        for _ in range(rounds):
            safe = F.regexp_replace(
                F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25"
            )
            text = F.try_url_decode(safe)
        return text

    return let(c, lambda t: F.when(t.contains("%"), decoded(t)).otherwise(t))


def _without_dots(p: Column) -> Column:
    def folded(path_text: Column) -> Column:
        kept = F.aggregate(
            F.split(path_text, "/"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(
                s == "..",
                F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc),
            )
            .otherwise(F.concat(acc, F.array(s))),
        )
        end = F.when(path_text.rlike(r"(\A|/)\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.array_join(kept, "/"), end)

    return let(
        p, lambda t: F.when(t.rlike(r"(\A|/)\.\.?(/|\z)"), folded(t)).otherwise(t)
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on page ``base``."""

    def resolved(href: Column) -> Column:
        root = F.concat(scheme(base), F.lit("://"), host(base))
        folder = F.coalesce(
            F.nullif(F.regexp_extract(path(base), r"\A(.*/)", 1), F.lit("")), F.lit("/")
        )
        tail = F.regexp_extract(href, r"(?s)\A[^?#]*(.*)\z", 1)
        return (
            F.when(href.rlike(SCHEME), href)
            .when(
                href.startswith("/") & ~href.startswith("//"),
                F.concat(root, _without_dots(path(href)), tail),
            )
            .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
            .when(href == "", base)
            .when(href.startswith("#"), F.concat(without_fragment(base), href))
            .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"(?s)[?#].*\z", ""), href))
            .otherwise(F.concat(root, _without_dots(F.concat(folder, path(href))), tail))
        )

    return let(href, resolved)


def normalize(url: Column) -> Column:
    """Decode, drop the fragment, close a last segment without a dot by ``/``."""

    def rebuilt(decoded: Column) -> Column:
        sch, net, query = scheme(decoded), host(decoded), F.regexp_extract(decoded, QUERY, 1)
        closed = F.regexp_replace(
            path(decoded), r"(?s)\A(.*/[^/.;]+|[^/.;]+|)(;[^/]*)?\z", "$1/$2"
        )
        return F.concat(
            F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(F.lit("")),
            F.when(net != "", F.concat(F.lit("//"), net)).otherwise(F.lit("")),
            closed,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        )

    return let(percent_decode(url), rebuilt)


def absolute(base: Column, href: Column) -> Column:
    return normalize(resolve(base, href))


def in_scope(url: Column, include=(), exclude=()) -> Column:
    """http(s) only; some include pattern found (if any given), no exclude found."""
    bare = without_fragment(url)
    kept = scheme(url).isin("http", "https")
    if include:
        kept = kept & any_of(bare.rlike(p) for p in include)
    return kept & ~any_of(bare.rlike(p) for p in exclude)


def in_scope_of(url: Column, include: Column, exclude: Column) -> Column:
    """As ``in_scope``, with the patterns of each row in array columns."""
    bare = without_fragment(url)
    return (
        scheme(url).isin("http", "https")
        & (
            (F.coalesce(F.size(include), F.lit(0)) <= 0)
            | F.coalesce(F.exists(include, lambda p: F.rlike(bare, p)), F.lit(False))
        )
        & ~F.coalesce(F.exists(exclude, lambda p: F.rlike(bare, p)), F.lit(False))
    )


def matches_task(url: Column, pattern: str) -> Column:
    """Anchored match; ``*`` and a pattern that does not compile let all pass."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(True)
    if pattern == "*":
        return F.lit(True)
    return url.rlike(rf"\A(?:{pattern})")


def host_relation(url: Column, site_host: Column) -> Column:
    return (
        F.when(host(url) == site_host, F.lit("same"))
        .when(F.endswith(host(url), F.concat(F.lit("."), site_host)), F.lit("subdomain"))
        .otherwise(F.lit("external"))
    )


def mime_class(mimetype: Column) -> Column:
    return (
        F.when(any_of(mimetype.startswith(m) for m in TEXT_TYPES), F.lit("text"))
        .when(any_of(mimetype.startswith(m) for m in BINARY_TYPES), F.lit("binary"))
        .otherwise(F.lit("unsupported"))
    )


def mime_of_file(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair])
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def site_key(site_id: Column) -> Column:
    return F.regexp_replace(site_id, "[^a-zA-Z0-9_]", "_")


def doc_key(site_id: Column, content_hash: Column) -> Column:
    return F.concat_ws(":", site_id, content_hash)


def key_site(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def key_hash(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)\A[^:]*:(.*)\z", 1)


def title_from_url(url: Column) -> Column:
    """Last path segment without ``.html``/``.pdf``, decoded; else the host."""
    last = F.substring_index(path(url), "/", -1)
    name = percent_decode(F.replace(F.replace(last, F.lit(".html"), F.lit("")), F.lit(".pdf"), F.lit("")), 1)
    return F.when(path(url).contains("/"), name).otherwise(host(url))


def cap_title(title: Column) -> Column:
    return F.when(F.length(title) > 250, F.concat(F.substring(title, 1, 245), F.lit("..."))).otherwise(title)
