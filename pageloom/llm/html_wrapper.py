"""Main text of pages by wrapper induction over the pages of a host (operator 11).

Pages of one host are aligned by simple tree matching: two trees match in their
root's label and in the best order-preserving matching of its children. What is
the same text at the same place on most pages of a host is template, what varies
is content.

* References. For each host a few pages of its most common size class are the
  references; their trees are small, so a page is compared with a few trees and
  never with all pages of its host, and a host that holds a third of all pages
  needs no group of its own.
* Alignment. Every page is matched with the references of its host where it is
  read. A block of text that meets the same text in a reference is a vote for
  that block of the reference.
* Template. Votes are counted over all pages of the host (pages whose longest
  block is the same count once, so copies of an article are no template). A
  block of a reference with the votes of half of them is constant.
* Content. Of the varying blocks those are taken that lie in the article: in
  ``article`` or ``main`` where a page has them, else in the smallest element
  that holds most of the varying text outside of links. Menus, headers, footers,
  sidebars, notices, adverts, forms and comments go by tag, role and class too,
  since much of that varies from page to page.

A page is read by one task; pages are not shuffled while the references and the
constant blocks are small enough to be sent, and joined by host beyond that.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import grams as g

REFERENCES = 3
#: bytes of reference trees, and hosts with constant blocks, that are sent to all tasks; more are joined by host
SENT_BYTES, SENT_HOSTS = 32 << 20, 200_000
#: share of a host's pages that make a block constant; pages that must agree within an article
SHARE, AGREED = 0.5, 3
#: elements nested deeper are read as children of the element at this depth
DEEPEST = 48
#: pairs of children up to which their grid is made at once; above it is made in arrays, with the same result
IN_DEPTH = 40_000
#: weights of pairs that a matching remembers; beyond it they are made again
REMEMBERED = 1 << 20

# fixed values: kinds of elements, roles, and words of class names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
 figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary
 table tbody td tfoot th thead tr ul""".split())
RAW = frozenset("script style textarea title noembed noframes xmp iframe".split())
DROPPED = frozenset("""script style noscript template head title textarea nav footer aside form button select option datalist input
 iframe object embed svg canvas dialog menu map audio video noembed noframes search""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
WORDS = frozenset("""ad ads adsense adslot advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments
 commentlist consent cookie cookies copyright discussion disqus footer form gdpr header login masthead menu menus modal nav navbar
 navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended recommendations related
 replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription teaser toolbar
 topbar widget widgets""".split())
STATES = frozenset("has with no without is not js".split())
OWN_HEADER = frozenset("article entry post story content".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"),
             "tfoot": ("thead", "tbody", "tr", "td", "th")}
STOPPED_AT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|</[^a-zA-Z][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_NAMED = re.compile(r"\b(?:class|id|role|hidden|style|aria-hidden)\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_DIGITS = re.compile("[0-9]+")

#: what is known of an element: 0 unknown, 1 article, 2 main, 3 not content
UNKNOWN, ARTICLE, MAIN, OTHER = range(4)


class Node:
    """An element, or a block of text (a leaf)."""

    __slots__ = ("label", "kids", "code", "size", "leaf")

    def __init__(self, label: str, leaf: int = -1) -> None:
        self.label, self.leaf, self.kids, self.code = label, leaf, [], 0
        self.size = 1 if leaf < 0 else 2  # what an equal tree weighs


class Page:
    """The tree of a page; of each leaf its text, characters in links, and the elements around it."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.links: list[int] = []
        self.around: list[tuple] = []  # numbers of the elements, outermost first
        self.root = Node("html")
        self.kinds: list[int] = []  # of the elements, by number


def _hash(text: str) -> int:
    body = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(body) << 32 | zlib.adler32(body)


def _attributes(source: str) -> dict:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name not in out:
            out[name] = html.unescape(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value)
    return out


def _unwanted(name: str) -> bool:
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in STATES:
        return False
    if words[0] in OWN_HEADER and words[-1] in ("header", "banner"):
        return False
    return any(w in WORDS for w in words)


def _kind(tag: str, attributes: dict, inside: bool) -> int:
    """What an element is by its tag, role and names; ``inside``: it lies in an article or main part."""
    if tag in DROPPED or (tag == "header" and not inside):
        return OTHER
    if tag in ("html", "body"):
        return UNKNOWN
    if attributes:
        role = attributes.get("role", "").lower()
        if role in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return OTHER
        if "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return OTHER
        if tag not in ("h1", "h2", "h3", "h4", "h5", "h6") and any(
                _unwanted(n) for n in (attributes.get("class", "") + " " + attributes.get("id", "")).split()):
            return ARTICLE if tag == "article" and not inside and "comment" not in attributes.get("class", "") else OTHER
        if role == "main":
            return MAIN
        if role == "article":
            return ARTICLE
    return MAIN if tag == "main" else ARTICLE if tag == "article" else UNKNOWN


def read_page(source: str | None) -> Page:
    """The tree of block elements of a page.

    Inline elements are part of the text of their block. Broken markup is read
    as browsers read it in the common cases: missing end tags of p, li, dt, dd
    and table parts, missing ends of a page, unknown end tags.
    """
    page = Page()
    source = source or ""
    # open elements: tag, node, number, kind that holds within; and inline ones that are dropped
    stack = [("", page.root, 0, UNKNOWN)]
    page.kinds.append(UNKNOWN)
    path: list[int] = [0]
    words: list[str] = []
    linked = 0
    in_link = 0

    def end_block():
        nonlocal linked
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                _, node, _, kind = stack[-1]
                leaf = Node("#", len(page.texts))
                leaf.code = _hash(text)
                node.kids.append(leaf)
                page.texts.append(text)
                page.links.append(min(linked, len(text)))
                page.around.append((*path,) if kind != OTHER else (*path, -1))
        linked = 0

    def close(count: int):
        nonlocal in_link
        for _ in range(count):
            tag = stack[-1][0]
            if tag in BLOCKS:
                end_block()
            if tag == "a":
                in_link = max(in_link - 1, 0)
            if stack.pop()[1] is not stack[-1][1]:
                path.pop()

    def find(tags, stops=()) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                return depth
            if stack[depth][0] in stops:
                return 0
        return 0

    def say(start: int, stop: int):
        nonlocal linked
        if stop > start and stack[-1][3] != OTHER or stop > start and stack[-1][0] in BLOCKS and stack[-1][0] != "head":
            text = source[start:stop]
            if "&" in text:
                text = html.unescape(text)
            words.append(text)
            if in_link:
                linked += len(text)

    at, size = 0, len(source)
    while at < size:
        found = _TOKEN.search(source, at)
        if found is None:
            say(at, size)
            break
        say(at, found.start())
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            if tag == "br":
                words.append(" ")
            elif tag == "p" and not find(("p",)):
                end_block()
            else:
                depth = find((tag,), () if tag in BLOCKS else ("p", "td", "th", "li", "div", "article", "section"))
                if depth:
                    close(len(stack) - depth)
            continue
        if tag in CLOSES_P:
            depth = find(("p",), ("table", "td", "th", "button", "div", "article", "section", "aside", "nav", "main", "li"))
            if depth:
                close(len(stack) - depth)
        if tag in CLOSED_BY:
            depth = find(CLOSED_BY[tag], STOPPED_AT.get(tag, ("table",)))
            while depth:
                close(len(stack) - depth)
                depth = find(CLOSED_BY[tag], STOPPED_AT.get(tag, ("table",)))
        if tag == "a" and in_link:
            depth = find(("a",), ("table", "td", "th"))
            if depth:
                close(len(stack) - depth)
        raw = found.group(3)
        attributes = _attributes(raw) if raw and _NAMED.search(raw) else {}
        _, node, _, within = stack[-1]
        kind = within if within == OTHER else _kind(tag, attributes, within in (ARTICLE, MAIN))
        if tag in BLOCKS:
            end_block()
        if tag == "br":
            words.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            if stop is None:
                break
            at = source.find(">", stop.end())
            at = size if at < 0 else at + 1
            continue
        if tag in ("html", "body"):
            continue
        hides = kind == OTHER and within != OTHER
        if (tag in BLOCKS or hides) and len(path) < DEEPEST:
            if tag not in BLOCKS:
                end_block()
            name = attributes.get("id") or attributes.get("class", "").split(" ")[0] if attributes else ""
            child = Node(f"{tag}.{_DIGITS.sub('0', name)}" if name else tag)
            node.kids.append(child)
            page.kinds.append(kind)
            path.append(len(page.kinds) - 1)
            stack.append((tag, child, len(page.kinds) - 1, within if kind == UNKNOWN else kind))
        else:
            stack.append((tag, node, stack[-1][2], OTHER if kind == OTHER else within))
        if tag == "a":
            in_link += 1
    end_block()
    _measure(page.root)
    return page


def _measure(node: Node) -> None:
    """Weight and hash of each subtree."""
    if node.leaf >= 0:
        return
    code = zlib.crc32(node.label.encode("utf-8", "surrogatepass"))
    for kid in node.kids:
        _measure(kid)
        node.size += kid.size
        code = (code * 0x9E3779B1 + kid.code) & 0xFFFFFFFFFFFFFFF
    node.code = code


def packed_tree(page: Page) -> str:
    def told(node):
        return node.code if node.leaf >= 0 else [node.label, *map(told, node.kids)]

    return json.dumps(told(page.root), separators=(",", ":"))


def read_tree(body: str) -> Node:
    leaves = iter(range(1 << 60))

    def built(told):
        if isinstance(told, int):
            leaf = Node("#", next(leaves))
            leaf.code = told
            return leaf
        node = Node(told[0])
        node.kids = [built(t) for t in told[1:]]
        return node

    root = built(json.loads(body))
    _measure(root)
    return root


class Matching:
    """Simple tree matching of two trees; equal texts weigh one more than different ones."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}

    def weight(self, a: Node, b: Node) -> int:
        if a.label != b.label:
            return 0
        if a.code == b.code:
            return a.size
        if a.leaf >= 0:
            return 1
        if not a.kids or not b.kids:
            return 1
        key = (id(a), id(b))
        weight = self.known.get(key)
        if weight is None:
            weight = 1 + self._best(a.kids, b.kids, None)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = weight
        return weight

    def _best(self, one: list, two: list, pairs: list | None) -> int:
        """Weight of the best matching of two lists of children; ``pairs`` gets it."""
        i, j, total = 0, 0, 0
        m, n = len(one), len(two)
        # equal subtrees at both ends belong to some best matching
        while i < m and j < n and one[i].code == two[j].code and one[i].label == two[j].label:
            total += one[i].size
            if pairs is not None:
                pairs.append((one[i], two[j]))
            i, j = i + 1, j + 1
        while m > i and n > j and one[m - 1].code == two[n - 1].code and one[m - 1].label == two[n - 1].label:
            m, n = m - 1, n - 1
            total += one[m].size
            if pairs is not None:
                pairs.append((one[m], two[n]))
        one, two = one[i:m], two[j:n]
        if not one or not two:
            return total
        if len(one) == 1 and len(two) == 1:
            w = self.weight(one[0], two[0])
            if w and pairs is not None:
                pairs.append((one[0], two[0]))
            return total + w
        if len(one) * len(two) > IN_DEPTH:
            return total + self._wide(one, two, pairs)
        rows = [[0] * (len(two) + 1)]
        weights = []
        for a in one:
            above, row, own = rows[-1], [0], []
            label, last = a.label, 0
            for j, b in enumerate(two):
                w = self.weight(a, b) if label == b.label else 0
                own.append(w)
                best = above[j + 1]
                if last > best:
                    best = last
                if w and above[j] + w > best:
                    best = above[j] + w
                row.append(best)
                last = best
            rows.append(row)
            weights.append(own)
        if pairs is not None:
            i, j = len(one), len(two)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((one[i], two[j]))
        return total + rows[-1][-1]

    def _wide(self, one: list, two: list, pairs: list | None) -> int:
        """As the grid of ``_best``, row by row in arrays, for lists of any length.

        Every ``step``-th row is kept, and the rows between are made again on
        the way back, so memory grows with the length times its root.
        """
        weights = _Weights(self, one, two)
        m, n = len(one), len(two)
        step = isqrt(m) + 1
        row, kept = np.zeros(n + 1, np.int32), []

        def following(above, i):
            below = np.zeros(len(above), np.int32)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights.row(i)[: len(above) - 1]), out=below[1:])
            return below

        for i in range(m):
            if pairs is not None and i % step == 0:
                kept.append(row)
            row = following(row, i)
        total = int(row[-1])
        if pairs is not None:
            j, stop = n, m
            while kept and j:
                rows = [kept.pop()[: j + 1]]
                start = len(kept) * step
                for i in range(start, stop):
                    rows.append(following(rows[-1], i))
                i = stop
                while i > start and j:
                    here, above = rows[i - start], rows[i - start - 1]
                    if here[j] == above[j]:
                        i -= 1
                    elif here[j] == here[j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        pairs.append((one[i], two[j]))
                stop = start
        return total

    def equal_leaves(self, a: Node, b: Node, out: list) -> None:
        """(leaf, leaf) of the matching whose texts are equal."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            if a.code == b.code:
                out.extend(zip(_leaves(a), _leaves(b)))
            elif a.leaf < 0:
                pairs: list[tuple] = []
                self._best(a.kids, b.kids, pairs)
                waiting.extend(p for p in pairs if p[0].label == p[1].label)


class _Weights:
    """Weights of all pairs of two long lists of children, a row at a time.

    Texts of one list only equal nothing, so nodes that differ in such texts
    alone weigh the same, and of two nodes without a common text only the
    elements count. So few pairs of nodes are matched, one for each kind.
    """

    def __init__(self, matching: Matching, one: list, two: list) -> None:
        self.matching, self.one, self.two = matching, one, two
        self.shared = {c for a in one for c in _codes(a)} & {c for b in two for c in _codes(b)}
        self.numbers: dict[tuple, int] = {}
        self.first = [self._told(a) for a in one]
        told = [self._told(b) for b in two]
        # of the second list: places of each form; forms of each frame, and with each shared text
        self.places: dict[int, list] = {}
        self.frames: dict[int, dict] = {}
        self.holding: dict[int, dict] = {}
        for j, (frame, form, codes) in enumerate(told):
            if form not in self.places:
                self.frames.setdefault(frame, {})[form] = j
                for code in codes:
                    self.holding.setdefault(code, {})[form] = j
            self.places.setdefault(form, []).append(j)
        numbers = {frame: k for k, frame in enumerate(self.frames)}
        self.frame_of = np.array([numbers[frame] for frame, _, _ in told], np.int64)
        # by frame the weights where no text is shared; by form the places and weights of the others
        self.apart: dict[int, np.ndarray] = {}
        self.met: dict[int, tuple] = {}
        self.held = 0

    def _told(self, node: Node) -> tuple[int, int, frozenset]:
        """Numbers of a node without its texts and with its shared texts, and the codes of these."""
        number = lambda *key: self.numbers.setdefault(key, len(self.numbers))
        if node.leaf >= 0:
            own = node.code if node.code in self.shared else None
            return number("#"), number("#", own), frozenset(() if own is None else (own,))
        kids = [self._told(k) for k in node.kids]
        label = node.label
        return (number(0, label, *(k[0] for k in kids)), number(1, label, *(k[1] for k in kids)), frozenset().union(*(k[2] for k in kids)))

    def row(self, i: int) -> np.ndarray:
        frame, form, codes = self.first[i]
        if form not in self.met:
            if self.held > REMEMBERED:
                self.met.clear()
                self.apart.clear()
                self.held = 0
            self._weigh(self.one[i], frame, form, codes)
        out = self.apart[frame][self.frame_of]
        at, own = self.met[form]
        out[at] = own
        return out

    def _weigh(self, a: Node, frame: int, form: int, codes: frozenset) -> None:
        weight, two = self.matching.weight, self.two
        met = {other: j for code in codes for other, j in self.holding.get(code, {}).items()}
        if frame not in self.apart:
            self.apart[frame] = np.full(len(self.frames), -1, np.int32)
            self.held += len(self.frames)
        apart = self.apart[frame]
        if (apart < 0).any():
            for k, forms in enumerate(self.frames.values()):
                if apart[k] < 0:
                    j = next((j for other, j in forms.items() if other not in met), None)
                    if j is not None:
                        apart[k] = weight(a, two[j])
        at, own = [], []
        for other, j in met.items():
            at += self.places[other]
            own += [weight(a, two[j])] * len(self.places[other])
        self.met[form] = np.array(at, np.int64), np.array(own, np.int32)
        self.held += len(at) + 1


def _codes(node: Node) -> list[int]:
    return [node.code] if node.leaf >= 0 else [c for k in node.kids for c in _codes(k)]


def _leaves(node: Node) -> list[int]:
    if node.leaf >= 0:
        return [node.leaf]
    out, waiting = [], [node]
    while waiting:
        node = waiting.pop()
        if node.leaf >= 0:
            out.append(node.leaf)
        else:
            waiting.extend(reversed(node.kids))
    return out


def votes(page: Page, tree: Node) -> list[tuple[int, int]]:
    """(leaf of the page, leaf of the reference) with one text, by simple tree matching."""
    out: list[tuple[int, int]] = []
    Matching().equal_leaves(page.root, tree, out)
    return out


def _in_article(page: Page) -> set[int]:
    """Numbers of the elements that a page itself says to be its article."""
    mass: dict[int, int] = {}
    for around, text, linked in zip(page.around, page.texts, page.links):
        if around[-1] != -1:
            for number in around:
                mass[number] = mass.get(number, 0) + len(text) - linked
    mains = [n for n, kind in enumerate(page.kinds) if kind == MAIN and mass.get(n)]
    articles = [n for n, kind in enumerate(page.kinds) if kind == ARTICLE and mass.get(n)]
    most = max((mass[n] for n in articles), default=0)
    articles = [n for n in articles if 3 * mass[n] >= most]
    if mains:
        largest = max(mains, key=lambda n: mass[n])
        inner = {n for n in articles if any(largest in a and n in a for a in page.around)}
        if inner and 2 * sum(mass[n] for n in inner) >= mass[largest]:
            return inner
        return {largest}
    return set(articles)


def content(texts: list[str], links: list[int], around: list, in_article: list[bool], constant: list[int]) -> list[int]:
    """The leaves that are the main text.

    ``constant``: 0 varying, 1 constant on this host, 2 constant even for a block of an article.
    """
    if any(in_article):
        inside = [i for i, own in enumerate(in_article) if own]
        return [i for i in inside if constant[i] < 2] or inside
    varying = [i for i in range(len(texts)) if not constant[i]]
    # blocks that are mostly links are menus
    varying = [i for i in varying if 2 * links[i] < len(texts[i]) + 1]
    mass: dict[int, int] = {}
    total = 0
    for i in varying:
        own = len(texts[i]) - links[i]
        total += own
        for number in around[i]:
            mass[number] = mass.get(number, 0) + own
    most = {n for n, m in mass.items() if 3 * m >= 2 * total}
    if not most:
        return varying
    inner = max(most)  # elements are numbered outside in
    return [i for i in varying if inner in around[i]]


def _joined(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


_BLOCK = "struct<text:string,links:int,around:array<int>,article:boolean,votes:array<long>>"
_READ = f"row long, page_id long, url string, host string, longest long, blocks array<{_BLOCK}>"


def _trees(batches):
    """(host, tree) of reference pages."""
    for batch in batches:
        trees = [packed_tree(read_page(h)) for h in _joined(batch, "html")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("row"), pa.array(trees, pa.string())], names=["host", "row", "tree"])


def _read(batches):
    """Pages with their blocks that may be content, and the votes of these."""
    block = pa.struct([("text", pa.string()), ("links", pa.int32()), ("around", pa.list_(pa.int32())), ("article", pa.bool_()),
                       ("votes", pa.list_(pa.int64()))])
    last, trees = None, []
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            longest, blocks = [], []
            for row, host, source, bodies in zip(*(_joined(part, n) for n in ("row", "host", "html", "trees"))):
                if bodies and (host, bodies) != last:
                    trees, last = [(t["row"], read_tree(t["tree"])) for t in bodies], (host, bodies)
                page = read_page(source)
                met: dict[int, list[int]] = {}
                if bodies:
                    for number, (own, tree) in enumerate(trees):
                        if own != row:
                            for leaf, other in votes(page, tree):
                                met.setdefault(leaf, []).append(number << 32 | other)
                own = _in_article(page)
                longest.append(_hash(max(page.texts, key=len, default="")) - (1 << 63))
                blocks.append([
                    {"text": t, "links": n, "around": list(a), "article": not own.isdisjoint(a), "votes": met.get(i, [])}
                    for i, (t, n, a) in enumerate(zip(page.texts, page.links, page.around)) if a[-1] != -1])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("page_id"), part.column("url"), part.column("host"), pa.array(longest, pa.int64()),
                 pa.array(blocks, pa.list_(block))], names=["row", "page_id", "url", "host", "longest", "blocks"])


def _chosen(batches):
    """The main text of each page."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            out = []
            for blocks, weak, strong in zip(*(_joined(part, n) for n in ("blocks", "weak", "strong"))):
                weak, strong = set(weak or ()), set(strong or ())
                state = [2 if not strong.isdisjoint(b["votes"]) else 1 if not weak.isdisjoint(b["votes"]) else 0 for b in blocks]
                texts = [b["text"] for b in blocks]
                kept = content(texts, [b["links"] for b in blocks], [b["around"] for b in blocks], [b["article"] for b in blocks], state)
                out.append([texts[i] for i in kept])
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(out, pa.list_(pa.string()))], names=["page_id", "url", "blocks"])


def _with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host (null where the url has none) and a number of the row."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.select("*", F.when(host != "", host).alias("host"), F.xxhash64("page_id", "url", "html").alias("row"))


def references(pages: DataFrame, count: int = REFERENCES) -> DataFrame:
    """host and trees (array of row and tree) of the pages that stand for their host.

    Of the most common size class of a host (by powers of 1.5 of the number of
    tags) the pages with the smallest hashes, with different titles.
    """
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)
    tags = F.length("html") - F.length(F.replace("html", F.lit("<"), F.lit("")))
    known = pages.filter("host IS NOT NULL AND html IS NOT NULL").select(
        "host", "row", F.xxhash64(title).alias("title"), F.floor(F.log(F.greatest(tags, F.lit(1)).cast("double")) / F.log(F.lit(1.5))).alias("class"))
    known = materialize(known, "sizes")
    common = known.groupBy("host", "class").agg(F.count("*").alias("c")).groupBy("host").agg(
        F.max(F.struct("c", -F.col("class"))).alias("m"), F.sum("c").alias("pages")).filter("pages > 1").select(
        "host", (-F.col("m.col2")).alias("class"))
    few = known.join(common, ["host", "class"]).groupBy("host", "title").agg(F.min("row").alias("row"))
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("row"))).filter(F.col("r") <= count)
    chosen = pages.join(F.broadcast(first.select("row").distinct()) if first.count() <= SENT_HOSTS else first.select("row").distinct(), "row", "left_semi")
    trees = chosen.select("host", "row", "html").mapInArrow(g.tidy(_trees), "host string, row long, tree string").dropDuplicates(["host", "row"])
    return trees.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("row", "tree"))).alias("trees"))


def constant_blocks(read: DataFrame) -> DataFrame:
    """host, weak and strong: blocks of its references that are constant.

    Pages with one longest block count as one. Strong: enough pages agree to
    believe it of a block within an article.
    """
    pages = read.filter("host IS NOT NULL").select("host", "longest", F.flatten("blocks.votes").alias("v"))
    total = pages.groupBy("host", "longest").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("pages"))
    met = pages.select("host", "longest", F.explode("v").alias("v")).distinct().groupBy("host", "v").agg(F.count("*").alias("c"))
    # a reference does not vote on its own blocks
    out = met.join(total, "host").filter(F.col("c") >= F.greatest(F.lit(1), F.floor((F.col("pages") - 1) * SHARE)))
    return out.groupBy("host").agg(
        F.collect_set("v").alias("weak"), F.collect_set(F.when(F.col("c") >= AGREED, F.col("v"))).alias("strong"))


def main_texts(pages: DataFrame, count: int = REFERENCES) -> DataFrame:
    """page_id, url and blocks (the main text, block by block) of each row of ``pages``.

    Needs columns page_id, url and html; others are ignored. A null or empty
    page has no blocks. Pages without a host, and hosts of one page, have no
    references: for them tags, roles, class names and the share of links
    decide. Repeated rows are read alike, references are chosen by hashes, and
    no rows give no rows. Whole pages are read, however long, and lists of
    children are matched alike at any length, in time that grows with the
    product of two lists; nesting beyond ``DEEPEST`` levels is read flat.
    """
    spark = pages.sparkSession
    rows = _with_host(pages)
    trees = materialize(references(rows, count), "references")
    size = trees.agg(F.sum(F.aggregate("trees", F.lit(0).cast("long"), lambda a, t: a + F.length(t["tree"])))).first()[0] or 0
    joined = rows.join(F.broadcast(trees) if size <= SENT_BYTES else trees, "host", "left")
    read = materialize(joined.select("row", "page_id", "url", "host", "html", "trees").mapInArrow(g.tidy(_read), _READ), "blocks")
    constant = materialize(constant_blocks(read), "constant")
    judged = read.join(F.broadcast(constant) if constant.count() <= SENT_HOSTS else constant, "host", "left")
    return judged.select("page_id", "url", "blocks", "weak", "strong").mapInArrow(
        g.tidy(_chosen), "page_id long, url string, blocks array<string>")
