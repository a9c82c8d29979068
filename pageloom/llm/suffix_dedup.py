"""Suffix-array dedup by threshold-bounded interval expansion (operator 4).

A byte goes if a string of ``length`` bytes covers it that also starts in a
document with a smaller doc_id. Strings never cross documents.

1. Winnowing over bytes picks an anchor in each string; only anchors that two
   documents share (``recurring``) can belong to a string that goes.
2. The strings of each such anchor overlap; together they are one context. The
   contexts are dealt by anchor, so all occurrences of a string meet in one
   part. Equal contexts are joined before they are sent: of those that a task
   holds only the one with the smallest doc_id goes on.
3. Each part sorts its contexts, takes their Burrows-Wheeler transform and
   extends intervals backwards, breadth first: each level finds the places
   where neighbouring suffixes share exactly so many bytes. It stops at
   ``length``; the intervals that are left are the classes of equal strings,
   and the smallest doc_id of a class decides.

Parts are cut into lots of about ``LOT`` bytes by anchor. A lot holds one whole
anchor at least and a part is expanded as a whole, so this does not bound memory:
all distinct contexts of one hot anchor meet in one task and one sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as g
from .recurring import by_owner, expand, packed, parts_for, recurring, squeeze, unpacked
from .substring_dedup import held_keys, held_of, is_held, keyed, own_places, runs, tags

#: bytes of contexts sorted at once
LOT = 1 << 21
#: never in UTF-8, so it ends contexts
END = 255
NOBODY = np.int64(np.iinfo(np.int64).max)

_SENT = "part long, owner long, starts binary, counts binary, texts binary, size long, count long, body binary"
_MARKS = "owner long, keys binary, extras binary"
_OUT = "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>"


def _ranks(ids: pa.Array) -> np.ndarray:
    """doc_id as numbers; a null one is larger than all others."""
    return ids.fill_null(int(NOBODY)).to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_keys(length: int, seed: int):
    def keys_of(batch):
        data, at = g.texts(batch.column("text"))
        rows, ids = batch.column("k").to_numpy(), _ranks(batch.column("doc_id"))
        for i, j in g.slices(at):
            seeds = g.windows(g.BYTE_CODE[data[at[i] : at[j]]], seed)
            place, text, _, _ = g.anchors(seeds, at[i : j + 1] - at[i], seed, length)
            yield seeds[place], rows[i:j][text], np.zeros(len(place), np.uint64), ids[i:j][text]

    return keys_of


# ---- contexts

def _contexts(length: int, seed: int, parts: int):
    """Contexts of recurring anchors, dealt by anchor; equal ones joined."""

    def send(lots):
        bodies, sizes, docs, owners, begin, count, anchor, codes = (
            np.concatenate([x[c] for x in lots]) for c in range(8))
        first = np.cumsum(sizes) - sizes
        # equal contexts follow each other, the smallest doc_id first
        order = np.lexsort((docs, codes))
        code, doc = codes[order], docs[order]
        new = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        larger = doc > least
        gone = order[larger]
        out: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}

        def row(**values):
            for name, column in out.items():
                column.append(values.get(name))

        by = gone[np.argsort(owners[gone], kind="stable")]
        cut = np.flatnonzero(np.r_[True, owners[by][1:] != owners[by][:-1]]) if len(by) else np.zeros(0, int)
        for a, b in zip(cut, np.append(cut[1:], len(by))):
            mine = by[a:b]
            row(part=int(owners[mine[0]]) % parts, owner=int(owners[mine[0]]),
                starts=begin[mine].tobytes(), counts=count[mine].tobytes())
        left = order[~larger]
        part = ((anchor[left] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        left, part = left[by], part[by]
        cut = np.searchsorted(part, np.arange(parts + 1))
        for p in np.flatnonzero(cut[1:] > cut[:-1]):
            mine = left[cut[p] : cut[p + 1]]
            row(part=int(p), size=int(sizes[mine].sum()), count=len(mine),
                texts=squeeze(bodies[g.ranges(first[mine], sizes[mine])].tobytes()),
                body=packed(*(x[mine].view(np.uint64) for x in (sizes, begin, docs, owners, anchor))))
        kinds = [pa.int64() if n in ("part", "owner", "size", "count") else pa.binary() for n in out]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    def run(batches):
        lots, size = [], 0
        for batch in batches:
            data, at = g.texts(batch.column("text"))
            rows, ids = batch.column("k").to_numpy(), _ranks(batch.column("doc_id"))
            for i, j in g.slices(at):
                held, holder = held_of(batch.column("keys"), i, j)
                body, first = data[at[i] : at[j]], at[i : j + 1] - at[i]
                symbols = g.BYTE_CODE[body]
                seeds = g.windows(symbols, seed)
                place, text, begin, count = g.anchors(seeds, first, seed, length)
                hit = is_held(seeds[place], text, held, holder)
                place, text, begin, count = place[hit], text[hit], begin[hit], count[hit]
                if not len(place):
                    continue
                sizes = count + length - 1
                up, down = g._KEPT.to(len(symbols))
                sums = np.zeros(len(symbols) + 1, np.uint64)
                np.cumsum(symbols * up, out=sums[1:])
                codes = g.mix((sums[begin + sizes] - sums[begin]) * down[begin]) ^ g.mix(
                    ((place - begin) << 20 | count).astype(np.uint64))
                lots.append((body[g.ranges(begin, sizes)], sizes, ids[i:j][text], rows[i:j][text],
                             begin - first[text] | tags(body, first)[text].view(np.int64), count, seeds[place], codes))
                size += int(sizes.sum())
                if size >= 16 * LOT:
                    yield send(lots)
                    lots, size = [], 0
        if lots:
            yield send(lots)

    return run


# ---- the transform of one lot

def _order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of the ``depth`` or more bytes that follow (text is a
    circle), the rank of each place, and where the first eight bytes change."""
    n = len(text)
    around = np.concatenate([text, text[:8]] if n >= 8 else [np.tile(text, 9)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | around[i : i + n].astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    first = new.copy()
    known = 8
    rank = np.empty(n, np.uint64)
    while known < depth:
        rank[order] = np.cumsum(new)
        key = rank << np.uint64(32) | np.roll(rank, -(known % n))
        order = np.argsort(key)
        sorted_key = key[order]
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
        known *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, first


def classes(text: np.ndarray, length: int) -> np.ndarray:
    """The class of each place: equal numbers where the next ``length`` bytes agree.

    Breadth-first backward extension. ``bound`` tells at which ranks a class of
    the present level begins. An interval is extended only while its right end
    is new: otherwise all that it could tell is known.
    """
    n = len(text)
    order, place, bound = _order(text, length + 1)
    before = np.where(order == 0, n - 1, order - 1)
    head = text[order]
    back = place[before]  # rank of the suffix that begins one byte earlier
    bound = np.append(bound, True)
    low = np.flatnonzero(bound[:-1])
    high = np.append(low[1:], n)
    for _ in range(8, length):
        inside = g.ranges(low, high - low)
        key = np.repeat(np.arange(len(low), dtype=np.uint64), high - low) << np.uint64(32) | back[inside].astype(np.uint64)
        key.sort()
        interval, at = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ends = np.empty(len(key), bool)
        ends[-1] = True
        ends[:-1] = (interval[1:] != interval[:-1]) | (head[at[1:]] != head[at[:-1]])
        last = np.flatnonzero(ends)
        right = at[last] + 1
        left = at[np.append(0, last[:-1] + 1)]
        new = ~bound[right]
        low, high = left[new], right[new]
        if not len(low):
            break
        bound[high] = True
    number = np.cumsum(bound[:-1])
    return number[place]


def _decide(texts, lengths, docs, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context which of its strings also start in a smaller document."""
    first = np.cumsum(lengths) - lengths
    # equal contexts are sorted once, for their smallest document
    symbols = g.BYTE_CODE[texts]
    up, down = g._KEPT.to(len(symbols))
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up, out=sums[1:])
    code = g.mix((sums[first + lengths] - sums[first]) * down[first]) ^ lengths.astype(np.uint64)
    _, one, which = np.unique(code, return_index=True, return_inverse=True)
    smallest = np.full(len(one), NOBODY)
    np.minimum.at(smallest, which, docs)
    size = lengths[one]
    begin = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(one), END, np.uint8)
    joined[g.ranges(begin, size)] = texts[g.ranges(first[one], size)]
    number = classes(joined, length)
    strings = size - length + 1
    where = number[g.ranges(begin, strings)]
    least = np.full(int(number.max()) + 1, NOBODY)
    np.minimum.at(least, where, np.repeat(smallest, strings))
    least = least[where]  # by string of the distinct contexts
    counts = lengths - length + 1
    mine = g.ranges((np.cumsum(strings) - strings)[which], counts)
    return least[mine] < np.repeat(docs, counts), counts


def _marks(length: int):
    def marks(table: pa.Table) -> pa.Table:
        out_owner, out_starts, out_counts = [], [], []
        told = table.filter(pa.compute.is_null(table.column("owner")))
        known = table.filter(pa.compute.is_valid(table.column("owner"))).select(["owner", "starts", "counts"])
        if told.num_rows:
            sizes, counts = told.column("size").to_pylist(), told.column("count").to_pylist()
            texts = np.concatenate([np.frombuffer(expand(b, n), np.uint8)
                                    for b, n in zip(told.column("texts").to_pylist(), sizes)])
            lots = [unpacked(b, n, 5) for b, n in zip(told.column("body").to_pylist(), counts)]
            lengths, begin, docs, owners, anchor = (np.concatenate([x[c] for x in lots]) for c in range(5))
            lengths, begin, docs, owners = (x.view(np.int64) for x in (lengths, begin, docs, owners))
            first = np.cumsum(lengths) - lengths
            order = np.argsort(anchor, kind="stable")
            new = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
            ends = np.append(new[1:], len(order))
            total = np.cumsum(lengths[order])
            a = 0
            while a < len(new):
                used = total[new[a]] - lengths[order[new[a]]]
                b = max(a + 1, int(np.searchsorted(total[ends - 1], used + LOT, "right")))
                lot = order[new[a] : ends[b - 1]]
                gone, counts = _decide(texts[g.ranges(first[lot], lengths[lot])], lengths[lot], docs[lot], length)
                place = np.repeat(begin[lot], counts) + g.ranges(np.zeros(len(lot)), counts)
                own = np.repeat(owners[lot], counts)
                # neighbouring strings that go become one run
                own, place = own[gone], place[gone]
                by = np.lexsort((place, own))
                own, place = own[by], place[by]
                if len(own):
                    edge = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)])
                    size = np.diff(np.append(edge, len(own)))
                    o, s = own[edge], place[edge]
                    cut = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                    for i, j in zip(cut, np.append(cut[1:], len(o))):
                        out_owner.append(int(o[i]))
                        out_starts.append(s[i:j].tobytes())
                        out_counts.append(size[i:j].tobytes())
                a = b
        out = pa.table({"owner": pa.array(out_owner, pa.int64()), "keys": pa.array(out_starts, pa.binary()),
                        "extras": pa.array(out_counts, pa.binary())})
        if known.num_rows:
            out = pa.concat_tables([known.rename_columns(["owner", "keys", "extras"]).cast(out.schema), out])
        return out

    return marks


def _cut(length: int):
    def cut(batches):
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for r in range(batch.num_rows):
                body = (batch.column("text")[r].as_py() or "").encode()
                starts = batch.column("keys")[r].as_py()
                spans, gone = [], 0
                if starts:
                    s, mine = own_places(starts, tags(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0])
                    c = held_keys(batch.column("extras")[r].as_py()).astype(np.int64)[mine]
                    edge = np.zeros(len(body) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + c + length - 1, -1)
                    mask = np.cumsum(edge[:-1]) > 0
                    first, end = runs(mask)
                    spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(first, end)]
                    gone, size = int(mask.sum()), len(body)
                    body = np.frombuffer(body, np.uint8)[~mask].tobytes()
                for column, value in zip(columns, (batch.column("doc_id")[r].as_py(), body, len(body) + gone, gone, spans)):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                     pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    return cut


def suffix_dedup(documents: DataFrame, length: int = 50, seed: int = 20) -> DataFrame:
    """Texts without the bytes of strings of ``length`` bytes that a smaller document holds.

    Needs columns doc_id and text; others are ignored. Gives for each row doc_id,
    kept (bytes left), n_bytes, n_removed and spans (first and last byte of each
    maximal run removed). Bytes left need not be UTF-8 any more.

    A null or empty text has no bytes. Rows that share a doc_id take nothing
    from each other; a null doc_id counts as larger than all others. No rows
    give no rows.
    """
    if not 8 <= seed <= length <= 64:
        raise ValueError("8 <= seed <= length <= 64")
    docs = keyed(documents)
    anchors = by_owner(recurring(docs.select("k", "doc_id", "text"), _anchor_keys(length, seed),
                                 parts_for(documents), distinct=True))
    seeded = docs.join(anchors, docs.k == anchors.owner).select("k", "doc_id", "text", "keys")
    parts = parts_for(documents, 1 << 20)
    contexts = seeded.mapInArrow(g.tidy(_contexts(length, seed, parts)), _SENT)
    marks = by_owner(contexts.groupBy("part").applyInArrow(_marks(length), _MARKS))
    rows = docs.join(marks, docs.k == marks.owner, "left").select("k", "doc_id", "text", "keys", "extras")
    return rows.mapInArrow(g.tidy(_cut(length)), _OUT)
