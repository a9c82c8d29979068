"""Substring dedup by seed and extend (operator 5).

Words are runs of bytes other than ASCII white space. A run of ``length`` words
that also starts anywhere else, in any document or the same one, marks all its
words for removal; what is left is the words that no such run covers.

1. Seed: winnowing picks an anchor, the smallest hash of ``seed`` words, in each
   window of ``length`` words. Equal windows pick the same anchor, so a window
   can only recur if its anchor does.
2. Join: anchors that recur are found for the whole corpus (``recurring``).
3. Extend: at recurring anchors the texts are extended both ways as far as the
   anchor speaks for windows; the extensions are compared by the hashes of
   their windows, again for the whole corpus. Neighbouring equal windows join
   up to maximal repeats.

No pair of documents is ever formed, so groups of thousands of copies cost what
their rows cost. Hashes have 64 bits.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as g
from .recurring import by_owner, parts_for, read_keys, recurring

_OUT = "doc_id long, kept string, n_words long, n_removed long, spans array<struct<first:long,last:long>>"


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and ``k``, the number under which a row is dealt.

    That is its doc_id, which compresses well; rows without one get a hash of
    their text, so they do not meet in one place. ``tags`` tell rows of one
    number but different texts apart.
    """
    return documents.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64("text")).alias("k"))


def tags(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits of a hash of each text, in the upper half of 64."""
    out = np.zeros(len(at) - 1, np.uint64)
    filled = at[:-1] < at[1:]
    if filled.any():
        size = np.diff(at)
        up, _ = g._KEPT.to(int(size.max()))
        codes = g.BYTE_CODE[data] * up[g.ranges(np.zeros(len(size)), size)]
        out[filled] = np.add.reduceat(codes, at[:-1][filled])
    return g.mix(out) & np.uint64(0xFFFFFFFF00000000)


def own_places(lists, tag: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Places told to a row's number that are meant for its text, and which they are."""
    told = held_keys(lists)
    mine = (told & np.uint64(0xFFFFFFFF00000000)) == tag
    return (told[mine] & np.uint64(0xFFFFFFFF)).astype(np.int64), mine


def held_keys(lists) -> np.ndarray:
    """The keys of a row of ``by_owner`` as one array."""
    return np.concatenate([read_keys(b) for b in lists]) if lists else np.zeros(0, np.uint64)


def held_of(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys held by rows i to j - 1 of a column of lists, and whose they are."""
    keys, owner = [], []
    for r, lists in enumerate(column.slice(i, j - i).to_pylist()):
        if lists:
            k = held_keys(lists)
            keys.append(k)
            owner.append(np.full(len(k), r, np.int64))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owner)


def is_held(keys: np.ndarray, owner: np.ndarray, held: np.ndarray, holder: np.ndarray) -> np.ndarray:
    """Whether (key, owner) is among (held, holder)."""
    if not len(held) or not len(keys):
        return np.zeros(len(keys), bool)
    salt = g.mix(np.arange(int(max(owner.max(), holder.max())) + 1, dtype=np.uint64) + np.uint64(1))
    return np.isin(keys ^ salt[owner], held ^ salt[holder])


def _words(data, at, i, j):
    a = at[i : j + 1] - at[i]
    d = data[at[i] : at[j]]
    starts, ends, first = g.word_spans(d, a)
    return g.word_codes(d, starts, ends), first


def _anchor_keys(length: int, seed: int):
    def keys_of(batch):
        data, at = g.texts(batch.column("text"))
        rows = batch.column("k").to_numpy()
        for i, j in g.slices(at):
            codes, first = _words(data, at, i, j)
            seeds = g.windows(codes, seed)
            place, text, _, _ = g.anchors(seeds, first, seed, length)
            owner = rows[i:j][text]
            yield seeds[place], owner, np.zeros(len(place), np.uint64), np.zeros(len(place), np.int64)

    return keys_of


def _window_keys(length: int, seed: int):
    def keys_of(batch):
        data, at = g.texts(batch.column("text"))
        rows = batch.column("k").to_numpy()
        lists = batch.column("keys")
        for i, j in g.slices(at):
            held, holder = held_of(lists, i, j)
            codes, first = _words(data, at, i, j)
            seeds = g.windows(codes, seed)
            place, text, begin, count = g.anchors(seeds, first, seed, length)
            hit = is_held(seeds[place], text, held, holder)
            text, begin, count = text[hit], begin[hit], count[hit]
            where = g.ranges(begin, count)
            text = np.repeat(text, count)
            tag = tags(data[at[i] : at[j]], at[i : j + 1] - at[i])
            yield (g.windows(codes, length)[where], rows[i:j][text], (where - first[text]).astype(np.uint64) | tag[text],
                   np.zeros(len(where), np.int64))

    return keys_of


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each run of True."""
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [start, start + length) of some start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(length: int):
    def cut(batches):
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            ids = batch.column("doc_id")
            for r in range(batch.num_rows):
                text = batch.column("text")[r].as_py()
                words = text.encode().split() if text else []
                lists = batch.column("extras")[r].as_py()
                spans, gone = [], 0
                if lists:
                    body = np.frombuffer(text.encode(), np.uint8)
                    places, _ = own_places(lists, tags(body, np.array([0, len(body)]))[0])
                    mask = covered(places, length, len(words))
                    first, end = runs(mask)
                    spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(first, end)]
                    gone = int(mask.sum())
                    words_left = compress(words, ~mask)
                else:
                    words_left = words
                for column, value in zip(columns, (ids[r].as_py(), b" ".join(words_left).decode(), len(words), gone, spans)):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(),
                     pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc_id", "kept", "n_words", "n_removed", "spans"])

    return cut


def substring_dedup(documents: DataFrame, length: int = 35, seed: int = 5) -> DataFrame:
    """Texts without the word runs of ``length`` words that occur more than once.

    Needs columns doc_id and text; others are ignored. Gives for each row doc_id,
    kept (words left, one space between), n_words, n_removed and spans (first
    and last removed word of each maximal run).

    A null or empty text has no words. Repeated rows are occurrences of their
    own, so a row that is there twice loses all words if it has ``length`` of
    them. A null doc_id is an id like any other. No rows give no rows.
    """
    if not 1 <= seed <= length:
        raise ValueError("a seed has between 1 and length words")
    docs = keyed(documents)
    parts = parts_for(documents)
    anchors = by_owner(recurring(docs.select("k", "doc_id", "text"), _anchor_keys(length, seed), parts))
    # doc_id goes along so that both joins can share one exchange of the texts
    seeded = docs.join(anchors, docs.k == anchors.owner).select("k", "doc_id", "text", "keys")
    repeats = by_owner(recurring(seeded, _window_keys(length, seed), parts))
    rows = docs.join(repeats, docs.k == repeats.owner, "left").select("k", "doc_id", "text", "extras")
    return rows.mapInArrow(g.tidy(_cut(length)), _OUT)
