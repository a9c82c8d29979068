"""Order-preserving packing of token sequences by dynamic programming (operator 3).

The documents of an input split, in their order, form one stream of tokens. It
is cut into windows of at most ``window`` tokens so that padding plus penalties
for cuts is least. A cut costs nothing at the end of a document, ``sentence``
tokens at the end of a sentence, and ``within`` tokens elsewhere, where every
``GRID``-th token of a document is a candidate. With the cost of a window

    window - length + penalty of the cut that ends it

the best cost up to a candidate depends on the smallest (cost + place) among
the candidates at most a window earlier, which a monotone queue holds: the
program is linear in the number of candidates.

Splits are packed by themselves, without a shuffle. A task keeps ``HORIZON``
tokens: what is decided is written, the open window goes on with the next
tokens, so only the end of a split leaves a window short.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import grams as g
from .tokens import word_ids

GRID = 32
HORIZON = 1 << 20

_OUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int, last: bool) -> list[int]:
    """The cuts (places) of the cheapest packing of tokens 0 to the last place.

    ``places`` rises, by ``window`` at most. With ``last`` the last place is a
    cut; otherwise the last cut is the one from which it is cheapest to go on.
    """
    at, cost = places.tolist(), penalties.tolist()
    came = [0] * len(at)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (cost + place, place, candidate)
    push, pop, shift = queue.append, queue.pop, queue.popleft
    for j, place in enumerate(at):
        low = place - window
        while queue[0][1] < low:
            shift()
        value, _, came[j] = queue[0]
        value += window + cost[j]
        while queue and queue[-1][0] >= value:
            pop()
        push((value, place, j))
    j = len(at) - 1
    if not last:
        while queue[0][1] < at[-1] - window + 1:
            shift()
        j = queue[0][2]
    cuts = []
    while j >= 0:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


class Stream:
    """Tokens and documents of a split that are not yet packed."""

    def __init__(self, window: int, sentence: int, within: int, enders: np.ndarray) -> None:
        self.window, self.sentence, self.within, self.enders = window, sentence, within, enders
        self.ids = np.zeros(0, np.int32)
        self.names: list = []
        self.first = self.size = np.zeros(0, np.int64)  # of each document; the first may have begun before
        self.sequence = TaskContext.get().partitionId() << 36 if TaskContext.get() else 0
        self.lots: list[tuple] = []
        self.waiting = 0

    def add(self, names: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.lots.append((names, ids, sizes))
        self.waiting += len(ids)

    def take(self, last: bool) -> pa.RecordBatch | None:
        names = self.names + [n for x in self.lots for n in x[0]]
        sizes = np.concatenate([self.size, *(x[2] for x in self.lots)])
        ids = np.concatenate([self.ids, *(x[1] for x in self.lots)])
        self.lots, self.waiting = [], 0
        if not len(ids):
            return None
        begin = self.first[0] if len(self.first) else 0
        first = np.cumsum(sizes) - sizes + begin
        places, penalties = self._candidates(ids, first, sizes)
        cuts = np.array([0, *best_cuts(places, penalties, self.window, last)])
        end = cuts[-1]
        out = self._pieces(names, ids, first, sizes, cuts)
        keep = int(np.searchsorted(first + sizes, end, "right"))
        self.names, self.first, self.size, self.ids = names[keep:], first[keep:] - end, sizes[keep:], ids[end:]
        return out

    def _candidates(self, ids, first, sizes):
        ends = first + sizes
        sentences = np.flatnonzero(np.isin(ids, self.enders)) + 1
        steps = (sizes - 1) // GRID
        grid = np.repeat(first, steps) + (g.ranges(np.zeros(len(steps)), steps) + 1) * GRID
        places = np.concatenate([ends, sentences, grid[grid > 0]])
        penalties = np.repeat([0, self.sentence, self.within], [len(ends), len(sentences), int((grid > 0).sum())])
        order = np.lexsort((penalties, places))
        places, penalties = places[order], penalties[order]
        keep = np.r_[True, places[1:] != places[:-1]]
        return places[keep], penalties[keep]

    def _pieces(self, names, ids, first, sizes, cuts):
        end = cuts[-1]
        at = np.unique(np.concatenate([cuts, first[(first > 0) & (first < end)]]))
        begin, length = at[:-1], np.diff(at)
        doc = np.searchsorted(first, begin, "right") - 1
        window = np.searchsorted(cuts, begin, "right") - 1
        body = ids.astype("<u4").tobytes()
        out = pa.RecordBatch.from_arrays(
            [pa.array([names[d] for d in doc.tolist()], pa.int64()), pa.array(begin - first[doc]), pa.array(length),
             pa.array(sizes[doc]), pa.array(self.sequence + window), pa.array(begin - cuts[window]),
             pa.array([body[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist())], pa.binary())],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        self.sequence += len(cuts) - 1
        return out


def sentence_ends(path: str) -> np.ndarray:
    """Ids of tokens that end a word and are nothing but . ! ? (fixed values)."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab()
    return np.array(sorted(i for t, i in vocabulary.items()
                           if t.endswith("</w>") and t[:-4] and not t[:-4].strip(".!?")), np.int32)


def pack(documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, sentence: int = 4,
         within: int = 16) -> DataFrame:
    """Pieces of documents in windows of ``window`` tokens.

    Needs columns doc_id and text; others are ignored. A document is the ids of
    its text followed by ``end_id``. Gives for each piece doc_id, start (ids of
    the document before it), length, doc_tokens (ids of the document),
    sequence_id, offset (place in the sequence) and ids (little-endian, 32 bits).

    A null or empty text is the end id alone. Repeated rows and null ids are
    packed like any other. No rows give no rows.
    """
    if window < GRID:
        raise ValueError(f"a window has at least {GRID} tokens")
    enders = sentence_ends(tokenizer)

    def run(batches):
        words = word_ids(tokenizer)
        stream = Stream(window, sentence, within, enders)
        for batch in batches:
            data, at = g.texts(batch.column("text"))
            for i, j in g.slices(at):
                ids, counts = words.of(data[at[i] : at[j]], at[i : j + 1] - at[i])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                stream.add(batch.column("doc_id").slice(i, j - i).to_pylist(), ids, counts + 1)
                if stream.waiting >= HORIZON:
                    yield stream.take(last=False)
        out = stream.take(last=True)
        if out is not None:
            yield out

    return documents.select("doc_id", "text").mapInArrow(g.tidy(run), _OUT)
