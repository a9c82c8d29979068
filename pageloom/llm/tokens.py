"""Token ids of whole texts, word by word.

Tokenizers whose pieces never reach over white space give a word the same ids
wherever it stands. A task therefore encodes each distinct word once, many in
one text, and finds the ids of a text by its words' hashes.
"""

from __future__ import annotations

import os

import numpy as np

from . import grams as g

#: distinct words kept by a worker before it starts anew
KEPT_WORDS = 1 << 18
#: words encoded as one text
JOINED = 512


class WordIds:
    """Ids of words; ``encode(texts)`` gives (ids, character offsets) of each text."""

    def __init__(self, encode) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.first = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, words: list[str], codes: np.ndarray) -> None:
        if len(self.codes) + len(codes) > KEPT_WORDS:
            self.clear()
        ids, counts = [self.ids], []
        lots = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for lot, (got, offsets) in zip(lots, self.encode([" ".join(x) for x in lots])):
            ends = np.cumsum([len(w) + 1 for w in lot])
            owner = np.searchsorted(ends, offsets, "right")
            counts.append(np.bincount(owner, minlength=len(lot)))
            ids.append(got)
        count = np.concatenate(counts)
        first = np.cumsum(count) - count + len(self.ids)
        self.ids = np.concatenate(ids)
        order = np.argsort(np.concatenate([self.codes, codes]), kind="stable")
        self.codes = np.concatenate([self.codes, codes])[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        starts, ends, words = g.word_spans(data, at)
        which, ids, count = self.of_spans(data, starts, ends)
        sums = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(sums[words])

    def of_spans(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of spans of bytes that are not empty: where each is kept, all ids, their number."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes = g.word_codes(data, starts, ends)
        distinct, example, which = np.unique(codes, return_index=True, return_inverse=True)
        unknown = np.flatnonzero(~np.isin(distinct, self.codes, assume_unique=True))
        if len(self.codes) + len(unknown) > KEPT_WORDS:
            self.clear()
            unknown = np.arange(len(distinct))
        if len(unknown):
            body = data.tobytes()
            e = example[unknown]
            self._learn([body[a:b].decode() for a, b in zip(starts[e].tolist(), ends[e].tolist())], distinct[unknown])
        found = np.searchsorted(self.codes, distinct)
        first, count = self.first[found][which], self.count[found][which]
        return found[which], self.ids[g.ranges(first, count)], count


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The words of a tokenizers file; one a worker, opened when first needed."""
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode(texts):
            for e in tokenizer.encode_batch(texts, add_special_tokens=False):
                yield np.array(e.ids, np.int32), np.array([a for a, _ in e.offsets], np.int64)

        _OPEN[path] = WordIds(encode)
    return _OPEN[path]
