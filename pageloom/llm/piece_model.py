"""SentencePiece models on the tokenizers library (operator 2).

The model file is read by its protobuf fields; from them the normaliser, the
white-space marker, the scores (or merges) and the byte fallback are rebuilt as
a ``tokenizers`` pipeline. Batches are encoded by the library's threads.

Where no piece reaches from a character to a white-space marker behind it, the
ids of a text are those of its words, each with the spaces before it. A task
then encodes every distinct word once. Models or texts for which that does not
hold are encoded whole.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import grams as g
from .tokens import WordIds

MARK = "▁"
# kinds of pieces and models in the file format (fixed values)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix: bool = False


def _fields(body: bytes):
    """(number, value) of a protobuf message; nested messages stay bytes."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = body[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(body):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        elif wire == 2:
            size = varint()
            yield number, body[i : i + size]
            i += size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield number, body[i : i + size]
            i += size
        else:
            raise ValueError(f"wire type {wire} is not in this format")


def read_model(path: str) -> Model:
    """Pieces and settings of a model file. Field numbers are those of the format."""
    with open(path, "rb") as f:
        body = f.read()
    m = Model()
    for number, value in _fields(body):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind = spec.get(3, UNIGRAM)
            m.byte_fallback = bool(spec.get(35, 0))
            m.suffix = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix = bool(spec.get(3, 1))
            m.remove_extra = bool(spec.get(4, 1))
            m.escape = bool(spec.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are rebuilt")
    if m.suffix:
        raise ValueError("models with the marker behind words are not rebuilt")
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that form a piece, best score first."""
    number = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in number.items():
        if m.pieces[i][2] != NORMAL:
            continue
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in number and right in number:
                found.append((-m.pieces[i][1], number[left], number[right], left, right))
    found.sort()
    return [(x[3], x[4]) for x in found]


def build(m: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unknown, m.byte_fallback)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, _merges(m), unk_token=m.pieces[unknown][0],
                           fuse_unk=True, byte_fallback=m.byte_fallback)
    tokenizer = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    own = [AddedToken(p, normalized=True) for p, _, kind in m.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return tokenizer


def splits_by_word(m: Model) -> bool:
    """Whether words, each with the spaces before it, can be encoded by themselves."""
    plain = not m.charsmap and not m.remove_extra and m.dummy_prefix and m.escape
    return plain and not any(kind == USER_DEFINED or (MARK in p[1:] and p.strip(MARK)) for p, _, kind in m.pieces)


class Encoder:
    """A model opened in a worker."""

    def __init__(self, path: str, threads: int) -> None:
        # the library's threads; one task has as many cores as the cluster gives it
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.model = read_model(path)
        self.tokenizer = build(self.model)
        self.by_word = splits_by_word(self.model)
        self.mark = next((i for i, p in enumerate(self.model.pieces) if p[0] == MARK), None)
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.threads = threads
        self.words = WordIds(None)
        self.words._learn = self._learn
        self.same = np.zeros(0, bool)  # parity of the kept words, in their order

    def _learn(self, words: list[str], codes: np.ndarray) -> None:
        w = self.words
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        theirs = self.other.encode(words, num_threads=self.threads)
        same = np.array([a == b for a, b in zip(got, theirs)], bool)
        if not len(w.codes):
            self.same = np.zeros(0, bool)
        count = np.array([len(x) for x in got], np.int64)
        first = np.cumsum(count) - count + len(w.ids)
        w.ids = np.concatenate([w.ids, *(np.array(x, np.int32) for x in got)])
        order = np.argsort(np.concatenate([w.codes, codes]), kind="stable")
        w.codes = np.concatenate([w.codes, codes])[order]
        w.first = np.concatenate([w.first, first])[order]
        w.count = np.concatenate([w.count, count])[order]
        self.same = np.concatenate([self.same, same])[order]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, their number in each, and whether each agrees with sentencepiece."""
        if not self.by_word or MARK.encode() in data.tobytes():
            body = data.tobytes()
            texts = [body[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = self.other.encode(texts, num_threads=self.threads)
            ids = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in got)])
            return ids, np.array([len(x) for x in got], np.int64), np.array([a == b for a, b in zip(got, theirs)], bool)
        rows = len(at) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64), np.ones(rows, bool)
        space = data == 32
        begins = np.zeros(len(data), bool)
        begins[1:] = space[1:] & ~space[:-1]
        filled = at[:-1] < at[1:]
        begins[at[:-1][filled]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        # inside a text the space before a word is its marker; at the start the prefix is
        inside = np.ones(len(starts), bool)
        first = np.searchsorted(starts, at)
        inside[first[:-1][filled]] = False
        starts = starts + inside
        some = starts < ends
        kept, ids, count = self.words.of_spans(data, starts[some], ends[some])
        counts = np.ones(len(starts), np.int64)  # a space alone is a marker
        counts[some] = count
        sums = np.concatenate([[0], np.cumsum(counts)])
        out = np.full(int(sums[-1]), self.mark if self.mark is not None else 0, np.int32)
        out[g.ranges(sums[:-1][some], count)] = ids
        differs = np.zeros(len(starts), np.int64)
        differs[some] = ~self.same[kept]
        wrong = np.concatenate([[0], np.cumsum(differs)])
        return out, np.diff(sums[first]), np.diff(wrong[first]) == 0


_OPEN: dict[tuple, Encoder] = {}


def _encoder(path: str, threads: int) -> Encoder:
    if (path, threads) not in _OPEN:
        _OPEN[path, threads] = Encoder(path, threads)
    return _OPEN[path, threads]


def _threads(df: DataFrame) -> int:
    return int(df.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian, 32 bits), n_ids and parity with sentencepiece.

    Needs columns doc_id and text; others are ignored. ``path`` is a model file
    that all executors can read. A null or empty text has no ids. Repeated rows
    and null ids are encoded like any other. No rows give no rows.
    """
    threads = _threads(documents)

    def run(batches):
        encoder = _encoder(path, threads)
        for batch in batches:
            data, at = g.texts(batch.column("text"))
            for i, j in g.slices(at, 4 * g.SLICE):
                ids, counts, same = encoder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                body, cut = ids.astype("<u4").tobytes(), 4 * np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i),
                     pa.array([body[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()),
                     pa.array(counts), pa.array(same)],
                    names=["doc_id", "ids", "n_ids", "parity"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n_ids long, parity boolean")


class Decoder:
    """Bytes of each id; what tokenizers' decoder gives, for many rows at once."""

    def __init__(self, m: Model) -> None:
        bodies = []
        for piece, _, kind in m.pieces:
            if kind == BYTE:
                bodies.append(bytes([int(piece[1:-1], 16)]))
            elif kind in (CONTROL, UNKNOWN):
                bodies.append(b"" if kind == CONTROL else " ⁇ ".encode())
            else:
                bodies.append(piece.replace(MARK, " ").encode() if m.escape else piece.encode())
        self.size = np.array([len(b) for b in bodies])
        self.first = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(bodies), np.uint8)
        self.prefix = m.dummy_prefix

    def text(self, ids: np.ndarray) -> str:
        out = self.body[g.ranges(self.first[ids], self.size[ids])].tobytes().decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of ids (as ``encode`` gives them).

    Bytes that are not UTF-8 become replacement characters; control ids become
    nothing; null ids give an empty text. Other columns are ignored.
    """

    def run(batches):
        decoder = Decoder(read_model(path))
        for batch in batches:
            texts = [decoder.text(np.frombuffer(b or b"", "<u4").astype(np.int64)) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Rows of ``encode`` with ``restored``: whether decoding gives the text back."""
    threads = _threads(documents)

    def run(batches):
        encoder = _encoder(path, threads)
        decoder = Decoder(encoder.model)
        for batch in batches:
            data, at = g.texts(batch.column("text"))
            for i, j in g.slices(at, 4 * g.SLICE):
                body = data[at[i] : at[j]]
                ids, counts, same = encoder.encode(body, at[i : j + 1] - at[i])
                cut = np.concatenate([[0], np.cumsum(counts)])
                flat = body.tobytes()
                restored = [decoder.text(ids[cut[r] : cut[r + 1]]).encode() == flat[at[i + r] - at[i] : at[i + r + 1] - at[i]]
                            for r in range(j - i)]
                all_ids = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i),
                     pa.array([all_ids[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()),
                     pa.array(counts), pa.array(same), pa.array(restored, pa.bool_())],
                    names=["doc_id", "ids", "n_ids", "parity", "restored"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids binary, n_ids long, parity boolean, restored boolean")
