"""Phrase collocations by SON partitioning (operator 13).

Texts are split into pieces at ``. , ; : ! ?`` and line ends, pieces into words.
Phrases of up to ``longest`` words that occur ``support`` times in a language
are found in two passes:

* Mining. Documents are dealt to ``shards`` shards. Every shard is mined
  completely: its tasks send the counts of all their phrases as sorted,
  compressed blocks of 64-bit hashes, dealt by (shard, range of hashes), and a
  phrase is locally frequent if its shard holds it
  ``(support - 1) // shards + 1`` times. A phrase with ``support`` occurrences
  reaches that in one shard at least (pigeonhole), so none is missed.
* Counting. The union of the locally frequent phrases goes to all tasks as a
  bit map of at most ``BITS`` bits. What it lets through is counted exactly, by
  the words themselves, and cut at ``support``; a bit that several phrases
  share only lets more through.

Scores, the choice of the cut, containment and ranks are joins and windows over
the frequent phrases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import grams as g
from .recurring import packed, parts_for, unpacked

SHARDS = 4
#: bits of the map of candidates; at most 32 MB, and one bit in BITS_EACH set while there are few
BITS, BITS_EACH = 1 << 28, 32
#: phrases that a task gathers before it sends their counts
GATHERED = 1 << 21
#: distinct candidates that a task holds as text
HELD = 1 << 18
#: parts of a language that are cut to its first rows before they meet
SALTS = 64

#: signs that end a piece, and white space within one (fixed values)
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 32]] = True


class Phrases:
    """Words of a slice of texts and the hashes of its phrases."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lang: np.ndarray) -> None:
        self.data = d = g.LOWER[data]
        end = ENDS[d]
        gap = end | BLANK[d]
        first = np.zeros(len(d), bool)
        filled = at[:-1] < at[1:]
        first[at[:-1][filled]] = True
        before = np.r_[True, gap[:-1]] | first
        after = np.r_[gap[1:], True] | np.r_[first[1:], True]
        self.starts = np.flatnonzero(~gap & before)
        self.ends = np.flatnonzero(~gap & after) + 1
        self.text = np.searchsorted(at, self.starts, "right") - 1
        # words of one piece: as many piece ends and text starts before them
        self.piece = (np.cumsum(end) + np.cumsum(first))[self.starts]
        self.codes = g.word_codes(d, self.starts, self.ends)
        self.lang = lang

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash (language and words) and first word of each phrase of ``size`` words."""
        hashes = g.windows(self.codes, size)
        if not len(hashes):
            return hashes, np.zeros(0, np.int64)
        place = np.flatnonzero(self.piece[size - 1 :] == self.piece[: len(hashes)])
        return g.mix(hashes[place] + self.lang[self.text[place]] * np.uint64(2 * size + 1)), place


def _sliced(batch: pa.RecordBatch):
    data, at = g.texts(batch.column("text"))
    names = batch.column("lang").to_pylist()
    codes = batch.column("code").to_numpy().astype(np.int64).view(np.uint64)
    for i, j in g.slices(at, 2 * g.SLICE):
        yield Phrases(data[at[i] : at[j]], at[i : j + 1] - at[i], codes[i:j]), names[i:j]


def _rows(documents: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    return documents.select("text", lang.alias("lang"), F.xxhash64(lang).alias("code"))


def _mined(documents: DataFrame, support: int, longest: int, shards: int) -> DataFrame:
    """(hash range, locally frequent hashes) of all shards."""
    parts = parts_for(documents)
    least = (support - 1) // shards + 1

    def send(lot, part0):
        hashes, count = np.unique(np.concatenate(lot), return_counts=True)
        part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(cut[1:] > cut[:-1])
        shard = part0 % shards
        body = [packed(np.diff(hashes[a:b], prepend=np.uint64(0)), count[a:b].astype(np.uint64))
                for a, b in zip(cut[full].tolist(), cut[full + 1].tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(full), shard)), pa.array(full), pa.array(cut[full + 1] - cut[full]), pa.array(body, pa.binary())],
            names=["shard", "part", "count", "body"])

    def count(batches):
        lot, size, number = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for phrases, _ in _sliced(batch):
                for n in range(1, longest + 1):
                    lot.append(phrases.of(n)[0])
                    size += len(lot[-1])
                if size >= GATHERED:
                    yield send(lot, number)
                    lot, size = [], 0
        if size:
            yield send(lot, number)

    def frequent(table: pa.Table) -> pa.Table:
        lots = [unpacked(b, n, 2) for b, n in zip(table.column("body").to_pylist(), table.column("count").to_pylist())]
        hashes = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in lots])
        counts = np.concatenate([x[1] for x in lots])
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        begin = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        keep = np.add.reduceat(counts, begin) >= least
        found = hashes[begin][keep]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "n": pa.array([len(found)], pa.int64()),
                         "hashes": pa.array([found.tobytes()], pa.binary())})

    sent = _rows(documents).mapInArrow(g.tidy(count), "shard long, part long, count long, body binary")
    return sent.groupBy("shard", "part").applyInArrow(frequent, "part long, n long, hashes binary")


def _bit_map(mined: DataFrame, most: int) -> np.ndarray:
    """Bits of the candidates, by their leading bits, as bytes; bounded by ``most`` bits."""
    total = mined.agg(F.sum("n")).first()[0] or 0
    bits = 1 << 16
    while bits < min(total * BITS_EACH, most):
        bits *= 2
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def stretch(table: pa.Table) -> pa.Table:
        """The stretch of the map that a range of hashes fills, of all shards."""
        hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
        places = np.unique(hashes >> shift)
        low = int(places[0]) >> 3
        own = np.zeros((int(places[-1]) >> 3) - low + 1, np.uint8)
        np.bitwise_or.at(own, (places >> np.uint64(3)).astype(np.int64) - low,
                         np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
        return pa.table({"low": pa.array([low], pa.int64()), "bits": pa.array([own.tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for row in mined.filter("n > 0").groupBy("part").applyInArrow(stretch, "low long, bits binary").collect():
        own = np.frombuffer(row.bits, np.uint8)
        out[row.low : row.low + len(own)] |= own
    return out


def frequent_phrases(documents: DataFrame, support: int = 10, longest: int = 3, shards: int = SHARDS,
                     bits: int = BITS) -> DataFrame:
    """lang, phrase, size (words) and f of all phrases with ``support`` occurrences in their language.

    A row with a null phrase and size 0 holds the number of words of a language.
    """
    spark = documents.sparkSession
    mined = materialize(_mined(documents, support, longest, shards), "mined")
    sent = spark.sparkContext.broadcast(_bit_map(mined, bits))

    def emit(counts, names):
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[k][0] for k in keys], pa.string()), pa.array([names[k][1] for k in keys], pa.string()),
             pa.array([names[k][2] for k in keys], pa.int64()), pa.array([counts[k] for k in keys], pa.int64())],
            names=["lang", "phrase", "size", "f"])

    def count(batches):
        table = sent.value
        shift = np.uint64(64 - (8 * len(table)).bit_length() + 1)
        counts, names = {}, {}
        for batch in batches:
            for phrases, langs in _sliced(batch):
                body = phrases.data.tobytes()
                words = np.bincount(phrases.text, minlength=len(langs)) if len(langs) else []
                for lang, n in zip(langs, words):
                    if n:
                        counts[lang] = counts.get(lang, 0) + int(n)
                        names[lang] = (lang, None, 0)
                for size in range(1, longest + 1):
                    hashes, place = phrases.of(size)
                    bit = hashes >> shift
                    inside = table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
                    keep = np.flatnonzero(inside)
                    distinct, example, n = np.unique(hashes[keep], return_index=True, return_counts=True)
                    at = place[keep[example]]
                    for h, k, p in zip(distinct.tolist(), n.tolist(), at.tolist()):
                        if h in counts:
                            counts[h] += k
                            continue
                        counts[h] = k
                        names[h] = (langs[phrases.text[p]], b" ".join(
                            [body[phrases.starts[q] : phrases.ends[q]] for q in range(p, p + size)]).decode(), size)
                if len(counts) >= HELD:
                    yield emit(counts, names)
                    counts, names = {}, {}
        if counts:
            yield emit(counts, names)

    rows = _rows(documents).mapInArrow(g.tidy(count), "lang string, phrase string, size long, f long")
    out = rows.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return out.filter((F.col("f") >= support) | (F.col("size") == 0))


def scored(frequent: DataFrame, percent: int = 50) -> DataFrame:
    """Candidates of two words or more with a, l, r, score, less those that a longer one covers.

    Counts are below 10^15, so 1000000 * a * a stays below 10^38 and is exact.
    """
    words = F.split("phrase", " ")
    cand = frequent.filter("size >= 2").withColumnRenamed("f", "a")
    part = frequent.filter("size >= 1").select("lang", F.col("phrase").alias("p"), "f")
    cuts = cand.select("lang", "phrase", "size", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int"))).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("head"),
                       F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("rest"))
    for side, name in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(part.withColumnsRenamed({"p": side, "f": name}), ["lang", side])
    exact = F.expr("cast((cast(1000000 as decimal(8,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) "
                   "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    cuts = cuts.withColumn("score", exact)
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = cand.filter("size >= 3").select("lang", "a", "size", words.alias("w")).select(
        "lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), (F.col("size") - 1).cast("int"))).alias("n"))
    inner = inner.select("lang", "a", "w", "n", F.explode(F.sequence(F.lit(1), (F.col("size") - F.col("n") + 1).cast("int"))).alias("s"))
    longer = inner.groupBy("lang", F.concat_ws(" ", F.slice("w", F.col("s"), F.col("n"))).alias("phrase")).agg(F.max("a").alias("longer"))
    out = best.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    return out.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(documents: DataFrame, support: int = 10, longest: int = 3, first: int = 2000, percent: int = 50,
                 shards: int = SHARDS) -> DataFrame:
    """The ``first`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Needs columns text and lang; others are ignored. A null language is ``und``,
    a null or empty text has no words, repeated rows count as often as they
    are there, and languages without a candidate give no rows, nor does an
    empty table. Ties go to the higher a, then to the smaller phrase in byte
    order. Whole texts count, however long. n is the number of all words of a
    language.
    """
    found = materialize(frequent_phrases(documents, support, longest, shards), "phrases")
    rows = materialize(scored(found.filter("size > 0"), percent), "collocations")
    order = (F.desc("score"), F.desc("a"), "phrase")
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    total = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
