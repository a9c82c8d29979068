"""N-gram Jaccard join as a blocked sparse matrix product (operator 1).

Rows of the incidence matrix are documents, columns are their distinct word
n-grams; two documents link when 100 * overlap >= percent * union. Documents
with the same set are one row (its node is a hash of the set).

* Bounds. The n-grams of a row are ordered, frequent ones last, and cut: of n
  of them only the first n - ceil(n * percent / 100) + depth enter the product,
  where depth grows with n. A pair that links shares at least the smaller depth
  of those columns, and their sizes differ by no more than the percentage, so
  rows and pairs below these bounds are discarded before any set is read.
* Blocks. Columns of one row alone are found by ranges of columns
  (``recurring``) and dropped; what is left is a small sparse matrix.
* Rounds. Rows of a dense column are first compared with a few rows of the
  column's largest component, among them the one with the fewest columns of its
  own, from which others differ least; after that only rows outside it are multiplied
  with the rest, and overlap counts are accumulated pair by pair. Rows of one
  component need no comparison, so a group of copies costs its rows, not its
  pairs. The last round is complete, so no link between components is lost.
* Pairs that pass the bounds meet as bit maps of their sets first: a bit that
  one row has and the other lacks is an n-gram that they don't share, so most
  pairs are discarded by a bound on the overlap, without reading a text.
* What is left is verified on the full sets.

The order of the columns only decides what is cheap, never what links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import grams as g
from .components import components, salted_join, unused
from .recurring import parts_for, recurring

#: columns that a pair must share within the cut: one for STEP of a row, DEPTH at most
DEPTH = 10
STEP = 16
#: n-grams of a lot, which bounds what a task counts at once
LOT = 1 << 21
#: an n-gram is frequent if one lot of documents holds it so often
OFTEN = 6
#: frequent n-grams that are ordered last; further ones are ordered like others
MOST_FREQUENT = 1 << 20
#: rounds that try some rows of the largest component before the complete one
TRIES = 2
#: rows of a column's largest component that are tried, and pairs of a row
SEEDS, TRIED = 6, 6
#: rows whose texts are wanted and that are sent to the tasks that read texts; more are joined by shuffles
SENT_ROWS = 500_000
#: bits of a row's map for each n-gram, at least
BITS_EACH = 4
#: parts of a group of copies, which is split where it meets its component
SALTS = 16

#: words of 64 bits of the small map that meets within a column
WORDS = 4
_SMALL = [f"m{i}" for i in range(WORDS)]
_SKETCH = "k long, doc_id long, node long, n long, bits binary, " + ", ".join(f"{m} long" for m in _SMALL) + ", gram long, count long"


def shingles(data: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text (hash, text), by text and hash.

    A-Z count as a-z. A text with fewer words has one n-gram, all its words.
    """
    d = g.LOWER[data]
    starts, ends, words = g.word_spans(d, first)
    codes = g.word_codes(d, starts, ends)
    place, text = g.starts_of_windows(words, size)
    grams = g.windows(codes, size)[place]
    counts = np.diff(words)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = g.mix(g.windows(codes, n)[words[short]] + np.uint64(n))
            grams, text = np.r_[grams, whole], np.r_[text, short]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    if len(grams):
        keep = np.r_[True, (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])]
        grams, text = grams[keep], text[keep]
    return grams, text


def _nodes(grams: np.ndarray, text: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each set and a hash of it."""
    n = np.bincount(text, minlength=rows)
    node = np.zeros(rows, np.uint64)
    begin = np.cumsum(n) - n
    filled = n > 0
    if filled.any():
        node[filled] = np.add.reduceat(g.mix(grams + g.ROOT), begin[filled])
    return n, g.mix(node + n.astype(np.uint64) * g.ROOT).view(np.int64)


def _map_bits(n: np.ndarray) -> np.ndarray:
    """Logarithm of the number of bits of rows of n n-grams."""
    return np.ceil(np.log2(np.maximum(BITS_EACH * n, 8))).astype(np.int64)


def _bit_maps(grams: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The bit map of each set, by the leading bits of its n-grams."""
    out, at = [], 0
    logs = _map_bits(n)
    for count, log in zip(n.tolist(), logs.tolist()):
        own = np.zeros(1 << log, bool)
        own[(grams[at : at + count] >> np.uint64(64 - log)).astype(np.int64)] = True
        out.append(np.packbits(own).tobytes() if count else b"")
        at += count
    return out


def _small_maps(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The map of ``WORDS`` words of each set, by other bits of its n-grams; a column for each word."""
    out = np.zeros((len(n), 64 * WORDS), bool)
    out[np.repeat(np.arange(len(n)), n), (grams & np.uint64(64 * WORDS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view("<i8").T


def _most_shared(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """An upper bound on the overlap of two sets, from their bit maps."""
    one, two = (np.unpackbits(np.frombuffer(x, np.uint8)).view(bool) for x in (a, b))
    while len(one) > len(two):
        one = one[::2] | one[1::2]
    while len(two) > len(one):
        two = two[::2] | two[1::2]
    both = int(np.count_nonzero(one & two))
    return min(n_a - int(np.count_nonzero(one)) + both, n_b - int(np.count_nonzero(two)) + both)


def _sketch(size: int):
    """A row for each document, and the n-grams that are frequent in each lot."""

    names = ["k", "doc_id", "node", "n", "bits", *_SMALL, "gram", "count"]

    def often(seen):
        grams, count = np.unique(np.concatenate(seen), return_counts=True)
        keep = count >= OFTEN
        none = pa.nulls(int(keep.sum()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.nulls(len(none), pa.binary()), *[none] * WORDS, pa.array(grams[keep].view(np.int64)),
             pa.array(count[keep].astype(np.int64))], names=names)

    def run(batches):
        seen, size_seen = [], 0
        for batch in batches:
            data, at = g.texts(batch.column("text"))
            keys, ids = batch.column("k"), batch.column("doc_id")
            for i, j in g.slices(at):
                grams, text = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
                n, node = _nodes(grams, text, j - i)
                seen.append(grams)
                size_seen += len(grams)
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), ids.slice(i, j - i), pa.array(node), pa.array(n.astype(np.int64)),
                     pa.array(_bit_maps(grams, n), pa.binary()), *[pa.array(np.ascontiguousarray(m)) for m in _small_maps(grams, n)],
                     none, none], names=names)
                if size_seen >= LOT:
                    yield often(seen)
                    seen, size_seen = [], 0
        if seen:
            yield often(seen)

    return run


def _frequent(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, sorted, and the logarithm of their counts (bounded)."""
    top = (sketch.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("count").alias("c"))
           .filter(F.col("c") >= 4 * OFTEN).orderBy(F.desc("c"), "gram").limit(MOST_FREQUENT)
           .select("gram", F.ceil(F.log2("c")).cast("int").alias("level")).toPandas())
    grams = top["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], top["level"].to_numpy(np.uint64)[order]


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _depth(n: np.ndarray) -> np.ndarray:
    """Columns a row must share within its cut; never more than it must share at all."""
    return np.clip(n // STEP, 1, DEPTH)


def _depth_of(n: str):
    return F.greatest(F.lit(1), F.least(F.lit(DEPTH), F.floor(F.col(n) / STEP)))


def _cut_keys(size: int, percent: int, frequent):
    """The columns within the cut of each row; extras: size of the set and rank of the column."""

    def keys_of(batch):
        often, level = frequent.value
        data, at = g.texts(batch.column("text"))
        for i, j in g.slices(at):
            grams, text = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], size)
            if not len(grams):
                continue
            n, node = _nodes(grams, text, j - i)
            late = np.zeros(len(grams), np.uint64)
            if len(often):
                found = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                hit = often[found] == grams
                late[hit] = level[found[hit]]
            order = np.lexsort((grams, late, text))
            grams, text = grams[order], text[order]
            rank = np.arange(len(grams)) - (np.cumsum(n) - n)[text]
            least = _least_overlap(n, percent)
            within = rank < (n - least + np.minimum(_depth(n), least))[text]
            grams, text, rank = grams[within], text[within], rank[within]
            yield grams, node[text], (n[text] << 32 | rank).astype(np.uint64), node[text]

    return keys_of


def _postings(table: pa.Table) -> pa.Table:
    """(gram, node, n, rank) rows of the columns that several rows share."""
    keys = [np.frombuffer(b, np.int64) for b in table.column("keys").to_pylist()]
    extras = [np.frombuffer(b, np.int64) for b in table.column("extras").to_pylist()]
    owner = np.repeat(table.column("owner").to_numpy(), [len(k) for k in keys])
    none = [np.zeros(0, np.int64)]
    extras = np.concatenate(extras + none)
    return pa.table({"gram": np.concatenate(keys + none), "node": owner.astype(np.int64), "n": extras >> 32,
                     "rank": extras & 0xFFFFFFFF})


def _able(postings: DataFrame, percent: int) -> DataFrame:
    """Postings of rows that share enough columns to link with the smallest row they may link with.

    Adds ``before``: shared columns of the row that come earlier.
    """
    row = Window.partitionBy("node")
    p = postings.withColumns({"before": F.row_number().over(row.orderBy("rank", "gram")) - 1, "_c": F.count("*").over(row),
                              "_least": F.ceil(F.col("n") * percent / 100)})
    return p.filter(F.col("_c") >= _depth_of("_least")).drop("_c", "_least")


def _reach(percent: int):
    """The overlap that a column leaves possible allows the link.

    Of the columns before it only shared ones count; behind it, at most what
    the shorter rest holds.
    """
    most = F.least("before_a", "before_b") + F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b"))
    return most >= F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))


def _side(name: str) -> list:
    return [F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "rank", "before", "component", *_SMALL)]]


def _maps_allow(percent: int):
    """The small maps allow the link: a bit that one has and the other lacks is an n-gram not shared."""
    def ones(name):
        return sum((F.bit_count(f"{m}_{name}") for m in _SMALL), F.lit(0))

    both = sum((F.bit_count(F.col(f"{m}_a").bitwiseAND(F.col(f"{m}_b"))) for m in _SMALL), F.lit(0))
    most = both + F.least(F.col("n_a") - ones("a"), F.col("n_b") - ones("b"))
    return most * (100 + percent) >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))


def _verify(size: int, percent: int):
    def sets(column, i, j):
        data, at = g.texts(column.slice(i, j - i))
        return shingles(data, at, size)

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            one, two = batch.column("text_a"), batch.column("text_b")
            at1, at2 = g.texts(one)[1], g.texts(two)[1]
            for i, j in g.slices(at1 + at2):
                g1, t1 = sets(one, i, j)
                g2, t2 = sets(two, i, j)
                salt = g.mix(np.arange(j - i, dtype=np.uint64) + np.uint64(1))
                n1, n2 = np.bincount(t1, minlength=j - i), np.bincount(t2, minlength=j - i)
                shared = np.bincount(t1[np.isin(g1 ^ salt[t1], g2 ^ salt[t2])], minlength=j - i)
                link = (shared > 0) & (100 * shared >= percent * (n1 + n2 - shared))
                yield pa.RecordBatch.from_arrays(
                    [a.slice(i, j - i).filter(pa.array(link)), b.slice(i, j - i).filter(pa.array(link))], names=["a", "b"])

    return run


def _alike(percent: int):
    """The sizes allow the link."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _tries(postings: DataFrame, percent: int, round_: int) -> DataFrame:
    """Each row outside the largest component of a column with some rows of that.

    A few pairs for each row: those with most columns in common.
    """
    # without regard to size a row would mostly meet rows that are far longer or shorter
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).alias("band")
    told = ("node", "n", "rank", "before")
    p = postings.select("gram", band, *told, "component", (F.col("rank") - F.col("before")).alias("own"))
    # first the row with the fewest columns of its own: what others were copied from, or nearest to it
    seeds = [F.min(F.struct("own", F.xxhash64("node", F.lit(round_)).alias("h"), *told)).alias("s0")]
    seeds += [F.min(F.struct(F.lit(0).alias("own"), F.xxhash64("node", F.lit(round_ * SEEDS + s)).alias("h"), *told)).alias(f"s{s}")
              for s in range(1, SEEDS if round_ else 1)]
    part = p.groupBy("gram", "band", "component").agg(F.count("*").alias("c"), *seeds)
    main = part.groupBy("gram", "band").agg(
        F.max(F.struct("c", (-F.col("s0.own")).alias("near"), F.col("component").alias("main"),
                       *[f"s{s}" for s in range(len(seeds))])).alias("m"),
        F.sum("c").alias("all")).filter("all > 1")
    tried = p.join(main, ["gram", "band"]).filter("component <> m.main").select(
        *told, F.explode(F.array(*[f"m.s{s}" for s in range(len(seeds))])).alias("s"))
    pairs = tried.select(F.col("node").alias("a"), F.col("s.node").alias("b"), *[
        x for c in told[1:] for x in (F.col(c).alias(f"{c}_a"), F.col(f"s.{c}").alias(f"{c}_b"))])
    pairs = pairs.filter("a <> b").filter(_alike(percent)).filter(_reach(percent))
    # a row is tried with those it shares most columns with, in as far as these were chosen
    pairs = pairs.groupBy("a", "b").agg(
        F.count("*").alias("c"), F.least(F.min(_depth_of("n_a")), F.min(_depth_of("n_b"))).alias("depth"))
    few = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    pairs = pairs.filter((F.col("c") >= 2) | (F.col("depth") < 2))
    return pairs.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= TRIED).select("a", "b")


def _rest(postings: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components above the bounds, by accumulated overlap.

    The bounds hold within the join, so a column of many rows gives the pairs
    that may link and not all of its pairs.
    """
    part = postings.groupBy("gram", "component").agg(F.count("*").alias("c"))
    main = part.groupBy("gram").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("k"))
    main = main.filter("k > 1").select("gram", F.col("m.component").alias("main"))
    p = postings.join(main, "gram")
    out = p.filter("component <> main").select("gram", *_side("a"))
    rest = p.select("gram", "main", *_side("b"))
    pairs = out.join(rest, "gram").filter("component_a <> component_b").filter(
        (F.col("component_b") == F.col("main")) | (F.col("a") < F.col("b")))
    pairs = pairs.filter(_alike(percent)).filter(_reach(percent)).filter(_maps_allow(percent))
    counted = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count("*").alias("shared"), F.min(F.least(_depth_of("n_a"), _depth_of("n_b"))).alias("depth"))
    return counted.filter(F.col("shared") >= F.col("depth")).select("a", "b")


def _bounded(percent: int):
    """Pairs whose bit maps leave the link possible."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b, n_a, n_b in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b"))):
                keep.append(100 * (m := _most_shared(a, b, n_a, n_b)) >= percent * (n_a + n_b - m))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that link; ``sets``: node, n, bits and the row (k) that stands for it."""
    def side(name):
        return sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(g.tidy(_bounded(percent)), "a long, b long")
    near = materialize(near, "pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "k"), "node")
    wanted = materialize(wanted, "wanted")
    # the same row may be there several times
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= SENT_ROWS else wanted, "k").select("node", "text")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = near.join(one, "a").join(two, "b")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(g.tidy(_verify(size, percent)), "a long, b long")
    return materialize(found, "found")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after some more links, from those before."""
    if labels is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        old = labels.select(F.col("node").alias(end), F.col("component").alias("c"))
        ends = ends.join(old, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    moved = components(ends).select(F.col("node").alias("component"), F.col("component").alias("to"))
    now = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = moved.join(labels, moved.component == labels.component, "left_anti").select(
        F.col("component").alias("node"), F.col("to").alias("component"))
    return now.union(fresh)


def ngram_jaccard(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose word n-gram sets link at ``percent`` Jaccard.

    Needs columns doc_id and text; others are ignored. Gives for each row k (a
    hash of id and text), doc_id, n_shingles (size of its set), class_id (rows
    of one set share it), component (a number of its component) and
    component_id (the smallest doc_id reachable by links).

    A null or empty text, or one without words, has no n-grams and no links:
    its component is its own doc_id. Repeated rows share set and component. Rows
    with a null doc_id link like others; a component of such rows alone has a
    null component_id. No rows give no rows.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    sketch = materialize(docs.select("k", "doc_id", "text").mapInArrow(g.tidy(_sketch(size)), _SKETCH), "sketch")
    frequent = spark.sparkContext.broadcast(_frequent(sketch))
    shared = recurring(docs.select("text"), _cut_keys(size, percent, frequent), parts_for(documents), distinct=True,
                       gathered=1 << 19, then=_postings, schema="gram long, node long, n long, rank long")
    postings = materialize(_able(shared.distinct(), percent), "postings")
    rows = sketch.filter("gram IS NULL").select("k", "doc_id", "node", "n")
    # one row for each set that shares a column with another
    chosen = rows.filter("n > 0").join(postings.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("k").alias("k"))
    sets = sketch.filter("gram IS NULL").select("k", "n", "bits", *_SMALL).join(chosen, "k").groupBy("node", "k", "n", *_SMALL).agg(
        F.first("bits").alias("bits"))
    sets = materialize(sets, "sets")
    labels = None
    for round_ in range(TRIES + 1):
        if labels is None:
            now = postings.withColumn("component", F.col("node"))
        else:
            now = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        pairs = _tries(now, percent, round_) if round_ < TRIES else _rest(now.join(sets.select("node", *_SMALL), "node"), percent)
        found = _verified(pairs, sets, docs, size, percent)
        if not found.isEmpty():
            labels = materialize(_joined(labels, found), "labels")
    if labels is None:
        labels = postings.limit(0).select("node", F.col("node").alias("component"))
    # sets find their components, then rows their sets; rows of a set of their own have no need to
    held = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    held = held.join(labels, "node", "left").filter((F.col("c") > 1) | F.col("component").isNotNull())
    held = held.select("node", "least", F.coalesce("component", "node").alias("component"))
    least = held.groupBy("component").agg(F.min("least").alias("component_id"))
    known = salted_join(held.select("node", "component"), least, "component", "node", SALTS)
    out = salted_join(rows, known, "node", "k", SALTS)
    return out.select(
        "k", "doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("class_id"),
        F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.xxhash64("k", F.lit("alone"))).alias("component"),
        F.when((F.col("n") > 0) & F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each component: that with the smallest doc_id.

    A null doc_id comes last; of equal ones the smaller hash of the text stays,
    and of rows equal in both one. Texts without words, null or empty, are each
    a component of their own. Other columns pass, whatever their names; no rows
    give no rows.
    """
    rows = ngram_jaccard(documents, size, percent).groupBy("component", "doc_id", "k").agg(F.count("*").alias("times"))
    kept = rows.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "times")).alias("m"))
    key, times = unused(documents, "key"), unused(documents, "times")
    kept = materialize(kept.select(F.col("m.k").alias(key), F.col("m.times").alias(times)).distinct(), "kept")
    keyed = documents.withColumn(key, F.xxhash64("doc_id", "text"))
    # rows that are there once need no choice
    once = keyed.join(kept.filter(F.col(times) == 1).select(key), key, "left_semi")
    again = keyed.join(kept.filter(F.col(times) > 1).select(key), key, "left_semi").dropDuplicates([key])
    return once.select(*documents.columns).union(again.select(*documents.columns))
