"""Dense and sparse vectors of texts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..session import materialize

DIMENSIONS = 64
BROADCAST_TERMS = 100_000  # term rows of some 100 bytes each in the memory of the driver and of a task
LONGEST_SENT = 128  # bytes of a term of all texts that is sent to all tasks
SENT_BYTES = 16 << 20  # of rows of query terms that are sent to all tasks
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Signed feature hashing of the terms, scaled to length one.

    It needs no model file, so results can be repeated anywhere.
    """
    slots: dict[str, tuple[int, float]] = {}
    word = re.compile(r"[^\W_]+")

    def slot(term: str) -> tuple[int, float]:
        if term not in slots:
            digest = hashlib.md5(term.encode()).hexdigest()
            slots[term] = (int(digest[:8], 16) % dimensions, 1.0 if int(digest[8:10], 16) % 2 == 0 else -1.0)
        return slots[term]

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        if len(slots) > 500_000:
            slots.clear()
        for row, text in zip(out, texts):
            for term, n in Counter(word.findall((text or "").lower())).items():
                at, sign = slot(term)
                row[at] += sign * n
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0).astype(np.float32)

    return embed


def embed(df: DataFrame, text: str = "text", out: str = "embedding",
          make: Callable[[], Embedder] = hashing_embedder, batch: int = 256, attempts: int = 3) -> DataFrame:
    """Add dense vectors. ``make`` runs once per task and may load a model.

    Only the text column is sent to Python; a failing batch is tried again.
    """

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for texts in batches:
            parts = [pa.array([], pa.list_(pa.float32()))]
            for at in range(0, len(texts), batch):
                part = texts.slice(at, batch).to_pylist()  # of an Arrow batch only these become Python's
                for attempt in range(attempts):
                    try:
                        rows = [None if r is None else np.asarray(r, dtype="float32") for r in model(part)]
                        break
                    except Exception:
                        if attempt == attempts - 1:
                            raise
                parts.append(pa.array(rows, pa.list_(pa.float32())))
            yield pa.concat_arrays(parts)

    return df.withColumn(out, vectors(F.col(text)))


def spread_table(small: DataFrame, salts: int) -> DataFrame:
    """Copy each row once per salt, for a join against a salted hot side."""
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_of(key: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def term_counts(df: DataFrame, key: str, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, term, tf). The texts are shuffled once, by key.

    Everything that follows per key (counting, scaling, scoring) finds its
    rows in place; the far larger token rows are never shuffled.
    """
    return (
        _by_key(df.select(key, *keep, text), key)
        .select(key, *keep, F.explode(tx.terms(F.col(text))).alias("term"))
        .groupBy(key, *keep, "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def join_terms(rows: DataFrame, small: DataFrame, key: str, limit: int = BROADCAST_TERMS, salts: int = 16) -> DataFrame:
    """Join on ``term`` where a frequent term may be in most ``rows``.

    A ``small`` side of checked size goes to every task, which leaves ``rows``
    where they are. A larger one is copied per salt, so that the rows of one
    term are spread over many tasks.
    """
    if _fits(small, limit):
        return rows.join(F.broadcast(small), "term")
    return (
        rows.withColumn("_salt", salt_of(key, salts))
        .join(spread_table(small, salts).hint("merge"), ["term", "_salt"]).drop("_salt")
    )


def _fits(small: DataFrame, limit: int) -> bool:
    """Whether a table of terms may go to all tasks, by its rows and by its bytes, as a term may be as long as a text."""
    each = F.octet_length(F.to_json(F.struct(*small.columns))).cast("long")
    rows, size = small.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(each)).first()
    return rows <= limit and (size or 0) <= SENT_BYTES


def _is_short() -> Column:
    return F.octet_length("term") <= LONGEST_SENT


def _frequent_from(idf: DataFrame, limit: int) -> int:
    """The power of two from which on at most ``limit`` short terms are in that many texts; 0 if that is all terms."""
    digits = F.when(_is_short(), F.length(F.bin("n"))).alias("digits")
    counts = dict(idf.groupBy(digits).agg(F.count(F.lit(1))).collect())  # a row for each number of digits, 64 at most
    if None not in counts and sum(counts.values()) <= limit:
        return 0
    counts.pop(None, None)  # long terms
    least, terms = max(counts, default=0) + 1, 0
    while least > 1 and terms + counts.get(least - 1, 0) <= limit:
        least -= 1
        terms += counts.get(least, 0)
    return 1 << (least - 1)


def join_idf(counts: DataFrame, idf: DataFrame, key: str, limit: int = BROADCAST_TERMS) -> DataFrame:
    """Add idf to (key, …, term, tf), which lie by ``key``.

    The most frequent terms, which are most rows, go to every task up to a
    checked number, so their rows stay where they are. Only rows of rarer
    terms are shuffled, to their term and back to their key; no such term is
    in many texts, so it is no hot key, and neither side is ever copied. Terms
    of more than ``LONGEST_SENT`` bytes are shuffled too, so the number bounds
    the bytes that the driver sends; a frequent one is left to adaptive skew
    handling.
    """
    least = _frequent_from(idf, limit)
    if not least:
        return counts.join(F.broadcast(idf.drop("n")), "term")
    sent = (F.col("n") >= least) & _is_short()
    frequent = F.broadcast(idf.filter(sent).drop("n"))
    rare = idf.filter(~sent).drop("n").hint("merge")
    far = counts.join(frequent.select("term"), "term", "left_anti").join(rare, "term")
    return counts.join(frequent, "term").unionByName(_by_key(far, key))


def _by_key(df: DataFrame, key: str) -> DataFrame:
    """By ``key`` into a fixed number of partitions, so that tables dealt alike can be put together in place."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def weigh(counts: DataFrame, idf: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, *keep, term, weight): tf × idf, scaled to length one per key."""
    raw = join_idf(counts, idf, key).withColumn("_w", F.col("tf") * F.col("idf"))
    # one key is one text, so this window stays as small as that text
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(key)))
    return raw.select(key, *keep, "term", (F.col("_w") / length).alias("weight"))


def sparse_postings(
    df: DataFrame, key: str, text: str = "text", keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(postings, idf) of a text table; queries are weighed with the same idf.

    The idf table, ln(1 + N / n) for a term in n of N texts, is written once:
    postings and queries both read it, and its size decides how it is joined.
    """
    distinct = df.select(F.explode(F.array_distinct(tx.terms(F.col(text)))).alias("term"))
    total = df.count()
    found = distinct.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    idf = materialize(found.withColumn("idf", F.log(1 + total / F.col("n"))), "idf")
    return weigh(term_counts(df, key, text, keep), idf, key, keep), idf


def query_postings(queries: DataFrame, idf: DataFrame, key: str, text: str = "text", limit: int = BROADCAST_TERMS) -> DataFrame:
    """(key, term, weight) of query texts, weighed with the idf of the texts that are searched.

    A batch of queries names few of all terms. Up to a checked number of rows
    its terms go to the idf table and only theirs are taken from it, so neither
    the frequent terms of all texts are sent to the tasks again nor the others
    shuffled.
    """
    counts = materialize(term_counts(queries, key, text), "query-terms")
    if _fits(counts, limit):
        idf = materialize(idf.join(F.broadcast(counts.select("term").distinct()), "term", "left_semi"), "query-idf")
    return materialize(weigh(counts, idf, key), "query-postings")


def term_id(term: Column) -> Column:
    """A stable integer for a term, as sparse vectors are keyed by integers."""
    return F.conv(F.substring(F.md5(term), 1, 7), 16, 10).cast("int")


def sparse_maps(postings: DataFrame, key: str) -> DataFrame:
    """One map of term id to weight per text; weights of one id are added."""
    by_id = postings.groupBy(key, term_id(F.col("term")).alias("_id")).agg(F.sum("weight").alias("_w"))
    return by_id.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_id", "_w"))).alias("sparse"))
