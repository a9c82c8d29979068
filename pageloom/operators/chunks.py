"""Texts to chunks, chunks to nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u

CHUNK_SIZE, CHUNK_OVERLAP = 1024, 256


def token_windows(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """``array<string>``: windows of ``size`` white-space tokens, ``overlap`` shared."""
    step = size - overlap

    def windows(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - overlap) / step) - 1).cast("int")
        return F.when(
            F.size(w) > 0,
            F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " ")),
        ).otherwise(F.array().cast("array<string>"))

    return tx.let(tx.words(text), windows)


def _tokens(sentence: Column) -> Column:
    """Token count of a text without white space at its ends."""
    return F.size(F.split(sentence, f"{tx.SPACE}+"))


def sentences(text: Column, size: int = CHUNK_SIZE) -> Column:
    """Sentences and lines; one longer than ``size`` tokens is cut into windows."""
    parts = F.filter(
        F.transform(F.split(text, r"(?<=[.!?。！？])\s+|\n+"), tx.strip), lambda s: s != ""
    )
    return F.flatten(
        F.transform(
            parts,
            lambda s: F.when(_tokens(s) > size, token_windows(s, size, 0)).otherwise(F.array(s)),
        )
    )


def pack(sizes, size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy runs of whole sentences: (first, last) of each chunk.

    A chunk starts with the last sentences of the one before, as many as fit
    into ``overlap`` and leave room for the next sentence.
    """
    runs: list[tuple[int, int]] = []
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > size and i > start:
            runs.append((start, i - 1))
            start, total = i, 0
            while start > runs[-1][0] and total + sizes[start - 1] <= overlap and total + sizes[start - 1] + n <= size:
                start -= 1
                total += sizes[start]
        total += n
    if len(sizes):
        runs.append((start, len(sizes) - 1))
    return runs


def sentence_chunks(
    df: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk (chunk_no, text) with all other columns copied.

    Only sentence lengths go to Python; the texts stay in the JVM.
    """

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def runs(sizes: pd.Series) -> pd.Series:
        return sizes.map(
            lambda s: [{"first": a, "last": b} for a, b in pack([int(x) for x in s], size, overlap)]
        )

    # Spark would move a deterministic UDF into the explode, where none can run
    runs = runs.asNondeterministic()

    rest = [c for c in df.columns if c != text]
    return (
        df.withColumn("_s", sentences(F.col(text), size))
        .withColumn("_runs", runs(F.transform("_s", _tokens)))
        .select(*rest, "_s", F.posexplode("_runs").alias("chunk_no", "_run"))
        .select(
            *rest, "chunk_no",
            F.array_join(F.slice("_s", F.col("_run.first") + 1, F.col("_run.last") - F.col("_run.first") + 1), " ").alias(text),
        )
    )


def window_chunks(
    df: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(token_windows(F.col(text), size, overlap)).alias("chunk_no", text))


def document_nodes(docs: DataFrame, chunked=window_chunks) -> DataFrame:
    """(site_id, content_hash, text, …) rows to nodes, one per chunk.

    ``doc_id`` is ``site:hash`` of the document, ``node_id`` adds the chunk.
    """
    keyed = docs.withColumn("doc_id", u.doc_key(F.col("site_id"), F.col("content_hash")))
    return chunked(keyed).withColumn("node_id", F.concat_ws("#", "doc_id", "chunk_no"))
