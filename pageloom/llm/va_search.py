"""Exact top-k inner-product search with a vector-approximation file (operator 8).

Components become integers, floor(256 * x). The approximation file keeps one
byte a component: its cell between the smallest and the largest component of
vectors of that length.

1. Scan: the cells give an upper and a lower bound of each score. A task keeps,
   for each query, what may still be among its k best; the kth best lower bound
   over all tasks cuts what is left.
2. Read: exact vectors are read in the order of their upper bounds, first a few
   times k for each query. The kth exact score then tells which others are
   still to be read; after those the result is certain.

Queries are taken in blocks of about ``BLOCK``, which bounds what is sent to
the tasks. Of equal vectors only the k + 1 smallest ids can be in a result
(ties go to the smaller id, one of them may be the query), so only those stay.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

BLOCK = 1024
#: vectors bounded against a block of queries at once
SCANNED = 1024
CELLS = 256
#: exact vectors read at first, in multiples of k
AHEAD = 4
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and v (whole numbers as doubles) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True))
    # floor() of a double gives a long, which large values do not fit
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**44, F.floor(c * 256).cast("double")).otherwise(c * 256))
    return vectors.filter(fine & F.col("vec_id").isNotNull()).select("vec_id", whole.alias("v"))


def distinct_few(rows: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of each vector; the partial top k runs before the shuffle."""
    order = Window.partitionBy("v").orderBy("vec_id")
    return rows.distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).drop("_r")


def _cells(scale: dict[int, tuple[float, float]]):
    """The approximation file: a byte for each component."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                low, step = scale[len(v)]
                code = np.clip((np.array(v, float) - low) / step, 0, CELLS - 1) if step else np.zeros(len(v))
                out.append(code.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "cells"])

    return run


def _scan(queries, scale, k: int):
    """What may be among the k best of each query, with bounds."""

    def bounds(q, codes, low, step):
        middle = low + (codes.astype(float) + 0.5) * step
        half = 0.5 * step * (1 + 1e-9)
        score = q @ middle.T
        # a cell's edge may round to its neighbour; a millionth part more is room enough
        room = np.abs(q).sum(axis=1, keepdims=True) * (half + 1e-6 * step) + 1e-9 * np.abs(score)
        return score + room, score - room

    def run(batches):
        ids, by_length = queries.value
        state = {length: [np.full((len(rows), 0), -np.inf), []] for length, (rows, _) in by_length.items()}

        def tighten(length):
            best, found = state[length]
            if found:
                row, vec, up, down = (np.concatenate(c) for c in zip(*found))
                keep = up >= best[row, 0] if best.shape[1] == k else np.ones(len(row), bool)
                found[:] = [(row[keep], vec[keep], up[keep], down[keep])]

        for batch in batches:
            sizes = np.array([len(b) for b in batch.column("cells").to_pylist()])
            vec_all = batch.column("vec_id").to_numpy()
            for length in np.unique(sizes):
                if length not in by_length:
                    continue
                rows, q = by_length[length]
                mine = np.flatnonzero(sizes == length)
                codes_all = np.frombuffer(b"".join(batch.column("cells").take(pa.array(mine)).to_pylist()), np.uint8)
                codes_all = codes_all.reshape(len(mine), -1)
                for i in range(0, len(mine), SCANNED):
                    vec = vec_all[mine[i : i + SCANNED]]
                    up, down = bounds(q, codes_all[i : i + SCANNED], *scale[length])
                    own = ids[rows][:, None] == vec[None, :]
                    up[own] = down[own] = -np.inf
                    best, found = state[length]
                    best = np.concatenate([best, down], axis=1)
                    if best.shape[1] > k:
                        best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
                        least = best.min(axis=1, keepdims=True)
                        best = np.sort(best, axis=1)
                    else:
                        least = np.full((len(best), 1), -np.inf)
                    state[length][0] = best
                    r, c = np.nonzero((up >= least) & ~own)
                    found.append((r, vec[c], up[r, c], down[r, c]))
                    if sum(len(x[0]) for x in found) > 1 << 20:
                        tighten(length)
        for length, (rows, _) in by_length.items():
            tighten(length)
            for r, vec, up, down in state[length][1]:
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows][r]), pa.array(vec), pa.array(up), pa.array(down)],
                                                 names=["query_id", "vec_id", "up", "down"])

    return run


def _score(queries):
    def run(batches):
        ids, by_length = queries.value
        where = {int(ids[r]): (length, i) for length, (rows, _) in by_length.items() for i, r in enumerate(rows)}
        for batch in batches:
            out = []
            for query, v in zip(batch.column("query_id").to_pylist(), batch.column("v").to_pylist()):
                length, i = where[query]
                q, v = by_length[length][1][i], np.array(v, float)
                if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(len(v), 1) < EXACT:
                    out.append(int(q @ v))
                else:
                    exact = sum(int(a) * int(b) for a, b in zip(q.tolist(), v.tolist()))
                    out.append(max(-LARGEST - 1, min(LARGEST, exact)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("vec_id"), pa.array(out, pa.int64())],
                names=["query_id", "vec_id", "score"])

    return run


def _exact(wanted: DataFrame, rows: DataFrame, queries) -> DataFrame:
    read = wanted.select("query_id", "vec_id").join(rows, "vec_id").select("query_id", "vec_id", "v")
    return read.mapInArrow(_score(queries), "query_id long, vec_id long, score long")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(spark, rows: DataFrame, cells: DataFrame, asked: list, scale, k: int) -> DataFrame:
    ids = np.array([r.vec_id for r in asked], np.int64)
    by_length = {}
    for length in {len(r.v) for r in asked}:
        mine = [i for i, r in enumerate(asked) if len(r.v) == length]
        by_length[length] = (np.array(mine), np.array([asked[i].v for i in mine], float).reshape(len(mine), length))
    queries = spark.sparkContext.broadcast((ids, by_length))
    found = materialize(cells.mapInArrow(_scan(queries, scale, k), "query_id long, vec_id long, up double, down double"), "bounds")
    low = Window.partitionBy("query_id").orderBy(F.desc("down"), "vec_id")
    kth = found.withColumn("r", F.row_number().over(low)).filter(F.col("r") <= k).groupBy("query_id").agg(
        F.count("*").alias("c"), F.min("down").alias("kth"))
    left = found.join(kth, "query_id").filter((F.col("c") < k) | (F.col("up") >= F.col("kth")))
    first = Window.partitionBy("query_id").orderBy(F.desc("up"), "vec_id")
    left = materialize(left.withColumn("r", F.row_number().over(first)).select("query_id", "vec_id", "up", "r"), "candidates")
    early = materialize(_exact(left.filter(F.col("r") <= AHEAD * k), rows, queries), "scores")
    sure = _ranked(early, k).groupBy("query_id").agg(F.min("score").alias("sure"))
    late = left.filter(F.col("r") > AHEAD * k).join(sure, "query_id").filter(F.col("up") >= F.col("sure"))
    return _ranked(early.union(_exact(late, rows, queries)), k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of each query.

    Both tables have columns vec_id and embedding; others are ignored. A query
    is compared with vectors of its own length under other ids.

    Vectors that are null or hold null or non-finite components, and rows
    without vec_id, take no part. Repeated rows count once; of queries that
    share an id but not a vector the smallest vector is asked. Ties go to the
    smaller vec_id. Scores beyond 64 bits are set to the nearest long. No rows
    give no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(distinct_few(integers(vectors), k), "vectors")
    asked = materialize(integers(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    # few lengths of vectors: one cell width each
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"))
    scale = {r.n: (r.low or 0.0, ((r.high or 0.0) - (r.low or 0.0)) / CELLS) for r in sizes.collect()}
    cells = materialize(rows.mapInArrow(_cells(scale), "vec_id long, cells binary"), "cells")
    blocks = max(1, -(-asked.count() // BLOCK))
    numbered = asked.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    results = []
    for b in range(blocks):
        # a block holds about BLOCK queries whatever their number
        block = numbered.filter(F.col("_b") == b).select("vec_id", "v").collect()
        if block:
            results.append(materialize(_block(spark, rows, cells, block, scale, k), "results"))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.union, results).select("query_id", "rank", "vec_id", "score")
