"""Batches of searches over a node table: dense, sparse, hybrid, reranked.

Queries are a table, so one plan answers all of them. Node vectors are scored
in blocks inside tasks and only the best rows per query leave a block: no pair
table of queries and nodes is ever written or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import labels
from ..functions import text as tx
from ..functions import urls as u
from ..functions import vectors
from ..session import materialize
from . import docstore, embedding, ordered

METRICS = ("IP", "L2", "COSINE")
QUERY_BLOCK = 4096
BROADCAST_HITS = 100_000
SENT_BYTES = 16 << 20  # of hits that are sent to all tasks with all they hold
DECIMALS = 9  # scores are rounded, so that equal vectors tie in any block


# ---- predicates ------------------------------------------------------------

def predicate(filters: Sequence[tuple] = (), join: str = "and") -> Column:
    """Column from (field, operator, value) rows, joined by and / or."""
    ops: dict[str, Callable[[Column, object], Column]] = {
        "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
        ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
        "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
        "in": lambda c, v: c.isin(*v), "nin": lambda c, v: ~c.isin(*v),
        "contains": lambda c, v: F.array_contains(c, v),
        "text_match": lambda c, v: tx.contains_ci(c, v),
    }
    parts = [ops[op](F.col(field), value) for field, op, value in filters]
    if not parts:
        return F.lit(True)
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if join == "and" else (out | p)
    return out


def filter_nodes(
    nodes: DataFrame, standard: Sequence[tuple] = (), scalar: Sequence[tuple] = (), join: str = "and",
    doc_ids: DataFrame | None = None, node_ids: DataFrame | None = None,
) -> DataFrame:
    """Standard AND scalar filters AND id lists; the lists are semi joins."""
    nodes = nodes.filter(predicate(standard, join) & predicate(scalar))
    if doc_ids is not None:
        nodes = nodes.join(doc_ids.select("doc_id"), "doc_id", "left_semi")
    if node_ids is not None:
        nodes = nodes.join(node_ids.select("node_id"), "node_id", "left_semi")
    return nodes


def output_fields(hits: DataFrame, fields: Sequence[str] | None = None, text_key: str = "text") -> DataFrame:
    if not fields or list(fields) == ["*"]:
        return hits
    return hits.select(*dict.fromkeys([*fields, text_key]))


# ---- dense -----------------------------------------------------------------

def _scores(block: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "L2":
        squares = (block**2).sum(1)[:, None] + (queries**2).sum(1)[None, :] - 2 * block @ queries.T
        return -np.sqrt(np.maximum(squares, 0))
    out = block @ queries.T
    if metric == "COSINE":
        out /= np.maximum(np.linalg.norm(block, axis=1), 1e-300)[:, None]
        out /= np.maximum(np.linalg.norm(queries, axis=1), 1e-300)[None, :]
    return out


def _best(scores: np.ndarray, groups: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the k best rows per query and group.

    Rows come in id order, so equal scores are cut at the larger ids, as the
    final order does; copies of one vector cannot flood the output.
    """
    rows, cols = [], []
    for g in np.unique(groups):
        at = np.flatnonzero(groups == g)
        part = scores[at]
        if len(at) > k:
            cut = np.partition(part, len(at) - k, axis=0)[len(at) - k][None, :]
            above, tied = part > cut, part == cut
            r, c = np.nonzero(above | (tied & (np.cumsum(tied, axis=0) <= k - above.sum(0))))
        else:
            r, c = np.nonzero(np.ones_like(part, dtype=bool))
        rows.append(at[r])
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _matrix(values) -> np.ndarray:
    return np.asarray([np.asarray(v, dtype=np.float64) for v in values], dtype=np.float64)


def _check_metric(metric: str) -> str:
    if metric.upper() not in METRICS:
        raise ValueError(f"metric {metric} is none of {METRICS}")
    return metric.upper()


def dense_search(
    nodes: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", by: Sequence[str] = (),
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, *by, node_id, score, rank): exact top k per query (and group).

    Larger is better for every metric; L2 gives the negative distance. Up to
    ``block`` queries travel to the tasks; more take ``dense_search_grid``.
    """
    metric = _check_metric(metric)
    rows = ordered.bounded_rows(queries.select("query_id", "embedding"), block)
    if rows is None:
        return dense_search_grid(nodes, queries, k, metric, by)
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(
        ([r.query_id for r in rows], _matrix([r.embedding for r in rows]))
    )
    schema = T.StructType(
        [queries.schema["query_id"], *[nodes.schema[c] for c in by], nodes.schema["node_id"],
         T.StructField("score", T.DoubleType())]
    )
    names = list(by)
    id_type = to_arrow_type(queries.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        arrow_ids = pa.array(ids, id_type)
        best: pa.Table | None = None  # the best rows of the partition so far
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            batch = batch.take(pc.sort_indices(batch.column("node_id")))
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            data = flat.astype(np.float64).reshape(batch.num_rows, -1)
            scores = np.round(_scores(data, matrix, metric), DECIMALS)
            r, c = _best(scores, _groups(batch, names), k)
            rows = pa.array(r)
            found = pa.table([pa.array(c), *[batch.column(n).take(rows) for n in names], batch.column("node_id").take(rows),
                              pa.array(scores[r, c])], names=["_query", *names, "node_id", "score"])
            best = found if best is None else _merged(pa.concat_tables([best, found]), ["_query", *names], k)
        if best is not None:
            columns = [arrow_ids.take(best.column("_query").combine_chunks()), *[best.column(n) for n in [*names, "node_id", "score"]]]
            yield from pa.table(columns, names=["query_id", *names, "node_id", "score"]).to_batches()

    local = nodes.select("node_id", "embedding", *by).mapInArrow(run, schema)
    return _top(local, k, by)


def _groups(rows: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    """A number for each row's values of ``names``."""
    if not names:
        return np.zeros(rows.num_rows, dtype=int)
    keys = pa.table([rows.column(c) for c in names], names=list(names)).to_pandas()
    return keys.groupby(list(names), sort=False, dropna=False).ngroup().to_numpy()


def _merged(rows: pa.Table, names: Sequence[str], k: int) -> pa.Table:
    """The best k rows of each group, ties to the smaller node."""
    node = pc.rank(rows.column("node_id"), sort_keys="ascending", tiebreaker="dense").to_numpy()
    group, score = _groups(rows, names), rows.column("score").to_numpy()
    order = np.lexsort((node, -score, group))
    group = group[order]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return rows.take(pa.array(np.sort(order[place < k]))).combine_chunks()


def _top(scored: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return ordered.top_per_key(
        scored, ["query_id", *by], [F.col("score").desc(), F.col("node_id").asc()], k
    )


def dense_search_grid(
    nodes: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", by: Sequence[str] = (),
    node_block: int = 20_000, query_block: int = 2_000,
) -> DataFrame:
    """As ``dense_search`` for any number of queries.

    Both sides are cut into blocks by a hash of their id, so no block can be
    hot; each cell of the grid is one block of nodes against one of queries,
    and only its best rows leave it.
    """
    metric = _check_metric(metric)
    names = list(by)
    n_blocks = max(1, -(-nodes.count() // node_block))
    q_blocks = max(1, -(-queries.count() // query_block))
    left = nodes.select(
        "node_id", "embedding", *names, embedding.salt_of("node_id", n_blocks).alias("_n"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("_q"),
    )
    right = queries.select(
        "query_id", F.col("embedding").alias("q_embedding"), embedding.salt_of("query_id", q_blocks).alias("_q"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_n"),
    )
    schema = T.StructType(
        [queries.schema["query_id"], *[nodes.schema[c] for c in names], nodes.schema["node_id"],
         T.StructField("score", T.DoubleType())]
    )
    columns = ["query_id", *names, "node_id", "score"]

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        a = a.sort_values("node_id", ignore_index=True)
        scores = np.round(_scores(_matrix(a["embedding"]), _matrix(b["q_embedding"]), metric), DECIMALS)
        groups = (
            a.groupby(names, sort=False, dropna=False).ngroup().to_numpy() if names else np.zeros(len(a), dtype=int)
        )
        r, c = _best(scores, groups, k)
        out = {"query_id": b["query_id"].to_numpy()[c], "node_id": a["node_id"].to_numpy()[r], "score": scores[r, c]}
        for n in names:
            out[n] = a[n].to_numpy()[r]
        return pd.DataFrame(out)[columns]

    cells = left.groupBy("_n", "_q").cogroup(right.groupBy("_n", "_q")).applyInPandas(cell, schema)
    return _top(cells, k, by)


# ---- approximate dense search ----------------------------------------------

def train_cells(nodes: DataFrame, n_cells: int, seed: int = 7) -> np.ndarray:
    """Centres of ``n_cells`` cells of unit vectors, by distributed k-means; none without vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # a vector of zeros has no direction; it belongs to any cell
    points = nodes.filter(F.exists("embedding", lambda x: x != 0)).select(array_to_vector("embedding").alias("features"))
    if points.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(points)
    return np.asarray(model.clusterCenters(), dtype=np.float64)


def _nearest(centres: np.ndarray, spark, count: int):
    """A column function: the numbers of the ``count`` cells nearest to a vector."""
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(embedding: pd.Series) -> pd.Series:
        order = np.argsort(-_scores(_matrix(embedding), shared.value, "COSINE"), axis=1, kind="stable")[:, :count]
        return pd.Series(list(order.astype("int32")))

    return nearest


def assign_cells(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add the nearest cell; store the table partitioned by ``cell`` to prune scans."""
    if not len(centres):
        return nodes.withColumn("cell", F.lit(0))
    return nodes.withColumn("cell", F.element_at(_nearest(centres, nodes.sparkSession, 1)("embedding"), 1))


def probed_search(
    nodes: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int, metric: str = "COSINE",
    by: Sequence[str] = (), node_block: int = 20_000, query_block: int = 2_000,
) -> DataFrame:
    """Top k by cosine among the nodes of each query's ``probes`` nearest cells.

    Approximate: ``probes`` trades time for recall, and all cells give the
    exact result. Only probed cells are read. Queries and nodes meet in one
    job, by cell and by blocks within it, so neither many queries nor a large
    cell is a task of its own. Queries of one id (NULL is one) are one query:
    a node counts once for them, with its best score. Without cells the search
    is exact.
    """
    metric, names = _check_metric(metric), list(by)
    if not len(centres):
        return dense_search(nodes, queries, k, metric, by)
    asked = queries.select("query_id", F.col("embedding").alias("q_embedding"),
                           F.explode(_nearest(centres, nodes.sparkSession, probes)("embedding")).alias("cell"))
    met = _by_cells(nodes, asked, names, lambda scores, groups: _best(scores, groups, k), metric, node_block, query_block)
    once = met.groupBy("query_id", *names, "node_id").agg(F.max("score").alias("score"))
    return _top(once, k, by)


def _by_cells(
    nodes: DataFrame, asked: DataFrame, names: Sequence[str], pick: Callable, metric: str, node_block: int, query_block: int
) -> DataFrame:
    """(query_id, names, node_id, score) of what ``pick`` takes of the scores of a block of queries and one of nodes.

    ``asked`` holds query_id, q_embedding and the cells that a query goes to.
    """
    asked = materialize(asked, "asked")
    # one row for each cell on the driver
    many = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = nodes.filter(F.col("cell").isin(list(many)) if many else F.lit(False))
    held = {r.cell: r.n for r in wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    def blocks(counts: dict, size: int) -> Column:
        pairs = [F.lit(x) for c, n in counts.items() for x in (int(c), int(-(-n // size)))]
        return F.coalesce(F.create_map(*pairs)[F.col("cell")], F.lit(1)) if pairs else F.lit(1)

    n_blocks, q_blocks = blocks(held, node_block), blocks(many, query_block)
    # both sides need keys of one type: an int and a long of one value go to different tasks
    dealt = lambda count, *columns: F.pmod(F.xxhash64(*columns), count).cast("int")
    others = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = wanted.select("node_id", "embedding", *names, "cell", dealt(n_blocks, "node_id").alias("_n"), others(q_blocks).alias("_q"))
    right = asked.select("query_id", "q_embedding", "cell", dealt(q_blocks, "query_id", "q_embedding").alias("_q"),
                         others(n_blocks).alias("_n"))
    schema = T.StructType([asked.schema["query_id"], *[nodes.schema[c] for c in names], nodes.schema["node_id"],
                           T.StructField("score", T.DoubleType())])
    columns = ["query_id", *names, "node_id", "score"]

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            a = a.take(pc.sort_indices(a.column("node_id")))
            scores = _table_scores(a, b, metric)
            r, c = pick(scores, _groups(a, names))
        else:
            scores, r, c = np.zeros((1, 1)), np.zeros(0, int), np.zeros(0, int)
        rows = pa.array(r, pa.int64())
        return pa.table([b.column("query_id").take(pa.array(c, pa.int64())), *[a.column(n).take(rows) for n in names],
                         a.column("node_id").take(rows), pa.array(scores[r, c], pa.float64())], names=columns)

    return left.groupBy("cell", "_n", "_q").cogroup(right.groupBy("cell", "_n", "_q")).applyInArrow(cell, schema)


def _table_scores(nodes: pa.Table, queries: pa.Table, metric: str) -> np.ndarray:
    one, two = (_matrix(t.column(c).to_pylist()) for t, c in ((nodes, "embedding"), (queries, "q_embedding")))
    return np.round(_scores(one, two, metric), DECIMALS)


def range_search(
    nodes: DataFrame, queries: DataFrame, threshold: float, pivots: int = 16, node_block: int = 20_000, query_block: int = 2_000
) -> DataFrame:
    """(query_id, node_id, score): all nodes whose cosine with a query is ``threshold`` or more.

    Exact, without a k. Some nodes are pivots and every node belongs to the
    nearest one. A query skips the cells whose nodes are all too far by the
    triangle inequality of angles; the rest is compared in blocks, and only
    what reaches the threshold leaves them.
    """
    chosen = nodes.filter(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("node_id"), "node_id").limit(pivots)
    centres = [r.embedding for r in chosen.select("embedding").collect()]
    if not centres:
        centres = [[1.0]]
    matrix = _matrix(centres)
    shared = nodes.sparkSession.sparkContext.broadcast(matrix)

    def angles(embedding: pd.Series) -> np.ndarray:
        data = _matrix(embedding)
        if data.shape[1] != shared.value.shape[1]:
            return np.full((len(data), len(shared.value)), np.pi / 2)
        return np.arccos(np.clip(_scores(data, shared.value, "COSINE"), -1, 1))

    @F.pandas_udf("cell int, angle double")
    def placed(embedding: pd.Series) -> pd.DataFrame:
        a = angles(embedding)
        return pd.DataFrame({"cell": a.argmin(1).astype("int32"), "angle": a.min(1)})

    held = materialize(nodes.withColumn("_p", placed("embedding")).select("node_id", "embedding", "_p.cell", "_p.angle"), "cells")
    reach = np.full(len(matrix), -np.inf)
    for r in held.groupBy("cell").agg(F.max("angle").alias("a")).collect():  # a row for each pivot
        reach[r.cell] = r.a
    far = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6 if threshold > -1 else np.inf

    @F.pandas_udf("array<int>")
    def cells(embedding: pd.Series) -> pd.Series:
        near = angles(embedding) - reach[None, :] <= far
        return pd.Series([np.flatnonzero(row).astype("int32") for row in near])

    asked = queries.select("query_id", F.col("embedding").alias("q_embedding"), F.explode(cells("embedding")).alias("cell"))
    return _by_cells(held, asked, [], lambda scores, groups: np.nonzero(scores >= threshold), "COSINE", node_block, query_block)


def score_groups(
    nodes: DataFrame, queries: DataFrame, by: Sequence[str], metric: str = "COSINE", node_block: int = 20_000, query_block: int = 2_000
) -> DataFrame:
    """(query_id, *by, n, best, mean) over the scores of all nodes of a group; no pair leaves its block."""
    names, metric = list(by), _check_metric(metric)
    n_blocks = max(1, -(-nodes.count() // node_block))
    q_blocks = max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = nodes.select("embedding", *names, embedding.salt_of("node_id", n_blocks).alias("_n"), every(q_blocks).alias("_q"))
    right = queries.select("query_id", F.col("embedding").alias("q_embedding"), embedding.salt_of("query_id", q_blocks).alias("_q"),
                           every(n_blocks).alias("_n"))
    schema = T.StructType([queries.schema["query_id"], *[nodes.schema[c] for c in names], T.StructField("n", T.LongType()),
                           T.StructField("best", T.DoubleType()), T.StructField("total", T.DoubleType())])
    columns = ["query_id", *names, "n", "best", "total"]

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        query, first, n, best, total = [], [], [], [], []
        if a.num_rows and b.num_rows:
            scores, groups = _table_scores(a, b, metric), _groups(a, names)
            for group in np.unique(groups):
                at = np.flatnonzero(groups == group)
                query += range(b.num_rows)
                first += [int(at[0])] * b.num_rows
                n += [len(at)] * b.num_rows
                best += scores[at].max(0).tolist()
                total += scores[at].sum(0).tolist()
        rows = pa.array(first, pa.int64())
        return pa.table([b.column("query_id").take(pa.array(query, pa.int64())), *[a.column(c).take(rows) for c in names],
                         pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(total, pa.float64())], names=columns)

    met = left.groupBy("_n", "_q").cogroup(right.groupBy("_n", "_q")).applyInArrow(cell, schema)
    return met.groupBy("query_id", *names).agg(
        F.sum("n").alias("n"), F.max("best").alias("best"), (F.sum("total") / F.sum("n")).alias("mean"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top k that was found, per query."""
    hit = exact.select("query_id", "node_id").join(
        found.select("query_id", "node_id", F.lit(1).alias("_hit")), ["query_id", "node_id"], "left"
    )
    return hit.groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


# ---- sparse ----------------------------------------------------------------

def sparse_search(
    postings: DataFrame, query_postings: DataFrame, k: int, by: Sequence[str] = ()
) -> DataFrame:
    """(query_id, *by, node_id, score, rank): top k by inner product.

    With postings kept by node and a query batch of checked size, scores are
    summed where the postings are and only k rows per query and task move on.
    Postings carry the ``by`` columns of their node.
    """
    wanted = query_postings.select("query_id", "term", F.col("weight").alias("_qw"))
    hits = (
        embedding.join_terms(postings, wanted, "node_id")
        .groupBy("query_id", *by, "node_id")
        .agg(F.round(F.sum(F.col("weight") * F.col("_qw")), DECIMALS).alias("score"))
    )
    return _top(hits, k, by)


# ---- fusion, diversity, rerank ---------------------------------------------

def fuse(
    legs: Sequence[DataFrame], k: int, ranker: str = "rrf", rrf_k: int = 60,
    weights: Sequence[float] | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Fuse ranked legs: sum of 1 / (rrf_k + rank), or of weight × score."""
    weights = list(weights or [1.0] * len(legs))
    if ranker not in ("rrf", "weighted"):
        raise ValueError(f"unsupported ranker: {ranker}")

    def part(leg: DataFrame, weight: float) -> DataFrame:
        term = vectors.rrf_term(F.col("rank"), rrf_k) if ranker == "rrf" else F.col("score") * weight
        return leg.select("query_id", *by, "node_id", term.alias("_part"))

    union = part(legs[0], weights[0])
    for leg, w in zip(legs[1:], weights[1:]):
        union = union.unionByName(part(leg, w))
    fused = union.groupBy("query_id", *by, "node_id").agg(F.round(F.sum("_part"), 12).alias("score"))
    return _top(fused, k, by)


def beside(hits: DataFrame, big: DataFrame, key: str) -> DataFrame:
    """Join hits to a big table without shuffling it.

    Hits are written, which also keeps them from being searched for again, and
    sent to the tasks up to ``SENT_BYTES``; they may hold texts, so their
    number says little. Beyond it only their keys are sent, and both sides meet
    by key with what is left of the big table.
    """
    stored = materialize(hits, "hits")
    size = stored.agg(F.sum(F.octet_length(F.to_json(F.struct(*stored.columns))))).first()[0] or 0
    if size <= SENT_BYTES:
        return big.join(F.broadcast(stored), key)
    keys = stored.select(key).distinct()
    if keys.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS:
        big = big.join(F.broadcast(keys), key, "left_semi")
    return big.join(stored.hint("merge"), key)


def mmr_search(
    nodes: DataFrame, queries: DataFrame, k: int, threshold: float = 0.5,
    prefetch_factor: float | None = None, prefetch_k: int | None = None,
) -> DataFrame:
    """Relevance against diversity: greedy choice among prefetched nodes.

    score = threshold × similarity − (1 − threshold) × closest chosen node.
    A group is one query with its prefetched rows, so it is small.
    """
    if prefetch_factor is not None and prefetch_k is not None:
        raise ValueError("give prefetch_factor or prefetch_k, not both")
    k0 = int(prefetch_k) if prefetch_k is not None else int(k * (4.0 if prefetch_factor is None else prefetch_factor))
    fetched = beside(dense_search(nodes, queries, k0, "COSINE"), nodes.select("node_id", "embedding"), "node_id")
    schema = T.StructType(
        [queries.schema["query_id"], nodes.schema["node_id"], T.StructField("score", T.DoubleType()),
         T.StructField("rank", T.IntegerType())]
    )

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        unit = _matrix(rows["embedding"])
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        relevance = rows["score"].to_numpy()
        closest = np.full(len(rows), -np.inf)
        left, chosen, values = list(range(len(rows))), [], []
        while left and len(chosen) < k:
            penalty = closest[left] if chosen else np.zeros(len(left))
            value = threshold * relevance[left] - (1 - threshold) * penalty
            best = int(np.argmax(value))
            values.append(float(value[best]))
            chosen.append(left.pop(best))
            closest = np.maximum(closest, unit @ unit[chosen[-1]])
        return pd.DataFrame(
            {"query_id": rows["query_id"][chosen].to_numpy(), "node_id": rows["node_id"][chosen].to_numpy(),
             "score": values, "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)}
        )

    return fetched.groupBy("query_id").applyInPandas(choose, schema)


def overlap_score(query: Column, text: Column) -> Column:
    """Default reranker: share of the query's terms found in the text."""
    asked = F.array_distinct(tx.terms(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tx.terms(text))) / F.size(asked)).otherwise(0.0)


def rerank(
    hits: DataFrame, texts: DataFrame, queries: DataFrame, top_n: int,
    scorer: Callable[[Column, Column], Column] = overlap_score, by: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Score (query text, node text) pairs again and keep the best ``top_n``.

    ``keep`` names node columns that stay in the result.
    """
    asked = hits.select("query_id", *by, "node_id").join(
        queries.select("query_id", F.col("text").alias("_query")), "query_id"
    )
    wanted = list(dict.fromkeys(["node_id", "text", *keep]))
    pairs = beside(asked, texts.select(*wanted), "node_id")
    scored = pairs.select("query_id", *by, "node_id", scorer(F.col("_query"), F.col("text")).alias("score"), *keep)
    return _top(scored, top_n, by)


def cutoff(hits: DataFrame, least: float) -> DataFrame:
    return hits.filter(F.col("score") >= least)


# ---- composed searches -----------------------------------------------------

def hybrid_search(
    nodes: DataFrame, postings: DataFrame, queries: DataFrame, query_postings: DataFrame, k: int,
    ranker: str = "rrf", weights: Sequence[float] | None = None, by: Sequence[str] = (), metric: str = "COSINE",
) -> DataFrame:
    """Dense and sparse leg, each of k rows, fused to k rows."""
    dense = dense_search(nodes, queries, k, metric, by)
    sparse = sparse_search(postings, query_postings, k, by)
    return fuse([dense, sparse], k, ranker, weights=weights, by=by)


def retrieve(
    nodes: DataFrame, postings: DataFrame, queries: DataFrame, query_postings: DataFrame, top_k: int = 10,
    use_rerank: bool = True, rerank_top_k: int = 10, similarity_cutoff: float = 0.6,
    scorer: Callable[[Column, Column], Column] = overlap_score, by: Sequence[str] = (),
) -> DataFrame:
    """Hybrid search, rerank, cutoff. The cutoff belongs to the reranker's score."""
    hits = hybrid_search(nodes, postings, queries, query_postings, top_k, by=by)
    if use_rerank:
        kept = rerank(hits, nodes, queries, rerank_top_k, scorer, by, ["doc_id", "text"])
        return cutoff(kept, similarity_cutoff)
    return beside(hits, nodes.select("node_id", "doc_id", "text"), "node_id")


def parents_and_orphans(hits: DataFrame, documents: DataFrame):
    """(hits with their document, doc_ids that are gone and may be deleted)."""
    known = documents.select("doc_id").distinct()
    return hits.join(known, "doc_id", "left_semi"), hits.select("doc_id").distinct().join(known, "doc_id", "left_anti")


def hit_documents(hits: DataFrame, docs: DataFrame, membership: DataFrame) -> DataFrame:
    """Hits with their document, found by hash, where it belongs to the hit's site."""
    wanted = docs.select("document_id", "url", "title", "description", "mimetype", "content_hash")
    found = beside(hits.withColumn("content_hash", u.key_hash(F.col("doc_id"))), wanted, "content_hash")
    return found.join(membership.select("site_id", "document_id"), ["site_id", "document_id"], "left_semi")


def semantic_search(
    nodes: DataFrame, postings: DataFrame, queries: DataFrame, query_postings: DataFrame,
    docs: DataFrame, membership: DataFrame, sites: DataFrame | None = None, top_k: int = 5,
    use_rerank: bool = True, rerank_top_k: int = 10, similarity_cutoff: float = 0.6,
    mimetype: str | None = None, scorer: Callable[[Column, Column], Column] = overlap_score,
) -> DataFrame:
    """Per query and site the best nodes, joined to documents of that site.

    Results keep the order of each site's hits; ``sites`` (site_id, site_no)
    gives the order of the sites. Empty queries give no rows.
    """
    asked = queries.filter(F.coalesce("text", F.lit("")) != "")
    asked_postings = query_postings.join(asked.select("query_id"), "query_id", "left_semi")
    if sites is not None:
        nodes = nodes.join(sites.select("site_id"), "site_id", "left_semi")
        postings = postings.join(sites.select("site_id"), "site_id", "left_semi")
    hits = retrieve(
        nodes, postings, asked, asked_postings, top_k, use_rerank, rerank_top_k, similarity_cutoff, scorer, ["site_id"]
    )
    found = hit_documents(hits, docs, membership)
    if mimetype:
        found = found.filter(F.col("mimetype") == mimetype)
    found = found.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit(labels.NO_TITLE))).withColumn(
        "description", F.coalesce("description", F.lit(""))
    )
    if sites is not None:
        found = found.join(sites.select("site_id", "site_no"), "site_id")
    return found


def page_of_hits(hits: DataFrame, page: int, size: int, global_sort: bool = False) -> DataFrame:
    """One page per query over the sites in order, or by score over all sites."""
    order = (
        [F.col("score").desc(), F.col("node_id").asc()] if global_sort
        else [F.col("site_no").asc(), F.col("rank").asc(), F.col("node_id").asc()]
    )
    numbered = ordered.top_per_key(hits, ["query_id"], order, page * size, "position")
    return numbered.filter(F.col("position") > (page - 1) * size)


def context(hits: DataFrame, order: Sequence[str] = ("rank", "node_id"), plain: bool = False) -> DataFrame:
    """Per query its top hits as one text, in order.

    Blocks of title, url and content parted by an empty line, or with
    ``plain`` the contents alone, one per line.
    """
    block = (
        F.col("text") if plain
        else F.concat(F.lit("来源: "), "title", F.lit("\nURL: "), "url", F.lit("\n内容: "), "text", F.lit("\n"))
    )
    rows = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*order, block.alias("_block")))).alias("_rows")
    )
    return rows.select("query_id", F.array_join(F.transform("_rows", lambda r: r["_block"]), "\n" if plain else "\n\n").alias("context"))


# ---- node table ------------------------------------------------------------

def get_nodes(nodes: DataFrame, *, node_ids: DataFrame | None = None, doc_ids: DataFrame | None = None,
              filters: Sequence[tuple] | None = None) -> DataFrame:
    if sum(x is not None for x in (node_ids, doc_ids, filters)) != 1:
        raise ValueError("give exactly one of node_ids, doc_ids and filters")
    return filter_nodes(nodes, filters or (), doc_ids=doc_ids, node_ids=node_ids)


def delete_nodes(nodes: DataFrame, *, node_ids: DataFrame | None = None, doc_ids: DataFrame | None = None,
                 filters: Sequence[tuple] | None = None) -> DataFrame:
    """The nodes left after a delete by ids, documents or filters."""
    if node_ids is not None:
        nodes = nodes.join(node_ids.select("node_id"), "node_id", "left_anti")
    if doc_ids is not None:
        nodes = nodes.join(doc_ids.select("doc_id"), "doc_id", "left_anti")
    if filters:
        nodes = nodes.filter(~F.coalesce(predicate(filters), F.lit(False)))
    return nodes


def apply_index(nodes: DataFrame, operations: DataFrame, to_nodes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Nodes after a batch of index operations.

    ``operations`` holds (operation, site_id, content_hash, prev_content_hash,
    text, …). new and new_site add, edit replaces what the previous hash left,
    delete removes, skip does nothing. An added document replaces its own
    earlier nodes, so a batch can be run again.
    """
    adds = operations.filter(F.col("operation").isin(docstore.NEW, docstore.NEW_SITE, docstore.EDIT))
    gone_hash = F.when(F.col("operation") == docstore.EDIT, F.array("prev_content_hash", "content_hash")).otherwise(
        F.array("content_hash")
    )
    gone = (
        operations.filter(F.col("operation") != docstore.SKIP)
        .select("site_id", F.explode(gone_hash).alias("_hash"))
        .filter(F.col("_hash").isNotNull())
        .select(u.doc_key(F.col("site_id"), F.col("_hash")).alias("doc_id")).distinct()
    )
    fresh = to_nodes(adds.dropDuplicates(["site_id", "content_hash"]))
    return nodes.join(gone, "doc_id", "left_anti").unionByName(fresh.select(*nodes.columns))


def replace_content(
    nodes: DataFrame, edits: DataFrame, to_nodes: Callable[[DataFrame], DataFrame], held: DataFrame | None = None
) -> DataFrame:
    """New text for indexed documents: (site_id, prev_content_hash, text).

    ``held`` names the (site_id, content_hash) of documents that are not
    edited; a text that one of them holds keeps its nodes.
    """
    if held is not None:
        still = held.select("site_id", F.col("content_hash").alias("prev_content_hash"), F.lit(True).alias("_held")).distinct()
        edits = edits.join(still, ["site_id", "prev_content_hash"], "left").withColumn(
            "prev_content_hash", F.when(F.col("_held").isNull(), F.col("prev_content_hash"))).drop("_held")
    ops = edits.withColumn("operation", F.lit(docstore.EDIT)).withColumn("content_hash", tx.content_hash(F.col("text")))
    return apply_index(nodes, ops, to_nodes)


def list_index(nodes: DataFrame, site_id: str | None = None, content_hash: str | None = None) -> DataFrame:
    """Indexed documents with a 200-character preview of their first chunk."""
    if site_id is not None:
        nodes = nodes.filter(F.col("site_id") == site_id)
    if content_hash is not None:
        nodes = nodes.filter(F.col("content_hash") == content_hash)
    return nodes.filter(F.col("chunk_no") == 0).select(
        "doc_id", "site_id", "content_hash", tx.preview(F.col("text"), 200).alias("preview")
    )
