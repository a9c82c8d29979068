"""Queries over vectors, postings and searches."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as u
from ..functions import vectors
from ..session import materialize
from ..operators import chunks, docstore as ds, embedding as em, retrieval as rt
from . import testbed as tb
from .registry import query
from .testbed import sql


# ---- vectors: the embeddings table; queries are the mean vectors of its labels

def _vectors(spark, sf):
    return tb.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("node_id"), "embedding", "label")


def _centroids(spark, sf):
    e = tb.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(
        F.col("label").alias("query_id"), F.transform("v", lambda p: p["x"]).alias("embedding"))


_VEC = """
    flat AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    means AS (SELECT label, i, avg(x) AS x FROM flat GROUP BY ALL),
    q AS (SELECT label AS query_id, list(x ORDER BY i) AS qv FROM means GROUP BY label),
    n AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS v, label FROM embeddings),
    cos AS (SELECT query_id, node_id, label, qv, v, round(list_cosine_similarity(qv, v), 9) AS score FROM q, n)"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols or ("score",)})


@query("v4_dense_cosine", f"""
    WITH {_VEC} SELECT query_id, node_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM cos) x WHERE r <= 10""")
def dense_cosine(spark, sf):
    return _rounded(rt.dense_search(_vectors(spark, sf), _centroids(spark, sf), 10))


@query("v4_dense_inner_product", f"""
    WITH {_VEC} SELECT query_id, node_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM (
        SELECT query_id, node_id, round(list_inner_product(qv, v), 9) AS score FROM q, n) y) x WHERE r <= 10""")
def dense_inner_product(spark, sf):
    return _rounded(rt.dense_search(_vectors(spark, sf), _centroids(spark, sf), 10, "IP"))


@query("v4_dense_l2_grid", f"""
    WITH {_VEC} SELECT query_id, node_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM (
        SELECT query_id, node_id, round(-list_distance(qv, v), 9) AS score FROM q, n) y) x WHERE r <= 10""")
def dense_l2_grid(spark, sf):
    return _rounded(rt.dense_search_grid(_vectors(spark, sf), _centroids(spark, sf), 10, "L2", node_block=200, query_block=4))


@query("v4_probed_recall", "SELECT DISTINCT label AS query_id, CAST(1.0 AS DOUBLE) AS all_cells, true AS some_bounded FROM embeddings")
def probed_recall(spark, sf):
    """Recall of the approximate search: all cells give 1, a quarter of them at most that."""
    nodes, queries = _vectors(spark, sf), _centroids(spark, sf)
    centres = rt.train_cells(nodes, 8)
    cells = materialize(rt.assign_cells(nodes, centres), "cells")
    exact = rt.dense_search(nodes, queries, 10)
    full = rt.recall(rt.probed_search(cells, queries, centres, 10, 8), exact)
    some = rt.recall(rt.probed_search(cells, queries, centres, 10, 2), exact)
    return full.withColumnRenamed("recall", "all_cells").join(
        some.select("query_id", F.col("recall").between(0.0, 1.0).alias("some_bounded")), "query_id")


@query("p12_filtered_dense_search", f"""
    WITH {_VEC} SELECT query_id, node_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM cos
      WHERE (label = 1 OR label IN (3, 5, 7)) AND label <> 5 AND node_id IN (SELECT doc_id FROM labels WHERE quality = 1)) x WHERE r <= 5""")
def filtered_dense_search(spark, sf):
    allowed = tb.table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("node_id"))
    nodes = rt.filter_nodes(_vectors(spark, sf), [("label", "==", 1), ("label", "in", [3, 5, 7])], [("label", "!=", 5)], "or", node_ids=allowed)
    return _rounded(rt.dense_search(nodes, _centroids(spark, sf), 5))


@query("j10_similarity_pairs", f"""
    WITH {_VEC} SELECT query_id, label, count(*) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM cos GROUP BY ALL""")
def similarity_pairs(spark, sf):
    """Every query against every node, by blocks of both: only a row for each query, label and block leaves a task."""
    scored = rt.score_groups(_vectors(spark, sf), _centroids(spark, sf), ["label"])
    return _rounded(scored, "best", "mean")


@query("o6_top_k_per_query", f"""
    WITH {_VEC} SELECT query_id, label, node_id, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, node_id) AS r FROM cos) x WHERE r <= 3""")
def top_k_per_query(spark, sf):
    return rt.dense_search(_vectors(spark, sf), _centroids(spark, sf), 3, by=["label"]).select("query_id", "label", "node_id", "rank")


@query("p13_similarity_cutoff", f"WITH {_VEC} SELECT query_id, node_id, round(score, 6) AS score FROM cos WHERE score >= 0.25")
def similarity_cutoff(spark, sf):
    hits = rt.range_search(_vectors(spark, sf), _centroids(spark, sf), 0.25)
    return _rounded(hits).select("query_id", "node_id", "score")


@query("p18_output_fields", "SELECT vec_id AS node_id, 'label ' || label AS text FROM embeddings")
def output_fields(spark, sf):
    v = _vectors(spark, sf).withColumn("text", F.concat(F.lit("label "), "label"))
    return rt.output_fields(v, ["node_id"])


@query("w9_ranks_per_leg", f"""
    WITH {_VEC} SELECT 'cosine' AS leg, query_id, node_id, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM cos) x WHERE r <= 20
    UNION ALL SELECT 'l2', query_id, node_id, CAST(r AS INTEGER) FROM (
      SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(qv, v), 9), node_id) AS r FROM q, n) x WHERE r <= 20""")
def ranks_per_leg(spark, sf):
    v, q = _vectors(spark, sf), _centroids(spark, sf)
    leg = lambda name, m: rt.dense_search(v, q, 20, m).select(F.lit(name).alias("leg"), "query_id", "node_id", "rank")
    return leg("cosine", "COSINE").unionByName(leg("l2", "L2"))


_LEGS = f"""{_VEC},
    a AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM cos QUALIFY r <= 10),
    b0 AS (SELECT query_id, node_id, round(-list_distance(qv, v), 9) AS score FROM q, n),
    b AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM b0 QUALIFY r <= 10)"""


@query("x10_rank_fusion", f"""
    WITH {_LEGS}, f AS (SELECT query_id, node_id, round(sum(s), 12) AS score FROM (
      SELECT query_id, node_id, 1.0::DOUBLE / (60 + r) AS s FROM a UNION ALL SELECT query_id, node_id, 1.0::DOUBLE / (60 + r) FROM b) u GROUP BY ALL),
    w AS (SELECT query_id, node_id, round(sum(s), 12) AS score FROM (
      SELECT query_id, node_id, score * 0.7::DOUBLE AS s FROM a UNION ALL SELECT query_id, node_id, score * 0.3::DOUBLE FROM b) u GROUP BY ALL)
    SELECT 'rrf' AS ranker, query_id, node_id, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10
    UNION ALL SELECT 'weighted', query_id, node_id, round(score, 9) FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10""")
def rank_fusion(spark, sf):
    v, q = _vectors(spark, sf), _centroids(spark, sf)
    legs = [rt.dense_search(v, q, 10), rt.dense_search(v, q, 10, "L2")]
    one = lambda name, df: df.select(F.lit(name).alias("ranker"), "query_id", "node_id", F.round("score", 9).alias("score"))
    return one("rrf", rt.fuse(legs, 10)).unionByName(one("weighted", rt.fuse(legs, 10, "weighted", weights=[0.7, 0.3])))


@query("v7_mmr_search")
def mmr_search(spark, sf):
    return rt.mmr_search(_vectors(spark, sf), _centroids(spark, sf), 5, 0.5)


@query("v12_node_get_delete", """
    SELECT 'get_ids' AS op, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'get_filter', count(*), CAST(sum(vec_id) AS BIGINT) FROM embeddings WHERE label >= 5
    UNION ALL SELECT 'delete', count(*), CAST(sum(vec_id) AS BIGINT) FROM embeddings WHERE NOT (vec_id IN (SELECT doc_id FROM labels) OR label = 3)""")
def node_get_delete(spark, sf):
    v = _vectors(spark, sf)
    ids = tb.table(spark, sf, "labels").select(F.col("doc_id").alias("node_id"))
    agg = lambda op, df: df.agg(F.count(F.lit(1)).alias("n"), F.sum("node_id").alias("ids")).select(F.lit(op).alias("op"), "n", "ids")
    return (agg("get_ids", rt.get_nodes(v, node_ids=ids)).unionByName(agg("get_filter", rt.get_nodes(v, filters=[("label", ">=", 5)])))
            .unionByName(agg("delete", rt.delete_nodes(v, node_ids=ids, filters=[("label", "==", 3)]))))


# ---- texts: documents as nodes, benchmark passages as query texts

def _chunk_source(spark, sf):
    return tb.documents(spark, sf).select(
        "document_id", F.col("source").alias("site_id"), "content_hash", F.col("content").alias("text"))


def _nodes(spark, sf):
    return chunks.document_nodes(_chunk_source(spark, sf).dropDuplicates(["site_id", "content_hash"]).drop("document_id"))


def _query_texts(spark, sf):
    return tb.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _search_tables(spark, sf):
    """(nodes with vectors, postings, queries with vectors, query postings)."""
    nodes = materialize(em.embed(_nodes(spark, sf)), "nodes")
    queries = em.embed(_query_texts(spark, sf))
    postings, q_postings = _postings(nodes, queries)
    return nodes, postings, queries, q_postings


def _postings(nodes, queries):
    """(node postings, query postings) as stored tables."""
    postings, idf = em.sparse_postings(nodes, "node_id", keep=["site_id"])
    return postings, em.query_postings(queries, idf, "query_id")


_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"
_NODES = rf"""
    srcdocs AS (SELECT DISTINCT source AS site_id, content_hash, content AS text FROM docs),
    cw AS (SELECT site_id, content_hash, {_WORDS.format('text')} AS w FROM srcdocs),
    cn AS (SELECT site_id, content_hash, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 256) / 768.0) AS BIGINT)))) AS chunk_no FROM cw WHERE len(w) > 0),
    nodes AS (SELECT site_id || ':' || content_hash || '#' || chunk_no AS node_id, site_id || ':' || content_hash AS doc_id, site_id, content_hash,
                     CAST(chunk_no AS INTEGER) AS chunk_no, array_to_string(w[chunk_no * 768 + 1 : chunk_no * 768 + 1024], ' ') AS text FROM cn)"""
_TERMS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"
_SPARSE = rf"""{_NODES},
    nt AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, {_TERMS} AS term FROM nodes) x GROUP BY ALL),
    idf AS (SELECT term, ln(1 + (SELECT count(*) FROM nodes) / count(*)) AS idf FROM nt GROUP BY term),
    nw AS (SELECT node_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY node_id)) AS weight FROM nt JOIN idf USING (term)),
    qt AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) x GROUP BY ALL),
    qw AS (SELECT query_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS weight FROM qt JOIN idf USING (term)),
    sp AS (SELECT query_id, node_id, round(sum(q.weight * n.weight), 9) AS score FROM qw q JOIN nw n USING (term) GROUP BY ALL)"""
_SLOT = "CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS slot, CASE WHEN CAST(('0x' || substr(md5(term), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END"


def _dense(src, key, out):
    return f"""
    {out}0 AS (SELECT {key}, {_SLOT} * tf AS v FROM {src}),
    {out}1 AS (SELECT {key}, slot, sum(v) AS v FROM {out}0 GROUP BY ALL),
    {out} AS (SELECT {key}, slot, CAST(CAST(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY {key})), 0) AS FLOAT) AS DOUBLE) AS v FROM {out}1)"""


_DENSE = f"""{_dense('nt', 'node_id', 'nv')}, {_dense('qt', 'query_id', 'qv')},
    nn AS (SELECT node_id, sqrt(sum(v * v)) AS l FROM nv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(v * v)) AS l FROM qv GROUP BY 1),
    de AS (SELECT query_id, node_id, round(d / l, 9) AS score FROM (
      SELECT query_id, node_id, sum(q.v * n.v) AS d FROM qv q JOIN nv n USING (slot) GROUP BY ALL) x
      JOIN (SELECT query_id, node_id, nn.l * qn.l AS l FROM nn, qn) y USING (query_id, node_id))"""


def _fused(k, by=""):
    part = f"query_id{', site_id' if by else ''}"
    site = " JOIN nodes USING (node_id)" if by else ""
    return f"""
    dl AS (SELECT {part}, node_id, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, node_id) AS r FROM de{site} QUALIFY r <= {k}),
    sl AS (SELECT {part}, node_id, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, node_id) AS r FROM sp{site} QUALIFY r <= {k}),
    fu AS (SELECT {part}, node_id, round(sum(s), 12) AS score FROM (
      SELECT {part}, node_id, 1.0::DOUBLE / (60 + r) AS s FROM dl UNION ALL SELECT {part}, node_id, 1.0::DOUBLE / (60 + r) FROM sl) x GROUP BY ALL),
    hy AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, node_id) AS rank FROM fu QUALIFY rank <= {k})"""


def _reranked(n, by=""):
    part = f"query_id{', site_id' if by else ''}"
    return f"""
    qset AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS qs FROM benchmark),
    nset AS (SELECT node_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS ns FROM nodes),
    rr0 AS (SELECT {part}, node_id, CAST(len(list_intersect(qs, ns)) AS DOUBLE) / len(qs) AS score FROM hy JOIN qset USING (query_id) JOIN nset USING (node_id)),
    rr AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, node_id) AS rank FROM rr0 QUALIFY rank <= {n})"""


@query("v1_token_window_chunks", sql(f"""
    WITH {_NODES} SELECT node_id, chunk_no, text FROM nodes""", "docs"))
def token_window_chunks(spark, sf):
    return _nodes(spark, sf).select("node_id", "chunk_no", "text")


@query("v1_sentence_chunks")
def sentence_chunks(spark, sf):
    d = tb.text_table(spark, sf, "documents").select("doc_id", "text")
    return chunks.sentence_chunks(d)


@query("v2_dense_vectors", sql(f"""
    WITH {_SPARSE}, {_dense('nt', 'node_id', 'nv')} SELECT node_id, slot, round(v, 6) AS v FROM nv WHERE v <> 0""", "docs"))
def dense_vectors(spark, sf):
    e = em.embed(_nodes(spark, sf)).select("node_id", F.posexplode("embedding").alias("slot", "v"))
    return e.filter("v <> 0").select("node_id", F.col("slot").cast("bigint").alias("slot"), F.round(F.col("v").cast("double"), 6).alias("v"))


@query("v3_sparse_vectors", sql(f"WITH {_SPARSE} SELECT node_id, term, round(weight, 6) AS weight FROM nw", "docs"))
def sparse_vectors(spark, sf):
    return _rounded(em.sparse_postings(materialize(_nodes(spark, sf), "nodes"), "node_id")[0], "weight")


@query("v5_sparse_search", sql(f"""
    WITH {_SPARSE} SELECT query_id, node_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM sp) x WHERE r <= 10""", "docs"))
def sparse_search(spark, sf):
    return _rounded(rt.sparse_search(*_postings(materialize(_nodes(spark, sf), "nodes"), _query_texts(spark, sf)), 10))


@query("v6_hybrid_search", sql(f"""
    WITH {_SPARSE}, {_DENSE}, {_fused(10)} SELECT query_id, node_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM hy""", "docs"))
def hybrid_search(spark, sf):
    nodes, postings, queries, qp = _search_tables(spark, sf)
    return rt.hybrid_search(nodes, postings, queries, qp, 10).withColumn("score", F.round("score", 9))


@query("v8_rerank", sql(f"""
    WITH {_SPARSE}, hy AS (SELECT query_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM sp) x WHERE r <= 20),
    {_reranked(5)} SELECT query_id, node_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rr""", "docs"))
def rerank(spark, sf):
    nodes, queries = materialize(_nodes(spark, sf), "nodes"), _query_texts(spark, sf)
    hits = rt.sparse_search(*_postings(nodes, queries), 20)
    return _rounded(rt.rerank(hits, nodes, queries, 5))


@query("v9_retrieve", sql(f"""
    WITH {_SPARSE}, {_DENSE}, {_fused(10)}, {_reranked(10)}
    SELECT query_id, node_id, n.doc_id, n.text, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rr JOIN nodes n USING (node_id) WHERE score >= 0.6""", "docs"))
def retrieve(spark, sf):
    nodes, postings, queries, qp = _search_tables(spark, sf)
    return _rounded(rt.retrieve(nodes, postings, queries, qp))


_SEARCH = f"""{_SPARSE}, {_DENSE}, {_fused(5, 'site')}, {_reranked(10, 'site')},
    found AS (SELECT rr.query_id, rr.site_id, rr.node_id, rr.score, rr.rank, n.text, d.document_id, d.url,
                     CASE WHEN d.title = '' THEN '无标题' ELSE d.title END AS title, d.mimetype, row_number() OVER () AS any_no
              FROM rr JOIN nodes n USING (node_id) JOIN docs d ON d.content_hash = n.content_hash AND d.source = rr.site_id WHERE score >= 0.5)"""


def _searched(spark, sf, mimetype=None):
    nodes, postings, queries, qp = _search_tables(spark, sf)
    sites = tb.table(spark, sf, "documents").select(F.col("source").alias("site_id")).distinct().withColumn(
        "site_no", F.regexp_extract("site_id", r"(\d+)", 1).cast("int"))
    return rt.semantic_search(nodes, postings, queries, qp, tb.documents(spark, sf), tb.membership(spark, sf), sites,
                              top_k=5, similarity_cutoff=0.5, mimetype=mimetype)


@query("v10_semantic_search", sql(f"""
    WITH {_SEARCH} SELECT query_id, site_id, node_id, document_id, url, title, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM found""", "docs"))
def semantic_search(spark, sf):
    return _rounded(_searched(spark, sf)).select("query_id", "site_id", "node_id", "document_id", "url", "title", "score", "rank")


@query("p14_mime_filter_after_search", sql(f"""
    WITH {_SEARCH} SELECT query_id, site_id, document_id, CAST(rank AS INTEGER) AS rank FROM found WHERE mimetype = 'text/html'""", "docs"))
def mime_filter_after_search(spark, sf):
    return _searched(spark, sf, "text/html").select("query_id", "site_id", "document_id", "rank")


@query("u2_cross_site_page", sql(f"""
    WITH {_SEARCH}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(regexp_extract(site_id, '([0-9]+)', 1) AS INTEGER), rank, node_id) AS position FROM found)
    SELECT query_id, site_id, node_id, CAST(position AS INTEGER) AS position FROM p WHERE position <= 5""", "docs"))
def cross_site_page(spark, sf):
    return rt.page_of_hits(_searched(spark, sf), 1, 5).select("query_id", "site_id", "node_id", "position")


@query("j6_hits_to_documents", sql(f"""
    WITH {_SPARSE}, h AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM sp QUALIFY r <= 10)
    SELECT h.query_id, h.node_id, n.site_id, d.document_id, CAST(h.r AS INTEGER) AS rank FROM h JOIN nodes n USING (node_id)
    JOIN docs d ON d.content_hash = n.content_hash JOIN members m ON m.document_id = d.document_id AND m.site_id = n.site_id""", "docs", "members"))
def hits_to_documents(spark, sf):
    nodes = materialize(_nodes(spark, sf), "nodes")
    hits = rt.sparse_search(*_postings(nodes, _query_texts(spark, sf)), 10).join(nodes.select("node_id", "doc_id", "site_id"), "node_id")
    return rt.hit_documents(hits, tb.documents(spark, sf), tb.membership(spark, sf)).select(
        "query_id", "node_id", "site_id", "document_id", "rank")


@query("j5_parents_and_orphans", f"""
    WITH {_VEC}, h AS (SELECT query_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM cos) x WHERE r <= 20)
    SELECT 'hit' AS kind, query_id, node_id AS doc_id FROM h WHERE node_id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT DISTINCT 'orphan', CAST(NULL AS INTEGER), node_id FROM h WHERE node_id NOT IN (SELECT doc_id FROM labels)""")
def parents_and_orphans(spark, sf):
    hits = rt.dense_search(_vectors(spark, sf), _centroids(spark, sf), 20).withColumn("doc_id", F.col("node_id"))
    kept, orphans = rt.parents_and_orphans(hits, tb.table(spark, sf, "labels"))
    return kept.select(F.lit("hit").alias("kind"), "query_id", "doc_id").unionByName(
        orphans.select(F.lit("orphan").alias("kind"), F.lit(None).cast("int").alias("query_id"), "doc_id"))


@query("o7_rerank_top_n", sql(f"""
    WITH {_SPARSE}, hy AS (SELECT query_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM sp) x WHERE r <= 10),
    t AS (SELECT hy.*, -length(n.text)::DOUBLE AS score FROM hy JOIN nodes n USING (node_id))
    SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INTEGER) AS rank FROM t QUALIFY rank <= 3""", "docs"))
def rerank_top_n(spark, sf):
    """A custom scorer in the reranker slot: shorter texts first."""
    nodes, queries = materialize(_nodes(spark, sf), "nodes"), _query_texts(spark, sf)
    hits = rt.sparse_search(*_postings(nodes, queries), 10)
    return rt.rerank(hits, nodes, queries, 3, scorer=lambda q, t: -F.length(t).cast("double"))


@query("a12_context_assembly", f"""
    WITH {_VEC}, h AS (SELECT query_id, node_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM cos QUALIFY rank <= 5)
    SELECT query_id, string_agg('来源: t' || node_id || chr(10) || 'URL: u' || node_id || chr(10) || '内容: label ' || label || chr(10), chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY 1""")
def context_assembly(spark, sf):
    v = _vectors(spark, sf)
    hits = rt.dense_search(v, _centroids(spark, sf), 5).join(v.select("node_id", "label"), "node_id")
    return rt.context(hits.select("query_id", "node_id", "rank", F.concat(F.lit("t"), "node_id").alias("title"),
                                  F.concat(F.lit("u"), "node_id").alias("url"), F.concat(F.lit("label "), "label").alias("text")))


_REWRITES = r"""rewrites AS (SELECT item_id AS question_id, item_id * 100 + i AS query_id, line AS text FROM (
      SELECT item_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM (
        SELECT item_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM benchmark) a) b)"""


def _rewrites(spark, sf):
    r = tb.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.posexplode(tx.rewrite_lines(F.col("text"))).alias("i", "text"))
    return r.select("question_id", (F.col("question_id") * 100 + F.col("i")).alias("query_id"), "text")


_DEEP = f"""{_SPARSE.replace('qt AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, ' + _TERMS + ' AS term FROM benchmark) x GROUP BY ALL)',
    _REWRITES + ', qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, ' + _TERMS + ' AS term FROM rewrites) x GROUP BY ALL)')},
    dp AS (SELECT question_id, query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM sp JOIN rewrites USING (query_id) QUALIFY rank <= 3)"""


def _deep_hits(spark, sf):
    nodes, queries = materialize(_nodes(spark, sf), "nodes"), _rewrites(spark, sf)
    hits = rt.sparse_search(*_postings(nodes, queries), 3)
    return nodes, hits.join(queries.select("query_id", "question_id"), "query_id")


@query("u5_multi_query_union", sql(f"WITH {_DEEP} SELECT question_id, query_id, node_id, CAST(rank AS INTEGER) AS rank FROM dp", "docs"))
def multi_query_union(spark, sf):
    return _deep_hits(spark, sf)[1].select("question_id", "query_id", "node_id", "rank")


@query("v11_deep_search", sql(f"""
    WITH {_DEEP} SELECT question_id AS query_id, string_agg('来源: ' || n.doc_id || chr(10) || 'URL: ' || node_id || chr(10) || '内容: ' || n.text || chr(10), chr(10) || chr(10)
      ORDER BY dp.query_id, dp.rank) AS context FROM dp JOIN nodes n USING (node_id) GROUP BY 1""", "docs"))
def deep_search(spark, sf):
    nodes, hits = _deep_hits(spark, sf)
    rows = hits.join(nodes.select("node_id", "doc_id", "text"), "node_id").select(
        F.col("question_id").alias("query_id"), F.col("query_id").alias("rewrite_id"), "rank",
        F.col("doc_id").alias("title"), F.col("node_id").alias("url"), "text")
    return rt.context(rows, ("rewrite_id", "rank"))


@query("v13_node_ingest", sql(f"""
    WITH {_SPARSE}, {_dense('nt', 'node_id', 'nv')}, t AS (SELECT node_id, count(*) AS n_terms FROM (SELECT DISTINCT node_id, substr(md5(term), 1, 7) AS i FROM nt) y GROUP BY 1)
    SELECT node_id, doc_id, site_id, chunk_no, 64 AS dimensions, coalesce(n_terms, 0) AS n_terms FROM nodes LEFT JOIN t USING (node_id)""", "docs"))
def node_ingest(spark, sf):
    nodes = materialize(_nodes(spark, sf), "nodes")
    sparse = em.sparse_maps(em.sparse_postings(nodes, "node_id")[0], "node_id")
    full = em.embed(nodes).join(sparse, "node_id", "left")
    return full.select("node_id", "doc_id", "site_id", "chunk_no", F.size("embedding").alias("dimensions"),
                       F.coalesce(F.size("sparse"), F.lit(0)).cast("bigint").alias("n_terms"))


@query("v14_index_listing", sql(f"""
    WITH {_NODES} SELECT doc_id, content_hash, substr(text, 1, 200) AS preview FROM nodes WHERE site_id = 'src4' AND chunk_no = 0""", "docs"))
def index_listing(spark, sf):
    return rt.list_index(_nodes(spark, sf), "src4").select("doc_id", "content_hash", "preview")


@query("d13_index_operations", sql(rf"""
    WITH live AS (SELECT source AS site_id, content_hash, content AS text FROM store WHERE content_hash <> ''),
    ops AS (SELECT c.site_id, c.operation, c.content_hash, c.prev_content_hash, d.content AS text FROM settled c JOIN docs d ON d.url = c.url),
    gone AS (SELECT site_id || ':' || content_hash AS k FROM ops WHERE operation <> 'skip'
             UNION SELECT site_id || ':' || prev_content_hash FROM ops WHERE operation = 'edit'),
    kept AS (SELECT DISTINCT site_id, content_hash, text FROM live WHERE site_id || ':' || content_hash NOT IN (SELECT k FROM gone)),
    added AS (SELECT DISTINCT site_id, content_hash, text FROM ops WHERE operation IN ('new', 'new_site', 'edit')),
    every AS (SELECT * FROM kept UNION ALL SELECT * FROM added),
    w AS (SELECT site_id, content_hash, {_WORDS.format('text')} AS w FROM every)
    SELECT site_id || ':' || content_hash AS doc_id, greatest(1, CAST(ceil((len(w) - 256) / 768.0) AS BIGINT)) AS chunks, CAST(len(w) AS BIGINT) AS tokens FROM w WHERE len(w) > 0""",
    "settled", "store"))
def index_operations(spark, sf):
    from .store_queries import _settled

    cols = ["node_id", "doc_id", "site_id", "content_hash", "chunk_no", "text"]
    live = tb.store(spark, sf).filter("content_hash <> ''").select(
        F.col("source").alias("site_id"), "content_hash", F.col("content").alias("text")).dropDuplicates(["site_id", "content_hash"])
    changes = _settled(spark, sf).select("url", "site_id", "operation", "prev_content_hash")
    ops = tb.incoming(spark, sf).select("url", "content_hash", F.col("content").alias("text")).join(changes, "url")
    fresh = lambda d: chunks.document_nodes(d.select("site_id", "content_hash", "text"))
    after = rt.apply_index(fresh(live).select(*cols), ops, fresh)
    n = tx.word_count(F.col("text"))
    return after.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        (F.sum(n) - 256 * (F.count(F.lit(1)) - 1)).cast("bigint").alias("tokens"))


@query("d14_content_replacement", sql(rf"""
    WITH e AS (SELECT DISTINCT source AS site_id, content AS text, content_hash, lang FROM docs),
    r AS (SELECT site_id, CASE WHEN lang = 'de' THEN sha256(text || ' replaced') ELSE content_hash END AS h,
                 CASE WHEN lang = 'de' THEN text || ' replaced' ELSE text END AS t FROM e)
    SELECT DISTINCT site_id || ':' || h AS doc_id, CAST(greatest(1, ceil((n - 256) / 768.0)) AS BIGINT) AS chunks, n AS tokens
    FROM (SELECT *, CAST(len({_WORDS.format('t')}) AS BIGINT) AS n FROM r) y WHERE n > 0""", "docs"))
def content_replacement(spark, sf):
    cols = ["node_id", "doc_id", "site_id", "content_hash", "chunk_no", "text"]
    docs = tb.documents(spark, sf).select(F.col("source").alias("site_id"), "content_hash", F.col("content").alias("text"), "lang").filter("text IS NOT NULL")
    base = docs.dropDuplicates(["site_id", "content_hash"])
    german = F.col("lang").eqNullSafe("de")  # copies of one text may differ in their language
    fresh = lambda d: chunks.document_nodes(d.select("site_id", "content_hash", "text"))
    edits = docs.filter(german).dropDuplicates(["site_id", "content_hash"]).select(
        "site_id", F.col("content_hash").alias("prev_content_hash"), F.concat("text", F.lit(" replaced")).alias("text"))
    after = rt.replace_content(fresh(base).select(*cols), edits, fresh, docs.filter(~german))
    # neighbouring chunks share 256 words
    return after.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        (F.sum(tx.word_count(F.col("text"))) - 256 * (F.count(F.lit(1)) - 1)).cast("bigint").alias("tokens"))
