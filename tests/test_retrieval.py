import numpy as np
import pytest
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from pageloom.operators import chunks, embedding as em, glossary, retrieval as rt


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8)).astype("float32")
    data[10:20] = data[0]  # ties
    nodes = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(data)],
                                  "node_id bigint, embedding array<float>, g int").repartition(5)
    queries = spark.createDataFrame([(i, [float(x) for x in data[i * 7]]) for i in range(6)], "query_id int, embedding array<float>")
    return data.astype("float64"), nodes, queries


def brute(data, q, k, metric):
    if metric == "IP":
        s = data @ q
    elif metric == "L2":
        s = -np.sqrt(((data - q) ** 2).sum(1))
    else:
        s = data @ q / np.linalg.norm(data, axis=1) / np.linalg.norm(q)
    return sorted(range(len(data)), key=lambda i: (-round(s[i], 9) + 0.0, i))[:k]


@pytest.mark.parametrize("metric", rt.METRICS)
def test_dense_search_equals_brute_force(vectors, metric):
    data, nodes, queries = vectors
    got, grid = {}, {}
    for out, df in ((got, rt.dense_search(nodes, queries, 15, metric)),
                    (grid, rt.dense_search_grid(nodes, queries, 15, metric, node_block=50, query_block=2)),):
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.node_id)
    want = {i: brute(data, data[i * 7], 15, metric) for i in range(6)}
    assert got == want and grid == want


def test_many_queries_take_the_grid(vectors):
    _, nodes, queries = vectors
    a = rt.dense_search(nodes, queries, 3, block=2).select("query_id", "node_id", "rank")
    b = rt.dense_search(nodes, queries, 3).select("query_id", "node_id", "rank")
    assert sorted(a.collect()) == sorted(b.collect())


def test_groups_have_their_own_top(vectors):
    _, nodes, queries = vectors
    got = rt.dense_search(nodes, queries, 2, by=["g"]).groupBy("query_id", "g").count()
    assert got.count() == 18 and got.filter("count <> 2").isEmpty()


def test_probed_search(vectors):
    _, nodes, queries = vectors
    centres = rt.train_cells(nodes, 5)
    cells = rt.assign_cells(nodes, centres)
    exact = rt.dense_search(nodes, queries, 8)
    every = rt.probed_search(cells, queries, centres, 8, 5)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    some = rt.recall(rt.probed_search(cells, queries, centres, 8, 2), exact).collect()
    assert len(some) == 6 and all(0 < r.recall <= 1 for r in some)


def test_probed_search_of_many_queries_of_one_id(spark, vectors):
    """More queries of one id (or none) than a block holds are one query; empty tables give nothing."""
    _, nodes, queries = vectors
    centres = rt.train_cells(nodes, 5)
    cells = rt.assign_cells(nodes, centres)
    same = queries.withColumn("query_id", F.lit(None).cast(queries.schema["query_id"].dataType))
    got = rt.probed_search(cells, same.unionByName(same), centres, 4, 5, node_block=7, query_block=2)
    exact = rt.dense_search(nodes, queries, 4).groupBy("node_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node_id").limit(4)
    assert sorted((r.node_id, r.score) for r in got.collect()) == sorted((r.node_id, r.score) for r in exact.collect())
    none = nodes.limit(0)
    assert rt.train_cells(none, 5).shape[0] == 0
    assert rt.probed_search(rt.assign_cells(none, rt.train_cells(none, 5)), queries, rt.train_cells(none, 5), 3, 2).count() == 0
    assert rt.probed_search(cells, queries.limit(0), centres, 3, 2).count() == 0
    assert rt.score_groups(none, queries, ["g"]).count() == 0 and rt.range_search(none, queries, 0.1).count() == 0


@pytest.mark.parametrize("threshold", [-2.0, -0.1, 0.0, 0.35, 0.9])
def test_range_search_is_exact(vectors, threshold):
    _, nodes, queries = vectors
    every = rt.dense_search(nodes, queries, nodes.count())
    want = sorted((r.query_id, r.node_id, r.score) for r in every.filter(F.col("score") >= threshold).collect())
    got = rt.range_search(nodes, queries, threshold, pivots=6, node_block=11, query_block=2)
    assert sorted((r.query_id, r.node_id, r.score) for r in got.collect()) == want


def test_top_of_a_partition_is_kept_over_batches(spark, vectors):
    _, nodes, queries = vectors
    want = sorted(map(tuple, rt.dense_search(nodes, queries, 3, by=["g"]).collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = rt.dense_search(nodes.coalesce(1), queries, 3, by=["g"])
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_mmr(vectors):
    _, nodes, queries = vectors
    plain = rt.dense_search(nodes, queries, 5).select("query_id", "node_id", "rank")
    relevance_only = rt.mmr_search(nodes, queries, 5, 1.0).select("query_id", "node_id", "rank")
    assert sorted(plain.collect()) == sorted(relevance_only.collect())
    diverse = rt.mmr_search(nodes, queries, 5, 0.3)
    assert diverse.groupBy("query_id").agg(F.count_distinct("node_id").alias("n")).filter("n <> 5").isEmpty()
    with pytest.raises(ValueError):
        rt.mmr_search(nodes, queries, 5, prefetch_factor=2, prefetch_k=9)


def test_sparse_search_broadcast_and_salted_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", "the " * (i % 3 + 1) + f"word{i % 7} tail{i}") for i in range(60)], "node_id string, text string")
    queries = spark.createDataFrame([(1, "the word3"), (2, "tail5 word5")], "query_id int, text string")

    def run():
        postings, idf = em.sparse_postings(docs, "node_id")
        q = em.weigh(em.term_counts(queries, "query_id"), idf, "query_id")
        return sorted(map(tuple, rt.sparse_search(postings, q, 5).collect()))

    first = run()
    monkeypatch.setattr(em.join_terms, "__defaults__", (0, 4))
    assert run() == first
    assert len(first) == 10 and [r[1] for r in first if r[0] == 2 and r[3] == 1] == ["d5"]


def test_blocks_of_nodes_and_queries_meet_in_many_tasks(vectors, spark):
    data, nodes, queries = vectors
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {(r.query_id, r.node_id) for r in rt.range_search(nodes, queries, 0.5, pivots=3, node_block=20, query_block=2).collect()}
        centres = rt.train_cells(nodes, 5)
        every = rt.probed_search(rt.assign_cells(nodes, centres), queries, centres, 8, 5, node_block=20, query_block=2)
        assert rt.recall(every, rt.dense_search(nodes, queries, 8)).filter("recall < 1").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    assert found == {(q, n) for q in range(6) for n in range(300) if round(float(unit[n] @ unit[q * 7]), 9) >= 0.5}


def test_replaced_text_that_another_document_holds_stays(spark):
    docs = spark.createDataFrame([("s", "h1", "one two"), ("s", "h2", "three")], "site_id string, content_hash string, text string")
    edits = docs.select("site_id", F.col("content_hash").alias("prev_content_hash"), F.concat("text", F.lit(" more")).alias("text"))
    left = lambda held: {r.text for r in rt.replace_content(
        chunks.document_nodes(docs), edits, lambda d: chunks.document_nodes(d.select("site_id", "content_hash", "text")), held).collect()}
    assert left(None) == {"one two more", "three more"}
    assert left(docs.filter("content_hash = 'h1'")) == {"one two", "one two more", "three more"}


def test_copies_in_two_languages_and_full_upper_case(spark, small_dir, tmp_path):
    import duckdb

    from pageloom.plans import catalog

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(900000 + i, "straße ŉ one", lang, "src1") for i, lang in enumerate(("de", "en", None, "es", "de"))] + [
        (900010, None, "de", "src2"), (900011, "", "de", "src2")]
    more = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    more = more.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("d14_content_replacement", "x1_custom_strategy"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name].strip()}) q").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want), name


def test_found_terms_are_handed_out_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(glossary, "OUT_ROWS", 7)
    automaton = glossary._Automaton(["a", "b", "ab", "c", "zz"])
    texts = ["ab", "c", "", "abc", "zz"] * 6
    pieces = [(m.to_pylist(), r.to_pylist()) for m, r in glossary._found(automaton, pa.array(texts), False)]
    assert len(pieces) > 3 and max(len(m) for m, _ in pieces) < 7 + 4
    got = [(i, t) for m, r in pieces for i, t in zip(m, r)]
    assert sorted(got) == sorted((i, t) for i, x in enumerate(texts) for t, w in enumerate(["a", "b", "ab", "c", "zz"]) if w in x)


def test_tokens_are_counted_before_documents_meet_their_sites(spark):
    from pageloom.operators import reports

    docs = spark.createDataFrame([(1, "one two"), (2, " "), (3, "three")], "document_id int, content string")
    members = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 2), ("c", 9)], "site_id string, document_id int")
    stats = reports.index_stats(docs, membership=members)
    assert sorted(map(tuple, stats.collect())) == [("a", 2, 3, 1.5), ("b", 2, 2, 1.0)]


def test_more_terms_than_are_sent(spark, monkeypatch):
    # word0 to word6 are frequent, the 60 tails are not
    docs = spark.createDataFrame([(f"d{i}", f"the word{i % 7} word{i % 7} tail{i}") for i in range(60)], "node_id string, text string")

    def run():
        return em.sparse_postings(docs, "node_id")[0]

    rows = lambda df: sorted((r.node_id, r.term, round(r.weight, 9)) for r in df.collect())
    first = rows(run())
    assert len(first) == 180
    for limit in (0, 10, 67):
        monkeypatch.setattr(em.join_idf, "__defaults__", (limit,))
        _, idf = em.sparse_postings(docs, "node_id")
        least = em._frequent_from(idf, limit)
        assert idf.filter(idf.n >= least).count() <= limit
        assert rows(run()) == first
    monkeypatch.setattr(em.join_idf, "__defaults__", (10,))
    plan = run()._jdf.queryExecution().executedPlan().toString()
    # one join of rare terms, no copies of the terms, and the texts' own dealing serves the lengths too
    assert plan.count("SortMergeJoin") == 1 and "explode(sequence" not in plan
    assert "Exchange" not in plan[: plan.index("Union")]


def test_hits_with_long_texts_are_not_sent(spark, monkeypatch):
    hits = spark.createDataFrame([(q, f"n{n}", "x" * 500) for q in range(5) for n in range(q, 8)], "query_id int, node_id string, said string")
    big = spark.range(20).select(F.concat(F.lit("n"), "id").alias("node_id"), F.col("id").alias("v"))
    rows = lambda: sorted(map(tuple, rt.beside(hits, big, "node_id").select("query_id", "node_id", "said", "v").collect()))
    first = rows()
    assert len(first) == 30
    monkeypatch.setattr(rt, "SENT_BYTES", 1000)
    assert rows() == first
    assert "SortMergeJoin" in rt.beside(hits, big, "node_id")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rt, "BROADCAST_HITS", 3)
    assert rows() == first


def test_fusion(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id int, node_id string, score double, rank int")
    a, b = leg([(1, "x", 0.9, 1), (1, "y", 0.8, 2)]), leg([(1, "y", 5.0, 1), (1, "z", 4.0, 2)])
    rrf = {r.node_id: r.score for r in rt.fuse([a, b], 5).collect()}
    assert rrf["y"] == pytest.approx(1 / 62 + 1 / 61) and rrf["x"] == pytest.approx(1 / 61)
    weighted = [r.node_id for r in rt.fuse([a, b], 2, "weighted", weights=[1, 0.1]).orderBy("rank").collect()]
    assert weighted == ["y", "x"]
    with pytest.raises(ValueError):
        rt.fuse([a], 1, "other")


def test_cutoff_needs_the_reranker(spark):
    docs = spark.createDataFrame([("s:h1", "s", "alpha beta gamma"), ("s:h2", "s", "alpha delta")], "doc_id string, site_id string, text string")
    nodes = em.embed(docs.withColumn("node_id", F.concat("doc_id", F.lit("#0"))))
    queries = em.embed(spark.createDataFrame([(1, "alpha beta"), (2, "alpha zeta")], "query_id int, text string"))
    postings, idf = em.sparse_postings(nodes, "node_id", keep=["site_id"])
    qp = em.weigh(em.term_counts(queries, "query_id"), idf, "query_id")
    got = rt.retrieve(nodes, postings, queries, qp, 5, similarity_cutoff=0.6)
    assert [(r.query_id, r.doc_id) for r in got.collect()] == [(1, "s:h1")]
    assert rt.retrieve(nodes, postings, queries, qp, 5, use_rerank=False, similarity_cutoff=0.99).count() == 4


def test_index_operations(spark):
    fresh = lambda d: chunks.document_nodes(d.select("site_id", "content_hash", "text"))
    cols = ["node_id", "doc_id", "site_id", "content_hash", "chunk_no", "text"]
    base = spark.createDataFrame([("s", "h1", "one"), ("s", "h2", "two"), ("t", "h1", "one")], "site_id string, content_hash string, text string")
    ops = spark.createDataFrame(
        [("edit", "s", "h1b", "h1", "one b"), ("delete", "s", "h2", None, None), ("new", "s", "h3", None, "three"), ("skip", "t", "h1", None, None)],
        "operation string, site_id string, content_hash string, prev_content_hash string, text string")
    after = rt.apply_index(fresh(base).select(*cols), ops, fresh)
    assert sorted(r.doc_id for r in after.collect()) == ["s:h1b", "s:h3", "t:h1"]
    again = rt.apply_index(after, ops, fresh)
    assert sorted(r.doc_id for r in again.collect()) == ["s:h1b", "s:h3", "t:h1"]


@settings(max_examples=200, deadline=None)
@given(hs.lists(hs.integers(1, 30), max_size=40))
def test_pack_covers_all_sentences_within_the_limit(sizes):
    runs = chunks.pack(sizes, 40, 12)
    assert sorted({i for a, b in runs for i in range(a, b + 1)}) == list(range(len(sizes)))
    for (a, b), (c, d) in zip(runs, runs[1:]):
        assert a < c <= b + 1 and b < d
        assert sum(sizes[c : b + 1]) <= 12
    for a, b in runs:
        assert sum(sizes[a : b + 1]) <= 40


def test_sentence_chunks(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(600))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "word " * 2500)], "id int, text string")
    got = chunks.sentence_chunks(df).orderBy("id", "chunk_no").collect()
    assert all(len(r.text.split()) <= 1024 for r in got)
    first = [r.text for r in got if r.id == 1]
    assert first[0].startswith("Sentence number 0") and first[-1].endswith("599 ends here.") and len(first) == 4
    assert first[1].split()[:3] == first[0].split()[-255:][:3]
    assert [r.id for r in got if r.id == 2] == [] and len([r for r in got if r.id == 3]) == 3


def test_token_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(2000))))], "id int, text string")
    got = [r.text.split() for r in chunks.window_chunks(df).orderBy("chunk_no").collect()]
    assert [(int(x[0]), int(x[-1])) for x in got] == [(0, 1023), (768, 1791), (1536, 1999)]


def test_embedder_is_unit_length_and_repeatable():
    e = em.hashing_embedder()
    a, b = e(["alpha beta", ""]), e(["beta ALPHA", "x"])
    assert np.allclose(a[0], b[0]) and np.isclose(np.linalg.norm(a[0]), 1) and not a[1].any()


def test_glossary(spark, tmp_path):
    g = spark.createDataFrame([("AI", "Artificial Intelligence", "zh1", ""), ("NLP", "Natural Language", "zh2", "note")],
                              "term string, full_name string, translation string, remarks string")
    m = spark.createDataFrame([(1, "This talks about AI and nothing else"), (2, "Nothing here"), (3, "said nlp")], "id int, text string")
    array = sorted((r.id, r.term) for r in glossary.matches(m, g, ["id"]).collect())
    cut = sorted((r.id, r.term) for r in glossary.matches(m, g, ["id"], sent_bytes=20).collect())
    assert array == cut == [(1, "AI"), (3, "AI"), (3, "NLP")]  # "said" holds "ai"
    hint = {r.id: r.hint for r in glossary.hints(glossary.matches(m, g, ["id"]), ["id"]).collect()}
    assert hint[1] == "\nHint for specific terms:\n- AI stands for Artificial Intelligence and zh1 in Chinese.\n"
    (tmp_path / "g.json").write_text('{"A": {"full_name": "f",\n "translation": "t", "remarks": ""}}')
    assert glossary.read_glossary(spark, str(tmp_path)).first().full_name == "f"
    (tmp_path / "g.json").write_text("{broken")
    assert glossary.read_glossary(spark, str(tmp_path)).isEmpty()
    assert glossary.read_glossary(spark, str(tmp_path / "none")).isEmpty()


def test_queries_take_only_their_terms_from_the_idf(spark, monkeypatch):
    """The same weights as from the whole idf table, of which only rows of the queries' terms go on."""
    docs = spark.createDataFrame([(f"n{i}", " ".join(f"w{j}" for j in range(i % 7 + 1)) + f" rare{i}") for i in range(40)], "node_id string, text string")
    asked = spark.createDataFrame([(1, "w0 w0 w3 rare5"), (2, "w1 unknown"), (3, "unknown"), (4, None)], "query_id int, text string")
    _, idf = em.sparse_postings(docs, "node_id")
    whole = sorted((r.query_id, r.term, round(r.weight, 12)) for r in em.weigh(em.term_counts(asked, "query_id"), idf, "query_id").collect())
    assert len(whole) == 4
    met, join_idf = [], em.join_idf
    monkeypatch.setattr(em, "join_idf", lambda counts, idf, *a: met.append(idf.count()) or join_idf(counts, idf, *a))
    for limit, rows in ((100, 4), (5, idf.count())):
        found = em.query_postings(asked, idf, "query_id", limit=limit)
        assert sorted((r.query_id, r.term, round(r.weight, 12)) for r in found.collect()) == whole
        assert met.pop() == rows


def test_long_terms_are_not_sent(spark, monkeypatch):
    """Few terms may be large: what goes to all tasks is bounded by bytes, and the weights stay the same."""
    long = ["x" * 300, "y" * 100_000]
    docs = spark.createDataFrame([(f"n{i}", f"the w{i % 3} {long[i % 2]} rare{i}") for i in range(30)], "node_id string, text string")
    asked = spark.createDataFrame([(1, f"the {long[0]} rare5"), (2, f"w1 {long[1]}")], "query_id int, text string")

    def run():
        postings, idf = em.sparse_postings(docs, "node_id")
        wanted = em.query_postings(asked, idf, "query_id")
        weights = sorted((r.node_id, r.term, round(r.weight, 9)) for r in postings.collect())
        return weights, sorted((r.query_id, r.node_id, r.score, r.rank) for r in rt.sparse_search(postings, wanted, 5).collect())

    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    monkeypatch.setattr(em, "SENT_BYTES", 10_000, raising=False)
    got = run()
    assert sent and all(df.agg(F.sum(F.octet_length("term"))).first()[0] <= 10_000 for df in sent if "term" in df.columns)
    monkeypatch.setattr(em, "SENT_BYTES", 1 << 30, raising=False)
    monkeypatch.setattr(em, "LONGEST_SENT", 1 << 30, raising=False)
    assert run() == got and len(got[0]) == 120
