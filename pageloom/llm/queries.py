"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op5_substring_dedup", f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
    h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM s),
    r AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
    c AS (SELECT doc_id, unnest(range(p, p + 35)) AS i FROM h SEMI JOIN r USING (h)),
    g AS (SELECT doc_id, list(DISTINCT i) AS gone FROM c GROUP BY doc_id),
    o AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
    k AS (SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
      list_filter(w, lambda x, i: NOT list_contains(gone, i)) AS kept FROM o)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
      sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""")
def substring_dedup(spark, sf_dir):
    from . import substring_dedup as m

    return m.substring_dedup(documents(spark, sf_dir), 35).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query("op4_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    from . import suffix_dedup as m

    return m.suffix_dedup(documents(spark, sf_dir), 50).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query("op1_ngram_jaccard")
def ngram_jaccard(spark, sf_dir):
    from . import ngram_jaccard as m

    return m.ngram_jaccard(documents(spark, sf_dir), 4, 85).select("doc_id", "n_shingles", "component_id", "class_id")


@query("op3_packing")
def packing(spark, sf_dir):
    import public_tokenizers

    from . import packing as m

    return m.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048, 1).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_quality_rules")
def quality_rules(spark, sf_dir):
    from . import quality_rules as m

    return m.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_va_search", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(
      CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM r WHERE r <= 5""")
def va_search(spark, sf_dir):
    from . import va_search as m

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return m.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@query("op2_piece_encoding")
def piece_encoding(spark, sf_dir):
    import public_tokenizers

    from . import piece_model as m

    return m.round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), "parity", "restored")


@query("op10_secret_scan")
def secret_scan(spark, sf_dir):
    from . import secret_scan as m

    return m.secret_scan(documents(spark, sf_dir)).select(
        "doc_id", "position", "nth", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


@query("op9_toxicity")
def toxicity(spark, sf_dir):
    from . import toxicity as m

    docs = documents(spark, sf_dir)
    model = m.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return m.score(docs, model).select(
        "doc_id", m.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


@query("op6_line_dedup")
def line_dedup(spark, sf_dir):
    from . import line_templates as m

    return m.line_dedup(documents(spark, sf_dir), shortest=1).select(
        "doc_id", "lines_total", "lines_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op12_conversation_repair", r"""
    WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
        lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c
      FROM (SELECT unnest(range(256)) AS i))),
    x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
        [4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
          coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
        lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 20 AS f FROM conversations, tbl),
    y AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
      CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM x WHERE f <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM y),
    v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
      left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
      regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') AS cut FROM o),
    z AS (SELECT *, again AND NOT blank AS duplicate, cut AND NOT again AND NOT blank AS truncated,
      lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM v),
    ins(s, n, t, lines) AS (VALUES (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
      (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
      (2, 0, 2, []), (2, 1, 3, ['assistant:']), (3, 0, 3, []), (3, 1, 2, ['user:'])),
    d AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS rep FROM z
      UNION ALL
      (SELECT conv_id, i, s, cost, audit, rep FROM (
        SELECT d.conv_id, z.i, CASE e WHEN 'D' THEN ins.t WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
            ELSE CASE ins.t WHEN 2 THEN 3 ELSE 2 END END AS s,
          d.cost + 5 * n + CASE e WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN truncated AND e <> 'D' THEN 5 ELSE 0 END AS cost,
          d.audit || repeat('I', n) || e AS audit,
          d.rep || CAST(lines AS VARCHAR[]) || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
            ELSE [CASE ins.t WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END AS rep
        FROM d JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id AND z.i = d.i + 1 JOIN ins ON ins.s = d.s,
          (SELECT unnest(['D', 'K', 'R']) AS e)
        WHERE e = 'D' OR (NOT blank AND NOT duplicate AND (e = 'R' OR (initial = 's' AND ins.t = 0)
          OR (initial = 'u' AND ins.t <> 2) OR (initial = 'a' AND ins.t = 2))))
        QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1)),
    m AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
      count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
      count(*) FILTER (illegal) AS illegal FROM z GROUP BY conv_id),
    e AS (SELECT m.*, d.cost + 5 * n AS cost, d.audit || repeat('I', n) AS audit, d.rep || CAST(lines AS VARCHAR[]) AS rep
      FROM m JOIN d ON d.conv_id IS NOT DISTINCT FROM m.conv_id AND d.i = m.last JOIN ins ON ins.s = d.s AND ins.t IN (0, 3)
      QUALIFY row_number() OVER (PARTITION BY m.conv_id ORDER BY d.cost + 5 * n, d.audit || repeat('I', n)) = 1)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
      coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rep, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""")
def conversation_repair(spark, sf_dir):
    from . import conversation_repair as m

    return m.repaired_damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op13_phrase_collocations", r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
    w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
    g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM
      (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, phrase, k AS size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
    s AS (SELECT lang, phrase, size, a, w, unnest(range(1, size)) AS k FROM c),
    x AS (SELECT s.lang, s.phrase, s.a, s.k, h.f AS l, r.f AS r,
      CAST((CAST(1000000 AS HUGEINT) * s.a * s.a) // (CAST(h.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM s
      JOIN f h ON h.lang = s.lang AND h.phrase = array_to_string(w[1:s.k], ' ')
      JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(w[s.k + 1:], ' ')),
    b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    o AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
    m AS (SELECT lang, phrase, max(a) AS longer FROM o GROUP BY ALL),
    y AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
    z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
    SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000""")
def phrase_collocations(spark, sf_dir):
    from . import collocations as m

    return m.collocations(documents(spark, sf_dir), support=10, longest=3, first=2000)


@query("op11_html_extraction")
def html_extraction(spark, sf_dir):
    from . import html_wrapper as m

    found = m.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", F.array_join("blocks", "\n\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
