"""Bucketed windows equal plain ones, also when one key holds most rows."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.operators import changes, ordered, queues as qu


def rows(spark, n=3000):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(40)}", rnd.randrange(500), i, rnd.choice("abc")) for i in range(n)]
    return spark.createDataFrame(data, "k string, t int, seq int, v string")


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_previous_and_running_sum(spark):
    df = rows(spark)
    w = W.partitionBy("k").orderBy("t", "seq")
    bucket = F.floor(F.col("t") / 37)
    prev = ordered.with_previous(df, ["k"], ["t", "seq"], bucket, {"p": "v"})
    assert sorted(map(repr, pairs(prev, "seq", "p"))) == sorted(map(repr, pairs(df.withColumn("p", F.lag("v").over(w)), "seq", "p")))
    run = ordered.with_running_sum(df, ["k"], ["t", "seq"], bucket, F.col("t"), "s")
    assert pairs(run, "seq", "s") == pairs(df.withColumn("s", F.sum("t").over(w)), "seq", "s")
    num = ordered.with_row_number(df, ["k"], ["t", "seq"], bucket, "n")
    assert pairs(num, "seq", "n") == pairs(df.withColumn("n", F.row_number().over(w)), "seq", "n")


def test_top_per_key_is_pruned_before_the_shuffle(spark):
    top = ordered.top_per_key(rows(spark), ["k"], [F.col("t").desc(), F.col("seq")], 3)
    assert top.groupBy("k").count().filter("count > 3").isEmpty()
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_version_numbers(spark):
    data = [("u", h, i) for i, h in enumerate("aabbbac")]
    df = spark.createDataFrame(data, "url string, content_hash string, seq int").withColumn(
        "created_at", F.timestamp_seconds(F.col("seq") * 50_000))
    got = changes.version_numbers(df).orderBy("seq")
    assert [r.version for r in got.collect()] == [1, 1, 2, 2, 2, 3, 4]


def events(spark, *rows):
    df = spark.createDataFrame(
        [(q, t, e, i, float(p)) for i, (q, t, e, p) in enumerate(rows)],
        "queue string, task_id string, event string, seq bigint, processing_time double")
    return df.withColumn("ts", F.timestamp_seconds("seq"))


def test_counter_metrics(spark):
    ev = [("q", str(i), "enqueue", 0) for i in range(5)] + [("q", str(i), "dequeue", 0) for i in range(3)]
    ev += [("q", "0", "complete", 2.5), ("q", "1", "complete", 3.9), ("q", "2", "fail", 0)]
    m = qu.counter_metrics(events(spark, *ev)).first()
    assert (m.pending, m.processing, m.completed, m.failed, m.avg_processing_time) == (2, 0, 2, 1, 3.0)


def test_health(spark):
    cols = "queue string, pending bigint, processing bigint, completed bigint, failed bigint"
    m = spark.createDataFrame([("q1", 1, 0, 1, 0), ("q2", 2001, 0, 1, 2)], cols)
    h = qu.health(m)
    s = qu.summary(h).first()
    assert (s.total_queues, s.unhealthy_queues, s.total_pending) == (2, 1, 2002)
    bad = h.filter("queue = 'q2'").first()
    assert bad.message == "队列积压任务过多 (2001>1000). 队列错误率过高 (66.67%>10.00%). "


def test_stalled_compares_consecutive_checks(spark):
    df = spark.createDataFrame([("q", 1000, 0, 1), ("q", 1006, 1, 1), ("q", 1010, 2, 1), ("q", 1020, 3, 2)],
                               "queue string, s int, seq int, processing int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.stalled for r in qu.stalled(df, 5).orderBy("seq").collect()] == [False, True, False, False]


def test_task_states(spark):
    ev = [("q", "a", e, 0) for e in ("enqueue", "dequeue", "complete", "complete")]
    ev += [("q", "b", e, 0) for e in ("enqueue", "dequeue", "retry", "dequeue", "fail")]
    ev += [("q", "c", e, 0) for e in ("enqueue", "complete")]
    got = {r.task_id: (r.status, r.retry_count) for r in qu.task_states(events(spark, *ev)).collect()}
    assert got == {"a": ("completed", 0), "b": ("failed", 1), "c": ("pending", 0)}


def test_null_keys_and_times_stay(spark):
    data = [("a", 1, 1, "x"), (None, 5, 2, "y"), (None, 9, 3, "z"), ("a", None, 4, "w"), ("a", 77, 5, None), (None, None, 6, "v")]
    df = spark.createDataFrame(data, "k string, t int, seq int, v string")
    w = W.partitionBy("k").orderBy("t", "seq")
    bucket = F.floor(F.col("t") / 10)
    prev = ordered.with_previous(df, ["k"], ["t", "seq"], bucket, {"p": "v"})
    assert sorted(map(repr, pairs(prev, "seq", "p"))) == sorted(map(repr, pairs(df.withColumn("p", F.lag("v").over(w)), "seq", "p")))
    num = ordered.with_row_number(df, ["k"], ["t", "seq"], bucket, "n")
    assert pairs(num, "seq", "n") == pairs(df.withColumn("n", F.row_number().over(w)), "seq", "n")


def test_last_record_of_a_url_with_nulls(spark):
    from pageloom.operators import docstore

    data = [("u", None, None, "s"), ("v", 1, "h", None), ("v", None, "g", "s"), (None, 2, "h", "s")]
    df = spark.createDataFrame(data, "url string, ts int, content_hash string, site_id string")
    got = docstore.latest_per_url(df).select("url", "ts", "content_hash").collect()
    assert {tuple(r) for r in got} == {("u", None, None), ("v", 1, "h"), (None, 2, "h")}


def test_glossary_rule_is_the_same_on_both_paths(spark):
    from pageloom.operators import glossary

    terms = spark.createDataFrame(
        [("AI", "a", "b", "c"), ("", "x", "x", "x"), (None, "y", "y", "y"), ("e", "l", "m", None)],
        "term string, full_name string, translation string, remarks string")
    said = spark.createDataFrame([(1, "an ai here"), (2, "none"), (3, "")], "id int, text string")
    small = sorted(map(tuple, glossary.matches(said, terms, ["id"]).collect()))
    assert sorted(map(tuple, glossary.matches(said, terms, ["id"], sent_bytes=10).collect())) == small
    words = glossary.matches(said, terms, ["id"], whole_word=True)
    assert [r[:2] for r in sorted(map(tuple, words.collect()))] == [(1, "AI")]
    assert [r[:2] for r in small] == [(1, "AI"), (1, "e"), (2, "e")]
    empty = glossary.matches(said, terms.filter("term = ''"), ["id"])
    assert empty.count() == 0 and glossary.hints(empty, ["id"]).count() == 0


def test_sitemap_chains_are_followed_to_their_end(spark):
    from pageloom.sources import records

    def index(i):
        return f"<sitemapindex><sitemap><loc>s{i + 1}</loc></sitemap></sitemapindex>"

    maps = [(f"s{i}", index(i)) for i in range(54)] + [("s54", "<urlset><url><loc>page</loc></url></urlset>")]
    got = records.sitemap_urls(spark.createDataFrame(maps, "url string, body string"), spark.createDataFrame([("s0",)], "url string"))
    assert [tuple(r) for r in got.collect()] == [("s0", "page")]
