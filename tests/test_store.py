import datetime as dt

from pyspark.sql import functions as F

from pageloom.operators import docstore as ds

DAY = dt.datetime(2024, 1, 1)
NOW = F.lit("2024-02-01").cast("timestamp")
DOC = "document_id bigint, url string, content string, content_hash string, title string, clean_content string, description string, version int, index_operation string, is_indexed boolean, created_at timestamp, updated_at timestamp"


def store(spark, *rows):
    return spark.createDataFrame(
        [(i, u, c, h, "t", c, None, 1, "new", True, DAY, DAY) for i, u, c, h in rows], DOC)


def members(spark, *pairs):
    return spark.createDataFrame([(s, d, DAY) for s, d in pairs], "site_id string, document_id bigint, created_at timestamp")


def incoming(spark, *rows):
    return spark.createDataFrame(rows, "url string, site_id string, content_hash string")


def outcome(df):
    return {r.url: (r.document_id, r.operation) for r in df.collect()}


def test_classify_keeps_the_order_of_the_tests(spark):
    docs = store(spark, (1, "u1", "a", "ha"), (2, "u2", "b", "hb"))
    got = outcome(ds.classify(
        incoming(spark, ("u1", "s", "ha"), ("u2", "s", "changed"), ("u3", "s", "hnew"), ("u4", "s", "hb"), ("u5", "s", "")),
        docs, members(spark, ("s", 1), ("other", 2)),
    ))
    assert got["u1"] == (1, "skip")
    assert got["u2"] == (2, "new_site")  # changed, yet not in the site
    assert got["u3"] == (None, "new")
    assert got["u4"] == (2, "new_site")  # unknown URL, known content
    assert got["u5"] == (None, "new")    # empty content matches nothing


def test_edit_without_site_or_hash(spark):
    docs, m = store(spark, (1, "u1", "a", "ha")), members(spark, ("s", 1))
    assert outcome(ds.classify(incoming(spark, ("u1", "s", "x")), docs, m))["u1"] == (1, "edit")
    assert outcome(ds.classify(incoming(spark, ("u1", None, "ha")), docs, m))["u1"] == (1, "skip")
    assert outcome(ds.classify(incoming(spark, ("u1", "s", None)), docs, m))["u1"] == (1, "skip")


def test_copies_within_a_batch(spark):
    changes = ds.classify(
        incoming(spark, ("u2", "s", "h"), ("u1", "s", "h"), ("u3", "z", "h"), ("e1", "s", ""), ("e2", "s", "")),
        store(spark, (9, "old", "o", "ho")), members(spark, ("s", 9)))
    got = outcome(ds.settle_copies(changes))
    assert got["u1"][1] == "new" and got["u2"] == (got["u1"][0], "skip") and got["u3"] == (got["u1"][0], "new_site")
    assert got["e1"][1] == got["e2"][1] == "new" and got["e1"][0] != got["e2"][0]


def test_apply_and_history(spark):
    before = store(spark, (1, "u1", "a", "ha"), (2, "u2", "b", "hb"))
    m = members(spark, ("s", 1), ("s", 2))
    batch = spark.createDataFrame(
        [("u1", "s", "a2", "ha2", "T2", DAY), ("u2", "s", "b", "hb", None, DAY), ("u3", "s", "c", "hc", None, DAY)],
        "url string, site_id string, content string, content_hash string, title string, ts timestamp")
    changes = ds.settle_copies(ds.classify(batch.select("url", "site_id", "content_hash"), before, m))
    after = ds.apply_documents(before, batch, changes, NOW)
    rows = {r.url: r for r in after.collect()}
    assert (rows["u1"].version, rows["u1"].content, rows["u1"].title, rows["u1"].is_indexed) == (2, "a2", "T2", False)
    assert (rows["u2"].version, rows["u2"].title, rows["u2"].is_indexed) == (1, "t", True)
    assert rows["u3"].version == 1 and rows["u3"].document_id >= 0
    assert ds.apply_membership(m, changes, NOW).count() == 3
    hist = {r.url: r for r in ds.history_rows(before, after, changes, NOW).collect()}
    assert {k: v.change_type for k, v in hist.items()} == {"u1": "edit", "u3": "new"}
    assert hist["u1"].content_length == 2


def test_delete_drops_a_document_with_its_last_site(spark):
    docs = store(spark, (1, "u1", "a", "ha"), (2, "u2", "b", "hb"), (3, "u3", "c", "hc"))
    m = members(spark, ("s", 1), ("t", 1), ("s", 2), ("s", 3), ("t", 3))
    req = spark.createDataFrame([("u1", "s"), ("u2", "s"), ("u3", None)], "url string, site_id string")
    left, pairs = ds.delete_documents(docs, m, req)
    assert [r.url for r in left.collect()] == ["u1"]
    assert [(r.site_id, r.document_id) for r in pairs.collect()] == [("t", 1)]


def test_newest_per_hash_with_a_hot_hash(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("document_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("content_hash"),
        F.timestamp_seconds(F.col("id")).alias("updated_at"))
    got = ds.newest_per_hash(rows)
    assert got.count() == 2001
    assert got.filter("content_hash = 'hot'").first().document_id == 2997
