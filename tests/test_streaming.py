import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pageloom import hooks
from pageloom.operators import cleaning
from pageloom.session import scratch_path
from pageloom.streaming import stages as st
from pageloom.streaming.log_table import LogTable

RECORD = "url string, site_id string, content string, mimetype string, title string, ts timestamp, status string, crawler_operation string"


@pytest.fixture(autouse=True, scope="module")
def small_plans(spark):
    """The tables here have a few rows: one partition, and no re-planning between stages."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def records(spark, *rows):
    df = spark.createDataFrame([(u, s, c, "text/plain", None, None, None) for u, s, c in rows],
                               "url string, site_id string, content string, mimetype string, title string, status string, crawler_operation string")
    return df.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).select(*[c.split()[0] for c in RECORD.split(", ")])


def state(spark, site):
    docs = sorted((r.url, r.version, r.clean_content) for r in st.current_documents(spark, site).collect())
    nodes = sorted((r.site_id, r.text) for r in st.current_nodes(spark, site).collect())
    return docs, nodes


def test_ingest_is_idempotent(spark):
    site = st.Site(scratch_path(spark, "site"))
    run = st.ingest_batch(site)
    run(records(spark, ("u1", "s", "one "), ("u2", "s", "two"), ("u3", None, "x"), ("u4", "s", None)), 0)
    second = records(spark, ("u1", "s", "one b"), ("u2", "t", "two"), ("u5", "s", "two"))
    run(second, 1)
    first_time = state(spark, site)
    run(second, 1)
    assert state(spark, site) == first_time
    docs, nodes = first_time
    assert docs == [("u1", 2, "one b"), ("u2", 1, "two")]
    assert nodes == [("s", "one b"), ("s", "two"), ("t", "two")]
    dead = st.read_log(spark, site.at("dead"), st.DEAD)
    # a record without a site is skipped, which is no failure
    assert sorted((r.url, r.reason) for r in dead.collect()) == [("u4", "url or content missing")]
    gone = records(spark, ("u1", "s", None)).withColumn("crawler_operation", F.lit("delete"))
    image = records(spark, ("u9", "s", "bytes")).withColumn("mimetype", F.lit("image/png"))
    run(gone.unionByName(image), 2)
    docs, nodes = state(spark, site)
    assert [d[0] for d in docs] == ["u2"] and nodes == [("s", "two"), ("t", "two")]
    rejected = st.read_log(spark, site.at("rejected"), st.REJECTED).collect()
    assert [(r.url, r.mimetype) for r in rejected] == [("u9", "image/png")]
    run(records(spark, ("u1", "s", "one b")), 3)
    docs, nodes = state(spark, site)
    assert [d[0] for d in docs] == ["u1", "u2"] and ("s", "one b") in nodes


def test_plans_of_a_batch_stay_short(spark):
    """The driver keeps the plans of its jobs: a step may not carry those of all steps before it."""
    site = st.Site(scratch_path(spark, "site"))
    run = st.ingest_batch(site)
    store = spark._jsparkSession.sharedState().statusStore()
    run(records(spark, ("u1", "s", "one"), ("u2", "s", "two"), ("u3", "s", "three")), 0)
    known = store.executionsCount()
    changed, again = records(spark, ("u1", "s", "one b"), ("u2", "s", "two")), records(spark, ("u2", "s", "two"))
    run(changed.unionByName(again).unionByName(records(spark, ("u3", "s", None)).withColumn("crawler_operation", F.lit("delete"))), 1)
    plans = store.executionsList(int(known), 1000)
    sizes = [len(re.findall(r"^\(\d+\) ", plans.apply(i).physicalPlanDescription(), re.M)) for i in range(plans.size())]
    assert len(sizes) > 5 and max(sizes) < 150
    assert state(spark, site) == ([("u1", 2, "one b"), ("u2", 1, "two")], [("s", "one b"), ("s", "two")])
    held = {name: len(os.listdir(site.at(f"held/{name}"))) for name in os.listdir(site.at("held"))}
    assert set(held) >= {"last", "known", "members", "cleaned"}  # one folder for each step, not for each batch


def test_nodes_live_as_long_as_a_document_holds_their_text(spark):
    """u1 is edited to the text of u2 and goes: the node of u2 stays; so with two sites and with a further edit."""
    site = st.Site(scratch_path(spark, "site"), fan=2)
    run = st.ingest_batch(site)
    gone = lambda *rows: records(spark, *rows).withColumn("crawler_operation", F.lit("delete"))
    run(records(spark, ("u1", "s", "one"), ("u2", "s", "two"), ("u3", "t", "three")), 0)
    run(records(spark, ("u1", "s", "two"), ("u3", "t", "two")), 1)
    assert state(spark, site)[1] == [("s", "two"), ("t", "two")]
    run(records(spark, ("u3", "t", "four")), 2)
    assert state(spark, site)[1] == [("s", "two"), ("t", "four")]
    run(gone(("u1", "s", None)), 3)
    docs, nodes = state(spark, site)
    assert [d[0] for d in docs] == ["u2", "u3"] and nodes == [("s", "two"), ("t", "four")]
    run(records(spark, ("u4", "s", "two"), ("u2", "s", "five")), 4)
    # u4 is a copy of what u2 held before this batch: the same document, which u2 changes
    docs, nodes = state(spark, site)
    assert ("u2", 2, "five") in docs and ("s", "five") in nodes and ("s", "two") not in nodes
    run(gone(("u2", "s", None), ("u3", "t", None)), 5)
    assert state(spark, site) == ([], [])


def test_log_table_equals_a_dict_and_stays_small(spark):
    """Random changes over ten batches: the same rows as a dict, few runs, hardly more rows than live."""
    table = LogTable(scratch_path(spark, "log"), "name string, v int", ("name",), "name", buckets=4, fan=2)
    rng, model, schema = random.Random(4), {}, "name string, v int"
    for batch in range(10):
        put = {f"n{rng.randrange(12)}": batch * 100 + i for i in range(5)}
        gone = [n for n in rng.sample(sorted(model), min(2, len(model))) if n not in put]
        changed = spark.createDataFrame(list(put.items()), schema).coalesce(1)
        dead = spark.createDataFrame([(n,) for n in gone], "name string").coalesce(1)
        for _ in range(2 if batch in (3, 7) else 1):  # a batch that is run again changes nothing
            table.write(changed, batch, dead)
            table.merge(spark, batch)
        model.update(put)
        for n in gone:
            del model[n]
        if batch in (2, 3, 7, 9):
            assert {r.name: r.v for r in table.current(spark).collect()} == model
    assert table.cover(spark) == [(0, 7), (8, 9)] and table.cover(spark, 8) == [(0, 7)]
    assert table.cover(spark, 7) == [(0, 3), (4, 5), (6, 6)] and LogTable(table.root + "-none", schema, ("name",), "name").cover(spark) == []
    assert table.log(spark).count() <= len(model) + 12
    # a look-up of one key reads its folder alone
    for name in ("n1", "n5", "none"):
        keys = spark.createDataFrame([(name,)], "name string")
        found = table.find(keys, 10)
        assert {r.name: r.v for r in found.collect()} == {n: v for n, v in model.items() if n == name}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan)


@pytest.mark.parametrize("kind", ["function", "expression"])
def test_a_failing_strategy_fails_one_record(spark, kind):
    def strict(text):
        if "bad" in text:
            raise ValueError("cannot read this")
        return text.upper()

    handles = lambda url, mime, content: mime.startswith("text/plain")
    raising = lambda c: F.when(c.contains("bad"), F.raise_error(F.lit("cannot read this"))).otherwise(F.upper(c))
    strategy = cleaning.Strategy("strict", handles, function=strict) if kind == "function" else cleaning.Strategy("strict", handles, raising)
    site = st.Site(scratch_path(spark, "site"))
    run = st.ingest_batch(site, (strategy,))
    rows = [(f"u{i}", "s", "bad" if i == 3 else f"text {i}") for i in range(8)]
    run(records(spark, *rows), 0)
    run(records(spark, ("u3", "s", "bad again"), ("u9", "s", "fine")), 1)
    docs, nodes = state(spark, site)
    assert [d[0] for d in docs] == [f"u{i}" for i in (0, 1, 2, 4, 5, 6, 7, 9)] and ("s", "TEXT 0") in nodes
    dead = sorted(st.read_log(spark, site.at("dead"), st.DEAD).collect(), key=lambda r: r.batch)
    assert [(r.url, r.content, r.stage, r.retry_count) for r in dead] == [("u3", "bad", "clean", 0), ("u3", "bad again", "clean", 1)]
    assert all("cannot read this" in r.reason for r in dead)
    run(records(spark, ("u3", "s", "good now")), 2)
    assert ("s", "GOOD NOW") in state(spark, site)[1]


def test_task_state_goes_on_over_batches(spark):
    inbox, root, mark = (scratch_path(spark, n) for n in ("inbox", "sink", "mark"))
    schema = "queue string, task_id string, event string, seq bigint, ts timestamp, processing_time double"

    def send(*rows):
        df = spark.createDataFrame([("q", t, e, i, 1.0) for t, e, i in rows], "queue string, task_id string, event string, seq bigint, processing_time double")
        df.withColumn("ts", F.timestamp_seconds("seq")).select("queue", "task_id", "event", "seq", "ts", "processing_time").write.mode("append").parquet(inbox)
        stream = st.task_states(st.file_stream(spark, inbox, schema))
        st.run_available(stream, st.batch_sink(root), mark, "update")

    send(("a", "enqueue", 1), ("a", "dequeue", 2))
    send(("a", "complete", 3), ("b", "enqueue", 4), ("b", "complete", 5))
    got = {r.task_id: (r.status, r.updated_at) for r in st.latest(st.read_log(spark, root, st.TASK_OUT), ["task_id"]).collect()}
    assert got == {"a": ("completed", 3_000_000), "b": ("pending", 4_000_000)}


def test_task_processor_turns_errors_into_rows(spark):
    def work(row):
        if row["n"] == 2:
            raise ValueError("no")
        return {"m": row["n"] * 10}

    df = spark.createDataFrame([(1,), (2,)], "n int")
    got = {r.n: (r.result, r.error) for r in hooks.process_tasks(df, work, "m int").collect()}
    assert got[1][0].m == 10 and got[1][1] is None
    assert got[2] == (None, "ValueError: no")


def test_sessions_end_alike_in_one_and_five_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(u, start + dt.timedelta(hours=h)) for u, hours in {
        1: [0, 5, 40, 45, 100], 2: [1, 70, 71], 3: [2, 20, 38, 56, 74, 92, 110], None: [3, 119]}.items() for h in hours]
    folder = tmp_path / "events"
    folder.mkdir()
    for n in range(5):
        part = [r for r in rows if 24 * n <= (r[1] - start).total_seconds() / 3600 < 24 * (n + 1)]
        spark.createDataFrame(part, "session_id bigint, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        (file,) = (tmp_path / f"part{n}").glob("*.parquet")
        file.rename(folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + 60 * n,) * 2)

    def run(files):
        seen, progress = [], []
        stream = st.file_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, max_files=files)
        q = (st.session_windows(stream, "20 hours", "1 hour").writeStream.outputMode("append")
             .option("checkpointLocation", scratch_path(spark, "mark")).trigger(availableNow=True)
             .foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).start())
        q.awaitTermination(120)
        progress = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
        return sorted(seen, key=str), progress

    hour = lambda h: start + dt.timedelta(hours=h)
    # the last event is at 119, so sessions whose last event is at 98 or before have ended
    expected = [(1, hour(0), hour(5), 2), (1, hour(40), hour(45), 2), (2, hour(1), hour(1), 1), (2, hour(70), hour(71), 2),
                (None, hour(3), hour(3), 1)]
    one, _ = run(None)
    five, held = run(1)
    assert one == five == sorted(expected, key=str)
    assert held[-1] == 3 and max(held) <= 5
