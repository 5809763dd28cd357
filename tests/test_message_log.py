"""The stored message log: repeatable runs, pruned reads, rows without a chat."""

import datetime

import pytest
from pyspark.sql import functions as F

from recipeflow.operators import chatlog as C
from recipeflow.operators import translate as T
from recipeflow.plans import jobs as J
from recipeflow.plans.stubs import StubGenerator, StubTranslator
from recipeflow.session import ship_package, work_dir
from recipeflow.sources.chats import write_chat_store
from recipeflow.sources.message_log import MessageLog

ROWS = "chat_id bigint, seq bigint, ts timestamp, role string, content string, payload_json string"


def at(day, hour=8):
    return datetime.datetime(2025, 9, day, hour)


def rows_of(df):
    return sorted(((r["chat_id"], r["seq"], str(r["day"]), r["run"], r["content"]) for r in df.collect()), key=repr)


@pytest.fixture
def log(spark):
    ship_package(spark)
    return MessageLog(spark, work_dir(spark, "test-log"))


def test_a_repeated_run_leaves_one_copy(spark, log):
    first = spark.createDataFrame([(1, 0, at(1), "user", "a", None), (None, 0, at(2), "user", "no chat", None)], ROWS)
    again = spark.createDataFrame([(1, 0, at(1), "user", "b", None), (2, 0, at(3), "user", "c", None)], ROWS)
    other = spark.createDataFrame([(1, 1, at(2), "user", "kept", None)], ROWS)
    assert log.read().count() == 0
    log.write(first, "007")
    log.write(other, "other")
    log.write(first, "007")
    assert rows_of(log.read()) == [(1, 0, "2025-09-01", "007", "a"), (1, 1, "2025-09-02", "other", "kept"), (None, 0, "2025-09-02", "007", "no chat")]
    log.write(again, "007")  # it has no row of the second any more
    assert rows_of(log.read()) == [(1, 0, "2025-09-01", "007", "b"), (1, 1, "2025-09-02", "other", "kept"), (2, 0, "2025-09-03", "007", "c")]
    assert rows_of(log.read(without_run="007")) == [(1, 1, "2025-09-02", "other", "kept")]


def test_days_are_pruned(spark, log):
    log.write(spark.createDataFrame([(1, i, at(1 + i), "user", str(i), None) for i in range(6)], ROWS), "r")
    df = log.read(since=at(3).date(), until=at(4).date())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert [r[2] for r in rows_of(df)] == ["2025-09-03", "2025-09-04"]


def test_times_payloads_and_names(spark, log):
    payload = '{"payload":{"recipe_detail":{"title":"T","ingredients":["x"],"steps":[]}}}'
    log.write(spark.createDataFrame([(1, 0, None, "assistant", "a", payload)], ROWS), "r", at="2025-09-09 01:02:03")
    (row,) = log.read().collect()
    assert str(row["ts"]) == "2025-09-09 01:02:03" and row["meta"]["payload"]["recipe_detail"]["title"] == "T"
    assert C.latest_payload(log.read()).first()["recipe_detail"]["ingredients"] == ["x"]
    with pytest.raises(ValueError, match="name"):
        log.write(log.read(), "a/b")


def test_a_job_run_twice_is_stored_once(spark, log):
    titles = spark.createDataFrame(
        [(1, 5, "Soup", "en"), (2, 5, "Pie", "fr"), (3, None, "Stew", "en")], "title_id bigint, chat_id bigint, title string, display_lang string"
    )
    stored = []
    for _ in range(2):
        out = J.recipe_job(titles, StubGenerator(), StubTranslator(), log=log, run="recipes", at="2025-09-09 00:00:00")
        assert out.count() == 6
        stored.append(rows_of(log.read()))
    assert stored[0] == stored[1] and len(stored[0]) == 6
    assert [r[:2] for r in stored[0]] == [(5, 0), (5, 1), (5, 2), (5, 3), (None, 0), (None, 1)]
    chats = log.read().select("chat_id").distinct()
    filters = chats.select("chat_id", F.array(F.lit("vegan")).alias("health_filters"))
    checks, _ = J.health_job(log, filters, chats.select("chat_id", F.lit("en").alias("display_lang")), StubGenerator(), StubTranslator(), run="checks")
    assert {r["chat_id"] for r in checks.collect()} == {5, None}  # it reads what the recipes' run stored


def test_ids_of_folders_stay_text(spark):
    docs = spark.createDataFrame([("007", '{"title":"a","messages":[]}'), ("7", "{bad"), ("2025-09-06", '{"title":""}')], "chat_id string, value string")
    c = C.scan_chats(spark, write_chat_store(docs, work_dir(spark, "folders")), glob=None)
    assert {(r["chat_id"], r["title"], r["corrupt"]) for r in c.collect()} == {("007", "a", False), ("7", "7", True), ("2025-09-06", "2025-09-06", False)}


def test_rows_without_a_chat_are_kept(spark):
    ship_package(spark)
    msgs = spark.createDataFrame([(None, 0), (None, 1), (1, 0)], "chat_id int, seq long")
    new = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "chat_id int, event_order int")
    got = {(r["chat_id"], r["event_order"], r["seq"]) for r in C.append_messages(msgs, new).collect()}
    assert got == {(None, 1, 2), (None, 2, 3), (1, 3, 1), (2, 4, 0)}
    for dense in (True, False):
        assert {(r["chat_id"], r["seq"], r["rank"]) for r in C.history(msgs, dense=dense).collect()} == {(None, 0, 2), (None, 1, 1), (1, 0, 1)}
    asked = spark.createDataFrame([(None,)], "chat_id int")
    assert C.history(msgs, asked).count() == 2
    requests = spark.createDataFrame([(None, "x"), (None, None), (at(1), "x")], "ts timestamp, title string")
    assert sorted(r["n_same_id"] for r in C.new_chat_rows(requests).collect()) == [1, 2, 2]


def test_repeated_keys_keep_their_own_items(spark):
    ship_package(spark)
    df = spark.createDataFrame([(1, ["a"]), (1, ["b", "c"]), (None, ["d"]), (2, None)], "k int, items array<string>")
    got = T.translate_array(df, "k", "items", F.lit("en"), F.lit("fr"), StubTranslator(), out="loc")
    assert got.columns == ["k", "items", "loc"]
    assert sorted((r["loc"] for r in got.collect()), key=repr) == [None, ["<fr>a"], ["<fr>b", "<fr>c"], ["<fr>d"]]
