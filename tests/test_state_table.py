"""Streams with a snapshot and deltas: last write wins over late, repeated and restarted batches."""

import random

import pytest
from pyspark.sql import functions as F

from recipeflow.session import work_dir
from recipeflow.streaming import chat_stream as S
from recipeflow.streaming.state_table import StateTable

ROWS = "chat_id string, seq bigint, v string, deleted boolean"


def brute(rows):
    newest = {}
    for chat, seq, v, deleted in rows:
        if chat not in newest or seq >= newest[chat][0]:
            newest[chat] = (seq, v, deleted)
    return {c: (s, v) for c, (s, v, d) in newest.items() if not d}


def state_of(table):
    return {r["chat_id"]: (r["seq"], r["v"]) for r in table.read().collect()}


@pytest.mark.parametrize("most_open,share", [(1, 0.5), (3, 100.0), (64, 0.5)])
def test_late_repeated_and_retried_batches(spark, most_open, share):
    rng, path = random.Random(most_open), work_dir(spark, "state")
    rows = [(rng.choice(["a", "b", "c", None]), i, f"v{i}", rng.random() < 0.3) for i in range(40)]
    rng.shuffle(rows)
    table, seen = None, []
    for batch in range(8):
        schema = spark.createDataFrame([], ROWS).drop("deleted").schema
        table = StateTable(spark, path, schema, "chat_id", "seq", share, most_open)  # a new object: a restart
        part = rows[batch * 5 : batch * 5 + 5] + rows[:2]
        for _ in range(1 + batch % 2):  # every other batch is retried
            table.merge(spark.createDataFrame(part, ROWS), batch)
        seen += part
        assert state_of(table) == brute(sorted(seen, key=lambda r: r[1]))
    upto, open_ = table._parts()
    assert len(open_) < most_open and len(table._done("snapshot")) <= 2
    table.fold()
    assert state_of(table) == brute(sorted(seen, key=lambda r: r[1])) and table._parts()[1] == []


def test_an_empty_state_and_an_empty_batch(spark):
    schema = spark.createDataFrame([], ROWS).drop("deleted").schema
    table = StateTable(spark, work_dir(spark, "state"), schema, "chat_id", "seq")
    assert state_of(table) == {}
    table.merge(spark.createDataFrame([], ROWS), 0)
    table.merge(spark.createDataFrame([("a", 1, None, None)], ROWS), 1)
    assert state_of(table) == {"a": (1, None)}


def test_filters_over_three_restarts(spark):
    cols = "chat_id string, seq bigint, tags array<string>, deleted boolean"
    events, sink, ckpt = work_dir(spark, "events"), work_dir(spark, "sink"), work_dir(spark, "ckpt")
    runs = [
        [("a", 1, ["x"], False), ("b", 5, ["y"], False), ("c", 1, ["z"], False)],
        [("a", 3, None, True), ("b", 2, ["late"], False)],
        [("a", 2, ["late"], False), ("c", 4, ["w"], None), ("c", 1, ["z"], False)],
        [("b", 6, [], False), ("a", 3, None, True)],
    ]
    want = [{"a": ["x"], "b": ["y"], "c": ["z"]}, {"b": ["y"], "c": ["z"]}, {"b": ["y"], "c": ["w"]}, {"b": [], "c": ["w"]}]
    schema = spark.createDataFrame([], cols).schema
    for rows, state in zip(runs, want):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(events)
        got = S.stream_latest_filters(spark, events, schema, sink, ckpt, max_files=1, timeout_s=120, most_open=2)
        assert {r["chat_id"]: r["health_filters"] for r in got.collect()} == state


def test_messages_sent_again_are_stored_once(spark):
    cols = "chat_id string, seq bigint, ts timestamp, content string"
    events, sink, ckpt = work_dir(spark, "events"), work_dir(spark, "sink"), work_dir(spark, "ckpt")
    rows = [("a", i, None, str(i)) for i in range(5)] + [(None, 0, None, "no chat"), ("b", 0, None, "b")]
    schema = spark.createDataFrame([], cols).schema
    for n in (3, 7, 7, 4):  # each run sends what went before again
        df = spark.createDataFrame(rows[:n], cols).withColumn("ts", F.expr(f"timestamp'2020-01-01' - make_dt_interval({n * 1000})"))
        df.coalesce(1).write.mode("append").parquet(events)
        S.stream_distinct_messages(spark, events, schema, sink=sink, checkpoint=ckpt, max_files=1, timeout_s=120)
    got = [(r["chat_id"], r["seq"], r["content"]) for r in spark.read.parquet(sink).collect()]
    assert sorted(got, key=repr) == sorted([(r[0], r[1], r[3]) for r in rows], key=repr)
