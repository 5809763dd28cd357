"""Work of the stored log's jobs: rows to be numbered move once, large chats are spread, nothing is made twice."""

import re

import pytest
from pyspark.sql import functions as F

from recipeflow.operators import chatlog as C
from recipeflow.plans import catalog_log as L
from recipeflow.plans import jobs as J
from recipeflow.plans.stubs import StubGenerator, StubTranslator
from recipeflow.session import ship_package, work_dir
from recipeflow.sources.message_log import MessageLog


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def titles(spark, n=6):
    rows = [(i // 2, 5 if i % 3 else None, f"Dish {i % 4}", ("en", "fr")[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "title_id int, chat_id bigint, title string, display_lang string")


def test_rows_that_are_numbered_move_once(spark):
    log = spark.createDataFrame([(1, 3), (None, 0)], "chat_id bigint, seq bigint")
    new = spark.createDataFrame([(c, k, "x") for c in (1, 2, None) for k in (8, 9)], "chat_id bigint, k int, title string")
    p = plan(C.exchange_positions(log, new, "k", ("title",)))
    # one for the rows, one for what the log's chats end with, which is a row a chat
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2 and "Join" not in p and len(re.findall(r"\bSort \[", p)) == 1


def test_large_chats_are_spread_and_numbered_alike(spark, monkeypatch):
    log = spark.createDataFrame([(1, 3), (None, 0), (4, None)], "chat_id bigint, seq bigint")
    keys = [None, *(i % 37 for i in range(60))]
    rows = [(c, k, f"t{i % 3}") for i, k in enumerate(keys) for c in (None, 1, 2)] + [(c, 1, "t") for c in (3, 4)]
    new = spark.createDataFrame(rows, "chat_id bigint, k int, title string")
    found = []
    ranged, by_range = [], C._numbered_by_range
    monkeypatch.setattr(C, "_numbered_by_range", lambda df, *a: (ranged.append({r["chat_id"] for r in df.collect()}), by_range(df, *a))[1])
    for most in (100_000, 20):
        monkeypatch.setattr(C, "ONE_TASK", most)
        got = C.exchange_positions(log, new, "k", ("title",))
        found.append(sorted(map(repr, got.select("chat_id", "k", "title", "seq_user", "seq_assistant").collect())))
    assert ranged == [{None, 1, 2}]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    other_type = new.withColumn("chat_id", F.col("chat_id").cast("int"))
    got = C.exchange_positions(log, other_type, "k", ("title",))
    assert got.schema["chat_id"].dataType == other_type.schema["chat_id"].dataType
    assert sorted(map(repr, got.select("chat_id", "k", "title", "seq_user", "seq_assistant").collect())) == found[0]


def test_returned_rows_are_the_stored_ones(spark):
    log = MessageLog(spark, work_dir(spark, "log"))
    for _ in range(2):
        out = J.recipe_job(titles(spark, 12).repartition(4), StubGenerator(), StubTranslator(), log=log, run="r", at="2025-09-09 00:00:00")
    # rows of one chat and key have their places by title and language
    assert sorted(map(repr, out.select("chat_id", "seq", "role", "content").collect())) == sorted(map(repr, log.read().select("chat_id", "seq", "role", "content").collect()))


def test_rows_are_made_once_when_a_run_is_repeated(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return str(i)

    log = MessageLog(spark, work_dir(spark, "log"))
    rows = spark.range(10, numPartitions=1).select(
        F.col("id").alias("chat_id"), F.lit(0).alias("seq"), F.lit("user").alias("role"), F.lit("x").alias("content"),
        F.expr("timestamp'2025-09-01 00:00:00' + make_dt_interval(id)").alias("ts"),
    ).where(text("chat_id") != "x")
    log.write(rows, "r")
    log.write(rows.where("chat_id < 4"), "r")
    log.write(rows.where("chat_id > 4").drop("ts"), "s", at="2025-09-09 00:00:00")
    log.write(rows.where("chat_id > 4").drop("ts"), "s", at="2025-09-10 00:00:00")
    assert sorted((r["run"], str(r["day"]), r["n"]) for r in log.read().groupBy("run", "day").agg(F.count("*").alias("n")).collect()) == [
        ("r", f"2025-09-0{d}", 1) for d in (1, 2, 3, 4)
    ] + [("s", "2025-09-10", 5)]
    assert made.value == 10 + 4 + 5 + 5


def test_both_runs_of_logged_jobs_read_titles_that_were_made_once(spark, monkeypatch):
    from conftest import SF_SMALL

    given, job = [], J.recipe_job
    monkeypatch.setattr(J, "recipe_job", lambda t, *a, **k: (given.append(plan(t)), job(t, *a, **k))[1])
    L.q_logged_jobs(spark, SF_SMALL)
    assert len(given) == 2 and not any(re.search("Aggregate|Join|Exchange|Generate", p) for p in given)


def test_only_the_newest_payloads_move(spark, monkeypatch):
    meta = "struct<payload:struct<recipe_detail:struct<title:string>>>"
    rows = [(c, s, ((f"{c}-{s}",),) if s < 3 else None) for c in (1, 2, None) for s in range(5)]
    log = spark.createDataFrame([(c, s, (m,) if m else None) for c, s, m in rows], f"chat_id int, seq long, meta {meta}")
    heads = C.newest_positions(log)
    assert {tuple(r) for r in heads.collect()} == {(c, 4, 2, True) for c in (1, 2, None)}
    passed, join = [], C.join_null_safe
    monkeypatch.setattr(C, "join_null_safe", lambda left, *a, **k: (passed.append(left.count()), join(left, *a, **k))[1])
    got = {r["chat_id"]: r["recipe_detail"]["title"] for r in C.latest_payload(log, newest=heads).collect()}
    assert got == {1: "1-2", 2: "2-2", None: "None-2"}
    assert passed == [3]  # of nine
