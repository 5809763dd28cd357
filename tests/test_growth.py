"""Work and moved rows of the jobs: texts are made, moved and looked up no more often than they must be."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from recipeflow.functions import parse as P
from recipeflow.operators import chatlog as C
from recipeflow.operators import modelmap as M
from recipeflow.operators import translate as T
from recipeflow.plans import jobs as J
from recipeflow.plans.stubs import CountingGenerator, StubGenerator, StubTranslator
from recipeflow.session import ship_package, work_dir
from recipeflow.sources.chats import write_chat_store
from recipeflow.sources.message_log import MessageLog


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def numbered_columns(monkeypatch):
    seen, old = [], C.row_number_within
    monkeypatch.setattr(C, "row_number_within", lambda df, *a, **k: (seen.append(set(df.columns)), old(df, *a, **k))[1])
    return seen


def empty_log(spark):
    return spark.createDataFrame([(5, 3)], "chat_id bigint, seq bigint")


TITLES = [(2, 5, " Soup ", "en"), (1, 5, "Soup", "EN"), (1, 5, "Pie", "fr"), (None, None, None, "fr"), (3, 5, "Soup", "te"), (1, 5, "Pie", "fr")]


def test_nothing_is_asked_when_the_memory_holds_all(spark, monkeypatch):
    path = work_dir(spark, "memory")
    df = spark.createDataFrame([(1, "a", "fr"), (2, "a", "fr"), (3, "b", "te"), (4, None, "fr"), (5, "c", "xx")], "id int, text string, tgt string")
    go = lambda d: {r["id"]: (r["translated"], r["translated_error"] is not None, r["translated_called"]) for r in T.translate(d, "text", F.lit("en"), "tgt", StubTranslator(), memory_path=path).collect()}
    want = {1: ("<fr>a", False, True), 2: ("<fr>a", False, True), 3: (None, True, True), 4: ("<fr>", False, True), 5: ("c", False, False)}
    assert go(df) == want
    asked, old = [], T._answer
    monkeypatch.setattr(T, "_answer", lambda uniq, *a: (asked.extend(r["text"] for r in uniq.collect()), old(uniq, *a))[1])
    assert go(df) == want and asked == ["b"]  # errors are not kept
    asked.clear()
    monkeypatch.setattr(T, "_answer", lambda *a: pytest.fail("everything is held"))
    assert set(go(df.where("id <> 3"))) == {1, 2, 4, 5}


def test_prompts_move_once_and_a_list_is_cut_once(spark, monkeypatch):
    plans, old = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, *a: (plans.append(plan(df)), old(df, *a))[1])
    acc = spark.sparkContext.accumulator(0)
    lists = spark.createDataFrame([(1, "egg, milk"), (2, "egg,milk"), (3, " , "), (4, None)], "list_id int, items string")
    out = {r["list_id"]: r["text"] for r in J.nutrition_job(lists, CountingGenerator(acc)).collect()}
    assert acc.value == 1 and out[1] == out[2] and out[3] == out[4] == "No ingredients provided."
    (asked,) = [p for p in plans if "MapInPandas" in p]
    assert len(re.findall("Exchange (hash|RoundRobin)", asked)) == 1
    assert spark.conf.get(M.COALESCE, "true") == "true"
    answers = spark.createDataFrame([("Ingredients:\n- a\nSteps:\n1. b",)], "text string")
    recipe = P.with_recipe(answers, "text")
    assert plan(recipe).count("(?=(?i:") == 1
    assert [list(x) for x in recipe.first()["recipe"]] == [["a"], ["b"]]


def test_titles_are_cut_once(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, t string").select("k", F.split("t", ",").alias("titles"))
    out = C.explode_titles(df, "k")
    assert plan(out).count("split(") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 1, "a"), (1, 2, "b")]


def test_recipe_job_numbers_titles_and_makes_a_recipe_once(spark, monkeypatch):
    seen = numbered_columns(monkeypatch)
    parsed, old = [], P.with_recipe
    monkeypatch.setattr(P, "with_recipe", lambda df, *a, **k: (parsed.append(df.count()), old(df, *a, **k))[1])
    titles = spark.createDataFrame(TITLES, "title_id int, chat_id bigint, title string, display_lang string")
    rows = J.recipe_job(titles, StubGenerator(), StubTranslator(), log=empty_log(spark)).collect()
    assert seen and not any({"content", "payload_json"} & s for s in seen)
    assert parsed == [4]  # of six rows
    roles = [r["role"] for r in sorted((r for r in rows if r["chat_id"] == 5), key=lambda r: r["seq"])]
    assert roles == ["user"] * 3 + ["assistant"] * 3 + ["user", "assistant"] * 2  # rows of one key: the users' first
    assert sorted(r["seq"] for r in rows if r["chat_id"] == 5) == list(range(4, 14))
    assert sorted(r["seq"] for r in rows if r["chat_id"] is None) == [0, 1]
    assert all((r["payload_json"] is not None) == (r["role"] == "assistant") for r in rows)


def test_positions_are_those_of_two_appended_messages(spark):
    new = spark.createDataFrame([(c, k) for c in (None, 1, 2) for k in (None, 7, 7, 8, 9, 9, 9)], "chat_id int, k int")
    log = spark.createDataFrame([(1, 4), (None, 0)], "chat_id int, seq long")
    got = C.exchange_positions(log, new, "k")
    pairs = got.select("chat_id", "k", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("seq_user").alias("seq")), F.struct(F.lit(1).alias("turn"), F.col("seq_assistant").alias("seq")))).alias("m"))
    got = sorted(map(repr, pairs.select("chat_id", "k", "m.turn", "m.seq").collect()))
    two = new.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    want = C.append_messages(log, two.withColumn("_o", F.struct("k", "turn")), "_o").select("chat_id", "k", "turn", "seq")
    assert got == sorted(map(repr, want.collect()))


def test_suggest_job_numbers_no_texts(spark, monkeypatch):
    seen = numbered_columns(monkeypatch)
    queries = spark.createDataFrame([(1, 5, "soup", "fr"), (2, 5, " pie ", "en"), (3, None, None, "te")], "query_id int, chat_id bigint, raw string, display_lang string")
    rows = J.suggest_job(queries, StubGenerator(), StubTranslator(), log=empty_log(spark)).collect()
    assert seen and not any({"content", "raw"} & s for s in seen)
    users = {r["query_id"]: (r["seq"], r["content"]) for r in rows if r["role"] == "user"}
    assert users == {1: (4, "soup"), 2: (6, "pie"), 3: (0, "")}
    answers = {r["query_id"]: (r["seq"], r["content"]) for r in rows if r["role"] == "assistant"}
    assert {k: v[0] for k, v in answers.items()} == {1: 5, 2: 7, 3: 1} and all(v[1] for v in answers.values())


def test_messages_of_one_day_are_written_where_they_are(spark):
    log = MessageLog(spark, work_dir(spark, "log"))
    rows = spark.range(400).select(F.col("id").alias("chat_id"), F.lit(0).alias("seq"), F.lit("user").alias("role"), F.lit("x").alias("content"))
    for n in (3, 2):
        log.write(rows.repartition(n), "r", at="2025-09-09 00:00:00")
        assert len(glob.glob(f"{log.path.removeprefix('file:')}/day=2025-09-09/run=r/part-*")) == n
    log.write(rows.limit(0), "r", at="2025-09-09 00:00:00")
    assert not glob.glob(f"{log.path.removeprefix('file:')}/day=*/run=r")


def test_latest_payload_compares_positions_before_payloads(spark):
    meta = "struct<payload:struct<recipe_detail:struct<title:string>>>"
    rows = [(1, 0, (("a",),)), (1, 2, (("b",),)), (1, 3, None), (None, 1, (("c",),)), (2, None, (("d",),))]
    latest = C.latest_payload(spark.createDataFrame([(c, s, (m,) if m else None) for c, s, m in rows], f"chat_id int, seq long, meta {meta}"))
    assert "LeftSemi" in plan(latest)
    got = {r["chat_id"]: (r["seq"], r["recipe_detail"] and r["recipe_detail"]["title"]) for r in latest.collect()}
    assert got == {1: (2, "b"), None: (1, "c"), 2: (None, None)}


def test_a_store_of_folders_is_listed_once(spark):
    path = write_chat_store(spark.createDataFrame([("007", '{"title":"a","messages":[]}')], "chat_id string, value string"), work_dir(spark, "folders"))
    assert C.has_chat_folders(spark, path)
    assert not C.has_chat_folders(spark, f"{path}/chat_id=007") and not C.has_chat_folders(spark, f"{path}/nothing")
    assert [r["chat_id"] for r in C.scan_chats(spark, path, glob=None).collect()] == ["007"]
