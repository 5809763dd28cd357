"""Chat log, model map and translation operators on small literal frames and
on the fixture chat folder (reference layout)."""

import os

from pyspark.sql import functions as F

from recipeflow.operators import chatlog as C
from recipeflow.operators import modelmap as M
from recipeflow.operators import translate as T
from recipeflow.plans import jobs as J
from recipeflow.plans.stubs import CountingGenerator, StubTranslator
from recipeflow.session import work_dir
from recipeflow.sources.chats import write_chat_lines

FIXTURE_CHATS = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "fixtures", "chats")


def test_scan_fixture_folder(spark):
    chats = C.scan_chats(spark, FIXTURE_CHATS)
    rows = {r.chat_id: r for r in chats.collect()}
    assert set(rows) == {"a", "b", "c", "d", "e"}  # _active.json skipped
    assert rows["a"].title == "Ingredients" and rows["a"].schema_version == 1
    assert rows["c"].corrupt and rows["c"].title == "c" and rows["c"].messages is None
    assert rows["d"].title == "d"  # empty title -> stem
    assert rows["e"].messages is None
    assert [r.chat_id for r in C.list_chats(chats).collect()] == ["a", "b", "c", "d", "e"]


def test_flatten_unify_latest(spark):
    chats = C.scan_chats(spark, FIXTURE_CHATS)
    msgs = C.flatten_messages(chats)
    assert msgs.where("chat_id = 'b'").count() == 4
    u = C.unify_message_schema(msgs, chats)
    ts = {(r.chat_id, r.seq): r.ts for r in u.collect()}
    assert ts[("a", 0)] is not None and ts[("b", 1)] is not None
    latest = C.latest_payload(msgs)
    lb = latest.where("chat_id = 'b'").first()
    assert lb.seq == 3 and lb.recipe_detail.title == "Air"  # empty lists not skipped
    ok, rejected = C.eligible_for_check(latest)
    assert [r.chat_id for r in rejected.collect()] == ["b"]
    assert ok.count() == 0


def test_history_and_append(spark):
    msgs = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], "chat_id bigint, seq bigint, content string")
    h = {(r.chat_id, r.seq): r.rank for r in C.history(msgs).collect()}
    assert h[(1, 2)] == 1 and h[(1, 0)] == 3 and h[(2, 0)] == 1
    new = spark.createDataFrame([(1, 10, "d"), (1, 11, "e"), (3, 5, "z")], "chat_id bigint, event_order bigint, content string")
    out = {(r.chat_id, r.content): r.seq for r in C.append_messages(msgs, new).collect()}
    assert out == {(1, "d"): 3, (1, "e"): 4, (3, "z"): 0}


def test_resolve_pointer(spark):
    chats = spark.createDataFrame([(1,), (5,)], "chat_id bigint")
    ptr = spark.createDataFrame([(10, 1), (11, 99), (12, None)], "user_id bigint, chat_id bigint")
    out = {r.user_id: (r.active_chat_id, r.status) for r in C.resolve_pointer(ptr, chats).collect()}
    assert out == {10: (1, "ok"), 11: (None, "dangling"), 12: (5, "latest")}


def test_new_chat_rows_collisions(spark):
    df = spark.createDataFrame(
        [("2025-01-02 03:04:05", "My dish"), ("2025-01-02 03:04:05", "My dish"), ("2025-01-02 03:04:06", "")],
        "ts string, title string",
    ).withColumn("ts", F.to_timestamp("ts"))
    out = sorted((r.chat_id, r.n_same_id) for r in C.new_chat_rows(df).collect())
    assert out == [
        ("20250102T030405_My_dish", 2), ("20250102T030405_My_dish", 2), ("20250102T030406_Ingredients", 1)
    ]


def test_map_model_dedup_and_errors(spark):
    acc = spark.sparkContext.accumulator(0)
    prompts = ["same prompt"] * 50 + ["other", "x" * 10]
    req = spark.createDataFrame(
        [(i, "detail", "sys", p) for i, p in enumerate(prompts)], "request_id bigint, task string, system string, prompt string"
    )
    out = M.map_model(req, CountingGenerator(acc)).collect()
    assert len(out) == 52
    assert acc.value == 3  # one call per distinct request
    by = {r.request_id: r for r in out}
    assert by[51].error == "boom" and by[51].text is None
    assert by[0].text.startswith("Ingredients:")


def test_translate_gate_memory_and_array(spark):
    df = spark.createDataFrame(
        [(1, "x", "en", "auto"), (2, "x", "en", "el"), (3, "soup", "en", "fr"), (4, "soup", "en", "te"), (5, "rice", "en", "fr")],
        "id bigint, text string, src string, tgt string",
    )
    r = {row.id: (row.translated, row.translated_called) for row in T.translate(df, "text", "src", "tgt", StubTranslator()).collect()}
    assert r[1] == ("x", False) and r[2] == ("x", False)  # not translatable: no model call
    assert r[3] == ("<fr>soup", True)
    assert r[4] == (None, True)  # te passes the gate, the model fails
    arr = spark.createDataFrame([(1, ["a", " b "], "fr"), (2, ["a", " b "], "te"), (3, ["a"], "auto")], "id bigint, items array<string>, tgt string")
    out = {row.id: row.translated for row in T.translate_array(arr, "id", "items", F.lit("en"), "tgt", StubTranslator()).collect()}
    assert out[1] == ["<fr>a", "<fr>b"]
    assert out[2] == ["a", " b "]  # failed items keep their original text
    assert out[3] == ["a"]


def test_translation_memory_is_used(spark):
    memory_src = spark.createDataFrame([("rice", "en", "fr", "riz!")], "text string, src string, tgt string, translated string")
    memory = memory_src.select(T.mt_key(F.col("text"), F.col("src"), F.col("tgt")).alias("mt_key"), "text", "src", "tgt", "translated")
    df = spark.createDataFrame([(1, "rice", "fr"), (2, "bread", "fr")], "id bigint, text string, tgt string")
    out = {r.id: r.translated for r in T.translate(df, "text", F.lit("en"), "tgt", StubTranslator(), memory).collect()}
    assert out == {1: "riz!", 2: "<fr>bread"}


def test_row_number_within_hot_key(spark):
    rows = [(7, i) for i in range(3000)] + [(k, i) for k in range(20) if k != 7 for i in range(5)]
    df = spark.createDataFrame(rows, "chat_id bigint, event_order bigint")
    out = C.row_number_within(df, "chat_id", "event_order", partitions=8)
    got = {(r.chat_id, r.event_order): r.rn for r in out.collect()}
    assert len(got) == len(rows)
    assert all(got[(7, i)] == i + 1 for i in range(3000))
    assert all(got[(k, i)] == i + 1 for k in range(20) if k != 7 for i in range(5))
    # the hot chat really is spread over several partitions
    pieces = df.repartitionByRange(8, "chat_id", "event_order").where("chat_id = 7").select(
        F.spark_partition_id().alias("p")).distinct().count()
    assert pieces > 1


def test_chat_lines_layout_matches_partitioned_layout(spark):
    from conftest import SF_SMALL
    from recipeflow.sources.chats import chat_store, derived_chat_documents, write_chat_store

    lines_path = chat_store(spark, SF_SMALL)
    folders = write_chat_store(derived_chat_documents(spark, SF_SMALL), work_dir(spark, "chat-folders"))
    a = C.scan_chat_lines(spark, lines_path).where("NOT corrupt")
    b = C.scan_chats(spark, folders, glob=None).where("NOT corrupt")
    cols = ["chat_id", "title", "schema_version", "created_at"]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())
    ma = C.flatten_messages(a).select("chat_id", "seq", "role", "content", "ts_raw")
    mb = C.flatten_messages(b).select("chat_id", "seq", "role", "content", "ts_raw")
    assert ma.exceptAll(mb).count() == 0 and mb.exceptAll(ma).count() == 0
    # (Spark rejects queries that read only the corrupt-record column, so select data columns too)
    bad_a = C.scan_chat_lines(spark, lines_path).where("corrupt").select("chat_id", "title").collect()
    bad_b = C.scan_chats(spark, folders, glob=None).where("corrupt").select("chat_id", "title").collect()
    assert sorted(bad_a) == sorted(bad_b) and bad_a


def test_append_keeps_every_row_and_column(spark):
    # a third of the rows in one chat, whole texts kept, several input files
    new = spark.range(60_000, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("chat_id"),
        F.col("id").alias("event_order"),
        F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("content"),
    )
    log = spark.createDataFrame([(7, 4)], "chat_id bigint, seq bigint")
    out = C.append_messages(log, new)
    by_chat = out.groupBy("chat_id").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.countDistinct("seq").alias("d"))
    assert out.count() == 60_000 and out.select("content").distinct().count() == 60_000
    assert by_chat.where("n != d or hi - lo + 1 != n or lo != if(chat_id = 7, 5, 0)").count() == 0
    late = out.where("chat_id = 7").orderBy("seq").select("event_order").collect()
    assert [r[0] for r in late] == sorted(r[0] for r in late)


def test_second_job_run_calls_no_model(spark):
    lists = spark.createDataFrame([(1, ["eggs", " ", None, "rice"]), (2, []), (3, None), (4, ["eggs", "rice"])], "list_id int, items array<string>")
    path, acc = work_dir(spark, "memory"), spark.sparkContext.accumulator(0)
    first = {r.list_id: r.text for r in J.nutrition_job(lists, CountingGenerator(acc), memory_path=path).collect()}
    calls = acc.value
    again = {r.list_id: r.text for r in J.nutrition_job(lists, CountingGenerator(acc), memory_path=path).collect()}
    assert again == first and first[1] is not None and first[1] == first[4] and first[2] == first[3]
    assert calls > 0 and acc.value == calls


def test_null_prompt_and_repeated_memory(spark):
    req = spark.createDataFrame([(1, "detail", "s", None), (2, "detail", "s", ""), (3, "detail", "s", "p")], "id int, task string, system string, prompt string")
    key = M.request_key("task", "system", "prompt")
    old = req.where("id = 3").select(key.alias("req_key"), F.lit("old").alias("text"))
    acc = spark.sparkContext.accumulator(0)
    got = [(r.id, r.text, r.error) for r in M.map_model(req, CountingGenerator(acc), memory=old.unionByName(old)).collect()]
    assert sorted(got) == [(1, None, None), (2, None, "boom"), (3, "old", None)] and acc.value == 1


def test_chat_lines_keep_ids_and_quotes(spark):
    docs = spark.createDataFrame([('20250906T083543_A "b"', '{"title": "x\\ny"}'), ("007", "{bad"), ("e", "")], "chat_id string, value string")
    got = {r.chat_id: r for r in C.scan_chat_lines(spark, write_chat_lines(docs, work_dir(spark, "lines"))).collect()}
    assert got['20250906T083543_A "b"'].title == "x\ny" and not got['20250906T083543_A "b"'].corrupt
    assert got["007"].corrupt and got["007"].title == "007" and got["e"].corrupt
