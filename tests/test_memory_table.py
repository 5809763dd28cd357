"""The bucketed memory: lookups, repeated appends, compaction, plans, and the jobs' use of it."""

import random

import pytest
from pyspark.sql import functions as F

from recipeflow.operators import modelmap as M
from recipeflow.operators import translate as T
from recipeflow.plans.stubs import CountingGenerator, StubTranslator
from recipeflow.session import ship_package, work_dir
from recipeflow.sources.memory_table import MOST_SLOTS, MemoryTable

ROWS = "k string, v string"


@pytest.fixture
def path(spark):
    ship_package(spark)
    return work_dir(spark, "test-memory")


def looked_up(table, keys):
    asked = table.spark.createDataFrame([(k,) for k in keys], "k string")
    return {r["k"]: r["v"] for r in table.lookup(asked).collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("slots", [1, 7, MOST_SLOTS])  # a filter that is full rules nothing out and loses nothing
def test_lookup_against_a_dict(spark, path, slots):
    rng, table, held = random.Random(slots), MemoryTable(spark, path, "k", "v", buckets=4, slots=slots), {}
    keys = [f"key {i} é" for i in range(120)] + [""]
    assert looked_up(table, keys) == {}
    for _ in range(3):
        rows = [(k, str(rng.randrange(100))) for k in rng.sample(keys, 40)]
        table.append(spark.createDataFrame(rows + [(None, "no key")], ROWS))
        for k, v in rows:
            held[k] = max(v, held.get(k, v))
        assert looked_up(table, keys + ["other"]) == held
        table.compact()
        assert looked_up(table, keys + ["other"]) == held
        assert table.read().count() == len(held)


def test_only_the_keys_move(spark, path):
    table = MemoryTable(spark, path, "k", "v", buckets=4)
    table.append(spark.createDataFrame([(str(i), "x") for i in range(2000)], ROWS))
    found = table.lookup(spark.createDataFrame([("1",), ("no",)], "k string"))
    plan = plan_of(found)
    assert "Bucketed: true" in plan and plan.count("REPARTITION_BY_NUM") == 1
    at_scan = plan[plan.index("ShuffledHashJoin") : plan.index("Bucketed: true")]
    assert "Exchange" not in at_scan  # between the stored rows and the join
    assert found.count() == 1
    strangers = spark.range(100_000).select(F.concat(F.lit("s"), F.col("id")).alias("k"))
    assert table.maybe_held(strangers).count() < 1000


def test_compaction_changes_buckets_and_slots_and_a_new_object_reads_them(spark, path):
    rows = spark.createDataFrame([(str(i), str(i)) for i in range(50)], ROWS)
    first = MemoryTable(spark, path, "k", "v", buckets=4, slots=16)
    first.append(rows)
    first.append(rows)
    assert first.read().count() == 100
    other = MemoryTable(spark, path, "k", "v", buckets=2, slots=64)
    assert len(looked_up(other, [str(i) for i in range(60)])) == 50  # read as it was written
    other.compact()
    assert [tuple(v) for v in other._versions()] == [(0, 4, 16), (1, 2, 64)]
    other.compact()
    assert [tuple(v) for v in first._versions()] == [(1, 2, 64), (2, 2, 64)]
    assert first.read().count() == 50 and len(looked_up(first, [str(i) for i in range(60)])) == 50


def test_an_unfinished_compaction_is_ignored_and_done_again(spark, path):
    table = MemoryTable(spark, path, "k", "v", buckets=2, slots=8)
    table.append(spark.createDataFrame([("a", "1"), ("b", "2")], ROWS))
    spark.createDataFrame([("a", "wrong")], ROWS).write.parquet(f"{path}/v1-b2-s8/rows")
    assert looked_up(table, ["a", "b"]) == {"a": "1", "b": "2"}
    table.compact()
    assert looked_up(table, ["a", "b"]) == {"a": "1", "b": "2"} and table.read().count() == 2


def test_a_second_run_moves_only_misses(spark, path):
    acc = spark.sparkContext.accumulator(0)
    cols = "id int, task string, system string, prompt string"
    one = spark.createDataFrame([(i, "health", "s", f"prompt {i % 30}") for i in range(90)] + [(90, "health", "s", None)], cols)
    more = spark.createDataFrame([(i, "health", "s", f"prompt {i % 35}") for i in range(90)], cols)

    def run(df):
        return {r.id: (r.text, r.error) for r in M.map_model(df, CountingGenerator(acc), memory_path=path).collect()}

    first, calls = run(one), acc.value
    assert run(one) == first and first[90] == (None, None)
    failed = {e for e in first.values() if e[1] is not None}
    again = acc.value - calls  # only failures are asked again
    assert calls == 30 and again == (20 if failed else 0)  # "prompt 10" to "prompt 29" have 9 characters, none fails
    before = acc.value
    assert {k: v for k, v in run(more).items()} == {r.id: (r.text, r.error) for r in M.map_model(more, CountingGenerator(acc)).collect()}
    assert acc.value - before == 5 + 35


def test_translations_are_stored_once(spark, path):
    df = spark.createDataFrame([(1, "rice", "fr"), (2, "rice", "fr"), (3, "rice", "te"), (4, None, "fr"), (5, "", "fr")], "id int, text string, tgt string")

    def run():
        return {r.id: r.translated for r in T.translate(df, "text", F.lit("en"), "tgt", StubTranslator(), memory_path=path).collect()}

    first = run()
    assert run() == first and first[1] == first[2] == "<fr>rice" and first[3] is None
    table = MemoryTable(spark, path, "mt_key", "translated")
    assert table.read().count() == table.read().select("mt_key").distinct().count() == 2
