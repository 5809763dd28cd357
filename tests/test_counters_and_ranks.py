"""Counters taken in a job's own pass, mergeable sketches, and the first rows of each group."""

import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from recipeflow.functions.text import safe_lang_code
from recipeflow.operators.counters import counter_sketches, merge_counters, observed
from recipeflow.operators.ranked import top_n_rows
from recipeflow.plans import jobs as J
from recipeflow.plans.stubs import StubGenerator
from recipeflow.session import ship_package


def test_a_job_reports_its_counters(spark):
    ship_package(spark)
    lists = spark.createDataFrame([(1, "eggs, rice"), (2, ""), (3, None), (4, "milk")], "list_id int, items string")
    counters = Observation()
    rows = J.nutrition_job(lists, StubGenerator(), counters=counters).collect()
    texts = [r["text"] for r in rows]
    got = counters.get
    assert got["rows"] == 4 and got["nulls"] == texts.count(None) and got["distinct"] == len({t for t in texts if t is not None})
    assert got["chars"] == sum(len(t or "") for t in texts) and max(got["lengths"]) == max(len(t or "") for t in texts)
    empty = Observation()
    assert observed(lists.where("false"), "items", empty).collect() == [] and empty.get["rows"] == 0 == empty.get["chars"]


def test_sketches_merge_to_the_sketch_of_all(spark):
    rng = random.Random(1)
    rows = [("fr" if i % 3 else "en", i % 5, "x" * rng.randrange(1, 1000) + str(i % 4000)) for i in range(20000)] + [("en", 9, None), (None, 9, "y")]
    df = spark.createDataFrame(rows, "lang string, day int, text string")
    parts = counter_sketches(df, "text", "lang", part="day")
    merged = {r["lang"]: r for r in merge_counters(parts, "lang").collect()}
    exact = df.groupBy(safe_lang_code("lang").alias("l"), F.coalesce("text", F.lit("")).alias("t")).count().toPandas()
    for lang in ("en", "fr"):
        own = exact[exact["l"] == lang]
        lengths = sorted(n for t, c in zip(own["t"], own["count"]) for n in [len(t)] * c)
        r = merged[lang]
        assert r["n_requests"] == len(lengths) and r["n_chars"] == sum(lengths)
        assert abs(r["n_texts"] - len(own)) <= 0.03 * len(own)
        for share, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
            low, high = (lengths[min(len(lengths) - 1, int(len(lengths) * s))] for s in (max(0, share - 0.03), min(1, share + 0.03)))
            assert low <= r[name] <= high
    assert merge_counters(parts.where("false"), "lang").count() == 0


def test_first_rows_of_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(6)
    out = top_n_rows(df, ["k"], [F.col("v").desc(), F.col("id")], 7, "rank")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan and "Final" in plan
    want = {(k, v, i, n + 1) for key in ("hot", "a", "b", None) for n, (k, v, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:7])}
    assert {tuple(r) for r in out.collect()} == want
    assert top_n_rows(df, ["k"], [F.col("id")], 1).columns == ["k", "v", "id"]
