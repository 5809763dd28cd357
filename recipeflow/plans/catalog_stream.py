"""Registered queries: streaming forms (rows 59-61), checked after drain.

Each query stages Spark-derived input files in the shared checkpoint folder,
drains a Structured Streaming query over them (``availableNow``) and returns
the drained result, which must equal the batch operator's result (the oracle
is the batch SQL).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeflow.plans.catalog_chat import filter_events, q_flatten_messages, q_latest_payload, q_upsert_filters
from recipeflow.plans.oracle_views import with_views
from recipeflow.plans.registry import ORACLE, register
from recipeflow.session import work_dir
from recipeflow.sources import views as V
from recipeflow.sources.chats import chat_store
from recipeflow.streaming import chat_stream as S

assert q_flatten_messages and q_latest_payload and q_upsert_filters


@register("stream_messages", ORACLE["flatten_messages"], row="59")
def q_stream_messages(spark, sf):
    sink = S.stream_messages(spark, chat_store(spark, sf), lines=True)
    m = spark.read.parquet(sink)
    return m.select(
        "chat_id", "seq", "role", "content", "ts_raw", F.col("meta.payload.recipe_detail.title").alias("recipe_title")
    )


@register(
    "stream_distinct_messages",
    with_views("SELECT chat_id, seq, role, content, ts_raw, CASE WHEN has_recipe THEN r_title END AS recipe_title FROM v1", "v1"),
    row="59",
)
def q_stream_distinct_messages(spark, sf):
    """Every message is sent twice, the second time in files of their own, oldest chats last."""
    msgs = V.v1_messages(spark, sf)
    path = work_dir(spark, "sent-messages")
    S.stage_files(msgs, path + "/first", n_files=8, order="chat_id")
    S.stage_files(msgs, path + "/again", n_files=5, order="seq")
    log = spark.read.schema(msgs.schema).parquet(S.stream_distinct_messages(spark, path + "/*", msgs.schema, max_files=4))
    return log.select(
        "chat_id", "seq", "role", "content", "ts_raw", F.col("meta.payload.recipe_detail.title").alias("recipe_title")
    )


@register("stream_latest_payload", ORACLE["latest_payload"], row="60")
def q_stream_latest_payload(spark, sf):
    msgs = V.v1_messages(spark, sf)
    path = S.stage_files(msgs, work_dir(spark, "message-events"), n_files=8, order="chat_id")
    lp = S.stream_latest_payload(spark, path, msgs.schema, max_files=2, most_open=2)
    d = F.col("recipe_detail")
    return lp.select(
        "chat_id",
        "seq",
        d["title"].alias("title"),
        F.size(d["ingredients"]).cast("bigint").alias("n_ing"),
        F.size(d["steps"]).cast("bigint").alias("n_steps"),
        F.array_join(d["ingredients"], ",").alias("ingredients"),
    )


@register("stream_latest_filters", ORACLE["upsert_filters"], row="61")
def q_stream_latest_filters(spark, sf):
    fe = filter_events(spark, sf)
    path = S.stage_files(fe, work_dir(spark, "filter-events"), n_files=8, order="seq")
    latest = S.stream_latest_filters(spark, path, fe.schema, max_files=2, most_open=2)
    chats = V.v1_messages(spark, sf).select("chat_id").distinct()
    u = chats.join(latest, "chat_id", "left").select(
        "chat_id", F.coalesce("health_filters", F.array().cast("array<string>")).alias("health_filters")
    )
    return u.select(
        "chat_id",
        F.size("health_filters").cast("bigint").alias("n_tags"),
        F.array_join("health_filters", ",").alias("tags"),
    )
