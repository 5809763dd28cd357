"""Chat documents derived from the driver tables, and the chat-store writer.

A chat store is a folder of JSON Lines, many chats per file, each line a
``chat_id`` and its document (:func:`write_chat_lines`); this is what the
registered queries read.  A small store may also be one file per chat under
``chat_id=<id>/`` (partition discovery restores ``chat_id``).
The reference layout - ``<stem>.json`` files in one folder - is read by the
same :func:`recipeflow.operators.chatlog.scan_chats`.

``derived_chat_documents`` builds documents of both shapes from V1:
even chats are in the current shape, odd chats in the older shape
(``schema_version``, ``created_at``, ``last_payload``); chats with
``chat_id % 6 = 0`` have an empty title and ``chat_id % 9 = 4`` are written
corrupt.  Grouping messages into a document is inherent in the data model
(one document per chat); the partial ``collect_list`` keeps the exchange to
the message rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recipeflow.session import work_dir
from recipeflow.sources.views import v1_messages

_STORES: dict[tuple[str, str], str] = {}


def derived_chat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = v1_messages(spark, sf_dir)
    msg = F.struct(
        F.col("seq"),
        F.col("role"),
        F.col("content"),
        F.col("ts_raw").alias("ts"),
        F.col("meta"),
    )
    g = m.groupBy("chat_id").agg(F.array_sort(F.collect_list(msg)).alias("_m"))
    messages = F.transform(
        "_m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["ts"].alias("ts"), x["meta"].alias("meta"))
    )
    older = F.col("chat_id") % 2 == 1
    title = F.when(F.col("chat_id") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("Chat "), F.col("chat_id").cast("string")))
    last = F.element_at("_m", -1)
    doc = F.struct(
        title.alias("title"),
        messages.alias("messages"),
        F.when(older, F.lit(1)).alias("schema_version"),
        F.when(older, F.element_at("_m", 1)["ts"]).alias("created_at"),
        F.when(older, F.struct(last["content"].alias("suggestions"), F.lit("USD").alias("currency"))).alias("last_payload"),
    )
    corrupt = F.col("chat_id") % 9 == 4
    value = F.when(corrupt, F.concat(F.lit("{bad "), F.col("chat_id").cast("string"))).otherwise(F.to_json(doc))
    return g.select("chat_id", value.alias("value"))


def write_chat_store(docs: DataFrame, path: str) -> str:
    """One file per chat under ``chat_id=<id>/`` (text writer: the documents
    are already serialised, corrupt ones included).

    The tasks put their folders in place themselves (commit algorithm 2): with a folder a chat, the driver alone would
    rename them one after the other. ``path`` is read only after the write has ended."""
    writer = docs.repartition("chat_id").write.mode("overwrite").partitionBy("chat_id")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


def write_chat_lines(docs: DataFrame, path: str) -> str:
    """Scale layout: JSON Lines of ``chat_id`` and the escaped ``document``, corrupt ones included."""
    line = F.struct(F.col("chat_id").cast("string").alias("chat_id"), F.col("value").alias("document"))
    docs.select(F.to_json(line).alias("value")).write.mode("overwrite").text(path)
    return path


def chat_store(spark: SparkSession, sf_dir: str) -> str:
    """The derived store for ``sf_dir``, written once per session into the
    shared checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = write_chat_lines(derived_chat_documents(spark, sf_dir), work_dir(spark, "chat-store"))
    return _STORES[key]
