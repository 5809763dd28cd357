"""Structured Streaming forms of the chat-log operators (rows 59-61).

stream_messages         chat documents arriving as files -> one row per
                        message -> parquet sink (stateless, append)
stream_distinct_messages  message events, some sent again -> each message once
                        (state in RocksDB, expires behind a watermark)
stream_latest_payload   message events -> newest recipe payload per chat
stream_latest_filters   saved profiles -> newest tag list per chat

The latest_* streams keep no operator state: every micro-batch is reduced to one
row per chat (a partial aggregate, so a hot chat is one row a task) and merged by
``foreachBatch`` into a :class:`~recipeflow.streaming.state_table.StateTable`, a snapshot and its open deltas.
A batch that is retried replaces itself, and the greatest ``seq`` wins whatever the order of arrival.
Every query has its own checkpoint location in the shared checkpoint folder,
so a restarted or re-tried query resumes exactly once.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeflow.operators import chatlog as C
from recipeflow.session import work_dir
from recipeflow.streaming.state_table import StateTable


def _run(writer, timeout_s: int | None = None):
    q = writer.start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not drain in time")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def read_chat_stream(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Chat documents as a stream (partitioned ``chat_id=<id>/`` layout)."""
    schema = T.StructType(C.CHAT_SCHEMA.fields + [T.StructField("chat_id", T.StringType())])
    return (
        spark.readStream.schema(schema)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("maxFilesPerTrigger", max_files)
        .json(path)
        .select(
            "chat_id",
            F.when(F.col("_corrupt").isNull(), F.col("messages")).alias("messages"),
        )
    )


def read_chat_lines_stream(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Chat documents as a stream of JSON Lines files, many chats per file."""
    lines = spark.readStream.schema(C.LINE_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    return C.chats_of_lines(lines).select("chat_id", "messages")


def stream_messages(
    spark: SparkSession,
    source: str,
    sink: str | None = None,
    checkpoint: str | None = None,
    timeout_s: int | None = None,
    lines: bool = False,
) -> str:
    """Drain ``source`` (trigger availableNow), a chat folder or with ``lines`` JSON Lines, into a parquet message log."""
    sink = sink or work_dir(spark, "stream-messages")
    checkpoint = checkpoint or work_dir(spark, "stream-messages-ckpt")
    msgs = C.flatten_messages((read_chat_lines_stream if lines else read_chat_stream)(spark, source))
    writer = (
        msgs.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    _run(writer, timeout_s)
    return sink


#: State in RocksDB, checkpointed as changelogs: a commit uploads what changed, not the whole state.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings while a query starts, which keeps those that it starts with."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_distinct_messages(
    spark: SparkSession,
    events_path: str,
    schema: T.StructType,
    key: tuple[str, ...] = ("chat_id", "seq"),
    delay: str = "7 days",
    sink: str | None = None,
    checkpoint: str | None = None,
    max_files: int = 64,
    timeout_s: int | None = None,
) -> str:
    """Drain message events into a parquet log that holds each ``key`` once; returns the log's folder.

    The watermark runs on the time at which a file arrived, in whose order files are read. So no message is too late to be
    stored, however old its own ``ts`` is or if it has none; one sent again within ``delay`` of its first arrival is dropped,
    and its key's state expires behind that. NULL in a key equals NULL.
    """
    sink = sink or work_dir(spark, "stream-distinct")
    checkpoint = checkpoint or work_dir(spark, "stream-distinct-ckpt")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(events_path)
    arrived = events.select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
    once = arrived.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(list(key)).drop("_arrived")
    writer = (
        once.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with _settings(spark, ROCKSDB):
        _run(writer, timeout_s)
    return sink


def _merge_stream(rows: DataFrame, state: StateTable, checkpoint: str, timeout_s: int | None) -> DataFrame:
    """Drain ``rows`` into ``state`` and read it."""
    writer = (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: state.merge(batch, batch_id))
        .trigger(availableNow=True)
    )
    _run(writer, timeout_s)
    return state.read()


def stream_latest_payload(
    spark: SparkSession,
    events_path: str,
    schema: T.StructType,
    sink: str | None = None,
    checkpoint: str | None = None,
    max_files: int = 64,
    timeout_s: int | None = None,
    **folding,
) -> DataFrame:
    """Newest ``recipe_detail`` payload per chat from a stream of message events; ``folding`` as in :class:`StateTable`."""
    sink = sink or work_dir(spark, "stream-latest-payload")
    checkpoint = checkpoint or work_dir(spark, "stream-latest-payload-ckpt")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(events_path)
    p = F.col("meta.payload.recipe_detail")
    rows = events.where(C.filled_payload(events, p)).select("chat_id", "seq", p.alias("recipe_detail"))
    state = StateTable(spark, sink, rows.schema, "chat_id", "seq", **folding)
    return _merge_stream(rows, state, checkpoint, timeout_s)


def stream_latest_filters(
    spark: SparkSession,
    events_path: str,
    schema: T.StructType,
    sink: str | None = None,
    checkpoint: str | None = None,
    max_files: int = 64,
    timeout_s: int | None = None,
    **folding,
) -> DataFrame:
    """Newest saved tag list per chat (last write wins) from a stream; an event whose ``deleted`` is true removes
    the chat's list until a later one is saved."""
    sink = sink or work_dir(spark, "stream-latest-filters")
    checkpoint = checkpoint or work_dir(spark, "stream-latest-filters-ckpt")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(events_path)
    rows = events.select("chat_id", "seq", F.col("tags").alias("health_filters"), *[c for c in ("deleted",) if c in events.columns])
    state = StateTable(spark, sink, rows.drop("deleted").schema, "chat_id", "seq", **folding)
    return _merge_stream(rows, state, checkpoint, timeout_s).select("chat_id", "health_filters")


def stage_files(df: DataFrame, path: str, n_files: int = 8, order: str | None = None) -> str:
    """Write a batch frame as ``n_files`` parquet files, in ``order`` (range
    partitioned), to feed a file stream."""
    out = df.repartitionByRange(n_files, order) if order else df.repartition(n_files)
    out.write.mode("overwrite").parquet(path)
    return path
