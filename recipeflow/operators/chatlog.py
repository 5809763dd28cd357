"""Chat log: scan, flatten, unify, append, history, latest state.

Data model
----------
``chats``     chat_id STRING, title STRING, messages ARRAY<STRUCT>, health_filters
              ARRAY<STRING>, plus the older shape's schema_version / created_at /
              last_payload (nullable).  One document per chat.
``messages``  one row per message: chat_id, seq BIGINT (list position), role,
              content, ts_raw, meta.

Message order is the list position ``seq`` (timestamps have one-second
resolution and tie).  ``seq`` is dense per chat (0..n-1): ``flatten_messages``
takes it from ``posexplode`` and ``append_messages`` continues it.

Scale notes
-----------
Per-chat state is computed with partial aggregates (``max_by``, ``max``,
``count``): each map task pre-aggregates, so a chat holding a third of all
messages costs one row per task in the exchange, never one huge group.
Joining such aggregates back to messages is an equi-join on ``chat_id`` that
AQE splits when one key is skewed.  The one true per-chat ordering (numbering
appended rows) is a window over one exchange for chats that fit a task, and a
range-partitioned, offset-corrected row number for larger ones
(:func:`row_number_within`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeflow.functions import constants as K
from recipeflow.functions.text import col
from recipeflow.session import stage
from recipeflow.sources.memory_table import filter_words, maybe_among

# --------------------------------------------------------------------------
# schemas
# --------------------------------------------------------------------------

RECIPE_DETAIL = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("ingredients", T.ArrayType(T.StringType())),
        T.StructField("steps", T.ArrayType(T.StringType())),
    ]
)
HEALTH_CHECK = T.StructType(
    [T.StructField("filters", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]
)
PAYLOAD = T.StructType(
    [
        T.StructField("recipe_detail", RECIPE_DETAIL),
        T.StructField("health_check", HEALTH_CHECK),
        # older document shape
        T.StructField("suggestions", T.StringType()),
        T.StructField("top", T.ArrayType(T.StringType())),
        T.StructField("currency", T.StringType()),
        T.StructField("filters", T.MapType(T.StringType(), T.StringType())),
    ]
)
META = T.StructType([T.StructField("payload", PAYLOAD)])
MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("ts", T.StringType()),
        T.StructField("meta", META),
    ]
)
CHAT_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("health_filters", T.ArrayType(T.StringType())),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("last_payload", PAYLOAD),
        T.StructField("_corrupt", T.StringType()),
    ]
)


# --------------------------------------------------------------------------
# 1, 7: scan and list
# --------------------------------------------------------------------------


def has_chat_folders(spark: SparkSession, path: str) -> bool:
    """Whether the folder ``path`` has ``chat_id=<id>`` folders in it; it looks no further than the first."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hp):  # a pattern, or an error that the reader reports
        return False
    inside = fs.listStatusIterator(hp)
    while inside.hasNext():
        found = inside.next()
        if found.isDirectory():
            name = found.getPath().getName()
            if not name.startswith(("_", ".")):
                return name.startswith("chat_id=")
    return False


def scan_chats(spark: SparkSession, path: str, glob: str | None = "*.json") -> DataFrame:
    """Read chat documents (one JSON document per file).

    * files starting with ``_`` or ``.`` are skipped by Spark's file source;
    * a corrupt file is kept as one row (fields NULL, ``corrupt`` true);
    * ``chat_id`` is the partition value ``chat_id=<id>`` when the store is
      laid out that way, else the file stem;
    * an empty or missing title falls back to ``chat_id``.
    """
    reader = (
        spark.read.schema(CHAT_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # folders name the chats: ids are read as they are written, 007 is not 7
    by_folder = T.StructType([*CHAT_SCHEMA, T.StructField("chat_id", T.StringType())])
    if has_chat_folders(spark, path):
        df = reader.schema(by_folder).json(path)  # the only listing: there is a folder a chat
    else:
        df = reader.json(path)
        if "chat_id" in df.columns:  # below other folders
            df = reader.schema(by_folder).json(path)
    fname = F.col("_metadata.file_name")
    stem = F.regexp_extract(fname, "^(.*?)(\\.json)?$", 1)
    chat_id = F.col("chat_id").cast("string") if "chat_id" in df.columns else stem
    return df.select(
        chat_id.alias("chat_id"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), chat_id).alias("title"),
        F.when(F.col("_corrupt").isNull(), F.col("messages")).alias("messages"),
        F.col("health_filters"),
        F.col("schema_version"),
        F.col("created_at"),
        F.col("last_payload"),
        F.col("_corrupt").isNotNull().alias("corrupt"),
        F.col("_metadata.file_path").alias("path"),
    )


LINE_SCHEMA = "chat_id string, document string"


def scan_chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read a chat store in the scale layout: JSON Lines, many chats per file
    (splittable, no small files).  A line holds ``chat_id`` and the ``document``
    as a string, so a corrupt document keeps its chat.

    Same output as :func:`scan_chats`.
    """
    return chats_of_lines(spark.read.schema(LINE_SCHEMA).json(path).select("*", F.col("_metadata.file_path").alias("path")))


def chats_of_lines(lines: DataFrame) -> DataFrame:
    """Chat rows of (chat_id, document[, path]) lines, read from a batch or a stream."""
    parsed = F.from_json("document", CHAT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    df = lines.withColumn("_d", parsed)
    # an empty document parses to NULL without a corrupt record
    ok = F.col("_d").isNotNull() & F.col("_d._corrupt").isNull()
    return df.select(
        "chat_id",
        F.coalesce(F.nullif(F.col("_d.title"), F.lit("")), F.col("chat_id")).alias("title"),
        F.when(ok, F.col("_d.messages")).alias("messages"),
        F.col("_d.health_filters"),
        F.col("_d.schema_version"),
        F.col("_d.created_at"),
        F.col("_d.last_payload"),
        (~ok).alias("corrupt"),
        *[c for c in ("path",) if c in lines.columns],
    )


def list_chats(chats: DataFrame) -> DataFrame:
    """(chat_id, title, path) in file-name order, then by chat (a range-partitioned sort)."""
    return chats.select("chat_id", "title", "path").orderBy("path", "chat_id")


# --------------------------------------------------------------------------
# 2, 3: flatten and unify
# --------------------------------------------------------------------------


def flatten_messages(chats: DataFrame) -> DataFrame:
    """One row per message; ``seq`` is the list position.

    A chat without messages (or unreadable) yields no rows.  Missing ``meta``
    reads as NULL, so nested fields are NULL, like ``(m.get('meta') or {})``.
    """
    return chats.select("chat_id", F.posexplode("messages").alias("pos", "m")).select(
        "chat_id",
        F.col("pos").cast("bigint").alias("seq"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("content"),
        F.col("m.ts").alias("ts_raw"),
        F.col("m.meta").alias("meta"),
    )


def parse_ts(ts_raw) -> Column:
    """Both timestamp formats; each yields NULL on the other."""
    c = col(ts_raw)
    return F.coalesce(
        F.try_to_timestamp(c, F.lit(K.TS_FORMAT_CURRENT)),
        F.try_to_timestamp(c, F.lit(K.TS_FORMAT_OLDER)),
    )


def unify_message_schema(messages: DataFrame, chats: DataFrame | None = None) -> DataFrame:
    """Messages of either document shape with a typed ``ts`` and a
    ``schema_version`` (0 for the current shape, which has none)."""
    out = messages.withColumn("ts", parse_ts("ts_raw"))
    if chats is not None:
        versions = chats.select("chat_id", F.coalesce("schema_version", F.lit(0)).alias("schema_version"))
        out = out.join(versions, "chat_id", "left")
    else:
        out = out.withColumn("schema_version", F.lit(0))
    return out.withColumn("schema_version", F.coalesce("schema_version", F.lit(0)))


# --------------------------------------------------------------------------
# 4: new chats
# --------------------------------------------------------------------------


def join_null_safe(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL, so rows without a chat are kept like any other's."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(right, same, how).drop(*[f"_right_{k}" for k in keys])


def new_chat_rows(requests: DataFrame, ts: str = "ts", title: str = "title") -> DataFrame:
    """Chat ids ``<yyyyMMdd'T'HHmmss>_<title with '_' for ' '>``.

    Requests in the same second with the same title get the same id (the
    application overwrote the file); ``n_same_id`` reports such collisions.
    A request without a time has no id, and is kept.
    The count is a partial aggregate joined back, so a hot id is handled by
    map-side combining and AQE skew splitting, not by one window task.
    """
    t = F.coalesce(F.nullif(F.col(title), F.lit("")), F.lit(K.DEFAULT_CHAT_TITLE))
    rows = requests.withColumn("chat_title", t).withColumn(
        "chat_id",
        F.concat(F.date_format(F.col(ts), K.TS_FORMAT_CURRENT), F.lit("_"), F.replace(t, F.lit(" "), F.lit("_"))),
    )
    counts = rows.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n_same_id"))
    return join_null_safe(rows, counts, "chat_id")


# --------------------------------------------------------------------------
# 5: append
# --------------------------------------------------------------------------


#: Rows of one key that one task numbers; the rows of a key with more are spread over many.
ONE_TASK = 100_000


def row_number_within(
    df: DataFrame, key: str, order: str, partitions: int | None = None, out: str = "rn", ties: tuple[str, str] | None = None,
    then: tuple[str, ...] = (), last: DataFrame | None = None,
) -> DataFrame:
    """``row_number() over (partition by key order by order)`` without putting
    a hot key into one task.

    Keys of up to :data:`ONE_TASK` rows are numbered by a window, in the one exchange that brings their rows together;
    rows of larger keys, which one cheap count finds, by ranges (:func:`_numbered_by_range`).

    ``ties`` names two more columns: the first number of the rows that are equal in ``key`` and ``order``, and how many
    they are.  ``then`` are columns that order such rows: if all rows that they leave equal are alike, every evaluation
    gives the same numbers.  ``last`` (key, _last), one row a key, is joined to the rows (NULL where it has none); where its
    key is of the same type it goes through the exchange with them.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    large = stage(sizes.where(F.col("_size") > ONE_TASK).select(key), "large-keys")  # fewer than the rows by ONE_TASK
    if large.isEmpty():
        return _numbered_by_key(df, key, order, out, ties, then, last)
    of_large, others = (join_null_safe(df, F.broadcast(large), key, how=how) for how in ("left_semi", "left_anti"))
    ranged = _numbered_by_range(of_large, key, order, partitions, out, ties, then)
    if last is not None:
        ranged = join_null_safe(ranged, join_null_safe(last, F.broadcast(large), key, how="left_semi"), key, how="left")
    return _numbered_by_key(others, key, order, out, ties, then, last).unionByName(ranged)


def _numbered_by_key(df: DataFrame, key: str, order: str, out: str, ties, then, last: DataFrame | None) -> DataFrame:
    """The numbers of :func:`row_number_within`: one exchange on ``key`` and one sort, all rows of a key in one task."""
    if last is not None and last.schema[key].dataType != df.schema[key].dataType:
        return join_null_safe(_numbered_by_key(df, key, order, out, ties, then, None), last, key, how="left")
    columns = [*df.columns, *(["_last"] if last is not None else [])]
    df = df.withColumn("_new", F.lit(True))
    if last is not None:  # a row before the key's others: its order is NULL, which comes first
        df = df.unionByName(last.select(key, "_last", F.lit(False).alias("_new")), allowMissingColumns=True)
    rows = Window.partitionBy(key).orderBy(order, "_new", *then).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(out, F.count(F.when(F.col("_new"), 1)).over(rows))
    if last is not None:
        df = df.withColumn("_last", F.max("_last").over(rows)).where("_new")
    if ties is not None:
        same = Window.partitionBy(key, order)  # sorted and placed already
        df = df.withColumn(ties[0], F.min(out).over(same)).withColumn(ties[1], F.count(F.lit(1)).over(same))
    return df.select(*columns, out, *(ties or ()))


def _numbered_by_range(df: DataFrame, key: str, order: str, partitions: int | None, out: str, ties, then) -> DataFrame:
    """The numbers of :func:`row_number_within`, for few keys of many rows.

    1. range-partition on (key, order) and write the pieces once: a key holding a third of
       all rows is spread over many partitions (ranges split inside the key);
    2. number rows locally per (partition, key) - the window's exchange is on
       (partition id, key), so each piece of a hot key is its own task;
    3. prefix-sum the per-(key, partition) counts (one row per piece) into
       offsets and join them back.

    Rows that are equal in ``key`` and ``order`` are in one piece.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    # written once: a second evaluation of the exchange would sample other bounds and disagree on the pieces
    ranged = stage(df.repartitionByRange(n, key, order).withColumn("_pid", F.spark_partition_id()), "numbered-pieces")
    piece = Window.partitionBy("_pid", key)
    local = ranged.withColumn("_lrn", F.row_number().over(piece.orderBy(order, *then)))
    if ties is not None:
        same = Window.partitionBy("_pid", key, order)
        local = local.withColumn(ties[0], F.min("_lrn").over(same)).withColumn(ties[1], F.count(F.lit(1)).over(same))
    counts = ranged.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.withColumn(
        "_off",
        F.coalesce(
            F.sum("_cnt").over(Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).drop("_cnt")
    numbered = join_null_safe(local, offsets, key, "_pid").withColumn(out, (F.col("_off") + F.col("_lrn")).cast("bigint"))
    if ties is not None:
        numbered = numbered.withColumn(ties[0], (F.col("_off") + F.col(ties[0])).cast("bigint"))
    return numbered.drop("_pid", "_lrn", "_off")


def last_positions(messages: DataFrame) -> DataFrame:
    """(chat_id, _last): the greatest position of each chat, a partial aggregate."""
    return messages.groupBy("chat_id").agg(F.max("seq").alias("_last"))


def append_messages(
    messages: DataFrame,
    new: DataFrame,
    order_by: str = "event_order",
    path: str | None = None,
) -> DataFrame:
    """Give new messages the next positions of their chat, optionally append
    them to a parquet log, and return them.

    ``seq = coalesce(max(seq), -1) + row_number()`` per chat.  The existing
    maximum is a partial aggregate; the numbering of the new rows is
    :func:`row_number_within`, which splits a hot chat over many tasks.
    """
    numbered = row_number_within(new, "chat_id", order_by, out="_rn", last=last_positions(messages))
    out = numbered.withColumn("seq", (F.coalesce("_last", F.lit(-1)) + F.col("_rn")).cast("bigint")).drop("_last", "_rn")
    if path is not None:
        out = stage(out, "appended")
        out.write.mode("append").parquet(path)
    return out


def exchange_positions(last: DataFrame, new: DataFrame, order_by: str, then: tuple[str, ...] = ()) -> DataFrame:
    """``new`` with the positions that its rows' messages take: ``seq_user`` and ``seq_assistant``.

    ``last`` are the messages before them, or what :func:`last_positions` gives of these.  The positions are those of
    :func:`append_messages` for two messages a row, ordered by (``order_by``, the user's first): rows equal in chat and order
    have all their users' messages before their assistants', in the order of ``then``. Only ``new`` moves, so give it
    before its messages are made: their texts are then not sorted.
    """
    if "_last" not in last.columns:
        last = last_positions(last)
    numbered = row_number_within(new, "chat_id", order_by, out="_rn", ties=("_first", "_same"), then=then, last=last)
    user = F.coalesce("_last", F.lit(-1)) + F.col("_first") + F.col("_rn") - 1  # 2 * (_first - 1) before, then _rn - _first + 1
    return (
        numbered.withColumn("seq_user", user.cast("bigint"))
        .withColumn("seq_assistant", (F.col("seq_user") + F.col("_same")).cast("bigint"))
        .drop("_last", "_rn", "_first", "_same")
    )


# --------------------------------------------------------------------------
# 6: history
# --------------------------------------------------------------------------


def history(messages: DataFrame, chat_ids: DataFrame | None = None, dense: bool = True) -> DataFrame:
    """Messages newest first: ``rank`` 1 is the last message of the chat.

    With a ``dense`` ``seq`` (list position) the reverse position is ``max(seq) - seq + 1``: a partial aggregate and a join,
    no per-chat sort.  Where positions may be missing, rows are numbered by :func:`row_number_within`.
    Rows without a chat are a chat of their own.
    """
    if chat_ids is not None:
        messages = join_null_safe(messages, chat_ids.select("chat_id").distinct(), "chat_id", how="left_semi")
    if not dense:
        backwards = messages.withColumn("_back", -F.col("seq"))
        return row_number_within(backwards, "chat_id", "_back", out="rank").drop("_back")
    last = messages.groupBy("chat_id").agg(F.max("seq").alias("_last"))
    return (
        join_null_safe(messages, last, "chat_id")
        .withColumn("rank", (F.col("_last") - F.col("seq") + 1).cast("bigint"))
        .drop("_last")
    )


# --------------------------------------------------------------------------
# 50, 16: latest recipe payload and the check guard
# --------------------------------------------------------------------------


def filled_payload(messages: DataFrame, payload: Column) -> Column:
    """Whether the struct ``payload`` has a field that is not NULL: an empty object is no payload."""
    filled = F.lit(False)
    for f in messages.select(payload.alias("p")).schema["p"].dataType.fieldNames():
        filled = filled | payload[f].isNotNull()
    return payload.isNotNull() & filled


def newest_positions(messages: DataFrame, kind: str = "recipe_detail") -> DataFrame:
    """(chat_id, _last, seq, _found): the greatest position of each chat, that of its messages carrying ``meta.payload.<kind>``,
    and whether there is one.  One partial aggregate over positions, without the payloads."""
    filled = filled_payload(messages, F.col("meta.payload." + kind))
    return messages.groupBy("chat_id").agg(
        F.max("seq").alias("_last"), F.max(F.when(filled, F.col("seq"))).alias("seq"), F.coalesce(F.bool_or(filled), F.lit(False)).alias("_found")
    )


def latest_payload(messages: DataFrame, kind: str = "recipe_detail", newest: DataFrame | None = None) -> DataFrame:
    """Per chat, the newest message carrying ``meta.payload.<kind>``.

    Empty lists in that payload are *not* skipped over to an older one.
    Positions are compared first, without the payloads (a partial aggregate that sorts nothing); only the newest messages'
    payloads go on.  ``newest`` are the :func:`newest_positions` of ``messages``, where they are staged already.
    """
    p = F.col("meta.payload." + kind)
    filled = messages.where(filled_payload(messages, p))
    newest = stage(newest_positions(messages, kind).where("_found"), "newest") if newest is None else newest.where("_found")
    newest = newest.select("chat_id", "seq")
    # where there are too many chats to broadcast, the other messages' payloads don't move either
    filled = maybe_among(filled, filter_words(newest, "chat_id", "seq"), "chat_id", "seq")
    return (
        join_null_safe(filled, newest, "chat_id", "seq", how="left_semi")
        .groupBy("chat_id")
        .agg(F.max_by(F.struct(F.col("seq"), p.alias("payload")), F.col("seq")).alias("_l"))
        .select("chat_id", F.col("_l.seq").alias("seq"), F.col("_l.payload").alias(kind))
    )


def eligible_for_check(latest: DataFrame, kind: str = "recipe_detail") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a recipe with neither ingredients nor steps is rejected."""
    ing = F.coalesce(F.size(F.col(kind + ".ingredients")), F.lit(-1))
    st = F.coalesce(F.size(F.col(kind + ".steps")), F.lit(-1))
    ok = (ing > 0) | (st > 0)
    return latest.where(ok), latest.where(~ok)


# --------------------------------------------------------------------------
# 52: filters per chat
# --------------------------------------------------------------------------


def upsert_filters(filter_events: DataFrame, chats: DataFrame) -> DataFrame:
    """The newest saved tag list replaces older ones (last write wins);
    chats that never saved one get an empty list."""
    latest = filter_events.groupBy("chat_id").agg(F.max_by("tags", "seq").alias("health_filters"))
    return chats.select("chat_id").join(latest, "chat_id", "left").select(
        "chat_id", F.coalesce("health_filters", F.array().cast("array<string>")).alias("health_filters")
    )


# --------------------------------------------------------------------------
# 15: pointer resolution
# --------------------------------------------------------------------------


def resolve_pointer(pointers: DataFrame, chats: DataFrame) -> DataFrame:
    """Active chat per user.

    * pointer present and the chat exists -> that chat (status 'ok');
    * pointer present but dangling -> NULL, no fallback ('dangling');
    * no pointer -> the latest chat (max ``chat_id``), or NULL ('latest').

    The latest chat is a scalar subquery (one value, evaluated once); the
    existence test is a left join on ``chat_id``.
    """
    ids = chats.select(F.col("chat_id").alias("_cid")).distinct()
    latest = chats.select(F.max("chat_id")).scalar()
    named = F.when(F.col("chat_id").cast("string") != "", F.col("chat_id"))  # an empty pointer is none
    pointers = pointers.withColumn("chat_id", named)
    j = pointers.join(ids, pointers["chat_id"] == ids["_cid"], "left")
    status = (
        F.when(F.col("chat_id").isNull(), F.lit("latest"))
        .when(F.col("_cid").isNull(), F.lit("dangling"))
        .otherwise(F.lit("ok"))
    )
    resolved = F.when(F.col("chat_id").isNull(), latest).otherwise(F.col("_cid"))
    return j.select(
        "user_id",
        F.col("chat_id").alias("pointer"),
        resolved.alias("active_chat_id"),
        status.alias("status"),
    )


# --------------------------------------------------------------------------
# 36, 31: long forms
# --------------------------------------------------------------------------


def recipe_items(df: DataFrame, key: str, rec: str = "recipe") -> DataFrame:
    """(key, section, pos, item) for the ingredients and steps of a recipe.

    One ``explode`` over a concatenated array of tagged items: the input is
    read once (a union of two projections would evaluate it twice).
    """

    def tag(section):
        return lambda x, i: F.struct(F.lit(section).alias("section"), i.alias("pos"), x.alias("item"))

    both = F.concat(
        F.transform(F.col(rec + ".ingredients"), tag("ingredients")),
        F.transform(F.col(rec + ".steps"), tag("steps")),
    )
    return df.select(key, F.explode(both).alias("_it")).select(
        key, F.col("_it.section").alias("section"), F.col("_it.pos").cast("bigint").alias("pos"), F.col("_it.item").alias("item")
    )


def explode_titles(df: DataFrame, key: str, titles: str = "titles") -> DataFrame:
    """(key, rank, title) with rank starting at 1.

    The outer form: for the inner one Spark filters by the list's size first, and so makes a computed list several times.
    """
    return df.select(key, F.posexplode_outer(titles).alias("pos", "title")).where("pos is not null").select(
        key, (F.col("pos") + 1).cast("bigint").alias("rank"), "title"
    )
