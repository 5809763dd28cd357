"""Registered queries: chat log and audit (rows 1-7, 9, 15, 16, 50, 52)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeflow.functions import render as R
from recipeflow.operators import chatlog as C
from recipeflow.operators.audit import audit_manifest, audit_summary
from recipeflow.plans import sqlgen as S
from recipeflow.plans.oracle_views import with_views
from recipeflow.plans.registry import register
from recipeflow.sources import views as V
from recipeflow.sources.chats import chat_store
from recipeflow.sources.tables import load


def stored_chats(spark, sf):
    return C.scan_chat_lines(spark, chat_store(spark, sf))


# SQL twin of the derived store: one row per conversation
_CHATS_SQL = """SELECT CAST(conv_id AS VARCHAR) AS chat_id, conv_id, (conv_id % 9 = 4) AS corrupt,
  CASE WHEN conv_id % 9 = 4 OR conv_id % 6 = 0 THEN CAST(conv_id AS VARCHAR) ELSE 'Chat ' || conv_id END AS title,
  CASE WHEN conv_id % 9 = 4 THEN 0 ELSE count(*) END AS n_messages
FROM conversations GROUP BY conv_id"""


@register(
    "scan_chats",
    f"SELECT chat_id, title, CAST(n_messages AS BIGINT) AS n_messages, corrupt FROM ({_CHATS_SQL})",
    row="1",
)
def q_scan_chats(spark, sf):
    c = stored_chats(spark, sf)
    return c.select(
        "chat_id", "title", F.coalesce(F.size("messages"), F.lit(0)).cast("bigint").alias("n_messages"), "corrupt"
    )


@register("list_chats", f"SELECT chat_id, title FROM ({_CHATS_SQL})", row="7")
def q_list_chats(spark, sf):
    return C.list_chats(stored_chats(spark, sf)).select("chat_id", "title")


@register(
    "flatten_messages",
    with_views(
        "SELECT CAST(chat_id AS VARCHAR) AS chat_id, seq, role, content, ts_raw, "
        "CASE WHEN has_recipe THEN r_title END AS recipe_title FROM v1 WHERE chat_id % 9 <> 4",
        "v1",
    ),
    row="2",
)
def q_flatten_messages(spark, sf):
    m = C.flatten_messages(stored_chats(spark, sf))
    return m.select(
        "chat_id", "seq", "role", "content", "ts_raw", F.col("meta.payload.recipe_detail.title").alias("recipe_title")
    )


@register(
    "unify_message_schema",
    with_views(
        "SELECT CAST(chat_id AS VARCHAR) AS chat_id, seq, "
        f"strftime(TIMESTAMP '{V.TS_BASE}' + to_seconds(seq // 2), '%Y-%m-%d %H:%M:%S') AS ts, "
        "CAST(CASE WHEN chat_id % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS schema_version FROM v1 WHERE chat_id % 9 <> 4",
        "v1",
    ),
    row="3",
)
def q_unify_message_schema(spark, sf):
    chats = stored_chats(spark, sf)
    u = C.unify_message_schema(C.flatten_messages(chats), chats)
    return u.select(
        "chat_id", "seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("schema_version").cast("bigint")
    )


_TITLE_SQL = "CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type || ' ' || props END"


@register(
    "new_chat_rows",
    f"""SELECT event_id, chat_id, CAST(count(*) OVER (PARTITION BY chat_id) AS BIGINT) AS n_same_id FROM (
      SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') || '_' || replace(coalesce(nullif({_TITLE_SQL}, ''), 'Ingredients'), ' ', '_') AS chat_id
      FROM events)""",
    row="4",
)
def q_new_chat_rows(spark, sf):
    e = load(spark, sf, "events", "event_id", "ts", "event_type", "props")
    title = F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.concat_ws(" ", "event_type", "props"))
    r = C.new_chat_rows(e.withColumn("title", title), ts="ts", title="title")
    return r.select("event_id", "chat_id", "n_same_id")


@register(
    "append_messages",
    with_views(
        """SELECT e.user_id AS chat_id, e.event_id, 'user' AS role, e.event_type || ' ' || e.props AS content,
             CASE WHEN e.event_id % 2 = 0 THEN e.props END AS payload_json,
             CAST(coalesce(m.last, -1) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS BIGINT) AS seq
           FROM events e LEFT JOIN (SELECT chat_id, max(seq) AS last FROM v1 GROUP BY chat_id) m ON m.chat_id = e.user_id""",
        "v1",
    ),
    row="5",
)
def q_append_messages(spark, sf):
    msgs = V.v1_messages(spark, sf)
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    new = e.select(
        F.col("user_id").alias("chat_id"),
        "event_id",
        F.lit("user").alias("role"),
        F.concat("event_type", F.lit(" "), "props").alias("content"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("payload_json"),
    )
    out = C.append_messages(msgs, new, order_by="event_id")
    return out.select("chat_id", "event_id", "seq", "role", "content", "payload_json")


@register(
    "history",
    with_views(
        """SELECT chat_id, seq, role, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) AS BIGINT) AS rank
           FROM v1 WHERE chat_id IN (SELECT chat_id FROM v6 WHERE chat_id IS NOT NULL)""",
        "v1",
        "v6",
    ),
    row="6",
)
def q_history(spark, sf):
    msgs = V.v1_messages(spark, sf).select("chat_id", "seq", "role")
    ptr = V.v6_pointers(spark, sf).where(F.col("chat_id").isNotNull())
    return C.history(msgs, ptr).select("chat_id", "seq", "role", "rank")


@register(
    "resolve_pointer",
    with_views(
        """SELECT p.user_id, p.chat_id AS pointer,
             CASE WHEN p.chat_id IS NULL THEN (SELECT max(chat_id) FROM v1) ELSE c.chat_id END AS active_chat_id,
             CASE WHEN p.chat_id IS NULL THEN 'latest' WHEN c.chat_id IS NULL THEN 'dangling' ELSE 'ok' END AS status
           FROM v6 p LEFT JOIN (SELECT DISTINCT chat_id FROM v1) c ON c.chat_id = p.chat_id""",
        "v1",
        "v6",
    ),
    row="15",
)
def q_resolve_pointer(spark, sf):
    chats = V.v1_messages(spark, sf).select("chat_id")
    return C.resolve_pointer(V.v6_pointers(spark, sf), chats)


_LATEST_SQL = """SELECT chat_id, max(seq) AS seq, arg_max(r_title, seq) AS title,
  arg_max(r_ing, seq) AS ing, arg_max(r_steps, seq) AS steps FROM v1 WHERE has_recipe GROUP BY chat_id"""


@register(
    "latest_payload",
    with_views(
        "SELECT chat_id, seq, title, CAST(len(ing) AS BIGINT) AS n_ing, CAST(len(steps) AS BIGINT) AS n_steps, "
        f"array_to_string(ing, ',') AS ingredients FROM ({_LATEST_SQL})",
        "v1",
    ),
    row="50",
)
def q_latest_payload(spark, sf):
    lp = C.latest_payload(V.v1_messages(spark, sf))
    d = F.col("recipe_detail")
    return lp.select(
        "chat_id",
        "seq",
        d["title"].alias("title"),
        F.size(d["ingredients"]).cast("bigint").alias("n_ing"),
        F.size(d["steps"]).cast("bigint").alias("n_steps"),
        F.array_join(d["ingredients"], ",").alias("ingredients"),
    )


@register(
    "eligible_for_check",
    with_views(f"SELECT chat_id, (len(ing) > 0 OR len(steps) > 0) AS eligible FROM ({_LATEST_SQL})", "v1"),
    row="16",
)
def q_eligible_for_check(spark, sf):
    lp = C.latest_payload(V.v1_messages(spark, sf))
    ok, rejected = C.eligible_for_check(lp)
    return ok.select("chat_id", F.lit(True).alias("eligible")).unionByName(
        rejected.select("chat_id", F.lit(False).alias("eligible"))
    )


def filter_events(spark, sf):
    """Saved dietary profiles as events: (chat_id, seq, tags)."""
    p = V.v5_profiles(spark, sf)
    return p.select(
        (F.col("profile_id") / 4).cast("bigint").alias("chat_id"),
        (F.col("profile_id") % 4).alias("seq"),
        R.flatten_profile().alias("tags"),
    )


FILTER_EVENTS_SQL = f"SELECT profile_id // 4 AS chat_id, profile_id % 4 AS seq, {S.flatten_profile()} AS tags FROM v5"


@register(
    "upsert_filters",
    with_views(
        """SELECT c.chat_id, CAST(len(coalesce(f.tags, []::VARCHAR[])) AS BIGINT) AS n_tags,
             array_to_string(coalesce(f.tags, []::VARCHAR[]), ',') AS tags
           FROM (SELECT DISTINCT chat_id FROM v1) c
           LEFT JOIN (SELECT chat_id, arg_max(tags, seq) AS tags FROM fe GROUP BY chat_id) f ON f.chat_id = c.chat_id""",
        "v1",
        "v5",
        extra=[("fe", FILTER_EVENTS_SQL)],
    ),
    row="52",
)
def q_upsert_filters(spark, sf):
    chats = V.v1_messages(spark, sf).select("chat_id").distinct()
    u = C.upsert_filters(filter_events(spark, sf), chats)
    return u.select(
        "chat_id",
        F.size("health_filters").cast("bigint").alias("n_tags"),
        F.array_join("health_filters", ",").alias("tags"),
    )


@register(
    "audit_manifest",
    with_views(
        """SELECT m.key, m.path, o.size,
             CASE WHEN o.path IS NULL THEN 'missing' WHEN o.size <= 1024 THEN 'too_small'
                  WHEN coalesce(m.sha256, '') <> '' AND lower(m.sha256) <> sha256(o.content) THEN 'hash_mismatch'
                  ELSE 'ok' END AS status
           FROM v7m m LEFT JOIN v7o o ON o.path = m.path""",
        "v7m",
        "v7o",
    ),
    row="9",
)
def q_audit_manifest(spark, sf):
    return audit_manifest(V.v7_manifest(spark, sf), V.v7_objects(spark, sf))


@register(
    "audit_summary",
    with_views(
        """SELECT bool_and(status = 'ok') AS all_ok, CAST(count(*) AS BIGINT) AS n_assets,
             CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS n_ok,
             CAST(count(*) FILTER (WHERE status = 'missing') AS BIGINT) AS n_missing,
             CAST(count(*) FILTER (WHERE status = 'too_small') AS BIGINT) AS n_too_small,
             CAST(count(*) FILTER (WHERE status = 'hash_mismatch') AS BIGINT) AS n_hash_mismatch
           FROM (SELECT CASE WHEN o.path IS NULL THEN 'missing' WHEN o.size <= 1024 THEN 'too_small'
                  WHEN coalesce(m.sha256, '') <> '' AND lower(m.sha256) <> sha256(o.content) THEN 'hash_mismatch'
                  ELSE 'ok' END AS status FROM v7m m LEFT JOIN v7o o ON o.path = m.path)""",
        "v7m",
        "v7o",
    ),
    row="9",
)
def q_audit_summary(spark, sf):
    return audit_summary(audit_manifest(V.v7_manifest(spark, sf), V.v7_objects(spark, sf)))
