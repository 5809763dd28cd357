"""Registered queries: the stored message log, and rows without a chat (rows 1, 4-6, 46, 55-58)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from recipeflow.operators import chatlog as C
from recipeflow.operators import translate as T
from recipeflow.operators.modelmap import materialize
from recipeflow.functions import parse as P
from recipeflow.plans import catalog_model as M
from recipeflow.plans import jobs as J
from recipeflow.plans import sqlgen as S
from recipeflow.plans.catalog_chat import FILTER_EVENTS_SQL, filter_events
from recipeflow.plans.catalog_text import probe_code, probe_sql
from recipeflow.plans.oracle_views import VIEWS, with_views
from recipeflow.plans.registry import ORACLE, register
from recipeflow.session import stage, work_dir
from recipeflow.sources import views as V
from recipeflow.sources.chats import derived_chat_documents, write_chat_store
from recipeflow.sources.message_log import MessageLog
from recipeflow.sources.tables import load

#: When the runs of the registered queries take place.
FIRST_DAY, RECIPE_AT, HEALTH_AT = "2025-09-06", "2025-09-07 10:00:00", "2025-09-08 11:30:00"


def started_log(spark, sf, name: str) -> MessageLog:
    """A log of its own that holds the conversations as its first run."""
    log = MessageLog(spark, work_dir(spark, name))
    msgs = V.v1_messages(spark, sf)
    log.write(msgs.withColumn("ts", C.parse_ts("ts_raw")), "import")
    return log


_MESSAGE = "chat_id, seq, CAST(day AS VARCHAR) AS day, run, role, content, title"
_FIRST = f"SELECT chat_id, seq, DATE '{FIRST_DAY}' AS day, 'import' AS run, role, content, CASE WHEN has_recipe THEN r_title END AS title FROM v1"


def _chain_sql() -> str:
    recipe = ORACLE["recipe_job"]
    at = recipe.rindex("SELECT title_id, m.chat_id")
    head, logged = recipe[:at].rstrip(), recipe[at:]
    code = S.safe_lang(probe_sql("l.chat_id"))
    return f"""{head},
logged AS ({logged}),
added AS (
  SELECT g.chat_id, g.seq, DATE '{RECIPE_AT[:10]}' AS day, 'recipes' AS run, g.role, g.content,
         CASE WHEN g.role = 'assistant' THEN t.title END AS title, t.ing, t.steps
  FROM logged g JOIN tr t ON t.title_id = g.title_id
),
payloads AS (
  SELECT chat_id, seq, r_title AS title, r_ing AS ing, r_steps AS steps FROM v1 WHERE has_recipe
  UNION ALL SELECT chat_id, seq, title, ing, steps FROM added WHERE role = 'assistant'
),
newest AS (SELECT chat_id, arg_max(title, seq) AS title, arg_max(ing, seq) AS ing, arg_max(steps, seq) AS steps FROM payloads GROUP BY chat_id),
ends AS (SELECT chat_id, max(seq) AS last FROM (SELECT chat_id, seq FROM v1 UNION ALL SELECT chat_id, seq FROM added) GROUP BY chat_id),
v5 AS ({VIEWS["v5"]}),
fe AS ({FILTER_EVENTS_SQL}),
ff AS (SELECT chat_id, arg_max(tags, seq) AS tags FROM fe GROUP BY chat_id),
hj AS (
  SELECT l.chat_id, l.title, {S.health_prompt('l.ing', 'l.steps', 'coalesce(f.tags, []::VARCHAR[])')} AS prompt, {code} AS code
  FROM newest l LEFT JOIN ff f ON f.chat_id = l.chat_id WHERE len(l.ing) > 0 OR len(l.steps) > 0
),
ha AS (
  SELECT chat_id, title, code, {S.strip(S.stub_generate("'health'", 'prompt'))} AS text_en FROM hj WHERE NOT {S.stub_fails('prompt')}
),
hl AS (
  SELECT chat_id, title, CASE WHEN code <> 'en' AND {S.can_translate('code')} AND NOT {S.stub_translate_fails("'en'", 'code')}
    THEN {S.stub_translate('text_en', 'code')} ELSE text_en END AS text_loc FROM ha
),
checks AS (
  SELECT h.chat_id, e.last + 1 AS seq, DATE '{HEALTH_AT[:10]}' AS day, 'checks' AS run, 'assistant' AS role,
         {S.check_block('title', 'text_loc')} AS content, NULL AS title
  FROM hl h JOIN ends e ON e.chat_id = h.chat_id
)
SELECT {_MESSAGE} FROM ({_FIRST} UNION ALL SELECT chat_id, seq, day, run, role, content, title FROM added
  UNION ALL SELECT * FROM checks)"""


def shown(log):
    return log.select(
        "chat_id", "seq", F.col("day").cast("string").alias("day"), "run", "role", "content",
        F.col("meta.payload.recipe_detail.title").alias("title"),
    )


@register("logged_jobs", _chain_sql(), row="58")
def q_logged_jobs(spark, sf):
    """recipe_job stores its messages, twice; health_job reads them back and stores its own: one copy of each is left."""
    log = started_log(spark, sf, "message-log")
    titles = stage(M.job_titles(spark, sf), "titles")  # read by both runs
    for _ in range(2):
        J.recipe_job(titles, M.GEN, M.TR, log=log, run="recipes", at=RECIPE_AT)
    chats = materialize(log.read().select("chat_id").distinct())  # read twice
    filters = C.upsert_filters(filter_events(spark, sf), chats)
    langs = chats.select("chat_id", probe_code("chat_id").alias("display_lang"))
    J.health_job(log, filters, langs, M.GEN, M.TR, run="checks", at=HEALTH_AT)
    return shown(log.read())


@register(
    "log_since",
    with_views(
        f"""SELECT {_MESSAGE} FROM (
              SELECT e.user_id AS chat_id, CAST(coalesce(m.last, -1) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS BIGINT) AS seq,
                     CAST(e.ts AS DATE) AS day, 'events' AS run, 'user' AS role, e.event_type AS content, NULL AS title, e.ts
              FROM events e LEFT JOIN (SELECT chat_id, max(seq) AS last FROM v1 GROUP BY chat_id) m ON m.chat_id = e.user_id)
            WHERE day >= (SELECT CAST(max(ts) AS DATE) - 2 FROM events)""",
        "v1",
    ),
    row="5",
)
def q_log_since(spark, sf):
    """The last days of a log that holds the events as messages; other days' files are not read."""
    log = started_log(spark, sf, "event-log")
    e = load(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    new = e.select(
        F.col("user_id").alias("chat_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("seq"), "event_id",
        F.lit("user").alias("role"), F.col("event_type").alias("content"),
    )
    J.append_to_log(new, "event_id", log, "events")
    last = e.agg(F.max("ts").cast("date").alias("d")).first()["d"]
    since = last - datetime.timedelta(days=2) if last else datetime.date.max
    return shown(log.read(since=since)).where("run = 'events'")


# ------------------------------------------------------- rows without a chat
_NO_CHAT = "CASE WHEN e.event_id % 7 <> 0 THEN e.user_id END"


@register(
    "append_without_chat",
    with_views(
        f"""SELECT e.chat_id, e.event_id, CAST(coalesce(m.last, -1) + row_number() OVER (PARTITION BY e.chat_id ORDER BY e.event_id) AS BIGINT) AS seq
           FROM (SELECT event_id, {_NO_CHAT} AS chat_id FROM events e) e
           LEFT JOIN (SELECT nullif(chat_id, 3) AS chat_id, max(seq) AS last FROM v1 GROUP BY 1) m ON m.chat_id IS NOT DISTINCT FROM e.chat_id""",
        "v1",
    ),
    row="5",
)
def q_append_without_chat(spark, sf):
    """Some new and some logged messages have no chat: they are numbered like any other chat's."""
    msgs = V.v1_messages(spark, sf).withColumn("chat_id", F.expr("nullif(chat_id, 3)"))
    e = load(spark, sf, "events", "event_id", "user_id")
    new = e.select(F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("chat_id"), "event_id", F.lit("user").alias("role"))
    return C.append_messages(msgs, new, order_by="event_id").select("chat_id", "event_id", "seq")


@register(
    "history_without_chat",
    with_views(
        """SELECT nullif(chat_id, 3) AS chat_id, seq, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) AS BIGINT) AS rank
           FROM v1 WHERE seq % 3 <> 1 AND chat_id % 2 = 1""",
        "v1",
    ),
    row="6",
)
def q_history_without_chat(spark, sf):
    """Positions are missing, and one chat has no id."""
    msgs = V.v1_messages(spark, sf).where("seq % 3 <> 1").withColumn("chat_id", F.expr("nullif(chat_id, 3)"))
    asked = msgs.where("chat_id is null or chat_id % 2 = 1").select("chat_id")
    return C.history(msgs, asked, dense=False).select("chat_id", "seq", "rank")


@register(
    "new_chats_without_time",
    """SELECT event_id, chat_id, CAST(count(*) OVER (PARTITION BY chat_id) AS BIGINT) AS n_same_id FROM (
      SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y%m%dT%H%M%S') || '_' || event_type END AS chat_id FROM events)""",
    row="4",
)
def q_new_chats_without_time(spark, sf):
    e = load(spark, sf, "events", "event_id", "ts", "event_type")
    e = e.withColumn("ts", F.when(F.col("event_id") % 5 != 0, F.col("ts")))
    return C.new_chat_rows(e, ts="ts", title="event_type").select("event_id", "chat_id", "n_same_id")


@register(
    "scan_chat_folders",
    """SELECT '00' || conv_id AS chat_id, CASE WHEN conv_id % 9 = 4 OR conv_id % 6 = 0 THEN '00' || conv_id ELSE 'Chat ' || conv_id END AS title,
         CAST(CASE WHEN conv_id % 9 = 4 THEN 0 ELSE count(*) END AS BIGINT) AS n_messages, conv_id % 9 = 4 AS corrupt
       FROM conversations GROUP BY conv_id""",
    row="1",
)
def q_scan_chat_folders(spark, sf):
    """One folder a chat, with ids such as 007, which stay text."""
    docs = derived_chat_documents(spark, sf).withColumn("chat_id", F.concat(F.lit("00"), F.col("chat_id").cast("string")))
    c = C.scan_chats(spark, write_chat_store(docs, work_dir(spark, "chat-folders")), glob=None)
    return c.select("chat_id", "title", F.coalesce(F.size("messages"), F.lit(0)).cast("bigint").alias("n_messages"), "corrupt")


@register("translate_array_repeated_keys", ORACLE["translate_array"].replace("SELECT answer_id, u.item", "SELECT answer_id % 10 AS k, u.item"), row="46")
def q_translate_array_repeated_keys(spark, sf):
    """A key that many rows share: each row keeps its own items."""
    t = V.v2_title_answers(spark, sf).select(
        (F.col("answer_id") % 10).alias("k"), P.extract_titles("text").alias("titles"), probe_code("answer_id").alias("lang")
    )
    r = T.translate_array(t, "k", "titles", F.lit("en"), "lang", M.TR, out="loc")
    return r.select("k", F.posexplode("loc").alias("pos", "item")).withColumn("pos", F.col("pos").cast("bigint"))

