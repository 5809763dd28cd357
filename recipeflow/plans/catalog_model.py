"""Registered queries: batch model map, translation memory and the four jobs
(rows 23, 43-49, 55-58).  The models are the deterministic stubs of
:mod:`recipeflow.plans.stubs`; the oracle evaluates the same stubs in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeflow.functions import constants as K
from recipeflow.functions import parse as P
from recipeflow.functions.render import SYSTEM_PROMPT
from recipeflow.operators import chatlog as C
from recipeflow.operators import modelmap as M
from recipeflow.operators import translate as T
from recipeflow.plans import jobs as J
from recipeflow.plans import sqlgen as S
from recipeflow.plans.catalog_chat import FILTER_EVENTS_SQL, filter_events
from recipeflow.plans.catalog_text import probe_code, probe_sql
from recipeflow.plans.oracle_views import with_views
from recipeflow.plans.registry import ORACLE, register
from recipeflow.plans.stubs import StubGenerator, StubTranslator
from recipeflow.session import work_dir
from recipeflow.sources import views as V
from recipeflow.sources.memory_table import MemoryTable
from recipeflow.sources.tables import load

GEN = StubGenerator()
_CODE_OK = S.can_translate("code")
_RAW_STRIPPED = S.strip("coalesce(raw, '')")
_TITLE_STRIPPED = S.strip("coalesce(title, '')")
TR = StubTranslator()


def _parse_block(src: str, key: str, text: str, prefix: str = "r") -> str:
    return S.parse_recipe_ctes(src, key, text, prefix)


def _q(sql: str, *views: str, extra=None, parse=None, after=()) -> str:
    """``with_views`` plus an optional parse CTE block placed after ``extra``, and CTEs ``after`` it."""
    ex = list(extra or [])
    if parse is not None:
        ex.append(("__p", "SELECT 1"))
    ex += after
    out = with_views(sql, *views, extra=ex)
    if parse is not None:
        out = out.replace("__p AS (SELECT 1)", _parse_block(*parse))
    return out


# ----------------------------------------------------------- map_model (43)
@register(
    "map_model",
    _q(
        f"SELECT request_id, task, {S.stub_generate('task', 'prompt')} AS text, "
        f"CASE WHEN {S.stub_fails('prompt')} THEN 'boom' END AS error FROM v9",
        "v9",
    ),
    row="43",
)
def q_map_model(spark, sf):
    r = M.map_model(V.v9_requests(spark, sf), GEN)
    return r.select("request_id", "task", "text", "error")


@register(
    "map_model_memory",
    _q(
        f"SELECT request_id, task, CASE WHEN EXISTS (SELECT 1 FROM v9 m WHERE m.request_id % 3 = 0 AND m.task = v9.task AND m.system = v9.system "
        f"AND m.prompt = v9.prompt) THEN '{{mem}}' || task "
        f"WHEN NOT {S.stub_fails('prompt')} THEN {S.stub_generate('task', 'prompt')} END AS text FROM v9",
        "v9",
    ),
    row="43",
)
def q_map_model_memory(spark, sf):
    """Earlier answers are reused; the memory holds some of them twice."""
    req = V.v9_requests(spark, sf)
    old = req.where(F.col("request_id") % 3 == 0).select(
        M.request_key("task", "system", "prompt").alias("req_key"), F.concat(F.lit("{mem}"), "task").alias("text")
    )
    return M.map_model(req, GEN, memory=old.unionByName(old)).select("request_id", "task", "text")


@register("map_model_memory_table", ORACLE["map_model_memory"], row="43")
def q_map_model_memory_table(spark, sf):
    """The second of two runs over a stored memory whose rows were appended twice and compacted."""
    req = V.v9_requests(spark, sf)
    old = M.materialize(
        req.where(F.col("request_id") % 3 == 0).select(
            M.request_key("task", "system", "prompt").alias("req_key"), F.concat(F.lit("{mem}"), "task").alias("text")
        )
    )
    store = MemoryTable(spark, work_dir(spark, "answers"), "req_key", "text", buckets=8)
    store.append(old)
    store.append(old)
    store.compact()
    M.map_model(req, GEN, memory_path=store.path)
    return M.map_model(req, GEN, memory_path=store.path).select("request_id", "task", "text")


@register(
    "distinct_requests",
    _q(
        "SELECT DISTINCT sha256(task || chr(31) || system || chr(31) || prompt) AS req_key, task, "
        "CAST(length(prompt) AS BIGINT) AS n_chars FROM v9",
        "v9",
    ),
    row="44",
)
def q_distinct_requests(spark, sf):
    d = M.distinct_requests(V.v9_requests(spark, sf))
    return d.select("req_key", "task", F.char_length("prompt").cast("bigint").alias("n_chars"))


# ------------------------------------------------------ translate (45-49)
def _memory(spark, sf):
    """Earlier translations (documents with doc_id % 3 = 0) as a memory table."""
    d = load(spark, sf, "documents", "doc_id", "text").where(F.col("doc_id") % 3 == 0)
    src, tgt = F.lit("en"), F.col("_tgt")
    d = d.withColumn("_tgt", T.safe_lang_code(probe_code("doc_id")))
    return d.select(
        T.mt_key(F.col("text"), src, tgt).alias("mt_key"),
        F.col("text"),
        src.alias("src"),
        tgt.alias("tgt"),
        F.concat(F.lit("{mem}"), F.col("text")).alias("translated"),
    ).dropDuplicates(["mt_key"])


_MEM_SQL = f"SELECT DISTINCT text, 'en' AS src, {S.safe_lang(probe_sql('doc_id'))} AS tgt, '{{mem}}' || text AS translated FROM documents WHERE doc_id % 3 = 0"


@register(
    "translate",
    _q(
        f"""SELECT q.query_id, CASE WHEN NOT q.go THEN q.raw WHEN m.translated IS NOT NULL THEN m.translated
                 WHEN {S.stub_translate_fails("'en'", 'q.code')} THEN NULL ELSE {S.stub_translate('q.raw', 'q.code')} END AS translated,
               (q.go AND m.translated IS NULL AND {S.stub_translate_fails("'en'", 'q.code')}) AS failed, q.go AS called
           FROM (SELECT query_id, raw, {S.safe_lang(probe_sql('query_id'))} AS code,
                        {S.can_translate(S.safe_lang(probe_sql('query_id')))} AS go FROM v4) q
           LEFT JOIN mem m ON m.text = q.raw AND m.tgt = q.code AND q.go""",
        "v4",
        extra=[("mem", _MEM_SQL)],
    ),
    row="45",
)
def q_translate(spark, sf):
    q = V.v4_queries(spark, sf).withColumn("_tgt", probe_code("query_id"))
    r = T.translate(q, "raw", F.lit("en"), "_tgt", TR, memory=_memory(spark, sf))
    return r.select(
        "query_id", "translated", F.col("translated_error").isNotNull().alias("failed"), F.col("translated_called").alias("called")
    )


@register("translate_memory_table", ORACLE["translate"], row="45")
def q_translate_memory_table(spark, sf):
    """As ``translate``, with the earlier translations in a stored memory; the second of two runs."""
    q = V.v4_queries(spark, sf).withColumn("_tgt", probe_code("query_id"))
    store = MemoryTable(spark, work_dir(spark, "translations"), "mt_key", "translated", buckets=8)
    store.append(M.materialize(_memory(spark, sf).select("mt_key", "translated")))
    T.translate(q, "raw", F.lit("en"), "_tgt", TR, memory_path=store.path)
    r = T.translate(q, "raw", F.lit("en"), "_tgt", TR, memory_path=store.path)
    return r.select(
        "query_id", "translated", F.col("translated_error").isNotNull().alias("failed"), F.col("translated_called").alias("called")
    )


_TITLES_SQL = f"SELECT answer_id, {S.extract_titles('text')} AS titles FROM v2"


@register(
    "translate_array",
    _q(
        f"""SELECT answer_id, u.item AS item, CAST(u.o - 1 AS BIGINT) AS pos FROM (
              SELECT answer_id, CASE WHEN {S.can_translate('code')} THEN
                list_transform(titles, lambda tx: CASE WHEN {S.stub_translate_fails("'en'", 'code')} THEN tx
                                                       ELSE {S.stub_translate(S.strip('tx'), 'code')} END)
                ELSE titles END AS l
              FROM (SELECT answer_id, titles, {S.safe_lang(probe_sql('answer_id'))} AS code FROM ti)),
            unnest(l) WITH ORDINALITY AS u(item, o)""",
        "v2",
        extra=[("ti", _TITLES_SQL)],
    ),
    row="46",
)
def q_translate_array(spark, sf):
    t = V.v2_title_answers(spark, sf).select(
        "answer_id", P.extract_titles("text").alias("titles"), probe_code("answer_id").alias("lang")
    )
    r = T.translate_array(t, "answer_id", "titles", F.lit("en"), "lang", TR, out="loc")
    return r.select("answer_id", F.posexplode("loc").alias("pos", "item")).withColumn("pos", F.col("pos").cast("bigint"))


@register(
    "translate_block",
    _q(
        f"""SELECT recipe_id, CASE WHEN {S.can_translate('code')} AND NOT {S.stub_translate_fails("'en'", 'code')}
                 THEN {S.stub_translate('text', 'code')} ELSE text END AS translated
           FROM (SELECT recipe_id, text, {S.safe_lang(probe_sql('recipe_id'))} AS code FROM v3)""",
        "v3",
    ),
    row="47",
)
def q_translate_block(spark, sf):
    v = V.v3_recipe_answers(spark, sf).withColumn("lang", probe_code("recipe_id"))
    return T.translate_block(v, "text", F.lit("en"), "lang", TR).select("recipe_id", "translated")


_RAW_SRC = "CASE WHEN query_id % 2 = 0 THEN NULL ELSE 'fr' END"


@register(
    "translate_raw",
    _q(
        f"""SELECT query_id, CASE WHEN NOT go THEN raw WHEN {S.stub_translate_fails('src', 'coalesce(tgt, chr(0))')} THEN NULL
                 ELSE {S.stub_translate('raw', 'tgt')} END AS translated,
               (go AND {S.stub_translate_fails('src', 'coalesce(tgt, chr(0))')}) AS failed
           FROM (SELECT query_id, raw, coalesce(nullif({_RAW_SRC}, ''), 'en') AS src, {probe_sql('query_id')} AS tgt,
                        ({S.strip("coalesce(raw, '')")} <> '') AS go FROM v4)""",
        "v4",
    ),
    row="48",
)
def q_translate_raw(spark, sf):
    q = V.v4_queries(spark, sf)
    q = q.withColumn("src", F.when(F.col("query_id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("fr")))
    q = q.withColumn("tgt", probe_code("query_id"))
    r = T.translate_raw(q, "raw", "src", "tgt", TR)
    return r.select("query_id", "translated", F.col("translated_error").isNotNull().alias("failed"))


_EXPLODED_TITLES_SQL = (
    f"SELECT answer_id, CAST(u.o AS BIGINT) AS rank, u.title AS title FROM ({_TITLES_SQL}), "
    f"unnest(titles) WITH ORDINALITY AS u(title, o)"
)


@register(
    "back_translate_title",
    _q(
        f"""SELECT answer_id, rank, CASE WHEN code <> 'en' AND {S.can_translate('code')} AND NOT {S.stub_translate_fails('code', "'en'")}
                 THEN {S.stub_translate('title', "'en'")} ELSE title END AS title_en
           FROM (SELECT answer_id, rank, title, {S.safe_lang(probe_sql('answer_id'))} AS code FROM et)""",
        "v2",
        extra=[("et", _EXPLODED_TITLES_SQL)],
    ),
    row="49",
)
def q_back_translate_title(spark, sf):
    t = V.v2_title_answers(spark, sf).select("answer_id", P.extract_titles("text").alias("titles"))
    e = M.materialize(C.explode_titles(t, "answer_id").withColumn("lang", probe_code("answer_id")))
    r = T.back_translate_title(e, "title", "lang", TR)
    return r.select("answer_id", "rank", "title_en")


@register(
    "query_to_english",
    _q(
        f"""SELECT query_id, CASE WHEN s = '' THEN ''
                 WHEN code <> 'en' AND {S.can_translate('code')} AND NOT {S.stub_translate_fails('code', "'en'")}
                      AND regexp_matches({S.stub_translate('s', "'en'")}, '[A-Za-z]') THEN {S.stub_translate('s', "'en'")}
                 ELSE {S.normalize_query('s', 'code')} END AS query_en
           FROM (SELECT query_id, {S.strip("coalesce(raw, '')")} AS s, {S.safe_lang(probe_sql('query_id'))} AS code FROM v4)""",
        "v4",
    ),
    row="23",
)
def q_query_to_english(spark, sf):
    q = V.v4_queries(spark, sf).withColumn("lang", probe_code("query_id"))
    return T.query_to_english(q, "raw", "lang", TR).select("query_id", "query_en")


# ------------------------------------------------------------ jobs (55-58)
def _logged(key: str, chat: str, rows: str) -> str:
    """Message rows (key, turn, role, content) at the next positions of chat ``chat`` in the log v1."""
    return f"""SELECT {key}, m.chat_id, role, content,
             CAST(coalesce(l.last, -1) + row_number() OVER (PARTITION BY m.chat_id ORDER BY {key}, turn) AS BIGINT) AS seq
           FROM (SELECT *, {chat} AS chat_id FROM ({rows})) m
           LEFT JOIN (SELECT chat_id, max(seq) AS last FROM v1 GROUP BY chat_id) l ON l.chat_id = m.chat_id"""


def _tr_list(arr: str, code: str, gate: str) -> str:
    return (
        f"CASE WHEN {gate} THEN list_transform({arr}, lambda ix: CASE WHEN {S.stub_translate_fails(chr(39) + 'en' + chr(39), code)} "
        f"THEN ix ELSE {S.stub_translate(S.strip('ix'), code)} END) ELSE {arr} END"
    )


@register(
    "suggest_job",
    _q(
        _logged(
            "query_id",
            "query_id // 5",
            f"""SELECT query_id, 0 AS turn, 'user' AS role, raw AS content FROM tl
           UNION ALL SELECT query_id, 1 AS turn, 'assistant' AS role, {S.render_titles('titles')} AS content FROM tl""",
        ),
        "v1",
        "v4",
        extra=[
            ("q", f"SELECT query_id, {_RAW_STRIPPED} AS raw, {S.safe_lang('display_lang')} AS code FROM v4"),
            ("q2", f"SELECT query_id, raw, code, {S.suggest_prompt(S.normalize_query('raw', 'code'))} AS prompt FROM q"),
            (
                "a",
                f"SELECT query_id, raw, code, CASE WHEN {S.stub_fails('prompt')} THEN {S.lit(K.DEFAULT_TITLES_TEXT)} "
                f"ELSE {S.stub_generate(chr(39) + 'suggest' + chr(39), 'prompt')} END AS text_en FROM q2",
            ),
            ("t", f"SELECT query_id, raw, code, {S.extract_titles('text_en')} AS titles FROM a"),
            (
                "tl",
                f"SELECT query_id, raw, {_tr_list('titles', 'code', f'code <> {chr(39)}en{chr(39)} AND {_CODE_OK}')} AS titles FROM t",
            ),
        ],
    ),
    row="55",
)
def q_suggest_job(spark, sf):
    queries = V.v4_queries(spark, sf).withColumn("chat_id", F.floor(F.col("query_id") / 5))
    out = J.suggest_job(queries, GEN, TR, log=V.v1_messages(spark, sf))
    return out.select("query_id", "chat_id", "seq", "role", "content")


def job_titles(spark, sf):
    t = V.v2_title_answers(spark, sf).select("answer_id", P.extract_titles("text").alias("titles"))
    e = C.explode_titles(t, "answer_id")
    return e.select(
        F.concat_ws("-", "answer_id", "rank").alias("title_id"),
        F.floor(F.col("answer_id") / 50).alias("chat_id"),
        "title",
        probe_code("answer_id").alias("display_lang"),
    )


_DEF_ING = S.str_list(K.DEFAULT_INGREDIENTS)
_DEF_STEPS = S.str_list(K.DEFAULT_STEPS)
_RECIPES_SQL = (
    f"SELECT a.title_id, a.title, a.code, a.failed, CASE WHEN a.failed THEN {_DEF_ING} ELSE r.ingredients END AS ing, "
    f"CASE WHEN a.failed THEN {_DEF_STEPS} ELSE r.steps END AS steps FROM a JOIN r_rec r ON r.k = a.title_id"
)
_RECIPE_GATE = f"NOT failed AND code <> 'en' AND {_CODE_OK}"
_TRANSLATED_SQL = (
    f"SELECT title_id, title, code, {_tr_list('ing', 'code', _RECIPE_GATE)} AS ing, "
    f"{_tr_list('steps', 'code', _RECIPE_GATE)} AS steps FROM rr"
)


@register(
    "recipe_job",
    _q(
        _logged(
            "title_id",
            "CAST(split_part(title_id, '-', 1) AS BIGINT) // 50",
            f"""SELECT title_id, 0 AS turn, 'user' AS role, {S.lit(K.SELECTED_RECIPE_PREFIX)} || title AS content FROM tr
           UNION ALL SELECT title_id, 1 AS turn, 'assistant' AS role, {S.render_recipe('ing', 'steps', 'code')} AS content FROM tr""",
        ),
        "v1",
        "v2",
        extra=[
            ("et", _EXPLODED_TITLES_SQL),
            ("ti", f"SELECT answer_id || '-' || rank AS title_id, title, {probe_sql('answer_id')} AS display_lang FROM et"),
            ("t0", f"SELECT title_id, {_TITLE_STRIPPED} AS title, {S.safe_lang('display_lang')} AS code FROM ti"),
            (
                "be",
                f"SELECT title_id, title, code, CASE WHEN code <> 'en' AND {S.can_translate('code')} AND NOT {S.stub_translate_fails('code', chr(39) + 'en' + chr(39))} "
                f"THEN {S.stub_translate('title', chr(39) + 'en' + chr(39))} ELSE title END AS title_en FROM t0",
            ),
            ("pr", f"SELECT title_id, title, code, {S.detail_prompt('title_en')} AS prompt FROM be"),
            (
                "a",
                f"SELECT title_id, title, code, {S.stub_fails('prompt')} AS failed, {S.stub_generate(chr(39) + 'detail' + chr(39), 'prompt')} AS text FROM pr",
            ),
        ],
        parse=("a", "title_id", "text", "r"),
        after=[("rr", _RECIPES_SQL), ("tr", _TRANSLATED_SQL)],
    ),
    row="56",
)
def q_recipe_job(spark, sf):
    out = J.recipe_job(job_titles(spark, sf), GEN, TR, log=V.v1_messages(spark, sf))
    return out.select("title_id", "chat_id", "seq", "role", "content")


@register(
    "nutrition_job",
    _q(
        f"""SELECT list_id, CASE WHEN len(items) = 0 THEN {S.lit(K.NO_INGREDIENTS_TEXT)} WHEN {S.stub_fails('prompt')} THEN NULL
                 ELSE {S.strip(S.stub_generate(chr(39) + 'nutrition' + chr(39), 'prompt'))} END AS text,
               CASE WHEN len(items) > 0 AND {S.stub_fails('prompt')} THEN 'boom' END AS error
           FROM (SELECT list_id, items, {S.nutrition_prompt('items')} AS prompt FROM
             (SELECT k AS list_id, list_filter(list_transform(string_split(array_to_string(ingredients, ' ,, '), ','),
                     lambda ix: {S.strip('ix')}), lambda ix: ix <> '') AS items FROM r_rec))""",
        "v3",
        parse=("v3", "recipe_id", "text", "r"),
    ),
    row="57",
)
def q_nutrition_job(spark, sf):
    v = P.with_recipe(V.v3_recipe_answers(spark, sf), "text", cap=False).select(
        F.col("recipe_id").alias("list_id"), F.array_join(F.col("recipe.ingredients"), " ,, ").alias("items")
    )
    return J.nutrition_job(v, GEN)


_LATEST_SQL = """SELECT chat_id, arg_max(r_title, seq) AS title, arg_max(r_ing, seq) AS ing, arg_max(r_steps, seq) AS steps
FROM v1 WHERE has_recipe GROUP BY chat_id"""


@register(
    "health_job",
    _q(
        f"""SELECT tr.chat_id, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN NOT failed THEN (SELECT max(v1.seq) + 1 FROM v1 WHERE v1.chat_id = tr.chat_id) END AS seq,
               CASE WHEN NOT failed THEN {S.check_block('title', 'text_loc')} END AS content FROM tr
           UNION ALL SELECT chat_id, 'rejected' AS status, NULL AS seq, NULL AS content FROM lt WHERE NOT (len(ing) > 0 OR len(steps) > 0)""",
        "v1",
        "v5",
        extra=[
            ("lt", _LATEST_SQL),
            ("fe", FILTER_EVENTS_SQL),
            ("ff", "SELECT chat_id, arg_max(tags, seq) AS tags FROM fe GROUP BY chat_id"),
            (
                "j",
                f"SELECT l.chat_id, l.title, {S.health_prompt('l.ing', 'l.steps', 'coalesce(f.tags, []::VARCHAR[])')} AS prompt, "
                f"{S.safe_lang(probe_sql('l.chat_id'))} AS code FROM lt l LEFT JOIN ff f ON f.chat_id = l.chat_id "
                f"WHERE len(l.ing) > 0 OR len(l.steps) > 0",
            ),
            (
                "a",
                f"SELECT chat_id, title, code, {S.stub_fails('prompt')} AS failed, "
                f"{S.strip(S.stub_generate(chr(39) + 'health' + chr(39), 'prompt'))} AS text_en FROM j",
            ),
            (
                "tr",
                f"SELECT chat_id, title, failed, CASE WHEN code <> 'en' AND {S.can_translate('code')} AND NOT {S.stub_translate_fails(chr(39) + 'en' + chr(39), 'code')} "
                f"THEN {S.stub_translate('text_en', 'code')} ELSE text_en END AS text_loc FROM a",
            ),
        ],
    ),
    row="58",
)
def q_health_job(spark, sf):
    msgs = V.v1_messages(spark, sf)
    chats = msgs.select("chat_id").distinct()
    filters = C.upsert_filters(filter_events(spark, sf), chats)
    langs = chats.select("chat_id", probe_code("chat_id").alias("display_lang"))
    checks, rejected = J.health_job(msgs, filters, langs, GEN, TR)
    return checks.select("chat_id", "status", "seq", "content").unionByName(
        rejected.select(
            "chat_id",
            F.lit("rejected").alias("status"),
            F.lit(None).cast("bigint").alias("seq"),
            F.lit(None).cast("string").alias("content"),
        )
    )


assert SYSTEM_PROMPT
